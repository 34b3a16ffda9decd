"""Typosquat detection: signature joins find candidates, the edit distance and gates judge them, reasons add to a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import materialize

#: Bounds of a scan.
MAX_CANDIDATES, MAX_COMPARISONS, MAX_DISTANCE, DELETIONS = 32, 200_000, 0.25, 2
MONTH = 30 * 86_400_000
#: Order of the transformations that explain a candidate, and those that add to its score.
TRANSFORMATIONS = ("adjacent-transposition", "insertion", "deletion", "substitution", "separator-variation", "repeated-character", "scope-impersonation", "unicode-confusable", "prefix-suffix")
SPECIAL = ("adjacent-transposition", "separator-variation", "repeated-character", "scope-impersonation", "unicode-confusable", "prefix-suffix")
CLASSES = ("candidate", "suspicious", "high-confidence")


def comparable(packages: DataFrame) -> DataFrame:
    """Valid names with normalized, scope, base, compact and skeleton."""
    n = F.col("normalized")
    valid = packages.withColumn("normalized", N.normalized(F.col("name"))).where(N.name_error(F.col("name"), n).isNull())
    return valid.withColumns({"scope": N.scope_of(n), "base": N.basename(n), "skeleton": N.skeleton(n)}).withColumn("compact", N.compact(F.col("base")))


def distinct_names(packages: DataFrame) -> DataFrame:
    """Every valid name once with its comparable forms, dealt by name and written: what follows from a name alone is worked
    out by name (`key` of the steps below), however many packages bear it."""
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(comparable(packages.select("name").distinct().repartition(parts, "name")))


def invalid_names(packages: DataFrame) -> DataFrame:
    return packages.withColumn("error", N.name_error(F.col("name"), N.normalized(F.col("name")))).where(F.col("error").isNotNull())


def merge_corpus(targets: DataFrame) -> DataFrame:
    """One target per normalised name: least package id, least rank, most popularity, all evidence."""
    return comparable(targets).groupBy("normalized", "scope", "base", "skeleton", "compact").agg(
        F.min("package_id").alias("package_id"), F.min("rank").alias("rank"), F.max("popularity").alias("popularity"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids")
    )


def _signature(reason: str, value: Column, exact: bool = False, reported: str | None = None) -> Column:
    return F.struct(F.lit(reason).alias("reason"), value.alias("value"), F.lit(reported or reason).alias("reported"), F.lit(exact).alias("exact"))


def target_signatures(targets: DataFrame) -> DataFrame:
    """(reason, value, package_id) of every target, the inverted index."""
    single = F.array(_signature("compact", F.col("compact")), _signature("basename", F.col("base")), _signature("confusable", F.col("skeleton")), _signature("same-scope", F.coalesce("scope", F.lit(""))))
    deleted = F.transform(N.deletion_variants(F.col("compact"), DELETIONS), lambda v: _signature("deletion", v))
    return targets.select("package_id", F.explode(F.concat(single, deleted)).alias("s")).select("s.reason", "s.value", "package_id").distinct()


def observed_signatures(observed: DataFrame, key: str = "observed_id") -> DataFrame:
    """(key, reason, value, reported, exact): what an observed name is looked up by."""
    variants = N.deletion_variants(F.col("compact"), DELETIONS)
    single = F.array(_signature("compact", F.col("compact")), _signature("basename", F.col("base")), _signature("confusable", F.col("skeleton")))
    exact = F.transform(F.filter(variants, lambda v: v != F.col("compact")), lambda v: _signature("compact", v, True, "deletion"))
    deleted = F.transform(variants, lambda v: _signature("deletion", v))
    scoped = F.when(F.col("scope").isNotNull(), F.array(_signature("same-scope", F.col("scope")))).otherwise(F.array().cast("array<struct<reason:string,value:string,reported:string,exact:boolean>>"))
    return observed.select(key, "normalized", "compact", F.explode(F.concat(single, exact, deleted, scoped)).alias("s")).select(key, "normalized", "compact", "s.*")


def candidates(observed: DataFrame, targets: DataFrame, limit: int = MAX_CANDIDATES, key: str = "observed_id") -> DataFrame:
    """The `limit` best targets of every observed name: `key`, package_id, reasons, matches, exact_matches, place.

    Ranked by kind of signature, exact variants, matches, difference in length, prominence, name and id. Prominent is a
    target with rank or popularity.
    """
    hits = observed_signatures(observed, key).join(target_signatures(targets), ["reason", "value"])
    of_target = targets.select("package_id", F.col("normalized").alias("target_name"), F.length("compact").alias("target_length"), (F.col("rank").isNotNull() | F.col("popularity").isNotNull()).alias("prominent"))
    grouped = hits.groupBy(key, "normalized", F.length("compact").alias("length"), "package_id").agg(F.array_sort(F.collect_set("reported")).alias("reasons"), F.count("*").alias("matches"), F.count_if("exact").alias("exact_matches"))
    has = lambda r: F.array_contains("reasons", r)
    priority = F.when(has("compact") | has("confusable"), 4).when(has("basename"), 3).when(has("deletion"), 2).otherwise(1)
    ranked = grouped.join(of_target, "package_id").where(F.col("target_name") != F.col("normalized"))
    order = Window.partitionBy(key).orderBy(
        priority.desc(), F.col("exact_matches").desc(), F.col("matches").desc(), F.abs(F.col("target_length") - F.col("length")), F.col("prominent").desc(), "target_name", "package_id"
    )
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select(key, "package_id", "reasons", "matches", "exact_matches", "prominent", "place")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1+", "$1")


def compare(found: DataFrame, observed: DataFrame, targets: DataFrame, key: str = "observed_id") -> DataFrame:
    """Candidate pairs with distance, transformations, accepted and strong."""
    o = observed.select(key, *[F.col(c).alias(f"o_{c}") for c in ("normalized", "scope", "base", "compact", "skeleton")])
    t = targets.select("package_id", "popularity", *[F.col(c).alias(f"t_{c}") for c in ("normalized", "scope", "base", "compact", "skeleton")])
    pairs = found.join(o, key).join(t, "package_id").withColumn("distance", N.weighted_distance(F.col("t_compact"), F.col("o_compact")))
    same_scope = F.col("t_scope").eqNullSafe(F.col("o_scope"))
    same_compact = F.col("t_compact") == F.col("o_compact")
    confusable = F.col("t_skeleton") == F.col("o_skeleton")
    tests = {
        "separator-variation": same_scope & (F.col("t_base") != F.col("o_base")) & same_compact,
        "scope-impersonation": ~same_scope & ((F.col("t_base") == F.col("o_base")) | same_compact),
        "unicode-confusable": (F.col("t_normalized") != F.col("o_normalized")) & confusable,
        "prefix-suffix": ~same_compact
        & (F.col("o_compact").startswith(F.col("t_compact")) | F.col("o_compact").endswith(F.col("t_compact")) | F.col("t_compact").startswith(F.col("o_compact")) | F.col("t_compact").endswith(F.col("o_compact"))),
        "repeated-character": F.col("o_compact").rlike(r"(.)\1") & (_squeezed(F.col("o_compact")) == _squeezed(F.col("t_compact"))),
    }
    edits = F.col("distance.kinds")
    found_kinds = [F.when(tests[k] if k in tests else F.array_contains(edits, k), k) for k in TRANSFORMATIONS]
    rows = pairs.withColumn("transformations", F.array_compact(F.array(*found_kinds)))
    has = lambda k: F.array_contains("transformations", k)
    length = F.least(F.length("t_compact"), F.length("o_compact"))
    transposed = (F.size(edits) == 1) & F.array_contains(edits, "adjacent-transposition")
    affix = has("prefix-suffix") & (F.abs(F.length("t_compact") - F.length("o_compact")) <= 2)
    special = same_compact | confusable | transposed | has("repeated-character") | affix
    cost, share = F.col("distance.cost"), F.col("distance.normalized")
    accepted = (
        F.when(length <= 3, same_compact | confusable).when(length == 4, same_compact | confusable | transposed | has("repeated-character")).when(length <= 7, (cost <= 100) | special).otherwise(((cost <= 200) & (share <= MAX_DISTANCE)) | special)
    ) & ((share <= MAX_DISTANCE) | special)
    strong = same_compact | confusable | ((length >= 4) & (transposed | has("repeated-character"))) | ((length >= 5) & (cost <= 100) & (share <= 0.2))
    return rows.withColumns({"accepted": accepted, "strong": accepted & strong, "same_compact": same_compact, "confusable": confusable})


def score(compared: DataFrame, context: DataFrame, generated_at: int, key: str = "observed_id") -> DataFrame:
    """Findings of accepted pairs: observed_id, package_id, score (at most 100), classification, categories.

    context: `key`, observed_id, source, published_at, downloads, scripts, maintainer_differs, evidence_ids, contexts
    (array of struct category, evidence_ids), blocklisted. High confidence takes a strong match seen in a lockfile and
    two categories with evidence that can be told apart: two sets with at least two ids between them.
    """
    rows = compared.where("accepted").join(context, key)
    recent = F.coalesce((F.col("published_at") <= generated_at) & (F.lit(generated_at) - F.col("published_at") <= MONTH), F.lit(False))
    imbalance = F.coalesce(F.col("downloads").isNotNull() & (F.col("popularity") >= 1000) & (F.col("popularity") >= F.greatest(F.col("downloads") * 100, F.lit(1000))), F.lit(False))
    own = lambda name, test: F.when(test, F.struct(F.lit(name).alias("category"), F.col("evidence_ids").alias("evidence_ids")))
    metadata = F.array_compact(
        F.array(own("publication", recent), own("downloads", imbalance), own("lifecycle-scripts", F.col("scripts") > 0), own("maintainer", F.col("maintainer_differs")), own("policy:blocklist", F.col("blocklisted")))
    )
    categories = F.concat(metadata, F.col("contexts"))
    pair_ok = F.exists("categories", lambda a: F.exists("categories", lambda b: (a["category"] < b["category"]) & (F.size(a["evidence_ids"]) > 0) & (F.size(b["evidence_ids"]) > 0) & (F.size(F.array_union(a["evidence_ids"], b["evidence_ids"])) >= 2)))
    points = lambda test, n: F.when(test, n).otherwise(0)
    share = F.col("distance.normalized")
    total = (
        F.when(share <= 0.1, 38).when(F.col("strong"), 30).otherwise(22)
        + points(F.col("same_compact"), 24)
        + points(F.col("confusable"), 32)
        + points(F.arrays_overlap("transformations", F.array(*map(F.lit, SPECIAL))), 16)
        + points(recent, 9)
        + points(imbalance, 9)
        + points(F.col("scripts") > 0, 10)
        + points(F.col("maintainer_differs"), 9)
        + 10 * F.size("contexts")
        + points(F.col("source") == "lockfile", 12)
        + points(F.col("blocklisted"), 24)
    )
    level = F.when(F.col("strong") & (F.col("source") == "lockfile") & pair_ok, "high-confidence").when(F.size("categories") > 0, "suspicious").otherwise("candidate")
    return rows.withColumn("categories", categories).select(
        "observed_id", "package_id", "transformations", "strong", F.col("distance.cost").cast("long").alias("cost"), F.least(total, F.lit(100)).cast("long").alias("score"), level.alias("classification"), F.array_sort(F.array_distinct(F.transform("categories", lambda c: c["category"]))).alias("categories")
    )


def within_budget(found: DataFrame, max_packages: int, max_comparisons: int = MAX_COMPARISONS) -> DataFrame:
    """Candidates of the first `max_packages` observed names, the first `max_comparisons` of them by (name, place)."""
    packages = found.select("observed_id").distinct().orderBy("observed_id").limit(max_packages)
    return found.join(packages, "observed_id", "left_semi").orderBy("observed_id", "place").limit(max_comparisons)


def finding_token(*parts: Column) -> Column:
    """SHA-256 of the JSON tuple that identifies a finding."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
