"""Names are looked up and compared once, however many packages bear them."""

from pyspark.sql import functions as F

from tracewright.operators import typosquat
from tracewright.plans import analysis, packages


def test_copies_of_a_name_are_looked_up_once(spark):
    corpus = typosquat.merge_corpus(spark.createDataFrame([(10, "react", 1, None, [1]), (20, "express", None, None, [2])], "package_id long, name string, rank long, popularity long, evidence_ids array<long>"))
    words = ["raect", "exprees", "REACT", "bad name", None, "@evil/react"]
    seen = spark.createDataFrame([(i, words[i % len(words)]) for i in range(60)], "observed_id long, name string")
    names = typosquat.distinct_names(seen)
    assert sorted(r.name for r in names.collect()) == ["@evil/react", "REACT", "exprees", "raect"]
    by_name = typosquat.candidates(names, corpus, key="name")
    rows = typosquat.compare(by_name, names, corpus, "name")
    each = typosquat.comparable(seen)
    plain = typosquat.compare(typosquat.candidates(each, corpus), each, corpus)
    shown = ["observed_id", "package_id", "reasons", "matches", "exact_matches", "place", "transformations", "accepted", "strong"]
    whole = seen.join(rows, "name").select(*shown)
    assert whole.count() == 30 and sorted(map(str, whole.collect())) == sorted(map(str, plain.select(*shown).collect()))


def test_registered_queries_do_not_work_by_package(spark, sf_dir, monkeypatch, tmp_path):
    """Ten parts for each one, with the same names: as many names are looked up and compared."""
    rows = []
    lookup, compare = typosquat.observed_signatures, typosquat.compare
    monkeypatch.setattr(typosquat, "observed_signatures", lambda observed, *key: (rows.append(observed.count()), lookup(observed, *key))[1])
    monkeypatch.setattr(typosquat, "compare", lambda found, *more: (rows.append(found.count()), compare(found, *more))[1])
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = part.agg(F.max("p_partkey")).first()[0] + 1
    shift = 84 * 11 * 9 * 5 * n  # a multiple of 7 and of every length, so that a copy is mutated alike
    for folder, times in (("one", 1), ("ten", 10)):
        copies = spark.range(times).withColumnRenamed("id", "r")
        part.crossJoin(copies).withColumn("p_partkey", F.col("p_partkey") + F.col("r") * shift).drop("r").write.parquet(str(tmp_path / folder / "part.parquet"))
    queries = (packages.j8_candidates, packages.typosquat_findings, analysis.w5_budget)
    one, ten = [], []
    for q in queries:
        one.append(q(spark, str(tmp_path / "one")).count())
    few = list(rows)
    rows.clear()
    for q in queries:
        ten.append(q(spark, str(tmp_path / "ten")).count())
    assert rows == few and ten[:2] == [10 * k for k in one[:2]] and len(few) == 4
