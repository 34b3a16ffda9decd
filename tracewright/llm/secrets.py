r"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every historical version (here: every document) is content-addressed. A blob meets a rule's patterns, its gate included,
only where the ledger does not hold that pair of blob and rule version yet; the ledger holds clean blobs too. The
findings are joined back to all paths that carry the blob. Text travels only for gated blobs, once each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._spans import match_spans, walk


@dataclass(frozen=True)
class Rule:
    """`pattern` finds candidates; one is kept if it is `keep`-matched as a whole. `gate` is implied by a kept match."""

    kind: str
    version: int
    pattern: str
    keep: str
    gate: str
    base: bool = False


_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_BETWEEN = r"[\"']?\x20*[:=]\x20*[\"']?"
_KEY_HEAD = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
_KEY_END = r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
_GAP = r"(?:\s|\\[nrt])"
#: A key runs to its END line if that is the next line of dashes; otherwise over its headers and the lines of base64, the last of any length.
_KEY_BODY = (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+" + _KEY_END + r"|(?:" + _GAP + r"*+(?:Proc-Type|DEK-Info|Comment|Version|X-[A-Za-z-]+):[^\r\n\\]*+)*+"
    r"(?:(?:" + _GAP + r"*+[A-Za-z0-9+/]{16,}+={0,2}+)++(?:" + _GAP + r"++[A-Za-z0-9+/]++={0,2}+(?=[\x20\t\\\r\n]|\z)(?=[\x20\t]*+(?:[\\\r\n]|-----END|\z)))?+)?+)"
)
#: The first three are the base kinds, in their listed order; the others are the method's own.
RULES = (
    Rule("assign", 1, _KEYWORD + _BETWEEN + r"[A-Za-z0-9+/_.=-]+", _KEYWORD + _BETWEEN + r"[A-Za-z0-9+/_.=-]{6,}", _KEYWORD + _BETWEEN + r"[A-Za-z0-9+/_.=-]{6}", True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}", True),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", True),
    Rule("private_key", 2, _KEY_HEAD + _KEY_BODY, r"(?s:.*)", _KEY_HEAD),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,255}", r".*", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r".*", r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", r".*", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", 1, r"[sr]k_live_[A-Za-z0-9]{16,}", r".*", r"[sr]k_live_[A-Za-z0-9]{16}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r".*", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8}"),
)
FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _quoted(s: str) -> str:
    """A raw SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gate(rules: tuple[Rule, ...] = RULES) -> str:
    """A pattern that every text with a finding matches."""
    return "|".join(f"(?:{r.gate})" for r in rules)


def _rule_findings(rule: Rule, rank: int, text: str) -> str:
    """SQL: kept findings of one rule in `text`."""
    spans = match_spans(text, _quoted(rule.pattern))
    return f"""transform(
        filter({spans}, s -> regexp_like(substring({text}, s.start + 1, s.end - s.start), {_quoted("^(?:" + rule.keep + ")$")})),
        s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{rule.kind}'))"""


def _versions(rules: tuple[Rule, ...]) -> str:
    return ", ".join(f"'{r.kind}:{r.version}'" for r in rules)


def _unseen(rules: tuple[Rule, ...]) -> str:
    """SQL: lacks `known` a rule version?"""
    return f"size(array_except(array({_versions(rules)}), known)) > 0"


def _current(rules: tuple[Rule, ...]) -> str:
    """SQL: the findings in `found` whose rule version is still in use and in `known`."""
    return f"filter(found, f -> exists(array({_versions(rules)}), v -> startswith(v, concat(f.kind, ':')) AND array_contains(known, v)))"


def _done(rules: tuple[Rule, ...]) -> str:
    return f"array_union(known, array({_versions(rules)})) AS rules"


def _scan(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows (blob, rules, findings) of texts that passed the gate (blob, _text, known, found), each distinct blob once.

    A rule runs on a blob only where `known` lacks that version of it.
    """
    blobs = rows.groupBy("blob").agg(*[F.first(c).alias(c) for c in ("_text", "known", "found")])
    nothing = f"cast(array() AS {FINDINGS})"
    scans = [
        f"if(array_contains(known, '{r.kind}:{r.version}') OR NOT regexp_like(_text, {_quoted(r.gate)}), {nothing}, {_rule_findings(r, k, '_text')})"
        for k, r in enumerate(rules)
    ]
    return blobs.selectExpr("blob", _done(rules), f"array_sort(concat({_current(rules)}, {', '.join(scans)})) AS findings")


def scan_history(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    path: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(versions, ledger): versions is one row per row of `docs`: doc_id, blob, findings (by start, then rule order); the
    returned ledger is one row per blob, clean or not: blob, rules (kind:version scanned), findings, the old one's included.

    `ledger` is what an earlier run returned: its (blob, rule version) pairs are not scanned again, and no pattern runs on
    a blob of which it holds every rule. Null text is the empty blob. Repeated rows and repeated ids are separate paths;
    other columns are ignored; an empty table gives empty results.
    """
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{path}`").alias("doc_id"), content.alias("_text")).withColumn("blob", F.unhex(F.sha2("_text", 256)))
    nothing = f"cast(array() AS {FINDINGS})"
    if ledger is None:
        rows = rows.selectExpr("*", "cast(array() AS array<string>) AS known", f"{nothing} AS found")
    else:
        held = ledger.selectExpr("blob", "rules AS known", "findings AS found")
        rows = rows.join(held, "blob", "left").selectExpr("doc_id", "_text", "blob", "coalesce(known, cast(array() AS array<string>)) AS known", f"coalesce(found, {nothing}) AS found")
    gated = f"if({_unseen(rules)}, if(regexp_like(_text, {_quoted(gate(rules))}), _text, NULL), NULL)"
    versions = materialize(rows.selectExpr("doc_id", "blob", f"{gated} AS _text", "known", "found"))
    scanned = materialize(_scan(versions.where(F.col("_text").isNotNull()), rules))
    current, done = _current(rules), _done(rules)
    # what the gate held back stays as the ledger has it
    rest = versions.where(F.col("_text").isNull()).selectExpr("doc_id", "blob", f"{current} AS findings")
    paths = versions.where(F.col("_text").isNotNull()).select("doc_id", "blob").join(scanned.select("blob", "findings"), "blob")
    clean = versions.where(F.col("_text").isNull()).groupBy("blob").agg(F.first("known").alias("known"), F.first("found").alias("found")).selectExpr("blob", done, f"{current} AS findings")
    grown = scanned.unionByName(clean)
    if ledger is not None:
        grown = grown.unionByName(ledger.join(grown.select("blob"), "blob", "left_anti").select(grown.columns))
    return paths.select("doc_id", "blob", "findings").unionByName(rest), grown


def secret_digest(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text."""
    base = [r.kind for r in rules if r.base]
    listed = ", ".join(f"'{k}'" for k in base)
    shown = "transform({}, f -> concat_ws(':', f.kind, f.start, f.end))"
    counts = [f"cast(size(filter(findings, f -> f.kind = '{k}')) AS long) AS n_{k}" for k in base]
    return versions.selectExpr(
        "doc_id",
        *counts,
        f"sha2(array_join({shown.format(f'filter(findings, f -> f.kind IN ({listed}))')}, ','), 256) AS base_sha256",
        f"array_join({shown.format('findings')}, ',') AS spans",
    )


def mask(text: str, findings: str, mark: str) -> str:
    """SQL for `text` with every finding replaced; overlapping findings share one mark."""
    reach = lambda f, at: f"aggregate({f}, {at}, (m, x) -> greatest(m, x.end))"
    pieces = walk(
        findings,
        "0",
        lambda b: reach(b, "0"),
        lambda c, t: f"greatest({c}, {t})",
        f"""aggregate({{0}}, named_struct('at', {{1}}, 'out', cast(array() AS array<string>)),
        (a, f) -> named_struct('at', greatest(a.at, f.end), 'out', if(f.start < a.at, a.out,
            concat(a.out, array(substring({text}, a.at + 1, f.start - a.at), {_quoted(mark)})))),
        a -> a.out)""".format,
    )
    return f"concat(array_join({pieces}, ''), substring({text}, {reach(findings, '0')} + 1))"


def redact_history(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(`docs`, all rows and columns, with every secret replaced by `mark`; the grown ledger). Null text stays null.

    A blob of which the ledger holds every rule meets no pattern, the gate included: its findings are looked up. The
    others meet the gate once, its answer is written with the rows, and each distinct blob that passes is scanned. Only
    rows with findings are rewritten.
    """
    # whole rows as one column: no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    content = F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit(""))
    rows = docs.select(row).withColumn("blob", F.unhex(F.sha2(content, 256)))
    nothing = f"cast(array() AS {FINDINGS})"
    if ledger is None:
        rows = rows.selectExpr("*", "cast(array() AS array<string>) AS known", f"{nothing} AS found")
    else:
        rows = rows.join(ledger.selectExpr("blob", "rules AS known", "findings AS found"), "blob", "left")
        rows = rows.selectExpr("_row", "blob", "coalesce(known, cast(array() AS array<string>)) AS known", f"coalesce(found, {nothing}) AS found")
    asked = F.when(F.expr(_unseen(rules)), content.rlike(gate(rules))).otherwise(F.lit(False))
    marked = materialize(rows.withColumn("gated", asked))
    hot = marked.where("gated")
    scanned = materialize(_scan(hot.select("blob", content.alias("_text"), "known", "found"), rules))
    # one plan part a case, so that texts without findings are not shuffled
    fresh = hot.select("_row", "blob").join(scanned.where(F.size("findings") > 0).select("blob", "findings"), "blob", "left")
    held = marked.where("NOT gated").selectExpr("_row", f"{_current(rules)} AS findings")
    told = F.coalesce(F.size("findings"), F.lit(0)) > 0
    shown = [F.when(told, F.expr(mask(f"_row.`{c}`", "findings", mark))).otherwise(F.col(f"_row.`{c}`")).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    clean = marked.where("NOT gated").groupBy("blob").agg(F.first("known").alias("known"), F.first("found").alias("found")).selectExpr("blob", _done(rules), f"{_current(rules)} AS findings")
    grown = scanned.unionByName(clean)
    if ledger is not None:
        grown = grown.unionByName(ledger.join(grown.select("blob"), "blob", "left_anti").select(grown.columns))
    return held.select(*shown).unionByName(fresh.select("_row", "findings").select(*shown)), grown
