"""Source divergence, token files and filter audit against slow definitions, and their odd cases."""

import itertools
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from tracewright.llm import divergence, filter_audit, token_files
from tracewright.llm._bytes import BLANK, pieces
from tracewright.session import shared_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "Alpha beta beta Ünïcode É x", "en", "a"),
    (2, "alpha beta gamma ünïcode", "en", "b"),
    (3, "ALPHA beta delta ünïcode x x x x", "en", "a"),
    (4, None, "en", "c"),
    (5, "1234 ##", None, None),
    (6, "alpha alpha", None, None),
    (6, "alpha alpha", None, None),
    (7, "alpha", None, "z"),
    (7, "alpha", "de", "z"),
    (None, "", "de", None),
    (None, "beta alpha", "en", ""),
    (8, "beta " * 5000 + "alpha", "en", "b"),
]


def slow_divergence(rows, least, top):
    """The definition, over plain integers."""
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in texts}:
        mine = [x for x in texts if x[0] == lang]
        kept = {t for t in {t for x in mine for t in x[2]} if sum(t in x[2] for x in mine) >= least}
        groups = {s: [t for x in mine if x[1] == s for t in x[2] if t in kept] for _, s, _ in mine}
        everything = [t for ts in groups.values() for t in ts]
        share = lambda ts, t: 1 + 10**9 * (ts.count(t) + 1) // (len(ts) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, ts in groups.items():
            lines = {"pair": [(sum(f(share(ts, t), share(us, t)) for t in kept), o) for o, us in groups.items() if o != s]}
            lines["term"] = [(f(share(ts, t), share(everything, t)), t) for t in kept if t in ts and share(ts, t) > share(everything, t)]
            for part, found in lines.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize(("least", "top", "block"), [(3, 200, 1_000_000), (1, 2, 2), (9, 5, 3)])
def test_divergence_is_the_definition(make_docs, least, top, block):
    got = [tuple(r) for r in divergence.source_divergence(make_docs(ODD), least, top, block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == slow_divergence(ODD, least, top)


def test_divergence_spills_and_zero_counts(make_docs, monkeypatch):
    """Small blocks and tables give the same answer as large ones, with many sources of which a term has few."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(chr(97 + x) * 2 for x in rng.integers(0, 26, rng.integers(0, 30))), "en", f"s{rng.integers(0, 9)}") for k in range(60)]
    monkeypatch.setattr(divergence, "CELLS", 20)
    assert {tuple(r) for r in divergence.source_divergence(make_docs(rows), block_entries=40).collect()} == slow_divergence(rows, 3, 200)


def test_fold_spills(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "SPILL_ENTRIES", 3)
    batch = pa.RecordBatch.from_pydict({"text": [b"a b c d", b"a b", b"a"], "lang": ["en"] * 3, "source": ["x", "y", "x"]})
    rows = [r for b in divergence.fold_stripes(iter([batch])) for r in b.to_pylist()]
    assert sum(r["docs"] for r in rows if r["term"] == "a") == 3
    assert len([r for r in rows if r["term"] == "a"]) > 1


def test_shares_stay_exact_beyond_64_bits():
    counts = np.array([10**13, 0], np.int64)
    assert divergence._shares(counts, 10**13 + 5).tolist() == [1 + 10**9 * (10**13 + 1) // (10**13 + 5), 1]


def test_divergence_of_nothing(make_docs):
    assert divergence.source_divergence(make_docs([])).collect() == []


def test_pieces_never_part_words():
    data = b"aa bb" * 50 + b"c" * 90 + b" d"
    for limit in (1, 7, 100, 10_000):
        parts = list(pieces(data, BLANK, limit))
        assert b"".join(parts) == data
        assert [w for p in parts for w in p.split()] == data.split()


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 400_000, 97)), [5] * 1000])
def test_codes_are_directly_addressable(ids):
    reader = token_files.DacReader(token_files.encode_dac(np.array(ids, np.uint32)))
    assert len(reader) == len(ids)
    assert reader.read(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), max(1, len(ids) // 300)):
        assert reader[i] == ids[i]
        assert reader.read(i, min(len(ids), i + 700)).tolist() == ids[i : i + 700]
    with pytest.raises(IndexError):
        reader[len(ids)]


def test_broken_codes_are_refused():
    code = token_files.encode_dac(np.arange(1000, dtype=np.uint32))
    for bad in (b"XXXX" + code[4:], code[:-1], code + b"\0"):
        with pytest.raises(ValueError):
            token_files.DacReader(bad)


def test_checksum_shares_add_up():
    data = bytes(range(256)) * 9
    for cut in (0, 1, 100, len(data)):
        shares = token_files.crc_after(token_files._ONES, len(data)) ^ token_files._ONES
        for piece, after in ((data[:cut], len(data) - cut), (data[cut:], 0)):
            shares ^= token_files.crc_after(zlib.crc32(piece, 0xFFFFFFFF) ^ 0xFFFFFFFF, after)
        assert shares == zlib.crc32(data)


TEXTS = [
    (5, "Hello  world's <|endoftext|>x<|startoftext|> tail"),
    (3, None),
    (3, "é ́a Σίσυφος ΑΣ b c　日本語12 34\x1c\x85"),
    (2, ""),
    (None, "null id"),
    (None, "null id"),
    (9, "long " * 40_000 + "😀" * 30),
    (7, "it's   we'll\t\n don't'd 's"),
    (1, " \n "),
]


def slow_tokens(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    return [(doc_id, [*library.encode(text or "", add_special_tokens=False).ids, 2]) for doc_id, text in rows]


@pytest.mark.parametrize("segment", [64, token_files.SEGMENT])
def test_token_files_hold_the_librarys_ids(spark, make_docs, segment):
    path = shared_dir(spark)
    token_files.write_token_files(make_docs(TEXTS).repartition(3), VOCABULARY, path, segment=segment)
    files = token_files.read_token_files(spark, path)
    want = slow_tokens(TEXTS)
    digest = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    got = token_files.token_digest(files).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), digest(i)) for d, i in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *itertools.accumulate(r.n_tokens for r in ordered)][:-1]
    assert [r.doc_id for r in ordered] == sorted((d for d, _ in want), key=lambda d: (d is not None, d))
    asked = [(d, p) for d, ids in want if d in (5, 9) for p in (0, 3, len(ids) - 1, len(ids))] + [(404, 0), (5, None)]
    picked = token_files.tokens_at(files, spark.createDataFrame(asked, "doc_id long, position long")).collect()
    held = dict(want)
    assert sorted(tuple(r) for r in picked) == sorted((d, p, held[d][p]) for d, p in asked if d in held and p is not None and p < len(held[d]))


def test_token_files_of_the_tables(spark, sf_dir):
    from tracewright.llm.registry import op12_token_files

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want, at = {}, 0
    for doc_id, ids in slow_tokens(rows):
        want[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = op12_token_files(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


@pytest.mark.parametrize("held", [3, 600_000])
def test_encoder_equals_the_library(monkeypatch, held):
    """Word by word and whole agree, whatever the table holds: punctuation, contractions, marks, special strings, odd spaces."""
    monkeypatch.setattr(token_files, "CACHE_WORDS", held)
    monkeypatch.setattr(token_files, "_JOINED", 2)
    words = token_files.WordEncoder(VOCABULARY)
    pieces_ = ["one", "Two,", "three's", "it'd.", "<|endoftext|>", "x<|startoftext|>y!", "e\u0301,", "\u0301", "\u0130,", "\u2014,", "a\u2014,", "5.", "12-3", "don't", "\u00df.", "\u4e2d\u6587,", "...", "'", "x'", "a|", "b>", "c<", "'s", "d's.", "9'll,", "\u01c4."]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(pieces_, 30)) for _ in range(40)] + ["".join(rng.choice(pieces_, 12)) for _ in range(40)] + ["", " ", "\u3000\x1c\x85"]
    for text, got in zip(texts, words.encode_all([t.encode() for t in texts]), strict=True):
        assert got.tolist() == slow_tokens([(0, text)])[0][1][:-1], text


def test_token_files_of_nothing(spark, make_docs):
    path = shared_dir(spark)
    token_files.write_token_files(make_docs([]), VOCABULARY, path)
    assert token_files.token_digest(token_files.read_token_files(spark, path)).collect() == []


def slow_audit(rows, labels):
    texts = [(d, t or "", s or "") for d, t, _, s in rows]
    good, toxic = ({d for d, *flags in labels if flags[k] == 1 and d is not None} for k in (0, 1))
    fails = []
    for d, t, _ in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        said = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), any(u == t and d is not None and e is not None and e < d for e, u, _ in texts)]
        fails.append({f for f, x in zip("ABCDE", said, strict=True) if x})
    out = {}
    for part in {s for *_, s in texts}:
        mine = [(d, f) for (d, _, s), f in zip(texts, fails, strict=True) if s == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone, kept = [x for x in left if name in x[1]], [x for x in left if name not in x[1]]
                failing, alone = sum(name in f for _, f in mine), sum(f == {name} for _, f in mine)
                out[part, order, step] = [len(kept), len(gone), failing - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                totals[name] += len(gone)
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(totals[order[step - 1]])
    return out


def test_audit_is_the_definition(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "en", "a"), (2, long, None, "b"), (2, long, None, "b"), (3, long, None, "a"), (None, long, None, "a"), (0, None, None, None), (4, "", None, None), (5, "", None, ""), (6, "SHOUT #1 " * 40, "x", "a"), (6, "other", "x", "a"), (7, "SHOUT #1 " * 40, "x", "b"), (None, "#", None, "n"), (8, "é é " * 3000, "x", "a")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (6, 0, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "'y' AS mask")
    got = filter_audit.audit_filters(make_docs(rows).repartition(3), said).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == slow_audit(rows, labels)
    assert len(got) == 600 * 4


def test_audit_of_nothing(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(make_docs([]), labels).collect() == []
    assert len(filter_audit.audit_filters(make_docs([(1, None)]), labels).collect()) == 600


def test_packed_sums_do_not_carry():
    many = 10**15
    total = many * filter_audit.packed(31, True, True) + many * filter_audit.packed(0, False, False)
    fields = filter_audit.unpacked(total)
    assert fields.max() <= 120 * many
    assert set(fields[0]) == {many}
    assert sorted(set(fields[1])) == [0, many]


