"""Media columns, source mixing, decontamination and the pipeline."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tracewright.llm import decontamination, media, mixing
from tracewright.llm._text import words


def test_media_round_trip(make_docs):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é😀" * 33), (5, "long text " * 40000), (5, "long text " * 40000)]
    got = media.media_digest(media.decode_media(media.encode_media(make_docs(rows)))).collect()
    assert len(got) == 6
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.feature) == 16
    assert media.encode_media(make_docs([])).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_every_row_filter_is_reversed(kind):
    """Rows filtered here by the definition of each filter."""
    image = np.random.default_rng(kind).integers(0, 256, (9, 64), np.uint8)
    lines = []
    for y in range(9):
        for x in range(64):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c
            lines.append((int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    filtered = np.array(lines, np.uint8).reshape(9, 64)
    assert (media.unfilter(np.full(9, kind, np.uint8), filtered) == image).all()


def test_damage_is_noticed():
    good = media.png_encode(media.pad(b"payload" * 50))
    assert media.png_decode(good).tobytes() == media.pad(b"payload" * 50)
    for at in (0, 20, 45, len(good) - 6):
        with pytest.raises((ValueError, struct.error)):
            media.png_decode(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises((ValueError, struct.error)):
        media.png_decode(good[:-12])


def water_fill(sizes, weights, cap=3):
    """Targets by repeated resharing of the excess."""
    total, target = sum(sizes), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        share = left / w
        left = 0.0
        for i in sorted(open_):
            target[i] += share * weights[i]
        for i in sorted(open_):
            if target[i] > cap * sizes[i]:
                left += target[i] - cap * sizes[i]
                target[i] = cap * sizes[i]
                open_.discard(i)
    assert total == 0 or abs(sum(target) - total) < 1e-6 * total
    return target


def test_mix(make_docs):
    r = np.random.default_rng(4)
    rows = [(0, None, None, "a"), (1, "", None, None), (2, " \t\x0b ", None, "b")]
    for k in range(400):
        source = ["a", "b", "c", None, "é", "tiny"][int(min(5, r.integers(0, 6)))]
        n = 2 if source == "tiny" else int(r.integers(1, 90))
        rows.append((k + 10, "w x " * n, None, source))
    rows += rows[-3:]
    docs = make_docs(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    totals, target, taken, largest = defaultdict(int), {}, defaultdict(int), 0
    for x in got:
        assert x.size == len(re.findall(r"[^\x20\x09-\x0D]+", dict((a, b) for a, b, *_ in rows)[x.doc_id] or ""))
        assert 0 <= x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        totals[x.source] += x.size
        target[x.source] = x.target
        taken[x.source] += x.taken
        largest = max(largest, x.size)
    order = sorted((s for s in totals if s is not None), key=lambda s: s) + [None]
    want = water_fill([totals[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 3
    again = sorted((x.doc_id, x.taken) for x in mixing.mix_sources(docs.repartition(3)).collect())
    assert again == sorted((x.doc_id, x.taken) for x in got)
    assert mixing.mix_sources(make_docs([])).count() == 0
    assert [x.taken for x in mixing.mix_sources(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_fit_beyond_the_table():
    lengths, counts = np.arange(1, 3000), np.full(2999, 40)
    total = int((lengths * counts).sum())
    for budget in (0, 1, 12345, total // 3, total - 7, total, total + 5):
        taken = mixing.fit_counts(lengths, counts, budget, cells=1 << 14)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert int((taken * lengths).sum()) == min(budget, total)


def brute_matches(text, items):
    w = words([text or ""])[0]
    found = {}
    for item_id, item in items:
        own = words([item or ""])[0]
        n = len(own)
        if n < 5:
            continue
        grams = [tuple(own[i : i + 5]) for i in range(n - 4)]
        best = 0
        for s in range(len(w) - n + 1):
            there = [tuple(w[s + i : s + i + 5]) for i in range(n - 4)]
            a, b = defaultdict(int), defaultdict(int)
            for g in grams:
                a[g] += 1
            for g in there:
                b[g] += 1
            shared = sum(min(a[g], b[g]) for g in a)
            best = max(best, shared / (2 * (n - 4) - shared))
        if best >= 0.8:
            found[item_id] = round(best, 9)
    return found


def test_decontamination_matches_brute_force(spark, sf_dir, make_docs):
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    r = np.random.default_rng(2)
    filler = lambda n: " ".join(f"f{v}" for v in r.integers(0, 50, n))
    rows = [(0, None), (1, ""), (2, "too short"), (3, filler(300))]
    for k, (_, text) in enumerate(items):
        w = text.split()
        for edits in range(3):
            v = list(w)
            for _ in range(edits):
                v[int(r.integers(0, len(v)))] = "edited"
            rows.append((10 + 3 * k + edits, f"{filler(20)} {' '.join(v).upper()}, {filler(30)}"))
    benchmark = spark.createDataFrame([*items, (900, None), (901, "four words are short"), (902, "a b c d e a b c d e a b c d e")], "item_id long, text string")
    rows += [(5000, "a b c d e a b c d e a b c d e"), (5001, "a b c d e"), (5001, "a b c d e")]
    want = {(d, i): s for d, t in rows for i, s in brute_matches(t, [*items, (902, "a b c d e a b c d e a b c d e")]).items()}
    docs = make_docs(rows)
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.contaminated(docs, benchmark).collect()}
    assert got == want
    chunked = decontamination.contaminated(docs, benchmark, chunk_bytes=2000).collect()
    assert {(x.doc_id, x.item_id): round(x.similarity, 9) for x in chunked} == want
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _ in rows if d not in {k for k, _ in want})
    assert decontamination.contaminated(make_docs([]), benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert not any(re.search(r"AKIA[A-Z0-9]{16}", x.text or "") for x in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.collect()), key=str) == sorted(map(tuple, last.collect()), key=str)


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids, odd columns and an empty table go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, unit string"
    prose = [(k, f"the {k} people of the town went over the river and then back to the old house number {k * k}", "en", "web", 10, "x", "y") for k in range(12)]
    odd = [(100, None, None, None, None, None, None), (101, "", "en", None, 0, None, None), (None, "password=abcdef12 and the people of the town by the river", "en", "web", 5, "x", "y")]
    tables = {"a": [*prose, *odd, prose[3], prose[3]], "b": []}
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for name, rows in tables.items():
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        left = docs.collect()
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        if not rows:
            assert not left and not mixed
            continue
        kept = [r.doc_id for r in left]
        assert len(kept) == len(set(kept)) and 100 not in kept and 101 not in kept and {k for k in range(12)} <= set(kept)
        assert "password" not in next(r.text for r in left if r.doc_id is None)
        assert {r.doc_id for r in mixed} <= set(kept)
