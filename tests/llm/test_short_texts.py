"""Decontamination of documents shorter than an item and of items of fewer than five words."""

import tracemalloc

import numpy as np

from tracewright.llm import _text, decontamination


def test_short_documents_and_items(spark, make_docs):
    item = [f"w{k}" for k in range(30)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "What is bread?"), (3, "yes"), (4, "..."), (5, "red blue red blue")], "item_id long, text string")
    rows = [
        (10, " ".join(item[:28])),
        (11, " ".join(item[3:])),
        (12, " ".join(item[:24])),
        (13, " ".join(item[:25])),
        (20, "Tell me: what is bread? what is bread"),
        (21, "what is"),
        (22, "bread what is"),
        (23, "what is"),
        (24, "bread"),
        (30, "no YES no yes"),
        (31, "yesterday"),
        (40, "red blue red blue red blue"),
        (50, ""),
        (51, None),
    ]
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 6)) for r in decontamination.contaminated(make_docs(rows), benchmark).collect()}
    assert got == {
        (10, 1): (0, 28, round(24 / 26, 6)),
        (11, 1): (0, 27, round(23 / 26, 6)),
        (13, 1): (0, 25, round(21 / 26, 6)),
        (20, 2): (2, 3, 1.0),
        (30, 3): (1, 1, 1.0),
        (40, 5): (0, 4, 1.0),
    }
    kept = {r.doc_id for r in decontamination.drop_contaminated(make_docs(rows), benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_a_very_long_text_needs_little_memory():
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20 + k))) for k in range(40)]
    index = decontamination.BenchmarkIndex(items, decontamination.SIMILARITY, decontamination.RADIUS)
    filler = " ".join(f"word{k}" for k in range(200_000))
    text = " ".join([filler, items[3][1], filler, items[3][1], items[39][1]] * 8)
    assert len(text) > 32_000_000
    tracemalloc.start()
    found = next(decontamination._scan(index, [text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, s, n, round(x, 6)) for i, s, n, x, _ in found] == [(3, 200_000, 23, 1.0), (39, 400_046, 59, 1.0)]
    assert peak < 500e6, peak


def test_pieces_of_a_text_lose_no_window(spark, make_docs, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(15 + 7 * k))) for k in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    draw = np.random.default_rng(3)
    rows = [(d, " ".join(" ".join([f"f{x}" for x in draw.integers(0, 50, draw.integers(0, 40))] + [items[int(k)][1]]) for k in draw.integers(0, 6, 5))) for d in range(20)]
    want = {tuple(r) for r in decontamination.contaminated(make_docs(rows), benchmark).collect()}
    index = decontamination.BenchmarkIndex(items, decontamination.SIMILARITY, decontamination.RADIUS)
    monkeypatch.setattr(decontamination, "WINDOWS", 7)
    monkeypatch.setattr(decontamination, "CELLS", 3)
    got = {(d, *m) for d, t in rows for m in next(decontamination._scan(index, [t]))}
    assert got == want and len(got) > 40


def test_words_do_not_depend_on_the_pieces(monkeypatch):
    texts = ["", "One two, THREE", "é" * 500 + " 中文 x", "a" * 9000, "... !!", "tail"]
    want = _text.words(texts)
    for size in (1, 2, 7, 100, 4096):
        monkeypatch.setattr(_text, "SLICE_BYTES", size)
        got = _text.words(texts)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
