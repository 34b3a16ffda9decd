"""Near-duplicate join against brute force over all pairs."""

import re
from collections import Counter

import numpy as np

from tracewright.llm import near_duplicates as nd
from tracewright.llm.components import components


def shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else None


def brute(rows, t=0.8):
    """(doc index -> number of links, group label) with copies of a text always linked."""
    n = len(rows)
    sets = [shingles(x) for _, x, *_ in rows]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return Counter((rows[i][0], min(groups[find(i)]), links[i]) for i in range(n))


def near_rows(seed=1):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    for g in range(25):
        base = list(r.choice(vocabulary, int(r.integers(20, 200))))
        for c in range(int(r.integers(1, 9))):
            w = list(base)
            for _ in range(int(r.integers(0, 5))):
                w[int(r.integers(0, len(w)))] = str(r.choice(vocabulary))
            rows.append((doc, " ".join(w)))
            doc += 1
    rows += [(doc, rows[0][1]), (doc + 1, rows[0][1].upper() + "!"), (doc + 2, ""), (doc + 3, None), (doc + 4, "..."), (doc + 5, "two words"), (doc + 6, "Two  words."), (doc + 7, "two words more"), (doc + 7, "two words more")]
    return rows


def got(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_against_brute_force(make_docs):
    rows = near_rows()
    assert got(nd.join_near_texts(make_docs(rows))) == brute(rows)


def test_blocks_lose_no_link(make_docs, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 3)
    rows = near_rows(2)
    assert got(nd.join_near_texts(make_docs(rows))) == brute(rows)


def test_tables_and_empty(spark, sf_dir, make_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(nd.join_near_texts(docs)) == brute(rows)
    assert nd.join_near_texts(make_docs([])).count() == 0


def test_one_of_each_stays(make_docs):
    rows = near_rows(3)
    docs = make_docs(rows)
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_units_of_long_prefixes_lose_no_link(make_docs, monkeypatch):
    """Large groups are taken apart at full paths; shortened prefixes bring their units together, few or many under a node."""
    rows = near_rows(4)
    for texts, under in ((6, 16), (6, 2)):
        monkeypatch.setattr(nd, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(nd, "NODE_UNITS", under)
        assert got(nd.join_near_texts(make_docs(rows))) == brute(rows)


def chain_rows(n, width=100, step=25):
    """Texts of which each has Jaccard similarity of about 0.6 with the next and less with the others."""
    return [(k, " ".join(f"w{i}" for i in range(k * step, k * step + width))) for k in range(n)]


def test_a_chain_of_loosely_similar_texts_grows_linearly(make_docs, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 10)
    counts = []
    parts = nd._parts

    def counted(texts, pairs):
        found = parts(texts, pairs)
        counts.append(found.count())
        return found

    monkeypatch.setattr(nd, "_parts", counted)
    for n in (60, 120):
        assert got(nd.join_near_texts(make_docs(chain_rows(n)))) == Counter((k, k, 0) for k in range(n))
    assert counts[1] < 2.6 * counts[0] and counts[1] < 120 * 20


def test_a_dense_group_is_compared_in_blocks(make_docs, monkeypatch):
    """Texts that are all loosely similar: their pairs would grow with the square, so they stay one unit."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 10)
    parts, counts = nd._parts, []
    monkeypatch.setattr(nd, "_parts", lambda texts, pairs: counts.append((texts.count(), pairs.count())) or parts(texts, pairs))
    draw = np.random.default_rng(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(w if draw.random() > 0.045 else f"x{draw.integers(0, 10**6)}" for w in base)) for k in range(90)]
    assert got(nd.join_near_texts(make_docs(rows))) == brute(rows)
    texts, pairs = counts[0]
    assert texts > 60 and pairs <= nd.NODE_UNITS * texts


def test_a_large_unit_takes_its_partners(make_docs, monkeypatch):
    """Near copies of one full path and looser ones around them: partners join the group, its texts do not travel for each."""
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 20)
    parts, counts = nd._parts, []

    def counted(texts, pairs):
        found = parts(texts, pairs)
        counts.append((texts.count(), found.count()))
        return found

    monkeypatch.setattr(nd, "_parts", counted)
    draw = np.random.default_rng(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w if draw.random() > rate else f"x{draw.integers(0, 10**6)}" for w in base)) for k, rate in enumerate([0.004] * 60 + [0.03] * 60)]
    assert got(nd.join_near_texts(make_docs(rows))) == brute(rows)
    texts, members = counts[0]
    assert members < texts * 20


def test_prefix_length_and_recall():
    d = nd.prefix_length(0.8, 0.999)
    assert 1 - (1 - 0.8**d) ** nd.TREES >= 0.999 and (d == nd.DEPTH or 1 - (1 - 0.8 ** (d + 1)) ** nd.TREES < 0.999)
    # texts that can only link at a higher similarity need no prefix as short
    assert nd.needed_prefix(1, 0.8, 0.999) == nd.needed_prefix(3, 0.8, 0.999) == nd.DEPTH and nd.needed_prefix(4, 0.8, 0.999) == d
    assert all(d <= nd.needed_prefix(n, 0.8, 0.999) <= nd.DEPTH for n in range(1, 300))
    # measured on random sets at the threshold, by prefix length
    r = np.random.default_rng(0)
    a, b = nd._coefficients(nd.TREES * nd.DEPTH)
    met = np.zeros(nd.DEPTH + 1, int)
    for _ in range(300):
        x = r.integers(0, 1 << 63, 180, np.uint64)
        y = np.concatenate([x[:160], r.integers(0, 1 << 63, 20, np.uint64)])
        p = nd.tree_paths(np.stack([nd.minhash(x, a, b), nd.minhash(y, a, b)]), nd.TREES, nd.DEPTH, d)
        for depth in range(d, nd.DEPTH + 1):
            width = nd.path_bytes(depth, d)
            met[depth] += (p[0, :, :width] == p[1, :, :width]).all(axis=1).any()
    assert met[d] >= 297 and (np.diff(met[d:]) <= 0).all() and met[nd.DEPTH] > 240


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1000), (2001, 2000), (2001, 2002)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {**{k: 0 for k in range(201)}, 1000: 1000, 2000: 2000, 2001: 2000, 2002: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
