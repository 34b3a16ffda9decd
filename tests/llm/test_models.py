"""Language ID, language model and token counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm import language_id, language_model, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def test_language_id_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_language_id_edges(spark, sf_dir, make_docs):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    odd = make_docs([(1, None), (2, ""), (3, "123 --- !"), (4, "the and of that " * 20000), (5, "Ω𝒳𐐷 ЖЖЖЖЖЖ" * 30), (5, "Ω𝒳𐐷 ЖЖЖЖЖЖ" * 30), (None, "a")])
    rows = language_id.identify(odd, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert by[4].lang_pred == "en" and not by[4].rejected and by[5].rejected and by[5].lang_pred != "und"
    assert language_id.keep_identified(odd, model).columns == odd.columns
    nothing = language_id.train(make_docs([(1, "text", None)]))
    assert [r.lang_pred for r in language_id.identify(make_docs([(1, "text")]), nothing).collect()] == ["und"]
    assert language_id.identify(make_docs([]), model).count() == 0


def test_unlearned_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = sorted(r.lang for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect())
    for left_out in langs:
        model = language_id.train(docs.where(f"lang <> '{left_out}'"))
        rows = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
        texts = {r.doc_id: r for r in docs.collect()}
        long = [d for d, r in texts.items() if r.lang == left_out and sum(c.isalpha() for c in r.text or "") > 400]
        assert len(long) > 3 and np.mean([rows[d].rejected for d in long]) > 0.9, left_out
        clean = [d for d, r in texts.items() if r.lang is not None and r.lang != left_out]
        assert np.mean([rows[d].rejected for d in clean]) < 0.02, left_out
    model = language_id.train(docs)
    draw = np.random.default_rng(5)
    junk = ["".join(draw.choice(list("bcdfghjklmnpqrstvwxz "), 600)) for _ in range(50)]
    assert model.predict(junk)[3].all()
    for size in (10, 30, 120):
        short = [r.text[:size] for r in docs.where("lang IS NOT NULL").collect() if r.text and len(r.text) >= size]
        assert np.mean(model.predict(short)[3]) < 0.03, size


@pytest.mark.parametrize("doc_id", range(40))
def test_every_labelled_language_is_learned(doc_id, spark, make_docs):
    if crc(doc_id, 4) == 2 or doc_id > 20 and doc_id % 4:
        pytest.skip("held out, or one of many")
    rows = [(100 + k, f"the cat and the dog number {k} ran home", "en") for k in range(12)] + [(doc_id, "der hund und die katze laufen nach haus", "de")]
    model = language_id.train(make_docs(rows))
    assert model.languages == ["de", "en"] and model.predict(["der hund und die katze"])[0] == ["de"]


def test_cross_entropies_follow_the_definition():
    corpora = {"a": ["the cat sat on the mat. The dog ran!", "a cat and a dog, 7 mats"], "b": ["le chat est sur le tapis", "un chien et un chat"]}

    def folded(text):
        return "   " + re.sub(" +", " ", " " * 3 + "".join(ch.lower() if ch.isalpha() else " " for ch in text)).lstrip(" ") if text.strip() else "   "

    def grams(text, n=4):
        t = folded(text)
        return [t[i - n + 1 : i + 1] for i in range(3, len(t))]

    def slow(texts):
        level = {4: Counter(g for t in texts for g in grams(t))}
        for n in (3, 2, 1):
            level[n] = Counter(g[1:] for g in level[n + 1])

        def p(g):
            n = len(g)
            if n == 0:
                return 1 / 65536
            c = level[n]
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            mates = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
            total = sum(mates.values())
            if not total:
                return p(g[1:])
            return (max(c[g] - discount, 0) if c[g] else 0) / total + discount * len(mates) / total * p(g[1:])

        return p

    counts = {}
    for name, texts in corpora.items():
        keys, n = np.unique(language_id.packed_ngrams(texts)[0], return_counts=True)
        counts[name] = (keys, n)
    model = language_id.LanguageModel(["a", "b"], counts)
    tests = ["the chat ran", "un dog 99 est la", "xyz"]
    entropies, _ = model.cross_entropies(tests)
    for k, text in enumerate(tests):
        for j, name in enumerate("ab"):
            own = grams(text)
            want = -sum(math.log(slow(corpora[name])(g)) for g in own) / len(own)
            assert abs(entropies[k, j] - want) < 1e-4, (text, name)


def test_kneser_ney_sums_to_one():
    texts = ["the cat sat on the mat and the dog ran", "a cat and a dog"]
    keys, n = np.unique(language_id.packed_ngrams(texts)[0], return_counts=True)
    one = language_id._OneLanguage(keys, n)
    for context in (" th", "cat", "xyz"):
        head = np.uint64(sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(context)))
        p = one.probability(4, head | np.arange(65536, dtype=np.uint64))
        assert abs(p.sum() - 1) < 1e-6


def test_language_model_base_is_exact_and_model_wins(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in language_model.score_texts(docs, head_words=500).collect()}
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in docs.collect()}
    c, end = Counter(), 0
    for d, w in words.items():
        if crc(d, 7) != 2:
            c.update(w)
            end += 1
    n, v = sum(c.values()) + end, len(c) + 1
    for d, w in words.items():
        r = rows[d]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((end + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(d, 7) == 2, len(w) + 1, n)
        assert r.n_known == sum(c[x] > 0 for x in w) + 1 and abs(r.base_score - base) < 1e-6 * abs(base)
    # a smaller step than in production, where a task has many more tokens
    again = {r.doc_id: r for r in language_model.score_texts(docs, batch=2048, min_count=5).collect()}
    own = [r for r in again.values() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_language_model_score_against_slow_scoring(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 7 < 4").select("doc_id", "text")
    fit, kept = language_model.fit_log_bilinear, []
    monkeypatch.setattr(language_model, "fit_log_bilinear", lambda *a, **k: kept.append(fit(*a, **k)) or kept[-1])
    rows = {r.doc_id: r for r in language_model.score_texts(docs, head_words=400, min_count=10, batch=512).collect()}
    model = kept[-1]
    texts = {r.doc_id: [w.decode() for w in language_model.tokens((r.text or "").encode())] for r in docs.collect()}
    c, ends = Counter(), 0
    for d, w in texts.items():
        if not rows[d].held_out:
            c.update(w)
            ends += 1
    head = sorted(c, key=lambda w: (-c[w], w.encode()))[:400]
    own = sum(c[w] >= 10 for w in head)
    assert 0 < own == model.words < 400
    items, before, mass = {}, 0, sum(c[w] for w in head[own:])
    for k, w in enumerate(head):
        items[w] = 2 + k if k < own else 2 + own + min(before * language_model.BANDS // mass, language_model.BANDS - 1)
        before += c[w] if k >= own else 0
    shares = Counter()
    for w in c:
        shares[items.get(w, 1)] += c[w] + 1
    shares[1] += 1
    for d in list(texts)[:25]:
        chain, total = [0, 0, 0], 0.0
        for w in [*texts[d], None]:
            item = 0 if w is None else items.get(w, 1)
            total += slow_probability(model, chain, item)
            total += math.log((c[w] + 1) / shares[item]) if item == 1 or item >= 2 + own else 0.0
            chain.append(item)
        assert abs(total / math.log(10) - rows[d].score) < 1e-4 * abs(rows[d].score) + 1e-6, d


def test_language_model_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    few = dict(batch=512, min_count=5, lane_tokens=4000)
    totals = [[r.score for r in language_model.score_texts(docs.repartition(n), **few).orderBy("doc_id").collect()] for n in (1, 5)]
    assert np.allclose(*totals, rtol=1e-4)


def test_language_model_learns_more_from_more(spark, sf_dir):
    """Three times the training texts bring held-out texts further above the counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gains = []
    for part in (docs.where("crc32(CAST(doc_id AS string)) % 7 IN (2, 3, 5)"), docs):
        own = [r for r in language_model.score_texts(part, batch=512, min_count=5, lane_tokens=4000).collect() if r.held_out]
        gains.append(sum(r.score - r.base_score for r in own))
    assert gains[1] > gains[0]


def test_schedule_grows_with_the_corpus():
    assert language_model.schedule(0) == language_model.schedule(language_model.LANE_TOKENS) == (1, 1)
    for n in (10**7, 10**9, 10**12):
        rounds, lanes = language_model.schedule(n)
        assert rounds <= language_model.MAX_ROUNDS and n / (rounds * lanes) <= language_model.LANE_TOKENS < n / (rounds * (lanes - 1) or 1)


def test_language_model_edges(make_docs):
    rows = language_model.score_texts(make_docs([(1, None), (2, ""), (2, ""), (3, "A a\tb " * 3), (None, "x")])).collect()
    assert len(rows) == 5 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert language_model.score_texts(make_docs([])).count() == 0


def slow_probability(model, history, item):
    """Natural log-probability of an item after a history, by the definition."""
    d, n = model.dimensions, len(model.counts)
    h = np.zeros(d)
    for i, c in enumerate(model.context_matrices()):
        h += model.rows[history[-1 - i], :d].astype(float) @ c
    score = lambda row: h @ model.rows[row, :d] + model.rows[row, d]
    kind = int(model.class_of[item])
    classes = np.array([score(model.s + k) for k in range(model.classes)])
    mates = [k for k in range(n) if model.class_of[k] == kind]
    words = np.array([score(model.q + k) for k in mates])
    within = words[mates.index(item)] - np.log(np.exp(words).sum()) if len(mates) > 1 else 0.0
    return classes[kind] - np.log(np.exp(classes).sum()) + within


def test_log_bilinear_probabilities_sum_to_one_and_follow_the_definition():
    draw = np.random.default_rng(1)
    model = language_model.LogBilinear(np.r_[7, 30, np.sort(draw.integers(1, 400, 60))[::-1], 5, 4], 60, 5)
    model.rows[:] = draw.standard_normal(model.rows.shape) * 0.5
    assert model.classes < 20 and (np.diff(model.class_of) >= 0).all()
    chain = draw.integers(0, 64, 300).astype(np.int32)
    at = np.arange(3, 300)
    slow = [slow_probability(model, list(chain[:p]), int(chain[p])) for p in at]
    assert np.allclose(model.log_probabilities(chain, at), slow, atol=1e-4)
    for history in ([0, 0, 0], [5, 61, 2]):
        assert abs(sum(math.exp(slow_probability(model, history, k)) for k in range(64)) - 1) < 1e-6
    # large scores do not overflow
    model.rows *= 40
    assert np.isfinite(model.log_probabilities(chain, at)).all()


def test_noise_contrastive_steps_learn_a_third_order_pattern():
    draw = np.random.default_rng(2)
    text = [2, 3, 4]
    for _ in range(30_000):
        text.append(2 + (text[-3] - 2 + 1) % 40 if draw.random() < 0.8 else int(draw.integers(2, 42)))
    text = np.array(text, np.int32)
    model = language_model.LogBilinear(np.r_[1, 0, np.bincount(text)[2:42]], 40, 12)
    chain, at = language_model.chain_of([text])
    before = model.log_probabilities(chain, at).mean()
    trainer = language_model.Trainer(model)
    for _ in range(10):
        trainer.fit(chain, at, 256)
    model.rows = trainer.rows
    assert model.log_probabilities(chain, at).mean() > before + 0.5


ODD = [None, "", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "don't  stop\n\n\t now  　 é中文 😀😀", "\x1c\x1d\x85 a", "12345 67٣", "'S 's'll", " \n ", "naïve " * 20000]


@pytest.mark.parametrize("where", ["odd", "tables"])
def test_token_counts_match_the_library(make_docs, spark, sf_dir, where):
    docs = make_docs(list(enumerate(ODD))) if where == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    library = Tokenizer.from_file(VOCABULARY)
    for r in token_counts.count_tokens(docs, VOCABULARY).collect():
        want = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len(texts[r.doc_id].encode()), want > 1024), r


def test_token_counts_with_a_small_cache(spark, sf_dir, monkeypatch, make_docs):
    merger = token_counts.RankMerger(VOCABULARY)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).collect()]
    want = merger.text_counts(texts)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 10)
    fresh = token_counts.RankMerger(VOCABULARY)
    assert [fresh.text_counts([t])[0] for t in texts] == want
    assert token_counts.count_tokens(make_docs([]), VOCABULARY).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 7, 100])
def test_long_texts_in_pieces_are_as_whole(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    draw = np.random.Generator(np.random.PCG64(5))
    for text in ["", "   ", "a", "  a  b", "".join(draw.choice(list("ab  \t\u00e9\U0001d400.1"), 60))]:
        keys, _, letters = language_id.packed_ngrams([text])
        found = list(language_id.ngram_pieces(text))
        assert np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)]).tolist() == keys.tolist()
        assert sum(n for _, n in found) == letters[0]


def test_very_long_text_needs_little_memory(spark, sf_dir):
    """A text of 32 MB, alone in a process: below 500 MB over what the process holds before."""
    import resource

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    text = (docs.where("lang = 'en' AND length(text) > 1000").first().text + " ")[:1000] * 32_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    lang, *_ = model.predict([text, "short"])
    assert lang[0] == "en" and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


def test_too_many_labels_are_refused(make_docs, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    rows = [(k, "some words", f"l{k}") for k in range(40)]
    with pytest.raises(ValueError, match="more than 3 labels"):
        language_id.train(make_docs(rows))
    assert language_id.train(make_docs([(k, "some words", f"l{k % 3}") for k in range(40)])).languages == ["l0", "l1", "l2"]
