"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation, over exact counts.

Word counts cover every training document; they and the texts as item numbers are tables that grow with the corpus. The
vocabulary is every word counted at least MIN_COUNT times, of these at most the VOCABULARY most frequent (what a task can
hold and normalise); its output is factored into classes of about equal square-root frequency, whose number grows with
the vocabulary. The next word's vector is predicted from the last three words, q(h) = sum_i r(h_i) C_i, and

    log P(w | h) = log softmax over classes (q . s_c + t_c) + log softmax over the words of the class (q . q_w + b_w).

Training reads all training texts once per epoch, in rounds. A round has lanes side by side, each of about LANE_TOKENS
tokens: a lane starts from the parameters of the round before, runs stochastic gradient steps on the noise-contrastive
objective of both factors, and hands on how far each row moved and how steep it was; Spark averages both by row, weighted
by how often the lane met it, and later rounds step the less the steeper a row has been so far. A larger corpus has more rounds and more lanes. Texts are dealt to rounds and lanes by the hash of their
id and words and are put in order there, so the model does not depend on partitions or machines. Scoring is batched matrix
products. Rarer words are items by frequency band, and words beyond the head are the item OTHER: such an item is
predicted like a word, and its probability is shared by smoothed count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from ._text import slices

#: Words whose counts every task holds; the counts of all others are joined.
HEAD_WORDS = 1 << 17
#: Words with vectors of their own: at most so many, each seen at least so often.
VOCABULARY, MIN_COUNT = 1 << 14, 20
#: Frequency bands of the rest of the head, of equal token mass.
BANDS = 32
#: Distinct words that a task holds before it passes its partial counts on.
FLUSH_WORDS = 150_000
DIMENSIONS, CONTEXT, EPOCHS = 12, 3, 1
#: Training tokens of a lane, about, and the most rounds of an epoch (a corpus with more has wider rounds).
LANE_TOKENS, MAX_ROUNDS = 1 << 21, 12
#: Tokens of a gradient step; noise classes of a step and noise words of a class in a step.
BATCH, NOISE_CLASSES, NOISE_WORDS = 1 << 15, 16, 8
RATE = 0.05
#: Tokens scored together, and cells of a score matrix.
WINDOW, CELLS = 1 << 17, 1 << 18
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END, OTHER = 0, 1
FIRST_WORD = 2


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text: maximal runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or b"").translate(_LOWER).split()


def held_out(doc_id: Column) -> Column:
    """Documents that never train: remainder 2 modulo 7 of the CRC of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _raw(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column("text").cast(pa.binary()).to_pylist()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n long) over all texts; tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                for text in _raw(part):
                    held.update(tokens(text))
                if len(held) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def chain_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(one item chain of all texts, places of the tokens in it): CONTEXT ENDs before every text and one after it."""
    sizes = np.array([len(t) + CONTEXT + 1 for t in texts], np.int64)
    chain = np.full(int(sizes.sum()), END, np.int32)
    target = np.ones(len(chain), bool)
    starts = np.cumsum(sizes) - sizes
    for k, (start, text) in enumerate(zip(starts.tolist(), texts, strict=True)):
        chain[start + CONTEXT : start + sizes[k] - 1] = text
    for k in range(CONTEXT):
        target[starts + k] = False
    return chain, np.flatnonzero(target)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of every run of equal values, the values)."""
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return first, ordered[first]


def _order(numbers: np.ndarray) -> np.ndarray:
    """Stable order; small numbers are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if numbers.max(initial=0) < 1 << 16 else numbers, kind="stable")


def _miss(score: np.ndarray) -> np.ndarray:
    """Chance that the noise-contrastive classifier gives to the wrong side: 1 - sigmoid(score), in place."""
    with np.errstate(over="ignore"):
        np.exp(score, out=score)
    score += 1.0
    return np.reciprocal(score, out=score)


@dataclass
class LogBilinear:
    """Parameters, as rows of one matrix: r and q of every item, s of every class, C_i; the last column is the bias."""

    counts: np.ndarray  # of END, OTHER, the vocabulary (most frequent first) and the bands
    words: int  # of the vocabulary
    dimensions: int = DIMENSIONS
    seed: int = 3

    def __post_init__(self) -> None:
        n, d = len(self.counts), self.dimensions
        weight = np.sqrt(self.counts[FIRST_WORD : FIRST_WORD + self.words] + 0.0)
        wanted = max(1, int(np.ceil(np.sqrt(self.words))))
        place = (np.cumsum(weight) - weight / 2) * (wanted / max(weight.sum(), 1e-9))
        # END, OTHER and the bands are classes of their own; the classes are runs of items
        runs = np.r_[END, OTHER, FIRST_WORD + np.unique(np.floor(place), return_inverse=True)[1]]
        self.class_of = np.r_[runs, runs[-1] + 1 + np.arange(n - FIRST_WORD - self.words)].astype(np.int32)
        self.classes = int(self.class_of[-1]) + 1
        self.lows = np.searchsorted(self.class_of, np.arange(self.classes + 1))
        seen = self.counts + 1.0
        of_class = np.add.reduceat(seen, self.lows[:-1])
        self.class_share = of_class / of_class.sum()
        self.word_share = seen / of_class[self.class_of]
        self.r, self.q, self.s, self.c = 0, n, 2 * n, 2 * n + self.classes  # first rows
        draw = np.random.Generator(np.random.PCG64(self.seed))
        self.rows = np.zeros((self.c + CONTEXT * d, d + 1), np.float32)
        self.slopes = np.ones_like(self.rows)  # running sums of squared gradients
        self.rows[:n, :d] = draw.standard_normal((n, d)) * 0.3
        self.rows[self.q : self.s, d] = np.log(self.word_share)
        self.rows[self.s : self.c, d] = np.log(self.class_share)
        for k in range(CONTEXT):
            self.rows[self.c + k * d : self.c + (k + 1) * d, :d] = np.eye(d) / (k + 1)

    def context_matrices(self) -> np.ndarray:
        return self.rows[self.c :, : self.dimensions].reshape(CONTEXT, self.dimensions, self.dimensions)

    def log_probabilities(self, chain: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the items of `chain` at the places `at`."""
        d, n = self.dimensions, len(self.counts)
        s, t = self.rows[self.s : self.c, :d].T.copy(), self.rows[self.s : self.c, d]
        q, b = self.rows[self.q : self.s, :d], self.rows[self.q : self.s, d]
        before = [self.rows[:n, :d] @ c for c in self.context_matrices()]
        out = np.zeros(len(at))
        for k in range(0, len(at), WINDOW):
            here = at[k : k + WINDOW]
            h = before[0][chain[here - 1]]
            for i in range(1, CONTEXT):
                h += before[i][chain[here - 1 - i]]
            items = chain[here]
            kinds, logs = self.class_of[items], np.zeros(len(here))
            rows = max(1, CELLS // self.classes)
            for j in range(0, len(here), rows):
                logs[j : j + rows] = _log_softmax(h[j : j + rows] @ s + t, kinds[j : j + rows])
            order = _order(items)
            first, found = _groups(kinds[order])
            for start, stop, kind in zip(first, np.r_[first[1:], len(order)], found, strict=True):
                low, high = int(self.lows[kind]), int(self.lows[kind + 1])
                if high - low > 1:
                    rows = max(1, CELLS // (high - low))
                    for j in range(start, stop, rows):
                        own = order[j : min(j + rows, stop)]
                        logs[own] += _log_softmax(h[own] @ q[low:high].T + b[low:high], items[own] - low)
            out[k : k + WINDOW] = logs
        return out


def _log_softmax(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probability of one column of each row; overwrites `scores`."""
    own = scores[np.arange(len(scores)), chosen].astype(np.float64)
    top = float(scores.max())
    if top > 60 or top < -60:
        shift = scores.max(axis=1, keepdims=True)
        scores -= shift
        own -= shift[:, 0]
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


class Trainer:
    """Gradient steps of one task on its own copy of the parameters."""

    def __init__(self, model: LogBilinear, seed: int = 0):
        self.model, self.rows = model, model.rows.copy()
        self.slopes = model.slopes.copy()
        self.met = np.zeros(len(self.rows), np.int64)
        self.draw = np.random.Generator(np.random.PCG64(seed))
        self.cumulative = np.cumsum(model.class_share)
        self.within = np.cumsum(model.counts + 1.0)
        self.log_class = np.log(NOISE_CLASSES * model.class_share).astype(np.float32)
        self.log_word = np.log(NOISE_WORDS * model.word_share).astype(np.float32)

    def _move(self, rows: np.ndarray, gradients: np.ndarray) -> None:
        self.slopes[rows] += gradients * gradients
        self.rows[rows] += RATE * gradients / np.sqrt(self.slopes[rows])

    def fit(self, chain: np.ndarray, at: np.ndarray, batch: int = BATCH) -> None:
        for k in range(0, len(at), batch):
            self._step(chain, at[k : k + batch])

    def _step(self, chain: np.ndarray, at: np.ndarray) -> None:
        m, d = self.model, self.model.dimensions
        at = at[_order(chain[at])]
        items = chain[at]
        c = self.rows[m.c :].reshape(CONTEXT, d, d + 1)  # their last column is 0
        before = [self.rows.take(chain[at - 1 - i], axis=0)[:, :d] for i in range(CONTEXT)]
        with_bias = sum(before[i] @ c[i] for i in range(CONTEXT))
        with_bias[:, d] = 1
        # classes: every token's own against the same noise classes
        kinds = m.class_of[items]
        own = self.rows.take(m.s + kinds, axis=0)
        pull = _miss(np.einsum("nd,nd->n", with_bias, own) - self.log_class[kinds])
        noise = np.minimum(np.searchsorted(self.cumulative, self.draw.random(NOISE_CLASSES)), m.classes - 1)
        against = self.rows[m.s + noise]
        push = _miss(self.log_class[noise] - with_bias @ against.T)
        dh = pull[:, None] * own - push @ against
        first, found = _groups(kinds)
        ds = np.zeros((m.classes, d + 1), np.float32)
        ds[found] = np.add.reduceat(pull[:, None] * with_bias, first)
        np.subtract.at(ds, noise, push.T @ with_bias)
        # words: a token's own against noise words of its class
        own = self.rows.take(m.q + items, axis=0)
        pull = _miss(np.einsum("nd,nd->n", with_bias, own) - self.log_word[items])
        pull[(m.lows[kinds + 1] - m.lows[kinds]) == 1] = 0
        dh += pull[:, None] * own
        word_first, words = _groups(items)
        moved, gradients = [words], [np.add.reduceat(pull[:, None] * with_bias, word_first)]
        for start, stop, kind in zip(first, np.r_[first[1:], len(items)], found, strict=True):
            low, high = int(m.lows[kind]), int(m.lows[kind + 1])
            if high - low > 1:
                base = self.within[low - 1] if low else 0.0
                noise = np.searchsorted(self.within[low:high], base + self.draw.random(NOISE_WORDS) * (self.within[high - 1] - base))
                noise = np.minimum(noise, high - low - 1) + low
                against, seen = self.rows[m.q + noise], with_bias[start:stop]
                push = _miss(self.log_word[noise] - seen @ against.T)
                dh[start:stop] -= push @ against
                moved.append(noise)
                gradients.append(-(push.T @ seen))
        moved, gradients = np.concatenate(moved), np.concatenate(gradients)
        order = _order(moved)
        first, rows = _groups(moved[order])
        self._move(m.q + rows, np.add.reduceat(gradients[order], first))
        self.met[m.q + words] += np.diff(np.r_[word_first, len(items)])
        self._move(slice(m.s, m.c), ds)
        self.met[m.s + found] += 1
        # contexts
        low, high = int(at.min()) - CONTEXT, int(at.max()) + 1
        there = np.zeros((high - low + CONTEXT, d + 1), np.float32)  # in the order of the chain
        there[at - low] = dh
        there[:, d] = 0
        back = np.zeros((high - low, d + 1), np.float32)
        moves = np.zeros((CONTEXT * d, d + 1), np.float32)
        for i in range(CONTEXT):
            back[:, :d] += there[i + 1 : i + 1 + high - low] @ c[i].T
            moves[i * d : (i + 1) * d, :d] = before[i].T @ dh[:, :d]
        order = _order(chain[low:high])
        first, rows = _groups(chain[low:high][order])
        self._move(m.r + rows, np.add.reduceat(back[order], first))
        self.met[m.r + rows] += np.diff(np.r_[first, high - low])
        self._move(slice(m.c, None), moves)
        self.met[m.c :] += len(at)


def schedule(n_tokens: int, lane_tokens: int = LANE_TOKENS) -> tuple[int, int]:
    """(rounds, lanes of a round) for so many training tokens."""
    shards = max(1, -(-n_tokens // lane_tokens))
    rounds = min(MAX_ROUNDS, shards)  # lanes only where rounds do not suffice: a round learns more than a lane
    return rounds, -(-shards // rounds)


def _lane(shared, turn: int, batch: int):
    def run(lane: pa.Table) -> pa.Table:
        """How far every row moved and how much steeper it is, times how often it was met."""
        model = shared.value
        trainer = Trainer(model, turn << 32 | lane.column("lane")[0].as_py())
        for found in lane.sort_by("place").select(["items"]).to_batches():
            for part in slices(found, "items"):
                trainer.fit(*chain_of(_items(part)), batch)
        at = np.flatnonzero(trainer.met)
        weight = trainer.met[at]
        moved = np.hstack([trainer.rows[at] - model.rows[at], trainer.slopes[at] - model.slopes[at]]) * weight[:, None].astype(np.float32)
        return pa.Table.from_arrays([pa.array(at), pa.array(weight), *[pa.array(moved[:, k]) for k in range(moved.shape[1])]], ["row", "n", *(f"v{k}" for k in range(moved.shape[1]))])

    return run


def fit_log_bilinear(dealt: DataFrame, counts: np.ndarray, words: int, rounds: int, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, batch: int = BATCH) -> LogBilinear:
    """A model of the texts in `dealt` (items: binary, 4 bytes each; round, lane, place), whose items are counted in `counts`."""
    model = LogBilinear(counts, words, dimensions)
    wide = dimensions + 1
    columns = [f"v{k}" for k in range(2 * wide)]
    spark = dealt.sparkSession
    for turn in range(epochs * rounds):
        shared = spark.sparkContext.broadcast(model)

        of_round = dealt.where(F.col("round") == turn % rounds).select("lane", "place", "items")
        moves = of_round.groupBy("lane").applyInArrow(_lane(shared, turn, batch), "row long, n long, " + ", ".join(f"{c} float" for c in columns))
        table = moves.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
        if table.num_rows:
            weight = table.column("n").to_numpy().astype(np.float64)
            mean = np.stack([table.column(c).to_numpy() for c in columns], axis=1) / weight[:, None]
            at = table.column("row").to_numpy()
            model.rows[at] += mean[:, :wide].astype(np.float32)
            model.slopes[at] += mean[:, wide:].astype(np.float32)
        shared.unpersist()
    return model


def _items(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in part.column("items").to_pylist()]


def number_texts(rows: DataFrame, head: list[bytes], head_counts: np.ndarray, item_of: np.ndarray, log_share: np.ndarray) -> DataFrame:
    """doc_id, held_out, items (binary, 4 bytes a word), known, base (log10 of count + 1 over the head words), shared (log10
    of the words' shares of their items, counts beyond the head left out), tail (word, n).

    `item_of` tells the items of the head words and, last, of all others; `log_share` is the log10 of the smoothed count
    that an item's words share, of every item beyond the vocabulary, and 0 for the others.
    """
    logs = np.r_[np.log10(head_counts + 1.0), 0.0]  # the last stands for words outside the head
    parts = np.where(log_share[item_of] > 0, logs - log_share[item_of], 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(({w: k for k, w in enumerate(head)}, logs, parts, item_of.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, logs, parts, item_of = shared.value
        lookup = number.get
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes, tails = [], [], []
                for raw in _raw(part):
                    words = tokens(raw)
                    own = [lookup(w, -1) for w in words]
                    ids.extend(own)
                    sizes.append(len(own))
                    tails.append(Counter([w for w, k in zip(words, own, strict=True) if k < 0]))
                x, sizes = np.array(ids, np.int64), np.array(sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                items = item_of[x]
                ends = np.cumsum(sizes)
                flat = pa.StructArray.from_arrays(
                    [pa.array([w for t in tails for w in t], pa.binary()), pa.array([n for t in tails for n in t.values()], pa.int64())], ["word", "n"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array([items[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                        pa.array(np.bincount(owner, x >= 0, minlength=len(sizes)).astype(np.int64)),
                        pa.array(np.bincount(owner, logs[x], minlength=len(sizes)), pa.float64()),
                        pa.array(np.bincount(owner, parts[x], minlength=len(sizes)), pa.float64()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(t) for t in tails])], pa.int32()), flat),
                    ],
                    ["doc_id", "held_out", "items", "known", "base", "shared", "tail"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, items binary, known long, base double, shared double, tail array<struct<word:binary,n:long>>")


def score_texts(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    head_words: int = HEAD_WORDS,
    vocabulary: int = VOCABULARY,
    min_count: int = MIN_COUNT,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    lane_tokens: int = LANE_TOKENS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the smoothed unigram log10 probability from the exact counts of the training documents, score the
    neural model's; the end of the text is a token of both. Words of equal count enter the head in byte order. Null text
    is empty: one token. Repeated rows give repeated rows and train as often; other columns are ignored; an empty table
    gives no rows. Without training documents every word is unknown.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = materialize(word_counts(training))
    ends = training.count()
    summed, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    n_train, n_kinds = int(summed or 0) + ends, kinds + (ends > 0)
    head = counts.orderBy(F.desc("n"), "word").limit(head_words).toArrow()
    head_list, head_counts = head.column("word").to_pylist(), head.column("n").to_numpy()
    own = min(vocabulary, int((head_counts >= min_count).sum()))
    # the rest of the head in bands of equal mass
    rest = head_counts[own:]
    band = np.minimum((np.cumsum(rest) - rest) * BANDS // max(int(rest.sum()), 1), BANDS - 1)
    item_of = np.r_[FIRST_WORD + np.arange(own), FIRST_WORD + own + band, OTHER].astype(np.int64)
    of_bands = np.bincount(band, rest, minlength=BANDS).astype(np.int64), np.bincount(band, rest + 1.0, minlength=BANDS)
    others = n_train - ends - int(head_counts.sum())
    # words beyond the head, unseen ones included
    unseen = others + (n_kinds - (ends > 0) - len(head_list)) + 1.0
    log_share = np.zeros(FIRST_WORD + own + BANDS)
    log_share[OTHER], log_share[FIRST_WORD + own :] = np.log10(unseen + 1e-9), np.log10(np.maximum(of_bands[1], 1.0))
    rounds, lanes = schedule(n_train, lane_tokens)
    key = F.xxhash64(F.col("doc_id").cast("string"), "items")
    numbered = number_texts(rows, head_list, head_counts, item_of, log_share).withColumns({"row": F.monotonically_increasing_id(), "place": key})
    numbered = numbered.withColumns({"lane": F.pmod(F.shiftright("place", 20), F.lit(lanes)).cast("int"), "round": F.pmod("place", F.lit(rounds)).cast("int")})
    path = shared_dir(spark)
    numbered.write.partitionBy("round").parquet(path)  # a round reads its own files
    numbered = spark.read.schema(numbered.schema).parquet(path)
    model = fit_log_bilinear(numbered.where(~F.col("held_out")), np.r_[ends, others, head_counts[:own], of_bands[0]], own, rounds, epochs=epochs, batch=batch)
    shared = spark.sparkContext.broadcast(model)
    log_total, log_end = float(np.log10(n_train + n_kinds + 1)), float(np.log10(ends + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for part in slices(found, "items"):
                texts = _items(part)
                chain, at = chain_of(texts)
                sizes = np.array([len(t) + 1 for t in texts])
                logs = np.add.reduceat(shared.value.log_probabilities(chain, at), np.cumsum(sizes) - sizes) / np.log(10)
                base = part.column("base").to_numpy() + log_end - sizes * log_total
                scored = logs + part.column("shared").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(sizes, pa.int64()), part.column("known"), pa.array(base), pa.array(scored)],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = numbered.select("row", "doc_id", "held_out", "items", "known", "base", "shared").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double"
    )
    rare = numbered.select("row", F.inline("tail")).join(counts.withColumnRenamed("n", "c"), "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_log", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("tail_log", F.lit(0.0))).alias("score"),
    )
