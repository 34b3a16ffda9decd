"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Characters are folded (lower case, everything but letters one blank) to 16-bit codes; an n-gram of up to four is one
packed 64-bit key. Counts come from Spark over a bounded sample of labelled documents; the tables of all languages are
merged into one sorted key array per order with a column of log-probabilities per language. A text gets the language of
the lowest cross-entropy per character. On documents left out of the counts a temperature and the rejection are
calibrated: by length class, the highest cross-entropies of texts in learned languages are set against the lowest that
texts have under the models of the other languages, as if their own were not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import slices, strings

ORDER = 4
#: Labels that one model takes; its tables have a column each and are broadcast.
MAX_LANGUAGES = 256
#: Characters of a longer text that are looked at together.
PIECE = 1 << 18
#: Bound of the fit: so many labelled documents of a language are read for counts and calibration (expected number of a
#: seeded hash sample; all of them where there are fewer).
MAX_TRAIN_DOCS = 3000
#: One in so many of these is for calibration.
CALIBRATION_SHARE = 5
#: Length classes of the rejection, by letters.
LENGTHS = (0, 16, 64, 256, 1024)
#: A text is rejected when its cross-entropy exceeds its language's mean by more than the middle between these quantiles of
#: its length class: of texts in their own language, and of texts whose language is left out (of these the lower quantile).
#: The bound is never less than the first plus SLACK nats for texts of up to 16 letters, and less by the root of the length
#: beyond; this alone holds where no other language is known.
REJECT_QUANTILE, OTHER_QUANTILE, SLACK = 0.999, 0.01, 0.75
UNKNOWN = "und"
_BLANK = 32
_UNIFORM = 1.0 / 65536


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    table = np.full(65536, _BLANK, np.uint16)
    for code in range(65536):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 and ord(low) < 65536 else code
    return table


def _fold(codes: np.ndarray) -> np.ndarray:
    """16-bit codes of code points; letters beyond the first plane share a private range."""
    high = codes > 65535
    if not high.any():
        return _fold_table()[codes]
    out = _fold_table()[np.where(high, _BLANK, codes)]
    for code in np.unique(codes[high]).tolist():
        if chr(code).isalpha():
            out[codes == code] = 0xE000 | (code & 0x7FF)
    return out


def packed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the order-4 n-gram that ends at every kept character, text number of each, letters of each text).

    Runs of blanks are one blank; a text is preceded by blanks.
    """
    gap = " " * (ORDER - 1)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer(gap.join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _fold(codes)
    owner = np.repeat(np.arange(len(texts)), lengths + len(gap))
    starts = np.cumsum(lengths + len(gap)) - lengths
    own = np.ones(len(codes), bool)  # not of a gap
    for k in range(1, len(gap) + 1):
        own[starts - k] = False
    blank = folded == _BLANK
    letters = np.bincount(owner[~blank], minlength=len(texts))
    keep = ~(blank & np.r_[False, blank[:-1]]) | ~own
    folded, owner, own = folded[keep].astype(np.uint64), owner[keep], own[keep]
    keys = folded.copy()
    for k in range(1, ORDER):
        keys[k:] |= folded[:-k] << np.uint64(16 * k)
    return keys[own], owner[own], letters


def ngram_pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The keys of `packed_ngrams` for one text, and its letters, piece by piece: what a piece needs of the one before are
    its last kept characters."""
    before = np.full(ORDER - 1, _BLANK, np.uint64)
    for low in range(0, len(text), PIECE):
        folded = _fold(np.frombuffer(text[low : low + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32))
        blank = folded == _BLANK
        keep = ~(blank & np.r_[before[-1] == _BLANK, blank[:-1]])
        chain = np.concatenate([before, folded[keep].astype(np.uint64)])
        keys = chain[ORDER - 1 :].copy()
        for k in range(1, ORDER):
            keys |= chain[ORDER - 1 - k : len(chain) - k] << np.uint64(16 * k)
        before = chain[len(chain) - (ORDER - 1) :]
        yield keys, int((~blank).sum())


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys if order == ORDER else keys & np.uint64((1 << (16 * order)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of keys in a sorted array."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


class _OneLanguage:
    """Kneser-Ney statistics of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = {}
        for order in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones and twos else 0.5
            contexts, first = np.unique(keys >> np.uint64(16), return_index=True)
            totals = np.add.reduceat(counts, first)
            kinds = np.diff(np.r_[first, len(keys)])
            self.levels[order] = (keys, counts, discount, contexts, totals, kinds)
            # lower orders count in how many contexts an n-gram occurs
            keys, counts = np.unique(_low(keys, order - 1), return_counts=True) if order > 1 else (keys, counts)

    def backoff(self, order: int, contexts: np.ndarray) -> np.ndarray:
        _, _, discount, known, totals, kinds = self.levels[order]
        at, found = _find(known, contexts)
        return np.where(found, discount * kinds[at] / totals[at], 1.0)

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), _UNIFORM)
        table, counts, discount, known, totals, _ = self.levels[order]
        lower = self.probability(order - 1, _low(keys, order - 1))
        contexts = keys >> np.uint64(16)
        at, found = _find(table, keys)
        own = np.where(found, counts[at] - discount, 0.0)
        where, there = _find(known, contexts)
        return np.where(there, own / np.where(there, totals[where], 1), 0.0) + self.backoff(order, contexts) * lower


class LanguageModel:
    """Merged tables of all languages: for each order sorted keys, log-probabilities, sorted contexts, log back-offs."""

    def __init__(self, languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        ones = [_OneLanguage(*counts[name]) for name in languages]
        self.orders = {}
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([o.levels[order][0] for o in ones]))
            contexts = np.unique(np.concatenate([o.levels[order][3] for o in ones]))
            logs = np.log(np.stack([o.probability(order, keys) for o in ones], axis=1)).astype(np.float32)
            back = np.log(np.stack([o.backoff(order, contexts) for o in ones], axis=1)).astype(np.float32)
            self.orders[order] = (keys, logs, contexts, back)
        self.means, self.excess = np.zeros(len(languages)), np.full(len(LENGTHS), np.inf)
        self.sharpness = 1.0

    def _logs(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full((len(keys), len(self.languages)), np.log(_UNIFORM), np.float32)
        table, logs, contexts, back = self.orders[order]
        at, found = _find(table, keys)
        out = logs[at]
        missing = np.flatnonzero(~found)
        if len(missing):
            rest = keys[missing]
            where, there = _find(contexts, rest >> np.uint64(16))
            out[missing] = np.where(there[:, None], back[where], 0) + self._logs(order - 1, _low(rest, order - 1))
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character by text and language, letters by text)."""
        if any(len(t) > PIECE for t in texts):
            return self._long_entropies(texts)
        keys, owner, letters = packed_ngrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(keys) and self.languages:
            logs = self._logs(ORDER, keys)
            present, first, sizes = np.unique(owner, return_index=True, return_counts=True)
            out[present] = -np.add.reduceat(logs, first, axis=0, dtype=np.float64) / sizes[:, None]
        return out, letters

    def _long_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            n = 0
            for keys, some in ngram_pieces(text):
                letters[k] += some
                n += len(keys)
                if len(keys) and self.languages:
                    out[k] -= self._logs(ORDER, keys).sum(axis=0, dtype=np.float64)
            out[k] /= max(n, 1)
        return out, letters

    def probabilities(self, entropies: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Calibrated posterior by text and language."""
        logits = -entropies * self.sharpness * np.sqrt(np.maximum(letters, 1))[:, None]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language or `und`, score, cross-entropy, rejected) by text."""
        entropies, letters = self.cross_entropies(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = entropies.argmin(axis=1)
        rows = np.arange(len(texts))
        none = letters == 0
        score = np.where(none, 0.0, self.probabilities(entropies, letters)[rows, best])
        rejected = none | (entropies[rows, best] - self.means[best] > self.excess[self._length_class(letters)])
        return [UNKNOWN if n else self.languages[b] for n, b in zip(none, best, strict=True)], score, entropies[rows, best], rejected

    @staticmethod
    def _length_class(letters: np.ndarray) -> np.ndarray:
        return np.searchsorted(LENGTHS, letters, "right") - 1

    def calibrate(self, entropies: np.ndarray, letters: np.ndarray, truth: np.ndarray) -> None:
        """Rejection bounds from calibration texts of known language (an index each); sharpness by the lowest log-loss on a
        fixed grid. A language without calibration texts has the mean of all; a length class without any is as lenient as
        the next shorter one, and the shortest rejects nothing."""
        rows = np.arange(len(truth))
        own = entropies[rows, truth]
        for k in range(len(self.languages)):
            self.means[k] = own[truth == k].mean() if (truth == k).any() else own.mean()
        others = entropies.copy()
        others[rows, truth] = np.inf
        near = others.argmin(axis=1)
        inside, outside = own - self.means[truth], others[rows, near] - self.means[near]
        kinds = self._length_class(letters)
        for k in range(len(LENGTHS)):
            mine = kinds == k
            if not mine.any():
                self.excess[k] = self.excess[k - 1] if k else np.inf
                continue
            high = float(np.quantile(inside[mine], REJECT_QUANTILE))
            self.excess[k] = high + SLACK * min(1.0, (16 / max(LENGTHS[k], 1)) ** 0.5)
            if len(self.languages) > 1:
                low = float(np.quantile(outside[mine], OTHER_QUANTILE))
                self.excess[k] = max(self.excess[k], (high + low) / 2)
        # a shorter text is never held to less
        self.excess = np.maximum.accumulate(self.excess[::-1])[::-1]
        losses = {}
        for sharpness in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
            self.sharpness = sharpness
            p = self.probabilities(entropies, letters)[np.arange(len(truth)), truth]
            losses[sharpness] = -np.log(np.maximum(p, 1e-12)).mean()
        self.sharpness = min(losses, key=losses.get) if losses else 1.0


def held_out(doc_id: Column) -> Column:
    """Documents that never train: remainder 2 of the CRC of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, seed: int = 23) -> LanguageModel:
    """A model from the labelled documents that are not held out; see MAX_TRAIN_DOCS for the bound.

    The driver receives n-gram counts of the bounded sample (not of the corpus) and the calibration rows. A language whose
    few documents were all drawn for calibration is counted from these, so every labelled language is learned.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in {lang}: the tables of all languages are held together, map the labels to fewer first")
    languages = sorted(sizes)
    if not languages:
        return _nothing()
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(scale, -(-max_docs * scale // sizes[name])))])
    draw = F.xxhash64("doc_id", F.lit(seed))
    sample = rows.where(F.pmod(draw, F.lit(scale)) < share[F.col("lang")]).withColumn("tune", F.pmod(F.shiftright(draw, 24), F.lit(CALIBRATION_SHARE)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                names = np.array(part.column("lang").to_pylist(), object)
                texts = np.array(strings(part, "text"), object)
                for name in sorted(set(names)):
                    mine = texts[names == name].tolist()
                    short = [t for t in mine if len(t) <= PIECE]
                    for found in [packed_ngrams(short)[0]] if short else []:
                        yield counted(name, found)
                    for t in mine:
                        for found, _ in ngram_pieces(t) if len(t) > PIECE else []:
                            yield counted(name, found)

    def counted(name: str, found: np.ndarray) -> pa.RecordBatch:
        keys, n = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    def gathered(fit: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = fit.select("text", "lang").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
        return np.array(table.column("lang").to_pylist(), object), table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()

    names, keys, n = gathered(sample.where(~F.col("tune")))
    missing = sorted(set(languages) - set(names))
    if missing:
        more = gathered(sample.where(F.col("tune") & F.col("lang").isin(missing)))
        names, keys, n = (np.concatenate(x) for x in zip((names, keys, n), more, strict=True))
    counts = {}
    for name in languages:
        own = np.flatnonzero(names == name)
        if len(own):
            order = own[np.argsort(keys[own])]
            counts[name] = (keys[order], n[order])
    if not counts:
        return _nothing()
    model = LanguageModel([x for x in languages if x in counts], counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                entropies, letters = shared.value.cross_entropies(strings(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(list(entropies), pa.list_(pa.float64())), pa.array(letters)], ["lang", "entropies", "letters"])

    tuning = sample.where("tune").select("text", "lang").mapInArrow(score, "lang string, entropies array<double>, letters long").where("letters > 0").toPandas()
    tuning = tuning[tuning["lang"].isin(model.languages)]
    if len(tuning):
        truth = np.array([model.languages.index(x) for x in tuning["lang"]])
        model.calibrate(np.stack(tuning["entropies"].to_list()), tuning["letters"].to_numpy(), truth)
    return model


def _nothing() -> LanguageModel:
    model = LanguageModel.__new__(LanguageModel)
    model.languages, model.orders, model.means, model.excess, model.sharpness = [], {}, np.zeros(0), np.zeros(0), 1.0
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Null text and text without a letter get `und`, score 0, and are rejected. Ties go to the language first in order.
    Repeated rows give repeated rows; other columns are ignored. The whole text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                names, score, entropy, rejected = shared.value.predict(strings(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)],
                    ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs`, all columns, without the documents that the model rejects. A filter: no shuffle, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 19):
                yield part.filter(pa.array(~shared.value.predict(strings(part, text))[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
