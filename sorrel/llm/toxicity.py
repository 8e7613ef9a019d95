"""Toxicity by a subsequence string kernel with Nyström landmarks and a support vector machine."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, quoted, slices, text_of

#: Places of a subsequence's later characters after its first: three or four characters, up to two others in between.
PLACES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4), (1, 2, 5), (1, 3, 5), (1, 4, 5), (2, 3, 5), (2, 4, 5), (3, 4, 5))
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
DECAY = 0.6
#: Subsequences are numbered by hash, modulo this.
DIMENSIONS = 1 << 18
#: Longer words are read in windows of this many characters that overlap by half; the largest score counts.
WINDOW = 32
#: Labelled documents that are fitted on, at most: those of the smallest hashes of their ids.
MAX_DOCUMENTS = 20_000
#: Decisions from which on distinct words are counted as evidence.
COUNTED = (0.0, -0.5)
#: Words of decisions that are larger than the bias by this are looked at first; most texts have enough of them.
HIGH = 0.4
#: Subsequences that are hashed at once, so that the arrays of a step stay in a core's cache.
AT_ONCE = 1 << 17

_SINGLE = re.compile(r"\w[^\w\s]?")
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]?\s){2,}\w(?![^\W])")
_INNER = re.compile(r"[\W_]+")
#: The usual characters among those that part a token.
_ENDS = ".,;:!?\"'()[]_-"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str) -> set[str]:
    """The distinct lower-cased words of a text, and letters that stand apart joined."""
    low = text.lower()
    words = low.split()
    out = set(words)
    single = {w for w in out if len(w) < 3 and _SINGLE.fullmatch(w)}
    if single and b"\1\1" in bytes(map(single.__contains__, words)):  # hardly any text has two in a row
        for m in _SPACED.finditer(low):
            out.add(_INNER.sub("", m[0]))
    return out


def forms(token: str) -> list[str]:
    """What a token may spell: itself without punctuation, and its parts between punctuation."""
    if token.isalnum():
        return [token]
    parts = [p for p in _INNER.split(token) if p]
    return parts if len(parts) < 2 else ["".join(parts), *parts]


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [f"^{word}$"]
    padded = f"^{word}$"
    return [padded[i : i + WINDOW] for i in range(0, len(padded) - WINDOW // 2, WINDOW // 2)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the gap-weighted subsequence kernel of orders three and four, as (row, dimension, value)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the word's end
    keys = []
    for places in PLACES:
        at = np.flatnonzero(left > places[-1])
        h = codes[at] * np.uint64(MULTIPLIERS[0])
        for place, m in zip(places, MULTIPLIERS[1:], strict=False):
            h ^= codes[at + place] * np.uint64(m)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # row, dimension and the number of gaps in one key, as sorting keys alone is fast
        keys.append((row[at].astype(np.uint64) << np.uint64(20)) | (h >> np.uint64(46) << np.uint64(2)) | np.uint64(places[-1] - len(places)))
    key = np.sort(np.concatenate(keys))
    value = (DECAY ** np.arange(4))[(key & np.uint64(3)).astype(np.int64)]
    key >>= np.uint64(2)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    value = np.add.reduceat(value, first) if len(first) else value
    key = key[first]
    row, dim = (key >> np.uint64(18)).astype(np.int64), (key & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(words)))
    return row, dim, value / norm[row]


def products(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights times the unit vectors that :func:`features` gives, for words of one length; codes: (character, word).

    Only a vector's length asks which subsequences are equal, so values are sorted within a word and not summed in general.
    """
    size, n = codes.shape
    mixed = [codes * np.uint64(m) for m in MULTIPLIERS]
    used = [p for p in PLACES if p[-1] < size]
    out, square = np.zeros(n), 0.0
    if not used:
        return out
    keys = np.empty((sum(size - p[-1] for p in used), n), np.uint32)
    at = 0
    for places in used:
        rows, gaps = size - places[-1], places[-1] - len(places)
        h = mixed[0][:rows] ^ mixed[1][places[0] : places[0] + rows]
        for place, m in zip(places[1:], mixed[2:], strict=False):
            h ^= m[place : place + rows]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(46)
        out += DECAY**gaps * weights[h.view(np.int64)].sum(axis=0, dtype=float)
        square += rows * DECAY ** (2 * gaps)
        h <<= np.uint64(2)
        h |= np.uint64(gaps)
        keys[at : at + rows] = h
        at += rows
    by_word = np.sort(np.ascontiguousarray(keys.T), axis=1)
    same = np.zeros((n, by_word.shape[1] + 1), bool)  # as the one before it
    np.less(by_word[:, 1:] ^ by_word[:, :-1], 4, out=same[:, 1:-1])
    norm, runs = np.full(n, square), np.flatnonzero(same[:, :-1] | same[:, 1:])
    if len(runs):
        value = (DECAY ** np.arange(4))[by_word.ravel()[runs] & 3]
        first = np.flatnonzero(~same[:, :-1].ravel()[runs])
        more = np.add.reduceat(value, first) ** 2 - np.add.reduceat(value * value, first)
        norm += np.bincount(runs[first] // by_word.shape[1], more, minlength=n)
    return out / np.sqrt(norm)


@dataclass
class Model:
    """decision(word) = weights · features(word) + bias; score(text) = sigmoid(calibration · evidence(text))."""

    weights: np.ndarray
    bias: float
    calibration: np.ndarray | None = None

    def decisions(self, words: list[str]) -> np.ndarray:
        long = [i for i, w in enumerate(words) if len(w) > WINDOW]
        parts = [windows(words[i]) for i in long]
        each = self._products([f"^{w}$" if len(w) <= WINDOW else "" for w in words] + [x for ws in parts for x in ws])
        if long:
            each[long] = np.maximum.reduceat(each[len(words) :], np.cumsum([0, *map(len, parts[:-1])]))
        return each[: len(words)] + self.bias

    def _products(self, spelt: list[str]) -> np.ndarray:
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        order, out = np.argsort(lengths, kind="stable"), np.zeros(len(spelt))
        codes = np.frombuffer("".join([spelt[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32)
        done = read = 0
        for size, n in zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True):
            block = codes[read : read + size * n].reshape(n, size)
            step = max(1, AT_ONCE // (len(PLACES) * max(1, size)))
            for i in range(0, n, step):
                out[order[done + i : done + min(n, i + step)]] = products(block[i : i + step].T.astype(np.uint64, order="C"), self.weights)
            done, read = done + n, read + size * n
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.calibration, -50, 50)))


class Scorer:
    """Evidence of whole texts from the decisions of their distinct words.

    One, the largest decisions, the logarithm of how many words there are (16 at least) and of how many decide for each
    bound in COUNTED. The bias stands for words that a text lacks.
    """

    KEEP, TOP = 300_000, 4

    def __init__(self, model: Model):
        self.model, self.known, self.before, self.high = model, {}, {}, set()
        self.least = min(*COUNTED, model.bias + HIGH)

    @classmethod
    def of(cls, model: Model) -> Scorer:
        """The model's scorer in this process: later tasks go on with the words that are known."""
        if "scorer" not in model.__dict__:
            model.__dict__["scorer"] = cls(model)
        return model.__dict__["scorer"]

    def decide(self, bags: Iterable[set[str]]) -> None:
        """Make all words of the bags known. A spelling is decided once, whatever punctuation it has."""
        words = set().union(*bags)
        if self.known and len(self.known) + len(words.difference(self.known)) > self.KEEP:
            self.before, self.known, self.high = self.known, {}, set()
        parts, spelt = set(), {}
        for w in self._unknown(words):
            if w.isalnum():
                parts.add(w)
            else:
                bare = w.strip(_ENDS)
                spelt[w] = [bare] if bare.isalnum() else forms(w)
        each = list(self._unknown(parts.union(*spelt.values())))
        self._learn(dict(zip(each, self.model.decisions(each).tolist(), strict=True)))
        self._learn({w: max(map(self.known.__getitem__, ws), default=self.model.bias) for w, ws in spelt.items()})

    def _unknown(self, words: set[str]) -> set[str]:
        """Those that are neither known nor were known before; the latter become known again."""
        new = words.difference(self.known)
        old = {w: self.before[w] for w in new if w in self.before}
        self._learn(old)
        return new.difference(old)

    def _learn(self, found: dict[str, float]) -> None:
        self.known.update(found)
        self.high.update([w for w, d in found.items() if d > self.least])

    def __call__(self, texts: list[str]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        self.decide(bags)
        out = np.empty((len(bags), self.TOP + 2 + len(COUNTED)))
        for row, bag in zip(out, bags, strict=True):
            high = bag & self.high
            # all words count where fewer are high, and the bias for words that are lacking
            each = sorted(map(self.known.__getitem__, high if len(high) >= self.TOP else bag), reverse=True)
            if len(each) < self.TOP:
                each = sorted([*each, *[self.model.bias] * (self.TOP - len(each))], reverse=True)
            row[1 : self.TOP + 1] = each[: self.TOP]
            row[self.TOP + 1] = max(len(bag), 16)
            row[self.TOP + 2 :] = [sum(self.known[w] > c for w in high) for c in COUNTED]
        out[:, 0], out[:, self.TOP + 1 :] = 1.0, np.log1p(out[:, self.TOP + 1 :])
        return out

    def witnesses(self, texts: list[str]) -> Iterator[dict[str, float]]:
        """The word of largest decision of each sentence, for each text."""
        bags = [[b for b in map(tokens, _SENTENCE.split(t)) if b] for t in texts]
        self.decide(chain.from_iterable(bags))
        for sentences in bags:
            yield {w: self.known[w] for w in map(self._largest, sentences)}

    def _largest(self, bag: set[str]) -> str:
        bag = bag & self.high or bag
        most = max(map(self.known.__getitem__, bag))
        return max([w for w in bag if self.known[w] == most])


def nystrom_svm(landmarks: list[str], positive: dict[str, float], negative: list[str], penalty: float = 500.0, steps: int = 100) -> Model:
    """A linear machine on Nyström features of the kernel, squared hinge loss, both classes of equal weight.

    positive: words and the margin asked of each; negative words are asked for a margin of one. A word's windows are
    examples of their own.
    """
    spelt = [x for w in landmarks for x in windows(w)]
    asked_of = [(x, m) for w, m in positive.items() for x in windows(w)]
    clean = [x for w in negative for x in windows(w)]

    row, dim, value = features(spelt)
    used, place = np.unique(dim, return_inverse=True)  # only dimensions that a landmark has can count
    dense = np.zeros((len(spelt), len(used)), np.float32)
    dense[row, place] = value
    column = np.full(DIMENSIONS, -1, np.int32)
    column[used] = np.arange(len(used))

    def kernel(words: list[str]) -> np.ndarray:
        r, d, v = features(words)
        at = column[d]
        r, at, v = r[at >= 0], at[at >= 0], v[at >= 0]
        return np.column_stack([np.bincount(r, v * mark[at], minlength=len(words)) for mark in dense])

    low, vectors = np.linalg.eigh((dense @ dense.T).astype(float))
    keep = low > 1e-6
    root = vectors[:, keep] / np.sqrt(low[keep])
    x = np.vstack([kernel([x for x, _ in asked_of]), kernel(clean)]) @ root
    asked = np.r_[np.array([m for _, m in asked_of]), np.ones(len(clean))]
    y = np.r_[np.ones(len(asked_of)), -np.ones(len(clean))]
    each = penalty * np.where(y > 0, 0.5 / len(asked_of), 0.5 / len(clean))
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    ridge = np.eye(len(w)) * 0.02
    for _ in range(steps):  # Newton's method; the loss is piecewise quadratic
        margin = asked - y * (xb @ w)
        on = margin > 0
        grad = ridge @ w - 2 * (xb[on].T @ (each[on] * y[on] * margin[on]))
        if np.linalg.norm(grad) < 1e-9:
            break
        w = w - np.linalg.solve(ridge + 2 * (xb[on].T * each[on]) @ xb[on], grad)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = dense.T @ (root @ w[:-1])
    return Model(weights, float(w[-1]))


def calibrate(evidence: np.ndarray, label: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of a sigmoid over the evidence with smoothed targets (Platt's, for several columns), by Newton's method."""
    n1, n0 = int(label.sum()), int((1 - label).sum())
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, ridge = np.zeros(evidence.shape[1]), np.diag([1e-6, *[0.02] * (evidence.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(evidence @ w, -50, 50)))
        step = np.linalg.solve((evidence.T * (p * (1 - p))) @ evidence + ridge, evidence.T @ (p - target) + ridge @ w)
        w = w - step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out(id_: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _words(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many texts of either label each spelling is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            cols = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (seen[1], seen[0]))]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "toxic", "clean"])

        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[label].update({f for t in tokens(text) for f in forms(t)})
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield flush()
        yield flush()

    return sample.select("_text", "_y").mapInArrow(count, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sample without near copies of its own rows, which would count the same words again and again.

    Each text gets the smallest hash of its three-word shingles under four hash functions; of texts that share one of the
    four, one stays. The sample is bounded, and so is what the driver sees of it.
    """
    masks = (0, 0x5BD1E995, 0x2C1B3C6D, 0x297A2D39)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(0).to_pylist():
                words = text.lower().split()
                hashes = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint64)
                mixed = [(hashes ^ np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) for m in masks]
                rows.append([int((x ^ (x >> np.uint64(32))).min() >> np.uint64(1)) for x in mixed])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.int64()))], ["n", "signs"])

    seen: set[tuple[int, int]] = set()
    copies = []
    for r in sorted(sample.select("_text", "_n").mapInArrow(sign, "n bigint, signs array<bigint>").collect()):
        signs = set(enumerate(r["signs"]))
        if signs & seen:
            copies.append((r["n"],))
        seen |= signs
    if not copies:
        return sample
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(copies, "_n bigint")), "_n", "left_anti")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_DOCUMENTS, max_landmarks: int = 384, max_positive: int = 500, max_negative: int = 12_000, rounds: int = 2) -> Model | None:
    """Fit on the sentences of at most ``max_documents`` labelled documents, those of the smallest hashes; held-out ids are never read.

    A sentence bears its document's label and decides by the largest decision of its words, its witness, as a toxic
    sentence's other words are clean. The machine is first fitted on words whose counts can hardly be chance: positive ones
    are in so many toxic documents and in hardly any clean one, the more the wider their margin; words of clean documents
    are negative. Then, ``rounds`` times, the witnesses of all labelled sentences are found and the machine is fitted anew:
    clean sentences' witnesses of largest decision join the negative words, and toxic sentences' witnesses that are decided
    toxic and are in no clean document the positive ones. Last, a document's largest decisions are calibrated to its label.

    The other parameters bound the landmarks and the words fitted on; only these words, their counts and one row of
    evidence for each labelled document reach the driver. None if either label is missing or no word stands out. Null
    texts count as empty; labels with a null id or value are ignored, and of several for one id the largest counts. Rows
    that repeat an id are examples each, but near copies within the sample count once for the words.
    """
    y = quoted(label_col)
    picked = labels.select(quoted(id_col).alias("_lid"), y.cast("int").alias("_y")).where(F.col("_lid").isNotNull() & y.isin(0, 1) & ~is_held_out(F.col("_lid")))
    picked = picked.groupBy("_lid").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_lid"), "_lid").limit(max_documents)
    sample = docs.select(quoted(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_lid"))
    with Scratch() as keep:
        return _fit(keep(sample.select("_text", "_y", F.xxhash64("_id").alias("_n")), "toxic-sample"), keep, max_landmarks, max_positive, max_negative, rounds)


def _fit(sample: DataFrame, keep: Scratch, max_landmarks: int, max_positive: int, max_negative: int, rounds: int) -> Model | None:
    """:func:`train` on a materialized sample (_text, _y, _n)."""
    n = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    words = keep(_words(_without_copies(sample)), "toxic-words")
    size = max(2, words.where("toxic + clean > 1").count())
    bar = max(3, int(np.ceil((np.log(size) + 2) / -np.log(n[1] / (n[0] + n[1])))))
    pure = words.where("clean <= 0.01 * toxic")
    positive: dict[str, float] = {}
    for least in (bar, 3, 2):
        positive = positive or {r["word"]: 1 + float(np.log(r["toxic"] / least)) for r in pure.where(F.col("toxic") >= least).orderBy(F.desc("toxic"), "word").limit(max_positive).collect()}
    usual = words.where("clean > 0.01 * toxic and word <> ''")
    negative = [r["word"] for r in usual.orderBy(F.xxhash64("word"), "word").limit(max_negative * 5 // 6).collect()]
    if not positive or not negative:
        return None
    ship = sample.sparkSession.sparkContext.broadcast

    def witnesses(model: Model) -> DataFrame:
        """(word, decision) of toxic sentences' witnesses (_y 1) and of clean ones' (_y 0)."""
        shipped = ship(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, found = Scorer.of(shipped.value), ({}, {})
            for b in slices(batches):
                for each, label in zip(scorer.witnesses(b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True):
                    for w, d in each.items():
                        if d > model.bias:
                            found[label].update(dict.fromkeys(forms(w), d))
            rows = [(w, label, d) for label in (0, 1) for w, d in found[label].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["word", "_y", "decision"])

        each = sample.select("_text", "_y").mapInArrow(run, "word string, _y int, decision double")
        return keep(each.groupBy("word", "_y").agg(F.max("decision").alias("decision")), "toxic-witnesses")

    def fit(yes: dict[str, float], hard: list[str]) -> Model:
        marks = [*list(yes)[: max_landmarks // 3], *hard[: max_landmarks // 3], *negative[: max_landmarks // 3]]
        return nystrom_svm(marks, yes, [*negative, *hard])

    model = fit(positive, [])
    for _ in range(rounds):
        seen = witnesses(model)
        hard = [r["word"] for r in seen.where("_y = 0").join(usual.select("word"), "word").orderBy(F.desc("decision"), "word").limit(max_negative // 6).collect()]
        more = seen.where("_y = 1 and decision > 0").join(pure.select("word", "toxic"), "word").where("toxic > 1 or decision > 0.5")
        more = [r["word"] for r in more.orderBy(F.desc("decision"), "word").limit(max_positive).collect()]
        model = fit(positive | {w: 1.0 for w in more if w not in positive}, hard)
    shipped = ship(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shipped.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(scorer(b.column(0).to_pylist())), pa.list_(pa.float64()))], ["y", "x"])

    found = sample.select("_text", "_y").mapInArrow(gather, "y int, x array<double>").collect()
    model.calibration = calibrate(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]))
    return model


def _scored(docs: DataFrame, model: Model | None, base_rate: float, text_col: str, name: str) -> DataFrame:
    """All columns of docs and one more with the score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        scorer = Scorer.of(m) if m else None
        for b in slices(batches):
            found = m.score(scorer([t or "" for t in b.column(at).to_pylist()])) if m else np.full(b.num_rows, base_rate)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], schema.names)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, base_rate: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    A text's score depends on the whole text and nothing else. Null counts as empty; texts without words score as the
    machine scores no evidence. Without a model every score is ``base_rate``. Repeated rows get equal scores; other
    columns are ignored; an empty table gives an empty result.
    """
    out = _scored(docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")), model, base_rate, "_text", "_score")
    return out.select(F.col("_id").alias(id_col), is_held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; no row is shuffled."""
    (name,) = fresh(docs, "_score")
    return _scored(docs, model, 0.0, text_col, name).where(F.col(name) < threshold).drop(name)
