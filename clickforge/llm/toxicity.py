"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine.

Unit: a word with its marks of start and end, after everything that is not a letter is taken out (``id-iot``,
``i.d.i.o.t`` and letters set apart by spaces become one word). The kernel counts common subsequences of three
letters inside a window of ``SPAN`` letters, each gap costing ``DECAY``, so inserted letters only weaken a
match. Its features are few (letter codes ** 3), so each landmark is a vector over them, and the whole trained
machine folds into one vector: scoring a word is a sum of table entries, whatever the number of landmarks.

Training: labels belong to documents, so a sentence or word is not labelled itself. Multiple-instance rounds
take the most toxic word of each toxic document as its positive example, and the words of clean
documents that look most toxic as negative ones (the first round looks for words and word starts that are
far more frequent in toxic documents). A document scores as its most toxic word, through a logistic curve
fitted to the training documents. It is fitted on at most about ``SAMPLE`` labelled documents of each class,
chosen by a hash of their ids.

Scale: one pass over the labelled sample and one over all texts, without a shuffle of texts. The model
(a vector of 64,000 numbers) travels with the tasks. Each worker keeps the scores of known words, up to a
bound that costs time only. Long words are scored in overlapping windows, so nothing is cut off.

Cases: null and blank texts have no word and get the score of a word without toxic parts; documents
without labels are scored all the same; labels without a document, null labels and null ids are left out of
training; without both classes every score is the share of toxic labels (0 without labels); repeated rows are
scored alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickforge.llm.common import free_name, whole

SAMPLE = 2000
LANDMARKS, ROUNDS, HARD, CLEAR = 256, 4, 4000, 8.0
SPAN, DECAY, CODES, WINDOW = 5, 0.6, 40, 24
STARTS = (4, 5, 6, 7)  # letters
RIDGE = 1e-5
CACHE_ENTRIES = 1 << 17
TEXTS = 256  # whose words are held at a time
CHUNK = 1 << 13  # words worked on at a time
BLOCK = 1 << 10  # training rows worked on at a time

_APART = re.compile(r"(?:(?:^|(?<=\s))[^\W\d_][.,\-_*]?(?:\s+|$)){3,}")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_GAPS = [(i, j, DECAY ** (j - 2)) for j in range(2, SPAN + 1) for i in range(1, j)]


def words_in(text: str) -> set[str]:
    """Distinct lower-case words as written, and letters that stand apart joined to words."""
    low = text.lower()
    found = set(low.split())
    for run in _APART.finditer(low):
        found.add(_NO_LETTERS.sub("", run[0]))
    return found


def _code(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 29 + ord(ch) % 11


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of windows (0 after the end) and the word that each window belongs to."""
    rows, owner = [], []
    for k, word in enumerate(words):
        letters = _NO_LETTERS.sub("", word)
        if len(letters) < 2:
            continue
        codes = [27, *map(_code, letters), 28]
        for a in range(0, max(1, len(codes) - WINDOW // 2), WINDOW // 2):
            rows.append(bytes(codes[a : a + WINDOW]).ljust(WINDOW, b"\0"))
            owner.append(k)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(owner, np.int64)


def _parts(table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    table = table.astype(np.int32)
    for i, j, weight in _GAPS:
        last = table[:, j:]
        yield (table[:, : WINDOW - j] * CODES + table[:, i : WINDOW - j + i]) * CODES + last, last > 0, weight


def project(table: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Each window's normalised features times the vector."""
    if len(table) > CHUNK:
        return np.concatenate([project(table[a : a + CHUNK], vector) for a in range(0, len(table), CHUNK)])
    total, norm = np.zeros(len(table)), np.full(len(table), 1e-12)
    for feature, real, weight in _parts(table):
        total += weight * np.where(real, vector[feature], 0.0).sum(axis=1)
        norm += weight * weight * real.sum(axis=1)
    return total / np.sqrt(norm)


def spread(table: np.ndarray) -> np.ndarray:
    """Normalised features of a few windows, as columns of a dense matrix."""
    out, norm = np.zeros((CODES**3, len(table)), np.float32), np.full(len(table), 1e-12)
    row = np.arange(len(table))[:, None]
    for feature, real, weight in _parts(table):
        np.add.at(out, (feature[real], np.broadcast_to(row, feature.shape)[real]), weight)
        norm += weight * weight * real.sum(axis=1)
    out /= np.sqrt(norm).astype(np.float32)
    return out


def _start_ids(names: list[str]) -> tuple[np.ndarray, int]:
    """A number for each word's start of each length in ``STARTS`` (-1 if the word is shorter), and how many there are."""
    out, n = np.full((len(names), len(STARTS)), -1, np.int32), 0
    for c, k in enumerate(STARTS):
        own = np.fromiter((r for r, w in enumerate(names) if len(w) >= k), np.int64)
        found, place = np.unique(np.fromiter((xxhash.xxh64_intdigest(names[r][:k]) for r in own), np.uint64, len(own)), return_inverse=True)
        out[own, c] = place + n
        n += len(found)
    return out, n


@dataclass
class ToxicModel:
    vector: np.ndarray
    bias: float
    slope: float
    middle: float
    constant: float | None = None

    def raw(self, words: list[str]) -> np.ndarray:
        """Margin of each word; one without letters has that of no matching part."""
        out = np.full(len(words), self.bias)
        table, owner = coded(words)
        if len(table):
            best = np.full(len(words), -np.inf)
            np.maximum.at(best, owner, project(table, self.vector) + self.bias)
            out = np.where(np.isfinite(best), best, out)
        return out

    def chance(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(np.clip(-(self.slope * margin + self.middle), -60, 60)))


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) of the squared-hinge machine, classes weighted alike; Newton steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1] + 1)
    ridge = RIDGE * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        square, side = ridge.copy(), np.zeros(len(w))
        for a in range(0, len(x), BLOCK):
            own, sign, share = (v[a : a + BLOCK] for v in (x, y, weight))
            own = np.c_[own, np.ones(len(own))]
            inside = sign * (own @ w) < 1
            own, share = own[inside], share[inside]
            square += own.T @ (own * share[:, None])
            side += own.T @ (share * sign[inside])
        new = np.linalg.solve(square, side)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(-(a * x + b), -60, 60)))
        h, g = p * (1 - p) + 1e-6, p - y
        matrix = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(matrix, np.array([(g * x).sum() + 1e-2 * a, g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def fit(bags: Iterable[tuple[int, Iterable[str]]]) -> ToxicModel:
    """Train on (label, distinct words) of documents; the words are read once and kept as numbers."""
    vocabulary: dict[str, int] = {}
    held, labels = [], []
    for y, words in bags:
        labels.append(y)
        held.append(np.unique(np.fromiter((vocabulary.setdefault(_NO_LETTERS.sub("", w), len(vocabulary)) for w in words), np.int32)))
    labels = np.array(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return ToxicModel(np.zeros(CODES**3), 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.0)
    names = list(vocabulary)
    start_of, n_starts = _start_ids(names)
    counts, start_counts = np.zeros((2, len(names)), np.int32), np.zeros((2, n_starts + 1), np.int32)
    for y, own in zip(labels, held):
        counts[y][own] += 1
        start_counts[y][np.unique(start_of[own])] += 1
    start_counts[:, -1] = 0  # of words too short for a start
    n = np.bincount(labels, minlength=2)

    def excess(toxic, clean):
        expected = (toxic + clean) * n[1] / n.sum()
        return (toxic - expected) / np.sqrt(expected + 1)

    whole_word = excess(counts[1], counts[0])
    score = np.maximum(whole_word, excess(start_counts[1], start_counts[0])[start_of].max(axis=1))
    table, owner = coded(names)
    clean = np.flatnonzero(counts[0] > 0)
    # landmarks: the most suspicious words, and clean words spread over the vocabulary
    top = np.argsort(-score, kind="stable")[: LANDMARKS // 2]
    rest = clean[:: max(1, len(clean) // (LANDMARKS // 2))][: LANDMARKS // 2]
    by_feature = spread(coded([names[k] for k in np.unique(np.r_[top, rest])])[0])
    values, vectors = np.linalg.eigh((by_feature.T @ by_feature).astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # kernel row times this is a word's Nystroem features

    def nystroem(rows: np.ndarray) -> np.ndarray:
        if len(rows) > BLOCK:
            return np.concatenate([nystroem(rows[a : a + BLOCK]) for a in range(0, len(rows), BLOCK)])
        kernel, norm = np.zeros((len(rows), by_feature.shape[1])), np.full(len(rows), 1e-12)
        for feature, real, weight in _parts(rows):
            for c in range(feature.shape[1]):
                own = np.flatnonzero(real[:, c])
                kernel[own] += weight * by_feature[feature[own, c]]
            norm += weight * weight * real.sum(axis=1)
        return (kernel / np.sqrt(norm)[:, None]) @ root

    first = np.full(len(names), -1)
    first[owner[::-1]] = np.arange(len(owner))[::-1]
    usable = first >= 0
    score = np.where(usable, score, -np.inf)
    # words that stand out by far are positive in every round, also with a letter put in or added
    clear = np.flatnonzero(usable & (whole_word > CLEAR) & (counts[1] > counts[0]))
    changed = [w[:i] + ch + w[i:] for w in (names[k] for k in clear) for i in range(1, len(w) + 1) for ch in "xs"]
    changed = coded([w for w in changed if w not in vocabulary])[0]
    for _ in range(ROUNDS):
        best = [own[np.argmax(score[own])] for y, own in zip(labels, held) if y == 1 and len(own) and usable[own].any()]
        hard = clean[np.argsort(-score[clean], kind="stable")[:HARD]]
        plain = clean[:: max(1, len(clean) // HARD)]
        negative = np.unique(np.r_[hard, plain])
        # a word that many clean documents have is no positive example
        positive = np.array([k for k in best if counts[1][k] > counts[0][k]] + clear.tolist(), np.int64)
        negative = np.setdiff1d(negative[usable[negative]], positive)
        if not len(positive) or not len(negative):
            break
        rows = np.concatenate([table[first[np.r_[positive, negative]]], changed])
        signs = np.r_[np.ones(len(positive)), -np.ones(len(negative)), np.ones(len(changed))]
        w = _machine(nystroem(rows), signs)
        folded = root @ w[:-1]
        vector = np.concatenate([by_feature[a : a + BLOCK] @ folded for a in range(0, len(by_feature), BLOCK)])
        model = ToxicModel(vector, float(w[-1]), 1.0, 0.0)
        score = np.full(len(names), -np.inf)
        np.maximum.at(score, owner, project(table, vector) + model.bias)
    else:
        top = np.array([score[own].max(initial=model.bias) if len(own) else model.bias for own in held])
        top = np.maximum(top, model.bias)
        model.slope, model.middle = _logistic(top, labels.astype(float))
        return model
    return ToxicModel(np.zeros(CODES**3), 0.0, 1.0, 0.0, float(labels.mean()))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """Fit on labelled documents whose id is not held out: at most about ``sample`` of each class."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k"))).dropDuplicates(["k"])
    sizes = dict(known.groupBy("y").count().collect())
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    chosen = known.filter(draw < share)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(words_in(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words)], names=["k", "y", "words"])

    # the sample is bounded by 2 * sample rows, so it may be broadcast and its words collected
    texts = docs.select(F.col(key).alias("k"), whole(text).alias("t")).join(F.broadcast(chosen), "k")
    rows = texts.select("k", "y", "t").mapInArrow(bag, "k long, y int, words string").dropDuplicates(["k"]).toArrow()
    order = np.argsort(rows.column("k").to_numpy(), kind="stable")
    y, words = rows.column("y"), rows.column("words")
    return fit((y[i].as_py(), words[i].as_py().split()) for i in order.tolist())


def score_texts(docs: DataFrame, model: ToxicModel, text: str, name: str) -> DataFrame:
    """All columns of ``docs`` and the score of the text; only the text goes to the Python workers, only scores come back."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for texts in batches:
            margins = []
            for at in range(0, len(texts), TEXTS):
                bags = [words_in(t) for t in texts.slice(at, TEXTS).to_pylist()]
                if len(known) > CACHE_ENTRIES:
                    known.clear()
                unknown = list(set().union(*bags).difference(known))
                for a in range(0, len(unknown), CHUNK):
                    part = unknown[a : a + CHUNK]
                    known.update(zip(part, model.raw(part).tolist()))
                margins += [max(map(known.__getitem__, b), default=model.bias) for b in bags]
            yield pa.array(model.chance(np.maximum(np.array(margins), model.bias)), pa.float64())

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], score(whole(text)).alias(name))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every document."""
    model = train(docs, labels, key, text)
    scored = score_texts(docs.select(F.col(key), F.col(text).alias("_text")).select(key, "_text"), model, "_text", "score")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the machine does not call toxic, whole rows."""
    name = free_name(docs, "_toxic")
    scored = score_texts(docs, train(docs, labels, key, text), text, name)
    return scored.filter(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
