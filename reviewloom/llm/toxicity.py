"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its ends), each hashed to a
row of an embedding table; a segment of a few words is the average of its distinct words'
averages (over as many places as a segment has, so that a word alone weighs no more than
among others); a softmax layer on that average gives the segment's classes. A misspelt word
shares most n-grams with the word it came from, and so its vector.

Labels are of whole documents, but a few words make a document toxic. So training
alternates: segments of clean documents are negative; of a toxic document first all
segments count as positive, later those that score highest by the model so far. In the
later rounds, random misspellings of the positive segments' strongest words are added.
A document's score is a logistic function of its highest segment, fitted on a quarter of
the sample that the segments are not trained on: all segments of the whole text are scored, whatever its length.

Training is on the driver, on a bounded sample of the labelled training rows, drawn by a
hash of doc_id: at most `max_toxic` and `max_clean` documents, none above
`max_train_chars` characters, of which a round takes at most `max_clean_segments` clean segments at random. Scoring is a pass over all documents with the model (one
float a hash bucket) broadcast.

Defined results: null and empty texts have no segment and score as a document without
any toxic word; rows with one doc_id are scored each by its own text; a doc_id with
several labels is toxic if any of them is; null labels and ids are not learned from;
without labels of both classes the score is 0 for every row; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_texts, words
from .encoder import slices

GRAMS = (3, 4, 5)
SEGMENT = 8
_edges = re.compile(r"^[^\w]+|[^\w]+$")


def buckets(word: str, bits: int) -> list[int]:
    """Rows of the word's n-grams in the embedding table."""
    w = f"<{word}>"
    mask = (1 << bits) - 1
    if len(w) <= min(GRAMS):
        return [zlib.crc32(w.encode()) & mask]
    return [zlib.crc32(w[i : i + n].encode()) & mask for n in GRAMS for i in range(len(w) - n + 1)]


def tokens(text: str) -> list[str]:
    """Lower-case words without the marks around them; words of marks alone stay."""
    return [_edges.sub("", w) or w for w in words(text.lower())]


def misspell(word: str, rng: np.random.Generator) -> str:
    """One random edit: a letter doubled, dropped, replaced, or two swapped."""
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    if kind == 0:
        return word[:i] + word[i] + word[i:]
    if kind == 1:
        return word[:i] + word[i + 1 :]
    if kind == 2:
        return word[:i] + "aeiou013*"[int(rng.integers(9))] + word[i + 1 :]
    return word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]


class _Bags:
    """Words by number, with the ragged rows of their n-grams."""

    def __init__(self, bits: int):
        self.bits, self.number, self.rows = bits, {}, []

    def of(self, word: str) -> int:
        n = self.number.setdefault(word, len(self.rows))
        if n == len(self.rows):
            self.rows.append(np.array(buckets(word, self.bits), np.int32))
        return n


def _ragged(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all items, owner of each item, 1 / length by owner)"""
    n = np.array([len(r) for r in rows])
    return np.concatenate([np.asarray(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), n), 1.0 / n


def _sum_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, d], n) for d in range(values.shape[1])], axis=1)


@dataclass
class FastText:
    dim: int = 4
    bits: int = 18
    steps: int = 40
    rounds: int = 6
    rate: float = 0.05
    fade: float = 0.6
    misspelt_weight: float = 0.1
    #: clean segments that a round of training draws (twice the toxic ones in the first, if that is more), besides each document's three highest
    max_clean_segments: int = 20_000
    seed: int = 7
    table: np.ndarray = field(default=None, repr=False)  # embeddings
    layer: np.ndarray = field(default=None, repr=False)  # (dim, 2)
    bias: np.ndarray = field(default=None, repr=False)
    slope: float = 1.0
    shift: float = 0.0

    def _train(self, bags: _Bags, segments: list[list[int]], labels: np.ndarray) -> None:
        """Adam on the whole batch, classes weighted equally; embeddings and layer together."""
        used = sorted({w for s in segments for w in s})
        local = {w: k for k, w in enumerate(used)}
        grams, gram_word, word_share = _ragged([bags.rows[w] for w in used])
        rows, grams = np.unique(grams, return_inverse=True)
        items, item_segment, _ = _ragged([[local[w] for w in s] for s in segments])
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        target = np.stack([1 - labels, labels], axis=1)
        params = [self.table[rows].astype(float), self.layer, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, self.steps + 1):
            e, layer, bias = params
            word = _sum_by(gram_word, e[grams], len(used)) * word_share[:, None]
            h = _sum_by(item_segment, word[items], len(segments)) / SEGMENT
            z = h @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - target) * weight[:, None]
            dh = dz @ layer.T / SEGMENT
            dword = _sum_by(items, dh[item_segment], len(used)) * word_share[:, None]
            grads = [_sum_by(grams, dword[gram_word], len(rows)), h.T @ dz, dz.sum(axis=0)]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                params[k] = params[k] - self.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
        self.table[rows], self.layer, self.bias = params[0].astype(np.float32), params[1], params[2]

    def logits(self) -> tuple[np.ndarray, float]:
        """The whole model as a float a bucket and a constant: a segment's logit is the sum of its words' means over SEGMENT, and that."""
        w = self.layer[:, 1] - self.layer[:, 0]
        return (self.table @ w).astype(np.float32), float(self.bias[1] - self.bias[0])

    def fit(self, texts: list[str], labels: list[int]) -> FastText:
        rng = np.random.default_rng(self.seed)
        self.table = rng.normal(0, 0.001, (1 << self.bits, self.dim)).astype(np.float32)  # n-grams never seen stay near zero
        self.layer, self.bias = rng.normal(0, 1, (self.dim, 2)), np.zeros(2)
        bags, docs = _Bags(self.bits), []
        for t in texts:
            ws = [bags.of(w) for w in tokens(t)]
            docs.append([list(dict.fromkeys(ws[i : i + SEGMENT])) for i in range(0, len(ws), SEGMENT)])
        y = np.array(labels)
        segments = [s for d in docs for s in d]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        # every fourth document is not trained on: it shows how high clean documents reach that the model does not know
        apart = np.arange(len(docs)) % 4 == 3
        toxic, clean = (y[owner] == 1) & ~apart[owner], (y[owner] == 0) & ~apart[owner]
        positive, negative = np.flatnonzero(toxic), rng.permutation(np.flatnonzero(clean))[: max(self.max_clean_segments, 2 * toxic.sum())]
        for round_ in range(self.rounds):
            extra, extra_y = [], []
            if round_ >= 2:
                extra = self._misspelt(bags, [segments[k] for k in positive], rng, 3)
                extra_y = [1] * len(extra)
            # what only the segments of earlier rounds taught fades
            self.table *= self.fade
            self._train(bags, [segments[k] for k in positive] + [segments[k] for k in negative] + extra, np.array([1] * len(positive) + [0] * len(negative) + extra_y))
            score = self._word_scores(bags)
            items, item_segment, _ = _ragged(segments)
            z = np.bincount(item_segment, score[items], len(segments)) / SEGMENT
            order = np.lexsort((-z, owner))
            first = np.r_[True, owner[order][1:] != owner[order][:-1]]
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            best = order[rank < 1]
            positive = np.unique(np.r_[best[toxic[best]], np.flatnonzero(toxic & (z + self.logits()[1] > 3))])
            hard = order[rank < 3]
            negative = np.unique(np.r_[hard[clean[hard]], rng.permutation(np.flatnonzero(clean))[: self.max_clean_segments]])
        top = np.full(len(docs), -20.0)
        np.maximum.at(top, owner, z + self.logits()[1])
        # a document whose one toxic word is misspelt is toxic too, at less weight
        other = self._misspelt(bags, [segments[k] for k in best if y[owner[k]] == 1 and apart[owner[k]]], rng, 1)
        weight = np.ones(len(docs))[apart]
        top, y = top[apart], y[apart]
        if other:
            score = self._word_scores(bags)
            items, item_segment, _ = _ragged(other)
            top = np.r_[top, np.bincount(item_segment, score[items], len(other)) / SEGMENT + self.logits()[1]]
            y, weight = np.r_[y, np.ones(len(other), int)], np.r_[weight, np.full(len(other), self.misspelt_weight)]
        if len(set(y.tolist())) == 2:
            self._calibrate(top, y, weight)
        return self

    def _misspelt(self, bags: _Bags, segments: list[list[int]], rng: np.random.Generator, times: int) -> list[list[int]]:
        """The segments with their strongest word misspelt, `times` each."""
        score, names, out = self._word_scores(bags), list(bags.number), []
        for s in segments:
            at = int(np.argmax(score[s]))
            for _ in range(times):
                out.append([*s[:at], bags.of(misspell(names[s[at]], rng)), *s[at + 1 :]])
        return out

    def _word_scores(self, bags: _Bags) -> np.ndarray:
        g, _ = self.logits()
        grams, gram_word, share = _ragged(bags.rows)
        return np.bincount(gram_word, g[grams], len(bags.rows)) * share

    def _calibrate(self, top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the label on the highest segment's logit, by Newton's method with a small prior."""
        x = np.clip(top, -20, 20)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = weight * np.maximum(p * (1 - p), 1e-6)
            g = np.array([(weight * (p - y) * x).sum() + 0.1 * (a - 1), (weight * (p - y)).sum()])
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.shift = max(a, 1e-3), b


class Scorer:
    """Scores texts with a model's floats; words seen before are remembered, in bounded number."""

    MEMO = 500_000

    def __init__(self, g: np.ndarray, constant: float, slope: float, shift: float, bits: int):
        self.g, self.constant, self.slope, self.shift, self.bits = g.tolist(), constant, slope, shift, bits
        self.memo: dict[str, float] = {}

    def _learn(self, raw: str) -> float:
        w = _edges.sub("", raw) or raw
        own = buckets(w, self.bits)
        g = self.g
        z = sum([g[k] for k in own]) / len(own)
        if len(self.memo) >= self.MEMO:
            self.memo.clear()
        if len(raw) <= 64:
            self.memo[raw] = z
        return z

    def score(self, text: str) -> float:
        ws = words(text.lower())
        top = -20.0
        if ws:
            get, learn = self.memo.get, self._learn
            best = max(sum([v if (v := get(w)) is not None else learn(w) for w in set(ws[i : i + SEGMENT])]) for i in range(0, len(ws), SEGMENT))
            top = min(20.0, max(-20.0, best / SEGMENT + self.constant))
        return 1 / (1 + math.exp(-(self.slope * top + self.shift)))


def crc_mod(doc_id, n: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


@dataclass(frozen=True)
class ToxicityModel:
    max_toxic: int = 1000
    max_clean: int = 2000
    max_train_chars: int = 30_000
    folds: int = 5

    def sample(self, documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
        """Texts and labels of the training sample: rows whose crc32(doc_id) modulo `folds` is not 0."""
        per_doc = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).filter(crc_mod("doc_id", self.folds) != 0)
        per_doc = per_doc.join(documents.filter(F.length("text") <= self.max_train_chars).select("doc_id"), "doc_id", "left_semi")
        draw = [per_doc.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, self.max_toxic), (0, self.max_clean))]
        picked = {r.doc_id: r.y for d in draw for r in d.collect()}
        if len(set(picked.values())) < 2:
            return [], []
        spark = documents.sparkSession
        ids = spark.createDataFrame([(k,) for k in picked], "doc_id long")
        # at most max_toxic + max_clean ids: a bounded broadcast
        rows = documents.filter(F.length("text") <= self.max_train_chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
        rows.sort(key=lambda r: r.doc_id)
        return [r.text for r in rows], [picked[r.doc_id] for r in rows]

    def score(self, documents: DataFrame, labels: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted for every document."""
        texts, y = self.sample(documents, labels)
        held = doc_texts(documents)
        if not texts:
            scored = held.select("doc_id", F.lit(0.0).alias("score"))
        else:
            model = FastText().fit(texts, y)
            g, constant = model.logits()
            shared = documents.sparkSession.sparkContext.broadcast((g, constant, model.slope, model.shift, model.bits))

            def run(batches):
                own = Scorer(*shared.value)
                for batch in batches:
                    keys, texts = column(batch, "doc_id"), column(batch, "text")
                    for i, j in slices(texts):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array([own.score(t) for t in texts[i:j]], pa.float64())], names=["doc_id", "score"])

            scored = held.mapInArrow(run, "doc_id long, score double")
        return scored.select("doc_id", F.coalesce(crc_mod("doc_id", self.folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
