"""Toxicity by votes of the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features are the letter words of a text (A-Z lower-cased) and the prefixes of PREFIX bytes of longer ones. All features of the
examples span the TF-IDF space, the rarest too; an IDF is multiplied by 1 + the likelihood-ratio statistic of the feature's
document counts in the two labels, so that those which tell the labels apart lead. The index holds, for each feature,
the examples that have it with their unit-length weights, in blocks of BLOCK examples, and for each block the largest
weight. The DENSE longest lists are kept as a matrix, so that their part of a cosine is one product for a batch of queries. A query's
upper bound for a block is the best of these parts in it plus the sum of its other weights times the block's largest
weights; blocks are opened from the highest bound down, until the bound is below the k-th best cosine found. Weights are multiples of 2^-20, so that sums of their
products are exact in double precision, in any order. So the NEAREST neighbours are exact; ties go to the first example by label and identifier. They vote with
weight cosine^2, each label scaled to its share of all training rows; a monotone step
function fitted on the examples' own leave-one-out votes turns the vote into a probability.

The index is fitted in one executor task on a bounded sample: EXAMPLES rows of each label at most, by hash, near copies once; an identifier with both labels is an example of
both. Whole texts are scored. Null counts as
empty; a text without a feature of any example, like the examples without any, scores their share of label 1. If only one label or none was
learnt, every text scores the share of label 1 (0 without training rows). `evidence` holds the identifiers of up to
three nearest examples. Repeated rows score alike. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Copies, Lookup, Spans, as_bytes, fold, in_arrow, labelled_sample, model_of, monotone, slices, table

EXAMPLES = 2048
PREFIX = 5
BLOCK, NEAREST, DENSE = 128, 15, 1024
THRESHOLD = 0.3
PARTS, HELD_OUT = 4, 2
_BORDER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_BATCH = 256
_U = np.uint64


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every feature that occurs."""
    spans = Spans(texts, _BORDER)
    owner = np.repeat(np.arange(len(texts)), np.diff(spans.at))
    long = spans.ends - spans.starts > PREFIX
    words = spans.hashes(spans.starts, spans.ends)
    prefixes = spans.hashes(spans.starts[long], spans.starts[long] + PREFIX) ^ _U(PREFIX)  # differs from the word of the same letters
    return np.concatenate((owner, owner[long])), np.concatenate((words, prefixes))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all ranges in turn, the range that each is of)"""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (starts - np.cumsum(sizes) + sizes)[owner], owner


class BlockMaxIndex:
    """Examples with unit sparse vectors (weights are multiples of 2^-20); exact best cosines of queries.

    Postings are sorted by feature and example; a run of one feature and block is a cell, which has the largest weight of it."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        order = sorted(range(len(rows)), key=lambda i: (int(rows[i][0][rows[i][1].argmax()]) if len(rows[i][0]) else -1, i))  # examples of one leading feature share a block
        feature = np.concatenate([rows[i][0] for i in order] or [np.empty(0)]).astype(np.int64)
        owner = np.repeat(np.arange(len(order)), [len(rows[i][0]) for i in order])
        place = np.argsort(feature, kind="stable")
        weight = np.concatenate([rows[i][1] for i in order] or [np.empty(0)])[place].astype(np.float32)
        self.__setstate__((np.array(order, np.int32), np.bincount(feature, minlength=width).astype(np.int32), owner[place].astype(np.int32), weight))

    def __getstate__(self):
        return self.example, self.sizes, self.owner, self.weight

    def __setstate__(self, state):
        self.example, self.sizes, self.owner, self.weight = state
        n = len(self.example)
        self.blocks = max(1, -(-n // BLOCK))
        ends = np.cumsum(self.sizes, dtype=np.int64)
        starts = ends - self.sizes
        longest = np.sort(np.argsort(-self.sizes, kind="stable")[:DENSE])
        self.row = np.full(len(self.sizes), -1, np.int32)
        self.row[longest] = np.arange(len(longest))
        self.matrix = np.zeros((len(longest), n))
        postings, at = _ranges(starts[longest], ends[longest])
        self.matrix[at, self.owner[postings]] = self.weight[postings]
        feature = np.repeat(np.arange(len(self.sizes)), self.sizes)
        rest = np.flatnonzero(self.row[feature] < 0)
        feature, self.rest_owner, self.rest_weight = feature[rest], self.owner[rest].astype(np.int64), self.weight[rest].astype(np.float64)
        block = self.rest_owner // BLOCK
        self.cell_at = np.flatnonzero(np.concatenate((np.ones(min(1, len(feature)), np.bool_), (feature[1:] != feature[:-1]) | (block[1:] != block[:-1]))))
        self.cell_block = block[self.cell_at]
        self.cell_most = np.maximum.reduceat(self.rest_weight, self.cell_at) if len(feature) else self.rest_weight
        self.feature_at = np.searchsorted(feature[self.cell_at], np.arange(len(self.sizes) + 1)).astype(np.int64)
        self.cell_at = np.append(self.cell_at, len(feature))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (examples, cosines) of the k best by cosine, then by example; only those above 0. without: an example for each query that doesn't count."""
        if not len(self.example):
            return [(np.empty(0, np.int64), np.empty(0)) for _ in queries]
        dense = np.zeros((len(queries), len(self.matrix)))
        for i, (at, weight) in enumerate(queries):
            row = self.row[at]
            dense[i, row[row >= 0]] = weight[row >= 0]
        parts = dense @ self.matrix
        if without is not None:
            place = np.empty(len(self.example), np.int64)
            place[self.example] = np.arange(len(place))
            parts[np.arange(len(queries)), place[without]] = -np.inf
        return [self._finished(parts[i], at[few], weight[few], k) for i, (at, weight) in enumerate(queries) for few in [self.row[at] < 0]]

    def _finished(self, score: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(score)
        k = min(k, n)
        cells, asked = _ranges(self.feature_at[at], self.feature_at[at + 1])
        if len(cells):
            cell_block = self.cell_block[cells]
            bounds = np.bincount(cell_block, weight[asked] * self.cell_most[cells], self.blocks)
            closed = bounds > 0  # what isn't in a list of the query is known already
            bounds += np.maximum.reduceat(score, np.arange(0, n, BLOCK))
            first = np.sort(bounds)[-max(1, self.blocks // 4)]
            while closed.any():
                opened = closed & (bounds >= max(first, np.partition(score, n - k)[n - k], 2.0**-40))
                if not opened.any():
                    if first <= 0:
                        break
                    first = 0.0
                    continue
                closed &= ~opened
                mine = np.flatnonzero(opened[cell_block])
                postings, cell = _ranges(self.cell_at[cells[mine]], self.cell_at[cells[mine] + 1])
                score += np.bincount(self.rest_owner[postings], weight[asked[mine]][cell] * self.rest_weight[postings], n)
                first = 0.0
        rows = np.flatnonzero(score >= max(np.partition(score, n - k)[n - k], 2.0**-40))
        example = self.example[rows]
        best = np.lexsort((example, -score[rows]))[:k]
        return example[best], score[rows[best]]


class NearestExamples:
    """The fitted model; its size is bounded by the parameters."""

    def __init__(self, rows: Iterator[tuple[int, int, bytes, int]]):
        """rows: (id, label, text, training rows of the label)"""
        totals: dict[int, int] = {}
        ids, labels, counted, copies = [], [], [], (Copies(), Copies())
        for i, label, text, total in rows:
            totals[label] = total
            # near copies in the sample would raise the statistic of whatever words they share, and vouch for each other
            if copies[label].new(text):
                ids.append(i)
                labels.append(label)
                counted.append(np.unique(features([text])[1], return_counts=True))
        self.share = totals.get(1, 0) / sum(totals.values()) if totals else 0.0
        self.ready = len(totals) == 2
        if not self.ready:
            return
        self.labels, self.ids = np.array(labels), np.array(ids, np.int64)
        held = [int((self.labels == y).sum()) for y in (0, 1)]
        self.scale = np.array([totals[y] / held[y] for y in (0, 1)])[self.labels]
        text = np.repeat(np.arange(len(ids)), [len(h) for h, _ in counted])
        self.known, feature = np.unique(np.concatenate([h for h, _ in counted]), return_inverse=True)
        positive = np.bincount(feature, weights=self.labels[text], minlength=len(self.known))
        every = np.bincount(feature, minlength=len(self.known))
        have = (positive / held[1] + (every - positive) / held[0]) / 2
        self.idf = ((1 + np.log(1 / np.maximum(have, 1e-4))) * (1 + self._statistic(positive, every - positive, *held[::-1]))).astype(np.float32)
        vectors = self._weighted(text, feature, np.concatenate([n for _, n in counted]), len(ids))
        self.index = BlockMaxIndex(vectors, max(1, len(self.known)))
        self.lookup = Lookup(self.known)
        none = np.array([not len(v[0]) for v in vectors])
        self.nothing = float((self.labels * self.scale)[none].sum() / self.scale[none].sum()) if none.any() else self.share
        raw = np.full(len(vectors), -1.0)
        for at in range(0, len(vectors), _BATCH):
            part = range(at, min(len(vectors), at + _BATCH))
            raw[part] = [self._vote(*near) for near in self.index.nearest(vectors[at : at + _BATCH], NEAREST, list(part))]
        raw[none] = -1
        ok = raw >= 0
        self.steps = monotone(raw[ok], self.labels[ok].astype(float), self.scale[ok]) if ok.any() else (np.array([0.0]), np.array([self.share]))
        left, value = self.steps  # a step lies halfway between the votes beside it, not at the higher one
        below = np.sort(raw[ok])[np.searchsorted(np.sort(raw[ok]), left[1:]) - 1]
        self.steps = np.concatenate((left[:1], (left[1:] + below) / 2)), value

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.ready:
            self.lookup = Lookup(self.known)

    @staticmethod
    def _statistic(a: np.ndarray, b: np.ndarray, positives: int, negatives: int) -> np.ndarray:
        """Twice the log likelihood ratio of a feature's document counts in the two labels."""
        total = positives + negatives

        def part(seen, expected):
            return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

        n = a + b
        return 2 * (part(a, n * positives / total) + part(b, n * negatives / total) + part(positives - a, (total - n) * positives / total) + part(negatives - b, (total - n) * negatives / total))

    def _weighted(self, text: np.ndarray, feature: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, unit weights in multiples of 2^-20) of each text: (1 + log count) * idf."""
        weight = (1 + np.log(counts)) * self.idf[feature] if len(counts) else np.empty(0)
        norm = np.sqrt(np.bincount(text, weights=weight * weight, minlength=size))
        weight = np.rint(weight / norm[text] * 2**20) / 2**20
        ends = np.searchsorted(text, np.arange(size + 1))
        return [(feature[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def vectors(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        owner, hashes = features(texts)
        rows, at = self.lookup.find(hashes)
        width = max(1, len(self.known))
        cells, counts = np.unique(owner[rows] * width + at, return_counts=True)
        return self._weighted(cells // width, cells % width, counts, len(texts))

    def _vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        if not len(near):
            return self.share
        strength = cosine**2 * self.scale[near]
        return float((strength * self.labels[near]).sum() / strength.sum())

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[int]]]:
        if not self.ready:
            return np.full(len(texts), self.share), [[] for _ in texts]
        score, evidence = np.full(len(texts), self.nothing), []
        left, value = self.steps
        for start in range(0, len(texts), _BATCH):
            vectors = self.vectors(texts[start : start + _BATCH])
            for i, ((at, _), near) in enumerate(zip(vectors, self.index.nearest(vectors, NEAREST), strict=True), start):
                if len(at):
                    score[i] = value[max(0, int(np.searchsorted(left, self._vote(*near), side="right")) - 1)]
                evidence.append(self.ids[near[0][:3]].tolist())
        return np.clip(score, 0, 1), evidence


def labelled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, int]]:
    """(id, label, text, training rows of the label)"""
    for batch in batches:
        for part in slices(batch):
            yield from zip(part.column("id").to_pylist(), part.column("label").to_pylist(), as_bytes(part.column("text")), part.column("total").to_pylist(), strict=True)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch):
                score, evidence = model.scores(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(evidence, pa.list_(pa.int64()))], names=["id", "score", "evidence"])

    return run


def scored(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", parts: int = PARTS, held_out: int = HELD_OUT, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: id_column, held_out, score, predicted, evidence."""
    sample = labelled_sample(docs, labels, label_column, EXAMPLES, id_column, text_column, parts, held_out)
    shared = model_of(sample, ["label", "id"], lambda batches: NearestExamples(labelled_rows(batches)), lambda: NearestExamples(iter(())))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    out = in_arrow(texts, _score(shared), "id long, score double, evidence array<long>").withColumnRenamed("id", id_column)
    return out.select(id_column, (fold(id_column, parts) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
