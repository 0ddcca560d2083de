"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its bytes, its words, and events: a word that repeats the one before, a word
in capitals, a punctuation byte that repeats the one before. Words, all of them, fall by hash into WORDS columns. Term weights are log(1 + rate per thousand) times, in place of the inverse document
frequency, the bits that the best threshold on it tells of the label, in standard deviations (a supervised TF-IDF). The leading eigenvectors of the labelled
sample's term-term matrix give the latent space. The labelled sample's vectors, at most 2 * EXAMPLES of DIMENSIONS
floats, are broadcast: their size does not depend on the input. Every text's vector is multiplied with all of them, a
block of texts at a time, and its NEAREST neighbours vote with weight similarity^SHARPNESS, each label scaled to its
share of all training rows. Vectors are multiples of 2^-20, so that products are exact, whatever else is in a block; of equally similar
neighbours the first by label and identifier votes.

A monotone step function, fitted on the examples' own leave-one-out votes, turns the weighted
share of label 1 into the score (0 to 1). Fitting is one executor task, over at most EXAMPLES rows of each label by hash, near copies once; an identifier
with both labels is an example of both. Whole texts are scored. Null counts as empty; a text without terms and, if only one
label or none was learnt, every text scores the share of label 1 (0.5 without training rows). Repeated rows score alike.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, Copies, Spans, as_bytes, fold, in_arrow, labelled_sample, model_of, monotone, slices, table
from .toxicity import labelled_rows

#: Labelled texts of each label, at most.
EXAMPLES = 2048
WORDS, DIMENSIONS = 1024, 64
NEAREST, SHARPNESS = 15, 16
#: Power of a term's information in its weight.
POWER = 0.5
THRESHOLD = 0.3
PARTS, HELD_OUT = 5, 0
#: An event is a term for each of these shares of the words that it exceeds.
_LEAST = (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)
_BLOCK = 256
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_U = np.uint64


def _spread(texts: np.ndarray, terms: np.ndarray, count: int, width: int) -> np.ndarray:
    return np.bincount(texts * width + terms, minlength=count * width).reshape(count, width).astype(np.float64)


def terms(texts: list[bytes | None]) -> np.ndarray:
    """Rates[text, term]: 256 bytes, the events, the words' columns."""
    spans = Spans(texts, _IS_SPACE)
    n = len(texts)
    of_byte = np.repeat(np.arange(n), np.diff(spans.text_at))
    of_word = np.repeat(np.arange(n), np.diff(spans.at))
    raw = spans.raw
    bytes_ = _spread(of_byte, raw.astype(np.int64), n, 256)
    bytes_[:, 10] -= 1  # the separator
    words = spans.hashes(spans.starts, spans.ends)
    again = np.zeros(len(words), np.bool_)
    again[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    capitals = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
    small = np.concatenate(([0], np.cumsum((raw >= 97) & (raw <= 122))))
    upper = capitals[spans.ends] - capitals[spans.starts]
    loud = (upper >= 2) & (small[spans.ends] - small[spans.starts] == 0)
    run = np.zeros(len(raw), np.bool_)
    run[1:] = _PUNCTUATION[raw[1:]] & (raw[1:] == raw[:-1])
    events = np.stack([np.bincount(of_word[again], minlength=n), np.bincount(of_word[loud], minlength=n), np.bincount(of_byte[run], minlength=n)], axis=1)
    column = (words >> _U(65 - WORDS.bit_length())).astype(np.int64)
    length, held = np.diff(spans.text_at)[:, None] + 60, np.diff(spans.at)[:, None] + 10
    # per thousand bytes or words, so that long and short texts are alike; smoothed for the shortest
    buckets = np.hstack([events / held > least for least in _LEAST])
    return 1000 * np.hstack([bytes_ / length, buckets, _spread(of_word, column, n, WORDS) / held])


def _exact(x: np.ndarray) -> np.ndarray:
    """Rounded to multiples of 2^-20: sums of products of such numbers need no rounding."""
    return np.rint(x * 2**20) / 2**20


def _information(values: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each column, the most bits that a threshold on it tells of the label; thresholds at 15 quantiles and at presence."""

    def entropy(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return -(p * np.log2(p) + (1 - p) * np.log2(1 - p))

    positive = weight * labels
    best = np.zeros(values.shape[1])
    for at in [np.zeros(values.shape[1]), *np.quantile(values, np.arange(1, 16) / 16, axis=0), 0.5 * values.max(0)]:
        above = (values > at).astype(np.float64)
        share, ones = weight @ above, positive @ above
        rest, rest_ones = 1 - share, positive.sum() - ones
        left = share * entropy(ones / np.maximum(share, 1e-12)) + rest * entropy(rest_ones / np.maximum(rest, 1e-12))
        best = np.maximum(best, entropy(positive.sum(keepdims=True)) - left)
    return np.maximum(best, 0)


class Neighbours:
    """The fitted model; its size is bounded by the parameters."""

    def __init__(self, rows: Iterator[tuple[int, int, bytes, int]]):
        """rows: (id, label, text, training rows of the label)"""
        totals: dict[int, int] = {}
        kept, rates, copies = [], [], (Copies(), Copies())
        for _, label, text, total in rows:
            totals[label] = total
            if copies[label].new(text):
                kept.append(label)
                rates.append(terms([text]).astype(np.float32))
        self.share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
        self.ready = len(totals) == 2
        if not self.ready:
            return
        labels, counts = np.array(kept), np.vstack(rates)
        # every label weighs alike, however many texts of it there are
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        logs = np.log1p(counts)
        spread = np.sqrt(np.maximum(logs.T**2 @ weight - (logs.T @ weight) ** 2, 1e-6))
        self.weights = _information(logs, labels, weight) ** POWER / (spread + 0.3)
        matrix = self._scaled(counts)
        _, vectors = np.linalg.eigh(matrix.T @ (matrix * weight[:, None]))
        self.space = _exact(vectors[:, ::-1][:, :DIMENSIONS])
        self.examples = self._unit(matrix @ self.space)
        self.labels = labels.astype(float)
        self.votes = np.array([totals[y] / (labels == y).sum() for y in (0, 1)])[labels]
        raw = np.concatenate([self._vote(self.examples[i : i + _BLOCK], i)[0] for i in range(0, len(kept), _BLOCK)])
        self.steps = monotone(raw, labels.astype(float), self.votes.astype(float))

    def _scaled(self, counts: np.ndarray) -> np.ndarray:
        out = np.log1p(counts, dtype=np.float64) * self.weights
        return _exact(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return _exact(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))

    def _vote(self, vectors: np.ndarray, leave_out: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(weighted share of label 1, total weight); leave_out: the vectors are the examples from there on, which don't vote for themselves."""
        near = vectors @ self.examples.T
        if leave_out is not None:
            near[np.arange(len(vectors)), leave_out + np.arange(len(vectors))] = -1
        k = min(NEAREST, near.shape[1])
        place = np.rint(near * 2**40).astype(np.int64) * 2 * EXAMPLES - np.arange(near.shape[1])  # distinct, also where similarities are equal
        top = np.argpartition(-place, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(place, top, 1), axis=1), 1)
        strength = np.maximum(np.take_along_axis(near, top, 1), 0) ** SHARPNESS * self.votes[top]
        total = strength.sum(1)
        return (strength * self.labels[top]).sum(1) / np.maximum(total, 1e-12), total

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not self.ready:
            return out
        for at in range(0, len(texts), _BLOCK):
            counts = terms(texts[at : at + _BLOCK])
            voted, total = self._vote(self._unit(self._scaled(counts) @ self.space))
            left, value = self.steps
            calibrated = value[np.maximum(np.searchsorted(left, voted, side="right") - 1, 0)]
            out[at : at + _BLOCK] = np.where((total > 1e-9) & (counts.sum(1) > 0), np.clip(calibrated, 0, 1), self.share)
        return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(as_bytes(part.column("text"))))], names=["id", "score"])

    return run


def _accept(shared, text_column: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, text_column):
                yield part.filter(pa.array(model.scores(as_bytes(part.column(text_column))) >= threshold))

    return run


def fitted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", parts: int = PARTS, held_out: int = HELD_OUT):
    """The model as a broadcast of its pickled bytes."""
    sample = labelled_sample(docs, labels, label_column, EXAMPLES, id_column, text_column, parts, held_out)
    return model_of(sample, ["label", "id"], lambda batches: Neighbours(labelled_rows(batches)), lambda: Neighbours(iter(())))


def scored(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", parts: int = PARTS, held_out: int = HELD_OUT, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: id_column, held_out, score, predicted."""
    shared = fitted(docs, labels, id_column, text_column, label_column, parts, held_out)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    out = in_arrow(texts, _score(shared), "id long, score double").withColumnRenamed("id", id_column)
    return out.select(id_column, (fold(id_column, parts) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold at least, with their columns; decided row by row, whatever the identifiers."""
    return in_arrow(docs, _accept(fitted(docs, labels, id_column, text_column, label_column), text_column, threshold), docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
