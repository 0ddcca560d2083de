"""Language ID by language-bitmask n-gram filters.

Each language has a Bloom filter of the byte n-grams (n = 3, 4, 5 of lower-cased words with their borders) that are
typical of it: at least MORE times as frequent in its training texts as in the pool of the others, and seen in several
texts. The filters are bit-sliced: one array whose cell holds a bit per language, so a hash function's probe returns
all languages at once and the AND over the probes is the set of languages whose filter has the n-gram. A text's
votes are popcounts per language over all its n-grams. A language's expected false positives are taken off, by the
false-positive rate of its filter: votes' = (votes - rate * n-grams) / (1 - rate). The largest corrected share decides
(ties: the first language by name); the score is its part of all corrected votes.

It is fitted in one executor task on a bounded sample of labelled rows: per language the SAMPLE whole texts whose identifiers have the smallest
hashes; predictions read whole texts. Texts that are null or have no letter (a character of a Unicode letter category; numerals are none) are `und` with score 0. A text without any hit gets
the language with the most training rows (of all, not of the sample; ties: the first by name), score 1 / languages.
Without labelled rows everything is `und`. Any number of languages: slices of more than 64 take several words a cell. Repeated rows get the same
language and score; of rows that share language and identifier the smallest text is learnt from. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, fold, in_arrow, in_pieces, likely, model_of, slices, table

LENGTHS = (3, 4, 5)
#: Training texts of a language.
SAMPLE = 400
#: Rows of identifiers that are broadcast at most; with more languages than that allows, the sample is joined by a shuffle.
BROADCAST = 400_000
MORE, LEAST_TEXTS = 4.0, 3
CELLS, PROBES = 1 << 19, 2
PARTS, HELD_OUT = 4, 2
UNKNOWN = "und"
_TOGETHER = 1 << 18
_LETTER = re.compile(r"\p{L}")
_U = np.uint64

#: Bytes that end a word here: everything in ASCII that is not a letter.
_BORDER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all n-grams inside words, borders counted as a byte; start of each text's n-grams, one more at the end)."""
    # further spaces, so that the shortest n-grams are not cut to the places where a longest one fits
    joined = b" " + b" ".join(texts).lower() + b" " * (1 + max(LENGTHS) - min(LENGTHS))
    data = np.frombuffer(joined, np.uint8)
    border = _BORDER[data]
    clean = np.where(border, 32, data).astype(_U)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text_at = np.concatenate(([0], np.cumsum(sizes)))
    packed, parts, keep_any = clean.copy(), [], []
    inner = np.zeros(len(data) + 1, np.int64)
    np.cumsum(border, out=inner[1:])
    for n in range(2, max(LENGTHS) + 1):
        packed = (packed[:-1] << _U(8)) | clean[n - 1 :]
        if n in LENGTHS:
            # a border may only stand first or last, and the middle is part of one word
            kept = inner[n - 1 : len(packed) + n - 1] - inner[1 : len(packed) + 1] == 0
            parts.append(packed | _U(n << 56))
            keep_any.append(kept)
    width = min(len(p) for p in parts)
    grams = np.stack([p[:width] for p in parts], axis=1)
    kept = np.stack([k[:width] for k in keep_any], axis=1)
    ends = np.concatenate(([0], np.cumsum(kept.sum(1))))
    return grams[kept], ends[np.minimum(text_at, width)]


def _cells(grams: np.ndarray, probe: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((grams * _U(0x9E3779B97F4A7C15 + 2 * probe)) ^ (grams >> _U(29 + probe))) * _U(0xC2B2AE3D27D4EB4F + 2 * probe) >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)


class LanguageFilters:
    """Bit-sliced Bloom filters of several languages."""

    def __init__(self, languages: list[str], common: int = 0):
        self.languages, self.common = languages, common
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if np.iinfo(k).bits >= len(languages)), np.uint64)
        self.bits = np.iinfo(kind).bits
        self.slices = np.zeros((max(1, -(-len(languages) // self.bits)), CELLS), kind)
        self.rates = np.zeros(len(languages))

    def add(self, language: int, grams: np.ndarray) -> None:
        word, bit = divmod(language, self.bits)
        for probe in range(PROBES):
            self.slices[word, _cells(grams, probe)] |= self.slices.dtype.type(1 << bit)

    def settle(self) -> None:
        """The false-positive rate of each filter follows from the bits that are set."""
        for k in range(len(self.languages)):
            self.rates[k] = (np.count_nonzero(self.has(self.slices, k)) / CELLS) ** PROBES

    def has(self, found: np.ndarray, language: int) -> np.ndarray:
        """The language's bit of each column of slice words, 0 or 1."""
        word, bit = divmod(language, self.bits)
        return (found[word] >> found.dtype.type(bit)) & found.dtype.type(1)

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """found[word, n-gram]: a bit for every language whose filter has the n-gram, in as many words as the languages need."""
        found = self.slices[:, _cells(grams, 0)]
        for probe in range(1, PROBES):
            found &= self.slices[:, _cells(grams, probe)]
        return found

    def votes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected votes[text, language], n-grams of each text)"""
        pieces, owner = in_pieces(texts, _TOGETHER)
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.languages)))
        sizes, at = np.cumsum([len(p) for p in pieces]), 0
        while at < len(pieces):  # n-grams take many times their text's memory
            past = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TOGETHER)))
            grams, ends = ngrams(pieces[at:past])
            found = self.containing(grams)
            np.add.at(total, owner[at:past], np.diff(ends))
            for k in range(len(self.languages)):
                counts = np.concatenate(([0], np.cumsum(self.has(found, k), dtype=np.int64)))
                np.add.at(hits[:, k], owner[at:past], np.diff(counts[ends]))
            at = past
        return np.maximum(0.0, (hits - self.rates * total[:, None]) / (1 - self.rates)), total

    def decide(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score)"""
        votes, _ = self.votes(texts)
        total = votes.sum(1)
        best = np.where(total > 0, votes.argmax(1), self.common)
        score = np.where(total > 0, votes.max(1) / np.maximum(total, 1e-300), 1.0 / len(self.languages))
        return best, score


def _largest_elsewhere(grams: list[np.ndarray], shares: list[np.ndarray]) -> list[np.ndarray]:
    """For each language's n-grams (distinct in a language), the largest share that another language has of the same one, else 0."""
    every, share = np.concatenate(grams), np.concatenate(shares)
    if not len(every):
        return [np.empty(0) for _ in grams]
    order = np.lexsort((-share, every))
    same = every[order][1:] == every[order][:-1]
    first = np.concatenate(([True], ~same))  # of an n-gram, the language with the largest share
    top = share[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    second = np.where(np.concatenate((same, [False])), np.concatenate((share[order][1:], [0.0])), 0.0)
    out = np.empty(len(every))
    out[order] = np.where(first, second, top)
    return np.split(out, np.cumsum([len(g) for g in grams])[:-1])


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams, the sums of their counts, how many of the arrays they are in)"""
    if not grams:
        return np.empty(0, _U), np.empty(0), np.empty(0)
    known, at = np.unique(np.concatenate(grams), return_inverse=True)
    return known, np.bincount(at, np.concatenate(counts), len(known)), np.bincount(at, minlength=len(known))


def _counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, counts) of a text, a piece at a time."""
    parts = [np.unique(ngrams([piece])[0], return_counts=True) for piece in in_pieces([text], _TOGETHER)[0]]
    return parts[0] if len(parts) == 1 else _summed([g for g, _ in parts], [n for _, n in parts])[:2]


def learnt(rows: Iterable[tuple[str, bytes, int]]) -> LanguageFilters | None:
    """Filters from rows of language, text and the language's rows before sampling."""
    by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    totals: dict[str, int] = {}
    for language, text, total in rows:
        by.setdefault(language, []).append(_counted(text))
        totals[language] = total
    if not by:
        return None
    languages = sorted(by)
    filters = LanguageFilters(languages, max(range(len(languages)), key=lambda k: (totals[languages[k]], -k)))
    counted = [_summed([g for g, _ in by[language]], [n for _, n in by[language]]) for language in languages]
    shares = [seen / max(1, seen.sum()) for _, seen, _ in counted]
    others = _largest_elsewhere([grams for grams, *_ in counted], shares)
    for k, ((grams, _, in_texts), share, other) in enumerate(zip(counted, shares, others, strict=True)):
        typical = (in_texts >= min(LEAST_TEXTS, len(by[languages[k]]))) & (share >= MORE * other if len(languages) > 1 else True)
        filters.add(k, grams[typical])
    filters.settle()
    return filters


def sample_of(docs: DataFrame, id_column: str, text_column: str, label_column: str, parts: int = PARTS, held_out: int = HELD_OUT) -> DataFrame:
    """language, total (training rows of the language), id, text: the SAMPLE rows of each language whose identifiers have the smallest hashes, chosen without their texts."""
    train = docs.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull() & (fold(id_column, parts) != held_out))
    train = train.select(F.col(label_column).cast("string").alias("language"), F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    named = train.select("language", "id", F.xxhash64("id").alias("h"))
    totals = named.groupBy("language").agg(F.count("*").alias("total"))
    small = totals.limit(BROADCAST // SAMPLE + 1).count() <= BROADCAST // SAMPLE  # so many languages that the sample's identifiers can be broadcast
    sent = F.broadcast if small else (lambda df: df)
    low = named.join(sent(totals), "language").filter(likely(F.col("h"), SAMPLE, F.col("total"))).distinct()  # some more than SAMPLE rows of each language
    first = Window.partitionBy("language").orderBy("h", "id")
    chosen = low.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE).select("language", "id", "total")
    return train.join(sent(chosen), ["language", "id"]).groupBy("language", "total", "id").agg(F.min("text").alias("text"))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(part.column("language").to_pylist(), as_bytes(part.column("text")), part.column("total").to_pylist(), strict=True)


_OUT = "id long, lang_pred string, score double"


def _decided(filters: LanguageFilters | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, whether the text has a letter and a language can be told)"""
    texts = column.to_pylist()
    if filters is None:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.bool_)
    known = np.array([t is not None and _LETTER.search(t) is not None for t in texts], np.bool_)
    best, score = filters.decide([t or b"" for t in as_bytes(column)])
    return best, np.where(known, score, 0.0), known


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch):
                best, score, known = _decided(filters, part.column("text"))
                names = [filters.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def _accept(shared, text_column: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = pickle.loads(shared.value)
        for batch in batches:
            for part in slices(batch, text_column):
                _, score, known = _decided(filters, part.column(text_column))
                yield part.filter(pa.array(known & (score >= least)))

    return run


def fitted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", parts: int = PARTS, held_out: int = HELD_OUT):
    """The filters as a broadcast of their pickled bytes."""
    return model_of(sample_of(docs, id_column, text_column, label_column, parts, held_out), ["language", "id"], lambda batches: learnt(_training_rows(batches)), lambda: None)


def predicted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", parts: int = PARTS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per input row: id_column, held_out, lang_pred, score."""
    filters = fitted(docs, id_column, text_column, label_column, parts, held_out)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    out = in_arrow(texts, _predict(filters), _OUT).withColumnRenamed("id", id_column)
    return out.select(id_column, (fold(id_column, parts) == held_out).alias("held_out"), "lang_pred", "score")


def accepted_rows(docs: DataFrame, least: float, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """The rows of docs whose language is told with a score of least or more, with their columns; decided row by row, whatever the identifiers."""
    return in_arrow(docs, _accept(fitted(docs, id_column, text_column, label_column), text_column, least), docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return predicted(table(spark, sf_dir, "documents"))
