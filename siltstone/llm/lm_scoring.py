"""Language-model scoring: Stupid-backoff over counts of all documents, as joins on n-gram hashes.

Words are maximal runs between ASCII spaces, A-Z lower-cased. The score of a word after a context is
count(context word) / count(context) if the n-gram was seen CUTOFF times at least, else ALPHA times the score after the
context without its first word; a single word's is count(word) / count of all words (the count of the empty n-gram).

Documents are dealt to chunks of a bounded number of bytes by a hash of identifier and text; they travel many to a row, compressed together. A chunk's n-grams are counted locally, and its
distinct 64-bit n-gram hashes leave in blocks by hash range: a block is many rows (hash, count) of the count table in
one. A hash range's blocks from all chunks meet in one task, which adds the counts up and joins the totals back to each
block, in the block's own order. The totals go back to their chunk, where the documents' n-grams look them up and each
document's scores are summed. So an n-gram crosses the network once per chunk and not once per occurrence; a frequent
one is a single entry of each block. Block rows carry one n-gram at least, so their number never exceeds the number of
distinct n-grams of all chunks.

Log scores are rounded to millionths and summed as integers, so that the order of summation doesn't matter. A null
text or one without words has n_words 0, log_prob_micro 0 and a null mean. Repeated rows count as often as they occur
and are scored each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hashed_words, in_arrow, mix, parallelism, release_memory, table

ORDER, CUTOFF, ALPHA = 3, 2, 0.4
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Chunks or ranges to a task, so that tasks stay of one size on large inputs.
TASK_CHUNKS = 16
_U = np.uint64
_EMPTY = _U(0x5851F42D4C957F2D)
_STEP = _U(0x9E3779B97F4A7C15)


def grams(texts: list[bytes | None], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(for k = 1..order: the hashes of the k-grams that end at each word, and whether they lie in its text; start of each text's words)"""
    words, at = hashed_words(texts)
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    out, inside = [words], [np.ones(len(words), np.bool_)]
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            longer = np.zeros(len(words), _U)
            longer[1:] = mix(out[-1][:-1] * _STEP + words[1:] + _U(k))
            out.append(longer)
            inside.append(place >= k - 1)
    return out, inside, at


def _all(out: list[np.ndarray], inside: list[np.ndarray]) -> np.ndarray:
    """All n-grams' hashes, the empty n-gram's last."""
    return np.concatenate([*(h[ok] for h, ok in zip(out, inside, strict=True)), [_EMPTY]])


def _distinct(all_: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, counts; the empty n-gram's is the number of words). Sorts all_ in place."""
    all_.sort()
    at = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1], [True])))
    known, counts = all_[at[:-1]], np.diff(at)
    counts[np.searchsorted(known, _EMPTY)] = words
    return known, counts


def _positions(all_: np.ndarray) -> np.ndarray:
    """Position of each hash among the sorted distinct ones."""
    order = np.argsort(all_)
    all_ = all_[order]
    rank = np.zeros(len(all_), np.int32)
    np.cumsum(all_[1:] != all_[:-1], out=rank[1:])
    position = np.empty(len(all_), np.int32)
    position[order] = rank
    return position


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Monotone in the hash."""
    return ((hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


_BUNDLES = "chunk long, ids array<long>, sizes array<int>, texts binary, raw long"


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each chunk in a batch, joined and compressed, in one row."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], chunks[order][1:] != chunks[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.take(pa.array(order[a:b]))
            texts = [t or b"" for t in as_bytes(rows.column("text"))]
            joined = b"".join(texts)
            held = [[int(chunks[order[a]])], [rows.column("id").to_pylist()], [[len(t) for t in texts]], [pa.compress(joined, "zstd", asbytes=True) if joined else b""], [len(joined)]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held, kinds, strict=True)], names=[c.split()[0] for c in _BUNDLES.split(", ")])


def _texts(sizes: list[list[int]], blobs: list[bytes], raw: list[int]) -> list[bytes]:
    out = []
    for lengths, blob, size in zip(sizes, blobs, raw, strict=True):
        joined, at = pa.decompress(blob, size, "zstd", asbytes=True) if size else b"", 0
        for n in lengths:
            out.append(joined[at : at + n])
            at += n
    return out


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of each chunk; rows must be sorted by chunk."""
    last, held = None, []
    for batch in batches:
        for chunk, *bundle in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "texts", "raw")), strict=True):
            if chunk != last:
                if held:
                    yield last, held
                last, held = chunk, []
            held += _texts(*([x] for x in bundle))
    if held:
        yield last, held


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, compressed: the high planes are nearly constant and the lowest plane of counts has few values. Blocks stay so in the JVM and in the shuffle."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _values(planes: bytes, size: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(planes, 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _sorted_planes(hashes: np.ndarray) -> bytes:
    return _planes(np.diff(hashes, prepend=_U(0)))


def _sorted_values(planes: bytes, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_values(planes, size, _U), dtype=_U)


_BLOCKS = "chunk long, hash_range long, size int, hashes binary, counts binary"
_TOTALS = "chunk long, hash_range long, size int, totals binary"


def _count(order: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in _by_chunk(batches):
            out, inside, _ = grams(texts, order)
            known, counts = _distinct(_all(out, inside), len(out[0]))
            del out, inside
            of = _range_of(known, ranges)
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cuts) - 1, chunk, np.int64)),
                    pa.array(of[cuts[:-1]]),
                    pa.array(np.diff(cuts), pa.int32()),
                    pa.array([_sorted_planes(known[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([_planes(counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                names=["chunk", "hash_range", "size", "hashes", "counts"],
            )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: adds the counts of a range's blocks and gives each block its totals."""

    def added(range_: int, held: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        sizes = [n for _, n, *_ in held]
        ends = np.cumsum(sizes)
        hashes = np.empty(ends[-1], _U)
        for end, (_, n, h, _) in zip(ends, held, strict=True):
            hashes[end - n : end] = _sorted_values(h, n)
        position = _positions(hashes)
        del hashes
        totals = np.zeros(int(position.max()) + 1, np.int64)
        for end, (_, n, _, c) in zip(ends, held, strict=True):
            totals[position[end - n : end]] += _values(c, n, np.int64)  # a block's hashes are distinct
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, *_ in held], pa.int64()), pa.array([range_] * len(held), pa.int64()), pa.array(sizes, pa.int32()), pa.array([_planes(totals[position[e - n : e]]) for e, n in zip(ends, sizes, strict=True)], pa.binary())],
            names=["chunk", "hash_range", "size", "totals"],
        )

    last, held = None, []
    for batch in batches:
        for range_, *block in zip(*(batch.column(c).to_pylist() for c in ("hash_range", "chunk", "size", "hashes", "counts")), strict=True):
            if range_ != last:
                if held:
                    yield added(last, held)
                last, held = range_, []
            held.append(tuple(block))
    if held:
        yield added(last, held)


def backoff(totals: np.ndarray, inside: list[np.ndarray], position: np.ndarray, cutoff: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(log score of each word in millionths, whether it backed off)"""
    seen, at = [], 0
    for ok in inside:
        counts = np.zeros(len(ok), np.int64)
        counts[ok] = totals[position[at : at + ok.sum()]]
        seen.append(counts)
        at += int(ok.sum())
    every = totals[position[-1]]
    score = seen[0] / max(1, every)
    longest = np.zeros(len(inside[0]), np.int64)
    for k in range(1, len(inside)):
        context = np.concatenate(([0], seen[k - 1][:-1]))
        use = inside[k] & (seen[k] >= cutoff)
        score = np.where(use, seen[k] / np.maximum(context, 1), np.where(inside[k], alpha * score, score))
        longest += use
    asked = sum(ok.astype(np.int64) for ok in inside[1:]) if len(inside) > 1 else 0
    return np.rint(np.log(score) * 1e6).astype(np.int64) if len(score) else np.empty(0, np.int64), longest < asked


_SCORED = "id long, n_words long, log_prob_micro long, n_backoff long"


def _score(order: int, cutoff: int, alpha: float):
    def run(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        out, inside, at = grams(_texts(*(docs.column(c).to_pylist() for c in ("sizes", "texts", "raw"))), order)
        position = _positions(_all(out, inside))
        del out
        ordered = sorted(zip(*(blocks.column(c).to_pylist() for c in ("hash_range", "size", "totals")), strict=True))
        totals = np.concatenate([_values(t, n, np.int64) for _, n, t in ordered])
        logs, less = backoff(totals, inside, position, cutoff, alpha)
        sums = [np.concatenate(([0], np.cumsum(x)))[at] for x in (logs, less.astype(np.int64))]
        ids = pa.array([i for part in docs.column("ids").to_pylist() for i in part], pa.int64())
        return pa.table({"id": ids, "n_words": np.diff(at), "log_prob_micro": np.diff(sums[0]), "n_backoff": np.diff(sums[1])})

    def released(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        try:
            return run(docs, blocks)
        finally:
            release_memory()

    return released


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, cutoff: int = CUTOFF, alpha: float = ALPHA) -> DataFrame:
    """One row per input row: id_column, n_words, log_prob_micro (sum of log scores in millionths), n_backoff (words whose longest n-gram was seen too seldom), mean_log_prob."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    held = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    chunks, ranges = held // CHUNK_BYTES + 1, held // RANGE_BYTES + 1
    partitions = max(parallelism(spark), chunks // TASK_CHUNKS + 1)
    bundles = in_arrow(texts.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))), _bundle, _BUNDLES)
    dealt = bundles.repartition(partitions, "chunk")
    blocks = in_arrow(dealt.sortWithinPartitions("chunk"), _count(order, ranges), _BLOCKS)
    totals = in_arrow(blocks.repartition(partitions, "hash_range").sortWithinPartitions("hash_range"), _add, _TOTALS)
    out = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_score(order, cutoff, alpha), _SCORED)
    mean = F.when(F.col("n_words") > 0, F.col("log_prob_micro") / 1e6 / F.col("n_words"))
    return out.select(F.col("id").alias(id_column), "n_words", "log_prob_micro", "n_backoff", mean.alias("mean_log_prob"))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
p AS (SELECT doc_id, w, lag(w) OVER o AS b1, lag(w, 2) OVER o AS b2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM p GROUP BY w), c2 AS (SELECT b1, w, count(*) AS n FROM p WHERE b1 IS NOT NULL GROUP BY b1, w), c3 AS (SELECT b2, b1, w, count(*) AS n FROM p WHERE b2 IS NOT NULL GROUP BY b2, b1, w),
one AS (SELECT w, n / (SELECT sum(n)::DOUBLE FROM c1) AS score FROM c1),
two AS (SELECT c2.b1, c2.w, c2.n, CASE WHEN c2.n >= {CUTOFF} THEN c2.n / c1.n ELSE {ALPHA}::DOUBLE * one.score END AS score FROM c2 JOIN c1 ON c1.w = c2.b1 JOIN one ON one.w = c2.w),
s AS (
  SELECT doc_id, CASE WHEN p.b2 IS NOT NULL THEN c3.n < {CUTOFF} WHEN p.b1 IS NOT NULL THEN two.n < {CUTOFF} ELSE false END AS less3,
         CASE WHEN p.b1 IS NULL THEN one.score WHEN p.b2 IS NULL THEN two.score WHEN c3.n >= {CUTOFF} THEN c3.n / before.n ELSE {ALPHA}::DOUBLE * two.score END AS score
  FROM p JOIN one ON p.w = one.w LEFT JOIN two ON p.b1 = two.b1 AND p.w = two.w LEFT JOIN c3 ON p.b2 = c3.b2 AND p.b1 = c3.b1 AND p.w = c3.w LEFT JOIN c2 before ON before.b1 = p.b2 AND before.w = p.b1
), g AS (SELECT doc_id, count(*) AS n_words, sum(round(ln(score::DOUBLE) * 1000000.0)::BIGINT)::BIGINT AS log_prob_micro, count_if(less3)::BIGINT AS n_backoff FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(log_prob_micro, 0) AS log_prob_micro, coalesce(n_backoff, 0) AS n_backoff,
       log_prob_micro::DOUBLE / 1000000.0::DOUBLE / n_words AS mean_log_prob
FROM d LEFT JOIN g USING (doc_id)
"""
