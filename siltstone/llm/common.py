"""What the operators of this folder share: staged tables, folds, text hashing and Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import operator
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the characters that separate words.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
SLICE_BYTES = 1 << 20
_SEGMENT = 1 << 20

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A local one is made only if the session names none and runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or _local_dir()


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="siltstone-")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{uuid.uuid4().hex}-{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, after which the worker gives its free memory back: workers live on beside the stages that run in the JVM."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(released, schema)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of `column`, a row at least, so that memory follows bytes and not rows."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        past = max(past, at + 1)
        yield batch.slice(at, past - at)
        at = past


def as_bytes(array: pa.Array) -> list[bytes | None]:
    return array.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U(33))
        x = x * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


_IS_SPACE = np.zeros(256, np.bool_)
_IS_SPACE[list(SPACES)] = True
_RADIX = 0x9E3779B97F4A7C15 | 1
_UNRADIX = pow(_RADIX, -1, 1 << 64)


@functools.cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _upto(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (int(size) - 1).bit_length()))[:size]


class Spans:
    """The words of a list of texts, A-Z lower-cased, and 64-bit hashes of any spans of them.

    A word is a maximal run of bytes that `border` (a table of 256 booleans) doesn't name. One pass over the bytes in
    numpy: a prefix sum of byte * radix^position gives every span's polynomial, moved to position 0 and mixed."""

    def __init__(self, texts: list[bytes | None], border: np.ndarray):
        joined = b"\n".join([t or b"" for t in texts]) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        self.data = np.frombuffer(joined.lower(), np.uint8)
        lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        edge = border[self.data]
        before = np.empty_like(edge)
        before[0], before[1:] = True, edge[:-1]
        self.starts, self.ends = np.flatnonzero(~edge & before), np.flatnonzero(edge & ~before)
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))  # of bytes
        self.at = np.searchsorted(self.starts, self.text_at)  # of words
        # exponents restart at a border after each segment, so that the tables of powers stay small for texts of any length
        cuts = np.flatnonzero(edge)
        cuts = cuts[np.searchsorted(cuts, np.arange(_SEGMENT, len(self.data), _SEGMENT))] if len(self.data) > _SEGMENT else cuts[:0]
        self._from = np.unique(np.concatenate(([0], cuts)))
        self._sums = np.zeros(len(self.data) + 1, _U)
        with np.errstate(over="ignore"):
            for lo, hi in zip(self._from, [*self._from[1:], len(self.data)], strict=True):
                # a segment starts at a border, where no word does: its place keeps the sum of the segment before
                np.cumsum((self.data[lo:hi].astype(_U) + _U(1)) * _upto(_RADIX, hi - lo), out=self._sums[lo + 1 : hi + 1])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        offset = starts - self._from[np.searchsorted(self._from, starts, side="right") - 1]
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * _upto(_UNRADIX, int(offset.max(initial=0)) + 1)[offset] + (ends - starts).astype(_U))


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, start of each text's words; one more start at the end). Words are maximal runs without the six ASCII space characters."""
    words, counts, group, held = [], [], [], 0
    for i, text in enumerate(texts):
        group.append(text)
        held += len(text or b"")
        if held >= SLICE_BYTES or i + 1 == len(texts):
            spans = Spans(group, _IS_SPACE)
            words.append(spans.hashes(spans.starts, spans.ends))
            counts.append(np.diff(spans.at))
            group, held = [], 0
    if not words:
        return np.empty(0, _U), np.zeros(1, np.int64)
    return np.concatenate(words), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def in_pieces(texts: list[bytes], limit: int = SLICE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """(the texts, those beyond `limit` cut at spaces, which are left out; the text that each piece is of)"""
    out, owner = [], []
    for i, text in enumerate(texts):
        while len(text) > limit:
            at = text.find(b" ", limit)
            if at < 0:
                break
            out.append(text[:at])
            owner.append(i)
            text = text[at + 1 :]
        out.append(text)
        owner.append(i)
    return out, np.array(owner, np.int64)


class Lookup:
    """Positions of known 64-bit hashes: a table by leading bits, then the hash itself."""

    def __init__(self, known: np.ndarray):
        self.order = np.argsort(known, kind="stable")
        self.sorted = known[self.order]
        self.shift = _U(64 - max(16, (8 * max(1, len(known)) - 1).bit_length()))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), np.bool_)
        self.maybe[(known >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of `hashes` that are known, their positions)"""
        rows = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        if not len(self.sorted):
            return rows[:0], rows[:0]
        at = np.minimum(np.searchsorted(self.sorted, hashes[rows]), len(self.sorted) - 1)
        right = self.sorted[at] == hashes[rows]
        return rows[right], self.order[at[right]]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_column: str, most: int, id_column: str = "doc_id", text_column: str = "text", parts: int = 4, held_out: int = 2) -> DataFrame:
    """label, total (training rows of that label), id, text: at most `most` training rows of each label 0 and 1, by hash of the identifier alone.

    The held-out fold is left out; so are null texts and identifiers. Identifiers are chosen before any text is read. A repeated row of
    documents counts in the totals and once in the sample; an identifier labelled both ways counts for each label."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).distinct()
    train = docs.filter(F.col(text_column).isNotNull() & (fold(id_column, parts) != held_out)).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    joined = train.select("id").join(known, "id").withColumn("h", F.xxhash64("id"))
    totals = {r["label"]: r["n"] for r in joined.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return train.limit(0).select(F.lit(0).alias("label"), F.lit(0).cast("long").alias("total"), F.col("id").cast("long"), "text")
    wanted = functools.reduce(operator.or_, [(F.col("label") == y) & likely(F.col("h"), most, n) for y, n in totals.items()])
    first = Window.partitionBy("label").orderBy("h", "id")
    chosen = joined.filter(wanted).select("label", "h", "id").distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    total = F.coalesce(*[F.when(F.col("label") == y, F.lit(n)) for y, n in totals.items()]).cast("long")
    texts = train.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))  # at most 2 * most identifiers
    return texts.join(chosen, "id").select("label", total.alias("total"), F.col("id").cast("long"), "text")


def model_of(sample: DataFrame, order: list[str], fit: Callable[[Iterator[pa.RecordBatch]], object], empty: Callable[[], object]) -> Broadcast:
    """What fit makes of the sorted sample in one executor task, pickled, as a broadcast: the driver passes its bytes on and holds neither texts nor the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(batches), 5)], pa.binary())], names=["model"])

    made = in_arrow(sample.repartition(1).sortWithinPartitions(*order), run, "model binary").collect()
    return sample.sparkSession.sparkContext.broadcast(bytes(made[0]["model"]) if made else pickle.dumps(empty(), 5))


def likely(hashed: Column, wanted: int, among: int | Column) -> Column:
    """Whether a row's hash is low enough to be among the `wanted` lowest: so that an ordered limit gathers about that many rows, however many partitions each could offer as many."""
    share = F.least(F.lit(1.0), F.lit(1.25 * wanted + 200) / F.greatest(F.lit(1), F.lit(among) if isinstance(among, int) else among))
    return F.pmod(hashed, F.lit(1 << 30)) < (share * (1 << 30)).cast("long") + 1


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y in weighted squares (pool adjacent violators): (left ends, values)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b * w
            pools[-1][1] += w
        else:
            pools.append([b * w, w, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, w_, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w_
            pools[-1][3] = last
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Copies:
    """Recognises near copies among texts of a bounded sample: those whose three-word windows have the same minimum under all of four orders."""

    def __init__(self):
        self.seen: set[tuple[int, ...]] = set()

    def new(self, text: bytes) -> bool:
        words, at = hashed_words([text])
        found, _ = windows(words, at, 3)
        least = tuple(int(mix(found ^ _U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min()) for k in range(1, 5)) if len(found) else ()
        known = least in self.seen
        self.seen.add(least)
        return not known


_STEPS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def windows(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the `size`-word windows inside each text, their starts as in hashed_words). A text with fewer words, one at least, has its whole sequence as its one window."""
    count = np.diff(at)
    full = np.maximum(count - size + 1, 0)
    made = np.where(full > 0, full, (count > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(out_at[-1], _U)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            sums = np.zeros(len(words) - size + 1, _U)
            for k in range(size):
                sums += words[k : k + len(sums)] * (_STEPS[k % len(_STEPS)] + _U(2 * (k // len(_STEPS))))
            rows = np.repeat(at[:-1] - out_at[:-1], full) + np.flatnonzero(np.repeat(full > 0, made)) if full.any() else np.empty(0, np.int64)
            out[np.repeat(full > 0, made)] = mix(sums[rows])
        for i in np.flatnonzero((full == 0) & (count > 0)):
            part = words[at[i] : at[i + 1]]
            total = _U(len(part))
            for k, word in enumerate(part):
                total = total + word * (_STEPS[k % len(_STEPS)] + _U(2 * (k // len(_STEPS))))
            out[out_at[i]] = mix(np.array([total + _U(0x51ED270B)], _U))[0]
    return out, out_at
