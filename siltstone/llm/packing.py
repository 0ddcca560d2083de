"""Packing token sequences by non-negative least squares over length combinations.

A document is its token ids (by `byte_bpe`) and an end id. It is cut into windows of the full length, which need no packing, and a
rest shorter than a window. The histogram of rests (at most window - 1 counts, however many documents there are) is
all the driver sees. Combinations of up to three lengths that fill a window exactly are enumerated; repeat counts x >= 0
that minimise |A x - histogram|^2 are found by coordinate descent, rounded down to what the histogram holds, and what
is left is packed greedily: rests in order of length, end to end, cut where a window ends. Only the last sequence
can be short of a window. So the place of a rest follows from its length and its rank among rests of that length,
and no documents meet in one task.

A task numbers its rests by length as it goes; the numbers are made global by a sum over tasks for each length. Pieces
that the greedy part cuts are few; their documents are tokenised again for the checksums of both parts.

Null texts count as empty: a document of the end id alone. Repeated rows are packed each. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import in_arrow, slices, staged, table

WINDOW = 2048
END_ID = 1
COMBINATIONS = 6000
SWEEPS = 40
#: Bytes of text that are tokenised at once.
_SLICE = 8 << 20

_tokenizers: dict[str, ByteBpe] = {}


def _tokenizer(path: str) -> ByteBpe:
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PIECES = "part int, rank long, doc_id long, mark long, start long, length int, ids_crc32 long, doc_tokens long"


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = _tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, limit=_SLICE):
                out: list[tuple] = []
                encoded = tokenizer.encoded(rows.column("text"), end_id)
                for doc, mark, ids in zip(rows.column("doc_id").to_pylist(), rows.column("mark").to_pylist(), encoded, strict=True):
                    tokens = len(ids) // 4
                    for at in range(0, tokens, window):
                        length = min(window, tokens - at)
                        out.append((part, int(seen[length]), doc, mark, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), tokens))
                        seen[length] += 1
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def combinations(counts: dict[int, int], window: int = WINDOW, most: int = COMBINATIONS) -> list[tuple[int, ...]]:
    """Up to `most` multisets of one to three present lengths that add up to the window: all of one and two, then the triples whose rarest length is commonest."""
    have = sorted(k for k, n in counts.items() if n > 0 and k < window)
    held = np.zeros(window + 1)
    for k in have:
        held[k] = counts[k]
    out: list[tuple[int, ...]] = [(a, window - a) for a in have if 2 * a <= window and held[window - a] > 0]
    lengths, found = np.array(have, np.int64), []
    for a in have:
        if 3 * a > window:
            break
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        c = window - a - b
        least = np.minimum(held[a], np.minimum(held[b], held[c]))
        keep = least > 0
        found += zip(least[keep].tolist(), [a] * int(keep.sum()), b[keep].tolist(), c[keep].tolist(), strict=True)
    found.sort(key=lambda x: (-x[0], x[1:]))
    return out + [x[1:] for x in found[: max(0, most - len(out))]]


def least_squares(sets: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """x >= 0 that minimises |A x - counts|^2, column j of A counting the lengths of sets[j]; coordinate descent, exact for each coordinate."""
    columns = [[(k, s.count(k)) for k in dict.fromkeys(s)] for s in sets]
    norms = [sum(m * m for _, m in c) for c in columns]
    left = {k: float(n) for k, n in counts.items()}
    x = [0.0] * len(sets)
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(m * left[k] for k, m in column) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, m in column:
                    left[k] -= m * step
        if moved < 0.25:
            break
    return x


def solved(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, past rank, sequence, offset, cut): rests of that length and those ranks lie one to a sequence from `sequence` on, at `offset`; or, if cut, end to end from there."""
    whole = counts.get(window, 0)
    runs = [(window, 0, whole, 0, 0, 0)] if whole else []
    rests = {k: n for k, n in counts.items() if k != window and n}
    sets = combinations(rests, window)
    x = least_squares(sets, rests) if sets else []
    used, sequence = dict.fromkeys(rests, 0), whole
    for rounded in (True, False):  # then what rounding down has left
        for j in sorted(range(len(sets)), key=lambda j: (-x[j], sets[j])):
            need = {k: sets[j].count(k) for k in sets[j]}
            fits = min((rests[k] - used[k]) // m for k, m in need.items())
            times = min(int(x[j]), fits) if rounded else fits
            if times <= 0:
                continue
            seen: dict[int, int] = {}
            offset = 0
            for k in sets[j]:
                lo = used[k] + seen.get(k, 0) * times
                runs.append((k, lo, lo + times, sequence, offset, 0))
                seen[k] = seen.get(k, 0) + 1
                offset += k
            for k, m in need.items():
                used[k] += m * times
            sequence += times
    place = sequence * window
    for k in sorted(rests, reverse=True):
        if used[k] < rests[k]:
            runs.append((k, used[k], rests[k], place // window, place % window, 1))
            place += k * (rests[k] - used[k])
    return runs


_PLACED = "doc_id long, mark long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut int"


def _place(runs: list[tuple], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.array(sorted(runs), np.int64).reshape(-1, 6)
        keys = table_[:, 0] * (1 << 44) + table_[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("rank", "before", "length", "start", "doc_id", "mark", "ids_crc32", "doc_tokens")}
            rank, length = col["rank"] + col["before"], col["length"]
            at = table_[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            past = rank - at[:, 1]
            place = np.where(at[:, 5] == 1, at[:, 3] * window + at[:, 4] + past * length, (at[:, 3] + past) * window + at[:, 4])
            sequence, offset = place // window, place % window
            cut = np.where(offset + length > window, window - offset, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (col["doc_id"], col["mark"], col["start"], length, col["ids_crc32"], col["doc_tokens"], sequence, offset, cut.astype(np.int32))], names=[c.split()[0] for c in _PLACED.split(", ")]
            )

    return run


_FINAL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _recut(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for rows in slices(batch, limit=_SLICE):
                out = []
                for r, ids in zip(rows.drop_columns(["text"]).to_pylist(), tokenizer.encoded(rows.column("text"), end_id), strict=True):
                    for at, length, sequence, offset in ((r["start"], r["cut"], r["sequence_id"], r["offset"]), (r["start"] + r["cut"], r["length"] - r["cut"], r["sequence_id"] + 1, 0)):
                        out.append((r["doc_id"], at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), r["doc_tokens"], sequence, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in _FINAL.split(", ")])

    return run


def packed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    pieces = staged(in_arrow(texts, _cut(path, window, end_id), _PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most `window` rows, whatever the input
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = in_arrow(pieces.join(offsets, ["length", "part"]), _place(solved(counts, window), window), _PLACED)
    whole = placed.filter("cut = 0").drop("cut", "mark")
    crossing = placed.filter("cut > 0")
    cut_docs = crossing.select("doc_id", "mark").distinct()
    again = texts.join(cut_docs, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    recut = in_arrow(crossing.join(again, ["doc_id", "mark"]), _recut(path, end_id), _FINAL)
    return whole.select(*[c.split()[0] for c in _FINAL.split(", ")]).unionByName(recut)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
