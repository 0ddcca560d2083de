"""Exact dedup by Patricia-trie owners.

Each task first inserts its texts into a compressed radix trie, whose terminal nodes hold the best row and the number
of rows seen, so a text leaves a task once however often it occurs there. What leaves is dealt by length and content
hash; each such partition inserts the full byte strings into its own trie. A trie that outgrows its budget spills its
heaviest subtree: the subtree's terminals go out as partial owners and the subtree is cut off. Partial owners of one
text meet in a last, small aggregation by (length, SHA-256).

Nulls count as empty text. Empty texts are one group. Repeated rows count as rows of their group. Of two rows with the
same identifier both are returned. A null identifier stands after all others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, in_arrow, parallelism, slices, table

TRIE_BYTES = 48 << 20
_NODE_BYTES = 300


class Owner:
    """What a terminal node holds: the best row by (most code points, smallest id), and the number of rows."""

    __slots__ = ("points", "row", "rows")

    def __init__(self, points: int, row: int | None, rows: int):
        self.points, self.row, self.rows = points, row, rows

    def take(self, points: int, row: int | None, rows: int) -> None:
        self.rows += rows
        if (-points, row is None, row or 0) < (-self.points, self.row is None, self.row or 0):
            self.points, self.row = points, row


class _Node:
    __slots__ = ("edges", "owner")

    def __init__(self, owner: Owner | None = None):
        self.edges: dict[int, tuple[bytes, _Node]] = {}  # by first byte
        self.owner = owner


class RadixTrie:
    """A compressed radix trie of byte strings with an Owner at each terminal."""

    def __init__(self) -> None:
        self.root = _Node()
        self.size = 0  # bytes held, with an allowance for nodes

    def insert(self, key: bytes, points: int, row: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.owner is None:
                    node.owner = Owner(points, row, rows)
                else:
                    node.owner.take(points, row, rows)
                return
            edge = node.edges.get(key[at])
            if edge is None:
                node.edges[key[at]] = (key[at:], _Node(Owner(points, row, rows)))
                self.size += len(key) - at + _NODE_BYTES
                return
            label, below = edge
            if not key.startswith(label, at):
                shared = _shared(label, key, at)
                middle = _Node()
                middle.edges[label[shared]] = (label[shared:], below)
                node.edges[label[0]] = (label[:shared], middle)
                self.size += _NODE_BYTES
                label, below = label[:shared], middle
            node, at = below, at + len(label)

    def terminals(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Owner]]:
        todo = [(node or self.root, prefix)]
        while todo:
            node, prefix = todo.pop()
            if node.owner is not None:
                yield prefix, node.owner
            todo.extend((below, prefix + label) for label, below in node.edges.values())

    def spill(self, until: int) -> Iterator[tuple[bytes, Owner]]:
        """Cuts the heaviest subtrees, from the root's edges down a level at a time, until `until` bytes are left; gives their terminals."""
        weights = {first: _weight(label, below) for first, (label, below) in self.root.edges.items()}
        for first in sorted(weights, key=weights.__getitem__, reverse=True):
            if self.size <= until:
                break
            label, below = self.root.edges.pop(first)
            self.size -= weights[first]
            yield from self.terminals(below, label)


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of label and key[at:], by halving."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _weight(label: bytes, node: _Node) -> int:
    total, todo = 0, [(label, node)]
    while todo:
        label, node = todo.pop()
        total += len(label) + _NODE_BYTES
        todo.extend(node.edges.values())
    return total


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def _code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


_KEYED = "id long, size int, digest binary"
_OWNERS = "size int, digest binary, content binary, points int, row long, rows long"


def _owner_rows(found: list[tuple[bytes, Owner]], with_content: bool) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes."""
    at = 0
    while at < len(found):
        past, held = at, 0
        while past < len(found) and (past == at or held < 4 << 20):
            held += len(found[past][0])
            past += 1
        part = found[at:past]
        at = past
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([len(k) for k, _ in part], pa.int32()),
                pa.array([hashlib.sha256(k).digest() for k, _ in part], pa.binary()),
                pa.array([k if with_content else None for k, _ in part], pa.binary()),
                pa.array([o.points for _, o in part], pa.int32()),
                pa.array([o.row for _, o in part], pa.int64()),
                pa.array([o.rows for _, o in part], pa.int64()),
            ],
            names=["size", "digest", "content", "points", "row", "rows"],
        )


def _drained(trie: RadixTrie, everything: bool, with_content: bool) -> Iterator[pa.RecordBatch]:
    found, held = [], 0
    for key, owner in trie.terminals() if everything else trie.spill(TRIE_BYTES // 2):
        found.append((key, owner))
        held += len(key)
        if held > 8 << 20:
            yield from _owner_rows(found, with_content)
            found, held = [], 0
    yield from _owner_rows(found, with_content)


def _local_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = RadixTrie()
    for batch in batches:
        for part in slices(batch):
            for row, text in zip(part.column("id").to_pylist(), as_bytes(part.column("text")), strict=True):
                text = text or b""
                trie.insert(normalised(text), _code_points(text), row)
                if trie.size > TRIE_BYTES:
                    yield from _drained(trie, False, True)
    yield from _drained(trie, True, True)


def _merged_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = RadixTrie()
    for batch in batches:
        for part in slices(batch, "content"):
            for key, points, row, rows in zip(part.column("content").to_pylist(), part.column("points").to_pylist(), part.column("row").to_pylist(), part.column("rows").to_pylist(), strict=True):
                trie.insert(key, points, row, rows)
                if trie.size > TRIE_BYTES:
                    yield from _drained(trie, False, False)
    yield from _drained(trie, True, False)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = [normalised(t or b"") for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["id", "size", "digest"])


def owners(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per distinct normalised text: size, digest, points, row (the owner's id), rows."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    local = in_arrow(texts, _local_owners, _OWNERS)
    dealt = local.repartition(parallelism(docs.sparkSession), "size", F.xxhash64("digest"))
    partial = in_arrow(dealt, _merged_owners, _OWNERS)
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("row").isNull().alias("unnamed"), "row")).alias("best")
    return partial.groupBy("size", "digest").agg(best, F.sum("rows").alias("rows")).select("size", "digest", (-F.col("best.less")).alias("points"), F.col("best.row").alias("row"), "rows")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id_column, keep_id, group_size, kept, text_sha256. The owner has the most code points, then the smallest id."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    keys = in_arrow(texts, _keys, _KEYED)
    # joined by the hex digest, not by the aggregation's own keys: so the join has exchanges of its own, of which the
    # optimizer can split the one that a large group of copies makes uneven
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    owned = owners(docs, id_column, text_column).select(sha, "row", "rows")
    joined = keys.select("id", sha).join(owned.hint("merge"), "text_sha256")
    return joined.select(F.col("id").alias(id_column), F.col("row").alias("keep_id"), F.col("rows").alias("group_size"), F.col("id").eqNullSafe(F.col("row")).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that own their text, all columns as they were. Of rows that repeat an owner's id and text, one stays."""
    # nulls in a struct are equal, and rows that the join has dealt by the struct are not dealt again
    held = owners(docs, id_column, text_column).select(F.struct(F.col("row").alias("id"), F.lower(F.hex("digest")).alias("digest"), "points").alias("key"))
    text = F.col(text_column)
    key = F.struct(F.col(id_column).cast("long").alias("id"), sha256_of(text).alias("digest"), F.length(F.coalesce(text, F.lit(""))).alias("points"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(held, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def sha256_of(text: Column) -> Column:
    """The digest of exact_groups as a JVM expression, for joins from other tables."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES.decode(), "").cast("binary"), 256)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS rn, count(*) OVER (PARTITION BY norm) AS group_size FROM t
), k AS (SELECT norm, doc_id AS keep_id FROM o WHERE rn = 1)
SELECT o.doc_id, k.keep_id, o.group_size, o.doc_id = k.keep_id AS kept, sha256(o.norm) AS text_sha256 FROM o JOIN k USING (norm)
"""
