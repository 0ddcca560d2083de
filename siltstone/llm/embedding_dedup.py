"""Near-dedup of embeddings by a pivot-permutation index.

Reference points (pivots) are vectors of a bounded sample, farthest-first as long as they lie apart (cosine below SEPARATION),
then seeded random directions: pivots close to each other would be ranked by noise inside a dense cluster. Their number
grows with the rows of the largest label, from 64 up to 4096. A vector is described by its NEAREST pivots in order
of cosine, and stands in the inverted list of each. Two vectors that meet in a list are candidates if they share
SHARED pivots at least; candidates are verified by cosine in double precision. A pair counts in one list only, that of its
smallest shared pivot. Where lists would grow beyond LONG rows, they are kept for pairs of pivots instead, which find the same
candidates. A list of more than BLOCK vectors is cut into blocks, and each pair of blocks is a task's
own group, so that no list is held whole anywhere; a block pair gives each vector's number of links and a spanning
forest, not its pairs. `exact` compares all blocks of a label with each other instead, without pivots.

Vectors of one label that are equal in every component (copies) collapse to one class with a count; classes have numbers of
their own, so that rows which share an identifier but not their vector stay apart (they count as separate vectors, and links
of either are kept). Only vectors of equal, non-null label and of the same length are compared. Vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing. A component's identifier is the smallest of its members'; null identifiers count only if it has no other. Ties between pivots go to the
first. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, likely, model_of, parallelism, staged, table
from .components import components

LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
NEAREST, SHARED = 8, 2
#: Cosine that two pivots taken from the sample have at most.
SEPARATION = 0.7
#: Vectors that pivots are chosen from, for each pivot.
SAMPLE = 8
BLOCK, TILE, LONG = 1024, 256, 8192


def chosen_pivots(sample: np.ndarray, dimension: int, count: int) -> np.ndarray:
    """Unit vectors: farthest-first from the sample's rows as long as they lie apart, then seeded random directions."""
    chosen: list[np.ndarray] = []
    if len(sample):
        unit = _unit(sample)
        nearest = np.full(len(unit), -np.inf)
        at = 0
        while len(chosen) < count and (not chosen or nearest[at] < SEPARATION):
            chosen.append(unit[at])
            nearest = np.maximum(nearest, unit @ unit[at])
            at = int(nearest.argmin())
    rest = np.random.default_rng(dimension).normal(size=(count - len(chosen), dimension))
    return np.vstack([*chosen, _unit(rest)])


def permutations(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """int16[vectors, NEAREST]: the numbers of the nearest pivots, the nearest first."""
    near = unit @ pivots.T
    top = np.sort(np.argpartition(-near, NEAREST - 1, axis=1)[:, :NEAREST], axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int16)


def _rows(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the usable vectors, by length."""
    column = batch.column("vector")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = pc.list_flatten(column.take(pa.array(at)))
        matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls become NaN
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((matrix * matrix).sum(1))
        good = np.isfinite(matrix).all(1) & np.isfinite(norm) & (norm > 0)
        yield at[good], matrix[good].astype(kind)


_VALID = "id long, label string, vector binary, dimension int"


def _valid(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _rows(batch, kind):
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("label").take(rows), pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array(np.full(len(at), matrix.shape[1]), pa.int32())],
                    names=["id", "label", "vector", "dimension"],
                )

    return run


def _matrix(column: pa.Array, dimension: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dimension).astype(np.float64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _pivots(count: int, kind: type):
    """The pivots of each dimension in the sample."""

    def fit(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for vector, dimension in zip(batch.column("vector").to_pylist(), batch.column("dimension").to_pylist(), strict=True):
                held.setdefault(dimension, []).append(np.frombuffer(vector, kind).astype(np.float64))
        return {d: chosen_pivots(np.array(v), d, count).astype(np.float32) for d, v in held.items()}

    return fit


_DESCRIBED = "id long, label string, vector binary, dimension int, copies long, nearest binary"


def _describe(shared, count: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = {d: p.astype(np.float64) for d, p in pickle.loads(shared.value).items()}
        for batch in batches:
            dimensions = batch.column("dimension").to_numpy()
            for d in np.unique(dimensions).tolist():
                if d not in pivots:
                    pivots[d] = chosen_pivots(np.empty((0, d)), d, count)
                rows = np.flatnonzero(dimensions == d)
                for at in range(0, len(rows), 1024):
                    part = batch.take(pa.array(rows[at : at + 1024]))
                    nearest = permutations(_unit(_matrix(part.column("vector"), d, kind)), pivots[d])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in nearest], pa.binary())], names=[*part.schema.names, "nearest"])

    return run


def _lists(depth: int):
    """A row for each list that a vector stands in: of a pivot, or of a pair of pivots, the smaller one first."""
    places = np.array(list(combinations(range(NEAREST), depth)), np.int64).reshape(-1, depth) if depth else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                pivots = np.sort(np.frombuffer(b"".join(part.column("nearest").to_pylist()), np.int16).reshape(-1, NEAREST), axis=1).astype(np.int64)
                keys = (pivots[:, places] * (MOST_PIVOTS ** np.arange(depth))).sum(2) if depth else np.zeros((len(pivots), 1), np.int64)
                rows = pa.array(np.repeat(np.arange(len(pivots)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column("label").take(rows), part.column("dimension").take(rows), pa.array(keys.ravel()), part.column("id").take(rows)], names=["label", "dimension", "list", "id"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """The least row that each row reaches, of a symmetric boolean matrix."""
    name = np.arange(len(linked), dtype=np.int32)
    while True:
        least = np.where(linked, name[None, :], np.int32(len(name))).min(1)
        new = np.minimum(name, least)
        new = new[new]
        if (new == name).all():
            return name
        name = new


_FOUND = "id long, links long, other long"


def _shared_pivots(nearest: np.ndarray, key: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(a column for each pivot that several vectors have, the columns that make a pair belong to an earlier list)"""
    known, at, counts = np.unique(nearest, return_inverse=True, return_counts=True)
    has = np.zeros((len(nearest), len(known)), np.float32)
    has[np.arange(len(nearest))[:, None], at.reshape(nearest.shape)] = 1
    own = [key // MOST_PIVOTS**k % MOST_PIVOTS for k in range(depth)]
    several = counts > 1
    return has[:, several], has[:, several & (known < max(own)) & ~np.isin(known, own)]


def _compare(threshold: float, depth: int, kind: type):
    """Rows sorted by (label, dimension, list, first, second): one group at a time, of two blocks at most."""

    def compared(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(group).combine_chunks()
        ids, copies, block = (rows.column(c).to_numpy() for c in ("id", "copies", "own"))
        head = {c: rows.column(c)[0].as_py() for c in ("list", "first", "second", "dimension")}
        if len(ids) < 2:
            return None
        order = np.argsort(ids, kind="stable")
        ids, copies, block = ids[order], copies[order], block[order]
        unit = _unit(_matrix(rows.column("vector"), head["dimension"], kind)[order])
        if depth:
            has, earlier = _shared_pivots(np.frombuffer(b"".join(rows.column("nearest").to_pylist()), np.int16).reshape(len(ids), -1)[order], head["list"], depth)
        linked = np.zeros((len(ids), len(ids)), np.bool_)
        for at in range(0, len(ids), TILE):
            part = slice(at, at + TILE)
            if depth:
                candidate = has[part] @ has.T >= SHARED
                candidate &= earlier[part] @ earlier.T == 0
            else:
                candidate = np.ones((len(ids[part]), len(ids)), np.bool_)
            if head["first"] != head["second"]:
                candidate &= block[part, None] != block[None, :]
            some = np.flatnonzero(candidate.any(0))
            linked[part, some] = (unit[part] @ unit[some].T >= threshold) & candidate[:, some]
        linked |= linked.T  # a product may differ in its last bit with its tile
        np.fill_diagonal(linked, False)
        some = linked.any(1)
        if not some.any():
            return None
        least = _forest(linked)
        links = np.array([copies[row].sum() for row in linked[some]], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links), pa.array(ids[least[some]])], names=["id", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("list", "first", "second", "dimension")
            values = [batch.column(c).to_numpy() for c in names]
            labels = pc.dictionary_encode(batch.column("label"))
            codes, known = labels.indices.to_numpy(), labels.dictionary.to_pylist()
            new = np.ones(batch.num_rows, np.bool_)
            new[1:] = np.any([v[1:] != v[:-1] for v in [*values, codes]], axis=0)
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = (known[codes[a]], *(v[a] for v in values))
                if key != last and held:
                    found = compared(held)
                    if found is not None:
                        yield found
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            found = compared(held)
            if found is not None:
                yield found

    return run


def embedding_groups(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = 0.98, exact: bool = False
) -> DataFrame:
    """One row per input row: id_column, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = np.float32 if dict(vectors.dtypes)[vector_column] == "array<float>" else np.float64  # as they travel; products are of doubles
    named = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    valid = in_arrow(named.filter("label IS NOT NULL"), _valid(kind), _VALID)
    keyed = staged(valid.withColumn("hash_a", F.xxhash64("vector")).withColumn("hash_b", F.xxhash64(F.lit(7), "vector")), "vectors")
    content = ["label", "dimension", "hash_a", "hash_b"]
    counted = keyed.groupBy(*content).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = staged(counted.withColumn("class", F.monotonically_increasing_id()), "classes")

    largest = classes.groupBy("label", "dimension").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    pivots = LEAST_PIVOTS
    while pivots < MOST_PIVOTS and pivots * BLOCK < (largest[0] or 0) * NEAREST * 2:
        pivots *= 2
    depth = 0 if exact else 1 if (largest[0] or 0) * NEAREST <= LONG * pivots else 2
    # a sample of fixed size, the same however the rows are dealt
    first = classes.filter(likely(F.col("hash_a"), SAMPLE * pivots, largest[1] or 0)).orderBy("hash_a", "hash_b", "label").limit(SAMPLE * pivots)
    shared = model_of(first.select("dimension", "vector", "hash_a"), ["dimension", "hash_a", "vector"], _pivots(pivots, kind), dict)
    own = classes.select(F.col("class").alias("id"), "label", "vector", "dimension", "copies")
    described = staged(in_arrow(own, _describe(shared, pivots, kind), _DESCRIBED), "described")

    lists = in_arrow(described.select("id", "label", "dimension", "nearest"), _lists(depth), "label string, dimension int, list long, id long")
    key = ["label", "dimension", "list"]
    sizes = lists.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = lists.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    paired = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(*key, F.least("own", "with").alias("first"), F.greatest("own", "with").alias("second"), "own", "id")
    full = paired.join(described.select("id", "vector", "copies", "nearest"), "id")
    group = [*key, "first", "second"]
    dealt = full.repartition(parallelism(spark), *group).sortWithinPartitions(*group)
    found = staged(in_arrow(dealt, _compare(threshold, depth, kind), _FOUND), "found")

    links = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("links"))
    reached = components(found.filter("id <> other").select(F.col("id").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "class")
    placed = classes.drop("vector").join(links, "class", "left").join(reached, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = placed.join(least, "component").select(*content, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    grouped = keyed.select("id", *content).join(per_class, content).select("id", "n_links", "component_id")
    usable = _usable(F.col("vector")) & F.col("label").isNotNull()
    alone = named.filter(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return grouped.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _usable(vector):
    """As _rows decides, in the JVM: finite components and a finite norm above zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & (norm > 0) & (norm < F.lit(float("inf")))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
l AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT e.vec_id, coalesce(l.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN l ON l.u = e.vec_id JOIN c ON c.id = e.vec_id
"""
