"""Near-dedup of texts by SetSketch registers.

A text's set is its distinct five-word shingles (A-Z lower-cased, words between ASCII spaces; a shorter text is one
shingle). Each of 192 registers holds floor(1 - log_b(least exponential draw of its shingles)), truncated to 0..q+1: the
registers of a union are the maxima, so sketches merge, and two sets agree in a register with a chance that grows with
their Jaccard similarity. Six registers make a band; texts with an equal band meet in a bucket. A pair is dropped
without its texts only where the joint likelihood of (greater, smaller, equal) registers at the threshold is e^-12.5
of its maximum or less, or where set sizes alone forbid it; all others are confirmed on the full sets, a shingle being
a 64-bit hash of its words. Two sets of n shingles hold a pair of different shingles with one hash with a chance below n^2 / 2^64, that is 2e-11 for texts of
20,000 words; one such pair changes an intersection by one.

Texts of one set (copies) collapse to a class first; classes have numbers of their own, so that rows which share an identifier but not their set stay
apart. A class is compared with the first members of its buckets, the four that it shares most bands with. Where a bucket then still holds members of different components, those are compared with each
other by their registers: the members of the bucket's largest component form blocks of their own, which meet only the blocks of the rest, so that a stray
member costs a bucket's length and not its square. In blocks of 512, each pair of blocks a task's own group, so that neither is a bucket held
whole nor are its pairs made; pairs that may link leave a block as lists, once, from the first band they share, and are
verified in blocks too: a text is sent to a block, not to a partner. So no pair
that shares a band is left out unless it is in one component already. At similarity 0.85 a pair shares none of 32 bands of 6 with a
chance of 3e-7.

Nulls and texts without words have an empty set and link with nothing. Repeated identifiers count as copies of each other
only if their sets are equal. A component's identifier is the smallest of its members'; null identifiers count only if it has no other. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, hashed_words, in_arrow, mix, parallelism, slices, staged, table, windows
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 6
BASE, RATE, MOST = 1.001, 20.0, (1 << 16) - 2
#: Natural logarithm of the likelihood ratio beyond which an estimate rules a pair out: five standard deviations.
RULED_OUT = 12.5
MEMBERS = 64
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Smallest members of its buckets that a text is compared with at first; what that leaves apart is compared in blocks.
LEADERS = 4
_U = np.uint64


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def registers(shingles: np.ndarray, at: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """uint16[texts, count]; texts without shingles have zeros."""
    full = np.flatnonzero(np.diff(at))
    least = np.full((len(at) - 1, count), np.iinfo(_U).max, _U)
    multipliers, i = _multipliers(count), 0
    with np.errstate(over="ignore"):
        while i < len(full):  # blocks that stay in the processor's cache
            j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + 32768)))
            block = shingles[at[full[i]] : at[full[j - 1] + 1]]
            starts = at[full[i:j]] - at[full[i]]
            for k in range(count):
                least[full[i:j], k] = np.minimum.reduceat(block * multipliers[k], starts)
            i = j
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    values = np.floor(1.0 - np.log(np.maximum(draw, 1e-300)) / np.log(BASE))
    out = np.clip(values, 0, MOST + 1).astype(np.uint16)
    out[np.diff(at) == 0] = 0
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """int64[texts, bands]"""
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=_U)[None, :] * _U(0xC2B2AE3D27D4EB4F)
        key = np.repeat(key, len(values), axis=0)
        for r in range(rows):
            key = mix(key ^ (values[:, r::rows][:, :bands].astype(_U) + _U(r + 1) * _U(0x165667B19E3779F9)))
    return key.view(np.int64)


def _chance(x: np.ndarray) -> np.ndarray:
    """-log_b(1 - x (b - 1) / b): the chance that one sketch's register is greater, x being that set's own share of the union's draws."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, u: np.ndarray, greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of similarity j, set a holding the share u of |a| + |b|, given the counts of registers."""
    v = 1 - u
    up, down = _chance(u - v * j), _chance(v - u * j)
    tiny = 1e-12
    return greater * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))


_GRID = np.linspace(0.0, 1.0, 65)


def estimated(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity on a grid, whether the pair may still reach the threshold)."""
    greater, smaller = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - greater - smaller
    u = (size_a / (size_a + size_b))[:, None]
    top = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    grid = log_likelihood(_GRID[None, :] * top[:, None], u, greater, smaller, equal)
    best = grid.argmax(1)
    likeliest = _GRID[best] * top
    at = log_likelihood(np.minimum(threshold, top)[:, None], u, greater, smaller, equal)[:, 0]
    may = (likeliest >= threshold) | (grid.max(1) - at < RULED_OUT)
    return likeliest, may & (top >= threshold - 1e-12)


def shingle_sets(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, start of each text's; one more start at the end)"""
    words, at = hashed_words(texts)
    shingles, at = windows(words, at, shingle)
    for i in range(len(at) - 1):
        shingles[at[i] : at[i + 1]].sort()
    new = np.ones(len(shingles), np.bool_)
    new[1:] = shingles[1:] != shingles[:-1]
    new[at[:-1][at[:-1] < len(shingles)]] = True
    return shingles[new], np.concatenate(([0], np.cumsum(new)))[at]


_SKETCH = "id long, mark long, n_shingles long, set_a long, set_b long, registers binary, bands array<long>"


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shingles, at = shingle_sets(as_bytes(part.column("text")), shingle)
                count = np.diff(at)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate(([_U(0)], np.cumsum(mix(shingles ^ _U(salt))))) for salt in (0x1234567, 0x89ABCDEF1)]
                    set_a, set_b = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                values = registers(shingles, at)
                keys = band_keys(values)
                empty = count == 0
                offsets = np.concatenate(([0], np.cumsum(np.where(empty, 0, BANDS)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("mark"),
                        pa.array(count, pa.int64()),
                        pa.array(set_a),
                        pa.array(set_b),
                        pa.array([r.tobytes() for r in values], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[~empty].ravel())),
                    ],
                    names=["id", "mark", "n_shingles", "set_a", "set_b", "registers", "bands"],
                )

    return run


def _may_link(threshold: float):
    """Keeps pairs that the sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, -1) for c in ("registers_a", "registers_b"))
                size_a, size_b = (part.column(c).to_numpy().astype(np.float64) for c in ("size_a", "size_b"))
                _, may = estimated(a, b, size_a, size_b, threshold)
                yield part.select(["a", "b"]).filter(pa.array(may))

    return run


_CROSS = "key long, first int, second int, own int, id long, component long, block long, n_shingles long, registers binary"
_LISTS = "x long, y long, a array<long>, b array<long>, ids array<long>, components array<long>"


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, of rows sorted by keys."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy() for c in keys]
        new = np.ones(batch.num_rows, np.bool_)
        new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
        starts = np.flatnonzero(new)
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(v[lo] for v in values)
            if key != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _across(threshold: float):
    """Rows sorted by (key, first, second): pairs of one group that are in different components and may link, one row of lists for each pair of blocks that verifies them."""

    def compared(rows: pa.Table) -> pa.RecordBatch | None:
        ids, components_, own, block, sizes = (rows.column(c).to_numpy() for c in ("id", "component", "own", "block", "n_shingles"))
        if len(ids) < 2 or (components_ == components_[0]).all():
            return None
        order = np.argsort(ids, kind="stable")
        ids, components_, own, block, sizes = ids[order], components_[order], own[order], block[order], sizes[order].astype(np.float64)
        values = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(len(ids), -1)[order]
        one_block = rows.column("first")[0].as_py() == rows.column("second")[0].as_py()
        a_all, b_all = [], []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            ok = (components_[j] != components_[i]) & (np.minimum(sizes[j], sizes[i]) >= (threshold - 1e-12) * np.maximum(sizes[j], sizes[i]))
            if not one_block:
                ok &= own[j] != own[i]
            j = j[ok]
            if len(j):
                same = (values[j] == values[i]).mean(1) > threshold - 0.35  # far below what the likelihood would rule out
                j = j[same]
            if len(j):
                _, may = estimated(np.repeat(values[i : i + 1], len(j), 0), values[j], np.full(len(j), sizes[i]), sizes[j], threshold)
                j = j[may]
            if len(j):
                # from the first shared band only; a band is ROWS neighbouring registers
                shared = (values[j] == values[i]).reshape(len(j), BANDS, ROWS).all(2)
                first = band_keys(values[i : i + 1])[0][shared.argmax(1)]
                j = j[first == rows.column("key")[0].as_py()]
                a_all.append(np.full(len(j), i))
                b_all.append(j)
        if not sum(map(len, a_all)):
            return None
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        x, y = np.minimum(block[a], block[b]), np.maximum(block[a], block[b])
        made: dict = {c: [] for c in ("x", "y", "a", "b", "ids", "components")}
        order = np.lexsort((y, x))
        ends = np.flatnonzero(np.diff(x[order]) | np.diff(y[order])) + 1
        for of in np.split(order, ends):
            texts = np.union1d(a[of], b[of])
            for c, v in zip(made, (x[of[0]], y[of[0]], ids[a[of]], ids[b[of]], ids[texts], components_[texts]), strict=True):
                made[c].append(v)
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c in "xy" else lists) for c, v in made.items()], names=list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ("key", "first", "second")):
            found = compared(rows)
            if found is not None:
                yield found

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shingles, at = shingle_sets(as_bytes(part.column("text")), shingle)
                held = [shingles[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(held, pa.binary())], names=["id", "hashes"])

    return run


_VERIFY = "x long, y long, a array<long>, b array<long>, id long, component long, hashes binary"
TOGETHER = 32


def _united(percent: int):
    """Rows sorted by (x, y): the pairs of two blocks, and the components and sets of their texts. Gives links of components to the least that they are united with here."""

    def united(rows: pa.Table) -> pa.RecordBatch:
        is_text = pc.is_valid(rows.column("id"))
        texts, lists = rows.filter(is_text), rows.filter(pc.invert(is_text))
        sets = {i: np.frombuffer(h, _U) for i, h in zip(texts.column("id").to_pylist(), texts.column("hashes").to_pylist(), strict=True)}
        component = dict(zip(texts.column("id").to_pylist(), texts.column("component").to_pylist(), strict=True))
        parent = {c: c for c in component.values()}

        def root(i: int) -> int:
            c = component[i]
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = (np.concatenate([v.values.to_numpy() for v in lists.column(c)]) for c in ("a", "b"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for of in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
            i = int(a[of[0]])
            own, others = sets[i], b[of].tolist()
            for at in range(0, len(others), TOGETHER):
                some = [j for j in others[at : at + TOGETHER] if root(j) != root(i)]
                if not some:
                    continue
                sizes = np.array([len(sets[j]) for j in some])
                joined = np.concatenate([sets[j] for j in some])
                shared = np.add.reduceat(_shared(own, joined), np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
                for j in np.array(some)[100 * shared >= percent * (len(own) + sizes - shared)].tolist():
                    low, high = sorted((root(i), root(j)))
                    parent[high] = low
        links = {component[i]: root(i) for i in component}
        links = {c: least for c, least in links.items() if c != least}
        return pa.RecordBatch.from_arrays([pa.array(links.keys(), pa.int64()), pa.array(links.values(), pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ("x", "y")):
            yield united(rows)

    return run


def _shared(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of others are in the sorted, non-empty own."""
    return own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others


def _confirm(shingle: int, percent: int):
    """Rows sorted by (leader, salt, role): the leader's text, then its members'. Holds one leader's set and a slice of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader = None, np.empty(0, _U)
        for batch in batches:
            for part in slices(batch):
                a, b = [], []
                shingles, at = shingle_sets(as_bytes(part.column("text")), shingle)
                for i, (lead, salt, member) in enumerate(zip(*(part.column(c).to_pylist() for c in ("leader", "salt", "id")), strict=True)):
                    own = shingles[at[i] : at[i + 1]]
                    if member == lead:
                        key, leader = (lead, salt), own.copy()
                    elif key == (lead, salt):
                        shared = int(_shared(leader, own).sum()) if len(leader) else 0
                        if shared and 100 * shared >= percent * (len(leader) + len(own) - shared):
                            a.append(lead)
                            b.append(member)
                    else:
                        raise ValueError(f"the text of {lead} is missing")
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return run


class _Linker:
    """Confirms candidate pairs of class representatives on their texts."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, shingle: int, percent: int):
        self.texts, self.shingle, self.percent = texts, shingle, percent
        self.sides = sketches.select("id", "registers", "n_shingles")
        self.partitions = parallelism(texts.sparkSession)

    def plausible(self, pairs: DataFrame) -> DataFrame:
        a = self.sides.select(F.col("id").alias("a"), F.col("registers").alias("registers_a"), F.col("n_shingles").alias("size_a"))
        b = self.sides.select(F.col("id").alias("b"), F.col("registers").alias("registers_b"), F.col("n_shingles").alias("size_b"))
        both = pairs.join(a, "a").join(b, "b").filter(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * self.percent)
        return in_arrow(both, _may_link(self.percent / 100), "a long, b long")

    def united(self, lists: DataFrame) -> DataFrame:
        """Of lists of pairs, links that unite components: of their names."""
        columns = [F.col(c.split()[0]).cast(c.split(" ", 1)[1]) for c in _VERIFY.split(", ")]
        met = lists.select("x", "y", F.inline(F.arrays_zip("ids", "components")).alias("id", "component")).distinct()
        sets = in_arrow(self.texts.join(met.select("id").distinct(), "id").select("id", "text"), _sets(self.shingle), "id long, hashes binary")
        rows = met.join(sets, "id").unionByName(lists.drop("ids", "components"), allowMissingColumns=True).select(*columns)
        dealt = rows.repartition(self.partitions, "x", "y").sortWithinPartitions("x", "y")
        return in_arrow(dealt, _united(self.percent), "u long, v long")

    def links(self, pairs: DataFrame, tag: str) -> DataFrame:
        """a: leader, b: member. A leader of many is dealt to several tasks, each with its text."""
        pairs = staged(pairs, f"{tag}-pairs")
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")).select("a", "parts")
        salted = pairs.join(many, "a").select(F.col("a").alias("leader"), F.col("b").alias("id"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"))
        leads = salted.select("leader", F.col("leader").alias("id"), "salt").distinct()
        wanted = salted.unionByName(leads)
        rows = wanted.join(self.texts, "id").select("leader", "salt", "id", "text")
        dealt = rows.repartition(self.partitions, "leader", "salt").sortWithinPartitions("leader", "salt", F.col("id") != F.col("leader"))
        return staged(in_arrow(dealt, _confirm(self.shingle, self.percent), "u long, v long"), f"{tag}-links")


_CONTENT = ["set_a", "set_b", "n_shingles"]


def _marked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))


def _classes(docs: DataFrame, id_column: str, text_column: str, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(sketches: id, mark, the set; classes: the set, head (id and mark of a row of it), component)"""
    texts = _marked(docs, id_column, text_column)
    sketches = staged(in_arrow(texts, _sketch(shingle), _SKETCH), "sketches")
    sets = sketches.filter("n_shingles > 0").groupBy(*_CONTENT).agg(F.min(_head()).alias("head"))
    sets = staged(sets.withColumn("class", F.monotonically_increasing_id()), "sets")
    heads = sets.select(F.col("class"), *_CONTENT, F.col("head.id").alias("head_id"), F.col("head.mark").alias("mark"))
    # the identifier is a key of this join, so that copies of one text are not dealt to one task
    first = sketches.join(heads.select("class", F.col("head_id").alias("id"), *_CONTENT).alias("h"), [sketches[c] == F.col(f"h.{c}") for c in _CONTENT] + [sketches["id"].eqNullSafe(F.col("h.id"))])
    first = first.select(F.col("class").alias("id"), sketches["n_shingles"], "registers", "bands").dropDuplicates(["id"])
    banded = first.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader")
    members = staged(banded.join(buckets, "key").select("key", "leader", "id"), "members")

    # only texts that share a bucket are read again, and written once
    near = members.select("id").distinct()
    wanted = heads.join(near.withColumnRenamed("id", "class"), "class").select("class", "head_id", "mark")
    held = texts.join(wanted, texts["id"].eqNullSafe(wanted["head_id"]) & (texts["mark"] == wanted["mark"])).select(F.col("class").alias("id"), "text")
    held = staged(held.dropDuplicates(["id"]), "texts")
    linker = _Linker(held, first.join(near, "id", "left_semi"), shingle, percent)
    shared = members.filter("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("bands"))
    nearest = Window.partitionBy("b").orderBy(F.desc("bands"), "a")
    likely = shared.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= LEADERS).select("a", "b")
    direct = linker.links(linker.plausible(likely), "direct")
    named = components(direct)

    # buckets that still hold several components: blocks of the largest one first, then of the rest
    placed = members.join(named, "id", "left").select("key", "leader", "id", F.coalesce("component", "id").alias("component"))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    mixed = mixed.select("key", F.col("most.component").alias("main"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("rests"))
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("id"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("id"), "rests")).cast("int")
    least_other = F.when(is_main, F.col("mains")).otherwise(0)  # a block of the largest component meets none of its own
    still = placed.join(mixed, "key").select("key", "leader", "id", "component", own.alias("own"), least_other.alias("from"), (F.col("mains") + F.col("rests") - 1).alias("to"))
    still = staged(still, "still")
    # texts that meet in many buckets are verified together, in blocks of the smallest leader of those buckets: whose it is only decides where a pair is verified
    homes = staged(still.groupBy("id", "component").agg(F.min("leader").alias("home")).join(linker.sides, "id"), "homes")
    parts = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).alias("parts"))
    homes = homes.join(parts, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("id", F.lit("block")), "parts"))).drop("home", "parts")
    paired = still.withColumn("with", F.explode(F.sequence("from", "to")))
    paired = paired.select("key", F.least("own", "with").alias("first"), F.greatest("own", "with").alias("second"), "own", "id")
    full = paired.join(homes, "id").select(*[c.split()[0] for c in _CROSS.split(", ")])
    dealt = full.repartition(linker.partitions, "key", "first", "second").sortWithinPartitions("key", "first", "second")
    lists = staged(in_arrow(dealt, _across(percent / 100), _LISTS), "lists")
    # stars of stars: first the components that the leaders make, then what unites those
    last = components(linker.united(lists)).select(F.col("id").alias("component"), F.col("component").alias("last"))
    found = sets.join(named.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    classes = found.join(last, "component", "left").select(*_CONTENT, "head", F.coalesce("last", "component").alias("component"))
    return sketches.select("id", "mark", *_CONTENT), classes


def _head():
    """Of several rows the one of smallest identifier, null the last, then of smallest text hash."""
    return F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id_column, n_shingles, component_id, kept."""
    sketches, classes = _classes(docs, id_column, text_column, percent, shingle)
    least = classes.groupBy("component").agg(F.min("head").alias("least")).select("component", F.col("least.id").alias("component_id"))
    out = sketches.join(classes.join(least, "component").select(*_CONTENT, "component_id"), _CONTENT, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that are first in their group, and all without words, with their columns. Rows are told apart by identifier and text; those that repeat both stay together."""
    sketches, classes = _classes(docs, id_column, text_column, percent, shingle)
    least = classes.groupBy("component").agg(F.min("head").alias("least"))
    grouped = sketches.filter("n_shingles > 0").join(classes.join(least, "component").select(*_CONTENT, "least"), _CONTENT)
    dropped = grouped.filter(~(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("mark") == F.col("least.mark")))).select("id", "mark").distinct().alias("dropped")
    same = F.col(f"docs.{id_column}").cast("long").eqNullSafe(F.col("dropped.id")) & (F.xxhash64(F.col(f"docs.{text_column}").cast("string")) == F.col("dropped.mark"))
    return docs.alias("docs").join(dropped, same, "left_anti")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


#: Pairs of documents that share a shingle are joined; links are closed by recursion.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
f AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g, lead(w, 4) OVER o AS fifth FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, g FROM f WHERE fifth IS NOT NULL OR i = 1),
s AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
p AS (SELECT u, v FROM i JOIN s x ON x.doc_id = u JOIN s y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON m.id = doc_id
"""
