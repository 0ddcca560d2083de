"""Reuse of earlier hashes: resumed scans, hard links, earlier scans; snapshots by upsert and sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What must be unchanged, and statuses whose hash may be used again.
IDENTITY = ["size_bytes", "mtime_ns", "ctime_ns", "device", "inode"]
REUSABLE = ["ok", "empty", "empty_ignored", "empty_reported", "reused"]


def incremental(current: DataFrame, previous: DataFrame, algorithm: str = "sha256", policy: str = "metadata") -> DataFrame:
    """Current files with `action`: reused (the digest of the earlier row of that path, if nothing changed) or hash.

    policy: metadata trusts the identity; sampled also needs equal, known sample digests on both sides (empty files need none); strict reuses nothing."""
    usable = previous.filter(F.col("status").isin(REUSABLE) & (F.col("algorithm") == algorithm))
    earlier = usable.select("path", *[F.col(c).alias(f"old_{c}") for c in IDENTITY], F.col("digest").alias("old_digest"), *([F.col("sample_digest").alias("old_sample")] if policy == "sampled" else []))
    same = F.col("old_digest").isNotNull()
    for c in IDENTITY:
        same = same & (F.col(c) == F.col(f"old_{c}"))
    if policy == "sampled":
        same = same & ((F.col("size_bytes") == 0) | ((F.col("sample_digest") != "") & (F.col("sample_digest") == F.col("old_sample"))))
    if policy == "strict":
        same = F.lit(False)
    same = F.coalesce(same, F.lit(False))
    joined = current.join(earlier, "path", "left")
    return joined.select(*current.columns, F.when(same, "reused").otherwise("hash").alias("action"), F.when(same, F.col("old_digest")).alias("reused_digest"))


def resumed(walked: DataFrame, partial: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the interrupted scan that still hold, walked files left to hash)"""
    key = ["path", *IDENTITY]
    done = partial.filter(F.col("status").isin(REUSABLE))
    return done.join(walked.select(*key), key, "left_semi"), walked.join(done.select(*key), key, "left_anti")


def swept(rows: DataFrame, generation: int) -> DataFrame:
    return rows.filter(F.col("seen_generation") == generation)


def hard_links(files: DataFrame) -> DataFrame:
    """status `ok` for the first path of each linked identity, which is hashed, and `reused` for the others."""
    order = Window.partitionBy(*IDENTITY).orderBy("path", "id")
    first = F.first("id").over(order)
    linked = files.filter("nlink > 1").withColumn("first_id", first)
    alone = files.filter("NOT (nlink > 1)").withColumn("first_id", F.col("id"))
    return linked.unionByName(alone).withColumn("link_status", F.when(F.col("first_id") == F.col("id"), "ok").otherwise("reused"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str = "seen_generation") -> DataFrame:
    """The latest row of each key; of equal versions the new one, then the greatest."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[c for c in old.columns])
    return both.groupBy(*keys).agg(F.max(F.struct(version, "_new", row.alias("row"))).alias("best")).select("best.row.*")


def assembled(reused: DataFrame, hashed: DataFrame, generation: int) -> DataFrame:
    """Rows of a snapshot: reused ones, which read no bytes in this scan, and those hashed now, all seen in this generation."""
    again = reused.withColumn("status", F.lit("reused")).withColumn("bytes_read", F.lit(0).cast("long")).withColumn("elapsed_seconds", F.lit(0.0))
    return again.unionByName(hashed, allowMissingColumns=True).withColumn("seen_generation", F.lit(generation))
