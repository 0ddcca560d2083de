"""Duplicate groups of an inventory: physical copies, groups, summary, detail rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import risk_of_rank, risk_rank, sparse_flag

CONTENT = ["digest", "size_bytes"]


def eligible(files: DataFrame, empty_policy: str = "count") -> DataFrame:
    """Rows that take part in duplicate reports; hashes of empty files only under the policy `report`."""
    statuses = ["ok", "reused"] + (["empty_reported"] if empty_policy == "report" else [])
    return files.filter(F.col("status").isin(statuses) & (F.col("digest") != ""))


def physical_copies(files: DataFrame) -> DataFrame:
    """One row per (digest, size, device, inode)."""
    return files.groupBy(*CONTENT, "device", "inode").agg(
        F.max(F.coalesce("allocated_bytes", F.lit(0))).alias("allocated_bytes"), F.max(F.when(F.col("allocated_bytes") < F.col("size_bytes"), 1).otherwise(0)).alias("is_sparse")
    )


def groups(files: DataFrame) -> DataFrame:
    """One row per content with several paths. Both aggregations group by the content, so paths and physical copies meet
    in one partitioning; the numbering runs over groups, not files."""
    # paths of a physical copy are counted before the content is: one exchange by content serves both statistics
    copies = files.groupBy(*CONTENT, "device", "inode").agg(
        F.max(F.coalesce("allocated_bytes", F.lit(0))).alias("allocated"),
        F.max(F.when(F.col("allocated_bytes") < F.col("size_bytes"), 1).otherwise(0)).alias("sparse"),
        F.count("*").alias("paths"),
        F.max(risk_rank(F.col("cleanup_risk"))).alias("rank"),
    )
    found = copies.groupBy(*CONTENT).agg(
        F.sum("paths").alias("path_count"),
        F.count("*").alias("physical_copy_count"),
        F.sum("allocated").alias("total_allocated"),
        F.max("allocated").alias("largest"),
        F.min("allocated").alias("smallest"),
        F.max("sparse").alias("contains_sparse"),
        F.max("rank").alias("max_rank"),
    ).filter("path_count > 1")
    order = Window.orderBy(F.desc("size_bytes"), F.desc("path_count"), "digest")
    return found.select(
        F.row_number().over(order).cast("long").alias("group_number"),
        *CONTENT,
        "path_count",
        "physical_copy_count",
        (F.col("size_bytes") * (F.col("path_count") - 1)).alias("logical_duplicate_bytes"),
        F.col("total_allocated").alias("total_allocated_bytes"),
        (F.col("total_allocated") - F.col("largest")).alias("reclaimable_min_bytes"),
        (F.col("total_allocated") - F.col("smallest")).alias("reclaimable_max_bytes"),
        "contains_sparse",
        risk_of_rank(F.col("max_rank")).alias("group_risk"),
    )


def summary(found: DataFrame) -> DataFrame:
    cleanup = (F.col("physical_copy_count") > 1) & (F.col("size_bytes") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg(
        F.count("*").alias("groups"),
        total(F.when(cleanup, 1).otherwise(0)).alias("cleanup_groups"),
        total(F.when(F.col("physical_copy_count") == 1, 1).otherwise(0)).alias("hardlink_only_groups"),
        total("path_count").alias("duplicate_paths"),
        total("logical_duplicate_bytes").alias("logical_duplicate_bytes"),
        total("reclaimable_min_bytes").alias("reclaimable_min_bytes"),
        total("reclaimable_max_bytes").alias("reclaimable_max_bytes"),
        total("contains_sparse").alias("sparse_groups"),
    )


def detail(files: DataFrame, found: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Every path of every group; a common content may hold many of the files, so the join is left to the optimizer."""
    kind = F.when(F.col("physical_copy_count") == 1, "hardlink_aliases").otherwise("physical_duplicates")
    candidate = F.when((F.col("physical_copy_count") == 1) | (F.col("size_bytes") == 0), "no").otherwise("review")
    rows = files.join(found, CONTENT)
    if roots is not None:
        rows = rows.join(roots, "root_id")
    return rows.select(
        "group_number",
        kind.alias("group_kind"),
        candidate.alias("cleanup_candidate"),
        "id",
        "path",
        *CONTENT,
        "path_count",
        "physical_copy_count",
        "group_risk",
        "cleanup_risk",
        sparse_flag(F.col("allocated_bytes"), F.col("size_bytes")).alias("sparse"),
        *(["root"] if roots is not None else []),
    )


def status_counters(files: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return files.agg(
        F.count("*").alias("examined"),
        n("ok").alias("hashed"),
        n("reused").alias("reused"),
        n("empty", "empty_reported").alias("empty"),
        n("changed").alias("changed"),
        n("cancelled").alias("cancelled"),
        n("error").alias("errors"),
    )
