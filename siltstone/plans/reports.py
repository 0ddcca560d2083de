"""The three reports of a scan and the manifest's order, as DataFrames with their final columns.

Column names and their order are fixed values. Nulls become empty fields when they are written (store.write_report).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import iso_time, sparse_flag
from ..operators import duplicates
from ..operators.pathaudit import PathPolicy

#: What each report is sorted by.
ALL_FILES_ORDER = ["path", "id"]
DUPLICATES_ORDER = ["duplicate_group", "path", "id"]


def _hex(files: DataFrame) -> Column:
    return F.lower(F.hex(F.col("path_raw") if "path_raw" in files.columns else F.col("path").cast("binary")))


def _yes(test: Column) -> Column:
    return F.when(test, "yes").otherwise("no")


def _of_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select("root_id", F.col("root").alias("root")), "root_id")


def all_files(files: DataFrame, roots: DataFrame, scan_id: str) -> DataFrame:
    """Every file of a scan, and its id to sort by."""
    rows = _of_roots(files, roots)
    return rows.select(
        F.lit(scan_id).alias("scan_id"), "root", "path", _hex(rows).alias("path_bytes_hex"), F.col("size_bytes").alias("apparent_size_bytes"), F.col("allocated_bytes").alias("allocated_size_bytes"),
        F.coalesce(sparse_flag(F.col("allocated_bytes"), F.col("size_bytes")), F.lit("no")).alias("sparse"), iso_time(F.col("mtime_ns")).alias("mtime_utc"), iso_time(F.col("ctime_ns")).alias("ctime_utc"),
        F.col("digest").alias("hash"), F.col("sample_digest").alias("sample_hash"), "algorithm", "status", "error", F.col("bytes_read").alias("logical_bytes_read"),
        F.format_string("%.6f", F.col("elapsed_seconds")).alias("elapsed_seconds"), "device", "inode", "management_class", "classification_confidence", "classification_reason", "cleanup_risk", "reused_from_file_id", "id",
    )


def duplicate_paths(files: DataFrame, roots: DataFrame, algorithm: str, empty_policy: str = "count") -> DataFrame:
    """Every path of every duplicate group, and its id to sort by."""
    chosen = duplicates.eligible(files, empty_policy)
    found = duplicates.groups(chosen)
    rows = _of_roots(chosen.join(found, duplicates.CONTENT), roots)
    alias_only = F.col("physical_copy_count") == 1
    return rows.select(
        F.col("group_number").alias("duplicate_group"), F.when(alias_only, "hardlink_aliases").otherwise("physical_duplicates").alias("group_kind"),
        F.when(alias_only | (F.col("size_bytes") == 0), "no").otherwise("review").alias("cleanup_candidate"), F.lit(algorithm).alias("algorithm"), F.col("digest").alias("hash"),
        F.col("size_bytes").alias("apparent_size_bytes"), "path_count", "physical_copy_count", "logical_duplicate_bytes", F.col("total_allocated_bytes").alias("total_unique_allocated_bytes"),
        F.col("reclaimable_min_bytes").alias("estimated_reclaimable_min_bytes"), F.col("reclaimable_max_bytes").alias("estimated_reclaimable_max_bytes"),
        _yes(F.col("contains_sparse") > 0).alias("contains_sparse_file"), _yes(alias_only).alias("same_physical_file_only"), F.col("group_risk").alias("group_cleanup_risk"), "root", "path", _hex(rows).alias("path_bytes_hex"),
        F.col("allocated_bytes").alias("allocated_size_bytes"), "device", "inode", iso_time(F.col("mtime_ns")).alias("mtime_utc"), iso_time(F.col("ctime_ns")).alias("ctime_utc"),
        "management_class", "classification_confidence", "classification_reason", "cleanup_risk", "id",
    )


def path_findings(found: DataFrame, items: DataFrame, roots: DataFrame, scan_id: str, policy: PathPolicy) -> DataFrame:
    """Findings of a path audit with the items they are of (id, root_id, scanned_path) and the limits, and the id to sort by."""
    rows = _of_roots(found.join(items.select("id", "root_id", "scanned_path", *(["path_raw"] if "path_raw" in items.columns else [])), "id").withColumn("path", F.col("scanned_path")), roots)
    utf16 = lambda c: (F.length(F.encode(F.col(c), "UTF-16LE")) / 2).cast("int")
    limit = lambda n, name: F.lit(n).alias(name)
    return rows.select(
        F.lit(scan_id).alias("scan_id"), "severity", "issue_codes", "item_type", "root", F.col("relative_path").alias("relative_windows_path"), "scanned_path", _hex(rows).alias("path_bytes_hex"),
        utf16("scanned_path").alias("actual_scanned_path_chars"), utf16("relative_path").alias("relative_path_chars"), limit(policy.prefix, "windows_prefix_length"),
        F.col("projected_chars").alias("projected_windows_path_chars"), limit(policy.warning, "path_warning_chars"), limit(policy.office, "office_path_limit"), limit(policy.hard, "hard_path_limit"),
        "name_chars", limit(policy.filename, "filename_limit"), "longest_directory_name", "longest_directory_chars", limit(policy.directory, "directory_name_limit"),
        F.col("over_hard_limit").alias("characters_over_hard_limit"), "recommendation", "id",
    )


def findings_order() -> list[Column]:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    return [rank, F.desc("projected_windows_path_chars"), F.col("scanned_path"), F.col("id")]
