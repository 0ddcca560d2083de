"""Snapshots, their fingerprint, and CSV reports."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The quoting that reports use.
CSV = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": "", "lineSep": "\r\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def fingerprint(configuration: dict[str, Any]) -> str:
    """SHA-256 of the configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(configuration, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_snapshot(files: DataFrame, path: str, scan_id: str) -> None:
    """One folder per scan: written once, found by its partition value."""
    files.drop("scan_id").write.mode("overwrite").parquet(f"{path}/scan_id={scan_id}")


def read_snapshot(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(f"{path}/scan_id={scan_id}")


def write_report(rows: DataFrame, path: str, order: list, drop: tuple[str, ...] = (), single: bool = True) -> None:
    """One sorted CSV file, or, if not single, files that are sorted when read by name, in a folder with a _SUCCESS marker. Columns of `drop` only sort. Line breaks inside values should be escaped first (exprs.display), as paths are."""
    ordered = rows.orderBy(*order).drop(*drop)
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").options(**CSV).csv(path)
