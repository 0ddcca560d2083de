"""The life of a scan: its configuration and fingerprints, its header and roots, its states.

A catalog is a folder with `scans` and `roots`, to which rows are only appended. A scan's latest row is its state.
"""

from __future__ import annotations

import json
import os
import platform
import socket
import sys
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pathaudit import PathPolicy
from ..operators.reuse import REUSABLE
from ..operators.scope import latest_scan
from ..sources.inventory import beneath, mounts, shown
from .store import fingerprint

#: The states of a scan, the version of the catalog, and exit codes.
STATES = ["running", "completed", "interrupted", "failed", "disk_full"]
SCHEMA_VERSION = 3
EXIT = {"completed": 0, "completed_with_errors": 1, "usage": 2, "interrupted": 130}

SCANS = "scan_id string, state string, started_utc string, ended_utc string, reason string, hostname string, platform string, python_version string, schema_version int, algorithm string, config_fingerprint string, invocation_json string, generation int, path_audit_enabled boolean, path_audit_only boolean, changed long"
ROOTS = "scan_id string, root_id int, root string, path_raw binary, device long, mount_point string, filesystem_type string, mount_source string, filesystem_uuid string"


@dataclass(frozen=True)
class ScanOptions:
    """What a scan does; it can be resumed only with the same."""

    roots: Sequence[str]
    excludes: Sequence[str] = ()
    algorithm: str = "sha256"
    one_file_system: bool = False
    empty_files: str = "count"
    chunk_mib: int = 8
    classify: bool = True
    audit_paths: bool = False
    audit_only: bool = False
    policy: PathPolicy = PathPolicy()

    def checked(self) -> ScanOptions:
        p = self.policy
        if not self.roots:
            raise ValueError("a scan needs a root")
        if self.empty_files not in ("count", "ignore", "report"):
            raise ValueError(f"unknown policy for empty files {self.empty_files}")
        if self.chunk_mib < 1:
            raise ValueError("chunks have 1 MiB at least")
        if self.audit_only and not self.audit_paths:
            raise ValueError("an audit alone needs the audit")
        if min(p.warning, p.office, p.hard, p.filename, p.directory) < 1 or p.prefix < 0:
            raise ValueError("limits of paths are positive")
        if not p.warning < p.office <= p.hard:
            raise ValueError("the warning limit is below the office limit, which is at most the hard limit")
        return self

    def payload(self, legacy: bool = False) -> dict[str, object]:
        """What the fingerprint is of. legacy: without the keys of path audits, as scans of earlier catalogs have it."""
        raw = [os.fsencode(r).hex() for r in self.roots]
        out: dict[str, object] = {"roots": [shown(r) for r in self.roots], "roots_raw_hex": raw, "excludes_raw_hex": sorted(os.fsencode(e).hex() for e in self.excludes)}
        out |= {"algorithm": self.algorithm, "one_file_system": self.one_file_system, "empty_files": self.empty_files, "chunk_size_mib": self.chunk_mib, "managed_classification": self.classify}
        if legacy:
            return out
        p = self.policy
        out |= {"path_audit_enabled": self.audit_paths, "path_audit_only": self.audit_only, "path_warning_chars": p.warning, "office_path_limit": p.office, "hard_path_limit": p.hard}
        return out | {"filename_limit": p.filename, "directory_name_limit": p.directory, "windows_prefix_length": p.prefix}


def accepted_fingerprints(options: ScanOptions, schema_version: int) -> set[str]:
    """Fingerprints under which a scan of that catalog version may be resumed."""
    return {fingerprint(options.payload())} | ({fingerprint(options.payload(legacy=True))} if schema_version < SCHEMA_VERSION else set())


def _now() -> str:
    return datetime.now(UTC).isoformat()


def device_number(device: int) -> str:
    return f"{os.major(device)}:{os.minor(device)}"


def disk_uuids(folder: str = "/dev/disk/by-uuid") -> dict[str, str]:
    """{device file: UUID}; empty where the folder can't be read."""
    try:
        return {os.path.realpath(e.path): e.name for e in os.scandir(folder)}
    except OSError:
        return {}


def mount_of(path: str, device: int, table: Sequence[tuple[str, str, str, str]], uuids: dict[str, str]) -> tuple[str, str, str, str]:
    """(mount point, type, source, UUID) of the longest mount point of that device above path."""
    over = [m for m in table if m[0] == device_number(device) and beneath(path, m[1])]
    if not over:
        return path, "unknown", "unknown", ""
    _, point, kind, source = max(over, key=lambda m: len(m[1]))
    return point, kind, source, uuids.get(os.path.realpath(source), "")


def begin_scan(spark: SparkSession, catalog: str, options: ScanOptions) -> str:
    """Appends a running scan and its roots; gives its identifier."""
    options = options.checked()
    scan_id = str(uuid.uuid4())
    invocation = json.dumps({"argv": [shown(a) for a in sys.argv], "cwd": shown(os.getcwd())})
    header = (scan_id, "running", _now(), None, None, socket.gethostname(), platform.platform(), platform.python_version(), SCHEMA_VERSION, options.algorithm, fingerprint(options.payload()), invocation, 1)
    spark.createDataFrame([(*header, options.audit_paths, options.audit_only, 0)], SCANS).write.mode("append").parquet(f"{catalog}/scans")
    try:
        with open("/proc/self/mountinfo") as f:
            table = mounts(f.read())
    except OSError:
        table = []
    rows, uuids = [], disk_uuids()
    for number, root in enumerate(options.roots, 1):
        device = os.stat(root, follow_symlinks=False).st_dev
        rows.append((scan_id, number, shown(root), os.fsencode(root), device, *map(shown, mount_of(root, device, table, uuids))))
    spark.createDataFrame(rows, ROOTS).write.mode("append").parquet(f"{catalog}/roots")
    return scan_id


def scans(spark: SparkSession, catalog: str) -> DataFrame:
    """The latest row of every scan."""
    rows = spark.read.schema(SCANS).parquet(f"{catalog}/scans")
    return rows.groupBy("scan_id").agg(F.max(F.struct("changed", *[c for c in rows.columns if c not in ("changed", "scan_id")])).alias("row")).select("scan_id", "row.*")


def roots(spark: SparkSession, catalog: str, scan_id: str) -> DataFrame:
    return spark.read.schema(ROOTS).parquet(f"{catalog}/roots").filter(F.col("scan_id") == scan_id).orderBy("root_id")


def set_state(spark: SparkSession, catalog: str, scan_id: str, state: str, reason: str = "", generation: int | None = None) -> None:
    """Appends the scan's row with another state."""
    if state not in STATES:
        raise ValueError(f"unknown state {state}")
    row = scans(spark, catalog).filter(F.col("scan_id") == scan_id)
    ended = F.lit(None).cast("string") if state == "running" else F.lit(_now())
    new = row.withColumns({"state": F.lit(state), "reason": F.lit(shown(reason)), "ended_utc": ended, "changed": F.col("changed") + 1, "generation": F.lit(generation) if generation else F.col("generation")})
    new.select(*[c.split()[0] for c in SCANS.split(", ")]).coalesce(1).write.mode("append").parquet(f"{catalog}/scans")


def resume_scan(spark: SparkSession, catalog: str, options: ScanOptions) -> tuple[str, int]:
    """The last scan that has not ended well, running again in its next generation: (identifier, generation)."""
    found = latest_scan(scans(spark, catalog), "resumable").collect()
    if not found:
        raise ValueError("there is no interrupted scan")
    row = found[0]
    if row["config_fingerprint"] not in accepted_fingerprints(options, row["schema_version"]):
        raise ValueError("the interrupted scan had another configuration")
    set_state(spark, catalog, row["scan_id"], "running", generation=row["generation"] + 1)
    return row["scan_id"], row["generation"] + 1


def held_rows(files: DataFrame) -> int:
    """Rows of an interrupted scan that needn't be hashed again."""
    return files.filter(F.col("status").isin(REUSABLE)).count()


def throughput(files: DataFrame) -> DataFrame:
    """bytes_read, elapsed_seconds and their ratio over a scan's rows (0 without elapsed time)."""
    sums = files.agg(F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read"), F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)).alias("elapsed_seconds"))
    return sums.withColumn("bytes_per_second", F.when(F.col("elapsed_seconds") > 0, F.col("bytes_read") / F.col("elapsed_seconds")).otherwise(0.0))
