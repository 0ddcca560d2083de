"""Clean-up runs: proposals are verified against the live files and, only if it is asked for, quarantined or deleted.

A run has three steps. The manifest is written first. Each keeper and each candidate is then checked once, by executors:
its metadata, and its whole content unless that is waived; the result is written to the store. Last, one task per batch of
candidates acts, after a second look at the metadata of both files. A task that is tried again finds its candidate gone,
or in quarantine already, and records the same result, as what it may act on was written before.

The files must be the same on all executors.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleanup
from ..sources.hashing import CHUNK, hasher
from .store import write_report

#: Actions, and what must be typed before files are deleted.
PREVIEW, QUARANTINE, DELETE = "preview", "quarantine", "delete"
TOKEN = "DELETETHESEFILES"
METADATA = ["size_bytes", "mtime_ns", "ctime_ns", "device", "inode"]


@dataclass(frozen=True)
class CleanupPolicy:
    """What a run may do. `eligibility` is automatic (obvious copies in one folder) or all (whole groups)."""

    risk: str = "low"
    action: str = PREVIEW
    eligibility: str = "automatic"
    algorithm: str = "sha256"
    full_verify: bool = True
    quarantine: str | None = None
    token: str | None = None
    include: Sequence[int] = ()
    exclude: Sequence[int] = ()
    protect: Sequence[str] = ()
    keep: Sequence[str] = ()
    delete: Sequence[str] = ()

    def checked(self) -> CleanupPolicy:
        """Itself, if its action is allowed."""
        if self.action not in (PREVIEW, QUARANTINE, DELETE):
            raise ValueError(f"unknown action {self.action}")
        if self.eligibility not in ("automatic", "all"):
            raise ValueError(f"unknown eligibility {self.eligibility}")
        if self.action != PREVIEW and self.risk == "critical":
            raise ValueError("files of critical risk are never altered")
        if self.action == QUARANTINE and not self.quarantine:
            raise ValueError("quarantine needs a folder")
        if self.action == DELETE:
            if self.eligibility != "automatic":
                raise ValueError("only automatic candidates are deleted")
            if not self.full_verify:
                raise ValueError("deletion needs full verification")
            if self.token != TOKEN:
                raise ValueError("the confirmation token does not match; nothing was deleted")
        hasher(self.algorithm)
        real = lambda paths: tuple(os.path.realpath(os.path.expanduser(p)) for p in paths)
        return replace(self, protect=real(self.protect), keep=real(self.keep))


def planned(files: DataFrame, policy: CleanupPolicy) -> DataFrame:
    """Proposals with the identifiers of both files."""
    whole = policy.eligibility == "all"
    found = cleanup.whole_groups(files, policy.risk) if whole else cleanup.clusters(files, policy.risk)
    found = cleanup.chosen_groups(found, policy.include, policy.exclude)
    return cleanup.paired(cleanup.keepers(files, found, policy.protect, policy.keep, policy.delete, whole))


def _live(path: bytes, expected: tuple[int, ...]) -> str:
    """'' if the path is still that regular file, else why not."""
    try:
        now = os.lstat(path)
    except OSError as e:
        return f"not found: {e.strerror}"
    if not stat.S_ISREG(now.st_mode):
        return "no longer a regular file"
    actual = (now.st_size, now.st_mtime_ns, now.st_ctime_ns, now.st_dev, now.st_ino)
    return "" if actual == expected else f"metadata changed: expected {expected}, found {actual}"


def _content(path: bytes, algorithm: str) -> str:
    digest = hasher(algorithm)()
    with open(os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_CLOEXEC), "rb", buffering=0) as handle:
        while part := handle.read(CHUNK):
            digest.update(part)
    return digest.hexdigest()


def _expected(row: dict, prefix: str = "") -> tuple[int, ...]:
    return tuple(int(row[prefix + c] or 0) for c in METADATA)


def checked_files(files: DataFrame, algorithm: str, full: bool) -> DataFrame:
    """files: id, path_raw, digest and metadata. id and `problem`: '' for files that are as they were."""

    def problem(row: dict) -> str:
        found = _live(row["path_raw"], _expected(row))
        if found or not full:
            return found
        try:
            return "" if _content(row["path_raw"], algorithm) == row["digest"] else "content changed"
        except OSError as e:
            return f"unreadable: {e.strerror}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([problem(r) for r in batch.to_pylist()], pa.string())], names=["id", "problem"])

    return files.select("id", "path_raw", "digest", *METADATA).mapInArrow(run, "id long, problem string")


_RESULT = "candidate_id long, action_result string, destination_path string, error string, acted_utc string"


def _acted(action: str, quarantine: str | None):
    def move(source: bytes, run_folder: bytes) -> tuple[bytes, bool]:
        """(destination, whether an earlier try has moved the file)"""
        wanted = os.path.join(run_folder, source.lstrip(b"/"))
        spare = wanted + b"." + hashlib.sha256(source).hexdigest()[:8].encode()
        if not os.path.lexists(source):
            for place in (spare, wanted):
                if os.path.lexists(place):
                    return place, True
            raise FileNotFoundError("the candidate is gone")
        os.makedirs(os.path.dirname(wanted), 0o700, exist_ok=True)
        place = spare if os.path.lexists(wanted) else wanted
        shutil.move(source, place)
        return place, False

    def one(row: dict) -> tuple[str, str, str]:
        if row["verification_result"] != "verified":
            return "skipped", "", row["verification_result"]
        found = _live(row["keeper_raw"], _expected(row, "keeper_"))
        if found:
            return "skipped", "", f"keeper {found}"
        source = row["candidate_raw"]
        if os.path.lexists(source):
            found = _live(source, _expected(row, "candidate_"))
            if found:
                return "skipped", "", f"candidate {found}"
        try:
            if action == QUARANTINE:
                place, _ = move(source, os.fsencode(quarantine))
                return "quarantined", os.fsdecode(place).encode("utf-8", "backslashreplace").decode(), ""
            if os.path.lexists(source):
                os.unlink(source)
                return "deleted", "", ""
            if TaskContext.get().attemptNumber():
                return "deleted", "", "was gone when a task was tried again"
            return "missing", "", "was gone before it could be deleted"
        except OSError as e:
            return "failed", "", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["candidate_id"], *one(r), datetime.now(UTC).isoformat()) for r in batch.to_pylist()]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")])

    return run


def _sides(proposed: DataFrame, files: DataFrame) -> DataFrame:
    out = proposed
    for side in ("keeper", "candidate"):
        columns = [F.col("id").alias(f"{side}_id"), F.col("path_raw").alias(f"{side}_raw"), *[F.col(c).alias(f"{side}_{c}") for c in METADATA]]
        out = out.join(files.select(*columns), f"{side}_id")
    return out


def totals(actions: DataFrame) -> DataFrame:
    """Counters of a run; reclaimed bytes are apparent sizes."""
    result, done = F.col("action_result"), F.col("action_result").isin("deleted", "quarantined")
    return actions.agg(
        F.count("*").alias("processed_files"), F.count_if(result == "deleted").alias("deleted_files"), F.count_if(result == "quarantined").alias("quarantined_files"),
        F.count_if(result.isin("skipped", "missing")).alias("skipped_files"), F.count_if(result == "failed").alias("failed_files"),
        F.coalesce(F.sum(F.when(done, F.col("size_bytes"))), F.lit(0)).cast("long").alias("reclaimed_bytes"),
    )


def run_cleanup(spark: SparkSession, files: DataFrame, policy: CleanupPolicy, folder: str, manifest: str | None = None) -> str:
    """Runs a policy on a scan's files (with path_raw and metadata) and returns the run's identifier.

    Below `folder`, which the driver and all executors share: manifest/<run> (CSV; or `manifest` itself) for every run; for runs that act also
    verified/<run>, cleanup_actions/cleanup_run_id=<run> with a row per proposal and cleanup_runs/cleanup_run_id=<run>."""
    policy = policy.checked()
    began = datetime.now(UTC)
    run_id = f"{began:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    planned(files, policy).write.parquet(f"{folder}/proposals/{run_id}")
    proposed = spark.read.parquet(f"{folder}/proposals/{run_id}")
    write_report(cleanup.manifest(proposed, policy.eligibility), manifest or f"{folder}/manifest/{run_id}", ["group_number", "candidate_path"])
    if policy.action == PREVIEW:
        return run_id

    named = proposed.select(F.col("keeper_id").alias("id")).distinct().unionByName(proposed.select(F.col("candidate_id").alias("id")))
    checked = checked_files(files.join(named, "id", "left_semi"), policy.algorithm, policy.full_verify)
    checked.write.parquet(f"{folder}/verified/{run_id}")
    checked = spark.read.schema("id long, problem string").parquet(f"{folder}/verified/{run_id}")
    of = lambda side: checked.select(F.col("id").alias(f"{side}_id"), F.col("problem").alias(f"{side}_problem"))
    judged = _sides(proposed, files).join(of("keeper"), "keeper_id").join(of("candidate"), "candidate_id")
    judged = judged.withColumn(
        "verification_result",
        F.when(F.col("keeper_problem") != "", F.concat(F.lit("keeper "), "keeper_problem")).when(F.col("candidate_problem") != "", F.concat(F.lit("candidate "), "candidate_problem")).otherwise("verified"),
    )
    judged.write.parquet(f"{folder}/judged/{run_id}")
    judged = spark.read.parquet(f"{folder}/judged/{run_id}")
    where = f"{policy.quarantine.rstrip('/')}/{run_id}" if policy.quarantine else None
    acted = judged.mapInArrow(_acted(policy.action, where), _RESULT)
    # results first, on their own: the rows of the run must not act again when they are joined or counted
    acted.write.parquet(f"{folder}/results/{run_id}")
    acted = spark.read.schema(_RESULT).parquet(f"{folder}/results/{run_id}")
    actions = judged.join(acted, "candidate_id").select(
        F.col("cleanup_group_number").alias("group_number"), "digest", "size_bytes", "keeper_path", "candidate_path", F.col("candidate_raw").alias("candidate_path_raw"),
        "verification_result", "action_result", "destination_path", "error", "acted_utc",
    )
    actions.write.parquet(f"{folder}/cleanup_actions/cleanup_run_id={run_id}")
    actions = spark.read.parquet(f"{folder}/cleanup_actions/cleanup_run_id={run_id}")
    state = F.when(F.col("failed_files") > 0, "completed_with_errors").otherwise("completed")
    header = {"started_utc": began.isoformat(), "ended_utc": datetime.now(UTC).isoformat(), "requested_risk": policy.risk, "action": policy.action, "verification_mode": "full" if policy.full_verify else "metadata"}
    row = totals(actions).crossJoin(cleanup.estimate(proposed).select(F.col("candidates").alias("proposed_files"), "estimated_bytes"))  # one row each
    row.select(*[F.lit(v).alias(k) for k, v in header.items()], state.alias("state"), "*").coalesce(1).write.parquet(f"{folder}/cleanup_runs/cleanup_run_id={run_id}")
    return run_id
