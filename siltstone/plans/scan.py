"""A scan from end to end: walk, reuse, hash, path audit, snapshot, reports.

A catalog holds `scans` and `roots` (lifecycle), `files/scan_id=…` and `findings/scan_id=…` (snapshots), and `parts/…`:
hashed rows, written batch by batch, so that a scan that was interrupted goes on after its last whole batch. The catalog
must be a folder that the driver and all executors share, and the roots must be the same on all of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates, pathaudit
from ..operators.classify import management
from ..operators.reuse import REUSABLE, assembled, hard_links, incremental, resumed
from ..operators.scope import latest_scan
from ..sources import hashing
from ..sources.inventory import InventorySource, valid_roots
from . import lifecycle, reports
from .lifecycle import ScanOptions
from .store import read_snapshot, write_report, write_snapshot

#: Names of the three reports.
ALL_FILES, DUPLICATES, PATHS = "all_file_hashes.csv", "duplicate_files.csv", "path_length_violations.csv"
#: Bytes of files between two points from which a scan can go on, and the most such points of one run.
BATCH_BYTES, BATCHES = 1 << 40, 256

_HASHED = f"id long, root_id long, path_raw binary, path string, nlink long, {hashing.RESULT}"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, for Hadoop."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def removed(spark: SparkSession, path: str) -> None:
    system, hadoop = _folder(spark, path)
    system.delete(hadoop, True)


def _whole_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that were written to their end."""
    system, hadoop = _folder(spark, f"{pattern}/_SUCCESS")
    return sorted(found.getPath().getParent().toString() for found in system.globStatus(hadoop) or [])


def _staged(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _walked(spark: SparkSession, options: ScanOptions, hidden: list[str]) -> DataFrame:
    spark.dataSource.register(InventorySource)
    read = spark.read.format("inventory").option("oneFileSystem", str(options.one_file_system))
    return read.option("roots", _joined(options.roots)).option("excludes", _joined([*options.excludes, *hidden])).load()


def _joined(paths) -> str:
    if any(":" in p for p in paths):
        raise ValueError("roots and excludes can't hold a colon")
    return ":".join(paths)


def _samples(files: DataFrame) -> DataFrame:
    """id and sample_digest of live files; '' for what can't be read."""

    def one(path: bytes, size: int) -> str:
        try:
            handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_CLOEXEC)
        except OSError:
            return ""
        try:
            return hashing.sampled(lambda at: os.pread(handle, hashing.REGION, at), size)
        except OSError:
            return ""
        finally:
            os.close(handle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(p, s) for p, s in zip(batch.column("path_raw").to_pylist(), batch.column("size_bytes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], names=["id", "sample_digest"])

    return files.select("id", "path_raw", "size_bytes").mapInArrow(run, "id long, sample_digest string")


def _by_raw(rows: DataFrame) -> DataFrame:
    """path holds the raw path, as two raw paths may be shown alike; `shown` what path was."""
    return rows.withColumn("shown", F.col("path")).withColumn("path", F.hex("path_raw"))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.col("shown")).drop("shown")


def _earlier(todo: DataFrame, previous: DataFrame, algorithm: str, policy: str) -> DataFrame:
    """todo with action and `found` (digest, sample_digest, id of the earlier row)."""
    old = _by_raw(previous).withColumn("digest", F.struct("digest", "sample_digest", "id"))
    old = old.withColumn("sample_digest", F.col("digest.sample_digest"))
    rows = _by_raw(todo)
    if policy == "sampled":
        same = incremental(rows, old, algorithm, "metadata").filter("action = 'reused' AND size_bytes > 0")
        rows = rows.join(_samples(same), "id", "left").withColumn("sample_digest", F.coalesce("sample_digest", F.lit("")))
    out = incremental(rows, old, algorithm, policy).withColumnRenamed("reused_digest", "found")
    return _plain(out).drop("sample_digest")


def _hashed(todo: DataFrame, options: ScanOptions, retries: int) -> DataFrame:
    """Rows of _HASHED. Dealt by path, as one folder may hold most files."""
    spark = todo.sparkSession
    dealt = todo.repartition(4 * spark.sparkContext.defaultParallelism, "path_raw")
    done = hashing.hashed_files(dealt, options.algorithm, retries, options.empty_files, options.chunk_mib << 20).alias("new")
    both = todo.alias("old").join(done, F.col("old.path_raw") == F.col("new.path_raw"))
    kept = [F.col(f"old.{c}").alias(c) for c in ("id", "root_id", "path_raw", "path", "nlink")]
    live = {"size_bytes", "allocated_bytes", "mtime_ns", "ctime_ns", "device", "inode"}
    names = [c.split()[0] for c in hashing.RESULT.split(", ")]
    return both.select(*kept, *[(F.coalesce(f"new.{c}", f"old.{c}") if c in live else F.col(f"new.{c}")).alias(c) for c in names])


def _in_batches(todo: DataFrame, options: ScanOptions, retries: int, folder: str) -> DataFrame:
    """Hashes files batch by batch; each batch that is written whole stays if the scan is interrupted."""
    spark = todo.sparkSession
    total = todo.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    batches = max(1, min(BATCHES, -(-total // BATCH_BYTES)))
    for n in range(batches):
        chosen = todo if batches == 1 else todo.filter(F.pmod(F.xxhash64("path_raw"), F.lit(batches)) == n)
        _hashed(chosen, options, retries).write.mode("overwrite").parquet(f"{folder}/batch={n}")
    return spark.read.schema(_HASHED).parquet(*[f"{folder}/batch={n}" for n in range(batches)])


def _from(rows: DataFrame) -> DataFrame:
    """Walked rows with `found` as reused rows."""
    return rows.select(*[c for c in rows.columns if c not in ("found", "action")], F.col("found.digest").alias("digest"), F.col("found.sample_digest").alias("sample_digest"), F.lit("").alias("error"), F.col("found.id").alias("reused_from_file_id"))


def _classified(files: DataFrame, roots: DataFrame, options: ScanOptions) -> DataFrame:
    path = _relative(files, roots).withColumn("_m", management(F.col("relative_path"), options.classify))
    out = path.withColumns({"management_class": F.col("_m.management_class"), "classification_confidence": F.col("_m.confidence"), "classification_reason": F.col("_m.reason"), "cleanup_risk": F.col("_m.cleanup_risk")})
    return out.drop("_m", "relative_path")


def _relative(files: DataFrame, roots: DataFrame) -> DataFrame:
    """relative_path: below the root. As many roots as the options name."""
    held = F.broadcast(roots.select(F.col("root_id").cast("long").alias("root_id"), F.length(F.rtrim("root", F.lit("/"))).alias("_n")))
    return files.join(held, "root_id").withColumn("relative_path", F.col("path").substr(F.col("_n") + 2, F.length("path"))).drop("_n")


def _collected(spark: SparkSession, catalog: str, scan_id: str, generation: int, options: ScanOptions, files: DataFrame, previous: DataFrame | None, policy: str, retries: int, work: str) -> DataFrame:
    """All rows of the scan's snapshot: kept from an interrupted run, reused, hashed, and links to hashed ones."""
    parts = _whole_folders(spark, f"{catalog}/parts/scan_id={scan_id}/*/*")
    partial = spark.read.schema(_HASHED).parquet(*parts) if parts else spark.createDataFrame([], _HASHED)
    kept, todo = resumed(_by_raw(files), _by_raw(partial))
    kept, todo = _plain(kept), _staged(_plain(todo), f"{work}/todo")
    if previous is not None and policy != "strict":
        judged = _staged(_earlier(todo, previous, options.algorithm, policy), f"{work}/judged")
        reused, todo = _from(judged.filter("action = 'reused'")), judged.filter("action = 'hash'").drop("action", "found")
    else:
        reused = None
    linked = _staged(_plain(hard_links(_by_raw(todo))), f"{work}/linked")
    folder = f"{catalog}/parts/scan_id={scan_id}/generation={generation}"
    hashed = _in_batches(linked.filter("link_status = 'ok'"), options, retries, f"{folder}")
    leaders = hashed.filter(F.col("status").isin(REUSABLE)).select(F.col("id").alias("first_id"), F.struct("digest", "sample_digest", "id").alias("found"))
    followers = _staged(linked.filter("link_status = 'reused'").join(leaders, "first_id", "left").drop("first_id", "link_status"), f"{work}/followers")
    # links to a file that could not be read are read themselves
    again = _hashed(followers.filter("found IS NULL"), options, retries)
    same = _from(followers.filter("found IS NOT NULL"))
    reused = same if reused is None else same.unionByName(reused)
    now = kept.unionByName(hashed).unionByName(again)
    return assembled(reused, now, generation).withColumn("algorithm", F.lit(options.algorithm))


def run_scan(spark: SparkSession, catalog: str, options: ScanOptions, output: str | None = None, resume: bool = False, use_previous: bool = False, policy: str = "sampled", retries: int = 1, single: bool = True) -> str:
    """Scans the roots and returns the scan's identifier; with `output`, its reports are written there.

    resume: goes on with the last scan that did not end well. use_previous: files that the last completed scan of the same
    algorithm holds unchanged are not hashed again (policy: metadata, sampled or strict). What fails is recorded as the scan's
    state before the error is raised."""
    if policy not in ("metadata", "sampled", "strict"):
        raise ValueError(f"unknown policy {policy}")
    if resume and use_previous:
        raise ValueError("a scan is resumed or compared with an earlier one, not both")
    if options.audit_only and use_previous:
        raise ValueError("an audit alone reads no earlier scan")
    if retries < 0:
        raise ValueError("retries can't be negative")
    options = replace(options, roots=valid_roots(list(options.roots)), excludes=[os.path.abspath(os.path.expanduser(e)) for e in options.excludes]).checked()
    previous = None
    if use_previous and _folder(spark, f"{catalog}/scans")[0].exists(_folder(spark, f"{catalog}/scans")[1]):
        found = latest_scan(lifecycle.scans(spark, catalog), "completed", options.algorithm).collect()
        previous = read_snapshot(spark, f"{catalog}/files", found[0]["scan_id"]) if found else None
    scan_id, generation = lifecycle.resume_scan(spark, catalog, options) if resume else (lifecycle.begin_scan(spark, catalog, options), 1)
    work = f"{catalog}/work/scan_id={scan_id}"
    try:
        hidden = [os.path.realpath(p) for p in (catalog, output) if p and "://" not in p]
        first = generation << 56  # identifiers of a generation follow those of the one before
        items = _staged(_walked(spark, options, hidden).withColumn("id", F.monotonically_increasing_id() + F.lit(first)), f"{work}/items")
        roots = lifecycle.roots(spark, catalog, scan_id)
        if options.audit_paths:
            checked = pathaudit.audited(_relative(items, roots).withColumn("scanned_path", F.col("path")), options.policy)
            write_snapshot(pathaudit.findings(checked).join(items.select("id", "root_id", "path_raw", F.col("path").alias("scanned_path")), "id"), f"{catalog}/findings", scan_id)
            write_snapshot(pathaudit.counters(checked), f"{catalog}/audits", scan_id)
        if not options.audit_only:
            files = items.filter("item_type = 'file'").drop("item_type")
            rows = _collected(spark, catalog, scan_id, generation, options, files, previous, policy, retries, work)
            write_snapshot(_classified(rows, roots, options), f"{catalog}/files", scan_id)
        if output:
            write_reports(spark, catalog, scan_id, options, output, single)
        lifecycle.set_state(spark, catalog, scan_id, "completed")
    except BaseException as e:
        state = "interrupted" if isinstance(e, KeyboardInterrupt) else "disk_full" if "No space left on device" in str(e) else "failed"
        lifecycle.set_state(spark, catalog, scan_id, state, f"{type(e).__name__}: {str(e)[:500]}")
        raise
    for done in (work, f"{catalog}/parts/scan_id={scan_id}"):
        removed(spark, done)
    return scan_id


def write_reports(spark: SparkSession, catalog: str, scan_id: str, options: ScanOptions, output: str, single: bool = True) -> None:
    """The reports of a scan; one of an earlier scan that this scan doesn't give is removed."""
    roots = lifecycle.roots(spark, catalog, scan_id)
    if options.audit_only:
        removed(spark, f"{output}/{ALL_FILES}")
        removed(spark, f"{output}/{DUPLICATES}")
    else:
        files = read_snapshot(spark, f"{catalog}/files", scan_id).drop("scan_id")
        write_report(reports.all_files(files, roots, scan_id), f"{output}/{ALL_FILES}", reports.ALL_FILES_ORDER, ("id",), single)
        write_report(reports.duplicate_paths(files, roots, options.algorithm, options.empty_files), f"{output}/{DUPLICATES}", reports.DUPLICATES_ORDER, ("id",), single)
    if not options.audit_paths:
        removed(spark, f"{output}/{PATHS}")
        return
    found = read_snapshot(spark, f"{catalog}/findings", scan_id).drop("scan_id")
    items = found.select("id", "root_id", "scanned_path", "path_raw")
    write_report(reports.path_findings(found.drop("root_id", "scanned_path", "path_raw"), items, roots, scan_id, options.policy), f"{output}/{PATHS}", reports.findings_order(), ("id",), single)


def totals(spark: SparkSession, catalog: str, scan_id: str) -> dict:
    """Counters of a scan's files."""
    return duplicates.status_counters(read_snapshot(spark, f"{catalog}/files", scan_id)).first().asDict()


