"""The command line: python -m siltstone --root DIR [...], or --cleanup to treat the duplicates of a completed scan.

Below --output-dir lie the catalog (`catalog`), the reports and what clean-up runs leave (`cleanup`). On a cluster it is a
folder that the driver and all executors share; start it by spark-submit there.
"""

from __future__ import annotations

import argparse
import logging
import os
import signal
import sys
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.exprs import RISKS
from .operators.pathaudit import PathPolicy
from .operators.scope import latest_scan
from .plans import actions, lifecycle, scan
from .plans.lifecycle import EXIT, ScanOptions
from .plans.store import read_snapshot

log = logging.getLogger("siltstone")
VERSION = "0.2"
#: Proposals that are shown; the manifest holds all.
SHOWN = 25
_LIMITS = PathPolicy()

#: Options with a value: name, type, default, help.
VALUES: list[tuple[str, Callable, object, str]] = [
    ("output-dir", str, "siltstone-results", "folder of the catalog, reports and clean-up runs"),
    ("workers", int, 0, "local cores; 0 takes the session's master, or all"),
    ("chunk-size-mib", int, 8, "read buffer"),
    ("progress-seconds", float, 5.0, "accepted; Spark shows progress"),
    ("file-progress-seconds", float, 0.0, "accepted; Spark shows progress"),
    ("retry-changed", int, 1, "times a file is read again that changed meanwhile"),
    ("cleanup-scan-id", str, None, "the scan to treat; the last completed one if not given"),
    ("cleanup-manifest", str, None, "folder of the manifest"),
    ("quarantine-dir", str, None, "where quarantined files go"),
    ("confirmation-token", str, None, "needed to delete"),
    ("path-warning-chars", int, _LIMITS.warning, "paths from this length get a warning"),
    ("office-path-limit", int, _LIMITS.office, "paths from this length are of high severity"),
    ("hard-path-limit", int, _LIMITS.hard, "paths beyond this length are critical"),
    ("filename-limit", int, _LIMITS.filename, "longest file name"),
    ("directory-name-limit", int, _LIMITS.directory, "longest folder name"),
    ("windows-prefix-length", int, _LIMITS.prefix, "characters that go before the relative path; 0 takes the scanned path"),
]
#: Options with one of some values, the first of which is the default.
CHOICES: list[tuple[str, list[str], str]] = [
    ("algorithm", ["sha256", "blake2b", "blake3"], "hash"),
    ("empty-files", ["count", "ignore", "report"], "empty files"),
    ("log-detail", ["summary", "verbose", "trace"], "how much is logged"),
    ("cleanup-action", ["interactive", "preview", "manifest", "quarantine", "delete"], "what a clean-up run does"),
    ("cleanup-risk", RISKS, "risk of the groups that are treated"),
    ("cleanup-eligibility", ["automatic", "all"], "obvious copies in one folder, or whole groups"),
    ("cache-policy", ["sampled", "metadata", "strict"], "when an earlier hash holds"),
]
#: Options that may be repeated: name, type.
LISTS: list[tuple[str, Callable]] = [("root", str), ("exclude", str), ("protect", str), ("keep-prefer", str), ("delete-prefer", str), ("include-group", int), ("exclude-group", int)]
FLAGS = [
    "one-file-system", "print-hashes", "resume", "report-only", "cleanup", "no-full-verify", "yes-noninteractive", "incremental", "no-managed-classification", "audit-paths", "path-audit-only", "ignore-empty",
    "no-print-duplicates",
]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("siltstone", description="Content inventories of directory trees: duplicates, path audits, clean-up.")
    for name, kind, default, text in VALUES:
        out.add_argument(f"--{name}", type=kind, default=default, help=text)
    for name, among, text in CHOICES:
        out.add_argument(f"--{name}", choices=among, default=among[0], help=text)
    for name, kind in LISTS:
        out.add_argument(f"--{name}", type=kind, action="append", default=[])
    for name in FLAGS:
        out.add_argument(f"--{name}", action="store_true")
    out.add_argument("--version", action="version", version=VERSION)
    return out


def problem(a: argparse.Namespace) -> str | None:
    """The first rule that the arguments break. Rules of paths and of clean-up are those of ScanOptions and CleanupPolicy."""
    modes = [m for m in ("resume", "incremental", "report_only") if getattr(a, m)]
    if a.cleanup:
        rules = [
            (bool(modes) or a.path_audit_only, "--cleanup goes with no other mode"),
            (bool(a.root), "--cleanup takes its roots from the scan"),
        ]
    else:
        rules = [
            (not a.root, "a scan needs --root"),
            (len(modes) > 1, f"--{' and --'.join(modes)} exclude each other".replace("_", "-")),
            (a.path_audit_only and (a.report_only or a.incremental), "--path-audit-only goes with neither --report-only nor --incremental"),
            (a.workers < 0, "--workers can't be negative"),
            (a.progress_seconds <= 0 or a.file_progress_seconds < 0, "times between progress lines are positive"),
            (a.retry_changed < 0, "--retry-changed can't be negative"),
        ]
    return next((text for broken, text in rules if broken), None)


def options_of(a: argparse.Namespace) -> ScanOptions:
    policy = PathPolicy(a.path_warning_chars, a.office_path_limit, a.hard_path_limit, a.filename_limit, a.directory_name_limit, a.windows_prefix_length)
    return ScanOptions(
        a.root, a.exclude, a.algorithm, a.one_file_system, "ignore" if a.ignore_empty else a.empty_files, a.chunk_size_mib, not a.no_managed_classification, a.audit_paths or a.path_audit_only, a.path_audit_only, policy,
    ).checked()


def policy_of(a: argparse.Namespace, algorithm: str) -> actions.CleanupPolicy:
    action = actions.PREVIEW if a.cleanup_action in ("interactive", "manifest") else a.cleanup_action
    return actions.CleanupPolicy(
        a.cleanup_risk, action, a.cleanup_eligibility, algorithm, not a.no_full_verify, a.quarantine_dir, a.confirmation_token, a.include_group, a.exclude_group, a.protect, a.keep_prefer, a.delete_prefer,
    ).checked()


def _session(a: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(f"local[{a.workers}]") if a.workers else builder).getOrCreate()


def _confirmed(a: argparse.Namespace, files: int) -> bool:
    """Whether files may be altered: said on the command line, or their number typed in again."""
    if a.yes_noninteractive:
        return True
    return sys.stdin.isatty() and input(f"{files} files would be altered. Type their number to go on: ").strip() == str(files)


def clean(spark: SparkSession, a: argparse.Namespace, catalog: str, folder: str) -> int:
    known = lifecycle.scans(spark, catalog)
    chosen = known.filter(F.col("scan_id") == a.cleanup_scan_id) if a.cleanup_scan_id else latest_scan(known, "cleanup")
    found = chosen.filter("state = 'completed' AND NOT path_audit_only").collect()
    if not found:
        raise ValueError("there is no such completed scan")
    policy = policy_of(a, found[0]["algorithm"])
    files = read_snapshot(spark, f"{catalog}/files", found[0]["scan_id"]).drop("scan_id")
    plan = actions.planned(files, policy)
    for row in plan.orderBy("cleanup_group_number", "candidate_path").limit(SHOWN).collect():
        log.info("group %d: keep %s, not %s", row["cleanup_group_number"], row["keeper_path"], row["candidate_path"])
    if policy.action != actions.PREVIEW and not _confirmed(a, plan.count()):
        log.error("not confirmed; nothing was altered")
        return EXIT["usage"]
    run_id = actions.run_cleanup(spark, files, policy, folder, a.cleanup_manifest)
    log.info("clean-up run %s", run_id)
    if policy.action == actions.PREVIEW:
        return EXIT["completed"]
    state = spark.read.parquet(f"{folder}/cleanup_runs/cleanup_run_id={run_id}").first()["state"]
    return EXIT[state]


def _stop(*_) -> None:
    raise KeyboardInterrupt


def main(arguments: Sequence[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    logging.basicConfig(level=logging.INFO if a.log_detail == "summary" else logging.DEBUG, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    output = os.path.abspath(a.output_dir) if "://" not in a.output_dir else a.output_dir
    catalog = f"{output}/catalog"
    old = signal.signal(signal.SIGTERM, _stop)
    try:
        if found := problem(a):
            raise ValueError(found)
        options = None if a.cleanup else options_of(a)
        if a.cleanup:
            policy_of(a, "sha256")  # refused before Spark starts
        spark = _session(a)
        if options is None:
            return clean(spark, a, catalog, f"{output}/cleanup")
        if a.report_only:
            last = latest_scan(lifecycle.scans(spark, catalog), "completed").collect()
            if not last:
                raise ValueError("there is no completed scan")
            row = last[0]
            scan_id = row["scan_id"]
            options = replace(options, algorithm=row["algorithm"], audit_paths=row["path_audit_enabled"], audit_only=row["path_audit_only"])
            scan.write_reports(spark, catalog, scan_id, options, output)
        else:
            scan_id = scan.run_scan(spark, catalog, options, output, a.resume, a.incremental, a.cache_policy, a.retry_changed)
        log.info("scan %s", scan_id)
        if not options.audit_only:
            log.info("%s", scan.totals(spark, catalog, scan_id))
        return EXIT["completed"]
    except ValueError as e:
        log.error("%s", e)
        return EXIT["usage"]
    except KeyboardInterrupt:
        log.error("interrupted; go on with --resume")
        return EXIT["interrupted"]
    except (OSError, PySparkException) as e:
        log.error("failed: %s", e)
        return EXIT["completed_with_errors"]
    finally:
        signal.signal(signal.SIGTERM, old)


if __name__ == "__main__":
    sys.exit(main())
