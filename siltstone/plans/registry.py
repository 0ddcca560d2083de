"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import classify, cleanup, duplicates, pathaudit, reuse, scope
from ..sources import hashing
from . import adapters as A
from . import reports

#: Limits low enough that the rules for names fire.
LOW = pathaudit.PathPolicy(warning=60, office=120, hard=200, filename=12, directory=15)
EXCLUDES = ["/src0", "/src3/en", "/src1/de/doc5.txt"]


def _dup_groups(spark, d):
    return duplicates.groups(duplicates.eligible(A.inventory(spark, d)))


def _empty(policy):
    status = {"ignore": "empty_ignored", "count": "empty", "report": "empty_reported"}[policy]

    def query(spark, d):
        files = A.inventory(spark, d, 13, status)
        return duplicates.summary(duplicates.groups(duplicates.eligible(files, policy)))

    return query


def _dup_detail(spark, d):
    files = duplicates.eligible(A.inventory(spark, d))
    roots = files.select("root_id").distinct().withColumn("root", F.concat(F.lit("/src"), F.col("root_id").cast("string")))
    return duplicates.detail(files, duplicates.groups(files), roots)


def _dup_turns(spark, d):
    turns = A.table(spark, d, "conversations").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("conv_id").alias("device"), F.col("turn").alias("inode"),
        F.octet_length("text").cast("long").alias("allocated_bytes"), F.lit("low").alias("cleanup_risk"),
    )
    return duplicates.summary(duplicates.groups(turns))


def _classified(spark, d):
    return A.placed_paths(spark, d).select("id", "relative_path", classify.management(F.col("relative_path")).alias("m")).select("id", "relative_path", "m.management_class", "m.confidence", "m.cleanup_risk")


def _paired(spark, d):
    files = A.cleanup_inventory(spark, d).withColumn("classification_reason", F.concat(F.lit("rule "), (F.col("id") % 3).cast("string")))
    return cleanup.paired(cleanup.keepers(files, cleanup.clusters(files, "low")))


def _proposals(spark, d):
    files = A.cleanup_inventory(spark, d)
    return cleanup.proposals(cleanup.keepers(files, cleanup.clusters(files, "low")))


def _whole_proposals(spark, d):
    files = A.cleanup_inventory(spark, d)
    return cleanup.proposals(cleanup.keepers(files, cleanup.whole_groups(files, "low"), whole=True))


def _keepers(spark, d):
    files = A.cleanup_inventory(spark, d)
    return cleanup.keepers(files, cleanup.clusters(files, "low")).filter("place = 1").select("cleanup_group_number", "path", "id")


def _keeper_lists(spark, d):
    files = A.keeper_inventory(spark, d)
    return cleanup.keepers(files, cleanup.whole_groups(files, "low"), whole=True, **A.LISTS).select("cleanup_group_number", "path", "id", "place")


def _plain_names(spark, d):
    name = F.get(F.array(*[F.lit(n) for n, _ in A.NAMES]), (F.col("doc_id") % len(A.NAMES)).cast("int"))
    path = F.concat(F.lit("/data/"), name)
    return A.table(spark, d, "documents").select("doc_id", exprs.plain_name(path).alias("plain"), exprs.copy_score(path).alias("copy_score"))


def _path_report(spark, d):
    items = A.path_items(spark, d).withColumn("root_id", F.lit(1))
    found = pathaudit.findings(pathaudit.audited(items))
    return reports.path_findings(found, items, spark.createDataFrame([(1, "/r")], "root_id int, root string"), "scan", pathaudit.PathPolicy()).drop("id")


def _resume(spark, d):
    now, before = A.generations(spark, d)
    held, todo = reuse.resumed(now, before)
    rows = held.select("path", F.lit("kept").alias("action")).unionByName(todo.select("path", F.lit("hash").alias("action")))
    return rows.groupBy("action").agg(F.count("*").alias("n"))


def _hardlinks(spark, d):
    files = A.inventory(spark, d)
    links = files.groupBy("device", "inode").agg(F.count("*").alias("nlink"))
    named = files.join(links, ["device", "inode"]).withColumn("mtime_ns", F.lit(0)).withColumn("ctime_ns", F.lit(0))
    return reuse.hard_links(named).select("id", "first_id", "link_status")


def _nested_roots(spark, d):
    roots = spark.createDataFrame([("/", 1), ("/src1", 2), ("/src1/en", 3), ("/src10", 4)], "root string, root_id long")
    return scope.owned_by_root(A.inventory(spark, d).select("id", "path"), roots).select("id", "root", "root_id")


def _mounts(spark, d):
    mounts = spark.createDataFrame([(1, "/", "ext4", "/dev/a"), (1, "/src1", "xfs", "/dev/b"), (1, "/src1/en", "xfs", "/dev/c"), (2, "/src1", "btrfs", "/dev/d")], "device long, mount_point string, filesystem_type string, mount_source string")
    return scope.mounted(A.inventory(spark, d).select("id", "path", "device"), mounts).select("id", "mount_point", "filesystem_type", "mount_source")


def _upsert(spark, d):
    now, before = A.generations(spark, d)
    old = before.select("path", "size_bytes", "mtime_ns").withColumn("seen_generation", F.lit(1))
    new = now.select("path", "size_bytes", "mtime_ns").withColumn("seen_generation", F.lit(2))
    return reuse.upserted(old, new, ["path"])


def _iso(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return A.table(spark, d, "events").select("event_id", exprs.iso_time(micros * 1000).alias("iso"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    items = A.path_items
    return {
        "inventory_all": lambda s, d: A.inventory(s, d).withColumn("sparse", exprs.sparse_flag(F.col("allocated_bytes"), F.col("size_bytes"))).withColumn("path_hex", F.lower(F.hex(F.col("path").cast("binary")))),
        "dup_physical_copies": lambda s, d: duplicates.physical_copies(duplicates.eligible(A.inventory(s, d))),
        "dup_groups": _dup_groups,
        "dup_summary": lambda s, d: duplicates.summary(_dup_groups(s, d)),
        "dup_detail": _dup_detail,
        "dup_hardlink_only": lambda s, d: _dup_groups(s, d).filter("physical_copy_count = 1").select("group_number", "digest", "path_count"),
        "dup_turns": _dup_turns,
        "status_counters": lambda s, d: duplicates.status_counters(A.inventory(s, d, 13, "empty")),
        "empty_policy_ignore": _empty("ignore"),
        "empty_policy_count": _empty("count"),
        "empty_policy_report": _empty("report"),
        "classify_paths": _classified,
        "classify_risk_histogram": lambda s, d: _classified(s, d).groupBy("management_class", "cleanup_risk").agg(F.count("*").alias("n")),
        "path_audit_items": lambda s, d: pathaudit.audited(items(s, d)),
        "path_audit_findings": lambda s, d: pathaudit.ordered(pathaudit.findings(pathaudit.audited(items(s, d)))),
        "path_audit_low_limits": lambda s, d: pathaudit.audited(items(s, d), LOW),
        "path_audit_counters": lambda s, d: pathaudit.counters(pathaudit.audited(items(s, d))),
        "cleanup_groups": lambda s, d: cleanup.cleanup_groups(A.cleanup_inventory(s, d), "low"),
        "cleanup_clusters": lambda s, d: cleanup.clusters(A.cleanup_inventory(s, d), "low"),
        "cleanup_keeper": _keepers,
        "cleanup_proposals": _proposals,
        "cleanup_proposals_all": _whole_proposals,
        "cleanup_chosen_groups": lambda s, d: cleanup.chosen_groups(cleanup.cleanup_groups(A.cleanup_inventory(s, d)), [2, 3, 5, 8], [3]),
        "cleanup_manifest": lambda s, d: cleanup.manifest(_paired(s, d)),
        "cleanup_keeper_lists": _keeper_lists,
        "plain_names": _plain_names,
        "report_all_files": lambda s, d: reports.all_files(A.report_inventory(s, d), A.report_roots(s, d), "scan").drop("id"),
        "report_duplicates": lambda s, d: reports.duplicate_paths(A.report_inventory(s, d), A.report_roots(s, d), "sha256").drop("id"),
        "report_path_findings": _path_report,
        "cleanup_estimate": lambda s, d: cleanup.estimate(_proposals(s, d)),
        "incremental_reuse": lambda s, d: reuse.incremental(*A.generations(s, d)).select("path", "action", "reused_digest"),
        "resume_sweep": _resume,
        "hardlink_reuse": _hardlinks,
        "snapshot_upsert": _upsert,
        "prefix_excludes": lambda s, d: scope.excluded(A.inventory(s, d), EXCLUDES).select("id", "path"),
        "nested_roots": _nested_roots,
        "longest_prefix_mount": _mounts,
        "latest_completed_scan": lambda s, d: scope.latest_scan(A.scans(s, d), "completed", "sha256"),
        "latest_resumable_scan": lambda s, d: scope.latest_scan(A.scans(s, d), "resumable"),
        "latest_report_scan": lambda s, d: scope.latest_scan(A.scans(s, d), "report"),
        "iso_timestamps": _iso,
        "utf16_lengths": lambda s, d: A.table(s, d, "documents").select("doc_id", exprs.utf16_length(F.col("text")).alias("utf16_chars")),
        "hash_blake2b": lambda s, d: hashing.hashed_texts(A.table(s, d, "documents"), "blake2b"),
        "sample_digest": lambda s, d: hashing.sampled_texts(A.table(s, d, "documents")),
    }


_SUMMARY = """ SELECT count(*) AS groups, coalesce(sum(CASE WHEN physical_copy_count > 1 AND size_bytes > 0 THEN 1 ELSE 0 END), 0)::BIGINT AS cleanup_groups,
  coalesce(sum(CASE WHEN physical_copy_count = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS hardlink_only_groups, coalesce(sum(path_count), 0)::BIGINT AS duplicate_paths,
  coalesce(sum(logical_duplicate_bytes), 0)::BIGINT AS logical_duplicate_bytes, coalesce(sum(reclaimable_min_bytes), 0)::BIGINT AS reclaimable_min_bytes,
  coalesce(sum(reclaimable_max_bytes), 0)::BIGINT AS reclaimable_max_bytes, coalesce(sum(contains_sparse), 0)::BIGINT AS sparse_groups FROM grp"""
_NOT_EMPTY = A.BLANK.replace("inv AS (", "inv0 AS (", 1) + ", inv AS (SELECT * FROM inv0 WHERE size_bytes > 0)" + A.GROUPS + _SUMMARY
_SCAN = " SELECT * FROM s WHERE {where} ORDER BY {order} LIMIT 1"
_LOW = A.path_audit_sql(LOW.warning, LOW.office, LOW.hard, LOW.filename, LOW.directory)
_UNDER = "(path = '{0}' OR starts_with(path, '{0}/'))"


def oracle_sql() -> dict[str, str]:
    return {
        "inventory_all": A.PLAIN + " SELECT *, 'ok' AS status, CASE WHEN allocated_bytes < size_bytes THEN 'yes' ELSE 'no' END AS sparse, lower(hex(path)) AS path_hex FROM inv",
        "dup_physical_copies": A.PLAIN + A.GROUPS + " SELECT digest, size_bytes, device, inode, a AS allocated_bytes, s AS is_sparse FROM phys",
        "dup_groups": A.PLAIN + A.GROUPS + " SELECT * FROM grp",
        "dup_summary": A.PLAIN + A.GROUPS + _SUMMARY,
        "dup_detail": A.PLAIN + A.GROUPS + """ SELECT group_number, CASE WHEN physical_copy_count = 1 THEN 'hardlink_aliases' ELSE 'physical_duplicates' END AS group_kind,
  CASE WHEN physical_copy_count = 1 OR size_bytes = 0 THEN 'no' ELSE 'review' END AS cleanup_candidate, id, path, digest, size_bytes, path_count, physical_copy_count, group_risk, cleanup_risk,
  CASE WHEN allocated_bytes < size_bytes THEN 'yes' ELSE 'no' END AS sparse, '/src' || CAST(root_id AS VARCHAR) AS root FROM inv JOIN grp USING (digest, size_bytes)""",
        "dup_hardlink_only": A.PLAIN + A.GROUPS + " SELECT group_number, digest, path_count FROM grp WHERE physical_copy_count = 1",
        "dup_turns": "WITH inv AS (SELECT sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size_bytes, conv_id AS device, turn AS inode, CAST(strlen(text) AS BIGINT) AS allocated_bytes, 'low' AS cleanup_risk FROM conversations)" + A.GROUPS + _SUMMARY,
        "status_counters": A.BLANK + " SELECT count(*) AS examined, count_if(size_bytes > 0)::BIGINT AS hashed, 0::BIGINT AS reused, count_if(size_bytes = 0)::BIGINT AS empty, 0::BIGINT AS changed, 0::BIGINT AS cancelled, 0::BIGINT AS errors FROM inv",
        "empty_policy_ignore": _NOT_EMPTY,
        "empty_policy_count": _NOT_EMPTY,
        "empty_policy_report": A.BLANK + A.GROUPS + _SUMMARY,
        "classify_paths": A.CLASSIFIED + " SELECT * FROM c",
        "classify_risk_histogram": A.CLASSIFIED + " SELECT management_class, cleanup_risk, count(*) AS n FROM c GROUP BY ALL",
        "path_audit_items": A.path_audit_sql() + " SELECT * FROM chk",
        "path_audit_findings": A.path_audit_sql() + " SELECT * FROM chk WHERE severity <> 'none'",
        "path_audit_low_limits": _LOW + " SELECT * FROM chk",
        "path_audit_counters": A.path_audit_sql() + """ SELECT count(*) AS examined, count_if(item_type = 'file')::BIGINT AS files, count_if(item_type = 'directory')::BIGINT AS directories, count_if(severity <> 'none')::BIGINT AS findings,
  count_if(severity = 'warning')::BIGINT AS warnings, count_if(severity = 'high')::BIGINT AS high, count_if(severity = 'critical')::BIGINT AS critical FROM chk""",
        "cleanup_groups": A.CLEANUP + " SELECT * FROM n WHERE group_risk = 'low'",
        "cleanup_clusters": A.CLEANUP + " SELECT * FROM cl",
        "cleanup_keeper": A.CLEANUP + " SELECT cleanup_group_number, path, id FROM k WHERE place = 1",
        "cleanup_proposals": A.CLEANUP + " SELECT * FROM pr",
        "cleanup_proposals_all": A.CLEANUP + """, ka AS (SELECT n.cleanup_group_number, n.group_risk, f.*, row_number() OVER (PARTITION BY n.cleanup_group_number ORDER BY score, length(path), path, id) AS place
  FROM f JOIN n USING (digest, size_bytes) WHERE n.group_risk = 'low')
SELECT a.cleanup_group_number, a.group_risk, a.digest, a.size_bytes, b.path AS keeper_path, a.path AS candidate_path, a.id FROM ka a JOIN ka b ON a.cleanup_group_number = b.cleanup_group_number AND b.place = 1 WHERE a.place > 1""",
        "cleanup_chosen_groups": A.CLEANUP + " SELECT * FROM n WHERE cleanup_group_number IN (2, 5, 8)",
        "cleanup_manifest": A.CLEANUP + " SELECT cleanup_group_number AS group_number, group_risk, 'yes' AS automatic_cleanup_eligible, 'same-folder-obvious-numbered-copy' AS eligibility_reason, digest, size_bytes, keeper_path, candidate_path, 'rule ' || CAST(id % 3 AS VARCHAR) AS classification_reason FROM pr",
        "cleanup_keeper_lists": A.KEEPERS,
        "plain_names": "SELECT doc_id, [" + ", ".join(f"'{x}'" for _, x in A.NAMES) + f"][doc_id % {len(A.NAMES)} + 1] AS plain, CAST(doc_id % {len(A.NAMES)} IN (1, 2, 4, 6) AS INTEGER) AS copy_score FROM documents",
        "report_all_files": A.PLAIN + f""" SELECT 'scan' AS scan_id, size_bytes AS apparent_size_bytes, CASE WHEN allocated_bytes < size_bytes THEN 'yes' ELSE 'no' END AS sparse, digest AS hash, substr(digest, 1, 16) AS sample_hash, 'sha256' AS algorithm,
  'ok' AS status, '' AS error, size_bytes AS logical_bytes_read, printf('%.6f', id / 8.0::DOUBLE) AS elapsed_seconds, CASE WHEN id % 9 = 0 THEN id - 1 END AS reused_from_file_id, {A.REPORT} FROM inv""",
        "report_duplicates": A.PLAIN + A.GROUPS + f""" SELECT group_number AS duplicate_group, CASE WHEN physical_copy_count = 1 THEN 'hardlink_aliases' ELSE 'physical_duplicates' END AS group_kind,
  CASE WHEN physical_copy_count = 1 OR size_bytes = 0 THEN 'no' ELSE 'review' END AS cleanup_candidate, 'sha256' AS algorithm, digest AS hash, size_bytes AS apparent_size_bytes, path_count, physical_copy_count, logical_duplicate_bytes,
  total_allocated_bytes AS total_unique_allocated_bytes, reclaimable_min_bytes AS estimated_reclaimable_min_bytes, reclaimable_max_bytes AS estimated_reclaimable_max_bytes, CASE WHEN contains_sparse > 0 THEN 'yes' ELSE 'no' END AS contains_sparse_file,
  CASE WHEN physical_copy_count = 1 THEN 'yes' ELSE 'no' END AS same_physical_file_only, group_risk AS group_cleanup_risk, {A.REPORT} FROM inv JOIN grp USING (digest, size_bytes)""",
        "report_path_findings": A.path_audit_sql() + """ SELECT 'scan' AS scan_id, severity, issue_codes, item_type, '/r' AS root, relative_path AS relative_windows_path, '/r/' || relative_path AS scanned_path, lower(hex('/r/' || relative_path)) AS path_bytes_hex,
  projected_chars AS actual_scanned_path_chars, projected_chars - 3 AS relative_path_chars, 0 AS windows_prefix_length, projected_chars AS projected_windows_path_chars, 200 AS path_warning_chars, 240 AS office_path_limit, 259 AS hard_path_limit,
  name_chars, 100 AS filename_limit, longest_directory_name, longest_directory_chars, 100 AS directory_name_limit, over_hard_limit AS characters_over_hard_limit, recommendation FROM chk WHERE severity <> 'none'""",
        "cleanup_estimate": A.CLEANUP + " SELECT count(*) AS candidates, coalesce(sum(size_bytes), 0)::BIGINT AS estimated_bytes, count(DISTINCT cleanup_group_number) AS groups FROM pr",
        "incremental_reuse": A.GENERATIONS + " SELECT cur.path, CASE WHEN ok.path IS NULL THEN 'hash' ELSE 'reused' END AS action, ok.digest AS reused_digest FROM cur LEFT JOIN ok ON cur.path = ok.path",
        "resume_sweep": A.GENERATIONS + " SELECT CASE WHEN ok.path IS NULL THEN 'hash' ELSE 'kept' END AS action, count(*) AS n FROM cur LEFT JOIN ok ON cur.path = ok.path GROUP BY ALL",
        "hardlink_reuse": A.PLAIN + ", f AS (SELECT id, first(id) OVER (PARTITION BY device, inode, size_bytes ORDER BY path, id) AS first_id FROM inv) SELECT id, first_id, CASE WHEN id = first_id THEN 'ok' ELSE 'reused' END AS link_status FROM f",
        "snapshot_upsert": """WITH b AS (SELECT doc_id AS id, '/' || source || '/doc' || CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents)
  SELECT path, size_bytes, CASE WHEN id % 10 = 3 AND id % 8 = 0 THEN id * 1000 - 1 ELSE id * 1000 END AS mtime_ns, CASE WHEN id % 10 = 3 THEN 1 ELSE 2 END AS seen_generation FROM b""",
        "prefix_excludes": A.PLAIN + " SELECT id, path FROM inv WHERE NOT (" + " OR ".join(_UNDER.format(e) for e in EXCLUDES) + ")",
        "nested_roots": A.PLAIN + " SELECT id, CASE WHEN starts_with(path, '/src1/en/') THEN '/src1/en' WHEN starts_with(path, '/src1/') THEN '/src1' WHEN starts_with(path, '/src10/') THEN '/src10' ELSE '/' END AS root, CASE WHEN starts_with(path, '/src1/en/') THEN 3 WHEN starts_with(path, '/src1/') THEN 2 WHEN starts_with(path, '/src10/') THEN 4 ELSE 1 END::BIGINT AS root_id FROM inv",
        "longest_prefix_mount": A.PLAIN + """, m(device, mount_point, filesystem_type, mount_source) AS (VALUES (1, '/', 'ext4', '/dev/a'), (1, '/src1', 'xfs', '/dev/b'), (1, '/src1/en', 'xfs', '/dev/c'), (2, '/src1', 'btrfs', '/dev/d')),
j AS (SELECT inv.id, inv.path, m.*, row_number() OVER (PARTITION BY inv.id ORDER BY length(m.mount_point) DESC NULLS LAST) AS rn FROM inv LEFT JOIN m ON inv.device = m.device AND (m.mount_point = '/' OR inv.path = m.mount_point OR starts_with(inv.path, m.mount_point || '/')))
SELECT id, coalesce(mount_point, path) AS mount_point, coalesce(filesystem_type, 'unknown') AS filesystem_type, coalesce(mount_source, 'unknown') AS mount_source FROM j WHERE rn = 1""",
        "latest_completed_scan": A.SCANS + _SCAN.format(where="state = 'completed' AND NOT path_audit_only AND algorithm = 'sha256'", order="ended_utc DESC, started_utc DESC, scan_id"),
        "latest_resumable_scan": A.SCANS + _SCAN.format(where="state IN ('running', 'interrupted', 'failed', 'disk_full')", order="started_utc DESC, scan_id"),
        "latest_report_scan": A.SCANS + _SCAN.format(where="true", order="started_utc DESC, scan_id"),
        "iso_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS iso FROM events",
        "utf16_lengths": "SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS INTEGER) AS utf16_chars FROM documents",
    }
