"""Inventories made of the test tables: each document is a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _risk(modulus: int = 11):
    n = F.col("doc_id") % modulus
    return F.when(n == 0, "critical").when(n == 1, "high").when(n == 2, "medium").otherwise("low")


def inventory(spark: SparkSession, sf_dir: str, blank_every: int = 0, empty_status: str = "ok") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    if blank_every:
        docs = docs.withColumn("text", F.when(F.col("doc_id") % blank_every == 0, "").otherwise(F.col("text")))
    hashed = docs.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    size = F.col("size_bytes")
    allocated = F.when(F.col("doc_id") % 7 == 0, F.floor(size / 2)).otherwise(F.ceil(size / 4096) * 4096)
    root = F.expr("cast(substr(source, 4) AS bigint)")
    # the linked name of a text within a source is its smallest document: an aggregation and a join, as a window would
    # hold all copies of one text in a task
    first = hashed.groupBy(F.col("source").alias("of_source"), F.col("digest").alias("of_digest")).agg(F.min("doc_id").alias("inode"))
    same = F.col("source").eqNullSafe(F.col("of_source")) & F.col("digest").eqNullSafe(F.col("of_digest"))  # rows without text or source stay
    return hashed.join(first, same).select(
        F.col("doc_id").alias("id"), root.alias("root_id"), root.alias("device"), "inode",
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "size_bytes", allocated.cast("long").alias("allocated_bytes"),
        F.when((size == 0) & F.lit(empty_status == "empty"), "").otherwise(F.col("digest")).alias("digest"),
        _risk().alias("cleanup_risk"), F.when(size == 0, empty_status).otherwise("ok").alias("status"),
    )


INVENTORY = """
WITH d0 AS (SELECT doc_id, lang, source, {text} AS text FROM documents),
inv AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS root_id, CAST(substr(source, 4) AS BIGINT) AS device, min(doc_id) OVER (PARTITION BY source, text) AS inode,
    '/' || source || '/' || lang || '/doc' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size_bytes,
    CAST(CASE WHEN doc_id % 7 = 0 THEN floor(strlen(text) / 2) ELSE ceil(strlen(text) / 4096) * 4096 END AS BIGINT) AS allocated_bytes,
    sha256(text) AS digest, CASE doc_id % 11 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS cleanup_risk
  FROM d0
)"""
PLAIN = INVENTORY.format(text="text")
BLANK = INVENTORY.format(text="CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END")

#: Group statistics over the relation `inv`.
GROUPS = """,
phys AS (SELECT digest, size_bytes, device, inode, max(coalesce(allocated_bytes, 0)) AS a, max(CASE WHEN allocated_bytes < size_bytes THEN 1 ELSE 0 END) AS s FROM inv GROUP BY ALL),
ps AS (SELECT digest, size_bytes, count(*) AS physical_copy_count, sum(a) AS t, max(a) AS hi, min(a) AS lo, max(s) AS contains_sparse FROM phys GROUP BY ALL),
pt AS (SELECT digest, size_bytes, count(*) AS path_count, max(CASE cleanup_risk WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS r FROM inv GROUP BY ALL HAVING count(*) > 1),
grp AS (
  SELECT row_number() OVER (ORDER BY size_bytes DESC, path_count DESC, digest) AS group_number, digest, size_bytes, path_count, physical_copy_count,
    CAST(size_bytes * (path_count - 1) AS BIGINT) AS logical_duplicate_bytes, CAST(t AS BIGINT) AS total_allocated_bytes, CAST(t - hi AS BIGINT) AS reclaimable_min_bytes,
    CAST(t - lo AS BIGINT) AS reclaimable_max_bytes, contains_sparse, ['low', 'medium', 'high', 'critical'][r + 1] AS group_risk
  FROM pt JOIN ps USING (digest, size_bytes)
)"""


def report_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with the columns that reports show."""
    n, null = F.col("id"), F.lit(None).cast("long")
    return inventory(spark, sf_dir).withColumns(
        {
            "mtime_ns": n * 1_000_000, "ctime_ns": F.when(n % 5 == 0, null).otherwise(n * 1_000_000_000), "sample_digest": F.substring("digest", 1, 16), "algorithm": F.lit("sha256"), "error": F.lit(""),
            "bytes_read": F.col("size_bytes"), "elapsed_seconds": n / 8, "management_class": F.lit("user-managed"), "classification_confidence": F.lit("medium"),
            "classification_reason": F.concat(F.lit("rule "), (n % 3).cast("string")), "reused_from_file_id": F.when(n % 9 == 0, n - 1),
        }
    )


def report_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select("root_id").distinct().withColumn("root", F.concat(F.lit("/src"), F.col("root_id").cast("string")))


_ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} % 1000000 <> 0 THEN '.' || lpad(CAST({0} % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'"
#: The report columns of a file, over inv.
REPORT = f"""'/src' || CAST(root_id AS VARCHAR) AS root, path, lower(hex(path)) AS path_bytes_hex, allocated_bytes AS allocated_size_bytes, device, inode, {_ISO.format("(id * 1000)")} AS mtime_utc,
  CASE WHEN id % 5 = 0 THEN '' ELSE {_ISO.format("(id * 1000000)")} END AS ctime_utc, 'user-managed' AS management_class, 'medium' AS classification_confidence, 'rule ' || CAST(id % 3 AS VARCHAR) AS classification_reason, cleanup_risk"""


def keeper_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text in several folders, of which one's name begins as another's."""
    files = cleanup_inventory(spark, sf_dir)
    folder = F.get(F.array(*[F.lit(f"/data/{x}") for x in FOLDERS]), (F.col("id") % len(FOLDERS)).cast("int"))
    name = F.concat(F.lit("d"), F.substring("digest", 1, 8), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" ("), F.col("id").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))), F.lit(".txt"))
    return files.withColumn("path", F.concat(folder, F.lit("/"), name))


FOLDERS = ["a", "ab", "b", "c", "d"]
#: What the query of keepers protects, keeps and would rather delete.
LISTS = {"protect": ["/data/c"], "keep": ["/data/b/", "/data/a"], "delete": ["d/*", "d*-?7.txt"]}
KEEPERS = f"""
WITH d AS (SELECT doc_id AS id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size_bytes, CASE WHEN doc_id % 17 = 0 THEN 3 ELSE 1 END AS r FROM documents),
f AS (SELECT *, '/data/' || ['{"', '".join(FOLDERS)}'][id % {len(FOLDERS)} + 1] AS folder, id % 2 = 0 AS marked, 'd' || substr(digest, 1, 8) || CASE WHEN id % 2 = 0 THEN ' (' || id || ')' ELSE '-' || id END || '.txt' AS name FROM d),
g AS (SELECT row_number() OVER (ORDER BY digest, size_bytes) AS cleanup_group_number, digest, size_bytes, max(r) AS r FROM f GROUP BY digest, size_bytes HAVING count(*) >= 2),
k AS (
  SELECT cleanup_group_number, folder || '/' || name AS path, id, row_number() OVER (PARTITION BY cleanup_group_number ORDER BY folder <> '/data/c', CASE folder WHEN '/data/b' THEN 0 WHEN '/data/a' THEN 1 ELSE 2 END,
    folder = '/data/d' OR regexp_matches(name, '^d[^/]*-[^/]7[.]txt$'), marked, length(folder || '/' || name), folder || '/' || name, id) AS place
  FROM f JOIN g USING (digest, size_bytes) WHERE g.r < 3
)
SELECT cleanup_group_number, path, id, place FROM k"""


#: Names that differ in case, in marks, or in characters that fold to others, and their plain names.
NAMES = [
    ("STRASSE.TXT", "strasse.txt"), ("Stra\u00dfe (2).txt", "strasse.txt"), ("\ufb01le copy.TXT", "file.txt"), ("\u039f\u0394\u039f\u03a3.txt", "\u03bf\u03b4\u03bf\u03c3.txt"),
    ("\u03bf\u03b4\u03bf\u03c2 (1).txt", "\u03bf\u03b4\u03bf\u03c3.txt"), ("\u0149a.txt", "\u02bcna.txt"), ("a copy 3.txt", "a.txt"), ("\u017f.txt", "s.txt"),
]


def cleanup_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text share a folder, with copy marks in their names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    rn = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))
    named = docs.withColumn("rn", rn)
    mark = F.when(F.col("rn") == 1, "").when(F.col("rn") % 2 == 0, F.concat(F.lit(" ("), F.col("rn").cast("string"), F.lit(")"))).otherwise(" copy")
    parent = F.when(F.col("lang") == "es", "/data/es/backup").otherwise(F.concat(F.lit("/data/"), "lang"))
    return named.select(
        F.col("doc_id").alias("id"), F.concat(parent, F.lit("/d"), F.substring("digest", 1, 8), mark, F.lit(".txt")).alias("path"), "digest", "size_bytes",
        F.lit(1).cast("long").alias("device"), F.col("doc_id").alias("inode"), F.when(F.col("doc_id") % 17 == 0, "high").otherwise("low").alias("cleanup_risk"), F.lit("ok").alias("status"),
    )


CLEANUP = """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn, sha256(text) AS digest FROM documents),
c AS (
  SELECT doc_id AS id, CASE WHEN lang = 'es' THEN '/data/es/backup' ELSE '/data/' || lang END AS parent, 'd' || substr(digest, 1, 8) || '.txt' AS plain,
    CASE WHEN rn = 1 THEN '' WHEN rn % 2 = 0 THEN ' (' || CAST(rn AS VARCHAR) || ')' ELSE ' copy' END AS mark, digest, CAST(strlen(text) AS BIGINT) AS size_bytes,
    CASE WHEN doc_id % 17 = 0 THEN 3 ELSE 1 END AS r FROM d
), f AS (SELECT *, parent || '/d' || substr(digest, 1, 8) || mark || '.txt' AS path, CASE WHEN mark = '' THEN 0 ELSE 1 END AS score FROM c),
g AS (SELECT digest, size_bytes, count(*) AS path_count, count(DISTINCT id) AS physical_copies, max(r) AS r FROM f GROUP BY ALL HAVING count(DISTINCT id) >= 2),
n AS (SELECT row_number() OVER (ORDER BY digest, size_bytes) AS cleanup_group_number, digest, size_bytes, path_count, physical_copies, CASE WHEN r = 3 THEN 'high' ELSE 'low' END AS group_risk FROM g),
cl AS (
  SELECT cleanup_group_number, group_risk, digest, size_bytes, parent, plain, count(*) AS members, count(DISTINCT id) AS physical_copies
  FROM f JOIN n USING (digest, size_bytes) WHERE group_risk = 'low' AND parent NOT LIKE '%backup%' GROUP BY ALL HAVING count(DISTINCT id) >= 2 AND max(score) = 1 AND min(score) = 0
), k AS (
  SELECT cl.cleanup_group_number, cl.group_risk, f.*, row_number() OVER (PARTITION BY cl.cleanup_group_number, f.parent, f.plain ORDER BY score, length(path), path, id) AS place
  FROM f JOIN cl USING (digest, size_bytes, parent, plain)
), pr AS (
  SELECT a.cleanup_group_number, a.group_risk, a.digest, a.size_bytes, b.path AS keeper_path, a.path AS candidate_path, a.id
  FROM k a JOIN k b ON a.cleanup_group_number = b.cleanup_group_number AND a.parent = b.parent AND a.plain = b.plain AND b.place = 1 WHERE a.place > 1
)"""


def generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(walked now, rows of the scan before)"""
    docs = table(spark, sf_dir, "documents")
    base = docs.select(
        F.concat(F.lit("/"), "source", F.lit("/doc"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size_bytes"),
        (F.col("doc_id") * 1000).alias("mtime_ns"), F.lit(0).cast("long").alias("ctime_ns"), F.lit(1).cast("long").alias("device"), F.col("doc_id").alias("inode"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )
    now = base.filter("id % 10 <> 3").drop("digest")
    before = base.filter("id % 10 <> 4").withColumn("mtime_ns", F.when(F.col("id") % 8 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")))
    return now, before.withColumn("status", F.when(F.col("id") % 19 == 0, "error").otherwise("ok")).withColumn("algorithm", F.lit("sha256"))


GENERATIONS = """
WITH b AS (SELECT doc_id AS id, '/' || source || '/doc' || CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS digest FROM documents),
cur AS (SELECT * FROM b WHERE id % 10 <> 3), ok AS (SELECT * FROM b WHERE id % 10 <> 4 AND id % 8 <> 0 AND id % 19 <> 0)"""


def path_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    base = F.regexp_replace("url", "^[a-z]+://", "")
    relative = F.concat_ws("/", F.array_repeat(base, (F.col("page_id") % 8 + 1).cast("int")))
    return pages.select(F.col("page_id").alias("id"), relative.alias("relative_path"), F.concat(F.lit("/r/"), relative).alias("scanned_path"), F.when(F.col("page_id") % 5 == 0, "directory").otherwise("file").alias("item_type"))


def path_audit_sql(warning: int = 200, office: int = 240, hard: int = 259, filename: int = 100, directory: int = 100) -> str:
    u16 = lambda x: f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
    return f"""
WITH i AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'directory' ELSE 'file' END AS item_type, array_to_string(list_transform(range(page_id % 8 + 1), lambda x: regexp_replace(url, '^[a-z]+://', '')), '/') AS relative_path FROM pages),
p AS (SELECT *, list_filter(string_split(relative_path, '/'), lambda x: x <> '') AS parts, {u16("'/r/' || relative_path")} AS projected_chars FROM i),
q AS (SELECT *, CASE WHEN item_type = 'directory' THEN parts ELSE parts[:len(parts) - 1] END AS dirs, {u16("parts[len(parts)]")} AS name_chars FROM p),
r AS (SELECT *, list_transform(dirs, lambda x: {u16("x")}) AS lens FROM q),
s AS (SELECT *, coalesce(list_max(lens), 0) AS longest_directory_chars, coalesce(dirs[list_position(lens, list_max(lens))], '') AS longest_directory_name FROM r),
t AS (SELECT *, item_type = 'file' AND name_chars > {filename} AS ln, longest_directory_chars > {directory} AS ld, name_chars > 255 OR longest_directory_chars > 255 AS co FROM s),
chk AS (
  SELECT id, item_type, relative_path, projected_chars, name_chars, longest_directory_name, longest_directory_chars,
    concat_ws(';', CASE WHEN projected_chars > {hard} THEN 'hard_path_limit_exceeded' WHEN projected_chars >= {office} THEN 'office_path_risk' WHEN projected_chars >= {warning} THEN 'path_length_warning' END,
      CASE WHEN ln THEN 'filename_limit_exceeded' END, CASE WHEN ld THEN 'directory_name_limit_exceeded' END, CASE WHEN co THEN 'filesystem_component_limit_exceeded' END) AS issue_codes,
    CASE WHEN projected_chars > {hard} OR co THEN 'critical' WHEN projected_chars >= {office} THEN 'high' WHEN projected_chars >= {warning} OR ln OR ld THEN 'warning' ELSE 'none' END AS severity,
    greatest(projected_chars - {hard}, 0) AS over_hard_limit,
    CASE WHEN projected_chars >= {warning} THEN 'Shorten the filename or folder hierarchy by at least ' || (projected_chars - {warning} + 1) || ' UTF-16 character(s) to return below the warning threshold.'
      WHEN ln THEN 'Shorten the filename by at least ' || (name_chars - {filename}) || ' UTF-16 character(s).'
      WHEN ld THEN 'Shorten the longest directory name by at least ' || (longest_directory_chars - {directory}) || ' UTF-16 character(s).' ELSE '' END AS recommendation
  FROM t
)"""


#: Prefixes that give the derived paths of classify_paths one of each class.
PLACES = ["home/u/", "repo/.git/objects/", "usr/share/", "etc/", "var/lib/dpkg/", "opt/app/node_modules/", "Windows/System32/", "work/steamapps/", "boot/", "srv/"]


def placed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = F.get(F.array(*[F.lit(p) for p in PLACES]), (F.col("doc_id") % len(PLACES)).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(place, F.lit("doc"), F.col("doc_id").cast("string")).alias("relative_path"))


_LIST = "[" + ", ".join(f"'{p}'" for p in PLACES) + "]"
CLASSIFIED = f"""
WITH p AS (SELECT doc_id, doc_id AS id, {_LIST}[doc_id % {len(PLACES)} + 1] || 'doc' || CAST(doc_id AS VARCHAR) AS relative_path FROM documents),
c AS (
  SELECT id, relative_path, CASE doc_id % 10 WHEN 1 THEN 'content-addressed' WHEN 2 THEN 'package-managed' WHEN 3 THEN 'system-critical' WHEN 4 THEN 'package-managed' WHEN 5 THEN 'application-managed'
    WHEN 6 THEN 'system-critical' WHEN 7 THEN 'application-managed' WHEN 8 THEN 'system-critical' ELSE 'user-managed' END AS management_class,
    CASE doc_id % 10 WHEN 0 THEN 'medium' WHEN 5 THEN 'medium' WHEN 7 THEN 'medium' WHEN 9 THEN 'medium' ELSE 'high' END AS confidence,
    CASE doc_id % 10 WHEN 1 THEN 'high' WHEN 2 THEN 'critical' WHEN 3 THEN 'critical' WHEN 4 THEN 'high' WHEN 5 THEN 'high' WHEN 6 THEN 'critical' WHEN 7 THEN 'high' WHEN 8 THEN 'critical' ELSE 'low' END AS cleanup_risk
  FROM p
)"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan headers made of events."""
    states = F.array(*[F.lit(s) for s in ("completed", "interrupted", "failed", "running", "completed")])
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("scan-"), F.col("event_id").cast("string")).alias("scan_id"),
        F.get(states, (F.col("event_id") % 5).cast("int")).alias("state"),
        (F.col("event_id") % 997).alias("started_utc"),
        (F.col("event_id") % 991).alias("ended_utc"),
        F.when(F.col("event_id") % 3 == 0, "blake2b").otherwise("sha256").alias("algorithm"),
        (F.col("event_id") % 7 == 0).alias("path_audit_only"),
    )


SCANS = """
WITH s AS (SELECT 'scan-' || CAST(event_id AS VARCHAR) AS scan_id, ['completed', 'interrupted', 'failed', 'running', 'completed'][event_id % 5 + 1] AS state, event_id % 997 AS started_utc, event_id % 991 AS ended_utc,
  CASE WHEN event_id % 3 = 0 THEN 'blake2b' ELSE 'sha256' END AS algorithm, event_id % 7 = 0 AS path_audit_only FROM events)"""
