"""Which root, mount or exclusion a path belongs to, and which scan a report reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import within


def excluded(paths: DataFrame, excludes: Sequence[str]) -> DataFrame:
    """Paths that no exclusion covers."""
    keep = F.lit(True)
    for e in excludes:
        keep = keep & ~within(F.col("path"), F.lit(e))
    return paths.filter(keep)


def _ancestors(path):
    """The path and all its parents, / included."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, F.lit(1), i))))


#: Prefixes that are sent along with the plan at most; beyond that, distinct paths meet them in a join.
INLINE = 1000


def longest_prefix(paths: DataFrame, prefixes: DataFrame, prefix_column: str, extra: list[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each row of paths with its longest covering prefix and that one's extra columns, nulls where none covers it. Of equal prefixes the one with the greatest extra columns counts."""
    named = prefixes.select(F.concat_ws("\0", *[F.col(k).cast("string") for k in keys], prefix_column).alias("key"), F.struct(prefix_column, *extra).alias("found"))
    named = named.groupBy("key").agg(F.max("found").alias("found"))
    ancestors = F.transform(_ancestors(F.col("path")), lambda a: F.concat(*[x for k in keys for x in (F.col(k).cast("string"), F.lit("\0"))], a))
    fields = [F.col(f"found.{c}").alias(c) for c in (prefix_column, *extra)]
    if named.limit(INLINE + 1).count() <= INLINE:
        # one row, a map of all prefixes: no path is shuffled or repeated
        known = named.agg(F.map_from_entries(F.collect_list(F.struct("key", "found"))).alias("known"))
        covering = F.filter(ancestors, lambda a: F.map_contains_key(F.col("known"), a))
        best = paths.join(F.broadcast(known)).withColumn("found", F.try_element_at("known", F.try_element_at(covering, F.lit(-1))))
        return best.select(*[best[c] for c in paths.columns], *fields)
    asked = ["path", *keys]
    spread = paths.select(*asked).distinct().select(*asked, F.posexplode(ancestors).alias("depth", "key"))
    best = spread.join(named, "key").groupBy(*asked).agg(F.max_by("found", "depth").alias("found")).alias("best")
    same = [F.col(f"paths.{c}").eqNullSafe(F.col(f"best.{c}")) for c in asked]
    return paths.alias("paths").join(best, same, "left").select("paths.*", *fields)


def owned_by_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """A file beneath nested roots belongs to the innermost."""
    return longest_prefix(paths, roots, "root", ["root_id"])


def mounted(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """The mount point of the file's device with the longest matching path; unknown where there is none."""
    out = longest_prefix(paths, mounts, "mount_point", ["filesystem_type", "mount_source"], ["device"])
    return out.select(*paths.columns, F.coalesce("mount_point", "path").alias("mount_point"), F.coalesce("filesystem_type", F.lit("unknown")).alias("filesystem_type"), F.coalesce("mount_source", F.lit("unknown")).alias("mount_source"))


def with_disk_uuid(mounted_paths: DataFrame, uuids: DataFrame) -> DataFrame:
    """uuids: mount_source, filesystem_uuid. '' where the source has none."""
    return mounted_paths.join(uuids.groupBy("mount_source").agg(F.max("filesystem_uuid").alias("filesystem_uuid")), "mount_source", "left").select(*mounted_paths.columns, F.coalesce("filesystem_uuid", F.lit("")).alias("filesystem_uuid"))


def latest_scan(scans: DataFrame, purpose: str = "completed", algorithm: str | None = None) -> DataFrame:
    """At most one scan. purpose: completed, resumable, cleanup or report (any state)."""
    if purpose == "resumable":
        return scans.filter(F.col("state").isin("running", "interrupted", "failed", "disk_full")).orderBy(F.desc("started_utc"), "scan_id").limit(1)
    if purpose == "report":
        return scans.orderBy(F.desc("started_utc"), "scan_id").limit(1)
    done = scans.filter((F.col("state") == "completed") & ~F.col("path_audit_only"))
    done = done.filter(F.col("algorithm") == algorithm) if algorithm else done
    return done.orderBy(F.desc("ended_utc"), F.desc("started_utc"), "scan_id").limit(1)
