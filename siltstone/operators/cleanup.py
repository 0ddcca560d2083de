"""Clean-up proposals: groups, clusters of obvious copies, the keeper of each, candidates and the manifest.

Nothing here alters files; siltstone.plans.actions does, if it is told to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import copy_score, extension_of, folded, glob_match, name_of, parent_of, plain_name, risk_of_rank, risk_rank, within

#: Words in a parent folder that rule automatic clean-up out, as substrings.
BLOCKED = [
    "backup", "backups", "archive", "archives", "server", "servers", "world", "worlds", "minecraft", "mods", "libraries", "library", "assets", "cache", "program files", "windows", "appdata", "system32",
    "steamapps", "node_modules", "venv", ".venv", "site-packages", "git", "project", "projects", "build", "dist", "content", "olddrive", "old drive", "old laptop", "oldlaptop",
]
CONTENT = ["digest", "size_bytes"]
CLUSTER = [*CONTENT, "parent", "plain"]


def _identity(name: str) -> Column:
    """Null and 0 are one unknown."""
    return F.when(F.col(name).isNull() | (F.col(name) == 0), -1).otherwise(F.col(name))


def candidates(files: DataFrame, include_empty: bool = True) -> DataFrame:
    statuses = ["ok", "reused"] + (["empty_reported"] if include_empty else [])
    chosen = files.filter(F.col("status").isin(statuses) & (F.col("digest") != ""))
    return chosen.withColumn("device", _identity("device")).withColumn("inode", _identity("inode"))


def cleanup_groups(files: DataFrame, risk: str | None = None) -> DataFrame:
    """Contents with two physical copies or more, numbered by (digest, size) before the risk filter."""
    copies = candidates(files).groupBy(*CONTENT, "device", "inode").agg(F.count("*").alias("paths"), F.max(risk_rank(F.col("cleanup_risk"), 3)).alias("rank"))
    found = copies.groupBy(*CONTENT).agg(F.sum("paths").alias("path_count"), F.count("*").alias("physical_copies"), F.max("rank").alias("rank")).filter("physical_copies >= 2")
    numbered = found.select(F.row_number().over(Window.orderBy(*CONTENT)).cast("long").alias("cleanup_group_number"), *CONTENT, "path_count", "physical_copies", risk_of_rank(F.col("rank")).alias("group_risk"))
    return numbered.filter(F.col("group_risk") == risk) if risk else numbered


def with_cluster(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumn("parent", parent_of(path)).withColumn("plain", plain_name(path)).withColumn("copy_score", copy_score(path)).withColumn("extension", folded(extension_of(name_of(path))))


def clusters(files: DataFrame, risk: str | None = None, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """Copies that automatic clean-up may treat: one folder, one name but for copy marks, one extension, a marked and a plain name, two physical copies."""
    groups = cleanup_groups(files, risk)
    rows = with_cluster(candidates(files).join(groups.select("cleanup_group_number", *CONTENT, "group_risk"), CONTENT))
    pattern = "|".join("\\Q" + b + "\\E" for b in blocked)
    open_ = rows.filter(~folded(F.col("parent")).rlike(pattern)) if pattern else rows
    made = open_.groupBy("cleanup_group_number", "group_risk", *CLUSTER).agg(
        F.count("*").alias("members"),
        F.count_distinct("device", "inode").alias("physical_copies"),
        F.count_distinct("extension").alias("extensions"),
        F.max("copy_score").alias("most"),
        F.min("copy_score").alias("least"),
    )
    return made.filter("physical_copies >= 2 AND extensions = 1 AND most = 1 AND least = 0").select("cleanup_group_number", "group_risk", *CLUSTER, "members", "physical_copies")


def whole_groups(files: DataFrame, risk: str | None = None) -> DataFrame:
    """Every group as one set, whatever its names: for review and quarantine, not for deletion."""
    return cleanup_groups(files, risk).select("cleanup_group_number", "group_risk", *CONTENT, F.lit("").alias("parent"), F.lit("").alias("plain"), F.col("path_count").alias("members"), "physical_copies")


def chosen_groups(found: DataFrame, include: Sequence[int] = (), exclude: Sequence[int] = ()) -> DataFrame:
    """Groups by number; no numbers to include means all, and to exclude wins."""
    number = F.col("cleanup_group_number")
    out = found.filter(number.isin(list(include))) if include else found
    return out.filter(~number.isin(list(exclude))) if exclude else out


def _first_parent(path: Column, parents: Sequence[str]) -> Column:
    out = F.lit(len(parents))
    for i, parent in reversed(list(enumerate(parents))):
        out = F.when(within(path, F.lit(parent)), i).otherwise(out)
    return out


def keepers(files: DataFrame, found: DataFrame, protect: Sequence[str] = (), keep: Sequence[str] = (), delete: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """Members of clusters (or of whole groups), ranked: protected, then by the first folder of `keep` that holds them, then those that no glob of `delete` matches, then plain names, then short, then the path."""
    rows = with_cluster(candidates(files))
    if whole:
        rows = rows.withColumn("parent", F.lit("")).withColumn("plain", F.lit(""))
    members = rows.join(found.select("cleanup_group_number", "group_risk", *CLUSTER), CLUSTER)
    path = F.col("path")
    protected = F.lit(False)
    for p in protect:
        protected = protected | within(path, F.lit(p))
    unwanted = F.lit(False)
    for g in delete:
        unwanted = unwanted | glob_match(path, g)
    order = [F.when(protected, 0).otherwise(1), _first_parent(path, keep), F.when(unwanted, 1).otherwise(0), F.col("copy_score"), F.length(path), path, F.col("id")]
    ranked = members.withColumn("protected", protected).withColumn("place", F.row_number().over(Window.partitionBy("cleanup_group_number", *CLUSTER).orderBy(*order)))
    return ranked


def paired(ranked: DataFrame) -> DataFrame:
    """One candidate per physical identity other than the keeper's: its first path that is not protected."""
    cluster = ["cleanup_group_number", *CLUSTER]
    keeper = ranked.filter("place = 1").select(*cluster, F.col("id").alias("keeper_id"), F.col("path").alias("keeper_path"), F.col("device").alias("keeper_device"), F.col("inode").alias("keeper_inode"))
    rest = ranked.join(keeper, cluster).filter("NOT (device = keeper_device AND inode = keeper_inode)")
    first = rest.withColumn("n", F.row_number().over(Window.partitionBy(*cluster, "device", "inode").orderBy("path", "id"))).filter("n = 1 AND NOT protected")
    reason = F.col("classification_reason") if "classification_reason" in ranked.columns else F.lit("").alias("classification_reason")
    return first.select("cleanup_group_number", "group_risk", *CONTENT, "keeper_id", "keeper_path", F.col("id").alias("candidate_id"), F.col("path").alias("candidate_path"), reason)


def proposals(ranked: DataFrame) -> DataFrame:
    return paired(ranked).select("cleanup_group_number", "group_risk", *CONTENT, "keeper_path", "candidate_path", F.col("candidate_id").alias("id"))


#: By eligibility, whether candidates count as automatic and the reason given.
REASONS = {"automatic": ("yes", "same-folder-obvious-numbered-copy"), "all": ("no", "manual-all-risk-group")}


def manifest(proposed: DataFrame, eligibility: str = "automatic") -> DataFrame:
    automatic, reason = REASONS[eligibility]
    return proposed.select(
        F.col("cleanup_group_number").alias("group_number"), "group_risk", F.lit(automatic).alias("automatic_cleanup_eligible"), F.lit(reason).alias("eligibility_reason"), *CONTENT, "keeper_path", "candidate_path", "classification_reason"
    )


def estimate(proposed: DataFrame) -> DataFrame:
    return proposed.agg(F.count("*").alias("candidates"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("estimated_bytes"), F.count_distinct("cleanup_group_number").alias("groups"))
