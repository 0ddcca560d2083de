"""Path-length policy: findings, their severity and recommendation, and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import utf16_length

#: Fixed value: the longest component that file systems take.
COMPONENT_LIMIT = 255
#: Texts of recommendations, around the number of characters.
ADVICE = [
    "Shorten the filename or folder hierarchy by at least ",
    " UTF-16 character(s) to return below the warning threshold.",
    "Shorten the filename by at least ",
    "Shorten the longest directory name by at least ",
    " UTF-16 character(s).",
]


@dataclass(frozen=True)
class PathPolicy:
    warning: int = 200
    office: int = 240
    hard: int = 259
    filename: int = 100
    directory: int = 100
    prefix: int = 0


def audited(items: DataFrame, policy: PathPolicy = PathPolicy()) -> DataFrame:  # noqa: B008
    """items: id, relative_path, scanned_path, item_type. All items, with lengths, issue codes, severity and recommendation."""
    parts = F.filter(F.split("relative_path", "/"), lambda x: x != "")
    is_dir = F.col("item_type") == "directory"
    one = items.withColumn("parts", parts).withColumn("directories", F.when(is_dir, F.col("parts")).otherwise(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0)))))
    two = one.withColumn("lengths", F.transform("directories", utf16_length)).withColumn("longest_directory_chars", F.coalesce(F.array_max("lengths"), F.lit(0)))
    projected = F.lit(policy.prefix) + utf16_length(F.col("relative_path")) if policy.prefix else utf16_length(F.col("scanned_path"))
    three = (
        two.withColumn("longest_directory_name", F.coalesce(F.get("directories", (F.array_position("lengths", F.col("longest_directory_chars")) - 1).cast("int")), F.lit("")))
        .withColumn("name_chars", F.coalesce(utf16_length(F.get("parts", F.size("parts") - 1)), F.lit(0)))
        .withColumn("projected_chars", projected)
    )
    p, name, directory = F.col("projected_chars"), F.col("name_chars"), F.col("longest_directory_chars")
    length = F.when(p > policy.hard, "hard_path_limit_exceeded").when(p >= policy.office, "office_path_risk").when(p >= policy.warning, "path_length_warning")
    long_name, long_directory = ~is_dir & (name > policy.filename), directory > policy.directory
    component = (name > COMPONENT_LIMIT) | (directory > COMPONENT_LIMIT)
    codes = F.array_compact(F.array(length, F.when(long_name, "filename_limit_exceeded"), F.when(long_directory, "directory_name_limit_exceeded"), F.when(component, "filesystem_component_limit_exceeded")))
    severity = F.when((p > policy.hard) | component, "critical").when(p >= policy.office, "high").when((p >= policy.warning) | long_name | long_directory, "warning").otherwise("none")
    characters = lambda n: n.cast("string")
    advice = (
        F.when(p >= policy.warning, F.concat(F.lit(ADVICE[0]), characters(p - policy.warning + 1), F.lit(ADVICE[1])))
        .when(long_name, F.concat(F.lit(ADVICE[2]), characters(name - policy.filename), F.lit(ADVICE[4])))
        .when(severity != "none", F.concat(F.lit(ADVICE[3]), characters(directory - policy.directory), F.lit(ADVICE[4])))
        .otherwise("")
    )
    return three.select(
        "id", "item_type", "relative_path", "projected_chars", "name_chars", "longest_directory_name", "longest_directory_chars",
        F.concat_ws(";", codes).alias("issue_codes"), severity.alias("severity"), F.greatest(p - policy.hard, F.lit(0)).alias("over_hard_limit"), advice.alias("recommendation"),
    )


def findings(checked: DataFrame) -> DataFrame:
    return checked.filter("severity <> 'none'")


def ordered(found: DataFrame) -> DataFrame:
    """Findings in report order: severity, then the longest path, then the path."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    return found.orderBy(rank, F.desc("projected_chars"), "relative_path", "id")


def counters(checked: DataFrame) -> DataFrame:
    n = F.count_if
    return checked.agg(
        F.count("*").alias("examined"),
        n(F.col("item_type") == "file").alias("files"),
        n(F.col("item_type") == "directory").alias("directories"),
        n(F.col("severity") != "none").alias("findings"),
        n(F.col("severity") == "warning").alias("warnings"),
        n(F.col("severity") == "high").alias("high"),
        n(F.col("severity") == "critical").alias("critical"),
    )
