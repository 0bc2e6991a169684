"""What a repository publishes and consumes, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repo_packages(references: DataFrame, producers: DataFrame) -> DataFrame:
    """(repo, role, package_key, version, project_id, producer_repo): the packages that each repository's projects produce (role publishes) and those that
    they reference of another repository (role consumes). A package belongs to the repository of its first producer by project id; references to
    packages without a producer are external and left out."""
    owner = producers.groupBy("package_key").agg(F.min_by("repo", "project_id").alias("producer_repo"))
    published = producers.select("repo", F.lit("publishes").alias("role"), "package_key", "version", "project_id", F.col("repo").alias("producer_repo"))
    used = references.join(owner, "package_key").filter("producer_repo <> repo").select("repo", F.lit("consumes").alias("role"), "package_key", "version", "project_id", "producer_repo")
    return published.union(used)
