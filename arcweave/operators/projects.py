"""Project files: inherited properties, central versions, property expansion, what kind of project it is."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routes import any_glob
from .linking import number_ids

#: Fixed values of the build system and its naming habits.
TEST_SDK, WEB_SDK = "microsoft.net.test.sdk", "microsoft.net.sdk.web"
TEST_SUFFIXES = (".tests", ".unittests", ".integrationtests", ".test")
CLIENT_SUFFIXES = (".client", ".contracts", ".sdk")
KINDS = ("Api", "Client", "Library", "Test", "Other")
PROPERTY = r"\$\(([A-Za-z_][A-Za-z0-9_.-]*)\)"


def folders_above(folder: Column) -> Column:
    """The folder and all above it, the root ('') last."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _seen_from(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", "repo", F.posexplode(folders_above(F.col("folder"))).alias("up", "folder"))


def owners(files: DataFrame, repos: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_id, repo, project_id) of files (file_id, folder): the innermost of repos (repo, folder) and of projects (project_id, folder) at or above the file, null where there is none. A repository
    inside a project takes its files from it. Of several in one folder the least counts."""
    dirs = repos.select("folder", F.lit("repo").alias("what"), F.col("repo").alias("owner")).unionByName(projects.select("folder", F.lit("project").alias("what"), F.col("project_id").alias("owner")))
    dirs = dirs.groupBy("folder", "what").agg(F.min("owner").alias("owner"))
    seen = files.select("file_id", F.posexplode(folders_above(F.col("folder"))).alias("up", "folder")).join(dirs, "folder")
    nearest = lambda what: F.min(F.when(F.col("what") == what, F.struct("up", "owner"))).alias(what)
    found = files.select("file_id").distinct().join(seen.groupBy("file_id").agg(nearest("repo"), nearest("project")), "file_id", "left")
    inside = F.col("repo.up").isNull() | (F.col("project.up") <= F.col("repo.up"))
    return found.select("file_id", F.col("repo.owner").alias("repo"), F.when(inside, F.col("project.owner")).alias("project_id"))


def inherited_properties(projects: DataFrame, properties: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(project_id, name_key, value): of properties (repo, folder, name, value, seq) at or above a project (project_id, repo, folder) the nearest
    folder's first; a project's own (project_id, name, value, seq) win over all, the last of each name. Names are compared in lower case."""
    files = properties.groupBy("repo", "folder", F.lower("name").alias("name_key")).agg(F.min_by("value", "seq").alias("value"))
    found = _seen_from(projects).join(files, ["repo", "folder"]).select("project_id", "name_key", "up", "value")
    if own is not None:
        mine = own.groupBy("project_id", F.lower("name").alias("name_key")).agg(F.max_by("value", "seq").alias("value"))
        found = found.unionByName(mine.withColumn("up", F.lit(-1)))
    return found.groupBy("project_id", "name_key").agg(F.min_by("value", "up").alias("value"))


def central_versions(projects: DataFrame, versions: DataFrame) -> DataFrame:
    """(project_id, package_key, version) of the nearest folder alone that has central versions (repo, folder, package_id, version, seq); a folder
    with no package still counts, as a row with a null package_id."""
    files = versions.select("repo", "folder").distinct()
    nearest = _seen_from(projects).join(files, ["repo", "folder"]).groupBy("project_id", "repo").agg(F.min_by("folder", "up").alias("folder"))
    last = versions.filter("package_id is not null").groupBy("repo", "folder", F.lower("package_id").alias("package_key")).agg(F.max_by("version", "seq").alias("version"))
    return nearest.join(last, ["repo", "folder"]).select("project_id", "package_key", "version")


def expand_properties(value: Column, properties: Column, rounds: int = 5) -> Column:
    """$(Name) by a map of lower-cased names, all at once in each round; a value that still has one becomes unresolved($(Name))."""

    def once(text: Column) -> Column:
        names = F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(1))
        between = F.split(text, PROPERTY, -1)
        put = F.transform(names, lambda n: F.coalesce(F.try_element_at(properties, F.lower(n)), F.concat(F.lit("$("), n, F.lit(")"))))
        return F.array_join(F.transform(F.arrays_zip(between.alias("a"), put.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")

    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), value, lambda text, _: F.when(F.contains(text, F.lit("$(")), once(text)).otherwise(text))
    left = F.regexp_extract(done, PROPERTY, 0)
    return F.when(left != "", F.concat(F.lit("unresolved("), left, F.lit(")"))).otherwise(done)


def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(or_, (F.lower(name).endswith(s) for s in suffixes))


def describe_projects(projects: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds is_test, is_packable, effective_id, version and kind to projects (name, sdk, properties map of lower-cased names, packages
    array<string> of own and inherited references, has_endpoints, has_http), where an empty property counts as none; overrides (name, kind) force a kind, in any case, if there is one."""
    prop = lambda n: expand_properties(F.nullif(F.try_element_at("properties", F.lit(n)), F.lit("")), F.col("properties"))
    yes = lambda n: F.coalesce(F.lower(prop(n)) == "true", F.lit(False))
    no = F.coalesce(F.lower(prop("istestproject")) == "false", F.lit(False))
    has_sdk = F.coalesce(F.exists("packages", lambda p: F.lower(p) == TEST_SDK), F.lit(False))
    test = yes("istestproject") | (~no & (has_sdk | _ends(F.col("name"), TEST_SUFFIXES)))
    packable = F.when(prop("ispackable").isNotNull(), yes("ispackable")).otherwise(prop("packageid").isNotNull() | yes("generatepackageonbuild"))
    out = projects.withColumns({"is_test": test, "is_packable": packable & ~test, "effective_id": F.coalesce(prop("packageid"), prop("assemblyname"), "name"), "version": F.coalesce(prop("version"), prop("packageversion"), prop("versionprefix"))})
    web = F.coalesce(F.lower("sdk") == WEB_SDK, F.lit(False)) | F.coalesce("has_endpoints", F.lit(False))
    client = (F.col("is_packable") | _ends(F.col("name"), CLIENT_SUFFIXES)) & F.coalesce("has_http", F.lit(False))
    kind = F.when(F.col("is_test"), "Test").when(web, "Api").when(client, "Client").when(F.col("is_packable"), "Library").otherwise("Other")
    if overrides is None:
        return out.withColumn("kind", kind)
    known = F.create_map(*(F.lit(x) for k in KINDS for x in (k.lower(), k)))
    forced = overrides.select("name", F.try_element_at(known, F.lower("kind")).alias("_forced")).dropDuplicates(["name"])
    return out.join(forced, "name", "left").withColumn("kind", F.coalesce("_forced", kind)).drop("_forced")


def discover(repos: DataFrame, include: list[str], exclude: list[str], seq: str = "path") -> DataFrame:
    """repos (name, path, ...) whose name some include glob fits and no exclude glob, with old_name and a name that no other has in any case: of several the first by name and path keeps it, later ones get #2, #3, ..."""
    kept = repos.filter(any_glob(F.col("name"), include) & ~any_glob(F.col("name"), exclude))
    keyed = kept.withColumns({"old_name": F.col("name"), "_id": F.lower("name"), "_seq": F.struct("name", seq)})
    numbered = number_ids(keyed, "_id", "_seq")
    return numbered.withColumn("name", F.concat("old_name", F.col("_id").substr(F.length("old_name") + 1, F.length("_id")))).drop("_id", "_seq")


def without_ignored(projects: DataFrame, ignore: list[str]) -> DataFrame:
    """projects (name, ...) whose name no glob fits."""
    return projects.filter(~any_glob(F.col("name"), ignore))
