"""Stable ids of nodes and the names inside them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def repo_id(repo: Column) -> Column:
    return _joined("repo:", repo)


def project_id(repo: Column, project: Column) -> Column:
    return _joined("proj:", repo, "/", project)


def package_id(package: Column) -> Column:
    return _joined("pkg:", package)


def endpoint_id(repo: Column, verb: Column, route: Column) -> Column:
    return _joined("ep:", repo, ":", F.upper(verb), ":", route)


def method_id(project: Column, type_name: Column, method: Column) -> Column:
    return _joined("cm:", project, ":", type_name, ".", method)


def site_id(repo: Column, project: Column, type_name: Column, member: Column, line: Column) -> Column:
    return _joined("cs:", repo, "/", project, ":", type_name, ".", member, ":", line)


def model_id(project: Column, full_name: Column) -> Column:
    return _joined("model:", project, ":", full_name)


def name_with_arity(name: Column, type_parameters: Column) -> Column:
    """Name`2 of a type with two parameters; a type without any keeps its name."""
    return F.when(F.size(type_parameters) > 0, F.concat(name, F.lit("`"), F.size(type_parameters).cast("string"))).otherwise(name)


def full_type_name(spaces: Column, outer: Column, own: Column) -> Column:
    """Namespace, the types around from the outermost in, and the type's own name, as array<string> but for the last; null parts are left out."""
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(spaces, none), F.coalesce(outer, none), F.array(own)), ".")


def project_name(project: Column) -> Column:
    """Api of proj:r/Api#2."""
    return F.regexp_replace(F.regexp_replace(project, "^[^/]*/", ""), r"#\d*$", "")
