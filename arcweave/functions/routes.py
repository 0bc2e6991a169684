"""Scalar rules on routes, verbs, names, globs, ids and versions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)(?<!\s)\s+\z", "")


def _segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), stripped), lambda s: s != "")


def normalize_route(route: Column) -> Column:
    """Scheme, host, leading tilde, query and fragment go; placeholders become {} before the query is cut, so {id?} survives."""
    text = F.regexp_replace(stripped(F.coalesce(route, F.lit(""))), r"(?s)^.*?://[^/]*", "")
    text = F.regexp_replace(F.regexp_replace(text, "^~+", ""), r"\{[^{}]*\}", "{}")
    return F.lower(F.array_join(_segments(F.regexp_replace(text, r"(?s)[?#].*", "")), "/"))


def lookup_route(route: Column) -> Column:
    """The form in which a query names a route: the query is cut before placeholders are read; no scheme or tilde."""
    text = F.regexp_replace(stripped(F.coalesce(route, F.lit(""))), r"(?s)[?#].*", "")
    return F.lower(F.array_join(_segments(F.regexp_replace(text, r"\{[^{}]*\}", "{}")), "/"))


def combine_routes(prefix: Column, template: Column) -> Column:
    """A rooted template (/x or ~/x) stands alone; else prefix and template; always with one leading slash."""
    own = stripped(F.coalesce(template, F.lit("")))
    rooted = own.startswith("/") | own.startswith("~/")
    joined = F.when(rooted, F.regexp_replace(own, "^~", "")).otherwise(F.concat_ws("/", F.coalesce(prefix, F.lit("")), own))
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(joined, "/"), lambda s: s != ""), "/"))


def replace_tokens(template: Column, controller: Column, action: Column) -> Column:
    """[controller] (without its suffix) and [action], in any case, by the lower-cased names."""
    name = F.lower(F.regexp_replace(controller, "Controller$", ""))
    put = lambda text, token: F.array_join(F.split(text, rf"(?i)\[{token}\]", -1), "\u0001")
    with_name = F.replace(put(template, "controller"), F.lit("\u0001"), name)
    return F.replace(put(with_name, "action"), F.lit("\u0001"), F.lower(action))


def verb_of_method(name: Column) -> Column:
    """GET, POST, ... from a method's name, where a capital or nothing follows; else null."""
    verb = F.regexp_extract(name, r"^(Get|Post|Put|Delete|Patch)(?=$|\p{Lu})", 1)
    return F.when(verb != "", F.upper(verb))


def is_route_like(text: Column) -> Column:
    """Has a slash or a placeholder, no white space, and is no media type."""
    return text.rlike(r"[/{]") & ~text.rlike(r"\s") & ~text.rlike(r"(?i)^(application|text|multipart|image)/")


def glob_match(text: Column, pattern: str) -> Column:
    """Anchored glob with * and ?, in any case."""
    signs = {"*": ".*", "?": "."}
    return text.rlike("(?is)^" + "".join(signs.get(c, c if c.isalnum() else "\\" + c) for c in pattern) + "$")


def any_glob(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (glob_match(text, p) for p in patterns), F.lit(False))


def simple_name(full_name: Column) -> Column:
    return F.regexp_replace(F.substring_index(full_name, ".", -1), "`.*$", "")


def route_suffixes(route: Column) -> Column:
    """All endings of a route that begin behind a slash."""
    parts = F.split(route, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))


def version_key(version: Column) -> Column:
    """Sorts versions: two to four numbers before a dash compare as numbers (a missing one is -1) and stand before all others,
    which compare as text. Mixed lists have no consistent order otherwise."""
    core = F.split(F.substring_index(version, "-", 1), r"\.")
    number = lambda i: F.coalesce(F.get(core, i).try_cast("int"), F.lit(-1))
    valid = F.size(core).between(2, 4) & ~F.exists(core, lambda p: p.try_cast("int").isNull())
    return F.struct(F.when(valid, 1).otherwise(0), *(F.when(valid, number(i)).otherwise(-1) for i in range(4)), version)
