"""Rules on the facts of endpoints and types: parameter binding, responses, type names inside type texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the web framework binds, what it never takes from a request, and which types are plain or wrap others.
BINDINGS = {"FromBody": "body", "FromQuery": "query", "FromRoute": "route", "FromHeader": "header", "FromForm": "form"}
NEVER_BOUND = ("CancellationToken", "HttpContext", "HttpRequest", "ClaimsPrincipal")
PLAIN_PARAMETERS = tuple("string int long short bool decimal double float Guid DateTime DateTimeOffset DateOnly TimeOnly byte char uint ulong".split())
DATA_INTERFACES = tuple("IFormFile IFormFileCollection IEnumerable IList ICollection IReadOnlyList IReadOnlyCollection IDictionary IReadOnlyDictionary ISet IAsyncEnumerable".split())
NO_RESPONSE = tuple("void Task ValueTask IActionResult Task<IActionResult> ValueTask<IActionResult> ActionResult ValueTask<ActionResult> ValueTask<IResult> Task<ActionResult> IResult Task<IResult>".split())
WRAPPERS = frozenset("Task ValueTask ActionResult Ok Created CreatedAtRoute Accepted Results Nullable IAsyncEnumerable".split())
COLLECTIONS = frozenset("IEnumerable List IList ICollection IReadOnlyList IReadOnlyCollection HashSet ISet".split())
DICTIONARIES = frozenset("Dictionary IDictionary IReadOnlyDictionary".split())
PLAIN_TYPES = frozenset(
    "string int long short byte sbyte uint ulong ushort bool decimal double float char object dynamic void String Int32 Int64 Boolean Decimal Double Object Guid DateTime DateTimeOffset DateOnly TimeOnly TimeSpan Uri Stream IFormFile JsonElement JsonDocument CancellationToken IActionResult ActionResult IResult NotFound NoContent BadRequest Ok Unauthorized Forbid Conflict UnprocessableEntity ValidationProblem ProblemDetails HttpResponseMessage Task ValueTask".split()
)
TYPE_REFS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("collection", T.BooleanType()), T.StructField("arity", T.IntegerType())]))


def bind_parameters(params: Column, verb: Column, route: Column) -> Column:
    """array<struct<name, type_name, attrs array<string>, default>> -> array<struct<name, source, type_name, required, default>>: services and
    framework objects go; an attribute, else a placeholder of the route, else verb and type name the source. Null: no parameters."""
    sources = F.create_map(*(F.lit(x) for pair in BINDINGS.items() for x in pair))
    bare = lambda p: F.regexp_replace(p["type_name"], r"\?+$", "")
    attrs = lambda p: F.coalesce(p["attrs"], F.array().cast("array<string>"))
    given = lambda p: F.get(F.filter(F.transform(attrs(p), lambda a: F.try_element_at(sources, a)), lambda s: s.isNotNull()), F.lit(0))

    def service(p: Column) -> Column:
        simple = F.substring_index(F.substring_index(bare(p), "<", 1), ".", -1)
        return given(p).isNull() & simple.rlike(r"^I\p{Lu}") & ~simple.isin(*DATA_INTERFACES)

    def source(p: Column) -> Column:
        in_route = F.lit(False)
        for end in ("}", ":", "?}"):
            in_route = in_route | F.contains(F.lower(route), F.concat(F.lit("{"), F.lower(p["name"]), F.lit(end)))
        body = verb.isin("POST", "PUT", "PATCH") & ~bare(p).isin(*PLAIN_PARAMETERS)
        return F.coalesce(given(p), F.when(in_route, "route").when(body, "body").otherwise("query"))

    asked = F.filter(F.coalesce(params, F.array()), lambda p: p["type_name"].isNotNull() & ~F.array_contains(attrs(p), "FromServices") & ~bare(p).isin(*NEVER_BOUND) & ~service(p))
    return F.transform(asked, lambda p: F.struct(p["name"].alias("name"), source(p).alias("source"), p["type_name"].alias("type_name"), (p["default"].isNull() & ~p["type_name"].endswith("?")).alias("required"), p["default"].alias("default")))


def responses_of(declared: Column, return_type: Column) -> Column:
    """Declared array<struct<status_code int, type_name string>> (a null status is 200), else 200 with the return type, else none."""
    own = F.transform(declared, lambda r: F.struct(F.coalesce(r["status_code"], F.lit(200)).alias("status_code"), F.coalesce(r["type_name"], F.lit("")).alias("type_name")))
    from_type = F.array(F.struct(F.lit(200).alias("status_code"), return_type.alias("type_name")))
    return F.when(F.size(declared) > 0, own).when(return_type.isNotNull() & ~return_type.isin(*NO_RESPONSE), from_type).otherwise(F.array().cast("array<struct<status_code int, type_name string>>"))


def status_of(name: Column) -> Column:
    """404 from Status404NotFound; else null."""
    return F.nullif(F.regexp_extract(name, r"^Status(\d{3})", 1), F.lit("")).cast("int")


def _arguments(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def _names(text: str, collection: bool) -> Iterator[tuple[str, bool, int]]:
    text = text.strip()
    while text.endswith(("?", "]")):
        if text.endswith("]"):
            text, collection = text[: text.rfind("[")] if "[" in text else "", True
        else:
            text = text[:-1]
        text = text.rstrip()
    found = re.fullmatch(r"(?:[\w@.:\s]*[.:]\s*)?(@?\w+)\s*(?:<(.*)>)?", text, re.DOTALL) or re.fullmatch(r".*>\s*\.\s*(@?\w+)\s*(?:<(.*)>)?", text, re.DOTALL)
    if not found:
        return
    name, inside = found.groups()
    if inside is None:
        if name not in PLAIN_TYPES:
            yield name, collection, 0
        return
    parts = _arguments(inside)
    if name in DICTIONARIES:
        parts = parts[1:] if len(parts) == 2 else []
    elif name not in WRAPPERS and name not in COLLECTIONS:
        yield name, collection, len(parts)
    for part in parts:
        yield from _names(part, collection or name in COLLECTIONS or name in DICTIONARIES)


@F.pandas_udf(TYPE_REFS)
def unwrap_types(text: pd.Series) -> pd.Series:
    """The distinct type names that a type text is about, with a collection mark and the number of type arguments; wrappers and plain types go."""
    return text.map(lambda t: [{"name": n, "collection": c, "arity": a} for n, c, a in dict.fromkeys(_names((t or "").replace("global::", ""), False))])


LIMITS = T.StructType([T.StructField("min_args", T.IntegerType()), T.StructField("max_args", T.IntegerType())])


def _parameters(text: str) -> list[str] | None:
    """The parameters of a list that begins behind its opening bracket; None where it isn't closed. Commas and brackets inside strings don't count."""
    out, depth, at, quote, i = [], 0, 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ")" and depth == 0:
            return [p.strip() for p in [*out, text[at:i]] if p.strip()]
        elif c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
        else:
            depth += (c in "<([{") - (c in ">)]}")
        i += 1
    return None


def _limits(signature: str | None, method: str | None) -> tuple[int, int | None]:
    start = (signature or "").find(f" {method}(") if method else -1
    found = _parameters(signature[start + len(method) + 2 :]) if start >= 0 else None
    if found is None:
        return 0, None
    open_ended = [re.match(r"(\[.*?\]\s*)*(this\s+)?params\s", p) is not None for p in found]
    required = sum("=" not in re.sub(r"^(\[.*?\]\s*)+", "", p) and not o for p, o in zip(found, open_ended, strict=True))
    return required, None if any(open_ended) else len(found)


@F.pandas_udf(LIMITS)
def argument_limits(signature: pd.Series, method: pd.Series) -> pd.DataFrame:
    """The least and the greatest number of arguments (null: any) that a method of a signature takes; one that can't be read takes any."""
    found = [_limits(s, m) for s, m in zip(signature, method, strict=True)]
    return pd.DataFrame({"min_args": pd.array([a for a, _ in found], "Int32"), "max_args": pd.array([b for _, b in found], "Int32")})
