"""Models from the types that endpoints name: expansion over fields with names resolved on the way, and fields that a base type lends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.facts import unwrap_types
from .declarations import resolve_types
from .graph import written

REF = ["name", "arity", "project_id", "repo"]
#: Confidences: of a name with one declaration or none, and of each of several.
CLEAR, AMBIGUOUS = 2, 0


@dataclass
class Expansion:
    """edges (kind, from_id, to_id, detail, confidence), models (id, depth, opaque) and ambiguous (name, project_id, node_ids in the order of path and position)."""

    edges: DataFrame
    models: DataFrame
    ambiguous: DataFrame


def opaque_id(name: str = "name"):
    return F.concat(F.lit("model:?:"), F.col(name))


def resolve_new(asked: DataFrame, decls: DataFrame, reach: DataFrame) -> DataFrame:
    """(REF, decl_id or null, candidates) of distinct asked names."""
    refs = asked.withColumn("ref_id", F.to_json(F.struct(*REF)))
    found = resolve_types(refs, decls, reach)
    return written(refs.join(found, "ref_id", "left").select(*REF, "decl_id", F.coalesce("candidates", F.lit(0)).alias("candidates")))


def expand_models(uses: DataFrame, decls: DataFrame, contracts: DataFrame, reach: DataFrame, most_depth: int = 6) -> Expansion:
    """From uses (endpoint_id, kind, detail, project_id, repo, type_name) and contracts (decl_id), both at depth 1, the models that fields lead to, level by level: a declaration (decl_id, name,
    arity, project_id, repo, path, span_start, type_params, fields array<struct<name, type_name>>) is expanded once, at its least depth, if that is below most_depth, so the order of rows has no
    say. A level resolves the names that no level before has asked for, each (name, arity, project) once. Names without a declaration are opaque models; of several declarations all are kept at
    the least confidence. Own type parameters are no models. Nulls: fields or type_params that are null are none, a null type_name names nothing."""
    params = F.coalesce("type_params", F.array().cast("array<string>"))
    own = decls.select(F.col("decl_id").alias("from_id"), params.alias("params"), "project_id", "repo", F.explode("fields").alias("f"))
    own = own.select("from_id", "params", "project_id", "repo", F.col("f.name").alias("detail"), F.inline(unwrap_types(F.col("f.type_name"))))
    fields = written(own.filter(~F.array_contains("params", F.col("name"))).select("from_id", F.lit("fieldOf").alias("kind"), "detail", *REF).distinct())
    refs = uses.select(F.col("endpoint_id").alias("from_id"), "kind", "detail", "project_id", "repo", F.inline(unwrap_types(F.col("type_name")))).select("from_id", "kind", "detail", *REF).distinct()
    seen, frontier = None, contracts.select(F.col("decl_id").alias("id")).distinct()
    answers, edges, asked_at = None, None, None
    for depth in range(1, most_depth + 1):
        asked = refs.select(*REF).distinct()
        fresh = asked if answers is None else asked.join(answers.select(*REF).distinct(), REF, "left_anti")
        new = resolve_new(fresh, decls, reach)
        answers = new if answers is None else answers.unionByName(new)
        found = refs.join(answers, REF).withColumn("to_id", F.coalesce("decl_id", opaque_id()))
        found = written(found.select("kind", "from_id", "to_id", "detail", F.when(F.col("candidates") > 1, AMBIGUOUS).otherwise(CLEAR).alias("confidence"), F.col("decl_id").isNull().alias("opaque")).distinct())
        edges = found if edges is None else edges.unionByName(found)
        times = asked.withColumn("depth", F.lit(depth))
        asked_at = times if asked_at is None else asked_at.unionByName(times)
        reached = found.select(F.col("to_id").alias("id"), "opaque").distinct()
        reached = reached.unionByName(frontier.withColumn("opaque", F.lit(False))).distinct() if depth == 1 else reached
        fresh = reached if seen is None else reached.join(seen, "id", "left_anti")
        level = written(fresh.select("id", F.lit(depth).alias("depth"), "opaque"))
        seen = level if seen is None else seen.unionByName(level)
        if depth == most_depth or level.isEmpty():
            break
        refs = fields.join(level.filter("not opaque").select(F.col("id").alias("from_id")), "from_id")
    order = decls.select("decl_id", "path", "span_start")
    first = asked_at.join(answers.filter("candidates > 1"), REF).join(order, "decl_id")
    groups = first.groupBy("name", "project_id", "depth", "arity").agg(F.array_sort(F.collect_set(F.struct("path", "span_start", "decl_id"))).alias("found"))
    ambiguous = groups.groupBy("name", "project_id").agg(F.min_by(F.transform("found", lambda x: x["decl_id"]), F.struct("depth", "arity")).alias("node_ids"))
    return Expansion(edges.select("kind", "from_id", "to_id", "detail", "confidence").distinct(), seen, ambiguous)


def with_base_fields(decls: DataFrame, reach: DataFrame) -> DataFrame:
    """(decl_id, base_id, fields): decls (decl_id, name, arity, kind, project_id, repo, path, span_start, bases array<string>, fields and properties array<struct<name, type_name>>) with the public
    properties of the first base that resolves to a class or record, a name that is there already keeping its first place. Of a base with several declarations the first by path and position counts."""
    bases = decls.select("decl_id", "project_id", "repo", F.posexplode("bases").alias("place", "text"))
    plain = F.substring_index(F.substring_index("text", "<", 1), ".", -1)
    named = bases.select("decl_id", "place", "project_id", "repo", plain.alias("plain"), F.get(unwrap_types(F.col("text")), F.lit(0)).alias("ref"))
    asked = written(named.select("decl_id", "place", "project_id", "repo", F.coalesce("ref.name", "plain").alias("name"), F.col("ref.arity").alias("arity")))
    known = resolve_new(asked.select(*REF).distinct(), decls, reach).filter("decl_id is not null")
    target = decls.select(F.col("decl_id").alias("base_id"), "kind", F.struct("path", "span_start").alias("at"))
    first = known.withColumnRenamed("decl_id", "base_id").join(target, "base_id").groupBy(*REF).agg(F.min_by(F.struct("base_id", "kind"), "at").alias("base"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in REF]
    chosen = asked.alias("a").join(first.filter(F.col("base.kind").isin("class", "record")).alias("b"), same).groupBy("decl_id").agg(F.min_by("b.base.base_id", "place").alias("base_id"))
    lent = chosen.join(decls.select(F.col("decl_id").alias("base_id"), F.col("properties").alias("lent")), "base_id")
    out = decls.select("decl_id", "fields").join(lent, "decl_id", "left")
    none = F.array().cast(decls.schema["fields"].dataType)
    every = F.concat(F.coalesce("fields", none), F.coalesce("lent", none))
    once = F.filter(every, lambda f, i: F.array_position(F.transform(every, lambda g: g["name"]), f["name"]) == i + 1)
    return out.select("decl_id", "base_id", once.alias("fields"))
