"""Registered queries on model expansion and lent fields, and the SQL that restates them: parts are type declarations, pages endpoints that name them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expansion
from .estate import Estate
from .facts import _text


def _declarations(e: Estate) -> DataFrame:
    """Two declarations for every tenth name, generic ones, chains of fields longer than any depth and back, names without a declaration."""
    k = F.col("p_partkey")
    field = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("type_name"))
    fields = F.array(field("Next", _text("M?", "p_partkey + 1")), field("Items", _text("List<M?>", "p_partkey div 2")), field("Gen", _text("M?<int>", "p_partkey - p_partkey % 7")), field("Own", F.lit("T")))
    return e.raw("part").select(_text("model:?", "p_partkey").alias("decl_id"), _text("M?", "CASE WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey END").alias("name"), F.when(k % 7 == 0, 1).otherwise(0).alias("arity"),
        (k % 20).alias("project_id"), (k % 20 % 5).alias("repo"), _text("f?", "p_partkey % 4").alias("path"), k.alias("span_start"), F.when(k % 7 == 0, F.array(F.lit("T"))).alias("type_params"), fields.alias("fields"), "p_partkey")


def _reach(e: Estate) -> DataFrame:
    line = e.raw("lineitem").select((F.col("l_orderkey") % 20).alias("project_id"), (F.col("l_suppkey") % 20).alias("target_id"))
    return line.filter("(project_id + target_id) % 3 = 0 and project_id % 2 = 0").distinct().withColumn("rank", F.col("target_id"))


def _expansion(spark: SparkSession, folder: str) -> expansion.Expansion:
    e = Estate(spark, folder)
    decls, n = _declarations(e), e.raw("part").count()
    pages = e.raw("pages").select(_text("ep:?", "page_id").alias("endpoint_id"), (F.col("page_id") % 20).alias("project_id"), (F.col("page_id") % 20 % 5).alias("repo"), "page_id")
    use = lambda kind, detail, text: pages.select("endpoint_id", F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), "project_id", "repo", text.alias("type_name"))
    uses = use("accepts", "body", _text("M?", f"page_id * 70 % {n}")).union(use("returns", "200", _text("Task<List<Acme.M?>>", f"page_id * 30 % {n}")))
    contracts = decls.filter("project_id % 10 = 3 and p_partkey % 4 = 1 and p_partkey % 8 <> 5")
    return expansion.expand_models(uses, decls, contracts, _reach(e))


def model_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return _expansion(spark, folder).edges


def expanded_models(spark: SparkSession, folder: str) -> DataFrame:
    return _expansion(spark, folder).models.withColumn("opaque", F.col("opaque").cast("int"))


def ambiguous_models(spark: SparkSession, folder: str) -> DataFrame:
    return _expansion(spark, folder).ambiguous.withColumn("node_ids", F.array_join("node_ids", ","))


def inherited_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    name = lambda text, column: F.struct(_text(text, column).alias("name"), F.lit("string").alias("type_name"))
    k = F.col("p_partkey")
    properties = F.array(name("P?", "p_partkey % 5"), name("Q?", "p_partkey % 3"), name("R?", "p_partkey"))
    kind = F.when(k % 6 == 5, "struct").when(k % 6 == 4, "enum").when(k % 2 == 0, "class").otherwise("record")
    bases = F.array(_text("IThing?", "p_partkey"), _text("Acme.Core.M?", "p_partkey div 2"), _text("M?<int>", "p_partkey div 3"))
    decls = _declarations(e).withColumns({"kind": kind, "bases": bases, "properties": properties, "fields": F.concat(F.array(name("P?", "p_partkey % 4"), name("X?", "p_partkey")), properties)})
    return expansion.with_base_fields(decls, _reach(e)).select("decl_id", "base_id", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("fields"))


QUERIES = {f.__name__: f for f in (model_expansion, expanded_models, ambiguous_models, inherited_fields)}

_TYPES = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part),
d AS (SELECT p_partkey AS k, 'M' || (CASE WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey END) AS name, CAST(p_partkey % 7 = 0 AS int) AS arity, p_partkey % 20 AS p, 'f' || p_partkey % 4 AS path FROM part),
reach AS (SELECT DISTINCT l_orderkey % 20 AS p, l_suppkey % 20 AS t FROM lineitem WHERE (l_orderkey % 20 + l_suppkey % 20) % 3 = 0 AND l_orderkey % 2 = 0)"""
_FOUND = """every AS (SELECT a.name, a.arity, a.p, d.k, d.path, d.arity = a.arity AS same, CASE WHEN d.p = a.p THEN 0 WHEN t IS NOT NULL THEN 100 + t WHEN d.p % 5 = a.p % 5 THEN 200 ELSE 300 END AS lvl
  FROM asked a JOIN d USING (name) LEFT JOIN reach ON reach.p = a.p AND t = d.p),
fit AS (SELECT * FROM every QUALIFY same OR NOT coalesce(bool_or(same) OVER (PARTITION BY name, arity, p), false)),
res AS (SELECT *, count(*) OVER (PARTITION BY name, arity, p) AS many FROM (SELECT * FROM fit QUALIFY lvl = min(lvl) OVER (PARTITION BY name, arity, p)))"""
_WALK = f"""{_TYPES}, f AS (SELECT k, 'Next' AS field, 'M' || (k + 1) AS name, 0 AS arity, p FROM d UNION ALL SELECT k, 'Items', 'M' || (k // 2), 0, p FROM d UNION ALL SELECT k, 'Gen', 'M' || (k - k % 7), 1, p FROM d
  UNION ALL SELECT k, 'Own', 'T', 0, p FROM d WHERE k % 7 <> 0),
u AS (SELECT page_id, 'accepts' AS kind, 'body' AS detail, 'M' || (page_id * 70 % n) AS name, 0 AS arity, page_id % 20 AS p FROM pages, n UNION ALL SELECT page_id, 'returns', '200', 'M' || (page_id * 30 % n), 0, page_id % 20 FROM pages, n),
asked AS (SELECT name, arity, p FROM f UNION SELECT name, arity, p FROM u), {_FOUND},
own AS (SELECT f.k, f.field, f.name, f.arity, f.p, res.k AS child, coalesce(many, 0) AS many FROM f LEFT JOIN res USING (name, arity, p)),
walk AS (SELECT res.k, 1 AS depth FROM u JOIN res USING (name, arity, p) UNION SELECT k, 1 FROM d WHERE p % 10 = 3 AND k % 4 = 1 AND k % 8 <> 5
  UNION SELECT child, depth + 1 FROM walk JOIN own USING (k) WHERE depth < 6 AND child IS NOT NULL),
least AS (SELECT k, min(depth) AS depth FROM walk GROUP BY k), open AS (SELECT * FROM least WHERE depth < 6)"""
ORACLES = {
    "model_expansion": f"""{_WALK} SELECT DISTINCT kind, 'ep:' || page_id AS from_id, coalesce('model:' || res.k, 'model:?:' || u.name) AS to_id, detail, CASE WHEN many > 1 THEN 0 ELSE 2 END AS confidence FROM u LEFT JOIN res USING (name, arity, p)
        UNION SELECT 'fieldOf', 'model:' || k, coalesce('model:' || child, 'model:?:' || name), field, CASE WHEN many > 1 THEN 0 ELSE 2 END FROM own JOIN open USING (k)""",
    "expanded_models": f"""{_WALK}, named AS (SELECT u.name, 1 AS depth FROM u LEFT JOIN res USING (name, arity, p) WHERE res.k IS NULL UNION ALL SELECT name, depth + 1 FROM own JOIN open USING (k) WHERE child IS NULL)
        SELECT 'model:' || k AS id, depth, 0 AS opaque FROM least UNION ALL SELECT 'model:?:' || name, min(depth), 1 FROM named GROUP BY name""",
    "ambiguous_models": f"""{_WALK}, said AS (SELECT name, arity, p, 1 AS depth FROM u UNION SELECT name, arity, p, depth + 1 FROM own JOIN open USING (k)),
        best AS (SELECT name, arity, p FROM said WHERE EXISTS (SELECT 1 FROM res r WHERE r.name = said.name AND r.arity = said.arity AND r.p = said.p AND many > 1) QUALIFY row_number() OVER (PARTITION BY name, p ORDER BY depth, arity) = 1)
        SELECT name, p AS project_id, string_agg('model:' || k, ',' ORDER BY path, k) AS node_ids FROM best JOIN res USING (name, arity, p) GROUP BY ALL""",
    "inherited_fields": f"""{_TYPES}, b AS (SELECT k, p, 2 AS place, 'M' || (k // 2) AS name, 0 AS arity FROM d UNION ALL SELECT k, p, 3, 'M' || (k // 3), 1 FROM d), asked AS (SELECT DISTINCT name, arity, p FROM b), {_FOUND},
        one AS (SELECT name, arity, p, arg_min(k, (path, k)) AS base FROM res GROUP BY ALL),
        chosen AS (SELECT b.k, base FROM b JOIN one USING (name, arity, p) WHERE base % 6 < 4 QUALIFY row_number() OVER (PARTITION BY b.k ORDER BY place) = 1),
        f AS (SELECT k, i, name FROM (SELECT k, unnest(['P' || k % 4, 'X' || k, 'P' || k % 5, 'Q' || k % 3, 'R' || k]) AS name, unnest([1, 2, 3, 4, 5]) AS i FROM d)
          UNION ALL SELECT k, i, name FROM (SELECT k, unnest(['P' || base % 5, 'Q' || base % 3, 'R' || base]) AS name, unnest([6, 7, 8]) AS i FROM chosen)),
        once AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY i) = 1)
        SELECT 'model:' || k AS decl_id, 'model:' || any_value(base) AS base_id, string_agg(name, ',' ORDER BY i) AS fields FROM once LEFT JOIN chosen USING (k) GROUP BY k""",
}
