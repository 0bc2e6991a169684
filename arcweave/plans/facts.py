"""Queries of the operators on facts, over rows that Spark derives from whole tables, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts
from ..operators import declarations, projects
from .estate import ESTATE_SQL, Estate


def _text(template: str, *columns: str):
    """template with each ? filled from a column or SQL expression."""
    pieces = template.split("?")
    return F.concat(F.lit(pieces[0]), *(x for c, p in zip(columns, pieces[1:], strict=True) for x in (F.expr(c).cast("string"), F.lit(p))))


def type_names(spark: SparkSession, folder: str) -> DataFrame:
    part = Estate(spark, folder).raw("part").select("p_partkey", F.expr("concat('B', p_size)").alias("b"))
    shapes = ("Task<ActionResult<List<?>>>", "Acme.Orders.?~", "Dictionary<string, ?[]>", "Page<?>")
    text = F.when(F.col("p_partkey") % 5 == 4, "Task<IActionResult>")
    for k, shape in enumerate(shapes):
        text = text.when(F.col("p_partkey") % 5 == k, F.replace(_text(shape, "b"), F.lit("~"), F.lit("?")))
    found = part.select("p_partkey", F.inline(facts.unwrap_types(text)))
    return found.withColumn("collection", F.col("collection").cast("int"))


def endpoint_facts(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder).endpoints()
    none = F.array().cast("array<string>")
    param = lambda name, kind, attrs=none, default=None: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type_name"), attrs.alias("attrs"), F.lit(default).cast("string").alias("default"))
    params = F.array(param("id", "int"), param("item", "OrderDto"), param("page", "int?"), param("trace", "string", F.array(F.lit("FromHeader")), "none"), param("orders", "Acme.IOrders"), param("files", "IList<string>"), param("stop", "CancellationToken"))
    bound = facts.bind_parameters(params, F.col("verb"), F.col("route"))
    declared = F.when(F.col("page_id") % 3 == 0, F.array(F.struct(F.lit(None).cast("int").alias("status_code"), F.lit("OrderDto").alias("type_name")), F.struct(facts.status_of(F.lit("Status404NotFound")).alias("status_code"), F.lit(None).cast("string").alias("type_name"))))
    returned = F.when(F.col("page_id") % 3 == 1, "Task<IActionResult>").otherwise("Task<OrderDto>")
    shown = F.array_join(F.transform(bound, lambda p: F.concat_ws(":", p["name"], p["source"], p["required"].cast("int").cast("string"))), ",")
    answers = F.array_join(F.transform(facts.responses_of(declared, returned), lambda r: F.concat_ws(":", r["status_code"].cast("string"), r["type_name"])), ",")
    return e.select("page_id", shown.alias("parameters"), answers.alias("responses"))


def _project_folders(e: Estate) -> DataFrame:
    return e.raw("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("repo"), _text("area?/group?/p?", "c_custkey % 3", "c_custkey % 4", "c_custkey").alias("folder"))


def _files(e: Estate) -> DataFrame:
    at = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, _text("area?", "s_suppkey % 2")).otherwise(_text("area?/group?", "s_suppkey % 2", "s_suppkey % 4"))
    return e.raw("supplier").select(F.col("s_nationkey").alias("repo"), at.alias("folder"), _text("Prop?", "s_suppkey % 2").alias("name"), _text("v?", "s_suppkey").alias("value"), F.col("s_suppkey").alias("seq"))


def inherited_properties(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    own = e.raw("customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("project_id"), F.lit("PROP1").alias("name"), F.lit("own-$(prop0)").alias("value"), F.lit(0).alias("seq"))
    found = projects.inherited_properties(_project_folders(e), _files(e), own)
    of_all = found.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("name_key", "value"))).alias("properties"))
    return found.join(of_all, "project_id").select("project_id", "name_key", projects.expand_properties(F.col("value"), F.col("properties")).alias("value"))


def central_versions(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return projects.central_versions(_project_folders(e), _files(e).select("repo", "folder", F.col("name").alias("package_id"), F.col("value").alias("version"), "seq"))


def file_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as files, nations and a third of the suppliers as repositories, which lie inside others, the other suppliers as projects."""
    e = Estate(spark, folder)
    files = e.raw("customer").select(F.col("c_custkey").alias("file_id"), _text("n?/area?/group?/p?", "c_nationkey", "c_custkey % 3", "c_custkey % 4", "c_custkey").alias("folder"))
    nested = e.raw("supplier").filter("s_suppkey % 3 = 1").select(F.col("s_name").alias("repo"), _text("n?/area?/group?", "s_nationkey", "s_suppkey % 2", "s_suppkey % 4").alias("folder"))
    repos = e.raw("nation").select(F.col("n_name").alias("repo"), _text("n?", "n_nationkey").alias("folder")).union(nested)
    at = F.when(F.col("s_suppkey") % 3 == 0, _text("n?/area?", "s_nationkey", "s_suppkey % 2")).otherwise(_text("n?/area?/group?", "s_nationkey", "s_suppkey % 2", "s_suppkey % 4"))
    return projects.owners(files, repos, e.raw("supplier").filter("s_suppkey % 3 <> 1").select(F.col("s_name").alias("project_id"), at.alias("folder")))


def _reach(e: Estate) -> DataFrame:
    return e.raw("lineitem").select((F.col("l_orderkey") % 50).alias("project_id"), (F.col("l_suppkey") % 10).alias("target_id"), (F.col("l_suppkey") % 10).alias("rank")).filter("(project_id + target_id) % 2 = 0").distinct()


def type_declarations(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    decls = e.raw("part").select(F.col("p_partkey").alias("decl_id"), _text("T?", "p_partkey div 4").alias("name"), (F.col("p_partkey") % 2).alias("arity"), (F.col("p_partkey") % 20).alias("project_id"), (F.col("p_partkey") % 20 % 5).alias("repo"))
    refs = e.raw("lineitem").select(_text("?-?", "l_orderkey", "l_linenumber").alias("ref_id"), _text("T?", "l_partkey div 4").alias("name"), (F.col("l_linenumber") % 3).cast("long").alias("arity"), (F.col("l_orderkey") % 50).alias("project_id"), (F.col("l_orderkey") % 50 % 5).alias("repo"))
    return declarations.resolve_types(refs.distinct(), decls, _reach(e))


def call_links(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    methods = e.raw("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("project_id"), _text("P?", "p_partkey % 10").alias("project_name"), _text("C?", "p_partkey div 8").alias("type_name"), _text("Get?", "p_partkey % 2").alias("method_name"), (F.col("p_partkey") % 3).alias("min_args"), (F.col("p_partkey") % 3 + 1).alias("max_args"))
    declared = F.when(F.col("l_linenumber") % 2 == 0, _text("Acme.P?.C?", "l_suppkey % 10", "l_partkey div 8")).otherwise(_text("C?", "l_partkey div 8"))
    calls = e.raw("lineitem").select(_text("?-?", "l_orderkey", "l_linenumber").alias("call_id"), _text("s?-?", "l_orderkey", "l_linenumber div 2").alias("site_id"), (F.col("l_orderkey") % 50).alias("project_id"), declared.alias("declared_type"), _text("Get?", "l_partkey % 2").alias("member"), (F.col("l_linenumber") % 4).alias("n_args"), F.array(_text("P?", "l_suppkey % 10")).alias("usings"))
    return declarations.link_calls(calls.distinct(), methods, _reach(e))


def project_kinds(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    suffix = F.when(key % 4 == 0, ".Tests").when(key % 4 == 1, ".Client").otherwise("")
    given = lambda when, value: F.when(when, value).otherwise("")
    properties = F.create_map(F.lit("packageid"), given(key % 3 == 0, _text("Id?", "c_custkey")), F.lit("version"), given(key % 2 == 0, _text("1.0.?", "c_custkey")), F.lit("ispackable"), given(key % 7 == 0, F.lit("False")))
    packages = F.when(key % 11 == 0, F.array(F.lit("Microsoft.NET.Test.Sdk"))).otherwise(F.array().cast("array<string>"))
    rows = Estate(spark, folder).raw("customer").select(F.concat(_text("P?", "c_custkey"), suffix).alias("name"), F.when(key % 5 == 0, "Microsoft.NET.Sdk.Web").alias("sdk"), properties.alias("properties"), packages.alias("packages"), (key % 13 == 0).alias("has_endpoints"), (key % 2 == 1).alias("has_http"), "c_custkey")
    forced = rows.filter("c_custkey % 17 = 0").select("name", F.when(key % 2 == 0, "LIBRARY").otherwise("unknown").alias("kind"))
    return projects.describe_projects(rows, forced).select("name", F.col("is_test").cast("int").alias("is_test"), F.col("is_packable").cast("int").alias("is_packable"), "effective_id", "version", "kind")


def merged_types(spark: SparkSession, folder: str) -> DataFrame:
    field = lambda text, column: F.struct(_text(text, column).alias("name"))
    parts = Estate(spark, folder).raw("lineitem").select((F.col("l_partkey") % 5).alias("project_id"), _text("T?", "l_partkey").alias("full_name"), _text("f?", "l_linenumber").alias("path"), F.col("l_orderkey").alias("span_start"), F.array(field("F?", "l_suppkey % 7"), field("G?", "l_linenumber")).alias("fields"))
    return declarations.merge_parts(parts).select("project_id", "full_name", F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("fields"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (type_names, endpoint_facts, inherited_properties, central_versions, file_owners, type_declarations, call_links, project_kinds, merged_types)}
_SEEN = """folders AS (SELECT c_custkey AS project_id, c_nationkey AS repo, 'area' || c_custkey % 3 || '/group' || c_custkey % 4 || '/p' || c_custkey AS folder FROM customer),
files AS (SELECT s_nationkey AS repo, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'area' || s_suppkey % 2 ELSE 'area' || s_suppkey % 2 || '/group' || s_suppkey % 4 END AS folder, 'prop' || s_suppkey % 2 AS name_key, 'v' || s_suppkey AS value, s_suppkey AS seq FROM supplier),
seen AS (SELECT project_id, f.* FROM folders p JOIN files f ON p.repo = f.repo AND (f.folder = '' OR starts_with(p.folder, f.folder || '/')))"""
_REACH = "reach AS (SELECT DISTINCT l_orderkey % 50 AS project_id, l_suppkey % 10 AS target_id FROM lineitem WHERE (l_orderkey % 50 + l_suppkey % 10) % 2 = 0)"
ORACLES = {
    "type_names": """WITH b AS (SELECT p_partkey, 'B' || p_size AS b, p_partkey % 5 AS k FROM part)
        SELECT p_partkey, b AS name, CAST(k IN (0, 2) AS int) AS collection, 0 AS arity FROM b WHERE k < 4 UNION ALL SELECT p_partkey, 'Page', 0, 1 FROM b WHERE k = 3""",
    "endpoint_facts": f"""WITH {ESTATE_SQL} SELECT page_id, 'id:' || CASE WHEN contains(lower(route), '{{id}}') THEN 'route' ELSE 'query' END || ':1,item:' || x || ':1,page:query:0,trace:header:0,files:' || x || ':1' AS parameters,
        CASE page_id % 3 WHEN 0 THEN '200:OrderDto,404:' WHEN 1 THEN '' ELSE '200:Task<OrderDto>' END AS responses FROM (SELECT *, CASE WHEN verb IN ('POST', 'PUT', 'PATCH') THEN 'body' ELSE 'query' END AS x FROM endpoints)""",
    "inherited_properties": f"""WITH {_SEEN}, near AS (SELECT project_id, name_key, value FROM seen QUALIFY row_number() OVER (PARTITION BY project_id, name_key ORDER BY length(folder) DESC, seq) = 1),
        mine AS (SELECT c_custkey AS project_id, 'prop1' AS name_key, coalesce('own-' || n.value, 'unresolved($(prop0))') AS value FROM customer LEFT JOIN near n ON c_custkey = n.project_id AND n.name_key = 'prop0' WHERE c_custkey % 10 = 0)
        SELECT * FROM near WHERE NOT (name_key = 'prop1' AND project_id % 10 = 0) UNION ALL SELECT * FROM mine""",
    "central_versions": f"WITH {_SEEN}, near AS (SELECT * FROM seen QUALIFY length(folder) = max(length(folder)) OVER (PARTITION BY project_id)) SELECT project_id, name_key AS package_key, arg_max(value, seq) AS version FROM near GROUP BY ALL",
    "file_owners": """WITH fs AS (SELECT c_custkey AS file_id, 'n' || c_nationkey || '/area' || c_custkey % 3 || '/group' || c_custkey % 4 || '/p' || c_custkey AS folder FROM customer),
        s AS (SELECT s_suppkey % 3 AS k, s_name, 'n' || s_nationkey || '/area' || s_suppkey % 2 AS area, '/group' || s_suppkey % 4 AS grp FROM supplier),
        rs AS (SELECT n_name AS repo, 'n' || n_nationkey AS folder FROM nation UNION ALL SELECT s_name, area || grp FROM s WHERE k = 1), ps AS (SELECT s_name AS project_id, CASE WHEN k = 0 THEN area ELSE area || grp END AS folder FROM s WHERE k <> 1),
        r AS (SELECT file_id, repo, length(rs.folder) AS n FROM fs JOIN rs ON starts_with(fs.folder || '/', rs.folder || '/') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY length(rs.folder) DESC, repo) = 1),
        p AS (SELECT file_id, project_id, length(ps.folder) AS n FROM fs JOIN ps ON starts_with(fs.folder || '/', ps.folder || '/') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY length(ps.folder) DESC, project_id) = 1)
        SELECT file_id, repo, CASE WHEN r.n IS NULL OR p.n >= r.n THEN project_id END AS project_id FROM fs LEFT JOIN r USING (file_id) LEFT JOIN p USING (file_id)""",
    "type_declarations": f"""WITH {_REACH}, r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS ref_id, l_partkey // 4 AS n, l_linenumber % 3 AS arity, l_orderkey % 50 AS p FROM lineitem), d AS (SELECT p_partkey AS decl_id, p_partkey // 4 AS n, p_partkey % 2 AS arity, p_partkey % 20 AS p FROM part),
        every AS (SELECT r.ref_id, d.decl_id, d.arity = r.arity AS same, CASE WHEN d.p = r.p THEN 0 WHEN t.target_id IS NOT NULL THEN 100 + d.p WHEN d.p % 5 = r.p % 5 THEN 200 ELSE 300 END AS lvl FROM r JOIN d USING (n) LEFT JOIN reach t ON t.project_id = r.p AND t.target_id = d.p),
        fit AS (SELECT * FROM every QUALIFY same OR NOT bool_or(same) OVER (PARTITION BY ref_id)), best AS (SELECT * FROM fit QUALIFY lvl = min(lvl) OVER (PARTITION BY ref_id))
        SELECT ref_id, decl_id, CAST(lvl // 100 AS int) AS level, count(*) OVER (PARTITION BY ref_id) AS candidates FROM best""",
    "call_links": f"""WITH {_REACH}, c AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS call_id, 's' || l_orderkey || '-' || l_linenumber // 2 AS site_id, l_orderkey % 50 AS p, l_partkey // 8 AS t, l_partkey % 2 AS m, l_linenumber % 4 AS args, l_suppkey % 10 AS hint FROM lineitem),
        f AS (SELECT call_id, site_id, p_partkey AS method_id, args BETWEEN p_partkey % 3 AND p_partkey % 3 + 1 AS takes, p_partkey % 10 = hint AS near FROM c JOIN reach r ON r.project_id = c.p JOIN part ON p_partkey % 10 = r.target_id AND p_partkey // 8 = t AND p_partkey % 2 = m),
        a AS (SELECT * FROM f QUALIFY takes OR NOT bool_or(takes) OVER (PARTITION BY call_id)), b AS (SELECT * FROM a QUALIFY near OR NOT bool_or(near) OVER (PARTITION BY call_id)), k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY call_id) > 1 THEN 0 ELSE 2 END AS c FROM b)
        SELECT site_id, method_id, min(c) AS confidence FROM k GROUP BY ALL""",
    "project_kinds": """WITH p AS (SELECT c_custkey AS k, 'P' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.Tests' WHEN 1 THEN '.Client' ELSE '' END AS name, c_custkey % 4 = 0 OR c_custkey % 11 = 0 AS test FROM customer),
        q AS (SELECT *, NOT test AND k % 7 <> 0 AND k % 3 = 0 AS pack FROM p)
        SELECT name, CAST(test AS int) AS is_test, CAST(pack AS int) AS is_packable, CASE WHEN k % 3 = 0 THEN 'Id' || k ELSE name END AS effective_id, CASE WHEN k % 2 = 0 THEN '1.0.' || k END AS version,
        CASE WHEN k % 34 = 0 THEN 'Library' WHEN test THEN 'Test' WHEN k % 5 = 0 OR k % 13 = 0 THEN 'Api' WHEN (pack OR k % 4 = 1) AND k % 2 = 1 THEN 'Client' WHEN pack THEN 'Library' ELSE 'Other' END AS kind FROM q""",
    "merged_types": """WITH f AS (SELECT l_partkey AS k, 'f' || l_linenumber AS path, l_orderkey AS s, unnest(['F' || l_suppkey % 7, 'G' || l_linenumber]) AS name, unnest([1, 2]) AS pos FROM lineitem),
        once AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY path, s, pos) = 1)
        SELECT k % 5 AS project_id, 'T' || k AS full_name, string_agg(name, ',' ORDER BY path, s, pos) AS fields FROM once GROUP BY k""",
}
