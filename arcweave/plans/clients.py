"""Registered queries on client methods and the SQL that restates them: orders are methods, order lines their calls, customers the owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clients
from .estate import Estate
from .facts import _text

CALLED = ("GetAsync", "PostAsync", "GetSection", "Send", "Patch", "Getter", "DeleteAsync")
RECEIVERS = ("_http", "System.IO.Path", None, "this.client", "Environment")


def _pick(values: tuple, number: str):
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.expr(number).cast("int"))


def _methods(e: Estate) -> DataFrame:
    """Every fifth an interface's; overloads by the thousands of one name, waiting or not."""
    k, face = F.col("o_orderkey"), F.col("o_orderkey") % 5 == 0
    owner = F.when(face, _text("I?", "o_custkey % 40")).otherwise(_text("C?", "o_custkey % 40"))
    bases = F.when(~face, F.array(_text("I?<X>", "o_custkey % 40"), F.lit("Base")))
    waits = F.when(k % 4 < 2, "Task<X>").when(k % 4 == 2, "ValueTask").otherwise("TaskList<X>")
    return e.raw("orders").select(k.alias("method_id"), (F.col("o_custkey") % 10).alias("project_id"), _text("P?", "o_custkey % 10").alias("project_name"), k.alias("seq"), F.concat_ws("/", (F.col("o_custkey") % 10).cast("string"), owner).alias("owner_id"), owner.alias("owner"),
        F.when(face, "interface").otherwise("class").alias("owner_kind"), bases.alias("base_types"), _text("Get?", "o_orderkey % 7").alias("method"), waits.alias("return_type"), (k % 3).alias("n_params"), (k % 11 < 4).alias("calls_own_name"))


def _calls(e: Estate) -> DataFrame:
    """The lines of every third order; those that fall on one number are one call."""
    route = F.when(F.col("l_partkey") % 4 == 0, _text("api/v?/x", "l_partkey % 5")).when(F.col("l_partkey") % 4 == 1, F.lit("plain")).when(F.col("l_partkey") % 4 == 2, F.lit("text/html"))
    line = e.raw("lineitem").filter("l_orderkey % 3 = 0").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    kind = F.when(F.col("l_linenumber") % 4 == 3, "request").otherwise("invocation")
    verb = F.when(F.col("l_suppkey") % 2 == 0, "PUT")
    return line.select(F.col("l_orderkey").alias("method_id"), F.col("l_linenumber").alias("seq"), kind.alias("kind"), _pick(RECEIVERS, "l_suppkey % 5").alias("receiver"), _pick(CALLED, "l_partkey % 7").alias("called"), verb.alias("verb"), F.array(route, _text("{b?}/y", "l_suppkey % 3")).alias("args"),
        F.array(_text("Acme.Http?Client<T>", "l_suppkey"), _text("Part?", "l_partkey")).alias("receiver_types"))


def generic_calls(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return clients.generic_hits(_calls(e), _methods(e))


def _rules(e: Estate) -> DataFrame:
    """A rule for every part: most by a whole name, some by an ending or a part of it; names first by a glob that rarely fits."""
    k = F.col("p_partkey")
    glob = F.when(k % 3 == 0, _text("part?", "p_partkey")).when(k % 3 == 1, _text("*HTTP?client", "p_partkey")).otherwise(_text("*art?", "p_partkey"))
    methods = F.array(F.struct(F.lit("Post*").alias("glob"), F.lit("post").alias("verb")), F.struct(F.lit("?etAsync").alias("glob"), F.lit("get").alias("verb")), F.struct(F.when(k % 2 == 0, "*").otherwise("Send").alias("glob"), F.lit("put").alias("verb")))
    return e.raw("part").select((k * 7 % 1009).alias("rule_order"), glob.alias("type_glob"), methods.alias("methods"), (k % 3).cast("int").alias("route_argument"), "p_partkey").withColumn("rule_order", F.struct("rule_order", "p_partkey")).drop("p_partkey")


def wrapper_calls(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return clients.wrapper_hits(_calls(e), _rules(e))


def _bodies(e: Estate) -> DataFrame:
    """Every fourth order as a generated method: appended parts by its lines."""
    k = F.col("o_orderkey")
    parts = e.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    value = F.when(F.col("l_partkey") % 3 > 0, _text("/p?", "l_partkey % 9"))
    appends = parts.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", value.alias("value"), (F.col("l_partkey") % 5 == 0).alias("is_base")))).alias("appends"))
    verb = F.when(k % 8 == 0, "Get").when(k % 8 == 4, "DELETE")
    comment = F.when(k % 16 == 4, _text("v?/path", "o_orderkey % 3"))
    template = F.when(k % 12 > 5, F.concat(_text("{+baseurl}/t?/{id}", "o_orderkey % 5"), F.lit("{?top,skip}")))
    return e.raw("orders").filter("o_orderkey % 4 = 0 or o_orderkey % 12 = 7").join(appends, "o_orderkey", "left").select(k.alias("method_id"), _text("Get?", "o_orderkey % 7").alias("method"), verb.alias("verb"), comment.alias("path_comment"), F.transform("appends", lambda a: F.struct(a["value"].alias("value"), a["is_base"].alias("is_base"))).alias("appends"), template.alias("template"))


def generated_routes(spark: SparkSession, folder: str) -> DataFrame:
    return clients.generated_hits(_bodies(Estate(spark, folder)))


def _first(e: Estate) -> DataFrame:
    refit = e.raw("orders").filter("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("method_id"), F.lit("HEAD").alias("verb"), _text("refit/?", "o_orderkey % 4").alias("route"), F.lit("refit").alias("strategy"), F.lit(2).alias("confidence"))
    few = e.raw("orders").filter("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("method_id"))  # so that most have none of their own
    found = clients.first_strategy(clients.generic_hits(_calls(e), _methods(e)), clients.generated_hits(_bodies(e)), refit)
    return found.join(few, "method_id", "left_semi")


def interface_routes(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return clients.lend_hits(_methods(e), _first(e))


def client_strategies(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    prefixes = e.raw("nation").filter("n_nationkey % 3 = 0 and n_nationkey < 10").select(_text("P?", "n_nationkey").alias("project_name"), _text("/gate?/", "n_nationkey").alias("prefix"))
    return clients.collapse_overloads(_methods(e), clients.lend_hits(_methods(e), _first(e)), prefixes)


QUERIES = {f.__name__: f for f in (generic_calls, wrapper_calls, generated_routes, interface_routes, client_strategies)}

_METHODS = """m AS (SELECT o_orderkey AS k, o_custkey % 10 AS p, o_custkey % 40 AS c, o_orderkey % 5 = 0 AS face, 'Get' || o_orderkey % 7 AS method, o_orderkey % 4 < 3 AS waits, o_orderkey % 3 AS n, o_orderkey % 11 < 4 AS own FROM orders)"""
_CALLS = f"""line AS (SELECT l_orderkey AS k, l_linenumber AS seq, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL),
calls AS (SELECT k, seq, part, supp, seq % 4 = 3 AS request, {list(RECEIVERS)!r}[supp % 5 + 1] AS receiver, {list(CALLED)!r}[part % 7 + 1] AS called, [CASE part % 4 WHEN 0 THEN 'api/v' || part % 5 || '/x' WHEN 1 THEN 'plain' WHEN 2 THEN 'text/html' END, '{{b' || supp % 3 || '}}/y'] AS args FROM line)""".replace("None", "NULL")
_GENERIC = f"""{_METHODS}, {_CALLS},
verbs AS (SELECT *, CASE WHEN request THEN CASE WHEN supp % 2 = 0 THEN 'PUT' END ELSE upper(nullif(regexp_extract(called, '^(Get|Post|Put|Delete|Patch)([A-Z]|$)', 1), '')) END AS verb,
  CASE WHEN NOT request AND args[1] LIKE '%/%' AND args[1] NOT LIKE 'text/%' THEN args[1] ELSE args[2] END AS route FROM calls JOIN m USING (k)),
generic AS (SELECT k, verb, route, 'generic-http' AS strategy, 1 AS confidence FROM verbs WHERE verb IS NOT NULL AND (request OR (called NOT IN {clients.NO_CALLS} AND coalesce(string_split(receiver, '.')[-1], '') NOT IN {clients.NO_RECEIVERS} AND NOT (receiver IS NULL AND called = method)))
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1)"""
_GENERATED = """app AS (SELECT k, string_agg(CASE WHEN part % 3 > 0 THEN '/p' || part % 9 ELSE '{}' END, '' ORDER BY seq) FILTER (part % 5 <> 0) AS built FROM (SELECT l_orderkey AS k, l_linenumber AS seq, min(l_partkey) AS part FROM lineitem GROUP BY ALL) GROUP BY k),
gen AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'GET' WHEN 4 THEN 'DELETE' END AS verb, CASE WHEN o_orderkey % 16 = 4 THEN 'v' || o_orderkey % 3 || '/path' ELSE built END AS built, CASE WHEN o_orderkey % 12 > 5 THEN '/t' || o_orderkey % 5 || '/{id}' END AS template
  FROM orders LEFT JOIN app ON k = o_orderkey WHERE o_orderkey % 4 = 0 OR o_orderkey % 12 = 7),
generated AS (SELECT k, CASE WHEN verb IS NOT NULL AND built IS NOT NULL THEN verb END AS verb, CASE WHEN verb IS NOT NULL AND built IS NOT NULL THEN built ELSE template END AS route, 'generated' AS strategy, 2 AS confidence FROM gen),
done AS (SELECT k, verb, route, strategy, confidence FROM generated WHERE verb IS NOT NULL)"""
_FIRST = f"""{_GENERIC}, {_GENERATED},
hits AS (SELECT * FROM (SELECT *, 1 AS rank FROM done UNION ALL SELECT *, 2 FROM generic UNION ALL SELECT o_orderkey, 'HEAD', 'refit/' || o_orderkey % 4, 'refit', 2, 0 FROM orders WHERE o_orderkey % 97 = 0) WHERE k % 9 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank) = 1),
own AS (SELECT m.*, verb, route, strategy, confidence FROM m LEFT JOIN hits USING (k)),
lent AS (SELECT a.k, b.verb, b.route, b.strategy, b.confidence FROM own a JOIN own b ON a.p = b.p AND a.c = b.c AND a.face = b.face AND a.method = b.method AND b.verb IS NOT NULL WHERE a.verb IS NULL AND a.own AND NOT a.face QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY b.k) = 1),
known AS (SELECT k, verb, route, strategy, confidence FROM hits UNION ALL SELECT * FROM lent), impl AS (SELECT m.*, verb, route, strategy, confidence FROM m JOIN known USING (k) WHERE NOT face),
faces AS (SELECT a.k, b.verb, b.route, b.strategy, b.confidence FROM own a JOIN impl b ON a.p = b.p AND a.c = b.c AND a.method = b.method WHERE a.face AND a.verb IS NULL QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY (b.n <> a.n)::int, b.k) = 1),
lending AS (SELECT * FROM known UNION ALL SELECT * FROM faces)"""
ORACLES = {
    "generic_calls": f"WITH {_GENERIC} SELECT k AS method_id, verb, route, strategy, confidence FROM generic",
    "wrapper_calls": f"""WITH {_CALLS}, types AS (SELECT k, seq, part, called, args, unnest(['acme.http' || supp || 'client', 'part' || part]) AS t FROM calls WHERE NOT request),
        rules AS (SELECT p_partkey AS r, p_partkey * 7 % 1009 AS o, CASE p_partkey % 3 WHEN 1 THEN 'client' || p_partkey ELSE 'part' || p_partkey END AS t FROM part),
        found AS (SELECT k, seq, o, r, CASE WHEN called LIKE 'Post%' THEN 'POST' WHEN called LIKE '_etAsync' THEN 'GET' WHEN r % 2 = 0 OR called = 'Send' THEN 'PUT' END AS verb, CASE WHEN r % 3 < 2 THEN args[r % 3 + 1] END AS route
          FROM types JOIN rules ON rules.t = CASE WHEN types.t LIKE 'acme%' THEN 'client' || regexp_extract(types.t, '[0-9]+') ELSE types.t END)
        SELECT k AS method_id, verb, route, 'configured-wrapper' AS strategy, 2 AS confidence FROM found WHERE verb IS NOT NULL AND route IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq, o, r) = 1""",
    "generated_routes": f"WITH {_GENERATED} SELECT k AS method_id, verb, route, strategy, confidence FROM done",
    "interface_routes": f"WITH {_FIRST} SELECT k AS method_id, verb, route, strategy, confidence FROM lending",
    "client_strategies": f"""WITH {_FIRST}, pre AS (SELECT n_nationkey AS p FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < 10),
        row AS (SELECT m.k, m.p, m.c, m.face, m.waits, 'cm:P' || m.p || ':' || CASE WHEN face THEN 'I' ELSE 'C' END || m.c || '.' || method AS base, verb, strategy, confidence, CASE WHEN pre.p IS NULL THEN '' ELSE '/gate' || pre.p END || '/' || ltrim(route, '/') AS route FROM m LEFT JOIN lending USING (k) LEFT JOIN pre ON pre.p = m.p),
        norm AS (SELECT *, lower(regexp_replace(ltrim(route, '/'), '\\{{[^{{}}]*\\}}', '{{}}', 'g')) AS norm, bool_or(verb IS NOT NULL) OVER (PARTITION BY p, face, c) AS owner FROM row),
        wait AS (SELECT base, min(k) AS k FROM norm WHERE verb IS NULL AND waits AND owner GROUP BY base), called AS (SELECT * FROM norm WHERE verb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY base, lower(verb), norm ORDER BY k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS place FROM called)
        SELECT r.base || CASE WHEN place > 1 THEN '#' || place ELSE '' END AS id, r.k AS method_id, p AS project_id, CASE WHEN place = 1 THEN least(r.k, coalesce(wait.k, r.k)) ELSE r.k END AS seq, verb, route, norm, strategy, confidence FROM ranked r LEFT JOIN wait ON wait.base = r.base
        UNION ALL SELECT w.base, w.k, p, w.k, NULL, NULL, NULL, 'none', 0 FROM wait w JOIN norm USING (k) WHERE w.base NOT IN (SELECT base FROM called)""",
}
