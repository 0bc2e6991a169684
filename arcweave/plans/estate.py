"""The graph tables of an estate, derived from star-schema tables: nations are repositories, suppliers client projects, customers
api projects, parts packages, order lines package references, pages endpoints and client methods, events calls.

ESTATE_SQL states the same in SQL, for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.routes import lookup_route, normalize_route

VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")


class Estate:
    """Tables are read when they are asked for, with the columns that are used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def repos(self) -> DataFrame:
        return self.raw("nation").select("n_nationkey", F.col("n_name").alias("repo"), F.concat(F.lit("repo:"), "n_name").alias("id"))

    def clients(self) -> DataFrame:
        s = self.raw("supplier").join(self.repos(), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select("s_suppkey", "repo", F.concat(F.lit("proj:"), "repo", F.lit("/"), "s_name").alias("project_id"))

    def apis(self) -> DataFrame:
        c = self.raw("customer").join(self.repos(), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select("c_custkey", "repo", F.concat(F.lit("proj:"), "repo", F.lit("/"), "c_name").alias("project_id"))

    def made(self) -> DataFrame:
        """(id, repo, package_id, version) of producing projects; every tenth package has two."""
        n = self.raw("supplier").count()
        part = self.raw("part").select("p_partkey", F.concat(F.lit("Part"), "p_partkey").alias("package_id"), F.when(F.col("p_partkey") % 7 == 0, F.lit("unresolved($(V))")).when(F.col("p_partkey") % 3 != 0, F.lit("1.4.25")).alias("version"))
        makers = part.withColumn("s_suppkey", F.explode(F.when(F.col("p_partkey") % 10 == 0, F.array(F.col("p_partkey") % n, (F.col("p_partkey") + 1) % n)).otherwise(F.array(F.col("p_partkey") % n))))
        return makers.join(self.clients(), "s_suppkey").select(F.col("project_id").alias("id"), "repo", "package_id", "version")

    def references(self) -> DataFrame:
        """(project_id, repo, package_key, version), distinct."""
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.when(F.col("l_returnflag") == "R", F.lit("unresolved($(V))")).otherwise(F.concat_ws(".", F.lit("1"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))).alias("version"))
        used = lines.join(self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").select("c_custkey", "l_partkey", "version").distinct()
        return used.join(self.apis(), "c_custkey").select("project_id", "repo", F.concat(F.lit("part"), "l_partkey").alias("package_key"), "version")

    def endpoints(self) -> DataFrame:
        pages = self.raw("pages").select("page_id", "url").join(F.broadcast(self.repos()), F.col("page_id") % 25 == F.col("n_nationkey"))
        route = F.regexp_replace("url", "[0-9]+", "{id}")
        route = F.when(F.col("page_id") % 9 == 4, F.concat(F.lit("\t"), route, F.lit("/{n:regex(^{2,3}$)}/x\n"))).otherwise(route)
        verb = F.get(F.array(*map(F.lit, VERBS)), (F.col("page_id") % 5).cast("int"))
        return pages.select(F.concat(F.lit("ep:"), "page_id").alias("id"), "page_id", "repo", verb.alias("verb"), route.alias("route"), normalize_route(route).alias("norm"), lookup_route(route).alias("lookup"))

    def methods(self) -> DataFrame:
        e = self.endpoints()
        norm = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("norm", "^[^/]*/", "")).otherwise(F.col("norm"))
        return e.select(F.concat(F.lit("cm:"), "page_id").alias("id"), "page_id", "repo", F.concat(F.lit("proj"), (F.col("page_id") % 10).cast("string")).alias("project_id"), F.concat(F.lit("Call"), (F.col("page_id") % 40).cast("string")).alias("method_name"), F.when(F.col("page_id") % 7 != 0, F.col("verb")).alias("verb"), norm.alias("norm"), F.lit("attribute").alias("strategy"), F.lit(3).alias("confidence"))

    def invoked(self) -> DataFrame:
        """(method_id) of the calls; squares leave most remainders out, so most of the methods are never called."""
        n = self.raw("pages").count()
        return self.raw("events").select((F.col("event_id") * F.col("event_id") % n).alias("m")).select(F.concat(F.lit("cm:"), "m").alias("method_id"))

    def files(self) -> DataFrame:
        return self.raw("documents").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "doc_id", F.lit(".cs")).alias("path"), "text")


_WHITE = "' ' || chr(9) || chr(10) || chr(13)"


def _norm_sql(x: str) -> str:
    text = f"regexp_replace(trim(coalesce({x}, ''), {_WHITE}), '^.*?://[^/]*', '', 's')"
    return _segments_sql(rf"regexp_replace(regexp_replace(regexp_replace({text}, '^~+', ''), '\{{[^{{}}]*\}}', '{{}}', 'g'), '[?#].*', '', 's')")


def _lookup_sql(x: str) -> str:
    return _segments_sql(rf"regexp_replace(regexp_replace(trim(coalesce({x}, ''), {_WHITE}), '[?#].*', '', 's'), '\{{[^{{}}]*\}}', '{{}}', 'g')")


def _segments_sql(x: str) -> str:
    return f"lower(array_to_string([trim(s, {_WHITE}) FOR s IN string_split({x}, '/') IF trim(s, {_WHITE}) <> ''], '/'))"


ESTATE_SQL = rf"""
repos AS (SELECT n_nationkey, n_name AS repo, 'repo:' || n_name AS id FROM nation),
clients AS (SELECT s_suppkey, repo, 'proj:' || repo || '/' || s_name AS project_id FROM supplier JOIN repos ON s_nationkey = n_nationkey),
apis AS (SELECT c_custkey, repo, 'proj:' || repo || '/' || c_name AS project_id FROM customer JOIN repos ON c_nationkey = n_nationkey),
maker AS (SELECT p_partkey, p_partkey % (SELECT count(*) FROM supplier) AS s_suppkey FROM part UNION SELECT p_partkey, (p_partkey + 1) % (SELECT count(*) FROM supplier) FROM part WHERE p_partkey % 10 = 0),
made AS (SELECT project_id, repo, 'part' || p_partkey AS package_key, CASE WHEN p_partkey % 7 = 0 THEN 'unresolved($(V))' WHEN p_partkey % 3 <> 0 THEN '1.4.25' END AS version FROM maker JOIN clients USING (s_suppkey)),
produced AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY package_key) > 1 THEN 0 ELSE 3 END AS confidence FROM made),
refs AS (SELECT DISTINCT project_id, repo, 'part' || l_partkey AS package_key, CASE WHEN l_returnflag = 'R' THEN 'unresolved($(V))' ELSE '1.' || l_linenumber || '.' || CAST(trunc(l_quantity) AS int) END AS version
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN apis ON o_custkey = c_custkey),
routes AS (SELECT page_id, url, repo, ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'][page_id % 5 + 1] AS verb, CASE WHEN page_id % 9 = 4 THEN chr(9) || regexp_replace(url, '[0-9]+', '{{id}}', 'g') || '/{{n:regex(^{{2,3}}$)}}/x' || chr(10) ELSE regexp_replace(url, '[0-9]+', '{{id}}', 'g') END AS route FROM pages JOIN repos ON page_id % 25 = n_nationkey),
endpoints AS (SELECT 'ep:' || page_id AS id, page_id, repo, verb, route, {_norm_sql("route")} AS norm, {_lookup_sql("route")} AS lookup FROM routes),
methods AS (SELECT 'cm:' || page_id AS id, page_id, repo, 'proj' || (page_id % 10) AS project_id, 'Call' || (page_id % 40) AS method_name, CASE WHEN page_id % 7 <> 0 THEN verb END AS verb,
  CASE WHEN page_id % 4 = 0 THEN regexp_replace(norm, '^[^/]*/', '') ELSE norm END AS norm FROM endpoints),
invoked AS (SELECT 'cm:' || (event_id * event_id % (SELECT count(*) FROM pages)) AS method_id FROM events),
exact AS (SELECT m.id AS method_id, e.id AS endpoint_id, 'attribute' AS strategy FROM methods m JOIN endpoints e ON m.repo = e.repo AND m.verb = e.verb AND m.norm = e.norm),
suffix AS (SELECT m.id AS method_id, e.id AS endpoint_id, 'attribute+suffix' AS strategy FROM methods m JOIN endpoints e ON m.repo = e.repo AND m.verb = e.verb AND m.norm <> '' AND e.norm <> ''
  AND (ends_with(m.norm, '/' || e.norm) OR ends_with(e.norm, '/' || m.norm)) WHERE m.id NOT IN (SELECT method_id FROM exact)),
matched AS (SELECT * FROM exact UNION ALL SELECT * FROM suffix),
links AS (SELECT method_id, endpoint_id, strategy, CASE WHEN strategy = 'attribute' AND count(*) OVER w = 1 THEN 3 ELSE 0 END AS confidence, CAST(count(*) OVER w AS int) AS matches FROM matched WINDOW w AS (PARTITION BY method_id)
  UNION ALL SELECT id, NULL, 'attribute', 3, 0 FROM methods WHERE id NOT IN (SELECT method_id FROM matched)),
depends AS (SELECT r.repo AS from_repo, p.repo AS to_repo, min(p.confidence) AS confidence, count(DISTINCT p.package_key) AS n_packages FROM (SELECT DISTINCT repo, package_key FROM refs) r JOIN produced p USING (package_key) WHERE r.repo <> p.repo GROUP BY ALL)
"""
