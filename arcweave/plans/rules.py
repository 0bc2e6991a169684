"""Registered queries on ids, signatures, discovered repositories and what diagnostics name, and the SQL that restates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, ids
from ..operators import diagnostics, findings, linking, projects
from .estate import ESTATE_SQL, Estate
from .facts import _text


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as call sites, parts as models, pages as endpoints and methods."""
    e = Estate(spark, folder)
    line, part, page = e.raw("lineitem"), e.raw("part"), e.endpoints()
    type_name = ids.name_with_arity(_text("T?", "p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")))
    outer = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Outer`1")))
    site = ids.site_id(F.col("l_suppkey"), F.col("l_partkey"), _text("C?", "l_linenumber"), F.col("l_returnflag"), F.col("l_orderkey"))
    rows = [
        line.select(F.lit("callSite").alias("kind"), site.alias("id")).distinct(),
        part.select(F.lit("model"), ids.model_id(ids.project_name(_text("proj:r/P?#2", "p_partkey")), ids.full_type_name(F.array(F.lit("Acme"), F.col("p_brand")), outer, type_name))),
        page.select(F.lit("endpoint"), ids.endpoint_id(F.col("repo"), F.lower("verb"), F.col("norm"))),
        page.select(F.lit("clientMethod"), ids.method_id(F.col("repo"), F.lit("Client"), _text("Get?", "page_id"))),
        part.select(F.lit("package"), ids.package_id(F.col("p_name"))),
        e.raw("customer").select(F.lit("project"), ids.project_id(F.col("c_nationkey"), F.col("c_name"))),
        e.raw("nation").select(F.lit("repo"), ids.repo_id(F.col("n_name"))),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def argument_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Parts' signatures: defaults, brackets, strings with commas, open ends, and ones that can't be read."""
    k = F.col("p_partkey") % 6
    tails = ("", "int a", "int a, Map<string, int> b = null", 'string s = "x, (y", [In] params int[] rest', "int a, int b", "int a = 1, Func<(int, int), int> f = null")
    text = F.get(F.array(*map(F.lit, tails)), k.cast("int"))
    end = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(")")
    part = Estate(spark, folder).raw("part").select("p_partkey", F.concat(F.lit("Task<X> Get"), "p_size", F.lit("("), text, end).alias("signature"), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("Get"), "p_size")).otherwise(F.lit("Other")).alias("method"))
    return part.select("p_partkey", facts.argument_limits("signature", "method").alias("x")).select("p_partkey", "x.min_args", "x.max_args")


def discovered_repos(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as repositories: many of one name in several cases, some left out."""
    key = F.col("s_suppkey")
    name = F.concat(F.when(key % 2 == 0, "Svc").otherwise("svc"), (key % 9).cast("string"), F.when(key % 13 == 0, ".old").otherwise(""))
    rows = Estate(spark, folder).raw("supplier").select(name.alias("name"), F.lpad(key.cast("string"), 12, "0").alias("path"))
    return projects.discover(rows, ["SVC*"], ["*.old", "sv?3"]).select("path", "old_name", "name")


def dangling_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that diagnostics on packages name, where the packages that somebody makes and the projects of suppliers are all there are."""
    e = Estate(spark, folder)
    made = linking.produces(e.made())
    known = made.select(diagnostics.package_node().alias("id")).union(e.clients().select("project_id"))
    return findings.dangling_findings(known, diagnostics.packages(e.references(), made))


QUERIES = {f.__name__: f for f in (stable_ids, argument_limits, discovered_repos, dangling_findings)}
ORACLES = {
    "stable_ids": f"""WITH {ESTATE_SQL} SELECT DISTINCT 'callSite' AS kind, 'cs:' || l_suppkey || '/' || l_partkey || ':C' || l_linenumber || '.' || l_returnflag || ':' || l_orderkey AS id FROM lineitem
        UNION ALL SELECT 'model', 'model:P' || p_partkey || ':Acme.' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '.Outer`1' ELSE '' END || '.T' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '`2' ELSE '' END FROM part
        UNION ALL SELECT 'endpoint', 'ep:' || repo || ':' || verb || ':' || norm FROM endpoints UNION ALL SELECT 'clientMethod', 'cm:' || repo || ':Client.Get' || page_id FROM endpoints
        UNION ALL SELECT 'package', 'pkg:' || p_name FROM part UNION ALL SELECT 'project', 'proj:' || c_nationkey || '/' || c_name FROM customer UNION ALL SELECT 'repo', 'repo:' || n_name FROM nation""",
    "argument_limits": """SELECT p_partkey, CAST(CASE WHEN open THEN 0 ELSE [0, 1, 1, 0, 2, 0][p_partkey % 6 + 1] END AS int) AS min_args, CAST(CASE WHEN open OR p_partkey % 6 = 3 THEN NULL ELSE [0, 1, 2, NULL, 2, 2][p_partkey % 6 + 1] END AS int) AS max_args
        FROM (SELECT p_partkey, p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS open FROM part)""",
    "discovered_repos": """WITH r AS (SELECT lpad(CAST(s_suppkey AS varchar), 12, '0') AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'Svc' ELSE 'svc' END || s_suppkey % 9 AS old_name FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 9 <> 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY lower(old_name) ORDER BY old_name, path) AS n FROM r) SELECT path, old_name, old_name || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS name FROM n""",
    "dangling_findings": f"""WITH {ESTATE_SQL}, known AS (SELECT 'pkg:' || package_key AS id FROM produced UNION SELECT project_id FROM clients),
        named AS (SELECT 'ambiguousProducer' AS kind, unnest(['pkg:' || package_key, project_id]) AS id FROM produced WHERE confidence = 0 UNION SELECT 'unresolvedVersion', unnest([project_id, 'pkg:' || package_key]) FROM refs WHERE starts_with(version, 'unresolved('))
        SELECT DISTINCT kind, id FROM named WHERE id NOT IN (SELECT id FROM known)""",
}
