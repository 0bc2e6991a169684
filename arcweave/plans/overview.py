"""Registered queries on all nodes, diagnostics and totals, and the SQL that restates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, linking, nodes
from . import catalog
from .estate import ESTATE_SQL, Estate


def _nodes(e: Estate) -> DataFrame:
    made = linking.produces(e.made())
    packages = made.groupBy("package_key").agg(F.min_by("repo", "project_id").alias("repo"))
    projects = e.clients().select("project_id", "repo").union(e.apis().select("project_id", "repo"))
    return nodes.node_universe(
        {
            "repo": e.repos().select("id", F.col("repo").alias("label"), "repo"),
            "project": projects.select(F.col("project_id").alias("id"), F.substring_index("project_id", "/", -1).alias("label"), "repo"),
            "package": packages.select(F.concat(F.lit("pkg:"), "package_key").alias("id"), F.col("package_key").alias("label"), "repo"),
            "endpoint": e.endpoints().select(F.concat_ws(":", F.lit("ep"), "repo", "verb", "norm").alias("id"), F.concat("verb", F.lit(" "), "route").alias("label"), "repo"),
            "clientMethod": e.methods().select("id", F.col("method_name").alias("label"), "repo"),
        }
    )


def node_universe(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(Estate(spark, folder))


def graph_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(Estate(spark, folder)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def package_universe(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    used = e.references().select(F.upper("package_key").alias("package_id"), F.col("project_id").alias("seq"))
    return nodes.package_universe(used, e.made().select("package_id", F.col("id").alias("seq")))


def _diagnostics(e: Estate) -> DataFrame:
    links = linking.link_counts(e.methods(), e.endpoints())
    made = linking.produces(e.made())
    unresolved = e.references().filter("startswith(version, 'unresolved(')")
    return nodes.diagnostics(
        [
            ("ambiguousRoute", "warning", links.filter("matches > 1").select(F.col("method_id").alias("node_id"), F.concat(F.lit("endpoints: "), "matches").alias("message"))),
            ("unresolvedClientMethod", "info", links.filter("matches = 0").select(F.col("method_id").alias("node_id"), F.lit("no endpoint").alias("message"))),
            ("ambiguousProducer", "warning", made.filter("confidence = 0").select(F.concat(F.lit("pkg:"), "package_key").alias("node_id"), F.lit("several producers").alias("message"))),
            ("unresolvedVersion", "warning", unresolved.select(F.col("project_id").alias("node_id"), F.concat("package_key", F.lit(" "), "version").alias("message"))),
        ]
    )


def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return _diagnostics(Estate(spark, folder))


def diagnostics_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return _diagnostics(Estate(spark, folder)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def diagnostics_of_repo(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings on nodes of the repository NATION_1, or of the first one where there is none of the name."""
    e = Estate(spark, folder)
    first = e.repos().agg(F.min("repo")).first()[0] or ""
    return nodes.filter_diagnostics(_diagnostics(e), _nodes(e), severity="WARNING", repo=first)


def call_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by event: the caller's repository by user, the callee's by method."""
    e = Estate(spark, folder)
    n, repos = e.raw("pages").count(), e.repos()
    event = e.raw("events").select(F.concat(F.lit("cm:"), F.col("event_id") % n).alias("id"), (F.col("user_id") % 25).alias("n_nationkey"))
    calls = event.join(e.methods().select("id", F.col("repo").alias("to_repo")), "id").join(F.broadcast(repos.select("n_nationkey", F.col("repo").alias("from_repo"))), "n_nationkey")
    depends = linking.repo_dependencies(e.references(), linking.produces(e.made())).select("from_repo", "to_repo")
    return nodes.call_counts(depends, calls)


def impact_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The first three of each kind that a change of a client project reaches, with totals."""
    found = catalog.impact(spark, folder).withColumn("kind", F.substring_index("node", ":", 1))
    return nodes.capped(found, ["root", "kind"], "node", 3)


def endpoint_page(spark: SparkSession, folder: str) -> DataFrame:
    return nodes.page_with_total(Estate(spark, folder).endpoints().select("id", "verb", "route"), "id")


def trace_both(spark: SparkSession, folder: str) -> DataFrame:
    """What each repository depends on and what depends on it, in one step; a node that is both comes twice."""
    e = Estate(spark, folder)
    hop, roots = catalog._depends(e), e.repos().select(F.col("id").alias("root"))
    both = [graph.trace(roots, hop, e.repos(), depth=1, up=up).withColumn("direction", F.lit("up" if up else "down")) for up in (False, True)]
    return both[0].unionByName(both[1]).select("root", "direction", "node", "depth", "via", "confidence")


def reachable_projects(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return nodes.reachable_projects(e.references(), linking.produces(e.made()))


def endpoint_details(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    calls = e.invoked().groupBy(F.col("method_id").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    return nodes.endpoint_details(e.endpoints(), linking.link_totals(e.methods().join(calls, "id", "left").fillna(0, ["calls"]), e.endpoints()))


def _sites(e: Estate) -> DataFrame:
    """Calls of fifty scans, whose sites have the same ids in several of them."""
    at = F.concat(F.lit("cs:"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/"), (F.col("l_partkey") % 60).cast("string"))
    return e.raw("lineitem").select((F.col("l_orderkey") % 50).alias("scan"), at.alias("id"), F.col("l_linenumber").alias("line"))


def renamed_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from call sites, and findings with their ids in arrays, by the ids that the sites have in the whole graph."""
    sites = _sites(Estate(spark, folder))
    renamed = linking.number_sites(sites.select("scan", "id").distinct())
    edges = sites.select("scan", F.col("id").alias("from"), F.concat(F.lit("cm:"), "line").alias("to")).distinct()
    findings = sites.groupBy("scan", "line").agg(F.array(F.max("id"), F.concat(F.lit("cm:"), F.first("line")), F.min("id")).alias("node_ids"))
    ends = linking.rename_ends(edges, renamed).select("scan", F.lit("edge").alias("kind"), F.concat_ws(">", "from", "to").alias("ids"))
    lists = linking.rename_in_arrays(findings, renamed, "line").select("scan", F.lit("finding").alias("kind"), F.concat_ws("|", F.col("line").cast("string"), F.array_join("node_ids", ",")).alias("ids"))
    return ends.unionByName(lists)


QUERIES = {f.__name__: f for f in (renamed_sites, node_universe, graph_totals, package_universe, diagnostics, diagnostics_by_kind, diagnostics_of_repo, call_counts, impact_capped, endpoint_page, trace_both, reachable_projects, endpoint_details)}

_NODES = """, listed AS (SELECT id, 'repo' AS kind, 1 AS rank, repo AS label, repo FROM repos
  UNION ALL SELECT project_id, 'project', 2, string_split(project_id, '/')[-1], repo FROM (SELECT project_id, repo FROM clients UNION ALL SELECT project_id, repo FROM apis)
  UNION ALL SELECT 'pkg:' || package_key, 'package', 3, package_key, arg_min(repo, project_id) FROM produced GROUP BY package_key
  UNION ALL SELECT 'ep:' || repo || ':' || verb || ':' || norm, 'endpoint', 4, verb || ' ' || route, repo FROM endpoints
  UNION ALL SELECT id, 'clientMethod', 5, method_name, repo FROM methods),
nodes AS (SELECT id, kind, label, repo FROM listed QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, label, repo) = 1)"""
_FOUND = """, found AS (SELECT 'ambiguousRoute' AS kind, 'warning' AS severity, method_id AS node_id, 'endpoints: ' || matches AS message FROM links WHERE matches > 1
  UNION SELECT 'unresolvedClientMethod', 'info', method_id, 'no endpoint' FROM links WHERE matches = 0
  UNION SELECT 'ambiguousProducer', 'warning', 'pkg:' || package_key, 'several producers' FROM produced WHERE confidence = 0
  UNION SELECT 'unresolvedVersion', 'warning', project_id, package_key || ' ' || version FROM refs WHERE starts_with(version, 'unresolved('))"""
_BODIES = {
    "renamed_sites": """, s AS (SELECT l_orderkey % 50 AS scan, 'cs:' || l_suppkey % 5 || '/' || l_partkey % 60 AS id, l_linenumber AS line FROM lineitem),
        r AS (SELECT scan, id, id || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS new FROM (SELECT scan, id, row_number() OVER (PARTITION BY id ORDER BY scan) AS n FROM (SELECT DISTINCT scan, id FROM s))),
        f AS (SELECT scan, line, max(id) AS most, min(id) AS least FROM s GROUP BY ALL)
        SELECT DISTINCT scan, 'edge' AS kind, new || '>cm:' || line AS ids FROM s JOIN r USING (scan, id)
        UNION ALL SELECT f.scan, 'finding', line || '|' || a.new || ',cm:' || line || ',' || b.new FROM f JOIN r a ON a.scan = f.scan AND a.id = most JOIN r b ON b.scan = f.scan AND b.id = least""",
    "node_universe": f"{_NODES} SELECT * FROM nodes",
    "graph_totals": f"{_NODES} SELECT kind, count(*) AS n FROM nodes GROUP BY kind",
    "package_universe": """, seen AS (SELECT upper(package_key) AS package_id, 0 AS list FROM refs UNION SELECT 'Part' || p_partkey, 1 FROM maker JOIN clients USING (s_suppkey))
        SELECT lower(package_id) AS package_key, arg_min(package_id, list) AS package_id, max(list) = 0 AS external FROM seen GROUP BY lower(package_id)""",
    "diagnostics": f"{_FOUND} SELECT * FROM found",
    "diagnostics_by_kind": f"{_FOUND} SELECT kind, severity, count(*) AS n FROM found GROUP BY ALL",
    "diagnostics_of_repo": f"{_FOUND}{_NODES} SELECT * FROM found WHERE severity = 'warning' AND node_id IN (SELECT id FROM nodes WHERE repo = (SELECT min(repo) FROM repos))",
    "call_counts": """, made_calls AS (SELECT a.repo AS from_repo, m.repo AS to_repo, count(*) AS calls FROM events JOIN repos a ON user_id % 25 = a.n_nationkey JOIN methods m ON m.id = 'cm:' || (event_id % (SELECT count(*) FROM pages)) GROUP BY ALL)
        SELECT from_repo, to_repo, coalesce(calls, 0) AS calls FROM depends LEFT JOIN made_calls USING (from_repo, to_repo)""",
    "impact_capped": f"""{catalog._IMPACT}, ranked AS (SELECT root, node, confidence, string_split(node, ':')[1] AS kind, count(*) OVER (PARTITION BY root, string_split(node, ':')[1]) AS total,
        CAST(row_number() OVER (PARTITION BY root, string_split(node, ':')[1] ORDER BY node) AS int) AS rank FROM impact) SELECT *, total > 3 AS truncated FROM ranked WHERE rank <= 3""",
    "endpoint_page": "SELECT id, verb, route, (SELECT count(*) FROM endpoints) AS total, (SELECT count(*) FROM endpoints) > 50 AS truncated FROM endpoints ORDER BY id LIMIT 50",
    "trace_both": """SELECT 'repo:' || from_repo AS root, 'down' AS direction, 'repo:' || to_repo AS node, 1 AS depth, 'repo:' || from_repo AS via, confidence FROM depends
        UNION ALL SELECT 'repo:' || to_repo, 'up', 'repo:' || from_repo, 1, 'repo:' || to_repo, confidence FROM depends""",
    "reachable_projects": "SELECT r.project_id, p.project_id AS reached, min(package_key) AS first_package FROM refs r JOIN produced p USING (package_key) GROUP BY 1, 2",
    "endpoint_details": """, calls AS (SELECT method_id, count(*) AS calls FROM invoked GROUP BY 1), own AS (SELECT endpoint_id AS id, count(*) AS n_methods, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies, CAST(sum(coalesce(calls, 0)) AS bigint) AS n_calls
        FROM links LEFT JOIN calls USING (method_id) WHERE endpoint_id IS NOT NULL GROUP BY 1) SELECT id, verb, route, coalesce(n_methods, 0) AS n_methods, coalesce(strategies, '') AS strategies, coalesce(n_calls, 0) AS n_calls FROM endpoints LEFT JOIN own USING (id)""",
}
ORACLES = {k: f"WITH RECURSIVE {ESTATE_SQL}{v if v.lstrip().startswith(',') else ' ' + v}" for k, v in _BODIES.items()}
