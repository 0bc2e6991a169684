"""Registered queries of the graph library, each over whole tables, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routes
from ..operators import details, findings, graph, linking
from ..sources import documents
from .estate import ESTATE_SQL, Estate, _lookup_sql

Query = Callable[[SparkSession, str], DataFrame]
SEARCHES = ("part 1", "stel", "zzz")


MEDIA = ("application/json", "audio/mpeg", "Image/png", "video/mp4", "text/html", "multipart/form-data")


def _candidate():
    """The route, or a media type for six pages in 13."""
    return F.coalesce(F.get(F.array(*map(F.lit, MEDIA)), (F.col("page_id") % 13).cast("int")), F.col("route"))


def route_rules(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder).endpoints()
    return e.select("page_id", "norm", "lookup", routes.combine_routes(F.concat(F.lit("api/v"), (F.col("page_id") % 3).cast("string")), F.col("norm")).alias("combined"), routes.is_route_like(_candidate()).alias("route_like"), routes.glob_match(F.col("route"), "*.example.com*").alias("com_host"), routes.verb_of_method(F.concat(F.initcap(F.lower("verb")), F.lit("Order"))).alias("verb"))


def client_links(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return linking.link_clients(e.methods(), e.endpoints())


def _produced(e: Estate) -> DataFrame:
    return linking.produces(e.made())


def repo_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    out = linking.repo_dependencies(e.references(), _produced(e))
    return out.select("from_repo", "to_repo", "confidence", F.size("via").cast("long").alias("n_packages"))


def ambiguous_producers(spark: SparkSession, folder: str) -> DataFrame:
    low = _produced(Estate(spark, folder)).filter("confidence = 0")
    return low.groupBy("package_key").agg(F.count(F.lit(1)).alias("producers"), F.array_join(F.sort_array(F.collect_set("project_id")), ",").alias("projects"))


def pinned_producers(spark: SparkSession, folder: str) -> DataFrame:
    """Producers where every second package is pinned to the repository of its last maker, and every seventh to one that makes nothing."""
    made = Estate(spark, folder).made()
    last = made.filter("package_id is not null").groupBy(F.upper("package_id").alias("package_key")).agg(F.max_by("repo", "id").alias("repo"))
    number = F.substring("package_key", 5, 20).cast("int")
    pins = last.select("package_key", F.when(number % 7 == 0, "nowhere").when(number % 2 == 0, F.lower("repo")).alias("repo")).filter("repo is not null")
    return linking.produces(made, pins).select("package_key", "project_id", "confidence")


def version_drift(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return findings.version_drift(e.references(), _produced(e))


def unused_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return findings.unused_endpoints(e.endpoints(), linking.link_totals(e.methods().withColumn("calls", F.lit(0)), e.endpoints()), e.methods())


def unused_methods(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return findings.unused_methods(e.methods(), e.invoked())


def endpoint_callers(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return linking.link_totals(e.methods().withColumn("calls", F.lit(0)), e.endpoints()).select("endpoint_id", F.col("n_methods").alias("callers"))


def hotspots(spark: SparkSession, folder: str) -> DataFrame:
    return endpoint_callers(spark, folder).orderBy(F.desc("callers"), "endpoint_id").limit(5)


def repo_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    """The five repositories on which most others depend."""
    return _depends(Estate(spark, folder)).groupBy(F.col("dst").alias("repo_id")).agg(F.count_distinct("src").alias("dependents")).orderBy(F.desc("dependents"), "repo_id").limit(5)


def link_findings(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("matches") == 0, "unresolvedRoute").when(F.col("matches") > 1, "ambiguousRoute")
    e = Estate(spark, folder)
    return linking.link_counts(e.methods(), e.endpoints()).select("method_id", kind.alias("kind")).filter("kind is not null").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _depends(e: Estate) -> DataFrame:
    return linking.repo_dependencies(e.references(), _produced(e)).select(F.concat(F.lit("repo:"), "from_repo").alias("src"), F.concat(F.lit("repo:"), "to_repo").alias("dst"), F.lit("dependsOn").alias("kind"), "confidence")


def cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.strong_components(_depends(Estate(spark, folder)).select("src", "dst"))


def neighbors_up(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbors(reference_hops(Estate(spark, folder)).unionByName(_depends(Estate(spark, folder))), up=True)


def trace_down(spark: SparkSession, folder: str) -> DataFrame:
    """What each api project depends on in two steps: packages, and the projects that make them."""
    e, hop = Estate(spark, folder), reference_hops(Estate(spark, folder))
    nodes = hop.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = graph.trace(e.apis().select(F.col("project_id").alias("root")), hop, nodes, depth=2, up=False)
    return found.select("root", "node", "depth", "via", "via_kind", "confidence", F.array_join("visit", ">").alias("visit"))


def reference_hops(e: Estate) -> DataFrame:
    """Projects depend on packages (less surely where the version is unresolved), packages on the projects that make them."""
    used = e.references().select(F.col("project_id").alias("from"), F.concat(F.lit("pkg:"), "package_key").alias("to"), F.lit("references").alias("kind"), F.when(F.startswith("version", F.lit("unresolved(")), 1).otherwise(3).alias("confidence"))
    made = _produced(e).select(F.col("project_id").alias("from"), F.concat(F.lit("pkg:"), "package_key").alias("to"), F.lit("produces").alias("kind"), "confidence")
    return graph.hops(used.union(made))


def impact(spark: SparkSession, folder: str) -> DataFrame:
    """What a change of each client project reaches: api projects and the repositories of projects and packages, with the best path's confidence."""
    e = Estate(spark, folder)
    made = _produced(e)
    reached = graph.widest(e.clients().select(F.col("project_id").alias("root")), reference_hops(e))
    projects = e.clients().select("project_id", "repo").union(e.apis().select("project_id", "repo")).select(F.col("project_id").alias("id"), "repo")
    packages = made.groupBy("package_key").agg(F.min_by("repo", "project_id").alias("repo")).select(F.concat(F.lit("pkg:"), "package_key").alias("id"), "repo")
    owners = projects.union(packages).select("id", F.concat(F.lit("repo:"), "repo").alias("owner"))
    return graph.roll_up(reached, owners).filter("not startswith(node, 'pkg:')")


def impact_totals(spark: SparkSession, folder: str) -> DataFrame:
    return impact(spark, folder).groupBy("root", F.substring_index("node", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least"))


def repo_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    depends = linking.repo_dependencies(e.references(), _produced(e)).select("from_repo", "to_repo")
    return findings.repo_summary(e.repos(), {"n_clients": e.clients(), "n_apis": e.apis(), "n_endpoints": e.endpoints(), "n_methods": e.methods()}, depends)


def repo_packages(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    return details.repo_packages(e.references(), _produced(e))


def fuzzy_search(spark: SparkSession, folder: str) -> DataFrame:
    part = Estate(spark, folder).raw("part").select(F.concat(F.lit("pkg:Part"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    return findings.fuzzy(list(SEARCHES), part)


def resolve_names(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories in lower case, endpoints by verb and route in two forms, ids, and words that nothing has."""
    e = Estate(spark, folder)
    none = F.lit(None).cast("string")
    nodes = e.repos().select("id", F.lit("repo").alias("kind"), F.col("repo").alias("label"), none.alias("verb"), none.alias("route"), none.alias("norm"))
    nodes = nodes.union(e.endpoints().select("id", F.lit("endpoint"), F.concat("verb", F.lit(" "), "route"), "verb", "route", "norm"))
    ask = e.endpoints().select(F.explode(F.array(F.concat(F.lower("verb"), F.lit(" "), F.upper("route")), F.concat("verb", F.lit(" /"), "norm", F.lit("/?q=1")), F.col("id"))).alias("name"))
    return findings.resolve(ask.union(e.repos().select(F.lower("repo"))).union(e.methods().select("id")), nodes)


def integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that several endpoints have, and packages that are referenced but no node, since nobody makes them."""
    e = Estate(spark, folder)
    nodes = e.endpoints().select(F.concat_ws(":", F.lit("ep"), "repo", "verb", "norm").alias("id")).union(e.apis().select("project_id")).union(_produced(e).select(F.concat(F.lit("pkg:"), "package_key")).distinct())
    return findings.dangling(nodes, e.references().select(F.col("project_id").alias("from"), F.concat(F.lit("pkg:"), "package_key").alias("to")))


def unique_ids(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder).endpoints()
    rows = e.select(F.concat_ws(":", F.lit("ep"), "repo", "verb", "norm").alias("id"), F.col("page_id").alias("seq"))
    return linking.number_ids(rows)


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    files = Estate(spark, folder).files()
    was = documents.manifest(files.filter("doc_id % 10 <> 3"))
    now = documents.manifest(files.filter("doc_id % 10 <> 7").withColumn("text", F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return documents.manifest_changes(was, now)


def file_snippets(spark: SparkSession, folder: str) -> DataFrame:
    files = Estate(spark, folder).files()
    places = files.select(F.col("path").alias("node_id"), "path", (F.col("doc_id") % 7 + 1).cast("int").alias("line"))
    out = documents.snippets(places, files, context=1)
    return out.select("node_id", "line", F.sha2("text", 256).alias("sha256"))


def snippet_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, of which every ninth is lost; files of more than 10,000 bytes count as too large."""
    files = Estate(spark, folder).files()
    places = files.select(F.col("path").alias("node_id"), "path")
    return documents.snippet_refusals(places, files.filter("doc_id % 9 <> 4"), most_bytes=10_000)


def workspace_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What makes a workspace out of date: files, heads of repositories (one in four moved, one is new) and the version of the rules."""
    e = Estate(spark, folder)
    heads = lambda moved: e.repos().select("repo", "n_nationkey", F.when(F.col("n_nationkey") % 4 == 1, moved).otherwise(F.col("n_nationkey").cast("string")).alias("head"))
    was = documents.manifest(e.files().filter("doc_id % 10 <> 3"), heads("old").filter("n_nationkey <> 7"), {"rules": "1", "schema": "1"})
    now = documents.manifest(e.files().filter("doc_id % 10 <> 7"), heads("new"), {"rules": "2", "schema": "1"})
    return documents.manifest_changes(was, now)


def endpoint_search(spark: SparkSession, folder: str) -> DataFrame:
    e = Estate(spark, folder)
    found = e.endpoints().filter(F.contains(F.lower("route"), F.lit("blog")) & graph.any_of(F.col("verb"), ["get", "put"]))
    return graph.page(found.join(endpoint_callers(spark, folder), found["id"] == F.col("endpoint_id"), "left").select("id", "verb", "route", F.coalesce("callers", F.lit(0)).alias("callers")), "id", 500)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (route_rules, client_links, repo_dependencies, ambiguous_producers, pinned_producers, version_drift, unused_endpoints, unused_methods, endpoint_callers, hotspots, repo_hotspots, link_findings, cycles, neighbors_up, trace_down, impact, impact_totals, repo_summary, fuzzy_search, resolve_names, integrity, unique_ids, changed_files, workspace_changes, file_snippets, snippet_refusals, endpoint_search, repo_packages)
}

_IMPACT = """,
ref AS (SELECT project_id, package_key, max(CASE WHEN starts_with(version, 'unresolved(') THEN 1 ELSE 3 END) AS confidence FROM refs GROUP BY ALL),
reach AS (SELECT project_id AS root, 'pkg:' || package_key AS node, confidence FROM produced
  UNION ALL SELECT p.project_id, r.project_id, max(least(p.confidence, r.confidence)) FROM produced p JOIN ref r USING (package_key) GROUP BY ALL),
owner AS (SELECT project_id AS id, 'repo:' || repo AS owner FROM clients UNION ALL SELECT project_id, 'repo:' || repo FROM apis UNION ALL SELECT 'pkg:' || package_key, 'repo:' || arg_min(repo, project_id) FROM produced GROUP BY package_key),
rolled AS (SELECT root, node, confidence FROM reach WHERE NOT starts_with(node, 'pkg:') UNION ALL SELECT root, owner, confidence FROM reach JOIN owner ON node = id),
impact AS (SELECT root, node, max(confidence) AS confidence FROM rolled GROUP BY ALL)
"""
_HOPS = """, hops AS (SELECT project_id AS src, 'pkg:' || package_key AS dst, 'references' AS kind, CASE WHEN starts_with(version, 'unresolved(') THEN 1 ELSE 3 END AS edge FROM refs
  UNION ALL SELECT 'pkg:' || package_key, project_id, 'produces', confidence FROM produced), step AS (SELECT src, dst, kind, max(edge) AS edge FROM hops GROUP BY ALL)"""
_CALLERS = "SELECT endpoint_id, count(*) AS callers FROM links WHERE endpoint_id IS NOT NULL GROUP BY 1"

_BODIES = {
    "route_rules": r"SELECT page_id, norm, lookup, '/api/v' || (page_id % 3) || CASE WHEN norm = '' THEN '' ELSE '/' || norm END AS combined, CASE WHEN page_id % 13 IN (0, 2, 4, 5) THEN false WHEN page_id % 13 IN (1, 3) THEN true ELSE regexp_matches(route, '[/{]') AND NOT regexp_matches(route, '\s') END AS route_like, route ILIKE '%.example.com%' AS com_host, verb FROM endpoints",
    "client_links": "SELECT * FROM links",
    "repo_dependencies": "SELECT * FROM depends",
    "ambiguous_producers": "SELECT package_key, count(*) AS producers, string_agg(project_id, ',' ORDER BY project_id) AS projects FROM produced WHERE confidence = 0 GROUP BY 1",
    "pinned_producers": """, pin AS (SELECT package_key, CAST(substr(package_key, 5) AS int) AS k, arg_max(repo, project_id) AS r FROM produced GROUP BY package_key),
        kept AS (SELECT package_key, project_id FROM produced JOIN pin USING (package_key) WHERE CASE WHEN k % 7 = 0 THEN false WHEN k % 2 = 0 THEN repo = r ELSE true END)
        SELECT package_key, project_id, CASE WHEN count(*) OVER (PARTITION BY package_key) > 1 THEN 0 ELSE 3 END AS confidence FROM kept""",
    "version_drift": """, good AS (SELECT *, [CAST(x AS int) FOR x IN string_split(version, '.')] AS k FROM refs WHERE NOT starts_with(version, 'unresolved(')),
        latest AS (SELECT package_key, coalesce(min(p.version) FILTER (WHERE NOT starts_with(p.version, 'unresolved(')), arg_max(g.version, g.k)) AS latest FROM produced p LEFT JOIN good g USING (package_key) GROUP BY 1),
        behind AS (SELECT DISTINCT package_key, latest, project_id || ' ' || version AS b FROM good JOIN latest USING (package_key) WHERE version <> latest)
        SELECT package_key, latest, string_agg(b, ', ' ORDER BY b) AS behind, count(*) AS n_behind FROM behind GROUP BY 1, 2""",
    "unused_endpoints": "SELECT id, repo FROM endpoints WHERE repo IN (SELECT repo FROM methods) AND id NOT IN (SELECT endpoint_id FROM links WHERE endpoint_id IS NOT NULL)",
    "unused_methods": "SELECT id, project_id, method_name FROM methods WHERE verb IS NOT NULL AND (project_id, method_name) NOT IN (SELECT project_id, method_name FROM methods WHERE id IN (SELECT method_id FROM invoked))",
    "endpoint_callers": _CALLERS,
    "hotspots": f"{_CALLERS} ORDER BY callers DESC, endpoint_id LIMIT 5",
    "repo_hotspots": "SELECT 'repo:' || to_repo AS repo_id, count(DISTINCT from_repo) AS dependents FROM depends GROUP BY to_repo ORDER BY dependents DESC, repo_id LIMIT 5",
    "link_findings": "SELECT CASE WHEN matches = 0 THEN 'unresolvedRoute' ELSE 'ambiguousRoute' END AS kind, count(DISTINCT method_id) AS n FROM links WHERE matches <> 1 GROUP BY 1",
    "cycles": """, step AS (SELECT 'repo:' || from_repo AS s, 'repo:' || to_repo AS d FROM depends), closure AS (SELECT s, d FROM step UNION SELECT c.s, t.d FROM closure c JOIN step t ON c.d = t.s),
        mutual AS (SELECT x.s AS node, x.d AS other FROM closure x JOIN closure y ON x.s = y.d AND x.d = y.s WHERE x.s <> x.d) SELECT node, least(node, min(other)) AS component FROM mutual GROUP BY node""",
    "neighbors_up": f"{_HOPS} SELECT dst AS node, src AS neighbor FROM hops UNION SELECT 'repo:' || to_repo, 'repo:' || from_repo FROM depends",
    "trace_down": f"""{_HOPS}, one AS (SELECT src AS root, dst AS node, 1 AS depth, src AS via, kind AS via_kind, edge AS confidence, src || '>' || dst AS visit FROM step WHERE kind = 'references'),
        two AS (SELECT root, dst AS node, 2 AS depth, min(node) AS via, 'produces' AS via_kind, arg_min(least(confidence, edge), node) AS confidence, arg_min(visit || '>' || dst, node) AS visit FROM one JOIN step ON node = src GROUP BY root, dst) SELECT * FROM one UNION ALL SELECT * FROM two""",
    "impact": f"{_IMPACT} SELECT * FROM impact",
    "impact_totals": f"{_IMPACT} SELECT root, string_split(node, ':')[1] AS kind, count(*) AS n, min(confidence) AS least FROM impact GROUP BY ALL",
    "repo_summary": """, d AS (SELECT from_repo, to_repo FROM depends)
        SELECT repo, (SELECT count(*) FROM clients c WHERE c.repo = r.repo) AS n_clients, (SELECT count(*) FROM apis c WHERE c.repo = r.repo) AS n_apis, (SELECT count(*) FROM endpoints c WHERE c.repo = r.repo) AS n_endpoints, (SELECT count(*) FROM methods c WHERE c.repo = r.repo) AS n_methods,
        coalesce((SELECT string_agg(to_repo, ',' ORDER BY to_repo) FROM d WHERE from_repo = r.repo), '') AS depends_on, coalesce((SELECT string_agg(from_repo, ',' ORDER BY from_repo) FROM d WHERE to_repo = r.repo), '') AS depended_on_by FROM repos r""",
    "repo_packages": """, first AS (SELECT package_key, arg_min(repo, project_id) AS producer_repo FROM produced GROUP BY 1)
        SELECT repo, 'publishes' AS role, package_key, version, project_id, repo AS producer_repo FROM produced
        UNION ALL SELECT repo, 'consumes', package_key, version, project_id, producer_repo FROM refs JOIN first USING (package_key) WHERE producer_repo <> repo""",
    "fuzzy_search": f""", n AS (SELECT 'pkg:Part' || p_partkey AS id, lower('pkg:Part' || p_partkey) AS a, lower(p_name) AS b FROM part), q AS (SELECT unnest({list(SEARCHES)}) AS query),
        ranked AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN contains(a, query) OR contains(b, query) THEN 0 ELSE 1 END, least(levenshtein(a, query), levenshtein(b, query)), id) AS int) AS rank, id FROM n, q) SELECT * FROM ranked WHERE rank <= 5""",
    "resolve_names": f""", names AS (SELECT unnest([lower(verb) || ' ' || upper(route), verb || ' /' || norm || '/?q=1', id]) AS name FROM endpoints UNION SELECT lower(repo) FROM repos UNION SELECT id FROM methods),
        hits AS (SELECT name, id, 0 AS rule FROM names JOIN endpoints ON id = name UNION ALL SELECT name, min(r.id), 1 FROM names JOIN repos r ON lower(repo) = lower(name) GROUP BY name
          UNION ALL SELECT name, id, 2 FROM names JOIN endpoints ON upper(split_part(name, ' ', 1)) = verb AND lower(split_part(name, ' ', 2)) = lower(route)
          UNION ALL SELECT name, id, 3 FROM names JOIN endpoints ON ends_with(name, '/?q=1') AND name = verb || ' /' || norm || '/?q=1'
          UNION ALL SELECT name, id, 3 FROM names JOIN endpoints ON NOT ends_with(name, '/?q=1') AND contains(name, ' ') AND upper(split_part(name, ' ', 1)) = verb AND norm = {_lookup_sql("split_part(name, ' ', 2)")}),
        best AS (SELECT name, id FROM hits QUALIFY rule = min(rule) OVER (PARTITION BY name))
        SELECT name, CASE count(DISTINCT id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '') AS candidates FROM names LEFT JOIN best USING (name) GROUP BY name""",
    "integrity": """, nodes AS (SELECT 'ep:' || repo || ':' || verb || ':' || norm AS id FROM endpoints UNION ALL SELECT project_id FROM apis UNION ALL SELECT DISTINCT 'pkg:' || package_key FROM produced), ends AS (SELECT project_id AS id FROM refs UNION SELECT 'pkg:' || package_key FROM refs)
        SELECT 'duplicate' AS problem, id FROM nodes GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'dangling', id FROM ends WHERE id NOT IN (SELECT id FROM nodes)""",
    "unique_ids": """, r AS (SELECT 'ep:' || repo || ':' || verb || ':' || norm AS id, page_id AS seq, row_number() OVER (PARTITION BY repo, verb, norm ORDER BY page_id) AS n FROM endpoints) SELECT CASE WHEN n = 1 THEN id ELSE id || '#' || n END AS id, seq FROM r""",
    "changed_files": """SELECT 'src/' || source || '/' || doc_id || '.cs' AS path, CASE doc_id % 10 WHEN 3 THEN 'added' WHEN 7 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (3, 5, 7)""",
    "file_snippets": r""", f AS (SELECT 'src/' || source || '/' || doc_id || '.cs' AS node_id, string_split_regex(text, '\r?\n') AS l, least(doc_id % 7 + 1, len(string_split_regex(text, '\r?\n'))) AS t FROM documents WHERE text <> ''), x AS (SELECT node_id, l, unnest(range(greatest(t - 1, 1), least(t + 1, len(l)) + 1)) AS i FROM f)
        SELECT node_id, CAST(i AS int) AS line, sha256(lpad(CAST(i AS varchar), 5, ' ') || '| ' || CASE WHEN length(l[i]) > 1999 THEN substr(l[i], 1, 1999) || '…' ELSE l[i] END) AS sha256 FROM x""",
    "snippet_refusals": """, f AS (SELECT 'src/' || source || '/' || doc_id || '.cs' AS path, CASE WHEN doc_id % 9 = 4 THEN 'missing' WHEN text IS NULL THEN 'unreadable' WHEN strlen(text) > 10000 THEN 'too large' END AS problem FROM documents) SELECT path AS node_id, path, problem FROM f WHERE problem IS NOT NULL""",
    "workspace_changes": """SELECT 'src/' || source || '/' || doc_id || '.cs' AS path, CASE doc_id % 10 WHEN 3 THEN 'added' ELSE 'removed' END AS change FROM documents WHERE doc_id % 10 IN (3, 7)
        UNION ALL SELECT 'repo:' || repo, CASE n_nationkey WHEN 7 THEN 'added' ELSE 'changed' END FROM repos WHERE n_nationkey = 7 OR n_nationkey % 4 = 1 UNION ALL SELECT 'rules', 'changed'""",
    "endpoint_search": f", c AS ({_CALLERS}) SELECT id, verb, route, coalesce(callers, 0) AS callers FROM endpoints LEFT JOIN c ON id = endpoint_id WHERE contains(lower(route), 'blog') AND verb IN ('GET', 'PUT') ORDER BY id LIMIT 500",
}
ORACLES = {k: f"WITH RECURSIVE {ESTATE_SQL}{v if v.lstrip().startswith(',') else ' ' + v}" for k, v in _BODIES.items()}
