"""The graph library against DuckDB on the given tables and against small graphs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from arcweave.functions import routes
from arcweave.operators import findings, graph, linking, models
from arcweave.plans import catalog, overview
from arcweave.plans import models as model_plans
from arcweave.sources import documents

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    clean = lambda v: None if v != v else int(v) if isinstance(v, float) and v == int(v) else v
    names = sorted(df.columns)
    return sorted(([clean(v) for v in r] for r in df[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return con


QUERIES, ORACLES = {**catalog.QUERIES, **overview.QUERIES, **model_plans.QUERIES}, {**catalog.ORACLES, **overview.ORACLES, **model_plans.ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_match_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object).where(got.notna(), None)) == rows(want.astype(object).where(want.notna(), None))


# Published cases of routes, here and for combined ones.
@pytest.mark.parametrize(
    ("route", "normal"),
    [("/api/orders/{id}", "api/orders/{}"), ("api/Orders/{id:int}", "api/orders/{}"), ("api/orders/{orderId}/lines/{lineId?}", "api/orders/{}/lines/{}"), ("api/files/{*path}", "api/files/{}"), ("api/orders?page={p}&size=10", "api/orders"), ("https://orders.internal:5001/api/orders/{id}", "api/orders/{}"), ("~/api//orders/", "api/orders"), ("  /api/orders#frag ", "api/orders"), ("api/orders/{id}.json", "api/orders/{}.json"), ("", ""), (None, "")],
)
def test_normalize_route(spark, route, normal):
    assert spark.createDataFrame([(route,)], "r string").select(routes.normalize_route(F.col("r"))).first()[0] == normal


@pytest.mark.parametrize(("prefix", "template", "route"), [("api/orders", "{id}", "/api/orders/{id}"), ("api/orders", "/health", "/health"), ("api/orders", "~/v2/orders", "/v2/orders"), (None, "api/x", "/api/x"), ("api/orders/", None, "/api/orders"), (None, None, "/")])
def test_combine_routes(spark, prefix, template, route):
    assert spark.createDataFrame([(prefix, template)], "p string, t string").select(routes.combine_routes(F.col("p"), F.col("t"))).first()[0] == route


def test_tokens_and_versions(spark):
    df = spark.createDataFrame([("api/[controller]/[action]", "OrdersController", "List"), ("api/[Controller]", "Orders", "Get")], "t string, c string, a string")
    assert [r[0] for r in df.select(routes.replace_tokens(F.col("t"), F.col("c"), F.col("a"))).collect()] == ["api/orders/list", "api/orders"]
    v = spark.createDataFrame([("1.9.0",), ("1.10.0-rc1",), ("1.2",)], "v string")
    assert v.select(F.max_by("v", routes.version_key(F.col("v")))).first()[0] == "1.10.0-rc1"


def test_links(spark):
    methods = spark.createDataFrame([("m1", "r", "get", "a/b", "s", 3), ("m2", "r", "GET", "x/a/b", "s", 3), ("m3", "r", None, "a/b", "s", 3), ("m4", "q", "GET", "a/b", "s", 3)], "id string, repo string, verb string, norm string, strategy string, confidence int")
    points = spark.createDataFrame([("e1", "r", "GET", "a/b"), ("e2", "r", "POST", "a/b")], "id string, repo string, verb string, norm string")
    got = {(r["method_id"], r["endpoint_id"], r["strategy"], r["confidence"], r["matches"]) for r in linking.link_clients(methods, points).collect()}
    assert got == {("m1", "e1", "s", 3, 1), ("m2", "e1", "s+suffix", 0, 1), ("m3", None, "s", 3, 0), ("m4", None, "s", 3, 0)}


def test_root_route_links_exactly(spark):
    methods = spark.createDataFrame([("m", "r", "GET", "", "s", 2), ("n", "r", "GET", None, "s", 2)], "id string, repo string, verb string, norm string, strategy string, confidence int")
    points = spark.createDataFrame([("e", "r", "GET", ""), ("f", "r", "GET", "a")], "id string, repo string, verb string, norm string")
    assert {(r["method_id"], r["endpoint_id"], r["confidence"]) for r in linking.link_clients(methods, points).collect()} == {("m", "e", 2), ("n", None, 2)}


def test_drift_passes_over_unresolved_producers(spark):
    used = spark.createDataFrame([("p", "k", "1.9.0"), ("q", "k", "1.10.0")], "project_id string, package_key string, version string")
    made = spark.createDataFrame([("a", "k", "unresolved($(V))"), ("b", "k", "2.0")], "project_id string, package_key string, version string")
    assert findings.version_drift(used, made).first()["latest"] == "2.0" and findings.version_drift(used, made.filter("project_id = 'a'")).first()["latest"] == "1.10.0"


def test_own_repo_is_affected_through_others(spark):
    reached = spark.createDataFrame([("proj:a", "proj:b", 2), ("proj:a", "pkg:x", 3)], "root string, node string, confidence int")
    owners = spark.createDataFrame([("proj:a", "repo:r"), ("proj:b", "repo:r"), ("proj:b", "proj:a")], "id string, owner string")
    assert {(r["node"], r["confidence"]) for r in graph.roll_up(reached, owners).collect()} == {("proj:b", 2), ("pkg:x", 3), ("repo:r", 2)}


def test_media_types_are_no_routes(spark):
    texts = ["application/json", "Text/html", "multipart/x", "image/png", "audio/mp3", "video/x", "a b/c", "a/{b}", "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(routes.is_route_like(F.col("t"))).collect()]
    assert got == [False] * 4 + [True, True, False, True, False]


def test_too_many_rounds_are_an_error(spark):
    pairs = [(f"{i}a", f"{i}b") for i in range(5)] + [(f"{i}b", f"{i}a") for i in range(5)] + [(f"{i}b", f"{i + 1}a") for i in range(4)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    with pytest.raises(RuntimeError):
        graph.strong_components(df, most_rounds=2).count()
    assert graph.strong_components(df).select("component").distinct().count() == 5


def test_number_ids_passes_taken_numbers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a#2", 4), ("b", 5)], "id string, seq int")
    assert {r["seq"]: r["id"] for r in linking.number_ids(df).collect()} == {1: "a", 2: "a#3", 3: "a#4", 4: "a#2", 5: "b"}


def test_components_widest_and_trace(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "e")], "src string, dst string")
    assert {(r["node"], r["component"]) for r in graph.strong_components(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    hop = spark.createDataFrame([("a", "b", "k", 1), ("a", "c", "k", 3), ("c", "b", "k", 2), ("b", "a", "k", 3)], "src string, dst string, kind string, confidence int")
    root = spark.createDataFrame([("b",)], "root string")
    assert {(r["node"], r["confidence"]) for r in graph.widest(root, hop).collect()} == {("a", 2), ("c", 2)}
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [(r["node"], r["depth"], r["confidence"]) for r in graph.trace(root, hop, nodes, 3, up=True).collect()] == [("a", 1, 1)]


def test_parallel_edges_count_by_kind_then_order(spark):
    rows = [("a", "b", "returns", None, 404, None, 3), ("a", "b", "returns", None, 200, None, 1), ("a", "b", "returns", None, 200, None, 2), ("a", "c", "returns", None, 200, None, 3), ("a", "c", "accepts", "query", None, None, 2), ("a", "c", "accepts", "body", None, None, 1), ("b", "d", "fieldOf", None, None, "Y", 2), ("b", "d", "fieldOf", None, None, "X", 0), ("c", "d", "fieldOf", None, None, "A", 3), ("c", "e", "fieldOf", None, None, "Z", 3), ("c", "e", "fieldOf", None, None, None, 1)]
    hop = spark.createDataFrame(rows, "src string, dst string, kind string, source string, status int, field string, confidence int")
    root = spark.createDataFrame([("a",)], "root string")
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "id string")
    got = lambda order: sorted((r["node"], r["depth"], r["via"], r["via_kind"], r["confidence"]) for r in graph.trace(root, hop, nodes, 2, up=False, order=order).collect())
    assert got(("source", "status", "field")) == [("b", 1, "a", "returns", 2), ("c", 1, "a", "accepts", 1), ("d", 2, "b", "fieldOf", 0), ("e", 2, "c", "fieldOf", 1)]
    assert got(()) == [("b", 1, "a", "returns", 3), ("c", 1, "a", "accepts", 2), ("d", 2, "b", "fieldOf", 2), ("e", 2, "c", "fieldOf", 2)]
    assert graph.trace(root.limit(0), hop, nodes, 2, up=False, order=("source",)).count() == 0


def test_snippets_lines_limits_and_refusals(spark):
    files = spark.createDataFrame([("a", "x\r\ny\rz\n"), ("b", ""), ("c", None), ("d", "é" * 6), ("e", "\n"), ("f", "\n".join(map(str, range(200))))], "path string, text string")
    places = spark.createDataFrame([("1", "a", None), ("2", "a", 99), ("3", "b", 1), ("4", "c", 1), ("5", "d", 1), ("6", "e", 5), ("7", "lost", 1), ("8", None, 1)], "node_id string, path string, line int")
    got = sorted(tuple(r) for r in documents.snippets(places, files, context=0, most_bytes=11).collect())
    assert got == [("1", 1, "    1| x"), ("2", 3, "    3| z"), ("6", 1, "    1| ")]
    assert documents.snippets(places, files, context=-3, most_chars=2).filter("node_id = '5'").first()["text"] == "    1| éé…"
    middle = spark.createDataFrame([("m", "f", 100)], "node_id string, path string, line int")
    assert documents.snippets(middle, files, context=70).count() == 101
    refused = {r["node_id"]: r["problem"] for r in documents.snippet_refusals(places, files, most_bytes=11).collect()}
    assert refused == {"4": "unreadable", "5": "too large", "7": "missing", "8": "missing"}
    assert documents.snippet_refusals(places.limit(0), files).count() == 0


def test_manifest_holds_heads_and_versions(spark):
    files = spark.createDataFrame([("a", "x"), ("b", None)], "path string, text string")
    repos = spark.createDataFrame([("r", "abc"), ("s", None)], "repo string, head string")
    was = documents.manifest(files, repos, {"rules": "1"})
    assert {r["path"]: r["sha256"] for r in was.filter("path <> 'a'").collect()} == {"b": "unreadable", "repo:r": "abc", "repo:s": "", "rules": "1"}
    now = documents.manifest(files, repos.filter("repo = 's'"), {"rules": "2", "schema": "1"})
    assert {tuple(r) for r in documents.manifest_changes(was, now).collect()} == {("repo:r", "removed"), ("rules", "changed"), ("schema", "added")}


def test_pins_settle_who_makes_a_package(spark):
    made = spark.createDataFrame([("p1", "R1", "A"), ("p2", "R2", "a"), ("p3", "R1", "B"), ("p4", "R2", "b"), ("p5", "R1", "C"), ("p6", "R1", None), ("p7", "R1", "D"), ("p8", "R1", "d"), ("p9", "R2", "d")], "id string, repo string, package_id string").selectExpr("*", "'1' as version")
    pins = spark.createDataFrame([("a", "r2"), ("C", "lost"), ("D", "R1"), ("e", "R1"), ("a", "z"), ("b", None)], "package_key string, repo string")
    assert sorted((r["package_key"], r["project_id"], r["confidence"]) for r in linking.produces(made, pins).collect()) == [("a", "p2", 3), ("b", "p3", 0), ("b", "p4", 0), ("d", "p7", 0), ("d", "p8", 0)]
    assert linking.produces(made, pins.limit(0)).count() == linking.produces(made).count() == 8


def test_documents_round_trip(spark, tmp_path):
    source = tmp_path / "graph.json"
    source.write_text('﻿{"schemaVersion": 1, "repos": [{"id": "repo:a", "name": "a", "path": "a", "dirty": false}], "edges": [{"kind": "references", "from": "x", "to": "y", "confidence": "certain"}, {"kind": "dependsOn", "from": "a", "to": "b", "confidence": "low", "viaPackages": ["p"]}]}', encoding="utf-8")
    tables = documents.read_document(spark, str(source))
    assert tables["repos"].count() == 1 and tables["models"].count() == 0
    documents.write_tables(tables, str(tmp_path / "tables"))
    again = documents.read_tables(spark, str(tmp_path / "tables"))
    assert {r["kind"] for r in again["edges"].collect()} == {"references", "dependsOn"}
    assert [r["kind"] for r in documents.sorted_rows("edges", tables["edges"]).collect()] == ["references", "dependsOn"]


def test_resolve_and_fuzzy(spark):
    columns = "id string, kind string, label string, verb string, route string, norm string"
    own = [("repo:o", "repo", "orders", None, None, None), ("repo:p", "repo", "Orders", None, None, None), ("model:a:X.Dto", "model", "X.Dto", None, None, None), ("model:b:Y.Dto", "model", "Y.Dto", None, None, None)]
    own += [("ep:1", "endpoint", "", "GET", "/api/A/{id}", "api/a/{}"), ("ep:2", "endpoint", "", "GET", "/api/a/{key}", "api/a/{}")]
    nodes = spark.createDataFrame(own, columns)
    names = spark.createDataFrame([("ORDERS",), ("Dto",), ("none",), ("repo:o",), ("get /API/a/{id}",), ("GET api/a/{other}?x=1",), ("POST /api/a/{id}",)], "name string")
    got = {r["name"]: (r["status"], r["candidates"]) for r in findings.resolve(names, nodes).collect()}
    assert got["ORDERS"] == ("found", "repo:o") and got["Dto"][0] == "ambiguous" and got["none"] == ("not_found", "") and got["repo:o"] == ("found", "repo:o")
    assert got["get /API/a/{id}"] == ("found", "ep:1") and got["GET api/a/{other}?x=1"] == ("ambiguous", "ep:1,ep:2") and got["POST /api/a/{id}"][0] == "not_found"
    assert findings.fuzzy(["order"], nodes, 1).first()["id"] == "repo:o"


def test_model_tree_usages_and_unused(spark):
    """A cycle ends in a stub, the last level gives no types, containers of containers count, and a field of another repository is marked."""
    own = spark.createDataFrame([("a", "r", "p"), ("b", "r", "p"), ("c", "q", "p"), ("d", "q", "p")], "id string, repo string, project_id string")
    fields = spark.createDataFrame([("a", "b", "b", 3), ("b", "a", "a", 2), ("b", "c", "c", 1), ("a", "n", None, 3)], "owner string, field string, type_id string, confidence int")
    got = {(r["path"], r["field"], r["type_id"], r["cross_repo"], r["stub"]) for r in models.tree(own, fields, 2).filter("root = 'a'").collect()}
    assert got == {("a", "b", "b", False, False), ("a", "n", None, False, False), ("a>b=b", "a", "a", False, True), ("a>b=b", "c", "c", True, False)}
    assert {(r["field"], r["type_id"]) for r in models.tree(own, fields, 0).filter("root = 'b'").collect()} == {("a", None), ("c", None)}
    uses = spark.createDataFrame([("e", "accepts", "a", 3), ("e", "returns", "b", 2), ("f", "returns", "c", 3)], "endpoint_id string, relation string, model_id string, confidence int")
    used = models.usages(own, fields, uses)
    assert {(r["endpoint_id"], r["relation"], r["via"], r["confidence"]) for r in used.filter("model = 'c'").collect()} == {("e", "accepts", "a", 1), ("e", "returns", "b", 1), ("f", "returns", "c", 3)}
    points, callers = spark.createDataFrame([("e", "r"), ("f", "")], "id string, repo string"), spark.createDataFrame([("f", "q")], "endpoint_id string, repo string")
    assert {r["repo"] for r in models.consumers(used, points, callers).filter("model = 'c'").collect()} == {"r", "q"}
    clients = own.select("project_id")
    assert [r["id"] for r in models.unused(own, clients, fields, uses).collect()] == ["d"]
    assert models.tree(own.limit(0), fields.limit(0)).count() == 0 and models.usages(own.limit(0), fields.limit(0), uses).count() == 0
