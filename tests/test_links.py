"""Renames, how to call, owners of packages and deep graphs on hand-made rows."""

from pyspark.sql import functions as F

from arcweave.functions import routes
from arcweave.operators import findings, graph, linking, models, nodes
from arcweave.plans import catalog, overview


def test_renames_reach_edges_and_arrays(spark):
    sites = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (2, "b"), (3, "a#2")], "scan int, id string")
    renamed = linking.number_sites(sites)
    assert {(r["scan"], r["old_id"]): r["id"] for r in renamed.collect()} == {(1, "a"): "a", (2, "a"): "a#3", (3, "a"): "a#4", (2, "b"): "b", (3, "a#2"): "a#2"}
    edges = spark.createDataFrame([(1, "a", "m"), (2, "a", "m"), (2, "b", "m"), (3, "a", None), (4, "a", "m"), (2, None, "m")], "scan int, from string, to string")
    ends = linking.rename_ends(edges, renamed)
    assert sorted(map(str, ({(r["scan"], r["from"]) for r in ends.collect()}))) == sorted(map(str, {(1, "a"), (2, "a#3"), (2, "b"), (3, "a#4"), (4, "a"), (2, None)}))
    rows = spark.createDataFrame([(2, 1, ["m", "a", "b", "a"]), (2, 2, ["m"]), (3, 3, None), (3, 4, [])], "scan int, key int, node_ids array<string>")
    assert {r["key"]: r["node_ids"] for r in linking.rename_in_arrays(rows, renamed, "key").collect()} == {1: ["m", "a#3", "b", "a#3"], 2: ["m"], 3: None, 4: []}
    clean = findings.dangling(renamed.select("id").union(spark.createDataFrame([("m",)], "id string")), ends.filter("scan < 4 and to is not null and from is not null").select("from", "to"))
    assert clean.count() == 0 and linking.number_sites(sites.limit(0)).count() == 0


def test_how_to_call(spark):
    endpoints = spark.createDataFrame([("e1",), ("e2",)], "id string")
    links = spark.createDataFrame([("m1", "e1", 2), ("m2", "e1", 0), ("m3", "e1", 2), ("m4", "e1", 2), ("m5", None, 2)], "method_id string, endpoint_id string, confidence int")
    methods = spark.createDataFrame([("m1", "p", "Api", "Get"), ("m2", "p", "IApi", "Get"), ("m3", "q", "Items", "Get"), ("m4", "none", "IApi", "Get"), ("m5", "p", "X", "Get")], "id string, project_id string, type_name string, method_name string")
    made = spark.createDataFrame([("p", "zz", "9"), ("p", "aa", None), ("q", "bb", "2")], "project_id string, package_key string, version string")
    uses = spark.createDataFrame([("e1", "accepts", "B"), ("e1", "accepts", "A"), ("e1", "returns", "C"), ("e1", "returns", "C")], "endpoint_id string, relation string, model_id string")
    got = {(r["endpoint_id"], r["place"]): tuple(r)[2:] for r in nodes.how_to_call(endpoints, links, methods, made, uses).collect()}
    assert got[("e1", 1)] == ("aa", None, "p", "IApi", "Get", 0, "A,B", "C", None) and got[("e1", 2)][3] == "Api" and got[("e1", 3)][:4] == ("bb", "2", "q", "Items")
    assert got[("e2", None)][-1] is not None and len(got) == 4


def test_a_chain_of_any_depth_is_walked_to_its_end(spark):
    hop = spark.createDataFrame([(f"n{i + 1}", f"n{i}", "references", 3) for i in range(60)], "src string, dst string, kind string, confidence int")
    assert graph.widest(spark.createDataFrame([("n0",)], "root string"), hop).count() == 60


def test_an_unused_package_bumps_its_own_repository(spark, tmp_path):
    """One supplier with one part that nothing refers to: its repository is reached by the package."""
    base = "/root/testdata/sf0.001"
    for name in ("nation", "customer", "orders", "lineitem"):
        table = spark.read.parquet(f"{base}/{name}.parquet")
        (table.limit(0) if name in ("orders", "lineitem") else table).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{base}/supplier.parquet").limit(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{base}/part.parquet").filter("p_partkey = 1").write.parquet(f"{tmp_path}/part.parquet")
    only = spark.read.parquet(f"{tmp_path}/supplier.parquet").first()
    spark.createDataFrame([(*only,)], spark.read.parquet(f"{tmp_path}/supplier.parquet").schema).withColumn("s_suppkey", F.lit(0).cast("long")).write.parquet(f"{tmp_path}/one/supplier.parquet")
    for name in ("nation", "customer", "orders", "lineitem", "part"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/one/{name}.parquet")
    found = catalog.impact(spark, f"{tmp_path}/one").collect()
    assert [(r["node"].split(":")[0], r["confidence"]) for r in found] == [("repo", 3)]


def test_routes_with_nested_braces_and_white_space(spark):
    texts = [r"api/{id:regex(^\d{3}$)}/x", "\tapi/x \n", " api / {a} / b ", "{{x}}", "  ~/api/{id?}?q={z}"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(routes.normalize_route(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [r"api/{id:regex(^\d{}$)}/x", "api/x", "api/{}/b", "{{}}", "api/{}"]
    assert spark.range(1).select(routes.combine_routes(F.lit("a b/ c "), F.lit(" /x y/")), routes.combine_routes(F.lit("a/ c"), F.lit("d"))).first()[:] == ("/x y", "/a/ c/d")


def test_impact_of_models_by_kind(spark):
    hop = spark.createDataFrame([("ep", "order", 2), ("line", "lost", 3), ("order", "line", 3), ("cm", "ep", 1), ("cs", "cm", 3), ("cs", "ghost", 3), ("pkg:x", "line", 3)], "src string, dst string, confidence int").withColumn("kind", F.lit("x"))
    table = spark.createDataFrame([("order", "model", "proj:r/a", "r"), ("line", "model", "proj:s/b", "s"), ("ep", "endpoint", "proj:r/a", "r"), ("cm", "clientMethod", "proj:s/b", "s"), ("cs", "callSite", None, "t"), ("pkg:x", "package", None, "u"), ("proj:r/a", "project", None, "r"), ("proj:s/b", "project", None, "s"), ("repo:r", "repo", None, "r"), ("repo:s", "repo", None, "s"), ("repo:t", "repo", None, ""), ("repo:u", "repo", None, None)], "id string, kind string, project_id string, repo string")
    got = {(r["node"], r["kind"]): r["confidence"] for r in models.impact(spark.createDataFrame([("line",)], "root string"), hop, table).collect()}
    assert got == {("order", "model"): 3, ("ep", "endpoint"): 2, ("cm", "clientMethod"): 1, ("cs", "callSite"): 1, ("proj:r/a", "project"): 3, ("proj:s/b", "project"): 1, ("repo:r", "repo"): 3, ("repo:s", "repo"): 1, ("repo:t", "repo"): 1, ("repo:u", "repo"): 3}
    assert models.impact(spark.createDataFrame([], "root string"), hop, table).count() == 0


def test_targets_name_a_model_or_one_of_its_fields(spark):
    known = spark.createDataFrame([("m1", "Acme.Order"), ("m2", "Acme.Line"), ("m3", "Acme.Line"), ("m4", None)], "id string, full_name string")
    fields = spark.createDataFrame([("m1", "Id"), ("m1", "Id"), ("m2", "No")], "owner string, field string")
    names = spark.createDataFrame([("m1",), ("Acme.Order",), ("Acme.Order.Id",), ("Acme.Order.Lost",), ("Acme.Line",), ("Acme.Line.No",), ("Nothing",), ("m1.Id",), (None,)], "name string")
    got = {r["name"]: tuple(r)[1:] for r in models.field_targets(names, known, fields).collect()}
    assert got["m1"] == ("m1", None, "model") == got["Acme.Order"] and got["Acme.Order.Id"] == ("m1", "Id", "field") == got["m1.Id"]
    assert {got[x][2] for x in ("Acme.Order.Lost", "Nothing", None)} == {"not_found"} and got["Acme.Line"] == (None, None, "ambiguous") == got["Acme.Line.No"]


def test_endpoint_parts(spark):
    points = spark.createDataFrame([("e1",), ("e2",)], "id string")
    uses = spark.createDataFrame([("e1", "accepts", "m", "body", 3), ("e1", "returns", "m", "200", 2), ("gone", "returns", "m", "200", 2)], "endpoint_id string, relation string, model_id string, detail string, confidence int")
    links = spark.createDataFrame([("c1", "e1", "refit", 2), ("c2", None, "refit", 2), ("c3", "e2", "refit", 0)], "method_id string, endpoint_id string, strategy string, confidence int")
    methods = spark.createDataFrame([("c1", "p"), ("c3", "q")], "id string, project_id string")
    made = spark.createDataFrame([("p", "b"), ("p", "a")], "project_id string, package_key string")
    calls = spark.createDataFrame([("s", "c1", 2), ("s", "c1", 2)], "site_id string, method_id string, confidence int")
    got = {tuple(r) for r in nodes.endpoint_parts(points, uses, links, methods, made, calls).collect()}
    assert got == {("e1", "accepts", "m", "body", 3), ("e1", "returns", "m", "200", 2), ("e1", "clientMethod", "c1", "refit a", 2), ("e2", "clientMethod", "c3", "refit", 0), ("e1", "caller", "s", "c1", 2)}


def small_lines(spark, tmp_path):
    """The smallest tables with the lines of small quantities alone, and what a change of each client project reaches of api projects: {(root, node): confidence}."""
    base, folder = "/root/testdata/sf0.001", f"{tmp_path}/small"
    for name in ("nation", "supplier", "part", "customer", "orders", "lineitem"):
        table = spark.read.parquet(f"{base}/{name}.parquet")
        (table.filter("l_quantity < 50") if name == "lineitem" else table).write.parquet(f"{folder}/{name}.parquet")
    rows = {name: spark.read.parquet(f"{folder}/{name}.parquet").collect() for name in ("nation", "supplier", "part", "customer", "orders", "lineitem")}
    repo, n = {r["n_nationkey"]: r["n_name"] for r in rows["nation"]}, len(rows["supplier"])
    client = {r["s_suppkey"]: f"proj:{repo[r['s_nationkey']]}/{r['s_name']}" for r in rows["supplier"]}
    api = {r["c_custkey"]: f"proj:{repo[r['c_nationkey']]}/{r['c_name']}" for r in rows["customer"]}
    made = {p: [client[s] for s in ([p % n, (p + 1) % n] if p % 10 == 0 else [p % n]) if s in client] for p in (r["p_partkey"] for r in rows["part"])}
    custom, reached = {r["o_orderkey"]: r["o_custkey"] for r in rows["orders"]}, {}
    for line in rows["lineitem"]:
        for root in made[line["l_partkey"]]:
            key = (root, api[custom[line["l_orderkey"]]])
            reached[key] = max(reached.get(key, 0), min(3 if len(made[line["l_partkey"]]) == 1 else 0, 1 if line["l_returnflag"] == "R" else 3))
    return folder, reached


def test_impact_follows_lines_of_any_quantity(spark, tmp_path):
    folder, reached = small_lines(spark, tmp_path)
    got = {(r["root"], r["node"]): r["confidence"] for r in catalog.impact(spark, folder).filter("startswith(node, 'proj:')").collect()}
    assert len(reached) > 1000 and got == reached


def test_impact_totals_count_lines_of_any_quantity(spark, tmp_path):
    folder, reached = small_lines(spark, tmp_path)
    got = {r["root"]: (r["n"], r["least"]) for r in catalog.impact_totals(spark, folder).filter("kind = 'proj'").collect()}
    assert got == {root: (len(own), min(own)) for root in {r for r, _ in reached} for own in [[c for (r, _), c in reached.items() if r == root]]}


def test_capped_impact_ranks_lines_of_any_quantity(spark, tmp_path):
    folder, reached = small_lines(spark, tmp_path)
    got = {(r["root"], r["rank"]): (r["node"], r["confidence"], r["total"], r["truncated"]) for r in overview.impact_capped(spark, folder).filter("kind = 'proj'").collect()}
    own = {root: sorted(n for r, n in reached if r == root) for root in {r for r, _ in reached}}
    assert got == {(root, i + 1): (n, reached[root, n], len(nodes), len(nodes) > 3) for root, nodes in own.items() for i, n in enumerate(nodes[:3])}
