"""Class routes, project files and listings on hand-made input."""

from pyspark.sql import functions as F

from arcweave.operators import controllers
from arcweave.sources import workspace

CLASS = "class_id string, project_id string, name string, seq int, is_abstract boolean, bases array<string>, own_route string, is_controller boolean"


def routes(spark, rows):
    out = controllers.class_routes(spark.createDataFrame(rows, CLASS)).collect()
    return {r[0]: (r[1], r[2]) for r in out}


def test_class_routes_follow_long_chains_and_end_in_cycles(spark):
    chain = [(f"a{i}", "p", f"A{i}", i, False, ["ILost", f"N.A{i - 1}<T>"] if i else None, "top" if i == 0 else None, i == 0) for i in range(70)]
    cycle = [(f"c{i}", "q", f"C{i}", i, False, [f"C{(i + 1) % 5}"], None, i == 3) for i in range(5)] + [("self", "q", "Self", 9, None, ["Self"], None, None)]
    other = [("x", "r", "X", 0, False, ["A0"], None, False), ("d1", "r", "D", 1, False, None, "first", True), ("d2", "r", "D", 2, False, None, "second", False), ("e", "r", "E", 3, False, ["D"], None, False), ("near", "r", "F", 4, False, ["D"], "own", False)]
    got = routes(spark, chain + cycle + other)
    assert all(got[f"a{i}"] == ("top", True) for i in range(70)) and all(got[f"c{i}"] == (None, True) for i in range(5))
    assert got["self"] == (None, False) and got["x"] == (None, False) and got["e"] == ("first", True) and got["near"] == ("own", True)
    assert routes(spark, []) == {}


def test_controller_and_mapped_endpoints(spark):
    classes = spark.createDataFrame([("b", "p", "Base", 0, True, None, "api/[controller]", True), ("o", "p", "OrdersController", 1, False, ["Base"], None, False), ("n", "p", "Plain", 2, False, None, "x", False)], CLASS)
    methods = spark.createDataFrame([(1, "o", "List", "GET", "{id}", "no"), (2, "o", "List", "GET", None, "[Action]"), (3, "o", "Put", "PUT", "~/v2/[action]", None), (4, "b", "Get", "GET", None, None), (5, "n", "Get", "GET", None, None)], "method_id int, class_id string, method string, verb string, template string, method_route string")
    got = {r["method_id"]: (r["route"], r["handler"]) for r in controllers.controller_endpoints(methods, classes).collect()}
    assert got == {1: ("/api/orders/{id}", "OrdersController.List"), 2: ("/api/orders/list", "OrdersController.List"), 3: ("/v2/put", "OrdersController.Put")}
    maps = spark.createDataFrame([(1, "GET", "/api", "/"), (2, "GET", "/api/", "/x/{Id}"), (3, "GET", None, "~/x"), (4, "GET", "/api", None)], "map_id int, verb string, prefix string, template string")
    assert {r["map_id"]: r["route"] for r in controllers.mapped_endpoints(maps).collect()} == {1: "/api", 2: "/api/x/{Id}", 3: "/x"}


GOOD = """<?xml version="1.0"?><!-- c --><Project xmlns="http://x"><Sdk Name="Own.Sdk"/><PropertyGroup><A> 1 </A></PropertyGroup><PropertyGroup Condition="c"><A>2</A></PropertyGroup>
<ItemGroup><PackageReference Include="P" Version="1" VersionOverride="2"/><PackageReference Include="Q"><PrivateAssets>all</PrivateAssets><Version>3</Version></PackageReference><PackageReference Include="R"/><ProjectReference Include="..\\..\\lib\\./L.csproj"/><ProjectReference/></ItemGroup>
<Target Name="t"><ItemGroup><PackageReference Include="T"/></ItemGroup></Target><Choose><Otherwise><PropertyGroup><B>b</B></PropertyGroup></Otherwise></Choose></Project>
"""


def test_project_files_go_on_past_malformed_ones(spark):
    bad = ["<Project><PropertyGroup></Project>", "", "plain", "<Project", "<Project/> more", "<Project><A>&lost;</A></Project>", None]
    files = spark.createDataFrame([("r", "a/b/Good.Api.csproj", GOOD, 1)] + [("r", f"bad{i}.csproj", t, 1) for i, t in enumerate(bad)] + [("r", "Empty.csproj", '<Project Sdk="S"/>', 1)], "repo string, path string, text string, name int")
    found = workspace.read_projects(files)
    rows = {r["path"]: r for r in found.collect()}
    good = rows["a/b/Good.Api.csproj"]
    assert (good["name"], good["sdk"], good["malformed"]) == ("Good.Api", "Own.Sdk", False) and good["references"] == ["lib/L.csproj"]
    assert [tuple(x) for x in good["properties"]] == [("A", "1"), ("A", "2"), ("B", "b")] and [tuple(x) for x in good["packages"]] == [("P", "2"), ("Q", "3"), ("R", None), ("T", None)]
    assert all(rows[f"bad{i}.csproj"]["malformed"] and rows[f"bad{i}.csproj"]["packages"] == [] for i in range(len(bad)))
    assert rows["Empty.csproj"]["sdk"] == "S" and not rows["Empty.csproj"]["malformed"]
    assert workspace.parse_errors(found).count() == len(bad) and workspace.read_projects(files.limit(0)).count() == 0


def test_listing_passes_over_folders_of_builds(spark, tmp_path):
    for path in ("a.cs", "src/B.CS", "src/b.cs", "src/obj/c.cs", "src/Bin/d.cs", "node_modules/x/e.cs", "lib/f.csproj", "lib/Directory.Build.props", "lib/g.txt", "binary/h.cs"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * len(path))
    got = {r["path"]: r["length"] for r in workspace.list_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.cs", "src/b.cs", "lib/f.csproj", "lib/Directory.Build.props", "binary/h.cs"} and got["a.cs"] == 4
    assert spark.range(1).select(workspace.resolve_path(F.lit("a/b"), F.lit("../../../c\\d"))).first()[0] == "c/d"
