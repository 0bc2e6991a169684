"""Ids, signatures, discovered repositories and names of nodes that nothing has, on hand-made rows."""

from pyspark.sql import functions as F

from arcweave.functions import facts, ids
from arcweave.operators import findings, projects

LIMITS = {
    "Task Get()": (0, 0), "Task Get(int a)": (1, 1), "Task Get(int a, int b = 3)": (1, 2), "Task Get(Map<int, string> m, (int, int) p)": (2, 2), 'Task Get(string s = "a, b)", char c = \'"\')': (0, 2), "Task Get(params int[] rest)": (0, None),
    'Task Get([A("=,")] int a, [In] params int[] rest)': (1, None), "Task Get(int a": (0, None), "Task Other(int a)": (0, None), "Get(int a)": (0, None), None: (0, None), "Task Get(Func<int, int> f = null, CancellationToken c = default)": (0, 2),
}


def test_argument_limits(spark):
    rows = spark.createDataFrame([(s, "Get") for s in LIMITS], "s string, m string").select("s", facts.argument_limits("s", "m").alias("x")).collect()
    assert {r["s"]: tuple(r["x"]) for r in rows} == LIMITS


def test_discovered_repositories(spark):
    repos = spark.createDataFrame([("orders", "a/x"), ("Orders", "b"), ("orders", "a"), ("orders#2", "c"), ("old", "d"), ("Tools", "e")], "name string, path string")
    got = {(r["path"], r["name"]) for r in projects.discover(repos, ["o*", "TOOLS"], ["OL?"]).collect()}
    assert len({n.lower() for _, n in got}) == 5 and ("b", "Orders") in got and ("c", "orders#2") in got and ("e", "Tools") in got and not any(p == "d" for p, _ in got)
    assert projects.discover(repos, [], []).count() == 0 and projects.without_ignored(repos, ["*ders"]).count() == 3 and projects.discover(repos.limit(0), ["*"], []).count() == 0


def test_ids(spark):
    texts = F.lit(None).cast("array<string>")
    made = [
        (ids.endpoint_id(F.lit("r"), F.lit("get"), F.lit("/a")), "ep:r:GET:/a"),
        (ids.project_name(F.lit("proj:r/Api#2")), "Api"),
        (ids.project_name(F.lit("proj:r/A#b")), "A#b"),
        (ids.full_type_name(F.array(F.lit("N")), texts, F.lit("T`1")), "N.T`1"),
        (ids.site_id(F.lit("r"), F.lit("p"), F.lit("T"), F.lit("M"), F.lit(7)), "cs:r/p:T.M:7"),
    ]
    assert list(spark.range(1).select(*(c.alias(str(i)) for i, (c, _) in enumerate(made))).first()) == [text for _, text in made]


def test_dangling_findings(spark):
    nodes = spark.createDataFrame([("a",), ("a",)], "id string")
    found = spark.createDataFrame([("cycle", ["a", "b"]), ("cycle", ["b"]), ("x", ["b", "c"]), ("y", []), ("z", None)], "kind string, node_ids array<string>")
    assert {tuple(r) for r in findings.dangling_findings(nodes, found).collect()} == {("cycle", "b"), ("x", "b"), ("x", "c")}
