"""Model expansion and lent fields on hand-made types."""

import random

from pyspark.sql import functions as F

from arcweave.operators import expansion

DECL = "decl_id string, name string, arity int, kind string, project_id string, repo string, path string, span_start int, type_params array<string>, bases array<string>, fields array<struct<name string, type_name string>>, properties array<struct<name string, type_name string>>"
USE = "endpoint_id string, kind string, detail string, project_id string, repo string, type_name string"


def decl(name, fields=(), project="p1", repo="r1", kind="class", bases=(), params=(), path="a", at=0, key=None):
    own = [(f, t) for f, t in fields]
    return (key or f"{project}.{name}", name, len(params), kind, project, repo, path, at, list(params), list(bases), own, own)


def run(spark, decls, uses, contracts=(), reach=(), **more):
    table = spark.createDataFrame(decls, DECL)
    used = spark.createDataFrame(uses, USE)
    out = expansion.expand_models(used, table, spark.createDataFrame([(c,) for c in contracts], "decl_id string"), spark.createDataFrame(list(reach), "project_id string, target_id string, rank int"), **more)
    edges = {(r["kind"], r["from_id"], r["to_id"], r["detail"], r["confidence"]) for r in out.edges.collect()}
    return edges, {r["id"]: (r["depth"], r["opaque"]) for r in out.models.collect()}, {(r["name"], r["project_id"]): r["node_ids"] for r in out.ambiguous.collect()}


def use(text, project="p1", repo="r1", kind="returns"):
    return ("ep", kind, "200", project, repo, text)


def test_depth_is_cut_at_the_least_depth_whatever_the_order_of_rows(spark):
    chain = [decl(f"T{i}", [("Next", f"T{i + 1}"), ("Deep", "T5" if i == 0 else "int")]) for i in range(12)]
    seen = []
    for seed in range(2):
        random.Random(seed).shuffle(chain)
        edges, models, _ = run(spark, chain, [use("Task<List<T0>>")])
        seen.append((edges, models))
        # T5 is two steps away, so its chain goes on to T9 at depth 6, which isn't expanded
        assert models["p1.T5"] == (2, False) and models["p1.T9"] == (6, False) and "p1.T10" not in models
        assert ("fieldOf", "p1.T8", "p1.T9", "Next", 2) in edges and not any(e[1] == "p1.T9" for e in edges)
    assert seen[0] == seen[1]


def test_cycles_parameters_and_opaque_names(spark):
    decls = [decl("A", [("B", "B"), ("Own", "T"), ("Lost", "Nowhere?")], params=["T"]), decl("B", [("A", "A<int>[]")])]
    edges, models, ambiguous = run(spark, decls, [use("A<B>")], contracts=["p1.B"])
    assert models == {"p1.A": (1, False), "p1.B": (1, False), "model:?:Nowhere": (2, True)} and not ambiguous
    assert ("fieldOf", "p1.A", "model:?:Nowhere", "Lost", 2) in edges and ("fieldOf", "p1.B", "p1.A", "A", 2) in edges
    assert not any(e[3] == "Own" for e in edges)


def test_several_declarations_are_all_kept_and_reported_once(spark):
    decls = [decl("S", project="p2", repo="r2", path="b", key="two"), decl("S", project="p3", repo="r3", path="a", key="three"), decl("S", params=["T"], project="p4", repo="r4", key="generic")]
    edges, models, ambiguous = run(spark, decls, [use("S"), use("S", kind="accepts"), use("S<int>")])
    assert {e[2:] for e in edges if e[0] == "accepts"} == {("two", "200", 0), ("three", "200", 0)}
    assert ambiguous == {("S", "p1"): ["three", "two"]} and models["generic"] == (1, False)
    # a reached project settles it
    edges, _, ambiguous = run(spark, decls, [use("S")], reach=[("p1", "p3", 2), ("p1", "p4", 1)])
    assert {e[2] for e in edges} == {"three"} and not ambiguous


def test_empty_tables_and_nulls(spark):
    assert run(spark, [], []) == (set(), {}, {})
    broken = ("x", "X", 0, "class", "p1", "r1", "a", 0, None, None, None, None)
    edges, models, _ = run(spark, [broken], [use("X"), use(None)])
    assert models == {"x": (1, False)} and len(edges) == 1
    assert run(spark, [broken], [], contracts=["x"])[1] == {"x": (1, False)}


def test_base_fields(spark):
    decls = [decl("Base", [("Id", "int"), ("Name", "string")], kind="record"), decl("IThing", [("No", "int")], kind="struct"), decl("Own", [("Name", "int"), ("Extra", "int")], bases=["IThing", "Acme.Lost", "Core.Base", "Other"]), decl("Other", [("Z", "int")]), decl("Plain", [("Q", "int"), ("Q", "string")])]
    out = expansion.with_base_fields(spark.createDataFrame(decls, DECL), spark.createDataFrame([], "project_id string, target_id string, rank int"))
    got = {r["decl_id"]: (r["base_id"], [(f["name"], f["type_name"]) for f in r["fields"]]) for r in out.collect()}
    assert got["p1.Own"] == ("p1.Base", [("Name", "int"), ("Extra", "int"), ("Id", "int")])
    assert got["p1.Plain"] == (None, [("Q", "int")]) and got["p1.Base"][1] == [("Id", "int"), ("Name", "string")]
    assert out.filter(F.col("decl_id") == "x").count() == 0
