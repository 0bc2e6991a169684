"""Operators on facts against DuckDB on the given tables and against small cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from arcweave.functions import facts as rules
from arcweave.operators import declarations, projects
from arcweave.plans import facts

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(facts.QUERIES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    got, want = facts.QUERIES[name](spark, FOLDER), con.sql(facts.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
    assert found and found == sorted(want.fetchall(), key=repr)


# Published cases of type texts, and some of our own behind them.
@pytest.mark.parametrize(
    ("text", "names"),
    [("Task<ActionResult<List<OrderDto>>>", "OrderDto*"), ("OrderDto?", "OrderDto"), ("Acme.Orders.OrderDto[]", "OrderDto*"), ("Results<Ok<OrderDto>, NotFound>", "OrderDto"), ("PagedResult<OrderDto>", "PagedResult OrderDto"), ("Dictionary<string, OrderLineDto>", "OrderLineDto*"), ("Task<IActionResult>", ""), ("Guid", ""), ("int?", ""), ("IAsyncEnumerable<OrderDto>", "OrderDto"), ("global::A.B<C.D, E[]?>", "B D E*"), (None, ""), ("", ""), ("(a, b)", "")],
)
def test_unwrap_types(spark, text, names):
    found = spark.createDataFrame([(text,)], "t string").select(rules.unwrap_types("t").alias("x")).first()["x"]
    assert " ".join(r["name"] + "*" * r["collection"] for r in found) == names


def test_expand_properties(spark):
    rows = [("$(A)/$(B)",), ("$(Nope)-$(A)",), ("$(Loop)",), ("plain",), (None,), ("",)]
    own = F.create_map(*(F.lit(x) for x in ("a", "1$(b)", "b", "2", "loop", "$(Loop)")))
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(projects.expand_properties(F.col("v"), own)).collect()]
    assert got == ["12/2", "unresolved($(Nope))", "unresolved($(Loop))", "plain", None, ""]


def test_describe_projects(spark):
    schema = "name string, sdk string, properties map<string,string>, packages array<string>, has_endpoints boolean, has_http boolean"
    rows = [("A.Tests", None, {}, [], None, None), ("B.Tests", None, {"istestproject": "False", "packageid": "B"}, None, False, True), ("C", "Microsoft.NET.Sdk.WEB", {}, [], False, False), ("D.Client", None, {"version": "1"}, [], False, True), ("E", None, {"ispackable": "true"}, [], False, False), ("F", None, None, ["microsoft.net.test.SDK"], True, False), ("G", None, {}, [], True, True)]
    forced = spark.createDataFrame([("G", "library"), ("C", "nothing")], "name string, kind string")
    got = projects.describe_projects(spark.createDataFrame(rows, schema), forced)
    assert {r["name"]: r["kind"] for r in got.collect()} == {"A.Tests": "Test", "B.Tests": "Client", "C": "Api", "D.Client": "Client", "E": "Library", "F": "Test", "G": "Library"}
    assert projects.describe_projects(spark.createDataFrame([], schema)).count() == 0


def test_merge_parts_and_sites(spark):
    parts = spark.createDataFrame([("p", "T", "b.cs", 0, [("x", "int"), ("y", "int")]), ("p", "T", "a.cs", 9, [("y", "long")]), ("p", "T", "a.cs", 2, [("z", "int")])], "project_id string, full_name string, path string, span_start int, fields array<struct<name string, type string>>")
    assert [(f["name"], f["type"]) for f in declarations.merge_parts(parts).first()["fields"]] == [("z", "int"), ("y", "long"), ("x", "int")]
    links = spark.createDataFrame([("s", "m", 2), ("s", "n", 0)], "site_id string, method_id string, confidence int")
    assert tuple(declarations.call_sites(links).first()) == ("s", 0, 2)


def test_facts_of_nothing(spark):
    kinds = "array<struct<name string, type_name string, attrs array<string>, default string>>"
    df = spark.createDataFrame([(None, None, None), ([("id", "Dto", None, None), ("x", None, None, None)], "POST", "a/{ID:int}")], f"p {kinds}, v string, r string")
    got = [r[0] for r in df.select(rules.bind_parameters(F.col("p"), F.col("v"), F.col("r"))).collect()]
    assert got[0] == [] and [(r["name"], r["source"], r["required"]) for r in got[1]] == [("id", "route", True)]
    answers = spark.createDataFrame([(None, None), ([], "void"), ([(None, None)], "Dto"), (None, "Dto")], "d array<struct<status_code int, type_name string>>, t string")
    assert [[tuple(x) for x in r[0]] for r in answers.select(rules.responses_of(F.col("d"), F.col("t"))).collect()] == [[], [], [(200, "")], [(200, "Dto")]]


def test_links_with_nulls_and_empty_tables(spark):
    refs = spark.createDataFrame([("r1", "T", None, "p", "a"), ("r2", None, 0, "p", "a"), ("r3", "T", 1, "q", "b")], "ref_id string, name string, arity int, project_id string, repo string")
    decls = spark.createDataFrame([("d1", "T", 0, "x", "a"), ("d2", "T", 0, "y", "c"), ("d3", None, 0, "p", "a")], "decl_id string, name string, arity int, project_id string, repo string")
    reach = spark.createDataFrame([], "project_id string, target_id string, rank int")
    got = {(r["ref_id"], r["decl_id"], r["level"], r["candidates"]) for r in declarations.resolve_types(refs, decls, reach).collect()}
    assert got == {("r1", "d1", 2, 1), ("r3", "d1", 3, 2), ("r3", "d2", 3, 2)}
    assert declarations.resolve_types(refs.limit(0), decls, reach).count() == 0
    calls = spark.createDataFrame([("c", "s", "p", "C?", "Get", None, None), ("d", "s", "p", None, "Get", 1, None)], "call_id string, site_id string, project_id string, declared_type string, member string, n_args int, usings array<string>")
    methods = spark.createDataFrame([("m", "t", None, "C", "Get", 1, None)], "id string, project_id string, project_name string, type_name string, method_name string, min_args int, max_args int")
    to = spark.createDataFrame([("p", "t"), ("p", "t")], "project_id string, target_id string")
    assert [tuple(r) for r in declarations.link_calls(calls, methods, to).collect()] == [("s", "m", 2)]
    assert declarations.link_calls(calls.limit(0), methods, to).count() == 0


def test_innermost_owners(spark):
    files = spark.createDataFrame([(1, "a/b/c"), (2, "a/x"), (3, "ab"), (4, "a/b"), (5, "")], "file_id int, folder string")
    repos = spark.createDataFrame([("r", "a"), ("inner", "a/b/c")], "repo string, folder string")
    own = spark.createDataFrame([("q", "a/b"), ("p", "a/b"), ("top", "a")], "project_id string, folder string")
    got = {r["file_id"]: (r["repo"], r["project_id"]) for r in projects.owners(files, repos, own).collect()}
    assert got == {1: ("inner", None), 2: ("r", "top"), 3: (None, None), 4: ("r", "p"), 5: (None, None)}
    assert projects.owners(files.limit(0), repos, own).count() == 0


def test_merge_parts_at_one_place(spark):
    """As the SQL: by the place of the field, not by part."""
    one = lambda *names: [(n,) for n in names]
    rows = [(1, "T", "f", 5, one("F2", "G")), (1, "T", "f", 5, one("F1", "G")), (1, "T", "e", 9, one("F3", None)), (1, "U", "f", 1, []), (1, "V", "f", 1, None)]
    got = declarations.merge_parts(spark.createDataFrame(rows, "project_id int, full_name string, path string, span_start int, fields array<struct<name string>>"))
    assert {r["full_name"]: [f["name"] for f in r["fields"]] for r in got.collect()} == {"T": ["F3", "F1", "F2", "G"], "U": [], "V": []}
