"""Client methods against plain folds over hand-made and random source orders."""

import fnmatch
import random

from pyspark.sql import functions as F

from arcweave.operators import clients

METHOD = "method_id long, project_id string, project_name string, seq long, owner_id string, owner string, owner_kind string, base_types array<string>, method string, return_type string, n_params int, calls_own_name boolean"
CALL = "method_id long, seq int, kind string, receiver string, called string, verb string, args array<string>, receiver_types array<string>"
HIT = "method_id long, verb string, route string, strategy string, confidence int"
RULE = "rule_order int, type_glob string, methods array<struct<glob string, verb string>>, route_argument int"


def method(i, owner="Orders", kind="class", bases=(), name="GetIt", returns="Task<X>", n=0, own=False, project="p"):
    return (i, project, "Proj", i, f"{project}/{owner}", owner, kind, list(bases), name, returns, n, own)


def rows(df):
    return {r["method_id"]: tuple(r[1:]) for r in df.collect()}


def test_generic_calls(spark):
    methods = spark.createDataFrame([method(i) for i in range(9)], METHOD)
    calls = [
        (0, 2, "invocation", "_http", "GetAsync", None, ["api/b"], None), (0, 1, "invocation", "_http", "PostAsync", None, [None, "text/json", "api/a"], None),
        (1, 1, "invocation", "System.IO.Path", "GetFull", None, ["a/b"], None), (1, 2, "invocation", "x", "GetSection", None, ["a/b"], None),
        (2, 1, "invocation", None, "GetIt", None, ["a/b"], None), (2, 2, "request", None, None, "PUT", ["x", "api/{id}"], None),
        (3, 1, "request", None, None, None, ["x", "a/b"], None), (4, 1, "invocation", "x", "Getter", None, ["a/b"], None), (5, 1, "invocation", "x", "Delete", None, None, None),
        (6, 1, "request", None, None, "PUT", ["only"], None), (7, 1, "invocation", None, None, None, ["a/b"], None),
    ]
    got = rows(clients.generic_hits(spark.createDataFrame(calls, CALL), methods))
    assert got == {0: ("POST", "api/a", "generic-http", 1), 2: ("PUT", "api/{id}", "generic-http", 1)}
    assert clients.generic_hits(spark.createDataFrame([], CALL), methods).count() == 0


def plain_wrapper(calls, rules):
    out = {}
    fits = lambda glob, text: text is not None and fnmatch.fnmatchcase(text.lower(), glob.lower().replace("[", "[[]"))
    for m, _, kind, _, called, _, args, types in sorted(calls, key=lambda c: (c[0], c[1])):
        if m in out or kind != "invocation":
            continue
        for _, glob, methods, at in sorted(rules, key=lambda r: r[0]):
            verb = next((v for g, v in methods if fits(g, called)), None)
            if any(fits(glob, t.split("<")[0]) for t in types or []) and verb and at < len(args or []) and args[at] is not None:
                out[m] = (verb.upper(), args[at], "configured-wrapper", 2)
                break
    return out


def test_wrapper_rules_by_globs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abAB.$") for _ in range(r.randint(1, 7)))
    glob = lambda: "".join(r.choice(["a", "b", "A", ".", "$", "*", "*", "?"]) for _ in range(r.randint(1, 6)))
    rules = [(i, glob(), [(glob(), "get"), (r.choice(["*", "b*"]), "post")], r.randint(0, 2)) for i in range(60)] + [(60, "*", [("*", "put")], 0)]
    calls = [(i // 2, i, r.choice(["invocation"] * 4 + ["request"]), None, word(), None, [r.choice([None, "x/y", f"r{i}"]) for _ in range(r.randint(0, 3))], [word() + r.choice(["", "<T>"]) for _ in range(r.randint(0, 2))]) for i in range(300)]
    calls += [(900, 1, "invocation", None, None, None, None, None)]
    table = spark.createDataFrame(calls, CALL)
    assert rows(clients.wrapper_hits(table, spark.createDataFrame(rules, RULE))) == plain_wrapper(calls, rules)
    assert clients.wrapper_hits(table, spark.createDataFrame([], RULE)).count() == 0


def test_generated_routes(spark):
    body = "method_id long, method string, verb string, path_comment string, appends array<struct<value string, is_base boolean>>, template string"
    parts = [("api", None), (None, False), ("skipped", True), ("/x", False)]
    bodies = [(1, "GetA", "Get", None, parts, None), (2, "GetA", "GET", "said/it", parts, None), (3, "PatchX", None, None, parts, "{+baseurl}/t/{id}{?a,b}"), (4, "Find", None, None, None, "{+baseurl}/t"), (5, "GetA", "GET", None, [("b", True)], "{+baseurl}/t"), (6, "GetA", "PUT", None, None, "no base")]
    got = rows(clients.generated_hits(spark.createDataFrame(bodies, body)))
    assert got == {1: ("GET", "api{}/x", "generated", 2), 2: ("GET", "said/it", "generated", 2), 3: ("PATCH", "/t/{id}", "generated", 2), 5: ("GET", "/t", "generated", 2)}


def test_first_strategy_and_lent_hits(spark):
    hit = lambda *x: spark.createDataFrame(list(x), HIT)
    first = clients.first_strategy(hit((1, "GET", "g", "generic-http", 1)), hit((1, "GET", "c", "configured-wrapper", 2), (2, "PUT", "c", "configured-wrapper", 2)), hit((1, "GET", "r", "refit", 2)))
    assert rows(first) == {1: ("GET", "r", "refit", 2), 2: ("PUT", "c", "configured-wrapper", 2)}
    methods = [method(1, n=1), method(2, own=True), method(3, own=True, name="Other"), method(10, "IOrders", "interface", n=1), method(11, "IOrders", "interface", n=7), method(12, "ILost", "interface"), method(13, "Later", bases=["IOrders<T>", "Base"], n=1), method(14, "First", bases=["IOrders"], n=3), method(15, "IOrders", "interface", project="q")]
    hits = hit((1, "GET", "one", "refit", 2), (13, "GET", "later", "refit", 2), (14, "GET", "first", "refit", 2))
    got = {k: v[1] for k, v in rows(clients.lend_hits(spark.createDataFrame(methods, METHOD), hits)).items()}
    assert got == {1: "one", 2: "one", 13: "later", 14: "first", 10: "later", 11: "later"}


def plain_collapse(methods, hits):
    """One method after the other, in the order of the source."""
    nodes, owners = {}, {m[4] for m in methods if m[0] in hits}
    for m in sorted(methods, key=lambda m: m[3]):
        group = nodes.setdefault((m[1], m[5], m[8]), [])
        hit = hits.get(m[0])
        if hit is None:
            if m[4] in owners and m[9].startswith("Task") and not group:
                group.append([m[0], None, m[3]])
        elif not any(x[1] == hit for x in group):
            if group and group[0][1] is None:
                group[0][:2] = m[0], hit
            else:
                group.append([m[0], hit, m[3]])
    return {(f"cm:Proj:{owner}.{name}" + (f"#{i + 1}" if i else ""), x[0], x[2]) for (_, owner, name), group in nodes.items() for i, x in enumerate(group)}


def test_overloads_collapse_as_one_by_one(spark):
    none = spark.createDataFrame([], "project_name string, prefix string")
    for seed in range(3):
        r = random.Random(seed)
        methods = [method(i, r.choice(["A", "B"]), name=r.choice(["GetX", "GetY"]), returns=r.choice(["Task", "Task<int>", "int"])) for i in range(30)]
        hits = {m[0]: (r.choice(["GET", "PUT"]), f"r{r.randint(0, 2)}") for m in methods if r.random() < (0.1, 0.4, 0.8)[seed]}
        r.shuffle(methods)
        held = spark.createDataFrame([(i, v if i % 2 else v.lower(), f"/{route}/", "refit", 2) for i, (v, route) in hits.items()], HIT)
        out = clients.collapse_overloads(spark.createDataFrame(methods, METHOD), held, none)
        assert {(x["id"], x["method_id"], x["seq"]) for x in out.collect()} == plain_collapse(methods, hits)


def test_prefixes_lead_routes(spark):
    hits = spark.createDataFrame([(1, "GET", "/x/{Id}", "refit", 2)], HIT)
    out = clients.collapse_overloads(spark.createDataFrame([method(1)], METHOD), hits, spark.createDataFrame([("Proj", "gate/")], "project_name string, prefix string")).first()
    assert (out["route"], out["norm"]) == ("/gate/x/{Id}", "gate/x/{}")
    empty = spark.createDataFrame([], METHOD)
    assert clients.collapse_overloads(empty, hits.limit(0), spark.createDataFrame([], "project_name string, prefix string")).count() == 0 and clients.lend_hits(empty, hits.limit(0)).count() == 0
    assert clients.match_globs(spark.createDataFrame([("ab",), (None,)], "text string"), spark.createDataFrame([("?B",), ("*",), ("a",)], "pattern string")).filter(F.col("pattern") != "a").count() == 2
