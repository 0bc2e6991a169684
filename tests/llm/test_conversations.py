"""Tries and repairs of conversations against brute force."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from arcweave.llm import prefix_trie, repair

SCHEMA = "conv_id long, turn long, role string, text string, n string, depth string, at string, seq string"
ROLES = ["user", "assistant", "system", "tool", "", None]
TEXTS = ["Hello there.", "What?", "no end", "", " \t\n", None, "Yes!", "wörld ends. ", "x. ", "a.b"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def made_up(seed: int, n: int, hot: int = 0) -> list[tuple]:
    """Conversations with shared beginnings, ties, repeated rows, nulls and negative ids; `hot` ones begin alike."""
    r, rows = random.Random(seed), []
    for c in [*range(n), *(r.choice([-7, -150, 100, 101, 199, 250, 1000]) for _ in range(3)), *range(300, 300 + hot)]:
        for t in range(r.randint(1, 9) if c % 11 else 1):
            start = c >= 300 and t < 3
            rows.append((c, t, "user" if start or t % 2 == 0 else r.choice(ROLES), f"start {t}." if start else r.choice(TEXTS)))
    rows += [(3, None, "user", "first"), (3, 1, "a", "tie"), (3, 1, "b", "tie"), rows[4], rows[4], (None, 1, "user", "Lost."), (None, 2, "assistant", "Lost")]
    r.shuffle(rows)
    return rows


def in_turns(rows):
    found = {}
    for c, t, role, text in rows:
        found.setdefault(c, []).append((t is not None, t or 0, role, text))
    return found


def plain_trie(rows) -> set[tuple]:
    own = {}
    for c, turns in in_turns((c, t, role or "", text or "") for c, t, role, text in rows if c is not None).items():
        own[c] = [x[2:] for x in sorted(turns, key=lambda x: (*x[:3], hashlib.md5(x[2].encode() + b"\xff" + x[3].encode()).digest()))]
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append((c, d == len(turns)))
    out = set()
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        children = {n[: len(node) + 1] for n in under if len(n) > len(node)}
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in under) for n in under)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        parent = min(c for c, _ in nodes[node[:-1]]) if node else None
        out.add((min(c for c, _ in members), len(node), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "n", "hot", "most_nodes"), [(1, 40, 0, 20_000), (2, 40, 40, 25)])
def test_trie_is_that_of_brute_force(spark, seed, n, hot, most_nodes):
    rows = made_up(seed, n, hot)
    got = prefix_trie.prefix_trie(table(spark, rows), most_nodes).collect()
    want = plain_trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_conversation_spreads_over_parts(spark, small_parts):
    rows = [(7, t, "user", f"turn {t}") for t in range(900)] + [(8, t, "user", f"turn {t}") for t in range(700)] + [(9, 0, "user", "x")]
    turns = prefix_trie.ordered_turns(table(spark, rows)).filter("conv_id = 7")
    assert turns.select(prefix_trie.part_of()).distinct().count() > 1 and sorted(r[0] for r in turns.select("pos").collect()) == list(range(900))
    assert {tuple(r) for r in prefix_trie.prefix_trie(table(spark, rows), 200).collect()} == plain_trie_of_chains(rows)
    digests = {r["conv_id"]: r for r in repair.repair_conversations(table(spark, rows)).collect()}
    for c in (7, 8, 9):
        assert tuple(digests[c]) == plain_repair(c, rows)


def plain_trie_of_chains(rows):
    """plain_trie looks at all pairs of nodes; chains are done by their order."""
    own = {c: [f"{x[2]}\0{x[3]}" for x in sorted(turns)] for c, turns in in_turns(rows).items()}
    texts = {c: [x[3] for x in sorted(turns)] for c, turns in in_turns(rows).items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        mark = hashlib.sha256()
        keys = [mark.hexdigest()]
        for x in own[c][h:]:
            mark.update(x.encode())
            keys.append(mark.hexdigest())
        for d, k in enumerate(keys):
            node = nodes.setdefault(k, {"depth": d, "members": [], "ends": [], "parent": keys[d - 1] if d else None, "chars": len(texts[c][h + d - 1]) if d else 0})
            node["members"].append(c)
            if d == len(keys) - 1:
                node["ends"].append(c)
    for x in nodes.values():
        x["children"], x["leaves"], x["saved"] = 0, 0, (len(x["members"]) - 1) * x["chars"]
    for x in nodes.values():
        if x["parent"]:
            nodes[x["parent"]]["children"] += 1
    for x in sorted(nodes.values(), key=lambda x: -x["depth"]):
        x["leaves"] += x["children"] == 0
        if x["parent"]:
            nodes[x["parent"]]["leaves"] += x["leaves"]
            nodes[x["parent"]]["saved"] += x["saved"]
    sha = lambda ends: hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
    return {(min(x["members"]), x["depth"], min(nodes[x["parent"]]["members"]) if x["parent"] else None, len(x["members"]), x["children"], x["leaves"], x["saved"], sha(x["ends"])) for x in nodes.values()}


def test_centroid_sums_are_sums_over_subtrees():
    r = random.Random(5)
    for n, deep in ((1, 1), (200, 1), (200, 200), (300, 4), (0, 1)):
        parent = [-1 if i == 0 or r.random() < 0.01 else r.randrange(max(0, i - deep), i) for i in range(n)]
        values = [(1, r.randint(-5, 9)) for _ in range(n)]
        want = [list(v) for v in values]
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] = [a + b for a, b in zip(want[parent[i]], want[i], strict=True)]
        assert prefix_trie.centroid_sums(parent, values) == want


def test_trie_sql_and_query_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view conversations as select * from '{folder}/conversations.parquet'")
    want = duckdb.sql(prefix_trie.OP11_SQL).fetchall()
    got = prefix_trie.op11_prefix_trie(spark, folder).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def damaged(c, rows):
    out = []
    for conv, t, role, text in rows:
        if conv != c:
            continue
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else "".join(x for x in text if x not in ".!?") if what == 2 else text
        out += [(t is not None, t or 0, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return sorted(out)


def plain_repair(c, rows) -> tuple:
    """The cheapest edits row by row, with whole strings."""
    turns, seen, faults = damaged(c, rows), set(), []
    for _, _, role, text in turns:
        stripped = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "none")
        seen.add((role, text))
    initials = [(x[2][:1] if x[2][:1] in ("s", "u", "a") else "?") for x in turns]
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(now):
        for _ in range(3):
            for (state, made), (cost, audit) in list(now.items()):
                for new in "ua":
                    if (state, new) in moves:
                        at, option = (new, (*made, f"{names[new]}:")), (cost + 5, audit + "I")
                        if at not in now or option < now[at]:
                            now[at] = option
        best = {}
        for (state, made), option in now.items():
            if state not in best or option < best[state][0]:
                best[state] = (option, made)
        return {(state, made): option for state, (option, made) in best.items()}

    now = with_inserts({("", ()): (0, "")})
    for (_, _, role, text), first, fault in zip(turns, initials, faults, strict=True):
        new = {}
        for (state, made), (cost, audit) in now.items():
            options = [((state, made), (cost + 2, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, first) in moves:
                    options.append(((first, (*made, f"{role}:{text}")), (cost + more, audit + "K")))
                options += [((x, (*made, f"{names[x]}:{text}")), (cost + 1 + more, audit + "R")) for x in "ua" if (state, x) in moves]
            for at, option in options:
                if at not in new or option < new[at]:
                    new[at] = option
        now = with_inserts(new)
    (cost, audit), made = min((option, made) for (state, made), option in now.items() if state in ("", "a"))
    numbers = {x[1] for x in turns if x[0]}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    return (c, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


@pytest.mark.parametrize("most_rules", [0, 3, 4096])
def test_repair_is_that_of_brute_force(spark, most_rules):
    rows = made_up(7, 90, 30)
    got = repair.repair_conversations(table(spark, rows), most_rules).collect()
    want = {plain_repair(c, rows) for c in {r[0] for r in rows}}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_repair_of_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {plain_repair(c, rows) for c in {r[0] for r in rows}}
    assert {tuple(r) for r in repair.op12_conversation_repair(spark, folder).collect()} == want


def test_ropes_compare_as_strings():
    r = random.Random(3)
    for _ in range(300):
        parts = [["".join(r.choice("DIK") for _ in range(r.choice([0, 1, 3, 90, 140]))) for _ in range(r.randint(1, 6))] for _ in range(2)]
        if r.random() < 0.7:
            parts[1] = [*parts[0][:-1], *parts[1][-1:]]
        ropes = []
        for p in parts:
            rope = ""
            for x in p:
                rope = repair.joined(rope, x) if r.random() < 0.5 else repair.Rope(rope, x)
            ropes.append(rope)
        a, b = map("".join, parts)
        assert (repair.flat(ropes[0]), repair.flat(ropes[1])) == (a, b) and repair.less(*ropes) == (a < b)


def test_grammar_repairs_long_strings_as_row_by_row():
    r = random.Random(9)
    text = "".join(r.choice("EEIIADKHF") for _ in range(5000)) + "EI" * 3000
    grammar = repair.Grammar.empty()
    plain = grammar.repair(text)
    for _ in range(12):
        now = repair.compress(text, grammar.rounds)
        counts = sorted(((a, b, sum(x == (a, b) for x in zip(now[:-1], now[1:], strict=True))) for a, b in set(zip(now[:-1], now[1:], strict=True))), key=lambda x: -x[2])[:20]
        grammar.add(counts, 50)
    assert len(repair.compress(text, grammar.rounds)) < 2500 and grammar.repair(text) == plain


def test_empty_tables(spark):
    none = table(spark, []).select(*(F.col(c) for c in SCHEMA.split(", ") for c in [c.split()[0]]))
    assert prefix_trie.prefix_trie(none).count() == 0 and repair.repair_conversations(none).count() == 0
    lost = table(spark, [(None, None, None, None)])
    assert prefix_trie.prefix_trie(lost).count() == 0 and [tuple(r) for r in repair.repair_conversations(lost).collect()] == [plain_repair(None, [(None, None, None, None)])]
