"""The trie of conversation prefixes and its rollup by centroid decomposition (operator 11).

Conversations are ordered by turn (null first; rows of one turn by role, then by a digest of their text). Each conv_id c is rebuilt: the first h turns of conversation
c - c % 100 (the remainder has c's sign), then its own turns after its first h, h = crc32(c) % 6. A prefix is named by a polynomial hash modulo the prime 2^127 - 1 over its
turns' digests. The hash of joined prefixes follows from theirs, so turns are hashed where they lie in the order of all turns: a conversation of any length
spreads over many tasks, and what a task must know of those before it is one entry a task.

Nodes are the groups of equal prefixes, counted with map-side combining. `centroid_rollup` sums values over subtrees of the parent-edge forest. A component of
more than `most_nodes` nodes is split in rounds of Spark jobs: its centroid is the deepest node that has half of the component's rebuilt turns below it, of
which each node knows its own number from the grouping; the subtrees of the centroid's children and what remains above become components, the total of the centroid's side is
added along the path from the centroid to the component's top, found in the rebuilt turns of the centroid's least member. At most half of a component's turns
go on together, so there are few rounds. Components within the bound are dealt to tasks, where the same recursion goes on by numbers of nodes.

Null role or text is empty. Rows without a conv_id belong to no conversation and are left out. A conversation whose rebuilt turns are none is a member of the root alone.
Repeated rows are turns of their own. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, read_table
from .sequences import PIECE_BYTES, in_order, joined_sha256, part_of

FAMILY, MOST_SHARED = 100, 5
PRIME = 2**127 - 1
BASE = 0x5DEECE66D1CE4E5B9 * 0x9E3779B97F4A7C15 % PRIME
UNBASE = pow(BASE, -1, PRIME)
LOW = (1 << 64) - 1
#: Rows of components' centroids that are broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 200_000
NODE, PARENT, TOP = ["n1", "n2"], ["p1", "p2"], ["t1", "t2"]
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def halves(value: int) -> tuple[int, int]:
    """A hash as two signed 64-bit columns."""
    return value >> 64, (value & LOW) - (1 << 63)


def whole(high: int, low: int) -> int:
    return (high << 64) | (low + (1 << 63))


ROOT = halves(0)
TURNS = "conv_id long, n_chars long, at long, pos long, first boolean, x1 long, x2 long, n1 long, n2 long"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def ordered_turns(convs: DataFrame) -> DataFrame:
    """TURNS of all rows with a conv_id: pos, counted from 0, and the hash of the prefix that ends there."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.encode(role, "UTF-8"), F.unhex(F.lit("FF")), F.encode(text, "UTF-8"))))  # no UTF-8 has the byte FF
    rows = convs.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos, value, first, begun = None, 0, 0, True, False
        for batch in batches:
            out = []
            for conv, digest, n_chars, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "n_chars", "at")), strict=True):
                if not begun or conv != now:
                    first, begun, now, pos, value = not begun, True, conv, 0, 0
                x = int.from_bytes(digest, "big") % PRIME
                value = (value * BASE + x) % PRIME
                out.append((conv, n_chars, at, pos, first, *halves(x), *halves(value)))
                pos += 1
            yield batch_of(out, TURNS)

    local = materialize(in_order(rows, ["conv_id", "turn", "role", "digest"]).mapInArrow(scan, TURNS), "turns")
    ends = local.groupBy(part_of().alias("part")).agg(F.min_by("conv_id", "at").alias("head"), F.max_by(F.struct("conv_id", "first", "pos", *NODE), "at").alias("end"))
    carried, last = [], None  # what goes on from the part before: one entry a part
    for part, head, end in sorted(ends.collect()):
        conv, first, pos, high, low = end
        count, value = pos + 1, whole(high, low)
        if last is not None and last[0] == head:
            carried.append((part, head, last[1], *halves(last[2])))
            if first:
                count, value = count + last[1], (last[2] * pow(BASE, count, PRIME) + value) % PRIME
        last = (conv, count, value)
    if not carried:
        return local
    before = F.broadcast(local.sparkSession.createDataFrame(carried, "part int, conv_id long, c0 long, h1 long, h2 long"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *row, pos, first, x1, x2, high, low, count, h1, h2 in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if count is not None:
                    high, low = halves((whole(h1, h2) * pow(BASE, pos + 1, PRIME) + whole(high, low)) % PRIME)
                    pos += count
                out.append((*row, pos, first, x1, x2, high, low))
            yield batch_of(out, TURNS)

    names = [f.split()[0] for f in TURNS.split(", ")]
    joined = local.withColumn("part", part_of()).join(before, ["part", "conv_id"], "left").select(*names, "c0", "h1", "h2")
    return materialize(joined.mapInArrow(carry, TURNS), "turns-whole")


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


PATHS = "conv_id long, depth long, n1 long, n2 long, p1 long, p2 long, n_chars long, below long"


def rebuilt_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads (conv_id, length of the rebuilt turns) and PATHS: a row for each rebuilt turn; below counts the turns from it on."""
    at = [F.col("pos") == i for i in range(MOST_SHARED)]
    firsts = [F.max(F.when(here, F.col(c))).alias(f"{c}_{i}") for i, here in enumerate(at) for c in ("n1", "n2", "n_chars")]
    own = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *firsts), "conversations")
    nth = lambda prefix, k, c: F.when(k > 0, F.get(F.array(*(F.col(f"{prefix}{c}_{i}") for i in range(MOST_SHARED))), k - 1)).otherwise(F.lit(dict(zip(NODE, ROOT, strict=True))[c]))
    base = own.select(F.col("conv_id").alias("base"), *(F.col(c).alias(f"base_{c}") for c in own.columns if c != "conv_id"))
    h = shared_turns(F.col("conv_id"))
    families = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")  # a base has 199 conversations at most
    families = families.withColumn("h", h).withColumn("take", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("rest", F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    joint = [nth("base_", F.col("take"), c).alias(f"b_{c}") for c in NODE] + [nth("", F.least("h", "n").cast("int"), c).alias(f"o_{c}") for c in NODE]
    heads = materialize(families.select("conv_id", "n", "h", "take", (F.col("take") + F.col("rest")).alias("length"), *joint, *(c for c in base.columns if c[-1].isdigit())), "heads")
    step = lambda i: F.struct(*(F.col(f"base_{c}_{i}").alias(c) for c in NODE), *((F.col(f"base_{c}_{i - 1}") if i else F.lit(r)).alias(p) for c, p, r in zip(NODE, PARENT, ROOT, strict=True)), F.col(f"base_n_chars_{i}").alias("n_chars"))
    taken = heads.filter("take > 0").select("conv_id", "length", F.posexplode(F.slice(F.array(*map(step, range(MOST_SHARED))), F.lit(1), F.col("take").cast("int"))).alias("i", "step"))
    taken = taken.select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "step.*", (F.col("length") - F.col("i")).alias("below"))
    later = turns.filter(F.col("pos") >= h).select("conv_id", "pos", "n_chars", "x1", "x2", *NODE)
    later = join_counted(later, heads.select("conv_id", "n", "h", "take", "length", "b_n1", "b_n2", "o_n1", "o_n2"), "conv_id")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "pos", "n_chars", "x1", "x2", "n1", "n2", "h", "take", "length", "b_n1", "b_n2", "o_n1", "o_n2")
        for batch in batches:
            out = []
            for conv, pos, n_chars, x1, x2, n1, n2, h, take, length, b1, b2, o1, o2 in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                new = pos - h + 1  # own turns up to here
                value = (whole(n1, n2) + (whole(b1, b2) - whole(o1, o2)) * pow(BASE, new, PRIME)) % PRIME
                parent = (value - whole(x1, x2)) * UNBASE % PRIME
                out.append((conv, take + new, *halves(value), *halves(parent), n_chars, length - take - new + 1))
            yield batch_of(out, PATHS)

    return heads.select("conv_id", "length"), materialize(taken.unionByName(later.mapInArrow(rename, PATHS)), "paths")


def centroid_sums(parent: list[int], values: list[tuple]) -> list[list]:
    """Sums over subtrees of a forest whose parents (-1: none) come before their children, by centroid decomposition."""
    n, width = len(parent), len(values[0]) if values else 0
    sums, size, side = [[0] * width for _ in range(n)], [0] * n, [0] * n
    trees: dict[int, list[int]] = {}
    for v in range(n):
        side[v] = v if parent[v] < 0 else side[parent[v]]
        trees.setdefault(side[v], []).append(v)
    stack = list(trees.values())
    while stack:
        part = stack.pop()
        top = part[0]
        for v in part:
            size[v] = 1
        for v in reversed(part):
            if v != top:
                size[parent[v]] += size[v]
        centroid = next(v for v in reversed(part) if 2 * size[v] >= len(part))  # the deepest, as such nodes form a path
        total, pieces = [0] * width, {}
        for v in part:  # -1: above the centroid, else the child of the centroid whose subtree it is
            side[v] = centroid if v == centroid else -1 if v == top else v if parent[v] == centroid else side[parent[v]]
            if side[v] >= 0:
                total = [a + b for a, b in zip(total, values[v], strict=True)]
            if v != centroid:
                pieces.setdefault(side[v], []).append(v)
        u = centroid
        while True:  # from the centroid to the top
            sums[u] = [a + b for a, b in zip(sums[u], total, strict=True)]
            if u == top:
                break
            u = parent[u]
        stack.extend(pieces.values())
    return sums


def rollup_in_tasks(parts: DataFrame, values: list[str]) -> DataFrame:
    """(n1, n2, values over subtrees) of components of bounded size, named by t1 and t2."""
    schema = ", ".join(f"{c} long" for c in [*NODE, *values])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            place = {row[:2]: i for i, row in enumerate(held)}
            sums = centroid_sums([place.get(row[2:4], -1) for row in held], [row[4:] for row in held])
            return batch_of([(*row[:2], *x) for row, x in zip(held, sums, strict=True)], schema)

        for batch in batches:
            for *top, row in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), zip(*(batch.column(c).to_pylist() for c in [*NODE, *PARENT, *values]), strict=True), strict=True):
                if top != now and len(held) >= 4096:  # several components at once; their forest is one call
                    yield close()
                    held = []
                now = top
                held.append(row)
        if held:
            yield close()

    dealt = parts.select(*TOP, *NODE, *PARENT, "depth", *values).repartition(*TOP).sortWithinPartitions(*TOP, "depth")
    return dealt.mapInArrow(roll, schema)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def centroid_rollup(nodes: DataFrame, paths: DataFrame, values: list[str], most_nodes: int = 20_000) -> DataFrame:
    """(n1, n2, values over subtrees) of nodes (n1, n2, p1, p2, conv_id, depth, weight, values). A node's weight counts the rows of paths at or below it; the rows of paths of
    its conv_id lead from the top to it. Tops have a parent that is no node; all are of one depth."""
    top_depth = nodes.agg(F.min("depth")).first()[0]
    if top_depth is None:
        return nodes.select(*NODE, *values)
    first = paths.filter(F.col("depth") == top_depth).select("conv_id", *(F.col(c).alias(t) for c, t in zip(NODE, TOP, strict=True)))
    one = nodes.filter(F.col("depth") == top_depth).limit(2).select(*NODE).collect()
    tops = nodes.withColumns({t: F.lit(one[0][c]) for c, t in zip(NODE, TOP, strict=True)}) if len(one) == 1 else nodes.join(first, "conv_id")
    state = tops.select(*TOP, F.lit(top_depth).cast("long").alias("top_depth"), *NODE, *PARENT, "conv_id", F.col("depth").cast("long").alias("depth"), F.col("weight").cast("long").alias("weight"), *(F.col(v).cast("long").alias(v) for v in values))
    done, added, name = [], [], lambda prefix: [F.col(c).alias(f"{prefix}{c[1]}") for c in NODE]
    while True:
        state = materialize(state, "components")
        large = state.groupBy(*TOP).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total")).filter(F.col("n") > most_nodes)
        large = materialize(large.drop("n"), "large-components")
        if large.isEmpty():
            done.append(rollup_in_tasks(state, values))
            break
        some = _few(large)
        done.append(rollup_in_tasks(state.join(some, TOP, "left_anti"), values))
        heavy = state.join(some, TOP).filter(2 * F.col("weight") >= F.col("total"))
        found = F.struct(*name("c"), F.col("conv_id").alias("c_conv"), F.col("depth").alias("c_depth"), F.col("weight").alias("c_weight"), "top_depth")
        centroids = materialize(heavy.groupBy(*TOP).agg(F.max_by(found, "depth").alias("found")).select(*TOP, "found.*"), "centroids")
        few = _few(centroids)
        # the row of paths below the centroid leads to the child in whose subtree a node is
        depths = _few(centroids.select((F.col("c_depth") + 1).alias("depth")).distinct())
        branches = paths.join(depths, "depth").select("conv_id", F.col("depth").alias("b_depth"), *name("b"), *(F.col(p).alias(f"q{p[1]}") for p in PARENT))
        own = state.join(few.drop("top_depth"), TOP)
        sided = own.withColumn("b_depth", F.col("c_depth") + 1).join(branches, ["conv_id", "b_depth"], "left")
        is_centroid = (F.col("n1") == F.col("c1")) & (F.col("n2") == F.col("c2"))
        under = (F.col("depth") > F.col("c_depth")) & F.coalesce((F.col("q1") == F.col("c1")) & (F.col("q2") == F.col("c2")), F.lit(False))
        split = materialize(sided.select(*state.columns, *(F.col(c) for c in ("c1", "c2", "c_depth", "b1", "b2")), is_centroid.alias("is_centroid"), under.alias("under")), "split")
        totals = split.filter("is_centroid or under").groupBy("c1", "c2").agg(*(F.sum(v).alias(v) for v in values))
        totals = materialize(centroids.join(totals, ["c1", "c2"]), "centroid-totals")
        done.append(totals.select(F.col("c1").alias("n1"), F.col("c2").alias("n2"), *values))
        ways = paths.select("conv_id", "depth", *NODE).join(_few(totals.withColumnRenamed("c_conv", "conv_id").drop(*TOP)), "conv_id").filter("depth < c_depth and depth >= top_depth")
        to_root = totals.filter((F.col("top_depth") == 0) & (F.col("c_depth") > 0)).select(F.lit(ROOT[0]).alias("n1"), F.lit(ROOT[1]).alias("n2"), "c_weight", *values)  # paths have no row of depth 0
        ways = materialize(ways.select(*NODE, "c_weight", *values).unionByName(to_root), "ways")
        added.append(ways.select(*NODE, *values))
        lighter = ways.groupBy(*NODE).agg(F.sum("c_weight").alias("gone"))
        state = split.filter("not is_centroid").join(lighter, NODE, "left").select(*(F.when(F.col("under"), F.col(f"b{t[1]}")).otherwise(F.col(t)).alias(t) for t in TOP), F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"), *NODE, *PARENT, "conv_id", "depth", (F.col("weight") - F.coalesce("gone", F.lit(0))).alias("weight"), *values)
    out = done[0]
    for more in done[1:] + added:
        out = out.unionByName(more)
    return out if len(done) == 1 else out.groupBy(*NODE).agg(*(F.sum(v).alias(v) for v in values))


def member_digests(ends: DataFrame) -> DataFrame:
    """(n1, n2, sha256) of the ascending conv_ids, comma-joined, of each node's conversations (n1, n2, conv_id) that end there."""
    schema = "n1 long, n2 long, at long, piece binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for n1, n2, conv, least, at in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "conv_id", "before", "at")), strict=True):
                if (n1, n2) != now or size >= PIECE_BYTES:
                    if held:
                        out.append((*now, start, "".join(held).encode()))
                    now, start, held, size = (n1, n2), at, [], 0
                held.append(f",{conv}" if conv != least else str(conv))
                size += len(held[-1])
            yield batch_of(out, schema)
        if held:
            yield batch_of([(*now, start, "".join(held).encode())], schema)

    least = ends.groupBy(*NODE).agg(F.min("conv_id").alias("before"), F.count(F.lit(1)).alias("n"))
    marked = join_counted(ends, materialize(least, "least-ends"), NODE)  # the least member has no comma before it
    return joined_sha256(in_order(marked, [*NODE, "conv_id"]).mapInArrow(join, schema), NODE, "members")


def prefix_trie(convs: DataFrame, most_nodes: int = 20_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    turns = ordered_turns(convs)
    heads, paths = rebuilt_paths(turns)
    zero = [F.lit(r).alias(c) for c, r in zip(NODE, ROOT, strict=True)]
    root = heads.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("length").alias("weight")).filter("n_convs > 0")
    root = root.select(*zero, *(F.lit(None).cast("long").alias(p) for p in PARENT), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("n_chars"), F.greatest("weight", F.lit(1)).alias("weight"))
    grouped = paths.groupBy(*NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("n_chars").alias("n_chars"), F.sum("below").alias("weight"))
    nodes = materialize(grouped.unionByName(root), "nodes")
    children = materialize(nodes.filter("p1 is not null").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n")), "children")
    counted = children.toDF(*NODE, "n_children")
    nodes = materialize(nodes.join(counted, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_chars")), "trie")
    sums = centroid_rollup(nodes, paths, ["n_leaves", "saved_tokens"], most_nodes)
    ends = paths.filter("below = 1").select(*NODE, "conv_id").unionByName(heads.filter("length = 0").select(*zero, "conv_id"))
    out = materialize(nodes.select(*NODE, *PARENT, "conv_id", "depth", "n_convs", "n_children").join(sums, NODE).join(member_digests(ends), NODE, "left"), "rolled")
    parents = materialize(nodes.filter("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "parents")
    named = join_counted(out.filter("p1 is not null"), parents, PARENT).unionByName(out.filter("p1 is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: The same without hashes or centroids: nodes by their whole prefixes, subtrees by the prefixes of each node's least member. For tables that fit one machine.
OP11_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda crc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY later, pos) AS depth, md5(role) || md5(text) AS turn, length(text) AS chars FROM (
    SELECT c.conv_id, 0 AS later, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos >= h)),
p AS (SELECT conv_id, depth, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, chars FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
g AS (SELECT prefix, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, left(prefix, length(prefix) - 64) AS parent FROM p GROUP BY prefix),
k AS (SELECT parent AS prefix, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY parent),
n AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (prefix)),
s AS (SELECT a.prefix, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens
  FROM n u JOIN p a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.prefix),
e AS (SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) USING (conv_id, depth) GROUP BY prefix)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN s USING (prefix) LEFT JOIN e USING (prefix) LEFT JOIN g up ON n.depth > 0 AND up.prefix = n.parent
"""
