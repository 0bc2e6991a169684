"""Graph operators over hops (src depends on dst): iterative joins of a frontier; each round writes what it found."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the cluster shares, which cuts the lineage of a loop."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Fixed value: the order of edge kinds.
KINDS = ("references", "produces", "targets", "invokes", "accepts", "returns", "fieldOf", "dependsOn")


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def hops(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence): dependent and dependency; a produces edge is turned round."""
    turned = F.col("kind") == "produces"
    return edges.select(F.when(turned, F.col("to")).otherwise(F.col("from")).alias("src"), F.when(turned, F.col("from")).otherwise(F.col("to")).alias("dst"), "kind", "confidence")


def neighbors(hop: DataFrame, up: bool) -> DataFrame:
    """(node, neighbor): distinct far ends, unknown nodes included."""
    near, far = ("dst", "src") if up else ("src", "dst")
    return hop.select(F.col(near).alias("node"), F.col(far).alias("neighbor")).distinct()


def widest(roots: DataFrame, hop: DataFrame, nodes: DataFrame | None = None, up: bool = True, top: int = 3) -> DataFrame:
    """(root, node, confidence): for all that reach the root (up) or that it reaches, the greatest over paths of the least edge
    confidence. nodes (id) limits the walk to known ones. Only pairs that got better are joined in the next round, and each round writes these alone. Steps to nodes from
    which no step leads on are taken once, behind the last round."""
    near, far = ("dst", "src") if up else ("src", "dst")
    steps = hop.groupBy(F.col(near).alias("at"), F.col(far).alias("next")).agg(F.max("confidence").alias("edge"))
    if nodes is not None:
        steps = steps.join(nodes.select(F.col("id").alias("next")).distinct(), "next", "left_semi")
    steps = written(steps.select("at", "next", "edge"))
    leads = written(steps.select(F.col("at").alias("next")).distinct())
    inner, last = written(steps.join(leads, "next", "left_semi")), steps.join(leads, "next", "left_anti")
    frontier = written(roots.select("root").distinct().join(leads.select(F.col("next").alias("root")), "root", "left_semi").select("root", F.col("root").alias("node"), F.lit(top).alias("confidence")))
    found, rounds = frontier, 0
    while True:  # confidences only rise, so it ends
        reached = frontier.join(inner, frontier["node"] == inner["at"]).groupBy("root", F.col("next").alias("node")).agg(F.max(F.least("confidence", "edge")).alias("new"))
        known = found.groupBy("root", "node").agg(F.max("confidence").alias("confidence"))
        frontier = written(reached.join(known, ["root", "node"], "left").filter("confidence is null or new > confidence").select("root", "node", F.col("new").alias("confidence")))
        if frontier.isEmpty():
            break
        found, rounds = found.union(frontier), rounds + 1
        if rounds % 4 == 0:  # a long walk's plan stays short
            found = written(found.groupBy("root", "node").agg(F.max("confidence").alias("confidence")))
    best = written(known)
    ends = best.join(last, best["node"] == last["at"]).groupBy("root", F.col("next").alias("node")).agg(F.max(F.least("confidence", "edge")).alias("confidence"))
    return best.filter("root <> node").union(ends)


def trace(roots: DataFrame, hop: DataFrame, nodes: DataFrame, depth: int, up: bool, order: tuple[str, ...] = ()) -> DataFrame:
    """(root, node, depth, via, via_kind, confidence, visit): breadth-first, each node once, neighbours in order of id; confidence is the
    least along the tree path, visit the path of ids by which a level is ordered. Unknown nodes are passed over; of parallel edges the first
    by kind counts, of those of one kind the first by the columns of order (as source, status and field; nulls first), then the surest."""
    near, far = ("dst", "src") if up else ("src", "dst")
    place = F.struct(kind_rank(F.col("kind")), *order, -F.col("confidence"))
    first = hop.groupBy(F.col(near).alias("at"), F.col(far).alias("next")).agg(F.min_by(F.struct("kind", F.col("confidence").alias("edge")), place).alias("e"))
    steps = written(first.select("at", "next", "e.*").join(nodes.select(F.col("id").alias("next")).distinct(), "next", "left_semi"))
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("via_kind"), F.lit(3).alias("confidence"), F.array("root").alias("visit"))
    seen = frontier = written(start)
    for level in range(1, max(1, min(10, depth)) + 1):
        found = frontier.join(steps, frontier["node"] == steps["at"]).select("root", F.col("next").alias("node"), F.lit(level).alias("depth"), F.col("at").alias("via"), F.col("kind").alias("via_kind"), F.least("confidence", "edge").alias("confidence"), F.concat("visit", F.array("next")).alias("visit"))
        fresh = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = written(fresh.groupBy("root", "node").agg(F.min_by(F.struct("depth", "via", "via_kind", "confidence", "visit"), "visit").alias("b")).select("root", "node", "b.*"))
        if frontier.isEmpty():
            break
        seen = written(seen.union(frontier))
    return seen.filter("depth > 0")


def roll_up(reached: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds the owners (id, owner) of reached nodes with at least the node's confidence; not the root itself."""
    own = reached.join(owners, reached["node"] == owners["id"]).select("root", F.col("owner").alias("node"), "confidence")
    return reached.select("root", "node", "confidence").union(own.filter("root <> node")).groupBy("root", "node").agg(F.max("confidence").alias("confidence"))


def strong_components(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of the strongly connected components over one node of (src, dst); component is the least node, and it is an error if most_rounds don't do. Nodes without both a way in
    and out are trimmed first; then least labels spread forward, and what each label's node is reached back from, within its colour, is a component."""
    left, done = written(pairs.filter("src <> dst").select("src", "dst").distinct()), None
    for _ in range(most_rounds):  # a round at least finds the component of the least node that is left
        while True:  # trim
            kept = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same, left = kept.count() == left.count(), kept
            if same:
                break
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).distinct()
        colour = written(nodes.select("node", F.col("node").alias("colour")))
        while True:
            into = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            new = written(colour.join(into, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        inside = left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst", F.col("a").alias("colour"))
        inside = written(inside)
        reach = written(colour.filter("node = colour"))
        while True:
            back = inside.join(reach.toDF("dst", "c"), "dst").filter("c = colour").select(F.col("src").alias("node"), "colour").distinct().join(reach, ["node", "colour"], "left_anti")
            back = written(back)
            if back.isEmpty():
                break
            reach = written(reach.union(back))
        done = reach if done is None else done.union(reach)
        left = written(left.join(reach.select(F.col("node").alias("src")), "src", "left_anti").join(reach.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    else:
        raise RuntimeError("components did not end in most_rounds")
    if done is None:
        return pairs.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    many = done.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return done.join(many, "colour").select("node", F.col("colour").alias("component"))


def page(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The first rows by key, 50 unless asked otherwise and 500 at most."""
    return df.orderBy(key).limit(max(1, min(500, limit or 50)))


def any_of(column: Column, values: list[str]) -> Column:
    return F.lower(column).isin([v.lower() for v in values])
