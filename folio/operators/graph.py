"""Graphs of objects, pages and outlines as edge tables: reachability, components, inheritance, preorder trees.

Loops grow a frontier by joins and cut their lineage through the session's checkpoint folder; nothing comes to the driver
but row counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared checkpoint folder (the warehouse where none is set) and read again."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """node of every node that a path leads to from a root, roots included. edges: src, dst; roots: node. depth: at most so
    many steps; without it ways of any length are followed to their end.

    A node with one edge into it is reached exactly if that edge's source is, so chains of such nodes are folded onto the
    node they hang from, in as many rounds as the length of the longest has binary digits; steps are walked among the rest.
    """
    start = settled(roots.select("node").distinct(), "reach")
    if depth is not None:
        return _walk(edges.select("src", "dst"), start, depth)
    ways = settled(edges.select("src", "dst").where("src != dst").distinct(), "reach")
    into = ways.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("at")).where("n = 1")
    up = settled(into.select(F.col("dst").alias("node"), "at").join(start, "node", "left_anti").withColumn("more", F.lit(True)), "reach")
    open_ = None
    while True:
        next_ = up.select(F.col("node").alias("at"), F.col("at").alias("to"))
        up = settled(up.drop("more").join(next_, "at", "left").select("node", F.coalesce("to", "at").alias("at"), F.col("to").isNotNull().alias("more")), "reach")
        left = up.where("more").count()
        if left in (0, open_):  # what is left hangs from a circle that nothing leads into
            break
        open_ = left
    hung = up.where("not more").select("node", "at")
    inner = ways.join(up.select(F.col("node").alias("dst")), "dst", "left_anti")
    inner = inner.join(hung, inner["src"] == hung["node"], "left").select(F.coalesce("at", "src").alias("src"), "dst").distinct()
    known = _walk(settled(inner, "reach"), start, None)
    return known.union(hung.join(known.select(F.col("node").alias("at")), "at").select("node"))


def _walk(edges: DataFrame, start: DataFrame, depth: int | None) -> DataFrame:
    """Step by step from the start, until nothing new is found or `depth` steps are done."""
    known = frontier = start
    steps = 0
    while depth is None or steps < depth:
        steps += 1
        frontier = settled(edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti"), "reach")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
        if steps % 32 == 0:  # one folder again, lest the plan grow with the way
            known = settled(known, "reach")
    return known


def renumbered(known: DataFrame) -> DataFrame:
    """node and its new number from 1, in order of the old one."""
    return known.select("node", F.row_number().over(Window.orderBy("node")).alias("new_num"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of all nodes in edges (a, b), by large and small stars in turn."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    stars = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        stars = settled(small.distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def inherit(tree: DataFrame, columns: list[str], depth: int | None = None) -> DataFrame:
    """tree (node, parent, ord, columns) with each column's nearest value on the way up, `level`, and `path` (the places of
    the way down). A node that is its own ancestor is cut; one listed under two parents comes twice. depth: levels below
    the roots that are followed, all without it."""
    level = tree.where("parent is null").select("node", *columns, F.lit(0).alias("level"), F.array(F.col("ord").cast("long")).alias("path"), F.array("node").alias("__up"))
    out = level = settled(level, "inherit")
    k = 0
    while depth is None or k < depth:
        k += 1
        down = tree.alias("c").join(level.alias("p"), F.col("c.parent") == F.col("p.node")).where(~F.array_contains("p.__up", F.col("c.node")))
        level = down.select(F.col("c.node").alias("node"), *(F.coalesce(f"c.{c}", f"p.{c}").alias(c) for c in columns), F.lit(k).alias("level"), F.concat("p.path", F.array(F.col("c.ord").cast("long"))).alias("path"), F.concat("p.__up", F.array("c.node")).alias("__up"))
        level = settled(level, "inherit")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("__up")


def subtree_counts(flat: DataFrame, file: str, order: str, depth: str) -> DataFrame:
    """flat preorder rows with `branch_end` (the place after a row's last descendant) and `descendants`.

    A row's branch ends where the next row of its depth or less stands: for each depth the place of the last such row seen
    from behind, so that a row carries as many places as there are depths, not as there are rows."""
    w = Window.partitionBy(file).orderBy(order)
    rows = flat.withColumn("__at", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(file)))
    behind = w.rowsBetween(1, Window.unboundedFollowing)
    depths = sorted(r[0] for r in flat.select(depth).distinct().collect() if r[0] is not None)  # outlines are a few levels deep
    ends = [F.when(F.col(depth) >= d, F.min(F.when(F.col(depth) == d, F.col("__at"))).over(behind)) for d in depths]
    end = F.least(F.col("__n"), F.col("__n"), *ends)
    return rows.withColumn("branch_end", end.cast("long")).withColumn("descendants", (F.col("branch_end") - F.col("__at") - 1).cast("long")).drop("__at", "__n")


def newest(versions: DataFrame, by: list[str], order: str, tie: str) -> DataFrame:
    """The newest definition of each object: the last by order, then by tie."""
    latest = versions.groupBy(*by).agg(F.max(F.struct(order, tie, *[c for c in versions.columns if c not in (*by, order, tie)])).alias("__v"))
    return latest.select(*by, "__v.*")


def duplicate_objects(objects: DataFrame, key: str, body: str) -> DataFrame:
    """key, keeper: of objects with equal bodies the least key stands for all; equal is told by a 256-bit digest and the length."""
    marked = objects.select(key, F.sha2(F.col(body).cast("binary"), 256).alias("__d"), F.octet_length(F.col(body).cast("binary")).alias("__n"))
    least = marked.groupBy("__d", "__n").agg(F.min(key).alias("keeper"))
    return marked.join(least, ["__d", "__n"]).select(key, "keeper")


def overlay(base: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Changes in front of a file's own objects."""
    return changes.unionByName(base.join(changes.select(*by), by, "left_anti"))
