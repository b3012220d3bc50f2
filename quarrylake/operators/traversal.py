"""Graph loops: frontier traversal, paths, impact, closures, components and communities.

Each round is one plan over what the last round wrote to the shared folder; the driver sees counts only, and the
frontier and the visited nodes stay tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where the session names none and runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quarrylake-"))
    return _LOCAL[app]


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/rounds/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "outgoing") -> DataFrame:
    """(id, depth, parent, edge_id) of nodes within depth of the seeds; the least parent and edge of the first round that reaches a node."""
    a, b = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    # the edges of every round, read from their sources once
    step = written(edges.where("source_id is not null and target_id is not null").select(F.col(a).alias("from"), F.col(b).alias("to"), F.col("id").alias("edge_id")), "step")
    seen = seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("edge_id")).distinct()
    seen = written(seen, "reach")
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.select(F.col("id").alias("from")).join(step, "from").groupBy(F.col("to").alias("id")).agg(F.min(F.struct("from", "edge_id")).alias("x"))
        frontier = written(found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), F.col("x.from").alias("parent"), F.col("x.edge_id").alias("edge_id")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 8) -> DataFrame:
    """(step, id, edge_id) along a shortest path, or no rows. Stops at the round that reaches the target; walks back round by round."""
    spark = edges.sparkSession
    schema = "step int, id string, edge_id string"
    if source == target:
        return spark.createDataFrame([(0, source, None)], schema)
    e = written(edges.where("source_id is not null and target_id is not null").select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), F.col("id").alias("edge_id")), "step")
    seen = spark.createDataFrame([(source,)], "id string")
    frontier, rounds = seen, []
    for _ in range(depth):
        found = frontier.select(F.col("id").alias("from")).join(e, "from").groupBy(F.col("to").alias("id")).agg(F.min(F.struct("from", "edge_id")).alias("x"))
        frontier = written(found.join(seen, "id", "left_anti").select("id", F.col("x.from").alias("parent"), F.col("x.edge_id").alias("edge_id")), "path")
        rounds.append(frontier)
        if not frontier.where(F.col("id") == target).isEmpty():
            break
        if frontier.isEmpty():
            return spark.createDataFrame([], schema)
        seen = seen.unionByName(frontier.select("id"))
    else:
        return spark.createDataFrame([], schema)
    steps, at = [], target
    for d in range(len(rounds), 0, -1):
        row = rounds[d - 1].where(F.col("id") == at).first()
        steps.append((d, at, row["edge_id"]))
        at = row["parent"]
    return spark.createDataFrame([(0, source, None), *reversed(steps)], schema)


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """What depends on the seeds, directly or through others."""
    return reach(edges, seeds, depth, "incoming").where("depth > 0")


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): connected components without direction; a node without edges is its own. Large and small stars, by minima only."""
    now = written(edges.where("source_id is not null and target_id is not null and source_id <> target_id").select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).distinct(), "cc")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = mark(now)
    for _ in range(rounds):
        # large star: what hangs beneath v goes beneath v's least neighbour. least is written so that the join's sides are plain
        # shuffles, whose skewed parts (all that hangs beneath one root) Spark splits
        least = written(now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "cc-least")
        large = now.join(least, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        pairs = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        now = written(pairs.select("x.*").where("u <> v").distinct(), "cc")
        this = mark(now)
        if this == last:
            break
        last = this
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("id").join(now.select(F.col("u").alias("id"), F.col("v").alias("r")), "id", "left").select("id", F.coalesce("r", "id").alias("root"))


def communities(edges: DataFrame, symbols: DataFrame, cohesive: tuple) -> DataFrame:
    """(id, community): components over cohesive relations and symbols of one file. A file's symbols are tied to its least one."""
    least = symbols.groupBy("path").agg(F.min("id").alias("target_id"))
    ties = symbols.join(least, "path").select(F.col("id").alias("source_id"), "target_id")
    kept = edges.where(F.col("relation").isin(*cohesive)).select("source_id", "target_id").unionByName(ties)
    return components(kept, symbols).withColumnRenamed("root", "community")


def alias_closure(links: DataFrame, seeds: DataFrame, depth: int = 32) -> DataFrame:
    """(root, key): every alias that a key reaches through (alias_of, alias), the key itself included. UNION semantics end cycles."""
    seen = written(seeds.select(F.col("key").alias("root"), "key").distinct(), "closure")
    frontier = seen
    for _ in range(depth):
        more = frontier.join(links.select(F.col("alias_of").alias("key"), F.col("alias").alias("next")), "key").select("root", F.col("next").alias("key")).distinct()
        frontier = written(more.join(seen, ["root", "key"], "left_anti"), "closure")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def relocations(records: DataFrame, moves: DataFrame, hops: int = 8) -> DataFrame:
    """uri -> where it ends after at most hops moves."""
    out = records.select("uri", F.col("uri").alias("at"))
    step = moves.select(F.col("from_uri").alias("at"), "to_uri")
    for _ in range(hops):
        out = out.join(step, "at", "left").select("uri", F.coalesce("to_uri", "at").alias("at"))
    return out
