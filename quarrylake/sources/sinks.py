"""Sinks: graph exports, findings, portable bundles, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, id, line) of a GraphML body: nodes, then edges with both ends."""
    n = symbols.select(F.lit(0).alias("section"), "id", F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="name">'), _xml(F.col("name")), F.lit("</data></node>")).alias("line"))
    e = edges.where("source_id is not null and target_id is not null").select(F.lit(1).alias("section"), "id", F.concat(F.lit('<edge id="'), _xml(F.col("id")), F.lit('" source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


def write_graph(symbols: DataFrame, edges: DataFrame, path: str, kind: str = "json") -> None:
    """json: two folders of JSON lines; graphml: lines sorted by section over range partitions."""
    if kind == "json":
        symbols.write.mode("overwrite").json(f"{path}/symbols")
        edges.write.mode("overwrite").json(f"{path}/edges")
    elif kind == "graphml":
        graphml_lines(symbols, edges).repartitionByRange("section", "id").sortWithinPartitions("section", "id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(kind)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object a finding, as JSON text."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return findings.select(F.to_json(F.struct(F.col("category").alias("ruleId"), level.alias("level"), F.struct(F.col("detail").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))).alias("value"))


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def bundle_plan(files: DataFrame) -> DataFrame:
    """(path, digest, position) in path order over range partitions; a path twice is an error."""
    n = files.groupBy("path").agg(F.count("*").alias("n"), F.min(F.sha2(F.col("content").cast("binary"), 256)).alias("digest"))
    return n.select("path", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate path "), F.col("path")))).otherwise(F.col("digest")).alias("digest"))


def bundle_digest(plan: DataFrame) -> DataFrame:
    """One row: a digest of the set of (path, digest), summed in parallel: the sum of row digests modulo 2**64 and the count."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\x00", "path", "digest"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return plan.agg(F.count("*").alias("files"), F.sha2(F.concat(F.count("*").cast("string"), F.lit(":"), F.coalesce(F.sum(part), F.lit(0)).cast("string")), 256).alias("digest"))


def write_snapshot(rows: DataFrame, path: str, snapshot: str = "snapshot_id") -> None:
    rows.write.mode("append").partitionBy(snapshot).parquet(path)


def read_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """The partition filter prunes all other snapshots."""
    return spark.read.parquet(path).where(F.col("snapshot_id") == snapshot_id)


def import_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """new, same or conflict by uri and content hash; aliases of existing content are told."""
    e = existing.select("uri", F.col("hash").alias("old"))
    by_content = existing.groupBy("hash").agg(F.min("uri").alias("alias"))
    j = incoming.join(e, "uri", "left").join(by_content, "hash", "left")
    return j.select("uri", F.when(F.col("old") == F.col("hash"), "same").when(F.col("old").isNotNull(), "conflict").when(F.col("alias").isNotNull(), "alias").otherwise("new").alias("plan"), "alias")
