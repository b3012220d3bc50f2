"""Vector search over coarse cells: a written index, a probed search of measured recall, and an exact search by bounds.

Vectors are taken to unit length and given to the nearest of up to MOST_CELLS centres, which spherical k-means finds on a
sample of SAMPLE rows at most; every vector is indexed. A cell's radius is the greatest angle between its centre and a member.
A query reads the cells whose centres are nearest to it: as many as hold RECALL of the true neighbours of CALIBRATED vectors,
which build() searches for exactly. The exact search then also reads every cell that may hold a
better vector than the k-th found: no member is nearer to the query than the centre's angle less the radius.

Queries meet vectors block by block: cells are cut into blocks of BLOCK_ROWS, queries of a cell into blocks of as many, and each
pair of blocks is one matrix product, which passes on its k best a query. So no group grows with the input, and no pair of
rows is written that is not among the best of its block.

Every vector needs components, all finite, of a length above zero, as many as all others, and an id of its own; else build() and
search() raise ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .recall import term_top_k
from .traversal import written

SAMPLE, MOST_CELLS, BLOCK_ROWS, ROUNDS = 32_768, 4096, 4096, 8
#: Vectors that build() looks up to choose the number of probes, their neighbours, and the share of these to be found.
CALIBRATED, NEIGHBOURS, RECALL = 64, 10, 0.95
#: Most numbers of a product of vectors and centres, and of the vectors of a batch given back, held at once by a Python worker.
MOST_AT_ONCE = 1 << 20
#: What rounding may take from a bound.
SLACK = 1e-9

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _slices(b: pa.RecordBatch, width: int):
    """A batch in slices of whose rows each has width numbers: MOST_AT_ONCE together, a row at least."""
    step = max(1, MOST_AT_ONCE // max(1, width))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def unit(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v) of unit length. Raises ValueError for vectors that are none, and for ids that come twice."""
    v = F.col(vector)
    rows = df.select(F.col(id_).cast("long").alias(id_), F.transform(v, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm)
    bad, ids, n, least, most = rows.agg(F.sum(F.when(F.col("norm").isNull() | F.isnan("norm") | (F.col("norm") <= 0) | (F.col("norm") == float("inf")) | F.col(id_).isNull(), 1).otherwise(0)), F.count_distinct(id_), F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if bad:
        raise ValueError(f"{bad} vectors have no finite length above zero, or no id")
    if ids < n:
        raise ValueError(f"{n - ids} vector ids are repeated")
    if n and least != most:
        raise ValueError(f"vectors of {least} and {most} dimensions")
    return rows.select(id_, F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means. An empty cell takes the vector that is farthest from its centre."""
    centres = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(rounds):
        near, best = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        step = max(1, MOST_AT_ONCE // max(1, len(centres)))
        for at in range(0, len(sample), step):
            score = sample[at : at + step] @ centres.T
            near[at : at + step], best[at : at + step] = score.argmax(axis=1), score.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=len(centres))
        lone = np.flatnonzero(sizes == 0)
        sums[lone] = sample[np.argsort(best, kind="stable")[: len(lone)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _placed(batches, id_: str, centres: np.ndarray):
    for b in (part for whole in batches for part in _slices(whole, len(centres))):
        score = _matrix(b.column("v")) @ centres.T
        cell = score.argmax(axis=1)
        yield pa.RecordBatch.from_arrays([b.column(id_), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(score[np.arange(len(cell)), cell])], names=[id_, "v", "cell", "near"])


def _nearest(df: DataFrame, id_: str, centres: np.ndarray) -> DataFrame:
    """df with the cell of each vector and the cosine of its angle to the centre."""
    return df.mapInArrow(lambda batches: _placed(batches, id_, centres), f"{id_} long, v array<double>, cell int, near double")


@dataclass
class VectorIndex:
    """The folder of an index: vectors by cell, and its cells (cell, centre, rows, parts, cos_radius), MOST_CELLS at most."""

    spark: SparkSession
    path: str

    @property
    def probes(self) -> int:
        """Cells to read for RECALL of the neighbours."""
        return self.spark.read.parquet(f"{self.path}/probes").first()["probes"]

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """All vectors, or those of some cells, whose folders alone are read."""
        rows = self.spark.read.schema("vec_id long, v array<double>, part int, cell int").parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))


def build(vectors: DataFrame, path: str, cells: int | None = None, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """Index of vectors (vec_id, v) in a folder. cells: about the square root of their number, if not given."""
    spark = vectors.sparkSession
    rows = written(unit(vectors, "vec_id", "v"), "unit-vectors")
    n = rows.count()
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v"))
    centres = _centres(sample, max(1, min(MOST_CELLS, cells or int(n**0.5), len(sample))), ROUNDS) if n else np.zeros((1, 1))
    near = written(_nearest(rows, "vec_id", centres), "near-vectors")
    found = near.groupBy("cell").agg(F.count("*").alias("rows"), F.min("near").alias("cos_radius"))
    names = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    table = names.join(found, "cell").withColumn("parts", F.ceil(F.col("rows") / block_rows).cast("int"))
    table.write.mode("overwrite").parquet(f"{path}/cells")
    parts = spark.read.parquet(f"{path}/cells").select("cell", "parts")
    placed = near.join(parts, "cell").select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "cell")
    placed.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    index = VectorIndex(spark, path)
    spark.createDataFrame([(_calibrated(index, block_rows),)], "probes int").write.mode("overwrite").parquet(f"{path}/probes")
    return index


def opened(vectors: DataFrame, path: str) -> VectorIndex:
    """The index of vectors kept below a folder, by a digest of all rows: built where there is none of these."""
    spark = vectors.sparkSession
    n, mark = vectors.agg(F.count("*"), F.bit_xor(F.xxhash64("vec_id", "v"))).first()
    folder = f"{path}/{n}-{(mark or 0) & (1 << 64) - 1:016x}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/probes/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return VectorIndex(spark, folder)
    return build(vectors, folder)


def _calibrated(index: VectorIndex, block_rows: int) -> int:
    """The place, in a vector's order of cells, up to which RECALL of its true neighbours lie."""
    some = index.vectors().orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(CALIBRATED).select(F.col("vec_id").alias("query_id"), "v")
    asked = some.toArrow()
    if not asked.num_rows:
        return 1
    found = search(index, index.spark.createDataFrame(asked), NEIGHBOURS, probes=MOST_CELLS, same_id=False, block_rows=block_rows)
    cell_of = {(r["query_id"], r["vec_id"]): r["cell"] for r in found.join(index.vectors().select("vec_id", "cell"), "vec_id").collect()}
    table = index.cells.orderBy("cell").toArrow()
    order = np.argsort(-(_matrix(asked.column("v")) @ _matrix(table.column("centre")).T), axis=1, kind="stable")
    place = {(q, int(table.column("cell")[c].as_py())): at + 1 for q, row in zip(asked.column("query_id").to_pylist(), order) for at, c in enumerate(row)}
    ranks = sorted(place[q, c] for (q, _), c in cell_of.items())
    return ranks[min(len(ranks) - 1, int(len(ranks) * RECALL))] if ranks else 1


def _asked(batches, number: np.ndarray, parts: np.ndarray, centres: np.ndarray, radius: np.ndarray, probes: int, later: bool):
    for b in (part for whole in batches for part in _slices(whole, len(number)) if len(number)):
        score = _matrix(b.column("v")) @ centres.T
        order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        first = np.zeros(score.shape, bool)
        np.put_along_axis(first, order, True, axis=1)
        if later:
            bound = np.cos(np.maximum(0, np.arccos(np.clip(score, -1, 1)) - radius - SLACK))
            first = ~first & (bound >= b.column("floor").to_numpy()[:, None] - SLACK)
        q, c = np.nonzero(first)
        step = max(1, MOST_AT_ONCE // centres.shape[1])
        for i in range(0, len(q), step):
            at, of = pa.array(q[i : i + step]), c[i : i + step]
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("v").take(at), pa.array(number[of]), pa.array(parts[of])], names=["query_id", "v", "cell", "parts"])


def _probes(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, v, cell, parts) of the cells that each query reads: the probes nearest, or, where queries have a floor, all others that may hold a score of floor or more."""
    table = index.cells.orderBy("cell").toArrow()
    number, parts = table.column("cell").to_numpy(), table.column("parts").to_numpy()
    centres, radius = _matrix(table.column("centre")), np.arccos(np.clip(table.column("cos_radius").to_numpy(), -1, 1))
    later = "floor" in queries.columns
    return queries.mapInArrow(lambda batches: _asked(batches, number, parts, centres, radius, probes, later), "query_id long, v array<double>, cell int, parts int")


def _scan(index: VectorIndex, probes: DataFrame, k: int, minimum: float, same_id: bool, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block and query, and what rounds to the same as the k-th."""
    probes = written(probes, "probes")
    asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("query_parts"))
    names = [r["cell"] for r in asked.select("cell").collect()]  # MOST_CELLS at most
    q = probes.join(asked, "cell").withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    v = index.vectors(names).join(asked, "cell").withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, vec_ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            of, by = _matrix(left.column("v")), _matrix(right.column("v")).T
            for at in range(0, len(ids), 512):
                score = np.clip(of[at : at + 512] @ by, -1, 1)
                if not same_id:
                    score[ids[at : at + 512, None] == vec_ids] = -2
                floor = np.full(len(score), minimum)
                if score.shape[1] > k:
                    floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k] - 1e-5)
                a, b = np.nonzero(score >= floor[:, None])
                out.append(pa.Table.from_arrays([pa.array(ids[at + a]), pa.array(vec_ids[b]), pa.array(score[a, b])], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    keys = ["cell", "part", "query_part"]
    return q.select(*keys, "query_id", "v").groupBy(*keys).cogroup(v.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(product, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int, digits: int) -> DataFrame:
    return term_top_k(found.withColumn("score", F.round("score", digits)), k, ["query_id"], [F.desc("score"), "vec_id"]).select("query_id", "vec_id", "score")


def search(index: VectorIndex, queries: DataFrame, k: int, minimum: float = -1.0, probes: int | None = None, exact: bool = False, same_id: bool = True, digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best vectors of each query (query_id, v) by cosine, ties by id: (query_id, vec_id, score).

    probes: cells that a query reads, as many as the index found to be needed if not given. exact: also reads all cells that the probed ones do not rule out. same_id False: a query's own id is no answer.
    """
    probes = index.probes if probes is None else probes
    q = written(unit(queries, "query_id", "v"), "queries")
    found = _scan(index, _probes(index, q, probes), k, minimum, same_id, block_rows)
    if not exact:
        return _best(found, k, digits)
    found = written(found, "probed")
    kth = _best(found, k, digits).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.col("least") - 10.0**-digits).otherwise(F.lit(float(minimum)))
    rest = q.join(kth, "query_id", "left").select("query_id", "v", F.coalesce(floor, F.lit(float(minimum))).alias("floor"))
    more = _scan(index, _probes(index, rest, probes), k, minimum, same_id, block_rows)
    return _best(found.unionByName(more), k, digits)
