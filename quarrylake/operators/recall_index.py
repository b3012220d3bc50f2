"""A recall index on disk: postings by hash of the term, refreshed by delta.

A folder holds, for each generation: documents (their statistics, a digest of what they are made from, and the buckets
that their terms lie in; no texts), postings and document frequencies by bucket, and a manifest that names, for each bucket,
the generation that last wrote it. A refresh compares digests, tokenises only what is new or changed, and writes anew
only the buckets that hold a term of a document that came, changed or went; all others stay where they are. What it leaves is
row for row what a build from nothing would give.

A generation counts once its manifest is whole (Spark's _SUCCESS), so a refresh that dies leaves the one before in force, and a
reader keeps the files it began with. generation is a digest chained from refresh to refresh over what changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming.streams import generation_digest
from .recall import document_frequency, source_changes
from .traversal import written

#: Buckets of a new index: one for so many documents, within limits.
BUCKET_DOCS, LEAST_BUCKETS, MOST_BUCKETS = 8000, 16, 4096
#: Of the files; an index of another one is not read.
LAYOUT = 2
_NEVER = -1
_POSTINGS = "doc_id long, term string, field_weight int, tf long, n long, length long"

Tokenise = Callable[[DataFrame], DataFrame]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class RecallIndex:
    """One generation of an index. manifest: bucket -> generation whose files hold it (none: no rows)."""

    spark: SparkSession
    path: str
    number: int
    buckets: int
    generation: str
    manifest: dict[int, int] = field(repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RecallIndex | None:
        """The newest whole generation, or None."""
        fs, at = _fs(spark, f"{path}/manifest")
        if not fs.exists(at):
            return None
        numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not numbers:
            return None
        rows = spark.read.parquet(f"{path}/manifest/g={max(numbers)}").collect()  # a row a bucket
        return cls(spark, path, max(numbers), rows[0]["buckets"], rows[0]["generation"], {r["bucket"]: r["written"] for r in rows})

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents/g={self.number}")

    def _parts(self, name: str, schema: str, buckets: list[int] | None) -> DataFrame:
        wanted = range(self.buckets) if buckets is None else buckets
        paths = [f"{self.path}/{name}/g={self.manifest[b]}/bucket={b}" for b in wanted if self.manifest[b] != _NEVER]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_id, term, field_weight, tf, n, length), of some buckets' files or all; length is the document's."""
        return self._parts("postings", _POSTINGS, buckets)

    def frequency(self, buckets: list[int] | None = None) -> DataFrame:
        """(term, frequency): logical documents that have a term."""
        return self._parts("frequency", "term string, frequency long", buckets)

    def buckets_of(self, terms: DataFrame) -> list[int]:
        """The buckets that hold terms (MOST_BUCKETS numbers at most)."""
        return sorted(r["b"] for r in terms.select(bucket_of(F.col("term"), self.buckets).alias("b")).distinct().collect())


def _digested(docs: DataFrame) -> DataFrame:
    """docs with a digest of all columns."""
    return docs.withColumn("digest", F.md5(F.to_json(F.struct(*sorted(docs.columns))).cast("binary")))


def _write(spark: SparkSession, path: str, number: int, buckets: int, generation: str, docs: DataFrame, postings: DataFrame, affected: list[int] | None, before: dict[int, int]) -> RecallIndex:
    """One generation: all documents, the affected buckets (None: all) and the manifest, last."""
    docs.write.mode("overwrite").parquet(f"{path}/documents/g={number}")
    docs = spark.read.parquet(f"{path}/documents/g={number}")
    placed = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    placed.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/g={number}")
    mine = spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{path}/postings/g={number}")
    frequency = document_frequency(mine, docs, "doc_id").withColumn("bucket", bucket_of(F.col("term"), buckets))
    frequency.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/frequency/g={number}")
    there = {r["bucket"] for r in mine.select("bucket").distinct().collect()}
    changed = range(buckets) if affected is None else affected
    manifest = before | {b: number if b in there else _NEVER for b in changed}
    spark.createDataFrame([(b, w, buckets, generation) for b, w in manifest.items()], "bucket int, written int, buckets int, generation string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/g={number}")
    return RecallIndex(spark, path, number, buckets, generation, manifest)


def _gathered(postings: DataFrame, buckets: int) -> DataFrame:
    """Written: a row a document with its length (the sum of n), the buckets of its terms and its postings. Where these were counted by document, nothing moves."""
    posts = F.collect_list(F.struct("term", bucket_of(F.col("term"), buckets).alias("bucket"), F.col("field_weight").cast("int").alias("field_weight"), F.col("tf").cast("long").alias("tf"), F.col("n").cast("long").alias("n")))
    rows = postings.groupBy("doc_id").agg(posts.alias("posts"), F.sum("n").cast("long").alias("length"))
    return written(rows.withColumn("buckets", F.array_sort(F.array_distinct("posts.bucket"))), "postings")


def _rows(gathered: DataFrame) -> DataFrame:
    """The postings of gathered documents."""
    return gathered.select("doc_id", "length", F.explode("posts").alias("x")).select("doc_id", "x.term", "x.field_weight", "x.tf", "x.n", "length")


def _statistics(docs: DataFrame, gathered: DataFrame) -> DataFrame:
    """Documents as the index keeps them: digest, length and the buckets of their terms; no texts."""
    held = gathered.select("doc_id", F.col("length"), "buckets")
    return docs.drop("text", "title").join(held, "doc_id", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long"))).withColumn("buckets", F.coalesce("buckets", F.array().cast("array<int>")))


def build(docs: DataFrame, path: str, tokenise: Tokenise, buckets: int | None = None) -> RecallIndex:
    """Indexes docs (doc_id, uri, logical_key, recorded_at, text, ...) in an empty folder. tokenise: docs -> (doc_id, term, field_weight, tf, n)."""
    spark = docs.sparkSession
    full = _digested(docs)
    buckets = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, docs.count() // BUCKET_DOCS))
    postings = _gathered(tokenise(docs), buckets)
    changes = full.select(F.col("doc_id").cast("string").alias("uri"), F.col("digest").alias("change"))
    generation = generation_digest("", changes).first()["generation"]
    return _write(spark, path, 0, buckets, generation, _statistics(full, postings), _rows(postings), None, {})


def changed_documents(index: RecallIndex, docs: DataFrame) -> DataFrame:
    """(doc_id, change, digest): what a refresh to docs would take in or out."""
    full = _digested(docs).select("doc_id", "digest")
    return source_changes(full, index.documents.select("doc_id", "digest"), ["digest"], "doc_id").join(full, "doc_id", "left")


def refresh(index: RecallIndex, docs: DataFrame, tokenise: Tokenise) -> RecallIndex:
    """The index of docs: index itself where nothing changed."""
    spark, old = index.spark, index.documents
    changes = written(changed_documents(index, docs), "index-changes")
    if changes.isEmpty():
        return index
    fresh = docs.join(changes.where("change <> 'removed'").select("doc_id"), "doc_id", "left_semi")
    postings = _gathered(tokenise(fresh), index.buckets)
    gone = written(changes.where("change <> 'added'").select("doc_id"), "index-gone")
    kept = old.join(gone, "doc_id", "left_anti")
    came = _statistics(_digested(fresh), postings)
    # buckets that a document leaves or enters: MOST_BUCKETS numbers at most
    left = old.join(gone, "doc_id", "left_semi").select(F.explode("buckets").alias("b"))
    affected = sorted(r["b"] for r in left.unionByName(postings.select(F.explode("buckets").alias("b"))).distinct().collect())
    after = index.postings(affected).join(gone, "doc_id", "left_anti").unionByName(_rows(postings))
    generation = generation_digest(index.generation, changes.select(F.col("doc_id").cast("string").alias("uri"), F.concat_ws(":", "change", "digest").alias("change"))).first()["generation"]
    return _write(spark, index.path, index.number + 1, index.buckets, generation, kept.unionByName(came), after, affected, index.manifest)


def opened(docs: DataFrame, path: str, tokenise: Tokenise) -> RecallIndex:
    """The index of docs in a folder: built if there is none, else refreshed to docs."""
    index = RecallIndex.open(docs.sparkSession, path)
    return build(docs, path, tokenise) if index is None else refresh(index, docs, tokenise)
