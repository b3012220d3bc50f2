"""Mixing sources to target weights: Pareto order sampling, in DataFrame functions only.

Each source gets a target number of words; a class of documents (source and size class) gets expected copies e.
floor(e) copies are certain; the fraction is an inclusion probability p. A document draws a uniform u from its id and
is ranked inside its source by random odds over inclusion odds, (u/(1-u)) / (p/(1-p)); the sample is the documents
ranked first, as many as fill the words that the certain copies left open. Longer documents have a somewhat greater
p, so the sample is one of fixed size (in words) with unequal probabilities.

The cut is found without sorting a source: ranks are counted in BUCKETS buckets a source, the bucket that the cut falls
into is counted again in BUCKETS parts, and only the rows of the part with the cut are looked at one by one.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id draws by its
source and text; rows of one id share their draw and so their fate, as do equal rows without an id; sizes of 0 are never
drawn and leave the shares of the others as they are; a source without words, and every source where there are no words
at all, has the target 0; an empty table gives an empty result; other columns are kept by `mix` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import read_table, scratch

WEIGHTS, SHARE, MOST, BUCKETS = (3, 1, 2), 1.5, 2.0, 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, source: Column, text: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5: the same on every engine and rerun."""
    unnamed = F.concat_ws("|", F.lit("null"), F.coalesce(source, F.lit("")), F.coalesce(text, F.lit("")))
    key = F.concat_ws("|", F.lit("mix"), F.coalesce(doc_id.cast("string"), unnamed))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _level(df: DataFrame, by: list[str], budget: Column, cap: Column, weight: Column, out: str) -> DataFrame:
    """Shares budget by weight with a cap each, the excess reshared until none is above. Rows in order of cap/weight are capped as long as the level that the rest would get is above them. Weights are above 0; a row with a cap of 0 comes first and is capped, so its weight changes no other's share."""
    over = Window.partitionBy(*by).orderBy(F.col("_cap") / F.col("_weight"), "_cap", "_weight").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_cap", cap).withColumn("_weight", weight)
    df = df.withColumn("_done", F.coalesce(F.sum("_cap").over(over), F.lit(0))).withColumn("_used", F.coalesce(F.sum("_weight").over(over), F.lit(0)))
    whole = Window.partitionBy(*by)
    df = df.withColumn("_level", (budget - F.col("_done")) / (F.sum("_weight").over(whole) - F.col("_used")))
    df = df.withColumn("_capped", F.col("_cap") / F.col("_weight") <= F.col("_level"))
    df = df.withColumn("_rest", F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_weight"), "_cap", "_weight", "_level"))).over(whole)["_level"])
    return df.withColumn(out, F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_weight") * F.col("_rest"))).drop("_cap", "_weight", "_done", "_used", "_level", "_capped", "_rest")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> target. One row a source; weights repeat in code-point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("_w", weight).withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
    return _level(ranked, [], F.col("_all") * F.lit(share), F.col("source_size") * F.lit(most), F.col("_w"), "target").drop("_w", "_all")


def size_class(size: Column) -> Column:
    """Binary digits of the size: at most 63 classes a source."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)).cast("int")


def _rank(u: Column, p: Column) -> Column:
    return F.try_divide(u / (F.lit(1.0) - u), p / (F.lit(1.0) - p))


def _bucket(q: Column) -> Column:
    """One of BUCKETS * BUCKETS steps of the rank; its quotient by BUCKETS is the wider bucket."""
    return F.floor(q / (q + F.lit(1.0)) * F.lit(BUCKETS * BUCKETS)).cast("int")


def _edge(draws: DataFrame, need: DataFrame, bucket: Column) -> DataFrame:
    """source, the bucket that the cut falls into and the words that are left open there; need has (_s, room)."""
    counts = draws.withColumn("_at", bucket).groupBy("source", "_at").agg(F.sum("size").alias("_words"))
    running = counts.withColumn("_after", F.sum("_words").over(Window.partitionBy("source").orderBy("_at")))
    reached = running.join(need, running["source"].eqNullSafe(F.col("_s"))).where(F.col("_after") - F.col("_words") < F.col("room"))
    last = reached.groupBy("source").agg(F.max(F.struct("_at", "_after", "_words", "room")).alias("e"))
    return last.select(F.col("source").alias("_s"), F.col("e._at").alias("_b"), (F.col("e.room") - (F.col("e._after") - F.col("e._words"))).alias("room"))


def decisions(sizes: DataFrame, **how) -> DataFrame:
    """(source, class) -> certain copies, inclusion probability and the source's cut, from rows (source, size, class, u).

    The result has at most 64 rows a source, so that applying it is a join with a small table.
    """
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    goal = targets(sources, **how)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    shared = classes.join(goal, same(classes, goal)).drop(goal["source"])
    shared = _level(shared, ["source"], F.col("target"), F.col("class_size") * F.lit(how.get("most", MOST)), F.greatest("class_size", F.lit(1)) * (F.col("class") + F.lit(8)), "wanted")
    copies = F.when(F.col("class_size") > 0, F.least(F.col("wanted") / F.col("class_size"), F.lit(how.get("most", MOST)))).otherwise(F.lit(0.0))
    plan = shared.withColumn("_e", copies).withColumn("certain", F.floor("_e").cast("int")).withColumn("p", F.col("_e") - F.floor("_e")).drop("_e", "wanted")
    left = F.col("target") - F.sum(F.col("certain") * F.col("class_size")).over(Window.partitionBy("source"))
    plan = scratch(plan.withColumn("open", left), "mix-classes")  # small, and read by all that follows

    draws = sizes.where("size > 0")
    draws = draws.join(plan.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "p").where("p > 0"), draws["source"].eqNullSafe(F.col("_s")) & (draws["class"] == F.col("_c")))
    draws = draws.select("source", "size", _rank(F.col("u"), F.col("p")).alias("q")).withColumn("bucket", _bucket(F.col("q")))
    need = plan.groupBy(F.col("source").alias("_s")).agg(F.max("open").alias("room"))
    wide = scratch(_edge(draws, need, F.floor(F.col("bucket") / BUCKETS).cast("int")), "mix-wide")
    near = draws.join(wide.select("_s", "_b"), draws["source"].eqNullSafe(F.col("_s")) & (F.floor(draws["bucket"] / BUCKETS) == F.col("_b"))).drop("_s", "_b")
    edge = scratch(_edge(near, wide.select("_s", "room"), F.col("bucket")), "mix-edge")
    inside = near.join(edge, near["source"].eqNullSafe(F.col("_s")) & (near["bucket"] == F.col("_b")))
    step = Window.partitionBy("source").orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("source", "q")
    # the last rank whose words bring the source nearer to its target than leaving them out
    taken = inside.withColumn("_sum", F.sum("size").over(step)).withColumn("_tie", F.sum("size").over(ties)).where(F.col("_sum") - F.col("_tie") / F.lit(2.0) <= F.col("room"))
    last = taken.groupBy("source").agg(F.max("q").alias("cut_rank"))
    cut = edge.join(last, last["source"].eqNullSafe(F.col("_s")), "left").select("_s", F.col("_b").alias("cut_bucket"), "cut_rank")
    return plan.join(cut, plan["source"].eqNullSafe(F.col("_s")), "left").drop("_s", "open", "class_size")


def copies(u: Column) -> Column:
    """Copies of a row that has joined its row of `decisions`: the certain ones, and one more if it ranks before the cut."""
    q = _rank(u, F.col("p"))
    b = _bucket(q)
    drawn = (F.col("p") > 0) & ((b < F.col("cut_bucket")) | ((b == F.col("cut_bucket")) & (q <= F.col("cut_rank"))))
    return F.col("certain") + F.coalesce(drawn, F.lit(False)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    size = words(F.col("text"))
    return docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), uniform(F.col("doc_id"), F.col("source"), F.col("text")).alias("u")).withColumn("class", size_class(F.col("size")))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row. The texts are read once, for their sizes."""
    rows = scratch(sized(docs), "mix-sizes")
    plan = decisions(rows, **how).withColumnRenamed("source", "_s").withColumnRenamed("class", "_c")
    out = rows.join(plan, rows["source"].eqNullSafe(F.col("_s")) & (rows["class"] == F.col("_c")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.when(F.col("size") > 0, copies(F.col("u"))).otherwise(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, all its columns kept. Rows without words stay as they are."""
    rows = scratch(sized(docs), "mix-sizes")
    plan = decisions(rows, **how).select(F.col("source").alias("__mix_source"), F.col("class").alias("__mix_class"), F.struct("certain", "p", "cut_bucket", "cut_rank").alias("__mix"))
    plan = scratch(plan, "mix-plan")  # small: at most 64 rows a source
    size = words(F.col("text"))
    full = docs.withColumn("__mix_size", size).withColumn("__mix_of", size_class(F.col("__mix_size")))
    joined = full.join(plan, full["source"].eqNullSafe(F.col("__mix_source")) & (F.col("__mix_of") == F.col("__mix_class")), "left")
    p, u = F.col("__mix.p"), uniform(F.col("doc_id"), F.col("source"), F.col("text"))
    q = _rank(u, p)
    drawn = (p > 0) & ((_bucket(q) < F.col("__mix.cut_bucket")) | ((_bucket(q) == F.col("__mix.cut_bucket")) & (q <= F.col("__mix.cut_rank"))))
    n = F.when(F.col("__mix_size") > 0, F.col("__mix.certain") + F.coalesce(drawn, F.lit(False)).cast("int")).otherwise(F.lit(1))
    return joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"))


#: DuckDB SQL of op5_mixing.
OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), concat('null|', coalesce(source, ''), '|', coalesce(text, ''))))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sized AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM rows),
classes AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS class_size FROM sized GROUP BY ALL),
sources AS (SELECT source, CAST(sum(class_size) AS BIGINT) AS source_size FROM classes GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget, source_size * 2.0::DOUBLE AS cap FROM sources),
filled AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS lvl FROM ranked
  WINDOW o AS (ORDER BY cap / w, cap, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, CASE WHEN cap / w <= lvl THEN cap ELSE w * first(CASE WHEN cap / w > lvl THEN lvl END IGNORE NULLS) OVER (ORDER BY cap / w, cap, w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM filled),
c1 AS (SELECT c.source, c.class, c.class_size, g.source_size, g.target, c.class_size * 2.0::DOUBLE AS cap, (c.class_size * (c.class + 8))::BIGINT AS w
  FROM classes c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source),
c2 AS (SELECT *, (target - coalesce(sum(cap) OVER o, 0)) / nullif(sum(w) OVER (PARTITION BY source) - coalesce(sum(w) OVER o, 0), 0)::DOUBLE AS lvl, cap / nullif(w, 0)::DOUBLE AS ratio FROM c1
  WINDOW o AS (PARTITION BY source ORDER BY cap / nullif(w, 0)::DOUBLE NULLS FIRST, cap, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c3 AS (SELECT *, first(CASE WHEN ratio > lvl THEN lvl END IGNORE NULLS) OVER (PARTITION BY source ORDER BY ratio NULLS FIRST, cap, w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rest FROM c2),
c4 AS (SELECT *, CASE WHEN class_size > 0 THEN least(CASE WHEN ratio <= lvl THEN cap ELSE w * rest END / class_size, 2.0) ELSE 0.0 END AS e FROM c3),
plan AS (SELECT source, class, source_size, target, CAST(floor(e) AS BIGINT) AS certain, e - floor(e) AS p,
         target - sum(floor(e) * class_size) OVER (PARTITION BY source) AS open FROM c4),
draws AS (SELECT s.*, p.source_size, p.target, p.certain, p.p, p.open, CASE WHEN p.p > 0 THEN (u / (1.0::DOUBLE - u)) / (p.p / (1.0::DOUBLE - p.p)) END AS q
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source AND s.class = p.class),
summed AS (SELECT *, CASE WHEN q IS NOT NULL AND size > 0 THEN sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - sum(size) OVER (PARTITION BY source, q) / 2.0::DOUBLE END AS mid FROM draws)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN mid <= open THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM summed
"""
