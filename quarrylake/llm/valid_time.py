"""Valid-time sale enrichment: a stateful streaming query whose event-time timers release sales and prune versions.

Both tables are cut into batches, written to the shared folder and fed in order to one Structured Streaming query that is
started anew for each batch on one checkpoint. Each table has a watermark of its own, on a column that holds the table's
greatest timestamp so far: it is the same for all rows of a batch and so never late, and Spark's minimum policy makes the
smaller of both watermarks the horizon H. A sale whose sold_at lies before H goes out on arrival; any other waits in
state, and a timer set to its sold_at releases it in the batch in which H has passed it. The same timers prune, client by
client, the versions that H has passed, all but the last.

State is kept by bucket of clients, as columns, so that a Python call serves thousands of rows. A client that has 1 of 1024
rows or more (there are 1024 such at most, whatever the input) is cut by time into slices of six hours, which lie in
different buckets. A slice sees its own versions only. It writes what its neighbours need as it changes: how many versions
it took and pruned, its last version, and the one kept behind H. enriched() joins these few rows with the client's sales: a
sale without a version in its slice takes the last of the slices before; a version behind H counts only if it is the
last of all slices. Versions of earlier slices are never younger than the release of a sale (those that come later are late),
so that join needs no order of batches.

Defined cases: a sale without client has none to take from (n_held 0); a sale without sold_at goes out in its own batch
and takes nothing; a change without client can only be late; a change without valid_at is left out; repeated sales are sales
of their own; equal changes are one; rows without arrived_at or change_id fall into the last batch, days before the first
batch into the first; nulls of seq or change_id sort first, further ties are broken by op and balance; a null or NaN balance
gives null cents; other columns are not read; empty tables give no rows. Timestamps before 1970-01-02T12:00 set no
watermark. Times are counted in microseconds, whatever the session's time zone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import delete, read_table, shared_dir

BATCHES, FIRST_DAY, DAYS = 10, 19723, 152
DELAY_HOURS = 36
#: A client of this share of all rows is cut into slices of so many hours.
HEAVY_SHARE, SLICE_HOURS = 1024, 6
#: But not one of fewer rows than these.
LEAST_HEAVY = 64
#: Rows of both tables a bucket and batch.
BUCKET_ROWS = 4096
HOUR = 3_600_000_000
#: Stands for null in state: sorts before all.
NONE, NO_SLICE = -(2**63), -(2**31)
#: Marks of a table that has no timestamp yet: Spark's watermark stays at 0, which means none.
NO_MARK = 24 * HOUR

ROWS = "batch int, bucket long, kind string, client long, lone boolean, slice int, id long, at long, seq long, op string, cents long"
OUT = "rec string, id long, batch long, client long, slice int, at long, n_held long, m_at long, m_seq long, change_id long, cents long, op string, taken long, pruned long"
_OUT = [x.split()[0] for x in OUT.split(", ")]
_KEYS = ["client", "slice", "at", "seq", "id", "op", "cents"]

#: The rows of op13_sale_versions in one piece: batches, horizons and prunings in closed form, crc32 by its table.
OP13_SQL = """
WITH poly AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
c0 AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
c1 AS (SELECT c0.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS more FROM c0, poly),
c2 AS (SELECT *, greatest(0, least(9, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + more - 19723) * 10 / 152) AS BIGINT))) AS batch FROM c1),
s AS (SELECT *, greatest(0, least(9, CAST(floor((date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - 19723) * 10 / 152) AS BIGINT))) AS batch FROM sales),
b AS (SELECT b, (SELECT max(sold_at) FROM s WHERE batch < b) - INTERVAL 36 HOUR AS ws, (SELECT max(valid_at) FROM c2 WHERE batch < b) - INTERVAL 36 HOUR AS wc FROM range(11) r(b)),
h AS (SELECT b, wc, CASE WHEN ws IS NULL OR wc IS NULL THEN TIMESTAMP '0001-01-01' ELSE least(ws, wc) END AS h FROM b),
v AS (SELECT c2.*, c2.valid_at < h.wc AS late FROM c2 JOIN h ON h.b = c2.batch),
e AS (SELECT s.*, coalesce((SELECT min(h.b) FROM h WHERE h.b >= s.batch AND h.b < 10 AND (s.sold_at IS NULL OR s.sold_at < h.h)), 10) AS out FROM s),
p AS (SELECT row_number() OVER () AS n, e.*, coalesce((SELECT h.h FROM h WHERE h.b = e.out - 1), TIMESTAMP '0001-01-01') AS behind FROM e),
k AS (SELECT o.client_id, o.out, arg_max(row(v.change_id), row_number) AS kept FROM (SELECT DISTINCT client_id, out, behind FROM p) o
  JOIN (SELECT *, row_number() OVER (ORDER BY valid_at, seq NULLS FIRST, change_id NULLS FIRST, op NULLS FIRST, balance NULLS FIRST) AS row_number FROM v WHERE NOT coalesce(late, false)) v
  ON v.client_id = o.client_id AND v.batch < o.out AND v.valid_at <= o.behind GROUP BY ALL),
j AS (SELECT p.n, v.*, p.sold_at, p.behind, p.out, k.kept FROM p LEFT JOIN k ON k.client_id = p.client_id AND k.out = p.out
  JOIN v ON v.client_id = p.client_id AND v.batch <= p.out AND NOT coalesce(v.late, false)
  AND (v.valid_at > p.behind OR v.batch = p.out OR row(v.change_id) = k.kept)),
g AS (SELECT n, count(*) AS n_held FROM j GROUP BY n),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY valid_at DESC, seq DESC NULLS LAST, change_id DESC NULLS LAST, op DESC NULLS LAST, balance DESC NULLS LAST) AS r FROM j WHERE valid_at <= sold_at) WHERE r = 1)
SELECT 'sale' AS rec, p.sale_id AS id, p.out AS batch, coalesce(g.n_held, 0) AS n_held, m.change_id, CAST(floor(100 * m.balance + 0.5) AS BIGINT) AS balance_cents, m.op
FROM p LEFT JOIN g USING (n) LEFT JOIN m USING (n)
UNION ALL SELECT 'late', change_id, batch, NULL, NULL, NULL, NULL FROM v WHERE late
"""


def micros(at: Column) -> Column:
    """Microseconds of a timestamp without a zone since 1970."""
    at = at.cast("timestamp_ntz")
    day = F.unix_date(at.cast("date")).cast("long")
    return (((day * 24 + F.hour(at)) * 60 + F.minute(at)) * 60) * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def batch_number(at: Column, later: Column | None = None, batches: int = BATCHES) -> Column:
    """Of the day of a timestamp, moved by so many days."""
    day = F.unix_date(at.cast("date"))
    day = day if later is None else day + later
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - FIRST_DAY) * batches / DAYS).cast("int"))).cast("int")


def sale_rows(sales: DataFrame, batches: int = BATCHES) -> DataFrame:
    return sales.select(batch_number(F.col("arrived_at"), None, batches).alias("batch"), F.lit("sale").alias("kind"), F.col("client_id").cast("long").alias("client"), F.col("sale_id").cast("long").alias("id"), micros(F.col("sold_at")).alias("at"), F.lit(NONE).alias("seq"), F.lit(None).cast("string").alias("op"), F.lit(NONE).alias("cents"))


def change_rows(changes: DataFrame, batches: int = BATCHES) -> DataFrame:
    c = changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").where("valid_at is not null").distinct()
    cents = F.when(F.col("balance").isNotNull() & ~F.isnan("balance"), F.floor(F.col("balance") * 100 + 0.5).cast("long"))
    batch = batch_number(F.col("valid_at"), (F.crc32(F.col("change_id").cast("string")) % 4).cast("int"), batches)
    orders = [F.coalesce(x, F.lit(NONE)) for x in (F.col("seq").cast("long"), F.col("change_id").cast("long"), cents)]
    return c.select(batch.alias("batch"), F.lit("change").alias("kind"), F.col("client_id").cast("long").alias("client"), orders[1].alias("id"), micros(F.col("valid_at")).alias("at"), orders[0].alias("seq"), "op", orders[2].alias("cents"))


def _placed(rows: DataFrame, heavy: list[int], buckets: int) -> DataFrame:
    """rows with their bucket; slices of heavy clients lie in different ones, and so do rows without client."""
    sliced = F.col("client").isin(heavy) if heavy else F.lit(False)
    by_time = F.floor(F.col("at") / (SLICE_HOURS * HOUR)).cast("int")
    cut = F.when(F.coalesce(sliced, F.lit(False)), F.coalesce(by_time, -1 - F.pmod(F.col("id"), F.lit(16)).cast("int"))).otherwise(NO_SLICE)
    rows = rows.withColumn("lone", F.col("client").isNull()).withColumn("slice", cut.cast("int"))
    key = F.when(F.col("lone"), F.xxhash64("id")).otherwise(F.xxhash64("client", "slice"))
    rows = rows.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("long")).withColumn("client", F.coalesce("client", F.lit(0))).withColumn("at", F.coalesce("at", F.lit(NONE)))
    return rows.select(*[x.split()[0] for x in ROWS.split(", ")])


def _match(sales: pd.DataFrame, versions: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each sale: the place of the last version of its client and slice at its time or before (-1: none), and the number of versions there."""
    m, n = len(versions), len(sales)
    both = [np.concatenate([versions[k].to_numpy(), sales[k].to_numpy()]) for k in ("client", "slice", "at")]
    order = np.lexsort((np.concatenate([np.arange(m), np.zeros(n, np.int64)]), np.arange(m + n) >= m, both[2], both[1], both[0]))
    client, cut = both[0][order], both[1][order]
    starts = np.flatnonzero(np.concatenate([[True], (client[1:] != client[:-1]) | (cut[1:] != cut[:-1])]))
    sizes = np.diff(np.append(starts, m + n))
    version = order < m
    last = np.maximum.accumulate(np.where(version, np.arange(m + n), -1))
    found = np.where(last >= np.repeat(starts, sizes), order[np.maximum(last, 0)], -1)
    held = np.repeat(np.add.reduceat(version.astype(np.int64), starts), sizes)
    at, number = np.empty(n, np.int64), np.empty(n, np.int64)
    at[order[~version] - m], number[order[~version] - m] = found[~version], held[~version]
    lone = sales["lone"].to_numpy()
    return np.where(lone, -1, at), np.where(lone, 0, number)


def _pruned(versions: pd.DataFrame, horizon: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Versions without those at the horizon or before, all but the last of their client (and slice); and a row for each slice that changed."""
    if versions.empty:
        return versions, pd.DataFrame(columns=_OUT)
    due = (versions["at"] <= horizon).to_numpy()
    client, cut = versions["client"].to_numpy(), versions["slice"].to_numpy()
    follows = np.append((client[1:] == client[:-1]) & (cut[1:] == cut[:-1]) & due[1:], False)
    drop = due & follows
    news = due & ~drop & ~versions["kept"].to_numpy() & (cut != NO_SLICE)
    told = pd.DataFrame(columns=_OUT)
    if news.any():
        before = np.cumsum(drop)
        group = np.maximum.accumulate(np.where(np.append(True, (client[1:] != client[:-1]) | (cut[1:] != cut[:-1])), np.arange(len(cut)), 0))
        kept = versions[news]
        told = pd.DataFrame({"rec": "kept", "client": kept["client"], "slice": kept["slice"], "m_at": kept["at"], "m_seq": kept["seq"], "change_id": kept["id"], "cents": kept["cents"], "op": kept["op"], "pruned": (before - (before - drop)[group])[news]})
    versions = versions[~drop].reset_index(drop=True)
    versions["kept"] = (versions["at"] <= horizon).to_numpy()
    return versions, told


class SaleClerk:
    """Versions and waiting sales of the clients of a bucket, one call a batch: with its new rows, or because its timer has run out. batch: its number; rest: microseconds of H below Spark's millisecond."""

    STATE = "versions binary, waiting binary"

    def __init__(self, batch: int, rest: int):
        self.batch, self.rest = batch, rest

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        horizon = mark * 1000 + self.rest if mark > 0 else NONE
        new = None if state.hasTimedOut else pd.concat(list(frames), ignore_index=True)
        versions, waiting, out = self.step(new, *self._load(state), horizon)
        state.update((_pack(versions), _pack(waiting)))
        times = [x.min() for x in (waiting["at"], versions["at"][~versions["kept"]]) if len(x)]
        if times:  # Spark calls when its watermark is beyond that time
            state.setTimeoutTimestamp(max(int(min(times)) // 1000 - 1, mark + 1))
        out = [p.assign(batch=self.batch).reindex(columns=_OUT) for p in out if len(p)]
        if out:
            yield pd.concat(out, ignore_index=True).astype({c: "Int64" for c in _OUT if c not in ("rec", "op")})

    @staticmethod
    def _load(state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame]:
        if state.exists:
            versions, waiting = state.get
            return _unpack(versions), _unpack(waiting)
        return pd.DataFrame({k: pd.Series(dtype=object if k == "op" else "int64") for k in _KEYS} | {"kept": pd.Series(dtype=bool)}), pd.DataFrame({k: pd.Series(dtype="int64") for k in ("client", "slice", "id", "at")} | {"lone": pd.Series(dtype=bool)})

    def step(self, new: pd.DataFrame | None, versions: pd.DataFrame, waiting: pd.DataFrame, horizon: int) -> tuple[pd.DataFrame, pd.DataFrame, list[pd.DataFrame]]:
        """A batch: late changes, then versions, then sales whose time has come, then pruning."""
        out, flush = [], False
        if new is not None:
            flush = (new["kind"] == "flush").any()
            out.append(pd.DataFrame({"rec": "late", "id": new["id"][new["kind"] == "late"]}))
            fresh = new[(new["kind"] == "change") & ~new["lone"].astype(bool)]
            if len(fresh):
                versions = _joint(versions, fresh[_KEYS].assign(kept=False)).sort_values(_KEYS, na_position="first", ignore_index=True)
                cut = fresh[fresh["slice"] != NO_SLICE]
                taken = cut.groupby(["client", "slice"], as_index=False).size().rename(columns={"size": "taken"})
                last = versions.drop_duplicates(["client", "slice"], keep="last").rename(columns={"at": "m_at", "seq": "m_seq", "id": "change_id"})
                out.append(taken.merge(last, on=["client", "slice"]).assign(rec="taken"))
            waiting = _joint(waiting, new[new["kind"] == "sale"][waiting.columns])
        goes = (waiting["at"] < horizon) | (waiting["at"] == NONE) | flush
        if goes.any():
            out.append(_sold(waiting[goes], versions))
            waiting = waiting[~goes].reset_index(drop=True)
        versions, told = _pruned(versions, horizon)
        return versions, waiting, [*out, told]


def _joint(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([x for x in (a, b) if len(x)] or [a], ignore_index=True)


def _pack(x: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, (t := pa.Table.from_pandas(x, preserve_index=False)).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _sold(sales: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
    place, held = _match(sales, versions)
    got = versions.take(np.maximum(place, 0)).reset_index(drop=True) if len(versions) else pd.DataFrame({k: [None] * len(sales) for k in _KEYS})
    got = got[["at", "seq", "id", "cents", "op"]].astype(object)
    got[place < 0] = None
    return pd.DataFrame({"rec": "sale", "id": sales["id"].to_numpy(), "client": sales["client"].to_numpy(), "slice": sales["slice"].to_numpy(), "at": sales["at"].to_numpy(), "n_held": held, "m_at": got["at"], "m_seq": got["seq"], "change_id": got["id"], "cents": got["cents"], "op": got["op"]})


@contextmanager
def _settings(spark: SparkSession, **settings: str):
    """These settings while the stream runs, the session's own afterwards."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _marker(ids: DataFrame, kind: str, batch: Column, bucket: Column) -> DataFrame:
    """Rows that are no sale and no change."""
    fixed = {"batch": batch, "bucket": bucket, "kind": F.lit(kind), "lone": F.lit(True), "slice": F.lit(NO_SLICE), "op": F.lit(None)}
    return ids.select(*[fixed.get(n, F.lit(0)).cast(t).alias(n) for n, t in (x.split() for x in ROWS.split(", "))])


def _feed(spark: SparkSession, path: str, to: str) -> None:
    """A batch's folder under the stream's; the last batch has no changes."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(source):
        fs.rename(source, target)


def _marks(spark: SparkSession, path: str, batches: int) -> list[int]:
    """A table's greatest timestamp up to each batch: a row a batch comes to the driver."""
    most = {r["batch"]: r["most"] for r in spark.read.schema(ROWS).parquet(path).where(F.col("at") != NONE).groupBy("batch").agg(F.max("at").alias("most")).collect()}
    out, top = [], NO_MARK
    for b in range(batches):
        top = max(top, most.get(b, NONE))
        out.append(top)
    return out


def horizons(sale_marks: list[int], change_marks: list[int], delay_hours: int = DELAY_HOURS) -> list[int]:
    """H of each batch and of the end, NONE where a table has no watermark yet."""
    after = [min(a, b) - delay_hours * HOUR for a, b in zip(sale_marks, change_marks)]
    return [NONE] + [h if h >= 1000 else NONE for h in after]


def enriched(sales: DataFrame, changes: DataFrame, batches: int = BATCHES, delay_hours: int = DELAY_HOURS, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """rec, id, batch, n_held, change_id, balance_cents, op: a row for each sale and each late change."""
    spark = sales.sparkSession
    root = f"{shared_dir(spark)}/valid-time/{uuid.uuid4().hex}"
    tables = {"sales": sale_rows(sales, batches), "changes": change_rows(changes, batches)}
    counted = tables["sales"].select("client").unionByName(tables["changes"].select("client"))
    per_client = counted.groupBy("client").count()
    total = sales.count() + changes.count()
    heavy = [r["client"] for r in per_client.where((F.col("client").isNotNull()) & (F.col("count") * heavy_share >= total) & (F.col("count") >= LEAST_HEAVY)).select("client").collect()]
    buckets = max(8, total // batches // BUCKET_ROWS)
    ticks = _marker(spark.range(batches), "tick", F.col("id"), F.lit(0))  # so that each table has a row, and its mark, in each batch
    for name, rows in tables.items():
        placed = _placed(rows, heavy, buckets)
        if name == "changes":  # after the shuffle of distinct: few files a batch
            placed = placed.repartition(max(8, buckets // 8), "batch", F.pmod("bucket", F.lit(8)))
        placed.unionByName(ticks).write.partitionBy("batch").parquet(f"{root}/staged/{name}")
    marks = {name: _marks(spark, f"{root}/staged/{name}", batches) for name in tables}
    limits = horizons(marks["sales"], marks["changes"], delay_hours)
    _marker(spark.range(buckets), "flush", F.lit(batches), F.col("id")).drop("batch").write.parquet(f"{root}/staged/sales/batch={batches}")
    partitions = str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets))  # no more state stores than buckets
    with _settings(spark, spark__sql__streaming__noDataMicroBatches__enabled="false", spark__sql__streaming__multipleWatermarkPolicy="min", spark__sql__shuffle__partitions=partitions):
        for b in range(batches + 1):
            for name in tables:
                _feed(spark, f"{root}/staged/{name}/batch={b}", f"{root}/in/{name}/batch={b}")
            _run(spark, root, b, {n: m[: b + 1] for n, m in marks.items()}, limits[b], delay_hours)
    out = spark.read.schema(OUT).parquet(f"{root}/out")
    for part in ("staged", "in", "checkpoint"):
        delete(spark, f"{root}/{part}")
    return _joined(out, limits)


def _run(spark: SparkSession, root: str, batch: int, marks: dict[str, list[int]], horizon: int, delay_hours: int) -> None:
    """One start of the query: takes what is new in the folders of both tables."""
    parts = []
    for name, most in marks.items():
        mark = F.timestamp_micros(F.element_at(F.array(*[F.lit(x) for x in [*most, most[-1]]]), F.col("batch") + 1))
        rows = spark.readStream.schema(ROWS).parquet(f"{root}/in/{name}").withColumn("mark", mark).withWatermark("mark", f"{delay_hours} hours")
        if name == "changes":
            before = F.element_at(F.array(*[F.lit(x - delay_hours * HOUR if x > NO_MARK else NONE) for x in [NO_MARK, *most]]), F.col("batch") + 1)
            rows = rows.withColumn("kind", F.when((F.col("kind") == "change") & (F.col("at") < before), "late").otherwise(F.col("kind")))
        parts.append(rows)
    both = parts[0].unionByName(parts[1])
    clerk = SaleClerk(batch, horizon % 1000 if horizon != NONE else 0)
    told = both.groupBy("bucket").applyInPandasWithState(clerk.__call__, OUT, SaleClerk.STATE, "append", GroupStateTimeout.EventTimeTimeout)
    told.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _joined(out: DataFrame, limits: list[int]) -> DataFrame:
    """Rows of whole clients as they are; sales of sliced clients with what the other slices told."""
    as_null = lambda c: F.when(F.col(c) != NONE, F.col(c))
    final = ["rec", as_null("id").alias("id"), F.col("batch").cast("long").alias("batch"), "n_held", as_null("change_id").alias("change_id"), as_null("cents").alias("balance_cents"), "op"]
    whole = out.where((F.col("rec") == "late") | (F.col("rec") == "sale") & (F.col("slice") == NO_SLICE))
    sold = out.where((F.col("rec") == "sale") & (F.col("slice") != NO_SLICE))
    told = out.where(F.col("rec").isin("taken", "kept")).withColumn("v", F.struct("m_at", "m_seq", "change_id", "op", "cents"))
    # of each slice the last version of the slices before it; a client has four slices a day
    last = told.where("rec = 'taken'").groupBy("client", "slice").agg(F.max("v").alias("last"))
    slices = sold.select("client", "slice").distinct().join(last, ["client", "slice"], "full")
    carried = slices.select("client", "slice", F.max("last").over(Window.partitionBy("client").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # of each client and batch what is held then, and the version kept behind the horizon of the batch before
    sums = told.groupBy("client", "batch").agg(F.sum("taken").alias("taken"), F.sum("pruned").alias("pruned"), F.max(F.when(F.col("rec") == "kept", F.col("v"))).alias("kept"), F.collect_set(F.when(F.col("rec") == "kept", F.col("slice"))).alias("cuts"))
    batches = sums.select("client").distinct().select("client", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(limits) - 1).cast("long"))).alias("batch"))
    to_now = Window.partitionBy("client").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("client").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("cuts", F.array().cast("array<int>"))).over(before))))
    taken, pruned = F.coalesce(F.sum("taken").over(to_now), F.lit(0)), F.coalesce(F.sum("pruned").over(before), F.lit(0))
    state = batches.join(sums, ["client", "batch"], "left").select("client", "batch", (taken - pruned - F.greatest(cuts - 1, F.lit(0))).alias("held"), F.max("kept").over(before).alias("kept"))
    behind = F.element_at(F.array(*[F.lit(h) for h in [NONE, *limits]]), (F.col("batch") + 1).cast("int"))
    found = F.when(F.col("m_at").isNotNull(), F.struct("m_at", "m_seq", "change_id", "op", "cents")).when(F.col("at") != NONE, F.col("carried"))
    sold = sold.join(carried, ["client", "slice"], "left").join(state, ["client", "batch"], "left").withColumn("v", found)
    sold = sold.withColumn("v", F.when((F.col("v.m_at") > behind) | (F.col("v") == F.col("kept")), F.col("v")))
    cut = sold.select("rec", "id", "batch", F.coalesce("held", F.lit(0)).cast("long").alias("n_held"), F.col("v.change_id").alias("change_id"), F.col("v.cents").alias("cents"), F.col("v.op").alias("op"))
    return whole.select(*final).unionByName(cut.select(*final))


def op13_sale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales with their client's version at the time of sale, and all late changes."""
    return enriched(read_table(spark, sf_dir, "sales"), read_table(spark, sf_dir, "client_changes"))
