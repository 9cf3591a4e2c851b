"""Streams of product rows: merged into the current table batch by batch, and watched for price changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfwise.operators import catalogue
from shelfwise.schema import KEY
from shelfwise.sources import sinks
from shelfwise.sources.versions import VersionedTable


def merge_batch(table: VersionedTable, history: sinks.DayHistory, schema: str, history_schema: str, quarantine: str | None = None, points: str = "all") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the newest row of each key goes into the table unless the stored one
    is newer, empty rich fields keep what is stored, and price points go into the history.

    All writes are keyed, so a batch that runs again changes nothing. ``points``: ``all`` observations, or
    ``changes`` only; they are appended, never written anew. With ``quarantine`` a batch that fails is
    written there and the stream goes on; ``merge_quarantine`` merges such batches later.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.where("coalesce(product_id, '') <> ''")
            order = [c for c in ("scraped_at", "ord") if c in rows.columns]
            stored = table.read(schema)
            newest = catalogue.latest_per_key(rows, KEY, order).drop(*[c for c in rows.columns if c not in stored.columns])
            old = stored.select(*KEY, F.col("scraped_at").alias("old_at"))
            fresh = newest.join(old, list(KEY), "left").where("old_at IS NULL OR scraped_at >= old_at").drop("old_at")
            table.write(catalogue.upsert(stored, catalogue.preserve_rich_fields(fresh, stored)))
            seen = rows if points == "all" else catalogue.price_changes(rows, order)
            history.add(catalogue.history_rows(seen), history_schema)
        except Exception:
            if quarantine is None:
                raise
            batch.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        finally:
            batch.unpersist()

    return merge


def merge_parts(table: str, history: str, schema: str, history_schema: str, buckets: int = sinks.BUCKETS, period: str = "day") -> Callable[[DataFrame, int], None]:
    """As ``merge_batch`` for a table of keyed parts and a history by day, given by their paths: a batch reads
    and writes only the parts and days that it has rows of, however large the table is."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        try:
            rows = batch.where("coalesce(product_id, '') <> ''")
            order = [c for c in ("scraped_at", "ord") if c in rows.columns]
            names = [f.name for f in T._parse_datatype_string(schema).fields]
            newest = catalogue.latest_per_key(rows, KEY, order).select([c for c in rows.columns if c in names])
            old = sinks.touched_parts(sinks.read_parts(spark, table, schema), newest, buckets).select(*KEY, F.col("scraped_at").alias("old_at"))
            fresh = newest.join(old, list(KEY), "left").where("old_at IS NULL OR scraped_at >= old_at").drop("old_at")
            sinks.upsert_parts(spark, table, fresh, schema, buckets)
            points = [f.name for f in T._parse_datatype_string(history_schema).fields]
            sinks.append_days(spark, history, catalogue.history_rows(rows).select([c for c in points if c in rows.columns]), history_schema, period=period)
        finally:
            batch.unpersist()

    return merge


def merge_quarantine(spark: SparkSession, merge: Callable[[DataFrame, int], None], quarantine: str) -> int:
    """Merge the batches that were set aside, in their order, and take them away; returns their number. A
    batch that fails again is an error, and it and those after it stay."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(quarantine)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")) if fs.exists(root) else []
    for batch_id in found:
        merge(spark.read.parquet(f"{quarantine}/batch={batch_id}"), batch_id)
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{quarantine}/batch={batch_id}"), True)
    return len(found)


def run_to_end(source: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there in micro-batches, then stop; the next call goes on from there."""
    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def landing(spark: SparkSession, folder: str, schema: str, max_files: int = 1000, kind: str = "parquet", **options) -> DataFrame:
    """A stream over files that land in a folder."""
    return spark.readStream.format(kind).schema(schema).options(maxFilesPerTrigger=max_files, **options).load(folder)


def close_stream(table: VersionedTable, schema: str, runs: DataFrame, site: str, run_id: str, now, failures: int, complete: bool, threshold: int = 3) -> DataFrame:
    """The run log after a stream has ended: partial with failures, else success; only after a whole and
    clean sweep are missing products aged, once for a run."""
    if complete and not failures:
        table.write(catalogue.age_missing_once(table.read(schema), runs, site, run_id, threshold))
    return catalogue.close_run(runs, run_id, "partial" if failures or not complete else "success", now, failures=failures)


_OUT = "site string, product_id string, ord long, scraped_at timestamp, selling_price double, in_stock boolean"
_STATE = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("ord", T.LongType()), T.StructField("selling_price", T.DoubleType()), T.StructField("in_stock", T.BooleanType())])


class PriceChanges(StatefulProcessor):
    """A product's last observation as value state; a batch's rows are compared with the one before at once."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["scraped_at", "ord"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        if last is not None:  # what is older than the last row is no change
            at = pd.Timestamp(last[0])
            seen = seen[(seen["scraped_at"] > at) | (seen["scraped_at"] == at) & (seen["ord"] > last[1])]
        if not len(seen):
            return
        now = seen[_STATE.names[2:]].astype({"selling_price": "Float64", "in_stock": "boolean"})
        before = now.shift(1)
        if last is not None:
            before.iloc[0] = [pd.NA if v is None else v for v in last[2:]]
        same = ((now == before).fillna(False) | (now.isna() & before.isna())).all(axis=1).to_numpy(dtype=bool, copy=True)
        same[0] &= last is not None
        end = seen.iloc[-1]
        values = [None if pd.isna(v) else v for v in now.iloc[-1]]
        self.last.update((end["scraped_at"].to_pydatetime(), int(end["ord"]), *(None if v is None else kind(v) for v, kind in zip(values, (float, bool)))))
        changed = seen[~same]
        if len(changed):
            yield changed.assign(site=key[0], product_id=key[1])[[c.split()[0] for c in _OUT.split(", ")]]

    def close(self) -> None:
        pass


#: State that grows with the products is kept on the executors' disks, with checkpoints of what changed.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def price_change_stream(observations: DataFrame, ttl_hours: float | None = None) -> DataFrame:
    """Observations (site, product_id, ord, scraped_at, selling_price, in_stock) whose price or stock differs
    from the product's last one, kept as state; the state is one row for each product. Rows that are older
    than the last one seen, by time and then ``ord``, are no changes. With ``ttl_hours`` a product that has
    not been seen for so long is forgotten, and its next observation counts as its first."""
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = PriceChanges(int(ttl_hours * 3_600_000) if ttl_hours else None)
    return observations.groupBy(*KEY).transformWithStateInPandas(processor, _OUT, "append", "processingTime" if ttl_hours else "none")
