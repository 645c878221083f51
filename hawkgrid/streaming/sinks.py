"""Micro-batch sinks: alert log with dead letters, merge-on-read, compaction, replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hawkgrid.operators import alerts as al
from hawkgrid.session import durable
from hawkgrid.sources.topic import TopicLog

# Hours that rows of each topic are kept.
RETENTION_HOURS = {"raw_traffic": 1, "security_alerts": 24, "incidents": 168, "dead_letter_events": 24}
_KEYS = ["tenant_id", "alert_id"]


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to a folder of its own; a retried batch replaces that folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def split_sink(good: Callable[[DataFrame], DataFrame], bad: Callable[[DataFrame], DataFrame],
               good_path: str, bad_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes accepted and rejected rows of one parsed batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        write_batch(good(batch), good_path, batch_id)
        write_batch(bad(batch), bad_path, batch_id)
        batch.unpersist()

    return sink


def alert_sink(alerts_path: str, dead_path: str, tenant_id: int) -> Callable[[DataFrame, int], None]:
    """Validate, keep the last row per alert id in the batch, stamp the tenant, append.

    Input: lines ``value`` with a unique ``offset``. The tenant comes from the sender's
    identity, never from the message. Nothing stored is read or rewritten here; readers
    merge by key, so the cost of a batch does not grow with the table.
    """

    def checked(batch: DataFrame) -> DataFrame:
        rows = al.parse_alerts(batch.select("value", "offset"))
        return rows.withColumn("errors", al.validation_errors(rows, F.col("_extra")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = checked(batch).persist()
        valid = rows.where(F.size("errors") == 0).drop("errors", "_extra", "_raw")
        stamped = valid.withColumn("tenant_id", F.lit(tenant_id).cast("bigint"))
        write_batch(al.last_per_key(stamped, _KEYS, ["offset"]), alerts_path, batch_id)
        write_batch(al.dead_letters(rows), dead_path, batch_id)
        rows.unpersist()

    return sink


def current_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each (tenant, alert id) of a log of batches."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return al.last_per_key(rows, _KEYS, ["batch", "offset"]).drop("batch", "offset")


class AlertTable:
    """Alerts as a compacted base and the batches since: a snapshot table on plain files.

    * ``batch=N`` folders below ``path``: what ``alert_sink`` writes.
    * ``base``: one row per (tenant, alert id), partitioned by tenant and by the day on which the alert was first stored; a later
      version stays in that partition, so an update never has to look elsewhere.
    * ``merged``: a row per compaction with the last batch in the base. Readers take the highest; a compaction that fails before
      its row is written is repeated with the same result.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._merged = f"{self.path}/merged"
        spark.createDataFrame([], "upto long").write.mode("ignore").parquet(self._merged)

    def upto(self) -> int:
        """The last batch in the base, -1 without one."""
        found = self.spark.read.schema("upto long").parquet(self._merged).agg(F.max("upto")).first()[0]
        return -1 if found is None else found

    def _newer(self, upto: int) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").where(F.col("batch") > upto)
        return al.last_per_key(rows, _KEYS, ["batch", "offset"])

    def _base(self, upto: int) -> DataFrame | None:
        return None if upto < 0 else self.spark.read.parquet(f"{self.path}/base")

    def read(self) -> DataFrame:
        """The newest version of each alert; only batches since the last compaction are ranked."""
        upto = self.upto()
        newer, base = self._newer(upto), self._base(upto)
        if base is not None:
            newer = base.drop("day").join(newer.select(*_KEYS), _KEYS, "left_anti").unionByName(newer, allowMissingColumns=True)
        return newer.drop("batch", "offset")

    def compact(self) -> int:
        """Merge the batches since the last compaction into the base; only partitions that they touch are written."""
        upto = self.upto()
        rows = durable(self._newer(upto))
        last = rows.agg(F.max("batch")).first()[0]
        if last is None:
            return upto
        day = F.date_format(F.to_timestamp("timestamp"), "yyyy-MM-dd")
        base = self._base(upto)
        if base is None:
            out = rows.withColumn("day", day)
        else:
            stored = base.select(*_KEYS, F.col("day").cast("string").alias("_day"))
            incoming = rows.join(stored, _KEYS, "left").withColumn("day", F.coalesce("_day", day)).drop("_day")
            incoming = durable(incoming)
            touched = incoming.select("tenant_id", "day").distinct()
            kept = base.withColumn("day", F.col("day").cast("string")).join(touched, ["tenant_id", "day"], "left_semi").join(
                incoming.select(*_KEYS), _KEYS, "left_anti")
            out = durable(kept.unionByName(incoming, allowMissingColumns=True))
        # Enough tasks for a tenant or day of any size: rows of a partition spread by their own ids.
        out = out.repartition(F.col("tenant_id"), F.col("day"), F.pmod(F.xxhash64("alert_id"), F.lit(8)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "day").parquet(f"{self.path}/base")
        self.spark.createDataFrame([(last,)], "upto long").coalesce(1).write.mode("append").parquet(self._merged)
        return last


def replay_to(spark: SparkSession, dead_lines: str, target: str, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Send the alerts of a dead-letter file through the input folder again, each marked as a replay.

    The mark is a field of the message, so it is there when the alert is parsed, stored and correlated. Returns what is (or, in
    a dry run, would be) sent.
    """
    found = al.replay_dead_letters(spark.read.text(dead_lines), limit)
    found = found.withColumn("value", al.as_replay(F.col("value")))
    if not dry_run:
        found.select("value").write.mode("append").text(target)
    return found


def apply_retention(path: str, topic: str, now_us: int) -> int:
    """Remove the entries of a topic folder whose rows are all older than the topic keeps them; returns how many."""
    return TopicLog(path).expire(now_us - RETENTION_HOURS[topic] * 3_600_000_000)
