"""Streams: pair counts merged batch by batch, and a pool that tracks the newest entry of a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.pairs import keep_newest, merge_pairs


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the Parquet files of a table: those of a folder, or the one file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if _status(spark, path).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", "".join(f"[{c}]" if c in "*?[]{}" else c for c in name)).parquet(folder)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _status(spark: SparkSession, path: str):
    p, fs = _fs(spark, path)
    return fs.getFileStatus(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


_STORE = "expected_card_id string, actual_card_id string, seen_count bigint, first_seen_utc timestamp, last_seen_utc timestamp"


def _part(parts: int):
    return F.pmod(F.xxhash64("expected_card_id", "actual_card_id"), F.lit(parts)).cast("int")


def _versions(spark: SparkSession, store: str) -> dict[int, list[int]]:
    """Of each part of the store the finished batches that wrote it, in order."""
    out: dict[int, list[int]] = {}
    for v in sorted(int(n[2:]) for n in _names(spark, store) if n.startswith("v=") and "_SUCCESS" in _names(spark, f"{store}/{n}")):
        for p in _names(spark, f"{store}/v={v}"):
            if p.startswith("part="):
                out.setdefault(int(p[5:]), []).append(v)
    return out


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(_STORE).parquet(*paths) if paths else spark.createDataFrame([], _STORE)


def count_pairs(events: DataFrame, store_path: str, checkpoint: str, parts: int = 16) -> None:
    """Merge (expected_card_id, actual_card_id, seen_at, seq) into the pair store, until no data is left.

    The store is kept in ``parts`` by a hash of the pair. A batch reads and writes only the parts it
    touches, from the version of an earlier batch to one of its own number; a repeated batch overwrites
    what it wrote, so every event counts once. The version before the last stays, older ones are removed.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        have = _versions(spark, store_path)
        touched = sorted(r.part for r in batch.select(_part(parts).alias("part")).distinct().collect())  # at most `parts` rows
        older = {p: [v for v in have.get(p, []) if v < number] for p in touched}
        store = _read(spark, [f"{store_path}/v={vs[-1]}/part={p}" for p, vs in older.items() if vs])
        merge_pairs(store, batch).withColumn("part", _part(parts)).write.mode("overwrite").partitionBy("part").parquet(f"{store_path}/v={number}")
        for part, vs in older.items():
            for v in vs[:-1]:
                p, fs = _fs(spark, f"{store_path}/v={v}/part={part}")
                fs.delete(p, True)

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_store(spark: SparkSession, store_path: str, most: int | None = None) -> DataFrame:
    """The pair store after the last batch; the ``most`` pairs seen last if given."""
    out = _read(spark, [f"{store_path}/v={vs[-1]}/part={p}" for p, vs in sorted(_versions(spark, store_path).items())])
    return out if most is None else keep_newest(out, most)


_POOL = "session string, name string, set_code string, collector_number string, fingerprint string, seq bigint, updates bigint"


def track_pool(events: DataFrame) -> DataFrame:
    """Stream of (session, name, set_code, collector_number, fingerprint, seq) to the tracked pool's updates.

    Of each card of a session the newest record holds; a record without a fingerprint keeps the one
    held before. The state is a fingerprint and two numbers a card.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seq, n = state.get if state.exists else (None, -1, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for f, s in zip(rows["fingerprint"], rows["seq"]):
            held = f if f is not None and f == f else held
            seq, n = max(seq, int(s)), n + 1
        state.update((held, seq, n))
        yield pd.DataFrame([(*key, held, seq, n)], columns=[c.split()[0] for c in _POOL.split(", ")])

    grouped = events.groupBy("session", "name", "set_code", "collector_number")
    return grouped.applyInPandasWithState(update, _POOL, "fingerprint string, seq bigint, updates bigint", "update", GroupStateTimeout.NoTimeout)


def pool_snapshot(events: DataFrame) -> DataFrame:
    """The pool after all of a batch of the same events, without state: the batch form of :func:`track_pool`."""
    key = ["session", "name", "set_code", "collector_number"]
    return events.groupBy(*key).agg(F.max_by("fingerprint", F.when(F.col("fingerprint").isNotNull(), F.col("seq"))).alias("fingerprint"), F.max("seq").alias("seq"), F.count("*").alias("updates"))
