"""What changed between full snapshots, by bitmaps over persistent ordinals.

Every key gets an ordinal that it keeps: its bucket (a hash, so that buckets are even) times 2**32
plus a running number within the bucket. A snapshot's keys in a bucket are then a bitmap held as
compressed containers of 2**16 ordinals, and each watched column is a vector aligned to the ordinals
in it. Additions and removals are AND-NOT of two bitmaps, changes the places where the vectors of
the common ordinals differ. A bucket holds all snapshots' rows of its keys, so after the one
exchange by bucket nothing is shuffled again: neither to number the keys nor to name them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Containers with at most this many members are stored as sorted arrays, else as bits.
ARRAY_MAX = 4096


class Bitmap:
    """Set of non-negative numbers below 2**32 in containers of 2**16, each an array or bits."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, members: np.ndarray) -> Bitmap:
        members = np.unique(np.asarray(members, dtype=np.uint32))
        high = members >> 16
        out = {}
        for h in np.unique(high):
            low = (members[high == h] & 0xFFFF).astype(np.uint16)
            out[int(h)] = cls._pack(low)
        return cls(out)

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= ARRAY_MAX:
            return low
        bits = np.zeros(1 << 16, dtype=bool)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _bits(c: np.ndarray) -> np.ndarray:
        if c.dtype == np.uint8:
            return np.unpackbits(c).view(bool)
        bits = np.zeros(1 << 16, dtype=bool)
        bits[c] = True
        return bits

    def _with(self, other: Bitmap, keep) -> Bitmap:
        out = {}
        for h, a in self.containers.items():
            b = other.containers.get(h)
            low = keep(a, b)
            if len(low):
                out[h] = self._pack(low)
        return Bitmap(out)

    def _low(self, c: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self._bits(c)).astype(np.uint16) if c.dtype == np.uint8 else c

    def and_not(self, other: Bitmap) -> Bitmap:
        def keep(a, b):
            if b is None:
                return self._low(a)
            if a.dtype == np.uint16 and b.dtype == np.uint16:
                return np.setdiff1d(a, b, assume_unique=True)
            return np.flatnonzero(self._bits(a) & ~self._bits(b)).astype(np.uint16)

        return self._with(other, keep)

    def and_(self, other: Bitmap) -> Bitmap:
        def keep(a, b):
            if b is None:
                return np.empty(0, np.uint16)
            if a.dtype == np.uint16 and b.dtype == np.uint16:
                return np.intersect1d(a, b, assume_unique=True)
            return np.flatnonzero(self._bits(a) & self._bits(b)).astype(np.uint16)

        return self._with(other, keep)

    def members(self) -> np.ndarray:
        parts = [self._low(c).astype(np.uint32) | np.uint32(h << 16) for h, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def __len__(self) -> int:
        return sum(int(np.unpackbits(c).sum()) if c.dtype == np.uint8 else len(c) for c in self.containers.values())


def compare_bucket(rows: pd.DataFrame, known: pd.DataFrame | None, order: list, vectors: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Changes within a bucket, and the bucket's ordinals including new ones.

    ``rows`` has snapshot, key and the vectors, one row a snapshot and key. ``known`` has key and
    ordinal from earlier runs: those stay, new keys are numbered on from there.
    """
    keys = pd.Index(known["key"]) if known is not None and len(known) else pd.Index([], dtype=object)
    start = int(known["ordinal"].max()) + 1 if len(keys) else 0
    held = known["ordinal"].to_numpy(np.int64) if len(keys) else np.empty(0, np.int64)
    fresh = pd.Index(np.sort(rows["key"].unique().astype(object))).difference(keys, sort=True)
    keys = keys.append(fresh)
    ordinals = np.concatenate([held, np.arange(start, start + len(fresh), dtype=np.int64)])
    names = pd.Series(np.asarray(keys, dtype=object), index=ordinals)
    at = ordinals[keys.get_indexer(rows["key"])] if len(rows) else np.empty(0, np.int64)
    maps, cols = {}, {}
    snapshot = rows["snapshot"].to_numpy()
    for s in order:
        here = np.flatnonzero(snapshot == s)
        here = here[np.argsort(at[here], kind="stable")]
        maps[s] = Bitmap.of(at[here])
        cols[s] = (at[here], [rows[v].to_numpy()[here] for v in vectors])
    out = []
    for old, new in zip(order, order[1:]):
        for change, found in (("added", maps[new].and_not(maps[old])), ("removed", maps[old].and_not(maps[new]))):
            out += [(new, names[o], change) for o in found.members().astype(np.int64)]
        both = maps[old].and_(maps[new]).members().astype(np.int64)
        a, b = np.searchsorted(cols[old][0], both), np.searchsorted(cols[new][0], both)
        differs = np.zeros(len(both), dtype=bool)
        for x, y in zip(cols[old][1], cols[new][1]):
            differs |= x[a] != y[b]
        out += [(new, names[o], "changed") for o in both[differs]]
    return pd.DataFrame(out, columns=["snapshot", "key", "change"]), pd.DataFrame({"key": names.to_numpy(), "ordinal": names.index.to_numpy(np.int64)})


def snapshot_changes(snapshots: DataFrame, snapshot: str, key: str, version: str, watched: dict[str, Column], ordinals: DataFrame | None = None, per_bucket: int = 50_000) -> DataFrame:
    """(snapshot, key, change) between consecutive delivered snapshots.

    Within a snapshot the row with the greatest ``version`` holds for a key (rows without one come
    last, of rows with the same the one whose watched values are greatest). ``watched`` maps names
    to the values whose difference is a change; null counts as empty. Values are compared by two
    independent 64-bit hashes, so the vectors have a fixed width however long the texts are. Rows
    without a snapshot or a key are left out; a snapshot that is empty or the only one gives no
    row. ``ordinals`` (buckets, bucket, key, ordinal, from :func:`snapshot_ordinals`) has the numbers of
    all keys and the number of buckets that they were made with; without it keys are numbered afresh.
    """
    rows, order, buckets = _bucketed(snapshots, snapshot, key, version, watched, per_bucket, ordinals)
    vectors = [c for c in rows.columns if c.startswith("v_")]
    kind, key_kind = snapshots.schema[snapshot].dataType.simpleString(), snapshots.schema[key].dataType.simpleString()
    schema = f"snapshot {kind}, key {key_kind}, change string"

    def alone(part: pd.DataFrame) -> pd.DataFrame:
        return compare_bucket(part, None, order, vectors)[0]

    def with_known(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return compare_bucket(part, known, order, vectors)[0]

    if ordinals is None:
        return rows.groupBy("bucket").applyInPandas(alone, schema)
    return rows.groupBy("bucket").cogroup(ordinals.select("bucket", "key", "ordinal").groupBy("bucket")).applyInPandas(with_known, schema)


def buckets_of(ordinals: DataFrame) -> int:
    """Number of buckets that stored ordinals were made with; 0 of an empty table."""
    return ordinals.agg(F.max("buckets")).first()[0] or 0


def snapshot_ordinals(snapshots: DataFrame, snapshot: str, key: str, per_bucket: int = 50_000, known: DataFrame | None = None) -> DataFrame:
    """(buckets, bucket, key, ordinal): every key's ordinal, known ones kept and new ones numbered on.

    The number of buckets is kept as well. Where the rows outgrow the buckets four times, each bucket is
    split in two until they fit; a key then keeps its ordinal within the half it falls into. Ordinals are
    unique within a bucket; rows without a snapshot or key are left out.
    """
    key_kind = snapshots.schema[key].dataType.simpleString()
    given = snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    rows = given.count()
    buckets = buckets_of(known) if known is not None else 0
    buckets = buckets or max(1, -(-rows // per_bucket))
    while rows > 4 * per_bucket * buckets:
        buckets *= 2
    keys = given.select(F.col(key).alias("key")).distinct().withColumn("bucket", _bucket(F.col("key"), buckets)).withColumn("snapshot", F.lit(0))

    def number(part: pd.DataFrame, old: pd.DataFrame | None) -> pd.DataFrame:
        out = compare_bucket(part, old, [0], [])[1]
        source = part if len(part) else old
        return out.assign(bucket=int(source["bucket"].iloc[0]), buckets=buckets)[["buckets", "bucket", "key", "ordinal"]]

    schema = f"buckets int, bucket int, key {key_kind}, ordinal bigint"
    if known is None:
        return keys.groupBy("bucket").applyInPandas(lambda part: number(part, None), schema)
    old = known.select("key", "ordinal", _bucket(F.col("key"), buckets).alias("bucket"))
    return keys.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(number, schema)


def kept_ordinals(snapshots: DataFrame, snapshot: str, key: str, store: str, per_bucket: int = 50_000) -> DataFrame:
    """Ordinals from the folder ``store``, brought up to date there with the keys of ``snapshots``.

    Each run writes a version of its own and older ones are removed, so a reader finds a whole one.
    """
    spark = snapshots.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda n: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/v={n}")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    versions = sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS")))
    known = spark.read.parquet(f"{store}/v={versions[-1]}") if versions else None
    new = versions[-1] + 1 if versions else 0
    snapshot_ordinals(snapshots, snapshot, key, per_bucket, known).write.mode("overwrite").parquet(f"{store}/v={new}")
    for old in versions[:-1]:  # the one before stays for readers that have begun
        fs.delete(at(old), True)
    return spark.read.parquet(f"{store}/v={new}")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bucketed(snapshots: DataFrame, snapshot: str, key: str, version: str, watched: dict[str, Column], per_bucket: int, ordinals: DataFrame | None):
    """Rows with bucket, snapshot, key and hash vectors, one a snapshot and key; the snapshots in order."""
    given = snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
    seen = given.groupBy(snapshot).agg(F.count("*").alias("n")).orderBy(snapshot).collect()  # one row a snapshot
    order = [r[0] for r in seen]
    buckets = (buckets_of(ordinals) if ordinals is not None else 0) or max(1, -(-sum(r["n"] for r in seen) // per_bucket))
    hashes = []
    for i, value in enumerate(watched.values()):
        v = F.coalesce(value.cast("string"), F.lit(""))
        hashes += [F.xxhash64(v).alias(f"v_{i}a"), F.xxhash64(F.lit(i + 1), v, F.lit("~")).alias(f"v_{i}b")]
    rows = given.select(F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.col(version).alias("version"), *hashes)
    vectors = [c for c in rows.columns if c.startswith("v_")]
    latest = F.max(F.struct("version", *vectors)).alias("last")
    rows = rows.groupBy("snapshot", "key").agg(latest).select("snapshot", "key", *(F.col(f"last.{v}").alias(v) for v in vectors))
    return rows.withColumn("bucket", _bucket(F.col("key"), buckets)), order, buckets
