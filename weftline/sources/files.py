"""File sources and sinks: pictures with sidecars, tolerant JSON, CSV, JSON lines, atomic publish."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Suffixes of picture files.
SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".tif", ".tiff")


def stem(path: Column) -> Column:
    """Path without its suffix."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, length, modified) of all picture files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    low = F.lower("path")
    keep = low.endswith(SUFFIXES[0])
    for s in SUFFIXES[1:]:
        keep = keep | low.endswith(s)
    return files.where(keep).select("path", "content", "length", F.col("modificationTime").alias("modified"))


def _header(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """Format, width and height of a PNG, GIF, BMP or JPEG from its bytes; nulls of anything else."""
    try:
        if data is None:
            return None, None, None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "bmp", w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                kind = data[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 1 if kind == 0xFF else 2 if 0xD0 <= kind <= 0xD9 or kind == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        pass
    return None, None, None


def _headers(content: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([_header(c) for c in content], columns=["format", "width", "height"])
    return out.astype({"width": "Int32", "height": "Int32"})


_HEADER = StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())])
#: Format and size from a file's bytes; null where they can't be read.
picture_header = F.pandas_udf(_headers, _HEADER)


#: Fields of a sidecar; others are ignored.
SIDECAR = "expected_name string, expected_language string, expected_games array<string>, expected_set_code string, expected_collector_number string, layout_hint string, split_family string, ocr_text_by_roi map<string,string>, image_sha256 string, saved_detection struct<card_bbox:array<int>,card_quad:array<array<int>>>"


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(key, sidecar) of the JSON files below a folder; an unreadable file gives nulls."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return t.select(stem(F.input_file_name()).alias("key"), F.from_json("value", SIDECAR).alias("sidecar"))


def with_sidecars(files: DataFrame, side: DataFrame) -> DataFrame:
    """Pictures with their sidecar (null where there is none), content hash and saved detection.

    A hash kept in the sidecar is used if it has 64 digits, else it is computed.
    """
    j = files.withColumn("key", stem(F.regexp_replace("path", "^file:/+", "/"))).join(side.withColumn("key", F.regexp_replace("key", "^file:/+", "/")), "key", "left")
    kept = F.when(F.length("sidecar.image_sha256") == 64, F.col("sidecar.image_sha256"))
    return j.withColumn("sha256", F.coalesce(kept, F.sha2("content", 256))).withColumn("detection", F.col("sidecar.saved_detection"))


def upsert(kept: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` and those of ``kept`` whose key it lacks."""
    return kept.join(new.select(key), key, "left_anti").unionByName(new)


def read_tolerant(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON records: unknown fields dropped, missing ones filled with ``defaults`` or null."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.fillna(defaults) if defaults else df


def publish(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write beside ``path``, move the old result aside, rename, and remove the old one last.

    If anything fails the old result is put back, so it is never lost. Between the two renames a reader
    may find nothing for a moment; the renames go through the file system of the path.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(staging)
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{staging}.old")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        fs.delete(new, True)
        raise OSError(f"{path} couldn't be moved aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        fs.delete(new, True)
        raise OSError(f"{staging} couldn't be renamed to {path}")
    if had:
        fs.delete(aside, True)


def write_report_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report in one CSV file with a fixed order of columns; for aggregates, not for facts."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a folder of JSON lines."""
    df.write.mode("append").json(path)


def fingerprint_cache(spark: SparkSession, path: str, signature: str) -> DataFrame:
    """Cached fingerprints of one region signature: a partition filter, so others aren't read."""
    return spark.read.parquet(path).where(F.col("roi_signature") == signature)


def missing_fingerprints(records: DataFrame, cache: DataFrame, key: str = "scryfall_id") -> DataFrame:
    """Records that have no cached fingerprint: what is left to compute."""
    return records.join(cache.select(key), key, "left_anti")
