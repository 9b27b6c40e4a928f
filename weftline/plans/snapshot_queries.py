"""Problem 6: what changed between full snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import squeeze
from weftline.operators.snapshots import kept_ordinals, snapshot_changes
from weftline.session import shared_root, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between exports. The keys' ordinals are read from the shared folder and kept there for the next run."""
    exports = table(spark, sf_dir, "catalog_snapshots")
    watched = {"image_uri": F.col("image_uri"), "oracle_text": squeeze(F.col("oracle_text"))}
    store = f"{shared_root(spark)}/ordinals-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    ordinals = kept_ordinals(exports, "snapshot_no", "scryfall_id", store)
    found = snapshot_changes(exports, "snapshot_no", "scryfall_id", "exported_at", watched, ordinals)
    return found.select(F.col("snapshot").alias("snapshot_no"), F.col("key").alias("scryfall_id"), "change")


_SQL = r"""
WITH l AS (SELECT snapshot_no AS s, scryfall_id AS k, coalesce(image_uri, '') AS i,
  trim(regexp_replace(coalesce(oracle_text, ''), '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')) AS o
  FROM catalog_snapshots WHERE scryfall_id IS NOT NULL AND snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, scryfall_id ORDER BY exported_at DESC NULLS LAST) = 1),
n AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt FROM (SELECT DISTINCT s FROM l)),
f AS (SELECT l.*, n.nxt FROM l JOIN n USING (s) WHERE n.nxt IS NOT NULL)
SELECT b.s AS snapshot_no, b.k AS scryfall_id, 'added' AS change FROM l b JOIN n ON n.nxt = b.s WHERE NOT EXISTS (SELECT 1 FROM l a WHERE a.s = n.s AND a.k = b.k)
UNION ALL SELECT f.nxt, f.k, 'removed' FROM f WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.s = f.nxt AND b.k = f.k)
UNION ALL SELECT f.nxt, f.k, 'changed' FROM f JOIN l b ON b.s = f.nxt AND b.k = f.k WHERE f.i <> b.i OR f.o <> b.o
"""


def p6_changes_per_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_found(spark, sf_dir).groupBy("snapshot_no", "change").agg(F.count("*").alias("n_printings"))


QUERIES = {"p6_found": p6_found, "p6_changes_per_export": p6_changes_per_export}
SQL = {"p6_found": _SQL, "p6_changes_per_export": f"SELECT snapshot_no, change, count(*) AS n_printings FROM ({_SQL}) GROUP BY ALL"}
