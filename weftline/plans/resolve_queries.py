"""Queries of the resolver: fuzzy names and candidates of the recognition results."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import resolve as R
from weftline.plans.catalog_queries import identities, view
from weftline.plans.registry import Registry
from weftline.session import cut, table

query = Registry()


def _observations(spark, d):
    """One row an observation, the earliest delivery."""
    r = table(spark, d, "recognition_results").where("obs_id is not null")
    return r.groupBy("obs_id").agg(F.min_by(F.struct("ocr_lines", "layout_hint"), "ingested_at").alias("r")).select("obs_id", F.col("r.ocr_lines").alias("lines"), "r.layout_hint")


def _names(spark, d):
    """(key, form) with the normalized name as key: identities of one name are one entry.

    Forms are the name itself and the aliases of its printings.
    """
    names = identities(spark, d).where("normalized_name <> ''").select(F.col("normalized_name").alias("key"), F.col("normalized_name").alias("form"))
    prints = view(spark, d).where("normalized_name <> ''").select(F.col("id").alias("card_id"), F.col("normalized_name").alias("key"))
    aliases = table(spark, d, "aliases").where("normalized_alias <> ''").select("card_id", F.col("normalized_alias").alias("form")).distinct()
    return names.unionByName(aliases.join(prints, "card_id").select("key", "form")).distinct()


def _records(spark, d):
    i = identities(spark, d).where("normalized_name <> ''")
    return i.groupBy(F.col("normalized_name").alias("key")).agg(F.min("name").alias("name"), F.min_by(F.struct("layout", "type_line", "oracle_text"), "id").alias("r")).select("key", "name", "r.layout", "r.type_line", R.lower_texts(F.col("r.oracle_text"), F.lit(None).cast("string")).alias("lower_texts"))


def _read(spark, d):
    """Observations with what was read below the title: lines around a long dash are type lines, sentences rules."""
    o = _observations(spark, d)
    lines = F.filter(F.col("lines"), lambda x: x.isNotNull())
    types = F.filter(lines, lambda x: x.rlike("^[^.:]+ (—|//) [^.:]+$"))
    rules = F.filter(lines, lambda x: x.rlike("[.]$|^[{]|^(When|Whenever|Each) "))
    return o.withColumn("type_text", F.get(types, F.lit(0))).withColumn("lower_text", F.nullif(F.array_join(rules, " "), F.lit("")))


@query()
def ref_j9_t4_fuzzy_names(spark, d):
    """The five nearest names of every recognised title that is no name or alias itself."""
    names = _names(spark, d)
    asked = R.title_queries(_observations(spark, d)).join(names.select(F.col("form").alias("query")), "query", "left_anti")
    return R.fuzzy_names(asked, names).select("query", "key", F.round("score", 6).alias("score"), "rank")


@query()
def ref_d1_d2_match_candidates(spark, d):
    return R.match(cut(_read(spark, d)), cut(_names(spark, d)), _records(spark, d))


QUERIES, SQL = query.queries, query.sql
