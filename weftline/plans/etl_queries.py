"""Queries of the catalogue build: nested source records, written as JSON and read back, to the three tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.keys import fold_key
from weftline.operators import catalog as C
from weftline.plans.catalog_queries import _IDENT, _KEY, _VAR, identities, variants
from weftline.plans.registry import Registry
from weftline.plans.text_queries import clean_sql, norm_sql
from weftline.session import shared_folder, table
from weftline.sources.files import read_tolerant

query = Registry()
_TEXTS = ("mana_cost", "type_line", "oracle_text", "colors", "color_identity")


def _source(spark, d):
    """Source records of all printings with an identity, by way of JSON lines in the shared folder.

    Records of two faces have their texts, colours and picture in the faces only.
    """
    i = C.first_wins(table(spark, d, "oracle_cards").where("oracle_id is not null"), "oracle_id", "ingested_at", ["id", "name", "layout", "mana_cost", "type_line", "oracle_text", "colors", "color_identity"])
    i = i.select(fold_key(F.col("oracle_id")).alias("oracle_key"), "name", "layout", *(F.col(c).alias(f"of_{c}") for c in _TEXTS))
    v = variants(spark, d, "printed_name", "language", "rarity", "games").withColumn("oracle_key", fold_key(F.col("oracle_id"))).join(i, "oracle_key")
    two = F.contains("name", F.lit(" // "))
    face = lambda n: F.struct(n.alias("name"), *(F.col(f"of_{c}").alias(c) for c in _TEXTS), F.struct(F.col("image_uri").alias("normal")).alias("image_uris"))
    top = lambda c: F.when(~F.coalesce(two, F.lit(False)), F.col(f"of_{c}")).alias(c)
    rows = v.select(
        F.col("id").alias("pos"), F.col("scryfall_id").alias("id"), "oracle_id", "name", "printed_name", F.col("set_code").alias("set"), "collector_number", F.col("language").alias("lang"), "games", "layout", "rarity", "released_at",
        *map(top, _TEXTS), F.when(~F.coalesce(two, F.lit(False)), F.struct(F.col("image_uri").alias("png"))).alias("image_uris"),
        F.when(two, F.transform(F.split("name", " // "), face)).alias("card_faces"), F.lit("ignored").alias("unknown_field"),
    )
    path = shared_folder(spark, "source")
    rows.write.json(path)
    return read_tolerant(spark, path, f"pos bigint, {C.SOURCE}")


_TWO = "coalesce(contains(i.name, ' // '), false)"
_S = f"""(SELECT v.id AS pos, {clean_sql('v.scryfall_id')} AS scryfall_id, coalesce({clean_sql('v.oracle_id')}, 'printing:' || {clean_sql('v.scryfall_id')}) AS oracle_id, {clean_sql('i.name')} AS name, {norm_sql('i.name')} AS normalized_name,
 {clean_sql('i.layout')} AS layout, CASE WHEN {_TWO} THEN {clean_sql('i.type_line')} || repeat(' // ' || {clean_sql('i.type_line')}, len(string_split(i.name, ' // ')) - 1) ELSE {clean_sql('i.type_line')} END AS type_line,
 CASE WHEN {_TWO} THEN {clean_sql('i.oracle_text')} || repeat(' // ' || {clean_sql('i.oracle_text')}, len(string_split(i.name, ' // ')) - 1) ELSE {clean_sql('i.oracle_text')} END AS oracle_text,
 CASE WHEN {_TWO} THEN list_sort(list_distinct(list_filter([{clean_sql('x')} FOR x IN coalesce(i.colors, [])], lambda x: x IS NOT NULL))) ELSE list_sort(list_filter([{clean_sql('x')} FOR x IN coalesce(i.colors, [])], lambda x: x IS NOT NULL)) END AS colors,
 {clean_sql('v.set_code')} AS set_code, {clean_sql('v.image_uri')} AS image_uri, {clean_sql('v.printed_name')} AS printed_name, CASE WHEN {_TWO} THEN string_split(i.name, ' // ') ELSE [] END AS faces
 FROM {_VAR} v JOIN {_IDENT} i ON {_KEY('v.oracle_id')} = {_KEY('i.oracle_id')} WHERE v.language = 'en' AND CASE WHEN list_contains([lower(g) FOR g IN v.games], 'paper') THEN true WHEN len(v.games) > 0 THEN false ELSE true END
 AND {clean_sql('v.scryfall_id')} IS NOT NULL AND {clean_sql('i.name')} IS NOT NULL)"""
_FIRST = lambda key, cols: f"SELECT {key}, {cols} FROM {_S} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY pos) = 1"


@query(_FIRST("oracle_id", "name, normalized_name, layout, type_line, oracle_text, colors"))
def ref_p2_p4_p5_build_identities(spark, d):
    i = C.build_catalog(_source(spark, d))["identities"]
    return i.select("oracle_id", "name", "normalized_name", "layout", "type_line", "oracle_text", F.array_sort("colors").alias("colors"))


@query(_FIRST("scryfall_id", "oracle_id, set_code, image_uri, printed_name"))
def ref_f3_p3_build_variants(spark, d):
    return C.build_catalog(_source(spark, d))["variants"].select("scryfall_id", "oracle_id", "set_code", "image_uri", "printed_name")


@query(f"""SELECT DISTINCT scryfall_id, alias, {norm_sql('alias')} AS normalized_alias FROM (SELECT scryfall_id, name, unnest(list_filter(list_concat([printed_name], [{clean_sql('f')} FOR f IN faces]), lambda x: x IS NOT NULL)) AS alias FROM {_S}) WHERE alias <> name""")
def ref_p6_build_aliases(spark, d):
    return C.build_catalog(_source(spark, d))["aliases"].select("scryfall_id", "alias", "normalized_alias")


@query(f"""WITH s AS {_S}, a AS (SELECT DISTINCT scryfall_id, alias FROM (SELECT scryfall_id, name, unnest(list_filter(list_concat([printed_name], [{clean_sql('f')} FOR f IN faces]), lambda x: x IS NOT NULL)) AS alias FROM s) WHERE alias <> name)
SELECT 'schema_version' AS key, '{C.SCHEMA_VERSION}' AS value UNION ALL SELECT 'card_count', count(DISTINCT scryfall_id)::VARCHAR FROM s UNION ALL SELECT 'oracle_count', count(DISTINCT oracle_id)::VARCHAR FROM s UNION ALL SELECT 'alias_count', count(*)::VARCHAR FROM a""")
def ref_p8_s3_build_metadata(spark, d):
    return C.build_catalog(_source(spark, d))["metadata"]


QUERIES, SQL = query.queries, query.sql
