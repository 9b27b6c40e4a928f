"""Queries of orders, region tables, sidecars, expansions and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.functions import vectors as V
from weftline.functions.text import normalize_text
from weftline.operators import resolve as R
from weftline.plans.catalog_queries import _IDENT, _VIEW, identities, view
from weftline.plans.evaluation_queries import _F, facts
from weftline.plans.registry import Registry
from weftline.plans.score_queries import _C, candidates
from weftline.plans.text_queries import norm_sql
from weftline.session import table

query = Registry()


@query(f"SELECT id, name, released_at FROM {_VIEW} WHERE length(trim(image_uri)) > 0")
def ref_k5_newest_first(spark, d):
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    v = view(spark, d).where(F.length(F.trim("image_uri")) > 0)
    return v.orderBy(F.desc(F.coalesce("released_at", F.lit(""))), F.lower("name"), low("set_code"), low("collector_number"), "id").select("id", "name", "released_at")


@query(f"SELECT obs_id, ord, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, name, coalesce(set_code, ''), coalesce(collector_number, ''), ord) AS rank FROM {_C}")
def ref_w2_rerank_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("obs_id").orderBy(F.desc("score"), "name", F.coalesce("set_code", F.lit("")), F.coalesce("collector_number", F.lit("")), "ord")
    return candidates(spark, d).select("obs_id", "ord", F.row_number().over(w).alias("rank"))


@query(f"SELECT obs_id, ord, len(list_intersect(notes, ['type_line_match', 'set_symbol_match', 'art_match', 'lower_text_match'])) AS support FROM {_C} WHERE len(list_intersect(notes, ['type_line_match', 'set_symbol_match', 'art_match', 'lower_text_match'])) > 0")
def ref_u4_supporting_notes(spark, d):
    s = F.array(*map(F.lit, ("type_line_match", "set_symbol_match", "art_match", "lower_text_match")))
    return candidates(spark, d).where(F.arrays_overlap("notes", s)).select("obs_id", "ord", F.size(F.array_intersect("notes", s)).alias("support"))


@query("""SELECT l_orderkey AS obs_id, l_linenumber AS n, l_partkey AS part, round((1 - least(abs(l_discount - 0.18) / 0.18, 1.0)) * 0.45 + (1 - least(abs(l_quantity / 50 - 0.35) / 0.35, 1.0)) * 0.35 + (1 - least(l_tax * 5, 1.0)) * 0.20, 6) AS quality FROM lineitem""")
def ref_v8_mask_quality(spark, d):
    q = V.mask_quality(F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_tax") * 5)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), q.alias("quality"))


_PRESET = "(VALUES " + ", ".join(f"('{g}', {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for g, (_, x, y, w, h) in G.REGIONS.items()) + ") p(region, x, y, w, h)"
_OVER = "(SELECT r_name AS region, r_regionkey / 10.0::DOUBLE AS x, 0.1::DOUBLE AS y, 0.2::DOUBLE AS w, 0.3::DOUBLE AS h FROM region UNION ALL SELECT 'standard', 0.07::DOUBLE, 0.04::DOUBLE, 0.85::DOUBLE, 0.13::DOUBLE)"


def _regions(spark, d):
    preset = spark.createDataFrame([(g, *map(float, r[1:])) for g, r in G.REGIONS.items()], "region string, x double, y double, w double, h double")
    over = table(spark, d, "region").select(F.col("r_name").alias("region"), (F.col("r_regionkey") / 10).alias("x"), F.lit(0.1).alias("y"), F.lit(0.2).alias("w"), F.lit(0.3).alias("h"))
    over = over.unionByName(spark.createDataFrame([("standard", 0.07, 0.04, 0.85, 0.13)], preset.schema))
    return G.merge_regions(preset, over)


@query(f"SELECT coalesce(o.region, p.region) AS region, coalesce(o.x, p.x) AS x, coalesce(o.y, p.y) AS y, coalesce(o.w, p.w) AS w, coalesce(o.h, p.h) AS h FROM {_PRESET} FULL JOIN {_OVER} o ON o.region = p.region")
def ref_g5_merge_regions(spark, d):
    return _regions(spark, d)


@query(f"SELECT sha256(array_to_string(list_sort(list(region || '|' || printf('%.4f', x) || '|' || printf('%.4f', y) || '|' || printf('%.4f', w) || '|' || printf('%.4f', h))), ';')) AS signature FROM (SELECT coalesce(o.region, p.region) AS region, coalesce(o.x, p.x) AS x, coalesce(o.y, p.y) AS y, coalesce(o.w, p.w) AS w, coalesce(o.h, p.h) AS h FROM {_PRESET} FULL JOIN {_OVER} o ON o.region = p.region)")
def ref_g7_region_signature(spark, d):
    return G.signature(_regions(spark, d))



@query(f"""WITH m AS (SELECT obs_id, {norm_sql('b')} AS key, c AS score FROM (SELECT obs_id, min(best_name) AS b, min(confidence) AS c FROM recognition_results WHERE best_name IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1)),
v AS (SELECT normalized_name AS key, count(*) AS n FROM {_VIEW} WHERE normalized_name <> '' GROUP BY 1) SELECT m.obs_id, CASE WHEN m.score >= 0.84 AND v.n IS NOT NULL THEN v.n END AS n_printings, m.score >= 0.84 AND v.n IS NOT NULL AS expanded FROM m LEFT JOIN v USING (key)""")
def ref_j14_expand_printings(spark, d):
    """Printings that a good best match stands for, counted per name before the join: a name may have a third of all."""
    r = table(spark, d, "recognition_results").where("best_name is not null and confidence is not null and not isnan(confidence)").groupBy("obs_id").agg(F.min("best_name").alias("b"), F.min("confidence").alias("score"))
    m = r.select("obs_id", normalize_text(F.col("b")).alias("key"), "score", F.lit(1).alias("rank"))
    v = view(spark, d).where("normalized_name <> ''").groupBy(F.col("normalized_name").alias("key")).agg(F.count("*").alias("n_printings"))
    return R.expand_printings(m, v).select("obs_id", "n_printings", "expanded")


@query(f"""WITH c AS (SELECT eval_id AS cand_id, predicted_name AS name, predicted_set_code AS set_code FROM {_F} WHERE predicted_name IS NOT NULL),
a AS (SELECT name, set_code, min(id) AS id FROM {_VIEW} WHERE set_code IS NOT NULL GROUP BY ALL), b AS (SELECT name, min(id) AS id FROM {_VIEW} GROUP BY 1)
SELECT c.cand_id, CASE WHEN a.id IS NOT NULL THEN 0 WHEN b.id IS NOT NULL THEN 1 END AS priority, coalesce(a.id, b.id) AS found_id FROM c LEFT JOIN a ON a.name = c.name AND a.set_code = c.set_code LEFT JOIN b ON b.name = c.name""")
def ref_j18_reconcile(spark, d):
    c = facts(spark, d).where("predicted_name is not null").select(F.col("eval_id").alias("cand_id"), F.col("predicted_name").alias("name"), F.col("predicted_set_code").alias("set_code"))
    v = view(spark, d).select("name", "set_code", "id", F.col("id").alias("ord"))
    return R.reconcile(c, [(v, ["name", "set_code"]), (v, ["name"])], ["id"]).select("cand_id", "priority", "found_id")


@query(f"""SELECT v.id, unnest(list_filter([nullif(trim(o.oracle_text), ''), nullif(trim(v.flavor_text), ''), nullif(trim(o.oracle_text), '') || ' ' || nullif(trim(v.flavor_text), '')], lambda x: x IS NOT NULL)) AS text
FROM (SELECT DISTINCT id, oracle_id, flavor_text FROM printed_cards) v JOIN {_IDENT} o ON o.oracle_id = v.oracle_id""")
def ref_t18_lower_texts(spark, d):
    v = table(spark, d, "printed_cards").select("id", "oracle_id", "flavor_text").distinct()
    j = v.join(identities(spark, d).select("oracle_id", "oracle_text"), "oracle_id")
    return j.select("id", F.explode(R.lower_texts(F.col("oracle_text"), F.col("flavor_text"))).alias("text"))


@query(f"SELECT id, name AS expected_name, coalesce(lower(set_code), '') AS expected_set_code, collector_number AS expected_collector_number, layout AS layout_hint, CASE WHEN contains(name, ' // ') THEN string_split(name, ' // ')[1] ELSE name END AS title FROM {_VIEW}")
def ref_s18_sidecar_rows(spark, d):
    """What a printing's sidecar says: its label, layout, and the title its picture shows."""
    return view(spark, d).select("id", F.col("name").alias("expected_name"), F.coalesce(F.lower("set_code"), F.lit("")).alias("expected_set_code"), F.col("collector_number").alias("expected_collector_number"), F.col("layout").alias("layout_hint"), F.get(F.split("name", " // "), F.lit(0)).alias("title"))


@query("SELECT obs_id, array_to_string(list_filter([trim(x) FOR x IN l], lambda x: x <> ''), ' ') AS joined FROM (SELECT obs_id, coalesce(min(ocr_lines), []) AS l FROM recognition_results GROUP BY 1) WHERE len(l) > 1")
def ref_p14_region_text(spark, d):
    r = table(spark, d, "recognition_results").groupBy("obs_id").agg(F.coalesce(F.min("ocr_lines"), F.array().cast("array<string>")).alias("l")).where(F.size("l") > 1)
    return r.select("obs_id", F.array_join(F.filter(F.transform("l", lambda x: F.trim(x)), lambda x: x != ""), " ").alias("joined"))


QUERIES, SQL = query.queries, query.sql
