"""Queries of regions, readings, picture pools, external identities and comparisons of bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.functions.text import normalize_text
from weftline.operators import evaluate as E
from weftline.operators import resolve as R
from weftline.operators import scoring as S
from weftline.operators.catalog import exact_summary
from weftline.plans.catalog_queries import _ALIAS, _IDENT, _VAR, _entries, variants
from weftline.plans.evaluation_queries import _BINS, _F, CUT, _halves, facts
from weftline.plans.registry import Registry
from weftline.plans.score_queries import _B, _C, _SCORE, _boxes, candidates
from weftline.plans.text_queries import SPLIT_SQL, _clean_line, norm_sql
from weftline.session import table

query = Registry()

_HALF = lambda op: _BINS.replace(_F, f"(SELECT * FROM {_F} WHERE evaluated_at {op} TIMESTAMP '{CUT}')")


@query(f"""SELECT a.mode, a.lower_bound, a.upper_bound, a.n AS baseline_n, a.calibration_gap AS baseline_gap, a.empirical_accuracy AS baseline_accuracy, b.n AS current_n, b.calibration_gap AS current_gap, b.empirical_accuracy AS current_accuracy,
 round(b.calibration_gap - a.calibration_gap, 4) AS gap_delta, round(b.empirical_accuracy - a.empirical_accuracy, 4) AS accuracy_delta FROM ({_HALF('<')}) a JOIN ({_HALF('>=')}) b USING (mode, lower_bound, upper_bound)""")
def ref_j17_bin_comparison(spark, d):
    old, new = _halves(spark, d)
    return E.bin_comparison(E.calibration_bins(old, ["mode"]), E.calibration_bins(new, ["mode"]), ["mode"])


@query(f"""WITH m AS (SELECT expected_set_code AS s, mode, count(*) FILTER (top1_hit) AS hits, count(*) AS n FROM {_F} WHERE expected_set_code IS NOT NULL GROUP BY ALL), b AS (SELECT s, mode FROM m WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY hits DESC, n, mode) = 1)
SELECT mode, count(*) AS n_sets FROM b GROUP BY 1""")
def ref_a19_best_of_counts(spark, d):
    """For how many sets each mode has the most hits; of equal ones that with fewer rows, then the first by name."""
    m = facts(spark, d).where("expected_set_code is not null").groupBy("expected_set_code", "mode").agg(F.count_if(F.coalesce("top1_hit", F.lit(False))).alias("hits"), F.count("*").alias("n")).where("hits > 0")
    return m.groupBy("expected_set_code").agg(F.min_by("mode", F.struct(-F.col("hits"), "n", "mode")).alias("mode")).groupBy("mode").agg(F.count("*").alias("n_sets"))


@query(f"""WITH e AS (SELECT v.scryfall_id, v.image_uri, s.n IS NOT NULL AS had, coalesce(s.n, 0) > 1 AS again FROM {_VAR} v LEFT JOIN (SELECT scryfall_id, count(DISTINCT snapshot_no) AS n FROM catalog_snapshots GROUP BY 1) s USING (scryfall_id))
SELECT count(*) AS n_all, count(*) FILTER (length(trim(image_uri)) > 0) AS n_eligible, count(*) FILTER (length(trim(image_uri)) > 0 AND had) AS n_already, count(*) FILTER (length(trim(image_uri)) > 0 AND NOT had) AS n_attempted,
 count(*) FILTER (NOT coalesce(length(trim(image_uri)) > 0, false)) AS n_without, count(*) FILTER (length(trim(image_uri)) > 0 AND again) AS n_again,
 round(count(*) FILTER (length(trim(image_uri)) > 0 AND had) / greatest(1, count(*) FILTER (length(trim(image_uri)) > 0)), 4) AS share_already FROM e""")
def ref_a23_all_totals(spark, d):
    """The seven totals of a run that computes what is missing: printings kept in an export count as done."""
    kept = table(spark, d, "catalog_snapshots").where("scryfall_id is not null").groupBy("scryfall_id").agg(F.count_distinct("snapshot_no").alias("k"))
    j = variants(spark, d).select("scryfall_id", F.coalesce(F.length(F.trim("image_uri")) > 0, F.lit(False)).alias("ok")).join(kept, "scryfall_id", "left")
    had, ok = F.col("k").isNotNull(), F.col("ok")
    a = j.agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_eligible"), F.count_if(ok & had).alias("n_already"), F.count_if(ok & ~had).alias("n_attempted"), F.count_if(~ok).alias("n_without"), F.count_if(ok & (F.col("k") > 1)).alias("n_again"))
    return a.withColumn("share_already", F.round(F.col("n_already") / F.greatest(F.lit(1), F.col("n_eligible")), 4))


_SIM = f"(SELECT obs_id, ord, round(((obs_id * 7 + ord * 13) % 101) / 100.0::DOUBLE, 4) AS sim FROM {_C})"


@query(f"""WITH r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(sim) OVER w, 0.0) AS nxt FROM {_SIM} WINDOW w AS (PARTITION BY obs_id ORDER BY sim DESC, ord))
SELECT obs_id, ord, sim AS similarity, round(sim - nxt, 4) AS margin, greatest(0.0, least(1.0, round(sim + least(0.06, round(sim - nxt, 4) * 0.5), 4))) AS score FROM r WHERE rn = 1 AND sim >= 0.92 AND round(sim - nxt, 4) >= 0.06""")
def ref_d9_w11_visual_pool(spark, d):
    return S.visual_pool(candidates(spark, d).withColumn("sim", F.round(((F.col("obs_id") * 7 + F.col("ord") * 13) % 101) / 100, 4)))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 > 0 THEN greatest(greatest(1, c_nationkey - 5), least(100, (c_nationkey % 3) * 30 * 3)) WHEN c_nationkey % 2 = 0 THEN greatest(greatest(1, c_nationkey - 5), 20) ELSE greatest(1, c_nationkey - 5) END AS top_n FROM customer""")
def ref_i10_external_top(spark, d):
    n = F.col("c_nationkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.external_top(n - 5, (n % 3) * 30, n % 2 == 0).alias("top_n"))


_LAYOUTS = "(SELECT DISTINCT layout FROM oracle_cards)"
_ORD = "[" + ", ".join(f"'{r}'" for r in G.REGION_ORDER) + "]"
_CASE = "CASE lower(coalesce(layout, 'normal')) " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in G.LAYOUT_REGIONS.items()) + " ELSE []::VARCHAR[] END"


@query(f"SELECT layout, list_filter({_ORD}, lambda r: list_contains({_CASE}, r) OR r = 'split_left') AS regions FROM {_LAYOUTS}")
def ref_g4_regions_of_layout(spark, d):
    enabled = F.array(F.lit("split_left"), F.lit("no such region"))
    return table(spark, d, "oracle_cards").select("layout").distinct().withColumn("regions", G.regions_of_layout(F.col("layout"), enabled))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN NULL ELSE [o_custkey::INT, (o_orderkey % 700)::INT, 30, -4] END AS box FROM orders""")
def ref_p13_coerce_boxes(spark, d):
    k = F.col("o_orderkey")
    texts = F.when(k % 5 == 0, F.array(k.cast("string"), F.lit("x"), F.lit("30"), F.lit("-4"))).when(k % 5 == 1, F.array(k.cast("string"))).otherwise(F.array(F.col("o_custkey").cast("string"), (k % 700).cast("string"), F.lit("30"), F.lit("-4")))
    return table(spark, d, "orders").select(k.alias("id"), G.coerce_ints(texts, 4).alias("box"))


_PICK = f"(SELECT frame_id, max(x) FILTER (n = 1) AS x1, max(y) FILTER (n = 1) AS y1, arg_max(x, {{'s': {_SCORE}, 'k': -n}}) AS bx, max({_SCORE}) AS s FROM {_B} GROUP BY 1)"


@query(f"""SELECT frame_id, CASE frame_id % 4 WHEN 0 THEN 'quad' WHEN 1 THEN 'box' ELSE CASE WHEN s > 0 AND frame_id % 4 = 2 THEN 'candidate' ELSE 'centre' END END AS source,
 CASE frame_id % 4 WHEN 0 THEN x1 WHEN 1 THEN x1 ELSE CASE WHEN s > 0 AND frame_id % 4 = 2 THEN bx ELSE 162 END END::INT AS left FROM {_PICK}""")
def ref_g3_detect_priority(spark, d):
    """Where the card is by the order of sources; a quarter of the frames has a quad, a box, candidates, or nothing."""
    f = _boxes(spark, d).groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("n", "b"))).alias("all"), F.max("fw").alias("fw"), F.max("fh").alias("fh"))
    first, k = F.col("all")[0]["b"], F.col("frame_id") % 4
    p = G.pick_box(F.when(k == 0, G.quad_of(first)), F.when(k == 1, first), F.when(k == 2, F.transform("all", lambda x: x["b"])), F.col("fw"), F.col("fh"))
    return f.select("frame_id", p.alias("p")).select("frame_id", "p.source", "p.box.left")


_R = "(SELECT DISTINCT obs_id, active_roi AS region, ocr_lines, layout_hint FROM recognition_results WHERE obs_id IS NOT NULL AND len(ocr_lines) > 0)"
_TITLES = "[" + ", ".join(f"'{r}'" for r in R.TITLE_REGIONS) + "]"
_FACES = "(" + ", ".join(f"'{r}'" for r in R.FACE_REGIONS) + ")"


@query(f"""WITH src AS (SELECT *, coalesce(list_position({_TITLES}, region), 0) AS rg FROM {_R}), {SPLIT_SQL},
one AS (SELECT *, {norm_sql("array_to_string(kept[1:2], ' ')")} AS single FROM split),
q AS (SELECT obs_id, rg, region, single, CASE WHEN coalesce(lower(layout_hint) = 'split', false) AND region IN {_FACES} THEN queries ELSE [single] END AS qs FROM one),
t AS (SELECT obs_id, rg, unnest(qs) AS query, generate_subscripts(qs, 1) AS pos FROM q WHERE rg > 0),
f AS (SELECT obs_id, query, min((rg, pos)) AS p FROM t WHERE query <> '' GROUP BY 1, 2)
SELECT obs_id, (row_number() OVER (PARTITION BY obs_id ORDER BY p) - 1)::INT AS q_ord, query FROM f
UNION ALL SELECT obs_id, 0, arg_min(single, (coalesce(region, ''), single)) FROM q WHERE single <> '' AND obs_id NOT IN (SELECT obs_id FROM f) GROUP BY 1""")
def ref_t11_ordered_title_queries(spark, d):
    return R.ordered_title_queries(_readings(spark, d))


def _readings(spark, d):
    return table(spark, d, "recognition_results").where("obs_id is not null").select("obs_id", F.col("active_roi").alias("region"), F.col("ocr_lines").alias("lines"), "layout_hint").distinct()


@query(f"""WITH src AS (SELECT obs_id, ocr_lines FROM {_R} WHERE region = 'split_full'), {SPLIT_SQL}, q AS (SELECT DISTINCT obs_id, unnest(queries) AS query FROM split),
ent AS (SELECT normalized, key, min(source) AS source FROM (SELECT normalized_name AS normalized, oracle_id AS key, 0 AS source FROM {_IDENT} WHERE normalized_name <> '' UNION ALL SELECT normalized, key, 1 FROM {_ALIAS}) GROUP BY 1, 2)
SELECT q.obs_id, q.query, count(*) AS n_keys, min(ent.key) AS first_key, min(ent.source) AS source FROM q JOIN ent ON ent.normalized = q.query GROUP BY 1, 2""")
def ref_j12_split_recovery(spark, d):
    """Identities that the split queries of whole split cards hit, names before aliases."""
    r = _readings(spark, d).where("region = 'split_full' and size(lines) > 0")
    q = r.select("obs_id", F.explode(R.split_title_queries(F.col("lines"))).alias("query")).distinct()
    names, aliases = _entries(spark, d)
    return exact_summary(q.select(F.struct("obs_id", "query").alias("q_id"), "query"), names, aliases).select("q_id.obs_id", "q_id.query", "n_keys", "first_key", "source")


@query(f"""SELECT obs_id, active_roi, confidence FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY round(coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, 0.0) - CASE WHEN len({_clean_line("array_to_string(ocr_lines[1:1], ' ')")}) < 4 THEN 0.2 ELSE 0.0 END, 4) DESC, length(array_to_string(ocr_lines, '')) DESC, len(ocr_lines), coalesce(active_roi, ''), coalesce(confidence, 0.0)) AS r
FROM (SELECT DISTINCT obs_id, active_roi, confidence, ocr_lines FROM recognition_results WHERE obs_id IS NOT NULL AND len(ocr_lines) > 0)) WHERE r = 1""")
def ref_w12_best_reading(spark, d):
    """Of an observation's readings the best by confidence less a penalty for a short first line, then characters, then fewer lines."""
    from weftline.functions.text import clean_line

    r = table(spark, d, "recognition_results").where("obs_id is not null and size(ocr_lines) > 0").select("obs_id", "active_roi", "confidence", "ocr_lines").distinct()
    conf = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0))
    short = F.length(clean_line(F.coalesce(F.col("ocr_lines")[0], F.lit("")))) < 4
    key = F.struct(-F.round(conf - F.when(short, 0.2).otherwise(0.0), 4), -F.length(F.array_join("ocr_lines", "")), F.size("ocr_lines"), F.coalesce("active_roi", F.lit("")), F.coalesce("confidence", F.lit(0.0)))
    return r.groupBy("obs_id").agg(F.min_by(F.struct("active_roi", "confidence"), key).alias("b")).select("obs_id", "b.*")


@query(f"""SELECT eval_id, CASE WHEN path IS NOT NULL OR expected_name IS NOT NULL THEN expected_name END AS name, CASE WHEN path IS NOT NULL OR expected_name IS NOT NULL THEN lower(expected_set_code) END AS set_code FROM {_F}""")
def ref_p16_p17_expected_identity(spark, d):
    """An expectation only where something identifies it, with the set in lower case."""
    some = F.coalesce("path", "expected_name").isNotNull()
    e = F.when(some, F.struct(F.col("expected_name").alias("name"), F.nullif(F.lower(F.trim("expected_set_code")), F.lit("")).alias("set_code")))
    return facts(spark, d).select("eval_id", e.alias("e")).select("eval_id", "e.name", "e.set_code")


_FIRED = [("ocr", "len(ocr_lines) > 0", "size(ocr_lines) > 0"), ("secondary", "len(tried_rois) > 1", "size(tried_rois) > 1"), ("split_full", "list_contains(tried_rois, 'split_full')", "array_contains(tried_rois, 'split_full')"), ("failed", "failure_code IS NOT NULL", "failure_code is not null"), ("review", "review_reason IS NOT NULL", "review_reason is not null")]
_O = "(SELECT * FROM recognition_results WHERE obs_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY ingested_at, coalesce(ocr_lines, [])) = 1)"


@query(f"""SELECT obs_id, CASE WHEN len(tried_rois) > 1 THEN 'secondary_ocr' WHEN len(ocr_lines) > 0 THEN 'title_only' ELSE 'unknown' END AS resolution_path, list_filter([{', '.join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql, _ in _FIRED)}], lambda x: x IS NOT NULL) AS branches_fired FROM {_O}""")
def ref_d15_pipeline_summary(spark, d):
    """How each observation came about: its path and the branches that took part, in their order."""
    cols = ["ocr_lines", "tried_rois", "failure_code", "review_reason"]
    r = table(spark, d, "recognition_results").where("obs_id is not null").groupBy("obs_id").agg(F.min_by(F.struct(*cols), F.struct("ingested_at", F.coalesce("ocr_lines", F.array().cast("array<string>")))).alias("r")).select("obs_id", "r.*")
    path = F.when(F.size("tried_rois") > 1, "secondary_ocr").when(F.size("ocr_lines") > 0, "title_only").otherwise("unknown")
    return r.select("obs_id", path.alias("resolution_path"), F.array_compact(F.array(*(F.when(F.expr(c), n) for n, _, c in _FIRED))).alias("branches_fired"))


QUERIES, SQL = query.queries, query.sql
