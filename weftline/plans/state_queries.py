"""Queries of streams, of the tracked pool, of tolerant JSON, and of the remaining joins and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import normalize_text
from weftline.operators import scoring as S
from weftline.operators.catalog import newest_per_key
from weftline.plans.catalog_queries import _VIEW, view
from weftline.plans.evaluation_queries import _F, facts
from weftline.plans.registry import Registry
from weftline.plans.score_queries import _C, candidates
from weftline.plans.text_queries import norm_sql
from weftline.session import shared_folder, table
from weftline.streaming.state import count_pairs, event_stream, latest_store, pool_snapshot, track_pool

query = Registry()


@query("SELECT user_id::VARCHAR AS expected_card_id, event_type AS actual_card_id, count(*) AS seen_count, min(ts) AS first_seen_utc FROM events GROUP BY ALL")
def ref_r4_stream_pair_counts(spark, d):
    """The pair store after streaming all events through it."""
    e = event_stream(spark, f"{d}/events.parquet")
    pairs = e.select(F.col("user_id").cast("string").alias("expected_card_id"), F.col("event_type").alias("actual_card_id"), F.col("ts").cast("timestamp").alias("seen_at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"))
    at = shared_folder(spark, "stream")
    count_pairs(pairs, f"{at}/store", f"{at}/offsets")
    return latest_store(spark, f"{at}/store").select("expected_card_id", "actual_card_id", "seen_count", "first_seen_utc")


_POOL = f"(SELECT mode AS session, predicted_name AS name, predicted_set_code AS set_code, predicted_collector_number AS collector_number, CASE WHEN eval_id % 3 > 0 THEN path END AS fingerprint, eval_id AS seq FROM {_F} WHERE predicted_name IS NOT NULL)"


@query(f"SELECT session, name, set_code, collector_number, arg_max(fingerprint, seq) FILTER (fingerprint IS NOT NULL) AS fingerprint, max(seq) AS seq, count(*) AS updates FROM {_POOL} GROUP BY ALL")
def ref_r1_r2_tracked_pool(spark, d):
    """The tracked pool after all events have gone through the stream with state, written and read back."""
    f = facts(spark, d).where("predicted_name is not null")
    e = f.select(F.col("mode").alias("session"), F.col("predicted_name").alias("name"), F.col("predicted_set_code").alias("set_code"), F.col("predicted_collector_number").alias("collector_number"), F.when(F.col("eval_id") % 3 > 0, F.col("path")).alias("fingerprint"), F.col("eval_id").alias("seq"))
    at = shared_folder(spark, "pool")
    e.write.parquet(f"{at}/events")
    out = track_pool(event_stream(spark, f"{at}/events"))
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/updates/batch={number}")
    out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    if not f.limit(1).count():
        return pool_snapshot(e)
    key = ["session", "name", "set_code", "collector_number"]
    updates = spark.read.schema("session string, name string, set_code string, collector_number string, fingerprint string, seq bigint, updates bigint").parquet(f"{at}/updates")
    return updates.groupBy(*key).agg(F.max_by(F.struct("fingerprint", "seq", "updates"), "updates").alias("r")).select(*key, "r.*")


@query("SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def ref_s11_p11_tolerant_json(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint, other string").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


_REST = "coalesce(predicted_name = expected_name, false) AND (expected_set_code IS NULL OR lower(coalesce(predicted_set_code, '')) = lower(expected_set_code)) AND (expected_collector_number IS NULL OR lower(coalesce(predicted_collector_number, '')) = lower(expected_collector_number))"


@query(f"""SELECT eval_id, CASE WHEN eval_id % 3 = 0 AND expected_set_code IS NOT NULL AND expected_collector_number IS NOT NULL THEN lower(coalesce(predicted_set_code || '-' || predicted_collector_number, '')) = lower(expected_set_code || '-' || expected_collector_number) ELSE {_REST} END AS matches,
 predicted_set_code IS DISTINCT FROM expected_set_code OR predicted_collector_number IS DISTINCT FROM expected_collector_number AS distinct_printing FROM {_F} WHERE expected_name IS NOT NULL""")
def ref_f10_f15_matches_expected(spark, d):
    """A third of the expectations name a printing's id (made of set and number), which then decides alone."""
    printing = lambda side: F.concat(f"{side}_set_code", F.lit("-"), f"{side}_collector_number")
    ids = {"expected_scryfall_id": F.when(F.col("eval_id") % 3 == 0, printing("expected")), "predicted_scryfall_id": F.upper(printing("predicted")), "expected_oracle_id": F.lit(None).cast("string"), "predicted_oracle_id": F.lit(None).cast("string")}
    f = facts(spark, d).where("expected_name is not null").withColumns(ids)
    p = S.distinct_printing(F.col("predicted_set_code"), F.col("predicted_collector_number"), F.col("expected_set_code"), F.col("expected_collector_number"))
    return f.select("eval_id", S.matches_expected("predicted_", "expected_").alias("matches"), p.alias("distinct_printing"))


@query(f"SELECT eval_id, lower(predicted_name) = lower(expected_name) OR list_contains([trim(x) FOR x IN string_split(lower(expected_name), '//')], lower(predicted_name)) AS soft_match FROM {_F} WHERE expected_name IS NOT NULL AND predicted_name IS NOT NULL")
def ref_f11_soft_match(spark, d):
    f = facts(spark, d).where("expected_name is not null and predicted_name is not null")
    faces = F.transform(F.split(F.lower("expected_name"), "//"), lambda x: F.trim(x))
    return f.select("eval_id", ((F.lower("predicted_name") == F.lower("expected_name")) | F.array_contains(faces, F.lower("predicted_name"))).alias("soft_match"))


_OBS = "(SELECT obs_id, arg_min(layout_hint, ingested_at) AS layout_hint, arg_min(best_name, ingested_at) AS best_name FROM recognition_results WHERE obs_id IS NOT NULL GROUP BY 1)"


@query(f"""SELECT o.obs_id, l.layout, lower(o.layout_hint) = lower(l.layout) OR (lower(o.layout_hint) IN ('transform', 'modal_dfc') AND lower(l.layout) IN ('transform', 'modal_dfc')) AS compatible FROM {_OBS} o
JOIN (SELECT normalized_name, min(layout) AS layout FROM {_VIEW} GROUP BY 1) l ON l.normalized_name = {norm_sql('o.best_name')} WHERE o.layout_hint IS NOT NULL AND l.layout IS NOT NULL""")
def ref_f13_layout_compatibility(spark, d):
    r = table(spark, d, "recognition_results").where("obs_id is not null").groupBy("obs_id").agg(F.min_by("layout_hint", "ingested_at").alias("layout_hint"), F.min_by("best_name", "ingested_at").alias("best_name"))
    v = view(spark, d).groupBy("normalized_name").agg(F.min("layout").alias("layout"))
    j = r.withColumn("normalized_name", normalize_text(F.col("best_name"))).join(v, "normalized_name").where("layout_hint is not null and layout is not null")
    a, b = F.lower("layout_hint"), F.lower("layout")
    return j.select("obs_id", "layout", ((a == b) | (a.isin("transform", "modal_dfc") & b.isin("transform", "modal_dfc"))).alias("compatible"))


@query(f"""WITH p AS (SELECT eval_id, 1 AS pr, w.id FROM {_F} e JOIN {_VIEW} w ON lower(w.set_code) = lower(e.expected_set_code) AND lower(w.collector_number) = lower(e.expected_collector_number) AND w.name = e.expected_name WHERE e.expected_set_code IS NOT NULL AND e.expected_collector_number IS NOT NULL
 UNION ALL SELECT eval_id, 2, w.id FROM {_F} e JOIN (SELECT name, min(id) AS id FROM {_VIEW} GROUP BY 1) w ON w.name = e.expected_name WHERE e.expected_set_code IS NULL OR e.expected_collector_number IS NULL)
SELECT eval_id, min(pr) AS priority, min(id) AS record_id FROM p GROUP BY 1""")
def ref_j13_resolve_expected(spark, d):
    """The record of an expectation: by set and number where both are given, else by name."""
    f = facts(spark, d).where("expected_name is not null")
    v = view(spark, d)
    full = f.where("expected_set_code is not null and expected_collector_number is not null").select("eval_id", F.col("expected_name").alias("name"), F.lower("expected_set_code").alias("s"), F.lower("expected_collector_number").alias("c"))
    a = full.join(v.select("id", "name", F.lower("set_code").alias("s"), F.lower("collector_number").alias("c")), ["name", "s", "c"]).select("eval_id", F.lit(1).alias("pr"), "id")
    names = v.groupBy("name").agg(F.min("id").alias("id"))
    b = f.where("expected_set_code is null or expected_collector_number is null").select("eval_id", F.col("expected_name").alias("name")).join(names, "name").select("eval_id", F.lit(2).alias("pr"), "id")
    return a.unionByName(b).groupBy("eval_id").agg(F.min("pr").alias("priority"), F.min("id").alias("record_id"))


@query(f"SELECT eval_id, coalesce(nullif(trim(expected_name), ''), regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')) AS expectation, coalesce(CASE WHEN candidate_count >= 0 THEN candidate_count END, 0) AS n_candidates FROM {_F} WHERE path IS NOT NULL")
def ref_p10_p12_expectation(spark, d):
    own = F.nullif(F.trim("expected_name"), F.lit(""))
    from_path = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "")
    return facts(spark, d).where("path is not null").select("eval_id", F.coalesce(own, from_path).alias("expectation"), F.coalesce(F.when(F.col("candidate_count") >= 0, F.col("candidate_count")), F.lit(0)).alias("n_candidates"))


@query("""SELECT fixture, arg_max(scan_id, {'c': confidence, 'h': name_hit::INT, 'k': -scan_id}) AS best_scan FROM (SELECT DISTINCT fixture, scan_id, confidence, name_hit FROM scan_results) WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND name_hit IS NOT NULL AND fixture IS NOT NULL GROUP BY 1""")
def ref_w11_w12_w13_best_of(spark, d):
    """The best attempt of every picture by an ordered list of keys, the first of equals."""
    s = table(spark, d, "scan_results").where("confidence is not null and not isnan(confidence) and name_hit is not null and fixture is not null").select("fixture", "scan_id", "confidence", "name_hit").distinct()
    return s.groupBy("fixture").agg(F.max_by("scan_id", F.struct("confidence", F.col("name_hit").cast("int"), -F.col("scan_id"))).alias("best_scan"))


_SIMS = f"(SELECT c.*, round(((obs_id * 7 + ord * 13) % 100) / 100.0::DOUBLE, 4) AS sim FROM {_C} c)"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, name, ord) AS rn FROM {_SIMS}), n AS (SELECT r.*, first_value(name) OVER w AS bn, first_value(score) OVER w AS bs FROM r WINDOW w AS (PARTITION BY obs_id ORDER BY rn)),
s AS (SELECT *, name = bn AND bs - score <= 0.10 AS near FROM n), k AS (SELECT *, near AND sum(near::INT) OVER (PARTITION BY obs_id ORDER BY rn) <= 6 AND sum(near::INT) OVER (PARTITION BY obs_id) >= 2 AS compared FROM s),
m AS (SELECT *, max(CASE WHEN compared THEN sim END) OVER (PARTITION BY obs_id) AS top, coalesce(nth_value(CASE WHEN compared THEN sim END, 2) OVER (PARTITION BY obs_id ORDER BY CASE WHEN compared THEN sim END DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0) AS second FROM k),
u AS (SELECT *, coalesce(compared AND top >= 0.81 AND top - second >= 0.03, false) AS moved FROM m), v AS (SELECT *, CASE WHEN moved THEN greatest(0.0, least(1.0, round(score + round((sim - 0.5) * 0.22, 4), 4))) ELSE score END AS final FROM u)
SELECT obs_id, ord, final AS score, moved FROM v""")
def ref_d7_d8_visual_rerank(spark, d):
    """Scores after comparing pictures: only near candidates of the best name, only if one stands out."""
    c = candidates(spark, d).withColumn("sim", F.round(((F.col("obs_id") * 7 + F.col("ord") * 13) % 100) / 100, 4))
    return S.visual_rerank(c, 0.10, 6, 0.22, least=0.81, lead=0.03).select("obs_id", "ord", "score", "moved")


@query(f"SELECT s.obs_id, count(*) AS n_lines, count(DISTINCT {norm_sql('l')}) AS n_distinct FROM (SELECT obs_id, unnest(ocr_lines) AS l FROM recognition_results) s WHERE {norm_sql('l')} <> '' GROUP BY 1")
def ref_s21_u5_line_dedupe(spark, d):
    x = table(spark, d, "recognition_results").select("obs_id", F.explode("ocr_lines").alias("l")).withColumn("n", normalize_text(F.col("l"))).where("n <> ''")
    return x.groupBy("obs_id").agg(F.count("*").alias("n_lines"), F.count_distinct("n").alias("n_distinct"))


_FIRSTS = f"(SELECT path, mode, arg_min(eval_id, eval_id) AS eval_id, arg_min({{'c': confidence}}, eval_id).c AS confidence, arg_min({{'n': predicted_name}}, eval_id).n AS name FROM {_F} WHERE path IS NOT NULL GROUP BY 1, 2)"


@query(f"""SELECT a.path, b.mode, a.eval_id, b.eval_id AS other_id, round(a.confidence - b.confidence, 4) AS difference, a.name IS NOT DISTINCT FROM b.name AS same_name FROM {_FIRSTS} a JOIN {_FIRSTS} b ON a.path = b.path WHERE a.mode = 'greenfield' AND b.mode <> 'greenfield'""")
def ref_i9_engine_comparison(spark, d):
    """Each picture's first result of the first mode beside those of every other mode."""
    one = facts(spark, d).where("path is not null").groupBy("path", "mode").agg(F.min("eval_id").alias("eval_id"), F.min_by(F.struct("confidence", F.col("predicted_name").alias("name")), "eval_id").alias("r"))
    a = one.where("mode = 'greenfield'").select("path", "eval_id", F.col("r.confidence").alias("c1"), F.col("r.name").alias("n1"))
    b = one.where("mode <> 'greenfield'").select("path", "mode", F.col("eval_id").alias("other_id"), F.col("r.confidence").alias("c2"), F.col("r.name").alias("n2"))
    return a.join(b, "path").select("path", "mode", "eval_id", "other_id", F.round(F.col("c1") - F.col("c2"), 4).alias("difference"), F.col("n1").eqNullSafe(F.col("n2")).alias("same_name"))


@query(f"""SELECT session, name, set_code, collector_number, seq FROM (SELECT *, row_number() OVER (PARTITION BY session, name ORDER BY seq DESC) AS r FROM {_POOL}) WHERE r = 1""")
def ref_j11_first_record_per_name(spark, d):
    f = facts(spark, d).where("predicted_name is not null").select(F.col("mode").alias("session"), F.col("predicted_name").alias("name"), F.col("predicted_set_code").alias("set_code"), F.col("predicted_collector_number").alias("collector_number"), F.col("eval_id").alias("seq"))
    return newest_per_key(f, ["session", "name"], "seq")


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(round(value, 4)), 2) AS total FROM events GROUP BY ALL""")
def extra_event_hours(spark, d):
    """Tumbling hours over the events; the batch form of a windowed stream, beyond the reference."""
    w = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(F.round("value", 4)), 2).alias("total"))
    return w.select("event_type", F.col("w.start").alias("hour"), "n", "total")



QUERIES, SQL = query.queries, query.sql
