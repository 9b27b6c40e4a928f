"""Queries of ranking, scoring and fingerprints over the order lines and the embeddings.

The tables hold no candidate lists, so the lines of an order stand for an observation's candidates:
the return flag is the name, part and supplier give number and set, discount and tax the score and
the notes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.functions import vectors as V
from weftline.operators import scoring as S
from weftline.plans.registry import Registry
from weftline.session import table

query = Registry()


def candidates(spark, d):
    li = table(spark, d, "lineitem")
    notes = F.array_compact(F.array(
        F.when(F.col("l_quantity") > 40, "exact"), F.when(F.col("l_tax") > 0.05, "type_line_match"), F.when(F.col("l_linestatus") == "O", "set_symbol_match"),
        F.when(F.col("l_quantity") < 8, "art_match"), F.when(F.col("l_tax") < 0.02, "lower_text_mismatch"), F.when(F.col("l_partkey") % 7 == 0, "noisy_title_ocr"),
    ))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("obs_id"), F.row_number().over(w).alias("ord"), F.col("l_returnflag").alias("name"), F.round(F.col("l_discount") * 4 + 0.55, 4).alias("score"),
        F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 3).cast("string")).alias("set_code"), (F.col("l_partkey") % 5).cast("string").alias("collector_number"), notes.alias("notes"), (F.col("l_partkey") % 4 == 0).alias("is_expected"),
    )


_C = """(SELECT l_orderkey AS obs_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_returnflag AS name, round(l_discount * 4 + 0.55, 4) AS score,
 CASE WHEN l_suppkey % 3 > 0 THEN (l_suppkey % 3)::VARCHAR END AS set_code, (l_partkey % 5)::VARCHAR AS collector_number,
 list_filter([CASE WHEN l_quantity > 40 THEN 'exact' END, CASE WHEN l_tax > 0.05 THEN 'type_line_match' END, CASE WHEN l_linestatus = 'O' THEN 'set_symbol_match' END, CASE WHEN l_quantity < 8 THEN 'art_match' END,
  CASE WHEN l_tax < 0.02 THEN 'lower_text_mismatch' END, CASE WHEN l_partkey % 7 = 0 THEN 'noisy_title_ocr' END], lambda x: x IS NOT NULL) AS notes, l_partkey % 4 = 0 AS is_expected FROM lineitem)"""
_R = f"(SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, ord) AS rn FROM {_C})"
_RN = f"(SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY score DESC, name, ord) AS rn FROM {_C})"


@query(f"SELECT obs_id, ord, name, score, rn FROM {_RN}")
def ref_w1_rank_candidates(spark, d):
    return S.ranked(candidates(spark, d)).select("obs_id", "ord", "name", "score", "rn")


def _noted(weights: dict, col: str) -> str:
    return " + ".join(f"CASE WHEN list_contains({col}, '{n}') THEN {w}::DOUBLE ELSE 0::DOUBLE END" for n, w in weights.items())


_PEN = """CASE WHEN same_name = 0 THEN 0.0::DOUBLE WHEN list_contains(notes, 'set_symbol_match') AND list_contains(notes, 'art_match') THEN least(0.16::DOUBLE, same_name * 0.035::DOUBLE) * 0.4::DOUBLE
 WHEN list_contains(notes, 'set_symbol_match') OR list_contains(notes, 'art_match') THEN least(0.16::DOUBLE, same_name * 0.035::DOUBLE) * 0.65::DOUBLE ELSE least(0.16::DOUBLE, same_name * 0.035::DOUBLE) + 0.035::DOUBLE END"""
_CONF = f"""SELECT obs_id, best_name, round(greatest(0.0, best - second), 4) AS margin, same_name, round({_PEN}, 4) AS penalty,
 greatest(0.0, least(1.0, round(best + least(0.08, greatest(0.0, best - second) * 0.24) + ({_noted(S.CONFIDENCE_NOTES, 'notes')}) - round({_PEN}, 4), 4))) AS confidence
FROM (SELECT b.obs_id, b.name AS best_name, b.score AS best, b.notes, coalesce(max(r.score) FILTER (r.rn = 2), 0.0) AS second,
 count(*) FILTER (r.rn > 1 AND r.name = b.name AND (r.set_code IS DISTINCT FROM b.set_code OR r.collector_number IS DISTINCT FROM b.collector_number) AND b.score - r.score <= 0.12) AS same_name
 FROM {_R} b JOIN {_R} r USING (obs_id) WHERE b.rn = 1 GROUP BY ALL)"""


@query(_CONF)
def ref_d4_d5_w3_w4_confidence(spark, d):
    return S.confidence(candidates(spark, d))


_SUP = "len(list_intersect(notes, ['type_line_match', 'lower_text_match', 'set_symbol_match', 'art_match'])) > 0"
_EX = "(list_contains(notes, 'exact') AND NOT list_contains(notes, 'noisy_title_ocr'))"


@query(f"""WITH c AS ({_CONF}), t AS (SELECT b.obs_id, b.name, b.score, b.notes, (SELECT count(*) FROM {_RN} x WHERE x.obs_id = b.obs_id) AS n FROM {_RN} b WHERE b.rn = 1),
s AS (SELECT obs_id, name, score FROM {_RN} WHERE rn = 2), o AS (SELECT r.obs_id, arg_min(r.score, r.rn) AS score FROM {_RN} r JOIN t USING (obs_id) WHERE r.name <> t.name GROUP BY 1)
SELECT t.obs_id, coalesce((t.n = 1 AND {_EX} AND confidence >= 0.9) OR (t.n = 1 AND confidence >= 0.94 AND {_SUP}) OR (t.n > 1 AND s.name <> t.name AND {_EX} AND t.score - s.score >= 0.16 AND confidence >= 0.9)
 OR (o.score IS NOT NULL AND confidence >= 0.88 AND t.score - o.score >= 0.18 AND {_SUP}) OR (confidence >= 0.92 AND (list_contains(notes, 'set_symbol_match') OR list_contains(notes, 'art_match'))), false) AS skip
FROM t JOIN c USING (obs_id) LEFT JOIN s USING (obs_id) LEFT JOIN o USING (obs_id)""")
def ref_d6_w9_skip_gates(spark, d):
    c = candidates(spark, d)
    return S.skip_gates(c, S.confidence(c))


@query(f"""WITH b AS (SELECT obs_id, name, score FROM {_RN} WHERE rn = 1), n AS (SELECT r.*, row_number() OVER (PARTITION BY r.obs_id ORDER BY r.rn) AS k FROM {_RN} r JOIN b ON b.obs_id = r.obs_id AND b.name = r.name WHERE b.score - r.score <= 0.12),
f AS (SELECT *, count(*) OVER (PARTITION BY obs_id) AS c FROM n WHERE k <= 6) SELECT obs_id, ord, k FROM f WHERE c >= 2""")
def ref_w5_compare_set(spark, d):
    return S.compare_set(candidates(spark, d), 0.12, 6).select("obs_id", "ord", "k")


@query(f"SELECT obs_id, count(*) = 2 AND min(name) = max(name) AND round(max(score) - min(score), 10) <= 0.08 AS tied FROM {_RN} WHERE rn <= 2 GROUP BY 1")
def ref_w6_tie_gate(spark, d):
    return S.tie_gate(candidates(spark, d), 0.08)


_E = f"(SELECT *, min(CASE WHEN is_expected THEN rn END) OVER (PARTITION BY obs_id) AS e FROM {_R})"


@query(f"""SELECT obs_id, n, expected_rank, expected_score, round(best - expected_score, 4) AS gap, best_other, round(expected_score - best_other, 4) AS margin FROM (SELECT obs_id, count(*) AS n, max(e)::INT AS expected_rank, max(score) AS best,
 max(score) FILTER (rn = e) AS expected_score, coalesce(max(score) FILTER (rn <> e), 0.0) AS best_other FROM {_E} GROUP BY 1)""")
def ref_w10_expected_rank(spark, d):
    return S.expected_ranks(candidates(spark, d))


@query(f"""WITH x AS (SELECT *, max(score) OVER (PARTITION BY obs_id) AS top FROM {_E}), p AS (SELECT *, coalesce(rn = e AND rn > 1 AND (round(top - score, 4) <= 0.08 OR (round(top - score, 4) <= 0.16 AND {_SUP})), false) AS promoted FROM x),
s AS (SELECT *, CASE WHEN promoted THEN least(1.0, round(top + 0.0001, 4)) ELSE score END AS new_score FROM p)
SELECT obs_id, ord, new_score AS score, promoted, row_number() OVER (PARTITION BY obs_id ORDER BY new_score DESC, rn) AS rank FROM s""")
def ref_d10_promote_expected(spark, d):
    return S.promote_expected(candidates(spark, d)).select("obs_id", "ord", "score", "promoted", "rank")


@query(f"""WITH o AS (SELECT obs_id, name AS en, score AS es, set_code AS ec, collector_number AS eno, notes AS enotes FROM {_E} WHERE rn = e),
j AS (SELECT r.obs_id, any_value(r.e) AS e, any_value(es) AS own, any_value(enotes) AS notes, coalesce(max(r.score) FILTER (r.rn <> r.e), 0.0) AS other,
 coalesce(bool_or(r.rn <> r.e AND r.name = en AND (r.set_code IS DISTINCT FROM ec OR r.collector_number IS DISTINCT FROM eno) AND es - r.score <= 0.05), false) AS rival FROM {_E} r LEFT JOIN o USING (obs_id) GROUP BY 1)
SELECT obs_id, coalesce(e = 1, false) AS matches, coalesce(CASE WHEN own IS NOT NULL THEN greatest(0.0, least(1.0, round(own + least(0.12, greatest(0.0, round(own - other, 4)) * 0.3) + ({_noted(S.CONFIRMATION_NOTES, 'notes')})
 - CASE WHEN e > 1 THEN least(0.2, abs(round(own - other, 4)) * 0.5) + 0.2 WHEN rival THEN 0.08 ELSE 0 END, 4))) END, 0.0) AS confidence FROM (SELECT obs_id, e, CASE WHEN e IS NOT NULL THEN own END AS own, notes, other, rival FROM j)""")
def ref_d11_confirmation(spark, d):
    return S.confirmation(candidates(spark, d))


def _pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id")


_V = "(SELECT a.vec_id, a.embedding, b.embedding AS other FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_SUM = lambda a, b: f"list_sum([{a}[i]::DOUBLE * {b}[i]::DOUBLE FOR i IN range(1, 65)])"


@query(f"SELECT vec_id, round(greatest(0.0, least(1.0, {_SUM('embedding', 'other')} / (sqrt({_SUM('embedding', 'embedding')}) * sqrt({_SUM('other', 'other')})))), 4) AS cosine FROM {_V}")
def ref_v2_histogram_similarity(spark, d):
    return _pairs(spark, d).select("vec_id", V.histogram_similarity(F.col("embedding"), F.col("other")).alias("cosine"))


@query(f"SELECT vec_id, round(greatest(0.0, 1 - sqrt(list_sum([(embedding[i]::DOUBLE - other[i]::DOUBLE) ** 2 FOR i IN range(1, 65)])) / 255), 4) AS similarity FROM {_V}")
def ref_v3_mean_colour_similarity(spark, d):
    return _pairs(spark, d).select("vec_id", V.mean_colour_similarity(F.col("embedding"), F.col("other")).alias("similarity"))


_NIB = lambda bits: f"lower(array_to_string([to_hex(({bits}[4 * k + 1]::INT * 8 + {bits}[4 * k + 2]::INT * 4 + {bits}[4 * k + 3]::INT * 2 + {bits}[4 * k + 4]::INT)) FOR k IN range(0, len({bits}) // 4)], ''))"
_DH = _NIB("[embedding[8 * r + c + 2] >= embedding[8 * r + c + 1] FOR r IN range(0, 8) FOR c IN range(0, 7)]")
_HASHES = "SELECT vec_id, [embedding[((x // 7) * 8 + x % 7 + 2)::INT] >= embedding[((x // 7) * 8 + x % 7 + 1)::INT] FOR x IN range(0, 56)] AS db, [x::DOUBLE >= list_sum([y::DOUBLE FOR y IN embedding]) / 64 FOR x IN embedding] AS ab FROM embeddings"


@query(f"SELECT vec_id, {_NIB('db')} AS dhash, {_NIB('ab')} AS ahash FROM ({_HASHES})")
def ref_v6_hash_bits(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", V.difference_hash(F.col("embedding"), 8, 8).alias("dhash"), V.average_hash(F.col("embedding"), 64).alias("ahash"))


@query(f"""WITH h AS ({_HASHES}) SELECT a.vec_id, round(1 - len(list_filter(range(1, 57), lambda i: a.db[i] <> b.db[i])) / 56, 4) AS d_similarity, round(1 - len(list_filter(range(1, 65), lambda i: a.ab[i] <> b.ab[i])) / 64, 4) AS a_similarity FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""")
def ref_v1_hash_similarity(spark, d):
    """Each vector's hashes once, then the neighbours' compared."""
    h = table(spark, d, "embeddings").select("vec_id", V.difference_hash(F.col("embedding"), 8, 8).alias("d1"), V.average_hash(F.col("embedding"), 64).alias("a1"))
    j = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("d1").alias("d2"), F.col("a1").alias("a2")), "vec_id")
    return j.select("vec_id", V.hash_similarity(F.col("d1"), F.col("d2"), 14).alias("d_similarity"), V.hash_similarity(F.col("a1"), F.col("a2"), 16).alias("a_similarity"))


_SIM = "(SELECT l_orderkey AS obs_id, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS c, l_discount AS x, l_tax AS y, l_linenumber AS n FROM lineitem)"


@query(f"""SELECT obs_id, n, round(a * 0.5 + b * 0.2 + c * 0.2 + (1 - abs(x - y)) * 0.1, 4) AS symbol, round(a * 0.22 + b * 0.18 + c * 0.45 + x * 0.15, 4) AS art, greatest(0.0, least(1.0, round(0.5 + (c - 0.5) * 0.24, 4))) AS moved FROM {_SIM}""")
def ref_v4_v5_v9_weighted_similarity(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obs_id"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_quantity") / 50).alias("c"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_linenumber").alias("n"))
    return x.select("obs_id", "n", V.symbol_similarity(F.col("a"), F.col("b"), F.col("c"), F.col("x"), F.col("y")).alias("symbol"), V.art_similarity(F.col("a"), F.col("b"), F.col("c"), F.col("x")).alias("art"), V.score_delta(F.lit(0.5), F.col("c"), 0.24).alias("moved"))


def _boxes(spark, d):
    b = G.box(F.col("l_partkey") % 500, F.col("l_suppkey") % 400, F.col("l_quantity") * 12, F.col("l_linenumber") * 130)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.row_number().over(w).alias("n"), b.alias("b"), F.lit(640).alias("fw"), F.lit(480).alias("fh"))


_B = "(SELECT l_orderkey AS frame_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, (l_partkey % 500)::INT AS x, (l_suppkey % 400)::INT AS y, (l_quantity * 12)::INT AS w, (l_linenumber * 130)::INT AS h FROM lineitem)"


@query(f"SELECT frame_id, n, greatest(0, least(x, 640)) AS left, greatest(0, least(y, 480)) AS top, greatest(0, least(w, 640 - greatest(0, least(x, 640)))) AS width, greatest(0, least(h, 480 - greatest(0, least(y, 480)))) AS height FROM {_B}")
def ref_g1_clamp_box(spark, d):
    return _boxes(spark, d).select("frame_id", "n", G.clamp_box(F.col("b"), F.col("fw"), F.col("fh")).alias("c")).select("frame_id", "n", "c.left", "c.top", "c.width", "c.height")


_SCORE = "CASE WHEN w > 0 AND h > 0 THEN round(greatest(0.0, 1 - abs(w / h - 63 / 88) / (63 / 88)) * 0.55 + w::DOUBLE * h / (640 * 480) * 0.3 + CASE WHEN w < 640 AND h < 480 THEN 1.0 ELSE 0.85 END * 0.15, 4) ELSE 0.0 END"


@query(f"SELECT frame_id, arg_max(n, {{'s': {_SCORE}, 'k': -n}}) AS best_n, max({_SCORE}) AS best_score FROM {_B} GROUP BY 1")
def ref_g2_w15_best_box(spark, d):
    b = _boxes(spark, d).withColumn("s", G.box_score(F.col("b"), F.col("fw"), F.col("fh")))
    return b.groupBy("frame_id").agg(F.max_by("n", F.struct("s", -F.col("n"))).alias("best_n"), F.max("s").alias("best_score"))


_EV = lambda e: f"round_even({e}, 0)::INT"


@query(f"""WITH f AS (SELECT DISTINCT 400 + p_size * 5 AS fw, 300 + p_size * (p_size % 3 + 5) AS fh FROM part), a AS (SELECT *, greatest(1, floor(fw * 0.92))::BIGINT AS iw, greatest(1, floor(fh * 0.92))::BIGINT AS ih FROM f),
b AS (SELECT *, CASE WHEN iw / (63 / 88) < ih THEN iw ELSE greatest(1, {_EV('ih * (63 / 88)')}) END::INT AS w, CASE WHEN iw / (63 / 88) < ih THEN greatest(1, {_EV('iw / (63 / 88)')}) ELSE ih END::INT AS h FROM a)
SELECT fw AS frame_width, fh AS frame_height, greatest(0, floor((fw - w) / 2))::INT AS left, greatest(0, floor((fh - h) / 2))::INT AS top, w AS width, h AS height FROM b""")
def ref_g3_centred_box(spark, d):
    f = table(spark, d, "part").select((F.col("p_size") * 5 + 400).alias("frame_width"), (F.col("p_size") * (F.col("p_size") % 3 + 5) + 300).alias("frame_height")).distinct()
    return f.withColumn("b", G.centred_box(F.col("frame_width"), F.col("frame_height"))).select("frame_width", "frame_height", "b.left", "b.top", "b.width", "b.height")


@query(f"""SELECT frame_id, n, least(rx1, rx2) AS left, least(ry1, ry2) AS top FROM (SELECT frame_id, n, CASE n % 4 WHEN 1 THEN y WHEN 2 THEN greatest(0, 639 - x) WHEN 3 THEN greatest(0, 639 - y) ELSE x END::DOUBLE AS rx1,
 CASE n % 4 WHEN 1 THEN greatest(0, 479 - x) WHEN 2 THEN greatest(0, 479 - y) WHEN 3 THEN x ELSE y END::DOUBLE AS ry1, CASE n % 4 WHEN 1 THEN y + h WHEN 2 THEN greatest(0, 639 - x - w) WHEN 3 THEN greatest(0, 639 - y - h) ELSE x + w END::DOUBLE AS rx2,
 CASE n % 4 WHEN 1 THEN greatest(0, 479 - x - w) WHEN 2 THEN greatest(0, 479 - y - h) WHEN 3 THEN x + w ELSE y + h END::DOUBLE AS ry2 FROM {_B})""")
def ref_g9_unrotate(spark, d):
    b = _boxes(spark, d)
    turn = (F.col("n") % 4) * 90
    p = lambda x, y: G.unrotate(x, y, turn, F.col("fw"), F.col("fh"))
    q = b.select("frame_id", "n", p(F.col("b.left"), F.col("b.top")).alias("p1"), p(F.col("b.left") + F.col("b.width"), F.col("b.top") + F.col("b.height")).alias("p2"))
    return q.select("frame_id", "n", F.least("p1.x", "p2.x").alias("left"), F.least("p1.y", "p2.y").alias("top"))


_REG = "(VALUES " + ", ".join(f"('{g}', {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for g, (_, x, y, w, h) in G.REGIONS.items()) + ") r(g, rx, ry, rw, rh)"
_GROW = "CASE WHEN g IN ('art_match', 'set_symbol') THEN 1.0 ELSE 1.2 END"


@query(f"""WITH f AS (SELECT DISTINCT p_size AS s, 300 + p_size * 5 AS fw, 420 + p_size * 7 AS fh FROM part), a AS (SELECT *, greatest(0, {_EV('fw * rx')}) AS bl, greatest(0, {_EV('fh * ry')}) AS bt FROM f CROSS JOIN {_REG}),
b AS (SELECT *, greatest(1, least(fw, bl + greatest(1, {_EV('fw * rw')})) - bl) AS bw, greatest(1, least(fh, bt + greatest(1, {_EV('fh * rh')})) - bt) AS bh FROM a),
c AS (SELECT *, bw * CASE WHEN bw >= bh THEN {_GROW} ELSE 1.0 END AS tw, bh * CASE WHEN bw >= bh THEN 1.0 ELSE {_GROW} END AS th FROM b),
e AS (SELECT s, g, greatest(0, {_EV('bl + bw / 2 - tw / 2')}) AS x0, greatest(0, {_EV('bt + bh / 2 - th / 2')}) AS y0, least(fw, {_EV('bl + bw / 2 + tw / 2')}) AS x1, least(fh, {_EV('bt + bh / 2 + th / 2')}) AS y1 FROM c)
SELECT s AS size, g AS region, x0 AS left, y0 AS top, greatest(1, x1 - x0) AS width, greatest(1, y1 - y0) AS height FROM e""")
def ref_g4_g6_g11_region_boxes(spark, d):
    """Every preset region in pixels of frames of several sizes, text regions grown by a fifth."""
    frames = table(spark, d, "part").select(F.col("p_size").alias("size"), (F.col("p_size") * 5 + 300).alias("fw"), (F.col("p_size") * 7 + 420).alias("fh")).distinct()
    presets = F.array(*(F.struct(F.lit(g).alias("region"), *(F.lit(float(v)).alias(k) for k, v in zip("xywh", r[1:]))) for g, r in G.REGIONS.items()))
    p = frames.select("size", "fw", "fh", F.inline(presets))
    grow = F.when(F.col("region").isin(*G.NOT_GROWN), 1.0).otherwise(1.2)
    b = G.region_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("fw"), F.col("fh"), grow, F.lit(1.0))
    return p.select("size", "region", b.alias("b")).select("size", "region", "b.left", "b.top", "b.width", "b.height")


QUERIES, SQL = query.queries, query.sql
