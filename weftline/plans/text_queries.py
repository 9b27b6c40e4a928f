"""Queries of the text functions over names, aliases, recognised lines and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.keys import clean_optional
from weftline.plans.registry import Registry
from weftline.session import table

query = Registry()


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(translate(replace(lower({x}), 'ß', 'ss'), '''’`´', ''), '[^0-9a-z]+', ' ', 'g'))"


_TOK = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
_WS = r"[\s\x{1c}-\x{1f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def clean_sql(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '')"


def squeeze_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


def _names(spark, d):
    return table(spark, d, "oracle_cards").select("id", "name", "normalized_name", "type_line", "oracle_text").distinct()


_N = "(SELECT DISTINCT id, name, normalized_name, type_line, oracle_text FROM oracle_cards)"


@query(f"SELECT id, {norm_sql('name')} AS norm, normalized_name IS NOT DISTINCT FROM {norm_sql('name')} AS agrees FROM {_N}")
def ref_t1_normalize_text(spark, d):
    n = T.normalize_text(F.col("name"))
    return _names(spark, d).select("id", n.alias("norm"), n.eqNullSafe(F.col("normalized_name")).alias("agrees"))


@query(f"""WITH p AS (SELECT id, '  ' || normalized_name || ' ' AS p FROM {_N} WHERE normalized_name IS NOT NULL)
SELECT id, list_sort(list_distinct([substring(p, i, 3) FOR i IN range(1, length(p) - 1)])) AS grams FROM p""")
def ref_t2_trigrams(spark, d):
    return _names(spark, d).where("normalized_name is not null").select("id", F.array_sort(T.trigrams(F.col("normalized_name"))).alias("grams"))


def _lines(spark, d):
    return table(spark, d, "recognition_results").groupBy("obs_id").agg(F.min_by("ocr_lines", F.struct("ingested_at", F.coalesce("ocr_lines", F.array().cast("array<string>")))).alias("ocr_lines")).select("obs_id", F.coalesce("ocr_lines", F.array().cast("array<string>")).alias("ocr_lines"))


_L = "(SELECT obs_id, coalesce(ocr_lines, []) AS ocr_lines FROM recognition_results QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY ingested_at, coalesce(ocr_lines, [])) = 1)"


@query(f"""WITH q AS (SELECT obs_id, {norm_sql('l')} AS n FROM (SELECT obs_id, unnest(ocr_lines) AS l FROM {_L}) WHERE l IS NOT NULL)
SELECT obs_id, n, n <> '' AND len(list_filter(string_split(n, ' '), lambda t: regexp_full_match(t, '[0-9]+'))) > 0 AS noisy,
 round(CASE WHEN n = '' THEN 0.0 ELSE greatest(0.0, least(length(n) / 24.0, 1.0) - greatest(len(list_filter(string_split(n, ' '), lambda t: t <> '')) - 2, 0) * 0.08
  - CASE WHEN len(list_filter(string_split(n, ' '), lambda t: regexp_full_match(t, '[0-9]+'))) > 0 THEN 0.18 ELSE 0.0 END) END, 6) AS quality FROM q""")
def ref_t6_t7_title_quality(spark, d):
    q = _lines(spark, d).select("obs_id", F.explode("ocr_lines").alias("l")).where("l is not null").select("obs_id", T.normalize_text(F.col("l")).alias("n"))
    return q.select("obs_id", "n", T.contains_noise(F.col("n")).alias("noisy"), F.round(T.title_quality(F.col("n")), 6).alias("quality"))


def _clean_line(x: str) -> str:
    bare = r"regexp_replace(t, '^[\[\](){}<>]+|[\[\](){}<>]+$', '', 'g')"
    return f"array_to_string(list_filter(string_split({squeeze_sql(x)}, ' '), lambda t: NOT ({bare} = '' OR regexp_full_match({bare}, '[0-9]{{1,2}}'))), ' ')"


@query(f"SELECT obs_id, coalesce(array_to_string(list_slice(list_filter([{_clean_line('x')} FOR x IN ocr_lines], lambda y: y <> ''), 1, 2), ' '), '') AS title FROM {_L}")
def ref_t8_f14_clean_title(spark, d):
    return _lines(spark, d).select("obs_id", T.clean_title_query(F.col("ocr_lines")).alias("title"))


@query(f"""WITH x AS (SELECT obs_id, {norm_sql('l')} AS n FROM (SELECT obs_id, unnest(ocr_lines) AS l FROM {_L}))
SELECT obs_id, count(*) AS n_lines, count(*) FILTER (len(list_filter(string_split(n, ' '), lambda t: t <> '')) BETWEEN 1 AND 3 AND NOT regexp_matches(n, '[0-9]') AND length(n) BETWEEN 3 AND 32) AS n_fragments FROM x GROUP BY obs_id""")
def ref_t9_title_fragments(spark, d):
    x = _lines(spark, d).select("obs_id", F.explode("ocr_lines").alias("l"))
    return x.groupBy("obs_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_title_fragment(F.col("l"))).alias("n_fragments"))


_FRAGMENT = f"len(list_filter(string_split({norm_sql('y')}, ' '), lambda t: t <> '')) BETWEEN 1 AND 3 AND NOT regexp_matches({norm_sql('y')}, '[0-9]') AND length({norm_sql('y')}) BETWEEN 3 AND 32"
SPLIT_SQL = f"""k AS (SELECT * EXCLUDE (ocr_lines), list_filter([{_clean_line('x')} FOR x IN ocr_lines], lambda y: y <> '') AS kept FROM src),
p AS (SELECT *, list_filter(kept, lambda y: {_FRAGMENT}) AS parts FROM k),
e AS (SELECT *, list_concat(kept, CASE WHEN len(parts) >= 2 THEN [parts[1] || ' // ' || parts[2], parts[2] || ' // ' || parts[1]] ELSE [] END, [array_to_string(kept[1:2], ' ')]) AS every FROM p),
n AS (SELECT *, list_filter([{norm_sql('x')} FOR x IN every], lambda y: y <> '') AS norms FROM e),
split AS (SELECT *, list_filter(norms, lambda y, i: list_position(norms, y) = i) AS queries FROM n)"""


@query(f"WITH src AS (SELECT obs_id, ocr_lines FROM {_L} WHERE len(ocr_lines) > 0), {SPLIT_SQL} SELECT obs_id, queries FROM split")
def ref_t10_split_title_queries(spark, d):
    return _lines(spark, d).where(F.size("ocr_lines") > 0).select("obs_id", T.split_title_queries(F.col("ocr_lines")).alias("queries"))


@query(f"SELECT obs_id, list_sort(list_distinct(regexp_extract_all(lower(array_to_string(ocr_lines, ' ')), '([a-z]{{3,}})', 1))) AS words FROM {_L}")
def ref_t12_title_tokens(spark, d):
    return _lines(spark, d).select("obs_id", F.array_sort(T.title_tokens(F.col("ocr_lines"))).alias("words"))


_SIDE = lambda i: clean_sql(f"CASE WHEN contains(name, ' // ') THEN {'substring(name, 1, strpos(name, ' + chr(39) + ' // ' + chr(39) + ') - 1)' if i == 0 else 'substring(name, strpos(name, ' + chr(39) + ' // ' + chr(39) + ') + 4)'} END")


@query(f"SELECT id, {_SIDE(0)} AS face_a, {_SIDE(1)} AS face_b FROM {_N} WHERE {_SIDE(0)} IS NOT NULL AND {_SIDE(1)} IS NOT NULL")
def ref_t13_face_names(spark, d):
    f = T.face_names(F.col("name"))
    return _names(spark, d).where(f.isNotNull()).select("id", f[0].alias("face_a"), f[1].alias("face_b"))


@query(f"""SELECT CASE WHEN lower(coalesce(type_line, '')) LIKE '%room%' THEN 'room' WHEN len(string_split(name, ' // ')) >= 3 THEN 'multi_split'
 WHEN lower(coalesce(oracle_text, '')) LIKE '%aftermath%' THEN 'aftermath' WHEN lower(coalesce(oracle_text, '')) LIKE '%fuse%' THEN 'fuse'
 WHEN len(string_split(name, ' // ')) = 2 THEN 'classic_split' ELSE 'other_split' END AS family, count(*) AS n FROM {_N} GROUP BY 1""")
def ref_t14_layout_family(spark, d):
    t, o, n = F.lower(F.coalesce("type_line", F.lit(""))), F.lower(F.coalesce("oracle_text", F.lit(""))), F.size(F.split("name", " // "))
    fam = F.when(t.contains("room"), "room").when(n >= 3, "multi_split").when(o.contains("aftermath"), "aftermath").when(o.contains("fuse"), "fuse").when(n == 2, "classic_split").otherwise("other_split")
    return _names(spark, d).groupBy(fam.alias("family")).agg(F.count("*").alias("n"))


@query(f"SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {_N} WHERE name IS NOT NULL")
def ref_t15_slugify(spark, d):
    return _names(spark, d).where("name is not null").select("id", T.slugify(F.col("name")).alias("slug"))


_PART = lambda c: f"nullif(lower({squeeze_sql(c)}), '')"


@query(f"""SELECT eval_id, CASE WHEN {_PART('predicted_set_code')} IS NOT NULL AND {_PART('predicted_collector_number')} IS NOT NULL THEN 'printing:' || {_PART('predicted_set_code')} || ':' || {_PART('predicted_collector_number')}
 WHEN nullif({norm_sql('predicted_name')}, '') IS NOT NULL THEN 'name:' || {norm_sql('predicted_name')} ELSE 'unrecognized' END AS card_id
FROM (SELECT DISTINCT eval_id, predicted_name, predicted_set_code, predicted_collector_number FROM evaluations)""")
def ref_t16_observed_card_id(spark, d):
    e = table(spark, d, "evaluations").select("eval_id", "predicted_name", "predicted_set_code", "predicted_collector_number").distinct()
    return e.select("eval_id", T.observed_card_id(F.col("predicted_name"), F.col("predicted_set_code"), F.col("predicted_collector_number"), "unrecognized").alias("card_id"))


_STEM = r"regexp_replace(regexp_replace(regexp_replace(fixture, '^.*/', ''), '\.[^.]*$', ''), '-[0-9a-f]{8}$', '')"


@query(f"""SELECT fixture, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(replace({_STEM}, '-', ' '), ' ')], ' ') AS inferred, count(*) AS n FROM scan_results WHERE fixture IS NOT NULL GROUP BY ALL""")
def ref_t17_name_from_path(spark, d):
    return table(spark, d, "scan_results").where("fixture is not null").groupBy("fixture", T.name_from_path(F.col("fixture")).alias("inferred")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT obs_id, i, {squeeze_sql('l')} AS l FROM (SELECT obs_id, unnest(ocr_lines) AS l, generate_subscripts(ocr_lines, 1) AS i FROM {_L})),
f AS (SELECT *, row_number() OVER (PARTITION BY obs_id, {norm_sql('l')} ORDER BY i) AS r FROM c WHERE l <> '')
SELECT obs_id, list(l ORDER BY i) AS lines FROM f WHERE r = 1 GROUP BY obs_id""")
def ref_t19_distinct_lines(spark, d):
    return _lines(spark, d).select("obs_id", T.distinct_lines(F.col("ocr_lines")).alias("lines")).where(F.size("lines") > 0)


@query(f"""WITH p AS (SELECT DISTINCT eval_id, {norm_sql('expected_name')} AS a, {norm_sql('predicted_name')} AS b FROM evaluations WHERE expected_name IS NOT NULL AND predicted_name IS NOT NULL)
SELECT eval_id, a, b, round(CASE WHEN len({_TOK('a')}) > 0 THEN len(list_intersect({_TOK('a')}, {_TOK('b')})) / len({_TOK('a')}) ELSE 0.0 END, 6) AS overlap, contains(a, b) OR contains(b, a) AS related FROM p""")
def ref_u3_t20_token_overlap(spark, d):
    a, b = T.normalize_text(F.col("expected_name")), T.normalize_text(F.col("predicted_name"))
    p = table(spark, d, "evaluations").where("expected_name is not null and predicted_name is not null").select("eval_id", a.alias("a"), b.alias("b")).distinct()
    return p.select("*", F.round(T.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"), (F.contains("a", "b") | F.contains("b", "a")).alias("related"))


@query()
def ref_t3_t4_gestalt_fuzzy_score(spark, d):
    """Similarity of expected and predicted names, once per distinct pair."""
    a, b = T.normalize_text(F.col("expected_name")), T.normalize_text(F.col("predicted_name"))
    p = table(spark, d, "evaluations").where("expected_name is not null and predicted_name is not null").select(a.alias("a"), b.alias("b")).distinct()
    r = p.withColumn("ratio", T.gestalt_ratio("a", "b"))
    return r.select("a", "b", F.round("ratio", 6).alias("ratio"), F.round(T.fuzzy_score(F.col("ratio"), F.col("a"), F.col("b")), 6).alias("score"), F.round(T.compatibility_score(F.col("ratio"), F.col("a"), F.col("b")), 6).alias("compatibility"))


@query(f"SELECT eval_id, {clean_sql('expected_set_code')} AS set_code, {clean_sql('mode')} AS mode FROM (SELECT DISTINCT eval_id, expected_set_code, mode FROM evaluations)")
def ref_p1_clean_optional(spark, d):
    e = table(spark, d, "evaluations").select("eval_id", "expected_set_code", "mode").distinct()
    return e.select("eval_id", clean_optional(F.col("expected_set_code")).alias("set_code"), clean_optional(F.col("mode")).alias("mode"))


QUERIES, SQL = query.queries, query.sql
