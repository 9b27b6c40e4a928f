"""Queries of the catalogue: scans, cleaning, joins, lookups, counts, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.keys import fold_key
from weftline.functions.text import normalize_text, trigrams
from weftline.operators import catalog as C
from weftline.plans.registry import Registry
from weftline.plans.text_queries import norm_sql
from weftline.session import table

query = Registry()
_KEY = lambda c: f"nullif(lower(trim({c}, E' \\t\\n\\r')), '')"


def identities(spark, d):
    """One row an identity id, the earliest delivery."""
    cols = ["id", "name", "normalized_name", "layout", "type_line", "oracle_text", "colors"]
    return C.first_wins(table(spark, d, "oracle_cards").where("oracle_id is not null"), "oracle_id", "ingested_at", cols)


def variants(spark, d, *more):
    """One row a printing id, the earliest delivery; ``more`` are columns beyond the usual ones."""
    cols = ["scryfall_id", "oracle_id", "set_code", "collector_number", "released_at", "image_uri", *more]
    return C.first_wins(table(spark, d, "printed_cards"), "id", "ingested_at", cols)


_IDENT = "(SELECT * FROM oracle_cards WHERE oracle_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY oracle_id ORDER BY ingested_at, id) = 1)"
_VAR = "(SELECT * FROM printed_cards QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_VIEW = f"(SELECT v.*, i.name, i.normalized_name, i.type_line, i.layout, i.oracle_id AS identity_id FROM {_VAR} v JOIN {_IDENT} i ON {_KEY('v.oracle_id')} = {_KEY('i.oracle_id')})"


def view(spark, d, *more):
    i = identities(spark, d).select(F.col("oracle_id").alias("identity_id"), fold_key(F.col("oracle_id")).alias("oracle_key"), "name", "normalized_name", "type_line", "layout")
    return variants(spark, d, *more).withColumn("oracle_key", fold_key(F.col("oracle_id"))).join(i, "oracle_key")


@query(f"SELECT oracle_id, name, normalized_name, type_line FROM {_IDENT}")
def ref_a2_first_wins_identity(spark, d):
    return identities(spark, d).select("oracle_id", "name", "normalized_name", "type_line")


@query(f"SELECT id, scryfall_id, identity_id, name, set_code, collector_number FROM {_VIEW}")
def ref_j1_j2_cards_view(spark, d):
    return view(spark, d).select("id", "scryfall_id", "identity_id", "name", "set_code", "collector_number")


@query(f"""WITH a AS (SELECT card_id, list_sort(list(DISTINCT alias)) AS aliases FROM aliases WHERE alias IS NOT NULL GROUP BY card_id)
SELECT v.id, v.printed_name, coalesce(a.aliases, []) AS aliases FROM {_VAR} v LEFT JOIN a ON a.card_id = v.id""")
def ref_j3_a1_fold_aliases(spark, d):
    return C.fold_aliases(variants(spark, d, "printed_name").select("id", "printed_name"), table(spark, d, "aliases"), "id", "card_id").select("id", "printed_name", "aliases")


@query(f"SELECT a.id AS alias_id, v.scryfall_id FROM (SELECT DISTINCT id, card_id FROM aliases) a JOIN {_VAR} v ON v.id = a.card_id")
def ref_j4_alias_natural_key(spark, d):
    return table(spark, d, "aliases").select(F.col("id").alias("alias_id"), "card_id").distinct().join(variants(spark, d).select(F.col("id").alias("card_id"), "scryfall_id"), "card_id").select("alias_id", "scryfall_id")


@query(f"""WITH a AS (SELECT {_KEY('v.oracle_id')} AS k, a.alias FROM aliases a JOIN {_VAR} v ON v.id = a.card_id WHERE a.alias IS NOT NULL)
SELECT w.oracle_key, w.name, w.n_variants, coalesce(x.aliases, []) AS aliases FROM (SELECT {_KEY('identity_id')} AS oracle_key, min(name) AS name, count(DISTINCT id) AS n_variants FROM {_VIEW} GROUP BY 1) w
LEFT JOIN (SELECT k, list_sort(list(DISTINCT alias)) AS aliases FROM a GROUP BY k) x ON x.k = w.oracle_key""")
def ref_a3_identity_groups(spark, d):
    v = view(spark, d)
    groups = v.groupBy("oracle_key").agg(F.min("name").alias("name"), F.count_distinct("id").alias("n_variants"))
    a = table(spark, d, "aliases").where("alias is not null").join(v.select(F.col("id").alias("card_id"), "oracle_key"), "card_id").select("oracle_key", "alias").distinct()
    listed = a.groupBy("oracle_key").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return groups.join(listed, "oracle_key", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


@query("SELECT (SELECT count(DISTINCT id) FROM printed_cards) AS card_count, (SELECT count(DISTINCT oracle_id) FROM oracle_cards) AS oracle_count, (SELECT count(DISTINCT id) FROM aliases) AS alias_count")
def ref_a4_counts(spark, d):
    c = table(spark, d, "printed_cards").agg(F.count_distinct("id").alias("card_count"))
    o = table(spark, d, "oracle_cards").agg(F.count_distinct("oracle_id").alias("oracle_count"))
    a = table(spark, d, "aliases").agg(F.count_distinct("id").alias("alias_count"))
    return c.join(F.broadcast(o)).join(F.broadcast(a))  # one row each


@query(f"SELECT id, coalesce(nullif(trim(oracle_id, E' \\t\\n\\r'), ''), 'printing:' || scryfall_id) AS identity_key FROM {_VAR}")
def ref_p3_derived_key(spark, d):
    return variants(spark, d).select("id", C.derived_key(F.col("oracle_id"), F.col("scryfall_id")).alias("identity_key"))


@query(f"SELECT language, count(*) AS n FROM {_VAR} WHERE language = 'en' AND CASE WHEN list_contains([lower(g) FOR g IN games], 'paper') THEN true WHEN len(games) > 0 THEN false ELSE true END GROUP BY 1")
def ref_f1_f2_language_and_paper(spark, d):
    return variants(spark, d, "language", "games").where((F.col("language") == "en") & C.is_paper(F.col("games"), F.lit(None).cast("boolean"))).groupBy("language").agg(F.count("*").alias("n"))


@query(f"SELECT id, name, set_code, collector_number, released_at FROM {_VIEW} WHERE normalized_name = 'emberkin wisp' AND lower(set_code) = 'm9q5'")
def ref_f4_predicates(spark, d):
    return view(spark, d).where(C.predicates(name="Emberkin Wisp", set_code="M9Q5")).select("id", "name", "set_code", "collector_number", "released_at")


@query(f"""WITH h AS (SELECT oracle_id, name, normalized_name FROM {_IDENT} WHERE contains(normalized_name, 'beacon'))
SELECT oracle_id, name FROM h WHERE normalized_name = 'beacon' OR NOT EXISTS (SELECT 1 FROM h WHERE normalized_name = 'beacon') ORDER BY name, oracle_id LIMIT 20""")
def ref_f5_k1_exact_then_like(spark, d):
    return C.exact_then_like(identities(spark, d).select("oracle_id", "name", "normalized_name"), "normalized_name", "beacon").orderBy("name", "oracle_id").limit(20).select("oracle_id", "name")


@query(f"SELECT count(*) AS n FROM {_VAR} WHERE length(trim(image_uri)) > 0")
def ref_f6_count_images(spark, d):
    return variants(spark, d).where(F.length(F.trim("image_uri")) > 0).agg(F.count("*").alias("n"))


@query(f"""SELECT scryfall_id, set_code, collector_number, min(id) AS id FROM {_VAR} WHERE length(trim(image_uri)) > 0 AND (len(games) = 0 OR games IS NULL OR list_contains([lower(g) FOR g IN games], 'paper')) GROUP BY ALL""")
def ref_f7_distinct_images(spark, d):
    paper = (F.size("games") == 0) | F.col("games").isNull() | F.array_contains(F.transform("games", lambda g: F.lower(g)), "paper")
    return variants(spark, d, "games").where((F.length(F.trim("image_uri")) > 0) & paper).groupBy("scryfall_id", "set_code", "collector_number").agg(F.min("id").alias("id"))


@query(f"SELECT layout, count(*) AS n, min(released_at) AS first_release FROM {_VIEW} WHERE contains(name, ' // ') GROUP BY 1")
def ref_f8_split_layouts(spark, d):
    return view(spark, d).where(F.contains("name", F.lit(" // "))).groupBy("layout").agg(F.count("*").alias("n"), F.min("released_at").alias("first_release"))


@query(f"SELECT id, name, set_code, released_at FROM {_VIEW} WHERE contains(name, ' // ') AND layout IS NOT NULL")
def ref_k6_split_order(spark, d):
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return view(spark, d).where(F.contains("name", F.lit(" // ")) & F.col("layout").isNotNull()).orderBy(low("released_at"), F.lower("name"), low("set_code"), low("collector_number"), "id").select("id", "name", "set_code", "released_at")


@query(f"SELECT id, set_code, collector_number, released_at FROM {_VIEW} WHERE normalized_name = 'mudgrave servant'")
def ref_i3_k2_printings_for_name(spark, d):
    order = [F.col("released_at").desc_nulls_last(), F.col("set_code").asc_nulls_first(), F.col("collector_number").asc_nulls_first(), "id"]
    return view(spark, d).where(C.predicates(name="Mudgrave Servant")).orderBy(*order).select("id", "set_code", "collector_number", "released_at")


def _queries(spark, d):
    r = table(spark, d, "recognition_results").where("best_name is not null").groupBy("obs_id").agg(F.min("best_name").alias("b"))
    return r.select(F.col("obs_id").alias("q_id"), normalize_text(F.col("b")).alias("query")).where("query <> ''")


_Q = f"(SELECT obs_id AS q_id, {norm_sql('b')} AS query FROM (SELECT obs_id, min(best_name) AS b FROM recognition_results WHERE best_name IS NOT NULL GROUP BY 1) WHERE {norm_sql('b')} <> '')"


def _entries(spark, d):
    v = view(spark, d).select(F.col("id").alias("card_id"), F.col("identity_id").alias("key"))
    names = identities(spark, d).select(F.col("normalized_name").alias("normalized"), F.col("oracle_id").alias("key")).where("normalized <> ''").distinct()
    aliases = table(spark, d, "aliases").where("normalized_alias <> ''").select("card_id", F.col("normalized_alias").alias("normalized")).distinct().join(v, "card_id").select("normalized", "key").distinct()
    return names, aliases


_ALIAS = f"(SELECT DISTINCT a.normalized_alias AS normalized, w.identity_id AS key FROM aliases a JOIN {_VIEW} w ON w.id = a.card_id WHERE a.normalized_alias <> '')"
_HITS = f"""SELECT q_id, query, key, min(source) AS source FROM (SELECT q.q_id, q.query, i.oracle_id AS key, 0 AS source FROM {_Q} q JOIN {_IDENT} i ON i.normalized_name = q.query
 UNION ALL SELECT q.q_id, q.query, a.key, 1 FROM {_Q} q JOIN {_ALIAS} a ON a.normalized = q.query) GROUP BY ALL"""


@query(f"SELECT q_id, count(*) AS n_identities, min(key) AS first_key, min(source) AS best_source FROM ({_HITS}) GROUP BY 1")
def ref_j5_u1_exact_lookup(spark, d):
    names, aliases = _entries(spark, d)
    hits = C.exact_summary(_queries(spark, d), names, aliases)
    return hits.select("q_id", F.col("n_keys").alias("n_identities"), "first_key", F.col("source").alias("best_source"))


@query(f"""SELECT s.snapshot_no, s.scryfall_id, count(DISTINCT v.id) AS n FROM (SELECT DISTINCT snapshot_no, scryfall_id FROM catalog_snapshots WHERE scryfall_id IS NOT NULL) s JOIN {_VAR} v ON lower(v.scryfall_id) = lower(s.scryfall_id) GROUP BY ALL""")
def ref_j6_id_lookup_without_case(spark, d):
    s = table(spark, d, "catalog_snapshots").where("scryfall_id is not null").select("snapshot_no", "scryfall_id").distinct()
    v = variants(spark, d).select(F.lower("scryfall_id").alias("k"), "id")
    return s.join(v, F.lower(s["scryfall_id"]) == v["k"]).groupBy("snapshot_no", "scryfall_id").agg(F.count_distinct("id").alias("n"))


_REQ = "(SELECT eval_id AS q_id, min(expected_name) AS name, min(expected_set_code) AS set_code, min(expected_collector_number) AS collector_number FROM evaluations WHERE expected_name IS NOT NULL GROUP BY 1)"


@query(f"""WITH j AS (SELECT q.q_id, q.set_code IS NULL AND q.collector_number IS NULL AS bare, count(*) AS n, min(w.id) AS record_id FROM {_REQ} q JOIN {_VIEW} w ON w.name = q.name
 WHERE (q.set_code IS NULL OR lower(q.set_code) = lower(coalesce(w.set_code, ''))) AND (q.collector_number IS NULL OR lower(q.collector_number) = lower(coalesce(w.collector_number, ''))) GROUP BY 1, 2)
SELECT q_id, record_id FROM j WHERE NOT bare OR n = 1""")
def ref_j7_find_record(spark, d):
    r = table(spark, d, "evaluations").where("expected_name is not null").groupBy(F.col("eval_id").alias("q_id")).agg(F.min("expected_name").alias("name"), F.min("expected_set_code").alias("set_code"), F.min("expected_collector_number").alias("collector_number"))
    records = view(spark, d).select("name", "set_code", "collector_number", F.col("id").alias("record_id"))
    return C.unique_or_filtered(r, records)


@query(f"""WITH n AS (SELECT DISTINCT normalized_name AS key, '  ' || normalized_name || ' ' AS p FROM {_IDENT} WHERE normalized_name <> ''),
ng AS (SELECT DISTINCT key, substring(p, i, 3) AS g FROM (SELECT key, p, unnest(range(1, length(p) - 1)) AS i FROM n)),
q AS (SELECT DISTINCT query, '  ' || query || ' ' AS p FROM {_Q}), qg AS (SELECT DISTINCT query, substring(p, i, 3) AS g FROM (SELECT query, p, unnest(range(1, length(p) - 1)) AS i FROM q)),
c AS (SELECT query, key, count(*) AS shared FROM qg JOIN ng USING (g) GROUP BY ALL)
SELECT query, count(*) AS n_blocked, max(shared) AS most_shared FROM c GROUP BY 1""")
def ref_j9_trigram_blocking(spark, d):
    q = _queries(spark, d).select("query").distinct().select(F.col("query").alias("q_id"), trigrams(F.col("query")).alias("grams"))
    n = identities(spark, d).where("normalized_name <> ''").select(F.col("normalized_name").alias("key")).distinct().withColumn("grams", trigrams(F.col("key")))
    return C.blocked_counts(q, n).withColumnRenamed("q_id", "query")


@query(f"""SELECT e.eval_id, min(w.id) AS record_id, count(DISTINCT s.id) AS n_siblings FROM (SELECT DISTINCT eval_id, expected_set_code, expected_collector_number FROM evaluations) e
JOIN {_VIEW} w ON lower(w.set_code) = lower(e.expected_set_code) AND lower(w.collector_number) = lower(e.expected_collector_number) JOIN (SELECT identity_id, count(*) AS c, list(id) AS ids FROM {_VIEW} GROUP BY 1) g ON g.identity_id = w.identity_id
JOIN (SELECT identity_id, id FROM {_VIEW}) s ON s.identity_id = w.identity_id GROUP BY 1""")
def ref_j16_siblings_of_expected(spark, d):
    """Record of each expected printing and the number of its identity's printings, counted once an identity."""
    e = table(spark, d, "evaluations").select("eval_id", F.lower("expected_set_code").alias("s"), F.lower("expected_collector_number").alias("c")).distinct()
    v = view(spark, d).select("id", "identity_id", F.lower("set_code").alias("s"), F.lower("collector_number").alias("c"))
    size = v.groupBy("identity_id").agg(F.count_distinct("id").alias("n"))
    hit = e.join(v, ["s", "c"]).join(size, "identity_id")
    per = hit.groupBy("eval_id", "identity_id").agg(F.min("id").alias("record_id"), F.max("n").alias("n"))
    return per.groupBy("eval_id").agg(F.min("record_id").alias("record_id"), F.sum("n").alias("n_siblings"))


@query(f"""SELECT e.eval_id, v.id FROM (SELECT DISTINCT eval_id, predicted_set_code AS s, predicted_collector_number AS c FROM evaluations WHERE predicted_name IS NOT NULL) e JOIN {_VAR} v ON v.set_code IS NOT DISTINCT FROM e.s AND v.collector_number IS NOT DISTINCT FROM e.c""")
def ref_j8_candidate_to_record(spark, d):
    e = table(spark, d, "evaluations").where("predicted_name is not null").select("eval_id", F.col("predicted_set_code").alias("s"), F.col("predicted_collector_number").alias("c")).distinct()
    v = variants(spark, d).select("id", "set_code", "collector_number")
    return e.join(v, e["s"].eqNullSafe(v["set_code"]) & e["c"].eqNullSafe(v["collector_number"])).select("eval_id", "id")


@query(f"""SELECT p.snapshot_no, count(DISTINCT w.id) AS n_printings, count(DISTINCT w.normalized_name) AS n_names FROM (SELECT DISTINCT snapshot_no, {_KEY('oracle_id')} AS k FROM catalog_snapshots) p JOIN {_VIEW} w ON {_KEY('w.identity_id')} = p.k GROUP BY 1""")
def ref_j10_pool_semi_join(spark, d):
    """Printings and names of each export's pool: the pool's identities, each counted once."""
    pool = table(spark, d, "catalog_snapshots").select("snapshot_no", fold_key(F.col("oracle_id")).alias("oracle_key")).distinct()
    per = view(spark, d).groupBy("oracle_key", "normalized_name").agg(F.count_distinct("id").alias("n"))
    return pool.join(per, "oracle_key").groupBy("snapshot_no").agg(F.sum("n").alias("n_printings"), F.count_distinct("normalized_name").alias("n_names"))


@query(f"SELECT v.id FROM {_VAR} v WHERE v.scryfall_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalog_snapshots s WHERE s.scryfall_id = v.scryfall_id)")
def ref_u6_missing_in_snapshots(spark, d):
    return variants(spark, d).where("scryfall_id is not null").join(table(spark, d, "catalog_snapshots").select("scryfall_id"), "scryfall_id", "left_anti").select("id")


@query(f"SELECT id, list_sort(list_filter(list_distinct([printed_name]), lambda x: x IS NOT NULL AND x <> name)) AS aliases FROM {_VIEW} WHERE printed_name IS NOT NULL")
def ref_p6_u2_alias_difference(spark, d):
    return view(spark, d, "printed_name").where("printed_name is not null").select("id", F.array_sort(F.array_except(F.array("printed_name"), F.array("name"))).alias("aliases"))


@query(f"SELECT identity_id, normalized_name, id FROM (SELECT *, row_number() OVER (PARTITION BY normalized_name ORDER BY released_at DESC NULLS LAST, id) AS r FROM {_VIEW} WHERE normalized_name <> '') WHERE r = 1")
def ref_w7_default_printing(spark, d):
    """The newest printing of every name; an ordered aggregate, so no task sorts a name's printings."""
    v = view(spark, d).where("normalized_name <> ''")
    key = F.struct(F.col("released_at").isNotNull().alias("has"), "released_at", (-F.col("id")).alias("neg"))
    best = v.groupBy("normalized_name").agg(F.max_by(F.struct("identity_id", "id"), key).alias("b"))
    return best.select("b.identity_id", "normalized_name", "b.id")


@query(f"""SELECT printed_group, sum(CASE WHEN cached THEN 1 ELSE 0 END)::BIGINT AS n_cached, count(*) AS n_eligible FROM (SELECT v.rarity AS printed_group, EXISTS (SELECT 1 FROM catalog_snapshots s WHERE s.scryfall_id = v.scryfall_id) AS cached FROM {_VAR} v WHERE length(trim(v.image_uri)) > 0) GROUP BY 1""")
def ref_a23_a25_prehash_totals(spark, d):
    cached = table(spark, d, "catalog_snapshots").where("scryfall_id is not null").select("scryfall_id").distinct().withColumn("c", F.lit(1))
    j = variants(spark, d, "rarity").where(F.length(F.trim("image_uri")) > 0).join(cached, "scryfall_id", "left")
    return j.groupBy(F.col("rarity").alias("printed_group")).agg(F.sum(F.coalesce("c", F.lit(0))).alias("n_cached"), F.count("*").alias("n_eligible"))


@query(f"SELECT id, lower(coalesce(set_code, '')) || '-' || lower(coalesce(collector_number, '')) || '-' || substring(sha1(coalesce(scryfall_id, '') || '|' || coalesce(image_uri, '')), 1, 12) AS cache_name FROM {_VAR}")
def ref_s15_cache_key(spark, d):
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    digest = F.substring(F.sha1(F.concat(F.coalesce("scryfall_id", F.lit("")), F.lit("|"), F.coalesce("image_uri", F.lit("")))), 1, 12)
    return variants(spark, d).select("id", F.concat_ws("-", low("set_code"), low("collector_number"), digest).alias("cache_name"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def ref_s9_content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT fixture AS stem, max(scanned_at) AS latest, count(*) AS n FROM scan_results WHERE fixture IS NOT NULL GROUP BY 1 ORDER BY max(scanned_at) DESC NULLS LAST, fixture DESC LIMIT 1000""")
def ref_s16_retention(spark, d):
    g = table(spark, d, "scan_results").where("fixture is not null").groupBy(F.col("fixture").alias("stem")).agg(F.max("scanned_at").alias("latest"), F.count("*").alias("n"))
    return C.latest_rank(g, 1000, [F.col("latest").desc_nulls_last(), F.desc("stem")])


@query(f"SELECT layout, color, count(*) AS n FROM (SELECT layout, unnest(colors) AS color FROM {_IDENT}) GROUP BY ALL")
def ref_p4_p7_color_lists(spark, d):
    return identities(spark, d).select("layout", F.explode("colors").alias("color")).groupBy("layout", "color").agg(F.count("*").alias("n"))


QUERIES, SQL = query.queries, query.sql
