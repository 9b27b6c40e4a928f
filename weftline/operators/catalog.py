"""The catalogue: nested records to identities, variants and aliases, and lookups over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.keys import clean_optional, fold_key
from weftline.functions.text import normalize_text
from weftline.session import tasks

SCHEMA_VERSION = "4"

_IMAGES = "struct<png:string,large:string,normal:string>"
_FACE = f"struct<name:string,printed_name:string,mana_cost:string,type_line:string,oracle_text:string,colors:array<string>,color_identity:array<string>,games:array<string>,image_uris:{_IMAGES}>"
#: Fields read of a source record; others are ignored, missing ones are null.
SOURCE = f"""id string, oracle_id string, name string, printed_name string, `set` string, collector_number string, lang string, games array<string>,
digital boolean, layout string, mana_cost string, colors array<string>, color_identity array<string>, type_line string, oracle_text string, rarity string,
flavor_text string, artist string, released_at string, image_uris {_IMAGES}, card_faces array<{_FACE}>"""


def read_bulk_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that holds one JSON array, with their position.

    A file that isn't an array fails; elements that aren't objects are skipped.
    """
    text = spark.read.text(path, wholetext=True)
    start = F.substring(F.ltrim("value"), 1, 1)
    text = text.where(F.when(start == "[", True).otherwise(F.raise_error(F.lit("the source is not an array")).cast("boolean")))
    items = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item")).where(F.ltrim("item").startswith("{"))
    return items.select("pos", F.from_json("item", SOURCE).alias("r")).select("pos", "r.*")


def image_uri(images: Column, faces: Column) -> Column:
    """The record's own png, large or normal picture, else the first face's that has one."""
    own = lambda s: F.coalesce(*(clean_optional(s[k]) for k in ("png", "large", "normal")))
    per_face = F.filter(F.transform(faces, lambda f: own(f["image_uris"])), lambda u: u.isNotNull())
    return F.coalesce(own(images), F.get(per_face, F.lit(0)))


def string_list(top: Column, faces: Column, key: str) -> Column:
    """The record's list without blanks, else the faces' lists in order without repeats."""
    clean = lambda a: F.filter(F.transform(a, clean_optional), lambda x: x.isNotNull())
    union = F.array_distinct(clean(F.flatten(F.filter(F.transform(faces, lambda f: f[key]), lambda a: a.isNotNull()))))
    return F.coalesce(clean(top), union, F.array().cast("array<string>"))


def joined_face_text(own: Column, faces: Column, key: str) -> Column:
    """The record's text, else the faces' texts joined by " // ", else null."""
    texts = F.filter(F.transform(faces, lambda f: clean_optional(f[key])), lambda x: x.isNotNull())
    return F.coalesce(clean_optional(own), F.nullif(F.array_join(texts, " // "), F.lit("")))


def alias_list(name: Column, printed_name: Column, faces: Column) -> Column:
    """Printed name and the faces' names and printed names, sorted, without the record's own name."""
    of_faces = F.coalesce(F.concat(F.transform(faces, lambda f: clean_optional(f["name"])), F.transform(faces, lambda f: clean_optional(f["printed_name"]))), F.array().cast("array<string>"))
    every = F.filter(F.concat(F.array(clean_optional(printed_name)), of_faces), lambda x: x.isNotNull())
    return F.array_sort(F.array_except(F.array_distinct(every), F.array(clean_optional(name))))


def is_paper(games: Column, digital: Column) -> Column:
    """Printed on paper: named among the games, or no games given and not digital only."""
    low = F.transform(games, lambda g: F.lower(g))
    return F.when(F.array_contains(low, "paper"), True).when(F.size(low) > 0, False).otherwise(~F.coalesce(digital, F.lit(False)))


def derived_key(oracle_id: Column, variant_id: Column) -> Column:
    """The identity's own id, else one made from the variant's."""
    return F.coalesce(clean_optional(oracle_id), F.concat(F.lit("printing:"), variant_id))


def build_catalog(source: DataFrame) -> dict[str, DataFrame]:
    """identities, variants, aliases and metadata from source records with a ``pos``.

    Of an identity the first record in source order holds, and of a variant as well.
    """
    faces = F.col("card_faces")
    kept = source.where((F.col("lang") == "en") & is_paper(F.col("games"), F.col("digital"))).where(clean_optional(F.col("id")).isNotNull() & clean_optional(F.col("name")).isNotNull())
    rows = kept.select(
        "pos", clean_optional(F.col("id")).alias("scryfall_id"), derived_key(F.col("oracle_id"), clean_optional(F.col("id"))).alias("oracle_id"), clean_optional(F.col("name")).alias("name"),
        normalize_text(F.col("name")).alias("normalized_name"), clean_optional(F.col("layout")).alias("layout"),
        joined_face_text(F.col("mana_cost"), faces, "mana_cost").alias("mana_cost"), joined_face_text(F.col("type_line"), faces, "type_line").alias("type_line"),
        joined_face_text(F.col("oracle_text"), faces, "oracle_text").alias("oracle_text"), string_list(F.col("colors"), faces, "colors").alias("colors"),
        string_list(F.col("color_identity"), faces, "color_identity").alias("color_identity"), clean_optional(F.col("printed_name")).alias("printed_name"),
        clean_optional(F.col("set")).alias("set_code"), clean_optional(F.col("collector_number")).alias("collector_number"), F.coalesce(clean_optional(F.col("lang")), F.lit("en")).alias("language"),
        clean_optional(F.col("rarity")).alias("rarity"), clean_optional(F.col("flavor_text")).alias("flavor_text"), clean_optional(F.col("artist")).alias("artist"),
        clean_optional(F.col("released_at")).alias("released_at"), image_uri(F.col("image_uris"), faces).alias("image_uri"), string_list(F.col("games"), faces, "games").alias("games"),
        alias_list(F.col("name"), F.col("printed_name"), faces).alias("aliases"),
    )
    identity = ["name", "normalized_name", "layout", "mana_cost", "type_line", "oracle_text", "colors", "color_identity"]
    variant = ["oracle_id", "printed_name", "set_code", "collector_number", "language", "rarity", "flavor_text", "artist", "released_at", "image_uri", "games"]
    identities = first_wins(rows, "oracle_id", "pos", identity)
    variants = first_wins(rows, "scryfall_id", "pos", variant)
    alias = rows.select("scryfall_id", F.explode("aliases").alias("alias")).distinct().withColumn("normalized_alias", normalize_text(F.col("alias")))
    counts = variants.agg(F.count("*").alias("cards")).join(identities.agg(F.count("*").alias("oracles"))).join(alias.agg(F.count("*").alias("aliases")))
    metadata = counts.select(F.explode(F.create_map(F.lit("schema_version"), F.lit(SCHEMA_VERSION), F.lit("card_count"), F.col("cards").cast("string"), F.lit("oracle_count"), F.col("oracles").cast("string"), F.lit("alias_count"), F.col("aliases").cast("string"))))
    return {"identities": identities, "variants": variants, "aliases": alias, "metadata": metadata}


def first_wins(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of each key the row of least ``order``; an aggregate, so a frequent key is combined map-side.

    Of rows with equal order that of the least hash is taken, so the result doesn't depend on the
    partitioning. Only ``columns`` are read and shuffled.
    """
    hashed = [c for c, t in df.dtypes if c in columns and "map<" not in t]
    best = df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(order, F.xxhash64(*hashed))).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def compatibility_view(identities: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants with their identity's fields; variants without an identity are left out."""
    own = identities.select(fold_key(F.col("oracle_id")).alias("oracle_key"), *(c for c in identities.columns if c not in variants.columns))
    return variants.withColumn("oracle_key", fold_key(F.col("oracle_id"))).join(own, "oracle_key")


def fold_aliases(cards: DataFrame, aliases: DataFrame, card_key: str, alias_key: str) -> DataFrame:
    """Cards with the sorted array of their distinct aliases, empty where there is none."""
    per = aliases.where(F.col("alias").isNotNull()).groupBy(F.col(alias_key).alias("__k")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return cards.join(per, cards[card_key] == F.col("__k"), "left").drop("__k").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def identity_groups(view: DataFrame) -> DataFrame:
    """One row an identity key: least name, variants, union of aliases sorted."""
    return view.groupBy("oracle_key").agg(F.min("name").alias("name"), F.count_distinct("scryfall_id").alias("n_variants"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"))


def predicates(name: str | None = None, oracle_id: str | None = None, set_code: str | None = None, collector_number: str | None = None) -> Column:
    """Conjunction of the filters that are given; a name without letters or digits matches nothing."""
    out = [F.lit(True)]
    if name:
        out.append((F.col("normalized_name") == normalize_text(F.lit(name))) & (normalize_text(F.lit(name)) != ""))
    if oracle_id:
        out.append(F.col("oracle_id") == oracle_id)
    if set_code:
        out.append(F.lower("set_code") == set_code.lower())
    if collector_number:
        out.append(F.lower("collector_number") == collector_number.lower())
    return reduce(lambda a, b: a & b, out)


def exact_then_like(df: DataFrame, column: str, norm: str) -> DataFrame:
    """Rows equal to ``norm``; if there are none, those that contain it.

    The equality, which a scan can use to skip row groups, is tried first; only if it finds nothing
    are the values searched.
    """
    if not norm:
        return df.limit(0)
    same = df.where(F.col(column) == norm)
    return same if same.limit(1).count() else df.where(F.col(column).contains(norm))


def newest_first() -> list[Column]:
    """Order of printings: newest release, then set, number and id."""
    return [F.col("released_at").desc_nulls_last(), F.col("set_code").asc_nulls_first(), F.col("collector_number").asc_nulls_first(), F.col("scryfall_id").asc_nulls_first()]



class Catalog:
    """Lookups over the three tables; each returns a DataFrame."""

    def __init__(self, identities: DataFrame, variants: DataFrame):
        self.identities, self.variants = identities, variants
        self.view = compatibility_view(identities, variants)

    def identity(self, oracle_id: str) -> DataFrame:
        return self.identities.where(F.col("oracle_id") == oracle_id)

    def variant(self, scryfall_id: str) -> DataFrame:
        return self.view.where(F.col("scryfall_id") == scryfall_id)

    def find_identities(self, name: str, limit: int = 20) -> DataFrame:
        norm = self.identities.sparkSession.range(1).select(normalize_text(F.lit(name)).alias("n")).first().n
        return exact_then_like(self.identities, "normalized_name", norm).orderBy("name", "oracle_id").limit(limit)

    def printings(self, *, name: str | None = None, oracle_id: str | None = None, set_code: str | None = None, collector_number: str | None = None, limit: int | None = None) -> DataFrame:
        out = self.view.where(predicates(name, oracle_id, set_code, collector_number)).orderBy(*newest_first())
        return out if limit is None else out.limit(limit)

    def resolve(self, *, scryfall_id: str | None = None, oracle_id: str | None = None, name: str | None = None) -> DataFrame:
        """Printings of what is given first: a variant, an identity, a name (at most 50)."""
        if scryfall_id:
            return self.variant(scryfall_id)
        return self.printings(oracle_id=oracle_id, name=None if oracle_id else name, limit=50)


def exact_lookup(queries: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Hits of (q_id, query) in names (normalized, key), then in aliases: each key once, names first.

    Adds source 0 for a name and 1 for an alias.
    """
    by_name = queries.join(names, queries["query"] == names["normalized"]).select("q_id", "query", "key", F.lit(0).alias("source"))
    by_alias = queries.join(aliases, queries["query"] == aliases["normalized"]).select("q_id", "query", "key", F.lit(1).alias("source"))
    return by_name.unionByName(by_alias).groupBy("q_id", "query", "key").agg(F.min("source").alias("source"))


def exact_summary(queries: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(q_id, n_keys, first_key, source) of every query with a hit.

    Keys are counted per entry before the join: a name that many queries ask for and many keys have
    isn't multiplied.
    """
    entries = names.select("normalized", "key", F.lit(0).alias("source")).unionByName(aliases.select("normalized", "key", F.lit(1).alias("source")))
    per = entries.groupBy("normalized", "key").agg(F.min("source").alias("source")).groupBy("normalized").agg(F.count("*").alias("n_keys"), F.min("key").alias("first_key"), F.min("source").alias("source"))
    return queries.join(per, queries["query"] == per["normalized"]).select("q_id", "n_keys", "first_key", "source")


def unique_or_filtered(requests: DataFrame, records: DataFrame) -> DataFrame:
    """A record for each request (q_id, name, set_code, collector_number): by name alone only if it is unique.

    With a set or number the first record (by record_id) that agrees without case is taken. Records are
    counted by what a request asks for before they are joined, so a name's many records meet no request one
    by one; requests without a name or without a record give no row.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    out = None
    for given in ((), ("set_code",), ("collector_number",), ("set_code", "collector_number")):
        asks = F.lit(True)
        for c in ("set_code", "collector_number"):
            asks = asks & (F.col(c).isNotNull() if c in given else F.col(c).isNull())
        per = records.groupBy("name", *(low(c).alias(c) for c in given)).agg(F.count("*").alias("n"), F.min("record_id").alias("record_id"))
        if not given:
            per = per.where("n = 1")
        mine = requests.where(asks).select("q_id", "name", *(low(c).alias(c) for c in given))
        part = mine.join(per, ["name", *given]).select("q_id", "record_id")
        out = part if out is None else out.unionByName(part)
    return out


def latest_rank(df: DataFrame, keep: int, order: list[Column]) -> DataFrame:
    """The ``keep`` newest rows by ``order`` (a top-k: no task sorts all rows)."""
    return df.orderBy(*order).limit(keep)


def blocked_counts(queries: DataFrame, names: DataFrame, block_names: int = 50_000) -> DataFrame:
    """(q_id, n_blocked, most_shared): how many names share a trigram with each query, and how many at most.

    Both sides have a column ``grams``; ``names`` has one row a key. The queries are a stated set that
    meets the names block by block: a block is the postings of its trigrams, added up for each query, so
    neither a frequent trigram nor its pairs are ever gathered. Queries that share nothing give no row.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-names.count() // block_names))
    asked = queries.select("q_id", "grams").repartition(tasks(spark))
    out = None
    for b in range(blocks):
        part = names.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("grams")
        postings: dict[str, list[int]] = {}
        n = 0
        for r in part.toLocalIterator():
            for g in r.grams or ():
                postings.setdefault(g, []).append(n)
            n += 1
        held = spark.sparkContext.broadcast(({g: np.array(x, np.int32) for g, x in postings.items()}, n))

        def look(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            known, size = held.value
            for batch in batches:
                rows = []
                for q, grams in zip(batch["q_id"], batch["grams"]):
                    hit = [known[g] for g in (() if grams is None else grams) if g in known]
                    if hit:
                        counts = np.bincount(np.concatenate(hit), minlength=size)
                        rows.append((q, int(np.count_nonzero(counts)), int(counts.max())))
                yield pd.DataFrame(rows, columns=["q_id", "n", "most"])

        found = asked.mapInPandas(look, f"q_id {queries.schema['q_id'].dataType.simpleString()}, n bigint, most bigint")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("q_id").agg(F.sum("n").alias("n_blocked"), F.max("most").alias("most_shared"))


def newest_per_key(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of each key the row of greatest ``order``; an aggregate, so a frequent key is combined map-side."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(*by, *(F.col(f"__r.{c}").alias(c) for c in rest))
