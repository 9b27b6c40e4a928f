"""Problem 9: per-document text statistics and documents that are no natural prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.quality import text_quality
from weftline.session import table

#: Most words that the list of common words may have to be sent to every executor.
MOST_COMMON_WORDS = 100_000


def _common(spark: SparkSession, sf_dir: str) -> list[str]:
    words = [r.word for r in table(spark, sf_dir, "common_words").select("word").distinct().limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError("the list of common words is longer than what may be broadcast")
    return words


def p9_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, mean word length, symbol ratio, punctuated lines, common words and form of every document."""
    return text_quality(table(spark, sf_dir, "documents"), "doc_id", "text", _common(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose words stand in a list, a table or junk."""
    return p9_text_stats(spark, sf_dir).where("form <> 'prose'").select("doc_id", "form").distinct()


def p9_basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can give as well."""
    return p9_text_stats(spark, sf_dir).select("doc_id", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "common_share")


_SPACE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIPPED = r"""regexp_replace(w, '^[\x22''“”‘’«»()\[\]{}.,;:!?…*_¡¿<>]+|[\x22''“”‘’«»()\[\]{}.,;:!?…*_¡¿<>]+$', '', 'g')"""
BASIC_SQL = rf"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')) AS w FROM documents),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS chars, sum(length(regexp_replace(w, '[\p{{L}}\p{{N}}\p{{M}}]', '', 'g'))) AS symbols,
 count(*) FILTER (lower({_STRIPPED}) IN (SELECT lower(word) FROM common_words)) AS common FROM w GROUP BY doc_id),
l AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '')) AS n_lines FROM documents)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_lines, 0) AS n_lines, round(chars / n_words, 4) AS mean_word_length, round(symbols / chars, 4) AS symbol_ratio,
 round(common / n_words, 4) AS common_share FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)
"""

QUERIES = {"p9_found": p9_found, "p9_text_stats": p9_text_stats, "p9_basic_stats": p9_basic_stats}
SQL = {"p9_basic_stats": BASIC_SQL}
