import pytest

from tests.oracle import connect, differences
from weftline.llm import queries
from weftline.llm.leakage import words
from weftline.session import table


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, data, name):
    assert differences(spark, connect(data), queries.QUERIES[name], queries.SQL[name], data) == ([], [], 0)


@pytest.mark.parametrize("name, columns", [("p2_found", ["obs_id", "normalized_name"]), ("p5_found", ["ref_table", "row_id"]), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id", "form"])])
def test_columns_and_distinct_rows(spark, data, name, columns):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert df.columns == columns and len(rows) == len(set(rows)) > 0


def test_every_result_with_lines_gets_a_row(spark, data):
    asked = {r.obs_id for r in table(spark, data, "recognition_results").where("size(ocr_lines) > 0").select("obs_id").collect()}
    assert {r.obs_id for r in queries.QUERIES["p2_found"](spark, data).collect()} == asked


def test_every_document_is_packed(spark, data):
    out = queries.QUERIES["p7_containers"](spark, data)
    assert out.select("doc_id").distinct().count() == table(spark, data, "documents").count()
    assert out.groupBy("container").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048
    fill = queries.QUERIES["p7_fill"](spark, data).first()
    assert fill.n_containers <= 1.01 * fill.lower_bound + 1


def test_whole_copies_are_found(spark, data):
    docs = {r.doc_id: " ".join(words(r.text)) for r in table(spark, data, "documents").collect()}
    items = {r.item_id: words(r.text) for r in table(spark, data, "heldout_items").collect()}
    found = {tuple(r) for r in queries.QUERIES["p8_found"](spark, data).collect()}
    plain = {(d, i) for d, t in docs.items() for i, w in items.items() if any(f" {' '.join(w[p : p + 12])} " in f" {t} " for p in range(len(w) - 11))}
    assert plain <= found


@pytest.mark.parametrize("name", ["p2_unmatched", "p5_consistent_names", "p5_look_alike_groups", "p8_leaks_per_item", "p9_text_stats"])
def test_reports_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
