import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

CORE = [m for m in entry._modules() if not m.__name__.startswith("weftline.llm")]
PAIRS = {n: (f, m.SQL[n]) for m in CORE for n, f in m.QUERIES.items() if n in m.SQL}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", PAIRS)
def test_query_equals_sql(spark, con, data, name):
    f, sql = PAIRS[name]
    assert differences(spark, con, f, sql, data) == ([], [], 0)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_imports_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "weftline")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "weftline.llm" not in open(os.path.join(folder, n), encoding="utf8").read()
