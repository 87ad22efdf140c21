"""Every query runs on the smallest tables; those with SQL give what DuckDB gives."""

import math
import os
from collections import Counter

import pytest

from holdfast.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, list) else v


def bag(rows):
    return Counter(str([plain(v) for v in r]) for r in rows)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(r[c] for c in names) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        assert bag(rows) == bag([tuple(r[i] for i in order) for r in found.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["video_id", "frame_number", "frame_id", "contact_label", "source_hand"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
