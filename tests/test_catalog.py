import math
import os
from collections import Counter

import duckdb
import pytest

from lodespark.plans import catalog


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list):
        return tuple(map(canon, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.execute(f"create view {f.split('.')[0]} as select * from '{tiny}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_against_sql(spark, tiny, con, name):
    df = catalog.queries()[name](spark, tiny)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert df.columns
        return
    result = con.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = Counter(tuple(canon(r[k]) for k in order) for r in result.fetchall())
    assert Counter(tuple(canon(v) for v in r) for r in rows) == want


def test_the_core_stands_without_the_subpackage():
    import lodespark

    root = os.path.dirname(lodespark.__file__)
    for d, _, names in os.walk(root):
        if os.path.basename(d) != "llm" and "/llm" not in d:
            for n in names:
                if n.endswith(".py"):
                    assert "lodespark.llm" not in open(os.path.join(d, n)).read()
