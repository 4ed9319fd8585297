import os

import duckdb
import pytest

from tessera.plans import edges, registry  # noqa: F401

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


def shown(x):
    return repr(round(x, 9)) if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else repr(x)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(D):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    found = con.execute(registry.SQL[name])
    assert normal(df.collect(), df.columns) == normal(found.fetchall(), [x[0] for x in found.description])
