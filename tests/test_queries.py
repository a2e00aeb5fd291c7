"""Every registered query of the engine's own operators against its SQL on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, D)
    want = db.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, D).count() >= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8 and set(e.oracle_sql()) <= set(e.queries())


def test_path_b_edges_are_cosines(spark, tmp_path):
    """Vectors of any length: anchors go by inner product, their edges by cosine."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT vec_id, label, list_transform(embedding, lambda x: (x * (1 + vec_id % 5))::FLOAT) AS embedding FROM '{D}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = QUERIES["path_b"](spark, str(tmp_path)).collect()
    want = c.execute(ORACLES["path_b"]).fetchall()
    assert sorted((r.paragraph, round(r.score, 5)) for r in got) == sorted((p, round(s, 5)) for p, s in want)
