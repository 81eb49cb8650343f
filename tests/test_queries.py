"""Every registered query of the engine against its DuckDB equivalent, over the smallest tables."""

import os

import duckdb
import pytest

from veilstream import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_every_event_gives_a_finding(spark, duck):
    from veilstream.plans import planted

    n, users = duck.execute("SELECT count(*), count(DISTINCT user_id) FROM events").fetchone()
    assert planted.findings(spark, DATA).count() == n == duck.execute(f"SELECT count(*) FROM ({planted.findings_sql()})").fetchone()[0]
    assert registry.queries()["risk_score"](spark, DATA).count() == users


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc_id", "action", "n_findings", "risk", "band", "sanitized"] and set(e.oracle_sql()) <= set(e.queries())


def test_every_detector_hits_and_misses():
    """Over the texts of cases: each pattern finds something, and some text of its family it misses."""
    from veilstream.plans import cases, oracle

    c = duckdb.connect()
    c.execute("CREATE TABLE texts AS SELECT * FROM (SELECT unnest(range(?)) AS doc_id, unnest(?) AS text)", [len(cases.TEXTS), cases.TEXTS])
    families = [(registry.D.PII, cases.PERSONAL), (registry.D.SECRETS, cases.SECRET), (registry.D.INJECTION, cases.INJECTION), (registry.D.GUARDRAILS, cases.TONE)]
    for detectors, texts in families:
        hit = c.sql(f"SELECT det, count(DISTINCT doc_id) AS n FROM ({oracle.findings('texts', detectors)}) GROUP BY det").fetchall()
        assert sorted(d for d, _ in hit) == list(range(len(detectors)))
        assert all(n < len(texts) for _, n in hit)
    c.execute("CREATE TABLE customer AS SELECT unnest(range(?)) AS c_custkey", [len(cases.TEXTS)])
    assert [t for _, t in sorted(c.sql(cases.sql()).fetchall())] == cases.TEXTS
