"""Every query with a SQL twin, compared on the smallest tables."""

import os

import duckdb
import pytest

from lendwell import fixed_values as fv
from lendwell.plans import catalog, model_queries
from tools.compare import TABLES, rows_of

FOLDER = os.environ.get("LENDWELL_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(catalog.SQL[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_scored_stream_equals_batch(spark):
    batch = catalog.QUERIES["batch_score"](spark, FOLDER).select(
        "lar_id", "prediction", "prediction_label", "probability"
    )
    stream = catalog.QUERIES["stream_scores"](spark, FOLDER)
    assert stream.count() > 0
    assert stream.exceptAll(batch).count() == 0
    assert batch.exceptAll(stream).count() == 0


def test_evidence_run_carries_errors(spark):
    rows = catalog.QUERIES["evidence_batch"](spark, FOLDER).collect()
    assert len({r["lar_id"] for r in rows}) == len(rows)
    failed = [r for r in rows if r["errors"]]
    assert failed and all(r["probability"] is None and r["insufficient_evidence"] for r in failed)
    assert all("Abstencion controlada" in r["final_response"] for r in failed)
    fine = [r for r in rows if not r["errors"]]
    assert fine and all(0 <= r["probability"] <= 1 for r in fine)


def test_evidence_batch_holds_what_the_last_stages_write(spark, monkeypatch):
    """Usable passages reach the row with their texts, and its prompt; abstentions have none."""
    host = f"https://{model_queries.ALLOWED_HOSTS[0]}/a"
    page = {f: host if f == "source_url" else f"{f} of it" for f in fv.RESULT_FIELDS} | {"score": 0.5}
    kind = ", ".join(f"{f}: {'double' if f == 'score' else 'string'}" for f in fv.RESULT_FIELDS)
    found = spark.createDataFrame(
        [(q, [tuple(page.values())]) for q in dict.fromkeys(fv.POLICY_QUERY.values())],
        f"query string, results array<struct<{kind}>>",
    )
    monkeypatch.setattr(model_queries, "policy_results", lambda *_: found)
    rows = catalog.QUERIES["evidence_batch"](spark, FOLDER).collect()
    ready = [r for r in rows if r["generation_status"] == "ready"]
    refused = [r for r in rows if r["generation_status"] != "ready"]
    assert ready and refused
    assert all('"text":"text of it"' in r["prompt"] and '"text":"text of it"' in r["policy_evidence"] for r in ready)
    assert all(r["prompt"] is None and r["errors"] for r in refused)
    assert all(fv.MSG_WORKFLOW_ERROR + r["errors"].split(" | ")[0] in r["warnings"] for r in refused)
