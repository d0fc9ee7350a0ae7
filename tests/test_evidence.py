import json

import pytest
from pyspark.sql import functions as F

from lendwell import fixed_values as fv
from lendwell.functions.text import citation_id, citations_changed, citations_fixed, citations_in
from lendwell.operators import contracts, evidence
from lendwell.plans import model_queries
from lendwell.session import COMPILED_BYTES

FACTORS = "f array<struct<model_feature:string, source_features:array<string>>>"


def queries_of(spark, factors, limit=5):
    df = spark.createDataFrame([(factors,)], FACTORS)
    return [(q["origin_feature"], q["query"]) for q in df.select(evidence.policy_queries(F.col("f"), limit)).first()[0]]


def test_policy_queries(spark):
    got = queries_of(spark, [
        ("dti_category", ["debt_to_income_ratio"]), ("loan_type", ["loan_type"]),
        ("applicant_age", ["applicant_age"]), ("x", ["derived_sex"]), ("dti_category", ["debt_to_income_ratio"]),
        ("loan_to_property_value", ["loan_amount", "property_value"]), ("preapproval", ["preapproval"]),
        ("ratio", ["zzz", "loan_amount", "income"]),
    ])
    assert [g[0] for g in got] == ["dti_category", "loan_type", "loan_to_property_value", "ratio"]
    assert got[3][1] == fv.POLICY_QUERY["income"]
    assert len(queries_of(spark, [(f, [f]) for f in fv.POLICY_QUERY], 3)) == 3
    assert queries_of(spark, []) == []


def test_citation_spellings(spark):
    ids = ["S1", "[ s3 ]", "s2", "[S4]", "x", "S1a"]
    df = spark.createDataFrame([(i,) for i in ids], "c string")
    assert [r[0] for r in df.select(citation_id(F.col("c"))).collect()] == ["[S1]", "[S3]", "[S2]", "[S4]", "x", "S1a"]
    text = "See S1, [s2] and [S3]; éS4 and xS5, S6]."
    one = spark.createDataFrame([(text,)], "t string").select(
        citations_fixed(F.col("t")), citations_changed(F.col("t")), citations_in(citations_fixed(F.col("t")))).first()
    assert one[0] == "See [S1], [S2] and [S3]; éS4 and xS5, S6]."
    assert one[1] == 2 and one[2] == ["[S1]", "[S2]", "[S3]"]


GOOD = dict(text="t", source_id="s", source_title="T", institution="I", source_url=f"https://{fv.OFFICIAL_HOSTS[0]}/a",
            page_or_section="p", chunk_id="s:0000", score=0.5)
RESULT = "struct<text:string,source_id:string,source_title:string,institution:string,source_url:string,page_or_section:string,chunk_id:string,score:double>"
STATE = (
    "errors array<string>, rag_queries array<struct<origin_feature:string,query:string>>, "
    f"policy_evidence array<struct<origin_feature:string,query:string,results:array<{RESULT}>>>, xai_features array<string>"
)


def guard(spark, results, errors=(), features=("income",), queries=(("income", "q"),)):
    rows = [tuple((GOOD | r).values()) for r in results]
    evidence_items = [("income", "q", rows), ("loan_type", "q2", rows[:1])] if queries else []
    df = spark.createDataFrame([(list(errors), list(queries), evidence_items, list(features))], STATE)
    return evidence.evidence_guardrail(df).first()


def test_guardrail_accepts_and_numbers(spark):
    r = guard(spark, [{}, {"chunk_id": "b"}, {}])
    assert r["insufficient_evidence"] is False and r["reasons"] == []
    assert [s["citation_id"] for s in r["sources"]] == ["[S1]", "[S2]"]
    assert [x["citation_id"] for x in r["policy_evidence"][0]["results"]] == ["[S1]", "[S2]", "[S1]"]
    assert r["covered_features"] == ["income"]


def test_guardrail_refuses(spark):
    one_bad = guard(spark, [{}, {"source_url": "https://other.org/x"}])
    assert one_bad["insufficient_evidence"] and one_bad["reasons"] == [fv.MSG_BAD_HOST + "https://other.org/x"]
    blank = guard(spark, [{"institution": " ", "score": None}])
    assert blank["reasons"][0] == fv.MSG_BAD_METADATA + "s:0000: ['institution', 'score']"
    assert guard(spark, [{}], features=("x",))["reasons"] == [fv.MSG_NO_COVERAGE]
    nothing = guard(spark, [], queries=())
    assert nothing["reasons"] == [fv.MSG_NO_QUERIES, fv.MSG_NO_RESULTS, fv.MSG_NO_COVERAGE]
    assert guard(spark, [{}], errors=["e"])["reasons"] == [fv.MSG_PRIOR_ERRORS]


def test_applications_carry_no_texts(spark):
    """Texts are put back, or written into the prompt's JSON, after the guardrail; copies of a chunk keep their own."""
    one, two, *_ = dict.fromkeys(fv.POLICY_QUERY.values())
    rows = lambda *changes: [tuple((GOOD | c).values()) for c in changes]
    found = spark.createDataFrame(
        [(one, rows({"text": 'say "a"\n\u00e9'}, {"source_url": "http://x.org"}, {"text": "copy", "score": 0.25})),
         (two, rows({"chunk_id": "b"}))],
        f"query string, results array<{RESULT}>",
    )
    apps = spark.createDataFrame(
        [(1, [], [("income", one), ("lien", two)], ["income"]), (2, [], [('l"', two)], ["x"]), (3, ["e"], [], [])],
        "id int, errors array<string>, rag_queries array<struct<origin_feature:string,query:string>>, xai_features array<string>",
    )
    passages = evidence.check_passages(found)
    keep = {"ignoreNullFields": "false"}
    whole = evidence.evidence_guardrail(evidence.attach_policy(apps, passages))
    whole = whole.withColumn("json", F.to_json("policy_evidence", keep))
    light = evidence.evidence_guardrail(evidence.attach_policy(apps, evidence.without_texts(passages)))
    assert "text" not in light.schema["policy_evidence"].dataType.elementType["results"].dataType.elementType.names
    policy = F.col("policy_evidence")
    light = light.withColumns(
        {"json": evidence.policy_json(policy, passages), "policy_evidence": evidence.with_texts(policy, passages)}
    )
    assert light.columns == whole.columns
    assert light.orderBy("id").collect() == whole.orderBy("id").collect()
    assert light.where("id = 1").first()["policy_evidence"][0]["results"][1]["text"] == "copy"


def test_searches_of_odd_factors(spark):
    rows = [(1, [("income", [None]), ("income", None), (None, ["income"]), ("x", ["loan_type", "income"]), ("x", [])]),
            (2, None), (3, [("x", ["loan_type"]), ("y", ["loan_type"])]), (4, [])]
    df = spark.createDataFrame(rows, f"id int, {FACTORS}").coalesce(1)
    got = {r[0]: r[1] for r in df.select("id", evidence.policy_queries(F.col("f"))).collect()}
    assert got[2] is None and got[4] == []
    assert [tuple(q) for q in got[1]] == [("x", fv.POLICY_QUERY["income"])]
    assert [tuple(q) for q in got[3]] == [("x", fv.POLICY_QUERY["loan_type"])]


def audit(spark, text, declared):
    df = spark.createDataFrame(
        [(text, "p", "f", declared, ["[S1]", "[S2]", "[S10]"], "approved", 0.75, [("[S1]",), ("[S2]",)], [])],
        "model_explanation string, policy_context string, final_assessment string, cited_source_ids array<string>, "
        "allowed_ids array<string>, prediction_label string, probability double, sources array<struct<citation_id:string>>, errors array<string>",
    )
    return evidence.answer_texts(evidence.audit_answers(df)).first()


def test_answer_audit(spark):
    ok = audit(spark, "as s10 and S2 say", ["S1", "[S2]"])
    assert ok["status"] == fv.STATUS_SUCCESS and ok["normalization_count"] == 3
    assert ok["valid_ids"] == ["[S1]", "[S2]", "[S10]"]
    assert "probabilidad=0.750000" in ok["final_response"] and "[S10]" in ok["final_response"]
    bad = audit(spark, "as S99 says", ["S1"])
    assert bad["status"] == fv.STATUS_REJECTED and bad["invalid_ids"] == ["[S99]"]
    assert fv.MSG_ABSTAIN in bad["final_response"] and bad["rejection"] in bad["response_warnings"]
    assert audit(spark, "nothing", [])["rejection"] == fv.MSG_NO_CITATION


def test_long_forms(spark):
    hits = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (1, 2, "b"), (1, 4, "c"), (2, 9, "c")], "app int, pos int, chunk string")
    got = {(r["app"], r["chunk"]): r["citation_id"] for r in evidence.citation_numbering(hits, "app", "pos", "chunk").collect()}
    assert got == {(1, "a"): "[S1]", (1, "b"): "[S2]", (1, "c"): "[S3]", (2, "c"): "[S1]"}
    a = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (3, 0, 0.5)], "id int, prediction int, probability double")
    b = spark.createDataFrame([(1, 1, 0.5 + 1e-7), (2, 1, 0.6), (3, 1, 0.5)], "id int, prediction int, probability double")
    assert {r["id"]: r["agrees"] for r in evidence.prediction_agreement(a, b, "id").collect()} == {1: True, 2: False, 3: False}


def test_agreement_sends_no_side_to_the_driver(spark, tmp_path):
    """Millions of scores compress to a file below Spark's broadcast limit; here any size would do."""
    spark.range(50).selectExpr("id", "1 AS prediction", "0.5D AS probability").write.parquet(str(tmp_path / "scores"))
    scores = spark.read.parquet(str(tmp_path / "scores"))
    out = evidence.prediction_agreement(scores, scores.select("*"), "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.where("agrees").count() == 50


def test_bad_limits():
    with pytest.raises(ValueError):
        evidence.policy_queries(None, 0)


def test_a_request_looks_every_value_up_once_as_type_and_once_as_text(spark, monkeypatch):
    lookups, get = [], F.try_variant_get
    monkeypatch.setattr(F, "try_variant_get", lambda *a: lookups.append(a[1:]) or get(*a))
    values = {c: "1" for c in fv.PREDICTORS}
    odd = [values | {"income": "1e5", "loan_type": 1.5}, values | {"income": True, "loan_term": "NaN", "loan_type": "x"}]
    texts = [json.dumps(v) for v in odd] + ["[1]", "3", "{", '{"income": 1, "income": 2}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    checked = contracts.validate_applications(df, "j").orderBy("i")
    assert len(lookups) == len(set(lookups)) == 2 * len(fv.PREDICTORS)
    got = [r["errors"] for r in checked.collect()]
    assert got[0] == ["loan_type: invalid value"]
    assert got[1] == ["income: invalid value", "loan_term: invalid value"]
    assert got[2:] == [[fv.MSG_NOT_OBJECT]] * 5


def test_evidence_is_read_by_compiled_plans(spark, monkeypatch):
    """The caller runs the plan, so the session keeps the limit; a lower one of its own stays."""
    seen, limit = [], "spark.sql.codegen.hugeMethodLimit"
    names = {"population": None, "applications": None, "champion": None, "policy_results": None}
    for name in names:
        monkeypatch.setattr(model_queries, name, lambda *_: None)
    monkeypatch.setattr(model_queries.workflow, "evidence_run", lambda *_, **__: seen.append(int(spark.conf.get(limit))))
    before = spark.conf.get(limit)
    try:
        for given, kept in ((65535, COMPILED_BYTES), (500, 500)):
            spark.conf.set(limit, str(given))
            model_queries._evidence(spark, "")
            assert seen.pop() == kept == int(spark.conf.get(limit))
    finally:
        spark.conf.set(limit, before)
