"""Scalars, the plan analyzer, sources and votes on literals."""

import datetime
import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as X
from factloom.operators import documents, reconcile
from factloom import streaming
from factloom.plans import answers
from factloom.plans.algebra import Measure, Plan, PlanError, analyze, describe, run
from factloom.plans.rules import classify
from factloom.sources import estate


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("text,want", [("INR 33.38 Cr", "333800000.00"), ("Rs. 3,338.00 Lakh", "333800000.00"), ("₹ 33,38,00,000", "333800000.00"), ("2 mn", "2000000.00"), ("none", None), (None, None)])
def test_parse_inr(spark, text, want):
    assert one(spark, X.parse_inr, text) == (want and Decimal(want))


@pytest.mark.parametrize("text", ["2021-03-05", "05/03/2021", "5/3/2021", "5 Mar 2021", "5 March 2021", "March 5, 2021", "Mar 5, 2021", "on 5 March 2021 at site"])
def test_parse_date(spark, text):
    assert one(spark, X.parse_date, text) == datetime.date(2021, 3, 5)


def test_other_scalars(spark):
    assert one(spark, X.nfkc, "ﬁ x") == "fi x"
    assert one(spark, X.words_to_number, "three hundred and twenty-one") == 321
    assert one(spark, X.words_to_number, "three gross") is None
    assert one(spark, X.find_amount, "3 lakh and 2 crore") == 20_000_000
    assert one(spark, X.years_in, "2010, 1995 and 2010, 2031") == [1995, 2010]
    assert one(spark, X.norm_person, "  O'Neil  J. ") == "o neil j"
    assert one(spark, lambda x: X.coerce(F.lit("2.345"), F.lit("percent")), "") == "2.35"
    assert one(spark, lambda x: X.coerce(F.lit("-2.5"), F.lit("money")), "") == "-3"
    assert one(spark, lambda x: F.rlike(F.lit("roads and  bridges"), X.category_pattern(F.lit("roads bridges"))), "")


@pytest.mark.parametrize(
    "text,want",
    [
        ("P.W.D. and PW, p wd", "public works department and public works department public works department"),
        ("PHED; phe Pheg", " ".join(["public health engineering department"] * 3)),
        ("U.P. Irr. Corp Ltd", "uttar pradesh irrigation corporation limited"),
        ("Ut Pr & Jhkd, Mah", "uttar pradesh and jharkhand maharashtra"),
        ("pwdx corps rajah", "pwdx corps rajah"),
        ("", ""),
        (None, None),
    ],
)
def test_short_forms(spark, text, want):
    assert one(spark, X.norm_question, text) == want


@pytest.mark.parametrize("plan", [Plan(Measure(), combine="twice"), Plan(Measure(), combine="sum"), Plan(Measure("planets")), Plan(Measure("constant")), Plan(Measure(agg="mode")), Plan(Measure(agg="sum_invoiced")), Plan(Measure(scope="planet")), Plan(Measure(filters=[])), Plan(Measure(filters={"colour": 1}))])
def test_invalid_plans(plan):
    with pytest.raises(PlanError):
        analyze(plan)


def test_analysis_and_text():
    m = analyze(Plan(Measure(filters={"completed_after": "the award", "categories_in": ["Roads"]}, n=0))).left
    assert m.filters == {"completed_after": "ANCHOR_DATE", "categories_in": ["roads"]} and m.n == 2
    assert describe(classify("What is the total value over the whole business?", "money", [])[1]).startswith("sum_value(corpus")


def test_empty_groups(spark):
    works = spark.createDataFrame([(1, 1, "low", Decimal(5)), (2, 2, "high", Decimal(7))], "pkg long, client_key long, category string, value decimal(18,2)")
    assert {tuple(r) for r in run(Plan(Measure(agg="count", filters={"categories_in": ["low"]})), works).collect()} == {(1, 1), (2, 0)}
    assert {tuple(r) for r in run(Plan(Measure(filters={"categories_in": ["low"]})), works).collect()} == {(1, Decimal(5))}
    assert run(Plan(Measure(scope="corpus", filters={"categories_in": ["none"]})), works).first()[0] is None


def test_portfolio_and_sheets(spark):
    got = one(spark, documents.parse_portfolio, "Pkg-1 | Prime | A b\nPkg-22 | JV Partner | C")
    assert [tuple(x) for x in got] == [("1", "Prime", "A b"), ("22", "JV Partner", "C")]
    kind = lambda h: documents.classify_sheet(F.lit(h), [("ageing", "client|party", "invoice"), ("boq", "item", "rate")])
    assert [one(spark, lambda x, h=h: kind(h), "") for h in ("Party Invoice", "Item Rate", "x")] == ["ageing", "boq", "unknown_workbook"]


def test_votes(spark):
    rows = [("a", "rules", 0, "1", False), ("a", "model", 1, "2", False), ("a", "model", 2, "2", False), ("b", "rules", 0, "1", True), ("b", "model", 1, "2", False), ("c", "rules", 0, None, False), ("c", "model", 1, "3", False), ("d", "rules", 0, None, False)]
    df = spark.createDataFrame(rows, "qid string, source string, place int, answer string, confident boolean")
    pick = lambda t: {r.qid: r.answer for r in reconcile.reconcile(df, t).collect()}
    assert pick("consensus") == {"a": "2", "b": "1", "c": "3", "d": None}
    assert pick("rules") == {"a": "1", "b": "1", "c": "3", "d": None}
    assert pick("model") == {"a": "2", "b": "2", "c": "3", "d": None}


def test_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": 1, "text": "x"}, {"question": "lost"}, {"qid": "b", "question": "y", "answer_type": "count"}]}))
    q = estate.load_questions(spark, str(tmp_path / "q.json"))
    assert [tuple(r)[:3] for r in q.orderBy("place").collect()] == [("1", "x", "money"), ("b", "y", "count")]
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Client</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    (tmp_path / "docs" / "a b").mkdir(parents=True)
    (tmp_path / "docs" / "a b" / "x.XLSX").write_bytes(book.getvalue())
    (tmp_path / "docs" / "bad.xlsx").write_bytes(b"no")
    (tmp_path / "docs" / "~$bad.xlsx").write_bytes(b"no")
    got = {r.doc_id: r for r in estate.read_workbooks(estate.find_documents(spark, str(tmp_path / "docs"))).collect()}
    assert set(got) == {"a_b_x.XLSX", "bad.xlsx"} and got["bad.xlsx"].error
    assert got["a_b_x.XLSX"].sheets[0].rows == [["Client", None, "2"]] and got["a_b_x.XLSX"].sheets[0].formulas == {"C1": "=1+1"}


def test_sheets_follow_their_relations(spark, tmp_path):
    book = io.BytesIO()
    row = '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>{}</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="rel"><sheets><sheet name="First" r:id="b"/><sheet name="Second" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", row.format("of the second"))
        z.writestr("xl/worksheets/sheet2.xml", row.format("of the first"))
    (tmp_path / "x.xlsx").write_bytes(book.getvalue())
    got = estate.read_workbooks(estate.find_documents(spark, str(tmp_path))).first()
    assert [(s.sheet, s.rows) for s in got.sheets] == [("First", [["of the first"]]), ("Second", [["of the second"]])]


@pytest.mark.parametrize("timed", [True, False])
def test_stream(spark, tmp_path, timed):
    row = (12, "COMPLETION CERTIFICATE\nReference: CERT/7/Pkg-12\nName of Work: low works Pkg-12\nGrading: good", datetime.datetime(2024, 1, 1, 10))
    rows = spark.createDataFrame([row] * 3, "pkg long, text string, seen timestamp")
    (rows if timed else rows.drop("seen")).coalesce(1).write.parquet(str(tmp_path / "in"))
    texts = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    name = f"parsed_{timed}".lower()
    query = streaming.parsed_stream(texts).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.pkg, r.grading) for r in spark.table(name).collect()] == [(12, "good")] * (1 if timed else 3)


def test_answers_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("b", "2", 1), ("a", "1.50", 0)], "qid string, answer string, place int")
    estate.write_answers(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "out")).collect()] == [("a", "1.50"), ("b", "2")]


def test_model_plans_and_fallbacks(spark):
    works = spark.createDataFrame([(1, 1, "c one", "low works", "low", Decimal(5), 7, "good", True, "unit"), (2, 1, "c one", "high works", "high", Decimal(9), 7, "good", False, "unit")], "pkg long, client_key long, client_name string, work_name string, category string, value decimal(18,2), manager_key long, grading string, has_ref boolean, business_unit string")
    works = works.withColumn("completed", F.lit("2020-01-05").cast("date")).withColumn("state", F.lit(None).cast("string")).withColumn("role", F.lit("Prime"))
    invoices = spark.createDataFrame([(1, datetime.date(2020, 1, 1), Decimal(4), Decimal(1), Decimal(3), "o")], "client_key long, date date, invoiced decimal(18,2), received decimal(18,2), outstanding decimal(18,2), status string")
    anchors = spark.createDataFrame([("q", 1, 7, 2, None), ("x", None, None, None, None)], "qid string, client_key long, manager_key long, pkg long, anchor_date date")
    measure = lambda **k: {"left": {"source": "works", **k}}
    plans = {
        "count": measure(agg="count", filters={"categories_in": ["Low"]}),
        "none": measure(agg="count", filters={"categories_in": ["no"]}),
        "median": measure(agg="median_value"),
        "nth": measure(agg="nth_largest_value", n=2),
        "top": measure(agg="top_n_sum_by_client", scope="engineer"),
        "corpus": measure(agg="max_value", scope="corpus"),
        "percent": {"left": {"source": "invoices", "agg": "sum_received"}, "right": {"source": "invoices", "agg": "sum_invoiced"}, "combine": "percent"},
        "gap": {"left": {"source": "constant", "value": "20"}, "right": {"source": "works"}, "combine": "difference"},
        "days": measure(agg="days_since_anchor_date", scope="work"),
        "bad": measure(agg="mode"),
    }
    rows = [(k, "q", "model", 0, json.dumps(p)) for k, p in plans.items()] + [("text", "q", "model", 0, "no JSON"), ("lost", "x", "model", 0, json.dumps(measure(agg="sum_value")))]
    candidates = spark.createDataFrame(rows, "cid string, qid string, source string, place int, plan string")
    got = {r.cid: (None if r.value is None else float(r.value), r.error) for r in answers.executed(candidates, anchors, works, invoices).collect()}
    assert {k: v[0] for k, v in got.items() if v[1] is None} == {"count": 1, "none": 0, "median": 7, "nth": 5, "top": 14, "corpus": 9, "percent": 25, "gap": 6}
    assert got["days"][1] == "no date to compare with" and got["lost"][1] == "the question names no such entity" and got["bad"][1].startswith("invalid plan") and got["text"][1] == "invalid plan: not JSON"
    assert {r.answer_type: r.value for r in answers.fallbacks(works, invoices).collect()} == {"money": 14, "count": 2, "percent": 25, "days": 365}
