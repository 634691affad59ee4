"""Readings of questions on small tables: labels inside labels, clients' names, amounts, defaults, selection and measures of the corpus."""

import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as X
from factloom.operators import resolve
from factloom.plans import answers, rules, selection

LABELS = ["buildings", "roads", "small buildings", "irrigation", "roads highways", "roads maintenance", " ".join("abcdefghij")]


def read(spark, rows, clients=()):
    """Shape, matched and plan of each (question, answer type), with the clients' names blanked."""
    q = resolve.asked(spark.createDataFrame([(str(i), t, k) for i, (t, k) in enumerate(rows)], "qid string, question string, answer_type string"))
    names = spark.createDataFrame([(str(i), n) for i, n in clients], "qid string, client_name string")
    spans = resolve.named_categories(resolve.without_client(q.select("qid", "nq"), names), spark.createDataFrame([(x,) for x in LABELS], "category string"))
    got = {r.qid: r for r in rules.by_rules(q.drop("nq").join(spans, "qid", "left")).collect()}
    return [(got[str(i)].shape, got[str(i)].matched, json.loads(got[str(i)].plan) if got[str(i)].plan else None) for i in range(len(rows))]


def test_readings(spark):
    rows = [
        ("What is the gap between small buildings and roads?", "money"),
        ("Value excluding small buildings?", "money"),
        ("Works exceeding four crore?", "money"),
        ("What is the figure?", "percent"),
        ("Irrigation & Waterways Dept: value excluding buildings?", "money"),
        ("Irrigation & Waterways Dept: value excluding irrigation?", "money"),
        ("Roads highways and maintenance: how do they differ?", "money"),
        ("a b c and d e f g h i j against roads", "money"),
        ("", "count"),
        ("Worth at least 70cr across all our clients?", "money"),
        ("anything", "weight"),
    ]
    got = read(spark, rows, [(4, "Irrigation & Waterways Department"), (5, "Irrigation & Waterways Department")])
    pair = lambda p: [p[s]["filters"]["categories_in"] for s in ("left", "right")]
    assert got[0][0] == "category_pair_diff" and pair(got[0][2]) == [["small buildings"], ["roads"]]
    assert got[1][2]["left"]["filters"] == {"categories_not_in": ["small buildings"]}
    assert got[2][0] == "threshold_aggregate" and Decimal(got[2][2]["left"]["filters"]["min_value"]) == 40_000_000
    assert got[3][:2] == ("collection_pct", False) and got[3][2]["combine"] == "percent"
    assert got[4][2]["left"]["filters"] == {"categories_not_in": ["buildings"]}
    assert got[5][2]["left"]["filters"] == {"categories_not_in": ["irrigation"]}
    assert pair(got[6][2]) == [["roads highways"], ["roads maintenance"]]
    assert pair(got[7][2]) == [["a b c d e f g h i j"], ["roads"]]
    assert got[8][:2] == ("work_count", False)
    assert got[9][2]["left"]["scope"] == "corpus" and Decimal(got[9][2]["left"]["filters"]["min_value"]) == 700_000_000
    assert got[10] == (None, False, None)


def test_long_names(spark):
    people = spark.createDataFrame([(1, "anna maria luisa della torre e tasso"), (2, "anna maria")], "manager_key long, name_key string")
    q = resolve.asked(spark.createDataFrame([("a", "Works of Anna Maria Luisa della Torre e Tasso"), ("b", "of Anna Maria?")], "qid string, question string"))
    assert {(r.qid, r.manager_key) for r in resolve.named_managers(q, people).collect()} == {("a", 1), ("b", 2)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("contracts hitting the six crore mark", 60_000_000),
        ("INR 23.0 Cr", 230_000_000),
        ("twenty-six crore, not 5 lakh", 260_000_000),
        ("0 crore or 5 crore", 50_000_000),
        ("one hundred five lakhs", 10_500_000),
        ("a crore", None),
    ],
)
def test_amounts(spark, text, want):
    assert spark.range(1).select(X.find_amount(F.lit(text))).first()[0] == want


def test_selection(spark):
    random.seed(6)
    values = {k: [Decimal(random.choice([0, 1, -5, 10**13, random.randrange(-(10**14), 10**14)])) / 100 for _ in range(random.randint(1, 60))] for k in range(12)}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(0, None)], "k int, value decimal(18,2)").repartition(7)
    counts = selection.counted(rows, ["k"])
    ranks = spark.createDataFrame([(k, r) for k, vs in values.items() for r in range(1, len(vs) + 3)], "k int, rank int")
    got = {(r.k, r["rank"]): r.value for r in selection.at_ranks(counts, ["k"], ranks).collect()}
    assert got == {(k, i): v for k, vs in values.items() for i, v in enumerate(sorted(vs, reverse=True), 1)}
    assert {(r.k, r["rank"]) for r in selection.middle(counts, ["k"]).collect()} == {(k, r) for k, vs in values.items() for r in ((len(vs) + 1) // 2, (len(vs) + 2) // 2)}


def test_plans_have_no_pairs_of_all(spark):
    works = spark.createDataFrame([(k, k % 3, k % 2, ["low", "high"][k % 2], "x", "good", "Prime", Decimal(k), k % 2 == 0, "u") for k in range(50)], "pkg long, client_key long, manager_key long, category string, state string, grading string, role string, value decimal(18,2), has_ref boolean, business_unit string")
    works = works.withColumn("completed", F.lit("2020-01-05").cast("date"))
    measures = [("works", "corpus", "sum_value", {"min_value": str(k)}) for k in range(20)] + [("works", "corpus", "count", {"categories_in": ["high"], "role": "prime"})]
    rows = [(str(i), "q", "model", 0, json.dumps({"left": {"source": s, "scope": c, "agg": a, "filters": f}})) for i, (s, c, a, f) in enumerate(measures)]
    made = spark.createDataFrame(rows, "cid string, qid string, source string, place int, plan string")
    bound = answers.measures(answers.analyzed(made), spark.createDataFrame([("q", None, None, None, None)], "qid string, client_key long, manager_key long, pkg long, anchor_date date"))
    found = answers._rows(bound.where("m.source = 'works'"), works, "works", {"corpus": ""})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == sum(50 - k for k in range(20)) + 25


def test_measures_of_the_corpus_are_those_of_rows(spark):
    """Cells against a plain program: nulls, values at, between and beyond bounds, dates at bounds, ranks beyond the rows, nothing that passes."""
    random.seed(7)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    rows = [(k, k % 3, k % 2, random.choice(["low", "high", "", None]), random.choice(["x", "Y", None]), "good", random.choice(["Prime", "JV Partner"]), random.choice([None, *map(Decimal, (0, 5, 5, 7, 10, 11))]), random.random() < 0.5, "u", random.choice([None, day(0), day(400), day(401), day(800)])) for k in range(120)]
    works = spark.createDataFrame(rows, "pkg long, client_key long, manager_key long, category string, state string, grading string, role string, value decimal(18,2), has_ref boolean, business_unit string, completed date")
    filters = [{}, {"min_value": "5"}, {"max_value": "5"}, {"min_value": "5.01", "max_value": "10"}, {"min_value": "99"}, {"categories_in": ["low", "high"], "min_value": "7"}, {"categories_not_in": ["low"]}, {"years_in": [2021]}]
    filters += [{"completed_after": str(day(400))}, {"completed_before": str(day(400)), "role": "prime"}, {"completed_after": str(day(1)), "completed_before": str(day(401)), "has_reference_letter": True}, {"state": "y", "max_value": "10"}]
    aggs = ["count", "sum_value", "mean_value", "max_value", "min_value", "median_value", "nth_largest_value", "distinct_categories", "max_client_value"]
    plans = {f"{a}/{i}": json.dumps({"left": {"source": "works", "scope": "corpus", "agg": a, "n": 9, "filters": f}}) for a in aggs for i, f in enumerate(filters)}
    made = spark.createDataFrame([(c, "q", "model", 0, p) for c, p in plans.items()], "cid string, qid string, source string, place int, plan string")
    bound = answers.measures(answers.analyzed(made), spark.createDataFrame([("q", None, None, None, None)], "qid string, client_key long, manager_key long, pkg long, anchor_date date"))
    values = {r.mid: r.value for r in answers.evaluate(bound, works, spark.createDataFrame([], "client_key long, date date, invoiced decimal(18,2), received decimal(24,4), outstanding decimal(24,4), status string")).collect()}
    got = {r.cid: values.get(r.mid) for r in bound.select("cid", "mid").collect()}
    for name in plans:
        a, f = name.split("/")[0], filters[int(name.split("/")[1])]
        low, high, after, before = f.get("min_value"), f.get("max_value"), f.get("completed_after"), f.get("completed_before")
        hit = [r for r in rows if (not low or (r[7] is not None and r[7] >= Decimal(low))) and (not high or (r[7] is not None and r[7] <= Decimal(high))) and ("categories_in" not in f or r[3] in f["categories_in"]) and ("categories_not_in" not in f or r[3] != "low") and ("years_in" not in f or (r[10] and r[10].year == 2021)) and (not after or (r[10] and str(r[10]) > after)) and (not before or (r[10] and str(r[10]) < before)) and ("role" not in f or r[6] == "Prime") and ("has_reference_letter" not in f or r[8]) and ("state" not in f or r[4] == "Y")]
        v = sorted((r[7] for r in hit if r[7] is not None), reverse=True)
        clients = [sum(r[7] for r in hit if r[1] == k and r[7] is not None) for k in {r[1] for r in hit}]
        want = {"count": len(hit), "sum_value": sum(v) if v else None, "mean_value": sum(v) / len(hit) if v else None, "max_value": v[0] if v else None, "min_value": v[-1] if v else None, "median_value": (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None, "nth_largest_value": v[8] if len(v) > 8 else None, "distinct_categories": len({r[3] for r in hit} - {"", None}), "max_client_value": max(clients) if clients else None}[a]
        assert (got[name] is None) == (want is None) and (want is None or abs(got[name] - want) < Decimal("1e-5")), (name, got[name], want)


def test_works_are_counted_once_for_all_bounds(spark):
    """Each work is joined once, not once for each measure that it passes."""
    works = spark.createDataFrame([(k, k % 3, k % 2, "low", "x", "good", "Prime", Decimal(k), True, "u", datetime.date(2020, 1, 5)) for k in range(4000)], "pkg long, client_key long, manager_key long, category string, state string, grading string, role string, value decimal(18,2), has_ref boolean, business_unit string, completed date")
    rows = [(str(i), "q", "model", 0, json.dumps({"left": {"source": "works", "scope": "corpus", "agg": "count", "filters": {"min_value": str(100 * i)}}})) for i in range(30)]
    bound = answers.measures(answers.analyzed(spark.createDataFrame(rows, "cid string, qid string, source string, place int, plan string")), spark.createDataFrame([("q", None, None, None, None)], "qid string, client_key long, manager_key long, pkg long, anchor_date date"))
    met, _ = answers._met(bound, works, False)
    assert met.count() <= 30 * 61 and met.agg(F.sum("c")).first()[0] == sum(4000 - 100 * i for i in range(30))
