"""Question shapes to plans, as expressions over a table of questions.

A rule is a row of ``RULES``: shape, answer type, cue. Cues, what a shape needs besides (amounts, years, labels, words), and plans are columns, so the first
rule that holds is one expression for all questions and nothing runs outside the JVM. Labels come from the resolvers (``categories``, in the
order of the text, and ``category``, the longest), amounts and years from the scalar functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from .algebra import ANCHOR, Measure, Plan

# The words that shapes go by. First those that several rules share.
GRADES = r"satisfactory|very good|excellent|good"
REFERENCE_WORDS = r"referenc|endors|testimoni|sign.?off|letter of recommend|reference letter|formal verification|on file"
AWARD_WORDS = (
    r"awarded|award value|contract value|contract totals|sanctioned|secured|committed|approved contract|total scope|\bawards?\b|project value|handed over|"
    r"commitments|unbilled|(total|full|entire) value of (the |their |our )?(projects|works|assignments|jobs|contracts)"
)
GAP_WORDS = (
    r"how much (more|additional|further|else)|still need|need to (reach|hit|clear|secure|get|bring)|shortfall (to|against|towards)|fall short of|"
    r"to (reach|clear|hit|secure) (our|the|a)|make up|top up|more value do we need|remaining to (reach|hit)|credential threshold|qualifying threshold|"
    r"eligibility threshold|how far short"
)
CORPUS = (
    r"all (?:of )?(?:our |the )?(?:clients|customers|departments|authorities)|every (?:client|customer|department|authority)|company.?wide|firm.?wide|group.?wide|"
    r"across the (?:whole |entire )?(?:business|estate|company|group|organisation|organization)|(?:whole|entire) (?:business|estate|company)|in aggregate across (?:all|every)"
)
RECEIVED = r"\b(collected|received|receipts?|realised|realized|cash received)\b"
#: (shape, answer type, cue): the first of its type that holds wins. A point stands for any text.
RULES = [
    ("largest_client_share", "percent", r"largest|biggest|top\b|main|principal|primary|foremost|dominant|single (client|account)|leading"),
    ("collection_pct", "percent", r"collect|receipt|receiv|realis|realiz|recover|cash|\bpaid\b|payment|bill|invoic|clear|settle"),
    (
        "referenced_share",
        "percent",
        r"referenc|endors|testimoni|sign.?off|recommend|attest|vouch|formal verification|letter|approv|accept(ed|ance)|clearance|commend|praise",
    ),
    ("business_units", "count", r"business unit|internal (unit|team|division)|\bdivision|\bunits\b"),
    (
        "absence",
        "count",
        r"\black\b|lacking|missing|absent|without|unreferenced|no (client )?(reference|letter|testimonial|endorsement)|do(es)? not have|don.?t have|"
        r"never (received|got)|yet to (receive|be)",
    ),
    ("distinct_category", "count", r"categor|classification|work type|types? of work|kinds? of work|different (kinds|types)|discipline"),
    ("distinct_clients", "count", r"how many (distinct |different |separate )?(clients|departments|authorities|customers)"),
    ("work_count", "count", r"."),
    ("mean_minus_median", "money", r"\bmedian\b"),
    ("category_pair_diff", "money", r"."),
    (
        "gap_to_threshold",
        "money",
        r"how much (more|additional|further|else)|shortfall|short of|still need|need to (reach|hit|clear|secure|get)|to (reach|clear|hit|secure) (our|the|a)|"
        r"target|remaining to|make up|top up|fall short|threshold",
    ),
    (
        "receivables_balance",
        "money",
        r"\bowe|\bunpaid\b|outstand|\bpending\b|arrears|overdue|still (due|owed|open|to be (paid|collected|settled))|not been (paid|settled|cleared)|"
        r"yet to (pay|be paid|collect|clear|settle)|remain(s|ing)? (on|due|unpaid|outstanding|owing|to be)|(amount|balance|sum|value) (still |currently )?remain|"
        r"(currently|still|now) due|amount due|due (across|from|on)|balance\b",
    ),
    ("grading_filter", "money", r"grad(e|ed|ing)|rated|assessment|remark"),
    ("year_delta", "money", r"."),
    (
        "awarded_vs_invoiced",
        "money",
        r"invoic|\bbill|claim|raised against|submitted for payment|vs award|against[^.?]{0,25}(award|contract value|sanction|total scope)",
    ),
    ("top_n_clients", "money", r"top (two|three|2|3)|(two|three|2|3) (largest|biggest)|(largest|biggest) (two|three)"),
    ("rank_value", "money", r"(?=.*(largest|biggest|highest|top\b|greatest))(?=.*(second|\bnext\b|runner|one down|subsequent|behind|below (it|that)))"),
    (
        "exclusion_aggregate",
        "money",
        r"exclud|except|without|net of|minus|less the|leav(e|ing)|drop|strip|remove|removing|set aside|ignor|other than|besides|apart from|discount(ing)? the|"
        r"bar the|omit|filter(ing)? out|take out|taking out|not counting|barring|save for|put aside|carve out",
    ),
    ("threshold_aggregate", "money", r"."),
    ("role_split", "money", r"\bprime\b|\bjv\b|joint venture|lead partner|subcontract|sub-contract|in that capacity|as (the )?lead"),
    ("avg_work_size", "money", r"averag|\bmean\b|typical|per (project|work|assignment|job|contract)|\bavg\b|on average"),
    ("temporal_chain", "money", r"after|since|subsequent|following|post[- ]|later than|from that (date|point)|onward"),
    ("hop_aggregate", "money", r"."),
    ("date_span", "days", r"."),
]
#: The shape of a question that no rule reads.
DEFAULTS = {"money": "hop_aggregate", "count": "work_count", "percent": "collection_pct", "days": "date_span"}



def _said(words: str, text: str = "raw") -> Column:
    return F.rlike(text, F.lit(words))


#: What a shape needs besides its cue.
NEEDS: dict[str, Callable[[], Column]] = {
    "threshold_aggregate": lambda: F.col("amount").isNotNull() & ~_said(GAP_WORDS),
    "gap_to_threshold": lambda: F.col("amount").isNotNull() & _said(GAP_WORDS),
    "receivables_balance": lambda: ~_said(AWARD_WORDS),
    "awarded_vs_invoiced": lambda: _said(AWARD_WORDS),
    "year_delta": lambda: F.size("years") >= 2,
    "category_pair_diff": lambda: F.size("categories") >= 2,
    "grading_filter": lambda: _said(GRADES),
    "avg_work_size": lambda: ~_said(r"\bmedian\b"),
    "collection_pct": lambda: ~_said(REFERENCE_WORDS),
}


def _measure(agg: str = "sum_value", scope: str = "client", source: str = "works", n: int | Column = 2, value: Column | None = None, **filters: Column) -> Column:
    wide = F.when(F.col("corpus"), "corpus").otherwise(scope) if scope == "client" else F.lit(scope)
    fields = [F.lit(source).alias("source"), wide.alias("scope"), F.lit(agg).alias("agg"), (n if isinstance(n, Column) else F.lit(n)).alias("n")]
    if value is not None:
        fields.append(value.cast("string").alias("value"))
    if filters:
        fields.append(F.struct(*[c.alias(k) for k, c in filters.items()]).alias("filters"))
    return F.struct(*fields)


def _plan(left: Column, right: Column | None = None, combine: str = "left") -> Column:
    sides = [left.alias("left")] + ([right.alias("right")] if right is not None else [])
    return F.to_json(F.struct(*sides, F.lit(combine).alias("combine")))


def _invoices(agg: str) -> Column:
    return _measure(agg, source="invoices")


def _pair(column: str, key: str) -> Column:
    one = lambda i: _measure(**{key: F.array(F.get(column, F.lit(i)))})
    return _plan(one(0), one(1), "abs_difference")


def _awarded() -> Column:
    return F.when(_said(RECEIVED, "nq"), _plan(_measure(), _invoices("sum_received"), "abs_difference")).otherwise(_plan(_measure(), _invoices("sum_invoiced"), "abs_difference"))


def _excluding() -> Column:
    label = F.col("category")
    return F.when(label.isNotNull(), _plan(_measure(categories_not_in=F.array(label)))).otherwise(_plan(_measure(role=F.lit("Prime"))))


PLANS: dict[str, Callable[[], Column]] = {
    "largest_client_share": lambda: _plan(_measure("max_client_value", "engineer"), _measure("sum_value", "engineer"), "percent"),
    "collection_pct": lambda: _plan(_invoices("sum_received"), _invoices("sum_invoiced"), "percent"),
    "referenced_share": lambda: _plan(_measure("count", has_reference_letter=F.lit(True)), _measure("count"), "percent"),
    "business_units": lambda: _plan(_measure("distinct_business_units")),
    "absence": lambda: _plan(_measure("count", has_reference_letter=F.lit(False))),
    "distinct_category": lambda: _plan(_measure("distinct_categories", "engineer")),
    "distinct_clients": lambda: _plan(_measure("distinct_clients", "engineer")),
    "work_count": lambda: _plan(_measure("count")),
    "mean_minus_median": lambda: _plan(_measure("mean_value"), _measure("median_value"), "difference"),
    "category_pair_diff": lambda: _pair("categories", "categories_in"),
    "gap_to_threshold": lambda: _plan(_measure(source="constant", value=F.col("amount")), _measure(), "difference"),
    "receivables_balance": lambda: _plan(_invoices("sum_invoiced"), _invoices("sum_received"), "difference"),
    "grading_filter": lambda: _plan(_measure(grading=F.regexp_extract("raw", GRADES, 0))),
    "year_delta": lambda: _pair("years", "years_in"),
    "awarded_vs_invoiced": _awarded,
    "top_n_clients": lambda: _plan(_measure("top_n_sum_by_client", "engineer", n=F.when(_said(r"top (three|3)|(three|3) (largest|biggest)"), 3).otherwise(2))),
    "rank_value": lambda: _plan(_measure("nth_largest_value", n=1), _measure("nth_largest_value", n=2), "difference"),
    "exclusion_aggregate": _excluding,
    "threshold_aggregate": lambda: _plan(_measure(min_value=F.col("amount").cast("string"))),
    "role_split": lambda: _plan(_measure(role=F.when(_said(r"\bjv\b|joint venture|subcontract", "nq"), "JV Partner").otherwise("Prime"))),
    "avg_work_size": lambda: _plan(_measure("mean_value")),
    "temporal_chain": lambda: _plan(_measure(scope="engineer", completed_after=F.lit(ANCHOR))),
    "hop_aggregate": lambda: _plan(_measure()),
    "date_span": lambda: _plan(_measure("days_since_anchor_date", "work")),
}


def shaped(questions: DataFrame) -> DataFrame:
    """``questions`` (qid, question, answer_type, categories, category) with raw, nq, amount, years, corpus, shape and ``matched``: whether words, and not a
    catch-all or a default, chose the shape. An unknown answer type has no shape."""
    texts = questions.withColumn("raw", F.lower(X.squeeze(F.coalesce("question", F.lit(""))))).withColumn("nq", X.norm_question(F.coalesce("question", F.lit(""))))
    found = texts.withColumn("amount", X.find_amount(F.col("question"))).withColumn("years", X.years_in(F.col("raw"))).withColumn("corpus", _said(CORPUS))
    kind = F.col("answer_type")

    def holds(shape: str, cue: str) -> Column:
        said = F.length("raw") > 0 if cue == "." else _said(cue, "nq") | _said(cue)
        return said & F.coalesce(NEEDS[shape](), F.lit(False)) if shape in NEEDS else said

    first = F.lit(None).cast("string")
    for answer_type in DEFAULTS:
        own = F.coalesce(*[F.when(holds(shape, cue), shape) for shape, of, cue in RULES if of == answer_type])
        first = F.when(kind == answer_type, own).otherwise(first)
    default = F.coalesce(*[F.when(kind == answer_type, shape) for answer_type, shape in DEFAULTS.items()])
    open_rules = [shape for shape, _, cue in RULES if cue == "." and shape not in NEEDS]
    rows = found.withColumn("first", first)
    matched = F.coalesce(F.col("first").isNotNull() & ~F.col("first").isin(open_rules), F.lit(False))
    return rows.withColumn("shape", F.coalesce("first", default)).withColumn("matched", matched).drop("first")


def planned(shapes: DataFrame) -> DataFrame:
    """``shaped`` questions with ``plan``, as JSON. Whole-business wording widens measures of a client to the corpus."""
    plan = F.lit(None).cast("string")
    for shape, make in PLANS.items():
        plan = F.when(F.col("shape") == shape, make()).otherwise(plan)
    return shapes.withColumn("plan", plan)


def by_rules(questions: DataFrame) -> DataFrame:
    """cid, qid, source, place, plan, shape, matched: the rules' reading of every question (qid, question, answer_type, categories, category)."""
    out = planned(shaped(questions))
    return out.select(F.concat_ws("/", "qid", F.lit("rules")).alias("cid"), "qid", F.lit("rules").alias("source"), F.lit(0).alias("place"), "plan", "shape", "matched")


def classify_all(questions: list[tuple[str, str]], labels: list[str]) -> list[tuple[str | None, Plan | None, bool]]:
    """(shape, plan, matched) of a few questions (text, answer type), in the active session."""
    from ..operators import resolve

    spark = SparkSession.active()
    rows = [(str(i), text, kind) for i, (text, kind) in enumerate(questions)]
    asked = resolve.asked(spark.createDataFrame(rows, "qid string, question string, answer_type string"))
    known = spark.createDataFrame([(x,) for x in labels], "category string")
    found = asked.drop("nq").join(resolve.named_categories(asked, known), "qid", "left")
    got = {r.qid: r for r in by_rules(found).collect()}
    side = lambda m: m and Measure(**m)

    def plan(text: str | None) -> Plan | None:
        raw = json.loads(text) if text else None
        return raw and Plan(side(raw["left"]), side(raw.get("right")), raw["combine"])

    return [(r.shape, plan(r.plan), r.matched) for r in (got[qid] for qid, _, _ in rows)]


def classify(question: str, answer_type: str, labels: list[str]) -> tuple[str, Plan, bool]:
    """``classify_all`` of one question; ValueError for an unknown answer type."""
    shape, plan, matched = classify_all([(question, answer_type)], labels)[0]
    if plan is None:
        raise ValueError(f"unknown answer type {answer_type}")
    return shape, plan, matched
