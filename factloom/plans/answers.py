"""Questions to answers, for a whole table at once: plans, anchors, measures, votes, fallbacks.

Plans are data here: a table of candidates (cid, qid, source, place, plan as JSON) from the rules and from any model. Each is analyzed, its
measures are bound to the question's anchors, and measures that are equal are computed once. A measure joins the rows of its scope
by key and filters by its own columns, so no plan is compiled by itself and nothing loops on the driver. Whatever fails
has a null value and its error; a question without any answer takes its type's fallback.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import reconcile, resolve
from ..sources.scratch import cut, dealt
from . import rules, selection
from .algebra import ANCHOR, COMBINES, FILTERS, INVOICE_AGGS, KEYS, WORK_AGGS, Plan

_MEASURE = (
    "struct<source:string, scope:string, agg:string, n:int, value:string, filters:struct<categories_in:array<string>, categories_not_in:array<string>, role:string, "
    "grading:string, state:string, status:string, years_in:array<int>, completed_after:string, completed_before:string, min_value:string, max_value:string, has_reference_letter:boolean>>"
)
_PLAN = f"struct<left:{_MEASURE}, right:{_MEASURE}, combine:string>"
RANKED, BY_CLIENT = ["nth_largest_value", "median_value"], ["top_n_sum_by_client", "max_client_value"]


def to_json(plan: Plan) -> str:
    side = lambda m: m and {"source": m.source, "scope": m.scope, "agg": m.agg, "n": m.n, "value": m.value, "filters": {k: str(v) if k in ("min_value", "max_value") else v for k, v in m.filters.items()}}
    return json.dumps({"left": side(plan.left), "right": side(plan.right), "combine": plan.combine})


def analyzed(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``plan`` in normal form, or null and ``error``: the checks of ``algebra.analyze`` as expressions."""
    p = F.from_json("plan", _PLAN)
    parsed = candidates.withColumn("_p", p).withColumn("_combine", F.coalesce(F.get_json_object("plan", "$.combine"), F.lit("left")))

    def wrong(side: str) -> Column:
        m, raw = F.col(f"_p.{side}"), F.get_json_object("plan", f"$.{side}.filters")
        source, scope, agg = (F.coalesce(m[k], F.lit(v)) for k, v in (("source", "works"), ("scope", "client"), ("agg", "sum_value")))
        unknown = F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, FILTERS)))
        return (
            F.when(F.json_object_keys(F.get_json_object("plan", f"$.{side}")).isNull(), "a side is not an object")
            .when(source == "constant", F.when(m["value"].isNull(), "a constant needs a value"))
            .when(~source.isin("works", "invoices"), F.concat(F.lit("unknown source "), source))
            .when(~scope.isin(*KEYS), F.concat(F.lit("unknown scope "), scope))
            .when(~agg.isin(*WORK_AGGS, *INVOICE_AGGS), F.concat(F.lit("unknown aggregate "), agg))
            .when(agg.isin(*INVOICE_AGGS) != (source == "invoices"), F.concat(agg, F.lit(" is not an aggregate of "), source))
            .when(raw.isNotNull() & F.json_object_keys(raw).isNull(), "filters are not an object")
            .when(F.size(unknown) > 0, F.concat(F.lit("unknown filters "), F.array_join(unknown, ", ")))
        )

    two = F.col("_combine") != "left"
    error = (
        F.when(F.json_object_keys("plan").isNull(), "not JSON")
        .when(~F.col("_combine").isin(*COMBINES), F.concat(F.lit("unknown combine "), "_combine"))
        .when(two & F.get_json_object("plan", "$.right").isNull(), F.concat("_combine", F.lit(" needs a right side")))
    )
    error = F.concat(F.lit("invalid plan: "), F.coalesce(error, wrong("left"), F.when(two, wrong("right"))))

    def normal(side: str) -> Column:
        m = F.col(f"_p.{side}")
        date = lambda k: F.when(m["filters"][k].rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(m["filters"][k], 1, 10)).when(m["filters"][k].isNotNull(), ANCHOR)
        lower = lambda k: F.transform(m["filters"][k], F.lower)
        own = {"categories_in": lower("categories_in"), "categories_not_in": lower("categories_not_in"), "completed_after": date("completed_after"), "completed_before": date("completed_before")}
        filters = F.struct(*[own.get(k, m["filters"][k]).alias(k) for k in FILTERS])
        scalars = [F.coalesce(m[k], F.lit(v)).alias(k) for k, v in (("source", "works"), ("scope", "client"), ("agg", "sum_value"))]
        n = F.coalesce(F.nullif(m["n"], F.lit(0)), F.lit(2))
        return F.struct(*scalars, n.alias("n"), m["value"].alias("value"), F.when(m["filters"].isNotNull(), filters).alias("filters"))

    plan = F.to_json(F.struct(normal("left").alias("left"), F.when(two, normal("right")).alias("right"), F.col("_combine").alias("combine")))
    checked = parsed.withColumn("error", error)
    return checked.withColumn("plan", F.when(F.col("error").isNull(), plan)).drop("_p", "_combine")


def measures(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """cid, side, mid, m, key, anchor_date: each side of each plan, bound to its question's anchors; equal measures have one ``mid``."""
    planned = candidates.where("plan is not null").select("cid", "qid", F.from_json("plan", _PLAN).alias("p"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("p.left").alias("m")), F.struct(F.lit("r").alias("side"), F.col("p.right").alias("m")))
    each = planned.select("cid", "qid", F.explode(sides).alias("s")).select("cid", "qid", "s.side", "s.m").where("m is not null").join(anchors, "qid", "left")
    key = F.when(F.col("m.scope") == "corpus", F.lit(-1)).when(F.col("m.source") == "invoices", F.col("client_key"))
    key = key.when(F.col("m.scope") == "client", F.col("client_key")).when(F.col("m.scope") == "engineer", F.col("manager_key")).when(F.col("m.scope") == "work", F.col("pkg"))
    dated = (F.col("m.filters.completed_after") == ANCHOR) | (F.col("m.filters.completed_before") == ANCHOR) | (F.col("m.agg") == "days_since_anchor_date")
    date = F.when(F.coalesce(dated, F.lit(False)), F.col("anchor_date"))
    bound = each.select("cid", "side", "m", key.cast("long").alias("key"), date.alias("anchor_date"), F.coalesce(dated, F.lit(False)).alias("dated"))
    return bound.withColumn("mid", F.sha2(F.concat_ws("|", F.to_json("m"), F.col("key").cast("string"), F.col("anchor_date").cast("string")), 256))


def _passes(source: str) -> Column:
    """Whether a row passes its measure's filters; a filter that is null is none."""
    f = lambda name: F.col(f"m.filters.{name}")
    date = F.col("completed" if source == "works" else "date")
    bound = lambda name: F.when(f(name) == ANCHOR, F.col("anchor_date")).otherwise(f(name).try_cast("date"))
    same = lambda c: f(c).isNull() | (F.lower(F.coalesce(F.col(c), F.lit(""))) == F.lower(f(c)))
    ok = (f("years_in").isNull() | F.array_contains(f("years_in"), F.year(date))) & (f("completed_after").isNull() | (date > bound("completed_after"))) & (f("completed_before").isNull() | (date < bound("completed_before")))
    if source == "invoices":
        return ok & same("status")
    ok &= (f("categories_in").isNull() | F.array_contains(f("categories_in"), F.col("category"))) & (f("categories_not_in").isNull() | ~F.array_contains(f("categories_not_in"), F.coalesce("category", F.lit(""))))
    ok &= (f("min_value").isNull() | (F.col("value") >= f("min_value").try_cast("decimal(18,2)"))) & (f("max_value").isNull() | (F.col("value") <= f("max_value").try_cast("decimal(18,2)")))
    return ok & same("role") & same("grading") & same("state") & (f("has_reference_letter").isNull() | (F.col("has_ref") == f("has_reference_letter")))


#: A measure of the whole corpus meets rows by one column that it asks to be equal: (column, filter), the first that it has.
_EQUAL = {
    "works": [("category", "categories_in"), ("year", "years_in"), ("state", "state"), ("grading", "grading"), ("role", "role"), ("has_ref", "has_reference_letter")],
    "invoices": [("year", "years_in"), ("status", "status")],
}
#: Rows of one value are dealt over so many lots, each of which has all measures of that value.
LOTS = 64


def _corpus_rows(of: DataFrame, facts: DataFrame, source: str) -> DataFrame | None:
    """Rows that measures of the whole corpus may take: a join on the value of one of the columns that a measure restricts, so a row meets only
    measures of its category (or year, state, ...) and those without any such filter. No measure is too many, and no value too frequent."""
    names = [name for name, _ in _EQUAL[source]]

    def wanted(f: str) -> Column:
        values = F.col(f"m.filters.{f}")
        return F.array_distinct(F.transform(values, lambda v: F.lower(v.cast("string")))) if f.endswith("_in") else F.array(F.lower(values.cast("string")))

    def own(name: str) -> Column:
        value = F.year("completed" if source == "works" else "date") if name == "year" else F.col(name)
        return F.lower(F.coalesce(value.cast("string"), F.lit(""))) if name != "category" else F.lower("category")

    has = {name: F.col(f"m.filters.{f}").isNotNull() for name, f in _EQUAL[source]}
    kind = F.coalesce(*[F.when(has[name], name) for name in names], F.lit("any"))
    values = F.coalesce(*[F.when(has[name], wanted(f)) for name, f in _EQUAL[source]], F.array(F.lit("")))
    part = of.withColumn("_kind", kind).withColumn("_at", F.explode(values)).withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    used = [r[0] for r in part.select("_kind").distinct().collect()]  # names of columns
    if not used:
        return None
    at = F.array(*[F.struct(F.lit(k).alias("_kind"), (F.lit("") if k == "any" else own(k)).alias("_at")) for k in used])
    lot = F.pmod(F.xxhash64(*facts.columns), F.lit(LOTS)).cast("int")
    rows = facts.withColumn("_lot", lot).withColumn("_k", F.explode(at)).select("*", "_k._kind", "_k._at").drop("_k")
    return part.join(rows, ["_kind", "_at", "_lot"]).drop("_kind", "_at", "_lot")


def _rows(of: DataFrame, facts: DataFrame, source: str, keys: dict[str, str]) -> DataFrame:
    """Rows of each measure's scope that pass its filters: joined by the scope's key, or, for the whole corpus, by ``_corpus_rows``."""
    out = None
    for scope, key in keys.items():
        part = of.where(F.col("m.scope") == scope) if source == "works" else of.where((F.col("m.scope") == "corpus") == (scope == "corpus"))
        joined = _corpus_rows(part, facts, source) if scope == "corpus" else part.join(facts, part["key"] == facts[key])
        if joined is not None:
            out = joined if out is None else out.unionByName(joined)
    return out.where(_passes(source))


#: Aggregates of the whole corpus that come from cells of rows: of all rows that no filter tells apart.
OF_CELLS = ["count", "sum_value", "mean_value", "max_value", "min_value", *RANKED]
#: Bounds of a column that are looked up for each row; where there are more, each value is apart.
BOUNDS = 1_000


def _band(of: DataFrame, facts: DataFrame, column: str, bounds: Column) -> DataFrame:
    """``facts`` with ``_column``, equal for values that lie alike to all ``bounds`` of the measures: below, at or above each."""
    each = of.select(F.explode(bounds).alias("b")).where("b is not null").distinct()
    if each.limit(BOUNDS + 1).count() > BOUNDS:
        return facts.withColumn(f"_{column}", F.col(column))
    at = F.size(F.filter("_bounds", lambda b: b < F.col(column))) + F.size(F.filter("_bounds", lambda b: b <= F.col(column)))
    return facts.crossJoin(F.broadcast(each.agg(F.collect_list("b").alias("_bounds")))).withColumn(f"_{column}", F.when(F.col(column).isNotNull(), at)).drop("_bounds")


def _met(of: DataFrame, works: DataFrame, ranked: bool) -> tuple[DataFrame, DataFrame]:
    """mid, agg, cell, c, s, hi, lo, k (rows with a value) of the cells that each measure of the whole corpus meets; cell, cents, n of all values.

    Works are counted once by what the measures' filters tell apart, not once for each measure that takes them. A cell's rows pass the same
    filters, so any of them stands for all; columns that no filter looks at are null.
    """
    f = lambda name: F.col(f"m.filters.{name}")
    known = ["categories_in", "categories_not_in", "role", "grading", "state", "has_reference_letter", "years_in", "completed_after", "completed_before", "min_value", "max_value"]
    used = of.agg(*[F.coalesce(F.bool_or(f(n).isNotNull()), F.lit(False)).alias(n) for n in known]).first()
    by = [c for c, names in {"category": known[:2], "role": ["role"], "grading": ["grading"], "state": ["state"], "has_ref": ["has_reference_letter"]}.items() if any(used[n] for n in names)]
    own, rows = list(by), works.select("category", "role", "grading", "state", "has_ref", "completed", "value")
    if used.years_in:
        rows, own = rows.withColumn("_year", F.year("completed")), [*own, "_year"]
    if used.completed_after or used.completed_before:
        bound = lambda name: F.when(f(name) == ANCHOR, F.col("anchor_date")).otherwise(f(name).try_cast("date"))
        rows, own = _band(of, rows, "completed", F.array(bound("completed_after"), bound("completed_before"))), [*own, "_completed"]
    if used.min_value or used.max_value:
        rows, own = _band(of, rows, "value", F.array(*[f(n).try_cast("decimal(18,2)") for n in ("min_value", "max_value")])), [*own, "_value"]
    cell = F.to_json(F.struct(F.lit(0).alias("_"), *own)).alias("cell")
    dated = [F.min("completed").alias("completed")] if "_year" in own or "_completed" in own else []
    unseen = [F.lit(None).cast(works.schema[c].dataType).alias(c) for c in ("category", "role", "grading", "state", "has_ref", *(() if dated else ("completed",))) if c not in by]
    cents = [(-(F.col("value") * 100).cast("long")).alias("cents")] if ranked else []
    money = [F.count("*").alias("c"), F.sum("value").alias("s"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("value").alias("k")]
    counts = cut(rows.groupBy(*own, *cents).agg(*dated, *money).withColumn("cell", cell), "values-of-cells")
    again = [F.sum("c").alias("c"), F.sum("s").cast("decimal(28,2)").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("k").alias("k")]
    cells = cut(counts.groupBy("cell", *own).agg(*dated, *again).select("*", *unseen, F.col("lo").alias("value")), "cells")
    met = cut(_corpus_rows(of, cells, "works").where(_passes("works")).select("mid", F.col("m.agg").alias("agg"), "cell", "c", "s", "hi", "lo", "k"), "met")
    return met, counts.where("cents is not null").select("cell", "cents", F.col("k").alias("n")) if ranked else None


def evaluate(bound: DataFrame, works: DataFrame, invoices: DataFrame) -> DataFrame:
    """mid, value of every distinct measure; counts of nothing are 0, other aggregates of nothing have no row.

    Only sources, scopes and aggregates that occur are computed: a branch without measures would read the works all the same.
    """
    distinct = cut(bound.where("m.source != 'constant' and key is not null and (not dated or anchor_date is not null)").select("mid", "m", "key", "anchor_date").dropDuplicates(["mid"]), "measures")
    occur = [(r[0], r[1], r[2]) for r in distinct.select("m.source", "m.scope", "m.agg").distinct().collect()]  # names
    keys = {"client": "client_key", "engineer": "manager_key", "work": "pkg", "corpus": ""}
    agg, exact, corpus = F.col("m.agg"), lambda c: c.cast("decimal(38,8)"), F.col("m.scope") == "corpus"
    w = distinct.where("m.source = 'works'")
    parts = [distinct.where("false").select("mid", exact(F.lit(0)).alias("value"))]

    def scopes(able) -> dict[str, str]:
        return {k: v for k, v in keys.items() if any(source == "works" and scope == k and able(a, scope) for source, scope, a in occur)}

    sums = []
    by_rows = scopes(lambda a, scope: a not in (*RANKED, *BY_CLIENT) and not (scope == "corpus" and a in OF_CELLS))
    if by_rows:
        simple = _rows(w.where(~agg.isin(*RANKED, *BY_CLIENT) & ~(corpus & agg.isin(*OF_CELLS))), works, "works", by_rows)
        kinds = {"distinct_categories": F.nullif("category", F.lit("")), "distinct_states": F.nullif("state", F.lit("")), "distinct_clients": F.coalesce("client_key", F.lit(-1)).cast("string"), "distinct_managers": F.coalesce("manager_key", F.lit(-1)).cast("string"), "distinct_business_units": F.col("business_unit")}
        what = F.lit(None).cast("string")
        for name, column in kinds.items():
            what = F.when(agg == name, column.cast("string")).otherwise(what)
        sums.append(simple.withColumn("what", what).groupBy("mid", F.col("m.agg").alias("agg")).agg(F.count("*").alias("c"), F.count_distinct("what").alias("k"), F.sum("value").alias("s"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.max(F.datediff("completed", "anchor_date")).alias("days")))
    if scopes(lambda a, scope: scope == "corpus" and a in OF_CELLS):
        ranked = bool(scopes(lambda a, scope: scope == "corpus" and a in RANKED))
        of = w.where(corpus & agg.isin(*OF_CELLS))
        met, counts = _met(of, works, ranked)
        sums.append(met.where(~F.col("agg").isin(*RANKED)).groupBy("mid", "agg").agg(F.sum("c").alias("c"), F.lit(None).cast("long").alias("k"), F.sum("s").cast("decimal(28,2)").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.lit(None).cast("int").alias("days")))
        if ranked:
            met = met.where(F.col("agg").isin(*RANKED))
            medians = selection.middle(met.where("agg = 'median_value'").select("mid", F.col("k").alias("n")), ["mid"])
            nth = of.where(agg == "nth_largest_value").select("mid", F.greatest(F.lit(1), F.col("m.n")).cast("long").alias("rank"))
            chosen = selection.at_ranks(counts, ["mid"], cut(nth.unionByName(medians), "ranks"), met.select("mid", "cell"))
            parts.append(chosen.groupBy("mid").agg(exact(F.sum("value").cast("decimal(28,8)") / F.count("*")).alias("value")))
    if sums:
        a = F.col("agg")
        value = F.when(a == "count", exact(F.col("c"))).when(a == "distinct_business_units", exact(F.nullif("k", F.lit(0)))).when(a.startswith("distinct"), exact(F.col("k"))).when(a == "sum_value", exact(F.col("s")))
        value = value.when(a == "mean_value", exact(F.col("s").cast("decimal(28,8)") / F.col("c"))).when(a == "max_value", exact(F.col("hi"))).when(a == "min_value", exact(F.col("lo"))).when((a == "days_since_anchor_date") & (F.col("c") == 1), exact(F.col("days")))
        every = cut((sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])).select("mid", value.alias("value")), "sums")
        parts.append(every)
        # counts of nothing
        parts.append(w.where(agg.startswith("count") | (agg.startswith("distinct") & (agg != "distinct_business_units"))).join(every, "mid", "left_anti").select("mid", exact(F.lit(0)).alias("value")))
    of_mid = Window.partitionBy("mid")
    if by := scopes(lambda a, scope: a in RANKED and scope != "corpus"):
        ranked = _rows(w.where(agg.isin(*RANKED) & ~corpus), works, "works", by).withColumn("_n", F.row_number().over(of_mid.orderBy(F.col("value").desc(), "pkg"))).withColumn("_c", F.count("*").over(of_mid))
        parts.append(ranked.where((agg == "nth_largest_value") & (F.col("_n") == F.greatest(F.lit(1), F.col("m.n")))).select("mid", exact(F.col("value")).alias("value")))
        parts.append(ranked.where((agg == "median_value") & F.expr("_n in (floor((_c + 1) / 2), floor((_c + 2) / 2))")).groupBy("mid").agg(exact(F.sum("value").cast("decimal(28,8)") / F.count("*")).alias("value")))
    if by := scopes(lambda a, scope: a in BY_CLIENT):
        clients = _rows(w.where(agg.isin(*BY_CLIENT)), works, "works", by).groupBy("mid", "m", "client_key").agg(F.sum("value").alias("v"))
        top = F.row_number().over(of_mid.orderBy(F.col("v").desc(), "client_key"))
        most = F.when(agg == "max_client_value", 1).otherwise(F.greatest(F.lit(1), F.col("m.n")))
        parts.append(clients.withColumn("_n", top).where(F.col("_n") <= most).groupBy("mid").agg(exact(F.sum("v")).alias("value")))
    if by := {("corpus" if scope == "corpus" else "client"): ("" if scope == "corpus" else "client_key") for source, scope, _ in occur if source == "invoices"}:
        i = distinct.where("m.source = 'invoices'")
        a = F.col("agg")
        billed = _rows(i, invoices, "invoices", by).groupBy("mid", F.col("m.agg").alias("agg")).agg(F.count("*").alias("c"), *(F.sum(c).alias(c) for c in ("invoiced", "received", "outstanding")))
        value = F.when(a == "count_invoices", exact(F.col("c"))).when(a == "sum_invoiced", exact(F.col("invoiced"))).when(a == "sum_received", exact(F.col("received"))).otherwise(exact(F.col("outstanding")))
        billed = cut(billed.select("mid", value.alias("value")), "billed")
        parts += [billed, i.where(agg == "count_invoices").join(billed, "mid", "left_anti").select("mid", exact(F.lit(0)).alias("value"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def executed(candidates: DataFrame, anchors: DataFrame, works: DataFrame, invoices: DataFrame) -> DataFrame:
    """``candidates`` with ``value`` and ``error``; a failure is a row's error, never the job's."""
    candidates = cut(analyzed(dealt(candidates)), "candidates")
    bound = cut(measures(candidates, anchors), "bound")
    known = cut(evaluate(bound, works, invoices).where("value is not null"), "values")
    sides = bound.join(known, "mid", "left").select("cid", "side", F.when(F.col("m.source") == "constant", F.col("m.value").try_cast("decimal(38,8)")).otherwise(F.col("value")).alias("v"), (F.col("key").isNull() & (F.col("m.source") != "constant")).alias("lost"), (F.col("dated") & F.col("anchor_date").isNull()).alias("undated"))
    both = sides.groupBy("cid").agg(F.max(F.when(F.col("side") == "l", F.col("v"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("v"))).alias("r"), F.bool_or("lost").alias("lost"), F.bool_or("undated").alias("undated"))
    combine = F.get_json_object("plan", "$.combine")
    l, r = F.col("l"), F.col("r")  # noqa: E741
    percent = F.try_divide(l.cast("double") * 100, r.cast("double")).cast("decimal(38,8)")
    value = F.when(combine == "left", l).when(combine == "difference", l - r).when(combine == "sum", l + r).when(combine == "abs_difference", F.abs(l - r)).when(combine == "percent", percent)
    error = F.coalesce("error", F.when(F.col("lost"), "the question names no such entity").when(F.col("undated"), "no date to compare with").when(F.col("value").isNull(), "nothing to compute from"))
    out = candidates.join(both, "cid", "left").withColumn("value", value.cast("decimal(38,8)"))
    return out.withColumn("error", error).drop("l", "r", "lost", "undated")


def fallbacks(works: DataFrame, invoices: DataFrame) -> DataFrame:
    """answer_type, value: a figure of the right size for questions that nothing could answer."""
    clients = works.groupBy("client_key").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("v")).agg(F.median("v").alias("money"), F.median("n").cast("double").alias("count"))
    paid = invoices.groupBy("client_key").agg((F.sum("received").cast("double") * 100).alias("r"), F.sum("invoiced").cast("double").alias("i")).agg(F.median(F.try_divide("r", "i")).alias("percent"))
    row = clients.crossJoin(paid).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("money", "count", "percent", "days"))), F.array("money", F.coalesce("count", F.lit(1.0)), F.coalesce("percent", F.lit(50.0)), F.lit(365.0)))).alias("answer_type", "value"))
    return row  # a row for each type


def answer(questions: DataFrame, works: DataFrame, invoices: DataFrame, managers: DataFrame, table: DataFrame, credentials: DataFrame, model: DataFrame | None = None, trust: str = "consensus", states: DataFrame | None = None) -> DataFrame:
    """qid, answer, source, shape, client_key, error, values of every question (qid, question, answer_type); ``values``: the distinct answers of its plans.

    ``works`` has ``anchor``-free facts with business_unit and work_name; ``model``: qid, place, plan (JSON) of a model's plans, if there are any. The
    rules are sure of a question if a cue matched, the plan ran, and the client isn't just the engineer's principal account. Works are made once: some
    twenty steps read them.
    """
    works = cut(works, "works")
    anchors = cut(resolve.anchors(questions, works, managers, table, credentials, states), "anchors")
    names = works.groupBy("client_key").agg(F.min_by("client_name", "pkg").alias("client_name"))
    told = anchors.where(F.col("client_from").isin("question", "mention")).select("qid", "client_key").join(names, "client_key")
    labels = works.where("category != ''").select("category").distinct()
    spans = resolve.named_categories(resolve.without_client(resolve.asked(questions).select("qid", "nq"), told), labels)
    ruled = cut(rules.by_rules(dealt(questions.select("qid", "question", "answer_type").join(spans, "qid", "left"))), "ruled")
    every = ruled.select("cid", "qid", "source", "place", "plan")
    if model is not None:
        every = every.unionByName(model.select(F.concat_ws("/", "qid", F.lit("model"), "place").alias("cid"), "qid", F.lit("model").alias("source"), F.col("place").cast("int").alias("place"), "plan"))
    ran = cut(executed(every, anchors, works, invoices), "ran")
    kinds = questions.select("qid", "answer_type")
    sure = ruled.select("qid", "shape", "matched").join(anchors.select("qid", "client_key", "client_from"), "qid", "left")
    confident = F.col("matched") & (F.coalesce("client_from", F.lit("")) != "the engineer's principal account")
    votes = ran.join(kinds, "qid").join(sure, "qid", "left").select("qid", "source", "place", X.coerce(F.col("value"), F.col("answer_type")).alias("answer"), F.coalesce(confident, F.lit(False)).alias("confident"))
    picked = reconcile.reconcile(votes, trust)
    values = votes.groupBy("qid").agg(F.array_sort(F.collect_set("answer")).alias("values"))
    errors = ran.where("source = 'rules'").select("qid", "error").join(values, "qid", "left")
    last = fallbacks(works, invoices).select("answer_type", X.coerce(F.col("value"), F.col("answer_type")).alias("last"))
    out = picked.join(kinds, "qid").join(F.broadcast(last), "answer_type", "left").join(sure, "qid", "left").join(errors, "qid", "left")
    return out.select("qid", F.coalesce("answer", "last").alias("answer"), "source", "shape", "client_key", "error", "values")
