"""The closed plan algebra: source x scope x filters x aggregate, one or two measures, one combiner.

A plan is analyzed before any DataFrame exists. It then compiles to one answer for each entity of its scope at once
(every client, every engineer, or the corpus), so a batch of anchors costs one aggregation; a single anchor is a filter on the
result's key, which the optimizer pushes to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection

KEYS = {"client": ["client_key"], "engineer": ["manager_key"], "work": ["pkg"], "corpus": []}
WORK_AGGS = ["count", "distinct_categories", "distinct_clients", "distinct_managers", "distinct_states", "distinct_business_units", "days_since_anchor_date", "sum_value", "mean_value", "median_value", "max_value", "min_value", "nth_largest_value", "top_n_sum_by_client", "max_client_value"]
INVOICE_AGGS = ["count_invoices", "sum_invoiced", "sum_received", "sum_outstanding"]
FILTERS = ["categories_in", "categories_not_in", "role", "years_in", "completed_after", "completed_before", "min_value", "max_value", "has_reference_letter", "grading", "state", "status"]
COMBINES = ["left", "difference", "sum", "abs_difference", "percent"]
ANCHOR = "ANCHOR_DATE"


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Measure:
    source: str = "works"
    scope: str = "client"
    agg: str = "sum_value"
    filters: dict = field(default_factory=dict)
    n: int = 2
    value: str | None = None


@dataclass(frozen=True)
class Plan:
    left: Measure
    right: Measure | None = None
    combine: str = "left"


def _measure(m: Measure) -> Measure:
    if m.source == "constant":
        if m.value is None:
            raise PlanError("a constant needs a value")
        return m
    if m.source not in ("works", "invoices"):
        raise PlanError(f"unknown source {m.source}")
    if m.scope not in KEYS:
        raise PlanError(f"unknown scope {m.scope}")
    if m.agg not in WORK_AGGS + INVOICE_AGGS:
        raise PlanError(f"unknown aggregate {m.agg}")
    if (m.agg in INVOICE_AGGS) != (m.source == "invoices"):
        raise PlanError(f"{m.agg} is not an aggregate of {m.source}")
    if not isinstance(m.filters, dict):
        raise PlanError("filters are not an object")
    if unknown := set(m.filters) - set(FILTERS):
        raise PlanError(f"unknown filters {sorted(unknown)}")
    filters = dict(m.filters)
    for k in ("categories_in", "categories_not_in"):
        if k in filters:
            filters[k] = [str(x).lower() for x in filters[k]]
    for k in ("completed_after", "completed_before"):
        if k in filters:
            import re

            filters[k] = filters[k][:10] if re.match(r"\d{4}-\d{2}-\d{2}", str(filters[k])) else ANCHOR
    return Measure(m.source, m.scope, m.agg, filters, m.n or 2, m.value)


def analyze(plan: Plan) -> Plan:
    """Validate and normalise; every plan goes through it."""
    if plan.combine not in COMBINES:
        raise PlanError(f"unknown combine {plan.combine}")
    if plan.combine != "left" and plan.right is None:
        raise PlanError(f"{plan.combine} needs a right side")
    return Plan(_measure(plan.left), _measure(plan.right) if plan.right and plan.combine != "left" else None, plan.combine)


def to_corpus(plan: Plan) -> Plan:
    """Scope rewrite: measures of a client become those of the corpus."""
    wide = lambda m: m and (Measure(m.source, "corpus", m.agg, m.filters, m.n, m.value) if m.scope == "client" else m)
    return Plan(wide(plan.left), wide(plan.right), plan.combine)


def describe(plan: Plan) -> str:
    one = lambda m: m.value if m.source == "constant" else f"{m.agg}({m.scope} {m.source}{' ' + str(m.filters) if m.filters else ''})"
    return one(plan.left) if plan.right is None else f"{plan.combine}({one(plan.left)}, {one(plan.right)})"


def condition(m: Measure) -> Column:
    """All filters as one predicate; those that don't apply to invoices are true there."""
    date, f, out = F.col("completed" if m.source == "works" else "date"), m.filters, F.lit(True)
    same = lambda c, v: F.lower(F.coalesce(F.col(c), F.lit(""))) == str(v).lower()
    bound = lambda v: F.col("anchor_date") if v == ANCHOR else F.lit(v).cast("date")
    if "years_in" in f:
        out &= F.year(date).isin(*f["years_in"])
    if "completed_after" in f:
        out &= date > bound(f["completed_after"])
    if "completed_before" in f:
        out &= date < bound(f["completed_before"])
    if m.source == "invoices":
        return out & same("status", f["status"]) if "status" in f else out
    if "categories_in" in f:
        out &= F.col("category").isin(*f["categories_in"])
    if "categories_not_in" in f:
        out &= ~F.coalesce(F.col("category"), F.lit("")).isin(*f["categories_not_in"])
    for k in ("role", "grading", "state"):
        if k in f:
            out &= same(k, f[k])
    if "min_value" in f:
        out &= F.col("value") >= F.lit(f["min_value"]).cast("decimal(18,2)")
    if "max_value" in f:
        out &= F.col("value") <= F.lit(f["max_value"]).cast("decimal(18,2)")
    if "has_reference_letter" in f:
        out &= F.col("has_ref") == F.lit(bool(f["has_reference_letter"]))
    return out


def _aggregate(m: Measure, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    ok, value = condition(m), F.col("value") if m.source == "works" else None
    if m.agg in ("top_n_sum_by_client", "max_client_value"):
        sums = rows.where(ok).groupBy(*dict.fromkeys([*keys, "client_key"])).agg(F.sum("value").alias("v"))
        if m.agg == "max_client_value":
            return sums.groupBy(*keys).agg(F.max("v").alias(name))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("v").desc(), "client_key"))
        return sums.withColumn("_n", rank).where(F.col("_n") <= max(1, m.n)).groupBy(*keys).agg(F.sum("v").alias(name))
    if m.agg in ("nth_largest_value", "median_value") and not keys:
        counts = selection.counted(rows.where(ok), [])
        ranks = counts.agg(F.lit(max(1, m.n)).alias("rank")) if m.agg == "nth_largest_value" else selection.middle(counts, [])
        return selection.at_ranks(counts, [], ranks).agg((F.sum("value") / F.count("*")).alias(name))
    if m.agg in ("nth_largest_value", "median_value"):
        order = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "pkg")
        ranked = rows.where(ok).withColumn("_n", F.row_number().over(order))
        if m.agg == "nth_largest_value":
            return ranked.where(F.col("_n") == max(1, m.n)).select(*keys, F.col("value").alias(name))
        ranked = ranked.withColumn("_c", F.count("*").over(Window.partitionBy(*keys)))
        return ranked.where("_n in (floor((_c + 1) / 2), floor((_c + 2) / 2))").groupBy(*keys).agg((F.sum("value") / F.count("*")).alias(name))
    pick = lambda c: F.when(ok, c)
    one = {
        "count": lambda: F.count(pick(F.lit(1))),
        "count_invoices": lambda: F.count(pick(F.lit(1))),
        "distinct_categories": lambda: F.count_distinct(pick(F.nullif("category", F.lit("")))),
        "distinct_states": lambda: F.count_distinct(pick(F.nullif("state", F.lit("")))),
        "distinct_clients": lambda: F.count_distinct(pick(F.coalesce("client_key", F.lit(-1)))),
        "distinct_managers": lambda: F.count_distinct(pick(F.coalesce("manager_key", F.lit(-1)))),
        "distinct_business_units": lambda: F.nullif(F.count_distinct(pick(F.col("business_unit"))), F.lit(0)),
        "days_since_anchor_date": lambda: F.when(F.count(pick(F.lit(1))) == 1, F.max(pick(F.datediff("completed", "anchor_date")))),
        "sum_value": lambda: F.sum(pick(value)),
        "mean_value": lambda: F.sum(pick(value)).cast("decimal(38,10)") / F.count(pick(F.lit(1))),
        "max_value": lambda: F.max(pick(value)),
        "min_value": lambda: F.min(pick(value)),
        "sum_invoiced": lambda: F.sum(pick(F.col("invoiced"))),
        "sum_received": lambda: F.sum(pick(F.col("received"))),
        "sum_outstanding": lambda: F.sum(pick(F.col("outstanding"))),
    }[m.agg]
    if not keys or m.agg.startswith(("count", "distinct")):
        return rows.groupBy(*keys).agg(one().alias(name))
    return rows.where(ok).groupBy(*keys).agg(one().alias(name))


def run(plan: Plan, works: DataFrame, invoices: DataFrame | None = None) -> DataFrame:
    """One row for each entity of the left scope: its key and ``value`` (null stands for an error: no rows, zero denominator)."""
    plan = analyze(plan)
    source = {"works": works, "invoices": invoices}

    def side(m: Measure, name: str) -> tuple[DataFrame | None, list[str]]:
        if m.source == "constant":
            return None, []
        keys = KEYS[m.scope] if m.source == "works" or m.scope == "corpus" else ["client_key"]
        return _aggregate(m, source[m.source], keys, name), keys

    if plan.right is None:
        out, keys = side(plan.left, "value")
        if out is None:
            raise PlanError("a constant alone is no plan")
        return out.where(F.col(keys[0]).isNotNull()) if keys else out
    (left, lk), (right, rk) = side(plan.left, "l"), side(plan.right, "r")
    if left is None and right is None:
        raise PlanError("two constants are no plan")
    if left is None or right is None:
        m, have, keys = (plan.left, right, rk) if left is None else (plan.right, left, lk)
        both = have.withColumn("l" if left is None else "r", F.lit(m.value).cast("decimal(18,2)"))
    else:
        keys = lk
        both = left.join(right, lk, "full") if lk and lk == rk else left.crossJoin(right) if not lk and not rk else left.join(F.broadcast(right), how="cross") if not rk else left.join(right, rk, "left")
    l, r = F.col("l"), F.col("r")  # noqa: E741
    value = {"difference": l - r, "sum": l + r, "abs_difference": F.abs(l - r), "percent": F.try_divide(l.cast("double") * 100, r.cast("double"))}[plan.combine]
    out = both.select(*keys, value.alias("value"))
    return out.where(F.col(keys[0]).isNotNull()) if keys else out
