"""Every query by name, each with the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as X
from .operators import documents, facts, reconcile, resolve
from .plans import rules
from .plans.algebra import Measure, Plan, run

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None, views: bool = True) -> None:
    _queries[name] = query
    if sql:
        _sql[name] = facts.VIEWS + (sql if not sql.startswith("with ") else ", " + sql[5:]) if views else sql


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    works = facts.works(spark, sf_dir)
    return works.join(facts.units(spark, sf_dir).withColumnRenamed("issued", "anchor_date"), "manager_key", "left"), facts.invoices(spark, sf_dir)


def _plan(name: str, plan: Plan, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(plan, *_facts(spark, sf_dir))
        return out.withColumn("value", F.col("value").cast("double"))

    _add(name, query, sql)


_W = lambda agg="sum_value", scope="client", n=2, **f: Measure("works", scope, agg, f, n)
_I = lambda agg="sum_invoiced", scope="client", **f: Measure("invoices", scope, agg, f)
_BY = "select client_key, cast({} as double) as value from {} where {} group by client_key"
_UW = "work left join unit using (manager_key)"

# filters
for _name, _f, _c in [
    ("works_excluding_category", {"categories_not_in": ["Urgent"]}, "category not in ('urgent')"),
    ("works_in_categories", {"categories_in": ["high", "low"]}, "category in ('high', 'low')"),
    ("works_by_role", {"role": "prime"}, "lower(role) = 'prime'"),
    ("works_in_years", {"years_in": [1996, 1998]}, "year(completed) in (1996, 1998)"),
    ("completed_after", {"completed_after": "1997-06-30"}, "completed > date '1997-06-30'"),
    ("completed_before", {"completed_before": "1997-06-30"}, "completed < date '1997-06-30'"),
    ("threshold_aggregate", {"min_value": "300000"}, "value >= 300000"),
    ("max_value_filter", {"max_value": "100000"}, "value <= 100000"),
    ("with_reference_letter", {"has_reference_letter": True}, "has_ref"),
    ("works_by_grading", {"grading": "Very Good"}, "grading = 'very good'"),
    ("works_by_state", {"state": "Nation B"}, "state = 'nation b'"),
    ("filters_together", {"categories_in": ["high"], "role": "Prime", "years_in": [1996, 1997], "min_value": "50000"}, "category = 'high' and role = 'Prime' and year(completed) in (1996, 1997) and value >= 50000"),
]:
    _plan(_name, Plan(_W(**_f)), _BY.format("sum(value)", "work", _c))
_plan("completed_after_anchor", Plan(_W(scope="engineer", completed_after="the credential")), "select manager_key, cast(sum(value) as double) as value from work join unit using (manager_key) where completed > issued group by manager_key")
_plan("invoice_status", Plan(_I(status="o")), _BY.format("sum(invoiced)", "invoice", "lower(status) = 'o'"))
_plan("invoice_years", Plan(_I(years_in=[1997, 1998])), _BY.format("sum(invoiced)", "invoice", "year(date) in (1997, 1998)"))
_plan("invoice_dates", Plan(_I(completed_after="1997-01-01", completed_before="1999-01-01")), _BY.format("sum(invoiced)", "invoice", "date > date '1997-01-01' and date < date '1999-01-01'"))
_plan("invoice_ignored_filters", Plan(_I("count_invoices", role="Prime", min_value="1")), _BY.format("count(*)", "invoice", "true"))

# aggregates
for _agg, _e in [
    ("count", "count(*)"),
    ("distinct_categories", "count(distinct category)"),
    ("distinct_states", "count(distinct state)"),
    ("distinct_managers", "count(distinct coalesce(manager_key, -1))"),
    ("distinct_business_units", "nullif(count(distinct business_unit), 0)"),
    ("sum_value", "sum(value)"),
    ("max_value", "max(value)"),
    ("min_value", "min(value)"),
]:
    _plan(f"{_agg}_by_client", Plan(_W(_agg)), _BY.format(_e, _UW, "client_key is not null"))
_plan("distinct_clients_by_engineer", Plan(_W("distinct_clients", "engineer")), "select manager_key, cast(count(distinct client_key) as double) as value from work where manager_key is not null group by manager_key")


def _rounded(name: str, plan: Plan, sql: str) -> None:
    """Means and medians: rounded half up to cents, by whole numbers in SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(plan, *_facts(spark, sf_dir)).withColumn("value", F.round(F.col("value").cast("decimal(28,8)"), 2).cast("double"))

    _add(name, query, sql)


_rounded("mean_value", Plan(_W("mean_value")), "select client_key, cast((2 * cast(sum(value) * 100 as bigint) + count(*)) // (2 * count(*)) as double) / 100 as value from work group by client_key")
_MEDIAN = "with ranked as (select client_key, value, row_number() over (partition by client_key order by value desc, pkg) n, count(*) over (partition by client_key) c from work) select client_key, cast((2 * cast(sum(value) * 100 as bigint) + count(*)) // (2 * count(*)) as double) / 100 as value from ranked where n in ((c + 1) // 2, (c + 2) // 2) group by client_key"
_rounded("median_value", Plan(_W("median_value")), _MEDIAN)
_plan("nth_largest_value", Plan(_W("nth_largest_value", n=2)), "with r as (select client_key, value, row_number() over (partition by client_key order by value desc, pkg) n from work) select client_key, cast(value as double) as value from r where n = 2")
_TOP = "with s as (select manager_key, client_key, sum(value) v from work where manager_key is not null group by 1, 2), r as (select *, row_number() over (partition by manager_key order by v desc, client_key) n from s) "
_plan("top_n_sum_by_client", Plan(_W("top_n_sum_by_client", "engineer", 2)), _TOP + "select manager_key, cast(sum(v) as double) as value from r where n <= 2 group by manager_key")
_plan("max_client_value", Plan(_W("max_client_value", "engineer")), _TOP + "select manager_key, cast(max(v) as double) as value from r group by manager_key")
_plan("days_since_anchor", Plan(_W("days_since_anchor_date", "work")), "select pkg, cast(date_diff('day', issued, completed) as double) as value from work join unit using (manager_key) union all select pkg, null from work where manager_key is null")
for _agg, _e in [("count_invoices", "count(*)"), ("sum_invoiced", "sum(invoiced)"), ("sum_received", "sum(received)"), ("sum_outstanding", "sum(outstanding)")]:
    _plan(f"{_agg}_by_client", Plan(_I(_agg)), _BY.format(_e, "invoice", "true"))

# combiners
_S = "with a as (select client_key, sum(value) l from work group by 1), b as (select client_key, sum(invoiced) i, sum(received) r from invoice group by 1) select coalesce(a.client_key, b.client_key) client_key, cast({} as double) as value from a full join b on a.client_key = b.client_key"
_plan("receivables_balance", Plan(_I(), _I("sum_received"), "difference"), "select client_key, cast(sum(invoiced) - sum(received) as double) as value from invoice group by 1")
_plan("award_vs_invoiced", Plan(_W(), _I(), "abs_difference"), _S.format("abs(l - i)"))
_plan("sum_two_sources", Plan(_W(), _I(), "sum"), _S.format("l + i"))
_plan("collection_pct", Plan(_I("sum_received"), _I(), "percent"), "select client_key, cast(sum(received) as double) * 100 / cast(sum(invoiced) as double) as value from invoice group by 1")
_plan("referenced_share", Plan(_W("count", has_reference_letter=True), _W("count"), "percent"), "select client_key, cast(count(*) filter (where has_ref) as double) * 100 / count(*) as value from work group by 1")
_plan("absence_of_reference", Plan(_W("count", has_reference_letter=False)), "select client_key, cast(count(*) filter (where not has_ref) as double) as value from work group by 1")
_plan("largest_client_share", Plan(_W("max_client_value", "engineer"), _W("sum_value", "engineer"), "percent"), _TOP + "select manager_key, cast(max(v) as double) * 100 / cast(sum(v) as double) as value from r group by 1")
_plan("rank_gap", Plan(_W("nth_largest_value", n=1), _W("nth_largest_value", n=2), "difference"), "with r as (select client_key, value, row_number() over (partition by client_key order by value desc, pkg) n from work) select a.client_key, cast(a.value - b.value as double) as value from r a left join r b on a.client_key = b.client_key and b.n = 2 where a.n = 1")
_plan("category_pair_gap", Plan(_W(categories_in=["high"]), _W(categories_in=["low"]), "abs_difference"), "with s as (select client_key, sum(value) filter (where category = 'high') h, sum(value) filter (where category = 'low') l from work where category in ('high', 'low') group by 1) select client_key, cast(abs(h - l) as double) as value from s")
_plan("year_gap", Plan(_W(years_in=[1996]), _W(years_in=[1997]), "abs_difference"), "with s as (select client_key, sum(value) filter (where year(completed) = 1996) h, sum(value) filter (where year(completed) = 1997) l from work where year(completed) in (1996, 1997) group by 1) select client_key, cast(abs(h - l) as double) as value from s")
_plan("gap_to_threshold", Plan(Measure("constant", value="300000"), _W(), "difference"), "select client_key, cast(300000 - sum(value) as double) as value from work group by 1")
_plan("corpus_scope", Plan(_W("count", "corpus")), "select cast(count(*) as double) as value from work")
_plan("corpus_share", Plan(_W("sum_value", "client"), _W("sum_value", "corpus"), "percent"), "with s as (select client_key, sum(value) v from work group by 1) select client_key, cast(v as double) * 100 / cast((select sum(value) from work) as double) as value from s")


# joins, dedup, rollups, sets
def _query(sql: str | None, views: bool = True) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _add(f.__name__, f, sql, views)
        return f

    return put


@_query("select pkg, client_key, client_name, category, cast(value as double) as value, completed, manager_key, role, grading, has_ref from work")
def gold_works(spark, sf_dir):
    return facts.works(spark, sf_dir).select("pkg", "client_key", "client_name", "category", F.col("value").cast("double"), "completed", "manager_key", "role", "grading", "has_ref")


@_query("select category, role, grading, count(*) filter (where has_ref) as referenced, count(*) as works from work group by 1, 2, 3")
def category_role_grading(spark, sf_dir):
    return facts.works(spark, sf_dir).groupBy("category", "role", "grading").agg(F.count_if("has_ref").alias("referenced"), F.count("*").alias("works"))


@_query("with r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) n from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from r where n = 1", views=False)
def first_certificate_wins(spark, sf_dir):
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    return facts.first_per_key(facts.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@_query("select pkg from work where manager_key is null")
def works_without_lines(spark, sf_dir):
    orders = facts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pkg"))
    return facts.documents_with(orders, facts.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pkg")), ["pkg"])[1]


@_query("select client_key, cast(sum(invoiced) as double) invoiced, cast(sum(received) as double) received, cast(sum(outstanding) as double) outstanding, count(*) as n from invoice group by 1")
def receivable_rollup(spark, sf_dir):
    return facts.invoices(spark, sf_dir).groupBy("client_key").agg(*[F.sum(c).cast("double").alias(c) for c in ("invoiced", "received", "outstanding")], F.count("*").alias("n"))


@_query("select count(*) as works, cast(sum(value) as double) total, count(distinct client_key) clients, count(distinct manager_key) managers, count(*) filter (where has_ref) referenced, count(*) filter (where manager_key is null) unmanaged from work")
def integrity_report(spark, sf_dir):
    w = facts.works(spark, sf_dir)
    return w.agg(F.count("*").alias("works"), F.sum("value").cast("double").alias("total"), F.count_distinct("client_key").alias("clients"), F.count_distinct("manager_key").alias("managers"), F.count_if("has_ref").alias("referenced"), F.count_if(F.col("manager_key").isNull()).alias("unmanaged"))


@_query("with own as (select manager_key, client_key, count(*) n, sum(value) v from work where manager_key is not null group by 1, 2), t as (select client_key, count(*) a from work group by 1), r as (select o.*, a, max(n) over (partition by manager_key) m from own o join t using (client_key)), s as (select *, row_number() over (partition by manager_key order by case when m > 1 then -n else a end, case when m > 1 then -v else 0 end, client_key) k from r) select manager_key, client_key from s where k = 1")
def primary_client(spark, sf_dir):
    return resolve.primary_client(facts.works(spark, sf_dir))


@_query("select client_key from work union select client_key from invoice")
def all_clients(spark, sf_dir):
    return facts.works(spark, sf_dir).select("client_key").unionByName(facts.invoices(spark, sf_dir).select("client_key")).distinct()


@_query("select client_key from work where category in ('urgent', 'high') group by 1 having count(distinct category) = 2")
def clients_with_all_categories(spark, sf_dir):
    have = facts.works(spark, sf_dir).groupBy("client_key").agg(F.collect_set("category").alias("have"))
    return have.where(F.size(F.array_except(F.array(F.lit("urgent"), F.lit("high")), "have")) == 0).select("client_key")


@_query("with r as (select manager_key, pkg, completed, row_number() over (partition by manager_key order by completed, pkg) n from work where manager_key is not null) select manager_key, pkg, completed from r where n = 1")
def earliest_work(spark, sf_dir):
    w = facts.works(spark, sf_dir).where("manager_key is not null")
    return w.groupBy("manager_key").agg(F.min(F.struct("completed", "pkg")).alias("x")).select("manager_key", "x.pkg", "x.completed")


@_query("with s as (select client_key, count(*) n, sum(value) v from work group by 1) select cast(median(n) as double) works_per_client, cast(median(cast(v as double)) as double) client_total from s")
def fallbacks(spark, sf_dir):
    s = facts.works(spark, sf_dir).groupBy("client_key").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("v"))
    return s.agg(F.median("n").cast("double").alias("works_per_client"), F.median("v").alias("client_total"))


# documents and scalars
_LOW = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_HEAD = r"lower(trim(regexp_replace(substr(text, 1, 1200), '\s+', ' ', 'g')))"


def _cue_sql() -> str:
    kinds: dict[str, list[str]] = {}
    for kind, weight, pattern in documents.CUES:
        kinds.setdefault(kind, []).append(f"case when regexp_matches({_HEAD if weight > 2 else _LOW}, '{pattern}') then {weight} else 0 end")
    raw = ", ".join(f"{' + '.join(v)} as {k}" for k, v in kinds.items())
    loser = {v: k for k, v in documents.DOMINATES.items()}
    rows = " union all ".join(f"select doc_id, '{k}' k, " + (f"case when {loser[k]} > 0 then 0 else {k} end" if k in loser else k) + " s from raw" for k in kinds)
    return f"with raw as (select doc_id, {raw} from documents), v as ({rows}), r as (select *, row_number() over (partition by doc_id order by s desc, k) n from v where s > 0) select d.doc_id, coalesce(a.k, 'unknown') doc_type, cast(coalesce(a.s, 0) as int) score, b.k runner_up from documents d left join r a on d.doc_id = a.doc_id and a.n = 1 left join r b on d.doc_id = b.doc_id and b.n = 2"


_add("classify_documents", lambda spark, sf_dir: documents.classify(facts.table(spark, sf_dir, "documents").select("doc_id", "text")), _cue_sql(), views=False)


@_query("select pkg, client_name, client_key as client_id, category, cast(value as double) as value, completed, grading from work")
def parsed_certificates(spark, sf_dir):
    texts = documents.render_certificates(facts.works(spark, sf_dir))
    return documents.parse_certificates(texts).withColumn("value", F.col("value").cast("double"))


@_query("select source as head, count(*) as n from documents group by 1 having count(*) >= greatest(3, 0.05 * (select count(*) from documents)) order by n desc, min(doc_id) limit 1", views=False)
def dominant_issuer(spark, sf_dir):
    return documents.dominant_issuer(facts.table(spark, sf_dir, "documents"), F.col("source"))


@_query("select s_suppkey as k, s_suppkey % 1000 as value from supplier", views=False)
def number_words(spark, sf_dir):
    word = F.create_map(*[F.lit(x) for w, v in X.NUMBER_WORDS.items() for x in (v, w)])
    n = (F.col("s_suppkey") % 1000).cast("int")
    r = n % 100
    low = F.when(r < 20, F.element_at(word, r)).otherwise(F.concat_ws("-", F.element_at(word, (r - r % 10).cast("int")), F.when(r % 10 > 0, F.element_at(word, (r % 10).cast("int")))))
    text = F.concat_ws(" and ", F.when(n >= 100, F.concat(F.element_at(word, F.floor(n / 100).cast("int")), F.lit(" hundred"))), F.when((r > 0) | (n == 0), low))
    return facts.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), X.words_to_number(text).cast("bigint").alias("value"))


@_query("select c_custkey as k, 'government department ' || c_custkey || ' and roads limited' as value from customer", views=False)
def client_names(spark, sf_dir):
    return facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), X.norm_client(F.concat(F.lit("Govt. Dept. "), "c_custkey", F.lit(" & Roads Ltd."))).alias("value"))


@_query("select pkg as k, completed as value from work")
def date_roundtrip(spark, sf_dir):
    w = facts.works(spark, sf_dir)
    text = F.element_at(F.array(*[F.date_format("completed", f) for f in X.DATE_FORMATS]), (F.pmod("pkg", F.lit(6)) + 1).cast("int"))
    return w.select(F.col("pkg").alias("k"), X.parse_date(F.concat(F.lit("dated "), text, F.lit(" at site"))).alias("value"))


def _asked(rows: DataFrame, key: str, *parts) -> DataFrame:
    """Questions about every row: qid and question."""
    return rows.select(F.col(key).cast("string").alias("qid"), F.concat(*parts).alias("question"))


def _clients(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Works and the signatures of all their clients."""
    w = facts.works(spark, sf_dir)
    clients = facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_key"), F.col("c_name").alias("client_name"))
    names = w.select(F.concat("category", F.lit(" works")).alias("work_name")).distinct()
    return w, resolve.client_signatures(clients, names)


@_query("select cast(o_orderkey as varchar) as qid, o_custkey as client_key from orders where o_orderkey % 7 = 0", views=False)
def resolve_clients(spark, sf_dir):
    w, table = _clients(spark, sf_dir)
    asked = _asked(w.where("pkg % 7 = 0"), "pkg", F.lit("What is the total value of works done for "), "client_name", F.lit("?"))
    return resolve.resolve_clients(asked, table).select("qid", "client_key")


@_query("select cast(o_orderkey as varchar) as qid, o_custkey as client_key from orders", views=False)
def resolve_every_client(spark, sf_dir):
    w, table = _clients(spark, sf_dir)
    return resolve.resolve_clients(_asked(w, "pkg", F.lit("What is the total value of works done for "), "client_name", F.lit("?")), table).select("qid", "client_key")


@_query("select cast(o_orderkey as varchar) as qid, o_orderkey as pkg from orders", views=False)
def resolve_every_work(spark, sf_dir):
    w = facts.works(spark, sf_dir).withColumn("work_name", F.concat("category", F.lit(" works Pkg-"), "pkg"))
    asked = resolve.asked(_asked(w, "pkg", F.lit("When was package "), F.col("pkg").cast("string"), F.lit(" handed over?")))
    return resolve.resolve_works(asked, w).select("qid", "pkg")


@_query("select cast(o_orderkey as varchar) as qid, min(o_orderkey) over (partition by o_orderpriority, c_nationkey) as pkg from orders join customer on o_custkey = c_custkey", views=False)
def resolve_works_by_name(spark, sf_dir):
    """Works by their name alone: of those of one name the first is meant."""
    w = facts.works(spark, sf_dir).withColumn("work_name", F.concat("category", F.lit(" depot "), F.translate(F.lower("state"), " ", "")))
    asked = resolve.asked(_asked(w, "pkg", F.lit("How much was the "), "work_name", F.lit(" worth?")))
    return resolve.resolve_works(asked, w).select("qid", "pkg")


@_query("select cast(s_suppkey as varchar) as qid, s_suppkey as manager_key from supplier", views=False)
def resolve_every_manager(spark, sf_dir):
    people = facts.managers(spark, sf_dir)
    asked = resolve.asked(_asked(people, "manager_key", F.lit("What did "), "name", F.lit(" lead?")))
    return resolve.resolve_managers(asked, people).select("qid", "manager_key")


@_query("select cast(s_suppkey as varchar) as qid, first_value(manager_key) over (partition by s_suppkey % 12 order by n desc, v desc, manager_key) as manager_key from supplier join (select s_suppkey manager_key, count(pkg) n, sum(value) v from supplier left join work on manager_key = s_suppkey group by 1) t on t.manager_key % 12 = s_suppkey % 12 qualify row_number() over (partition by s_suppkey order by n desc, v desc, manager_key) = 1")
def resolve_first_names(spark, sf_dir):
    """A first name alone means the manager of that name with the largest portfolio."""
    people = facts.managers(spark, sf_dir)
    asked = resolve.asked(_asked(people, "manager_key", F.lit("Which works are "), F.element_at(F.split("name", " "), 1), F.lit("'s?")))
    return resolve.resolve_managers(asked, people).select("qid", "manager_key")


@_query("select cast(pkg as varchar) as qid, category || '|' || case when category = 'urgent' then 'medium' else 'urgent' end as categories from work")
def resolve_categories(spark, sf_dir):
    w = facts.works(spark, sf_dir)
    other = F.when(F.col("category") == "urgent", "medium").otherwise("urgent")
    asked = resolve.asked(_asked(w, "pkg", F.lit("How do "), "category", F.lit(" works compare with "), other, F.lit(" ones?")))
    return resolve.named_categories(asked, w.select("category").distinct()).select("qid", F.array_join("categories", "|").alias("categories"))


@_query("select cast(manager_key as varchar) as qid, issued from unit")
def resolve_credentials(spark, sf_dir):
    """Dates of certificates, by the quoted id for every second manager, by the manager's kind for the others."""
    known = facts.credentials(spark, sf_dir)
    asked = known.select(F.col("manager_key").cast("string").alias("qid"), F.when(F.col("manager_key") % 2 == 0, F.concat(F.lit("What came after "), "credential_id", F.lit("?"))).otherwise(F.concat(F.lit("What came after the "), "credential", F.lit("?"))).alias("question"), "manager_key")
    return resolve.resolve_credentials(asked, known).select("qid", "issued")


@_query("with own as (select manager_key, client_key, count(*) n, sum(value) v from work where manager_key is not null group by 1, 2), t as (select client_key, count(*) a from work group by 1), r as (select o.*, a, max(n) over (partition by manager_key) m from own o join t using (client_key)), s as (select *, row_number() over (partition by manager_key order by case when m > 1 then -n else a end, case when m > 1 then -v else 0 end, client_key) k from r) select cast(u.manager_key as varchar) as qid, client_key, u.manager_key, issued as anchor_date from unit u left join s on u.manager_key = s.manager_key and k = 1")
def resolve_anchors(spark, sf_dir):
    """All that a question points at: the engineer, their certificate's date, their principal account."""
    w, table = _clients(spark, sf_dir)
    w = w.withColumn("work_name", F.concat("category", F.lit(" works")))
    people = facts.managers(spark, sf_dir)
    asked = _asked(people, "manager_key", F.lit("What was completed after "), "name", F.lit(" was certified?"))
    return resolve.anchors(asked, w, people, table, facts.credentials(spark, sf_dir)).select("qid", "client_key", "manager_key", "anchor_date")


@_query("select cast(c_custkey as varchar) as qid, case when c_custkey % 3 = 0 and c_custkey % 2 = 1 then 'm' else 'r' end as answer, case when c_custkey % 3 = 0 and c_custkey % 2 = 1 then 'model' else 'rules' end as source from customer", views=False)
def vote_consensus(spark, sf_dir):
    c = facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    model = lambda p: F.struct(F.lit("model").alias("source"), F.lit(p).alias("place"), F.when(F.col("k") % 3 == 0, "m").when(F.col("k") % 3 == 1, F.lit(f"m{p}")).alias("answer"), F.lit(False).alias("confident"))
    rule = F.struct(F.lit("rules").alias("source"), F.lit(0).alias("place"), F.lit("r").alias("answer"), (F.col("k") % 2 == 0).alias("confident"))
    return reconcile.reconcile(c.select(F.col("k").cast("string").alias("qid"), F.explode(F.array(rule, model(1), model(2))).alias("x")).select("qid", "x.*"))


#: A question for each shape; its plan answers it for every entity at once.
QUESTIONS = [
    ("largest_client_share", "percent", "What share of the engineer's value comes from the largest client?"), ("collection_pct", "percent", "What percentage was collected?"), ("referenced_share", "percent", "What share of works has a reference?"),
    ("absence", "count", "How many works are without a reference letter?"), ("business_units", "count", "How many business units took part?"), ("distinct_category", "count", "How many categories did the engineer handle?"), ("distinct_clients", "count", "How many clients did the engineer serve?"), ("work_count", "count", "How many works were done?"),
    ("mean_minus_median", "money", "By how much does the mean exceed the median?"), ("category_pair_diff", "money", "What is the gap between high and low works?"), ("gap_to_threshold", "money", "How far short of 3 lakh is the client?"), ("receivables_balance", "money", "What is the outstanding balance?"), ("grading_filter", "money", "What is the value of works graded excellent?"),
    ("year_delta", "money", "How did value change from 1996 to 1997?"), ("awarded_vs_invoiced", "money", "How far apart are awarded and invoiced sums?"), ("top_n_clients", "money", "What do the top two clients add up to?"), ("rank_value", "money", "How much larger is the largest work than the second?"), ("exclusion_aggregate", "money", "What is the value excluding urgent works?"),
    ("threshold_aggregate", "money", "What is the value of works of at least 3 lakh?"), ("role_split", "money", "What is the value of works as prime contractor?"), ("avg_work_size", "money", "What is the average work?"), ("temporal_chain", "money", "What was completed after the credential?"), ("hop_aggregate", "money", "What is the total value?"), ("date_span", "days", "How many days passed?"),
]


_read: list = []


def _shapes() -> None:
    same = {"largest_client_share": "largest_client_share", "collection_pct": "collection_pct", "referenced_share": "referenced_share", "absence": "absence_of_reference", "business_units": "distinct_business_units_by_client", "distinct_clients": "distinct_clients_by_engineer", "work_count": "count_by_client", "category_pair_diff": "category_pair_gap", "gap_to_threshold": "gap_to_threshold", "receivables_balance": "receivables_balance", "year_delta": "year_gap", "awarded_vs_invoiced": "award_vs_invoiced", "top_n_clients": "top_n_sum_by_client", "rank_value": "rank_gap", "exclusion_aggregate": "works_excluding_category", "threshold_aggregate": "threshold_aggregate", "role_split": "works_by_role", "temporal_chain": "completed_after_anchor", "hop_aggregate": "sum_value_by_client", "date_span": "days_since_anchor"}
    gap = (
        "with ranked as (select client_key, value, row_number() over (partition by client_key order by value desc, pkg) n, count(*) over (partition by client_key) c from work), "
        "s as (select client_key, count(*) n, cast(sum(value) * 100 as bigint) s from work group by 1), "
        "m as (select client_key, count(*) k, cast(sum(value) * 100 as bigint) m from ranked where n in ((c + 1) // 2, (c + 2) // 2) group by 1), "
        "d as (select client_key, s * k - m * n num, n * k den from s join m using (client_key)) "
        "select client_key, cast(sign(num) * ((2 * abs(num) + den) // (2 * den)) as double) / 100 as value from d"
    )
    own = {"mean_minus_median": ", " + gap[5:], "grading_filter": _BY.format("sum(value)", "work", "grading = 'excellent'"), "distinct_category": "select manager_key, cast(count(distinct category) as double) as value from work where manager_key is not null group by 1"}
    for shape, kind, question in QUESTIONS:

        def query(spark, sf_dir, shape=shape, kind=kind, question=question):
            if not _read:  # all of them at once, on first use
                labels = ["urgent", "high", "medium", "not specified", "low"]
                _read.extend(rules.classify_all([(text, answer_type) for _, answer_type, text in QUESTIONS], labels))
            found, plan, _ = _read[QUESTIONS.index((shape, kind, question))]
            assert found == shape, (found, shape)
            value = run(plan, *_facts(spark, sf_dir))
            decimals = shape in ("avg_work_size", "mean_minus_median")
            return value.withColumn("value", F.round(F.col("value").cast("decimal(28,8)"), 2).cast("double") if decimals else F.col("value").cast("double"))

        _queries[f"shape_{shape}"] = query
        if shape in own:
            _sql[f"shape_{shape}"] = facts.VIEWS + own[shape]  # whole numbers of cents where the value is rounded
        elif shape in same:
            _sql[f"shape_{shape}"] = _sql[same[shape]]
        elif shape == "avg_work_size":
            _sql[f"shape_{shape}"] = _sql["mean_value"]


_shapes()


def queries() -> dict[str, Query]:
    from . import catalog_documents, catalog_estate, catalog_questions  # noqa: F401  they register their queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import catalog_documents, catalog_estate, catalog_questions  # noqa: F401

    return dict(_sql)
