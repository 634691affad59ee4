"""Queries about questions: shapes of many wordings, labels of any length, answers over the whole corpus, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _W, _clients, _facts, _plan, _query
from .functions import scalars as X
from .operators import facts, resolve
from .plans import answers, rules
from .plans.algebra import Plan


def _quoted(values: list) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" for v in values) + "]"


def _spelled(n: Column) -> Column:
    """Number words of 1 to 99."""
    word = F.create_map(*[F.lit(x) for w, v in X.NUMBER_WORDS.items() for x in (v, w)])
    tens = F.concat_ws("-", F.element_at(word, (n - n % 10).cast("int")), F.when(n % 10 > 0, F.element_at(word, (n % 10).cast("int"))))
    return F.when(n < 20, F.element_at(word, n.cast("int"))).otherwise(tens)


#: (answer type, shape, sure, wording): N is an amount in words, Y and Z are years, A and B two labels. The last ones differ from earlier ones in a word that
#: another rule goes by, or have no word that any rule goes by.
WORDINGS = [
    ("percent", "largest_client_share", True, "What portion of the portfolio comes from the single client that matters most?"),
    ("percent", "largest_client_share", True, "How much of her value rests on the biggest account, in percent?"),
    ("percent", "largest_client_share", True, "Give the share of the dominant customer."),
    ("percent", "collection_pct", True, "What percentage of what we billed has been realised?"),
    ("percent", "collection_pct", True, "The verified collection percentage once actual receipts are counted?"),
    ("percent", "collection_pct", True, "How much has been paid, as a share of invoices?"),
    ("percent", "referenced_share", True, "What share of works carries an endorsement from the client, with bills settled or not?"),
    ("percent", "referenced_share", True, "For what share do we have a testimonial on file?"),
    ("percent", "referenced_share", True, "What fraction of jobs did the client vouch for?"),
    ("percent", "collection_pct", False, "What is the percentage here?"),
    ("count", "business_units", True, "How many internal teams delivered these?"),
    ("count", "business_units", True, "Across how many divisions were the works spread?"),
    ("count", "business_units", True, "Count the business units involved."),
    ("count", "absence", True, "How many works lack a letter?"),
    ("count", "absence", True, "How many assignments have yet to receive a letter?"),
    ("count", "absence", True, "For how many works do we not, or don't, have anything?"),
    ("count", "distinct_category", True, "How many kinds of work did he lead?"),
    ("count", "distinct_category", True, "Number of different types under her name?"),
    ("count", "distinct_category", True, "In how many disciplines was she active?"),
    ("count", "distinct_clients", True, "How many departments did he serve?"),
    ("count", "distinct_clients", True, "How many separate customers did she have?"),
    ("count", "distinct_clients", True, "How many different authorities were served?"),
    ("count", "work_count", False, "How many jobs were finished?"),
    ("count", "work_count", False, "Number of completed contracts?"),
    ("count", "work_count", False, "Count the assignments."),
    ("money", "mean_minus_median", True, "How far does the average sit above the median?"),
    ("money", "mean_minus_median", True, "Mean less median value?"),
    ("money", "mean_minus_median", True, "What separates the median from the typical figure?"),
    ("money", "category_pair_diff", True, "What is the gap between A and B?"),
    ("money", "category_pair_diff", True, "A versus B in value?"),
    ("money", "category_pair_diff", True, "How much more did B bring than A?"),
    ("money", "gap_to_threshold", True, "How much more value do we need to reach N crore?"),
    ("money", "gap_to_threshold", True, "The outstanding contract value we still need to clear the N cr bar?"),
    ("money", "gap_to_threshold", True, "By how much do works fall short of a N crore target?"),
    ("money", "receivables_balance", True, "How much do they owe us?"),
    ("money", "receivables_balance", True, "What amount has not been settled, is overdue or pending?"),
    ("money", "receivables_balance", True, "Which sum is still due?"),
    ("money", "grading_filter", True, "Total of works rated very good?"),
    ("money", "grading_filter", True, "What is the value of jobs with an assessment of satisfactory?"),
    ("money", "grading_filter", True, "Sum over contracts with the remark excellent?"),
    ("money", "year_delta", True, "How did the total move between Y and Z?"),
    ("money", "year_delta", True, "Z compared to Y: what is the change?"),
    ("money", "year_delta", True, "Growth from Y to Z?"),
    ("money", "awarded_vs_invoiced", True, "How far is the contract value from what was billed?"),
    ("money", "awarded_vs_invoiced", True, "Outstanding claims against the awarded total?"),
    ("money", "awarded_vs_invoiced", True, "What was invoiced relative to the full value of our projects?"),
    ("money", "top_n_clients", True, "What do the two biggest clients add up to?"),
    ("money", "top_n_clients", True, "Combined value of the top 3?"),
    ("money", "top_n_clients", True, "What do his largest two bring?"),
    ("money", "rank_value", True, "By how much does the highest work exceed the runner-up?"),
    ("money", "rank_value", True, "The distance of the second work behind the greatest?"),
    ("money", "rank_value", True, "The biggest job and the next one: how far apart?"),
    ("money", "exclusion_aggregate", True, "What is the total leaving A aside?"),
    ("money", "exclusion_aggregate", True, "Value apart from A?"),
    ("money", "exclusion_aggregate", True, "Strip the subcontracted work: what remains as value?"),
    ("money", "threshold_aggregate", True, "Value of contracts hitting the N crore mark?"),
    ("money", "threshold_aggregate", True, "Sum of jobs worth more than N lakh?"),
    ("money", "threshold_aggregate", True, "What do works exceeding N crore add up to?"),
    ("money", "role_split", True, "How much was done in a joint venture?"),
    ("money", "role_split", True, "Works where we were lead partner?"),
    ("money", "role_split", True, "Total for jobs done as JV?"),
    ("money", "avg_work_size", True, "What is the typical size?"),
    ("money", "avg_work_size", True, "Value per contract?"),
    ("money", "avg_work_size", True, "What did a job come to on average?"),
    ("money", "temporal_chain", True, "What was finished later than the certificate?"),
    ("money", "temporal_chain", True, "The total since then?"),
    ("money", "temporal_chain", True, "Value from that date onward?"),
    ("money", "hop_aggregate", False, "What is it all worth?"),
    ("money", "hop_aggregate", False, "Total over the entire company?"),
    ("money", "hop_aggregate", False, "Sum for every client?"),
    ("days", "date_span", False, "How long did it take?"),
    ("days", "date_span", False, "Days between the two?"),
    ("days", "date_span", False, "How many days lie between the credential and the handover?"),
    ("grams", None, False, "What does it weigh?"),
]
_UNIT = {"crore": 10_000_000, "cr": 10_000_000, "lakh": 100_000}
_AMOUNTS = [next((by for unit, by in _UNIT.items() if f"N {unit}" in w[3]), None) for w in WORDINGS]
_WIDE = [w[1] == "hop_aggregate" and ("every client" in w[3] or "entire company" in w[3]) for w in WORDINGS]
_LABELS = ["high", "low", "medium", "not specified", "urgent"]


def _worded(spark, sf_dir) -> DataFrame:
    """A question for each order: the wordings in turn, with amounts, years and labels of the order."""
    w = facts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pkg"))
    at = F.pmod("pkg", F.lit(len(WORDINGS))).cast("int")
    text = F.get(F.array(*[F.lit(x[3]) for x in WORDINGS]), at)
    label = lambda step: F.get(F.array(*map(F.lit, _LABELS)), F.pmod(F.col("pkg") + step, F.lit(len(_LABELS))).cast("int"))
    year = lambda step: (F.lit(1992) + F.pmod("pkg", F.lit(5)) + step).cast("string")
    for letter, value in (("N", _spelled(F.pmod("pkg", F.lit(97)) + 1)), ("Y", year(0)), ("Z", year(1)), ("A", label(0)), ("B", label(1))):
        text = F.regexp_replace(text, rf"\b{letter}\b", value)
    kind = F.get(F.array(*[F.lit(x[0]) for x in WORDINGS]), at)
    return w.select(F.col("pkg").cast("string").alias("qid"), text.alias("question"), kind.alias("answer_type"))


_I = f"cast(o_orderkey % {len(WORDINGS)} as int) + 1"


@_query(
    f"""select cast(o_orderkey as varchar) as qid, {_quoted([w[1] for w in WORDINGS])}[{_I}] as shape, {[w[2] for w in WORDINGS]}[{_I}] as matched,
    case when {[a is not None for a in _AMOUNTS]}[{_I}] then cast((o_orderkey % 97 + 1) * {[a or 0 for a in _AMOUNTS]}[{_I}] as double) end as amount,
    case when {_quoted([w[3] for w in WORDINGS]).replace("don't", "don''t")}[{_I}] like '%Y%Z%' or {_quoted([w[3] for w in WORDINGS]).replace("don't", "don''t")}[{_I}] like '%Z%Y%'
      then (1992 + o_orderkey % 5) || ',' || (1993 + o_orderkey % 5) else '' end as years,
    {_WIDE}[{_I}] as corpus
    from orders""",
    views=False,
)
def question_shapes(spark, sf_dir):
    """The rules' reading of three wordings or more of each shape, with the amount and the years that they name."""
    q = resolve.asked(_worded(spark, sf_dir))
    labels = spark.createDataFrame([(x,) for x in _LABELS], "category string")
    spans = resolve.named_categories(q.select("qid", "nq"), labels)
    out = rules.shaped(q.drop("nq").join(spans, "qid", "left"))
    return out.select("qid", "shape", "matched", F.col("amount").cast("double").alias("amount"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "corpus")


#: Words of the labels that the next query makes: the label of length n is the last n of these, so every shorter one ends every longer one.
_LONG = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima".split()


@_query(
    f"""with n as (select c_custkey, cast(c_custkey % 12 + 1 as int) as n, cast(c_custkey % 5 + 1 as int) as m from customer)
    select cast(c_custkey as varchar) as qid,
      array_to_string({_LONG}[13 - n:12], ' ') || '|' || array_to_string({_LONG}[13 - m:12], ' ') as categories,
      array_to_string({_LONG}[13 - greatest(n, m):12], ' ') as category
    from n""",
    views=False,
)
def labels_of_any_length(spark, sf_dir):
    """Labels of 1 to 12 words, each the end of all longer ones: the longest that a question holds counts at each place, also with "and" between words."""
    c = facts.table(spark, sf_dir, "customer").select("c_custkey")

    def ends(n: Column) -> Column:
        words = F.slice(F.array(*map(F.lit, _LONG)), 13 - n, n)
        return F.when(F.col("c_custkey") % 2 == 0, F.array_join(words, " and ")).otherwise(F.array_join(words, " "))

    n, m = ((F.col("c_custkey") % k + 1).cast("int") for k in (12, 5))
    text = F.concat(F.lit("What did we earn with "), ends(n), F.lit(", and then with "), ends(m), F.lit("?"))
    labels = spark.createDataFrame([(" ".join(_LONG[k:]),) for k in range(12)], "category string")
    q = resolve.asked(c.select(F.col("c_custkey").cast("string").alias("qid"), text.alias("question")))
    return resolve.named_categories(q, labels).select("qid", F.array_join("categories", "|").alias("categories"), "category")


# the whole corpus
_CENTS = "(2 * cast(sum(value) * 100 as bigint) + count(*)) // (2 * count(*))"
_plan("corpus_nth", Plan(_W("nth_largest_value", "corpus", n=100)), "select cast(value as double) as value from work order by value desc limit 1 offset 99")


@_query(f"with r as (select value, row_number() over (order by value desc) n, count(*) over () c from work where role = 'Prime') select cast({_CENTS} as double) / 100 as value from r where n in ((c + 1) // 2, (c + 2) // 2)")
def corpus_median(spark, sf_dir):
    from .plans.algebra import run

    out = run(Plan(_W("median_value", "corpus", role="prime")), *_facts(spark, sf_dir))
    return out.withColumn("value", F.round(F.col("value").cast("decimal(28,8)"), 2).cast("double"))


#: Measures of the whole corpus, one for each customer: an aggregate, a category, a year or a least value, in turn.
_AGGS = ["sum_value", "count", "max_value", "median_value", "nth_largest_value"]


@_query(
    """with m as (select c_custkey k, c_custkey % 5 a, c_custkey % 3 f, ['high', 'low', 'medium', 'not specified', 'urgent'][cast(c_custkey % 5 as int) + 1] category,
      1992 + c_custkey % 7 as y, c_custkey % 40 * 10000 as least from customer),
    hit as (select k, a, value, row_number() over (partition by k order by value desc) n, count(*) over (partition by k) c from m join work w
      on (f = 0 and w.category = m.category) or (f = 1 and year(completed) = y) or (f = 2 and value >= least)),
    v as (select k, any_value(a) a, sum(value) s, count(*) c, max(value) hi, max(value) filter (where n = 7) nth,
      (cast(sum(value) filter (where n in ((c + 1) // 2, (c + 2) // 2)) as double) * 100) mid, 2 - max(c) % 2 parts from hit group by k)
    select cast(m.k as varchar) as cid, case m.a when 0 then cast(v.s as double) when 1 then coalesce(v.c, 0) when 2 then cast(v.hi as double)
      when 3 then round(mid) / parts / 100 else cast(nth as double) end as value from m left join v on m.k = v.k"""
)
def corpus_measures(spark, sf_dir):
    """Measures over the whole corpus, by the thousand: computed once each where they are equal, in one pass over rows that meet them by category or year."""
    c = facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    names = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod("k", F.lit(n)).cast("int"))
    f = F.col("k") % 3
    filters = F.struct(
        F.when(f == 0, F.array(names(["high", "low", "medium", "not specified", "urgent"], 5))).alias("categories_in"),
        F.when(f == 1, F.array((F.lit(1992) + F.col("k") % 7).cast("int"))).alias("years_in"),
        F.when(f == 2, (F.col("k") % 40 * 10000).cast("string")).alias("min_value"),
    )
    left = F.struct(F.lit("works").alias("source"), F.lit("corpus").alias("scope"), names(_AGGS, 5).alias("agg"), F.lit(7).alias("n"), filters.alias("filters"))
    rows = c.select(F.col("k").cast("string").alias("cid"), F.col("k").cast("string").alias("qid"), F.lit("model").alias("source"), F.lit(0).alias("place"), F.to_json(F.struct(left.alias("left"))).alias("plan"))
    none = rows.select("qid", *[F.lit(None).cast(kind).alias(c) for c, kind in (("client_key", "long"), ("manager_key", "long"), ("pkg", "long"), ("anchor_date", "date"))])
    works, invoices = _facts(spark, sf_dir)
    return answers.executed(rows, none, works.drop("anchor_date"), invoices).select("cid", F.col("value").cast("double").alias("value"))


@_query(
    """with money as (select median(cast(v as double)) m from (select sum(value) v from work group by client_key)), own as (select c_custkey k, sum(value) s, count(value) n from customer left join work on client_key = c_custkey group by 1)
    select cast(k as varchar) as qid, cast(case when n > 0 then round(s) else round((select m from money)) end as double) as answer, case when n > 0 then 'rules' else 'fallback' end as source from own"""
)
def answered_or_fallback(spark, sf_dir):
    """A question about every customer; those without works take the fallback of their answer type."""
    w, table = _clients(spark, sf_dir)
    w = w.withColumn("work_name", F.concat("category", F.lit(" works"))).join(facts.units(spark, sf_dir).drop("issued"), "manager_key", "left")
    asked = facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("qid"), F.concat(F.lit("What is the total value of works for "), "c_name", F.lit("?")).alias("question"), F.lit("money").alias("answer_type"))
    out = answers.answer(asked, w, facts.invoices(spark, sf_dir), facts.managers(spark, sf_dir), table, facts.credentials(spark, sf_dir))
    return out.select("qid", F.col("answer").cast("double").alias("answer"), "source")


# a model's plans, and scores
#: (a model's words for a category, the label meant or null): equal, spelled otherwise, holding, held, half covered, nothing.
_SNAPS = [("urgent", "urgent"), ("URGENT!", "urgent"), ("urgent road works", "urgent"), ("specif", "not specified"), ("items as specified later", "not specified"), ("zebra", None), ("medium-size", "medium"), ("  ", None)]
_ROLE_WORDS = [("prime", "Prime"), ("as lead firm", "Prime"), ("joint-venture member", "JV Partner"), ("subcontract", "Sub-contractor"), ("observer", None), ("", None), ("JV Partner", "JV Partner")]


@_query(
    f"""with c as (select c_custkey k, {_quoted([b for _, b in _SNAPS])}[cast(c_custkey % {len(_SNAPS)} as int) + 1] one, {_quoted([b for _, b in _SNAPS])}[cast((c_custkey + 3) % {len(_SNAPS)} as int) + 1] two,
      {_quoted([b for _, b in _ROLE_WORDS])}[cast(c_custkey % {len(_ROLE_WORDS)} as int) + 1] as r from customer)
    select cast(k as varchar) as qid, k % 11 = 0 as none, case when k % 11 = 0 then '' else array_to_string(list_sort(list_distinct(list_filter([one, two], lambda x: x is not null))), ',') end as categories,
      case when k % 11 != 0 then r end as role, case when k % 11 != 0 and k % 4 > 0 then cast(k % 4 as varchar) end as min_value,
      case when k % 11 != 0 and k % 3 = 0 then true when k % 11 != 0 and k % 3 = 1 then false end as letter from c""",
    views=False,
)
def snapped_plans(spark, sf_dir):
    """A model's plan for each customer: its words for categories and roles onto those of the store, or no filter; every eleventh has no left side."""
    from .plans import wire

    k = F.col("k")
    pick = lambda values, step=0: F.get(F.array(*map(F.lit, values)), F.pmod(k + step, F.lit(len(values))).cast("int"))
    words, roles = [a for a, _ in _SNAPS], [a for a, _ in _ROLE_WORDS]
    left = F.struct(
        F.when(k % 11 == 0, "none").otherwise("works").alias("source"), F.lit("sum_value").alias("agg"), F.array(pick(words), pick(words, 3)).alias("categories_in"), pick(roles).alias("role"),
        (k % 4).cast("string").alias("min_value"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "No").otherwise("any").alias("has_reference_letter"),
    )
    c = facts.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    wires = c.select(k.cast("string").alias("qid"), F.lit(0).alias("place"), F.to_json(F.struct(left.alias("left"), k.cast("string").alias("reading"))).alias("wire"))
    out = answers.analyzed(wire.plans(wires, facts.works(spark, sf_dir).select("category").distinct()))
    plan = lambda path: F.get_json_object("plan", f"$.left.filters.{path}")
    categories = F.array_join(F.coalesce(F.from_json(plan("categories_in"), "array<string>"), F.array().cast("array<string>")), ",")
    return out.select("qid", F.col("plan").isNull().alias("none"), categories.alias("categories"), plan("role").alias("role"), plan("min_value").alias("min_value"), plan("has_reference_letter").cast("boolean").alias("letter"))


@_query(
    """with k as (select pkg, value, case pkg % 4 when 0 then 'money' when 1 then 'count' when 2 then 'percent' else 'days' end as answer_type, case pkg % 3 when 0 then 'T1' when 1 then 'T2' end as tier,
      pkg % 7 != 0 as answered, case when pkg % 7 = 0 then false when pkg % 4 = 0 then pkg % 5 != 1 when pkg % 4 = 2 then pkg % 5 != 2 else pkg % 5 != 3 end as ok,
      case when pkg % 6 = 0 then '?' else 'shape_' || pkg % 3 end as shape, case when pkg % 6 = 0 then '?' else 'rules' end as source from work)
    select case when grouping(answer_type) = 0 then 'answer_type' when grouping(tier) = 0 then 'tier' when grouping(shape) = 0 then 'shape' when grouping(source) = 0 then 'source' else 'all' end as "by",
      coalesce(answer_type, tier, shape, source, case when grouping(tier) = 0 then '?' else '' end) as value, count(*) as questions, count(*) filter (where answered) as answered, count(*) filter (where ok) as "right"
    from k group by grouping sets ((), (answer_type), (tier), (shape), (source))"""
)
def scored_answers(spark, sf_dir):
    """Answers of every work's question: some missing, some within the tolerance of their type, some not."""
    from .plans import scoring

    w, k = facts.works(spark, sf_dir).select("pkg", F.col("value").cast("double").alias("value")), F.col("pkg")
    kind = F.get(F.array(*map(F.lit, ("money", "count", "percent", "days"))), (k % 4).cast("int"))
    want = F.when(k % 4 == 2, (k % 90).cast("double")).when(k % 4 == 0, F.col("value")).otherwise((k % 500).cast("double"))
    w = w.select("pkg", k.cast("string").alias("qid"), kind.alias("answer_type"), F.when(k % 3 == 0, "T1").when(k % 3 == 1, "T2").alias("tier"), want.alias("want"))
    money = F.col("want") * F.when(k % 5 == 1, 1.01).when(k % 5 == 2, 1.004).otherwise(1.0)
    percent = F.col("want") + F.when(k % 5 == 2, 0.06).when(k % 5 == 1, 0.04).otherwise(0.0)
    got = F.when(k % 4 == 0, money).when(k % 4 == 2, percent).otherwise(F.col("want") + F.when(k % 5 == 3, 1).otherwise(0))
    given = w.where("pkg % 7 != 0").select("qid", got.cast("string").alias("answer"))
    log = w.where("pkg % 6 != 0").select("qid", F.concat(F.lit("shape_"), k % 3).alias("shape"), F.lit("rules").alias("source"))
    return scoring.scores(scoring.judged(w.select("qid", "answer_type", "tier", F.col("want").cast("string").alias("answer")), given, log))
