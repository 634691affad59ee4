"""What larger inputs need: work is dealt over all cores, done once, and no long expression is read again by a filter."""

import re

import pytest
from pyspark.sql import functions as F

from factloom import catalog
from factloom.catalog_documents import _works
from factloom.functions import scalars as X
from factloom.operators import documents, kinds, records, render, resolve
from factloom.plans import answers
from factloom.sources import scratch

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_works_are_dealt(spark):
    assert _works(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_classified_once(spark):
    docs = spark.createDataFrame([("a", "Curriculum Vitae", None, None)], f"doc_id string, text string, sheets {render._SHEETS}, error string")
    assert _plan(kinds.by_issuer(kinds.classified(docs))).count("curriculum vitae") == 1


def test_entries_are_read_once(spark):
    docs = spark.createDataFrame([("a", "1. X works Pkg-1")], "doc_id string, text string")
    entries = records.portfolio_entries(docs).where("pkg is not null")
    assert not [line for line in _plan(entries).split("\n") if " Filter " in f" {line.strip(' :+-')}" and "regexp_replace" in line]


@pytest.mark.parametrize("pattern", [p for _, _, p in kinds.SIGNATURES + documents.CUES])
def test_needles_are_in_every_match(pattern):
    for text in ("no. work completion certificate of completion ref: cc/1/2/3 to whomsoever it may concern pmp certification credential id certificate no. 4", "subject: performance of m/s x, bond no: bnd4, directors' report a/c: 5 licence @ a@b.co bg no 3"):
        for alternative in documents._alternatives(pattern):
            found = re.search(alternative, text)
            assert not found or documents.needle(alternative) in found[0]


def test_hits_are_those_of_the_patterns(spark):
    texts = ["Letter of  Recommendation\nto whomever it\tmay concern", "Final RA  Bill", "annual report\x0bbalance sheet", "", None, "Ref: CC/1/2/3 " + "x " * 700 + "curriculum vitae total experience", "directors' report of the lean certificate, contractor's own record"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    low = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    there = {w: F.contains(low(F.col("text")), F.lit(s)) for w, s in documents.stems([p for _, _, p in kinds.SIGNATURES]).items()}
    for _, weight, pattern in kinds.SIGNATURES:
        text = low(F.substring("text", 1, 1200)) if weight > 2 else low(F.col("text"))
        row = docs.agg(F.count_if(F.coalesce(text.rlike(pattern), F.lit(False)) != F.coalesce(documents.holds(text, pattern, there), F.lit(False)))).first()
        assert row[0] == 0, pattern


def test_blanks_and_dates(spark):
    texts = [" a \t\n b\r\n\x0bc\f ", "a  b", "ab", "", "\t", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.trim(F.regexp_replace("t", r"\s+", " "))
    flat = F.trim(F.regexp_replace(F.regexp_replace("t", "\n", " "), r"[ \t]+", " "))
    assert rows.where(~X.squeeze(F.col("t")).eqNullSafe(old) | ~X.flat(F.col("t")).eqNullSafe(flat)).count() == 0
    days = ["1996-02-03", "1996-02-30", "3/2/1996", "13/14/1996", "3 Feb 1996", "3 february 1996", "3 Sept 1996", "February 3, 1996", "feb 3, 1996", "3 May 1996", "on 1996-02-03 or 4/5/1997", "none", None]
    got = [r[0] and str(r[0]) for r in spark.createDataFrame([(d,) for d in days], "d string").select(X.parse_date(F.col("d"))).collect()]
    assert got == ["1996-02-03", None, "1996-02-03", None, "1996-02-03", "1996-02-03", None, "1996-02-03", "1996-02-03", "1996-05-03", "1996-02-03", None, None]
    sums = ["INR 12.5 Lakh", "Rs. 1,200.50", "3 crores", "2 lacs", "7 mn", "x", None]
    got = [r[0] and float(r[0]) for r in spark.createDataFrame([(d,) for d in sums], "d string").select(X.parse_inr(F.col("d"))).collect()]
    assert got == [1250000.0, 1200.5, 30000000.0, 200000.0, 7000000.0, None, None]


def test_many_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Rows count, not the bytes of files; a table of few rows may still be broadcast."""
    monkeypatch.setattr(scratch, "LARGE", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = scratch.cut(spark.range(100).withColumn("name", F.lit("x")), "many")
        few = scratch.cut(spark.range(40), "few")
        plan = lambda a, b: a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan(rows, rows.withColumnRenamed("name", "other")) and "Broadcast" in plan(few, few)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_answers_without_broadcasts(spark, monkeypatch):
    """The same answers where every table of files counts as large: joins by sorting, unions that are joined among them."""
    import duckdb

    monkeypatch.setattr(scratch, "LARGE", 0)
    con = duckdb.connect()
    for t in "region nation customer supplier orders lineitem".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()["answered_questions"]).fetchall()
    got = [(r.qid, r.client_key, r.answer) for r in catalog.queries()["answered_questions"](spark, SF).select("qid", "client_key", "answer").collect()]
    assert sorted(got) == sorted(want)


def test_labels_are_found_without_filters_below(spark):
    """Neither the normalised text nor the choice among labels is computed once more in a filter, which would move below the shuffle that deals the questions."""
    from factloom.operators import resolve

    q = spark.createDataFrame([("a", "What did roads and highways bring, and maintenance?"), ("b", None)], "qid string, question string")
    labels = spark.createDataFrame([("roads highways",), ("roads maintenance",), ("roads",)], "category string")
    found = resolve.named_categories(resolve.asked(q), labels)
    assert not [line for line in _plan(found).split("\n") if re.search(r"\bFilter\b.*(regexp_replace|aggregate\()", line)]
    assert [(r.qid, r.categories, r.category) for r in found.collect()] == [("a", ["roads highways", "roads maintenance"], "roads highways")]


def test_equal_questions_are_scored_once(spark, monkeypatch):
    """Works are looked for once for each set of words, state and manager; every question, null states among them, gets its work."""
    from factloom.operators import resolve

    seen = []
    monkeypatch.setattr(resolve, "_best", lambda df, *a, best=resolve._best: seen.append(df.select("qid").distinct().count()) or best(df, *a))
    works = spark.createDataFrame([(1, 7, "road works depot Goa"), (2, 8, "harbour bridge"), (3, 7, "harbour bridge")], "pkg long, manager_key long, work_name string")
    rows = [(i, ("What was the harbour bridge worth?", "The bridge: what was harbour worth?", "Value of road works depot in Goa?", "nothing")[i % 4]) for i in range(40)]
    q = resolve.asked(spark.createDataFrame(rows, "qid long, question string"))
    got = {r.qid: r.pkg for r in resolve.resolve_works(q, works).collect()}
    assert got == {i: (2, 2, 1)[i % 4] for i in range(40) if i % 4 < 3}
    assert seen == [2]  # the first two wordings hold the same words
    led = q.where("qid < 8").withColumn("manager_key", F.when(F.col("qid") < 4, 7).cast("long"))
    assert {r.qid: r.pkg for r in resolve.resolve_works(led, works).collect()} == {0: 3, 1: 3, 2: 1}


def test_an_estate_is_read_once(spark, tmp_path, monkeypatch):
    """Texts are normalised and typed before letterheads are counted, and the report joins records, not texts."""
    from factloom.operators import lake

    seen = []

    def joined(work, company):
        seen.append(_plan(company))
        raise StopIteration

    monkeypatch.setattr(kinds, "by_issuer", lambda t, by_issuer=kinds.by_issuer: seen.append(_plan(t)) or by_issuer(t))
    monkeypatch.setattr(lake.store, "report", joined)
    monkeypatch.setattr(lake, "read", lambda *a: spark.range(1))
    docs = spark.createDataFrame([("a", "Record of work completed\nWork roads works Pkg-7\nClient Acme (private)\nExecuted Value INR 5", None, None)], f"doc_id string, text string, sheets {render._SHEETS}, error string")
    lake.ingest(docs, str(tmp_path))
    with pytest.raises(StopIteration):
        lake.report(spark, str(tmp_path), "none")
    assert len(seen) == 2 and not [p for p in seen if "nfkc" in p or "regexp" in p or "contains" in p]


def _rows_of(monkeypatch, module) -> dict:
    """Rows of each table that a module cuts, by its name."""
    rows, plain = {}, module.cut

    def cut(df, name):
        out = plain(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "cut", cut)
    return rows


def test_equal_names_are_read_once(spark, monkeypatch):
    rows = _rows_of(monkeypatch, resolve)
    works = spark.createDataFrame([(k, ["steel bridge", "canal lining"][k % 2]) for k in range(40)], "pkg long, work_name string")
    q = resolve.asked(spark.createDataFrame([("a", "the canal lining work"), ("b", "a steel bridge")], "qid string, question string"))
    assert {r.qid: r.pkg for r in resolve.resolve_works(q, works).collect()} == {"a": 1, "b": 0}
    assert rows["work-names"] == [2]


def test_equal_questions_about_clients_are_scored_once(spark, monkeypatch):
    rows = _rows_of(monkeypatch, resolve)
    names = spark.createDataFrame([(1, "Mahanadi Works"), (2, "Trishakti Limited")], "client_key long, client_name string")
    table = resolve.client_signatures(names, spark.createDataFrame([("steel works",)], "work_name string"))
    text = lambda k: ["what does mahanadi owe", "trishakti totals", "nobody", None][k % 4]
    q = spark.createDataFrame([(str(k), text(k)) for k in range(40)] + [(None, text(0))], "qid string, nq string")
    assert {r.qid: r.client_key for r in resolve.resolve_clients(q, table).collect()} == {str(k): k % 4 + 1 for k in range(40) if k % 4 < 2}
    assert rows["texts"] == [4]


def test_works_are_made_once_for_answers(spark):
    """The works' own steps are run by one write, not by each step that reads them."""
    made = spark.sparkContext.accumulator(0)

    def seen(k):
        made.add(1)
        return k

    works = spark.createDataFrame([(k, k % 2, f"Client {'ab'[k % 2]}xx", "low works", "low", "good", "Prime", k % 2, True, "u") for k in range(10)], "pkg long, client_key long, client_name string, work_name string, category string, grading string, role string, manager_key long, has_ref boolean, business_unit string")
    works = works.withColumn("state", F.lit(None).cast("string")).withColumn("completed", F.lit("2020-01-05").cast("date")).withColumn("value", F.udf(seen, "long")("pkg").cast("decimal(18,2)"))
    invoices = spark.createDataFrame([], "client_key long, date date, invoiced decimal(18,2), received decimal(24,4), outstanding decimal(24,4), status string")
    people = spark.createDataFrame([], "manager_key long, name string, name_key string, works long, value decimal(18,2)")
    table = resolve.client_signatures(works.select("client_key", "client_name").distinct(), works.select("work_name").distinct())
    credentials = spark.createDataFrame([], "credential_id string, credential string, manager_key long, issued date")
    asked = spark.createDataFrame([("q", "What is the total value of works for Client axx?", "money")], "qid string, question string, answer_type string")
    got = answers.answer(asked, works, invoices, people, table, credentials).collect()
    assert [(r.qid, float(r.answer)) for r in got] == [("q", 20.0)] and made.value == 10


def test_a_store_parses_what_is_asked(spark, monkeypatch):
    """The store's works come from certificates, portfolios and letters: the company's certificates aren't parsed, nor fields that no query shows."""
    from factloom import catalog_documents

    def unasked(*_):
        raise AssertionError("the company's certificates were parsed")

    plans = {}
    monkeypatch.setattr(records, "company_certificates", unasked)
    monkeypatch.setattr(catalog_documents, "cut", lambda df, name, cut=scratch.cut: plans.update({name: _plan(df)}) or cut(df, name))
    works, certificates, company, _ = catalog_documents._store(spark, SF, ["category"])
    assert company is None and works.count() > 1000 and certificates.where("category is null or manager is not null").count() == 0
    assert r"graded\s+" not in plans["certificates"] and "crores?" not in plans["portfolio"] and "Repartition" not in plans["letters"]


def test_files_are_read_in_many_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100_000).repartition(4 * spark.sparkContext.defaultParallelism).write.parquet(path)
    few = spark.read.parquet(path).rdd.getNumPartitions()
    with scratch.spread(spark):
        assert spark.read.parquet(path).rdd.getNumPartitions() > few


def test_ingest_doesnt_shuffle_texts(spark, tmp_path, monkeypatch):
    """Files of the estate are read in many parts; the session's setting is as it was."""
    from factloom.operators import lake

    plans, key = [], "spark.sql.files.minPartitionNum"
    monkeypatch.setattr(lake, "cut", lambda df, name, cut=scratch.cut: plans.append((_plan(df), spark.conf.get(key, None))) or cut(df, name))
    docs = spark.createDataFrame([("a", "Record of work completed", None, None)], f"doc_id string, text string, sheets {render._SHEETS}, error string")
    lake.ingest(docs, str(tmp_path))
    assert plans and not [p for p, _ in plans if "Repartition" in p] and all(int(n) == 4 * spark.sparkContext.defaultParallelism for _, n in plans)
    assert spark.conf.get(key, None) is None


def test_issues_are_made_if_asked(spark, tmp_path, monkeypatch):
    from factloom.operators import lake

    rows = [("a", "Acme  Office\nCompletion Certificate\nRef: CC/1/1996/7\nName of Work    roads works Pkg-7\nContract Value    INR 5 Lakh\nCompletion Date    03/02/1996", None, None)]
    lake.ingest(spark.createDataFrame(rows, f"doc_id string, text string, sheets {render._SHEETS}, error string"), f"{tmp_path}/e")
    monkeypatch.setattr(records, "company_certificates", lambda *_: pytest.fail("parsed"))
    assert lake.build(spark, f"{tmp_path}/e", f"{tmp_path}/f", issues=False) is None
    assert lake.read(spark, f"{tmp_path}/f", "work").count() == 1


def test_letterheads_are_read_once(spark):
    rows = [("a", "\n  \nAcme  Office"), ("b", "  Acme  Office"), ("c", " Acme, Ltd. · Goa\nx"), ("d", " \n "), ("e", None), ("f", "")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], f"doc_id string, text string, sheets {render._SHEETS}, error string")
    typed = kinds.classified(docs)
    assert _plan(typed).count(r"\s{2,}|·") == 1 and "array_sort" not in _plan(typed)
    assert [r.head_org for r in typed.orderBy("doc_id").collect()] == ["acme", None, "acme, ltd", None, None, None]


def test_the_first_of_equal_scores_has_the_lowest_name(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["b a", "a b c c", "c", "d", None])], "doc_id long, text string")
    cues = [("z", 1, "b"), ("y", 1, r"\ba\b"), ("x", 2, "c"), ("w", 1, "c")]
    got = documents.classify(docs, cues, {"x": "w"}).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [("y", 1, "z"), ("x", 2, "y"), ("x", 2, None), ("unknown", 0, None), ("unknown", 0, None)]
