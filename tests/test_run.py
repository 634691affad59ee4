"""A run from a folder of files to the CSV, the log and the counts; the names that a model is told."""

import io
import json
import zipfile

import pytest

from factloom import run
from factloom.operators import lake
from factloom.plans import wire
from factloom.sources import estate


def certificate(pkg, client, value, category="road works", manager="Bela Rao"):
    return (
        f"{client}  Office of the Secretary\nCOMPLETION CERTIFICATE\nRef: CC/{pkg}/2020/1\nName of Work    {category} Pkg-{pkg}\nContract Value    INR {value} Lakh\n"
        f"Completion Date    28/04/2020\nProject Manager    {manager}\n" + "Remarks follow. " * 10
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "deep").mkdir()
    for pkg, client, value in ((1, "Client One", 2), (2, "Client One", 3), (3, "Client Two", 5)):
        (root / "deep" / f"c {pkg}.pdf").write_bytes(b"%PDF")
        (root / "deep" / f"c {pkg}.pdf.txt").write_text(certificate(pkg, client, value))
    (root / "mute.pdf").write_bytes(b"%PDF")
    (root / "~$lock.txt").write_text("x")
    (root / "broken.xlsx").write_bytes(b"no book")
    (root / "note.txt").write_text("Minutes")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Ageing"/></sheets></workbook>')
        cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
        rows = [["Client", "Invoice No", "Invoice date", "Invoiced", "Collected", "Outstanding"], ["Client Two", "I1", "2020-05-01", "100", "60", "40"]]
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    (root / "book.xlsx").write_bytes(held.getvalue())
    return root


QUESTIONS = [
    {"qid": "a", "question": "What is the total value of works for Client One?", "tier": "easy"},
    {"qid": "a", "question": "How many works were done for Client Two?", "answer_type": " Count "},
    {"id": "b", "question": "What is the outstanding balance for Client Two?", "tier": "easy"},
    {"qid": "c", "question": None, "answer_type": "days"},
    {"question": "no id"},
]


def test_estate_of_files(spark, folder):
    got = {r.doc_id: r for r in estate.read_estate(spark, str(folder)).collect()}
    assert set(got) == {"deep_c_1.pdf", "deep_c_2.pdf", "deep_c_3.pdf", "mute.pdf", "broken.xlsx", "note", "book.xlsx"}
    assert got["mute.pdf"].error and got["broken.xlsx"].error and got["note"].text == "Minutes"
    assert got["book.xlsx"].sheets[0].rows[1][0] == "Client Two" and got["deep_c_1.pdf"].error is None


def test_run(spark, folder, tmp_path):
    asked, build, out = tmp_path / "q.json", str(tmp_path / "build"), tmp_path / "out"
    asked.write_text(json.dumps({"questions": QUESTIONS}))
    log = run.run(spark, str(folder), str(asked), str(out), build)
    rows = {r.place: r for r in log.collect()}
    assert [(rows[i].qid, rows[i].answer) for i in range(3)] == [("a", "500000"), ("a", "1"), ("b", "40")]
    assert rows[0].source == "rules" and rows[0].client_name == "Client One" and rows[0].agreed and rows[0]["values"] == ["500000"]
    assert (rows[3].qid, rows[3].answer, rows[3].source, rows[3].agreed) == ("c", "365", "fallback", False) and len(rows) == 4
    lines = "".join(p.read_text() for p in out.glob("part-*.csv")).splitlines()
    assert lines == ["question_id,answer", "a,500000", "a,1", "b,40", "c,365"]
    assert {(r["by"], r["value"]): r.n for r in run.counts(log).collect()} == {
        ("tier", "easy"): 2, ("tier", "untiered"): 2, ("answer_type", "money"): 2, ("answer_type", "count"): 1, ("answer_type", "days"): 1,
        ("source", "rules"): 3, ("source", "fallback"): 1, ("agreed", "true"): 3, ("agreed", "false"): 1,
    }
    assert spark.read.json(f"{build}/run_log").count() == 4 and spark.read.parquet(f"{build}/issues").count() == 0
    figures = {r.figure: (r.n, r["of"], r.share) for r in lake.report(spark, f"{build}/estate", f"{build}/facts").collect()}
    assert figures["works"] == (3.0, None, None) and figures["invoice"][0] == 1.0
    assert figures["certificates that gave a work"] == (3.0, 3, 1.0) and figures["values that the company confirms"] == (0.0, 0, None)
    # the store that is there is reused, with a limit and a model's plans
    before = lake.current(spark, f"{build}/facts")
    side = {"source": "works", "scope": "client", "agg": "count"}
    plans = tmp_path / "plans.json"
    plans.write_text("".join(json.dumps({"qid": "a", "place": k, "wire": json.dumps({"left": side, "combine": "left"})}) + "\n" for k in range(2)))
    log = run.run(spark, "/nowhere", str(asked), str(out), build, str(plans), "model", 1, True)
    assert [(r.answer, r.source, sorted(r["values"])) for r in log.collect()] == [("2", "model", ["2", "500000"])]
    assert lake.current(spark, f"{build}/facts") == before
    with pytest.raises(ValueError, match="trust"):
        run.answered(spark, build, estate.load_questions(spark, str(asked)), trust="none")


def test_no_work_leaves_the_store(spark, tmp_path):
    docs = spark.createDataFrame([("n", "Minutes", None, None)], "doc_id string, text string, sheets array<struct<sheet:string, rows:array<array<string>>>>, error string")
    with pytest.raises(ValueError, match="no work"):
        run.prepare(spark, docs, str(tmp_path))
    assert not lake.is_built(spark, f"{tmp_path}/facts")


def test_vocabulary(spark):
    works = spark.createDataFrame([("b", "Prime", None, None), ("a", None, "good", None), ("", "Prime", " good ", None), ("c", "", None, None)], "category string, role string, grading string, completed date")
    people = spark.createDataFrame([("Bela",), (None,)], "name string")
    got = {(r.kind, r.place): (r.name, r.total) for r in wire.vocabulary(works, people, spark.createDataFrame([("X",)], "client_name string"), 2).collect()}
    assert got == {("category", 1): ("a", 3), ("category", 2): ("b", 3), ("role", 1): ("Prime", 1), ("grading", 1): ("good", 1), ("client", 1): ("X", 1), ("engineer", 1): ("Bela", 1)}
    lines = {r.kind: r.line for r in wire.vocabulary_lines(wire.vocabulary(works, people, spark.createDataFrame([], "client_name string"), 2)).collect()}
    assert lines["category"] == "category (3): a; b ... (+1 more)" and "client" not in lines
