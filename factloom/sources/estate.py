"""Files in and answers out: document estates, workbooks, questions, answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "xlsx", "xlsm")


def find_documents(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, doc_id, kind, content of every document under ``root``; lock files and dot files are left out. Ids end in the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name, suffix = F.element_at(F.split("path", "/"), -1), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), F.lit("^" + root.replace("file:", "").rstrip("/") + "/"), F.lit(""))
    key = F.btrim(F.regexp_replace(rel, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    wanted = suffix.isin(*suffixes) & ~name.startswith("~$") & ~name.startswith(".")
    return files.where(wanted).select("path", key.alias("doc_id"), suffix.alias("kind"), F.col("length").alias("bytes"), "content")


def _sheets(content: bytes) -> list[dict]:
    """Values and formulas of a workbook, by the standard library alone."""
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"]
        listed = [s for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(s) == "sheet"]
        links = {}
        if "xl/_rels/workbook.xml.rels" in z.namelist():
            links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        numbered = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for place, s in enumerate(listed):
            # a sheet's file is the one that its relation names; a book without relations numbers its files in order
            target = links.get(next((v for k, v in s.attrib.items() if k.rpartition("}")[2] == "id" and k != "id"), None))
            path = (target[1:] if target.startswith("/") else f"xl/{target}") if target else numbered[place]
            name = s.get("name")
            rows, formulas = [], {}
            for row in (e for e in ET.fromstring(z.read(path)).iter() if local(e) == "row"):
                cells: list[str | None] = []
                for c in (e for e in row if local(e) == "c"):
                    col = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        col = col * 26 + ord(ch) - 64
                    cells += [None] * (max(col, 1) - 1 - len(cells))
                    v = next((e for e in c if local(e) == "v"), None)
                    text = "".join(t.text or "" for t in c.iter() if local(t) == "t") if c.get("t") == "inlineStr" else v.text if v is not None else None
                    cells.append(strings[int(text)] if c.get("t") == "s" and text is not None else text)
                    f = next((e for e in c if local(e) == "f"), None)
                    if f is not None and f.text:
                        formulas[c.get("r")] = "=" + f.text
                rows.append(cells)
            out.append({"sheet": name, "rows": rows, "formulas": formulas})
        return out


def read_workbooks(files: DataFrame) -> DataFrame:
    """doc_id, sheets, error: a file that can't be read gives its error, never a failed job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, content in zip(part["doc_id"], part["content"], strict=True):
                try:
                    rows.append((doc, _sheets(content), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((doc, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "sheets", "error"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, sheets array<struct<sheet:string, rows:array<array<string>>, formulas:map<string,string>>>, error string")


def read_estate(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, text, sheets, error of every document under ``root``.

    The text of ``a.pdf`` is the file ``a.pdf.txt`` beside it, in UTF-8; a PDF without one, and a workbook that can't be read, is a row with
    its error. A text without a PDF is a document too.
    """
    files = find_documents(spark, root, (*SUFFIXES, "txt"))
    sheets = "array<struct<sheet:string, rows:array<array<string>>>>"
    none = F.lit(None).cast("string")
    texts = files.where("kind = 'txt'").select(F.regexp_replace("doc_id", r"(?i)\.txt$", "").alias("doc_id"), F.col("content").cast("string").alias("text"))
    texts = texts.select("doc_id", "text", F.lit(None).cast(sheets).alias("sheets"), none.alias("error"))
    mute = files.where("kind = 'pdf'").select("doc_id").join(texts.select("doc_id"), "doc_id", "left_anti")
    mute = mute.select("doc_id", none.alias("text"), F.lit(None).cast(sheets).alias("sheets"), F.lit("no text beside the PDF").alias("error"))
    books = read_workbooks(files.where(F.col("kind").isin("xlsx", "xlsm")))
    plain = F.transform("sheets", lambda s: F.struct(s["sheet"].alias("sheet"), s["rows"].alias("rows")))
    return texts.unionByName(mute).unionByName(books.select("doc_id", none.alias("text"), plain.cast(sheets).alias("sheets"), "error"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, answer_type, tier from a list or an object with ``questions``; rows without an id are dropped."""
    item = "qid string, question_id string, id string, question string, text string, answer_type string, tier string"
    text = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"struct<questions:array<struct<{item.replace(' string', ':string')}>>>")["questions"], F.from_json("value", f"array<struct<{item.replace(' string', ':string')}>>"))
    q = text.select(F.posexplode(rows).alias("place", "q"))
    return q.select(F.coalesce("q.qid", "q.question_id", "q.id").alias("qid"), F.coalesce("q.question", "q.text", F.lit("")).alias("question"), F.coalesce("q.answer_type", F.lit("money")).alias("answer_type"), F.col("q.tier").alias("tier"), "place").where("qid is not null")


def write_answers(answers: DataFrame, path: str) -> None:
    """question_id,answer in the questions' order, as one CSV part."""
    answers.orderBy("place").select(F.col("qid").alias("question_id"), "answer").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
