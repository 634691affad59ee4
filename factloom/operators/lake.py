"""The estate and its fact store as tables on disk: ingested once, typed, parted by type, parsed from there, replaced as a whole.

Every build writes a version of its own and then names it in one small file, ``current.txt``: readers see the old tables or the new ones, and a build that
fails leaves the old ones. Documents are parted by ``doc_type``, so an extractor reads the files of its kind only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.scratch import cut, spread
from . import kinds, records, store

FACTS = ["work", "credential", "cv", "invoice", "bond", "dossier"]
#: Texts shorter than this are counted as weak: little was read from the file.
WEAK = 200


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _publish(spark: SparkSession, root: str, version: str) -> None:
    files, where = _file(spark, f"{root}/current.txt")
    out = files.create(where, True)
    out.write(bytearray(version.encode()))
    out.close()


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version that readers are to see."""
    return f"{root}/{spark.read.text(f'{root}/current.txt', wholetext=True).first()[0].strip()}"


def ingest(docs: DataFrame, root: str) -> str:
    """Type ``docs`` (doc_id, text, sheets, error) and write them under ``root``: ``documents`` parted by doc_type, ``quarantine`` those with an error.

    Texts are normalised (NFKC). Null ids, empty texts and repeated ids are rows like others; an empty table gives empty tables. ``docs`` are read twice
    (documents, errors), so they are to be a table of files, and of many: texts are not shuffled.
    """
    spark = docs.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", X.nfkc("text").alias("text"), "sheets", "error")
    good = F.col("error").isNull()
    with spread(spark):
        # kept as a table: the count of letterheads would else normalise all texts once more
        typed = kinds.by_issuer(cut(kinds.classified(rows), "typed")).withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))
        typed.where(good).drop("error").write.option("compression", "zstd").partitionBy("doc_type").parquet(f"{root}/{version}/documents")
        docs.where(~good).select("doc_id", "error").write.parquet(f"{root}/{version}/quarantine")
    _publish(spark, root, version)
    return f"{root}/{version}"


_DOCUMENT = f"doc_id string, text string, sheets {'array<struct<sheet:string, rows:array<array<string>>>>'}, score int, runner_up string, head_org string, chars int, doc_type string"


def of_type(spark: SparkSession, root: str, *doc_types: str) -> DataFrame:
    """Documents of the named types (all, if none is named); only their files are read."""
    docs = spark.read.schema(_DOCUMENT).parquet(f"{current(spark, root)}/documents")
    return docs.where(F.col("doc_type").isin(*doc_types)) if doc_types else docs


def type_counts(spark: SparkSession, root: str) -> DataFrame:
    """doc_type, n, weak (texts of fewer than 200 characters); quarantined documents are 'unreadable'."""
    short = F.col("text").isNotNull() & (F.col("chars") < WEAK)
    good = of_type(spark, root).groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(short).alias("weak"))
    bad = spark.read.schema("doc_id string, error string").parquet(f"{current(spark, root)}/quarantine").agg(F.count("*").alias("n"))
    return good.unionByName(bad.where("n > 0").select(F.lit("unreadable").alias("doc_type"), "n", F.lit(0).cast("long").alias("weak")))


def build(spark: SparkSession, estate: str, root: str, issues: bool = True) -> DataFrame | None:
    """Parse the ingested ``estate`` into the six tables of the fact store under ``root`` and return the ``issues``, if they are asked for. ValueError if no
    work was parsed: the store that is there stays."""
    with spread(spark):
        return _build(spark, estate, root, issues)


def _build(spark: SparkSession, estate: str, root: str, issues: bool) -> DataFrame | None:
    of = lambda *types: of_type(spark, estate, *types)
    certificates = cut(records.completion_certificates(of("completion_certificate")), "certificates")
    letters = cut(records.reference_letters(of("reference_letter")).select("doc_id", "pkg", "role"), "letters")
    work = store.works(certificates, records.portfolio_entries(of("past_performance_portfolio")), letters)
    people, lives = records.personnel_certificates(of("personnel_certificate")), records.cvs(of("cv"))
    tables = {
        "work": work,
        "credential": people.withColumn("holder_key", X.norm_person(F.col("holder"))),
        "cv": lives.withColumn("name_key", X.norm_person(F.col("name"))),
        "invoice": records.receivables(of("ageing_workbook")).withColumn("client_key", X.norm_client(F.col("client_name"))),
        "bond": records.performance_bonds(of("performance_bond")),
        "dossier": records.tender_dossiers(of("tender_dossier")),
    }
    version = f"v-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{root}/{version}/{name}")
    if spark.read.parquet(f"{root}/{version}/work").limit(1).count() == 0:
        files, where = _file(spark, f"{root}/{version}")
        files.delete(where, True)
        raise ValueError("no work was parsed: the store would be empty")
    _publish(spark, root, version)
    if not issues:
        return None
    # kept as tables: each kind of issue would else parse the texts once more
    named = cut(people.select("doc_id", F.col("holder").alias("name")).unionByName(lives.select("doc_id", "name")), "named")
    company = cut(records.company_certificates(of("company_completion_certificate")).select("doc_id", "cert_ref", "pkg", "value", "manager"), "company")
    return store.issues(read(spark, root, "work"), certificates, company, letters, named)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, root)}/{name}")


def is_built(spark: SparkSession, root: str) -> bool:
    files, where = _file(spark, f"{root}/current.txt")
    return bool(files.exists(where))


def report(spark: SparkSession, estate: str, root: str) -> DataFrame:
    """figure, n, of, share: what was parsed and how far independent readings of it agree; ``of`` and ``share`` where a figure is a part of another."""
    # kept as a table: filters of the joins would be moved below the parse and read every field again
    with spread(spark):
        company = cut(records.company_certificates(of_type(spark, estate, "company_completion_certificate")).select("pkg", "value"), "company")
    row = store.report(read(spark, root, "work"), company)
    listed = of_type(spark, estate, "completion_certificate").agg(F.count("*").alias("certificates"))
    for name in FACTS[1:]:
        listed = listed.crossJoin(read(spark, root, name).agg(F.count("*").alias(name)))  # a row each
    whole = ["works", "total", "clients", "managers", "categories", *FACTS[1:]]
    parts = [
        ("with a reference letter", "referenced", "works"),
        ("with a known role", "roles", "works"),
        ("values that the company confirms", "agreed", "checked"),
        ("certificates that gave a work", "works", "certificates"),
    ]
    none = F.lit(None).cast("long")
    figures = [F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("n"), none.alias("of")) for c in whole]
    figures += [F.struct(F.lit(name).alias("figure"), F.col(n).cast("double").alias("n"), F.col(of).cast("long").alias("of")) for name, n, of in parts]
    out = row.crossJoin(listed).select(F.explode(F.array(*figures)).alias("f")).select("f.*")
    return out.withColumn("share", F.round(F.try_divide("n", F.col("of").cast("double")), 6))


def facts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """works, invoices, managers, credentials, clients of the store, with the columns that questions are answered from.

    Clients and managers get a number for a key, the hash of their normalised name (64 bits); ``keys_are_distinct`` holds it against the names.
    The last CV by document tells a manager's business unit.
    """
    number = lambda c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.xxhash64(c))
    units = read(spark, root, "cv").where("name_key != ''").groupBy("name_key").agg(F.max_by("business_unit", "doc_id").alias("business_unit"))
    work = read(spark, root, "work").join(units, F.col("manager_key") == F.col("name_key"), "left").drop("name_key")
    works = work.select(
        "pkg", number(F.col("client_key")).alias("client_key"), "client_name", F.lower("state").alias("state"), "work_name", "category", "value", "completed",
        number(F.col("manager_key")).alias("manager_key"), "role", "grading", F.col("has_reference_letter").alias("has_ref"), "business_unit",
    )
    billed = read(spark, root, "invoice").withColumn("client_key", number(F.col("client_key")))
    invoices = billed.select("client_key", "date", "invoiced", "received", "outstanding", "status")
    names = work.where("manager_key != ''").groupBy("manager_key").agg(F.count("*").alias("works"), F.sum("value").alias("value"))
    spelt = work.where("manager_key != ''").groupBy("manager_key").agg(F.min_by("manager", "pkg").alias("name"))
    managers = names.join(spelt, "manager_key").select(number(F.col("manager_key")).alias("manager_key"), "name", F.col("manager_key").alias("name_key"), "works", "value")
    held = read(spark, root, "credential")
    credentials = held.select("credential_id", "credential", number(F.col("holder_key")).alias("manager_key"), "issued")
    clients = works.select("client_key", "client_name", "pkg").groupBy("client_key").agg(F.min_by("client_name", "pkg").alias("client_name"))
    only_billed = billed.join(clients, "client_key", "left_anti").groupBy("client_key").agg(F.min("client_name").alias("client_name"))
    return {"works": works, "invoices": invoices, "managers": managers, "credentials": credentials, "clients": clients.unionByName(only_billed).where("client_key is not null")}


def keys_are_distinct(spark: SparkSession, root: str) -> bool:
    """Whether no two names of clients or managers share a number."""
    work = read(spark, root, "work")
    counts = [F.count_distinct(c) == F.count_distinct(F.xxhash64(c)) for c in ("client_key", "manager_key")]
    return work.agg((counts[0] & counts[1]).alias("ok")).first().ok
