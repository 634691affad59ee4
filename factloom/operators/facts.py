"""The fact store as DataFrames: works, invoices, credentials and units, over the driver's star schema.

Joins are on keys and left to the optimizer: dimension tables are broadcast by their size, large ones sort-merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import apart

GRADES = ["satisfactory", "good", "very good", "excellent"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: certificate left-joined to its client, manager and reference letters."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("manager_key"), F.bool_or(F.col("l_returnflag") == "R").alias("letter"))
    state = F.initcap(F.translate(F.lower("n_name"), "_0123456789", " abcdefghij"))
    customers = table(spark, sf_dir, "customer")
    clients = customers.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", state.alias("state"))
    clients = apart(clients, customers)
    grade = F.element_at(F.array(*map(F.lit, GRADES)), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").join(clients, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    category = F.regexp_replace(F.lower("o_orderpriority"), "^[0-9]-", "")
    return orders.select(
        F.col("o_orderkey").alias("pkg"),
        F.col("o_custkey").alias("client_key"),
        F.col("c_name").alias("client_name"),
        "state",
        category.alias("category"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"),
        F.col("o_orderdate").cast("date").alias("completed"),
        "manager_key",
        F.when(F.col("o_orderstatus") == "F", "Prime").when(F.col("o_orderstatus") == "O", "JV Partner").otherwise("Sub-contractor").alias("role"),
        grade.alias("grading"),
        F.coalesce("letter", F.lit(False)).alias("has_ref"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, off = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("client_key"), F.col("l_shipdate").cast("date").alias("date"), price.alias("invoiced"), (price * (1 - off)).cast("decimal(24,4)").alias("received"), (price * off).cast("decimal(24,4)").alias("outstanding"), F.col("l_linestatus").alias("status"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business unit and earliest credential of each manager."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("s_suppkey").alias("manager_key"), F.col("r_name").alias("business_unit"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("issued"))


FIRST_NAMES = ["Asha", "Bela", "Chitra", "Devika", "Esha", "Farida", "Gauri", "Hema", "Indra", "Jaya", "Kavita", "Lata"]


def managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manager_key, name, name_key, works, value of each manager; names are made of the key, in letters."""
    last = F.initcap(F.translate(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, FIRST_NAMES)), (F.pmod("s_suppkey", F.lit(12)) + 1).cast("int")), last)
    sums = works(spark, sf_dir).where("manager_key is not null").groupBy("manager_key").agg(F.count("*").alias("works"), F.sum("value").alias("value"))
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("manager_key"), name.alias("name"), F.lower(name).alias("name_key"))
    return people.join(sums, "manager_key", "left").na.fill({"works": 0})


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """credential_id, credential, manager_key, issued: one of each manager, of three kinds."""
    kind = F.element_at(F.array(F.lit("PMP"), F.lit("Six Sigma Black Belt"), F.lit("PRINCE2")), (F.pmod("manager_key", F.lit(3)) + 1).cast("int"))
    number = F.concat(F.lit("CR-"), F.lpad(F.col("manager_key").cast("string"), 7, "0"))
    return units(spark, sf_dir).select(number.alias("credential_id"), kind.alias("credential"), "manager_key", "issued")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a full order; losers are the rest."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def documents_with(df: DataFrame, other: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched, issues): semi and anti join."""
    return df.join(other, keys, "left_semi"), df.join(other, keys, "left_anti")


#: The same views as SQL, for the oracle.
VIEWS = """with lines as (select l_orderkey, min(l_suppkey) manager_key, bool_or(l_returnflag = 'R') letter from lineitem group by l_orderkey),
work as (select o_orderkey pkg, o_custkey client_key, c_name client_name, regexp_replace(lower(o_orderpriority), '^[0-9]-', '') category, lower(translate(lower(n_name), '_0123456789', ' abcdefghij')) state,
 cast(o_totalprice as decimal(18,2)) as value, cast(o_orderdate as date) completed, manager_key,
 case o_orderstatus when 'F' then 'Prime' when 'O' then 'JV Partner' else 'Sub-contractor' end as role,
 case o_orderkey % 4 when 0 then 'satisfactory' when 1 then 'good' when 2 then 'very good' else 'excellent' end as grading, coalesce(letter, false) has_ref
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join lines on o_orderkey = l_orderkey),
invoice as (select o_custkey client_key, cast(l_shipdate as date) as date, cast(l_extendedprice as decimal(18,2)) invoiced,
 cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(24,4)) received,
 cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as decimal(24,4)) outstanding, l_linestatus status from lineitem join orders on l_orderkey = o_orderkey),
unit as (select s_suppkey manager_key, r_name business_unit, date '1996-01-01' + cast(s_suppkey as int) issued from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
"""
