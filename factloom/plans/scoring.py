"""Answers held against a key: right, wrong and missing ones, in all and by answer type, tier, shape and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X


def judged(gold: DataFrame, answers: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """qid, answer_type, tier, shape, source, answered, right for every row of ``gold`` (qid, answer_type, answer and, if known, tier).

    ``answers``: qid, answer; ``log``: qid, shape, source. What a table lacks is '?'; an answer that isn't a number is wrong; answers without a key don't
    count. Of several answers to one question the first by text counts.
    """
    tier = F.col("tier") if "tier" in gold.columns else F.lit(None).cast("string")
    key = gold.select("qid", "answer_type", tier.alias("tier"), F.col("answer").cast("string").try_cast("double").alias("want"))
    given = answers.where("qid is not null").groupBy("qid").agg(F.min(F.col("answer").cast("string")).alias("got"), F.lit(True).alias("answered"))
    out = key.join(given, "qid", "left")
    if log is not None:
        out = out.join(log.groupBy("qid").agg(F.min("shape").alias("shape"), F.min("source").alias("source")), "qid", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("shape", "source")})
    right = X.within(F.col("got").try_cast("double"), F.col("want"), F.col("answer_type"))
    unknown = lambda c: F.coalesce(c, F.lit("?")).alias(c)
    return out.select("qid", *map(unknown, ("answer_type", "tier", "shape", "source")), F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce(right, F.lit(False)).alias("right"))


def scores(rows: DataFrame) -> DataFrame:
    """by, value, questions, answered, right of ``judged`` rows: one row for all, one for each answer type, tier, shape and source."""
    by = ["answer_type", "tier", "shape", "source"]
    sets = rows.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by])
    out = sets.agg(F.count("*").alias("questions"), F.count_if("answered").alias("answered"), F.count_if("right").alias("right"), F.grouping_id().alias("g"))
    which = F.when(F.col("g") == 15, "all")
    for place, c in enumerate(by):
        which = which.when(F.col("g") == 15 - (8 >> place), c)
    return out.select(which.alias("by"), F.coalesce(*by, F.lit("")).alias("value"), "questions", "answered", "right")
