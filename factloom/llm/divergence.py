"""How the sources of a language differ in their use of words, with exact smoothed shares.

Plain relational work: each text's terms are exploded and counted by (lang, source, term); the terms that enough documents of a
language hold are kept; every group is crossed with its language's kept terms, so that absent terms count 0; shares are
compared by a self-join on lang and term, summed by pair of sources, and ranked.

The explosion is counted before anything is shuffled, so a hot source or word is a row of each task. What is crossed has one row for
each group and kept term, whatever the number of documents; the self-join has one for each pair of sources and kept term.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Runs of ASCII letters and of code points above 0x7F.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are multiples of one part in SCALE; every count is raised by PRIOR.
SCALE, PRIOR = 1_000_000_000, 5


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a group without terms has a row with a null term."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    terms = docs.select(*own, F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    # kind 0 holds all terms of a text, kind 1 each of them once
    kinds = terms.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("kind", "terms"))
    each = kinds.select("lang", "source", F.explode_outer("terms").alias("term"), F.col("kind").cast("long").alias("kind"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("kind")).alias("n"), F.sum("kind").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), in whole numbers of up to 38 digits."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    return 1 + F.call_function("div", wide, (total + PRIOR * kept).cast("decimal(19,0)"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: every other source of the language, by the distance of the two sources' shares summed over the kept terms (0 where none
    is kept). ``term``: the ``top`` kept terms that the group uses and uses more than its language does, by how much more.

    A null text, lang or source is ''; repeated rows are documents of their own; a term counts once for each document that holds it
    towards ``least_docs``. An empty table gives no rows, a language of one source no pairs. Further columns are not read. Equal
    values are ranked by the bytes of ``item``.
    """
    found = cut(counts(docs), "term-counts")
    groups = found.select("lang", "source").distinct()
    whole = found.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = cut(whole.where(F.col("docs") >= least_docs).select("lang", "term", "all_n"), "kept-terms")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    used = found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n")
    total = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    dense = (
        groups.join(size, "lang")
        .join(total, ["lang", "source"], "left")
        .join(kept, "lang")
        .join(used, ["lang", "source", "term"], "left")
        .select(
            "lang",
            "source",
            "term",
            F.coalesce("n", F.lit(0)).alias("n"),
            _share(F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0)), F.col("v")).alias("p"),
            _share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q"),
        )
    )
    dense = cut(dense, "term-shares")

    own, other = dense.select("lang", "source", "term", "p"), dense.select("lang", F.col("source").alias("item"), "term", F.col("p").alias("q"))
    ahead = own.join(other, ["lang", "term"]).where("source < item")  # the distance is the same both ways
    one_way = ahead.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # also of languages without terms
    pairs = pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    above = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


#: The same in DuckDB's SQL, over all documents.
SQL = rf"""
with texts as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') as terms
  from documents),
groups as (select distinct lang, source from texts),
occurrences as (select lang, source, unnest(terms) as term from texts),
holders as (select lang, unnest(list_distinct(terms)) as term from texts),
kept as (select lang, term from holders group by lang, term having count(*) >= 30),
used as (select lang, source, term, count(*) as n from occurrences join kept using (lang, term) group by lang, source, term),
sizes as (select lang, count(*) as v from kept group by lang),
totals as (select lang, source, sum(n) as total from used group by lang, source),
lang_used as (select lang, term, sum(n) as n from used group by lang, term),
lang_totals as (select lang, sum(n) as total from used group by lang),
shares as (
  select g.lang, g.source, k.term, coalesce(u.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(u.n, 0) + {PRIOR})) // (coalesce(t.total, 0) + {PRIOR} * s.v) as p,
    1 + ({SCALE}::hugeint * (l.n + {PRIOR})) // (lt.total + {PRIOR} * s.v) as q
  from groups g join kept k using (lang) join sizes s using (lang) join lang_totals lt using (lang)
    join lang_used l on l.lang = g.lang and l.term = k.term
    left join totals t on t.lang = g.lang and t.source = g.source
    left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term),
distances as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(d.value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join distances d on d.lang = a.lang and d.source = a.source and d.item = b.source
  union all
  select lang, source, 'term', term, cast(p - q as bigint) from shares where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from found)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
