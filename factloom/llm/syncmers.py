"""Document fingerprints from closed syncmers, by DataFrame functions alone.

The words of a text are hashed; a k-mer is a run of ``K`` words, its inner substrings are its runs of ``S`` words. A k-mer
is a closed syncmer if the least hash of its inner substrings is that of the first or the last: a matter of the k-mer
alone, so an anchor that two texts share is chosen in both, whatever surrounds it. A fingerprint holds
the hashes of all closed syncmers of the whole text in the text's order, and as many positions (the number of each one's
first word), so that anchors can be matched by position; likeness is the Jaccard similarity of two texts' sets of anchors.
A text of fewer than K words has one anchor, the hash of the text at 0; an empty text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, partitions

K, S = 6, 2


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the hashes of all anchors of column ``text`` in its order, and ``out``_at, their first words' numbers."""
    w, g, at = f"_{out}_w", f"_{out}_g", f"{out}_at"
    df = df.withColumn(w, F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    df = df.withColumn(g, F.expr(f"case when size({w}) < {K} then cast(array() as array<bigint>) else transform(sequence(0, size({w}) - {S}), i -> xxhash64(get({w}, i), get({w}, i + 1))) end"))
    last = K - S
    inner = ", ".join(f"get({g}, i + {j})" for j in range(1, last))
    chosen = f"filter(sequence(0, size({g}) - {last + 1}), i -> least(get({g}, i), get({g}, i + {last})) <= least({inner}))"
    df = df.withColumn(at, F.expr(f"case when {text} = '' then cast(array() as array<int>) when size({g}) = 0 then array(0) else {chosen} end"))
    return df.withColumn(out, F.expr(f"case when size({g}) = 0 then transform({at}, i -> xxhash64({text})) else transform({at}, i -> xxhash64(get({g}, i), get({g}, i + {last // 2}), get({g}, i + {last}))) end")).drop(w, g)


def hexed(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1, over the whole sets of anchors; two empty fingerprints are alike."""
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1.0d else cast(size(array_intersect({a}, {b})) as double) / size(array_union({a}, {b})) end")


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id, next_id (the next lower one; after the lowest, the highest), chars: a third of the longest text of doc_id.

    Ids alone are dealt to ranges; a window ranks each range, and the ranges' first ids, one row each, close the gaps.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("chars"))
    n = partitions(docs.sparkSession)
    ids = cut(ids.repartitionByRange(n, F.col("doc_id").desc()).withColumn("range", F.spark_partition_id()), "ids-by-range")
    within = Window.partitionBy("range").orderBy(F.col("doc_id").desc())
    firsts = ids.groupBy("range").agg(F.max("doc_id").alias("first"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("after"), F.first("first").over(order).alias("top"))
    ids = ids.withColumn("below", F.lead("doc_id").over(within)).join(F.broadcast(after), "range")
    return cut(ids.select("doc_id", F.coalesce("below", "after", "top").alias("next_id"), "chars"), "next-ids")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions, edited_positions of every row.

    The edited text's last floor(n_chars / 3) code points are the first as many (or all) of the next document's text.
    A null text is the empty text. Rows that share a ``doc_id`` have one next document; of the rows of a next document's id the
    least text counts. Rows without a ``doc_id`` have an empty next text. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = next_ids(docs.where("doc_id is not null"))
    by_next = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), "chars")
    small = order.count() <= BROADCAST_ROWS
    heads = with_anchors(docs.join(F.broadcast(by_next) if small else by_next, "doc_id"), "text", "next_anchors")
    heads = heads.select(F.col("prev_id").alias("doc_id"), F.struct(F.expr("substring(text, 1, chars)").alias("head"), F.array_distinct("next_anchors").alias("next_anchors")).alias("next")).groupBy("doc_id").agg(F.min("next").alias("next"))
    out = docs.join(heads, "doc_id", "left").withColumn("n_chars", F.length("text").cast("long"))
    out = out.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) as int)), substring(coalesce(next.head, ''), 1, cast(floor(n_chars / 3) as int)))"))
    out = with_anchors(with_anchors(out, "text", "own"), "edited", "other").withColumn("following", F.coalesce("next.next_anchors", F.expr("cast(array() as array<bigint>)")))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hexed(F.col("own")).alias("fingerprint"), hexed(F.col("other")).alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"), F.col("own_at").alias("positions"), F.col("other_at").alias("edited_positions"))
