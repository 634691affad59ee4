"""Document operators: classification by weighted cues, issuer fix-up, record extraction from rendered certificates."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.scratch import cut

#: (type, weight, pattern); weights up to 2 look at the whole text, larger ones at its first 1200 characters.
CUES = [("license_notice", 3, r"licen[cs]e"), ("license_notice", 1, r"released under|licensed under"), ("contact_record", 2, r"[\w.]+@[\w.]+\.\w+"), ("secret_dump", 2, r"(token|password|secret|api[_-]?key)\s*[=:]"), ("numeric_record", 1, r"\b\d{10,}\b"), ("shouting", 1, r"!!.*!!")]
#: A type that, if it scores at all, takes the other out of the vote.
DOMINATES = {"secret_dump": "numeric_record", "license_notice": "contact_record"}
HEAD = 1200


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern that stand outside of brackets."""
    out, depth = [""], 0
    for token in re.findall(r"\\.|\[[^\]]*\]|.", pattern):
        depth += {"(": 1, ")": -1}.get(token, 0)
        out = [*out, ""] if token == "|" and depth == 0 else [*out[:-1], out[-1] + token]
    return out


def needle(pattern: str) -> str:
    """The longest string that every match of a pattern without outer alternatives holds, as far as it is easily seen; may be empty."""
    bare = re.sub(r"\((?:[^()]|\([^()]*\))*\)", "\0", re.sub(r"\[[^\]]*\]", "\0", pattern))  # classes, then groups
    bare = re.sub(r"(?:\\.|[^\\])(?:[?*+]|\{[\d,]*\})\??|\\[A-Za-z]|(?<!\\)[.^$]", "\0", bare)
    return max(re.sub(r"\\(.)", r"\1", bare).split("\0"), key=len)


def stems(patterns: list[str], length: int = 4) -> dict[str, str]:
    """For each needle of the patterns that is as long a stem, a part of it that as many needles as can be share."""
    left, out = {w for p in patterns for a in _alternatives(p) if len(w := needle(a)) >= length}, {}
    while left:
        counts = Counter(s for w in left for s in {w[i : i + length] for i in range(len(w) - length + 1)})
        stem = max(counts, key=lambda s: (counts[s], s))
        out |= {w: stem for w in left if stem in w}
        left -= out.keys()
    return out


def holds(text: Column, pattern: str, there: dict[str, Column] | None = None) -> Column:
    """Whether a pattern matches somewhere: a plain string is looked for as such, another pattern only where a string that it needs is there.
    ``there``: for needles with a stem, whether the text may hold it."""

    def one(alternative: str) -> Column:
        word = needle(alternative)
        if not word:
            return text.rlike(alternative)
        found = F.contains(text, F.lit(word))
        found = there[word] & found if there and word in there else found
        return found if word == alternative else found & text.rlike(alternative)

    return reduce(Column.__or__, map(one, _alternatives(pattern)))


def classify(docs: DataFrame, cues: list[tuple[str, int, str]] = CUES, dominates: dict[str, str | list[str]] = DOMINATES, keep: bool = False) -> DataFrame:
    """doc_id, doc_type, score, runner_up: highest score, ties by name; no score is 'unknown'. One pass, no shuffle; ``keep``: other columns stay.

    Text and head are columns made once a row, then each cue's hit, then sums: expressions stay small enough to be compiled whole.
    """
    own = docs.columns if keep else ["doc_id"]
    made = docs.select(*own, F.lower(X.squeeze(F.col("text"))).alias("_body"), "text") if not keep else docs.withColumn("_body", F.lower(X.squeeze(F.col("text"))))
    head = F.when(F.length("text") <= HEAD, F.col("_body")).otherwise(F.lower(X.squeeze(F.substring("text", 1, HEAD))))
    stem_of = stems([p for _, _, p in cues])
    each = sorted(set(stem_of.values()))
    known = F.transform(F.array(*[F.contains("_body", F.lit(x)) for x in each]).cast("array<boolean>"), lambda x: x)
    made = made.select(*own, "_body", head.alias("_head"), known.alias("_g"))
    there = {w: F.get("_g", F.lit(each.index(x))) for w, x in stem_of.items()}
    kinds = sorted({k for k, _, _ in cues})
    points = lambda weight, pattern: F.when(holds(F.col("_head" if weight > 2 else "_body"), pattern, there), weight).otherwise(0)
    total = {k: sum((points(weight, pattern) for kind, weight, pattern in cues if kind == k), F.lit(0)) for k in kinds}
    # through a function of arrays, which Spark compiles in parts: one method of all cues is too long for the JVM to compile
    made = made.select(*own, F.transform(F.array(*[total[k] for k in kinds]), lambda x: x.cast("int")).alias("_s"))
    at = {k: i for i, k in enumerate(kinds)}
    winners: dict[str, list[str]] = {}
    for winner, losers in dominates.items():
        for loser in [losers] if isinstance(losers, str) else losers:
            winners.setdefault(loser, []).append(winner)
    score = lambda k: F.get("_s", F.lit(at[k]))
    final = {k: F.when(F.greatest(F.lit(0), *[score(w) for w in winners[k]]) > 0, 0).otherwise(score(k)) if k in winners else score(k) for k in kinds}
    # places in an array of whole numbers, not sorted pairs: the kinds are in order, so the first of equal scores has the lowest name
    made = made.select(*own, F.array(*[final[k] for k in kinds]).alias("_f"))
    place = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    made = made.select(*own, "_f", place(F.col("_f")).alias("_p"))
    made = made.select(*own, F.array_max("_f").alias("score"), "_p", F.transform("_f", lambda s, i: F.when(i + 1 == F.col("_p"), 0).otherwise(s)).alias("_r"))
    name = lambda at: F.get(F.array(*map(F.lit, kinds)), at - 1)
    first = F.when(F.col("score") > 0, name(F.col("_p")))
    second = F.when(F.array_max("_r") > 0, name(place(F.col("_r"))))
    return made.select(*own, F.coalesce(first, F.lit("unknown")).alias("doc_type"), "score", second.alias("runner_up"))


def letterhead(text: Column) -> Column:
    """The first line that isn't blank, up to two blanks or a point; mostly that is the text's first line, and no other is cut."""
    first = F.substring_index(text, "\n", 1)
    line = F.when(F.trim(first) != "", first).otherwise(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))
    return F.btrim(F.lower(F.get(F.split(line, r"\s{2,}|·", 2), F.lit(0))), F.lit(" .,-"))


def dominant_issuer(docs: DataFrame, head: Column, share: float = 0.05) -> DataFrame:
    """The modal head, if it is as frequent as max(3, share of all rows); ties go to the lowest id."""
    # counted without ids, as Spark sorts all rows for the least of strings; ids are read for heads that are equally frequent only
    counts = cut(docs.groupBy(head.alias("head")).agg(F.count("*").alias("n")), "heads")
    total = counts.agg(F.sum("n").alias("total"))
    known = counts.where("head is not null")
    top = known.join(F.broadcast(known.agg(F.max("n").alias("n"))), "n")
    if top.limit(2).count() > 1:
        firsts = docs.select(head.alias("head"), "doc_id").join(top, "head").groupBy("head", "n").agg(F.min("doc_id").alias("first"))
        top = firsts.orderBy("first").limit(1).drop("first")
    return top.crossJoin(total).where(F.col("n") >= F.greatest(F.lit(3), F.col("total") * share)).select("head", "n")


def classify_sheet(header: Column, signatures: list[tuple[str, str, str]]) -> Column:
    """First type whose two patterns both match the header row."""
    out = F.lit("unknown_workbook")
    for kind, a, b in reversed(signatures):
        out = F.when(F.lower(header).rlike(a) & F.lower(header).rlike(b), kind).otherwise(out)
    return out


def render_certificates(works: DataFrame) -> DataFrame:
    """Certificate texts of works, in a table layout (even numbers) and in prose (odd ones)."""
    table = F.format_string("COMPLETION CERTIFICATE\nClient: %s\nReference: CERT/%s/Pkg-%s\nName of Work: %s works Pkg-%s\nCategory: %s\nValue: INR %s Lakh\nDate of Completion: %s\nGrading: %s", "client_name", "client_key", "pkg", "category", "pkg", "category", (F.col("value") / 100000).cast("decimal(18,7)"), F.date_format("completed", "dd/MM/yyyy"), "grading")
    prose = F.format_string("COMPLETION CERTIFICATE\nThis is to certify that %s had the work %s works Pkg-%s (category: %s) executed at a value of Rs. %s under reference CERT/%s/Pkg-%s. The work was completed on %s and graded as %s.", "client_name", "category", "pkg", "category", F.col("value"), "client_key", "pkg", F.date_format("completed", "yyyy-MM-dd"), "grading")
    return works.select("pkg", F.when(F.col("pkg") % 2 == 0, table).otherwise(prose).alias("text"))


def parse_certificates(docs: DataFrame) -> DataFrame:
    """Typed records of certificate texts; each field is found by itself, in either layout."""
    t = F.col("text")
    return docs.select(
        X.package_of(t).alias("pkg"),
        X.first(t, [r"Client: ([^\n]+)", r"certify that (.+?) had the work"]).alias("client_name"),
        X.first(t, [r"CERT/(\d+)/"]).try_cast("bigint").alias("client_id"),
        X.first(t, [r"category: ([^)\n]+)"]).alias("category"),
        X.parse_inr(X.first(t, [r"Value: ([^\n]+)", r"value of (Rs\. [\d.,]+\d)"])).alias("value"),
        X.parse_date(X.first(t, [r"Completion: ([^\n]+)", r"completed on (\S+)"])).alias("completed"),
        X.first(t, [r"Grading: ([^\n]+)", r"graded as ([a-z ]+)\."]).alias("grading"),
    )


def parse_portfolio(text: Column) -> Column:
    """Several records of one text: array of (pkg, role, client)."""
    pattern = F.lit(r"Pkg-(\d+) \| ([^|\n]+) \| ([^|\n]+)")
    return F.arrays_zip(*[F.transform(F.regexp_extract_all(text, pattern, F.lit(i)), F.trim).alias(n) for i, n in ((1, "pkg"), (2, "role"), (3, "client"))])
