"""Scalar functions of the fact domain as Column expressions; all stay in the JVM but for ``nfkc``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Rupee units, date patterns, number words, short forms of names, states.
UNITS = {"crore": 10_000_000, "cr": 10_000_000, "lakh": 100_000, "lac": 100_000, "mn": 1_000_000, "million": 1_000_000}
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}


STATE_INITIALS = [(r"\bU\.?\s?P\.?\b", "uttar pradesh"), (r"\bM\.?\s?P\.?\b", "madhya pradesh"), (r"\bW\.?\s?B\.?\b", "west bengal"), (r"\bT\.?\s?N\.?\b", "tamil nadu")]
SPACED_FORMS = {"p ?w ?d": "pwd", "ut pr": "uttar pradesh"}
SHORT_FORMS = {
    "pwd": "public works department", "pw": "public works department",
    "phe": "public health engineering department", "phed": "public health engineering department",
    "pheg": "public health engineering department", "phedg": "public health engineering department",
    "irr": "irrigation", "infra": "infrastructure", "corp": "corporation", "ltd": "limited", "auth": "authority", "muni": "municipal",
    "neda": "national expressway development authority",
    "mah": "maharashtra", "guj": "gujarat", "raj": "rajasthan", "jhd": "jharkhand", "jhkd": "jharkhand",
}
STATES = [
    "uttar pradesh", "madhya pradesh", "west bengal", "tamil nadu", "maharashtra", "gujarat", "rajasthan", "jharkhand", "odisha", "delhi",
    "andhra pradesh", "assam", "bihar", "chhattisgarh", "goa", "haryana", "himachal pradesh", "karnataka", "kerala", "manipur", "meghalaya",
    "mizoram", "nagaland", "punjab", "sikkim", "telangana", "tripura", "uttarakhand", "arunachal pradesh", "jammu and kashmir", "ladakh",
    "puducherry", "chandigarh",
]
MONTH = r"[A-Za-z]{3,9}"


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group of the first match; null, not '', where there is none."""
    found = F.array(F.trim(F.regexp_extract(text, pattern, n)))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))  # nullif would search twice


def first(text: Column, patterns: list[str], n: int = 1) -> Column:
    """First non-blank match over alternatives, case-insensitive."""
    return F.coalesce(*[group(text, f"(?i){p}", n) for p in patterns])


def squeeze(text: Column) -> Column:
    return F.trim(_one_blank(text, "\n\t\r\x0b\f"))


def _one_blank(text: Column, marks: str) -> Column:
    """``marks`` to blanks and runs of blanks to one; a text without runs, by far the most frequent, meets no expression."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    one = lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    return F.get(F.transform(F.array(text), one), F.lit(0))


def flat(text: Column) -> Column:
    """Line feeds to blanks, runs of blanks and tabs to one; form feeds stay."""
    return F.trim(_one_blank(text, "\n\t"))


@F.pandas_udf(StringType())
def nfkc(s):
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def parse_inr(text: Column) -> Column:
    """First amount in rupees: an optional INR/Rs sign, digits with commas, an optional unit."""
    number = F.regexp_replace(group(text, r"(\d[\d,]*(?:\.\d+)?)"), ",", "").try_cast("decimal(28,10)")
    unit = F.lower(group(text, r"(?i)\d[\d,]*(?:\.\d+)?\s*(crores?|cr|lakhs?|lacs?|mn|million)\b"))
    known = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    factor = F.coalesce(F.try_element_at(known, F.regexp_replace(unit, "s$", "")), F.lit(1))
    return F.round(number * factor, 2).cast("decimal(18,2)")


def parse_date(text: Column) -> Column:
    found = first(text, [r"(\d{4}-\d{2}-\d{2})", r"(\d{1,2}/\d{1,2}/\d{4})", r"(\d{1,2} [a-z]{3,9} \d{4})", r"([a-z]{3,9} \d{1,2}, \d{4})"])
    return F.get(F.transform(F.array(found), _date_of), F.lit(0))


def _date_of(found: Column) -> Column:
    """The shape of a date tells its one format: a failed attempt at another costs more than all the rest."""
    date = lambda text, form: F.try_to_timestamp(text, F.lit(form)).cast("date")
    padded = F.regexp_replace(F.regexp_replace(found, r"^(\d)/", "0$1/"), r"/(\d)/", "/0$1/")
    short = found.rlike(r"(?i)(?:^|\s)[a-z]{3}\s")
    iso, slashes, day, day_full, month_full, month = DATE_FORMATS
    out = F.when(found.rlike(r"^\d+-"), date(found, iso)).when(found.rlike(r"^\d+/"), date(padded, slashes))
    out = out.when(found.rlike(r"^\d"), F.when(short, date(found, day)).otherwise(date(found, day_full)))
    return out.when(found.isNotNull(), F.when(short, date(found, month)).otherwise(date(found, month_full)))


def norm_client(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), r"[.']", "")
    for short, full in (("govt", "government"), ("dept", "department"), ("corpn?", "corporation"), ("ltd", "limited")):
        out = F.regexp_replace(out, rf"\b{short}\b", full)
    return squeeze(F.regexp_replace(out, "[^a-z0-9]+", " "))


def norm_person(name: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(name, "[^A-Za-z]+", " ")))


def package_of(text: Column) -> Column:
    return group(text, r"(?i)pkg[-\s]*(\d+)").try_cast("bigint")


def norm_question(text: Column) -> Column:
    """Words of a question or a name: initials of states (capitals only) and short forms written out, lower case, a-z and 0-9."""
    out = F.regexp_replace(text, "[\u2018\u2019]", "'")
    for short, full in STATE_INITIALS:
        out = F.regexp_replace(out, short, f" {full} ")
    out = F.regexp_replace(F.lower(out), "&", " and ")
    out = squeeze(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for spaced, whole in SPACED_FORMS.items():
        out = F.regexp_replace(out, rf"\b{spaced}\b", whole)
    known = F.create_map(*[F.lit(x) for form in SHORT_FORMS.items() for x in form])
    return F.array_join(F.transform(F.split(out, " "), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def mask_once(text: Column, words: Column) -> Column:
    """``text`` without the first occurrence of each of ``words`` (of a-z and 0-9)."""
    return F.aggregate(words, text, lambda acc, w: F.regexp_replace(acc, F.concat(F.lit(r"^(.*?)\b"), w, F.lit(r"\b")), F.lit("$1 ")))


def blank_once(text: Column, words: Column) -> Column:
    """``text`` with the first occurrence of each of ``words`` (of a-z and 0-9) written as lines of its length, so that places stay."""
    return F.aggregate(words, text, lambda acc, w: F.regexp_replace(acc, F.concat(F.lit(r"^(.*?)\b"), w, F.lit(r"\b")), F.concat(F.lit("$1"), F.repeat(F.lit("_"), F.length(w)))))


def words_to_number(text: Column) -> Column:
    """Number words up to hundreds; null if any word is unknown, or if "hundred" has no number before it."""
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[-\s]+", " "), " "), lambda w: ~w.isin("", "and"))
    value = F.aggregate(words, F.lit(0), lambda acc, w: F.when((w == "hundred") & (acc > 0), acc * 100).otherwise(acc + F.element_at(table, w)))
    return F.when(F.size(words) > 0, value)


def norm_amount(text: Column) -> Column:
    """Question text for amounts: lower case, no commas, points and dashes kept, digits apart from letters ("70cr")."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), ",", ""), "&", " and ")
    return squeeze(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9. -]+", " "), r"(\d)\s*([a-z])", "$1 $2"))


def find_amount(text: Column) -> Column:
    """A threshold in crore or lakh, in digits or number words; crore first; an amount of zero is none.

    Words are read from each unit back: of the four before it (and "and"s) the longest run that is a number. A text is normalised once, and one
    without a unit meets no other expression.
    """

    def before(text: Column, unit: str) -> Column:
        """Of each unit, in order, the words and digits before it."""
        found = F.regexp_extract_all(text, F.lit(rf"((?:[a-z0-9.]+[ -]+){{0,6}}?[a-z0-9.]+)[ -]+(?:{unit})\b"), F.lit(1))
        return F.when(text.rlike(rf"[ -](?:{unit})\b"), found)

    def number(piece: Column) -> Column:
        words = F.split(piece, "[ -]+")
        digits = F.regexp_extract(piece, r"([0-9.]+)$", 1).try_cast("decimal(18,4)")
        tail = lambda n: words_to_number(F.array_join(F.slice(words, -F.least(F.lit(n), F.size(words)), F.lit(n)), " "))
        return F.coalesce(digits, *[tail(n).cast("decimal(18,4)") for n in (6, 5, 4, 3, 2, 1)])

    def at(text: Column, unit: str, by: int) -> Column:
        found = F.transform(before(text, unit), number)
        return F.get(F.filter(found, lambda x: x > 0), F.lit(0)) * by

    amount = lambda t: F.coalesce(at(t, "crores?|cr", UNITS["crore"]), at(t, "lakhs?|lacs?", UNITS["lakh"])).cast("decimal(18,2)")
    return F.get(F.transform(F.array(norm_amount(text)), amount), F.lit(0))


def years_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(199\d|20[0-2]\d)\b")), lambda y: y.cast("int"))))


def category_pattern(label: Column) -> Column:
    """Regular expression of a label that tolerates 'and' between its words."""
    return F.concat(F.lit(r"\b"), F.regexp_replace(label, r"\s+(and\s+)?", r"\\s+(?:and\\s+)?"), F.lit(r"\b"))


def coerce(value: Column, answer_type: Column) -> Column:
    """Answer text: percent with 2 decimals, else a whole number, halves away from zero."""
    exact = value.cast("decimal(38,10)")
    return F.when(answer_type == "percent", F.round(exact, 2).cast("decimal(20,2)").cast("string")).otherwise(F.round(exact, 0).cast("decimal(28,0)").cast("string"))


def within(got: Column, want: Column, answer_type: Column) -> Column:
    gap = F.abs(got - want)
    return F.when(answer_type == "money", gap <= F.greatest(F.lit(1.0), F.abs(want) * 0.005)).when(answer_type == "percent", gap <= 0.05).otherwise(gap == 0)
