r"""Personal data: patterns propose spans, checksums confirm them, context adjusts their score. SQL functions only.

The texts between matches (split) and the matches (regexp_extract_all) of one pattern alternate, so the running sum of
their lengths gives every match its place in code points. Running sums are taken in two levels, so a text with very
many matches stays affordable. Patterns are anchored so that a run of characters is walked once: a match may begin at
the start of a run or where the last match ended (\G), which is where the leftmost match begins anyway, and runs are
possessive. A pattern is applied only where a cheap test finds a character that it needs.

Kinds: email; ip (parts at most 255); card (16 to 19 digits, Luhn); phone (8 to 15 digits); and by the method iban
(mod 97 on the country's length) and ssn (three, two and four digits, only near words that speak of one). A span's
score starts at its kind's value and rises with a context word among the 40 characters before it. Words that a kind
requires may also stand among the 40 characters behind, and count for a whole list: numbers hang together if at most
40 characters without the end of a clause, or only separators, part them. An IBAN's search consumes only its first
four characters, so a false beginning does not hide a true one behind it.

Edge cases: null and empty texts have no spans (empty strings, SHA-256 of nothing, counts 0); texts are searched
whole; rows are searched one by one, so ties, repeated rows, null ids and other columns do not matter; an empty table
gives an empty result. Overlapping spans of different kinds are all given.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
STEP = 256  # matches in the lower level of the running sums


#: Characters of an IBAN by country (those of the registry, and those that countries outside it use).
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_ONE = "|".join(r"(?:%s)[0-9]{2}(?:\x20?[A-Z0-9]){%d}" % (c.replace(" ", "|"), n - 4) for n, c in IBAN_CHARS.items())
IBAN_HEAD = 4
CLAUSE_END = r"[;\n]|[.!?]\s"
SEPARATORS = r"(?i)^(?:[\s,;:/&|()-]|and|or)*$"


class Kind(NamedTuple):
    name: str
    pattern: str
    needs: str  # a pattern that every text with a match contains
    score: float
    context: str  # words that raise the score
    required: bool = False  # whether only spans with context count
    group: int = 0  # the group that is the span; if not 0, the pattern consumes IBAN_HEAD characters of it


#: Patterns, context words and scores of the kinds, in the order of their spans.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write to"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.7, "card|visa|master|credit|debit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|mobile|fax|contact"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=((?:{IBAN_ONE})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}", r"[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank|transfer", group=1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.2, "ssn|social security", True),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def add(total: Column, place: Column) -> Column:
        d = F.substring(F.reverse(number), place, F.lit(1)).cast("int")
        return total + F.when(place % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether letters (10 to 35) and digits, the first four at the end, leave 1 when divided by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = c >= "A"
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def is_valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(x, "[.]"), part)
    if kind == "card":
        return F.length(digits(x)).between(16, 19) & luhn(digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(8, 15)
    return mod97(x) if kind == "iban" else F.lit(True)


def running(lengths: Column) -> Column:
    """Sums of an array of integers up to and with each element, in two levels."""
    add = lambda a, b: a + b
    total = lambda start, n: F.aggregate(F.slice(lengths, start, n), F.lit(0).cast("long"), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda k: total(F.lit(1), k * STEP))
    sums = lambda b: F.transform(lengths, lambda _, i: F.element_at(b, F.floor(i / STEP).cast("int") + 1) + total(F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1))
    return F.element_at(F.transform(F.array(blocks), sums), 1)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, found: an array of (kind, start, end, score), kinds in their order, then by start."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    none = F.array().cast("array<string>")
    for k in KINDS:
        needed = F.contains("text", F.lit(k.needs)) if k.needs == "@" else F.rlike("text", F.lit(k.needs))
        out = out.withColumn(f"{k.name}_match", F.when(needed, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group))).otherwise(none))
    for k in KINDS:
        out = out.withColumn(f"{k.name}_between", F.when(F.size(f"{k.name}_match") > 0, F.split("text", k.pattern, -1)).otherwise(none))
    out = out.drop("text")
    return out.select("doc_id", F.concat(*map(kept_spans, KINDS)).alias("found"))


def in_context(match: Column, between: Column, context: str) -> Column:
    """For each match whether a context word stands near it, or near one of the list of matches that it is in."""

    def mark(_: Column, i: Column) -> Column:
        before, after = F.element_at(between, i + 1), F.element_at(between, i + 2)
        word = lambda x: F.rlike(F.lower(x), F.lit(context))
        near = word(F.right(before, F.lit(CONTEXT_CHARS))) | word(F.left(after, F.lit(CONTEXT_CHARS)))
        close = (F.length(before) <= CONTEXT_CHARS) & (~F.rlike(before, F.lit(CLAUSE_END)) | F.rlike(F.left(before, F.lit(CONTEXT_CHARS + 1)), F.lit(SEPARATORS)))
        return F.concat(F.when((i > 0) & close, "").otherwise("|"), F.when(near, "x").otherwise("o"))

    lists = F.split(F.array_join(F.transform(match, mark), ""), "[|]")
    spread = F.transform(lists, lambda run: F.when(F.contains(run, F.lit("x")), F.translate(run, "o", "x")).otherwise(run))
    return F.transform(F.filter(F.split(F.array_join(spread, ""), ""), lambda c: c != ""), lambda c: c == "x")


def kept_spans(k: Kind) -> Column:
    """The valid spans of one kind, from its columns of matches and of texts between them."""
    match, between = F.col(f"{k.name}_match"), F.col(f"{k.name}_between")
    taken = lambda x: F.lit(IBAN_HEAD) if k.group else F.length(x)
    # the text before match i and what the pattern took, so that the i-th running sum is where that ends
    steps = F.transform(match, lambda x, i: (taken(x) + F.length(F.element_at(between, i + 1))).cast("long"))

    def judged(x: Column, i: Column) -> Column:
        near = F.rlike(F.lower(F.right(F.element_at(between, i + 1), F.lit(CONTEXT_CHARS))), F.lit(k.context))
        score = F.lit(k.score) + F.when(F.lit(True) if k.required else near, 0.3).otherwise(0.0)
        return F.struct(F.length(x).alias("n"), taken(x).alias("taken"), F.least(score, F.lit(1.0)).alias("score"), is_valid(k.name, x).alias("valid"))

    columns = [F.transform(match, judged).alias("p"), running(steps).alias("end")]
    if k.required:
        columns.append(in_context(match, between, k.context).alias("near"))
    valid = F.filter(F.arrays_zip(*columns), lambda z: z["p"]["valid"] & z["near"] if k.required else z["p"]["valid"])

    def span(z: Column) -> Column:
        start = z["end"] - z["p"]["taken"]
        return F.struct(F.lit(k.name), start.cast("long"), (start + z["p"]["n"]).cast("long"), z["p"]["score"])

    return F.when(F.size(match) > 0, F.transform(valid, span).cast(SPAN)).otherwise(F.array().cast(SPAN))


def op3_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    sure = F.size(F.filter("found", lambda s: s["score"] >= 0.9)).cast("long").alias("n_confident")
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), sure)
