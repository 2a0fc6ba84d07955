"""URL filters: rules by host and path, and for all other URLs a ratio of character language models. SQL functions only.

Two Markov models of variable order, one of accepted and one of rejected URLs, are counted over 32 classes of
characters: the distribution behind a context of three characters is mixed with that behind its last two, one and none,
by how many different characters were seen there (Witten and Bell), so a context that was never seen leaves the word
to the shorter one. A URL's score is its log-likelihood difference divided by its characters. The threshold is
calibrated: models are counted on three quarters of the URLs with a verdict (by the MD5 of the URL), and of all multiples
of 1/64 the one that separates the other quarter best (mean of both classes' shares) is taken. Accepted and rejected
URLs are those for which a rule stands. All counts are exact and over all rows.

The model is a table of 32**3 contexts by 32 classes (8 MB) whatever the corpus; it reaches the tasks as one value of a
scalar subquery, so scoring needs no join and no shuffle.

Edge cases: a null URL, or one without `://`, has an empty host and path, no rule and no characters; its score is 0.0.
A rule whose path is `/` does not fit a URL without any path. Without accepted or without rejected URLs all scores are 0.0
(models without counts are equal) and the threshold is 0.0, so what no rule blocks is allowed. URLs are judged row by row: ties, repeated rows and
null ids do not matter; an empty table gives an empty result; other columns are not read. Whole URLs are read, however long.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 32  # classes of characters: none (before the beginning), 26 letters, digit, slash, dot, dash, other
ORDER = 3
OFFSETS = (0, 1, 1 + SYMBOLS, 1 + SYMBOLS + SYMBOLS**2)  # rows of the model's table at which the contexts of each length begin
CONTEXTS = OFFSETS[-1] + SYMBOLS**ORDER
STEPS = 64  # thresholds are multiples of 1 / STEPS
MOST_STEPS = 8 * STEPS  # log-likelihood differences of a character are far below 8


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """Class of each character of what follows `://`, as an array of numbers from 1 to 31; empty if nothing does."""
    rest = F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit("")), UPPER, LOWER)
    kinds = F.translate(F.regexp_replace(rest, r"(?s)[^a-z0-9/._-]", "~"), LOWER + "0123456789/.-_~", UPPER + "[" * 10 + "\\]^^_")
    return F.when(rest == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(kinds, ""), lambda c: F.ascii(c) - 64))


def grams(kinds: Column) -> Column:
    """Each character with the ORDER before it, as one number below 2**20; the beginning counts as characters of class 0."""
    padded = F.concat(F.array_repeat(F.lit(0), ORDER), kinds)
    one = lambda i: reduce(lambda a, k: a * SYMBOLS + padded[i + k], range(1, ORDER + 1), padded[i])
    return F.when(F.size(kinds) > 0, F.transform(F.sequence(F.lit(0), F.size(kinds) - 1), one)).otherwise(F.array().cast("array<int>"))


def fit_models(labelled: DataFrame) -> DataFrame:
    """One row with `model`: for each context of three characters an array of log p_accepted - log p_rejected of the 32 classes.

    labelled has kinds (as from symbols) and accepted (boolean)."""
    seen = labelled.select("accepted", F.explode(grams(F.col("kinds"))).alias("gram")).groupBy("gram")
    seen = seen.agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    context = [F.lit(OFFSETS[k]) + F.pmod(F.shiftright("gram", 5), F.lit(SYMBOLS**k)) for k in range(ORDER + 1)]
    each = seen.select(F.explode(F.array(*context)).alias("context"), F.pmod("gram", F.lit(SYMBOLS)).alias("symbol"), "a", "r")
    each = each.groupBy("context", "symbol").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    counts = each.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("a", "r")))).alias("n"))  # at most SYMBOLS entries
    row = lambda field: F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS - 1)), lambda s: F.coalesce(F.col("n")[s][field], F.lit(0)).cast("double"))
    counts = counts.select("context", row("a").alias("a"), row("r").alias("r"))

    def mixed(own: str, shorter: Column) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda t, x: t + x)
        kinds = F.aggregate(own, F.lit(0.0), lambda t, x: t + F.when(x > 0, 1.0).otherwise(0.0))
        return F.when(n > 0, F.zip_with(own, shorter, lambda x, p: (x + kinds * p) / (n + kinds))).otherwise(shorter)  # also for unseen contexts

    spark, level = labelled.sparkSession, None
    for k in range(ORDER + 1):  # every context of k characters, from those of k - 1
        places = spark.range(SYMBOLS**k).select(F.col("id").cast("int").alias("place"))
        own = places.join(F.broadcast(counts.select((F.col("context") - OFFSETS[k]).alias("place"), "a", "r")), "place", "left")  # at most CONTEXTS rows
        if level is None:  # the one context without characters is mixed with the uniform distribution
            own = own.select("*", *[F.array_repeat(F.lit(1.0 / SYMBOLS), SYMBOLS).alias(c) for c in ("sa", "sr")])
        else:
            shorter = level.select(F.col("place").alias("parent"), F.col("pa").alias("sa"), F.col("pr").alias("sr"))  # SYMBOLS**(k - 1) rows
            own = own.withColumn("parent", F.pmod("place", F.lit(SYMBOLS ** (k - 1)))).join(F.broadcast(shorter), "parent")
        level = own.select("place", mixed("a", F.col("sa")).alias("pa"), mixed("r", F.col("sr")).alias("pr"))
    ratios = level.select("place", F.zip_with("pa", "pr", lambda a, r: F.ln(a) - F.ln(r)).alias("ratio"))
    return ratios.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ratio"))), lambda x: x["ratio"]).alias("model"))  # SYMBOLS**ORDER entries


def with_score(df: DataFrame, model: DataFrame) -> DataFrame:
    """df with score: the mean over the characters (kinds) of the log-likelihood difference.

    The model is named once, so that the optimizer puts the subquery's value in its place and no row carries it."""

    def step(acc: Column, c: Column) -> Column:
        context = F.pmod(acc["context"] * SYMBOLS + c, F.lit(SYMBOLS**ORDER))
        return F.struct(context.alias("context"), (acc["total"] + F.get(F.get("__model", acc["context"]), c)).alias("total"))

    total = F.aggregate("kinds", F.struct(F.lit(0).alias("context"), F.lit(0.0).alias("total")), step, lambda acc: acc["total"])
    score = F.coalesce(F.round(F.try_divide(total, F.size("kinds")), 9), F.lit(0.0))
    return df.select("*", model.scalar().alias("__model")).select(*df.columns, score.alias("score"))


def fit_threshold(scored: DataFrame) -> DataFrame:
    """One row with `threshold`: the multiple of 1 / STEPS that accepts most of the accepted and fewest of the others; ties: the nearest to 0.

    scored has score and accepted."""
    step = F.greatest(F.lit(-MOST_STEPS), F.least(F.lit(MOST_STEPS), F.floor(F.col("score") * STEPS)))
    found = scored.groupBy(step.alias("step")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    whole = found.agg(F.sort_array(F.collect_list(F.struct("step", "a", "r"))).alias("h"), F.sum("a").alias("na"), F.sum("r").alias("nr"))  # 2 * MOST_STEPS + 1 entries
    share = lambda t: F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.when(x["step"] >= t, x["a"] / F.col("na")).otherwise(x["r"] / F.col("nr")))
    tried = whole.where("na > 0 and nr > 0").select("h", "na", "nr", F.explode(F.sequence(F.lit(-MOST_STEPS), F.lit(MOST_STEPS))).alias("t"))
    best = tried.agg(F.max_by(F.col("t"), F.struct(F.round(share(F.col("t")), 9), -F.abs("t"), "t")).alias("t"))
    return best.select((F.coalesce("t", F.lit(0)) / STEPS).alias("threshold"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) of every row of pages."""
    url = F.col("url")
    host, path = host_and_path(url)
    ruled = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    labelled = ruled.where("found is not null").select(symbols(url).alias("kinds"), (F.col("found.verdict") == "allow").alias("accepted"), F.substring(F.md5(url.cast("binary")), 1, 1).isin("0", "4", "8", "c").alias("held"))
    model = fit_models(labelled.where("not held").select("kinds", "accepted"))
    threshold = fit_threshold(with_score(labelled.where("held").select("kinds", "accepted"), model))
    others = F.when(F.col("found").isNull(), symbols(url)).otherwise(F.array().cast("array<int>"))
    judged = with_score(ruled.select("page_id", "host", "path", "found", others.alias("kinds")), model)
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= threshold.scalar(), "allow").otherwise("block"))
    score = F.when(F.col("found").isNull(), F.round("score", 6))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))


def op13_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    """The same in DuckDB: rows of characters in place of arrays."""
    rules = sorted(RULES, key=lambda r: -len(r.text))
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in rules]
    pick = lambda value: "CASE " + " ".join(f"WHEN {f} THEN '{value(r)}'" for f, r in zip(fits, rules, strict=True)) + " END"
    context = lambda k: f"{OFFSETS[k]} + ((g >> 5) % {SYMBOLS**k})"
    ctes = [
        f"u AS MATERIALIZED (SELECT row_number() OVER () AS n, page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)",
        f"f AS MATERIALIZED (SELECT *, {pick(lambda r: r.text)} AS rule, {pick(lambda r: r.verdict)} AS ruled, substr(md5(url), 1, 1) IN ('0', '4', '8', 'c') AS held FROM u)",
        f"s AS MATERIALIZED (SELECT n, i, CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 96 WHEN c BETWEEN '0' AND '9' THEN 27 WHEN c = '/' THEN 28 WHEN c = '.' THEN 29 WHEN c IN ('-', '_') THEN 30 ELSE 31 END AS c FROM (SELECT n, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT n, translate(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '{UPPER}', '{LOWER}') AS t FROM u) a WHERE t <> '') b)",
        f"g AS MATERIALIZED (SELECT n, ((coalesce(lag(c, 3) OVER w, 0) * {SYMBOLS} + coalesce(lag(c, 2) OVER w, 0)) * {SYMBOLS} + coalesce(lag(c) OVER w, 0)) * {SYMBOLS} + c AS g FROM s WINDOW w AS (PARTITION BY n ORDER BY i))",
        f"e AS MATERIALIZED (SELECT x, y, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) AS a, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS r FROM (SELECT unnest([{', '.join(context(k) for k in range(ORDER + 1))}]) AS x, g % {SYMBOLS} AS y, ruled FROM g JOIN f USING (n) WHERE ruled IS NOT NULL AND NOT held) q GROUP BY x, y)",
        "k AS MATERIALIZED (SELECT x, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ka, count(*) FILTER (r > 0) AS kr FROM e GROUP BY x)",
        f"m0 AS MATERIALIZED (SELECT k.x, y, coalesce((coalesce(a, 0) + ka / {SYMBOLS}e0) / nullif(na + ka, 0), 1 / {SYMBOLS}e0) AS pa, coalesce((coalesce(r, 0) + kr / {SYMBOLS}e0) / nullif(nr + kr, 0), 1 / {SYMBOLS}e0) AS pr FROM k CROSS JOIN range({SYMBOLS}) t(y) LEFT JOIN e USING (x, y) WHERE k.x = 0)",
    ]
    for i in range(1, ORDER + 1):
        ctes.append(
            f"m{i} AS MATERIALIZED (SELECT k.x, s.y, coalesce((coalesce(a, 0) + ka * s.pa) / nullif(na + ka, 0), s.pa) AS pa, coalesce((coalesce(r, 0) + kr * s.pr) / nullif(nr + kr, 0), s.pr) AS pr FROM k JOIN m{i - 1} s ON s.x = {OFFSETS[i - 1]} + ((k.x - {OFFSETS[i]}) % {SYMBOLS ** (i - 1)}) LEFT JOIN e ON e.x = k.x AND e.y = s.y WHERE k.x BETWEEN {OFFSETS[i]} AND {OFFSETS[i] + SYMBOLS**i - 1})"
        )
    ctes += [
        "m AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT x, y, ln(pa) - ln(pr) AS d FROM m{i}" for i in range(ORDER + 1)) + ")",
        f"z AS MATERIALIZED (SELECT n, round(sum(coalesce({', '.join(f'd{k}.d' for k in range(ORDER, -1, -1))}, 0)) / count(*), 9) AS score FROM g " + " ".join(f"LEFT JOIN m d{k} ON d{k}.x = {context(k)} AND d{k}.y = g % {SYMBOLS}" for k in range(ORDER + 1)) + " GROUP BY n)",
        "j AS MATERIALIZED (SELECT f.*, coalesce(score, 0) AS score FROM f LEFT JOIN z USING (n))",
        f"b AS (SELECT greatest(-{MOST_STEPS}, least({MOST_STEPS}, floor(score * {STEPS}))) AS step, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS r FROM j WHERE ruled IS NOT NULL AND held GROUP BY 1)",
        f"c AS (SELECT t, round(sum(CASE WHEN step >= t THEN a / na ELSE r / nr END), 9) AS q FROM (SELECT *, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM b) b CROSS JOIN range(-{MOST_STEPS}, {MOST_STEPS + 1}) t(t) WHERE na > 0 AND nr > 0 GROUP BY t)",
        f"h AS (SELECT coalesce((SELECT t FROM c ORDER BY q DESC, abs(t), t DESC LIMIT 1), 0) / {STEPS}e0 AS threshold)",
    ]
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN ruled IS NULL THEN round(score, 6) END AS score FROM j, h"


SQL = _sql()
