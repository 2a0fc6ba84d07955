"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding lower-cases, turns homoglyphs (Cyrillic, Greek, full width) and digits and signs used as letters into the
letters they imitate, and drops invisible characters. The lexicon is learned from labelled rows. Its terms are whole
words and beginnings of words; what counts of a term is the number of its different words in a document, divided by
the document's length in units of PER_WORDS words (one unit at least), in a few bins. A term's weight in a bin is the
log of the odds of toxic documents there. So a beginning that clean text also has now and then weighs only where it
is dense. Terms are taken by their evidence against chance, one of those that begin alike. Matches inside exception
phrases do not count. The score is the logistic function of the weights' sum and the prior odds; the threshold is 0.3.

Learning uses a bounded, hash-chosen sample of rows of each label; among sampled texts of one label that share their
smallest hash of three words in a row (copies and most near copies) one is kept, so that a document with many copies makes no words toxic.

Edge cases: null and empty texts have the prior score; with no labelled toxic rows the lexicon is empty and every
score is 0; a row without doc_id is never learned from; contradicting labels of one id count as toxic; repeated rows
are scored each; an empty table gives an empty result; lang, source and other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import bounded_ids, cut, is_train_row, lean

SAMPLE = 20_000  # most labelled rows of each label that are learned from
MOST_TERMS = 5_000  # most terms of a lexicon
PREFIXES = (4, 5, 6)  # lengths of beginnings of words
LEAST_SUPPORT = 3
MOST_PRIOR = math.log(1 / 9)  # log odds of a text without terms, at most
LEAST_ODDS = 10.0  # of a term in a bin; below, the bin speaks for nothing
PER_WORDS = 300
BINS = (0.5, 1.5, 2.5, 4.0)  # upper ends; a last bin is open
THRESHOLD = 0.3
#: Phrases in which a word of abuse is none.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown")
#: Characters that imitate Latin letters, and the letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
#: Digits that imitate letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Signs that imitate letters, where they stand before a letter.
SIGNS = {"@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"


class Folding(dict):
    """For str.translate; characters that it does not change are entered when they are met."""

    def __init__(self):
        super().__init__({ord(k): v for k, v in {**HOMOGLYPHS, **DIGITS}.items()} | dict.fromkeys(map(ord, INVISIBLE)))
        self.update({0xFF41 + i: chr(97 + i) for i in range(26)})

    def __missing__(self, c: int) -> int:
        self[c] = c
        return c


WORD = re.compile(r"[^\W\d_]+")
SIGN = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])|(?<![^\s])[@$](?=[^\W\d_])")


def fold(text: str, table: Folding) -> str:
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(table)


def dense(n: int, words: int) -> int:
    """The bin of n different words of a term in a text of so many words."""
    return bisect_left(BINS, n / max(1.0, words / PER_WORDS))


def terms_of(words: list[str]) -> list[tuple[str, int]]:
    """(term, bin) for the words of a text, and for their beginnings, which are written with a star."""
    out: Counter = Counter()
    for w in set(words):
        out[w] += 1
        for n in PREFIXES:
            if len(w) > n:
                out[w[:n] + "*"] += 1
    return [(t, dense(n, len(words))) for t, n in out.items()]


def mark(words: list[str]) -> int:
    """The smallest hash of three words in a row (of all words, if there are fewer): copies share it, and most near copies."""
    windows = set(zip(words, words[1:], words[2:], strict=False)) or {tuple(words)}
    return min(xxhash.xxh3_64_intdigest(" ".join(w).encode("utf-8", "replace")) for w in windows) - 2**63


class Lexicon(NamedTuple):
    weights: dict[str, tuple[float, ...]]  # by term, one for each bin
    prior: float  # log odds of toxic documents, and of a text without terms


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Terms and weights. Term counts are made on the executors; counts of the terms that qualify reach the driver."""
    seen = labels.where(is_train_row(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share_of = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = cut(bounded_ids(seen.where("toxic = 1"), "doc_id", sample).withColumn("toxic", F.lit(1)).unionByName(bounded_ids(seen.where("toxic = 0"), "doc_id", sample).withColumn("toxic", F.lit(0))))

    def signatures(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = Folding()
        for batch in batches:
            marks = [mark(WORD.findall(fold(t, table))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(marks, pa.int64())], ["doc_id", "toxic", "mark"])

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, found = Folding(), (Counter(), Counter())

        def held():
            names = list(found[1] | found[0])
            columns = [pa.array([t for t, _ in names], pa.string()), pa.array([b for _, b in names], pa.int32())]
            columns += [pa.array([found[k][t] for t in names], pa.int64()) for k in (1, 0)]
            out = pa.RecordBatch.from_arrays(columns, ["term", "bin", "toxic", "clean"])
            found[0].clear(), found[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found[toxic].update(terms_of(WORD.findall(fold(text, table))))
                if len(found[0]) + len(found[1]) > 500_000:
                    yield held()
        yield held()

    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    rows = lambda ids: texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    marked = rows(chosen).mapInArrow(lean(signatures), "doc_id long, toxic int, mark long")
    distinct = cut(marked.groupBy("mark", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"))  # 2 * sample ids at most
    of = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = of.get(1, 0), of.get(0, 0)
    if not n1:
        return Lexicon({}, -math.inf)
    partial = rows(distinct).mapInArrow(lean(counts), "term string, bin int, toxic long, clean long")
    summed = cut(partial.groupBy("term", "bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # evidence of a term: how far the share of toxic documents is above what it is over all, in nats, over its bins of high odds
    share = n1 / (n1 + n0)
    odds = ((F.col("toxic") + share) / n1) / ((F.col("clean") + 1 - share + 1e-9) / max(1, n0))
    total = F.col("toxic") + F.col("clean")
    p = F.col("toxic") / total
    nats = total * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share + 1e-9))).otherwise(0.0))
    terms = summed.groupBy("term").agg(F.sum("toxic").alias("n"), F.sum(F.when(odds >= LEAST_ODDS, nats).otherwise(0.0)).alias("evidence")).where(F.col("n") >= LEAST_SUPPORT)
    tested = terms.count()
    best = terms.where(F.col("evidence") >= math.log(20 * max(1, tested))).orderBy(F.desc("evidence"), F.desc(F.length("term")), "term").limit(MOST_TERMS)
    found: dict[str, dict[int, tuple[int, int]]] = {}
    for r in best.join(summed, "term").select("term", "evidence", "bin", "toxic", "clean").collect():  # MOST_TERMS times bins at most
        found.setdefault((-r["evidence"], -len(r["term"]), r["term"]), {})[r["bin"]] = (r["toxic"], r["clean"])
    weights: dict[str, tuple[float, ...]] = {}
    for (_, _, term), bins in sorted(found.items()):
        stem = term.rstrip("*")
        if any(t.rstrip("*").startswith(stem) or (t.endswith("*") and stem.startswith(t[:-1])) for t in weights):
            continue
        one = lambda x: math.log((x[0] + share) / n1) - math.log((x[1] + 1 - share + 1e-9) / max(1, n0))
        seen = {b: one(x) for b, x in bins.items() if sum(x) > 1}
        near = lambda b, seen=seen: min(seen, key=lambda c: (abs(c - b), c)) if seen else None  # noqa: E731  bins without documents are as the next one
        full = [0.0 if near(b) is None else seen[near(b)] for b in range(len(BINS) + 1)]
        weights[term] = tuple(round(w if w >= math.log(LEAST_ODDS) else min(w, 0.0), 6) for w in full)
    # the odds of all labelled rows, not of the sample, whose labels are bounded each; a text without terms is never toxic
    return Lexicon(weights, min(MOST_PRIOR, math.log(share_of[1] / max(1, share_of.get(0, 0)))))


class Matcher:
    """Scores of texts by one automaton of terms and exception phrases."""

    def __init__(self, lexicon: Lexicon, exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.table, self.automaton, self.lexicon = Folding(), ahocorasick.Automaton(), lexicon
        entries: dict[str, list[str | None]] = {}
        for term in lexicon.weights:
            entries.setdefault(term.rstrip("*"), []).append(term)
        for phrase in exceptions if entries else ():
            entries.setdefault(fold(phrase, self.table), []).append(None)
        for text, terms in entries.items():
            self.automaton.add_word(text, (len(text), terms))
        if entries:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of the terms that count; a match ends where its word does."""
        terms, free = [], []
        for last, (n, kinds) in self.automaton.iter(folded):
            start, end = last + 1 - n, last + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end == len(folded) or not folded[end].isalpha()
            for term in kinds:
                if term is None:
                    free += [(start, end)] * whole
                elif term.endswith("*") and not whole:
                    terms.append((start, WORD.match(folded, start).end(), term))
                elif whole and not term.endswith("*"):
                    terms.append((start, end, term))
        return [t for t in terms if not any(a <= t[0] and t[1] <= b for a, b in free)] if free else terms

    def score(self, text: str | None) -> float:
        weights, logit = self.lexicon
        if not weights:
            return 0.0
        if text:
            folded = fold(text, self.table)
            if found := self.matches(folded):
                different = Counter(term for term, _ in {(t, folded[a:b]) for a, b, t in found})
                words = len(WORD.findall(folded))
                logit += sum(weights[t][dense(n, words)] for t, n in different.items())
        return round(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))), 6)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, score of every row."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([matcher.score(t) for t in batch["text"].to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """The documents that score under the threshold, all columns as they were."""
    lexicon = learn_lexicon(docs, labels)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            yield batch.filter(pa.array([matcher.score(t) < threshold for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(work), docs.schema)


def op5_lexicon_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, learn_lexicon(docs, labels))
    return scored.select("doc_id", (~is_train_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
