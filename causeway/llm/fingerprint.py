"""Document fingerprints: a wide hash of the canonical text, verified byte by byte where hashes are equal.

Canonical form: NFKC, case folding, NFKC again, and each run of white space one blank (none at the ends). The
fingerprint is its 128-bit xxhash in hexadecimal. Documents that share a hash are grouped by the canonical bytes
themselves; should a hash stand for several texts, all but the one of the smallest doc_id (texts without ids last) get
the hash and a number, which a text keeps whatever ids its documents have.
Fingerprints are exact, so likeness is 1 (the same canonical text) or 0.

Edge cases: null text is empty; empty and blank texts share one fingerprint; equal texts, repeated rows included,
have equal fingerprints; an empty table gives an empty result; only doc_id and text are read. In the edited text of
a document the next one is by ascending doc_id, null ids first and equal ids in the order of their texts; the last
document takes the first, a lone document itself.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import cut, join_counted

BROADCAST_ROWS = 4_000_000  # ids that are sent to every executor; beyond, a shuffle join
HEX_128 = xxhash.xxh3_128_hexdigest


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def check_of(form: bytes) -> bytes:
    """A second digest, of another construction, that tells texts of one fingerprint apart."""
    return hashlib.blake2b(form, digest_size=16).digest()


def hashes_of(texts: list[str | None], digest: Callable[[bytes], str]) -> tuple[list[str], list[bytes], list[bytes]]:
    """The fingerprints, second digests and canonical bytes of texts."""
    forms = [canonical(t).encode("utf-8", "replace") for t in texts]
    return [digest(f) for f in forms], [check_of(f) for f in forms], forms


def fingerprints(docs: DataFrame, digest: Callable[[bytes], str] = HEX_128) -> DataFrame:
    """doc_id, fingerprint of every row: the hash, made unique to its canonical text."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints, checks, _ = hashes_of(batch["text"].to_pylist(), digest)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.string()), pa.array(checks, pa.binary())], ["doc_id", "fingerprint", "check"])

    ids = docs.select(F.col("doc_id").cast("long"), "text")
    hashed = cut(ids.mapInArrow(work, "doc_id long, fingerprint string, check binary"))
    return with_numbers(hashed, numbers(ids, hashed, digest)).drop("check")


def numbers(docs: DataFrame, hashed: DataFrame, digest: Callable[[bytes], str] = HEX_128) -> DataFrame | None:
    """fingerprint, check, number of the texts whose hash another text, the first, has; None if there are none.

    Only documents in buckets of several, and those without id, are read again; a bucket is grouped by its canonical
    bytes, with equal ones combined before they are shuffled, so neither a bucket nor a group of copies is gathered
    anywhere. A text is told by both its digests, whatever ids its documents have; if two texts share both, that is an error."""
    total = hashed.count()
    buckets = hashed.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    named = hashed.where("doc_id is not null").select("fingerprint", "doc_id")
    shared = cut(join_counted(named, buckets, "fingerprint", "n", total).select("doc_id").distinct())
    n = shared.count()
    if not n and not hashed.where("doc_id is null").limit(1).count():
        return None

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints, checks, forms = hashes_of(batch["text"].to_pylist(), digest)
            columns = [batch["doc_id"], pa.array(prints, pa.string()), pa.array(checks, pa.binary()), pa.array(forms, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "check", "form"])

    read = docs.join(F.broadcast(shared) if n <= BROADCAST_ROWS else shared, "doc_id").unionByName(docs.where("doc_id is null"))
    forms = read.mapInArrow(work, "doc_id long, fingerprint string, check binary, form binary")
    texts = cut(forms.groupBy("fingerprint", "check", "form").agg(F.min("doc_id").alias("first")).drop("form"))
    clashes = texts.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    if not clashes.limit(1).count():
        return None
    if texts.groupBy("fingerprint", "check").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("two canonical texts share both digests")
    order = Window.partitionBy("fingerprint").orderBy(F.asc_nulls_last("first"), "check")
    numbered = texts.join(clashes.drop("n"), "fingerprint").withColumn("number", F.row_number().over(order) - 1).where("number > 0")
    return cut(numbered.select("fingerprint", "check", "number"))


def with_numbers(hashed: DataFrame, numbered: DataFrame | None, edited: str | None = None) -> DataFrame:
    """hashed with the number added to fingerprint, and to the column edited where near_edited says that it is the same text."""
    if numbered is None:
        return hashed
    few = numbered.count() <= BROADCAST_ROWS
    joined = hashed.join(F.broadcast(numbered) if few else numbered, ["fingerprint", "check"], "left")
    full = F.when(F.col("number").isNotNull(), F.concat("fingerprint", F.lit("-"), "number")).otherwise(F.col("fingerprint"))
    changed = {"fingerprint": full} | ({edited: F.when(F.col("near_edited") == 1, full).otherwise(F.col(edited))} if edited else {})
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in hashed.columns])


def edited(text: str, following: str) -> str:
    """text whose last half is replaced by as many of the following text's first characters, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Comparison:
    """What a document, its edited text and the next document have in common."""

    COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "check")
    SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, check binary"

    def __init__(self, digest: Callable[[bytes], str]):
        self.digest = digest

    def __call__(self, text: str, form: str, following: str, next_form: str) -> tuple:
        changed = edited(text, following)
        changed_form = canonical(changed)
        own, other = form.encode("utf-8", "replace"), changed_form.encode("utf-8", "replace")
        sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
        return len(text), sha, self.digest(own), self.digest(other), float(changed_form == form), float(next_form == form), check_of(own)


def compare_with_edited(docs: DataFrame, digest: Callable[[bytes], str] = HEX_128) -> DataFrame:
    """doc_id and Comparison's columns for every row.

    Rows are dealt out by ranges of doc_id and sorted, the one shuffle of the texts. Within a range each document
    sees the next; the last of each range is handed out with its text, as is the first, and the two are joined."""
    schema = f"kind int, doc_id long, {Comparison.SCHEMA}, text string"

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compare, last, begun = Comparison(digest), None, False
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.string()]
        names = ["kind", "doc_id", *Comparison.COLUMNS, "text"]

        def table(rows: list[tuple]):
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        none = (None,) * len(Comparison.COLUMNS)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                form = canonical(text)
                if last is not None:
                    rows.append((0, last[0], *compare(last[1], last[2], text, form), None))
                elif not begun:
                    begun = True
                    rows.append((2, doc_id, *none, text))
                last = (doc_id, text, form)
            yield table(rows)
        if last is not None:
            yield table([(1, last[0], *none, last[1])])

    def close(batches: Iterator) -> Iterator:
        import pyarrow as pa

        compare = Comparison(digest)
        for batch in batches:
            rows = [compare(a, canonical(a), b, canonical(b)) for a, b in zip(batch["text"].to_pylist(), batch["following"].to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(Comparison.COLUMNS)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *Comparison.COLUMNS])

    ids = docs.select(F.col("doc_id").cast("long"), "text")
    seen = cut(ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(work, schema))
    order = Window.orderBy(F.asc_nulls_first("doc_id"))  # over one row for each range
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.row_number().over(order) % F.count("*").over(everything) + 1
    lasts = seen.where("kind = 1").select(F.col("doc_id").alias("id"), after.alias("r"))
    firsts = seen.where("kind = 2").select(F.col("doc_id").alias("next_id"), F.row_number().over(order).alias("r"))
    a, b = seen.where("kind = 1").select("doc_id", "text"), seen.where("kind = 2").select(F.col("doc_id").alias("b_id"), F.col("text").alias("following"))
    ends = lasts.join(firsts, "r").join(a, F.col("id").eqNullSafe(F.col("doc_id"))).join(b, F.col("next_id").eqNullSafe(F.col("b_id")))
    closed = ends.select("doc_id", "text", "following").mapInArrow(close, f"doc_id long, {Comparison.SCHEMA}")
    hashed = seen.where("kind = 0").select("doc_id", *Comparison.COLUMNS).unionByName(closed)
    numbered = numbers(ids, hashed.select("doc_id", "fingerprint", "check"), digest)
    return with_numbers(hashed, numbered, "edited_fingerprint").drop("check")


def op7_canonical_xxhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
