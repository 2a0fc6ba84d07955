"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed byte 4-grams are counted: one over the trusted documents (a bounded, hash-chosen
sample of the labelled good ones), one over the whole corpus. A document's score is the mean over its n-grams of
log p_target - log p_raw, so that length does not matter; a fixed threshold decides on every document. Counting
emits one small table for each task (2**bits rows at most), summed by bucket; only that table reaches the driver.

Edge cases: null or empty text has no words and no n-grams (score 0.0) and fails the base rules; texts under four
bytes score 0.0; without trusted documents all scores are 0.0 and the base rules decide alone; repeated rows are
scored one by one; extra columns are ignored by the query and kept by `keep_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import WordHashes, bounded_ids, is_train_row, lean, text_bytes, window_hashes

BITS = 16  # buckets of the hashed n-grams: 2**BITS rows are the most that the driver sees
TRUSTED = 20_000  # most labelled rows that form the target
THRESHOLD = -0.5  # mean log-likelihood ratio per n-gram below which a document goes
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CHUNK = 1 << 22  # n-grams that are worked on at once


def gram_buckets(text: bytes, bits: int = BITS) -> np.ndarray:
    """Bucket of each byte 4-gram."""
    a = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    if len(a) < 4:
        return np.zeros(0, np.uint32)
    g = a[:-3] | (a[1:-2] << 8) | (a[2:-1] << 16) | (a[3:] << 24)
    return (g * np.uint32(2654435761)) >> np.uint32(32 - bits)


def base_figures(text: bytes | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    s = text.decode("utf-8", "replace")
    chars = len(s) - sum(map(s.count, SPACES))
    symbols = sum(text.count(x) for x in SYMBOLS)
    dup = 0
    if b"\n" in text:
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
    n, repeats = len(words), 0
    if n > 3:
        w = window_hashes(hashes.of(words), 3)
        order = np.argsort(w)
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(n, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = twice.copy()
            covered[1:] |= twice[:-1]
            covered[2:] |= twice[:-2]
            repeats = int(covered.sum())
    return n, chars, symbols, dup, repeats


def gram_counts(docs: DataFrame, trusted_ids: DataFrame, bits: int = BITS) -> DataFrame:
    """bucket, raw, target: n-gram counts over the whole corpus and over its trusted documents.

    trusted_ids (doc_id) must be bounded, as it is broadcast."""
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted_ids.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left"
    )

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((2, 1 << bits), dtype=np.int64)
        held: list[list[np.ndarray]] = [[], []]

        def fold(k: int) -> None:
            if held[k]:
                total[k] += np.bincount(np.concatenate(held[k]), minlength=1 << bits)
                held[k].clear()

        size = [0, 0]
        for batch in batches:
            for text, good in zip(text_bytes(batch["text"]), batch["trusted"].to_pylist(), strict=True):
                for at in range(0, len(text or b""), CHUNK):
                    g = gram_buckets(text[at : at + CHUNK + 3], bits)
                    for k in (0, 1) if good else (0,):
                        held[k].append(g)
                        size[k] += len(g)
                        if size[k] >= CHUNK:
                            fold(k)
                            size[k] = 0
        fold(0), fold(1)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])

    partial = flagged.select("text", "trusted").mapInArrow(lean(count), "bucket long, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_ratio(docs: DataFrame, labels: DataFrame, bits: int = BITS, trusted: int = TRUSTED) -> np.ndarray:
    """log p_target - log p_raw for each bucket (float32, 2**bits values)."""
    good = labels.where((F.col("quality") == 1) & is_train_row(F.col("doc_id")))
    counts = gram_counts(docs, bounded_ids(good, "doc_id", trusted), bits).toPandas()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(1 << bits, dtype=np.float32)
    smooth = lambda x: np.log((x + 0.5) / (x.sum() + 0.5 * len(x)))
    return (smooth(target) - smooth(raw)).astype(np.float32)


def score_quality(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept for every row."""

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            rows, llrs = [], []
            for text in text_bytes(batch["text"]):
                rows.append(base_figures(text, hashes))
                total = n = 0
                for at in range(0, len(text or b""), CHUNK):
                    g = gram_buckets(text[at : at + CHUNK + 3], bits)
                    total, n = total + float(ratio[g].sum(dtype=np.float64)), n + len(g)
                llrs.append(round(total / n, 6) if n else 0.0)
            a = np.array(rows, dtype=np.int64).reshape(-1, 5)
            failed = (a[:, 0] < MIN_WORDS) | (100 * a[:, 4] > MAX_REPEAT_PERCENT * a[:, 0])
            llr = np.array(llrs, dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(a[:, i]) for i in range(5)), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"],
            )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(score), schema)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The documents that the rules keep, all columns as they were."""
    ratio = fit_ratio(docs, labels, bits)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            mask = []
            for text in text_bytes(batch["text"]):
                n, _, _, _, repeats = base_figures(text, hashes)
                ok = n >= MIN_WORDS and 100 * repeats <= MAX_REPEAT_PERCENT * n
                if ok:
                    total = grams = 0
                    for at in range(0, len(text), CHUNK):
                        g = gram_buckets(text[at : at + CHUNK + 3], bits)
                        total, grams = total + float(ratio[g].sum(dtype=np.float64)), grams + len(g)
                    ok = round(total / grams, 6) >= threshold if grams else threshold <= 0
                mask.append(ok)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, fit_ratio(docs, labels))
