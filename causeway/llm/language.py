"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A trigram of letters binds its letters' vectors, each rotated by
its place, with an elementwise product; a document bundles (sums) the vectors of its trigrams; a language prototype
bundles the unit vectors of its documents. A document has the language whose prototype is nearest by cosine.

Words are separated by one boundary letter; letters beyond a to z share hashed classes, so any script has vectors.
Learning sums prototypes in each task and then over tasks: a table of languages times DIMENSIONS reaches the driver.

Edge cases: null text, and text without letters, is `und` with score 0; so is every text when nothing could be
learned; rows with a null lang are not learned from; equal cosines go to the language that is first in alphabetical
order; repeated rows each count; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import is_train_row

DIMENSIONS = 1024
CLASSES = 64  # letter classes, 0 being the boundary between words
SEED = 20240101
BATCH_DOCS, BATCH_CHARS = 64, 1 << 21
UNKNOWN = "und"


def letter_classes() -> np.ndarray:
    """The class of each code point of the basic plane; 0 for what is no letter."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 % 2**32 >> 16) % (CLASSES - 27)
    return out


class Profiles:
    """Document vectors of batches of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.classes = letter_classes()
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(CLASSES, dimensions))
        self.places = [np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters]
        self.column = np.zeros(CLASSES**3, dtype=np.int64)
        self.dimensions = dimensions

    def trigrams(self, text: str | None) -> np.ndarray:
        """Codes of the trigrams of letter classes; none if there is no letter."""
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        x = self.classes[np.where(c < 1 << 16, c, 0)] if not len(c) or int(c.max()) < 1 << 16 else self._any_plane(c)
        if not x.any():
            return np.zeros(0, dtype=np.int64)
        x = np.concatenate([[0], x, [0]]).astype(np.int64)
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        return (x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:]

    def _any_plane(self, c: np.ndarray) -> np.ndarray:
        high = c >= 1 << 16
        x = self.classes[np.where(high, 0, c)]
        x[high] = [27 + int(v) % (CLASSES - 27) if chr(int(v)).isalpha() else 0 for v in c[high]]
        return x

    def __call__(self, grams: list[np.ndarray]) -> np.ndarray:
        """One float32 row for each list of trigram codes."""
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.int64)
        if not len(flat):
            return np.zeros((len(grams), self.dimensions), dtype=np.float32)
        seen = np.zeros(CLASSES**3, dtype=bool)
        seen[flat] = True
        codes = np.flatnonzero(seen)
        self.column[codes] = np.arange(len(codes))
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        counts = np.bincount(owner * len(codes) + self.column[flat], minlength=len(grams) * len(codes))
        counts = counts.reshape(len(grams), len(codes)).astype(np.float32)
        a, b, c = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
        out = np.zeros((len(grams), self.dimensions), dtype=np.float32)
        for at in range(0, len(codes), 4096):
            s = slice(at, at + 4096)
            out += counts[:, s] @ (self.places[0][a[s]] * self.places[1][b[s]] * self.places[2][c[s]]).astype(np.float32)
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def vectors(texts: Iterator[str | None], profiles: Profiles) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(unit vectors, whether each text has a letter), over groups of texts of bounded size, in order."""
    held, size = [], 0
    for text in texts:
        held.append(profiles.trigrams(text))
        size += len(held[-1])
        if len(held) >= BATCH_DOCS or size >= BATCH_CHARS:
            yield unit(profiles(held)), np.array([len(g) > 0 for g in held])
            held, size = [], 0
    if held:
        yield unit(profiles(held)), np.array([len(g) > 0 for g in held])


def learn_languages(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and their prototypes (unit rows), from the rows that may be learned from."""

    def bundle(batches: Iterator) -> Iterator:
        import pyarrow as pa

        profiles, sums = Profiles(dimensions, seed), {}
        for batch in batches:
            langs, at = batch["lang"].to_pylist(), 0
            for rows, real in vectors(batch["text"].to_pylist(), profiles):
                some = np.array(langs[at : at + len(rows)], dtype=object)
                at += len(rows)
                for lang in set(some[real]):
                    sums[lang] = sums.get(lang, 0) + rows[real & (some == lang)].sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    rows = docs.where(is_train_row(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(bundle, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    langs = sorted(sums["lang"].unique())
    out = np.zeros((len(langs), dimensions), dtype=np.float32)
    out[sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), sums["dim"].to_numpy(dtype=np.int64)] = sums["value"]
    return langs, unit(out)


def identify_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest prototype, 0 at least) of every row."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        profiles = Profiles(prototypes.shape[1], seed)
        for batch in batches:
            found: list[str] = []
            scores: list[float] = []
            for rows, real in vectors(batch["text"].to_pylist(), profiles):
                if not langs:
                    real = real & False
                    cosines = np.zeros((len(rows), 1))
                else:
                    cosines = (rows @ prototypes.T).astype(np.float64)
                best = cosines.argmax(axis=1)
                found += [langs[b] if r else UNKNOWN for b, r in zip(best, real, strict=True)]
                scores += np.where(real, np.clip(cosines.max(axis=1), 0, 1), 0.0).round(6).tolist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compare, "doc_id long, lang_pred string, score double")


def op6_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs, *learn_languages(docs))
    return found.select("doc_id", (~is_train_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
