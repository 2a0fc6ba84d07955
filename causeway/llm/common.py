"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import sys
import tempfile
import types
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a local session that names none (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: its lineage ends there and no executor owns the only copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def is_train_row(doc_id) -> "F.Column":
    """Rows that models may learn from: crc32 of the id as text, modulo 4, is not 2. Null ids are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def bounded_ids(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most bound ids, those of the smallest hashes: the same ids at every run, whatever the partitioning."""
    ids = df.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(bound)


HOT_ROWS = 1_000  # rows of a key, above which it may count as hot
MOST_HOT = 100_000  # more keys than these are never hot


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined to right (inner or left), where right has one row for each key and, in n, how often left has it.

    A key is hot if it has more than HOT_ROWS and more than one in MOST_HOT of all rows, so there are MOST_HOT hot keys at
    most. Their rows of right are broadcast and those of left stay where they are; only the others are shuffled by key,
    and neither rows of a hot key nor those without a key meet in one task. left is read once for each of these parts
    and should be a written table; rows is the number of its rows, or more."""
    least = max(HOT_ROWS, rows // MOST_HOT)
    hot = right.where(F.col(n) > least)
    out = left.join(F.broadcast(hot), key)
    others = left.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti")
    out = out.unionByName(others.join(right.where(F.col(n) <= least), key, how))
    return out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class WordHashes(dict):
    """bytes -> 64-bit hash, computed once for each word. Forgets everything at the given numbers of words and bytes of words."""

    def __init__(self, most: int = 200_000, most_bytes: int = 8 << 20):
        super().__init__()
        self.most, self.most_bytes, self.size = most, most_bytes, 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word)
        if len(self) >= self.most or self.size > self.most_bytes:
            self.clear()
            self.size = len(word)
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


class _Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, key) -> int:
        i = self[key] = len(self)
        return i


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of flat that start and length name, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


class _Generation:
    def __init__(self):
        self.index, self.size, self.notes = _Numbers(), 0, []
        self.flat, self.offsets = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)


class TokenMemory:
    """Token ids of strings (runs of text), each learned once and kept packed, not as objects.

    learn takes a list of keys and returns their ids in one array, the number of ids of each, and a note for each key
    (or None). Two generations are held: when the younger has more than most keys or most_bytes bytes of keys and ids it
    becomes the older one, and what the older one alone held is forgotten. So what lasts from batch to batch is bounded
    by about twice the two numbers, and the frequent keys stay."""

    def __init__(self, learn, most: int = 150_000, most_bytes: int = 6 << 20):
        self.learn, self.most, self.most_bytes = learn, most, most_bytes
        self.young, self.old = _Generation(), _Generation()

    def numbers(self, cuts: list[list]) -> list[np.ndarray]:
        """The number of each key, list by list; they hold until the next call."""
        if len(self.young.index) > self.most or self.young.size > self.most_bytes:
            self.old, self.young = self.young, _Generation()
        young = self.young
        known, number = len(young.offsets) - 1, young.index.__getitem__
        out = [np.fromiter(map(number, keys), dtype=np.int64, count=len(keys)) for keys in cuts]
        if len(young.index) > known:
            self._add(list(islice(young.index, known, None)))
        return out

    def _add(self, fresh: list) -> None:
        young, old = self.young, self.old
        at = [old.index.get(k, -1) for k in fresh]
        flat, lengths, notes = self.learn([k for k, i in zip(fresh, at, strict=True) if i < 0])
        at = np.array(at, dtype=np.int64)
        new = at < 0
        start, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[~new], length[~new] = old.offsets[at[~new]], old.offsets[at[~new] + 1] - old.offsets[at[~new]]
        length[new] = lengths
        start[new] = len(old.flat) + np.cumsum(lengths) - lengths
        young.flat = np.concatenate([young.flat, gathered(np.concatenate([old.flat, flat.astype(np.uint32)]), start, length)])
        young.offsets = np.concatenate([young.offsets, young.offsets[-1] + np.cumsum(length)])
        if notes is not None:
            new_notes = iter(notes)
            young.notes += [next(new_notes) if i < 0 else old.notes[i] for i in at.tolist()]
        young.size += sum(map(len, fresh)) + 4 * int(length.sum())

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the keys of these numbers, one after another."""
        offsets = self.young.offsets
        return gathered(self.young.flat, offsets[numbers], offsets[numbers + 1] - offsets[numbers])


class RunMemory:
    """Token ids of runs of text (bytes), each learned once while it is remembered, in a bounded number of bytes.

    What is in use is a dictionary of at most about most runs. When it is full, its runs move to a packed store: sorted
    128-bit digests, and ids one after another, some 35 bytes a run. The store keeps most_packed runs; beyond, those that
    were not asked for again since they came are forgotten, so rare runs do not push out frequent ones. learn takes a list of
    runs and returns their ids in one array and the number of ids of each."""

    def __init__(self, learn, most: int = 80_000, most_packed: int = 300_000):
        self.learn, self.most, self.most_packed = learn, most, most_packed
        self._clear()
        self.digests, self.starts, self.flat = np.zeros((0, 2), U64), np.zeros(1, np.int64), np.zeros(0, np.uint32)  # the store
        self.again = np.zeros(0, bool)

    def _clear(self) -> None:
        self.index, self.young_digests = _Numbers(), []
        self.young_flat, self.young_starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def numbers(self, cuts: list[list[bytes]]) -> list[np.ndarray]:
        """The number of each run, list by list; they hold until the next call."""
        if len(self.index) > self.most:
            self._store()
        known, number = len(self.young_starts) - 1, self.index.__getitem__
        out = [np.fromiter(map(number, keys), dtype=np.int64, count=len(keys)) for keys in cuts]
        if len(self.index) > known:
            self._add(list(islice(self.index, known, None)))
        return out

    def _add(self, fresh: list[bytes]) -> None:
        asked = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, fresh)), dtype="<u8").reshape(-1, 2)
        at = np.searchsorted(self.digests[:, 0], asked[:, 0])
        there = at < len(self.digests)
        there[there] = (self.digests[at[there]] == asked[there]).all(axis=1)
        at = at[there]
        self.again[at] = True
        start, length = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        start[there], length[there] = self.starts[at], self.starts[at + 1] - self.starts[at]
        flat, lengths = self.learn([k for k, seen in zip(fresh, there.tolist(), strict=True) if not seen])
        length[~there] = lengths
        start[~there] = len(self.flat) + np.cumsum(lengths) - lengths
        ids = gathered(np.concatenate([self.flat, flat.astype(np.uint32)]), start, length)
        self.young_flat = np.concatenate([self.young_flat, ids])
        self.young_starts = np.concatenate([self.young_starts, self.young_starts[-1] + np.cumsum(length)])
        self.young_digests.append(asked)

    def _store(self) -> None:
        """Move the runs in use to the store."""
        digests = np.concatenate([self.digests, *self.young_digests])
        lengths = np.concatenate([np.diff(self.starts), np.diff(self.young_starts)])
        starts = np.concatenate([self.starts[:-1], len(self.flat) + self.young_starts[:-1]])
        again = np.concatenate([self.again, np.zeros(len(digests) - len(self.again), bool)])
        flat = np.concatenate([self.flat, self.young_flat])
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        digests = digests[order]
        first = np.ones(len(order), bool)
        first[1:] = (digests[1:] != digests[:-1]).any(axis=1)
        kept = again[order] | np.concatenate([~first[1:], [False]])  # a run of both places was asked for again
        order, digests, kept = order[first], digests[first], kept[first]
        if len(order) > self.most_packed:
            if kept.sum() > self.most_packed // 2:
                kept &= np.arange(len(kept)) % 2 == 0  # digests are random, so this is any half
            order, digests, kept = order[kept], digests[kept], np.zeros(int(kept.sum()), bool)
        self.digests, self.again = digests, kept
        self.flat = gathered(flat, starts[order], lengths[order])
        self.starts = np.concatenate([[0], np.cumsum(lengths[order])])
        self._clear()

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the runs of these numbers, one after another."""
        return gathered(self.young_flat, self.young_starts[numbers], self.young_starts[numbers + 1] - self.young_starts[numbers])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of k words, in order; the whole sequence as one window if it is shorter; none without words."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k * 0x9E3779B97F4A7C15 % 2**64, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : n - k + 1 + i]) * U64(0x9FB21C651E98DF25)
            out ^= out >> U64(29)
        return mixed(out)


def _kept() -> dict:
    """What this process keeps; it hangs on a module of its own, as this module's names are made anew for each task."""
    return sys.modules.setdefault("causeway_kept_in_process", types.ModuleType("causeway_kept_in_process")).__dict__.setdefault("kept", {})


def kept_in_process(key: tuple, make):
    """An object that a Python worker makes once and keeps for its later tasks (a tokenizer and what it remembers).

    Only the last one asked for is kept, so that a stage's memory does not outlast it where the next stage keeps another
    or is lean. It must bound its own memory."""
    kept = _kept()
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def lean(work, keeps: bool = False):
    """work, a function of batches for mapInArrow, as one that leaves no memory behind in the worker process.

    Worker processes outlive their tasks. At the end, freed memory goes back to the system; at the beginning, unless work
    keeps an object itself, what another stage kept is forgotten."""

    def run(batches):
        if not keeps:
            _kept().clear()
        try:
            yield from work(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def text_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding them."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: $PUBLIC_TOKENIZERS if set, else the installed package."""
    if root := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
