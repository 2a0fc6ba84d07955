"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Pieces are dealt at random to parts of bounded size. In each part best-fit decreasing opens some number of bins, and
dual feasible functions give a number that no packing can go below. A part whose two numbers agree is certified: it
cannot be packed better. The others give up the pieces of their bins that have gaps; those are dealt anew among fewer
parts, mixed, and packed again, for a few rounds or until one part holds them all. Only counts reach the driver.

Edge cases: null and empty texts are the separator alone (one piece of one token); a document of exactly the
capacity is not cut; equal lengths are taken in the order of id, piece and content, so ties give the same packing at
every run; repeated rows are packed each; rows without doc_id are packed with a null id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import RunMemory, cut, gathered, kept_in_process, lean, text_bytes, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 0
REMEMBERED = 300_000  # runs whose ids a worker keeps
PART_PIECES = 30_000  # pieces that are packed in one task
ROUNDS = 3
WORD_END = "</w>"  # the ending of a word's last token in the vocabulary
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # letters of ASCII and Latin-1, which no normalisation joins or parts
ENCODED_AT_ONCE = 4096  # runs that the tokenizer is given at once; what it returns for a run is large
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkIds:
    """Token ids of texts by a tokenizer that drops white space and case: runs between ASCII white space are encoded once.

    White space ends every word of the vocabulary, so ids of a text are those of its runs, one after another. So does
    a comma or full stop after a letter; a run that ends in one has the ids of the rest and of the mark. Runs of plain
    letters are one word each, and the last token of a word carries the vocabulary's ending, so many of them are encoded
    as one text and told apart by their endings. Special tokens are told by case, so only texts without their beginning are lower-cased as a whole."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)
        self.marks = {m: self._encode([m])[0] for m in (b",", b".")}
        self.memory = RunMemory(self._learn, remembered // 6, remembered)

    def _encode(self, runs: list[bytes]) -> list[list[int]]:
        """Ids of each run by itself."""
        out: list[list[int]] = []
        for at in range(0, len(runs), ENCODED_AT_ONCE):
            some = [r.decode("utf-8", "replace") for r in runs[at : at + ENCODED_AT_ONCE]]
            out += [e.ids for e in self.encode_batch(some, add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters, one after another, and how many each has."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), ENCODED_AT_ONCE):
            some = words[at : at + ENCODED_AT_ONCE]
            ids = np.array(self.encode_batch([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and int(ends[-1]) == len(ids):
                flat.append(ids)
                lengths.append(np.diff(ends, prepend=0))
            else:  # another vocabulary may end words in another way
                each = self._encode(some)
                flat.append(np.fromiter(chain.from_iterable(each), dtype=np.uint32))
                lengths.append(np.fromiter(map(len, each), dtype=np.int64, count=len(each)))
        return np.concatenate(flat), np.concatenate(lengths)

    def _learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lower = [w if b"<|" in w else w.lower() for w in fresh]
        marked = [len(w) > 1 and w[-1:] in self.marks and w[-2:-1].isalpha() for w in lower]
        cores = [w[:-1] if m else w for w, m in zip(lower, marked, strict=True)]
        number: dict[bytes, int] = {}
        core_of = np.fromiter((number.setdefault(c, len(number)) for c in cores), dtype=np.int64, count=len(cores))
        distinct = list(number)
        plain = np.fromiter((PLAIN.fullmatch(c) is not None for c in distinct), dtype=bool, count=len(distinct))
        flat, some = self._encode_words([c for c, p in zip(distinct, plain.tolist(), strict=True) if p])
        odd = self._encode([c for c, p in zip(distinct, plain.tolist(), strict=True) if not p])
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(odd), dtype=np.uint32), *[np.array(ids, dtype=np.uint32) for ids in self.marks.values()]])
        lengths = np.zeros(len(distinct), np.int64)
        lengths[plain], lengths[~plain] = some, np.fromiter(map(len, odd), dtype=np.int64, count=len(odd))
        starts = np.zeros(len(distinct), np.int64)
        starts[plain] = np.cumsum(some) - some
        starts[~plain] = int(some.sum()) + np.cumsum(lengths[~plain]) - lengths[~plain]
        # a run is its core and, if it has one, its mark: two slices of flat
        behind, mark_start, mark_length = int(lengths.sum()), {}, {}
        for m, ids in self.marks.items():
            mark_start[m], mark_length[m], behind = behind, len(ids), behind + len(ids)
        marks = [w[-1:] if m else b"" for w, m in zip(lower, marked, strict=True)]
        start, length = np.zeros(2 * len(fresh), np.int64), np.zeros(2 * len(fresh), np.int64)
        start[::2], length[::2] = starts[core_of], lengths[core_of]
        start[1::2] = [mark_start.get(m, 0) for m in marks]
        length[1::2] = [mark_length.get(m, 0) for m in marks]
        return gathered(flat, start, length), length[::2] + length[1::2]

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        cuts = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        return [self.memory.ids(n) for n in self.memory.numbers(cuts)]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a separator, cut only where it exceeds capacity.

    remembered: runs whose ids a worker keeps; more take memory (100 MB for a million) and save time."""
    path = path or tokenizer_path(VOCABULARY)

    def cut_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = kept_in_process(("chunk ids", path, remembered), lambda: ChunkIds(path, remembered))
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), text_bytes(batch["text"])
            rows: list[tuple] = []
            at = 0
            while at < len(texts):  # a few MB of text at once
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or b"") <= 4 << 20):
                    size += len(texts[end] or b"")
                    end += 1
                for doc_id, tokens in zip(ids[at:end], encode(texts[at:end]), strict=True):
                    raw = np.append(tokens, np.uint32(separator)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        rows.append((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                at = end
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut_up, keeps=True), PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. lengths must not increase."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free, opened = 0, 0  # free: bit c is set if some bin has c free
    for i, n in enumerate(lengths.tolist()):
        fits = free >> n
        if fits:
            c = n + (fits & -fits).bit_length() - 1
            b = room[c].pop()
            if not room[c]:
                free ^= 1 << c
        else:
            b, c = opened, capacity
            opened += 1
        bins[i], offsets[i] = b, capacity - c
        if c > n:
            room[c - n].append(b)
            free |= 1 << (c - n)
    return bins, offsets, opened


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins that any packing needs, by dual feasible functions.

    f_t sends lengths over capacity - t to a whole bin, those under t to nothing, others to themselves; u_k rounds
    (k + 1) * length / capacity down to multiples of 1/k unless it is whole. Each maps any set that fits one bin to
    at most one bin, so the sum of the images, rounded up, is a bound."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    weight, items = np.cumsum(count * x), np.cumsum(count)
    best = -(-int(weight[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        whole = int(items[-1] - items[capacity - t])
        middle = int(weight[capacity - t] - weight[t - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 101):
        p = (k + 1) * x
        image = np.where(p % capacity == 0, x * k, (p // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * image).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id, offset, certified (its part's number of bins is proven to be the least)."""
    keep = pieces.columns
    schema = f"{PIECE}, bin long, offset long, fill long, bins long, bound long, part long"

    def fill(key, table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets, opened = best_fit_decreasing(lengths, capacity)
        full = np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)
        n, bound = len(lengths), lower_bound(lengths, capacity)
        more = {"bin": bins, "offset": offsets, "fill": full[bins], "bins": np.full(n, opened), "bound": np.full(n, bound), "part": np.full(n, key[0].as_py())}
        return pa.table({**{c: table[c] for c in keep}, **{k: pa.array(v, pa.int64()) for k, v in more.items()}})

    rest, done = cut(pieces), None
    for i in range(rounds):
        n = rest.count()
        parts = max(1, -(-n // part_pieces))
        # rest is a written table, so that its row numbers stay as they are when a task runs again
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(i)), F.lit(parts)))
        packed = cut(dealt.groupBy("part").applyInArrow(fill, schema))
        last = i == rounds - 1 or parts == 1
        gaps = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        settled = packed if last else packed.where(~gaps)
        settled = settled.select(
            *keep, ((F.lit(i) * (1 << 40) + F.col("part")) * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")
        )
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rest = packed.where(gaps).select(*keep)
    return done


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    return pack(token_pieces(docs, path, capacity, remembered=remembered), capacity)


def op9_bestfit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), remembered=5 * REMEMBERED)
