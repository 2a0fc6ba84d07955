"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

The vocabulary's pattern cuts texts into words. Each distinct word of a batch becomes rows of token and position,
beginning with its single bytes. A recursive query joins neighbouring tokens with the merge table and contracts, in
every word at once, the leftmost pair of the least rank; a word without a pair in the table is done.

A long word is cut into short pieces, each contracted by the same query, and put together again at its seams. Tokens are
the encoding of a word exactly if every two neighbours are the encoding of their own bytes: a merge across the border of two
tokens, the first one that there is, would also be made where only these two are encoded. So a seam whose two tokens are
theirs is sound; at another, a window of tokens on both sides is contracted anew and widened until its borders are sound.
Where a word repeats one to four bytes over a long stretch, pieces begin with the stretch and hold a power of two of
repetitions, as merges of equal pairs go from left to right.

Words that are in the vocabulary as they are need no query, as in the tiktoken library. Decoding joins ids
with the vocabulary and aggregates the bytes in order of position.

Runs between single blanks that stand before something else than white space are cut once and remembered, since the
pattern always begins a word at such a blank. Both memories and the rows of one query are bounded.

Edge cases: null and empty texts have no ids (n_tokens 0, digests of nothing); nulls among ids, and ids that are not
in the vocabulary, raise an error when decoded; every row is encoded by itself, so ties, repeated rows and other columns do not matter;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import TokenMemory, kept_in_process, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = re.compile(r" (?=\S)")
LOOSE = re.compile(r" (?!\S)")
BATCH_CHARS = 4 << 20  # text that is encoded at once
QUERY_BYTES = 1 << 19  # bytes of words in one query
CACHE = 250_000  # words, and runs, of one of two generations that are remembered
CACHE_BYTES = 10 << 20  # bytes of runs and their ids in one generation

SHORT = 64  # bytes of a word that is contracted whole
PIECE = 96  # bytes of a piece of a longer word
REPEATS = 64  # repetitions in a piece of a stretch that repeats itself
WINDOW = 4  # tokens on each side of a seam that are contracted anew, at first
CONTRACT = """
WITH RECURSIVE t(k, tok, live) AS (
    SELECT k, tok, true FROM start
  UNION ALL
    SELECT k, tok, live
    FROM (
        WITH r AS MATERIALIZED (
            SELECT k, tok, CASE WHEN lead(k) OVER w >> 32 = k >> 32 THEN lead(tok) OVER w END AS nxt, CASE WHEN lag(k) OVER w >> 32 = k >> 32 THEN lag(k) OVER w END AS prev
            FROM t WHERE live WINDOW w AS (ORDER BY k)
        ), b AS (
            SELECT k >> 32 AS word, min(m.rank::BIGINT * 4294967296 + (k & 4294967295)) AS best FROM r JOIN merges m ON r.tok::BIGINT * 65536 + r.nxt = m.pair GROUP BY ALL
        )
        SELECT r.k, CASE WHEN r.k & 4294967295 = b.best & 4294967295 THEN (b.best >> 32)::INT ELSE r.tok END AS tok, b.best IS NOT NULL AS live
        FROM r LEFT JOIN b ON r.k >> 32 = b.word
        WHERE b.best IS NULL OR r.prev & 4294967295 IS DISTINCT FROM b.best & 4294967295
    )
)
SELECT k >> 32 AS word, list(tok ORDER BY k) AS ids FROM t WHERE NOT live GROUP BY ALL ORDER BY word
"""  # k: the word's number and the token's position in one number, so that one sort serves all words

DECODE = """
SELECT doc, string_agg(v.chars, '' ORDER BY pos) AS chars, count(*) AS n
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM docs_ids) d JOIN vocabulary v USING (id)
GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder over one in-memory DuckDB connection."""

    def __init__(self, path: str, pattern: str = PATTERN, decoding: bool = False):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": "", "preserve_insertion_order": False})
        merges = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    merges.append((a, b, rank))
        a, b, rank = (np.array(x, dtype=np.int32) for x in zip(*merges, strict=True))
        self._table("merges", pa.table({"pair": a.astype(np.int64) * 65536 + b, "rank": rank}))
        chars = ["".join(chr(256 + x) for x in t) for t in self.ranks]
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "chars": chars}))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.sound: dict[tuple[int, int], bool] = {}  # pairs of tokens at seams
        self.words = TokenMemory(self._contract, CACHE, CACHE_BYTES)  # ids of words, and with decoding their bytes
        self.memory = TokenMemory(self._learn, CACHE, CACHE_BYTES)  # ids of runs, and with decoding their bytes
        self.decoding = decoding

    def _table(self, name: str, table) -> None:
        self.db.register("given", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes] | None]:
        """Ids of words; where it is wanted, also the bytes that those ids decode to."""
        out: list[bytes] = [b""] * len(words)  # little-endian unsigned 32-bit integers
        short: list[tuple[int, bytes]] = []
        long: list[tuple[int, bytes]] = []
        for i, w in enumerate(words):
            raw = w.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                (long if len(raw) > SHORT else short).append((i, raw))
        self._run(short, out)
        for (i, _), ids in zip(long, self._put_together([raw for _, raw in long]), strict=True):
            out[i] = np.array(ids, dtype="<u4").tobytes()
        flat, lengths = np.frombuffer(b"".join(out), dtype="<u4"), np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4
        return flat, lengths, self._decode(flat, lengths.tolist()) if self.decoding and words else [] if self.decoding else None

    def _pieces(self, raw: bytes) -> list[bytes]:
        """A long word, cut into pieces."""
        a = np.frombuffer(raw, dtype=np.uint8)
        step, starts = np.full(len(a), PIECE), {0}
        for period in (4, 3, 2, 1):  # the shortest period of a stretch counts
            same = np.concatenate([[False], a[period:] == a[:-period], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            for lo, hi in zip(edges[::2].tolist(), (edges[1::2] + period).tolist(), strict=True):
                if hi - lo >= 4 * period * REPEATS:
                    step[lo:hi] = period * REPEATS
                    starts |= {lo, hi}
        out = []
        for lo, hi in pairwise([*sorted(s for s in starts if s < len(a)), len(a)]):
            width = int(step[lo])
            out += [raw[at : min(hi, at + width)] for at in range(lo, hi, width)]
        return out

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of byte strings, contracted whole, equal ones once."""
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        out: list[bytes] = [b""] * len(number)
        self._run([(i, w) for w, i in number.items()], out)
        found = [np.frombuffer(x, dtype="<u4").tolist() for x in out]
        return [found[number[w]] for w in words]

    def _check(self, pairs: list[tuple[int, int]]) -> None:
        """Find out which pairs of tokens are the encoding of their bytes."""
        if len(self.sound) > CACHE:
            self.sound.clear()
        new = [p for p in dict.fromkeys(pairs) if p not in self.sound]
        for p, ids in zip(new, self._ids([self.tokens[a] + self.tokens[b] for a, b in new]), strict=True):
            self.sound[p] = ids == list(p)

    def _put_together(self, words: list[bytes]) -> list[list[int]]:
        """Ids of long words."""
        cuts = [self._pieces(w) for w in words]
        ids = iter(self._ids([p for c in cuts for p in c]))
        parts = [[next(ids) for _ in c] for c in cuts]
        self._check([(a[-1], b[0]) for ps in parts for a, b in pairwise(ps)])
        for i, ps in enumerate(parts):
            joined: list[list[int]] = []
            for p in ps:
                if joined and self.sound.get((joined[-1][-1], p[0])):
                    joined[-1] += p
                else:
                    joined.append(list(p))
            parts[i] = joined
        while seams := [(i, k) for i, ps in enumerate(parts) for k in range(0, len(ps) - 1, 2)]:
            done = self._mend([(parts[i][k], parts[i][k + 1]) for i, k in seams])
            for (i, k), ids in zip(seams, done, strict=True):
                parts[i][k], parts[i][k + 1] = ids, []
            parts = [[p for p in ps if p] for ps in parts]
        return [ps[0] for ps in parts]

    def _mend(self, seams: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """Each two encodings as that of their bytes together."""
        out: list[list[int]] = [[] for _ in seams]
        todo, width = list(range(len(seams))), WINDOW
        while todo:
            windows = [(seams[i][0][-width:], seams[i][1][:width]) for i in todo]
            middles = self._ids([b"".join(map(self.tokens.__getitem__, a + b)) for a, b in windows])
            borders = []
            for i, middle in zip(todo, middles, strict=True):
                a, b = seams[i]
                borders.append([*([(a[-width - 1], middle[0])] if len(a) > width else []), *([(middle[-1], b[width])] if len(b) > width else [])])
            self._check([p for ps in borders for p in ps])
            again = []
            for i, middle, ps in zip(todo, middles, borders, strict=True):
                if all(self.sound[p] for p in ps):
                    a, b = seams[i]
                    out[i] = a[: max(0, len(a) - width)] + middle + b[width:]
                else:
                    again.append(i)
            todo, width = again, 2 * width
        return out

    def _run(self, todo: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Contract byte strings by the recursive query; their ids as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        at = 0
        while at < len(todo):
            end, size = at, 0
            while end < len(todo) and (end == at or size + len(todo[end][1]) <= QUERY_BYTES):
                size += len(todo[end][1])
                end += 1
            some = [raw for _, raw in todo[at:end]]
            lengths = np.array([len(x) for x in some])
            ends = np.cumsum(lengths)
            word = np.repeat(np.arange(len(some), dtype=np.int32), lengths)
            pos = (np.arange(size) - np.repeat(ends - lengths, lengths) + 1).astype(np.int32)
            self.db.register("start", pa.table({"k": word.astype(np.int64) << 32 | pos, "tok": self.byte_ids[np.frombuffer(b"".join(some), dtype=np.uint8)]}))
            ids = self.db.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
            self.db.unregister("start")
            flat, cuts = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            for (i, _), lo, hi in zip(todo[at:end], cuts[:-1], cuts[1:], strict=True):
                out[i] = flat[lo:hi]
            at = end

    def _split(self, runs: list[str | tuple[str]]) -> tuple[list[str], np.ndarray]:
        """The words of runs, one after another, and how many of them come before each run's beginning and the last one's end."""
        find = self.pattern.findall
        firsts = [i for i, r in enumerate(runs) if not isinstance(r, str)]
        words: list[str] = []
        for lo, hi in zip([0, *firsts], [*firsts, len(runs)], strict=True):  # a text's first run and runs with their blanks are a text again
            if lo < hi:
                head = " " + runs[lo] if isinstance(runs[lo], str) else runs[lo][0]
                words += find(" ".join([head, *runs[lo + 1 : hi]]))
        ends = np.cumsum(np.fromiter((len(r) + 1 if isinstance(r, str) else len(r[0]) for r in runs), dtype=np.int64, count=len(runs)))
        word_ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        bounds = np.concatenate([[0], np.searchsorted(word_ends, ends, side="right")])
        if len(runs) and np.array_equal(np.concatenate([[0], word_ends])[bounds[1:]], ends):
            return words, bounds
        split = [find(" " + r if isinstance(r, str) else r[0]) for r in runs]  # another pattern may leave characters out
        return [w for s in split for w in s], np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))])

    def _learn(self, fresh: list[str | tuple[str]]) -> tuple[np.ndarray, np.ndarray, list[bytes] | None]:
        """Ids of runs; where it is wanted, also the bytes that those ids decode to."""
        words, bounds = self._split(fresh)
        numbers = self.words.numbers([words])[0]
        offsets = self.words.young.offsets
        edges = np.concatenate([[0], np.cumsum(offsets[numbers + 1] - offsets[numbers])])
        notes = None
        if self.decoding:
            parts = [self.words.young.notes[i] for i in numbers.tolist()]
            cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))])[bounds].tolist()
            raw = b"".join(parts)
            notes = [raw[lo:hi] for lo, hi in pairwise(cuts)]
        return self.words.ids(numbers), np.diff(edges[bounds]), notes

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text as numbers of runs in the memory."""
        cuts: list[list] = []
        for t in texts:
            # a plain split does the same where no blank stands before white space or the end
            c = [] if not t else BLANK.split(t) if LOOSE.search(t) else t.split(" ")
            if c:
                c[0] = (c[0],)  # the one run that no blank leads; others are kept without their blank
            cuts.append(c)
        return self.memory.numbers(cuts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        return [self.memory.ids(n) for n in self.numbers(texts)]

    def encode_and_decode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each text and the bytes that they decode to; the ids of a run are decoded once and remembered."""
        for n in self.numbers(texts):
            yield self.memory.ids(n), b"".join(map(self.memory.young.notes.__getitem__, n.tolist()))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        return self._decode(np.concatenate(ids) if ids else np.zeros(0, np.int32), [len(x) for x in ids])

    def _decode(self, flat: np.ndarray, lengths: list[int]) -> list[bytes]:
        import pyarrow as pa

        out = [b""] * len(lengths)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat.astype(np.int32)))
        self.db.register("docs_ids", pa.table({"doc": np.arange(len(lengths)), "ids": lists}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("docs_ids")
        docs = found["doc"].to_numpy()
        if not np.array_equal(np.flatnonzero(lengths), docs) or not np.array_equal(found["n"].to_numpy(), np.array(lengths)[docs]):
            raise ValueError("an id is not in the vocabulary")
        # each byte is the character 256 above it: two bytes of UTF-8, the lower half of two bytes of UTF-16
        chars = found["chars"].cast(pa.large_string()).combine_chunks() if len(docs) else pa.array([], pa.large_string())
        cuts = np.frombuffer(chars.buffers()[1], dtype=np.int64, count=len(chars) + 1, offset=8 * chars.offset) if len(docs) else np.zeros(1, np.int64)
        raw = chars.buffers()[2][int(cuts[0]) : int(cuts[-1])].to_pybytes().decode().encode("utf-16-le")[::2] if len(docs) else b""
        at = ((cuts - cuts[0]) // 2).tolist()
        for i, doc in enumerate(docs.tolist()):
            out[doc] = raw[at[i] : at[i + 1]]
        return out


def small_batches(batches: Iterator, column: str, most: int) -> Iterator:
    """Batches whose column holds about most characters or list items."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        size = pc.fill_null(pc.binary_length(batch[column]) if column == "text" else pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // most
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def encode_bpe(docs: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids (array<long>) of every whole text."""
    path = path or tokenizer_path(VOCABULARY)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = kept_in_process(("bpe", path, pattern), lambda: Bpe(path, pattern))
        for batch in small_batches(batches, "text", BATCH_CHARS):
            ids = [pa.array(x, pa.int64()) for x in bpe.encode(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids array<long>")


def decode_bpe(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, bytes (binary) of rows of doc_id and ids."""
    path = path or tokenizer_path(VOCABULARY)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = kept_in_process(("bpe", path, PATTERN), lambda: Bpe(path))
        for batch in small_batches(batches, "ids", BATCH_CHARS // 4):
            ids = [np.array(x if x is not None else [], dtype=np.int64) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bpe.decode(ids), pa.binary())], ["doc_id", "bytes"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both operators in one pass, without moving ids between processes."""
    path = path or tokenizer_path(VOCABULARY)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = kept_in_process(("bpe both ways", path, pattern), lambda: Bpe(path, pattern, decoding=True))
        for batch in small_batches(batches, "text", BATCH_CHARS):
            n, digests, decoded = [], [], []
            for ids, raw in bpe.encode_and_decode(batch["text"].to_pylist()):
                n.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
