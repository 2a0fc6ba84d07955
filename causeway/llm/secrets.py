"""Secret scans: fixed patterns, and random strings told by how badly a tokenizer's vocabulary fits them.

Text that people write takes few tokens for its characters; keys and tokens take many. Runs of key characters are
encoded with a public byte-level vocabulary, and those with few characters per token are secrets, unless they are
known digests (hexadecimal of the usual lengths, with or without an algorithm's name before them), UUIDs, or plain
identifiers, numbers, words or web addresses. Runs of every length are tested, so embedded base64 data counts as
random too. Where a fixed pattern covers only part of a run, the whole run is tested, and then what is left of it.

Edge cases: null and empty texts have no spans (empty strings, the SHA-256 of nothing); texts of any length are
scanned whole; every row is scanned by itself, so ties, repeated rows and other columns do not matter; an empty
table gives an empty result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import lean, tokenizer_path

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
CHARS_PER_TOKEN = 1.9  # below this a run counts as random
LEAST = 20  # characters of a run that is tested; there is no upper bound
PIECE = 512  # characters that are encoded at once; tokens of the pieces of a longer run are summed

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# '=' ends a run, as padding or before a value, and a run may follow it directly (KEY=value, ?sig=value)
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?" % LEAST)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_]?)?(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def is_identifier(run: str) -> bool:
    """Known digests, UUIDs, numbers, and names: words or parts of a path joined by _, - or /, or in camel case."""
    if UUID.fullmatch(run) or run.strip("0123456789_-/+=") == "":
        return True
    if DIGEST.fullmatch(run):
        body = re.sub(r"^(md5|sha\d+)[-_]?", "", run)
        if len(body) in DIGEST_LENGTHS:
            return True
    kinds = sum(bool(re.search(p, run)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    if kinds < 2:
        return True  # one alphabet alone: a long word, a heading
    parts = [p for p in re.split(r"[_/=+-]+", run) if p]
    return all(re.fullmatch(r"[a-z]+|[A-Z]+|[A-Z][a-z]+|\d+|(?:[A-Z]?[a-z]{2,}+)++\d{0,4}", p) for p in parts)


class TokenRatio:
    """Characters per token of runs, under a vocabulary of byte-level ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ratio", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, run: str) -> float:
        tokens = sum(len(self.encoding.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))
        return len(run) / max(1, tokens)


def joined(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of spans in order, overlapping ones as one."""
    out = []
    for _, start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def random_spans(text: str, ratio: TokenRatio, least: float, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, characters per token) of random runs.

    taken holds the fixed patterns' spans, in order. A run that they cover, or all but names in it, is left to them;
    one that they cover in part is given whole if it is random, else what is left of it is tested part by part."""
    out, covers, at = [], joined(taken), 0
    for m in RUN.finditer(text):
        start, end = m.span()
        if is_identifier(m[0]):
            continue
        while at < len(covers) and covers[at][1] <= start:
            at += 1
        left, near, begin = [], at, start
        while near < len(covers) and covers[near][0] < end:
            left.append((begin, covers[near][0]))
            begin = covers[near][1]
            near += 1
        left = [(a, b) for a, b in [*left, (begin, end)] if a < b]
        if near > at and all(is_identifier(text[a:b]) for a, b in left):
            continue
        if (r := ratio(m[0])) < least:
            out.append(("random", start, end, r))
        elif near > at:
            parts = [(a, b, ratio(text[a:b])) for a, b in left if b - a >= LEAST and not is_identifier(text[a:b])]
            out += [("random", a, b, r) for a, b, r in parts if r < least]
    return out


def written(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def scan_secrets(docs: DataFrame, path: str | None = None, least: float = CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, base and found (arrays of kind, start, end, ratio), in order; ratio is null for fixed patterns."""
    path = path or tokenizer_path(VOCABULARY)
    span = "array<struct<kind:string,start:long,end:long,ratio:double>>"

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ratio = TokenRatio(path)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))
        as_row = lambda s: {"kind": s[0], "start": s[1], "end": s[2], "ratio": s[3] if len(s) > 3 else None}
        for batch in batches:
            bases, founds = [], []
            for text in batch["text"].to_pylist():
                base = base_spans(text) if text else []
                more = random_spans(text, ratio, least, base) if text else []
                bases.append([as_row(s) for s in base])
                founds.append([as_row(s) for s in sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bases, kind), pa.array(founds, kind)], ["doc_id", "base", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(scan), f"doc_id long, base {span}, found {span}")


def mask_secrets(docs: DataFrame, path: str | None = None, least: float = CHARS_PER_TOKEN) -> DataFrame:
    """docs with each secret replaced by <kind>, all columns as they were, n_chars (where there is one) made new.

    No document goes; overlapping spans become one, named after the first."""
    path = path or tokenizer_path(VOCABULARY)
    counted = [f.name for f in docs.schema if f.name == "n_chars"]

    def mask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ratio = TokenRatio(path)
        for batch in batches:
            texts, at = [], batch.schema.get_field_index("text")
            for text in batch["text"].to_pylist():
                if text:
                    base = base_spans(text)
                    spans = sorted([*base, *random_spans(text, ratio, least, base)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                    parts, done = [], 0
                    for kind, start, end, *_ in spans:
                        if start >= done:
                            parts += [text[done:start], f"<{kind}>"]
                        done = max(done, end)
                    text = "".join([*parts, text[done:]]) if spans else text
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            for name in counted:
                i = batch.schema.get_field_index(name)
                columns[i] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(mask), docs.schema)


def op8_secret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.expr(f"array_join(transform({c}, s -> concat(s.kind, ':', s.start, ':', s.`end`)), ',')")
    n = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS[:3]), F.sha2(text("base"), 256).alias("base_sha256"), text("found").alias("spans"))
