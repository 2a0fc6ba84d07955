"""Long words of the byte-level vocabulary, and the packed memory of runs."""

import os
import random
import time

import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F

from causeway.llm import bpe, common, packing
from causeway.llm.common import RunMemory


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    path = tokenizers.path(bpe.VOCABULARY)
    return bpe.Bpe(path), tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_very_long_words_end_soon(coders):
    """One word each, of up to two million characters, within DuckDB's bounded memory."""
    coder, plain = coders
    rng = random.Random(5)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(100_000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), "ab" * 30_000, "-" + "=" * 30_001 + "+", "哈" * 20_000]
    began = time.time()
    for text in texts:
        assert coder.encode([text])[0].tolist() == plain.encode_ordinary(text)
    assert len(coder.encode(["=" * 2_000_000])[0]) == 2_000_000 // 64 and len(coder.encode(["a" * 1_000_001])[0]) == 250_001
    assert time.time() - began < 120


def test_seams_of_odd_words(coders):
    """Stretches that repeat, begin anywhere and end anywhere, next to irregular letters."""
    coder, plain = coders
    rng = random.Random(6)
    alphabets = ("ab", "abc", "etaoinshr", "=-", "aé日", "ABCdef", "étà", "01", "กาน", "哈")
    texts = ["".join(rng.choice(a) * rng.choice([1, 1, 1, 2, 3, 40, 300]) for _ in range(rng.randint(20, 60))) for a in alphabets for _ in range(6)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == plain.encode_ordinary(text)


def test_pieces_make_up_the_word():
    for raw in (b"x" * 5000, b"-" + b"=" * 700 + b"abcabcabc" * 90, bytes(range(256)) * 9, "日本".encode() * 800):
        assert b"".join(bpe.Bpe._pieces(None, raw)) == raw


def test_memory_of_runs_keeps_what_comes_again():
    asked = []

    def learn(runs):
        asked.extend(runs)
        return np.array([b for r in runs for b in r], dtype=np.uint32), np.array([len(r) for r in runs], dtype=np.int64)

    memory = RunMemory(learn, most=100, most_packed=1000)
    often = [b"often%d" % i for i in range(20)]
    for at in range(0, 30_000, 150):
        runs = [*often, *(b"%x" % i for i in range(at, at + 150)), b""]
        (numbers,) = memory.numbers([runs])
        assert memory.ids(numbers).tolist() == [b for r in runs for b in r]
        assert len(memory.index) <= 100 + 171 and len(memory.digests) <= 1000 + 271
    assert asked.count(b"often3") == 1 and sorted(asked[:171]) == sorted({*often, *(b"%x" % i for i in range(150)), b""})


@pytest.mark.parametrize("remembered", [60, 300_000])
def test_runs_have_the_ids_of_whole_texts(remembered):
    from tokenizers import Tokenizer

    path = tokenizers.path(packing.VOCABULARY)
    rng = random.Random(7)
    letters = ["abcdefghij", "ABCxyz", "éàüßñçœÉÀÇØ÷×ÿ", "0123456789", "'st.,;:!?-", "漢字", "İıſﬁ", "é"]
    word = lambda: "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 12)))
    texts = [rng.choice([" ", "\n", "\t\x0b", " "]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "<|endoftext|> Abc<|startoftext|>", "don't, can't. 12.5,"]
    encode, plain = packing.ChunkIds(path, remembered), Tokenizer.from_file(path)
    for at in range(0, len(texts), 40):
        for text, ids in zip(texts[at : at + 40], encode([t.encode() for t in texts[at : at + 40]]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert encode([None])[0].tolist() == [] and os.environ["TOKENIZERS_PARALLELISM"] == "false"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_of_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    keys = [0] * 40 + [1] * 6 + [2] * 5 + [3] + [None] * 9
    left = spark.createDataFrame(list(enumerate(keys)), "i long, key long").repartition(4)
    right = left.where("key is not null and key <> 3").groupBy("key").agg(F.count("*").alias("n"))
    got = common.join_counted(left, right, "key", "n", len(keys), how)
    want = left.join(right, "key", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
