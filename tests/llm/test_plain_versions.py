"""The quality ratio and the secret spans against plain versions."""

import math
import random
import re
import string
import zlib
from collections import Counter

import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from causeway.llm import quality, secrets


def test_quality_ratio(spark):
    rng = random.Random(3)
    rows = [(i % 25, " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 120)))) for i in range(40)] + [(None, "no id here"), (3, None), (7, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    trusted = {i for i in range(30) if i % 2 and zlib.crc32(str(i).encode()) % 4 != 2}
    grams = lambda t: [(int.from_bytes(b[j : j + 4], "little") * 2654435761 % 2**32) >> 16 for b in [(t or "").encode()] for j in range(len(b) - 3)]
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        target.update(grams(t) if i in trusted else ())
    log = lambda c, b: math.log((c[b] + 0.5) / (c.total() + 0.5 * 2**16))
    want = sorted((i or -1, sum(log(target, b) - log(raw, b) for b in g) / len(g) if (g := grams(t)) else 0.0) for i, t in rows)
    got = sorted((r["doc_id"] or -1, r["llr"]) for r in quality.score_quality(docs, quality.fit_ratio(docs, labels)).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-4)


def pieces(rng):
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    letters = string.ascii_letters + string.digits
    return rng.choice([
        "plain words", "été 日本", "token", "PassWord", "api_key", "apikey", ": ", " = ", '" : "', "=", "\n", "AKIA", "hash", "/path/to/thing", "some_long_identifier_name_v2",
        some(letters, rng.randint(3, 60)), some("0123456789abcdef", rng.randint(20, 70)), some(string.ascii_uppercase + string.digits, rng.randint(8, 20)), some(letters + "+/_-", rng.randint(18, 40)),
    ])


def test_secret_spans(spark):
    rng = random.Random(11)
    texts = ["".join(pieces(rng) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    patterns = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32))
    ratio, tested = secrets.TokenRatio(secrets.tokenizer_path(secrets.VOCABULARY)), 0
    for r in rows:
        text = texts[r["doc_id"]] or ""
        base = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(patterns) for m in re.finditer(p, text) if len(m[1] if k == 0 else m[0]) >= least]
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == [(a, patterns[k][0], b) for a, k, b in sorted(base)]
        found = {(s["start"], s["end"]) for s in r["found"] if s["kind"] == "random"}
        if not base:  # every stretch of key characters, character by character
            inside = [c in set(string.ascii_letters + string.digits + "+/_-") for c in text] + [False]
            starts = [i for i in range(len(text)) if inside[i] and (i == 0 or not inside[i - 1])]
            runs = {i: next(j for j in range(i, len(inside)) if not inside[j]) for i in starts}
            bare = {(a, b) for a, b in runs.items() if b - a >= secrets.LEAST and text[b : b + 1] != "=" and not secrets.is_identifier(text[a:b]) and ratio(text[a:b]) < secrets.CHARS_PER_TOKEN}
            tested += len(bare)
            assert {(a, b) for a, b in found if text[b : b + 1] != "=" and text[b - 1] != "="} == bare
    assert tested > 20
