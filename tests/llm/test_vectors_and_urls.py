"""Hard negatives, clustering and URL filters: against plain versions, their SQL, and odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import clusters, negatives, registry, urls

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, rank int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, 1, 2, "clash") for i, e, y in rows], SCHEMA)


def made(n: int, seed: int = 0, width: int = 64):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, width)) / 6
    return [(i, (centre[i % 8] + rng.normal(size=width) / 12).tolist(), int(rng.integers(10))) for i in range(n)]


ODD = [
    (None, [0.25] * 64, 3), (5, None, 1), (6, [0.1] * 63, 1), (7, [0.1] * 63 + [None], 1), (8, [0.1] * 63 + [float("nan")], 1), (9, [0.1] * 63 + [float("inf")], 1), (10, [0.1] * 64, None), (11, [], 2),
]


@pytest.fixture(scope="module")
def vectors(spark):
    """Ties, copies of one vector, repeated rows, null and wrong vectors, and columns with clashing names."""
    rows = made(350)
    rows += [(1000 + i, rows[0][1], i % 10) for i in range(150)] + rows[:40] + ODD
    return table(spark, rows)


def ints(e):
    return tuple(math.floor(256 * float(np.float32(x))) for x in e)


def fine(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def plain_negatives(rows):
    fit = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, ints(e)) for i, e, y in rows if y is not None and fine(e)]
    late = lambda i: math.inf if i is None else i
    out = []
    for a, ya, va in {r for r in fit if r[0] is not None and r[0] % 100 == 0}:
        scored = sorted(((sum(p * q for p, q in zip(va, v)), i, y) for i, y, v in fit if i != a), key=lambda s: (-s[0], late(s[1])))
        for ps, p, _ in [s for s in scored if s[2] == ya][:5]:
            hits = [s for s in scored if s[2] != ya and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            out += [(a, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(hits, 1)]
    return sorted(out, key=repr)


def of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def given(vectors):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]


def test_hard_negatives(vectors, monkeypatch):
    want = plain_negatives(given(vectors))
    assert len(want) > 150
    assert of(negatives.hard_negatives(vectors)) == want
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 2)  # several cells, whose rows are copied by bounds
    assert of(negatives.hard_negatives(vectors)) == want
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 100)
    assert of(negatives.hard_negatives(vectors)) == want


def test_hard_negatives_of_odd_tables(spark, vectors):
    assert negatives.hard_negatives(vectors.where("false")).collect() == []
    assert negatives.hard_negatives(vectors.where("vec_id % 100 <> 0")).collect() == []
    one = table(spark, [(0, [0.5, 0.5], 1), (1, [0.5], 2), (2, [0.3], 3), (3, [-0.5, -0.5], 3)])  # short vectors count as filled up
    assert of(negatives.hard_negatives(one)) == plain_negatives([(0, [0.5, 0.5], 1), (1, [0.5, 0], 2), (2, [0.3, 0], 3), (3, [-0.5, -0.5], 3)]) != []
    large = table(spark, [(0, [300000.0, 1.0], 1), (1, [300000.0, 2.0], 2), (2, [200000.0, 3.0], 5)])  # products beyond what doubles hold exactly
    assert of(negatives.hard_negatives(large)) == plain_negatives([(0, [300000.0, 1.0], 1), (1, [300000.0, 2.0], 2), (2, [200000.0, 3.0], 5)])


def test_cells_leave_rows_out(spark):
    """Bounds keep rows of a far cluster from being copied, and lose no result."""
    rng = np.random.default_rng(5)
    rows = [(100 * i if i < 20 else 3001 + 2 * i, (np.eye(64)[i % 4] / 2 + rng.normal(size=64) / 200).tolist(), int(i % 40 // 4)) for i in range(400)]
    df = table(spark, rows)
    seen = []
    copies = negatives._copies
    negatives._copies = lambda r, *a: seen.append((r.count(), copies(r, *a).count())) or copies(r, *a)
    try:
        negatives.CELL_ANCHORS = 2
        got = of(negatives.hard_negatives(df))
    finally:
        negatives._copies, negatives.CELL_ANCHORS = copies, 128
    assert got == plain_negatives([(i, e, y) for i, e, y in given(df)])
    rows, copied = seen[0]
    assert copied < 9 * rows / 2  # of nine other cells


def plain_clusters(rows, k=40, rounds=5):
    fit = [(i, np.array(ints(e))) for i, e, _ in rows if fine(e) and len(e) == 64]
    seeds = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in fit if i is not None))[:k]
    c = np.array([v for _, v in seeds])
    x = np.array([v for _, v in fit])
    for t in range(rounds + 1):
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
        a = d.argmin(axis=1)
        if t < rounds:
            c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    own = d[np.arange(len(a)), a]
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return sorted(((i, int(j), int(s), int(own[a == j].sum()), int(own.sum()), sha[j]) for (i, _), j, s in zip(fit, a, own)), key=repr)


def test_clusters(spark, vectors):
    rows = given(vectors)
    assert of(clusters.cluster_vectors(vectors)) == plain_clusters(rows)
    assert clusters.cluster_vectors(vectors.where("false")).collect() == []
    few = table(spark, made(7))
    assert of(clusters.cluster_vectors(few)) == plain_clusters(given(few))
    same = table(spark, [(i, [0.5] * 64, 1) for i in range(60)])  # only ties
    assert of(clusters.cluster_vectors(same)) == plain_clusters(given(same)) and {r["cluster"] for r in clusters.cluster_vectors(same).collect()} == {0}
    big = table(spark, [(i, (np.arange(64) * 60.0 * (i + 1)).tolist(), 1) for i in range(50)])  # beyond what doubles hold exactly
    assert of(clusters.cluster_vectors(big)) == plain_clusters(given(big))
    with pytest.raises(Exception, match="2\\*\\*27"):
        clusters.cluster_vectors(table(spark, [(1, [1e9] * 64, 1)])).collect()


def test_bounds_save_scans():
    rng = np.random.default_rng(3)
    centre = rng.integers(-200, 200, size=(10, 64))
    v = clusters.exact(centre[rng.integers(10, size=2000)] + rng.integers(-9, 9, size=(2000, 64)))
    old, new = centre + rng.integers(-3, 4, size=(10, 64)), centre
    first = clusters.scan(v, clusters.exact(old))
    cluster, upper, lower, scans = clusters.Move(old, new).follow(v, *first)
    d = np.sqrt(clusters.squared_distances(v, clusters.exact(new)))
    assert (cluster == d.argmin(axis=1)).all() and scans < 20
    assert (upper >= d.min(axis=1)).all() and (lower <= np.partition(d, 1, axis=1)[:, 1]).all()


URLS = [
    "http://a.example.net/en/1", "http://example.net/en/", "https://Sub.Example.NET/de/x?q=/en/", "http://x.net", "http://x.net?a", "http://notexample.net/en/", "http://example.com/de/1", "http://www.example.com/de", "http://z.org/fr/2#t",
    "http://z.org/en/2", "https://spam.example.com/en/pills", "nothing", "", None, "://", "http://", "a://b://c/d", "HTTP://É.ORG/FR/", "http://ünï.org/fr/ß", "http://q.org/fr/\nnext", "http://q.com/" + "long/" * 4000, "http://q.com/x y",
]


def plain_judge(rows):
    """The same models in plain Python."""
    table = []
    for u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = path = ""
        if rest is not None:
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = rest[:cut], rest[cut:]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text)) if fits else None
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in rest or "")][0]
        kinds = [ord(c) - 96 if "a" <= c <= "z" else 27 if "0" <= c <= "9" else 28 if c == "/" else 29 if c == "." else 30 if c in "-_" else 31 for c in low]
        held = bool(u) and hashlib.md5(u.encode()).hexdigest()[0] in "048c"
        table.append((host, path, rule, kinds, held))
    models = {}
    for verdict in ("allow", "block"):
        counts = defaultdict(Counter)
        for _, _, rule, kinds, held in table:
            if rule and rule.verdict == verdict and not held:
                padded = [0, 0, 0, *kinds]
                for i, c in enumerate(kinds):
                    for k in range(4):
                        counts[tuple(padded[i + 3 - k : i + 3])][c] += 1
        models[verdict] = counts

    def p(verdict, context, c):
        lower = p(verdict, context[1:], c) if context else 1 / 32
        n = models[verdict].get(context)
        return (n[c] + len(n) * lower) / (sum(n.values()) + len(n)) if n else lower

    def score(kinds):
        padded = [0, 0, 0, *kinds]
        return sum(math.log(p("allow", tuple(padded[i : i + 3]), c)) - math.log(p("block", tuple(padded[i : i + 3]), c)) for i, c in enumerate(kinds)) / len(kinds) if kinds else 0.0

    held = [(math.floor(round(score(k), 9) * 64), r.verdict == "allow") for _, _, r, k, h in table if r and h]
    a, b = sum(x for _, x in held), sum(not x for _, x in held)
    quality = lambda t: round(sum(s >= t for s, x in held if x) / a + sum(s < t for s, x in held if not x) / b, 9)
    threshold = max(range(-512, 513), key=lambda t: (quality(t), -abs(t), t)) / 64 if a and b else 0.0
    return [(h, pa, r.text if r else None, r.verdict if r else "allow" if round(score(k), 9) >= threshold else "block") for h, pa, r, k, _ in table]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "<p>", "clash", 1) for i, u in enumerate(rows)], "page_id long, url string, html string, host string, score int")


@pytest.mark.parametrize("more", [0, 300])
def test_urls(spark, more):
    rng = np.random.default_rng(1)
    words = ["news", "blog", "shop", "cheap", "pills", "wiki"]
    rows = URLS + [f"https://{rng.choice(words)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.integers(99)}" for _ in range(more)]
    rows += rows[:5]
    got = urls.filter_urls(pages(spark, rows)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == plain_judge(rows)


def test_urls_of_odd_tables(spark):
    assert urls.filter_urls(pages(spark, URLS).where("false")).collect() == []
    got = urls.filter_urls(pages(spark, ["http://x.com/", None]).withColumn("page_id", F.lit(None).cast("long"))).collect()  # nothing to learn from
    assert [(r["page_id"], r["verdict"], r["score"]) for r in got] == [(None, "allow", 0.0)] * 2


@pytest.mark.parametrize("name", ["op11_voronoi_negatives", "op12_hamerly", "op13_url_markov"])
def test_registered_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.queries()[name](spark, folder)
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert of(got.select(columns)) == sorted(want.fetchall(), key=repr)
