"""Near duplicates: fast similarity sketches, banding, exact verification on full shingle sets.

Sketch: every shingle of a set is thrown, round after round, at a hashed bin with a hashed value; a bin keeps the
smallest value of the earliest round that reached it. From round t on, round i sends all shingles to bin i - t, so
every one of the t coordinates is filled, and coordinates of two sets agree with a probability that concentrates
around their Jaccard similarity. t = BANDS * ROWS coordinates are cut into bands; sets that agree on a whole band
meet. At similarity 0.8 a pair misses all 32 bands of 5 with probability (1 - 0.8**5)**32 = 3e-6.

Equal sets are one class before anything is compared. All members of a bucket belong to the region of its smallest
id; a region is dealt into blocks of bounded size, the region's first document joining each. Within a block all
pairs are counted exactly (one product of the incidence matrix), and only a spanning forest of the links leaves it.
For regions of several blocks a second pass compares, block by block, whatever is outside the region's largest
component with all its members. So no link between different sets that meet in a bucket is lost, and no task ever
holds more than two blocks.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are kept; fewer words than a
shingle form one shingle; rows that share a doc_id are one node; a row without doc_id takes the component of an
equal set that has one (kept false), else null (kept true); an empty table gives an empty result; only doc_id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import U64, WordHashes, cut, ensure_checkpoint_dir, lean, mixed, text_bytes, window_hashes
from causeway.llm.components import connected_components

BANDS, ROWS = 32, 5
PERCENT = 80
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000
ROW = "__row"  # column of row numbers
BROADCAST_ROWS = 1_000_000  # rows of (id, up to BANDS pairs of numbers) that are sent to every executor; beyond, a shuffle join


def shingles(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text whose A-Z are lower-cased."""
    return np.unique(window_hashes(hashes.of(text.lower().split()), k)) if text else np.zeros(0, U64)


def sketch(x: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set of distinct 64-bit hashes (not empty); the upper 32 bits hold the round."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=U64)
    at_once = max(1, 1024 // len(x))
    with np.errstate(over="ignore"):
        for start in range(0, 2 * t, at_once):
            rounds = np.arange(start, min(2 * t, start + at_once), dtype=U64)
            h = mixed(x[None, :] ^ mixed((rounds + U64(1)) * U64(0x9E3779B97F4A7C15))[:, None])
            bins = (h >> U64(32)) % U64(t)
            late = rounds >= t
            if late.any():
                bins[late] = (rounds[late] - U64(t))[:, None]
            np.minimum.at(out, bins.ravel().astype(np.int64), ((h & U64(0xFFFFFFFF)) | (rounds << U64(32))[:, None]).ravel())
            if int(out.max()) >> 32 < start + at_once:
                break
    return out


def band_keys(s: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of a sketch; keys of different bands differ."""
    rows = s.reshape(bands, -1)
    with np.errstate(over="ignore"):
        key = mixed(np.arange(1, bands + 1, dtype=U64) * U64(0xD1B54A32D192ED03))
        for i in range(rows.shape[1]):
            key = mixed(key ^ rows[:, i]) * U64(0x9FB21C651E98DF25)
    return key.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set; null if empty), keys (one for each band)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            n, digests, keys = [], [], []
            for text in text_bytes(batch["text"]):
                x = shingles(text, k, hashes)
                n.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                keys.append(band_keys(sketch(x, bands * rows), bands) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id long, n_shingles long, digest binary, keys array<long>")


def _intersections(sets: list[np.ndarray], others: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices over the shingles that both sides have."""
    out = np.zeros((len(sets), len(others)), dtype=np.int64)
    common = np.intersect1d(np.unique(np.concatenate(sets)), np.unique(np.concatenate(others)), assume_unique=True)
    at = [[np.searchsorted(common, x[np.isin(x, common, assume_unique=True)]) for x in side] for side in (sets, others)]
    for start in range(0, len(common), width):
        m = []
        for side in at:
            a = np.zeros((len(side), min(width, len(common) - start)), dtype=np.float32)
            for i, x in enumerate(side):
                lo, hi = np.searchsorted(x, (start, start + width))
                a[i, x[lo:hi] - start] = 1
            m.append(a)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _within(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections within one list of sets."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (start, start + width))
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n[:, None] + m[None, :] - inter)


def _forest(ids: np.ndarray, adjacent: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id of its component) where they differ."""
    label = np.arange(len(ids))[np.argsort(np.argsort(ids, kind="stable"), kind="stable")]  # ranks of the ids
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    ranked = np.sort(ids, kind="stable")
    return [(int(i), int(ranked[r])) for i, r in zip(ids, label, strict=True) if i != ranked[r]]


def _by_size(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with wanted (one row for each doc_id): broadcast if it is known to be small, else shuffled."""
    return docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id")


def _edges_in_blocks(docs: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """src, dst: spanning forests of the links within each block of a region, and to the region's first document."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            for doc_id, text, regions in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["regions"].to_pylist(), strict=True):
                x = shingles(text, k, hashes).tobytes()
                for r in regions if x else ():
                    blocks = range(r["blocks"]) if r["hub"] == doc_id else (r["block"],)
                    for at in range(0, len(blocks), 1024):
                        some = list(blocks[at : at + 1024])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["hub"]] * len(some)), pa.array(some, pa.int64()), pa.array([doc_id] * len(some)), pa.array([x] * len(some), pa.binary())],
                            ["hub", "block", "doc_id", "shingles"],
                        )

    def verify(table):
        import pyarrow as pa

        ids = table["doc_id"].to_numpy()
        sets = [np.frombuffer(x, dtype=U64) for x in table["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets])
        edges = _forest(ids, _linked(_within(sets), n, n, percent)) if len(ids) > 1 else []
        return pa.table({"src": pa.array([a for a, _ in edges], pa.int64()), "dst": pa.array([b for _, b in edges], pa.int64())})

    dealt = _by_size(docs.select(F.col("doc_id").cast("long"), "text"), wanted).mapInArrow(lean(deal), "hub long, block long, doc_id long, shingles binary")
    return dealt.groupBy("hub", "block").applyInArrow(verify, "src long, dst long")


def _edges_across_blocks(docs: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """src, dst: links between the documents outside a region's largest component and all its members.

    regions has hub, block, blocks, rest (block among the outsiders, or null), rests (their blocks), component."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        names = ["hub", "i", "j", "left", "doc_id", "component", "shingles"]
        for batch in batches:
            for doc_id, text, regions in zip(batch["doc_id"].to_pylist(), text_bytes(batch["text"]), batch["regions"].to_pylist(), strict=True):
                x = shingles(text, k, hashes).tobytes()
                for r in regions if x else ():
                    keys = [(i, r["block"], False) for i in range(r["rests"])]
                    keys += [(r["rest"], j, True) for j in range(r["blocks"])] if r["rest"] is not None else []
                    for at in range(0, len(keys), 1024):
                        i, j, left = zip(*keys[at : at + 1024], strict=True)
                        same = lambda v, m=len(i), **a: pa.array([v] * m, **a)
                        yield pa.RecordBatch.from_arrays(
                            [same(r["hub"]), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(left), same(doc_id), same(r["component"]), same(x, type=pa.binary())], names
                        )

    def verify(table):
        import pyarrow as pa

        left = table["left"].to_numpy(zero_copy_only=False).astype(bool)
        ids, comps = table["doc_id"].to_numpy(), table["component"].to_numpy()
        sets = [np.frombuffer(x, dtype=U64) for x in table["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        edges: set[tuple[int, int]] = set()
        if len(a) and len(b):
            hit = _linked(_intersections([sets[i] for i in a], [sets[j] for j in b]), n[a], n[b], percent) & (comps[a][:, None] != comps[b][None, :])
            seen: set[tuple[int, int]] = set()
            for i, j in np.argwhere(hit):
                c = (int(comps[a[i]]), int(comps[b[j]]))
                if c not in seen:  # one link is enough to join two components
                    seen.add(c)
                    edges.add((int(ids[a[i]]), int(ids[b[j]])))
        return pa.table({"src": pa.array([x for x, _ in edges], pa.int64()), "dst": pa.array([y for _, y in edges], pa.int64())})

    dealt = _by_size(docs.select(F.col("doc_id").cast("long"), "text"), wanted).mapInArrow(
        lean(deal), "hub long, i long, j long, left boolean, doc_id long, component long, shingles binary"
    )
    return dealt.groupBy("hub", "i", "j").applyInArrow(verify, "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, for every row of docs."""
    rows_of = cut(sketches(docs, k, bands, rows))
    classes = (
        rows_of.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("first"), F.count("*").alias("copies"))
        .select("digest", "first.*", "copies")
    )
    met = classes.select(F.col("doc_id").alias("member"), "n_shingles", F.explode("keys").alias("key"))
    hubs = met.groupBy("key").agg(F.min("member").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    # A member that only ever is its buckets' first comes back as its own region's member.
    regions = cut(met.join(hubs, "key").groupBy("hub", "member").agg(F.first("n_shingles").alias("n_shingles")))
    sizes = regions.groupBy("hub").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    blocks = sizes.select("hub", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    placed = regions.join(blocks, "hub").withColumn("block", F.expr("pmod(xxhash64(member, 7), blocks)"))
    wanted = placed.groupBy(F.col("member").alias("doc_id")).agg(F.collect_list(F.struct("hub", "block", "blocks")).alias("regions"))
    edges = cut(_edges_in_blocks(docs, cut(wanted), k, percent))
    found = connected_components(edges)

    several = placed.where("blocks > 1")
    if several.limit(1).count():
        named = several.join(found, several["member"] == found["node"], "left").select(several["*"], F.coalesce("component", "member").alias("component"))
        named = cut(named)
        counts = named.groupBy("hub", "component").agg(F.count("*").alias("n"))
        largest = counts.groupBy("hub").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"), F.sum("n").alias("docs"), F.max("n").alias("most"))
        largest = largest.select("hub", "largest", F.expr("cast(ceil((docs - most) / {0}D) as long)".format(BLOCK_DOCS)).alias("rests")).where("rests > 0")
        dealt = named.join(largest, "hub").select(
            F.col("member").alias("doc_id"),
            F.struct("hub", "block", "blocks", "rests", "component", F.expr("if(component = largest, null, pmod(xxhash64(member, 11), rests))").alias("rest")).alias("r"),
        )
        wanted = cut(dealt.groupBy("doc_id").agg(F.collect_list("r").alias("regions")))
        if wanted.limit(1).count():
            found = connected_components(edges.unionByName(_edges_across_blocks(docs, wanted, k, percent)))

    component = classes.select("digest", "doc_id", "copies").join(found, F.col("doc_id") == F.col("node"), "left")
    component = component.where("copies > 1 or component is not null").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows_of.select("doc_id", "n_shingles", "digest").join(component, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.expr("if(component_id is null, true, coalesce(doc_id = component_id, false))"))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """docs, written to the shared folder, with a number for each row in ROW: the same at every reading."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows that stay when each group of near duplicates keeps one of its smallest doc_id; all columns as they were.

    Rows are compared one by one, whatever their ids: of repeated rows one stays, a row without id stays only in a
    group without ids, and rows of one id with different texts are documents of their own."""
    rows = numbered_rows(docs)
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), k, percent)
    lesser = cut(found.where("not kept").select(F.col("doc_id").alias(ROW), "component_id"))
    members = lesser.unionByName(lesser.select(F.col("component_id").alias(ROW), "component_id").distinct())
    named = members.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("first")
    stays = named.groupBy("component_id").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    gone = cut(members.select(ROW).join(stays, ROW, "left_anti").select(F.col(ROW).alias("__gone")))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, rows[ROW] == gone["__gone"], "left_anti").drop(ROW)


def op2_minhash_fss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
