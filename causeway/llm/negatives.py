"""Hard negatives by a Voronoi-partitioned nearest-neighbour join of inner products.

A vector x gets one more component, sqrt(M**2 - |x|**2) with M the largest norm, an anchor q gets 0: then the squared
distance of the two is |q|**2 + M**2 - 2 q.x, so the largest inner product is the nearest neighbour. Pivots, a bounded
hash-chosen sample of the anchors, cut the space into cells; every row lies in the cell of its nearest pivot. First,
each anchor is joined with the rows of its own cell, which gives every search a score that its k-th result cannot fall
below. From those a cell has bounds: no row farther from its pivot than the largest (distance of an anchor from the pivot
plus distance at which the anchor's worst possible result lies) can matter, nor one nearer than where all its
anchors' ranges of scores end. A row is then copied to the other cells whose bounds it meets, and to no others, and the
exact join is made there. Scores are exact integers; bounds are rounded outwards.

Two such searches: the first 5 rows of the anchor's label, then for each of these the first 10 rows of other labels
whose score is within the asked share of the positive's.

A cell is cut into blocks of anchors and chunks of rows, by their numbers in a written table, so neither copies of one
vector nor a crowded cell make a large task; a task holds one block and one chunk. Results of chunks are at most k rows a
search, and are merged by a window over a search.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; shorter vectors count
as if filled up with zeros; a row is not its anchor's positive if it has its vec_id, and repeated rows count each as results
(a repeated anchor is searched once); rows without vec_id are no anchors and come last among equals, with a null id; equal scores
go by vec_id; negative positive scores leave no range and so no rows; an empty table gives an empty result; other
columns are not read. Components from 2**27 on raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.clusters import SCALE, finite, scaled
from causeway.llm.common import cut, lean

LABELS, EVERY, NOISE = 10, 100, 7
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
CELL_ANCHORS, MOST_PIVOTS = 128, 256  # anchors for which there is one pivot; most pivots
BLOCK_ANCHORS, CHUNK_ROWS = 256, 32_768  # anchors and rows that one task joins
AT_ONCE = 4096  # rows that are scored at once
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max
LEAST, MOST = -(1 << 62), 1 << 62  # below and above every score
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors(table, width: int, kind=np.float64) -> np.ndarray:
    import pyarrow as pa

    column = table["v"]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


class Cells:
    """Pivots in the space with one more component."""

    def __init__(self, pivots: np.ndarray, most_norm2: float, kind):
        self.width, self.most, self.kind = pivots.shape[1], most_norm2, kind
        self.pivots = self.augmented(pivots.astype(np.float64))

    def augmented(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0.0, self.most - (v * v).sum(1)))])

    def distances(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        """From each row to each pivot."""
        x = np.column_stack([v, np.zeros(len(v))]) if anchors else self.augmented(v)
        d = (x * x).sum(1)[:, None] - 2 * (x @ self.pivots.T) + (self.pivots * self.pivots).sum(1)[None, :]
        return np.sqrt(np.maximum(0.0, d))


def _numbers(values: list, default: float) -> Column:
    return F.array(*[F.lit(v if math.isfinite(v) else default) for v in values])


def _homes(rows: DataFrame, cells: Cells, anchors: bool = False) -> DataFrame:
    """rows with cell (number of the nearest pivot) and away (the distance to it)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            d = cells.distances(vectors(b, cells.width), anchors)
            at = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at])], [*b.schema.names, "cell", "away"])

    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(lean(work), f"{fields}, cell int, away double")


def _copies(rows: DataFrame, cells: Cells, outer: np.ndarray, inner: np.ndarray) -> DataFrame:
    """Each row (with the cell that it lies in) once for every other cell within whose bounds it lies."""
    names = [c for c in rows.columns if c != "cell"]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            d = cells.distances(vectors(b, cells.width))
            meets = (d <= outer[None, :]) & (d >= inner[None, :])
            meets[np.arange(len(d)), b["cell"].to_numpy()] = False
            for cell in np.flatnonzero(meets.any(axis=0)).tolist():
                some = b.filter(pa.array(meets[:, cell]))
                yield pa.RecordBatch.from_arrays([*(some[c] for c in names), pa.array(np.full(some.num_rows, cell), pa.int32())], [*names, "cell"])

    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "cell")
    return rows.mapInArrow(lean(work), f"{fields}, cell int")


def _counted(rows: DataFrame, n: int) -> list[int]:
    """Rows of each cell."""
    found = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each pivot
    return [found.get(i, 0) for i in range(n)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _join(anchors: DataFrame, rows: DataFrame, cells: Cells, k: int, same: bool) -> DataFrame:
    """anchor, want, vec_id, score: for each block of anchors and chunk of rows of a cell, each search's first k."""
    n = len(cells.pivots)
    blocks = [max(1, -(-c // BLOCK_ANCHORS)) for c in _counted(anchors, n)]
    chunks = [max(1, -(-c // CHUNK_ROWS)) for c in _counted(rows, n)]
    deal = lambda column, many, k: F.pmod(F.xxhash64(column, F.lit(k)), F.get(_numbers(many, 1), F.col("cell"))).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.get(_numbers(many, 1), F.col("cell")).cast("int") - 1))
    left = anchors.withColumn("block", deal("anchor", blocks, 1)).withColumn("chunk", each(chunks))
    right = rows.withColumn("chunk", deal("row", chunks, 2)).withColumn("block", each(blocks))
    width, kind = cells.width, cells.kind

    def work(key, a, c):
        import pyarrow as pa

        out: list[tuple] = []
        if a.num_rows and c.num_rows:
            q, s = vectors(a, width, kind), vectors(c, width, kind)
            labels, others = a["label"].to_numpy(), c["label"].to_numpy()
            own, ids = a["vec_id"].to_numpy(), c["vec_id"].fill_null(NO_ID).to_numpy()
            wants = [(i, w["want"], w["low"], w["high"]) for i, ws in enumerate(a["wants"].to_pylist()) for w in ws]
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in wants]
            for at in range(0, len(ids), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                score = (q @ s[part].T).astype(np.int64)
                fine = ((labels[:, None] == others[None, part]) == same) & (own[:, None] != ids[None, part])
                for j, (i, _, low, high) in enumerate(wants):
                    kept, kept_ids = held[j]
                    least = max(low, int(kept[-1])) if len(kept) == k else low
                    hit = np.flatnonzero(fine[i] & (score[i] >= least) & (score[i] <= high))
                    if len(hit):
                        held[j] = _best(np.concatenate([kept, score[i, hit]]), np.concatenate([kept_ids, ids[part][hit]]), k)
            names = a["anchor"].to_pylist()
            out = [(names[i], want, None if v == NO_ID else v, x) for (i, want, _, _), (xs, vs) in zip(wants, held, strict=True) for x, v in zip(xs.tolist(), vs.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["anchor", "want", "vec_id", "score"])

    keys = ("cell", "block", "chunk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "anchor long, want int, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each search, with rank from 1."""
    order = Window.partitionBy("anchor", "want").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, rows: DataFrame, cells: Cells, k: int, same: bool) -> DataFrame:
    """anchor, want, vec_id, score, rank: for every want of every anchor the first k rows of the same (or another) label.

    anchors: anchor (a number), vec_id, label, v, wants (array of want, low, high), cell, away; rows: row (a number), vec_id,
    label, v, cell. Both must be written tables, so that a row's cell and number are the same at every reading."""
    home = cut(_first(_join(anchors, rows, cells, k, same), k).drop("rank"))
    reached = home.groupBy("anchor", "want").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).select("anchor", "want", "score")
    wanted = anchors.select("anchor", "cell", "away", "v", F.explode("wants").alias("w")).select("anchor", "cell", "away", "v", "w.*").join(reached, ["anchor", "want"], "left")
    norm2 = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    far = lambda score: F.sqrt(F.greatest(F.lit(0.0), norm2 + cells.most - 2 * score.cast("double")))
    least = F.greatest(F.col("low"), F.coalesce("score", "low"))
    outer = F.when(least > LEAST, F.col("away") + far(least)).otherwise(F.lit(float("inf")))
    inner = F.when(F.col("high") < MOST, far(F.col("high")) - F.col("away")).otherwise(F.lit(0.0))
    bounds = {r["cell"]: r for r in wanted.groupBy("cell").agg(F.max(outer).alias("o"), F.min(inner).alias("i")).collect()}  # one row for each pivot
    room = 1e-6 * math.sqrt(cells.most + 1)
    limit = lambda f, none: np.array([f(bounds[i]) if i in bounds else none for i in range(len(cells.pivots))])
    copies = _copies(rows, cells, limit(lambda r: r["o"] * (1 + SLACK) + room, -1.0), limit(lambda r: r["i"] * (1 - SLACK) - room, 0.0))
    return _first(home.unionByName(_join(anchors, copies, cells, k, same)), k)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by every; a negative's score lies between low and high percent of the positive's."""
    spark, e = embeddings.sparkSession, F.col("embedding")
    label = F.when(F.col("vec_id") % NOISE == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    fit = embeddings.where(F.col("label").isNotNull() & finite(e))
    fit = fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(label, F.col("label")).cast("long").alias("label"), scaled(e).alias("v"))
    fit = cut(fit.withColumn("row", F.monotonically_increasing_id()))
    norm2 = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda t, x: (t + x.cast("decimal(18,0)") * x.cast("decimal(18,0)")).cast("decimal(38,0)"))
    about = fit.agg(F.max(norm2).alias("norm2"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("narrow")).first()
    if about["norm2"] is None:
        return spark.createDataFrame([], RESULT)
    width = max(1, about["width"])
    rows = fit if about["narrow"] == width else cut(fit.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v")))))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.min("row").alias("anchor"))
    one = lambda want, lo, hi: F.struct(want.cast("int").alias("want"), lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    asked = cut(asked)
    many = min(MOST_PIVOTS, -(-asked.count() // CELL_ANCHORS))
    if not many:
        return spark.createDataFrame([], RESULT)
    pivots = asked.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(many).collect()
    kind = np.float64 if width * (about["largest"] or 0) ** 2 < 1 << 53 else np.int64
    cells = Cells(np.array([r["v"] for r in pivots], dtype=np.int64), float(about["norm2"]), kind)

    rows = cut(_homes(rows, cells).drop("away"))
    asked = cut(_homes(asked, cells, anchors=True))
    anchors = asked.withColumn("wants", F.array(one(F.lit(0), F.lit(LEAST), F.lit(MOST))))
    found = cut(search(anchors, rows, cells, positives, same=True).select("anchor", F.col("rank").cast("int").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100")  # noqa: E731  exact, where a quotient of doubles is not
    least, most = -floor(f"(-{low}L * positive_score)"), floor(f"({high}L * positive_score)")
    wants = found.groupBy("anchor").agg(F.collect_list(one(F.col("want"), least, most)).alias("wants"))  # at most `positives` entries
    second = cut(asked.join(wants, "anchor").withColumn("wants", F.filter("wants", lambda w: w["low"] <= w["high"])).where(F.size("wants") > 0))
    got = search(second, rows, cells, negatives, same=False).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    names = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    out = got.join(found, ["anchor", "want"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in DuckDB: every anchor's score with every row."""
    return f"""WITH v AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % {NOISE} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
    ), p AS MATERIALIZED (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""


SQL = _sql()
