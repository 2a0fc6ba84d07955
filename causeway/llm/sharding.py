"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal text are linked (through their group, so a group of n has n links, not n * n). Every document
begins in a hashed shard. In each round a group looks at the shards that hold most of it, as few as can hold it (one,
unless it is larger than a shard), and its other members ask to move there. How many of those in shard a may move to
shard b follows from the table of all askings by shard pairs: moves are admitted in exchanges (round trips over
shards), and into room that only documents without copies take. Every other round, groups that fit a shard look at
any of their shards, so that groups whose home gives nothing in exchange can meet elsewhere. Rounds go on until two
of them lower neither the parts that groups are cut into nor the documents away from home. Last come exact counts
(any two shards differ by one at most, the law `rows`): where copies overfill a shard, whole groups move, then parts
of groups for what whole groups cannot even out; documents without copies fill up the rest.

Documents of one text in one shard are alike, so rounds work on (text, shard, count) and rows are dealt at the end.
Ranks over a whole shard are those within hashed buckets of bounded size plus the counts of the buckets before, so no
task holds a shard. Only one row for each shard reaches the driver.

Edge cases: null text has size 1, crc32 0 and no links; empty text has size 1 and links with empty texts; repeated
rows are documents of their own; an empty table gives an empty result; doc_id may be null; columns other than doc_id
and text are not read. With fewer documents than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import cut, join_counted

SHARDS = 16
BUCKET_ROWS = 4000


def by_shard(values: dict[int, float], shard: Column, default: float = 0.0) -> Column:
    """The value of each shard (a few literals)."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(shard == k, F.lit(v)).otherwise(out)
    return out


def linked_rows(docs: DataFrame, shards: int) -> DataFrame:
    """rid, doc_id, size, text_crc32, key (of the text), copies, shard (hashed)."""
    text = F.col("text")
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
        )
    ).withColumn("rid", F.monotonically_increasing_id())  # of a written table: the same at every run
    groups = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    joined = join_counted(rows, groups, "key", "copies", rows.count(), "left")
    return cut(joined.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")))


def askings(cells: DataFrame, room: int, turn: int) -> DataFrame:
    """key, shard, goal, n: the parts of groups that ask to move to one of their group's homes."""
    held = F.collect_list(F.struct("shard", "n")).alias("held")
    lists = cells.groupBy("key").agg(F.ceil(F.sum("n") / max(1, room)).cast("int").alias("homes"), held).where(F.size("held") > 1)
    weight = lambda c: F.when((F.col("homes") == 1) & F.lit(turn % 2 == 1), F.lit(0)).otherwise(c["n"])
    order = F.transform("held", lambda c: F.struct(weight(c).alias("w"), F.xxhash64("key", c["shard"], F.lit(turn)).alias("h"), c["shard"].alias("shard"), c["n"].alias("n")))
    lists = lists.select("key", "homes", F.sort_array(order, asc=False).alias("held")).where(F.size("held") > F.col("homes"))
    movers = lists.select("key", "homes", "held", F.explode(F.expr("slice(held, homes + 1, size(held))")).alias("c"))
    home = F.element_at("held", (F.pmod(F.xxhash64("key", "c.shard", F.lit(turn)), F.col("homes")) + 1).cast("int"))
    return movers.select("key", F.col("c.shard").alias("shard"), home["shard"].alias("goal"), F.col("c.n").alias("n"))


def exchanges(asked: dict[tuple[int, int], int], space: dict[int, int], shards: int) -> dict[tuple[int, int], int]:
    """How many of those that ask to move from one shard to another may, so that no shard gains more than its space.

    Round trips over the askings, shortest first; one through the outside stands for a gain that takes space."""
    outside = shards
    cap = dict(asked) | {(s, outside): n for s, n in space.items()} | {(outside, s): sum(asked.values()) for s in range(shards)}
    cap = {arc: n for arc, n in cap.items() if n > 0}
    given: dict[tuple[int, int], int] = {}

    def trip(start: int) -> list[int] | None:
        back, todo = {}, [start]
        for u in todo:
            for v in range(shards + 1):
                if cap.get((u, v), 0) and not (u, v) == (outside, start) and v not in back:
                    back[v] = u
                    if v == start:
                        path = [v]
                        while len(path) == 1 or path[-1] != start:
                            path.append(back[path[-1]])
                        return path[::-1]
                    todo.append(v)
        return None

    def walk(path: list[int]) -> None:
        arcs = list(zip(path, path[1:]))
        n = min(cap[arc] for arc in arcs)
        for arc in arcs:
            cap[arc] -= n
            if outside not in arc:
                given[arc] = given.get(arc, 0) + n

    for u, v in sorted(asked):
        if cap.get((u, v), 0) and cap.get((v, u), 0):
            walk([u, v, u])
    for u, v in sorted(asked):  # into free room
        if cap.get((u, v), 0) and cap.get((v, outside), 0) and cap.get((outside, u), 0):
            walk([outside, u, v, outside])
    for u in range(shards):
        while path := trip(u):
            walk(path)
    return given


def running(parts: DataFrame, by: list[str], turn: int, count: int) -> DataFrame:
    """parts with the sum of n before each (in the order of hashes) among those that agree in by, in column before."""
    buckets = max(1, -(-count // BUCKET_ROWS))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(buckets)))
    ahead = Window.partitionBy(*by, "bucket").orderBy(F.xxhash64("key", F.lit(turn + 1)), "key").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    if buckets > 1:
        sums = parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*by, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("from"))
        out = out.join(sums, [*by, "bucket"]).withColumn("before", F.col("before") + F.col("from")).drop("from")
    return out.drop("bucket")


def moved(cells: DataFrame, moves: DataFrame) -> DataFrame:
    """cells after moves (key, shard, goal, n)."""
    lost = moves.select("key", "shard", (-F.col("n")).alias("n"))
    gained = moves.select("key", F.col("goal").alias("shard"), "n")
    return cut(cells.unionByName(lost).unionByName(gained).groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0"))


def in_shards(cells: DataFrame, shards: int) -> tuple[dict[int, int], int]:
    """The documents in each shard, and the number of cells."""
    got = cells.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).collect()
    return {s: 0 for s in range(shards)} | {r["shard"]: r["n"] for r in got}, sum(r["cells"] for r in got)


def propagate(cells: DataFrame, room: int, shards: int) -> DataFrame:
    """cells (key, shard, n) with groups brought together; room: most linked documents that a shard should have."""
    turn, best = 0, None
    while True:
        held, count = in_shards(cells, shards)
        moves = askings(cells, room, turn)
        got = moves.groupBy("shard", "goal").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
        asked = {(r["shard"], r["goal"]): r["n"] for r in got}
        if turn % 2 == 0:
            now = (count, sum(asked.values()))
            if not asked or (best is not None and now >= best):
                return cells
            best = now
        given = exchanges(asked, {s: room - n for s, n in held.items()}, shards)
        if given:
            quota = cells.sparkSession.createDataFrame([(a, b, n) for (a, b), n in given.items()], "shard int, goal int, most long")
            most = max(r["parts"] for r in got)
            placed = running(moves, ["shard", "goal"], turn, most).join(F.broadcast(quota), ["shard", "goal"]).where("before < most")
            cells = moved(cells, placed.select("key", "shard", "goal", F.least("n", F.col("most") - F.col("before")).alias("n")))
        turn += 1


def level_groups(cells: DataFrame, target: dict[int, int], shards: int) -> DataFrame:
    """cells with no more in any shard than its target: whole groups move as long as any fits, then parts of groups."""
    turn, whole = 0, True
    while True:
        held, count = in_shards(cells, shards)
        over, gaps = {s: n - target[s] for s, n in held.items()}, []
        for s in sorted(over, key=over.get):
            if over[s] < 0:
                gaps.append([s, -over[s]])
        if max(over.values()) <= 0:
            return cells
        deal = []  # (shard, goal, from, to): which of the documents that leave a shard go where
        for s in sorted(over, key=lambda s: -over[s]):
            at = 0
            while at < over[s]:
                goal, n = gaps[0][0], min(gaps[0][1], over[s] - at)
                deal.append((s, goal, at, at + n))
                at, gaps[0][1] = at + n, gaps[0][1] - n
                if not gaps[0][1]:
                    gaps.pop(0)
        quota = F.broadcast(cells.sparkSession.createDataFrame(deal, "shard int, goal int, lo long, hi long"))
        if whole:
            fits = F.broadcast(cells.sparkSession.createDataFrame([(s, max(hi - lo for t, _, lo, hi in deal if t == s)) for s in {d[0] for d in deal}], "shard int, fits long"))
            single = cells.groupBy("key").agg(F.count("*").alias("cells"), F.max("shard").alias("shard"), F.sum("n").alias("n")).where("cells = 1").drop("cells")
            parts = single.join(fits, "shard").where("n <= fits").drop("fits")
        else:
            parts = cells
        placed = running(parts, ["shard"], turn, -(-count // shards)).join(quota, "shard")
        if whole:
            moves = cut(placed.where("before >= lo and before + n <= hi").select("key", "shard", "goal", "n"))
            if not moves.limit(1).count():
                whole = False
                continue
        else:
            n = F.least(F.col("before") + F.col("n"), "hi") - F.greatest("before", "lo")
            moves = placed.select("key", "shard", "goal", n.alias("n")).where("n > 0")
        cells = moved(cells, moves)
        turn += 1


def dealt(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (linked ones) with the shards of cells, as many of each text in a shard as its cell says."""
    buckets = F.ceil(F.col("copies") / BUCKET_ROWS)
    rows = rows.drop("shard").withColumn("bucket", F.pmod(F.xxhash64("rid", F.lit(5)), buckets))
    counts = rows.where(F.col("copies") > BUCKET_ROWS).groupBy("key", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "bucket", F.sum("n").over(earlier).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy("rid")
    numbered = rows.withColumn("r", F.row_number().over(inside) - 1).join(starts, ["key", "bucket"], "left")
    numbered = numbered.withColumn("r", F.col("r") + F.coalesce("start", F.lit(0))).drop("start")
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    last = F.ceil(F.sum("n").over(Window.partitionBy("key")) / BUCKET_ROWS) - 1
    ranges = cells.select("key", "shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lo"), last.alias("last"))
    ranges = ranges.select("key", "shard", "n", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("bucket"))
    return numbered.join(ranges, ["key", "bucket"]).where("r >= lo and r < lo + n").drop("r", "n", "lo", "bucket")


def ranked(rows: DataFrame, n: int, shards: int, last: Column) -> DataFrame:
    """rows with their rank (from 0) within their shard, rows where last holds after the others."""
    buckets = max(1, -(-n // (shards * BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(buckets)) + F.when(last, F.lit(buckets)).otherwise(F.lit(0)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    inside = Window.partitionBy("shard", "bucket").orderBy("rid")
    numbered = rows.withColumn("r", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket"]).withColumn("rank", F.col("from") + F.col("r")).drop("bucket", "from", "r")


def level(rows: DataFrame, n: int, target: dict[int, int], shards: int) -> DataFrame:
    """rows with the shards of documents without copies changed so that each shard has its target."""
    held = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over = {s: max(0, held.get(s, 0) - target[s]) for s in range(shards)}
    if not any(over.values()):
        return rows
    starts, total = {}, 0
    for s in range(shards):
        starts[s] = total
        total += over[s]
    number = by_shard(starts, F.col("shard"), 0) + F.col("rank")
    goal, at = F.col("shard"), total
    for s in reversed(range(shards)):  # numbers are dealt to the shards below their target, one after another
        if (gap := max(0, target[s] - held.get(s, 0))) > 0:
            goal = F.when((number >= at - gap) & (number < at), F.lit(s)).otherwise(goal)
            at -= gap
    moves = F.col("rank") < by_shard(over, F.col("shard"), 0)
    return ranked(rows, n, shards, F.col("copies").isNotNull()).withColumn("shard", F.when(moves, goal).otherwise(F.col("shard")).cast("int")).drop("rank")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 in each shard), copies (null if the text is unique) of every row."""
    rows = linked_rows(docs, shards)
    n, linked = rows.count(), rows.where("copies is not null")
    cells = propagate(cut(linked.groupBy("key", "shard").agg(F.count("*").alias("n"))), n // shards, shards)
    held, _ = in_shards(cells, shards)
    target = {s: n // shards + (i < n % shards) for i, s in enumerate(sorted(held, key=lambda s: (-held[s], s)))}
    grouped = dealt(linked, level_groups(cells, target, shards))
    settled = cut(level(rows.where("copies is null").unionByName(grouped), n, target, shards))
    out = ranked(settled, n, shards, F.lit(False))
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"), "copies")


def op10_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "copies")
