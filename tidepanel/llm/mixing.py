"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

A source is cut into blocks of equally many rows. With weight w of W parts in all, its block b (from 0) may not start
before slot floor(b * W / w) and must be placed by slot ceil((b + 1) * W / w). Taking, slot for slot, the released
block with the earliest deadline meets them all, and after any number of slots every source is less than one block
away from its target. Release times and deadlines repeat every W slots, so one period is scheduled, in one row, and
every block finds its slot from its number: no row waits for another.

Rows of a source are numbered by hash order of their id in buckets that grow in number, not in size, so that a
source with most of all rows is numbered by many tasks. Slots of a source that has run out stay empty. The mix ends
with the last source that is no larger than its target; what larger sources have left then is not ``kept``.

A null source is a source of its own. Null ids and repeated rows are placed like others. An empty table gives an
empty table. Input columns that carry an added name are replaced. A period costs W steps over all sources: W is
about ``parts``, a parameter, or the number of sources if that is larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

#: Rows numbered by one task, about.
BUCKET_ROWS = 50_000
ADDED = ("block", "release", "deadline", "slot", "position", "kept")


def _source(col: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("n"))


def targets(counts: DataFrame, most: float = 1 / 3, parts: int = 10_000) -> DataFrame:
    """(source key, n, w) from (key, n): natural shares, but none above ``most``; what that frees goes to the others
    in proportion. If all are above it, shares stay natural. Every source gets one part at least."""
    every = Window.partitionBy()                     # one row per source
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(every))
    over = F.col("share") > most
    free = share.withColumn("held", F.sum(F.when(over, F.lit(most)).otherwise(0.0)).over(every)) \
        .withColumn("low", F.sum(F.when(over, 0.0).otherwise(F.col("share"))).over(every))
    target = F.when(F.col("low") <= 0, F.col("share")).when(over, F.lit(most)).otherwise(
        F.col("share") * (1 - F.col("held")) / F.col("low"))
    return free.select("key", "n", F.greatest(F.lit(1), F.floor(target * parts + 0.5)).cast("long").alias("w"))


def period(weights: DataFrame) -> DataFrame:
    """(key, w, total, turn, slot): the slots of each source in a period of W slots, earliest deadline first."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("key", "w"))).alias("s"), F.sum("w").alias("total"))
    numbers = F.sequence(F.lit(0), F.size("s") - 1)

    def step(state, t):
        ready = F.filter(F.transform(numbers, lambda i: F.struct(
            F.ceil((F.get(state.done, i) + 1) * F.col("total") / F.get("s", i).w).alias("deadline"), i.alias("i"),
            F.floor(F.get(state.done, i) * F.col("total") / F.get("s", i).w).alias("release"))),
            lambda x: x.release <= t)
        return F.get(F.transform(F.array(F.array_min(ready).i), lambda i: F.struct(
            F.transform(state.done, lambda x, k: F.when(k == i, x + 1).otherwise(x)).alias("done"),
            F.array_append(state.picked, i).alias("picked"))), F.lit(0))

    start = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("done"),
                     F.array().cast("array<int>").alias("picked"))
    slots = one.where(F.size("s") > 0).select("s", "total", F.posexplode(F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.col("total") - 1), start, step).picked).alias("slot", "i"))
    row = F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1
    return slots.select(F.get("s", F.col("i")).key.alias("key"), F.get("s", F.col("i")).w.alias("w"), "total",
                        F.col("slot").cast("long").alias("slot")).withColumn("turn", row.cast("long"))


def mix(df: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id",
        block_rows: int = 16, **how) -> DataFrame:
    """Add block, release, deadline, slot, position (rows in mixed order, gaps included) and kept.

    ``weights`` holds (source, w) with whole positive numbers for every source of ``df``; without it ``targets`` of
    the counts is used."""
    names = [c for c in df.columns if c not in ADDED]
    rows = df.select(*names, _source(source_col).alias("__key"),
                     F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("__hash"))
    slim = rows.select("__key", "__hash")
    n = df.count()
    digits = 0
    while n > BUCKET_ROWS * 16 ** digits:
        digits += 1
    bucket = F.substring("__hash", 1, digits)
    sizes = stored(slim.groupBy(F.col("__key").alias("key"), bucket.alias("bucket")).agg(F.count("*").alias("rows")), "sizes")
    before = F.sum("rows").over(Window.partitionBy("key").orderBy("bucket")) - F.col("rows")
    offsets = sizes.select("key", "bucket", before.alias("before"))
    counts = sizes.groupBy("key").agg(F.sum("rows").alias("n"))
    if weights is None:
        shares = targets(counts, **how)
    else:
        shares = counts.join(weights.select(_source(source_col).alias("key"), F.col("w").cast("long").alias("w")), "key")
    shares = stored(shares, "weights")
    turns = stored(period(shares.select("key", "w")), "period")

    # The last slot of every source; the mix ends with the last of those that are no larger than their target.
    end = shares.withColumn("last", F.floor((F.col("n") - 1) / block_rows)).withColumn("turn", F.col("last") % F.col("w"))
    end = end.join(turns.select("key", "turn", "slot", "total"), ["key", "turn"]).withColumn(
        "end", F.floor(F.col("last") / F.col("w")) * F.col("total") + F.col("slot"))
    every = Window.partitionBy()                     # one row per source
    end = end.withColumn("all", F.sum("n").over(every)).agg(F.coalesce(
        F.max(F.when(F.col("n") * F.col("total") <= F.col("w") * F.col("all"), F.col("end"))), F.max("end")).alias("horizon"))

    rest = [c for c in names if c != id_col]
    order = Window.partitionBy("__key", bucket).orderBy("__hash", id_col, F.xxhash64(*rest) if rest else F.lit(0))
    found = rows.withColumn("__row", F.row_number().over(order) - 1).withColumn("__bucket", bucket)
    found = found.join(offsets.withColumnsRenamed({"key": "__key", "bucket": "__bucket", "before": "__before"}),
                       ["__key", "__bucket"]).withColumn("__row", F.col("__row") + F.col("__before"))
    found = found.withColumn("block", F.floor(F.col("__row") / block_rows))
    # A few thousand turns and one row: their number follows the sources and ``parts``, not the rows.
    widths = shares.select(F.col("key").alias("__key"), F.col("w").alias("__w"))
    found = found.join(widths, "__key").withColumn("__turn", F.col("block") % F.col("__w"))
    found = found.join(turns.select(F.col("key").alias("__key"), F.col("turn").alias("__turn"), F.col("slot").alias("__slot"),
                                    F.col("total").alias("__total")), ["__key", "__turn"]).join(F.broadcast(end))
    found = found.withColumns({
        "release": F.floor(F.col("block") * F.col("__total") / F.col("__w")),
        "deadline": F.ceil((F.col("block") + 1) * F.col("__total") / F.col("__w")),
        "slot": F.floor(F.col("block") / F.col("__w")) * F.col("__total") + F.col("__slot")})
    return found.withColumn("position", F.col("slot") * block_rows + F.col("__row") % block_rows) \
        .withColumn("kept", F.col("slot") <= F.col("horizon")).select(*names, *ADDED)


def sql(most: str = "(1.0::DOUBLE / 3)", parts: int = 10_000, block_rows: int = 16) -> str:
    """DuckDB SQL of ``mix`` on ``documents``."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
 row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(doc_id::VARCHAR), ''), doc_id NULLS FIRST) - 1 AS row FROM documents),
c AS (SELECT key, count(*) AS n FROM d GROUP BY key),
sh AS (SELECT *, n::DOUBLE / sum(n) OVER () AS share FROM c),
fr AS (SELECT *, sum(CASE WHEN share > {most} THEN {most} ELSE 0 END) OVER () AS held,
 sum(CASE WHEN share > {most} THEN 0 ELSE share END) OVER () AS low FROM sh),
w AS MATERIALIZED (SELECT key, n, greatest(1, floor((CASE WHEN low <= 0 THEN share WHEN share > {most} THEN {most}
 ELSE share * (1 - held) / low END) * {parts} + 0.5))::BIGINT AS w FROM fr),
o AS MATERIALIZED (SELECT list(key ORDER BY key) AS keys, list(w ORDER BY key) AS ws, sum(w)::BIGINT AS total FROM w),
e AS (SELECT 0::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM o
 UNION ALL SELECT t + 1, list_transform(done, lambda x, i: x + (i = p)::BIGINT), p FROM (
  SELECT t, done, list_sort(list_filter(list_transform(range(1, len(ws) + 1),
   lambda i: [((done[i] + 1) * total + ws[i] - 1) // ws[i], i, done[i] * total // ws[i]]), lambda x: x[3] <= t))[1][2] AS p
  FROM e, o WHERE t < total)),
s AS MATERIALIZED (SELECT keys[pick] AS key, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
 FROM e, o WHERE t > 0),
h AS MATERIALIZED (SELECT coalesce(max(CASE WHEN n * total <= w * nn THEN x END), max(x)) AS horizon FROM (
 SELECT w.n, w.w, total, sum(w.n) OVER () AS nn, ((w.n - 1) // {block_rows}) // w.w * total + s.slot AS x
 FROM w, o, s WHERE s.key = w.key AND s.turn = ((w.n - 1) // {block_rows}) % w.w)),
b AS (SELECT d.*, row // {block_rows} AS block FROM d)
SELECT doc_id, source, block::BIGINT AS block, (block * total // w.w)::BIGINT AS release,
 (((block + 1) * total + w.w - 1) // w.w)::BIGINT AS deadline, (block // w.w * total + s.slot)::BIGINT AS slot,
 ((block // w.w * total + s.slot) * {block_rows} + row % {block_rows})::BIGINT AS position,
 block // w.w * total + s.slot <= horizon AS kept
FROM b JOIN w ON w.key = b.key JOIN s ON s.key = b.key AND s.turn = b.block % w.w, o, h"""
