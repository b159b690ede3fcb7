"""Daily and weekly panels built once from fact tables and stored for all queries.

The panel is the reused asset, so it is written to the cluster's shared folder,
in periods of time that are bucketed by code: rolling windows need no shuffle, cross-sections
read only the columns they use, a span of dates reads only its periods, and a lost executor
costs a re-read instead of a rebuild.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.clean import ratio, session_day, zero_pad
from ..session import run_dir


#: For each of these numbers of rows the panel holds the date that lies so many rows back in a code's history.
LADDER = (4, 16, 64, 256)


@dataclass(frozen=True)
class Panel:
    """A stored panel, unique on (date, code): partitioned by period, and bucketed by code within a period. Its
    sessions (texts, in order) are bounded by the calendar and known to the driver, so that spans of dates become
    literals and prune periods."""
    df: DataFrame
    rows: int
    table: str
    buckets: int
    months: int             # of a period
    sessions: tuple[str, ...]

    def between(self, start: str | None = None, stop: str | None = None, back: bool = False) -> DataFrame:
        """Rows of the dates from ``start`` to ``stop``; only the periods of these dates are read."""
        rows = self.df.sparkSession.table(self.table)
        for limit, keeps in ((start, lambda x, y: x >= y), (stop, lambda x, y: x <= y)):
            if limit is not None:
                rows = rows.filter(keeps(F.col("date"), F.lit(limit).cast("timestamp"))
                                   & keeps(F.col("period"), F.lit(self.period(limit))))
        return rows if back else rows.select(*self.df.columns)

    def period(self, day: str) -> int:
        return (int(day[:4]) * 12 + int(day[5:7]) - 1) // self.months

    def session(self, as_of: str, back: int = 0) -> str | None:
        """The last session that is not after ``as_of``, or the one so many sessions before it."""
        at = bisect_right(self.sessions, as_of if len(as_of) > 10 else f"{as_of} 00:00:00") - 1 - back
        return self.sessions[at] if at >= 0 else None

    def last_sessions(self, as_of: str, count: int) -> DataFrame:
        """Rows of the last ``count`` sessions up to the as-of date."""
        stop = self.session(as_of)
        return self.between(self.session(as_of, count - 1) or self.sessions[0], stop) if stop else self.df.limit(0)

    def history(self, as_of: str, lookback: int | None, codes: DataFrame) -> tuple[DataFrame, str | None]:
        """What a value of ``codes`` on their last date up to ``as_of`` needs, and that date: the rows from the earliest
        date that lies ``lookback`` rows back for one of the codes on that day. A code may miss sessions, so the
        rows of the day say where to begin."""
        codes = codes.select("code").distinct()
        stop = self.session(as_of)
        periods = sorted({self.period(s) for s in self.sessions if stop and s <= stop}, reverse=True)
        for period in periods:       # almost always one
            part = self.df.sparkSession.table(self.table).filter(F.col("period") == period)
            part = part.filter(F.col("date") <= F.lit(stop).cast("timestamp")).join(codes, "code", "left_semi")
            steps = [n for n in LADDER if lookback is not None and n >= lookback]
            start = F.min(F.col(f"back_{steps[0]}") if steps else F.lit(None).cast("timestamp"))
            found = part.groupBy("date").agg(start.alias("start")).orderBy(F.col("date").desc()).select(
                F.date_format("date", DAY).alias("date"), F.date_format("start", DAY).alias("start")).first()
            if found is not None:
                start = found["date"] if lookback == 0 else found["start"]
                return self.between(start, found["date"]).join(codes, "code", "left_semi"), found["date"]
        return self.df.limit(0), None


DAY = "yyyy-MM-dd HH:mm:ss"
_STORED: dict[tuple[str, str, str], Panel] = {}


ROWS_PER_BUCKET = 1_500_000     # facts that a task sorts, a few hundred MB
MOST_OF_CODE = ROWS_PER_BUCKET  # facts of one code that are sorted in one task


def bucket_count(spark: SparkSession, fact_rows: int) -> int:
    """Buckets by input size, and enough of them to occupy the cores on small inputs."""
    by_size = -(-fact_rows // ROWS_PER_BUCKET)
    by_cores = min(spark.sparkContext.defaultParallelism, -(-fact_rows // 5_000))
    return max(1, by_size, by_cores)


def period_months(fact_rows: int) -> int:
    """Longer periods for small inputs, whose files would be too small."""
    return 12 if fact_rows < 250_000_000 else 3 if fact_rows < 1_000_000_000 else 1


def store(spark: SparkSession, name: str, key: str, facts: DataFrame, code: str, build, finish=None) -> Panel:
    """Write the panel on first use in this application, then reuse the table.

    ``build`` takes the facts and the number of buckets they are dealt into by code, or None where a code (a column of
    the facts) has more of them than a task should sort; ``finish`` adds columns that need a code's whole history, after
    the shuffle by code.
    """
    # A changed input has another size or other files, and is another panel.
    files = [f for f in facts.inputFiles()]
    fact_rows = facts.count()       # reads file footers only
    slot = (spark.sparkContext.applicationId, name, f"{key} {fact_rows} {hash(tuple(sorted(files)))}")
    if slot not in _STORED:
        buckets, months = bucket_count(spark, fact_rows), period_months(fact_rows)
        path = run_dir(spark, name)
        table = "tidepanel_" + path.rsplit("-", 1)[1]
        most = facts.groupBy(code).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
        if most > MOST_OF_CODE:
            rows = build(facts, None).repartition(buckets, "code")
        else:
            rows = build(facts, buckets)
        rows = rows if finish is None else finish(rows)
        line, first = Window.partitionBy("code").orderBy("date"), F.min("date").over(Window.partitionBy("code"))
        shown = rows.columns
        rows = rows.withColumns({f"back_{n}": F.coalesce(F.lag("date", n).over(line), first) for n in LADDER} | {
            "period": F.floor((F.year("date") * 12 + F.month("date") - 1) / months).cast("int")})
        rows.write.partitionBy("period").bucketBy(buckets, "code").sortBy("code", "date").option("path", path).saveAsTable(table)
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS NOSCAN")      # else its size counts as unknown
        df = spark.table(table).select(*shown)
        # At most MAX_SESSIONS rows.
        days = df.groupBy("date").count().select(F.date_format("date", DAY).alias("day"), "count").collect()
        _STORED[slot] = Panel(df, sum(d["count"] for d in days), table, buckets, months, tuple(sorted(d["day"] for d in days)))
    return _STORED[slot]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_number(*parts: tuple[Column, int]) -> Column:
    """Columns (non-negative integers, with their number of digits) as one number that
    sorts like the tuple. A number keeps first/last aggregates in hash aggregation,
    where a struct key would sort all facts before they are combined. A value outside
    its digits fails the job, as it would change the order silently."""
    total, shift = None, 0
    for value, digits in reversed(parts):
        unit = F.lit("1" + "0" * shift).cast("decimal(38,0)")
        fits = value.isNull() | value.between(0, 10 ** digits - 1)
        value = F.when(fits, value).otherwise(F.raise_error(F.lit(f"an order value needs more than {digits} digits")))
        term = (value.cast("decimal(38,0)") * unit).cast("decimal(38,0)")
        total = term if total is None else (term + total).cast("decimal(38,0)")
        shift += digits
    if shift > 38:
        raise ValueError("order key does not fit 38 digits")
    return total


def price_panel(facts: DataFrame, day: Column, code: Column, price: Column, order: tuple[tuple[Column, int], ...],
                last: dict[str, Column], aggs: dict[str, Column], buckets: int | None) -> DataFrame:
    """Open, high, low and close per (date, code) from ordered facts; ``order`` is as for ``order_number``.

    With ``buckets`` the facts' own columns are shuffled once, by code, and a task sorts its codes' facts: most groups
    have few facts, so that combining them map-side would shuffle more than the facts and spill. Without, all aggregates
    have numeric buffers and combine map-side, so a code with a large share of the facts is reduced to one row per
    date before anything is shuffled.
    """
    rows = facts.select("*", day.alias("date"), code.alias("code")).filter("date IS NOT NULL")
    if buckets is None:
        place = order_number(*order)
    else:
        rows = rows.repartition(buckets, "code")
        known = reduce(and_, [v.isNotNull() for v, _ in order])
        place = F.when(known, F.struct(*[v.alias(f"o{i}") for i, (v, _) in enumerate(order)]))
    rows = rows.select("*", price.alias("_price"), place.alias("_order"), *[v.alias(f"_{k}") for k, v in last.items()])
    made = rows.groupBy("code", "date").agg(
        F.min_by("_price", "_order").alias("open"), F.max_by("_price", "_order").alias("close"),
        F.max("_price").alias("high"), F.min("_price").alias("low"),
        *[F.max_by(f"_{k}", "_order").alias(k) for k in last], *[v.alias(k) for k, v in aggs.items()])
    return made.select("date", "code", *made.columns[2:])


def weekly_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Weekly supplier panel from line items."""
    item = read(spark, sf_dir, "lineitem")

    def build(item, buckets):
        supplier = read(spark, sf_dir, "supplier")
        nation = read(spark, sf_dir, "nation")
        week = F.date_trunc("week", session_day("l_shipdate"))
        # Ship dates are whole days; the digits leave room for a trillion orders.
        order = ((F.datediff("l_shipdate", week), 1), (F.col("l_orderkey"), 12), (F.col("l_linenumber"), 1),
                 (F.col("l_partkey"), 12), (F.round(F.col("l_extendedprice") * 100).cast("bigint"), 10))
        panel = price_panel(
            item, week, zero_pad(F.col("l_suppkey").cast("string")), ratio("l_extendedprice", "l_quantity"), order,
            {"Ifsuspend": F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0),
             "status": F.ascii("l_linestatus")},
            {"volume": F.sum("l_quantity"),
             "amount": F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"),
             "first_ship": F.min("l_shipdate")}, buckets)
        groups = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            zero_pad(F.col("s_suppkey").cast("string")).alias("code"), F.col("s_nationkey").cast("int").alias("industry"),
            F.col("n_regionkey").cast("int").alias("sector"))
        return panel.withColumn("category", F.char("status")).drop("status").join(groups, "code", "left")

    def listed(panel):
        first = F.min("first_ship").over(Window.partitionBy("code"))
        return panel.withColumn("ListedDate", first).drop("first_ship")
    return store(spark, "weekly", sf_dir, item, "l_suppkey", build, listed)


def daily_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Daily user panel from events."""
    events = read(spark, sf_dir, "events")

    def build(events, buckets):
        def seen(kind):
            return F.max(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
        ts = F.col("ts").cast("timestamp")
        return price_panel(
            events, session_day("ts"),
            zero_pad(F.col("user_id").cast("string")), F.col("value"),
            ((F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts)), 11), (F.col("event_id"), 18)), {},
            {"volume": F.count(F.lit(1)).cast("double"),
             "amount": F.sum(F.col("value").cast("decimal(18,2)")).cast("double"),
             "Ifsuspend": seen("error"), "if_up": seen("purchase"), "if_down": seen("signup")}, buckets)
    return store(spark, "daily", sf_dir, events, "user_id", build)
