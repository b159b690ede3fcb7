"""Correlations of every pair of many factors, by blocks of factors.

A row's factors are one array. The array is cut into blocks, a row is dealt once for each pair of blocks, and a task
adds up products and flags of presence of the rows of a group as matrix products, batch by batch, so that it holds
one block of sums and not the group. Plans do not grow with the number of factors. Pairs are complete: a
row counts for a pair if both factors are there. A group of very many rows is dealt over several tasks, whose
sums are put together by their means.

Ranks depend on the rows of a pair, that is, on where both factors are present. They are made once for each
factor and each different set of such rows: factors that are present on the same rows share one, and so does a pair
of which one factor is present wherever the other is. All of a factor's ranks come from one sort. Values and ranks are
shuffled as packed arrays, a few hundred or thousand to a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import ratio
from ..functions.stats import paired
from ..session import cut

BLOCK = 256
ROWS_PER_TASK = 200_000
NARROW = 8                # entries whose sums are plain aggregates, which combine map-side
ROWS_PER_RANGE = 500_000  # values of a factor that are sorted at once
STRIDE = 64               # sampled rows to a range
SAMPLED = 4_000_000       # sampled values at most; beyond, ranges get longer
ROWS_PER_CHUNK = 65_536   # rows whose ranks are put together
CELLS_PER_CHUNK = 2_000_000
SUMS = ("n", "mx", "my", "vx", "vy", "cxy")


class _Sums:
    """Sums of a pair of blocks over batches, around each column's first value."""

    def __init__(self, a: int, b: int):
        self.zero = None
        self.sums = [np.zeros((a, b)) for _ in range(6)]

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if self.zero is None:
            self.zero = [np.full(m.shape[1], np.nan) for m in (x, y)]
        sides = []
        for k, m in enumerate((x, y)):
            there = ~np.isnan(m)
            new = np.isnan(self.zero[k]) & there.any(0)
            self.zero[k][new] = m[there.argmax(0)[new], np.flatnonzero(new)]
            sides.append((there.astype(float), np.where(there, m - self.zero[k], 0.0)))
        (px, x), (py, y) = sides
        for total, more in zip(self.sums, (px.T @ py, x.T @ py, px.T @ y, (x * x).T @ py, px.T @ (y * y), x.T @ y)):
            total += more

    def rows(self, first: int, second: int) -> list[np.ndarray]:
        """i, j, n, means, sums of squared deviations and of products, of the pairs i < j that have rows."""
        i, j = np.meshgrid(np.arange(self.sums[0].shape[0]) + first, np.arange(self.sums[0].shape[1]) + second, indexing="ij")
        keep = (i < j) & (self.sums[0] > 0)
        n, sx, sy, sxx, syy, sxy = (s[keep] for s in self.sums)
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        i, j = i[keep], j[keep]
        return [i.astype(np.int32), j.astype(np.int32), n, self.zero[0][i - first] + sx / n, self.zero[1][j - second] + sy / n,
                np.where(vx <= 1e-13 * sxx, 0.0, vx), np.where(vy <= 1e-13 * syy, 0.0, vy), sxy - sx * sy / n]


def _sums(keys: int):
    def run(batches):
        held, sums, spot, key = None, None, None, None

        def made():
            lists = sums.rows(*spot)
            return pa.RecordBatch.from_arrays(
                [*key, *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in lists]],
                names=[*[f"k{i}" for i in range(keys)], "i", "j", *SUMS])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column(keys).to_numpy()
            starts = np.flatnonzero(np.diff(marks, prepend=marks[0] ^ 1))
            for a, b in zip(starts, [*starts[1:], len(marks)]):
                part = batch.slice(a, b - a)
                if marks[a] != held:
                    if sums is not None:
                        yield made()
                    held, key = marks[a], [c.slice(0, 1) for c in part.columns[:keys]]
                    spot = part.column(keys + 1)[0].as_py(), part.column(keys + 2)[0].as_py()
                    sums = None
                x, y = (part.column(keys + k).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                        for k in (3, 4))
                sums = sums or _Sums(x.shape[1], y.shape[1])
                sums.add(x, y)
        if sums is not None:
            yield made()
    return run


def _together(a: Column, b: Column) -> Column:
    """Sums of two parts of a group, by the distance of their means."""
    n = a["n"] + b["n"]
    dx, dy, share = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * b["n"] / n
    made = {"n": n, "mx": a["mx"] + dx * b["n"] / n, "my": a["my"] + dy * b["n"] / n, "vx": a["vx"] + b["vx"] + dx * dx * share,
            "vy": a["vy"] + b["vy"] + dy * dy * share, "cxy": a["cxy"] + b["cxy"] + dx * dy * share}
    return F.struct(*[made[k].alias(k) for k in SUMS])


def moments(df: DataFrame, x: str, width: int, by) -> DataFrame:
    """(by, i, j, n, mx, my, vx, vy, cxy) of the pairs i < j of the entries of the array ``x`` (at most ``width``), over
    the rows of a group where both are there: rows, means, sums of squared deviations and of products."""
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.agg(F.max("rows")).first()[0] or 0
    salts = -(-most // ROWS_PER_TASK)
    count = -(-width // BLOCK)
    rows = df.select(*by, F.col(x).alias("_x"))
    spots = F.array(*[F.struct(F.lit(a * BLOCK).alias("a"), F.lit(b * BLOCK).alias("b")) for a in range(count) for b in range(a, count)])
    rows = rows.withColumn("_spot", F.explode(spots)).withColumns({
        "_a": F.col("_spot.a"), "_b": F.col("_spot.b"),
        "_mark": F.xxhash64(*by, "_spot", F.pmod(F.xxhash64("_x"), F.lit(max(1, salts))) if salts > 1 else F.lit(0))})
    part = lambda at: F.slice(F.col("_x"), F.col(at) + 1, F.lit(BLOCK))
    rows = rows.select(*by, "_mark", "_a", "_b", part("_a").alias("_left"), part("_b").alias("_right"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"k{k} {f.dataType.simpleString()}" for k, f in enumerate(rows.schema.fields[:len(by)]))
    lists = ", ".join(f"{n} array<{t}>" for n, t in (("i", "int"), ("j", "int"), *[(n, "double") for n in SUMS]))
    made = rows.repartition(tasks, "_mark").sortWithinPartitions("_mark").mapInArrow(_sums(len(by)), f"{kinds}, {lists}")
    found = made.select(*[F.col(f"k{k}").alias(b) for k, b in enumerate(by)], F.inline(F.arrays_zip("i", "j", *SUMS)))
    if salts > 1:
        parts = F.sort_array(F.collect_list(F.struct(*SUMS)))
        found = found.groupBy(*by, "i", "j").agg(parts.alias("parts")).select(*by, "i", "j", F.aggregate(
            F.slice("parts", 2, salts), F.col("parts")[0], _together).alias("m")).select(*by, "i", "j", "m.*")
    return found.withColumn("n", F.col("n").cast("bigint"))


def _moments_of_few(df: DataFrame, x: str, width: int, by) -> DataFrame:
    """``moments``; of few entries by aggregates of each pair, so that rows are not shuffled."""
    by = list(by)
    if not 2 <= width <= NARROW:
        return moments(df, x, width, by)
    held = df.select(*by, *[F.get(F.col(x), F.lit(i)).alias(f"_{i}") for i in range(width)])
    cells = []
    for i, j in combinations(range(width), 2):
        px, py = paired(f"_{i}", f"_{j}")
        n = F.count(px)
        cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), n.alias("n"), F.avg(px).alias("mx"), F.avg(py).alias("my"),
                              (F.var_pop(px) * n).alias("vx"), (F.var_pop(py) * n).alias("vy"), (F.covar_pop(px, py) * n).alias("cxy")))
    return held.groupBy(*by).agg(F.array(*cells).alias("m")).select(*by, F.inline("m")).filter("n > 0")


def pearson(min_pairs: int, floor: float | None = None) -> Column:
    """Correlation from ``moments``: NULL for too few rows; without variation NULL, or with a floor of the deviations 0."""
    sx, sy = (F.sqrt(F.col(v) / F.col("n")) for v in ("vx", "vy"))
    value = ratio(F.col("cxy") / F.col("n"), sx * sy)
    value = value if floor is None else F.when((sx < floor) | (sy < floor), 0.0).otherwise(value)
    return F.when(F.col("n") >= min_pairs, value)


def _named(df: DataFrame, names) -> DataFrame:
    held = F.array(*[F.lit(n) for n in names])
    return df.withColumns({"f1": F.get(held, F.col("i")), "f2": F.get(held, F.col("j"))}).drop("i", "j")


def correlations(wide: DataFrame, factors, by=("date",), min_pairs: int = 3, floor: float | None = None) -> DataFrame:
    """(by, f1, f2, ic, pairs) of every pair of factors in each group, f1 before f2 as listed."""
    rows = wide.select(*by, F.array(*[F.col(f).cast("double") for f in factors]).alias("x"))
    found = _moments_of_few(rows, "x", len(factors), by).withColumn("ic", pearson(min_pairs, floor))
    return _named(found, factors).select(*by, "f1", "f2", "ic", F.col("n").alias("pairs"))


def mutual_ic(zscores: DataFrame, factors, floor: float = 1e-3) -> DataFrame:
    """Mean daily correlation of each pair of filled z-scores (no NULLs)."""
    return correlations(zscores, factors, ("date",), 2, floor).groupBy("f1", "f2").agg(
        F.avg("ic").alias("mutual_ic"), F.count("ic").alias("usable_dates"))


def _matrix(column) -> np.ndarray:
    """The arrays of a batch as rows of a matrix, NULL as a masked value."""
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return np.ma.MaskedArray(x, flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape))


def _present(batches):
    """For every two factors the number of rows of a task on which both are there, as one matrix."""
    total = None
    for batch in batches:
        if batch.num_rows:
            there = (~np.ma.getmaskarray(_matrix(batch.column(0)))).astype(float)
            total = there.T @ there + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size, dtype=np.int32), "n": total.ravel().astype(np.int64)})


def _presence(rows: DataFrame, width: int) -> tuple[list, dict]:
    """The set of rows on which each factor is present (factors of equal sets have the same number), and for two sets
    the number of their common rows."""
    found = rows.select("x").mapInArrow(_present, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(width * width, dtype=np.int64)
    for r in found:
        both[r["at"]] = r["n"]
    both = both.reshape(width, width)
    first, sets = [], []
    for a in range(width):
        same = (s for s, b in enumerate(first) if both[a, b] == both[a, a] == both[b, b])
        sets.append(next(same, len(first)) if both[a, a] else None)
        if sets[a] == len(first):
            first.append(a)
    return sets, {(p, q): int(both[a, b]) for p, a in enumerate(first) for q, b in enumerate(first) if p <= q}


@dataclass
class _Nests:
    """What tasks know when they rank factors in several sets of rows. A span is the common rows of two sets. A factor's
    values are cut into slots: an even one is a range between cuts, an odd one a frequent value, itself a cut."""
    first: list             # a factor of each set
    spans: list             # two sets
    rows: list              # of each span
    members: list           # factors of each span
    of: list                # spans of each factor
    cuts: list = field(default_factory=list)        # of each factor
    alone: list = field(default_factory=list)       # of each factor: which cuts are frequent values
    held: list = field(default_factory=list)        # of each factor: rows by slot and span
    before: list = field(default_factory=list)      # rows in the slots before

    def cells(self, x, f: int):
        """Place in the chunk, value, slot and presence of each set, of the rows that have the factor."""
        there = ~np.ma.getmaskarray(x)
        at = np.flatnonzero(there[:, f])
        v = x.data[at, f]
        slot = np.searchsorted(self.cuts[f], v, side="right") * 2
        if self.alone[f].any():
            last = np.maximum(slot // 2 - 1, 0)
            slot = slot - ((slot > 0) & self.alone[f][last] & (self.cuts[f][last] == v))
        return at, v, slot, there[at][:, self.first]

    def inside(self, sets, f: int):
        """Membership of each span of the factor."""
        return np.stack([sets[:, p] & sets[:, q] for p, q in (self.spans[s] for s in self.of[f])], axis=1)

    def ranked(self, f: int, slot: int, v, sets):
        """Twice the rank less the span's mean rank (whole numbers), by row and span; 0 outside a span."""
        inside, n = self.inside(sets, f), np.array([self.rows[s] for s in self.of[f]])
        if slot % 2:
            places = np.broadcast_to(2 * self.before[f][slot] + self.held[f][slot] - n, inside.shape)
            return np.where(inside, places, 0)
        order = np.argsort(v, kind="stable")
        v = v[order]
        new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))))
        upto = np.concatenate([np.zeros((1, len(n)), dtype=np.int64), np.cumsum(inside[order], axis=0, dtype=np.int64)])
        ends = np.append(new[1:], len(v))
        places = np.repeat(upto[new] + upto[ends] + 2 * self.before[f][slot] - n, ends - new, axis=0)
        made = np.empty_like(places)
        made[order] = places
        return np.where(inside, made, 0)


def _chunks(batches, size: int):
    """The rows of a task, so many at a time."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            x = _matrix(batch.column(0).slice(start, size))
            if held and n + len(x) > size:
                yield np.ma.concatenate(held)
                held, n = [], 0
            held.append(x)
            n += len(x)
    if held:
        yield np.ma.concatenate(held)


def _slot_rows(nests: _Nests, size: int):
    """Rows of each factor, slot and span in a task."""
    def run(batches):
        held = [np.zeros((2 * len(c) + 1, len(s)), dtype=np.int64) for c, s in zip(nests.cuts, nests.of)]
        for x in _chunks(batches, size):
            for f, spans in enumerate(nests.of):
                if spans:
                    _, _, slot, sets = nests.cells(x, f)
                    for k, inside in enumerate(nests.inside(sets, f).T):
                        held[f][:, k] += np.bincount(slot[inside], minlength=len(held[f]))
        for f, m in enumerate(held):
            slot, k = np.nonzero(m)
            if len(slot):
                yield pa.RecordBatch.from_pydict({"f": np.full(len(slot), f, np.int32), "slot": slot.astype(np.int32),
                                                  "k": k.astype(np.int32), "n": m[slot, k]})
    return run


def _dealt(nests: _Nests, size: int):
    """Values of each chunk of rows by factor and slot, one packed row for each; those of frequent values go to any task."""
    def run(batches):
        base = np.cumsum([0, *[2 * len(c) + 1 for c in nests.cuts]])
        part = TaskContext.get().partitionId()
        for number, x in enumerate(_chunks(batches, size)):
            chunk = (part << 32) + number
            for f, spans in enumerate(nests.of):
                if not spans:
                    continue
                at, v, slot, sets = nests.cells(x, f)
                order = np.argsort(slot, kind="stable")
                at, v, slot, sets = at[order].astype(np.int32), v[order], slot[order], np.packbits(sets[order], axis=1)
                starts = np.flatnonzero(np.diff(slot, prepend=-1))
                cuts = [*zip(starts, [*starts[1:], len(slot)])]
                slots = slot[starts]
                yield pa.RecordBatch.from_pydict({
                    "spot": np.where(slots % 2, -1 - chunk, base[f] + slots), "f": np.full(len(cuts), f, np.int32),
                    "slot": slots.astype(np.int32), "chunk": np.full(len(cuts), chunk),
                    **{name: pa.array([m[a:b].tobytes() for a, b in cuts], pa.binary()) for name, m in (
                        ("at", at), ("v", v), ("sets", sets))}})
    return run


def _ranked(nests: _Nests, part: int):
    """Ranks of each factor and slot of a task, packed by chunk (cut into parts of so many rows)."""
    def run(batches):
        spots = {}
        for batch in batches:
            for f, slot, *row in zip(*[batch.column(k).to_pylist() for k in ("f", "slot", "chunk", "at", "v", "sets")]):
                spots.setdefault((f, slot), []).append(row)
        wide = -(-len(nests.first) // 8)
        kind = np.int32 if max(nests.rows) < 2 ** 31 else np.int64
        for f, slot in sorted(spots):
            chunks, *packed = zip(*spots.pop((f, slot)))
            at, v, sets = (np.frombuffer(b"".join(b), t) for b, t in zip(packed, (np.int32, float, np.uint8)))
            sets = np.unpackbits(sets.reshape(-1, wide), axis=1, count=len(nests.first)).astype(bool)
            ranks = nests.ranked(f, slot, v, sets).astype(kind)
            key = np.repeat(np.arange(len(chunks)), [len(b) // 4 for b in packed[0]])
            starts = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(at // part, prepend=-1) != 0))
            made = [(chunks[key[a]], int(at[a]) // part, f, (at[a:b] % part).tobytes(), ranks[a:b].tobytes())
                    for a, b in zip(starts, [*starts[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (
                pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "part", "f", "at", "ranks"])
    return run


def _products(nests: _Nests, part: int):
    """Sums of products of the ranks of a span's factors, over the chunks of a task."""
    def run(batches):
        kind = np.int32 if max(nests.rows) < 2 ** 31 else np.int64
        chunks, sums = {}, [np.zeros((len(m), len(m))) for m in nests.members]
        for batch in batches:
            for chunk, at, *row in zip(*[batch.column(k).to_pylist() for k in ("chunk", "part", "f", "at", "ranks")]):
                chunks.setdefault((chunk, at), []).append(row)
        while chunks:
            _, held = chunks.popitem()
            ranks = {f: np.zeros((part, len(nests.of[f])), kind) for f in {f for f, _, _ in held}}
            for f, at, made in held:
                ranks[f][np.frombuffer(at, np.int32)] = np.frombuffer(made, kind).reshape(-1, len(nests.of[f]))
            for s, members in enumerate(nests.members):
                here = [i for i, f in enumerate(members) if f in ranks]
                if here:
                    x = np.stack([ranks[members[i]][:, nests.of[members[i]].index(s)] for i in here], axis=1).astype(float)
                    sums[s][np.ix_(here, here)] += x.T @ x
        for s, m in enumerate(sums):
            i, j = np.nonzero(m)
            if len(i):
                yield pa.RecordBatch.from_pydict({"span": np.full(len(i), s, np.int32), "i": i.astype(np.int32),
                                                  "j": j.astype(np.int32), "s": m[i, j]})
    return run


def _cut(nests: _Nests, rows: DataFrame, total: int, rows_per_range: int, size: int) -> None:
    """Cuts of the factors from a bounded sample of rows; rows of the slots are counted, so that ranks never rest on it."""
    width = len(nests.of)
    least = max(rows_per_range * NARROW // max(NARROW, *map(len, nests.of)), 1)
    ranges = min(-(-total // least), SAMPLED // (STRIDE * width) + 1)
    nests.cuts, nests.alone = [np.zeros(0)] * width, [np.zeros(0, dtype=bool)] * width
    if ranges > 1:
        drawn = rows.filter(F.rand(7) < F.lit(ranges * STRIDE / total)).select("x").toArrow().column(0).combine_chunks()
        drawn = _matrix(drawn) if len(drawn) else np.ma.masked_all((0, width))
        for f in range(width):
            v, times = np.unique(drawn[:, f].compressed(), return_counts=True)
            often = times * 8 >= STRIDE
            # A cut where the drawn rows between frequent values fill another range.
            full = np.cumsum(np.where(often, 0, times)) // STRIDE
            keep = often | (np.diff(full, prepend=0) > 0)
            nests.cuts[f], nests.alone[f] = v[keep], often[keep]
    nests.held = [np.zeros((2 * len(c) + 1, len(s)), dtype=np.int64) for c, s in zip(nests.cuts, nests.of)]
    if any(map(len, nests.cuts)):
        counted = rows.select("x").mapInArrow(_slot_rows(nests, size), "f int, slot int, k int, n bigint")
        for r in counted.groupBy("f", "slot", "k").agg(F.sum("n").alias("n")).collect():
            nests.held[r["f"]][r["slot"], r["k"]] = r["n"]
    nests.before = [np.cumsum(h, axis=0) - h for h in nests.held]


def pooled_spearman(wide: DataFrame, factors, rows_per_range: int = ROWS_PER_RANGE, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Pooled rank correlation per factor pair over the rows where both are present.

    A factor is sorted once, in ranges, for all sets of rows that it is ranked in: its rank in one is the number of rows
    of the set up to it. Ranks go back to their rows by chunks, where their products are added up.
    """
    factors = list(factors)
    rows = cut(wide.select(F.array(*[F.col(f).cast("double") for f in factors]).alias("x")), "factors")
    sets, common = _presence(rows, len(factors))
    # What each pair's common rows are: those of one of its sets, or of two sets together.
    spans, pairs, members = {}, [], {}
    for a, b in combinations(range(len(factors)), 2):
        if sets[a] is None or sets[b] is None:
            continue
        p, q = sorted((sets[a], sets[b]))
        n = common.get((p, q), 0)
        if n:
            span = spans.setdefault((p, p) if n == common[p, p] else (q, q) if n == common[q, q] else (p, q), len(spans))
            pairs.append((span, a, b, n))
            members.setdefault(span, set()).update((a, b))
    schema = "f1 string, f2 string, spearman double, pairs bigint"
    if not pairs:
        return wide.sparkSession.createDataFrame([], schema)
    members = [sorted(members[s]) for s in range(len(spans))]
    of = [[s for s, held in enumerate(members) if f in held] for f in range(len(factors))]
    nests = _Nests([sets.index(s) for s in range(len({s for s in sets if s is not None}))], list(spans),
                   [common[p, q] for p, q in spans], members, of)
    total = max(n for n in common.values())
    size = max(1, min(rows_per_chunk, CELLS_PER_CHUNK // len(factors)))
    _cut(nests, rows, total, rows_per_range, size)
    # A chunk's ranks are put together in parts, so that a task holds few of them.
    part = max(1, min(size, CELLS_PER_CHUNK * 4 // sum(map(len, of))))
    spots, tasks = sum(2 * len(c) + 1 for c in nests.cuts), -(-total // part)
    dealt = rows.mapInArrow(_dealt(nests, size), "spot bigint, f int, slot int, chunk bigint, at binary, v binary, sets binary")
    ranks = dealt.repartition(spots, "spot").mapInArrow(_ranked(nests, part), "chunk bigint, part int, f int, at binary, ranks binary")
    sums = ranks.repartition(tasks, "chunk", "part").mapInArrow(
        _products(nests, part), "span int, i int, j int, s double").groupBy("span", "i", "j").agg(F.sum("s").alias("s"))
    asked = wide.sparkSession.createDataFrame([(s, k, members[s].index(a), members[s].index(b), factors[a], factors[b], n) for k, (s, a, b, n) in enumerate(pairs)],
                                              "span int, k int, i int, j int, f1 string, f2 string, pairs bigint")
    sides = asked.select("span", "k", "f1", "f2", "pairs", F.inline(F.array(*[F.struct(F.lit(n).alias("side"), F.col(a).alias("i"), F.col(b).alias("j")) for n, a, b in (
        ("x", "i", "i"), ("y", "j", "j"), ("xy", "i", "j"))])))
    held = {n: F.coalesce(F.sum(F.when(F.col("side") == n, F.col("s"))), F.lit(0.0)) for n in ("x", "y", "xy")}
    found = sides.join(sums, ["span", "i", "j"], "left").groupBy("k", "f1", "f2", "pairs").agg(*[v.alias(n) for n, v in held.items()])
    value = ratio(F.col("xy"), F.sqrt("x") * F.sqrt("y"))
    return found.select("f1", "f2", F.when(F.col("pairs") >= 3, value).alias("spearman"), "pairs")
