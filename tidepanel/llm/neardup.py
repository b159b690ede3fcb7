"""Near duplicates by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

* Each text becomes the set of its word shingles (64-bit hashes) and a signature of 128 16-bit MinHash values. Texts
  with equal sets are one class from here on.
* A tree of the forest is one sorted order of the signatures: it reads them from its own place on, in a cycle. Two
  classes with a common prefix of 3 values lie in one region. A region of more than ``REGION`` classes goes deeper,
  to longer common prefixes, until its parts are small enough; how deep differs from region to region. Where whole
  signatures are equal, a hash of class and tree deals the rest, differently in each tree. Of each part that a
  region falls into, one class also stays, so that the parts are compared with each other, in regions of their own.
* In a region all pairs are compared by signature, each pair in the first tree where it meets. Pairs of a promising
  estimate are then confirmed on the full sets, in the region, and the links that join something new leave it.
* Longer prefixes separate pairs. The classes of regions that were split are therefore compared a second time, by a
  join on the rarest shingles of their sets, which misses no pair of them: two sets above the threshold share one of
  the first shingles of each, in any one order of all shingles. Only shingles of several components of the links so
  far are read, so a group that is connected already costs nothing here; frequent ones are dealt into tiles.
* The least document id over a component of links names it.

With 32 trees and depth 3 a pair at similarity 0.75 misses all regions once in 10^7, as pairs of larger regions meet
in the join; the estimate, cut four deviations below the threshold, loses it once in 10^4 at the very threshold and
never in practice above. Tiles grow with the square of a group only for a shingle that is among the rarest of very
many classes in several components.

Null texts and texts without words have the empty set and are linked with nothing; texts of fewer words than a
shingle have one shingle of all their words. Repeated rows share a class. Rows with a null id take part; a component
of such rows alone has a null id. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WHITE, stored
from .components import labelled
from .wordcache import run_hashes

HASHES, TREES, REGION = 128, 32, 1024
#: Common prefix lengths that a region may take.
DEPTHS = (3, 4, 5, 6, 8, 10, 13, 16, 20, 26, 36, 52, 80, 128)
#: Counters of the sketch that orders shingles by how often they occur.
BUCKETS = 1 << 20
#: Bytes of text a worker shingles at a time (a longer text is taken whole).
STEP_BYTES = 1 << 21
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE.encode())] = True
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _MIX
    return x ^ x >> np.uint64(29)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
            size += len(texts[end])
            end += 1
        out += _sets(texts[at:end], width)
        at = end
    return out


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    white = _WHITE[raw]
    change = np.flatnonzero(np.diff(white, prepend=True))           # word, gap, word, gap ...
    borders = np.cumsum([len(t) + 1 for t in texts])
    if not len(change):
        return [np.zeros(0, np.uint64)] * len(texts)
    runs = run_hashes(raw[change[0]:], change - change[0], np.diff(change, append=len(raw)))
    words = _mixed(runs[::2])
    first = np.concatenate([[0], np.searchsorted(change[::2], borders)])
    n = len(words)
    rows = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rows = rows * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(rows)]
    rows = _mixed(rows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rows[a:b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = np.uint64((int(whole) * 0x9E3779B97F4A7C15 + int(w)) & (1 << 64) - 1)
            out.append(_mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 8192):
        least = np.minimum(least, (grams[i:i + 8192, None] * _FACTORS + _SHIFTS).min(0))
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def tree_keys(signatures: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """64-bit keys of the first ``depth`` values of each signature in the order of a tree."""
    places = (tree * DEPTHS[0] + np.arange(depth)) % HASHES
    key = np.full(len(signatures), tree * 1_000_003 + depth, np.uint64)
    for p in places:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, p])
    return key.view(np.int64)


def _signatures(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint16).reshape(len(data), HASHES)


def classes(docs: DataFrame, width: int) -> DataFrame:
    """(id, cls, n, sig, ...) of rows (id, text, ...); cls is a 128-bit digest of the shingle set, null for the empty
    set."""
    more = docs.columns[2:]

    def run(batches):
        for batch in batches:
            texts, at = [(t or "").encode() for t in batch.column(1).to_pylist()], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= STEP_BYTES):
                    size += len(texts[end])
                    end += 1
                sets = shingle_sets(texts[at:end], width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, end - at),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    *[batch.column(2 + k).slice(at, end - at) for k in range(len(more))]],
                    names=["id", "cls", "n", "sig", *more])
                at = end
    return docs.mapInArrow(run, "id long, cls binary, n long, sig binary" + "".join(f", {c} string" for c in more))


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, region, cls, own) of the classes that are not alone in their region; own regions are one for each tree.
    And the classes (cls) of regions that were split."""
    def shallow(batches):
        for batch in batches:
            sig = _signatures(batch.column(1))
            for tree in range(TREES):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(sig), tree, np.int32)), pa.array(tree_keys(sig, tree, DEPTHS[0])),
                    batch.column(0), pa.array(np.zeros(len(sig), np.int64))], names=["tree", "key", "cls", "parent"])

    spec = "tree int, key long, cls binary, parent long"

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy("tree", "key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        sized = stored(rows.join(sizes, ["tree", "key"]), "regions")
        return sized.where(F.col("size") <= REGION).drop("size"), sized.where(F.col("size") > REGION)

    def own(rows: DataFrame, level: int) -> DataFrame:
        return rows.select("tree", F.xxhash64("tree", F.lit(level), "key").alias("region"), "cls", F.lit(True).alias("own"))

    def delegates(rows: DataFrame, level: int) -> DataFrame:
        """A class of each part, in regions of the part's parent."""
        one = rows.groupBy("tree", "key", "parent").agg(F.min("cls").alias("cls"))
        parts = one.groupBy("tree", "parent").agg(F.count("*").alias("parts")).where(F.col("parts") > 1)
        share = F.when(F.col("parts") <= REGION, 0).otherwise(
            F.pmod(F.xxhash64("cls", "tree"), F.ceil(F.col("parts") / (REGION // 2))))
        return one.join(parts, ["tree", "parent"]).select(
            "tree", F.xxhash64("tree", F.lit(-level), "parent", share).alias("region"), "cls", F.lit(False).alias("own"))

    found, dense = split(nodes.select("cls", "sig").mapInArrow(shallow, spec))
    found, torn = own(found, 0), dense.select("cls").distinct()
    for level in range(1, len(DEPTHS) + 1):
        if dense.isEmpty():
            break
        if level == len(DEPTHS):
            dealt = F.xxhash64("key", F.pmod(F.xxhash64("cls", "tree"), F.ceil(F.col("size") / (REGION // 2))))
            rows = dense.select("tree", dealt.alias("key"), "cls", F.col("key").alias("parent"))
            return found.unionByName(own(rows, level)).unionByName(delegates(rows, level)), torn

        def deeper(batches, depth=DEPTHS[level]):
            for batch in batches:
                sig, tree = _signatures(batch.column(1)), batch.column(2).to_numpy()
                key = np.zeros(len(sig), np.int64)
                for t in np.unique(tree):
                    key[tree == t] = tree_keys(sig[tree == t], int(t), depth)
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(key), batch.column(0), batch.column(3)],
                                                 names=["tree", "key", "cls", "parent"])

        rows = dense.join(nodes, "cls").select("cls", "sig", "tree", F.col("key").alias("parent")).mapInArrow(deeper, spec)
        rows = stored(rows, "deeper")
        more, dense = split(rows)
        found = found.unionByName(own(more, level)).unionByName(delegates(rows, level))
    return found, torn


def by_region(batches, keys: int) -> Iterator[pa.Table]:
    """The rows of each region from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            here = tuple(c[a] for c in columns)
            if here != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def promising(sig: np.ndarray, n: np.ndarray, member: np.ndarray, tree: int, threshold: float):
    """Pairs (i, j, estimate) of a region's rows that meet here first and may be linked.

    ``member`` holds, for each row and tree, the key of its region there (0: alone)."""
    spread = 4 * (threshold * (1 - threshold) / HASHES) ** 0.5
    least, few = threshold - spread, HASHES // 4
    early = threshold - 4 * (threshold * (1 - threshold) / few) ** 0.5
    out = []
    for i in range(len(sig) - 1):
        j = np.arange(i + 1, len(sig))
        j = j[(np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]))]
        j = j[(sig[j, :few] == sig[i, :few]).mean(1) >= early] if len(j) else j
        if tree and len(j):
            j = j[~((member[j, :tree] == member[i, :tree]) & (member[i, :tree] != 0)).any(1)]
        if len(j):
            estimate = (sig[j] == sig[i]).mean(1)
            keep = estimate >= least
            out += [(i, int(b), float(e)) for b, e in zip(j[keep], estimate[keep])]
    return out


def sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(cls, grams) of at least the classes of ``wanted`` (cls), read from their texts."""
    def sets(batches):
        for batch in batches:
            made = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], width)
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in made], pa.binary()),
                pa.array([s.tobytes() for s in made], pa.binary())], names=["cls", "grams"])

    ids = nodes.join(wanted, "cls").select(F.col("id").alias("wanted")).distinct()
    return texts.join(ids, texts["id"].eqNullSafe(ids["wanted"])).select("id", "text").mapInArrow(
        sets, "cls binary, grams binary").where("cls IS NOT NULL").groupBy("cls").agg(F.first("grams").alias("grams"))


def links(nodes: DataFrame, found: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) of classes, enough of them to join what is linked."""
    limit = threshold[0] / threshold[1]
    at = found.groupBy("cls").agg(F.collect_set(F.struct("tree", "region", "own")).alias("regions")).withColumn(
        "m", F.map_from_entries(F.transform(F.filter("regions", lambda x: x.own), lambda x: F.struct(x.tree, x.region))))
    full = at.join(nodes, "cls").select("cls", "n", "sig", F.expr(
        f"transform(sequence(0, {TREES - 1}), t -> coalesce(m[t], 0L))").alias("member"), F.inline("regions"))
    order = full.select("tree", "region", "cls", "n", "sig", "member") \
        .repartition("tree", "region").sortWithinPartitions("tree", "region", "cls")

    def compare(batches):
        for t in by_region(batches, 2):
            sig = _signatures(t.column("sig"))
            member = t.column("member").combine_chunks().flatten().to_numpy().reshape(len(sig), TREES)
            pairs = promising(sig, t.column("n").to_numpy(), member, t.column("tree")[0].as_py(), limit)
            if not pairs:
                continue
            mates: dict[int, list[int]] = {}
            for i, j, e in pairs:
                mates.setdefault(i, []).append(j << 8 | int(e * 255))
                mates.setdefault(j, [])
            rows = sorted(mates)
            yield pa.RecordBatch.from_arrays([
                pa.array([t.column("tree")[0].as_py()] * len(rows), pa.int32()),
                pa.array([t.column("region")[0].as_py()] * len(rows), pa.int64()),
                pa.array(rows, pa.int32()), pa.array([t.column("cls")[i].as_py() for i in rows], pa.binary()),
                pa.array([mates[i] for i in rows], pa.list_(pa.int32()))],
                names=["tree", "region", "row", "cls", "mates"])

    asked = stored(order.mapInArrow(compare, "tree int, region long, row int, cls binary, mates array<int>"), "pairs")
    full_sets = sets_of(asked.select("cls").distinct(), nodes, texts, width)
    rows = asked.join(full_sets, "cls").select("tree", "region", "row", "cls", "mates", "grams") \
        .repartition("tree", "region").sortWithinPartitions("tree", "region", "row")

    def confirm(batches):
        for t in by_region(batches, 2):
            where = {r: k for k, r in enumerate(t.column("row").to_pylist())}
            grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
            names, parent = t.column("cls").to_pylist(), list(range(len(grams)))

            def root(k):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            pairs = [(-(m & 255), k, where[m >> 8]) for k, ms in enumerate(t.column("mates").to_pylist()) for m in ms]
            out = []
            for _, i, j in sorted(pairs):                     # likeliest first
                a, b = root(i), root(j)
                if a == b:
                    continue
                shared = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
                if threshold[1] * shared >= threshold[0] * (len(grams[i]) + len(grams[j]) - shared):
                    parent[a] = b
                    out.append((names[i], names[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    return rows.mapInArrow(confirm, "a binary, b binary")


def rare_links(nodes: DataFrame, torn: DataFrame, labels: DataFrame, texts: DataFrame, width: int,
               threshold: tuple[int, int]) -> DataFrame:
    """Confirmed links (a, b) between classes of ``torn`` (cls) that have different labels (node, label) so far.

    Of two sets, the shorter has a common shingle among its first n - ceil(2t / (1 + t) n) + 1 in a common order, the
    longer among its first n - ceil(t n) + 1. Rare shingles come first, by counts in ``BUCKETS`` buckets."""
    over, under = threshold
    sets = stored(torn.join(sets_of(torn, nodes, texts, width), "cls").join(
        labels, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("label", "cls").alias("label"), "grams"), "sets")

    def tally(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(g, np.uint64) % BUCKETS).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    # A sketch of a set size, whatever the input.
    tallied = sets.select("grams").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[tallied["bucket"].to_numpy()] = tallied["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def firsts(batches):
        counts = shared.value
        for batch in batches:
            for k, g in enumerate(batch.column(2).to_pylist()):
                grams = np.frombuffer(g, np.uint64)
                n = len(grams)
                long, short = n + over * n // -under + 1, n + 2 * over * n // -(over + under) + 1
                first = grams[np.lexsort((grams, counts[(grams % BUCKETS).astype(np.int64)]))[:long]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(first.view(np.int64)), *[pa.array([batch.column(c)[k].as_py()] * long, pa.binary()) for c in (0, 1)],
                    pa.array(np.full(long, n)), pa.array(np.arange(long) < short)], names=["gram", "cls", "label", "n", "short"])

    rows = stored(sets.select("cls", "label", "grams").mapInArrow(
        firsts, "gram long, cls binary, label binary, n long, short boolean"), "firsts")
    half = REGION // 2
    hot = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("longs"),
                                   F.count_if("short").alias("shorts")).where("low <> high AND shorts > 0").select(
        "gram", F.ceil(F.col("longs") / half).alias("longs"), F.ceil(F.col("shorts") / half).alias("shorts"))
    hot = stored(hot, "shared")
    if hot.isEmpty():
        return sets.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    rows = rows.join(hot, "gram").join(nodes.select("cls", "sig"), "cls")

    def tiles(rows: DataFrame, mine: str, other: str, short: bool) -> DataFrame:
        """Each row in a tile of its own kind, against every tile of the other kind."""
        tile = F.pmod(F.xxhash64("cls", "gram"), F.col(mine)).alias(mine)
        return rows.select("gram", tile, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
                           F.lit(short).alias("short"), "cls", "label", "n", "sig").select(
            "gram", "longs", "shorts", "short", "cls", "label", "n", "sig")

    dealt = tiles(rows.where("short"), "shorts", "longs", True).unionByName(tiles(rows, "longs", "shorts", False))
    dealt = dealt.repartition("gram", "longs", "shorts").sortWithinPartitions("gram", "longs", "shorts", "cls")
    limit = over / under
    least = limit - 4 * (limit * (1 - limit) / HASHES) ** 0.5

    def compare(batches):
        for t in by_region(batches, 3):
            short, n, sig = t.column("short").to_numpy(zero_copy_only=False), t.column("n").to_numpy(), _signatures(t.column("sig"))
            names, label = t.column("cls").to_pylist(), np.unique(t.column("label").to_pylist(), return_inverse=True)[1]
            long, out = np.flatnonzero(~short), []
            for i in np.flatnonzero(short):
                j = long[(label[long] != label[i]) & (n[long] >= n[i]) & (n[i] >= limit * n[long])]
                j = j[(sig[j] == sig[i]).mean(1) >= least] if len(j) else j
                out += [(min(names[i], names[k]), max(names[i], names[k])) for k in j]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    pairs = stored(dealt.mapInArrow(compare, "a binary, b binary").distinct(), "rare")
    one, two = (sets.select(F.col("cls").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")

    def confirm(batches):
        for batch in batches:
            x, y = ([np.frombuffer(g, np.uint64) for g in batch.column(c).to_pylist()] for c in (2, 3))
            shared = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)]
            linked = [under * s >= over * (len(p) + len(q) - s) for p, q, s in zip(x, y, shared)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (0, 1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(confirm, "a binary, b binary")


def _named(texts: DataFrame, width: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(id, cls, n, sig, ...) of every row of (id, text, ...), and (cls, label, component_id) of every class."""
    rows = stored(classes(texts, width), "classes")
    # Equal sets meet here once, combined map-side; what they share besides the id is a function of the class.
    nodes = stored(rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    found, torn = regions(nodes)
    edges = links(nodes, found, texts, width, threshold)
    torn = stored(torn, "torn")
    if torn.isEmpty():
        labels = labelled(edges)
    else:
        edges = stored(edges, "links")
        labels = stored(labelled(edges), "labels")
        more = stored(rare_links(nodes, torn, labels, texts, width, threshold), "links")
        if not more.isEmpty():
            labels = labelled(edges.unionByName(more))
    named = nodes.select("cls", "id").join(labels, nodes["cls"] == labels["node"], "left").select(
        "cls", "id", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    return rows, named.join(least, "label").select("cls", "label", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept where the id is its component's least."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, of_class = _named(texts, width, threshold)
    out = rows.select("id", "n", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                 threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """The rows of ``df``, one of each component: of those with its least id (a null id comes last), the one with the
    least digest of its text. Texts without words are in no component: one row of each id and text stays, and all
    with a null id."""
    digest = F.md5(F.col(text_col).cast("binary"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), digest.alias("digest"))
    rows, of_class = _named(texts, width, threshold)
    place = F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("digest").alias("digest"))
    one = rows.join(of_class, "cls").groupBy("label").agg(F.min(place).alias("p")).select("p.id", "p.digest", F.lit(False).alias("every"))
    wordless = rows.where("cls IS NULL").select("id", "digest", F.col("id").isNull().alias("every")).distinct()
    kept = one.unionByName(wordless).withColumnsRenamed({"id": "__id", "digest": "__digest", "every": "__every"})
    found = df.withColumn("__of", digest).join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & F.col("__of").eqNullSafe(F.col("__digest")))
    found = found.withColumn("__row", F.when(F.col("__every"), F.monotonically_increasing_id()))
    # Repeated rows; each task keeps one before they meet.
    order = Window.partitionBy("__id", "__of", "__row").orderBy(F.xxhash64(*df.columns))
    return found.withColumn("__place", F.row_number().over(order)).where("__place = 1").select(df.columns)
