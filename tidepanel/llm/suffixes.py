"""Removal of repeated substrings: every byte covered by a 200-byte string that also starts anywhere else.

Suffix arrays are built only where repeats can be, in shards of bounded size:

* Anchors: the 200-byte strings of a text, one from each byte on, are cut into runs in which the least hash of a
  48-byte gram stays the same. Equal strings have equal least hashes, so they lie in runs of the same anchor. A run
  covers its context, 276 bytes on average; every string is in one run.
* Runs are counted by gram and context hash, combined map-side. A gram seen once repeats nothing, unless its
  run holds it twice. A context seen
  twice repeats wholly, without a look at its text: copies, however many, end here.
* The texts of the other contexts, one for each distinct context, go to shards by gram; a gram with more contexts
  than a shard holds is dealt over several. Each shard sorts its suffixes by Larsson-Sadakane refinement (doubling,
  sorted groups left alone), takes common prefixes by Kasai's rule, and marks 200-byte strings that stand next to an
  equal one of another place.
* Strings of dealt grams that found no partner in their shard leave it as sorted lists of hashes, cut into ranges;
  for each range the lists of all shards of a gram are merged by binary search.

Null and empty texts have no bytes and keep the hash of nothing. Matches never cross rows; repeated rows repeat each
other. Rows with null ids take part. An empty table gives an empty table. ``length`` may be changed, at least 60.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .neardup import by_region
from .wordcache import _BYTES

GRAM = 48
#: Contexts in a shard, about, and contexts of a gram for each hash range in which its shards are merged.
SHARD, RANGE = 4096, 16384
STEP_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Symbols of 9 bits in one word of the suffix sorter.
WORD = 7


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _MIX
    return x ^ x >> np.uint64(29)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i:i + width] for each i with a whole window."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return best(x[:len(x) - rest], x[rest:]) if rest else x


class Hashes:
    """Hashes of any stretch of a byte string."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            _BYTES[raw] * _powers(_BASE, len(raw))[:-1], dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(raw))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.back[a])


def anchors(texts: list[bytes], length: int):
    """(text number, begin, size, gram hash, context hash, whether the gram is there twice) of the runs of texts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0] + [len(t) for t in texts])
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 5 + (np.zeros(0, bool),)
    of = Hashes(raw)
    starts = np.arange(len(raw) - GRAM + 1)
    gram = of(starts, starts + GRAM)
    least = _sliding(gram, length - GRAM + 1, np.minimum)                # for each string of the length
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    crossing = text[:len(least)] != text[length - 1:length - 1 + len(least)]
    least = np.where(crossing, 0, least)
    cut = np.flatnonzero(np.diff(least)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(least)]]) - 1 + length
    real = least[begin] != 0
    begin, end = begin[real], end[real]
    context = of(begin, end) + _mixed((end - begin).astype(np.uint64))
    # Places of grams that are the least of some string; a run that holds its own twice may repeat itself.
    side = np.zeros(length - GRAM, np.uint64)
    places = np.flatnonzero(_sliding(np.concatenate([side, least, side]), length - GRAM + 1, np.maximum) == gram)
    lo, hi = np.searchsorted(places, begin), np.searchsorted(places, end - GRAM, "right")
    run = np.repeat(np.arange(len(begin)), hi - lo)
    near = places[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(run))]
    twice = np.bincount(run, gram[near] == least[begin][run], len(begin)) > 1
    number = text[begin]
    return number, begin - at[number], end - begin, least[begin].view(np.int64), context.view(np.int64), twice


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in full order (Kasai's rule needs it), and the packed words of 7 symbols each.

    Larsson-Sadakane refinement: suffixes are ranked by h symbols; only groups of equal rank are sorted again, by the
    rank h places on, which doubles h.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(WORD, np.int64)])
    words = np.zeros(n, np.int64)
    for k in range(WORD):
        words = words << 9 | padded[k:k + n]
    order = np.argsort(words)
    head = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]             # a group's rank is its first place
    h = WORD
    while True:
        alone = head & np.append(head[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        members = order[places]
        ahead = members + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + second
        inner = np.argsort(key)
        order[places], key = members[inner], key[inner]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[places] = new
        rank[order[places]] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2
    return order, words


def common_prefixes(order: np.ndarray, words: np.ndarray, symbols: np.ndarray, cap: int, step: int = 16) -> np.ndarray:
    """Symbols (up to ``cap``) that each suffix shares with the one before it in order.

    By Kasai's rule a suffix shares at least one symbol less than the suffix one place to its left in the text: every
    16th place is compared from nothing, the places between go on from their left neighbour.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)

    def extend(i: np.ndarray) -> None:
        i = i[before[i] >= 0]
        for unit, words_ in ((WORD, words), (1, symbols)):
            live = i
            while len(live):
                a, b = live + shared[live], before[live] + shared[live]
                fits = (np.maximum(a, b) + unit <= n) & (shared[live] < cap)
                live, a, b = live[fits], a[fits], b[fits]
                same = words_[a] == words_[b]
                live = live[same]
                shared[live] += unit

    for k in range(step):
        i = np.arange(k, n, step)
        if k:
            shared[i] = np.maximum(shared[i - 1] - 1, 0)
        extend(i)
    return np.minimum(shared, cap)[order]


def repeated(contexts: list[bytes], place: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, whether the ``length`` bytes from each of its places also start elsewhere.

    ``place`` (context x 2) is the row and the byte there at which a context begins: one string of one place that two
    contexts share is not a repeat. A context with ``copies`` above 1 stands for several places.
    """
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    inside = np.arange(len(symbols)) - starts[owner]
    symbols[inside < sizes[owner]] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
    order, words = suffix_array(symbols)
    shared = common_prefixes(order, words, symbols, length)
    run = np.cumsum(shared < length)                                     # equal strings in a row
    whole = inside[order] + length <= sizes[owner[order]]
    run, at = run[whole], order[whole]
    # Only runs of several strings can repeat; one place counts once.
    several = np.bincount(run, minlength=1)[run] > 1
    copied = copies[owner[at]] > 1
    run, at, copied = run[several | copied], at[several | copied], copied[several | copied]
    row, byte = place[owner[at], 0], place[owner[at], 1] + inside[at]
    order = np.lexsort((byte, row, run))
    fresh = np.ones(len(order), bool)
    fresh[1:] = ((np.diff(run[order]) != 0) | (np.diff(row[order]) != 0) | (np.diff(byte[order]) != 0))
    count = np.bincount(run[order][fresh], minlength=1) + 2 * np.bincount(run, copied, minlength=1) if len(run) else run
    flag = np.zeros(len(symbols), bool)
    flag[at] = count[run] > 1
    return [flag[s:s + max(0, z - length + 1)] for s, z in zip(starts, sizes)]


def runs(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of stretches [begin, end) as disjoint runs that do not touch."""
    if not len(begins):
        return []
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(begins[1:] > ends[:-1]) + 1
    return list(zip(begins[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut - 1, [len(ends) - 1]])].tolist()))


def _spans(flag: np.ndarray, first: int, length: int) -> list[int]:
    at = np.flatnonzero(flag) + first
    return [x for pair in runs(at, at + length) for x in pair]


def find(texts: DataFrame, length: int) -> DataFrame:
    """(row, spans) of rows (row, text): flat lists begin, end, begin, end ... of bytes to remove; a row may come often."""
    def first_pass(batches):
        for batch in batches:
            rows, raws = batch.column(0).to_numpy(), [(t or "").encode() for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(raws):
                end = at + 1
                size = len(raws[at])
                while end < len(raws) and size + len(raws[end]) <= STEP_BYTES:
                    size += len(raws[end])
                    end += 1
                number, pos, size, gram, context, twice = anchors(raws[at:end], length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram), pa.array(context), pa.array(rows[at:end][number], pa.int64()),
                    pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(twice)],
                    names=["gram", "context", "row", "pos", "size", "twice"])
                at = end

    found = stored(texts.mapInArrow(first_pass, "gram long, context long, row long, pos int, size int, twice boolean"), "anchors")
    distinct = found.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.first("row").alias("row"), F.first("pos").alias("pos"), F.first("size").alias("size"),
        F.max("twice").alias("twice"))
    # A gram's distinct contexts, small rows without text, are counted map-side too.
    grams = distinct.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("contexts"),
                                         F.min("n").alias("rarest"), F.max("twice").alias("twice")).where(
        (F.col("total") > 1) | F.col("twice"))
    wanted = stored(distinct.drop("twice").join(grams, "gram").drop("total"), "contexts")

    # Contexts seen twice or more: all their strings repeat.
    twice = found.join(wanted.where(F.col("n") > 1).select("gram", "context"), ["gram", "context"])
    whole = twice.select("row", F.array(F.col("pos").cast("long"), (F.col("pos") + F.col("size")).cast("long")).alias("spans"))

    # The others' texts, by row.
    asked = wanted.where(((F.col("contexts") > 1) | F.col("twice")) & (F.col("rarest") == 1))
    shard = F.when(F.col("contexts") > SHARD, F.pmod(F.xxhash64("row", "pos"), F.ceil(F.col("contexts") / SHARD) + 1)
                   ).otherwise(-1)
    total = asked.count()
    shards = max(1, -(-total // SHARD))
    asked = asked.withColumn("part", shard).withColumn("shard", F.when(F.col("part") < 0, F.pmod(
        F.xxhash64("gram"), F.lit(shards))).otherwise(F.col("gram")))
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct("shard", "part", "pos", "size", "n", F.ceil(
        F.col("contexts") / RANGE).alias("ranges"))).alias("asked"))

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for row, text, want in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for w in want:
                    lo = w["pos"]
                    for column, value in zip(out, (w["shard"], w["part"], row, lo, w["n"], w["ranges"],
                                                     data[lo:lo + w["size"]])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 6 + [pa.binary()])],
                names=["shard", "part", "row", "lo", "n", "ranges", "bytes"])

    pieces = texts.join(by_row, "row").select("row", "text", "asked").mapInArrow(
        cut, "shard long, part long, row long, lo long, n long, ranges long, bytes binary")
    sharded = pieces.repartition("shard", "part").sortWithinPartitions("shard", "part")

    def within(batches):
        for t in by_region(batches, 2):
            row, lo, n = (t.column(c).to_numpy() for c in ("row", "lo", "n"))
            texts_ = t.column("bytes").to_pylist()
            flags = repeated(texts_, np.column_stack([row, lo]), n, length)
            part, gram = t.column("part")[0].as_py(), t.column("shard")[0].as_py()
            spans = [(int(r), _spans(f, int(b), length)) for r, b, f, k in zip(row, lo, flags, n) if k == 1]
            spans = [s for s in spans if s[1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.list_(pa.int64())),
                pa.nulls(len(spans), pa.int64()), pa.nulls(len(spans), pa.int32()),
                pa.nulls(len(spans), pa.list_(pa.int64())), pa.nulls(len(spans), pa.list_(pa.int64())),
                pa.nulls(len(spans), pa.list_(pa.int64()))], names=["row", "spans", "gram", "range", "hash", "rows", "at"])
            if part < 0:
                continue
            # One string of each kind that the shard holds goes on, sorted by hash.
            raw = np.frombuffer(b"".join(texts_), np.uint8)
            of = Hashes(raw)
            begin = np.cumsum([0] + [len(x) for x in texts_])
            at = np.concatenate([begin[k] + np.arange(len(f)) for k, f in enumerate(flags)])
            owner = np.repeat(np.arange(len(flags)), [len(f) for f in flags])
            hashes = of(at, at + length)
            hashes, index = np.unique(hashes, return_index=True)
            single = ~np.concatenate(flags)[index]
            owner, byte = owner[index], lo[owner[index]] + (at[index] - begin[owner[index]])
            ranges = np.uint64(t.column("ranges")[0].as_py())
            band = ((hashes >> np.uint64(32)) * ranges >> np.uint64(32)).astype(np.int64)
            for r in np.unique(band):
                k = band == r
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([gram], pa.int64()),
                    pa.array([int(r)], pa.int32()), pa.array([hashes[k].view(np.int64)], pa.list_(pa.int64())),
                    pa.array([np.where(single[k], row[owner[k]], -1)], pa.list_(pa.int64())),
                    pa.array([byte[k]], pa.list_(pa.int64()))],
                    names=["row", "spans", "gram", "range", "hash", "rows", "at"])

    parts = stored(sharded.mapInArrow(within, "row long, spans array<long>, gram long, range int, hash array<long>, "
                                              "rows array<long>, at array<long>"), "repeats")

    def across(batches):
        for t in by_region(batches, 2):
            lists = [(np.array(h, np.int64).view(np.uint64), np.array(r, np.int64), np.array(a, np.int64)) for h, r, a in zip(
                *(t.column(c).to_pylist() for c in ("hash", "rows", "at")))]
            for k, (hashes, rows, at) in enumerate(lists):
                hit = np.zeros(len(hashes), bool)
                for j, (other, _, _) in enumerate(lists):
                    if j != k:
                        near = np.minimum(np.searchsorted(other, hashes), len(other) - 1)
                        hit |= other[near] == hashes
                hit &= rows >= 0                          # strings with a partner at home are marked already
                if hit.any():
                    rows, at = rows[hit], at[hit]
                    which = np.unique(rows)
                    spans = [[x for p in runs(np.sort(at[rows == r]), np.sort(at[rows == r]) + length) for x in p] for r in which]
                    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(spans, pa.list_(pa.int64()))],
                                                     names=["row", "spans"])

    merged = parts.where("gram IS NOT NULL").select("gram", "range", "hash", "rows", "at") \
        .repartition("gram", "range").sortWithinPartitions("gram", "range") \
        .mapInArrow(across, "row long, spans array<long>")
    return whole.unionByName(parts.where("row IS NOT NULL").select("row", "spans")).unionByName(merged)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   keep_text: bool = False, plain_files: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with ``keep_text`` also the spans and the bytes left.

    Row numbers must be the same in every pass. They follow the files' splits if ``plain_files`` promises that ``df``
    reads files as they are; else the numbered rows are stored first."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not plain_files:
        rows = stored(rows, "numbered")
    spans = find(rows.select("row", "text"), length).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def finish(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                s = np.array(flat or [], np.int64).reshape(-1, 2)
                gone = runs(s[:, 0], s[:, 1])
                edges = [0, *(x for r in gone for x in r), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(out, (len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(),
                                               [{"start": a, "end": b} for a, b in gone], left)):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]]
            if keep_text:
                arrays += [pa.array(out[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                           pa.array(out[5], pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    spec = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", spans array<struct<start: long, end: long>>, kept binary" if keep_text else "")
    return rows.join(spans, "row", "left").select("id", "text", "spans").mapInArrow(finish, spec) \
        .withColumnRenamed("id", id_col)
