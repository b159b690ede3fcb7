"""Token ids of a corpus in bit-plane files, and their reader.

``write`` tokenises texts in ascending id order and stores a stream of blocks of ``block_ids`` ids. A block is
transposed into bit or byte planes, each plane is compressed with zstandard, and the row that holds the block also
holds its index: plane sizes, the place of the block in its shard, and the document pieces inside. Shards are the
tasks of one range partitioning by id, so that no document list meets anywhere; the number of ids before a shard
is a sum over one small row per shard. The files are Parquet folders written by Spark, hence readable from any
store, and a lost task writes its shard again.

Null and empty texts hold the end id alone. Rows with equal ids keep their own entry, in the order of the first 32
characters of their text (and of the whole text inside a shard); an id of very many rows is dealt over shards. Null ids
come first. Very long texts are taken whole. An empty table writes an empty folder with the schema. Other columns take
no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .wordcache import ChunkCache

#: UTF-8 of white space beyond ASCII, and of separators that regular expressions disagree on.
OTHER_WHITE = (rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
               rb"|\xef\xbb\xbf")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: Bytes of text a worker tokenises at a time (a longer text is taken whole).
STEP_BYTES = 1 << 22


class WordTokens:
    """The library's ids of texts, by their distinct words.

    The byte-level pre-tokeniser starts a new word at every white-space run and between a letter and a mark, and merges
    words apart from each other. In a row of words that each begin with white space it finds the same words, so new
    words go to the library in such rows. Texts with special tokens or white space beyond ASCII go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)     # bytes of each id: one character each
        for piece, i in vocab.items():
            self.width[i] = len(piece)
        added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.odd_at = re.compile(b"|".join([OTHER_WHITE, *map(re.escape, added)])).match
        self.may_begin = np.zeros(256, bool)                         # first bytes of what is odd
        self.may_begin[[*range(0x1c, 0x20), 0xc2, 0xe1, 0xe2, 0xe3, 0xef, *(a[0] for a in added if a)]] = True
        self.white = np.zeros(256, bool)
        self.white[list(b" \t\n\x0b\x0c\r")] = True
        self.cache = ChunkCache(b" \t\n\x0b\x0c\r", self.learn, (LETTERS, b",.!?;:"), most=3_000_000)

    def odd(self, data: bytes) -> bool:
        """Does the text hold a special token or white space beyond ASCII?"""
        places = np.flatnonzero(self.may_begin[np.frombuffer(data, np.uint8)])
        return any(self.odd_at(data, p) for p in places.tolist())

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that begin with white space and end otherwise go as one text, the others one by one."""
        ids, counts = [], []
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        raw, upto = np.frombuffer(b"".join(chunks), np.uint8), np.cumsum(sizes)
        row = self.white[raw[upto - sizes]] & ~self.white[raw[upto - 1]]
        order = np.argsort(~row, kind="stable")                      # the row first
        many = int(row.sum())
        for i in range(0, many, 50_000):
            some = order[i:min(i + 50_000, many)]
            part = [chunks[k] for k in some.tolist()]
            made = self.library.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids
            ids.append(np.array(made, np.int64))
            ends = np.searchsorted(np.cumsum(self.width[ids[-1]]), np.cumsum(sizes[some])) + 1
            counts.append(np.diff(ends, prepend=0))
        alone = [chunks[k].decode() for k in order[many:].tolist()]
        for found in self.library.encode_batch_fast(alone, add_special_tokens=False):
            ids.append(np.array(found.ids, np.int64))
            counts.append([len(found)])
        flat, counts = np.concatenate(ids), np.concatenate(counts)
        back = np.argsort(order)
        firsts = (np.cumsum(counts) - counts)[back]
        counts = counts[back]
        upto = np.cumsum(counts)
        flat = flat[np.repeat(firsts - upto + counts, counts) + np.arange(len(flat))]
        return flat, self.width[flat], counts

    def encode(self, data: bytes, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number in each; text k is data[text_at[k]:text_at[k + 1]] in UTF-8."""
        if not self.odd(data):
            ids, _, borders = self.cache.encode(data, text_at)
            return ids, np.diff(borders)
        out = []
        for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist()):
            text = data[a:b]
            out.append(np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
                       if self.odd(text) else self.cache.encode(text, np.array([0, b - a]))[0])
        return np.concatenate(out), np.array([len(x) for x in out])


def pack(ids: np.ndarray, planes: str, level: int) -> tuple[list[int], bytes]:
    """(compressed size of each plane, planes) of a block; only planes up to the highest set bit are kept."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if planes == "bit":
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T[:top], axis=1)
    else:
        rows = np.ascontiguousarray(raw.T[:-(-top // 8)])
    press = zstandard.ZstdCompressor(level=level)
    made = [press.compress(r.tobytes()) for r in rows]
    return [len(m) for m in made], b"".join(made)


def unpack(payload: bytes, sizes: list[int], n: int, planes: str) -> np.ndarray:
    at, rows, out = 0, [], zstandard.ZstdDecompressor()
    for size in sizes:
        rows.append(np.frombuffer(out.decompress(payload[at:at + size]), np.uint8))
        at += size
    if not rows:
        return np.zeros(n, np.uint32)
    if planes == "bit":
        bits = np.zeros((32, n), np.uint8)
        bits[:len(rows)] = np.unpackbits(np.vstack(rows), axis=1)[:, :n]
        raw = np.packbits(bits.T, axis=1, bitorder="little")
    else:
        raw = np.zeros((n, 4), np.uint8)
        raw[:, :len(rows)] = np.vstack(rows).T
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


BLOCK = ("shard int, block long, first long, n_ids int, planes string, plane_sizes array<int>, payload binary, "
         "docs array<struct<doc_id: long, start: long, n_tokens: long, at: int, size: int>>")
_CACHES: dict[str, WordTokens] = {}


def write(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 2, block_ids: int = 1 << 16, planes: str = "byte", level: int = 3) -> None:
    """Write the blocks of all texts, each closed by ``end_id``, to ``path``."""
    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        if tokenizer_path not in _CACHES:
            _CACHES[tokenizer_path] = WordTokens(tokenizer_path)
        cache = _CACHES[tokenizer_path]
        pending: list[np.ndarray] = []                # ids that are in no block yet
        docs: list[tuple] = []                        # keys, whether null, starts and sizes of the documents of a step
        held = block = done = 0                       # ids pending, blocks and ids written

        def blocks(last: bool):
            """Full blocks of what is pending, and with ``last`` the rest."""
            nonlocal pending, docs, held, block, done
            if not (held >= block_ids or last and held):
                return
            ids = np.concatenate(pending)
            keys, null, starts, sizes = (np.concatenate(x) for x in zip(*docs))
            while held >= block_ids or last and held:
                size = min(block_ids, held)
                lo, hi = done, done + size
                a, b = np.searchsorted(starts + sizes, lo, "right"), np.searchsorted(starts, hi)
                here = slice(a, b)
                at = np.maximum(starts[here], lo)
                entries = pa.StructArray.from_arrays([
                    pa.array(keys[here], mask=null[here]), pa.array(starts[here]), pa.array(sizes[here]),
                    pa.array((at - lo).astype(np.int32)),
                    pa.array((np.minimum(starts[here] + sizes[here], hi) - at).astype(np.int32))],
                    ["doc_id", "start", "n_tokens", "at", "size"])
                planes_of, payload = pack(ids[:size], planes, level)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([lo], pa.int64()),
                    pa.array([size], pa.int32()), pa.array([planes]), pa.array([planes_of], pa.list_(pa.int32())),
                    pa.array([payload], pa.binary()), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), entries)],
                    names=["shard", "block", "first", "n_ids", "planes", "plane_sizes", "payload", "docs"])
                ids, held, done, block = ids[size:], held - size, hi, block + 1
            left = starts + sizes > done
            pending, docs = [ids], [(keys[left], null[left], starts[left], sizes[left])]

        for batch in batches:
            keys, null = (batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False))
            texts = pc.fill_null(batch.column(1), "").cast(pa.string())
            raw = memoryview(texts.buffers()[2] or b"")
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
            at = 0
            while at < len(keys):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_BYTES, "right")) - 1)
                ids, sizes = cache.encode(bytes(raw[ends[at]:ends[end]]), ends[at:end + 1] - ends[at])
                n = end - at
                closed = np.full(len(ids) + n, end_id, np.uint32)
                closed[np.arange(len(ids)) + np.repeat(np.arange(n), sizes)] = ids
                sizes = sizes.astype(np.int64) + 1
                docs.append((keys[at:end], null[at:end], done + held + np.cumsum(sizes) - sizes, sizes))
                pending.append(closed)
                held += len(closed)
                yield from blocks(False)
                at = end
        yield from blocks(True)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Equal ids go by their text; the last key deals out rows that are alike.
    rows.withColumns({"_begin": F.substring("text", 1, 32), "_tie": F.monotonically_increasing_id()}) \
        .repartitionByRange(common.tasks(rows), "doc_id", "_begin", "_tie") \
        .sortWithinPartitions("doc_id", "_begin", "text").select("doc_id", "text") \
        .mapInArrow(run, BLOCK).write.parquet(path)


def read(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids of every document.

    Ids come as array<long>, with ``as_bytes`` as little-endian unsigned 32-bit binary. Only documents that lie
    in several blocks are shuffled to put their pieces together.
    """
    stored = spark.read.schema(BLOCK).parquet(path)
    # One row of two numbers per shard, and a writer has at most 200,000 tasks: small enough to send to all.
    # No document data passes this window.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = totals.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))

    def pieces(whole: bool) -> DataFrame:
        """The documents, or parts of documents, of each block that lie in it wholly, or not wholly."""
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    docs = r["docs"]
                    if docs:
                        raw = unpack(r["payload"], r["plane_sizes"], r["n_ids"], r["planes"]).tobytes()
                        yield pa.RecordBatch.from_arrays([
                            pa.array([r["shard"]] * len(docs), pa.int32()),
                            *[pa.array([d[k] for d in docs], pa.int64()) for k in ("doc_id", "start", "n_tokens")],
                            pa.array([r["block"]] * len(docs), pa.int64()),
                            pa.array([raw[4 * d["at"]:4 * (d["at"] + d["size"])] for d in docs], pa.binary())],
                            names=["shard", "doc_id", "start", "n_tokens", "block", "raw"])

        inside = F.filter("docs", lambda d: (d["size"] == d["n_tokens"]) == F.lit(whole))
        return stored.withColumn("docs", inside).mapInArrow(
            run, "shard int, doc_id long, start long, n_tokens long, block long, raw binary")

    split = pieces(False).groupBy("shard", "start", "doc_id", "n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("block", "raw"))).alias("parts"))
    joined = split.select("shard", "doc_id", "start", "n_tokens", F.expr(
        "aggregate(parts, X'', (a, p) -> concat(a, p.raw))").alias("raw"))
    found = pieces(True).drop("block").unionByName(joined)
    out = found.join(F.broadcast(before), "shard").withColumn("start", F.col("start") + F.col("before"))
    if as_bytes:
        return out.select("doc_id", "start", "n_tokens", F.col("raw").alias("ids"))

    def numbers(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int64()))],
                                             names=["doc_id", "start", "n_tokens", "ids"])

    return out.select("doc_id", "start", "n_tokens", "raw").mapInArrow(
        numbers, "doc_id long, start long, n_tokens long, ids array<long>")
