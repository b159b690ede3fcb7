"""SentencePiece BPE encoding that keeps, for every piece, the bytes of the original text it stands for.

The model file is read as it is: normalisation walks its compiled character map (a double-array trie) with the
longest matching prefix and notes, for each normalised byte, the original byte it came from; pieces are merged by
score on the normalised text, and their borders are projected back through those notes.

Nulls and empty texts give empty arrays and an empty decoded text. Texts are never cut. Repeated rows are encoded
one by one. An empty table gives an empty table. Columns of the input that carry a name this operator adds are
replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .wordcache import ChunkCache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Characters of text a worker encodes at a time (a longer text is taken whole).
STEP_CHARS = 1 << 21


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message."""
    at, end = 0, len(buf)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, buf[at:at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield key >> 3, buf[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix lookup in a compiled map: a double-array trie and the replacement strings behind it."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that starts at ``at``."""
        units, node, found = self.units, 0, None
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start:self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class PieceModel:
    def __init__(self, blob: bytes, library=None):
        self.library = library
        self.pieces, self.scores, self.kinds, charmap = [], [], [], b""
        self.dummy_prefix = self.trim = self.escape = True
        for field, value in _fields(blob):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("the model is not a BPE model")
            elif field == 3:
                spec = dict(_fields(value))
                charmap = spec.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if {USER, UNUSED} & set(self.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.map = CharacterMap(charmap) if charmap else None
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        # Bytes that a piece stands for in unescaped text.
        self.width = np.array([1 if k == BYTE else len(p.replace(SPACE, " ").encode())
                               for p, k in zip(self.pieces, self.kinds)], np.int64)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        # No piece holds a space behind another character: a chunk may end before every space.
        split = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if split else r"[\s\S]+").findall
        # Without a map and trimming, normalising only writes each space as a mark.
        # Then, and if every character has pieces, a text is encoded by its distinct chunks.
        self.plain = self.map is None and not self.trim and self.escape and split and len(self.bytes) == 256
        self.cache = ChunkCache(b" ", self._learn)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the offset of the original byte."""
        if not text:
            return "", np.zeros(1, np.int64)
        data = text.encode()
        if self.map is None and not self.trim and self.escape:
            raw = np.frombuffer(data, np.uint8)
            origin = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            norm = text.replace(" ", SPACE)
            if self.dummy_prefix:
                norm, origin = SPACE + norm, np.concatenate([np.zeros(3, np.int64), origin])
            return norm, np.append(origin, len(data))
        parts: list[tuple[bytes, int]] = []           # replacement bytes, original offset
        at = 0
        while at < len(data):
            width = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            hit = self.map.longest(data, at) if self.map else None
            size, made = hit or (width, data[at:at + width])
            parts.append((made, at))
            at += size
        out, origin, mark = bytearray(), [], SPACE.encode() if self.escape else b" "
        gap = self.trim                               # leading spaces go, runs become one
        for made, start in parts:
            for byte in made:
                if byte == 32:
                    if not (self.trim and gap):
                        out += mark
                        origin += [start] * len(mark)
                    gap = True
                else:
                    out.append(byte)
                    origin.append(start)
                    gap = False
        end = len(data)
        if self.trim and gap and out.endswith(mark):
            end = origin[-1]
            del out[-len(mark):], origin[-len(mark):]
        if out and self.dummy_prefix:
            out[:0], origin[:0] = mark, [origin[0]] * len(mark)
        return out.decode(), np.array(origin + [end], np.int64)

    def merged(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids and normalised byte lengths of a chunk: best-scored neighbours merge first, ties from the left."""
        part: list[str | None] = list(chunk)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(part):
                both = part[left] + part[right]
                if (found := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.scores[found], left, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, left, both = heapq.heappop(heap)
            if part[left] is None or after[left] >= len(part) or part[left] + part[after[left]] != both:
                continue
            right = after[left]
            part[left], part[right] = both, None
            after[left] = after[right]
            if after[left] < len(part):
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        ids, sizes = [], []
        for text in part:
            if text is None:
                continue
            found, raw = self.ids.get(text), text.encode()
            if found is not None:
                ids.append(found)
                sizes.append(len(raw))
            elif self.bytes:
                ids += [self.bytes[b] for b in raw]
                sizes += [1] * len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return ids, sizes

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the original byte span [start, end) of each."""
        norm, origin = self.normalise(text or "")
        ids: list[int] = []
        sizes: list[int] = []
        for chunk in self.chunks(norm):
            made = self.merged(chunk)
            ids += made[0]
            sizes += made[1]
        ends = np.cumsum(np.array(sizes, np.int64))
        return np.array(ids, np.int64), origin[ends - sizes] if ids else ends, origin[ends]

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of chunks of unescaped text, with their sizes in unescaped bytes.

        The library merges a chunk as ``merged`` does; the space it puts in front stands for the chunk's first.
        """
        if self.library is not None and self.dummy_prefix:
            front = [c[:1] == b" " and len(c) > 1 for c in chunks]
            found = self.library.encode([c[1:].decode() if f else "" for c, f in zip(chunks, front)], num_threads=1)
            made = [ids if f else self.merged(c.decode().replace(" ", SPACE))[0]
                    for ids, f, c in zip(found, front, chunks)]
        else:
            made = [self.merged(c.decode().replace(" ", SPACE))[0] for c in chunks]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int64, int(counts.sum()))
        return flat, self.width[flat], counts

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of many texts, each distinct chunk once."""
        plain = [self.plain and SPACE not in t for t in texts]
        lead = b" " if self.dummy_prefix else b""
        ids, sizes, borders = self.cache.encode_texts([lead + t.encode() if t else b"" for t, p in zip(texts, plain) if p])
        ends = np.cumsum(sizes, dtype=np.int64)
        out, k = [], 0
        for text, p in zip(texts, plain):
            if not p:
                out.append(self.encode(text))
                continue
            a, b = borders[k], borders[k + 1]
            k += 1
            upto = ends[a:b] - (ends[a - 1] if a else 0) - len(lead)
            out.append((ids[a:b], np.maximum(upto - sizes[a:b], 0), upto))
        return out


_MODELS: dict[str, tuple] = {}


def loaded(path: str) -> tuple:
    """(PieceModel, library processor) of a model file, once for each worker."""
    if path not in _MODELS:
        import sentencepiece

        with open(path, "rb") as file:
            library = sentencepiece.SentencePieceProcessor(model_file=path)
            _MODELS[path] = PieceModel(file.read(), library), library
    return _MODELS[path]


ADDED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                      T.StructField("starts", T.ArrayType(T.IntegerType())),
                      T.StructField("ends", T.ArrayType(T.IntegerType())),
                      T.StructField("decoded", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])


def steps(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about STEP_CHARS characters."""
    at = chars = 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= STEP_CHARS:
            yield texts[at:k + 1]
            at, chars = k + 1, 0
    yield texts[at:]


def encode(df: DataFrame, model_path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Add ids, byte spans (starts, ends) and the decoded text; with ``digests`` their count and SHA-256 instead.

    The model file must be at ``model_path`` on every executor. One pass, no shuffle.
    """
    added = DIGESTS if digests else ADDED
    names = set(added.fieldNames())
    keep = [c for c in df.columns if c not in names]
    # The text goes to Python under its own name; kept columns pass through as they are.
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + added.fields)

    def run(batches):
        model, library = loaded(model_path)
        kinds = ([pa.int64(), pa.string(), pa.string()] if digests
                 else [pa.list_(pa.int32())] * 3 + [pa.string()])
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            at = 0
            for step in steps(texts):                   # what leaves at once is bounded by the step, not the batch
                rows = [[] for _ in added.fields]
                for ids, starts, ends in model.encode_all(step):
                    plain = ids.tolist()
                    decoded = library.decode(plain) if plain else ""
                    if digests:
                        values = (len(plain), hashlib.sha256(",".join(map(str, plain)).encode()).hexdigest(),
                                  hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        values = ids, starts, ends, decoded
                    for row, value in zip(rows, values):
                        row.append(value)
                part = batch.slice(at, len(step))
                at += len(step)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in keep]
                    + [pa.array(r, k) for r, k in zip(rows, kinds)], names=keep + added.fieldNames())

    return df.mapInArrow(run, schema)
