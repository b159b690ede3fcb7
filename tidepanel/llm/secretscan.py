"""Secrets in texts: pattern matches, and spans tagged by a linear-chain conditional random field.

Tokens are runs of code-like characters or of marks. A token's features are its shape, length, digits, variety of
characters and key words; a tag sees those of the token itself, of three tokens before and one after it, and of the
file (how many of its tokens hold digits or assign something). The field is trained on windows around the pattern
matches of a bounded sample, tagged begin, inside and outside by them, and windows without a match. Viterbi decodes
whole texts: where outside wins by more than any change of transitions could win back, the chain falls apart exactly,
and only the stretches between are searched.

A text's spans are its pattern matches and those tagged spans that overlap none of them (kind ``tagged``). Offsets
count code points, ends are exclusive. Null and empty texts have none. Repeated rows get equal spans. Without a match
in the sample there are pattern matches only. An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import share_of_hash
from .wordcache import ChunkCache

KINDS = ("assign", "access", "hex", "tagged")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "api")
DIGIT = re.compile("[0-9]").search
KEYWORDS = re.compile(r"passw|pwd|secret|token|key|auth|bearer|credential")
TOKENS = re.compile(r"[\w+/.-]+|[^\s\w+/.-]+")
#: Offsets of the tokens that a tag sees, and tags.
OFFSETS = (-3, -2, -1, 0, 1)
OUT, BEGIN, INSIDE = 0, 1, 2
REACH = 12
STEP_CHARS = 1 << 21
#: Token ids with a meaning of their own: white space, and beyond the ends of a text.
GAP, EDGE = 0, 1


def matches(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, secret's start, end) of the pattern matches; a match ends where its secret does."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), "assign", m.start(2), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[1])))


SIZES = (3, 6, 9, 13, 19, 31, 63)


def describe(token: str) -> tuple[str, ...]:
    """The features of a token."""
    if not (token[0].isalnum() or token[0] in "+/_.-"):
        return "mark", "=" + token[:2]
    if not token.isascii():
        return ("foreign",)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", re.sub(r"[0-9]", "d", token))))
    n, size = len(token), bisect.bisect_left(SIZES, len(token))
    digits = sum(c.isdigit() for c in token)
    out = ["word", f"size{size}", "shape" + (shape if len(shape) <= 6 else "mixed" if digits else "letters")]
    if digits:
        out.append(f"digits{min(3, digits * 4 // n)}")
        if n >= 8:
            out += [f"variety{min(4, len(set(token)) // 4)}", f"long{size}"]
            if digits < n:
                out.append(f"code{size}")
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
            out.append(f"hex{size}")
    if KEYWORDS.search(token.lower()):
        out.append("keyword")
    return tuple(out)


def assigns_or_counts(token: str) -> tuple[bool, bool]:
    """Whether a token holds a digit, and whether it assigns something."""
    return token.isascii() and DIGIT(token) is not None and (token[0].isalnum() or token[0] in "+/_.-"), token[0] in "=:"


@dataclass
class Field:
    features: dict[str, int]
    weights: np.ndarray          # offsets x features x tags
    file: np.ndarray             # 16 file kinds x tags
    change: np.ndarray           # tags x tags

    def emission(self, names: tuple[str, ...]) -> np.ndarray:
        at = [self.features[f] for f in names if f in self.features]
        return self.weights[:, at].sum(1) if at else np.zeros((len(OFFSETS), 3))


def file_kind(digits: np.ndarray, assigns: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One of 16 kinds of file by the shares of tokens with digits and of tokens that assign."""
    level = lambda x: np.searchsorted([0.001, 0.01, 0.05], x / np.maximum(tokens, 1))
    return level(digits) * 4 + level(assigns)


class Tagger:
    """Tags texts; keeps what it has seen of tokens."""

    def __init__(self, field: Field):
        self.field = field
        self.kinds: dict[tuple, int] = {}
        self.rows = [field.emission(("gap",)), field.emission(("edge",))]
        self.marks = [(False, False)] * 2
        self.letters: dict[tuple[int, int], int] = {}
        self.cache = ChunkCache(b" \t\n\x0b\x0c\r", self._learn)
        c = field.change
        # The most that any tag can win back over OUT by the changes before and after it.
        self.reach = max(c[a, x] + c[x, b] - c[a, OUT] - c[OUT, b] for a in range(3) for b in range(3) for x in (1, 2))

    def _kind(self, token: str) -> int:
        names = describe(token)
        kind = self.kinds.get((names, assigns_or_counts(token)))
        if kind is None:
            kind = self.kinds[names, assigns_or_counts(token)] = len(self.rows)
            self.rows.append(self.field.emission(names))
            self.marks.append(assigns_or_counts(token))
        return kind

    def _learn(self, chunks: list[bytes]):
        ids, sizes, counts = [], [], []
        for chunk in chunks:
            text, at, n = chunk.decode(), 0, len(ids)
            plain = not KEYWORDS.search(text.lower())
            ascii_ = len(text) == len(chunk)
            for m in TOKENS.finditer(text):
                token, start = m[0], m.start()
                if start > at:
                    ids.append(GAP)
                    sizes.append(len(text[at:start].encode()))
                if plain and ascii_ and token.isalpha() and (token.islower() or token.isupper()):
                    # Letters of one case differ by their number alone.
                    key = bisect.bisect_left(SIZES, len(token)), token.islower()
                    kind = self.letters.get(key)
                    if kind is None:
                        kind = self.letters[key] = self._kind(token)
                else:
                    kind = self._kind(token)
                ids.append(kind)
                sizes.append(len(token) if ascii_ else len(token.encode()))
                at = m.end()
            if at < len(text):
                ids.append(GAP)
                sizes.append(len(text[at:].encode()))
            counts.append(len(ids) - n)
        return np.array(ids, np.int64), np.array(sizes, np.int64), np.array(counts, np.int64)

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """Byte spans that are tagged in each text."""
        ids, sizes, borders = self.cache.encode_texts(texts)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(ids):
            return out
        ends = np.cumsum(sizes, dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(borders))
        real = ids != GAP
        ids, text, ends, begins = ids[real], text[real], ends[real], (ends - sizes)[real]
        if not len(ids):
            return out
        rows, marks = np.array(self.rows), np.array(self.marks, float)
        n = np.bincount(text, minlength=len(texts))
        kind = file_kind(*(np.bincount(text, marks[ids, k], len(texts)) for k in (0, 1)), n)
        score = self.field.file[kind][text]
        for o, offset in enumerate(OFFSETS):
            at = np.arange(len(ids)) + offset
            inside = (at >= 0) & (at < len(ids))
            at = np.clip(at, 0, len(ids) - 1)
            score += rows[np.where(inside & (text[at] == text), ids[at], EDGE), o]
        sure = score[:, OUT] - score[:, 1:].max(1) > self.reach
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return out
        fresh = np.concatenate([[True], (np.diff(open_) > 1) | (np.diff(text[open_]) > 0)])
        first, length = open_[fresh], np.diff(np.append(np.flatnonzero(fresh), len(open_)))
        tags = np.zeros(len(ids), np.int8)
        last = first + length - 1
        before = (first > 0) & (text[np.maximum(first - 1, 0)] == text[first])
        after = (last < len(ids) - 1) & (text[np.minimum(last + 1, len(ids) - 1)] == text[last])
        viterbi(score, first, length, before, after, self.field.change, tags)
        start = None
        for i in np.flatnonzero(tags).tolist():
            joined = start is not None and i == previous + 1 and tags[i] == INSIDE and text[i] == text[previous]
            if not joined:
                if start is not None:
                    out[text[previous]].append((start, int(ends[previous])))
                start = int(begins[i])
            previous = i
        if start is not None:
            out[text[previous]].append((start, int(ends[previous])))
        base = np.cumsum([0] + [len(t) for t in texts]).tolist()
        return [[(a - base[k], b - base[k]) for a, b in found] for k, found in enumerate(out)]


def viterbi(score: np.ndarray, first: np.ndarray, length: np.ndarray, before: np.ndarray, after: np.ndarray,
            change: np.ndarray, tags: np.ndarray) -> None:
    """Write the best tags of the stretches [first, first + length), all at once, step by step.

    ``before`` and ``after`` say that an OUT token stands on that side (else an end of the text)."""
    order = np.argsort(-length, kind="stable")
    first, length, before, after = first[order], length[order], before[order], after[order]
    best = score[first] + np.where(before[:, None], change[OUT], 0.0)
    back: list[np.ndarray] = []
    for t in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -t, "left"))                # those longer than t
        options = best[:live, :, None] + change[None]
        back.append(options.argmax(1).astype(np.int8))
        best[:live] = options.max(1) + score[first[:live] + t]
    tag = (best + np.where(after[:, None], change[:, OUT], 0.0)).argmax(1).astype(np.int8)
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        tags[first[:live] + t] = tag[:live]
        if t:
            tag[:live] = back[t - 1][np.arange(live), tag[:live]]


def train(windows: list[dict], rounds: int = 150, ridge: float = 2e-4, rate: float = 0.1) -> Field | None:
    """Maximum likelihood of windows {tokens, tags, file} by Adam; forward and backward run over all windows at once."""
    if not any(any(w["tags"]) for w in windows):
        return None
    width = max(len(w["tokens"]) for w in windows)
    kinds: dict[tuple[str, ...], int] = {("gap",): GAP, ("edge",): EDGE}
    ids = np.full((len(windows), width), EDGE)
    tags = np.zeros((len(windows), width), int)
    there = np.zeros((len(windows), width), bool)
    for k, w in enumerate(windows):
        n = len(w["tokens"])
        ids[k, :n] = [kinds.setdefault(describe(t), len(kinds)) for t in w["tokens"]]
        tags[k, :n], there[k, :n] = w["tags"], True
    file = np.array([w["file"] for w in windows])
    names = sorted({f for kind in kinds for f in kind})
    features = {f: i for i, f in enumerate(names)}
    has = np.zeros((len(kinds), len(names)), np.float32)
    for kind, i in kinds.items():
        has[i, [features[f] for f in kind]] = 1
    near = [np.pad(ids, ((0, 0), (3, 1)), constant_values=EDGE)[:, 3 + o:3 + o + width] for o in OFFSETS]
    theta = [np.zeros((len(OFFSETS), len(names), 3)), np.zeros((16, 3)), np.zeros((3, 3))]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    truth = np.eye(3)[tags] * there[..., None]
    steps = there[:, 1:]
    true_change = np.einsum("kti,ktj->ij", truth[:, :-1], truth[:, 1:])
    for n in range(1, rounds + 1):
        weights, of_file, change = theta
        flat = weights.transpose(1, 0, 2).reshape(len(names), -1).astype(np.float32)
        rows = (has @ flat).astype(np.float64).reshape(len(kinds), len(OFFSETS), 3).transpose(1, 0, 2)
        score = of_file[file][:, None, :] + sum(rows[o][near[o]] for o in range(len(OFFSETS)))
        lead = np.zeros_like(score)
        lead[:, 0] = score[:, 0]
        for t in range(1, width):
            new = np.logaddexp.reduce(lead[:, t - 1, :, None] + change, axis=1) + score[:, t]
            lead[:, t] = np.where(there[:, t, None], new, lead[:, t - 1])
        total = np.logaddexp.reduce(lead[:, -1], axis=1)
        rest = np.zeros_like(score)
        for t in range(width - 2, -1, -1):
            new = np.logaddexp.reduce(change + (score[:, t + 1] + rest[:, t + 1])[:, None, :], axis=2)
            rest[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        chance = np.exp(np.where(there[..., None], lead + rest - total[:, None, None], -np.inf))
        pair = np.exp(np.where(steps[..., None, None], lead[:, :-1, :, None] + change + (
            score[:, 1:] + rest[:, 1:])[:, :, None, :] - total[:, None, None, None], -np.inf))
        miss = truth - chance
        pull = np.zeros((len(OFFSETS), len(kinds), 3))
        for o in range(len(OFFSETS)):
            for t in range(3):
                pull[o, :, t] = np.bincount(near[o].ravel(), miss[..., t].ravel(), len(kinds))
        by_file = np.zeros((16, 3))
        np.add.at(by_file, file, miss.sum(1))
        gained = has.T @ pull.transpose(1, 0, 2).reshape(len(kinds), -1).astype(np.float32)
        slopes = [gained.astype(np.float64).reshape(len(names), len(OFFSETS), 3).transpose(1, 0, 2), by_file, true_change - pair.sum((0, 1))]
        for x, (m, v), g in zip(theta, moments, slopes):
            g = g / len(windows) - ridge * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9 ** n)) / (np.sqrt(v / (1 - 0.99 ** n)) + 1e-8)
    return Field(features, *theta)


def _windows(text: str, share: float) -> list[dict]:
    """Windows around the secrets of a text; of a text without, one window at a place given by ``share``."""
    tokens = [(m.start(), m.end(), m[0]) for m in TOKENS.finditer(text)]
    if not tokens:
        return []
    tags = np.zeros(len(tokens), int)
    starts = np.array([t[0] for t in tokens])
    for _, _, a, b in matches(text):
        lo, hi = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
        lo += tokens[lo][1] <= a
        tags[lo:hi] = INSIDE
        tags[lo:lo + 1] = BEGIN
    flags = np.array([assigns_or_counts(t[2]) for t in tokens], float).sum(0)
    kind = int(file_kind(*flags[:, None], np.array([len(tokens)]))[0])
    middles = np.flatnonzero(tags == BEGIN).tolist()
    if not middles:                    # where a token looks most like code, or anywhere
        codes = [k for k, t in enumerate(tokens) if len(t[2]) >= 8 and t[2].isascii() and DIGIT(t[2])]
        middles = [codes[int(share * len(codes))] if codes else int(share * len(tokens))]
    return [{"tokens": [t[2] for t in tokens[max(0, m - REACH):m + REACH + 1]],
             "tags": tags[max(0, m - REACH):m + REACH + 1].tolist(), "file": kind} for m in middles]


#: Key words and alphabets of the secrets that stand in for those of the sample, so that shapes it lacks are known.
OTHER_KEYS = ("password", "secret", "token", "api_key", "auth_key", "credential", "bearer")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def varied(windows: list[dict], times: int = 3) -> list[dict]:
    """Windows with their secrets drawn anew from other alphabets and lengths, and key words exchanged."""
    rng, out = random.Random(11), []
    for w in windows:
        if any(w["tags"]):
            for _ in range(times):
                letters, key = rng.choice(ALPHABETS), rng.choice(OTHER_KEYS)
                out.append(w | {"tokens": [
                    "".join(rng.choices(letters, k=rng.randint(16, 44))) if tag == BEGIN and len(t) >= 8
                    else key if tag == OUT and KEYWORDS.fullmatch(t.lower()) else t
                    for t, tag in zip(w["tokens"], w["tags"])]})
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000,
        most_windows: int = 1_500) -> Field | None:
    """Train on about ``sample_rows`` texts, at most ``most_windows`` windows with and as many without a secret."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), share_of_hash(id_col, text_col).alias("h"))
    n = docs.count()
    rows = rows.where(F.col("h") < sample_rows / max(n, 1))

    def cut(batches):
        for batch in batches:
            out = [(h, i, w) for text, h in zip(*(c.to_pylist() for c in batch.columns))
                   for i, w in enumerate(_windows(text, h * 1e4 % 1))]
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int32()),
                pa.array([o[2]["tokens"] for o in out], pa.list_(pa.string())),
                pa.array([o[2]["tags"] for o in out], pa.list_(pa.int32())),
                pa.array([o[2]["file"] for o in out], pa.int32())], names=["h", "i", "tokens", "tags", "file"])

    windows = rows.mapInArrow(cut, "h double, i int, tokens array<string>, tags array<int>, file int")
    secret = F.exists("tags", lambda t: t > 0)
    chosen = [r.asDict() for part in (secret, ~secret)
              for r in windows.where(part).orderBy("h", "i", "tokens").limit(most_windows).collect()]
    return train(chosen + varied(chosen))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, field: Field | None, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """Add ``secrets``, the spans of each text in order of start and kind; with ``redact`` each stretch of the text
    that spans cover is replaced by it. One pass, no shuffle."""
    keep = [c for c in df.columns if c != "secrets"]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [T.StructField("secrets", SPANS)])
    shared = df.sparkSession.sparkContext.broadcast(field)       # bounded by the sample
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        tagger = Tagger(shared.value) if shared.value is not None else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found: list[list[dict]] = []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < STEP_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                raws = [(t or "").encode() for t in texts[at:end]]
                tagged = tagger.spans(raws) if tagger else [[]] * len(raws)
                for text, raw, more in zip(texts[at:end], raws, tagged):
                    spans = [(a, k, b) for a, k, _, b in matches(text or "")]
                    for a, b in more:
                        a = len(raw[:a].decode())
                        b = a + len(raw[len(text[:a].encode()):b].decode())
                        if not any(a < e and s < b for s, _, e in spans):
                            spans.append((a, "tagged", b))
                    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
                    found.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
                at = end
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if redact is not None:
                columns[keep.index(text_col)] = pa.array([_without(t, f, redact) for t, f in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=keep + ["secrets"])

    return df.mapInArrow(run, schema)


def _without(text: str | None, spans: list[dict], put: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in sorted((s["start"], s["end"]) for s in spans):
        if s[1] > at:
            if s[0] >= at:
                out += [text[at:s[0]], put]
            at = s[1]
    return "".join(out) + text[at:]
