"""A gated recurrent language model over words, trained in numpy by truncated backpropagation, and its scores of whole
texts.

``gather`` counts the words of the training texts (all of them: the table of counts grows with the corpus) and lists
the most frequent ones. ``encode`` turns each text into ids once. ``train`` runs in rounds: in each, every task starts
from the same weights, learns from its share of that round's documents, and the weights are averaged by tokens; the
rounds together read every training document once. Documents run side by side in slots, window by window; the state is
carried from window to window, gradients stop at its start, and an end token clears it. ``score`` carries the state
through each document in the same way, so that the sum over its tokens is the log-likelihood of the whole text.

The softmax has two factors: class of the next token, then token in the class; classes are ranges of the frequency
order of equal mass. A word outside the network's vocabulary is the unknown token times its smoothed share among all
such words, ``(c + 1) / (tokens + words + 1)``, so that probabilities of all words, unseen ones together, add up to one.

Counts of at most ``LISTED`` words of at most ``LONGEST`` bytes go to the workers: the cut is a count that leaves no
more words, whatever the corpus. All other words of a text are joined with the table of counts, in a shuffle whose
skewed keys adaptive execution splits. Averages are sums of weight vectors in two steps, each task holding one vector.
What is stored (ids, counts, sums) lies in the shared folder; a lost task is run again from there.

Texts that are null, empty or without words consist of the end alone. Repeated rows and ids are rows of their own.
Very long texts are taken whole: their slot runs on when all others are done. With no training texts every word is
unknown and all weights stay as they start. An empty table gives no rows. Kept columns that have the name of a
result are replaced by it.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

#: Words whose counts every worker knows, and their greatest size in bytes.
LISTED, LONGEST = 262_144, 64
#: Bytes of text and tokens that a worker handles at a time (a longer text is taken whole).
STEP_BYTES, STEP_TOKENS = 1 << 22, 4_000_000
#: Distinct words that a worker counts before it hands them on.
HELD_WORDS = 400_000
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


@dataclass(frozen=True)
class Settings:
    words: int = 1024       # vocabulary of the network, end and unknown included
    classes: int = 24
    hidden: int = 16
    window: int = 16        # tokens of truncated backpropagation
    slots: int = 512        # documents that run side by side
    rounds: int = 4         # averages of weights
    rate: float = 0.01
    seed: int = 11


@dataclass
class Lexicon:
    """Listed words with their counts (falling), the table of all counts, and totals of tokens and distinct tokens."""
    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    table: DataFrame

    def network_size(self, settings: Settings) -> int:
        """Listed words that the network knows."""
        return min(len(self.words), settings.words - 2)

    def outside(self, settings: Settings) -> tuple[int, int]:
        """Tokens and words that the network does not know."""
        k = self.network_size(settings)
        return (self.tokens - self.ends - int(self.counts[:k].sum()), self.distinct - (self.ends > 0) - k)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in steps of about STEP_BYTES with their texts in UTF-8."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= STEP_BYTES):
                held += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def gather(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """Counts of lower-cased words and of the end token (the null word) over all of ``docs``."""
    def run(batches):
        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                              names=["word", "c"])
        found = Counter()
        for part, texts in _texts(batches, 0):
            found[None] += len(texts)
            # A separator keeps the last word of a text apart from the first of the next.
            found.update(b"\n".join(texts).lower().split())
            if len(found) > HELD_WORDS:
                yield rows()
                found = Counter()
        if found:
            yield rows()

    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word binary, c long") \
        .groupBy("word").agg(F.sum("c").alias("c"))
    counts = common.stored(counts, "words")
    total = counts.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("word").isNull(), F.col("c")))).first()
    short = counts.where(F.octet_length("word") <= LONGEST)
    step = F.floor(F.log2("c") * 16).cast("int")
    # At most 16 * 63 steps of counts; the lowest step down to which no more than LISTED words lie.
    steps = sorted(((r[0], r[1]) for r in short.groupBy(step.alias("s")).count().collect()), reverse=True)
    held, cut = 0, None
    for s, n in steps:
        if held + n > LISTED:
            break
        held, cut = held + n, s
    listed = short.where(step >= cut).collect() if cut is not None else []
    listed = sorted(((r["c"], bytes(r["word"])) for r in listed), key=lambda r: (-r[0], r[1]))
    return Lexicon([w for _, w in listed], np.array([c for c, _ in listed], np.int64), total[2] or 0, total[0] or 0,
                   total[1], counts)


def vocabulary(lexicon: Lexicon, settings: Settings) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Network id of each of the first listed words, counts by id (falling), and the ids of end and unknown."""
    k = lexicon.network_size(settings)
    counts = np.concatenate([[lexicon.ends, lexicon.outside(settings)[0]], lexicon.counts[:k]])
    order = np.argsort(-counts, kind="stable")
    ids = np.empty(k + 2, np.int64)
    ids[order] = np.arange(k + 2)
    return ids[2:], counts[order], int(ids[0]), int(ids[1])


def encode(docs: DataFrame, lexicon: Lexicon, settings: Settings, keep: list[str], text_col: str = "text") -> DataFrame:
    """kept (a struct of the kept columns), row (a key of this table), n_tokens, n_listed (tokens of known count), log_listed and log_out (sums
    of log10(c + 1) over those, and over those that the network does not know), n_out, ids, and rare (all other words)."""
    known_ids, _, end_id, unknown = vocabulary(lexicon, settings)
    words, counts, k = lexicon.words, lexicon.counts, lexicon.network_size(settings)
    ends = lexicon.ends

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        get = {w: i for i, w in enumerate(words)}.get
        logs = np.log10(np.append(counts, 0) + 1.0)
        to_id = np.full(len(words) + 1, unknown, np.int16)
        to_id[:k] = known_ids
        for part, texts in _texts(batches, 1):
            found, sizes = [], np.empty(len(texts), np.int64)
            for i, t in enumerate(texts):
                split = t.lower().split()
                sizes[i] = len(split)
                found += split
            n, d = len(found), len(texts)
            place = np.fromiter(map(get, found, repeat(-1)), np.int64, n)
            doc = np.repeat(np.arange(d), sizes)
            total = lambda weights: np.bincount(doc, weights=weights, minlength=d)  # noqa: B023, E731
            listed, inside = place >= 0, (place >= 0) & (place < k)
            log = logs[place]                                             # the last entry, 0, for words not listed
            ids = np.full(n + d, end_id, np.int16)
            ids[np.arange(n) + doc] = to_id[place]
            rare = np.flatnonzero(~listed)
            borders = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(row + np.arange(d), pa.int64()), pa.array(sizes + 1),
                pa.array(total(listed).astype(np.int64) + (ends > 0)), pa.array(total(log) + np.log10(ends + 1.0)),
                pa.array(total(np.where(inside, 0.0, log))), pa.array(total(~inside).astype(np.int64)),
                pa.ListArray.from_arrays(borders(sizes + 1), pa.array(ids)),
                pa.ListArray.from_arrays(borders(total(~listed)), pa.array([found[i] for i in rare.tolist()], pa.binary()))],
                names=["kept", "row", "n_tokens", "n_listed", "log_listed", "log_out", "n_out", "ids", "rare"])
            row += d

    # A struct, so that no kept name meets one of these; it is never empty.
    kept = F.struct(*[F.col(f"`{c}`") for c in keep if c not in RESULTS], F.lit(None).cast("boolean").alias("_none"))
    rows = docs.select(kept.alias("kept"), F.col(f"`{text_col}`").alias("text"))
    made = StructType.fromDDL("row long, n_tokens long, n_listed long, log_listed double, log_out double, n_out long, "
                              "ids array<short>, rare array<binary>")
    return common.stored(rows.mapInArrow(run, StructType([rows.schema["kept"], *made.fields])), "encoded")


class Network:
    """Gated recurrent units and a two-factor softmax. Weights lie in one flat vector; its parts are views."""

    def __init__(self, counts: np.ndarray, end_id: int, unknown: int, settings: Settings):
        k, h = len(counts), settings.hidden
        self.held: dict[str, np.ndarray] = {}
        mass = np.cumsum(np.sqrt(counts + 1.0))
        cls = np.minimum((mass / mass[-1] * settings.classes * (1 - 1e-12)).astype(np.int64), settings.classes - 1)
        self.class_of = np.unique(cls, return_inverse=True)[1].reshape(-1)          # only classes that have a word
        self.borders = np.searchsorted(self.class_of, np.arange(self.class_of[-1] + 2))
        self.end_id, self.unknown, self.hidden, self.settings = end_id, unknown, h, settings
        c = len(self.borders) - 1
        self.shapes = {"x": (k, 3 * h), "u": (h, 3 * h), "c": (h, c), "cb": (c,), "w": (k, h), "wb": (k,)}
        self.set(np.zeros(sum(map(np.prod, self.shapes.values())), np.float32))
        rng = np.random.default_rng(settings.seed)
        for name, scale in (("x", 0.3), ("u", h ** -0.5), ("c", 0.1), ("w", 0.1)):
            part = getattr(self, name)
            part[...] = rng.normal(0, scale, part.shape)
        share = (counts + 1.0) / (counts + 1.0).sum()
        by_class = np.add.reduceat(share, self.borders[:-1])
        self.cb[...] = np.log(by_class)
        self.wb[...] = np.log(share / by_class[self.class_of])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = flat[at:at + size].reshape(shape)
            at += size
        return out

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that the next call of the same name may overwrite: fresh memory for every window costs more than
        what is done there."""
        size = int(np.prod(shape))
        if len(self.held.get(name, ())) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)

    def set(self, flat: np.ndarray) -> None:
        self.flat = np.ascontiguousarray(flat, np.float32)
        self.__dict__.update(self.views(self.flat))

    def states(self, ids: np.ndarray, h: np.ndarray, trace: bool = False):
        """States (units, slots) before each token of ids (window, slots) and after the last one; with ``trace`` what
        gradients need. Slots are the inner axis, so that the parts of a gate lie together."""
        steps, slots, n = *ids.shape, self.hidden
        hs = self.room("hs", steps + 1, n, slots)
        hs[0] = h
        held = steps if trace else 1
        hu, zr, new = (self.room(f"gate{k}", held, k * n, slots) for k in (3, 2, 1))
        rows = self.room("rows", steps, slots, 3 * n)
        np.take(self.x, ids, axis=0, out=rows, mode="clip")
        xs = self.room("xs", steps, 3 * n, slots)
        xs[...] = rows.transpose(0, 2, 1)
        live = (ids != self.end_id).astype(np.float32)
        ut = np.ascontiguousarray(self.u.T)
        for t in range(steps):
            i = t if trace else 0
            before, x, after, gate, made = hs[t], xs[t], hs[t + 1], zr[i], new[i]
            np.dot(ut, before, out=hu[i])
            np.add(x[:2 * n], hu[i, :2 * n], out=gate)
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.multiply(gate[n:], hu[i, 2 * n:], out=made)
            made += x[2 * n:]
            np.tanh(made, out=made)
            np.subtract(before, made, out=after)
            after *= gate[:n]
            after += made
            after *= live[t]
        return hs, (hu, zr, new, live)

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each token y after the state in the row of h; with ``grads`` the gradients of their
        negative sum are added there, and those for h are returned."""
        def softmax(logits, pick):
            rows = np.arange(len(pick))
            np.minimum(logits, 80, out=logits)        # states lie in (-1, 1): no more than a guard
            chosen = logits[rows, pick]
            np.exp(logits, out=logits)
            total = logits.sum(1)
            if grads is not None:
                logits *= np.reciprocal(total)[:, None]
                logits[rows, pick] -= 1
            return chosen - np.log(total)

        # Tokens of one class lie together, so that each class is a slice.
        cls = self.class_of[y]
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cls, h, y = cls[order], h[order], y[order]
        bounds = np.searchsorted(cls, np.arange(len(self.borders)))
        logits = h @ self.c
        logits += self.cb
        found, dh = softmax(logits, cls), None
        if grads is not None:
            grads["c"] += h.T @ logits
            grads["cb"] += logits.sum(0)
            dh = logits @ self.c.T
        for c in range(len(self.borders) - 1):
            (a, b), (i, j) = self.borders[c:c + 2], bounds[c:c + 2]
            if b - a == 1 or i == j:
                continue
            logits = h[i:j] @ self.w[a:b].T
            logits += self.wb[a:b]
            found[i:j] += softmax(logits, y[i:j] - a)
            if grads is not None:
                grads["w"][a:b] += logits.T @ h[i:j]
                grads["wb"][a:b] += logits.sum(0)
                dh[i:j] += logits @ self.w[a:b]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return found[back], None if dh is None else dh[back]

    def gradients(self, ids: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
        """Gradient of the mean loss over a window, the state behind it, its tokens and the sum of their log-likelihoods."""
        steps, slots, n = *ids.shape, self.hidden
        hs, (hu, zr, new, live) = self.states(ids, h, trace=True)
        flat = np.zeros_like(self.flat)
        grads = self.views(flat)
        rows = self.room("states", steps, slots, n)
        rows[...] = hs[:-1].transpose(0, 2, 1)
        rows = rows.reshape(-1, n)
        there = valid.reshape(-1)
        full = bool(there.all())
        found, dout = self.outputs(rows if full else rows[there], ids.reshape(-1) if full else ids[valid], grads)
        if not full:
            dout, some = np.zeros((steps * slots, n), np.float32), dout
            dout[there] = some
        behind = self.room("behind", steps, n, slots)
        behind[...] = dout.reshape(steps, slots, n).transpose(0, 2, 1)
        dx, dhu = (self.room(name, steps, 3 * n, slots) for name in ("dx", "dhu"))
        carried, work = np.zeros((n, slots), np.float32), np.empty((n, slots), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, made = zr[t, :n], zr[t, n:], new[t]
            dz, dr, dn = dx[t, :n], dx[t, n:2 * n], dx[t, 2 * n:]
            carried *= live[t]
            np.subtract(hs[t], made, out=dz)
            dz *= carried
            dz *= z
            np.subtract(1, z, out=work)
            dz *= work
            np.multiply(carried, work, out=dn)
            np.multiply(made, made, out=work)
            np.subtract(1, work, out=work)
            dn *= work
            np.multiply(dn, hu[t, 2 * n:], out=dr)
            dr *= r
            np.subtract(1, r, out=work)
            dr *= work
            dhu[t, :2 * n] = dx[t, :2 * n]
            np.multiply(dn, r, out=dhu[t, 2 * n:])
            carried *= z
            carried += self.u @ dhu[t]
            carried += behind[t]
        by_row = self.room("by row", steps, slots, 3 * n)
        by_row[...] = dhu.transpose(0, 2, 1)
        grads["u"] += rows.T @ by_row.reshape(-1, 3 * n)
        by_row[...] = dx.transpose(0, 2, 1)
        seen = ids.reshape(-1)
        order = np.argsort(seen.astype(np.int16), kind="stable")
        starts = np.flatnonzero(np.diff(seen[order], prepend=-1))
        grads["x"][seen[order[starts]]] = np.add.reduceat(by_row.reshape(-1, 3 * n)[order], starts)
        tokens = int(there.sum())
        flat /= max(tokens, 1)
        return flat, hs[-1].copy(), tokens, float(found.sum(dtype=np.float64))


def packed(ids: np.ndarray, sizes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole documents laid into slots, the longest first into the slot with the least: token ids (steps, slots), -1
    behind a slot's end, and the document of each place. Slots are ordered from the longest to the shortest."""
    held = [(0, s) for s in range(min(slots, len(sizes)))]
    place = []
    for d in np.argsort(-sizes, kind="stable").tolist():
        used, s = held[0]
        place.append((d, s, used))
        heapq.heapreplace(held, (used + int(sizes[d]), s))
    lengths = np.zeros(len(held), np.int64)
    for used, s in held:
        lengths[s] = used
    column = np.empty(len(held), np.int64)
    column[np.argsort(-lengths, kind="stable")] = np.arange(len(held))
    tokens = np.full((len(held), int(lengths.max())), -1, np.int16)
    doc = np.zeros(tokens.shape, np.int32)
    starts = np.cumsum(sizes) - sizes
    for d, s, used in place:
        tokens[column[s], used:used + sizes[d]] = ids[starts[d]:starts[d] + sizes[d]]
        doc[column[s], used:used + sizes[d]] = d
    return np.ascontiguousarray(tokens.T), np.ascontiguousarray(doc.T)


def _windows(tokens: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """First step, end and number of slots that are still running of each window."""
    running = (tokens >= 0).sum(1)
    for a in range(0, len(tokens), length):
        yield a, min(a + length, len(tokens)), int(running[a])


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches together that hold about STEP_TOKENS, with their ids in a row and the size of each document."""
    held, many = [], 0

    def made():
        lists = [b.column(column) for b in held]
        return held, np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]), np.concatenate(
            [x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            many += len(batch.column(column).flatten())
        if many >= STEP_TOKENS:
            yield made()
            held, many = [], 0
    if held:
        yield made()


def train(coded: DataFrame, lexicon: Lexicon, settings: Settings = Settings()) -> np.ndarray:
    """Weights of the network after every document of ``coded`` has been learned from once. Second moments of the
    gradients are averaged and carried over with the weights."""
    _, counts, end_id, unknown = vocabulary(lexicon, settings)
    weights = Network(counts, end_id, unknown, settings).flat
    moments = np.zeros_like(weights)

    def learn(rate: float, first: bool):
        start = np.concatenate([weights, moments])

        def run(batches):
            net = Network(counts, end_id, unknown, settings)
            half = len(net.flat)
            net.set(start[:half].copy())
            square, slope = start[half:].copy(), np.zeros(half, np.float32)
            total, steps = 0, 0
            for _, ids, sizes in _grouped(batches, 0):
                tokens, _ = packed(ids, sizes, settings.slots)
                h = np.zeros((net.hidden, tokens.shape[1]), np.float32)
                for a, b, running in _windows(tokens, settings.window):
                    part = tokens[a:b, :running].astype(np.int32)
                    valid = part >= 0
                    part[~valid] = net.unknown
                    with np.errstate(over="ignore"):
                        grad, h, n, _ = net.gradients(part, valid, h[:, :running])
                    steps += 1
                    total += n
                    size = float(np.sqrt(np.dot(grad, grad)))
                    if size > 1:
                        grad /= size
                    slope += 0.1 * (grad - slope)
                    square += 0.01 * (grad * grad - square)
                    scale = 1 - 0.99 ** steps if first else 1.0
                    net.flat -= (rate / (1 - 0.9 ** steps)) * slope / (np.sqrt(square / scale) + 1e-6)
            if total:
                if first:
                    square /= 1 - 0.99 ** steps
                yield pa.RecordBatch.from_arrays([pa.array([float(total)]), pa.array(
                    [(np.concatenate([net.flat, square]) * np.float64(total)).tobytes()], pa.binary())], names=["n", "v"])
        return run

    def add(batches):
        n, held = 0.0, None
        for batch in batches:
            for r in batch.to_pylist():
                more = np.frombuffer(r["v"], np.float64)
                n, held = n + r["n"], more.copy() if held is None else held + more
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([held.tobytes()], pa.binary())], names=["n", "v"])

    shape = "n double, v binary"
    for k in range(settings.rounds):
        part = coded.where(F.pmod(F.xxhash64("row"), F.lit(settings.rounds)) == k).select("ids")
        tasks = part.mapInArrow(learn(settings.rate * 0.7 ** k, not moments.any()), shape)
        some = max(1, round(common.tasks(part) ** 0.5))
        found = tasks.repartition(some).mapInArrow(add, shape).repartition(1).mapInArrow(add, shape).first()
        if found is not None:
            both = (np.frombuffer(found["v"], np.float64) / found["n"]).astype(np.float32)
            weights, moments = both[:len(weights)], both[len(weights):]
    return weights


def score(coded: DataFrame, lexicon: Lexicon, weights: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """Kept columns, n_tokens, n_known, train_tokens, base_score (smoothed word counts) and score (the model's log10
    probability of the whole text)."""
    plain = coded.columns[:7]
    _, counts, end_id, unknown = vocabulary(lexicon, settings)

    def run(batches):
        net = Network(counts, end_id, unknown, settings)
        net.set(weights)
        for held, ids, sizes in _grouped(batches, 7):
            tokens, doc = packed(ids, sizes, settings.slots)
            h = np.zeros((net.hidden, tokens.shape[1]), np.float32)
            total = np.zeros(len(sizes))
            for a, b, running in _windows(tokens, 4 * settings.window):
                part = tokens[a:b, :running].astype(np.int32)
                valid = part >= 0
                part[~valid] = net.unknown
                with np.errstate(over="ignore"):
                    hs, _ = net.states(part, h[:, :running])
                found, _ = net.outputs(hs[:-1].transpose(0, 2, 1)[valid], part[valid])
                total += np.bincount(doc[a:b, :running][valid], weights=found, minlength=len(sizes))
                h = hs[-1].copy()
            total /= np.log(10)
            at = 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(total[at:at + batch.num_rows])],
                                                 names=[*plain, "model"])
                at += batch.num_rows

    # Words that are not listed: their counts by a join, summed for each row.
    rare = coded.select("row", F.explode("rare").alias("word"))
    known = lexicon.table.where("word IS NOT NULL")
    rare = rare.join(known, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log_rare"), F.count("c").alias("n_rare"))
    shape = StructType([*coded.schema.fields[:7], StructField("model", DoubleType())])
    made = coded.select(*plain, "ids").mapInArrow(run, shape).join(rare, "row", "left")
    log_rare, n_rare = F.coalesce("log_rare", F.lit(0.0)), F.coalesce("n_rare", F.lit(0).cast("long"))
    out_tokens, out_words = lexicon.outside(settings)
    all_log, out_log = (float(np.log10(x + 1.0)) for x in (lexicon.tokens + lexicon.distinct, out_tokens + out_words))
    return made.select("kept.*", "n_tokens", (F.col("n_listed") + n_rare).alias("n_known"),
                       F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
                       (F.col("log_listed") + log_rare - F.col("n_tokens") * all_log).alias("base_score"),
                       (F.col("model") + F.col("log_out") + log_rare - F.col("n_out") * out_log).alias("score")).drop("_none")


def fit_and_score(docs: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; texts are read twice."""
    marked = docs.withColumn("_held_out", held_out)
    lexicon = gather(marked.where(~F.col("_held_out")))
    keep = [c for c in docs.columns if c not in (*RESULTS, "text", "held_out")]
    coded = encode(marked.select(*[F.col(f"`{c}`") for c in keep], F.col("_held_out").alias("held_out"), "text"), lexicon,
                   settings, [*keep, "held_out"])
    weights = train(coded.where(~F.col("kept.held_out")), lexicon, settings)
    return score(coded, lexicon, weights, settings)
