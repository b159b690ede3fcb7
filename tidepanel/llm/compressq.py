"""Quality scores from compression: how much smaller a text gets with a dictionary of good than of bad text.

Two zstandard dictionaries are built from labelled samples, one for each label. A text is compressed with either;
the difference of the sizes over their sum, next to the two compression rates and the length, goes through a
logistic curve fitted on labelled texts that no dictionary has seen, weighted to the shares of the labels.

The fit is on a bounded sample: about ``sample_rows`` documents and at most ``sample_bytes`` of text for each label,
chosen by a hash of their ids; one half builds the dictionaries and the other fits the curve. Every text is scored,
whole. Null and empty texts get the score of a text of no bytes. Labels other than 0 and 1 and null labels teach
nothing; of repeated label rows each counts. With one label only, or no labels, every score is that label's share
(0.5 without labels). An empty table gives an empty table. Input columns that carry an added name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import share_of_hash

#: Samples for the dictionary builder are pieces of this many bytes.
PIECE = 2048


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes] | None     # of label 1 and 0
    weights: list[float]
    level: int

    def __post_init__(self):
        self._press = None

    def features(self, texts: list[bytes]) -> np.ndarray:
        if self._press is None:
            self._press = [zstandard.ZstdCompressor(
                level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False,
                write_content_size=False, write_dict_id=False) for d in self.dictionaries]
        sizes = np.array([[len(p.compress(t)) for p in self._press] for t in texts], float).reshape(-1, 2)
        n = np.array([len(t) for t in texts], float)
        d = (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 1] + sizes[:, 0])
        return np.c_[d, sizes[:, 0] / (n + 1), sizes[:, 1] / (n + 1), np.log1p(n), d * np.log1p(n), np.ones(len(n))]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(texts), self.weights[0])
        return _curve(self.features(texts) @ np.array(self.weights))

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "weights": self.weights, "level": self.level, "_press": None}


def _curve(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> list[float]:
    """Weights of a ridge logistic regression by Newton steps; the last column of x is constant."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[-1], scale[-1] = 0.0, 1.0
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _curve(z @ w)
        hess = z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, z.T @ (weight * (y - p)) - ridge * w)
    w /= scale
    w[-1] -= (w[:-1] * mean[:-1]).sum()
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = 1000, sample_bytes: int = 8 << 20, dictionary_bytes: int = 32 << 10,
        level: int = 3) -> Model:
    """Fit on the labelled documents of ``labels`` (id, label)."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        id_col, F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model(None, [float(next(iter(counts)))] if counts else [0.5], level)
    rate = F.when(F.col("label") == 1, sample_rows / counts[1]).otherwise(sample_rows / counts[0])
    marks = marks.withColumn("h", share_of_hash(id_col)).where(F.col("h") < rate)
    # The marks number about 2 * sample_rows whatever the input, and with them the texts that the join keeps.
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marks), id_col)
    so_far = Window.partitionBy("label").orderBy("h", id_col, "text")
    rows = texts.withColumn("upto", F.sum(F.octet_length("text")).over(so_far)).where(
        F.col("upto") <= sample_bytes).select("label", "h", "text").orderBy("h", "text").collect()
    halves: dict[tuple[int, int], list[bytes]] = {(y, k): [] for y in (0, 1) for k in (0, 1)}
    seen = {0: 0, 1: 0}
    for r in rows:
        halves[r["label"], seen[r["label"]] % 2].append(r["text"].encode())
        seen[r["label"]] += 1
    if not all(halves.values()):
        return Model(None, [counts[1] / total], level)
    model = Model(tuple(_dictionary(halves[y, 0], dictionary_bytes) for y in (1, 0)), [], level)
    x = model.features(halves[1, 1] + halves[0, 1])
    y = np.repeat([1.0, 0.0], [len(halves[1, 1]), len(halves[0, 1])])
    weight = np.where(y == 1, counts[1] / len(halves[1, 1]), counts[0] / len(halves[0, 1]))
    model.weights = logistic(x, y, weight * len(y) / weight.sum())
    return model


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[i:i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:                   # too little text to choose from: all of it is the dictionary
        return b"".join(pieces)[-size:] or b"\n" * 8


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``. One pass, no shuffle."""
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    drop_text = text_col not in keep
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    assert not drop_text, "the text column may not be named score or predicted"
    shared = df.sparkSession.sparkContext.broadcast(model)      # two dictionaries of a set size

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = model.scores([(t or "").encode() for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep]
                + [pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))],
                names=keep + ["score", "predicted"])

    return df.mapInArrow(run, schema)
