"""Language identification with string kernels.

A text's blended spectrum is the set of its character n-grams of every length from 1 to 3, in lower case with
everything but letters as a space. The kernel of two texts is the number of n-grams in both, over the root of the
product of their own numbers. Nystrom landmarks (labelled texts) turn a text into its kernel values with each
landmark, whitened by the landmarks' own kernel matrix; one-versus-rest kernel ridge regression on these features
gives a score per language. Scoring multiplies a block of presence rows over the landmarks' n-grams with the
landmarks' presence matrix, and the result with the weights.

The fit is on a bounded sample, ``train_rows`` texts in all, ``landmarks`` of them as landmarks, spread evenly over
the languages and chosen by a hash of their ids; only landmarks' n-grams and kernel rows reach the driver. Every
text is scored whole. Null texts, and texts without a letter, get ``und`` and score 0. Rows with a null language
teach nothing. Without any training text every prediction is ``und``. Ties go to the language first in order.
Repeated rows are predicted one by one; an empty table gives an empty table. Input columns that carry an added
name are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import share_of_hash

SPACES = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: Texts in one matrix product.
BLOCK = 64


def spectrum(text: str | None) -> np.ndarray | None:
    """Sorted codes of the distinct 1-, 2- and 3-grams (21 bits a character), or None without a letter."""
    cleaned = SPACES.sub(" ", (text or "").lower()).strip()
    if not cleaned:
        return None
    c = np.frombuffer(f" {cleaned} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(np.concatenate([c, c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]]))


@dataclass
class Kernel:
    """Presence of the landmarks' n-grams."""
    grams: np.ndarray            # sorted codes of all landmarks
    presence: np.ndarray         # float32, n-grams x landmarks
    sizes: np.ndarray            # number of n-grams of each landmark

    def rows(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (by their spectra) with each landmark."""
        block = np.zeros((len(sets), len(self.grams)), np.float32)
        for k, grams in enumerate(sets):
            at = np.searchsorted(self.grams, grams)
            at[at == len(self.grams)] = 0
            block[k, at[self.grams[at] == grams]] = 1
        n = np.array([len(g) for g in sets], np.float64)
        return (block @ self.presence).astype(np.float64) / np.sqrt(np.outer(n, self.sizes))


@dataclass
class Model:
    kernel: Kernel | None
    weights: np.ndarray | None   # landmarks (and a constant) x languages
    languages: list[str]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.kernel is None:
            return names, scores
        for start in range(0, len(texts), BLOCK):
            sets = [(k, g) for k in range(start, min(start + BLOCK, len(texts)))
                    if (g := spectrum(texts[k])) is not None]
            if not sets:
                continue
            rows = self.kernel.rows([g for _, g in sets])
            values = np.c_[rows, np.ones(len(rows))] @ self.weights
            best = values.argmax(1)
            for (k, _), b, row in zip(sets, best, values):
                names[k] = self.languages[b]
                scores[k] = float(np.clip((row[b] + 1) / 2, 0, 1))   # targets are 1 and -1
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_rows: int = 1600, landmarks: int = 160, ridge: float = 1e-2) -> Model:
    """Fit on the rows of ``docs`` with a language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(None, None, [])
    languages = sorted(counts)
    share = train_rows / len(languages)
    rate = F.element_at(F.create_map(*[F.lit(x) for y in languages for x in (y, min(1.0, share / counts[y]))]),
                        F.col("lang"))
    # About train_rows rows whatever the input.
    sample = known.withColumn("h", share_of_hash("id")).where(F.col("h") < rate)
    first = sample.where(F.col("h") < rate * min(1.0, landmarks / train_rows))

    def grams(batches):
        for batch in batches:
            sets = [s for t in batch.column(0).to_pylist() if (s := spectrum(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], names=["grams"])

    sets = [np.array(r["grams"], np.int64) for r in first.select("text", "h").orderBy("h", "text").select("text")
            .mapInArrow(grams, "grams array<long>").collect()]
    if not sets:
        return Model(None, None, [])
    vocabulary = np.unique(np.concatenate(sets))
    presence = np.zeros((len(vocabulary), len(sets)), np.float32)
    for k, s in enumerate(sets):
        presence[np.searchsorted(vocabulary, s), k] = 1
    kernel = Kernel(vocabulary, presence, np.array([len(s) for s in sets], np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(kernel)

    def rows(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(texts), BLOCK):
                kept = [(g, y) for t, y in zip(texts[start:start + BLOCK], langs[start:start + BLOCK])
                        if (g := spectrum(t)) is not None]
                if kept:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shared.value.rows([g for g, _ in kept]).tolist(), pa.list_(pa.float64())),
                        pa.array([y for _, y in kept], pa.string())], names=["k", "lang"])

    found = sample.select("text", "lang").mapInArrow(rows, "k array<double>, lang string") \
        .orderBy("lang", "k").collect()
    x = np.array([r["k"] for r in found])
    y = np.where(np.array([r["lang"] for r in found])[:, None] == np.array(languages), 1.0, -1.0)
    # Whitening by the landmarks' own kernel: features z = k @ half, with half = K^(-1/2).
    own = kernel.rows(sets)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-8 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    z = np.c_[x @ half, np.ones(len(x))]
    penalty = ridge * len(z) / 100 * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    return Model(kernel, np.vstack([half @ solved[:-1], solved[-1:]]), languages)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1). One pass, no shuffle."""
    added = ("lang_pred", "score")
    keep = [c for c in df.columns if c not in added]
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)    # landmarks x their n-grams, both bounded

    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep]
                + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=keep + list(added))

    return df.mapInArrow(run, schema)
