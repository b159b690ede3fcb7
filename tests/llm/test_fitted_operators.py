"""Language identification, the compression classifier, top-k search and the registered queries."""

import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import llm_helpers as brute  # noqa: E402

from tidepanel.llm import compressq, langid, queries, topk  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_language_identification(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 +-! \n"), (-4, "and the of that with")], "doc_id long, text string")
    model = langid.fit(docs.where(~held_out))
    out = langid.predict(docs.where(held_out).withColumn("score", F.lit("clash")), model).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert out[-1] == out[-2] == out[-3] == ("und", 0.0) and out[-4][0] == "en"
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in langid.predict(docs, nothing).select("lang_pred").collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_kernel_against_sets():
    texts = ["The cat sat.", "le chat est là", "12", "A b"]
    sets = [langid.spectrum(t) for t in texts]
    assert sets[2] is None
    sets = [s for s in sets if s is not None]
    words = [" the cat sat ", " le chat est là ", " a b "]
    plain = [{w[i:i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)} for w in words]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    vocabulary = np.unique(np.concatenate(sets[:2]))
    presence = np.array([np.isin(vocabulary, s) for s in sets[:2]]).T.astype(np.float32)
    rows = langid.Kernel(vocabulary, presence, np.array([len(s) for s in sets[:2]], float)).rows(sets)
    for i in range(3):
        for j in range(2):
            assert rows[i, j] == pytest.approx(len(plain[i] & plain[j]) / (len(plain[i]) * len(plain[j])) ** 0.5)


def test_compression_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = compressq.fit(docs, labels.where(~held_out))
    out = compressq.score(docs.withColumn("predicted", F.lit("clash")), model).join(
        labels.where(held_out), "doc_id").toPandas()
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert ((out.score >= 0.3).astype(int) == out.predicted).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000)], "doc_id long, text string")
    scores = [r["score"] for r in compressq.score(odd, model).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    assert compressq.score(odd, compressq.fit(docs, labels.where("quality = 1"))).first()["score"] == 1.0
    assert compressq.score(odd, compressq.fit(docs, labels.limit(0))).first()["score"] == 0.5
    assert compressq.score(odd.limit(0), model).count() == 0


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=10)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 10),
                                                       (503, [float("inf")] * 10), (520, [1.0, 2.0]), (521, [3.0, 1.0]), (None, [1.0] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    found = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, x in fine:
        if q % 20 == 0:
            ranked = sorted((-int(x @ y), i) for i, y in fine if i != q and len(y) == len(x))[:20]
            assert sorted(found.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_huge_components_and_bounds():
    q, x = np.array([[2.0 ** 70, 1.0]]), np.array([[2.0 ** 70, 0.0], [1.0, 5.0], [-2.0 ** 70, 0.0]])
    row, ids, score = topk.best(q, np.array([9]), x, np.array([1, 2, 3]), 3)
    assert ids.tolist() == [1, 2, 3] and score[0] == topk.LONGEST and score[2] == -topk.LONGEST - 1
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(20, 12)), rng.normal(size=(30, 12))
    for m in (1, 2, 4, 6):
        assert (topk.statistics(a, m) @ topk.statistics(b, m).T >= a @ b.T - 1e-9).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    text = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert text(ours) == text(theirs)


def test_pipeline_against_brute_force(spark):
    """Every stage on the input it was given."""
    import corpus_pipeline
    import public_tokenizers

    from tidepanel.llm import pieces, secretscan

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        kept[name] = out.toPandas()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == names and out.dtypes == docs.dtypes
            docs = spark.createDataFrame(kept[name], docs.schema)
    rows = [tuple(r) for r in kept["quality_rules"].itertuples(index=False)]
    assert all(len(r[1].split()) >= 50 for r in rows)
    least = {c for _, c in brute.components(rows)}
    assert set(kept["near_dedup"].doc_id) == least and len(kept["near_dedup"]) == len(least)
    assert set(kept["secret_scan"].doc_id) == least
    assert not any(secretscan.matches(t) for t in kept["secret_scan"].text)
    assert set(kept["source_mixing"].doc_id) <= least
    _, library = pieces.loaded(public_tokenizers.path("piece_bpe_32k.model"))
    last = kept["sentencepiece"]
    assert set(last.doc_id) == set(kept["source_mixing"].doc_id)
    assert all(list(i) == library.encode(t) for i, t in zip(last.ids, last.text))
