"""Classifiers on held-out rows, searches against brute force, the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftkit.llm import toxicity
from driftkit.llm.ann import approximate_neighbours
from driftkit.llm.quality import quality_scores
from driftkit.llm.topk import exact_top_k
from driftkit.llm.toxicity import toxicity_scores

DATA = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("scores, label, least", [(toxicity_scores, "toxic", 0.97), (quality_scores, "quality", 0.95)])
def test_held_out_accuracy(spark, odd_docs, no_docs, scores, label, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got[label].to_numpy()) >= least
    odd = scores(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert scores(no_docs, labels).count() == 0
    blank = scores(odd_docs, labels.limit(0)).collect()  # nothing to learn from
    assert len(blank) == len(odd) and len({r.score for r in blank}) == 1


def test_rare_words_reach_their_examples(spark):
    """Toxic texts whose words are each too rare to be associated with the label."""
    clean = [(i, f"plain common text about topic{i} and place{i}") for i in range(300)]
    code = [chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(60)]
    toxic = [(1000 + i, f"{c}vexar {c}dolmik and {c}urbat") for i, c in enumerate(code)]
    asked = [(5000 + i, f"{c}vexar {c}dolmik and {c}urbat") for i, c in enumerate(code)]
    docs = spark.createDataFrame(clean + toxic + asked + [(9000, "zzyx")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + toxic], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    learnt = [i for i in range(60) if not got[1000 + i].held_out]
    assert len(learnt) > 20
    for i in learnt:
        assert got[5000 + i].evidence[0] == 1000 + i
        assert got[5000 + i].predicted == 1 and got[1000 + i].predicted == 1
    assert not any(got[i].predicted for i, _ in clean) and not got[9000].evidence


def test_recall_at_the_threshold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got[got.toxic == 1]
    assert (toxic.predicted == 1).mean() >= 0.9 and (got[got.toxic == 0].predicted == 1).mean() <= 0.015
    for lo in (0.0, 0.8):  # of the outer score bins, the share of toxic rows is near the mean score
        part = got[(got.score >= lo) & (got.score < lo + 0.2)]
        assert abs(part.score.mean() - part.toxic.mean()) < 0.06


def test_nearest_examples_against_brute_force(spark, odd_docs, monkeypatch):
    """Places, cosines and ties of the block-max search; rare terms, long texts, no shared term."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(odd_docs.selectExpr("doc_id + 1000000 AS doc_id", "text"))
    docs = docs.unionByName(docs.where("doc_id < 40").selectExpr("doc_id + 2000000 AS doc_id", "text"))  # copies
    copied = labels.unionByName(labels.where("doc_id < 40").selectExpr("doc_id + 2000000 AS doc_id", "quality", "toxic"))
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    index, sample = toxicity.fit_index(docs, copied, 200, 10.0, 3)
    index = index.open()
    assert index.blocks > 20
    dense = np.zeros((len(index.ids), len(index.idf)))
    term, example, value = index.postings
    dense[example, term] = value
    assert np.allclose((dense ** 2).sum(1)[(dense ** 2).sum(1) > 0], 1)
    matcher = toxicity.Matcher(index.vocabulary)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for _, text in texts:
        terms, counts = matcher((text or "").encode())
        weights = index.vector(terms, counts)
        (at, cosine), = index.nearest([(terms, weights)], 15)
        full = np.round(dense[:, terms] @ weights, 9)
        want = [i for i in np.lexsort((index.ids, -full))[:15] if full[i] > 0]
        assert np.allclose(cosine, full[want], atol=2e-9)
        clear = [i for i in range(len(want)) if (np.abs(full - full[want[i]]) < 1e-7).sum() == 1]
        assert [at[i] for i in clear] == [want[i] for i in clear]
    # document frequencies count all documents
    n = {}
    for _, text in texts:
        for t in toxicity.text_terms((text or "").encode()):
            n[t] = n.get(t, 0) + 1
    assert np.allclose(index.idf, [np.log((1 + len(texts)) / (1 + n[t])) + 1 for t in index.vocabulary])


def test_calibration_is_logistic_and_rising():
    rng = np.random.default_rng(0)
    vote = rng.random(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * np.log(vote / (1 - vote)) + 1))).astype(float)
    slope, offset = toxicity.fit_calibration(vote, y, np.ones(4000))
    assert abs(slope - 2) < 0.2 and abs(offset + 1) < 0.2
    assert toxicity.fit_calibration(vote, np.zeros(4000), np.ones(4000)) == (1.0, 0.0)


@pytest.mark.parametrize("scores, label", [(toxicity_scores, "toxic"), (quality_scores, "quality")])
def test_scores_do_not_use_held_out_labels(spark, scores, label):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    copies = docs.unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 10_000_000))  # copies score alike
    rows = [sorted((r.doc_id, r.score) for r in scores(copies, x).collect()) for x in (labels, turned)]
    assert rows[0] == rows[1]
    by_id = dict(rows[0])
    assert all(by_id[i] == by_id[i - 10_000_000] for i in by_id if i >= 10_000_000)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 1) for i in range(0, 120)]
    rows += [(200, None, 0), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (300, [float("nan")] * 6, 0), (350, [float("inf")] * 6, 0), (400, [0.0] * 6, 0), (450, [], 0), (500, [1.0, 2.0], 0), (501, [2.0, 2.0], 0), (None, [1.0] * 6, 0)]
    rows += [rows[0], rows[7], (601, rows[7][1], 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")


def test_exact_top_k(odd_vectors):
    vecs = {r.vec_id: [int(np.floor(256 * x)) for x in r.embedding] for r in odd_vectors.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)}
    want = []
    for q, v in vecs.items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in vecs.items() if c != q and len(w) == len(v))[:5]
            want += [(q, i + 1, c, -x) for i, (x, c) in enumerate(s)]
    assert sorted(map(tuple, exact_top_k(odd_vectors).collect())) == sorted(want)
    assert exact_top_k(odd_vectors.limit(0)).count() == 0


def test_blocks_are_not_gathered_by_section(odd_vectors, monkeypatch):
    """Several blocks and salts give the same rows, and no window or join holds a section's blocks in one task."""
    want = sorted(map(tuple, exact_top_k(odd_vectors).collect()))
    monkeypatch.setattr("driftkit.llm.topk.BLOCK_ROWS", 4)
    monkeypatch.setattr("driftkit.llm.topk.QUERY_ROWS", 2)
    for search in (exact_top_k, approximate_neighbours):
        got = search(odd_vectors)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(section" not in plan
        assert not [x for x in plan.split("\n") if "SortMergeJoin [section" in x and "salt" not in x]
        if search is exact_top_k:
            assert sorted(map(tuple, got.collect())) == want


def test_neighbours_small_table_is_exact(odd_vectors):
    vecs = {r.vec_id: r.embedding for r in odd_vectors.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}
    want = []
    for q, v in vecs.items():
        if q % 100 == 0:
            s = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), c) for c, w in vecs.items() if c != q and len(w) == len(v))[:10]
            want += [(q, i + 1, c, pytest.approx(x)) for i, (x, c) in enumerate(s)]
    assert sorted(map(tuple, approximate_neighbours(odd_vectors).collect())) == sorted(want, key=lambda r: r[:2])
    assert approximate_neighbours(odd_vectors.limit(0)).count() == 0


def test_neighbours_recall(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = emb.select("vec_id", "embedding").toPandas()
    x, ids = np.array(pdf.embedding.tolist(), float), pdf.vec_id.to_numpy()
    got = approximate_neighbours(emb).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits.append(len(got[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_pipeline_stages(spark, odd_docs):
    import corpus_pipeline as p

    docs = odd_docs
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(p.STAGES) - 1:
            assert out.columns == odd_docs.columns, name
            kept = out.collect()
            docs = spark.createDataFrame(kept, odd_docs.schema)
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in kept if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and 6 not in ids and 5 in ids
    assert out.count() > 0
    assert p.run(spark, "/root/testdata/sf0.001").count() > 0
