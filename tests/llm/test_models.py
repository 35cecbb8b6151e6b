import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import quality_gam, toxicity
from tickloom.llm.labelled import held_out, labelled_sample

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("query,label", [(quality_gam.op5_quality, "quality"), (toxicity.op9_toxicity, "toxic")])
def test_held_out_accuracy(spark, query, label):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    positive, negative = ([r.score for r in rows if r[label] == v] for v in (1, 0))
    right = np.mean([r.predicted == r[label] for r in rows])
    assert right > 0.97 and np.mean(np.array(positive)[:, None] > np.array(negative)) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_no_labels_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "some words here"), (4, "x" * 200_000)], SCHEMA).selectExpr("*", "0 AS n", "'a' AS term")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_gam.fit_quality(docs, none)
    scores = [r.quality_score for r in quality_gam.score_quality(docs, model).collect()]
    assert len(scores) == 4 and all(s == pytest.approx(0.5) for s in scores)
    terms, weights = toxicity.fit_toxicity(docs, none)
    got = toxicity.score_toxicity(docs, terms, weights)
    assert [r.toxicity for r in got.collect()] == [0.5] * 4 and got.columns == [*docs.columns, "toxicity"]
    assert quality_gam.score_quality(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (4, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality_gam.score_quality(docs, quality_gam.fit_quality(docs, one)).count() == 4
    assert toxicity.score_toxicity(docs, *toxicity.fit_toxicity(docs, one)).count() == 4
    with pytest.raises(ValueError):
        quality_gam.score_quality(docs, model, into="n")


def test_folds(spark):
    import zlib

    ids = spark.range(50)
    got = {r.id: r.h for r in ids.select("id", held_out(ids.id).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_label_model_sees_correlated_voters_once():
    """Six copies of a weak voter are one: the model is about as good as who knows all rates, and better than who counts them six times."""
    rnd = np.random.default_rng(0)
    n = 20_000
    y = rnd.random(n) < 0.3
    strong = (rnd.random((n, 3)) < np.where(y, 0.7, 0.02)[:, None]).astype(float)
    copies = np.repeat((rnd.random((n, 1)) < np.where(y, 0.5, 0.2)[:, None]).astype(float), 6, axis=1)
    v, half = np.hstack([strong, copies]), n // 2
    model = toxicity.LabelModel.fit(v[:half], y[:half].astype(float), v[half:])
    assert len(set(model.clusters[3:])) == 1 and len(set(model.clusters)) == 4
    copied = np.where(copies[:, 0] > 0, np.log(0.5 / 0.2), np.log(0.5 / 0.8))
    once = np.log(0.3 / 0.7) + np.where(strong > 0, np.log(0.7 / 0.02), np.log(0.3 / 0.98)).sum(axis=1) + copied
    best, worst = (((odds > 0) == y)[half:].mean() for odds in (once, once + 5 * copied))
    assert worst + 0.02 < best - 0.01 < ((model.posterior > 0.5) == y[half:]).mean()


def test_label_model_estimates_accuracies_without_labels():
    """Independent voters of known rates, two that copy one another, and a mined fold that flatters its voters."""
    rnd = np.random.default_rng(1)
    y = rnd.random(8000) < 0.3
    bad, good = np.array([0.8, 0.6, 0.5, 0.7, 0.6]), np.array([0.02, 0.05, 0.02, 0.01, 0.03])
    v = (rnd.random((8000, 5)) < np.where(y[:, None], bad, good)).astype(float)
    v[:2000] = np.where(y[:2000, None] & (rnd.random((2000, 5)) < 0.2), 1.0, v[:2000])
    v = np.hstack([v, v[:, :1]])
    model = toxicity.LabelModel.fit(v[:2000], y[:2000].astype(float), v[2000:])
    assert np.abs(model.toxic_rates[:5] - bad).max() < 0.06 and np.abs(model.clean_rates[:5] - good).max() < 0.04
    assert model.correlations[0, 5] > 0.9 and model.clusters[0] == model.clusters[5]
    assert ((model.posterior > 0.5) == y[2000:]).mean() > 0.96


def test_posteriors_come_from_votes_alone(spark):
    """They agree with labels that the model has not seen, and stay the same when these are others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "cross_fitted", lambda *a, f=toxicity.cross_fitted: seen.append((*a, f(*a))) or seen[-1][-1])
        toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)
    x, y, fold, terms, by_fold, p = seen[0]
    for k in (0, 1):
        assert ((p > 0.5) == y)[fold == k].mean() >= 0.95 > (y[fold == k] == 0).mean()
        changed = np.where(fold == k, 1 - y, y)
        assert (toxicity.cross_fitted(x, changed, fold, terms, by_fold)[fold == k] == p[fold == k]).all()


def test_sample_is_bounded_by_rows(spark):
    """One id with many rows, and one with two labels, are a row each."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "two"), (3, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    free = {r.id for r in spark.range(4).where(~held_out(F.col("id"))).collect()}
    got = {r.doc_id: (r.text, r.y) for r in labelled_sample(docs, labels, "quality").collect()}
    assert set(got) == {1, 2, 3} & free and got.get(2, ("two", 1)) == ("two", 1) and got.get(3, (None, 1)) == (None, 1)
    assert labelled_sample(docs, labels, "quality").count() == len(got) and labelled_sample(docs, labels, "toxic", 1).count() <= 1


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.Gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
