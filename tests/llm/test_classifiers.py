import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import quality_classifier, queries, toxicity
from tokenloom.llm.jaccard_join import JaccardJoin
from tokenloom.llm.labels import training_labels

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
DOCS = "doc_id long, text string, score double, y int"


def made(n=400):
    """Texts, a third of them junk and a fifth with insults, and their labels."""
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(["the", "of", "river", "house", "green", "walk", "table", "seven"]) for _ in range(r.randint(60, 160))]
        toxic, good = int(r.random() < 0.2), int(r.random() < 0.67)
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["idiot", "moron", "blarghface"])
        text = " ".join(words) if good else "### ".join(w.upper() for w in words)
        docs.append((i, text, 0.5, 1))
        labels.append((i, good, toxic))
    return docs, labels


def test_classifiers_learn_and_hold_out(spark):
    docs, labels = made()
    extra = [(1000, None, 0.5, 1), (1001, "", 0.5, 1), (1001, "", 0.5, 1), (None, "no id", 0.5, 1), (1002, "idiot " * 5000, 0.5, 1)]
    frame, known = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (2000, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for score, column, modulus, rest in ((toxicity.score_toxicity, 2, 5, 0), (quality_classifier.score_quality, 1, 4, 2)):
        rows = score(frame, known).collect()
        assert len(rows) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in rows)
        by_id = {r["doc_id"]: r for r in rows}
        assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest) for i, *_ in docs) and not by_id[None]["held_out"]
        held = [x for x in labels if by_id[x[0]]["held_out"]]
        assert np.mean([by_id[x[0]]["predicted"] == x[column] for x in held]) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs, labels = made(200)
    frame = spark.createDataFrame(docs, DOCS)
    for score, modulus, rest in ((toxicity.score_toxicity, 5, 0), (quality_classifier.score_quality, 4, 2)):
        turned = [(i, 1 - a, 1 - b) if zlib.crc32(str(i).encode()) % modulus == rest else (i, a, b) for i, a, b in labels]
        one, two = ({r["doc_id"]: r["score"] for r in score(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned))
        assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-6


def test_without_labels_or_rows(spark):
    frame, none = spark.createDataFrame([(1, "some words", 0.1, 0), (2, "you idiot", 0.1, 0)], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality_classifier.score_quality):
        assert score(frame, none).count() == 2
        assert score(spark.createDataFrame([], DOCS), none).count() == 0


def test_training_sample_is_bounded(spark):
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic")
    rows = training_labels(labels, "toxic", 5, 0, rows=200).collect()
    assert 100 < sum(r["y"] for r in rows) < 300 and 100 < sum(1 - r["y"] for r in rows) < 300
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_quality_keeps_the_balance_of_many_labels(spark):
    docs = spark.range(120_000).selectExpr("id as doc_id", "'some words' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 > 0 as int) as quality")
    score = quality_classifier.score_quality(docs, labels).agg({"score": "avg"}).first()[0]
    assert abs(score - 0.9) < 0.01


def test_toxicity_counts_every_label(spark, monkeypatch):
    docs = spark.range(120_000).selectExpr("id as doc_id", "'some words' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 10 = 0 as int) as toxic")
    counted, fit = [], toxicity.fit_label_model

    def spy(patterns):
        counted.append(tuple(patterns.selectExpr("sum(n)", "sum(clean)", "sum(toxic)").first()))
        return fit(patterns)

    monkeypatch.setattr(toxicity, "fit_label_model", spy)
    terms = toxicity.Terms([])
    toxicity.fit_toxicity(docs.select("doc_id", toxicity.measured_by(terms, F.col("text")).alias("m")), labels, terms)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(120_000))
    toxic = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(0, 120_000, 10))
    assert counted == [(held, 120_000 - held - toxic, toxic)]


def votes_of(seed=7, n=4000):
    """Votes of three voters, the second mostly a copy of the first, their classes, and which of these are known."""
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.3
    good = np.where(r.random(n) < 0.9, y, ~y)
    copy = np.where(r.random(n) < 0.95, good, ~good)
    weak = np.where(r.random(n) < 0.6, y, ~y)
    return ["".join("01"[int(x)] for x in v) for v in zip(good, copy, weak)], y, np.arange(n) < n // 4


def test_label_model_finds_accuracies_and_correlations(spark):
    votes, y, known = votes_of()
    rows = [(p, *(int(sum(v == p and (not known[i] if k < 0 else known[i] and y[i] == k) for i, v in enumerate(votes))) for k in (-1, 0, 1))) for p in sorted({*votes})]
    model = toxicity.fit_label_model(spark.createDataFrame(rows, "votes string, n long, clean long, toxic long"))
    for p, *_ in rows:
        truth = np.mean([y[i] for i, v in enumerate(votes) if v == p])
        assert abs(model.posterior([p])[0] - truth) < 0.12
    assert {frozenset((i, q)) for i, q in enumerate(model.parent) if q >= 0} >= {frozenset((0, 1))}
    # one more step of expectation maximisation, document by document, changes nothing
    q = {p: float(model.posterior([p])[0]) for p, *_ in rows}
    weight = [[1 - t, t] for t in (float(y[i]) if known[i] else q[v] for i, v in enumerate(votes))]
    for i, parent in enumerate(model.parent):
        for c in (0, 1):
            alone = [0.5 + sum(w[c] for v, w in zip(votes, weight) if v[i] == x) for x in "01-"]
            for a, above in enumerate("01"):
                own = [2 * alone[b] / sum(alone) + (sum(w[c] for v, w in zip(votes, weight) if v[parent] == above and v[i] == x) if parent >= 0 else 0) for b, x in enumerate("01-")]
                assert np.allclose(np.exp(model.tables[i][c][a]), np.array(own) / sum(own), atol=2e-3)


def test_every_row_is_fitted_on_its_posterior(spark, monkeypatch):
    docs, labels = made(300)
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models, fit = [], toxicity.fit_label_model
    monkeypatch.setattr(toxicity, "fit_label_model", lambda patterns: models.append(fit(patterns)) or models[-1])
    terms = toxicity.Terms(toxicity.mined_terms(frame, training_labels(known, "toxic", *toxicity.FOLD)))
    own = toxicity.fit_toxicity(frame.select("doc_id", toxicity.measured_by(terms, F.col("text")).alias("m")), known, terms)
    # slow reference: the gradient of the penalised loss over all rows outside the fold, posteriors as labels, is zero
    rows = [terms.measure(t) for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 5]
    x = np.zeros((len(rows), len(own.weights)))
    for i, r in enumerate(rows):
        x[i, r["terms"]] = r["counts"]
        x[i, own.n_terms : -1] = own.dense([r])[0]
        x[i, -1] = 1
    score = 1 / (1 + np.exp(-x @ own.weights))
    gradient = x.T @ (score - models[0].posterior([r["votes"] for r in rows])) / len(rows) + toxicity.PENALTY * np.r_[own.weights[:-1], 0]
    assert np.abs(gradient).max() < 1e-3
    assert np.allclose(own.score(rows), score)


def test_quality_scores_against_a_slow_reference(spark):
    docs, labels = made(240)
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score_quality(frame, known).collect()}
    x = np.array([quality_classifier.statistics(t) for _, t, *_ in docs])
    model = quality_classifier.Model(x.mean(0), x.std(0))
    z = model.features(x)
    y = np.array([q for _, q, _ in labels], float)
    train = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i, *_ in docs])
    fold = quality_classifier.fold_of(np.array([i for i, *_ in docs]))

    def ridge(use):
        a = np.diag([quality_classifier.RIDGE * use.sum()] * quality_classifier.FEATURES + [1e-9])
        for row in z[use]:
            a = a + np.outer(row, row)
        return np.linalg.solve(a, z[use].T @ y[use])

    unseen = np.array([z[i] @ ridge(train & (fold != fold[i])) for i in np.flatnonzero(train)])
    bins = np.clip((unseen + 0.5) * quality_classifier.BINS / 2, 0, quality_classifier.BINS - 1).astype(int)
    kinds = sorted({*bins.tolist()})
    n, good = ([float((bins == b).sum()) for b in kinds], [float(y[train][bins == b].sum()) for b in kinds])
    prior = sum(good) / sum(n)
    value, weight = [(g + prior) / (m + 1) for g, m in zip(good, n)], [m + 1 for m in n]
    mean = lambda i, j: sum(v * w for v, w in zip(value[i:j], weight[i:j])) / sum(weight[i:j])
    monotone = [max(min(mean(i, j) for j in range(k + 1, len(kinds) + 1)) for i in range(k + 1)) for k in range(len(kinds))]  # the min-max formula
    # blocks of equal values are one knot at their weighted mean place
    place, knots = [(b + 0.5) * 2 / quality_classifier.BINS - 0.5 for b in kinds], []
    for v in sorted({round(m, 12) for m in monotone}):
        own = [k for k, m in enumerate(monotone) if round(m, 12) == v]
        knots.append((sum(place[k] * weight[k] for k in own) / sum(weight[k] for k in own), v))
    raw = z @ ridge(train)
    want = np.clip(np.interp(raw, *zip(*knots)), 0, 1)
    assert np.allclose([got[i] for i, *_ in docs], want, atol=1e-6)


def test_isotonic_is_the_best_monotone_fit():
    knots = quality_classifier.isotonic(np.arange(5.0), np.array([0.0, 0.6, 0.4, 0.4, 1.0]), np.array([1.0, 1, 1, 2, 1]))
    assert np.allclose(knots[:, 1], [0, 0.45, 1])


@needs_tables
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for i, (name, apply) in enumerate(corpus_pipeline.STAGES):
        after = apply(spark, before, FOLDER)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if i < 3:
            assert after.columns == docs.columns and after.subtract(before).count() == 0 and 0 < after.count() < before.count()
        if name == "quality":
            kept = {r["doc_id"] for r in quality_classifier.score_quality(before, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in after.collect()} == kept
        if name == "toxicity":
            kept = {r["doc_id"] for r in toxicity.score_toxicity(before, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 0").collect()}
            assert {r["doc_id"] for r in after.collect()} == kept
        if name == "near_copies":
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in JaccardJoin(before, 5, 80).classes().collect()}
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
        before = after


@needs_tables
def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    own = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, FOLDER), own.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))
