import math
import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from larkspur.llm import cotraining
from tests.llm.fixtures import documents, rows


def corpus(n=400):
    r = random.Random(2)
    found, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        own = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 120))]
        text = " ".join(own) + "." if good else " ".join(w + r.choice(["###", "$$$", "!!"]) for w in own)
        found.append((i, text, "en", f"src{r.randrange(4) + (0 if good else 2)}", len(text)))
        labels.append((i, int(good)))
    return found, labels


def test_held_out_accuracy_and_exchange(spark):
    found, labels = corpus()
    train = spark.createDataFrame([x for x in labels if x[0] % 5 and x[0] % 3], "doc_id long, quality int")
    df = documents(spark, found)
    model = cotraining.fit(df, train)
    assert model.exchanged[0] > 0
    got = {r.doc_id: r.keep for r in cotraining.score(df, model).collect()}
    test = [(i, y) for i, y in labels if not (i % 5 and i % 3)]
    assert np.mean([got[i] == bool(y) for i, y in test]) > 0.97
    kept = cotraining.filtered(df, model)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in got.items() if k}


def logistic(x, y, weight):
    """Ridge logistic regression on standardised columns by damped Newton steps; returns the function of its logit."""
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread < 1e-6, np.inf, spread)
    scaled = lambda q: np.hstack([(q - mean) / spread, np.ones((len(q), 1))])
    z, w = scaled(x), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = ridge @ w - sum(weight[i] * (y[i] - p[i]) * z[i] for i in range(len(z)))
        hessian = ridge + z.T @ np.diag(weight * p * (1 - p)) @ z
        w = w - np.linalg.solve(hessian, gradient)
    return lambda q: np.clip(scaled(q) @ w, -30, 30)


def brute_scores(found, labels, rounds, per_round, confidence):
    """Co-training over all rows at once, one document after the other."""
    given = sorted({r[0]: r for r in found}.values())
    views = [cotraining.text_features([r[1] for r in given]).astype(float), cotraining.metadata_features([r[3] for r in given], [r[2] for r in given], [r[4] for r in given]).astype(float)]
    y = dict(labels)
    hold = {i for i in y if zlib.crc32(f"hold{i}".encode()) % 4 == 0}
    prior = np.mean(list(y.values()))
    sets = [{i: (t, 1.0) for i, t in y.items() if i not in hold} for _ in views]
    place = {r[0]: k for k, r in enumerate(given)}

    def fitted(v):
        rows = [place[i] for i in sets[v]]
        return logistic(views[v][rows], np.array([sets[v][i][0] for i in sets[v]]), np.array([sets[v][i][1] for i in sets[v]]))

    models = [fitted(0), fitted(1)]
    for _ in range(rounds):
        logits = [m(x) for m, x in zip(models, views)]
        lessons = []
        for teacher in (0, 1):
            for label in (1, 0):
                sure = sorted((round(-logits[teacher][place[i]] * (1 if label else -1), 9), i) for i in place if i not in y and i not in sets[1 - teacher])
                k = max(1, round(per_round * (prior if label else 1 - prior)))
                lessons.append((1 - teacher, label, [i for s, i in sure if -s >= math.log(confidence / (1 - confidence))][:k]))
        for pupil, label, ids in lessons:
            sets[pupil] |= {i: (label, 0.5) for i in ids}
        if not any(ids for *_, ids in lessons):
            break
        models = [fitted(0), fitted(1)]
    rows, t, ones = [place[i] for i in sorted(hold)], np.array([y[i] for i in sorted(hold)]), np.ones(len(hold))
    logits = [m(x)[:, None] for m, x in zip(models, views)]
    own = np.hstack([logistic(x[rows], t, ones)(x)[:, None] for x in logits])
    return {r[0]: p for r, p in zip(given, 1 / (1 + np.exp(-logistic(own[rows], t, ones)(own))))}


def test_scores_equal_brute_force(spark):
    found, labels = corpus(240)
    known = [(i, y) if i % 11 else (i, 1 - y) for i, y in labels if i % 2]  # some wrong labels, so that no class is free of doubt
    df = documents(spark, found)
    for rounds, per_round, confidence in ((3, 12, 0.8), (2, 1000, 0.6)):
        model = cotraining.fit(df, spark.createDataFrame(known, "doc_id long, quality int"), rounds=rounds, per_round=per_round, confidence=confidence)
        expected = brute_scores(found, known, rounds, per_round, confidence)
        got = {r.doc_id: r.score for r in cotraining.score(df, model).collect()}
        assert min(model.exchanged) > 0
        assert max(abs(got[i] - expected[i]) for i in expected) < 1e-5


def test_filter_and_score_agree_whatever_the_types(spark):
    found, labels = corpus(200)
    df = documents(spark, found).withColumn("source", F.expr("cast(substr(source, 4) as int)")).withColumn("_view_text", F.lit(1))
    model = cotraining.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id for r in cotraining.score(df, model).collect() if r.keep}
    assert 0 < len(kept) < 200
    out = cotraining.filtered(df, model)
    assert out.schema == df.schema and {r.doc_id for r in out.collect()} == kept


def test_any_document_may_be_taught(spark):
    """Pseudo-labels go to the surest of all documents, wherever they are, and repeated ones are taught once."""
    r = np.random.default_rng(5)
    text = r.normal(size=(3000, cotraining.STYLE + cotraining.PAIRS)).astype(np.float32)
    meta = r.normal(size=(3000, cotraining.SOURCES + cotraining.LANGS + 3)).astype(np.float32)
    views = [cotraining.Logistic(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(r.normal(size=x.shape[1]), 0.0)) for x in (text, meta)]
    pool = spark.createDataFrame([(i, bytearray(t.tobytes()), bytearray(m.tobytes())) for i, (t, m) in enumerate(zip(text, meta))], "_id long, text binary, meta binary").repartition(7)
    taken = ({5, 6, 7}, set(range(0, 3000, 2)))
    found = cotraining.chooser(pool)(views, taken, [40, 1, 3000, 7], 2.0)
    for (_, pupil, _), sure, k, (ids, *_) in zip(cotraining.LESSONS, cotraining.sureness(views, (text, meta)), [40, 1, 3000, 7], found):
        expected = sorted((-s, i) for i, s in enumerate(sure) if s >= 2.0 and i not in taken[pupil])[:k]
        assert ids.tolist() == [i for _, i in expected]


def test_probabilities_are_calibrated(spark):
    found, labels = corpus()
    model = cotraining.fit(documents(spark, found), spark.createDataFrame(labels, "doc_id long, quality int"))
    p = [r.score for r in cotraining.score(documents(spark, found), model).collect()]
    assert abs(np.mean(p) - np.mean([y for _, y in labels])) < 0.05


def test_fitting_does_not_depend_on_partitions(spark):
    found, labels = corpus(200)
    y = spark.createDataFrame(labels[:120], "doc_id long, quality int")
    scores = []
    for parts in (1, 5):
        df = documents(spark, found).repartition(parts)
        scores.append({r.doc_id: r.score for r in cotraining.score(df, cotraining.fit(df, y)).collect()})
    assert scores[0] == scores[1]


def test_edge_cases(spark):
    df = documents(spark)
    no_labels = cotraining.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in cotraining.score(df, no_labels).collect()} == {0.5}
    one_class = cotraining.fit(df, spark.createDataFrame([(r[0], 1) for r in rows() if r[0] is not None], "doc_id long, quality int"))
    assert {r.score for r in cotraining.score(df, one_class).collect()} == {1.0}
    mixed = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows())] + [(3, None), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    assert cotraining.score(df, cotraining.fit(df, mixed)).count() == len(rows())
    assert cotraining.score(df.where("false"), no_labels).count() == 0
