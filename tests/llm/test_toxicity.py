import zlib

import numpy as np

from tabloom.llm.toxicity import apply, best_threshold, drop_toxic, fit, platt, score_documents, sigmoid, train


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"))
    return (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    plain, bad = [f"w{i}" for i in range(300)], ["rotten", "rottenly", "vile"]
    texts, y = [], rng.random(n) < 0.2
    for t in y:
        words = rng.choice(plain, rng.integers(3, 60)).tolist()
        if t:
            words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        texts.append(" ".join(words))
    return texts, y.astype(int)


def test_it_learns_words_and_calibrates():
    texts, y = made(1500)
    model = fit(texts, y, ["en" if i % 2 else "de" for i in range(len(y))])
    other, truth = made(400, 1)
    from tabloom.llm.toxicity import Hasher, pack

    score = model.score(pack(other, Hasher(model.rows)))
    assert auc(truth, score) > 0.95 and abs(score.mean() - truth.mean()) < 0.06 and {"", "de", "en"} <= set(model.thresholds)
    whole = " ".join(["w1"] * 30_000 + ["vile"])
    assert model.score(pack([whole], Hasher(model.rows)))[0] > model.score(pack([whole[:-5]], Hasher(model.rows)))[0]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    apart = rows[rows.held_out]
    assert auc(apart.toxic.to_numpy(), apart.score.to_numpy()) > 0.93
    assert (apart.predicted == apart.toxic).mean() > 0.95
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = {r.doc_id: r.score for r in score_documents(documents, labels).collect()}
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) toxic")
    b = {r.doc_id: r.score for r in score_documents(documents.selectExpr("doc_id", "text", "'xx' lang", "'s' source"), turned).collect()}
    assert a == b


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, i % 2) for i in range(14)] + [(None, 1, 1), (99, 1, 1), (5, 0, 1)], "doc_id long, toxic int, score int")
    out = score_documents(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    assert score_documents(nothing, labels).collect() == []
    assert len({r.score for r in score_documents(awkward, labels.where("toxic = 0")).collect()}) == 1
    kept = drop_toxic(awkward, labels)
    assert kept.columns == awkward.columns
    model = train(awkward, labels)
    assert apply(awkward, model, ["doc_id"]).count() == awkward.count()


def test_calibration():
    x = np.linspace(-4, 4, 400)
    y = (np.random.default_rng(0).random(400) < sigmoid(2 * x - 1)).astype(float)
    a, b = platt(x, y)
    assert abs(a - 2) < 0.6 and abs(b + 1) < 0.5
    assert 0.3 < best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1, 0, 0])) < 0.7


def test_scores_follow_the_mix_of_all_labels(spark, monkeypatch):
    from functools import partial

    from tabloom.llm import toxicity

    texts, bad = made(3000, 3)
    y = (np.random.default_rng(3).random(len(bad)) < np.where(bad, 0.6, 0.05)).astype(int)
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", partial(train, sample=(150, 150)))
    rows = score_documents(docs, labels).toPandas()
    assert abs(rows.score.mean() - y.mean()) < 0.04
    kept = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert kept == set(rows[rows.predicted == 0].doc_id)


def test_a_text_over_the_budget_ends_no_sample_and_one_class_rejects_nothing(spark):
    texts, y = made(300, 4)
    first = min((i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: zlib.crc32(str(i).encode()))
    texts[first] = "w1 " * 40_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y.tolist())), "doc_id long, toxic int")
    model = train(docs, labels, sample_chars=100_000)
    assert model.rows and model.thresholds
    for some in (labels.where("false"), labels.where("toxic = 1"), labels.where("toxic = 0").limit(1)):
        rows = score_documents(docs, some).collect()
        assert len(rows) == 300 and not any(r.predicted or r.lang_toxic for r in rows) and drop_toxic(docs, some).count() == 300
