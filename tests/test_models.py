"""Results of training, tuning, selection and explanation, against numpy and by their laws."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tabloom.operators import select, shap, train, tune


@pytest.fixture(scope="module")
def frame(spark):
    """Two informative columns, two of noise; a class and a number that depend on the first two."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["id"], pdf["y"] = np.arange(300), (x[:, 0] + x[:, 1] + 0.5 * rng.normal(size=300) > 0).astype(int)
    pdf["z"] = 3 * x[:, 0] + x[:, 1] ** 2
    return spark.createDataFrame(pdf).cache()


def validator(metric, problem="classification", target="y", features="abcd"):
    return train.CrossValidationTrainer(problem, metric, target, list(features), "id", 3)


def lr():
    return LogisticRegression(maxIter=10)


def arrays(oof):
    rows = oof.orderBy("id").collect()
    return np.array([r.y for r in rows]), np.array([r.probability[1] for r in rows])


def f1(y, p):
    return 2 * (y & p).sum() / (y.sum() + p.sum())


def test_cutoff_is_the_best_of_all_scores(frame):
    cv = validator("F1")
    cutoff, score = tune.CutoffTunerCV(lr(), cv).tune(frame)
    y, p = arrays(cv.oof_)
    best = max(f1(y, (p >= c).astype(int)) for c in p if 0.01 <= c <= 0.99)
    assert score == pytest.approx(best) and f1(y, (p >= cutoff).astype(int)) == pytest.approx(best)


def test_folds_are_disjoint_and_models_are_averaged(frame):
    cv = validator("Roc AUC")
    train_scores, valid_scores, test = cv.fit(lr(), frame, frame)
    assert len(train_scores) == len(valid_scores) == 3 and cv.oof_.count() == cv.oof_.select("id").distinct().count() == 300
    each = [cv.trainer.predict(m, frame).orderBy("id").collect() for _, m in cv.models_]
    mean = np.mean([[r.probability[1] for r in rows] for rows in each], axis=0)
    got = test.orderBy("id").collect()
    assert [r.probability[1] for r in got] == pytest.approx(mean.tolist())
    sure = cv.predict_with_confidence(frame).orderBy("id").collect()
    spread = np.std([[r.probability[g.prediction] for r, g in zip(rows, got, strict=True)] for rows in each], axis=0)
    assert [r.disagreement for r in sure] == pytest.approx(spread.tolist()) and [r.confidence for r in sure] == pytest.approx([max(r.probability) for r in got])


def pooled(p, y):
    """Isotonic regression by pooling neighbours that go down."""
    order = np.argsort(p, kind="stable")
    blocks = []
    for v in y[order].astype(float):
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    out = np.empty(len(p))
    out[order] = np.concatenate([[v] * n for v, n in blocks])
    return out


def test_calibrators(frame):
    cv = validator("Log Loss")
    cv.fit(lr(), frame)
    y, p = arrays(cv.oof_)
    _, q = arrays(train.Calibrator("isotonic").fit(cv.oof_, "y").transform(cv.oof_))
    assert q.tolist() == pytest.approx(np.clip(pooled(p, y), 1e-6, 1 - 1e-6).tolist(), abs=1e-6)
    c = train.Calibrator("sigmoid").fit(cv.oof_, "y")
    _, a, b = c.models_[1]
    loss = lambda a, b: -np.mean(np.log(np.where(y == 1, 1 / (1 + np.exp(-a * p - b)), 1 / (1 + np.exp(a * p + b)))))
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-6 for da in (-0.1, 0, 0.1) for db in (-0.1, 0, 0.1))
    _, s = arrays(c.transform(cv.oof_))
    assert s.tolist() == pytest.approx((1 / (1 + np.exp(-a * p - b))).tolist())
    model = train.CalibratedModel(lr(), "y", list("abcd"), "id", "sigmoid").fit(frame)
    plain = train.BaseTrainer("classification", "y", list("abcd"))
    _, raw = arrays(plain.predict(plain.fit_estimator(lr(), frame), frame))
    _, a, b = model.calibrator.models_[1]
    _, done = arrays(model.predict(frame))
    assert done.tolist() == pytest.approx((1 / (1 + np.exp(-a * raw - b))).tolist(), abs=1e-6)


def test_calibration_choice_takes_the_best(frame):
    chosen = tune.ClassificationCalibrator(lr(), validator("Roc AUC")).fit(frame)
    table = {m: (v, brier) for m, v, _e, brier in chosen.table_}
    assert set(table) == {"Uncalibrated", "isotonic", "sigmoid"} and chosen.best_ == min(table, key=lambda m: table[m][0])
    y, p = arrays(chosen.cv.oof_)
    assert table["Uncalibrated"][1] == pytest.approx(((p - y) ** 2).mean())
    assert set(chosen.calibration_curves()) == set(table)


def test_out_of_fold_model_and_ensembles(frame):
    cv = validator("Roc AUC")
    model = train.OOFModel(lr(), cv, True, "sigmoid").fit(frame)
    _, a, b = model.calibrator_.models_[1]
    _, raw = arrays(cv.trainer.predict(model.final_[1], frame))
    _, done = arrays(model.predict(frame))
    assert done.tolist() == pytest.approx((1 / (1 + np.exp(-a * raw - b))).tolist(), abs=1e-6)
    forest = RandomForestClassifier(numTrees=3, maxDepth=2, seed=1)
    blend = train.EnsembleModel([lr(), forest], "classification", "y", list("abcd"), [3, 1]).fit(frame)
    each = [arrays(blend.trainer.predict(m, frame))[1] for m in blend.models_]
    _, mixed = arrays(blend.predict(frame))
    assert mixed.tolist() == pytest.approx((0.75 * each[0] + 0.25 * each[1]).tolist())
    sure = blend.predict_with_confidence(frame).orderBy("id").collect()
    assert [r.confidence for r in sure] == pytest.approx(np.maximum(mixed, 1 - mixed).tolist())
    stacked = train.EnsembleModel([lr(), forest], "classification", "y", list("abcd"), meta_learner=lr()).fit(frame)
    y, q = arrays(stacked.predict(frame))
    assert ((q >= 0.5) == y).mean() > 0.8


def test_ensemble_weights(frame):
    tuner = tune.EnsembleWeightTunerCV([lr(), RandomForestClassifier(numTrees=3, maxDepth=2, seed=1)], validator("Log Loss"), 20)
    weights, score = tuner.tune(frame)
    each = []
    for e in tuner.estimators:
        tuner.cv.fit(e, frame)
        each.append(arrays(tuner.cv.oof_))
    y = each[0][0]
    loss = lambda w: -np.mean(np.log(np.where(y == 1, (q := w[0] * each[0][1] + w[1] * each[1][1]), 1 - q)))
    assert sum(weights) == pytest.approx(1) and score == pytest.approx(loss(weights), abs=1e-9)
    assert score <= min(loss([1, 0]), loss([0, 1]), loss([0.5, 0.5])) + 1e-12
    assert score <= min(loss([i / 100, 1 - i / 100]) for i in range(101)) + 2e-3


def test_search_learns_from_its_trials():
    space = {"rate": tune.Range.of("float", [1e-4, 1.0], {"log": True}), "depth": tune.Range.of("int", [2, 12, 2]), "kind": tune.Range.of("categorical", "abc"), "fixed": tune.Range.of("constant", 7)}
    loss = lambda s: (np.log10(s["rate"]) + 2) ** 2 + 0.1 * abs(s["depth"] - 8) + (s["kind"] != "b")

    def best(seed, n, startup):
        search = tune.Parzen(space, False, seed)
        search.STARTUP = startup
        for _ in range(n):
            s = search.ask()
            assert 1e-4 <= s["rate"] <= 1 and s["depth"] in (2, 4, 6, 8, 10, 12) and s["kind"] in "abc" and s["fixed"] == 7
            search.tell(s, loss(s))
        return [s for _, s in search.seen], min(-v for v, _ in search.seen)

    assert best(1, 15, 10)[0] == best(1, 15, 10)[0]
    assert np.mean([best(i, 50, 10)[1] for i in range(20)]) < 0.7 * np.mean([best(i, 50, 10**9)[1] for i in range(20)])
    with pytest.raises(ValueError, match="unknown kind"):
        tune.Range.of("list", [1])
    assert tune.Range.of("float", [0.5, 1.5], {"step": 0.25}).value(0.9) == 1.0 and tune.Range.of("float", [1, 100, "log"]).log


def test_random_search(frame):
    search = tune.RandomSearchCV(validator("RMSE", "regression", "z"), 4)
    best, score = search.tune(LinearRegression(solver="normal"), frame, {"regParam": ("float", [1e-3, 10.0], {"log": True}), "fitIntercept": ("constant", True)})
    assert len(search.trials_) == 4 and score == min(s for _, s in search.trials_) and (best, score) in search.trials_


def test_pseudo_labels(frame):
    known, unknown = frame.where("id % 3 <> 0"), frame.where("id % 3 = 0")
    made = tune.PseudoLabelGenerator(validator("Roc AUC"), "fixed", fixed=0.8).fit(lr(), known, unknown)
    scored = made.cv.predict_proba(unknown).collect()
    sure = {r.id: int(r.probability[1] >= 0.5) for r in scored if max(r.probability) >= 0.8}
    out = made.get_augmented_dataset().collect()
    extra = {r.id: r.y for r in out if r.id % 3 == 0}
    assert extra == sure and sum(r.weight == 1 for r in out) >= 200 and all(r.weight >= 0.8 for r in out)


@pytest.mark.parametrize("make", [lambda: GBTRegressor(maxIter=3, maxDepth=2, seed=1), lambda: DecisionTreeRegressor(maxDepth=3)])
def test_contributions_sum_to_the_prediction(frame, make):
    own = train.BaseTrainer("regression", "z", list("abcd"))
    model = own.fit_estimator(make(), frame)
    out = shap.compute_shap_values(model, own.predict(model, frame), list("abcd")).collect()
    assert [sum(r.shap) + r.shap_base[0] for r in out] == pytest.approx([r.prediction for r in out])


def test_contributions_are_shapley_values(frame):
    """Against all coalitions: features outside one are averaged over the tree's own shares of rows."""
    own = train.BaseTrainer("regression", "z", list("abc"))
    model = own.fit_estimator(DecisionTreeRegressor(maxDepth=3), frame)
    rows = shap.compute_shap_values(model, frame.limit(10), list("abc")).collect()
    tree = shap.nodes(model.stages[-1])

    def value(i, x, known):
        n = tree[i]
        if n["feature"] < 0:
            return n["value"]
        if n["feature"] in known:
            return value(n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], x, known)
        left, right = tree[n["left"]]["stats"][0], tree[n["right"]]["stats"][0]
        return (left * value(n["left"], x, known) + right * value(n["right"], x, known)) / (left + right)

    for r in rows:
        x = [r.a, r.b, r.c]
        for f in range(3):
            others = [g for g in range(3) if g != f]
            want = sum(factorial(k) * factorial(2 - k) / 6 * (value(0, x, {*s, f}) - value(0, x, {*s})) for k in range(3) for s in combinations(others, k))
            assert r.shap[f] == pytest.approx(want)


@pytest.mark.parametrize(
    "make",
    [
        lambda cv: select.MutualInformationRecursiveFeatureElimination(lr(), cv, 2), lambda cv: select.ModelImportanceRecursiveFeatureElimination(lr(), cv, 2),
        lambda cv: select.PermutationRecursiveFeatureElimination(lr(), cv, 2, 2), lambda cv: select.ShapRecursiveFeatureElimination(RandomForestClassifier(numTrees=5, maxDepth=3, seed=1), cv, 2),
    ],
)
def test_elimination_keeps_what_informs(frame, make):
    found = make(validator("Roc AUC"))
    chosen = found.run(frame, list("abcd"))
    gone = [h[3] for h in found.history_ if h[3]]
    assert set(gone[:2]) == {"c", "d"} and {"a", "b"} <= set(chosen) and len(found.history_) == 4
    assert [h[2] for h in found.history_][0] == 4 and found.history_[-1][2] == 1


def test_importance_filter_and_weighted_score(frame):
    found = select.ModelImportanceFiltering(RandomForestClassifier(numTrees=5, maxDepth=3, seed=1), validator("Roc AUC"), 0.1)
    assert found.run(frame, list("abcd")) == ["a", "b"]
    history = [(0, 0, 3, None, 0.8, 0.0, None), (1, 1, 2, "c", 0.9, 0.1, 0.0), (2, 2, 1, "b", 0.5, -0.3, 0.1)]
    assert select.select_features_weighted_score(history, ["a", "b", "c"], "maximize") == ["a", "b"]
    assert select.select_features_weighted_score(history, ["a", "b", "c"], "minimize") == ["a"]
    assert select.select_features_weighted_score(history, ["a", "b", "c"], "minimize", protected=["b"]) == ["a", "b"]
    assert select.compute_removal_schedule(10, 3, 1) == [5, 3, 1] and select.compute_removal_schedule(0, 3) == []


def test_permuted_values_are_the_same_values(frame):
    out = select.permuted(frame, "a", "id", 3).orderBy("id").collect()
    was = frame.orderBy("id").collect()
    assert sorted(r.a for r in out) == sorted(r.a for r in was) and [r.a for r in out] != [r.a for r in was]
    assert [(r.id, r.b, r.y) for r in out] == [(r.id, r.b, r.y) for r in was]
    assert frame.agg(F.count("*")).first()[0] == len(out)


def test_permuting_shuffles_a_fold_once(spark):
    rows = spark.range(5000).selectExpr("id", "double(id) AS a", "id % 7 AS b", "CASE WHEN id % 5 > 0 THEN concat('v', id % 3) END AS t", "double(id % 2) AS y")
    places = select.dealt(rows, "id", 3).persist()
    assert sorted(r[0] for r in places.select("_at").collect()) == list(range(5000))
    for feature, joins in (("a", 1), ("b", 0), ("t", 0)):
        was, seen = rows.orderBy("id").collect(), set()
        for turn in range(3):
            frame = select.permuted_feature(places, feature, 5000, turn)
            plan = frame._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Join") == joins and frame.columns == rows.columns  # few values need no other row
            out = frame.orderBy("id").collect()
            assert sorted(map(str, (r[feature] for r in out))) == sorted(map(str, (r[feature] for r in was)))
            assert [r.y for r in out] == [r.y for r in was]
            moved = sum(o[feature] != w[feature] for o, w in zip(out, was, strict=True)) / 5000
            assert moved > {"a": 0.99, "b": 0.8, "t": 0.6}[feature]
            seen.add(str([r[feature] for r in out]))
        assert len(seen) == 3
    assert list(select.permuted(rows, "b", "id", 3).orderBy("id").toPandas().b) == list(select.permuted(rows.repartition(3), "b", "id", 3).orderBy("id").toPandas().b)
    places.unpersist()


def test_information_elimination_brings_no_rows_to_the_driver(frame, monkeypatch):
    got, to_arrow = [], type(frame).toArrow
    monkeypatch.setattr(type(frame), "toArrow", lambda self: got.append((t := to_arrow(self)).num_rows) or t)
    found = select.MutualInformationRecursiveFeatureElimination(lr(), validator("Roc AUC"), 2)
    rows = frame.select("id", "y", (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    found.prepare(rows, ["a", "b"])
    assert set(found.information_) == {"a", "b"} and max(got, default=0) <= 5 < rows.count()


def test_area_scores_each_row_once(spark, frame, monkeypatch):
    from tabloom.functions import stats
    from tabloom.operators import metrics

    scored = spark.sparkContext.accumulator(0)

    def p(x):
        scored.add(1)
        return x % 7 / 7

    rows = frame.select("y", F.udf(p, "double")("id").alias("p"))
    plain = metrics.roc_auc(frame.select("y", (F.col("id") % 7 / 7).alias("p")), "y", "p")
    monkeypatch.setattr(stats, "WINDOW_ROWS", 100)
    assert metrics.roc_auc(rows, "y", "p") == plain and scored.value == frame.count()


def test_kept_rows_are_not_kept_again_by_validation(frame):
    def kept(f):
        return f.sparkSession.sparkContext._jsc.getPersistentRDDs().size()

    rows = frame.where("id >= 0").persist()
    rows.count()
    before, seen = kept(rows), []
    cv = train.CrossValidationTrainer("classification", None, "y", list("ab"), "id", 3, custom_metric={"name": "n", "function": lambda d, y, p: seen.append(kept(d)) or d.count(), "metric_type": "preds", "direction": "maximize"})
    cv.fit(DecisionTreeClassifier(maxDepth=2), rows)
    assert max(seen) <= before and kept(rows) == before
    rows.unpersist()
