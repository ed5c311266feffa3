"""Golden values and contracts of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import special, stats
from tabloom.operators import clean, convert, drift, encode, expand, impute, metrics, profile, report, sample, select


def column(df, name, by="id"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.fixture(scope="module")
def city(spark):
    rows = [(i, c, y) for i, (c, y) in enumerate([("Warsaw", 1), ("Warsaw", 1), ("Warsaw", 0), ("Krakow", 0), ("Krakow", 1), ("Gdansk", 0)])]
    return spark.createDataFrame(rows, "id long, city string, y int")


def test_count_frequency(spark, city):
    count = expand.CountFrequencyEncoderWithOriginal(["city"]).fit(city)
    assert column(count.transform(city), "city_PREPROCESS_CNT_FREQ") == [3, 3, 3, 2, 2, 1]
    share = expand.CountFrequencyEncoder(["city"], "frequency").fit_transform(city)
    assert column(share, "city") == pytest.approx([0.5] * 3 + [1 / 3] * 2 + [1 / 6])
    other = spark.createDataFrame([(1, "Oslo", 1)], city.schema)
    assert column(count.transform(other), "city_PREPROCESS_CNT_FREQ") == [None]
    with pytest.raises(Exception, match="unseen"):
        expand.CountFrequencyEncoderWithOriginal(["city"], unseen="raise").fit(city).transform(other).collect()
    with pytest.raises(ValueError, match="missing"):
        expand.CountFrequencyEncoder(["city"]).fit(city.withColumn("city", F.nullif("city", F.lit("Gdansk"))))
    with pytest.raises(AttributeError):
        expand.CountFrequencyEncoder(["city"]).transform(city)


def test_mean_and_woe(city):
    m = column(expand.MeanEncoder("y", ["city"]).fit_transform(city), "city")
    assert m == pytest.approx([2 / 3] * 3 + [0.5] * 2 + [0.0])
    m = column(expand.MeanEncoder("y", ["city"], smoothing=3).fit_transform(city), "city")
    assert m[0] == pytest.approx((2 + 3 * 0.5) / 6)
    with pytest.raises(ValueError, match="without one"):
        expand.WoEEncoder("y", ["city"]).fit(city)
    w = column(expand.WoEEncoder("y", ["city"]).fit_transform(city.where("city <> 'Gdansk'")), "city")
    assert w[0] == pytest.approx(np.log((2 / 3) / (1 / 2))) and w[3] == pytest.approx(np.log((1 / 3) / (1 / 2)))


def test_rare_and_similar(spark):
    df = spark.createDataFrame(list(enumerate(["Warsaw"] * 6 + ["Krakow"] * 2 + ["Gdansk", "Poznan"])), "id long, city string")
    assert column(expand.RareLabelEncoder(["city"], 0.15, 2).fit_transform(df), "city")[6:] == ["Krakow", "Krakow", "Rare", "Rare"]
    assert column(expand.RareLabelEncoder(["city"], 0.15, 9).fit_transform(df), "city")[8] == "Gdansk"
    s = expand.StringSimilarityEncoderWithOriginal(["city"]).fit(df)
    out = s.transform(df).orderBy("id").first()
    assert set(s.get_feature_names_out()) == {f"city_{c}" for c in ("Warsaw", "Krakow", "Gdansk", "Poznan")} and out["city_Warsaw"] == 1.0 and 0 < out["city_Krakow"] < 1


def test_bins(spark):
    age = spark.createDataFrame(list(enumerate([5, 20, 30, 50, 200, 0])), "id long, age int")
    d = expand.ArbitraryDiscretiserWithOriginal({"age": [0, 10, 25, 40, 100]}).fit(age)
    assert column(d.transform(age), "age_PREPROCESS_ARB_DISC") == [0, 1, 2, 3, None, 0]
    with pytest.raises(ValueError, match="unique"):
        expand.GeometricWidthDiscretiser(["age"]).fit(age.withColumn("age", F.lit(3)))
    q = column(expand.EqualFrequencyDiscretiser(["id"], 3).fit_transform(age), "age", "age")
    assert len(q) == 6 and sorted(column(expand.EqualFrequencyDiscretiserWithOriginal(["id"], 3).fit_transform(age), "id_PREPROCESS_EQ_FREQ")) == [0, 0, 1, 1, 2, 2]


def test_outliers(spark):
    pay = spark.createDataFrame(list(enumerate([50.0, 52.0, 51.0, 53.0, 200.0, None])), "id long, pay double")
    out = column(expand.OutlierTrimmerWithOriginal(["pay"], "iqr", "right").fit_transform(pay), "pay_PREPROCESS_TRIMMED")
    assert out == [50, 52, 51, 53, None, None]
    assert expand.OutlierTrimmer(["pay"], "iqr").fit_transform(pay).count() == 5
    w = column(expand.Winsorizer(["pay"], "iqr", fold=1.5).fit_transform(pay), "pay")
    assert w[:4] == [50, 52, 51, 53] and w[4] < 200 and w[5] is None


@pytest.mark.parametrize(("kind", "bad"), [("LogTransformer", 0.0), ("BoxCoxTransformer", -1.0), ("ArcsinTransformer", 2.0), ("ReciprocalTransformer", 0.0)])
def test_domains(spark, kind, bad):
    df = spark.createDataFrame([(0.5,), (bad,)], "x double")
    with pytest.raises(ValueError, match="domain"):
        getattr(expand, kind)(["x"]).fit(df)


def test_powers_match_a_search(spark):
    x = np.random.default_rng(17).lognormal(3, 1, 300)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    grid = np.arange(-1, 1, 0.001)
    like = lambda p: -len(x) / 2 * np.log(np.var(np.log(x) if abs(p) < 1e-9 else (x**p - 1) / p)) + (p - 1) * np.log(x).sum()
    assert expand.BoxCoxTransformer(["x"]).fit(df).lambdas_["x"] == pytest.approx(grid[np.argmax([like(p) for p in grid])], abs=2e-3)
    y = column(expand.YeoJohnsonTransformer(["x"]).fit_transform(df.withColumn("x", F.col("x") - 30)), "x", "x")
    assert np.isfinite(y).all()


def test_digits_and_crosses(spark):
    df = spark.createDataFrame([(0, 123.45), (1, 67.89), (2, 10.01)], "id long, num double")
    d = encode.DigitsEncodingFeatureGenerator(["num"], digit_limits=(2, 4)).fit(df)
    assert d.get_feature_names_out() == [f"num_d{k}" for k in (-2, -1, 0, 1)]
    assert column(d.transform(df), "num_d1") == [2, 6, 1] and column(d.transform(df), "num_d0") == [3, 7, 0]
    assert column(d.transform(df.withColumn("num", F.lit(None).cast("double"))), "num_d0") == [-1, -1, -1]
    x = spark.createDataFrame([(0, "a", "x", 1, 10), (1, "b", "y", 2, 20), (2, "a", None, None, 10), (3, "c", "z", 3, 30)], "id long, A string, B string, C long, D long")
    out = encode.CrossFeatureGenerator(["A", "B"]).fit(x)
    assert column(out.transform(x), "A_B") == [1, 2, 0, 3] and column(out.transform(x.withColumn("A", F.lit("q"))), "A_B") == [-1] * 4
    assert column(encode.CrossFeatureGenerator(["C", "D"]).fit_transform(x), "C_D") == [10, 40, 10, 90]


def test_target_encoding(spark, city):
    te = encode.TargetEncodingFeatureGenerator(["city"], "y", smooth=0, folds=0).fit(city)
    assert column(te.transform(city), "TE_MEAN_city") == pytest.approx([2 / 3] * 3 + [0.5] * 2 + [0.0])
    assert column(te.transform(city.withColumn("city", F.lit("Oslo"))), "TE_MEAN_city") == pytest.approx([0.5] * 6)
    oof = encode.TargetEncodingFeatureGenerator(["city"], "y", smooth=0, folds=2, id_col="id").fit_transform(city, fold=(F.col("id") % 2).cast("int"))
    assert column(oof, "TE_MEAN_city") == pytest.approx([1, 0.5, 1, 1, 0, 0.5])
    with pytest.raises(ValueError):
        encode.TargetEncodingFeatureGenerator(["city"], "y", "mode")


def test_pipeline(spark, city):
    p = encode.FeatureGenerationPipeline([encode.CrossFeatureGenerator(["city", "y"]), encode.CountEncoder(["__NEW__"])], final_features=["id", "CE_city_y"])
    assert column(p.fit_transform(city), "CE_city_y") == [2, 2, 1, 1, 1, 1] and column(p.transform(city), "CE_city_y") == [2, 2, 1, 1, 1, 1]
    with pytest.raises(ValueError, match="no fit"):
        encode.FeatureGenerationPipeline([object()])


def test_conversion(spark):
    df = spark.createDataFrame([(0, "ab-cd o'NEIL", 5), (1, None, 300), (2, "straße", None)], "id long, s string, n int")
    for mode, f in (("title", str.title), ("casefold", str.casefold), ("upper", str.upper), ("capitalize", str.capitalize), ("lower", str.lower)):
        assert column(convert.CaseNormalizer(["s"], mode).fit_transform(df), "s") == [f("ab-cd o'NEIL"), None, f("straße") if mode != "upper" else "STRASSE"]
    assert dict(convert.NumericalDowncaster().fit_transform(df).dtypes) == {"id": "tinyint", "s": "string", "n": "float"}
    a = convert.CategoricalAligner(["s"]).fit(df.where("id = 2"))
    assert column(a.transform(df), "s") == ["straße"] * 3
    assert convert.CategoricalAligner.create_fill_values(df, ["s", "n"], {"n": "x"}) == {"s": "ab-cd o'NEIL", "n": "x"}
    with pytest.warns(UserWarning, match="cast"):
        assert convert.DtypesConverter({"s": "int", "n": "string"}).fit_transform(df).dtypes[1:] == [("s", "string"), ("n", "string")]


def test_imputation(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate([("x", "u")] * 30 + [("y", "v")] * 25 + [(None, "u")] * 8 + [(None, "v")] * 5 + [("z", "w")] * 10 + [("q", "w")] * 10)]
    df = spark.createDataFrame(rows, "id long, A string, B string")
    out = column(impute.impute_missing_values(df, ["A"], ["B"]), "A")
    assert out[55:63] == ["x"] * 8 and out[63:68] == ["y"] * 5
    once = impute.StatisticalAssociationImputer(features=["A", "B"], top_n=1).fit(df)
    filled = once.transform(df)
    assert filled.where("A is null").count() == 0 and column(filled, "A") == column(once.transform(filled), "A")


def test_cleaning(spark):
    df = spark.createDataFrame([(i, i % 5, "abcde"[i % 5], 1, i % 5, None if i == 3 else i % 5) for i in range(40)], "id long, a int, b string, c int, d int, e int")
    out, gone = clean.initial_features_removal(df, "id")
    assert gone == {"constant": ["c"], "empty": [], "duplicate": ["d"], "bijective": ["b"]} and out.columns == ["id", "a", "e"]
    assert clean.drop_highly_skewed_categorical_features(df, ["c", "b"], 0.99)[1] == ["c"]


def test_quantiles_by_brackets_are_exact(spark):
    x = np.random.default_rng(0).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0, 0.013, 0.25, 0.5, 0.999, 1]
    want = np.quantile(x, probs).tolist()
    for accuracy in (20, 500):  # several rounds of brackets
        assert stats.quantiles_of(df, {"x": F.col("x")}, probs, exact=50, held=100, accuracy=accuracy)["x"] == pytest.approx(want)
    assert stats.quantiles(df, ["x"], probs)["x"] == pytest.approx(np.quantile(x, probs).tolist())


def test_quantiles_of_few_values_and_of_none(spark):
    pdf = pd.DataFrame({"a": [0.0] * 700 + [1.0] * 300, "b": [2.0] * 1000, "c": [float(i % 7) for i in range(1000)]})
    df, probs = spark.createDataFrame(pdf), [0, 0.1, 0.6999, 0.7, 0.9, 1]
    got = stats.quantiles_of(df, {c: F.col(c) for c in pdf} | {"none": F.lit(None)}, probs, exact=10, held=40, accuracy=50)
    assert got.pop("none") == [None] * 6
    assert got == {c: pytest.approx(np.quantile(pdf[c], probs).tolist()) for c in pdf}


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v), int(n)) for k in "ab" for v, n in zip(rng.permutation(300) * 0.5, rng.integers(1, 9, 300), strict=True)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    want = sorted((k, v, sum(n for j, w, n in rows if j == k and w < v)) for k, v, _ in rows)
    for window_rows in (1000, 40):
        assert sorted(tuple(r) for r in stats.running(df, ["k"], "v", ["n"], 300, window_rows).select("k", "v", "before_n").collect()) == want
    alone = stats.running(df.where("k = 'a'"), [], "v", ["n"], 300, 40).select("k", "v", "before_n")
    assert sorted(tuple(r) for r in alone.collect()) == [w for w in want if w[0] == "a"]


def test_places_over_all_rows(spark):
    keys = [None, "", "a", "é", "\U0001f600"]
    rows = [(k, v, 1 + (v * 7) % 5) for k in keys for v in range(60)]
    df = spark.createDataFrame(rows, "k string, v int, n long").repartition(7)
    order = lambda r: ((r[0] or "").encode(), r[0] is not None, r[1])
    at, want = 0, []
    for r in sorted(rows, key=order):
        want.append((*r, at))
        at += r[2]
    for window_rows in (1000, 40, 2):
        got = [tuple(r) for r in stats.before_all(df, ["k", "v"], 300, "n", window_rows).collect()]
        assert sorted(got, key=order) == want
    few = stats.before_all(df.where("v = 0"), ["k"], 5, window_rows=1)
    assert sorted(r["before"] for r in few.collect()) == [0, 1, 2, 3, 4]
    assert stats.before_all(df.limit(0), ["k", "v"], 300, "n", 40).count() == 0


def test_medians_by_key(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y", None, "z"], 400, p=[0.6, 0.2, 0.15, 0.05]), "v": rng.integers(0, 60, 400) / 4})
    df = spark.createDataFrame(list(zip(pdf["k"], pdf["v"].tolist(), strict=True)), "k string, v double")
    want = {k: (g["v"].median(), len(g)) for k, g in pdf.dropna().groupby("k")}
    for held, window_rows in ((10_000, None), (10, 1000), (10, 20)):
        got = stats.medians(df.where("k is not null"), ["k"], "v", held, window_rows)
        assert {r["k"]: (r["median"], r["n"]) for r in got.collect()} == want


def test_association_and_drift_do_not_cancel_on_large_means(spark):
    rng = np.random.default_rng(5)
    cls = rng.integers(0, 3, 400)
    x = cls + rng.normal(size=400)
    pdf = pd.DataFrame({"id": range(400), "y": cls.astype(str), "x": x, "far": x + 1e9})
    df = spark.createDataFrame(pdf)
    eta = {r.feature: r.eta_squared for r in profile.numerical_target_association(df, ["x", "far"], "y").collect()}
    mean = x.mean()
    between = sum((cls == c).sum() * (x[cls == c].mean() - mean) ** 2 for c in range(3))
    assert eta["x"] == pytest.approx(between / ((x - mean) ** 2).sum()) and eta["far"] == pytest.approx(eta["x"], abs=1e-6)
    w = {r.feature: r.wasserstein for r in drift.numerical_drift_analysis(df.where("y = '0'"), df.where("y = '1'"), ["x", "far"]).collect()}
    assert w["far"] == pytest.approx(w["x"], abs=1e-5)


def test_metric_names():
    for name in ("F1 (Micro)", "Recall (Macro)", "Precision (Weighted)", "Roc AUC (Multi-class)", "RMSPE"):
        assert metrics.get_metric_direction(name) in ("maximize", "minimize")


def test_tails():
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and special.chi2_tail(18.307038, 10) == pytest.approx(0.05, rel=1e-6)
    assert special.chi2_tail(0, 3) == 1 and special.gamma_tail(2, 50) < 1e-19
    assert special.kolmogorov_tail(0.0, 10, 10) == 1 and 0.04 < special.kolmogorov_tail(1.36 / np.sqrt(5000), 10_000, 10_000) < 0.06
    assert special.digamma(1.0) == pytest.approx(-0.5772156649)


def test_metrics_errors_and_selection(spark):
    df = spark.createDataFrame([(0, 0.1, 1.0), (1, 0.9, 2.0), (0, 0.1, 3.0), (1, 0.9, 4.0), (1, 0.9, 5.0)], "y int, p double, points double")
    assert metrics.f_beta_selection_score(spark.createDataFrame([(0, 0.9, 1.0), (1, 0.1, 2.0), (0, 0.9, 3.0), (1, 0.1, 4.0), (0, 0.9, 5.0)], df.schema), "y", "p", "points") == pytest.approx(0.6)
    assert metrics.get_metric_function("Roc AUC")(df, "y", "p") == 1.0
    with pytest.raises(ValueError):
        metrics.get_metric_type("None such")
    with pytest.raises(ValueError, match="zero"):
        metrics.root_mean_squared_percentage_error(df.withColumn("y", F.lit(0)), "y", "p")
    with pytest.raises(ValueError, match="missing"):
        metrics.CustomMetricsHandler.validate_custom_metric_config({"name": "x"})
    with pytest.raises(ValueError, match="cutoffs"):
        report.classification_results(df, df, "y", "y", cutoffs=0.5)
    assert "<td>5</td>" in report.to_html(df.where("points = 5"))
    assert sum(select.compute_removal_schedule(23, 6)) == 23 and select.compute_removal_schedule(0, 3) == []
    with pytest.raises(ValueError):
        sample.FoldwiseSampler("y", "points", "none such")


def test_bands_and_items(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 1, 1, 2, 9, 9, 3, 4, 4])], "id long, x double")
    bands = profile.bin_regression_target(df, "x", 4, "id").groupBy("target_band").count().collect()
    assert sorted(r["count"] for r in bands) == [2, 2, 3, 3]
    assert profile.bin_regression_target(df.limit(1), "x", 4, "id").first()["target_band"].startswith("Q1")
    texts = ["['apple', 'banana', 'apple', ' Orange ']", None, "not a list", "Not Provided", "[1, 'B']"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("u", profile.extract_unique_items(F.col("t")))
    assert column(items, "u") == [["apple", "banana", "orange"], [], [], [], ["1", "b"]]
    with pytest.raises(ValueError):
        profile.describe_time_series_feature(df, "x", "Q")


def test_a_fitted_operator_on_a_stream(spark, tmp_path):
    from tabloom.streaming.apply import stream_table, write_stream

    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id long, k string")
    rows.write.parquet(str(tmp_path / "in"))
    fitted = encode.CountEncoder(["k"]).fit(rows)
    write_stream(stream_table(spark, str(tmp_path / "in"), rows), fitted, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert column(spark.read.parquet(str(tmp_path / "out")), "CE_k") == [5] * 10


def test_mutual_information_counts_every_row(spark):
    import inspect

    from tabloom.functions.neighbours import _reach
    from tabloom.operators.profile import mutual_information_scores
    from tabloom.operators.select import ShapRecursiveFeatureElimination
    from tabloom.plans import catalog

    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(size=(700, 2)), np.stack([np.repeat(np.arange(5.0), 60), rng.random(300)], 1), [[90.0, 90.0]]])
    apart = np.abs(points[:, None] - points[None]).max(-1)
    assert np.array_equal(_reach(points, 3), np.partition(apart, 3, axis=1)[:, 3])
    assert "sample" not in inspect.signature(mutual_information_scores).parameters
    text = inspect.getsource(catalog)
    assert "sample=5000" not in text and "_cv(f), 2, 2000)" not in text
    assert inspect.signature(ShapRecursiveFeatureElimination).parameters["max_samples_shap"].default == 50_000


def test_smote_takes_neighbours_of_the_whole_class(spark):
    x = np.random.default_rng(9).uniform(-1, 1, (10_001, 4))
    rows = [(i, "b", *p) for i, p in enumerate(x.tolist())] + [(20_000 + i, "a", *[0.0] * 4) for i in range(10_040)]
    df = spark.createDataFrame(rows, "id long, y string, " + ", ".join(f"x{i} double" for i in range(4)))
    out = sample.smote(df, "y", "id", k=1).where("id < 0").toPandas()
    assert len(out) == 39 and out.id.is_unique
    x = x / np.array([r[2:] for r in rows]).std(0, ddof=1)
    std = np.array([r[2:] for r in rows]).std(0, ddof=1)
    near = np.concatenate([np.argsort(((x[i : i + 200, None] - x) ** 2).sum(-1), 1)[:, 1] for i in range(0, len(x), 200)])
    step = x[near] - x
    for p in out[[f"x{i}" for i in range(4)]].to_numpy() / std:
        along = np.clip(((p - x) * step).sum(1) / (step**2).sum(1), 0, 1)
        assert np.abs(x + along[:, None] * step - p).max(1).min() < 1e-6


def test_a_streamed_result_does_not_pass_through_the_driver(spark, tmp_path):
    from tabloom.streaming.apply import stream_table, streamed

    rows = spark.createDataFrame([(i, "AbC"[i % 3]) for i in range(90)], "id long, k string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    out = streamed(stream_table(spark, str(tmp_path / "in"), rows, 2), convert.CaseNormalizer(["k"], "lower").fit(rows))
    assert out.schema == rows.schema and out.inputFiles()  # files that executors have written, where a memory sink has none
    assert sorted(map(tuple, out.collect())) == [(i, "abc"[i % 3]) for i in range(90)]


def plain_information(x, y, classes, k=3, seed=1):
    """By noise and all distances."""
    from tabloom.functions.information import psi

    rng = np.random.default_rng(seed)
    noisy = lambda v: v / v.std() + 1e-10 * rng.standard_normal(len(v))
    dx = np.abs((z := noisy(x))[:, None] - z)
    if classes:
        same = y[:, None] == y
        size = same.sum(1)
        kk = np.minimum(k, size - 1)
        r = np.sort(np.where(same, dx, np.inf), 1)[np.arange(len(x)), kk]
        some = size > 1
        m = (dx < r[:, None])[:, some].sum(1)[some]
        return max(0.0, psi(np.array([some.sum()]))[0] + (psi(kk[some]) - psi(size[some]) - psi(m)).mean())
    dy = np.abs((z := noisy(y))[:, None] - z)
    r = np.partition(np.maximum(dx, dy), k, axis=1)[:, k : k + 1]
    return max(0.0, psi(np.array([len(x)]))[0] + psi(np.array([k]))[0] - (psi((dx < r).sum(1)) + psi((dy < r).sum(1))).mean())


@pytest.fixture(scope="module")
def related(spark):
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal(1500), rng.integers(1, 20, 1500)
    rows = pd.DataFrame({"x": x, "y": x + rng.standard_normal(1500), "q": q * 1.0, "price": np.round(q * rng.uniform(9, 21, 1500), 2), "tenths": np.round(x, 1), "many": rng.integers(0, 200, 1500)})
    rows = pd.concat([rows, rows[:400]], ignore_index=True).assign(c=lambda d: (d.price > 150).astype(int))
    return rows, spark.createDataFrame(rows).persist()


@pytest.mark.parametrize(("x", "c"), [("x", "c"), ("q", "c"), ("price", "many"), ("tenths", "many")])
def test_information_on_classes_is_that_of_all_rows(related, x, c):
    from tabloom.functions.information import mixed_information

    rows, df = related
    found = mixed_information(df, x, c)
    assert found == pytest.approx(np.mean([plain_information(rows[x].to_numpy(), rows[c].to_numpy(), True, seed=i) for i in range(8)]), abs=0.02)
    assert mixed_information(df, x, c, window_rows=300, sent=10, slab=7) == pytest.approx(found, abs=1e-9)


@pytest.mark.parametrize(("x", "y"), [("x", "y"), ("q", "price"), ("price", "tenths")])
def test_information_of_two_numbers_is_that_of_all_rows(related, x, y):
    from tabloom.functions.information import pair_information

    rows, df = related
    found = pair_information(df, x, y)
    assert found == pytest.approx(np.mean([plain_information(rows[x].to_numpy(), rows[y].to_numpy(), False, seed=i) for i in range(8)]), abs=0.03)
    assert pair_information(df, x, y, cell_pairs=120, sent=10, slab=40) == pytest.approx(found, abs=1e-9)


def test_information_brings_no_rows_to_the_driver(spark, monkeypatch):
    from tabloom.operators.profile import mutual_information_scores

    got, to_arrow = [], type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: got.append((t := to_arrow(self)).num_rows) or t)
    rows = spark.range(40_000).selectExpr("double(id % 20) AS a", "double(id % 50) AS y", "id % 20 < 10 AS c", "string(null) AS nothing", "string(id % 2) AS s")
    found = mutual_information_scores(rows.drop("y"), ["a", "nothing"], "c")  # a column without values takes no rows from others
    assert found["a"] == pytest.approx(np.log(2), abs=1e-3) and found["nothing"] == 0
    assert mutual_information_scores(rows, ["a", "s"], "y", "regression") == pytest.approx({"a": np.log(10), "s": np.log(2)}, abs=0.01)
    assert max(got, default=0) <= 50


def test_information_of_many_columns_comes_to_the_driver_at_once(related, monkeypatch):
    rows, df = related
    alone = {x: profile.mutual_information_scores(df, [x], "c")[x] for x in ("x", "q", "tenths")}
    calls, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: calls.append(1) or collect(self))
    few = df.select("c", *[F.floor(F.col("x") * 2 + i).cast("double").alias(f"q{i}") for i in range(4)])
    profile.mutual_information_scores(few, [f"q{i}" for i in range(4)], "c")
    assert len(calls) <= 6
    together = profile.mutual_information_scores(df, ["x", "q", "tenths"], "c")
    assert together == pytest.approx(alone, abs=1e-9)


def test_psi_in_a_plan_is_that_of_numpy(spark):
    from tabloom.functions.information import psi, psi_of

    n = [1, 2, 3, 5, 6, 7, 60, 10**6, 36 * 10**6]
    found = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i int, n long").orderBy("i").select(psi_of("n")).collect()]
    assert found == pytest.approx(psi(np.array(n, float)).tolist(), abs=2e-11)  # the error of either series
    assert found[:4] == pytest.approx([sum(1 / i for i in range(1, x)) - 0.57721566490153286 for x in n[:4]], abs=1e-11)
