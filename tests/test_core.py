import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.functions import special
from sparkloom.functions.coerce import num, safe_corr
from sparkloom.operators import align as al
from sparkloom.operators import correlate, forests, hypothesis, information, metrics, models, preprocess, profile, sampling, windows
from sparkloom.plans import modules, queries
from sparkloom.sinks import reports
from sparkloom.sources import tables
from sparkloom.streaming.profile import streaming_profile


def test_coercion(spark):
    cells = [" 1.5 ", "1e3", "inf", "-Infinity", "nan", "true", "0x10", "1_000", "1,000", "", None, "1d", "1f", "+3", ".5", "5.", "1e400"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cells)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(num(df, "s")).collect()]
    assert got == [1.5, 1000.0, *[None] * 11, 3.0, 0.5, 5.0, None]


def test_safe_corr_of_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 5.0)], "g string, x double, y double")
    got = {r[0]: r[1] for r in df.groupBy("g").agg(safe_corr(F.col("x"), F.col("y"))).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_tail_probabilities():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert special.f_sf(3.0, 2, 20) == pytest.approx(0.07253815028640, abs=1e-10)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.2281388519649, abs=1e-9)
    assert special.binomial_tail(20, 30) == pytest.approx(0.0493685735, abs=1e-9) and special.binomial_tail(19, 30) > 0.05
    assert special.gammaincc(2.5, 1e-3) == pytest.approx(1.0, abs=1e-6) and special.betainc(2, 3, 0.5) == pytest.approx(0.6875)


def test_alignment(spark):
    a, b = spark.createDataFrame([(1.0, 1), (None, 2), (None, 3)], "k double, x int"), spark.createDataFrame([(None, 1), (1.0, 2)], "k double, y int")
    assert al.align(a, b, "k").df.count() == 3
    c = al.align(spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3)], "k int, v int"))
    assert c.df.columns == ["k", "v", "v__label"] and c.strategy.startswith("inner join on common column")
    with pytest.raises(ValueError):
        al.align(spark.range(3).withColumnRenamed("id", "a"), spark.range(4).withColumnRenamed("id", "b"))
    p = al.align(spark.range(3).withColumnRenamed("id", "a"), spark.range(3).withColumnRenamed("id", "b"))
    assert sorted((r.a, r.b) for r in p.df.collect()) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(ValueError, match="available"):
        al.choose_targets(["a"], ["z"])
    with pytest.raises(ValueError):
        al.align(a, b, "x")


def test_sources_and_gate(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Date,x,s\n2024-01-01,1,a\nbad,NA,\n")
    df = tables.read_table(spark, str(tmp_path / "f.csv"))
    assert [(r.Date is None, r.x, r.s) for r in df.collect()] == [(False, "1", "a"), (True, None, None)] or df.count() == 2
    assert tables.read_table(spark, str(tmp_path / "f.csv"), 1).count() == 1
    with pytest.raises(ValueError):
        tables.check_path("x.json")
    with pytest.raises(ValueError):
        tables.positive("0")
    with pytest.raises(SystemExit) as e:
        cli.main(["fit", "a.json", "b.csv"])
    assert e.value.code == 2


def test_exclusions(spark):
    rows = [(str(i), 1.0, "t", float(i) if i < 2 else None, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "numeric_string string, constant double, text string, mostly_missing double, usable double").withColumn("Date", F.current_timestamp())
    got = profile.exclusions(profile.column_stats(df, df.columns))
    assert got == {"numeric_string": None, "constant": "constant_or_too_few_values", "text": "non_numeric", "mostly_missing": "too_many_missing", "usable": None, "Date": "date_column"}


def test_quantile_buckets_as_linear_edges(spark):
    rng = random.Random(3)
    for n, q in ((4, 3), (10, 4), (37, 10), (50, 4)):
        values = [float(rng.randrange(0, 20)) for _ in range(n)] if n != 10 else [float(i) for i in range(10)]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        edges = windows.quantile_edges(df, "x", q)
        expected = np.unique(np.quantile(values, [k / q for k in range(q + 1)]))
        assert np.allclose(edges, expected)
        got = sorted((r[0], r[1]) for r in df.select("x", windows.bucket(F.col("x"), edges)).collect())
        assert got == sorted((v, max(0, int(np.searchsorted(edges, v, "left")) - 1)) for v in values)
    sizes = {}
    for r in spark.range(1, 11).select(windows.rank_bucket(F.col("id"), 10, 4).alias("b")).collect():
        sizes[r.b] = sizes.get(r.b, 0) + 1
    assert [sizes[k] for k in range(4)] == [3, 2, 2, 3]


def test_folds_and_rolling(spark):
    assert windows.folds(260) == [(0, 100, 100, 150), (0, 150, 150, 200), (0, 200, 200, 250)] and windows.folds(120) == []
    with pytest.raises(ValueError):
        windows.folds(100, 0)
    df = spark.createDataFrame(list(enumerate([1.0, 3.0, None, 4.0, 9.0])), "i int, y double")
    got = [r.volatility for r in windows.rolling_abs_change(df, "y", ["i"]).orderBy("i").collect()]
    assert got == [None, 2.0, 2.0, 2.0, 3.5]


def test_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 7, 11)], "x double")
    r = profile.numeric_summary(df, "d", ["x"]).first()
    assert (r.skew, r.kurtosis, r["std"], r.q25) == (pytest.approx(1.284715), pytest.approx(0.570327), pytest.approx(3.881580), 2.0)
    assert profile.duplicate_rows(spark.createDataFrame([(None,), (None,)], "x int")).first()[0] == 1


def test_ranks_over_ranges(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.randrange(15))) for g in "ab" for _ in range(60)]
    got = correlate.average_ranks(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "r").collect()
    for r in got:
        own = [x for g, x in rows if g == r.g]
        assert r.r == sum(x < r.x for x in own) + (sum(x == r.x for x in own) + 1) / 2


def test_hypothesis_dispatch(spark):
    rng = random.Random(5)
    rows = [(i, float(i), rng.gauss(0, 1), "ab"[i % 2], "xyz"[i % 3], float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "__rid long, x double, e double, two string, three string, y double")
    stats = profile.column_stats(df, df.columns)
    got = {(r.feature, r.label): r.test for r in hypothesis.pairwise(df, stats, ["x", "e", "two"], ["y", "two", "three"], ["__rid"]).collect() if r.feature != r.label}
    assert got == {("x", "y"): "pearsonr", ("e", "y"): "pearsonr", ("x", "two"): "welch_ttest", ("e", "two"): "welch_ttest", ("x", "three"): "one_way_anova", ("e", "three"): "one_way_anova", ("two", "three"): "chi2_contingency"}
    assert hypothesis.two_feature(df, profile.column_stats(df, ["x", "e", "y"]), ["x", "e"], ["y"]).count() == 1


def test_md5_choices(spark):
    df = spark.range(100).withColumnRenamed("id", "rid").withColumn("c", (F.col("rid") % 4).cast("string"))
    assert sampling.sample(df, 10, "rid").count() == 10 and sampling.sample(df, 1000, "rid").count() == 100
    assert sampling.split(df, "rid").where("is_test").count() == 20
    by = {r[0]: r[1] for r in sampling.split(df, "rid", classes="c").where("is_test").groupBy("c").count().collect()}
    assert by == dict.fromkeys("0123", 5)
    a = sorted((r.rid, r.perm_c) for r in sampling.permute(df, "c", "rid").collect())
    assert a == sorted((r.rid, r.perm_c) for r in sampling.permute_bounded(df, "c", "rid").collect())
    assert {r[0]: r[1] for r in sampling.resamples(df, "rid", 100, 3).groupBy("resample").count().collect()} == {0: 70, 1: 70, 2: 70}


def test_mutual_information_kernels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=1500)
    y = 0.8 * x + 0.6 * rng.normal(size=1500)
    assert information.mi_continuous(x, y) == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.1)
    assert information.mi_continuous(x, rng.normal(size=1500)) < 0.06
    assert information.mi_discrete(x, np.where(x > 0, "a", "b")) == pytest.approx(math.log(2), abs=0.05)


def test_tree_shap_sums_to_the_prediction():
    tree = [(0, 0.5, 1, 2, 0.0, 10.0), (-1, 0.0, -1, -1, 1.0, 4.0), (1, 0.0, 3, 4, 0.0, 6.0), (-1, 0.0, -1, -1, 2.0, 2.0), (-1, 0.0, -1, -1, 5.0, 4.0)]
    x = np.array([[0.0, 0.0], [1.0, -1.0], [1.0, 1.0]])
    mean = (4 * 1.0 + 2 * 2.0 + 4 * 5.0) / 10
    assert models.tree_shap([(1.0, tree)], x).sum(1) == pytest.approx(np.array([1.0, 2.0, 5.0]) - mean)


def test_boruta_thresholds(spark):
    got = {r[0]: r[1] for r in spark.range(31).select("id", models.decision_column(F.col("id"))).collect()}
    assert all(got[h] == ("rejected" if h <= 10 else "confirmed" if h >= 20 else "tentative") for h in range(31))


def test_agreement_of_identical_clusterings(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(30)], "c int")
    r = metrics.agreement(df, F.col("c"), F.col("c")).first()
    assert r.adjusted_rand == 1.0 and r.normalized_mutual_info == pytest.approx(1.0)


def test_interactions(spark):
    df, made = preprocess.interactions(spark.createDataFrame([(6.0, 3.0), (1.0, 0.0)], "a double, b double"), ["a", "b", "a"])
    assert [m[0] for m in made] == ["a__product__b", "a__difference__b", "a__ratio__b"]
    assert [tuple(r)[2:] for r in df.collect()] == [(18.0, 3.0, 2.0), (0.0, 1.0, None)]


def _signal(spark):
    rng = range(260)
    signal = np.linspace(-2, 2, 260)
    target = 2.5 * signal + 0.2 * np.sin(np.arange(260) / 9) + 0.03 * np.cos(np.arange(260) / 5)
    date = F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 300)
    f = spark.createDataFrame([(i, float(signal[i]), math.sin(i / 9), math.cos(i), 1.0) for i in rng], "i int, signal double, seasonal double, noise double, constant double")
    y = spark.createDataFrame([(i, float(target[i]), "up" if target[i] > np.median(target) else "down") for i in rng], "i int, target double, label_class string")
    return f.withColumn("Date", date).drop("i"), y.withColumn("Date", date).drop("i")


SMALL = modules.Settings(models=models.Options(trees=5, holdout_trees=5, iterations=2, resamples=4, inits=2, explain_rows=20), permutation_trees=5, max_base_features=3, max_pairs=3)


@pytest.mark.parametrize("name", ["information_coefficient", "mutual_information", "mrmr", "stability_selection", "regime_scoring", "feature_interactions", "permutation_importance_ts"])
def test_signal_ranks_first(spark, name):
    f, y = _signal(spark)
    found = modules.compute(name, f, y, targets=["target"], settings=SMALL)["feature_scores"].collect()
    best = [r.feature for r in found if abs(r["score"] if "score" in r.asDict() else r.mean_abs_score) == abs(found[0]["score"] if "score" in found[0].asDict() else found[0].mean_abs_score)]
    assert any("signal" in f for f in best) and all(r.feature != "constant" for r in found)


def test_registry_and_run(spark, tmp_path):
    assert len(modules.list_modules()) == 20
    with pytest.raises(ValueError, match="available"):
        modules.get_module("none")
    f, y = _signal(spark)
    f.write.parquet(f"{tmp_path}/f.parquet")
    y.write.parquet(f"{tmp_path}/y.parquet")
    progress = reports.Progress(show=False)
    for name in ("statistics", "eda", "scipy"):
        out = modules.run(spark, name, f"{tmp_path}/f.parquet", f"{tmp_path}/y.parquet", str(tmp_path / "out"), settings=SMALL, progress=progress)
        summary = json.load(open(out.artifacts["summary"]))
        assert summary["module"] == name and (tmp_path / "out" / name / "report.html").exists()
    assert open(tmp_path / "out" / "statistics" / "feature_label_correlations_heatmap.png", "rb").read(4) == b"\x89PNG"
    assert progress.steps


def test_reports_escape():
    md, page = reports.report("t", {"x": float("nan")}, {"s": (["a|b"], [["<script>|\n"]])})
    assert "<script>" not in page and r"\|" in md and "No rows." in reports.markdown_table(["a"], [])


def test_streaming_profile(spark, tmp_path):
    spark.createDataFrame([(1.0, "2"), (None, "x"), (3.0, None)], "a double, b string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a double, b string").parquet(f"{tmp_path}/in")
    q = streaming_profile(stream, ["a", "b"]).writeStream.outputMode("complete").format("memory").queryName("prof").start()
    q.processAllAvailable()
    got = {r["column"]: (r["rows"], r.missing, r["mean"]) for r in spark.sql("select * from prof").collect()}
    q.stop()
    assert got == {"a": (3, 1, 2.0), "b": (3, 1, 2.0)}


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert {k for k in entry.oracle_sql()} <= set(entry.queries())


def test_regimes_are_of_all_rows(spark):
    """Changes grow with the position, so the high regime is the last third of all rows: there x follows y, before it x opposes y."""
    n = 9000
    rows = [(i, float(i if i % 2 else -i), float(i if i % 2 else -i) * (1 if i >= 6000 else -1)) for i in range(n)]
    df = spark.createDataFrame(rows, "pos long, y double, x double").repartition(7)
    whole = {r.pos: r.volatility for r in windows.rolling_abs_change(df, "y", ["pos"]).collect()}
    assert {r.pos: r.volatility for r in windows.rolling_by_blocks(df, "y", block=64).collect()} == whole
    found = windows.regimes(df, ("label", "y")).groupBy("regime").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).collect()
    assert {r.regime: (r.a, r.b) for r in found} == {"low": (1, 3000), "mid": (3001, 5999), "high": (6000, 8999)}
    scores = windows.regime_scores(df.withColumnRenamed("pos", "t"), ["x"], ["y"], ["t"], ("label", "y")).where("score_name = 'pearson_ic'").collect()
    assert {(r.regime, round(r.score)) for r in scores} == {("low", -1), ("mid", -1), ("high", 1)}


def test_registered_modules_do_the_whole_job():
    settings = queries._SETTINGS
    assert settings == modules.Settings()
    n = settings.models.iterations
    assert {models.decision(h, n) for h in range(n + 1)} == {"confirmed", "rejected", "tentative"}


def test_neighbour_distances_against_all_pairs():
    rng = np.random.default_rng(12)
    for n in (5, 40, 900):
        x, y = rng.normal(size=n), rng.exponential(size=n) ** 3
        d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        np.fill_diagonal(d, np.inf)
        assert (information.kth_distance(x, y, 3) == np.partition(d, 2, axis=1)[:, 2]).all()


def test_selection_against_plain_solvers(spark):
    """Lasso and L1 logistic regression by slow proximal gradients over the same standardised rows."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(240, 5)) * [1, 10, 0.1, 3, 1]
    y = x[:, 0] + 0.05 * x[:, 1] + 0.3 * rng.normal(size=240)
    code = np.digitize(x[:, 0] + 0.3 * rng.normal(size=240), [-0.7, 0.7])
    z = (x - x.mean(0)) / x.std(0)

    def rows(values):
        return spark.createDataFrame([(k, float(v), r.tolist()) for k in (0, 1) for v, r in zip(values, x)], "resample int, y double, x array<double>").repartition(3)

    def plain(value, step, c, steps=4000):
        w = np.zeros(6)
        one = np.column_stack([z, np.ones(len(z))])
        for _ in range(steps):
            w = w - step * c * one.T @ value(one @ w)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step, 0)
        return np.abs(w[:-1])

    lasso = plain(lambda m: m - y, 0.002, 1 / (240 * 0.01) * 1.0)
    assert {k: v.tolist() for k, v in information.select_by_lasso(rows(y), 5).items()} == {k: (lasso > 1e-6).tolist() for k in (0, 1)}
    logistic = np.max([plain(lambda m, i=i: 1 / (1 + np.exp(-m)) - (code == i), 0.02, 0.2) for i in range(3)], axis=0)
    found = information.select_by_logistic(rows(code), 5, 3)
    assert {k: v.tolist() for k, v in found.items()} == {k: (logistic > 1e-6).tolist() for k in (0, 1)}
    assert logistic[0] > 1e-6 and not (logistic > 1e-6).all()


def test_quantiles_and_distinct_counts(spark):
    rng = np.random.default_rng(14)
    data = [(float(v), str(int(v)) if v > 0 else None, bool(v > 1)) for v in np.round(rng.normal(size=300) * 3, 1)] + [(None, "x", None), (float("nan"), "1.50", True), (-0.0, "1.5", False), (0.0, "", False)]
    df = spark.createDataFrame(data, "a double, b string, c boolean")
    values = profile.value_table(df, ["a", "b", "c"])
    a = np.array([v[0] for v in data if v[0] is not None and v[0] == v[0]])
    b = np.array([float(v[1]) for v in data if v[1] not in (None, "x", "")])
    found = {r["column"]: r for r in profile.quantiles(profile.number_table(df, ["a", "b", "c"]), [0, 0.25, 0.5, 0.9, 1]).collect()}
    for name, x in (("a", a), ("b", b)):
        assert [found[name][f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(x, [0, 0.25, 0.5, 0.9, 1]).tolist())
    counts = {r["column"]: (r["distinct"], r["numeric_distinct"]) for r in profile.distinct_counts(values).collect()}
    assert counts["a"] == (len(set(a.tolist())),) * 2 and counts["c"] == (2, 2)
    assert counts["b"] == (len({v[1] for v in data if v[1] is not None}), len(set(b.tolist())))


def test_collinear_least_squares_as_by_pseudo_inverse(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(80, 2)) * [1, 1000] + [5, -300]
    full = np.column_stack([x, 2 * x[:, 0], x[:, 1]])
    y = 3 + x[:, 0] - 0.01 * x[:, 1] + rng.normal(size=80)
    df = spark.createDataFrame([(i, float(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, full))], "rid long, y double, a double, b double, c double, d double")
    scores, found = models.ols(df, ["a", "b", "c", "d"], ["y"], "rid")
    with_one = np.column_stack([np.ones(80), full])
    beta = np.linalg.pinv(with_one) @ y
    residual = y - with_one @ beta
    cov = np.linalg.pinv(with_one.T @ with_one, rcond=1e-10) * (residual @ residual / 77)
    by = {r[1]: r for r in found}
    for k, name in enumerate(["const", "a", "b", "c", "d"]):
        assert by[name][2] == pytest.approx(beta[k], abs=1e-5) and by[name][6] == pytest.approx(math.sqrt(cov[k, k]), abs=1e-4)
    assert scores[0][4] == pytest.approx(1 - (residual @ residual) / ((y - y.mean()) @ (y - y.mean())), abs=1e-6)


def test_next_by_blocks(spark):
    df = spark.range(25).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("v"))
    found = {r.pos: r.n for r in windows.next_by_blocks(df, "v", "n", 10).collect()}
    assert found == {i: (i + 1) * 3 if i < 24 else None for i in range(25)}


def test_exact_mann_whitney_against_all_orders(spark):
    import itertools

    for n1, n2 in ((2, 3), (4, 5), (3, 1)):
        us = [sum(p) - n1 * (n1 + 1) / 2 for p in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            far = max(u, n1 * n2 - u)
            assert special.mann_whitney_two_sided(u, n1, n2) == pytest.approx(min(1, 2 * sum(x >= far for x in us) / len(us)))
    df = spark.createDataFrame([(i, float(v), "a" if i < 4 else "b") for i, v in enumerate([1, 2, 3, 5, 4, 6, 7, 8, 9])], "rid int, x double, y string")
    row = hypothesis.pairwise(df, profile.column_stats(df, ["x", "y"]), ["x"], ["y"], ["rid"]).first()
    assert "mannwhitney_u=1.0, mannwhitney_p=0.031746" in row.note


def test_every_module_has_notes_and_reports_show_them():
    assert list(modules.NOTES) == modules.list_modules()
    md, page = reports.report("t", {"k": 1}, {"s": (["a"], [[1]])}, ["one < two"])
    assert md.startswith("# t\n\n- one < two\n\n## Summary") and "<li>one &lt; two</li>" in page
    assert reports.report("t", {}, {})[0].startswith("# t\n\n## Summary")


def observed(spark):
    """Two classes, in a session that has observed a plan: its summaries of two classes can't be sent to tasks any more."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    return spark.createDataFrame([(i, (i * 37 % 101) / 7.0, (i * 17 % 29) / 3.0, int(i * 37 % 101 > 50)) for i in range(200)], "rid long, a double, b double, y int")


def test_linear_scores_after_an_observation(spark):
    scores, importance = models.linear(observed(spark), ["a", "b"], ["y"], "rid")
    assert scores[0][5] > 0.9 and importance[0][2] > importance[1][2]


def test_boruta_and_permutations_after_an_observation(spark):
    small = models.Options(trees=3, holdout_trees=3, iterations=2)
    scores, found = models.boruta(observed(spark), ["a", "b"], ["y"], "rid", small)
    assert scores[0][5] > 0.9 and [f[2] for f in found] == ["a", "b"]
    assert models.permutation_scores(observed(spark), ["a", "b"], ["y"], ["rid"], 3)


def test_regularized_after_an_observation(spark):
    found = models.regularized(observed(spark), ["a", "b"], ["y"], "rid")
    assert [f[0] for f in found] == ["a", "b"] and found[0][6] == "logistic_l1_cv"


def test_rolling_means_are_those_of_sql_bit_by_bit(spark):
    """Means that are equal but for rounding must have the same order as in SQL."""
    import duckdb

    rng = random.Random(11)
    values = [(i, None if rng.random() < 0.05 else round(rng.expovariate(0.02), 2)) for i in range(3000)]
    con = duckdb.connect()
    con.execute("create table v (pos bigint, value double)")
    con.execute("insert into v select unnest(?), unnest(?)", [[v[0] for v in values], [v[1] for v in values]])
    sql = "select pos, avg(ch) over (order by pos rows between 19 preceding and current row) from (select pos, abs(value - lag(value) over (order by pos)) ch from v)"
    df = spark.createDataFrame(values, "pos long, value double")
    for block in (50_000, 64, 100):
        assert dict(map(tuple, windows.rolling_by_blocks(df, "value", block=block).select("pos", "volatility").collect())) == dict(con.execute(sql).fetchall())


def test_permuted_places_are_those_of_permute(spark):
    df = spark.createDataFrame([(i * 3, float(i)) for i in range(50)], "rid long, f0 double")
    want = dict(map(tuple, sampling.permute_bounded(df, "f0", "rid", 42007).select("rid", "perm_f0").collect()))
    assert [want[i * 3] for i in range(50)] == [float(p) for p in sampling.permuted_places([str(i * 3) for i in range(50)], "f0", 42007)]


def test_forests_of_capped_rows():
    """Trees learn, leave the rows of weight 0 out, and their importances sum to 1."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    bins, weight = forests.binned(x, np.ones(600, bool)), np.where(np.arange(600) < 100, 0.0, 1.0)
    y = (x[:, 2] > 0.2).astype(float)
    found, votes = forests.grow(bins, y, 2, weight, 20, 1)
    assert found.shape == (20, 4) and found.sum(1) == pytest.approx(np.ones(20)) and found.mean(0).argmax() == 2
    assert votes[:100].sum(1) == pytest.approx(np.full(100, 20.0)) and not votes[100:].any()
    assert (votes[:100].argmax(1) == y[:100]).mean() > 0.9
    lied = np.where(weight == 0, 1 - y, y)
    assert (forests.grow(bins, lied, 2, weight, 20, 1)[1] == votes).all()
    found, votes = forests.grow(bins, 3 * x[:, 1], 0, weight, 20, 1)
    assert found.mean(0).argmax() == 1 and np.corrcoef(votes[:100, 0], x[:100, 1])[0, 1] > 0.9


def test_boruta_makes_few_jobs(spark):
    """With the defaults, forests of all iterations are grown by one pass, not by passes for each level of each forest."""
    df = spark.createDataFrame([(i, (i * 37 % 101) / 7.0, (i * 17 % 29) / 3.0, int(i * 37 % 101 > 50)) for i in range(200)], "rid long, a double, b double, y int")
    spark.sparkContext.setJobGroup("boruta", "boruta")
    scores, found = models.boruta(df, ["a", "b"], ["y"], "rid", models.Options(trees=20, holdout_trees=20))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boruta")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 100 and scores[0][5] > 0.9
    assert [(f[2], f[3]) for f in found][0] == ("a", "confirmed")


def test_forests_on_all_rows_keep_where_rows_are():
    """Levels of deep trees cost what their rows do, not walks from the root."""
    assert models.forest("regression", 3, 1).getCacheNodeIds() and models.forest("classification", 3, 1).getCacheNodeIds()


def test_boruta_reads_all_rows(spark, monkeypatch):
    """No sample, however many rows have the label; and trees that are grown a few at a time are as many."""
    monkeypatch.setattr(forests, "AT_ONCE", 30_000)
    df = spark.range(12_000).selectExpr("id rid", "id * 37 % 101 / 7.0D a", "id * 17 % 29 / 3.0D b", "int(id * 37 % 101 > 50) y")
    scores, found = models.boruta(df, ["a", "b"], ["y"], "rid", models.Options(trees=5, holdout_trees=5, iterations=6))
    assert scores[0][3] == 12_000 and scores[0][5] == 1.0
    assert found[0][2:5] == ("a", "confirmed", 6) and found[1][3] != "confirmed"
    x, weight = np.arange(12_000)[:, None] % 97 / 3.0, np.where(np.arange(12_000) % 5 == 0, 0.0, 1.0)
    importances, votes = forests.grow_many(forests.binned(x, weight > 0), (x[:, 0] > 11).astype(float), 2, weight, 5, 1)
    assert importances == pytest.approx([5.0]) and votes[weight == 0].sum(1) == pytest.approx(np.full(2400, 5.0))
