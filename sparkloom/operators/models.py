"""Holdout models and importances on pyspark.ml; where the methods define a cap, rows are md5 samples."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import special
from sparkloom.functions.coerce import num
from sparkloom.operators import forests, metrics, preprocess, profile, sampling
from sparkloom.operators.align import numbered
from sparkloom.session import cut

#: Rows that a method reads at most, classes, and sizes of ensembles. Ensembles can be made smaller by options.
CAPS = {"sklearn": 20_000, "xgboost": 20_000, "shap": 10_000, "statsmodels": 50_000, "kmean": 50_000, "kmeans_gpu": 50_000}
MAX_CLASSES, LEAST_ROWS, OLS_FEATURES, SEED = 50, 30, 25, 42
# Fixed value: what results of least squares say.
OLS_NOTE = "Numeric labels only; top features selected by absolute Pearson correlation before OLS."
SCORES = "label string, task string, model string, samples long, features long, score_primary double, score_primary_name string, mae double, rmse double, accuracy double, balanced_accuracy double, f1_weighted double, note string"


@dataclasses.dataclass(frozen=True)
class Options:
    trees: int = 200
    holdout_trees: int = 300
    iterations: int = 30
    resamples: int = 30
    inits: int = 10
    seed: int = SEED
    explain_rows: int = 1000


def _round(x) -> float | None:
    return None if x is None or not math.isfinite(x) else round(float(x), 6)


class _Bare:
    """Estimators whose models don't keep their training summary: that of two classes holds the session, and once a session has observed a plan, it can't be sent to tasks."""

    def _create_model(self, java_model):
        java_model.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
        return super()._create_model(java_model)


class BareLogisticRegression(_Bare, LogisticRegression):
    pass


class BareForest(_Bare, RandomForestClassifier):
    pass


@dataclasses.dataclass
class Holdout:
    """An imputed, encoded and assembled sample with its split; or the reason that there is none."""

    task: str
    note: str = ""
    df: DataFrame | None = None
    features: list[str] = dataclasses.field(default_factory=list)
    classes: list[str] = dataclasses.field(default_factory=list)
    rows: int = 0

    @property
    def train(self) -> DataFrame:
        return self.df.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col("is_test"))


def holdout(df: DataFrame, features: list[str], label: str, rid: str, cap: int | None, seed: int = SEED, scaled: bool = False, indicators: bool = False) -> Holdout:
    """Rows with a label, capped if the method has a cap; 80/20 by md5, by class if every class has two rows; medians (and scales) of the training rows."""
    known = sampling.sample(df.where(F.col(f"`{label}`").isNotNull()), cap, rid, seed)
    stats = profile.column_stats(known, [label])[label]
    task = profile.task_by_values(stats)
    if task == "regression":
        known = known.withColumn("__y", num(known, label)).where("__y is not null")
        classes, strata = [], None
    else:
        if not 2 <= stats.distinct <= MAX_CLASSES:
            return Holdout(task, "label_has_too_many_classes" if stats.distinct > MAX_CLASSES else "label_has_less_than_2_classes")
        coded, classes = preprocess.label_codes(known, label)
        known = coded.withColumn("__y", F.col(f"{label}__code").cast("double"))
        least = known.groupBy("__y").count().agg(F.min("count")).first()[0]
        if least < 2:
            return Holdout(task, "class_has_less_than_2_samples")
        strata = label
    known = cut(known.select(F.col(rid).alias("rid"), "__y", F.col(f"`{label}`").cast("string").alias("__class"), *[num(known, c).alias(f"f{i}") for i, c in enumerate(features)]))
    n = known.count()
    if n < LEAST_ROWS:
        return Holdout(task, "not_enough_samples")
    parts = sampling.split(known, "rid", 0.2, seed, "__class" if strata else None)
    names = [f"f{i}" for i in range(len(features))]
    extra = []
    if indicators:
        missing = parts.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in names]).first()
        extra = [c for c in names if missing[c]]
        parts = parts.withColumns({f"{c}m": F.col(c).isNull().cast("double") for c in extra})
    parts = preprocess.impute(parts, names, ~F.col("is_test"))
    if scaled:
        parts = preprocess.standardize(parts, names, ~F.col("is_test"))
    made = VectorAssembler(inputCols=[*names, *[f"{c}m" for c in extra]], outputCol="x").transform(parts)
    return Holdout(task, "", cut(made.select("rid", "__y", "is_test", "x", *names)), list(features), classes, n)


def balanced(df: DataFrame) -> DataFrame:
    """w: weights by which all classes count alike."""
    counts = {r[0]: r[1] for r in df.groupBy("__y").count().collect()}
    total, k = sum(counts.values()), len(counts)
    return df.withColumn("w", sum((F.when(F.col("__y") == y, total / (k * n)).otherwise(0.0) for y, n in counts.items()), F.lit(0.0)))


def score_row(held: Holdout, label: str, model: str, predicted: DataFrame) -> tuple:
    if held.task == "regression":
        r = metrics.regression_metrics(predicted, F.col("__y"), F.col("prediction")).first()
        return (label, held.task, model, held.rows, len(held.features), r.r2, "r2", r.mae, r.rmse, None, None, None, "")
    r = metrics.classification_metrics(predicted, F.col("__y"), F.col("prediction")).first()
    return (label, held.task, model, held.rows, len(held.features), r.balanced_accuracy, "balanced_accuracy", None, None, r.accuracy, r.balanced_accuracy, r.f1_weighted, "")


def skipped(held: Holdout, label: str, model: str, features: int) -> tuple:
    return (label, held.task, model, held.rows, features, None, "r2" if held.task == "regression" else "balanced_accuracy", None, None, None, None, None, held.note)


def scores_frame(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCORES).orderBy(F.desc_nulls_last("score_primary"), F.desc("samples"), "label")


# Linear ---------------------------------------------------------------------------------------


def linear(df: DataFrame, features: list[str], labels: list[str], rid: str, cap: int = CAPS["sklearn"], seed: int = SEED) -> tuple[list[tuple], list[tuple]]:
    """Ridge (alpha 1) or balanced logistic regression on standardised features: score rows and (label, feature, importance, name, coefficient)."""
    scores, importance = [], []
    for y in labels:
        use = [f for f in features if f != y]
        held = holdout(df, use, y, rid, cap, seed, scaled=True)
        name = "ridge" if held.task == "regression" else "logistic_regression"
        if held.df is None:
            scores.append(skipped(held, y, name, len(use)))
            continue
        train = held.train
        if held.task == "regression":
            model = LinearRegression(featuresCol="x", labelCol="__y", regParam=1.0 / max(1, train.count()), elasticNetParam=0.0, standardization=False).fit(train)
            weights = np.asarray(model.coefficients.toArray())
            per = [(abs(w), float(w)) for w in weights]
        else:
            model = BareLogisticRegression(featuresCol="x", labelCol="__y", weightCol="w", family="multinomial" if len(held.classes) > 2 else "binomial", regParam=1e-4, standardization=False, maxIter=50).fit(balanced(train))
            m = model.coefficientMatrix.toArray()
            per = [(float(np.abs(m[:, i]).mean()), float(m[0, i]) if len(m) == 1 else None) for i in range(m.shape[1])]
        scores.append(score_row(held, y, name, model.transform(held.test)))
        label_name = "ridge_abs_coefficient" if held.task == "regression" else "logistic_abs_coefficient"
        importance += [(y, f, _round(a), label_name, _round(c)) for f, (a, c) in zip(use, per, strict=True)]
    return scores, importance


def ols(df: DataFrame, features: list[str], labels: list[str], rid: str, cap: int = CAPS["statsmodels"]) -> tuple[list[tuple], list[tuple]]:
    """Least squares with intercept on the features most correlated with each label, by the Gram matrix of complete rows."""
    from sparkloom.operators.correlate import pair_corr

    sampled = cut(sampling.sample(df, cap, rid))
    scores, coefficients = [], []
    for y in labels:
        near = pair_corr(sampled, [(f, y) for f in features if f != y]).where("samples >= 30 and r is not null").orderBy(F.desc(F.abs("r")), "feature").limit(OLS_FEATURES)
        use = [r.feature for r in near.collect()]
        if not use:
            continue
        rows = sampled.select(num(sampled, y).alias("y"), *[num(sampled, f).alias(f"f{i}") for i, f in enumerate(use)]).na.drop()
        cols = ["y", *[f"f{i}" for i in range(len(use))]]
        means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]).first()
        n, k = means.n, len(use)
        if n < LEAST_ROWS:
            continue
        center = [F.col(c) - F.lit(means[c]) for c in cols]
        gram_row = rows.agg(*[F.sum(center[i] * center[j]).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
        gram = np.array([[gram_row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
        if not _fit_ols(y, use, n, np.array([means[c] for c in cols]), gram, scores, coefficients):
            continue
    return scores, coefficients


def _fit_ols(label: str, use: list[str], n: int, means: np.ndarray, gram: np.ndarray, scores: list, coefficients: list) -> bool:
    """The solution of least norm, as by a pseudo-inverse, so collinear regressors share their effect; degrees of freedom go by the rank."""
    sxx, sxy, syy = gram[1:, 1:], gram[1:, 0], gram[0, 0]
    if syy <= 0:
        return False
    d = np.sqrt(np.diag(sxx)) + 1e-300
    values, vectors = np.linalg.eigh(sxx / np.outer(d, d))  # of columns of one scale: ranks don't depend on units
    real = values > 1e-10 * len(use)
    k = int(real.sum())
    if not k or n < k + 2:
        return False
    inner = (vectors[:, real] / values[real]) @ vectors[:, real].T / np.outer(d, d)
    slopes = inner @ sxy
    inverse = np.block([[np.array([[1 / n + means[1:] @ inner @ means[1:]]]), -(means[1:] @ inner)[None]], [-(inner @ means[1:])[:, None], inner]])
    beta = np.append(means[0] - slopes @ means[1:], slopes)
    free = vectors[:, ~real] / d[:, None]  # directions that change no prediction
    if free.shape[1]:
        basis, _ = np.linalg.qr(np.vstack([-(means[1:] @ free)[None], free]))
        project = np.eye(len(use) + 1) - basis @ basis.T
        beta, inverse = project @ beta, project @ inverse @ project
    rss, dof = max(0.0, syy - slopes @ sxy), n - k - 1
    r2 = 1 - rss / syy
    sigma2 = rss / dof
    f = (r2 / k) / ((1 - r2) / dof) if r2 < 1 else math.inf
    fit = n * math.log(2 * math.pi * rss / n) + n if rss > 0 else -math.inf
    scores.append((label, "OLS", n, len(use), _round(r2), _round(1 - (1 - r2) * (n - 1) / dof), _round(f), _round(special.f_sf(f, k, dof)), _round(fit + 2 * (k + 1)), _round(fit + (k + 1) * math.log(n)), OLS_NOTE))
    quantile = special.t_ppf(0.975, dof)
    errors = np.sqrt(np.maximum(sigma2 * np.diag(inverse), 0))
    for name, b, e in zip(["const", *use], beta, errors, strict=True):
        t = b / e if e > 0 else math.inf
        coefficients.append((label, name, _round(b), _round(abs(b)), _round(special.t_two_sided(t, dof)), _round(t), _round(e), _round(b - quantile * e), _round(b + quantile * e), n))
    return True


def regularized(df: DataFrame, features: list[str], labels: list[str], rid: str, seed: int = SEED) -> list[tuple]:
    """Elastic net, or L1 logistic regression (one class against the rest), by 3 contiguous folds of all rows: (feature, label, score_name, score, coefficient, abs_coefficient, model_type, samples)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    out = []
    filled = preprocess.impute(df, features)
    for y in labels:
        use = [f for f in features if f != y]
        known = filled.where(F.col(f"`{y}`").isNotNull())
        regression = profile.task_by_distinct(profile.column_stats(known, [y])[y]) == "regression"
        if regression:
            known, classes = known.withColumn("__y", num(known, y)), []
        else:
            known, classes = preprocess.label_codes(known, y)
            known = known.withColumn("__y", F.col(f"{y}__code").cast("double"))
        placed = numbered(preprocess.standardize(known.where("__y is not null"), use), [rid])
        n = placed.count()
        if n < LEAST_ROWS or not use or (not regression and len(classes) < 2):
            continue
        folded = placed.select("__y", F.least(F.floor(F.col("__rid") * 3 / n), F.lit(2)).cast("int").alias("fold"), *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(use)])
        data = cut(VectorAssembler(inputCols=[f"f{i}" for i in range(len(use))], outputCol="x").transform(folded).select("__y", "fold", "x"))
        if regression:
            est = LinearRegression(featuresCol="x", labelCol="__y", elasticNetParam=0.5, standardization=False)
            top = data.agg(F.stddev_pop("__y")).first()[0] or 1.0
            grid = ParamGridBuilder().addGrid(est.regParam, [top * 10.0**-e for e in (0.5, 1, 2, 3)]).build()
            judge, kind = RegressionEvaluator(labelCol="__y", metricName="mse"), "elastic_net_cv"
        else:
            one = BareLogisticRegression(featuresCol="x", labelCol="__y", elasticNetParam=1.0, standardization=False, maxIter=50)
            est = one if len(classes) == 2 else OneVsRest(featuresCol="x", labelCol="__y", classifier=one)
            grid = ParamGridBuilder().addGrid(one.regParam, [1 / (c * n) for c in (0.01, 0.1, 1.0, 10.0, 100.0)]).build()
            judge, kind = MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy"), "logistic_l1_cv"
        best = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=3, foldCol="fold", seed=seed, parallelism=4).fit(data).bestModel
        mean = np.mean([m.coefficients.toArray() for m in (best.models if hasattr(best, "models") else [best])], axis=0)
        out += [(f, y, "abs_coefficient", abs(float(b)), float(b), abs(float(b)), kind, n) for f, b in zip(use, mean, strict=True)]
    return sorted(out, key=lambda r: (-r[3], r[0], r[1]))


# Trees ----------------------------------------------------------------------------------------


def boosted(held: Holdout, options: Options):
    """200 trees of depth 4, step 0.05, rows and columns by 0.9. More than two classes: one against the rest."""
    common = dict(featuresCol="x", labelCol="__y", maxIter=options.trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=options.seed)
    if held.task == "regression":
        return GBTRegressor(**common).fit(held.train)
    if len(held.classes) == 2:
        return GBTClassifier(**common).fit(held.train)
    return OneVsRest(featuresCol="x", labelCol="__y", classifier=GBTClassifier(**common)).fit(held.train)


def importances(model, size: int) -> np.ndarray:
    """featureImportances; of one-against-the-rest models their mean. Missing-value indicators come after the features."""
    models = model.models if hasattr(model, "models") else [model]
    return np.mean([m.featureImportances.toArray() for m in models], axis=0)[:size]


def gradient_boosting(df: DataFrame, features: list[str], labels: list[str], rid: str, options: Options, cap: int = CAPS["xgboost"]) -> tuple[list[tuple], list[tuple]]:
    scores, importance = [], []
    for y in labels:
        use = [f for f in features if f != y]
        held = holdout(df, use, y, rid, cap, options.seed, indicators=True)
        if held.df is None:
            scores.append(skipped(held, y, "gbt", len(use)))
            continue
        model = boosted(held, options)
        scores.append(score_row(held, y, "gbt", model.transform(held.test)))
        importance += [(y, f, _round(v), "gain_importance") for f, v in zip(use, importances(model, len(use)), strict=True)]
    return scores, importance


def forest(task: str, trees: int, seed: int, leaf: int = 2, weight: bool = False):
    common = dict(featuresCol="x", labelCol="__y", numTrees=trees, maxDepth=30, minInstancesPerNode=leaf, seed=seed, cacheNodeIds=True)  # else every level walks all trees from their roots
    if weight:
        common["weightCol"] = "w"
    return RandomForestRegressor(**common) if task == "regression" else BareForest(**common)


def split_importance(df: DataFrame, features: list[str], labels: list[str], rid: str, options: Options, cap: int | None = None) -> list[tuple]:
    """Forest importances on all rows: (feature, label, score_name, score, importance_type, backend, samples)."""
    out = []
    for y in labels:
        use = [f for f in features if f != y]
        held = holdout(df, use, y, rid, cap, options.seed)
        if held.df is None:
            continue
        tasks = max(held.df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
        model = forest(held.task, options.trees, options.seed).fit(held.df.repartition(tasks, "rid"))
        out += [(f, y, "gbm_importance", float(v), "split", "spark_random_forest", held.rows) for f, v in zip(use, importances(model, len(use)), strict=True)]
    return sorted(out, key=lambda r: (-r[3], r[0], r[1]))


def boruta(df: DataFrame, features: list[str], labels: list[str], rid: str, options: Options) -> tuple[list[tuple], list[tuple]]:
    """Shadow features, on all rows with a label: each iteration permutes every feature by md5; a hit is an importance above that of the best shadow."""
    scores, found = [], []
    for y in labels:
        use = [f for f in features if f != y]
        held = holdout(df, use, y, rid, None, options.seed)
        if held.df is None:
            scores.append(skipped(held, y, "random_forest", len(use)))
            continue
        v, predicted = _shadowed(held, options)
        scores.append(score_row(held, y, "random_forest", predicted))
        top = v[:, len(use) :].max(1)
        hits, means, best = (v[:, : len(use)] > top[:, None]).sum(0), v[:, : len(use)].mean(0), top.mean()
        for f, h, m in zip(use, hits.tolist(), means, strict=True):
            found.append((y, held.task, f, decision(h, options.iterations), h, options.iterations, _round(h / options.iterations), _round(m), _round(best), _round(special.binomial_tail(h, options.iterations)), _round(1 - special.binomial_tail(h + 1, options.iterations))))
    return scores, found


def _shadowed(held: Holdout, options: Options, together: int = 50) -> tuple[np.ndarray, DataFrame]:
    """Importances of each iteration's features and of their permuted copies, and predictions (__y, prediction) of the test rows by a forest of the others. All rows go to every task, in 24 bytes and two a feature each, and it grows ``together`` trees."""
    import pyarrow as pa

    spark, size = held.df.sparkSession, len(held.features)
    rid = F.col("rid") if dict(held.df.dtypes)["rid"] in ("int", "bigint") else F.col("rid").cast("string")  # as text, numbers are the same
    column = lambda *names: held.df.select(F.col("rid").alias("id"), *names).orderBy("id").toArrow()
    told = column(rid.alias("text"), "__y", "is_test")
    ids, y, test = told["text"].to_numpy(), told["__y"].to_numpy(), told["is_test"].to_numpy()
    classes, every, learned = len(held.classes), np.zeros((len(y), size), np.uint8), np.zeros((len(y), size), np.uint8)
    for i in range(size):  # a feature at a time: what is kept of it are its bins
        x = column(f"f{i}").column(1).to_numpy()[:, None]
        every[:, i], learned[:, i] = forests.binned(x, np.ones(len(y), bool))[:, 0], forests.binned(x, ~test)[:, 0]
    by_class = np.bincount(y[~test].astype(int), minlength=classes) if classes else None
    weight = np.where(test, 0.0, 1.0 if by_class is None else (~test).sum() / np.maximum((by_class > 0).sum() * by_class, 1)[y.astype(int) if classes else 0])
    parts = lambda k, trees: [(k, i, min(together, trees - i)) for i in range(0, trees, together)]
    units = [u for k in range(options.iterations) for u in parts(k, options.trees)] + parts(-1, options.holdout_trees)
    seed, sent = options.seed, spark.sparkContext.broadcast((ids, every, learned, y, weight))

    def work(batches):
        import pandas as pd

        for batch in batches:
            ids, every, learned, y, weight = sent.value
            for unit in batch["id"]:
                k, first, trees = units[unit]
                if k < 0:
                    found, votes = forests.grow_many(learned, y, classes, weight, trees, seed * 1_000_003 + first)
                else:  # a permuted copy has the bins of its feature
                    wide = np.hstack([every, *[every[sampling.permuted_places(ids, f"f{i}", seed * 1000 + k), i][:, None] for i in range(size)]])
                    found, votes = forests.grow_many(wide, y, classes, np.ones(len(y)), trees, (seed + k) * 1_000_003 + first)
                yield pd.DataFrame({"k": [k], "v": [found.tolist()], "votes": [votes[weight == 0].tobytes() if k < 0 else b""]})

    told = spark.range(0, len(units), 1, len(units)).mapInPandas(work, "k int, v array<double>, votes binary").collect()  # sums
    sent.destroy()
    v, votes = np.zeros((options.iterations, 2 * size)), np.zeros((int(test.sum()), classes or 1))
    for r in told:
        if r.k < 0:
            votes += np.frombuffer(r.votes).reshape(votes.shape)
        else:
            v[r.k] += r.v
    whole = v.sum(1, keepdims=True)
    guess = votes.argmax(1).astype(float) if classes else votes[:, 0] / options.holdout_trees
    return v / np.where(whole > 0, whole, 1.0), spark.createDataFrame(pa.table({"__y": y[test], "prediction": guess}))


def decision(hits: int, iterations: int = 30, alpha: float = 0.05) -> str:
    """confirmed or rejected if the binomial tail of that many hits at a half is at most alpha."""
    if special.binomial_tail(hits, iterations) <= alpha:
        return "confirmed"
    return "rejected" if 1 - special.binomial_tail(hits + 1, iterations) <= alpha else "tentative"


def decision_column(hits: Column, iterations: int = 30) -> Column:
    """The same by thresholds, which are computed once."""
    told = [decision(h, iterations) for h in range(iterations + 1)]
    return F.when(hits >= told.index("confirmed"), "confirmed").when(hits < told.index("tentative"), "rejected").otherwise("tentative")


# SHAP -----------------------------------------------------------------------------------------


def tree_nodes(model) -> list[tuple[float, list[tuple]]]:
    """(weight, nodes) of a fitted GBT's trees; node: (feature or -1, threshold, left, right, value, cover), the root first."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list = []

        def visit(node) -> int:
            at = len(nodes)  # noqa: B023
            nodes.append(None)  # noqa: B023
            kind = node.getClass().getSimpleName()
            value, cover = float(node.prediction()), float(node.impurityStats().count())
            if kind == "LeafNode":
                nodes[at] = (-1, 0.0, -1, -1, value, cover)  # noqa: B023
            else:
                s = node.split()
                left, right = visit(node.leftChild()), visit(node.rightChild())
                nodes[at] = (s.featureIndex(), float(s.threshold()), left, right, value, cover)  # noqa: B023
            return at

        visit(tree._call_java("rootNode"))
        out.append((weight, nodes))
    return out


def tree_shap(trees: list[tuple[float, list[tuple]]], x: np.ndarray) -> np.ndarray:
    """Shapley values (path-dependent), exact: a leaf's value times, for each feature on its path, the difference that knowing the feature makes, over all orders.

    For a leaf, features on the path are known (the row follows them or not: 1 or 0) or unknown (share of
    training rows that follow). With depth at most 4 a path has few features, so orders are summed over subsets.
    """
    import itertools

    out = np.zeros(x.shape)
    for weight, nodes in trees:
        paths: list[tuple[float, dict[int, tuple[list, float]]]] = []

        def walk(at: int, path: dict) -> None:
            feature, threshold, left, right, value, cover = nodes[at]  # noqa: B023
            if feature < 0:
                paths.append((value, path))  # noqa: B023
                return
            for child, low in ((left, True), (right, False)):
                tests, share = path.get(feature, ([], 1.0))
                walk(child, {**path, feature: ([*tests, (threshold, low)], share * nodes[child][5] / max(cover, 1e-300))})  # noqa: B023

        walk(0, {})
        for value, path in paths:
            if not path or not value:
                continue
            features = list(path)
            follows = np.stack([np.all([(x[:, f] <= t) == low for t, low in path[f][0]], axis=0) for f in features]).astype(float)
            shares = np.array([path[f][1] for f in features])
            m = len(features)
            for i, f in enumerate(features):
                rest = [j for j in range(m) if j != i]
                total = np.zeros(len(x))
                for size in range(m):
                    factor = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    for chosen in itertools.combinations(rest, size):
                        term = np.ones(len(x))
                        for j in rest:
                            term = term * (follows[j] if j in chosen else shares[j])
                        total += factor * term
                out[:, f] += weight * value * total * (follows[i] - shares[i])
    return out


def shap_importance(df: DataFrame, features: list[str], labels: list[str], rid: str, options: Options, cap: int = CAPS["shap"]) -> tuple[list[tuple], list[tuple]]:
    """Mean |SHAP| of boosted trees over up to 1,000 test rows, averaged over classes: score rows and (label, task, feature, mean_abs_shap, explain_rows)."""
    scores, found = [], []
    for y in labels:
        use = [f for f in features if f != y]
        held = holdout(df, use, y, rid, cap, options.seed)
        if held.df is None:
            scores.append(skipped(held, y, "gbt", len(use)))
            continue
        model = boosted(held, options)
        scores.append(score_row(held, y, "gbt", model.transform(held.test)))
        trees = [tree_nodes(m) for m in (model.models if hasattr(model, "models") else [model])]
        rows = sampling.sample(held.test, options.explain_rows, "rid", options.seed).select("x").repartition(8)

        def explain(batches, trees=trees, size=len(use)):
            import pandas as pd

            for b in batches:
                x = np.array(b["a"].tolist(), float).reshape(-1, size)
                total = np.mean([np.abs(tree_shap(t, x)) for t in trees], axis=0).sum(0)
                yield pd.DataFrame({"s": [total.tolist()], "n": [len(x)]})

        parts = rows.select(vector_to_array("x").alias("a")).mapInPandas(explain, "s array<double>, n long").collect()  # sums of at most 1,000 rows
        n = sum(p.n for p in parts)
        mean = np.sum([p.s for p in parts], axis=0) / max(n, 1)
        found += [(y, held.task, f, _round(v), n) for f, v in zip(use, mean, strict=True)]
    return scores, found


# Permutation ----------------------------------------------------------------------------------


def permutation_scores(df: DataFrame, features: list[str], labels: list[str], order: list[str], trees: int = 100, seed: int = SEED, params: tuple[int, int, int, int] | None = None) -> list[tuple]:
    """Walk-forward permutation importance: (fold, feature, label, score_name, metric, baseline, permutation_drop, correlation_support, score, samples).

    Each fold is a forest on the rows before it; all permuted copies of its test rows are scored by one transform.
    """
    from sparkloom.operators import windows
    from sparkloom.operators.correlate import long_pairs, windowed_ranks

    params = params or windows.WALK
    head = cut(windows.first_in_order(df, order, windows.fold_rows(params)))
    n, out, names = head.count(), [], [f"f{i}" for i in range(len(features))]
    for y in labels:
        use = [i for i, f in enumerate(features) if f != y]
        task = profile.task_by_distinct(profile.column_stats(head, [y])[y])
        base = head.select("pos", F.col(f"`{y}`").cast("string").alias("__class"), num(head, y).alias("__num"), *[num(head, f).alias(c) for f, c in zip(features, names, strict=True)])
        base = base.where("__num is not null" if task == "regression" else "__class is not null")
        if task == "classification":
            base, _ = preprocess.label_codes(base, "__class")
        base = base.withColumn("__y", (F.col("__num") if task == "regression" else F.col("__class__code")).cast("double"))
        base = cut(preprocess.impute(base, names))
        for k, (_, train_end, test_start, test_end) in enumerate(windows.folds(n, *params)):
            train, test = base.where(F.col("pos") < train_end), base.where((F.col("pos") >= test_start) & (F.col("pos") < test_end)).coalesce(1)  # a fold's rows
            if task == "classification":
                test = test.join(F.broadcast(train.select("__y").distinct()), "__y", "left_semi")
            if train.count() < 20 or test.count() < 10 or train.select("__y").distinct().count() < 2:
                continue
            assemble = VectorAssembler(inputCols=[names[i] for i in use], outputCol="x")
            model = forest(task, trees, seed).fit(assemble.transform(train))
            copies = test.withColumn("__f", F.lit(-1))
            for i in use:
                moved = sampling.permute_bounded(test.select("pos", names[i]), names[i], "pos", seed)
                copies = copies.unionByName(test.drop(names[i]).join(moved.select("pos", F.col(f"perm_{names[i]}").alias(names[i])), "pos").withColumn("__f", F.lit(i)))
            judged = model.transform(assemble.transform(copies))
            table = (metrics.classification_metrics if task == "classification" else metrics.regression_metrics)(judged, F.col("__y"), F.col("prediction"), ["__f"])
            told = {r["__f"]: (r["accuracy"] if task == "classification" else r["r2"], r["samples"]) for r in table.collect()}
            support = {}
            if task == "regression":
                pairs = windowed_ranks(windowed_ranks(long_pairs(test, [names[i] for i in use], ["__y"]), ["feature"], "x", "rx"), ["feature"], "y", "ry")
                from sparkloom.functions.coerce import safe_corr

                support = {r[0]: abs(r[1] or 0.0) for r in pairs.groupBy("feature").agg(safe_corr(F.col("rx"), F.col("ry"))).collect()}
            baseline, samples = told[-1]
            for i in use:
                drop = (baseline or 0.0) - (told[i][0] or 0.0)
                s = support.get(names[i], 0.0)
                out.append((k, features[i], y, "permutation_importance", "accuracy" if task == "classification" else "r2", baseline, drop, s, max(drop, 0.0) + s, samples))
    return out
