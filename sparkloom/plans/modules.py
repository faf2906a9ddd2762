"""The twenty analysis modules: each maps two aligned tables to named result relations.

``compute`` returns DataFrames; ``run`` writes them with summary.json, report.md and report.html.
"""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.coerce import dtype_name, rnd
from sparkloom.operators import align as al
from sparkloom.operators import cluster, correlate, hypothesis, information, models, preprocess, profile, windows
from sparkloom.session import cut
from sparkloom.sinks import reports
from sparkloom.sources.tables import read_table

TOP, SHOWN = 50, 25


@dataclasses.dataclass(frozen=True)
class ModuleResult:
    report_dir: str
    artifacts: dict[str, str]


@dataclasses.dataclass(frozen=True)
class Settings:
    """Options of all modules; defaults are the methods' own."""

    models: models.Options = models.Options()
    permutation_trees: int = 100
    max_features: int = information.MRMR
    max_base_features: int = preprocess.PRODUCT_BASES
    max_pairs: int = preprocess.PRODUCT_PAIRS
    n_regimes: int = 3
    digits: int = 6


@dataclasses.dataclass
class Context:
    """Aligned rows with a row number, the columns by role, and their statistics, computed once."""

    spark: SparkSession
    features: DataFrame
    labels: DataFrame
    aligned: al.Aligned
    targets: list[str]
    settings: Settings
    order: list[str]

    def __post_init__(self) -> None:
        df = self.aligned.df if "__rid" in self.aligned.df.columns else al.numbered(self.aligned.df, self.order or None)
        self.df = cut(df)
        self.stats = profile.column_stats(self.df, [*self.aligned.features, *self.targets])

    def of(self, names: list[str]) -> dict[str, profile.ColumnStats]:
        return {c: self.stats[c] for c in names}

    @property
    def numeric(self) -> list[str]:
        return profile.numeric_features(self.of(self.aligned.features))

    @property
    def matrix(self) -> list[str]:
        return profile.matrix_features(self.of(self.aligned.features), self.targets)

    @property
    def numeric_targets(self) -> list[str]:
        return [y for y in self.targets if self.stats[y].numeric]

    @property
    def by_time(self) -> list[str]:
        """Time, where there is one, then the row number."""
        return [*([self.aligned.time] if self.aligned.time else []), "__rid"]

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[rnd(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def statistics(c: Context) -> dict[str, DataFrame]:
    means = None
    for y in c.numeric_targets:
        part = windows.label_quantile_means(c.df, y, c.numeric)
        means = part if means is None else means.unionByName(part)
    spread = None
    for y in c.targets:
        part = profile.label_distribution(c.df, y)
        spread = part if spread is None else spread.unionByName(part)
    out = {
        "feature_profile": profile.feature_profile(c.df, c.aligned.features), "label_profile": profile.feature_profile(c.df, c.targets),
        "feature_label_correlations": correlate.correlations(c.df, c.numeric, c.numeric_targets),
        "target_summary": c.frame([(y, c.stats[y].distinct, c.stats[y].rows - c.stats[y].non_null) for y in c.targets], "label string, unique long, missing long"),
    }
    return out | ({"label_quantile_means": means} if means is not None else {}) | ({"label_distribution": spread} if spread is not None else {})


def eda(c: Context) -> dict[str, DataFrame]:
    """Of both tables on their own: nothing is joined."""
    parts: dict[str, list[DataFrame]] = {}
    for name, df, keep in (("features", c.features, None), ("labels", c.labels, c.targets)):
        df = df.select(*[f"`{x}`" for x in df.columns if keep is None or x in keep])
        stats = profile.column_stats(df, df.columns)
        kinds = {x: profile.inferred_type(df, s) for x, s in stats.items()}
        columns = cut(profile.eda_columns(df, name))
        numeric = [x for x, k in kinds.items() if k == "numeric"]
        parts.setdefault("dataset_overview", []).append(profile.overview(df, name, stats))
        parts.setdefault("columns_profile", []).append(columns)
        parts.setdefault("missingness", []).append(profile.missingness(columns))
        parts.setdefault("numeric_summary", []).append(profile.numeric_summary(df, name, numeric))
        if others := [x for x, k in kinds.items() if k == "categorical"]:
            parts.setdefault("categorical_summary", []).append(profile.categorical_summary(df, name, others))
        parts.setdefault("correlation_matrix", []).append(correlate.correlation_matrix(df, numeric).withColumn("dataset", F.lit(name)))
    out = {}
    for k, dfs in parts.items():
        dfs = [d for d in dfs if d.columns == max((x.columns for x in dfs), key=len)]
        out[k] = dfs[0] if len(dfs) == 1 else dfs[0].unionByName(dfs[1])
    return out


def scipy(c: Context) -> dict[str, DataFrame]:
    return {"pairwise": hypothesis.pairwise(c.df, c.stats, c.aligned.features, c.targets, ["__rid"]), "two_feature": hypothesis.two_feature(c.df, c.stats, c.aligned.features, c.targets)}


def sklearn(c: Context) -> dict[str, DataFrame]:
    scores, importance = models.linear(c.df, c.numeric, c.targets, "__rid", seed=c.settings.models.seed)
    return {"scores": models.scores_frame(c.spark, scores), "importance": c.frame(importance, "label string, feature string, importance double, importance_name string, coefficient double").orderBy("label", F.desc("importance"), "feature")}


def statsmodels(c: Context) -> dict[str, DataFrame]:
    scores, coefficients = models.ols(c.df, profile.numeric_features(c.of(c.aligned.features), 30), c.numeric_targets, "__rid")
    return {
        "scores": c.frame(scores, "label string, model string, samples long, features long, r_squared double, adjusted_r_squared double, f_statistic double, f_p_value double, aic double, bic double, note string").orderBy(F.desc_nulls_last("adjusted_r_squared"), "label"),
        "coefficients": c.frame(coefficients, "label string, feature string, coefficient double, abs_coefficient double, p_value double, t_value double, std_error double, ci_low double, ci_high double, samples long").orderBy("label", F.asc_nulls_last("p_value"), F.desc("abs_coefficient"), "feature"),
    }


def xgboost(c: Context) -> dict[str, DataFrame]:
    scores, importance = models.gradient_boosting(c.df, c.numeric, c.targets, "__rid", c.settings.models)
    return {"scores": models.scores_frame(c.spark, scores), "importance": c.frame(importance, "label string, feature string, importance double, importance_name string").orderBy("label", F.desc("importance"), "feature")}


def shap(c: Context) -> dict[str, DataFrame]:
    scores, found = models.shap_importance(c.df, c.numeric, c.targets, "__rid", c.settings.models)
    return {"scores": models.scores_frame(c.spark, scores), "shap_importance": c.frame(found, "label string, task string, feature string, mean_abs_shap double, explain_rows long").orderBy("label", F.desc("mean_abs_shap"), "feature")}


def boruta(c: Context) -> dict[str, DataFrame]:
    scores, found = models.boruta(c.df, c.numeric, c.targets, "__rid", c.settings.models)
    schema = "label string, task string, feature string, decision string, hits long, iterations long, hit_rate double, mean_importance double, mean_shadow_threshold double, accepted_p_value double, rejected_p_value double"
    place = F.when(F.col("decision") == "confirmed", 0).when(F.col("decision") == "tentative", 1).otherwise(2)
    return {"scores": models.scores_frame(c.spark, scores), "boruta_features": c.frame(found, schema).orderBy("label", place, F.desc("hit_rate"), F.desc("mean_importance"), "feature")}


def _kmeans(c: Context, note: str, sample: int | None = None) -> dict[str, DataFrame]:
    numeric = c.numeric
    labels = profile.categorical_labels(c.of(c.targets))
    assigned = cluster.pairs_by_labels(c.df, numeric, labels or c.targets, "__rid", inits=c.settings.models.inits, seed=c.settings.models.seed)
    top = {y: r for y in labels for r in [profile.top_values(c.df, [y]).first()]}
    found = cut(cluster.results(assigned, sample, note, c.settings.models.seed))
    return {
        "numeric_features": c.frame([(f, dtype_name(c.df, f), c.stats[f].numeric, c.stats[f].numeric_distinct) for f in numeric], "feature string, dtype string, non_null long, unique long"),
        "categorical_labels": c.frame([(y, dtype_name(c.df, y), c.stats[y].non_null, c.stats[y].distinct, top[y]["top_values"]) for y in labels], "label string, dtype string, non_null long, unique long, top_values string"),
        "kmean_results": cluster.ordered(found), "cluster_label_distribution": cluster.distribution(assigned), "skip_reasons": cluster.skip_reasons(found),
    }


def kmean(c: Context) -> dict[str, DataFrame]:
    return _kmeans(c, "")


def kmeans_gpu(c: Context) -> dict[str, DataFrame]:
    """The same clusterings; executors without GPU run them, and the note says so."""
    return _kmeans(c, "backend=spark", cluster.SILHOUETTE_ROWS)


def _bundle(scores: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    return {"fold_scores": scores, "feature_scores": summary, "top_features": summary.limit(TOP)}


def information_coefficient(c: Context) -> dict[str, DataFrame]:
    scores = cut(windows.information_coefficients(c.df, c.matrix, c.numeric_targets, c.by_time))
    return _bundle(scores, windows.score_summary(scores))


_PERMUTED = "fold int, feature string, label string, score_name string, metric string, baseline double, permutation_drop double, correlation_support double, score double, samples long"


def permutation_importance_ts(c: Context) -> dict[str, DataFrame]:
    scores = c.frame(models.permutation_scores(c.df, c.matrix, c.targets, c.by_time, c.settings.permutation_trees, c.settings.models.seed), _PERMUTED)
    return _bundle(scores, windows.score_summary(scores))


def timeseries_importance(c: Context) -> dict[str, DataFrame]:
    """Rank IC and permutation importance, each divided by its best, averaged."""
    ranks = cut(windows.information_coefficients(c.df, c.matrix, c.numeric_targets, c.by_time)).where("score_name = 'rank_ic'")
    permuted = c.frame(models.permutation_scores(c.df, c.matrix, c.targets, c.by_time, c.settings.permutation_trees, c.settings.models.seed), _PERMUTED)
    union = cut(ranks.unionByName(permuted, allowMissingColumns=True))
    combined = windows.combined_scores(windows.score_summary(union))
    return {"component_scores": union, "feature_scores": combined, "top_features": combined.limit(TOP)}


def mutual_information(c: Context) -> dict[str, DataFrame]:
    found = cut(information.mutual_information(c.df, c.matrix, c.targets, "__rid"))
    ordered = found.orderBy(F.desc("score"), F.desc("samples"), "feature", "label")
    return {"feature_scores": ordered, "top_features": ordered.limit(TOP)}


def mrmr(c: Context) -> dict[str, DataFrame]:
    schema = "feature string, label string, score_name string, score double, relevance double, redundancy double, mrmr_score double, samples long"
    relevance = [(r.feature, r.label, r.score, r.samples) for r in information.mutual_information(c.df, c.matrix, c.targets, "__rid").collect()]
    rho = {(r.feature, r.label): r.rho for r in information.redundancy(c.df, c.matrix).collect()} if relevance else {}
    found = c.frame(information.mrmr(relevance, rho, c.settings.max_features), schema)
    return {"feature_scores": found, "top_features": found.limit(TOP)}


def stability_selection(c: Context) -> dict[str, DataFrame]:
    found = c.frame(information.stability_selection(c.df, c.matrix, c.targets, "__rid", c.settings.models.resamples, c.settings.models.seed), "feature string, label string, score_name string, score double, selection_frequency double, samples long, valid_resamples long")
    return {"feature_scores": found, "top_features": found.limit(TOP)}


def regularized_linear(c: Context) -> dict[str, DataFrame]:
    found = c.frame(models.regularized(c.df, c.matrix, c.targets, "__rid", c.settings.models.seed), "feature string, label string, score_name string, score double, coefficient double, abs_coefficient double, model_type string, samples long")
    return {"feature_scores": found, "top_features": found.limit(TOP)}


def lightgbm(c: Context) -> dict[str, DataFrame]:
    found = c.frame(models.split_importance(c.df, c.matrix, c.targets, "__rid", c.settings.models), "feature string, label string, score_name string, score double, importance_type string, backend string, samples long")
    return {"feature_scores": found, "top_features": found.limit(TOP)}


def feature_interactions(c: Context) -> dict[str, DataFrame]:
    wide, made = preprocess.interactions(c.df, c.matrix, c.settings.max_base_features, c.settings.max_pairs)
    table = c.frame(made, "interaction string, left_feature string, right_feature string, operation string")
    names = profile.matrix_features(profile.column_stats(wide, [m[0] for m in made])) if made else []
    found = information.mutual_information(wide, names, c.targets, "__rid").join(F.broadcast(table), F.col("feature") == F.col("interaction"), "left")  # 240 rows at most
    ordered = cut(found).orderBy(F.desc("score"), F.desc("samples"), "feature", "label")
    return {"generated_interactions": table, "feature_scores": ordered, "top_features": ordered.limit(TOP)}


def regime_scoring(c: Context) -> dict[str, DataFrame]:
    source = windows.regime_source(c.matrix, {x: s.numeric for x, s in c.stats.items()}, c.numeric_targets, c.settings.n_regimes)
    scores = cut(windows.regime_scores(c.df, c.matrix, c.numeric_targets, c.by_time, source, c.settings.n_regimes))
    return _bundle(scores, windows.regime_summary(scores))


REGISTRY: dict[str, Callable[[Context], dict[str, DataFrame]]] = {
    f.__name__: f for f in (
        statistics, eda, scipy, sklearn, statsmodels, xgboost, shap, boruta, kmean, kmeans_gpu, information_coefficient, permutation_importance_ts, timeseries_importance,
        mutual_information, mrmr, stability_selection, regularized_linear, lightgbm, feature_interactions, regime_scoring,
    )
}


#: What the reports of a module say of how to read it.
NOTES: dict[str, list[str]] = {
    "statistics": ["Correlations are over rows where both columns have numbers.", "Feature means are by quartiles of a numeric target; labels with up to 20 values are counted."],
    "eda": ["Both tables are profiled on their own, before they are joined.", "Missing correlations count as 0 in the matrix."],
    "scipy": ["The test of a pair follows from its columns: numbers, two groups, several groups, or categories.", "P-values are not corrected for the number of tests."],
    "sklearn": ["80 % of the rows train and 20 % score; medians and scales are those of the training rows.", "Up to 20,000 rows are read."],
    "statsmodels": [models.OLS_NOTE, "Collinear features share their effect.", "Up to 50,000 rows are read."],
    "xgboost": ["Boosted trees of depth 4; importances are gains, which sum to 1.", "Up to 20,000 rows are read."],
    "shap": ["Mean absolute Shapley values of up to 1,000 test rows, averaged over classes.", "Up to 10,000 rows are read."],
    "boruta": ["A feature scores a hit when its importance exceeds that of the best permuted one.", "It is confirmed or rejected when so many hits are unlikely by chance (0.05), else tentative."],
    "kmean": ["Every pair of features is clustered against every label with 2 to 50 values, with as many clusters as values.", "Combinations without a clustering are listed with the reason."],
    "kmeans_gpu": ["Every pair of features is clustered against every label with 2 to 50 values, with as many clusters as values.", f"Silhouettes are of up to {cluster.SILHOUETTE_ROWS:,} test rows."],
    "information_coefficient": ["Folds follow time: each tests rows after those it could train on.", "Both Pearson's and Spearman's coefficients are scored."],
    "permutation_importance_ts": ["Folds follow time.", "The score is the loss of accuracy, or of explained variance, when a feature is shuffled."],
    "timeseries_importance": ["Rank coefficients and permutation importance, each divided by its best, are averaged."],
    "mutual_information": ["By nearest neighbours; missing values of features are medians.", "All rows are read."],
    "mrmr": ["Relevance is mutual information, redundancy the mean absolute rank correlation with the features chosen before."],
    "stability_selection": ["The share of 70 % resamples that select a feature by L1 penalties."],
    "regularized_linear": ["Penalties are chosen by 3 contiguous folds; features are standardised."],
    "lightgbm": ["Importances of a forest's splits; the backend is named in each row."],
    "feature_interactions": ["Products, differences and ratios of pairs of features are scored by mutual information."],
    "regime_scoring": ["Regimes are thirds of a volatility; folds follow time within each."],
}


def list_modules() -> list[str]:
    return list(REGISTRY)


def get_module(name: str) -> Callable[[Context], dict[str, DataFrame]]:
    if name not in REGISTRY:
        raise ValueError(f"unknown module {name!r}; available: {', '.join(REGISTRY)}")
    return REGISTRY[name]


def context(features: DataFrame, labels: DataFrame, key: str | None = None, targets: list[str] | None = None, settings: Settings = Settings(), order: list[str] | None = None) -> Context:
    features, labels = al.explode_arrays(features), al.explode_arrays(labels)
    aligned = al.align(features, labels, key)
    return Context(features.sparkSession, features, labels, aligned, al.choose_targets(profile.not_time(aligned.labels), targets), settings, order or ([aligned.time] if aligned.time else []))


def compute(name: str, features: DataFrame, labels: DataFrame, key: str | None = None, targets: list[str] | None = None, settings: Settings = Settings(), order: list[str] | None = None) -> dict[str, DataFrame]:
    """Named result relations of a module."""
    return get_module(name)(context(features, labels, key, targets, settings, order))


def run(spark: SparkSession, name: str, feature_path: str, label_path: str, output_dir: str, key: str | None = None, targets: list[str] | None = None, limit: int | None = None, settings: Settings = Settings(), progress: reports.Progress | None = None) -> ModuleResult:
    """Compute a module and write its artifacts under output_dir/<module>."""
    module = get_module(name)
    progress = progress or reports.Progress(spark)
    progress.step("read")
    features, labels = read_table(spark, feature_path, limit), read_table(spark, label_path, limit)
    progress.step("align")
    c = context(features, labels, key, targets, settings)
    progress.step(f"compute {name}")
    found = module(c)
    folder = reports.ensure_folder(os.path.join(output_dir, name))
    artifacts, sections, sizes = {}, {}, {}
    for k, df in found.items():
        progress.step(f"write {k}")
        df = cut(df) if k not in ("top_features",) else df
        artifacts[k] = reports.write_csv(df, os.path.join(folder, f"{k}.csv"))
        sections[k] = reports.rows_of(df, SHOWN)
        sizes[k] = df.count()
    for k, (rows, cols, value) in {"feature_label_correlations": ("feature", "label", "pearson_correlation"), "correlation_matrix": ("column_1", "column_2", "correlation")}.items():
        if k in found:
            cells = {(r[rows], r[cols]): r[value] for r in found[k].limit(80 * 80).collect()}
            artifacts[f"{k}_heatmap"] = reports.heat_map(list(dict.fromkeys(y for _, y in cells)), list(dict.fromkeys(x for x, _ in cells)), cells, os.path.join(folder, f"{k}_heatmap.png"))
    summary = {"module": name, "created_at": reports.now(), "feature_path": feature_path, "label_path": label_path, "join_strategy": c.aligned.strategy if name != "eda" else "none", "targets": c.targets, "rows": sizes}
    artifacts["summary"] = reports.write_json(summary, os.path.join(folder, "summary.json"))
    md, page = reports.report(f"{name} report", summary, sections, NOTES.get(name, ()))
    for kind, text in (("md", md), ("html", page)):
        path = os.path.join(folder, f"report.{kind}")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        artifacts[f"report_{kind}"] = path
    return ModuleResult(folder, artifacts)


def head_by_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group, for reports."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


