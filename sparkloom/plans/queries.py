"""The operators over the standard tables, and DuckDB SQL for those that SQL can express.

Doubles are rounded to six digits on both sides, once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.coerce import num, rnd
from sparkloom.operators import align as al
from sparkloom.operators import cluster, correlate, hypothesis, information, metrics, models, preprocess, profile, sampling, windows
from sparkloom.plans import modules
from sparkloom.session import cut, shared_folder
from sparkloom.sinks import reports
from sparkloom.sources.tables import first_rows, parse_time, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

D1_FEATURES = ["quantity", "extendedprice", "discount", "tax", "linenumber"]
D1_ORDER = ["l_orderkey", "linenumber", "extendedprice", "partkey", "suppkey", "quantity", "discount", "tax", "l_shipdate"]
D1_SQL = """d1 as (select l_orderkey, l_linenumber linenumber, l_quantity quantity, l_extendedprice extendedprice, nullif(l_discount, 0) discount, l_tax tax, l_partkey partkey, l_suppkey suppkey,
    l_returnflag returnflag, l_linestatus linestatus, l_shipdate, o_totalprice totalprice, o_orderstatus orderstatus, o_orderpriority orderpriority from lineitem join orders on l_orderkey = o_orderkey)"""
D2_SQL = "d2 as (select d.doc_id, n_chars, lang, source, quality, toxic from documents d join labels l on d.doc_id is not distinct from l.doc_id)"
D3_SQL = """d3 as (select event_id, ts, user_id, value, event_type, hour(ts)::bigint as hour, try_cast(json_extract_string(props, '$.k') as double) k, lead(value) over (order by ts) next_value, row_number() over (order by ts) - 1 pos from events)"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders, joined by the explicit key; discount 0 is missing."""
    f = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("linenumber"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), "l_shipdate",
    )
    y = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderstatus").alias("orderstatus"), F.col("o_orderpriority").alias("orderpriority"))
    return al.join_on(f, y, "l_orderkey")[0]


def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.align(_t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), _t(spark, sf_dir, "labels")).df


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their hour and the number in their props."""
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", "ts", "user_id", "value", "event_type", F.hour("ts").cast("long").alias("hour"), F.when(F.trim(k).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), k.try_cast("double")).alias("k"))


def d3(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    """The first events in time order, where folds bound what is read, with pos and next_value."""
    head = _timed(spark, sf_dir).orderBy("ts").limit(rows + 1)
    w = Window.orderBy("ts")
    made = head.withColumn("next_value", F.lead("value").over(w)).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    return made.where(F.col("pos") < rows)


def d3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with pos and next_value, dealt by range of time."""
    placed = cut(al.numbered(_timed(spark, sf_dir), ["ts"]).withColumnRenamed("__rid", "pos"))
    return windows.next_by_blocks(placed, "value", "next_value")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def R(x: str) -> str:  # noqa: N802
    return f"round({x}, 6)"


# Alignment ------------------------------------------------------------------------------------


@query(f"with {D1_SQL} select l_orderkey, linenumber, partkey, suppkey, quantity, totalprice, orderstatus from d1")
def align_explicit_key(spark, sf):
    return d1(spark, sf).select("l_orderkey", "linenumber", "partkey", "suppkey", "quantity", "totalprice", "orderstatus")


@query(f"with {D2_SQL} select * from d2")
def align_common_column(spark, sf):
    return d2(spark, sf)


@query("""select a.n_name as name, b.n_name as label_name, a.n_regionkey as region from (select *, row_number() over (order by n_nationkey) i from nation) a join (select *, row_number() over (order by n_name) i from nation) b using (i)""")
def align_positional(spark, sf):
    n = _t(spark, sf, "nation")
    f, y = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), n.select(F.col("n_name").alias("label_name"))
    return al.join_by_position(f, y, (["key"], ["label_name"]))[0].select("name", "label_name", "region")


@query("select n.k, n.n_name, r.r_name from (select nullif(n_regionkey, 0) k, n_name from nation) n join (select nullif(r_regionkey, 0) k, r_name from region) r on n.k is not distinct from r.k")
def align_null_keys(spark, sf):
    f = _t(spark, sf, "nation").select(F.nullif("n_regionkey", F.lit(0)).alias("k"), "n_name")
    return al.join_on(f, _t(spark, sf, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("k"), "r_name"), "k")[0]


@query("select a.n_nationkey k, a.n_name v, upper(a.n_name) v__label from nation a")
def align_collision_suffix(spark, sf):
    n = _t(spark, sf, "nation")
    return al.align(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), n.select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("v")), "k").df


@query("select d.doc_id, n_chars, toxic from (select * from documents order by doc_id limit 150) d join (select * from labels order by doc_id limit 150) l on d.doc_id = l.doc_id")
def limit_then_join(spark, sf):
    f, y = first_rows(_t(spark, sf, "documents").select("doc_id", "n_chars"), 150, ["doc_id"]), first_rows(_t(spark, sf, "labels").select("doc_id", "toxic"), 150, ["doc_id"])
    return al.align(f, y).df


_ODD = ["' 1.5 '", "'1e3'", "'inf'", "'1d'", "'0x10'", "'1_000'", "''", "'+3'", "'5.'", "'1e400'", "'nan'"]


@query(f"""with s as (select event_id, case event_id % 12 {' '.join(f'when {i} then {v}' for i, v in enumerate(_ODD))} else json_extract_string(props, '$.k') end s from events)
    select event_id, case when regexp_full_match(trim(s), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') and not isinf(try_cast(trim(s) as double)) then try_cast(trim(s) as double) end x from s""")
def coerce_numeric_strings(spark, sf):
    s = F.get_json_object("props", "$.k")
    for i, v in reversed(list(enumerate(_ODD))):
        s = F.when(F.col("event_id") % 12 == i, F.lit(v.strip("'"))).otherwise(s)
    df = _t(spark, sf, "events").select("event_id", s.alias("s"))
    return df.select("event_id", num(df, "s").alias("x"))


# Statistics -----------------------------------------------------------------------------------


def _profile_sql(source: str, columns: list[str], numeric: list[str]) -> str:
    part = lambda c: (
        f"""select '{c}' as "column", count(*) "rows", count(*) - count({c}) missing, {R(f'(count(*) - count({c})) * 100.0::double / count(*)')} missing_pct, count(distinct {c}) as "unique", """
        + (f"{R(f'avg({c}::double)')} mean, {R(f'stddev_samp({c}::double)')} std, {R(f'min({c}::double)')} min, {R(f'median({c}::double)')} median, {R(f'max({c}::double)')} max" if c in numeric else "null::double mean, null::double std, null::double min, null::double median, null::double max")
        + f" from {source}"
    )
    return " union all ".join(map(part, columns))


@query(f"with {D1_SQL} {_profile_sql('d1', [*D1_FEATURES, 'returnflag', 'linestatus'], D1_FEATURES)}")
def statistics_feature_profile(spark, sf):
    return profile.feature_profile(d1(spark, sf), [*D1_FEATURES, "returnflag", "linestatus"]).drop("dtype")


@query(f"with {D2_SQL} {_profile_sql('d2', ['quality', 'toxic', 'n_chars', 'lang'], ['quality', 'toxic', 'n_chars'])}")
def statistics_label_profile(spark, sf):
    return profile.feature_profile(d2(spark, sf), ["quality", "toxic", "n_chars", "lang"]).drop("dtype")


def _corr_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    one = lambda f, y: f"select '{f}' feature, '{y}' as label, {R(f'corr({f}, {y})')} pearson_correlation, {R(f'abs(corr({f}, {y}))')} abs_correlation, count(*) filter ({f} is not null and {y} is not null) samples from {source}"
    return " union all ".join(one(*p) for p in pairs)


@query(f"with {D1_SQL} {_corr_sql('d1', [(f, y) for f in D1_FEATURES for y in ('totalprice', 'partkey')])}")
def statistics_correlations(spark, sf):
    return correlate.correlations(d1(spark, sf), D1_FEATURES, ["totalprice", "partkey"])


@query(f"with e as (select {', '.join(f'embedding[{i + 1}]::double e{i}' for i in range(64))}, label::double y from embeddings) select feature, 'label' as label, pearson_correlation, abs_correlation, samples from ({_corr_sql('e', [(f'e{i}', 'y') for i in range(64)])})")
def statistics_correlations_wide(spark, sf):
    wide = al.explode_arrays(_t(spark, sf, "embeddings").select(F.col("embedding").alias("e"), "label"))
    found = correlate.correlations(wide, [f"e_{i}" for i in range(64)], ["label"])
    return found.withColumn("feature", F.replace("feature", F.lit("_"), F.lit("")))


@query(f"""with {D1_SQL}, q as (select quantile_cont(totalprice, [0, 0.25, 0.5, 0.75, 1]) e from d1), b as (select least(3, (totalprice > e[2])::int + (totalprice > e[3])::int + (totalprice > e[4])::int) bucket, d1.*, e from d1, q)
    select 'totalprice' as label, bucket, {R('any_value(e[bucket + 1])')} lo, {R('any_value(e[bucket + 2])')} hi, f.feature, {R('avg(f.x)')} mean from b, lateral (values ('quantity', quantity::double), ('extendedprice', extendedprice), ('discount', discount), ('tax', tax), ('linenumber', linenumber::double)) f(feature, x) group by bucket, f.feature""")
def statistics_label_quantile_means(spark, sf):
    return windows.label_quantile_means(d1(spark, sf), "totalprice", D1_FEATURES)


@query(f"with {D1_SQL} select 'orderpriority' as label, orderpriority as value, count(*) as count from d1 group by orderpriority")
def statistics_label_distribution(spark, sf):
    return profile.label_distribution(d1(spark, sf), "orderpriority")


# EDA ------------------------------------------------------------------------------------------


@query(f"""select 'part' dataset, count(*) as "rows", 6::bigint as columns, (select count(*) - (select count(*) from (select distinct p_partkey, p_name, p_brand, p_type, nullif(p_size, 1), p_retailprice from part)) from part) duplicate_rows,
    count(*) filter (p_size = 1) total_missing, {R('count(*) filter (p_size = 1) * 100.0::double / (6 * count(*))')} total_missing_pct, 3::bigint numeric_columns, 3::bigint categorical_columns, 0::bigint datetime_columns from part""")
def eda_overview(spark, sf):
    return profile.overview(_part(spark, sf), "part")


def _part(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").withColumn("p_size", F.nullif("p_size", F.lit(1)))


_PART = "(select p_partkey, p_name, p_brand, p_type, nullif(p_size, 1) p_size, p_retailprice from part)"


def _eda_columns_sql() -> str:
    one = lambda c, n: f"""select 'part' dataset, '{c}' as "column", '{'numeric' if n else 'categorical'}' inferred_type, count(*) as "rows", count({c}) non_null, count(*) - count({c}) missing, {R(f'(count(*) - count({c})) * 100.0::double / count(*)')} missing_pct, count(distinct {c}) as "unique", {R(f'count(distinct {c}) * 100.0::double / count(*)')} unique_pct, {f'count(*) filter ({c} = 0)' if n else 'null::bigint'} zero_count, {f'count(*) filter ({c} < 0)' if n else 'null::bigint'} negative_count from {_PART}"""
    return " union all ".join(one(c, c in ("p_partkey", "p_size", "p_retailprice")) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


@query(_eda_columns_sql())
def eda_columns(spark, sf):
    return profile.eda_columns(_part(spark, sf), "part").drop("dtype")


@query(f"select dataset, \"column\", missing, missing_pct, non_null, \"rows\" from ({_eda_columns_sql()})")
def eda_missingness(spark, sf):
    return profile.missingness(profile.eda_columns(_part(spark, sf), "part"))


def _summary_sql(source: str, columns: list[str]) -> str:
    one = lambda c: f"""select 'd1' dataset, '{c}' as "column", count({c}) as count, {', '.join(f'{R(e)} {n}' for e, n in ((f'avg({c}::double)', 'mean'), (f'stddev_samp({c}::double)', 'std'), (f'min({c}::double)', 'min'), (f'quantile_cont({c}::double, 0.25)', 'q25'), (f'quantile_cont({c}::double, 0.5)', 'median'), (f'quantile_cont({c}::double, 0.75)', 'q75'), (f'max({c}::double)', 'max'), (f'skewness({c}::double)', 'skew'), (f'kurtosis({c}::double)', 'kurtosis')))} from {source}"""
    return " union all ".join(map(one, columns))


@query(f"with {D1_SQL} {_summary_sql('d1', D1_FEATURES)}")
def eda_numeric_summary(spark, sf):
    return profile.numeric_summary(d1(spark, sf), "d1", D1_FEATURES)


@query("""with l as (select 'p_brand' as "column", p_brand as value from part union all select 'p_type', p_type from part), c as (select "column", value, count(*) n from l group by 1, 2),
    k as (select *, row_number() over (partition by "column" order by n desc, value) place from c)
    select 'part' dataset, "column", (select count(*) from c where c."column" = k."column") as "unique", string_agg(value || '=' || n, '; ' order by place) top_values from k where place <= 10 group by "column" """)
def eda_categorical_top(spark, sf):
    return profile.categorical_summary(_t(spark, sf, "part"), "part", ["p_brand", "p_type"])


@query(f"with {D1_SQL} " + " union all ".join(f"select '{a}' column_1, '{b}' column_2, coalesce({R(f'corr({a}, {b})')}, 0) correlation from d1" for a in D1_FEATURES for b in D1_FEATURES))
def eda_corr_matrix(spark, sf):
    return correlate.correlation_matrix(d1(spark, sf), D1_FEATURES)


@query("select count(*) - (select count(*) from (select distinct o_orderstatus, o_orderpriority, o_custkey from orders)) duplicate_rows from orders")
def eda_duplicate_rows(spark, sf):
    return profile.duplicate_rows(_t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


@query(f"""with {D1_SQL} select c as "column", g.reason from (values ('quantity', null), ('returnflag', 'non_numeric'), ('discount', null), ('Date', 'date_column'), ('one', 'constant_or_too_few_values'), ('rare', 'too_many_missing')) g(c, reason)""")
def feature_exclusions(spark, sf):
    df = d1(spark, sf).withColumn("Date", F.col("l_shipdate")).withColumn("one", F.lit(1)).withColumn("rare", F.when(F.col("quantity") <= 5, F.col("tax")))
    found = profile.exclusions(profile.column_stats(df, ["quantity", "returnflag", "discount", "Date", "one", "rare"]))
    return spark.createDataFrame(list(found.items()), "column string, reason string")


@query(f"""with {D1_SQL} {' union all '.join(f"select '{c}' as \"column\", count(*) as \"rows\", count({c}) non_null, count(distinct {c}) as distinct_values from d1" for c in ('quantity', 'discount', 'returnflag', 'orderpriority'))}""")
def column_statistics(spark, sf):
    s = profile.column_stats(d1(spark, sf), ["quantity", "discount", "returnflag", "orderpriority"])
    return spark.createDataFrame([(c, x.rows, x.non_null, x.distinct) for c, x in s.items()], "column string, rows long, non_null long, distinct_values long")


# Tests ----------------------------------------------------------------------------------------


@query(f"with {D1_SQL} select feature, label, pearson_correlation statistic, samples from ({_corr_sql('d1', [(f, 'totalprice') for f in D1_FEATURES])})")
def scipy_pearson(spark, sf):
    found = correlate.pair_corr(d1(spark, sf), [(f, "totalprice") for f in D1_FEATURES])
    return found.select("feature", "label", rnd(F.col("r")).alias("statistic"), "samples")


_LONG = "l as (select f.feature, f.x, totalprice y from d1, lateral (values ('quantity', quantity::double), ('discount', discount), ('tax', tax)) f(feature, x) where f.x is not null)"
_RANK = lambda c, part: f"rank() over (partition by {part} order by {c}) + (count(*) over (partition by {part}, {c}) - 1) / 2.0"


@query(f"with {D1_SQL}, {_LONG}, r as (select feature, {_RANK('x', 'feature')} rx, {_RANK('y', 'feature')} ry from l) select feature, 'totalprice' as label, {R('corr(rx, ry)')} statistic, count(*) samples from r group by feature")
def scipy_spearman(spark, sf):
    found = correlate.spearman(correlate.long_pairs(d1(spark, sf), ["quantity", "discount", "tax"], ["totalprice"]), ["feature", "label"])
    return found.select("feature", "label", rnd(F.col("rho")).alias("statistic"), "samples")


_M = "m as (select f.feature, linestatus as class, count(f.x) n, avg(f.x) m, var_samp(f.x) v from d1, lateral (values ('quantity', quantity::double), ('discount', discount), ('tax', tax)) f(feature, x) where f.x is not null group by 1, 2)"
_W = f"with {D1_SQL}, {_M}, w as (select a.feature, a.n n1, b.n n2, a.m m1, b.m m2, a.v v1, b.v v2 from m a join m b on a.feature = b.feature and a.class < b.class)"


@query(f"{_W} select feature, {R('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} t, {R('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))')} dof, n1 + n2 samples from w")
def scipy_welch(spark, sf):
    found = hypothesis.two_groups(hypothesis.group_moments(d1(spark, sf), ["quantity", "discount", "tax"], "linestatus"))
    return found.select("feature", rnd(F.col("t")).alias("t"), rnd(F.col("dof")).alias("dof"), "samples")


@query(f"{_W} select feature, {R('abs(m1 - m2) / sqrt((v1 + v2) / 2)')} cohens_d from w")
def scipy_cohens_d(spark, sf):
    found = hypothesis.two_groups(hypothesis.group_moments(d1(spark, sf), ["quantity", "discount", "tax"], "linestatus"))
    return found.select("feature", rnd(F.col("cohens_d")).alias("cohens_d"))


_S = lambda label: f"with {D1_SQL}, l as (select f.feature, {label} as class, f.x from d1, lateral (values ('quantity', quantity::double), ('discount', discount), ('tax', tax)) f(feature, x) where f.x is not null), r as (select *, {_RANK('x', 'feature')} rk from l), t as (select feature, sum(n) total, sum(n::double * n * n - n) ties from (select feature, x, count(*) n from l group by 1, 2) group by 1), s as (select feature, class, count(*)::double n, sum(rk) rs from r group by 1, 2)"


@query(f"""{_S('linestatus')}, u as (select a.feature, a.rs - a.n * (a.n + 1) / 2 u, a.n n1, b.n n2 from s a join s b on a.feature = b.feature and a.class < b.class)
    select feature, {R('u')} u, {R('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((total + 1) - ties / (total::double * (total - 1))))')} z, total::double samples from u join t using (feature)""")
def scipy_mannwhitney_u(spark, sf):
    found = hypothesis.mann_whitney(hypothesis.rank_sums(d1(spark, sf), ["quantity", "discount", "tax"], "linestatus"))
    return found.select("feature", rnd(F.col("u")).alias("u"), rnd(F.col("z")).alias("z"), F.col("samples").cast("double").alias("samples"))


@query(f"{_S('orderpriority')} select feature, {R('(12 / (total::double * (total + 1)) * sum(rs * rs / n) - 3 * (total + 1)) / (1 - any_value(ties) / (total::double * total * total - total))')} h, count(*) as groups from s join t using (feature) group by feature, total")
def scipy_kruskal(spark, sf):
    found = hypothesis.kruskal(hypothesis.rank_sums(d1(spark, sf), ["quantity", "discount", "tax"], "orderpriority"))
    return found.select("feature", rnd(F.col("h")).alias("h"), "groups")


@query(f"""with {D1_SQL}, {_M.replace('linestatus', 'orderpriority')}, g as (select feature, sum(n * m) / sum(n) gm, sum(n) total, count(*) k from m group by 1)
    select feature, {R('(sum(n * pow(m - gm, 2)) / (any_value(k) - 1)) / (sum((n - 1) * v) / (any_value(total) - any_value(k)))')} f, any_value(k) as groups, any_value(total)::bigint samples from m join g using (feature) group by feature""")
def scipy_anova(spark, sf):
    found = hypothesis.anova(hypothesis.group_moments(d1(spark, sf), ["quantity", "discount", "tax"], "orderpriority"))
    return found.select("feature", rnd(F.col("f")).alias("f"), "groups", "samples")


def _chi_sql(a: str, b: str) -> str:
    return f"""select '{a}' feature, '{b}' as label, chi2, dof, cramers_v, samples from (with c as (select {a} a, {b} b, count(*) n from d1 group by 1, 2), ra as (select a, sum(n) n from c group by 1), cb as (select b, sum(n) n from c group by 1), s as (select (select count(*) from ra) r, (select count(*) from cb) k, (select sum(n) from c)::double t),
      e as (select abs(coalesce(c.n, 0) - ra.n * cb.n / t) g, ra.n * cb.n / t e, r, k, t from ra cross join cb cross join s left join c on c.a = ra.a and c.b = cb.b),
      x as (select sum(pow(case when r = 2 and k = 2 then greatest(g - least(g, 0.5), 0) else g end, 2) / e) v, any_value(r) r, any_value(k) k, any_value(t) t from e)
      select {R('v')} chi2, (r - 1) * (k - 1) dof, {R('sqrt(v / (t * (least(r, k) - 1)))')} cramers_v, t::bigint samples from x)"""


_CHI = [("returnflag", "orderpriority"), ("linestatus", "orderstatus"), ("linestatus", "half")]


@query(f"with {D1_SQL.replace('o_orderpriority orderpriority', chr(39) + 'x' + chr(39) + ' || (o_orderkey % 2) half, o_orderpriority orderpriority')} {' union all '.join(_chi_sql(*p) for p in _CHI)}")
def scipy_chi2_yates(spark, sf):
    df = d1(spark, sf).withColumn("half", F.concat(F.lit("x"), (F.col("l_orderkey") % 2).cast("string")))
    found = hypothesis.chi_square(hypothesis.contingency(df, _CHI))
    return found.select("feature", "label", rnd(F.col("chi2")).alias("chi2"), "dof", rnd(F.col("cramers_v")).alias("cramers_v"), "samples")


@query(f"""with {D1_SQL}, m as (select count(*) n, var_samp(quantity) pp, var_samp(tax) qq, covar_samp(quantity, tax) pq, covar_samp(quantity, totalprice) pz, covar_samp(tax, totalprice) qz, var_samp(totalprice) zz from d1),
    r as (select n, ((qq * pz - pq * qz) / (pp * qq - pq * pq) * pz + (pp * qz - pq * pz) / (pp * qq - pq * pq) * qz) / zz r2 from m)
    select 'quantity' feature_1, 'tax' feature_2, 'totalprice' as label, {R('r2')} r_squared, {R('1 - (1 - r2) * (n - 1) / (n - 3)')} adjusted_r_squared, {R('(r2 / 2) / ((1 - r2) / (n - 3))')} f_statistic, n samples from r""")
def scipy_two_feature_ols(spark, sf):
    found = hypothesis.two_regressors(d1(spark, sf), "quantity", "tax", ["totalprice"])
    return found.select("feature_1", "feature_2", "label", *[rnd(F.col(c)).alias(c) for c in ("r_squared", "adjusted_r_squared", "f_statistic")], "samples")


_NUMBERS = ["quantity", "discount", "tax"]


@query(f"""with {D1_SQL}, m2 as ({_M[len('m as ('):-1]}), w as (select a.feature, a.n n1, b.n n2, a.m m1, b.m m2, a.v v1, b.v v2 from m2 a join m2 b on a.feature = b.feature and a.class < b.class),
    m5 as ({_M[len('m as ('):-1].replace('linestatus', 'orderpriority')}), g as (select feature, sum(n * m) / sum(n) gm, sum(n) total, count(*) k from m5 group by 1)
    select feature, label, 'pearsonr' test, pearson_correlation statistic, abs_correlation effect_size, samples from ({_corr_sql('d1', [(f, 'totalprice') for f in _NUMBERS])})
    union all select feature, 'linestatus', 'welch_ttest', {R('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')}, {R('abs(m1 - m2) / sqrt((v1 + v2) / 2)')}, n1 + n2 from w
    union all select feature, 'orderpriority', 'one_way_anova', {R('(sum(n * pow(m - gm, 2)) / (any_value(k) - 1)) / (sum((n - 1) * v) / (any_value(total) - any_value(k)))')}, null, any_value(total)::bigint from m5 join g using (feature) group by feature
    union all select feature, label, 'chi2_contingency', chi2, cramers_v, samples from ({' union all '.join(_chi_sql('returnflag', y) for y in ('linestatus', 'orderpriority'))})""")
def scipy_pairwise_statistics(spark, sf):
    """Every pair gets the test that its columns' values call for; without the p-values, which SQL has no functions for."""
    df, labels = d1(spark, sf), ["totalprice", "linestatus", "orderpriority"]
    found = hypothesis.pairwise(df, profile.column_stats(df, [*_NUMBERS, "returnflag", *labels]), [*_NUMBERS, "returnflag"], labels)
    return found.select("feature", "label", "test", "statistic", "effect_size", "samples")


@query("""select note, count(*) as count from (select 'label_has_too_many_classes' note from documents having count(distinct doc_id) > 50 union all select 'label_has_less_than_2_classes' from documents having count(*) >= 20 union all select 'not_enough_samples' from documents having count(*) filter (doc_id <= 9) < 20
    union all select 'not_enough_distinct_points_for_clusters' from documents having count(distinct lang) > 1) group by note""")
def kmean_skip_reasons(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "lang", F.lit(1).alias("one"), F.when(F.col("doc_id") <= 9, F.col("lang")).alias("few"), F.col("doc_id").cast("string").alias("many"), F.lit(2.0).alias("a"), F.lit(3.0).alias("b"))
    assigned = cluster.pairs_by_labels(docs, ["a", "b"], ["lang", "one", "few", "many"], "doc_id", inits=1)
    return cluster.skip_reasons(cluster.results(assigned))


@query()
def scipy_pairwise_tests(spark, sf):
    df = d1(spark, sf).withColumn("__rid", F.xxhash64(*D1_ORDER))
    features, labels = [*D1_FEATURES, "returnflag", "linestatus"], ["totalprice", "orderstatus", "orderpriority", "linestatus"]
    return hypothesis.pairwise(df, profile.column_stats(df, [*features, *labels]), features, labels, ["__rid"])


# Linear models --------------------------------------------------------------------------------


@query(f"with {D1_SQL}, c as ({_corr_sql('d1', [(f, 'totalprice') for f in D1_FEATURES])}) select feature, label, abs_correlation, row_number() over (order by abs_correlation desc, feature) place from c where samples >= 30 order by place limit 3")
def ols_topk_selection(spark, sf):
    found = correlate.correlations(d1(spark, sf), D1_FEATURES, ["totalprice"]).where("samples >= 30")
    ranked = found.select("feature", "label", "abs_correlation")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("abs_correlation"), "feature"))).where("place <= 3")


@query(f"with {D1_SQL} select {R('regr_slope(totalprice, extendedprice)')} slope, {R('regr_intercept(totalprice, extendedprice)')} intercept, {R('regr_r2(totalprice, extendedprice)')} r_squared, count(*) samples from d1")
def ols_univariate(spark, sf):
    df = d1(spark, sf).withColumn("rid", F.concat_ws("|", *D1_ORDER))
    scores, coefficients = models.ols(df, ["extendedprice"], ["totalprice"], "rid", cap=2**31 - 1)
    by = {c[1]: c for c in coefficients}
    return spark.createDataFrame([(by["extendedprice"][2], by["const"][2], scores[0][4], scores[0][2])], "slope double, intercept double, r_squared double, samples long")


def _d1_small(spark, sf) -> DataFrame:
    return d1(spark, sf).withColumn("rid", F.md5(F.concat_ws("|", *D1_ORDER)))


@query()
def ols_multi(spark, sf):
    return spark.createDataFrame(models.ols(_d1_small(spark, sf), D1_FEATURES, ["totalprice"], "rid")[1], "label string, feature string, coefficient double, abs_coefficient double, p_value double, t_value double, std_error double, ci_low double, ci_high double, samples long")


# Time -----------------------------------------------------------------------------------------


@query("select i::int fold, 0 train_start, (100 + 50 * i)::int train_end, (100 + 50 * i)::int test_start, (150 + 50 * i)::int test_end from range(20) t(i) where 150 + 50 * i <= (select count(*) from events)")
def walk_forward_splits(spark, sf):
    n = _t(spark, sf, "events").count()
    return spark.createDataFrame([(i, *f) for i, f in enumerate(windows.folds(n))], "fold int, train_start int, train_end int, test_start int, test_end int")


_IC_LONG = "select pos, f.feature, f.x, y.label, y.y from {src}, lateral (values ('user_id', user_id::double), ('hour', hour::double), ('k', k)) f(feature, x), lateral (values ('value', value), ('next_value', next_value)) y(label, y) where f.x is not null and y.y is not null"


def _ic_sql(src: str, group: str, least: int) -> str:
    keys = f"{group}, feature, label"
    return f"""p as ({src}), r as (select {keys}, x, y, {_RANK('x', keys)} rx, {_RANK('y', keys)} ry from p),
      c as (select {keys}, count(*) samples, corr(x, y) pearson_ic, corr(rx, ry) rank_ic from r group by all having count(*) >= {least} and min(x) < max(x) and min(y) < max(y)),
      ic as (select {keys}, 'pearson_ic' score_name, pearson_ic score, samples from c union all select {keys}, 'rank_ic', rank_ic, samples from c)"""


_FOLDS = f"select (pos - 100) // 50 as fold, feature, x, label, y from ({_IC_LONG.format(src='d3')}) where pos >= 100 and pos < 1100 and 150 + 50 * ((pos - 100) // 50) <= (select count(*) from d3)"


def _ic(spark, sf) -> DataFrame:
    return windows.information_coefficients(d3(spark, sf, windows.fold_rows()), ["user_id", "hour", "k"], ["value", "next_value"], ["ts"])


@query(f"with {D3_SQL}, {_ic_sql(_FOLDS, 'fold', 20)} select fold::int fold, feature, label, score_name, {R('score')} score, samples from ic")
def ic_fold_scores(spark, sf):
    return _ic(spark, sf).withColumn("score", rnd(F.col("score")))


_SUMMARY = f"select feature, label, score_name, {R('avg(score)')} mean_score, {R('avg(abs(score))')} mean_abs_score, {R('coalesce(stddev_samp(score), 0)')} score_std, count(*) valid_folds, {R('avg((round(score, 6) > 0)::int)')} positive_fold_ratio, sum(samples)::bigint samples from ic group by feature, label, score_name"


@query(f"with {D3_SQL}, {_ic_sql(_FOLDS, 'fold', 20)} {_SUMMARY}")
def ic_summary(spark, sf):
    return windows.score_summary(_ic(spark, sf))


@query(f"""with {D3_SQL}, {_ic_sql(_FOLDS, 'fold', 20)}, s as ({_SUMMARY}), z as (select *, mean_abs_score / max(mean_abs_score) over (partition by label, score_name) part from s)
    select feature, label, {R('avg(part)')} combined_score, {R('avg(mean_abs_score)')} mean_abs_score, count(distinct score_name) component_count, sum(valid_folds)::bigint valid_folds, sum(samples)::bigint samples from z group by feature, label""")
def combined_scores(spark, sf):
    return windows.combined_scores(windows.score_summary(_ic(spark, sf)))


@query(f"""with {D3_SQL}, c as (select pos, abs(value - lag(value) over (order by ts)) ch, ts from d3) select pos, {R('avg(ch) over (order by ts rows between 19 preceding and current row)')} volatility from c""")
def rolling_abs_diff(spark, sf):
    return windows.rolling_by_blocks(d3_all(spark, sf), "value").select("pos", rnd(F.col("volatility")).alias("volatility"))


_REGIME = """v as (select *, avg(ch) over (order by pos rows between 19 preceding and current row) vol from (select *, abs(value - lag(value) over (order by pos)) ch from d3)),
    q as (select *, row_number() over (order by vol, pos) rk, count(*) over () n from v where vol is not null),
    g as (select *, case when rk <= 1 + (n - 1) / 3.0 then 'low' when rk <= 1 + (n - 1) * 2 / 3.0 then 'mid' else 'high' end regime from q)"""


@query(f"with {D3_SQL}, {_REGIME} select pos, regime from g")
def regime_assignment(spark, sf):
    return windows.regimes(d3_all(spark, sf), ("label", "value")).select("pos", "regime")


_REGIME_FOLDS = f"""select regime, (pos - 50) // 25 as fold, feature, x, label, y from ({_IC_LONG.format(src='w').replace('select pos', 'select regime, size, pos')}) where pos >= 50 and pos < 550 and 75 + 25 * ((pos - 50) // 25) <= size"""


@query(f"""with {D3_SQL}, {_REGIME}, w as (select * exclude (pos), row_number() over (partition by regime order by pos) - 1 pos, count(*) over (partition by regime) size from g), {_ic_sql(_REGIME_FOLDS, 'regime, fold', 10)}
    select s.*, regime_count, 'all' regime from ({_SUMMARY}) s join (select feature, label, score_name, count(distinct regime) regime_count from ic group by all) using (feature, label, score_name)""")
def regime_ic_summary(spark, sf):
    scores = windows.regime_scores(d3_all(spark, sf), ["user_id", "hour", "k"], ["value", "next_value"], ["ts"], ("label", "value"))
    return windows.regime_summary(scores)


# Bins and purity ------------------------------------------------------------------------------


@query("""with r as (select doc_id, row_number() over (order by n_chars, doc_id) rk, count(*) over () n from documents where n_chars is not null)
    select doc_id, least(9, greatest(0, ceil((rk - 1) * 10.0 / (n - 1))::int - 1))::smallint bin from r""")
def quantile_bins(spark, sf):
    df = windows.quantile_bins(_t(spark, sf, "documents").select("doc_id", "n_chars"), ["n_chars"], ["doc_id"])
    return df.select("doc_id", F.col("b_n_chars").alias("bin"))


_BINS = """b as (select d2.*, least(9, greatest(0, ceil((row_number() over (order by n_chars, doc_id) - 1) * 10.0 / (count(*) over () - 1))::int - 1)) bin, least(9, greatest(0, ceil((row_number() over (order by length(source), doc_id) - 1) * 10.0 / (count(*) over () - 1))::int - 1)) bin2 from d2)"""
_PURITY = f"""c as (select f.feature, y.label, f.bin, y.class, count(*) n from b, lateral (values ('n_chars', bin)) f(feature, bin), lateral (values ('lang', lang), ('toxic', toxic::varchar)) y(label, class) group by all),
    h as (select feature, label, bin, max(n) top, sum(n) held from c group by all), p as (select feature, label, max(n) / sum(n) prior from (select feature, label, class, sum(n) n from c group by all) group by all)"""


@query(f"with {D2_SQL}, {_BINS}, {_PURITY} select h.feature, h.label, sum(held)::bigint samples, {R('greatest(sum(top) / sum(held) - any_value(prior), 0)')} score from h join p using (feature, label) group by all")
def purity_1d(spark, sf):
    df = windows.quantile_bins(d2(spark, sf), ["n_chars"], ["doc_id"])
    return windows.purity(df, {"n_chars": "b_n_chars"}, ["lang", "toxic"])


@query("""with s as (select source feature, avg(n_chars) score from documents group by 1), a as (select *, row_number() over (order by score desc, feature) by_score from s), o as (select *, row_number() over (order by case when by_score <= 4 then lpad(by_score::varchar, 8, '0') else 'x' || md5('42|' || feature) end, feature) place from a)
    select feature, place from o where place <= 8""")
def candidate_features(spark, sf):
    s = _t(spark, sf, "documents").groupBy(F.col("source").alias("feature")).agg(F.avg("n_chars").alias("score"))
    return windows.candidate_features(s, 4, 8)


# Reproducible choices -------------------------------------------------------------------------


@query("select doc_id, n_chars from documents order by md5('42|' || doc_id), doc_id limit 200")
def sample_rows(spark, sf):
    return sampling.sample(_t(spark, sf, "documents").select("doc_id", "n_chars"), 200, "doc_id")


@query("select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) <= ceil(0.2 * count(*) over ()) is_test from documents")
def train_test_split(spark, sf):
    return sampling.split(_t(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "is_test")


@query("select doc_id, lang, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) <= ceil(0.2 * count(*) over (partition by lang)) is_test from documents")
def stratified_split(spark, sf):
    return sampling.split(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", classes="lang").select("doc_id", "lang", "is_test")


@query("select a.doc_id, b.n_chars perm_n_chars from (select doc_id, row_number() over (order by doc_id) i from documents) a join (select n_chars, row_number() over (order by md5('42|n_chars|' || doc_id), doc_id) i from documents) b using (i)")
def permuted_column(spark, sf):
    return sampling.permute(_t(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "perm_n_chars")


@query("select resample::int resample, doc_id from (select r.i resample, doc_id, row_number() over (partition by r.i order by md5('42|' || r.i || '|' || doc_id), doc_id) k, count(*) over (partition by r.i) n from labels, range(5) r(i)) where k <= greatest(20, floor(0.7 * n))")
def resamples(spark, sf):
    y = _t(spark, sf, "labels").select("doc_id")
    return sampling.resamples(y, "doc_id", y.count(), 5)


# Preprocessing --------------------------------------------------------------------------------


@query(f"with {D1_SQL} select l_orderkey, linenumber, partkey, suppkey, coalesce(discount, (select median(discount) from d1)) discount from d1")
def median_impute(spark, sf):
    return preprocess.impute(d1(spark, sf), ["discount"]).select("l_orderkey", "linenumber", "partkey", "suppkey", "discount")


@query(f"with {D1_SQL}, m as (select avg(quantity) a, stddev_pop(quantity) s from d1) select l_orderkey, linenumber, partkey, suppkey, {R('(quantity - a) / s')} quantity from d1, m")
def standardize(spark, sf):
    df = preprocess.standardize(d1(spark, sf), ["quantity"])
    return df.select("l_orderkey", "linenumber", "partkey", "suppkey", rnd(F.col("quantity")).alias("quantity"))


@query("select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int code from orders")
def label_encode(spark, sf):
    return preprocess.label_codes(_t(spark, sf, "orders"), "o_orderpriority")[0].select("o_orderkey", F.col("o_orderpriority__code").alias("code"))


@query(f"with {D1_SQL} select l_orderkey, linenumber, partkey, suppkey, {R('quantity * tax')} p, {R('quantity - tax')} d, {R('case when abs(tax) > 1e-12 then quantity / tax end')} q from d1")
def interactions(spark, sf):
    df, _ = preprocess.interactions(d1(spark, sf), ["quantity", "tax"])
    return df.select("l_orderkey", "linenumber", "partkey", "suppkey", *[rnd(F.col(f"quantity__{op}__tax")).alias(n) for op, n in (("product", "p"), ("difference", "d"), ("ratio", "q"))])


# Metrics --------------------------------------------------------------------------------------


def _clustered(spark, sf) -> DataFrame:
    """Embeddings by the signs of their first two components."""
    sign = lambda k: (F.get("embedding", F.lit(k)) > 0).cast("int")
    return _t(spark, sf, "embeddings").select("vec_id", "label", (sign(0) * 2 + sign(1)).alias("cluster"))


_CL = "cl as (select vec_id, label, ((embedding[1] > 0)::int * 2 + (embedding[2] > 0)::int) as cluster from embeddings)"


@query(f"with {_CL} select cluster, label::varchar label_value, count(*) as count, {R('count(*) * 100.0::double / sum(count(*)) over (partition by cluster)')} cluster_pct from cl group by cluster, label")
def cluster_label_distribution(spark, sf):
    return metrics.cluster_labels(_clustered(spark, sf), F.col("cluster"), F.col("label"))


@query(f"""with {_CL}, n as (select cluster c, label l, count(*)::double n from cl group by 1, 2), a as (select c, sum(n) n from n group by 1), b as (select l, sum(n) n from n group by 1),
    s as (select (select sum(n * (n - 1) / 2) from n) p, (select sum(n * (n - 1) / 2) from a) pa, (select sum(n * (n - 1) / 2) from b) pb, (select sum(n * ln(n)) from n) g, (select sum(n * ln(n)) from a) ga, (select sum(n * ln(n)) from b) gb, (select sum(n) from n) t),
    h as (select *, ln(t) - ga / t hc, ln(t) - gb / t hl, ln(t) + (g - ga - gb) / t mi, pa * pb / (t * (t - 1) / 2) e from s)
    select {R('(p - e) / ((pa + pb) / 2 - e)')} adjusted_rand, {R('2 * mi / (hc + hl)')} normalized_mutual_info, {R('mi / hl')} homogeneity, {R('mi / hc')} completeness, {R('2 * (mi / hl) * (mi / hc) / (mi / hl + mi / hc)')} v_measure, t::bigint samples from h""")
def ari_nmi_from_contingency(spark, sf):
    return metrics.agreement(_clustered(spark, sf), F.col("cluster"), F.col("label"))


@query(f"""with {D2_SQL}, p as (select toxic a, (n_chars > 1500)::int p from d2), k as (select a c, count(*) na, count(*) filter (a = p) hit from p group by 1), g as (select p c, count(*) np from p group by 1)
    select {R('sum(hit) / sum(na)')} accuracy, {R('avg(hit / na)')} balanced_accuracy, {R('sum(na * 2 * hit / (na + coalesce(np, 0))) / sum(na)')} f1_weighted, sum(na)::bigint samples from k left join g using (c)""")
def classification_metrics(spark, sf):
    return metrics.classification_metrics(d2(spark, sf), F.col("toxic"), (F.col("n_chars") > 1500).cast("int"))


@query(f"with {D1_SQL}, p as (select totalprice a, extendedprice * 4 p from d1) select {R('1 - sum(pow(a - p, 2)) / (var_pop(a) * count(a))')} r2, {R('avg(abs(a - p))')} mae, {R('sqrt(avg(pow(a - p, 2)))')} rmse, count(*) samples from p")
def regression_metrics(spark, sf):
    return metrics.regression_metrics(d1(spark, sf), F.col("totalprice"), F.col("extendedprice") * 4)


@query(f"""with s as (select vec_id, label, embedding[1]::double a, embedding[2]::double b from embeddings order by md5('42|' || vec_id), vec_id limit 300), d as (select x.vec_id id, x.label own, y.label other, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) d from s x, s y),
    g as (select id, own, other, sum(d) d, count(*) n from d group by all), m as (select id, max(case when own = other and n > 1 then d / (n - 1) end) i, min(case when own <> other then d / n end) o from g group by id)
    select {R('avg(case when i is null then 0 else (o - i) / greatest(o, i) end)')} silhouette from m""")
def silhouette_sample(spark, sf):
    s = sampling.sample(_t(spark, sf, "embeddings"), 300, "vec_id").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    return metrics.silhouette(s, "vec_id", ["a", "b"], "label")


@query("select i::bigint hits, case when i >= 20 then 'confirmed' when i <= 10 then 'rejected' else 'tentative' end decision from range(31) t(i)")
def boruta_decision_table(spark, sf):
    return spark.range(31).select(F.col("id").alias("hits"), models.decision_column(F.col("id")).alias("decision"))


@query(f"""with {D1_SQL}, l as (select a.feature f, b.feature g, a.x, b.x y from d1, lateral (values ('quantity', quantity::double), ('discount', discount), ('tax', tax)) a(feature, x), lateral (values ('quantity', quantity::double), ('discount', discount), ('tax', tax)) b(feature, x) where a.feature < b.feature and a.x is not null and b.x is not null),
    r as (select f, g, {_RANK('x', 'f, g')} rx, {_RANK('y', 'f, g')} ry from l) select f feature, g as label, {R('corr(rx, ry)')} rho from r group by f, g""")
def mrmr_redundancy(spark, sf):
    found = information.redundancy(d1(spark, sf), ["quantity", "discount", "tax"])
    return found.select("feature", "label", rnd(F.col("rho")).alias("rho"))


# Unions and joins of results ------------------------------------------------------------------


@query("""select o_orderstatus status, c.v as label, n from (select o_orderstatus, 'F' v, count(*) n from orders where o_orderstatus = 'F' group by 1 union all select o_orderstatus, null, count(*) from orders where o_orderstatus <> 'F' group by 1) c""")
def union_with_missing_columns(spark, sf):
    o = _t(spark, sf, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit("F"))
    b = o.where("o_orderstatus <> 'F'").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"with {D1_SQL} select returnflag, orderpriority, n, place from (select returnflag, orderpriority, count(*) n, row_number() over (partition by returnflag order by count(*) desc, orderpriority) place from d1 group by 1, 2) where place <= 2")
def head_by_group(spark, sf):
    counts = d1(spark, sf).groupBy("returnflag", "orderpriority").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("returnflag").orderBy(F.desc("n"), "orderpriority")
    return modules.head_by_group(counts, "returnflag", [F.desc("n"), "orderpriority"], 2).withColumn("place", F.row_number().over(w))


# Sources and sinks ----------------------------------------------------------------------------


def _written(df: DataFrame, kind: str) -> str:
    """The path of a table that Spark's writers put into the shared folder; its files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}.{kind}"
    (df.write.option("header", True).csv(path) if kind == "csv" else df.write.parquet(path))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@query("select s_suppkey, s_name, case when s_suppkey % 3 <> 0 then s_acctbal end balance, case when s_suppkey % 4 <> 0 then s_name end shown, make_timestamp(2020, 1 + (s_suppkey % 12), 5, 6, 7, 8) as \"Date\" from supplier where s_suppkey % 5 <> 0 union all select s_suppkey, s_name, case when s_suppkey % 3 <> 0 then s_acctbal end, case when s_suppkey % 4 <> 0 then s_name end, null from supplier where s_suppkey % 5 = 0")
def csv_scan(spark, sf):
    """Written as CSV and read again: types are inferred, words for missing are missing, Date is a time."""
    s = _t(spark, sf, "supplier")
    k = F.col("s_suppkey")
    date = F.when(k % 5 != 0, F.concat(F.lit("2020-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-05 06:07:08"))).otherwise("no date")
    text = F.when(k % 4 != 0, F.col("s_name")).otherwise(F.when(k % 8 == 0, "N/A").otherwise("null"))
    path = _written(s.select("s_suppkey", "s_name", F.when(k % 3 != 0, F.col("s_acctbal")).alias("balance"), text.alias("shown"), date.alias("Date")), "csv")
    return read_table(spark, path).withColumn("s_suppkey", F.col("s_suppkey").cast(s.schema["s_suppkey"].dataType))


@query("select event_id, case when event_id % 7 = 0 then null when event_id % 7 = 1 then date_trunc('day', ts) else ts end as \"Date\" from events")
def parse_dates(spark, sf):
    e, k = _t(spark, sf, "events"), F.col("event_id") % 7
    text = F.when(k == 0, "soon").when(k == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return parse_time(e.select("event_id", text.alias("Date")))


@query("select a.event_id, a.user_id, b.event_id other, b.value from (select * from events where event_id % 2 = 0) a join (select * from events where event_id % 3 = 0) b on a.ts = b.ts")
def align_by_date(spark, sf):
    """Both tables have a Date, and a column in common that doesn't count then."""
    e = _t(spark, sf, "events").withColumnRenamed("ts", "Date")
    found = al.align(e.where("event_id % 2 = 0").select("event_id", "Date", "user_id"), e.where("event_id % 3 = 0").select("event_id", "Date", "value"))
    return found.df.select("event_id", "user_id", F.col("event_id__label").alias("other"), "value")


_REGION_MD = "'| ' || rpad(k, greatest(max(length(k)) over (), 3)::int, ' ') || ' | ' || rpad(n, greatest(max(length(n)) over (), 4)::int, ' ') || ' |'"


@query(f"""with r as (select r_regionkey::varchar k, r_name n, r_regionkey o from region), w as (select greatest(max(length(k)), 3)::int a, greatest(max(length(n)), 4)::int b from r)
    select 0::bigint line, '| ' || rpad('key', a, ' ') || ' | ' || rpad('name', b, ' ') || ' |' as text from w union all select 1, '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |' from w union all select 2 + row_number() over (order by o) - 1, {_REGION_MD} from r""")
def markdown_lines(spark, sf):
    names, rows = reports.rows_of(_t(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).orderBy("key"))
    return spark.createDataFrame(list(enumerate(reports.markdown_table(names, rows).split("\n"))), "line long, text string")


@query("select '<table><thead><tr><th>key</th><th>name</th></tr></thead><tbody>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || ' &amp; &lt;more&gt;</td></tr>', '' order by r_regionkey) || '</tbody></table>' as text from region")
def html_text_of_rows(spark, sf):
    names, rows = reports.rows_of(_t(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.concat("r_name", F.lit(" & <more>")).alias("name")).orderBy("key"))
    return spark.createDataFrame([(reports.html_table(names, rows),)], "text string")


# Gates and dispatch ---------------------------------------------------------------------------

_GATE_COLUMNS = {"quantity": True, "discount": True, "tax": True, "one": True, "rare": True, "returnflag": False, "linestatus": False, "orderpriority": False, "shipdate": False}


def _gates_sql() -> str:
    part = lambda c, number: f"select '{c}' as \"column\", count({c}) k, {f'count({c})' if number else '0'} m, count(distinct {c}) d, {f'count(distinct {c})' if number else '0'} e from g"
    return f"""with {D1_SQL}, g as (select *, 1 one, case when l_orderkey <= 40 then tax end rare, l_shipdate::varchar shipdate from d1), c as ({' union all '.join(part(*x) for x in _GATE_COLUMNS.items())})
    select "column", m >= 10 and e >= 2 numeric_feature, m >= 1 and e >= 2 matrix_feature, m >= 30 and e >= 2 ols_feature, m = k and e >= 2 fully_numeric, d between 2 and 50 label_50, d between 2 and 20 label_20,
      case when m >= 10 and e > 50 then 'regression' else 'classification' end task_by_values, case when m = 0 or d <= 10 then 'classification' else 'regression' end task_by_distinct from c"""


@query(_gates_sql())
def column_gates(spark, sf):
    df = d1(spark, sf).withColumns({"one": F.lit(1), "rare": F.when(F.col("l_orderkey") <= 40, F.col("tax")), "shipdate": F.col("l_shipdate").cast("string")})
    s = profile.column_stats(df, _GATE_COLUMNS)
    sets = [profile.numeric_features(s), profile.matrix_features(s), profile.numeric_features(s, 30), profile.fully_numeric(s), profile.categorical_labels(s), profile.categorical_labels(s, 20)]
    rows = [(c, *[c in x for x in sets], profile.task_by_values(s[c]), profile.task_by_distinct(s[c])) for c in _GATE_COLUMNS]
    return spark.createDataFrame(rows, "column string, numeric_feature boolean, matrix_feature boolean, ols_feature boolean, fully_numeric boolean, label_50 boolean, label_20 boolean, task_by_values string, task_by_distinct string")


@query(f"""with p as (select p_partkey, nullif(p_size, 1)::double size, p_retailprice price, row_number() over (order by md5('42|' || p_partkey), p_partkey) <= ceil(0.2 * count(*) over ()) is_test from part), m as (select median(size) m from p where not is_test),
    f as (select p_partkey, is_test, coalesce(size, m) size, price from p, m), t as (select avg(size) a, stddev_pop(size) b, avg(price) c, stddev_pop(price) d from f where not is_test)
    select p_partkey, is_test, {R('(size - a) / b')} size, {R('(price - c) / d')} price from f, t""")
def impute_and_scale_by_training_rows(spark, sf):
    p = _part(spark, sf).select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    parts = cut(sampling.split(p, "p_partkey"))
    made = preprocess.standardize(preprocess.impute(parts, ["size", "price"], ~F.col("is_test")), ["size", "price"], ~F.col("is_test"))
    return made.select("p_partkey", "is_test", rnd(F.col("size")).alias("size"), rnd(F.col("price")).alias("price"))


# Least squares --------------------------------------------------------------------------------

_OLS2 = f"""with {D1_SQL}, m as (select count(*) n, avg(quantity) mp, avg(tax) mq, avg(totalprice) mz, covar_pop(quantity, quantity) * count(*) pp, covar_pop(tax, tax) * count(*) qq, covar_pop(quantity, tax) * count(*) pq, covar_pop(quantity, totalprice) * count(*) pz, covar_pop(tax, totalprice) * count(*) qz, var_pop(totalprice) * count(*) zz from d1),
    b as (select *, pp * qq - pq * pq det, (qq * pz - pq * qz) / (pp * qq - pq * pq) b1, (pp * qz - pq * pz) / (pp * qq - pq * pq) b2 from m), s as (select *, (zz - b1 * pz - b2 * qz) / (n - 3) s2 from b),
    c as (select 'const' feature, mz - b1 * mp - b2 * mq b, sqrt(s2 * (1.0 / n + (mp * mp * qq - 2 * mp * mq * pq + mq * mq * pp) / det)) e, n from s union all select 'quantity', b1, sqrt(s2 * qq / det), n from s union all select 'tax', b2, sqrt(s2 * pp / det), n from s)"""


@query(f"{_OLS2} select 'totalprice' as label, feature, round(b, 4) coefficient, round(e, 4) std_error, round(b / e, 4) t_value, n samples from c")
def ols_two_regressors(spark, sf):
    found = models.ols(_d1_small(spark, sf), ["quantity", "tax"], ["totalprice"], "rid", cap=2**31 - 1)[1]
    return spark.createDataFrame([(c[0], c[1], round(c[2], 4), round(c[6], 4), round(c[5], 4), c[9]) for c in found], "label string, feature string, coefficient double, std_error double, t_value double, samples long")


@query(f"with {D1_SQL} select 'totalprice' as label, feature, round(b, 4) coefficient from (select unnest(['quantity', 'twice']) feature, unnest([regr_slope(totalprice, quantity) / 5, 2 * regr_slope(totalprice, quantity) / 5]) b from d1)")
def ols_collinear(spark, sf):
    """A column and its double share the effect: of all solutions the shortest. Both are centred, so the constant takes no part."""
    df = _d1_small(spark, sf)
    mean = df.agg(F.avg("quantity")).first()[0]
    df = df.withColumn("quantity", F.col("quantity") - mean).withColumn("twice", 2 * F.col("quantity"))
    found = models.ols(df, ["quantity", "twice"], ["totalprice"], "rid", cap=2**31 - 1)[1]
    return spark.createDataFrame([(c[0], c[1], round(c[2], 4)) for c in found if c[1] != "const"], "label string, feature string, coefficient double")


# Models: no SQL -------------------------------------------------------------------------------


def _pair(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Features and labels of documents by doc_id."""
    docs = _t(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").alias("length"), F.size(F.split("text", " ")).alias("words"), F.size(F.split("text", "\n")).alias("lines"))
    return docs, _t(spark, sf, "labels")


def _events(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Features and labels of events, both with a Date."""
    e = d3(spark, sf, windows.fold_rows()).withColumnRenamed("ts", "Date")
    return e.select("Date", "user_id", "hour", "k"), e.select("Date", "value", "event_type")


def _all_events(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The same of all events: regimes are of the whole table."""
    e = _timed(spark, sf).withColumnRenamed("ts", "Date")
    return e.select("Date", "user_id", "hour", "k"), e.select("Date", "value", "event_type")


_PAIR_SQL = "pr as (select d.doc_id, n_chars, length(text) length, len(string_split(text, ' ')) words, len(string_split(text, chr(10))) lines, quality, toxic from documents d join labels l on d.doc_id is not distinct from l.doc_id)"
_DOCS_SQL = "(select doc_id, n_chars, length(text) length, len(string_split(text, ' ')) words, len(string_split(text, chr(10))) as lines from documents)"


def _module_eda_sql() -> str:
    one = lambda source, dataset, c, kind: f"""select '{dataset}' dataset, '{c}' as "column", '{kind}' dtype, 'numeric' inferred_type, count(*) as "rows", count({c}) non_null, count(*) - count({c}) missing, {R(f'(count(*) - count({c})) * 100.0::double / count(*)')} missing_pct, count(distinct {c}) as "unique", {R(f'count(distinct {c}) * 100.0::double / count(*)')} unique_pct, count(*) filter ({c} = 0) zero_count, count(*) filter ({c} < 0) negative_count from {source}"""
    return " union all ".join([one(_DOCS_SQL, "features", c, k) for c, k in (("doc_id", "int64"), ("n_chars", "int64"), ("length", "int32"), ("words", "int32"), ("lines", "int32"))] + [one("labels", "labels", c, "int32") for c in ("quality", "toxic")])


#: SQL of the modules that have some.
_MODULE_SQL = {
    "module_statistics_target_summary": f"with {_PAIR_SQL} select 'quality' as label, count(distinct quality) as \"unique\", count(*) - count(quality) missing from pr union all select 'toxic', count(distinct toxic), count(*) - count(toxic) from pr",
    "module_statistics_label_distribution": f"with {_PAIR_SQL} select 'quality' as label, quality::varchar as value, count(*) as count from pr group by quality union all select 'toxic', toxic::varchar, count(*) from pr group by toxic",
    "module_eda_missingness": f"select dataset, \"column\", missing, missing_pct, non_null, \"rows\" from ({_module_eda_sql()})",
    "module_statistics_feature_label_correlations": f"with {_PAIR_SQL} {_corr_sql('pr', [(f, y) for f in ('n_chars', 'length', 'words', 'lines') for y in ('quality', 'toxic')])}",
    "module_eda_columns_profile": _module_eda_sql(),
    "module_information_coefficient_feature_scores": f"with {D3_SQL}, {_ic_sql(_FOLDS, 'fold', 20)} select * from ({_SUMMARY}) where label = 'value'",
    "module_regime_scoring_feature_scores": f"""with {D3_SQL}, {_REGIME}, w as (select * exclude (pos), row_number() over (partition by regime order by pos) - 1 pos, count(*) over (partition by regime) size from g), {_ic_sql(_REGIME_FOLDS, 'regime, fold', 10)}
    select s.*, regime_count, 'all' regime from ({_SUMMARY}) s join (select feature, label, score_name, count(distinct regime) regime_count from ic group by all) using (feature, label, score_name) where label = 'value'""",
}


def _module(name: str, relation: str, data, settings: modules.Settings, **more):
    def run(spark, sf):
        f, y = data(spark, sf)
        return modules.compute(name, f, y, settings=settings, **more)[relation]

    run.__name__ = f"module_{name}_{relation}"
    QUERIES[run.__name__] = run
    if run.__name__ in _MODULE_SQL:
        ORACLES[run.__name__] = _MODULE_SQL[run.__name__]


#: The modules' defaults.
_SETTINGS = modules.Settings()
for _name, _relation, _data in (
    ("sklearn", "scores", _pair), ("sklearn", "importance", _pair), ("statsmodels", "coefficients", _pair), ("xgboost", "scores", _pair), ("xgboost", "importance", _pair), ("shap", "shap_importance", _pair), ("boruta", "boruta_features", _pair),
    ("kmean", "kmean_results", _pair), ("kmeans_gpu", "kmean_results", _pair), ("information_coefficient", "feature_scores", _events), ("permutation_importance_ts", "feature_scores", _events), ("timeseries_importance", "feature_scores", _events),
    ("mutual_information", "feature_scores", _pair), ("mrmr", "feature_scores", _pair), ("stability_selection", "feature_scores", _pair), ("regularized_linear", "feature_scores", _pair), ("lightgbm", "feature_scores", _pair),
    ("feature_interactions", "feature_scores", _pair), ("regime_scoring", "feature_scores", _all_events), ("scipy", "pairwise", _pair), ("statistics", "feature_label_correlations", _pair), ("eda", "columns_profile", _pair),
    ("statistics", "target_summary", _pair), ("statistics", "label_distribution", _pair), ("eda", "missingness", _pair),
):
    _module(_name, _relation, _data, _SETTINGS, **({"targets": ["value"]} if _name in ("permutation_importance_ts", "timeseries_importance") else {}))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


