"""The operators over the standard tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_dedup, html_text, line_dedup, lm, ngram_join, packing, secrets, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("repo").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers from 0; keeper_ids: for each dropped line the document whose line stays."""
    found = line_dedup.line_verdicts(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
        F.transform("dropped", lambda x: x["line"]).alias("dropped_lines"), F.transform("dropped", lambda x: x["keeper"]).alias("keeper_ids"),
    )


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_sql() -> str:
    def kind(name: str, regex: str, group: int, least: int) -> str:
        r = _quoted(regex)
        return f"""select doc_id, source, '{name}' kind, unnest(list_transform(range(1, len(w) + 1), lambda i: struct_pack(
            s := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0), n := length(w[i]), v := v[i]))) x
          from (select doc_id, source, string_split_regex(t, {r}) g, regexp_extract_all(t, {r}) w, regexp_extract_all(t, {r}, {group}) v from d where regexp_matches(t, {r}))"""

    kinds = [("assign", secrets.ASSIGN, 2, 6), ("access", secrets.ACCESS, 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24), ("vendor", secrets.VENDOR, 0, 1)]
    parts = " union all ".join(f"select doc_id, source, kind, x.s::bigint s, (x.s + x.n)::bigint e, x.v v from ({kind(*k)}) where length(x.v) >= {k[3]}" for k in kinds)
    rank = "case kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 else 3 end"
    return f"""
    with d as (select doc_id, source, coalesce(text, '') t from documents), c as ({parts}),
    f as (select v, count(distinct doc_id) + max((doc_id is null)::int) repos, count(distinct source) + max((source is null)::int) owners from c group by v),
    live as (select distinct doc_id, 'live' kind, e - length(v) s, e from c join f using (v)
             where owners <= {secrets.MAX_OWNERS} and repos <= {secrets.MAX_REPOS} and regexp_matches(v, '[0-9]') and len(list_distinct(string_split(v, ''))) >= {secrets.MIN_DIFFERENT}),
    base as (select doc_id, kind, s, e from c where kind <> 'vendor'),
    b as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
                 string_agg(kind || ':' || s || ':' || e, ',' order by s, {rank}) txt from base group by doc_id),
    a as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, {rank}, e) spans from (select * from base union all select doc_id, kind, s, e from live) group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(txt, '')) base_sha256, coalesce(spans, '') spans
    from d left join b on b.doc_id = d.doc_id left join a on a.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": _secret_sql(),
        "op8_exact_dedup": """
    select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(coalesce(text, '')) text_sha256
    from documents window w as (partition by coalesce(text, ''))""",
    }
