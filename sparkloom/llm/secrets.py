"""Secret scan with corpus-wide ownership frequency. DataFrame operations only.

Every text is matched by the base patterns below. ``regexp_extract_all`` gives the matches and ``split``
the pieces between them, so running sums of their lengths give the spans in code points. Values of the
matches are hashed; over the corpus each hash has a number of distinct repositories and of distinct
owners. A value that few repositories of one owner hold and that looks random is taken for live: its
own span is added with kind ``live``. Widely copied values are examples and add nothing.

Defined results: null text counts as empty and has no spans; empty texts have none; very long texts are
matched whole, in time about linear in their matches; null owners and repositories count as one owner or
repository each; repeated rows each get a row, and count as one repository if their ids agree; spans that
begin at one place are ordered by kind as listed and then by end; an empty table gives an empty result.
Columns are taken by name; redact() keeps extra ones, whatever their names, but for names that begin
with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stash

# The base patterns, the group that holds the value and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Prefixes of well-known issuers: candidates of the method alone.
VENDOR = r"gh[pousr]_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{10,}"
KINDS = ("assign", "access", "hex", "live")
#: A live value has at most so many owners and repositories, and at least so many different characters.
MAX_OWNERS, MAX_REPOS, MIN_DIFFERENT = 1, 3, 8
#: Verdicts on hashes that hold over 1/HOT_SHARE of all candidate spans are broadcast: fewer than HOT_SHARE rows.
HOT_SHARE = 500
#: Elements of an array that are gone through at once.
BLOCK = 256

_SPANS = "array<struct<kind:string,start:int,end:int,vstart:int,value:string>>"


def _once(value: Column, use) -> Column:
    """use(value), which evaluates it once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """The arrays that emit(state, item) gives, end to end; step(state, item) is the next state. By blocks, as every array that grows is copied with each element."""
    empty = F.array().cast(kind)

    def told(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(z) / BLOCK).cast("int") - 1, F.lit(0)))
        part = lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK))
        states = F.aggregate(blocks, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.aggregate(part(b), F.element_at(acc, -1), step))))

        def each(at: Column) -> Column:
            one = lambda b: F.aggregate(
                part(b), F.struct(F.get(at, b).alias("s"), empty.alias("out")),
                lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], emit(acc["s"], x)).alias("out")), lambda acc: acc["out"],
            )
            return F.flatten(F.transform(blocks, one))

        return _once(states, each)

    return _once(items, told)


def _matches(text: Column, kind: str, regex: str, group: int, least: int, hint: str) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has ``least`` characters. Java's split and find walk alike."""
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    zipped = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("value"))

    def span(at: Column, x: Column) -> Column:
        begin = at + size(x["gap"])
        end = begin + size(x["all"])
        made = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), (end - F.length(x["value"])).alias("vstart"), x["value"].alias("value"))
        return F.when(F.length(x["value"]) >= least, F.array(made)).otherwise(F.array().cast(_SPANS))

    found = _running(zipped, F.lit(0), lambda at, x: at + size(x["gap"]) + size(x["all"]), span, _SPANS)
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """All candidate spans of a text, base kinds and ``vendor``. The hints are implied by a match that counts."""
    parts = [
        _matches(text, "assign", ASSIGN, 2, 6, r"(?i)(?:passw|secret|token|api_?key)[a-z]*[\"']?\x20*[:=]"),
        _matches(text, "access", ACCESS, 0, 20, r"AKIA[A-Z0-9]{16}"),
        _matches(text, "hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
        _matches(text, "vendor", VENDOR, 0, 1, VENDOR),
    ]
    return F.concat(*parts)


def verdicts(spans: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """spans: hash, repo, owner. Per hash: uses, n_repos, n_owners, live. Each step aggregates before it shuffles."""
    each = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("uses"))
    repos = each.groupBy("hash", "repo").agg(F.sum("uses").alias("uses")).groupBy("hash").agg(F.count("*").alias("n_repos"), F.sum("uses").alias("uses"))
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def looks_random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DIFFERENT) & value.rlike("[0-9]")


def _found(text: Column) -> Column:
    """Candidate spans with the hashes of their values, which stand for the values from here on."""
    return F.transform(base_spans(text), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["vstart"].alias("vstart"), F.sha2(x["value"].cast("binary"), 256).alias("hash"), looks_random(x["value"]).alias("odd")))


def scan(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """Per row: repo, owner, row (a number), base and spans: all with kind, start, end by start and kind; n_copied."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return judge(cut(docs.select(F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.monotonically_increasing_id().alias("row"), _found(text).alias("found"))))


def judge(rows: DataFrame) -> DataFrame:
    """rows: repo, owner, row, found; stored. The result of scan()."""
    spans = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("x")).select("row", "repo", "owner", "x.*")
    told = cut(verdicts(spans.select("hash", "repo", "owner")))
    total = told.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    hot = told.where(F.col("uses") * HOT_SHARE > total).select("hash", F.col("live").alias("hot_live"))
    near = spans.join(F.broadcast(hot), "hash", "left")
    known = near.where("hot_live is not null").withColumn("live", F.col("hot_live"))
    rest = near.where("hot_live is null").join(told.select("hash", "live"), "hash", "left")
    added = (
        known.unionByName(rest).groupBy("row")
        .agg(F.collect_set(F.when(F.col("live") & F.col("odd"), F.struct(F.lit("live").alias("kind"), F.col("vstart").alias("start"), "end"))).alias("live"), F.count(F.when(~F.col("live"), 1)).alias("n_copied"))
    )
    base = F.transform(F.filter("found", lambda x: x["kind"] != "vendor"), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.join(added, "row", "left").select("repo", "owner", "row", _sorted(base).alias("base"), _sorted(F.concat(base, F.coalesce("live", empty))).alias("spans"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def _sorted(spans: Column) -> Column:
    """By start, then by kind as listed in KINDS, then by end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """docs with every span replaced: [SECRET] if a live value lies in it, else [EXAMPLE]. Texts are matched once; those without a span aren't shuffled."""
    columns = docs.columns
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stored = stash(docs.withColumns({"__row": F.monotonically_increasing_id(), "__found": _found(text)}))
    some = F.size("__found") > 0
    hits = stored.where(some)
    found = judge(cut(hits.select(F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.col("__row").alias("row"), F.col("__found").alias("found")))).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    merged = hits.join(found, "__row").withColumn(text_col, _cut_out(text, F.col("__spans")))
    return stored.where(~some).select(*columns).unionByName(merged.select(*columns))


_GROUPS = "array<struct<after:int,s:int,live:boolean>>"


def _cut_out(text: Column, spans: Column) -> Column:
    """Overlapping spans become one, live if one of them is; what lies between them is kept. spans: sorted by start."""
    # until where the spans before reach, and whether this one begins a group
    placed = _running(
        spans, F.lit(0), lambda m, x: F.greatest(m, x["end"]),
        lambda m, x: F.array(F.struct(m.alias("after"), x["start"].alias("s"), (x["kind"] == "live").alias("live"), (x["start"] >= m).alias("first"))), "array<struct<after:int,s:int,live:boolean,first:boolean>>",
    )
    # from the end on: whether a span of the group from here on is live; the first of a group tells
    groups = F.reverse(_running(
        F.reverse(placed), F.lit(False), lambda live, x: ~x["first"] & (live | x["live"]),
        lambda live, x: F.when(x["first"], F.array(F.struct(x["after"].alias("after"), x["s"].alias("s"), (live | x["live"]).alias("live")))).otherwise(F.array().cast(_GROUPS)), _GROUPS,
    ))
    last = F.array_max(F.transform(spans, lambda x: x["end"]))

    def pieces(g: Column) -> Column:
        """Text before each group and its mark. A block is cut out of the text first, as finding a place takes as long as what lies before it."""

        def block(b: Column) -> Column:
            own = F.slice(g, b * BLOCK + 1, F.lit(BLOCK))
            begin = F.get(own, F.lit(0))["after"]
            each = lambda t: F.transform(own, lambda x: F.concat(F.substring(t, x["after"] - begin + 1, x["s"] - x["after"]), F.when(x["live"], "[SECRET]").otherwise("[EXAMPLE]")))
            return F.array_join(_once(F.substring(text, begin + 1, F.element_at(own, -1)["s"] - begin), each), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size(g) / BLOCK).cast("int") - 1), block), "")

    return F.when(spans.isNull() | (F.size(spans) == 0), text).otherwise(F.concat(_once(groups, pieces), F.substring(text, last + 1, F.length(text))))
