import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import ann, common, line_dedup, ngram_join, similarity

from .helpers import brute_components, clashing, documents, shingles

VOCABULARY = [f"w{i}" for i in range(3000)]


def _edited(rng, w, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else x for x in w]


def _corpus(seed=4):
    rng, out = random.Random(seed), []
    passage = rng.choices(VOCABULARY, k=60)
    for _ in range(25):
        base = rng.choices(VOCABULARY, k=rng.choice([1, 2, 4, 5, 7, 8, 9, 12, 20, 60, 150, 400]))
        out.append(base)
        for _ in range(rng.randrange(0, 6)):
            w = _edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.08]))
            cut = rng.randrange(0, max(1, len(w) // 8))
            out.append(w[cut:] if rng.random() < 0.5 else w + rng.choices(VOCABULARY, k=cut))
    for _ in range(40):  # many texts share a passage without being alike
        out.append(rng.choices(VOCABULARY, k=rng.randrange(20, 200)) + passage)
    rng.shuffle(out)
    return [(i, " ".join(w), f"s{i % 3}") for i, w in enumerate(out)]


def _check_join(found, data, words, part):
    sets = {i: shingles(t, words) for i, t, _ in data}
    components = brute_components(sets, part)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), components[i]) for i in sets}


def test_ngram_join_against_all_pairs(spark):
    data = _corpus() + [(1000, None, "s"), (1001, "", "s"), (1002, " \t", "s"), (1003, "One two", "s"), (1004, "one TWO", "s"), (1005, "one two three four five " * 4000, "s"), (1006, "one two three four five " * 4001, "s")]
    _check_join(ngram_join.ngram_join(documents(spark, data)).collect(), data, 4, 85)
    _check_join(ngram_join.ngram_join(clashing(spark, data), words=5, part=80).collect(), data, 5, 80)
    assert ngram_join.ngram_join(documents(spark, [])).count() == 0


def test_ngram_join_splits_large_clusters(spark, monkeypatch):
    rng = random.Random(8)
    base = rng.choices(VOCABULARY, k=80)
    data = [(i, " ".join(_edited(rng, base, 0.02)[: rng.randrange(66, 81)]), "s") for i in range(160)]
    # many texts with much in common of which few link: a large cluster that falls apart
    shared = rng.choices(VOCABULARY, k=200)
    for i in range(120):
        at = rng.randrange(0, 90)
        data.append((500 + i, " ".join(shared[at : at + rng.randrange(60, 110)]), "s"))
    for tile, pivots in ((8, 2), (8, 1), (30, 5)):
        monkeypatch.setattr(similarity, "TILE", tile)
        monkeypatch.setattr(similarity, "PIVOTS", pivots)
        _check_join(ngram_join.ngram_join(documents(spark, data)).collect(), data, 4, 85)


def test_large_clusters_of_lines(spark, monkeypatch):
    rng = random.Random(18)
    shared = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=150))
    data = []
    for i in range(90):
        at = rng.randrange(0, 70)
        data.append((i, shared[at : at + rng.randrange(60, 81)], "s"))
    monkeypatch.setattr(similarity, "TILE", 6)
    monkeypatch.setattr(similarity, "PIVOTS", 2)
    sets = {i: {f[j : j + 6] for j in range(len(f) - 5)} for i, f in ((i, line_dedup.normal_form(t)) for i, t, _ in data)}
    components = brute_components(sets, 80)
    found = {r.doc_id: ([x.keeper for x in r.dropped] or [r.doc_id])[0] for r in line_dedup.line_verdicts(documents(spark, data)).collect()}
    assert sum(found[i] != components[i] for i in components) <= 2  # banding may miss a pair near the threshold


def test_ngram_join_repeated_rows_and_null_ids(spark):
    text = " ".join(VOCABULARY[:50])
    out = [(r.doc_id, r.component_id) for r in ngram_join.ngram_join(documents(spark, [(5, text, "s"), (5, text, "s"), (3, text, "s"), (None, text, "s"), (9, "else " * 9, "s")])).collect()]
    assert sorted(out, key=str) == sorted([(5, 3), (5, 3), (3, 3), (None, None), (9, 9)], key=str)


def test_keys_never_lose_a_link():
    """Every linked pair shares a key: over random sets of all small sizes."""
    rng = np.random.default_rng(3)
    for part in (80, 85):
        for size in [*range(1, 45), 120, 500]:
            for _ in range(6):
                base = rng.integers(0, 2**63, size, dtype=np.uint64)
                drop = rng.integers(0, max(1, size // 8) + 1)
                other = np.concatenate([base[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, size // 9) + 1), dtype=np.uint64)])
                sets = [np.unique(base), np.unique(other)]
                if not len(sets[1]):
                    continue
                n = len(np.intersect1d(*sets))
                if 100 * n < part * (len(sets[0]) + len(sets[1]) - n) or len(sets[0]) == len(sets[1]) == n:
                    continue
                sizes = np.array([len(x) for x in sets])
                keys, item = ngram_join.keys(similarity.Items(np.arange(2), np.arange(1, 3, dtype=np.uint64), sizes, np.concatenate(sets), np.cumsum(sizes)), part)
                assert set(keys[item == 0].tolist()) & set(keys[item == 1].tolist())


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choices(VOCABULARY, k=rng.randrange(5, 60)))
    shared, data = [line() for _ in range(12)], []
    for i in range(60):
        lines = [line() for _ in range(rng.randrange(0, 5))]
        for _ in range(rng.randrange(0, 4)):
            x = rng.choice(shared)
            at = rng.randrange(len(x))
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([x, x.upper(), f"  {x}", x[:at] + "#" + x[at + 1 :], x + " tail"]))
        data.append((i, "\n".join([*lines, "short", "short"]), "s"))
    data += [(200, None, "s"), (201, "", "s"), (202, shared[0], "s"), (203, shared[0] + "\n" + shared[0], "s"), (204, "\n\n \t", "s"), (205, "ab\nAB \nabc", "s")]
    sets = {}
    for i, t, _ in data:
        for k, x in enumerate((t or "").split("\n")):
            form = line_dedup.normal_form(x)
            if form:
                sets[i, k] = {form[j : j + 6] for j in range(max(1, len(form) - 5))}
    components = brute_components(sets, line_dedup.PART)
    expected = {i: sorted((k, components[i, k][0]) for (j, k) in sets if j == i and components[j, k] != (j, k)) for i, _, _ in data}
    found = {r.doc_id: [(x.line, x.keeper) for x in r.dropped] for r in line_dedup.line_verdicts(clashing(spark, data)).collect()}
    total = sum(map(len, expected.values()))
    missed = sum(len(set(expected[i]) ^ set(found[i])) for i in expected)
    assert total > 50 and missed <= 0.03 * total  # banding may miss a pair near the threshold
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, data)).collect()}
    assert 202 not in out and 203 not in out and out[200] is None and out[201] == "" and out[204] == "\n\n \t" and out[205] == "ab\nabc"
    for i, t, _ in data[:60]:
        gone = {k for k, _ in found[i]}
        left = [x for k, x in enumerate(t.split("\n")) if k not in gone]
        if gone and not any(x.strip() for x in left):
            assert i not in out
        else:
            assert out[i] == ("\n".join(left) if gone else t)
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


def test_components(spark, monkeypatch):
    edges, expected = _edges()
    for most in (similarity.ONE_TASK, 0):  # one task, and rounds over tables
        monkeypatch.setattr(similarity, "ONE_TASK", most)
        found = [(r.node, r.root) for r in similarity.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()]
        assert sorted(found) == sorted(expected.items())
    assert similarity.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _edges():
    rng, edges = random.Random(2), []
    for _ in range(60):
        a = rng.randrange(0, 100)
        edges.append((a, rng.randrange(0, 100)))
    edges += [(200 + i, 201 + i) for i in range(40)] + [(300, k) for k in range(301, 380)]
    parent = {}
    for a, b in edges:
        ra, rb = a, b
        while parent.get(ra, ra) != ra:
            ra = parent[ra]
        while parent.get(rb, rb) != rb:
            rb = parent[rb]
        parent[max(ra, rb)] = min(ra, rb)

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    return edges, {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 5000 + [2, 2, 3, 4, None])], "k long, i long")
    by_key = spark.createDataFrame([(1, "a", 5000), (2, "b", 2), (3, "c", 1), (9, "d", 0)], "k long, v string, n long")
    for how in ("inner", "left"):
        found = common.spread_join(rows, by_key, "k", 5004, how)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, rows.join(by_key.drop("n"), "k", how).collect()), key=str)


def test_line_dedup_repeated_rows_and_null_ids(spark):
    text = "a line that is there again and again\nand one of its own " * 2
    data = [(5, text, "s"), (5, text, "s"), (3, "a line that is there again and again", "s"), (None, text, "s"), (5, "something else\nA  line that is there again and again", "s")]
    found = sorted((r.doc_id or 0, r.n_lines, [tuple(x) for x in r.dropped]) for r in line_dedup.line_verdicts(documents(spark, data)).collect())
    assert found == [(0, 3, []), (3, 1, []), (5, 2, [(1, 3)]), (5, 3, [(0, 3)]), (5, 3, [(0, 3)])]
    assert line_dedup.line_verdicts(documents(spark, [])).count() == 0
    spared = line_dedup.line_verdicts(documents(spark, [(1, "}\n}\nlonger line", "s"), (2, "longer line", "s")]), min_chars=5).collect()
    assert sorted((r.doc_id, [tuple(x) for x in r.dropped]) for r in spared) == [(1, []), (2, [(0, 1)])]


def test_maybe_in_loses_nothing(spark):
    df, keys = spark.range(5000).withColumn("v", F.col("id") * 2), spark.range(0, 5000, 7)
    maybe, rest = similarity.maybe_in(df, keys, ["id"])
    a, b = {r.id for r in maybe.collect()}, {r.id for r in rest.collect()}
    assert a | b == set(range(5000)) and not a & b and set(range(0, 5000, 7)) <= a and len(a) < 1500


def _vectors(n=700, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[50]  # a common vector
    return x


def _check_search(out, x, ids, queries, least):
    """Ranks, order and scores by brute force; the share of true neighbours found."""
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(queries)
    hit, place = 0, {i: n for n, i in enumerate(ids)}
    for q, found in by.items():
        score = ann.exact(np.repeat(x[place[q]][None].astype(float), len(x), 0), x.astype(float))
        best = [ids[i] for i in np.lexsort((np.array(ids), -score)) if ids[i] != q][:20]
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == score[place[i]] for _, i, s in found)
        hit += len(set(best) & {i for _, i, _ in found})
    assert hit >= least * 20 * len(by)


def test_multi_index_recall_order_and_odd_rows(spark):
    x = _vectors()
    rows = [(i, v.tolist(), 0, "q", 1) for i, v in enumerate(x)]
    odd = [(1000, None, 0, "q", 1), (1020, [0.0] * 16, 0, "q", 1), (1040, [float("nan")] * 16, 0, "q", 1), (1060, [1.0, None] * 8, 0, "q", 1), (None, [1.0] * 16, 0, "q", 1), (1100, [float("inf")] * 16, 0, "q", 1), (1120, [], 0, "q", 1)]
    schema = "vec_id long, embedding array<float>, label int, block string, chunk int"
    df = spark.createDataFrame(rows + odd, schema)
    _check_search(ann.search(df, F.col("vec_id") % 20 == 0).collect(), x, list(range(700)), range(0, 700, 20), 0.9)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2
    # other lengths are searched on their own, of one component on
    short = spark.createDataFrame([(2000 + i, [float(i % 30 + 1)], 0, "q", 1) for i in range(60)], schema)
    out = [r for r in ann.search(df.unionByName(short), F.col("vec_id") % 20 == 0).collect() if r.query_id >= 2000]
    assert {r.query_id for r in out} == {2000, 2020, 2040}
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 2000][:3] == [2029, 2059, 2028]


def test_multi_index_visits_few_of_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 24))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    v = F.col("embedding").cast("array<double>")
    index = ann.Index(df.select(F.col("vec_id").alias("id"), v.alias("v"), F.lit(False).alias("query")), 24)
    assert index.counts.sum() == 6000 and index.reach(20, ann.RECALL) < 0.1 * 6000
    _check_search(ann.search(df, F.col("vec_id") % 50 == 0).collect(), x, list(range(6000)), range(0, 6000, 50), 0.9)


def test_cells_are_packed_into_blocks():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 9, 64)
    counts[17] = 100
    first, pieces = ann.packed(counts, 8, 20)
    held = {}
    for c in np.flatnonzero(counts):
        for p in range(pieces[c]):
            held[first[c] + p] = held.get(first[c] + p, 0) + -(-counts[c] // pieces[c])
    assert pieces[17] == 5 and max(held.values()) <= 20 and sorted(held) == list(range(len(held)))


def test_walk_is_by_descending_sum():
    rng = np.random.default_rng(5)
    a, b, counts = rng.normal(size=6), rng.normal(size=7), rng.integers(0, 3, (6, 7))
    cells = ann.walk(a, b, counts, int(counts.sum()))
    assert sorted(cells) == np.flatnonzero(counts).tolist()
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums, reverse=True)
    some = ann.walk(a, b, counts, 5)
    assert some == cells[: len(some)] and counts.ravel()[some].sum() >= 5 > counts.ravel()[some[:-1]].sum()


def test_line_dedup_links_one_edit_in_short_lines(spark):
    """One changed character breaks six shingles of six: lines from 59 characters on are near copies. Lengths are stated here, not read from the module."""
    rng, data = random.Random(12), []
    for i, n in enumerate([64, 65, 66, 67, 68] * 4):
        x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        data += [(2 * i, x, "s"), (2 * i + 1, x[: n // 2] + "#" + x[n // 2 + 1 :], "s")]
    found = {r.doc_id: [(x.line, x.keeper) for x in r.dropped] for r in line_dedup.line_verdicts(documents(spark, data)).collect()}
    linked = [i for i in range(20) if found[2 * i] == [] and found[2 * i + 1] == [(0, 2 * i)]]
    assert len(linked) >= 19  # banding may miss a pair near the threshold


def test_ngram_items_of_a_block_shorter_than_a_shingle(spark):
    for n in range(1, 6):
        for words in (4, 5):
            found = ngram_join.items([" ".join(VOCABULARY[:n]).encode()], similarity.SETS, words)
            assert found.size.tolist() == [max(1, n - words + 1)]
    for text in ("One two", "One two three"):
        out = ngram_join.ngram_join(documents(spark, [(7, text, "s")]), words=5, part=80).collect()
        assert [tuple(r) for r in out] == [(7, 1, 7)]


def test_chance_keys_connect_no_clusters(spark):
    """A chain of nodes that share keys, of which two have like sketches: one cluster of two, not one of all."""
    rng, nodes = np.random.default_rng(5), np.arange(1, 41, dtype=np.uint64)
    words = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    words[11] = words[10] ^ np.uint64(7 << 61)
    keys = np.repeat(np.arange(1, 40, dtype=np.uint64), 2)
    members = np.stack([nodes[:-1], nodes[1:]], axis=1).ravel()
    rows = [(0, similarity.pack(keys), similarity.pack(members), b""), (-1, words.tobytes(), nodes.tobytes(), b"")]
    df = spark.createDataFrame([(g, bytearray(k), bytearray(m), bytearray(p)) for g, k, m, p in rows], "group int, keys binary, members binary, places binary")
    assert similarity.clusters(df).count() == 40
    assert sorted(tuple(r) for r in similarity.clusters(df, True).collect()) == [(11, 11), (12, 11)]


def test_agreeing_sketches_against_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (30, 2), dtype=np.uint64)[rng.integers(0, 30, 400)]
    noise = sum((rng.integers(0, 2, (400, 2)).astype(np.uint64) << np.uint64(k) for k in range(0, 64, 2)), np.uint64(0))
    x, y = (base ^ noise).T.copy()
    name, node = np.sort(rng.integers(0, 40, 400)).astype(np.int64), np.arange(400)
    a, b = similarity.agreeing(name, node, x.view(np.int64), y.view(np.int64))
    i, j = np.nonzero((name[:, None] == name) & (np.bitwise_count((x[:, None] ^ x) | (y[:, None] ^ y)) <= similarity.SKETCH - similarity.AGREE))
    own = np.arange(400)
    plain, got = (dict(zip(*(v.tolist() for v in similarity.local_roots(np.append(p, own), np.append(q, own))), strict=True)) for p, q in ((i, j), (a, b)))
    assert plain == got and len(set(got.values())) < 400


def test_sketches_of_linked_lines_agree():
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(300):
        line = "".join(rng.choice(list("abcdefgh "), 150))
        at = int(rng.integers(20, 120))
        texts += [line, line[:at] + "zzz" + line[at + 3 :]]
    sets = line_dedup.items(["\n".join(texts).encode()], similarity.SETS)
    sketch = line_dedup.keys_and_sketches(sets)[2]
    assert len(sketch) == 600
    same = similarity.SKETCH - np.bitwise_count((sketch[::2] ^ sketch[1::2])[:, 0] | (sketch[::2] ^ sketch[1::2])[:, 1])
    others = similarity.SKETCH - np.bitwise_count((sketch[:-2] ^ sketch[2:])[:, 0] | (sketch[:-2] ^ sketch[2:])[:, 1])
    assert same.min() >= similarity.AGREE and (others < similarity.AGREE).mean() > 0.99


def test_ngram_join_stores_no_keys(spark):
    """Keys are about as large as the texts: the shuffle of their ranges is their only copy on disk."""
    rng = random.Random(12)
    data = [(i, " ".join(rng.choices(VOCABULARY, k=200)), "s") for i in range(400)]
    common.sweep(spark)
    _check_join(ngram_join.ngram_join(documents(spark, data)).collect(), data, 4, 85)
    stored = sum(f.stat().st_size for path in common._stashes for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert 0 < stored < 0.2 * sum(len(t) for _, t, _ in data)


def test_large_sets_that_do_not_link_are_not_intersected(monkeypatch):
    """Bitmaps grow with the sets: full ones let every pair of large sets through to the exact test. Links stay those of all pairs."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(1, 2**63, int(n), dtype=np.uint64)) for n in [*rng.integers(3, 90, 40), *rng.integers(4000, 5000, 120), *rng.integers(15_000, 18_000, 10)]]
    sets += [np.unique(np.append(s[: int(len(s) * share)], rng.integers(1, 2**63, 1, dtype=np.uint64))) for s in sets[::7] for share in (0.7, 0.97)]
    method = similarity.Method(None, None, None, 80)
    whole = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((whole[i], whole[j]))
                whole[whole == high] = low
    exact, found = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: (exact.append(1) if np.size(v) > 1 and a.dtype == np.uint64 else None, found(a, v, *rest))[1])
    assert (similarity.link(sets, np.zeros(len(sets), int), method) == whole).all()
    assert 20 <= len(exact) < 2 * len(sets)
