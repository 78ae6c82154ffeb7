"""Hand-computed cases, invariants and round trips."""

import fnmatch
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, cluster, containment, edits, graph, joins, ranking, retrieval, summaries
from tessera.streaming.usage import windowed_usage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, text.tokens(F.lit("orderTotal-price_2"))) == ["order", "total", "price", "2"]
    assert one(spark, text.clean_comment(F.lit("a (b) c|d\ne"))) == "a  c"
    assert one(spark, text.bigrams(F.lit("abc, abcde"))) == ["abc", "ab", "bc", "cd", "de"]
    assert one(spark, text.samples(F.lit(" a | |b|c|d|e|f"))) == ["a", "b", "c", "d", "e"]
    assert one(spark, text.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == 1 - 3 / 7
    assert one(spark, text.edit_similarity(F.lit(None).cast("string"), F.lit("x"))) == 0
    assert one(spark, F.rlike(F.lit("etl_a"), text.glob_regex(F.lit("ETL_*"))))
    assert one(spark, text.fenced_json(F.lit('```json\n{"k": 3}\n```'), "k int")).k == 3
    assert one(spark, text.blank_samples(F.lit("null| |N/A"), (*text.NULL_TOKENS, "N/A"))) and not one(spark, text.blank_samples(F.lit("null|none")))
    assert one(spark, text.empty_sample(F.lit(" NULL | none -|"))) and not one(spark, text.empty_sample(F.lit("null|n/a")))
    assert one(spark, text.token_set(F.lit("Order_date（订单日期）/x"))) == ["order", "date", "订单日期", "x", "订单", "单日", "日期"]
    assert one(spark, text.character_class(F.array(F.lit("a"), F.lit("1")))) == "mixed"


def test_globs_equal_fnmatch(spark):
    """Random globs of brackets, wildcards and what regular expressions treat as their own."""
    rng = np.random.default_rng(7)
    signs = list("ab]][[!-*?^&&\\|.(a-c") + ["\n", "é", "$", "&&"]
    globs = ["a*]b", "a?]", "[a&&b]x", "[]a]", "[!]a]", "[b-a]", "[!b-a]", "[^a]", "[a-]", "[--a]", "[!]", "[", "", "*", "a[", "[a-c-e]"] + ["".join(rng.choice(signs, rng.integers(1, 8))) for _ in range(900)]
    rows = [(i, g, "".join(rng.choice(signs, rng.integers(0, 5))) if k else re.sub(r"[*?\[!]", "", g)) for i, g in enumerate(globs) for k in range(6)]
    df = spark.createDataFrame(rows, "i int, glob string, name string")
    got = df.select("glob", "name", F.expr("lower(name)").alias("low"), text.glob_regex(F.col("glob")).alias("regex")).selectExpr("glob", "name", "low rlike regex as hit").collect()
    assert [r for r in got if r.hit != fnmatch.fnmatchcase(r.name.lower(), r.glob.lower())] == []
    assert sum(r.hit for r in got) > 300


@pytest.mark.parametrize("hot", [3, 65536])
def test_containment(spark, hot):
    """All texts with all parts, with pairs of characters that many texts share, single characters, empty and null ones, repeats and signs of two code units."""
    rng = np.random.default_rng(3)
    make = lambda n, most: ["".join(rng.choice(list("abé😀 "), rng.integers(0, most))) for _ in range(n)]
    texts, parts = make(150, 9) + ["key of key", "key", None], make(60, 4) + ["key", "zz", "a", None, ""]
    df = lambda x, name: spark.createDataFrame([(v, 1) for v in x + x[:9]], f"{name} string, gram int")
    for least in (1, 2):
        got = sorted(map(tuple, containment.containing(df(texts, "text"), df(parts, "part"), least, hot).collect()))
        assert got == sorted({(t, p) for t in texts for p in parts if t is not None and p is not None and len(p) >= least and p in t})
    assert containment.containing(df(texts, "text").where("false"), df(parts, "part")).count() == 0


def test_what_shares_a_part_comes_once(spark):
    rng = np.random.default_rng(4)
    one, two = ([(int(rng.integers(0, 9)), f"p{rng.integers(0, 7)}") for _ in range(n)] for n in (40, 25))
    got = containment.sharing(spark.createDataFrame(one, "k int, part string"), ["k"], spark.createDataFrame(two, "o int, part string"), ["o"]).collect()
    assert sorted(map(tuple, got)) == sorted({(k, o) for k, p in one for o, q in two if p == q})


@pytest.mark.parametrize("hot", [5, 65536])
def test_top_cosines_equal_the_whole_matrix(spark, hot):
    """Texts of common and rare words: the same best five and scores as from all pairs, and less than half of the pairs."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(150)]
    topics = [rng.choice(words, 6) for _ in range(20)]
    text_ = lambda i: " ".join(["the", *rng.choice(topics[i % 20], rng.integers(2, 6)), *rng.choice(words, rng.integers(0, 2))])
    rows = [(f"a{i}", text_(i)) for i in range(60)] + [(f"b{i}", text_(i)) for i in range(200)] + [("a90", "zzzz"), ("b900", "the"), ("b901", "the"), ("a91", "")]
    w = retrieval.tfidf(spark.createDataFrame(rows, "key string, text string"), "key", "text").cache()
    left, right = w.where("key like 'a%'").withColumnRenamed("key", "a"), w.where("key like 'b%'").withColumnRenamed("key", "b")
    whole = retrieval.sparse_cosine(left, right, "a", "b").withColumn("score", F.round("score", 9))
    want = ranking.top(whole, 5, ["a"], [F.col("score").desc(), F.col("b")]).select("a", "b", "rank", "score").collect()
    got = retrieval.top_cosines(left, right, "a", "b", 5, hot=hot).select("a", "b", "rank", "score").collect()
    key = lambda rows_: sorted((r.a, r["rank"], r.b, round(r.score, 8)) for r in rows_)
    assert key(got) == key(want)
    x, y = left.select("a", "gram", F.col("weight").alias("wa")), right.select("b", "gram", F.col("weight").alias("wb"))
    pairs, every = retrieval.candidate_pairs(x, y, 5, hot=hot).count(), whole.count()
    assert pairs < every / 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)]
    nodes = spark.range(200).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in graph.connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + i] == 100 for i in range(40)) and got[150] == 150


def average_link(distance, threshold):
    """One merge of the closest two clusters after the other."""
    clusters = [[i] for i in range(len(distance))]
    mean = lambda a, b: np.mean([distance[i][j] for i in a for j in b])
    while len(clusters) > 1:
        d, i, j = min((mean(clusters[i], clusters[j]), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        if d > threshold:
            break
        clusters[i] += clusters.pop(j)
    return {i: min(c) for c in clusters for i in c}


def test_average_links(spark):
    rng = np.random.default_rng(13)
    rows, want = [], {}
    for g in range(3):
        x = rng.normal(0, 1, (14, 5)) + 3 * np.eye(5)[rng.integers(0, 5, 14)]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        want |= {(g, i): c for i, c in average_link(1 - unit @ unit.T, 0.3).items()}
        rows += [(g, i, x[i].tolist()) for i in range(14)]
    got = {(r.g, r.k): r.cluster for r in cluster.average_links(spark.createDataFrame(rows, "g int, k long, v array<double>"), "g", "k", "v", 0.3).collect()}
    assert got == want and 3 < len(set((g, c) for (g, _), c in got.items())) < 42


def density(distance: np.ndarray, least: int = 3) -> np.ndarray:
    """Cluster numbers by density, -1 for noise: the tree of mutual reachability distances is cut where clusters of `least` rows live longest.

    Core distance: to the (least - 1)-th other row. Single links over max(core, core, distance) give the hierarchy; a split counts where both sides
    have `least` rows; of a cluster and its children those with the larger sum of (1 / d) lifetimes stay. The root isn't a cluster.
    """
    n = len(distance)
    if n < least:
        return np.full(n, -1)
    core = np.sort(distance, axis=1)[:, min(least - 1, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None]), distance)
    edges = sorted((float(reach[i, j]), i, j) for i in range(n) for j in range(i + 1, n))
    parent, kids, height = list(range(n)), {}, {}
    top = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    k = 0
    for w, a, b in edges:
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        kids[n + k], height[n + k] = (top[ra], top[rb]), max(w, 1e-12)
        parent[rb] = ra
        top[ra] = n + k
        k += 1

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += kids[x]
        return out

    found: list[list[int]] = []

    def best_of(node: int, born: float, root: bool) -> tuple[float, list[list[int]]]:
        rows, lived = leaves(node), 0.0
        while True:
            if node < n:
                return lived, [rows]
            at = 1 / height[node]
            lived += len(leaves(node)) * (at - born)
            born = at
            big = [c for c in kids[node] if len(leaves(c)) >= least]
            if len(big) == 2:
                parts = [best_of(c, at, False) for c in big]
                below = sum(p[0] for p in parts)
                if root or below > lived:
                    return below, [x for p in parts for x in p[1]]
                return lived, [rows]
            if not big:
                return lived, [] if root else [rows]
            node = big[0]

    found = best_of(2 * n - 2, 0.0, True)[1] if n > 1 else []
    out = np.full(n, -1)
    for i, rows in enumerate(sorted(found, key=min)):
        out[rows] = i
    return out


def clustered(spark, rows, least):
    df = spark.createDataFrame(rows, "g int, k long, v array<double>").repartition(3)
    return {(r.g, r.k): r.cluster for r in cluster.dense(df, "g", "k", "v", least).collect()}


def reach(x):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return np.round(np.clip(1 - x @ x.T, 0, 2), 12)


@pytest.mark.parametrize("least, near, edges", [(3, 4, 40), (5, 3, 1 << 16)])
def test_density(spark, monkeypatch, least, near, edges):
    """Several groups, in blocks of a few rows and stretches of a few edges, with equal vectors, a group that is too small, and rows that can't take part."""
    for name, value in (("BLOCK", 30), ("NEAR", near), ("EDGES", edges)):
        monkeypatch.setattr(cluster, name, value)
    rng = np.random.default_rng(3)
    centres, rows, want = rng.normal(0, 1, (9, 4)), [], {}
    for g, n in enumerate((130, 90, 2)):
        x = centres[rng.integers(0, 9, n)] + rng.normal(0, 0.12, (n, 4))
        x[rng.random(n) < 0.15] += 1
        if g == 1:
            x[:10] = x[0]
        labels = density(reach(x), least)
        want |= {(g, i): None if labels[i] < 0 else int(np.flatnonzero(labels == labels[i])[0]) for i in range(n)}
        rows += [(g, i, x[i].tolist()) for i in range(n)]
    rows += [(0, 900, None), (0, 901, [1.0, None, 0.0, 0.0])]
    got = clustered(spark, rows, least)
    assert got == want | {(0, 900): None, (0, 901): None} and len(set(want.values())) > 8


def test_density_of_one_large_group(spark, monkeypatch):
    """20,000 rows of one group: the tree weighs what a direct one does, and no cluster mixes what was made apart. Edges come in five stretches."""
    monkeypatch.setattr(cluster, "EDGES", 4096)
    rng = np.random.default_rng(4)
    home = rng.integers(0, 40, 20_000)
    x = (3 * rng.normal(0, 1, (40, 8))[home] + rng.normal(0, 0.05, (20_000, 8))).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    made, trees = cluster.spanning_tree, []
    monkeypatch.setattr(cluster, "spanning_tree", lambda *a: trees.append(made(*a)) or trees[-1])
    got = clustered(spark, [(1, i, x[i].tolist()) for i in range(len(x))], 25)
    core = np.concatenate([np.partition(1 - x[i : i + 500] @ x.T, 24, axis=1)[:, 24] for i in range(0, len(x), 500)])
    inside, best, total = np.zeros(len(x), bool), np.full(len(x), np.inf), 0.0
    at = 0
    for _ in range(len(x) - 1):
        inside[at] = True
        best = np.minimum(best, np.maximum(np.maximum(core, core[at]), 1 - x @ x[at]))
        at = int(np.where(inside, np.inf, best).argmin())
        total += best[at]
    tree = trees[0].agg(F.count("*"), F.sum("w")).first()
    assert tree[0] == len(x) - 1 and abs(tree[1] - total) < 1e-6 * total
    homes = {}
    for (_, i), c in got.items():
        if c is not None:
            homes.setdefault(c, set()).add(int(home[i]))
    assert all(len(h) == 1 for h in homes.values()) and set().union(*homes.values()) == set(range(40))
    assert sum(c is not None for c in got.values()) > 10_000


names = st.sampled_from(["a", "b", "c", "d"])


@settings(max_examples=5, deadline=None)
@given(st.lists(names, min_size=1, max_size=5, unique=True), st.dictionaries(names, names, max_size=4))
def test_revert_undoes_renames(spark, slots, renames):
    before = spark.createDataFrame([("v", i, n, "extended") for i, n in enumerate(slots)], "vt_id string, slot_index int, name string, origin string")
    plan = spark.createDataFrame([("v", a, b) for a, b in renames.items()], "vt_id string, before string, after string")
    after = edits.renamed(before, plan)
    assert {r.slot_index: r.name for r in after.collect()} == {i: renames.get(n, n) for i, n in enumerate(slots)}
    back = edits.reverted(after, edits.rename_log(before, after, 1), 0)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, before.collect()))


def test_ranks_are_permutations_and_recall_grows(spark):
    rows = spark.range(40).select(F.lit("c").alias("channel"), (F.col("id") % 4).alias("q"), F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("score"))
    ranked = ranking.ranks(rows, "q", "i")
    assert [sorted(r.x) for r in ranked.groupBy("q").agg(F.collect_list("rank").alias("x")).collect()] == [list(range(1, 11))] * 4
    found = {r.k: r.recall for r in ranking.metrics(ranked, rows.where("i < 8").select("q", "i"), "q", "i").collect()}
    assert 0 <= found[1] <= found[3] <= found[5] <= found[10] == 1


def test_windowed_usage_of_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'click' as event_type, 2.0D as value union all select timestamp'2024-01-01 00:50:00', 'click', 3.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage_out").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("usage_out").collect()
    assert [(r.event_type, r.n, r.total) for r in got] == [("click", 2, 5.0)] == [(r.event_type, r.n, r.total) for r in windowed_usage(rows).collect()]


def test_numbered_places_every_row(spark):
    rows = [(i, i * 37 % 11 if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(3)
    got = ranking.numbered(df, [F.col("v").desc_nulls_last(), F.col("id")]).orderBy("place").collect()
    assert [r.id for r in got] == [i for i, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert [r.place for r in got] == list(range(1, 501))
    assert ranking.numbered(df.where("false"), [F.col("id")]).count() == 0


def test_places_within_groups_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 3 else f"g{g}", int(x), int(w)) for g, x, w in zip(rng.integers(0, 4, 400), rng.permutation(400), rng.integers(1, 4, 400))]
    df = spark.createDataFrame(rows, "g string, x int, w int").repartition(3)
    got = {r.x: r.place for r in ranking.placed(df, ["g"], [F.col("x").desc()], F.col("w")).collect()}
    for g, x, _ in rows:
        assert got[x] == sum(w for h, y, w in rows if h == g and y >= x)


def test_spread_is_exact(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        values = {g: rng.integers(0, 9, n + g).tolist() for g in (0, 1)}
        df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [(0, None)], "g int, v double").repartition(3)
        for r in summaries.spread(df, ["g"], "v").collect():
            assert (r.least, r.most, r.median) == (min(values[r.g]), max(values[r.g]), float(np.median(values[r.g]))) and abs(r["mean"] - np.mean(values[r.g])) < 1e-9


def test_small_sides_and_blocks_give_the_same_pairs(spark):
    a, b = spark.range(7), spark.range(50).select(F.col("id").alias("j"))
    assert sorted(map(tuple, joins.all_pairs(a, b, 10).collect())) == sorted(map(tuple, joins.all_pairs(a, b, 50).collect())) == [(i, j) for i in range(7) for j in range(50)]
    ranked = spark.createDataFrame([("c", 1, i, i + 1) for i in range(5)], "channel string, q int, i int, rank int")
    weights = spark.createDataFrame([(f"f{k}", "c", 1.0) for k in range(12000)], "fusion string, channel string, weight double")  # more than were once let through
    assert ranking.fused(ranked, "q", "i", weights).count() == 5 * 12000


def test_globs(spark):
    from fnmatch import fnmatch

    cases = [(n, g) for n in ("etl_a", "etl_1", "a.b", "a]b", "[x", "x*y", "axy", "!z", "a^b") for g in ("etl_[a-c]", "etl_[!a-c]", "ETL_?", "a.b", "a[.]b", "[x", "x[*]y", "*y", "[!a]z", "a^b", "a[]^]b"[:5], "etl_[ab1]")]
    df = spark.createDataFrame(cases, "n string, g string")
    for r in df.select("n", "g", F.rlike(F.col("n"), text.glob_regex(F.col("g"))).alias("x")).collect():
        assert r.x == fnmatch(r.n, r.g.lower()), r


def test_nested_lists_are_cut_and_counts_whole(spark):
    rows = [(f"a{i % 2}", f"b{i % 6}", i) for i in range(60)]
    got = {r.x: r for r in summaries.nested(spark.createDataFrame(rows, "x string, y string, leaf int"), ["x", "y"], F.struct("leaf"), "leaf", most=2).collect()}
    assert {k: (r.children, r.n) for k, r in got.items()} == {"a0": (3, 30), "a1": (3, 30)}
    assert [(n.name, n.n, [leaf.leaf for leaf in n.nodes]) for n in got["a0"].nodes] == [("b0", 10, [0, 6]), ("b2", 10, [2, 8])]
    assert summaries.nested(spark.createDataFrame([], "x string, y string, leaf int"), ["x", "y"], F.struct("leaf"), "leaf").count() == 0


def test_asked_twice_at_most(spark):
    """All outcomes, with a second answer that is missing, unreadable or recorded under other names, and bad names of base slots."""
    said = lambda *names: '{"slots": [' + ", ".join(f'{{"name": "{n}", "from": "{f}"}}' for n, f in names) + "]}"
    bad, good = ("Bad-Name", "extended"), ("good_name", "extended")
    first = {"p1": said(good), "p2": said(bad), "p3": said(bad), "p4": said(bad), "p5": "oops", "p7": said(("X", "base")), "p8": said(bad, ("c_id", "extended"), bad), "p9": said(bad)}
    second = [("p2", ["Bad-Name"], said(good)), ("p3", ["Bad-Name"], said(("o_id", "extended"))), ("p8", ["Bad-Name", "c_id"], said(good)), ("p9", ["other"], said(good)), ("p4", ["Bad-Name"], "oops")]
    rows = spark.createDataFrame([(p, i, None) for p, i, _ in second], "prompt string, issues array<string>, answer string")
    keys = {r.prompt: r.key for r in rows.select("prompt", answers.prompt_key(F.col("prompt"), F.col("issues")).alias("key")).collect()}
    ones = {r.prompt: r.key for r in spark.createDataFrame([(p,) for p in first], "prompt string").select("prompt", answers.prompt_key(F.col("prompt")).alias("key")).collect()}
    recorded = spark.createDataFrame([(ones[p], a) for p, a in first.items()] + [(keys[p], a) for p, _, a in second], "key string, answer string")
    asked = spark.createDataFrame([(f"i{i}", f"p{i}") for i in range(1, 10)], "item string, prompt string")
    got = {r.item: (r.outcome, r.names, r.warnings) for r in answers.with_feedback(asked, recorded, "item", ["c", "o", "id"]).collect()}
    assert got == {
        "i1": ("accepted", ["good_name"], []), "i2": ("corrected", ["good_name"], []), "i3": ("warned", ["o_id"], ["o_id"]), "i4": ("warned", ["Bad-Name"], ["Bad-Name"]), "i5": ("unanswered", [], []), "i6": ("unanswered", [], []),
        "i7": ("accepted", ["X"], []), "i8": ("corrected", ["good_name"], []), "i9": ("warned", ["Bad-Name"], ["Bad-Name"]),
    }


def _largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_members_of_classes_meet_block_by_block(spark):
    """One class with nearly all rows: every pair once, and no task with most of them."""
    left = spark.range(200).select((F.col("id") >= 195).cast("long").alias("_left"), F.col("id").alias("a"))
    right = spark.range(150).select((F.col("id") >= 149).cast("long").alias("_right"), F.col("id").alias("b"))
    pairs = spark.createDataFrame([(0, 0, 0.5), (1, 1, 1.0), (1, 7, 0.0)], "_left long, _right long, score double")
    out = joins.expanded(pairs, left, right, block=16)
    got = sorted((r.a, r.b, r.score) for r in out.collect())
    assert got == sorted([(a, b, 0.5) for a in range(195) for b in range(149)] + [(a, 149, 1.0) for a in range(195, 200)])
    assert _largest_share(out) < 0.6


def test_few_cells_of_very_many_pairs_are_dealt_over_more_tasks(spark, monkeypatch):
    """12 cells of up to 4,096 pairs, whose classes are literals: more tasks than there are shuffle partitions (4) put them out."""
    monkeypatch.setattr(joins, "PAIRS", 1_000)
    left, right, pairs = (spark.range(n).select(F.lit(0).cast("long").alias(c), F.col("id").alias(k)) for n, c, k in ((200, "_left", "a"), (150, "_right", "b"), (1, "_left", "_right")))
    out = joins.expanded(pairs, left, right, block=64)
    assert out.distinct().count() == out.count() == 30_000
    assert out.select(F.spark_partition_id()).distinct().count() > 4


def test_texts_with_a_common_pair_of_characters_are_not_broadcast(spark):
    texts, parts = spark.range(50).select(F.concat(F.lit("price "), F.col("id")).alias("text")), spark.createDataFrame([("price",)], "part string")
    got = containment.containing(texts, parts)
    assert got.count() == 50 and "SortMergeJoin [gram" in got._jdf.queryExecution().executedPlan().toString()


def test_covering_compares_classes_not_rows(spark):
    """The rows come straight from the join of members: no arrays are compared for each of them."""
    found = spark.range(40).select(F.col("id").alias("k"), F.explode(F.array(F.lit("x"), F.when(F.col("id") % 2 == 0, "y").otherwise("z"))).alias("part"))
    owners = spark.range(30).select(F.col("id").alias("o"), F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("w"))).alias("part"))
    got = containment.sharing(found, ["k"], owners, ["o"])
    assert sorted(map(tuple, got.collect())) == [(k, o) for k in range(40) for o in range(30)]
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_shares_are_those_of_classes(spark):
    """Random fields and names against brute force; the hot class is dealt out."""
    rng = np.random.default_rng(9)
    words = ["price", "date", "unit price", "da", "x", "key", "order key", "zz"]
    fields = [(q, str(rng.choice(words))) for q in range(60) for _ in range(rng.integers(1, 5))] + [(9, "none"), (61, "none")]
    names = [(g, str(rng.choice(words))) for g in range(40) for _ in range(rng.integers(1, 4))]
    out = retrieval.literal_shares(spark.createDataFrame(fields, "q int, field string"), spark.createDataFrame(names, "g int, name string"), "q", "g")
    want = {}
    for q in {q for q, _ in fields}:
        mine = {f for x, f in fields if x == q}
        for g in range(40):
            theirs = {n for x, n in names if x == g}
            n = sum(any(f == t or (len(t) >= 2 and (f in t or t in f)) for t in theirs) for f in mine)
            if n:
                want[q, g] = n / len(mine)
    assert {(r.q, r.g): r.score for r in out.collect()} == pytest.approx(want)
    assert "count(DISTINCT" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]


def test_nested_lists_are_whole(spark):
    rows = spark.range(4800).select(F.lit("a").alias("x"), (F.col("id") % 1200).alias("y"), F.col("id").alias("leaf"))
    (r,) = summaries.nested(rows, ["x", "y"], F.struct("leaf"), "leaf").collect()
    assert [n.name for n in r.nodes] == list(range(1200)) and [leaf.leaf for leaf in r.nodes[7].nodes] == [7, 1207, 2407, 3607]


def test_word_cosines_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    words = lambda: sorted({str(w) for w in rng.choice(list("abcdefgh"), rng.integers(1, 5))})
    q, d = [(i, words()) for i in range(30)] + [(30, ["zz"])], [(i, words()) for i in range(50)] + [(50, ["yy"])]
    got = retrieval.word_cosines(spark.createDataFrame(q, "q int, words array<string>"), spark.createDataFrame(d, "d int, words array<string>"), "q", "d", 4).collect()
    score = lambda a, b: round(len(set(a) & set(b)) / len(a) ** 0.5 / len(b) ** 0.5, 9)
    want = [(i, j, n) for i, a in q for n, (_, j) in enumerate(sorted((-score(a, b), j) for j, b in d)[:4], 1)]
    assert sorted((r.q, r.d, r["rank"]) for r in got) == sorted(want)


def test_hashed_vectors_stay_where_their_keys_are(spark):
    """One exchange, of the texts: neither n-grams nor counts are exchanged again, and texts of one key are one vector."""
    from tessera.plans.retrieving import hashed_vectors

    out = hashed_vectors(spark.createDataFrame([(1, "abc"), (1, "abc"), (2, "abc")], "k int, t string"), ["k"], "t")
    one, two = ({r.place: r.value for r in out.where(f"k = {k}").collect()} for k in (1, 2))
    assert one == pytest.approx(two) and sum(x * x for x in one.values()) == pytest.approx(1)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_allowed_references_are_one_join(spark):
    from tessera.plans import columns

    plan = columns.f17_allowed_references(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_all_pairs_deals_out_a_left_side_of_one_partition(spark):
    left, right = spark.range(100).toDF("a").coalesce(1), spark.range(60).toDF("b")
    for most in (10, 100):
        out = joins.all_pairs(left, right, most)
        assert out.distinct().count() == 6000
    assert _largest_share(out) < 0.9


def test_sharing_pairs_are_not_made_distinct(spark):
    rows = [(i, f"g{i % 2}") for i in range(60)] + [(1, "g0"), (3, None), (99, None)]
    out = joins.sharing_pairs(spark.createDataFrame(rows, "k int, g string"), "k", "g")
    sets = {i: {g for k, g in rows if k == i and g} for i in range(100)}
    assert sorted(map(tuple, out.collect())) == [(a, b) for a in range(100) for b in range(a + 1, 100) if sets[a] & sets[b]]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]


def test_labels_of_components_are_not_broadcast(spark):
    seen, edges = [], spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    keep, graph.settled = graph.settled, lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    try:
        assert {r.component for r in graph.connected(spark.range(1, 4).toDF("node"), edges).collect()} == {1}
    finally:
        graph.settled = keep
    assert not any("BroadcastHashJoin" in p for p in seen) and any("SortMergeJoin" in p for p in seen)


def test_named_questions_are_looked_up(spark, monkeypatch):
    """Questions meet topics and slots once; what they name is not scored again."""
    from tessera.plans import retrieving

    calls, plain = [], retrieval.scored_slots
    monkeypatch.setattr(retrieval, "scored_slots", lambda *a, **k: calls.append(1) or plain(*a, **k))
    retrieving.channels(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_asked_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(q, topic, j, not topic and q % 3 == 0, g, round(float(rng.random()), 1)) for q in range(12) for topic in (True, False) for j in range(1 + q % 2) for g in range(6)]
    asked = spark.createDataFrame(rows, "question long, topic boolean, j int, own boolean, label int, m double")
    topics, fields = asked.where("topic"), asked.where("not topic")
    got = {(r.question, r.label): r for r in retrieval.asked_scores(asked, "question", "label").collect()}
    assert len(got) == 72
    for name, found in [("intent", retrieval.intent(topics, fields.where("not own"), "question", "label")), ("multi_topic", retrieval.rank_sums(topics, "question", "label")), ("multi_field", retrieval.rare_fields(fields, "question", "label"))]:
        want = {(r.question, r.label): r.score for r in found.collect()}
        assert all(got[k][name] == pytest.approx(want.get(k, 0.0)) for k in got) and set(want) <= set(got)


def test_topic_metrics_exchange_ranks_once(spark):
    """Each query's wanted items come to its ranks as one row, so no item fans the ranks out before they meet what is wanted."""
    ranked = spark.createDataFrame([(c, q, t, t + 1) for c in "ab" for q in range(3) for t in range(4) if (c, q) != ("b", 2)], "channel string, question int, label int, rank int")
    queries = spark.createDataFrame([(0,), (1,), (2,)], "question int")
    tables, owned = spark.createDataFrame([(0, "x"), (0, "y"), (1, "y"), (2, "x")], "question int, item string"), spark.createDataFrame([(0, "x"), (3, "y")], "label int, item string")
    fields, named = spark.createDataFrame([(0, "f"), (2, "g")], "question int, item string"), spark.createDataFrame([(1, "f"), (1, "g")], "label int, item string")
    found = ranking.topic_metrics(ranked, queries, tables, owned, fields, named, "question", "label", (1, 4))
    assert sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found.select("channel", "k", "hit", "recall", "field_hit", "support").collect()) == [
        ("a", 1, 0.666667, 0.5, 0.0, 0.0), ("a", 4, 1.0, 1.0, 0.666667, 1.0), ("b", 1, 0.333333, 0.166667, 0.0, 0.0), ("b", 4, 0.666667, 0.666667, 0.333333, 0.666667),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 1


@pytest.mark.parametrize("most", [1, 100])
def test_edit_distances(spark, most):
    """All pairs as levenshtein gives them, with nulls, empty texts, texts beyond a machine word and characters beyond 16 bits, without a call of levenshtein for the others."""
    from tessera.operators.distances import edit_distances

    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abc é😀"), rng.integers(0, n)))
    left = spark.createDataFrame([(i, word(80)) for i in range(40)] + [(40, ""), (41, None), (42, "a" * 64), (42, "a" * 64)], "k int, t string")
    right = spark.createDataFrame([(f"p{i}", word(64)) for i in range(30)] + [("e", ""), ("n", None), ("w", "b" * 64), ("l", "b" * 65)], "k string, t string")
    got = edit_distances(left, right, most, 8, 8)
    want = left.toDF("a", "x").join(right.toDF("b", "y")).select("a", "b", F.levenshtein("x", "y").cast("long").alias("distance"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    short = edit_distances(left.where("t is not null"), right.where("length(t) <= 64"), most)
    assert "levenshtein" not in short._jdf.queryExecution().optimizedPlan().toString().lower()


def test_literal_shares_are_rounded_by_class(spark):
    """No row of the result is computed on: scores are those of pairs of classes."""
    from tessera.plans import retrieving

    found = retrieving.v5_literal_fields(spark, "/root/testdata/sf0.001")
    assert found.columns == ["question_id", "vt_id", "score"] and "round(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_add_values_in_the_order_of_the_table(spark, tmp_path):
    """Sums of doubles depend on the order of addition; the order is that of the files and their rows, as in the SQL, not that of tasks."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.plans import grouping, registry

    # In this order user 1 has 1.0, user 2 has 0.0; by files first both would have 0.0.
    files = [[(1, 1e16), (1, 1.0), (2, 1.0), (2, 1e16), (3, None)], [(1, -1e16), (1, 1.0), (2, -1e16), (3, 0.5)]]
    (tmp_path / "events.parquet").mkdir()
    for i, part in enumerate(files):
        users, values = zip(*part)
        pq.write_table(pa.table({"event_type": ["view"] * len(part), "user_id": pa.array(users, "int64"), "value": pa.array(values, "float64")}), tmp_path / "events.parquet" / f"{i}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name, f in (("w4_ranks", grouping.w4_ranks), ("a11_reciprocal_ranks", grouping.a11_reciprocal_ranks)):
        got = f(spark, str(tmp_path))
        want = con.sql(f"select {', '.join(got.columns)} from ({registry.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [r.item for r in grouping.w4_ranks(spark, str(tmp_path)).orderBy("rank").collect()] == [1, 3, 2]


def _least_reached(nodes, edges):
    found = {n: n for n in nodes}
    edges = [(a, b) for a, b in edges if a in found and b in found]
    while True:
        before = dict(found)
        for a, b in edges:
            found[a] = found[b] = min(found[a], found[b])
        if before == found:
            return found


@pytest.mark.parametrize("together", [1_000_000, 3])
def test_components_lead_pieces_together_before_rounds(spark, monkeypatch, together):
    """A long chain, random edges, loops, repeats, nulls and edges of what isn't a node; ended by one task, with no round, or by rounds."""
    rng = np.random.default_rng(3)
    chain = list(rng.permutation(400))
    edges = [(f"n{a}", f"n{b}") for a, b in zip(chain, chain[1:])] + [(f"m{a}", f"m{b}") for a, b in rng.integers(0, 90, (60, 2))]
    edges += [edges[0], ("n1", "n1"), ("m1", "gone"), ("gone", "n1"), ("alone", None), (None, "n2")]
    nodes = [f"n{i}" for i in range(400)] + [f"m{i}" for i in range(90)] + ["alone"]
    monkeypatch.setattr(graph, "TOGETHER", together)
    calls, keep = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: calls.append(1) or keep(df))
    left = spark.createDataFrame([(n,) for n in nodes], "node string")
    got = graph.connected(left, spark.createDataFrame(edges, "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == _least_reached(nodes, [e for e in edges if None not in e]) and got.count() == len(nodes)
    assert len(calls) == 2 if together > 3 else len(calls) > 3


@pytest.mark.parametrize("together", [1_000_000, 7])
def test_pieces_of_edges(monkeypatch, together):
    import pyarrow as pa

    monkeypatch.setattr(graph, "TOGETHER", together)
    rng = np.random.default_rng(4)
    for n, m in ((1, 3), (30, 20), (200, 150), (50, 400)):
        pairs = rng.integers(-n, n, (m, 2)) * 10**12
        batches = [pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 3, 0]), pa.array(pairs[i : i + 3, 1])], ["a", "b"]) for i in range(0, m, 3)]
        out = [(r["a"], r["b"]) for batch in graph._leading(iter(batches)) for r in batch.to_pylist()]
        names = {int(x) for x in pairs.ravel()}
        want = _least_reached(names, pairs.tolist())
        assert _least_reached(names, out) == want
        if together > m:
            assert dict(out) == {a: b for a, b in want.items() if a != b} and len(out) == len(dict(out))


def test_edit_distances_leave_tasks_as_lists(spark):
    """Python gives lists of a few texts' distances and keys, so keys aren't repeated for every pair; null and repeated keys stay."""
    from tessera.operators.distances import edit_distances

    left = spark.createDataFrame([(i % 7 if i % 5 else None, "abcd"[: i % 4] + str(i)) for i in range(23)], "k int, t string")
    right = spark.createDataFrame([(f"p{i % 9}" if i % 4 else None, "abce"[: i % 5]) for i in range(19)], "k string, t string")
    got = edit_distances(left, right, 100, 12, 8)
    want = left.toDF("a", "x").join(right.toDF("b", "y")).select("a", "b", F.levenshtein("x", "y").cast("long").alias("distance"))
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "posexplode" in got._jdf.queryExecution().optimizedPlan().toString()
