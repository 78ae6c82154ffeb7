"""Edits of slots, proposals, topics and categories on small tables with refusals, repeats and nulls; reports of written tables."""

from pyspark.sql import functions as F

from tessera.operators import edits, reports


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_slot_lists_are_replaced_whole_or_not_at_all(spark):
    schema = "vt_id string, slot_index int, name string, origin string, role string"
    slots = spark.createDataFrame([("a", 0, "key", "base", "key"), ("a", 1, "old", "extended", "x"), ("b", 0, "stay", "extended", "x")], schema)
    new = spark.createDataFrame([("a", 0, " key ", "base", "key"), ("a", 1, "new", "extended", "x"), ("b", 0, "", "extended", "x"), ("b", 1, "fine", "extended", "x"), ("c", 0, "first", "extended", None), ("d", 0, "x", "extended", "x"), ("e", 0, "x", "other", "x"), ("e", 1, "x", "extended", "x")], schema)
    scaffold = spark.createDataFrame([(t, 1) for t in "abce"], "vt_id string, slots int")
    library = spark.createDataFrame([("key",)], "name string")
    reviews = spark.createDataFrame([("t", "f1", "a", "take", "old"), ("t", "f2", "a", "take", "key"), ("t", "f3", "a", "skip", None), ("t", "f4", "a", "skip", " "), ("t", "f1", "b", "take", "old")], "table string, field string, vt_id string, decision string, decision_slot string")
    seeds = spark.createDataFrame([("t", "f2", "a", "new"), ("t", "f2", "a", "new"), ("t", "f9", "a", "gone"), ("t", "f1", "b", "fine"), ("u", "f5", "c", "first")], "table string, field string, vt_id string, decision_slot string")
    after, reviewed, refused = edits.slots_replaced(slots, scaffold, library, reviews, new, seeds)
    assert rows(after) == rows(spark.createDataFrame([("a", 0, "key", "base", "key"), ("a", 1, "new", "extended", "x"), ("b", 0, "stay", "extended", "x"), ("c", 0, "first", "extended", None)], schema))
    assert dict(rows(refused)) == {"b": "no name", "d": "unknown topic", "e": "repeated"}
    assert rows(reviewed.select("table", "field", "vt_id", "decision", "decision_slot")) == sorted([("t", "f2", "a", "use_slot", "new"), ("t", "f3", "a", "skip", None), ("t", "f4", "a", "skip", " "), ("t", "f1", "b", "take", "old"), ("u", "f5", "c", "use_slot", "first")], key=str)


def test_proposals(spark):
    proposals = spark.createDataFrame(
        [("p1", "n1", "l", "r", "base", "pending", None), ("p2", "n1", "l", "r", "base", "pending", None), ("p3", "n3", "l", "r", "domain", "pending", None), ("p4", "n4", "l", "r", "vt_local", "pending", None), ("p5", "n5", "l", "r", "base", "rejected", None), ("p6", "held", "l", "r", "base", "pending", None), ("p7", "n7", None, None, None, "pending", None)],
        "proposal_id string, name string, label string, role string, scope string, status string, renamed_to string",
    )
    decisions = [("p1", "accept", None, None), ("p2", "accept", None, None), ("p2", "rename", " n2 ", None), ("p3", "rename", "", None), ("p3", "accept", None, None), ("p4", "accept", None, None), ("p5", "accept", None, None), ("p6", "accept", None, None), ("p7", "accept", None, None), ("p9", "reject", None, None), ("p1", "maybe", None, None), ("p4", "reject", None, None)]
    library = spark.createDataFrame([("held", "x", "y")], "name string, label string, role string")
    after, base, domain, log = edits.proposals_applied(proposals, library, library.where("false"), spark.createDataFrame(decisions, "proposal_id string, decision string, renamed_to string, target string"))
    assert {r.proposal_id: r.status for r in after.collect()} == {"p1": "accepted", "p2": "pending", "p3": "accepted", "p4": "accepted", "p5": "rejected", "p6": "pending", "p7": "pending"}
    assert [r.name for r in base.orderBy("name").collect()] == ["held", "n1"] and [r.name for r in domain.collect()] == ["n3"]
    assert rows(log) == sorted([
        ("p1", "accept", "base", None), ("p2", "accept", None, "name taken"), ("p2", "rename", None, "decided already"), ("p3", "rename", None, "no new name"), ("p3", "accept", "domain", None), ("p4", "accept", "vt_local", None), ("p5", "accept", None, "not pending"),
        ("p6", "accept", None, "name taken"), ("p7", "accept", None, "unknown target"), ("p9", "reject", None, "missing"), ("p1", "maybe", None, "unknown decision"), ("p4", "reject", None, "decided already"),
    ], key=str)


def test_merges_and_categories(spark):
    scaffold = spark.createDataFrame([(t, "old" if t in "ab" else "other") for t in "abcd"], "vt_id string, l1 string")
    bridge = spark.createDataFrame([("a", "t1", 0), ("b", "t1", 0), ("b", "t2", 1), ("c", "t3", 0), ("d", "t4", 0)], "vt_id string, table string, ord int")
    merges = spark.createDataFrame([("a", "b", "pending"), ("b", "c", "pending"), ("d", "x", "pending"), ("c", "d", "rejected"), ("d", "d", "pending")], "primary string, absorbed string, status string")
    topics, tables, log = edits.topics_merged(scaffold, bridge, merges)
    assert [r.vt_id for r in topics.orderBy("vt_id").collect()] == ["a", "c", "d"]
    assert rows(tables) == [("a", "t1", 0), ("a", "t2", 1), ("c", "t3", 0), ("d", "t4", 0)]
    assert {(r.primary, r.absorbed): r.status for r in log.collect()} == {("a", "b"): "merged", ("b", "c"): "pending", ("d", "x"): "pending", ("c", "d"): "rejected", ("d", "d"): "pending"}
    ops = spark.createDataFrame([("rename", "old", "new"), ("rename", "other", "old"), ("delete", "other", None), ("delete", "free", None)], "action string, name string, new_name string")
    topics, categories, done = edits.categories_applied(scaffold, spark.createDataFrame([("old",), ("other",), ("free",)], "name string"), ops)
    assert {r.vt_id: r.l1 for r in topics.collect()} == {"a": "new", "b": "new", "c": "other", "d": "other"}
    assert rows(categories) == [("new",), ("other",)] and {r.name + r.action: r.error for r in done.collect()} == {"oldrename": None, "otherrename": "name taken", "otherdelete": "in use", "freedelete": None}


def test_extra_candidates(spark):
    columns = spark.createDataFrame([("t", "Ship_Day", None), ("t", "free", "the PRICE of it"), ("t", "x1", "nothing"), ("t", "taken", "seed words"), ("t", "y", "has seed words too"), ("t", "auto", None), ("u", "lone", None)], "table string, field string, comment string")
    bridge, slots = spark.createDataFrame([("v", "t"), ("v", "t"), ("w", "u")], "vt_id string, table string"), spark.createDataFrame([("v", "base", "ship", ["d"]), ("v", "extended", "cost", ["Price", None]), ("w", "base", "zz", [])], "vt_id string, origin string, name string, aliases array<string>")
    library, reviews = spark.createDataFrame([("zz", "one")], "name string, label string"), spark.createDataFrame([("t", "taken", "v", "take_top1"), ("t", "x1", "v", "skip")], "table string, field string, vt_id string, decision string")
    got = edits.extra_candidates(columns, bridge, slots, library, reviews, ["take_top1"], spark.createDataFrame([("v", "t", "auto")], "vt_id string, table string, field string"))
    assert rows(got) == [("v", "t", "x1")] and ("v", "t", "auto") in rows(edits.extra_candidates(columns, bridge, slots, library, reviews, ["take_top1"]))


def test_reports_are_gathered_by_the_write(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 7}" if i % 5 else None, "é") for i in range(100)], "i int, v string, n string")
    ask = reports.Report([("c", "small", F.col("i") < 10), ("c", "null", F.lit(None).cast("boolean"))], [("t", F.col("v"), 3)], [("s", F.col("i").cast("string"), F.col("i") > 90, 4)])
    got = reports.written(df, f"file://{tmp_path}/a", ask).collect()
    assert rows(spark.read.parquet(f"file://{tmp_path}/a")) == rows(df)
    counts = {r.v: r["count"] for r in df.where("v is not null").groupBy("v").count().collect()}
    best = [(v, n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:3]
    assert [(r.item, r.n) for r in got if r.section == "t"] == best and [(r.item, r.n, r.share) for r in got if r.section in ("all", "c")] == [("rows", 100, 1.0), ("small", 10, 0.1), ("null", 0, 0.0)]
    samples = [r.item for r in got if r.section == "s"]
    assert 0 < len(samples) <= 4 and all(90 < int(x) < 100 for x in samples) and len(set(samples)) == len(samples)
    none = reports.written(df.where("false"), f"file://{tmp_path}/b", ask).collect()
    assert [(r.section, r.item, r.n) for r in none] == [("all", "rows", 0), ("c", "small", 0), ("c", "null", 0)]
