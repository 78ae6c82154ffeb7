"""Versioned tables and steps: round trips, writers at the same time, and what runs again."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import edits, steps
from tessera.sources.versions import Change, Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(df):
    return {f for f in df.inputFiles() if ".keys/" not in f}


def test_versions_by_key(spark, store):
    first = [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    df = lambda x: spark.createDataFrame(x, "k string, n long")
    assert store.version() == 0
    assert store.commit(0, {"t": Change(df(first), "k"), "u": Change(df(first))}) == 1
    assert store.commit(1, {"t": Change(df([("b", 30), ("c", 5)]), "k")}) == 2
    assert store.commit(2, {"t": Change(df([]), "k", df([("a", 0), (None, 0)]))}) == 3
    assert [rows(store.read("t", i)) for i in (1, 2, 3)] == [sorted(first, key=str), sorted([("a", 1), ("a", 2), ("b", 30), ("c", 5), (None, 4)], key=str), [("b", 30), ("c", 5)]]
    assert rows(store.read("u")) == sorted(first, key=str)
    assert store.commit(3, {"t": Change(df([("z", 9)]))}) == 4 and rows(store.read("t")) == [("z", 9)] and rows(store.read("t", 3)) == [("b", 30), ("c", 5)]
    with pytest.raises(Conflict):
        store.commit(3, {"t": Change(df([("lost", 0)]))})
    assert rows(store.read("t")) == [("z", 9)] and store.version() == 4
    with pytest.raises(ValueError, match="no table"):
        store.read("v")


def test_writers_at_the_same_time_lose_nothing(spark, store):
    """Three writers add five rows each, one a commit; every edit is in the end table once, and every version has one row more."""
    store.commit(0, {"t": Change(spark.createDataFrame([("start", 0)], "who string, i int"))})
    failed = []

    def writer(who):
        try:
            for i in range(5):
                store.edit(lambda read: {"t": Change(read("t").unionByName(spark.createDataFrame([(who, i)], "who string, i int")).coalesce(1))}, tries=50)  # noqa: B023
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(w,)) for w in ("a", "b", "c")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.version() == 16
    assert rows(store.read("t")) == sorted([("start", 0)] + [(w, i) for w in "abc" for i in range(5)])
    assert all(store.read("t", i).count() == i for i in (1, 7, 16))


def test_one_key_is_read_and_written_alone(spark, store):
    df = spark.createDataFrame([(f"k{i % 6}", i) for i in range(60)], "k string, n int")
    store.commit(0, {"t": Change(df, "k"), "u": Change(df, "k")})
    before = files(store.read("t"))
    one = store.read("t", only=["k2"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(__part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(files(one.select("n"))) <= len(before)
    assert rows(one) == sorted(((f"k{i % 6}", i) for i in range(60) if i % 6 == 2), key=str) and store.read("t", only=["none", None]).isEmpty()
    new = one.withColumn("n", -F.col("n"))
    store.commit(1, {"t": Change(new, "k"), "u": Change(new, "k")})
    after = files(store.read("t"))
    assert before < after and len(after - before) == 1  # the replaced file stays for older versions
    for name in "tu":
        assert rows(store.read(name)) == sorted(((f"k{i % 6}", -i if i % 6 == 2 else i) for i in range(60)), key=str)


def test_rename_log_snapshot_revert(spark, store):
    """A batch of renames with its log in one commit; the version before it is the snapshot; reverting is a commit of its own."""
    slots = spark.createDataFrame([("v1", 0, "a", "extended"), ("v1", 1, "b", "extended"), ("v2", 0, "a", "base")], "vt_id string, slot_index int, name string, origin string")
    renames = spark.createDataFrame([("v1", "a", "b"), ("v1", "b", "c")], "vt_id string, before string, after string")
    store.commit(0, {"slots": Change(slots, "vt_id")})

    def rename(read):
        old = read("slots")
        new = edits.renamed(old, renames)
        return {"slots": Change(new.where("vt_id = 'v1'"), "vt_id"), "log": Change(edits.rename_log(old, new, 2))}

    assert store.edit(rename) == 2
    assert rows(store.read("slots").select("vt_id", "slot_index", "name")) == [("v1", 0, "b"), ("v1", 1, "c"), ("v2", 0, "a")]
    assert store.read("log").count() == 2
    assert store.edit(lambda read: {"slots": Change(edits.reverted(read("slots"), read("log"), 1).where("vt_id = 'v1'"), "vt_id")}) == 3
    assert rows(store.read("slots").select(*slots.columns)) == rows(store.read("slots", 1).select(*slots.columns)) == rows(slots)


def test_steps_after_a_touched_table(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    spark.range(5).write.parquet(a)
    spark.range(7).write.parquet(b)
    plan = [
        steps.Step("one", [a], lambda x: x.selectExpr("id * 2 as id")), steps.Step("two", [b], lambda x: x.selectExpr("id + 1 as id")),
        steps.Step("both", ["one", "two"], lambda x, y: x.join(y, "id")), steps.Step("last", ["both", a], lambda x, y: x.union(y)),
    ]
    run = lambda: [name for name, ran in steps.run_dirty(spark, f"file://{tmp_path}/store", plan) if ran]
    assert run() == ["one", "two", "both", "last"] and run() == []
    spark.range(9).write.mode("append").parquet(b)
    assert run() == ["two", "both", "last"] and run() == []
    spark.range(1).write.mode("overwrite").parquet(a)
    assert run() == ["one", "both", "last"]
    assert rows(Store(spark, f"file://{tmp_path}/store").read("last")) == [(0,)]
