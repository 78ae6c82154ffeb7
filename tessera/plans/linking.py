"""Queries of clusters and components (G) and of versioned edits (M)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import answers, cluster, edits, graph, joins, retrieval, steps
from tessera.operators.ranking import placed, widened
from tessera.plans import vocabularies as v
from tessera.plans.columns import _NOISE, _X13, SYLLABLES, lexical_of, noise
from tessera.plans.grouping import _RESULTS, results
from tessera.plans.matching import matched_columns
from tessera.plans.registry import ORACLES, query, read
from tessera.sources.files import settled, workspace
from tessera.sources.versions import Change, Store


def _members(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").withColumn("slot", F.col("vec_id") % 7).withColumn("topic", F.concat(F.lit("t"), F.col("label") % 3))
    return retrieval.centroids(rows, ["topic", "label", "slot"], "embedding").select("topic", (F.col("label") * 10 + F.col("slot")).cast("long").alias("key"), "centroid", "label")


@query()
def g1_average_link(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.average_links(_members(spark, sf), "topic", "key", "centroid", threshold=0.3)


@query()
def g2_density(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf)
    found = cluster.dense(members, "topic", "key", "centroid")
    tight = cluster.cohesion(found.where("cluster is not null").join(members, ["topic", "key"]), ["topic", "cluster"], "key", "centroid").where("cohesion >= 0.55")
    return found.join(tight, ["topic", "cluster"], "left").select("topic", "key", "cluster", F.round("cohesion", 6).alias("cohesion"))


_EDGES = "e as (select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey where abs(a.s_acctbal - b.s_acctbal) < 1500)"
_PARTS = "c(node, comp) as (select s_suppkey, s_suppkey from supplier union select x.b, c.comp from c join (select a, b from e union all select b, a from e) x on x.a = c.node)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs less than 1500 apart of neighbours in the order of a nation's balances: they connect what all such pairs connect. Neighbours lie in the same task, but for the ends of tasks."""
    order = [F.col("s_acctbal"), F.col("s_suppkey")]
    rows = settled(placed(read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], order))
    after = rows.select("s_nationkey", (F.col("place") - 1).alias("place"), F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("next"))
    pairs = rows.join(after.hint("merge"), ["s_nationkey", "place"]).where(F.col("next") - F.col("s_acctbal") < 1500)
    return settled(pairs).repartitionByRange("s_nationkey", "place").select(F.col("s_suppkey").alias("a"), "b")


@query(f"with recursive {_EDGES}, {_PARTS} select node, min(comp) as component from c group by 1")
def g3_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")), _edges(spark, sf), closed=True)


#: Items: the fifths of each label, with a mean vector, the files that their rows are in, and a group.
_ITEMS = """e as (select vec_id, label, vec_id % 5 as slot, list_transform(embedding, lambda x: x::double) as x from embeddings), sa as (select label, slot, i, avg(y) as y from (select label, slot, unnest(x) as y, generate_subscripts(x, 1) as i from e) group by all), sc as (select label, slot, list(y order by i) as c from sa group by all),
it as (select label * 10 + slot as item, label, slot, list_transform(c, lambda y: y / sqrt(list_sum(list_transform(c, lambda z: z * z)))) as s, files from sc join (select label, slot, list_distinct(list((label * 2 + slot + vec_id // 5 % (2 + label % 3)) % 19)) as files from e group by all) using (label, slot))"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").withColumn("slot", F.col("vec_id") % 5)
    files = rows.groupBy("label", "slot").agg(F.collect_set((F.col("label") * 2 + F.col("slot") + F.floor(F.col("vec_id") / 5) % (2 + F.col("label") % 3)) % 19).alias("files"))
    means = retrieval.centroids(rows, ["label", "slot"], "embedding").select("label", "slot", retrieval.unit(F.col("centroid")).alias("s"))
    return means.join(files, ["label", "slot"]).select((F.col("label") * 10 + F.col("slot")).alias("item"), "label", "slot", "s", "files")


@query(f"""with recursive {_ITEMS}, pp as (select a.item as a, b.item as b, round(list_sum(list_transform(list_zip(a.s, b.s), lambda z: z[1] * z[2])), 9) as sim, len(list_intersect(a.files, b.files)) / least(len(a.files), len(b.files)) as overlap from it a join it b on a.label % 4 = b.label % 4 and a.item < b.item),
ed as (select a, b from pp where sim >= 0.80 or overlap >= 0.60 or 0.6 * sim + 0.4 * overlap >= 0.65), c(node, comp) as (select item, item from it union select x.b, c.comp from c join (select a, b from ed union all select b, a from ed) x on x.a = c.node) select node, min(comp) as component from c group by 1""")
def g4_merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Items of a group that any of the three rules joins."""
    rows = _items(spark, sf).withColumn("g", F.col("label") % 4)
    pairs = joins.group_pairs(rows, ["g"], "item", ["s", "files"])
    edges = graph.triggered(pairs.select("a", "b", F.round(retrieval.dot(F.col("s_a"), F.col("s_b")), 9).alias("sim"), text.overlap(F.col("files_a"), F.col("files_b")).alias("overlap")))
    return graph.connected(rows.select(F.col("item").alias("node")), edges)


@query("select s_nationkey as component, first('s' || s_suppkey order by support desc, src <> 'cluster', coh is null, 's' || s_suppkey) as name, sum(support) as total, count(*) - 1 as n_aliases from (select *, s_suppkey % 4 as support, case when s_suppkey % 3 = 0 then 'cluster' else 'manual' end as src, nullif(s_suppkey % 2, 0) as coh from supplier) group by 1")
def g5_survivors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("component"), F.concat(F.lit("s"), k).alias("name"), (k % 4).alias("support"), F.when(k % 3 == 0, "cluster").otherwise("manual").alias("src"), F.nullif(k % 2, F.lit(0)).alias("coh"))
    return graph.survivors(rows, "component", "name", "support", "src", "coh").select("component", "name", "total", F.size("aliases").cast("long").alias("n_aliases"))


@query(f"""with {_ITEMS}, nm as (select item, slot, s, case when slot < 2 then 'n' || (label * 2 + slot) else 'n' || (label * 3 + slot + 9) end as name, case when (label + slot) % 3 = 0 then '' else 'l' || (label + slot * 5) end as label from it), nw as (select * from nm where slot < 2), ex as (select * from nm where slot >= 2),
bn as (select nw.item, min(ex.item) as found from nw join ex using (name) group by 1), bl as (select nw.item, min(ex.item) as found from nw join ex using (label) where nw.label <> '' and nw.item not in (select item from bn) group by 1),
sc2 as (select nw.item, ex.item as found, round(list_sum(list_transform(list_zip(nw.s, ex.s), lambda z: z[1] * z[2])), 9) as similarity from nw, ex where nw.item not in (select item from bn) and nw.item not in (select item from bl)), rr as (select *, row_number() over (partition by item order by similarity desc, found) as r from sc2),
tw as (select * from rr where r = 1 and similarity >= 0.85)
select item, found, 'equal name' as reason, 1.0 as similarity, true as duplicate from bn union all select item, found, 'equal label', 1.0, true from bl union all select item, found, 'near', similarity, true from tw
union all select item, found, 'similar', similarity, false from rr where r <= 3 and similarity >= 0.65 and item not in (select item from tw)""")
def g6_near_existing(spark: SparkSession, sf: str) -> DataFrame:
    label, slot = F.col("label"), F.col("slot")
    name = F.when(slot < 2, F.concat(F.lit("n"), (label * 2 + slot).cast("string"))).otherwise(F.concat(F.lit("n"), (label * 3 + slot + 9).cast("string")))
    rows = _items(spark, sf).select("item", "slot", "s", F.col("s").alias("q"), name.alias("name"), F.when((label + slot) % 3 == 0, "").otherwise(F.concat(F.lit("l"), (label + slot * 5).cast("string"))).alias("label"))
    return graph.near_existing(rows.where("slot < 2"), rows.where("slot >= 2"))


@query("select p_name, count(distinct p_type) as topics, case when count(distinct p_type) >= 3 then 'base' when count(distinct p_type) = 2 then 'domain' else 'local' end as scope from part group by 1")
def g7_scope(spark: SparkSession, sf: str) -> DataFrame:
    return graph.scope(read(spark, sf, "part"), "p_name", "p_type")


@query("select l_orderkey, l_partkey, l_discount as sim, l_linenumber as line from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_discount desc nulls last, l_linenumber) = 1")
def g8_best_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.ranking import top

    best = top(read(spark, sf, "lineitem"), 1, ["l_orderkey", "l_partkey"], [F.col("l_discount").desc_nulls_last(), F.col("l_linenumber")])
    return best.select("l_orderkey", "l_partkey", F.col("l_discount").alias("sim"), F.col("l_linenumber").alias("line"))


@query("with w as (select p_size, min(p_name) as canonical, max(p_name) as far from part group by 1 having count(*) >= 2 and count(distinct p_type) >= 2) select p_partkey, canonical, p_name <> canonical as changed, p_name = far and p_size % 3 = 0 as excluded_as_outlier from part join w using (p_size)")
def g9_rename_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Members of clusters with their common name; in every third cluster the last name is an outlier."""
    part = read(spark, sf, "part")
    names = part.groupBy("p_size").agg(F.min("p_name").alias("canonical"), F.max("p_name").alias("p_name"))
    return graph.rename_plan(part, "p_size", "p_name", "p_type", names.select("p_size", "canonical"), outliers=names.where("p_size % 3 = 0")).select("p_partkey", "canonical", "changed", "excluded_as_outlier")


_RENAMED = "rn as (select s.*, coalesce(r.after, s.name) as new_name from slots s left join renames r on s.vt_id = r.vt_id and s.name = r.before and s.origin = 'extended' and s.slot_index = (select min(x.slot_index) from slots x where x.vt_id = s.vt_id and x.name = s.name and x.origin = 'extended'))"


def _state(spark: SparkSession, sf: str | None) -> DataFrame:
    return v.SLOTS.frame(spark, sf).select("vt_id", "slot_index", "name", "origin", "role")


@query(f"with {v.SLOTS.cte()}, {v.RENAMES.cte()}, {_RENAMED} select vt_id, slot_index, new_name as name from rn")
def m1_batch_rename(spark: SparkSession, sf: str) -> DataFrame:
    return edits.renamed(_state(spark, sf), v.RENAMES.frame(spark, sf)).select("vt_id", "slot_index", "name")


@query(f"with {v.SLOTS.cte()} select vt_id, slot_index, case when vt_id like 'shelf_%' and slot_index = 2 then 'second' when vt_id like 'shelf_%' and slot_index = 1 then 'by_name' when vt_id = 'vt_text' and slot_index = 2 then 'tongue' else name end as name from slots")
def m1_exact_rename(spark: SparkSession, sf: str) -> DataFrame:
    """Renames that say which slot they take: of two slots of one name the named one, whatever its name, before those that go by name; slots of the library stay."""
    state = _state(spark, sf)
    shelves = state.where("vt_id like 'shelf_%'").select("vt_id").distinct()
    one = lambda before, after, at: F.struct(F.lit(before).alias("before"), F.lit(after).alias("after"), F.lit(at).cast("int").alias("slot_index"))
    asked = shelves.select("vt_id", F.explode(F.array(one("shelf_price", "second", 2), one("shelf_date", "by_name", None), one("order_key", "never", 0), one("nothing", "never", 9))).alias("r")).select("vt_id", "r.*")
    asked = asked.unionByName(spark.createDataFrame([("vt_text", "label", "tongue", 2)], "vt_id string, before string, after string, slot_index int"))
    return edits.renamed(state, asked).select("vt_id", "slot_index", "name")


@query(f"with {_X13}, {_RESULTS}, {v.RENAMES.cte()} select \"table\", field, vt_id, coalesce(after, slot) as slot from results left join renames using (vt_id) where before = slot or before is null union all select \"table\", field, vt_id, slot from results where vt_id in (select vt_id from renames) and slot not in (select before from renames n where n.vt_id = results.vt_id)")
def m1_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return edits.cascaded(results(spark, sf).select("table", "field", "vt_id", "slot"), v.RENAMES.frame(spark, sf), ["slot"]).select("table", "field", "vt_id", "slot")


_FIVE = ["selected_slot", "top1_slot", "top2_slot", "top3_slot", "suggested_slot"]
_MATCHED = f"select \"table\", field, vt_id, case when status = 'auto' then top1_slot end as selected_slot, top1_slot, top2_slot, top3_slot, case when status = 'conflict' then top2_slot end as suggested_slot from ({ORACLES['matched_columns']})"
_AFTER = "coalesce((select min(after) from renames r where r.vt_id = x.vt_id and r.before = x.{0}), x.{0})"
_TOUCHED = "exists (select 1 from renames r where r.vt_id = x.vt_id and r.before in ({}))"


@query(f"""with x as ({_MATCHED}), {v.SLOTS.cte()}, {v.RENAMES.cte()}, {v.REVIEWS.cte()}, {_RENAMED}, lg as (select r.vt_id, r.before, r.after, coalesce(rn.slot_index, -1) as slot_index from renames r left join rn on rn.vt_id = r.vt_id and rn.name = r.before and rn.new_name = r.after and rn.name <> rn.new_name)
select 'slots' as part, vt_id, vt_id || '.' || slot_index as item, new_name as value from rn union all select 'reviews', vt_id, "table" || '.' || field, {_AFTER.format('decision_slot')} from reviews x union all select 'log', vt_id, before || '>' || after, slot_index::varchar from lg
union all select 'results', vt_id, "table" || '.' || field, concat_ws(',', {', '.join(f"coalesce({_AFTER.format(c)}, '-')" for c in _FIVE)}) from x
union all select 'results before', vt_id, "table" || '.' || field, concat_ws(',', {', '.join(f"coalesce({c}, '-')" for c in _FIVE)}) from x where {_TOUCHED.format(', '.join('x.' + c for c in _FIVE))}
union all select 'reviews before', vt_id, "table" || '.' || field, decision_slot from reviews x where {_TOUCHED.format('x.decision_slot')}
union all select 'tallies', null, 'slots', (select count(*) from rn where name <> new_name)::varchar union all select 'tallies', null, 'results', (select count(*) from x where {_TOUCHED.format(', '.join('x.' + c for c in _FIVE))})::varchar union all select 'tallies', null, 'reviews', (select count(*) from reviews x where {_TOUCHED.format('x.decision_slot')})::varchar""")
def m1_whole_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """One batch of renames through slots, five result columns and reviews, with its log, what was there before, and how much was touched."""
    found = settled(matched_columns(spark, sf))
    found = found.select("table", "field", "vt_id", F.when(F.col("status") == "auto", F.col("top1_slot")).alias("selected_slot"), "top1_slot", "top2_slot", "top3_slot", F.when(F.col("status") == "conflict", F.col("top2_slot")).alias("suggested_slot"))
    done = edits.cascade(_state(spark, sf), found, v.REVIEWS.frame(spark, sf), v.RENAMES.frame(spark, sf), 1, _FIVE)
    column, five = F.concat_ws(".", "table", "field"), F.concat_ws(",", *[F.coalesce(c, F.lit("-")) for c in _FIVE])
    parts = {
        "slots": (F.concat_ws(".", "vt_id", "slot_index"), F.col("name")), "results": (column, five), "reviews": (column, F.col("decision_slot")), "log": (F.concat_ws(">", "before", "after"), F.col("slot_index").cast("string")), "results_before": (column, five),
        "reviews_before": (column, F.col("decision_slot")), "tallies": (F.col("what"), F.col("n").cast("string")),
    }
    out = None
    for name, (item, value) in parts.items():
        rows = done[name].select(F.lit(name.replace("_", " ")).alias("part"), F.lit(None).cast("string").alias("vt_id") if name == "tallies" else F.col("vt_id"), item.alias("item"), value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {v.SLOTS.cte()} select vt_id, slot_index, case when vt_id = 'vt_text' and name = 'label' and origin = 'extended' then 'label_text' else name end as name, case when vt_id = 'vt_text' and name = 'label' then 'base' else origin end as origin from slots")
def m2_promote(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.createDataFrame([("vt_text", "label", "label_text")], "vt_id string, name string, base_name string")
    return edits.promoted(_state(spark, sf), v.LIBRARY.frame(spark), members)[0].select("vt_id", "slot_index", "name", "origin")


@query(f"with {v.SLOTS.cte()}, {v.LIBRARY.cte()} select name, role, label from library union all select 'label_text', 'display', null union all select 'day_of_shelf', min(role), null from slots where name = 'shelf_date'")
def m2_library(spark: SparkSession, sf: str) -> DataFrame:
    """The library's side of a promotion: base names that it lacks join it, once."""
    shelf = _state(spark, sf).where("name = 'shelf_date'").select("vt_id", "name", F.lit("day_of_shelf").alias("base_name"))
    members = spark.createDataFrame([("vt_text", "label", "label_text"), ("vt_sales", "ship_date", "order_date")], "vt_id string, name string, base_name string").unionByName(shelf)
    return edits.promoted(_state(spark, sf), v.LIBRARY.frame(spark), members)[1].select("name", "role", "label")


@query(f"with {v.BRIDGE.cte()} select vt_id, \"table\" from bridge union select 'vt_sales', r_name from region")
def m3_idempotent_add(spark: SparkSession, sf: str) -> DataFrame:
    new, base = read(spark, sf, "region").select(F.lit("vt_sales").alias("vt_id"), F.col("r_name").alias("table")), v.BRIDGE.frame(spark, sf).select("vt_id", "table")
    once = edits.added(base, new, ["vt_id", "table"])
    return edits.added(once, new, ["vt_id", "table"])


@query(f"with {v.SLOTS.cte()}, {v.RENAMES.cte()} select vt_id, slot_index, name, 3 as version from slots where vt_id in (select vt_id from renames)")
def m4_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return edits.snapshot(_state(spark, sf), v.RENAMES.frame(spark, sf), ["vt_id"], 3).select("vt_id", "slot_index", "name", "version")


@query(f"with {v.SLOTS.cte()} select vt_id, slot_index, name from slots")
def m5_revert_renames(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of renames, then back to the start: the rows are those before."""
    before = _state(spark, sf)
    one = edits.renamed(before, v.RENAMES.frame(spark, sf))
    second = spark.createDataFrame([("vt_sales", "net_price", "gross"), ("vt_text", "language", "label2")], "vt_id string, before string, after string")
    two = edits.renamed(one, second)
    log = edits.rename_log(before, one, 1).unionByName(edits.rename_log(one, two, 2))
    return edits.reverted(two, log, 0).select("vt_id", "slot_index", "name")


@query("select n_nationkey, n_name, n_regionkey from nation")
def m6_revert_structure(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation")
    shot = edits.snapshot(nation, nation.where("n_regionkey = 1").select("n_nationkey"), ["n_nationkey"], 1)
    changed = edits.removed(nation, nation.where("n_regionkey = 1 and n_nationkey % 2 = 0"), ["n_nationkey"]).withColumn("n_name", F.when(F.col("n_regionkey") == 1, "gone").otherwise(F.col("n_name")))
    return edits.restored(changed, shot, ["n_nationkey"], 0)


@query("select n_nationkey, case when n_regionkey = 2 then lower(n_name) else n_name end as n_name from nation")
def m8_upsert(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return edits.upsert(n, n.where("n_regionkey = 2").withColumn("n_name", F.lower("n_name")), ["n_nationkey"]).select("n_nationkey", "n_name")


@query("select n_nationkey from nation where n_regionkey <> 3")
def m9_undo(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    return edits.removed(n, n.where("n_regionkey = 3"), ["n_nationkey"]).select("n_nationkey")


_SYNC = "st as (select s_nationkey as vt_id, s_suppkey as k, case when s_suppkey % 3 = 0 then 'manual' else 'seed' end as source from supplier)"


@query(f"with {_SYNC} select vt_id, k, source from st where vt_id >= 10 or source = 'manual' union all select vt_id, k, 'seed' from st where vt_id < 10 and source <> 'manual' and k % 2 = 0 union all select 5, 100000, 'seed'")
def m10_seed_sync(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    state = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("vt_id"), k.alias("k"), F.when(k % 3 == 0, "manual").otherwise("seed").alias("source"))
    seeds = state.where("vt_id < 10 and k % 2 = 0").withColumn("source", F.lit("seed")).unionByName(spark.createDataFrame([(5, 100000, "seed")], "vt_id int, k long, source string"))
    return edits.synced(state, seeds, spark.range(10).select(F.col("id").cast("int").alias("vt_id")), ["vt_id", "k"])


@query(f"with {v.SLOTS.cte()}, {v.LIBRARY.cte()}, t as (select distinct vt_id from slots) select vt_id, name from t, library union select vt_id, name from slots where origin = 'extended'")
def m11_manual_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Every topic gets the library's slots anew; its extended ones that these lack are put behind them."""
    state = _state(spark, sf)
    made = state.select("vt_id").distinct().join(F.broadcast(v.LIBRARY.frame(spark).select("name")))  # seven written rows
    return edits.added(made, state.where("origin = 'extended'").select("vt_id", "name"), ["vt_id", "name"])


@query(f"""with {_X13}, {_RESULTS}, {v.REVIEWS.cte()}, m as (select r.vt_id, r.slot, r."table", r.field, min(case when length(r.field) % 2 = 0 then c.comment end) as comment from results r join catalog c using ("table", field) where length(r.field) % 3 > 0 group by all),
w as (select r.vt_id, r.decision_slot as slot, r."table", r.field, min(c.comment) as comment from reviews r left join catalog c using ("table", field) where decision_slot is not null group by all),
n as (select w.*, vt_id in (select vt_id from slots) as topic, (vt_id, slot) in (select vt_id, name from slots) as there from w), g as (select * from n where there)
select vt_id, slot, "table", field, case when m.there is null then g.comment when trim(coalesce(m.comment, '')) = '' and g.comment is not null then g.comment else m.comment end as comment,
case when m.there is null then 'added' when g.there is null then 'kept' when trim(coalesce(m.comment, '')) = '' and g.comment is not null then 'filled' else 'same' end as outcome from (select *, true as there from m) m full join g using (vt_id, slot, "table", field)
union all select vt_id, slot, "table", field, comment, case when topic then 'missing slot' else 'missing topic' end from n where not there""")
def m12_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed columns put into the mapped columns of their slots, with what became of each."""
    catalog = v.CATALOG.frame(spark, sf).select("table", "field", F.col("comment").alias("said"))
    best = results(spark, sf).where(F.length("field") % 3 > 0).join(catalog, ["table", "field"])
    mapped = best.select("vt_id", "slot", "table", "field", F.when(F.length("field") % 2 == 0, F.col("said")).alias("comment"))
    reviewed = v.REVIEWS.frame(spark, sf).where("decision_slot is not null").join(catalog, ["table", "field"], "left").select("vt_id", F.col("decision_slot").alias("slot"), "table", "field", F.col("said").alias("comment"))
    return edits.backfilled(mapped, reviewed, v.SLOTS.frame(spark, sf).select("vt_id", "name"))


@query(f"""with {v.SCAFFOLD.cte()}, {v.BRIDGE.cte()}, {v.MERGES.cte()}, mg as (select *, 'pending' as status from merges union all select 'shelf_' || (shelf - 1), 'shelf_' || shelf, case when shelf % 4 = 1 then 'pending' else 'rejected' end from (select distinct p_partkey // 20 as shelf from part) where shelf % 2 = 1 union all select 'vt_sales', 'vt_gone', 'pending'),
dn as (select * from mg where status = 'pending' and absorbed <> 'vt_gone'), mv as (select coalesce("primary", vt_id) as vt_id, "table", "primary" is not null as late, vt_id as was, ord from bridge left join (select "primary", absorbed from dn) d on absorbed = vt_id),
bt as (select vt_id, "table", row_number() over (partition by vt_id order by late, was, ord, "table") - 1 as ord from (select distinct on (vt_id, "table") * from mv order by vt_id, "table", late, was, ord))
select 'topic' as part, vt_id, topic as value from scaffold where vt_id not in (select absorbed from dn) union all select 'table', vt_id, ord || ' ' || "table" from bt union all select 'merge', "primary" || '<' || absorbed, case when status = 'pending' and absorbed <> 'vt_gone' then 'merged' else status end from mg""")
def m13_merged_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Pending merges take the absorbed topics away, put their tables behind the primary's and are merged; rejected ones and one of a topic that isn't there stay."""
    shelves = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("shelf")).distinct().where("shelf % 2 = 1")
    name = lambda x: F.concat(F.lit("shelf_"), x.cast("string"))
    merges = v.MERGES.frame(spark).withColumn("status", F.lit("pending")).unionByName(spark.createDataFrame([("vt_sales", "vt_gone", "pending")], "primary string, absorbed string, status string"))
    merges = merges.unionByName(shelves.select(name(F.col("shelf") - 1).alias("primary"), name(F.col("shelf")).alias("absorbed"), F.when(F.col("shelf") % 4 == 1, "pending").otherwise("rejected").alias("status")))
    topics, tables, log = edits.topics_merged(v.SCAFFOLD.frame(spark, sf), v.BRIDGE.frame(spark, sf), merges)
    out = topics.select(F.lit("topic").alias("part"), "vt_id", F.col("topic").alias("value")).unionByName(tables.select(F.lit("table").alias("part"), "vt_id", F.concat_ws(" ", "ord", "table").alias("value")))
    return out.unionByName(log.select(F.lit("merge").alias("part"), F.concat_ws("<", "primary", "absorbed").alias("vt_id"), F.col("status").alias("value")))


@query(f"with {v.SCAFFOLD.cte()} select vt_id, case l1 when 'sales' then 'commerce' else l1 end as l1, l2 from scaffold")
def m14_category_rename(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.SCAFFOLD.frame(spark, sf).withColumn("l2_path", F.array("l1", "l2"))
    return edits.category_renamed(rows, 1, "sales", "commerce").select("vt_id", F.get("l2_path", F.lit(0)).alias("l1"), F.get("l2_path", F.lit(1)).alias("l2"))


@query(f"with {v.SCAFFOLD.cte()} select * from (values ('rename', 'sales', 'commerce', null), ('rename', 'sales', 'stock', 'name taken'), ('rename', 'nothing', 'x', 'missing'), ('rename', 'content', 'content', 'no new name'), ('delete', 'stock', null, 'in use'), ('delete', 'spare', null, null)) v(action, name, new_name, error) where exists (select 1 from scaffold)")
def m14_category_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Renames and deletes of categories, with the reason where one is refused; spare is a category without topics."""
    topics = v.SCAFFOLD.frame(spark, sf)
    categories = topics.select(F.col("l1").alias("name")).distinct().unionByName(spark.createDataFrame([("spare",)], "name string"))
    ops = spark.createDataFrame([("rename", "sales", "commerce"), ("rename", "sales", "stock"), ("rename", "nothing", "x"), ("rename", "content", "content"), ("delete", "stock", None), ("delete", "spare", None)], "action string, name string, new_name string")
    return edits.categories_edited(topics, categories, ops)


@query(f"""with {v.SCAFFOLD.cte()} select 'topic' as part, vt_id as item, case l1 when 'sales' then 'commerce' else l1 end as value from scaffold union all select distinct 'category', case l1 when 'sales' then 'commerce' else l1 end, null from scaffold
union all select 'refused', action || ' ' || name, error from (values ('rename', 'content', 'name taken'), ('rename', 'nothing', 'missing'), ('delete', 'stock', 'in use')) v(action, name, error)""")
def m14_categories_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted edits of categories take effect in the categories and in their topics; spare has no topics and goes."""
    topics = v.SCAFFOLD.frame(spark, sf)
    categories = topics.select(F.col("l1").alias("name")).distinct().unionByName(spark.createDataFrame([("spare",)], "name string"))
    ops = spark.createDataFrame([("rename", "sales", "commerce"), ("rename", "content", "stock"), ("rename", "nothing", "x"), ("delete", "stock", None), ("delete", "spare", None)], "action string, name string, new_name string")
    topics, categories, done = edits.categories_applied(topics, categories, ops)
    out = topics.select(F.lit("topic").alias("part"), F.col("vt_id").alias("item"), F.col("l1").alias("value")).unionByName(categories.select(F.lit("category").alias("part"), F.col("name").alias("item"), F.lit(None).cast("string").alias("value")))
    return out.unionByName(done.where("error is not null").select(F.lit("refused").alias("part"), F.concat_ws(" ", "action", "name").alias("item"), F.col("error").alias("value")))


#: Every other shelf has a rule of its own.
_SHELVES = "sh as (select distinct p_partkey // 20 as s from part), rl as (select kind, value, table_en from noise_rules union all select 'glob', 'shelf_' || s || '_*', null from sh where s % 2 = 0)"


def _rules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(shelves (s, value), rules)."""
    shelves = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("s")).distinct().select("s", F.concat(F.lit("shelf_"), F.col("s").cast("string"), F.lit("_*")).alias("value"))
    own = shelves.where("s % 2 = 0").select(F.lit("glob").alias("kind"), "value", F.lit(None).cast("string").alias("table_en"))
    return shelves, v.NOISE_RULES.frame(spark).select("kind", "value", "table_en").unionByName(own)


@query(f"with {v.NOISE_RULES.cte()}, {_SHELVES} select kind, value from rl union select 'glob', 'tmp_*' union select 'glob', 'shelf_' || s || '_*' from sh")
def m15_rule_list(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of all shelves are added to the list; what is there already isn't added again."""
    shelves, rules = _rules(spark, sf)
    new = spark.createDataFrame([("glob", "tmp_*"), ("glob", "etl_*"), ("exact", "row_id")], "kind string, value string").unionByName(shelves.select(F.lit("glob").alias("kind"), "value"))
    return edits.added(rules.select("kind", "value"), new, ["kind", "value"])


@query(f"""with {v.NOISE_RULES.cte()}, {_SHELVES}, ok as (select kind, value, table_en from noise_rules where value <> 'etl_*' union all select 'glob', 'tmp_*', null union all select 'pair', 'props', 'orders' union all select 'glob', 'shelf_' || s || '_*', null from sh where s % 4 <> 0)
select 'rule' as part, kind, value, table_en, null as error from ok union all select 'refused', * from (values ('glob', '*_bak', null, 'there already'), ('regex', 'x', null, 'unknown kind'), ('exact', '', null, 'no value'), ('pair', 'props', null, 'no table'), ('exact', 'nowhere', null, 'missing')) w(kind, value, table_en, error)
union all select 'refused', 'glob', 'shelf_' || s || '_*', null, 'there already' from sh where s % 2 = 0""")
def m15_rule_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Rules added and removed under checks, for all shelves too: half of those are there already, a quarter goes."""
    shelves, rules = _rules(spark, sf)
    ops = [("add", "glob", "tmp_*", None), ("add", "glob", "*_bak", None), ("add", "regex", "x", None), ("add", "exact", "", None), ("add", "pair", "props", None), ("add", "pair", "props", "orders"), ("remove", "glob", "etl_*", None), ("remove", "exact", "nowhere", None)]
    of_shelves = lambda action, rows: rows.select(F.lit(action).alias("action"), F.lit("glob").alias("kind"), "value", F.lit(None).cast("string").alias("table_en"))
    ops = spark.createDataFrame(ops, "action string, kind string, value string, table_en string").unionByName(of_shelves("add", shelves)).unionByName(of_shelves("remove", shelves.where("s % 4 = 0")))
    rules, done = edits.rules_edited(rules, ops)
    return rules.select(F.lit("rule").alias("part"), "kind", "value", "table_en", F.lit(None).cast("string").alias("error")).unionByName(done.where("error is not null").select(F.lit("refused").alias("part"), "kind", "value", "table_en", "error"))


@query(f"with {_X13}, {_RESULTS}, b as (select \"table\", field, vt_id, slot from results) select a.\"table\", a.field, a.vt_id, a.slot, string_agg(b.field, ',' order by b.field) as aliases from b a join b on a.vt_id = b.vt_id and a.slot = b.slot and (a.\"table\", a.field) <> (b.\"table\", b.field) group by all")
def m16_anchors(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf).select("table", "field", "vt_id", "slot").withColumn("aliases", F.array().cast("array<string>"))
    return edits.anchored(rows, rows, ["table", "field"]).where(F.size("aliases") > 0).withColumn("aliases", F.array_join(F.array_sort("aliases"), ","))


@query(f"with {_X13}, {_RESULTS}, {v.REVIEWS.cte()} select \"table\", field, vt_id, case when decision in ('noise', 'skip') then null else coalesce(decision_slot, slot) end as slot, case when decision like 'take_%' then 'manual' when decision = 'new_slot' then 'manual_new' when decision in ('noise', 'skip') then decision else 'auto' end as status from results left join reviews using (\"table\", field, vt_id)")
def m17_review_override(spark: SparkSession, sf: str) -> DataFrame:
    rows = results(spark, sf).withColumn("status", F.lit("auto"))
    return edits.decided(rows, v.REVIEWS.frame(spark, sf), ["table", "field", "vt_id"]).select("table", "field", "vt_id", "slot", "status")


@query(f"with {v.SLOTS.cte()}, {v.LIBRARY.cte()}, s as (select *, count(*) over (partition by vt_id, name) as times from slots) select vt_id, slot_index, case when times > 1 then 'repeated' when origin = 'base' and name not in (select name from library where name <> 'text') then 'unknown base' end as error from s where times > 1 or (origin = 'base' and name not in (select name from library where name <> 'text'))")
def m18_replace_check(spark: SparkSession, sf: str) -> DataFrame:
    return edits.slot_errors(_state(spark, sf), v.LIBRARY.frame(spark).where("name <> 'text'"))


@query(f"""with {v.SLOTS.cte()}, {v.REVIEWS.cte()}, st as (select * from slots where vt_id not in (select 'shelf_' || shelf from (select distinct p_partkey // 20 as shelf from part) where shelf % 8 = 0)), sh as (select distinct p_partkey // 20 as shelf from part),
bad as (select 'shelf_' || shelf as vt_id, case shelf % 4 when 1 then 'repeated' when 2 then 'unknown base' end as error from sh where shelf % 4 in (1, 2) union all select 'vt_nowhere', 'unknown topic'), ok as (select 'shelf_' || shelf as vt_id from sh where shelf % 4 = 0)
select 'slot' as part, vt_id, slot_index || ' ' || name as item, origin as value from st where vt_id not in (select vt_id from ok) union all select 'slot', vt_id, '0 order_key', 'base' from ok union all select 'slot', vt_id, '1 stock_day', 'extended' from ok union all select 'refused', vt_id, null, error from bad
union all select 'review', vt_id, "table" || '.' || field, coalesce(decision_slot, '-') from reviews r where not (vt_id in (select vt_id from ok) and (coalesce(decision_slot, 'order_key') <> 'order_key' or field like '%date')) union all select 'review', 'shelf_' || (p_partkey // 20), "table" || '.' || field, 'stock_day'
from (select 't' || (p_partkey // 20) as "table", split_part(p_name, ' ', 1) || '_' || (p_partkey % 20) || '_date' as field, p_partkey from part where p_size % 5 = 1 and p_partkey // 20 % 4 = 0)""")
def m18_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """New slot lists of shelves: some are refused whole, some belong to topics without slots so far; reviews of slots that are gone go, and date columns are sown."""
    shelves = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("shelf")).distinct()
    name = F.concat(F.lit("shelf_"), F.col("shelf").cast("string"))
    slots = edits.removed(_state(spark, sf), shelves.where("shelf % 8 = 0").select(name.alias("vt_id")), ["vt_id"])
    row = lambda at, name_, origin: F.struct(F.lit(at).alias("slot_index"), name_.alias("name"), F.lit(origin).alias("origin"), F.lit("key").alias("role"))
    second = F.when(F.col("shelf") % 4 == 1, " order_key").otherwise("stock_day ")
    first = F.when(F.col("shelf") % 4 == 2, "order_number").otherwise("order_key")
    new = shelves.where("shelf % 4 < 3").select(name.alias("vt_id"), F.explode(F.array(row(0, first, "base"), row(1, second, "extended"))).alias("s")).select("vt_id", "s.*")
    new = new.unionByName(spark.createDataFrame([("vt_nowhere", 0, "x", "extended", "key")], "vt_id string, slot_index int, name string, origin string, role string"))
    dates = v.CATALOG.frame(spark, sf).where("field like '%date' and `table` like 't%'").select("table", "field", F.concat(F.lit("shelf_"), F.substring("table", 2, 20)).alias("vt_id"), F.lit("stock_day").alias("decision_slot"))
    library = v.LIBRARY.frame(spark)
    slots, reviews, refused = edits.slots_replaced(slots, v.SCAFFOLD.frame(spark, sf), library, v.REVIEWS.frame(spark, sf), new, dates)
    out = slots.select(F.lit("slot").alias("part"), "vt_id", F.concat_ws(" ", "slot_index", "name").alias("item"), F.col("origin").alias("value")).unionByName(refused.select(F.lit("refused").alias("part"), "vt_id", F.lit(None).cast("string").alias("item"), F.col("error").alias("value")))
    return out.unionByName(reviews.select(F.lit("review").alias("part"), "vt_id", F.concat_ws(".", "table", "field").alias("item"), F.coalesce("decision_slot", F.lit("-")).alias("value")))


@query(f"with {v.SCAFFOLD.cte()} select vt_id, topic from scaffold where vt_id <> 'vt_click' union all select 'vt_new', 'parts'")
def m19_topic_edits(spark: SparkSession, sf: str) -> DataFrame:
    base = v.SCAFFOLD.frame(spark, sf).select("vt_id", "topic")
    new = spark.createDataFrame([("vt_new", "parts")], "vt_id string, topic string")
    return edits.removed(edits.upsert(base, new, ["vt_id"]), base.where("vt_id = 'vt_click'"), ["vt_id"])


@query(f"""with {v.SCAFFOLD.cte()}, a as (select action, vt_id, error, before, after from (values ('create', 'vt_new', null, null, 'parts/fact/stock/-'), ('create', 'vt_sales', 'there already', null, null), ('create', 'vt_b', 'unknown type', null, null), ('create', 'vt_c', 'no topic', null, null), ('create', 'vt_d', 'no path', null, null),
  ('edit', 'vt_click', null, 'activity/fact/activity/events', 'clicks/fact/activity/events'), ('edit', 'vt_gone', 'missing', null, null), ('delete', 'vt_text', null, 'content/entity/content/texts', null)) v(action, vt_id, error, before, after))
select 'topic' as part, vt_id, topic || '/' || table_type || '/' || l1 || '/' || coalesce(l2, '-') as now, null as error, null as was from (select vt_id, case vt_id when 'vt_click' then 'clicks' else topic end as topic, table_type, l1, l2 from scaffold where vt_id <> 'vt_text' union all select 'vt_new', 'parts', 'fact', 'stock', null)
union all select action, vt_id, after, error, before from a union all select 'edit', vt_id, topic || ' (seen)/' || table_type || '/' || l1 || '/' || l2, null, topic || '/' || table_type || '/' || l1 || '/' || l2 from scaffold where l2 = 'aisle 9'""".replace("case vt_id when 'vt_click' then 'clicks' else topic end as topic", "case when vt_id = 'vt_click' then 'clicks' when l2 = 'aisle 9' then topic || ' (seen)' else topic end as topic"))
def m19_topic_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Topics created, edited and deleted under checks, with an audit row for each try; all topics of one aisle are edited too."""
    topics = v.SCAFFOLD.frame(spark, sf)
    ops = [
        ("create", "vt_new", "parts", "fact", "stock"), ("create", "vt_sales", "x", "fact", "y"), ("create", "vt_b", "x", "table", "y"), ("create", "vt_c", " ", "fact", "y"), ("create", "vt_d", "x", "fact", None), ("edit", "vt_click", "clicks", None, None),
        ("edit", "vt_gone", "x", None, None), ("delete", "vt_text", None, None, None),
    ]
    more = topics.where("l2 = 'aisle 9'").select(F.lit("edit").alias("action"), "vt_id", F.concat("topic", F.lit(" (seen)")).alias("topic"), F.lit(None).cast("string").alias("table_type"), F.lit(None).cast("string").alias("l1"))
    asked = spark.createDataFrame(ops, "action string, vt_id string, topic string, table_type string, l1 string").unionByName(more).withColumn("l2", F.lit(None).cast("string"))
    now, audit = edits.topics_edited(topics, asked)
    none = F.lit(None).cast("string")
    state = now.select(F.lit("topic").alias("part"), "vt_id", F.concat_ws("/", "topic", "table_type", "l1", F.coalesce("l2", F.lit("-"))).alias("now"), none.alias("error"), none.alias("was"))
    return state.unionByName(audit.select(F.col("action").alias("part"), "vt_id", F.col("after").alias("now"), "error", F.col("before").alias("was")))


@query(f"""with {v.LIBRARY.cte()}, {v.SLOTS.cte()} select 'library' as part, name, role, case name when 'quantity' then 'pieces' else label end as label, null as error from library union all select 'library', 'unit', 'measure', 'unit', null
union all select * from (values ('create', 'unit', 'measure', 'unit', null), ('create', '1st', 'key', 'first', 'bad name'), ('create', 'name', 'display', 'n', 'there already'), ('create', 'colour', null, 'colour', 'no role'), ('create', 'shade', 'display', '', 'no label'), ('alias', 'quantity', null, 'pieces', null), ('alias', 'nothing', null, 'x', 'missing'), ('delete', 'order_key', null, null, 'in use')) v(part, name, role, label, error) where exists (select 1 from slots)""")
def m20_library_edits(spark: SparkSession, sf: str) -> DataFrame:
    ops = [("create", "unit", "measure", "unit"), ("create", "1st", "key", "first"), ("create", "name", "display", "n"), ("create", "colour", None, "colour"), ("create", "shade", "display", ""), ("alias", "quantity", None, "pieces"), ("alias", "nothing", None, "x"), ("delete", "order_key", None, None)]
    library, done = edits.library_edited(v.LIBRARY.frame(spark), _state(spark, sf), spark.createDataFrame(ops, "action string, name string, role string, label string"))
    return library.select(F.lit("library").alias("part"), "name", "role", "label", F.lit(None).cast("string").alias("error")).unionByName(done.select(F.col("action").alias("part"), "name", "role", "label", "error"))


@query(f"with {v.LIBRARY.cte()}, {v.SLOTS.cte()} select name, name in (select name from slots where origin = 'base') as in_use from library")
def m20_library_references(spark: SparkSession, sf: str) -> DataFrame:
    used = _state(spark, sf).where("origin = 'base'").select("name").distinct().withColumn("in_use", F.lit(True))
    return v.LIBRARY.frame(spark).join(used, "name", "left").select("name", F.coalesce("in_use", F.lit(False)).alias("in_use"))


@query("select p_partkey, case when p_size < 25 then case when p_size % 2 = 0 then 'accepted' else 'rejected' end else 'pending' end as state from part")
def m21_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Only pending proposals change; a decision that comes twice changes nothing."""
    part = read(spark, sf, "part")
    state = part.select("p_partkey", F.lit("pending").alias("state"))
    decisions = part.where("p_size < 25").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "accepted").otherwise("rejected").alias("state"))
    pending = state.where("state = 'pending'").join(decisions.select("p_partkey"), "p_partkey", "left_semi")
    return edits.upsert(state, decisions.join(pending.select("p_partkey"), "p_partkey", "left_semi"), ["p_partkey"])


@query(f"""with {v.LIBRARY.cte()}, p as (select p_partkey as k, p_size as z, case p_size % 3 when 0 then 'base' when 1 then 'domain' else 'vt_local' end as scope, case when p_size % 10 = 0 then 'accepted' else 'pending' end as status from part),
d as (select *, case z % 4 when 0 then 'accept' when 1 then 'reject' when 2 then 'rename' else 'postpone' end as decision, case when k % 5 = 0 then 'base' when k % 5 = 1 then 'elsewhere' else scope end as target, case when z % 4 = 2 then 'new_' || k else 'slot_' || k end as final from p where z < 25),
e as (select *, case when decision = 'postpone' then 'unknown decision' when status <> 'pending' then 'not pending' when decision <> 'reject' and target = 'elsewhere' then 'unknown target' end as error from d), f as (select * from e where error is null)
select 'proposal' as part, 'sp_' || k as item, coalesce(case f.decision when 'accept' then 'accepted' when 'reject' then 'rejected' when 'rename' then 'renamed ' || final end, p.status) as value from p left join f using (k) union all select 'base', name, role from library union all select target, final, 'key' from f where decision <> 'reject' and target <> 'vt_local'
union all select 'log', 'sp_' || k || ' ' || decision, coalesce(error, case when decision = 'reject' then 'none' else target end) from e union all select 'log', 'sp_x accept', 'missing'""")
def m21_proposals_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on slot proposals, with renames, all three targets and refusals."""
    k, z = F.col("p_partkey"), F.col("p_size")
    part, none = read(spark, sf, "part"), F.lit(None).cast("string")
    proposals = part.select(
        F.concat(F.lit("sp_"), k).alias("proposal_id"), F.concat(F.lit("slot_"), k).alias("name"), F.col("p_name").alias("label"), F.lit("key").alias("role"), F.when(z % 3 == 0, "base").when(z % 3 == 1, "domain").otherwise("vt_local").alias("scope"),
        F.when(z % 10 == 0, "accepted").otherwise("pending").alias("status"), none.alias("renamed_to"),
    )
    decision = F.when(z % 4 == 0, "accept").when(z % 4 == 1, "reject").when(z % 4 == 2, "rename").otherwise("postpone")
    decisions = part.where("p_size < 25").select(F.concat(F.lit("sp_"), k).alias("proposal_id"), decision.alias("decision"), F.when(z % 4 == 2, F.concat(F.lit("new_"), k)).alias("renamed_to"), F.when(k % 5 == 0, "base").when(k % 5 == 1, "elsewhere").alias("target"))
    decisions = decisions.unionByName(spark.createDataFrame([("sp_x", "accept", None, "base")], "proposal_id string, decision string, renamed_to string, target string"))
    base = v.LIBRARY.frame(spark)
    after, base, domain, log = edits.proposals_applied(proposals, base, base.where("false"), decisions)
    row = lambda df, part_, item, value: df.select(F.lit(part_).alias("part"), item.alias("item"), value.alias("value"))
    out = row(after, "proposal", F.col("proposal_id"), F.concat_ws(" ", "status", "renamed_to")).unionByName(row(base, "base", F.col("name"), F.col("role"))).unionByName(row(domain, "domain", F.col("name"), F.col("role")))
    return out.unionByName(row(log, "log", F.concat_ws(" ", "proposal_id", "decision"), F.coalesce("error", "applied_to")))


@query(f"""with {v.CATALOG.cte()}, {v.USAGE.cte()}, {v.REVIEWS.cte()}, {v.SLOTS.cte()}, {v.BRIDGE.cte()}, {v.LIBRARY.cte()}, nz as ({_NOISE}), mc as ({ORACLES['matched_columns']}), tk as (select distinct vt_id, "table", field from reviews where decision like 'take_%' or decision = 'new_slot'),
c as (select * from catalog join nz using ("table", field) where (reason is null or reason = 'whitelisted') and len(list_filter(regexp_split_to_array(lower(coalesce(sample_data, '')), '[|\\s]+'), lambda x: x not in ('', 'null', 'nan', 'none', '-'))) > 0 and ("table", field) in (select "table", field from usage_stats where usage_count > 0)),
al as (select vt_id, unnest(list_append(list_append(aliases, name), case when origin = 'base' then label end)) as alias from slots left join (select name, label from library) l using (name) union all select vt_id, unnest([t.field, k.comment]) from tk t join c k using ("table", field)),
r as (select distinct b.vt_id, c."table", c.field, lower(c.field) as n, lower(trim(coalesce(c.comment, ''))) as m from c join bridge b using ("table"))
select vt_id, "table", field from r where (vt_id, "table", field) not in (select vt_id, "table", field from tk) and (vt_id, "table", field) not in (select vt_id, "table", field from mc where status = 'auto')
and not exists (select 1 from al where al.vt_id = r.vt_id and length(alias) >= 2 and (contains(n, lower(alias)) or contains(m, lower(alias))))""")
def m22_extra_candidates(spark: SparkSession, sf: str) -> DataFrame:
    key, taken = ["table", "field"], ["take_top1", "take_top2", "take_top3", "new_slot"]
    named = noise(spark, sf).where("reason is null or reason = 'whitelisted'").select(*key)
    columns = v.CATALOG.frame(spark, sf).where(~text.empty_sample(F.coalesce("sample_data", F.lit("")))).join(named, key, "left_semi").join(v.USAGE.frame(spark, sf).where("usage_count > 0"), key, "left_semi")
    auto = matched_columns(spark, sf).where("status = 'auto'")
    return edits.extra_candidates(columns, v.BRIDGE.frame(spark, sf), v.SLOTS.frame(spark, sf), v.LIBRARY.frame(spark), v.REVIEWS.frame(spark, sf), taken, auto)


@query(f"""with {_X13}, k as (select "table", field, vt_id, round(lexical, 9) as s, row_number() over (partition by "table", field, vt_id order by round(lexical, 9) desc, slot_index) as r from l),
w as (select "table", field, vt_id, max(s) filter (r = 1) as a, coalesce(max(s) filter (r = 2), 0) as b from k group by all)
select "table", field, vt_id, case when vt_id = 'shelf_3' then round(a, 6) else 0.0 end as score, case when vt_id <> 'shelf_3' then 'old' when a - b < 0.05 and a >= 0.45 then 'conflict' when a >= 0.65 and a - b >= 0.10 then 'auto' when a >= 0.45 then 'review' else 'low' end as status, 2 as version from w""")
def m23_recompute_one(spark: SparkSession, sf: str) -> DataFrame:
    """One topic is scored and decided anew from its own partitions, and both tables change in one commit; all others keep what they had (0 and old here)."""
    store, key = Store(spark, workspace(spark, "topics")), ["table", "field", "vt_id"]
    columns = v.CATALOG.frame(spark, sf).select("table", "field", "comment").join(v.BRIDGE.frame(spark, sf).select("vt_id", "table"), "table")
    slots = v.SLOTS.frame(spark, sf).select("vt_id", "slot_index", F.col("name").alias("slot"), "aliases")
    all_of = settled(columns.join(slots.select("vt_id").distinct(), "vt_id", "left_semi").select(*key).distinct())
    tables = {"columns": columns, "slots": slots, "scores": all_of.withColumn("score", F.lit(0.0)), "decisions": all_of.withColumn("status", F.lit("old"))}
    store.commit(0, {name: Change(rows, "vt_id") for name, rows in tables.items()})

    def recompute(read: Callable[..., DataFrame]) -> dict[str, Change]:
        mine = read("columns", only=["shelf_3"]).join(read("slots", only=["shelf_3"]), "vt_id")
        two = settled(widened(lexical_of(mine).withColumn("score", F.round("lexical", 9)), 2, key, [F.col("score").desc(), F.col("slot_index")], ["score"]))
        return {"scores": Change(two.select(*key, F.round("top1_score", 6).alias("score")), "vt_id"), "decisions": Change(two.select(*key, scores.status(F.col("top1_score"), F.col("top2_score")).alias("status")), "vt_id")}

    version = store.edit(recompute)
    return store.read("scores").join(store.read("decisions"), key).select(*key, "score", "status", F.lit(version).alias("version"))


def _two_writers(spark: SparkSession, sf: str) -> Store:
    """A store whose second version was committed while another edit of the first one was under way, which then had to start again."""
    store, tries = Store(spark, workspace(spark, "writers")), []
    store.commit(0, {"supplier": Change(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey")})

    def other(get: Callable[..., DataFrame]) -> dict[str, Change]:
        return {"supplier": Change(get("supplier", only=[3]).withColumn("s_acctbal", F.col("s_acctbal") + 1), "s_nationkey")}

    def mine(get: Callable[..., DataFrame]) -> dict[str, Change]:
        rows = get("supplier", only=[3, 4]).withColumn("s_acctbal", F.col("s_acctbal") * 2)
        tries.append(rows)
        if len(tries) == 1:
            store.edit(other)
        return {"supplier": Change(rows, "s_nationkey")}

    if store.edit(mine) != 3 or len(tries) != 2:
        raise RuntimeError("the second edit did not start again")
    return store


@query("select s_suppkey, s_nationkey, round(case s_nationkey when 3 then (s_acctbal + 1) * 2 when 4 then s_acctbal * 2 else s_acctbal end, 2) as s_acctbal from supplier")
def m7_two_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Two edits of one version: the later one is done again on the outcome of the first, so neither is lost."""
    return _two_writers(spark, sf).read("supplier").select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("""select version, s_nationkey, count(*) as n, round(sum(case when s_nationkey = 3 and version = 2 then s_acctbal + 1 when s_nationkey = 3 and version = 3 then (s_acctbal + 1) * 2 when s_nationkey = 4 and version = 3 then s_acctbal * 2 else s_acctbal end), 2) as total
from supplier, (values (1), (2), (3)) v(version) group by all""")
def m7_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every version of a table can still be read."""
    store, out = _two_writers(spark, sf), None
    for version in (1, 2, 3):
        rows = store.read("supplier", version).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total")).withColumn("version", F.lit(version))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""with r as (select * from (values (1, 'nations', true), (1, 'suppliers', true), (1, 'regions', true), (2, 'nations', false), (2, 'suppliers', false), (2, 'regions', false), (3, 'nations', false), (3, 'suppliers', true), (3, 'regions', true)) v(run, step, ran))
select run, step, ran, case step when 'nations' then (select count(*) from nation) when 'suppliers' then (select count(distinct s_nationkey) from supplier) + (run // 3) else (select count(distinct n_regionkey) from nation where n_nationkey in (select s_nationkey from supplier)) end as n from r""")
def s14_dirty_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps, run at first, then again with nothing changed, then after one of their inputs has got a further file: only that one's step and what follows it run."""
    base, inputs = workspace(spark, "steps"), workspace(spark, "inputs")
    read(spark, sf, "nation").write.parquet(f"{inputs}/nation")
    read(spark, sf, "supplier").select("s_suppkey", "s_nationkey").write.parquet(f"{inputs}/supplier")
    plan = [
        steps.Step("nations", [f"{inputs}/nation"], lambda n: n.select("n_nationkey", "n_regionkey")),
        steps.Step("suppliers", [f"{inputs}/supplier"], lambda s: s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))),
        steps.Step("regions", ["nations", "suppliers"], lambda n, s: n.join(s, "n_nationkey").groupBy("n_regionkey").agg(F.sum("n").alias("n"))),
    ]
    out = None
    for run in (1, 2, 3):
        if run == 3:
            read(spark, sf, "supplier").select("s_suppkey", F.lit(-1).alias("s_nationkey")).write.mode("append").parquet(f"{inputs}/supplier")
        store = Store(spark, base)
        for name, ran in steps.run_dirty(spark, base, plan):
            row = store.read(name).agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit(name).alias("step"), F.lit(ran).alias("ran"), "n")
            out = row if out is None else out.unionByName(row)
    return out


#: What is recorded for each shelf: by its number modulo 8 the one extended slot of the first answer, and that of the second, where there is one.
_FIRST = "case s % 8 when 1 then 'Order_ID' when 2 then 'o_id' when 3 then 'o_id' when 6 then 'c_ts' else 'stock_price' end"
_SECOND = "case s % 8 when 1 then 'order_code' when 2 then 'l_id' when 6 then 'event_time' end"


@query(f"""with a as (select distinct p_partkey // 20 as s from part), b as (select s, {_FIRST} as one, {_SECOND} as two from a)
select 'shelf_' || s as vt_id, case when s % 8 = 5 then 'unanswered' when one = 'stock_price' then 'accepted' when two is null or two = 'l_id' then 'warned' else 'corrected' end as outcome,
case when s % 8 = 5 then '' else 'n_id,' || coalesce(two, one) end as names, case when s % 8 = 5 or one = 'stock_price' or two in ('order_code', 'event_time') then '' else coalesce(two, one) end as warnings from b""")
def s15_asked_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Answers about each shelf are read, linted, and asked for once more under a key that has the bad names; some are unreadable, some have no second one."""
    shelves = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("s")).distinct()
    said = shelves.select("s", F.concat(F.lit("slots of shelf "), "s").alias("prompt"), F.expr(_FIRST).alias("one"), F.expr(_SECOND).alias("two"))
    fence = lambda name: F.concat(F.lit('```json\n{"slots": [{"name": "n_id", "from": "base"}, {"name": "'), name, F.lit('", "from": "extended"}]}\n```'))
    first = said.select(answers.prompt_key(F.col("prompt")).alias("key"), F.when(F.col("s") % 8 == 5, "no JSON").otherwise(fence(F.col("one"))).alias("answer"))
    second = said.where("two is not null").select(answers.prompt_key(F.col("prompt"), F.array("one")).alias("key"), fence(F.col("two")).alias("answer"))
    asked = said.select(F.concat(F.lit("shelf_"), "s").alias("vt_id"), "prompt")
    got = answers.with_feedback(asked, first.unionByName(second), "vt_id", SYLLABLES)
    return got.select("vt_id", "outcome", F.array_join("names", ",").alias("names"), F.array_join("warnings", ",").alias("warnings"))
