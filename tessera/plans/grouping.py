"""Queries of joins, aggregates, rankings and set operations (J, A, W, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import distances, joins, ranking, summaries
from tessera.operators.edits import merged as merge_rows
from tessera.plans import vocabularies as v
from tessera.plans.columns import _NOISE, _X13, lexical, noise
from tessera.plans.registry import query, read, read_in_order
from tessera.sources.files import settled


@query(f"with {v.CATALOG.cte()}, {v.USAGE.cte()} select c.\"table\", c.field, sum(u.usage_count) as usage_count, sum(u.role_join) as role_join from catalog c left join usage_stats u using (\"table\", field) group by all")
def j1_left_with_usage(spark: SparkSession, sf: str) -> DataFrame:
    return joins.with_usage(v.CATALOG.frame(spark, sf), v.USAGE.frame(spark, sf), ["table", "field"]).select("table", "field", "usage_count", "role_join")


_RESULTS = "results as (select \"table\", field, vt_id, arg_max(slot, lexical - slot_index / 1e6) as slot, max(lexical) as score from l group by all)"


def results(spark: SparkSession, sf: str | None) -> DataFrame:
    """(table, field, vt_id, slot, score): the best slot of each column and topic by its lexical score."""
    best = ranking.top(lexical(spark, sf), 1, ["table", "field", "vt_id"], [F.col("lexical").desc(), F.col("slot_index")])
    return best.select("table", "field", "vt_id", "slot", F.col("lexical").alias("score"))


@query(f"with {_X13}, {_RESULTS}, {v.REVIEWS.cte()} select \"table\", field, vt_id, slot, round(score, 6) as score, decision, decision_slot from results full join reviews using (\"table\", field, vt_id)")
def j2_full_with_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return joins.overlaid(results(spark, sf).withColumn("score", F.round("score", 6)), v.REVIEWS.frame(spark, sf), ["table", "field", "vt_id"])


@query("select a.o_custkey, a.best = b.latest as agree from (select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as best from orders group by 1) a join (select o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) as latest from orders group by 1) b using (o_custkey)")
def j3_agreement(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    pick = lambda c, name: orders.groupBy("o_custkey").agg((-F.max(F.struct(c, -F.col("o_orderkey"))).getField("col2")).alias(name))
    return pick("o_totalprice", "best").join(pick("o_orderdate", "latest"), "o_custkey").select("o_custkey", (F.col("best") == F.col("latest")).alias("agree"))


@query("select o_orderkey, l.first_ship from orders left join (select l_orderkey, min(l_shipdate) as first_ship from lineitem group by 1) l on l_orderkey = o_orderkey")
def j4_left_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    one = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    return read(spark, sf, "orders").join(one, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "first_ship")


@query("select c_custkey, coalesce(n_name, 'unknown') as n_name from customer left join (select * from nation where n_nationkey < 20) on n_nationkey = c_nationkey")
def j5_lookup_with_default(spark: SparkSession, sf: str) -> DataFrame:
    lookup = read(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.with_default(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), lookup, "c_nationkey", "n_name", "unknown").select("c_custkey", "n_name")


@query(f"with {v.CATALOG.cte()}, {v.BRIDGE.cte()}, {v.SLOTS.cte()} select \"table\", field, vt_id, slot_index from catalog join bridge using (\"table\") join slots using (vt_id)")
def j6_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return joins.bridged(v.CATALOG.frame(spark, sf), v.BRIDGE.frame(spark, sf), v.SLOTS.frame(spark, sf)).select("table", "field", "vt_id", "slot_index")


@query(f"with {v.SLOTS.cte()}, {v.LIBRARY.cte()} select s.name, s.vt_id, coalesce(nullif(s.role, 'display'), l.role) as role, l.label from slots s left join library l using (name)")
def j7_reference_filled(spark: SparkSession, sf: str) -> DataFrame:
    refs = v.SLOTS.frame(spark, sf).select("name", "vt_id", F.nullif("role", F.lit("display")).alias("role"), F.lit(None).cast("string").alias("label"))
    return joins.filled(refs, v.LIBRARY.frame(spark), "name", ["role", "label"])


@query("select c_custkey, 'with' as kind from customer where c_custkey in (select o_custkey from orders) union all select c_custkey, 'without' from customer where c_custkey not in (select o_custkey from orders)")
def j8_semi_and_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("without")))


@query("select a.n_regionkey, a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def j9_pairs_in_group(spark: SparkSession, sf: str) -> DataFrame:
    return joins.group_pairs(read(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", [])


@query("with m as (select distinct s_suppkey as k, s_nationkey as g from supplier) select distinct a.k as a, b.k as b from m a join m b on a.g = b.g and a.k < b.k")
def j10_pairs_sharing(spark: SparkSession, sf: str) -> DataFrame:
    return joins.sharing_pairs(read(spark, sf, "supplier"), "s_suppkey", "s_nationkey")


@query(f"with {v.QUESTIONS.cte()}, {v.SCAFFOLD.cte()} select question_id, vt_id, levenshtein(query_text, topic) as distance from questions, scaffold")
def j11_cross_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every question with every topic, which is what is asked for."""
    found = distances.edit_distances(v.QUESTIONS.frame(spark, sf).select("question_id", "query_text"), v.SCAFFOLD.frame(spark, sf).select("vt_id", "topic"))
    return found.toDF("question_id", "vt_id", "distance")


@query(f"with {v.QUESTIONS.cte()}, {v.BRIDGE.cte()}, e as (select question_id, unnest(tables) as \"table\" from questions) select question_id, string_agg(distinct vt_id, ',' order by vt_id) as topics from e join bridge using (\"table\") group by 1")
def j12_tables_to_topics(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.QUESTIONS.frame(spark, sf).select("question_id", F.explode("tables").alias("table")).join(v.BRIDGE.frame(spark, sf), "table")
    return rows.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("vt_id")), ",").alias("topics"))


@query("select event_type, count(*) as n from events where event_type is not null group by event_type")
def a1_count_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.counts(read(spark, sf, "events"), ["event_type"])


@query("select o_custkey, count(*) filter (o_orderstatus = 'F') as n_F, count(*) filter (o_orderstatus = 'O') as n_O, count(*) filter (o_orderstatus = 'P') as n_P from orders group by 1")
def a2_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.status_counts(read(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by 1")
def a3_element_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.element_counts(read(spark, sf, "part").select(F.split("p_name", " ").alias("word")), "word")


@query("select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def a4_count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(f"with {v.CATALOG.cte()} select \"table\", bool_or(ends_with(field, 'key') or ends_with(field, 'id')) as has_key, bool_or(type = 'timestamp') as has_time, bool_or(coalesce(contains(comment, 'region') or contains(comment, 'nation'), false)) as has_place from catalog group by 1")
def a5_flags(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("comment")
    return v.CATALOG.frame(spark, sf).groupBy("table").agg(
        F.bool_or(F.endswith("field", F.lit("key")) | F.endswith("field", F.lit("id"))).alias("has_key"), F.bool_or(F.col("type") == "timestamp").alias("has_time"), F.bool_or(F.coalesce(F.contains(c, F.lit("region")) | F.contains(c, F.lit("nation")), F.lit(False))).alias("has_place")
    )


@query("select l_orderkey, l_linenumber, round(l_quantity / (select max(l_quantity) from lineitem), 6) as l_quantity, round(l_extendedprice / (select max(l_extendedprice) from lineitem), 6) as l_extendedprice from lineitem")
def a6_share_of_largest(spark: SparkSession, sf: str) -> DataFrame:
    rows = summaries.shares_of_largest(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 6).alias("l_extendedprice"))


@query("select l_orderkey, count(distinct l_returnflag) as n from lineitem group by 1 having count(distinct l_returnflag) > 1")
def a7_ambiguous_groups(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.ambiguous(read(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""with e as (select distinct c_nationkey, c_custkey, o_orderpriority || o_orderstatus as kind from customer join orders on o_custkey = c_custkey), k as (select c_nationkey, kind, count(*) as w from e group by all),
r as (select c_nationkey, count(distinct c_custkey) as rows from e group by 1) select c_nationkey, rows, count(*) as kinds from k join r using (c_nationkey) group by all having rows >= 5 and max(w) < rows and count(*) >= 6""")
def a8_scattered_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).withColumn("kind", F.concat("o_orderpriority", "o_orderstatus"))
    return summaries.scattered(rows, ["c_nationkey"], ["c_custkey"], "kind")


@query("select p_brand, round(avg(p_retailprice), 6) as mean from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part) where k <= 3 group by 1")
def a9_mean_of_best(spark: SparkSession, sf: str) -> DataFrame:
    best = ranking.top(read(spark, sf, "part"), 3, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")])
    return best.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("select o_custkey, round(avg(m), 6) as mean from (select o_custkey, l_orderkey, max(l_quantity) as m from lineitem join orders on o_orderkey = l_orderkey group by all) group by 1")
def a10_mean_of_maxima(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey", "l_orderkey").agg(F.max("l_quantity").alias("m")).groupBy("o_custkey").agg(F.round(F.avg("m"), 6).alias("mean"))


_RANKED = "select channel, item, row_number() over (partition by channel order by s desc, item) as rank from (select event_type as channel, user_id as item, sum(value) as s from events group by all)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """(channel, item, score, query): each user's sum of an event type, added in the order of the table as the SQL's is, so that nearly equal sums rank alike."""
    rows = read_in_order(spark, sf, "events").withColumnsRenamed({"event_type": "channel", "user_id": "item"})
    sums = summaries.sums_in_order(rows, ["channel", "item"], "value", ["_file", "_row"], "score")
    return settled(sums).withColumn("query", F.lit(0))  # dealing rows out by ranges reads them twice


@query(f"select item, round(sum(case channel when 'click' then 1.0 when 'view' then 0.5 else 0.25 end / (60 + rank)), 9) as score from ({_RANKED}) group by item")
def a11_reciprocal_ranks(spark: SparkSession, sf: str) -> DataFrame:
    weights = spark.createDataFrame([("all", c, w) for c, w in (("click", 1.0), ("view", 0.5), ("error", 0.25), ("signup", 0.25), ("purchase", 0.25))], "fusion string, channel string, weight double")
    ranked = ranking.placed(_scored(spark, sf), ["channel"], [F.col("score").desc_nulls_last(), F.col("item")], name="rank")
    return ranking.fused(ranked, "query", "item", weights).select("item", F.round("score", 9).alias("score"))


@query("select event_type, round(avg(case when value >= 50 then 1.0 else 0.0 end), 6) as hit, round(avg(value / 100), 6) as recall from events group by 1")
def a12_mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") >= 50).cast("double")), 6).alias("hit"), F.round(F.avg(F.col("value") / 100), 6).alias("recall"))


@query("select l_returnflag, min(l_extendedprice) as least, max(l_extendedprice) as most, round(avg(l_extendedprice), 4) as mean, median(l_extendedprice) as median from lineitem group by 1")
def a13_spread(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.spread(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("select bin, count(l_quantity) as n from (values (0, '0-9', 0, 10), (1, '10-19', 10, 20), (2, '20-49', 20, 50), (3, '50-99', 50, 100), (4, '100+', 100, 1e9)) b(i, bin, lo, hi) left join lineitem on l_quantity >= lo and l_quantity < hi group by bin")
def a14_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.histogram(read(spark, sf, "lineitem"), "l_quantity", [0, 10, 20, 50, 100])


@query("""with r as (select l_returnflag || l_linestatus as g, l_extendedprice as s, l_partkey as i, [case when l_discount >= 0.05 then 'discount' else 'full' end, case when l_tax > 0.04 then 'taxed' else 'light' end] as reasons, l_suppkey from lineitem)
select g, first(i order by s desc, i) as best, round(avg(s), 4) as mean, array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') as reasons, array_to_string(list_sort(list_distinct(list(l_suppkey)))[1:10], ',') as examples from r group by g""")
def a15_representatives(spark: SparkSession, sf: str) -> DataFrame:
    reasons = F.array(F.when(F.col("l_discount") >= 0.05, "discount").otherwise("full"), F.when(F.col("l_tax") > 0.04, "taxed").otherwise("light"))
    rows = read(spark, sf, "lineitem").withColumn("g", F.concat("l_returnflag", "l_linestatus")).withColumn("reasons", reasons)
    return summaries.representatives(rows, ["g"], "l_extendedprice", "l_partkey", "reasons", "l_suppkey").select("g", "best", F.round("mean", 4).alias("mean"), F.array_join("reasons", ",").alias("reasons"), F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("select r_name, n_name, count(*) as n, 2 - grouping(r_name) - grouping(n_name) as level from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, n_name)")
def a16_rollup_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(read(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return summaries.rolled_up(rows, ["r_name", "n_name"]).withColumn("level", F.col("level").cast("long"))


@query(f"""with {v.SCAFFOLD.cte()}, {v.BRIDGE.cte()}, nz as ({_NOISE}), pl as (select "table", first(l1 order by b.ord, vt_id) as l1, first(l2 order by b.ord, vt_id) as l2 from bridge b join scaffold using (vt_id) group by 1),
f as (select coalesce(l1, 'unknown') as l1, coalesce(l2, 'unknown') as l2, "table", count(*) as n, list({{'field': field, 'reason': reason}} order by field) as nodes from nz left join pl using ("table") where reason is not null and reason <> 'whitelisted' group by all),
g as (select l1, l2, count(*) as children, cast(sum(n) as bigint) as n, list({{'name': "table", 'children': n, 'n': n, 'nodes': nodes}} order by "table") as nodes from f group by all)
select l1, count(*) as children, cast(sum(n) as bigint) as n, cast(to_json(list({{'name': l2, 'children': children, 'n': n, 'nodes': nodes}} order by l2)) as varchar) as tree from g group by all""")
def a16_nested_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Noise columns by category, subcategory and table, as one nested document a category with the counts of each level."""
    first = F.min(F.struct("ord", "vt_id", "l1", "l2")).alias("m")
    places = v.BRIDGE.frame(spark, sf).join(v.SCAFFOLD.frame(spark, sf), "vt_id").groupBy("table").agg(first).select("table", "m.l1", "m.l2")
    rows = noise(spark, sf).where("reason is not null and reason <> 'whitelisted'").join(places, "table", "left").fillna("unknown", ["l1", "l2"])
    tree = summaries.nested(rows, ["l1", "l2", "table"], F.struct("field", "reason"), "field")
    return tree.select("l1", "children", "n", F.to_json("nodes").alias("tree"))


@query("select p_brand, count(*) as support, array_to_string(list_sort(list_distinct(list(p_name)))[1:6], '|') as names, count(distinct p_type) as types from part group by 1")
def a17_capped_candidates(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    return part.groupBy("p_brand").agg(F.count("*").alias("support"), F.count_distinct("p_type").alias("types")).join(summaries.few_of(part, ["p_brand"], "p_name", 6, "names"), "p_brand").select("p_brand", "support", F.array_join("names", "|").alias("names"), "types")


@query("select p_name, count(distinct p_type) as paths from part group by 1 having count(distinct p_type) >= 5 and p_name not in (select p_name from part where p_size = 1)")
def a18_covering_names(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    return summaries.covering(part, "p_name", "p_type", 5, part.where("p_size = 1").select("p_name").distinct())


@query(f"""with {v.SLOTS.cte()}, {v.SCAFFOLD.cte()}, {v.LIBRARY.cte()}, e as (select s.*, l1, l2 from slots s join scaffold using (vt_id) where origin = 'extended')
select 'repeat' as issue, name, count(*) as n from e group by name having count(*) > 1 union all select 'same path', name, count(*) from e group by l1, l2, name having count(*) > 1
union all select 'base clash', name, count(*) from e where name in (select name from library) group by name union all select 'roles', name, count(distinct role) from e group by name having count(distinct role) > 1""")
def a19_naming_issues(spark: SparkSession, sf: str) -> DataFrame:
    e = v.SLOTS.frame(spark, sf).join(v.SCAFFOLD.frame(spark, sf), "vt_id").where("origin = 'extended'")
    issue = lambda kind, by, n: e.groupBy(*by).agg(n.alias("n")).where("n > 1").select(F.lit(kind).alias("issue"), "name", "n")
    clash = e.join(v.LIBRARY.frame(spark).select("name"), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("base clash").alias("issue"), "name", "n")
    return issue("repeat", ["name"], F.count("*")).unionByName(issue("same path", ["l1", "l2", "name"], F.count("*"))).unionByName(issue("roles", ["name"], F.count_distinct("role"))).unionByName(clash)


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
def a20_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    found = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return summaries.zero_filled(read(spark, sf, "customer").select("c_custkey"), found, "c_custkey", "n")


@query("select o_custkey, case when n <= 10 then 'small' when n <= 20 and kinds <= 2 then 'small_aux' else 'normal' end as size from (select o_custkey, count(*) as n, count(distinct o_orderstatus) as kinds from orders group by 1)")
def a21_size_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("kinds"))
    return rows.select("o_custkey", summaries.size_class(F.col("n"), F.col("kinds")).alias("size"))


@query("select event_type, count(*) as n, count(*) filter (value >= 90) as hits, first(user_id order by value desc, user_id) as best from events group by 1")
def a22_channel_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    best = F.min(F.struct((-F.col("value")).alias("v"), F.col("user_id").alias("u"))).getField("u")
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 90).alias("hits"), best.alias("best"))


@query("""with r as (select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part) select p_brand, max(p_partkey) filter (k = 1) as top1_p_partkey, max(p_retailprice) filter (k = 1) as top1_p_retailprice,
max(p_partkey) filter (k = 2) as top2_p_partkey, max(p_retailprice) filter (k = 2) as top2_p_retailprice, max(p_partkey) filter (k = 3) as top3_p_partkey, max(p_retailprice) filter (k = 3) as top3_p_retailprice from r where k <= 3 group by 1""")
def w1_top3_wide(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.widened(read(spark, sf, "part"), 3, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], ["p_partkey", "p_retailprice"])


@query("select o_custkey, first(o_orderkey order by o_totalprice desc, o_orderkey) as o_orderkey from orders group by 1")
def w2_first_in_group(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(read(spark, sf, "orders"), 1, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("select o_orderkey, row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice desc, o_orderkey) as priority from orders")
def w3_priorities(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("priority"))


@query(f"select channel, item, rank from ({_RANKED})")
def w4_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.placed(_scored(spark, sf), ["channel"], [F.col("score").desc_nulls_last(), F.col("item")], name="rank").select("channel", "item", "rank")


@query("""with a as (select o_custkey as q, o_orderkey as i, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders union all select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by epoch(o_orderdate) desc, o_orderkey) from orders)
select q, i, round(sum(1.0 / (60 + r)), 9) as score from a group by all""")
def w5_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("i"), "o_totalprice", "o_orderdate")
    price = orders.select(F.lit("price").alias("channel"), "q", "i", F.col("o_totalprice").alias("score"))
    date = orders.select(F.lit("date").alias("channel"), "q", "i", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("score"))
    weights = spark.createDataFrame([("fusion", "price", 1.0), ("fusion", "date", 1.0)], "fusion string, channel string, weight double")
    return ranking.fused(ranking.ranks(price.unionByName(date), "q", "i"), "q", "i", weights).select("q", "i", F.round("score", 9).alias("score"))


@query("select o_custkey, o_orderkey, k from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders), (values (1), (3), (5)) v(k) where r <= k")
def w6_top_n_cuts(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.top(read(spark, sf, "orders"), 5, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return rows.join(F.broadcast(spark.createDataFrame([(1,), (3,), (5,)], "k int")), F.col("rank") <= F.col("k")).select("o_custkey", "o_orderkey", "k")


@query("select l_orderkey, l_partkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) as r from lineitem) where r <= 2")
def w7_two_best(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(read(spark, sf, "lineitem"), 2, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_partkey"), F.col("l_linenumber")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query(f"with {v.SLOTS.cte()} select vt_id, min(slot_index) filter (role = 'time') as first_time, min(slot_index) filter (role = 'key') as first_key from slots group by 1")
def w8_first_of_role(spark: SparkSession, sf: str) -> DataFrame:
    return v.SLOTS.frame(spark, sf).groupBy("vt_id").agg(F.min(F.when(F.col("role") == "time", F.col("slot_index"))).alias("first_time"), F.min(F.when(F.col("role") == "key", F.col("slot_index"))).alias("first_key"))


@query("select o_orderkey, row_number() over (order by case o_orderstatus when 'P' then 0 when 'O' then 1 end nulls last, o_totalprice desc, o_orderkey) as place from orders")
def w9_custom_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the order; the page is W10 and the head W11."""
    return w9_whole_order(spark, sf)


@query("select o_orderkey, row_number() over (order by case o_orderstatus when 'P' then 0 when 'O' then 1 end nulls last, o_totalprice desc, o_orderkey) as place from orders")
def w9_whole_order(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).asc_nulls_last(), F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return ranking.placed(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [], order).select("o_orderkey", "place")


@query("select o_orderkey, (select count(*) from orders where o_orderstatus = 'O') as total from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 20 offset 40")
def w10_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").where("o_orderstatus = 'O'")
    return ranking.page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40, 20).select("o_orderkey", "total")


@query("select c_custkey, n from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey order by n desc nulls last, c_custkey limit 25")
def w11_head_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").orderBy(F.col("n").desc_nulls_last(), "c_custkey").limit(25)


@query("select user_id, event_type, first(event_id order by ts, event_id) as event_id from events group by all")
def w12_first_per_pair(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(read(spark, sf, "events"), 1, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_suppkey order by case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, l_orderkey, l_linenumber, l_partkey) as k from lineitem) where k <= 30")
def w13_capped_by_role(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return ranking.top(read(spark, sf, "lineitem"), 30, ["l_suppkey"], [role, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select 1 + max(r_regionkey) as version from region")
def w14_next_version(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.edits import next_version

    return next_version(read(spark, sf, "region").withColumnRenamed("r_regionkey", "version"))


@query("select r_regionkey as id, r_name as name, cast(null as bigint) as extra from region union all select n_nationkey, n_name, n_regionkey from nation")
def u1_union_missing(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    b = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') as words from (select p_partkey, string_split(p_name || ' ' || p_name || ' ' || lower(p_type), ' ') as w from part)")
def u2_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "p_name", "p_name", F.lower("p_type")), " ")
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.array_distinct(words), " ").alias("words"))


@query(f"with {v.QUESTIONS.cte()} select min(question_id) as question_id, query_text from questions where query_text <> '' group by query_text, list_sort(tables)")
def u3_distinct_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.QUESTIONS.frame(spark, sf).where("query_text <> ''").withColumn("key", F.concat_ws("|", F.array_sort("tables")))
    return rows.groupBy("query_text", "key").agg(F.min("question_id").alias("question_id")).select("question_id", "query_text")


@query("select k, coalesce(b, a) as v from (select n_nationkey as k, n_name as a from nation where n_nationkey < 15) full join (select n_nationkey as k, lower(n_name) as b from nation where n_nationkey >= 10) using (k)")
def u4_merge_new_wins(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    old = n.where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return merge_rows(old, n.where("n_nationkey >= 10").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("v")), "k")


@query("select o_custkey, len(list_intersect(f, o)) as both, len(list_filter(f, lambda x: not list_contains(o, x))) as only_f from (select o_custkey, coalesce(list_distinct(list(o_orderpriority) filter (o_orderstatus = 'F')), []) as f, coalesce(list_distinct(list(o_orderpriority) filter (o_orderstatus = 'O')), []) as o from orders group by 1)")
def u5_set_counts(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))).alias(s.lower())
    rows = read(spark, sf, "orders").groupBy("o_custkey").agg(pick("F"), pick("O"))
    return rows.select("o_custkey", F.size(F.array_intersect("f", "o")).cast("long").alias("both"), F.size(F.array_except("f", "o")).cast("long").alias("only_f"))


@query("""with c as (select c_mktsegment as s, list_distinct(list(c_nationkey)) as a from customer group by 1), p as (select list_distinct(list(s_nationkey)) as b from supplier)
select s, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) as overlap from c, p""")
def u6_jaccard_and_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("s")).agg(F.collect_set("c_nationkey").alias("a"))
    rows = c.join(F.broadcast(read(spark, sf, "supplier").agg(F.collect_set("s_nationkey").alias("b"))))
    return rows.select("s", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(text.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(f"with {v.BRIDGE.cte()}, {v.MERGES.cte()} select coalesce(\"primary\", vt_id) as vt_id, \"table\", bool_and(\"primary\" is not null) as late from bridge left join merges on absorbed = vt_id group by 1, 2")
def u7_merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.edits import absorbed

    return absorbed(v.BRIDGE.frame(spark, sf), v.MERGES.frame(spark)).select("vt_id", "table", "late")
