"""Queries of sources, predicates and scalar functions (S, F, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import containment, joins, ranking, summaries
from tessera.plans import vocabularies as v
from tessera.plans.registry import query, read
from tessera.sources import files
from tessera.sources.files import settled

SUFFIXES = {"key": "key", "id": "key", "date": "time", "ts": "time", "price": "measure", "bal": "measure", "name": "display", "flag": "code", "status": "code"}
KEYWORDS = {"key": ["key"], "time": ["date", "time"], "money": ["price", "balance"], "place": ["region", "nation"], "code": ["code", "flag", "status"]}
SYLLABLES = ["c", "o", "l", "r", "n", "id", "ts"]
_DUCK_TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[_\-]+'), lambda t: t <> '')"


@query("select n_nationkey, n_name, n_regionkey from nation")
def s1_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = files.workspace(spark, "csv")
    files.write_csv(read(spark, sf, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("select n_name from nation where n_regionkey = 2")
def s2_projected_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = files.workspace(spark, "csv")
    files.write_csv(read(spark, sf, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").where("n_regionkey = 2").select("n_name")


@query("select r_name as \"table\", cast(r_regionkey as varchar) as field, cast(null as varchar) as comment from region")
def s3_tolerant_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "region").select(F.col("r_name").alias("Table_EN"), F.col("r_regionkey").cast("string").alias("FIELD"))
    return files.resolved(rows, {"table": ["table", "table_en", "origin_table"], "field": ["field", "field_name"], "comment": ["comment", "remark"]})


@query("select r_name, n_nationkey, n_name from nation join region on n_regionkey = r_regionkey")
def s4_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    nested = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    path = files.workspace(spark, "json")
    files.append_log(nested, path)
    kinds = "r_name string, nations array<struct<n_nationkey: int, n_name: string>>"
    return spark.read.schema(kinds).json(path).select("r_name", F.explode("nations").alias("n")).select("r_name", "n.*")


@query("""select 'orders by ' || r_name as query, case r_regionkey % 4 when 0 then r_name || ',k' || r_regionkey when 1 then r_name || ',x' when 2 then r_name else r_name || ',b,c' end as tables from region
union all select 'inner ' || r_name, r_name from region where r_regionkey % 4 = 2""")
def s5_record_finder(spark: SparkSession, sf: str) -> DataFrame:
    """Records at several depths, with lists of names, lists of objects or one text of names; the last ones are too deep to be found."""
    name, key = F.col("r_name"), F.col("r_regionkey").cast("string")
    q = F.concat(F.lit('"Question": "orders by '), name, F.lit('"'))
    listed = F.concat(F.lit('{"a": {"b": [{'), q, F.lit(', "sql": "", "tables": ["'), name, F.lit('", "k'), key, F.lit('"]}]}}'))
    objects = F.concat(F.lit("[{"), q, F.lit(', "expected_tables": [{"table": "'), name, F.lit('"}, {"other": 1}, {"en": "x"}]}]'))
    nested = F.concat(F.lit("{"), q, F.lit(', "tables": ["'), name, F.lit('"], "more": {"query": "inner '), name, F.lit('", "table_list": "'), name, F.lit('"}}'))
    packed = F.concat(F.lit('{"items": [{'), q, F.lit(', "tables": "'), name, F.lit(', b;c"}, {"query": "", "tables": "z"}]}'))
    deep = F.concat(F.lit('{"l":' * 9), F.lit('{"query": "too deep", "tables": "z"}'), F.lit("}" * 9))
    k = F.col("r_regionkey") % 4
    docs = read(spark, sf, "region").select(F.explode(F.array(F.when(k == 0, listed).when(k == 1, objects).when(k == 2, nested).otherwise(packed), deep, F.lit("no json {"))).alias("doc"))
    found = files.found_records(docs, "doc", ["query", "query_text", "question"], ["tables", "table_list", "expected_tables"])
    return found.select("query", F.array_join("tables", ",").alias("tables"))


@query("select event_type, count(*) as n from events where event_type in ('click', 'view') group by event_type")
def s8_parquet_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = files.workspace(spark, "parquet")
    read(spark, sf, "events").write.partitionBy("event_type").parquet(path)
    return spark.read.parquet(path).where(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select r_regionkey, r_name from region")
def s9_csv_with_bom(spark: SparkSession, sf: str) -> DataFrame:
    path = files.workspace(spark, "csv")
    files.write_csv(read(spark, sf, "region"), path, bom=True)
    return files.resolved(spark.read.csv(path, header=True), {"r_regionkey": ["r_regionkey"], "r_name": ["r_name"]}).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("select 'create' as action, r_name as name from region union all select 'delete', r_name from region where r_regionkey < 2")
def s10_append_log(spark: SparkSession, sf: str) -> DataFrame:
    path, region = files.workspace(spark, "log"), read(spark, sf, "region")
    files.append_log(region.select(F.lit("create").alias("action"), F.col("r_name").alias("name")), path)
    files.append_log(region.where("r_regionkey < 2").select(F.lit("delete").alias("action"), F.col("r_name").alias("name")), path)
    return spark.read.schema("action string, name string").json(path)


@query(f"with {v.SLOTS.cte()} select vt_id, slot_index, '[' || array_to_string(list_transform(aliases, lambda a: '\"' || a || '\"'), ',') || ']' as aliases from slots")
def s11_nested_as_text(spark: SparkSession, sf: str) -> DataFrame:
    return files.nested_as_text(v.SLOTS.frame(spark, sf).select("vt_id", "slot_index", "aliases"))


@query("select o_orderkey, case when o_orderstatus = 'P' then 0.0 else o_totalprice end as o_totalprice, o_orderstatus from orders")
def s12_partition_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    path, orders = files.workspace(spark, "orders"), read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.overwrite_keys(orders, path, "o_orderstatus")
    files.overwrite_keys(orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), path, "o_orderstatus")
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string").parquet(path)


@query("select event_type as channel, count(*) as n, cast(null as double) as best from events where event_type <> 'click' group by 1 union all select 'click', count(*), max(value) from events where event_type = 'click'")
def s13_merge_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    old = events.groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    new = events.where("event_type = 'click'").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"), F.max("value").alias("best"))
    return files.merged_by_key(old, new, "channel")


@query("select sha256('{\"brand\":\"' || p_brand || '\",\"type\":\"' || p_type || '\"}') as key, count(*) as n, bool_or(p_size <= 10) as cached from part group by p_brand, p_type")
def s15_call_cache(spark: SparkSession, sf: str) -> DataFrame:
    parts = read(spark, sf, "part").withColumn("key", files.cache_key({"type": F.col("p_type"), "brand": F.col("p_brand")}))
    calls = parts.groupBy("key").agg(F.count("*").alias("n"))
    done, todo = files.split_by_cache(calls, parts.where("p_size <= 10").select("key").distinct())
    return done.withColumn("cached", F.lit(True)).unionByName(todo.withColumn("cached", F.lit(False)))


@query("select 'orders' as metric, count(*) as n from orders union all select 'status ' || o_orderstatus, count(*) from orders group by o_orderstatus union all select 'without priority', count(*) from orders where o_orderpriority is null")
def s16_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    by = orders.groupBy(F.concat(F.lit("status "), "o_orderstatus").alias("metric")).agg(F.count("*").alias("n"))
    both = orders.agg(F.struct(F.lit("orders").alias("metric"), F.count("*").alias("n")).alias("a"), F.struct(F.lit("without priority").alias("metric"), F.count_if(F.col("o_orderpriority").isNull()).alias("n")).alias("b"))
    return by.unionByName(both.select(F.explode(F.array("a", "b")).alias("m")).select("m.*"))


_NOISE = f"""with {v.CATALOG.cte()}, {v.NOISE_RULES.cte()}, {v.WHITELIST.cte()},
hits as (select c."table", c.field, min(r.ord) as ord from catalog c join noise_rules r on (r.kind = 'glob' and lower(c.field) glob lower(r.value)) group by all),
named as (select h.*, r.value from hits h join noise_rules r using (ord))
select c."table", c.field, case when w.field_name is not null then 'whitelisted' when c.field in (select value from noise_rules where kind = 'exact') then 'exact'
  when n.value is not null then 'glob ' || n.value when p.value is not null then 'pair'
  when coalesce(trim(c.comment), '') = '' and not regexp_matches(c.field, '[A-Za-z]') then 'nameless'
  when coalesce(trim(c.comment), '') = '' and len(list_filter(string_split(c.sample_data, '|'), lambda x: trim(x) not in ('', 'null', 'Null', 'NULL', 'NaN', 'nan', 'None', '\\N', '-', '--'))) = 0 then 'empty' end as reason
from catalog c left join whitelist w on w.table_en = c."table" and w.field_name = c.field left join named n on n."table" = c."table" and n.field = c.field
left join noise_rules p on p.kind = 'pair' and p.table_en = c."table" and p.value = c.field"""


def noise(spark: SparkSession, sf: str | None) -> DataFrame:
    """(table, field, reason): the first rule that marks a column as noise, or whitelisted, or null."""
    catalog, rules, white = v.CATALOG.frame(spark, sf), v.NOISE_RULES.frame(spark), v.WHITELIST.frame(spark)
    globs = rules.where("kind = 'glob'").select("ord", "value", text.glob_regex(F.col("value")).alias("regex"))
    hit = catalog.join(F.broadcast(globs), F.expr("lower(field) rlike regex")).groupBy("table", "field").agg(F.min_by("value", "ord").alias("glob"))
    exact = rules.where("kind = 'exact'").select(F.col("value").alias("field"), F.lit(True).alias("exact"))
    pair = rules.where("kind = 'pair'").select(F.col("table_en").alias("table"), F.col("value").alias("field"), F.lit(True).alias("pair"))
    known = white.select(F.col("table_en").alias("table"), F.col("field_name").alias("field"), F.lit(True).alias("white"))
    rows = catalog.join(hit, ["table", "field"], "left").join(exact, "field", "left").join(pair, ["table", "field"], "left").join(known, ["table", "field"], "left")
    blank = F.coalesce(F.trim("comment"), F.lit("")) == ""
    reason = F.when(F.col("white"), "whitelisted").when(F.col("exact"), "exact").when(F.col("glob").isNotNull(), F.concat(F.lit("glob "), "glob")).when(F.col("pair"), "pair")
    return rows.select("table", "field", reason.when(blank & ~F.col("field").rlike("[A-Za-z]"), "nameless").when(blank & text.blank_samples(F.col("sample_data")), "empty").alias("reason"))


@query(_NOISE)
def f1_noise_reason(spark: SparkSession, sf: str) -> DataFrame:
    return noise(spark, sf)


@query("select p_partkey, case when p_name glob 'c?ld *' then 'c?ld *' when p_name glob '*bolt' then '*bolt' when p_name glob '[rs]* [a-g]*' then '[rs]* [a-g]*' end as glob from part where p_name glob 'c?ld *' or p_name glob '*bolt' or p_name glob '[rs]* [a-g]*'")
def f2_glob_match(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([(0, "C?LD *"), (1, "*bolt"), (2, "[rs]* [A-G]*")], "ord int, value string").withColumn("regex", text.glob_regex(F.col("value")))
    hit = read(spark, sf, "part").join(F.broadcast(rules), F.expr("lower(p_name) rlike regex")).groupBy("p_partkey").agg(F.min_by(F.lower("value"), "ord").alias("glob"))
    return hit


@query(f"select \"table\", field from ({_NOISE}) where reason = 'whitelisted'")
def f3_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return noise(spark, sf).where("reason = 'whitelisted'").select("table", "field")


@query(f"select \"table\", count(*) as n from ({_NOISE}) where reason is null or reason = 'whitelisted' group by 1")
def f4_without_noise(spark: SparkSession, sf: str) -> DataFrame:
    return noise(spark, sf).where("reason is null or reason = 'whitelisted'").groupBy("table").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')")
def f5_status_in(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


@query("select p_partkey from part where contains(p_name, 'red') or contains(p_brand, '13') or contains(p_type, 'PROMO')")
def f6_search_three(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").where(F.contains("p_name", F.lit("red")) | F.contains("p_brand", F.lit("13")) | F.contains("p_type", F.lit("PROMO"))).select("p_partkey")


def filtered(df: DataFrame, equal: dict[str, object], search: dict[str, str] | None = None) -> DataFrame:
    """Only the parameters that are given (not None) filter."""
    for c, x in equal.items():
        df = df if x is None else df.where(F.col(c) == x)
    for c, x in (search or {}).items():
        df = df if x is None else df.where(F.contains(c, F.lit(x)))
    return df


@query("select o_orderkey from orders where o_orderstatus = 'O' and contains(o_orderpriority, 'HIGH')")
def f7_optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(read(spark, sf, "orders"), {"o_orderstatus": "O", "o_custkey": None}, {"o_orderpriority": "HIGH"}).select("o_orderkey")


_F8 = """select l_orderkey, l_linenumber, round(cast(least(1.0, case when l_quantity >= 45 then 0.4 else 0 end + case when l_discount >= 0.09 then 0.3 else 0 end + case when l_tax = 0 then 0.35 else 0 end + case when l_returnflag = 'R' then 0.15 else 0 end) as double), 6) as score,
list_filter([case when l_quantity >= 45 then 'bulk' end, case when l_discount >= 0.09 then 'discount' end, case when l_tax = 0 then 'untaxed' end, case when l_returnflag = 'R' then 'returned' end], lambda x: x is not null) as reasons from lineitem"""


def _rules() -> tuple:
    return scores.rule_score([("bulk", F.col("l_quantity") >= 45, 0.4), ("discount", F.col("l_discount") >= 0.09, 0.3), ("untaxed", F.col("l_tax") == 0, 0.35), ("returned", F.col("l_returnflag") == "R", 0.15)])


@query(f"select l_orderkey, l_linenumber, score, array_to_string(reasons, ',') as reasons from ({_F8})")
def f8_rule_score(spark: SparkSession, sf: str) -> DataFrame:
    total, reasons = _rules()
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(total, 6).alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query(f"select l_orderkey, l_linenumber, score from ({_F8}) where score >= 0.3")
def f9_score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(_rules()[0], 6).alias("score")).where("score >= 0.3")


@query(f"""with {v.CATALOG.cte()}, {v.SLOTS.cte()}, a as (select name as slot, row_number() over (order by vt_id, slot_index) - 1 as ord, unnest(aliases) as alias from slots),
m as (select c."table", c.field, a.slot, a.ord, case when lower(c.field) = alias then 1 when c.comment = alias then 2 when list_contains({_DUCK_TOKENS.format('c.field')}, alias) then 3
  when length(alias) >= 2 and (contains(lower(c.field), alias) or contains(c.comment, alias)) then 4 end as match from catalog c, a),
r as (select *, row_number() over (partition by "table", field order by match, ord, slot) as k from m where match is not null)
select "table", field, match, slot from r where k = 1""")
def f10_best_name_match(spark: SparkSession, sf: str) -> DataFrame:
    slots = ranking.numbered(v.SLOTS.frame(spark, sf).select("vt_id", "slot_index", "name", "aliases"), [F.col("vt_id"), F.col("slot_index")], "ord")
    aliases = slots.select(F.col("name").alias("slot"), F.col("ord") - 1, F.explode("aliases").alias("alias")).toDF("slot", "ord", "alias")
    return containment.best_match(v.CATALOG.frame(spark, sf), aliases, F.lower("field"), F.col("comment"), text.tokens(F.col("field")), ["table", "field"])


@query(f"""with {v.CATALOG.cte()}, {v.SLOTS.cte()} select c."table", c.field, s.vt_id, s.slot_index from catalog c, slots s
where len(list_filter(s.aliases, lambda a: length(a) >= 2 and (contains(lower(c.field), a) or contains(coalesce(c.comment, ''), a)))) > 0""")
def f11_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Which slots cover a column: an alias of two characters or more is within its name or comment."""
    names = v.CATALOG.frame(spark, sf).select("table", "field", F.explode(F.array(F.lower("field"), F.col("comment"))).alias("text"))
    aliases = v.SLOTS.frame(spark, sf).select("vt_id", "slot_index", F.explode("aliases").alias("part"))
    pairs = containment.containing(names, aliases)
    return containment.sharing(names.join(pairs, "text").select("table", "field", "part"), ["table", "field"], aliases, ["vt_id", "slot_index"])


@query(f"""with {v.QUESTIONS.cte()}, {v.SLOTS.cte()} select q.question_id, s.vt_id, s.slot_index from questions q, slots s where q.query_text <> ''
and len(list_filter(list_append(s.aliases, s.name), lambda h: contains(h, q.query_text) or (length(h) >= 2 and contains(q.query_text, h)))) > 0""")
def f12_either_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of which a name is within a question, or holds all of it."""
    asked = settled(v.QUESTIONS.frame(spark, sf).where("query_text <> ''").select("question_id", F.col("query_text").alias("question")))
    names = settled(v.SLOTS.frame(spark, sf).select("vt_id", "slot_index", F.explode(F.array_append("aliases", F.col("name"))).alias("name")))
    inside = settled(containment.containing(asked.select(F.col("question").alias("text")), names.select(F.col("name").alias("part"))).toDF("question", "name"))
    around = settled(containment.containing(names.select(F.col("name").alias("text")), asked.select(F.col("question").alias("part")), least=1).toDF("name", "question"))
    found = asked.join(inside.unionByName(around), "question").select("question_id", F.col("name").alias("part"))
    return containment.sharing(found, ["question_id"], names.withColumnRenamed("name", "part"), ["vt_id", "slot_index"])


@query(f"""with {v.CATALOG.cte()}, t as (select "table", field, {_DUCK_TOKENS.format('field')} as w from catalog)
select "table", field from t where not regexp_full_match(field, '[a-z][a-z0-9]*(_[a-z0-9]+)*') or (len(w) >= 2 and len(list_filter(w, lambda x: x in ('c', 'o', 'l', 'r', 'n', 'id', 'ts'))) / len(w) >= 0.6)""")
def f13_badly_named(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).where(text.badly_named(F.col("field"), SYLLABLES)).select("table", "field")


@query(f"with {v.CATALOG.cte()} select \"table\", count(*) as fields from catalog group by 1 having \"table\" in ('region') or (count(*) >= 4 and regexp_full_match(\"table\", '[a-z][a-z0-9_]*'))")
def f14_good_tables(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.CATALOG.frame(spark, sf).groupBy("table").agg(F.count("*").alias("fields"))
    return rows.where(F.col("table").isin("region") | ((F.col("fields") >= 4) & F.col("table").rlike("^[a-z][a-z0-9_]*$")))


@query(f"with {v.CATALOG.cte()} select \"table\", field from catalog where len(list_filter(regexp_split_to_array(lower(sample_data), '[|\\s]+'), lambda x: x not in ('', 'null', 'nan', 'none', '-'))) = 0")
def f15_blank_samples(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).where(text.empty_sample(F.col("sample_data"))).select("table", "field")


@query(f"""with {v.CATALOG.cte()}, {v.USAGE.cte()}, j as (select c."table", c.field, u.field is not null as used from catalog c left join (select distinct "table", field from usage_stats) u using ("table", field)), k as (select *, bool_or(used) over (partition by "table") as any_used from j)
select "table", field from k where used or not any_used""")
def f16_used_unless_none(spark: SparkSession, sf: str) -> DataFrame:
    used = v.USAGE.frame(spark, sf).select("table", "field").distinct().withColumn("used", F.lit(True))
    rows = v.CATALOG.frame(spark, sf).join(used, ["table", "field"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    return summaries.kept_unless_none(rows, ["table"], F.col("used")).select("table", "field")


@query("select l_orderkey, l_linenumber, l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') as kept from lineitem")
def f17_allowed_references(spark: SparkSession, sf: str) -> DataFrame:
    """One join of lines, dealt out by key so many a task, with the distinct allowed keys."""
    lines, orders = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), read(spark, sf, "orders").where("o_orderstatus = 'F'")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // 1_000_000)
    allowed = orders.select(F.col("o_orderkey").alias("l_orderkey")).where("l_orderkey is not null").repartition(tasks, "l_orderkey").distinct().withColumn("kept", F.lit(True))
    return lines.repartition(tasks, "l_orderkey").join(allowed.hint("merge"), "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(f"with {v.CATALOG.cte()} select \"table\", field, array_to_string({_DUCK_TOKENS.format('field')}, ' ') as tokens from catalog")
def x1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).select("table", "field", F.array_join(text.tokens(F.col("field")), " ").alias("tokens"))


@query(f"with {v.CATALOG.cte()} select \"table\", field, case " + " ".join(f"when ends_with(lower(field), '{k}') then '{x}'" for k, x in SUFFIXES.items()) + " end as kind from catalog")
def x2_suffix_class(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).select("table", "field", text.suffix_class(F.col("field"), SUFFIXES).alias("kind"))


@query(f"""with {v.CATALOG.cte()}, {v.ABBREVIATIONS.cte()}, t as (select "table", field, unnest({_DUCK_TOKENS.format('field')}) as token, generate_subscripts({_DUCK_TOKENS.format('field')}, 1) as i from catalog),
w as (select "table", field, i, unnest(coalesce(words, [token])) as word, generate_subscripts(coalesce(words, [token]), 1) as j from t left join abbreviations using (token)), f as (select "table", field, word, min(i * 100 + j) as pos from w group by all)
select "table", field, string_agg(word, ' ' order by pos) as expanded from f group by all""")
def x3_expanded(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.CATALOG.frame(spark, sf).select("table", "field", F.posexplode(text.tokens(F.col("field"))).alias("i", "token")).join(v.ABBREVIATIONS.frame(spark), "token", "left")
    return rows.groupBy("table", "field").agg(F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("words", F.array("token")).alias("w")))), lambda s: s.w))), " ").alias("expanded"))


@query(rf"with {v.CATALOG.cte()} select \"table\", field, trim(string_split(string_split(regexp_replace(coalesce(comment, ''), '\([^)]*\)|\[[^\]]*\]', '', 'g'), '|')[1], chr(10))[1]) as clean from catalog".replace('\\"', '"'))
def x4_clean_comment(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).select("table", "field", text.clean_comment(F.col("comment")).alias("clean"))


@query(f"with {v.CATALOG.cte()} select \"table\", field, array_to_string(list_filter([" + ", ".join("case when " + " or ".join(f"contains(lower(comment), '{w}')" for w in ws) + f" then '{k}' end" for k, ws in KEYWORDS.items()) + "], lambda x: x is not null), ' ') as concepts from catalog")
def x5_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).select("table", "field", F.array_join(text.concepts(F.col("comment"), KEYWORDS), " ").alias("concepts"))


_BIGRAMS = """s as (select {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[\\s,.;:!?/\\\\|()\\[\\]{{}}<>"''_\\-]+'), lambda x: x <> '')) as seg, generate_subscripts(list_filter(regexp_split_to_array(lower({text}), '[\\s,.;:!?/\\\\|()\\[\\]{{}}<>"''_\\-]+'), lambda x: x <> ''), 1) as i from {table}),
g as (select {key}, i, case when length(seg) <= 3 then [seg] else list_transform(range(1, length(seg)), lambda p: substr(seg, p, 2)) end as grams from s), u as (select {key}, i, unnest(grams) as gram, generate_subscripts(grams, 1) as j from g), f as (select {key}, gram, min(i * 1000 + j) as pos from u group by all)"""


@query("with " + _BIGRAMS.format(key="p_partkey", text="p_name", table="part") + " select p_partkey, string_agg(gram, ' ' order by pos) as grams from f group by p_partkey")
def x6_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.array_join(text.bigrams(F.col("p_name")), " ").alias("grams"))


@query(f"with {v.CATALOG.cte()} select \"table\", field, array_to_string(list_filter(list_transform(string_split(sample_data, '|'), lambda x: trim(x)), lambda x: x <> '')[1:5], '~') as samples from catalog")
def x7_samples(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).select("table", "field", F.array_join(text.samples(F.col("sample_data")), "~").alias("samples"))


def voted(spark: SparkSession, rows: DataFrame, key: list[str], values: str) -> DataFrame:
    """(key, patterns): patterns that at least half of the values match; weak ones go if a strong one stays; the best two by votes, then rule order."""
    from tessera.operators.ranking import top

    sized = rows.select(*key, F.explode(values).alias("value"), F.size(values).alias("n"))
    votes = sized.join(F.broadcast(v.PATTERNS.frame(spark)), F.expr("value rlike regex")).groupBy(*key, "n", "pattern", "strong", "ord").agg(F.count("*").alias("votes"))
    votes = votes.where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col("n") / 2)))
    strong = votes.where("strong").select(*key).distinct().withColumn("has", F.lit(True))
    votes = votes.join(strong, key, "left").where("strong or has is null")
    best = top(votes, 2, key, [F.col("votes").desc(), F.col("ord")])
    return best.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pattern"))), lambda s: s.pattern).alias("patterns"))


_VOTES = f"""with {v.CATALOG.cte()}, {v.PATTERNS.cte()}, s as (select "table", field, list_filter(list_transform(string_split(sample_data, '|'), lambda x: trim(x)), lambda x: x <> '')[1:5] as vals from catalog), e as (select "table", field, len(vals) as n, unnest(vals) as val from s),
k as (select "table", field, n, pattern, strong, ord, count(*) as votes from e join patterns on regexp_matches(val, regex) group by all having count(*) >= greatest(1, ceil(n / 2))),
b as (select *, bool_or(strong) over (partition by "table", field) as has from k), r as (select *, row_number() over (partition by "table", field order by votes desc, ord) as i from b where strong or not has)"""


@query(_VOTES + " select \"table\", field, string_agg(pattern, ' ' order by i) as patterns from r where i <= 2 group by all")
def x8_pattern_vote(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.CATALOG.frame(spark, sf).select("table", "field", text.samples(F.col("sample_data")).alias("values"))
    return voted(spark, rows, ["table", "field"], "values").select("table", "field", F.array_join("patterns", " ").alias("patterns"))


@query("select p_brand, min(length(p_name)) as shortest, max(length(p_name)) as longest, cast(round(cast(avg(length(p_name)) as decimal(18, 6)), 2) as double) as mean from part group by p_brand")
def x9_lengths(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("p_name")
    return read(spark, sf, "part").groupBy("p_brand").agg(F.min(size).cast("long").alias("shortest"), F.max(size).cast("long").alias("longest"), F.round(F.avg(size), 2).alias("mean"))


@query(f"with {v.CATALOG.cte()} select \"table\", field, case when (regexp_matches(sample_data, '[0-9]'))::int + (regexp_matches(sample_data, '[A-Za-z]'))::int > 1 then 'mixed' when regexp_matches(sample_data, '[0-9]') then 'digit' when regexp_matches(sample_data, '[A-Za-z]') then 'letter' else 'unknown' end as kind from catalog")
def x10_character_class(spark: SparkSession, sf: str) -> DataFrame:
    return v.CATALOG.frame(spark, sf).select("table", "field", text.character_class(F.split("sample_data", r"\|")).alias("kind"))


_PIECES = "list_filter(regexp_split_to_array(lower({}), '[\\s_\\-,，/、()（）:：]+'), lambda t: t <> '')"


@query(f"""with t as (select p_partkey, p_name || '_' || p_type || '（订单日期）/' || p_brand as x from part)
select p_partkey, array_to_string(list_sort(list_distinct(list_concat({_PIECES.format('x')}, ['订单', '单日', '日期']))), ' ') as tokens from t""")
def x11_token_set(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.lit("_"), "p_type", F.lit("（订单日期）/"), "p_brand")
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(text.token_set(name)), " ").alias("tokens"))


@query("select p_partkey, round(case when length(p_name) > 0 and length(p_type) > 0 then 1 - levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type)) else 0 end, 6) as similarity from part")
def x12_edit_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.round(text.edit_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("similarity"))


def _x13(base: bool = False) -> str:
    clean = r"trim(string_split(string_split(regexp_replace(coalesce(c.comment, ''), '\([^)]*\)|\[[^\]]*\]', '', 'g'), '|')[1], chr(10))[1])"
    return f"""{v.CATALOG.cte(base)}, {v.SLOTS.cte(base)}, {v.BRIDGE.cte(base)}, {v.ABBREVIATIONS.cte()},
xe as (select "table", field, list_distinct(flatten(list(coalesce(words, [token])))) as expanded from (select distinct "table", field, unnest({_DUCK_TOKENS.format('field')}) as token from catalog) left join abbreviations using (token) group by all),
xj as (select c."table", c.field, {clean} as clean, s.vt_id, s.name as slot, s.slot_index, s.aliases, {_DUCK_TOKENS.format('c.field')} as w from catalog c join bridge b using ("table") join slots s using (vt_id)),
xk as (select xj.*, coalesce(expanded, []) as expanded, list_distinct(list_concat(list_concat(w, coalesce(expanded, [])), {_PIECES.format('clean')})) as ours, list_distinct(flatten(list_transform(list_append(aliases, slot), lambda a: {_PIECES.format('a')}))) as theirs from xj left join xe using ("table", field)),
l as (select "table", field, vt_id, slot_index, slot, greatest(
  case when len(ours) = 0 or len(theirs) = 0 then 0.0 else len(list_intersect(ours, theirs)) / len(list_distinct(list_concat(ours, theirs))) end,
  list_max(list_transform(list_append(aliases, slot), lambda a: case when length(a) = 0 then 0.0 else 1 - levenshtein(lower(field), lower(a)) / greatest(length(field), length(a)) end)),
  case when list_has_any(aliases, expanded) then 1.0 else 0.0 end,
  case when len(list_filter(aliases, lambda a: length(a) >= 2 and contains(clean, a))) > 0 then 0.8 when len(list_filter(aliases, lambda a: length(a) >= 2 and contains(lower(field), lower(a)))) > 0 then 0.7 else 0.0 end) as lexical from xk)"""


_X13 = _x13()


def lexical(spark: SparkSession, sf: str | None) -> DataFrame:
    """(table, field, vt_id, slot_index, slot, lexical): the best of four measures of a column's names and comment against a slot's name and aliases.

    These are the Jaccard of their tokens, the edit similarity of the names, an alias that is a word of the spelt-out name (1), and an alias
    within the comment (0.8) or the name (0.7).
    """
    return lexical_of(joins.bridged(v.CATALOG.frame(spark, sf), v.BRIDGE.frame(spark, sf).select("vt_id", "table"), v.SLOTS.frame(spark, sf).withColumnRenamed("name", "slot")))


def lexical_of(rows: DataFrame) -> DataFrame:
    """`lexical` of columns that stand beside slots already: (table, field, comment, vt_id, slot_index, slot, aliases)."""
    known = F.create_map(*[x for token, words in v.ABBREVIATIONS.rows for x in (F.lit(token), F.array(*map(F.lit, words)))])
    name, clean, words, none = F.lower("field"), text.clean_comment(F.col("comment")), text.tokens(F.col("field")), F.array().cast("array<string>")
    rows = rows.withColumns({"clean": clean, "expanded": F.flatten(F.transform(words, lambda t: F.coalesce(F.try_element_at(known, t), F.array(t))))})
    theirs = F.array_append("aliases", F.col("slot"))
    jaccard = text.jaccard(F.array_distinct(F.concat(words, "expanded", text.token_set(F.col("clean")))), F.array_distinct(F.flatten(F.transform(theirs, text.token_set))))
    edit = F.array_max(F.transform(theirs, lambda a: text.edit_similarity(name, F.lower(a))))
    inside = lambda whole, fold: F.exists("aliases", lambda a: (F.length(a) >= 2) & F.contains(whole, F.lower(a) if fold else a))
    part = F.when(inside(F.col("clean"), False), 0.8).when(inside(name, True), 0.7).otherwise(0.0)
    best = F.greatest(jaccard, edit, F.when(F.arrays_overlap(F.coalesce("aliases", none), "expanded"), 1.0).otherwise(0.0), part)
    return rows.select("table", "field", "vt_id", "slot_index", "slot", best.alias("lexical"))


@query(f"with {_X13} select \"table\", field, vt_id, slot, slot_index, round(lexical, 6) as lexical from l")
def x13_lexical_score(spark: SparkSession, sf: str) -> DataFrame:
    return lexical(spark, sf).withColumn("lexical", F.round("lexical", 6))


_X14 = f"""p as (select "table", field, list(pattern) as found, list_distinct(flatten(list(coalesce(near, [])))) as near from r left join (select pattern, list(neighbour) as near from adjacent group by 1) using (pattern) where i <= 2 group by all),
q as (select c."table", c.field, s.vt_id, s.slot_index, cast(case when len(coalesce(p.found, [])) = 0 or len(s.patterns) = 0 then 0.5 when list_has_any(p.found, s.patterns) then 1.0 when list_has_any(p.near, s.patterns) then 0.5 else 0.1 end as double) as pattern_score
  from catalog c join bridge b using ("table") join slots s using (vt_id) left join p using ("table", field))"""


def pattern_scores(spark: SparkSession, sf: str | None) -> DataFrame:
    rows = v.CATALOG.frame(spark, sf).select("table", "field", text.samples(F.col("sample_data")).alias("values"))
    found = voted(spark, rows, ["table", "field"], "values")
    near = found.select("table", "field", F.explode("patterns").alias("pattern")).join(F.broadcast(v.ADJACENT.frame(spark)), "pattern").groupBy("table", "field").agg(F.collect_set("neighbour").alias("near"))
    both = joins.bridged(v.CATALOG.frame(spark, sf), v.BRIDGE.frame(spark, sf).select("vt_id", "table"), v.SLOTS.frame(spark, sf).withColumnRenamed("patterns", "wanted")).join(found, ["table", "field"], "left").join(near, ["table", "field"], "left")
    none = F.array().cast("array<string>")
    return both.select("table", "field", "vt_id", "slot_index", scores.pattern_score(F.coalesce("patterns", none), F.col("wanted"), F.coalesce("near", none)).alias("pattern_score"))


@query(f"{_VOTES}, {v.SLOTS.cte()}, {v.BRIDGE.cte()}, {v.ADJACENT.cte()}, {_X14} select \"table\", field, vt_id, slot_index, pattern_score from q")
def x14_pattern_score(spark: SparkSession, sf: str) -> DataFrame:
    return pattern_scores(spark, sf)


_BONUS = {("fact", "time"): 0.3, ("fact", "measure"): 0.2, ("entity", "display"): 0.3}


@query(f"""with {v.SLOTS.cte()}, {v.SCAFFOLD.cte()} select vt_id, slot_index, round(cast(least(1.0, case when len(types) = 0 then 0.15 when list_contains(types, table_type) then 0.3 else 0.0 end
+ case when table_type = 'fact' and role = 'time' then 0.3 when table_type = 'fact' and role = 'measure' then 0.2 when table_type = 'entity' and role = 'display' then 0.3 else 0.0 end + case when count(*) filter (role = 'key') over (partition by vt_id) > 0 then 0.2 else 0.0 end) as double), 6) as context from slots join scaffold using (vt_id)""")
def x15_context_score(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = v.SLOTS.frame(spark, sf).join(v.SCAFFOLD.frame(spark, sf), "vt_id")
    together = F.count_if(F.col("role") == "key").over(Window.partitionBy("vt_id")) > 0
    return rows.select("vt_id", "slot_index", F.round(scores.context_score(F.col("table_type"), F.col("types"), F.col("role"), _BONUS, together), 6).alias("context"))


_WEIGHTS = {"role_where": 0.4, "role_join": 0.3, "role_select": 0.2, "usage_count": 0.1}


@query(f"""with {v.USAGE.cte()}, u as (select "table", field, sum(usage_count) as usage_count, sum(role_select) as role_select, sum(role_where) as role_where, sum(role_join) as role_join from usage_stats group by all), m as (select max(usage_count) a, max(role_select) b, max(role_where) c, max(role_join) d from u)
select "table", field, round(0.4 * least(1, ln(1 + role_where) / ln(1 + c)) + 0.3 * least(1, ln(1 + role_join) / ln(1 + d)) + 0.2 * least(1, ln(1 + role_select) / ln(1 + b)) + 0.1 * least(1, ln(1 + usage_count) / ln(1 + a)), 6) as usage from u, m""")
def x16_usage_score(spark: SparkSession, sf: str) -> DataFrame:
    u = v.USAGE.frame(spark, sf).groupBy("table", "field").agg(*[F.sum(c).alias(c) for c in _WEIGHTS])
    rows = u.join(F.broadcast(u.agg(*[F.max(c).alias(f"m_{c}") for c in _WEIGHTS])))
    return rows.select("table", "field", F.round(scores.usage_score({c: (F.col(c), F.col(f"m_{c}")) for c in _WEIGHTS}, _WEIGHTS), 6).alias("usage"))


@query("select l_orderkey, l_linenumber, round(0.30 * l_tax + 0.20 * l_discount + 0.15 * l_quantity / 50 + 0.10 * l_tax + 0.25 * l_discount, 6) as total from lineitem")
def x17_total_score(spark: SparkSession, sf: str) -> DataFrame:
    parts = {"lexical": F.col("l_tax"), "pattern": F.col("l_discount"), "context": F.col("l_quantity") / 50, "usage": F.col("l_tax"), "semantic": F.col("l_discount")}
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(scores.total_score(parts), 6).alias("total"))


_TWO = "(select p_partkey, p_size / 50.0 as a, nullif(p_partkey % 41, 0) / 50.0 as b, p_brand, p_type from part)"


def _two(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), (F.nullif(F.col("p_partkey") % 41, F.lit(0)) / 50.0).alias("b"), "p_brand", "p_type")


@query(f"select p_partkey, case when a - coalesce(b, 0) < 0.05 and a >= 0.45 then 'conflict' when a >= 0.65 and a - coalesce(b, 0) >= 0.10 then 'auto' when a >= 0.45 then 'review' else 'low' end as status from {_TWO}")
def x18_status(spark: SparkSession, sf: str) -> DataFrame:
    return _two(spark, sf).select("p_partkey", scores.status(F.col("a"), F.col("b")).alias("status"))


@query(f"select p_partkey, coalesce(a >= 0.5 and b >= 0.5 and a - b < 0.05 and p_brand <> p_type, false) as roles, coalesce(a >= 0.6 and b >= 0.6 and a - b < 0.05, false) as twins from {_TWO}")
def x19_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    f = F.lit(False)
    return _two(spark, sf).select("p_partkey", F.coalesce(scores.role_conflict(a, b, F.col("p_brand"), F.col("p_type")), f).alias("roles"), F.coalesce(scores.near_duplicate(a, b), f).alias("twins"))


@query(f"select p_partkey, case when p_partkey % 7 = 0 then 'D' when p_brand = 'Brand#1' then 'A' when b is null then 'C' when a < 0.45 then 'B' end as trigger from {_TWO}")
def x20_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _two(spark, sf).select("p_partkey", scores.fallback(F.col("p_partkey") % 7 == 0, F.col("p_brand") == "Brand#1", F.col("b").isNull(), F.col("a") < 0.45).alias("trigger"))


@query(f"""with {v.SLOTS.cte()}, {v.BRIDGE.cte()}, f as (select *, slot_index = min(slot_index) filter (role = 'time') over (partition by vt_id) as first from slots), n as (select vt_id, count(*) as sources from bridge group by 1)
select vt_id, slot_index, case when role = 'key' or coalesce(first, false) or name = 'source_system' then 'essential' when sources >= 3 then 'frequent' else 'optional' end as tier from f join n using (vt_id)""")
def x21_tier(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.col("slot_index") == F.min(F.when(F.col("role") == "time", F.col("slot_index"))).over(Window.partitionBy("vt_id"))
    rows = v.SLOTS.frame(spark, sf).withColumn("first", F.coalesce(first, F.lit(False))).join(v.BRIDGE.frame(spark, sf).groupBy("vt_id").agg(F.count("*").alias("sources")), "vt_id")
    return rows.select("vt_id", "slot_index", scores.tier(F.col("role"), F.col("first"), F.col("name"), F.col("sources")).alias("tier"))


@query(f"select p_partkey, case when a < 0.45 then 'adjusted' when a >= 0.65 then 'direct' else 'synonym_best' end as mapping from {_TWO}")
def x22_mapping_type(spark: SparkSession, sf: str) -> DataFrame:
    return _two(spark, sf).select("p_partkey", scores.mapping_type(F.when(F.col("a") < 0.45, "B").otherwise("-"), F.col("a")).alias("mapping"))


@query("select o_orderkey, case when o_orderstatus = 'F' then case when o_totalprice >= 100000 then 'ok' else 'partial_coverage' end when o_custkey % 3 = 0 then 'missing_slot' when o_custkey % 3 = 1 then 'unmapped_field' when o_orderpriority <> '5-LOW' then 'intent_miss' else 'other' end as failure from orders")
def x23_failure_type(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    kind = scores.failure_type(F.col("o_orderstatus") == "F", F.when(F.col("o_totalprice") >= 100000, 1.0).otherwise(0.5), k != 0, k != 1, F.col("o_orderpriority") == "5-LOW")
    return read(spark, sf, "orders").select("o_orderkey", kind.alias("failure"))


@query(f"with {v.CATALOG.cte()}, n as (select *, count(*) over (partition by field) + length(field) % 3 as tables from catalog) select \"table\", field, case when comment is null and tables >= 2 then case when contains(field, '_') then string_split(field, '_')[1] || '_*' else field end when tables >= 2 then field else 'pair' end as action from n")
def x24_suggested_action(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("field")) + F.length("field") % 3
    return v.CATALOG.frame(spark, sf).withColumn("tables", n).select("table", "field", scores.suggested_action(F.col("comment").isNull(), F.col("tables"), F.col("field")).alias("action"))


@query(f"with {v.SCAFFOLD.cte()} select vt_id, case when contains(lower(topic), 'order') or contains(lower(topic), 'activity') then 'fact' when contains(lower(topic), 'customer') then 'entity' when contains(lower(topic), 'place') then 'dictionary' else 'fact' end as kind from scaffold")
def x25_table_type(spark: SparkSession, sf: str) -> DataFrame:
    return v.SCAFFOLD.frame(spark, sf).select("vt_id", scores.first_matching(F.col("topic"), {"fact": ["order", "activity"], "entity": ["customer"], "dictionary": ["place"]}, "fact").alias("kind"))


@query(f"with {v.SCAFFOLD.cte()} select vt_id, topic || ' ' || topic || ' ' || topic || ' ' || l2 || ' ' || l2 || ' ' || l1 as text from scaffold")
def x26_weighted_text(spark: SparkSession, sf: str) -> DataFrame:
    return v.SCAFFOLD.frame(spark, sf).select("vt_id", text.weighted_text([(F.col("topic"), 3), (F.col("l2"), 2), (F.lit(" "), 2), (F.col("l1"), 1)]).alias("text"))


@query("select event_id, case when event_id % 5 = 0 then null else cast(json_extract(props, '$.k') as bigint) end as k from events")
def x27_fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("no answer {")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return read(spark, sf, "events").select("event_id", text.fenced_json(raw, "k long").getField("k").alias("k"))


@query("select l_orderkey, l_linenumber, round(l_discount / 3 + l_tax / 7, 4) as score from lineitem")
def x28_round(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") / 3 + F.col("l_tax") / 7, 4).alias("score"))
