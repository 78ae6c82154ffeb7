"""The catalogue of the test tables and vocabularies about them: slots, topics, rules, reviews, questions.

Some rows are written by hand. The rest follow the test tables: each row of `part` is a column of a table, twenty columns a table (a shelf),
each shelf is a topic with slots of its own, a question and renames, and every third column is used, every tenth reviewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import Vocabulary, read

#: The kind of a column, by the size of its part: the end of its name, and of its comment.
_KINDS = ("key", "date", "price", "name", "flag")
#: A column of each part, for both engines.
_COLUMN = f"""select p_partkey as k, p_partkey // 20 as shelf, p_size as s, split_part(p_name, ' ', 1) || '_' || (p_partkey % 20) || '_' || {list(_KINDS)}[1 + p_size % 5] as field, {list(_KINDS)}[1 + p_size % 5] as kind, lower(p_type) as topic from part"""
_DATA = "case when k % 8 = 0 then 'null|null' when k % 8 = 1 then '' when kind = 'date' then '1997-01-' || lpad((1 + s % 28)::varchar, 2, '0') || '|1998-02-03' when kind = 'price' then s || '.' || (k % 90 + 10) || '|' || (s + 1) || '.25' when kind = 'key' then k || '|' || s else upper(topic) || '|' || topic end"
_COMMENT = "case when k % 9 = 0 then null when k % 9 = 1 then '' else topic || ' ' || kind || case when k % 4 = 0 then ' (old)|spare' else '' end end"


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    p, kinds = read(spark, sf, "part"), F.array(*map(F.lit, _KINDS))
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.get(kinds, (size % 5).cast("int"))
    rows = p.select(k.alias("k"), F.floor(k / 20).alias("shelf"), size.alias("s"), kind.alias("kind"), F.lower("p_type").alias("topic"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_"), (k % 20).cast("string"), F.lit("_"), kind).alias("field"))
    k, s, topic = F.col("k"), F.col("s"), F.col("topic")
    day = F.concat(F.lit("1997-01-"), F.lpad((1 + s % 28).cast("string"), 2, "0"), F.lit("|1998-02-03"))
    price = F.concat(s.cast("string"), F.lit("."), (k % 90 + 10).cast("string"), F.lit("|"), (s + 1).cast("string"), F.lit(".25"))
    data = F.when(k % 8 == 0, "null|null").when(k % 8 == 1, "").when(F.col("kind") == "date", day).when(F.col("kind") == "price", price).when(F.col("kind") == "key", F.concat_ws("|", k, s)).otherwise(F.concat_ws("|", F.upper(topic), topic))
    comment = F.when(k % 9 == 0, None).when(k % 9 == 1, "").otherwise(F.concat(topic, F.lit(" "), F.col("kind"), F.when(k % 4 == 0, " (old)|spare").otherwise("")))
    return rows.withColumns({"table": F.concat(F.lit("t"), F.col("shelf").cast("string")), "comment": comment, "sample_data": data, "type": F.when(F.col("kind").isin("key"), "bigint").when(F.col("kind") == "date", "timestamp").otherwise("string")})


def _per_column(where: str, **values: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A row for each column where the condition holds; the values are expressions that both engines read alike."""
    sql = f"select 't' || shelf as \"table\", field, {', '.join(f'{x} as {n}' for n, x in values.items())} from ({_COLUMN}) c where {where}"
    return lambda spark, sf: _columns(spark, sf).where(where).select("table", "field", *[F.expr(x).alias(n) for n, x in values.items()]), sql


def _per_shelf(rows: list[dict[str, str]], where: str = "true") -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """The given rows of expressions over `shelf` for each shelf."""
    sql = " union all ".join(f"select {', '.join(f'{x} as \"{n}\"' for n, x in r.items())} from (select distinct p_partkey // 20 as shelf from part) s where {where}" for r in rows)

    def grown(spark: SparkSession, sf: str) -> DataFrame:
        shelves = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("shelf")).distinct().where(where)
        spoken = lambda x: x.replace("[", "array(").replace("]", ")") if x.startswith("[") else x
        return shelves.select(F.explode(F.array(*[F.struct(*[F.expr(spoken(x)).alias(n) for n, x in r.items()]) for r in rows])).alias("r")).select("r.*")

    return grown, sql


_TOPICS = ("vt_sales", "vt_party", "vt_place", "vt_click", "vt_text")
_SHELF = "'shelf_' || shelf"


def _shelf_slot(at: int, name: str, origin: str, role: str, alias: str, pattern: str, kinds: str) -> dict[str, str]:
    return {"vt_id": _SHELF, "slot_index": str(at), "name": f"'{name}'", "origin": f"'{origin}'", "role": f"'{role}'", "aliases": f"['{alias}']", "patterns": f"['{pattern}']", "types": f"['{kinds}']"}


CATALOG = Vocabulary(
    "catalog", "table string, field string, comment string, type string, sample_data string",
    [
        ("region", "r_regionkey", "region key", "int", "0|1|2|3|4"), ("region", "r_name", "region name (upper case)", "string", "AFRICA|AMERICA|ASIA"),
        ("nation", "n_nationkey", "nation key", "int", "0|7|24"), ("nation", "n_name", "nation name", "string", "NATION_0|NATION_7"), ("nation", "n_regionkey", "region key|joins region", "int", "0|3"),
        ("customer", "c_custkey", "customer key", "bigint", "0|149"), ("customer", "c_name", "customer name", "string", "Customer#000000000"), ("customer", "c_acctbal", "account balance", "double", "2095.23|-12.50"),
        ("customer", "c_mktsegment", "market segment", "string", "FURNITURE|MACHINERY"), ("customer", "etl_batch", None, "bigint", "null|null"), ("customer", "c_name_bak", None, "string", ""),
        ("orders", "o_orderkey", "order key", "bigint", "0|1|2"), ("orders", "o_custkey", "customer key", "bigint", "85|134"), ("orders", "o_orderstatus", "order status", "string", "F|O|P"),
        ("orders", "o_totalprice", "total price of the order", "double", "144449.04|88094.03"), ("orders", "o_orderdate", "order date", "timestamp", "1997-01-15|1997-07-27|2001-07-11"), ("orders", "row_id", "", "bigint", "1|2"),
        ("lineitem", "l_orderkey", "order key", "bigint", "201|594"), ("lineitem", "l_quantity", "quantity", "double", "20|45|17"), ("lineitem", "l_extendedprice", "extended price", "double", "44473.56|93450.38"),
        ("lineitem", "l_shipdate", "ship date", "timestamp", "1997-10-31|2000-08-18"), ("lineitem", "l_returnflag", "return flag", "string", "N|A|R"), ("lineitem", "_01", None, "string", "null|"),
        ("events", "event_id", "event id", "bigint", "0|1"), ("events", "ts", "event time", "timestamp", "2024-01-01 00:09:58|2024-01-01 00:16:06"), ("events", "eventType", "event type", "string", "click|view|error"),
        ("events", "props", "properties as JSON", "string", '{"k": 87}'), ("documents", "doc_id", "document id", "bigint", "0|1"), ("documents", "text", "text of the document", "string", "Du. Oure an le"), ("documents", "lang", "language code", "string", "en|fr|de"),
    ],
    (lambda spark, sf: _columns(spark, sf), f"select 't' || shelf as \"table\", field, {_COMMENT} as comment, case kind when 'key' then 'bigint' when 'date' then 'timestamp' else 'string' end as type, {_DATA} as sample_data from ({_COLUMN}) c"),
)
USAGE = Vocabulary(
    "usage_stats", "table string, field string, usage_count double, role_select double, role_where double, role_join double",
    [
        ("orders", "o_orderkey", 40.0, 20.0, 10.0, 30.0), ("orders", "o_orderkey", 2.0, 1.0, 0.0, 1.0), ("orders", "o_orderdate", 25.0, 10.0, 20.0, 0.0), ("orders", "o_totalprice", 18.0, 18.0, 2.0, 0.0), ("customer", "c_custkey", 30.0, 9.0, 8.0, 25.0),
        ("customer", "c_name", 12.0, 12.0, 3.0, 0.0), ("lineitem", "l_orderkey", 33.0, 3.0, 2.0, 33.0), ("lineitem", "l_quantity", 21.0, 21.0, 6.0, 0.0), ("lineitem", "l_shipdate", 14.0, 8.0, 14.0, 0.0), ("events", "ts", 9.0, 5.0, 9.0, 0.0),
    ],
    _per_column("k % 3 = 0", usage_count="s", role_select="s % 7", role_where="s % 5", role_join="s % 3"),
)
#: vt_id, topic and path of each group of tables.
SCAFFOLD = Vocabulary(
    "scaffold", "vt_id string, topic string, table_type string, l1 string, l2 string",
    [("vt_sales", "sales orders", "fact", "sales", "orders"), ("vt_party", "customers", "entity", "sales", "parties"), ("vt_place", "places", "dictionary", "sales", "parties"), ("vt_click", "activity", "fact", "activity", "events"), ("vt_text", "content", "entity", "content", "texts")],
    _per_shelf([{"vt_id": _SHELF, "topic": "'parts of shelf ' || shelf", "table_type": "case when shelf % 2 = 0 then 'fact' else 'entity' end", "l1": "'stock'", "l2": "'aisle ' || (shelf % 10)"}]),
)
BRIDGE = Vocabulary(
    "bridge", "vt_id string, table string, ord int",
    [("vt_sales", "orders", 0), ("vt_sales", "lineitem", 1), ("vt_party", "customer", 0), ("vt_party", "nation", 1), ("vt_place", "nation", 0), ("vt_place", "region", 1), ("vt_click", "events", 0), ("vt_text", "documents", 0), ("vt_none", "region", 0)],
    _per_shelf([{"vt_id": _SHELF, "table": "'t' || shelf", "ord": "0"}, {"vt_id": "case shelf " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(_TOPICS)) + " else 'vt_none' end", "table": "'t' || shelf", "ord": "1"}]),
)
SLOTS = Vocabulary(
    "slots", "vt_id string, slot_index int, name string, origin string, role string, aliases array<string>, patterns array<string>, types array<string>",
    [
        ("vt_sales", 0, "order_key", "base", "key", ["order key", "orderkey"], ["digits"], ["fact"]), ("vt_sales", 1, "order_date", "base", "time", ["order date", "date"], ["date"], ["fact"]), ("vt_sales", 2, "ship_date", "extended", "time", ["ship date"], ["date"], []),
        ("vt_sales", 3, "unit_price", "extended", "measure", ["price", "total price"], ["decimal"], ["fact"]), ("vt_sales", 4, "quantity", "base", "measure", ["quantity"], ["digits"], []), ("vt_party", 0, "customer_key", "base", "key", ["customer key", "custkey"], ["digits"], ["entity"]),
        ("vt_party", 1, "name", "base", "display", ["name"], [], []), ("vt_party", 2, "balance", "extended", "measure", ["account balance"], ["decimal"], ["entity"]), ("vt_place", 0, "region_name", "extended", "display", ["region name"], ["upper"], ["dictionary"]),
        ("vt_click", 0, "event_time", "base", "time", ["event time", "ts"], ["datetime"], ["fact"]), ("vt_click", 1, "label", "extended", "display", ["event type", "type"], ["lower"], []), ("vt_text", 0, "label", "extended", "display", ["language code"], ["lower"], []),
        ("vt_text", 1, "text", "base", "display", ["text"], [], []), ("vt_text", 2, "label", "extended", "display", ["label"], [], []),
    ],
    _per_shelf([_shelf_slot(0, "order_key", "base", "key", "key", "digits", "fact"), _shelf_slot(1, "shelf_date", "extended", "time", "date", "date", "entity"), _shelf_slot(2, "shelf_price", "extended", "measure", "price", "decimal", "fact")]),
)
LIBRARY = Vocabulary("library", "name string, role string, label string", [("order_key", "key", "order key"), ("order_date", "time", "order date"), ("quantity", "measure", "quantity"), ("customer_key", "key", "customer key"), ("name", "display", "name"), ("event_time", "time", "event time"), ("text", "display", "text")])
NOISE_RULES = Vocabulary("noise_rules", "kind string, value string, table_en string, ord int", [("exact", "row_id", None, 0), ("glob", "etl_*", None, 1), ("glob", "*_bak", None, 2), ("glob", "etl_b?tch", None, 3), ("pair", "props", "events", 4)])
WHITELIST = Vocabulary("whitelist", "table_en string, field_name string", [("orders", "row_id")])
PATTERNS = Vocabulary(
    "patterns", "pattern string, regex string, strong boolean, ord int",
    [("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", True, 0), ("datetime", "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]+$", True, 1), ("decimal", "^-?[0-9]+[.][0-9]+$", True, 2), ("digits", "^[0-9]+$", False, 3), ("upper", "^[A-Z]+$", False, 4), ("lower", "^[a-z]+$", False, 5)],
)
ADJACENT = Vocabulary("adjacent", "pattern string, neighbour string", [("date", "datetime"), ("datetime", "date"), ("digits", "decimal"), ("decimal", "digits")])
ABBREVIATIONS = Vocabulary("abbreviations", "token string, words array<string>", [("acctbal", ["account", "balance"]), ("mktsegment", ["market", "segment"]), ("custkey", ["customer", "key"]), ("orderkey", ["order", "key"]), ("ts", ["time"])])
REVIEWS = Vocabulary(
    "reviews", "table string, field string, vt_id string, decision string, decision_slot string",
    [("orders", "o_orderdate", "vt_sales", "take_top1", "order_date"), ("orders", "o_totalprice", "vt_sales", "new_slot", "total_price"), ("lineitem", "l_shipdate", "vt_sales", "take_top2", "ship_date"), ("customer", "etl_batch", "vt_party", "noise", None), ("customer", "c_name", "vt_party", "skip", None), ("orders", "o_dropped", "vt_sales", "take_top1", "order_key")],
    _per_column("k % 10 = 0", vt_id=_SHELF, decision="case s % 4 when 0 then 'take_top1' when 1 then 'noise' when 2 then 'skip' else 'new_slot' end", decision_slot="case s % 4 when 0 then 'order_key' when 3 then 'new_' || s end"),
)
QUESTIONS = Vocabulary(
    "questions", "question_id int, query_text string, tables array<string>",
    [(0, "total price of orders by order date", ["orders"]), (1, "quantity shipped by ship date", ["lineitem", "orders"]), (2, "account balance of customers by nation", ["customer", "nation"]), (3, "event time and event type", ["events"]), (4, "language code of each text", ["documents"]), (5, "region name", ["region", "nation"]), (6, "region name", ["nation", "region"]), (7, "", [])],
    _per_shelf([{"question_id": "100 + shelf", "query_text": "'price by order date of shelf ' || shelf", "tables": "['t' || shelf]"}]),
)
RENAMES = Vocabulary("renames", "vt_id string, before string, after string", [("vt_sales", "ship_date", "unit_price"), ("vt_sales", "unit_price", "net_price"), ("vt_text", "label", "language"), ("vt_sales", "order_key", "nothing")], _per_shelf([{"vt_id": _SHELF, "before": "'shelf_date'", "after": "'stock_date'"}], "shelf % 2 = 0"))
MERGES = Vocabulary("merges", "primary string, absorbed string", [("vt_party", "vt_place")])
