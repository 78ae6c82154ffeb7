"""The catalogue matching of one pass: samples to patterns, names to lexical scores, the best three slots, and a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import ranking, reports
from tessera.plans import vocabularies as v
from tessera.plans.columns import _VOTES, _X13, _X14, KEYWORDS, lexical, noise, pattern_scores, voted
from tessera.plans.registry import ORACLES, query
from tessera.sources.files import workspace

_KEY = ["table", "field", "vt_id"]


@query(
    f"""{_VOTES}, {_X13.replace(v.CATALOG.cte() + ", ", "", 1)}, {v.ADJACENT.cte()}, {_X14},
t as (select "table", field, vt_id, slot, 0.6 * lexical + 0.4 * pattern_score as score, row_number() over (partition by "table", field, vt_id order by round(0.6 * lexical + 0.4 * pattern_score, 9) desc, slot_index) as k from l join q using ("table", field, vt_id, slot_index)),
w as (select "table", field, vt_id, max(slot) filter (k = 1) as top1_slot, max(score) filter (k = 1) as a, max(slot) filter (k = 2) as top2_slot, max(score) filter (k = 2) as b, max(slot) filter (k = 3) as top3_slot, max(score) filter (k = 3) as c from t where k <= 3 group by all)
select "table", field, vt_id, top1_slot, round(a, 6) as top1_score, top2_slot, round(b, 6) as top2_score, top3_slot, round(c, 6) as top3_score,
case when a - coalesce(b, 0) < 0.05 and a >= 0.45 then 'conflict' when a >= 0.65 and a - coalesce(b, 0) >= 0.10 then 'auto' when a >= 0.45 then 'review' else 'low' end as status from w"""
)
def matched_columns(spark: SparkSession, sf: str) -> DataFrame:
    both = lexical(spark, sf).join(pattern_scores(spark, sf), [*_KEY, "slot_index"])
    rows = both.withColumn("score", 0.6 * F.col("lexical") + 0.4 * F.col("pattern_score"))
    wide = ranking.widened(rows, 3, _KEY, [F.round("score", 9).desc(), F.col("slot_index")], ["slot", "score"])
    status = scores.status(F.col("top1_score"), F.col("top2_score")).alias("status")
    rounded = [F.round(f"top{i}_score", 6).alias(f"top{i}_score") for i in (1, 2, 3)]
    return wide.select(*_KEY, "top1_slot", "top2_slot", "top3_slot", *rounded, status)


_PATTERN_NAMES, _REASONS = [r[0] for r in v.PATTERNS.rows], ["exact", "pair", "nameless", "empty", *(f"glob {r[1]}" for r in v.NOISE_RULES.rows if r[0] == "glob")]
_LEVELS = [("0.85 and more", 0.85, 9.0), ("0.60 to 0.85", 0.60, 0.85), ("0.40 to 0.60", 0.40, 0.60), ("below 0.40", -9.0, 0.40)]
_STATUSES = ["auto", "review", "low", "conflict"]


def _counted(section: str, items: list[tuple[str, str]], table: str) -> str:
    return " union all ".join(f"select '{section}' as section, '{item}' as item, count(*) filter ({where}) as n, count(*) filter ({where}) / (select count(*) from {table}) as share from {table}" for item, where in items)


def _frequent(section: str, value: str, n: int, table: str) -> str:
    return f"select * from (select '{section}' as section, {value} as item, count(*) as n, count(*) / (select count(*) from {table}) as share from {table} where {value} is not null group by all order by n desc, item limit {n})"


def _sampled(section: str, text_: str, where: str, n: int, table: str) -> str:
    return f"select '{section}' as section, min({text_}) as item, null as n, null as share from {table} where {where} group by ('0x' || md5({text_})[1:8])::bigint % {n}"


_SAMPLE = "\"table\" || '.' || field || ' in ' || vt_id || ' is ' || top1_slot"
_PLACES = "select \"table\", first(l1 order by b.ord, vt_id) as l1, count(*) as topics from bridge b join scaffold using (vt_id) group by 1"


@query(
    f"""with {v.CATALOG.cte()}, {v.BRIDGE.cte()}, {v.SCAFFOLD.cte()}, nz as ({ORACLES['f1_noise_reason']}), pt as ({ORACLES['x8_pattern_vote']}), cc as ({ORACLES['x5_concepts']}), pl as ({_PLACES}),
f as (select c.*, reason, ' ' || coalesce(patterns, '') || ' ' as patterns, ' ' || coalesce(concepts, '') || ' ' as concepts, coalesce(l1, 'unknown') as l1, topics from catalog c join nz using ("table", field) left join pt using ("table", field) left join cc using ("table", field) left join pl using ("table"))
{_counted('all', [('rows', 'true'), ('noise', "reason <> 'whitelisted'"), ('with topics', 'topics > 0'), ('with comment', "trim(comment) <> ''"), ('with pattern', "trim(patterns) <> ''")], 'f')}
union all {_counted('noise', [(r, f"reason = '{r}'") for r in _REASONS], 'f')} union all {_counted('patterns', [(p, f"contains(patterns, ' {p} ')") for p in _PATTERN_NAMES], 'f')}
union all {_counted('concepts', [(k, f"contains(concepts, ' {k} ')") for k in KEYWORDS], 'f')} union all {_frequent('categories', 'l1', 15, 'f')}"""
)
def s16_feature_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report on all columns, gathered while their features are written."""
    key = ["table", "field"]
    at = F.min(F.struct("ord", "vt_id", "l1")).alias("m")
    places = v.BRIDGE.frame(spark, sf).join(v.SCAFFOLD.frame(spark, sf), "vt_id").groupBy("table").agg(at, F.count("*").alias("topics")).select("table", "m.l1", "topics")
    catalog = v.CATALOG.frame(spark, sf)
    patterns = voted(spark, catalog.select(*key, text.samples(F.col("sample_data")).alias("values")), key, "values").select(*key, "patterns")
    none = F.array().cast("array<string>")
    rows = catalog.select(*key, "comment", text.concepts(F.col("comment"), KEYWORDS).alias("concepts")).join(noise(spark, sf), key).join(patterns, key, "left").join(places, "table", "left")
    rows = rows.withColumns({"patterns": F.coalesce("patterns", none), "concepts": F.coalesce("concepts", none), "l1": F.coalesce("l1", F.lit("unknown"))})
    has = F.array_contains
    counts = [("all", "noise", F.col("reason") != "whitelisted"), ("all", "with topics", F.col("topics") > 0), ("all", "with comment", F.trim("comment") != ""), ("all", "with pattern", F.size("patterns") > 0)]
    counts += [("noise", r, F.col("reason") == r) for r in _REASONS] + [("patterns", p, has("patterns", p)) for p in _PATTERN_NAMES] + [("concepts", k, has("concepts", k)) for k in KEYWORDS]
    return reports.written(rows, workspace(spark, "features"), reports.Report(counts, [("categories", F.col("l1"), 15)]))


@query(
    f"""with mc as ({ORACLES['matched_columns']}), lx as ({ORACLES['x13_lexical_score']}), bl as (select "table", field, vt_id, arg_max(slot_index, (lexical, -slot_index)) as slot_index from lx group by all), {v.SLOTS.cte()},
f as (select mc.*, s.name as other from mc join bl using ("table", field, vt_id) join slots s using (vt_id, slot_index))
{_counted('all', [('rows', 'true'), ('both ways agree', 'top1_slot = other')], 'f')} union all {_counted('scores', [(n, f'top1_score >= {a} and top1_score < {b}') for n, a, b in _LEVELS], 'f')}
union all {_counted('statuses', [(s, f"status = '{s}'") for s in _STATUSES], 'f')} union all {_frequent('auto slots', "case when status = 'auto' then top1_slot end", 10, 'f')}
union all {_sampled('high', _SAMPLE, 'top1_score >= 0.85', 15, 'f')} union all {_sampled('low', _SAMPLE, 'top1_score < 0.40', 15, 'f')}"""
)
def s16_match_report(spark: SparkSession, sf: str) -> DataFrame:
    """The reports on scores and on decisions, gathered while matched columns are written."""
    best = ranking.top(lexical(spark, sf).withColumn("lexical", F.round("lexical", 6)), 1, _KEY, [F.col("lexical").desc(), F.col("slot_index")]).select(*_KEY, F.col("slot").alias("other"))
    rows = matched_columns(spark, sf).join(best, _KEY)
    score, said = F.col("top1_score"), F.concat("table", F.lit("."), "field", F.lit(" in "), "vt_id", F.lit(" is "), "top1_slot")
    counts = [("all", "both ways agree", F.col("top1_slot") == F.col("other"))] + [("scores", n, (score >= a) & (score < b)) for n, a, b in _LEVELS] + [("statuses", s, F.col("status") == s) for s in _STATUSES]
    samples = [("high", said, score >= 0.85, 15), ("low", said, score < 0.40, 15)]
    return reports.written(rows, workspace(spark, "matches"), reports.Report(counts, [("auto slots", F.when(F.col("status") == "auto", F.col("top1_slot")), 10)], samples))
