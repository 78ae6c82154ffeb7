"""Recorded answers of a language model: asking once more with what was wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.files import cache_key

SLOTS = "slots array<struct<name: string, `from`: string>>"


def prompt_key(prompt: Column, issues: Column | None = None) -> Column:
    """The key under which an answer is recorded: that of the prompt, and for a second try also of the names that were wrong."""
    return cache_key({"prompt": prompt} if issues is None else {"prompt": prompt, "issues": F.array_join(issues, ",")})


def _linted(rows: DataFrame, syllables: list[str], n: int) -> DataFrame:
    """With the names of answer n (null if it can't be read) and those of its extended slots that are badly named, in order."""
    slots = text.fenced_json(F.col(f"answer{n}"), SLOTS).getField("slots")
    bad = F.filter(slots, lambda s: (F.coalesce(s["from"], F.lit("extended")) != "base") & text.badly_named(F.coalesce(s["name"], F.lit("")), syllables))
    return rows.withColumns({f"names{n}": F.transform(slots, lambda s: F.coalesce(s["name"], F.lit(""))), f"issues{n}": F.array_distinct(F.transform(bad, lambda s: F.coalesce(s["name"], F.lit(""))))})


def with_feedback(asked: DataFrame, answers: DataFrame, item: str, syllables: list[str]) -> DataFrame:
    """(item, outcome, names, warnings) of what is asked (item, prompt) by recorded answers (key, answer), each asked twice at most.

    A first answer without badly named slots is accepted. Otherwise the answer recorded for the prompt with these names is asked for and kept: corrected
    if it has none, else warned, with its bad names as warnings. Where no readable second answer is recorded the first one is kept, warned of its own. Without a readable
    first answer an item is unanswered and has no names. Names of base slots aren't looked at. Of several answers under one key the least counts.
    """
    known = answers.where("answer is not null").groupBy("key").agg(F.min("answer").alias("answer"))
    reply = lambda n: known.select(F.col("key").alias(f"key{n}"), F.col("answer").alias(f"answer{n}"))
    one = _linted(asked.select(item, "prompt", prompt_key(F.col("prompt")).alias("key1")).join(reply(1), "key1", "left"), syllables, 1)
    again = F.when(F.size("issues1") > 0, prompt_key(F.col("prompt"), F.col("issues1")))
    two = _linted(one.withColumn("key2", again).join(reply(2), "key2", "left"), syllables, 2)
    read1, read2 = F.col("names1").isNotNull(), F.col("names2").isNotNull()
    clean = F.size("issues1") == 0
    outcome = F.when(~read1, "unanswered").when(clean, "accepted").when(read2 & (F.size("issues2") == 0), "corrected").otherwise("warned")
    second = read1 & ~clean & read2
    none = F.array().cast("array<string>")
    return two.select(item, outcome.alias("outcome"), F.coalesce(F.when(second, F.col("names2")).otherwise(F.col("names1")), none).alias("names"), F.coalesce(F.when(second, F.col("issues2")).otherwise(F.col("issues1")), none).alias("warnings"))
