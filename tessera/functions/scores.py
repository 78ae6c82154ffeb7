"""Scores of a column against a slot, and what is decided from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_score(found: Column, wanted: Column, neighbours: Column) -> Column:
    """0.5 if either side is empty, 1 for a common pattern, 0.5 for neighbouring ones, else 0.1. neighbours: patterns next to those found."""
    return F.when((F.size(found) == 0) | (F.size(wanted) == 0), 0.5).when(F.arrays_overlap(found, wanted), 1.0).when(F.arrays_overlap(neighbours, wanted), 0.5).otherwise(0.1)


def context_score(kind: Column, applicable: Column, role: Column, bonus: dict[tuple[str, str], float], together: Column) -> Column:
    """0.3 if the table type is applicable, 0.15 if none is stated, plus the bonus of (type, role) and 0.2 if the slot's companions are there; at most 1."""
    base = F.when(F.size(applicable) == 0, 0.15).when(F.array_contains(applicable, kind), 0.3).otherwise(0.0)
    extra = F.lit(0.0)
    for (t, r), x in bonus.items():
        extra = F.when((kind == t) & (role == r), x).otherwise(extra)
    return F.least(F.lit(1.0), base + extra + F.when(together, 0.2).otherwise(0.0))


def usage_score(counts: dict[str, tuple[Column, Column]], weights: dict[str, float]) -> Column:
    """Weighted sum of log1p(count) / log1p(largest), each at most 1; a largest of 0 or null counts as 1."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        count, most = counts[name]
        top = F.when(F.coalesce(most, F.lit(0.0)) > 0, most).otherwise(F.lit(1.0))
        out = out + weight * F.least(F.lit(1.0), F.log1p(F.coalesce(count, F.lit(0.0))) / F.log1p(top))
    return out


#: Fixed weights of the five factors.
FACTORS = {"lexical": 0.30, "pattern": 0.20, "context": 0.15, "usage": 0.10, "semantic": 0.25}


def total_score(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in FACTORS.items():
        out = out + weight * parts[name]
    return out


# The thresholds of status, role_conflict, near_duplicate and mapping_type.


def status(top: Column, second: Column) -> Column:
    """conflict, auto, review or low, from the best two scores; a missing second counts as 0."""
    gap = top - F.coalesce(second, F.lit(0.0))
    return F.when((gap < 0.05) & (top >= 0.45), "conflict").when((top >= 0.65) & (gap >= 0.10), "auto").when(top >= 0.45, "review").otherwise("low")


def role_conflict(top: Column, second: Column, role: Column, other: Column) -> Column:
    return (top >= 0.50) & (second >= 0.50) & (top - second < 0.05) & (role != other)


def near_duplicate(top: Column, second: Column) -> Column:
    return (top >= 0.60) & (second >= 0.60) & (top - second < 0.05)


def fallback(conflict: Column, blank: Column, samples_blank: Column, low: Column) -> Column:
    """Why a decision needs a second opinion: D conflicts, A no comment, C no samples, B a low score; the first that holds."""
    return F.when(conflict, "D").when(blank, "A").when(samples_blank, "C").when(low, "B")


def tier(role: Column, first: Column, name: Column, sources: Column) -> Column:
    return F.when((role == "key") | first | (name == "source_system"), "essential").when(sources >= 3, "frequent").otherwise("optional")


def mapping_type(trigger: Column, score: Column) -> Column:
    return F.when(trigger == "B", "adjusted").when(score >= 0.65, "direct").otherwise("synonym_best")


def failure_type(hit: Column, recall: Column, slot: Column, mapped: Column, intent: Column) -> Column:
    """Why a question missed its tables, the first that holds; for a hit whether it was whole."""
    return F.when(hit, F.when(recall >= 1, "ok").otherwise("partial_coverage")).when(~slot, "missing_slot").when(~mapped, "unmapped_field").when(~intent, "intent_miss").otherwise("other")


def suggested_action(strong: Column, tables: Column, name: Column) -> Column:
    prefix = F.substring_index(name, "_", 1)
    return F.when(strong & (tables >= 2), F.when(F.contains(name, F.lit("_")), F.concat(prefix, F.lit("_*"))).otherwise(name)).when(tables >= 2, name).otherwise(F.lit("pair"))


def first_matching(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first class one of whose keywords is in the text."""
    out = F.lit(default)
    for kind, words in reversed(rules.items()):
        any_ = F.lit(False)
        for w in words:
            any_ = any_ | F.contains(F.lower(text), F.lit(w))
        out = F.when(any_, kind).otherwise(out)
    return out


def rule_score(rules: list[tuple[str, Column, float]], most: float = 1.0) -> tuple[Column, Column]:
    """(score, reasons): the sum of the weights of the rules that hold, at most `most`, and their names."""
    total = F.lit(0.0)
    for _, holds, weight in rules:
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(F.lit(most), total), F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds, _ in rules]))
