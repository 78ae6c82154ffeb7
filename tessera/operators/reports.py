"""Reports that are gathered while a table is written: counts, the most frequent values and samples of its rows, in the one pass that writes them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Values that a sketch of the most frequent ones tracks: counts are exact while a column has no more than three quarters of that, and estimates beyond.
TRACKED, LISTED = 10_000, 1_000


@dataclass(frozen=True)
class Report:
    """What is asked of a table. counts: (section, item, condition). tops: (section, value, how many), nulls don't count. samples: (section, text, condition, how many)."""

    counts: list[tuple[str, str, Column]] = field(default_factory=list)
    tops: list[tuple[str, Column, int]] = field(default_factory=list)
    samples: list[tuple[str, Column, Column, int]] = field(default_factory=list)


def written(df: DataFrame, path: str, report: Report) -> DataFrame:
    """Writes df as Parquet to path and gives (section, item, n, share) of the report, share of all rows; counts of 0 are lines too, samples have null in n and share.

    A sample is the least text of each of `how many` buckets by md5 of the text, so it is bounded, the same on every run, and empty buckets have none. Of
    most frequent values equal counts go by value. The report is a few rows, whatever the table.
    """
    seen, wanted = Observation(), [F.count("*").alias("all")]
    wanted += [F.count_if(F.coalesce(condition, F.lit(False))).alias(f"c{i}") for i, (_, _, condition) in enumerate(report.counts)]
    for i, (_, value, _) in enumerate(report.tops):
        df = df.withColumn(f"__top{i}", value.cast("string"))
        wanted.append(F.expr(f"approx_top_k(__top{i}, {LISTED}, {TRACKED})").alias(f"t{i}"))
    for i, (_, text, condition, n) in enumerate(report.samples):
        bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n
        wanted += [F.min(F.when(condition & (bucket == b), text)).alias(f"s{i}_{b}") for b in range(n)]
    out = df.observe(seen, *wanted)
    out.drop(*[f"__top{i}" for i in range(len(report.tops))]).write.parquet(path)
    got = seen.get
    share = lambda n: n / got["all"] if got["all"] else 0.0
    rows = [("all", "rows", got["all"], share(got["all"]))] + [(s, item, got[f"c{i}"], share(got[f"c{i}"])) for i, (s, item, _) in enumerate(report.counts)]
    for i, (section, _, n) in enumerate(report.tops):
        best = sorted((-r["count"], r["item"]) for r in got[f"t{i}"] or [] if r["item"] is not None)[:n]
        rows += [(section, item, -count, share(-count)) for count, item in best]
    for i, (section, _, _, n) in enumerate(report.samples):
        rows += [(section, got[f"s{i}_{b}"], None, None) for b in range(n) if got[f"s{i}_{b}"] is not None]
    return df.sparkSession.createDataFrame(rows, "section string, item string, n long, share double")
