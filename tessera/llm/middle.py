"""Fill-in-middle training texts: a marker is injected behind every unit of a text and its ranked parts are cut out by it. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marker that is put behind units, and the sign that escapes both it and itself in the text.
MARK, ESCAPE = "\x1f", "\x1e"
#: A line with its end, or what comes after the last one.
LINES = r"[^\n]*\n|[^\n]+"
#: What introduces prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "m"))


def unescaped(text: Column) -> Column:
    """The text without marks, as it was before `escaped`."""
    return F.replace(F.replace(F.replace(text, F.lit(MARK), F.lit("")), F.lit(ESCAPE + "m"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def marked(text: Column, unit: str = LINES) -> Column:
    """The escaped text with a mark behind each match of unit. unit must match no empty string, no escaped sign in part, and cover whatever it is to count."""
    return F.regexp_replace(escaped(text), F.lit(f"(?:{unit})"), F.lit("$0" + MARK))


def count_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))


def _first(text: Column, k: Column) -> Column:
    """The first k units with what marks them."""
    return F.call_function("substring_index", text, F.lit(MARK), k.cast("int"))


def _hashes(doc_id: Column, seed: str, k: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(k)]


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: str = "7", unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: doc_id, n (units), form, output, prefix, middle, suffix. form is psm, spm or plain.

    Two cuts between units are drawn for each document from a hash of seed and doc_id; `rate` of 100 documents are reordered and `spm` of 100 of
    those as suffix, prefix, middle, the others as prefix, suffix, middle. A text stays plain, its parts null, where it is empty or null (then "") or
    holds a sentinel, since it could not be told from a reordered one. A null doc_id is drawn as an empty one; equal rows give equal rows. Other
    columns are ignored. Texts of any length are cut whole; an empty table gives no rows.
    """
    p, s, m = sentinels
    h = _hashes(F.col("doc_id"), seed, 4)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), marked(text, unit).alias("_marked")).select("doc_id", "_text", "_marked", count_marks(F.col("_marked")).cast("long").alias("n"))
    plain = (F.col("_text") == "") | (h[2] % 100 >= rate)
    for sign in sentinels:
        plain = plain | F.contains("_text", F.lit(sign))
    cuts = [x % (F.col("n") + 1) for x in h[:2]]
    rows = rows.select("doc_id", "n", "_text", "_marked", F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"), F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"))
    upto = _first(F.col("_marked"), F.col("_b"))
    some = F.col("form") != "plain"
    part = lambda x: F.when(some, unescaped(x))
    rows = rows.select(
        "doc_id", "n", "form", "_text",
        part(_first(F.col("_marked"), F.col("_a"))).alias("prefix"), part(_first(upto, F.col("_a") - F.col("_b"))).alias("middle"), part(_first(F.col("_marked"), F.col("_b") - F.col("n") - 1)).alias("suffix"),
    )
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm_ = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("_text"))
    return rows.select("doc_id", "n", "form", output.alias("output"), "prefix", "middle", "suffix")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from output and form alone: a reordered text holds each sentinel once."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1) if b else F.substring_index(output, a, -1)
    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
