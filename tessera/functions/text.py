"""Names, comments and samples of columns, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as an absent value among the samples of a column, as it is written.
NULL_TOKENS = ("", "null", "Null", "NULL", "NaN", "nan", "None", "\\N", "-", "--")
#: The words, lower-cased, that make a whole sample text empty.
EMPTY_WORDS = ("", "null", "nan", "none", "-")
PUNCTUATION = r"[\s,.;:!?/\\|()\[\]{}<>\"'_\-]+"


def tokens(name: Column) -> Column:
    """camelCase, snake_case and kebab-case names as lower-case words."""
    split = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[_\\-]+")
    return F.filter(split, lambda t: t != "")


def suffix_class(name: Column, suffixes: dict[str, str]) -> Column:
    """The class of the first suffix, in their order, that the name ends with; null if none."""
    out = F.lit(None).cast("string")
    for suffix, kind in reversed(suffixes.items()):
        out = F.when(F.endswith(F.lower(name), F.lit(suffix)), kind).otherwise(out)
    return out


def clean_comment(comment: Column) -> Column:
    """Without what is in brackets, cut at the first | or line break, trimmed."""
    plain = F.regexp_replace(F.coalesce(comment, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", "")
    return F.trim(F.substring_index(F.substring_index(plain, "|", 1), "\n", 1))


def concepts(comment: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the concepts any of whose keywords is in the comment, in their order."""
    hits = [F.when(_any(comment, words), F.lit(name)) for name, words in keywords.items()]
    return F.array_compact(F.array(*hits))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return F.coalesce(out, F.lit(False))


def bigrams(text: Column, whole: int = 3) -> Column:
    """Segments between punctuation: short ones whole, longer ones as their character pairs; each once, in order."""
    segments = F.filter(F.split(F.lower(text), PUNCTUATION), lambda s: s != "")
    pairs = lambda s: F.when(F.length(s) <= whole, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))
    return F.array_distinct(F.flatten(F.transform(segments, pairs)))


def samples(packed: Column, most: int = 5) -> Column:
    """The first values of a sample column packed with |."""
    parts = F.filter(F.transform(F.split(packed, r"\|"), lambda x: F.trim(x)), lambda s: s != "")
    return F.slice(parts, 1, most)


def blank_samples(packed: Column, absent: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Whether a sample column packed with | has no value, or absent ones only."""
    return F.coalesce(F.forall(F.split(packed, r"\|"), lambda s: F.trim(s).isin(*absent)), F.lit(True))


def empty_sample(packed: Column, absent: tuple[str, ...] = EMPTY_WORDS) -> Column:
    """Whether a sample text is nothing but separators, blanks and words for nothing, however they are written."""
    return F.coalesce(F.forall(F.split(F.lower(packed), r"[|\s]+"), lambda s: s.isin(*absent)), F.lit(True))


def token_set(text: Column) -> Column:
    """The lower-cased pieces of a text between separators, and the character pairs of its Chinese runs; each once. Null or empty: none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pieces = F.filter(F.split(low, "[\\s_\\-,，/、()（）:：]+"), lambda t: t != "")
    runs = F.filter(F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0)), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(pieces, pairs))


def lengths(values: Column) -> Column:
    """struct<shortest, longest, mean> of the lengths of the non-null values; mean to two digits."""
    size = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda x: F.length(x))
    mean = F.round(F.aggregate(size, F.lit(0), lambda a, b: a + b) / F.nullif(F.size(size), F.lit(0)), 2)
    return F.struct(F.array_min(size).alias("shortest"), F.array_max(size).alias("longest"), mean.alias("mean"))


def character_class(values: Column) -> Column:
    """digit, letter, cjk or mixed, of all values together; unknown without any of these."""
    text = F.array_join(values, "")
    digit, letter, cjk = text.rlike("[0-9]"), text.rlike("[A-Za-z]"), text.rlike("[一-鿿]")
    kinds = digit.cast("int") + letter.cast("int") + cjk.cast("int")
    return F.when(kinds > 1, "mixed").when(digit, "digit").when(letter, "letter").when(cjk, "cjk").otherwise("unknown")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 0 if either is empty or null."""
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(some, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection by union of two arrays of distinct elements; 0 if either is empty or null."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection by the smaller set; 0 if either is empty or null."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def glob_regex(glob: Column) -> Column:
    """A glob of *, ?, [seq] and [!seq] as an anchored regular expression, lower-cased. A bracket that isn't closed stands for itself, as does a ] first within one; a range whose ends are swapped holds nothing."""
    quoted = lambda x: F.regexp_replace(x, r"([!-/:-@\[-`{-~])", r"\\$1")

    def one(piece: Column) -> Column:
        negated = F.substring(piece, 2, 1) == "!"
        inner = F.when(negated, F.substring(piece, F.lit(3), F.length(piece) - 3)).otherwise(F.substring(piece, F.lit(2), F.length(piece) - 2))
        items = F.regexp_extract_all(inner, F.lit("(?s).-.|."), F.lit(0))
        kept = F.filter(items, lambda i: (F.length(i) < 3) | (F.substring(i, 1, 1) <= F.substring(i, 3, 1)))
        listed = F.array_join(F.transform(kept, lambda i: F.when(F.length(i) < 3, quoted(i)).otherwise(F.concat(quoted(F.substring(i, 1, 1)), F.lit("-"), quoted(F.substring(i, 3, 1))))), "")
        class_ = F.when(listed == "", F.when(negated, ".").otherwise("(?!)")).otherwise(F.concat(F.when(negated, "[^").otherwise("["), listed, F.lit("]")))
        return F.when(F.length(piece) > 1, class_).when(piece == "*", ".*").when(piece == "?", ".").otherwise(quoted(piece))

    pieces = F.regexp_extract_all(F.lower(glob), F.lit(r"(?s)\[!?+\]?+[^\]]*+\]|."), F.lit(0))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(pieces, one), ""), F.lit(r"\z"))


def badly_named(name: Column, syllables: list[str], share: float = 0.6) -> Column:
    """Not snake_case, or at least two words of which `share` are bare syllables."""
    words = tokens(name)
    bare = F.size(F.filter(words, lambda w: w.isin(*syllables)))
    return ~name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$") | ((F.size(words) >= 2) & (bare / F.size(words) >= share))


def fenced_json(answer: Column, schema: str) -> Column:
    """The parsed JSON object of an answer, with or without a code fence around it; null if it is malformed."""
    return F.from_json(F.trim(F.regexp_replace(answer, r"^\s*```[a-z]*\s*|\s*```\s*$", "")), schema)


def weighted_text(parts: list[tuple[Column, int]]) -> Column:
    """Texts joined by blanks, each as often as its weight; blank ones are left out."""
    pieces = [F.array_repeat(F.when(F.trim(text) != "", F.trim(text)), n) for text, n in parts]
    return F.array_join(F.array_compact(F.flatten(F.array(*pieces))), " ")
