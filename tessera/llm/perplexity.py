"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted documents and joined shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import frozen, thawed
from tessera.llm.durable import settled
from tessera.llm.textkit import chunks, released
from tessera.operators.joins import small

#: Characters are UTF-16 units, so an n-gram of up to four is one 64-bit number: context = n-gram >> 16, and its lower units are the suffix.
ORDER = 4
#: Stands before the text, three times. Units 0 and 1 of a text count as 2.
START = 1
#: Documents and bytes of a block, on average. A block asks once for each n-gram it has.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: One trusted document in so many, by a hash of its id, is kept from training and sets the thresholds.
CALIBRATION = 8


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram that ends at each unit, its text) of texts in a row, each behind START units."""
    units = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16)
    size = ((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0)
    at = np.concatenate([[0], np.cumsum(size)])[offsets]
    units = np.maximum(units, 2).astype(np.uint64)
    padded = np.insert(units, np.repeat(at[:-1], ORDER - 1), np.uint64(START))
    code = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:] if len(padded) > 3 else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at) + ORDER - 1)[3:]
    first = at[:-1] + (ORDER - 1) * np.arange(len(at) - 1)
    real = np.ones(len(padded), bool)
    for i in range(ORDER - 1):
        real[first + i] = False
    real = real[3:]
    return code[real].view(np.int64), text[real]


def _blobs(docs: DataFrame) -> DataFrame:
    """(block, docs binary) of rows (block, doc_id, text, lang): rows of each block, compressed together as far as they come in one batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            names, at = np.unique(number[order], return_index=True)
            rows = batch.select(batch.schema.names[1:])
            for name, some in zip(names.tolist(), np.split(order, at[1:])):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([frozen(pa.Table.from_batches([rows]).take(pa.array(some)).combine_chunks())], pa.binary())], ["block", "docs"])
        released()

    return docs.select("block", "doc_id", "text", "lang").mapInArrow(work, "block long, docs binary")


def _dealt(docs: DataFrame, trusted: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(docs, trusted) with the number of their block, by a hash of the id.

    Rows without an id, and those of an id with more rows than a block takes, go round by row number instead, and a trusted one of these ids
    is told to all the blocks it is in. Which block a row is in changes no result.
    """
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    count = max(size.rows // block, (size.bytes or 0) // BLOCK_BYTES) + 1
    hot = settled(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows")).where(F.col("rows") > block).select("doc_id", F.ceil(F.col("rows") / block).cast("long").alias("spread")))
    home, turn = F.pmod(F.xxhash64("doc_id"), F.lit(count)), F.monotonically_increasing_id()
    if hot.isEmpty():
        return docs.withColumn("block", F.when(F.col("doc_id").isNull(), F.pmod(turn, F.lit(count))).otherwise(home)), trusted.withColumn("block", home)
    hot = small(hot)
    rows = docs.join(hot, "doc_id", "left").withColumn("block", F.when(F.col("doc_id").isNull(), F.pmod(turn, F.lit(count))).otherwise(F.pmod(home + F.pmod(turn, F.coalesce("spread", F.lit(1))), F.lit(count))))
    told = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.coalesce("spread", F.lit(1)), F.lit(count)) - 1))
    good = trusted.join(hot, "doc_id", "left").select("doc_id", told.alias("turn")).select("doc_id", F.pmod(home + F.col("turn"), F.lit(count)).alias("block"))
    return rows.drop("spread"), good


def _count_block(there: pa.Table, trusted: pa.Table) -> pa.Table:
    """All n-grams of a block, each with how often trusted documents have it."""
    good = trusted["doc_id"].combine_chunks() if trusted.num_rows else pa.array([], pa.int64())
    seen, counted = np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for blob in there["docs"] if there.num_rows else ():
        docs = thawed(blob.as_buffer())
        ours = pa.compute.is_in(docs["doc_id"].combine_chunks(), value_set=good).to_numpy(zero_copy_only=False)
        for first, data, offsets in chunks(docs["text"].combine_chunks()):
            code, text = gram_codes(data, offsets)
            seen = np.union1d(seen, np.unique(code))
            got, n = np.unique(code[ours[first + text]], return_counts=True)
            both, at = np.unique(np.concatenate([counted[0], got]), return_inverse=True)
            counted = both, np.bincount(at, weights=np.concatenate([counted[1], n]), minlength=len(both)).astype(np.int64)
    n = np.zeros(len(seen), np.int64)
    n[np.searchsorted(seen, counted[0])] = counted[1]
    block = there["block"][0].as_py() if there.num_rows else 0
    released()
    return pa.table([pa.array(np.full(len(seen), block)), pa.array(seen), pa.array(n)], names=["block", "gram", "n"])


def _score_block(there: pa.Table, known: pa.Table) -> pa.Table:
    """Mean log probability of a unit for each document of a block."""
    names, kinds = ["doc_id", "lang", "n_units", "log_prob"], (pa.int64(), pa.string(), pa.int64(), pa.float64())
    order = np.argsort(known["gram"].to_numpy(), kind="stable") if known.num_rows else np.zeros(0, np.int64)
    grams, values = (known[c].to_numpy()[order] if known.num_rows else np.zeros(0) for c in ("gram", "log_prob"))
    out = [pa.table([pa.array([], k) for k in kinds], names=names)]
    for blob in there["docs"] if there.num_rows else ():
        docs = thawed(blob.as_buffer()).combine_chunks()
        for first, data, offsets in chunks(docs["text"].combine_chunks()):
            code, text = gram_codes(data, offsets)
            n = len(offsets) - 1
            units = np.bincount(text, minlength=n)
            total = np.bincount(text, weights=values[np.searchsorted(grams, code)], minlength=n) if len(code) else np.zeros(n)
            mean = total / np.maximum(units, 1)
            out.append(pa.table([docs["doc_id"].slice(first, n).combine_chunks(), docs["lang"].slice(first, n).combine_chunks().cast(pa.string()), pa.array(units), pa.array(mean, mask=units == 0)], names=names))
    released()
    return pa.concat_tables(out).combine_chunks()


def _suffix(gram: Column, units: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * units) - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many n-grams have count 1, 2, 3 and 4; 0.5, 1 and 1.5 where these say nothing."""
    row = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [row[f"n{i}"] or 0 for i in range(1, 5)]
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return tuple(d if 0 < d <= i + 1 else (i + 1) / 2 for i, d in enumerate(found))


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, log_prob) for every 4-gram of wanted: interpolated modified Kneser-Ney from counts (gram, n) of trusted text.

    The lower orders count in how many longer n-grams theirs is the suffix. Every table is joined by its n-gram, so each join is sharded by
    it and none of them has to fit anywhere whole. Without any counts all n-grams are equally likely.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = settled(tables[order + 1].groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n")))
    types = tables[1].count()
    out = wanted.withColumn("p", F.lit(1.0 / (types + 1)))
    for order in range(1, ORDER + 1):
        d = discounts(tables[order])
        n = F.col("n")
        cut = F.when(n == 1, F.lit(d[0])).when(n == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        stats = tables[order].groupBy(F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("spare"))
        held = tables[order].select(F.col("gram").alias("part"), (n - cut).alias("left"))
        out = out.withColumn("part", _suffix(F.col("gram"), order) if order < ORDER else F.col("gram")).withColumn("context", F.shiftrightunsigned("part", 16))
        out = out.join(held, "part", "left").join(stats, "context", "left")
        out = out.select("gram", F.when(F.col("total").isNull(), F.col("p")).otherwise((F.coalesce("left", F.lit(0.0)) + F.col("spare") * F.col("p")) / F.col("total")).alias("p"))
        out = settled(out)
    return out.select("gram", F.log("p").alias("log_prob"))


def perplexities(docs: DataFrame, trusted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang, n_units, perplexity) of every row: that of its whole text by a model of the texts of trusted (doc_id).

    Documents are dealt into blocks. A block asks once for each n-gram that it has, counts those of its trusted documents on the
    way, and gets their probabilities back. Two texts of the same row count twice; a null or empty text has no perplexity. A null id is
    never trusted. Columns other than doc_id, text and lang are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    good = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows, good = _dealt(docs, good, block)
    blobs = _blobs(rows)
    counted = settled(blobs.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_count_block, "block long, gram long, n long"))
    grams = settled(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    table = probabilities(settled(grams.where("n > 0")), grams.select("gram"))
    answers = counted.select("block", "gram").join(table, "gram").select("block", "gram", "log_prob")
    scored = blobs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block, "doc_id long, lang string, n_units long, log_prob double")
    return scored.select("doc_id", "lang", "n_units", F.exp(-F.col("log_prob")).alias("perplexity"))


def calibrates(doc_id: Column) -> Column:
    """Whether a trusted document is kept from training, to set thresholds."""
    return F.crc32(doc_id.cast("string")) % CALIBRATION == 0


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.98, slack: float = 1.25, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang, n_units, perplexity, threshold, keep): keep is whether the perplexity is at most the threshold of the document's language.

    One trusted document in CALIBRATION is kept from training. A language's threshold is the given quantile of the perplexities of those, to
    three digits after the point; a language without any, null included, takes that of all of them. Where no such document has a text at all,
    the quantile of the documents that trained the model counts, times slack, as the model knows these better than others. Without trusted
    documents nothing is rejected. A text without perplexity is not kept.
    """
    trusted = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    scored = settled(perplexities(docs, trusted.where(~calibrates(F.col("doc_id"))), block))
    ours = scored.join(trusted, "doc_id", "left_semi").where("perplexity is not null").withColumn("held", calibrates(F.col("doc_id")))
    cut = lambda some: F.percentile_approx(F.when(some, F.round("perplexity", 3)), quantile, 100000)
    found = small(settled(ours.where("held and lang is not null").groupBy("lang").agg(cut(F.col("held")).alias("own"))))
    any_ = ours.agg(cut(F.col("held")).alias("any"), cut(~F.col("held")).alias("seen"))  # one row
    scored = scored.join(found, "lang", "left").crossJoin(F.broadcast(any_))
    threshold = F.coalesce("own", "any", F.col("seen") * slack)
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.round("perplexity", 3) <= threshold, F.lit(True))
    return scored.select("doc_id", "lang", "n_units", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
