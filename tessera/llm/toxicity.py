"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels, noisy-or joins them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.durable import settled
from tessera.llm.textkit import FOLD, U64, buffers, chunks, released, words

#: Words are hashed to so many features; the model is a weight for each, so its broadcast has a fixed size (1 MB).
BITS = 18
#: At most so many labelled documents, and so many bytes of their texts, are used for fitting: the first in a hash order of ids.
FIT_DOCS, FIT_BYTES = 8000, 64 << 20
#: Words are runs of ASCII letters, apostrophes and bytes of other scripts.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
ENDERS = np.zeros(256, bool)
ENDERS[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def instances(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, ...]:
    """(feature of each word, its sentence; text, first byte and end of each sentence). Sentences end at . ! ? or a new line, and with the text; those without words don't count."""
    hashed, starts, ends, text = words(data, offsets, NOT_WORD, FOLD)
    feature = (hashed >> U64(64 - bits)).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(ENDERS[data])])[starts] if len(data) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sentence = np.cumsum(new) - 1
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return feature, sentence, text[first], starts[first], ends[last] if len(first) else first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _featured(docs: DataFrame, bits: int) -> DataFrame:
    """(label, sizes of sentences, distinct features of each sentence) of (text, label)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(0)):
                feature, sentence, text, _, _ = instances(data, offsets, bits)
                pairs = np.unique(sentence << bits | feature)
                owner = pairs >> bits
                per = np.bincount(owner, minlength=len(text)).astype(np.int32)
                feats = (pairs & ((1 << bits) - 1)).astype(np.int32)
                at = np.searchsorted(text, np.arange(len(offsets)))
                ends = np.concatenate([[0], np.cumsum(per)])[at]
                rows = range(len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(rows)), pa.array([per[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([feats[ends[i] : ends[i + 1]].tobytes() for i in rows], pa.binary())],
                    ["label", "sizes", "features"],
                )

    return docs.mapInArrow(work, "label int, sizes binary, features binary")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES, bits: int = BITS, steps: int = 160, least: int = 4, penalty: float = 0.5) -> Model:
    """Weights of words such that 1 - product(1 - sigmoid(sentence)) fits the labels of documents; no sentence carries a label.

    labels has doc_id and label (0 or 1; null and repeated rows are skipped). The fit takes at most fit_docs labelled documents, the first in
    a hash order of ids as far as their texts have fit_bytes together, so that it is the same on every run. Of rows that repeat an id the one with the least text is taken. penalty is that of each
    word's absolute weight, against one document's loss. Words in fewer than `least` of them have no weight. Without any labelled
    document of either class the model scores everything near its bias.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    )  # fit_docs bounds the rows, so this side can be broadcast
    size = F.octet_length(F.coalesce("text", F.lit("")))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(size <= fit_bytes).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = settled(found.withColumn("size", size.cast("long")))
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= fit_bytes).select("doc_id")  # of fit_docs rows
    rows = _featured(found.join(F.broadcast(within), "doc_id").select("text", "label"), bits).toArrow().combine_chunks()
    if not rows.num_rows:
        return Model(np.zeros(1 << bits, np.float32), -6.0)
    rows = rows.sort_by([("features", "ascending"), ("sizes", "ascending"), ("label", "ascending")])
    y = rows["label"].to_numpy().astype(float)
    data, offsets = buffers(rows["sizes"])
    per = np.frombuffer(data.tobytes(), np.int32)
    text = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(offsets) // 4)
    feats = np.frombuffer(buffers(rows["features"])[0].tobytes(), np.int32)
    del rows, data
    sentence = np.repeat(np.arange(len(per), dtype=np.int32), per)
    pairs = np.unique(text[sentence].astype(np.int64) << bits | feats)
    often = np.bincount(pairs & ((1 << bits) - 1), minlength=1 << bits)
    toxic = np.bincount(pairs & ((1 << bits) - 1), weights=y[pairs >> bits], minlength=1 << bits)
    del pairs
    keep = often[feats] >= least
    feats, sentence = feats[keep], sentence[keep]
    used = np.flatnonzero(np.bincount(feats, minlength=1 << bits))
    place = np.zeros(1 << bits, np.int32)
    place[used] = np.arange(len(used))
    at = place[feats]
    # Start from each word's log odds, shrunk by its count; the steps then take the words apart that only stand beside others.
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    odds = np.log((toxic[used] + rate * 10) / (often[used] - toxic[used] + (1 - rate) * 10)) - np.log(rate / (1 - rate))
    w, b = np.maximum(odds, 0.0) * 1.5 * (odds > 0.7), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(sentence, weights=w[at], minlength=len(per))
        s = _sigmoid(z)
        clean = np.bincount(text, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=len(y))
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        pull = np.where(y > 0.5, -(1 - p) / p, 1.0)[text] * s / len(y)
        g = np.bincount(at, weights=pull[sentence], minlength=len(w)) + (penalty * np.sign(w) + 0.02 * w) / len(y)
        gb = pull.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate_t = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w = w - rate_t * m / (np.sqrt(v) + 1e-9)
        b = b - rate_t * mb / (np.sqrt(vb) + 1e-9)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def _scores(data: np.ndarray, offsets: np.ndarray, w: np.ndarray, bias: float) -> tuple[np.ndarray, ...]:
    """(score of each text; score, text, first byte and end of each sentence)."""
    bits, n = len(w).bit_length() - 1, len(offsets) - 1
    feature, sentence, text, start, end = instances(data, offsets, bits)
    some = w[feature] != 0
    pairs = np.unique(sentence[some] << bits | feature[some])
    s = _sigmoid(bias + np.bincount(pairs >> bits, weights=w[pairs & ((1 << bits) - 1)].astype(float), minlength=len(text)))
    found = -np.expm1(np.bincount(text, weights=np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=n))
    return np.clip(found, 0, 1), s, text, start, end


def score(docs: DataFrame, model: Model, flag_at: float = 0.3) -> DataFrame:
    """(doc_id, score, offending) of every row: the noisy-or of its sentences and those of them that reach flag_at.

    offending is array<struct<start, length, score>>, places in UTF-8 bytes of the text, in order. A null text or one without words has
    score 0 and no sentences. Each word counts once in a sentence. Repeated and null ids stay; other columns than doc_id and text are ignored.
    """
    bias, shared = model.bias, docs.sparkSession.sparkContext.broadcast(model.weights)
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                found, s, text, start, end = _scores(data, offsets, shared.value, bias)
                n, bad = len(found), np.flatnonzero(s >= flag_at)
                at = np.searchsorted(text[bad], np.arange(n + 1)).astype(np.int32)
                inner = pa.StructArray.from_arrays([pa.array(start[bad] - offsets[text[bad]]), pa.array(end[bad] - start[bad]), pa.array(s[bad])], ["start", "length", "score"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(found), pa.ListArray.from_arrays(pa.array(at), inner).cast(span)], ["doc_id", "score", "offending"])
        released()

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, offending array<struct<start: bigint, length: bigint, score: double>>")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below threshold. Rows without text score 0 and stay.

    Only the texts go to Python and only scores come back.
    """
    bias, shared = model.bias, docs.sparkSession.sparkContext.broadcast(model.weights)

    def scores(texts: pa.Array) -> pa.Array:
        found = [_scores(data, offsets, shared.value, bias)[0] for _, data, offsets in chunks(texts)]
        released()
        return pa.array(np.concatenate([*found, np.zeros(0)]))

    return docs.where(F.arrow_udf(scores, "double")(F.col("text")) < threshold)


def predicted(score: Column, threshold: float = 0.3) -> Column:
    return (score >= threshold).cast("int")
