"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import U64, chunks, released, splitmix

DIM = 512
GRAM = 3
#: Texts and n-grams whose counts are multiplied with vectors at once, so that dense arrays have a fixed size whatever the alphabet.
TEXTS, GRAMS = 64, 8192
#: Letters lie below this code point; above are private and unassigned planes.
_TOP = 0x32400


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.int64)
    for i in range(_TOP):
        if (c := chr(i)).isalpha():
            table[i] = ord(low) if len(low := c.lower()) == 1 else i
    return table


@lru_cache(4096)
def _letter(code: int, dim: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter; 0 stands for the gap between words."""
    words = splitmix((U64(code) << U64(20)) + np.arange(dim // 64, dtype=U64))
    return (np.unpackbits(words.view(np.uint8)).astype(np.int8) << 1) - 1


def bound(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row for each n-gram (a row of letters): its letters' vectors, each rotated by its place, multiplied together."""
    alphabet, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    vectors = np.stack([_letter(int(c), dim) for c in alphabet])
    out = np.ones((len(grams), dim), np.int8)
    for place in range(grams.shape[1]):
        out *= np.roll(vectors, grams.shape[1] - 1 - place, axis=1)[at[:, place]]
    return out


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams; text, n-gram and number of each pair that occurs, by text; letters of each text). A text is lower-cased letters; whatever is between counts as one gap."""
    texts = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = _letters()[points]
    letters = np.add.reduceat(np.append(low > 0, False), np.minimum(heads[:-1], len(low))) * (np.diff(heads) > 0)
    low = np.append(np.insert(low, heads[:-1], 0), 0)
    fresh = np.zeros(len(low), bool)
    fresh[heads[:-1] + np.arange(texts)] = True  # the gap before each text
    keep = fresh | (low > 0)
    keep[1:] |= low[:-1] > 0
    low, fresh = low[keep], fresh[keep]
    keep = np.ones(len(low), bool)
    keep[:-1] = ~(fresh[1:] & (low[:-1] == 0) & ~fresh[:-1])  # of a gap at the end of a text and that before the next, one
    low, fresh = low[keep], fresh[keep]
    if len(low) < GRAM:
        none = np.zeros(0, np.int64)
        return np.zeros((0, GRAM), np.int64), none, none, none, letters
    present = np.flatnonzero(np.bincount(low))
    place = np.zeros(present[-1] + 1, np.int64)
    place[present] = np.arange(len(present))
    low, n = place[low], len(present)
    code = (low[:-2] * n + low[1:-1]) * n + low[2:]
    text = (np.cumsum(fresh) - 1)[:-2]
    inside = ~fresh[1:-1]
    code, text = code[inside], text[inside]
    if n**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(code, minlength=1))
        index = np.zeros(n**3, np.int64)
        index[used] = np.arange(len(used))
        at = index[code]
    else:
        used, at = np.unique(code, return_inverse=True)
    pair = text * len(used) + at
    if texts * len(used) <= 1 << 22:
        dense = np.bincount(pair, minlength=1)
        pair = np.flatnonzero(dense)
        count = dense[pair]
    else:
        pair, count = np.unique(pair, return_counts=True)
    return present[np.stack([used // (n * n), used // n % n, used % n], axis=1)], pair // max(1, len(used)), pair % max(1, len(used)), count, letters


def bundles(grams: np.ndarray, text: np.ndarray, gram: np.ndarray, count: np.ndarray, texts: int, dim: int = DIM) -> np.ndarray:
    """For each text the sum of its n-grams' bound vectors. Exact: all of it is whole numbers."""
    out = np.zeros((texts, dim))
    at = np.searchsorted(text, np.arange(0, texts + TEXTS, TEXTS))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        used, column = np.unique(gram[a:b], return_inverse=True)
        rows, order = min(TEXTS, texts - i * TEXTS), np.argsort(column, kind="stable")
        cuts = np.searchsorted(column[order], np.arange(0, len(used) + GRAMS, GRAMS))
        for j, (c, d) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            some, width = order[c:d], min(GRAMS, len(used) - j * GRAMS)
            tile = np.zeros((rows, width))
            tile[text[a:b][some] - i * TEXTS, column[some] - j * GRAMS] = count[a:b][some]
            out[i * TEXTS : i * TEXTS + rows] += tile @ bound(grams[used[j * GRAMS : j * GRAMS + width]], dim).astype(np.float64)
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """The prototype of each language: the bundle (sum) of the n-gram vectors of all its texts, less what all languages share.

    Every row with a non-null lang counts. Tasks add up whole-number vectors, so the result doesn't depend on their order; the driver gets
    dim numbers a language. An empty table gives no prototypes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for first, data, offsets in chunks(batch.column(0)):
                grams, of, gram, count, _ = gram_counts(data, offsets)
                if not len(grams):
                    continue
                told, group = np.unique(names[first : first + len(offsets) - 1], return_inverse=True)
                order = np.argsort(group[of] * len(grams) + gram, kind="stable")
                pair, head = np.unique((group[of] * len(grams) + gram)[order], return_index=True)
                sums_ = bundles(grams, pair // len(grams), pair % len(grams), np.add.reduceat(count[order], head), len(told), dim)
                for name, bundle in zip(told.tolist(), sums_):
                    sums[name] = sums.get(name, 0) + bundle
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])
        released()

    parts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(work, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("bundle"))
    found = {r.lang: np.array([x.value for x in r.bundle]) for r in sums.orderBy("lang").collect()}
    units = {k: v / (np.linalg.norm(v) or 1.0) for k, v in found.items()}
    common = np.mean(list(units.values()), axis=0) if len(units) > 1 else 0.0
    return {k: (v - common) / (np.linalg.norm(v - common) or 1.0) for k, v in units.items()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """(doc_id, lang_pred, score) of every row by its text alone: the language whose prototype has the largest cosine with the text's vector.

    score is the cosine moved to 0..1. A null text, one without letters, or no prototypes at all: `und` with score 0. Ties go to the first
    language in code point order. Repeated and null ids stay as they are; columns other than doc_id and text are ignored.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, dim))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1), 1 << 19):
                grams, *triples, letters = gram_counts(data, offsets)
                told, score = np.full(len(letters), "und", object), np.zeros(len(letters))
                if len(grams) and names:
                    vectors = bundles(grams, *triples, len(letters), dim)
                    norms = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ matrix.T) / np.maximum(norms, 1e-9)[:, None]
                    some = letters > 0
                    told[some] = np.array(names, object)[cosine.argmax(axis=1)][some]
                    score[some] = np.clip((1 + cosine.max(axis=1)) / 2, 0, 1)[some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(letters)), pa.array(told, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        released()

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))
