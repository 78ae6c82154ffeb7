"""Hard negatives, fill-in-middle texts and token-id files against brute force."""

import math
import os
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import huffman, middle, negatives, queries
from tests.llm.test_queries import SF, documents, odd  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_fill_in_middle"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# Hard negatives


def mined(rows, anchors, positives=5, negatives_=3):
    """rows: (vec_id, vector, label), usable and distinct."""
    rows = [(i, [math.floor(256 * v) for v in x], label) for i, x, label in rows]
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for a, x, label in rows:
        if a is None or not anchors(a):
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y))
        others = sorted((-score(y), last(i), other, i) for i, y, other in rows if (i, y, other) != (a, x, label))
        for minus, _, _, p in [o for o in others if o[2] == label][:positives]:
            fits = [o for o in others if o[2] != label and 50 * -minus <= 100 * -o[0] <= 95 * -minus][:negatives_]
            out.update((a, p, k, n[3], -minus, -n[0]) for k, n in enumerate(fits, 1))
    return out


def usable(rows):
    seen = {}
    for i, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            seen.setdefault((i, tuple(np.pad(np.float32(x), (0, 8 - len(x))).tolist()), label))
    return list(seen)


def test_op11(spark, odd):  # noqa: F811
    table = spark.read.parquet(f"{odd}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id is not None and r.vec_id % 7 == 0 else r.label) for r in table]
    df = queries.op11_hard_negatives(spark, odd)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = Counter(map(tuple, df.collect()))
    assert got == mined(usable(rows), lambda i: i % 50 == 0) and sum(got.values()) > 30


def test_mining_in_many_blocks(spark, monkeypatch):
    """Blocks of a few rows, a hot label, hundreds of equal vectors under other ids, repeats, nulls and clashing columns."""
    for name, size in (("BLOCK", 37), ("BATCH", 5)):
        monkeypatch.setattr(negatives, name, size)
    rng = np.random.default_rng(12)
    x = rng.normal(0, 0.5, (400, 5)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(int(i), [float(v) for v in x[i]], 0 if i % 3 else int(i % 5)) for i in range(400)]
    rows += rows[:50] + [(7, [1.0, 2.0], 1), (8, None, 1), (9, [None, 1.0], 1), (10, [float("nan")], 1), (11, [1.0], None), (12, [], 1), (None, [0.5] * 5, 2), (13, [1e30] * 5, 1)]
    df = spark.createDataFrame([(*r, 0.5, 1, 2, "q") for r in rows], "vec_id long, embedding array<double>, label int, score double, row long, rank int, q string").repartition(3)
    got = Counter(map(tuple, negatives.mine(df, F.col("vec_id") % 20 == 0).collect()))
    fits = [r for r in usable(rows) if all(abs(v) < 1e20 for v in r[1])]
    want = mined(fits, lambda i: i % 20 == 0)
    assert got == want and len(want) > 50
    assert negatives.mine(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_sliced_products_keep_what_can_qualify():
    rng = np.random.default_rng(2)
    for turn in range(60):
        most = int(rng.choice([2, 10, 300, 1 << 20]))
        x, y = (rng.integers(-most, most + 1, (int(rng.integers(1, n)), 6)) for n in (8, 60))
        if turn % 3 == 0:
            y = y[rng.integers(0, max(1, len(y) // 5), len(y))]
        score, alive, k = x @ y.T, rng.random((len(x), len(y))) < 0.8, int(rng.integers(1, 5))
        i, j, got = negatives.sliced_products(x, y, alive, negatives.first_by_score(k))
        assert (got == score[i, j]).all()
        least = rng.integers(-most * most, most * most, (len(x), 2))
        upto = least + rng.integers(-2, most * most, (len(x), 2))
        i2, j2, got = negatives.sliced_products(x, y, alive, negatives.first_in_windows(least, upto, k))
        assert (got == score[i2, j2]).all()
        for a in range(len(x)):
            kth = lambda at: sorted(score[a][at])[-k] if len(at) >= k else -(1 << 62)  # noqa: B023, E731
            at = np.flatnonzero(alive[a])
            assert set(j[i == a]) == {b for b in at if score[a, b] >= kth(at)}
            inside = [np.flatnonzero(alive[a] & (score[a] >= least[a, w]) & (score[a] <= upto[a, w])) for w in range(2)]
            assert set(j2[i2 == a]) == {b for at in inside for b in at if score[a, b] >= kth(at)}


# Fill-in-middle texts


def reordered(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


def test_op12(spark, odd):  # noqa: F811
    want = Counter()
    for d, t in documents(spark, odd):
        n, form, p, m, out = reordered(d, t or "")
        want[d, n, form, None if p is None else len(p), None if m is None else len(m), sha256(out.encode()).hexdigest(), sha256((t or "").encode()).hexdigest()] += 1
    df = queries.op12_fill_in_middle(spark, odd)
    assert df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, df.collect())) == want


@pytest.mark.parametrize("rate", [100, 40])
def test_marks_in_texts(spark, rate):
    """Texts that hold the mark, its escape, parts of sentinels, the separators of other engines, only ends of lines, and 3 MB without one."""
    rng = np.random.default_rng(6)
    signs = ["\x1f", "\x1e", "\x1em", "\x1ee", "\n", "\n\n", "\r\n", "a", "é", "日", "😀", "<", "<S", "S>", "P>", "$1", "\\", " ", "\x00", " "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(400)] + ["<P>", "a<M>\nb", "\n", "\n" * 1000, "x" * (3 << 20), ("line " * 20 + "\n") * 30000, None, ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, prefix string").repartition(3)
    rows = middle.transform(df, rate=rate).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, out = reordered(r.doc_id, texts[r.doc_id] or "", rate)
        assert (r.n, r.form, r.prefix, r.middle, r.output, r.back) == (n, form, p, m, out, texts[r.doc_id] or "")
    assert middle.transform(df.where("false")).count() == 0


# Token-id files


def ids_of(rows):
    slow = Tokenizer.from_file(WORDS)
    coded = sorted(((d is not None, d or 0, slow.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows), key=lambda r: r[:2])
    return [(d if some else None, np.array(ids, "<u4")) for some, d, ids in coded]


def check_ids(got, want):
    """Documents follow one another without gaps, ids ascending; rows of one id in any order."""
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)


def test_op13(spark, odd):  # noqa: F811
    df = queries.op13_token_files(spark, odd)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    check_ids(df.collect(), ids_of(documents(spark, odd)))


def test_id_files_in_small_blocks(spark, tmp_path):
    """Blocks of a few documents, few ids between checkpoints, rows that share an id or have none, and reading single documents from their checkpoints."""
    rng = np.random.default_rng(4)
    words = ["the", "rock", "don't", "Élan", "ünïcode", "日本", "7", "<|endoftext|>", "x" * 70, "¿qué?", "á", "ſ", "İ", "ŉ", "…", " ", "\x85", "²"]
    rows = [(int(i) % 60 if i % 9 else None, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(200)] + [(500, None), (501, ""), (502, "rock " * 5000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, n int, ids string").repartition(4)
    huffman.write_ids(df, f"{tmp_path}/ids", WORDS, block_ids=100, stride=7)
    read = huffman.read_ids(spark, f"{tmp_path}/ids")
    whole = read.select("*", F.crc32("ids").alias("ids_crc32")).collect()
    check_ids(whole, ids_of(rows))
    some = huffman.read_ids(spark, f"{tmp_path}/ids", F.col("doc_id").isin(5, 31, 502)).collect()
    key = lambda rows_: sorted((r.doc_id, r.start, bytes(r.ids)) for r in rows_ if r.doc_id in (5, 31, 502))
    assert key(some) == key(whole) and len(some) == len(key(some))
    huffman.write_ids(df.where("false"), f"{tmp_path}/none", WORDS)
    assert huffman.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_a_long_document(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)])
    rows = [(1, " ".join(words[rng.integers(0, len(words), 600_000)])), (2, "short")]
    huffman.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/ids", WORDS)
    check_ids(huffman.read_ids(spark, f"{tmp_path}/ids").select("*", F.crc32("ids").alias("ids_crc32")).collect(), ids_of(rows))


def test_words_have_the_same_ids_alone():
    """Random strings of letters, marks, blanks and special strings: word by word equals the library on the whole text."""
    rng = np.random.default_rng(1)
    signs = [*"'s 't 're 'll ' ’ a B é É ß ž ſ İ ı ŉ 0 7 ² ½ - _ <|endoftext|> <| |> ́ 日本 😀 Σ ΑΣ ά × ÷ ñ Ÿ don't THE ŀ Ŀ".split(" "), " ", "\t", "\n", " ", "\x85", " ", "​", "\x00", "\x01", "\x1c"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(3000)]
    encode, kind = huffman._encoder(WORDS)
    want = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    assert [encode(t) for t in texts] == [np.array(w.ids, kind).tobytes() for w in want]


def least_bits(counts, limit):
    """Total bits of the best code of at most `limit` bits, by packages of whole lists."""
    leaves = sorted((int(w), 1) for w in counts if w)
    if len(leaves) < 2:
        return sum(w for w, _ in leaves)
    level = leaves
    for _ in range(limit - 1):
        level = sorted(leaves + [(level[i][0] + level[i + 1][0], 1) for i in range(0, len(level) - 1, 2)])
    return sum(w for w, _ in level[: 2 * len(leaves) - 2])


def test_codes_are_least_and_canonical():
    rng = np.random.default_rng(3)
    for _ in range(150):
        counts = np.where(rng.random(rng.integers(1, 40)) < 0.8, rng.integers(1, 10 ** rng.integers(1, 7)), 0)
        used = int((counts > 0).sum())
        if not used:
            continue
        limit = max(1, math.ceil(math.log2(max(2, used)))) + int(rng.integers(0, 4))
        bits = huffman.code_lengths(counts, limit)
        assert int((counts * bits).sum()) == least_bits(counts, limit) and bits.max() <= limit and ((bits > 0) == (counts > 0)).all()
        codes = huffman.canonical(bits)
        strings = sorted((f"{int(codes[i]):0{bits[i]}b}", bits[i], i) for i in np.flatnonzero(bits))
        assert [(n, i) for _, n, i in strings] == sorted((n, i) for _, n, i in strings)
        assert not any(b.startswith(a) for (a, _, _), (b, _, _) in zip(strings, strings[1:]))
        ids = rng.choice(np.flatnonzero(counts), rng.integers(0, 500))
        data, start = huffman.encode_bits(ids, bits, codes)
        assert "".join(f"{b:08b}" for b in data).startswith("".join(f"{int(codes[i]):0{bits[i]}b}" for i in ids))
        lanes, longest = np.arange(0, len(ids), 16), int(bits.max())
        got = huffman.decode_bits(data, start[lanes], np.minimum(16, len(ids) - lanes), huffman.decoding_table(bits, longest), longest)
        assert (got == ids).all()
