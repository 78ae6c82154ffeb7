"""Registered queries over the small tables: chat formatting against SQL, the pipeline's stages against what they promise."""

import math
import os
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import media, mixing, perplexity, queries, toxicity
from tests.llm.test_operators import ODD, base_rows, brute_cosine_hash, brute_languages, brute_toxicity, cut, kneser_ney_at, linked

SF = "/root/testdata/sf0.001"


def test_chat_format_equals_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = queries.op6_chat_format(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op6_chat_format"])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_names_of_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "repeated_passages", "source_mix", "packing"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_keep_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_toxicity_stage(spark, stages):
    model = toxicity.learn(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(stages[0], model).where("score >= 0.3").collect()}
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in stages[0].collect()} - bad


def test_near_duplicate_stage(stages):
    sets = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in stages[2].collect()} == {i for i in sets if find(i) == i}


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_repeats_stage(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (stages[2], stages[3]))
    assert set(after) <= set(before)
    seen = {}
    for i in sorted(before):
        raw = before[i].encode()
        if i in after and after[i] == before[i]:
            assert not any(raw[j : j + 50] in seen for j in range(len(raw) - 49))
        if i not in after:
            assert all(raw[j : j + 50] in seen for j in range(0, max(1, len(raw) - 49), 50))
        seen |= {raw[j : j + 50]: i for j in range(len(raw) - 49) if raw[j : j + 50] not in seen}
    assert all(len(r.text) == r.n_chars for r in stages[3].collect() if r.text != before[r.doc_id])


def test_mix_and_packing_stages(stages):
    names = {r.doc_id: r.text for r in stages[3].collect()}
    copies = [r.doc_id for r in stages[4].collect()]
    assert copies and all(copies.count(i) <= 3 and i in names for i in set(copies))
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == set(copies)
    whole = stages[5].where("start = 0").count()
    assert whole == len(copies)


# Every registered query once over a folder of odd rows, against brute force.


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, empty and repeated rows, ties, and extra columns whose names the operators use inside."""
    folder = tmp_path_factory.mktemp("odd")
    rng = np.random.default_rng(31)
    rows = [(*r, "c", 1, "s", "k", 0.5, 7) for r in base_rows()]
    rows += [(100 + i, f"Total moron {i}! " + r[1] if i % 3 == 0 else (r[1] or "") + " fine day", *r[2:5], "c", 1, "s", "k", 0.5, 7) for i, r in enumerate(base_rows()[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ODD + ", block long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, int(i >= 100 and (i - 100) % 3 == 0), "x") for i in range(150)] + [(None, 1, 1, "x"), (3, None, None, "x"), (4, 0, 0, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, label string").write.parquet(f"{folder}/labels.parquet")
    x = rng.normal(0, 1, (260, 6)).round(1).astype(np.float32)
    x[30:60] = x[30]
    vectors = [(i, [float(v) for v in x[i]], i % 3, 1) for i in range(260)] + [(5, [float(v) for v in x[5]], 0, 1), (300, None, 0, 1), (400, [0.0] * 6, 0, 1), (500, [float("inf")] * 6, 0, 1), (600, [1.0], 0, 1), (None, [1.0] * 6, 0, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, rank int").write.parquet(f"{folder}/embeddings.parquet")
    turns = [(1, 0, "user", "</s>[INST] ok"), (1, 1, "assistant", None), (2, 0, "tool", ""), (None, None, None, None), (3, 0, "system", "a\\b"), (3, 1, "user", "u"), (3, 2, "assistant", "yes"), (3, 2, "assistant", "yes")]
    spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def documents(spark, odd):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op1(spark, odd):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]
    df = queries.op1_language_id(spark, odd)
    assert df.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got, want = sorted(map(tuple, df.collect()), key=str), sorted(brute_languages(rows), key=lambda r: str(r[:4]))
    near = lambda r: (str(r[0]), r[1], round(r[3], 4))
    assert Counter(map(near, got)) == Counter(map(near, want)) and all(r[1] == held(r[0]) for r in got)


def test_op2(spark, odd):
    """Each row's words and positions, from the order of the digests."""
    got = mixing.mix_sources(spark.read.parquet(f"{odd}/documents.parquet")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    for turn, source in enumerate(order):
        rows = sorted(by[source], key=lambda r: (r.digest % mixing.SLICES, r.digest, -1 if r.doc_id is None else r.doc_id, r["size"]))
        total, want, before = sum(r["size"] for r in rows), round(rows[0].target), 0
        passes, knots = (want // total if total else 0), mixing.SCHEDULES[turn % 3]
        seen = {}
        for r in rows:
            taken = passes * r["size"] + max(0, min(want - passes * total - before, r["size"]))
            starts = [(i * total + before) / max(1, want) for i in range(-(-taken // r["size"]) if r["size"] else 0)]
            seen.setdefault((r.doc_id, r.digest), []).append((taken, [round(position(s, knots), 9) for s in starts]))
            before += r["size"]
        found = {}
        for r in rows:
            found.setdefault((r.doc_id, r.digest), []).append((r.taken, [round(p, 9) for p in r.positions]))
        assert {k: sorted(x) for k, x in found.items()} == {k: sorted(x) for k, x in seen.items()}
    df = queries.op2_source_mix(spark, odd)
    assert df.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert Counter((r.doc_id, r["size"], r.taken) for r in df.collect()) == Counter((r.doc_id, r["size"], r.taken) for r in got)


def position(share, knots):
    """The time at which the integral has reached the share of its total, by halving."""
    total, low, high = mixing.integral(knots), 0.0, 1.0
    area = lambda t: sum((min(t, b) - a) * (wa + wa + (wb - wa) * (min(t, b) - a) / (b - a)) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if area(middle) < share * total else (low, middle)
    return high


def test_op3(spark, odd):
    got = queries.op3_ngram_jaccard(spark, odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == linked(documents(spark, odd), 4, 85)


def test_op4(spark, odd):
    """Perplexities by a direct model of the training documents, thresholds by language from those kept from it."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{odd}/documents.parquet").where("length(text) < 300 or text is null").collect()]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = {i for i in range(150) if i % 2}
    calibrates = {i for i in trusted if zlib.crc32(str(i).encode()) % perplexity.CALIBRATION == 0}
    got = perplexity.classify(small, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), block=7).collect()
    some = [i for i in range(0, len(rows), 9)]
    direct = kneser_ney_at([t for _, t, _ in rows], {n for n, (d, _, _) in enumerate(rows) if d in trusted - calibrates}, some)
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.lang, r.n_units), []).append(r.perplexity)
    for i, want in zip(some, direct):
        d, t, lang = rows[i]
        options = found[d, lang, len((t or "").encode("utf-16-le")) // 2]
        assert options == [None] * len(options) if want is None else any(abs(p - want) < 1e-6 * want for p in options)
    cut = {}
    for r in got:
        if r.doc_id in calibrates and r.perplexity is not None:
            for k in (r.lang, "any"):
                cut.setdefault(k, []).append(round(r.perplexity, 3))
    quantile = lambda x: sorted(x)[math.ceil(0.98 * len(x)) - 1]
    for r in got:
        own = cut.get(r.lang) if r.lang is not None else None
        assert abs(r.threshold - quantile(own or cut["any"])) < 1e-9
        assert r.keep == (r.perplexity is not None and round(r.perplexity, 3) <= r.threshold)
    assert queries.op4_perplexity(spark, odd).count() == len(documents(spark, odd))


def test_op5(spark, odd):
    docs, labels = spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~queries.held_out()))
    texts = documents(spark, odd)
    want = Counter((d, held(d), round(s, 6), int(s >= 0.3), len(spans)) for d, t in texts for s, spans in [brute_toxicity(t, model)])
    df = queries.op5_toxicity(spark, odd)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert Counter((r.doc_id, r.held_out, round(r.score, 6), r.predicted, r.n_offending) for r in df.collect()) == want
    # What is held out teaches nothing: other labels there leave the model as it is.
    other = labels.where(~queries.held_out()).unionByName(labels.where(queries.held_out()).withColumn("toxic", F.lit(1)))
    assert (toxicity.learn(docs, other.where(~queries.held_out())).weights == model.weights).all()


def test_op6(spark, odd):
    rows = {r.conv_id: r for r in queries.op6_chat_format(spark, odd).collect()}
    told = "user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n"
    assert rows[-7].turns_sha256 == sha256(told.encode()).hexdigest() and rows[-7].loss_chars == len("</s>[INST] ok [/INST]") and rows[-7].n_turns == 2
    assert rows[3].loss_sha256 == sha256(b"yesyes").hexdigest() and rows[None].n_turns == 1 and rows[1].loss_chars == 0


def test_op7(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in set(documents(spark, odd))}
    known = {}
    for d, t in documents(spark, odd):
        known.setdefault((d, len(ids[t])), []).append(ids[t])
    got = queries.op7_packing(spark, odd).collect()
    ends = {}
    for r in got:
        options = known[r.doc_id, r.doc_tokens]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in options)
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids[t]) for _, t in documents(spark, odd))
    for pieces in ends.values():
        assert [o for o, _ in sorted(pieces)] == [0, *np.cumsum([n for _, n in sorted(pieces)])[:-1].tolist()] and sum(n for _, n in pieces) <= 1024


def test_op8(spark, odd):
    want = Counter()
    for d, t in documents(spark, odd):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        rows = np.frombuffer(payload, np.uint8).reshape(-1, 576)
        png = media.to_png(payload)
        want[d, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), sha256(png).hexdigest(), brute_cosine_hash(rows).hex()] += 1
    df = queries.op8_media(spark, odd)
    assert df.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert Counter(map(tuple, df.collect())) == want


def test_op9(spark, odd):
    df = queries.op9_repeated_passages(spark, odd)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == cut(documents(spark, odd))


def test_op10(spark, odd):
    rows = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in spark.read.parquet(f"{odd}/embeddings.parquet").where("vec_id < 260").collect()}
    got = {}
    for r in queries.op10_nearest(spark, odd).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200}
    hits = 0
    for q, found in got.items():
        exact = sorted((math.sqrt(((x - rows[q]) ** 2).sum()), i) for i, x in rows.items() if i != q)[:10]
        hits += len({i for _, i in exact} & {i for i, _ in found})
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0]))
    assert hits >= 27


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path, kind):
    """Columns that clash and tables without rows pass through all five stages."""
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{odd}/{name}.parquet")
        (df if kind == "odd" else df.where("false")).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == before.columns and after.dtypes == before.dtypes
        after.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() > 0) == (kind == "odd")
