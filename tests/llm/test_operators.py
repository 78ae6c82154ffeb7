"""The language-model operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, components, jaccard, langid, media, mixing, packing, perplexity, suffixes, toxicity

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that clash with names the operators use inside.
ODD = "component string, n long, slice string, key string, score double"


def base_rows():
    rng = np.random.default_rng(5)
    vocabulary = ["Straße", "élan", "the", "and", "of", "alpha", "beta", "Gamma", "delta", "rock", "river", "stone", "cloud", "ñandú", "quick", "brown"]
    sentence = lambda n: " ".join(rng.choice(vocabulary, n))
    one, two = sentence(60), sentence(80)
    texts = [one, one, one + " extra", two, two.replace("the", "a", 1), sentence(40) + "\n" + one, "", None, " \t\n ", "x", "only three words", "only three words", "ÉÈ!!  --  123", sentence(9000), "日本語 テキスト 😀 ok", "a\x00b c", "<|endoftext|> [INST] </s>"]
    texts += [sentence(int(n)) for n in rng.integers(1, 120, 30)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][min(i % 7, 3)], 0) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, one, "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "c", 1, "s", "k", 0.5) for r in base_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ODD).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_language_profiles(spark, docs, none):
    rows = [(i, ("der die und nicht ein Straße " if i % 2 else "le la que pour élan être ") * (1 + i % 5), "de" if i % 2 else "fr") for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(train)
    got = {r.doc_id: r for r in langid.identify(train, profiles).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    found = langid.identify(docs, profiles).collect()
    assert len(found) == docs.count()
    letters = Counter((r.doc_id, any(c.isalpha() for c in r.text or "")) for r in docs.collect())
    assert Counter((r.doc_id, r.lang_pred != "und") for r in found) == letters
    assert langid.learn(none) == {} and langid.identify(none, profiles).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_gram_vectors_are_the_bound_letters():
    dim = 128
    grams, text, gram, counts, letters = langid.gram_counts(np.frombuffer("Ab é".encode(), np.uint8), np.array([0, 5]))
    want = Counter([(0, ord("a"), ord("b")), (ord("a"), ord("b"), 0), (ord("b"), 0, ord("é")), (0, ord("é"), 0)])
    assert Counter({tuple(grams[g].tolist()): int(c) for g, c in zip(gram, counts)}) == want and letters[0] == 3 and set(text) == {0}
    a, b, gap = (langid._letter(x, dim) for x in (ord("a"), ord("b"), 0))
    assert (langid.bound(np.array([[0, ord("a"), ord("b")]]), dim)[0] == np.roll(gap, 2) * np.roll(a, 1) * b).all()


def bundle(text, dim=langid.DIM):
    """The vector of a text, letter by letter."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    line = " " + " ".join(words) + " " if words else ""
    vector = lambda c: langid._letter(0 if c == " " else ord(c), dim).astype(np.int64)
    return sum((np.roll(vector(line[i]), 2) * np.roll(vector(line[i + 1]), 1) * vector(line[i + 2]) for i in range(len(line) - 2)), np.zeros(dim, np.int64))


def brute_languages(rows):
    """(doc_id, held out, language, score) of (doc_id, text, lang), and the margin of the best language before the next."""
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows}
    sums = defaultdict(lambda: np.zeros(langid.DIM))
    for d, t, lang in rows:
        if lang is not None and t is not None and not held[d]:
            sums[lang] += bundle(t)
    unit = {k: v / (np.linalg.norm(v) or 1) for k, v in sums.items()}
    common = np.mean(list(unit.values()), axis=0) if len(unit) > 1 else 0
    unit = {k: (v - common) / (np.linalg.norm(v - common) or 1) for k, v in unit.items()}
    out = []
    for d, t, _ in rows:
        v = bundle(t)
        cosine = {k: float(v @ u / max(np.linalg.norm(v), 1e-9)) for k, u in sorted(unit.items())}
        best = max(cosine, key=cosine.get, default=None)
        some = any(c.isalpha() for c in t or "") and best is not None
        out.append((d, held[d], best if some else "und", min(1, max(0, (1 + cosine[best]) / 2)) if some else 0.0, sorted(cosine.values())[-1] - sorted(cosine.values())[-2] if some and len(cosine) > 1 else 1))
    return out


def test_language_profiles_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(300 + i, t, lang) for i, (t, lang) in enumerate([("der die das", "de"), ("der die das", "nl"), ("ζωή και φως", "el"), ("日本語の文", "ja"), ("ÀÉÎ õü", "pt"), ("x1y2", None)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted((tuple(r) for r in langid.identify(df, langid.learn(df.where(~langid.held_out()))).select("doc_id", langid.held_out().alias("h"), "lang_pred", "score").collect()), key=str)
    want = sorted(brute_languages(rows), key=lambda r: str(r[:4]))
    for (d, held, lang, score), (d2, held2, lang2, score2, margin) in zip(got, want, strict=True):
        assert (d, held) == (d2, held2) and abs(score - score2) < 1e-6 and (lang == lang2 or margin < 1e-6)
    assert {r[1] for r in got} == {True, False}


def test_language_of_equal_prototypes_is_the_first():
    same = {"b": np.ones(langid.DIM), "a": np.ones(langid.DIM)}
    assert sorted(same)[int(np.array([same[k] @ np.ones(langid.DIM) for k in sorted(same)]).argmax())] == "a"


def test_grams_of_many_letters_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 42))).encode() for _ in range(4096)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    langid.gram_counts(np.frombuffer(b"a", np.uint8), np.array([0, 1]))
    tracemalloc.start()
    grams, *triples, letters = langid.gram_counts(data, offsets)
    found = langid.bundles(grams, *triples, len(letters), 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(grams) > 150_000 and peak < 100 << 20
    assert all((found[i] == bundle(texts[i].decode(), 128)).all() for i in (0, 63, 64, 4095))


def water(sizes, weights, cap=3.0):
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in capped]
        if not rest:
            return {s: cap * sizes[s] for s in sizes}
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(weights[s] for s in rest)
        over = [s for s in rest if level * weights[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= set(over)


def test_mixing(spark, docs, none):
    rows = mixing.mix_sources(docs, slices=8).collect()
    sizes, order = Counter(), sorted({r.source for r in docs.collect()}, key=lambda s: (s is None, s or ""))
    for r in docs.collect():
        sizes[r.source] += len(BLANK.findall(r.text or ""))
    targets = water({s: sizes[s] for s in order}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and r.taken <= 3 * r.size
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0) and all(-1e-9 <= p <= 1 + 1e-9 for p in r.positions)
    assert len(rows) == docs.count() and all(abs(taken[s] - targets[s]) <= 1 for s in order)
    again = mixing.mix_sources(docs.repartition(5), slices=8).collect()
    assert Counter((r.doc_id, r.digest, r.taken) for r in rows) == Counter((r.doc_id, r.digest, r.taken) for r in again)
    assert mixing.mix_sources(none).count() == 0
    copies = mixing.training_rows(docs)
    assert copies.columns == docs.columns and copies.count() > 0
    hot = spark.createDataFrame([(i, "w " * (1 + i % 9), "big" if i % 3 else "small") for i in range(600)], "doc_id long, text string, source string")
    got = {r.source: (r.t, r.g) for r in mixing.mix_sources(hot, slices=16).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()}
    assert all(abs(t - g) <= 1 for t, g in got.values())


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("x")).select("x", mixing.inverse(F.col("x"), knots).alias("t")).collect()
        for x, t in rows:
            area = sum((min(t, b) - a) * (wa + wa + (wb - wa) * (min(t, b) - a) / (b - a)) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a)
            assert abs(area / mixing.integral(knots) - x) < 1e-9
    assert [round(mixing.integral(k), 9) for k in mixing.SCHEDULES] == [5, 2, 1]


def linked(rows, k, percent):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = BLANK.findall(fold(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least[find(i)], d)
    return sorted(((d, len(sets[i]), None if least[find(i)] == math.inf else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [None, 2])
def test_jaccard_join(spark, docs, none, monkeypatch, block):
    if block:  # so that buckets of several blocks come up on small tables too
        for name, value in (("BLOCK", block), ("HEADS", 1), ("NAMED", 1)):
            monkeypatch.setattr(jaccard, name, value)
    near = [(100 + i, " ".join(f"w{j}" if j != 7 * i else f"v{i}" for j in range(70))) for i in range(9)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.link(df, 4, 85).collect()), key=str)
    assert got == linked(rows, 4, 85)
    if not block:
        assert jaccard.link(docs, 5, 80).count() == docs.count() and jaccard.link(none, 4, 85).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_large_group_of_near_copies(spark, monkeypatch, block):
    """One group whose members are similar enough to some others only, beside sets that are also parts of others: one block, and many."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HEADS", 2)
    rng, rows = np.random.default_rng(11), []
    for i in range(220):
        words = [f"w{j}" for j in range(120)]
        for at in rng.choice(120, rng.integers(1, 5), replace=False).tolist():
            words[at] = f"v{rng.integers(0, 40)}"
        rows.append((i, " ".join(words[: 120 - int(rng.integers(0, 12))])))
    got = sorted((tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()), key=str)
    want = linked(rows, 4, 85)
    assert got == want and 1 < len({c for _, _, c in want}) < 220


def test_jaccard_pairs_beside_sets_that_are_parts_of_both(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "HEADS", 1)
    rng, rows = np.random.default_rng(9), []
    for i in range(150):  # two texts that share 7 of 9 shingles; half of these are also texts of their own, so their buckets are large
        shared = [f"w{i}x{j}" for j in range(10)]
        rows += [(1000 * i + j, " ".join([*shared, f"{end}{i}"])) for j, end in enumerate("ab")]
        rows += [(1000 * i + 10 + j, " ".join(shared[j : j + 4])) for j in np.flatnonzero(rng.random(7) < 0.5).tolist()]
    got = sorted((tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 75).collect()), key=str)
    assert got == linked(rows, 4, 75)


def test_parities_bound_the_intersection():
    rng = np.random.default_rng(2)
    for n, m, shared in ((5, 5, 5), (100, 90, 80), (300, 260, 0), (900, 800, 790), (60000, 59000, 50000)):
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = pool[:n], pool[n - shared : n - shared + m]
        table = pa.table({"token": [1, 1], "key": [1, 2], "component": [1, 2], "side": [3, 3], "n": [n, m], "other": [True, True], "names": [[1, 5], [0, 1]]})
        (_, _, both), *_ = [x for x in jaccard.Members(table, [jaccard.parities(a), jaccard.parities(b)]).pairs(1) if len(x[0])]
        assert len(np.intersect1d(a, b)) <= both[0] <= min(n, m)


def test_components(spark):
    edges = [(i, i + 1) for i in range(12)] + [(50, 50 + i) for i in range(1, 9)] + [(58, 12), (70, 70)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(13), *range(50, 59)]}


def kneser_ney(texts, trusted):
    return kneser_ney_at(texts, trusted, range(len(texts)))


def kneser_ney_at(texts, trusted, places):
    """Perplexities of the texts at places by a model of those in trusted, gram by gram."""

    def units(t):
        raw = t.encode("utf-16-le")
        return [1, 1, 1, *(max(2, raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))]

    tables = {4: Counter(tuple(u[j - 3 : j + 1]) for i, t in enumerate(texts) if t and i in trusted for u in [units(t)] for j in range(3, len(u)))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cut, after = {}, {n: defaultdict(list) for n in tables}
    for n, table in tables.items():
        for g, c in table.items():
            after[n][g[:-1]].append(c)
        k = [sum(x == i for x in table.values()) for i in range(1, 5)]
        y = k[0] / (k[0] + 2 * k[1]) if min(k) else 0
        d = [i + 1 - (i + 2) * y * k[i + 1] / k[i] for i in range(3)] if min(k) else [0.5, 1.0, 1.5]
        cut[n] = [x if 0 < x <= i + 1 else (i + 1) / 2 for i, x in enumerate(d)]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(tables[1]) + 1)
        rows = after[n].get(gram[:-1])
        if not rows:
            return p(gram[1:])
        c = tables[n].get(gram, 0)
        return ((c - cut[n][min(c, 3) - 1] if c else 0) + sum(cut[n][min(x, 3) - 1] for x in rows) * p(gram[1:])) / sum(rows)

    return [math.exp(-sum(math.log(p(tuple(u[j - 3 : j + 1]))) for j in range(3, len(u))) / (len(u) - 3)) if t and len(u := units(t)) > 3 else None for t in (texts[i] for i in places)]


def test_perplexity(spark, docs, none):
    texts = ["abracadabra", "abba abba", "cab", "zzzz", "", None, "a😀b", "abracadabra"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(0,), (1,), (2,), (2,), (None,), (99,)], "doc_id long")
    got = {r.doc_id: r.perplexity for r in perplexity.perplexities(df, trusted, block=3).collect()}
    for i, want in enumerate(kneser_ney(texts, {0, 1, 2})):
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-9 * want
    rows = perplexity.classify(df, trusted).collect()
    assert {r.doc_id: r.keep for r in rows}[0] and not {r.doc_id: r.keep for r in rows}[3]
    assert perplexity.classify(docs, trusted.where("false")).count() == docs.count() and perplexity.classify(none, trusted).count() == 0


def test_toxicity(spark, docs, none):
    clean, bad = "A quiet day by the river. We walked home! All is well", "You are a total moron. "
    rows = [(i, clean + (". " + bad + clean if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for i, text, toxic in rows:
        assert (got[i].score >= 0.3) == bool(toxic)
        if toxic:
            raw = text.encode()
            assert any(b"moron" in raw[s.start : s.start + s.length] for s in got[i].offending)
    assert {r.doc_id for r in toxicity.accepted(df, model).collect()} == {r[0] for r in rows if not r[2]}
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    assert all(r.score == 0 for r in toxicity.score(docs.where("text is null or trim(text) = ''"), model).collect())
    assert toxicity.learn(none, labels).bias < 0


def brute_toxicity(text, model):
    """(score, offending spans): each sentence's words once, noisy-or over sentences, with plain Python."""
    from tessera.llm.textkit import words

    bits, clean, spans, raw = len(model.weights).bit_length() - 1, 1.0, [], (text or "").encode()
    for m in re.finditer(rb"[^.!?\n]+", raw):
        found = list(re.finditer(rb"[A-Za-z\x80-\xff]+", m[0]))
        if not found:
            continue
        line = np.frombuffer(b" ".join(w[0] for w in found), np.uint8)
        features = set((words(line, np.array([0, len(line)]), toxicity.NOT_WORD)[0] >> np.uint64(64 - bits)).tolist())
        s = 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(float(model.weights[f]) for f in features)))))
        clean *= 1 - min(s, 1 - 1e-12)
        if s >= 0.3:
            spans.append((m.start() + found[0].start(), found[-1].end() - found[0].start()))
    return 1 - clean, spans


def test_toxicity_equals_brute_force(spark, docs):
    rng = np.random.default_rng(12)
    weights = np.where(rng.random(1 << 12) < 0.2, rng.normal(0.5, 2, 1 << 12), 0).astype(np.float32)
    model = toxicity.Model(weights, -3.0)
    more = spark.createDataFrame([(400, "One. two! three? four\nfive 6 'seven'...  é ü.eight" + " nine" * 50), (401, ". . ! ?"), (402, "a" * 3000)], "doc_id long, text string")
    texts = docs.select("doc_id", "text").union(more).where("doc_id is not null").distinct()
    want = {r.doc_id: brute_toxicity(r.text, model) for r in texts.collect()}
    got = toxicity.score(texts, model).collect()
    assert len(got) == len(want)
    for r in got:
        score, spans = want[r.doc_id]
        assert abs(r.score - score) < 1e-9 and [(s.start, s.length) for s in r.offending] == spans
    some = toxicity.accepted(texts.withColumns({"score": F.lit(1.0), "n": F.lit("x")}), model)
    assert some.columns == ["doc_id", "text", "score", "n"] and {r.doc_id for r in some.collect()} == {d for d, (s, _) in want.items() if s < 0.3}


def test_toxicity_fit_is_bounded_and_skips_repeats(spark):
    rows = [(i, ("bad word. " if i % 2 else "fine day. ") * 5) for i in range(60)]
    df = spark.createDataFrame(rows + [(1, "bad word. " * 5 + "zzz")] * 3 + [(99, "bad " * 4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(99, 0)], "doc_id long, toxic int")
    one = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    two = toxicity.learn(df, labels, fit_bytes=60 * 50)  # what doesn't fit and what repeats an id takes no part
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\b \\l[<|end|>", "", None, "<<SYS>>\\", "a|b<c[d\\e"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(tricky)] + [(2, 0, "tool<|x", "t"), (2, 1, None, "u"), (2, 1, None, "u"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in made.select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    for c in (1, 2, 3, None):
        assert [(t.role, t.text) for t in got[c].back] == [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
    assert got[1].valid and got[3].valid and not got[2].valid
    assert chat.format_conversations(df.where("false")).count() == 0


def test_packing(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((d, np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in set(rows))
    got, places = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs.dropDuplicates(["doc_id", "text"]), path, group=9).collect():
        got[(r.doc_id, r.doc_tokens, r.sequence_id if r.doc_id is None else 0)].append((r.start, bytes(r.ids)))
        places[r.sequence_id].append((r.offset, r.length))
    if None in {d for d, _ in want}:
        want = Counter({k: n for k, n in want.items() if k[0] is not None})
    assert Counter((d, b"".join(x for _, x in sorted(p))) for (d, _, _), p in got.items() if d is not None) == want
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(none, path).count() == 0 and packing.pack(docs, path).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_both_tokenizers_give_the_same_ids():
    """Plain texts take the faster one of two libraries; the slower one is the measure."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, rng = Tokenizer.from_file(path), np.random.default_rng(21)
    alphabet = [*map(chr, range(32, 127)), *map(chr, range(0xA1, 0x180)), *"‐–—‘’“”†•…‧", *" \t\n\r\x0b\x0c"]
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "  ", "   ", "\n\n", " \n ", "\t\t", "the", "The", "and", "123", "4567", "é", "ß", "Ⅳ", "x" * 20]
    texts = ["", " ", "\n", "<|endoftext|>", "a<|endoftext|>b", "x" * 500, "日本", "a\x00b"]
    for _ in range(4000):
        n = int(rng.integers(1, 30))
        pool = alphabet if rng.random() < 0.5 else parts + alphabet[:95]
        texts.append("".join(pool[int(i)] for i in rng.integers(0, len(pool), n)))
    assert packing._encoder(path)(texts) == [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)]


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 200)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        free += [100] * (at == len(free))
        assert bins[i] == at and offsets[i] == 100 - free[at]
        free[at] -= sizes[i]


def brute_cosine_hash(rows):
    """Sums in whole numbers of any size."""
    height, width = rows.shape
    basis = lambda n: [[round(4096 * math.cos(math.pi * (2 * x + 1) * f / (2 * n))) for x in range(n)] for f in range(8)]
    across = [[int(np.dot(rows[y].astype(np.int64), np.array(basis_row))) for basis_row in basis(width)] for y in range(height)]
    found = [sum(b * across[y][g] for y, b in enumerate(down)) for down in basis(height) for g in range(8)]
    middle = sorted(found[1:])[31]
    bits = "".join("1" if x > middle else "0" for x in found)
    return int(bits, 2).to_bytes(8, "big")


@pytest.mark.parametrize("height", [1, 2, 9, media.STRIP, media.STRIP + 1, 65537])
def test_cosine_hash_equals_brute_force(height):
    rng = np.random.default_rng(height)
    rows = (rng.integers(0, 256, (height, 4), dtype=np.uint8).repeat(144, axis=1) if height > 100 else rng.integers(0, 256, (height, 576), dtype=np.uint8))
    assert media.cosine_hash(rows) == brute_cosine_hash(rows)


def test_png(spark, docs, none):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (7, 576), dtype=np.uint8)
    assert (media.from_png(media.to_png(rows)) == rows).all()
    lines, above = np.zeros((7, 577), np.uint8), np.zeros(576, int)
    for i, kind in enumerate([4, 3, 2, 1, 0, 3, 4]):  # encoded here pixel by pixel with every filter
        lines[i, 0] = kind
        for x in range(576):
            left, up, corner = (int(rows[i, x - 1]) if x else 0), int(above[x]), (int(above[x - 1]) if x else 0)
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: (abs(p - v), (left, up, corner).index(v)))
            lines[i, 1 + x] = (int(rows[i, x]) - [0, left, up, (left + up) // 2, paeth][kind]) % 256
        above = rows[i].astype(int)
    assert (media.unfiltered(lines) == rows).all()
    broken = bytearray(media.to_png(rows))
    broken[60] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))
    seen = {}
    for r in media.read_back(media.encode(docs)).join(docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id is not null").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert seen.setdefault(raw, (bytes(r.media), bytes(r.feature))) == (bytes(r.media), bytes(r.feature)) and len(r.feature) == 8
    assert media.encode(docs).count() == docs.count() and media.read_back(media.encode(none)).count() == 0


def cut(rows, length=50):
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            least[w] = min(least.get(w, math.inf), math.inf if d is None else d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            if least[raw[j : j + length]] < (math.inf if d is None else d):
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(raw)) if gone[j] and not (j and gone[j - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages(spark, docs, none):
    passage = "".join(chr(97 + (i * i) % 26) for i in range(90))
    more = [(200, "x" * 30 + passage + "y"), (201, passage[5:60] + passage[20:89]), (202, "é" * 60), (203, "é" * 70), (204, "ab" * 200), (205, "ab" * 210), (206, passage[:49]), (199, "q" + passage[:50] + "\x00" * 60), (207, "\x00" * 55)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + more
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.remove_repeats(df)
    found = [(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), r.kept_sha256) for r in got.collect()]
    assert sorted(found, key=str) == cut(rows)
    assert suffixes.remove_repeats(none).count() == 0
    short = suffixes.without_repeats(docs)
    assert short.columns == docs.columns and short.where("text = ''").count() == docs.where("text = ''").count() and short.where("text is null").count() == docs.where("text is null").count()
    assert suffixes.without_repeats(none).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(4)
    runs, strings = [], []
    for _ in range(7):
        run = sorted(bytes(rng.integers(97, 100, rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(0, 40)))
        same = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(run, run[1:])]
        runs.append((same[: len(run)], [s[n:] for s, n in zip(run, same)]))
        strings.append(run)
    out = list(suffixes.merged(runs))
    texts = [strings[r][i] for r, i, _ in out]
    assert texts == sorted(x for run in strings for x in run)
    for (_, _, n), a, b in zip(out[1:], texts, texts[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize(("part_rows", "parts"), [(4096, 256), (300, 4), (40, 4)])
def test_nearest(spark, part_rows, parts):
    """One part, four, and four that are cut into parts again."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (8, 16))
    x = (centres[np.arange(1200) % 8] + rng.normal(0, 0.3, (1200, 16))).astype(np.float32)
    x[700:900] = x[700]  # a hot vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(1200)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0]), (None, [1.0] * 16), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "vec_id long, embedding array<float>, label int, part string")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, part_rows=part_rows, parts=parts, block=100, batch=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits, wide = 0, x.astype(float)
    assert set(got) == set(range(0, 1200, 100))
    for q, found in got.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort([np.arange(1200), d])[:10]
        hits += len({i for i, _ in found} & set(best.tolist()))
        assert len(found) == 10 and found == sorted(found, key=lambda f: (f[1], f[0])) and all(abs(s - d[i]) < 1e-12 for i, s in found)
    assert hits >= 0.9 * 120
    assert ann.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_nearest_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (60, 8)).astype(np.float32)
    d = np.sqrt(((x.astype(float) - x[0].astype(float)) ** 2).sum(axis=1))
    d[0] = np.inf
    best = np.argsort(d, kind="stable")[:10].tolist()
    rows = [(i, [float(v) for v in x[i]]) for i in [*range(60), *[best[0]] * 19, 0]]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, parts=1).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in found] == list(enumerate(best, 1))


def test_training_rows_are_the_words_taken(spark, docs):
    """Each document comes as often as the words that the mix takes of it say, to the nearest whole number."""
    some = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    want = {r.doc_id: math.floor(r.taken / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix_sources(some).collect()}
    got = Counter(r.doc_id for r in mixing.training_rows(some).collect())
    assert got == Counter({d: n for d, n in want.items() if n})


def test_very_long_texts(spark):
    """Texts of 2 and 9 MB: beyond a run, a block and what is kept of powers."""
    rng = np.random.default_rng(17)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(60000)])
    text = lambda size: " ".join(words[rng.integers(0, len(words), size // 10)])
    two, nine = text(2 << 20), text(7 << 20)
    rows = [(1, two, "en", "s"), (2, two + " " + nine, "en", "s"), (3, two[:-200], "en", "t"), (4, "short one", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    raw = {d: t.encode() for d, t, _, _ in rows}
    assert {r.doc_id: r.lang_pred for r in langid.identify(df, langid.learn(df)).collect()} == {d: lang for d, _, lang, _ in rows}
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(df).collect()} == {d: len(t.split(" ")) for d, t, _, _ in rows}
    assert {r.doc_id: r.component_id for r in jaccard.link(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert toxicity.score(df, toxicity.Model(np.zeros(1 << 10, np.float32), -6.0)).count() == 4
    for r in media.read_back(media.encode(df)).collect():
        payload = raw[r.doc_id] + b"\xff" * (-len(raw[r.doc_id]) % 576)
        assert (r.n_bytes, r.payload_sha256) == (len(raw[r.doc_id]), hashlib.sha256(payload).hexdigest())
    cut_ = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in suffixes.remove_repeats(df).collect()}
    assert cut_[1] == cut_[4] == [] and cut_[3] == [(0, len(two) - 200)] and cut_[2][0][0] == 0 and len(two) <= cut_[2][0][1] <= len(two) + 9
    pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == 4 and all(r.n == r.m for r in pieces)
