"""The registered queries of the language-model operators. Each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chat, huffman, jaccard, langid, media, middle, mixing, negatives, packing, perplexity, suffixes, toxicity
from tessera.llm.langid import held_out
from tessera.sources.files import workspace


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    prototypes = langid.learn(docs.where(~held_out()))
    return langid.identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity.classify(_read(spark, sf_dir, "documents"), trusted)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted"), F.size("offending").alias("n_offending"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("select -7 as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in turns.schema])
    made = chat.format_conversations(turns.unionByName(tricky))
    read = made.select("conv_id", "formatted", "valid", chat.read_back(F.col("formatted")).alias("turns"), chat.unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), "")).alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_back(media.encode(_read(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("feature")).alias("feature")
    )


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.length)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(_read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "ids")
    huffman.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return huffman.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_ALL = (op1_language_id, op2_source_mix, op3_ngram_jaccard, op4_perplexity, op5_toxicity, op6_chat_format, op7_packing, op8_media, op9_repeated_passages, op10_nearest, op11_hard_negatives, op12_fill_in_middle, op13_token_files)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op3_ngram_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) >= 4 then list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
c(node, top) as (select doc_id, doc_id from documents union select e.b, c.top from c join (select a, b from l union all select b, a from l) e on e.a = c.node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, t.component_id from documents d left join n using (doc_id) join (select node, min(top) as component_id from c group by 1) t on t.node = d.doc_id
""",
    "op6_chat_format": r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    case role when 'system' then length('<<SYS>><</SYS>>') when 'user' then length('[INST][/INST]') when 'assistant' then length('<s></s>')
      else length('<||><|end|>') + length(role) + length(regexp_replace(role, '[^\\<|\[]', '', 'g')) end
      + length(text) + length(regexp_replace(text, '[^\\<|\[]', '', 'g')) as chars
  from rows_)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars,
  coalesce(regexp_full_match(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, '' order by k), 's?(ua)+'), false) as valid
from marked group by conv_id
""",
    "op11_hard_negatives": r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as alike, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, score from s where alike qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b as positive, p.score as ps, s.b as negative, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as k
  from p join s on s.a = p.a and not s.alike and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, positive as positive_id, cast(k as integer) as rank, negative as negative_id, ps as positive_score, ns as negative_score from n where k <= 3
""",
    "op12_fill_in_middle": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, len(units) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
c as (select doc_id, n, form, text, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:n], '') as s from f)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from c
""",
}
