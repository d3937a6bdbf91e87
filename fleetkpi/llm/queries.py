"""One query for each operator over its whole table, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_names, bpe, chat, embed_join, hard_negatives, mixing, ngram_join, quality, rules, token_files, toxicity, warc, whitening

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


#: The conversation that says control strings, beside those of the table.
EXTRA = """select * from values
  (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
  as t(conv_id, turn, role, text)"""


@_query(
    r"""
with extra(conv_id, turn, role, text) as (
  values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from extra
), shown as (
  select *,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|image\|>|\|audio\|>|\|document\|>|\|startoftext\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g') as role_out,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|image\|>|\|audio\|>|\|document\|>|\|startoftext\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g') as text_out
  from rows
)
select conv_id::bigint as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role_out) + length(text_out) + 33)::bigint as formatted_chars
from shown group by conv_id
"""
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, read back and digested."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA))
    back = chat.read_chat(chat.format_chat(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _digested(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return _digested(bpe.encode(_table(spark, sf_dir, "documents"), decoded=True))


@_query(
    r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words
), items as (
  select doc_id, len(s) as n, unnest(s) as item from sets
), pairs as (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.item = b.item and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways as (
  select a, b from pairs union all select b, a from pairs
), reached(node, low) as (
  select doc_id, doc_id from sets
  union
  select ways.b, reached.low from reached join ways on ways.a = reached.node where reached.low < ways.b
)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.low) as component_id
from sets s join reached r on r.node = s.doc_id group by s.doc_id, s.s
"""
)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle sets of all documents and the components of their links."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


@_query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of all documents, from graded labels."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(_table(spark, sf_dir, "labels")))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", "tail", "expected_grade", quality.accepted().alias("kept")
    )


@_query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted"
    )


@_query()
def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, the fixed rules, and the adaptive ones."""
    return rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_files.read_tokens(spark, token_files.write_tokens(_table(spark, sf_dir, "documents")))


@_query(
    """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
), usable as (
  select vec_id, e from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
  on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), reached(node, low) as (
  select vec_id, vec_id from v
  union
  select links.b, reached.low from reached join links on links.a = reached.node where reached.low < links.b
)
select v.vec_id, (select count(*) from links where a = v.vec_id) as n_links, min(r.low) as component_id, min(r.low) = v.vec_id as kept
from v join reached r on r.node = v.vec_id group by v.vec_id
"""
)
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embed_join.link_components(_table(spark, sf_dir, "embeddings"))


@_query(
    """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, strlen(html) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as top from p
)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex || '00', 1 + (5 * i) // 4, 3))::integer >> (7 - (5 * i) % 4)) & 31), 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from d
"""
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as legacy archives, converted to WARC and read back."""
    return warc.pages_as_warc(_table(spark, sf_dir, "pages")).drop("record_id")


@_query(
    """
with t as (
  select doc_id, coalesce(text, '') as text from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(text) as text_sha256
from t window same as (partition by text)
"""
)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, the largest doc_id of each group stays."""
    return block_names.exact_duplicates(_table(spark, sf_dir, "documents"))


@_query(
    """
with r as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as a, r.vec_id as b, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as s
  from r a join r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id and len(a.v) = len(r.v)
), positives as (
  select a, b, s from scored where same qualify row_number() over (partition by a order by s desc, b) <= 5
), negatives as (
  select p.a, p.b as p, p.s as ps, n.b as n, n.s as ns, row_number() over (partition by p.a, p.b order by n.s desc, n.b) as rank
  from positives p join scored n on n.a = p.a and not n.same and 80 * p.s <= 100 * n.s and 100 * n.s <= 100 * p.s
)
select a as anchor_id, p as positive_id, rank::integer as rank, n as negative_id, ps as positive_score, ns as negative_score
from negatives where rank <= 5
"""
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("bigint")
    table = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(table, vec_id % 100 == 0)


@_query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the eight largest components of their covariance, whitened."""
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@_query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
