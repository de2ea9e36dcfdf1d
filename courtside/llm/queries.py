"""Registered queries of the numbered operators, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_sha256(column) :
    return F.sha2(column.cast("binary"), 256)


@query("op6_pieces")
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from courtside.llm.pieces import encode_pieces

    out = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


OP3_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, len(w) as n, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from docs),
windows as (
  select doc_id, i, hash(l) as h
  from (select doc_id, n, i, list(word) over (partition by doc_id order by i rows between current row and 49 following) as l from words) where i + 49 <= n),
firsts as (select h, min(doc_id) as first from windows group by h having count(*) > 1),
gone as (
  select distinct doc_id, i + k as i from (select doc_id, i from windows join firsts using (h) where first < doc_id), (select unnest(range(50)) as k)),
kept as (
  select doc_id, count(gone.i) as n_removed, string_agg(case when gone.i is null then word end, ' ' order by words.i) as text
  from words left join gone using (doc_id, i) group by doc_id)
select docs.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (doc_id)"""


@query("op3_substrings", OP3_SQL)
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    words = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "repeats.n_words", "repeats.n_removed", hex_sha256(words).alias("kept_sha256"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.golay import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


@query("op1_decontam")
def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), tolerance=0.1, recall=0.99, passages=True)


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.labelled import id_remainder, labels_of
    from courtside.llm.quality_net import fit_quality, score_quality

    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    net = fit_quality(docs, labels_of(table(spark, sf_dir, "labels"), "quality").where(~held_out))
    return score_quality(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_rules")
def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.labelled import labels_of
    from courtside.llm.rule_lists import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), labels_of(table(spark, sf_dir, "labels"), "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.labelled import id_remainder, labels_of
    from courtside.llm.toxicity import score_toxicity

    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    out = score_toxicity(docs, labels_of(table(spark, sf_dir, "labels"), "toxic").where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_urls")
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.urls import Rule, filter_urls

    rules = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, replace(replace(replace(role, '\', '\s'), '<', '\l'), chr(10), '\n') as safe_role, replace(replace(text, '\', '\s'), '<', '\l') as safe_text from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(length('<turn>') + length(safe_role) + 1 + length(safe_text) + length('</turn>') + 1) as bigint) as formatted_chars
from sized group by conv_id"""


@query("op7_chats", OP7_SQL)
def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.chats import format_rows, probe, read_back, rows_of_turns, turn_rows, turns_of_json

    rows = turn_rows(table(spark, sf_dir, "conversations"), "conv_id").union(rows_of_turns(turns_of_json(probe(spark), "conv_id", "record"), "conv_id"))
    out = read_back(format_rows(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hex_sha256(turns).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        hex_sha256(learned).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
q as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest,
  case when strlen(payload) >= 1000 then max(page_id) over (partition by payload) end as first from p)
select page_id, payload_bytes, payload_digest, case when page_id < first then 'revisit' else 'response' end as record_type,
  case when page_id < first then first end as refers_to
from q"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.functions.store import new_path
    from courtside.llm.warc import page_number, page_records, read_archives, write_archives

    manifest = write_archives(page_records(table(spark, sf_dir, "pages")), new_path(spark, "warc"))
    found = read_archives(manifest).where("kind = 'record'")
    return found.select(
        page_number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"),
        page_number(F.col("refers_to")).alias("refers_to"),
    )


OP11_SQL = r"""
with docs as (select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
terms as (
  select doc, lang, source,
    unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as term
  from docs),
kept as (select lang, term, count(*) as n from terms group by lang, term having count(distinct doc) >= 30),
langs as (select lang, sum(n) as total, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as n from terms join kept using (lang, term) group by lang, source, term),
groups as (
  select g.lang, g.source, coalesce(t.total, 0) as total, coalesce(langs.v, 0) as v
  from (select distinct lang, source from docs) g
  left join (select lang, source, sum(n) as total from counts group by lang, source) t on t.lang = g.lang and t.source = g.source
  left join langs on langs.lang = g.lang),
shares as (
  select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v)::hugeint as p
  from groups g join kept on kept.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
whole as (select kept.lang, term, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v)::hugeint as q from kept join langs using (lang)),
apart as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(apart.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source),
own as (
  select s.lang, s.source, 'term' as part, s.term as item, (s.p - whole.q)::bigint as value
  from shares s join whole on whole.lang = s.lang and whole.term = s.term where s.n > 0 and s.p > whole.q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from own))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50"""


@query("op11_divergence", OP11_SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.divergence import audit_sources

    return audit_sources(table(spark, sf_dir, "documents"), min_docs=30, prior=5, top_terms=50)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id,
  positive_score, score as negative_score
from positives join scores using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5"""


@query("op12_negatives", OP12_SQL)
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.multi_index import mine_hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, least_percent=80, scale=256)


@query("op13_neighbours")
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from courtside.llm.pivot_index import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, recall=0.95)
