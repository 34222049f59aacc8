"""Registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culturelens.llm import (
    ann, bpe, chat, langid, lexical, line_dedup, packing, periodic, pii, quality, sharding,
    simhash, token_counts,
)

RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
SHARDS = 40
DIMENSIONS = {"text": "size", "lang": "value", "source": "value"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Documents that language ID never learns from; a null id counts as one."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return F.coalesce(third, F.lit(True))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()), "doc_id", "text", "lang")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return langid.predict(rows, model).select(
        "row.doc_id", "row.held_out", "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), "text", (F.col("doc_id"),)).select(
        F.col("carry_0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "failed_rules", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS, DIMENSIONS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode_ids(encoded, path))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_removed", "emptied", F.col("new_text").alias("text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path(WORD_BPE)).drop("loss")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), repeated=True)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash_dedup, op2_chat_formatting, op3_nearest_neighbours, op4_language_id,
             op5_quality_rules, op6_token_counts, op7_kd_sharding, op8_byte_bpe, op9_line_dedup,
             op10_packing, op11_pii, op12_lexical_search, op13_periodic_runs)
    return {q.__name__: q for q in found}


CHAT_SQL = f"""
with rows as (
  select distinct conv_id, turn, coalesce(role, '{chat.NO_ROLE}') as role,
    coalesce(text, '') as text, cast(floor(turn / {chat.BLOCK}) as bigint) as block
  from conversations),
placed as (
  select *, row_number() over (partition by conv_id
    order by turn nulls first, role, text) - 1 as pos
  from rows),
prefixes as (
  select conv_id, pos, string_agg(role || chr(31) || text, chr(30)) over (
    partition by conv_id order by pos rows unbounded preceding) as prefix
  from placed),
ends as (
  select conv_id, max(pos) as pos, max_by(prefix, pos) as prefix from prefixes group by conv_id),
whole as (
  select min(conv_id) as conv_id, pos, prefix, count(*) as n_copies
  from ends group by pos, prefix),
maximal as (
  select w.* from whole w where not exists (
    select 1 from prefixes p join ends e using (conv_id)
    where p.pos < e.pos and p.pos = w.pos and p.prefix = w.prefix)),
blocks as (
  select conv_id, m.pos + 1 as n_turns, n_copies, block, min(p.pos) as start,
    string_agg('{chat.OPEN}' || role || chr(10) || text || '{chat.CLOSE.strip()}' || chr(10), ''
      order by p.pos) as text
  from maximal m join placed p using (conv_id) group by all)
select conv_id, cast(row_number() over (partition by conv_id order by start) - 1 as int) as part,
  cast(count(*) over (partition by conv_id) as int) as n_parts, n_turns, n_copies, text
from blocks
"""

STOP_LIST = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
FAILED = ", ".join(f"case when not ({quality.rule_sql(r)}) then '{r.name}' end"
                   for r in quality.RULES)
QUALITY_SQL = rf"""
with texts as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (
  select *, regexp_extract_all(text, '{quality.WORD}') as words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '{quality.WORD}')] as lines
  from texts),
windows as (
  select r, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select r, words, unnest(range(1, len(words) - 1)) as i from split)),
twice as (select r, a, b, c from windows group by all having count(*) > 1),
covered as (
  select distinct r, i + k as place
  from windows join twice using (r, a, b, c), (select unnest([0, 1, 2]) as k)),
repeated as (select r, count(*) as n from covered group by r),
counts as (
  select doc_id, cast(len(words) as bigint) as n_words,
    length(regexp_replace(text, '{quality.SPACE}', '', 'g')) as word_chars,
    length(regexp_replace(text, '{quality.NOT_SYMBOL}', '', 'g')) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    coalesce(n, 0) as n_repeat_words, cast(len(lines) as bigint) as n_lines,
    cast(len([x for x in words if x in ({STOP_LIST})]) as bigint) as n_stop_words
  from split left join repeated using (r)),
judged as (
  select *, n_words < {quality.LEAST_WORDS}
      or 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words as base_failed,
    concat_ws(',', {FAILED}) as failed_rules
  from counts)
select *, not base_failed and failed_rules = '' as kept from judged
"""

SEARCH_SQL = rf"""
with doc_terms as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'),
      '{lexical.TERM}') as terms
  from documents),
stats as (
  select count(*) as nd, sum(len(terms))::bigint as nt from doc_terms where len(terms) > 0),
item_terms as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')) as term
  from benchmark),
tf as (
  select r, term, count(*) as tf from (select r, unnest(terms) as term from doc_terms)
  where term in (select term from item_terms) group by all),
weights as (
  select term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::bigint as w
  from tf, stats group by term, nd),
parts as (
  select r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * nd) // nt)))
    as part
  from tf join weights using (term) join doc_terms using (r), stats),
scores as (
  select item_id, r, sum(part)::bigint as score
  from item_terms join parts using (term) group by all having sum(part) > 0),
ranked as (
  select item_id, doc_id, score, cast(row_number() over (partition by item_id
    order by score desc, doc_id nulls last) as int) as rank
  from scores join doc_terms using (r))
select item_id, rank, doc_id, score from ranked where rank <= {lexical.TOP}
"""


def llm_oracles() -> dict[str, str]:
    return {"op2_chat_formatting": CHAT_SQL, "op5_quality_rules": QUALITY_SQL,
            "op12_lexical_search": SEARCH_SQL}
