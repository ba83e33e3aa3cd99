"""The registered queries of the corpus operators, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm import chat, decontamination, html_text, language_id, line_dedup, mixing, phrases, pii, quality, simhash, spelling, token_files, warc
from siftlog.llm.common import table
from siftlog.session import stage


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document."""
    rated = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", *quality.FEATURES, "base_failed", "kept", "ratio")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of repeated windows."""
    docs = table(spark, sf_dir, "documents")
    counts = line_dedup.counts_name(docs)
    return line_dedup.dedup_lines(docs).select("doc_id", F.col(f"{counts}.before").alias("n_lines"), F.col(f"{counts}.removed").alias("n_removed"), "text")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    return warc.convert_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select(F.col("_row.doc_id").alias("doc_id"), *counts, F.sha2(pii.joined_spans(pii.BASE), 256).alias("base_sha256"), pii.joined_spans().alias("spans"), pii.joined_scores().alias("scores"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as read back from its formatted text, and one that holds control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), said.alias("text"))
    done = chat.format_conversations(turns.unionByName(extra))
    read = chat.read_turns(F.col("formatted"))
    learnt = chat.loss_text(F.col("formatted"), F.col("loss"))
    text = F.array_join(F.transform("_turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))), "")
    return done.withColumns({"_turns": read, "_learnt": learnt}).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item and the score."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "n_words")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the binary files."""
    path = token_files.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = stage(token_files.with_checksums(token_files.read_shards(spark, path)), "token-rows")
    return token_files.with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_language_id, op2_source_mix, op3_quality_rules, op4_html_text, op5_line_dedup,
        op6_arc_to_warc, op7_personal_data, op8_chat_format, op9_benchmark_leaks, op10_simhash_groups,
        op11_collocations, op12_token_files, op13_spelling_variants,
    )
}

LINE_DEDUP = """
with parts as (
  select doc_id, text, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) as lines from documents
), numbered as (
  select doc_id, text, lines, list_filter(list_transform(range(1, len(lines) + 1), lambda i: {'i': i, 'line': lines[i]}), lambda x: x.line <> '') as held from parts
), shown as (
  select doc_id, p as place, held[p + 1].line || chr(10) || held[p + 2].line || chr(10) || held[p + 3].line as shingle
  from numbered, unnest(range(0, len(held) - 2)) as t(p)
), firsts as (
  select shingle, min({'doc_id': doc_id, 'place': place}) as first from shown group by shingle having count(*) > 1
), covered as (
  select distinct s.doc_id, s.place + k.k as place from shown s join firsts f using (shingle), (values (0), (1), (2)) k(k)
  where {'doc_id': s.doc_id, 'place': s.place} <> f.first
), gone as (
  select c.doc_id, list(n.held[c.place + 1].i) as gone from covered c join numbered n using (doc_id) group by c.doc_id
), kept as (
  select n.doc_id, n.text, len(n.lines) as n_lines, coalesce(len(g.gone), 0) as n_removed, g.gone from numbered n left join gone g using (doc_id)
)
select doc_id, case when text is null then 0 else n_lines end as n_lines, n_removed,
  case when gone is null then text else
    array_to_string(list_transform(list_filter(range(1, n_lines + 1), lambda i: not list_contains(gone, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) end as text
from kept
"""

DIGITS = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {} + 1, 1)"
_BASE32 = " || ".join(DIGITS.format(f"((('0x' || substr(hex, {1 + 5 * (k // 4)}, 5))::bigint >> {15 - 5 * (k % 4)}) & 31)") for k in range(32))
ARC_TO_WARC = f"""
with hashed as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
named as (select page_id, payload_bytes, {_BASE32} as payload_digest from hashed),
firsts as (select payload_digest, min(page_id) as first from named group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from named join firsts using (payload_digest)
"""

CHAT_FORMAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
    regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') as safe_role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as safe_text from turns
), sums as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as learnt,
    sum(length(safe_text) + case when before = role then length('<|im_next|>') else length('<|im_start|>' || safe_role || '<|im_sep|>' || '<|im_end|>') end) as formatted_chars
  from marked group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, formatted_chars::bigint as formatted_chars from sums
"""

COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), lists as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), totals as (
  select lang, sum(len(w))::bigint as n from lists group by lang
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from lists
), grams as (
  select lang, w[i:i + k - 1] as g, k, count(*) as f from places, range(1, 6) s(k) where i + k - 1 <= len(w) group by all having count(*) >= 100
), cuts as (
  select c.lang, c.g, c.k, c.f as a, cut, l.f as l, r.f as r, n, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
  from grams c, range(1, 5) s(cut), grams l, grams r, totals t
  where c.k >= 2 and cut < c.k and l.lang = c.lang and l.g = c.g[1:cut] and r.lang = c.lang and r.g = c.g[cut + 1:] and t.lang = c.lang
), scored as (
  select * from cuts qualify row_number() over (partition by lang, g order by score, cut) = 1
), held as (
  select lang, g[i:i + m - 1] as g, max(f) as f from grams, range(2, 5) s(m), range(1, 5) p(i) where m < k and i + m - 1 <= k group by all
), kept as (
  select s.* from scored s left join held h on h.lang = s.lang and h.g = s.g where h.f is null or 100 * h.f < 100 * s.a
), ranked as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from kept
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from ranked qualify rank <= 2000
"""

SQL = {"op11_collocations": COLLOCATIONS, "op5_line_dedup": LINE_DEDUP, "op6_arc_to_warc": ARC_TO_WARC, "op8_chat_format": CHAT_FORMAT}
