"""The thin opN_ queries: each derives its contract's columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ruleweave.llm import bwt_dedup, chat, decontam, langid, lattice, licenses, sharding, simhash, sp_codec, token_counts
from ruleweave.llm.common import table

#: The vocabulary of operators 1 and 8; a file outside this repository.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_decode(table(spark, sf_dir, "documents"), MODEL)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.repeated_bytes(table(spark, sf_dir, "documents"), length=50)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.format_log(chat.log_of(turns), digest=True)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), n_shards=24)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), MODEL)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.default_templates(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_license_scan": op10_license_scan,
}

#: DuckDB SQL of those that SQL can express.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATE_ROWS = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.TEMPLATES.items())
ORACLE: dict[str, str] = {
    "op3_decontamination": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        b as (select item_id, {_WORDS} as w from benchmark),
        bw as (select distinct item_id, least(len(w), 13) as m, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') as win
               from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as k from b where len(w) > 0)),
        dw as (select doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') as win
               from (select doc_id, m, w, unnest(range(1, len(w) - m + 2)) as k from d, (select distinct m from bw) where len(w) >= m)),
        hits as (select doc_id, k, dw.m, item_id from dw join bw on dw.win = bw.win and dw.m = bw.m),
        covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + m)) as p from hits) group by doc_id),
        named as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join covered on d.doc_id = covered.doc_id left join named on d.doc_id = named.doc_id""",
    "op5_chat_formatting": r"""
        with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
                   union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e as (select *, length(text)
                + len(regexp_extract_all(text, '\\'))
                + len(regexp_extract_all(text, '<s>|</s>|\[/?INST\]|\[/?SYS\]|\[ASST\]|\[/?ROLE'))
                + len(regexp_extract_all(text, '\]'))
                + case when text like '% ' then 1 else 0 end
                + case role when 'user' then 15 when 'system' then 13 when 'assistant' then 12 else null end as size from c)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(size) + 3 as bigint) as formatted_chars
        from e group by conv_id""",
    "op9_embedding_near_dedup": """
        with recursive l as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id
                   where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.98),
        r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
        m as (select a, min(b) as component_id from r group by a),
        n as (select a, count(*) as n from l group by a)
        select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
        from embeddings join m on vec_id = m.a left join n on vec_id = n.a""",
    "op10_license_scan": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        t as (select license_id, {_WORDS} as w from (values {_TEMPLATE_ROWS}) as x(license_id, text)),
        ts as (select distinct license_id, cast(pow(2, ceil(log2(greatest(len(w) * 1.25, 8)))) as integer) as size, array_to_string(w[k:k + 4], ' ') as s
               from (select license_id, w, unnest(range(1, len(w) - 3)) as k from t)),
        ds as (select doc_id, k - 1 as pos, array_to_string(w[k:k + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5)),
        f as (select distinct doc_id, license_id, size, pos // size - i as k, ts.s from ds join ts on ds.s = ts.s, (values (0), (1)) as x(i) where pos // size - i >= 0),
        m as (select doc_id, license_id, k * size as first_word, count(*) / any_value(n) as share from f join (select license_id, count(*) as n from ts group by license_id) using (license_id)
              group by doc_id, license_id, size, k having count(*) / any_value(n) >= 0.8),
        g as (select doc_id, count(distinct license_id) as n, string_agg(distinct license_id, ',' order by license_id) as licenses, max(share) as share, min(first_word) as first_word from m group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_licenses, coalesce(licenses, '') as licenses,
               round(coalesce(share, 0.0), 6) as containment, cast(first_word as integer) as first_word
        from d left join g on d.doc_id = g.doc_id""",
}
