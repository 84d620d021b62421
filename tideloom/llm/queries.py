"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_blocks import token_blocks

    return token_blocks(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fertility import quality

    return quality(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeats

    return repeats(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"), size=3, percent=85).drop("key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import byte_bpe

    return byte_bpe(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc, op3_token_blocks, op4_fertility, op5_suffix_array, op6_language, op7_near_dedup, op8_toxicity, op9_packing, op10_byte_bpe, pipeline)}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as text from documents),
        g as (select text, max(doc_id) as keep_id, count(*) as group_size from d group by text)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.text) as text_sha256
        from d join g on d.text = g.text""",
    "op2_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        g as (select html, min(page_id) as first_id from p group by html),
        r as (select p.page_id, octet_length(encode(p.html)) as payload_bytes, sha256(p.html) as payload_digest, g.first_id
              from p join g on p.html = g.html)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
        from r""",
}
