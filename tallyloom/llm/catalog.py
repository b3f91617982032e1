"""Registered queries of this subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import annlinks, bytebpe, dialogue, minhash, mixing, phrases, pii, quality, store, suffixes, tokenfile, urlfilter, vectorcodes, vptree

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_read(spark, sf_dir, "embeddings"), k=20, query_modulus=20, factor=1.0)


def op2_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.deduplicate(_read(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(_read(spark, sf_dir, "documents"), BYTE_BPE)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_read(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.folder(spark, "token-ids")
    tokenfile.write(tokenfile.encoded(_read(spark, sf_dir, "documents"), WORD_BPE, end_id=2), path)
    return tokenfile.digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annlinks.links(_read(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.errors(_read(spark, sf_dir, "embeddings"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.digests(dialogue.damaged(_read(spark, sf_dir, "conversations")))


#: The contract's rules.
URL_RULES = "SELECT * FROM VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS r(host, path, verdict)"


def op13_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), spark.sql(URL_RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_vp_tree, op2_phrase_dedup, op3_minhash, op4_byte_bpe, op5_suffix_dedup, op6_pii_anchors, op7_source_mix, op8_token_files, op9_quality, op10_embedding_links, op11_vector_codes, op12_dialogue_repair, op13_url_cascade)}
