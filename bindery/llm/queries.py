"""Registry of the problem queries of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import boilerplate, leaks, lookalike, mojibake, names, subjects, tokens
from bindery.session import read


def _records(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.book_records(read(spark, d, "text_region"), read(spark, d, "toc_entry"), read(spark, d, "bookmark_node"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(_records(spark, d))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(_records(spark, d))


REGION = ["doc_id", "page_index", "revision", "region_id"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(read(spark, d, "text_region"), "text", REGION, "site", "doc_id")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_lines(read(spark, d, "text_region"), "text", REGION, p3_found(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    key = ["doc_id", "page_index", "revision"]
    region = read(spark, d, "text_region").select(F.lit("text_region").alias("tab"), *key, F.col("region_id").alias("rec_no"), "text")
    line = read(spark, d, "text_line").select(F.lit("text_line").alias("tab"), *key, F.col("line_no").alias("rec_no"), "text")
    return region.unionByName(line)


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return mojibake.restored(texts, "text", ["tab", "doc_id", "page_index", "revision", "rec_no"], mojibake.model(texts, "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("tab", "doc_id", "page_index", "revision", "rec_no").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(read(spark, d, "contributor"), "contributor_id", "name")


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(read(spark, d, "contributor"), "contributor_id", "name")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(os.environ.get("BINDERY_TOKENIZERS", "/opt/tokenizers"), name)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"), "doc_id", "text", tokenizer_path())


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.spans(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_item"), "item_id", ["passage", "question"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


def _quoted(spark: SparkSession, d: str) -> Iterator[list[str]]:
    """Texts of the evaluation items, in blocks; one block at a time is on the driver."""
    rows = read(spark, d, "eval_item").select(F.explode(F.array("passage", "question")).alias("t")).where("t is not null").distinct().orderBy("t")
    return subjects.blocks(r[0] for r in rows.toLocalIterator())


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    names_ = sorted(r[0] for r in read(spark, d, "subject").select("subject").distinct().toLocalIterator() if r[0])
    model = subjects.fit(docs, "doc_id", "text", read(spark, d, "subject_label"), "subject", names_, _quoted(spark, d))
    return subjects.assign(docs, "doc_id", "text", model, _quoted(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
