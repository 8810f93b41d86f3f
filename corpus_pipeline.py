"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of documents.
A row without doc_id is kept by the near-duplicate stage; rows that share a doc_id are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe_stream, cross_parse, decontaminate, pii, token_group_join
from sparkloom.llm.store import saved, table


def _row(docs: DataFrame):
    return F.struct(*(docs[c] for c in docs.columns)).alias("__row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without a letter go, and no others, also where no label tells of any language."""
    samples = cross_parse.sample_texts(docs)
    if not any(map(any, samples.values())):
        return cross_parse.lettered(docs)
    found = cross_parse.identify(docs, samples, _row(docs))
    return found.where("lang_pred != 'und'").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the document of least doc_id."""
    groups = token_group_join.jaccard_components(docs, size=5, percent=80)
    return docs.join(groups.where("doc_id != component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    found = pii.detect(docs, _row(docs))
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("n_added") + F.length("spans") > 0, F.length("redacted").cast("bigint")).otherwise(F.col("__row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*(new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their number of tokens and the digests of ids, decoded text and words, which take the place of columns of these names."""
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "text_sha256")
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return bpe_stream.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), _row(docs)).select(*kept, *new)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination), ("personal_data", personal_data), ("bpe_round_trip", bpe_round_trip)]

#: No SQL says what the stages do; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
