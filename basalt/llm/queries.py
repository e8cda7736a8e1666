"""The queries of the operators and of the pipeline, with DuckDB SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_secret_scan(spark, sf_dir):
    from basalt.llm import secrets

    model = secrets.train(secrets.generated_samples(table(spark, sf_dir, "benchmark")))
    return secrets.summary(table(spark, sf_dir, "documents"), model)


@_query
def op4_exact_dedup(spark, sf_dir):
    from basalt.llm import exactdedup

    return exactdedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
ORACLES["op4_exact_dedup"] = f"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


@_query
def op6_source_mixing(spark, sf_dir):
    from basalt.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


@_query
def op9_best_fit_packing(spark, sf_dir):
    from basalt.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op5_quality_classifier(spark, sf_dir):
    from basalt.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op8_toxicity(spark, sf_dir):
    from basalt.llm import toxicity

    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op7_hash_prefix_forest(spark, sf_dir):
    from basalt.llm import neighbours

    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@_query
def op10_licence_scan(spark, sf_dir):
    from basalt.llm import licences

    return licences.scan(licences.documents_as_files(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@_query
def op3_ngram_jaccard_join(spark, sf_dir):
    from basalt.llm import jaccard

    return jaccard.components(table(spark, sf_dir, "documents"))


@_query
def op3_ngram_jaccard_links(spark, sf_dir):
    from basalt.llm import jaccard

    return jaccard.links(table(spark, sf_dir, "documents"))


@_query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@_query
def op2_suffix_array_dedup(spark, sf_dir):
    from basalt.llm import substrings

    return substrings.summary(table(spark, sf_dir, "documents"))


ORACLES["op1_secret_scan"] = oracles.secrets_sql()
ORACLES["op2_suffix_array_dedup"] = oracles.REPEATS
ORACLES["op3_ngram_jaccard_join"] = oracles.JACCARD
ORACLES["op3_ngram_jaccard_links"] = oracles.JACCARD_LINKS
