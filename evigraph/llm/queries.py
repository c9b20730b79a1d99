"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles
from .common import fold, read

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_url_filter", oracles.url_filter_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the model that grows with the pages."""
    from .url_filter import judge_long

    return judge_long(read(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    docs = read(spark, sf_dir, "documents")
    scored = quality_rules.score(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op8_suffix_dedup", oracles.SUFFIX_DEDUP)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    rows = remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_near_vectors", oracles.NEAR_VECTORS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_links

    return near_links(read(spark, sf_dir, "embeddings"))


@query("op10_jaccard_join", oracles.JACCARD)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_sets

    return near_sets(read(spark, sf_dir, "documents"), words=3, percent=90)


@query("op6_hilbert_search")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_search import search

    return search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op5_piece_sampler")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every sampled segmentation, with the text decoded again from its pieces held against the input."""
    import public_tokenizers

    from .piece_sampler import decoded_digest, sample_encodings

    path = public_tokenizers.path("piece_bpe_32k.model")
    return decoded_digest(sample_encodings(read(spark, sf_dir, "documents"), path), path, ["doc_id", "rank", "log_prob", "inclusion"])


@query("op11_warc", oracles.WARC)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back; revisits take their size from the response they name."""
    from .warc import round_trip

    pages = read(spark, sf_dir, "pages")
    back = round_trip(pages)
    kind = pages.schema["page_id"].dataType
    named = F.when(F.col("type") == "revisit", F.col("full_key")).cast(kind).alias("refers_to")
    return back.select(F.col("page_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), named)


@query("op12_source_divergence", oracles.DIVERGENCE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(read(spark, sf_dir, "documents"))


@query("op13_simplex_clusters", oracles.clusters_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simplex_clusters import centroid_digest, cluster

    rows = cluster(read(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest(F.col("centroid")).alias("centroid_sha256"))
