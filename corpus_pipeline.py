"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. quality: documents that the rule ensemble rejects (score below 0.3) go.
2. near_duplicates: of each group linked by shingle similarity, the document of smallest id stays. The
   stage takes five words a shingle and a similarity of 0.8.
3. repeats: every byte covered by a 100-byte string that also starts earlier goes; what a cut leaves of
   a character goes with it. A document may end up empty, and stays.
4. mixture: documents are repeated or left out so that sources come near their target shares; empty
   documents add no words and follow their source.
5. pieces: distinct sampled segmentations of each document, as piece ids.

All stages but the last return the columns of ``documents``; extra columns pass through. Null and
repeated ids, null texts and empty tables pass as each operator defines; of rows that share an id, the
second stage keeps the one of smallest text, and rows without an id link with nothing and stay.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evigraph.common import cut_lineage, first_per_key
from evigraph.llm import jaccard_join, mixing, piece_sampler, quality_rules, suffix_dedup
from evigraph.llm.common import read


#: Columns that stages read by name.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(stage):
    """The stage with every other column under a plain name of its own, so that no name clashes inside it."""

    @functools.wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in OWN else f"extra_{i}" for i, c in enumerate(docs.columns)]
        names = dict(zip(inner, docs.columns))
        out = stage(spark, docs.toDF(*inner), sf_dir)
        return out.toDF(*[names.get(c, c) for c in out.columns])

    return run_apart


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.score(docs, model, docs.columns, names=("_score", "_good")).filter("_good = 1").select(*docs.columns)


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = jaccard_join.near_sets(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = first_per_key(docs.join(kept, "doc_id", "left_semi"), ["doc_id"], ["text"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


@_apart
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    rows = suffix_dedup.remove_repeats(docs, keep=others, whole=True)
    rows = rows.withColumn("text", F.decode("kept", "UTF-8")).withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


@_apart
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@_apart
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampler.sample_encodings(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("pieces", pieces)]

#: Fitted models, sampled segmentations and byte-wise dedup have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
