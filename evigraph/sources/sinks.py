"""Sinks with checks, content fingerprints, resume and drift detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import as_col


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; the job's commit makes the folder appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """CSV with a fixed column order. ``files=1`` is for aggregated reports only."""
    out = df.select(*columns)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def archive_answers(answers: DataFrame, path: str, methods: int, questions: int | None = None) -> None:
    """Write answers as JSON only if every question has all methods exactly once."""
    per = answers.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("method").alias("m"))
    facts = per.agg(F.count(F.lit(1)).alias("q"), F.count_if((F.col("n") != methods) | (F.col("m") != methods)).alias("bad")).first()
    if facts.bad or (questions is not None and facts.q != questions):
        raise ValueError(f"incomplete archive: {facts.q} questions, {facts.bad} without exactly {methods} methods")
    write_json(answers, path)


def text_fingerprint(text, size: int, variant: str) -> Column:
    """Twelve hex digits over the numbered lines of a text, the chunk size and a variant name."""
    rows = F.transform(F.split(as_col(text), "\n"), lambda x, i: F.concat(i.cast("string"), F.lit("\t"), x, F.lit("\n")))
    return F.left(F.sha1(F.concat(F.array_join(rows, ""), F.lit(f"{size}{variant}"))), F.lit(12))


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a good result: same key, version and content hash, and no error."""
    good = done.filter(F.coalesce("error", F.lit("")) == "").select(*keys)
    return items.join(good, keys, "left_anti")


def manifest(spark: SparkSession, path: str, key_pattern: str) -> DataFrame:
    """Key, size and digest of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.regexp_extract("path", key_pattern, 1).alias("key"), "length", F.sha2("content", 256).alias("sha"), "path")
    ordered = F.array_sort(F.collect_list(F.struct("path", "sha")))
    per = rows.filter("key <> ''").groupBy("key").agg(F.sum("length").alias("bytes"), F.transform(ordered, lambda s: s["sha"]).alias("digests"))
    return per.select("key", "bytes", F.sha2(F.array_join("digests", ","), 256).alias("sha"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose content changed, vanished or appeared between two manifests."""
    a = old.select("key", F.col("sha").alias("old_sha"))
    b = new.select("key", F.col("sha").alias("new_sha"))
    state = (
        F.when(F.col("new_sha").isNull(), "missing").when(F.col("old_sha").isNull(), "new")
        .when(F.col("old_sha") != F.col("new_sha"), "changed").otherwise("same")
    )
    return a.join(b, "key", "full").select("key", state.alias("state"))
