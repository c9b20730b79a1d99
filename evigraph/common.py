"""Shared building blocks: tables, scratch space, lineage cuts, keyed scans and top-k."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


#: Session setting for tests and benchmarks on one machine: small text tables are dealt out to all cores.
SPREAD = "spark.evigraph.spreadSmallTexts"


def build_session(master: str = "local[8]", partitions: int = 8, **conf) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("evigraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "7g")
        .config(SPREAD, "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" and spark.conf.get(SPREAD, "false") == "true" else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small input out to all cores; text work on one row group would use a single task.

    Inputs with at least one split per core stay as they are, so no large table is moved by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


_own_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or one temp folder a process in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="evigraph-"))
    return _own_dirs[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Materialise in the shared folder, so lost executors cost nothing that came before.

    A written table starts a fresh plan: a checkpoint would carry the inferred constraints of
    every earlier loop round, which makes planning time grow with each one. ``keep_layout``
    checkpoints instead, for a table whose partitioning later joins rely on.
    """
    spark = df.sparkSession
    if keep_layout:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        return df.checkpoint()
    path = scratch_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a ``cut_lineage`` result that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key, ranked from 1. The filter lets Spark cut groups before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Smallest row per key by ``order``. An aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if rest and set(rest) <= set(order):  # what is compared is all that is returned: it travels once
        return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_best")).select(*keys, *[f"_best.{c}" for c in rest])
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    blocks: list[str],
    order: list[str],
    wanted: dict[str, tuple[str, Column | str]],
) -> DataFrame:
    """Running values per key without putting a whole key into one task.

    ``blocks`` cut each key into bounded runs whose order agrees with ``order``. A window
    runs inside each block; one summary row per block is then scanned per key and joined
    back as the carry. Kinds: ``count``, ``sum`` (inclusive), ``sum_before``, ``max``,
    ``last`` (latest non-null up to here) and ``next`` (first non-null after here).
    """
    inside = W.partitionBy(*keys, *blocks).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    after = inside.rowsBetween(1, W.unboundedFollowing)
    across = W.partitionBy(*keys).orderBy(*blocks)
    past = across.rowsBetween(W.unboundedPreceding, -1)
    future = across.rowsBetween(1, W.unboundedFollowing)

    local, summary, carry, final = df, [], {}, {}
    source = lambda c: F.col(c) if isinstance(c, str) else c
    for name, (kind, col) in wanted.items():
        part, tot, off = f"_{name}_in", f"_{name}_blk", f"_{name}_off"
        if kind == "count":
            local = local.withColumn(part, F.row_number().over(inside))
            summary.append(F.count(F.lit(1)).alias(tot))
            carry[off] = F.coalesce(F.sum(tot).over(past), F.lit(0))
            final[name] = F.col(part) + F.col(off)
        elif kind in ("sum", "sum_before"):
            frame = upto if kind == "sum" else before
            local = local.withColumn(part, F.coalesce(F.sum(source(col)).over(frame), F.lit(0)))
            summary.append(F.coalesce(F.sum(source(col)), F.lit(0)).alias(tot))
            carry[off] = F.coalesce(F.sum(tot).over(past), F.lit(0))
            final[name] = F.col(part) + F.col(off)
        elif kind == "max":
            local = local.withColumn(part, F.max(source(col)).over(upto))
            summary.append(F.max(source(col)).alias(tot))
            carry[off] = F.max(tot).over(past)
            final[name] = F.greatest(part, off)
        elif kind == "last":
            local = local.withColumn(part, F.last(source(col), True).over(upto))
            summary.append(F.max_by(source(col), F.when(source(col).isNotNull(), F.struct(*order))).alias(tot))
            carry[off] = F.last(tot, True).over(past)
            final[name] = F.coalesce(part, off)
        elif kind == "next":
            local = local.withColumn(part, F.first(source(col), True).over(after))
            summary.append(F.min_by(source(col), F.when(source(col).isNotNull(), F.struct(*order))).alias(tot))
            carry[off] = F.first(tot, True).over(future)
            final[name] = F.coalesce(part, off)
        else:
            raise ValueError(kind)
    carries = df.groupBy(*keys, *blocks).agg(*summary)
    for off, col in carry.items():
        carries = carries.withColumn(off, col)
    carries = carries.select(*keys, *blocks, *carry)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*keys, *blocks]]
    joined = local.alias("l").join(carries.alias("c"), same, "left")
    joined = joined.select("l.*", *[f"c.{off}" for off in carry])
    for name, col in final.items():
        joined = joined.withColumn(name, col)
    return joined.select(*df.columns, *wanted)
