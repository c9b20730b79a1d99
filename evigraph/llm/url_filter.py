"""URL filter: host and path rules, and a character language-model ratio for urls that no rule fits.

Two variable-order Markov models over url characters are learnt from the urls that the rules accept and
reject. Contexts of ``ORDER`` down to 0 characters are mixed by Witten-Bell smoothing: the more often a
context was seen with few different successors, the more its own counts weigh against the next shorter
context. A url is judged by the difference of both log-likelihoods, divided by its length, against a
threshold calibrated on rule-labelled urls that the models have not seen.

``judge_long`` is the registered form: its model is a table that grows with the pages, of real characters
in every context that occurs. ``judge`` is a small form for samples and streams: order 2 over 35 folded
symbols, so its model is an array of 35^3 numbers whatever the input, which travels to each task as a
scalar subquery.

Only DataFrame and SQL functions run. Counting combines in the map tasks before its shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, and no rule fits it;
its score is 0 by ``judge_long``. Equal urls get equal verdicts. Without labelled urls of both kinds the
score is 0 and the threshold 0, which allows. Columns of the input beyond id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evigraph.common import cut_lineage

#: Letters, the digit class, and url signs; every other character folds to "?". 0 is the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_%?$"
A = len(ALPHABET) + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Threshold steps per unit of score, and the largest score they tell apart.
STEPS, TOP = 100, 10
FOLDS = 5
#: Longest context of the model that grows with the pages, and the fractions of a log-probability that its sums count.
ORDER, UNITS = 6, 10**9

DEFAULT_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased. Path: from there up to ``? #``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (verdict, rule) of the longest fitting rule, else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def codes(host: Column, path: Column) -> Column:
    """One number per character and one for the end: the symbols before it and its own, in base ``A``."""
    folded = F.regexp_replace(F.translate(F.lower(F.concat(host, path)), "123456789", "0" * 9), "[^a-z0./_%$-]", "?")
    ids = F.transform(F.split(F.concat(F.lit(">>"), F.regexp_replace(folded, r"\$", "?"), F.lit("$")), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.length(folded) + 1
    # Shifted copies instead of look-ups by place: an array expression inside a lambda is evaluated once per element.
    pairs = F.zip_with(F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n), lambda a, b: a * A + b)
    return F.zip_with(pairs, F.slice(ids, F.lit(3), n), lambda ab, c: ab * A + c)


def log_likelihoods(counts: DataFrame, kinds: list[str]) -> DataFrame:
    """Columns code and one log-probability per kind, for all ``A``^3 codes, from (code, kind, n)."""
    spark = counts.sparkSession
    wide = counts.groupBy("code").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
    grid = spark.range(A**3).select(
        F.col("id").cast("int").alias("code"), (F.col("id") / (A * A)).cast("int").alias("a"), ((F.col("id") / A) % A).cast("int").alias("b"), (F.col("id") % A).cast("int").alias("c")
    )
    cells = grid.join(wide, "code", "left").select("code", "a", "b", "c", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
    pairs = cells.groupBy("b", "c").agg(*[F.sum(k).alias(f"{k}_bc") for k in kinds])
    ones = pairs.groupBy("c").agg(*[F.sum(f"{k}_bc").alias(f"{k}_c") for k in kinds])
    ab = cells.groupBy("a", "b").agg(*[x for k in kinds for x in (F.sum(k).alias(f"{k}_ab"), F.sum((F.col(k) > 0).cast("int")).alias(f"{k}_ab_t"))])
    b = pairs.groupBy("b").agg(*[x for k in kinds for x in (F.sum(f"{k}_bc").alias(f"{k}_b"), F.sum((F.col(f"{k}_bc") > 0).cast("int")).alias(f"{k}_b_t"))])
    total = ones.select(*[F.sum(f"{k}_c").alias(f"{k}_all") for k in kinds], F.lit(1).alias("one"))
    joined = cells.join(pairs, ["b", "c"]).join(ones, "c").join(ab, ["a", "b"]).join(b, "b").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    out = ["code"]
    for k in kinds:
        n = lambda s, k=k: F.col(f"{k}{s}")
        p0 = (n("_c") + 1.0) / (n("_all") + F.lit(float(A)))
        p1 = F.when(n("_b") > 0, (n("_bc") + n("_b_t") * p0) / (n("_b") + n("_b_t"))).otherwise(p0)
        p2 = F.when(n("_ab") > 0, (n("") + n("_ab_t") * p1) / (n("_ab") + n("_ab_t"))).otherwise(p1)
        out.append(F.log(p2).alias(k))
    return joined.select(*out)


def ratio_model(labelled: DataFrame) -> DataFrame:
    """One row: array of log-probability differences by code, from rows (codes, verdict)."""
    counts = labelled.select("verdict", F.explode("codes").alias("code")).groupBy("code", F.col("verdict").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    both = labelled.select(F.coalesce(F.count_if(F.col("verdict") == "allow"), F.lit(0)).alias("x"), F.count_if(F.col("verdict") == "block").alias("y"))
    known = both.select(((F.col("x") > 0) & (F.col("y") > 0)).cast("int").cast("double")).scalar()
    diff = log_likelihoods(counts, ["allow", "block"]).select("code", ((F.col("allow") - F.col("block")) * known).alias("d"))
    return diff.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "d"))), lambda x: x["d"]).alias("model"))


def score(codes_: Column, model: Column) -> Column:
    """Length-normalised log-likelihood difference."""
    return F.aggregate(codes_, F.lit(0.0), lambda acc, c: acc + F.element_at(model, c + 1)) / F.size(codes_)


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score that best parts held-out (score, verdict) rows by balanced accuracy; ties go to the smallest absolute value.

    Scores fall into at most 2 * TOP * STEPS + 1 steps before they meet.
    """
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-TOP)), F.lit(TOP)) * STEPS).cast("int")
    bins = scored.groupBy(step.alias("step")).agg(F.count_if(F.col("verdict") == "allow").alias("x"), F.count_if(F.col("verdict") == "block").alias("y"))
    packed = bins.agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("bins")).select("bins", F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + b["x"]).alias("xs"), F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + b["y"]).alias("ys"))
    over = packed.select("xs", "ys", F.explode("bins").alias("cut"), "bins").select(
        (F.col("cut.step") / float(STEPS)).alias("at"),
        (F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + F.when(b["step"] >= F.col("cut.step"), b["x"]).otherwise(0)) / F.col("xs")
         + F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + F.when(b["step"] < F.col("cut.step"), b["y"]).otherwise(0)) / F.col("ys")).alias("good"),
    )
    return over.agg(F.coalesce(F.min_by("at", F.struct(-F.round("good", 9), F.abs("at"), "at")), F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns id, host, path, rule, verdict, score, threshold for every row."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules))
    labelled = rows.filter("fit IS NOT NULL").select(codes(F.col("host"), F.col("path")).alias("codes"), F.col("fit.verdict").alias("verdict"), (F.crc32(F.col("_url").cast("binary")) % FOLDS == 0).alias("held"))
    model = ratio_model(labelled.filter("NOT held")).scalar()
    held = labelled.filter("held").withColumn("model", model)
    cut = threshold(held.select(score(F.col("codes"), F.col("model")).alias("score"), "verdict")).scalar()
    rows = rows.withColumn("_model", model).withColumn("score", score(codes(F.col("host"), F.col("path")), F.col("_model"))).withColumn("threshold", cut)
    own = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return rows.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "score", "threshold")


def grams(texts: DataFrame, order: int) -> DataFrame:
    """Rows (size, ctx, next, allow, block): how often a character follows a context, from rows (text, allow, block).

    Every character of every text and the end of each (next = "") is there once for each context size, also
    where both counts are 0. A context shorter than its size is the whole text before: it includes the start.
    """
    tops = texts.select("text", "allow", "block", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("i")).select(*top_gram(order), "allow", "block")
    distinct = tops.groupBy("size", "ctx", "next").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    every = distinct.select("ctx", "next", "allow", "block", F.explode(F.sequence(F.lit(0), "size")).alias("size"))
    return every.groupBy("size", F.expr("right(ctx, size)").alias("ctx"), "next").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def top_gram(order: int) -> list[Column]:
    """Columns size, ctx, next of the character at place ``i`` of ``text`` after its longest context."""
    size = F.least(F.lit(order), F.col("i") + 1)
    start = F.greatest(F.col("i") - order, F.lit(0))
    return [size.alias("size"), F.substring(F.col("text"), start + 1, F.col("i") - start).alias("ctx"), F.substring(F.col("text"), F.col("i") + 1, F.lit(1)).alias("next")]


def back_off(counted: DataFrame, order: int) -> DataFrame:
    """Columns size, ctx, next, d: difference of both log-probabilities of each gram, as whole ``UNITS``.

    A gram joins the one of the next shorter context, which at most as many grams share as there are characters. These
    tables lie packed in few bytes on disk, and grow with the pages: sort-merge joins by hint keep them out of the driver.
    """
    own = W.partitionBy("size", "ctx")
    kinds = ("allow", "block")
    totals = [x for k in kinds for x in (F.sum(k).over(own).alias(f"{k}_n"), F.count_if(F.col(k) > 0).over(own).alias(f"{k}_t"))]
    wide = cut_lineage(counted.select("size", "ctx", "next", *kinds, *totals, F.count(F.lit(1)).over(own).alias("symbols")))
    p = [((F.col(k) + 1.0) / (F.col(f"{k}_n") + F.col("symbols"))).alias(f"p_{k}") for k in kinds]
    level = wide.filter("size = 0").select("size", "ctx", "next", *p)
    out = [level]
    for size in range(1, order + 1):
        rows = wide.filter(F.col("size") == size).withColumn("short", F.right("ctx", F.lit(size - 1)))
        below = level.select(F.col("ctx").alias("short"), "next", *[F.col(f"p_{k}").alias(f"q_{k}") for k in kinds])
        p = [F.when(F.col(f"{k}_n") > 0, (F.col(k) + F.col(f"{k}_t") * F.col(f"q_{k}")) / (F.col(f"{k}_n") + F.col(f"{k}_t"))).otherwise(F.col(f"q_{k}")).alias(f"p_{k}") for k in kinds]
        level = cut_lineage(rows.join(below.hint("merge"), ["short", "next"]).select("size", "ctx", "next", *p))
        out.append(level)
    every = out[0]
    for level in out[1:]:
        every = every.unionByName(level)
    return every.select("size", "ctx", "next", F.round((F.log("p_allow") - F.log("p_block")) * UNITS).cast("long").alias("d"))


def judge_long(pages: DataFrame, rules: list[tuple[str, str]] = DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """As ``judge``, by the model whose contexts and characters grow with the pages. An empty host and path scores 0."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    # One url may reach its text in several ways (scheme, query); each labelled row counts by its own fold.
    held = (F.crc32(F.col("_url").cast("binary")) % FOLDS == 0) & F.col("fit").isNotNull()
    rows = rows.withColumn("held", held).drop("_url")
    seen = lambda k, h: F.count_if((F.col("fit.verdict") == k) & (F.col("held") == h))
    texts = cut_lineage(rows.groupBy("text").agg(seen("allow", False).alias("allow"), seen("block", False).alias("block"), seen("allow", True).alias("x"), seen("block", True).alias("y")).filter("text <> ''"))
    both = texts.agg(F.coalesce(F.sum("allow"), F.lit(0)).alias("a"), F.coalesce(F.sum("block"), F.lit(0)).alias("b"))
    known = both.select(((F.col("a") > 0) & (F.col("b") > 0)).cast("int")).scalar()
    values = back_off(grams(texts, order), order)
    places = texts.select("text", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("i")).select("text", *top_gram(order))
    # Whole numbers: the sums do not hang on the order of rows.
    sums = places.join(values.hint("merge"), ["size", "ctx", "next"]).groupBy("text").agg(F.sum("d").alias("d"))
    scored = cut_lineage(sums.join(texts.hint("merge"), "text").select("text", (F.col("d") * known / F.lit(float(UNITS)) / (F.length("text") + 1)).alias("score"), "x", "y"))
    cases = scored.select("score", F.explode(F.array_repeat(F.lit("allow"), F.col("x").cast("int"))).alias("verdict")).unionByName(scored.select("score", F.explode(F.array_repeat(F.lit("block"), F.col("y").cast("int"))).alias("verdict")))
    cut = threshold(cases).scalar()
    out = rows.join(scored.select("text", "score").hint("merge"), "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("threshold", cut)
    own = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return out.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "score", "threshold")
