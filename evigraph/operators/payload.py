"""Turn raw model payloads (JSON text columns) into validated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..common import first_per_key, prefix_scan
from ..functions import constants as K
from ..functions.answers import answer_letter
from ..functions.text import as_col, norm_text, squash_text, time_day, time_period
from .ground import contained_pairs

ENTITY = (
    "entities array<struct<name:string,type:string,aliases:array<string>,description:string,salience:string,"
    "attributes:string,mentions:array<struct<text:string,sentence_index:string>>>>"
)
RELATION = (
    "relations array<struct<source:string,target:string,type:string,evidence:string,sentence_index:string,"
    "confidence:string,decoy:boolean,importance:string>>"
)
SPANS = "kept array<struct<text:string,time_label:string>>, dropped array<struct<text:string,reason:string>>"
KINDS = ("support", "contradict", "decoy")


def _clamp(c: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def _items(payloads: DataFrame, schema: str, field: str, cap: int | None) -> DataFrame:
    """Explode one array of a JSON payload, first ``cap`` items, keeping their position."""
    items = F.from_json("payload", schema)[field]
    if cap is not None:
        items = F.slice(items, 1, cap)
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*keep, F.posexplode(items).alias("pos", "item")).select(*keep, "pos", "item.*")


def validated_entities(payloads: DataFrame, cap: int = 40) -> DataFrame:
    """Typed, named entities with cleaned aliases, mentions, description and salience."""
    rows = _items(payloads, ENTITY, "entities", cap)
    aliases = F.slice(F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: a != ""), 1, 6)
    index = lambda m: m["sentence_index"].try_cast("int")
    mentions = F.filter(
        F.transform(F.slice("mentions", 1, 6), lambda m: F.struct(F.trim(m["text"]).alias("text"), index(m).alias("sentence_index"))),
        lambda m: (m["text"] != "") & (m["sentence_index"] >= 0),
    )
    kind = F.trim(F.coalesce("type", F.lit("evidence_sentence")))
    return (
        rows.withColumn("name", F.trim("name")).withColumn("type", kind)
        .filter((F.col("name") != "") & F.col("type").isin(K.NODE_TYPES))
        .withColumn("aliases", F.coalesce(aliases, F.array().cast("array<string>")))
        .withColumn("mentions", F.coalesce(mentions, F.array().cast("array<struct<text:string,sentence_index:int>>")))
        .withColumn("description", F.left(F.coalesce("description", F.lit("")), F.lit(120)))
        .withColumn("salience", _clamp(F.coalesce(F.col("salience").try_cast("int"), F.lit(3)), 1, 5))
        .withColumn("attributes", attribute_map("attributes"))
    )


def validated_relations(payloads: DataFrame, cap: int = 60, default_confidence: float = 0.9) -> DataFrame:
    """Relations of a known type with endpoints, evidence and a sentence index."""
    rows = _items(payloads, RELATION, "relations", cap)
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.lit(default_confidence))
    out = (
        rows.withColumn("source", F.trim("source")).withColumn("target", F.trim("target"))
        .withColumn("type", F.trim("type")).withColumn("evidence", F.left(F.trim("evidence"), F.lit(200)))
        .withColumn("sentence_index", F.coalesce(F.col("sentence_index").try_cast("int"), F.lit(-1)))
        .withColumn("confidence", _clamp(conf, 0.0, 1.0))
        .withColumn("decoy", F.coalesce("decoy", F.lit(False)))
        .withColumn("importance", _clamp(F.coalesce(F.col("importance").try_cast("int"), F.lit(3)), 1, 5))
    )
    return out.filter(
        F.col("type").isin(K.EDGE_TYPES) & (F.col("source") != "") & (F.col("target") != "")
        & (F.col("evidence") != "") & (F.col("sentence_index") >= 0)
    )


def validated_spans(payloads: DataFrame) -> DataFrame:
    """Kept and dropped spans of a chunk payload; ``found`` is false for text the chunk lacks.

    All spans of a payload are looked up in its own row, so the chunk's text is normalised once and goes no further.
    """
    keep = [c for c in payloads.columns if c not in ("payload", "chunk_text")]
    parsed = payloads.select(*keep, norm_text("chunk_text").alias("_body"), F.from_json("payload", SPANS).alias("_p"))

    def looked_up(kind: str, label, reason) -> Column:
        def one(item: Column, pos: Column) -> Column:
            span = F.trim(item["text"])
            return F.struct(
                F.lit(kind).alias("kind"), pos.alias("pos"), span.alias("span"), label(item).cast("string").alias("time_label"),
                reason(item).cast("string").alias("reason"), F.contains("_body", norm_text(span)).alias("found"),
            )

        return F.coalesce(F.transform(F.col("_p")[kind], one), F.array())

    none = lambda item: F.lit(None)
    kept = looked_up("kept", lambda item: F.coalesce(item["time_label"], F.lit("unknown")), none)
    dropped = looked_up("dropped", none, lambda item: F.coalesce(item["reason"], F.lit("other")))
    rows = parsed.select(*keep, F.inline(F.concat(kept, dropped))).filter("span <> ''")
    return rows.withColumn("day", time_day("time_label")).withColumn("period", F.when(F.col("kind") == "kept", time_period("time_label")))


def attribute_map(value) -> Column:
    """Attributes as a map from any of: object, list of objects, pairs, or ``key: value`` strings."""
    v = F.trim(F.coalesce(as_col(value), F.lit("")))
    as_object = F.map_entries(F.from_json(v, "map<string,string>"))

    def entries(e: Column) -> Column:
        pair = F.from_json(e, "array<string>")
        key = F.trim(F.substring_index(e, ":", 1))
        val = F.trim(F.substring(e, F.locate(":", e) + 1, F.length(e)))
        entry = lambda k, x: F.struct(k.alias("key"), x.alias("value"))
        none = F.array().cast("array<struct<key:string,value:string>>")
        return (
            F.when(e.startswith("{"), F.map_entries(F.from_json(e, "map<string,string>")))
            .when(e.startswith("["), F.when(F.size(pair) == 2, F.array(entry(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))).otherwise(none))
            .when(e.contains(":") & (key != ""), F.array(entry(key, val)))
            .otherwise(none)
        )

    listed = F.flatten(F.transform(F.from_json(v, "array<string>"), entries))
    every = F.when(v.startswith("{"), as_object).when(v.startswith("["), listed)
    later = lambda e, i: F.exists(F.slice(every, i + 2, F.size(every)), lambda x: x["key"] == e["key"])
    last = F.filter(every, lambda e, i: ~later(e, i))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def normalized_option_payloads(payloads: DataFrame) -> DataFrame:
    """Option-evidence payloads with only valid ids (``valid_ids``), at most four per kind."""
    schema = (
        "selected_letter string, confidence string, needs_more boolean, followup_queries array<string>, "
        "evidence map<string,struct<support:array<string>,contradict:array<string>,decoy:array<string>>>"
    )
    p = payloads.withColumn("_p", F.from_json("payload", schema))
    letter = answer_letter("_p.selected_letter")
    conf = F.lower(F.coalesce("_p.confidence", F.lit("low")))
    none = F.array().cast("array<string>")

    def ids(name: str, kind: str) -> Column:
        got = F.try_element_at(F.col("_p.evidence"), F.lit(name))[kind]
        return F.slice(F.filter(F.coalesce(got, none), lambda x: F.array_contains("valid_ids", x)), 1, 4)

    table = F.create_map(
        *[x for name in K.LETTERS for x in (F.lit(name), F.struct(*[ids(name, kind).alias(kind) for kind in KINDS]))]
    )
    out = p.withColumn("letter", letter).withColumn("evidence", table)
    own = F.try_element_at(F.col("evidence"), F.coalesce("letter", F.lit("")))
    decisive = F.coalesce((F.size(own["support"]) > 0) | (F.size(own["contradict"]) > 0), F.lit(False))
    every = F.flatten(F.transform(F.map_values("evidence"), lambda r: F.flatten(F.array(*[r[k] for k in KINDS]))))
    queries = F.slice(F.filter(F.coalesce("_p.followup_queries", none), lambda q: F.trim(q) != ""), 1, 3)
    return (
        out.withColumn("decisive", decisive)
        .withColumn("confidence", F.when(F.col("decisive") & conf.isin("high", "medium", "low"), conf).otherwise("low"))
        .withColumn("evidence_ids", F.array_sort(F.array_distinct(every)))
        .withColumn("needs_more", F.coalesce("_p.needs_more", F.lit(False)) | ~F.col("decisive"))
        .withColumn("followup_queries", queries)
        .drop("_p", "payload")
    )


def repaired_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Map citations (id text, position or quote) to a chunk of the same document.

    Rules in order: a ``c_<n>`` id that exists; the last chunk containing the position;
    the first chunk with the whole quote (or inside it); the first with its 80-char prefix.
    Each rule is an equi-join.
    """
    cid = lambda c: F.concat(F.lit("c_"), c.cast("string"))
    named = citations.select(
        "doc_id", "cit", F.posexplode(F.transform(F.regexp_extract_all("quote", F.lit(r"(?i)\b(c_\d+)\b"), 1), F.lower)).alias("at", "ref")
    )
    ids = chunks.select("doc_id", "chunk_idx", cid(F.col("chunk_idx")).alias("ref"))
    by_id = named.join(ids, ["doc_id", "ref"]).select(
        "doc_id", "cit", "chunk_idx", F.lit(3).alias("rule"), F.col("at").alias("tie")
    )
    bins = chunks.select("doc_id", "chunk_idx", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 1500), F.floor((F.col("end") - 1) / 1500))).alias("bin"))
    by_pos = (
        citations.filter("pos is not null").withColumn("bin", F.floor(F.col("pos") / 1500)).join(bins, ["doc_id", "bin"])
        .filter("start <= pos and pos < end")
        .select("doc_id", "cit", "chunk_idx", F.lit(1).alias("rule"), (-F.col("chunk_idx")).alias("tie"))
    )
    quotes = citations.select("doc_id", "cit", squash_text("quote").alias("q")).filter(F.length("q") >= 18)
    bodies = chunks.select("doc_id", "chunk_idx", squash_text("text").alias("body")).join(
        citations.select("doc_id").distinct(), "doc_id", "left_semi"
    )
    heads = quotes.withColumn("head", F.left("q", F.lit(80)))
    in_body = contained_pairs(heads, bodies, ["doc_id"], "head", "body", sizes=(9,)).select(
        "doc_id", "cit", "chunk_idx", F.when(F.contains("body", "q"), 4).otherwise(5).alias("rule"), F.col("chunk_idx").alias("tie")
    )
    around = bodies.filter(F.length("body") >= 24)
    in_quote = contained_pairs(around, quotes, ["doc_id"], "body", "q", sizes=(9,)).select(
        "doc_id", "cit", "chunk_idx", F.lit(4).alias("rule"), F.col("chunk_idx").alias("tie")
    )
    hits = by_id.unionByName(by_pos).unionByName(in_body).unionByName(in_quote)
    best = first_per_key(hits, ["doc_id", "cit"], ["rule", "tie", "chunk_idx"])
    return citations.select("doc_id", "cit").join(best.drop("tie"), ["doc_id", "cit"], "left")


def budgeted_blocks(blocks: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """Leading blocks of each key whose summed length stays within the budget."""
    out = prefix_scan(
        blocks.withColumn("_b", F.floor(F.col(order) / 4096)), keys, ["_b"], [order], {"used": ("sum", F.length("block"))}
    )
    return out.filter(F.col("used") <= budget).drop("_b")


def budgeted_context(blocks: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """The blocks that fit, joined to one text per key; its size is bounded by the budget."""
    kept = budgeted_blocks(blocks, keys, order, budget)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("block").alias("b"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["b"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_blocks"))
