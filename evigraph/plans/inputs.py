"""Input relations derived from the given tables, stated once in SQL for Spark and for the check.

The given tables hold no graphs, questions or answers, so these relations derive
deterministic ones from them. Each grows with its source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..common import TABLES, scratch_path, table

#: Unit ids are text id * UNIT + place: no text has 2^31 places, and ids beyond 2^32 raise instead of colliding.
UNIT = 1 << 31

METHODS = [
    ("graph_a", 1, 54), ("graph_b", 2, 48), ("graph_c", 3, 50), ("graph_gate", 4, 52),
    ("graph_expand", 5, 58), ("tail", 6, 46), ("compress", 7, 51), ("vector", 8, 52),
    ("question_only", 9, 40),
]
TEMPLATES = [
    "Who killed the count?", "Which statement is not true?", "What is the real identity of the guest?",
    "Why was the letter hidden?", "How many keys were found?", "Where was the knife?",
    "When did the train leave?", "How did the thief enter?", "What was in the box?",
    "Who was the accomplice?",
]
ANSWER_FORMS = [
    "'Answer: ' || letter || '. a clue'", "'selected_letter: \"' || letter || '\" maybe'",
    "'The correct option is ' || letter", "'(' || letter || ') because of the key'",
    "'ANSWER: ' || num", "'no selection'", "'I first said answer A. Final answer: (' || letter || ')'",
    "'the killer surely is ' || letter", "'答案为 ' || letter", "'reasons follow\n' || letter || ').'",
    "'{\"selected_letter\": \"' || letter || '\"}'", "'ANSWER: 3 no wait ANSWER: 9'",
]


def _case(expr: str, values: list[str], quote: bool = True) -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + ("'" + v + "'" if quote else v) for i, v in enumerate(values)
    )
    return f"CASE {expr} {arms} END"


class Dialect:
    """The few spots where the two SQL dialects differ."""

    def __init__(self, spark: bool):
        self.spark = spark

    def h(self, expr: str) -> str:
        if self.spark:
            return f"cast(conv(substr(md5({expr}),1,8),16,10) as bigint)"
        return f"(('0x' || substr(md5({expr}),1,8))::BIGINT)"

    def div(self, a: str, b: str) -> str:
        return f"cast(({a}) div ({b}) as bigint)" if self.spark else f"cast(({a}) // ({b}) as bigint)"

    def lines(self) -> str:
        if self.spark:
            return (
                "SELECT doc_id, source, lang, cast(seq as bigint) seq, text FROM (SELECT doc_id, source, lang,"
                " posexplode(split(text, '\\n')) AS (seq, text) FROM documents)"
            )
        return (
            "SELECT doc_id, source, lang, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as bigint) seq,"
            " unnest(string_split(text, chr(10))) AS text FROM documents"
        )

    def methods(self) -> str:
        rows = ",".join(f"('{m}',{i},{s})" for m, i, s in METHODS)
        if self.spark:
            rows = ",".join(f"struct('{m}',{i},{s})" for m, i, s in METHODS)
            return f"LATERAL VIEW inline(array({rows})) m AS method, morder, skill"
        return f", (VALUES {rows}) m(method, morder, skill)"


def _relations(d: Dialect) -> dict[str, str]:
    h, div = d.h, d.div
    quarter = lambda i: (
        f"trim(substr(text, 1 + {div(f'{i} * length(text)', '4')}, {div('length(text)', '4')}))"
    )
    chars = "substr('ABCD', cast({} as int), 1)".format
    return {
        "lines": d.lines(),
        # story spans: one per non-blank document line, with a time label
        "spans": f"""
            SELECT doc_id, seq AS chunk_idx, cast(0 as bigint) AS span_idx, text,
              CASE WHEN {h("'lab' || doc_id || ':' || seq")} % 3 = 0
                THEN 'Day ' || (1 + {h("'day' || doc_id || ':' || seq")} % 4) || ', ' ||
                  {_case(h("'per' || doc_id || ':' || seq") + ' % 6', ['morning', 'noon', 'afternoon', 'evening', 'night', 'later'])}
                ELSE 'unknown' END AS time_label
            FROM lines WHERE trim(text) <> ''""",
        "questions": f"""
            SELECT doc_id AS qid, source AS novel, {_case('doc_id % 10', TEMPLATES)} || ' ' || text AS question
            FROM documents""",
        "answer_texts": f"""
            SELECT qid, {_case('form', ANSWER_FORMS, quote=False)} AS answer FROM (
              SELECT doc_id AS qid, {h("'form' || doc_id")} % {len(ANSWER_FORMS)} AS form,
                {chars(f"1 + {h(chr(39) + 'let' + chr(39) + ' || doc_id')} % 4")} AS letter,
                1 + {h("'num' || doc_id")} % 6 AS num FROM documents) f""",
        # one row per (question, method)
        "answers": f"""
            SELECT cohort, novel, qid, qtype, method, morder, unanimous, confidence, elapsed, gold, selected,
              CASE WHEN selected = gold THEN 1 ELSE 0 END AS correct
            FROM (
              SELECT cohort, novel, qid, qtype, method, cast(morder as bigint) AS morder, unanimous, gold,
                {h("'el' || qid || method")} % 9000 AS elapsed,
                {_case(h("'cf' || qid || method") + ' % 3', ['low', 'medium', 'high'])} AS confidence,
                CASE WHEN {h("'nul' || qid || method")} % 40 = 0 THEN NULL
                  WHEN {h("'hit' || qid || method")} % 100 < skill THEN gold
                  ELSE {chars(f"1 + {h(chr(39) + 'alt' + chr(39) + ' || qid || method')} % 4")} END AS selected
              FROM (
                SELECT CASE WHEN d.lang = 'en' THEN 'old' ELSE 'new' END AS cohort, d.source AS novel,
                  l.doc_id AS qid,
                  {_case(h("'qt' || l.doc_id") + ' % 4', ['killer', 'identity', 'location', 'clue_fact'])} AS qtype,
                  {h("'un' || l.doc_id")} % 3 > 0 AS unanimous,
                  {chars(f"1 + ({h(chr(39) + 'gold' + chr(39) + ' || l.doc_id')} + l.quality * 2 + l.toxic) % 4")} AS gold
                FROM labels l JOIN documents d ON l.doc_id = d.doc_id
              ) q {d.methods()}
            ) x""",
        # one graph per customer nation
        "edges": f"""
            SELECT graph_id, src, dst, type, evidence, confidence, decoy, importance,
              'e' || substr(md5(src || '>' || dst || ':' || okey || ':' || line), 1, 16) AS edge_id
            FROM (
              SELECT DISTINCT graph_id, src, dst, type, evidence, confidence, decoy, importance, okey, line FROM (
                SELECT c.c_nationkey AS graph_id, 'c' || c.c_custkey AS src, 'p' || l.l_partkey AS dst,
                  {_case('l.l_linenumber % 7', ['mentions', 'supports', 'motive', 'contradicts', 'related_to', 'means', 'opportunity'])} AS type,
                  p.p_name AS evidence, round(1 - l.l_discount, 2) AS confidence, l.l_returnflag = 'R' AS decoy,
                  cast(1 + l.l_linenumber % 5 as bigint) AS importance, l.l_orderkey AS okey, l.l_linenumber AS line
                FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
                UNION ALL
                SELECT c.c_nationkey, 'p' || l.l_partkey, 's' || l.l_suppkey, 'belongs_to', p.p_name,
                  round(1 - l.l_tax, 2), l.l_linestatus = 'F', cast(1 + l.l_linenumber % 3 as bigint), l.l_orderkey, l.l_linenumber
                FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
              ) u ) e""",
        "nodes": f"""
            SELECT graph_id, node_id, name, type, alias, description,
              1 + {h("'sal' || node_id")} % 5 AS salience, {h("'pos' || graph_id || node_id")} % 1000 / 1000.0e0 AS text_pos,
              {h("'men' || graph_id || node_id")} % 4 AS mention_count
            FROM (
              SELECT c_nationkey AS graph_id, 'c' || c_custkey AS node_id, c_name AS name, 'person' AS type,
                lower(c_mktsegment) || ' buyer ' || c_custkey AS alias, 'buyer in ' || lower(c_mktsegment) AS description FROM customer
              UNION ALL
              SELECT k.graph_id, k.node_id, p.p_name || ' ' || p.p_partkey, 'clue_object', p.p_brand, lower(p.p_type) || ' ' || p.p_name
                FROM (SELECT DISTINCT graph_id, dst AS node_id FROM edges WHERE type <> 'belongs_to') k
                JOIN part p ON k.node_id = 'p' || p.p_partkey
              UNION ALL
              SELECT k.graph_id, k.node_id, s.s_name, 'event', 'vendor ' || s.s_suppkey, 'supplier from nation ' || s.s_nationkey
                FROM (SELECT DISTINCT graph_id, dst AS node_id FROM edges WHERE type = 'belongs_to') k
                JOIN supplier s ON k.node_id = 's' || s.s_suppkey
            ) n""",
        # every part asks in one graph; the last parts have no later ones to choose from and choose themselves
        "graph_questions": """
            SELECT a.p_partkey % 25 AS graph_id, a.p_partkey * 25 + a.p_partkey % 25 AS qid, 'Who moved the ' || a.p_name || ' for ' || a.p_brand AS question,
              coalesce(b.p_name || ' ' || b.p_partkey, a.p_name || ' ' || a.p_partkey) AS choice_a, coalesce(c.p_name, a.p_name) AS choice_b
            FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 3 LEFT JOIN part c ON c.p_partkey = a.p_partkey + 5""",
        # benchmark items as questions over the chunks of one source
        "items": f"""
            SELECT item_id AS qid, 'src' || (item_id % 20) AS scope, text AS question,
              {quarter(0)} AS choice_a, {quarter(1)} AS choice_b, {quarter(2)} AS choice_c, {quarter(3)} AS choice_d
            FROM benchmark""",
    }


NEEDS = {"spans": ["lines"], "nodes": ["edges"]}
SPARK_SQL, CHECK_SQL = _relations(Dialect(True)), _relations(Dialect(False))

# The same rows for Spark with fewer moves: lines meet their part, orders their customer, then both meet once by order, where
# equal rows are dropped in place; a line makes its two edges only there.
_KIND = _case("l_linenumber % 7", ["mentions", "supports", "motive", "contradicts", "related_to", "means", "opportunity"])
_EDGE = "src, {} AS dst, {} AS type, p_name AS evidence, round(1 - {}, 2) AS confidence, {} AS decoy, cast(1 + l_linenumber % {} as bigint) AS importance"
SPARK_SQL["edges"] = f"""
    SELECT graph_id, src, dst, type, evidence, confidence, decoy, importance,
      'e' || substr(md5(src || '>' || dst || ':' || okey || ':' || line), 1, 16) AS edge_id
    FROM (
      SELECT DISTINCT graph_id, src, dst, type, evidence, confidence, decoy, importance, okey, line FROM (
        SELECT c_nationkey AS graph_id, l_orderkey AS okey, l_linenumber AS line, inline(array(
          struct('c' || c_custkey AS {_EDGE.format("'p' || l_partkey", _KIND, "l_discount", "l_returnflag = 'R'", 5)}),
          struct('p' || l_partkey AS {_EDGE.format("'s' || l_suppkey", "'belongs_to'", "l_tax", "l_linestatus = 'F'", 3)})))
        FROM (SELECT l.*, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) x
          JOIN (SELECT o.o_orderkey, c.c_custkey, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) y
          ON x.l_orderkey = y.o_orderkey
      ) u ) e"""

# chunks and tokens exist only on the checking side; Spark builds them with its operators
CHECK_SQL["chunks"] = """
    SELECT doc_id, source AS scope, cast(i as bigint) AS chunk_idx, cast(i * 1400 as bigint) AS start,
      cast(least(i * 1400 + 1500, length(text)) as bigint) AS "end", substr(text, cast(i * 1400 + 1 as bigint), 1500) AS text,
      doc_id * 2147483648 + i AS unit
    FROM (SELECT doc_id, source, text, unnest(range(cast(CASE WHEN length(text) = 0 THEN 0
      WHEN length(text) <= 1500 THEN 1 ELSE ceil((length(text) - 1500) / 1400.0) + 1 END as bigint))) AS i FROM documents) c"""
CHECK_SQL["chunk_terms"] = """
    SELECT scope, unit, term, count(*) AS tf FROM (SELECT scope, unit,
      unnest(regexp_extract_all(lower(text), '[a-z0-9一-鿿]+')) AS term FROM chunks) t GROUP BY ALL"""
CHECK_SQL["chunk_len"] = """
    SELECT scope, unit, len(regexp_extract_all(lower(text), '[a-z0-9一-鿿]+')) AS dl FROM chunks"""
CHECK_SQL["chunk_stats"] = "SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM chunk_len GROUP BY scope"
CHECK_SQL["chunk_df"] = "SELECT scope, term, count(*) AS df FROM chunk_terms GROUP BY scope, term"
CHECK_SQL["item_queries"] = """
    SELECT qid, scope, 'Q' AS label, question AS query FROM items
    UNION ALL SELECT qid, scope, 'A', question || ' ' || choice_a FROM items
    UNION ALL SELECT qid, scope, 'B', question || ' ' || choice_b FROM items
    UNION ALL SELECT qid, scope, 'C', question || ' ' || choice_c FROM items
    UNION ALL SELECT qid, scope, 'D', question || ' ' || choice_d FROM items"""
CHECK_SQL["item_terms"] = """
    SELECT DISTINCT qid, scope, label, unnest(regexp_extract_all(lower(query), '[a-z0-9一-鿿]+')) AS term FROM item_queries"""
CHECK_SQL["item_scores"] = """
    SELECT q.qid, q.scope, q.label, t.unit,
      sum(ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1.0) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.dl / s.avgdl))) AS score
    FROM item_terms q JOIN chunk_terms t USING (scope, term) JOIN chunk_df d USING (scope, term)
      JOIN chunk_stats s USING (scope) JOIN chunk_len l USING (scope, unit)
    GROUP BY q.qid, q.scope, q.label, t.unit"""
NEEDS |= {
    "chunk_terms": ["chunks"], "chunk_len": ["chunks"], "chunk_stats": ["chunk_len"],
    "chunk_df": ["chunk_terms"], "item_queries": ["items"], "item_terms": ["item_queries"],
    "item_scores": ["item_terms", "chunk_terms", "chunk_df", "chunk_stats", "chunk_len"],
}


def _closure(names: list[str], out: list[str] | None = None) -> list[str]:
    out = [] if out is None else out
    for name in names:
        _closure(NEEDS.get(name, []), out)
        if name not in out:
            out.append(name)
    return out


STORED = ("edges", "nodes")
_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived graph table, written once per application to the shared folder and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        _derive(spark, sf_dir, name).write.option("compression", "zstd").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a DataFrame."""
    return stored(spark, sf_dir, name) if name in STORED else _derive(spark, sf_dir, name)


def _derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = [n for n in _closure([name]) if n == name or n not in STORED]
    ctes = ", ".join(f"{n} AS ({SPARK_SQL[n]})" for n in parts)
    words = set(re.findall(r"\w+", ctes))
    for base in TABLES:
        if base in words:
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    for base in STORED:
        if base in words and base != name:
            stored(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")


def check(names: str, body: str) -> str:
    """Expected-result SQL over derived inputs."""
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CHECK_SQL[n]})" for n in _closure(names.split()))
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"
