"""Registered queries: question typing, answer parsing and payload validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions import answers as A, constants as K, text as T
from ..operators import payload as P, segment as S
from .inputs import Dialect, check, relation
from .registry import query
from .text_queries import NORM, doc_text, docs

LETTERS = "('A'),('B'),('C'),('D')"
DUCK = Dialect(False)


def words_sql(words, col="question"):
    """Whole-word match with Unicode boundaries in the checking dialect."""
    body = "|".join(words).replace("'", "''")
    return f"regexp_matches({col}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({body})($|[^\\p{{L}}\\p{{N}}_])')"


def rules_sql(rules, default):
    return "CASE " + " ".join(f"WHEN {words_sql(w)} THEN '{n}'" for n, w in rules) + f" ELSE '{default}' END"


@query("question_type", check("questions", f"SELECT qid, {rules_sql(K.QUESTION_RULES, 'clue_fact')} AS qtype FROM questions"))
def question_type(spark, sf):
    return relation(spark, sf, "questions").select("qid", A.question_type("question").alias("qtype"))


@query("question_type5", check("questions", f"SELECT qid, {rules_sql(K.QUESTION_RULES_SHORT, 'fact')} AS qtype FROM questions"))
def question_type5(spark, sf):
    return relation(spark, sf, "questions").select("qid", A.question_type5("question").alias("qtype"))


@query(
    "question_flags",
    check("questions", f"SELECT qid, {words_sql(K.NEGATIVE_WORDS)} AS negative, {words_sql(K.WHO_WORDS)} AS who FROM questions"),
)
def question_flags(spark, sf):
    return relation(spark, sf, "questions").select("qid", A.is_negative("question").alias("negative"), A.is_who("question").alias("who"))


@query(
    "question_role",
    check("questions", r"""SELECT qid, CASE WHEN v <> '' THEN 'the killer of ' || v
      WHEN contains(lower(question), 'accomplice') THEN 'the accomplice of the killer' ELSE 'the correct answer' END AS role
    FROM (SELECT qid, question, trim(regexp_extract(question, 'killed\s+(.+?)[?？]', 1)) AS v FROM questions) t"""),
)
def question_role(spark, sf):
    return relation(spark, sf, "questions").select("qid", A.question_role("question").alias("role"))


def patterns_sql(patterns, last=True, col="answer"):
    arms = []
    for p in patterns:
        arms.append(f"list_extract(regexp_extract_all(trim({col}), '{p.replace(chr(39), chr(39) * 2)}', 1), {-1 if last else 1})")
    return "upper(coalesce(" + ", ".join(arms) + "))"


@query("answer_letter", check("answer_texts", f"SELECT qid, answer, {patterns_sql(K.LETTER_LAST)} AS letter FROM answer_texts"))
def answer_letter(spark, sf):
    return relation(spark, sf, "answer_texts").select("qid", "answer", A.answer_letter("answer").alias("letter"))


FIELD = "upper(trim(CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.selected_letter') END))"


@query(
    "answer_letter_variants",
    check("answer_texts", f"""SELECT qid, {patterns_sql(K.LETTER_MARKED, last=False)} AS marked,
      coalesce({patterns_sql(K.LETTER_LAST)}, {patterns_sql(K.LETTER_PROSE)}) AS prose,
      coalesce(CASE WHEN {FIELD} IN ('A','B','C','D') THEN {FIELD} END, {patterns_sql(K.LETTER_BILINGUAL, last=False)}) AS bilingual
    FROM answer_texts"""),
)
def answer_letter_variants(spark, sf):
    return relation(spark, sf, "answer_texts").select(
        "qid", A.answer_letter_marked("answer").alias("marked"), A.answer_letter_prose("answer").alias("prose"),
        A.answer_letter_bilingual("answer").alias("bilingual"),
    )


@query(
    "answer_number",
    check("answer_texts", f"""SELECT qid, CASE WHEN num IS NOT NULL THEN CASE WHEN TRY_CAST(num AS INT) BETWEEN 1 AND 4 THEN TRY_CAST(num AS INT) - 1 END
      WHEN let IS NOT NULL AND ascii(let) - 65 < 4 THEN ascii(let) - 65 END AS choice FROM (
      SELECT qid, list_extract(regexp_extract_all(answer, '{K.ANSWER_NUMBER}', 1), -1) AS num,
        list_extract(regexp_extract_all(trim(answer), '{K.ANSWER_TAIL_LETTER}', 1), 1) AS let FROM answer_texts) t"""),
)
def answer_number(spark, sf):
    return relation(spark, sf, "answer_texts").select("qid", A.answer_number("answer", 4).alias("choice"))


PAIR_SQL = f"""SELECT doc_id AS qid, {DUCK.h("'ev' || doc_id")} % 4 AS ev, {DUCK.h("'te' || doc_id")} % 4 AS te, quality AS g1, toxic AS g2 FROM labels"""


@query(
    "judge_pair",
    f"""SELECT qid, (ev = g1 AND te = g2) OR (ev = 2 AND te = 3) AS pair_hit, ev = g1 OR ev = 2 AS evidence_hit,
      te = g2 OR te = 3 AS testimony_hit FROM ({PAIR_SQL}) p""",
)
def judge_pair(spark, sf):
    """Answers alternate between clean JSON and JSON quoted inside prose."""
    lab = table(spark, sf, "labels")
    ev = T.hash_mod(F.concat(F.lit("ev"), "doc_id"), 4).cast("string")
    te = T.hash_mod(F.concat(F.lit("te"), "doc_id"), 4).cast("string")
    body = F.concat(F.lit('{"evidence": '), ev, F.lit(',\n "testimony": '), te, F.lit("}"))
    answer = F.when(F.col("quality") == 1, F.concat(F.lit("I think "), body, F.lit(" is it"))).otherwise(body)
    gold = F.array(F.array("quality", "toxic"), F.array(F.lit(2), F.lit(3)))
    rows = lab.select(F.col("doc_id").alias("qid"), answer.alias("answer"), gold.alias("gold"))
    hits = A.judge_pair("answer", "gold")
    return rows.select("qid", *[c.alias(n) for n, c in hits.items()])


# -- payloads: JSON built from document lines, expected rows from the lines -----------
def picked(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def pick_sql(values, index):
    return "CASE " + index + f" % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def entity_payloads(spark, sf):
    def item(x, i):
        mention = F.struct(F.substring(x, 1, 30).alias("text"), (i - 1).alias("sentence_index"))
        return F.struct(
            F.substring(x, 1, 12).alias("name"), picked([*K.NODE_TYPES, "alien"], i).alias("type"),
            F.array(F.substring(x, 13, 8), F.lit(" "), F.lit("same")).alias("aliases"), x.alias("description"),
            (F.length(x) % 9 - 1).alias("salience"), F.array(mention).alias("mentions"),
        )

    items = F.transform(F.split("text", "\n"), item)
    return docs(spark, sf).select("doc_id", F.to_json(F.struct(items.alias("entities"))).alias("payload"))


@query(
    "entities_validated",
    check("lines", f"""SELECT doc_id, seq AS pos, trim(substr(text, 1, 12)) AS name, {pick_sql([*K.NODE_TYPES, 'alien'], 'seq')} AS type,
      CASE WHEN trim(substr(text, 13, 8)) = '' THEN 'same' ELSE trim(substr(text, 13, 8)) || '|same' END AS aliases,
      CASE WHEN seq >= 1 AND trim(substr(text, 1, 30)) <> '' THEN (seq - 1) || ':' || trim(substr(text, 1, 30)) ELSE '' END AS mentions,
      left(text, 120) AS description, greatest(1, least(5, length(text) % 9 - 1)) AS salience
    FROM lines WHERE seq < 40 AND trim(substr(text, 1, 12)) <> '' AND seq % 7 <> 6"""),
)
def entities_validated(spark, sf):
    rows = P.validated_entities(entity_payloads(spark, sf), cap=40)
    shown = F.transform("mentions", lambda m: F.concat(m["sentence_index"].cast("string"), F.lit(":"), m["text"]))
    return rows.select(
        "doc_id", "pos", "name", "type", F.array_join("aliases", "|").alias("aliases"),
        F.array_join(shown, "|").alias("mentions"), "description", "salience",
    )


def relation_payloads(spark, sf):
    def item(x, i):
        return F.struct(
            F.substring(x, 1, 10).alias("source"), F.substring(x, 11, 10).alias("target"),
            picked([*K.EDGE_TYPES, "knows", ""], i).alias("type"), x.alias("evidence"), (i - 2).alias("sentence_index"),
            F.when(i % 5 != 0, (F.length(x) % 15) / 10).alias("confidence"), (i % 3 == 0).alias("decoy"),
            (F.length(x) % 8).alias("importance"),
        )

    items = F.transform(F.split("text", "\n"), item)
    return docs(spark, sf).select("doc_id", F.to_json(F.struct(items.alias("relations"))).alias("payload"))


@query(
    "relations_validated",
    check("lines", f"""SELECT doc_id, seq AS pos, trim(substr(text, 1, 10)) AS source, trim(substr(text, 11, 10)) AS target,
      {pick_sql([*K.EDGE_TYPES, 'knows', ''], 'seq')} AS type, left(trim(text), 200) AS evidence, seq - 2 AS sentence_index,
      CASE WHEN seq % 5 = 0 THEN 0.9e0 ELSE least(1.0e0, (length(text) % 15) / 10.0e0) END AS confidence, seq % 3 = 0 AS decoy,
      greatest(1, least(5, length(text) % 8)) AS importance
    FROM lines WHERE seq < 60 AND seq >= 2 AND trim(substr(text, 1, 10)) <> '' AND trim(substr(text, 11, 10)) <> '' AND seq % 14 < 12"""),
)
def relations_validated(spark, sf):
    return P.validated_relations(relation_payloads(spark, sf), cap=60)


def span_payloads(spark, sf):
    """Every third line is dropped; every fifth span is text the document lacks."""
    parts = F.split("text", "\n")
    text = lambda x, i: F.when(i % 5 == 4, F.concat(x, F.lit(" zzqq"))).otherwise(F.replace(x, F.lit(" "), F.lit("\n  ")))
    label = lambda i: F.when(i % 2 == 0, F.concat(F.lit("Day "), i.cast("string"), F.lit(", night")))
    items = F.transform(parts, lambda x, i: F.struct(i.alias("i"), text(x, i).alias("text"), label(i).alias("time_label"), picked(K.DROP_REASONS, i).alias("reason")))
    kept = F.transform(F.filter(items, lambda s: s["i"] % 3 != 0), lambda s: F.struct(s["text"], s["time_label"]))
    lost = F.transform(F.filter(items, lambda s: s["i"] % 3 == 0), lambda s: F.struct(s["text"], s["reason"]))
    body = F.to_json(F.struct(kept.alias("kept"), lost.alias("dropped")))
    return docs(spark, sf).select("doc_id", F.col("text").alias("chunk_text"), body.alias("payload"))


@query(
    "spans_validated",
    check("lines", f"""SELECT doc_id, CASE WHEN seq % 3 = 0 THEN 'dropped' ELSE 'kept' END AS kind,
      CASE WHEN seq % 3 = 0 THEN seq // 3 ELSE seq - 1 - seq // 3 END AS pos,
      trim(CASE WHEN seq % 5 = 4 THEN text || ' zzqq' ELSE replace(text, ' ', chr(10) || '  ') END) AS span, seq % 5 <> 4 AS found,
      CASE WHEN seq % 3 <> 0 AND seq % 2 = 0 THEN seq END AS day,
      CASE WHEN seq % 3 <> 0 THEN CASE WHEN seq % 2 = 0 THEN 'night' ELSE 'unknown' END END AS period,
      CASE WHEN seq % 3 = 0 THEN {pick_sql(K.DROP_REASONS, 'seq')} END AS reason
    FROM lines WHERE trim(text) <> ''"""),
)
def spans_validated(spark, sf):
    return P.validated_spans(span_payloads(spark, sf)).select("doc_id", "kind", "pos", "span", "found", "day", "period", "reason")


@query(
    "attr_normalize",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'k=' || json_extract_string(props, '$.k')
      WHEN 1 THEN 'a=' || event_type || '|k=' || json_extract_string(props, '$.k')
      WHEN 2 THEN 'who=' || user_id WHEN 3 THEN 'day=' || event_id || ': late|' || 'type=' || event_type ELSE '' END AS attrs
    FROM events""",
)
def attr_normalize(spark, sf):
    ev = table(spark, sf, "events")
    s = lambda c: F.col(c).cast("string")
    quoted = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    shapes = [
        F.col("props"),
        quoted('[{"k": 0}, {"a": "', s("event_type"), '"}, ', F.col("props"), "]"),
        quoted('[["who", "nobody"], ["who", "', s("user_id"), '"], ["odd"]]'),
        quoted('["type: ', s("event_type"), '", "no colon", "day: ', s("event_id"), ': late", ": none"]'),
        quoted("broken ", F.col("props")),
    ]
    raw = F.get(F.array(*shapes), (F.col("event_id") % 5).cast("int"))
    entries = F.array_sort(F.map_entries(P.attribute_map(raw)))
    shown = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return ev.select("event_id", shown.alias("attrs"))


@query(
    "payload_normalize",
    f"""SELECT doc_id AS qid, letter, CASE WHEN decisive AND conf <> 'sure' THEN conf ELSE 'low' END AS confidence, decisive,
      NOT decisive AS needs_more, CASE WHEN quality = 1 THEN 'c_1,c_2' || CASE WHEN toxic = 1 THEN ',c_3' ELSE '' END
        ELSE CASE WHEN toxic = 1 THEN 'c_3' ELSE '' END END AS evidence_ids, 1 AS n_queries FROM (
      SELECT *, coalesce(letter = 'A' AND quality = 1 OR letter = 'B' AND toxic = 1, false) AS decisive FROM (
        SELECT doc_id, quality, toxic, CASE {DUCK.h("'l' || doc_id")} % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS letter,
          CASE {DUCK.h("'c' || doc_id")} % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'sure' END AS conf FROM labels) a) b""",
)
def payload_normalize(spark, sf):
    lab = table(spark, sf, "labels")
    letter = picked(["Answer: A", "Answer: B", "none of them"], T.hash_mod(F.concat(F.lit("l"), "doc_id"), 3))
    conf = picked(["HIGH", "Medium", "sure"], T.hash_mod(F.concat(F.lit("c"), "doc_id"), 3))
    ids = lambda flag, *xs: F.when(F.col(flag) == 1, F.array(*map(F.lit, xs))).otherwise(F.array(F.lit("c_99")))
    none = F.array().cast("array<string>")
    row = lambda s, c: F.struct(s.alias("support"), c.alias("contradict"), none.alias("decoy"))
    evidence = F.create_map(F.lit("A"), row(ids("quality", "c_2", "c_77", "c_1"), none), F.lit("B"), row(none, ids("toxic", "c_3")))
    body = F.to_json(F.struct(letter.alias("selected_letter"), conf.alias("confidence"), evidence.alias("evidence"),
                              F.lit(False).alias("needs_more"), F.array(F.lit(" "), F.lit("more")).alias("followup_queries")))
    payloads = lab.select(F.col("doc_id").alias("qid"), body.alias("payload"), F.array(*[F.lit(f"c_{i}") for i in range(9)]).alias("valid_ids"))
    out = P.normalized_option_payloads(payloads)
    return out.select("qid", "letter", "confidence", "decisive", "needs_more", F.array_join("evidence_ids", ",").alias("evidence_ids"),
                      F.size("followup_queries").alias("n_queries"))


CIT_SQL = """cits AS (
  SELECT doc_id, 0 AS cit, 'see [C_' || (doc_id % 3) || '] and c_0' AS quote, NULL::BIGINT AS pos FROM documents
  UNION ALL SELECT doc_id, 1, '', length(text) // 2 FROM documents
  UNION ALL SELECT doc_id, 2, replace(substr(text, 1 + length(text) // 3, 60), ' ', '--'), NULL FROM documents
  UNION ALL SELECT doc_id, 3, substr(text, 1 + length(text) // 4, 90) || ' and then they said so', NULL FROM documents),
pairs AS (SELECT c.doc_id, c.cit, k.chunk_idx, CASE
    WHEN regexp_matches(lower(c.quote), '(^|[^a-z0-9_])c_' || k.chunk_idx || '($|[^a-z0-9_])') THEN 3
    WHEN c.pos >= k.start AND c.pos < k."end" THEN 1
    WHEN length(q) < 18 THEN NULL WHEN contains(body, q) OR (length(body) >= 24 AND contains(q, body)) THEN 4
    WHEN contains(body, left(q, 80)) THEN 5 END AS rule,
    CASE WHEN regexp_matches(lower(c.quote), '(^|[^a-z0-9_])c_' || k.chunk_idx || '($|[^a-z0-9_])') THEN instr(lower(c.quote), 'c_' || k.chunk_idx)
      WHEN c.pos >= k.start AND c.pos < k."end" THEN -k.chunk_idx ELSE k.chunk_idx END AS tie
  FROM (SELECT *, lower(regexp_replace(quote, '[^\\p{L}\\p{N}_]+', '', 'g')) AS q FROM cits) c
  JOIN (SELECT *, lower(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')) AS body FROM chunks) k ON c.doc_id = k.doc_id),
best AS (SELECT doc_id, cit, chunk_idx, rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cit ORDER BY rule, tie, chunk_idx) AS rn
  FROM pairs WHERE rule IS NOT NULL) r WHERE rn = 1)
SELECT c.doc_id, c.cit, b.chunk_idx, b.rule FROM cits c LEFT JOIN best b USING (doc_id, cit)"""


@query("citation_repair", check("chunks", f"WITH {CIT_SQL}"))
def citation_repair(spark, sf):
    d = doc_text(spark, sf)
    n = F.length("text")
    none = F.lit(None).cast("long")
    cites = [
        (F.concat(F.lit("see [C_"), (F.col("doc_id") % 3).cast("string"), F.lit("] and c_0")), none),
        (F.lit(""), F.floor(n / 2)),
        (F.replace(F.substring("text", 1 + F.floor(n / 3).cast("int"), F.lit(60)), F.lit(" "), F.lit("--")), none),
        (F.concat(F.substring("text", 1 + F.floor(n / 4).cast("int"), F.lit(90)), F.lit(" and then they said so")), none),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("cit"), q.alias("quote"), p.alias("pos")) for i, (q, p) in enumerate(cites)])
    citations = d.select("doc_id", F.inline(rows))
    return P.repaired_citations(citations, S.chunk_fixed(d))


@query(
    "quote_grounded",
    f"""SELECT doc_id, length({NORM("replace(substr(text, 4, 40), ' ', '   ')")}) >= 18 AS long_enough_hit,
      length({NORM("replace(substr(text, 4, 22), ' ', '   ')")}) >= 24 AS short_hit, false AS altered_hit FROM documents""",
)
def quote_grounded(spark, sf):
    quote = lambda n: F.concat(F.lit(' "'), F.replace(F.substring("text", 4, n), F.lit(" "), F.lit("   ")), F.lit('"'))
    return docs(spark, sf).select(
        "doc_id", A.quote_grounded(quote(40), "text").alias("long_enough_hit"), A.quote_grounded(quote(22), "text", 24).alias("short_hit"),
        A.quote_grounded(F.concat(F.substring("text", 1, 40), F.lit(" zzqq")), "text").alias("altered_hit"),
    )


VERDICTS = ["Supported by text", "clearly FALSE", "not sure", "refuted", "entailed", "incorrect", "correct"]


@query(
    "verdict_status",
    f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'supported' WHEN 2 THEN 'unknown' WHEN 4 THEN 'supported' WHEN 6 THEN 'supported' ELSE 'contradicted' END AS verdict,
      CASE WHEN value > 20 AND user_id % 2 = 0 THEN 'mixed' WHEN value > 20 THEN 'supported' WHEN user_id % 2 = 0 THEN 'contradicted' ELSE 'unknown' END AS status
    FROM events""",
)
def verdict_status(spark, sf):
    said = picked(VERDICTS, F.col("event_id"))
    return table(spark, sf, "events").select(
        "event_id", A.verdict(said).alias("verdict"), A.evidence_status(F.col("value") > 20, F.col("user_id") % 2 == 0).alias("status")
    )


NAMES = ["She", "the doctor", " THEY ", "the old doctor", "Doctor Grey"]


@query(
    "generic_entity",
    f"""SELECT c_custkey, {pick_sql(NAMES, 'c_custkey')} || CASE WHEN c_nationkey % 5 = 0 THEN ' Jr' ELSE '' END AS name,
      c_custkey % 5 < 3 AND c_nationkey % 5 <> 0 AS generic FROM customer""",
)
def generic_entity(spark, sf):
    name = F.concat(picked(NAMES, F.col("c_custkey")), F.when(F.col("c_nationkey") % 5 == 0, " Jr").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", name.alias("name"), A.is_generic_name(name).alias("generic"))


@query(
    "clean_link",
    check("lines", f"""SELECT doc_id, seq, ok AND length({NORM('left(text, 60)')}) >= 18 AND seq % 6 <> 5 AS clean FROM (
      SELECT doc_id, seq, text, CASE seq % 6 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS ok FROM lines) t"""),
)
def clean_link(spark, sf):
    """Link shapes by line number: fine, option entity, self link, weak relation, fine, evidence missing."""
    d = doc_text(spark, sf)
    rows = d.select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    case = F.col("seq") % 6
    source = F.when(case == 1, "Option B").otherwise("Mary Grey")
    target = F.when(case == 2, "mary  grey").otherwise("John")
    rel = F.when(case == 3, "mentions").otherwise("motive")
    evidence = F.when(case == 5, F.concat(F.lit("zz"), "line")).otherwise(F.left("line", F.lit(60)))
    return rows.select("doc_id", "seq", A.clean_link(source, target, rel, evidence, F.col("line")).alias("clean"))


SWAPS = """p0 AS (SELECT *, 0 AS a0, 1 AS b0, 2 AS c0, 3 AS d0 FROM base),
p1 AS (SELECT *, CASE j3 WHEN 0 THEN d0 ELSE a0 END AS a1, CASE j3 WHEN 1 THEN d0 ELSE b0 END AS b1, CASE j3 WHEN 2 THEN d0 ELSE c0 END AS c1,
  CASE j3 WHEN 0 THEN a0 WHEN 1 THEN b0 WHEN 2 THEN c0 ELSE d0 END AS d1 FROM p0),
p2 AS (SELECT *, CASE j2 WHEN 0 THEN c1 ELSE a1 END AS a2, CASE j2 WHEN 1 THEN c1 ELSE b1 END AS b2,
  CASE j2 WHEN 0 THEN a1 WHEN 1 THEN b1 ELSE c1 END AS c2 FROM p1),
p3 AS (SELECT *, CASE j1 WHEN 0 THEN b2 ELSE a2 END AS a3, CASE j1 WHEN 0 THEN a2 ELSE b2 END AS b3 FROM p2)"""
BYTES = ", ".join("('0x' || substr(dig, {}, 2))::INT % {} AS j{}".format(1 + 2 * i, i + 1, i) for i in (3, 2, 1))
PERM_BASE = f"""base AS (SELECT *, {BYTES} FROM (SELECT doc_id AS qid, substr('ABCD', cast(1 + doc_id % 4 AS INT), 1) AS letter, {{}} AS dig FROM documents) s)"""


def shuffled(spark, sf):
    letter = F.substring(F.lit(K.LETTERS), 1, 4).substr((F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    return docs(spark, sf).select(F.col("doc_id").alias("qid"), letter.alias("letter"), F.col("doc_id").cast("string").alias("key"), "source", "lang")


@query(
    "permutation",
    f"""WITH {PERM_BASE.format("sha256(doc_id::VARCHAR)")}, {SWAPS}, s1 AS (SELECT qid, a3 || ',' || b3 || ',' || c2 || ',' || d1 AS plain FROM p3),
    n1 AS (SELECT qid, a3 || ',' || b3 || ',' || c2 || ',' || d1 AS moved FROM (
      WITH {PERM_BASE.format("sha1(doc_id::VARCHAR || source)")}, {SWAPS} SELECT * FROM p3) z)
    SELECT qid, plain, CASE WHEN moved = '0,1,2,3' THEN '1,2,3,0' ELSE moved END AS moved FROM s1 JOIN n1 USING (qid)""",
)
def permutation(spark, sf):
    shown = lambda order: F.array_join(F.transform(order, lambda i: i.cast("string")), ",")
    return shuffled(spark, sf).select(
        "qid", shown(A.permutation4(F.sha2("key", 256))).alias("plain"),
        shown(A.permutation4(F.sha1(F.concat("key", "source")), never_identity=True)).alias("moved"),
    )


@query(
    "permute_map_back",
    f"""WITH {PERM_BASE.format("sha256(doc_id::VARCHAR)")}, {SWAPS} SELECT qid, letter AS shown_letter,
      'o' || a3 || '|o' || b3 || '|o' || c2 || '|o' || d1 AS shown_choices,
      substr('ABCD', 1 + CASE letter WHEN 'A' THEN a3 WHEN 'B' THEN b3 WHEN 'C' THEN c2 ELSE d1 END, 1) AS original_letter FROM p3""",
)
def permute_map_back(spark, sf):
    order = A.permutation4(F.sha2("key", 256))
    rows = shuffled(spark, sf).select("qid", "letter", order.alias("order"))
    shown = A.permute_choices(F.array(*[F.lit(f"o{i}") for i in range(4)]), "order")
    return rows.select("qid", F.col("letter").alias("shown_letter"), F.array_join(shown, "|").alias("shown_choices"),
                       A.map_letter_back("letter", "order").alias("original_letter"))


LOGP = f"""logp AS (SELECT doc_id AS qid, letter, CASE WHEN {DUCK.h("'m' || doc_id || letter")} % 7 = 0 THEN -30.0e0
    ELSE -({DUCK.h("'a' || doc_id || letter")} % 400) / 100.0e0 END AS l1,
    -({DUCK.h("'b' || doc_id || letter")} % 300) / 100.0e0 AS l2 FROM labels, (VALUES {LETTERS}) v(letter)),
soft AS (SELECT qid, letter, exp(l1 - max(l1) OVER q) AS e1, exp(l2 - max(l2) OVER q) AS e2 FROM logp WINDOW q AS (PARTITION BY qid)),
prob AS (SELECT qid, letter, e1 / sum(e1) OVER q AS p1, e2 / sum(e2) OVER q AS p2 FROM soft WINDOW q AS (PARTITION BY qid)),
pick AS (SELECT qid, list(p1 ORDER BY p1 DESC, letter) AS ps, -sum(p1 * ln(greatest(p1, 1e-12))) AS entropy, arg_max(letter, (p1, -ascii(letter))) AS first_pick,
    arg_max(letter, (ln(p1 + 1e-8) + ln(p2 + 1e-8), -ascii(letter))) AS both_pick FROM prob GROUP BY qid)
SELECT qid, round(ps[1], 6) AS top_p, round(ps[1] - ps[2], 6) AS margin, round(entropy, 6) AS entropy, first_pick,
  CASE WHEN ps[1] < 0.80 OR ps[1] - ps[2] < 0.45 THEN both_pick ELSE first_pick END AS selected FROM pick"""


@query("option_probs", f"WITH {LOGP}")
def option_probs(spark, sf):
    """Softmax over option log-probabilities in-row, then a second read where the first is not decisive."""
    lab = table(spark, sf, "labels")
    key = lambda p, x: F.concat(F.lit(p), F.col("doc_id").cast("string"), F.lit(x))
    first = F.array(*[F.when(T.hash_mod(key("m", x), 7) != 0, -T.hash_mod(key("a", x), 400) / 100) for x in K.LETTERS])
    second = F.array(*[-T.hash_mod(key("b", x), 300) / 100 for x in K.LETTERS])
    rows = lab.select(F.col("doc_id").alias("qid"), first.alias("first"), second.alias("second"))
    return A.option_reads(rows, "first", "second").select(
        "qid", F.round("top_p", 6).alias("top_p"), F.round("margin", 6).alias("margin"), F.round("entropy", 6).alias("entropy"), "first_pick", "selected"
    )


ROUNDS = f"""SELECT doc_id AS qid, letter, rnd, {DUCK.h("'s' || doc_id || letter || rnd")} % 100 / 100.0e0 AS support,
  {DUCK.h("'t' || doc_id || letter || rnd")} % 100 / 100.0e0 AS contradict, {DUCK.h("'u' || doc_id || letter || rnd")} % 100 / 100.0e0 AS unknown
  FROM labels, (VALUES {LETTERS}) v(letter), (VALUES (1),(2)) r(rnd)"""


def option_rounds(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.explode(F.array(*map(F.lit, K.LETTERS))).alias("letter"))
    lab = lab.select("qid", "letter", F.explode(F.array(F.lit(1), F.lit(2))).alias("rnd"))
    share = lambda p: T.hash_mod(F.concat(F.lit(p), "qid", "letter", "rnd"), 100) / 100
    return lab.select("qid", "letter", "rnd", share("s").alias("support"), share("t").alias("contradict"), share("u").alias("unknown"))


@query(
    "evidence_logodds",
    f"""SELECT qid, letter, round(ln(max(support) + 0.03) - ln(max(contradict) + 0.25 * min(unknown) + 0.03), 6) AS score
    FROM ({ROUNDS}) r GROUP BY qid, letter""",
)
def evidence_logodds(spark, sf):
    best = option_rounds(spark, sf).groupBy("qid", "letter").agg(
        F.max("support").alias("s"), F.max("contradict").alias("c"), F.min("unknown").alias("u")
    )
    return best.select("qid", "letter", F.round(A.evidence_logodds("s", "c", "u"), 6).alias("score"))


@query(
    "evidence_score",
    f"""SELECT qid, letter, CASE WHEN qid % 2 = 0 THEN 3 * c - 3 * s ELSE 3 * s - 3 * c END - d AS score FROM (
      SELECT doc_id AS qid, letter, {DUCK.h("'n1' || doc_id || letter")} % 5 AS s, {DUCK.h("'n2' || doc_id || letter")} % 5 AS c,
        {DUCK.h("'n3' || doc_id || letter")} % 5 AS d FROM labels, (VALUES {LETTERS}) v(letter)) t""",
)
def evidence_score(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.explode(F.array(*map(F.lit, K.LETTERS))).alias("letter"))
    ids = lambda p: F.array_repeat(F.lit("c"), T.hash_mod(F.concat(F.lit(p), "qid", "letter"), 5).cast("int"))
    rows = lab.select("qid", "letter", ids("n1").alias("support"), ids("n2").alias("contradict"), ids("n3").alias("decoy"))
    score = A.evidence_score(F.size("support"), F.size("contradict"), F.size("decoy"), F.col("qid") % 2 == 0)
    return rows.select("qid", "letter", score.alias("score"))


@query(
    "quality_flags",
    """SELECT page_id, CASE WHEN sus AND short THEN 'translation_or_format,very_short_gold' WHEN sus THEN 'translation_or_format'
      WHEN short THEN 'very_short_gold' ELSE '' END AS flags FROM (
      SELECT page_id, regexp_matches(html, '(?i)<br>|\\bpieces? of\\b|\\b200 acres\\b') AS sus, page_id % 5 = 0 AS short FROM pages) t""",
)
def quality_flags(spark, sf):
    gold = F.when(F.col("page_id") % 5 != 0, F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.array_join(A.quality_flags("html", gold), ",").alias("flags"))


@query(
    "budgeted_context",
    check("chunks", """SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY chunk_idx) AS context, count(*) AS n_blocks FROM (
      SELECT *, sum(length(block)) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS used FROM (
        SELECT doc_id, chunk_idx, '[c_' || chunk_idx || ']' || chr(10) || text AS block FROM chunks) b) u WHERE used <= 6000 GROUP BY doc_id"""),
)
def budgeted_context(spark, sf):
    chunks = S.chunk_fixed(doc_text(spark, sf))
    block = F.concat(F.lit("[c_"), F.col("chunk_idx").cast("string"), F.lit("]\n"), "text")
    return P.budgeted_context(chunks.select("doc_id", "chunk_idx", block.alias("block")), ["doc_id"], "chunk_idx", 6000)
