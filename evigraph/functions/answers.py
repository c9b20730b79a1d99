"""Column functions over questions and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import constants as K
from .text import as_col, hex_int, norm_text, word_regex


def _first_rule(question, rules, default: str) -> Column:
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(as_col(question).rlike(word_regex(words)), name).otherwise(out)
    return out


def question_type(question) -> Column:
    """Nine ordered classes; the first rule that matches wins."""
    return _first_rule(question, K.QUESTION_RULES, "clue_fact")


def question_type5(question) -> Column:
    return _first_rule(question, K.QUESTION_RULES_SHORT, "fact")


def is_negative(question) -> Column:
    return as_col(question).rlike(word_regex(K.NEGATIVE_WORDS))


def is_who(question) -> Column:
    return as_col(question).rlike(word_regex(K.WHO_WORDS))


def question_role(question) -> Column:
    q = as_col(question)
    victim = F.trim(F.regexp_extract(q, "killed\\s+(.+?)[?？]", 1))
    return (
        F.when(victim != "", F.concat(F.lit("the killer of "), victim))
        .when(F.lower(q).contains("accomplice"), F.lit("the accomplice of the killer"))
        .otherwise(F.lit("the correct answer"))
    )


def letter_by_patterns(text, patterns: list[str], last: bool = True) -> Column:
    """First pattern with a match decides; ``last`` picks its last match, else its first."""
    body = F.trim(F.coalesce(as_col(text), F.lit("")))
    hits = [
        F.try_element_at(F.regexp_extract_all(body, F.lit(p), 1), F.lit(-1 if last else 1))
        for p in patterns
    ]
    return F.upper(F.coalesce(*hits))


def answer_letter(text) -> Column:
    return letter_by_patterns(text, K.LETTER_LAST)


def answer_letter_prose(text) -> Column:
    """Standard grammar first, then prose phrasings."""
    return F.coalesce(answer_letter(text), letter_by_patterns(text, K.LETTER_PROSE))


def answer_letter_marked(text) -> Column:
    return letter_by_patterns(text, K.LETTER_MARKED, last=False)


def answer_letter_bilingual(text) -> Column:
    """JSON answers first, then English or Chinese phrasings."""
    body = F.trim(F.coalesce(as_col(text), F.lit("")))
    bare = F.regexp_replace(body, r"(?i)^```(?:json)?\s*|\s*```$", "")
    field = F.upper(F.trim(F.get_json_object(bare, "$.selected_letter")))
    return F.coalesce(
        F.when(field.rlike("^[A-D]$"), field), letter_by_patterns(text, K.LETTER_BILINGUAL, last=False)
    )


def answer_number(text, n_choices) -> Column:
    """Zero-based choice: last ``ANSWER: N`` in range; without one, a trailing letter."""
    body = F.coalesce(as_col(text), F.lit(""))
    number = F.try_element_at(F.regexp_extract_all(body, F.lit(K.ANSWER_NUMBER), 1), F.lit(-1))
    picked = number.try_cast("int")
    letter = F.try_element_at(F.regexp_extract_all(F.trim(body), F.lit(K.ANSWER_TAIL_LETTER), 1), F.lit(1))
    index = F.ascii(letter) - F.ascii(F.lit("A"))
    return F.when(
        number.isNotNull(), F.when(picked.between(1, n_choices), picked - 1)
    ).otherwise(F.when(index < n_choices, index)).cast("int")


def judge_pair(answer, gold_pairs) -> dict[str, Column]:
    """Compare an (evidence, testimony) answer with the gold pairs; exact and partial hits."""
    a = as_col(answer)
    quoted = r'(?s)"evidence"\s*:\s*(\d+).*?"testimony"\s*:\s*(\d+)'
    ev = F.coalesce(
        F.get_json_object(a, "$.evidence").try_cast("int"), F.regexp_extract(a, quoted, 1).try_cast("int")
    )
    te = F.coalesce(
        F.get_json_object(a, "$.testimony").try_cast("int"), F.regexp_extract(a, quoted, 2).try_cast("int")
    )
    gold = as_col(gold_pairs)
    hit = lambda test: F.coalesce(F.exists(gold, test), F.lit(False))
    return {
        "pair_hit": hit(lambda p: (p[0] == ev) & (p[1] == te)),
        "evidence_hit": hit(lambda p: p[0] == ev),
        "testimony_hit": hit(lambda p: p[1] == te),
    }


def verdict(value) -> Column:
    text = F.lower(F.coalesce(as_col(value), F.lit("")))
    return (
        F.when(text.rlike("|".join(K.VERDICT_CONTRADICT)), "contradicted")
        .when(text.rlike("|".join(K.VERDICT_SUPPORT)), "supported")
        .otherwise("unknown")
    )


def evidence_status(support, contradict) -> Column:
    s, c = as_col(support), as_col(contradict)
    return F.when(s & c, "mixed").when(s, "supported").when(c, "contradicted").otherwise("unknown")


def quote_grounded(quote, passage, min_chars: int = 18) -> Column:
    """Normalised quote is long enough and occurs verbatim in the normalised passage."""
    q = norm_text(F.regexp_replace(F.trim(as_col(quote)), "^[\"']+|[\"']+$", ""))
    return (F.length(q) >= min_chars) & norm_text(passage).contains(q)


def is_generic_name(name) -> Column:
    n = F.lower(F.trim(F.coalesce(as_col(name), F.lit(""))))
    return n.isin(K.PRONOUNS) | n.rlike(K.GENERIC_NAME)


def clean_link(source, target, relation, evidence, passage) -> Column:
    """True for links between real entities whose evidence is in the passage."""
    s, t = F.trim(as_col(source)), F.trim(as_col(target))
    return (
        (s != "") & (t != "") & ~s.rlike(K.OPTION_ENTITY) & ~t.rlike(K.OPTION_ENTITY)
        & (norm_text(s) != norm_text(t))
        & as_col(relation).isin(K.HIGH_VALUE_RELATIONS)
        & quote_grounded(evidence, passage)
    )


def permutation4(digest, never_identity: bool = False) -> Column:
    """Shuffle of [0,1,2,3]: slot i swaps with byte i of a hex digest, i = 3, 2, 1."""
    order = F.array(*[F.lit(i) for i in range(4)])
    for i in (3, 2, 1):
        j = (hex_int(digest, 1 + 2 * i, 2) % (i + 1)).cast("int")
        swapped = [
            F.when(j == k, F.get(order, F.lit(i))).otherwise(F.get(order, F.lit(k))) for k in range(i)
        ]
        kept = [F.get(order, F.lit(k)) for k in range(i + 1, 4)]
        order = F.array(*swapped, F.get(order, j), *kept)
    if never_identity:
        same = order == F.array(*[F.lit(i) for i in range(4)])
        order = F.when(same, F.array(*[F.lit(i) for i in (1, 2, 3, 0)])).otherwise(order)
    return order


def permute_choices(choices, order) -> Column:
    return F.transform(as_col(order), lambda i: F.get(as_col(choices), i))


def map_letter_back(letter, order) -> Column:
    """Letter shown under a permutation -> letter of the original option."""
    shown = F.ascii(as_col(letter)) - F.ascii(F.lit("A"))
    original = F.get(as_col(order), shown)
    return F.when(as_col(letter).isNotNull(), F.substring(F.lit(K.LETTERS), 1, 4).substr(original + 1, F.lit(1)))


def evidence_logodds(support, contradict, unknown) -> Column:
    return F.log(as_col(support) + 0.03) - F.log(as_col(contradict) + 0.25 * as_col(unknown) + 0.03)


def evidence_score(n_support, n_contradict, n_decoy, negative) -> Column:
    """3*support - 3*contradict - decoy; a negative question flips the first two."""
    flip = F.when(as_col(negative), F.lit(-1)).otherwise(F.lit(1))
    return flip * 3 * (as_col(n_support) - as_col(n_contradict)) - as_col(n_decoy)


def quality_flags(text, gold_text) -> Column:
    body = F.concat_ws(" ", as_col(text), F.coalesce(as_col(gold_text), F.lit("")))
    return F.array_compact(
        F.array(
            F.when(body.rlike(K.SUSPICIOUS_TEXT), F.lit("translation_or_format")),
            F.when(F.length(F.coalesce(as_col(gold_text), F.lit(""))) < 2, F.lit("very_short_gold")),
        )
    )


def softmax(logps) -> Column:
    """Probabilities from an array of log-probabilities; missing letters count as -30."""
    full = F.transform(as_col(logps), lambda x: F.coalesce(x, F.lit(-30.0)))
    raised = F.transform(full, lambda x: F.exp(x - F.array_max(full)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def best_letter(scores) -> Column:
    """Letter of the largest array entry, earliest on ties."""
    at = F.array_position(as_col(scores), F.array_max(as_col(scores))).cast("int")
    return F.lit(K.LETTERS).substr(at, F.lit(1))


def option_reads(rows: DataFrame, first: str, second: str) -> DataFrame:
    """First-read distribution with entropy and margin; a weak first read adds the second's log-probabilities."""
    p = rows.withColumn("_p", softmax(first)).withColumn("_q", softmax(second))
    ranked = F.sort_array("_p", asc=False)
    top, margin = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))
    entropy = -F.aggregate("_p", F.lit(0.0), lambda a, x: a + x * F.log(F.greatest(x, F.lit(1e-12))))
    both = F.zip_with("_p", "_q", lambda a, b: F.log(a + 1e-8) + F.log(b + 1e-8))
    out = (
        p.withColumn("top_p", top).withColumn("margin", margin).withColumn("entropy", entropy)
        .withColumn("first_pick", best_letter("_p"))
    )
    weak = (F.col("top_p") < 0.80) | (F.col("margin") < 0.45)
    return out.withColumn("selected", F.when(weak, best_letter(both)).otherwise(F.col("first_pick"))).drop("_p", "_q")
