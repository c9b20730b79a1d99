"""Votes, gates, routes and leave-one-group-out selection over the long answer table.

Answers: (novel, qid, qtype, method, morder, selected, gold, correct). Held-out training uses
"total minus own group" sums, so nothing is retrained per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K

Q = ["novel", "qid", "gold"]


def valid(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isin(*K.LETTERS), F.lit(False))


def tallies(answers: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Votes per letter; unparsed answers do not vote."""
    return answers.filter(valid("selected")).groupBy(*keys, "selected").agg(F.count(F.lit(1)).alias("votes"), *extra)


def early(letter: str = "selected") -> Column:
    """Sort key that prefers earlier letters."""
    return -F.ascii(letter)


def majority(answers: DataFrame, keys: list[str], tiebreak: str) -> DataFrame:
    """Most votes; a tie goes to the named method's letter if it is among the leaders, else the first letter."""
    t = tallies(answers, keys, F.max((F.col("method") == tiebreak).cast("int")).alias("named"))
    rank = F.struct("votes", "named", early().alias("early"))
    return t.groupBy(*keys).agg(F.max_by("selected", rank).alias("winner"), F.max("votes").alias("votes"))


def latest(answers: DataFrame, keys: list[str], at_least: int = 2) -> DataFrame:
    """Most votes; a tie goes to the letter given by the latest method. Needs ``at_least`` votes."""
    t = tallies(answers, keys, F.max("morder").alias("late"))
    out = t.groupBy(*keys).agg(F.max_by("selected", F.struct("votes", "late")).alias("winner"), F.sum("votes").alias("cast"))
    return out.filter(F.col("cast") >= at_least)


def wide(answers: DataFrame, methods: list[str], keep: list[str] = Q) -> DataFrame:
    """One row per question, one letter column per method."""
    return answers.groupBy(*keep).pivot("method", methods).agg(F.first("selected"))


def row_majority(methods: list[str], fallback: str) -> Column:
    """Majority over letter columns of one row; a tie goes to ``fallback`` if it leads, else the first letter."""
    votes = {x: sum((F.coalesce(F.col(m) == x, F.lit(False)).cast("int") for m in methods), F.lit(0)) for x in K.LETTERS}
    top = F.greatest(*votes.values())
    leads = reduce(lambda a, b: a | b, [F.coalesce(F.col(fallback) == x, F.lit(False)) & (v == top) for x, v in votes.items()])
    first = F.coalesce(*[F.when(v == top, x) for x, v in votes.items()])
    return F.when(top == 0, None).when(leads, F.col(fallback)).otherwise(first)


def majority_or(methods: list[str], fallback: str, need: int = 2) -> tuple[Column, Column]:
    """Letter with at least ``need`` of the methods, else the fallback method; and the route taken."""
    counts = [sum((F.coalesce(F.col(m) == x, F.lit(False)).cast("int") for m in methods), F.lit(0)) for x in K.LETTERS]
    hit = F.coalesce(*[F.when(c >= need, x) for x, c in zip(K.LETTERS, counts)])
    return F.coalesce(hit, F.col(fallback)), F.when(hit.isNotNull(), "majority").otherwise("fallback")


def agree_else(a: str, b: str, fallback: str) -> tuple[Column, Column]:
    """First method's letter when two methods agree, else a fallback method; and the route taken."""
    same = F.coalesce((F.col(a) == F.col(b)) & valid(a), F.lit(False))
    return F.when(same, F.col(a)).otherwise(F.col(fallback)), F.when(same, "agreement").otherwise("fallback")


def apply_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every named rule on every row, long: (.., rule, priority, choice)."""
    table = F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(i).alias("priority"), c.alias("choice")) for i, (n, c) in enumerate(rules.items())
    ]))
    return rows.select("*", table)


def agrees(a: str, *others: str) -> Column:
    """How many of the other methods gave the same letter."""
    return sum((F.coalesce(F.col(a) == F.col(m), F.lit(False)).cast("int") for m in others), F.lit(0))


def route_tables(rows: DataFrame, tables: dict[str, list[tuple[str, str, str, str]]]) -> DataFrame:
    """Every route of every table on every wide row, long: (.., study, rule, priority, choice). Conditions are SQL over the row."""
    routes = [
        F.struct(F.lit(study).alias("study"), F.lit(name).alias("rule"), F.lit(i).alias("priority"), F.when(F.expr(f"coalesce({cond}, false)"), F.col(then)).otherwise(F.col(other)).alias("choice"))
        for study, table in tables.items()
        for i, (name, cond, then, other) in enumerate(table)
    ]
    return rows.select("*", F.inline(F.array(*routes)))


# -- reliability -----------------------------------------------------------------------
def held_out(counts: DataFrame, groups: DataFrame, keys: list[str], group: str = "novel") -> DataFrame:
    """For every group, sums of ``c`` and ``n`` per key over all *other* groups.

    ``counts``: (group, keys, c, n); ``groups``: distinct groups to hold out.
    """
    total = counts.groupBy(*keys).agg(F.sum("c").alias("_c"), F.sum("n").alias("_n"))
    # every key counts for every group, also where the group has no row of it; keys are the methods, rules or settings
    # that are compared, so their number does not grow with the data
    every = groups.select(group).distinct().crossJoin(F.broadcast(total))
    own = counts.select(group, *keys, "c", "n")
    out = every.join(own, [group, *keys], "left")
    return out.select(
        group, *keys, (F.col("_c") - F.coalesce("c", F.lit(0))).alias("c"), (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n")
    )


def reliability(answers: DataFrame, blend: float) -> DataFrame:
    """Smoothed accuracy per (type, method), blended with the method's overall accuracy."""
    overall = answers.groupBy("method").agg(((F.sum("correct") + 1) / (F.count(F.lit(1)) + 2)).alias("g"))
    by_type = answers.groupBy("qtype", "method").agg(F.sum("correct").alias("c"), F.count(F.lit(1)).alias("n"))
    local = (F.col("c") + 2 * F.col("g")) / (F.col("n") + 2)
    return by_type.join(overall, "method").select("qtype", "method", ((1 - blend) * F.col("g") + blend * local).alias("weight"))


def weighted_vote(rows: DataFrame, keys: list[str], fallback: str) -> DataFrame:
    """Letter of most weight with its margin; near-ties go to the fallback method's letter, else the first.

    ``rows``: (keys, method, selected, weight).
    """
    sums = rows.filter(valid("selected")).groupBy(*keys, "selected").agg(
        F.round(F.sum("weight"), 9).alias("s"), F.max((F.col("method") == fallback).cast("int")).alias("named")
    )
    packed = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "named", early().alias("early"), "selected")), asc=False).alias("r"))
    second = F.coalesce(F.get("r", F.lit(1))["s"], F.lit(0.0))
    return packed.select(*keys, F.get("r", F.lit(0))["selected"].alias("winner"), (F.get("r", F.lit(0))["s"] - second).alias("margin"))


def method_counts(answers: DataFrame, *keys: str) -> DataFrame:
    return answers.groupBy("novel", *keys).agg(F.sum("correct").alias("c"), F.count(F.lit(1)).alias("n"))


def smoothed(c: str = "c", n: str = "n") -> Column:
    """(c+2)/(n+8); no training rows count as chance."""
    return F.when(F.col(n) == 0, 0.25).otherwise((F.col(c) + 2.0) / (F.col(n) + 8.0))


def best_method_held_out(answers: DataFrame, by_type: bool) -> DataFrame:
    """Answers of the method that did best on the other groups (optionally on the same type)."""
    keys = ["qtype", "method", "morder"] if by_type else ["method", "morder"]
    train = held_out(method_counts(answers, *keys), answers, keys)
    group = ["novel", *keys[:-2]]
    best = train.groupBy(*group).agg(F.max_by("method", F.struct(smoothed(), -F.col("morder"))).alias("method"))
    return answers.join(best, [*group, "method"])


def weighted_held_out(answers: DataFrame, fallback: str) -> DataFrame:
    """Votes weighted by how far a method beats chance on the other groups."""
    train = held_out(method_counts(answers, "method"), answers, ["method"])
    w = train.select("novel", "method", F.greatest(smoothed() - 0.25, F.lit(0.0)).alias("weight"))
    return weighted_vote(answers.join(w, ["novel", "method"]), Q, fallback)


def confidence_vote_held_out(answers: DataFrame, lead: str, methods: list[str]) -> DataFrame:
    """Votes weighted by smoothed held-out accuracy; the lead's sure answers weigh by the accuracy of its sure answers."""
    rows = answers.filter(F.col("method").isin(*methods))
    plain = held_out(method_counts(rows, "method"), answers, ["method"]).select("novel", "method", ((F.col("c") + 1) / (F.col("n") + 2)).alias("plain"))
    sure_rows = rows.filter((F.col("method") == lead) & (F.col("confidence") == "high"))
    sure = held_out(method_counts(sure_rows, "method"), answers, ["method"]).select("novel", ((F.col("c") + 1) / (F.col("n") + 2)).alias("sure"))
    both = rows.join(plain, ["novel", "method"]).join(sure, "novel", "left")
    own = (F.col("method") == lead) & (F.col("confidence") == "high")
    return weighted_vote(both.withColumn("weight", F.when(own, F.coalesce("sure", F.lit(0.5))).otherwise(F.col("plain"))), Q, lead)


def routed_by_type(answers: DataFrame, at_least: int = 5) -> DataFrame:
    """Best method by raw held-out accuracy on the row's type, or on everything if the type is rare."""
    typed = held_out(method_counts(answers, "qtype", "method", "morder"), answers, ["qtype", "method", "morder"])
    every = held_out(method_counts(answers, "method", "morder"), answers, ["method", "morder"])
    every = every.select("novel", "method", F.col("c").alias("ec"), F.col("n").alias("en"))
    both = typed.join(every, ["novel", "method"])
    rate = F.when(F.col("n") >= at_least, F.col("c") / F.col("n")).otherwise(F.try_divide("ec", "en"))
    best = both.groupBy("novel", "qtype").agg(F.max_by("method", F.struct(rate, -F.col("morder"))).alias("method"))
    return answers.join(best, ["novel", "qtype", "method"])


def best_rule_held_out(ruled: DataFrame) -> DataFrame:
    """Choice of the rule that did best on the other groups; ties by rule order."""
    scored = ruled.withColumn("hit", F.coalesce(F.col("choice") == F.col("gold"), F.lit(False)).cast("int"))
    counts = scored.groupBy("novel", "rule", "priority").agg(F.sum("hit").alias("c"), F.count(F.lit(1)).alias("n"))
    train = held_out(counts, scored, ["rule", "priority"])
    best = train.groupBy("novel").agg(F.max_by("rule", F.struct("c", -F.col("priority"))).alias("rule"))
    return scored.join(best, ["novel", "rule"])


def combine_if_better(answers: DataFrame, new: list[str], base: list[str], gain: float = 0.05) -> DataFrame:
    """Best new method only where it beats the best baseline by ``gain`` on the other groups."""
    train = held_out(method_counts(answers, "method", "morder"), answers, ["method", "morder"])
    rate = F.struct(F.try_divide("c", "n").alias("acc"), (-F.col("morder")).alias("o"))
    best = lambda names: F.max(F.when(F.col("method").isin(*names), F.struct(rate.alias("r"), F.col("method").alias("m"))))
    picked = train.groupBy("novel").agg(best(new).alias("a"), best(base).alias("b"))
    better = F.round(F.col("a.r.acc") - F.col("b.r.acc"), 9) >= gain
    return answers.join(picked.select("novel", F.when(better, F.col("a.m")).otherwise(F.col("b.m")).alias("method")), ["novel", "method"])


GATE = {"evidence": range(7), "support": range(4), "agree": range(5), "confidence": range(3), "third": range(2)}


def gate_grid(rows: DataFrame) -> DataFrame:
    """Best of 840 gate settings per held-out group.

    ``rows``: (novel, the five features, first, fallback, gold). A setting takes the first letter
    where every feature reaches its threshold. Only disagreeing rows can change the score: they are
    summed per distinct feature vector first, then credited to the settings they satisfy.
    """
    names = list(GATE)
    hit = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False)).cast("int")
    differ = ~F.coalesce(F.col("first").eqNullSafe(F.col("fallback")), F.lit(False))
    small = rows.filter(differ).groupBy("novel", *names).agg(F.sum(hit("first") - hit("fallback")).alias("c"), F.count(F.lit(1)).alias("n"))
    for name in names:
        top = max(GATE[name])
        reach = F.sequence(F.lit(0), F.least(F.col(name).cast("int"), F.lit(top)))
        small = small.withColumn(name, F.explode(reach))
    counts = small.groupBy("novel", *names).agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    # every setting exists for every group, also where no row satisfies it
    grid = rows.select("novel").distinct()
    for name in names:
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(i) for i in GATE[name]])))
    full = grid.join(counts, ["novel", *names], "left").fillna(0, ["c", "n"])
    train = held_out(full, rows, names)
    strict = F.col("evidence") + F.col("support") + F.col("agree") + F.col("confidence")
    order = F.struct("c", -F.col("n"), strict, "third", *names)
    return train.groupBy("novel").agg(F.max_by(F.struct(*names), order).alias("g")).select("novel", "g.*")


def apply_gate(rows: DataFrame, settings: DataFrame) -> DataFrame:
    limits = settings.select("novel", *[F.col(n).alias(f"min_{n}") for n in GATE])
    ok = reduce(lambda a, b: a & b, [F.col(n) >= F.col(f"min_{n}") for n in GATE])
    return rows.join(limits, "novel").withColumn("choice", F.when(ok, F.col("first")).otherwise(F.col("fallback")))


def blend_scores(answers: DataFrame, fallback: str, blends: list[float]) -> DataFrame:
    """Held-out accuracy of the weighted vote for each blend of overall and per-type reliability."""
    overall = held_out(method_counts(answers, "method"), answers, ["method"])
    g = overall.select("novel", "method", ((F.col("c") + 1) / (F.col("n") + 2)).alias("g"))
    typed = held_out(method_counts(answers, "qtype", "method"), answers, ["qtype", "method"])
    w = typed.join(g, ["novel", "method"]).withColumn("blend", F.explode(F.array(*[F.lit(b) for b in blends])))
    local = (F.col("c") + 2 * F.col("g")) / (F.col("n") + 2)
    w = w.select("novel", "qtype", "method", "blend", ((1 - F.col("blend")) * F.col("g") + F.col("blend") * local).alias("weight"))
    voted = weighted_vote(answers.join(w, ["novel", "qtype", "method"]), ["blend", *Q], fallback)
    hit = F.coalesce(F.col("winner") == F.col("gold"), F.lit(False)).cast("int")
    return voted.groupBy("blend").agg(F.sum(hit).alias("correct"))


# -- verdicts and gates -------------------------------------------------------------------
def signed(verdict: str, plus: str, minus: str, confidence: str) -> Column:
    v = F.col(verdict)
    return F.when(v == plus, F.col(confidence)).when(v == minus, -F.col(confidence)).otherwise(0.0)


def best_candidate(verdicts: DataFrame, keys: list[str], threshold: float = 0.3) -> DataFrame:
    """Candidate with the highest signed confidence, if it clears the threshold; ties keep the first."""
    s = verdicts.withColumn("score", signed("verdict", "support", "refute", "confidence"))
    best = s.groupBy(*keys).agg(F.max("score").alias("score"), F.max_by("candidate", F.struct("score", -F.col("ord"))).alias("best"))
    return best.withColumn("best", F.when(F.col("score") > threshold, F.col("best")))


def obligation_scores(checks: DataFrame, keys: list[str], decisive: float = 0.6) -> DataFrame:
    """Sum of signed confidences up to the first decisive check, with a bonus or malus for it."""
    strong = (F.col("confidence") >= decisive) & F.col("verdict").isin("supported", "violated")
    stop = checks.groupBy(*keys).agg(
        F.min(F.when(strong, F.col("ord"))).alias("stop"), F.min_by("verdict", F.when(strong, F.col("ord"))).alias("end")
    )
    used = checks.join(stop, keys).filter(F.col("stop").isNull() | (F.col("ord") <= F.col("stop")))
    bonus = F.when(F.col("end") == "supported", 0.5).when(F.col("end") == "violated", -0.5).otherwise(0.0)
    state = F.when(F.col("end") == "supported", "accepted").when(F.col("end") == "violated", "rejected").otherwise("unknown")
    out = used.groupBy(*keys, "stop", "end").agg(F.sum(signed("verdict", "supported", "violated", "confidence")).alias("s"))
    return out.select(*keys, state.alias("state"), F.round(F.col("s") + F.when(F.col("stop").isNotNull(), bonus).otherwise(0.0), 3).alias("score"))


def evidence_gate(cands: DataFrame, lead: str, fallback_letter: str) -> DataFrame:
    """Accept the lead method when it is stable, grounded and backed; else the letter with most evidence.

    ``cands``: (qid, method, selected, n_evidence, consistent, ``fallback_letter``).
    """
    ok = valid("selected")
    mine = F.col("method") == lead
    grounded = F.when(ok & (F.col("n_evidence") > 0), F.col("selected"))
    per = cands.groupBy("qid").agg(
        F.first(F.when(mine & ok & F.col("consistent") & (F.col("n_evidence") > 0), F.col("selected")), True).alias("direct"),
        F.collect_list(grounded).alias("grounded"), F.first(fallback_letter, True).alias("fb"),
    )
    weights = cands.filter(ok).groupBy("qid", "selected").agg(F.sum(2 * F.col("n_evidence")).alias("w"))
    best = weights.groupBy("qid").agg(F.max_by("selected", F.struct("w", early())).alias("heaviest"))
    out = per.join(best, "qid", "left")
    backed = F.size(F.filter("grounded", lambda x: x == F.col("direct"))) >= 2
    accept = F.coalesce(F.col("direct").isNotNull() & backed, F.lit(False))
    return out.select(
        "qid", accept.alias("accepted"), F.when(accept, F.col("direct")).otherwise(F.coalesce("heaviest", "fb", F.lit("A"))).alias("winner")
    )
