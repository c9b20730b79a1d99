"""Small graphs: merging, hops, masks, quality, cores and rank propagation."""

import random

from pyspark.sql import functions as F

from evigraph.common import cut_lineage
from evigraph.operators import graph as G, iterate as I, retrieve as R

EDGE = "graph_id int, edge_id string, src string, dst string, type string, evidence string, confidence double, decoy boolean, importance int"


def edges(spark, rows):
    return spark.createDataFrame([(1, f"e{i}", s, t, k, ev, c, d, im) for i, (s, t, k, ev, c, d, im) in enumerate(rows)], EDGE)


def test_alias_resolution_and_dedup(spark):
    nodes = spark.createDataFrame([(1, "n1", "The Alice", "Miss A"), (1, "n2", "Bob", ""), (1, "n3", "Knife", "")], "graph_id int, node_id string, name string, alias string")
    rel = spark.createDataFrame(
        [(1, 1, "alice", "Knife", "means", "She took it"), (1, 2, "miss a", "knife", "means", "she  TOOK it"), (1, 3, "alice", "Ghost", "means", "x")],
        "graph_id int, rid int, source string, target string, type string, evidence string",
    )
    out = G.resolved_endpoints(rel, nodes)
    assert out.filter("src is null or dst is null").count() == 1
    kept = G.deduped_edges(out.filter("src is not null and dst is not null"), ["rid"]).collect()
    assert [(r.src, r.dst, r.rid) for r in kept] == [("n1", "n3", 1)]


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    rows = [("g", i, [f"k{rng.randint(0, 60)}", f"k{rng.randint(0, 60)}"]) for i in range(50)] + [("h", i, ["same", f"u{i}"]) for i in range(30)]
    parent = {(g, i): i for g, i, _ in rows}

    def find(x):
        while parent[x] != x[1]:
            x = (x[0], parent[x])
        return x[1]

    for a in rows:
        for b in rows:
            if a[0] == b[0] and set(a[2]) & set(b[2]):
                x, y = find(a[:2]), find(b[:2])
                parent[(a[0], max(x, y))] = min(x, y)
    got = {(r.g, r.rec): r.label for r in G.resolved_entities(spark.createDataFrame(rows, "g string, rec int, names array<string>"), ["g"], "rec").collect()}
    assert got == {k: find(k) for k in parent}


def test_hops(spark):
    e = edges(spark, [("n1", "n2", "means", "", 0.9, False, 3), ("n2", "n3", "means", "", 0.8, False, 3), ("n1", "n1", "means", "", 0.7, False, 3)])
    first = spark.createDataFrame([(1, 1, "n1", 1.0, 1)], "graph_id int, qid int, node_id string, score double, rank int")
    got = {(r.node_id, r.hop) for r in R.k_hop(first, e, [5, 5]).collect()}
    assert got == {("n1", 1), ("n2", 2), ("n3", 3)}


def test_decoys_rank_lower(spark):
    nodes = spark.createDataFrame([(1, "a", "A", "person"), (1, "b", "B", "person"), (1, "v", "V", "event")], "graph_id int, node_id string, name string, type string")
    e = edges(spark, [("a", "v", "motive", "x", 0.9, True, 5), ("b", "v", "motive", "y", 0.8, False, 3), ("v", "a", "motive", "y", 0.9, False, 3)])
    best, _ = G.suspect_chain(nodes, e)
    assert [r.src for r in best.orderBy("rank").collect()] == ["b", "a"]


def test_sparse_graph_fails_gate(spark):
    nodes = spark.createDataFrame([(1, f"n{i}", 1) for i in range(10)], "graph_id int, node_id string, mention_count int")
    e = edges(spark, [("n0", "n1", "means", "", 0.9, False, 3)])
    m = G.graph_metrics(nodes, e).withColumns({"dropped": F.lit(0), "deduplicated": F.lit(0), "candidate_persons": F.lit(0), "merged_nodes": F.lit(0)})
    row = G.quality_gate(m).first()
    assert not row.passed and row.failures == ["isolate_rate", "edge_node_ratio"]


def test_mask_leaks_nothing(spark):
    nodes = spark.createDataFrame(
        [(1, "a", "alice", "the killer", ["Alice met Bob"], 0.9, "later reveal"), (1, "b", "bob", "x", ["Bob fled at night"], 0.9, "y")],
        "graph_id int, node_id string, name string, alias string, evidence array<string>, text_pos double, description string",
    )
    e = edges(spark, [("a", "b", "motive", "alice met bob", 0.9, False, 3), ("a", "a", "motive", "alice met bob", 0.9, False, 3)])
    seen = spark.createDataFrame([(1, "Alice  met\nBob in town.", 0.5)], "graph_id int, visible string, visible_ratio double")
    n, kept = G.strict_mask(nodes, e, seen)
    row = n.collect()
    assert [(r.node_id, r.alias, r.description) for r in row] == [("a", None, "Alice met Bob")]
    assert [(r.src, r.dst) for r in kept.collect()] == [("a", "a")]


def test_pronoun_edge_moves(spark):
    nodes = spark.createDataFrame([(1, "n1", "Alice"), (1, "n2", "the woman"), (1, "n3", "Bob")], "graph_id int, node_id string, name string")
    e = edges(spark, [("n2", "n3", "motive", "she hid it", 0.9, False, 3), ("n3", "n1", "motive", "she saw", 0.9, False, 3)]).withColumn("seq", F.lit(7).cast("long"))
    ante = G.antecedent_map(spark.createDataFrame([(1, "id=7", "alice"), (1, "x", "Bob")], "graph_id int, key string, name string"), spark.createDataFrame([(7,)], "seq long"))
    got = {r.edge_id: (r.src, r.dst, r.moved) for r in G.reattached_edges(e, nodes, ante).collect()}
    assert got == {"e0": ("n1", "n3", True), "e1": ("n3", "n1", None)}


def brute_plan(groups, nodes, fits):
    """Ordered fold over one whole graph; ``fits`` holds the ordered name pairs that go together."""
    head, name, degree = {}, {i: n for i, n, _ in nodes}, {i: d for i, _, d in nodes}
    by = {n.lower(): i for i, n, _ in nodes}
    for _, members in sorted(groups):
        ids = list(dict.fromkeys(by[m.lower()] for m in members if m.lower() in by))
        heads = {head[i] for i in ids if i in head}
        first = heads.copy().pop() if heads else max(ids, key=degree.get, default=None)
        if len(ids) > 1 and len(heads) < 2 and first in ids:
            for i in ids:
                if i != first and i not in head and (name[first], name[i]) in fits:
                    head[i] = head[first] = first
    return {i: h for i, h in head.items() if i != h}


def plan_of(spark, graphs):
    """The plan of several graphs next to the fold of each."""
    names = sorted({n for nodes, _ in graphs.values() for _, n, _ in nodes})
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    fits = {(r.a, r.b) for r in G.name_compatible(pairs, "a", "b").collect() if r.compatible}
    want = {(g, i): h for g, (nodes, groups) in graphs.items() for i, h in brute_plan(groups, nodes, fits).items()}
    out = G.consolidation_plan(
        spark.createDataFrame([(g, n, m) for g, (_, groups) in graphs.items() for n, m in groups], "graph_id int, group_no long, members array<string>"),
        spark.createDataFrame([(g, i, n, d) for g, (nodes, _) in graphs.items() for i, n, d in nodes], "graph_id int, node_id string, name string, degree int"),
    ).collect()
    assert len(out) == len({(r.graph_id, r.node_id) for r in out})
    return {(r.graph_id, r.node_id): r.canonical for r in out}, want


def test_consolidation_in_waves_equals_the_ordered_fold(spark):
    rng = random.Random(4)
    base = ["anna grey", "ann grey", "mrs grey", "mr grey", "tom hale", "thomas hale", "t. hale", "eve stone", "eva stone", "dr stone", "max", "maxim"]
    graphs = {}
    for g in range(6):
        nodes = [(f"n{i}", n, rng.randint(0, 3)) for i, n in enumerate(base)]
        graphs[g] = nodes, [(i, rng.sample(base, rng.randint(2, 3 + g % 3))) for i in range(14)]
    got, want = plan_of(spark, graphs)
    assert len(want) > 12 and got == want


def test_consolidation_of_chains_and_of_a_node_in_all_groups(spark):
    chain = [(f"n{i}", f"lee part{i:02}", 9 - i) for i in range(7)]  # each group hands its head on to the next
    hot = [("hot", "lee", 1)] + [(f"m{i}", f"lee x{i}", 0) for i in range(40)]
    graphs = {
        1: (chain, [(i, [chain[i][1], chain[i + 1][1]]) for i in range(6)]),
        2: (hot, [(i, ["lee", f"lee x{i}"]) for i in range(40)]),
        3: ([("a", "ann", 0)], [(1, ["ann", "ann", "nobody"])]),
    }
    got, want = plan_of(spark, graphs)
    assert got == want and sum(g == 2 for g, _ in got) == 40
    assert plan_of(spark, {1: (chain, [(0, ["nobody"])])})[0] == {}


def test_proven_quotes_in_lots(spark):
    quotes = [(1, f"w{i}") for i in range(30)] * 2 + [(1, ""), (1, None), (2, "w1"), (3, "w1")]
    texts = [(1, " ".join(f"W{i}" for i in range(0, 30, 2))), (2, None), (4, "w1")]
    asked = spark.createDataFrame(quotes, "graph_id int, quote string")
    out = G.proven_quotes(asked, spark.createDataFrame(texts, "graph_id int, visible string"), lot=4).collect()
    body = G.norm_text(F.lit(texts[0][1]))
    shown = spark.range(1).select(body.alias("b")).first().b
    assert sorted(map(tuple, out)) == sorted((1, f"w{i}") for i in range(30) if f"w{i}" in shown)
    assert len(out) == len(set(out))


def test_name_guard(spark):
    names = ["Mr. Grey", "Mrs Grey", "Anna Grey", "Ana Grey", "Dr", "Jean-Paul Hale", "Hale", "Bob", "Boris"]
    together = [{"Mr. Grey", "Anna Grey", "Ana Grey"}, {"Mrs Grey", "Anna Grey", "Ana Grey"}, {"Jean-Paul Hale", "Hale"}]
    out = G.name_compatible(spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string"), "a", "b").collect()
    assert len(out) == len(names) ** 2
    for r in out:
        assert r.compatible == (r.a != "Dr" and (r.a == r.b or any({r.a, r.b} <= t for t in together))), (r.a, r.b)


def test_core_equals_brute_force(spark):
    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(32)}
    left = set(pairs)
    while True:
        deg = {}
        for a, b in left:
            deg[a] = deg.get(a, 0) + 1
            deg[b] = deg.get(b, 0) + 1
        keep = {(a, b) for a, b in left if deg[a] >= 2 and deg[b] >= 2}
        if keep == left:
            break
        left = keep
    out = I.k_core(spark.createDataFrame([(1, a, b) for a, b in pairs], "graph_id int, a int, b int"), ["graph_id"]).collect()
    assert {(r.a, r.b) for r in out} == left


def test_rank_equals_dense_iteration(spark):
    names = ["a", "b", "c", "lone"]
    raw = [("a", "b", 1.0), ("a", "b", 0.5), ("b", "c", 2.0), ("c", "c", 1.0)]
    seed = {"a": 0.5, "b": 0.0, "c": 0.2, "lone": 0.3}
    out = {n: [] for n in names}
    for s, t, w in raw:
        out[s].append((t, w))
        out[t].append((s, w))
    rank = dict(seed)
    for _ in range(16):
        stuck = sum(rank[n] for n in names if not out[n])
        new = {n: 0.22 * seed[n] + 0.78 * stuck * seed[n] for n in names}
        for n in names:
            total = sum(w for _, w in out[n])
            for t, w in out[n]:
                new[t] += 0.78 * rank[n] * w / total
        rank = new
    got = I.personalized_rank(
        spark.createDataFrame([(1, *r) for r in raw], "graph_id int, src string, dst string, weight double"),
        spark.createDataFrame([(1, 7, n, v) for n, v in seed.items()], "graph_id int, qid int, node_id string, seed double"), ["graph_id"], 0.78, 16,
    ).collect()
    assert all(abs(r["rank"] - rank[r.node_id]) < 1e-12 for r in got) and len(got) == 4


def resolve_in_order(rows):
    """(graph, record) -> first record of its node, reading records one by one."""
    owner, node = {}, {}
    for g, rec, names in sorted(rows):
        keys = [" ".join(n.lower().split()) for n in names if n]
        if not names[0]:
            continue
        known = [owner[g, k] for k in keys if (g, k) in owner]
        node[g, rec] = known[0] if known else rec
        owner.update({(g, k): node[g, rec] for k in keys})
    return node


def test_resolution_in_order(spark, monkeypatch):
    monkeypatch.setattr(G, "RECORD_SPAN", 16)
    rng = random.Random(11)
    rows = [("a", i, [f"x{i}", f"x{i + 1}"]) for i in range(40)]  # a chain that the order-free form also joins
    # r2 knows both names and follows its own; its alias stands for that node from then on
    rows += [("b", 0, ["p"]), ("b", 1, ["q"]), ("b", 2, ["p", "q"]), ("b", 3, ["q"]), ("b", 4, ["", "p"]), ("b", 5, ["z", "q", "p"]), ("b", 6, ["Z"])]
    rows += [("c", i, [f"n{rng.randrange(40)}" for _ in range(rng.randint(1, 3))]) for i in range(150)]
    rows += [("d", i, ["same"]) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, rec long, names array<string>").repartition(5)
    got = {(r.g, r.rec): r.label for r in G.resolved_entities(df, ["g"], "rec", mode="first").collect()}
    want = resolve_in_order(rows)
    assert got == want and got["b", 3] == 0 and got["b", 1] == 1 and ("b", 4) not in got
    linked = {(r.g, r.rec): r.label for r in G.resolved_entities(df, ["g"], "rec").collect()}
    assert linked["b", 1] == 0 and len({v for (g, _), v in got.items() if g == "c"}) > len({v for (g, _), v in linked.items() if g == "c"})
    assert G.resolved_entities(df.limit(0), ["g"], "rec", mode="first").count() == 0


def test_hops_and_induced_edges_around_hubs(spark):
    """A hub's edges do not meet every question that holds it; the rows are those of plain loops."""
    rng = random.Random(9)
    rows = [(0, f"e{i}", f"n{rng.randint(0, 3)}", f"n{rng.randint(0, 150)}", rng.randint(0, 6) / 6) for i in range(500)]
    e = spark.createDataFrame(rows, "graph_id int, edge_id string, src string, dst string, confidence double")
    asks = {q: {f"n{rng.randint(0, 150)}" for _ in range(4)} | {"n0"} for q in range(12)}
    first = spark.createDataFrame([(0, q, n, 1, 1.0) for q, ns in asks.items() for n in ns], "graph_id int, qid int, node_id string, rank int, score double")
    links = R.best_links(e, F.col("confidence"), 11)
    assert links.groupBy("node_id").count().agg(F.max("count")).first()[0] == 11
    want = set()
    for q, ns in asks.items():
        seen, front = {n: 1 for n in ns}, ns
        for hop, k in ((2, 3), (3, 4)):
            near = {}
            for _, _, a, b, w in rows:
                for x, y in ((a, b), (b, a)):
                    if x in front and y not in seen:
                        near[y] = max(near.get(y, 0), w)
            front = {n for n, _ in sorted(near.items(), key=lambda p: (-p[1], p[0]))[:k]}
            seen |= {n: hop for n in front}
        want |= {(q, n, h) for n, h in seen.items()}
    hops = cut_lineage(R.k_hop(first, e, [3, 4]))
    assert {(r.qid, r.node_id, r.hop) for r in hops.collect()} == want
    got = [(r.qid, r.edge_id, r.src, r.dst) for r in R.induced(hops, e).collect()]
    held = {q: {n for p, n, _ in want if p == q} for q in asks}
    assert sorted(got) == sorted((q, i, a, b) for q in asks for _, i, a, b, _ in rows if a in held[q] and b in held[q])


def test_found_nodes_equal_brute_force(spark):
    rng = random.Random(9)
    name = lambda: " ".join(rng.choice(["Old", "old", "ring", "ringlet", "bolt", "5", "55"]) for _ in range(rng.randint(1, 3)))
    nodes = [(1, f"n{rng.randint(0, 70)}", name()) for _ in range(120)]  # a node may have several names
    asks = [(1, name()) for _ in range(60)]
    got = G.find_nodes(spark.createDataFrame(asks, "graph_id int, lookup string"), spark.createDataFrame(nodes, "graph_id int, node_id string, name string"), 3)
    want = set()
    for _, ask in set(asks):
        tiers = {}
        for _, node, held in nodes:
            a, b = ask.lower(), held.lower()
            if a in b or b in a:
                tiers[node] = min(tiers.get(node, 1), int(a != b))
        want |= {(1, ask, node, tier, i + 1) for i, (tier, node) in enumerate(sorted((t, n) for n, t in tiers.items())[:3])}
    assert {tuple(r) for r in got.collect()} == want


def test_mentions_of_shared_names_are_not_shuffled_again(spark):
    nodes = spark.createDataFrame([(1, f"n{i}", f"Big Ring {i}", "Brand#7") for i in range(6)] + [(1, "n9", "--", "(Brand#7)")], "graph_id int, node_id string, name string, alias string")
    texts = spark.createDataFrame([(1, 1, "the big ring 2 of brand#7"), (1, 1, "big ring 3"), (1, 2, "a (brand#7) -- lock"), (1, 3, "brand#77")], "graph_id int, qid long, text string")
    found = G.name_mentions(nodes, texts)
    every = [f"n{i}" for i in range(6)]
    assert sorted((r.qid, r.node_id) for r in found.collect()) == sorted([(1, n) for n in every] + [(2, n) for n in every + ["n9"]])
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Join" in plan[1] and "Aggregate" not in plan[0]  # nothing gathers the rows that the last join makes


def joined_after(plan, word):
    """Whether ``word`` stands only below the plan's first join."""
    lines = plan.split("\n")
    join = min(i for i, line in enumerate(lines) if "Join " in line)
    return any(word in line for line in lines[join + 1 :]) and not any(word in line for line in lines[: join + 1])


def test_names_are_cleaned_once(spark):
    """A name is cleaned in one place of the plan, and a name that many relations hold once before its ends are compared."""
    nodes = spark.createDataFrame([(1, "n1", "The  Old--Man", "x"), (1, "n2", "Bob", "")], "graph_id int, node_id string, name string, alias string")
    index = G.name_index(nodes)
    assert {(r.key, r.node_id) for r in index.collect()} == {("old man", "n1"), ("x", "n1"), ("bob", "n2")}
    assert index._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    rel = spark.createDataFrame([(1, "old man", "nobody")] * 50, "graph_id int, source string, target string")
    out = G.referenced_nodes(nodes, rel)
    assert [r.node_id for r in out.collect()] == ["n1"]
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    cleaned = [i for i, line in enumerate(lines) if "regexp_extract_all" in line]
    assert len(cleaned) == 2 and any("Aggregate" in line and "raw" in line for line in lines[cleaned[1] :])


def test_canonical_name_keeps_words(spark):
    cases = {"The  Old--Man ": "old man", "the": "the", " the the": "the", "--": "", "一龥 The A": "一龥 the a", "théa": "th a", "\u00a0The\u2003x": "x"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", G.canonical_name("raw").alias("key")).collect()
    assert {r.raw: r.key for r in rows} == cases


def test_core_reads_edges_and_writes_them_once(spark, monkeypatch):
    """A chain peels one node a round; edges are written once, and anew only beyond the number of nodes sent to tasks."""
    chain = [(1, "a", "b"), (1, "b", "c"), (1, "a", "c")] + [(1, f"x{i}", f"x{i + 1}") for i in range(6)] + [(1, "a", "x0"), (2, "p", "q"), (None, "a", "b")]
    pairs = spark.createDataFrame(chain, "graph_id int, a string, b string")
    keep, seen = I.cut_lineage, []
    monkeypatch.setattr(I, "cut_lineage", lambda df: seen.append(df.columns) or keep(df))
    want = {(1, "a", "b"), (1, "b", "c"), (1, "a", "c")}
    assert {tuple(r) for r in I.k_core(pairs, ["graph_id"]).collect()} == want
    assert seen.count(["graph_id", "a", "b"]) == 1
    seen.clear()
    monkeypatch.setattr(I, "PEELED", 1)
    assert {tuple(r) for r in I.k_core(pairs, ["graph_id"]).collect()} == want
    assert seen.count(["graph_id", "a", "b"]) > 2


def test_only_pronoun_edges_look_up_their_ends(spark):
    nodes = spark.createDataFrame([(1, "n1", "Alice"), (1, "n2", "the woman")], "graph_id int, node_id string, name string")
    e = edges(spark, [("n2", "n1", "motive", "a key", 0.9, False, 3), ("n1", "n2", "motive", "she saw", 0.9, False, 3), ("n2", "n1", "motive", None, 0.9, False, 3)])
    ante = spark.createDataFrame([(1, 3, "alice")], "graph_id int, seq long, name string")
    out = G.reattached_edges(e.withColumn("seq", F.col("importance").cast("long")), nodes, ante)
    assert {r.edge_id: (r.src, r.dst, r.moved) for r in out.collect()} == {"e0": ("n2", "n1", None), "e1": ("n1", "n1", True), "e2": ("n2", "n1", None)}
    assert joined_after(out.drop("evidence")._jdf.queryExecution().optimizedPlan().toString(), "RLIKE")


def test_waves_send_no_tables_to_the_driver(spark, monkeypatch):
    """However small the tables of a wave are, none is broadcast; the plan equals the fold in order."""
    keep, plans = G.cut_lineage, []
    monkeypatch.setattr(G, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    names = ["Mr. Ash", "Ash", "Dr. Ash", "Mr. Birch", "Birch", "Lady Birch"]
    nodes = spark.createDataFrame([(1, f"n{i}", n, 10 - i) for i, n in enumerate(names)], "graph_id int, node_id string, name string, degree long")
    groups = [(1, 1, ["Mr. Ash", "Ash"]), (1, 2, ["Ash", "Dr. Ash"]), (1, 3, ["Mr. Birch", "Birch"]), (1, 4, ["Birch", "Lady Birch", "Ash"])]
    out = G.consolidation_plan(spark.createDataFrame(groups, "graph_id int, group_no long, members array<string>"), nodes).collect()
    assert {(r.group_no, r.node_id, r.canonical) for r in out} == {(1, "n1", "n0"), (3, "n4", "n3")}
    waves = [p for p in plans if "waits" in p or "earlier" in p]
    assert waves and not any("Broadcast" in p for p in waves)


def test_top_valid_edges_look_up_few_ends(spark, monkeypatch):
    """The first valid edges per graph, also where most edges dangle; where none do, only twice as many look up their ends."""
    from evigraph.operators import graph as G

    looked = []
    keep = G.valid_edges
    monkeypatch.setattr(G, "valid_edges", lambda e, n: looked.append(e.count()) or keep(e, n))
    nodes = spark.createDataFrame([(g, f"n{i}") for g in (1, 2, 3) for i in range(5)], "graph_id int, node_id string")
    rows = [(g, f"e{i:04d}", f"n{i % 5}", f"n{i % 7 if g == 1 else i % 5}" if g < 3 or i > 300 else "gone", (i % 10) / 10 if i % 10 and g < 3 else None) for g in (1, 2, 3) for i in range(400 if g != 2 else 3)]
    edges = spark.createDataFrame(rows, "graph_id int, edge_id string, src string, dst string, confidence double")
    for k in (1, 4, 30):
        got = G.top_valid_edges(edges, nodes, "confidence", k).collect()
        valid = [r for r in rows if r[3] in {f"n{i}" for i in range(5)}]
        want = []
        for g in (1, 2, 3):
            mine = sorted((r for r in valid if r[0] == g), key=lambda r: (r[4] is None, -(r[4] or 0), r[1]))[:k]
            want += [(r[0], r[1], i + 1) for i, r in enumerate(mine)]
        assert sorted((r.graph_id, r.edge_id, r["rank"]) for r in got) == sorted(want)
    looked.clear()
    assert G.top_valid_edges(edges.filter("graph_id = 1 and dst not in ('n5', 'n6')"), nodes, "confidence", 4).count() == 4 and looked == [8]


def test_dedup_without_texts_moves_them_once(spark):
    """Evidence that is only compared is not returned; a row that is only counted is its own key; what orders travels once."""
    from evigraph.common import first_per_key
    from evigraph.operators import graph as G

    rows = [(1, "e2", "a", "b", "t", " The  Key "), (1, "e1", "a", "b", "t", "the key"), (1, "e3", "a", "b", "t", None), (1, "e4", "a", None, "t", "x"), (1, None, "a", None, "t", "x")]
    edges = spark.createDataFrame(rows, "graph_id int, edge_id string, src string, dst string, type string, evidence string")
    full = G.deduped_edges(edges, ["edge_id"])
    slim = G.deduped_edges(edges, ["edge_id"], texts=False)
    pick = lambda df: sorted((str(r.dst), str(r.edge_id)) for r in df.collect())
    assert pick(full) == pick(slim) == [("None", "None"), ("b", "e1"), ("b", "e3")] and "evidence" not in slim.columns
    assert G.deduped_edges(edges.drop("edge_id"), ["evidence"], texts=False).count() == 3
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" in plan(full) and "min_by" not in plan(slim)
    two = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, None, "z"), (2, 1, "y")], "k int, x int, y string")
    assert sorted(first_per_key(two, ["k"], ["x", "y"]).collect()) == [(1, 5, "a"), (2, None, "z")]
