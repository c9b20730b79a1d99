"""The url model that grows with the pages, against the smoothed model written out in Python."""

import math
import zlib
from collections import defaultdict

import pytest

from evigraph.llm import url_filter


def reference(texts, order):
    """Log-probability differences of whole texts from (text, verdict or None) rows; only labelled ones are counted."""
    grams, symbols = {k: defaultdict(lambda: defaultdict(int)) for k in ("allow", "block")}, set()
    for text, verdict in texts:
        chars = ["start", *text, "end"]
        symbols |= set(chars[1:])
        for i in range(1, len(chars)):
            for n in range(min(order, i) + 1):
                if verdict:
                    grams[verdict][tuple(chars[i - n : i])][chars[i]] += 1

    def p(kind, ctx, c):
        seen = grams[kind].get(ctx, {})
        if not ctx:
            return (seen.get(c, 0) + 1) / (sum(seen.values()) + len(symbols))
        q = p(kind, ctx[1:], c)
        return (seen.get(c, 0) + len(seen) * q) / (sum(seen.values()) + len(seen)) if seen else q

    def score(text):
        chars = ["start", *text, "end"]
        pairs = [(tuple(chars[max(0, i - order) : i]), chars[i]) for i in range(1, len(chars))]
        return sum(math.log(p("allow", *x)) - math.log(p("block", *x)) for x in pairs) / len(pairs)

    return score


def test_long_model_counts_real_characters(spark):
    urls = [None, "", "http://", "https://пример.org/漢字", "https://пример.org/漢子", "https://a.org/v1", "https://a.org/v2", "https://a.org/V2", "https://b.example.com/en/👩‍👩‍👧", "https://a.net/es/$^\x01"]
    urls += [f"https://h{i % 7}.example.{'com' if i % 2 else 'net'}/{'de' if i % 2 else 'es'}/{i % 90}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, text string, size int").repartition(3)
    got = {r["page_id"]: r for r in url_filter.judge_long(pages).collect()}
    old = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, r in got.items():  # what the rules decide stays
        assert (r["host"], r["path"], r["rule"]) == (old[i]["host"], old[i]["path"], old[i]["rule"])
        assert r["verdict"] == old[i]["verdict"] if r["rule"] else r["verdict"] == ("allow" if r["score"] >= r["threshold"] else "block")
    texts = []
    for i, u in enumerate(urls):
        text = got[i]["host"] + got[i]["path"]
        trains = got[i]["rule"] and zlib.crc32(u.encode()) % url_filter.FOLDS
        texts.append((text, got[i]["verdict"] if trains else None))
    score = reference([t for t in texts if t[0]], url_filter.ORDER)
    for i in range(30):
        assert got[i]["score"] == pytest.approx(score(texts[i][0]) if texts[i][0] else 0, abs=1e-8)
    # Digits, case and signs that the folded model takes for one another now tell urls apart.
    assert old[5]["score"] == old[6]["score"] == old[7]["score"] and old[3]["score"] == old[4]["score"]
    longer = spark.createDataFrame([(1, "https://a.net/es/v1v2v1"), (2, "https://a.com/v2v2v2"), (3, "https://q.org/v1"), (4, "https://q.org/v2")] + [(9, f"https://a.net/es/{i}v1") for i in range(20)] + [(9, f"https://a.com/{i}v2") for i in range(20)], "page_id long, url string")
    s = {r["page_id"]: r["score"] for r in url_filter.judge_long(longer).collect()}
    assert s[3] < s[4]
    f = {r["page_id"]: r["score"] for r in url_filter.judge(longer).collect()}
    assert f[3] == f[4]


def test_long_model_grows_with_the_pages(spark):
    def rows(n):
        texts = spark.createDataFrame([(f"h.org/{chr(0x4E00 + i)}{i}", 1, 0) for i in range(n)], "text string, allow long, block long")
        return url_filter.grams(texts, url_filter.ORDER).count()

    assert rows(400) > 3 * rows(100)


def test_long_model_without_labels(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x"), (None, None)], "page_id long, url string")
    assert {(r["page_id"], r["verdict"], r["score"]) for r in url_filter.judge_long(pages).collect()} == {(1, "allow", 0.0), (None, "allow", 0.0)}
    assert url_filter.judge_long(pages.limit(0)).count() == 0


def test_long_model_sends_no_table_through_the_driver(spark, monkeypatch):
    """Tables that grow with the pages are small on disk, as they are packed; none of them is broadcast for that."""
    from evigraph.llm import url_filter as U

    seen = []
    keep = U.cut_lineage
    monkeypatch.setattr(U, "cut_lineage", lambda df: seen.append(df) or keep(df))
    pages = spark.createDataFrame([(i, f"http://x{i % 7}.{'com' if i % 2 else 'net'}/es/{i}") for i in range(60)], "page_id long, url string")
    seen.append(U.judge_long(pages))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert len(plans) > 5 and sum(p.count("SortMergeJoin") for p in plans) >= U.ORDER + 3
    assert not any("BroadcastHashJoin" in p for p in plans)
