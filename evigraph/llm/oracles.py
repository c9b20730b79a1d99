"""DuckDB SQL of the operators whose whole result SQL can state, by brute force."""

from __future__ import annotations

from .url_filter import DEFAULT_RULES, FOLDS, LOWER, ORDER, STEPS, TOP, UNITS, UPPER


def components_sql(links: str, nodes: str, node: str) -> str:
    """CTEs: smallest node reachable over ``links`` (a, b), both ways; ``nodes`` has the column ``node``."""
    return f"""both_ways AS MATERIALIZED (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
      walk AS (SELECT {node} AS origin, {node} AS place FROM {nodes} UNION SELECT w.origin, l.b FROM walk w JOIN both_ways l ON l.a = w.place),
      reach AS (SELECT origin AS {node}, min(place) AS component_id FROM walk GROUP BY 1)"""


NEAR_VECTORS = f"""WITH RECURSIVE ok AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
      links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
        WHERE list_dot_product(p.v, q.v) >= 0.9e0 * sqrt(list_dot_product(p.v, p.v) * list_dot_product(q.v, q.v))),
      {components_sql('links', 'embeddings', 'vec_id')}
    SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN reach USING (vec_id)
      LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) c USING (vec_id)"""

JACCARD = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
      s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0) x),
      size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      links AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.shingle = q.shingle AND p.doc_id < q.doc_id GROUP BY ALL) x
        JOIN size m ON m.doc_id = a JOIN size n ON n.doc_id = b WHERE 100 * c >= 90 * (m.n + n.n - c)),
      {components_sql('links', 'documents', 'doc_id')}
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN reach USING (doc_id) LEFT JOIN size USING (doc_id)"""

SUFFIX_DEDUP = """WITH raw AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      win AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, p * 2 + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM raw) x),
      again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS rn FROM win) x WHERE rn > 1),
      runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM again) x) y GROUP BY doc_id, g),
      kept AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM runs
        UNION ALL SELECT r.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM raw r LEFT JOIN runs USING (doc_id) GROUP BY r.doc_id),
      text AS (SELECT doc_id, coalesce(string_agg(substr(h, x * 2 + 1, (y - x) * 2), '' ORDER BY x, y), '') AS k FROM kept JOIN raw USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, (length(h) - length(k)) // 2 AS n_removed, (SELECT count(*) FROM runs z WHERE z.doc_id = r.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
    FROM raw r JOIN text USING (doc_id)"""


WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
      d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS code FROM p),
      c AS (SELECT page_id, payload_bytes, translate(concat(BASE32), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
      l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM c)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM l""".replace(
    "BASE32", ", ".join(f"lpad(to_base(('0x' || substr(code, {10 * i + 1}, 10))::BIGINT, 32), 8, '0')" for i in range(4))
)

_SHARE = "1 + (1000000000::HUGEINT * ({} + 5)) // {}".format
DIVERGENCE = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
      words AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
      kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
      n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
      v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
      grp AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce(c, 0) + 5 * coalesce(v, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN v USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS c FROM n GROUP BY ALL) s USING (lang, source)),
      lg AS (SELECT lang, (sum(total - 5 * v) + 5 * max(v))::BIGINT AS total FROM grp GROUP BY 1),
      p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, {_SHARE('coalesce(n.n, 0)', 'g.total')} AS p FROM grp g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
      q AS (SELECT a.lang, a.term, {_SHARE('a.n', 'l.total')} AS q FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM n GROUP BY ALL) a JOIN lg l USING (lang)),
      pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
          ON z.lang = a.lang AND z.s = a.source AND z.t = b.source),
      term AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
    SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term) u) r WHERE part = 'pair' OR rank <= 50"""


def clusters_sql(rounds: int = 10, k: int = 8) -> str:
    """Lloyd's rounds over whole numbers, each round as two relations of its own."""
    places = range(1, 65)
    apart = " + ".join(f"(v.q[{i}] - c.q[{i}]) * (v.q[{i}] - c.q[{i}])" for i in places)
    mean = ", ".join(f"((sum(v.q[{i}]) - ((sum(v.q[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT" for i in places)

    def near(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT row, arg_min(c.n, ({apart}, c.n)) AS cluster, min({apart}) AS distance FROM v CROSS JOIN c{r} c GROUP BY row)"""

    steps = [near(0)]
    for r in range(1, rounds + 1):
        steps.append(f"""c{r} AS MATERIALIZED (SELECT c.n, coalesce(m.q, c.q) AS q FROM c{r - 1} c LEFT JOIN (SELECT cluster AS n, [{mean}] AS q FROM v JOIN a{r - 1} USING (row) GROUP BY 1) m USING (n))""")
        steps.append(near(r))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024.0e0 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE len(embedding) = 64 AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS n, q FROM v ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q LIMIT {k}),
      {', '.join(steps)},
      s AS (SELECT cluster, sum(distance)::BIGINT AS t FROM a{rounds} GROUP BY 1)
    SELECT vec_id, a.cluster::INT AS cluster, distance::BIGINT AS distance, s.t AS cluster_inertia, (SELECT sum(t)::BIGINT FROM s) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM v JOIN a{rounds} a USING (row) JOIN s USING (cluster) JOIN c{rounds} c ON c.n = a.cluster"""


def url_filter_sql() -> str:
    """Rules, both Markov models over real characters, the calibrated threshold and the verdicts. Grams as in ``url_filter.grams``."""
    fits = []
    for verdict, rule in sorted(DEFAULT_RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{verdict} {rule}'")
    kinds = ("allow", "block")
    count = ", ".join(f"sum({k})::DOUBLE AS {k}" for k in kinds)
    totals = ", ".join(f"sum({k}) OVER w AS {k}_n, (count(*) FILTER ({k} > 0) OVER w)::DOUBLE AS {k}_t" for k in kinds)
    first = ", ".join(f"({k} + 1.0e0) / ({k}_n + symbols) AS p_{k}" for k in kinds)
    mixed = ", ".join(f"CASE WHEN {k}_n > 0 THEN ({k} + {k}_t * q.p_{k}) / ({k}_n + {k}_t) ELSE q.p_{k} END AS p_{k}" for k in kinds)
    levels = [f"l0 AS MATERIALIZED (SELECT size, ctx, next, {first} FROM wide WHERE size = 0)"]
    for n in range(1, ORDER + 1):
        levels.append(f"l{n} AS MATERIALIZED (SELECT w.size, w.ctx, w.next, {mixed} FROM wide w JOIN l{n - 1} q ON right(w.ctx, {n - 1}) = q.ctx AND w.next = q.next WHERE w.size = {n})")
    labels = ", ".join(f"count(*) FILTER (verdict = '{k}' AND {'' if held else 'NOT '}held) AS {name}" for k, held, name in (("allow", False, "allow"), ("block", False, "block"), ("allow", True, "x"), ("block", True, "y")))
    return f"""WITH parsed AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
      hosted AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parsed),
      ruled AS MATERIALIZED (SELECT *, host || path AS text, CASE {' '.join(fits)} END AS fit FROM hosted),
      texts AS MATERIALIZED (SELECT text, {labels} FROM (SELECT text, split_part(fit, ' ', 1) AS verdict, {crc32_sql('url')} % {FOLDS} = 0 AS held FROM ruled WHERE text <> '') r GROUP BY text),
      places AS MATERIALIZED (SELECT text, allow, block, i, least({ORDER}, i + 1) AS size, substr(text, greatest(i - {ORDER}, 0) + 1, i - greatest(i - {ORDER}, 0)) AS ctx, substr(text, i + 1, 1) AS next
        FROM (SELECT *, unnest(range(0, length(text) + 1)) AS i FROM texts) x),
      grams AS (SELECT n AS size, right(ctx, n) AS ctx, next, {count} FROM (SELECT *, unnest(range(0, size + 1)) AS n FROM places) x GROUP BY ALL),
      wide AS MATERIALIZED (SELECT *, {totals}, count(*) OVER w AS symbols FROM grams WINDOW w AS (PARTITION BY size, ctx)),
      {', '.join(levels)},
      model AS MATERIALIZED (SELECT size, ctx, next, round((ln(p_allow) - ln(p_block)) * {UNITS})::BIGINT AS d FROM ({' UNION ALL '.join(f'SELECT * FROM l{n}' for n in range(ORDER + 1))}) u),
      known AS (SELECT (coalesce(sum(allow), 0) > 0 AND coalesce(sum(block), 0) > 0)::INT AS yes FROM texts),
      scored AS MATERIALIZED (SELECT text, sum(d)::BIGINT * any_value(yes) / {UNITS}.0e0 / count(*) AS score FROM places JOIN model USING (size, ctx, next) CROSS JOIN known GROUP BY text),
      bins AS MATERIALIZED (SELECT floor(least(greatest(score, -{TOP}), {TOP}) * {STEPS})::INT AS step, sum(x) AS x, sum(y) AS y FROM scored JOIN texts USING (text) WHERE x + y > 0 GROUP BY 1),
      cuts AS (SELECT c.step / {STEPS}.0e0 AS edge, (SELECT sum(x) FILTER (b.step >= c.step) / sum(x) + coalesce(sum(y) FILTER (b.step < c.step), 0) / sum(y) FROM bins b) AS good FROM bins c),
      cut AS (SELECT coalesce(arg_min(edge, (-round(good, 9), abs(edge), edge)), 0.0) AS threshold FROM cuts WHERE good IS NOT NULL)
    SELECT page_id, host, path, nullif(split_part(fit, ' ', 2), '') AS rule, coalesce(nullif(split_part(fit, ' ', 1), ''), CASE WHEN coalesce(score, 0) >= threshold THEN 'allow' ELSE 'block' END) AS verdict,
      round(coalesce(score, 0), 6) AS score, threshold FROM ruled LEFT JOIN scored USING (text) CROSS JOIN cut"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a UTF-8 text, byte by byte; DuckDB has no function of that name."""
    byte = lambda e: f"(('0x' || {e})::UBIGINT)"
    step = "xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    one = "list_reduce(list_concat([xor(acc, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda acc, z: " + step + ")"
    listed = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: {byte(f'substr(hex(encode({text})), i * 2 + 1, 2)')})"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {listed}), lambda acc, b: {one}), 4294967295::UBIGINT)"
