"""The registered queries as plain SQL over the same tables.

Written apart from the operators: sessions by lag and running sum, ranks by
ordering the full cross product, vector means in long form.
"""

from __future__ import annotations

ORDER = "sec, is_click, event_id"
DAY_START = "epoch(TIMESTAMP '2024-01-24')::BIGINT"

ACTIONS = """
raw AS (
  SELECT *, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS clicked
  FROM events),
actions AS (
  SELECT user_id AS guid, (epoch_us(ts) // 1000000)::BIGINT AS sec, event_id, clicked::INTEGER AS is_click,
         CASE WHEN clicked = 1 THEN 'm' || (k % 20) ELSE 'p' || (k % 50) END AS domain,
         CASE WHEN event_id % 13 = 0 THEN []::VARCHAR[]
              ELSE [k::VARCHAR, (CASE WHEN k % 10 = 0 THEN 100000 + k ELSE 7 * k + 3 END)::VARCHAR] END AS keywords,
         year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day
  FROM raw),
merchants AS (SELECT DISTINCT domain FROM actions WHERE is_click = 1)
"""

DWELL = f"""
ahead AS (SELECT *, lead(sec) OVER (PARTITION BY guid ORDER BY {ORDER}) - sec AS step FROM actions),
dwelt AS (SELECT *, coalesce(step, avg(step) OVER (PARTITION BY guid))::DOUBLE AS dwell FROM ahead)
"""


def cut(gap: int) -> str:
    return f"""
marked AS (
  SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY guid ORDER BY {ORDER}) > {gap} THEN 1 ELSE 0 END AS fresh
  FROM dwelt),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY guid ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no
  FROM marked),
cut AS (SELECT *, count(*) OVER (PARTITION BY guid, session_no) AS n_events FROM numbered),
bounded AS (
  SELECT *, (row_number() OVER (PARTITION BY guid, session_no ORDER BY {ORDER}) - 1)::INTEGER AS pos
  FROM cut WHERE n_events BETWEEN 3 AND 20)
"""


MODEL = """
model AS (
  SELECT * FROM bounded WHERE (guid, session_no) IN (
    SELECT (guid, session_no) FROM bounded GROUP BY guid, session_no HAVING count(DISTINCT domain) >= 2)),
flat AS (
  SELECT guid, session_no, domain, sec, is_click,
         (row_number() OVER (PARTITION BY guid, session_no ORDER BY pos) - 1)::INTEGER AS pos
  FROM (SELECT *, lag(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) AS earlier FROM model)
  WHERE earlier IS DISTINCT FROM domain)
"""

RUNS = """
tagged AS (
  SELECT *, sum(fresh_run) OVER (PARTITION BY guid, session_no ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no
  FROM (SELECT *, CASE WHEN lag(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) <> domain
                       THEN 1 ELSE 0 END AS fresh_run,
               lead(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) <> domain AS ends_run,
               lead(day) OVER (PARTITION BY guid, session_no ORDER BY pos) AS next_day
        FROM model)),
runs AS (
  SELECT guid, session_no, run_no, any_value(domain) AS domain, flatten(list(keywords ORDER BY pos)) AS keywords,
         CASE WHEN min(dwell) > 0 THEN
           round_even(round(avg(CASE WHEN dwell > 0 THEN log2(dwell) END), 9), 0)::INTEGER END AS dwell_bucket,
         arg_max((sec // 3600) % 24, pos)::INTEGER AS hour, arg_max(day, pos)::INTEGER AS day,
         arg_max(CASE WHEN ends_run THEN next_day ELSE day END, pos)::INTEGER AS boundary_day,
         max(is_click)::INTEGER AS is_merchant
  FROM tagged GROUP BY guid, session_no, run_no),
slots AS (
  SELECT *, CASE WHEN dwell_bucket IS NULL OR dwell_bucket >= 20 OR dwell_bucket < -20 THEN 0
                 WHEN dwell_bucket < 0 THEN dwell_bucket + 20 ELSE dwell_bucket END AS dwell_slot,
         CASE WHEN day >= 31 THEN 0 ELSE day END AS day_slot
  FROM runs)
"""

WORDS = """
kv AS (
  SELECT vec_id::VARCHAR AS word, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim
  FROM embeddings),
dims AS (SELECT DISTINCT dim FROM kv)
"""

DOMAIN_WORDS = """
dw AS (
  SELECT DISTINCT domain, unnest(CASE WHEN len(keywords) = 0 THEN [''] ELSE keywords END) AS word FROM runs),
dmean AS (
  SELECT d.domain, dims.dim, coalesce(m.v, 0) AS v
  FROM (SELECT DISTINCT domain FROM dw) d CROSS JOIN dims
  LEFT JOIN (SELECT domain, dim, avg(v) AS v FROM dw JOIN kv USING (word) GROUP BY domain, dim) m
    ON m.domain = d.domain AND m.dim = dims.dim),
rmean AS (
  SELECT r.guid, r.session_no, r.run_no, r.domain, dims.dim, coalesce(o.v, d.v) AS v
  FROM runs r CROSS JOIN dims
  LEFT JOIN (
    SELECT guid, session_no, run_no, dim, avg(v) AS v
    FROM (SELECT guid, session_no, run_no, unnest(keywords) AS word FROM runs) w JOIN kv USING (word)
    GROUP BY guid, session_no, run_no, dim) o
    ON o.guid = r.guid AND o.session_no = r.session_no AND o.run_no = r.run_no AND o.dim = dims.dim
  JOIN dmean d ON d.domain = r.domain AND d.dim = dims.dim)
"""

VECTORS = """
dv AS (
  SELECT CASE WHEN vec_id < 20 THEN 'm' || vec_id ELSE 'p' || (vec_id - 20) END AS domain,
         unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim
  FROM embeddings WHERE (CASE WHEN vec_id < 20 THEN vec_id ELSE vec_id - 20 END) % 7 <> 0),
prior AS (SELECT dim, avg(v) AS v FROM dv WHERE domain IN (SELECT domain FROM merchants) GROUP BY dim)
"""

SPLIT = f"""
dated AS (SELECT *, min(sec) OVER (PARTITION BY guid, session_no) AS start FROM flat),
train AS (SELECT * FROM dated WHERE start < {DAY_START}),
test AS (
  SELECT * FROM dated WHERE start >= {DAY_START} AND domain IN (SELECT domain FROM train)),
vocab AS (
  SELECT domain, is_merchant, row_number() OVER (ORDER BY is_merchant DESC, domain) - 1 AS idx
  FROM (SELECT DISTINCT domain, (CASE WHEN domain IN (SELECT domain FROM merchants) THEN 1 ELSE 0 END)::INTEGER
               AS is_merchant FROM train)),
seen AS (
  SELECT *, (CASE WHEN row_number() OVER (PARTITION BY guid, session_no, domain ORDER BY pos) > 1
                  THEN 1 ELSE 0 END)::INTEGER AS seen_before FROM test),
steps AS (
  SELECT * FROM (SELECT *, lag(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) AS prev,
                        domain AS target, pos = max(pos) OVER (PARTITION BY guid, session_no) AS is_last FROM seen)
  WHERE prev IS NOT NULL)
"""

POPULAR = """
popular AS (
  SELECT domain AS candidate, n, n / (n + 1) AS score
  FROM (SELECT domain, count(*) AS n FROM train GROUP BY domain) ORDER BY n DESC, domain LIMIT 10)
"""

SESSION_POPULAR = """
visits AS (
  SELECT s.guid, s.session_no, s.pos, t.domain AS candidate, count(*) AS n
  FROM steps s JOIN test t ON t.guid = s.guid AND t.session_no = s.session_no AND t.pos < s.pos
  GROUP BY s.guid, s.session_no, s.pos, t.domain),
scored AS (
  SELECT guid, session_no, pos, candidate, round(sum(score), 9) AS score
  FROM (SELECT guid, session_no, pos, candidate, n::DOUBLE AS score FROM visits
        UNION ALL SELECT guid, session_no, pos, candidate, score FROM steps CROSS JOIN popular)
  GROUP BY guid, session_no, pos, candidate)
"""


def knn(rows: str, session: str, n_sims: int) -> str:
    return f"""
visit AS (SELECT {session}, domain, count(*) AS n FROM {rows} GROUP BY {session}, domain),
supp AS (SELECT domain, count(*) AS n FROM {rows} GROUP BY domain),
co AS (
  SELECT a.domain, b.domain AS other, sum(a.n)::BIGINT AS n
  FROM visit a JOIN visit b USING ({session}) WHERE a.domain <> b.domain GROUP BY a.domain, b.domain),
sims AS (
  SELECT domain, other, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sim DESC, other) AS place FROM (
      SELECT co.domain, co.other, co.n / (sqrt(i.n + 20.0) * sqrt(j.n + 20.0)) AS sim
      FROM co JOIN supp i ON i.domain = co.domain JOIN supp j ON j.domain = co.other))
  WHERE place <= {n_sims})
"""


KNN_SCORED = """
scored AS (
  SELECT guid, session_no, pos, other AS candidate, sim AS score FROM steps JOIN sims ON sims.domain = steps.prev)
"""

RANKED = """
dense AS (
  SELECT s.guid, s.session_no, s.pos, v.domain AS candidate, v.idx, coalesce(c.score, 0) AS score
  FROM steps s CROSS JOIN vocab v
  LEFT JOIN scored c ON c.guid = s.guid AND c.session_no = s.session_no AND c.pos = s.pos AND c.candidate = v.domain),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY guid, session_no, pos ORDER BY score DESC, idx) AS rank FROM dense),
ranks AS (
  SELECT s.*, p.rank FROM steps s
  LEFT JOIN placed p ON p.guid = s.guid AND p.session_no = s.session_no AND p.pos = s.pos AND p.candidate = s.target)
"""

MEAN_VECTORS = """
known AS (
  SELECT f.guid, f.session_no, f.pos, f.domain, p.dim, coalesce(d.v, p.v) AS v
  FROM {rows} f CROSS JOIN prior p LEFT JOIN dv d ON d.domain = f.domain AND d.dim = p.dim),
visited AS (
  SELECT guid, session_no, pos, domain, dim,
         avg(v) OVER (PARTITION BY guid, session_no, dim ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v
  FROM known)
"""

PURCHASES = """
purchases AS (
  SELECT o_custkey AS guid, l_partkey AS domain FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
counted AS (SELECT domain, count(*) AS n FROM purchases GROUP BY domain)
"""

BASKETS = """
baskets AS (
  SELECT l_orderkey AS session, l_suppkey AS domain FROM lineitem)
"""

# parts every session query shares
KEY = "guid, session_no, pos"
CUT = [ACTIONS, DWELL, cut(21600)]
FLAT = [*CUT, MODEL]
RUN_PARTS = [*FLAT, RUNS]
MEANS = [*RUN_PARTS, WORDS, DOMAIN_WORDS]
TESTED = [*FLAT, SPLIT]
BY_KNN = [*TESTED, knn("train", "guid, session_no", 100), KNN_SCORED]
BY_SESSION = [*TESTED, POPULAR, SESSION_POPULAR]

SHUFFLED = """
mixed AS (
  SELECT * EXCLUDE (pos), (row_number() OVER (PARTITION BY guid, session_no ORDER BY
         md5(concat_ws('|', '7', guid, session_no, pos)), pos) - 1)::INTEGER AS pos
  FROM {rows})
"""

BY_SHUFFLED = [*FLAT, SPLIT.replace("test AS (", "ordered AS (").replace(
    "seen AS (", SHUFFLED.format(rows="ordered").replace("mixed AS", "test AS").strip() + ",\nseen AS ("),
    POPULAR, SESSION_POPULAR, RANKED]

RANDOM = """
draws AS (
  SELECT guid, session_no, pos, target,
         ('0x' || substr(md5(concat_ws('|', '7', guid, session_no, pos)), 1, 15))::BIGINT % 2147483646 + 1 AS a FROM steps),
lots AS (
  SELECT domain, idx, ('0x' || substr(md5(concat_ws('|', '7', domain)), 1, 15))::BIGINT % 2147483646 + 1 AS b FROM vocab),
dense AS (
  SELECT guid, session_no, pos, target, domain AS candidate, idx, (a * b % 2147483647) / 2147483647.0 AS score
  FROM draws CROSS JOIN lots)
"""

VECTOR_SCORED = MEAN_VECTORS.format(rows="test") + """,
dense AS (
  SELECT q.guid, q.session_no, q.pos, v.domain AS candidate, v.idx, sum(q.v * d.v) AS score
  FROM visited q JOIN dv d ON d.dim = q.dim JOIN vocab v ON v.domain = d.domain
  WHERE (q.guid, q.session_no, q.pos) IN (
    SELECT (guid, session_no, pos) FROM (
      SELECT *, lead(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) AS following FROM test)
    WHERE following IS NOT NULL)
  GROUP BY q.guid, q.session_no, q.pos, v.domain, v.idx)
"""

FOLDED = f"""
y AS (
  SELECT domain, idx, max(v) FILTER (dim = 0) AS a, max(v) FILTER (dim = 1) AS b, max(v) FILTER (dim = 2) AS c
  FROM dv JOIN vocab USING (domain) GROUP BY domain, idx),
gram AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc FROM y),
visit AS (
  SELECT t.guid, t.session_no, t.pos, lead(t.domain) OVER w AS target, a, b, c,
         CASE WHEN row_number() OVER (PARTITION BY t.guid, t.session_no, t.domain ORDER BY t.pos) = 1 THEN 2 ELSE 1 END AS n
  FROM test t LEFT JOIN y USING (domain) WINDOW w AS (PARTITION BY t.guid, t.session_no ORDER BY t.pos)),
equations AS (
  SELECT guid, session_no, pos, target,
         {", ".join(f"gram.{p + q} + coalesce(sum({p}*{q}) OVER w, 0) + {0.1 if p == q else 0} AS {p + q}"
                    for p, q in ("aa", "ab", "ac", "bb", "bc", "cc"))},
         {", ".join(f"coalesce(sum(n*{p}) OVER w, 0) AS r{p}" for p in "abc")}
  FROM visit CROSS JOIN gram WINDOW w AS (PARTITION BY guid, session_no ORDER BY pos ROWS UNBOUNDED PRECEDING)),
solved AS (
  SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det,
         ra*(bb*cc - bc*bc) - ab*(rb*cc - bc*rc) + ac*(rb*bc - bb*rc) AS x,
         aa*(rb*cc - bc*rc) - ra*(ab*cc - bc*ac) + ac*(ab*rc - rb*ac) AS y2,
         aa*(bb*rc - rb*bc) - ab*(ab*rc - rb*ac) + ra*(ab*bc - bb*ac) AS z
  FROM equations WHERE target IS NOT NULL),
dense AS (
  SELECT guid, session_no, pos, target, domain AS candidate, idx, (x*a + y2*b + z*c) / det AS score
  FROM solved CROSS JOIN y)
"""
#: Steps whose target has a vector, with its score
VECTOR_OWN = f"""
own AS (
  SELECT d.guid, d.session_no, d.pos, d.score AS own FROM dense d JOIN (
    SELECT *, lead(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) AS target FROM test) t
  ON t.guid = d.guid AND t.session_no = d.session_no AND t.pos = d.pos AND t.target = d.candidate),
scores AS (
  SELECT *, max(score) OVER (PARTITION BY {KEY}) AS top, count(*) OVER (PARTITION BY {KEY}) AS size,
         row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC) AS place FROM dense JOIN own USING ({KEY}))
"""


def sql(parts: list[str], select: str) -> str:
    return f"WITH {', '.join(p.strip() for p in parts)}\n{select.strip()}" if parts else select.strip()


def metrics(source: str = "ranks", hit: str = "rank < 10", full: bool = False, by: str = "") -> str:
    gain = "1.0 / rank" if full else f"CASE WHEN {hit} THEN 1.0 / rank END"
    return f"""
SELECT {by + ',' if by else ''} count(*) AS n,
       round(count(*) FILTER ({hit}) / count(*), 6) AS recall,
       round((coalesce(sum({gain}), 0) / count(*))::DOUBLE, 6) AS mrr,
       round(count(*) FILTER ({hit} AND rank = 1) / count(*), 6) AS accuracy
FROM {source} {'GROUP BY ' + by if by else ''}"""


SCAN = "guid, sec, event_id, domain, array_to_string(keywords, ' ') AS keywords, year, month, day"
DIGEST = "round(sum(v), 6) AS plain_sum, round(sum(v * (dim + 1)), 6) AS weighted_sum"
HISTORIES = f"""
cookies AS (SELECT * REPLACE (concat_ws('-', guid, year, month, day) AS guid) FROM actions),
both_sides AS (SELECT guid FROM cookies GROUP BY guid HAVING min(is_click) = 0 AND max(is_click) = 1),
histories AS (
  SELECT *, row_number() OVER (PARTITION BY guid ORDER BY {ORDER}) - 1 AS pos
  FROM cookies WHERE guid IN (SELECT guid FROM both_sides))
"""
TOP_TEN = f"""
SELECT {KEY}, candidate, round(score, 6) AS score, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC, candidate) AS place FROM dense)
WHERE place <= 10"""



def feistel(seed: int, epoch: int, batch: int) -> str:
    """The network of epoch_batches, a step per recursion for places that are not among the n."""
    steps, left, right = [], "x // c", "x % c"
    for k in range(3):
        lot = "('0x' || substr(md5(concat_ws('|', {}, {}, {}, {})), 1, 15))::BIGINT"
        steps.append(f"(({left}) + {lot.format(seed, epoch, 2 * k, right)} % r) % r AS l{k}")
        left = f"l{k}"
        steps.append(f"(({right}) + {lot.format(seed, epoch, 2 * k + 1, left)} % c) % c AS r{k}")
        right = f"r{k}"
    return sql([], f"""
WITH RECURSIVE {", ".join(p.strip() for p in FLAT)},
numbers AS (SELECT dense_rank() OVER (ORDER BY guid, session_no) AS session_id FROM flat GROUP BY guid, session_no),
grid AS (SELECT n, r, (n + r - 1) // r AS c FROM (
  SELECT n, ceil(sqrt(n::DOUBLE))::BIGINT AS r FROM (SELECT count(*) AS n FROM numbers))),
walk AS (
  SELECT session_id, session_id - 1 AS x, false AS moved FROM numbers
  UNION ALL
  SELECT session_id, l2 * c + r2, true FROM (
    SELECT session_id, c, {", ".join(steps)} FROM walk CROSS JOIN grid WHERE NOT moved OR x >= n))
SELECT session_id, x AS place, x // {batch} AS batch_no FROM walk CROSS JOIN grid WHERE moved AND x < n""")


ORACLES: dict[str, str] = {
    "scan_impressions": sql([ACTIONS], f"SELECT {SCAN} FROM actions WHERE is_click = 0"),
    "scan_clicks": sql([ACTIONS], f"SELECT {SCAN} FROM actions WHERE is_click = 1"),
    "scan_week": sql([ACTIONS], f"SELECT {SCAN} FROM actions WHERE month = 1 AND day BETWEEN 8 AND 14"),
    "scan_partitioned_week": sql([ACTIONS], f"SELECT {SCAN} FROM actions WHERE month = 1 AND day BETWEEN 8 AND 14"),
    "keyword_counts": sql([ACTIONS], """
SELECT word, count(*) AS n FROM (SELECT unnest(keywords) AS word FROM actions) GROUP BY word"""),
    "keyword_full_join": sql([ACTIONS], """
SELECT word, sum(CASE WHEN is_click = 0 THEN 1 END)::BIGINT AS n_impressions,
       sum(CASE WHEN is_click = 1 THEN 1 END)::BIGINT AS n_clicks
FROM (SELECT unnest(keywords) AS word, is_click FROM actions) GROUP BY word"""),
    "keyword_vectors": sql([ACTIONS, WORDS], """
SELECT word, dim, round(v, 6) AS value FROM kv
WHERE word IN (SELECT unnest(keywords) FROM actions)"""),
    "publisher_list": sql([ACTIONS], "SELECT DISTINCT domain FROM actions WHERE is_click = 0"),
    "merchant_list": sql([ACTIONS], "SELECT domain FROM merchants"),
    "merchants_in_data": sql(FLAT, "SELECT domain FROM merchants INTERSECT SELECT domain FROM model"),
    "publishers_in_data": sql(FLAT, "SELECT domain FROM model EXCEPT SELECT domain FROM merchants"),
    "vocab_index": sql(FLAT, """
SELECT domain, is_merchant, row_number() OVER (ORDER BY is_merchant DESC, domain) - 1 AS idx
FROM (SELECT DISTINCT domain, (CASE WHEN domain IN (SELECT domain FROM merchants) THEN 1 ELSE 0 END)::INTEGER
             AS is_merchant FROM model)"""),
    "user_histories": sql([ACTIONS, HISTORIES], "SELECT guid, pos, sec, is_click, event_id, domain FROM histories"),
    "user_histories_nested": sql([ACTIONS, HISTORIES], """
SELECT guid, pos // 10000 AS part, count(*)::INTEGER AS n_events, arg_min(domain, pos) AS first_domain,
       arg_max(domain, pos) AS last_domain FROM histories GROUP BY guid, part"""),
    "histories_roundtrip": sql([ACTIONS, HISTORIES.replace(
        "SELECT * REPLACE (concat_ws('-', guid, year, month, day) AS guid) FROM actions", "SELECT * FROM actions")], """
SELECT guid, pos // 10 AS part, pos, sec, event_id, domain, array_to_string(keywords, ' ') AS keywords, day
FROM histories"""),
    "domain_counts": sql([PURCHASES], "SELECT domain, n FROM counted"),
    "frequent_domains": sql([PURCHASES], "SELECT domain, n FROM counted WHERE n > 18"),
    "users_without_rare_domains": sql([PURCHASES], """
SELECT guid, count(*) AS n FROM purchases
WHERE guid NOT IN (SELECT guid FROM purchases JOIN counted USING (domain) WHERE n <= 18) GROUP BY guid"""),
    "dwell_time": sql([ACTIONS, DWELL], "SELECT guid, event_id, sec, round(dwell, 6) AS dwell FROM dwelt"),
    "sessionize": sql(CUT, "SELECT guid, event_id, session_no, n_events FROM cut"),
    "sessionize_split": sql(CUT, "SELECT guid, event_id, session_no, n_events FROM cut"),
    "pipeline_sessions": sql([ACTIONS, HISTORIES, """
rare AS (SELECT domain FROM histories GROUP BY domain HAVING count(*) <= 8),
kept AS (SELECT * EXCLUDE (pos) FROM histories WHERE guid NOT IN (SELECT guid FROM histories JOIN rare USING (domain)))
""", DWELL.replace("FROM actions", "FROM kept"), cut(21600)], f"""
SELECT {KEY}, event_id, n_events, round(dwell, 6) AS dwell FROM bounded"""),
    "sessions_by_day": sql(
        [ACTIONS, "week AS (SELECT * FROM actions WHERE month = 1 AND day BETWEEN 8 AND 14)",
         DWELL.replace("FROM actions", "FROM week"), cut(21600)],
        "SELECT guid, event_id, session_no, n_events FROM cut"),
    "bucketed_sessions": sql(CUT, """
SELECT guid, session_no, count(*) AS n_events, any_value(u.user_events) AS user_events, any_value(u.user_clicks) AS user_clicks
FROM cut JOIN (SELECT guid, count(*) AS user_events, sum(is_click)::BIGINT AS user_clicks FROM actions GROUP BY guid) u
USING (guid) GROUP BY guid, session_no"""),
    "session_summary": sql(CUT, f"""
SELECT guid, session_no, count(*) AS n_events, min(sec) AS start_sec, max(sec) AS end_sec,
       first(domain ORDER BY {ORDER}) AS first_domain, last(domain ORDER BY {ORDER}) AS last_domain,
       sum(is_click)::BIGINT AS n_clicks FROM cut GROUP BY guid, session_no"""),
    "sessions_bounded": sql([ACTIONS, DWELL, cut(86400)], f"SELECT {KEY}, event_id, n_events FROM bounded"),
    "sessions_multi_domain": sql(CUT, """
SELECT guid, session_no, event_id, domain FROM cut WHERE (guid, session_no) IN (
  SELECT (guid, session_no) FROM cut GROUP BY guid, session_no HAVING count(DISTINCT domain) >= 2)"""),
    "sessions_roundtrip": sql(CUT, f"""
SELECT {KEY}, event_id, sec, domain, array_to_string(keywords, ' ') AS keywords, day,
       round(dwell, 6) AS dwell FROM bounded"""),
    "drop_repeats": sql(FLAT, f"SELECT {KEY}, domain FROM flat"),
    "flat_sessions": sql(FLAT, """
SELECT dense_rank() OVER (ORDER BY guid, session_no) AS session_id, pos, domain FROM flat"""),
    "shuffled_sessions": sql([*FLAT, SHUFFLED.format(rows="model")], f"SELECT {KEY}, event_id FROM mixed"),
    "sample_sessions": sql(FLAT, """
SELECT guid, session_no FROM (SELECT DISTINCT guid, session_no FROM model)
ORDER BY md5(concat_ws('|', '7', guid, session_no)), guid, session_no LIMIT 200"""),
    "epoch_batches": feistel(seed=7, epoch=2, batch=128),
    "next_item_pairs": sql(FLAT, f"""
SELECT * FROM (SELECT {KEY}, domain, lead(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) AS target FROM flat)
WHERE target IS NOT NULL"""),
    "seen_before": sql(FLAT, f"""
SELECT {KEY}, domain, (CASE WHEN EXISTS (
  SELECT 1 FROM flat g WHERE g.guid = f.guid AND g.session_no = f.session_no AND g.domain = f.domain AND g.pos < f.pos)
  THEN 1 ELSE 0 END)::INTEGER AS seen_before FROM flat f"""),
    "collapse_runs": sql(RUN_PARTS, """
SELECT guid, session_no, run_no, domain, array_to_string(keywords, ' ') AS keywords, dwell_bucket, hour, day, is_merchant
FROM runs"""),
    "collapse_runs_boundary_day": sql(RUN_PARTS, """
SELECT guid, session_no, run_no, domain, boundary_day AS day FROM runs"""),
    "dwell_bucket": sql([ACTIONS, DWELL], """
SELECT guid, event_id, bucket, (CASE WHEN bucket IS NULL OR bucket >= 20 OR bucket < -20 THEN 0
       WHEN bucket < 0 THEN bucket + 20 ELSE bucket END)::INTEGER AS slot
FROM (SELECT *, CASE WHEN dwell > 0 THEN round_even(round(log2(dwell), 9), 0)::INTEGER END AS bucket FROM dwelt)"""),
    "hour_of_day": "SELECT event_id, hour(ts)::INTEGER AS hour FROM events",
    "context_one_hot": sql(RUN_PARTS, """
SELECT guid, session_no, run_no, dwell_slot::INTEGER AS dwell_bucket_slot, 20 AS dwell_bucket_size, hour AS hour_slot,
       24 AS hour_size, day_slot::INTEGER AS day_slot, 31 AS day_size, is_merchant AS is_merchant_slot, 2 AS is_merchant_size
FROM slots"""),
    "context_vector": sql(MEANS, """
SELECT guid, session_no, run_no, 141 AS dims, round(plain + 4, 6) AS plain_sum,
       round(weighted + (65 + dwell_slot) + (85 + hour) + (109 + day_slot) + (140 + is_merchant), 6) AS weighted_sum
FROM slots JOIN (
  SELECT guid, session_no, run_no, sum(v) AS plain, sum(v * (dim + 1)) AS weighted
  FROM rmean GROUP BY guid, session_no, run_no) USING (guid, session_no, run_no)"""),
    "next_context": sql(RUN_PARTS, """
SELECT * FROM (
  SELECT guid, session_no, run_no AS pos, domain, lead(domain) OVER w AS next_domain,
         lead(dwell_bucket) OVER w AS next_dwell_bucket, lead(hour) OVER w AS next_hour,
         lead(day) OVER w AS next_day, lead(is_merchant) OVER w AS next_is_merchant
  FROM runs WINDOW w AS (PARTITION BY guid, session_no ORDER BY run_no))
WHERE next_domain IS NOT NULL"""),
    "domain_keywords": sql([*RUN_PARTS, WORDS, DOMAIN_WORDS], "SELECT domain, word FROM dw"),
    "domain_keyword_mean": sql(MEANS, "SELECT domain, dim, round(v, 6) AS value FROM dmean"),
    "run_keyword_mean": sql(MEANS, f"""
SELECT guid, session_no, run_no, domain, {DIGEST} FROM rmean GROUP BY guid, session_no, run_no, domain"""),
    "merchant_prior": sql([ACTIONS, VECTORS], "SELECT dim, round(v, 6) AS value FROM prior"),
    "domain_vector_lookup": sql([ACTIONS, VECTORS], """
SELECT a.domain, p.dim, round(coalesce(d.v, p.v), 6) AS value
FROM (SELECT DISTINCT domain FROM actions) a CROSS JOIN prior p
LEFT JOIN dv d ON d.domain = a.domain AND d.dim = p.dim"""),
    "dictionary_roundtrip": sql([ACTIONS, WORDS, VECTORS], """
SELECT domain, dim, round(v, 6) AS value FROM dv UNION ALL SELECT '0', dim, 0 FROM dims"""),
    "session_vector": sql([*FLAT, VECTORS, MEAN_VECTORS.format(rows="flat")], f"""
SELECT {KEY}, domain, {DIGEST} FROM visited GROUP BY {KEY}, domain"""),
    "popular_topn": sql([BASKETS], """
SELECT domain AS candidate, count(*) AS n, round(count(*) / (count(*) + 1), 6) AS score
FROM baskets GROUP BY domain ORDER BY n DESC, domain LIMIT 10"""),
    "session_support": sql([BASKETS], "SELECT session, count(*) AS n FROM baskets GROUP BY session"),
    "item_cooccurrence": sql([BASKETS, knn("baskets", "session", 20)], "SELECT domain, other, n FROM co"),
    "item_knn": sql([BASKETS, knn("baskets", "session", 20)], """
SELECT domain, other, round(sim, 6) AS sim FROM sims"""),
    "knn_scores": sql(BY_KNN, f"SELECT {KEY}, candidate, round(score, 6) AS score FROM scored"),
    "session_popular_scores": sql(BY_SESSION, f"SELECT {KEY}, candidate, round(score, 6) AS score FROM scored"),
    "recommend_topk": sql(BY_SESSION, f"""
SELECT {KEY}, candidate, round(score, 6) AS score, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC, candidate) AS place FROM scored)
WHERE place <= 5"""),
    "recommend_by_kind": sql(BY_SESSION, f"""
SELECT {KEY}, candidate, is_merchant, round(score, 6) AS score, place::INTEGER AS place FROM (
  SELECT scored.*, is_merchant, row_number() OVER (
    PARTITION BY {KEY}, is_merchant ORDER BY score DESC, candidate) AS place
  FROM scored JOIN vocab ON vocab.domain = candidate)
WHERE place <= 3"""),
    "session_vector_scores": sql([*TESTED, VECTORS, VECTOR_SCORED], TOP_TEN),
    "random_scores": sql([*TESTED, RANDOM], TOP_TEN),
    "train_test_split": sql(FLAT, f"""
SELECT CASE WHEN min(sec) OVER (PARTITION BY guid, session_no) < {DAY_START} THEN 'train' ELSE 'test' END AS side,
       {KEY}, domain FROM flat"""),
    "train_test_tail": sql(FLAT, """
SELECT side, session_id, pos, domain FROM (
  SELECT *, CASE WHEN session_id > last - 100 THEN 'test' WHEN session_id <= last - 150 THEN 'train' END AS side
  FROM (SELECT *, max(session_id) OVER () AS last FROM (
    SELECT *, dense_rank() OVER (ORDER BY guid, session_no) AS session_id FROM flat)))
WHERE side IS NOT NULL"""),
    "test_known_domains": sql(TESTED, f"SELECT {KEY}, domain FROM test"),
    "common_domains": sql(TESTED, "SELECT DISTINCT domain FROM test"),
    "eval_steps": sql(TESTED, f"SELECT {KEY}, prev, target FROM steps"),
    "eval_popular": sql([*TESTED, POPULAR,
                         f"scored AS (SELECT {KEY}, candidate, score FROM steps CROSS JOIN popular)", RANKED], metrics()),
    "eval_session_popular": sql([*BY_SESSION, RANKED], metrics()),
    "eval_knn": sql([*BY_KNN, RANKED], metrics()),
    "eval_last_step": sql([*BY_KNN, RANKED], metrics("(SELECT * FROM ranks WHERE is_last)")),
    "eval_ranks": sql([*BY_KNN, RANKED], f"SELECT {KEY}, prev, target, rank FROM ranks"),
    "eval_topk_mode": sql([*BY_KNN, RANKED], metrics(hit="rank <= 10", full=True)),
    "eval_by_target_kind": sql([*BY_SESSION, RANKED], metrics(
        "(SELECT ranks.*, is_merchant FROM ranks JOIN vocab ON vocab.domain = target)", "rank <= 10", True, "is_merchant")),
    "eval_by_history": sql([*BY_SESSION, RANKED], metrics("ranks", "rank <= 10", True, "seen_before")),
    "eval_by_position": sql([*BY_SESSION, RANKED], """
SELECT position, count(rank) AS n, round(coalesce(avg(CASE WHEN rank <= 10 THEN 1.0 WHEN rank IS NOT NULL THEN 0.0 END), 0), 6)
       AS recall
FROM (SELECT unnest(range(19))::INTEGER AS position) LEFT JOIN ranks ON ranks.pos - 1 = position GROUP BY position"""),
    "eval_batch_mean": sql([*BY_SESSION, RANKED], """
SELECT count(*) AS batches, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(accuracy), 6) AS accuracy
FROM (SELECT batch_no, count(*) FILTER (rank <= 10) / count(*) AS recall, sum((1.0 / rank)::DOUBLE) / count(*) AS mrr,
             count(*) FILTER (rank = 1) / count(*) AS accuracy
      FROM (SELECT *, (dense_rank() OVER (ORDER BY guid, session_no) - 1) // 128 AS batch_no FROM ranks)
      GROUP BY batch_no)"""),
    "eval_random": sql([*TESTED, RANDOM], metrics(f"""(
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC, idx) AS rank FROM dense)
  WHERE candidate = target)""")),
    "eval_session_vector": sql([*TESTED, VECTORS, VECTOR_SCORED], metrics(f"""(
  SELECT t.guid, t.session_no, t.pos, p.rank
  FROM (SELECT *, lead(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) AS target FROM test) t
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC, idx) AS rank FROM dense) p
    ON p.guid = t.guid AND p.session_no = t.session_no AND p.pos = t.pos AND p.candidate = t.target
  WHERE t.target IS NOT NULL)""")),
    "vector_ranks_with_ties": sql([*TESTED, VECTORS, MEAN_VECTORS.format(rows="test"), """
filled AS (
  SELECT v.domain, v.idx, v.is_merchant, p.dim, coalesce(d.v, p.v) AS v
  FROM vocab v CROSS JOIN prior p LEFT JOIN dv d ON d.domain = v.domain AND d.dim = p.dim),
asked AS (
  SELECT * FROM (SELECT *, lead(domain) OVER (PARTITION BY guid, session_no ORDER BY pos) AS target FROM test)
  WHERE target IS NOT NULL),
dense AS (
  SELECT guid, session_no, pos, f.domain AS candidate, idx, round(sum(q.v * f.v) + any_value(is_merchant) * 0.25, 9) AS score
  FROM visited q JOIN filled f USING (dim) GROUP BY guid, session_no, pos, f.domain, idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY guid, session_no, pos ORDER BY score DESC, idx) AS rank FROM dense)
"""], """
SELECT a.guid, a.session_no, a.pos, r.rank FROM asked a LEFT JOIN ranked r
  ON r.guid = a.guid AND r.session_no = a.session_no AND r.pos = a.pos AND r.candidate = a.target"""),
    "eval_shuffled": sql(BY_SHUFFLED, metrics(hit="rank <= 10", full=True)),
    "eval_shuffled_by_kind": sql(BY_SHUFFLED, metrics(
        "(SELECT ranks.*, is_merchant FROM ranks JOIN vocab ON vocab.domain = target)", "rank <= 10", True, "is_merchant")),
    "eval_shuffled_by_history": sql(BY_SHUFFLED, metrics("ranks", "rank <= 10", True, "seen_before")),
    "eval_batch_mean_whole": sql([*BY_SESSION, RANKED], """
SELECT count(*) AS batches, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(accuracy), 6) AS accuracy
FROM (SELECT batch_no, count(*) FILTER (rank <= 10) / count(*) AS recall, sum((1.0 / rank)::DOUBLE) / count(*) AS mrr,
             count(*) FILTER (rank = 1) / count(*) AS accuracy
      FROM (SELECT *, (no - 1) // 128 AS batch_no, max(no) OVER () // 128 AS whole FROM (
        SELECT *, dense_rank() OVER (ORDER BY guid, session_no) AS no FROM ranks))
      WHERE batch_no < whole GROUP BY batch_no)"""),
    "loss_cross_entropy": sql([*BY_SESSION, RANKED], f"""
SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM (
  SELECT ln(sum(exp(score))) - max(CASE WHEN candidate = target THEN score END) AS loss
  FROM dense JOIN steps USING ({KEY}) GROUP BY {KEY})"""),
    "loss_bpr_max": sql([*BY_SESSION, RANKED], f"""
SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM (
  SELECT -ln(sum(exp(score) / (1 + exp(score - own))) / sum(exp(score)))
         + sum(exp(score) * score * score) / sum(exp(score)) AS loss
  FROM (SELECT p.*, max(CASE WHEN candidate = target THEN score END) OVER (PARTITION BY {KEY}) AS own
        FROM placed p JOIN steps USING ({KEY}))
  WHERE rank <= (SELECT count(*) FROM vocab) // 3 GROUP BY {KEY})"""),
    "loss_cross_entropy_dense": sql([*TESTED, VECTORS, VECTOR_SCORED, VECTOR_OWN], f"""
SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM (
  SELECT ln(sum(exp(score - top))) + any_value(top) - any_value(own) AS loss FROM scores GROUP BY {KEY})"""),
    "loss_bpr_max_dense": sql([*TESTED, VECTORS, VECTOR_SCORED, VECTOR_OWN], f"""
SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM (
  SELECT -ln(sum(exp(score - top) / (1 + exp(score - own))) / sum(exp(score - top)))
         + sum(exp(score - top) * score * score) / sum(exp(score - top)) AS loss
  FROM scores WHERE place <= greatest(1, size // 3) GROUP BY {KEY})"""),
    "vector_block_share": sql([*TESTED, VECTORS, VECTOR_SCORED, VECTOR_OWN, f"""
sized AS (SELECT v.domain, v.idx, sqrt(sum(d.v * d.v)) AS size FROM vocab v JOIN dv d ON d.domain = v.domain GROUP BY ALL),
blocks AS (
  SELECT block, max(size) AS size FROM (SELECT *, (row_number() OVER (ORDER BY size DESC, idx) - 1) // 8 AS block FROM sized)
  GROUP BY block),
lengths AS (SELECT {KEY}, sqrt(sum(v * v)) AS length FROM visited GROUP BY {KEY})"""], f"""
SELECT count(DISTINCT ({KEY})) AS steps, (SELECT count(*) FROM blocks) AS blocks,
       count_if(length * size + 1e-9 * (1 + length * size) >= own) AS met
FROM own JOIN lengths USING ({KEY}) CROSS JOIN blocks"""),
    "eval_factors": sql([*TESTED, VECTORS, FOLDED], metrics(f"""(
  SELECT t.guid, t.session_no, t.pos, p.rank
  FROM (SELECT * FROM solved) t
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY score DESC, idx) AS rank FROM dense) p
    ON p.guid = t.guid AND p.session_no = t.session_no AND p.pos = t.pos AND p.candidate = t.target)""")),
    "word2vec_corpus": sql(FLAT, """
SELECT guid, session_no, string_agg(domain, ' ' ORDER BY pos) || ' UNK UNK UNK' AS tokens
FROM model GROUP BY guid, session_no"""),
    "domain_vectors": sql(FLAT, "SELECT DISTINCT domain, 50 AS dims FROM model UNION ALL SELECT 'UNK', 50"),
    "ppmi_pairs": sql([*FLAT, """
near AS (
  SELECT a.domain, b.domain AS context, count(*) AS n FROM model a JOIN model b
  ON a.guid = b.guid AND a.session_no = b.session_no AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 3 GROUP BY ALL),
sums AS (SELECT domain, sum(n) AS own FROM near GROUP BY domain)"""], """
SELECT domain, context, round(value, 6) AS value FROM (
  SELECT near.domain, context, ln(n::DOUBLE * (SELECT sum(own) FROM sums) / (i.own * j.own::DOUBLE)) AS value
  FROM near JOIN sums i ON i.domain = near.domain JOIN sums j ON j.domain = context)
WHERE value > 0"""),
    "domain_vectors_ppmi": sql(FLAT, "SELECT DISTINCT domain, 16 AS dims FROM model"),
    "item_factors_als": sql(FLAT, "SELECT DISTINCT domain, 100 AS dims FROM flat"),
    "negative_samples": sql([*FLAT, f"placed AS (SELECT *, row_number() OVER (ORDER BY {KEY}) - 1 AS row_no FROM flat)"], f"""
SELECT a.guid, a.session_no, a.pos, a.domain AS positive, b.domain AS negative
FROM placed a JOIN placed b ON b.row_no =
  ('0x' || substr(md5(concat_ws('|', '7', a.guid, a.session_no, a.pos)), 1, 15))::BIGINT % (SELECT count(*) FROM placed)"""),
    "training_examples": sql([*MEANS, VECTORS], f"""
SELECT guid, session_no, pos, target, idx AS target_idx, target_is_merchant, seen_before, 205 AS input_dims,
       round(own_plain + plain, 6) AS input_sum, round(own_weighted + weighted + 64 * plain, 6) AS input_weighted,
       round(next_plain, 6) AS next_sum, round(next_weighted, 6) AS next_weighted
FROM (
  SELECT guid, session_no, run_no AS pos, domain, own_plain, own_weighted, plain, weighted,
         lead(domain) OVER w AS target, lead(is_merchant) OVER w AS target_is_merchant,
         lead(seen) OVER w AS seen_before, lead(plain) OVER w AS next_plain, lead(weighted) OVER w AS next_weighted
  FROM (
    SELECT s.guid, s.session_no, s.run_no, s.domain, s.is_merchant, m.plain + 4 AS plain,
           m.weighted + (65 + dwell_slot) + (85 + hour) + (109 + day_slot) + (140 + s.is_merchant) AS weighted,
           own_plain, own_weighted,
           (CASE WHEN row_number() OVER (PARTITION BY s.guid, s.session_no, s.domain ORDER BY s.run_no) > 1
                 THEN 1 ELSE 0 END)::INTEGER AS seen
    FROM slots s
    JOIN (SELECT guid, session_no, run_no, sum(v) AS plain, sum(v * (dim + 1)) AS weighted
          FROM rmean GROUP BY guid, session_no, run_no) m USING (guid, session_no, run_no)
    JOIN (SELECT u.domain, sum(coalesce(d.v, p.v)) AS own_plain, sum(coalesce(d.v, p.v) * (p.dim + 1)) AS own_weighted
          FROM (SELECT DISTINCT domain FROM model) u CROSS JOIN prior p
          LEFT JOIN dv d ON d.domain = u.domain AND d.dim = p.dim GROUP BY u.domain) o ON o.domain = s.domain)
  WINDOW w AS (PARTITION BY guid, session_no ORDER BY run_no))
JOIN (SELECT domain AS target, row_number() OVER (ORDER BY is_merchant DESC, domain) - 1 AS idx
      FROM (SELECT DISTINCT domain, max(is_click) AS is_merchant FROM model GROUP BY domain)) USING (target)"""),
}
# the same rows, with vectors of 16 numbers beside the context of 141
ORACLES["training_examples_learned"] = f"""
SELECT guid, session_no, pos, target, target_idx, target_is_merchant, seen_before, 157 AS input_dims
FROM ({ORACLES["training_examples"]})"""
