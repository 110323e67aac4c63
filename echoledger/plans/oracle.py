"""Plain SQL over the same tables: what each query should return."""

from __future__ import annotations

from echoledger.functions import guard as G

DIMS = 384

# Fixed values, written out a second time so that a wrong entry in the code under test shows.
RATE_CARD = (
    ("claude-fable-5", 10.0, 50.0),
    ("claude-opus-4-8", 5.0, 25.0),
    ("claude-opus-4-7", 5.0, 25.0),
    ("claude-opus-4-6", 5.0, 25.0),
    ("claude-opus-4-5", 5.0, 25.0),
    ("claude-opus-4-1", 15.0, 75.0),
    ("claude-opus-4", 15.0, 75.0),
    ("claude-sonnet-4", 3.0, 15.0),
    ("claude-haiku-4", 1.0, 5.0),
    ("claude-3-7-sonnet", 3.0, 15.0),
    ("claude-3-5-sonnet", 3.0, 15.0),
    ("claude-3-5-haiku", 0.8, 4.0),
    ("claude-3-sonnet", 3.0, 15.0),
    ("claude-3-haiku", 0.25, 1.25),
    ("claude-3-opus", 15.0, 75.0),
)
DEFAULT_RATE = (3.0, 15.0)
SWEEP = (0.8, 0.81, 0.82, 0.83, 0.84, 0.85, 0.86, 0.87, 0.88, 0.89, 0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99)
SHORT_SWEEP = (0.9, 0.92, 0.95)

USAGE = """
usage AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, event_type IN ('view','click') AS cache_hit,
         CASE user_id % 5 WHEN 0 THEN 'claude-opus-4-5-20251101' WHEN 1 THEN 'claude-opus-4-20250514'
              WHEN 2 THEN 'claude-sonnet-4-6' WHEN 3 THEN 'claude-3.5-haiku-20241022' ELSE 'other-model' END AS model,
         CAST(floor(value*10) AS INT) AS input_tokens, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS output_tokens,
         CAST(floor(value) AS INT) AS latency_ms,
         CASE event_type WHEN 'view' THEN CAST(1.0 AS DOUBLE)
              WHEN 'click' THEN 0.9+CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE)/1000 END AS similarity_score,
         event_type = 'error' AS failed, ts AS created_at
  FROM events)"""

_CARD = ", ".join(f"('{p}', {i}::DOUBLE, {o}::DOUBLE)" for p, i, o in RATE_CARD)

PRICED = USAGE + f""",
rates AS (SELECT * FROM (VALUES {_CARD}) t(prefix, in_rate, out_rate)),
ranked AS (SELECT m.model, r.in_rate, r.out_rate, row_number() OVER (PARTITION BY m.model ORDER BY length(r.prefix) DESC NULLS LAST) AS rn
           FROM (SELECT DISTINCT model FROM usage) m LEFT JOIN rates r ON starts_with(replace(lower(m.model),'.','-'), r.prefix)),
price AS (SELECT model, coalesce(in_rate,{DEFAULT_RATE[0]})::DOUBLE AS in_rate, coalesce(out_rate,{DEFAULT_RATE[1]})::DOUBLE AS out_rate
          FROM ranked WHERE rn=1),
facts AS (SELECT u.*, (u.input_tokens*p.in_rate+u.output_tokens*p.out_rate)/1000000 AS cost_usd,
                 CASE WHEN u.cache_hit THEN (u.input_tokens*p.in_rate+u.output_tokens*p.out_rate)/1000000 ELSE 0.0 END AS cost_saved_usd
          FROM usage u JOIN price p ON u.model=p.model)"""

_H = "CAST(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END) AS BIGINT)"
_M = "CAST(sum(CASE WHEN NOT cache_hit THEN 1 ELSE 0 END) AS BIGINT)"


def _pct(digits: int) -> str:
    return f"round(100.0*{_H}::DOUBLE/nullif(count(*),0), {digits})"


REQS = """
reqs AS (
  SELECT doc_id AS request_id, source AS session_id, text,
         CASE doc_id % 4 WHEN 0 THEN 'claude-opus-4-5' WHEN 1 THEN 'claude-opus-4-5' WHEN 2 THEN 'claude-3-5-haiku' END AS family
  FROM documents),
firsts AS (SELECT family, text, min(request_id) AS first_id, count(*) AS n FROM reqs GROUP BY 1, 2),
seen AS (SELECT r.*, f.first_id, f.n FROM reqs r JOIN firsts f ON r.text=f.text AND r.family IS NOT DISTINCT FROM f.family)"""

VECTORS = f"""
tok AS (SELECT request_id, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) AS t FROM reqs),
tf AS (SELECT request_id, ('0x'||substr(md5(t),1,8))::BIGINT % {DIMS} AS b, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY 1,2),
nn AS (SELECT request_id, sqrt(sum(tf*tf)) AS n FROM tf GROUP BY 1),
vec AS (SELECT tf.request_id, tf.b, tf.tf/nn.n AS x FROM tf JOIN nn ON tf.request_id=nn.request_id)"""


def _values(pairs) -> str:
    return ", ".join(f"('{x}','{y}')" for x, y in pairs)


_ARTICLES = ", ".join(f"'{a}'" for a in G.ARTICLES)


def guard_sql(texts: str) -> str:
    """CTEs over a relation texts(id, t): polarity features and the word-level signs."""
    edge = G._EDGE
    pattern = f"(^|{edge})({'|'.join(G.NEGATIONS)})({edge}|$)|n''t"
    return f"""
gt AS (SELECT id, regexp_matches(lower(t), '{pattern}') AS neg, regexp_extract_all(lower(t),'[a-z0-9]+') AS tk FROM {texts}),
gp AS (SELECT *, len(tk) AS n, CASE WHEN list_contains(tk,'to') OR list_contains(tk,'into') THEN
         greatest(coalesce(len(tk)+1-nullif(list_position(list_reverse(tk),'to'),0),0), coalesce(len(tk)+1-nullif(list_position(list_reverse(tk),'into'),0),0)) END AS i FROM gt),
gd AS (SELECT id, neg, tk,
         CASE WHEN i > 1 AND i < n THEN list_filter(tk[1:i-1], lambda x: x NOT IN ({_ARTICLES}))[-1] END AS source,
         CASE WHEN i > 1 AND i < n THEN list_filter(tk[i+1:n], lambda x: x NOT IN ({_ARTICLES}))[1] END AS target FROM gp),
gw AS (SELECT DISTINCT id, unnest(tk) AS t FROM gt),
gv AS (SELECT DISTINCT t FROM gw),
gx AS (
  SELECT a.t AS x, b.t AS y FROM gv b CROSS JOIN (SELECT unnest({list(G.NEGATING_PREFIXES)}) AS p) q JOIN gv a ON a.t = q.p || b.t
  UNION SELECT a.t, b.t FROM gv a JOIN (VALUES {_values(G.OPPOSING_PREFIXES)}) q(p1,p2) ON starts_with(a.t,q.p1) AND length(a.t)-length(q.p1) >= 3
        JOIN gv b ON b.t = q.p2 || substr(a.t, length(q.p1)+1)
  UNION SELECT x, y FROM (VALUES {_values(G.OPPOSITES)}) q(x,y)),
gs AS (
  SELECT wx.id, o.x, o.y, 1 AS s FROM gx o JOIN gw wx ON wx.t=o.x LEFT JOIN gw wy ON wy.id=wx.id AND wy.t=o.y WHERE wy.id IS NULL
  UNION ALL
  SELECT wy.id, o.x, o.y, -1 FROM gx o JOIN gw wy ON wy.t=o.y LEFT JOIN gw wx ON wx.id=wy.id AND wx.t=o.x WHERE wx.id IS NULL)"""


def verdict_sql(cand: str) -> str:
    """CTE verdict(a, b, neg_conflict, way_conflict, word_conflict, safe) over cand(a, b)."""
    return f"""
wordbad AS (SELECT DISTINCT c.a, c.b FROM {cand} c JOIN gs p ON p.id=c.a JOIN gs q ON q.id=c.b AND q.x=p.x AND q.y=p.y AND q.s=-p.s),
verdict AS (
  SELECT c.a, c.b, ga.neg <> gb.neg AS neg_conflict,
         coalesce(ga.source=gb.target AND ga.target=gb.source AND ga.source<>ga.target, false) AS way_conflict,
         w.a IS NOT NULL AS word_conflict,
         NOT (ga.neg <> gb.neg OR coalesce(ga.source=gb.target AND ga.target=gb.source AND ga.source<>ga.target, false) OR w.a IS NOT NULL) AS safe
  FROM {cand} c JOIN gd ga ON ga.id=c.a JOIN gd gb ON gb.id=c.b LEFT JOIN wordbad w ON w.a=c.a AND w.b=c.b)"""


def near_sql(probe: str, store: str, order: str, threshold: float = 0.9) -> str:
    """CTEs near(a, b, score, fits) and the verdicts; probe/store are conditions on a request id."""
    return f"""
vp AS (SELECT * FROM vec v WHERE {probe.format('v.request_id')}),
vs AS (SELECT * FROM vec v WHERE {store.format('v.request_id')}),
near AS (
  SELECT d.a, d.b, d.score, (ra.family IS NULL OR rb.family IS NULL OR ra.family=rb.family) AS fits FROM (
    SELECT p.request_id AS a, s.request_id AS b, round(sum(p.x*s.x),9) AS score FROM vp p JOIN vs s ON p.b=s.b AND {order}
    GROUP BY 1,2 HAVING round(sum(p.x*s.x),9) >= {threshold}) d
  JOIN reqs ra ON ra.request_id=d.a JOIN reqs rb ON rb.request_id=d.b),
texts AS (SELECT request_id AS id, text AS t FROM reqs WHERE request_id IN (SELECT a FROM near UNION SELECT b FROM near)),""" + guard_sql("texts") + "," + verdict_sql("near")


_HEAD = "WITH " + REQS + "," + VECTORS + ","
_EARLIER = near_sql("true OR {0} IS NULL", "true OR {0} IS NULL", "s.request_id < p.request_id")
_SNAP_FIRST = "{0} IN (SELECT min(request_id) FROM reqs WHERE request_id % 2 = 0 GROUP BY family, text)"
_SNAP_ASKED = "{0} % 2 = 1"
_SNAPSHOT = near_sql(_SNAP_ASKED, _SNAP_FIRST, "true")
_BEST = """
best AS (SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY n.a ORDER BY score DESC, n.b) AS rn
         FROM near n JOIN verdict v ON v.a=n.a AND v.b=n.b WHERE n.fits AND v.safe) WHERE rn=1)"""

PAIRS = """
pairs AS (SELECT l.doc_id AS pair_id, l.text AS a, r.text AS b, CASE WHEN l.lang=r.lang THEN 'hit' ELSE 'miss' END AS expect,
                 l.source AS eval_set, CASE WHEN l.doc_id % 3 = 0 THEN 'held-out' ELSE 'dev' END AS role
          FROM documents l JOIN documents r ON r.doc_id = l.doc_id + 1)"""
_PAIR_CAND = """
texts AS (SELECT doc_id AS id, text AS t FROM documents),
cand AS (SELECT pair_id AS a, pair_id + 1 AS b FROM pairs),""" + guard_sql("texts") + "," + verdict_sql("cand")
SCORED = PAIRS + "," + REQS + "," + VECTORS + "," + _PAIR_CAND + """,
scores AS (SELECT p.request_id AS a, round(sum(p.x*s.x),9) AS score FROM vec p JOIN vec s ON p.b=s.b AND s.request_id=p.request_id+1 GROUP BY 1),
scored AS (SELECT p.*, coalesce(s.score, 0.0) AS score, v.safe FROM pairs p LEFT JOIN scores s ON s.a=p.pair_id JOIN verdict v ON v.a=p.pair_id)"""


def confusion_sql(thresholds, by: str = "") -> str:
    g = f"{by}, " if by else ""
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return f"""
conf AS (SELECT {g} pipeline, thr,
    count(*) FILTER (WHERE expect='hit' AND score>=thr AND (pipeline='cosine' OR safe)) AS tp,
    count(*) FILTER (WHERE expect='miss' AND score>=thr AND (pipeline='cosine' OR safe)) AS fp,
    count(*) FILTER (WHERE expect='hit') AS n_hit, count(*) FILTER (WHERE expect='miss') AS n_miss
  FROM scored, (VALUES {values}) t(thr), (VALUES ('cosine'),('guarded')) q(pipeline) GROUP BY ALL),
pr AS (SELECT *, n_hit-tp AS fn, CASE WHEN tp+fp>0 THEN tp::DOUBLE/(tp+fp) ELSE 1.0 END AS precision,
    CASE WHEN n_hit>0 THEN tp::DOUBLE/n_hit ELSE 0.0 END AS recall FROM conf),
sweep AS (SELECT *, CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0.0 END AS f1 FROM pr)"""


_R4 = "round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1"

_DOC_CANON = """
canon AS (SELECT doc_id AS request_id,
   '{"messages":[{"content":[{"text":' || CAST(to_json(text) AS VARCHAR) || ',"type":"text"}],"role":"user"}]'
   || CASE doc_id % 4 WHEN 0 THEN ',"model":"claude-opus-4-5"' WHEN 1 THEN ',"model":"claude-opus-4-5"' WHEN 2 THEN ',"model":"claude-3-5-haiku"' ELSE '' END
   || CASE WHEN doc_id % 5 IN (2,3) THEN ',"system":[{"text":"be brief","type":"text"}]' ELSE '' END
   || CASE WHEN doc_id % 6 = 1 THEN ',"tool_choice":{"type":"auto"}' ELSE '' END
   || CASE WHEN doc_id % 3 = 0 THEN ',"tools":[{"input_schema":{"a":[1,2],"type":"object"},"name":"f"}]' ELSE '' END
   || '}' AS c,
   CASE WHEN doc_id % 5 IN (2,3) THEN 'be brief' || chr(10) || text ELSE text END AS e,
   CASE doc_id % 4 WHEN 0 THEN 'claude-opus-4-5' WHEN 1 THEN 'claude-opus-4-5' WHEN 2 THEN 'claude-3-5-haiku' END AS model
   FROM documents WHERE doc_id % 23 NOT IN (7,8,9,10,11,12,13))"""

_SAID = """
said AS (SELECT conv_id || '-' || turn AS response_id, conv_id, turn, text, length(text) AS in_tok, len(string_split(text,' ')) AS out_tok
         FROM conversations WHERE role='assistant')"""

_RANKS = """
r AS (SELECT session_id, latency_ms AS x, row_number() OVER (PARTITION BY session_id ORDER BY latency_ms, id) AS k,
             count(*) OVER (PARTITION BY session_id) AS n FROM usage),
j AS (SELECT *, least(greatest(CAST(floor(19*(n+1)/20.0) AS BIGINT),1),greatest(n-1,1)) AS j FROM r),
p95 AS (SELECT session_id, CASE WHEN max(n)=1 THEN CAST(max(x) AS DOUBLE)
   ELSE sum(CASE WHEN k=j THEN x*(20-(19*(n+1)-20*j)) WHEN k=j+1 THEN x*(19*(n+1)-20*j) ELSE 0 END)/CAST(20 AS DOUBLE) END AS p95 FROM j GROUP BY 1)"""

_METRICS = "WITH " + PRICED + "," + _RANKS + """
, sm AS (SELECT f.session_id, round(sum(cost_usd),6) AS cost_usd, round(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END)::DOUBLE/count(*),6) AS hit_rate,
  any_value(p.p95) AS latency_p95, count(*) AS total_calls FROM facts f JOIN p95 p ON p.session_id=f.session_id GROUP BY 1)"""

_DAILY = f"SELECT CAST(created_at AS DATE) AS date, {_H} AS hits, {_M} AS misses FROM usage GROUP BY 1"

# One decimal of the double x by its exact binary value: tenths in units of 2^-59, half to even.
_T = "(CAST((x-floor(x))*576460752303423488::DOUBLE AS HUGEINT)*10)"
_HALF_EVEN = f"""(floor(x)*10 + {_T}//576460752303423488 + CASE WHEN {_T}%576460752303423488 > 288230376151711744
    OR ({_T}%576460752303423488 = 288230376151711744 AND (floor(x)::BIGINT*10 + {_T}//576460752303423488)%2 = 1) THEN 1 ELSE 0 END)/10::DOUBLE"""

ORACLE: dict[str, str] = {
    # usage analytics
    "stats_all_time": f"WITH {PRICED} SELECT count(*) AS total_calls, {_H} AS cache_hits, {_M} AS cache_misses, {_pct(1)} AS hit_rate_pct, round(coalesce(sum(cost_saved_usd),0.0),6) AS cost_saved_usd FROM facts",
    "session_stats": f"WITH {PRICED} SELECT session_id, total_calls, cache_hits, cache_misses, {_HALF_EVEN} AS hit_rate_pct, saved AS cost_saved_usd FROM (SELECT session_id, count(*) AS total_calls, {_H} AS cache_hits, count(*)-{_H} AS cache_misses, {_H}::DOUBLE/count(*)*100 AS x, round(sum(cost_saved_usd),6) AS saved FROM facts GROUP BY 1)",
    "daily_hits": f"WITH {USAGE} {_DAILY}",
    "hit_rate": f"WITH {USAGE} SELECT {_pct(2)} AS hit_rate_pct FROM usage",
    "total_saved": f"WITH {PRICED} SELECT round(sum(cost_saved_usd)::DECIMAL(28,9),4)::DOUBLE AS total_saved_usd FROM facts",
    "daily_summary": f"WITH {PRICED} SELECT CAST(created_at AS DATE) AS date, count(*) AS total_calls, {_H} AS cache_hits, {_pct(1)} AS hit_rate_pct, round(sum(cost_usd)::DECIMAL(28,9),4)::DOUBLE AS gross_cost_usd, round(sum(cost_saved_usd)::DECIMAL(28,9),4)::DOUBLE AS saved_usd, round(avg(latency_ms)) AS avg_latency_ms FROM facts GROUP BY 1",
    "cost_by_model": f"WITH {PRICED} SELECT model, count(*) AS n_calls, round(sum(cost_usd),6) AS cost_usd, round(sum(cost_saved_usd),6) AS cost_saved_usd, round(sum(cost_usd-cost_saved_usd),6) AS spend_usd FROM facts GROUP BY 1",
    "rate_lookup": f"WITH {PRICED} SELECT model, in_rate, out_rate FROM price",
    "savings_model": f"WITH {USAGE} SELECT count(*) AS n_calls, {_H} AS n_hits, 0.00975::DOUBLE AS cost_per_call, round({_H}*0.00975::DOUBLE,6) AS saved_usd, round((count(*)-{_H})*0.00975::DOUBLE,6) AS spent_usd, round(100.0*{_H}::DOUBLE/count(*),4) AS saved_pct FROM usage",
    "session_metrics": _METRICS + " SELECT * FROM sm",
    "metric_rows": _METRICS + " SELECT session_id AS run, metric, value FROM (SELECT session_id, cost_usd, hit_rate, latency_p95, total_calls::DOUBLE AS total_calls FROM sm) UNPIVOT (value FOR metric IN (cost_usd, hit_rate, latency_p95, total_calls))",
    "session_p95": f"WITH {USAGE}, {_RANKS} SELECT session_id, p95 FROM p95",
    "latency_nearest_rank": f"WITH {USAGE}, r AS (SELECT model, latency_ms, row_number() OVER (PARTITION BY model ORDER BY latency_ms) AS k, count(*) OVER (PARTITION BY model) AS n FROM usage) SELECT model, n, latency_ms AS value FROM r WHERE k = least(greatest(round_even(0.95::DOUBLE*n,0)::BIGINT,1),n)",
    "latency_floor_rank": f"WITH {USAGE}, r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS k, count(*) OVER () AS n FROM usage) SELECT n, latency_ms AS value FROM r WHERE k = floor(0.95::DOUBLE*n)::BIGINT",
    "newest_latencies": f"WITH {USAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS k FROM usage) SELECT session_id, id, latency_ms FROM r WHERE k <= 20",
    "running_totals": f"WITH {PRICED} SELECT id, session_id, count(*) OVER w AS calls_so_far, CAST(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hits_so_far, round(sum(cost_usd) OVER w,6) AS cost_so_far, round(sum(cost_saved_usd) OVER w,6) AS saved_so_far FROM facts WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)",
    "fact_invariants": f"WITH {PRICED} SELECT count(*) FILTER (WHERE cache_hit AND cost_saved_usd<>cost_usd) AS hit_without_full_saving, count(*) FILTER (WHERE NOT cache_hit AND cost_saved_usd<>0) AS miss_with_saving, count(*) FILTER (WHERE cache_hit AND similarity_score IS NULL) AS hit_without_score, count(*) FILTER (WHERE NOT cache_hit AND similarity_score IS NOT NULL) AS miss_with_score FROM facts",
    "tail_lines": f"WITH {PRICED} SELECT id, CASE WHEN cache_hit THEN '[HIT ] ' ELSE '[MISS] ' END || 'latency=' || latency_ms || 'ms  sim=' || coalesce(printf('%.3f', similarity_score),'—') || '  cost=$' || printf('%.6f', cost_usd) || '  saved=$' || printf('%.6f', cost_saved_usd) || '  ' || model AS line FROM facts",
    "failure_rolling": f"WITH {USAGE} SELECT id, model AS service, count(*) OVER (PARTITION BY model ORDER BY epoch_us(created_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_recent, count(*) OVER (PARTITION BY model ORDER BY epoch_us(created_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) >= 3 AS trips FROM usage WHERE failed",
    # requests
    "eligible_requests": "SELECT doc_id AS request_id FROM documents WHERE doc_id % 29 NOT IN (3,4)",
    "model_family": "WITH " + REQS + " SELECT request_id, family AS model FROM reqs",
    "canonical_hash": "WITH " + _DOC_CANON + " SELECT request_id, sha256(c) AS prompt_hash, model FROM canon",
    "request_rejects": "SELECT doc_id AS request_id, CASE doc_id % 23 WHEN 7 THEN 'invalid_json' WHEN 12 THEN 'invalid_json' WHEN 13 THEN 'invalid_json' WHEN 8 THEN 'not_object' WHEN 9 THEN 'messages_not_list' WHEN 10 THEN 'message_not_object' ELSE 'duplicate_key' END AS reject_reason FROM documents WHERE doc_id % 23 IN (7,8,9,10,11,12,13)",
    "embedding_text": "WITH " + _DOC_CANON + " SELECT request_id, sha256(e) AS embed_hash FROM canon",
    "conversation_embedding_text": """WITH m AS (SELECT *, count(*) FILTER (WHERE role<>'system') OVER (PARTITION BY conv_id) AS nt FROM conversations)
        SELECT conv_id, sha256(string_agg(CASE WHEN role='system' THEN text WHEN nt>1 THEN role||': '||text ELSE text END, chr(10)
          ORDER BY CASE WHEN role='system' THEN 0 ELSE 1 END, turn)) AS embed_hash FROM m GROUP BY 1""",
    "exact_repeat_attribution": "WITH " + REQS + " SELECT request_id, first_id, request_id<>first_id AS is_repeat FROM seen",
    "exact_lookup": "WITH " + REQS + ", st AS (SELECT DISTINCT family, text FROM reqs WHERE request_id % 2 = 0) SELECT r.request_id, CASE WHEN s.text IS NOT NULL THEN 1.0::DOUBLE END AS similarity_score FROM reqs r LEFT JOIN st s ON s.text=r.text AND s.family IS NOT DISTINCT FROM r.family WHERE r.request_id % 2 = 1",
    "top_prompts": "WITH " + REQS + " SELECT sha256(text) AS text_hash, n-1 AS hit_count, last_id FROM (SELECT family, text, count(*) AS n, max(request_id) AS last_id, min(request_id) AS f FROM reqs GROUP BY 1,2) WHERE n > 1",
    # store
    "store_upsert": "SELECT user_id AS id, event_id AS version, event_type AS payload FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1",
    "insert_if_absent": "SELECT sha256(text) AS id, CASE WHEN min(doc_id % 2) = 0 THEN 'old' ELSE 'new' END AS origin FROM documents GROUP BY text",
    "store_index_reconcile": "SELECT sha256(text) AS id, CASE WHEN min(doc_id % 2) = 0 THEN 'index' ELSE 'store' END AS missing_in FROM documents GROUP BY text HAVING min(doc_id % 2) = max(doc_id % 2)",
    "index_projection": "WITH " + REQS + " SELECT f.first_id AS id, coalesce(f.family,'unknown') AS model, 0.0::DOUBLE AS cost_usd FROM firsts f",
    "pending_round_trip": "WITH " + REQS + ", " + VECTORS + " SELECT request_id, count(*) AS n_dims, round(sum(x*x),4) AS norm FROM vec GROUP BY 1",
    "seed_store": "SELECT min(doc_id) AS first_id, sha256(text) AS text_hash, count(*) AS n_prompts, 384 AS n_dims FROM documents GROUP BY text",
    "schema_check": "SELECT c.column_name, c.got, c.want, c.got=c.want AS ok, (SELECT count(*) FROM events) AS n_rows, CASE c.column_name WHEN 'similarity_score' THEN (SELECT count(*) FROM events WHERE event_type NOT IN ('view','click')) ELSE 0 END AS n_null FROM (VALUES ('id','bigint','string'),('session_id','string','string'),('cache_hit','boolean','boolean'),('model','string','string'),('input_tokens','int','int'),('output_tokens','int','int'),('cost_usd','double','double'),('cost_saved_usd','double','double'),('latency_ms','int','int'),('similarity_score','double','double'),('created_at','timestamp','timestamp')) c(column_name, got, want)",
    # responses
    "stream_tokens": "WITH " + _SAID + " SELECT response_id, in_tok AS input_tokens, out_tok AS output_tokens FROM said",
    "message_tokens": "WITH " + _SAID + " SELECT response_id, in_tok AS input_tokens, out_tok AS output_tokens FROM said",
    "assemble_message": "WITH " + _SAID + """ SELECT response_id, sha256(text) AS text_hash, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN '{"n":' || turn || '}' ELSE '{}' END END AS tool_input,
        CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 1 THEN '{"n": ' || turn || ']' END AS leftover, 'end_turn' AS stop_reason, '{"output_tokens":' || out_tok || '}' AS usage, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS n_blocks FROM said""",
    "expand_message": "WITH " + _SAID + """ SELECT response_id, b.block, b.step, b.name FROM said, (VALUES (-1,0,'message_start'),(0,0,'content_block_start'),(0,1,'content_block_delta'),(0,2,'content_block_stop'),(1,0,'message_delta'),(1,1,'message_stop')) b(block, step, name)""",
    "complete_responses": "WITH " + _SAID + " SELECT response_id FROM said WHERE conv_id % 7 <> 6",
    "replay_form": "WITH " + _SAID + " SELECT response_id, CASE WHEN turn % 3 = 0 THEN 'stream' ELSE 'json' END AS form, (conv_id % 2 = 0) = (turn % 3 = 0) AS converted FROM said",
    "round_trip": "WITH " + _SAID + " SELECT response_id, true AS same_content, true AS same_stop, true AS same_output_tokens FROM said",
    # vectors and similarity
    "doc_vectors": "WITH " + REQS + ", " + VECTORS + " SELECT request_id, b AS bucket, round(x,6) AS x FROM vec",
    "unit_vectors": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),4) AS norm, round(embedding[1]::DOUBLE/sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),6) AS first_value FROM embeddings",
    "contradiction_probability": """WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
        r AS (SELECT vec_id, e, unnest(list_append(range(1, 62, 3), 62)) AS i FROM l),
        p AS (SELECT vec_id, max(e[i]/(e[i]+e[i+1]+e[i+2])) AS p FROM r GROUP BY 1)
        SELECT vec_id, round(p,6) AS probability, p >= 0.5 AS contradicts FROM p""",
    "similarity_profile": _HEAD + _EARLIER + " SELECT n.a AS request_id, count(*) AS n_near, count(*) FILTER (WHERE n.fits) AS n_compatible, count(*) FILTER (WHERE n.fits AND v.safe) AS n_safe, round(max(score),6) AS top_score FROM near n JOIN verdict v ON v.a=n.a AND v.b=n.b GROUP BY 1",
    "similarity_best": _HEAD + _EARLIER + "," + _BEST + " SELECT a AS request_id, b AS matched_id, round(score,6) AS score FROM best",
    "similarity_top": _HEAD + _EARLIER + """, ranked AS (SELECT n.*, v.safe, row_number() OVER (PARTITION BY n.a ORDER BY score DESC, n.b) AS rk FROM near n JOIN verdict v ON v.a=n.a AND v.b=n.b),
        pick AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rk) AS rn FROM ranked WHERE rk <= 5 AND fits AND safe)
        SELECT a AS request_id, b AS matched_id, round(score,6) AS score FROM pick WHERE rn=1""",
    "similarity_newest": _HEAD + near_sql(_SNAP_ASKED, "{0} IN (SELECT request_id FROM reqs WHERE request_id % 2 = 0 ORDER BY request_id DESC LIMIT 300)", "true") + "," + _BEST + " SELECT a AS request_id, b AS matched_id, round(score,6) AS score FROM best",
    "embedding_best": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id AS request_id, b.vec_id AS matched_id, round(list_dot_product(a.v,b.v),9) AS score FROM e a JOIN e b ON b.vec_id < a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, matched_id) AS rn FROM s WHERE score >= 0.3) SELECT request_id, matched_id, round(score,6) AS score FROM r WHERE rn=1",
    "tiered_resolution": _HEAD + _SNAPSHOT + "," + _BEST + """, st AS (SELECT family, text, min(request_id) AS first_id FROM reqs WHERE request_id % 2 = 0 GROUP BY 1,2)
        SELECT r.request_id, CASE WHEN s.first_id IS NOT NULL THEN 'L1' WHEN b.a IS NOT NULL THEN 'L2' ELSE 'miss' END AS tier,
               coalesce(s.first_id, b.b) AS matched_id, CASE WHEN s.first_id IS NOT NULL THEN 1.0 ELSE round(b.score,6) END AS score
        FROM reqs r LEFT JOIN st s ON s.text=r.text AND s.family IS NOT DISTINCT FROM r.family LEFT JOIN best b ON b.a=r.request_id WHERE r.request_id % 2 = 1""",
    "phase_report": _HEAD + _SNAPSHOT + "," + _BEST + """, st AS (SELECT family, text, min(request_id) AS first_id FROM reqs WHERE request_id % 2 = 0 GROUP BY 1,2),
        t AS (SELECT d.lang AS phase, CASE WHEN s.first_id IS NOT NULL THEN 'L1' WHEN b.a IS NOT NULL THEN 'L2' ELSE 'miss' END AS tier
        FROM reqs r JOIN documents d ON d.doc_id=r.request_id LEFT JOIN st s ON s.text=r.text AND s.family IS NOT DISTINCT FROM r.family LEFT JOIN best b ON b.a=r.request_id WHERE r.request_id % 2 = 1)
        SELECT phase, count(*) AS n_requests, count(*) FILTER (WHERE tier='L1') AS l1_hits, count(*) FILTER (WHERE tier='L2') AS l2_hits, count(*) FILTER (WHERE tier='miss') AS misses FROM t GROUP BY 1""",
    # guard and quality
    "guard_negation": "WITH " + PAIRS + "," + _PAIR_CAND + " SELECT a AS pair_id, neg_conflict FROM verdict",
    "guard_direction": "WITH " + PAIRS + "," + _PAIR_CAND + " SELECT id AS doc_id, CASE WHEN target IS NOT NULL THEN source END AS source, CASE WHEN source IS NOT NULL THEN target END AS target FROM gd",
    "guard_words": "WITH " + PAIRS + "," + _PAIR_CAND + " SELECT a AS pair_id, word_conflict FROM verdict",
    "guard_difference": "WITH " + PAIRS + "," + _PAIR_CAND + ", d AS (SELECT p.a, (SELECT count(*) FROM gw x WHERE x.id=p.a) AS na, (SELECT count(*) FROM gw x WHERE x.id=p.b) AS nb, (SELECT count(*) FROM gw x JOIN gw y ON x.t=y.t WHERE x.id=p.a AND y.id=p.b) AS nc FROM cand p) SELECT a AS pair_id, (na-nc)::INT AS only_a, (nb-nc)::INT AS only_b FROM d",
    "guard_safe": "WITH " + PAIRS + "," + _PAIR_CAND + " SELECT a AS pair_id, safe FROM verdict",
    "pair_scores": "WITH " + SCORED + " SELECT pair_id, round(score,6) AS score, safe FROM scored",
    "confusion_sweep": "WITH " + SCORED + "," + confusion_sql(SWEEP) + f" SELECT pipeline, thr, tp, fp, fn, n_hit, n_miss, {_R4} FROM sweep",
    "best_threshold": "WITH " + SCORED + "," + confusion_sql(SWEEP) + " SELECT pipeline, min(thr) FILTER (WHERE fp=0 AND tp>0) AS thr, round(max(recall) FILTER (WHERE fp=0 AND tp>0),6) AS recall FROM sweep GROUP BY 1",
    "generalization": "WITH " + SCORED + "," + confusion_sql((0.9,), "eval_set, role") + " SELECT eval_set, role, tp, fp, n_hit, round(precision,6) AS precision, round(recall,6) AS recall FROM sweep WHERE pipeline='guarded'",
    "recall_report": "WITH " + SCORED + "," + confusion_sql(SHORT_SWEEP) + " SELECT thr, tp AS recalled, n_hit, fp AS false_positives, n_miss FROM sweep WHERE pipeline='cosine'",
    "wilson_ci": "WITH c AS (SELECT source AS grp, count(*) AS n, count(*) FILTER (WHERE quality=1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), w AS (SELECT grp, n, k, k::DOUBLE/n AS p, 1.96::DOUBLE AS z FROM c) SELECT grp, k, n, round(greatest(0.0,((p+z*z/(2*n))-z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n)),6) AS low, round(least(1.0,((p+z*z/(2*n))+z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n)),6) AS high FROM w",
    "pair_integrity": "WITH " + PAIRS + ", g AS (SELECT eval_set, a, b, count(*) AS n, count(*) FILTER (WHERE trim(a)='' OR trim(b)='') AS blank FROM pairs GROUP BY 1,2,3) SELECT eval_set, CAST(sum(n) AS BIGINT) AS n_pairs, sum(n)<30 AS too_small, 0::BIGINT AS bad_labels, CAST(sum(blank) AS BIGINT) AS blank_texts, CAST(sum(n-1) AS BIGINT) AS repeated_pairs FROM g GROUP BY 1",
    # streams
    "stream_session_metrics": _METRICS + " SELECT * FROM sm",
    "stream_ingest": f"WITH {USAGE} SELECT id, session_id, cache_hit FROM usage",
    "stream_daily": f"WITH {USAGE} SELECT CAST(created_at AS DATE) AS date, count(*) AS n_calls, {_H} AS hits, {_M} AS misses FROM usage GROUP BY 1",
    "stream_drain": "WITH " + REQS + " SELECT first_id AS id, family AS model FROM firsts",
    "stream_propagation": "WITH " + REQS + " SELECT first_id AS id, coalesce(family,'unknown') AS model FROM firsts",
    "stream_lookup": "WITH " + REQS + ", st AS (SELECT DISTINCT family, text FROM reqs WHERE request_id % 2 = 0) SELECT r.request_id, s.text IS NOT NULL AS hit FROM reqs r LEFT JOIN st s ON s.text=r.text AND s.family IS NOT DISTINCT FROM r.family",
}
ORACLE["stream_tail"] = ORACLE["tail_lines"]
ORACLE["store_append"] = ORACLE["store_upsert"]
ORACLE["similarity_indexed"] = ORACLE["similarity_best"]
ORACLE["chunk_assembly"] = ORACLE["stream_assembly"] = ORACLE["assemble_message"] + " WHERE conv_id % 7 <> 6 AND conv_id % 11 <> 3"
ORACLE["usage_append"] = f"""WITH {PRICED} SELECT CAST(created_at AS DATE) AS date, CAST(id % 3 AS INT) AS batch, id, session_id, cache_hit,
    round(cost_usd,6) AS cost_usd FROM facts"""
_VERSIONS = """WITH d AS (SELECT doc_id AS id, sha256(text) AS text, source FROM documents),
    o AS (SELECT * FROM d WHERE id % 7 <> 0),
    n AS (SELECT id, CASE WHEN id % 3 = 0 THEN text || '+' ELSE text END AS text, CASE WHEN id % 11 <> 0 THEN source END AS source FROM d WHERE id % 5 <> 0)"""
ORACLE["change_feed"] = _VERSIONS + """ SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change,
    coalesce(o.id, n.id) AS id, n.text, n.source FROM o FULL JOIN n ON n.id = o.id
    WHERE o.id IS NULL OR n.id IS NULL OR o.text <> n.text OR o.source IS DISTINCT FROM n.source"""
ORACLE["index_after_changes"] = _VERSIONS + " SELECT id, text, source FROM n"

# Replay with write-back: the log walked row by row.
def _replay(embedded: str) -> str:
    """embedded: SQL of the ids whose text has a vector; the rest miss, and so do their repeats."""
    return (
        "WITH RECURSIVE " + REQS + "," + VECTORS + ","
        + near_sql("{0} IN (SELECT first_id FROM firsts) AND {0} IN (" + embedded + ")", "{0} IN (SELECT first_id FROM firsts) AND {0} IN (" + embedded + ")", "s.request_id < p.request_id")
        + """,
    node AS (SELECT first_id AS id, row_number() OVER (ORDER BY first_id) AS rn FROM firsts WHERE first_id IN (""" + embedded + """)),
    edge AS (SELECT x.rn AS a, y.rn AS b FROM near n JOIN verdict v ON v.a=n.a AND v.b=n.b AND v.safe JOIN node x ON x.id=n.a JOIN node y ON y.id=n.b WHERE n.fits),
    adj AS (SELECT a, list(b) AS l FROM edge GROUP BY 1),
    walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
             SELECT i+1, CASE WHEN list_has_any(coalesce((SELECT l FROM adj WHERE a=i+1), []::BIGINT[]), kept) THEN kept ELSE list_append(kept, i+1) END
             FROM walk WHERE i < (SELECT count(*) FROM node)),
    stored AS (SELECT n.id FROM node n WHERE n.rn IN (SELECT unnest(kept) FROM walk WHERE i = (SELECT count(*) FROM node))),
    best AS (SELECT * FROM (SELECT n.a, n.b, n.score, row_number() OVER (PARTITION BY n.a ORDER BY n.score DESC, n.b) AS rn
             FROM near n JOIN verdict v ON v.a=n.a AND v.b=n.b AND v.safe WHERE n.fits AND n.b IN (SELECT id FROM stored) AND n.a NOT IN (SELECT id FROM stored)) WHERE rn=1)
    SELECT s.request_id, CASE WHEN s.first_id NOT IN (""" + embedded + """) THEN 'miss' WHEN s.request_id<>s.first_id THEN 'L1' WHEN b.a IS NOT NULL THEN 'L2' ELSE 'miss' END AS tier,
           CASE WHEN s.first_id NOT IN (""" + embedded + """) THEN NULL WHEN s.request_id<>s.first_id OR b.a IS NOT NULL THEN coalesce(b.b, s.first_id) END AS matched_id,
           CASE WHEN s.first_id NOT IN (""" + embedded + """) THEN NULL WHEN s.request_id<>s.first_id THEN 1.0 ELSE round(b.score,6) END AS score
    FROM seen s LEFT JOIN best b ON b.a=s.first_id"""
    )


ORACLE["replay_attribution"] = _replay("SELECT doc_id FROM documents")
ORACLE["replay_failed_embeds"] = _replay("SELECT doc_id FROM documents WHERE length(text) % 11 <> 0")

# The same walk, priced: tokens come from the answer that was served.
ORACLE["usage_ledger"] = (
    "WITH r AS (" + ORACLE["replay_attribution"] + """),
    u AS (SELECT r.request_id, r.tier, d.source, d.text, CASE d.doc_id % 4 WHEN 0 THEN 'claude-opus-4-5' WHEN 1 THEN 'claude-opus-4-5' WHEN 2 THEN 'claude-3-5-haiku' ELSE 'unknown' END AS model,
          coalesce(r.matched_id, r.request_id) AS served FROM r JOIN documents d ON d.doc_id=r.request_id),
    p AS (SELECT u.*, length(s.text)::INT AS input_tokens, (u.served % 97)::INT AS output_tokens,
          CASE model WHEN 'claude-opus-4-5' THEN 5.0::DOUBLE WHEN 'claude-3-5-haiku' THEN 0.8::DOUBLE ELSE 3.0::DOUBLE END AS ri,
          CASE model WHEN 'claude-opus-4-5' THEN 25.0::DOUBLE WHEN 'claude-3-5-haiku' THEN 4.0::DOUBLE ELSE 15.0::DOUBLE END AS ro
          FROM u JOIN documents s ON s.doc_id=u.served),
    q AS (SELECT *, (input_tokens*ri+output_tokens*ro)/1000000 AS c FROM p)
    SELECT sha256(source || '|' || request_id) AS id, request_id, tier, tier<>'miss' AS cache_hit, model, input_tokens, output_tokens, (length(text) % 1000)::INT AS latency_ms,
           round(c,6) AS cost_usd, CASE WHEN tier<>'miss' THEN round(c,6) ELSE 0.0 END AS cost_saved_usd, CASE WHEN tier<>'miss' THEN 0.0 ELSE round(c,6) END AS spend_usd FROM q"""
)

ORACLE["top_prompts_limited"] = "WITH " + REQS + """,
    k AS (SELECT '{"messages":[{"content":[{"text":' || CAST(to_json(text) AS VARCHAR) || ',"type":"text"}],"role":"user"}]' || CASE WHEN family IS NULL THEN '' ELSE ',"model":"' || family || '"' END || '}' AS c, n FROM firsts)
    SELECT sha256(c) AS prompt_hash, sha256(c) AS text_hash, n-1 AS hit_count FROM k WHERE n > 1 ORDER BY n DESC, sha256(c) LIMIT 20"""

ORACLE["similarity_newest_blocks"] = ORACLE["similarity_newest"]
ORACLE["stream_metric_rows"] = ORACLE["metric_rows"]
ORACLE["stream_resolution"] = ORACLE["tiered_resolution"]
ORACLE["similarity_scored"] = _HEAD + _EARLIER + """,
    best AS (SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY n.a ORDER BY score DESC, n.b) AS rn
             FROM near n JOIN verdict v ON v.a=n.a AND v.b=n.b JOIN reqs p ON p.request_id=n.a JOIN reqs q ON q.request_id=n.b
             WHERE n.fits AND v.safe AND (length(p.text) + length(q.text)) % 3 <> 0) WHERE rn=1)
    SELECT a AS request_id, b AS matched_id, round(score,6) AS score, 0::BIGINT AS n_failed FROM best"""
ORACLE["pair_scan"] = "WITH " + PAIRS + """ SELECT expect, count(*) AS n_pairs, count(*) FILTER (WHERE pair_id % 5 = 0) AS n_odd,
    CAST(sum(length(a) + 2 * length(b)) AS BIGINT) AS n_chars, count(DISTINCT sha256(a || '|' || b)) AS n_distinct FROM pairs GROUP BY 1"""
ORACLE["pair_faults"] = "WITH " + PAIRS + """ SELECT eval_set, count(*) AS n_pairs, count(*) < 30 AS too_small,
    count(*) FILTER (WHERE pair_id % 13 = 0 OR pair_id % 17 = 0) AS bad_labels,
    count(*) FILTER (WHERE regexp_replace(a,'\\s','','g') = '' OR pair_id % 23 = 0 OR regexp_replace(b,'\\s','','g') = '') AS blank_texts,
    count(*) FILTER (WHERE pair_id % 19 = 0) AS odd_keys FROM pairs GROUP BY 1"""


def _wilson(k: str, n: str, sign: str) -> str:
    """One end of the 95 % interval, clipped; (0, 0) without cases."""
    p = f"({k}::DOUBLE/{n})"
    return (f"CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ({p} + 3.8416/(2*{n}) {sign} 1.96*sqrt({p}*(1-{p})/{n} + 3.8416/(4.0*{n}*{n})))"
            f"/(1 + 3.8416/{n}))) END")


ORACLE["sweep_intervals"] = "WITH " + SCORED + "," + confusion_sql(SWEEP) + f""" SELECT pipeline, thr, tp, fp,
    round({_wilson('tp', 'n_hit', '-')},6) AS recall_low, round({_wilson('tp', 'n_hit', '+')},6) AS recall_high,
    round({_wilson('fp', 'n_miss', '-')},6) AS false_hit_low, round({_wilson('fp', 'n_miss', '+')},6) AS false_hit_high FROM sweep"""
ORACLE["fact_faults"] = f"""WITH {PRICED}, f AS (SELECT cache_hit, cost_usd, similarity_score = 1.0 AS exact,
      CASE WHEN id % 37 = 0 THEN 0.0 WHEN id % 41 = 0 THEN cost_usd WHEN cache_hit THEN cost_usd ELSE 0.0 END AS saved,
      CASE WHEN id % 43 = 0 THEN NULL WHEN id % 47 = 0 THEN 0.5 ELSE similarity_score END AS score FROM facts)
    SELECT count(*) FILTER (WHERE cache_hit AND saved <> cost_usd) AS hit_without_full_saving, count(*) FILTER (WHERE NOT cache_hit AND saved <> 0) AS miss_with_saving,
      count(*) FILTER (WHERE cache_hit AND score IS NULL) AS hit_without_score, count(*) FILTER (WHERE NOT cache_hit AND score IS NOT NULL) AS miss_with_score,
      count(*) FILTER (WHERE exact AND score <> 1.0) AS exact_hit_score_not_one FROM f"""
