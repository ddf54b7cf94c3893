"""DuckDB SQL that computes the registered queries independently."""

from __future__ import annotations

from ..config import DEFAULT
from ..functions.wordlists import ANAPHORA, SENTENCE_STARTERS, STOPWORDS
from .queries import ANSWERS, DATES, QUESTIONS, STAMPS

_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
STOP = _list(STOPWORDS)
NOISE = _list(sorted(set(STOPWORDS + SENTENCE_STARTERS)))
TURNS = """t0 AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM conversations),
turns AS (SELECT idx, idx + 1 AS id, CAST(conv_id AS VARCHAR) AS session_id, idx - min(idx) OVER (PARTITION BY conv_id) AS session_turn, role AS speaker, text, idx AS ts, conv_id || '-' || turn AS source_uuid FROM t0)"""
EVENTS = """e0 AS (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS idx FROM events),
turns AS (SELECT idx, CAST(user_id AS VARCHAR) AS session_id, event_type AS speaker, event_type || ' ' || props AS text, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(event_id AS VARCHAR) AS source_uuid FROM e0)"""
QS = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in QUESTIONS) + ") v(query_id, text))"


def tokens(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[\\pL\\pM\\pN'']+'), lambda x: lower(trim(x, ''''))), lambda x: x <> '')"


def content(c: str) -> str:
    return f"list_filter({tokens(c)}, lambda x: strlen(x) > 1 AND NOT list_contains({STOP}, x))"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def sentences(c: str) -> str:
    marked = f"regexp_replace(regexp_replace({c}, '([.!?])([\\t\\n\\v\\f\\r ]|$)', '\\1' || chr(2) || '\\2', 'g'), '\\n', chr(10) || chr(2), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(2)), lambda s: {strip('s')}), lambda s: s <> '')"


_ALNUM = "\\pL\\pM\\pN"
_CAP = f"\\p{{Lu}}[{_ALNUM}''.\\-]*"
_SPAN = f"(\\x01? {_CAP} (?: {_CAP} | (?:of|the|and|de|da|di|van|von|la|le)  {_CAP} )*)"
NAMES = f"""n1 AS (SELECT idx, row_number() OVER (PARTITION BY idx) AS k, s FROM (SELECT idx, unnest({sentences("text")}) AS s FROM turns)),
n2 AS (SELECT idx, k, chr(1) || array_to_string(list_transform(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''), lambda w: ' ' || regexp_replace(regexp_replace(w, '^[^{_ALNUM}''.\\-]+', ''), '[^{_ALNUM}''.\\-]+$', '') || ' '), '') AS p FROM n1),
n3 AS (SELECT idx, k, generate_subscripts(m, 1) AS j, unnest(m) AS span FROM (SELECT idx, k, regexp_extract_all(p, '{_SPAN}', 1) AS m FROM n2)),
n4 AS (SELECT idx, k, j, starts_with(span, chr(1)) AS first, list_filter(regexp_split_to_array(replace(span, chr(1), ''), ' +'), lambda w: w <> '') AS w FROM n3),
n5 AS (SELECT idx, k, j, regexp_replace(array_to_string(w, ' '), '\\.+$', '') AS display FROM n4
  WHERE CASE WHEN first AND len(w) = 1 THEN NOT list_contains({NOISE}, lower(w[1])) AND strlen(w[1]) > 2 ELSE len(list_filter(w, lambda x: NOT list_contains({NOISE}, lower(x)))) > 0 END),
mentions AS (SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY k, j) AS pos, display, array_to_string(list_transform(regexp_split_to_array(display, '\\s+'), lambda x: regexp_replace(lower(x), '''s$', '')), ' ') AS canon FROM n5 WHERE display <> '')"""
EDGES = f"""{NAMES},
ents AS (SELECT canon, arg_min(display, idx * 1048576 + pos) AS display, min(idx * 1048576 + pos) AS eid FROM mentions GROUP BY canon),
pairs AS (SELECT idx, canon, count(*) AS cnt FROM mentions GROUP BY 1, 2),
edges AS (SELECT idx, canon, cnt, cnt / sum(cnt) OVER (PARTITION BY idx) AS w_turn, cnt / sum(cnt) OVER (PARTITION BY canon) AS w_entity FROM pairs)"""
ADJ = "adj AS (SELECT a.idx, b.idx AS other FROM turns a JOIN turns b ON a.session_id = b.session_id AND abs(a.idx - b.idx) = 1)"
BM25 = f"""kw AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({content("text")}) AS term FROM q) GROUP BY 1, 2),
tk AS (SELECT idx, {content("text")} AS t FROM turns),
st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM tk),
tf AS (SELECT idx, dl, term, count(*) AS tf FROM (SELECT idx, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, idx, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM kw JOIN tf USING (term) JOIN dfs USING (term), st GROUP BY 1, 2)"""
_FNV = "list_reduce(list_transform(range(0, strlen(f)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS UHUGEINT)), lambda x, y: (xor(x, y) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


def vectors(source: str, key: str, out: str) -> str:
    """Sparse unit vectors (key, bucket, v) of the texts of a relation."""
    return f"""{out}1 AS (SELECT {key}, unnest({tokens("text")}) AS tok FROM {source}),
{out}2 AS (SELECT {key}, tok, CASE WHEN list_contains({STOP}, tok) THEN 0.2 ELSE 1.0 END AS w FROM {out}1),
{out}3 AS (SELECT {key}, tok AS f, w FROM {out}2 UNION ALL SELECT {key}, unnest(list_transform(range(1, length(tok) + 1), lambda i: substr('^' || tok || '$', i, 3))) AS f, 0.4 * w FROM {out}2),
{out}4 AS (SELECT f, {_FNV} AS h FROM (SELECT DISTINCT f FROM {out}3)),
{out}5 AS (SELECT {key}, CAST(h % 256 AS BIGINT) AS bucket, sum(CASE WHEN CAST((h // 4294967296::UHUGEINT) % 2 AS INTEGER) = 1 THEN -w ELSE w END) AS v FROM {out}3 JOIN {out}4 USING (f) GROUP BY 1, 2),
{out} AS (SELECT {key}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {out}5)"""


SIMS = f"""{vectors("turns", "idx", "tv")}, {vectors("q", "query_id", "qv")},
sims AS (SELECT query_id, idx, sum(tv.v * qv.v) AS sim FROM tv JOIN qv USING (bucket) GROUP BY 1, 2)"""
BASE = f"""{SIMS}, {BM25},
base AS (SELECT query_id, idx, sum(p) AS base FROM (SELECT query_id, idx, 0.5 * sim AS p FROM sims WHERE sim > 0 UNION ALL SELECT query_id, idx, 0.5 * score / greatest(max(score) OVER (PARTITION BY query_id), 1e-6) FROM bm) GROUP BY 1, 2)"""


def hierarchy(gap: int = DEFAULT.episode_gap) -> str:
    return f"""seg0 AS (SELECT idx, session_id, ts, CASE WHEN lag(session_id) OVER (ORDER BY idx) IS DISTINCT FROM session_id OR ts - lag(ts) OVER (ORDER BY idx) > {gap} THEN idx END AS b FROM turns),
seg AS (SELECT idx, session_id, ts, max(b) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS segment FROM seg0),
members AS (SELECT *, segment + 4 * ((idx - segment) // 4) AS window_start FROM seg)"""


_DRIFT = """wu AS (SELECT window_start, segment, list(x ORDER BY pos) AS c FROM cent GROUP BY 1, 2),
wn AS (SELECT window_start, segment, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS u FROM wu),
lows AS (SELECT w.window_start, w.segment, row_number() OVER (ORDER BY w.window_start) AS k, coalesce(list_inner_product(a.u, b.u) < 0.35, false) AS low
  FROM wn w LEFT JOIN wn a ON a.window_start = w.window_start - 4 AND a.segment = w.segment LEFT JOIN wn b ON b.window_start = w.window_start - 8 AND b.segment = w.segment),
runs AS (SELECT *, k - coalesce(max(CASE WHEN NOT low THEN k END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS place FROM lows),
eps AS (SELECT window_start, segment, max(CASE WHEN window_start = segment OR (low AND place % 2 = 1) THEN window_start END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS episode FROM runs)"""
CONV_HIER = f"""{hierarchy()},
cent AS (SELECT window_start, segment, pos, sum(v) / n AS x FROM (SELECT m.window_start, m.segment, b.pos, coalesce(tv.v, 0) AS v, count(DISTINCT m.idx) OVER (PARTITION BY m.window_start) AS n FROM members m CROSS JOIN range(256) b(pos) LEFT JOIN tv ON tv.idx = m.idx AND tv.bucket = b.pos) GROUP BY 1, 2, 3, n),
{_DRIFT},
th AS (SELECT idx, session_id, ts, m.window_start, episode FROM members m JOIN eps USING (window_start))"""
EPISODE_BEAM = f"""{CONV_HIER},
es AS (SELECT query_id, episode, max(coalesce(base, 0)) + 0.1 * avg(coalesce(base, 0)) AS e_score FROM q CROSS JOIN th LEFT JOIN base USING (query_id, idx) GROUP BY 1, 2),
eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(e_score, 9) DESC, episode) AS e_rank FROM es) WHERE e_rank <= 4)"""
WINDOW_BEAM = f"""{EPISODE_BEAM},
ws AS (SELECT query_id, window_start, sum(x * v) / sqrt(any_value(nn)) AS sim FROM (SELECT window_start, pos, x, sum(x * x) OVER (PARTITION BY window_start) AS nn FROM cent) c JOIN qv ON qv.bucket = c.pos GROUP BY 1, 2),
wb0 AS (SELECT query_id, window_start, e_rank, max(coalesce(base, 0)) AS best FROM eb JOIN th USING (episode) LEFT JOIN base USING (query_id, idx) GROUP BY 1, 2, 3),
wb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w_score, 9) DESC, e_rank, window_start) AS w_rank FROM (SELECT *, 0.4 * greatest(coalesce(sim, 0), 0) + 0.6 * best AS w_score FROM wb0 LEFT JOIN ws USING (query_id, window_start))) WHERE w_rank <= 8)"""
# Profiles of the registered questions, as read off them by hand.
PROFILE = """pr AS (SELECT * FROM (VALUES (1, ['thha and erer'], ['thha and erer'], 0, 'Time', 0.4), (2, ['tion'], ['tion'], NULL, 'Person', 0.6), (3, ['onre and thea'], ['onre and thea'], NULL, 'List', 0.6),
(4, ['rethen', 'ble'], ['rethen', 'ble'], NULL, 'Number', 0.6), (5, ['thin'], ['thin'], -1, 'Place', 0.4), (6, ['is nobodyknown'], ['is nobodyknown'], NULL, 'Boolean', 0.4)) v(query_id, subjects, phrases, boundary, answer_type, w_graph))"""
HIER = f"""{WINDOW_BEAM}, {PROFILE}, {EDGES},
sp AS (SELECT session_id, row_number() OVER (ORDER BY min(idx)) - 1 AS pos, count(*) OVER () AS n FROM turns GROUP BY 1),
cn AS (SELECT idx, list(canon) AS canons FROM edges GROUP BY 1),
hier AS (SELECT query_id, idx, base * (1 + 0.25 * len(list_filter(subjects, lambda s: list_contains(coalesce(canons, []), s))) / len(subjects)
    + CASE WHEN boundary IS NULL THEN 0 WHEN (boundary = -1 AND pos = n - 1) OR pos = boundary THEN 0.3 ELSE -0.9 END
    + CASE WHEN answer_type IN ('Person', 'Entity', 'Place') AND canons IS NOT NULL THEN 0.15 ELSE 0 END
    + 0.1 * least(len(list_filter(phrases, lambda p: contains(lower(text), p))), 3)) AS score
  FROM wb JOIN th USING (window_start) JOIN base USING (query_id, idx) JOIN pr USING (query_id) JOIN turns USING (idx) JOIN sp ON sp.session_id = turns.session_id LEFT JOIN cn USING (idx))"""
ACT = f"""{EDGES}, {PROFILE},
{vectors("(SELECT canon, canon AS text FROM ents)", "canon", "ev")},
exact AS (SELECT DISTINCT query_id, canon, 1.0 AS a FROM (SELECT query_id, unnest(list_concat(subjects, phrases)) AS canon FROM pr) JOIN ents USING (canon)),
near AS (SELECT query_id, arg_min(canon, (-round(sim, 9), eid)) AS canon, max(sim) AS a FROM (SELECT query_id, canon, eid, sum(ev.v * qv.v) AS sim FROM ev JOIN qv USING (bucket) JOIN ents USING (canon) GROUP BY 1, 2, 3) WHERE sim > 0.55 AND query_id NOT IN (SELECT query_id FROM exact) GROUP BY 1),
a0 AS (SELECT * FROM exact UNION ALL SELECT * FROM near)""" + "".join(
    f""",
b{i} AS (SELECT query_id, e2.canon, sum(a * sim) AS a FROM a{i - 1} a JOIN edges e1 USING (canon) JOIN sims s USING (query_id, idx) JOIN edges e2 ON e2.idx = e1.idx AND e2.canon <> e1.canon WHERE sim > 0 GROUP BY 1, 2),
c{i} AS (SELECT query_id, canon, sum(a) AS a FROM (SELECT query_id, canon, a FROM a{i - 1} UNION ALL SELECT * FROM b{i}) GROUP BY 1, 2),
a{i} AS (SELECT query_id, canon, a / max(a) OVER (PARTITION BY query_id) AS a FROM c{i})"""
    for i in (1, 2)
)
TRANS = f"""{ADJ},
cnt AS (SELECT t.idx, coalesce(ne, 0) AS ne, coalesce(na, 0) AS na FROM turns t LEFT JOIN (SELECT idx, count(*) AS ne FROM edges GROUP BY 1) USING (idx) LEFT JOIN (SELECT idx, count(*) AS na FROM adj GROUP BY 1) USING (idx)),
trans AS (SELECT 'e' || canon AS src, 't' || idx AS dst, w_entity AS p FROM edges UNION ALL SELECT 't' || idx, 'e' || canon, 0.8 * w_turn FROM edges
  UNION ALL SELECT 't' || idx, 't' || other, CASE WHEN ne > 0 THEN 0.2 ELSE 1.0 END / na FROM adj JOIN cnt USING (idx) UNION ALL SELECT 't' || idx, 't' || idx, 1.0 FROM cnt WHERE ne = 0 AND na = 0)"""
# What comes before the recursion is nested, as WITH RECURSIVE reads its unions differently.
_START = f"""WITH {TURNS}, {QS}, {SIMS}, {ACT},
s0 AS (SELECT query_id, 'e' || canon AS node, 'e' AS side, a AS v FROM a2 WHERE a > 0 UNION ALL SELECT query_id, 't' || idx, 't', sim FROM sims WHERE sim > 0)
SELECT query_id, node, v / sum(v) OVER (PARTITION BY query_id, side) / (SELECT count(DISTINCT side) FROM s0 x WHERE x.query_id = s0.query_id) AS r FROM s0"""
RANK = f"""r1 AS MATERIALIZED (SELECT * FROM ({_START})), tr AS MATERIALIZED (SELECT * FROM (WITH {TURNS}, {EDGES}, {TRANS} SELECT src, dst, p FROM trans)),
pi AS (SELECT 0 AS step, query_id, node, r AS m FROM r1
  UNION ALL SELECT step, query_id, node, sum(m) FROM (
    SELECT pi.step + 1 AS step, pi.query_id, tr.dst AS node, 0.6 * m * p AS m FROM pi JOIN tr ON tr.src = pi.node WHERE pi.step < 30
    UNION ALL SELECT s.step + 1, r1.query_id, r1.node, 0.4 * r FROM r1, (SELECT DISTINCT step FROM pi WHERE step < 30) s) GROUP BY ALL),
rk AS (SELECT query_id, CAST(substr(node, 2) AS BIGINT) AS idx, m AS mass FROM pi WHERE step = 30 AND node LIKE 't%')"""
_EMB = "v AS (SELECT vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), f AS (SELECT label AS query_id, arg_min(vec, idx) AS qvec FROM v GROUP BY 1), s AS (SELECT query_id, idx, list_inner_product(vec, qvec) AS sim FROM v, f)"
_EMB_TURNS = f"""t0 AS (SELECT *, row_number() OVER (ORDER BY label, vec_id) - 1 AS idx FROM embeddings), turns AS (SELECT idx, CAST(label AS VARCHAR) AS session_id, 0 AS ts FROM t0), {hierarchy()},
cent AS (SELECT window_start, segment, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT window_start, segment, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM members JOIN t0 USING (idx)) GROUP BY 1, 2, 3)"""
_MASK = "[^\\pL\\pN_]"
_MON = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Sept|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"

_OUT = "STRUCT(idx BIGINT, score DOUBLE, role VARCHAR, anchor BIGINT)[]"
BEST_BM25 = "m AS (SELECT * FROM (SELECT query_id, idx AS anchor, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx) AS r FROM bm) WHERE r <= 5)"
# From m (query_id, r, anchor, score), turns, edges and ents: mains in turn take their best bridge and neighbours not yet taken.
CLOSE = f"""rad AS (SELECT *, CASE WHEN strlen(text) < 48 OR list_contains({_list(ANAPHORA)}, lower(regexp_extract(text, '\\S+'))) THEN 2 ELSE 1 END AS radius FROM turns),
c1 AS (SELECT query_id, anchor, d.idx, least(a.w_turn, d.w_turn) AS s, eid FROM m JOIN edges a ON a.idx = m.anchor JOIN edges d ON d.canon = a.canon AND d.idx <> m.anchor JOIN ents e ON e.canon = a.canon),
c2 AS (SELECT query_id, anchor, idx, max(s) AS s, arg_max(eid, (s, -eid)) AS eid FROM c1 GROUP BY 1, 2, 3),
bl AS (SELECT query_id, anchor, list(idx ORDER BY round(s, 12) DESC, eid, idx) AS bs FROM c2 GROUP BY 1, 2),
nb AS (SELECT a.idx AS anchor, list(b.idx ORDER BY b.idx) AS ns FROM rad a JOIN turns b ON a.session_id = b.session_id AND a.idx <> b.idx AND abs(a.idx - b.idx) <= radius GROUP BY 1),
mm AS (SELECT m.*, coalesce(bs, []) AS bs, coalesce(ns, []) AS ns FROM m LEFT JOIN bl USING (query_id, anchor) LEFT JOIN nb USING (anchor)),
fold AS (SELECT query_id, CAST(0 AS BIGINT) AS k, list(anchor ORDER BY r) AS seen, CAST([] AS {_OUT}) AS got FROM m GROUP BY 1
  UNION ALL SELECT query_id, k + 1, seen || b || ns, got || list_transform(b, lambda x: {{'idx': x, 'score': score * 0.5, 'role': 'GraphBridge', 'anchor': anchor}}) || list_transform(ns, lambda x: {{'idx': x, 'score': score * 0.5, 'role': 'LocalNeighbor', 'anchor': anchor}})
  FROM (SELECT query_id, k, seen, got, b, list_filter(ns, lambda x: NOT list_contains(seen || b, x)) AS ns, anchor, score
    FROM (SELECT fold.*, anchor, score, ns, list_slice(list_filter(bs, lambda x: NOT list_contains(seen, x)), 1, 1) AS b FROM fold JOIN mm ON mm.query_id = fold.query_id AND mm.r = fold.k + 1))),
closed AS (SELECT query_id, anchor AS idx, score, 'Main' AS role, anchor, r - 1 AS emit FROM m
  UNION ALL SELECT query_id, x.idx, x.score, x.role, x.anchor, n + i - 1 FROM (SELECT query_id, n, unnest(got) AS x, generate_subscripts(got, 1) AS i FROM fold JOIN (SELECT query_id, count(*) AS n FROM m GROUP BY 1) USING (query_id) WHERE k = n))"""
# No question of the six asks for the latest date or number, so supersession (see superseded_values) takes nothing away.
CALIBRATE = """zp AS (SELECT session_id, row_number() OVER (ORDER BY min(idx)) - 1 AS pos, count(*) OVER () AS n FROM turns GROUP BY 1),
ad AS (SELECT closed.* FROM closed JOIN turns USING (idx) JOIN zp USING (session_id) JOIN pr USING (query_id) WHERE boundary IS NULL OR CASE WHEN boundary = -1 THEN pos = n - 1 ELSE pos = boundary END),
ma AS (SELECT query_id, idx, score, role, m_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx) AS m_rank FROM ad WHERE role = 'Main') WHERE m_rank <= 5),
su AS (SELECT * FROM (SELECT ad.query_id, ad.idx, ad.score, ad.role, m_rank, row_number() OVER (PARTITION BY ad.query_id, ad.anchor ORDER BY CASE ad.role WHEN 'GraphBridge' THEN 1 ELSE 2 END, abs(ad.idx - ad.anchor), emit) AS s_rank
  FROM ad JOIN ma ON ma.query_id = ad.query_id AND ma.idx = ad.anchor WHERE ad.role <> 'Main' AND NOT EXISTS (SELECT 1 FROM ma o WHERE o.query_id = ad.query_id AND o.idx = ad.idx)) WHERE s_rank <= 2),
it AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m_rank, s_rank) AS i FROM (SELECT *, 0 AS s_rank FROM ma UNION ALL SELECT * FROM su)),
pick AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS seen, CAST([] AS STRUCT(idx BIGINT, score DOUBLE, role VARCHAR)[]) AS got FROM it
  UNION ALL SELECT query_id, i, CASE WHEN ok THEN seen || [idx] ELSE seen END, CASE WHEN ok THEN got || [{'idx': idx, 'score': score, 'role': role}] ELSE got END
  FROM (SELECT it.*, seen, got, s_rank = 0 OR (len(got) < 10 AND NOT list_contains(seen, it.idx)) AS ok FROM pick JOIN it ON it.query_id = pick.query_id AND it.i = pick.i + 1)),
ev AS (SELECT query_id, CAST(k AS INTEGER) AS rank, x.idx AS idx, x.score AS score, x.role AS role FROM (SELECT query_id, unnest(got) AS x, generate_subscripts(got, 1) AS k FROM pick JOIN (SELECT query_id, max(i) AS i FROM it GROUP BY 1) USING (query_id, i)))"""
GRAPH = "gs AS (SELECT query_id, idx, mass * (1 + 0.25 * len(list_filter(phrases, lambda p: p <> '' AND contains(lower(text), p)))) AS score FROM rk JOIN turns USING (idx) JOIN pr USING (query_id) WHERE mass > 0)"
FUSED = f"""{GRAPH},
hs AS (WITH {TURNS}, {QS}, {BASE}, {HIER} SELECT query_id, idx, score FROM hier WHERE score > 0),
fv AS (SELECT query_id, idx, 'g' AS view, score FROM gs UNION ALL SELECT query_id, idx, 'h', score FROM hs),
fs AS (SELECT query_id, idx, view, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM fv WINDOW w AS (PARTITION BY query_id, view)),
ff AS (SELECT query_id, idx, sum(x * CASE view WHEN 'g' THEN w_graph ELSE 1 - w_graph END) AS score FROM fs JOIN pr USING (query_id) GROUP BY 1, 2),
m AS (SELECT * FROM (SELECT query_id, idx AS anchor, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx) AS r FROM ff) WHERE r <= 5)"""
_CLOSED = "SELECT query_id, idx, round(score, 6) AS score, role, anchor, CAST(emit AS INTEGER) AS emit FROM closed"

ORACLES: dict[str, str] = {
    "ingest_session_ordinals": f"WITH {TURNS} SELECT idx, id, session_id, session_turn, speaker, ts, source_uuid FROM turns",
    "ingest_dedup_uuid": f"WITH {EVENTS} SELECT DISTINCT source_uuid, session_id, speaker, ts FROM turns WHERE speaker <> 'purchase'",
    "ingest_numbering": f"WITH {EVENTS} SELECT source_uuid, session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 + (SELECT count(*) FROM turns s WHERE s.session_id = t.session_id AND s.speaker = 'signup') AS session_turn FROM turns t WHERE speaker <> 'signup'",
    "incremental_scan_hwm": f"WITH {TURNS} SELECT id, session_id, text FROM turns WHERE id > 100",
    "forget_session": f"WITH {TURNS} SELECT session_id, count(*) AS n_turns, min(id) AS first_id FROM turns WHERE session_id NOT IN (SELECT session_id FROM turns WHERE speaker = 'system') GROUP BY 1",
    "store_stats": f"WITH {TURNS} SELECT count(*) AS turns, count(DISTINCT session_id) AS sessions, max(session_turn) AS longest FROM turns",
    "engine_stats": f"WITH {TURNS}, {QS}, {SIMS}, {CONV_HIER}, {EDGES} SELECT (SELECT count(*) FROM turns) AS turns, (SELECT count(DISTINCT session_id) FROM turns) AS sessions, (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM eps) AS windows, (SELECT count(DISTINCT episode) FROM eps) AS episodes, 'hash-v1-256' AS embedder",
    "session_order": f"WITH {TURNS} SELECT session_id, row_number() OVER (ORDER BY min(idx)) - 1 AS pos, row_number() OVER (ORDER BY min(idx) DESC) = 1 AS last FROM turns GROUP BY 1",
    "token_frequencies": f"WITH {TURNS} SELECT token, count(*) AS n FROM (SELECT unnest({tokens('text')}) AS token FROM turns) GROUP BY 1",
    "content_token_frequencies": f"SELECT token, count(*) AS n FROM (SELECT unnest({content('text')}) AS token FROM documents) GROUP BY 1",
    "sentence_counts": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS n_kept FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "masked_code": "SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)```.*?```', ' ', 'g'), '`[^`\\n]+`', ' ', 'g')) AS masked FROM pages",
    "pattern_entities": f"""WITH m AS (SELECT doc_id, text AS c, regexp_replace(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.-]+', ' ', 'g') AS m0 FROM documents),
x AS (SELECT doc_id, 'Url' AS kind, unnest(regexp_extract_all(c, 'https?://\\S+')) AS d FROM m UNION ALL
SELECT doc_id, 'Email', unnest(regexp_extract_all(c, '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.-]+')) FROM m UNION ALL
SELECT doc_id, 'Date', unnest(regexp_extract_all(c, '(?:^|{_MASK})(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:$|{_MASK})', 1)) FROM m UNION ALL
SELECT doc_id, 'Date', unnest(regexp_extract_all(m0, '(?:^|{_MASK})({_MON}\\.?\\s+\\d{{1,2}}(?:st|nd|rd|th)?(?:,?\\s+\\d{{4}})?)(?:$|{_MASK})', 1)) FROM m UNION ALL
SELECT doc_id, 'Date', unnest(regexp_extract_all(m0, '(?:^|{_MASK})((?:19|20)\\d{{2}})(?:$|{_MASK})', 1)) FROM m UNION ALL
SELECT doc_id, 'Number', d FROM (SELECT doc_id, unnest(regexp_extract_all(' ' || regexp_replace(m0, '({_MASK})(?:19|20)\\d{{2}}({_MASK})', '\\1 \\2', 'g'), '{_MASK}(\\d+(?:[,.]\\d+)*%?)', 1)) AS d FROM m) WHERE strlen(d) > 1 OR CAST(d AS INTEGER) > 1 UNION ALL
SELECT doc_id, 'Quote', d FROM (SELECT doc_id, unnest(regexp_extract_all(c, '"([^"]{{2,120}})"', 1)) AS d FROM m) WHERE regexp_matches(d, '\\pL') AND NOT regexp_matches(d, '^-|&&|\\$\\(|`|\\{{|\\}}|\\\\|--'))
SELECT doc_id, kind, array_to_string(list_transform(list_filter(regexp_split_to_array(d, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), '''s$', '')), ' ') AS canon, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "named_spans": f"WITH {TURNS}, {NAMES} SELECT idx, canon, count(*) AS n FROM mentions GROUP BY 1, 2",
    "entity_catalog": f"WITH {TURNS}, {EDGES} SELECT canon, display, 'Named' AS kind, eid // 1048576 AS first_idx FROM ents",
    "edge_weights": f"WITH {TURNS}, {EDGES} SELECT idx, canon, cnt, round(w_turn, 9) AS w_turn, round(w_entity, 9) AS w_entity FROM edges",
    "turn_adjacency": f"WITH {TURNS}, {ADJ} SELECT idx, other FROM adj",
    "transition_mass": f"WITH {TURNS}, {EDGES}, {TRANS} SELECT src, count(*) AS n_out, round(sum(p), 9) AS p_out FROM trans WHERE src LIKE 't%' GROUP BY 1",
    "bm25_topk": f"WITH {TURNS}, {QS}, {BM25} SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx) AS INTEGER) AS rank, idx, round(score, 6) AS score FROM bm) WHERE rank <= 5",
    "bm25_scores": f"WITH {TURNS}, {QS}, {BM25} SELECT query_id, idx, round(score, 6) AS score FROM bm",
    "phrase_match_counts": f"WITH {TURNS} SELECT idx, CAST(len(list_filter(['the tion', 'ering', 'tion', 'ering', 'und'], lambda p: contains(lower(text), p))) AS BIGINT) AS n FROM turns",
    "fnv1a_tokens": f"WITH {TURNS}, k AS (SELECT DISTINCT unnest({tokens('text')}) AS f FROM turns), h AS (SELECT f, {_FNV} AS h FROM k) SELECT f AS token, CAST(h // 4294967296::UHUGEINT AS BIGINT) AS hi, CAST(h % 4294967296::UHUGEINT AS BIGINT) AS lo FROM h",
    "hash_embedding_cells": f"WITH {TURNS}, {vectors('turns', 'idx', 'tv')} SELECT idx, bucket, round(v, 6) AS v FROM tv WHERE abs(v) > 1e-9",
    "hash_similarities": f"WITH {TURNS}, {QS}, {SIMS} SELECT query_id, idx, round(sim, 6) AS sim FROM sims WHERE abs(sim) > 1e-6",
    "dense_topk": f"WITH {_EMB} SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, idx) AS INTEGER) AS rank, idx, round(sim, 6) AS sim FROM s) WHERE rank <= 5",
    "dense_alignment": f"WITH {_EMB} SELECT query_id, arg_min(idx, (-round(sim, 9), idx)) AS idx, round(max(sim), 6) AS sim FROM s WHERE sim > 0.55 GROUP BY 1",
    "segments_and_windows": f"WITH {EVENTS}, {hierarchy()} SELECT idx, session_id, segment, window_start FROM members",
    "gap_episodes": "WITH " + EVENTS.replace("ORDER BY user_id, ts, event_id", "ORDER BY ts, event_id") + f", {hierarchy()} SELECT segment, max(idx) AS end_idx, count(*) AS n, min(session_id) AS session_id FROM members GROUP BY 1",
    "window_centroids": f"WITH {_EMB_TURNS} SELECT window_start, end_idx, n, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM cent JOIN (SELECT window_start, max(idx) AS end_idx, count(*) AS n FROM members GROUP BY 1) USING (window_start)",
    "drift_episodes": f"WITH {_EMB_TURNS}, {_DRIFT} SELECT window_start, segment, episode, n FROM eps JOIN (SELECT window_start, count(*) AS n FROM members GROUP BY 1) USING (window_start)",
    "query_profiles": f"""WITH {QS}, {PROFILE}, l AS (SELECT *, lower(text) AS w FROM q),
d AS (SELECT query_id, {content("text")} AS kw, list_filter(['yesterday', 'last week', 'last month', 'last year', 'recently', 'earlier'], lambda m: contains(w, m)) AS mk, contains(w, 'latest') AS late,
  regexp_matches(w, '\\b(how many times|how often|every time|all the|list all|which all|both|each time)\\b') AS agg, regexp_extract(w, '\\b(first|second|last)\\s+(?:conversation|session)\\b', 1) AS b,
  CASE WHEN w LIKE 'who%' THEN 'Person' WHEN w LIKE 'when%' THEN 'Time' WHEN w LIKE 'where%' THEN 'Place' WHEN w LIKE '%how many%' THEN 'Number' WHEN w LIKE '%what are%' THEN 'List' WHEN w LIKE 'is %' THEN 'Boolean' ELSE 'Open' END AS kind FROM l),
r AS (SELECT *, CASE WHEN (b <> '' OR len(mk) > 0 OR kind = 'Time') AND NOT agg THEN 'Local' ELSE 'Relational' END AS route FROM d)
SELECT r.query_id, array_to_string(subjects, '|') AS subjects, array_to_string(phrases, '|') AS phrases, array_to_string(kw, '|') AS keywords, array_to_string(mk, '|') AS mentions, kind AS answer_type,
  CAST(CASE b WHEN 'first' THEN 0 WHEN 'last' THEN -1 END AS INTEGER) AS boundary, agg AS aggregation, CASE WHEN late OR len(mk) > 0 THEN 'Latest' END AS prefer, route, CASE route WHEN 'Local' THEN 0.4 ELSE 0.6 END::DOUBLE AS w_graph, CASE route WHEN 'Local' THEN 0.6 ELSE 0.4 END::DOUBLE AS w_hier
FROM r JOIN pr USING (query_id)""",
    "date_ranges": f"""WITH d AS (SELECT unnest({_list(DATES)}) AS mention),
p AS (SELECT mention, CASE
  WHEN regexp_matches(mention, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(mention, '%Y-%m-%d')
  WHEN regexp_matches(mention, '^[a-z]+\\.? \\d{{1,2}}(st|nd|rd|th)?,? \\d{{4}}$') THEN try_strptime(regexp_replace(mention, '^([a-z]{{3}})[a-z]*\\.? (\\d{{1,2}})(?:st|nd|rd|th)?,? (\\d{{4}})$', '\\2 \\1 \\3'), '%d %b %Y')
  WHEN regexp_matches(mention, '^\\d{{1,2}}(st|nd|rd|th)? [a-z]+\\.? \\d{{4}}$') THEN try_strptime(regexp_replace(mention, '^(\\d{{1,2}})(?:st|nd|rd|th)? ([a-z]{{3}})[a-z]*\\.? (\\d{{4}})$', '\\1 \\2 \\3'), '%d %b %Y') END AS day,
  CASE WHEN regexp_matches(mention, '^[a-z]+ \\d{{4}}$') THEN try_strptime('1 ' || regexp_replace(mention, '^([a-z]{{3}})[a-z]* ', '\\1 '), '%d %b %Y') END AS mon,
  CASE WHEN regexp_matches(mention, '^(19|20)\\d{{2}}$') THEN make_timestamp(CAST(mention AS BIGINT), 1, 1, 0, 0, 0) END AS yr FROM d)
SELECT mention, CAST(epoch(coalesce(day, mon, yr)) AS BIGINT) AS lo, CAST(epoch(CASE WHEN day IS NOT NULL THEN day + INTERVAL 1 DAY WHEN mon IS NOT NULL THEN mon + INTERVAL 1 MONTH ELSE yr + INTERVAL 1 YEAR END) AS BIGINT) - 1 AS hi FROM p""",
    "iso_timestamps": f"SELECT s AS stamp, CASE WHEN s LIKE '%Z' AND s NOT LIKE '%:60Z' THEN CAST(floor(epoch(coalesce(try_strptime(regexp_replace(s, '\\.\\d+Z$', 'Z'), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(s, '%Y-%m-%dT%H:%MZ')))) AS BIGINT) END AS seconds FROM (SELECT unnest({_list(STAMPS)}) AS s)",
    "episode_beam": f"WITH {TURNS}, {QS}, {BASE}, {EPISODE_BEAM} SELECT query_id, episode, CAST(e_rank AS INTEGER) AS e_rank, round(e_score, 6) AS e_score FROM eb",
    "window_beam": f"WITH {TURNS}, {QS}, {BASE}, {WINDOW_BEAM} SELECT query_id, window_start, CAST(w_rank AS INTEGER) AS w_rank, round(w_score, 6) AS w_score FROM wb",
    "hier_scores": f"WITH {TURNS}, {QS}, {BASE}, {HIER} SELECT query_id, idx, round(score, 6) AS score FROM hier WHERE score > 0",
    "activation_propagation": f"WITH {TURNS}, {QS}, {SIMS}, {ACT} SELECT query_id, canon, round(a, 6) AS a FROM a2",
    "personalized_pagerank": f"WITH RECURSIVE {RANK} SELECT query_id, idx, round(mass, 6) AS mass FROM rk WHERE mass > 1e-6",
    "minmax_fusion": f"""WITH {TURNS}, {QS}, {SIMS}, {BM25}, {PROFILE},
v AS (SELECT query_id, idx, 'g' AS view, score FROM bm UNION ALL SELECT query_id, idx, 'h', sim FROM sims WHERE sim > 1e-9),
s AS (SELECT query_id, idx, view, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM v WINDOW w AS (PARTITION BY query_id, view)),
f AS (SELECT query_id, idx, sum(x * CASE view WHEN 'g' THEN w_graph ELSE 1 - w_graph END) AS score FROM s JOIN pr USING (query_id) GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx) AS INTEGER) AS rank, idx, round(score, 6) AS score FROM f) WHERE rank <= 5""",
    "local_neighbours": f"WITH {TURNS}, r AS (SELECT *, CASE WHEN strlen(text) < 48 OR list_contains({_list(ANAPHORA)}, lower(regexp_extract(text, '\\S+'))) THEN 2 ELSE 1 END AS radius FROM turns) SELECT a.idx AS anchor, b.idx, CAST(b.idx - a.idx AS INTEGER) AS delta FROM r a JOIN turns b ON a.session_id = b.session_id AND a.idx <> b.idx AND abs(a.idx - b.idx) <= radius",
    "graph_bridges": f"""WITH {TURNS}, {QS}, {BM25}, {EDGES},
m AS (SELECT * FROM (SELECT query_id, idx AS anchor, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, idx) AS r FROM bm) WHERE r <= 5),
c AS (SELECT query_id, anchor, d.idx, least(a.w_turn, d.w_turn) AS s, eid FROM m JOIN edges a ON a.idx = m.anchor JOIN edges d ON d.canon = a.canon AND d.idx <> m.anchor JOIN ents e ON e.canon = a.canon),
g AS (SELECT query_id, anchor, idx, max(s) AS s, arg_max(eid, (s, -eid)) AS eid FROM c GROUP BY 1, 2, 3)
SELECT * FROM (SELECT query_id, anchor, idx, CAST(row_number() OVER (PARTITION BY query_id, anchor ORDER BY round(s, 12) DESC, eid, idx) AS INTEGER) AS b_rank, round(s, 6) AS strength FROM g) WHERE b_rank <= 3""",
    "bm25_closure": f"WITH RECURSIVE {TURNS}, {QS}, {BM25}, {EDGES}, {BEST_BM25}, {CLOSE} {_CLOSED}",
    "bm25_evidence": f"WITH RECURSIVE {TURNS}, {QS}, {BM25}, {EDGES}, {PROFILE}, {BEST_BM25}, {CLOSE}, {CALIBRATE} SELECT query_id, rank, idx, round(score, 6) AS score, role FROM ev",
    "graph_scores": f"WITH RECURSIVE {RANK}, {TURNS}, {PROFILE}, {GRAPH} SELECT query_id, idx, round(score, 6) AS score FROM gs WHERE score > 1e-6",
    "evidence_closure": f"WITH RECURSIVE {RANK}, {TURNS}, {PROFILE}, {EDGES}, {FUSED}, {CLOSE} {_CLOSED}",
    "recall": f"""WITH RECURSIVE {RANK}, {TURNS}, {PROFILE}, {EDGES}, {FUSED}, {CLOSE}, {CALIBRATE}
SELECT query_id, CASE WHEN w_graph > 0.5 THEN 'Relational' ELSE 'Local' END AS route, rank, id AS turn_id, session_id, session_turn, speaker, text, ts, round(score, 6) AS score, role FROM ev JOIN turns USING (idx) JOIN pr USING (query_id)""",
    "superseded_values": f"WITH {EVENTS}, v AS (SELECT session_id || '/' || speaker AS query_id, idx, ts, regexp_extract(text, '(\\d+)', 1) AS x FROM turns) SELECT query_id, idx FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE a.query_id = b.query_id AND b.ts > a.ts AND b.x <> a.x)",
    "answer_calibration": "SELECT * FROM (VALUES (1, 'february 14, 2022', true, true, 'february 14, 2022'), (2, 'three cats', false, true, '12'), (3, 'red, blue', true, true, 'the red'), (4, 'maria lopez', true, true, 'maria lopez'), (5, 'nobody', false, false, 'john smith|maria lopez'), (6, '42', true, true, '42')) v(query_id, calibrated, changed, supported, candidates)",
    "transcript_turns": "SELECT * FROM (VALUES ('user', 'hello there', 1706695200::BIGINT, 'a'), ('assistant', E'one\\n\\ntwo', 0, 'b'), ('user', '[1] bracketed prose', 0, 'g')) v(speaker, text, ts, uuid)",
    "spool_stream_ingest": f"WITH {TURNS} SELECT session_id, speaker, source_uuid, ts, md5(text) AS text_md5 FROM turns",
}
assert len(ANSWERS) == 6
