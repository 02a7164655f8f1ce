"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from talweg.operators import evaluation
from talweg.plans.queries import DAY, QUESTIONS

_VALUES = ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS)


def _norm(x: str) -> str:
    return rf"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({_norm(x)}, '\s+'), lambda t: t <> '')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _plain(x: str) -> str:
    return "lower(" + _strip(rf"regexp_replace(strip_accents(coalesce({x}, '')), '\s+', ' ', 'g')") + ")"


_DOCS = "d AS (SELECT doc_id, text FROM documents)"
_TF = f"w AS (SELECT doc_id, {_tokens('text')} AS ws FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS token FROM w) GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w), dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token)"
_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_ASKED = f"q(query_id, text) AS (VALUES {_VALUES})"
_CASES = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
_BM25 = f"""{_TF}, qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_tokens('text')}) AS token FROM q) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(times * {_IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))), 6) AS score
  FROM qt JOIN tf USING (token) JOIN dfs USING (token) JOIN w USING (doc_id) CROSS JOIN stats GROUP BY ALL)"""


def _top(source: str, n: int, by: str = "doc_id") -> str:
    return f"(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {by}) AS INT) AS rank FROM {source} QUALIFY rank <= {n})"


_DENSE = f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ds AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / greatest(sqrt(list_dot_product(q.v, q.v)), 1e-30) / greatest(sqrt(list_dot_product(e.v, e.v)), 1e-30), 6) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
dk AS {_top('ds', 20, 'vec_id')}"""
_SPARSE = """hd AS (SELECT doc_id, CAST('0x' || substr(sha256(token), 1, 4) AS INT) % 64 AS b, sum(tf) AS v FROM tf GROUP BY ALL),
hq AS (SELECT query_id, CAST('0x' || substr(sha256(token), 1, 4) AS INT) % 64 AS b, sum(times) AS v FROM qt GROUP BY ALL),
ld AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM hd GROUP BY ALL), lq AS (SELECT query_id, sqrt(sum(v * v)) AS l FROM hq GROUP BY ALL),
cs AS (SELECT query_id, doc_id, round(sum((hd.v / ld.l) * (hq.v / lq.l)), 6) AS score FROM hd JOIN hq USING (b) JOIN ld USING (doc_id) JOIN lq USING (query_id) GROUP BY ALL)"""
_FUSED = f"""bk AS {_top('bm', 20)}, ck AS {_top('cs', 20)},
fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM bk UNION ALL SELECT query_id, doc_id, rank FROM ck) GROUP BY ALL),
fk AS (SELECT f.query_id, f.doc_id, f.rank, coalesce(cs.score, 0.0) AS score FROM {_top('fu', 20)} f LEFT JOIN cs USING (query_id, doc_id))"""
_TURNS = "t AS (SELECT conv_id AS session_id, turn AS turn_id, role, text FROM conversations)"
_ACTIVITY = "a AS (SELECT user_id AS session_id, epoch_us(min(ts)) / 1000000 AS created_at, epoch_us(max(ts)) / 1000000 AS seen_at, count(*) AS messages FROM events GROUP BY user_id), n AS (SELECT epoch_us(max(ts)) / 1000000 AS now FROM events)"

_BARE = _strip("line")
_LETTERS = r"regexp_replace(line, '[^\p{L}]', '', 'g')"
_TITLE = rf"({_BARE} <> '' AND length({_BARE}) <= 80 AND (regexp_matches({_BARE}, '^\s*\d+(?:\.\d+)*[.)]?\s+\S') OR regexp_matches({_LETTERS}, '^\p{{Lu}}{{3,}}$')))"
_SECTIONS = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
o AS (SELECT doc_id, line, i, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l),
s AS (SELECT doc_id, start, {_BARE} AS title FROM o WHERE {_TITLE})"""


def _pieces(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda y: {_strip('y')}), lambda z: z <> '')"


_UNITS = rf"""SELECT doc_id, CAST(generate_subscripts(us, 1) - 1 AS INT) AS unit_no, unnest(us) AS unit FROM (
  SELECT doc_id, flatten(list_transform({_pieces(r"regexp_split_to_array(coalesce(text, ''), '\n\s*\n')")}, lambda p: CASE WHEN length(p) <= 900 THEN [p] ELSE
    flatten(list_transform({_pieces(r"string_split(regexp_replace(p, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1))")}, lambda s: CASE WHEN length(s) <= 900 THEN [s] ELSE
      list_transform(range(0, length(s), 900), lambda i: substr(s, i + 1, 900)) END)) END)) AS us FROM documents)"""
_FIXED = f"fc AS (SELECT doc_id, list_filter(list_transform(range(0, greatest(length(text) - 150 - 1, 0) + 1, 750), lambda i: {_strip('substr(text, i + 1, 900)')}), lambda z: z <> '') AS cs FROM documents)"


def _html() -> str:
    """By patterns, for markup as the test tables have it; a tag or reference that the end of the page cuts off is left to the end."""
    x = r"regexp_replace(html, '(?s)<!--.*?-->', chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?is)<(script|style|head)(\s[^>]*)?>.*?</(script|style|head)\s*>', chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?is)</head\s*>', chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?is)</?(p|div|br|li|tr|h[1-6])(\s[^>]*)?>', chr(1) || chr(2) || chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?s)<[!/a-zA-Z][^>]*>', chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?s)</?[a-zA-Z][^>]*$', '')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    joined = f"replace(array_to_string({_pieces(f'string_split({x}, chr(1))')}, ' '), chr(2), chr(10))"
    return f"SELECT page_id, {_strip(joined)} AS text FROM pages"


_REFUSAL = " OR ".join(f"contains({_plain('text')}, '{p}')" for p in evaluation.REFUSALS)
_RELEVANCE = f"{_CASES}, {_BM25}, rel AS (SELECT b.query_id, b.doc_id, b.rank, {_plain('q.text')} <> '' AND contains({_plain('d.text')}, {_plain('q.text')}) AS hit FROM {_top('bm', 20)} b JOIN documents d USING (doc_id) JOIN q USING (query_id))"
_FOUND = f"{_ASKED}, {_BM25}, f AS (SELECT b.query_id, b.rank, b.doc_id, d.text FROM {_top('bm', 4)} b JOIN documents d USING (doc_id))"
_OLD = "old AS (SELECT 'doc-' || doc_id AS doc, sha256(CASE WHEN quality = 1 THEN text ELSE '' END) AS h FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'item-' || item_id, sha256(text) FROM benchmark)"

ORACLE_SQL = {
    "hybrid_search": f"WITH {_ASKED}, {_BM25}, {_SPARSE}, {_FUSED}, c AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM fk), k AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS place FROM c WHERE score >= greatest(0.3, 0.85 * best)) SELECT query_id, doc_id, CAST(place AS INT) AS rank, score FROM k WHERE place <= 4",
    "tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token",
    "term_freq": f"WITH {_TF} SELECT doc_id, token, tf FROM tf",
    "bm25_terms": f"WITH {_TF} SELECT token, df, round({_IDF}, 6) AS idf FROM dfs CROSS JOIN stats",
    "corpus_stats": f"WITH {_TF} SELECT count(*) AS n_docs, CAST(coalesce(sum(len(ws)), 0) AS BIGINT) AS n_tokens, round(avg(len(ws)), 6) AS avgdl FROM w",
    "bm25_topk": f"WITH {_ASKED}, {_BM25} SELECT * FROM {_top('bm', 4)}",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM dk",
    "l2_norm": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e) SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS place, round(unnest(v) / CASE WHEN l = 0 THEN 1 ELSE l END, 6) AS value FROM n",
    "rrf_fusion": f"WITH {_DENSE}, fu AS (SELECT 1 AS query_id, vec_id AS doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM dk GROUP BY vec_id) SELECT * FROM {_top('fu', 20)}",
    "threshold_adaptive": f"WITH {_DENSE} SELECT query_id, vec_id AS doc_id, score, rank FROM dk QUALIFY score >= greatest(0.3, 0.85 * max(score) OVER (PARTITION BY query_id))",
    "threshold_fixed": f"WITH {_DENSE} SELECT query_id, vec_id AS doc_id, score, rank FROM dk WHERE score >= 0.4",
    "normalize_eval": f"SELECT doc_id, {_plain('text')} AS plain FROM documents",
    "relevance": f"WITH {_RELEVANCE} SELECT * FROM rel",
    "eval_recall_mrr": f"WITH {_RELEVANCE}, p AS (SELECT q.query_id, min(rank) FILTER (WHERE hit) AS position FROM q LEFT JOIN rel USING (query_id) GROUP BY q.query_id) SELECT count(*) AS cases, count(*) AS positives, CAST(0 AS BIGINT) AS negatives, round(avg(CASE WHEN position IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / position, 0)), 6) AS mrr FROM p",
    "eval_judge_metrics": "SELECT count(*) AS cases, round(avg(CASE WHEN lang = 'en' THEN CAST(quality = 1 AS INT) END), 6) AS faithfulness, round(avg(CASE WHEN lang = 'en' THEN CAST(quality = 1 AS INT) END), 6) AS answered, round(avg(CASE WHEN lang = 'en' THEN quality END), 6) AS mean_grade, round(avg(CASE WHEN lang <> 'en' THEN CAST(toxic = 1 AS INT) END), 6) AS refusal_rate FROM documents LEFT JOIN labels USING (doc_id)",
    "sweep": f"""WITH {_CASES}, {_BM25}, {_SPARSE}, {_FUSED},
      runs AS (SELECT 'lexical' AS mode, query_id, doc_id, rank, CAST(NULL AS DOUBLE) AS score FROM bk UNION ALL SELECT 'dense', query_id, doc_id, rank, score FROM ck UNION ALL SELECT 'hybrid', query_id, doc_id, rank, score FROM fk),
      fl AS (SELECT *, greatest(0.3, 0.85 * max(score) OVER (PARTITION BY mode, query_id)) AS floor FROM runs),
      h AS (SELECT fl.*, contains({_plain('d.text')}, {_plain('q.text')}) AS hit FROM fl JOIN documents d USING (doc_id) JOIN q USING (query_id)),
      g AS (SELECT m AS mode, k AS top_k, u AS threshold FROM (VALUES ('dense'), ('lexical'), ('hybrid')) a(m), (VALUES (3), (4), (6), (8)) b(k), (VALUES (CAST(NULL AS DOUBLE)), (0.3), (0.4), (0.5), (0.6)) c(u)),
      kept AS (SELECT g.mode, g.top_k, g.threshold, query_id, hit, row_number() OVER (PARTITION BY g.mode, g.top_k, g.threshold, query_id ORDER BY rank, doc_id) AS place FROM g JOIN h ON g.mode = h.mode AND (h.score IS NULL OR h.score >= coalesce(g.threshold, h.floor))),
      p AS (SELECT mode, top_k, threshold, query_id, min(place) AS position FROM kept WHERE place <= top_k AND hit GROUP BY ALL),
      s AS (SELECT mode, top_k, threshold, count(*) AS found, sum(1.0 / position) AS rr FROM p GROUP BY ALL)
      SELECT g.mode, g.top_k, coalesce(CAST(g.threshold AS VARCHAR), 'adaptive') AS threshold, round(coalesce(found, 0) / n.n, 6) AS recall, round(coalesce(rr, 0) / n.n, 6) AS mrr
      FROM g LEFT JOIN s ON g.mode = s.mode AND g.top_k = s.top_k AND g.threshold IS NOT DISTINCT FROM s.threshold CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM q) n""",
    "refusals": f"WITH {_TURNS} SELECT session_id, turn_id, {_REFUSAL} AS refusal FROM t",
    "section_titles": f"WITH {_SECTIONS} SELECT * FROM s",
    "asof_section": f"WITH {_SECTIONS}, p AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS start FROM documents WHERE length(text) > 0) SELECT p.doc_id, p.start, s.title AS section FROM p ASOF LEFT JOIN s ON p.doc_id = s.doc_id AND p.start >= s.start",
    "units": _UNITS,
    "fixed_chunks": f"WITH {_FIXED} SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INT) AS chunk_no, unnest(cs) AS chunk FROM fc",
    "chunks_per_doc": f"WITH {_FIXED} SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(len(cs) AS BIGINT) AS n_chunks FROM fc",
    "chunk_order": f"WITH {_FIXED}, r AS (SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(generate_subscripts(cs, 1) - 1 AS INT) AS chunk_no, CAST(length(unnest(cs)) AS INT) AS length FROM fc) SELECT row_number() OVER (ORDER BY doc, chunk_no) - 1 AS chunk_id, doc, chunk_no, length FROM r",
    "doc_fingerprint": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "index_diff": f"WITH {_OLD}, now AS (SELECT 'doc-' || doc_id AS doc, sha256(text) AS h FROM documents) SELECT coalesce(now.doc, old.doc) AS doc, CASE WHEN now.h IS NULL THEN 'removed' WHEN old.h IS NULL THEN 'new' WHEN now.h = old.h THEN 'unchanged' ELSE 'changed' END AS status FROM now FULL JOIN old ON now.doc = old.doc",
    "index_reusable": f"WITH {_FIXED} SELECT doc_id AS doc FROM fc LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 AND len(cs) > 0",
    "html_text": _html(),
    "history_last_n": f"WITH {_TURNS} SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 40",
    "rewrite_context": f"WITH {_TURNS} SELECT session_id, turn_id, coalesce(string_agg(CASE role WHEN 'user' THEN 'Usuario' WHEN 'model' THEN 'Asistente' ELSE role END || ': ' || text, chr(10)) OVER (PARTITION BY session_id ORDER BY turn_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS context FROM t",
    "turns_per_session": f"WITH {_TURNS} SELECT session_id, count(*) AS turns FROM t GROUP BY session_id",
    "session_count": "SELECT count(DISTINCT conv_id) AS sessions FROM conversations",
    "session_activity": f"WITH {_ACTIVITY} SELECT * FROM a",
    "session_gate": f"WITH {_ACTIVITY} SELECT c_custkey AS session_id, CASE WHEN seen_at IS NULL THEN 'missing' WHEN now - seen_at > 86400 THEN 'expired' WHEN messages >= 60 THEN 'capped' ELSE 'ok' END AS status FROM customer LEFT JOIN a ON c_custkey = session_id CROSS JOIN n",
    "expired_sessions": f"WITH {_ACTIVITY} SELECT session_id FROM a, n WHERE now - seen_at > 21600",
    "user_sessions": "WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1000000 - lag(epoch_us(ts) / 1000000) OVER p > 86400 AS new FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM g) SELECT user_id, session_no, epoch_us(min(ts)) / 1000000 AS started, epoch_us(max(ts)) / 1000000 AS ended, count(*) AS events FROM s GROUP BY ALL",
    "capped_messages": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n <= 50",
    "sliding_counts": f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW) AS n FROM events",
    "rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST([] AS DOUBLE[]) AS held, CAST(0 AS BIGINT) AS wait FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL
        SELECT user_id, i, event_id, CASE WHEN wait = 0 THEN list_append(held, t) ELSE held END, wait FROM (
          SELECT user_id, i, event_id, t, held, CAST(CASE WHEN len(a) >= 2 THEN greatest(1, floor(3600 - (t - a[1])) + 1) WHEN len(b) >= 3 THEN greatest(1, floor(86400 - (t - b[1])) + 1) ELSE 0 END AS BIGINT) AS wait FROM (
            SELECT e.user_id, e.i, e.event_id, e.t, list_filter(held, lambda x: e.t - x <= 86400) AS held, list_filter(held, lambda x: e.t - x <= 3600) AS a, list_filter(held, lambda x: e.t - x <= 86400) AS b
            FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
      SELECT event_id, CAST(user_id AS VARCHAR) AS key, wait = 0 AS admitted, wait FROM r WHERE i > 0""",
    "prompt_context": f"WITH {_FOUND} SELECT q.query_id, '<<<INICIO_MATERIAL_DE_REFERENCIA>>>' || chr(10) || coalesce(string_agg('[' || rank || '] ' || f.text, chr(10) || chr(10) ORDER BY rank), '(No se ha encontrado informacion relevante.)') || chr(10) || '<<<FIN_MATERIAL_DE_REFERENCIA>>>' AS context FROM q LEFT JOIN f ON q.query_id = f.query_id GROUP BY q.query_id",
    "source_legend": f"WITH {_FOUND}, {_SECTIONS}, t AS (SELECT doc_id, min_by(title, start) AS title FROM s GROUP BY doc_id) SELECT query_id, 'Fuentes:' || chr(10) || string_agg('  [' || rank || '] ' || f.doc_id || ', p. 1' || coalesce(' (' || title || ')', ''), chr(10) ORDER BY rank) AS legend FROM f LEFT JOIN t ON f.doc_id = t.doc_id GROUP BY query_id",
    "first_line": rf"""WITH {_TURNS}, x AS (SELECT session_id, turn_id, list_filter(list_transform(regexp_split_to_array(' ' || chr(10) || ' "' || text || '"', '\r\n|\r|\n'), lambda y: {_strip('y')}), lambda z: z <> '')[1] AS line FROM t),
      y AS (SELECT session_id, turn_id, regexp_replace(line, '^"+|"+$', '', 'g') AS line FROM x) SELECT session_id, turn_id, coalesce(nullif({_strip('line')}, ''), '?') AS line FROM y""",
    "llm_json": "SELECT event_id, nullif(regexp_extract(props, '(?s)\\{.*\\}'), '') AS json FROM events",
    "event_props": "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events",
    "valid_names": r"SELECT name, regexp_full_match(name, '[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}') AS valid FROM (SELECT source AS name FROM documents UNION SELECT string_split(url, '/')[-1] FROM pages UNION SELECT p_name FROM part)",
    "upload_validation": r"""WITH u AS (SELECT string_split(url, '/')[-1] AS name, html AS content, page_id AS id FROM pages UNION ALL SELECT doc_id || '.TXT', text, doc_id FROM documents UNION ALL SELECT item_id || '.pdf', '%PDF' || substr(text, 1, 1) || text, item_id FROM benchmark),
      x AS (SELECT *, lower(regexp_extract(name, '(\.[^./\\]*)$', 1)) AS ext FROM u)
      SELECT name, id, CASE WHEN ext NOT IN ('.pdf', '.docx', '.txt', '.md', '.html', '.htm') THEN 'extension' WHEN content = '' THEN 'empty' WHEN ext = '.pdf' AND NOT starts_with(content, '%PDF-') OR ext = '.docx' AND NOT starts_with(hex(encode(content)), '504B0304') THEN 'signature' WHEN ext NOT IN ('.pdf', '.docx') AND regexp_matches(hex(encode(content))[1:16384], '^(..)*?00') THEN 'binary' ELSE 'ok' END AS status FROM x""",
    "log_hash": "SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN '-' ELSE substr(sha256(url), 1, 12) END AS key FROM pages",
    "log_json": "SELECT event_id, CAST(json_object('event_id', event_id, 'user_id', user_id, 'evento', event_type) AS VARCHAR) AS line FROM events",
    "collections_listing": "WITH d AS (SELECT source AS collection, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS document, coalesce(toxic, 0) = 1 AS t FROM documents LEFT JOIN labels USING (doc_id) WHERE regexp_full_match(source, '[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}')) SELECT collection, document, count(*) OVER p AS n_documents, bool_or(t) OVER p AS indexed FROM d WINDOW p AS (PARTITION BY collection)",
    "lru_residents": "SELECT user_id AS key, epoch_us(max(ts)) / 1000000 AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 4",
    "rerank_merge": f"WITH {_ASKED}, {_BM25}, c AS (SELECT query_id, doc_id, rank, CAST(length(text) AS DOUBLE) AS l FROM {_top('bm', 20)} JOIN documents USING (doc_id)), z AS (SELECT *, count(*) OVER (PARTITION BY query_id) > 4 AS used FROM c) SELECT query_id, doc_id, rank, CASE WHEN used THEN l END AS score_rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN used THEN l ELSE rank END, doc_id) AS INT) AS final_rank FROM z QUALIFY final_rank <= 4",
}
