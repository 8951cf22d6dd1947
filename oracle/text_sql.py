"""DuckDB SQL for the document operators. The chunker is a recursive CTE:
from a chunk start ``s`` the next start is the first word whose running
token total exceeds ``total(s-1) + max`` (at least ``s + 1``); a first word
over budget adds an empty first chunk."""

DOCS = r"""docs AS (
  SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS key, doc_id, text
  FROM documents)"""


def chunks_cte(max_tokens: int, name: str = "chunks", docs: str = "docs") -> str:
    m = int(max_tokens)
    return rf"""{name}_w AS (
  SELECT key, i, w, (length(w) + 4) // 4 AS c,
         SUM((length(w) + 4) // 4) OVER (PARTITION BY key ORDER BY i) AS cs
  FROM (SELECT key, unnest(arr) AS w, generate_subscripts(arr, 1) AS i
        FROM (SELECT key, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS arr FROM {docs}))),
{name}_n AS (SELECT key, COUNT(*) AS n, MAX(c) FILTER (WHERE i = 1) AS c1 FROM {name}_w GROUP BY key),
{name}_r AS (
  WITH RECURSIVE r(key, k, s, n) AS (
    SELECT key, 1, 1, n FROM {name}_n
    UNION ALL
    SELECT r.key, r.k + 1,
           greatest(r.s + 1, COALESCE((SELECT MIN(w2.i) FROM {name}_w w2, {name}_w b
                                       WHERE w2.key = r.key AND b.key = r.key AND b.i = r.s
                                         AND w2.i >= r.s AND w2.cs - (b.cs - b.c) > {m}), r.n + 1)),
           r.n
    FROM r WHERE r.s <= r.n)
  SELECT key, k, s, lead(s) OVER (PARTITION BY key ORDER BY k) AS e FROM r),
{name} AS (
  SELECT r.key, CAST(r.k + CASE WHEN n.c1 > {m} THEN 1 ELSE 0 END AS INTEGER) AS chunk_no,
         string_agg(w.w, ' ' ORDER BY w.i) AS chunk
  FROM {name}_r r JOIN {name}_w w ON w.key = r.key AND w.i >= r.s AND w.i < r.e
  JOIN {name}_n n ON n.key = r.key
  WHERE r.e IS NOT NULL
  GROUP BY r.key, r.k, n.c1
  UNION ALL
  SELECT key, 1, '' FROM {name}_n WHERE c1 > {m})"""


SQL = {
    "chunk_documents": f"WITH {DOCS},\n{chunks_cte(8000)}\nSELECT key, chunk_no, chunk FROM chunks",
    "chunk_documents_200": f"WITH {DOCS},\n{chunks_cte(200)}\nSELECT key, chunk_no, chunk FROM chunks",
}


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


SENT = "'[^.!?]+[.!?]*'"
TERMS = "'\\p{L}+'"


def annotate_cte(chunks: str, corpus: str, name: str = "ann", n_keywords: int = 8) -> str:
    """title / keywords / summary / annotation for the rows of ``chunks``
    (key, chunk_no, chunk) with TF-IDF statistics from ``corpus``."""
    return rf"""{name}_tf AS (
  SELECT key, chunk_no, term, COUNT(*) AS tf
  FROM (SELECT key, chunk_no, unnest(regexp_extract_all(lower(chunk), {TERMS})) AS term FROM {chunks})
  GROUP BY ALL),
{name}_df AS (
  SELECT term, COUNT(*) AS df FROM (
    SELECT DISTINCT key, chunk_no, unnest(regexp_extract_all(lower(chunk), {TERMS})) AS term FROM {corpus})
  GROUP BY term),
{name}_w AS (
  SELECT t.key, t.chunk_no, t.term, t.tf,
         round(t.tf * (ln((1.0 + (SELECT COUNT(*) FROM {corpus})) / (1.0 + d.df)) + 1.0), 9) AS tfidf
  FROM {name}_tf t JOIN {name}_df d ON t.term = d.term),
{name}_kw AS (
  SELECT key, chunk_no, string_agg(term, ', ' ORDER BY r) AS keywords, list(term ORDER BY r) AS kwl FROM (
    SELECT key, chunk_no, term, row_number() OVER (PARTITION BY key, chunk_no ORDER BY tfidf DESC, term) AS r
    FROM {name}_w) WHERE r <= {n_keywords} GROUP BY key, chunk_no),
{name}_s AS (
  SELECT key, chunk_no, sent_no, {strip('s')} AS sentence FROM (
    SELECT key, chunk_no, unnest(l) AS s, generate_subscripts(l, 1) AS sent_no
    FROM (SELECT key, chunk_no, regexp_extract_all(chunk, {SENT}) AS l FROM {chunks}))
  WHERE {strip('s')} <> ''),
{name}_ss AS (
  SELECT s.key, s.chunk_no, s.sent_no, round(avg(w.tfidf), 9) AS score
  FROM (SELECT key, chunk_no, sent_no, unnest(regexp_extract_all(lower(sentence), {TERMS})) AS term FROM {name}_s) s
  JOIN {name}_w w ON w.key = s.key AND w.chunk_no = s.chunk_no AND w.term = s.term
  GROUP BY ALL),
{name}_sum AS (
  SELECT key, chunk_no, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.key, s.chunk_no ORDER BY COALESCE(ss.score, 0.0) DESC, s.sent_no) AS r
    FROM {name}_s s LEFT JOIN {name}_ss ss ON ss.key = s.key AND ss.chunk_no = s.chunk_no AND ss.sent_no = s.sent_no)
  WHERE r <= 2 GROUP BY key, chunk_no),
{name} AS (
  SELECT c.key, c.chunk_no, {strip(f"regexp_extract(c.chunk, {SENT}, 0)")} AS title,
         COALESCE(k.keywords, '') AS keywords, COALESCE(k.kwl, []) AS kwl, m.summary
  FROM {chunks} c LEFT JOIN {name}_kw k ON k.key = c.key AND k.chunk_no = c.chunk_no
  LEFT JOIN {name}_sum m ON m.key = c.key AND m.chunk_no = c.chunk_no)"""


ANNOTATION = ("concat_ws(chr(10), 'Title: ' || title, 'Keywords: ' || keywords, "
              "'Summary: ' || COALESCE(summary, ''))")

PAGE_OBJECTS = r"""page_objects AS (
  SELECT regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS key, html AS text
  FROM pages)"""

# The registered indexing run: previous index = chunks at 4000 tokens with
# the first sentence as summary; new run at 8000 tokens.
INDEX_RUN = f"""WITH {DOCS}, {PAGE_OBJECTS},
{chunks_cte(8000)},
{chunks_cte(4000, 'prior_chunks')},
prior AS (
  SELECT c.key, c.chunk_no, CAST(n.cnt AS INTEGER) AS chunks, regexp_extract(c.chunk, {SENT}, 0) AS summary
  FROM prior_chunks c JOIN (SELECT key, COUNT(*) AS cnt FROM prior_chunks GROUP BY key) n ON n.key = c.key),
counts AS (SELECT key, CAST(COUNT(*) AS INTEGER) AS chunks FROM chunks GROUP BY key),
prior_counts AS (SELECT DISTINCT key, chunks FROM prior),
status AS (
  SELECT c.key, CASE WHEN p.chunks IS NOT NULL AND p.chunks = c.chunks THEN 'Cached' ELSE 'Processed' END AS status,
         c.chunks
  FROM counts c LEFT JOIN prior_counts p ON p.key = c.key),
all_status AS (
  SELECT key, status, chunks FROM status
  UNION ALL
  SELECT key, 'Skipped', CAST(NULL AS INTEGER) FROM page_objects
  WHERE NOT (lower(key) LIKE '%.txt' OR lower(key) LIKE '%.md' OR lower(key) LIKE '%.csv'
             OR lower(key) LIKE '%.log' OR lower(key) LIKE '%.pdf')
  UNION ALL
  SELECT key, 'Skipped', CAST(NULL AS INTEGER) FROM page_objects WHERE lower(key) LIKE '%.pdf'
  UNION ALL
  SELECT key, 'Empty', CAST(NULL AS INTEGER) FROM (SELECT key, text FROM docs UNION ALL
      SELECT key, text FROM page_objects WHERE lower(key) SIMILAR TO '.*[.](txt|md|csv|log)')
  WHERE NOT regexp_matches(text, '\\S')),
todo AS (
  SELECT c.key, c.chunk_no, c.chunk, s.chunks FROM chunks c JOIN status s ON s.key = c.key WHERE s.status = 'Processed'),
{annotate_cte('todo', 'chunks')},
updates AS (
  SELECT t.key, t.chunk_no, t.chunks,
         CASE WHEN COALESCE({ANNOTATION}, '') = '' THEN '[Error] no annotation' ELSE {ANNOTATION} END AS summary
  FROM todo t LEFT JOIN ann a ON a.key = t.key AND a.chunk_no = t.chunk_no),
new_index AS (
  SELECT * FROM prior WHERE key NOT IN (SELECT key FROM updates)
  UNION ALL SELECT key, chunk_no, chunks, summary FROM updates)
"""

# The run by hash: every document indexed before, English ones with another text.
HASH_RUN = f"""WITH {DOCS},
{chunks_cte(8000)},
cnt AS (SELECT key, CAST(COUNT(*) AS INTEGER) AS chunks FROM chunks GROUP BY key),
state AS (
  SELECT d.key, c.chunks, x.lang = 'en' AS changed, sha256(d.text) AS text_hash
  FROM docs d JOIN documents x ON x.doc_id = d.doc_id JOIN cnt c ON c.key = d.key),
todo AS (SELECT c.*, s.chunks, s.text_hash FROM chunks c JOIN state s ON s.key = c.key WHERE s.changed),
{annotate_cte('todo', 'chunks')}
"""

# Retrieval over the benchmark questions and the 8000-token chunks.
RETRIEVAL = rf"""WITH {DOCS},
{chunks_cte(8000)},
rchunks AS (SELECT key AS file, chunk_no AS chunk, chunk AS text FROM chunks),
questions AS (SELECT item_id AS query_id, text FROM benchmark),
ptf AS (
  SELECT file, chunk, term, COUNT(*) AS tf
  FROM (SELECT file, chunk, unnest(regexp_extract_all(lower(text), {TERMS})) AS term FROM rchunks)
  GROUP BY ALL),
pdl AS (SELECT file, chunk, SUM(tf) AS dl FROM ptf GROUP BY ALL),
stats AS (SELECT COUNT(*) AS n, avg(dl) AS avgdl FROM pdl),
pdf AS (SELECT term, COUNT(*) AS df FROM ptf GROUP BY term),
weighted AS (
  SELECT t.file, t.chunk, t.term,
         round(ln(1.0 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2
               / (t.tf + 1.2 * (0.25 + 0.75 * l.dl / s.avgdl)), 9)::DECIMAL(18,9) AS w
  FROM ptf t JOIN pdl l ON l.file = t.file AND l.chunk = t.chunk JOIN pdf d ON d.term = t.term, stats s),
qterms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), {TERMS})) AS term FROM questions),
bm AS (
  SELECT q.query_id, w.file, w.chunk, CAST(round(SUM(w.w), 6) AS DOUBLE) AS bm25
  FROM qterms q JOIN weighted w ON w.term = q.term GROUP BY ALL),
scored AS (
  SELECT query_id, file, chunk, bm25, round(bm25 * 10 / NULLIF(max(bm25) OVER (PARTITION BY query_id), 0), 6) AS score
  FROM bm),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, file, chunk) AS INTEGER) AS rank
  FROM scored),
top0 AS (SELECT * FROM ranked WHERE rank <= 3),
qwords AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), {TERMS})) AS qw FROM questions),
sents AS (
  SELECT t.query_id, t.file, t.chunk, unnest(regexp_extract_all(c.text, {SENT})) AS s,
         generate_subscripts(regexp_extract_all(c.text, {SENT}), 1) AS pos
  FROM top0 t JOIN rchunks c ON c.file = t.file AND c.chunk = t.chunk),
best_sent AS (
  SELECT s.query_id, s.file, s.chunk, {strip('s.s')} AS sentence FROM sents s JOIN qwords q ON q.query_id = s.query_id
  WHERE {strip('s.s')} <> ''
  QUALIFY row_number() OVER (PARTITION BY s.query_id, s.file, s.chunk ORDER BY
    len(list_intersect(list_distinct(regexp_extract_all(lower(s.s), {TERMS})), q.qw)) DESC, s.pos) = 1),
top AS (
  SELECT t.query_id, t.file, t.chunk, t.bm25, t.score, t.rank,
         'Reason: bm25 ' || CAST(CAST(t.bm25 AS DECIMAL(18,6)) AS VARCHAR) AS reason,
         ' Anser: ' || COALESCE(b.sentence, '') AS answer
  FROM top0 t LEFT JOIN best_sent b ON b.query_id = t.query_id AND b.file = t.file AND b.chunk = t.chunk),
kept AS (SELECT * FROM top WHERE score >= 0.4),
ctx0 AS (
  SELECT q.query_id, 'Top Relevant Chunks and the answer:'
         || COALESCE(string_agg(chr(10) || 'Related report: ' || k.answer, '' ORDER BY k.rank), '') AS context
  FROM questions q LEFT JOIN kept k ON k.query_id = q.query_id GROUP BY q.query_id),
contexts AS (
  SELECT query_id, context FROM ctx0)
"""

# Replies about every document in six forms, parsed as T3 does.
PARSED = rf"""WITH replies AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN sc || re || an
    WHEN 1 THEN sc || re || ', ' || lang || an
    WHEN 2 THEN sc || '/10' || re || an
    WHEN 3 THEN sc || re
    WHEN 4 THEN text
    ELSE sc || re || an || ' ' || sc || re || an END AS reply
  FROM (SELECT *, 'Score: ' || CAST(n_chars % 11 AS VARCHAR) AS sc, ', Reason: ' || source AS re,
               ', Anser: ' || text AS an FROM documents)),
seg AS (
  SELECT *, {strip("string_split(reply, 'Score:')[2]")} AS sg FROM replies WHERE contains(reply, 'Score:')),
parts AS (
  SELECT *, instr(sg, ',') AS p1, instr(substr(sg, instr(sg, ',') + 1), ',') AS p2 FROM seg),
parsed AS (
  SELECT doc_id,
         CASE WHEN regexp_full_match({strip("substr(sg, 1, p1 - 1)")}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')
              THEN TRY_CAST({strip("substr(sg, 1, p1 - 1)")} AS DOUBLE) END AS score,
         {strip("substr(substr(sg, p1 + 1), 1, p2 - 1)")} AS reason,
         substr(substr(sg, p1 + 1), p2 + 1) AS answer
  FROM parts WHERE p1 > 0 AND p2 > 0)
SELECT doc_id, score, reason, answer FROM parsed WHERE score IS NOT NULL"""


def _sents_of_kept() -> str:
    return rf"""ks AS (
  SELECT k.query_id, k.rank, k.file, k.chunk, unnest(regexp_extract_all(c.text, {SENT})) AS s,
         generate_subscripts(regexp_extract_all(c.text, {SENT}), 1) AS sent_no
  FROM kept k JOIN rchunks c ON c.file = k.file AND c.chunk = k.chunk),
ks2 AS (SELECT query_id, rank, file, chunk, sent_no, {strip('s')} AS sentence FROM ks WHERE {strip('s')} <> ''),
qt AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), {TERMS})) AS qt FROM questions),
ks3 AS (
  SELECT k.*, len(list_intersect(list_distinct(regexp_extract_all(lower(k.sentence), {TERMS})), q.qt)) AS overlap
  FROM ks2 k JOIN qt q ON q.query_id = k.query_id),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, file, chunk, sent_no) AS r
                 FROM ks3) WHERE r <= 3)"""


def _diverse() -> str:
    """Maximal marginal relevance: three rounds, each taking the best free
    sentence of a question and raising the others' similarity to it."""
    sql = rf"""ms AS (
  SELECT k.query_id, k.rank, k.file, k.chunk, unnest(regexp_extract_all(c.text, {SENT})) AS s,
         generate_subscripts(regexp_extract_all(c.text, {SENT}), 1) AS sent_no
  FROM kept k JOIN rchunks c ON c.file = k.file AND c.chunk = k.chunk),
mq AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), {TERMS})) AS asked FROM questions),
m0 AS (
  SELECT m.query_id, rank, file, chunk, sent_no, {strip('s')} AS sentence,
         list_distinct(regexp_extract_all(lower({strip('s')}), {TERMS})) AS own, q.asked,
         COALESCE(len(list_intersect(own, q.asked)) / NULLIF(len(q.asked), 0)::DOUBLE, 0.0) AS relevance, 0.0::DOUBLE AS sim, FALSE AS taken
  FROM ms m JOIN mq q ON q.query_id = m.query_id WHERE {strip('s')} <> '')"""
    for i in range(3):
        sql += f""",
p{i} AS (SELECT query_id, rank AS r, file AS f, chunk AS c, sent_no AS n, sentence AS ps, own AS po FROM m{i} WHERE NOT taken AND sim < 1.0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * relevance - 0.5 * sim, 9) DESC, rank, file, chunk, sent_no) = 1),
m{i + 1} AS (
  SELECT m.query_id, rank, file, chunk, sent_no, sentence, own, relevance,
         greatest(sim, CASE WHEN p.n IS NULL THEN 0.0 WHEN sentence = ps THEN 1.0
           ELSE COALESCE(len(list_intersect(own, po)) / NULLIF(len(list_distinct(list_concat(own, po))), 0)::DOUBLE, 0.0) END) AS sim,
         taken OR COALESCE(rank = r AND file = f AND chunk = c AND sent_no = n, FALSE) AS taken
  FROM m{i} m LEFT JOIN p{i} p ON p.query_id = m.query_id)"""
    return sql


SQL.update({
    "diverse_summary": RETRIEVAL + ",\n" + _diverse() + """
SELECT q.query_id, COALESCE(string_agg(sentence, ' ' ORDER BY rank, file, chunk, sent_no), '') AS summary
FROM questions q LEFT JOIN (SELECT * FROM m3 WHERE taken) t ON t.query_id = q.query_id GROUP BY q.query_id""",
    "word_counts": f"""WITH {DOCS}
SELECT key, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM docs""",
    "decode_text": f"WITH {DOCS}\nSELECT key, text FROM docs",
    "decode_damaged_text": """SELECT doc_id, substr(text, 1, length(text) // 2) || chr(65533) || '(' || substr(text, length(text) // 2 + 1) AS text
FROM documents""",
    "filled_replies": f"""SELECT doc_id, CASE WHEN doc_id % 3 IN (0, 1) OR regexp_extract(text, {SENT}, 0) = '' THEN '[Error] no annotation'
       ELSE regexp_extract(text, {SENT}, 0) END AS summary FROM documents""",
    "event_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events",
    "chunk_counts": f"""WITH {DOCS},\n{chunks_cte(8000)}
SELECT key, CAST(COUNT(*) AS INTEGER) AS chunks FROM chunks GROUP BY key""",
    "annotate_chunks": f"""WITH {DOCS},\n{chunks_cte(8000)},\n{annotate_cte('chunks', 'chunks')}
SELECT key, chunk_no, title, keywords, summary, {ANNOTATION} AS annotation FROM ann""",
    "chunk_topics": f"""WITH {DOCS},\n{chunks_cte(8000)},\n{annotate_cte('chunks', 'chunks')},
kw AS (SELECT key, chunk_no, unnest(kwl) AS term FROM ann),
use AS (SELECT term, CAST(COUNT(*) AS BIGINT) AS topic_chunks FROM kw GROUP BY term)
SELECT key, chunk_no, term AS topic, topic_chunks FROM kw JOIN use USING (term)
QUALIFY row_number() OVER (PARTITION BY key, chunk_no ORDER BY topic_chunks DESC, term) = 1""",
    "index_status": INDEX_RUN + "SELECT key, status, chunks FROM all_status",
    "read_objects": "SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS length, text || chr(10) AS text FROM documents WHERE lang = 'en'",
    "chunk_object_lines": SQL["chunk_documents_200"],
    "streamed_index": f"""WITH docs AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS key, doc_id, text FROM documents),
{chunks_cte(8000)},
cnt AS (SELECT key, CAST(COUNT(*) AS INTEGER) AS chunks FROM chunks GROUP BY key),
{annotate_cte('chunks', 'chunks')}
SELECT c.key, c.chunk_no, n.chunks,
       CASE WHEN COALESCE({ANNOTATION}, '') = '' THEN '[Error] no annotation' ELSE {ANNOTATION} END AS summary
FROM chunks c JOIN cnt n ON n.key = c.key JOIN ann a ON a.key = c.key AND a.chunk_no = c.chunk_no""",
    "streamed_statuses": f"""WITH docs AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS key, doc_id, text FROM documents),
{chunks_cte(8000)},
cnt AS (SELECT key, CAST(COUNT(*) AS INTEGER) AS chunks FROM chunks GROUP BY key)
SELECT d.key, CASE WHEN c.chunks IS NULL THEN 'Empty' ELSE 'Processed' END AS status, c.chunks
FROM docs d LEFT JOIN cnt c ON c.key = d.key""",
    "index_errors": f"""WITH {DOCS},\n{chunks_cte(8000)},
cnt AS (SELECT key, CAST(COUNT(*) AS INTEGER) AS chunks FROM chunks GROUP BY key)
SELECT d.key, CASE WHEN d.text IS NULL OR n.n % 7 = 0 THEN 'Error' WHEN n.n IS NULL THEN 'Empty' ELSE 'Processed' END AS status,
       CASE WHEN n.n % 7 <> 0 THEN c.chunks END AS chunks
FROM docs d LEFT JOIN chunks_n n ON n.key = d.key LEFT JOIN cnt c ON c.key = d.key""",
    "index_status_hash": HASH_RUN + """SELECT key, CASE WHEN changed THEN 'Processed' ELSE 'Cached' END AS status, chunks FROM state
UNION ALL SELECT key, CASE WHEN text IS NULL THEN 'Error' ELSE 'Empty' END, NULL FROM docs WHERE key NOT IN (SELECT key FROM state)""",
    "saved_index": HASH_RUN + f"""SELECT t.key, t.chunk_no, t.chunks,
       CASE WHEN COALESCE({ANNOTATION}, '') = '' THEN '[Error] no annotation' ELSE {ANNOTATION} END AS summary, t.text_hash
FROM todo t LEFT JOIN ann a ON a.key = t.key AND a.chunk_no = t.chunk_no
UNION ALL SELECT c.key, c.chunk_no, s.chunks, regexp_extract(c.chunk, {SENT}, 0), s.text_hash
FROM chunks c JOIN state s ON s.key = c.key WHERE NOT s.changed""",
    "index_run_summary": INDEX_RUN + "SELECT status, COUNT(*) AS documents FROM all_status GROUP BY status",
    "upsert_index": INDEX_RUN + "SELECT key, chunk_no, chunks, summary FROM new_index",
    "pack_index": INDEX_RUN + """SELECT key, MAX(chunks) AS chunks, list(summary ORDER BY chunk_no) AS summaries
FROM new_index GROUP BY key""",
    "explode_index": INDEX_RUN + "SELECT key AS file, chunk_no AS chunk, summary FROM new_index",
    "score_chunks": RETRIEVAL + "SELECT query_id, file, chunk, bm25, score FROM scored",
    "parse_scored_reply": PARSED,
    "top_chunks": RETRIEVAL + "SELECT query_id, file, chunk, bm25, score, reason, answer, rank FROM top",
    "top_scored_chunks": RETRIEVAL + "SELECT query_id, file, chunk, bm25, score, rank FROM top0",
    "relevant_chunks": RETRIEVAL + "SELECT query_id, file, chunk, bm25, score, reason, answer, rank FROM kept",
    "build_context": RETRIEVAL + "SELECT query_id, context FROM contexts",
    "truncate_context": RETRIEVAL + """SELECT query_id,
  CASE WHEN length(context) > 300 THEN substr(context, 1, 100) ELSE context END AS context FROM contexts""",
    "clip_output": RETRIEVAL + "SELECT query_id, substr(context, 1, 200) || '...' AS context FROM contexts",
    "summarize_context": RETRIEVAL + ",\n" + _sents_of_kept() + """
SELECT q.query_id, COALESCE(string_agg(b.sentence, ' ' ORDER BY b.rank, b.file, b.chunk, b.sent_no), '') AS summary
FROM questions q LEFT JOIN best b ON b.query_id = q.query_id GROUP BY q.query_id""",
    "filled_summaries": RETRIEVAL + ",\n" + _sents_of_kept() + """,
summ AS (SELECT q.query_id, string_agg(b.sentence, ' ' ORDER BY b.rank, b.file, b.chunk, b.sent_no) AS summary
FROM questions q LEFT JOIN best b ON b.query_id = q.query_id GROUP BY q.query_id)
SELECT query_id, CASE WHEN COALESCE(summary, '') = '' THEN '[Error] no annotation' ELSE summary END AS summary
FROM summ""",
})
