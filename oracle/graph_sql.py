"""DuckDB SQL for the graph and transcript queries."""

from oracle.text_sql import DOCS, RETRIEVAL, annotate_cte, chunks_cte, strip


def _term_graph(ann: str, min_count: int) -> str:
    return f"""{ann}_t AS (SELECT DISTINCT key, chunk_no, unnest(kwl) AS term FROM {ann}),
{ann}_nodes AS (SELECT DISTINCT term AS id, term AS label FROM {ann}_t),
{ann}_edges AS (
  SELECT a.term AS "from", b.term AS "to", COUNT(*) AS weight, 'co_occurs' AS type
  FROM {ann}_t a JOIN {ann}_t b ON a.key = b.key AND a.chunk_no = b.chunk_no AND a.term < b.term
  GROUP BY a.term, b.term HAVING COUNT(*) >= {min_count})"""


CORPUS_GRAPH = f"""WITH {DOCS},
{chunks_cte(8000)},
{annotate_cte('chunks', 'chunks')},
{annotate_cte('chunks', 'chunks', 'ann5', 5)},
{_term_graph('ann', 1)},
{_term_graph('ann5', 1)}
"""

QUESTION_GRAPH = RETRIEVAL + f""",
{annotate_cte('chunks', 'chunks')},
qk AS (
  SELECT DISTINCT k.query_id, k.file, k.chunk, unnest(a.kwl) AS term
  FROM kept k JOIN ann a ON a.key = k.file AND a.chunk_no = k.chunk),
qnodes AS (SELECT DISTINCT query_id, term AS id, term AS label FROM qk),
qedges AS (
  SELECT a.query_id, a.term AS "from", b.term AS "to", 'co_occurs' AS type
  FROM qk a JOIN qk b ON a.query_id = b.query_id AND a.file = b.file AND a.chunk = b.chunk AND a.term < b.term
  GROUP BY ALL)
"""

TOOL = r"'(?s)^\[([^\]]+) result\]:\n(.*)$'"

CONV = f"""conv AS (
  SELECT conv_id, turn, role, text,
         CAST(greatest(1, SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
              OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS round,
         role = 'assistant' AND regexp_matches(text, {TOOL}) AS is_tool
  FROM (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 4 = 1
               THEN '[lookup result]:' || chr(10) || text ELSE text END AS text FROM conversations))"""

FOLLOW_PRE = "Output of "
FOLLOW_MID = " is given above. Still open is the request: "

SQL = {
    "term_graph_nodes": CORPUS_GRAPH + "SELECT id, label FROM ann_nodes",
    "term_graph_edges": CORPUS_GRAPH + 'SELECT "from", "to", weight, type FROM ann_edges',
    "graph_changed": CORPUS_GRAPH + """,
old_g AS (SELECT 'node' AS element, id, label, NULL::VARCHAR AS "from", NULL::VARCHAR AS "to", NULL::VARCHAR AS type FROM ann5_nodes
          UNION ALL SELECT 'edge', NULL, NULL, "from", "to", type FROM ann5_edges),
new_g AS (SELECT 'node' AS element, id, label, NULL::VARCHAR AS "from", NULL::VARCHAR AS "to", NULL::VARCHAR AS type FROM ann_nodes
          UNION ALL SELECT 'edge', NULL, NULL, "from", "to", type FROM ann_edges)
SELECT *, 'added' AS change FROM (SELECT * FROM new_g EXCEPT ALL SELECT * FROM old_g)
UNION ALL
SELECT *, 'removed' AS change FROM (SELECT * FROM old_g EXCEPT ALL SELECT * FROM new_g)""",
    "graph_state": QUESTION_GRAPH + """,
new_rows AS (SELECT query_id, 'n' AS el, id AS a, label AS b, NULL AS c FROM qnodes WHERE query_id % 5 <> 4
             UNION ALL SELECT query_id, 'e', "from", "to", type FROM qedges WHERE query_id % 5 <> 4),
old_rows AS (SELECT query_id, 'n' AS el, id AS a, label AS b, NULL AS c FROM qnodes WHERE query_id % 3 = 0 OR query_id % 3 = 1 AND id < 'm'
             UNION ALL SELECT query_id, 'e', "from", "to", type FROM qedges WHERE query_id % 3 <> 2),
plus AS (SELECT query_id, COUNT(*) AS n FROM (SELECT * FROM new_rows EXCEPT ALL SELECT * FROM old_rows) GROUP BY query_id),
minus AS (SELECT query_id, COUNT(*) AS n FROM (SELECT * FROM old_rows EXCEPT ALL SELECT * FROM new_rows) GROUP BY query_id),
present AS (SELECT DISTINCT query_id FROM new_rows)
SELECT q.query_id, CASE WHEN r.query_id IS NULL THEN 'absent' WHEN p.n IS NULL AND m.n IS NULL THEN 'unchanged' ELSE 'changed' END AS state,
       CAST(CASE WHEN r.query_id IS NULL THEN 0 ELSE COALESCE(p.n, 0) END AS BIGINT) AS added,
       CAST(CASE WHEN r.query_id IS NULL THEN 0 ELSE COALESCE(m.n, 0) END AS BIGINT) AS removed
FROM questions q LEFT JOIN plus p ON p.query_id = q.query_id LEFT JOIN minus m ON m.query_id = q.query_id
LEFT JOIN present r ON r.query_id = q.query_id""",
    "graph_nodes": QUESTION_GRAPH + "SELECT query_id, id, label FROM qnodes",
    "graph_edges": QUESTION_GRAPH + 'SELECT query_id, "from", "to", type FROM qedges',
    "cap_rounds": f"WITH {CONV}\nSELECT conv_id, turn, role, text, round FROM conv WHERE round <= 2",
    "tool_results": f"""WITH {CONV}
SELECT conv_id, turn, regexp_extract(text, {TOOL}, 1) AS tool, regexp_extract(text, {TOOL}, 2) AS output
FROM conv WHERE is_tool""",
    "stop_round": f"""WITH {CONV},
per_round AS (SELECT conv_id, round, MAX(CAST(is_tool AS INTEGER)) AS t FROM conv GROUP BY ALL),
stops AS (SELECT conv_id, MIN(round) AS stop_round FROM per_round WHERE t = 0 GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, c.text, c.round, s.stop_round
FROM conv c LEFT JOIN stops s ON s.conv_id = c.conv_id
WHERE s.stop_round IS NULL OR c.round <= s.stop_round""",
    "assemble_response": f"""WITH {CONV}
SELECT conv_id, {strip("string_agg(text, chr(10) ORDER BY turn)")} AS response
FROM conv WHERE role = 'assistant' AND NOT is_tool GROUP BY conv_id""",
    "followup_prompts": f"""WITH {CONV},
fu AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn, regexp_extract(c.text, {TOOL}, 1) AS tool,
       '{FOLLOW_PRE}' || regexp_extract(c.text, {TOOL}, 1) || '{FOLLOW_MID}' || COALESCE(fu.q, '') AS prompt
FROM conv c LEFT JOIN fu ON fu.conv_id = c.conv_id WHERE c.is_tool""",
    "round_summary": f"""WITH {CONV}
SELECT conv_id, round, COUNT(*) AS turns, CAST(SUM(CAST(is_tool AS INTEGER)) AS BIGINT) AS tool_results
FROM conv GROUP BY conv_id, round""",
}


def _lit(text: str) -> str:
    """SQL literal with newlines as chr(10)."""
    parts = text.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


# T8 prompt templates (same fixed wording as the Spark operator).
ANNOTATE_PRE = "Text:\n"
ANNOTATE_POST = "\n\nWrite a heading for it, name its subjects and search terms, and retell it in a paragraph."
SCORE_PRE, SCORE_MID = "Question: ", "\n\nChunk summary:\n"
SCORE_POST = ("\n\nRate the relevance of the chunk to the question from 0 to 10 and answer in the form: "
              "Score: <number>, Reason: <short reason>, Anser: <answer>")
SUM_PRE, SUM_MID = "Someone asked: ", "\n\nNotes:\n"
SUM_POST = "\n\nUsing the notes alone, state what they show about it and close with one sentence."
GRAPH_PRE = "Notes:\n"
GRAPH_POST = ("\n\nTurn the notes into a JSON object with the lists nodes (id, label) and edges (from, to, type). "
              "Reply with the object and nothing else.")

SQL["build_prompts"] = RETRIEVAL + f"""
SELECT 'annotate' AS kind, CAST(NULL AS BIGINT) AS query_id, file, chunk, {_lit(ANNOTATE_PRE)} || text || {_lit(ANNOTATE_POST)} AS prompt
FROM rchunks
UNION ALL
SELECT 'score', k.query_id, k.file, k.chunk,
       {_lit(SCORE_PRE)} || q.text || {_lit(SCORE_MID)} || c.text || {_lit(SCORE_POST)}
FROM kept k JOIN questions q ON q.query_id = k.query_id JOIN rchunks c ON c.file = k.file AND c.chunk = k.chunk
UNION ALL
SELECT 'summarize', x.query_id, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER),
       {_lit(SUM_PRE)} || q.text || {_lit(SUM_MID)} || x.context || {_lit(SUM_POST)}
FROM contexts x JOIN questions q ON q.query_id = x.query_id
UNION ALL
SELECT 'graph', x.query_id, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), {_lit(GRAPH_PRE)} || x.context || {_lit(GRAPH_POST)}
FROM contexts x"""

SQL["saved_graph_nodes"] = SQL["graph_nodes"]
