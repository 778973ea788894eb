"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from paperloom import more_oracles
from paperloom.plans.prompts import TEMPLATES
from paperloom.sql_parts import DOCS, SPEAKER, TURNS, first_words, fixed, overlapped, pack, quoted, section, sentence_chunks, transcript, trim, words

_LOG_LINES = r"""logs AS (SELECT user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type
      || ' value=' || trunc(value * 100)::BIGINT::VARCHAR || CASE WHEN event_type = 'error' THEN chr(10) || chr(9) || 'at app.handler(' || event_id::VARCHAR || ')' ELSE '' END,
      chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY user_id),
    lines AS (SELECT user_id, i, l[i] AS line FROM (SELECT user_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM logs)),
    flagged AS (SELECT *, regexp_matches(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}') AND NOT regexp_matches(line, '^[\t ]+(?:at |frame #|\d+\s+0x|[\w.]+\()') AS starts FROM lines),
    numbered AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY i)::BIGINT AS block FROM flagged),
    blocks AS (SELECT user_id, block, string_agg(line, chr(10) ORDER BY i) AS text FROM numbered GROUP BY ALL)"""
_SEVERITY = "CASE WHEN contains(lower(text), 'fatal') THEN 'fatal' WHEN contains(lower(text), 'error') THEN 'error' WHEN contains(lower(text), 'warn') THEN 'warning' WHEN contains(lower(text), 'info') THEN 'info' WHEN contains(lower(text), 'debug') THEN 'debug' END"
_LOG_CHUNKS = rf"""{_LOG_LINES}, sized AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY block) AS i, text, len({words("text")})::BIGINT AS n, {_SEVERITY} AS severity,
      regexp_extract(text, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}') AS t FROM blocks), {pack("sized", 15)},
    made AS (SELECT p.k AS user_id, p.c AS chunk_index, string_agg(b.text, chr(10) ORDER BY b.i) AS text, sum(b.n)::BIGINT AS word_count, first(b.severity ORDER BY b.i) AS severity, string_agg(b.t, ',' ORDER BY b.i) AS times
      FROM pack p JOIN sized b ON b.k = p.k AND b.i = p.i GROUP BY ALL)"""

_MARKDOWN = rf"""md AS (SELECT page_id, '# ' || regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) || chr(10) || chr(10) || array_to_string(list_transform(
      regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), chr(10) || chr(10)) AS text FROM pages),
    mlines AS (SELECT page_id, i, l[i] AS line FROM (SELECT page_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM md)),
    heads AS (SELECT *, regexp_matches({trim("line")}, '^#{{1,3}}(?:[^#]|$)') AS head FROM mlines),
    parts AS (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY i) AS part FROM heads),
    secs AS (SELECT page_id, part, max(CASE WHEN head THEN {trim("line")} END) AS h, {trim("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), '')")} AS body FROM parts GROUP BY ALL),
    full_secs AS (SELECT page_id, part, h, CASE WHEN h IS NULL THEN body WHEN body = '' THEN h ELSE h || chr(10) || chr(10) || body END AS text FROM secs),
    named AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part) - 1 AS chunk_index, h, text, len({words("text")})::BIGINT AS word_count FROM full_secs WHERE text <> ''),
    counted AS (SELECT page_id, chunk_index, text, word_count FROM named)"""

_SHARE = "trunc(512 / 1.33)::BIGINT"
_ROUTE = f"CASE WHEN len({words('text')}) + 1 + {_SHARE} <= 900 THEN 'stuff' ELSE 'mapReduce' END"
_STUFFED = first_words("'Summarise: ' || text", 20)


def _summaries(docs: str) -> str:
    """Map summaries of the sentence chunks of ``docs`` with their labels, their number, and what all of them count."""
    return f"""{sentence_chunks(120)},
    mapped AS (SELECT c.doc_id, chunk_index, '[Chunk ' || (chunk_index + 1)::VARCHAR || '] ' || {first_words("'Summarise this part: ' || c.text", 20)} AS s FROM chunks c JOIN {docs} USING (doc_id)),
    sizes AS (SELECT doc_id, count(*)::BIGINT AS n, sum(6 + len({words("s")}))::BIGINT AS size FROM mapped GROUP BY ALL)"""


def _merged(table: str) -> str:
    """``table(doc_id, g, i, n, s)`` -> the merge of each group."""
    prompt = f"'Merge the notes: ' || string_agg({section('s', 'i', 'n')}, chr(10) || chr(10) ORDER BY i)"
    return f"SELECT doc_id, g, {first_words(prompt, 20)} AS text, regexp_extract(first(s ORDER BY i), '\\[Chunks? ([\\d\\-]+)\\]', 1) AS a, regexp_extract(last(s ORDER BY i), '\\[Chunks? ([\\d\\-]+)\\]', 1) AS b FROM {table} GROUP BY ALL"


_ADAPTIVE = f"""WITH RECURSIVE {_summaries("docs")}, routed AS (SELECT doc_id, text, {_ROUTE} AS route FROM docs),
    deep AS (SELECT doc_id, n, size + 3 + {_SHARE} > 900 AS two FROM sizes),
    ones AS (SELECT m.doc_id, CASE WHEN two THEN chunk_index // 8 ELSE 0 END AS g, CASE WHEN two THEN chunk_index % 8 ELSE chunk_index END + 1 AS i,
      CASE WHEN two THEN least(8, n - (chunk_index // 8) * 8) ELSE n END AS n, s FROM mapped m JOIN deep USING (doc_id)),
    merged AS ({_merged("ones")}),
    twos AS (SELECT doc_id, 0 AS g, m.g + 1 AS i, ((n + 7) // 8) AS n, '[Chunks ' || a || '-' || b || '] ' || text AS s FROM merged m JOIN deep USING (doc_id) WHERE two),
    again AS ({_merged("twos")}),
    results AS (SELECT r.doc_id, r.route, CASE WHEN r.route = 'stuff' THEN {first_words("'Summarise: ' || r.text", 20)} WHEN d.two THEN a.text ELSE m.text END AS text,
      CASE WHEN r.route = 'stuff' THEN 0 ELSE d.n END::BIGINT AS n_chunks, CASE WHEN r.route = 'stuff' THEN 0 WHEN d.two THEN (d.n + 7) // 8 + 1 ELSE 1 END::BIGINT AS n_reduce
      FROM routed r LEFT JOIN deep d USING (doc_id) LEFT JOIN merged m ON m.doc_id = r.doc_id AND m.g = 0 AND NOT d.two LEFT JOIN again a ON a.doc_id = r.doc_id)"""

_PROMPTS = f"""WITH {fixed(128, 96)}, totals AS (SELECT doc_id, count(*) AS total FROM fixed GROUP BY ALL)
    SELECT doc_id, chunk_index, @prompt@ AS prompt FROM fixed JOIN totals USING (doc_id)"""
_SAID = f"{trim(f'''regexp_extract(text, '{SPEAKER}', 1)''')}"

ORACLES: dict[str, str] = {
    "word_token_counts": f"WITH {DOCS} SELECT doc_id, len({words('text')})::BIGINT AS n_words, greatest(1, trunc(len({words('text')}) * 1.33)::BIGINT) AS n_tokens FROM docs",
    "fixed_chunks": f"WITH {fixed(128, 128)} SELECT * FROM fixed",
    "fixed_chunks_overlap": f"WITH {fixed(128, 96)} SELECT * FROM fixed",
    "sentence_chunks": f"WITH RECURSIVE {sentence_chunks(120)} SELECT doc_id, chunk_index, text, word_count, start_word, start_word + word_count AS end_word FROM chunks",
    "turn_packing": f"""WITH RECURSIVE items AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, len({words('text')})::BIGINT AS n FROM conversations), {pack('items', 120)}
      SELECT p.k AS conv_id, p.c AS chunk_index, min(t.turn) AS first_turn, count(*)::BIGINT AS n_turns, sum(t.n)::BIGINT AS n_words FROM pack p JOIN items t ON t.k = p.k AND t.i = p.i GROUP BY ALL""",
    "budget_route": f"WITH {DOCS} SELECT doc_id, len({words('text')})::BIGINT AS n_words, {_ROUTE} AS route FROM docs",
    "prompt_budget": f"""WITH {DOCS}, n AS (SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len({words('text')}) END AS w, CASE WHEN text = '' THEN 0 ELSE greatest(1, trunc(len({words('text')}) * 1.33)::BIGINT) END AS t FROM docs)
      SELECT doc_id, w + 1 + {_SHARE} <= 900 AS fits_words, t + 1 + 512 <= 1500 AS fits_tokens, t::BIGINT AS n_tokens FROM n""",
    "route_summary": f"WITH {DOCS} SELECT {_ROUTE} AS route, count(*)::BIGINT AS n_docs, sum(len({words('text')}))::BIGINT AS n_words FROM docs GROUP BY 1",
    "transcript_mode": "SELECT conv_id, count(DISTINCT role)::BIGINT AS n_speakers, CASE WHEN count(DISTINCT role) >= 2 THEN 'speaker' ELSE 'temporal' END AS mode FROM conversations GROUP BY conv_id",
    "transcript_speaker_chunks": transcript(False),
    "transcript_temporal_chunks": transcript(True),
    "transcript_overlap_chunks": f"""WITH RECURSIVE {TURNS}, {overlapped('turns', 120, 1)},
      firsts AS (SELECT k, i, (sum(n) OVER (PARTITION BY k ORDER BY i) - n)::BIGINT AS start_word FROM turns)
      SELECT w.k AS conv_id, w.c AS chunk_index, string_agg(t.line, chr(10) ORDER BY t.i) AS text, sum(t.n)::BIGINT AS word_count, min(f.start_word) AS start_word, (min(f.start_word) + sum(t.n))::BIGINT AS end_word
      FROM walk w JOIN turns t ON t.k = w.k AND t.i BETWEEN w.s AND w.e JOIN firsts f ON f.k = t.k AND f.i = t.i GROUP BY w.k, w.c""",
    "log_blocks": f"WITH {_LOG_LINES} SELECT * FROM blocks",
    "log_kind_severity": f"WITH {_LOG_LINES} SELECT user_id, block, 'unknown' AS kind, NULL::VARCHAR AS process, NULL::VARCHAR AS subsystem, NULL::VARCHAR AS category, {_SEVERITY} AS severity FROM blocks",
    "log_chunks": f"WITH RECURSIVE {_LOG_CHUNKS} SELECT user_id, chunk_index, text, word_count, (sum(word_count) OVER (PARTITION BY user_id ORDER BY chunk_index) - word_count)::BIGINT AS start_word, 'unknown' AS kind, severity, times FROM made",
    "diagnostic_labels": f"WITH RECURSIVE {_LOG_CHUNKS} SELECT user_id, chunk_index, '[Chunk ' || (chunk_index + 1)::VARCHAR || ']' AS label FROM made",
    "markdown_sections": f"WITH {_MARKDOWN} SELECT *, (sum(word_count) OVER (PARTITION BY page_id ORDER BY chunk_index) - word_count)::BIGINT AS start_word, (sum(word_count) OVER (PARTITION BY page_id ORDER BY chunk_index))::BIGINT AS end_word FROM counted",
    "markdown_chunks": rf"""WITH RECURSIVE {_MARKDOWN}, lists AS (SELECT page_id * 100000 + chunk_index AS k, page_id, chunk_index AS part, h, list_filter(list_transform(string_split_regex(
      regexp_replace(c.text, '([.!?]+[)"]*)[ \t]+([^a-z \t\n])', '\1' || chr(1) || '\2', 'g'), '[' || chr(1) || chr(10) || ']'), lambda s: {trim("s")}), lambda s: s <> '') AS l, c.text, word_count FROM named c),
      items AS (SELECT k, i, l[i] AS s, len({words("l[i]")})::BIGINT AS n FROM (SELECT k, l, unnest(range(1, len(l) + 1)) AS i FROM lists WHERE word_count > 120)), {pack("items", 120)},
      pieces AS (SELECT p.k, p.c, string_agg(t.s, ' ' ORDER BY t.i) AS text FROM pack p JOIN items t ON t.k = p.k AND t.i = p.i GROUP BY ALL),
      every AS (SELECT page_id, part, coalesce(c, 0) AS c, CASE WHEN p.k IS NULL THEN l.text WHEN h IS NULL THEN p.text ELSE h || chr(10) || chr(10) || p.text END AS text FROM lists l LEFT JOIN pieces p USING (k)),
      sized AS (SELECT page_id, row_number() OVER w - 1 AS chunk_index, text, len({words("text")})::BIGINT AS word_count FROM every WINDOW w AS (PARTITION BY page_id ORDER BY part, c))
      SELECT page_id, chunk_index, text, word_count, (sum(word_count) OVER w - word_count)::BIGINT AS start_word, (sum(word_count) OVER w)::BIGINT AS end_word FROM sized WINDOW w AS (PARTITION BY page_id ORDER BY chunk_index)""",
    "crash_sections": """SELECT s_suppkey AS supp_id, i::BIGINT AS chunk_index, kind, n::BIGINT AS word_count, 'app' || s_suppkey::VARCHAR || ' [12]' AS process, 'SIGSEGV' AS signal, '0' AS crashed_thread, 'partiallySymbolicated' AS symbolication
      FROM supplier, (VALUES (0, 'crashHeader', 16), (1, 'exceptionInfo', 11), (2, 'diagnosticMessage', 5), (3, 'crashedThread', 29), (4, 'registers', 12), (5, 'binaryImages', 6)) v(i, kind, n)""",
    "map_prompts_raw": _PROMPTS.replace("@prompt@", "'Summarise this part: ' || text"),
    "map_prompts_delimited": _PROMPTS.replace("@prompt@", f"""'Summarise this part: ' || chr(10) || chr(10) || '<source index="' || chunk_index::VARCHAR || '" of="' || total::VARCHAR || '" words="' || start_word::VARCHAR || '-' || end_word::VARCHAR || '"'
      || CASE WHEN {_SAID} = '' THEN '' ELSE ' speaker="' || {_SAID} || '"' END || '>' || chr(10) || text || chr(10) || '</source>'"""),
    "stuff_summary": f"WITH {DOCS} SELECT doc_id, 'stuff' AS route, {_STUFFED} AS text, NULL::VARCHAR AS error, 0::BIGINT AS n_chunks, 0::BIGINT AS n_reduce FROM docs",
    "map_reduce_summary": f"""WITH RECURSIVE {_summaries('docs')}, ones AS (SELECT doc_id, 0 AS g, chunk_index + 1 AS i, n, s FROM mapped JOIN sizes USING (doc_id)), merged AS ({_merged('ones')})
      SELECT docs.doc_id, 'mapReduce' AS route, coalesce(merged.text, '') AS text, NULL::VARCHAR AS error, coalesce(n, 0)::BIGINT AS n_chunks, (n IS NOT NULL)::BIGINT AS n_reduce FROM docs LEFT JOIN merged USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "adaptive_summary": f"{_ADAPTIVE} SELECT doc_id, route, text, NULL::VARCHAR AS error, n_chunks, n_reduce FROM results",
    "chain_metrics": f"{_ADAPTIVE} SELECT route, count(*)::BIGINT AS n_docs, sum(n_chunks)::BIGINT AS n_chunks, sum(n_chunks)::BIGINT AS n_map, sum(n_reduce)::BIGINT AS n_reduce FROM results GROUP BY route",
    "run_events": f"""{_ADAPTIVE} SELECT doc_id, v.kind AS type, v.phase, v.n::BIGINT AS n FROM results, LATERAL (VALUES
      ('progress', CASE WHEN route = 'stuff' THEN 'stuffing' ELSE 'mapping' END, CASE WHEN route = 'stuff' THEN 1 ELSE n_chunks END), ('progress', 'reducing', n_reduce), ('progress', 'complete', 1), ('chunk', NULL, 1), ('result', NULL, 1)) v(kind, phase, n) WHERE v.n > 0""",
    "json_extract": """SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN user_id END AS "user",
      CASE WHEN event_id % 7 = 0 THEN 'invalidJSON' WHEN event_id % 5 = 0 THEN 'schemaMismatch' END AS error FROM events""",
    "coverage_check": f"WITH {DOCS} SELECT doc_id, len({words('text')})::BIGINT AS n_words, len({words('text')})::BIGINT AS n_chunked, len({words('text')})::BIGINT AS last_word FROM docs",
    "prompt_templates": "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(t.map_prompt)}, {quoted(t.reduce_prompt)}, {quoted(t.stuff_prompt)})" for k, t in TEMPLATES.items()) + ") v(name, map_prompt, reduce_prompt, stuff_prompt)",
}
ORACLES |= more_oracles.ORACLES
