"""DuckDB SQL for the further registered queries, and for document structure, code and hierarchical reduce."""

from __future__ import annotations

import re

from paperloom.plans.prompts import TEMPLATES
from paperloom.sql_parts import DOCS, SENTENCES, TURNS, first_words, overlapped, pack, quoted, section, sentence_chunks, transcript, trim, words

#: Number, kind, process, subsystem, category, severity and words of each block of the log with all kinds; @ as in the text.
_KINDS = """kinds(i, kind, process, subsystem, category, severity, n, second, body) AS (VALUES
    (1, 'testFailure', NULL, NULL, NULL, 'error', 8, '01', '2024-01-02 03:04:01 Test Case ''AppTests.testLogin@'' failed (0.1 seconds).'),
    (2, 'linkerError', NULL, NULL, NULL, 'error', 7, '02', '2024-01-02 03:04:02 Undefined symbols for architecture arm64'),
    (3, 'xcodeBuildError', NULL, NULL, NULL, 'error', 10, '03', '2024-01-02 03:04:03 Command SwiftCompile failed with a nonzero exit code'),
    (4, 'swiftCompilerError', NULL, NULL, NULL, 'warning', 7, '04', '2024-01-02 03:04:04 compile
/src/File@.swift:12:5: warning: unused value'),
    (5, 'runtimeWarning', 'app@', NULL, NULL, 'warning', 8, '05', '2024-01-02 03:04:05 app@[12:34] Main Thread Checker: interface call'),
    (6, 'runtimeWarning', NULL, NULL, NULL, 'fatal', 8, '06', '2024-01-02 03:04:06 Fatal error: index out of range'),
    (7, 'simulatorLog', 'board@', 'com.example.ui', NULL, 'debug', 6, '07', '2024-01-02 03:04:07.123+0100 board@[55:66] [com.example.ui] debug layout'),
    (8, 'simulatorLog', 'board@', NULL, 'layout', 'info', 6, '08', '2024-01-02 03:04:08.5 board@[5:6] [layout] info pass'),
    (9, 'consoleLog', 'netd', 'net.example', NULL, 'fatal', 8, '09', '2024-01-02 03:04:09 console
03:04:09.1+0000 netd[7:8] [net.example] fatal drop'),
    (10, 'stackTrace', NULL, NULL, NULL, NULL, 15, '10', '2024-01-02 03:04:10 trace
0   app   0x0000000100000001 main
1   lib   0x0000000100000002 start
2   lib   0x0000000100000003 wait'),
    (11, 'unknown', NULL, NULL, NULL, 'info', 5, '11', '2024-01-02 03:04:11 info started @'),
    (12, 'unknown', NULL, NULL, NULL, 'debug', 4, '12', '2024-01-02 03:04:12 debug stopped'))"""
_OF = lambda c: f"replace({c}, '@', s_suppkey::VARCHAR)"
#: The blocks in groups: a new one where the words go over the target or another known kind begins.
_KIND_CHUNKS = f"""{_KINDS}, cut AS (SELECT i, 0 AS c, n AS total, kind AS known FROM kinds WHERE i = 1
      UNION ALL SELECT k.i, CASE WHEN w THEN c + 1 ELSE c END, CASE WHEN w THEN n ELSE total + n END, CASE WHEN w OR known = 'unknown' THEN kind ELSE known END
      FROM (SELECT k.*, p.c, p.total, p.known, total + n > 14 OR (kind <> 'unknown' AND known <> 'unknown' AND kind <> known) AS w FROM cut p JOIN kinds k ON k.i = p.i + 1) k),
    made AS (SELECT s_suppkey AS supp_id, c::BIGINT AS chunk_index, sum(n)::BIGINT AS word_count, coalesce(first(kind ORDER BY i) FILTER (WHERE kind <> 'unknown'), 'unknown') AS kind,
      first({_OF('process')} ORDER BY i) FILTER (WHERE process IS NOT NULL) AS process, first(subsystem ORDER BY i) FILTER (WHERE subsystem IS NOT NULL) AS subsystem,
      first(category ORDER BY i) FILTER (WHERE category IS NOT NULL) AS category, first(severity ORDER BY i) FILTER (WHERE severity IS NOT NULL) AS severity,
      '2024-01-02 03:04:' || min(second) AS first_time, '2024-01-02 03:04:' || max(second) AS last_time, string_agg({_OF('body')}, chr(10) ORDER BY i) AS text FROM cut JOIN kinds USING (i), supplier GROUP BY 1, 2)"""
_KIND_LABEL = r"""'[' || concat_ws(', ', 'Chunk ' || (chunk_index + 1)::VARCHAR, nullif(kind, 'unknown'), CASE WHEN kind IN ('simulatorLog', 'consoleLog', 'runtimeWarning') THEN process END,
      CASE kind WHEN 'xcodeBuildError' THEN nullif(regexp_extract(text, 'Command (\w+) failed', 1), '') WHEN 'testFailure' THEN nullif(regexp_extract(text, 'Test Case ''(\S+)'' failed', 1), '') END,
      CASE WHEN kind IN ('xcodeBuildError', 'swiftCompilerError', 'testFailure') THEN severity END) || ']'"""

#: The sections of a text with topics, and the two segments of one without.
_TOPICS = f"""items AS (SELECT s_suppkey AS k, i, n::BIGINT AS n, replace(body, '@', s_suppkey::VARCHAR) AS body, replace(topic, '@', s_suppkey::VARCHAR) AS topic, times, mode
      FROM supplier, (VALUES (1, 6, '# Intro @' || chr(10) || 'first words here', 'Intro @', NULL, 'topical'), (2, 5, '**Bold Part**' || chr(10) || 'more and more', 'Bold Part', NULL, 'topical'),
        (3, 4, 'PLAIN CAPS' || chr(10) || 'x y', 'PLAIN CAPS', NULL, 'topical'), (4, 7, 'Topic: Last one' || chr(10) || 'z at 10:30 z', 'Last one', '10:30', 'topical'),
        (1, 4, 'just one line @', NULL, NULL, 'temporal'), (2, 3, '01:02 another line', NULL, '01:02', 'temporal')) v(i, n, body, topic, times, mode)
      WHERE s_suppkey % 5 <> 3 AND (mode = 'temporal') = (s_suppkey % 5 = 4)), {pack('items', 8)}"""


def _structure(target: int) -> str:
    """The blocks of each page's document with their places, and the groups that they are packed into."""
    after = [("table", "| key | value |\n|---|---|\n| page | here |", 11, 0), ("codeBlock", "```\n# not a heading\nrun()\n```", 7, 0), ("list", "- first item\n- second item", 6, 0), ("blockQuote", "> quoted words", 3, 0)]
    after += [("thematicBreak", "---", 0, 0), ("figureCaption", "![a figure](f.png)", 2, 0), ("footnote", "[^1]: a note", 3, 0), ("heading", "Title\n=====", 2, 1), ("paragraph", "last words", 2, 1)]
    tail = ", ".join(f"({k}, {quoted(kind)}, {quoted(text)}, {n}, {top})" for k, (kind, text, n, top) in enumerate(after))
    return rf"""pieces AS (SELECT page_id, {trim("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title, list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: {trim("regexp_replace(x, '<[^>]+>', '', 'g')")}) AS ps FROM pages),
    parts AS (SELECT page_id, title, len(ps) AS m, unnest(range(1, len(ps) + 1)) AS j, ps FROM pieces),
    listed AS (SELECT page_id AS k, 0 AS o, 'heading' AS kind, '# ' || title AS text, len({words("'# ' || title")})::BIGINT AS n, NULL::BIGINT AS page, [title] AS path FROM pieces
      UNION ALL SELECT page_id, 2 * j, 'heading', '## Part ' || j::VARCHAR, 3, j, [title, 'Part ' || j::VARCHAR] FROM parts
      UNION ALL SELECT page_id, 2 * j + 1, 'paragraph', ps[j], len({words("ps[j]")})::BIGINT, j, [title, 'Part ' || j::VARCHAR] FROM parts
      UNION ALL SELECT page_id, 1000000 + v.o, kind, text, n, nullif(len(ps), 0), CASE WHEN top = 1 THEN ['Title'] WHEN len(ps) = 0 THEN [title] ELSE [title, 'Part ' || len(ps)::VARCHAR] END FROM pieces, (VALUES {tail}) v(o, kind, text, n, top)),
    blocks AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS i, kind IN ('table', 'codeBlock') AND n > {target} AS whole FROM listed),
    walk AS (SELECT k, i, CASE WHEN whole THEN 1 ELSE 0 END AS mine, CASE WHEN whole THEN 2 ELSE 0 END AS c, CASE WHEN whole THEN 0 ELSE n END AS total, CASE WHEN whole THEN 0 ELSE 1 END AS cnt, n AS lastn, kind = 'heading' AS head, false AS carried FROM blocks WHERE i = 1
      UNION ALL SELECT b.k, b.i, CASE WHEN whole OR over THEN c + 1 ELSE c END, CASE WHEN whole THEN c + 2 WHEN over THEN c + 1 ELSE c END,
        CASE WHEN whole THEN 0 WHEN over THEN b.n + CASE WHEN takes THEN lastn ELSE 0 END ELSE total + b.n END, CASE WHEN whole THEN 0 WHEN over THEN 1 + takes::INT ELSE cnt + 1 END, b.n, b.kind = 'heading', over AND takes AND NOT whole
      FROM (SELECT b.*, w.c, w.total, w.cnt, w.lastn, NOT b.whole AND w.total > 0 AND w.total + b.n > {target} AS over, w.cnt > 1 AND w.head AS takes FROM walk w JOIN blocks b ON b.k = w.k AND b.i = w.i + 1) b),
    placed AS (SELECT k, i, CASE WHEN lead(carried) OVER (PARTITION BY k ORDER BY i) THEN lead(mine) OVER (PARTITION BY k ORDER BY i) ELSE mine END AS g FROM walk),
    heads AS (SELECT k, g, bool_and(kind = 'heading') AS only_heads FROM placed JOIN blocks USING (k, i) GROUP BY k, g),
    joined AS (SELECT k, g, sum(CASE WHEN coalesce(before, true) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY g) AS c FROM (SELECT *, lag(only_heads) OVER (PARTITION BY k ORDER BY g) AS before FROM heads)),
    grouped AS (SELECT k, i, c FROM placed JOIN joined USING (k, g))"""


def _structure_rows(target: int, overlap: bool) -> str:
    more = "SELECT * FROM grouped" + (" UNION ALL SELECT k, max(i), c + 1 FROM grouped g WHERE EXISTS (SELECT 1 FROM grouped h WHERE h.k = g.k AND h.c = g.c + 1) GROUP BY k, c" if overlap else "")
    return f"""WITH RECURSIVE {_structure(target)}, members AS ({more}),
    types AS (SELECT k, c, kind, min(i) AS i FROM members JOIN blocks USING (k, i) GROUP BY k, c, kind),
    named AS (SELECT k, c, string_agg(kind, ',' ORDER BY i) AS blocks, coalesce(first(kind ORDER BY i) FILTER (WHERE kind NOT IN ('paragraph', 'unknown', 'thematicBreak')), 'paragraph') AS block FROM types GROUP BY k, c)
    SELECT m.k AS page_id, m.c::BIGINT AS chunk_index, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, sum(n)::BIGINT AS word_count, array_to_string(first(path ORDER BY i), ' > ') AS headings,
      any_value(block) AS block, any_value(named.blocks) AS blocks, min(page) AS first_page, max(page) AS last_page FROM members m JOIN blocks USING (k, i) JOIN named ON named.k = m.k AND named.c = m.c GROUP BY m.k, m.c"""


def _code(target: int) -> str:
    """Prose before the code by paragraphs, the code, and the prose after it."""
    before = "'# ' || title || chr(10) || chr(10) || array_to_string(list_transform(ps, lambda p, j: '[page ' || j::VARCHAR || ']' || chr(10) || '## Part ' || j::VARCHAR || chr(10) || p), chr(10) || chr(10)) || chr(10) || chr(10) || '| key | value |' || chr(10) || '|---|---|' || chr(10) || '| page | here |' || chr(10)"
    after = quoted("\n- first item\n- second item\n\n> quoted words\n\n---\n\n![a figure](f.png)\n\n[^1]: a note\n\nTitle\n=====\nlast words")
    return rf"""WITH RECURSIVE pieces AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title, list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')) AS ps FROM pages),
    prose AS (SELECT page_id, 0 AS part, string_split({before}, chr(10) || chr(10)) AS l FROM pieces UNION ALL SELECT page_id, 2, string_split({after}, chr(10) || chr(10)) FROM pieces),
    listed AS (SELECT page_id AS k, part, j, l[j] AS text, false AS code FROM (SELECT page_id, part, l, unnest(range(1, len(l) + 1)) AS j FROM prose) UNION ALL SELECT page_id, 1, 1, {quoted("```" + chr(10) + "# not a heading" + chr(10) + "run()" + chr(10) + "```")}, true FROM pieces),
    sized AS (SELECT k, part, j, text, code, len({words("text")})::BIGINT AS n FROM listed),
    items AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY part, j) AS i, text, code, n FROM sized WHERE n > 0),
    pack AS (SELECT k, i, 0::BIGINT AS c, n AS total, code, code AND n >= {target} AS done FROM items WHERE i = 1
      UNION ALL SELECT t.k, t.i, CASE WHEN w THEN c + 1 ELSE c END, CASE WHEN w THEN n ELSE total + n END, t.code, t.code AND CASE WHEN w THEN n ELSE total + n END >= {target}
      FROM (SELECT t.*, p.c, p.total, p.done OR (p.total > 0 AND (p.code <> t.code OR p.total + t.n > {target})) AS w FROM pack p JOIN items t ON t.k = p.k AND t.i = p.i + 1) t)
    SELECT p.k AS page_id, c AS chunk_index, string_agg(text, chr(10) ORDER BY i) AS text, sum(n)::BIGINT AS word_count, '' AS headings, CASE WHEN bool_or(t.code) THEN 'codeBlock' END AS block, '' AS blocks, NULL::BIGINT AS first_page, NULL::BIGINT AS last_page
      FROM pack p JOIN items t USING (k, i) GROUP BY p.k, c"""


def _renamed(sql: str, names: str, suffix: str) -> str:
    for name in names.split():
        sql = re.sub(rf"\b{name}\b", name + suffix, sql)
    return sql


def _two_targets(wide: int, narrow: int, most: int) -> str:
    """Sentence chunks of ``wide`` words, or of ``narrow`` for documents with a chunk over ``most`` words."""
    again = sentence_chunks(narrow)
    again = _renamed(again[again.index("pack AS") :], "pack grouped chunks", "_b")
    return f"""{sentence_chunks(wide)}, {again}, largest AS (SELECT doc_id, max(word_count) > {most} AS cut FROM chunks GROUP BY doc_id),
    fitting AS (SELECT c.* FROM chunks c JOIN largest USING (doc_id) WHERE NOT cut UNION ALL SELECT c.* FROM chunks_b c JOIN largest USING (doc_id) WHERE cut)"""


def _levels(depth: int) -> str:
    """Reduce levels of summaries of 12 words, four in a group at most, until one call of 160 words holds all."""
    chunk_label = r"'\[Chunks? ([\d\-]+)\]'"
    out = [f"{_two_targets(60, 61, 61)}, s0 AS (SELECT doc_id, chunk_index + 1 AS i, '[Chunk ' || (chunk_index + 1)::VARCHAR || '] ' || " + first_words("'Summarise this part: ' || text", 12) + " AS s FROM fitting)"]
    for k in range(depth):
        prompt = f"'Merge the notes: ' || string_agg({section('s', 'i', 'n')}, chr(10) || chr(10) ORDER BY i)"
        out.append(f"""z{k} AS (SELECT doc_id, sum(6 + len({words('s')})) + 3 <= 160 AS ends, count(*)::BIGINT AS n FROM s{k} GROUP BY doc_id),
    d{k} AS (SELECT doc_id, CASE WHEN ends THEN 0 ELSE (i - 1) // 4 END AS g, CASE WHEN ends THEN i ELSE (i - 1) % 4 + 1 END AS i, CASE WHEN ends THEN n ELSE least(4, n - (i - 1) // 4 * 4) END AS n, s, ends FROM s{k} JOIN z{k} USING (doc_id)),
    m{k} AS (SELECT doc_id, g, any_value(ends) AS ends, {first_words(prompt, 12)} AS text, regexp_extract(first(s ORDER BY i), {chunk_label}, 1) AS a, regexp_extract(last(s ORDER BY i), {chunk_label}, 1) AS b FROM d{k} GROUP BY doc_id, g),
    s{k + 1} AS (SELECT doc_id, g + 1 AS i, '[Chunks ' || a || '-' || b || '] ' || text AS s FROM m{k} WHERE NOT ends)""")
    ends = " UNION ALL ".join(f"SELECT doc_id, {k} AS level, max(CASE WHEN ends THEN text END) AS text, count(*) AS calls FROM m{k} GROUP BY doc_id" for k in range(depth))
    return f"{', '.join(out)}, calls AS ({ends}), results AS (SELECT doc_id, max(text) AS text, string_agg(calls::VARCHAR, ',' ORDER BY level) AS levels FROM calls GROUP BY doc_id)"


_TOKENS = lambda n: f"greatest(1, trunc(({n}) * 1.33)::BIGINT)"
_TEMPLATE = TEMPLATES["transcriptSummary"]
_NATIONS = "(SELECT string_agg(n_name, ' ' ORDER BY n_nationkey) FROM nation)"
_STUFFED_NATIONS = first_words(f"'Summarise: ' || {_NATIONS}", 6)
_LIVE = f"list_transform(string_split('Summarise: ' || {_NATIONS}, ' ')[1:4], lambda x: x)"


def map_reduce(map_task: str, reduce_task: str, n: int) -> str:
    """One map call for each sentence chunk of 120 words and one reduce call, both answered by the first ``n`` words."""
    return f"""WITH RECURSIVE {sentence_chunks(120)},
    mapped AS (SELECT doc_id, chunk_index + 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, '[Chunk ' || (chunk_index + 1)::VARCHAR || '] ' || {first_words(quoted(map_task) + " || text", n)} AS s FROM chunks),
    merged AS (SELECT doc_id, any_value(n)::BIGINT AS n, {first_words(f"{quoted(reduce_task)} || string_agg({section('s', 'i', 'n')}, chr(10) || chr(10) ORDER BY i)", n)} AS text FROM mapped GROUP BY doc_id)"""


_CRASH = """(VALUES (true, 0, 'crashHeader', 16, 0), (true, 1, 'exceptionInfo', 11, 16), (true, 2, 'diagnosticMessage', 5, 27), (true, 3, 'crashedThread', 29, 32), (true, 4, 'registers', 12, 61),
    (false, 0, 'crashHeader', 16, 0), (false, 1, 'exceptionInfo', 11, 16), (false, 2, 'diagnosticMessage', 5, 27), (false, 3, 'crashedThread', 9, 32), (false, 4, 'crashedThread', 6, 41), (false, 5, 'crashedThread', 8, 47),
    (false, 6, 'crashedThread', 6, 55), (false, 7, 'registers', 12, 61)) v(whole_thread, i, kind, n, w)"""

ORACLES: dict[str, str] = {
    "docstructure_chunks": _structure_rows(10, False),
    "docstructure_overlap": _structure_rows(40, True),
    "codeblock_chunks": _code(40),
    "sentence_overlap_chunks": f"""WITH RECURSIVE {SENTENCES} {overlapped('items', 120, 1)},
      firsts AS (SELECT k, i, (sum(n) OVER (PARTITION BY k ORDER BY i) - n)::BIGINT AS start_word FROM items)
      SELECT w.k AS doc_id, w.c AS chunk_index, string_agg(t.s, ' ' ORDER BY t.i) AS text, sum(t.n)::BIGINT AS word_count, min(f.start_word) AS start_word, (min(f.start_word) + sum(t.n))::BIGINT AS end_word
      FROM walk w JOIN items t ON t.k = w.k AND t.i BETWEEN w.s AND w.e JOIN firsts f ON f.k = t.k AND f.i = t.i GROUP BY w.k, w.c""",
    "hierarchical_labels": f"""WITH RECURSIVE {_levels(8)} SELECT docs.doc_id, coalesce(r.text, '') AS text, NULL::VARCHAR AS error, coalesce(f.n, 0)::BIGINT AS n_chunks, coalesce(levels, '') AS levels
      FROM docs LEFT JOIN results r USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM fitting GROUP BY doc_id) f USING (doc_id)""",
    "reduce_depth": f"""WITH RECURSIVE {_levels(2)} SELECT docs.doc_id, CASE WHEN r.doc_id IS NULL THEN '' ELSE r.text END AS text, CASE WHEN r.doc_id IS NOT NULL AND r.text IS NULL THEN 'reduceDepthExceeded' END AS error, coalesce(levels, '') AS levels
      FROM docs LEFT JOIN results r USING (doc_id)""",
    "log_kinds": f"WITH {_KINDS} SELECT s_suppkey AS supp_id, i::BIGINT AS block, kind, {_OF('process')} AS process, subsystem, category, severity FROM kinds, supplier",
    "log_kind_chunks": f"WITH RECURSIVE {_KIND_CHUNKS} SELECT supp_id, chunk_index, word_count, (sum(word_count) OVER (PARTITION BY supp_id ORDER BY chunk_index) - word_count)::BIGINT AS start_word, kind, process, subsystem, category, severity, first_time, last_time FROM made",
    "kind_labels": f"WITH RECURSIVE {_KIND_CHUNKS} SELECT supp_id, chunk_index, {_KIND_LABEL} AS label, {_KIND_LABEL} || chr(10) || text AS labelled FROM made",
    "topic_chunks": f"""WITH RECURSIVE {_TOPICS}, made AS (SELECT p.k, p.c, string_agg(body, chr(10) || chr(10) ORDER BY i) AS text, sum(t.n)::BIGINT AS word_count, first(topic ORDER BY i) AS topic_label, any_value(mode) AS attribution_type,
      coalesce(string_agg(times, ',' ORDER BY i), '') AS times FROM pack p JOIN items t USING (k, i) GROUP BY p.k, p.c)
      SELECT k AS supp_id, c AS chunk_index, text, word_count, (sum(word_count) OVER (PARTITION BY k ORDER BY c) - word_count)::BIGINT AS start_word, topic_label, attribution_type, times FROM made""",
    "time_ranges": f"SELECT conv_id, chunk_index, nullif(string_split(times, ',')[1], '') AS first_time, nullif(string_split(times, ',')[-1], '') AS last_time, nullif(string_split(times, ',')[-1], '') AS last_of_column FROM ({transcript(True)})",
    "report_detectors": """SELECT s_suppkey AS supp_id, given, given = 'crash' AS is_crash, given = 'json' AS is_json, given = 'topics' AND s_suppkey % 5 < 3 AS has_topics FROM supplier, (VALUES ('crash'), ('json'), ('topics')) v(given)""",
    "line_facts": """SELECT s_suppkey AS supp_id, 'log' AS given, i AS line_no, CASE WHEN i = 2 THEN 'SwiftCompile' END AS command, CASE WHEN i = 0 THEN 'AppTests.testLogin' || s_suppkey::VARCHAR END AS test, NULL::VARCHAR AS heading FROM supplier, (SELECT unnest(range(17))::INT AS i)
      UNION ALL SELECT s_suppkey, 'topic', i, NULL, NULL, replace(h, '@', s_suppkey::VARCHAR) FROM supplier, (VALUES (0, 'Intro @'), (2, 'Bold Part'), (4, 'PLAIN CAPS'), (6, 'Last one')) v(i, h) WHERE s_suppkey % 5 < 3""",
    "split_reports": f"SELECT s_suppkey AS supp_id, whole_thread, i::BIGINT AS chunk_index, kind, n::BIGINT AS word_count, w::BIGINT AS start_word FROM supplier, {_CRASH}",
    "json_reports": """SELECT s_suppkey AS supp_id, i::BIGINT AS chunk_index, replace(t, '@', s_suppkey::VARCHAR) AS text, kind, n::BIGINT AS word_count, true AS bare FROM supplier, (VALUES
      (0, '{"app_name":"app@",' || chr(10) || '"bundleID": "org.example",', 'crashHeader', 3), (1, '"exception":"EXC @",', 'exceptionInfo', 2), (2, '"faultingThread":0,', 'crashedThread', 1),
      (3, '"threads":[' || chr(10) || '{"frame": 1}],', 'threadBacktrace', 3), (4, '"usedImages":[1]}', 'binaryImages', 1)) v(i, t, kind, n)""",
    "budget_numbers": f"""WITH {DOCS} SELECT doc_id, len({words('text')}) + 25 <= 300 AS fits_words, len({words('text')}) + 5 <= trunc(400 / 1.33) AS fits_tokens, 300 - 2 - 3 - trunc(64 / 1.33)::INT - trunc(128 / 1.33)::INT AS free_words,
      400 - trunc(2 * 1.33)::INT - trunc(3 * 1.33)::INT - 64 - 128 AS free_tokens, 350 - trunc(2 * 1.33)::INT - trunc(3 * 1.33)::INT - 64 - 128 AS free_aware,
      300 - 2 - 3 - trunc(64 / 1.33)::INT - trunc(128 / 1.33)::INT AS target_words, trunc((400 - 5 - 192) / 1.33)::INT AS target_tokens, trunc((350 - 5 - 192) / 1.5)::INT AS target_aware FROM docs""",
    "rechunked_sentences": f"WITH RECURSIVE {_two_targets(900, 417, 417)} SELECT doc_id, chunk_index, word_count, start_word FROM fitting",
    "template_summary": f"{map_reduce(_TEMPLATE.map_prompt, _TEMPLATE.reduce_prompt, 60)} SELECT docs.doc_id, coalesce(merged.text, '') AS text, coalesce(n, 0)::BIGINT AS n_chunks FROM docs LEFT JOIN merged USING (doc_id)",
    "token_aware": f"""WITH {DOCS}, n AS (SELECT doc_id, text = '' AS none, len({words('text')}) AS w FROM docs), r AS (SELECT *, 1 + CASE WHEN none THEN 0 ELSE {_TOKENS('w')} END + 512 <= 1500 AS one FROM n)
      SELECT doc_id, CASE WHEN one THEN 'stuff' ELSE 'mapReduce' END AS route, CASE WHEN one THEN {_TOKENS('w + 1')} END AS tokens_in, CASE WHEN one THEN {_TOKENS('least(20, w + 1)')} END AS tokens_out, NOT one OR w + 1 > 20 AS more_in FROM r""",
    "stuff_prompts": f"WITH {DOCS} SELECT doc_id, 'Summarise: ' || chr(10) || chr(10) || '<source words=\"0-' || len({words('text')})::VARCHAR || '\">' || chr(10) || text || chr(10) || '</source>' AS prompt FROM docs",
    "streamed_events": """SELECT doc_id, v.seq::BIGINT AS seq, v.type, v.text, v.phase FROM documents, (VALUES (0, 'progress', NULL, 'stuffing'), (1, 'chunk', 'three', NULL), (2, 'chunk', ' short', NULL), (3, 'chunk', ' words', NULL), (4, 'progress', NULL, 'complete'), (5, 'result', 'three short words', NULL)) v(seq, type, text, phase)""",
    "one_text": f"""SELECT source, seq::BIGINT AS seq, type, text, phase FROM (SELECT 'run' AS source, 0 AS seq, 'progress' AS type, NULL AS text, 'stuffing' AS phase UNION ALL SELECT 'run', 1, 'chunk', {_STUFFED_NATIONS}, NULL
      UNION ALL SELECT 'run', 2, 'progress', NULL, 'complete' UNION ALL SELECT 'run', 3, 'result', {_STUFFED_NATIONS}, NULL UNION ALL SELECT 'metadata', 0, 'result', {_STUFFED_NATIONS}, NULL
      UNION ALL SELECT 'live', 0, 'progress', NULL, 'stuffing' UNION ALL SELECT 'live', i, 'chunk', l[i], NULL FROM (SELECT {_LIVE} AS l), range(1, 5) t(i)
      UNION ALL SELECT 'live', 5, 'progress', NULL, 'complete' UNION ALL SELECT 'live', 6, 'result', array_to_string({_LIVE}, ''), NULL)""",
    "retried_calls": f"{map_reduce('Summarise this part: ', 'Merge the notes: ', 20)} SELECT docs.doc_id, 'mapReduce' AS route, coalesce(merged.text, '') AS text, NULL::VARCHAR AS error, coalesce(n, 0)::BIGINT AS n_chunks, (n IS NOT NULL)::BIGINT AS n_reduce FROM docs LEFT JOIN merged USING (doc_id)",
    "completion_order": f"{map_reduce('Summarise this part: ', 'Merge the notes: ', 6)}, sorted AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS l FROM mapped GROUP BY doc_id) SELECT docs.doc_id, coalesce(l, '') AS summaries FROM docs LEFT JOIN sorted USING (doc_id)",
    "json_retries": """SELECT event_id, CASE WHEN event_type <> 'purchase' THEN event_type END AS kind, CASE WHEN event_type = 'purchase' THEN 'retriesExhausted: invalidJSON' END AS error,
      CASE WHEN event_type = 'purchase' THEN 'nothing' ELSE '```json' || chr(10) || '{"kind": "' || event_type || '"}' || chr(10) || '```' END AS raw_text FROM events""",
    "written_formats": f"""WITH {DOCS} SELECT format, doc_id::VARCHAR AS doc_id, len({words('text')})::BIGINT AS n_words FROM docs, (VALUES ('table'), ('json')) v(format)
      UNION ALL SELECT 'files', 'all', 2 * sum(len({words('r_name')}))::BIGINT FROM region""",
    "memory_gate": "SELECT s_suppkey AS supp_id, CASE WHEN abs(s_acctbal) / 10 < 100 THEN 'critical' WHEN abs(s_acctbal) / 10 < 300 THEN 'warning' ELSE 'ok' END AS level, abs(s_acctbal) / 10 >= 100 AS proceed FROM supplier",
}
