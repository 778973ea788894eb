"""Parts of the DuckDB SQL that several queries share."""

from __future__ import annotations

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{_WS}'), lambda w: w <> '')"


def trim(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{_WS}', ''), '{_WS}$', '')"


def first_words(t: str, n: int) -> str:
    return f"array_to_string({words(t)}[1:{n}], ' ')"


DOCS = "docs AS (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS text FROM documents)"
SPEAKER = r"^\s*(?:\d{1,2}:\d{2}(?::\d{2})?\s+)?([A-Za-z][A-Za-z\s]{0,30}):"


def fixed(size: int, step: int) -> str:
    return f"""{DOCS}, split AS (SELECT doc_id, {words("text")} AS w FROM docs),
    placed AS (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS s FROM split),
    fixed AS (SELECT doc_id, (s // {step})::BIGINT AS chunk_index, array_to_string(w[s + 1:s + {size}], ' ') AS text,
      len(w[s + 1:s + {size}])::BIGINT AS word_count, s::BIGINT AS start_word, (s + len(w[s + 1:s + {size}]))::BIGINT AS end_word FROM placed)"""


def pack(items: str, target: int) -> str:
    """``items(k, i, n)`` from i = 1 -> ``pack(k, i, c)`` with the group of each item."""
    cut = f"(p.total + t.n > {target} AND p.total > 0)"
    return f"""pack AS (SELECT k, i, 0::BIGINT AS c, n AS total FROM {items} WHERE i = 1
      UNION ALL SELECT p.k, t.i, CASE WHEN {cut} THEN p.c + 1 ELSE p.c END, CASE WHEN {cut} THEN t.n ELSE p.total + t.n END
      FROM pack p JOIN {items} t ON t.k = p.k AND t.i = p.i + 1)"""


SENTENCES = rf"""{DOCS}, lists AS (SELECT doc_id, list_filter(list_transform(string_split_regex(
      regexp_replace(text, '([.!?]+[)"]*)[ \t]+([^a-z \t\n])', '\1' || chr(1) || '\2', 'g'), '[' || chr(1) || chr(10) || ']'),
      lambda s: {trim("s")}), lambda s: s <> '') AS l FROM docs),
    items AS (SELECT doc_id AS k, i, l[i] AS s, len({words("l[i]")})::BIGINT AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lists)),"""


def sentence_chunks(target: int) -> str:
    return f"""{SENTENCES} {pack("items", target)},
    grouped AS (SELECT p.k AS doc_id, p.c AS chunk_index, string_agg(t.s, ' ' ORDER BY t.i) AS text, sum(t.n)::BIGINT AS word_count
      FROM pack p JOIN items t ON t.k = p.k AND t.i = p.i GROUP BY ALL),
    chunks AS (SELECT *, (sum(word_count) OVER (PARTITION BY doc_id ORDER BY chunk_index) - word_count)::BIGINT AS start_word FROM grouped)"""


TURNS = f"""said AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, upper(role[1]) || role[2:] AS speaker,
      lpad(turn::VARCHAR, 2, '0') || ':00' AS t, {trim("lpad(turn::VARCHAR, 2, '0') || ':00 ' || upper(role[1]) || role[2:] || ': ' || replace(text, chr(10), ' ')")} AS line FROM conversations),
    turns AS (SELECT *, len({words("line")})::BIGINT AS n FROM said)"""


def transcript(temporal: bool) -> str:
    by_time = "true" if temporal else "m.speakers < 2"
    return f"""WITH RECURSIVE {TURNS}, {pack("turns", 120)},
    modes AS (SELECT k, count(DISTINCT speaker) AS speakers FROM turns GROUP BY k),
    made AS (SELECT p.k, p.c, CASE WHEN {by_time} THEN string_agg(t.line, chr(10) || chr(10) ORDER BY t.i) ELSE string_agg(t.line, chr(10) ORDER BY t.i) END AS text, sum(t.n)::BIGINT AS word_count,
      CASE WHEN ({by_time}) AND any_value(m.speakers) < 2 THEN '' ELSE array_to_string(list_sort(list_distinct(list(t.speaker))), ',') END AS speakers,
      CASE WHEN {by_time} THEN 'temporal' ELSE 'speaker' END AS attribution_type, string_agg(t.t, ',' ORDER BY t.i) AS times
      FROM pack p JOIN turns t ON t.k = p.k AND t.i = p.i JOIN modes m ON m.k = p.k GROUP BY p.k, p.c, m.speakers)
    SELECT k AS conv_id, c AS chunk_index, text, word_count, (sum(word_count) OVER (PARTITION BY k ORDER BY c) - word_count)::BIGINT AS start_word, speakers, attribution_type, times FROM made"""


def overlapped(items: str, target: int, overlap: int) -> str:
    """``items(k, i, n)``: where a group from each item would end, then the groups that are really reached from the first."""
    return f"""sums AS (SELECT k, i, sum(n) OVER (PARTITION BY k ORDER BY i) AS c, n, count(*) OVER (PARTITION BY k) AS m FROM {items}),
    ends AS (SELECT a.k, a.i AS s, a.m, greatest(a.i, coalesce(b.i, 0)) AS e FROM (SELECT *, c - n + {target} AS most FROM sums) a ASOF LEFT JOIN sums b ON a.k = b.k AND a.most >= b.c),
    walk AS (SELECT k, s, e, m, 0::BIGINT AS c FROM ends WHERE s = 1
      UNION ALL SELECT w.k, x.s, x.e, x.m, w.c + 1 FROM walk w JOIN ends x ON x.k = w.k AND x.s = greatest(w.s + 1, w.e + 1 - least({overlap}, w.e - w.s)) WHERE w.e < w.m)"""


def section(s: str, i: str, n: str) -> str:
    return f"'--- Section ' || ({i})::VARCHAR || ' of ' || ({n})::VARCHAR || ' ---' || chr(10) || {s}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
