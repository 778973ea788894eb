"""DuckDB SQL for the rows of the queries that SQL can express.

The others need hashes, tokenizers or fitted models that SQL has not; tests hold them against brute force.
"""

from paperloom.llm import embedding_dedup as E
from paperloom.llm import license_scan as S
from paperloom.llm import quality_rules as Q
from paperloom.llm import url_filter as U


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license() -> str:
    gram = lambda words: "[" + ", ".join(map(_quoted, words)) + "]"
    rows = [f"({n}, {str(base).lower()}, {_quoted(label)}, {size}, {slack}, {k}, {t}, {gram(words)})" for n, base, label, size, slack, k, t, words in S.template_rows()]
    word = S.WORD.replace("\\x00", "\\x{00}").replace("\\x2F", "\\x{2F}").replace("\\x3A", "\\x{3A}").replace("\\x60", "\\x{60}").replace("\\x7B", "\\x{7B}").replace("\\x7F", "\\x{7F}")
    key = "r, template, span"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH templates(template, base, label, t_words, slack, k, t_pos, g) AS (VALUES {", ".join(rows)}),
    split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
    grams AS (SELECT r, {S.SHORT_GRAM} AS k, w[p:p + {S.SHORT_GRAM - 1}] AS g, p - 1 AS pos FROM (SELECT r, w, unnest(range(1, len(w) - {S.SHORT_GRAM - 2})) AS p FROM split)
      UNION ALL SELECT r, {S.LONG_GRAM}, w[p:p + {S.LONG_GRAM - 1}], p - 1 FROM (SELECT r, w, unnest(range(1, len(w) - {S.LONG_GRAM - 2})) AS p FROM split)),
    lines AS (SELECT r, template, base, label, t_words, slack, k, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS found
      FROM grams JOIN templates USING (k, g) GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS starts FROM lines),
    placed AS (SELECT *, sum(starts) OVER (PARTITION BY r, template ORDER BY diagonal) AS span, len(found) = t_words - k + 1 AS whole FROM marked),
    spans AS (SELECT {key}, any_value(base) AS base, any_value(label) AS label, any_value(t_words) AS t_words, any_value(slack) AS slack, first(diagonal ORDER BY len(found) DESC, diagonal) AS main,
      sum(whole::INT) AS n_whole, min(CASE WHEN whole THEN diagonal END) AS first_whole, max(CASE WHEN whole THEN diagonal END) AS last_whole FROM placed GROUP BY {key}),
    starts_at AS (SELECT {key}, diagonal, k, unnest(found) AS f FROM placed WHERE NOT base),
    covered AS (SELECT DISTINCT {key}, diagonal, t FROM (SELECT {key}, diagonal, unnest(range(f, f + k)) AS t FROM starts_at)),
    chosen AS (SELECT {key}, t, first(diagonal ORDER BY abs(diagonal - main), diagonal) + t AS p FROM covered JOIN spans USING ({key}) GROUP BY {key}, t),
    ordered AS (SELECT *, p > coalesce(max(p) OVER (PARTITION BY {key} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p - 1) AS later FROM chosen),
    verified AS (SELECT {key}, count(*) AS n, max(p) - min(p) + 1 AS extent FROM ordered WHERE later GROUP BY {key}),
    judged AS (SELECT *, base AND n_whole > 0 AS is_base, CASE WHEN base THEN n_whole > 0 ELSE n / t_words >= CASE WHEN t_words < {S.LONG} THEN {S.SHORT_COVER} ELSE {S.COVER} END AND extent <= t_words + slack END AS sure,
      (CASE WHEN base THEN 1.0::DOUBLE ELSE n / t_words END) * (1 - 0.5::DOUBLE / t_words) AS weight FROM spans LEFT JOIN verified USING ({key}))
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(sum(CASE WHEN is_base THEN n_whole END), 0)::BIGINT AS n_base,
      min(CASE WHEN is_base THEN first_whole END)::BIGINT AS first_word, max(CASE WHEN is_base THEN last_whole END)::BIGINT AS last_word,
      coalesce(string_agg(DISTINCT CASE WHEN is_base THEN label END, ',' ORDER BY CASE WHEN is_base THEN label END), '') AS base_labels,
      coalesce(string_agg(DISTINCT CASE WHEN sure THEN label END, ',' ORDER BY CASE WHEN sure THEN label END), '') AS labels,
      round(coalesce(max(CASE WHEN sure THEN weight END), 0), 6)::DOUBLE AS score
    FROM split LEFT JOIN judged USING (r) GROUP BY r, doc_id, len(w)"""


def _quality() -> str:
    word = r"[^\x{20}\x{09}-\x{0D}]+"
    n = Q.WINDOW
    return f"""WITH split AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    windows AS (SELECT r, p, list_slice(w, p, p + {n - 1}) AS v FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS p FROM split)),
    again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, v) AS c FROM windows) WHERE c > 1),
    repeats AS (SELECT r, count(DISTINCT p + d)::BIGINT AS n_repeat_words FROM again, range({n}) AS k(d) GROUP BY r),
    measured AS (SELECT r, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')))))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words FROM split LEFT JOIN repeats USING (r)),
    judged AS (SELECT *, n_words < {Q.LEAST_WORDS} OR 100 * n_repeat_words > {Q.MOST_REPEATED} * n_words AS base_failed FROM measured),
    stricter AS (SELECT *, base_failed OR 200 * n_repeat_words > {Q.MOST_REPEATED} * n_words OR 5 * n_symbols > word_chars OR 10 * n_dup_lines > n_words AS strict_failed FROM judged),
    hosts AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS failed FROM stricter GROUP BY host),
    moments AS (SELECT sum(failed) / sum(n) AS mean, coalesce(var_samp(failed / n), 0) AS spread, avg(1 / n) AS share FROM hosts),
    prior AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * share > 0 THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * share) - 1, 2), 1000) ELSE 20 END AS weight FROM moments),
    rates AS (SELECT host, round((failed + weight * mean) / (n + weight), 9) AS host_rate, mean FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT (host_rate >= {Q.HOST_RATE} AND host_rate >= {Q.HOST_TIMES} * mean AND strict_failed) AS kept, host_rate FROM stricter JOIN rates USING (host)"""


def _url() -> str:
    rules = sorted(U.RULES, key=lambda r: (-len(r[1]), r))
    fits = lambda p: f"(host = {_quoted(p.split('/')[0])} OR ends_with(host, {_quoted('.' + p.split('/')[0])})) AND starts_with(path, {_quoted('/' + p.split('/', 1)[1])})"
    rule = "CASE " + " ".join(f"WHEN {fits(p)} THEN {_quoted(p)}" for _, p in rules) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(p)} THEN {_quoted(k)}" for k, p in rules) + " END"
    z = "abs(labelled_bad / labelled - (all_blocked - labelled_bad) / (all_labelled - labelled)) / sqrt(all_blocked / all_labelled * (1 - all_blocked / all_labelled) * (1 / labelled + 1 / (all_labelled - labelled)))"
    levels = []
    for k in range(U.DEPTH):
        # the last level takes all that is left of a path
        segment = "parts[1]" if k < U.DEPTH - 1 else "array_to_string(parts, '/')"
        levels.append(f"""c{k} AS (SELECT host, t, {segment} AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM l{k} WHERE len(parts) > 0 GROUP BY ALL),
    p{k} AS (SELECT host, t, count(*) AS kids, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(blocked) AS all_blocked FROM c{k} GROUP BY ALL),
    n{k} AS (SELECT c.*, CASE WHEN kids > {U.FAN_OUT} AND n * {U.FAN_OUT} <= all_n THEN '{U.WILDCARD}' ELSE '=' || segment END AS name FROM c{k} c JOIN p{k} USING (host, t)),
    b{k} AS (SELECT host, t, name, sum(labelled) AS labelled, sum(blocked) AS labelled_bad FROM n{k} GROUP BY ALL),
    d{k} AS (SELECT host, t, name, CASE WHEN labelled > 0 AND all_labelled > labelled AND all_blocked > 0 AND all_blocked < all_labelled AND {z} > {U.DIFFERENT_Z} THEN name ELSE '{U.MERGED}' END AS branch FROM b{k} JOIN p{k} USING (host, t)),
    w{k} AS (SELECT host, t, segment, branch FROM n{k} JOIN d{k} USING (host, t, name)),
    l{k + 1} AS (SELECT l.host, flat, CASE WHEN len(parts) > 0 THEN {"parts[2:]" if k < U.DEPTH - 1 else "[]"} ELSE parts END AS parts, CASE WHEN len(parts) > 0 THEN l.t || '/' || branch ELSE l.t END AS t, n, labelled, blocked
      FROM l{k} l LEFT JOIN w{k} w ON w.host = l.host AND w.t = l.t AND w.segment = CASE WHEN len(parts) > 0 THEN {segment} END)""")
    return rf"""WITH urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    named AS (SELECT *, {rule} AS rule, {ruled} AS ruled, regexp_replace(array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/'), '\.[A-Za-z]{{1,5}}\z', '') AS flat FROM urls),
    l0 AS (SELECT host, flat, CASE WHEN flat = '' THEN []::VARCHAR[] ELSE string_split(flat, '/') END AS parts, '' AS t, count(*) AS n, count(ruled) AS labelled, coalesce(sum((ruled = 'block')::INT), 0) AS blocked FROM named GROUP BY ALL),
    prior AS (SELECT coalesce(least(sum(blocked) / nullif(sum(labelled), 0), {U.MOST_PRIOR}), 0) AS p FROM l0),
    {", ".join(levels)},
    pure AS (SELECT host, flat, CASE WHEN t = '' THEN '/' ELSE t END AS template, round((sum(blocked) OVER w + {U.PRIOR_WEIGHT} * p) / (sum(labelled) OVER w + {U.PRIOR_WEIGHT}), 9)::DOUBLE AS purity FROM l{U.DEPTH}, prior WINDOW w AS (PARTITION BY host, t))
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {U.BLOCK_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM named JOIN pure USING (host, flat)"""


def _embeddings() -> str:
    """All pairs of a label, and what is reachable by links; the exact result that the index comes near to."""
    return f"""WITH RECURSIVE every AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
    fine AS (SELECT * FROM every WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.r AS u, b.r AS v FROM fine a JOIN fine b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {E.COSINE}),
    reach AS (SELECT u, v FROM links UNION SELECT l.u, x.v FROM links l JOIN reach x ON l.v = x.u),
    least AS (SELECT u, min(vec_id) AS m FROM reach JOIN every ON r = v GROUP BY u),
    counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, m) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, m) AS kept
    FROM every LEFT JOIN least ON least.u = r LEFT JOIN counts ON counts.u = r"""


def _chat() -> str:
    """The digests of each conversation's turns in order; a mark adds a letter wherever the text has one to escape."""
    marks = lambda c: f"(length({c}) + length(regexp_replace({c}, '[^<>\\\\]', '', 'g')))"
    own = _quoted(r"\### Assistant: </turn> ok")
    said = "string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant')"
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', {own} UNION ALL SELECT -7, 1, 'assistant', {own})
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce({said}, '')) AS loss_sha256,
      sum({len('<turn ></turn>')} + {marks('role')} + {marks('text')})::BIGINT AS formatted_chars FROM turns GROUP BY conv_id"""


ORACLES: dict[str, str] = {"op1_license_scan": _license(), "op2_quality_rules": _quality(), "op5_embedding_dedup": _embeddings(), "op8_chat_format": _chat(), "op10_url_filter": _url()}
