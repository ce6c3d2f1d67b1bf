"""DuckDB SQL for the queries that SQL can express on whole tables: op3, op4, op7 and op10.

The others hang on hashes that DuckDB lacks (op5, op9), on sums whose last digits depend on
the order (op1), or on trained models and media coding (op2, op6, op8).
"""

from __future__ import annotations

from . import chat_format, decontaminate, secret_scan


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_text, sorted(words))) + ")"


def chat() -> str:
    """Turns are put together and hashed as they stand in the table; only the formatted length goes by the escapes."""
    escaped = lambda c: f"regexp_replace({c}, {_text(chat_format.ESCAPE)}, {_text(chr(92).join(['', '1', '', '', '2', '3']))}, 'g')"
    opened = " ".join(f"WHEN {_text(r)} THEN {len(f'<s>[{m}]  [/{m}]</s>')}" for r, m in chat_format.ROLES.items())
    hard = _text("</s>[INST] ok [/INST]")
    return f"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', {hard} UNION ALL SELECT -1, 1, 'assistant', {hard}
), turns AS (
    SELECT *, {escaped("text")} AS body,
        CASE role {opened} ELSE length('<s>[ROLE][/ROLE]</s>') + length({escaped("role")}) END AS marks FROM given
), chats AS (
    SELECT conv_id, count(*) AS n_turns, sum(length(body) + marks)::BIGINT AS formatted_chars,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '') AS loss
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM chats"""


def repeats(least: int = 100) -> str:
    """Every string of so many bytes, by its place; a window over the starts of later ones covers bytes."""
    return f"""
WITH given AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), places AS (
    SELECT doc_id, digits, unnest(range(0, length(digits) // 2)) AS pos FROM given
), strings AS (
    SELECT doc_id, pos, substr(digits, 2 * pos + 1, 2) AS byte,
        CASE WHEN 2 * pos + {2 * least} <= length(digits) THEN md5_number(substr(digits, 2 * pos + 1, {2 * least})) END AS string FROM places
), ranked AS (
    SELECT *, string IS NOT NULL AND row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) > 1 AS later FROM strings
), covered AS (
    SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {least - 1} PRECEDING AND CURRENT ROW) AS gone FROM ranked
), runs AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM covered
), found AS (
    SELECT doc_id, count_if(gone) AS n_removed, count_if(opens) AS n_spans,
        sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (NOT gone), ''))) AS kept_sha256 FROM runs GROUP BY doc_id
)
SELECT doc_id, length(digits) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM given LEFT JOIN found USING (doc_id)"""


def secrets() -> str:
    """Matches and the text between them give places; windows of candidates are listed one by one."""
    token, width = secret_scan.ALPHABET, secret_scan.WINDOW
    run = "[A-Za-z0-9+/_=-]+"
    assert all(c in token for c in "Az09+/_=-")
    kinds = [(secret_scan.ASSIGN, 2, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32), (run, 0, width)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, regexp_extract_all(text, {_text(p)}) AS m, regexp_extract_all(text, {_text(p)}, {g}) AS v, string_split_regex(text, {_text(p)}) AS b, {least} AS least FROM given"
        for k, (p, g, least) in enumerate(kinds)
    )
    allowed = " OR ".join(f"regexp_matches(s, {_text(p)})" for p in secret_scan.ALLOWED)
    t = secret_scan.THRESHOLDS
    names = "[" + ", ".join(map(_text, secret_scan.KINDS)) + "]"
    return f"""
WITH given AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS (
    {found}
), listed AS (
    SELECT doc_id, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS s, unnest(v) AS v, unnest(b[1:len(m)]) AS before FROM found
), placed AS (
    SELECT *, (sum(length(before) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(s))::BIGINT AS start FROM listed
), spans AS (
    SELECT doc_id, kind, s, start, start + length(s) AS stop FROM placed WHERE length(v) >= least
), candidates AS (
    SELECT DISTINCT s FROM spans WHERE kind = 3 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT ({allowed})
), windows AS (
    SELECT s, unnest(range(1, length(s) - {width} + 2)) AS w FROM candidates
), entropies AS (
    SELECT s, log2({width}) - list_sum(list_transform(map_values(list_histogram(string_split(substr(s, w, {width}), ''))), lambda c: c * log2(c))) / {width} AS bits FROM windows
), secretive AS (
    SELECT s FROM entropies GROUP BY s
    HAVING max(bits) >= CASE WHEN regexp_matches(s, '^[0-9a-fA-F]+$') THEN {t["hex"]} WHEN regexp_matches(s, '^[A-Z0-9]+$') THEN {t["upper"]} ELSE {t["mixed"]} END
), base AS (
    SELECT * FROM spans WHERE kind < 3
), kept AS (
    SELECT doc_id, kind, start, stop FROM base UNION ALL
    SELECT doc_id, kind, start, stop FROM spans AS x WHERE kind = 3 AND s IN (SELECT s FROM secretive)
        AND NOT EXISTS (SELECT 1 FROM base AS y WHERE y.doc_id = x.doc_id AND y.start <= x.start AND y.stop >= x.stop)
), spelled AS (
    SELECT doc_id, count_if(kind = 0) AS a, count_if(kind = 1) AS c, count_if(kind = 2) AS h,
        string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
        string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
    FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM given LEFT JOIN spelled USING (doc_id)"""


def templates() -> str:
    """Windows are joined as strings of canonical words, without hashes or the bitmap."""
    d = decontaminate
    return f"""
WITH texts AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), rowed AS (
    SELECT row_number() OVER () AS r, side, id, coalesce(text, '') AS text FROM texts
), tokens AS (
    SELECT r, side, id, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS tok, generate_subscripts(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), 1) AS i FROM rowed
), words AS (
    SELECT r, side, id, i, trim(tok, {_text(d._EDGE)}) AS w, lower(trim(tok, {_text(d._EDGE)})) AS low FROM tokens
), kinds AS (
    SELECT *, CASE
        WHEN regexp_full_match(w, {_text(d._NUMBER.pattern)}) OR low IN {_list(d.NUMBER_WORDS)} THEN 'n'
        WHEN regexp_full_match(w, {_text(d._JOINED.pattern)}) AND lower(regexp_extract(w, {_text(d._JOINED.pattern)}, 2)) IN {_list(d.UNITS)} THEN 'j'
        WHEN low IN {_list(d.UNITS)} THEN 'u' WHEN regexp_matches(w, '^\\p{{Lu}}') THEN 'p' ELSE '' END AS kind
    FROM words WHERE w <> ''
), forms AS (
    SELECT r, side, id, form, i, CASE WHEN kind = '' THEN '' ELSE kind || low END AS slot, (kind = '' OR form = 1 AND kind = 'p')::INT AS literal,
        CASE kind WHEN 'n' THEN '<num>' WHEN 'j' THEN '<num><unit>' WHEN 'u' THEN '<unit>' WHEN 'p' THEN CASE form WHEN 0 THEN '<name>' ELSE low END ELSE low END AS word
    FROM kinds, (VALUES (0), (1)) AS f(form)
), lists AS (
    SELECT r, side, id, form, list(word ORDER BY i) AS words, list(slot ORDER BY i) AS slots, list(literal ORDER BY i) AS literals FROM forms GROUP BY ALL
), sized AS (
    SELECT *, least({d.WINDOW}, len(words)) AS size FROM lists WHERE side = 'b'
    UNION ALL SELECT * FROM lists, (SELECT DISTINCT least({d.WINDOW}, len(words)) AS size FROM lists WHERE side = 'b') WHERE side = 'd'
), places AS (
    SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM sized
), windows AS (
    SELECT side, id, form, p, array_to_string(words[p : p + size - 1], ' ') AS string, slots[p : p + size - 1] AS slots
    FROM places WHERE list_sum(literals[p : p + size - 1]) >= {d.LITERAL}
), theirs AS (
    SELECT DISTINCT id AS item_id, form, p, string, slots FROM windows WHERE side = 'b'
), met AS (
    SELECT o.id AS doc_id, t.item_id, t.p, unnest(t.slots) AS a, unnest(o.slots) AS b
    FROM (SELECT * FROM windows WHERE side = 'd') AS o JOIN theirs AS t ON o.form = t.form AND o.string = t.string
), spread AS (
    SELECT doc_id, item_id, count(DISTINCT p) AS n_windows FROM met GROUP BY ALL
), votes AS (
    SELECT doc_id, item_id, a, b, count(*) AS n FROM met WHERE a <> '' GROUP BY ALL
), by_value AS (
    SELECT doc_id, item_id, a, sum(n) AS n, max(n) AS best, coalesce(sum(n) FILTER (a <> b), 0) AS changed FROM votes GROUP BY ALL
), by_seen AS (
    SELECT doc_id, item_id, b, max(n) AS best FROM votes GROUP BY ALL
), back AS (
    SELECT doc_id, item_id, sum(best)::BIGINT AS best FROM by_seen GROUP BY ALL
), forward AS (
    SELECT doc_id, item_id, sum(n)::BIGINT AS n, sum(best)::BIGINT AS best, sum(changed) AS changed FROM by_value GROUP BY ALL
), agreed AS (
    SELECT doc_id, item_id, n, least(forward.best, back.best) AS best, changed FROM forward JOIN back USING (doc_id, item_id)
), lengths AS (
    SELECT item_id, count(DISTINCT p) AS item_windows FROM theirs GROUP BY ALL
), pairs AS (
    SELECT doc_id, item_id, n_windows, item_windows, n_windows / item_windows AS coverage, coalesce(best / n, 1.0::DOUBLE) AS consistency, coalesce(changed, 0) = 0 AS verbatim
    FROM spread JOIN lengths USING (item_id) LEFT JOIN agreed USING (doc_id, item_id)
)
SELECT * FROM pairs WHERE n_windows >= least({d.ENOUGH}, item_windows) AND consistency >= {d.CONSISTENT}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": chat(),
        "op4_suffix_array_dedup": repeats(),
        "op7_secret_scans": secrets(),
        "op10_benchmark_decontamination": templates(),
    }
