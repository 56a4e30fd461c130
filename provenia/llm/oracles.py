"""What SQL can say of this subpackage's queries."""

from provenia.llm.substring_dedup import LEAST_WORDS

SPACE = r"[\x20\x09-\x0D]+"
NAMES = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = NAMES + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _hits(kind: int, pattern: str, group: int) -> str:
    """row, kind, start, stop, value of each match: the pieces between matches tell where they are."""
    return f"""SELECT row, doc_id, source, lang, {kind} AS kind, value, CAST(sum(gap + size) OVER (PARTITION BY row ORDER BY i) - size AS BIGINT) AS start, CAST(sum(gap + size) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS stop FROM
(SELECT row, doc_id, source, lang, i, length(g[i]) AS gap, length(m[i]) AS size, v[i] AS value FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM
(SELECT row, doc_id, source, lang, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v FROM d WHERE regexp_matches(text, '{pattern}'))))"""


EXACT = f"""WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {LETTERS}), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS s FROM w),
e AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s"""

CHAT = r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
c AS (SELECT *, contains(' ' || text, ' [/INST]') OR contains(' ' || text, ' </s>') OR contains(' ' || text, ' [/ROLE]') OR contains(text, '\\') OR contains(text, '\b') OR contains(text, '\l') OR contains(text, '\r') AS odd FROM t),
f AS (SELECT *, CASE WHEN odd THEN replace(replace(replace(replace(text, '\', '\\'), '[', '\b'), '<', '\l'), ']', '\r') ELSE text END AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars, count(*) FILTER (odd) AS escaped_turns, true AS identical FROM f GROUP BY conv_id"""

CUT = """string_split(regexp_replace(line, '([.!?])([\\x20\\x09-\\x0D])', '\\1' || chr(10) || '\\2', 'g'), chr(10))"""
SUBSTRING = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, {CUT} AS pieces FROM l),
p AS (SELECT doc_id, i, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j, len(pieces) AS n FROM c),
o AS (SELECT *, CAST(coalesce(sum(length(piece) + CAST(j = n AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, trim(translate(regexp_replace(piece, '{SPACE}', ' ', 'g'), {LETTERS})) AS unit_text FROM p),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS unit, CAST(len(string_split(unit_text, ' ')) AS INTEGER) AS n_words FROM o WHERE unit_text <> ''),
g AS (SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start, row_number() OVER w AS nth FROM u WINDOW w AS (PARTITION BY unit_text ORDER BY doc_id, unit)),
a AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM g WHERE nth > 1),
s AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS words FROM a)
SELECT doc_id, unit, start, start + length(piece) AS stop, n_words, kept_doc_id, kept_start, CAST(words AS BIGINT) AS run_words FROM s WHERE words >= """

WORD = r"[^\x20\x09-\x0D]+"
#: Clauses begin where a word's hash is the least among its neighbours; three in a row are compared.
CLAUSES = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT row, doc_id, regexp_extract_all(text, '{WORD}') AS w, string_split_regex(text, '{WORD}') AS g FROM t),
e AS (SELECT row, doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(g[1:len(w)]) AS gap FROM x),
o AS (SELECT row, doc_id, i, translate(word, {LETTERS}) AS word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS stop, length(word) AS size, CAST('0x' || substr(md5(translate(word, {LETTERS})), 1, 8) AS BIGINT) AS h FROM e),
k AS (SELECT *, stop - size AS start, CASE WHEN i = 1 OR h < coalesce(lag(h, 1) OVER q, h + 1) AND h < coalesce(lag(h, 2) OVER q, h + 1) AND h <= coalesce(lead(h, 1) OVER q, h) AND h <= coalesce(lead(h, 2) OVER q, h) THEN 1 ELSE 0 END AS cut FROM o WINDOW q AS (PARTITION BY row ORDER BY i)),
n AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY row ORDER BY i) - 1 AS INTEGER) AS unit FROM k),
c AS (SELECT row, doc_id, unit, min(start) AS start, max(stop) AS stop, CAST(count(*) AS INTEGER) AS n_words, string_agg(word, ' ' ORDER BY i) AS said FROM n GROUP BY row, doc_id, unit),
v AS (SELECT row, doc_id, unit, start, coalesce(lead(start) OVER q, stop) AS stop, n_words, count(*) OVER (PARTITION BY row) AS units, concat_ws(chr(10), said, lead(said, 1) OVER q, lead(said, 2) OVER q) AS said FROM c WINDOW q AS (PARTITION BY row ORDER BY unit)),
f AS (SELECT *, first_value(doc_id) OVER q AS kept_doc_id, first_value(start) OVER q AS kept_start, row_number() OVER q AS nth FROM v WHERE unit <= units - 3 OR unit = 0 WINDOW q AS (PARTITION BY said ORDER BY doc_id, unit)),
r AS (SELECT row, unit + unnest([0, 1, 2]) AS unit, unit AS found, kept_doc_id, kept_start FROM f WHERE nth > 1),
m AS (SELECT row, unit, arg_min(kept_doc_id, found) AS kept_doc_id, arg_min(kept_start, found) AS kept_start FROM r GROUP BY row, unit),
a AS (SELECT v.row, v.doc_id, v.unit, v.start, v.stop, v.n_words, kept_doc_id, kept_start, v.unit - row_number() OVER (PARTITION BY v.row ORDER BY v.unit) AS run FROM m JOIN v ON v.row = m.row AND v.unit = m.unit),
s AS (SELECT *, CAST(sum(n_words) OVER (PARTITION BY row, run) AS BIGINT) AS run_words FROM a)"""
REPEATED = CLAUSES + f" SELECT doc_id, unit, start, stop, n_words, kept_doc_id, kept_start, run_words FROM s WHERE run_words >= {LEAST_WORDS}"
# what lies between the removed clauses
CUT_TEXTS = (
    CLAUSES
    + f""", z AS (SELECT row, start, stop, coalesce(lag(stop) OVER (PARTITION BY row ORDER BY unit), 0) AS since FROM s WHERE run_words >= {LEAST_WORDS}),
y AS (SELECT t.row, count(z.start) AS n_removed, coalesce(string_agg(substr(t.text, since + 1, z.start - since), '' ORDER BY z.start), '') || substr(any_value(t.text), coalesce(max(z.stop), 0) + 1) AS text FROM t LEFT JOIN z ON z.row = t.row GROUP BY t.row)
SELECT t.doc_id, n_removed, sha256(y.text) AS text_sha256 FROM y JOIN t ON t.row = y.row"""
)

_KINDS = "['assign', 'access', 'hex', 'bare']"
SECRETS = (
    "WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, lang, coalesce(text, '') AS text FROM documents), h AS ("
    + " UNION ALL ".join([_hits(0, ASSIGN, 2), _hits(1, "AKIA[A-Z0-9]{16,}", 0), _hits(2, "[0-9a-f]{24,}", 0), _hits(3, "[A-Za-z0-9+/_=-]{16,}", 0)])
    + f"""), k AS (SELECT * FROM h WHERE (kind <> 0 OR length(value) >= 6) AND (kind <> 3 OR regexp_matches(value, '[0-9]'))),
free AS (SELECT * FROM k WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM k b WHERE b.row = k.row AND b.kind < 3 AND b.start < k.stop AND b.stop > k.start)),
own AS (SELECT value, count(DISTINCT (coalesce(source, ''), coalesce(lang, ''))) AS repos, count(DISTINCT coalesce(source, '')) AS owners, bool_or(kind < 3) AS named FROM free GROUP BY value),
c AS (SELECT free.*, named, CASE WHEN owners >= 3 THEN 'example' WHEN regexp_matches(lower(free.value), 'example|changeme|placeholder|dummy|sample|your[_-]') OR len(list_distinct(string_split(free.value, ''))) < 6 THEN 'placeholder' ELSE 'live' END AS class FROM free JOIN own USING (value)),
s AS (SELECT *, ({_KINDS})[kind + 1] || ':' || start || ':' || stop AS said FROM c WHERE kind < 3 OR class = 'live' AND (named OR length(value) >= 20 AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'example') AS n_example FROM d LEFT JOIN s ON s.row = d.row GROUP BY d.row, d.doc_id"""
)



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {step}), 4294967295)"


TRIE = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS k, length(text) AS n FROM t),
o AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS own FROM k GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(list_slice(b.own, 1, o.h), []), list_slice(o.own, o.h + 1, len(o.own))) AS turns FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
s AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
p AS (SELECT conv_id, depth, depth || '|' || array_to_string(list_transform(list_slice(turns, 1, depth), lambda x: x.k), ',') AS node, (depth - 1) || '|' || array_to_string(list_transform(list_slice(turns, 1, depth - 1), lambda x: x.k), ',') AS up, coalesce(turns[depth].n, 0) AS n, len(turns) = depth AS ends FROM s),
g AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n, min(up) AS up, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node, depth),
c AS (SELECT up AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY up),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (node)),
a AS (SELECT p.node, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum((f.n_convs - 1) * f.n) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, f.ends_sha256 FROM f JOIN a USING (node) LEFT JOIN f u ON u.node = f.up"""

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_words = lambda table, row: f"SELECT {row}, list_filter(string_split_regex(translate(coalesce(text, ''), {LETTERS}), '{NO_WORD}'), lambda x: x <> '') AS w FROM {table}"
IMPORTANCE = f"""WITH d AS ({_words("documents", "row_number() OVER () AS row, doc_id")}), e AS (SELECT row, unnest(w) AS f FROM d), b AS (SELECT unnest(w) AS f FROM ({_words("benchmark", "0 AS i")})),
v AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM e UNION SELECT f FROM b)),
s AS (SELECT bucket, count(*) AS s FROM e JOIN v USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (f) GROUP BY bucket),
n AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM e) AS all_s, (SELECT CAST(count(*) AS DOUBLE) FROM b) AS all_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket) CROSS JOIN n),
x AS (SELECT row, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM e JOIN v USING (f) JOIN g USING (bucket) GROUP BY row),
y AS (SELECT row, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (row)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM y),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM q"""

ORACLES = {"op2_jaccard": JACCARD, "op4_chat": CHAT, "op8_exact_dedup": EXACT, "op9_substring_dedup": REPEATED, "op9_cut_texts": CUT_TEXTS, "op9_repeated_units": f"{SUBSTRING}1", "op9_repeated_lines": f"{SUBSTRING}1".replace(CUT, "[line]"), "op10_secrets": SECRETS, "op11_prefix_trie": TRIE, "op12_importance": IMPORTANCE}
