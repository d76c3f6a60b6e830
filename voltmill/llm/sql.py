"""DuckDB SQL of the queries that SQL can express."""

import math

from . import langid, license_scan, line_dedup, phrases, repeats, resample, secrets

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT two.b, reach.c FROM reach JOIN two ON two.a = reach.a),
comp AS (SELECT a AS doc_id, min(c) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

def _places(name: str, pattern: str) -> str:
    """Rows (doc_id, hit, start) of a pattern's matches; the text between matches gives the places."""
    return f"""{name} AS (
  SELECT r, hit, CAST(sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS BIGINT) AS start
  FROM (SELECT r, unnest(regexp_extract_all(t, '{pattern}')) AS hit, unnest(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS gap,
               unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS k FROM d WHERE regexp_matches(t, '{pattern}'))
  WINDOW w AS (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING))"""


_ASSIGN = secrets.ASSIGN.replace("'", "''")
_PLAIN = {c: p.replace("*+", "*").replace("++", "+").replace("}+", "}") for c, p in (("ruler", secrets.RULER), ("uuid", secrets.UUID), ("joined", secrets.JOINED))}
_N_LOG = [round(n * math.log2(n) * secrets.SCALE) if n else 0 for n in range(secrets.WINDOW + 1)]
_MOST = "CASE " + " ".join(f"WHEN regexp_matches(hit, '{p}') THEN {int((math.log2(secrets.WINDOW) - bits + 1e-9) * secrets.WINDOW * secrets.SCALE)}" for p, bits in secrets.CLASSES) + " END"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_places("assign", _ASSIGN)},
{_places("access", secrets.ACCESS + "+")},
{_places("hex", secrets.HEX + "+")},
{_places("candidate", secrets.CANDIDATE)},
shape AS (
  SELECT *, length(regexp_replace(hit, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(hit, '[^AEIOUYaeiouy]', '', 'g')) AS vowels,
         len(regexp_extract_all(hit, '{secrets.CASED}')) AS words FROM candidate
),
suspect AS (
  SELECT r, hit, start, {_MOST} AS most FROM shape
  WHERE NOT regexp_matches(hit, '{_PLAIN["ruler"]}') AND NOT regexp_matches(hit, '{_PLAIN["uuid"]}')
    AND NOT (regexp_matches(hit, '{_PLAIN["joined"]}') AND letters >= 3 * words AND vowels >= {secrets.VOWELS[0]}::DOUBLE * letters AND vowels <= {secrets.VOWELS[1]}::DOUBLE * letters
             AND NOT regexp_matches(hit, '[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{{{secrets.CONSONANTS}}}'))
),
windows AS (SELECT r, start, most, hit, unnest(range(1, length(hit) - {secrets.WINDOW} + 2)) AS i FROM suspect),
counted AS (
  SELECT r, start, most, i, c, count(*) AS n FROM (SELECT r, start, most, i, unnest(string_split(substring(hit, i, {secrets.WINDOW}), '')) AS c FROM windows) GROUP BY ALL
),
high AS (SELECT r, start, i FROM counted GROUP BY r, start, most, i HAVING sum(({_N_LOG})[n + 1]) <= most),
span AS (
  SELECT r, start, 0 AS kind, start + length(hit) AS e FROM assign WHERE length(regexp_extract(hit, '{_ASSIGN}', 1)) >= {secrets.LEAST["assign"]}
  UNION ALL SELECT r, start, 1, start + length(hit) FROM access WHERE length(hit) >= {secrets.LEAST["access"]}
  UNION ALL SELECT r, start, 2, start + length(hit) FROM hex WHERE length(hit) >= {secrets.LEAST["hex"]}
  UNION ALL SELECT r, start + min(i) - 1, 3, start + max(i) - 1 + {secrets.WINDOW} FROM high GROUP BY r, start
),
said AS (SELECT *, ({list(secrets.KINDS)!r})[kind + 1] || ':' || start || ':' || e AS s FROM span),
own AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM said GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN own USING (r)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM pat),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k)
),
occ AS (SELECT doc_id, win.k, i, item_id FROM win JOIN pat ON win.p = pat.p AND win.k = pat.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license_scan.PHRASES.items())
_TEMPLATES = ", ".join(f"({k}, '{label}', {must.split()!r}, {text.split()!r})" for k, (label, must, text) in enumerate(license_scan.TEMPLATES))

OP9 = f"""
WITH d AS (SELECT doc_id, text, {ALNUM} AS w FROM documents),
phrases(p, label) AS (VALUES {_PHRASES}),
place AS (
  SELECT doc_id, i - 1 AS word, label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN phrases ON w[i] = p[1]
  WHERE w[i:i + len(p) - 1] = p
),
base AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
template(k, label, must, words) AS (VALUES {_TEMPLATES}),
need AS (
  SELECT k, label, must, len(words) AS length, list_distinct(words) AS toks, len(list_distinct(words)) AS m,
         ceil({license_scan.THRESHOLD} * len(list_distinct(words)) - 1e-9) AS least FROM template
),
tok AS (SELECT k, unnest(toks) AS t FROM need),
word AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS t FROM d),
hit AS (SELECT doc_id, n, i, k, t FROM word JOIN tok USING (t)),
near AS (SELECT doc_id, k FROM hit JOIN need USING (k) GROUP BY doc_id, k HAVING count(DISTINCT t) >= any_value(least)),
inside AS (
  SELECT doc_id, k, t, least(length, n) AS size, unnest(range(greatest(0, i - least(length, n) + 1), least(i, n - least(length, n)) + 1)) AS s
  FROM hit JOIN near USING (doc_id, k) JOIN need USING (k)
),
over AS (SELECT doc_id, k, size, s, list(DISTINCT t) AS held FROM inside GROUP BY ALL),
met AS (
  SELECT doc_id, label, s, s + size AS e, len(held) / m AS c FROM over JOIN need USING (k) WHERE len(held) >= least AND list_has_all(held, must)
),
block AS (
  SELECT doc_id, label, c FROM met b
  WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.doc_id = b.doc_id AND o.s < b.e AND b.s < o.e AND o.c > b.c)
),
best AS (SELECT doc_id, max(c) AS c FROM block GROUP BY doc_id),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT doc_id, label FROM block UNION ALL SELECT doc_id, label FROM place) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN lab USING (doc_id)
"""

#: crc32 of an id's text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""

# Valid where no language has more than MAX_DOCS_PER_LANG documents, so all of them teach.
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, lang, {_CRC} % 4 = 2 AS held_out FROM documents),
chars AS (SELECT r, string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM d),
gram AS (
  SELECT r, c[i] AS g FROM (SELECT r, c, unnest(range(1, len(c) + 1)) AS i FROM chars WHERE len(c) > 2) WHERE c[i] <> ' '
  UNION ALL SELECT r, c[i] || c[i + 1] FROM (SELECT r, c, unnest(range(1, len(c))) AS i FROM chars WHERE len(c) > 2)
  UNION ALL SELECT r, c[i] || c[i + 1] || c[i + 2] FROM (SELECT r, c, unnest(range(1, len(c) - 1)) AS i FROM chars WHERE len(c) > 2) WHERE c[i + 1] <> ' '
),
own AS (SELECT r, g, count(*) AS n FROM gram GROUP BY r, g),
ranked AS (
  SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(g), g) - 1 AS k FROM own QUALIFY k < {langid.PROFILE}
),
learned AS (SELECT lang, g, sum(n) AS n FROM own JOIN d USING (r) WHERE NOT held_out AND text IS NOT NULL AND lang IS NOT NULL GROUP BY lang, g),
profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS p FROM learned QUALIFY p < {langid.PROFILE}
),
sizes AS (SELECT r, count(*) AS m FROM ranked GROUP BY r),
near AS (SELECT r, lang, sum({langid.PROFILE} - least(abs(p - k), {langid.PROFILE})) AS won FROM ranked JOIN profile USING (g) GROUP BY r, lang),
far AS (
  SELECT r, lang, m, m * {langid.PROFILE} - coalesce(won, 0) AS away
  FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM profile) LEFT JOIN near USING (r, lang)
),
best AS (SELECT r, lang, m, away FROM far QUALIFY row_number() OVER (PARTITION BY r ORDER BY away, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, '{langid.UNKNOWN}') AS lang_pred, coalesce(1 - CAST(away AS DOUBLE) / CAST({langid.PROFILE} * m AS DOUBLE), 0.0::DOUBLE) AS score
FROM d LEFT JOIN best USING (r)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, source, unnest(l) AS s, unnest(range(len(l))) AS k, len(l) AS n FROM d),
wide AS (SELECT trim(s) AS t FROM line WHERE trim(s) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
marked AS (SELECT doc_id, s, k, n, trim(s) IN (SELECT t FROM wide) AS gone FROM line),
kept AS (
  SELECT doc_id, max(n) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(s, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256
FROM kept
"""

OP11 = rf"""
WITH d AS (SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang, unnest(string_split_regex({FOLD}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k) GROUP BY ALL
),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {phrases.LEAST}),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
),
least AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM least c WHERE NOT EXISTS (
    SELECT 1 FROM cand o WHERE o.k = 3 AND o.lang = c.lang AND c.phrase IN (array_to_string(o.w[1:2], ' '), array_to_string(o.w[2:3], ' ')) AND 100 * o.a >= {phrases.SUBSUMED} * c.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= {phrases.TOP}
"""

#: What the remainder of crc32 becomes by four bits.
_NIBBLES = []
for _x in range(16):
    for _ in range(4):
        _x = _x >> 1 ^ (3988292384 if _x & 1 else 0)
    _NIBBLES.append(_x)
_CRC_OF_WORD = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(hex(encode(t)))), lambda i: instr('0123456789ABCDEF', substr(hex(encode(t)), i + 2 - 2 * (i % 2), 1))::BIGINT - 1)),
  lambda c, x: xor(c >> 4, ({_NIBBLES})[(xor(c, x) & 15) + 1])))"""

OP12 = rf"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT {ALNUM} AS w FROM benchmark),
dw AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
bw AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM b) GROUP BY t),
bucket AS (SELECT t, {_CRC_OF_WORD} % {resample.BUCKETS} AS k FROM (SELECT t FROM dw UNION SELECT t FROM bw)),
held AS (SELECT k, sum(n) AS s FROM dw JOIN bucket USING (t) GROUP BY k),
wanted AS (SELECT k, sum(n) AS s FROM bw JOIN bucket USING (t) GROUP BY k),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw)::DOUBLE + {resample.BUCKETS} AS s, (SELECT coalesce(sum(n), 0) FROM bw)::DOUBLE + {resample.BUCKETS} AS t),
gain AS (
  SELECT k, floor(1000 * ln((coalesce(wanted.s, 0) + 1)::DOUBLE * sums.s / ((held.s + 1)::DOUBLE * sums.t)))::BIGINT AS g FROM held LEFT JOIN wanted USING (k) CROSS JOIN sums
),
weight AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM dw JOIN bucket USING (t) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)
),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {resample.LEAST_WORDS}
  QUALIFY rank <= (SELECT {resample.PERCENT} * count(*) // 100 FROM scored WHERE n_features >= {resample.LEAST_WORDS})
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""

OP13 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
window_ AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * repeats.LENGTH})) AS m FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {repeats.LENGTH - 1})) AS s FROM d WHERE length(h) >= {2 * repeats.LENGTH})),
again AS (SELECT doc_id, s FROM window_ QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, s) > 1),
edge AS (SELECT *, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) + {repeats.LENGTH} AS begins FROM again),
run AS (SELECT doc_id, s, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edge),
span AS (SELECT doc_id, min(s) AS s, max(s) + {repeats.LENGTH} AS e FROM run GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, coalesce(lag(e) OVER w, 0) AS a, s AS b FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, max(e), NULL FROM span GROUP BY doc_id
),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (coalesce(b, length(h) // 2) - a))::BIGINT), '' ORDER BY a, b NULLS LAST) AS rest FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - s) AS n, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1, "op2_secret_scan": OP2, "op6_benchmark_decontamination": OP6, "op8_language_id": OP8, "op9_license_scan": OP9, "op10_line_dedup": OP10,
    "op11_phrase_collocations": OP11, "op12_importance_resampling": OP12, "op13_suffix_array_dedup": OP13,
}
