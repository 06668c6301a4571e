"""DuckDB statements equal to the registered queries, where SQL can express them.

Token ids (op4, op7, op8), span offsets (op6), nearest-neighbour scores (op9),
template trees (op10), eigenvectors (op12) and page parsing (op13) have none; tests hold those against plain versions.
"""

from __future__ import annotations

from blotter.llm.license_scan import COPYRIGHT_LINE, EQUIVALENT, TEXTS
from blotter.llm.quality_rules import HOST_LIMIT, LEAST_WORDS, MOST_REPEATED

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_id AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id) AS component_id,
       coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id l ON l.doc_id = d.doc_id
"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""

QUALITY = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, sum(base_failed::INT)::DOUBLE AS failed FROM f GROUP BY source),
p AS (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v FROM h),
q AS (SELECT m, CASE WHEN v = 0 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / v - 1)) END AS k FROM p),
r AS (SELECT source, (failed + m * k) / (docs + k) > {HOST_LIMIT} AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"regexp_replace(' ' || regexp_replace({out}, '[^a-z0-9]+', ' ', 'g') || ' ', ' +', ' ', 'g')"
    for left, right in EQUIVALENT:
        out = f"replace({out}, {_quoted(' ' + left)}, {_quoted(' ' + right)})"
    return f"trim({out})"


LICENSES = f"""
WITH known AS (SELECT sha256({_canonical('text')}) AS digest, min(license) AS license
               FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in TEXTS)}) v(license, text) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS c
      FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM l) JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, sha256({_canonical('d.text')}) AS text_digest, known.license, coalesce(n.notices, '') AS notices,
       coalesce(n.c, 0)::BIGINT AS n_notices
FROM d LEFT JOIN known ON known.digest = sha256({_canonical('d.text')}) LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: crc32 of a decimal string, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)))"""

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(sha256(length(role)::VARCHAR || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS ds,
             list(strlen(text) ORDER BY turn NULLS FIRST, role, text) AS bs FROM t GROUP BY conv_id),
h AS (SELECT *, {_CRC} % 9 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ds, [])[:h.h], h.ds[h.h + 1:]) AS ds, list_concat(coalesce(b.bs, [])[:h.h], h.bs[h.h + 1:]) AS bs
      FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, array_to_string(ds[:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(ds[:d - 1], ',') END AS up,
             d = len(ds) AS ends, coalesce(bs[d], 0) AS bytes
      FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS d FROM r)),
n AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS first, count(*) AS n, any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS hashed FROM p GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT p.k, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.bytes) AS saved
          FROM n JOIN p ON p.conv_id = n.first AND p.d <= n.d LEFT JOIN kids ON kids.k = n.k GROUP BY p.k)
SELECT n.first AS conv_id, n.d AS depth, u.first AS parent_conv_id, n.n AS n_convs, coalesce(kids.kids, 0)::BIGINT AS n_children,
       below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, n.hashed AS ends_sha256
FROM n LEFT JOIN n u ON u.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN below ON below.k = n.k
"""

ORACLE = {"op1_minhash_near_dedup": NEAR_DUP, "op2_license_scan": LICENSES, "op3_quality_rules": QUALITY, "op5_exact_dedup": EXACT_DEDUP,
          "op11_prefix_trie": PREFIX_TRIE}
ORACLE = {k: v.strip() for k, v in ORACLE.items()}
