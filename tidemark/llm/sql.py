"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from tidemark.llm.license_templates import Word, as_regex, parse

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS words FROM p),
f AS (SELECT words, min(doc_id) AS least FROM s GROUP BY words),
c AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS i FROM s JOIN f USING (words) WHERE doc_id > least)),
a AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM a ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

CONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[pos:pos + least(len(w), 10) - 1], ' ') AS words
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS pos FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS words
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, pos, n FROM dw JOIN bw USING (n, words)),
h AS (SELECT doc_id, count(DISTINCT i)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS i FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
bs AS MATERIALIZED (SELECT DISTINCT words, word FROM (SELECT DISTINCT words, unnest(string_split(words, ' ')) AS word FROM bw)),
bn AS (SELECT words, count(*) AS n FROM bs GROUP BY words),
o AS MATERIALIZED (SELECT doc_id, words, word, pos FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) JOIN bs USING (word)),
c AS MATERIALIZED (SELECT doc_id, words, n FROM (SELECT doc_id, words, count(DISTINCT word) AS n_found FROM o GROUP BY ALL) JOIN bn USING (words) WHERE n_found = n),
r AS MATERIALIZED (SELECT doc_id, words, word, pos, n FROM o JOIN c USING (doc_id, words)),
q AS (SELECT DISTINCT x.doc_id, x.words FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.words = y.words AND y.pos >= x.pos AND y.pos < x.pos + 20 GROUP BY x.doc_id, x.words, x.pos, x.n HAVING count(DISTINCT y.word) = x.n),
z AS (SELECT doc_id, count(DISTINCT coalesce(item_id::VARCHAR, chr(0)))::BIGINT AS n_near_items FROM q JOIN bw USING (words) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN z USING (doc_id)
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31)::INT), 1)" for g in range(8) for shift in (15, 10, 5, 0))

ARCHIVED = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS least FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM p JOIN f USING (html)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def licenses(base: dict[str, str], templates: list[tuple[str, str]]) -> str:
    """The templates as regular expressions over the words."""
    places = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r})) - 1 AS pos, '{label}' AS label, {len(p.split())} AS m FROM d" for p, label in base.items())
    accepted = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {sum(isinstance(x, Word) for x in parse(t))} AS m FROM d WHERE regexp_matches(s, '{as_regex(t)}')" for label, t in templates)
    return f"""
WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS ({places}),
t AS ({accepted}),
bb AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(m) AS m FROM (SELECT doc_id, label, m FROM b UNION ALL SELECT doc_id, label, m FROM t) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(1 - pow(2, -m / 2.0), 0)::DOUBLE AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN al USING (doc_id)
"""

NEAR_COPIES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[pos:pos + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM t a JOIN t b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.reach = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.reach) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""

_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


MANIFEST = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS checked FROM documents),
t AS (SELECT 0 AS level, g, i, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM d
      UNION ALL SELECT level + 1, g, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY level, g, i // 3),
s AS MATERIALIZED (SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, subroot AS digest, count(*) OVER () AS n FROM s
      UNION ALL SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3),
r AS MATERIALIZED (SELECT level, g, i // 3 AS run, list(digest ORDER BY i) AS kids FROM t WHERE n > 1 GROUP BY level, g, i // 3),
q AS MATERIALIZED (SELECT level, i // 3 AS run, list(digest ORDER BY i) AS kids FROM u WHERE n > 1 GROUP BY level, i // 3),
f AS (SELECT 0 AS level, doc_id, g, i, checked AS node, '' AS siblings FROM d
      UNION ALL SELECT f.level + 1, doc_id, f.g, i // 3, sha256(array_to_string(kids[:i % 3], '') || node || array_to_string(kids[i % 3 + 2:], '')),
                       siblings || array_to_string(kids[:i % 3], '') || array_to_string(kids[i % 3 + 2:], '') FROM f JOIN r ON r.level = f.level AND r.g = f.g AND r.run = i // 3),
a AS MATERIALIZED (SELECT doc_id, g, max_by(node, level) AS node, max_by(siblings, level) AS siblings FROM f GROUP BY ALL),
h AS (SELECT 0 AS level, doc_id, s.i, node, siblings FROM a JOIN s USING (g)
      UNION ALL SELECT h.level + 1, doc_id, i // 3, sha256(array_to_string(kids[:i % 3], '') || node || array_to_string(kids[i % 3 + 2:], '')),
                       siblings || array_to_string(kids[:i % 3], '') || array_to_string(kids[i % 3 + 2:], '') FROM h JOIN q ON q.level = h.level AND q.run = i // 3),
z AS (SELECT doc_id, max_by(node, level) AS folded_root, sha256(max_by(siblings, level)) AS proof_sha256 FROM h GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN s USING (g) JOIN z USING (doc_id), (SELECT digest AS root FROM u WHERE n = 1)
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_terms FROM d),
f AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY r, term),
g AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, n_docs),
q AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark)) GROUP BY item, term),
s AS (SELECT item, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN g USING (term) JOIN f USING (term), c GROUP BY item, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10
"""
