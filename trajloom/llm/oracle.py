"""DuckDB SQL of the training-data queries that SQL can express, written apart from them."""

from __future__ import annotations

import math

from trajloom.llm.licenses import PHRASES, TEMPLATES
from trajloom.llm.quality import COMMON_WORDS

_SPACE = r"\x20\x09-\x0D"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _size_of(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length(text) - length(regexp_replace(text, '{quoted}', '', 'g'))"


def _distance(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0.0 END"
    x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    both = part.format(x=x, y=y) + " + " + part.format(x=y, y=x)
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: {both})) / 2)) END"


def _quality() -> str:
    known = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    m = len(COMMON_WORDS["en"]) + 1
    words_of = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in COMMON_WORDS.items()) + f" ELSE {_list(COMMON_WORDS['en'])} END"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lower(lang) IN ({known}) THEN lower(lang) ELSE 'other' END AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^{_SPACE}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines, {words_of} AS listed,
  ({_size_of('[A-Z]')})::DOUBLE AS upper, ({_size_of('[0-9]')})::DOUBLE AS digit, ({_size_of("[.,;:!?'" + '"' + "()-]")})::DOUBLE AS punctuation, ({_size_of('[#*$%&|<>]')})::DOUBLE AS symbols, ({_size_of(f'[{_SPACE}]')})::DOUBLE AS space, (strlen(text) - length(text))::DOUBLE AS wide FROM d),
g AS (SELECT rid, unnest(range(len(words) - 4)) AS pos, words FROM w WHERE len(words) >= 5),
gh AS (SELECT rid, pos, array_to_string(words[pos + 1:pos + 5], ' ') AS gram FROM g),
gt AS (SELECT rid, pos FROM gh WINDOW x AS (PARTITION BY rid, gram) QUALIFY count(*) OVER x > 1),
gs AS (SELECT rid, least(5, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, 5)) AS covers FROM gt),
gr AS (SELECT rid, sum(covers)::BIGINT AS n_repeat_words FROM gs GROUP BY 1),
h AS (SELECT w.rid, doc_id, lang, len(words)::BIGINT AS n_words, (length(text) - space)::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  [greatest(0, length(text) - (upper + digit + punctuation + symbols + space + wide)), upper, digit, punctuation, symbols, space, wide] AS classes,
  list_concat(list_transform(listed, lambda x: len(list_filter(words, lambda y: y = x))::DOUBLE), [len(list_filter(words, lambda y: NOT list_contains(listed, y)))::DOUBLE]) AS common FROM w LEFT JOIN gr USING (rid)),
r AS (SELECT lang, [{", ".join(f"sum(classes[{k}])" for k in range(1, 8))}] AS ref_classes, [{", ".join(f"sum(common[{k}])" for k in range(1, m + 1))}] AS ref_common FROM h GROUP BY 1),
j AS (SELECT h.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_distance("classes", "ref_classes", 7)} AS js_classes, {_distance("common", "ref_common", m)} AS js_common, 1.2 / sqrt(greatest(n_words, 1)) AS chance FROM h JOIN r USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words >= 20 AND (coalesce(js_classes, 0) > 0.18 + chance / 2 OR coalesce(js_common, 0) > 0.2 + chance)) AS kept, round(js_classes, 6) AS js_classes, round(js_common, 6) AS js_common FROM j"""


def _licenses(threshold: float = 0.9) -> str:
    sets = [(k, label, sorted(set(x.split())), len(x.split())) for k, (label, x) in enumerate(TEMPLATES)]
    templates = ", ".join(f"({k}, '{label}', {len(ws)}, {math.ceil(threshold * len(ws) - 1e-9)}, {long})" for k, label, ws, long in sets)
    members = ", ".join(f"({k}, '{w}')" for k, _, ws, _ in sets for w in ws)
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{word}') AS words FROM d), p(phrase, label, n) AS (VALUES {phrases}), t(tid, label, n, need, long) AS (VALUES {templates}), m(tid, word) AS (VALUES {members}),
wp AS (SELECT rid, words, unnest(range(len(words))) AS i FROM w), pl AS (SELECT rid, i, label FROM wp JOIN p ON words[i + 1] = string_split(phrase, ' ')[1] AND array_to_string(words[i + 1:i + n], ' ') = phrase),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS base_list FROM pl GROUP BY 1),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM w), l1 AS (SELECT rid, no, regexp_extract_all(line, '{word}') AS ws FROM l0),
l2 AS (SELECT rid, no, ws, sum(len(ws)) OVER (PARTITION BY rid ORDER BY no) AS upto FROM l1 WHERE len(ws) > 0), v AS (SELECT rid, no, upto - len(ws) AS before, upto, unnest(list_distinct(ws)) AS word FROM l2),
o AS (SELECT rid, no, before, upto, tid, word FROM v JOIN m USING (word)), full_ AS (SELECT rid, tid FROM o JOIN t USING (tid) GROUP BY rid, tid, need HAVING count(DISTINCT word) >= need),
f AS (SELECT o.* FROM o SEMI JOIN full_ USING (rid, tid)), s AS (SELECT DISTINCT rid, tid, no, upto FROM f),
h AS (SELECT s.rid, s.tid, s.no, count(DISTINCT f.word) AS held FROM s JOIN t USING (tid) JOIN f ON f.rid = s.rid AND f.tid = s.tid AND f.no >= s.no AND (f.no = s.no OR f.before - s.upto < t.long) GROUP BY ALL),
g AS (SELECT rid, list_distinct(list(label)) AS more, max(held / n) AS best FROM h JOIN t USING (tid) WHERE held >= need GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_list), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(more, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score FROM w LEFT JOIN b USING (rid) LEFT JOIN g USING (rid)"""


_FINGERPRINTS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
x AS (SELECT doc_id, 'own' AS which, text AS t FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
p AS (SELECT doc_id, which, unnest(string_split(t, chr(10))) AS para, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM x),
l AS (SELECT doc_id, which, no, list_transform(regexp_extract_all(para, '[^.!?]{1,256}[.!?]{0,3}|[.!?]{1,256}'), lambda y: sha256('leaf' || y)) AS leaves FROM p),
g AS (SELECT *, sha256('paragraph' || array_to_string(leaves, '')) AS digest FROM l),
s0 AS (SELECT *, coalesce(sum((right(digest, 1) IN ('0', '8'))::INT) OVER (PARTITION BY doc_id, which ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM g),
s1 AS (SELECT doc_id, which, sid, sha256('section' || string_agg(digest, '' ORDER BY no)) AS section FROM s0 GROUP BY ALL),
s2 AS (SELECT doc_id, which, sha256('root' || string_agg(section, '' ORDER BY sid)) AS root, list(section ORDER BY sid) AS sections FROM s1 GROUP BY ALL),
g2 AS (SELECT doc_id, which, flatten(list(leaves ORDER BY no)) AS leaves, list(digest ORDER BY no) AS digests FROM g GROUP BY ALL),
f AS (SELECT doc_id, which, root, root || ':' || array_to_string(list_transform(leaves, lambda y: left(y, 16)), '') || ':' || array_to_string(list_transform(digests, lambda y: left(y, 16)), '') || ':' || array_to_string(list_transform(sections, lambda y: left(y, 16)), '') AS fingerprint,
  list_distinct(list_concat(leaves, digests, sections)) AS nodes FROM g2 JOIN s2 USING (doc_id, which)),
z AS (SELECT e.doc_id, e.next_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint, a.root AS ra, b.root AS rb, c.root AS rc, a.nodes AS na, b.nodes AS nb, c.nodes AS nc
  FROM e JOIN f a ON a.doc_id = e.doc_id AND a.which = 'own' JOIN f b ON b.doc_id = e.doc_id AND b.which = 'edited' JOIN f c ON c.doc_id = e.next_id AND c.which = 'own')
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, CASE WHEN ra = rb THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(na, nb)) / (len(na) + len(nb) + 2) END::DOUBLE AS near_edited, CASE WHEN ra = rc THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(na, nc)) / (len(na) + len(nc) + 2) END::DOUBLE AS near_next, next_id FROM z"""


_HARD_NEGATIVES = """WITH v AS (SELECT vec_id::BIGINT AS vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS alike, list_inner_product(a.q, v.q)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


_COLLOCATIONS = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
o AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(size)),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM g WHERE size > 1),
e AS (SELECT c.*, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score FROM c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, a, m, string_split(phrase, ' ') AS ws, unnest(range(1, size - m + 2)) AS i FROM g, (VALUES (2), (3)) v(m) WHERE m < size),
y AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM x GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b LEFT JOIN y USING (lang, phrase) JOIN t USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000"""


ORACLE_SQL = {"op10_quality_rules": _quality(), "op8_license_scan": _licenses(), "op7_fingerprints": _FINGERPRINTS, "op12_collocations": _COLLOCATIONS, "op13_hard_negatives": _HARD_NEGATIVES}
