"""DuckDB SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from reelspark.llm.licenses import RULES as LICENSE_RULES
from reelspark.llm.licenses import SENTENCES, pattern_of


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
c AS (SELECT payload_digest, payload_bytes, max(page_id) AS chief FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN chief <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN chief <> d.page_id THEN chief END AS refers_to
FROM d LEFT JOIN c USING (payload_digest, payload_bytes)
"""

OP3 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
x AS (SELECT doc_id, host, text, y, len(regexp_extract_all(y, '[^\x20\x09-\x0D]+')) AS n,
  trim(regexp_replace(regexp_replace(translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, host, text, unnest(l) AS y FROM w)),
h AS (SELECT host, count(DISTINCT text) AS texts FROM t GROUP BY host),
f AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS found FROM x GROUP BY host, line) JOIN h USING (host) WHERE found > 20 AND found > texts * 0.02),
q AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS lost FROM x SEMI JOIN f USING (host, line) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS n_frequent_words
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_frequent_words >= 0.2 * n_words AS kept
FROM b
"""

OP7 = r"""
WITH a AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM a WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT k FROM n),
p AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, s WHERE len(w) >= k)),
m AS (SELECT doc_id, i, p.k, item_id FROM p JOIN n ON n.g = p.g AND n.k = p.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN u USING (doc_id)
"""

OP8 = r"""
WITH RECURSIVE p AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)(?:licensed|released|distributed|available)[\x20\x09-\x0D]+under|spdx-license-identifier') AS speaks,
  regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09\x0B-\x0D]*\n') AS p FROM documents),
q AS (SELECT doc_id, generate_subscripts(p, 1) AS j, unnest(p) AS p FROM p),
c AS (SELECT doc_id, j, 1 AS side, regexp_split_to_array(p, '[.!?;]+[\x20\x09-\x0D]+|[.!?;]+$') AS s FROM q
  UNION ALL SELECT doc_id, j, 2 AS side, regexp_split_to_array(p, '[.!?;]+[\x20\x09-\x0D]+|\n|[.!?;]+$') AS s FROM q WHERE contains(p, chr(10))),
u AS (SELECT doc_id, j, side, generate_subscripts(s, 1) AS i,
  trim(regexp_replace(translate(unnest(s), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM c),
s AS (SELECT doc_id, j, sentence, min((side, i)) AS pos FROM u WHERE sentence <> '' GROUP BY doc_id, j, sentence),
k(sentence, sid) AS (VALUES {known}),
f AS (SELECT doc_id, list(sid ORDER BY j, pos) AS ids FROM s JOIN k USING (sentence) GROUP BY doc_id),
r(n, name, pattern, taken) AS (VALUES {rules}),
g AS (SELECT doc_id, sid, min((j, pos)) AS pos FROM s JOIN k USING (sentence) GROUP BY doc_id, sid),
t(doc_id, n, rest, names) AS (
  SELECT doc_id, 0, list(sid ORDER BY pos), CAST([] AS VARCHAR[]) FROM g GROUP BY doc_id
  UNION ALL
  SELECT doc_id, r.n, CASE WHEN regexp_matches(' ' || array_to_string(rest, ' ') || ' ', pattern) THEN list_filter(rest, lambda x: NOT list_contains(string_split(taken, ' '), x)) ELSE rest END,
    CASE WHEN regexp_matches(' ' || array_to_string(rest, ' ') || ' ', pattern) THEN list_append(names, name) ELSE names END
  FROM t JOIN r ON r.n = t.n + 1),
e AS (SELECT doc_id, names FROM t WHERE n = (SELECT max(n) FROM r)),
l AS (SELECT doc_id, count(*) AS n_sentences FROM s GROUP BY doc_id)
SELECT p.doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(n_sentences, 0) AS n_sentences,
  CASE WHEN speaks AND len(coalesce(names, [])) = 0 THEN 'LicenseRef-unknown' ELSE coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') END AS licenses,
  CAST(len(coalesce(names, [])) AS BIGINT) AS n_rules
FROM p LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN e USING (doc_id)
""".format(known=_values(SENTENCES.items()), rules=_values((n, name, pattern_of(wanted), " ".join(wanted + more)) for n, (name, wanted, more) in enumerate(LICENSE_RULES, 1)))

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM t),
f AS (SELECT doc_id, text, u, len(u) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS low, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS high FROM u),
p AS (SELECT *, array_to_string(u[1 : low], '') AS pre, array_to_string(u[low + 1 : high], '') AS mid, array_to_string(u[high + 1 : n], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL),
g AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2, "op3_quality": OP3, "op7_decontamination": OP7, "op8_licenses": OP8, "op12_fill_in_middle": OP12, "op13_lexical_search": OP13}
