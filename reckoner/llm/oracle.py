"""SQL for the queries of this package that SQL can express, written for DuckDB over the same tables.

The statements state the result plainly (every template against every block, one ordering per source) and share only
constants with the operators.
"""

from __future__ import annotations

from reckoner.llm import licenses, lines, mixing, spots, vectors

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def _templates() -> str:
    rows = ", ".join(f"({i}, {text(t.label)}, {'true' if t.phrase else 'false'}, {texts(t.words)}, {texts(sorted(set(t.words)))})"
                     for i, t in enumerate((*licenses.PHRASES, *licenses.NOTICES)))
    return f"""SELECT *, phrase OR len(bag) < {licenses.LONG} AS in_row, ceil({licenses.THRESHOLD}::DOUBLE * len(bag) - 1e-9::DOUBLE)::INT AS need,
  ceil(len(seq) / {licenses.THRESHOLD}::DOUBLE - 1e-9::DOUBLE)::INT AS span FROM (VALUES {rows}) AS t(number, label, phrase, seq, bag)"""


LICENSES = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
t AS ({_templates()}),
starts AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
places AS (SELECT r, label, CASE WHEN phrase THEN i END AS i, 1.0::DOUBLE AS share FROM starts, t WHERE in_row AND w[i + 1] = seq[1] AND w[i + 1:i + len(seq)] = seq),
likely AS (SELECT r, w, label, bag, need, span FROM d, t WHERE NOT in_row AND len(list_intersect(bag, w)) >= need),
windows AS (SELECT r, label, len(list_intersect(bag, w[i + 1:i + span])) AS n, len(bag) AS m, need FROM (SELECT *, unnest(range(len(w))) AS i FROM likely)),
hits AS (SELECT r, label, i, share FROM places
         UNION ALL SELECT r, label, NULL, n::DOUBLE / m FROM windows WHERE n >= need),
found AS (SELECT r, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, max(share) AS score,
                 list_sort(list_distinct(list(label) FILTER (WHERE i IS NOT NULL))) AS base,
                 list_sort(list_distinct(list(label))) AS every
          FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(every, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)"""

MIX = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {mixing.MAX_REPEAT}.0::DOUBLE * sum(size) AS most,
             [{', '.join(f'{w}::DOUBLE' for w in mixing.WEIGHTS)}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1] AS w
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER up AS k, sum(source_size) OVER () - coalesce(sum(most) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due,
             sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM s WINDOW up AS (ORDER BY most / w, source)),
cut AS (SELECT k AS first, due, rest FROM o WHERE due * w / rest <= most ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR k < first THEN most ELSE cut.due * w / cut.rest END AS target FROM o LEFT JOIN cut ON true),
e AS (SELECT r, doc_id, d.source, size, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS f,
             ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', 'mix', doc_id)), 1, 13))::BIGINT::DOUBLE / {float(2**52)!r} AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, floor(f)::BIGINT AS whole, CASE WHEN f > floor(f) THEN u / (1 - u) / ((f - floor(f)) / (1 - (f - floor(f)))) END AS q FROM e),
summed AS (SELECT *, coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q, doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(whole * size) OVER (PARTITION BY source) AS sure FROM ranked)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN q IS NOT NULL AND size > 0 AND before + size / 2 <= target - sure THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed"""

WORD = "'[^\\x20\\x09-\\x0D]+'"
LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, source IS NULL AS none, coalesce(text, '') AS x, text IS NULL AS empty,
                  regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
grams AS (SELECT r, i, w[i + 1:i + 3] AS g FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM d)),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams), (SELECT unnest([0, 1, 2]) AS k)
             WHERE c > 1 GROUP BY r),
cut AS (SELECT r, host, none, x, line, len(regexp_extract_all(line, {WORD})) AS n,
               trim(translate(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '{UPPER}123456789', '{UPPER.lower()}000000000'), ' ') AS norm
        FROM (SELECT r, host, none, x, unnest(string_split(x, chr(10))) AS line FROM d)),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM cut WHERE n > 0 GROUP BY r),
common AS (SELECT host, none, norm FROM cut WHERE n > 0 GROUP BY host, none, norm
           HAVING count(DISTINCT x) > {lines.LINE_DOCS}
              AND count(DISTINCT x) > {lines.LINE_SHARE}::DOUBLE * (SELECT count(DISTINCT (y.x, y.empty)) FROM d y WHERE y.host = cut.host AND y.none = cut.none)),
removed AS (SELECT r, sum(n) AS n FROM cut JOIN common USING (host, none, norm) WHERE cut.n > 0 GROUP BY r),
c AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
             coalesce(repeated.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS removed_words
      FROM d LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.MAX_REPEATED} * n_words) AS base_failed, removed_words::BIGINT AS removed_words,
       NOT (n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.MAX_REPEATED} * n_words)
         AND n_words - removed_words >= {lines.DEPLETED}::DOUBLE * n_words AS kept
FROM c"""

#: CRC-32 of a column of digits, bit by bit (the polynomial is a fixed value of the checksum).
CRC = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), "
       "lambda s, c: list_reduce(list_concat([xor(s, c)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)")
FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT *, sha256(head || {FIELD.format('text')}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {CRC.format('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS later
  FROM (SELECT doc_id, source, text, concat({', '.join(FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))}) AS head FROM documents)),
leaves AS (
  SELECT doc_id, source, leaf, sha256(head || {FIELD.format('later')}) AS tampered,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM d),
nodes(level, tree, pos, n, digest) AS (
  SELECT 0, tree, pos, n, leaf FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 16, n),
tops(level, pos, n, digest) AS (
  SELECT 0, tree, (SELECT count(DISTINCT tree) FROM leaves), digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n),
up AS (  -- (leaf, level from 0 on through both trees): the siblings to the left and to the right
  SELECT l.tree, l.pos, s.level, string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < l.pos // (16 ** s.level)::BIGINT) AS lefts,
         string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > l.pos // (16 ** s.level)::BIGINT) AS rights
  FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.n > 1 AND s.pos // 16 = l.pos // (16 ** (s.level + 1))::BIGINT GROUP BY l.tree, l.pos, s.level
  UNION ALL
  SELECT l.tree, l.pos, 100 + s.level, string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < l.tree // (16 ** s.level)::BIGINT),
         string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > l.tree // (16 ** s.level)::BIGINT)
  FROM leaves l JOIN tops s ON s.n > 1 AND s.pos // 16 = l.tree // (16 ** (s.level + 1))::BIGINT GROUP BY l.tree, l.pos, s.level),
paths AS (
  SELECT tree, pos, list(coalesce(lefts, '') ORDER BY level) AS lefts, list(coalesce(rights, '') ORDER BY level) AS rights,
         string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY level) AS every FROM up GROUP BY tree, pos),
folded(tree, pos, step, digest) AS (
  SELECT tree, pos, 0, tampered FROM leaves
  UNION ALL
  SELECT tree, pos, step + 1, sha256(lefts[step + 1] || digest || rights[step + 1]) FROM folded JOIN paths USING (tree, pos) WHERE step < len(lefts)),
ends AS (SELECT tree, pos, arg_max(digest, step) AS digest FROM folded GROUP BY tree, pos)
SELECT doc_id, leaf, (SELECT digest FROM nodes r WHERE r.n = 1 AND r.tree = l.tree) AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
       sha256(coalesce(every, '')) AS proof_sha256, e.digest AS folded_root, e.digest = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN ends e USING (tree, pos) LEFT JOIN paths USING (tree, pos)"""

HARD = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
      FROM e a JOIN e b ON a.r != b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b)::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""

def _likeness(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


_SPOTS_WORD = "regexp_extract_all(translate({0}, '" + UPPER + "', '" + UPPER.lower() + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_MD5 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
SPOTS = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, doc_id, lang, coalesce(text, '') AS x FROM documents),
langs AS (SELECT lang FROM d GROUP BY lang HAVING count(*) * {spots.LANGUAGES} >= (SELECT count(*) FROM d)),
used AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_distinct({_SPOTS_WORD.format('x')})) AS w FROM d) GROUP BY lang, w),
anchors AS (SELECT DISTINCT w FROM (SELECT lang, w FROM used u WHERE EXISTS (SELECT 1 FROM langs l WHERE l.lang IS NOT DISTINCT FROM u.lang)
                                    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {spots.ANCHORS})),
e AS (SELECT d.*, y.x AS y, d.x[:length(d.x) - length(d.x) // 3] || y.x[:length(d.x) // 3] AS z
      FROM d JOIN d y ON y.r = d.r % (SELECT count(*) FROM d) + 1),
every AS (SELECT DISTINCT t FROM (SELECT x AS t FROM e UNION ALL SELECT z FROM e)),
parted AS (SELECT t, i, w, w IN (SELECT w FROM anchors) AS a FROM (SELECT t, unnest(u) AS w, generate_subscripts(u, 1) AS i FROM (SELECT t, {_SPOTS_WORD.format('t')} AS u FROM every))),
content AS (SELECT t, i, w, row_number() OVER (PARTITION BY t ORDER BY i) AS c FROM parted WHERE NOT a),
spots AS (SELECT t, w, c FROM (
            SELECT t, w, a, coalesce(count(*) FILTER (WHERE NOT a) OVER (PARTITION BY t ORDER BY i), 0) AS c FROM parted) WHERE a),
chains AS (SELECT DISTINCT s.t, (({_MD5.format('s.w')})::HUGEINT * {spots.MIX[0]} + ({_MD5.format('p.w')})::HUGEINT * {spots.MIX[1]}
                                 + ({_MD5.format('q.w')})::HUGEINT * {spots.MIX[2]}) % 18446744073709551616 // 4294967296 AS sig
           FROM spots s JOIN content p ON p.t = s.t AND p.c = s.c + 1 JOIN content q ON q.t = s.t AND q.c = s.c + 2),
prints AS (SELECT t, coalesce(list(sig ORDER BY sig) FILTER (WHERE sig IS NOT NULL), [({_MD5.format('t')})::HUGEINT]) AS sigs FROM every LEFT JOIN chains USING (t) GROUP BY t),
texts AS (SELECT t, sigs, base64(unhex(array_to_string(list_transform(sigs, lambda s: printf('%08x', s::BIGINT)), ''))) AS print FROM prints)
SELECT doc_id, length(x)::BIGINT AS n_chars, sha256(z) AS edited_sha256, own.print AS fingerprint, ed.print AS edited_fingerprint,
       {_likeness('own.sigs', 'ed.sigs')} AS near_edited, {_likeness('own.sigs', 'nx.sigs')} AS near_next,
       {_likeness('own.sigs', 'ed.sigs')} >= {spots.THRESHOLD}::DOUBLE AS similar_edited, {_likeness('own.sigs', 'nx.sigs')} >= {spots.THRESHOLD}::DOUBLE AS similar_next
FROM e JOIN texts own ON own.t = e.x JOIN texts ed ON ed.t = e.z JOIN texts nx ON nx.t = e.y"""

VECTORS = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM e
      WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= {vectors.COSINE}::DOUBLE),
reached(r, o) AS (SELECT r, r FROM n UNION SELECT reached.r, links.b FROM reached JOIN links ON reached.o = links.a),
least AS (SELECT reached.r, min(n.vec_id) AS component_id FROM reached JOIN n ON n.r = reached.o GROUP BY reached.r),
counted AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM e LEFT JOIN least USING (r) LEFT JOIN counted USING (r)"""

SQL: dict[str, str] = {"op6_embedding_near_dedup": VECTORS, "op12_fingerprints": SPOTS, "op11_hard_negatives": HARD, "op13_merkle_manifest": MERKLE, "op2_license_scan": LICENSES, "op3_source_mix": MIX, "op8_quality_rules": LINES}
