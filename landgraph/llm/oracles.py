"""SQL of the spelling variants and of the Merkle manifest, both of which need a CRC-32."""

from __future__ import annotations

# the table of the CRC-32 polynomial, as a list
_CRC = """
bit AS (SELECT b, 0 AS i, b AS c FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bit WHERE i = 8)"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8, where crc's list `t` is at hand."""
    codes = f"list_transform(range(0, strlen({text}), 1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8)), 4294967295)"


SPELLING = rf"""
WITH RECURSIVE {_CRC.strip()},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 5 GROUP BY doc_id, w),
keyed AS (SELECT w, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k FROM each),
hashed AS (SELECT w, n, {_crc('k')} AS h FROM keyed, crc),
said AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, CAST(unnest(range(length(word) + 1)) AS INT) AS i FROM v),
less AS (SELECT word, n, i, CASE WHEN i = length(word) THEN word ELSE substr(word, 1, i) || substr(word, i + 2) END AS rest, i = length(word) AS own FROM cut),
pair AS (SELECT DISTINCT x.word AS a, x.n AS an, y.word AS b, y.n AS bn FROM less x JOIN less y ON x.rest = y.rest
  WHERE x.word <> y.word AND (x.own OR y.own OR x.i = y.i) AND NOT (x.own AND y.own)),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS best, max(bn) AS best_n, first(an) AS n FROM pair GROUP BY a),
f AS (SELECT word, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM near),
way AS (SELECT word, 0 AS step, word AS spot FROM v UNION ALL SELECT way.word, step + 1, form FROM way JOIN f ON way.spot = f.word WHERE form IS NOT NULL),
root AS (SELECT word, arg_max(spot, step) AS root FROM way GROUP BY word)
SELECT v.word, form, root, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n FROM v JOIN root USING (word) LEFT JOIN f USING (word)"""

_FIELD = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


# all levels of trees whose leaves are rows (tree, k, d); n counts the nodes of the level
_UP = """SELECT tree, 0 AS level, k, d, n FROM {0}
  UNION ALL SELECT tree, level + 1, k // 3, sha256(string_agg(d, '' ORDER BY k)), (n + 2) // 3 FROM {1} WHERE n > 1 GROUP BY tree, level, k // 3, n"""

MERKLE = f"""
WITH RECURSIVE {_CRC.strip()},
src AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
  CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents, crc),
doc AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n, leaf AS d FROM src),
up AS ({_UP.format('doc', 'up')}),
sub AS (SELECT '' AS forest, tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM up WHERE n = 1),
top AS ({_UP.format('(SELECT forest AS tree, k, d, n FROM sub)', 'top')}),
height AS (SELECT tree, max(level) AS h FROM up GROUP BY tree),
step AS (SELECT r, a.level AS step, string_agg(a.d, '' ORDER BY a.k) FILTER (WHERE a.k < doc.k // CAST(3 ** a.level AS BIGINT)) AS l,
    string_agg(a.d, '' ORDER BY a.k) FILTER (WHERE a.k > doc.k // CAST(3 ** a.level AS BIGINT)) AS g
  FROM doc JOIN up a ON a.tree = doc.tree AND a.n > 1 AND a.k // 3 = doc.k // CAST(3 ** (a.level + 1) AS BIGINT) GROUP BY r, a.level
  UNION ALL SELECT r, h + a.level, string_agg(a.d, '' ORDER BY a.k) FILTER (WHERE a.k < sub.k // CAST(3 ** a.level AS BIGINT)),
    string_agg(a.d, '' ORDER BY a.k) FILTER (WHERE a.k > sub.k // CAST(3 ** a.level AS BIGINT))
  FROM doc JOIN sub ON sub.name = doc.tree JOIN height ON height.tree = doc.tree
    JOIN top a ON a.n > 1 AND a.k // 3 = sub.k // CAST(3 ** (a.level + 1) AS BIGINT) GROUP BY r, h, a.level),
proof AS (SELECT r, sha256(string_agg(coalesce(l, '') || coalesce(g, ''), '' ORDER BY step)) AS proof_sha256 FROM step GROUP BY r),
fold AS (SELECT r, 0 AS step, coalesce(tampered, leaf) AS d FROM doc
  UNION ALL SELECT fold.r, fold.step + 1, sha256(coalesce(l, '') || d || coalesce(g, '')) FROM fold JOIN step ON step.r = fold.r AND step.step = fold.step),
folded AS (SELECT r, arg_max(d, step) AS folded_root FROM fold GROUP BY r),
root AS (SELECT d AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, sub.d AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM doc JOIN sub ON sub.name = doc.tree CROSS JOIN root JOIN folded USING (r) LEFT JOIN proof USING (r)"""
