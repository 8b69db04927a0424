"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: One row with t, the 256 remainders of a byte under the CRC-32 polynomial.
_CRC_TABLE = """crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), b)) AS t)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text expression, beside crc_table."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * CAST(i AS INTEGER) + 1, 2) AS BIGINT)"
    return (f"xor(4294967295, list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: {byte}), "
            "lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1]), 4294967295))")


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees over leaves (grp, pos, hash): grp, level, pos, hash and n, the nodes of the group's level."""
    return f"""{name} AS (
    SELECT grp, 0 AS level, pos, hash, count(*) OVER (PARTITION BY grp) AS n FROM {leaves}
    UNION ALL
    SELECT grp, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3
    FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 3, n)"""


MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
    SELECT doc_id, source, {_leaf('text')} AS leaf,
           CASE WHEN coalesce({_crc32('CAST(doc_id AS VARCHAR)')}, 0) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
                ELSE {_leaf('text')} END AS other
    FROM documents, crc_table),
docs AS (
    SELECT *, row_number() OVER () AS rid,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos FROM hashed),
leaves AS (SELECT source AS grp, pos, leaf AS hash FROM docs),
{_levels('lower_nodes', 'leaves')},
subroots AS (SELECT grp AS source, hash AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place
             FROM lower_nodes WHERE n = 1),
tops AS (SELECT 0 AS grp, place AS pos, subroot AS hash FROM subroots),
{_levels('upper_nodes', 'tops')},
root AS (SELECT hash AS root FROM upper_nodes WHERE n = 1),
runs AS (
    SELECT d.rid, m.level, m.pos, m.hash, d.pos // CAST(3 ** m.level AS BIGINT) AS own
    FROM docs d JOIN lower_nodes m ON m.grp IS NOT DISTINCT FROM d.source AND m.n > 1
        AND m.pos // 3 = d.pos // CAST(3 ** (m.level + 1) AS BIGINT)
    UNION ALL
    SELECT d.rid, 1000 + m.level, m.pos, m.hash, s.place // CAST(3 ** m.level AS BIGINT)
    FROM docs d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
    JOIN upper_nodes m ON m.n > 1 AND m.pos // 3 = s.place // CAST(3 ** (m.level + 1) AS BIGINT)),
steps AS (
    SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS k,
           coalesce(string_agg(hash, '' ORDER BY pos) FILTER (pos < own), '') AS before,
           coalesce(string_agg(hash, '' ORDER BY pos) FILTER (pos > own), '') AS after
    FROM runs GROUP BY rid, level),
folded AS (
    SELECT rid, CAST(0 AS BIGINT) AS k, other AS h FROM docs
    UNION ALL
    SELECT f.rid, s.k, sha256(s.before || f.h || s.after) FROM folded f JOIN steps s ON s.rid = f.rid AND s.k = f.k + 1),
ends AS (SELECT rid, arg_max(h, k) AS folded_root FROM folded GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY rid)
SELECT d.doc_id, d.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = r.root AS verified
FROM docs d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source JOIN ends e USING (rid) LEFT JOIN proofs p USING (rid), root r"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
hashed AS (SELECT run, {_crc32("(CAST(doc_id AS VARCHAR) || ':' || run)")} AS h FROM found, crc_table),
damaged AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (
    SELECT word, CAST(i AS INTEGER) AS i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
inserted AS (SELECT DISTINCT c.word AS x, w.word AS y FROM cuts c JOIN words w ON c.rest = w.word),
near AS (
    SELECT x, y FROM inserted UNION ALL SELECT y, x FROM inserted UNION ALL
    SELECT a.word, b.word FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (
    SELECT x, count(*) AS n_near, arg_min(y, (-n, y)) AS y, max(n) AS n FROM near JOIN words ON y = word GROUP BY x),
own AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.y END AS form,
           CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
    FROM words w LEFT JOIN best b ON b.x = w.word),
ways AS (
    SELECT word, word AS root, 0 AS k FROM own UNION ALL
    SELECT p.word, o.form, p.k + 1 FROM ways p JOIN own o ON o.word = p.root WHERE o.form IS NOT NULL)
SELECT o.word, o.form, r.root, o.n, o.n_near, o.form_n
FROM own o JOIN (SELECT word, arg_max(root, k) AS root FROM ways GROUP BY word) r USING (word)"""
