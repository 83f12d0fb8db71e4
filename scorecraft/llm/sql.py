"""DuckDB SQL of the corpus queries that SQL can express: the same rows from the same tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Scores of all documents that share a term with an item, as the contract states them.
LEXICAL_SEARCH = f"""
WITH doc_term AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
     doc AS (SELECT doc_id, count(*) AS n FROM doc_term GROUP BY doc_id),
     total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
     asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
     held AS (SELECT doc_id, t, count(*) AS tf FROM doc_term WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
     weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
                 FROM (SELECT t, count(*) AS df FROM held GROUP BY t), total),
     impact AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS i
                FROM held JOIN weights USING (t) JOIN doc USING (doc_id), total),
     scored AS (SELECT item_id, doc_id, sum(times * i)::BIGINT AS score FROM asked JOIN impact USING (t) GROUP BY ALL HAVING sum(times * i) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 20
"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name} END"


def _climb(name: str, base: str) -> str:
    """All nodes above ``base`` (k, pos, h, n): n nodes in a level, one less level by level."""
    return f"""{name} AS (
  SELECT k, 0 AS lvl, pos, h, n FROM {base}
  UNION ALL
  SELECT k, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY k, lvl, pos // 8, n)"""


def _beside(name: str) -> str:
    """What stands before and after a node in its run."""
    run = "PARTITION BY k, lvl, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"""SELECT k, lvl, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
       coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name} WHERE n > 1"""


def _walk(name: str, base: str, beside: str) -> str:
    """From ``base`` (doc_id, k, pos, proof, h) up over the siblings."""
    return f"""{name} AS (
  SELECT doc_id, k, 0 AS lvl, pos, proof, h, leaf FROM {base}
  UNION ALL
  SELECT w.doc_id, w.k, w.lvl + 1, w.pos // 8, w.proof || s.a || s.b, sha256(s.a || w.h || s.b), w.leaf
  FROM {name} w JOIN {beside} s ON s.k = w.k AND s.lvl = w.lvl AND s.pos = w.pos)"""


_CRC_STEP = "list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),"
        " lambda x, y: xor(x >> 8, crc[((xor(x, y) & 255) + 1)::INTEGER])), 4294967295)")
_ROW = " || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "n_chars"))

MERKLE_MANIFEST = f"""
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, {_CRC_STEP} AS c FROM (SELECT unnest(range(256)) AS i))),
leaves AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n, h, changed
  FROM (SELECT doc_id, coalesce('1' || lang, '0') AS k, sha256({_ROW} || ({_field("text")})) AS h,
               CASE WHEN {_CRC} % 3 = 0 THEN sha256({_ROW} || ({_field(_LOWER.format("text"))})) END AS changed
        FROM documents, tab)),
{_climb("low", "leaves")},
subroots AS (SELECT '' AS k, k AS g, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, h FROM low WHERE n = 1),
{_climb("high", "subroots")},
low_beside AS ({_beside("low")}),
high_beside AS ({_beside("high")}),
start AS (SELECT doc_id, k, pos, '' AS proof, coalesce(changed, h) AS h, h AS leaf FROM leaves),
{_walk("low_walk", "start", "low_beside")},
low_end AS (SELECT * FROM low_walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
passed AS (SELECT e.doc_id, '' AS k, s.pos, e.proof, e.h, e.leaf FROM low_end e JOIN subroots s ON s.g = e.k),
{_walk("high_walk", "passed", "high_beside")},
ended AS (SELECT * FROM high_walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT e.doc_id, e.leaf, s.h AS subroot, t.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.root AS verified
FROM ended e JOIN leaves l ON l.doc_id = e.doc_id JOIN subroots s ON s.g = l.k, top t
"""

ORACLE_SQL = {"op11_lexical_search": LEXICAL_SEARCH, "op13_merkle_manifest": MERKLE_MANIFEST}
