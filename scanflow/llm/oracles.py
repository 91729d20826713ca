"""SQL twins of the corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

#: A-Z in lower case, nothing else.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"


def _shingles(source: str, key: str, size: int) -> str:
    """Distinct (key, s) rows: s joins ``size`` words, or all words of a shorter text."""
    words = _WORDS.format(_LOWER.format("coalesce(text, '')"))
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END) AS s
      FROM (SELECT {key}, {words} AS w FROM {source})"""


SUFFIX_DEDUP = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  l AS (SELECT doc_id, list_transform(range(0, len(h) // 2 - 99), lambda p: md5(substr(h, 2 * p + 1, 200))) AS l FROM t
    WHERE len(h) >= 200),
  w AS (SELECT doc_id, unnest(range(0, len(l))) AS p, unnest(l) AS s FROM l),
  g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
  e AS (SELECT doc_id, p AS lo, p + 100 AS hi FROM g WHERE again),
  m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS new FROM e),
  n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM m),
  s AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY doc_id, run),
  k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
  c AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS body FROM k JOIN t USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE body || substr(h, 2 * last + 1) END)) AS kept_sha256
  FROM t LEFT JOIN c USING (doc_id)"""

DECONTAMINATION = f"""WITH i AS ({_shingles('benchmark', 'item_id', 5)}), d AS ({_shingles('documents', 'doc_id', 5)}),
  n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1),
  m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM i JOIN d USING (s) GROUP BY 1, 2)
  SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id)
  WHERE 5 * n_shared >= 4 * n_item"""

NEAR_DEDUP = f"""WITH RECURSIVE d AS ({_shingles('documents', 'doc_id', 3)}),
  n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1)
  SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(c.low, t.doc_id)) AS component_id,
    t.doc_id = least(t.doc_id, coalesce(c.low, t.doc_id)) AS kept
  FROM documents t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

EXACT_DEDUP = """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS s FROM documents),
  r AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
    first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept FROM t)
  SELECT doc_id, keep_id, group_size, kept, s AS text_sha256 FROM r"""


#: crc32 of a decimal text by the table of the reversed polynomial.
_CRC = """crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""
_CRC_OF = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i])::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""


def _merkle(levels: int = 10) -> str:
    """Level by level: nodes keep their group's count ``n``; a group with one node is done and passes on unchanged.

    ``b`` and ``a`` are the siblings left and right of a node; a row of p is a document with its place on the level.
    """
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(body: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", body]
        parts = [f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
        return f"sha256({' || '.join(parts)})"

    out = [
        "WITH RECURSIVE " + _CRC,
        f"""d AS MATERIALIZED (SELECT row_number() OVER () AS nr, doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf,
    CASE WHEN {_CRC_OF.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(text)} ELSE {leaf('text')} END AS changed
    FROM documents, crc_table)""",
        """p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, nr) - 1 AS i, '' AS proof,
    changed AS fold FROM d)""",
        "n0 AS MATERIALIZED (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p0)",
    ]

    def climb(k: int, name: str, nodes: str) -> list[str]:
        return [
            f"""{nodes}s{k} AS MATERIALIZED (SELECT g, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {nodes}{k})""",
            f"""{name}{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (i, proof, fold), CASE WHEN n = 1 THEN p.i ELSE p.i // 8 END AS i,
    CASE WHEN n = 1 THEN proof ELSE proof || b || a END AS proof, CASE WHEN n = 1 THEN fold ELSE sha256(b || fold || a) END AS fold
    FROM {name}{k} p JOIN {nodes}s{k} s ON p.g = s.g AND p.i = s.i)""",
            f"""{nodes}{k + 1} AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT g, i, h FROM {nodes}{k} WHERE n = 1 UNION ALL
    SELECT g, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {nodes}{k} WHERE n > 1 GROUP BY g, i // 8))""",
        ]

    for k in range(levels):
        out += climb(k, "p", "n")
    out += [
        f"f0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS lang, count(*) OVER () AS n FROM n{levels})",
        f"""q0 AS MATERIALIZED (SELECT p.doc_id, p.leaf, r.h AS subroot, '' AS g, r.i, p.proof, p.fold FROM p{levels} p
    JOIN f0 r ON p.g = r.lang)""",
    ]
    for k in range(4):
        out += climb(k, "q", "f")
    body = ",\n  ".join(out)
    return f"""{body}
  SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM q4, f4"""


MERKLE = _merkle()


def _clusters(rounds: int = 10) -> str:
    """Rounds of exact assignment and floored means, over one row per component."""
    out = [
        """e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(x) AS x FROM e)",
        """s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c FROM e)""",
        "c0 AS MATERIALIZED (SELECT c, i, x AS y FROM s JOIN v USING (r) WHERE c < 8)",
    ]
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM (
    SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM v JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r)""")
        if k < rounds:
            out.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(w.y, o.y) AS y FROM c{k} o LEFT JOIN (
    SELECT m.c AS c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS y
    FROM v JOIN a{k} USING (r) GROUP BY m.c, i) w ON w.c = o.c AND w.i = o.i)""")
    body = ",\n  ".join(out)
    return f"""WITH {body},
  z AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY c)
  SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(m.d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256 FROM e JOIN a{rounds} USING (r) JOIN z ON z.c = m.c"""


CLUSTERS = _clusters()
