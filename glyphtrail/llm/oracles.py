"""DuckDB SQL of the queries that SQL can express: the whole computation by its definition, without sketches or candidates."""

from __future__ import annotations

from .sharding import SEED, SHARDS


def crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its reflected polynomial 0xEDB88320."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


SHARDING = f"""
WITH bytes AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
sums AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS stratum, (strlen(t) + 1)::BIGINT AS size, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
  CASE WHEN t = '' THEN 0::BIGINT ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(substr(regexp_replace(hex(encode(t)), '(..)', ' 0x\\1', 'g'), 2), ' '), lambda x: x::BIGINT)),
    lambda c, b: xor(c >> 8, {crc_table()}[(xor(c, b) & 255) + 1]::BIGINT)), 4294967295::BIGINT) END AS text_crc32 FROM bytes),
placed AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM sums),
ranked AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, (g * {SHARDS} // n)::INT AS shard, (g - ((g * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, substr(stratum, 2) AS source, fraction FROM ranked"""

#: The windows of 200 bytes by their digests; runs of the ones that occur twice; what is left between the runs.
SUBSTRINGS = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, b, unnest(range(octet_length(b) - 199)) AS i FROM raw WHERE octet_length(b) >= 200),
windows AS (SELECT doc_id, i, md5(b[i + 1 : i + 200]) AS w FROM places),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM windows SEMI JOIN often USING (w)),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[lo + 1 : coalesce(hi, octet_length(b))]), '' ORDER BY lo) AS k FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN k IS NULL THEN b ELSE unhex(k) END) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

#: All pairs that share a shingle, counted, and everything reachable over those that are alike enough.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM words d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) r ON r.node = d.doc_id"""
