"""DuckDB SQL for those of the subpackage's queries that SQL can express on whole tables."""

ORACLES = {
    "op1_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 10
    """,
    "op13_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
        ), p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY rank <= 5
    """,
    "op5_url_list_as_of": r"""
        WITH captures AS (
          SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS DATE) AS fetched_on,
                 regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') AS host,
                 regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path
          FROM pages
        ), named AS (
          SELECT DISTINCT h FROM (SELECT host AS h FROM captures UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM captures UNION ALL SELECT host || path FROM captures WHERE host <> '' AND length(path) > 1) WHERE h <> ''
        ), d AS (
          SELECT h, ascii(substr(md5(h), 1, 1)) AS a, ascii(substr(md5(h), 3, 1)) AS c, ascii(substr(md5(h), 4, 1)) AS e,
                 CAST(DATE '2024-01-01' + CAST(ascii(substr(md5(h), 2, 1)) * 7 % 180 AS INTEGER) AS DATE) AS day
          FROM named
        ), entries AS (
          SELECT h AS pattern, 'block' AS verdict, day AS since FROM d WHERE a % 3 = 0
          UNION ALL
          SELECT h, CASE WHEN c % 2 = 0 THEN 'removed' ELSE 'allow' END, CAST(day + 60 AS DATE) FROM d WHERE a % 3 = 0 AND e % 2 = 0
        ), spans AS (
          SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM entries
        ), hits AS (
          SELECT c.page_id, c.url, s.verdict, s.pattern, s.since,
                 row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(s.pattern) DESC, s.since DESC) AS n
          FROM (SELECT page_id, url, fetched_on, unnest(list_append(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 99), '.')), CASE WHEN length(path) > 1 THEN host || path END)) AS name FROM captures) c
          JOIN spans s ON c.name = s.pattern
           AND s.verdict <> 'removed' AND s.since <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until)
        )
        SELECT c.page_id, c.url, CAST(c.fetched_on AS VARCHAR) AS fetched_on, c.host, coalesce(h.verdict, 'none') AS verdict, h.pattern, CAST(h.since AS VARCHAR) AS since
        FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND c.url = h.url AND h.n = 1
    """,
}

#: Quotation linking over the messages of a table or query named ``messages``.
QUOTES = r"""
        lines AS (
          SELECT conv_id, turn, i, string_split(text, chr(10))[i] AS line
          FROM messages, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)
        ), marked AS (
          SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[\x20\t]*>)+'), '[^>]', '', 'g')) AS level FROM lines
        ), runs AS (
          SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM marked
        ), passages AS (
          SELECT conv_id, turn, level, min(i) AS k, string_agg(regexp_replace(line, '^(?:[\x20\t]*>)+[\x20\t]?', ''), chr(10) ORDER BY i) AS body
          FROM runs WHERE level > 0 GROUP BY conv_id, turn, level, run
        ), own AS (
          SELECT c.conv_id, c.turn, CASE WHEN count(*) FILTER (WHERE m.level > 0) > 0
                   THEN trim(coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE m.level = 0), ''), ' ') ELSE any_value(c.text) END AS body
          FROM messages c JOIN marked m USING (conv_id, turn) GROUP BY c.conv_id, c.turn
        ), texts AS (
          SELECT conv_id, turn, 0 AS k, 0 AS level, body FROM own UNION ALL SELECT conv_id, turn, k, level, body FROM passages
        ), units AS (
          SELECT DISTINCT conv_id, turn, k, level, u, CASE WHEN u = whole THEN 1000 ELSE 1 END AS weight FROM (
            SELECT *, trim(regexp_replace(lower(body), '[\x20\t\r\n]+', ' ', 'g')) AS whole,
                   unnest(list_append(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(lower(x), '[\x20\t\r\n]+', ' ', 'g'))),
                                      trim(regexp_replace(lower(body), '[\x20\t\r\n]+', ' ', 'g')))) AS u FROM texts)
          WHERE length(u) > 0 AND (length(u) >= 20 OR u = whole)
        ), said AS (
          SELECT conv_id, u, min(turn) AS origin FROM units WHERE level = 0 GROUP BY conv_id, u
        ), hits AS (
          SELECT q.conv_id, q.turn, q.k, q.level, s.origin, sum(q.weight) AS weight
          FROM units q JOIN said s ON q.conv_id = s.conv_id AND q.u = s.u AND s.origin < q.turn WHERE q.level > 0
          GROUP BY q.conv_id, q.turn, q.k, q.level, s.origin
        ), best AS (
          SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY weight DESC, origin) = 1
        ), links AS (
          SELECT conv_id, turn, origin FROM best QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, k) = 1
        ), chain AS (
          SELECT conv_id, turn, origin AS root FROM links
          UNION ALL
          SELECT c.conv_id, c.turn, l.origin FROM chain c JOIN links l ON c.conv_id = l.conv_id AND c.root = l.turn
        ), roots AS (
          SELECT conv_id, turn, min(root) AS root FROM chain GROUP BY conv_id, turn
        ), counts AS (
          SELECT conv_id, turn, count(*) AS n, max(level) AS depth FROM passages GROUP BY conv_id, turn
        )
        SELECT c.conv_id, c.turn, c.role, o.body AS text, CAST(coalesce(p.n, 0) AS INTEGER) AS n_quotes,
               CAST(coalesce(p.depth, 0) AS INTEGER) AS quote_depth, l.origin AS reply_to, coalesce(r.root, c.turn) AS thread_root,
               row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(r.root, c.turn), c.turn, md5(o.body) NULLS FIRST) AS place
        FROM messages c JOIN own o USING (conv_id, turn) LEFT JOIN counts p USING (conv_id, turn)
        LEFT JOIN links l USING (conv_id, turn) LEFT JOIN roots r USING (conv_id, turn)
    """

ORACLES["op8_quotation_linking"] = (
    r"""WITH RECURSIVE earlier AS (SELECT conv_id AS conv, turn AS at, min(text) AS said FROM conversations GROUP BY conv_id, turn),
        messages AS (
          SELECT c.conv_id, c.turn, c.role, coalesce(CASE c.turn % 4 WHEN 1 THEN '> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10) WHEN 2 THEN '>' || translate(string_split(a.said, chr(10))[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || chr(10)
                 WHEN 3 THEN '> > ' || replace(b.said, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10) END, '') || c.text AS text
          FROM conversations c LEFT JOIN earlier a ON a.conv = c.conv_id AND a.at = c.turn - 1 LEFT JOIN earlier b ON b.conv = c.conv_id AND b.at = c.turn - 2
        ),"""
    + QUOTES
)


#: The checksum is the public CRC-32 over the text's bytes, by its table of 256 values.
ORACLES["op4_byte_balanced_shards"] = """
        WITH RECURSIVE step(b, c, k) AS (
          SELECT CAST(b AS BIGINT), CAST(b AS BIGINT), 0 FROM range(256) AS r(b)
          UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
        ), crc AS (
          SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8
        ), raw AS (
          SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents
        ), sized AS (
          SELECT doc_id, size, CAST(xor(list_reduce(list_transform(bytes, lambda x: CAST(('0x' || x) AS BIGINT)), lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32 FROM raw, crc
        ), placed AS (
          SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
                 row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n FROM sized
        ), cut AS (
          SELECT *, CAST(least(39, ((2 * upto - size) * 40) // (2 * total)) AS INTEGER) AS shard FROM placed
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
    """


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
