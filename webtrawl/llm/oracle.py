"""The queries of this subpackage in DuckDB SQL, where it can express them."""

EXACT_DEDUP = """
WITH marked AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT
    doc_id,
    max(doc_id) OVER same AS keep_id,
    count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
    text_sha256
FROM marked
WINDOW same AS (PARTITION BY text_sha256)
"""

WARC = """
WITH hashed AS (
    SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
    FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
           row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST, url NULLS FIRST) = 1 AS responds
    FROM hashed
)
SELECT
    page_id,
    payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31
            AS INTEGER) + 1,
        1)), '') AS payload_digest,
    CASE WHEN responds OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN NOT responds THEN first END AS refers_to,
    true AS intact
FROM firsts
"""

LINE_SPREAD = """
WITH split AS (
    SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS pieces FROM documents
), lines AS (
    SELECT source, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line
    FROM (SELECT source, unnest(pieces) AS line FROM split)
), boilerplate AS (
    SELECT line FROM lines WHERE line <> '' GROUP BY line
    HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= 8
), numbered AS (
    SELECT doc_id, source, len(pieces) AS n_lines, unnest(pieces) AS line,
           unnest(range(0, len(pieces))) AS place
    FROM split
), kept AS (
    SELECT doc_id, source, n_lines, place, n.line, b.line IS NOT NULL AS gone
    FROM numbered n LEFT JOIN boilerplate b
      ON trim(n.line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = b.line
)
SELECT doc_id, source, n_lines,
       sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS clean_text
FROM kept GROUP BY doc_id, source, n_lines
"""

PREFERENCES = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
    FROM conversations
), learned AS (
    SELECT conv_id, seq, text, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS place,
           count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WHERE role = 'assistant'
), picked AS (
    SELECT conv_id, seq, text, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS number, count(*) OVER () AS last
    FROM learned WHERE place = (coalesce(conv_id, 0) * 31 + 7) % n + 1
), changes AS (
    SELECT p.conv_id, p.seq AS at, d.conv_id AS donor_id, d.text AS other
    FROM picked p JOIN picked d ON d.number = p.number % p.last + 1
), sides AS (
    SELECT t.conv_id, c.donor_id, t.seq, t.role, t.text, CASE WHEN t.seq < c.at THEN t.text WHEN t.seq = c.at THEN c.other END AS other
    FROM turns t JOIN changes c ON t.conv_id IS NOT DISTINCT FROM c.conv_id
), split AS (
    SELECT conv_id, coalesce(min(CASE WHEN other IS DISTINCT FROM text THEN seq END), 1 << 40) AS split FROM sides GROUP BY conv_id
), parts AS (
    SELECT s.conv_id, donor_id, seq, (seq - 1) // 1000 AS piece, 'prompt' AS part, role, text
    FROM sides s JOIN split p ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE seq < split
    UNION ALL
    SELECT s.conv_id, donor_id, seq, (seq - 1) // 1000, 'chosen', role, text
    FROM sides s JOIN split p ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE seq >= split
    UNION ALL
    SELECT s.conv_id, donor_id, seq, (seq - 1) // 1000, 'rejected', role, other
    FROM sides s JOIN split p ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE seq >= split AND other IS NOT NULL
), rendered AS (
    SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS line FROM parts
), placed AS (
    SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, piece, part ORDER BY seq) - length(line) AS before FROM rendered
), spans AS (
    SELECT *, CASE WHEN part <> 'prompt' AND role = 'assistant'
                   THEN (before + length(role) + 5)::VARCHAR || '-' || (before + length(line))::VARCHAR END AS span
    FROM placed
)
SELECT conv_id, any_value(donor_id) AS donor_id, piece,
       coalesce(string_agg(line, '' ORDER BY seq) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY seq) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY seq) FILTER (WHERE part = 'chosen'), '') AS chosen_loss,
       coalesce(string_agg(line, '' ORDER BY seq) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY seq) FILTER (WHERE part = 'rejected'), '') AS rejected_loss
FROM spans GROUP BY conv_id, piece
"""


PHRASES = r"""
WITH texts AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT doc, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), split AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), totals AS (
    SELECT lang, sum(len(words))::HUGEINT AS n FROM split GROUP BY lang
), phrases AS (
    SELECT lang, unnest(list_transform(range(1, len(words) - d + 2), lambda i: words[i : i + d - 1])) AS words
    FROM split, (SELECT unnest(range(1, 6)) AS d) WHERE len(words) >= d
), counts AS (
    SELECT lang, words, count(*)::HUGEINT AS f FROM phrases GROUP BY lang, words HAVING count(*) >= 100
), candidates AS (
    SELECT * FROM counts WHERE len(words) > 1
), held AS (
    SELECT DISTINCT c.lang, c.words FROM candidates c JOIN candidates o
      ON c.lang = o.lang AND c.f = o.f AND len(o.words) > len(c.words)
     AND len(list_filter(range(1, len(o.words) - len(c.words) + 2),
                         lambda i: o.words[i : i + len(c.words) - 1] = c.words)) > 0
), cuts AS (
    SELECT c.lang, c.words, c.f AS a, k, l.f AS l, r.f AS r, t.n, (1000 * c.f * t.n) // (l.f * r.f) AS score
    FROM candidates c CROSS JOIN (SELECT unnest(range(1, 5)) AS k) JOIN totals t ON t.lang = c.lang
    JOIN counts l ON l.lang = c.lang AND l.words = c.words[1 : k]
    JOIN counts r ON r.lang = c.lang AND r.words = c.words[k + 1 :]
    WHERE k < len(c.words)
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM cuts
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank,
           array_to_string(words, ' ') AS phrase, a, l, r, n, score
    FROM lowest WHERE place = 1 AND (lang, words) NOT IN (SELECT lang, words FROM held)
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

VECTOR_DEDUP = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""

# CRC-32 bit by bit: 3988292384 is its polynomial, 4294967295 its first and last mask.
TURN_TRIE = """
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id
                              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
    FROM conversations WHERE conv_id IS NOT NULL
), hashed AS (
    SELECT DISTINCT conv_id, xor(4294967295::BIGINT, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1),
                    lambda i: ascii(substr(conv_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(0, 8), lambda z: 0::BIGINT)),
                                 lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 6 AS h
    FROM own
), rebuilt AS (
    SELECT r.conv_id, 0 AS part, o.seq, o.role, o.text
    FROM hashed r JOIN own o ON o.conv_id = r.conv_id - r.conv_id % 100 AND o.seq <= r.h
    UNION ALL
    SELECT r.conv_id, 1, o.seq, o.role, o.text FROM hashed r JOIN own o ON o.conv_id = r.conv_id AND o.seq > r.h
), chained AS (
    SELECT conv_id, text, row_number() OVER w AS depth,
           string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER w AS path
    FROM rebuilt
    WINDOW w AS (PARTITION BY conv_id ORDER BY part, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), members AS (
    SELECT path, depth, conv_id, length(text) AS size FROM chained
    UNION ALL SELECT '', 0, conv_id, 0 FROM hashed
), lasts AS (
    SELECT conv_id, max_by(path, depth) AS path FROM members GROUP BY conv_id
), ends AS (
    SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM lasts GROUP BY path
), plain AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved
    FROM members GROUP BY path, depth
), nodes AS (
    SELECT p.*, CASE WHEN depth > 0 THEN substr(path, 1, 32 * (depth - 1)::INTEGER) END AS above FROM plain p
), children AS (
    SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above
), counted AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)
), spread AS (
    SELECT unnest(list_transform(range(0, depth + 1), lambda k: substr(path, 1, 32 * k::INTEGER))) AS path,
           saved, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf
    FROM counted
), sums AS (
    SELECT path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM spread GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.sha, sha256('')) AS ends_sha256
FROM counted n JOIN sums s USING (path) LEFT JOIN ends e USING (path) LEFT JOIN nodes p ON p.path = n.above
"""


def all_sql() -> dict[str, str]:
    return {
        "op4_preferences": PREFERENCES,
        "op5_line_spread": LINE_SPREAD,
        "op6_exact_dedup": EXACT_DEDUP,
        "op10_warc": WARC,
        "op11_phrases": PHRASES,
        "op12_vector_dedup": VECTOR_DEDUP,
        "op13_turn_trie": TURN_TRIE,
    }
