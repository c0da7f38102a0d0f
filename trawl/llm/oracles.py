"""DuckDB SQL for those queries of this folder that SQL can express."""

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP2 = """WITH RECURSIVE ok AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)"""

OP6 = f"""WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, regexp_split_to_array(coalesce(text, ''), '\\n') AS raw FROM documents),
lines AS MATERIALIZED (SELECT doc_id, source, text, line, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS plain FROM (SELECT doc_id, source, text, unnest(raw) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
spots AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM spots JOIN (SELECT doc_id, g FROM spots GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM twice GROUP BY doc_id),
texts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
held AS (SELECT source, lower(plain) AS line, count(DISTINCT text) AS n, min(doc_id) AS first FROM lines GROUP BY ALL),
above AS (SELECT held.* FROM held JOIN texts ON texts.source IS NOT DISTINCT FROM held.source WHERE n >= 20 AND n > 0.1 * texts),
gone AS (SELECT doc_id, sum(len({_WORDS.format("lines.plain")})) AS removed FROM lines JOIN above ON above.source IS NOT DISTINCT FROM lines.source AND above.line = lower(lines.plain) AND first <> doc_id GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 20 AS kept, removed_words FROM m"""

OP8 = f"""WITH d AS MATERIALIZED (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, ('0x' || substring(md5(doc_id || '-mix'), 1, 10))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
u AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS place FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM u WINDOW b AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE 2 * source_size / w > level),
g AS MATERIALIZED (SELECT source, source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN 2.0::DOUBLE * source_size ELSE w * f.level END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM g),
r AS (SELECT source, h, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT p.*, r.h, n, sum(n) OVER (PARTITION BY p.source ORDER BY h) AS upto, target - passes * source_size AS more FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, arg_min(struct_pack(h := h, n := n, left_ := more - (upto - n)), h) AS e FROM c WHERE upto > more GROUP BY source),
t AS (SELECT d.*, p.source_size, p.target, CAST(least(2, passes + CASE WHEN d.h < e.h + CASE WHEN e.n - e.left_ < e.left_ THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS INTEGER) AS times FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN (SELECT source, e.h AS h, e.n AS n, e.left_ AS left_ FROM e) e ON e.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, size, source_size, target, CAST(times * size AS BIGINT) AS taken, times FROM t"""

OP10 = """WITH p AS MATERIALIZED (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
n AS (SELECT *, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', s[i]) - 1) AS v, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[5 * i // 4 + 1] * 16 + coalesce(v[5 * i // 4 + 2], 0)) >> (3 - 5 * i % 4)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, coalesce(url, '') AS url FROM n"""

_SAID = "'[^\\x20\\x09-\\x0D]'"

OP11 = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) x(i))),
named AS MATERIALIZED (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) % 20 AS d FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE d <> 0),
seen AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
fault AS MATERIALIZED (SELECT conv_id, turn, role, text, i, role[1:1] AS initial, before[1:1] AS before, CASE WHEN NOT regexp_matches(text, {_SAID}) THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS f FROM seen),
ins(a, b, cost, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (3, 2, 2, 'I'), (2, 3, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
moves(a, b, r) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
edits AS MATERIALIZED (SELECT conv_id, i, a, b, CASE WHEN r = initial THEN 0 ELSE 2 END + CASE WHEN f = 't' THEN 1 ELSE 0 END AS cost, CASE WHEN r = initial THEN 'K' ELSE 'R' END AS letter FROM fault JOIN moves ON r = initial OR r <> 's' WHERE f NOT IN ('b', 'd') UNION ALL SELECT conv_id, i, s, s, 3, 'D' FROM fault, range(4) x(s)),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0, 'a': ''}} AS v FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT best.conv_id, best.i + 1, edits.b, min({{'c': v.c + ins.cost + edits.cost, 'a': v.a || ins.letters || edits.letter}}) FROM best JOIN ins ON ins.a = s JOIN edits ON edits.conv_id IS NOT DISTINCT FROM best.conv_id AND edits.i = best.i + 1 AND edits.a = ins.b GROUP BY ALL),
ends AS MATERIALIZED (SELECT conv_id, min({{'c': v.c + cost, 'a': v.a || letters}}) AS v FROM best JOIN ins ON ins.a = s AND ins.b IN (0, 3) WHERE i = coalesce((SELECT max(i) FROM fault WHERE fault.conv_id IS NOT DISTINCT FROM best.conv_id), 0) GROUP BY conv_id),
steps AS (SELECT conv_id, v.a AS audit, unnest(range(1, length(v.a) + 1)) AS p FROM ends),
marks AS (SELECT conv_id, p, audit[p] AS e, p - length(replace(audit[1:p], 'I', '')) AS put, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS o FROM steps),
made AS (SELECT m.conv_id, p, o, CASE WHEN e <> 'I' THEN text ELSE '' END AS text, CASE WHEN e = 'K' THEN role END AS role, max(CASE WHEN e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS shift FROM marks m LEFT JOIN fault f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i WHERE e <> 'D'),
said AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p) AS said FROM made GROUP BY conv_id),
sums AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY conv_id)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, v.c::BIGINT AS cost, v.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256 FROM ends LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ends.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM ends.conv_id"""

_TERMS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP13 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format("text")} AS terms FROM documents),
c AS MATERIALIZED (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS total FROM d),
m AS (SELECT row, doc_id, 25 + (75 * len(terms) * docs) // total AS m FROM d, c WHERE len(terms) > 0),
i AS (SELECT row_number() OVER () AS number, item_id, {_TERMS.format("text")} AS terms FROM benchmark),
q AS MATERIALIZED (SELECT number, item_id, term, count(*) AS times FROM (SELECT number, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
p AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT number, item_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT number, item_id, doc_id, score, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s JOIN m USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLES = {"op2_embedding_near_dedup": OP2, "op6_quality_rules": OP6, "op8_mixing": OP8, "op10_warc": OP10, "op11_conversation_repair": OP11, "op13_lexical_search": OP13}
