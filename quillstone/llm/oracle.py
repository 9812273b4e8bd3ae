"""SQL of the opN_ queries that SQL can express."""

from __future__ import annotations

from quillstone.llm import sharding
from quillstone.llm.queries import SHARDS

#: CRC-32 of UTF-8 bytes by its table, which is itself made by rule.
CRC32 = """
t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
b AS (SELECT doc_id, text, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes FROM documents),
c AS (SELECT doc_id, text, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM b, t)"""


def sharding_sql() -> str:
    tree = sharding.uniform_tree(SHARDS)
    return f"""WITH {CRC32}, s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, {sharding.draw_sql(tree)} AS shard, {sharding.draw_sql(sharding.grow(tree))} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s"""


#: Sets of 4-word shingles, links by counting shared ones, classes by the least reachable document.
JACCARD = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
m AS (SELECT x FROM x GROUP BY x HAVING count(*) > 1),
h AS (SELECT x.doc_id, x.x FROM x JOIN m USING (x)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2"""


#: Turns in order; the formatted length counts marks and the backslashes that escaping adds.
CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?(?:INST|ROLE|TEXT)\]|\|(?:image|audio|document|other|part)\|>)'))
  + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 19 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|/?(?:INST|ROLE|TEXT)\]|\|(?:image|audio|document|other|part)\|>)')) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


#: Phrases of two and three words of all pieces, counted in full; products are of 128 bits.
COLLOCATIONS = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
p AS (SELECT lang, phrase, a, k, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
s AS (SELECT p.lang, p.phrase, p.a, cut, fx.f AS l, fy.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(fx.f AS HUGEINT) * fy.f) AS score FROM p JOIN f fx ON fx.lang = p.lang AND fx.phrase = x JOIN f fy ON fy.lang = p.lang AND fy.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
h AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase AND 100 * d.a >= 50 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM h)
SELECT o.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op4_hash_tree": sharding_sql(), "op9_jaccard_join": JACCARD, "op11_chat_format": CHAT, "op13_collocations": COLLOCATIONS}
