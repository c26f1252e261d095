"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from . import bpe, chat, counts, extract, neardup, packing, quality, sentences, simhash, topk, toxicity, trie, whitening

QUERIES = {
    "op1_html_extraction": extract.op1,
    "op2_chat_formatting": chat.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op4_packing": packing.op4,
    "op5_byte_bpe": bpe.op5,
    "op6_token_counts": counts.op6,
    "op7_toxicity": toxicity.op7,
    "op8_quality": quality.op8,
    "op9_embedding_near_dedup": neardup.op9,
    "op10_exact_top_k": topk.op10,
    "op11_conversation_trie": trie.op11,
    "op12_sentencepiece": sentences.op12,
    "op13_embedding_whitening": whitening.op13,
}

_LENGTH = "length({0}) + length({0}) - length(replace({0}, chr(27), ''))" + "".join(
    f" + 2 * ((length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)})" for c in chat.CONTROLS)

_CRC32 = ("4294967295 - list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda crc, byte: "
          "list_reduce([xor(crc, byte)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))")

#: The others cannot be given in SQL over whole tables in reasonable time; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_chat_formatting": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(7 + sum(23 + {_LENGTH.format('role')} + {_LENGTH.format('text')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op9_embedding_near_dedup": """WITH RECURSIVE b AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 ok AS MATERIALIZED (SELECT * FROM b WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS MATERIALIZED (SELECT a.uid AS u, b.uid AS v FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.uid <> b.uid
 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 reach AS (SELECT uid, vec_id AS least FROM ok UNION SELECT l.u, r.least FROM links l JOIN reach r ON r.uid = l.v),
 c AS (SELECT uid, min(least) AS component_id FROM reach GROUP BY uid), n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
 SELECT b.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.component_id, b.vec_id) AS component_id,
 coalesce(b.vec_id = coalesce(c.component_id, b.vec_id), false) AS kept FROM b LEFT JOIN c USING (uid) LEFT JOIN n ON n.u = b.uid""",
    "op10_exact_top_k": """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
 FROM b a JOIN b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op11_conversation_trie": f"""WITH t AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w
 FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
 c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, ({_CRC32.format('CAST(conv_id AS VARCHAR)')}) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
 b AS MATERIALIZED (SELECT c.*, coalesce(least(h, n), 0) AS lent FROM c LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM o GROUP BY conv_id) USING (base)),
 s AS (SELECT b.conv_id, o.pos, o.digest, o.w FROM b JOIN o ON o.conv_id = b.base AND o.pos <= b.h
 UNION ALL SELECT b.conv_id, o.pos - b.h + b.lent, o.digest, o.w FROM b JOIN o ON o.conv_id = b.conv_id AND o.pos > b.h),
 k AS (SELECT conv_id, pos AS depth, w, md5(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM s
 UNION ALL SELECT conv_id, 0, 0, '' FROM b),
 m AS MATERIALIZED (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM k),
 n AS MATERIALIZED (SELECT key, any_value(up) AS up, any_value(depth) AS depth, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key),
 ch AS MATERIALIZED (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
 sub AS (SELECT m.key, count(*) FILTER (ch.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved_tokens
 FROM n LEFT JOIN ch USING (key) JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.key)
 SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children,
 sub.n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
 FROM n JOIN sub USING (key) LEFT JOIN ch USING (key) LEFT JOIN n p ON p.key = n.up""",
}
