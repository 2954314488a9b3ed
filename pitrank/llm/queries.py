"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, html, langid, lattice, minhash, mixing, outliers, packing, prefixtrie, quality, repair, toxicity
from .common import FIT_ROWS, fold_of, join_labels, read_table


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit_language(docs.where(fold_of() != 0))
    out = langid.identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score", "lang_rejected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(labelled_toxicity(spark, docs, sf_dir), ["toxic"])
    out = toxicity.predict_chain(docs, chain)
    scores = [c for c in out.columns if c.startswith("p_")]
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), *scores, "toxic")


def labelled_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labelled rows outside the held-out fold; the labels are sampled before they meet the texts."""
    labels = read_table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & (fold_of() != 0))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return join_labels(docs.select("doc_id", "text"), labels, toxicity.TOXIC_FIT_ROWS)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(chat.log_of_turns(turns))
    back = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.text_under_mask(F.col("formatted"), F.col("loss_spans"))})
    told_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told_turns, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outliers.robust_quality(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_embeddings(read_table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (fold_of() != 0))
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    net = quality.fit_quality(docs, join_labels(docs, labels, 2 * FIT_ROWS))
    out = quality.score_quality(docs, net)
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    out = html.extract_main(pages.select("page_id", "url", "html"), html.fit_labeller(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` in sequences of 1024 ids, with the checksum of their ids."""
    import public_tokenizers

    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefixtrie.prefix_trie(prefixtrie.with_shared_starts(prefixtrie.turn_sequences(turns)))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_texts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_conversations(repair.damaged(turns))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat": op2_chat,
    "op3_toxicity": op3_toxicity,
    "op4_minhash": op4_minhash,
    "op7_quality_rules": op7_quality_rules,
    "op5_html": op5_html,
    "op6_lattice": op6_lattice,
    "op8_quality": op8_quality,
    "op10_packing": op10_packing,
    "op9_language_id": op9_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bpe": op12_bpe,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-')), 1, 15))::BIGINT AS pos
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((rn - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM o),
f AS (SELECT min(k) AS k0, arg_min(share, k) AS level FROM l WHERE share <= ratio),
t AS (
  SELECT source, source_size, CASE WHEN k0 IS NOT NULL AND k >= k0 THEN least(cap, level * weight) ELSE cap END AS target
  FROM l, f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (SELECT source, pos, sum(size) AS size FROM d WHERE size > 0 GROUP BY ALL),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pos) AS run FROM p),
m AS (
  SELECT r.source, r.pos, run - r.size / 2 <= target - whole * source_size AS more
  FROM r JOIN n ON r.source IS NOT DISTINCT FROM n.source)
SELECT d.doc_id, d.size::BIGINT AS size, n.source_size, n.target,
       ((n.whole + CASE WHEN m.more THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.pos = m.pos
""",
    "op2_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(replace(text, '\', '\0')) + len(regexp_extract_all(text, '(<\||<</SYS>>|<<SYS>>|</s>|<s>|\[/INST\]|\[INST\])'))
         + len(replace(role, '\', '\0')) + len(regexp_extract_all(role, '(<\||<</SYS>>|<<SYS>>|</s>|<s>|\[/INST\]|\[INST\])'))
         + len('<|turn|><|body|><|end|>') AS size
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op6_lattice": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n2 FROM embeddings),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) >= 0.9 * sqrt(a.n2) * sqrt(b.n2)),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id
""",
    "op4_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 1 THEN words
                      ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM w WHERE len(words) > 0),
g AS (SELECT list_sort(shingles) AS shingles, min(doc_id) AS first_id FROM s GROUP BY 1),
x AS (SELECT first_id, len(shingles) AS n, unnest(shingles) AS shingle FROM g),
p AS (
  SELECT a.first_id AS a, b.first_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.shingle = b.shingle AND a.first_id < b.first_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE common * 100 >= (na + nb - common) * 80),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT first_id AS node, first_id AS root FROM g UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT s.doc_id, len(s.shingles) AS n_shingles, g.first_id FROM s JOIN g ON g.shingles = list_sort(s.shingles))
SELECT d.doc_id, coalesce(k.n_shingles, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON c.node = k.first_id
""",
    "op11_prefix_trie": r"""
WITH RECURSIVE b AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM b WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM b WHERE k = 8),
o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
                           ORDER BY turn NULLS FIRST, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, turns, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) AS chars FROM o),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, chars), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 4 AS h FROM k, crc),
c AS (SELECT h.conv_id, list_concat(coalesce(l.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN h l ON l.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d AS depth, len(turns) AS size, turns[1:d] AS path, CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM c)),
n AS (SELECT depth, path, min(conv_id) AS id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
      FROM m GROUP BY depth, path),
-- The node of every member at every depth; a node's subtree is what its least member's longer paths pass through.
i AS (SELECT m.conv_id, m.depth, n.id FROM m JOIN n ON m.depth = n.depth AND m.path = n.path),
p AS (SELECT n.*, i.id AS parent FROM n LEFT JOIN i ON i.conv_id = n.id AND i.depth = n.depth - 1),
q AS (SELECT p.*, (SELECT count(*) FROM p x WHERE x.parent = p.id AND x.depth = p.depth + 1) AS n_children FROM p),
s AS (SELECT i.id, i.depth, sum((q.n_convs - 1) * q.words) AS saved_tokens, count(*) FILTER (WHERE q.n_children = 0) AS n_leaves
      FROM q JOIN i ON i.conv_id = q.id AND i.depth <= q.depth GROUP BY i.id, i.depth)
SELECT q.id AS conv_id, q.depth, q.parent AS parent_conv_id, q.n_convs, q.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, q.ends_sha256
FROM q JOIN s ON s.id = q.id AND s.depth = q.depth
""",
    "op13_repair": r"""
WITH RECURSIVE b AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM b WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM b WHERE k = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS chars
      FROM conversations),
n AS (SELECT k.* EXCLUDE (chars), xor(list_reduce(list_prepend(4294967295::BIGINT, chars), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 20 AS kind
      FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM n),
o AS (SELECT *, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             regexp_replace(text, '[ 	-
]+$', '') AS bare FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS px FROM o),
g AS (SELECT conv_id, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
             count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal
      FROM f GROUP BY conv_id),
-- Best edits by state (none, s, u, a): cost in ten digits, then the initials.
p AS (
  SELECT conv_id, 0::BIGINT AS i, '0000000000' AS n, NULL::VARCHAR AS s, '0000000003I' AS u, '0000000006II' AS a FROM g
  UNION ALL
  SELECT conv_id, i, n, s, u, least(a, lpad((left(u, 10)::BIGINT + 3)::VARCHAR, 10, '0') || substr(u, 11) || 'I')
  FROM (
    SELECT conv_id, i, n, s, a,
           least(u, lpad((left(n, 10)::BIGINT + 3)::VARCHAR, 10, '0') || substr(n, 11) || 'I', lpad((left(s, 10)::BIGINT + 3)::VARCHAR, 10, '0') || substr(s, 11) || 'I',
                 lpad((left(a, 10)::BIGINT + 3)::VARCHAR, 10, '0') || substr(a, 11) || 'I') AS u
    FROM (
      SELECT p.conv_id, f.i, lpad((left(n, 10)::BIGINT + 4)::VARCHAR, 10, '0') || substr(n, 11) || 'D' AS n,
             least(lpad((left(s, 10)::BIGINT + 4)::VARCHAR, 10, '0') || substr(s, 11) || 'D',
                   CASE WHEN q.free AND x = 's' THEN lpad((left(n, 10)::BIGINT + extra)::VARCHAR, 10, '0') || substr(n, 11) || 'K' END) AS s,
             least(lpad((left(u, 10)::BIGINT + 4)::VARCHAR, 10, '0') || substr(u, 11) || 'D',
                   CASE WHEN q.free THEN lpad((left(n, 10)::BIGINT + extra + CASE WHEN x = 'u' THEN 0 ELSE 3 END)::VARCHAR, 10, '0') || substr(n, 11) || CASE WHEN x = 'u' THEN 'K' ELSE 'R' END END,
                   CASE WHEN q.free THEN lpad((left(s, 10)::BIGINT + extra + CASE WHEN x = 'u' THEN 0 ELSE 3 END)::VARCHAR, 10, '0') || substr(s, 11) || CASE WHEN x = 'u' THEN 'K' ELSE 'R' END END,
                   CASE WHEN q.free THEN lpad((left(a, 10)::BIGINT + extra + CASE WHEN x = 'u' THEN 0 ELSE 3 END)::VARCHAR, 10, '0') || substr(a, 11) || CASE WHEN x = 'u' THEN 'K' ELSE 'R' END END) AS u,
             least(lpad((left(a, 10)::BIGINT + 4)::VARCHAR, 10, '0') || substr(a, 11) || 'D',
                   CASE WHEN q.free THEN lpad((left(u, 10)::BIGINT + extra + CASE WHEN x = 'a' THEN 0 ELSE 3 END)::VARCHAR, 10, '0') || substr(u, 11) || CASE WHEN x = 'a' THEN 'K' ELSE 'R' END END) AS a
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1,
           LATERAL (SELECT f.fault NOT IN (1, 2) AS free, CASE WHEN f.fault = 3 THEN 3 ELSE 0 END AS extra) q))),
e AS (SELECT g.*, least(p.n, p.a) AS best FROM g JOIN p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.i = g.m),
-- Each letter with the row it takes (insertions take none) and its place among the turns that stay.
w AS (SELECT conv_id, unnest(string_split(substr(best, 11), '')) AS letter, unnest(range(1, len(best) - 9)) AS pos FROM e WHERE len(best) > 10),
t AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i,
             sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS place,
             sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS turns FROM w),
r AS (SELECT t.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (turns - place) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':'
             || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS told
      FROM t LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i AND t.letter <> 'I'
      WHERE letter <> 'D' GROUP BY t.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 10)::BIGINT, 0) AS cost, coalesce(substr(best, 11), '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}
