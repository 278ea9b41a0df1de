"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from notewise.llm import (chat, conversation_repair, fill_middle, fingerprints, near_text, near_vectors, packing, pivot_search, quality,
                          sentencepieces, token_counts, toxicity, url_filter)
from notewise.llm.catalog import query
from notewise.llm.staging import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The rules of the URL query (fixed values): host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP3_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES %s),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS n, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
""" % ", ".join(str(r) for r in URL_RULES)

#: The conversation that the chat query adds (fixed values).
CONTROL_TEXT = "</s>[INST] ok [/INST]"

OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
escaped AS (
  SELECT *, length(replace(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2', 'g'), '|>', '|\>'))
     + length(replace(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2', 'g'), '|>', '|\>')) AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n + length('<|turn|>') + length('<|text|>') + length('<|end|>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

#: The cheapest edits by a walk along the rows, one state of the role language at a time. crc32 is spelled out.
OP11_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                 lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS code
  FROM said),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
moves(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, price, said) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'),
  (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
edits AS (
  SELECT conv_id, n, p, p AS q, 2 AS price, 'D' AS said FROM judged, (VALUES (0), (1), (2), (3)) AS states(p)
  UNION ALL SELECT conv_id, n, p, q, CASE WHEN fault IS NULL THEN 0 ELSE 5 END, 'K' FROM judged JOIN moves USING (initial)
    WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT conv_id, n, p, q, CASE WHEN fault IS NULL THEN 1 ELSE 6 END, 'R' FROM judged, moves
    WHERE moves.initial <> 's' AND (fault IS NULL OR fault = 'truncated')),
steps AS (
  SELECT conv_id, n, e.p, i.q, min({'price': e.price + i.price, 'said': e.said || i.said}) AS step
  FROM edits e JOIN inserts i ON e.q = i.p GROUP BY ALL),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, q, {'price': price, 'said': said} AS best FROM counted, inserts WHERE p = 0
  UNION ALL
  SELECT walk.conv_id, walk.n + 1, steps.q, min({'price': best.price + step.price, 'said': best.said || step.said})
  FROM walk JOIN steps ON walk.conv_id IS NOT DISTINCT FROM steps.conv_id AND steps.n = walk.n + 1 AND steps.p = walk.q
  GROUP BY walk.conv_id, walk.n + 1, steps.q),
ended AS (
  SELECT conv_id, min(best) AS best FROM walk JOIN counted USING (conv_id) WHERE n = n_rows AND q IN (0, 3) GROUP BY conv_id),
letters AS (
  SELECT conv_id, i, substr(best.said, i, 1) AS letter, length(replace(best.said, 'D', '')) AS total,
         length(replace(substr(best.said, 1, i), 'I', '')) AS n, length(replace(substr(best.said, 1, i), 'D', '')) - 1 AS place
  FROM ended, range(1, length(best.said) + 1) AS r(i)),
lines AS (
  SELECT l.conv_id, i, CASE WHEN letter = 'K' THEN j.role WHEN (place - total % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':'
         || CASE WHEN letter = 'I' THEN '' ELSE j.text END AS line
  FROM letters l LEFT JOIN judged j ON l.conv_id IS NOT DISTINCT FROM j.conv_id AND l.n = j.n WHERE letter <> 'D'),
written AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS repaired_sha256 FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.price, 0)::BIGINT AS cost,
       coalesce(best.said, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN written w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
"""

OP12_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
hashed AS (SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM rows),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE
          WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""

OP13_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    """Every document's toxicity score, learnt from the labels that are not held out."""
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """Every document's piece ids, and the digest of the text that they decode to."""
    encoded = sentencepieces.encode(read_table(spark, sf_dir, "documents"), PIECES, decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"), "ids")


@query("op3_url_filters", OP3_SQL)
def op3_url_filters(spark, sf_dir):
    """Every page's URL judged by the rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), rules)


@query("op4_embedding_near_dedup")
def op4_embedding_near_dedup(spark, sf_dir):
    """Every vector's links (cosine 0.98 or more, equal label) and component."""
    return near_vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark, sf_dir):
    """Every document's fingerprint, that of its edited text, and their likeness."""
    return fingerprints.edit_report(read_table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Words and greedy word pieces of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), PIECES)


@query("op7_chat_formatting", OP7_SQL)
def op7_chat_formatting(spark, sf_dir):
    """All conversations formatted and read back, and one whose texts hold control strings."""
    turns = chat.turns_of_table(chat.rows_to_records(read_table(spark, sf_dir, "conversations")), "conv_id")
    said = [F.struct(F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("content")) for r in ("user", "assistant")]
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*said).alias("messages"))
    back = chat.read_back(chat.format_turns(turns.unionByName(chat.turns_of_table(extra, "conv_id"))))
    said_by_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_by_all, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       "formatted_chars")


@query("op8_packing")
def op8_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 ids."""
    return packing.pack(read_table(spark, sf_dir, "documents"), BYTE_BPE)


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    """Every document's perplexity under a model of the trusted (quality 1) documents, and its verdict."""
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(read_table(spark, sf_dir, "documents"), trusted)


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark, sf_dir):
    """Every document's near-duplicate component."""
    return near_text.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark, sf_dir):
    """All conversations damaged by a rule, and the cheapest repair of each."""
    table = read_table(spark, sf_dir, "conversations")
    plan, rows = conversation_repair.repair(conversation_repair.damaged(table))
    made = conversation_repair.digests(plan, rows)
    every = table.select("conv_id").distinct().withColumnRenamed("conv_id", "original")
    out = every.join(made, F.expr("original <=> conv_id"), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("original").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op12_fill_middle", OP12_SQL)
def op12_fill_middle(spark, sf_dir):
    """Every document cut and rearranged, and rebuilt from that."""
    made = fill_middle.transform(read_table(spark, sf_dir, "documents"))
    digested = made.withColumn("output_sha256", F.sha2("output", 256))
    return fill_middle.restore(digested).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                                                F.sha2("text", 256).alias("restored_sha256"))


@query("op13_exact_top_k", OP13_SQL)
def op13_exact_top_k(spark, sf_dir):
    """The ten vectors with the highest inner product with each vector whose id is divisible by 100."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return pivot_search.top_k(pivot_search.build(vectors), vectors.where("vec_id % 100 = 0"))
