"""Queries of the operators that learn, search for near copies, or work inside Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.llm import class_lm, hard_negatives, html_main, language_id, near_dedup, pieces, sharding, turns
from memlake.llm.base import query, read


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    """The language of every document, learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.learn(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op1_pack_shards")
def op1_pack_shards(spark, sf_dir):
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    packed = sharding.shard(read(spark, sf_dir, "documents"), 24)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
spans AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM spans),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM words UNION SELECT node, v FROM reach JOIN links ON u = other),
first AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN first ON node = doc_id"""


@query("op5_near_duplicates", NEAR_SQL)
def op5_near_duplicates(spark, sf_dir):
    """The group of near copies that every document belongs to."""
    found = near_dedup.similar_components(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op6_main_text")
def op6_main_text(spark, sf_dir):
    """The article of every page."""
    found = html_main.main_text(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op4_class_lm")
def op4_class_lm(spark, sf_dir):
    """Log10 probability of every text under a class bigram model of six sevenths of them."""
    docs = read(spark, sf_dir, "documents")
    away = class_lm.held_out(F.col("doc_id"))
    model, counts = class_lm.train(docs.where(~away).select("text"))
    return class_lm.score_texts(docs, model, counts).select(
        "doc_id", away.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def piece_model() -> str:
    """The public 32k merge vocabulary of the machine; other models are passed to the operator by their path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op11_piece_ids")
def op11_piece_ids(spark, sf_dir):
    """Ids of every text in a merge vocabulary, and the text that they decode to."""
    encoded = pieces.encode(read(spark, sf_dir, "documents"), piece_model(), eos=True, back=True)
    ids = F.col("pieces")["ids"]
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), pieces.digest(ids).alias("ids_sha256"),
        F.sha2(F.col("pieces")["decoded"], 256).alias("decoded_sha256"),
    )


NEGATIVES_SQL = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v),
      lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark, sf_dir):
    """Rows of other labels that score nearly as high as an anchor's best rows of its own label."""
    rows = hard_negatives.usable(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # A row without an id isn't divisible by anything.
    rows = rows.withColumn("label", F.when(F.col("id") == hard_negatives.NO_ID, F.col("label")).otherwise(moved))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


TURNS_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (
  SELECT * EXCLUDE (name), xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(name, '.'), lambda x: ascii(x)::BIGINT)),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM named, crc),
broken AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM broken),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    CASE substr(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind,
    i > 1 AND substr(lag(role) OVER w, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
inserts(s, put, mid, added) AS (VALUES
  (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']),
  (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
  (2, '', 2, []), (2, 'I', 3, ['assistant:']), (2, 'II', 2, ['assistant:', 'user:']),
  (3, '', 3, []), (3, 'I', 2, ['user:']), (3, 'II', 3, ['user:', 'assistant:'])),
steps AS (
  SELECT s, put || edit AS put, added, edit, mid,
    2 * len(put) + CASE edit WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END AS paid
  FROM inserts, (VALUES ('D'), ('K'), ('R')) e(edit)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM counted
  UNION ALL
  SELECT conv_id, i, s, cost, audit, said FROM (
    SELECT w.conv_id, r.i, w.cost + paid + (edit <> 'D' AND fault = 'truncated')::INT AS cost, audit || put AS audit,
      CASE edit WHEN 'D' THEN mid WHEN 'K' THEN kind ELSE CASE mid WHEN 2 THEN 3 ELSE 2 END END AS s,
      list_concat(said, added, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
        ELSE [CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END) AS said
    FROM walk w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN steps USING (s)
    WHERE (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
      AND (edit <> 'K' OR kind = 1 AND mid = 0 OR kind = 2 AND mid <> 2 OR kind = 3 AND mid = 2))
  QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
ended AS (
  SELECT w.conv_id, cost + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost,
    audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(said, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS said
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n),
chosen AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query("op13_turn_repair", TURNS_SQL)
def op13_turn_repair(spark, sf_dir):
    """The cheapest edits after which the roles of every damaged conversation take turns."""
    return turns.repair(turns.damaged(read(spark, sf_dir, "conversations")))
