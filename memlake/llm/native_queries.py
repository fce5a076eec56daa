"""Queries of the operators that need DataFrame functions only, with SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.llm import decontamination, licenses, line_quality, mixing, surrogates
from memlake.llm.base import query, read

WORDS = r"[^\x20\x09-\x0D]+"

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE
              WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT source, s, w, 2.0::DOUBLE * s AS cap,
         coalesce(sum(2.0::DOUBLE * s) OVER f, 0.0::DOUBLE) AS used,
         sum(w) OVER () - coalesce(sum(w) OVER f, 0.0::DOUBLE) AS open,
         1.5::DOUBLE * sum(s) OVER () AS budget
  FROM sources
  WINDOW f AS (ORDER BY 2.0::DOUBLE * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (budget - used) / open AS level FROM filled),
rest AS (SELECT arg_min(level, row(cap / w, source IS NULL, source)) AS rest FROM levels WHERE cap / w > level),
targets AS (SELECT source, s, round(least(cap, w * rest), 6) AS target FROM levels, rest),
line AS (
  SELECT d.doc_id, d.size, t.s, t.target, floor(t.target + 1e-6)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
       (CASE WHEN s > 0 THEN budget // s ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN s > 0 THEN budget % s ELSE 0 END - start)))::BIGINT AS taken
FROM line"""


@query("op7_mix_sources", MIX_SQL)
def op7_mix_sources(spark, sf_dir):
    """Every document's share of the mix, sources at weights 5, 2, 1 over 150 % of all words."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


DECONTAMINATE_SQL = r"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
spans AS (
  SELECT item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
  FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM spans),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT r, p, n, words FROM (
    SELECT r, p, 10 AS n, string_agg(word, ' ') OVER o AS words, count(*) OVER o AS k FROM tokens
    WINDOW o AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE k = 10
  UNION ALL
  SELECT d.r, g.p, l.n, array_to_string(d.w[g.p:g.p + l.n - 1], ' ')
  FROM docs d, lengths l, unnest(range(1, len(d.w) - l.n + 2)) AS g(p) WHERE l.n < 10),
hits AS (SELECT r, p, n, item FROM runs JOIN windows USING (n, words)),
inside AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN inside USING (r) LEFT JOIN named USING (r)"""


@query("op9_decontaminate", DECONTAMINATE_SQL)
def op9_decontaminate(spark, sf_dir):
    """Words of every document that lie in a ten-word window of the benchmark."""
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _sql_pattern(pattern: str) -> str:
    """The pattern for an engine without look-around: the sides of a phrase are matched instead."""
    return pattern.replace("(?<![a-z])", "(?:^|[^a-z])").replace("(?![a-z])", "(?:[^a-z]|$)").replace("'", "''")


QUALITY_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines
  FROM documents),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
runs AS (
  SELECT r, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS three FROM tokens
  WINDOW o AS (PARTITION BY r ORDER BY p)),
again AS (SELECT r, p FROM runs WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
repeats AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY r),
judged AS (
  SELECT r, line, len(regexp_extract_all(line, '{WORDS}')) AS n,
         len(regexp_extract_all(line, '{line_quality.SEPARATOR}')) AS seps,
         len(regexp_extract_all(line, '{_sql_pattern(line_quality.SYMBOL_RUN)}')) AS runs
  FROM (SELECT r, unnest(lines) AS line FROM docs)),
good AS (
  SELECT r, sum(n) AS n FROM judged
  WHERE regexp_matches(line, '{_sql_pattern(line_quality.SENTENCE_END)}') AND NOT runs * 3 > n
    AND NOT (seps >= 3 AND seps * 5 >= n)
    AND NOT (n <= {line_quality.BOILERPLATE_WORDS}
             AND regexp_matches(line, '{_sql_pattern(line_quality.BOILERPLATE)}'))
  GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{line_quality.SYMBOL}'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(good.n, 0) AS n_good
  FROM docs LEFT JOIN repeats USING (r) LEFT JOIN good USING (r)),
failed AS (
  SELECT *, n_words < {line_quality.LEAST_WORDS} OR 100 * n_repeat_words > {line_quality.MOST_REPEATED} * n_words
         AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_good >= {line_quality.LEAST_KEPT} * n_words AS kept
FROM failed"""


@query("op10_line_quality", QUALITY_SQL)
def op10_line_quality(spark, sf_dir):
    """Which documents keep enough of their words once failing lines are gone."""
    return line_quality.clean_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _license_sql() -> str:
    """The licence scan as SQL: one step of text marking, identifier cases, then one step per rule."""
    text = "text"
    for pattern, to in [(licenses.COMMENT, "$1"), *licenses.SENTENCE_BREAKS]:
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    lower = "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cases = " ".join(f"WHEN regexp_matches(s, '^(?:{p})$') THEN '{n}'" for n, p in licenses.SENTENCES)
    steps = ["found AS (SELECT r, coalesce(string_agg('<' || id || '>', '' ORDER BY i), '') AS rest, '' AS lic"
             " FROM named GROUP BY r), s0 AS (SELECT * FROM found)"]
    for k, (name, ids) in enumerate(licenses.RULES):
        tag = licenses._tag(ids)
        steps.append(
            f"s{k + 1} AS (SELECT r, replace(rest, '{tag}', '|') AS rest, lic || CASE WHEN contains(rest, '{tag}')"
            f" AND NOT contains(lic || ',', ',{name},') THEN ',{name}' ELSE '' END AS lic FROM s{k})")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, string_split({text}, '{licenses.BREAK}') AS parts FROM docs
        WHERE regexp_matches(text, '{licenses.STEMS}')),
parts AS (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM cut),
normal AS (SELECT r, i, trim(regexp_replace({lower}, '[^a-z0-9]+', ' ', 'g')) AS s FROM parts),
named AS (SELECT * FROM (SELECT r, i, CASE {cases} END AS id FROM normal
          WHERE regexp_matches(s, '{licenses.STEMS}')) WHERE id IS NOT NULL),
{', '.join(steps)}
SELECT doc_id, coalesce((SELECT string_agg(id, ',' ORDER BY i) FROM named n WHERE n.r = d.r), '') AS sentence_ids,
       coalesce(substr(lic, 2), '') AS licenses,
       coalesce(array_to_string(regexp_extract_all(rest, '<([A-Za-z0-9]+)>', 1), ','), '') AS unmatched
FROM docs d LEFT JOIN s{len(licenses.RULES)} USING (r)"""


@query("op2_license_scan", _license_sql())
def op2_license_scan(spark, sf_dir):
    """Licences that every document states."""
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "unmatched")])


@query("op3_surrogates")
def op3_surrogates(spark, sf_dir):
    """Every text with its personal data replaced by surrogates."""
    found = surrogates.replace_entities(read(spark, sf_dir, "documents"))
    return found.withColumn("kinds", F.array_join("kinds", ","))
