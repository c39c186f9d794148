"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm import (
    decontamination, divergence, line_dedup, media, mixing, packing, pseudonyms, quality, simhash, spelling, token_counts, token_files, toxicity,
)
from emberlens.llm.common import materialise, shared_dir, table
from emberlens.llm.labelled import in_fold

TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, metadata = table(spark, sf_dir, "documents"), ("n_chars",)
    model = quality.train(docs, table(spark, sf_dir, "labels"), metadata_cols=metadata)
    return quality.score(docs, model, metadata_cols=metadata).withColumn("held_out", in_fold(F.col("doc_id"), 4, 2))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.read(spark, path, with_ids=False)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key="not a secret: the query's own")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", in_fold(F.col("doc_id"), 5, 0))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS text_md5 FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (
      ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size <= weight * level THEN 2.0::DOUBLE * source_size
    ELSE weight * max(CASE WHEN 2.0::DOUBLE * source_size > weight * level THEN level END) OVER () END AS target
  FROM levels
), rates AS (
  SELECT doc_id, size, text_md5, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE
  WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_md5), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate)
  THEN 1 ELSE 0 END) AS taken
FROM rates
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM doc),
windows AS (SELECT doc_id, pos, trim(lines[pos + 1]) AS a, trim(lines[pos + 2]) AS b, trim(lines[pos + 3]) AS c FROM numbered),
wide AS (SELECT * FROM windows WHERE a <> '' OR b <> '' OR c <> ''),
ranked AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
  FROM wide WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, pos)
),
later AS (
  SELECT doc_id, pos FROM ranked
  WHERE (doc_id <> first_doc OR pos <> first_pos) AND NOT (doc_id = first_doc AND pos < first_pos + 3)
),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (VALUES (0), (1), (2)) v(d)),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
exploded AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM doc),
kept AS (
  SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pos) AS text
  FROM exploded e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.doc_id IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM doc d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(media.store(table(spark, sf_dir, "documents")), "media")
    return media.describe(stored)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP9_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH doc AS (SELECT doc_id, {_OP9_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP9_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win, least(len(w), 13) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n),
spans AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM places),
hits AS (SELECT doc_id, i, s.n, item FROM spans s JOIN windows USING (win)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM step WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
),
counted AS (SELECT run, length(run) AS size, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, size, n, xor(list_reduce([CAST(CAST('0x' || substr(code, 2 * CAST(i AS INT) + 1, 2) AS INT) AS BIGINT) FOR i IN range(len(code) // 2)],
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INT) + 1]), 4294967295), 4294967295) AS h
  FROM counted, crc_table
),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % size AS INT)) || substr(run, CAST(h % size AS INT) + 2) ELSE run END AS word, n FROM hashed),
word AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
pair AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.rest = b.word
),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pair GROUP BY word),
named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM word w LEFT JOIN near USING (word)
),
follow AS (
  SELECT word, word AS at FROM named
  UNION ALL SELECT f.word, m.form FROM follow f JOIN named m ON f.at = m.word WHERE m.form IS NOT NULL
)
SELECT m.word, m.form, f.at AS root, m.n, CAST(m.n_near AS BIGINT) AS n_near, m.form_n
FROM named m JOIN follow f USING (word) JOIN named e ON f.at = e.word WHERE e.form IS NULL
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
),
each AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(terms) AS term FROM doc) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM each GROUP BY ALL HAVING count(*) >= 30),
counts AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN size USING (lang)
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality, op2_token_files, op3_pseudonyms, op4_simhash, op5_toxicity, op6_source_mixing, op7_line_dedup, op8_jpeg_media, op9_decontamination, op10_token_counts,
        op11_spelling, op12_divergence, op13_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": OP6_SQL, "op7_line_dedup": OP7_SQL, "op9_decontamination": OP9_SQL, "op11_spelling": OP11_SQL, "op12_divergence": OP12_SQL}
