"""The registered query of each operator, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary.llm import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, substring_dedup, suffix_tree_lm, token_counts, warc
from formulary.llm.storage import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 3))::INTEGER AS bucket
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
         list_extract([3.0, 1.0, 2.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight
  FROM s),
l AS (
  SELECT source, source_size, most, weight,
         ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(most, coalesce((SELECT max(level) FROM l WHERE level < most / weight) * weight, most)) AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, chr(1))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l),
r AS (
  SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS f,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.bucket, d.doc_id) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rank * f + u) - floor((rank - 1) * f + u))::BIGINT * size AS taken
FROM r
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS least FROM n UNION SELECT e.y, r.least FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(least) AS least FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
  FROM documents),
w AS (SELECT doc_id, line, content, list_filter(regexp_split_to_array(content, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
u AS (SELECT words, len(words) AS n, min(ROW(doc_id, line)) AS place FROM w WHERE len(words) > 0 GROUP BY words),
v AS (
  SELECT place, n, unnest(range(n)) AS i, words FROM u WHERE n >= 8),
d AS (SELECT place, n, i, array_to_string(list_concat(words[1:i], words[i + 2:]), ' ') AS key FROM v),
f AS (SELECT place, array_to_string(words, ' ') AS key FROM u WHERE n >= 8),
near AS (
  SELECT a.place FROM d a JOIN (SELECT key, i, min(place) AS p FROM d GROUP BY key, i) b ON a.key = b.key AND a.i = b.i AND b.p < a.place
  UNION SELECT f.place FROM f JOIN d ON f.key = d.key AND d.place < f.place
  UNION SELECT d.place FROM f JOIN d ON f.key = d.key AND f.place < d.place),
k AS (SELECT place FROM u WHERE place NOT IN (SELECT place FROM near)),
s AS (
  SELECT w.doc_id, w.line, w.content, len(w.words) = 0 OR k.place IS NOT NULL AS stays
  FROM w LEFT JOIN k ON k.place = ROW(w.doc_id, w.line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
       sha256(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (stays), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS key FROM p),
r AS (SELECT doc_id, i FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS at FROM r),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM d),
g AS (
  SELECT w.doc_id, count(c.at) AS n_removed, string_agg(w.word, ' ' ORDER BY w.at) FILTER (c.at IS NULL) AS kept
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.at = w.at GROUP BY w.doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS item FROM benchmark),
dw AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM d),
bw AS (SELECT item_id, len(item) AS m, unnest(item) AS word, generate_subscripts(item, 1) - 1 AS q FROM b WHERE len(item) > 0),
same AS (SELECT doc_id, item_id, n, m, p - q AS shift, list(q) AS places, count(*) AS k FROM dw JOIN bw USING (word) GROUP BY ALL),
ok AS (
  SELECT doc_id, item_id, k FROM same
  WHERE m >= 12 AND k >= 11
    AND len(list_filter(range(m - 11), lambda s: shift + s >= 0 AND shift + s + 12 <= n AND len(list_filter(places, lambda x: x >= s AND x < s + 12)) >= 11)) > 0
  UNION ALL SELECT doc_id, item_id, k FROM same WHERE m < 12 AND k = m)
SELECT doc_id, item_id, max(k) AS overlap FROM ok GROUP BY doc_id, item_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scored(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
v AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::INTEGER) AS groups FROM h),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(groups, lambda x:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest
  FROM v)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY payload_digest)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_mixing": op2_mixing, "op3_ngram_join": op3_ngram_join, "op4_line_dedup": op4_line_dedup, "op5_substring_dedup": op5_substring_dedup, "op6_decontaminate": op6_decontaminate, "op7_token_counts": op7_token_counts, "op8_quality": op8_quality, "op9_suffix_tree_lm": op9_suffix_tree_lm, "op10_warc": op10_warc}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op3_ngram_join": OP3_SQL, "op4_line_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op6_decontaminate": OP6_SQL, "op10_warc": OP10_SQL}
