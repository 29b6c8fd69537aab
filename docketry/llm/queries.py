"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, codes, extraction, fingerprints, knn, language, lexical, lm, mixing, sharding, simhash, toxicity, warc
from docketry.llm.common import drop_folder, remainder, shared_folder, stable, table, vocabulary


def held_out(modulus: int, fold: int) -> Column:
    """The column held_out of the contracts. A row without an id is in no fold: not held out, nor learned from."""
    return F.coalesce(remainder("doc_id", modulus) == fold, F.lit(False)).alias("held_out")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & (remainder("doc_id", 5) != 0))
    return toxicity.learn(table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _digests(e: bpe.Encoded) -> tuple:
    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return e.n_tokens, hexed(e.ids_text), hexed(e.decoded)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"), _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.resolved(warc.captures(warc.read(spark, path, payloads=False).drop("payload")))
    drop_folder(spark, path)  # what was read from it is checkpointed
    of = lambda name: F.coalesce(f"original.{name}", f"response.{name}").alias(name)
    return found.select(
        F.col("metadata.page_id").alias("page_id"), of("payload_bytes"), of("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("original.page_id").alias("refers_to"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = language.learn(docs, remainder("doc_id", 3) != 1)
    found = language.identify(docs, content)
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score", "margin", "accepted")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scored.select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = fingerprints.with_next(docs.withColumn("s", fingerprints.sketch(F.col("text"))), ["text", "s"])
    made = seen.select("doc_id", "text", "s", F.col("next.s").alias("z"), fingerprints.edited(F.col("text"), F.col("next.text")).alias("e"))
    made = made.withColumn("t", fingerprints.sketch(F.col("e")))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("e"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("s")).alias("fingerprint"), fingerprints.as_text(F.col("t")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("s"), F.col("t")).alias("near_edited"), fingerprints.likeness(F.col("s"), F.col("z")).alias("near_next"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc_id", "place.size", "place.text_crc32", F.lit("bytes").alias("law"), "place.shard", "place.slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = codes.compress(table(spark, sf_dir, "embeddings"))
    rows = stable(made.select("vec_id", "label", "compressed.*"))
    return codes.with_sums(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_OP3 = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS stop,
         ([3.0, 1.0, 2.0]::DOUBLE[])[CAST((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM totals
), ranked AS (
  SELECT *, stop / weight AS reach,
         coalesce(sum(stop) OVER w, 0) AS stopped, coalesce(sum(weight) OVER w, 0) AS done,
         sum(source_size) OVER () * 1.5::DOUBLE AS share, sum(weight) OVER () AS weights
  FROM weighed WINDOW w AS (ORDER BY stop / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (share - stopped) / (weights - done) AS level FROM ranked
  WHERE (share - stopped) / (weights - done) <= reach ORDER BY reach, encode(source) ASC NULLS LAST LIMIT 1
), rates AS (
  SELECT source, source_size, least(stop, coalesce((SELECT level FROM level) * weight, stop)) AS target FROM ranked
), drawn AS (
  SELECT doc_id, sized.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken FROM drawn
"""

_ENTRIES_OP12 = """
{to} AS MATERIALIZED (
  SELECT p, j, list(z ORDER BY k) AS c FROM (
    SELECT b.p, b.j, k, CASE WHEN count(a.x) = 0 THEN any_value(b.c[k]) ELSE CAST((sum(a.x[k]) - ((sum(a.x[k]) % count(a.x)) + count(a.x)) % count(a.x)) // count(a.x) AS BIGINT) END AS z
    FROM {of} b CROSS JOIN LATERAL (SELECT unnest(range(1, len(b.c) + 1)) AS k) u LEFT JOIN {near} a ON a.p = b.p AND a.j = b.j GROUP BY b.p, b.j, k) GROUP BY p, j
)"""
_NEAR_OP12 = """
{to} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, min(d) AS d, arg_min(j, struct_pack(d := d, j := j)) AS j FROM (
    SELECT a.rid, a.p, a.x, b.j, list_sum([(a.x[k] - b.c[k]) * (a.x[k] - b.c[k]) for k in range(1, len(b.c) + 1)]) AS d FROM cut a JOIN {of} b ON a.p = b.p) GROUP BY rid, p
)"""
ORACLE_OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), cut AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept CROSS JOIN (SELECT range AS p FROM range(16))
), b0 AS MATERIALIZED (SELECT p, rid - 1 AS j, x AS c FROM cut WHERE rid <= 64),
{_NEAR_OP12.format(to="n0", of="b0")}, {_ENTRIES_OP12.format(to="b1", of="b0", near="n0")},
{_NEAR_OP12.format(to="n1", of="b1")}, {_ENTRIES_OP12.format(to="b2", of="b1", near="n1")},
{_NEAR_OP12.format(to="n2", of="b2")},
made AS (SELECT rid, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY rid),
told AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN made USING (rid) CROSS JOIN told
"""

_TERMS_OP13 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS_OP13} AS ts FROM documents),
s AS (SELECT doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM s),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_OP13}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id
), k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""

QUERIES = {"op1_simhash": op1_simhash, "op2_toxicity": op2_toxicity, "op3_knn": op3_knn, "op4_extraction": op4_extraction, "op5_bpe": op5_bpe, "op6_mixing": op6_mixing, "op7_warc": op7_warc, "op8_language": op8_language, "op9_lm": op9_lm, "op10_fingerprints": op10_fingerprints, "op11_sharding": op11_sharding, "op12_codes": op12_codes, "op13_lexical": op13_lexical}
ORACLES: dict[str, str] = {"op3_knn": ORACLE_OP3, "op6_mixing": ORACLE_OP6, "op12_codes": ORACLE_OP12, "op13_lexical": ORACLE_OP13}
