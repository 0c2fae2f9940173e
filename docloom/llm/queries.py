"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, lines, mixing, neardup, packing, quality, syncmers, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """Where the environment keeps the word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file(), 2048)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(_table(spark, sf_dir, "documents"), percent=80)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"), 100)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_experiment(_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85, k=5)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, and all documents, whose source stands for a host."""
    documents, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = langid.train(documents.select("text", "lang"))
    found = []
    for rows, is_markup in ((langid.page_rows(pages), True), (langid.document_rows(documents), False)):
        fused = langid.fuse(langid.text_evidence(rows, model, is_markup), model)
        found.append(fused.drop("declared", "suffix", "domain", "host"))
    return found[0].unionByName(found[1], allowMissingColumns=True)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    """Fitted to the labels outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels").where(quality.fold(F.col("doc_id")) != 2)
    documents = _table(spark, sf_dir, "documents")
    return quality.train(documents, labels.select("doc_id", F.col("quality").alias("label")))


#: Documents that score less are rejected.
QUALITY_LEAST = 0.7


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 2, F.lit(False))
    predicted = (F.col("score") >= QUALITY_LEAST).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    plan = mixing.range_sorted(plan, "position", "doc_id")
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_exact_topk": op4_exact_topk,
    "op5_syncmers": op5_syncmers,
    "op6_minhash": op6_minhash,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest)
        SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
          CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN f ON p.payload_digest = f.payload_digest""",
    "op4_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings),
        s AS (
          SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.x, r.x) AS BIGINT) AS score
          FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 5""",
    "op6_minhash": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION SELECT b AS a, a AS b FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b AS doc_id, r.c FROM r JOIN e ON e.a = r.doc_id),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
}
