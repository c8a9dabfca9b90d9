"""Documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import documents as docs
from tidemark.operators.pruned import pruned_top_k
from tidemark.operators.vectors import top_k

from .base import query, table


@query(
    "doc_chunk",
    """SELECT doc_id, chunk_no, substring(text, (chunk_no * 400 + 1)::BIGINT, 500) AS chunk FROM
      (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 100) / 400.0), 1)::BIGINT)) AS chunk_no FROM documents WHERE length(text) > 0)""",
)
def doc_chunk(spark, sf_dir):
    pieces = docs.chunk(table(spark, sf_dir, "documents"), "text", 500, 100)
    return pieces.select("doc_id", "chunk_no", "chunk")


@query(
    "doc_new_only",
    """SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE '%/en/%')""",
)
def doc_new_only(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    indexed = pages.where(F.col("url").contains("/en/")).select("url")
    return docs.new_only(pages, indexed, "url").select("page_id", "url")


def _html_sql() -> str:
    text = "html"
    for pattern in (docs.COMMENTS, docs.BLOCKS, docs.TAGS):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    for entity, char in docs.ENTITIES.items():
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT page_id, trim(regexp_replace({text}, '{docs.BLANKS}', ' ', 'g')) AS text FROM pages"


@query("doc_html_text", _html_sql())
def doc_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", docs.html_text(F.col("html")).alias("text"))


MASKED = f"regexp_replace(text, '{docs.EMAIL}', 'john_doe@email.com', 'g')"
BARE = f"regexp_replace(text, '{docs.EMAIL}', ' ', 'g')"


@query(
    "doc_pii_mask",
    f"""SELECT doc_id, regexp_replace({MASKED}, '{docs.PHONE}', '123456789', 'g') AS text,
      len(regexp_extract_all(text, '{docs.EMAIL}'))::INT AS n_emails,
      len(regexp_extract_all({BARE}, '{docs.PHONE}'))::INT AS n_phones FROM documents""",
)
def doc_pii_mask(spark, sf_dir):
    return docs.mask_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


VEC_TOPK = """WITH c AS (SELECT label, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM
        (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
    SELECT label, vec_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT c.label, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score,
        row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id) AS rank
      FROM embeddings, c) WHERE rank <= 3"""


def _centroids(vectors):
    return (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("q"))
    )


@query("vec_topk", VEC_TOPK)
def vec_topk(spark, sf_dir):
    """Nearest vectors to the centroid of every label."""
    vectors = table(spark, sf_dir, "embeddings")
    found = top_k(vectors, _centroids(vectors), "vec_id", "embedding", "label", "q", 3)
    return found.withColumn("score", F.round("score", 6))


@query("vec_topk_pruned", VEC_TOPK)
def vec_topk_pruned(spark, sf_dir):
    """The same from tiles around pivots; tiles too far from a centroid are not read."""
    vectors = table(spark, sf_dir, "embeddings")
    found = pruned_top_k(vectors, _centroids(vectors), "vec_id", "embedding", "label", "q", 3)
    return found.withColumn("score", F.round("score", 6))
