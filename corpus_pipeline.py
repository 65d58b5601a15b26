"""A corpus from raw documents to training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``.

1. quality rules: documents that the learned decision list or the base rules reject go;
2. n-gram Jaccard join: of each class of near duplicates (five words, 0.8) the least id stays;
3. suffix-array dedup: 50-byte strings that a smaller id has are cut out; documents
   of which nothing is left go (a character of which a byte is cut goes whole);
4. benchmark decontamination: documents with a passage of a test item go;
5. packing: concatenated and cut into sequences of 1024 ids, which are returned.

Rows with a null id pass through the stages that decide by id. Rows of one id
share the decisions of stages 2 and 4; stage 3 cuts each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontamination, jaccard_join, packing, quality_rules, suffix_dedup
from marquee.llm.common import free

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept_rows(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one of the least id."""
    found = jaccard_join.classes(docs, words=5, percent=80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a document of a smaller id has."""
    kept, sha = (free(n, docs.columns) for n in ("kept_text", "text_sha256"))
    left = suffix_dedup.remove_repeats(docs, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias(sha), F.col("kept_text").alias(kept))
    left = left.dropDuplicates(["_id", sha]).withColumnRenamed("_id", free("_id", docs.columns))
    whole = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    out = docs.join(left, docs["doc_id"].eqNullSafe(left[left.columns[0]]) & (whole == left[sha]), "left").where(F.col(kept).isNull() | (F.col(kept) != ""))
    new = {"text": F.coalesce(kept, "text"), "n_chars": F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)}
    return out.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontamination.matches(docs, items).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_array_dedup", substrings),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
