"""A corpus pipeline of the training-data operators; each stage works on all that the one before kept.

Quality classifier (rejected documents go), n-gram Jaccard join (one document of each group of
near duplicates stays), substring dedup (repeated paragraphs go), secret scan (secrets are
masked), packing (pieces of fixed sequences). All but the last return the columns of documents;
n_chars is counted anew where the text changes.
"""

from pyspark.sql import functions as F

from duespark.llm import ngram_join, packing, quality, secrets, substring_dedup
from duespark.llm.queries import BYTE_BPE
from duespark.llm.scratch import broadcast_if, write_table

#: Ids and digests of dropped documents up to this number are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark, docs, sf_dir):
    """Keeps documents of a score of 0.7 or more; trained on the labelled documents of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    fitted = quality.train(docs, labels)
    scored = quality.score_rows(docs, fitted)
    return scored.filter("score >= 0.7").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one row of each class of near duplicates: of its least id (null if it has no other) the text of the least digest.

    Equal ids with different texts are documents of their own; of rows alike in id and text, one stays.
    """
    classes = write_table(ngram_join.near_duplicates(docs), "classes")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    gone = classes.filter(~first).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    gone = broadcast_if(write_table(gone, "gone"), BROADCAST_IDS)
    keyed = docs.select(*COLUMNS, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti")
    # Only repeated ids make the texts worth a shuffle.
    repeated = classes.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "digest"])).select(*COLUMNS)


def repeated_passages(spark, docs, sf_dir):
    """Removes paragraphs of which an earlier document has one like it."""
    cut = substring_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def secret_scan(spark, docs, sf_dir):
    """Masks secrets; all documents stay."""
    masked = secrets.redact(docs, secrets.train(spark))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """Pieces of sequences of 2048 ids."""
    pieces = packing.pack(docs, BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scan", secret_scan),
    ("packing", pack),
]
#: Models, MinHash and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of sf_dir's documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, name.replace(" ", "-"))
    return docs
