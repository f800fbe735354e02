"""The registered queries of this subpackage, each over its whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from duespark.llm import fingerprints, lm_score, ngram_join, oracles, packing, prefix_trie, quality, quality_rules, secrets, sentencepiece_bpe, simhash, spelling, substring_dedup, warc

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_secret_scan(spark, sf_dir):
    found = secrets.scan(_read(spark, sf_dir, "documents"), secrets.train(spark))
    return found.filter("secret").select("doc_id", "start", "length", F.col("candidate").alias("secret"), "score")


def op3_lm_score(spark, sf_dir):
    return lm_score.score(_read(spark, sf_dir, "documents"), BYTE_BPE, lambda doc_id: quality.fold(doc_id, 7) == 2)


def op4_quality_classifier(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").filter(quality.fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "kept_in")


def op6_warc(spark, sf_dir):
    found = warc.checked_round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op7_packing(spark, sf_dir):
    pieces = packing.pack(_read(spark, sf_dir, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.round_trip(_read(spark, sf_dir, "documents"), PIECES)


def op9_fingerprints(spark, sf_dir):
    pairs = fingerprints.fingerprint_pairs(_read(spark, sf_dir, "documents"))
    text, like = fingerprints.as_text, fingerprints.likeness
    return pairs.select("doc_id", "n_chars", F.col("edited").alias("edited_sha256"), text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), like("fp", "edited_fp").alias("near_edited"), like("fp", "next_fp").alias("near_next"))


def op10_quality_rules(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    trusted = _read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.fit_and_judge(docs, trusted)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.nodes(_read(spark, sf_dir, "conversations"))


def op12_simhash(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_secret_scan": op2_secret_scan,
    "op3_lm_score": op3_lm_score,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {"op11_prefix_trie": oracles.PREFIX_TRIE, "op13_spelling_variants": oracles.SPELLING}
