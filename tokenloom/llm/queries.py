"""The queries of this package: each applies one operator to its whole table; SQL stands beside those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import chat_format, conversation_repair, periodic_runs, quality_rules, spot_signatures, warc
from tokenloom.llm.best_fit import best_fit
from tokenloom.llm.bpe import encode_documents
from tokenloom.llm.common import table
from tokenloom.llm.jaccard_join import JaccardJoin
from tokenloom.llm.packing import pack, token_lengths
from tokenloom.llm.quality_classifier import score_quality
from tokenloom.llm.token_store import token_store
from tokenloom.llm.toxicity import score_toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules and the verdict by its group's thresholds."""
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as shards with Elias-Fano boundaries and read back."""
    return token_store(table(spark, sf_dir, "documents"), WORD_BPE, END_ID)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by links of 4-word shingle sets with a Jaccard similarity of 0.85 or more."""
    return JaccardJoin(table(spark, sf_dir, "documents"), width=4, percent=85).classes().select("doc_id", "n_shingles", "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one made of marks, formatted, written, read back and parsed."""
    return chat_format.formatted_and_read(table(spark, sf_dir, "conversations")).drop("escape_rounds")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of WARC archives, read back from them."""
    return warc.archives(table(spark, sf_dir, "pages")).drop("url")


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness and that of the next document."""
    return spot_signatures.compare_with_next(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by speculation and verification, and decoded."""
    return encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and slot."""
    return pack(token_lengths(table(spark, sf_dir, "documents"), WORD_BPE))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, one in ten of them with a looped tail."""
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4,096 tokens."""
    return best_fit(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_store, op3_ngram_jaccard_join, op4_chat_format, op5_warc, op6_spot_signatures, op7_toxicity, op8_quality_classifier, op9_bpe, op10_packing, op11_periodic_runs, op12_conversation_repair, op13_best_fit_packing)}

SQL: dict[str, str] = {"op1_quality_rules": quality_rules.SQL, "op4_chat_format": chat_format.SQL, "op5_warc": warc.SQL, "op11_periodic_runs": periodic_runs.SQL, "op12_conversation_repair": conversation_repair.SQL}
