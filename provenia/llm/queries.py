"""The queries of this subpackage for the driver: each applies its operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.llm.bpe import bpe_round_trip
from provenia.llm.chat import format_chats
from provenia.llm.common import read
from provenia.llm.exact_dedup import by_id, exact_dedup_in_batches, fresh_index
from provenia.llm.fingerprint import fingerprints
from provenia.llm.importance import resampled
from provenia.llm.jaccard import jaccard_classes
from provenia.llm.lm import score_texts
from provenia.llm.mixing import mix_order
from provenia.llm.packing import packed_documents
from provenia.llm.prefix_trie import prefix_trie
from provenia.llm.quality import fit_quality, quality_scores
from provenia.llm.secrets import scanned
from provenia.llm.substring_dedup import deduplicated, repeated_units

#: The vocabulary of op1_bpe and of the pipeline, a parameter of both.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The vocabulary of op13_packing, a parameter of it.
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Target weights of sources in op7_mixing; those not named have weight 1.
WEIGHTS = {"src0": 3, "src1": 0.5, "src2": "1/3"}
#: The conversation that the chat query adds: its texts are the template's own marks.
CONFLICT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), vocabulary, outputs=False)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(CONFLICT, "conv_id long, turn long, role string, text string"))
    chats = format_chats(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("escaped_turns").cast("long").alias("escaped_turns"), "identical")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, fit_quality(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_order(read(spark, sf_dir, "documents"), WEIGHTS)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two batches by id, of which the second meets in the index what the first left there."""
    index = fresh_index(spark, "op8-digests")
    out = exact_dedup_in_batches(by_id(read(spark, sf_dir, "documents")), index)
    index.drop()  # what the result needs of it is in tables of its own by now
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated clauses in runs of LEAST_WORDS words; op9_repeated_units has every later occurrence of a sentence."""
    return repeated_units(read(spark, sf_dir, "documents"))


def op9_cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without what op9_substring_dedup finds."""
    out = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a sentence, with the words of its run of repeated sentences."""
    return repeated_units(read(spark, sf_dir, "documents"), least_words=1, by="sentence")


def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a whole line, with the words of its run of repeated lines."""
    return repeated_units(read(spark, sf_dir, "documents"), least_words=1, by="line")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def op13_packing(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents"), vocabulary, outputs=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_jaccard": op2_jaccard,
    "op3_lm": op3_lm,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_fingerprint": op6_fingerprint,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op9_cut_texts": op9_cut_texts,
    "op9_repeated_units": op9_repeated_units,
    "op9_repeated_lines": op9_repeated_lines,
    "op10_secrets": op10_secrets,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance": op12_importance,
    "op13_packing": op13_packing,
}
