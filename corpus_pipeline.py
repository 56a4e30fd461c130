"""A corpus from raw documents to token ids: reject, deduplicate, mix, encode."""

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.llm.bpe import bpe_round_trip
from provenia.llm.common import free_name, read, stage, with_position, with_written_position
from provenia.llm.exact_dedup import by_id, drop_exact_copies, fresh_index, normalised
from provenia.llm.jaccard import jaccard_classes
from provenia.llm.mixing import mixed
from provenia.llm.quality import fit_quality, quality_scores

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among docs.

    Null text counts as empty text. Rows with null or repeated ids are judged each by its own text. Without labels of both kinds all stay.
    """
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    accepted = free_name(docs, "quality_accepted")
    return quality_scores(docs, model, names=("quality_score", accepted, "quality_held_out")).filter(F.col(accepted) == 1).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest id, nulls last; of rows with the same id the first. Null text is empty text, and empty texts are equal."""
    index = fresh_index(spark, "pipeline-digests")
    # two batches by id: the second meets in the index what the first left there
    kept = [drop_exact_copies(part, index, batch=str(i)) for i, part in enumerate(by_id(docs))]
    index.drop()
    return reduce(DataFrame.unionByName, kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id, null last; of rows with the same id that of the least digest.

    Texts move only if some doc_id is null or not unique: then rows go by their places in that order.
    """
    if docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        lost = jaccard_classes(docs).filter("doc_id <> component_id").select("doc_id")
        return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
    place = free_name(docs, "near_place")
    rows = with_position(docs, [F.asc_nulls_last("doc_id"), F.sha2(normalised(F.col("text")), 256)], place)
    lost = jaccard_classes(rows, id_col=place).filter("doc_id <> component_id").select(F.col("doc_id").alias(place))
    return rows.join(lost, place, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in an order in which each source has the same weight; a null source is a source, null and repeated ids are rows of their own."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their digest and that of the text decoded from them, and its position in the mix: docs is the mix as written.

    Null text is empty text and has no ids; null and repeated ids stay. Columns of docs other than doc_id and text are not read.
    """
    return bpe_round_trip(with_written_position(docs), VOCABULARY, decoded=False, keep=("position",))


STAGES = [("quality", quality), ("exact dedup", exact), ("near duplicates", near), ("mix", mix), ("encode", encode)]
#: The first stage learns from rows and the third walks trees; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
