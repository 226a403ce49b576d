"""A cleaning pipeline over ``documents``: each stage calls one operator of ravelin.llm and works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import ready, table, written
from ravelin.llm.packing import pack
from ravelin.llm.quality_crf import score_quality
from ravelin.llm.queries import WORD_BPE, tokenizer
from ravelin.llm.simhash_trees import similar_texts
from ravelin.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good ones.

    Null and empty texts are scored as one empty line; repeated rows and rows that share an id are kept or dropped each by its own text; a null id takes no part in the
    training and is scored like any other; very long texts are read whole. A score of exactly the threshold stays. Columns beyond those of documents are left out; an empty table
    stays empty.
    """
    scored = score_quality(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies, once; a group without ids keeps one of its texts.

    Near copies share 0.8 or more of their five-word shingles. Of different texts that share the least id of a group one stays; an id
    whose texts lead several groups keeps each of them. Null and empty texts are one group; repeated rows stay once; very long texts are compared whole; columns
    beyond those of documents are left out; an empty table stays empty.
    """
    ready(spark)
    heads = similar_texts(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("id"), F.col("head.key").alias("key"))
    same = docs.doc_id.eqNullSafe(heads.id) & (F.xxhash64(F.coalesce(docs.text, F.lit(""))) == heads.key)
    kept = docs.join(heads, same, "left_semi").select(*COLUMNS, F.coalesce("text", F.lit("")).alias("same"))
    return kept.dropDuplicates(["doc_id", "same"]).drop("same")  # a null text repeats an empty one


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that occur earlier; n_chars is the new length.

    A null text becomes the empty text; a document that is all repeat stays with an empty one. Rows equal in id and text share their result; of equal passages the one
    in the smallest id stays, null ids last. Very long texts are read whole; columns beyond those of documents are left out; an empty table stays empty.
    """
    cut = remove_repeats(docs, carry=("lang", "source"), with_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, a row for each piece of a document.

    A null or empty text is its end id; repeated rows are packed each; a null id stays null; a long text becomes several pieces; other columns are left out; an
    empty table gives no rows.
    """
    return pack(docs, tokenizer(WORD_BPE))


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))  # as Parquet, so that no later read runs a stage again
    return STAGES[-1][1](spark, docs, sf_dir)
