"""A corpus pipeline of five operators: each stage is judged on what the one before it kept.

Language ID drops documents whose language it rejects; line dedup removes repeated and near-repeated lines; MinHash keeps
one document of each group of near copies; substring dedup removes repeated passages; packing lays the rest into sequences.
Rows that share a doc_id, or have none, are documents of their own; a row goes only where a stage finds it rejected or a copy.

A stage's result must be written before the next stage is called, as run() does: each stage first deletes what the ones before it left in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, langid, line_dedup, minhash, packing, suffix_dedup
from tessera.llm.queries import vocabulary


#: How many tables had been written when the first stage, or the first one that was called, began.
_BEGAN: list[int] = []


def _begin(spark: SparkSession, first: bool = False) -> None:
    """Deletes what the stages since the first have left; tables of other queries stay."""
    if first or not _BEGAN:
        _BEGAN[:] = [common.written()]
    common.discard_since(spark, _BEGAN[0])


def _shortened(docs: DataFrame, rows: DataFrame, text: str, removed) -> DataFrame:
    """The columns of docs from rows; where `removed` holds, text is that column and n_chars, if there is one, its length."""
    changed = {"text": F.when(removed, F.col(text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(removed, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is accepted; the model is trained on these documents' labelled rows."""
    _begin(spark, True)
    return langid.accepted_rows(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before; those that lose none are unchanged, those that lose all stay with an empty text."""
    _begin(spark)
    found = common.free_name(docs, "lines")
    rows = line_dedup.rewrite_lines(docs, found)
    return _shortened(docs, rows, f"{found}.kept_text", F.col(f"{found}.n_removed") > 0)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies."""
    _begin(spark)
    key = common.free_name(docs, "row_key")
    keyed = common.row_keys(docs, key)
    mark = common.written()
    found = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    lost = common.materialize(found.filter("not kept").select(F.coalesce("doc_id", F.lit(common.LEAST_LONG)).alias(key)), "lost")
    common.discard_since(spark, mark, lost)
    return common.without(keyed, lost, key).select(docs.columns)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that start earlier too; those that lose none are unchanged."""
    _begin(spark)
    rows = suffix_dedup.rewrite_repeats(docs)
    return _shortened(docs, rows, "text", F.col(rows.columns[-1]) > 0)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    _begin(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), length=4096, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("substring_dedup", dedup_passages),
    ("packing", pack_documents),
]

#: Models, hashes and a tokenizer are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
