"""A corpus pipeline of the numbered operators: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept. All but the last return the
columns of documents. `run` writes each stage's rows as Parquet in the shared folder and reads them for the next.

Rows and values that are odd go through: a null text is an empty text to every stage and stays null; documents without
an id are kept and scored as others; repeated rows are rows of their own until near-dedup keeps one; an empty table gives
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clicklake.llm import decontamination, line_dedup, packing, simhash, toxicity
from clicklake.llm.common import Scratch, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator, trained on the table's labels, predicts to be toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; n_chars follows the text where the table has it."""
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, texts that a similarity of 0.8 or more of their five-word shingles links, the one with the least id stays."""
    return simhash.keep_one(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_unleaked(spark, docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of what is left: a row per piece, as the packing operator returns it."""
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: SQL cannot express SimHash, union-find and packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
