"""The corpus pipeline: language, toxicity, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and gives a DataFrame. Its input
may hold nulls anywhere, empty texts, repeated rows, extra columns or no rows at all; what each operator does
with them stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelmill.llm import decontaminate, language, ngram_join, packing, rows, toxicity
from voxelmill.llm.queries import tokenizer_path
from voxelmill.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in none of the learned languages, by bounds calibrated on texts held
    back from the fit and on texts of left-out languages."""
    texts, langs = language.sample(docs)
    shared = spark.sparkContext.broadcast((language.train(texts, langs), language.calibrate(texts, langs)))

    def judge():
        model, known = shared.value
        tables = model.prepared()
        return lambda texts: known.judge(texts, language.predict(texts, model, tables)[0])

    return rows.keep_where(docs, judge)


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts scored 0.5 or more."""
    shared = spark.sparkContext.broadcast(toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

    def judge():
        scorer = toxicity.Scorer(shared.value)
        return lambda texts: (scorer.scores(texts) < 0.5).tolist()

    return rows.keep_where(docs, judge, max_bytes=2 << 20)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a benchmark item stands."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, at the corpus's own proportions of sources."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("toxicity", filter_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_tokens),
]

#: Learned models, shingle links and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
