"""The corpus pipeline: its stages in order, and run(), which applies them to documents.

Every stage takes what the one before kept. All but the last return the columns of documents;
the last returns the digests of every document's tokens, a document that the mix takes twice
having two rows.
"""

from __future__ import annotations

from tracespark.llm import common, op1_exact_dedup, op2_language_id, op4_jaccard_join, op5_mixing, op10_bpe


def language(spark, docs, sf_dir):
    """Documents with a language; texts without a letter go."""
    model = op2_language_id.fit(docs.filter(op2_language_id.split("doc_id", 4) != 2))
    return op2_language_id.predict(docs, model).filter(f"lang_pred != '{op2_language_id.UND}'").select("row.*")


def exact(spark, docs, sf_dir):
    """One of all documents with equal texts."""
    return op1_exact_dedup.exact_dedup(docs).filter("kept").select("row.*")


def near(spark, docs, sf_dir):
    """One of each group of near duplicates."""
    return op4_jaccard_join.one_of_each(docs)


def mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    return op5_mixing.mixed(docs)


def tokens(spark, docs, sf_dir):
    """Digests of the tokens and of the text decoded from them."""
    return op10_bpe.digests(docs, *op10_bpe.public_vocabulary())


STAGES = [("language", language), ("exact_dedup", exact), ("near_duplicates", near), ("mixing", mix), ("tokens", tokens)]
#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:  # stages read their input more than once
        docs = common.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
