"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return
the columns of documents. Stages are written as Parquet and read again.
"""

from mailspark.llm import exact_dedup, jaccard_join, language, packing, pii
from mailspark.llm.common import table, written
from mailspark.llm.queries import tokenizer_path

SHINGLE, SIMILARITY = 5, 80


def find_language(spark, docs, sf_dir):
    """Documents without a letter go, and those that no mixture of the learned languages explains."""
    return language.with_language(docs)


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents linked by their shingles of five words at 0.8 or more, directly or through others,
    the one with the smallest id stays."""
    return jaccard_join.representatives(docs, SHINGLE, SIMILARITY)


def mask_personal_data(spark, docs, sf_dir):
    """Personal data in the text becomes a placeholder."""
    return pii.redact(docs)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of the packed sequences, sources in the proportions of what was kept."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", find_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Language models, near duplicates and disguised personal data have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
