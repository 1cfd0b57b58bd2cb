"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays,
benchmark passages go, personal data is masked, and the rest is packed.

Each stage takes what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``, whatever these are. In
every stage null and empty texts are documents without words, a null doc_id is
kept unless its text is judged, repeated rows are judged alike, an empty table
gives an empty one, and a text is held whole by the task that reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import decontaminate, near_dedup, packing, pii, toxicity
from packetloom.storage import materialize, table

#: Words of the near-duplicate stage's shingles; op7_near_dedup takes four.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a model trained on ``labels`` does not find toxic.

    Texts without words show nothing and stay. Without toxic, or without other,
    labelled documents nothing is toxic. The training sample is bounded
    (``toxicity.SAMPLE_ROWS`` of each class); every row is judged.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts alike by shingles of SHINGLE words: the one with the smallest doc_id.

    Texts without words, and rows without doc_id, are like no other and stay. All
    equal rows of a document that is kept stay. Of a doc_id with several texts
    those go for which another document stands.
    """
    return near_dedup.remove_near_duplicates(docs, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of any ``benchmark`` item; an item of fewer words than a window is one window.

    Texts and items without words hit nothing. Ties and repeats: a row's own text alone decides.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with identifiers in their texts, plain or disguised, replaced by their kind; n_chars is counted anew.

    A null text stays null. Where identifiers overlap the first one, then the longest, names the whole.
    """
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every row's token ids, with its sequence and place there.

    A null or empty text is its end id alone. Repeated rows, and rows without
    doc_id, are packed like others. Pieces of equal length are interchangeable; a hash ranks them.
    """
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: No SQL expresses these stages; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
