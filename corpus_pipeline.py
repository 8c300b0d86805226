"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept, written as
Parquet and read again. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from ragweave.llm import linededup, mixing, neardup, pieces, quality
from ragweave.llm.common import Tables, opened, release, table


def quality_rules(spark, docs, sf_dir):
    """Documents that fail a base rule or the outlier test go."""
    return quality.keep_quality(docs)


def line_dedup(spark, docs, sf_dir):
    """Lines that an earlier line equals or nearly equals go, and documents left without a word."""
    return linededup.dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate class stays."""
    return neardup.dedup(docs)


def mix_sources(spark, docs, sf_dir):
    """Each source has as many words as its target: documents repeat or go, whole."""
    return mixing.mix_documents(docs)


def encode(spark, docs, sf_dir):
    """The mixed documents' ids, as digests, beside the columns that identify them."""
    out = pieces.encode_documents(docs)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Covariance estimates and link closure iterate over whole tables, which SQL can't express;
#: tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the table ``documents``.

    What a stage wrote for itself, and the rows it read, are deleted once its own rows are written.
    """
    tables = Tables(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        mark = opened()
        docs = tables.write(stage(spark, docs, sf_dir))
        release(spark, mark)
        tables.keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
