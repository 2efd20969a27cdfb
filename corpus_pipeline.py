"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Toxic documents go; later copies of repeated line runs are cut; of near-duplicates one stays; documents contaminated
by the benchmark go; and the rest is mixed to the sources' target weights. Every stage works on all that the one
before kept, at the settings of the operators' own queries. Near-duplicates are what ``op9`` links, 2 bits apart or less, and
besides that what has a Jaccard similarity of 0.8 or more in 5-word shingles. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import ftrl_toxicity, line_dedup, pareto_mix, positional_index, shingle_pairs, simhash_variants
from marginalia.llm.common import read
from marginalia.plans.storage import materialize, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The fit sees the labelled rows of the ``documents`` and ``labels`` tables."""
    model = ftrl_toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return ftrl_toxicity.keep_clean(docs.select(*COLUMNS), model, 0.5)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines (50 words or more) leave the texts; every document stays."""
    return line_dedup.deduplicated(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that ``op9``'s fingerprints link, or a Jaccard similarity of 0.8 or more (5-word shingles), the one of
    the smallest id stays; a component may have links of both."""
    docs = docs.select(*COLUMNS)
    return shingle_pairs.near_duplicates(docs, simhash_variants.grouped(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in benchmark windows go."""
    return positional_index.keep_uncontaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes at least once, with ``size`` in words and the number of ``copies``."""
    return pareto_mix.mix(docs.select(*COLUMNS)).filter(F.col("copies") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity model, the sketches' components and the hashes of documents can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on; every result but the last is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # a stage's own tables go as soon as its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
