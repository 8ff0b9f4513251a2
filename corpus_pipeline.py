"""The cleaning pipeline over `documents`: five stages, each a whole operator.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame with the columns of `documents`; the last adds shard and
slot.  ``run`` writes each stage's result as Parquet under the shared folder
and reads it back as the next one's input.  SQL cannot express the nearest
neighbour, join and tiling stages, so ORACLE_SQL is None and the stages are
tested against brute force.
"""

from lexmetric.llm import hilbert, jaccard, mixing, tiling, toxicity
from lexmetric.llm.common import ready, table
from lexmetric.session import shared_dir


def drop_toxic(spark, docs, sf_dir):
    """Documents scored toxic go (operator 8)."""
    ready(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays (operator 10): five-word
    shingles, Jaccard of 0.8 or more."""
    ready(spark)
    return jaccard.keep_first(docs, k=5, num=80, den=100)


def drop_benchmark_copies(spark, docs, sf_dir):
    """Documents that contain a benchmark passage go (operator 7)."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Documents as often as their source's target asks (operator 5)."""
    ready(spark)
    return mixing.mixed_rows(docs)


def shard(spark, docs, sf_dir):
    """Rows with shard and slot along the Hilbert curve (operator 9)."""
    ready(spark)
    return hilbert.shard_rows(docs, shards=16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, in order, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
