"""A corpus in five stages: what is good, said once, not nearly said before, in the target mix, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
``run`` writes each stage's result to the shared folder and reads it again.

Defined results of all stages: a null text counts as an empty one, which the classifier
scores like any other, which equals all empty ones, links with nothing, has no tokens
and is one piece in no bin. Rows with a null id stay until packing, but for exact
copies. Of equal rows one stays after exact_dedup; rows that share an id but not the
text are dropped together by near_dedup if a smaller id has a linked text, and are each
mixed and packed. Ties go to the smallest id. More columns pass through up to packing,
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm import exact_dedup, jaccard_groups, mixing, packing, quality, token_counts
from sparquill.llm.common import Workspace, fresh, scratch, table
from sparquill.llm.queries import ACCEPT, LEVELS, MAX_EPOCHS, METADATA, WEIGHTS, domain, vocabulary

VOCABULARY = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), METADATA)
    (score,) = fresh(docs.columns, "score")
    return quality.score(docs, model, METADATA, keep_text=True, out=score).where(F.col(score) >= ACCEPT).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.deduplicate(docs, Workspace(spark, "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that links of five-word shingles and similarity 0.8 join, the smallest id."""
    groups = jaccard_groups.similar_components(docs, Workspace(spark, "near"), words=5, percent=80)
    (out,) = fresh(docs.columns, "out")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(out)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(out), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mix, by tokens of the vocabulary; a document of a second epoch comes twice."""
    ws = Workspace(spark, "mix")
    counted = token_counts.token_counts(docs.select("doc_id", "lang", "source", "text"), vocabulary(VOCABULARY))
    sizes = ws.stage(counted.select("doc_id", domain(F.col("source")).alias("domain"), "lang", "source", "n_tokens", F.col("n_bytes").alias("bytes")), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    # rows that share an id meet their copies by their place and size, too
    chosen = mixing.mix(sizes, LEVELS, total, MAX_EPOCHS, WEIGHTS).groupBy("doc_id", "lang", "source", "bytes").agg(F.max("copies").alias("copies"))
    names = fresh(docs.columns, "id", "lang_", "source_", "bytes", "copies", "copy")
    chosen = chosen.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "lang", "source", "bytes", "copies"), names, strict=False)))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    meets = F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col("lang").eqNullSafe(F.col(names[1])) & F.col("source").eqNullSafe(F.col(names[2])) & (size == F.col(names[3]))
    got = docs.join(chosen, meets)
    return got.withColumn(names[5], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[4])))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths, of all documents of the mix, by tokens of the vocabulary."""
    counted = token_counts.token_counts(docs.select("doc_id", "text"), vocabulary(VOCABULARY))
    return packing.pack_documents(Workspace(spark, "pack").stage(counted.select("doc_id", "n_tokens"), "sizes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier and packing can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():
            docs = ws.stage(stage(spark, docs, sf_dir), name)
        if i:
            ws.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
