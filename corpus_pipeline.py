"""Five stages from raw documents to shards; each is an operator of boardflow.llm at work on what the one before kept.

All stages read every text whole, very long ones too, look at other columns only to hand them on, and give no rows for
an empty table. A stage that joins its decisions to the rows does so by doc_id where ids are all there and differ, else
by a number that it gives to each row; so rows without an id and repeated rows are rows as others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardflow.llm import decontaminate, jaccard_join, mixing, quality, sharding
from boardflow.plans.staging import scratch, staged


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a column that is never null and differs from row to row, and its name.

    That is doc_id, if it will do. Otherwise rows are numbered, and written with their numbers, so that these don't
    change when a task is run again.
    """
    if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte"):
        if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
            return docs, "doc_id"
    key = _fresh(docs, "row")
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _without(docs: DataFrame, gone: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows whose key isn't among those of ``gone``, dealt by it at every size."""
    return docs.join(staged(gone, "gone").hint("merge"), key, "left_anti").select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: score of 0.3 or more.

    Null and empty texts, which have no features, are scored by the bias alone. Repeated rows are scored alike, and so
    all stay or all go. Without labels of both classes a score is the share of ones. A score of just 0.3 stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, quality.remainder("doc_id", 5) != 0)
    name = _fresh(docs, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.3).select(*docs.columns)


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles.

    The one with the smallest id stays; where rows had to be numbered, the first. So of a repeated row one stays.
    Null and empty texts and texts without words are alone, and all stay.
    """
    rows, key = _keyed(docs)
    groups = jaccard_join.jaccard_join(rows, n=5, num=80, den=100, id_col=key)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key))
    return _without(rows, gone, key, docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark windows.

    Just a twentieth is enough to go. Null and empty texts have no words and stay. Repeated rows stay or go together.
    """
    rows, key = _keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(rows.select(F.col(key).alias("doc_id"), "text"), items, rare=0)
    return _without(rows, found.where("contaminated").select(F.col("doc_id").alias(key)), key, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it: not at all, once, or several times; documents are taken whole.

    Null, empty and blank texts have no words that a target could ask for, and are left out. A null source is a source.
    Repeated rows are rows of their own, and take their turns by their place.
    """
    rows, key = _keyed(docs)
    mixed = mixing.mix(rows, whole=True, id_col=key).where("taken > 0")
    times, nth = _fresh(rows, "times"), _fresh(rows, "nth")
    taken = staged(mixed.select(F.col("doc_id").alias(key), (F.col("taken") / F.col("size")).cast("int").alias(times)), "taken")
    return rows.join(taken.hint("merge"), key).withColumn(nth, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near equal bytes, equal texts together.

    Null texts are with empty ones. Repeated rows are rows of their own, in one shard; rows without an id keep none.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_first_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: SQL can't express the classifier: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again as the next one's documents.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns: as each stage says.
    """
    base = scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}")
    return docs
