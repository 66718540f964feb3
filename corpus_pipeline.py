"""Documents into packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.common import remainder
from pricelens.llm.decontamination import clean
from pricelens.llm.language import in_known_language
from pricelens.llm.packing import pack
from pricelens.llm.secrets import mask_secrets
from pricelens.llm.simhash import first_of_groups
from pricelens.session import shared_folder
from pricelens.sources.observations import table

#: Columns of documents, and what listings call them.
NAMES = {"doc_id": "obs_id", "text": "description", "lang": "language"}
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _listings(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT).withColumnsRenamed(NAMES)


def _documents(listings: DataFrame) -> DataFrame:
    return listings.withColumnsRenamed({v: k for k, v in NAMES.items()}).select(*DOCUMENT)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return _documents(in_known_language(_listings(docs), remainder(F.col("obs_id")) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _documents(first_of_groups(_listings(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage makes up a twentieth of."""
    return _documents(clean(_listings(docs), table(spark, sf_dir, "benchmark").select("item_id", "text")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths those of the new texts."""
    masked = _documents(mask_secrets(_listings(docs)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return pack(_listings(docs)).drop("ids").withColumnRenamed("obs_id", "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: No SQL can train the models or tokenize; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if folder:
            old = spark._jvm.org.apache.hadoop.fs.Path(folder)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        docs, folder = spark.read.parquet(out), out
    return STAGES[-1][1](spark, docs, sf_dir)
