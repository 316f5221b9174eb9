"""From raw documents to a training mix: five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result and rereads it as the
next stage's ``docs``. All stages but the last return the columns of ``documents``.

Rows with null ids, null or empty texts, and repeated rows go through as the operators define; an empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, jaccard, mixing, pii, quality
from waymark.llm.textops import documents, staged, without


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, documents(spark, sf_dir, "labels"))
    return quality.scored(docs, model, "__score").filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least id."""
    return jaccard.without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, and no others: a row is named by its id and its text, as ids may
    be null or repeated."""
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.col("text")))
    pairs = decontaminate.contaminated(docs, documents(spark, sf_dir, "benchmark"), key=row)
    gone = staged(pairs.select("doc_id").distinct(), "contaminated")
    return without(docs.withColumn("__row", row), "__row", gone).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; ``n_chars`` follows the text."""
    out = pii.mask(docs, pii.train(pii.labelled_table(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mix of domains, languages and sources; ``mix_epochs`` tells how often a row is read."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]

# The classifiers of the first and fourth stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
