"""A corpus pipeline over ``documents``: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm import ngram_join, packing, pii, quality
from shortlist.llm.storage import new_folder

TOKENIZER, END_ID = "word_bpe_49k.json", 2


def free_name(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep.

    A null text has no words and goes; a null ``lang`` is a stratum of its own; a score
    equal to its cutoff stays. Repeated rows are judged alike. Other columns stay as
    they are, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "lang", "text", F.struct(*docs.columns).alias("whole_row"))
    measured = quality.store(quality.with_measures(rows, ["lang"]).drop("lang", "text"))
    judged = quality.judge(measured, *quality.fit_cutoffs(measured, labels))
    return judged.where("kept").select("whole_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that with the least ``doc_id`` and text hash, or any of equal rows.

    Rows without a ``doc_id`` belong to no class and stay.
    """
    firsts = ngram_join.firsts(docs).select(F.col("doc_id").alias("first"), F.col("text_hash").alias("first_hash"))
    mark = free_name(docs, "text_hash")
    rows = docs.withColumn(mark, ngram_join.text_hash(F.col("text")))
    firsts = firsts.toDF(free_name(rows, "first"), free_name(rows, "first_hash"))
    mine = (rows["doc_id"] == firsts[firsts.columns[0]]) & (rows[mark] == firsts[firsts.columns[1]])
    kept = rows.join(firsts, mine, "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; null texts stay null."""
    found = pii.personal_data(F.col("text"), pii.fit(docs), with_text=True)["redacted"]
    name = free_name(docs, "redacted")
    text = F.when(F.col("text").isNotNull(), F.col(name))
    clean = docs.withColumn(name, found).withColumn("text", text)
    clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences.

    Null texts are empty ones (their end id only); a null ``doc_id`` stays null; rows
    that repeat a document are packed each; other columns are ignored.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]
# Min-hashes, tokens and the curve have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        folder = new_folder(spark, "stage")
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
