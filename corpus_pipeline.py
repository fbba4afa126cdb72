"""The corpus pipeline: from all documents to a mix of clean, distinct, uncontaminated and redacted ones.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it to the shared folder and reads it again
for the next stage, so a lost executor costs a part of one stage. All stages but the last return the columns of
documents. Rows are told apart by a key of their own, not by doc_id, which may be null or shared.

Defined cases, of all stages: documents with null or empty texts are clean, no near duplicates (of those with one id, one
stays, as rows of one id without words are copies of one document), not contaminated and have nothing to redact; they reach the mix with size 0. Null and shared ids are safe, as
rows have their own keys. A very long text is read whole by every stage. Repeated rows are near duplicates of each
other, so one stays; of ties the least doc_id, then the first row. An empty table of documents gives an empty mix, empty
labels keep all documents, an empty benchmark keeps all. Further columns of documents, whatever their names, pass
through all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import contaminated, find_contamination
from siltstone.llm.mixing import mix
from siltstone.llm.ngram_join import near_duplicates
from siltstone.llm.pii import fit, redact
from siltstone.llm.scratch import Scratch, table, without_ids
from siltstone.llm.toxicity import score_documents

#: Words of a shingle and percent of Jaccard similarity from which two documents are near duplicates.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return score_documents(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select("doc.*")


def keyed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The documents with a key of each row, written once so that every later read sees the same keys."""
    return scratch.keep(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("_row")), "keyed")


def by_row(rows: DataFrame) -> DataFrame:
    """What the operators read, with the row's key in place of the id."""
    return rows.select(F.col("_row").alias("doc_id"), "doc.text")


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of the rows whose key is not in ``gone`` (a table with a doc_id column that holds keys)."""
    return without_ids(rows.select("doc", F.col("_row").alias("doc_id")), gone).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, nulls last (of repeated rows, one)."""
    scratch = Scratch(spark)
    rows = keyed(scratch, docs)
    found = near_duplicates(by_row(rows), SHINGLE_WORDS, SIMILAR_PERCENT)
    found = scratch.keep(found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("group"), (F.col("n_shingles") == 0).alias("wordless")), "found")
    copies = found.where("_row != group").select("_row", "group")
    ids = rows.select("_row", F.col("doc.doc_id").cast("long").alias("doc_id"))
    members = copies.unionByName(copies.select(F.col("group").alias("_row"), "group").distinct()).join(ids, "_row").withColumn("same", F.lit(None).cast("long"))
    # Rows without words are no near duplicates; of those with one id, one stays.
    wordless = found.where("wordless").select("_row").join(ids, "_row").where("doc_id is not null").select("_row", F.lit(None).cast("long").alias("group"), "doc_id", F.col("doc_id").alias("same"))
    members = scratch.keep(members.unionByName(wordless), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))["_row"]
    stay = members.groupBy("group", "same").agg(first.alias("_row")).select("_row")
    return without_rows(rows, members.join(stay, "_row", "left_anti").select(F.col("_row").alias("doc_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands verbatim in the benchmark."""
    rows = keyed(Scratch(spark), docs)
    found = find_contamination(by_row(rows), table(spark, sf_dir, "benchmark"))
    return without_rows(rows, found.where(contaminated()).select("doc_id"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    out = redact(docs, fit(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
]

#: The first stage is a trained classifier, which SQL can't express; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with Scratch.owned():  # a stage's own tables go once its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
