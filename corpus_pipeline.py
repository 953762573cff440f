"""A training corpus in five stages, each a corpus operator whose decisions take effect on documents.

All stages: rows are told apart as rows, so null and repeated ids lose none; columns beyond documents' own, of any name but row,
travel along until the last stage; an empty table gives an empty one; a text of any length is taken whole. Null and
empty texts, which have no language, go in the first stage; the others keep them. Ties: of near copies with the same
least id, the one whose row hash is least stays; secrets and items are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language_id, secret_scan, sentencepiece_lattice
from lectern.llm.common import Tables, release, release_executors, table
from lectern.llm.decontamination import contaminated
from lectern.llm.jaccard_join import jaccard_components
from lectern.llm.queries import MODEL_FILE


#: Below this posterior a language is not taken as told.
LEAST_SCORE = 0.5


def fresh(stage: Callable) -> Callable:
    """The stage, begun with a driver and executors that hold nothing of the stages before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        release_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@fresh
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told (no text, none with a letter, or a score below LEAST_SCORE); lang becomes what was told."""
    model = language_id.learn(docs)
    release(spark)
    told = language_id.annotate(docs, model)
    told = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a 64-bit hash of each whole row, by which rows are told apart: ids may be null or repeat."""
    return docs.withColumn("row", F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)))


@fresh
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8) the row of least id stays, one without an id only if none has one.

    Rows that are equal in all columns count as one.
    """
    rows = keyed(docs)
    groups = jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = groups.distinct().join(rows.select("row", "doc_id").distinct(), "row").groupBy("component_id").agg(first.alias("m")).select("m.row")
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(docs.columns)


@fresh
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that hold a copy of a benchmark item."""
    rows = keyed(docs)
    found = contaminated(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(found, "row", "left_anti").select(docs.columns)


@fresh
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced by a mark; all documents stay."""
    words = secret_scan.dictionary(docs)
    release(spark)
    forest = secret_scan.train(secret_scan.labelled_findings(spark), words)
    release(spark)
    out = secret_scan.redact(docs, forest)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


#: Smaller buckets than the operator's own, since the rows carry all ids.
TOKEN_BUCKET = 6 << 20


@fresh
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids."""
    return sentencepiece_lattice.encode(docs, MODEL_FILE, keys=("doc_id", "lang", "source"), bucket_bytes=TOKEN_BUCKET)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]

#: Similarity groups, alignment and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again by the next."""
    tables, docs, before = Tables(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        others = list(Tables.made)
        docs = tables.keep(stage(spark, docs, sf_dir), name)
        # Nothing reads the operator's own tables any more, nor the stage before.
        for made in [t for t in Tables.made if t not in others]:
            made.drop_all()
        tables.drop([before] if before else [])
        before = name
    return docs
