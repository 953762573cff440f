"""Idempotent loads, validation gates, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text


def plan_load(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, sha256, outcome): skipped where the manifest has the file with this checksum, else updated or added."""
    known = manifest.select("file", F.col("sha256").alias("old"))
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("sha256"), "skipped").otherwise("updated")
    return found.select("file", "sha256").join(known, "file", "left").select("file", "sha256", outcome.alias("outcome"))


def outcomes(planned: DataFrame, loaded: DataFrame) -> DataFrame:
    """planned with failed for files that were to be read and gave no rows."""
    some = loaded.select("file").distinct().withColumn("read", F.lit(True))
    failed = (F.col("outcome") != "skipped") & F.col("read").isNull()
    return planned.join(some, "file", "left").select("file", "sha256", F.when(failed, "failed").otherwise(F.col("outcome")).alias("outcome"))


class ValidationError(ValueError):
    """Names every problem that was found."""


def require(checks: dict[str, DataFrame], shown: int = 20) -> None:
    """Raises an error that lists the rows of every check that has any; checks are queries for violations."""
    problems = []
    for name, rows in checks.items():
        found = rows.limit(shown + 1).collect()
        problems += [f"{name}: {r.asDict()}" for r in found[:shown]]
        if len(found) > shown:
            problems.append(f"{name}: and more")
    if problems:
        raise ValidationError("\n".join(problems))


def only_if_empty(df: DataFrame, path: str) -> bool:
    """Writes df under path unless a table is there already; tells whether it wrote."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place) and fs.listStatus(place):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def publish(df: DataFrame, path: str) -> None:
    """Writes df beside path and then swaps it in, so that readers see the old table or the new one."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged, place, old = hadoop(f"{path}.staged"), hadoop(path), hadoop(f"{path}.old")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.staged")
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(staged, place)
    fs.delete(old, True)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A copy of all tables under path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def export_markdown(notes: DataFrame, path: str) -> None:
    """Notes (title, body as HTML) as Markdown text, a heading and a paragraph each."""
    notes.select(F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), html_text(F.col("body")), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def export_html(rows: DataFrame, path: str) -> None:
    """Rows (title, body) as HTML documents, one line each."""
    rows.select(F.concat(F.lit("<article><h1>"), "title", F.lit("</h1>"), F.regexp_replace("body", r"\s+", " "), F.lit("</article>")).alias("value")).write.mode("overwrite").text(path)
