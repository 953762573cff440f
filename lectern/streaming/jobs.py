"""Structured Streaming forms of the jobs that follow a log: extensions of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.references import citations
from ..functions.text import tokens

CITATIONS = "doc_id long, label string, occurrence int, context string, book int, chapter int, verse_start int, verse_end int"


def daily_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """(day, kind, n): events of each day, closed once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), kind, "n")


def append_postings(path: str):
    """A foreachBatch sink that adds each batch's postings (token, doc_id, tf, positions) under path; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        each = batch.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
        postings = each.groupBy("token", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
        postings.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def cited(documents: DataFrame) -> DataFrame:
    """The citations of each document (doc_id, text); works on streams and tables alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, name, n, context, *ref) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if t for name, n, context, ref in citations(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CITATIONS.split(", ")]).astype({"verse_start": "Int64", "verse_end": "Int64"})

    return documents.select("doc_id", "text").mapInPandas(run, CITATIONS)
