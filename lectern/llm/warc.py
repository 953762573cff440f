"""Operator 4: WARC archives, written and read in parallel, with boundary-chain verification.

Archives are plain text files, so a reader may start anywhere: it cuts its split at every magic
(``WARC/1.``), also at those inside payloads. Each piece is a candidate record that names its successor:
its own offset plus its header, its declared length and the end mark. Pointer jumping over these
edges from the start of the file (the reachable set doubles in each step) keeps the true records; a
header that a magic cuts (in a URL, say) goes on to the first blank line of the pieces that follow; a magic inside a payload is not reachable, however well formed it looks. Only offsets are
gathered by file, 16 bytes a record. Files in which every piece is as long as it declares need no
more; the pieces of other files are read once more with their bytes, and those between two reachable
offsets are put together again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables

MAGIC, END = "WARC/1.", "\r\n\r\n"
LEAST = 1000
_URN = "urn:lectern:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def write_warc(pages: DataFrame, path: str, tables: Tables, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, html) to text files under path.

    Of rows with equal payloads of ``least`` bytes or more those with the largest page_id become
    responses and the others revisits of it; all others are responses. A null html is an empty payload,
    a null url is left out of the header, line breaks in it are percent-encoded; a null page_id is
    never revisited.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    large = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    small = rows.select("page_id", "digest", "bytes").join(large.drop("n"), ["digest", "bytes"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    # Only the revisits, from a table whose size is known: small ones are broadcast, others joined by a shuffle.
    revisits = tables.keep(small, "revisits")
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    named = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.when(revisit, F.lit(_HTTP + END)).otherwise(F.concat(F.lit(_HTTP + END), "payload"))
    record = F.concat(
        F.lit(f"{MAGIC}0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        named("WARC-Record-ID", urn("page_id")), F.coalesce(named("WARC-Target-URI", url), F.lit("")), named("WARC-Date", F.lit(date)),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(named("WARC-Profile", F.lit(_PROFILE)), named("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        named("Content-Type", F.lit("application/http;msgtype=response")), named("Content-Length", F.octet_length("block").cast("string")), F.lit(END), "block",
    )
    rows.withColumn("block", block).select(record.alias("value")).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", 1_000_000).text(path)


def _field(name: str, pattern: str = r"([^\r\n]*)") -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?i)\r\n{name}:[ \t]*{pattern}", 1), F.lit(""))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Header fields, the payload's size and digest, and whether a piece (the bytes after a magic) is as long as it declares."""
    out = pieces.withColumn("header", F.substring_index("value", END, 1))
    out = out.withColumns({"bytes": F.octet_length("value").cast("long"), "length": _field("Content-Length", r"(\d{1,15})[ \t]*(?=$|\r\n)").cast("long")})
    # Null where a magic in the header's free text cut it before its end.
    out = out.withColumn("head", F.expr(f"if(instr(value, '{END}') > 0, octet_length(header), null)".replace("\r", "\\r").replace("\n", "\\n")).cast("long"))
    out = out.withColumn("whole", F.coalesce((F.col("head") + 8 + F.col("length") == F.col("bytes")) & F.col("value").endswith(END), F.lit(False)))
    out = out.withColumn("block", F.expr("substring(value, length(header) + 5, length(value) - length(header) - 8)"))
    out = out.withColumn("payload", F.expr(f"if(instr(block, '{END}') > 0, substring(block, instr(block, '{END}') + 4), '')".replace("\r", "\\r").replace("\n", "\\n")))
    page = lambda c: F.regexp_extract(c, rf"{_URN}(-?\d+)", 1).try_cast("long")
    return out.withColumns({
        "type": F.lower(_field("WARC-Type")), "page_id": page(_field("WARC-Record-ID")), "refers_to": page(_field("WARC-Refers-To")), "url": _field("WARC-Target-URI"),
        "stated": F.regexp_extract(_field("WARC-Payload-Digest"), r"sha1:(\w+)", 1), "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"),
    }).drop("block", "header")


_FIELDS = ["type", "page_id", "refers_to", "url", "stated", "payload_bytes", "payload_digest"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics, with the place of each in its file: the split's start and its order inside."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value")


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one file that belong to records reachable from its start, each with its record's offset."""
    pdf = pdf.sort_values(["split", "nth"], kind="stable")
    size = pdf["bytes"].to_numpy(np.int64)
    # A piece's offset is that of the magic before it; what precedes the first magic is no record.
    ends = np.cumsum(size + len(MAGIC)) - len(MAGIC)
    offsets = np.concatenate([[-len(MAGIC)], ends[:-1]])
    n = len(offsets)
    out = pd.DataFrame({"file": pdf["file"], "split": pdf["split"], "nth": pdf["nth"], "offset": offsets})
    # A header ends in the first piece with a blank line, and its length is the first stated up to there.
    after = lambda known: np.minimum.accumulate(np.where(known, np.arange(n), n)[::-1])[::-1]
    head, length = (np.append(pdf[c].to_numpy(np.float64), np.nan) for c in ("head", "length"))
    last, stated = after(~np.isnan(head[:n])), after(~np.isnan(length[:n]))
    declared = np.where(stated <= last, np.append(offsets, 0)[last] - offsets + head[last] + 8 + length[stated], np.nan)
    heads = np.where(np.isnan(declared) | (offsets < 0), -1, offsets + len(MAGIC) + np.nan_to_num(declared)).astype(np.int64)
    # The successor's number; n for the file's end, n + 1 for none.
    at = np.searchsorted(offsets, heads)
    to = np.where(heads == ends[-1], n, np.where((at < n) & (offsets[np.minimum(at, n - 1)] == heads), at, n + 1))
    jump = np.concatenate([to, [n, n + 1]])
    good = np.zeros(n + 2, bool)
    good[np.flatnonzero(offsets == 0)[:1]] = True
    for _ in range(max(1, n.bit_length())):
        good[jump[good]] = True
        jump = jump[jump]
    # A reachable record without a successor is cut off or damaged; it is left out.
    record = np.maximum.accumulate(np.where(good[:n] & (to <= n), np.arange(n), -1))
    inside = (record >= 0) & (offsets < heads[np.maximum(record, 0)])
    out["record"] = offsets[np.maximum(record, 0)]
    return out[inside]


_CHAIN = "file string, split long, nth long, offset long, record long"


def read_warc(spark: SparkSession, path: str, tables: Tables) -> DataFrame:
    """A row for each record of the archives under path: file, record (its offset), type, page_id, refers_to, url, stated (digest), payload_bytes, payload_digest."""
    place = ["file", "split", "nth"]
    first = tables.keep(_parsed(_pieces(spark, path)).select(*place, "bytes", "head", "length", "whole", *_FIELDS), "pieces")
    # A file's first piece is what precedes its first magic: nothing, in a sound file.
    broken = tables.keep(first.where("not whole and bytes > 0").select("file").distinct(), "broken")
    whole = first.join(broken, "file", "left_anti")
    sound = whole.select(*place, "bytes", "head", "length").groupBy("file").applyInPandas(_chain, _CHAIN)
    records = whole.join(sound, place).where("offset = record").select("file", "record", *_FIELDS)

    again = _parsed(_pieces(spark, path)).join(broken, "file").select(*place, "bytes", "head", "length", "value")
    again = tables.keep(again, "pieces-again")
    mended = again.join(again.select(*place, "bytes", "head", "length").groupBy("file").applyInPandas(_chain, _CHAIN), place)
    mended = mended.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    return records.unionByName(_parsed(mended).select("file", "record", *_FIELDS))


def archive_pages(pages: DataFrame, least: int = LEAST, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html; other columns are ignored) as WARC, reads the archives back and describes what was read.

    Returns page_id, payload_bytes, payload_digest (SHA-1 in hex; of the full payload, for a revisit
    that of the response it refers to), record_type (response or revisit), refers_to (a revisit's
    response), and verified: whether the digest in the header is that of the payload read. Rows that
    repeat one page_id with one payload are responses each. No rows give no rows. The archives stay
    under path, or in spark.checkpoint.dir.
    """
    spark = pages.sparkSession
    tables = Tables(spark, "warc")
    path = path or tables.path("archive")
    write_warc(pages, path, tables, least)
    tables.release()
    found = tables.keep(read_warc(spark, path, tables), "records")
    tables.drop(["pieces", "pieces-again", "revisits", "broken"])
    responses = found.where("type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("stated"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).distinct()
    out = found.where("type in ('response', 'revisit')").join(responses, ["refers_to", "stated"], "left")
    revisit = F.col("type") == "revisit"
    out = out.withColumns({"payload_bytes": F.when(revisit, F.col("b")).otherwise(F.col("payload_bytes")), "payload_digest": F.when(revisit, F.col("d")).otherwise(F.col("payload_digest"))})
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", F.coalesce(F.col("payload_digest") == F.col("stated"), F.lit(False)).alias("verified"))
