"""WARC archives: writing with revisits, reading by boundary-chain verification.

Writing: records go through Spark's text writer with the record end as line end, so
any file system that Spark writes to will do. Reading: tasks split the archives at
each `WARC/1.0` line, wherever it stands, and emit for each such place a candidate
record with the offset of its successor by Content-Length. Pointer jumping from
the start of each file keeps only the candidates that the chain reaches: the same
line inside a payload is no record, however well it imitates one. Payloads that were
split so are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import fresh_path, group_min_back

VERSION = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 1000
#: Records of a file: bounds what pointer jumping holds at 24 bytes a candidate of one file.
RECORDS_PER_FILE = 50_000


def _octets(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def write_warc(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """A record per row of pages (page_id, url, html): response, or revisit if its
    payload of at least LEAST_BYTES equals that of a row with a larger page_id.

    A null html is an empty payload, a null url an empty target, a null page_id an
    empty id (its payload is then its own response unless an id shares it). Rows that
    repeat the largest id with its payload are responses all. Line ends in a url are
    percent-encoded. Revisits carry the HTTP head, with the length of the payload."""
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", _octets(F.col("html")))
    # small payloads are alone: keyed by themselves, no group
    large = df.filter(F.col("n") >= LEAST_BYTES)
    keyed = group_min_back(large, "digest", -F.col("page_id"), "neg")
    keyed = keyed.withColumn("refers", F.when(~F.col("page_id").eqNullSafe(-F.col("neg")), -F.col("neg"))).drop("neg")
    small = df.filter(F.col("n") < LEAST_BYTES).withColumn("refers", F.lit(None).cast("bigint"))
    df = keyed.select("page_id", "url", "html", "digest", "n", "refers").unionByName(small)
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(RECORD_END))
    revisit = F.col("refers").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), page(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), page(F.col("refers")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), _octets(block).cast("string"), F.lit(RECORD_END),
    )
    lines = df.select(F.concat(head, block).alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one file that the chain from offset 0 reaches, by pointer jumping:
    in each round the reached set takes in what its pointers lead to, and each pointer
    is replaced by its pointer's pointer. Pointers that do not lead on are none, so each
    ends within log2(n) + 1 rounds. `owner` is the last reached offset at or
    before a candidate; `split` says that the owner is no complete stretch by itself."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    at, n = pdf["offset"].to_numpy(), len(pdf)
    where = np.searchsorted(at, pdf["successor"].to_numpy())
    hit = (where < n) & (at[np.minimum(where, n - 1)] == pdf["successor"].to_numpy()) & (pdf["successor"].to_numpy() > at)
    jump = np.append(np.where(hit, where, n), n)  # n: the end of the chain
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = at[0] == 0
    while True:
        grown = reached.copy()
        grown[jump[reached]] = True
        if (grown == reached).all() and (jump == n).all():
            break
        reached, jump = grown, jump[jump]
    last = np.maximum.accumulate(np.where(reached[:n], np.arange(n), -1))
    pdf["real"], pdf["owner"] = reached[:n], np.where(last < 0, -1, at[last])
    pdf["split"] = (last >= 0) & ~pdf["whole"].to_numpy()[last]
    return pdf[["file", "offset", "real", "owner", "split"]]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Each stretch of an archive between two version lines, with its offset, what its
    head says, and `whole`: the stretch is a complete record by its own length."""
    raw = spark.read.option("lineSep", VERSION).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    order = Window.partitionBy("file").orderBy("part", "row")
    mark, end = len(VERSION), len(RECORD_END)
    df = raw.withColumn("size", _octets(F.col("value")) + mark)
    # an archive begins with a version line: before it stands an empty stretch
    df = df.withColumn("head", F.substring_index("value", RECORD_END, 1))
    field = lambda name: F.regexp_extract("head", rf"(?im)^{name}: *([^\r\n]*)", 1)
    # a length is digits alone, so that each successor lies behind its candidate
    df = df.withColumn("length", F.regexp_extract("head", r"(?im)^Content-Length: *(\d{1,15})[ \t]*\r?$", 1).try_cast("bigint"))
    headed = F.col("value").contains(RECORD_END)
    df = df.withColumn("need", F.when(headed, mark + _octets(F.col("head")) + end + F.col("length") + end))
    df = df.withColumn("whole", F.coalesce(F.col("need") == F.col("size"), F.lit(False)))
    # the block: behind the head, without the record's end; its payload behind the HTTP head
    block = F.substring(F.col("value"), F.char_length("head") + end + 1, F.char_length("value") - F.char_length("head") - 2 * end)
    df = df.withColumn("block", F.when(F.col("whole"), block))
    df = df.withColumn("parts", F.when(~F.col("whole"), F.col("value")))
    df = _with_http(df)
    for name, key in (("warc_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("target_uri", "WARC-Target-URI"), ("refers_to", "WARC-Refers-To"), ("stated_digest", "WARC-Payload-Digest")):
        df = df.withColumn(name, field(key))
    df = df.withColumn("offset", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)) - mark)
    return df.filter(F.col("offset").isNotNull()).drop("value")


def _with_http(df: DataFrame) -> DataFrame:
    split = F.char_length(F.substring_index("block", RECORD_END, 1))
    df = df.withColumn("http_head", F.substring_index("block", RECORD_END, 1))
    df = df.withColumn("payload", F.substring(F.col("block"), split + len(RECORD_END) + 1, F.char_length("block")))
    return df.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary"))).withColumn("payload_octets", _octets(F.col("payload")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under path: file, offset, warc_type, record_id,
    target_uri, refers_to, stated_digest, http_head, payload (text), payload_digest and
    payload_octets (of the payload here: empty in a revisit).

    Columns that a query leaves out are not carried. What follows a broken length is
    given up to the file's end, like a file that does not begin with a record; an
    empty folder of archives gives no rows."""
    pieces = _pieces(spark, path)
    links = pieces.select("file", "offset", "whole", (F.col("offset") + F.col("need")).alias("successor")).fillna(-1, ["successor"])
    real = links.groupBy("file").applyInPandas(_reached, "file string, offset long, real boolean, owner long, split boolean")
    out = ["file", "offset", "warc_type", "record_id", "target_uri", "refers_to", "stated_digest", "http_head", "payload", "payload_digest", "payload_octets"]
    whole = pieces.filter("whole").join(real.filter("real").select("file", "offset"), ["file", "offset"]).select(*out)
    # records whose payload holds version lines: their stretches, in order, up to their
    # length. A file's few split offsets meet its stretches by file alone, so that the
    # texts, which lie by file already, are not shuffled again
    marks = real.filter("split").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("offset", "owner"))).alias("owners"))
    split = pieces.join(marks.hint("merge"), "file").withColumn("start", F.try_element_at("owners", F.col("offset"))).filter("start is not null")
    same = [c for c in out[2:7]]
    joined = split.groupBy("file", "start").agg(
        F.max(F.when(F.col("offset") == F.col("start"), F.col("need"))).alias("need"),
        F.array_sort(F.collect_list(F.struct("offset", F.coalesce("parts", F.concat("head", F.lit(RECORD_END), "block", F.lit(RECORD_END))).alias("text")))).alias("all"),
        *[F.min_by(c, "offset").alias(c) for c in same],
    )
    text = F.array_join(F.transform("all", lambda x: x["text"]), VERSION)
    joined = joined.withColumn("value", text).filter(_octets(F.col("value")) + len(VERSION) >= F.col("need"))
    joined = joined.withColumn("head", F.substring_index("value", RECORD_END, 1)).withColumnRenamed("start", "offset")
    rest = F.substring(F.col("value"), F.char_length("head") + len(RECORD_END) + 1, F.char_length("value") - F.char_length("head") - 2 * len(RECORD_END))
    joined = _with_http(joined.withColumn("block", rest))
    return whole.unionByName(joined.select(*out))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record
    that read_warc() finds in the archives that write_warc() has made of all pages."""
    path = fresh_path(spark, "archives")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    revisit = F.col("warc_type") == "revisit"
    stated = F.regexp_extract("http_head", r"(?i)Content-Length: *(\d+)", 1).try_cast("bigint")
    return records.select(
        page("record_id").alias("page_id"), F.when(revisit, stated).otherwise(F.col("payload_octets")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"),
    )
