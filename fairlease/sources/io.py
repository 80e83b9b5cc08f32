"""Sources and sinks (A1-A10).

Readers declare their schema (no inference), CSV families with differing
headers are aligned by name, API XML payloads are parsed with ``from_xml``
into one row per item, and failed payloads are routed to an error frame
instead of aborting the job.
"""

from __future__ import annotations

import codecs
import csv
import io as _io
import itertools
import os
from collections.abc import Sequence

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlease.session import materialize

# ---------------------------------------------------------------------------
# The public trade-data API catalogue (name, trade type, property type).
# ---------------------------------------------------------------------------
API_CATALOGUE = (
    ("rent_apt", "rent", "apt"),
    ("rent_rh", "rent", "rh"),
    ("rent_officetel", "rent", "officetel"),
    ("rent_detached", "rent", "detached"),
    ("sale_apt", "sale", "apt"),
    ("sale_rh", "sale", "rh"),
    ("sale_officetel", "sale", "officetel"),
    ("sale_detached", "sale", "detached"),
)
OK_CODES = ("000", "00")
PAGE_ROWS = 1000
LEGACY_CHARSETS = ("cp949", "euc-kr", "ms949")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(API_CATALOGUE), "source_api string, trade_type string, property_type string")


# A1 ---------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """CSV scan with a declared schema; a UTF-8 BOM is dropped by the reader.  Legacy Korean charsets
    are decoded by this library, a file a task at a time, so no session setting changes."""
    if encoding.lower() not in LEGACY_CHARSETS:
        return spark.read.schema(schema).option("header", header).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    inside = path if _list_files(spark, path) else f"{path.rstrip('/')}/part-*"
    rows = _csv_rows(spark, inside, (encoding,), header).where(F.col("values").isNotNull())
    # as the scan does: by position, and NULL where a value is not of its type
    return rows.select(*[F.get("values", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def _list_files(spark: SparkSession, pattern: str, files_only: bool = True) -> list[str]:
    """Glob through the Hadoop FileSystem (works for local, HDFS and object stores).

    With ``files_only=False`` directories (Spark-written tables) match too."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath)
    return sorted(str(s.getPath().toString()) for s in (found or []) if s.isFile() or not files_only)


# A2 ---------------------------------------------------------------------------
#: Tried in this order on every file.
CHARSETS = ("utf-8-sig", "cp949")


def _csv_rows(spark: SparkSession, pattern: str, charsets: Sequence[str], header: bool = True) -> DataFrame:
    """(path, columns, values): a row a record, and one with NULL values for each file's header.

    One scan of whole files for any number of them: Spark packs small files into tasks.  A file is
    decoded by the first charset that takes all of it; one that none takes is an error naming it.
    Short records are filled with NULL, long ones cut; an empty field is NULL.
    """

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()  # not copied, and decoded a piece at a time
                charset = next((c for c in charsets if _decodes(raw, c)), None)
                if charset is None:
                    raise ValueError(f"{path}: in none of the charsets {', '.join(charsets)}")
                csv.field_size_limit(1 << 30)
                text = _io.TextIOWrapper(pa.BufferReader(raw), charset, newline="")
                records = filter(None, csv.reader(text, doublequote=True, escapechar="\\"))
                names = next(records, []) if header else []
                width = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([names], pa.list_(pa.string())), pa.array([None], pa.list_(pa.string()))], names=["path", "columns", "values"])
                while True:
                    part = list(itertools.islice(records, CSV_RECORDS))
                    if not part:
                        break
                    values = [[x or None for x in (r[:width] + [None] * (width - len(r)) if header else r)] for r in part]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([names] * len(part), pa.list_(pa.string())), pa.array(values, pa.list_(pa.string()))], names=["path", "columns", "values"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(parse, "path string, columns array<string>, values array<string>")


#: Records of a file that are turned into one Arrow batch.
CSV_RECORDS = 10_000
#: Records of a CSV file that is written here: a reader's task takes in whole files.
CSV_FILE_ROWS = 200_000
#: Bytes of a file that are decoded at once to tell its charset.
DECODED_BYTES = 1 << 20


def _decodes(raw: pa.Buffer, charset: str) -> bool:
    """Whether ``charset`` takes all of a file."""
    view = memoryview(raw)
    try:
        if len(view) <= DECODED_BYTES:
            bytes(view).decode(charset)
            return True
        decoder = codecs.getincrementaldecoder(charset)()
        for at in range(0, len(view), DECODED_BYTES):
            decoder.decode(view[at : at + DECODED_BYTES])
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return True


def read_csv_files(spark: SparkSession, pattern: str, charsets: Sequence[str] = CHARSETS) -> DataFrame:
    """All CSV files that ``pattern`` matches (or that lie in matching folders) as strings, aligned by column name.

    Headers and charsets may differ from file to file; a column that a file lacks is NULL there, of two
    equal names in a header the first counts.  The files are read once, whatever their number: the parsed
    records are a stage boundary, from which the few distinct headers are taken.  No file: no columns.
    """
    if not _list_files(spark, pattern, files_only=False):
        return spark.createDataFrame([], T.StructType([]))
    rows = materialize(_csv_rows(spark, pattern, charsets))
    headers = [r["columns"] for r in rows.groupBy("columns").agg(F.min("path").alias("first")).orderBy("first").collect()]  # a row a family
    names = list(dict.fromkeys(c for h in headers for c in h))
    records = rows.where(F.col("values").isNotNull())

    def pick(name: str):
        held = [(h, h.index(name)) for h in headers if name in h]
        if len(held) == len(headers) and len({i for _, i in held}) == 1:
            return F.get("values", F.lit(held[0][1]))
        out = F.lit(None).cast("string")
        for h, i in held:
            out = F.when(F.col("columns") == F.array(*[F.lit(c) for c in h]), F.get("values", F.lit(i))).otherwise(out)
        return out

    return records.select(*[pick(c).alias(c) for c in names]) if names else spark.createDataFrame([], T.StructType([]))


def read_raw_trades(spark: SparkSession, directory: str, trade_type: str) -> DataFrame:
    """All ``{trade_type}_*.csv`` files read as strings, aligned by column name (headers differ by API)."""
    return read_csv_files(spark, f"{directory.rstrip('/')}/{trade_type}_*.csv", ("utf-8-sig",))


# A3 ---------------------------------------------------------------------------
def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty frame with the declared columns when nothing is there."""
    if not _list_files(spark, path) and not _list_files(spark, f"{path.rstrip('/')}/*"):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


# A4 ---------------------------------------------------------------------------
#: Both envelopes: the data response, and the gateway's service error.
XML_SCHEMA = (
    "header struct<resultCode string, resultMsg string, returnReasonCode string, returnAuthMsg string>,"
    " cmmMsgHeader struct<resultCode string, resultMsg string, returnReasonCode string, returnAuthMsg string>,"
    " body struct<items struct<item array<map<string, string>>>, totalCount long>, _malformed string"
)
MALFORMED, EMPTY = "MALFORMED", "EMPTY"


def parse_trade_xml(df: DataFrame, payload_col: str = "payload", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): one row per ``<item>`` (its child tags as a string map, trimmed) with the
    response's total, and one error row per payload that is no good.

    Errors keep the payload and carry its result code: the API's or the gateway's own, ``MALFORMED``
    for what does not parse as a whole (cut off, no XML), ``EMPTY`` for a null or blank payload and
    for one with neither code nor body.  Every payload gives rows, an error, or is a good empty page.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    text = F.col(payload_col).cast("string")
    whole = F.trim(text).rlike(r"(?s)^<.*>$")  # the parser alone would take a cut-off text for an empty one
    parsed = df.select(*keep, text.alias("payload"), whole.alias("whole"), F.from_xml(text, XML_SCHEMA, options).alias("x"))

    def said(field: str) -> F.Column:
        # in either envelope, else anywhere in the document
        anywhere = F.regexp_extract("payload", rf"(?s)<{field}>\s*(.*?)\s*</{field}>", 1)
        found = F.coalesce(F.col(f"x.header.{field}"), F.col(f"x.cmmMsgHeader.{field}"), anywhere)
        return F.nullif(F.trim(found), F.lit(""))

    body = F.col("x.body").isNotNull()
    blank = F.col("payload").isNull() | (F.trim("payload") == "")
    broken = ~F.col("whole") | F.col("x").isNull() | F.col("x._malformed").isNotNull()
    told = F.coalesce(said("resultCode"), said("returnReasonCode"))
    code = F.when(blank, F.lit(EMPTY)).when(broken, F.lit(MALFORMED)).otherwise(F.coalesce(told, F.when(~body, F.lit(EMPTY))))
    msg = F.when(blank | broken, F.substring("payload", 1, 200)).otherwise(F.coalesce(said("resultMsg"), said("returnAuthMsg")))
    good = code.isNull() | code.isin(*OK_CODES)
    parsed = parsed.select(
        *keep, F.when(~good, F.col("payload")).alias("payload"), code.alias("result_code"), msg.alias("result_msg"), F.coalesce(F.col("x.body.totalCount"), F.lit(0)).alias("total_count"),
        # trimmed here: behind the boundary an item is a plain column, which a pushed filter may read many times
        F.transform("x.body.items.item", lambda item: F.transform_values(item, lambda k, v: F.trim(v))).alias("items"),
    )
    parsed = materialize(parsed)  # parsed once for both results; of good pages the items alone
    ok = F.col("result_code").isNull() | F.col("result_code").isin(*OK_CODES)
    errors = parsed.filter(~ok).select(*keep, "result_code", "result_msg", "payload")
    rows = parsed.filter(ok).select(*keep, "total_count", F.explode("items").alias("item"))
    return rows, errors


def item_columns(rows: DataFrame, tags: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project map items to string columns (absent tag -> NULL)."""
    return rows.select(*keep, *[F.col("item").getItem(t).alias(t) for t in tags])


# A5 ---------------------------------------------------------------------------
def stamp_provenance(df: DataFrame, source_api: str | None = None, region_col: str | None = None, month_col: str | None = None) -> DataFrame:
    """Add source_api / trade_type / property_type from the API catalogue (broadcast join when the
    source is a column, literals when it is fixed) and the request region / month."""
    spark = df.sparkSession
    if source_api is not None:
        row = {r[0]: r for r in API_CATALOGUE}[source_api]
        out = df.withColumns({"source_api": F.lit(row[0]), "trade_type": F.lit(row[1]), "property_type": F.lit(row[2])})
    else:
        cat = catalogue(spark)
        out = df.join(F.broadcast(cat.drop(*[c for c in ("trade_type", "property_type") if c in df.columns and c != "source_api"])), "source_api", "left")
    cols = {}
    if region_col:
        cols["request_gu_code"] = F.col(region_col)
    if month_col:
        cols["request_deal_ymd"] = F.col(month_col)
    return out.withColumns(cols) if cols else out


# A6 ---------------------------------------------------------------------------
def collection_manifest(regions: DataFrame, start_ym: str, end_ym: str, targets: Sequence[str] | None = None) -> DataFrame:
    """targets x regions x months (``yyyyMM``): one request per row before pagination."""
    spark = regions.sparkSession
    cat = catalogue(spark)
    if targets is not None:
        cat = cat.filter(F.col("source_api").isin(*targets))
    months = spark.range(1).select(
        F.explode(
            F.sequence(F.to_date(F.lit(start_ym + "-01")), F.to_date(F.lit(end_ym + "-01")), F.expr("interval 1 month"))
        ).alias("m")
    ).select(F.date_format("m", "yyyyMM").alias("deal_ymd"))
    return F.broadcast(cat).crossJoin(regions.select("gu_code").distinct()).crossJoin(F.broadcast(months))


def expand_pages(df: DataFrame, total_col: str = "total_count", page_rows: int = PAGE_ROWS) -> DataFrame:
    """One row per page: pages 1..ceil(total/page_rows), at least one page per request."""
    pages = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(total_col), F.lit(0)) / page_rows)).cast("bigint")
    return df.withColumn("page_no", F.explode(F.sequence(F.lit(1).cast("bigint"), pages)))


# A7 ---------------------------------------------------------------------------
def pending(manifest: DataFrame, existing: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Manifest entries without existing output (all of them with ``overwrite``)."""
    return manifest if overwrite else manifest.join(existing.select(*keys).distinct(), list(keys), "left_anti")


# A8 ---------------------------------------------------------------------------
def read_listings(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Listing batch from JSON/JSONL (one object per line or an array) or CSV, by suffix."""
    low = path.lower().rstrip("/")
    if low.endswith(".json") or low.endswith(".jsonl"):
        r = spark.read.option("multiLine", low.endswith(".json"))
        return (r.schema(schema) if schema else r).json(path)
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r).csv(path)


# A9 ---------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("maxRecordsPerFile", CSV_FILE_ROWS)
    w.format(fmt).save(path)
    return path


# A10 --------------------------------------------------------------------------
def write_report(df: DataFrame, path: str) -> str:
    """Report rows as JSON lines (small frames: one output file)."""
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared checkpoint directory (never a machine-local temp dir)."""
    from fairlease.session import checkpoint_dir

    base = checkpoint_dir(spark)
    return os.path.join(base, "fairlease", *parts) if "://" not in base else "/".join([base.rstrip("/"), "fairlease", *parts])
