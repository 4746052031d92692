"""Sources and sinks: registry with fallback, JSONL, catalogues, documents, manifests, partitioned tables."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS: dict[str, Callable[..., DataFrame]] = {
    "parquet": lambda spark, path, **o: spark.read.options(**o).parquet(path),
    "csv": lambda spark, path, schema=None, **o: (spark.read.schema(schema) if schema else spark.read).options(**{"header": "true", **o}).csv(path),
    "json": lambda spark, path, schema=None, **o: (spark.read.schema(schema) if schema else spark.read).options(**o).json(path),
    "orc": lambda spark, path, **o: spark.read.options(**o).orc(path),
    "jdbc": lambda spark, path, **o: spark.read.format("jdbc").options(url=path, **o).load(),
}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


def register_reader(kind: str, reader: Callable[..., DataFrame]) -> None:
    """A function of session and path for a kind of source, for example one of Spark's Python data sources."""
    READERS[kind] = reader


def write(df: DataFrame, kind: str, path: str, mode: str = "overwrite", **options) -> None:
    """A table as parquet, ORC, CSV with a header, JSON lines, or to a database by JDBC (``path`` is the address, ``dbtable`` an option)."""
    w = df.write.mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options)
    if kind == "jdbc":
        w.format("jdbc").option("url", path).save()
    elif kind in ("parquet", "orc", "csv", "json"):
        getattr(w, kind)(path)
    else:
        raise ValueError(f"unknown sink {kind!r}")


def write_report(lines: DataFrame, path: str, order: list[str], text: str = "text") -> None:
    """The lines of a report in order, as one text file: reports are pages, not tables."""
    lines.orderBy(*order).select(text).coalesce(1).write.mode("overwrite").text(path)


def first_readable(spark: SparkSession, choices: list[tuple[str, str]], log: Callable[[str], None] = print) -> DataFrame:
    """The first of ``(kind, path)`` that can be read; each one passed over is logged."""
    failed = []
    for kind, path in choices:
        try:
            df = read(spark, kind, path)
            df.schema
            return df
        except Exception as e:  # any source may be absent: the next one is tried, the last error is raised
            failed.append(f"{kind} {path}: {str(e).splitlines()[0]}")
            log(f"source passed over: {failed[-1]}")
    raise ValueError("; ".join(failed))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """JSON lines with defaults for missing values; blank and bad lines are left out."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in (defaults or {}).items()})


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replaces a folder of JSON lines; readers see the old or the new one, as the writer commits at the end."""
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, day: str = "tradingday") -> None:
    """One folder a day; only the days written are replaced. Rows are brought together by day, and large days are split by size as the job runs."""
    df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


#: Category, priority, words in the name or suffixes; the first that fits counts.
FILE_RULES = [
    ("diligence_note", 100, "尽调笔记 尽调摘要 尽调反馈 调研纪要"),
    ("meeting_or_interview", 90, "会议纪要 通话记录 路演纪要 访谈"),
    ("product_report", 70, "月报 产品报告 业绩归因 定期报告 净值"),
    ("presentation", 55, "路演 公司介绍 策略介绍 标准版 材料"),
    ("raw_pdf", 45, ".pdf .pptx .docx"),
    ("audio_or_low_signal", 20, ".mp3 .m4a .wav .png .jpg .jpeg"),
    ("text_note", 60, ".md .txt"),
    ("other", 40, ""),
]
#: Words in names of files that are no source.
SKIP = ["~$", ".DS_Store", "Thumbs.db", "营业执照", "身份证", "公司章程", "公示信息", "备案证明", "备案函", "基金合同", "风险揭示书", "提供材料清单", "承诺函", "申报制度"]


def file_category(name: Column) -> Column:
    """``category, priority`` of a file's name."""
    low, pick = F.lower(name), None
    for kind, rank, words in reversed(FILE_RULES):
        got = F.struct(F.lit(kind).alias("category"), F.lit(rank).alias("priority"))
        hit = functools.reduce(lambda a, b: a | b, [low.endswith(w) if w.startswith(".") else low.contains(w) for w in words.split()], F.lit(False))
        pick = got if pick is None else F.when(hit, got).otherwise(pick)
    return pick


def date_hint(name: Column) -> Column:
    """A valid date in a file's name; month and day may have one digit."""
    pattern = r"(20\d{2})[-_年. ]?(\d{1,2})[-_月. ]?(\d{1,2})"
    loose = [F.regexp_extract(name, pattern, k) for k in (1, 2, 3)]
    strict = [F.regexp_extract(name, r"(20\d{2})(\d{2})(\d{2})", k) for k in (1, 2, 3)]
    day = lambda p: F.try_to_timestamp(F.concat_ws("-", *p), F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(day(loose), day(strict))


def catalogue(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """Files below a folder with fingerprint, category and date hint, by priority."""
    skip = "|".join(re.escape(x) for x in SKIP)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    t = files.select("path", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    t = t.withColumn("suffix", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1)))
    t = t.where(F.col("suffix").isin([e.lower() for e in extensions]) & ~F.col("file_name").rlike(skip))
    return t.withColumn("date_hint", date_hint(F.col("file_name"))).withColumn("__c", file_category(F.col("file_name"))).select("*", "__c.*").drop("__c").orderBy(F.desc("priority"), F.asc_nulls_first("date_hint"), "file_name")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8, else GBK; what neither reads is replaced."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for name in ("utf-8-sig", "gbk"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("utf-8", "replace")

    return content.map(one)


def text_of(content: Column) -> Column:
    """UTF-8 by Spark's own cast; only bytes that aren't UTF-8 go through Python."""
    plain = content.cast("string")
    valid = F.is_valid_utf8(plain)
    return F.when(valid, F.regexp_replace(plain, "^\ufeff", "")).otherwise(decoded(F.when(~valid, content)))


PARSERS: dict[str, Callable[[Column], Column]] = {".txt": text_of, ".md": text_of, ".csv": text_of}


def register_parser(suffix: str, parser: Callable[[Column], Column]) -> None:
    """A function of the content column for files of a suffix."""
    PARSERS[suffix.lower()] = parser


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, status, error_message`` of documents; a suffix without a parser is an error row, not a failure."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    text = F.lit(None).cast("string")
    for s, f in PARSERS.items():
        text = F.when(suffix == s, f(F.col("content"))).otherwise(text)
    known = suffix.isin(list(PARSERS))
    return files.select("path", text.alias("text"), known.alias("__k"), suffix.alias("__s")).select("path", F.col("text").alias("content"), F.when(F.col("__k") & F.col("text").isNotNull(), "success").otherwise("error").alias("status"), F.when(~F.col("__k"), F.concat(F.lit("no parser for "), F.col("__s"))).when(F.col("text").isNull(), "can't be read").alias("error_message"))


#: Error values of spreadsheets.
CELL_ERRORS = ["#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A"]


def cell_errors(cells: DataFrame, first: int = 20) -> DataFrame:
    """Count and first places of each error value in ``sheet, cell, value``."""
    t = cells.where(F.trim("value").isin(CELL_ERRORS)).select(F.trim("value").alias("error"), F.concat_ws("!", "sheet", "cell").alias("place"))
    # the first places of parts, then of all, so that no task sorts a whole kind of error
    w = W.partitionBy("error", "__part").orderBy("place")
    parts = t.withColumn("__part", F.pmod(F.xxhash64("place"), F.lit(256))).withColumn("__n", F.row_number().over(w))
    parts = parts.groupBy("error", "__part").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("__n") <= first, F.col("place"))).alias("places"))
    return parts.groupBy("error").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("places"))), 1, first).alias("places"))


def to_markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows as a Markdown table, on the driver."""
    body = df.limit(rows).collect()
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in body]])


def to_html(df: DataFrame, rows: int = 50) -> str:
    """The first rows as an HTML table with escaped cells, on the driver."""
    import html

    cell = lambda tag, v: f"<{tag}>{'-' if v is None else html.escape(str(v))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<table><thead><tr>{''.join(cell('th', c) for c in df.columns)}</tr></thead><tbody>{body}</tbody></table>"


def parameters(text: str | None, overrides: list[str] = ()) -> dict:
    """A JSON object and ``key=value`` pairs on top; values are JSON where they can be read as such."""
    import json

    out = json.loads(text) if text else {}
    if not isinstance(out, dict):
        raise ValueError("parameters must be a JSON object")
    for item in overrides:
        k, sep, v = item.partition("=")
        if not sep or not k.strip():
            raise ValueError(f"not key=value: {item!r}")
        try:
            out[k.strip()] = json.loads(v)
        except ValueError:
            out[k.strip()] = v
    return out
