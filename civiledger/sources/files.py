"""Readers of files in other formats: delimited text, JSON lines, pages and pipe-separated sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Delimited rows by a fixed schema; what does not parse stays in ``_corrupt``."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])).csv(
        path, sep=sep, header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt"
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def links(html: Column) -> Column:
    """Addresses of all links of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def list_items(html: Column) -> Column:
    """Text of all list items, tags removed and blanks collapsed."""
    raw = F.regexp_extract_all(html, F.lit(r"<li>(.*?)</li>"), F.lit(1))
    return F.transform(raw, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "[ \n\t]+", " ")))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)), F.lit(""))


def sheet_rows(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """Pipe-separated sheet lines to item rows: the last header above a line names its columns."""
    from pyspark.sql import Window

    cells = F.transform(F.split(text, r"\|"), lambda x: F.trim(x))
    is_header = F.lower(F.col(text)).rlike(r"descri") & F.lower(F.col(text)).rlike(r"(quant|qtd|qty).*\|.*(unit|price|value|valor)|(unit|price|value|valor).*\|.*(quant|qtd|qty)")
    rows = lines.withColumns({"cells": cells, "is_header": is_header})
    above = F.last(F.when(F.col("is_header"), F.transform("cells", lambda x: F.lower(x))), ignorenulls=True).over(Window.partitionBy("sheet_id").orderBy(order))
    rows = rows.withColumn("header", above).filter("NOT is_header AND header IS NOT NULL")
    at = lambda p: F.get("cells", F.array_position(F.transform("header", lambda h: h.rlike(p)), F.lit(True)).cast("int") - 1)
    number = lambda c: F.expr("try_cast(replace(replace(" + c + ", '.', ''), ',', '.') AS decimal(18,2))")
    out = rows.select("sheet_id", order, at("descri").alias("description"), at("quant|qtd|qty").alias("q"), at("unit|price|value|valor").alias("v"))
    return out.select("sheet_id", order, "description", number("q").alias("quantity"), number("v").alias("price")).filter("quantity IS NOT NULL OR price IS NOT NULL")
