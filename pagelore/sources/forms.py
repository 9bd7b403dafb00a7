"""Form values as CSV and XML text, both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions.text import csv_plain, xml_text

BOM = "﻿"


def records(text: Column) -> Column:
    """Records of CSV text: line ends inside quotes don't count. An array of field arrays."""
    whole = F.regexp_replace(text, f"^{BOM}", "")
    # a line end is one if an even number of quotes follows up to the end of the text
    rows = F.filter(F.split(whole, r'\r?\n(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda r: F.trim(r) != "")
    fields = lambda r: F.transform(F.split(r, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda f: F.replace(F.regexp_replace(f, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')))
    return F.transform(rows, fields)


def values_of_csv(texts: DataFrame) -> DataFrame:
    """form_id, name, ord, values: repeated names collect their values in order; a heading line and blank names are left out."""
    rows = texts.select("form_id", F.posexplode(records(F.col("text"))).alias("k", "r"))
    rows = rows.select("form_id", "k", F.trim(F.col("r")[0]).alias("name"), F.coalesce(F.get("r", F.lit(1)), F.lit("")).alias("value"))
    rows = rows.filter("name <> '' AND NOT (k = 0 AND lower(name) = 'name' AND lower(value) = 'value')")
    got = F.sort_array(F.collect_list(F.struct("k", "value")))
    return rows.groupBy("form_id", "name").agg(F.min("k").alias("ord"), got["value"].alias("values"))


def csv_of_values(values: DataFrame) -> DataFrame:
    """form_id, text: a row for each value, an empty one for a name without any; byte order mark and CR LF as spreadsheets want them."""
    rows = values.select("form_id", "ord", "name", F.posexplode_outer("values").alias("k", "value"))
    rows = rows.withColumn("line", F.concat(csv_plain(F.col("name")), F.lit(","), csv_plain(F.coalesce("value", F.lit("")))))
    ordered = F.sort_array(F.collect_list(F.struct("ord", F.coalesce("k", F.lit(0)).alias("k"), "line")))
    return rows.groupBy("form_id").agg(F.concat(F.lit(f"{BOM}name,value\r\n"), F.array_join(ordered["line"], "\r\n"), F.lit("\r\n")).alias("text"))


def xfdf_of_values(values: DataFrame) -> DataFrame:
    """form_id, text: fields with their values; names are written in full."""
    value = F.transform("values", lambda v: F.concat(F.lit("<value>"), xml_text(v), F.lit("</value>")))
    rows = values.withColumn("x", F.concat(F.lit('<field name="'), xml_text(F.col("name")), F.lit('">'), F.array_join(value, ""), F.lit("</field>")))
    ordered = F.sort_array(F.collect_list(F.struct("ord", "x")))
    return rows.groupBy("form_id").agg(F.concat(F.lit("<xfdf><fields>"), F.array_join(ordered["x"], ""), F.lit("</fields></xfdf>")).alias("text"))


def values_of_xfdf(texts: DataFrame) -> DataFrame:
    """form_id, name, ord, values of XFDF text whose fields are not nested."""
    fields = texts.select("form_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)(<field name=\"[^\"]*\">.*?</field>)"), F.lit(1))).alias("ord", "x"))
    return fields.select("form_id", _unescape(F.regexp_extract("x", r"(?s)^<field name=\"([^\"]*)\">", 1)).alias("name"), "ord", F.transform(F.regexp_extract_all("x", F.lit(r"(?s)<value>(.*?)</value>"), F.lit(1)), lambda v: _unescape(v)).alias("values"))


def _unescape(text: Column) -> Column:
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return text
