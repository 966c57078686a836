"""Index pages: table rows whose cells carry their field's name in the class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.regex import found, rx
from assaykit.functions.text import strip_html

# --- fixed values: patterns and unit factors
ROW = rx(r"<tr>(.*?)</tr>", "s")
CELL = rx(r'<td[^>]*class="views-field views-field-([a-z0-9-]+)"[^>]*>(.*?)</td>', "s")
LINK = rx(r'href="([^"]+\.pdf)"', "i")
SIZE = rx(r"Size:\s*([\d.]+)\s*(KB|MB|GB)", "i")


def index_rows(pages: DataFrame, html: str = "html", *carried: str) -> DataFrame:
    """carried columns, row (its place), applicant, state, brief, order_no, category, pdf, size_mb (null if unknown)."""
    df = pages.select(*carried, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ROW), F.lit(1))).alias("row", "_raw"))
    names = F.regexp_extract_all("_raw", F.lit(CELL), F.lit(1))
    cells = F.regexp_extract_all("_raw", F.lit(CELL), F.lit(2))
    df = df.withColumns({"_names": names, "_cells": cells}).where(F.size("_names") > 0)

    def cell(name: str):
        at = F.array_position("_names", name).cast("int")
        return F.coalesce(strip_html(F.get("_cells", at - 1)), F.lit(""))

    upload = cell("field-upload-file")
    unit = F.upper(found(upload, SIZE, 2))
    factor = F.when(unit == "KB", F.lit(1 / 1024)).when(unit == "MB", F.lit(1.0)).when(unit == "GB", F.lit(1024.0))
    return df.select(
        *carried,
        "row",
        cell("title").alias("applicant"),
        cell("field-states-ut").alias("state"),
        cell("body").alias("brief"),
        cell("field-order-no-date").alias("order_no"),
        cell("field-category").alias("category"),
        found(F.col("_raw"), LINK, 1).alias("pdf"),
        (found(upload, SIZE, 1).cast("double") * factor).alias("size_mb"),
    )
