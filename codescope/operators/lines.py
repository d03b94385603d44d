"""Lines of every file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines


def file_lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(path, line_no, line), counted from 1. Narrow: a file's lines are made where its row is."""
    return files.select("path", F.posexplode(split_lines(F.col(text_col))).alias("_pos", "line")).select(
        "path", (F.col("_pos") + 1).alias("line_no"), "line"
    )
