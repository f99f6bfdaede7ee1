"""Filtering the text sections of exported articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filter_sections(docs: DataFrame, id_col: str, text_col: str, least_words: int = 5) -> DataFrame:
    """id, n, line of the lines that stay. After a line "Text:" and until one that begins with ---, script blocks and
    lines of fewer words go. A null text has no lines; windows are over one document's lines."""
    line = F.col("line")
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    mark = F.when(line.startswith("Text:"), True).when(line.startswith("---"), False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)) & ~line.startswith("---")
    rows = rows.withColumn("inside", inside)
    opened = F.when(F.col("inside"), F.when(line.rlike("(?i)</script>"), False).when(line.rlike("(?i)<script"), True))
    script = line.rlike("(?i)<script") | F.coalesce(F.last(opened, ignorenulls=True).over(before), F.lit(False))
    rows = rows.withColumn("gone", F.col("inside") & (script | (F.regexp_count(line, F.lit(r"\S+")) < least_words)))
    return rows.filter(~F.col("gone")).select("id", "n", "line")
