"""Reports as text: Markdown tables, subtitle ground truth, plans of evidence to cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cell(name: str) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"\s*[\r\n]+\s*", " ")


def markdown_rows(df: DataFrame, columns: list[str]) -> Column:
    """A row of a Markdown table: bars within values are escaped, line ends become a space, nulls are empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in columns]), F.lit(" |"))


def markdown_table(df: DataFrame, title: str, columns: list[str], order: list[str]) -> DataFrame:
    """line of each row of a report: title, header and the rows in order. The sort is by range: no task holds the whole report."""
    head = [f"## {title}", "", f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    keys = [f"_o{k}" for k in range(len(order))]
    body = df.select(F.lit(len(head)).alias("_part"), markdown_rows(df, columns).alias("line"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "_part int, line string")
    return top.unionByName(body, allowMissingColumns=True).orderBy("_part", *keys).select("line")


def write_markdown(lines: DataFrame, path: str) -> None:
    """Write lines in their order, as many part files as the sort has ranges."""
    lines.write.mode("overwrite").text(path)


def ground_truth(states: DataFrame, keys: list[str], prefix: str = "D") -> DataFrame:
    """Rows to fill in by hand: idx (D-01 ...) in order of start, and times with three decimals; speech is left blank."""
    idx = F.format_string(f"{prefix}-%02d", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")))
    three = lambda c: F.format_string("%.3f", c)
    blank = F.lit("")
    return states.select(*keys, idx.alias("idx"), blank.alias("speech_start"), blank.alias("speech_end"), three(F.col("start")).alias("subtitle_start"), three(F.col("end")).alias("subtitle_end"))


def write_ground_truth(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def evidence_plan(findings: DataFrame, pad: float = 0.5) -> DataFrame:
    """Add clip_start and clip_length: the stretch to cut around each finding, never before the file's start."""
    start = F.greatest(F.lit(0.0), F.col("start") - pad)
    return findings.withColumn("clip_start", start).withColumn("clip_length", F.col("end") + pad - start)
