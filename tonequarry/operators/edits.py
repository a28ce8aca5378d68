"""Reports made anew without losing what people wrote into the one before.

Reports are rows (doc, n, line). Three kinds of entries are found again by what they are about, not by where they stand: a cell
beside its label, a table row by its first two cells, a line by its beginning, with the indented lines under it. Numbers that a
program counts follow the new report; a rate keeps what was written before and after its denominator. Every step is a join or a
window by doc, so any number of reports is merged at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Form:
    """The lines that people fill in, and what they hold before anyone has."""

    prefixes: tuple[str, ...] = ("- 结论", "- 执行次数：", "- 复现率：", "- 各段是否", "- 预期：", "- 实际", "- 关键时间码：", "- 是否升级为缺陷", "- 其它备注：")
    blank_tails: tuple[str, ...] = ("（PASS / FAIL / BLOCKED / 未复现）：", "（写可观察事实 + 时间码）：", "是 / 否", "")
    count_prefix: str = "- 执行次数："
    counted: str = r"^- 执行次数：\d+（本目录内 \d+ 个片段）$"
    rate_prefix: str = "- 复现率："
    rate: str = r"^- 复现率：([^/]*)/\s*(\d+)(.*)$"
    unrated: str = r"^- 复现率：__ / \d+$"
    labels_left_out: tuple[str, ...] = ("项目", "---")
    key_mark: str = "`"
    #: A heading's mark goes once a cell or a line of its part is filled in.
    open_cell: tuple[str, str, str] = ("游戏 / 版本", "## 一、环境（待填）", "## 一、环境")
    open_line: tuple[str, str, str] = ("- 结论", "## 四、结论（待填）", "## 四、结论")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _parsed(lines: DataFrame, form: Form) -> DataFrame:
    """doc, n, line with said (trimmed), bars, cells, prefix (the first that the line begins with), block (which head an indented line belongs to)."""
    said = _trimmed(F.col("line"))
    p = lines.select("doc", "n", "line", said.alias("said")).withColumn("bars", F.when(F.startswith("said", F.lit("|")), F.length("said") - F.length(F.replace("said", F.lit("|"), F.lit("")))).otherwise(0))
    p = p.withColumn("cells", F.transform(F.split(F.regexp_replace("said", r"^\|+|\|+$", ""), r"\|"), _trimmed))
    p = p.withColumn("prefix", F.coalesce(*[F.when(F.startswith("said", F.lit(x)), F.lit(x)) for x in form.prefixes]))
    under = F.col("line").rlike(r"(?U)^\s") & (F.col("said") != "") & F.col("prefix").isNull()
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.withColumn("under", under).withColumn("block", F.sum((~under).cast("int")).over(w))


def written_entries(lines: DataFrame, form: Form = Form()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What people wrote into reports, of several the last: cells (doc, label, value), rows (doc, key1, key2, rest), lines (doc, prefix, lines) and
    rates (doc, head, tail)."""
    p = _parsed(lines, form)
    cell = lambda k: F.get("cells", F.lit(k))
    cells = p.filter((F.col("bars") >= 3) & (F.coalesce(cell(1), F.lit("")) != "") & ~cell(0).isin(*form.labels_left_out))
    cells = cells.groupBy("doc", cell(0).alias("label")).agg(F.max_by(cell(1), "n").alias("value"))
    rest = F.slice("cells", 3, F.greatest(F.size("cells") - 2, F.lit(0)))
    rows = p.filter((F.col("bars") >= 4) & F.startswith(cell(0), F.lit(form.key_mark)) & (F.coalesce(cell(1), F.lit("")) != "") & F.exists(rest, lambda c: c != ""))
    rows = rows.groupBy("doc", cell(0).alias("key1"), cell(1).alias("key2")).agg(F.max_by(rest, "n").alias("rest"))
    heads = p.filter("prefix is not null").withColumn("tail", _trimmed(F.expr("substring(said, length(prefix) + 1)")))
    # the few lines under one head
    more = p.filter("under").groupBy("doc", "block").agg(F.array_sort(F.collect_list(F.struct("n", F.regexp_replace("line", r"(?U)\s+$", "").alias("line")))).alias("more"))
    heads = heads.join(more, ["doc", "block"], "left").withColumn("more", F.coalesce(F.transform("more", lambda m: m["line"]), F.array().cast("array<string>")))
    rated = heads.filter(F.col("prefix") == form.rate_prefix)
    match = F.col("said").rlike(form.rate)
    rates = rated.filter(match & ~F.col("said").rlike(form.unrated)).groupBy("doc").agg(F.max_by(F.struct(F.trim(F.regexp_extract("said", form.rate, 1)).alias("head"), F.regexp_extract("said", form.rate, 3).alias("tail")), "n").alias("m")).select("doc", "m.*")
    other = rated.filter(~match & (F.col("tail") != "")).select("doc", "prefix", "n", F.array("said").alias("lines"))
    own = heads.filter((F.col("prefix") != form.rate_prefix) & ~((F.col("prefix") == form.count_prefix) & F.col("said").rlike(form.counted)))
    own = own.filter(~F.col("tail").isin(*form.blank_tails) | (F.size("more") > 0)).select("doc", "prefix", "n", F.concat(F.array("said"), "more").alias("lines"))
    kept = own.union(other).groupBy("doc", "prefix").agg(F.max_by("lines", "n").alias("lines"))
    return cells, rows, kept, rates


def merge_reports(fresh: DataFrame, edited: DataFrame, form: Form = Form()) -> DataFrame:
    """``fresh`` reports (doc, n, line) with what people wrote into ``edited`` ones of the same doc; lines are numbered anew from 0."""
    cells, rows, kept, rates = written_entries(edited, form)
    p = _parsed(fresh, form)
    cell = lambda k: F.get("cells", F.lit(k))
    p = p.withColumns({"label": F.when((F.col("bars") >= 3) & (cell(1) == ""), cell(0)), "key1": F.when((F.col("bars") >= 3) & (F.size("cells") >= 4), cell(0)), "key2": cell(1)})
    j = p.join(cells, ["doc", "label"], "left").join(rows, ["doc", "key1", "key2"], "left").join(kept, ["doc", "prefix"], "left").join(rates, "doc", "left")
    filled = F.transform("cells", lambda c, i: F.when((i >= 2) & (c == ""), F.coalesce(F.get("rest", i - 2), c)).otherwise(c))
    bars = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    total = F.when(F.contains("said", F.lit("/")), F.trim(F.element_at(F.split("said", "/"), -1))).otherwise("")
    rated = (F.col("prefix") == form.rate_prefix) & (F.col("head") != "")
    new = (
        F.when(F.col("value").isNotNull(), F.array(bars(F.array("label", "value"))))
        .when(F.col("rest").isNotNull() & (filled != F.col("cells")), F.array(bars(filled)))
        .when(rated, F.array(F.concat(F.lit(form.rate_prefix), "head", F.lit(" / "), total, "tail")))
        .when(F.col("lines").isNotNull(), F.col("lines"))
    )
    j = j.withColumn("new", new)
    # lines under a head that brings its own go
    over = F.max(F.when(~F.col("under"), F.coalesce(F.size("new") > 1, F.lit(False)))).over(Window.partitionBy("doc", "block"))
    out = j.withColumn("_gone", F.col("under") & over).filter("not _gone").select("doc", "n", F.posexplode(F.coalesce("new", F.array("line"))).alias("k", "line"))
    for have, (key, old, heading) in ((cells.select("doc", F.col("label").alias("key")), form.open_cell), (kept.select("doc", F.col("prefix").alias("key")), form.open_line)):
        done = have.filter(F.col("key") == key).select("doc", F.lit(True).alias("_done")).distinct()
        out = out.join(done, "doc", "left").withColumn("line", F.when(F.col("_done"), F.replace("line", F.lit(old), F.lit(heading))).otherwise(F.col("line"))).drop("_done")
    order = F.row_number().over(Window.partitionBy("doc").orderBy("n", "k")) - 1
    return out.select("doc", order.alias("n"), "line")
