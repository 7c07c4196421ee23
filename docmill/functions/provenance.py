"""Where a document's text comes from: spans between the markers of pages, slides, sheets and recognised pages, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.lines import lines_of, once

SPAN = "struct<source_type:string,label:string,ordinal:int,start_line:int,end_line:int,confidence:double>"

# The markers, and the labels that other programs read.
SLIDE = r"^\s*<!--\s*(?i:slide number)\s*:\s*(\d+)\s*-->\s*$"
PAGE = r"^\s*<!--\s*(?i:page)\s*:\s*(\d+)\s*-->\s*$"
SHEET_LABEL = "工作表："
SHEET = rf"^\s*#\s+{SHEET_LABEL}(.+?)\s*$"
APPENDIX = "## OCR 补充文本"
RECOGNISED = r"^\s*###\s+(.+?)（平均置信度\s+([\d.]+)%）\s*$"
WHOLE = {".doc": "Word 文档", ".docx": "Word 文档", ".ppt": "PowerPoint 文档", ".pptx": "PowerPoint 文档", ".xls": "Excel 工作簿", ".xlsx": "Excel 工作簿", ".pdf": "PDF 文档"}
OTHER = "源文档"
NO_PLACE = "文档级定位"


def _marker(line: Column, at: Column) -> Column:
    """The span that a line opens, its end open; null for a line that is no marker."""
    found = lambda pattern, k=1: F.regexp_extract(line, pattern, k)
    none = F.lit(None).cast("string")
    number = lambda pattern: found(pattern).try_cast("int")
    numbered = lambda kind, text, pattern: F.struct(F.lit(kind).alias("kind"), F.format_string(text, number(pattern)).alias("label"), number(pattern).alias("ordinal"), none.alias("sure"), at.alias("line"))
    named = lambda kind, pattern, sure: F.struct(F.lit(kind).alias("kind"), F.trim(found(pattern)).alias("label"), F.lit(None).cast("int").alias("ordinal"), sure.alias("sure"), at.alias("line"))
    return (
        F.when(line.rlike(SLIDE), numbered("slide", "幻灯片 %d", SLIDE))
        .when(line.rlike(PAGE), numbered("page", "第 %d 页", PAGE))
        .when(line.rlike(SHEET), named("worksheet", SHEET, none))
        .when(line.rlike(RECOGNISED), named("ocr", RECOGNISED, found(RECOGNISED, 2)))
    )


def with_spans(docs: DataFrame, text: str = "markdown", suffix: str = "suffix") -> DataFrame:
    """docs with spans: from each marker to the line before the next one; without markers one span for the whole document, labelled by its suffix."""
    label = F.lit(OTHER)
    for name, value in WHOLE.items():
        label = F.when(F.lower(suffix) == name, value).otherwise(label)
    kind = f"array<{SPAN}>"

    def of_marks(marks: Column, n: Column) -> Column:
        end = lambda m, i: F.coalesce(F.get(marks, i + 1)["line"] - 1, F.greatest(m["line"], n))
        marked = F.transform(marks, lambda m, i: F.struct(m["kind"], m["label"], m["ordinal"], m["line"], end(m, i), m["sure"].try_cast("double") / 100))
        whole = F.array(F.struct(F.lit("document"), label, F.lit(None).cast("int"), F.lit(1), F.greatest(F.lit(1), n), F.lit(None).cast("double")))
        return F.when(F.size(marks) > 0, marked.cast(kind)).otherwise(whole.cast(kind))

    def of_lines(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda x, i: _marker(x, i + 1)), lambda x: x.isNotNull())
        return once(marks, lambda m: of_marks(m, F.size(lines)))

    return docs.withColumn("spans", once(lines_of(F.col(text)), of_lines))


def location_label(span: Column) -> Column:
    """A span (source_type, label, ordinal, confidence) as a reader of Chinese sees it; what lacks its place stands for the document."""
    name = F.coalesce(span["label"], F.lit(""))
    sure = F.when(span["confidence"].isNotNull(), F.format_string("（置信度 %d%%）", F.bround(span["confidence"] * 100, 0).cast("long"))).otherwise("")
    return (
        F.when((span["source_type"] == "page") & span["ordinal"].isNotNull(), F.format_string("第 %d 页", span["ordinal"]))
        .when((span["source_type"] == "slide") & span["ordinal"].isNotNull(), F.format_string("第 %d 张幻灯片", span["ordinal"]))
        .when((span["source_type"] == "worksheet") & (name != ""), F.concat(F.lit(SHEET_LABEL), name))
        .when(span["source_type"] == "ocr", F.concat(F.when(name != "", F.concat(F.lit("OCR："), name)).otherwise("OCR"), sure))
        .otherwise(NO_PLACE)
    )
