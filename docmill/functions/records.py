"""Expressions over the records of tasks, packs, tools and previews: coercions, labels, paths that stay where they belong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that other programs read.
RISK_LEVELS = ("info", "warning", "error")
CONTACT_SHEET = "contact-sheet.jpg"
OCR_HEADING = r"^###\s+(.+?)（平均置信度\s+([\d.]+)%）\s*$"
TOOL_SOURCES = ("override", "bundled", "path")
PREVIEW_CHARS = 12_000

#: The options and tools whose values and versions a task records, by operation.
PARAMETERS = {
    "TO_MARKDOWN": ("mode", "split_enabled", "target_tokens", "max_tokens", "ocr_enabled"),
    "DOCUMENT_CONTEXT_PACK": ("context_budget", "budget_unit", "source_count", "ocr_enabled"),
    "TO_PDF": ("output_type",),
    "COMPRESS_VIDEO": ("compression_crf", "compression_preset"),
    "EXTRACT_AUDIO": ("audio_format", "audio_bitrate"),
    "STANDARDIZE_MP4": (),
    "KEYFRAMES_CONTACT_SHEET": ("scene_threshold", "max_keyframes", "contact_sheet_columns"),
    "RENAME_VIDEO": ("rename_template", "project_name"),
    "ORGANIZE_VIDEO": ("rename_template", "project_name", "organize_mode"),
}
TOOLS = {"TO_MARKDOWN": ("markitdown", "rapidocr"), "DOCUMENT_CONTEXT_PACK": ("markitdown", "rapidocr"), "TO_PDF": ("libreoffice", "winword", "powerpoint")}
VIDEO_TOOLS = ("ffmpeg", "ffprobe", "exiftool")


def provenance_level(kinds: Column) -> Column:
    """The distinct kinds of a source's spans, ascending, with commas; 'document' without any."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(kinds))), ","), F.lit("")), F.lit("document"))


def base_name(display: Column, fallback: Column) -> Column:
    """The last part of a display name, whichever way its slashes lean; the fallback where that is empty."""
    shown = F.coalesce(F.nullif(display, F.lit("")), fallback)
    return F.coalesce(F.nullif(F.substring_index(F.replace(F.trim(shown), F.lit("\\"), F.lit("/")), "/", -1), F.lit("")), fallback)


def risk_level(value: Column) -> Column:
    """A known level as it is, all else a warning."""
    return F.when(value.isin(*RISK_LEVELS), value).otherwise("warning")


def duration_of(text: Column) -> Column:
    """Seconds as a tool prints them: what is no number, or below 0, is 0."""
    seconds = F.expr("double(0)") + F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(seconds) | (seconds < 0), 0.0).otherwise(seconds)


def is_contact_sheet(name: Column) -> Column:
    return F.coalesce(F.lower(name) == CONTACT_SHEET, F.lit(False))


def pack_path(file: Column) -> Column:
    """The path packs/….md that a manifest entry may name; null for every other path."""
    path = F.replace(F.coalesce(file, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.when(path.rlike(r"(?i)^(?:\./+)*(?-i:packs)/+(?:\./+)*[^/]*[^/.][^/]*\.md/*$"), F.concat(F.lit("packs/"), F.element_at(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), -1)))


def content_path(source_id: Column) -> Column:
    """Where the content of a source stands; null for an id that is empty, absolute or has a '..' part."""
    inside = (source_id != "") & ~source_id.rlike(r"^[/\\]|^[A-Za-z]:") & ~source_id.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return F.when(inside, F.concat(F.lit("sources/"), source_id, F.lit("/content.md")))


def resolved_tool(override: Column, bundled: Column, on_path: Column) -> Column:
    """(path, source) of a tool: the configured one, else the first bundled one in descending order, else the one on the search path, else nulls."""
    chosen = (F.nullif(override, F.lit("")), F.get(F.sort_array(F.array_compact(bundled), asc=False), 0), F.nullif(on_path, F.lit("")))
    source = F.lit(None).cast("string")
    for column, name in reversed(list(zip(chosen, TOOL_SOURCES, strict=True))):
        source = F.when(column.isNotNull(), name).otherwise(source)
    return F.struct(F.coalesce(*chosen).alias("path"), source.alias("source"))


def in_order(values: Column, order: tuple[str, ...], separator: str = ",") -> Column:
    """The values that are met, each once, in a fixed order."""
    return F.array_join(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(values, x)), separator)


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def warning_text(code: Column, reason: Column, message: Column, known: dict[str, str]) -> Column:
    """The text of a known code, else the reason, the message, the code itself; empty ones are passed over."""
    text = F.lit(None).cast("string")
    for name, value in known.items():
        text = F.when(code == name, value).otherwise(text)
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(text, full(reason), full(message), full(code), F.lit("unknown"))


def _by_operation(operation: Column, table: dict[str, tuple[str, ...]], default: tuple[str, ...]) -> Column:
    names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    out = names(default)
    for name, value in table.items():
        out = F.when(operation == name, names(value)).otherwise(out)
    return out


def task_parameters(operation: Column, options: Column) -> Column:
    """The options (a map) that a task of this operation records."""
    return F.map_filter(options, lambda k, _: F.array_contains(_by_operation(operation, PARAMETERS, ()), k))


def task_tools(operation: Column, versions: Column) -> Column:
    """The versions (a map) of the tools that the operation needs, without those that have none."""
    return F.map_filter(versions, lambda k, v: F.array_contains(_by_operation(operation, TOOLS, VIDEO_TOOLS), k) & (F.coalesce(v, F.lit("")) != ""))
