"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# CJK ideographs, and the white space beyond \s that ends no word and is no punctuation.
CJK = r"[\u3400-\u9fff\uf900-\ufaff]"
SPACE = r"\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def token_estimate(text: Column) -> Column:
    """max(1, ideographs + words + a quarter of the punctuation, rounded up); ideographs are taken out before words are counted."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(t, CJK, "")
    words = F.regexp_count(bare, F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*"))
    marks = F.regexp_count(bare, F.lit(rf"[^\p{{L}}\p{{N}}_{SPACE}]"))
    return F.greatest(F.lit(1), F.length(t) - F.length(bare) + words + F.ceil(marks / 4)).cast("long")


#: The same in DuckDB SQL, for a column named text.
TOKEN_SQL = r"""CAST(greatest(1, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\x{3400}-\x{9fff}\x{f900}-\x{faff}]', '', 'g'))
 + len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x{3400}-\x{9fff}\x{f900}-\x{faff}]', '', 'g'), '[\p{L}\p{N}_][\p{L}\p{N}_''-]*'))
 + ceil(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x{3400}-\x{9fff}\x{f900}-\x{faff}]', '', 'g'), '[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) / 4.0)) AS BIGINT)"""


#: White space as regular expressions of SQL know it; Java's \s has \x0B besides.
SQL_SPACE = r"[ \t\n\f\r]"


def bare_line(line: Column) -> Column:
    """A line without space of any script at its ends, as SQL's trim() leaves it."""
    return F.regexp_replace(line, r"^\p{Zs}+|\p{Zs}+\z", "")


def line_form(line: Column) -> Column:
    """The form in which page lines are compared: trimmed, white space single, digits replaced."""
    return F.regexp_replace(F.regexp_replace(bare_line(line), f"{SQL_SPACE}+", " "), "[0-9]+", "<num>")


def safe_component(value: Column, fallback: str) -> Column:
    """A file name part: illegal characters to _, white space to -, no ` ._-` at the ends."""
    bare = F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", "-")
    return F.coalesce(F.nullif(F.btrim(bare, F.lit(" ._-")), F.lit("")), F.lit(fallback))


def format_bytes(n: Column) -> Column:
    """B, KB, MB, GB in steps of 1024, one decimal."""
    scaled = lambda k, unit: F.format_string("%.1f " + unit, F.round(n / float(1024**k), 1))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


#: File URLs, drive letters, network shares, home and temporary folders, letter case aside; and what stands for one that is left out.
_END = r"""[^\s<>'"\]\)\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"""
PRIVATE_PATH = rf"(?i)(?:file:/+(?:[A-Za-z]:)?{_END}|[A-Za-z]:[\\/]{_END}|\\\\{_END}|/(?:Users|home|tmp|var/tmp)/{_END})"
OMITTED = "[local path omitted]"

#: The same pattern for DuckDB SQL.
PRIVATE_PATH_SQL = PRIVATE_PATH.replace("'", "''").replace("\\u0085", "\\x{85}").replace("\\u00a0", "\\x{a0}").replace("\\u1680", "\\x{1680}").replace("\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000", "\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")


def private_path(text: Column) -> Column:
    """Whether a text names a path on someone's machine."""
    return text.rlike(PRIVATE_PATH)


def redact(text: Column) -> Column:
    """The text without such paths."""
    return F.regexp_replace(text, PRIVATE_PATH, F.lit(OMITTED))


def scrub(value: Column, kind: DataType) -> tuple[Column, Column]:
    """(a value of any nested type with every string in it redacted, whether any was changed). Keys of maps stay; nulls stay and count as unchanged."""
    if isinstance(kind, StringType):
        return redact(value), F.coalesce(private_path(value), F.lit(False))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: scrub(x, kind.elementType)[0]), F.coalesce(F.exists(value, lambda x: scrub(x, kind.elementType)[1]), F.lit(False))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: scrub(x, kind.valueType)[0]), F.coalesce(F.exists(F.map_values(value), lambda x: scrub(x, kind.valueType)[1]), F.lit(False))
    if isinstance(kind, StructType):
        parts = [(f.name, *scrub(value.getField(f.name), f.dataType)) for f in kind.fields]
        whole = F.when(value.isNotNull(), F.struct(*[v.alias(name) for name, v, _ in parts]))
        return whole, F.greatest(*[c for _, _, c in parts], F.lit(False), F.lit(False))
    return value, F.lit(False)
