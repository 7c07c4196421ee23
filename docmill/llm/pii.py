"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move their score.

The kinds of BASE (e-mail, IP address, payment card, international phone) stand wherever their pattern matches and its check holds, whatever their score. The
kinds of ADDED (IBAN by mod 97, social security number, national phone, date of birth) are kept if their score reaches THRESHOLD: what the pattern alone is
worth, plus CONFIRMED if a checksum holds, plus or less CONTEXT for words that speak for or against it within BEFORE code points before and AFTER behind. An
added span that overlaps a base span, or an added one of a kind listed earlier, is dropped. A failing match is dropped without a retry.

Rows are judged by themselves, so nothing is exchanged and any number of repeats, ties or hot sources costs nothing; a null text has no spans, a null doc_id
stays. Patterns run in time linear in the text: e-mail addresses grow from their "@", and digits are taken as whole chains that are cut afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "birth_date")
KINDS = BASE + ADDED

THRESHOLD, CONFIRMED, CONTEXT = 50, 30, 40
BEFORE, AFTER = 40, 20

#: What a pattern alone is worth, words that speak for a kind, words that speak against personal data.
WORTH = {"email": 60, "ip": 40, "card": 20, "phone": 50, "iban": 20, "ssn": 20, "local_phone": 20, "birth_date": 10}
SPEAKS_FOR = {
    "email": "mail|email|contact|write",
    "ip": "ip|address|host|server|client",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|telefon|handy",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|social",
    "local_phone": "phone|tel|telephone|call|mobile|cell|fax|telefon|handy",
    "birth_date": "born|birth|birthday|dob|geboren|geburtsdatum|naissance|nacido|nacida|nacimiento",
}
SPEAKS_AGAINST = "order|invoice|version|release|isbn|serial|sku|part|ticket|model"

#: The patterns of the added kinds; all quantifiers are bounded.
PATTERNS = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "local_phone": r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
    "birth_date": r"\b(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]\b",
}

_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_ADDED = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}
_FOR = {k: re.compile(rf"\b(?:{w})\b", re.ASCII) for k, w in SPEAKS_FOR.items()}
_AGAINST = re.compile(rf"\b(?:{SPEAKS_AGAINST})\b", re.ASCII)


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    doubled = [2 * int(d) - 9 * (d > "4") for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def mod97(compact: str) -> bool:
    """The check of account numbers: the first four characters go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".") if m[0].count(".") > 2 else ()
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ssn_valid(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Check:
    """valid: whether a match stands at all; sure: whether that is a checksum, which raises the score."""

    valid: Callable[[str], bool]
    sure: bool = False


_CHECKS = {
    "iban": Check(lambda found: mod97(found.replace(" ", "")), True),
    "ssn": Check(_ssn_valid),
    "local_phone": Check(lambda found: found[0] > "1"),
    "birth_date": Check(lambda found: "01" <= found[5:7] <= "12" and "01" <= found[8:] <= "31"),
}
_BASE_SPANS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def score(text: str, kind: str, start: int, end: int, sure: bool) -> int:
    """Worth of the pattern, of its checksum and of the words nearby."""
    near = text[max(0, start - BEFORE) : start].translate(_SMALL), text[end : end + AFTER].translate(_SMALL)
    words = CONTEXT * (any(map(_FOR[kind].search, near)) - any(map(_AGAINST.search, near)))
    return WORTH[kind] + CONFIRMED * sure + words


def find(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind's place in KINDS, end, score) of all spans, by start and kind."""
    spans = [(a, k, b, score(text, kind, a, b, kind == "card")) for k, kind in enumerate(BASE) for a, b in _BASE_SPANS[kind](text)]
    taken = [(a, b) for a, _, b, _ in spans]
    for k, kind in enumerate(ADDED, len(BASE)):
        check = _CHECKS[kind]
        more = [m.span() for m in _ADDED[kind].finditer(text) if check.valid(m[0])]
        more = [(a, k, b, score(text, kind, a, b, check.sure)) for a, b in more]
        more = [x for x in more if x[3] >= THRESHOLD and not any(a < x[2] and x[0] < b for a, b in taken)] if more else more
        taken += [(a, b) for a, _, b, _ in more]
        spans += more
    return sorted(spans)


def masked(text: str, spans: list[tuple[int, int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, done = [], 0
    for a, k, b, _ in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k]}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


SPANS = "array<struct<kind string, start int, end int, score int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.int32())])
_NAMES = pa.array(KINDS)


def _found(batches: Iterator[pa.RecordBatch], mask: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, flat, texts = [0], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = find(text)
            flat += spans
            ends.append(len(flat))
            if mask:
                texts.append(masked(text, spans))
        start, kind, end, points = (pa.array(c, pa.int32()) for c in zip(*flat, strict=True)) if flat else (pa.array([], pa.int32()),) * 4
        spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([_NAMES.take(kind), start, end, points], fields=list(_SPAN)))
        columns = [batch.column(0), spans] + ([pa.array(texts, pa.string())] if mask else [])
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "masked"][: len(columns)])


def find_personal_data(documents: DataFrame, mask: bool = False) -> DataFrame:
    """A row for each row of documents: doc_id, spans (kind, start, end in code points, score; by start and kind) and, if asked for, the masked text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_found, mask=mask), f"doc_id long, spans {SPANS}" + (", masked string" if mask else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_pii: counts, digest and list of the spans of every document."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for the query: the patterns as they are stated, matched as wholes."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    } | PATTERNS
    matches = " UNION ALL ".join(f"SELECT r, doc_id, text, '{k}' AS kind, {n} AS nth, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM doc" for n, (k, p) in enumerate(patterns.items()))
    speaks = " ".join(f"WHEN '{k}' THEN '\\b({w})\\b'" for k, w in SPEAKS_FOR.items())
    worth = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WORTH.items())
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({matches}),
span AS (
  SELECT r, text, kind, nth, m[k] AS found, length(m[k]) AS n, regexp_replace(m[k], '[^0-9]', '', 'g') AS digits,
    CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM matched, unnest(range(1, len(m) + 1)) t(k)
), checked AS (
  SELECT *, a + n AS b,
    translate(text[greatest(1, a - {BEFORE - 1}):a], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS left_words,
    translate(text[a + n + 1:a + n + {AFTER}], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS right_words,
    CASE kind {speaks} END AS speaks
  FROM span
  WHERE CASE kind
    WHEN 'ip' THEN list_max(list_transform(string_split(found, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INTEGER) END)) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19
      AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER) ELSE 2 * CAST(x AS INTEGER) - CASE WHEN x > '4' THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN list_reduce([CAST(0 AS BIGINT)] || list_transform(string_split(replace(found, ' ', '')[5:] || found[1:4], ''), lambda x: CAST(CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END AS BIGINT)),
      lambda m, v: (m * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    WHEN 'ssn' THEN found[1:3] NOT IN ('000', '666') AND found[1:3] < '900' AND found[5:6] <> '00' AND found[8:] <> '0000'
    WHEN 'local_phone' THEN found[1:1] > '1'
    WHEN 'birth_date' THEN found[6:7] BETWEEN '01' AND '12' AND found[9:10] BETWEEN '01' AND '31'
    ELSE true END
), scored AS (
  SELECT *, CASE kind {worth} END + CASE WHEN kind IN ('card', 'iban') THEN {CONFIRMED} ELSE 0 END
    + CASE WHEN regexp_matches(left_words, speaks) OR regexp_matches(right_words, speaks) THEN {CONTEXT} ELSE 0 END
    - CASE WHEN regexp_matches(left_words, '\b({SPEAKS_AGAINST})\b') OR regexp_matches(right_words, '\b({SPEAKS_AGAINST})\b') THEN {CONTEXT} ELSE 0 END AS points
  FROM checked
), base AS (SELECT r, kind, nth, a, b FROM scored WHERE nth < {len(BASE)}),
{"".join(f'''k{n} AS (
  SELECT * FROM {prior} UNION ALL
  SELECT s.r, s.kind, s.nth, s.a, s.b FROM scored s WHERE s.nth = {n} AND s.points >= {THRESHOLD}
    AND NOT EXISTS (SELECT 1 FROM {prior} p WHERE p.r = s.r AND p.a < s.b AND s.a < p.b)
),
''' for n, prior in [(n, "base" if n == len(BASE) else f"k{n - 1}") for n in range(len(BASE), len(KINDS))])}
told AS (
  SELECT r, {counts},
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) FILTER (WHERE nth < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) AS spans
  FROM k{len(KINDS) - 1} GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN told USING (r)
"""
