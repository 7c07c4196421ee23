"""Images within office files as rows, and engines that read them: members of archives in the order of their names, each bounded, faults as rows."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.registry import query, table

# Where office files keep their images, which members are images, and the labels that readers know.
FOLDERS = {".docx": "word/media/", ".pptx": "ppt/media/", ".xlsx": "xl/media/"}
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
IMAGE_LABEL, MEMBER_LABEL = "图片", "内嵌图片 %d"
MOST = 64 << 20  # bytes of a member

MEDIA = "path string, place int, label string, member string, bytes long, sha256 string, content binary, error_code string"

#: Bytes of an image -> (text, score from 0 to 1) of each of its lines.
Engine = Callable[[bytes], list[tuple[str, float]]]


def _members(path: str, content: bytes, most: int) -> Iterator[tuple]:
    suffix = posixpath.splitext(path)[1].lower()

    def row(place: int, label: str, member: str | None, data: bytes | None, code: str | None = None, size: int | None = None) -> tuple:
        return path, place, label, member, len(data) if data is not None else size, hashlib.sha256(data).hexdigest() if data is not None else None, data, code

    if suffix in IMAGES:
        yield row(1, IMAGE_LABEL, None, content)
    elif suffix in FOLDERS:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = sorted(n for n in archive.namelist() if n.lower().startswith(FOLDERS[suffix]) and posixpath.splitext(n)[1].lower() in IMAGES)
                for place, name in enumerate(names, start=1):
                    try:
                        with archive.open(name) as member:  # what an archive says of a member's size is not relied on
                            data = member.read(most + 1)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError):
                        yield row(place, MEMBER_LABEL % place, name, None, "unreadable_member")
                        continue
                    fits = len(data) <= most
                    yield row(place, MEMBER_LABEL % place, name, data if fits else None, None if fits else "member_too_large", archive.getinfo(name).file_size)
        except zipfile.BadZipFile:
            yield row(0, "", None, None, "unreadable_archive")


def _rows(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    columns = [f.split()[0] for f in MEDIA.split(", ")]
    held, size = [], 0
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            for row in _members(path or "", content or b"", most):
                held.append(row)
                size += row[4] or 0
                if len(held) >= 1000 or size >= most:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def media(files: DataFrame, most: int = MOST) -> DataFrame:
    """MEDIA of (path, content): the image itself, or the images within an office file; other files have none. A member of over `most` bytes has no content
    but an error, as one that can't be read has; so has an archive that is none."""
    return files.select("path", "content").mapInPandas(partial(_rows, most=most), MEDIA)


def _read(frames: Iterator[pd.DataFrame], load: Callable[[], Engine]) -> Iterator[pd.DataFrame]:
    engine: Engine | None = None
    for frame in frames:
        out = []
        for path, place, label, content in zip(frame["path"], frame["place"], frame["label"], frame["content"], strict=True):
            engine = engine or load()  # once for a task, and only if it has images
            lines = engine(bytes(content))
            text = "\n".join(t.strip() for t, _ in lines if t and t.strip())
            if text:
                out.append((path, place, label, text, round(sum(s for _, s in lines) / len(lines), 6)))
        yield pd.DataFrame(out, columns=["path", "place", "label", "text", "confidence"])


def recognised(images: DataFrame, load: Callable[[], Engine]) -> DataFrame:
    """path, place, label, text, confidence of images (media()) by an engine that each task loads once; images without text have no row."""
    rows = images.filter("content is not null").select("path", "place", "label", "content")
    return rows.mapInPandas(partial(_read, load=load), "path string, place int, label string, text string, confidence double")


# --- query: a supplier is an office file ---------------------------------------------------------------------------------------------------------------


def _archives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Office files as archives, by their keys: two images of their own in any letter case, a member that is no image, one elsewhere; every seventh is broken."""
    for frame in frames:
        out = []
        for key in frame["key"]:
            suffix, folder = list(FOLDERS.items())[key % 3]
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, data in ((f"{folder}image2.PNG", f"two{key}" * 50), (f"{folder.upper()}image1.jpeg", f"one{key}"), (f"{folder}x.emf", "no"), ("docProps/a.png", "no")):
                    archive.writestr(name, data)
            out.append((f"/in/{key}{suffix}", held.getvalue()[:-30] if key % 7 == 0 else held.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query("embedded_media", r"""WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'ppt' ELSE 'xl' END AS folder, '/in/' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.pptx' ELSE '.xlsx' END AS path FROM supplier)
SELECT path, 1 AS place, '内嵌图片 1' AS label, upper(folder) || '/MEDIA/image1.jpeg' AS member, sha256('one' || k) AS sha256, NULL AS error_code FROM s WHERE k % 7 > 0
UNION ALL SELECT path, 2, '内嵌图片 2', folder || '/media/image2.PNG', sha256(repeat('two' || k, 50)), NULL FROM s WHERE k % 7 > 0
UNION ALL SELECT path, 0, '', NULL, NULL, 'unreadable_archive' FROM s WHERE k % 7 = 0""")
def embedded_media(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key")).mapInPandas(_archives, "path string, content binary")
    return media(files).select("path", "place", "label", "member", "sha256", "error_code")
