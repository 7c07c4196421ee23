"""Images within office files: order, bounds, broken archives and members, engines."""

import io
import zipfile

from docmill.sources import office_media as M


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_rows(spark):
    good = archive(("xl/media/b.png", b"two"), ("xl/media/A.TIFF", b"blank"), ("xl/media/c.wmf", b"no"), ("word/media/d.png", b"no"))
    bad = bytearray(archive(("ppt/media/a.png", b"first" * 20), ("ppt/media/b.png", b"x")))
    at = bad.index(b"first")
    bad[at : at + 5] = b"worst"  # the check sum of the member no longer holds
    rows = [("/a.XLSX", good), ("/b.pptx", bytes(bad)), ("/c.docx", b"no archive"), ("/d.PNG", b"own"), ("/e.txt", good), (None, b"x"), ("/f.docx", None), ("/g.docx", archive(("word/media/big.png", b"y" * 100), ("word/media/ok.png", b"z" * 50)))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = M.media(files, most=50)
    found = {(r.path, r.place): (r.label, r.member, bytes(r.content) if r.content is not None else None, r.bytes, r.error_code) for r in got.collect()}
    assert found == {
        ("/a.XLSX", 1): ("内嵌图片 1", "xl/media/A.TIFF", b"blank", 5, None),
        ("/a.XLSX", 2): ("内嵌图片 2", "xl/media/b.png", b"two", 3, None),
        ("/b.pptx", 1): ("内嵌图片 1", "ppt/media/a.png", None, None, "unreadable_member"),
        ("/b.pptx", 2): ("内嵌图片 2", "ppt/media/b.png", b"x", 1, None),
        ("/c.docx", 0): ("", None, None, None, "unreadable_archive"),
        ("/d.PNG", 1): ("图片", None, b"own", 3, None),
        ("/f.docx", 0): ("", None, None, None, "unreadable_archive"),
        ("/g.docx", 1): ("内嵌图片 1", "word/media/big.png", None, 100, "member_too_large"),
        ("/g.docx", 2): ("内嵌图片 2", "word/media/ok.png", b"z" * 50, 50, None),
    }
    whole = {(r.path, r.place): r.error_code for r in M.media(files).collect()}
    assert whole["/b.pptx", 1] == "unreadable_member" and whole["/g.docx", 1] is None
    assert M.media(files.limit(0)).collect() == []


def test_engines(spark):
    def loaded():
        calls = []

        def engine(data):
            calls.append(data)
            return [] if data == b"blank" else [(" a ", 0.5), ("", 0.2), (f"call {len(calls)}", 1.0)]

        return engine

    files = spark.createDataFrame([(f"/{k}.png", b"blank" if k == 2 else b"x") for k in range(4)], "path string, content binary").coalesce(1)
    got = {r.path: (r.label, r.text, r.confidence) for r in M.recognised(M.media(files), loaded).collect()}
    # one engine for the task: its calls are counted on
    assert got == {"/0.png": ("图片", "a\ncall 1", 0.566667), "/1.png": ("图片", "a\ncall 2", 0.566667), "/3.png": ("图片", "a\ncall 4", 0.566667)}
