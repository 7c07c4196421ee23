"""Conversion of files made here; faults become rows."""

import io
import zipfile

import pytest

from docmill.sources import convert as C


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


W = '<d xmlns:w="w"><w:body>%s</w:body></d>'


def test_html():
    page = b"<html><head><title>x</title></head><body><script>no()</script><h2>A &amp; B</h2><p>One <b>two</b> <a href='u'>three</a></p><ul><li>x<li>y</ul><table><tr><th>a<td>p|q</td></tr></table><pre>k\n  v</pre></body>"
    text = C.html(page)
    assert text.startswith("## A & B\n\nOne **two** [three](u)\n\n- x\n- y\n") and "no()" not in text and "```\nk\n  v\n```" in text
    assert C.html(b"") == "\n"


def test_office():
    doc = zipped({"word/document.xml": W % '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'})
    assert C.docx(doc) == "## Head\n\none two\n\n| a |  |\n| --- | --- |\n"
    slide = '<s xmlns:p="p" xmlns:a="a"><p:sp><p:ph type="title"/><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:sp></s>'
    deck = zipped({f"ppt/slides/slide{k}.xml": slide % f"T{k}" for k in (10, 2)})
    assert C.pptx(deck) == "<!-- Slide number: 1 -->\n\n# T2\n\n<!-- Slide number: 2 -->\n\n# T10\n"
    book = zipped({
        "xl/workbook.xml": '<w xmlns:r="r"><sheets><sheet name="S" r:id="i"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": '<r><x Id="i" Target="worksheets/sheet1.xml"/></r>',
        "xl/sharedStrings.xml": "<s><si><t>hi</t></si></s>",
        "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></w>',
    })
    assert C.xlsx(book) == "## S\n\n| hi |  | 3 |\n| --- | --- | --- |\n|  | x |  |\n"
    novel = zipped({"META-INF/container.xml": '<c><rootfile full-path="o/b.opf"/></c>', "o/b.opf": '<p><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="a"/></p>', "o/a.xhtml": "<p>A</p>", "o/b.xhtml": "<p>B</p>"})
    assert C.epub(novel) == "B\n\nA\n"


def test_faults_are_rows(spark):
    bomb = b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'
    files = [("a/x.txt", "é".encode()), ("b.json", b"{"), ("c.pdf", b"%PDF"), ("d.XML", b"<r><k>v</k></r>"), ("e.xml", bomb), ("f.docx", b"PK"), ("g.csv", None), (None, b"x")]
    rows = {r.path: r for r in C.to_markdown(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert rows["a/x.txt"].markdown == "é" and rows["d.XML"].markdown == "- r\n  - k: v\n"
    assert {p: r.error_code for p, r in rows.items() if r.error_code} == {"b.json": "conversion_failed", "c.pdf": "unsupported_suffix", "e.xml": "conversion_failed", "f.docx": "conversion_failed", None: "unsupported_suffix"}
    assert rows["g.csv"].markdown == "\n"
    with pytest.raises(ValueError, match="already"):
        C.converter(".txt", C.decode)
