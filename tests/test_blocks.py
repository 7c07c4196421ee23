"""Blocks, splits, cleaning and asset links on hand-made texts."""

import re
from docmill.operators import blocks as B

TEXT = "# A\n\nOne. Two!\nthree\n\n### B\n| x | y |\n| 1 | 2 |\n\n````\n```\ncode. here\n```\n````\n$$\nE = m\n$$\n![i](assets/p.png)\n## C\nlast"


def test_parse():
    got = list(B.parse(TEXT))
    assert [(g[0].split("\n")[0], g[1], g[2], g[3]) for g in got] == [("# A", 1, 1, False), ("One.", 3, 3, False), ("Two!", 3, 3, False), ("three", 4, 4, False), ("### B", 6, 6, False), ("| x | y |", 7, 8, True), ("````", 10, 14, True), ("$$", 15, 17, True), ("![i](assets/p.png)", 18, 18, True), ("## C", 19, 19, False), ("last", 20, 20, False)]
    assert got[5][4] == ["A", "B"] and got[-1][4] == ["A", "C"] and got[0][4] == ["A"] and got[4][4] == ["A", "B"]
    assert list(B.parse("")) == []


def test_parse_of_links_formulas_and_fences():
    first = lambda text: [(c, a, z, atomic) for c, a, z, atomic, _ in B.parse(text)]
    assert first("See ![x](./assets/p.png) here. And. ") == [("See ![x](./assets/p.png) here. And.", 1, 1, True)]
    assert first("[X](ASSETS/p) x") == [("[X](ASSETS/p) x", 1, 1, True)]
    assert first("$$ a\nb. $$ c") == [("$$ a\nb.", 1, 2, False), ("$$ c", 2, 2, False)]
    assert first("$$ a $$\n$$x\n$$\ny $$\n$$\nz") == [("$$ a $$", 1, 1, True), ("$$x", 2, 2, False), ("$$\ny $$\n$$", 3, 5, True), ("z", 6, 6, False)]
    assert first("      ```\na. b\n        ```` \nc") == [("      ```\na. b\n        ```` ", 1, 3, True), ("c", 4, 4, False)]
    assert first("a\u2028b.\x0cc") == [("a\nb.", 1, 2, False), ("c", 3, 3, False)]
    assert [c[4] for c in B.parse("One. # Two\nx")] == [[], []] and [c[4] for c in B.parse("# \n#\tT \nx")] == [[], ["T"], ["T"]]


def test_sentence_blocks():
    assert B.sentence_blocks("a. b！c\n\nd\n# H\n$$x$$\ne") == ["a.", "b！", "c", "d", "# H", "$$x$$", "e"]
    assert B.sentence_blocks("p. q\n```\nx. y\n```\nr") == ["p. q\n```\nx. y\n```", "r"]
    assert B.sentence_blocks("p. q\n$$ \nx. y\n $$\nr. s") == ["p. q", "$$ \nx. y\n $$", "r.", "s"]
    assert B.sentence_blocks("") == [] and B.sentence_blocks("$$\na. b") == ["$$\na.", "b"]


def test_oversized_pieces_fit_and_keep_all_words():
    text = " ".join(f"word{i}{'.' if i % 9 == 0 else ''}" for i in range(500))
    pieces = B.split_oversized(text, 40)
    assert " ".join(pieces).split() == text.split() and all(B.tokens(p) <= 40 for p in pieces)
    assert B.split_oversized("| a | " * 100, 5) == ["| a | " * 100]
    rest_like_a_table = "word " * 40 + "| " * 200  # only a whole text that begins as a table stays whole
    assert all(B.tokens(p) <= 31 for p in B.split_oversized(rest_like_a_table, 31)) and B.split_oversized("fits. whole", 9) == ["fits. whole"]


def test_clean():
    assert B.clean("# A\r\n\r\n\r\n#### B\n\\(x\\)\n```\n\n\n# c") == "# A\n\n## B\n$x$\n```\n\n\n# c\n```\n"
    assert B.clean(B.clean(TEXT)) == B.clean(TEXT) and B.clean("") == ""


def test_rebase_assets():
    assert B.rebase_assets("[a](assets/x) `[a](assets/x)`\n```\n[a](assets/x)\n```\n[b](assets/y)", "../s") == "[a](../s/assets/x) `[a](assets/x)`\n```\n[a](assets/x)\n```\n[b](../s/assets/y)"


def test_tokens_agree_with_the_column(spark):
    from pyspark.sql import functions as F

    from docmill.functions.text import token_estimate

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", token_estimate(F.col("text")).alias("t")).collect()
    assert all(B.tokens(r.text or "") == r.t for r in rows)


def test_shortcuts_for_ascii_and_plain_lines_change_nothing():
    """The short ways of tokens() and pieces_of() against the patterns that they stand for."""
    import random

    from docmill.operators import blocks as B

    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B9", "_", "-", "'", " ", "\n", ".", "!", "\x1c", "\t", "|", "`", "。", "é"]) for _ in range(rng.randint(0, 20)))
        bare = B._CJK.sub("", text)
        assert B.tokens(text) == max(1, len(text) - len(bare) + len(B._WORD.findall(bare)) - (-len(B._MARK.findall(bare)) // 4))
        assert B.pieces_of(text) == [x for x in re.split(r"(?<=[。！？.!?])\s*", text.strip()) if x]
