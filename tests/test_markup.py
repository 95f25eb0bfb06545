"""Pages to text by the tag state machine, and repair of wrongly decoded text."""

import pytest
from pyspark.sql import functions as F

from siftstone.functions import markup
from siftstone.functions import text as T

PAGES = [
    ("<p>one<p>two</p>", "\none\ntwo"),
    ("<script>var t = '</p>' + 1 < 2;</script>a<style>p{}</style>b", "ab"),
    ("a<!-- <b>no</b> -->b<!DOCTYPE html>c", "abc"),
    ("&lt;p&gt; &amp;amp; &eacute;&#233;&#xe9; &copy &nosuch;", "<p> &amp; ééé © &nosuch;"),
    ("<div><template><p>x</p></template><noscript>y</noscript>z</div>", "\nz"),
    ("<script>never closed <p>text", ""),
    ("</script>stray</p> end", "stray end"),
    ("x<br/>y<BR>z", "x\ny\nz"),
    ("<ul><li>1<li>2</ul><h2 class='a>b'>t</h2>", "\n1\n2\nt"),
    ("plain & simple", "plain & simple"),
    ("", ""),
]


def test_pages(spark):
    assert [markup.page_text(h) for h, _ in PAGES] == [t for _, t in PAGES]
    df = spark.createDataFrame([(n, h) for n, (h, _) in enumerate(PAGES)] + [(99, None)], "n int, h string")
    got = {r.n: r.t for r in df.select("n", markup.html_text(F.col("h")).alias("t")).collect()}
    assert got == {n: t for n, (_, t) in enumerate(PAGES)} | {99: None}


def test_the_profile_chooses_the_path(spark):
    html = "<p>a &eacute;</p><script>var x = 1;</script>"
    df = spark.createDataFrame([(html,), ("no tags &eacute;",), (None,)], "raw_text string")
    flat, tree = ([r.text for r in T.clean(df, profile=T.CleaningProfile(tree_html=t)).collect()] for t in (False, True))
    assert flat[0] == "a &eacute;var x = 1;" and tree == ["a é", "no tags &eacute;", ""]
    log = T.clean(df, profile=T.CleaningProfile(tree_html=True)).first().log
    assert [(r.op, r.detail) for r in log][3] == ("html_strip", f"parsed HTML; {len(html) - 4} chars removed") and log[3].chars_after == 4


def damaged(text, times=1, encoding="latin-1"):
    for _ in range(times):
        text = text.encode().decode(encoding)
    return text


CLEAN = ["plain ascii", "größe und Maß", "déjà vu à l'été «É» 5€", "ñandú ¿qué? ¡sí!", "漢字かな交じり", "naïve – “quoted” …", "Ã", "É«x»", "x²+y³ ±1 ©", "emoji 😀", "À bientôt", ""]


@pytest.mark.parametrize("times", [1, 2, 3])
def test_planted_damage_is_repaired(times):
    for t in CLEAN:
        back, places = markup.repaired(damaged(t, times))
        assert back == t and (places > 0) == any(ord(c) > 127 for c in t)


def test_windows_damage_and_mixed_text():
    for t in ("größe", "“quoted – déjà", "5€"):
        assert markup.repaired(damaged(t, 1, "cp1252"))[0] == t
    assert markup.repaired("fine é, " + damaged("broken é") + ", fine ü") == ("fine é, broken é, fine ü", 1)


def test_clean_text_is_untouched(spark):
    for t in CLEAN:
        assert markup.repaired(t) == (t, 0)
    df = spark.createDataFrame([(damaged("é ü"),), ("é ü",), (None,)], "raw_text string")
    rows = T.clean(df, profile=T.CleaningProfile(repair_encoding=True)).collect()
    assert [r.text for r in rows] == ["é ü", "é ü", ""] and [r.log[0].detail for r in rows] == ["repaired 2 place(s)", "", ""]
    assert (rows[0].log[0].chars_before, rows[0].log[0].chars_after) == (5, 3)
    assert T.clean(df).first().log[0].detail == "ftfy not installed; skipped"
