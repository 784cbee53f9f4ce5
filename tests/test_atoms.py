"""Atoms of markup, navigation and safe reading of archives."""

import io
import zipfile

import pytest

from folioquarry.operators import atoms as A
from folioquarry.sources import epub as E

SCHEMA = "document_id string, ordinal int, kind string, spine_path string, semantic_path string, parent_path string, classes string, style string, continues boolean, page_break boolean, text string"


def atoms(spark, *rows):
    return spark.createDataFrame([("d", n, kind, spine, f"{spine}/{n}" if own is None else own, "body", "", "", False, turn, text) for n, (kind, spine, own, turn, text) in enumerate(rows)], SCHEMA)


def test_boundaries_and_blocks(spark):
    df = atoms(spark, ("heading", "a", None, False, "Chapter One"), ("heading", "a", None, False, "The Beginning"), ("paragraph", "a", None, False, "A sentence that goes on, "), ("paragraph", "a", None, True, "over the page and is cut at a hyph-"),
               ("paragraph", "a", None, False, "en, as it happens."), ("paragraph", "a", None, False, "Another one."), ("list_item", "a", None, False, "first,"), ("list_item", "a", None, False, "second"), ("paragraph", "b", "x", False, "one"), ("paragraph", "b", "x", False, "Box"))
    merges = [r.merges for r in A.boundaries(df).orderBy("ordinal").collect()]
    assert merges == [False, True, False, True, True, False, False, False, False, True]
    blocks = [(r.kind, r.text, r.atoms) for r in A.reflowed(df).orderBy("block_no").collect()]
    assert blocks == [("heading", "Chapter One\nThe Beginning", 2), ("paragraph", "A sentence that goes on, over the page and is cut at a hyphen, as it happens.", 3), ("paragraph", "Another one.", 1), ("list_item", "first,", 1), ("list_item", "second", 1), ("paragraph", "one Box", 2)]
    assert A.reflowed(df.limit(0)).count() == 0


def test_entries_find_their_atoms(spark):
    df = atoms(spark, *[("paragraph", f, None, False, "t") for f in "aabbc"])
    entries = spark.createDataFrame([("d", 0, "a", ""), ("d", 1, "b", "x"), ("d", 2, "b", "nowhere"), ("d", 3, "z", ""), ("d", 4, "c", "")], "document_id string, entry_no int, spine_path string, fragment string")
    anchors = spark.createDataFrame([("d", "b", "x", 3)], "document_id string, spine_path string, fragment string, ordinal int")
    placed = A.placed_entries(entries, anchors, df)
    assert {r.entry_no: r.ordinal for r in placed.collect()} == {0: 0, 1: 3, 2: 2, 3: None, 4: 4}
    assert {r.ordinal: r.entry_no for r in A.chapters_of(df, placed).collect()} == {0: 0, 1: 0, 2: 2, 3: 1, 4: 4}


NAV = b"""<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="x">no</a></li></ol></nav>
<nav epub:type="toc"><ol><li><a href="a.xhtml">One</a><ol><li><div><a href="a.xhtml#s1">One&nbsp;and a half</a></div></li><li><span>no link</span></li></ol></li><li><a href="../b.xhtml#t%20t">Two</a></li><li><a href="http://out.org/">out</a></li></ol></nav></body></html>"""
NCX = b"""<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>Sub</text></navLabel><content src="a.xhtml#s"/></navPoint></navPoint></navMap></ncx>"""


def test_navigation():
    assert E.navigation(NAV, "OEBPS/nav.xhtml") == [("One", "OEBPS/a.xhtml", "", 0), ("One and a half", "OEBPS/a.xhtml", "s1", 1), ("Two", "b.xhtml", "t t", 0)]
    assert E.navigation(NCX, "OEBPS/toc.ncx") == [("One", "OEBPS/a.xhtml", "", 0), ("Sub", "OEBPS/a.xhtml", "s", 1)] and E.navigation(b"<html/>", "n") == []


def test_text_between_blocks_and_kinds():
    page = b"<html><body>before<div>loose <b>bold</b><p>para</p> after</div><blockquote><p>said</p></blockquote><p class='footnote'>note</p><pre>a\n  b</pre><script>x</script><ul><li>item</li></ul></body></html>"
    got = [(k, t) for _, k, t in E._blocks(E.parse_xml(page), "")]
    assert got == [("paragraph", "before"), ("paragraph", "loose bold"), ("paragraph", "para"), ("paragraph", "after"), ("blockquote", "said"), ("footnote", "note"), ("verse", "a\n  b"), ("list_item", "item")]


@pytest.mark.parametrize("data", [b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', ("<!--" + "x" * 9000 + "-->" + '<!DOCTYPE a [<!ENTITY x "y">]><a/>').encode("utf-16"), b'<!DOCTYPE html SYSTEM "http://other.org/x.dtd"><html/>', b"<a>", b"<a>&nosuch;</a>"])
def test_refused_xml(data):
    with pytest.raises((ValueError, E.ElementTree.ParseError)):
        E.parse_xml(data)


def test_accepted_xml():
    assert E.parse_xml(b'<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd"><html>a&nbsp;b &amp; c<!-- <!ENTITY --></html>').text == "a b & c"


def test_archive_rules():
    def made(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members:
                z.writestr(name, data)
        return zipfile.ZipFile(out)

    assert E.problem(made(("a", b"0" * 900_000))) is None and E.problem(made(("a", b"0" * 9_000_000))) == "too large"
    assert E.problem(made(("a/../b", b"x"))) and E.problem(made(("a//b", b"x"))) and E.problem(made(("a/", b""), ("a/b", b"x"))) is None
