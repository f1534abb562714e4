import io
import zipfile

import pytest

from graphloom.sources import documents as d


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="urn:p" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_front_matter_and_titles():
    found, body = d.front_matter('---\ntitle: "My Doc"\ntags:\n  - a\n  - b\ndraft: true\n---\n# Head\n')
    assert found == {"title": "My Doc", "tags": ["a", "b"], "status": "DRAFT"} and body == "# Head\n"
    assert d.front_matter("---\ntitre: Fin\n...\nBody\n---\n") == ({"title": "Fin"}, "Body\n---\n")
    assert d.front_matter("---\nkeywords: [x, 'y']\nstatus: draft\n---\n")[0] == {"tags": ["x", "y"], "status": "DRAFT"}
    assert d.first_heading("# 1. Introduction\ntext\n# Real title") is None  # the file's name is the better title
    assert d.first_heading("text\n # Real title\n# Other") == "Real title" and d.is_generic("2. Glossary:") and d.is_generic("Scope")
    assert d.extract("a/b_c.txt", b"# not a heading\n")["title"] == "b c" and not d.extract("x.txt", b"t")["structured"]
    with pytest.raises(ValueError):
        d.detect("x.bin", b"\xff\xfe\x00\x80")


def test_html():
    page = """<html><head><title>T</title><meta property="og:title" content="Big &amp; small"></head><body><nav>menu</nav><main><h1>H</h1><p>One&nbsp;two <b>x</b></p>
    <ul><li>a</li><li>b</li></ul><aside>side</aside><div class="navbox">box<div>in</div></div><table><tr><th>k|1</th><td>v</td></tr></table>
    <figure><img src="pic.png" width="300"><figcaption>Figure 1: cat</figcaption></figure><img src="dot.gif" width="1"></main><footer>foot</footer></body></html>"""
    text, images = d.html_markdown(page.replace("One", "One " + "long " * 60))
    assert "# H" in text and "- a" in text and "| k/1 | v |" in text and "<!-- image 1 -->" in text
    assert not any(x in text for x in ("menu", "side", "box", "foot"))
    assert [(i["src"], i["caption"]) for i in images] == [("pic.png", "Figure 1: cat")] and d.html_title(page) == "Big & small"


def test_office():
    doc = zipped(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'
                    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
                    "docProps/core.xml": '<c xmlns:dc="urn:dc"><dc:title>Core</dc:title></c>'})
    got = d.extract("x", doc)
    assert (got["format"], got["title"], got["text"]) == ("docx", "Core", "# Top\n\n- item\n\n| a/b | c |")
    slide = lambda *t: f"<p:sld {A}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:sld>"
    deck = zipped(**{"ppt/presentation.xml": f'<p:presentation {A}><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:presentation>',
                     "ppt/_rels/presentation.xml.rels": '<R><x Id="r1" Target="slides/slide1.xml"/><x Id="r2" Target="slides/slide2.xml"/></R>',
                     "ppt/slides/slide1.xml": slide("Second"), "ppt/slides/slide2.xml": slide("First", "point"),
                     "ppt/slides/_rels/slide2.xml.rels": '<R><x Id="n" Target="../notesSlides/n.xml"/></R>', "ppt/notesSlides/n.xml": slide("Say this", "1")})
    text, title, pages = d.pptx(deck)
    assert pages == 2 and text.split("\n\n") == ["## Diapositive 1 : First", "- point", "Notes : Say this", "## Diapositive 2 : Second"] and title is None


def test_pdf_layout():
    page = lambda n, *rows: f'<page number="{n}" height="1000">' + "".join(f'<text top="{t}" left="10" font="{f}">{x}</text>' for t, f, x in rows) + "</page>"
    xml = ('<pdf><fontspec id="0" size="10" family="Serif"/><fontspec id="1" size="16" family="Serif"/><fontspec id="2" size="10" family="Courier"/>'
           + page(1, (20, 0, "Header 1"), (200, 1, "Chapter"), (300, 0, "Body text runs to an exam-"), (320, 0, "ple here."), (340, 0, "• point"), (400, 2, "x = 1"))
           + page(2, (20, 0, "Header 2"), (300, 0, "More body text.")) + page(3, (20, 0, "Header 3"), (300, 0, "End of body.")) + "</pdf>")
    text, pages = d.pdf_markdown(xml)
    assert pages == 3 and "Header" not in text and "# Chapter" in text and "an example here." in text and "- point" in text and "```\nx = 1\n```" in text and "<!-- page 2 -->" in text


def test_urls():
    base = "https://a.org/x/y.html"
    assert [d.resolve_url(base, u) for u in ("z.png", "/r", "../up", "//b.org/q", "mailto:x@y", "http://c.org", "#f")] == [
        "https://a.org/x/z.png", "https://a.org/r", "https://a.org/up", "https://b.org/q", None, "http://c.org", None]
    assert d.url_id("https://a.org/x/y.html?q=1") == "url/a.org/x/y.html-q-1" and d.url_file_name("https://a.org/", "text/html; charset=x") == "index.html"
    with pytest.raises(ValueError):
        d.fetch("file:///etc/passwd")


def test_folder(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_text("---\ntags: x\n---\n# Title A\nText.")
    (tmp_path / "docs/sub/b c.html").write_text("<html><body><article><p>Hi there</p></article></body></html>")
    (tmp_path / "docs/.hidden.md").write_text("no")
    (tmp_path / "docs/empty.txt").write_text(" ")
    got = {r.id: r for r in d.read_folder(spark, str(tmp_path / "docs")).collect()}
    assert set(got) == {"a.md", "sub/b-c.html", "empty.txt"} and got["a.md"].title == "Title A" and got["a.md"].tags == ["x"]
    assert got["sub/b-c.html"].content == "Hi there" and got["empty.txt"].error
    assert d.listing(spark, str(tmp_path / "docs")).count() == 3


def layout(words, image=""):
    return f'<pdf2xml><page number="1" height="1000" width="700"><fontspec id="0" size="10" family="Serif"/><text top="300" left="50" font="0">{words}</text>{image}<text top="980" left="340" font="0">12</text></page></pdf2xml>'


def test_pdf_images_stand_in_place_and_stay_inside_the_folder(tmp_path):
    (tmp_path / "work").mkdir()
    (tmp_path / "work" / "a.png").write_bytes(b"picture")
    (tmp_path / "secret.png").write_bytes(b"no")
    load = d.folder_file(str(tmp_path / "work"))
    assert load("a.png") == b"picture" and load("../secret.png") is None and load("none.png") is None
    size = 'top="400" left="9" width="80" height="80"'
    text, pages, images = d.pdf_layout(layout("Some words", f'<image {size} src="a.png"/><image {size} src="../secret.png"/><image top="1" left="1" width="59" height="80" src="a.png"/>'), load)
    assert text == "<!-- page 1 -->\nSome words\n<!-- image 1 -->" and pages == 1  # the page number in the margin goes
    assert images == [{"n": 1, "page": 1, "data": b"picture"}]


@pytest.mark.parametrize("words, structured", [("one two three four five six seven", True), ("scan", False)])
def test_pdf_falls_back_to_plain_text(tmp_path, words, structured):
    def tool(command, data, then=lambda folder: None):
        (tmp_path / "out.xml").write_text(layout(words))
        return {"pdfinfo": b"Title:  Plan B \nPages:  1\n", "pdftotext": "infor-\nmation Rhine-\nMain\fnext".encode()}.get(command[0], b""), then(str(tmp_path))

    got = d.pdf(b"%PDF", tool)
    assert got["title"] == "Plan B" and got["structured"] is structured
    assert words in got["text"] if structured else got["text"] == "information Rhine-\nMain\n\nnext" and got["pages"] == 2


def test_absent_converters_are_named():
    with pytest.raises(ValueError, match="no-such-tool"):
        d.run_tool(["no-such-tool", "{in}"], b"x")
    assert d.run_tool(["cat", "{in}"], b"x") == (b"x", None)


def test_page_images_are_bounded_and_failures_left_out():
    asked = []

    def get(url, most, timeout):
        asked.append(url)
        if "bad" in url:
            raise OSError
        return "f", b"data"

    images = [{"src": "a.png"}, {"src": "bad.png"}, {"src": "mailto:x"}, {"src": "", "data": b"own"}, {"src": "/b.png"}, {"src": "c.png"}, {"src": "data:image/png;base64,b3du"}, {"src": "data:image/png;base64,!"}]
    got = d.page_images(images, "https://x.org/p/q", get, most=3)
    assert [(i["src"], i["data"]) for i in got] == [("https://x.org/p/a.png", b"data"), ("", b"own"), ("https://x.org/b.png", b"data"), ("", b"own")] and len(asked) == 3


def test_diagnosis():
    from graphloom.models import Patterns

    assert d.diagnosis("a.txt", b"Some text.") == "Some text."
    assert isinstance(d.diagnosis("a.txt", b"Ada Lovelace met Charles Babbage in London.", Patterns()), str)
