import math
import re
import time

import pytest

from acreflow.llm import htmltext


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &lt; text\n  two", "plain < text two"), ("<p", ""), ("<script>x", ""), ("<p>a<br>b<p>c", "a b\nc"), ("<p>a<b>b</b> c</p><!-- no -->", "ab c"),
        ("<body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>Some &amp; text.<p>More.</article><footer>f</footer>", "T\nSome & text.\nMore."),
        ("<div class='page with-sidebar'><article><p>Body text here.</p><aside>no</aside><section class='comments'><p>hi</section></article></div><div id=sidebar>s</div>", "Body text here."),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<div class='ad'>buy</div><article><p>x<style>p{}</style> y</p><form><p>mail</form></article>", "x y"),
        ("<main><p>a</p><div role=complementary><p>b</p></div><p>c</main>", "a\nc"),
        ('<article><p>x <a href="foo>text</a> more</p><p>two <b class="y">b</b></article>', "x text more\ntwo b"), ("<article><p title='a > b <i>' class=x>it's</p></article>", "it's"), ('<p class="a>b', "b"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <label>a label</label> <span hidden>and more</span></p></article>", "Let x=2 be a label and more"),
        ("<p>&copy; &#233; &#x263a; &nope; 1 &lt 2</p>", "© é ☺ &nope; 1 < 2"),
    ],
)
def test_pages(page, text):
    assert htmltext.main_text(page) == text


def test_unlabelled_boilerplate():
    links = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div><p>{'A long paragraph of the story. ' * 20}</p><p>{'Another one with words. ' * 20}</p></div></div>"
    text = htmltext.main_text(page)
    assert text.startswith("A long paragraph") and "Section 3" not in text


STORY = f"<div><p>{'A long paragraph of the story. ' * 20}</p><p>{'Another one with words. ' * 20}</p></div>"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(30)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "has", "not_has"),
    [
        (f"<body>{LINKS}<div>{'Bare text of the story. ' * 9}<br>goes <b>on</b> here.{STORY}</div>", ["Bare text", "goes on here.", "A long", "Another"], ["Section 3"]),
        (f"<body>{LINKS}<div><h2>Short title</h2>{STORY}</div>", ["Short title", "A long"], ["Section 3"]),
        (f"<body>{LINKS}<div>{STORY}<p>Short.</p> and <i>bare</i> {STORY}</div>", ["Short.", "and bare"], ["Section 3"]),
        (f"<body>{LINKS}<article><p>First part.</p>{STORY}</article><p>Between.</p>{LINKS}<article><p>Second part.</article>{LINKS}", ["First part.", "Between.", "Second part."], ["Section 3"]),
        (f"<body><div><article>{STORY}</article></div>{LINKS}<div><article><p>Second part.</article></div>", ["A long", "Second part."], ["Section 3"]),
    ],
)
def test_parts_beside_the_best_one(page, has, not_has):
    text = htmltext.main_text(page)
    assert all(x in text for x in has) and not any(x in text for x in not_has)


def test_bare_text_between_parts_that_are_kept():
    """The best node is inside one part; a short text lies between it and another dense part."""
    text = htmltext.main_text(f"<body>{LINKS}<section>{STORY}</section>Short words.<p>{'Dense text of the story. ' * 10}</p>")
    assert "A long" in text and "Short words." in text and "Dense text" in text and "Section 3" not in text


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = htmltext.page_texts(pages).toPandas()
    html = pages.toPandas().set_index("page_id").html
    assert len(got) == len(html) and (got.n_chars == got.text.str.len()).all()
    for page_id, text in zip(got.page_id, got.text, strict=True):
        body = re.search(r"<article>(.*?)(?:</article>|$)", html[page_id], re.S)[1]
        parts = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|li|ul)>", "\n", body.replace("<br>", " ")))
        import html as h

        assert text == "\n".join(x for x in (re.sub(r"\s+", " ", h.unescape(p)).strip() for p in parts.split("\n")) if x)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (1, "u", "<p>a</p>", "y"), (1, "u", "<p>a</p>", "y"), (2, "u", "<div>" * 3000 + "deep" + "<p>x " * 20000, "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.page_texts(frame).collect()
    assert sorted(r.text[:4] for r in got) == ["", "a", "a", "a", "deep"]
    assert htmltext.page_texts(frame.limit(0)).count() == 0


def tree(node):
    """A parsed page as nested (tag, parts)."""
    return node.tag, [tree(x) if isinstance(x, htmltext.Node) else x for x in node.parts]


def plain_densities(root):
    """(density, sum of the children's densities) of every node of a nested page, parents first, by the published definition with the base of the logarithm one more."""
    def counts(node):
        tag, parts = node
        below = [counts(x) for x in parts if isinstance(x, tuple)]
        chars = sum(c[0] for c in below) + sum(len(x.replace(" ", "")) for x in parts if isinstance(x, str) and x.strip())
        link_chars, links = (chars, 1 + sum(c[3] for c in below)) if tag == "a" else (sum(c[2] for c in below), sum(c[3] for c in below))
        return chars, sum(c[1] + 1 for c in below), link_chars, links

    chars, _, link_chars, _ = counts(root)
    share = link_chars / max(chars, 1)

    def density(node):
        c, t, lc, lt = counts(node)
        t = max(t, 1)
        ratio = (c / max(lc, 1)) * (t / max(lt, 1))
        if not c or ratio <= 1:
            return 0.0
        return c / t * math.log(ratio) / math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e) + 1)

    def walk(node):
        children = [x for x in node[1] if isinstance(x, tuple)]
        yield density(node), sum(map(density, children))
        for x in children:
            yield from walk(x)

    return list(walk(root))


def test_densities_against_the_definition(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40).collect()]
    for page in [*pages, f"<body>{LINKS}<div>{STORY}</div>{LINKS}", "<p>x", "<a>y</a>"]:
        root = htmltext.parse(page)
        nested = tree(root)
        nodes = htmltext._measure(root)
        want = plain_densities(nested)
        for k in (0, 1):
            assert sorted((x.density, x.total)[k] for x in nodes) == pytest.approx(sorted(x[k] for x in want), rel=1e-6, abs=1e-6)
        assert max(x.total for x in nodes) == pytest.approx(max(t for _, t in want))


def test_density_alone_finds_the_article_of_real_pages(spark):
    """No article or menu is marked as such; the text is that of the marked page, which needs no density."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = 0
    for page in pages:
        bare = re.sub(r"<(/?)(?:nav|article)\b[^>]*>", r"<\1div>", page)
        text = htmltext.main_text(bare)
        everything = "\n".join(htmltext._blocks(htmltext.parse(bare)))
        assert text != everything  # the menu at least is gone
        same += text == htmltext.main_text(page)
    assert same >= 0.9 * len(pages)


def test_an_article_does_not_override_density():
    """The densest part is kept beside an article, and an article that is a list of links is not kept for its tag."""
    teaser = f"<article>{LINKS}</article>"
    text = htmltext.main_text(f"<body>{teaser}<div>{STORY}</div></body>")
    assert "A long" in text and "Section 3" not in text
    text = htmltext.main_text(f"<body><article>{STORY}</article><div><p>{'Dense text beside the article. ' * 20}</p></div></body>")
    assert "A long" in text and "Dense text beside" in text


def test_unclosed_quotes_take_time_in_proportion():
    began = time.process_time()
    for page in ('<a href="x>y ' * 60_000, "<a title='x>y</a> " * 60_000, '<a b="c" ' * 60_000, "<p>it's " * 60_000):
        htmltext.main_text(page)
    assert time.process_time() - began < 20


LONG = "A long paragraph of an article about things that matter, with many words and no link at all. " * 5


def middle(part):
    """What is left of a part between two long paragraphs of one article."""
    page = f'<html><body><nav><a href="/">Home</a></nav><article><p>{LONG}</p>{part}<p>{LONG}</p></article><footer>Foot</footer></body></html>'
    lines = htmltext.main_text(page).split("\n")
    assert lines[0] == lines[-1] == LONG.strip()
    return lines[1:-1]


@pytest.mark.parametrize(
    "part",
    [
        '<section id="discussion"><h2>Discussion</h2><p>We found it.</p></section>', '<h2 id="search-algorithms">Search algorithms</h2>', '<p class="market-share">Its share of the market grew.</p>',
        '<div id="related-work">Others did so before.</div>', '<p aria-label="social history">Once upon a time.</p>', '<div class="post-header"><h1>A title</h1></div>', '<div class="header"><h1>Another title</h1></div>',
        "<fieldset>In a set of fields stands text.</fieldset>", "<dialog open>Two people talk.</dialog>", "<canvas>In place of a picture.</canvas>", '<ul class="notice-period"><li>Three months</li></ul>',
        '<blockquote class="comment">As the report says.</blockquote>', '<section class="widget-theory"><p>On widgets.</p></section>', '<div data-class="ad">No advert.</div>',
    ],
)
def test_parts_of_the_article_stay(part):
    assert middle(part) == [x for x in re.sub(r"<[^>]+>", "\n", part).split("\n") if x]


@pytest.mark.parametrize(
    "part",
    [
        '<div class="ad">Buy this now, it is cheap and good for you and all of your friends.</div>', '<div class="cookie-notice">We use cookies.</div>', '<div id="comments"><p>Nice words from a reader who likes it very much.</p></div>',
        '<section class="comments"><h2>Comments</h2><p>First! I like it a lot.</p></section>', '<div class="related"><a href="a">One more story</a> <a href="b">Two more stories</a></div>', '<div class="sideBar">Words at the side</div>',
        '<div role="navigation">Home and more</div>', "<form><p>Name</p><input></form>", '<ul class="share-buttons"><li><a href="x">Tell</a><li><a href="y">Show</a></ul>', '<div class="site-footer">Imprint</div>',
    ],
)
def test_other_parts_go(part):
    assert middle(part) == []


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "</span>" * 90_000, "<p><button><b>" + "<b>" * 90_000 + "<ul></ul>" * 60_000, "<nav>" + "<div>" * 90_000 + "</span>" * 90_000, "<table>" + "<tr><td>" * 90_000 + "</p>" * 90_000])
def test_time_grows_with_the_length(page):
    began = time.time()
    htmltext.main_text(page + "<p>text")
    assert time.time() - began < 8
