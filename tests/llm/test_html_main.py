import html
import re

import pytest

from memlake.llm.html_main import main_text, parse


def text_of(page):
    return " ".join(parse(page)[0])


@pytest.mark.parametrize("page, text", [
    ("<article><h1>A &amp; B</h1><p>One <b>tw</b>o<br>three&nbsp; four<p>five</article>", "A & B One two three four five"),
    ("<body><nav>Menu</nav><main><p>Body</p><form>Mail <input></form></main><footer>(c)</footer>", "Body"),
    ("<div class='site-header'>Top</div><div id='content'><p>In</p><div class='cookieNotice'>Ok?</div></div>", "In"),
    ("<article>Story<section id=comments><article>Nice!</article></section></article>", "Story"),
    ("<article><header class='entry-header'><h1>T</h1></header>x</article><header>site</header>", "T x"),
    ("<p>a<script>if (a < b) '</p>'</script>b</p><!-- c --><style>p{}</style>", "ab"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a b 1 2"),
    ("x < y & z &lt; &#233;&bogus; <b unclosed", "x < y & z < é&bogus; <b unclosed"),
    ("<div class='has-comments'><article class='post comments-open'>a</article><article class='comment'>b</article></div>", "a"),
    ("<div role=banner>b</div><div hidden>h</div><div style='display: none'>n</div><p>k</p>", "k"),
    ("<p>cut <i>off", "cut off"), ("", ""), (None, ""), ("plain", "plain"),
    ("<main><h1>Head</h1><p>A story that is much longer than the rest.</p><article class=card>Teaser</article></main>",
     "Head A story that is much longer than the rest. Teaser"),
    ("<main><h1>Head</h1><p>Lead</p><div>x</div><article>A story that is longer.</article><p>after</p></main>",
     "Head Lead A story that is longer."),
    ("<div class='elementor-widget-text-editor'><p>Story</p></div><div class='ad-slot'>Buy</div>", "Story"),
    ("<div class='page sidebar-right'><p>The story of the page</p><div class='sidebar-right'>Links</div></div>", "The story of the page"),
    ("<article><div class='product-reviews-intro'>Words</div><p>More</p></article>", "Words More"),
    ("<article>Sum <math><mi>x</mi></math> <label>of</label> <object>all</object></article>", "Sum x of all"),
    ("<div class=widget><p>All there is</p></div>", "All there is"),
    ("<p>Short</p><div id=comments>Much longer than the text of the page itself.</div>", "Short"),
    ("<article><p>The notice was read.</p><p class='lead'>Comments follow.</p></article>", "The notice was read. Comments follow."),
])
def test_parse(page, text):
    assert text_of(page) == text


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_recurring_subtrees_go(spark):
    body = "<div><div><p>Words of page {0}, long enough to be most of what it says, as articles are.</p></div><div><p>Call us today</p></div></div>"
    rows = [(i, f"https://shop.example.com/{i}", body.format(i)) for i in range(8)]
    rows += [(100 + i, f"https://h{i}.example.com/", body.format(i)) for i in range(8)]
    got = texts(main_text(pages(spark, rows)))
    for i in range(8):
        assert "Call us" not in got[i] and f"page {i}," in got[i]
        assert "Call us" in got[100 + i]


def test_template_of_few_pages_of_a_host(spark):
    """A block on a tenth of the pages goes, lists and tables in articles among them; copies of a page count once."""
    note = "<ul><li>Sale</li><li>until May</li></ul>"
    page = "<article><p>Page {0} tells of {0}, in words enough to be most of the page.</p>{1}<ul><li>yes</li><li>own {0}</li></ul></article>"
    rows = [(i, f"http://big.example.com/{i}", page.format(i, note if i % 10 == 0 else "")) for i in range(200)]
    rows += [(1000 + i, "http://big.example.com/copy", page.format("copied", "<table><tr><td>cell</td></tr></table>")) for i in range(50)]
    got = texts(main_text(pages(spark, rows).repartition(3)))
    for i in range(200):
        assert got[i] == f"Page {i} tells of {i}, in words enough to be most of the page. yes own {i}"
    assert got[1000].endswith("cell yes own copied")


def test_counts_against_plain_ones(spark, rng):
    """Which subtrees of a generated host go, by counting the pages that hold them one by one."""
    boxes = [f"<div><p>box {k}</p></div>" for k in range(12)]
    rows = []
    for i in range(120):
        held = [b for k, b in enumerate(boxes) if rng.random() < (k + 1) / 60]
        rows.append((i, "http://one.example.com/", f"<div><p>{'long text of page %d ' % i * 6}</p>{''.join(held)}</div>"))
    counts = {b: sum(b in page for _, _, page in rows) for b in boxes}
    template = {b for b, n in counts.items() if n >= 6}
    assert 0 < len(template) < len(boxes)
    got = texts(main_text(pages(spark, rows)))
    for i, _, page in rows:
        for k, b in enumerate(boxes):
            assert (f"box {k}" in re.findall(r"box \d+", got[i])) == (b in page and b not in template)


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>a" * 8000, "<div>a" * 8000 + "</section>" * 8000, "<div class=x>" * 8000 + "end" + "</div>" * 8000):
        start = time.process_time()
        parse(page)
        assert time.process_time() - start < 1


def test_shared_paragraphs_of_articles_stay(spark):
    rows = [(i, "http://a.example.com/x", f"<article><p>Own {i}</p><p>A passage on all pages.</p></article>") for i in range(9)]
    assert all(t == f"Own {i} A passage on all pages." for i, t in texts(main_text(pages(spark, rows))).items())


def test_given_pages_against_their_article(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = texts(main_text(df))
    for r in df.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].rindex("</article>")]
        inner = re.sub("</?b>", "", re.sub("</?(?:h1|p|br)>", " ", inner))
        assert got[r["page_id"]] == " ".join(html.unescape(inner).split())


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "x", None), (2, "http://h/", ""), (3, "", "<p>" * 3000)]
    got = main_text(pages(spark, rows).selectExpr("*", "1 AS text", "2 AS blocks", "3 AS host", "4 AS template"))
    assert sorted(r["text"] for r in got.collect()) == ["", "", "", "a", "a"]
    assert main_text(pages(spark, [])).collect() == []
