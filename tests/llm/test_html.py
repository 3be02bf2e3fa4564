import pytest

from stageledger.llm import html_extraction as hx

PAGE = '<html><head><title>T</title><script>x("<p>")</script></head><body><nav><a href="/">m{i}</a></nav><div class="ad">buy {i}</div><article><h1>Head {i}</h1><p>One &amp; <b>two</b>three<br>four<p>five  \n six<div class="comments">no {i}</div></article><footer>&copy; {i}</footer>'


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in hx.main_text(pages).collect()}


def test_article_stays_and_boilerplate_goes(spark):
    got = texts(spark, [(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(6)])
    assert got == {i: f"Head {i} One & twothree four five six" for i in range(6)}


def test_entropy_decides_without_an_article(spark):
    page = "<body><div id=top>Welcome to our site</div><div id=mid><p>Story number {i}</p></div><div id=low>All the same</div></body>"
    got = texts(spark, [(i, f"http://h.example/{i}", page.replace("{i}", str(i))) for i in range(8)])
    assert got == {i: f"Story number {i}" for i in range(8)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a", ""), (3, "nothing", "<p>a &am"), (4, "http://b", "<article>x<p"), (4, "http://b", "<article>x<p"), (None, "http://b", "a < b <3 c"), (5, "http://c", '<article>q<a href="u>v</article>'), (6, "http://d", "<article>" + "w " * 50000), (7, "http://e", "<article><!-- gone <p>")]
    got = texts(spark, rows)
    assert got == {1: "", 2: "", 3: "a &am", 4: "x", None: "a < b <3 c", 5: "qv", 6: " ".join(["w"] * 50000), 7: ""}
    assert texts(spark, []) == {}


def test_siblings_with_other_verdicts_are_other_nodes(spark):
    long = " ".join(f"col{c}" * 4 for c in "abcdefgh")
    rows = [
        (1, "http://a", "<article><p hidden>gone</p><p>All the text</p></article>"),
        (2, "http://b", "<article><p>All the text</p><p aria-hidden=true>gone</p></article>"),
        (3, "http://c", "<div role=navigation>gone</div><div>Main text</div>"),
        (4, "http://d", "<div>Main text</div><div role=navigation>gone</div>"),
        (5, "http://e", '<article><p style="display: none">gone</p><p>All the text</p></article>'),
        (6, "http://f", f'<div class="{long} sidebar">gone</div><div class="{long} solid">Main text</div>'),
        (7, "http://g", '<p>beside <span role=main>Main text</span></p>'),
        (8, "http://h", '<div class="w-1/2"><p hidden>gone</p><p>Main text</p></div>'),
    ]
    got = texts(spark, rows)
    assert got == {1: "All the text", 2: "All the text", 3: "Main text", 4: "Main text", 5: "All the text", 6: "Main text", 7: "Main text", 8: "Main text"}


def test_entropy_decides_on_both_sides_of_an_article(spark):
    page = "<body><article><p>Story number {i}</p><div class=box>Follow us for more</div></article><section><p>Analysis number {i}</p></section><section class=same>Made in our office</section></body>"
    rows = [(i, f"http://h.example/{i}", page.replace("{i}", str(i))) for i in range(8)]
    assert texts(spark, rows) == {i: f"Story number {i} Analysis number {i}" for i in range(8)}


def test_copies_of_a_page_count_once(spark):
    same = "<body><nav>menu {i}</nav><p>The whole text</p></body>"
    rows = [(i, f"http://h.example/{i}", same.replace("{i}", str(i))) for i in range(4)] + [(9, "http://a", same)] * 3
    assert texts(spark, rows) == {i: "The whole text" for i in (0, 1, 2, 3, 9)}


STORY = "<h1>The harbour</h1><p>Boats came in at dawn, and the market opened.</p>"
WRAPPERS = ["site has-sidebar", "layout no-sidebar", "social-science", "page-with-menu", "search-page", "cookies-recipe"]


@pytest.mark.parametrize("body", [f'<div class="{w}"><article>{STORY}</article></div>' for w in WRAPPERS] + [f'<form id="aspnetForm"><article>{STORY}</article></form>', f'<article class="related-story">{STORY}</article>', f'<div class="social-science"><div>{STORY}</div></div>', f'<div class="site has-sidebar"><div>{STORY}</div></div>'])
def test_a_name_never_blanks_a_page(body):
    page = f'<body><nav>Menu one two</nav>{body.replace("</h1>", "</h1><div class=share-buttons>Share this</div>")}<footer>Imprint</footer></body>'
    kept = {p for p, b in hx.branches(page).items() if not b.boiler}
    assert hx.extract(page, kept) == "The harbour Boats came in at dawn, and the market opened."


def test_names_still_judge_what_is_beside_an_article():
    page = f'<body><div class="sidebar"><article class="teaser">Other news</article><p>More</p></div><article>{STORY}</article><div class="social-links">Follow</div><form>Mail <input></form></body>'
    kept = {p for p, b in hx.branches(page).items() if not b.boiler}
    assert hx.extract(page, kept) == "The harbour Boats came in at dawn, and the market opened."
    for bare in ('<div class="menu">Home Shop</div><div class="footer">Imprint</div>', '<div class="menu">Home Shop</div>', f'<div hidden><article>{STORY}</article></div>'):
        assert hx.extract(bare, {p for p, b in hx.branches(bare).items() if not b.boiler}) == ""
