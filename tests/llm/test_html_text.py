import html
import re

from vigilog.llm.html_text import main_text, main_texts

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice">We use cookies, ok.</div>
<div class="wrap has-sidebar"><div class="topmenu menu"><ul><li>Home<li>About</ul></div><div id="content"><h1>Title &amp; more</h1>
<p>First para, with words. And more of it, here.<p>Second <b>bo</b>ld&nbsp;para<br>x, with many words; indeed.<script>var a="</p>"</script>
<div class="comments"><p>Great article, thanks a lot! I like it, really.</p></div></div><div class="sidebar"><p>Related: a, b, c.</p></div></div>
<form><p>Sign up</p></form><div class=footer>copyright, all.</div></body></html>"""


def test_article_among_other_parts():
    assert main_text(PAGE) == "Title & more First para, with words. And more of it, here. Second bold para x, with many words; indeed."


def test_odd_pages():
    assert main_text("") == "" and main_text("plain < text &amp; a <b") == "plain < text & a <b"
    assert main_text("<!-- never") == "" and main_text("<nav>a</nav>") == "" and main_text("<p>x") == "x"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>Some words, here.</p>" * 20000 + "</article>")) == 20000 * 18 - 1


def test_every_given_page(spark, small):
    rows = {x.page_id: x for x in main_texts(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    for page in spark.read.parquet(f"{small}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", page.html)[1]
        plain = re.sub(r"<[^>]*>", lambda m: "" if re.match("</?b>", m[0]) else " ", article)
        assert rows[page.page_id].text == " ".join(html.unescape(plain).split())
        assert rows[page.page_id].n_chars == len(rows[page.page_id].text)


def test_nulls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (2, "u", "", "z"), (2, "u", "", "z")], "page_id bigint, url string, html string, text string")
    got = sorted((x.page_id or 0, x.url or "", x.text, x.n_chars) for x in main_texts(pages).collect())
    assert got == [(0, "u", "a", 1), (1, "", "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert main_texts(pages.where("page_id > 9")).collect() == []


def test_parts_beside_the_largest_container_stay():
    some = "Some sentence of the article, with words; and marks, too. " * 3
    long = "".join(f"<p>{k}. {some}</p>" for k in range(20))
    plain = " ".join(f"{k}. {some}".strip() for k in range(20))
    for frame in ("<div id=x>%s</div>", "<div><h1>T</h1>%s</div>", "<section>%s</section>"):
        page = "<html><body><div class=nav><a>Home</a></div>" + frame + "<div class=footer>f</div></body></html>"
        title = "T " if "<h1>" in frame else ""
        got = main_text(page % f"<div class=lead><p>Lead. {some}</p></div><div class=part>{long}</div><div class=end><p>End. {some}</p></div>")
        assert got == f"{title}Lead. {some}{plain} End. {some}".strip()
        table = "".join(f"<tr><td>{k}. {some}</td></tr>" for k in range(20))
        got = main_text(page % f"<p>Lead. {some}</p><table>{table}</table><p>End. {some}</p>")
        assert got == f"{title}Lead. {some}{plain} End. {some}".strip()
