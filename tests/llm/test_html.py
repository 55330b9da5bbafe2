"""Main text of pages."""

import html as entities
import re

from lodeseek.llm import html

SF = "/root/testdata/sf0.001"


def test_article_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>)", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<(/?b)>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_noise_is_removed_by_tags_and_classes():
    page = """<html><body><header>Site</header><div id="cookie-notice">We use cookies</div><main><h1>T&eacute;st</h1>
    <p>One <b>two</b><br>three &amp;\n four&#33;<aside>x</aside><div class="adBox"> </div><p>five<ul><li>six<li>seven</ul>
    <form>f<input></form><section class="comments"><article>me too</article></section></main><div class=sidebar>s</div><script>a="</p>"</script></body>"""
    assert html.main_text(page) == "Tést\n\nOne two three & four!\n\nfive\n\nsix\n\nseven"


def test_odd_pages():
    assert html.main_text("") == ""
    assert html.main_text("just < text & more") == "just < text & more"
    assert html.main_text("<article><p>a<p>b</article") == "a\n\nb"
    assert html.main_text('<article><a href="x>link</a><p>b</article>') == "link\n\nb"
    assert html.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.main_text("<!-- a <article>no</article> --><p>yes<!-- open") == "yes"


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div><p>Welcome to the site</p></div><div class=text><p>Story {i} of many</p></div></body>") for i in range(20)]
    rows += [(100, "http://lonely.example/", "<body><div><p>Welcome to the site</p></div></body>"), (101, None, None), (102, "x", "")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert all(got[i] == f"Story {i} of many" for i in range(20))
    assert got[100] == "Welcome to the site" and got[101] == "" and got[102] == ""
    assert html.extract(df.limit(0)).count() == 0


def texts(spark, rows):
    """Texts of (url, html) rows, in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in html.extract(df).orderBy("page_id").collect()]


def test_copies_of_a_page_keep_their_text(spark):
    marked, bare = "<body><article><h1>T</h1><p>text</p></article></body>", "<body><div><p>one</p><p>two</p><p>three</p></div></body>"
    assert texts(spark, [("http://a/", marked)] * 5 + [("http://b/", bare)] * 20) == ["T\n\ntext"] * 5 + ["one\n\ntwo\n\nthree"] * 20
    # copies don't make what is on few distinct pages look repeated
    assert texts(spark, [("http://c/", f"<body><p>Text {i % 3}</p></body>") for i in range(60)]) == [f"Text {i % 3}" for i in range(60)]


def test_a_marked_article_below_repeated_branches_stays(spark):
    page = "<body><div class=a><div class=b><article><h1>T</h1><p>text</p></article></div></div><div class=c><p>{}</p></div></body>"
    assert texts(spark, [("http://a/", page.format(i)) for i in range(8)]) == ["T\n\ntext"] * 8


def test_repeated_lists_and_empty_elements_go(spark):
    menu = "".join(f"<li>Item {k}</li>" for k in range(20))
    page = f"<body><ul class=top>{menu}</ul><div class=x>Hello<br></div><div class=y><p>Same</p><p></p><hr></div><table><tr><td>a<td>b<td>c</table><div class=text><p>Story {{}}</p></div></body>"
    assert texts(spark, [("http://a/", page.format(i)) for i in range(9)]) == [f"Story {i}" for i in range(9)]


def test_one_page_and_few_pages_are_no_tree(spark):
    page = "<body><div><p>a{0}<p>b{0}<p>c{0}<p>d{0}<p>e{0}<p>f{0}</div><p class=z>Same</body>"
    for n in (1, 4):
        assert all(x.endswith("Same") for x in texts(spark, [("http://a/", page.format(i)) for i in range(n)]))
    pages = spark.createDataFrame([("http://a/", page.format(0))], "url string, html string")
    assert html.style_trees(pages).count() == 0


def test_entropies_are_to_the_base_of_the_pages_that_hold_the_element(spark):
    rows = [("http://a/", f"<body><p>Menu<p>More<p>Part {i // 4}<div>{i}</div></body>") for i in range(16)]
    got = sorted(round(r["importance"], 6) for r in html.style_trees(spark.createDataFrame(rows, "url string, html string")).collect())
    # p: two texts on 16 of 16 pages, one on 4 of 16; root and body: one sequence; div: 16 texts
    assert got == [0.0, 0.0, round(1 - (16 + 16 + 16 * 0.5) / 48, 6), 1.0]


def test_blocks_in_inline_elements_count(spark):
    page = "<body><section><a href=x><div>Story {}</div></a></section><section class=s><a href=x><div>Same</div></a></section></body>"
    assert html.main_text(page.format(1)) == "Story 1\n\nSame"
    assert texts(spark, [("http://a/", page.format(i)) for i in range(6)]) == [f"Story {i}" for i in range(6)]


def test_what_a_host_repeats_goes_from_marked_articles_too(spark):
    page = "<body><article><h1>Title {0}</h1><div class=box><p>All stories of this site are free.</p></div><p>Story {0}</p><section><div class=who>By us<br></div></section></article></body>"
    same = "<body data-id={0}><article><h1>T</h1><p>text</p></article><p>{0}</p></body>"
    rows = [("http://a/", page.format(i)) for i in range(7)] + [("http://b/", same.format(i)) for i in range(7)]
    assert texts(spark, rows) == [f"Title {i}\n\nStory {i}" for i in range(7)] + ["T\n\ntext"] * 7
