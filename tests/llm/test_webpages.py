from procura.llm import webpages

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Menu {i}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div>{body}<aside>side</aside><form><p>mail</p></form><div class="comments"><p>first!</p></div><footer>&copy; {i}</footer><script>if(a<b){{}}</script></body></html>"""


def extract(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, main string, host int")
    return {r.page_id: r.text for r in webpages.extract(df).collect()}


def test_article_text_block_by_block(spark):
    body = '<article><h1>T &amp; U</h1><p>One <b>tw</b>o\n  three<p>Four&nbsp;5<ul><li>five<li>six</ul><span class="ad">buy</span><div class="share">Share</div><table><tr><td>a<td>b</table>tail</article>'
    expected = "T & U\nOne two three\nFour 5\nfive\nsix\na\nb\ntail"
    found = extract(spark, [(i, f"http://a.org/{i}", PAGE.format(i=i, body=body)) for i in range(3)])
    assert found == {i: expected for i in range(3)}


def test_main_slot_is_deduced_where_no_element_names_it(spark):
    rows = [(i, f"http://b.org/{i}", PAGE.format(i=i, body=f'<div class="wrap"><div class="body"><p>{"text %d " % i * 30}</p><p>end {i}</p></div><div class="tools">Print this page</div></div>')) for i in range(10)]
    found = extract(spark, rows)
    for i in range(10):
        assert found[i] == " ".join(["text %d" % i] * 30) + f"\nend {i}"


def test_template_text_in_the_main_slot_is_no_content_but_short_sites_keep_it(spark):
    page = lambda i: PAGE.format(i=i, body=f"<article><p>Read more below</p><p>story {i} {'word ' * i}</p></article>")
    found = extract(spark, [(i, f"http://c.org/{i}", page(i)) for i in range(12)] + [(100 + i, f"http://d.org/{i}", page(i)) for i in range(3)])
    assert found[4] == "story 4 word word word word" and found[101] == "Read more below\nstory 1 word"


def test_classes_share_vectors_on_their_host(spark):
    rows = [(f"h{i % 2}", i, PAGE.format(i=i, body="<article>" + "<p>x</p>" * (i + 1) + "</article>")) for i in range(6)]
    found = {r.host: r for r in webpages.templates(spark.createDataFrame(rows, "host string, page long, html string")).collect()}
    assert found["h0"].main == found["h1"].main == "html>body>article"


def test_nulls_broken_markup_long_pages_and_repeats(spark):
    long = "<article>" + "<p>long text here</p>" * 20_000
    rows = [(1, None, None), (2, "x", ""), (3, "http://e.org/", "plain &lt;text&gt; <!-- open"), (4, "http://e.org/2", "<article><p>unclosed <b>bold"), (5, "http://f.org/", long), (6, "http://g.org/", "<div><p>a</div></article>b")]
    found = extract(spark, rows)
    assert found == {1: "", 2: "", 3: "plain <text>", 4: "unclosed bold", 5: "\n".join(["long text here"] * 20_000), 6: "a\nb"}
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert [r.text for r in webpages.extract(df).collect()] == ["a", "a"]
    assert webpages.extract(df.limit(0)).collect() == []


def story(i, words=120):
    import random

    rng = random.Random(i)
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(words))


def test_copies_and_versions_of_one_article_keep_it(spark):
    body = f"<article><h1>Title</h1><p>{story(1)}</p><p>Summary</p><p>{story(2)}</p></article>"
    rows = [(i, f"http://copy.org/{i}", PAGE.format(i=i, body=body)) for i in range(8)]
    rows += [(100 + i, f"http://near.org/{i}", PAGE.format(i=i, body=body.replace("Summary", f"Summary {i}"))) for i in range(40)]
    rows += [(200, "http://copy.org/0", rows[0][2])] * 3
    found = extract(spark, rows)
    assert {found[i] for i in [*range(8), 200]} == {f"Title\n{story(1)}\nSummary\n{story(2)}"}
    assert all(found[100 + i] == f"Title\n{story(1)}\nSummary {i}\n{story(2)}" for i in range(40))


def test_a_long_repeated_block_is_template_text(spark):
    notice = "This text is shown on every page of this site, whatever the page is about, and it is longer than eighty characters."
    page = "<html><body><div class=q1><p>Welcome to the site</p></div><div class=q2><p>{}</p><p>" + notice + "</p><p>{}</p></div><div class=q3>All rights kept</div></body></html>"
    found = extract(spark, [(i, f"http://g.org/{i}", page.format(story(i), story(1000 + i))) for i in range(20)])
    assert all(found[i] == f"{story(i)}\n{story(1000 + i)}" for i in range(20))


def test_pages_of_another_layout_use_their_own_article(spark):
    rows = [(i, f"http://l.org/{i}", f"<html><body><div class=top>Top line</div><div class=text><p>{story(i)}</p></div></body></html>") for i in range(12)]
    rows += [(50, "http://l.org/x", f"<html><body><main><p>{story(77)}</p></main><div class=other>{story(78, 5)}</div></body></html>")]
    found = extract(spark, rows)
    assert all(found[i] == story(i) for i in range(12)) and found[50] == story(77)


def test_deep_and_broken_markup_takes_linear_time():
    import time

    cases = ["<div>" * 8000 + "x", "<section><p>" * 8000, "<title" * 20_000, '<x y="' * 20_000, "<x y='\"" * 20_000 + ">", "<p>" + "<span>" * 20_000, "<!--" * 50_000, "</div>" * 50_000 + "<", "<" * 200_000 + ">", "<li><ul>" * 8000 + "</p>" * 8000, "<style>" * 30_000, "a<b " * 100_000]
    for case in cases:
        start = time.perf_counter()
        webpages.main_text(case * (1 + 1_000_000 // len(case) if case.startswith(("a<", "<!--")) else 1), None, [], frozenset())
        assert time.perf_counter() - start < 5, case[:20]
    assert webpages.main_text("<p>a <b c='>'>d</b> e < f <g h=\"", None, [], frozenset()) == "a d e < f <g h=\""


def test_tokens_of_repeated_rows_do_not_cancel(spark):
    page = PAGE.format(i=1, body=f"<article><p>{story(5)}</p></article>")
    rows = [("h", 7, page)] * 4 + [("h", 8, PAGE.format(i=2, body=f"<article><p>{story(6)}</p><p>x</p></article>"))]
    found = webpages.templates(spark.createDataFrame(rows, "host string, page long, html string")).first()
    assert found.main == "html>body>article" and found.texts == 2 and found.constant == []
