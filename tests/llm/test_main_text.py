from meterlake.llm import main_text as M


def text(page, template=frozenset()):
    found = M.tokens_of(page)
    return M.main_text(found, M.page_keys(found), set(template))


def test_article_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x">x</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
    <article><h1>Head &amp; shoulders</h1><p><b>First  bold
    text.<br><p>Second <i>in</i>line&nbsp;x</p><aside>no</aside><div class="comments"><p>no</p></div>
    <form><input value=">"><button>no</button></form><ul><li>one<li>two</ul></article><footer>&copy; no</footer>"""
    assert text(page) == "Head & shoulders\nFirst bold text.\nSecond inline x\none\ntwo"


def test_page_without_article():
    page = "<body><header>no</header><div id=content><p>yes<div>also</div>tail</div><div role='navigation'>no</div><div class='cookie-notice'>no</div></body>"
    assert text(page) == "yes\nalso\ntail"


def test_broken_markup():
    assert text("") == ""
    assert text("just text") == "just text"
    assert text("a < b & c &lt;p&gt; <p") == "a < b & c <p>"
    assert text("<article>x<script>never closed <p>no") == "x"
    assert text("<article>kept") == "kept"
    assert text("<p a=\"1>2\" b='<'>v</p>") == "v"
    assert text("<main><p>in</p></main><p>out</p>") == "in"
    assert text("<article>one<!-- open") == "one"


def test_raw_elements_end_where_they_end():
    assert text('<article>a<svg width="1"/> b<p>c<math display="block" />d</p><svg><text>no</text></svg>e</article>') == "a\nb\ncd\ne"
    assert text("<article>a <svg><svg><text>no</text></svg><text>no</text></svg>b</article>") == "a\nb"
    assert text("<article>a<svg>b<p>c</p><svg><text>no</text></svg>d</article>") == "a\nb\nc\nd"
    assert text("<p>x <math><mi>y</mi><mo>=</mo><mspace/><mn>2</mn></math> z</p>") == "x y=2 z"
    assert text("<p>x <object data='a'>no plugin</object> <canvas>a chart</canvas> z</p>") == "x no plugin a chart z"
    assert text("<p>one<svg><path d=''/><p>two<noscript><p>three<iframe src='x'><p>four<template><p>five") == "one\ntwo\nthree\nfour\nfive"
    for name in ("script", "style", "textarea", "title"):
        assert text(f"<p>one</p><{name}>no<p>no") == "one"


def test_class_words_take_out_no_article():
    for label in ('class="content-sidebar-wrap"', 'class="no-sidebar"', 'id="page-with-header"', 'class="widget-area"', 'class="sidebar"', 'id="comments"'):
        assert text(f"<div {label}><p>no</p><article><p>all of it</p></article></div>") == "all of it"
        assert text(f"<div {label}><div class=widget><div role=main>all of it</div></div></div>") == "all of it"
    inside = '<h2 id="related-work">Work</h2><section id="notice-period">Notice</section><p class="reply-to">Reply</p><p class="big comments">no</p><p id="ad_banner">no</p>'
    assert text(f"<article>{inside}</article>") == "Work\nNotice\nReply"
    assert text('<article>x</article><div class="comments"><article class="comment">no</article></div>') == "x"


def test_hidden_is_an_attribute():
    assert text('<p><a title="a hidden gem">text</a> <b hidden>no</b><i HIDDEN class=x>no</i><u hidden="">no</u></p>') == "text"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


def test_template_text_of_a_host_is_left_out(spark):
    body = "<html><body><div><b>Our site</b></div><div><p>story {i} of its own</p></div><div>All rights kept</div></body></html>"
    rows = [(i, f"http://Host.example/{i}", body.replace("{i}", str(i))) for i in range(8)]
    rows += [(20, "http://other.example/", body.replace("{i}", "z")), (21, None, None), (22, "http://host.example:80/e", ""), (23, "bad url", "<p>x</p>"), (None, "http://host.example/n", body.replace("{i}", "n"))]
    rows.append(rows[0])
    got = M.extract_main_text(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {g.page_id: g for g in got}
    assert by[3].text == "story 3 of its own" and by[None].text == "story n of its own"
    assert by[20].text == "Our site\nstory z of its own\nAll rights kept"
    assert (by[21].text, by[21].n_chars, by[22].text, by[23].text) == ("", 0, "", "x")
    assert M.extract_main_text(pages(spark, [])).collect() == []


def test_article_text_that_repeats_stays(spark):
    rows = [(i, f"http://h/{i}", f"<article><p>same line</p><p>own {i % 2}</p></article><div>same foot</div>") for i in range(6)]
    assert {g.text for g in M.extract_main_text(pages(spark, rows)).collect()} == {"same line\nown 0", "same line\nown 1"}


def test_classes_nest():
    tokens, classes = [1, 2, 3, 4, 5, 6], [10, 10, 11, 11, 12, 12]
    assert M.nested(tokens, classes, [1, 3, 4, 2, 9]) == {1, 2, 3, 4}
    assert M.nested(tokens, classes, [2, 1, 3, 4]) == {3, 4}
    assert M.nested([1, 3, 2, 4], [10, 11, 10, 11], [1, 3, 2, 4]) == {1, 2}


def test_vectors_tell_classes_apart(spark):
    body = "<div><p>a</p>{}</div><div>b</div>"
    rows = [(i, f"http://v/{i}", body.format("<em>c</em>" if i < 4 else "")) for i in range(5)]
    (row,) = M.host_templates(pages(spark, rows)).collect()
    sizes = sorted(row.classes.count(c) for c in set(row.classes))
    assert row.host == "v" and len(sizes) == 2 and sizes[0] == 3


def test_copies_do_not_make_their_article_template(spark):
    page = '<html><head><link rel="canonical" href="/{i}"><title>{i}</title></head><body><header>{i}</header><div>Our site</div><div><p>The story that all hold</p></div></body></html>'
    rows = [(i, f"http://copies/{i}", page.replace("{i}", str(i % 4))) for i in range(9)]
    rows += [(20 + i, f"http://copies/{i}", page.replace("The story that all hold", f"Story {i}")) for i in range(4)]
    by = {g.page_id: g.text for g in M.extract_main_text(pages(spark, rows)).collect()}
    assert {by[i] for i in range(9)} == {"The story that all hold"}
    assert [by[20 + i] for i in range(4)] == [f"Story {i}" for i in range(4)]
    alone = [(i, f"http://alone/{i}", page.replace("{i}", str(i))) for i in range(5)]
    assert {g.text for g in M.extract_main_text(pages(spark, alone)).collect()} == {"Our site\nThe story that all hold"}


def test_template_decides_on_pages_with_articles(spark):
    page = '<div><b>Our site</b></div><article><h1>Head {i}</h1><p>By our staff</p><p>Long text of story {i}</p></article><div><p>Next story {i}</p></div>'
    rows = [(i, f"http://a/{i}", page.replace("{i}", str(i))) for i in range(4)]
    teaser = '<div><b>Our site</b></div><div class="widget"><p>Whole long story {i}, all of it.</p></div><article>Teaser {i}</article><div><i>Kept</i></div>'
    rows += [(10 + i, f"http://b/{i}", teaser.replace("class=\"widget\"", "class=\"story\"").replace("{i}", str(i))) for i in range(4)]
    rows += [(20 + i, f"http://c/{i}", teaser.replace("<article>", "<i>").replace("</article>", "</i>").replace("{i}", str(i))) for i in range(4)]
    near = "<article><p>The same long article under each address.</p><p>Seen {i} times</p></article>"
    rows += [(30 + i, f"http://d/{i}", near.replace("{i}", str(i))) for i in range(4)]
    by = {g.page_id: g.text for g in M.extract_main_text(pages(spark, rows)).collect()}
    for i in range(4):
        assert by[i] == f"Head {i}\nLong text of story {i}"
        assert by[10 + i] == f"Whole long story {i}, all of it.\nTeaser {i}"
        assert by[20 + i] == f"Whole long story {i}, all of it.\nTeaser {i}"
        assert by[30 + i] == f"The same long article under each address.\nSeen {i} times"
