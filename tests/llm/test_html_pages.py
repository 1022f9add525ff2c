import random
import time

from basketlens.llm import html_text

SOME = "real words of the story here " * 20


def page_text(body, **kw):
    return html_text._Page(f"<body>{body}</body>").text(**kw)[0]


def test_articles_keep_what_only_looks_like_junk():
    kept = "<div class='market-share'>Market text</div><p class='reply'>He replied</p><section id='related-work'>Prior work</section><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><section id=discussion><p>We discuss</p></section><p>x <math><mi>E</mi>=<mi>m</mi><annotation>tex</annotation></math> y</p>"
    junk = "<div class='ad-slot'>Buy</div><div class='share'><a>tweet</a> <a>post</a></div><div class='newsletter-signup'>Join us</div><div class='reply'>Say <input> <button>Go</button></div><div class='comments'><article>Nice</article></div>"
    got = page_text(f"<article><h1>T</h1><p>{SOME}</p>{kept}{junk}</article>")
    assert got == f"T\n{SOME.strip()}\nMarket text\nHe replied\nPrior work\none\ntwo\nthree\nWe discuss\nx E=m y"


def test_readers_comments_and_notices_go():
    post = f"<article><h1>T</h1><p>{SOME}</p></article>"
    for talk in ("<div id='discussion'><article>{0}</article><article>{0}{0}</article></div>", "<div class='below'><article>c one</article><article>c two</article></div>", "<section class='comment-list'><p>{0}</p></section>"):
        assert page_text(post + talk.format(SOME)) == f"T\n{SOME.strip()}", talk
    assert page_text("<div class='cookie-notice'>We use cookies</div>") == ""
    assert page_text("<div class='top-story-banner-x'>All there is</div>") == "All there is"  # one word of a longer name


def test_text_repeated_inside_articles_of_a_host_goes(spark):
    page = "<body><article><h1>T{0}</h1><p>{1} {0}</p><div class='related'>{2}</div></article></body>"
    rows = [(i, "http://same.x/", page.format(i, SOME, "See our other stories")) for i in range(8)] + [(100 + i, "http://own.x/", page.format(i, SOME, f"What belongs to story {i}")) for i in range(8)]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"T{i}\n{SOME}{i}" for i in range(8))
    assert all(out[100 + i] == f"T{i}\n{SOME}{i}\nWhat belongs to story {i}" for i in range(8))


def test_long_and_deep_pages_take_linear_time():
    for make in (lambda n: "<div>" * n + "x", lambda n: "<div>x" * n, lambda n: "<b>x" * n, lambda n: "<article>x</article>" * n, lambda n: f"<article>{SOME}</article>" + "<div>x</div>" * n, lambda n: "<div>" * n + "</section>" * n):
        at = time.process_time()
        page = html_text._Page(make(50_000))
        page.text()
        content = page.totals()
        [page.said(n) for n in page.beside(page.best(content), content)]
        assert time.process_time() - at < 15
    assert page_text("<div>" * 50_000 + "deep").strip() == "deep"


LAYOUTS = {
    "article": "<header>{site}</header><nav>{menu}</nav><article><h1>{title}</h1>{body}</article><footer>{site}</footer>",
    "main": "<div class='top'>{site}</div><main><h1>{title}</h1>{body}</main><div class='end'>{site}</div>",
    "div": "<div class='masthead'>{site}</div><div id='c{n}' class='post-{n}'><h1>{title}</h1>{body}</div><div class='sidebar'>{other}</div>",
    "table": "<table><tr><td class='l'>{menu}</td><td class='m'><h1>{title}</h1>{body}</td></tr></table>",
    "sections": "<ul>{menu}</ul><article><h1>{title}</h1><section class='a'>{half}</section><section class='b'>{rest}</section></article>",
    "comments": "<article><h1>{title}</h1>{body}</article><section class='comments'><article>{other}</article><article>{other}</article></section>",
    "adverts": "<article><h1>{title}</h1>{half}<div class='advert'>{other}</div>{rest}</article>",
    "neutral": "<div class='n1'>{site}</div><div class='x7'><h1>{title}</h1>{body}</div><div class='n2'>{site} again</div>",
    "cookies": "<div class='cookie-bar'>{other}</div><div class='page'><div class='inner'><h1>{title}</h1>{body}</div></div>",
    "role": "<div role='navigation'>{menu}</div><div role='main'><h1>{title}</h1>{body}</div><div role='complementary'>{other}</div>",
    "forms": "<article><h1>{title}</h1>{body}<form><p>{other}</p><input></form></article>",
    "related": "<article><h1>{title}</h1>{body}<div class='related-posts'>{menu}</div></article>",
}


def test_many_layouts_with_known_texts(spark):
    """Twelve hosts of twelve layouts, 10 pages each: the figure is in the README."""
    rng, rows, want = random.Random(7), [], {}
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    for k, (host, layout) in enumerate(LAYOUTS.items()):
        site, menu = words(6), "".join(f"<li><a href=x>{words(1)}</a></li>" for _ in range(5))
        for i in range(10):
            paragraphs, title = [words(rng.randint(20, 60)) for _ in range(6)], words(4)
            p = [f"<p>{t}</p>" for t in paragraphs]
            html = layout.format(site=site, menu=menu, title=title, body="".join(p), half="".join(p[:2]), rest="".join(p[2:]), other=words(30), n=i)
            rows.append((100 * k + i, f"https://{host}.x/{i}", f"<html><body>{html}</body></html>"))
            want[100 * k + i] = "\n".join([title, *paragraphs])
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = {k for k in want if out[k] != want[k]}
    assert not wrong, (len(wrong), sorted(wrong)[:5])
