import html as entities
import re
import time

import pytest
from pyspark.sql import functions as F

from siftlog.llm import html_text as H

PAGES = "page_id long, url string, html string, text string, wrapper string"


def page(article, extra="", wrap="article", tail="</body></html>"):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><!-- ad --><div class=ad>Buy</div><aside>side</aside>{extra}<{wrap}>{article}</{wrap.split()[0]}><section id=comments><p>first!</p></section>"
        f"<form><p>mail</p><input><button>Go</button></form><div class='sidebar'>Links</div><footer>&copy; x</footer>{tail}"
    )


ARTICLE = "<h1>Title &amp; more</h1><p>One <b>two</b>\n three<br>four<p>open &lt;p&gt; &#233;&nbsp;x<ul><li>a<li>b <a href='?q=>'>c</a></ul><div>tail <i>x</i>y<hr>z</div>"
TEXT = "Title & more\nOne two three four\nopen <p> é x\na\nb c\ntail xy\nz"


def run(spark, rows):
    pages = spark.createDataFrame([(i, url, text, "own", "own") for i, (url, text) in enumerate(rows)], PAGES)
    found = H.extract(pages).collect()
    assert all(row.n_chars == len(row.text) for row in found)
    return {row.page_id: row.text for row in found}


def test_article_without_what_is_around_it(spark):
    found = run(spark, [("http://a.x/1", page(ARTICLE)), (None, page(ARTICLE)), ("http://a.x/2", page(ARTICLE, tail="")), ("http://A.x:80/3", page(ARTICLE, wrap="main"))])
    assert set(found.values()) == {TEXT}


def test_equal_articles_of_a_host_stay(spark):
    rows = [("http://b.x/1", page("<h1>Same</h1><p>All pages say this.</p>"))] * 6
    assert set(run(spark, rows).values()) == {"Same\nAll pages say this."}


def test_host_template_without_an_article_element(spark):
    """What every page says alike is the host's; the part that differs is the article."""
    rows = [(f"http://c.x/{i}", f"<body><div class=top><p>Welcome to the site</p></div><div class=text><h2>All rights reserved</h2><p>Story {i} begins with words {i * 7}.</p><p>More of story {i} here.</p></div></body>") for i in range(8)]
    found = run(spark, rows)
    assert found == {i: f"Story {i} begins with words {i * 7}.\nMore of story {i} here." for i in range(8)}


def test_odd_pages(spark):
    rows = [
        ("u", None), ("u", ""), ("u", "plain text  only"), ("u", "<p>cut <b off"), ("u", "<article><p>a</p><script>x<y</article>"), ("u", "<article>x<!-- never closed <p>y"),
        ("u", "</div></p><article><p>&am</p><p>&amp</article>"), ("u", "<article>" + "<div>" * 400 + "deep" + "<p>q</p>" * 2000 + "</article>"), ("u", "<article><p>\U0001f600</p></article>"),
    ]
    found = run(spark, rows)
    assert [found[i] for i in (0, 1, 3, 5, 6, 8)] == ["", "", "cut", "x", "&am\n&", "\U0001f600"]
    assert found[4] == "a"
    assert found[7] == "\n".join(["deep", *["q"] * 2000])
    assert run(spark, []) == {}


def test_raw_elements_end_at_their_own_tag(spark):
    """Signs of tags, comments and quotes in scripts, styles and text fields are no tokens."""
    raw = ["<script>for(i=0;i<n;i++){f(i);}</script>", "<script>a='<!--'; b=\"<p title='\"</script >", "<style>/* <!-- <b */</style>", "<textarea>x <!-- <i</textarea>", "<svg><style>a<b</style><title/><g></svg>"]
    rows = [(f"http://raw{i}.x/", f"<html><head>{part}</head><body>{part}<article><h1>T</h1>{part}<p>one{part} two</p></article><script>z()</script></body></html>") for i, part in enumerate(raw)]
    assert {text for text in run(spark, rows).values()} == {"T\none two"}


def test_texts_of_one_page_and_of_copies_are_not_the_template(spark):
    """Left out is what all of several different pages share, not what one page or its copies have."""
    frame = "<body><div class=top><p>Welcome to the site</p></div><div class=text>{}</div></body>"
    rows = [("http://e.x/", frame.format(f"<p>Story {i} begins.</p><p>More of story {i}.</p>")) for i in range(5)]
    rows.append(("http://e.x/6", frame.format("<h2>Only here</h2><p>Story 6 begins.</p><blockquote>Said once</blockquote><p>More of it.</p><pre>code</pre>")))
    rows += [("http://f.x/", "<body><div class=text><h2>Copied</h2><p>A lone paragraph</p></div></body>")] * 4 + [("http://f.x/", "")]
    found = run(spark, rows)
    assert found[0] == "Story 0 begins.\nMore of story 0."
    assert found[5] == "Only here\nStory 6 begins.\nSaid once\nMore of it.\ncode"
    assert [found[i] for i in range(6, 11)] == ["Copied\nA lone paragraph"] * 4 + [""]


def test_names_around_the_article_do_not_drop_it(spark):
    """Class names and forms around an article; comments, side columns and controls still go."""
    rest = "<div class=sidebar><p>Links</p></div><section id=comments><article class=comment><p>a comment longer than all else of the page</p></article></section>"
    article = "<h1>T</h1><p>One two.</p><p>Three.</p>"
    pages = [
        f"<div class='content sidebar-right'><article>{article}</article></div>{rest}",
        f"<article class='post social'>{article}</article>{rest}",
        f"<form id=aspnetForm action=x><input><div class=menu><a>Home</a></div><main>{article}<select><option>o</select><button>Go</button></main></form>{rest}",
        f"<div id=page-with-banner class=banner><div class='post comments-closed'><article>{article}</article></div></div>",
        f"<div>Top</div><div class='text widget'>{article}<div class=share>Share it</div></div><form><p>mail</p></form>",
    ]
    found = run(spark, [(f"http://g{i}.x/", f"<html><body>{text}</body></html>") for i, text in enumerate(pages)])
    assert [found[i] for i in range(4)] == ["T\nOne two.\nThree."] * 4
    assert found[4].endswith("T\nOne two.\nThree.")


def test_articles_of_several_containers_are_whole(spark):
    """Containers beside each other, and article elements on different paths."""
    body = "<body><div class=top>Site</div><div><h1>T{0}</h1><div class=lead><p>A{0}</p></div><div class=text><p>B{0} is the longest part of all.</p></div><div class=end>C{0}<p>D{0}</p></div></div></body>"
    rows = [("http://h.x/", body.format(i)) for i in range(4)]
    rows.append(("http://i.x/", "<body><div><h1>T</h1><div class=lead><p>A</p></div><div class=text><p>B is longer</p></div></div></body>"))
    rows.append(("http://j.x/", "<body>Site<div class=a><article><p>One</p></article></div><div class=b><section><article>Two is longer</article></section></div></body>"))
    found = run(spark, rows)
    assert [found[i] for i in range(4)] == [f"T{i}\nA{i}\nB{i} is the longest part of all.\nC{i}\nD{i}" for i in range(4)]
    assert [found[4], found[5]] == ["T\nA\nB is longer", "One\nTwo is longer"]


def test_wrappers_of_many_partials(spark, monkeypatch):
    """Wrappers of a host aligned in groups, level by level, are one in the end."""
    monkeypatch.setattr(H, "GROUP", 3)
    rows = [(i, "http://d.x/", page(f"<h1>t{i}</h1>" + "<p>x</p>" * (i % 4) + f"<h2>s{i}</h2>" * (i % 2)), None, None) for i in range(40)]
    pages = spark.createDataFrame(rows, PAGES).repartition(20)
    found = H.wrappers(pages).collect()
    assert [(row.host, row.pages) for row in found] == [("d.x", 40)]


def test_alignment_gives_optional_and_repeated_groups():
    one, two = (H.page_wrapper(H.tree(text)) for text in ("<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><h1>b</h1><table><tr><td>1</td></tr></table><p>x</p></div>"))
    parts = H.align(one, two)[H.PARTS][0][H.PARTS]
    assert [(part[H.LABEL], part[H.OPTIONAL], part[H.REPEATED], part[H.TEXT]) for part in parts[:1]] == [("h1", False, False, H.SLOT)]
    assert [(part[H.LABEL], part[H.OPTIONAL], part[H.REPEATED]) for part in parts[1:]] == [("table", True, False), ("p", False, True)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_given_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = H.extract(pages).withColumnRenamed("text", "found").join(pages, "page_id").select("found", "html").collect()
    for row in found:
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", article))
        assert row.found == "\n".join(part for part in parts if part)


def test_deep_and_long_pages_take_time_in_proportion():
    """Depth, quotes without an end, many siblings, stray ends: crash-free, and eight times the input takes far less than its square."""

    def seconds(make, n):
        text = make(n)
        start = time.perf_counter()
        H.page_wrapper(H.tree(text))
        found = list(H.blocks(H.tree(text)))
        return time.perf_counter() - start, found

    kinds = [
        lambda n: "<div>" * n + "deep" + "</div>x" * n,
        lambda n: "<p>it's x <a b='" * n,
        lambda n: "<a <b c=\"" * n + ">",
        lambda n: "<h2>t</h2><p>x</p>" * n,
        lambda n: "<div>" * n + "</section>" * n + "y",
        lambda n: "<ul><li><ul>" + "<div>" * n + "<li>z</li>" * n,
        lambda n: "<" * n + "<!-- " * n,
    ]
    for make in kinds:
        small, _ = seconds(make, 2_500)
        large, _ = seconds(make, 20_000)
        assert large < 24 * small + 1
    assert seconds(kinds[0], 100_000)[1] == ["deep", *["x"] * 100_000]


def test_deep_elements_keep_their_order_and_asides():
    deep = "<div>" * 150 + "a<section>b<p>c</p>d<nav>menu<div>in it</div>still</nav>e</section>f" + "</div>g" * 150
    assert list(H.blocks(H.tree(deep))) == ["a", "b", "c", "d", "e", "f", *["g"] * 150]


def test_long_alignments_and_numbered_classes():
    one, two = (H.page_wrapper(H.tree("".join(f"<h2 class='post-{k + i}'>t</h2><p>x</p>" for i in range(n)))) for k, n in ((0, 6_000), (9, 6_001)))
    start = time.perf_counter()
    whole = H.align(one, two)
    assert time.perf_counter() - start < 20
    many = H.page_wrapper(H.tree("<div class=post-1><p>a</p></div>"))
    for i in range(2_000):
        many = H.align(many, H.page_wrapper(H.tree(f"<div class=post-{i}><p>a{i}</p></div>")))
    assert len(str(many)) < 300 and len(whole[H.PARTS]) == 12_002


def test_names_of_other_things_stay_in_the_article(spark):
    article = "<article><h1>T</h1><p>One.</p><p class='share-price'>Two.</p><section id='skip-bad-debt'><p>Three.</p></section><p>If <math><mi>x</mi></math> then.</p><div class='share-buttons'>Share</div><div class=ad>Buy</div></article>"
    assert run(spark, [("http://k.x/", article)]) == {0: "T\nOne.\nTwo.\nThree.\nIf x then."}


def test_hosts(spark):
    urls = ["http://a.B/x", "https://u:p@h.example:8080/x", None, "", "nothing", "ftp://z?q"]
    rows = spark.createDataFrame([(url,) for url in urls], "url string").select(H.host_of(F.col("url"))).collect()
    assert [row[0] for row in rows] == ["a.b", "h.example", "", "", "", "z"]
