import json
import random

from crewmetrics.llm import html_text as H

PAGES = "page_id long, url string, html string, host string, wrapper string"


def page(rng, host, n, article=True):
    words = lambda k: " ".join(rng.choices(["alpha", "b&amp;c", "ü&nbsp;x", "d"], k=k))
    body = "".join(f"<p>{words(5)}<b>{words(2)}</b><br>{words(1)}" + "</p>" * rng.randrange(2) for _ in range(n))
    aside = '<aside>side</aside><div class="cookie-notice">We use cookies</div>' if rng.random() < 0.5 else ""
    menu = "".join(f'<li><a href="/{i}">{i}</a></li>' for i in range(rng.randrange(1, 6)))
    comments = '<section class="comments"><p>First!</p></section>' if rng.random() < 0.5 else ""
    main = f"<article><h1>T {host}</h1>{body}</article>" if article else f'<div class="story"><h1>T {host}</h1>{body}</div>'
    return (
        f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><header>{host}</header>"
        f"<nav><ul>{menu}</ul></nav>{aside}{main}{comments}<form><p>Search</p></form><footer>&copy; {host}</footer>"
        + ("</body></html>" if rng.random() < 0.8 else "")
    )


def brute(html):
    """What an article's tags say, without any wrapper."""
    import html as entities
    import re

    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    plain = (" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks)
    return "\n\n".join(b for b in plain if b)


def test_articles_of_many_hosts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        host = "hot.example" if i % 3 else f"h{i % 5}.example"
        rows.append((i, f"http://{host}/{i}", page(rng, host, rng.randrange(1, 9)), "clash", None))
    got = {r.page_id: r for r in H.main_texts(spark.createDataFrame(rows, PAGES).repartition(7)).collect()}
    assert len(got) == len(rows)
    for i, url, html, *_ in rows:
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, brute(html), len(brute(html)))


def test_without_articles_constant_texts_and_menus_go(spark):
    rng = random.Random(2)
    rows = [(i, "http://x.example/", page(rng, "x.example", 3 + i, article=False).replace("T x", f"T {i}"), None, None) for i in range(6)]
    for r in H.main_texts(spark.createDataFrame(rows, PAGES)).collect():
        assert r.text.startswith(f"T {r.page_id}") and "alpha" in r.text
        assert not any(w in r.text for w in ("cookies", "Search", "First!", "©", "side"))


def test_nulls_empties_and_repeats(spark):
    rows = [(1, None, None, None, None), (2, "", "", None, None), (3, "nonsense", "<p>", None, None), (None, "http://a/", "<article>x", None, None),
            (4, "http://a/", "<article>x", None, None), (4, "http://a/", "<article>x", None, None)]
    got = sorted((str(r.page_id), r.url, r.text) for r in H.main_texts(spark.createDataFrame(rows, PAGES)).collect())
    assert got == sorted([("1", None, ""), ("2", "", ""), ("3", "nonsense", ""), ("None", "http://a/", "x"), ("4", "http://a/", "x"), ("4", "http://a/", "x")], key=str)
    assert H.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_malformed_pages():
    one = lambda html: H.extract(html, H.shape(H.parse(html)))
    assert one("<article><h1>A</h1><p>b<p>c &lt;d&gt; &am<div>e</div></p>f") == "A\n\nb\n\nc <d> &am\n\ne\n\nf"
    assert one("<article>a <!-- <p>no</p> --> b<script>'</article>'</script> c</artic") == "a b\n\nc"
    assert one('<article><p title="x > y">a</p><p class=ad>no</p><div hidden>no</div>3 < 4</article><footer>no') == "a\n\n3 < 4"
    assert one('<main><div class="comments"><p>no</p></div><table><tr><td>1<td>2</table></main>') == "1\n\n2"
    assert one("<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_wrappers_generalise():
    wrap = lambda *pages: H.merge(H.shape(H.parse(pages[0])), H.shape(H.parse(pages[1])))
    (body,) = wrap("<body><ul><li>1<li>2</ul><p>x</p></body>", "<body><p>x</p><p>y</p><hr></body>")[2]
    assert [(k[0], k[1]) for k in body[2]] == [("ul", "?"), ("p", "+"), ("hr", "?")]
    (groups,) = H.shape(H.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))[2]
    assert [(k[0], k[1]) for k in groups[2]] == [("()", "+")]
    a, b = H.shape(H.parse("<p>1</p>")), H.shape(H.parse("<p>2</p><p>3</p>"))
    assert json.dumps(H.merge(a, b)) == json.dumps(H.merge(b, a))


def test_repetition_within_repetition_is_read():
    one = lambda html: H.extract(html, H.shape(H.parse(html)))
    turn = "<p>a</p><ul><li>b</li></ul><p>c</p><ul><li>d</li></ul><h2>e</h2>"
    assert one(f"<article>{turn * 2}</article>") == "\n\n".join("abcde" * 2)
    turn = "<p>a</p><pre>b</pre><p>c</p><pre>d</pre><h2>e</h2>"
    assert one(f"<article><h1>t</h1>{turn * 3}</article>") == "\n\n".join("t" + "abcde" * 3)
    # An element the wrapper has no place for.
    assert H.extract("<article><p>a</p><div>b</div></article>", H.shape(H.parse("<article><p>a</p></article>"))) == "a\n\nb"


def test_copies_are_one_page_and_links_that_do_not_repeat_stay(spark):
    copy = "<body><div><h1>T</h1><p>alpha</p></div></body>"
    rows = [(i, "http://copies.example/", copy + f"<script>{i}</script>", None, None) for i in range(4)]
    rows += [
        (10 + i, "http://mixed.example/", f'<body><div><p>Menu</p><ul><li><a href="/">Home</a></li></ul><h1>T{i}</h1><p><a href="/{i}">source {i}</a></p></div></body>', None, None)
        for i in range(4)
    ]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(4)] == ["T\n\nalpha"] * 4
    assert [got[10 + i] for i in range(4)] == [f"T{i}\n\nsource {i}" for i in range(4)]


def test_words_in_class_or_id_do_not_lose_articles_or_headings(spark):
    one = lambda html: H.extract(html, H.shape(H.parse(html)))
    assert one("<article class='post category-social'><p>x</p></article>") == "x"
    assert one("<main class='hentry comments-open'><p>x</p></main>") == "x"
    assert one("<article><h2 id='search-methods'>M</h2><section id='related'><p>w</p></section></article>") == "M\n\nw"
    assert one("<article><div class='entry-content no-sidebar'><p>x</p></div><div class='Comments'>no</div></article>") == "x"
    # Doubtful parts go where they hold one text on all pages of the host.
    rows = [
        (i, "http://x/", f"<article><p>a{i}</p><div class='share-bar'>Tell</div><div class='no-sidebar'>b{i}</div></article>", None, None) for i in range(4)
    ]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"a{i}\n\nb{i}" for i in range(4)}


def test_comments_teasers_adverts_and_forms():
    one = lambda html: H.extract(html, H.shape(H.parse(html)))
    assert one("<article><p>x</p><ol class='comment-list'><li><article class='comment'><p>First 0!</p></article></ol></article>") == "x"
    assert one("<article><p>x</p><article><p>First!</p></article><article><p>Second!</p></article></article>") == "x"
    assert one("<article><h1>t</h1><article><p>body</p></article></article>") == "t\n\nbody"
    assert one("<article><p>x</p><div class='ad-slot'>Buy</div><div id='cookie-banner'>c</div><div class='newsletterSignup'>n</div></article>") == "x"
    assert one("<article class='post'><p>x</p></article><article class='card'>t</article><article class='card'>u</article>") == "x"
    assert one("<article class='card'>t</article><article class='card'>u</article>") == "t\n\nu"
    assert one("<main><article>x</article></main><article>teaser</article>") == "x"
    assert one("<article class='comment'><p>all there is</p></article>") == "all there is"
    assert one("<form><nav>m</nav><article><p>x</p></article><input></form>") == "x"
    assert one("<form><header>m</header><div><h1>t</h1><p>x</p></div></form>") == "t\n\nx"
    assert one("<article><p class='search'>x</p><form><p>mail</p></form><p class='ad'>no</p></article>") == "x"


def test_alignments_are_those_of_the_whole_table():
    def table(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                yield i, j
                i, j = i + 1, j + 1
            elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
                yield i, None
                i += 1
            else:
                yield None, j
                j += 1

    rng = random.Random(5)
    for _ in range(500):
        a, b = (rng.choices("abcde"[: rng.randrange(1, 6)], k=rng.randrange(30)) for _ in range(2))
        assert H.pairs(a, b) == list(table(a, b))


def test_a_page_of_very_many_siblings_is_whole():
    rng = random.Random(6)
    pages = ["<article>" + "".join(f"<{t}>{i}</{t}>" for i, t in enumerate(rng.choices(["p", "ul", "pre", "h2", "dl"], k=20_000))) + "</article>" for _ in range(2)]
    wrapper = H.merge(*(H.shape(H.parse(p)) for p in pages))
    for p in pages:
        assert H.extract(p, wrapper) == "\n\n".join(map(str, range(20_000)))


def test_links_that_pages_share_are_joined_page_by_page(spark):
    # Each text of a link stands on five pages of the host, in lists without a place of their own.
    rows = [
        (i, "http://x/", f"<body><div><p>Text {i}</p><p><a href=/>Topic {i // 5}</a></p><p>More {i}</p></div></body>", None, None) for i in range(60)
    ]
    rows.append((60, "http://x/", "<body><div><p>Text 60</p><p><a href=/>Only here</a></p></div></body>", None, None))
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert got == {i: f"Text {i}\n\nMore {i}" for i in range(60)} | {60: "Text 60\n\nOnly here"}
