import random
import time

import pytest

from lodeline.llm import html_text as H


def text(html, template=()):
    return H.Page(html).main_text(set(template))


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b<br>c<b>d</b>e</p>f", "a\nb cde\nf"),
        ("<article><h1>T &lt;x&gt;</h1><p> one\n two </p><aside>no</aside><p>three</p></article>", "T <x>\none two\nthree"),
        ("<nav><ul><li>Menu</li></ul></nav><main><p>Text</p></main><footer>foot</footer>", "Text"),
        ("<div id='sidebar'>s</div><div class='post-content'><p>Body</p><form>f</form></div><div class=\"comments-area\">c</div>", "Body"),
        ("<header>h</header><article><header><h1>Kept</h1></header><p>x</p><section class=comments><p>c</p></section></article>", "Kept\nx"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a</p><noscript>n</noscript><!-- <p>c</p> --><p>b", "a\nb"),
        ("<article>a<div class='ad'>ad</div>b</article>", "a\nb"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<p title='a > b'>x</p><p data=\"unclosed>y</p>", "x\ny"),
        ("<article></article><p>outside</p>", "outside"),
        ("1 < 2 <3 & x&nbsp;y", "1 < 2 <3 & x y"),
        ("<article><p>a</article><p>b", "a"),
        ("<div role=banner>b</div><div hidden>h</div><p>t</p>", "t"),
        ("<article><p>a</p><div class='search-results'>real</div><section id='related-work'>text</section></article>", "a\nreal\ntext"),
        ("<article><p>a</p><div class='ad-slot'>x</div><div class='related'>y</div></article>", "a"),
        ("<div class='search-page'><article><p>a</p></article></div>", "a"),
        ("<article><p>quoted <em>word</em>, end.</p></article>", "quoted word, end."),
    ],
)
def test_main_text(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html", ["<" * 200_000, "<p " * 60_000, "<p a='" * 50_000, "<!--" * 60_000, "<div>" * 30_000 + "x", "<p>x" * 60_000, "<script>" * 50_000, "&amp" * 80_000, "<b>" * 20_000 + "</i>" * 100])
def test_hostile_pages_end_soon(html):
    began = time.time()
    H.Page(html)
    assert time.time() - began < 20


def test_template_takes_what_a_host_repeats(spark):
    rows = [(i, f"http://User@Shop.example.com:80/p{i}?q", f"<body><div><p>Best shop ever</p></div><div><p>Item {i} is number {i * i}</p><p>same on two</p></div><div><p>All rights reserved</p></div></body>") for i in range(9)]
    rows += [(50, "http://other.example.com/x", "<div><p>Best shop ever</p></div>"), (51, None, None), (52, "not a url", ""), (0, rows[0][1], rows[0][2])]
    rows += [(60 + i, f"https://copy.example.org/{i}", "<nav>n</nav><article><p>Copied article</p></article>") for i in range(4)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract(df).collect()}
    for i in range(9):
        assert got[i, rows[i][1]][0] == f"Item {i} is number {i * i}"
    assert got[50, rows[9][1]][0] == "Best shop ever" and got[51, None] == ("", 0) and got[52, "not a url"] == ("", 0)
    assert all(got[60 + i, f"https://copy.example.org/{i}"] == ("Copied article", 14) for i in range(4))
    assert H.extract(df).count() == len(rows) and H.extract(df.limit(0)).count() == 0


def test_vectors_tell_apart_who_occurs_where(spark):
    pages = [("h", str(i), "<p>x</p>" * (1 + i % 2) + "<b>y</b>") for i in range(6)]
    got = H.equivalence_classes(H.tokens_of(spark.createDataFrame(pages, "host string, page string, html string"))).collect()
    p = H.Page("<p>x</p>").tokens
    b = H.Page("<b>y</b>").tokens
    by = {r.token: (r.pages, r.low, r.high) for r in got}
    assert by[p[0][0]] == by[p[-1][0]] == by[p[1][0]] != by[b[0][0]]


def article(i, extra="", body=None):
    lines = body or [f"Line {i}.{k} of its own {i * k} words" for k in range(3)]
    return f"<html><body><nav><a>Home</a></nav><article><h1>Title {i}</h1>{''.join(f'<p>{x}</p>' for x in lines)}{extra}</article><footer>&copy; all</footer></body></html>"


def test_template_cuts_what_articles_repeat(spark):
    extra = "<div class='xq7'><p>Subscribe to our letter today</p></div>"
    kept = "<div class='related-work'><p>Only here</p></div>"
    often = "<div class='related-posts'><p>See {}</p></div>"
    rows = [(i, f"http://a.example/{i}", article(i, extra)) for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", article(i, kept if i == 3 else "")) for i in range(8)]
    rows += [(40 + i, f"http://c.example/{i}", article(i, often.format(i))) for i in range(8)]
    rows += [(60 + i, f"http://d.example/{i}", article("x", f"<p>{i}</p>", ["One real article that is copied", "with a second line"])) for i in range(8)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: "\n".join([f"Title {i}", *(f"Line {i}.{k} of its own {i * k} words" for k in range(3))])
    for i in range(8):
        assert got[i] == own(i) != H.Page(rows[i][2]).main_text(set())
        assert got[20 + i] == own(i) + ("\nOnly here" if i == 3 else "")
        assert got[40 + i] == own(i)
        assert got[60 + i] == f"Title x\nOne real article that is copied\nwith a second line\n{i}"


def plain_template(pages):
    """Valid classes of one host by brute force: exact occurrence vectors, order and gaps page by page."""
    streams = [[t for t, _ in H.Page(html).tokens] for html in pages]
    classes = {}
    for t in {t for s in streams for t in s}:
        classes.setdefault(tuple(s.count(t) for s in streams), set()).add(t)
    large = {v: ts for v, ts in classes.items() if len(ts) >= H.LEAST_TOKENS and sum(map(bool, v)) >= max(H.LEAST_PAGES, H.LEAST_SHARE * len(pages))}

    def spans(stream, ts):
        at = [i for i, t in enumerate(stream) if t in ts]
        runs = [at[i : i + len(ts)] for i in range(0, len(at), len(ts))]
        orders = {tuple(stream[i] for i in run) for run in runs}
        return runs, orders

    out = set()
    for ts in large.values():
        orders, gaps, one_gap = set(), set(), True
        for stream in streams:
            runs, here = spans(stream, ts)
            orders |= here
            of_page = set()
            for run in runs:
                runs_around = [o for other in large.values() if other != ts for o in spans(stream, other)[0] if o[0] < run[0] <= o[-1]]
                one_gap &= not any(run[0] < i < run[-1] for o in runs_around for i in o)  # else the two cross
                around = [(min(other), sum(i < run[0] for i in o)) for other in large.values() if other != ts for o in spans(stream, other)[0] if o[0] < run[0] <= o[-1]]
                of_page.add(max(around, key=lambda x: x[0], default=None) if len(around) < 2 else tuple(sorted(around)))
            gaps |= of_page
            one_gap &= len(of_page) <= 1
        if len(orders) == 1 and len(gaps) <= 1 and one_gap:
            out |= ts
    return out


def test_deduction_agrees_with_brute_force(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for h in range(6):
        pages = []
        for i in range(6):
            items = "".join(f"<li><i>Read</i><b>{rng.random()}</b></li>" for _ in range(rng.randint(1, 4)))
            swapped = ["<em>x</em>", "<u>y</u>"]
            rng.shuffle(swapped)
            pages.append(f"<div><h2>Shop {h}</h2><ul>{items}</ul><p>{rng.random()}</p>{''.join(swapped) if h % 2 else ''}<p>Fixed end</p></div>")
        rows += [(f"h{h}", f"{h}-{i}", p) for i, p in enumerate(pages)]
        want[f"h{h}"] = plain_template(pages)
    got = {r.host: set(r.template) for r in H.templates(spark.createDataFrame(rows, "host string, page string, html string")).collect()}
    assert got == {h: t for h, t in want.items() if t}
    assert got["h0"]


def test_copies_of_a_page_are_no_template(spark):
    page = "<html><body><div><p>First real line.</p><p>Second real line.</p></div></body></html>"
    rows = [(i, "http://copies.example/a", page) for i in range(5)] + [(9, "http://copies.example/b", page.replace("Second", "Third"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got == {i: "First real line.\nSecond real line." for i in range(5)} | {9: "First real line.\nThird real line."}


def test_compound_names_within_an_article_are_left_to_the_template():
    page = (
        '<body><div class="site-nav">Menu</div><article><h1 class="banner-headline">Title</h1><div class="ad-hoc-analysis">Ad hoc.</div>'
        '<p id="comment-policy">Policy.</p><section class="navigation-satellites">Orbits.</section><p>One <select><option>a<option>b</select> line.</p>'
        '<div class="ad">Buy</div><div class="reader-comments">Nice!</div><div class="promo-box">Repeated.</div></article></body>'
    )
    kept = "Title\nAd hoc.\nPolicy.\nOrbits.\nOne line.\nRepeated."
    assert H.Page(page).main_text(set()) == kept
    promo = [t for t, b in H.Page(page).tokens if b is None and t in {d for _, x in H.Page(page).tokens if x and x.text == "Repeated." for d in x.doubts}]
    assert H.Page(page).main_text(set(promo)) == kept.removesuffix("\nRepeated.")
