import itertools
import random
import time

from veilwright.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="home page">
<header class="site-header"><a href="/">Home of all things that are worth reading.</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this page better for you, and for us as well as all others.</p></div>
<div id="content"><article><header><h1>Head &lt;line&gt;</h1><p class="byline">By A. Writer on a day in May of the year.</p></header>
<p>First   <b>paragraph<br>goes</b>&nbsp;on &eacute;.<p>Second one
with lines.</p><ul><li>Point one</li><li>Point two</li></ul>
<aside>Also see these other five articles that we have.</aside><div class="ad">Buy now, it is cheap, and very good for you.</div>
<script>var x = "</p>";</script><!-- <p>no</p> --><blockquote>A quote.</blockquote><form><label>Mail</label><input><button>Send it</button></form>
<h2>Section</h2><table><tr><td>cell 1</td><td>cell 2</td></tr></table></article></div>
<div id="sidebar"><p>A long sentence in the side bar that reads like prose, but is not what people came for.</p></div>
<section id="comments"><p>I think that this article is quite wrong about all that it says, as always.</p></section>
<footer>&copy; 2020 All rights are reserved.</footer></body></html>"""


def test_regions_of_a_page():
    assert H.main_text(PAGE).split("\n") == ["Head <line>", "First paragraph goes on é.", "Second one with lines.", "Point one", "Point two", "A quote.", "Section", "cell 1", "cell 2"]


def test_page_without_marks():
    page = """<body><div><a href=a>Home</a> <a href=b>News</a> <a href=c>Sport</a></div>
    <div><p>This is a paragraph of prose that has more than twelve words in it, and ends.</p><p>So it is.</p>
    <p>Another paragraph of prose follows here with many words, so that it is text as well.</p></div>
    <div><a href=d>Terms</a> | <a href=e>Privacy</a></div>"""
    assert H.main_text(page).split("\n") == [
        "This is a paragraph of prose that has more than twelve words in it, and ends.",
        "So it is.",
        "Another paragraph of prose follows here with many words, so that it is text as well.",
    ]


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("   ") == ""
    assert H.main_text("<nav><a href=x>y</a></nav>") == ""
    assert H.main_text("<article><p>cut off in the middle of a ta<b cla") == "cut off in the middle of a ta"
    assert H.main_text("<article><p>1 < 2 &amp; 3 > 2<br><p>&#233;&am</article><footer>x</footer>") == "1 < 2 & 3 > 2\né&am"
    assert H.main_text('<article><p title="a > b">x</p><p title="open>y</p></article>') == "x\ny"
    assert len(H.main_text("<article>" + "<p>word" * 50_000)) == 5 * 50_000 - 1
    assert H.main_text("<div>" * 3000 + "<p>Deep down there is a paragraph with more than twelve words in all of it.")


PROSE = "This is a paragraph of prose that has more than twelve words in it, and ends."


def test_names_that_only_hint():
    for page, want in (
        (f'<article><div class="entry-header"><h1>Title of it</h1></div><p>{PROSE}</p></article>', ["Title of it", PROSE]),
        (f'<main><div class="article-header"><h1>Title of it</h1></div><p>{PROSE}</p></main>', ["Title of it", PROSE]),
        (f'<main><div class="related-work"><h2>Related work</h2><p>{PROSE}</p></div></main>', ["Related work", PROSE]),
        (f'<article id="a"><section id="share-price-analysis"><p>{PROSE}</p><p>Short.</p></section></article>', [PROSE, "Short."]),
        (f'<div class="share-price-analysis"><p>{PROSE}</p><p>{PROSE}</p></div>', [PROSE, PROSE]),
        (f'<article><p>{PROSE}</p><div class="related-posts"><p>{PROSE}</p></div><div class="share-buttons">Share it</div><div class="post-comments"><p>{PROSE}</p></div></article>', [PROSE]),
        (f'<div class="site-header"><p>{PROSE}</p></div><article><p>{PROSE}</p></article>', [PROSE]),
    ):
        assert H.main_text(page).split("\n") == want, page


def test_unclosed_and_unread_elements():
    for tag in ("object", "select", "video", "audio", "textarea", "canvas", "svg", "iframe", "noscript"):
        assert H.main_text(f"<article><p>One.<{tag} x=y>two</p><p>Three.</article>") == "One.two\nThree.", tag
        assert H.main_text(f"<article><p>One.<{tag} x=y>two</{tag}></p><p>Three.</article>") == "One.\nThree.", tag
    assert H.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</article>") == "So x=2 holds."
    assert H.main_text("<article><p>One.<script>two</p><p>Three.</article>") == "One."
    assert len(H.main_text("<article>" + "<object><p>word" * 30_000)) == 5 * 30_000 - 1


def test_minimum_cut_equals_all_cuts():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        a, b = [[rng.choice([0, 0.5, 1, 2, 5]) for _ in range(n)] for _ in range(2)]
        edges = [(*sorted(rng.sample(range(n), 2)), rng.choice([0.3, 0.7, 1.9])) for _ in range(rng.randint(0, 12))] if n > 1 else []

        def value(side):
            return sum(b[i] if s else a[i] for i, s in enumerate(side)) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(map(value, itertools.product([False, True], repeat=n)))
        assert abs(value(H.minimum_cut(a, b, edges)) - best) < 1e-9


def test_dataframe(spark):
    rows = spark.createDataFrame([(1, PAGE, "u", 7), (2, None, None, 8)], "page_id long, html string, text string, n_chars long")
    got = {r.page_id: r for r in H.extract(rows).collect()}
    assert got[1].text.startswith("Head <line>\n") and got[1].n_chars == 7 and got[2].text == ""
    assert H.extract(rows.limit(0)).count() == 0
    twice = rows.unionByName(rows).withColumnRenamed("n_chars", "text")
    assert sorted(r.text[:4] for r in H.extract(twice).collect()) == ["", "", "Head", "Head"]


def test_broken_pages_are_read_in_one_pass():
    for piece in ("<a ", '<a href="', "<script", "<svg>", "</svg", "<svg></svg", '<a ">"', "<a '\">\"' ", "<section>", "<", "<!", "<!--", "<noscript", "<header><h1>", "<p class=\"a'>"):
        took = []
        for size in (100_000, 400_000):
            page = "<article><p>Hello there.</p>" + piece * (size // len(piece)) + "</div>" * (size // 10)
            began = time.perf_counter()
            assert H.main_text(page).startswith("Hello there."), piece
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 0.3, (piece, took)


def test_tags_are_those_of_a_plain_scan():
    """The remembered scans change nothing: each tag is found as by a scan of its own."""
    rng = random.Random(4)

    def plain_end(page, at):
        quote = None
        for i in range(at, len(page)):
            if quote:
                quote = None if page[i] == quote else quote
            elif page[i] == ">":
                return i
            elif page[i] in "\"'":
                quote = page[i]
        return -1

    for _ in range(3000):
        page = "".join(rng.choice(["<a ", "<b", ">", '"', "'", "x", " ", "</a", "<!", "<"]) for _ in range(rng.randint(1, 30)))
        tokens = H.Tokens(page)
        for at in sorted(rng.sample(range(len(page)), min(len(page), 8))):
            assert tokens._tag_end(at) == plain_end(page, at), (page, at)


def test_scripts_without_spaces():
    for lines in (["关于城市的历史", "这座城市建于一千年前，位于河流的两岸，人口超过三百万。它是该地区的经济和文化中心。", "城市的北部是山区，南部是平原，气候温和，四季分明，适合居住。"], ["都市の歴史", "この都市は千年前に建てられ、川の両岸に位置し、人口は三百万人を超えています。", "北部は山地で、南部は平野です。気候は温暖で、四季がはっきりしています。"]):
        page = f"<body><div><a href=a>首页</a> <a href=b>新闻</a></div><h1>{lines[0]}</h1><p>{lines[1]}</p><p>{lines[2]}</p><div><a href=c>条款</a></div></body>"
        assert H.main_text(page).split("\n") == lines


def test_unmarked_pages_by_all_cuts():
    """The text is that of the least of all cuts of the costs and edges."""
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 9)
        parts = [rng.choice([f"<p>{PROSE}</p>", "<p>Yes.</p>", "<h2>Part</h2>", "<div><a href=x>Go there</a></div>", "<div>Copyright 2020 Acme</div>", f"<div>{PROSE}</div>", f'<div class="share-price">{PROSE}</div>', '<div class="ad">Buy it.</div>']) for _ in range(n)]
        page = "<body>" + "".join(parts) + "</body>"
        kept, marked = H._written(page)
        weights = tuple(w + rng.uniform(-0.3, 0.3) for w in H.WEIGHTS)
        both = [H.costs(x, b, marked, weights) for b, x in kept]

        def value(side):
            total = sum(c if s else b for (b, c), s in zip(both, side, strict=True))
            last = {}
            for k, (b, _) in enumerate(kept):
                if k and side[k] != side[k - 1]:
                    total += H.NEXT if kept[k - 1][0].region == b.region else H.NEXT / 4
                if b.parent in last and side[k] != side[last[b.parent]]:
                    total += H.KIN
                last[b.parent] = k
            return total

        lines = H.main_text(page, weights).split("\n")
        best = min(itertools.product([False, True], repeat=len(kept)), key=value)
        text = [x for (_, x), s in zip(kept, best, strict=True) if s]
        assert "\n".join(text).split("\n") == lines


def test_weights_are_fitted_on_marked_pages(spark):
    page = f"<body><nav><a href=a>Home</a></nav><div class=ad>Now</div><article><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE}</p></article></body>"
    rows = spark.createDataFrame([(i, page.replace("Now", f"Now {i}").replace("Title", f"Title {i}").replace("Home", f"Home {i}")) for i in range(80)] + [(99, None), (100, "<p>Unmarked page.</p>")], "page_id long, html string")
    w = H.fit_weights(rows)
    assert w != H.WEIGHTS and w[1] > 0 and w[3] < 0 and H.fit_weights(rows.repartition(7)) == w
    assert H.fit_weights(rows.limit(5)) == H.fit_weights(rows.limit(0)) == H.WEIGHTS
    # Each region's costs are bounded; looks and neighbours are weighed with them.
    assert H.REGION < H.LOOKS + H.OUTSIDE + 2 * (H.NEXT + H.KIN)
