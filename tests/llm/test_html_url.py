import pytest

from helixmill.llm import html_extract as H
from helixmill.llm.url_rules import apply_url_rules


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain text only, without any tags.", ["plain text only, without any tags."]),
        ("<body><nav><a>Home</a></nav><div class='x'><p>A fairly long first paragraph of the story, with words.</p><p>Second one.</p></div><div class='comments'><p>I think this is great and I liked it.</p></div></body>", ["A fairly long first paragraph of the story, with words.", "Second one."]),
        ("<article><h1>T</h1><p><b>One &amp; two<br>three.<p>Four &lt;x&gt;.<script>var t='</p>'</script></article><footer>c</footer>", ["T", "One & two three.", "Four <x>."]),
        ("<article><p>One is here.<svg width='1'/> Two.</p><button>x<p>Three here.</p><video-player></video-player><p>Four <math><mi>y</mi></math> ends.</p><svg><text>no</text></svg></article>", ["One is here. Two.", "x", "Three here.", "Four y ends."]),
        ("<div id=main><p>Hello world this is one.<form><p>Your name</form></div>", ["Hello world this is one."]),
    ],
)
def test_blocks(page, want):
    assert H.blocks(page, H.model()) == want


def test_unclosed_elements_swallow_nothing():
    for odd in ("<iframe src='x'/>", "<button>", "<svg/>", "<select>", "<video>", "<svg><g>", "<button-group>"):
        page = f"<article><p>The first paragraph stands here.</p>{odd}<p>The second paragraph stands here.</p></article>"
        assert "The second paragraph stands here." in " ".join(H.blocks(page, H.model())), odd
    assert H.dropped_parts("<svg><svg></svg>x</svg>") == {0: 23, 5: 16}
    H.parse("<a '" * 20_001)
    H.parse("<a '" * 20_001 + ">")


def test_frames_of_articles():
    """Forms that frame a page and headers of articles lose nothing of it; forms in and beside articles, and site headers, do go."""
    a, b = "The first paragraph of this article stands here.", "The second paragraph of this article stands here."
    got = lambda page: H.blocks(page, H.model())
    assert got(f"<body><form><article><p>{a}</p><p>{b}</p></article></form></body>") == [a, b]
    assert got(f"<body><form id='aspnetForm'><input type=hidden><div class='content'><p>{a}</p><p>{b}</p></div></form></body>") == [a, b]
    assert got(f"<article><header><h1>A headline</h1></header><p>{a}</p></article>") == ["A headline", a]
    assert got(f"<article><p>{a}</p><p class='ad-hoc'>{b}</p></article>") == [a, b]
    assert got(f"<article><p>{a}</p><div class='ad'>{b}</div></article>") == [a]
    assert got(f"<body><header><p>Our site.</p></header><article><p>{a}</p><form class='subscribe'><p>Your name</p></form><p>{b}</p></article></body>") == [a, b]
    assert got(f"<body><article><p>{a}</p></article><form><p>Write to us about this here.</p><select><option>x</select></form></body>") == [a]


def test_deep_pages_take_linear_time():
    import time

    def took(n: int) -> float:
        t = time.perf_counter()
        H.parse("<ul><li>" + "<div>" * n + "</nav><li>x</li>" * n)
        H.parse("<div>" * n + "</section>x" * n)
        return time.perf_counter() - t

    took(500)
    assert took(20_000) < 40 * max(took(2_000), 0.02)


def test_marginals_are_exact():
    nodes = H.parse("<div><p>abc.</p><ul><li><a>x</a></li></ul></div><p>d</p>")
    m = H.model()
    own = [m.own(nodes, i) for i in range(len(nodes))]
    total, on = 0.0, [0.0] * len(nodes)
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        p = m.prior[y[0]] * own[0][y[0]]
        for i in range(1, len(nodes)):
            p *= own[i][y[i]] * m.edge[H.group(nodes[nodes[i].parent]), y[nodes[i].parent]][y[i]]
        total += p
        for i, v in enumerate(y):
            on[i] += p * v
    assert m.marginals(nodes) == pytest.approx([x / total for x in on])


def test_held_out_frames():
    pages = H.training_pages()
    fit = H.Model([H.labelled(p) for i, p in enumerate(pages) if i % 4])
    right = all_ = 0
    for p in pages[::4]:
        nodes = H.labelled(p)
        for n, q in zip(nodes, fit.marginals(nodes)):
            if n.text:
                all_ += n.chars
                right += n.chars * ((q > 0.5) == n.label)
    assert right / all_ > 0.97


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>" + "word " * 50_000 + ".</p>"), (3, "u", "<p>x y z.</p>")]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "text").selectExpr("page_id", "text as url", "html")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 6), (3, 250_001)]
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_rules(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "https://www.example.com/en/", "http://b.www.example.com/en/x#y", "http://net/es/", "http://x.net/fr", "http://com", None, "", "no scheme", "a://", "http://notexample.com/en/", "http://xcom/", "http://com/", "x://y.com:80/", "http://é.com/"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in apply_url_rules(df, ranges=3).collect()}
    assert len(got) == len(urls) + 3
    assert [got[i][2:] for i in range(16)] == [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), (None, "allow"), ("com/", "allow"), (None, "allow"), ("com/", "allow")]
    assert got[3][:2] == ("b.www.example.com", "/en/x") and got[16] == got[0]
    assert apply_url_rules(df.limit(0)).count() == 0
    nested = [("com", "/a", "allow"), ("com", "/a/b", "block"), ("x.com", "/", "block"), ("com", "/a/bc", "allow")]
    two = spark.createDataFrame([(1, "h://x.com/a/bd"), (2, "h://y.com/a/b"), (3, "h://x.com/z"), (4, "h://y.com/a/bcd")], "page_id long, url string")
    assert {r.page_id: r.rule for r in apply_url_rules(two, nested).collect()} == {1: "com/a/b", 2: "com/a/b", 3: "x.com/", 4: "com/a/bc"}
