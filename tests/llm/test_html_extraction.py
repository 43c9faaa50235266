import random

from pyspark.sql import functions as F

from sievelake.llm import html_extraction as h
from sievelake.llm.html_extraction import Page
from tests.llm.conftest import prose

SCHEMA = "page_id long, url string, html string"


def own(source):
    return Page(source).text(None)


def test_blocks_white_space_and_references():
    assert own("<article><h1>A &amp; B</h1><p>one\n two<br>three&nbsp;four <b>fi</b>ve</p>tail<ul><li>x<li>y</ul></article>") == "A & B\none two three four five\ntail\nx\ny"
    assert own("<p>caf&eacute; &#8364; &lt;p&gt; a < b &amp") == "café € <p> a < b &"
    assert own("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>t<dd>d</dl>") == "a\nb\nc\nt\nd"


def test_broken_markup():
    assert own("<article><p><b>First one.<br><p>Second one.</i></p></div><p>Third <a title='>'>one</a>.") == "First one.\nSecond one.\nThird one."
    assert own("<article><p>kept <em>whole</em> text</p><p cla") == "kept whole text"
    assert own('<script>var t="</p><p>";</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>') == "yes"
    assert own("<ARTICLE><P CLASS=x>Up &Amp; down</P></ARTICLE>") == "Up &Amp; down"
    assert own("<p>" + "<b>" * 20000 + "deep" + "</b>" * 20000) == "deep"
    assert own("<div>" * 5000 + "deep words" + "</div>" * 5000) == "deep words"


NOISY = [
    "<nav><a href=/>Home page of ours</a></nav>",
    "<header><h2>Name of the site, in large letters.</h2></header>",
    '<div class="cookie-notice">We use cookies to make this page better for you, accept.</div>',
    '<div id="sidebar"><p>Other things that you may want to read one day.</p></div>',
    '<aside><p>Beside the matter, quite a long sentence stands here.</p></aside>',
    '<div class="ad">Buy this thing now, it is cheap and it is good for you.</div>',
    '<form><label>Write to us here, we read it all.</label><input name=q></form>',
    '<section id="comments"><article class="comment"><p>First! I have read it all and liked it very much, thanks for it.</p></article></section>',
    '<footer>Copyright of the owners, all rights reserved.</footer>',
    '<div role="navigation">Previous and next and other pages of this site.</div>',
    "<noscript>Please turn scripts on to see all of this page.</noscript>",
    '<ul class="breadcrumbs"><li>Start</li><li>Part</li></ul>',
]


def test_boilerplate_goes_wherever_it_stands():
    rng = random.Random(3)
    for i in range(60):
        blocks = [prose(i * 10 + j, rng.randint(2, 40)).capitalize() + "." for j in range(rng.randint(1, 6))]
        inside = "".join(x for b in blocks for x in (f"<p>{b}</p>", rng.choice(["", *NOISY])))
        around = rng.sample(NOISY, 4)
        tag = rng.choice(["article", "main", 'div class="content has-sidebar"', 'div class="post-body"'])
        page = f"<html><body class='with-sidebar'>{around[0]}{around[1]}<{tag}><h1>A headline {i}</h1>{inside}</{tag.split()[0]}>{around[2]}{around[3]}</body></html>"
        assert own(page) == "\n".join([f"A headline {i}", *blocks]), page


def test_names():
    assert all(map(h.noisy, ["ad", "top-ad", "siteHeader", "page-footer", "cookie_consent", "x comments-area", "AdBox", "newsletter-signup"]))
    assert not any(map(h.noisy, ["", "has-sidebar", "article-header", "entry-header", "badge", "headline", "no-comments", "readable", "content", "download", "gradient"]))


def test_form_around_the_page_is_no_noise():
    assert own("<form id=aspnet><nav>Menu</nav><article><h1>T</h1><p>Words of the article.</p></article></form>") == "T\nWords of the article."
    assert own("<article><header><h1>T</h1><p>By me</p></header><p>Words of the article.</p><footer>Filed</footer></article>") == "T\nBy me\nWords of the article."


def site(host, i, seed, article, beside):
    body = "".join(f"<p>{prose(seed + j, 30)}.</p>" for j in range(article))
    side = "".join(f"<p>{prose(seed + 500 + j, 30)}.</p>" for j in range(beside))
    return (seed, f"https://{host}/{i}?x=1", f'<html><body><div class="c-{i + 1000} k1"><div class=a1>{body}</div></div><div class="k2 z{i + 1000}">{side}</div></body></html>')


def test_consensus_beats_a_page_of_its_own(spark):
    """Names say nothing here; on two pages more stands beside the article than in it, and the host's other pages tell which is which."""
    rows = [site("a.example", i, 1000 * i, 4, 1) for i in range(8)] + [site("A.example:80", i, 1000 * i, 1, 4) for i in (20, 21)] + [site("b.example", i, 1000 * i, 1, 4) for i in range(30, 33)]
    rows += [(-1, None, rows[8][2]), (-2, "https://a.example/x", None), (-3, "https://a.example/y", ""), (-4, "mailto:x", "<p>Just a line.</p>"), (-1, None, rows[8][2]), (None, "//a.example/z", "<article><p>Other shape.</p></article>")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"host": F.lit("x"), "path": F.lit("y"), "text": F.lit("z")})
    votes = {r.host: r.path for r in h.consensus(df).collect()}
    assert votes == {"a.example": "html>body>div.c-#.k1>div.a1", "b.example": "html>body>div.k2.z#"}
    got = sorted(h.extract(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.url or ""))
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {r.page_id: r for r in got}
    for i, _, source in rows[:10]:
        want = [x.removesuffix("</p>") for x in source.split("<div class=a1>")[1].split("</div>")[0].split("<p>")[1:]]
        assert by[i].text == "\n".join(want) and by[i].n_chars == len(by[i].text)
    assert by[-1].text.count("\n") == 3 and by[-2].text == by[-3].text == "" and by[-4].text == "Just a line." and by[None].text == "Other shape."


def test_small_tables(spark):
    assert h.extract(spark.createDataFrame([], SCHEMA)).count() == 0
