import pytest

from tickerloom.llm import html_text, queries

P1 = "Hello, world, this is a long paragraph of text, with commas, yes."
P2 = "A second paragraph that also says a lot of things, as articles do."
ARTICLE = f"<h1>Title</h1><p>{P1}<p>{P2}"
WANT = f"Title\n{P1}\n{P2}"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>foot</footer></body>",
        f"<div class='site-header'>Site</div><div id=main-menu><a href=a>a</a></div><div class=content>{ARTICLE}</div><div class='sidebar'><p>{P1} {P1}</p></div>",
        f"<main><div class='cookie-notice'>We use cookies, and more cookies, and even more, on this site.</div>{ARTICLE}<section id=comments><p>{P2} says a reader</p></section></main>",
        f"<body><article>{ARTICLE}<form><input value=1>Subscribe to this, please, now, today</form><aside>related, things</aside></article>",
        f"<div><div class=ad><p>Buy this, now, it is cheap, and good, really.</p></div><div>{ARTICLE}</div><div hidden><p>{P1}</p></div></div>",
        f"<article>{ARTICLE}<ul><li><a href=1>more of one</a></li><li><a href=2>more of two</a></li></ul></article>",
    ],
)
def test_article(page):
    assert html_text.main_text(page) == WANT


def test_text_rules():
    assert html_text.main_text("<p>a &amp; b&nbsp;\n\t c<br>d &#233; &lt;x&gt;</p>") == "a & b c d é <x>"
    assert html_text.main_text("<div><p>one <b>two</b>three</p>tail</div>") == "one twothree\ntail"
    assert html_text.main_text("no tags here") == "no tags here"
    assert html_text.main_text("<p>cut off <a hre") == "cut off"
    assert html_text.main_text("<!-- <p>x</p> --><style>p{}</style>") == ""
    assert html_text.main_text("<table><tr><td>left cell<td>right cell</table>") == "left cell\nright cell"


def test_sections_of_one_article_stay_together():
    page = "<body>" + "<div id=wrap>" + "".join(f"<section><h2>Part {i}</h2><p>{P1}</p></section>" for i in range(3)) + "</div></body>"
    assert html_text.main_text(page) == "\n".join(f"Part {i}\n{P1}" for i in range(3))


def test_query(spark, tmp_path):
    rows = [(1, "u", f"<p>{P1}</p>", 5), (1, "u", f"<p>{P1}</p>", 5), (2, None, None, 6), (None, "w", "", 7), (4, "v", "<b>" * 3000 + "deep", 8), (5, "x", "<p>" + "word " * 50_000, 9)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text int").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op3_html_extraction"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(P1)), (1, len(P1)), (2, 0), (4, 4), (5, 249_999)]
    assert all(len(r.text) == r.n_chars for r in got)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.QUERIES["op3_html_extraction"](spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout has-sidebar", "main no-sidebar", "post with-comments", "side-by-side"])
def test_a_wrapper_with_a_doubtful_name_keeps_the_article(name):
    side = f"<div class=sidebar><p>{P2}</p></div>"
    assert html_text.main_text(f"<body><div class='{name}'><article>{ARTICLE}</article>{side}</div></body>") == WANT
    assert html_text.main_text(f"<body><div class='{name}'><div class=text>{ARTICLE}</div>{side}</div></body>") == WANT
    assert html_text.main_text(f"<body><div class='{name}'>{ARTICLE}</div></body>") == WANT


def test_a_form_around_the_page_and_an_article_of_doubtful_parts():
    assert html_text.main_text(f"<body><form action=/><nav>n</nav><div>{ARTICLE}</div></form></body>") == WANT
    parts = "".join(f"<div class='side-by-side'><p>{p}</p></div>" for p in (P1, P2))
    assert html_text.main_text(f"<body><div>{parts}</div></body>") == f"{P1}\n{P2}"


def test_longer_comments_are_still_not_the_article():
    said = "".join(f"<article class=comment-body><p>{P2} says {i}</p></article>" for i in range(3))
    assert html_text.main_text(f"<main><article>{ARTICLE}</article><div id=comments>{said}</div></main>") == WANT
    assert html_text.main_text(f"<body><div>{ARTICLE}</div><div id=comments><p>{P2} says a reader</p></div></body>") == WANT


def test_formulas_belong_to_the_article():
    page = f"<article><p>{P1}<p>The sum is <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>, as shown, above.</article>"
    assert html_text.main_text(page) == f"{P1}\nThe sum is x=2, as shown, above."


def test_lists_and_tables_that_belong_to_the_article():
    refs = "<ol><li><a href=1>Smith, J. On paragraphs. Journal of Texts.</a></li><li><a href=2>Doe, K. On commas.</a></li></ol>"
    want = f"{WANT}\nSmith, J. On paragraphs. Journal of Texts.\nDoe, K. On commas."
    assert html_text.main_text(f"<article>{ARTICLE}{refs}</article>") == want
    table = "<table><tr><td><a href=1>Cell one</a></td><td>2</td></tr></table>"
    assert html_text.main_text(f"<article>{ARTICLE}{table}</article>") == f"{WANT}\nCell one\n2"
    links = "<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>"
    assert html_text.main_text(f"<article>{ARTICLE}<p>The parts are:</p>{links}</article>") == f"{WANT}\nThe parts are:\none\ntwo"
    assert html_text.main_text(f"<article>{ARTICLE}<ul><li>note <ul><li><a href=1>one</a></li></ul></li></ul></article>") == f"{WANT}\nnote"


def test_names_on_paragraphs_and_attributes_of_other_names():
    assert html_text.main_text(f"<article>{ARTICLE}<p class=advert>Buy this, now, it is cheap, and good, really.</p></article>") == WANT
    assert html_text.main_text(f"<article><h2 id=privacy>Title</h2><p id=survey>{P1}<p title='a hidden gem' data-hidden=1>{P2}</article>") == WANT
    assert html_text.main_text(f"<p class=notice>{P1}</p>") == P1


@pytest.mark.parametrize(
    "part",
    ["<b>", "</i>", "<div>word word, ", "<b><i><p>one, two", '<a ">"', "<ul><li><a>x", "<table><tr><td>x", "<div class=menu><main>", "<!-- x ", "<p class='", "</p>", "<h1>x", "&", "<"],
)
def test_broken_markup_takes_time_by_length(part):
    import time

    start = time.process_time()
    html_text.main_text("<b>" * 50_000 + part * (600_000 // len(part)) + "</i>" * 50_000)
    assert time.process_time() - start < 10


def test_parser_and_sums_against_a_plain_tree():
    """Trees of random elements: html.parser reads them, and every block walks all its ancestors."""
    import random
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tags, self.up, self.stack, self.lines, self.held = ["#"], [-1], [0], [], []

        def end_line(self):
            line = " ".join("".join(t for _, t in self.held).split())
            if line:
                self.lines.append((next(n for n, t in self.held if t.strip()), line, sum(len(t) for n, t in self.held if self.linked(n))))
            self.held = []

        def linked(self, n):
            return n > 0 and (self.tags[n] == "a" or self.linked(self.up[n]))

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCK:
                self.end_line()
            self.tags.append(tag)
            self.up.append(self.stack[-1])
            self.stack.append(len(self.tags) - 1)

        def handle_endtag(self, tag):
            assert self.tags[self.stack.pop()] == tag
            if tag in html_text.BLOCK:
                self.end_line()

        def handle_data(self, data):
            self.held.append((self.stack[-1], data))

    def tree(rng, depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "section", "span", "a", "em"]) if depth else None
            out += f"<{tag}>{tree(rng, depth - 1)}</{tag}>" if tag else rng.choice(["<p>{}</p>", "{}", "<a>{}</a>"]).format(rng.choice(["short ", P1, P2, "a, b, c, d, "]))
        return out

    for seed in range(60):
        source = tree(random.Random(seed), 5)
        page, plain = html_text.Page(source), Plain()
        plain.feed(source)
        plain.close()
        plain.end_line()
        assert list(page.blocks()) == plain.lines and page.tag == plain.tags and page.up == plain.up
        letters, points = [0] * len(plain.tags), [0.0] * len(plain.tags)
        for n, line, linked in plain.lines:
            while n and plain.tags[n] not in html_text.BLOCK:
                n = plain.up[n]
            above = [n]
            while above[-1] >= 0:
                above.append(plain.up[above[-1]])
            for x in above[:-1]:
                letters[x] += len(line)
            if len(line) >= 25:
                worth = (1 + line.count(",") + min(len(line) / 100, 3)) * (1 - min(linked, len(line)) / len(line))
                from_ = above[1:-1] if plain.tags[n] == "p" else above[:-1]
                for share, x in zip([1, 1 / 2, 1 / 6, 1 / 9, 1 / 12], from_):
                    points[x] += worth * share
        score, counted, _, _ = html_text.scores(page, 25, 5)
        assert counted == letters and score == pytest.approx(points)
