"""Pages of which no heading, paragraph or article may be lost."""

import math

import numpy as np
import pytest

from turnstone.llm import extraction

LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>link number {i}</a></li>" for i in range(20)) + "</ul>"


def words(n: int, i: int = 0) -> str:
    return (f"w{i} " + "text " * n)[: n - 2] + "x."


def page(lengths: list[int], wrap: str = "<div>{}</div>") -> tuple[str, list[str]]:
    texts = [words(n, i) for i, n in enumerate(lengths)]
    return f"<body>{LINKS}{wrap.format(''.join(f'<p>{t}</p>' for t in texts))}{LINKS}</body>", texts


@pytest.mark.parametrize("long", [1500, 4000, 20_000])
@pytest.mark.parametrize("place", [0, 9, 18])
@pytest.mark.parametrize("heading", [True, False])
def test_one_very_long_block(long, place, heading):
    lengths = [400] * 19
    lengths[place] = long
    html, texts = page(lengths)
    if heading:
        html, texts = html.replace("<div>", "<div><h1>A heading of about forty characters here</h1>"), ["A heading of about forty characters here", *texts]
    assert extraction.main_text(html).split("\n") == texts


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "{}"])
def test_short_lines_around_the_content(wrap):
    html, texts = page([50, 60, 400, 300, 500, 80, 60, 40], wrap)
    assert extraction.main_text(html).split("\n") == texts


def test_article_of_short_lines_stays():
    long = "".join(f"<p>{words(900, i)}</p>" for i in range(5))
    got = extraction.main_text(f"<body><article>{long}</article><article><p>Short one.</p><p>And two.</p></article></body>")
    assert got.endswith("Short one.\nAnd two.") and got.count("\n") == 6


@pytest.mark.parametrize("wrapper", ["class='container with-sidebar'", "id='page' class='has-comments'", "class='sidebar-layout'", "class='no-ads'"])
@pytest.mark.parametrize("inner", ["article", "main", "div role=main"])
def test_wrappers_keep_the_article(wrapper, inner):
    texts = [words(300, i) for i in range(4)]
    got = extraction.main_text(f"<body><div {wrapper}>{LINKS}<{inner}>{''.join(f'<p>{t}</p>' for t in texts)}</{inner.split()[0]}></div></body>")
    assert got.split("\n") == texts


def test_hints_inside_an_article():
    kept = f"<h1>Title</h1><p>{words(300)}</p><h2 id='legal-status'>Status</h2><p class='copyright-history'>{words(200, 1)}</p><section id='discussion'><p>{words(100, 2)}</p></section>"
    left = f"<div class='comments'><article><p>{words(90, 3)}</p></article></div><section id='comments'><p>Me too</p></section><div class='share-buttons'>Share</div>"
    got = extraction.main_text(f"<body><article>{kept}{left}</article></body>")
    assert got.split("\n") == ["Title", words(300), "Status", words(200, 1), words(100, 2)]


def test_names_that_say_nothing_keep_their_text():
    own = f"<h1>Title</h1><p>{words(300)}</p><div id='related-work'><h2 id='search-results'>Earlier work</h2><p>{words(200, 1)}</p></div>"
    got = extraction.main_text(f"<body>{LINKS}<article>{own}<div class='ad-top'>Buy</div></article></body>")
    assert got.split("\n") == ["Title", words(300), "Earlier work", words(200, 1)]
    got = extraction.main_text(f"<body>{LINKS}<div class='legal-analysis'><p>{words(300, 2)}</p><p>{words(200, 3)}</p></div>{LINKS}</body>")
    assert got.split("\n") == [words(300, 2), words(200, 3)]


EVERY = lambda lines: np.ones(len(lines), bool)
ITEMS = "<ul>" + "".join(f"<li>item {i}</li>" for i in range(20)) + "</ul>"
TAGS = "<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>"


@pytest.mark.parametrize(
    "html",
    [
        # a list of links in an article, by whatever name
        f"<body>{LINKS}<article><p>{words(400)}</p><p>{words(300, 1)}</p>{TAGS}<div class=q>{LINKS}</div></article><footer>(c)</footer></body>",
        # no names at all: the menu goes by its ratios
        f"<body><div>{ITEMS}</div><div><p>{words(400)}</p><p>{words(300, 1)}</p></div><div>{ITEMS}</div></body>",
    ],
)
def test_clusters_decide(html):
    assert extraction.main_text(html).split("\n") == [words(400), words(300, 1)]
    assert extraction.main_text(html, EVERY) != extraction.main_text(html)


def test_long_references_are_text():
    """Lines that are links but in the upper cluster stay."""
    titles = [words(150, i) for i in range(8)]
    refs = "".join(f"<li><a href='/{i}'>{t}</a></li>" for i, t in enumerate(titles))
    got = extraction.main_text(f"<body>{LINKS}<article><p>{words(200, 9)}</p><ul>{refs}</ul></article>{LINKS}</body>")
    assert got.split("\n") == [words(200, 9), *titles]


def brute_split(values):
    """2-means in one dimension by trying every cut."""
    x = sorted(values)
    if len(x) < 3 or x[-1] - x[0] <= math.log(2):
        return [True] * len(values)
    cost = lambda part: sum((v - sum(part) / len(part)) ** 2 for v in part)
    cut = min((i for i in range(1, len(x)) if x[i] != x[i - 1]), key=lambda i: cost(x[:i]) + cost(x[i:]))
    return [v >= x[cut] for v in values]


def brute_smooth(values):
    out = []
    for i in range(len(values)):
        near = [(math.exp(-0.5 * (i - j) ** 2), v) for j, v in enumerate(values) if abs(i - j) <= 3]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def random_page(rng):
    """A well-formed page as nested lists of (tag, children or text), and its html."""

    def text(n, link=False):
        t = words(n, int(rng.integers(0, 999)))
        return ("a", t) if link else ("", t)

    def box(depth):
        kids = []
        for _ in range(int(rng.integers(1, 6))):
            kind = rng.integers(0, 6)
            if kind == 0 and depth < 3:
                kids.append(("div", box(depth + 1)))
            elif kind == 1:
                kids.append(("ul", [("li", [text(int(rng.integers(5, 12)), True)]) for _ in range(int(rng.integers(2, 7)))]))
            elif kind == 2:
                kids.append(("h2", [text(int(rng.integers(8, 40)))]))
            else:
                kids.append(("p", [text(int(rng.integers(5, 400)), rng.random() < 0.15)]))
        return kids

    return [("nav", box(3)), ("article", box(0)), ("div", box(2)), ("article", box(1)), ("footer", box(3))]


def brute_page(tree):
    """Text of such a page: lines, ratios, clusters and segments by plain recursion."""
    lines, state = [], {"tags": 1, "n": 0, "region": 0}  # <body>

    def walk(nodes, holder, region, out, parent="body"):
        for tag, kids in nodes:
            if tag in ("", "a"):
                lines.append([kids, state["tags"] + 2 * (tag == "a") + 1, holder, region, out, tag == "a", parent])  # with the end tag of its block
                state["tags"] = -1
                continue
            state["tags"] += 1
            state["n"] += 1
            mine = state["n"] if tag in ("div", "ul", "nav", "article", "footer") else holder
            inside = region
            if tag == "article":
                state["region"] += 1
                inside = state["region"]
            walk(kids, mine, inside, out or tag in ("nav", "footer"), tag)
            state["tags"] += 1

    walk(tree, 0, 0, False)
    upper = brute_split(brute_smooth([math.log1p(len(t) / max(1, tags)) for t, tags, *_ in lines]))
    own = [(x, u) for x, u in zip(lines, upper) if x[3] and not x[4]]

    def fine(segment):
        part = [(x, u) for x, u in own if x[2] == segment]
        size = lambda pick: sum(len(x[0]) for x, u in part if pick(x, u))
        every = size(lambda x, u: True)
        return 2 * size(lambda x, u: u) >= every or 2 * size(lambda x, u: x[5]) <= every

    stays = [fine(x[2]) for x, _ in own]
    paragraphs = [i for i, (x, _) in enumerate(own) if stays[i] and x[6] == "p" and not x[5]]
    between = lambda i: any(own[j][0][3] == own[i][0][3] and j < i for j in paragraphs) and any(own[j][0][3] == own[i][0][3] and j > i for j in paragraphs)
    kept = [x for i, (x, _) in enumerate(own) if stays[i] or between(i)]
    if not kept:
        most = max({x[3] for x, _ in own}, key=lambda r: sum(len(x[0]) for x, _ in own if x[3] == r))
        kept = [x for x, _ in own if x[3] == most]
    return "\n".join(x[0] for x in kept)


def html_of(nodes):
    return "".join(k if not t else f"<a href=x>{k}</a>" if t == "a" else f"<{t}>{html_of(k)}</{t}>" for t, k in nodes)


def test_pages_equal_brute_force():
    rng, differ = np.random.default_rng(12), 0
    for _ in range(300):
        tree = random_page(rng)
        html = f"<body>{html_of(tree)}</body>"
        got = extraction.main_text(html)
        assert got == brute_page(tree)
        differ += got != extraction.main_text(html, EVERY)
    assert differ > 20


ARTICLE = f"<article><h1>Title</h1><p>{words(300)}</p><p>{words(250, 1)}</p></article>"


@pytest.mark.parametrize("page", [f"<form id=aspnetForm>{LINKS}{ARTICLE}</form>", f"<form id=aspnetForm><div><p>{words(300)}</p><p>{words(250, 1)}</p></div></form>", f"<div aria-hidden=true>{ARTICLE}</div>", f"<div role=form>{ARTICLE}</div>"])
def test_frames_around_the_article_stay(page):
    assert extraction.main_text(f"<body aria-hidden='true'>{page}</body>").split("\n")[-2:] == [words(300), words(250, 1)]


def test_forms_in_and_beside_an_article_go():
    form = "<form><p>Your name and a few words on this form</p></form>"
    assert extraction.main_text(f"<body>{form}{ARTICLE.replace('</article>', form + '</article>')}{form}</body>").split("\n") == ["Title", words(300), words(250, 1)]
    assert extraction.main_text(f"<body><article><p>Short news.</p></article><form><p>{words(80)}</p></form></body>") == "Short news."


@pytest.mark.parametrize("holder", ["section id=responses", "div id=comments", "section class=comment-list", "div class=q"])
@pytest.mark.parametrize("own", [f"<p>{words(400, 5)}</p>", "<p>Short news.</p>"])
def test_comments_go_however_short_the_article(holder, own):
    comments = "".join(f"<article class=comment><p>{words(500, i)}</p></article>" for i in range(3))
    got = extraction.main_text(f"<body>{LINKS}<article>{own}</article><{holder}>{comments}</{holder.split()[0]}></body>")
    assert got == own[3:-4]


def test_links_between_paragraphs_stay():
    links = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(8))
    got = extraction.main_text(f"<body>{LINKS}<article><h1>Title</h1><p>{words(300)}</p><h2>The list</h2><ul>{links}</ul><p>{words(200, 1)}</p><ul>{links}</ul></article></body>")
    assert got.split("\n") == ["Title", words(300), "The list", *[f"item {i}" for i in range(8)], words(200, 1)]


def test_a_comment_that_never_ends_is_no_text():
    assert extraction.main_text(f"<body><article><p>{words(300)}</p></article><!-- {'lost ' * 100_000}") == words(300)


def test_split_equals_every_cut():
    rng = np.random.default_rng(3)
    for n in range(1, 40):
        values = rng.choice(rng.normal(0, 2, max(1, n // 2)), n)
        assert extraction.upper_cluster(values).tolist() == brute_split(values.tolist())
        assert np.allclose(extraction.smoothed(values), brute_smooth(values.tolist()))


def test_awkward_pages(spark):
    long = f"<article>{''.join(f'<p>{words(900, i)}</p>' for i in range(3000))}</article>"
    rows = [(1, "u", long, "x"), (2, None, None, None), (None, "u", "", "y"), (1, "u", long, "x"), (3, "u", "<p>unclosed <b>text<p>two</b><article>", "z"), (4, "u", "&amp;&#65;&bogus; <", "q")]
    got = extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6 and sorted(len(r) for r in got) == [4] * 6
    by = {(r.page_id, r.text) for r in got}
    assert (2, "") in by and (None, "") in by and (1, "\n".join(words(900, i) for i in range(3000))) in by and (4, "&A&bogus; <") in by
