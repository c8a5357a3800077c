"""op4 on parts of articles whose names or elements look like what it drops."""

import random

import pytest

from duebook.llm import html_main

PROSE = "<p>" + "Some prose of the article goes on here and there. " * 6 + "</p>"
SHORT = "<p>Second part, which is shorter but still prose.</p>"


def text(page):
    parts = html_main.read(page)
    up = html_main.above(parts)
    found = {p: (f, o) if up[p][1] else (f - x, o + x) for p, (f, o, x, _) in html_main.own(parts).items()}
    return html_main.text_at(parts, html_main.climb(found, up, html_main.best(html_main.scores(parts)))) if found else ""


@pytest.mark.parametrize("page,held", [
    (f'<body><form id="aspnetForm"><div class="content">{PROSE}{SHORT}</div></form>', ["Some prose", "Second part"]),
    (f'<body><nav>menu</nav><div class="widget-content"><h1>Title</h1>{PROSE}</div><footer>foot</footer>', ["Title", "Some prose"]),
    (f'<body><article><div class="header"><h1>My title</h1></div>{PROSE}</article>', ["My title"]),
    (f'<body><article><section class="banner"><h1>My title</h1></section>{PROSE}</article>', ["My title"]),
    (f'<body><article><section class="header"><h1>My title</h1></section>{PROSE}</article>', ["My title"]),
    (f'<body><div class="post"><header><h1>My title</h1></header>{PROSE}</div>', ["My title"]),
    (f'<body><article><h1>T</h1>{PROSE}<section id="related"><p>Related work is this.</p></section></article>', ["Related work"]),
    (f'<body><article><h1>T</h1>{PROSE}<p class="share">In 2020 the market share grew.</p></article>', ["market share"]),
    (f'<body><article><h1>T</h1>{PROSE}<h2 id="social">Social life</h2>{SHORT}<h2 id="comments">Comments on it</h2>{SHORT}</article>', ["Social life", "Comments on it"]),
    (f'<body><nav>m</nav><section class="a">{PROSE}</section><section class="b">{SHORT}</section></body>', ["Some prose", "Second part"]),
])
def test_parts_of_the_article_stay(page, held):
    found = text(page)
    assert all(h in found for h in held) and "menu" not in found and "foot" not in found


@pytest.mark.parametrize("part", [
    '<header class="site-header"><h1>Site name</h1><nav>a</nav></header>', '<header><h1>Site name</h1></header>', '<div id="comments"><p>A reader says so.</p></div>',
    '<div class="share"><a href=x>Tweet</a> <a href=y>Post</a></div>', "<form><input> Search here</form>", f'<div class="cookie-notice"><p>{"We use cookies. " * 60}</p></div>',
    '<div class="comments-list"><h2>Comments</h2><p>A reader says so.</p></div>', '<aside><p>More to read elsewhere.</p></aside>', '<p class="notice">Mind the notice.</p>',
    '<div class="related"><ul><li><a href=x>Another story</a></li></ul></div>', '<div class="copyright">(c) 2020 Corp</div>', '<div role="banner">Logo text</div>',
])
@pytest.mark.parametrize("place", ["before", "within", "after"])
def test_what_is_no_part_goes(part, place):
    if place == "within" and part.startswith("<header"):
        pytest.skip("a header inside the article is its own")
    before, within, after = (part if place == p else "" for p in ("before", "within", "after"))
    found = text(f"<body>{before}<article><h1>T</h1>{PROSE}{within}{SHORT}</article>{after}</body>")
    assert found == f"T {'Some prose of the article goes on here and there. ' * 6}Second part, which is shorter but still prose."


def test_articles_with_misleading_names(spark):
    """A host whose article parts carry the names of what is dropped, amid real menus and notices."""
    r = random.Random(4)
    words = lambda n: " ".join(r.choice("aber bort cass dend elms fort gild hame".split()) + str(r.randrange(1000)) for _ in range(n))
    pages, want = [], {}
    for k in range(40):
        title, lead, body, more = words(4), words(25), [words(40) for _ in range(3)], words(30)
        want[k] = " ".join([title, lead, *body, more])
        pages.append((k, f"https://h.example/{k}", f"""<html><body><form id="page"><div class="site-header"><h2>Daily</h2><nav><a href=/>Home</a></nav></div>
<div class="post"><div class="header"><h1>{title}</h1></div><p class="banner">{lead}</p><div class="body">{''.join(f'<p>{b}</p>' for b in body)}</div><p id="related">{more}</p></div>
<div class="cookie-notice"><p>We set cookies.</p></div><div class="comments"><p>{words(50)}</p></div><footer>Imprint</footer></form></body></html>"""))
    got = {x["page_id"]: x["text"] for x in html_main.op4(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert sum(got[k] == want[k] for k in want) == len(want), next((got[k], want[k]) for k in want if got[k] != want[k])


@pytest.mark.parametrize("page", ["<b>x" * 30_000, "<div class=header>x" * 20_000, "<h1 class=share>x" * 20_000])
def test_deep_pages_take_linear_time(page):
    assert isinstance(html_main.read(page), list)


def test_consensus_climbs_as_one_page_does(spark):
    """Summed over a host's pages by hand, ``climb`` gives the paths that Spark finds."""
    from collections import Counter, defaultdict

    r = random.Random(21)
    words = lambda n: " ".join(r.choice("aber bort cass dend elms fort".split()) + str(r.randrange(50)) for _ in range(n))

    def part(depth):
        if depth == 0 or r.random() < 0.3:
            return f"<p>{r.choice([words(r.randint(1, 30)), 'the same on many pages', '<a href=x>' + words(6) + '</a>'])}</p>{r.choice(['', words(3)])}"
        tag = r.choice(["div", "section", "article", "div class=x", "div class=y1", "ul"])
        return f"<{tag}>{''.join(part(depth - 1) for _ in range(r.randint(1, 4)))}</{tag.split()[0]}>"

    pages = [(k, f"http://h{k % 12 if k % 7 else 100 + k}.example/", f"<body>{part(5)}</body>") for k in range(150)]
    by_host = defaultdict(list)
    for _, url, page in pages:
        by_host[url.split("/")[2]].append(page)
    want = {}
    for where, texts in by_host.items():
        score, sums, up, held = Counter(), {}, {}, defaultdict(list)
        for page in texts:
            parts = html_main.read(page)
            score.update(html_main.scores(parts))
            up |= html_main.above(parts)
            for p, x in html_main.own(parts).items():
                held[p, x[3]].append((page, x))
        several = len(set(texts)) > 1
        for (p, _), found in held.items():
            f, o, x = (sum(v[k] for _, v in found) for k in range(3))
            again = f if len({page for page, _ in found}) > 1 else 0
            x = 0 if several or up[p][1] else x
            a, b = sums.get(p, (0, 0))
            sums[p] = (a + f - again - x, b + o + again + x)
        good = {p: n for p, n in score.items() if n > 0}
        if good:
            want[where] = html_main.climb(sums, up, html_main.best(good))
    got = {x["host"]: x["path"] for x in html_main.consensus(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want and len({p.count("/") for p in want.values()}) > 2


def test_very_deep_pages_have_a_path(spark):
    deep = "<body>" + "<div>" * 1000 + PROSE + SHORT + "</div>" * 1000
    rows = [(k, "http://deep.example/", deep.replace("goes", f"goes{k}")) for k in range(3)] + [(9, "http://deep.example/", None)]
    got = html_main.op4(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sum("Second part" in x["text"] and "Some prose" in x["text"] for x in got) == 3
