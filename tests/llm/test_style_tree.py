"""The site style tree: whole stories stay, what a host repeats at a place goes; equal to a tree built by brute force."""

import math
import random
from collections import defaultdict

import pytest

from clicklake.llm import html_text

COLUMNS = "page_id long, url string, html string"


def texts(spark, pages, hosts="h.example"):
    rows = [(i, f"http://{hosts}/{i}", p) for i, p in enumerate(pages)]
    return [r["text"] for r in html_text.extract(spark, spark.createDataFrame(rows, COLUMNS)).orderBy("page_id").collect()]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><h1>T{0}</h1><div><p class=note>Same notice</p></div><div><p>Unique {0} a</p></div><div><p>Unique {0} b</p></div></article>", "T{0}\nUnique {0} a\nUnique {0} b"),
        ("<main><h1>T{0}</h1><div><span>Share this page</span></div><div><p>Unique {0} story</p><p>Second {0}</p></div></main>", "T{0}\nUnique {0} story\nSecond {0}"),
        ("<article><table><tr><th>Year</th><th>Sum</th></tr><tr><td>{0}</td><td>1{0}</td></tr></table></article>", "Year\nSum\n{0}\n1{0}"),
        ("<section><h2>Method</h2></section><section><p>Unique {0}</p></section>", "Method\nUnique {0}"),
        ("<article><h2>Introduction</h2><p>a {0}</p><h2>Results</h2><p>b {0}</p><ul><li>Yes</li><li>No</li></ul></article>", "Introduction\na {0}\nResults\nb {0}\nYes\nNo"),
        ("<article><h1>T{0}</h1><p>Story {0}</p><p>Read our terms before posting here.</p></article>", "T{0}\nStory {0}"),
        ("<div><ul><li>Home</li><li>About</li></ul></div><div><p>Story {0}</p></div>", "Story {0}"),
        ("<article><h1>T{0}</h1><section><h2>More of it</h2><p>Get our app</p></section><section><h2>More</h2><p>Story {0} in words enough</p></section></article>", "T{0}\nMore\nStory {0} in words enough"),
        ("<article><p>The same words alone</p></article>", "The same words alone"),
    ],
)
def test_whole_stories_stay(spark, page, want):
    assert texts(spark, [page.format(i) for i in range(20)]) == [want.format(i) for i in range(20)]


def test_places_from_the_end_agree_on_pages_of_any_length(spark):
    story = lambda i: [f"Story {i} has part {k} of its own" for k in range(1 + i % 7)]
    pages = ["<article>" + "".join(f"<p>{x}</p>" for x in [*story(i), "Read our terms before posting here."]) + "</article>" for i in range(30)]
    assert texts(spark, pages) == ["\n".join(story(i)) for i in range(30)]


def test_copies_of_a_page_are_one_page(spark):
    """Nine of twelve pages are copies, four of them with a changed end: nothing of them is template."""
    story = "<article><h1>Title of it</h1><p>A story that was copied, long enough to be what tells pages apart</p><p>{}</p></article>"
    pages = [story.format("the end")] * 5 + [story.format(f"end {i}") for i in range(4)] + [f"<article><h1>Other {i}</h1><p>Another story {i}</p></article>" for i in range(3)]
    assert texts(spark, pages) == [html_text.main_text(p) for p in pages]


def test_joined_by_host_in_parts_as_broadcast(spark, monkeypatch):
    page = "<article><h1>T{0}</h1><p>Sign up</p><p>Story {0} {1}</p></article>"
    rows = [(i, f"http://{'big' if i % 3 else f'h{i % 2}'}.example/{i}", page.format(i, i * i)) for i in range(90)] + [(90, None, None), (91, "http://one.example/", page.format(1, 1))]
    pages = spark.createDataFrame(rows, COLUMNS)
    want = sorted(map(tuple, html_text.extract(spark, pages).collect()))
    assert sum("Sign up" in r[2] for r in want) == 1
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(html_text, "PART_PAGES", 10)
    assert sorted(map(tuple, html_text.extract(spark, pages).collect())) == want


def brute_force(pages):
    """Texts of pages given as nested (tag, [child or words]) below one article, by a tree of nested names and whole sets of pages."""

    def walk(node, front, back, visit):
        visit(node, front, back)
        tags = ["words" if isinstance(c, str) else c[0] for c in node[1]]
        for k, c in enumerate(node[1]):
            at = (tags[k], tags[:k].count(tags[k])), (tags[k], tags[k:].count(tags[k]))
            if isinstance(c, str):
                visit(c, (*front, at[0]), (*back, at[1]))
            else:
                walk(c, (*front, at[0]), (*back, at[1]), visit)

    there = defaultdict(lambda: defaultdict(set))  # place -> what is there -> marks of pages
    for page in pages:
        words = []
        walk(page, (), (), lambda x, f, b: words.append(x) if isinstance(x, str) else None)
        by_length = sorted(set(words), key=lambda t: (-len(t), [-ord(c) for c in t]))

        def add(x, front, back):
            if isinstance(x, str):
                mark = next((w for w in by_length if w != x), None) if x == by_length[0] else by_length[0]
                for side, at in (("f", front), ("b", back)):
                    there[side, at, "w"][x].add(mark)
            elif any(not isinstance(c, str) for c in x[1]):
                for side, at in (("f", front), ("b", back)):
                    there[side, at, "s"][tuple("words" if isinstance(c, str) else c[0] for c in x[1])].add(by_length[0])

        walk(page, (), (), add)

    def worth(kind, what, front, back):
        found = [1.0]
        for side, at in (("f", front), ("b", back)):
            here = there[side, at, kind]
            m = sum(len(v) for v in here.values())
            if m >= 5:
                found.append(1 - math.log(len(here[what])) / math.log(m) if kind == "w" else -sum(len(v) / m * math.log(len(v) / m) for v in here.values()) / math.log(m))
        return min(found)

    stays = {"h2", "ul", "li"}
    out = []
    for page in pages:
        known = {}

        def value(node, front, back):
            tags = ["words" if isinstance(c, str) else c[0] for c in node[1]]
            got = []
            for k, c in enumerate(node[1]):
                f, b = (*front, (tags[k], tags[:k].count(tags[k]))), (*back, (tags[k], tags[k:].count(tags[k])))
                if isinstance(c, str):
                    w = worth("w", c, f, b)
                    got.append((w, w < 0.3, True))
                else:
                    got.append(value(c, f, b))
            blocks = len(tags) - tags.count("words")
            shape = worth("s", tuple(tags), front, back) if blocks else 1.0
            g = 0.9**blocks
            known[id(node)] = got, ((1 - g) * shape + g * sum(x[0] for x in got) / len(got), all(x[1] for x in got), node[0] not in stays and any(x[2] for x in got))
            return known[id(node)][1]

        def left(node, fixed, top=False):
            got, (w, solid, free) = known[id(node)]
            if not top and not fixed and solid and free and w < 0.3:
                return []
            fixed = fixed or node[0] in stays
            return [t for c, x in zip(node[1], got) for t in (([c] if fixed or x[0] >= 0.3 else []) if isinstance(c, str) else left(c, fixed))]

        value(page, (), ())
        everything = []
        walk(page, (), (), lambda x, f, b: everything.append(x) if isinstance(x, str) else None)
        out.append("\n".join(left(page, False, True) or everything))
    return out


def test_tree_equals_brute_force(spark):
    draw = random.Random(11)
    common = [f"said on many pages {k}" for k in range(6)]

    def block(i, depth):
        tag = draw.choice(["div", "section", "p", "h2", "li"]) if depth else "p"
        words = lambda: draw.choice(common) if draw.random() < 0.55 else f"own {i} {draw.randrange(10**6)}"
        if tag in ("p", "h2", "li"):
            return (tag, [words()])
        items = [block(i, depth - 1) for _ in range(draw.randrange(1, 4))]
        return (tag, ([words()] if draw.random() < 0.3 else []) + items)

    def markup(node):
        return f"<{node[0]}>" + "".join(c if isinstance(c, str) else markup(c) for c in node[1]) + f"</{node[0]}>"

    layouts = [random.Random(k) for k in range(3)]
    pages = []
    for i in range(60):
        draw.seed(layouts[i % 3].randrange(4) + 100 * (i % 3))  # pages of a layout share tags and words, but for their own
        page = ("article", [*(block(i, 2) for _ in range(draw.randrange(2, 6))), ("p", [f"the story of page {i} with words enough to be its longest run {i}"])])
        pages.append(page)
    want = brute_force(pages)
    got = texts(spark, [markup(p) for p in pages])
    assert got == want
    assert sum(w != html_text.main_text(markup(p)) for w, p in zip(want, pages)) > 10
