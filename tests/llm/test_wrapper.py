"""Wrapper induction on hosts that are laid out so that a part of the page could pass for all of it."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("pyarrow")
from millrace.llm import wrapper  # noqa: E402

SOME = "river stone paper light garden window copper basil meadow lantern orbit velvet".split()


def words(seed, n):
    r = random.Random(str(seed))
    return " ".join(r.choices(SOME, k=n)) + f" {seed}"


def texts(spark, pages):
    rows = [(i, f"http://{host}.example/{i}", f"<html><body><nav>menu</nav>{body}<footer>end</footer></body></html>") for i, (host, body) in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in wrapper.html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_slot_holds_all_that_varies(spark):
    pages, want = [], []
    for i in range(8):
        h, l, b = words(("h", i), 4), words(("l", i), 8), [words(("b", i, j), 60) for j in range(5)]
        pages.append(("lead", f"<article><h1>{h}</h1><p class=lead>{l}</p><div class=body>{''.join(f'<p>{x}</p>' for x in b)}</div></article>"))
        want.append("\n".join([h, l, *b]))
    for i in range(6):  # no article; the varying parts have only the page in common
        h, b = words(("t", i), 30), words(("u", i), 200)
        pages.append(("bare", f"<div class=t>{h}</div><div class=c><p>{b}</p></div>"))
        want.append(f"{h}\n{b}")
    for i in range(6):  # as many sections as the page has
        b = [words(("s", i, j), 20) for j in range(1 + i % 3)]
        pages.append(("parts", f"<div class=all>{''.join(f'<div class=section><p>{x}</p></div>' for x in b)}</div>"))
        want.append("\n".join(b))
    got = texts(spark, pages)
    assert [got[i] for i in range(len(pages))] == want


def of(*pages):
    """The host's template, made from its pages as the operator does."""
    trees = [wrapper.skeleton(wrapper.parse(p))[0] for p in pages]
    met = {}
    for t in trees:
        for k, v in wrapper.tally(trees[0], t).items():
            met[k] = tuple(a + b for a, b in zip(met.get(k, (0, 0, 0, 0)), v, strict=True))
    return (trees[0], *wrapper.induce(trees[0], len(pages), met))


def test_stub_pivot():
    page = "<article><h1>T {0}</h1><p>one {0}</p><div class=body><p>two {0}</p></div></article>"
    template = of("<article><h1>Stub</h1></article>", *(page.format(i) for i in range(6)))
    assert template[0][template[1]][0][0] == "article"
    assert wrapper.extract(page.format(1), template) == "T 1\none 1\ntwo 1"


def test_all_slots_in_page_order():
    page = "<div class=x><div class=s><p>a {0}</p></div><p>fixed</p><div class=s><p>bb {0}</p></div></div>"
    assert wrapper.extract(page.format(9), of(*(page.format(i) for i in range(6)))) == "a 9\nbb 9"
    split = "<div class=x><article><p>a {0}</p></article><div class=y><p>fixed</p></div><article><p>bb {0}</p></article></div>"
    assert wrapper.extract(split.format(9), of(*(split.format(i) for i in range(6)))) == "a 9\nbb 9"


@pytest.mark.parametrize("items", [10, 1000])
def test_hosts_without_landmarks_or_telling_names(spark, items):
    """Menu, notice, boxes between the paragraphs and the last line are only told by being the same on the host's pages."""
    pages, want = [], []
    for i in range(9):
        menu = "".join(f"<div class=m{k % 7}><a href=/{k}>entry {k}</a></div>" for k in range(items))
        body = [words(("p", items, i, k), 30) for k in range(3 + i % 4)]
        box = "<div class=q1>Read more in our shop</div>"
        pages.append(("bare", f"<div class=z1>{menu}</div><div class=z2><div class=z3><p>This site is closed on Sundays, and this line is the same on all pages of it.</p></div><div class=z4><h2>{words(('h', i), 3)}</h2>{box}{''.join(f'<p>{x}</p>' for x in body)}{box}</div></div><div class=z5>All rights of the site</div>"))
        want.append("\n".join([words(("h", i), 3), *body]))
    got = texts(spark, pages)
    assert [got[i] for i in range(len(pages))] == want
    alone = [wrapper.extract(p) for _, p in pages]
    assert all(a != w and "Read more" in a for a, w in zip(alone, want, strict=True))  # without the template


def test_lines_that_articles_share_stay():
    page = "<article><h1>T {0}</h1><p>{1}</p><p>The same licence holds for all texts.</p><div class=w>Read more</div></article>"
    pages = [page.format(i, words(i, 3)) for i in range(12)]
    assert wrapper.extract(pages[0], of(*pages)).endswith("texts.\nRead more")  # a large part of short articles
    pages = [page.format(i, words(i, 200)) for i in range(12)]
    assert wrapper.extract(pages[0], of(*pages)).endswith("licence holds for all texts.")  # the box goes, the paragraph stays
    assert wrapper.extract(pages[0], of(*pages[:4])).endswith("Read more")  # too few pages
    some = [p if i % 3 else p.replace("<div class=w>Read more</div>", "") for i, p in enumerate(pages)]
    assert wrapper.extract(pages[1], of(some[1], *some)).endswith("Read more")


def test_near_copies_are_no_template():
    text = [words(("near", k), 40) for k in range(6)]
    pages = [f"<div class=a><div>menu</div></div><div class=b><h2>{text[0]}</h2><p>{'</p><p>'.join(text)}</p><p>edition {i}</p></div>" for i in range(8)]
    assert wrapper.extract(pages[0], of(*pages)) == "\n".join([text[0], *text, "edition 0"])


def test_varying_lists_of_links_are_left_out():
    pages = [f"<div class=a><ul>{''.join(f'<li><a>{words((i, k), 2)}</a>' for k in range(4))}</ul><p>{words(i, 40)}</p><ul><li>one {i}<li>two {i}<li>three {i}</ul></div>" for i in range(5)]
    assert wrapper.extract(pages[2], of(*pages)) == f"{words(2, 40)}\none 2\ntwo 2\nthree 2"


def brute(a, b, i=0, j=0):
    """The size of the largest simple tree matching, by recursion over the lists of children."""
    ka, kb = wrapper.children(a), wrapper.children(b)

    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), lists(x[1:], y[1:]) + tree(x[0], y[0]))

    def tree(i, j):
        return 1 + lists(ka[i], kb[j]) if a[i][0] == b[j][0] else 0

    return tree(i, j)


def test_match_against_brute_force():
    r = random.Random(5)

    def some(depth):
        return "".join(f"<{t}>{r.choice('xyz')}{some(depth + 1) if depth < 3 and r.random() < 0.5 else ''}</{t}>" for t in r.choices(["div", "section", "ul"], k=r.randint(1, 3)))

    for _ in range(150):
        a, b = (wrapper.skeleton(wrapper.parse(some(0)))[0] for _ in range(2))
        pairs = wrapper.match(a, b)
        assert len(pairs) == brute(a, b)
        up = [wrapper.parents(t) for t in (a, b)]
        known = set(pairs)
        assert all(a[i][0] == b[j][0] and ((i, j) == (0, 0) or (up[0][i], up[1][j]) in known) for i, j in pairs)
        in_order = sorted(pairs)
        assert [j for _, j in in_order] == sorted(j for _, j in pairs)


def test_large_trees_match_as_small_ones_do():
    """The largest matching, in order, for trees of any size: rows of one more cell and boxes that only one side has do not shift the others."""

    def table(n, seed):
        r = random.Random(seed)
        boxes = lambda k: r.choice(["<p>{0}</p>", "<ul><li>{0}<li>x</ul>", "<ul><li>{0}</ul>", "<h3>{0}</h3>"]).format(f"{seed} {k}")
        return wrapper.skeleton(wrapper.parse(f"<div>{''.join(boxes(k) for k in range(n))}</div>"))[0]

    def by_table(a, b):
        """Of two lists of children that are at most two levels deep."""
        ka, kb = wrapper.children(a), wrapper.children(b)
        x, y = ka[1], kb[1]
        row = [0] * (len(y) + 1)
        for i in x:
            last, row = row, [0]
            for j, q in enumerate(y):
                row.append(max(row[-1], last[j + 1], last[j] + (1 + min(len(ka[i]), len(kb[q])) if a[i][0] == b[q][0] else 0)))
        return 2 + row[-1]

    for n in (5, 40, 150, 400):
        a, b = table(n, "a"), table(n + n // 7, "b")
        pairs = wrapper.match(a, b)
        assert len(pairs) == by_table(a, b)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        up, known = [wrapper.parents(t) for t in (a, b)], set(pairs)
        assert all(a[i][0] == b[j][0] and ((i, j) == (0, 0) or (up[0][i], up[1][j]) in known) for i, j in pairs)
        assert [j for _, j in sorted(pairs)] == sorted(j for _, j in pairs)


def test_large_trees_that_differ_at_all_levels():
    one, two = ("".join(f"<div class={c}>" + "<p>x</p>" * (k % n) + "<div>" for k in range(150)) for c, n in (("a", 3), ("a", 4)))
    a, b = (wrapper.skeleton(wrapper.parse(x))[0] for x in (one, two))
    assert max(n[1] for n in a) == wrapper.DEEPEST
    assert len(wrapper.match(a, b)) == 1 + wrapper.DEEPEST + sum(min(k % 3, k % 4) for k in range(wrapper.DEEPEST // 2))


def test_templates_ahead_of_pages(spark, monkeypatch):
    """Without a broadcast, and hosts cut in parts, the result is the same."""
    pages = [(f"h{i % 3}", f"<div class=a><div>menu of h{i % 3}</div></div><div class=b><p>{words(i, 30)}</p><p>{words(-i, 3)}</p></div>") for i in range(60)]
    want = texts(spark, pages)
    monkeypatch.setattr(wrapper, "SMALL_BYTES", -1)
    monkeypatch.setattr(wrapper, "SALT_PAGES", 7)
    assert texts(spark, pages) == want
    assert all("menu" not in x for x in want.values())


def test_defined_cases(spark):
    kind = "page_id bigint, url string, html string, text int"
    page = "<div class=a>menu</div><p>{0}</p>"
    rows = [(1, None, page.format(words(i, 9)), 0) for i in range(4)] + [(1, None, page.format(words(0, 9)), 1), (None, "http://x.example/", None, 2), (3, "odd", "", 3), (4, "http://long.example/", "<p>" + "word " * 400_000, 4)]
    got = wrapper.html_extract(spark.createDataFrame(rows, kind))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert sorted(r["text"] for r in got if r["page_id"] == 1) == sorted([words(i, 9) for i in range(4)] + [words(0, 9)])
    assert {r["page_id"]: r["n_chars"] for r in got if r["page_id"] != 1} == {None: 0, 3: 0, 4: 5 * 400_000 - 1}
    assert wrapper.html_extract(spark.createDataFrame([], kind)).count() == 0


def test_large_pages_take_part_whole(spark):
    pages, want = [], []
    for i in range(5):  # an article in two parts, the first with more than 400 blocks
        one, two = ([words((k, i, j), 5) for j in range(n)] for k, n in (("one", 450), ("two", 30)))
        pages.append(("long", f"<div class=text><div class=part1>{''.join(f'<p>{x}</p><h3>- {i}</h3>' for x in one)}</div><div class=part2>{''.join(f'<p>{x}</p>' for x in two)}</div></div>"))
        want.append("\n".join([*(y for x in one for y in (x, f"- {i}")), *two]))
    for i in range(5):  # a menu of more than 400 nodes before the article, one of them varying
        b = words(("m", i), 50)
        pages.append(("menu", f"<div class=list><div>{'</div><div>'.join(['entry'] * 500)}</div></div><article><h1>{b}</h1><p>{b}</p></article>"))
        want.append(f"{b}\n{b}")
    got = texts(spark, pages)
    assert [got[i] for i in range(len(pages))] == want


def test_large_and_deep_trees():
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    a = wrapper.skeleton(wrapper.parse(deep))[0]
    assert len(a) == wrapper.DEEPEST + 1
    assert sum(n[3] for n in a) == 4
    wide = wrapper.skeleton(wrapper.parse("".join(f"<ul><li>{i}<li>x</ul><p>{i}</p>" for i in range(1000))))[0]
    assert sum(n[3] for n in wide) == 2 * sum(len(str(i)) for i in range(1000)) + 1000
    assert len(wrapper.match(wide, wide)) == len(wide) > 3000
    assert wrapper.match(a, a) == [(i, i) for i in range(len(a))]
    assert wrapper.unpacked(wrapper.packed(wide)) == wide


@pytest.mark.parametrize("names", ["id=page class='layout has-sidebar'", "class='content no-print'", "class=with-banner", "class=has-header", "class='post-1 comments-open'"])
def test_layout_names_do_not_drop_the_article(names):
    page = "<div {0}><article><h1>T</h1><p>text</p></article><div class=sidebar><p>side</p></div></div>"
    assert wrapper.extract(page.format(names)) == "T\ntext"
    assert wrapper.extract(f"<div {names}><div class=inner><h1>T</h1><p>text</p></div></div>") == "T\ntext"


def test_names_still_drop_what_is_beside_the_article():
    beside = "<div class=related><article class=card><p>other other other</p></article></div><div id=comments><h1>c</h1><p>long long long long</p></div><div class=masthead><h1>Site</h1></div><div class=sidebar><div class=related><article><p>o</p></article></div></div>"
    assert wrapper.extract(f"<main><h1>T</h1><p>text</p>{beside}</main>") == "T\ntext"
    assert wrapper.extract("<div class=share><p>tell</p></div><div><p>text text</p></div>") == "text text"


def test_names_of_a_host(spark):
    pages = [("names", f"<div class='layout has-sidebar'><article><h1>{words(i, 3)}</h1><p>{words(i, 30)}</p></article><div class=sidebar><p>news {i}</p></div></div>") for i in range(6)]
    assert [t for _, t in sorted(texts(spark, pages).items())] == [f"{words(i, 3)}\n{words(i, 30)}" for i in range(6)]


def test_names_in_deep_trees():
    assert wrapper.extract("<div class=share>" * 20_000 + "<p>text" + "</div>" * 20_000) == "text"
