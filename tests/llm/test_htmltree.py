import html
import itertools
import random
import re

from asofspark.llm import htmltree as ht


def page(title, paragraphs, closed=True):
    body = "".join(f"<p>{html.escape(p)}{'</p>' if closed else ''}" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        f"<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></ul></nav><!-- x > y --><div class='ad'>Buy this now.</div>"
        f"<article><h1>{title}</h1>{body}</article><footer>&copy; site &middot; All of it.</footer></body></html>"
    )


def sample(n=60):
    rnd = random.Random(1)
    say = lambda: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(5)) for _ in range(rnd.randrange(4, 30))).capitalize() + "."
    return [(f"Title {i}", [say() for _ in range(rnd.randrange(1, 9))], i % 3 > 0) for i in range(n)]


def test_extraction_and_contract(spark):
    made = sample()
    rows = [(i, f"u{i}", page(*m)) for i, m in enumerate(made)]
    want = {i: "\n\n".join([m[0], *m[1]]) for i, m in enumerate(made)}
    rows += [(900, "u", None), (901, None, ""), (902, "u", "no markup at all"), (903, "u", "<nav><a>x</a></nav>"), (None, "u", rows[3][2]), (3, "u3", rows[3][2])]
    rows += [(904, "u", page("Long", ["Word and more of it. " * 30_000])), (905, "u", "<div>" * 5000 + "deep" + "</div>" * 10), (907, "u", "<b>" * 60_000 + "x" + "</i>" * 60_000)]
    rows += [(906, "u", page("A &amp; B", ["1 < 2 & 3 > 2 é日 nbsp here.", "  many \n\t spaces  "]))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = ht.extract_pages(df, ht.train(df)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for i, w in want.items():
        assert by[i].text == w, i
    assert all(r.n_chars == len(r.text) for r in got)
    assert by[900].text == by[901].text == by[903].text == ""
    assert by[904].text == "Long\n\n" + ("Word and more of it. " * 30_000).strip()
    assert by[906].text == "A & B\n\n1 < 2 & 3 > 2 é日 nbsp here.\n\nmany spaces"


def test_marginals_equal_all_labellings():
    pairs = [("pair", f"{up} {k}", y, n + i) for i, k in enumerate(("container", "block")) for up, y, n in ((0, 0, 5.0), (0, 1, 2.0), (1, 0, 1.0), (1, 1, 6.0))]
    model = ht.Model([*pairs, ("all", "", 0, 10.0), ("all", "", 1, 8.0)]
                     + [("seen", f"tag {t}", y, n) for t, a, b in [("p", 1, 6), ("nav", 5, 1), ("div", 4, 3)] for y, n in ((0, float(a)), (1, float(b)))])
    nodes, pieces = ht.parse("<div><p>a b.</p><div><p>c</p><nav>d</nav></div></div><nav><p>e</p></nav>")
    ht.measure(nodes, pieces)
    own = [None] + [1 / (1 + 2.718281828459045 ** -sum(model.seen.get(o, 0) for o in ht.observations(n))) for n in nodes[1:]]
    total, mass = 0.0, [0.0] * len(nodes)
    for ys in itertools.product((0, 1), repeat=len(nodes) - 1):
        y = (0, *ys)
        p = 1.0
        for i in range(1, len(nodes)):
            p *= model.pair[ht.kind(nodes[i])][y[nodes[i].parent]][y[i]] * (own[i] if y[i] else 1 - own[i])
        total += p
        for i in range(len(nodes)):
            mass[i] += p * y[i]
    got = model.marginals(nodes)
    assert all(abs(a - b / total) < 1e-6 for a, b in zip(got[1:], mass[1:], strict=True))


def test_unseen_layouts():
    from collections import Counter

    counts = Counter()
    for s in range(ht.LAYOUT_PAGES):
        counts.update(ht.page_counts(ht.layout_page(s)))
    model = ht.Model([(*k, float(n)) for k, n in counts.items()])
    right = total = 0
    for s in range(10_000, 10_100):
        nodes, pieces = ht.parse(ht.layout_page(s))
        ht.measure(nodes, pieces)
        for y, m in zip(ht.gold_labels(nodes)[1:], model.marginals(nodes)[1:], strict=True):
            right += (m >= 0.5) == bool(y)
            total += 1
    assert right / total > 0.93


def test_parts_of_unlike_pages():
    from collections import Counter

    counts = Counter()
    for s in range(ht.LAYOUT_PAGES):
        counts.update(ht.page_counts(ht.layout_page(s)))
    model = ht.Model([(*k, float(n)) for k, n in counts.items()])
    say = "This is a sentence of the story that goes on for a while. And here is one more of them."
    got = model.extract(
        "<body><header class=site-header><a href=/>Home</a></header><div class='cookie-notice'>We use cookies. <button>OK</button></div>"
        f"<div class='post-content'><h2>Heading</h2><p>{say}</p><p>{say} <a href=/x>link</a> more.</p></div>"
        f"<div id=sidebar><ul><li><a>Related</a></li><li><a>Other</a></li></ul></div><section class=comments><div class=comment><p>{say}</p></div></section>"
        "<form class=search-form><label>Search</label><input></form></body>"
    )
    assert re.sub(r"\s+", " ", got) == f"Heading {say} {say} link more."


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert ht.extract_pages(df, ht.train(df)).count() == 0


def shown(page):
    nodes, pieces = ht.parse(page)
    hidden = ht.silent(nodes)
    return " ".join("".join(t if t else " " for i, t in pieces if not hidden[i]).split())


def test_head_without_an_end_tag():
    assert shown("<html><head><title>no</title><meta charset=utf-8><body><p>All of the text.</p></body></html>") == "All of the text."
    assert shown("<html><head><link rel=x><p>No body tag.</p></html>") == "No body tag."
    assert shown("<html><head><title>no</title></head><body><p>Closed.</p></body></html>") == "Closed."


def test_self_closed_svg_and_math():
    assert shown("<p>One <svg width='1'/> two <MATH/> three.</p><p>Four <svg><path d=''/>no</svg> five.</p>") == "One two three. Four five."
    assert shown("<p>One <svg data-x=a/b><path/>no</svg> two.</p>") == "One two."


def test_markup_errors_lose_no_text():
    """Elements that are never closed end with their parent; a quote opens a value right after the equals sign only."""
    story = "<p>One of three paragraphs.</p>"
    odd = [f"<div><{t} src=a></div>" for t in "video canvas object noscript svg math audio select template".split()]
    odd += ["<a title=it's href=/x></a>", '<a title="x href=/x></a>', "<a b='x></a>", '<svg viewBox="0"/>', "<svg><path d=a/><path/></svg>", '<img alt = "a>b">']
    for bad in odd:
        page = f"<html><head><title>no</title></head><body><article>{story}{bad}{story}{story}</article></body></html>"
        assert shown(page) == " ".join(["One of three paragraphs."] * 3), bad
    assert shown("<p>One <select><option>no<option>no</select> two.") == "One two."
    assert shown("<script>if (a < b) '</p>'</script><p>After.</p><style>no") == "After."
