"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element has a hidden label, content or not. A page's probability is the
product of what an element's tag, names, length, links and sentences say about its
label, and of a potential between each element and its parent. Both tables are
counted from labelled pages. Messages passed from the leaves to the root and back
(sum-product, exact on a tree) give each element's marginal; text directly inside
elements that are likelier content than not is the main text.

Labelled pages are a bounded sample of the table's own pages that mark their one
article, together with built-in layouts that name their parts in the usual ways.
The model is two small tables; pages are read where they lie, without a shuffle.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm.bpe import slices
from asofspark.llm.common import column_of

MAX_TRAINING_PAGES = 2_000
LAYOUT_PAGES = 240
"""Built-in labelled pages; they weigh as much as all pages of the table together."""
SMOOTHING = 0.5
LEAST_COUNT = 3

# fixed values: the kinds of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea select head title audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body main article section div center aside nav header footer form fieldset details dialog".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot li dd dt legend figcaption summary".split())
SIBLINGS = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
FENCES = frozenset("ul ol dl table article section div nav aside main body object template".split())
FOREIGN = ("svg", "math")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|(?>=\s*(?:\"[^\"]*\"|'[^']*')?))*)(?:>|\Z)",
    re.S | re.I,
)
"""Comments, raw text, declarations, tags. A quote opens a value right after ``=`` only; one that is never closed is a character."""
_NAMES = re.compile(r"""\b(class|id|role|itemprop|data-gold)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE_END = re.compile(r"[.!?。！？](?:\s|$)")


class Node:
    __slots__ = ("tag", "names", "gold", "parent", "chars", "linked", "ends")

    def __init__(self, tag: str, names: list[str], gold: str | None, parent: int):
        self.tag, self.names, self.gold, self.parent = tag, names, gold, parent
        self.chars = self.linked = self.ends = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Elements in page order, parents first, and the page's text as (element, piece); None stands for a block's edge."""
    nodes = [Node("", [], None, -1)]
    pieces: list[tuple[int, str | None]] = []
    stack, at = [0], 0
    is_open: Counter = Counter()

    def say(raw: str) -> None:
        if raw:
            pieces.append((stack[-1], html.unescape(raw) if "&" in raw else raw))

    def close_to(depth: int) -> None:
        for i in stack[depth:]:
            is_open[nodes[i].tag] -= 1
            if nodes[i].tag in BLOCKS:
                pieces.append((i, None))
        del stack[depth:]

    def open_at(tags, fences=frozenset()) -> int:
        if not any(is_open[t] for t in tags):
            return 0
        for d in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[d]].tag
            if tag in tags:
                return d
            if tag in fences:
                break
        return 0

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if d := open_at((tag,)):
                close_to(d)
            continue
        if tag not in IN_HEAD and (d := open_at(("head",))):
            close_to(d)
        if tag in CLOSES_P and (d := open_at(("p",), FENCES)):
            close_to(d)
        if tag in SIBLINGS and (d := open_at(SIBLINGS[tag].split(), FENCES)):
            close_to(d)
        if m[4].endswith("/") and (tag in FOREIGN or any(is_open[t] for t in FOREIGN)):
            continue
        if tag in VOID:
            pieces.append((stack[-1], None if tag == "hr" else " "))
            continue
        names, gold = [], None
        if "=" in m[4]:
            for key, *values in _NAMES.findall(m[4]):
                value = next(filter(None, values), "")
                if key.lower() == "data-gold":
                    gold = value
                else:
                    names += [w.lower() for w in _WORD.findall(value)]
        nodes.append(Node(tag, names, gold, stack[-1]))
        if tag in BLOCKS:
            pieces.append((len(nodes) - 1, None))
        stack.append(len(nodes) - 1)
        is_open[tag] += 1
    say(page[at:])
    return nodes, pieces


def measure(nodes: list[Node], pieces: list[tuple[int, str | None]]) -> None:
    """Sums of text, linked text and sentence ends below each element."""
    for i, t in pieces:
        if t and not t.isspace():
            n = len(t.strip())
            nodes[i].chars += n
            nodes[i].ends += len(_SENTENCE_END.findall(t))
    for node in reversed(nodes):
        if node.tag == "a":
            node.linked = node.chars
        if node.parent >= 0:
            up = nodes[node.parent]
            up.chars += node.chars
            up.linked += node.linked
            up.ends += node.ends


def silent(nodes: list[Node]) -> list[bool]:
    """Elements whose text is never shown, and all below them."""
    out: list[bool] = []
    for node in nodes:
        out.append(node.tag in SILENT or (node.parent >= 0 and out[node.parent]))
    return out


def observations(node: Node) -> list[str]:
    share = node.linked / node.chars if node.chars else -1
    out = ["tag " + node.tag, *{"name " + w for w in node.names}]
    links = "none" if share < 0 else "0" if share == 0 else "few" if share < 0.3 else "some" if share < 0.7 else "most"
    if node.tag not in CONTAINERS:  # a container's text has been heard from its blocks
        out += ["links " + links, "chars " + str(min(5, int(math.log(node.chars + 1, 6)))), "ends " + str(min(3, node.ends))]
    elif share >= 0.3:
        out.append("links " + links)
    return out


def kind(node: Node) -> str:
    """Containers, blocks of text and inline elements have a potential with their parent each."""
    return "inline" if node.tag not in BLOCKS else "container" if node.tag in CONTAINERS else "block"


def gold_labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a labelled page: by ``data-gold`` marks, or by its one article; None without either.

    An article's own navigation, asides, forms and footers are not content.
    """
    marked = any(n.gold for n in nodes)
    if not marked and sum(n.tag == "article" for n in nodes) != 1:
        return None
    out: list[int] = []
    for n in nodes:
        up = out[n.parent] if n.parent >= 0 else 0
        if marked:
            out.append(int(n.gold) if n.gold in ("0", "1") else up)
        else:
            out.append(1 if n.tag == "article" else 0 if n.tag in ("nav", "aside", "form", "footer") else up)
    return out


def page_counts(page: str) -> Counter:
    """Counts of (observation, label) and of (parent's label and kind, label) on a labelled page."""
    nodes, pieces = parse(page)
    labels = gold_labels(nodes)
    counts: Counter = Counter()
    if labels is None:
        return counts
    measure(nodes, pieces)
    for n, y in zip(nodes, labels, strict=True):
        if n.parent >= 0:
            counts[("pair", f"{labels[n.parent]} {kind(n)}", y)] += 1
            counts[("all", "", y)] += 1
            for o in observations(n):
                counts[("seen", o, y)] += 1
    return counts


# fixed values: usual names of the parts of a page
CONTENT_NAMES = "content post-content entry-content article-body story main-text post entry body-text article story-body main".split()
OTHER_PARTS = {
    "nav": "nav menu navbar main-menu breadcrumb pagination tabs toc",
    "header": "header site-header masthead top-bar logo branding",
    "footer": "footer site-footer copyright bottom legal",
    "aside": "sidebar widget related recommended trending popular tags share social",
    "div": "ad ads advert advertisement banner sponsored promo cookie cookie-notice consent notice alert newsletter subscribe popup modal paywall",
    "form": "form search-form login signup contact-form comment-form",
    "section": "comments comment-list comment reply discussion disqus responses",
}


def layout_page(seed: int) -> str:
    """One built-in page with its labels as ``data-gold`` marks."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulnrstm") for _ in range(rnd.randrange(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    prose = lambda: " ".join(say(rnd.randrange(5, 16)) for _ in range(rnd.randrange(1, 6)))
    link = lambda: f'<a href="/{word()}">{word()} {word()}</a>'

    def other(kind: str) -> str:
        name = rnd.choice(OTHER_PARTS[kind].split())
        tag = rnd.choice([kind, kind, "div", "section"])
        mark = rnd.choice([f'class="{name}"', f'id="{name}"', f'class="{name} {word()}"', "" if tag == kind and kind not in ("div", "section") else f'class="{name}"'])
        if kind in ("nav", "aside", "header") or rnd.random() < 0.2:
            body = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randrange(3, 9))) + "</ul>"
        elif kind == "form":
            body = f"<label>{word()}</label><input name=q><button>{word()}</button>"
        elif kind == "section":
            body = "".join(f'<div class="comment"><b>{word()}</b><p>{prose()}</p>{link()}</div>' for _ in range(rnd.randrange(1, 4)))
        else:
            body = rnd.choice([f"<p>{say(8)}</p>", say(6), f"{say(5)} {link()}", f"&copy; {word()} {link()}", f"<p>{prose()}</p>"])
        return f"<{tag} {mark} data-gold=0>{body}</{tag}>"

    def block() -> str:
        roll = rnd.random()
        if roll < 0.6:
            inner = rnd.choice(["{}", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<i>{}</i>"]).format(say(4))
            return f"<p>{prose()} {inner} {rnd.choice(['', '', link()])}</p>"
        if roll < 0.7:
            return f"<h2>{say(4)[:-1]}</h2>"
        if roll < 0.78:
            return "<ul>" + "".join(f"<li>{say(rnd.randrange(4, 12))}</li>" for _ in range(3)) + "</ul>"
        if roll < 0.84:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if roll < 0.88:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{word()}</td></tr>" for _ in range(3)) + "</table>"
        if roll < 0.92:
            return f"<pre><code>{word()} = {word()}</code></pre>"
        return f"<p>{say(3)}</p>" if roll < 0.96 else other(rnd.choice(["div", "aside", "form"]))

    title = rnd.choice([f"<h1>{say(6)[:-1]}</h1>", f"<header><h1>{say(6)[:-1]}</h1></header>"])
    blocks = "".join(block() for _ in range(rnd.randrange(1, 12)))
    tag = rnd.choice(["div", "div", "article", "main", "section"])
    mark = f'class="{rnd.choice(CONTENT_NAMES)}"' if tag in ("div", "section") or rnd.random() < 0.4 else ""
    main = f"<{tag} {mark} data-gold=1>{title}{blocks}</{tag}>"
    before = "".join(other(k) for k in ("header", "nav", "div") if rnd.random() < 0.7)
    after = "".join(other(k) for k in ("aside", "section", "div", "form", "footer") if rnd.random() < 0.6)
    middle = f'<div class="{rnd.choice(["wrapper", "container", "page", "row", "site"])}">{main}{after}</div>' if rnd.random() < 0.5 else main + after
    return f"<html><body>{before}{middle}</body></html>"


class Model:
    """Log potentials from counts."""

    def __init__(self, rows: list[tuple[str, str, int, float]]):
        count = {(k, f, y): n for k, f, y, n in rows}
        total = [max(1.0, count.get(("all", "", y), 0)) for y in (0, 1)]
        self.pair = {}
        for k in ("container", "block", "inline"):
            self.pair[k] = []
            for up in "01":
                n = [count.get(("pair", f"{up} {k}", y), 0) + SMOOTHING for y in (0, 1)]
                self.pair[k].append([x / sum(n) for x in n])
        self.seen = {}
        for f in {f for k, f, _, _ in rows if k == "seen"}:
            n = [count.get(("seen", f, y), 0) for y in (0, 1)]
            if sum(n) >= LEAST_COUNT:
                self.seen[f] = math.log((n[1] + SMOOTHING) / total[1]) - math.log((n[0] + SMOOTHING) / total[0])

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each element: messages up to the root, then down."""
        seen, pair = self.seen, [self.pair[kind(node)] for node in nodes]
        n = len(nodes)
        own0, own1 = [1.0] * n, [1.0] * n
        for i in range(1, n):
            odds = math.exp(max(-30.0, min(30.0, sum(seen.get(o, 0.0) for o in observations(nodes[i])))))
            own1[i], own0[i] = odds / (1 + odds), 1 / (1 + odds)
        own1[0] = 1e-9
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            (p00, p01), (p10, p11) = pair[i]
            a, b = p00 * own0[i] + p01 * own1[i], p10 * own0[i] + p11 * own1[i]
            up0[i], up1[i] = a / (a + b), b / (a + b)
            p = nodes[i].parent
            own0[p] *= up0[i]
            own1[p] *= up1[i]
            s = own0[p] + own1[p]
            own0[p], own1[p] = own0[p] / s, own1[p] / s
        out = [0.0] * n
        for i in range(1, n):
            (p00, p01), (p10, p11) = pair[i]
            p = nodes[i].parent
            q1 = out[p] / max(up1[i], 1e-300)
            q0 = (1 - out[p]) / max(up0[i], 1e-300)
            down0, down1 = q0 * p00 + q1 * p10, q0 * p01 + q1 * p11
            a, b = own0[i] * down0, own1[i] * down1
            out[i] = b / (a + b) if a + b > 0 else 0.5
        return out

    def extract(self, page: str | None) -> str:
        """The blocks of text in content elements, joined by an empty line."""
        if not page:
            return ""
        nodes, pieces = parse(page)
        measure(nodes, pieces)
        content = [m >= 0.5 and not s for m, s in zip(self.marginals(nodes), silent(nodes), strict=True)]
        blocks: list[str] = []
        line: list[str] = []
        for i, t in [*pieces, (0, None)]:
            if t is None:
                if line and (text := " ".join("".join(line).split())):
                    blocks.append(text)
                line = []
            elif content[i]:
                line.append(t)
        return "\n\n".join(blocks)


def train(pages: DataFrame, limit: int = MAX_TRAINING_PAGES) -> Model:
    """Counts from at most about ``limit`` of the pages that mark one article, chosen by a digest, and the built-in layouts.

    Pages without such a mark teach nothing; an empty table leaves the layouts.
    """
    body = pages.select(column_of(pages, "html").alias("html")).filter(F.instr("html", "<article") > 0)
    share = limit / max(limit, body.count())
    sample = body.filter(F.conv(F.substring(F.md5("html"), 1, 12), 16, 10).cast("double") < share * 16.0**12)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for page in b["html"]:
                total.update(page_counts(page))
        yield pd.DataFrame([(*k, float(n)) for k, n in total.items()], columns=["kind", "feature", "label", "n"])

    schema = "kind string, feature string, label int, n double"
    sums = lambda df: df.groupBy("kind", "feature", "label").agg(F.sum("n").alias("n"))
    table = [tuple(r) for r in sums(sample.mapInPandas(count, schema)).collect()]
    built_in: Counter = Counter()
    for seed in range(LAYOUT_PAGES):
        built_in.update(page_counts(layout_page(seed)))
    nodes = lambda rows: sum(n for k, _, _, n in rows if k == "all")
    layouts = [(*k, float(n)) for k, n in built_in.items()]
    weight = max(1.0, nodes(layouts)) / max(1.0, nodes(table))
    merged: Counter = Counter()
    for k, f, y, n in layouts:
        merged[(k, f, y)] += n
    for k, f, y, n in table:
        merged[(k, f, y)] += n * min(1.0, weight)
    return Model([(*k, n) for k, n in merged.items()])


def extract_pages(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars per page.

    A null page has an empty text, as has a page without content. Every row
    appears, equal rows too; other columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    base = pages.select(column_of(pages, "page_id").alias("page_id"), column_of(pages, "url").alias("url"), column_of(pages, "html").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = sent.value.extract
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([extract(t) for t in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"]
                )

    out = base.mapInArrow(run, base.schema)
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
