"""HTML extraction: a tree-structured graphical model over the nodes of a page.

A page becomes a tree of block elements; its leaves are the texts between block
boundaries.  Each node has a hidden mark - whether it holds main text - with a
potential of its own (from its class and id words, its length and share of links) and one with
its parent's mark (by the tags of both).  Sum-product messages pass upward and then
downward, which is exact on a tree; a leaf whose marginal exceeds one half is main
text.  The potentials are counts over labelled pages, summed by Spark.

No table has such labels, so the labelled pages are made here by rule: articles of
many layouts among menus, headers, side columns, notices, adverts, forms, comments
and footers, whose blocks' origin is known.

There is no shuffle in extraction; memory is bounded by one Arrow batch.  Nulls: a
null page is empty: text '' and 0 characters; null ids and urls stay null.  Pages
without main text: ''.  Broken markup: unclosed and stray tags are tolerated as
browsers do.  Long pages: read whole, in time that grows with their length.  Repeated rows: one result each.  Ties (a marginal of exactly one
half): not main text.  Empty tables: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Fixed values of the HTML standard: elements that break text into blocks, whose text isn't shown or is
#: typed in, without content, and what an opening tag closes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("script style noscript template title textarea iframe object svg annotation annotation-xml canvas audio video select datalist noframes noembed xmp".split())
#: Of those, the ones that reach to the page's end where they aren't closed.
RAW = frozenset("script style noscript title textarea iframe noframes noembed xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
HOLDERS = frozenset("table ul ol dl menu dir body html".split())

#: A tag's name, and its attributes up to the end of the tag, quotes closed.
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Node:
    parent: int
    tag: str
    words: tuple[str, ...] = ()
    text: str = ""
    links: int = 0
    leaf: bool = False
    marks: list[str] = field(default_factory=list)


def is_hidden(attributes: str) -> bool:
    """By the hidden attribute or the style; a class such as overflow-hidden doesn't count."""
    for a in ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name == "hidden" and value.lower() != "until-found" or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Texts and tags in order: (text, '', ''), or ('' or '/', name, attributes); comments and declarations give nothing.

    Each character is looked at a bounded number of times.  A quote that never closes ends tags at the next '>' from there on.
    Elements that aren't shown are skipped with what they hold.
    """
    at = begin = 0
    quotes = True
    unclosed: set[str] = set()
    last = page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0 or (start > last and not page.startswith("<!--", start)):
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            stop, found = len(page) if end < 0 else end + 3, None
        elif name := TAG_NAME.match(page, start + 1):
            rest = TAG_REST.match(page, name.end()) if quotes else None
            quotes = rest is not None
            stop = rest.end() if rest else page.find(">", name.end()) + 1
            if not stop:
                break
            found = name[1], name[2].lower(), page[name.end() : stop - 1]
        elif page[start + 1 : start + 2] in ("!", "?", "/"):
            stop, found = page.find(">", start) + 1, None
        else:
            at = start + 1
            continue
        if begin < start:
            yield page[begin:start], "", ""
        begin = at = stop
        if not found:
            continue
        closing, tag, attributes = found
        if tag not in UNSEEN:
            yield closing, tag, attributes
        elif not closing and not attributes.endswith("/") and tag not in unclosed:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end:
                begin = at = page.find(">", end.end()) + 1 or len(page)
            elif tag in RAW:
                begin = at = len(page)
            else:
                unclosed.add(tag)
    if begin < len(page):
        yield page[begin:], "", ""


def parse(page: str) -> list[Node]:
    """The page's block elements and texts; parents come before their children."""
    nodes = [Node(-1, "#root")]
    stack = [0]
    open_ = Counter()
    raw: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal raw, linked
        text = " ".join("".join(raw).split()) if raw else ""
        if text:
            nodes.append(Node(stack[-1], "#text", text=text, links=min(linked, len(text)), leaf=True))
        raw, linked = [], 0

    def close(k: int) -> None:
        """Close the elements of the stack from place k on."""
        for i in stack[k:]:
            open_[nodes[i].tag] -= 1
        del stack[k:]

    for kind, tag, attributes in tokens(page):
        if not tag:
            # A reference is one in the page's source: what tags stand between isn't joined to one.
            text = html.unescape(kind)
            raw.append(text)
            linked += len(text) * in_link
        elif tag == "br":
            raw.append(" ")
        elif tag == "a":
            in_link = 0 if kind else 1
        elif tag in BLOCKS:
            flush()
            if kind:
                if open_[tag]:
                    k = len(stack) - 1
                    while nodes[stack[k]].tag != tag:
                        k -= 1
                    close(k)
                continue
            in_link = 0
            if nodes[stack[-1]].tag == "p":
                close(len(stack) - 1)
            closes = CLOSED_BY.get(tag, ())
            k = len(stack) - 1
            while k > 0 and any(open_[t] for t in closes):
                open_tag = nodes[stack[k]].tag
                if open_tag in closes:
                    close(k)
                    if open_tag == tag or tag in ("dt", "dd", "td", "th"):
                        break
                elif open_tag in HOLDERS:
                    break
                k -= 1
            words = tuple(dict.fromkeys(w.lower() for a in NAMES.finditer(attributes) for w in WORD.findall(a[1] or a[2] or a[3] or "")))
            if is_hidden(attributes):
                words += ("#hidden",)
            nodes.append(Node(stack[-1], tag, words))
            if tag not in VOID:
                stack.append(len(nodes) - 1)
                open_[tag] += 1
    flush()
    return nodes


#: Words by which sites name their parts; the made pages draw class and id names from them.
PART_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu links toolbar pagination pager tabs skip",
    "header": "header masthead top logo branding site title banner hero topbar",
    "footer": "footer foot bottom copyright legal colophon imprint credits",
    "aside": "sidebar side aside widget rail related more recommended popular trending teaser latest tags categories archive column secondary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning paywall privacy disclaimer toast info",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner outbrain taboola adsense commercial partner offer",
    "form": "form search login signup subscribe newsletter contact register signin mailing feedback field input",
    "comments": "comment comments reply replies discussion disqus respond thread reactions feedback user community",
    "share": "share social sharing follow buttons facebook twitter print tools meta",
    "content": "content article post entry story main body text page single blog news document container wrapper hentry primary",
}
#: A block with none of these words (or with a generated name only) is bare, which tells too.
PARTS = frozenset(" ".join(PART_NAMES.values()).split()) | {"#hidden"}


def marks_of(node: Node) -> list[str]:
    """What the node's own potential depends on."""
    if node.leaf:
        n = len(node.text)
        share = 4 * node.links // max(1, n)
        return [f"length {min(9, max(5, n.bit_length()))}", f"links {share}", f"sign {'©' in node.text}"]
    return [f"word {w}" for w in node.words] + ([] if PARTS.intersection(node.words) else [f"bare {node.tag}"])


def edge_of(node: Node, parent: Node) -> str:
    """The kind of an edge; it carries what the tags tell."""
    return f"{parent.tag}>{node.tag}"


@dataclass
class Model:
    """Log ratios of marks, and log tables of (parent's mark, own mark) by kind of child."""

    marks: dict[str, float]
    edges: dict[str, tuple[float, float, float, float]]
    any_edge: tuple[float, float, float, float]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of main text of each node: sum-product, upward and downward."""
        # Texts of one page aren't independent (it may repeat a line a hundred times), so theirs is weighed as that of a few.
        share = min(1.0, 6 / max(1, sum(n.leaf for n in nodes)))
        own = [sum(self.marks.get(m, 0.0) for m in marks_of(n)) * (share if n.leaf else 1.0) for n in nodes]
        own[0] = 4.0
        table = [self.edges.get(edge_of(n, nodes[n.parent]), self.edges.get(n.tag, self.any_edge)) for n in nodes]
        up = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # own[i] has gathered the children's messages
            t00, t01, t10, t11 = table[i]
            up[i] = _ratio(t10, t11, t00, t01, own[i])
            own[nodes[i].parent] += up[i]
        total = own[:]
        for i in range(1, len(nodes)):
            t00, t01, t10, t11 = table[i]
            total[i] = own[i] + _ratio(t01, t11, t00, t10, total[nodes[i].parent] - up[i])
        return [1 / (1 + exp(-max(-700.0, min(700.0, x)))) for x in total]


def _ratio(a0: float, a1: float, b0: float, b1: float, x: float) -> float:
    """log (e^a0 + e^(a1 + x)) - log (e^b0 + e^(b1 + x))."""
    x = max(-60.0, min(60.0, x))
    return log(exp(a0) + exp(a1 + x)) - log(exp(b0) + exp(b1 + x))


def main_text(page: str, model: Model) -> str:
    nodes = parse(page)
    chance = model.marginals(nodes)
    return "\n\n".join(n.text for n, c in zip(nodes, chance, strict=True) if n.leaf and c > 0.5)


def made_page(seed: int) -> tuple[str, set[str]]:
    """A labelled page: its HTML, and the texts of it that are main text (all its texts differ)."""
    r = random.Random(seed)
    count = 0

    def words(low: int, high: int) -> str:
        nonlocal count
        count += 1
        w = ["".join(r.choice(["ta", "re", "on", "mi", "les", "ver", "no", "qua", "shi"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        odd = r.choice(["", "", "", " |", "!!", "###"])
        w = [x + (r.choice([",", ".", "."]) if r.random() < 0.15 else "") + odd for x in w]
        return f"{' '.join(w).capitalize()} z{count}" + r.choice([".", ".", "", "?"])

    def named(tag: str, part: str, chance: float = 0.75) -> str:
        if r.random() > chance:
            # Without a name, or with one that a style sheet's compiler has made and that tells nothing.
            return r.choice([f"<{tag}>", f'<{tag} class="{r.choice(["css", "sc", "jsx", "_"])}-{r.getrandbits(28):x}">'])
        name = r.choice(["-", " ", "_"]).join(r.sample(PART_NAMES[part].split(), r.randint(1, 2)))
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">'

    def menu() -> str:
        items = "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(r.randint(3, 9)))
        tag = r.choice(["nav", "nav", "div", "header"])
        return f"{named(tag, 'menu', 0.5 if tag == 'nav' else 0.9)}<ul>{items}</ul></{tag}>"

    def small(part: str, tags: list[str], low: int, high: int) -> str:
        tag = r.choice(tags)
        inner = r.choice([words(low, high), f"<p>{words(low, high)}</p>", f"<span>{words(low, high)}</span>", f'<p><a href="#">{words(low, high)}</a></p>', f"<h3>{words(1, 4)}</h3><p>{words(low, high)}</p>"])
        if part == "header" and r.random() < 0.4:
            inner = f"<h1>{words(1, 5)}</h1>" + r.choice(["", f"<p>{words(1, 8)}</p>"])
        return f"{named(tag, part, 0.4 if tag == part or tag in ('aside', 'footer', 'form') else 1)}{inner}</{tag}>"

    def side() -> str:
        items = "".join(f"<li>{r.choice(['<a href=x>%s</a>', '%s']) % words(2, 9)}</li>" for _ in range(r.randint(2, 6)))
        tag = r.choice(["aside", "aside", "div", "section"])
        return f"{named(tag, 'aside', 0.4 if tag == 'aside' else 1)}<h3>{words(1, 3)}</h3>{r.choice([f'<ul>{items}</ul>', f'<p>{words(5, 40)}</p>'])}</{tag}>"

    def form() -> str:
        return f"{named('form', 'form', 0.5)}<label>{words(1, 5)}</label><input type=text><p>{words(2, 12)}</p><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        tag = r.choice(["div", "section", "ol", "aside"])
        item = "li" if tag == "ol" else "div"
        return named(tag, "comments", 1) + f"<h3>{words(1, 3)}</h3>" + "".join(f"{named(item, 'comments')}<b>{words(1, 2)}</b><p>{words(3, 60)}</p></{item}>" for _ in range(r.randint(1, 6))) + f"</{tag}>"

    def footer() -> str:
        tag = r.choice(["footer", "footer", "div"])
        text = r.choice([f"&copy; {words(1, 4)} &middot; {words(2, 12)}", words(3, 20), f"<p>{words(3, 15)}</p><p><a href=x>{words(1, 3)}</a></p>"])
        return f"{named(tag, 'footer', 0.4 if tag == 'footer' else 1)}{text}</{tag}>"

    def hidden() -> str:
        tag = r.choice(["div", "div", "p", "section", "aside"])
        how = r.choice(["hidden", 'hidden=""', 'style="display:none"', 'style="display: none"'])
        return f"<{tag} {how}>{words(2, 60)}</{tag}>"

    wanted: list[str] = []

    def own(low: int, high: int) -> str:
        wanted.append(words(low, high))
        return wanted[-1]

    def article() -> str:
        head = f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{own(2, 12)}</{h}>"
        parts: list[str] = []
        block = r.choice(["p"] * 7 + ["div"] * 3)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.6:
                parts.append(f"<{block}>{own(*r.choice([(1, 3), (4, 20), (20, 120), (20, 120)]))}" + (r.choice(["</p>", "</p>", "</p>", ""]) if block == "p" else "</div>"))
            elif kind < 0.68:
                parts.append(f"<p><b>{own(1, 30)}<br>")
            elif kind < 0.76:
                parts.append(f"<h2>{own(1, 8)}</h2><p>{own(10, 60)}</p>")
            elif kind < 0.81:
                tag = r.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{own(1, 20)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.86:
                parts.append(f"<blockquote><p>{own(5, 40)}</p></blockquote>")
            elif kind < 0.89:
                parts.append(f"<pre>{own(3, 20)}</pre>")
            elif kind < 0.92:
                parts.append(f"<table><tr><td>{own(1, 4)}</td><td>{own(1, 4)}</td></tr></table>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{own(2, 15)}</figcaption></figure>")
            elif kind < 0.98:
                parts.append(small("advert", ["div", "aside"], 2, 14))
            elif kind < 0.99:
                parts.append(small("share", ["div", "ul"], 1, 4))
            else:
                parts.append(hidden())
        # The heading in a header of its own, the text in a section; the whole in what a page may use, named or not, or in nothing.
        if r.random() < 0.25:
            head = f"{named('header', 'content', 0.3)}{head}{r.choice(['', f'<p>{own(2, 8)}</p>'])}</header>"
        inside = "".join(parts)
        if r.random() < 0.25:
            tag = r.choice(["section", "div"])
            inside = f"{named(tag, 'content', 0.3)}{inside}</{tag}>"
        layers = r.choice([0, 0, 1, 1, 1, 1, 2, 3])
        for _ in range(layers):
            tag = r.choice(["article", "article", "div", "div", "div", "main", "section"])
            head, inside = "", f"{named(tag, 'content', 0.4 if tag in ('article', 'main') else 0.6)}{head}{inside}</{tag}>"
        return head + inside

    before = [x for x, p in ((small("header", ["header", "header", "div"], 1, 8), 0.5), (menu(), 0.85), (small("notice", ["div", "section", "aside"], 3, 30), 0.35), (small("advert", ["div", "aside", "section"], 2, 16), 0.6), (form(), 0.2)) if r.random() < p]
    after = [x for x, p in ((small("advert", ["div", "aside"], 2, 16), 0.3), (comments(), 0.4), (side(), 0.45), (form(), 0.25), (small("share", ["div"], 1, 6), 0.2), (small("notice", ["div"], 3, 25), 0.15)) if r.random() < p]
    r.shuffle(before)
    r.shuffle(after)
    inner = article()
    if r.random() < 0.3:
        inner = named("div", "content", 0.8) + inner + (side() if r.random() < 0.4 else "") + "</div>"
    if r.random() < 0.25:
        inner = f"<main>{inner}{comments() if r.random() < 0.3 else ''}</main>"
    foot = [footer()] if r.random() < 0.9 else []
    before += [hidden()] if r.random() < 0.3 else []
    after += [hidden()] if r.random() < 0.3 else []
    body = "".join([*before, inner, *after, *foot])
    if r.random() < 0.3:  # all of a page in one or two blocks, as applications draw it
        for _ in range(r.randint(1, 2)):
            body = r.choice(['<div id="root">', '<div id="app">', named("div", "content", 0.3)]) + body + "</div>"
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{body}" + r.choice(["</body></html>", "", "</body></html>"]), {" ".join(w.split()) for w in wanted}


def labelled(seed: int) -> tuple[list[Node], list[bool]]:
    """A made page's nodes and their marks: a text's origin, and for an element whether it holds main text."""
    page, wanted = made_page(seed)
    nodes = parse(page)
    marks = [n.leaf and n.text in wanted for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        marks[nodes[i].parent] |= marks[i]
    return nodes, marks


def train(spark: SparkSession, pages: int = 600) -> Model:
    """Potentials from ``pages`` labelled pages (a documented bound), counted by Spark's tasks."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[str] = []
            marks: list[int] = []
            for seed in batch.column(0).to_pylist():
                nodes, own = labelled(seed)
                for n, m in zip(nodes[1:], own[1:], strict=True):
                    found = [f"own {x}" for x in marks_of(n)]
                    keys += [*found, f"edge {int(own[n.parent])} {edge_of(n, nodes[n.parent])}", f"edge {int(own[n.parent])} {n.tag}", f"edge {int(own[n.parent])}", "all leaf" if n.leaf else "all"]
                    marks += [int(m)] * (len(found) + 4)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(marks, pa.int32())], ["key", "mark"])

    seen = spark.range(0, pages, 1, 8).mapInArrow(counts, "key string, mark int").groupBy("key").agg(F.sum(1 - F.col("mark")).alias("no"), F.sum("mark").alias("yes"))
    n = {r["key"]: (r["no"], r["yes"]) for r in seen.collect()}  # one row for each tag, word and shape
    marks: dict[str, float] = {}
    for key, (no, yes) in n.items():
        if key.startswith("own "):
            mark = key[4:]
            # Words and shapes come several to a node, so each counts less.  Without a name, a block is compared with those of its tag.
            all_no, all_yes = n["all" if mark.startswith("word ") else "all leaf"]
            if mark.startswith("bare "):
                of_tag = [n.get(f"edge {parent} {mark[5:]}", (0, 0)) for parent in (0, 1)]
                all_no, all_yes = (sum(t[i] for t in of_tag) for i in (0, 1))
            marks[mark] = 0.7 * (log((yes + 0.5) / (all_yes + 1)) - log((no + 0.5) / (all_no + 1)))

    def table(kind: str) -> tuple[float, float, float, float]:
        """log P(own mark | parent's mark) over the node's base rate, which its own potential leaves out."""
        rows = []
        for parent in (0, 1):
            no, yes = n.get(f"edge {parent}{kind}", (0, 0))
            rows += [log((no + 0.5) / (no + yes + 1)), log((yes + 0.5) / (no + yes + 1))]
        return tuple(rows)

    kinds = {key.split(" ", 2)[2] for key in n if key.startswith("edge ") and key.count(" ") == 2}
    return Model(marks, {k: table(f" {k}") for k in kinds}, table(""))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    spark = pages.sparkSession
    carried = spark.sparkContext.broadcast(model or train(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), carried.value) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return slim.mapInArrow(run, f"page_id {dict(slim.dtypes)['page_id']}, url string, text string, n_chars long")
