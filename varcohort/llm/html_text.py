"""Operator 8: main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of block elements. Each node is content or not: a unary potential from the
node's own features and a potential between parent and child. Messages summed upward and downward give
every node's exact marginal; text of nodes above one half is kept. Elements in the line whose names tell that they
are no part of the text are nodes too. Potentials are fitted, by the gradient of the likelihood less a penalty on
what departs from stated weights, to labelled pages: pages whose own semantic tags tell content from the rest. Each is
shown also with these tags and half the names hidden, with its article in a named ``div``, and with asides, forms,
adverts and notices moved into the article, whose words are the page's own. So what one template never shows
keeps its stated weight.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: code, or text that is no part of the page's own.
RAW = frozenset("script style textarea title iframe".split())
CODE = frozenset("script style".split())
#: Whatever lies inside these runs on in the line.
FOREIGN = frozenset("math svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article aside nav main header footer form body html".split())
#: Semantic tags and names that make a page label itself.
INSIDE = frozenset("article main".split())
OUTSIDE = frozenset("nav aside footer header form button head menu dialog select noscript template".split())
BOILER_NAME = re.compile(r"(?i)(^|[\s_-])(ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu|side-?bar|foot\w*|head(er)?|comment\w*|reply|replies|respond|disqus|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|signup|share|social|related|breadcrumbs?|pagination|widget|toolbar|login|search)([\s_-]|$)")
BODY_NAME = re.compile(r"(?i)(^|[\s_-])(article|content|main|post|entry|story|body|text|prose)([\s_-]|$)")
TOKEN = re.compile(r"""<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>?|[^<]+|<""", re.S)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
NEXT_TAG = re.compile(r"</?[a-zA-Z]")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "names", "parent", "runs", "links", "kids", "depth")

    def __init__(self, tag: str, names: str, parent: int, depth: int):
        self.tag, self.names, self.parent, self.depth = tag, names, parent, depth
        self.runs: list[list] = []
        self.links = self.kids = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]], list[tuple[int, int, str]]]:
    """Nodes, parents first, the texts in page order as (node, text), and the same unsplit as (node, block, raw text).

    A block's pieces have one node, but for elements in the line that are nodes of their own. A comment that is never
    closed, and a tag whose quote is not, end at the next ``>``.

    Script, style, textarea, title and iframe have no text. Where one of them is never closed, code ends at the next
    tag and of the others only the tag itself is left out, so that the rest of the page is kept; so it is after any
    other element that is never closed.
    """
    nodes = [Node("html", "", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]
    texts: list[tuple[int, list[str]]] = []
    links, foreign = 0, 0
    unclosed: set[str] = set()  # what has no closing tag from here on
    at, size, match = 0, len(page), TOKEN.match
    while at < size:
        if page.startswith("<!--", at):
            end = -1 if "!--" in unclosed else page.find("-->", at + 2)
            if end < 0:
                unclosed.add("!--")
                end = page.find(">", at)
                at = end + 1 if end >= 0 else size
            else:
                at = end + 3
            continue
        m = match(page, at)
        at = m.end()
        tag = m[2]
        if tag and at < size and page[at - 1] != ">" and page[at] in "\"'":
            at = page.find(">", at) + 1 or size
        if tag is None:
            word = m[0]
            if word[0] != "<" or word == "<":
                here = stack[-1][1]
                if texts and texts[-1][0] == here:
                    texts[-1][1].append(word)
                else:
                    texts.append((here, [word]))
                if links:
                    nodes[here].links += len(word)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE and stack[i][1] != stack[i - 1][1]:  # not run on in the line
                        texts.append((-1, []))
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag == "br" and texts and texts[-1][0] >= 0:
                texts[-1][1].append(" ")
            elif tag == "hr":
                texts.append((-1, []))
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = None if tag in unclosed else RAW_END[tag].search(page, at)
                if end is None:
                    unclosed.add(tag)
                    end = NEXT_TAG.search(page, at) if tag in CODE else None
                    at = end.start() if end else size if tag in CODE else at
                else:
                    at = end.start()
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            ends = {"p"} if tag in CLOSES_P else CLOSED_BY[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
        foreign = sum(t in FOREIGN for t, _ in stack) if foreign else 0
        if tag in INLINE or tag in FOREIGN or (foreign and tag not in CLOSES_P and tag not in CLOSED_BY):
            if m[3].endswith("/") and tag not in INLINE:
                continue
            links += tag == "a"
            foreign += tag in FOREIGN
            here = stack[-1][1]
            names = " ".join(x or y or z for x, y, z in NAMES.findall(m[3])) if m[3] else ""
            if names and BOILER_NAME.search(names):
                nodes[here].kids += 1
                nodes.append(Node(tag, names, here, nodes[here].depth + 1))
                here = len(nodes) - 1
            stack.append((tag, here))
            continue
        names = " ".join(x or y or z for x, y, z in NAMES.findall(m[3])) if m[3] else ""
        parent = stack[-1][1]
        nodes[parent].kids += 1
        nodes.append(Node(tag, names, parent, nodes[parent].depth + 1))
        texts.append((-1, []))
        stack.append((tag, len(nodes) - 1))
    blocks, pieces, block = [], [], 0
    for node, parts in texts:
        block += node < 0
        if node >= 0:
            raw = html.unescape("".join(parts))
            pieces.append((node, block, raw))
            if text := " ".join(raw.split()):
                blocks.append((node, text))
                nodes[node].runs.append(len(text))
    return nodes, blocks, pieces


#: Names of the unary features.
FEATURES = ("one", "content tag", "boiler tag", "boiler name", "body name", "paragraph", "list item", "heading", "linked", "short", "long", "ends a sentence", "no text", "div", "many kids", "under content", "under boiler tag", "under boiler name", "under body name", "beside the content", "beside a body name", "root of a bare page")
#: What the names of the features say, in their order; the fit departs from it as far as pages ask.
PRIOR = (-0.5, 3.0, -6.0, -6.0, 2.0, 1.0, 0.0, 0.5, -3.0, -0.5, 1.0, 1.0, 0.0, 0.0, 0.0, 3.0, -8.0, -8.0, 1.5, -6.0, -3.0, 3.0)
PRIOR_PAIR = ((1.0, -1.0), (-1.0, 1.0))
HIDDEN_TAG = {"article": "div", "main": "div", "nav": "div", "aside": "div", "footer": "div", "header": "div", "section": "div"}


def features(nodes: list[Node], blocks: list[tuple[int, str]], plain: bool = False) -> np.ndarray:
    """A row of features for each node; ``plain`` hides the tags and names by which pages label themselves."""
    stops = [0] * len(nodes)
    for i, text in blocks:
        stops[i] += text[-1] in ".!?…。"
    seen = [(HIDDEN_TAG.get(n.tag, n.tag), "" if i % 2 else n.names) if plain else (n.tag, n.names) for i, n in enumerate(nodes)]
    marked = [(t in INSIDE, t in OUTSIDE, bool(x and BOILER_NAME.search(x)), bool(x and t != "body" and BODY_NAME.search(x))) for t, x in seen]
    inside = any(m[0] for m in marked)
    named = not inside and any(m[3] and not m[1] and not m[2] for m in marked)
    rows, under = [], []
    for i, n in enumerate(nodes):
        tag, own = seen[i][0], marked[i]
        size = sum(n.runs)
        above = under[n.parent] if n.parent >= 0 else (False,) * 4
        now = tuple(a or o for a, o in zip(above, own, strict=True))
        under.append(now)
        rows.append((
            1.0, *own, tag in ("p", "pre", "blockquote"), tag in ("li", "td", "dt", "dd"), tag in ("h1", "h2", "h3", "h4"),
            min(1.0, n.links / size) if size else 0.0, 0 < size < 40, size > 120, bool(size) and stops[i] > 0, size == 0,
            tag in ("div", "section"), n.kids > 4, *above, inside and not now[0], named and not now[3], tag in ("html", "body") and not inside and not named,
        ))
    return np.array(rows, dtype=float)


def marginals(score: np.ndarray, parents: list[int], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product over the tree: P(node is content), the summed pair marginals, and log Z.

    ``score``: log-odds potential of content; ``pair[a, b]``: log potential of a parent in a and a child in b.
    """
    n = len(parents)
    e = np.exp(pair)
    e00, e01, e10, e11 = (float(x) for x in e.ravel())
    own = np.exp(np.clip(score, -30, 30)).tolist()
    up0, up1 = [1.0] * n, own[:]  # product of own potential and the children's messages
    m0, m1 = [1.0] * n, [1.0] * n
    log_z = 0.0
    for i in range(n - 1, 0, -1):
        a0, a1 = e00 * up0[i] + e01 * up1[i], e10 * up0[i] + e11 * up1[i]
        s = a0 + a1
        log_z += np.log(s)
        m0[i], m1[i] = a0 / s, a1 / s
        p = parents[i]
        x0, x1 = up0[p] * m0[i], up1[p] * m1[i]
        s = x0 + x1
        if s < 1e-200 or s > 1e200:
            log_z += np.log(s)
            x0, x1 = x0 / s, x1 / s
        up0[p], up1[p] = x0, x1
    log_z += np.log(up0[0] + up1[0])
    full0, full1 = [0.0] * n, [0.0] * n
    s = up0[0] + up1[0]
    full0[0], full1[0] = up0[0] / s, up1[0] / s
    pairs = np.zeros(4)
    for i in range(1, n):
        p = parents[i]
        r0, r1 = full0[p] / m0[i], full1[p] / m1[i]  # the parent's belief without this child
        b00, b01, b10, b11 = r0 * e00 * up0[i], r0 * e01 * up1[i], r1 * e10 * up0[i], r1 * e11 * up1[i]
        s = b00 + b01 + b10 + b11
        full0[i], full1[i] = (b00 + b10) / s, (b01 + b11) / s
        pairs += (b00 / s, b01 / s, b10 / s, b11 / s)
    return np.array(full1), pairs.reshape(2, 2), log_z


def own_label(nodes: list[Node]) -> np.ndarray | None:
    """Labels by the page's semantic tags and names, or None where it has no article."""
    if not any(n.tag in INSIDE for n in nodes):
        return None
    label = np.zeros(len(nodes), dtype=int)
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        p = n.parent
        out[i] = (p >= 0 and out[p]) or n.tag in OUTSIDE or bool(n.names and BOILER_NAME.search(n.names))
        label[i] = not out[i] and (n.tag in INSIDE or (p >= 0 and label[p] == 1))
    return label


OPENED, CLOSED = re.compile(r"(?i)<article(?=[\s>])"), re.compile(r"(?i)</article\s*>")
PARAGRAPH = re.compile(r"(?i)<p(?:\s[^>]*)?>[^<]{20,}")
#: What is put into an article for the fit; its words are a paragraph of the page itself.
MOVED = ("<aside><p>{}</p></aside>", "<form><p>{}</p><button>{}</button></form>", '<div class="advert"><p>{}</p></div>', '<div class="cookie-notice">{}</div>', '<div class="comments"><p>{}</p></div>', '<span class="ad">{}</span>')


def shown(page: str, turn: int) -> list[tuple[np.ndarray, list[int], np.ndarray]]:
    """(features, parents, labels) of a page as it is, with its marks hidden, with its article in a named ``div``, and with a foreign part moved in."""
    nodes, blocks, _ = parse(page)
    label = own_label(nodes)
    if label is None:
        return []
    cases = []
    for plain in (False, True):
        x = features(nodes, blocks, plain)
        cases.append((x, [n.parent for n in nodes], np.where(x[:, -1] > 0, 1, label)))  # the root of a page without marks holds its content
    renamed = CLOSED.sub("</div>", OPENED.sub(('<div class="post"', '<div id="content"')[turn % 2], page))
    other, own, _ = parse(renamed)
    if len(other) == len(nodes):
        cases.append((features(other, own), [n.parent for n in other], label))
    own_words = PARAGRAPH.search(page, OPENED.search(page).end()) if OPENED.search(page) else None
    if own_words:
        words = own_words[0].partition(">")[2]
        at = own_words.end() if turn % len(MOVED) == len(MOVED) - 1 else own_words.start()
        moved, own, _ = parse(page[:at] + MOVED[turn % len(MOVED)].format(words, words[:20]) + page[at:])
        cases.append((features(moved, own), [n.parent for n in moved], own_label(moved)))
    return cases


def fit(pages: list[str], rounds: int = 40, ridge: float = 0.002) -> dict[str, np.ndarray]:
    """Weights and pair potentials that maximise the likelihood of self-labelled pages, less ``ridge`` times what they depart from the stated ones."""
    cases = [c for i, page in enumerate(pages) for c in shown(page, i)]
    start, begin = np.array(PRIOR), np.array(PRIOR_PAIR)
    w, pair = start.copy(), begin.copy()
    sw, sp = np.zeros_like(w), np.zeros_like(pair)
    total = sum(len(c[2]) for c in cases)
    for _ in range(rounds if cases else 0):
        gw, gp = -ridge * (w - start), -ridge * (pair - begin)
        for x, parents, y in cases:
            p, pairs, _ = marginals(x @ w, parents, pair)
            gw = gw + x.T @ (y - p) / total
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[parents[1:]], y[1:]), 1)
            gp = gp + (seen - pairs) / total
        sw, sp = 0.9 * sw + 0.1 * gw**2, 0.9 * sp + 0.1 * gp**2
        w, pair = w + 0.1 * gw / (np.sqrt(sw) + 1e-2), pair + 0.05 * gp / (np.sqrt(sp) + 1e-2)
    return {"w": w, "pair": pair}


def main_text(page: str, model: dict[str, np.ndarray]) -> str:
    nodes, blocks, pieces = parse(page)
    if not blocks:
        return ""
    p, _, _ = marginals(features(nodes, blocks) @ model["w"], [n.parent for n in nodes], model["pair"])
    whole: dict[int, list[str]] = {}
    for node, block, raw in pieces:
        if p[node] > 0.5:
            whole.setdefault(block, []).append(raw)
    return " ".join(text for parts in whole.values() if (text := " ".join("".join(parts).split())))


def extract(pages: DataFrame, sample: int = 120, longest: int = 40_000) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, by a model fitted to at most ``sample`` pages.

    The pages fitted to are those of up to ``longest`` characters with the smallest hashes, so that at most
    ``sample`` x ``longest`` characters reach the driver; all pages of any length are extracted. A null or empty html
    has empty text; null ids and urls are carried; repeated rows give repeated results, an empty table none; further
    columns are ignored; pages cut off in the middle of a tag, and tags never closed, are read as far as they go.
    """
    usable = pages.where((F.length("html") <= longest) & F.col("html").rlike("(?i)<(article|main)[ >]")).select(F.xxhash64("html").alias("h"), "html")
    smallest = [r["h"] for r in usable.select("h").distinct().orderBy("h").limit(sample).collect()]
    chosen = usable.where(F.col("h") <= smallest[-1]).groupBy("h").agg(F.min("html").alias("html")) if smallest else usable.limit(0)
    fitted = fit([r["html"] for r in chosen.orderBy("h").collect()])  # at most ``sample`` pages, copies once
    sent = pages.sparkSession.sparkContext.broadcast(fitted)  # a few dozen numbers

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h or "", sent.value) for h in htmls], dtype=object)

    out = pages.select("page_id", "url", run("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


