"""Main-text extraction with gradient-boosted trees over the DOM.

Pages are parsed into block nodes (inline elements belong to their block; scripts, styles, heads, controls and comments of the markup
are no text). Each node has features of its tag, its attribute tokens and those of its ancestors, its depth, the density of
text and links in its subtree, and its siblings. Boosted trees give each node log-odds of being main text. Decoding is
hierarchical: the best set of nodes that is closed towards the root is chosen (a node is in only if its parent is, and a
subtree is left out as a whole), so that choices of ancestors and descendants never contradict each other.

Training: at most ``TRAIN_PAGES`` pages, in the order of a hash of their id. Their semantic elements (article or main against nav, footer,
aside and so on) are the labels. Each page is also trained on in rewritten forms, in which
semantic tags become plain ones with common class names and more parts (comments, notices, forms, sidebars) are added, so
that the trees do not rest on the tags alone. Extraction reads every page where it lies; only the trees are sent out.

Defined results: null and empty pages have an empty text, as have pages without main text; a page without any tag is its own text;
unclosed tags end with their parents, an unclosed head at the first block; of elements that are no text, those that are self-closed or have no end tag
inside their parent end at once, but scripts, styles and textareas last to the end of the page; repeated rows and null ids get their own row; without
labelled pages the trees come from the rewritten forms of a fixed plain page; an empty table gives an empty table; other columns are ignored."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceframe.llm.hashing import slices

TRAIN_PAGES = 200
TREES, DEPTH, RATE, CUTS = 60, 4, 0.3, 16
# Element kinds and common words in attributes.
DROPPED = set("noscript template svg iframe object canvas select button title audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav article main section aside header footer form table tr td th thead tbody "
    "blockquote pre figure figcaption address details summary fieldset center hgroup dialog menu".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
MAIN_WORDS = set("article content post entry main story body text maincontent articlebody".split())
SIDE_WORDS = set(
    "ad ads advert advertisement banner sponsor sponsored promo nav navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom sidebar side widget "
    "aside related recommended cookie cookies consent notice alert popup modal newsletter subscribe signup login form search share social comment comments reply replies "
    "disqus reader discussion copyright legal disclaimer toolbar pagination tags meta".split())
KINDS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("nav",), ("article", "main"), ("aside", "dialog", "details"), ("header",),
         ("footer", "address"), ("form", "fieldset"), ("div", "section", "center"), ("table", "tr", "td", "th"), ("blockquote", "pre", "figure")]
KIND = {t: i for i, tags in enumerate(KINDS) for t in tags}
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I)
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
UNQUOTED = re.compile(r"=\s*[^\s\"']+$")
SPACES = re.compile(r"\s+")
N_FEATURES = len(KINDS) + 16


def closing(tag: str, top: str) -> bool:
    """Whether the start of a block ends the block ``top`` that is open."""
    return top == "p" or top in CLOSES.get(tag, ())


def closed(tokens: list[re.Match]) -> dict[int, int]:
    """Dropped elements that have an end tag inside their parent: numbers of the start and end tokens. Self-closed and
    unclosed ones are not in it."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    still: Counter = Counter()
    body = False
    for k, m in enumerate(tokens):
        tag = (m[3] or "").lower()
        if tag not in DROPPED and tag not in BLOCKS or tag == "html":
            continue
        if m[2]:
            while still[tag]:
                top, at = stack.pop()
                still[top] -= 1
                if top == tag:
                    if tag in DROPPED:
                        out[at] = k
                    break
            continue
        if tag in DROPPED:
            if m[4].endswith("/") and not UNQUOTED.search(m[4]):
                continue
        elif tag == "body" and not body:  # what the head has left open ends here
            body = True
            stack.clear()
            still.clear()
        elif stack and closing(tag, stack[-1][0]):
            still[stack.pop()[0]] -= 1
        stack.append((tag, k))
        still[tag] += 1
    return out


class Page:
    """Block nodes in page order: tag, parent, depth, attribute tokens; and text pieces (node, text, in a link)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.words = ["html"], [-1], [0], [frozenset()]
        self.pieces: list[tuple[int, str, bool]] = []
        tokens = list(TOKEN.finditer(html))
        ends = closed(tokens) if any(m[3] and m[3].lower() in DROPPED for m in tokens) else {}
        node, links, at, until, head = 0, 0, 0, -1, None
        for k, m in enumerate(tokens):
            if k <= until:  # in a dropped element
                at = m.end()
                continue
            if m.start() > at:
                self.pieces.append((node, html[at:m.start()], links > 0))
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if tag in DROPPED:
                until = ends.get(k, -1)
                if tag == "title" and k not in ends and not m[2] and not m[4].endswith("/"):  # ends at the next tag
                    at = tokens[k + 1].start() if k + 1 < len(tokens) else len(html)
            elif tag == "head":
                if not m[2] and len(self.tags) == 1:
                    head = len(self.pieces)
                elif m[2] and head is not None:
                    del self.pieces[head:]
                    head = None
            elif tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                self.pieces.append((node, " ", False))
            elif tag in BLOCKS and tag != "html":
                links = 0
                if not m[2]:
                    head = None  # an unclosed head ends at the first block
                if m[2]:
                    up = node
                    while up > 0 and self.tags[up] != tag:
                        up = self.parents[up]
                    if up > 0:
                        node = self.parents[up]
                else:
                    closes = CLOSES.get(tag, set()) if tag != "p" and tag in CLOSES else {"p"}
                    if self.tags[node] in closes or self.tags[node] == "p":
                        node = self.parents[node]
                    if self.tags[node] in closes:
                        node = self.parents[node]
                    self.tags.append(tag)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                    named = " ".join(NAMED.findall(m[4])) if m[4] else ""
                    self.words.append(frozenset(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())) if named else frozenset())
                    node = len(self.tags) - 1
        if at < len(html) and not html[at:].lstrip().startswith("<"):
            self.pieces.append((node, html[at:], links > 0))

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parents = np.array(self.parents)
        own, link, stops = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text, linked in self.pieces:
            size = len(text) - text.count(" ")
            own[node] += size
            link[node] += size if linked else 0
            stops[node] += text.count(".") + text.count(",")
        text, links, marks, count, children = own.copy(), link.copy(), stops.copy(), np.ones(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = parents[i]
            text[p] += text[i]
            links[p] += links[i]
            marks[p] += marks[i]
            count[p] += count[i]
            children[p] += 1
        x = np.zeros((n, N_FEATURES))
        place, seen, good, bad, inside, outside = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            kind = KIND.get(self.tags[i], -1)
            if kind >= 0:
                x[i, kind] = 1
            if self.words[i]:
                good[i], bad[i] = len(self.words[i] & MAIN_WORDS), len(self.words[i] & SIDE_WORDS)
            if i:
                p = parents[i]
                place[i] = seen[p]
                seen[p] += 1
                inside[i] = inside[p] + (good[p] > bad[p] or self.tags[p] in ("article", "main"))
                outside[i] = outside[p] + (bad[p] > 0 or self.tags[p] in ("nav", "aside", "footer", "form"))
        k = len(KINDS)
        up = np.maximum(parents, 0)
        x[:, k:] = np.stack([
            good, bad, inside, outside, np.array(self.depths), np.log2(text + 1), links / np.maximum(text, 1), text / count, children, children[up], place / np.maximum(children[up], 1),
            np.log2(own + 1), 50 * marks / np.maximum(text, 1), text / np.maximum(text[up], 1), text / max(text[0], 1), count / n], 1)
        return x

    def choose(self, odds: np.ndarray) -> np.ndarray:
        """The best set of nodes that is closed towards the root."""
        n = len(self.tags)
        text = np.zeros(n)
        for node, piece, _ in self.pieces:
            text[node] += len(piece)
        value = np.clip(odds, -6, 6) * np.log2(text + 2)
        value[[i for i in range(n) if self.tags[i] in ("html", "body")]] = 0
        best = value.copy()
        for i in range(n - 1, 0, -1):
            if best[i] > 0:
                best[self.parents[i]] += best[i]
        chosen = best > 0
        chosen[0] = True
        for i in range(1, n):
            chosen[i] = (chosen[i] or self.tags[i] == "body") and chosen[self.parents[i]]
        return chosen

    def text(self, chosen: np.ndarray) -> str:
        blocks, held, last = [], [], -1
        for node, piece, _ in [*self.pieces, (-2, "", False)]:
            if node != last:
                line = SPACES.sub(" ", entities.unescape("".join(held))).strip()
                if line:
                    blocks.append(line)
                held, last = [], node
            if node >= 0 and chosen[node]:
                held.append(piece)
        return "\n".join(blocks)

    def labels(self) -> np.ndarray | None:
        """Main text by the semantic elements, where the page has any: 1, 0, or -1 for nodes that hold both."""
        if not {"article", "main"} & set(self.tags):
            return None
        out = np.zeros(len(self.tags), int)
        for i in range(1, len(self.tags)):
            p = self.parents[i]
            side = self.tags[i] in ("nav", "aside", "footer", "form") or bool(self.words[i] & SIDE_WORDS) and not self.words[i] & MAIN_WORDS
            out[i] = 0 if side else 1 if self.tags[i] in ("article", "main") else max(out[p], 0)
        held = out == 1
        for i in range(len(self.tags) - 1, 0, -1):
            if held[i] and out[self.parents[i]] == 0 and not held[self.parents[i]]:
                out[self.parents[i]] = -1
                held[self.parents[i]] = True
        return out


PLAIN = ('<html><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><article><h1>A title of some words</h1><p>A first paragraph, with words and '
         'stops. It goes on for a while, as paragraphs do.</p><p>A second one, which is shorter.</p></article><footer>Copyright of the page.</footer></body></html>')


def rewritten(html: str, number: int) -> list[str]:
    """The page itself and forms of it with plain tags, other class names and more parts."""
    pick = lambda values, k: values[(number * 7 + k) % len(values)]
    said = re.search(r"<p>(?:<b>)?([^<]{20,})", html)
    words = (said[1] if said else "Some words of a reader about this page, said plainly.")[:220]
    side, main = pick(["sidebar", "side-bar widget", "related", "promo"], 1), pick(["content", "post", "entry-content", "main-content", "story", "article-body"], 2)
    extra_in = pick([
        f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{words}</p></div><div class="comment"><p>{words[:90]}</p></div></section>',
        f'<div id="comments"><ul><li>{words}</li><li>{words[:60]}</li></ul></div>', f'<div class="newsletter"><form><p>{words[:70]}</p><input></form></div>',
        f'<aside class="related"><p>{words[:100]}</p></aside>', f'<div class="ad">{words[:80]}</div>', ""], 3)
    extra_out = pick([f'<aside class="{side}"><h3>{words[:20]}</h3><p>{words[:120]}</p></aside>', f'<div class="cookie-notice"><p>{words[:90]}</p></div>',
                      f'<form action="/s"><label>{words[:30]}</label></form>', f'<div class="comments"><div class="comment"><p>{words}</p></div></div>', f'<div class="{side}"><p>{words}</p></div>'], 4)
    head = f'<header class="{pick(["site-header", "masthead", ""], 5)}"><div>{words[:25]}</div><p>{words[:60]}</p></header>'
    full = re.sub(r"(<body[^>]*>)", lambda m: m[1] + head, html, count=1)
    full = re.sub(r"</article>", lambda m: extra_in + "</article>" + extra_out, full, count=1)
    if number % 3:  # short paragraphs, lists and a wrapper
        full = re.sub(r"(<p>(?:<b>)?[^<]{%d})[^<]*" % (20 + number % 5 * 35), r"\1.", full)
        full = re.sub(r"</p>", lambda m: f"</p><h2>{words[:24]}</h2><ul><li>{words[:40]}</li><li>{words[40:60]} and more</li></ul>", full, count=number % 2 + 1)
        full = re.sub(r"<article", f'<div class="{pick(["wrap", "container", "page", "row"], 9)}"><article', full, count=1)
        full = full.replace("<footer", "</div><footer", 1)
    plain = {"article": f'div class="{main}"', "nav": f'div class="{pick(["menu", "navbar nav", "navigation"], 6)}"', "footer": f'div id="{pick(["footer", "page-footer", "bottom"], 7)}"',
             "header": f'div class="{pick(["header", "topbar", "banner"], 8)}"', "aside": f'div class="{side}"'}
    marked = full
    for tag, new in plain.items():
        marked = re.sub(rf"<{tag}\b[^>]*>", lambda m, t=tag, n=new: f"<{n} data-was={t}>", marked)
        marked = marked.replace(f"</{tag}>", "</div>")
    other = full.replace("<article", "<main").replace("</article>", "</main>")
    return [html, full, other, marked]  # the plain form stands last


def training_rows(html: str, number: int):
    """Features and labels of the forms of one page. In a plain form the labels are those of the full form, node by node."""
    own, full, other, marked = (Page(x) for x in rewritten(html, number))
    for page, model in ((own, own), (full, full), (other, other), (marked, full), (marked, full)):
        labels = model.labels()
        if labels is not None and len(labels) == len(page.tags):
            some = labels >= 0
            yield page.features()[some], labels[some]


def fit_trees(x: np.ndarray, y: np.ndarray):
    """Boosted regression trees on the logistic loss. A tree is arrays of feature, border and value in heap order."""
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(b, c, "right") for b, c in zip(borders, x.T, strict=True)], 1)
    odds, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        slope, weight = y - p, p * (1 - p)
        nodes, size = np.zeros(len(y), int), 2 ** (DEPTH + 1) - 1
        feature, border, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        for node in range(size):
            own = np.flatnonzero(nodes == node)
            if not len(own):
                continue
            s, w = slope[own], weight[own]
            value[node] = RATE * s.sum() / (w.sum() + 1)
            if node >= 2 ** DEPTH - 1 or len(own) < 20:
                continue
            best = (1e-3, -1, 0)
            for f in range(x.shape[1]):
                n = len(borders[f]) + 1
                left_s, left_w = np.cumsum(np.bincount(binned[own, f], s, n))[:-1], np.cumsum(np.bincount(binned[own, f], w, n))[:-1]
                if len(left_s):
                    gain = left_s ** 2 / (left_w + 1) + (s.sum() - left_s) ** 2 / (w.sum() - left_w + 1) - s.sum() ** 2 / (w.sum() + 1)
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), f, k))
            if best[1] >= 0:
                feature[node], border[node] = best[1], borders[best[1]][best[2]]
                right = binned[own, best[1]] > best[2]
                nodes[own] = 2 * node + 1 + right
        trees.append((feature, border, value))
        odds += predict([trees[-1]], x)
    return trees


def predict(trees, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for feature, border, value in trees:
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] >= border[node]), node)
        out += value[node]
    return out


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html", most: int = TRAIN_PAGES):
    """Trees from a bounded sample of pages."""
    ids = pages.select(F.col(page_id).alias("_id")).filter("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    sample = pages.select(F.col(page_id).alias("_id"), F.col(html).alias("_html")).join(F.broadcast(ids), "_id").dropDuplicates(["_id"])  # at most ``most`` ids

    def rows(batches):
        for batch in batches:
            for page in batch.column("_html").to_pylist():
                for x, y in training_rows(page or "", zlib.crc32((page or "").encode())):
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()), pa.array([y.astype(np.int64).tobytes()], pa.binary())], names=["x", "y"])

    found = sample.mapInArrow(rows, "x binary, y binary").toArrow().sort_by("x").to_pydict()
    parts = [(np.frombuffer(x).reshape(-1, N_FEATURES), np.frombuffer(y, np.int64)) for x, y in zip(found["x"], found["y"], strict=True)]
    parts += [part for k in range(8) for part in training_rows(PLAIN, k)]
    return fit_trees(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))


def extract_text(html: str | None, trees) -> str:
    page = Page(html or "")
    if len(page.tags) == 1:
        return page.text(np.ones(1, bool))
    return page.text(page.choose(predict(trees, page.features())))


def extract(pages: DataFrame, trees=None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    trees = trees or train(pages, page_id, html)
    given = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("text"))

    def run(batches):
        for part, _, _ in slices(batches, 1 << 20):
            read = [Page(h or "") for h in part.column("text").to_pylist()]
            features = [p.features() for p in read]
            odds = predict(trees, np.concatenate(features))
            ends = np.cumsum([len(f) for f in features])
            texts = [p.text(p.choose(o) if len(p.tags) > 1 else np.ones(1, bool)) for p, o in zip(read, np.split(odds, ends[:-1]), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
