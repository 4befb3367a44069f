"""Main text of web pages by composite text density.

A page becomes a tree without scripts, styles, forms and what tags or roles mark as menus, headers, footers or
sidebars. Class names mark parts too: those of menus, sidebars, notices, adverts and comments go unless an article lies in them; those
whose words a story may be about (legal, share) go if they are links for the most part or no longer than
what isn't marked at all; paragraphs and words in a line only if they are links for the most part. For every node the link-adjusted characters per tag
are computed; a node's density sum adds its children's densities. The
node of the largest sum is the main text; the least density on its path from the body
is the threshold for other parts. What is chosen inside an article is taken with its article; of several articles
that of the largest sum is taken.

Null and empty pages have empty text; so do pages without any. Malformed pages are read
as browsers do in the common cases: unclosed paragraphs, items and cells end at the
next, unknown end tags are left out. Repeated rows each get their result.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from plumbline.llm.common import map_texts, named

# Names of HTML's elements by how they are laid out, and words of class names.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "listing main menu nav ol option optgroup p plaintext pre search section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCK - set("html head body br caption td th tr tbody thead tfoot option optgroup legend".split())
FORMATTING = set("a b big code em font i nobr s small span strike strong sub sup tt u".split())
OUT_TAGS = RAW | set("head nav footer aside form noscript template svg math canvas object audio video map select button input datalist dialog menu frameset".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored promo promos promotion promoted banner outbrain taboola "
    "sidebar sidebars nav navbar navigation navigations menu menus breadcrumb breadcrumbs masthead topbar header footer "
    "comment comments commentlist commentary reply replies respond disqus discussion "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup signin login register alert toast paywall "
    "share sharing sharebar social related recommended recommendations trending widget widgets toolbar pagination pager skip copyright legal hidden".split()
)
#: Words that say nothing of a part's kind: "site-header" is a header, "has-sidebar" is none.
PLAIN_WORDS = set("area bar block bottom box buttons col column container global group icons inner item items left links list main message module outer page panel posts primary right row secondary section site slot the top unit user wrap wrapper".split())
#: Of those, words that a story's own parts may be named after.
SOFT_WORDS = set("legal copyright notice notices share sharing social promotion promotions alert register commentary discussion reply replies respond".split())
#: First words of names that go on with any others.
LEAD_WORDS = set("ad ads advert advertisement adsense outbrain taboola sponsor sponsored promo sidebar breadcrumb breadcrumbs comment comments disqus cookie cookies gdpr consent newsletter related popup modal paywall".split())
#: Words that take an article out too: readers' comments and adverts are often marked as articles.
OUT_ARTICLES = set("comment comments reply replies ad ads advert advertisement sponsored promo related recommended".split())
#: Elements that no other class name takes out.
KEPT = set("html body main article p h1 h2 h3 h4 h5 h6 b i em strong a span".split())
IN_SCOPE_OF = {"li": set("ul ol menu dir".split()), "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": set("tr table".split()), "th": set("tr table".split()), "option": {"select"}}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}

TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|$))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+")


OUT, LINKED, SOFT, MARKED = 4, 3, 2, 1


def marked(names: str, words: set[str]) -> int:
    """MARKED if one of the names begins with a leading word, or consists of such words and plain ones alone; SOFT if only by soft ones; else 0."""
    found = 0
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        parts = WORDS.findall(name)
        if words.isdisjoint(parts):
            continue
        if all(p in words or p in PLAIN_WORDS for p in parts):
            if not words.isdisjoint(set(parts) - SOFT_WORDS):
                return MARKED
            found = SOFT
        elif parts[0] in LEAD_WORDS and parts[0] in words:
            return MARKED
    return found


def kind_of(tag: str, attributes: str, inside_article: bool) -> int:
    """OUT if an element with all below it is no main text; else how its class names mark it, 0 for not at all."""
    if tag in OUT_TAGS or tag == "header" and not inside_article:
        return OUT
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub(" ", attributes)) or "hidden" in a or a.get("aria-hidden") == "true" or HIDES.search(a.get("style", "")):
        return OUT
    if a.get("role", "").lower() in OUT_ROLES:
        return OUT
    if tag == "article":
        return MARKED if marked(a.get("class", ""), OUT_ARTICLES) else 0
    if tag in KEPT:
        return LINKED if tag in ("p", "span", "a") and marked(a.get("class", ""), OUT_WORDS) else 0
    return marked(a.get("class", "") + " " + a.get("id", ""), OUT_WORDS - {"header"} if inside_article else OUT_WORDS)


class Tree:
    """Nodes in page order with their parents; texts as (node, text) in page order, None at a block's edge."""

    def __init__(self, page: str):
        self.tag, self.parent = ["html"], [-1]
        self.texts: list[tuple[int, str | None]] = []
        self.marks: dict[int, int] = {}
        stack, out, articles = [0], 0, 0  # out: the depth at which a part that is left out began
        self.open = {"html": 1}  # how many elements of a name are open
        at = 0
        find = TAG.search
        while m := find(page, at):
            if m.start() > at and not out:
                self.texts.append((stack[-1], page[at : m.start()]))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                depth = self._match(stack, name)
                if depth:
                    self._edge(stack[depth:], out)
                    articles -= sum(self.tag[n] in ("article", "main") for n in stack[depth:])
                    self._close(stack, depth)
                    out = 0 if out > depth else out
                continue
            if name in ("html", "body") and self.open.get(name):
                continue
            depth = self._implied(stack, name)
            if depth < len(stack):
                self._edge(stack[depth:], out)
                self._close(stack, depth)
                out = 0 if out > depth else out
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            kind = 0 if out else kind_of(name, m[3], articles > 0)
            leave = kind == OUT
            if kind and not leave:
                self.marks[node] = kind
            if not out and not leave and name in BLOCK:
                self.texts.append((node, None))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name not in VOID and not m[3].endswith("/") or name in BLOCK - VOID:
                stack.append(node)
                self.open[name] = self.open.get(name, 0) + 1
                articles += name in ("article", "main")
                if leave:
                    out = len(stack)
        if at < len(page) and not out:
            self.texts.append((stack[-1], page[at:]))

    def _edge(self, nodes: list[int], out: int) -> None:
        if not out:
            self.texts += [(n, None) for n in nodes if self.tag[n] in BLOCK]

    def _close(self, stack: list[int], depth: int) -> None:
        for n in stack[depth:]:
            self.open[self.tag[n]] -= 1
        del stack[depth:]

    def _match(self, stack: list[int], name: str) -> int:
        """The depth of the element that an end tag closes, or 0."""
        if not self.open.get(name):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                return depth
            if name in FORMATTING and tag in BLOCK or name == "p" and tag in ("td", "th", "table", "article", "section", "div"):
                return 0
        return 0

    def _implied(self, stack: list[int], name: str) -> int:
        """The depth down to which a start tag closes what is open."""
        ends = ENDS.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        if not any(self.open.get(e) for e in ends):
            return len(stack)
        stop = IN_SCOPE_OF.get(name, set()) | ({"td", "th", "table", "button", "article", "section", "main"} if name not in IN_SCOPE_OF else set())
        low = len(stack)
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in ends:
                low = depth
                if tag == "p":
                    break
            elif tag in stop:
                break
        return low


def without_marked(tree: Tree) -> None:
    """Takes the texts of parts that their class names mark out of a tree, as far as they are no main text."""
    if not tree.marks:
        return
    n = len(tree.tag)
    chars, links, free, holds = [0] * n, [0] * n, 0, [False] * n
    linked, under = [False] * n, [False] * n
    for i in range(1, n):
        linked[i] = tree.tag[i] == "a" or linked[tree.parent[i]]
        under[i] = i in tree.marks or under[tree.parent[i]]
    for node, text in tree.texts:
        if text is not None:
            k = len("".join(text.split()))
            chars[node] += k
            links[node] += k * linked[node]
            free += k * (not under[node])
    for i in range(n - 1, 0, -1):
        over = tree.parent[i]
        chars[over] += chars[i]
        links[over] += links[i]
        holds[over] |= holds[i] or tree.tag[i] in ("article", "main") and i not in tree.marks and chars[i] > 0
    gone = [False] * n
    for i in range(1, n):
        kind = tree.marks.get(i)
        go = kind == MARKED and not holds[i] or kind == LINKED and links[i] * 2 >= chars[i] or kind == SOFT and not holds[i] and (links[i] * 10 >= chars[i] * 3 or chars[i] <= free)
        gone[i] = gone[tree.parent[i]] or go
    tree.texts = [(node, text) for node, text in tree.texts if text is None or not gone[node]]


def densities(tree: Tree) -> tuple[list[float], list[float], list[int]]:
    """For each node its composite density, the sum of its children's, and its characters."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = tree.tag[i] == "a" or linked[tree.parent[i]]
        tags[i] += 1
        link_tags[i] += linked[i]
    for node, text in tree.texts:
        if text is not None:
            k = len("".join(html.unescape(text).split())) if "&" in text else len("".join(text.split()))
            chars[node] += k
            link_chars[node] += k * linked[node]
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        for totals in (chars, tags, link_chars, link_tags):
            totals[p] += totals[i]
    body_share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
        if c:
            base = math.log(c * lc / max(1, c - lc) + body_share * c + math.e)
            ratio = (c / max(1, lc)) * (t / max(1, lt))
            density[i] = c / t * (math.log(ratio) / math.log(base) if base > 1.0000001 and ratio > 1 else math.log(max(ratio, 1)))
        if i:
            total[tree.parent[i]] += density[i]
    return density, total, chars


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by one space."""
    tree = Tree(page or "")
    without_marked(tree)
    if not any(text for _, text in tree.texts if text and not text.isspace()):
        return ""
    density, total, chars = densities(tree)
    n = len(tree.tag)
    for i in range(n):  # a node of text alone is its own only child
        if chars[i] and not total[i]:
            total[i] = density[i]
    best = max(range(n), key=lambda i: (total[i], -i))
    path = [best]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    threshold = min(density[i] for i in path)
    anchor = next((i for i in path if tree.tag[i] in ("article", "main")), None)
    chosen = [False] * n
    chosen[best if anchor is None else anchor] = True
    if anchor is None:  # headings over the best and dense parts beside it; of an article, all is taken
        on_path = set(path)
        for i in range(1, n):
            over = tree.parent[i]
            while tree.tag[i] in HEADINGS and over not in on_path and chars[over] == chars[i]:
                over = tree.parent[over]  # what holds the heading alone
            heading = tree.tag[i] in HEADINGS and over in on_path
            if heading or tree.tag[i] in BLOCK and chars[i] and density[i] >= threshold and i not in on_path:
                chosen[i] = True
    for i in range(1, n):
        chosen[i] = chosen[i] or chosen[tree.parent[i]]
    blocks: list[list[str]] = [[]]
    for node, text in tree.texts:
        if text is None:
            blocks.append([])
        elif chosen[node]:
            blocks[-1].append(text)
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return " ".join(b for b in joined if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def make():
        def work(batch):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_texts(named(pages, page_id=id_col, url=url_col, html=html_col), make, "page_id long, url string, text string, n_chars long")
