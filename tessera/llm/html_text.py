"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tokens: words score positive, tags negative, and
a word under tags that stand for something else (a menu, an advert) negative
too. Kadane's linear scan finds the contiguous run with the largest sum, and
of its words those with a positive score are the main text.

The weights are learned from labelled pages: pages that mark their content
with one ``<article>`` or ``<main>`` element say of each word whether it is
inside. These two tags have no weight, neither in the fit nor in the scan. A
word's features are the tags open around it, the words of their class, id and
role, and whether its block is mostly links; its score is their sum in a
logistic regression with balanced classes. A tag's score is the log-odds of
its place. Tags and names that the labelled pages don't show have the weights
of a prior; the evidence of the pages moves them from there.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free

#: A bound on the labelled pages that are read for the weights.
SAMPLE = 600
_ATTRIBUTES = r"""(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|iframe|select|title)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<foreign>svg|math)\b{_ATTRIBUTES}(?:(?<=/)>|>.*?(?:</(?P=foreign)\s*>|\Z))"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{_ATTRIBUTES})>"
    r"|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
# HTML's void elements, its elements inside a line, its blocks that end an open paragraph, and what an opening one ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup li main menu nav ol section table tbody td tfoot th thead tr ul".split())
LISTS = frozenset("ul ol dl menu table".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
CONTENT = frozenset(("article", "main"))
# The prior: elements and names that rarely are content.
ASIDE = frozenset("nav footer aside form button dialog menu object audio video canvas input option datalist".split())
#: Words in class, id or role of an element that is no content: a name of them and of NEUTRAL ones, so not has-sidebar, comments-open or share-enabled.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation navi menu menus breadcrumb breadcrumbs footer foot masthead topbar sidebar sidebars side rail aside widget widgets notice notices alert alerts cookie cookies consent gdpr popup modal overlay toast newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus discussion reply replies responses respond related recommended recommendations pagination pager toolbar complementary contentinfo skip paywall outbrain taboola".split()
)
#: Parts of a name that leave its meaning as it is.
NEUTRAL = frozenset(
    "site page post posts blog global primary secondary tertiary top bottom left right main inner outer box block list lists item items area section sections container wrapper wrap group holder slot slots unit units zone space bar row column col panel module region text title label link links icon icons button buttons btn btns form input message messages articles stories story news google gpt dfp id div js desktop mobile large small image img".split()
)
#: Inside a content element these may name the author's own text.
AUTHORS = frozenset("notice notices alert alerts discussion side aside response responses reply replies respond skip".split())
#: There an id or label of these is the author's own.
ANCHORED = frozenset("section p h1 h2 h3 h4 h5 h6 li dt dd tr td th figure blockquote pre a span".split())
#: Whole class or id words of a page's head, where no content element is open.
HEADS = frozenset("header site-header page-header top-header main-header siteheader".split())
#: Features that no name can have: a listed name, a hidden element, a block of links.
ASIDE_NAME, UNSEEN, LINKED = "~aside", "~hidden", "~linked"
PRIOR = {**dict.fromkeys(ASIDE, -8.0), "header": -8.0, ASIDE_NAME: -8.0, UNSEEN: -12.0, LINKED: -1.0}
#: Scores of a word and of a tag lie within these; what an element that is no content takes from a sum is bounded, so that it parts no text.
WORDS, TAGS, OTHER_TAG, PARTING = (-6.0, 3.0), (-2.0, -0.1), -0.3, 1.0
#: Contexts that a worker remembers.
MEMO = 50_000


# ------------------------------------------------------------------ the page


def tokens(page: str):
    """(kind, name, value): open or close with a tag and its attributes, text with its run; scripts, styles and comments go."""
    for m in TOKENS.finditer(page):
        if m["text"] is not None:
            yield "text", "", m["text"]
        elif m["tag"]:
            yield ("close" if m["close"] else "open"), m["tag"].lower(), m["rest"]


def is_named(tag: str, rest: str, inside_content: bool) -> bool:
    """Whether a name of the prior's list says that an element is no content."""
    for m in NAMED.finditer(rest):
        if inside_content and m[1].lower() in ("id", "aria-label") and tag in ANCHORED:
            continue
        value = m[2] or m[3] or m[4] or ""
        for word in value.split():
            parts = {x.lower() for x in NAME_PART.findall(word)}
            asides = parts & ASIDE_NAMES
            if asides and not (inside_content and asides <= AUTHORS) and all(x in NEUTRAL or len(x) == 1 for x in parts - asides):
                return True
        if not inside_content and HEADS & set(value.lower().split()):
            return True
    return False


def features(tag: str, rest: str, inside_content: bool, lists: bool = True) -> tuple[str, ...]:
    """What an element adds to the context of its words."""
    if tag in CONTENT or tag in ("html", "body"):
        return ()
    own = {tag} if tag != "header" or not inside_content else set()
    if rest:
        if HIDDEN.search(rest):
            own.add(UNSEEN)
        for m in NAMED.finditer(rest):
            if m[1].lower() in ("class", "id", "role"):
                own |= {"." + x.lower() for x in NAME_PART.findall(m[2] or m[3] or m[4] or "")}
        if lists and is_named(tag, rest, inside_content):
            own.add(ASIDE_NAME)
    return tuple(sorted(own))


class Page:
    """Tokens in order, each with its element; elements by the order in which they open, so parents come first.

    ``rows`` holds (kind, tag, text, element): kind is open, close or text.
    End tags that HTML leaves out are supplied for paragraphs, list items and
    table cells; an end tag without its element is passed over.
    """

    def __init__(self, page: str, lists: bool = True):
        self.rows: list[tuple[str, str, str, int]] = []
        self.parent, self.tags, self.own, self.inside = [-1], [""], [()], [False]
        words, linked, main, mark = [0], [0], [False], [False]
        stack, where, link = [0], {}, []  # where: the stack's places by tag; link: those of links
        boxes, lists_at = [0], [0]

        def shut(to: int) -> None:
            while len(stack) > to:
                at = stack.pop()
                tag = self.tags[at]
                where[tag].pop()
                for held in (boxes if tag in CONTAINERS else [], lists_at if tag in LISTS else [], link if tag == "a" else []):
                    if held:
                        held.pop()

        for kind, tag, value in tokens(page):
            if kind == "open":
                if (tag in CONTAINERS or tag in ("p", "hr", "pre") or tag[0] == "h" and tag[1:].isdigit()) and where.get("p") and where["p"][-1] > boxes[-1]:
                    shut(where["p"][-1])
                for other in SIBLINGS.get(tag, ()):
                    if where.get(other) and where[other][-1] > lists_at[-1]:
                        shut(where[other][-1])
                top = stack[-1]
                if tag in VOID:
                    self.rows.append(("open", tag, "", top))
                    continue
                at = len(self.parent)
                self.parent.append(top)
                self.tags.append(tag)
                own = features(tag, value, self.inside[top], lists)
                self.own.append(own)
                aside = ASIDE_NAME in own or tag in ASIDE
                self.inside.append((self.inside[top] or tag in CONTENT and not aside and not self._within_aside(top)))
                words.append(0)
                linked.append(0)
                main.append(tag == "main")
                mark.append(tag == "h1" or tag in CONTENT and not aside)
                place = len(stack)
                stack.append(at)
                where.setdefault(tag, []).append(place)
                if tag in CONTAINERS:
                    boxes.append(place)
                if tag in LISTS:
                    lists_at.append(place)
                if tag == "a":
                    link.append(place)
                self.rows.append(("open", tag, "", at))
            elif kind == "close":
                place = where[tag][-1] if where.get(tag) else 0
                if not place or (tag == "p" or tag in INLINE) and boxes[-1] > place:
                    self.rows.append(("close", tag, "", stack[-1]))
                    continue
                self.rows.append(("close", tag, "", stack[place]))
                shut(place)
            else:
                n = len(value.split())
                words[stack[-1]] += n
                if link:
                    linked[stack[-1]] += n
                self.rows.append(("text", "", value, stack[-1]))
        for at in range(len(self.parent) - 1, 0, -1):
            up = self.parent[at]
            words[up] += words[at]
            linked[up] += linked[at]
            main[up] = main[up] or main[at]
            mark[up] = mark[up] or mark[at]
        self.words, self.linked, self.main, self.mark = words, linked, main, mark

    def _within_aside(self, at: int) -> bool:
        while at > 0:
            if ASIDE_NAME in self.own[at] or self.tags[at] in ASIDE:
                return True
            at = self.parent[at]
        return False

    def contexts(self, join) -> list:
        """Each element's context: ``join(parent's context, own features)``.

        An element that holds the page's ``<main>``, or over half of its words
        outside of links and a first heading or content element, isn't an
        aside, whatever it is named: names add nothing there. On a page
        without such marks three quarters of the words say the same.
        """
        out = [join(None, ())]
        plain = [n - k for n, k in zip(self.words, self.linked, strict=True)]
        share = 2 * plain[0] if self.mark[0] else 3 * plain[0]
        block = [0] * len(self.parent)
        for at in range(1, len(self.parent)):
            up, tag, own = self.parent[at], self.tags[at], self.own[at]
            block[at] = block[up] if tag in INLINE else at
            if self.main[at] or 4 * plain[at] > share and self.mark[at] == self.mark[0]:
                own = tuple(x for x in own if x not in PRIOR and x[0] not in ".~")
            if 2 * self.linked[block[at]] > self.words[block[at]]:
                own = (*own, LINKED)
            out.append(join(out[up], own))
        return out


# --------------------------------------------------------------- the weights


def _joined(context: str | None, own: tuple[str, ...]) -> str:
    return " ".join(sorted({*(context or "").split(), *own})) if own else context or ""


def count(page: str | None, lists: bool = True) -> tuple[Counter, Counter] | None:
    """Words by context ("word ...") and tags ("tag ...") inside and outside of a page's one content element; None if it doesn't mark one."""
    page = page or ""
    marks = [k for k, t, _ in tokens(page) if t in CONTENT]
    if marks != ["open", "close"]:
        return None
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    parsed = Page(page, lists)
    contexts, out = parsed.contexts(_joined), True
    for kind, tag, text, at in parsed.rows:
        if tag in CONTENT:
            out = kind == "close"
        elif kind == "text":
            if n := len(text.split()):
                seen[out]["word " + contexts[at]] += n
        else:
            seen[out]["tag " + tag] += 1
    return seen


def weights(inside: Counter, outside: Counter, prior: dict[str, float] | None = None, epochs: int = 600, rate: float = 0.1) -> dict:
    """{"bias", "words": by feature, "tags": by tag} from the counts of labelled pages; without any the prior alone.

    Names move from the prior ten times as easily as tags do, so that the name
    of an advert and not the ``div`` it stands in takes what sets it apart.
    """
    prior = PRIOR if prior is None else prior
    rows = sorted({x[5:] for x in (*inside, *outside) if x.startswith("word ")})
    names = sorted({f for row in rows for f in row.split()})
    index = {f: i for i, f in enumerate(names)}
    n = np.array([[inside[f"word {r}"], outside[f"word {r}"]] for r in rows], dtype=np.float64).reshape(-1, 2)
    mean = np.array([prior.get(f, 0.0) for f in names])
    w, bias = mean.copy(), np.array([2.0])
    if len(rows) and n.sum(0).all():
        total = n.sum()
        pull = max(1e-4, 0.1 / total) * np.array([1.0 if f[0] in ".~" else 10.0 for f in names])
        share = n / n.sum(0) / 2
        owner = np.repeat(np.arange(len(rows)), [len(r.split()) for r in rows])
        column = np.array([index[f] for r in rows for f in r.split()], dtype=np.int64)
        state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, bias)]
        for epoch in range(1, epochs + 1):
            z = np.bincount(owner, w[column], len(rows)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            d = share[:, 1] * p - share[:, 0] * (1 - p)
            for value, grad, (first, second) in zip((w, bias), (np.bincount(column, d[owner], len(names)) + pull * (w - mean), np.array([d.sum()]) + 1e-4 * (bias - 2)), state, strict=True):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                value -= rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
    tags = {}
    for name in {x[4:] for x in (*inside, *outside) if x.startswith("tag ")}:
        odds = math.log((inside[f"tag {name}"] + 1) / (outside[f"tag {name}"] + 1))
        tags[name] = max(TAGS[0], min(TAGS[1], odds))
    return {"bias": float(bias[0]), "words": {**prior, **dict(zip(names, w.tolist(), strict=True))}, "tags": tags}


def learn(df: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE) -> dict:
    """Weights from at most ``sample`` pages, those of the smallest hash of their key; only counts come to the driver."""
    rows = df.select(F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct().orderBy("h", "k").limit(sample)
    chosen = [r["k"] for r in rows.collect()]
    picked = df.where(F.col(key).isin(chosen)).select(page) if chosen else df.limit(0).select(page)

    def counted(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (found := count(text)) is not None:
                    inside += found[0]
                    outside += found[1]
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], names=["name", "inside", "outside"])

    sums = picked.mapInArrow(counted, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return weights(Counter({r["name"]: r["i"] for r in sums}), Counter({r["name"]: r["o"] for r in sums}))


# ------------------------------------------------------------------ the scan


class Scanner:
    """Main texts by one set of weights; ``lists`` says whether the prior's lists of names count."""

    def __init__(self, weight: dict, lists: bool = True):
        self.weight, self.lists = weight, lists
        self.known: dict = {}

    def _join(self, context, own: tuple[str, ...]):
        """(features, score) of an element's words."""
        key = (context[0] if context else "", own)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > MEMO:
                self.known.clear()
            name = _joined(key[0], own)
            score = self.weight["bias"] + sum(self.weight["words"].get(f, 0.0) for f in name.split())
            found = self.known[key] = name, max(WORDS[0], min(WORDS[1], score))
        return found

    def text(self, page: str | None) -> str:
        """The words of the best run: references decoded, white space within a block as one space, blocks joined by one space."""
        parsed = Page(page or "", self.lists)
        score = [s for _, s in parsed.contexts(self._join)]
        tags = self.weight["tags"]
        best = total = parted = 0.0  # parted: what the current stretch of other words has taken
        start = first = last = 0
        for i, (kind, tag, text, at) in enumerate(parsed.rows):
            if score[at] <= 0:
                loss = -score[at] * len(text.split()) if kind == "text" else -tags.get(tag, OTHER_TAG)
                loss = min(loss, PARTING - parted)
                parted += loss
                total -= loss
            elif kind == "text":
                n = len(text.split())
                total += score[at] * n
                parted = 0.0 if n else parted
            elif tag not in CONTENT:
                total += tags.get(tag, OTHER_TAG)
            if total > best:
                best, first, last = total, start, i + 1
            if total <= 0:
                total, start = 0.0, i + 1
        out: list[str] = []
        for kind, tag, text, at in parsed.rows[first:last]:
            if kind == "text":
                if score[at] > 0:
                    out.append(html.unescape(text))
            elif tag not in INLINE:
                out.append(" ")
        return " ".join("".join(out).split())


def main_text(page: str | None, weight: dict, lists: bool = True) -> str:
    return Scanner(weight, lists).text(page)


def extract(df: DataFrame, weight: dict, page: str = "html") -> DataFrame:
    """``df`` without ``page``, with text and n_chars (code points).

    A null or empty page, or one with no words, gives the empty text. Repeated
    rows stay, an empty table gives an empty one; columns named text or
    n_chars are replaced (also where ``page`` has such a name).
    """
    (source,) = free(df.columns, "page__")
    df = df.withColumnRenamed(page, source).drop("text", "n_chars")
    names = [c for c in df.columns if c != source]
    types = dict(df.dtypes)

    def run(batches):
        scanner = Scanner(weight)
        for batch in batches:
            texts = [scanner.text(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return df.select(*(F.col(f"`{c}`") for c in names), F.col(source).cast("string")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), "text string", "n_chars long"]))
