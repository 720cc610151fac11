"""Main text of web pages by removal of site templates.

Every element's subtree is hashed (tag, attributes, texts and the hashes of its children). Spark counts on how many
pages of a host each hash occurs; subtrees that recur on at least MIN_PAGES pages and MIN_SHARE of a host's pages are
that site's template and deleted. What occurs once is told by its element and role, and last by its class names and id:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. A class name tells only
where all its parts are known (`share-box`, not `share-price`). What is left of all outermost article and main elements
(else of all outermost elements named as content, else of the body) is the text; where they hold less than LEAST_SHARE
of what is left of the body, the body is.

Subtrees inside the content are counted once for each distinct text of the content, so that copies of an article on the
same host don't make a template, and the content itself is never deleted. Containers (div, section and the like) that
recur in at least MIN_PAGES articles and MIN_SHARE of the host's distinct ones are deleted. Prose (paragraphs, headings,
lists, tables, quotes), which near copies of an article share too, must recur in MIN_ARTICLES and PROSE_SHARE of them,
and is deleted only where at least half of the content's text is left. Nothing is deleted that would leave no text.

A host's template has at most (elements of an average page) / MIN_SHARE entries of either kind, whatever the number of its
pages. Every page is parsed once for the counts and once for its text, and its html is shuffled once.

Defined results: a null or empty page has an empty text; a null url or one without a host counts as host ''; repeated
rows count as pages each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annogrid.llm.common import map_batches, stage
from annogrid.llm.markup import INLINE, Node, parse, text_of, walk

MIN_PAGES, MIN_SHARE = 4, 0.2
#: The same for prose inside the content, in distinct articles.
MIN_ARTICLES, PROSE_SHARE = 20, 0.5
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figcaption".split())
#: Share of the body's text, without templates, that the content must hold to stand for it.
LEAST_SHARE = 0.2
#: Pages of the whole table for each part that a host's pages are dealt over, and the fewest parts.
SALT_PAGES, SALTS = 20_000, 64
#: Elements that never are article text.
DROPPED = frozenset(
    "script style noscript template head nav footer aside form button select input textarea iframe svg canvas dialog menu object audio video datalist title xmp noembed noframes".split()
)
#: Roles and parts of class names and ids that tell what an element is for.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    """nav navbar navigation menu menus topbar header masthead footer sidebar sidebars aside rail ad ads adv advert adverts advertisement
    advertisements advertising adsense adslot sponsor sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices popup popups
    modal overlay toast alert comment comments disqus respond replies reply discussion reactions share sharing social related recommended recommendations
    breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login widget widgets toolbar skip search copyright legal""".split()
)
#: Parts that class names have beside those of NAMES without another meaning.
FILLERS = frozenset(
    """box boxes bar bars block blocks list lists item items link links button buttons btn icon icons slot slots unit wrap wrapper container inner outer
    area areas section sections panel panels row rows col column columns top bottom left right site page global primary secondary main mobile desktop
    header small large post posts article articles story stories us this our on by to for form tools title text""".split()
)
CONTENT = frozenset("article content main post entry story".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def named_as_template(attributes: dict[str, str]) -> bool:
    """Whether a class name or the id has only parts that are known, one of them of NAMES."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {x.lower() for x in _PART.findall(name)}
        if parts & NAMES and all(x in NAMES or x in FILLERS or x.isdigit() for x in parts):
            return True
    return False


def name_parts(node: Node) -> tuple[set[str], dict[str, str]]:
    if not node.raw:
        return set(), {}
    attributes = node.attributes()
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return {x.lower() for x in _PART.findall(named)}, attributes


class Page:
    """A parsed page: its content, and which elements are dropped by what they are."""

    def __init__(self, page: str):
        self.root = parse(page)
        self.nodes = list(walk(self.root))
        self.by_name: set[int] = set()  # what isn't looked into for the content
        self.told: set[int] = set()  # what isn't text
        articles, contents = [], []
        held: dict[int, bool] = {}  # whether an element holds an article or main element
        facts = []
        for node in self.nodes:
            parts, attributes = name_parts(node)
            role = attributes.get("role", "").strip().lower()
            facts.append((node, parts, attributes, role))
            if node.tag in ("article", "main") or role in ("main", "article"):
                up = node.parent
                while up is not None and id(up) not in held:
                    held[id(up)] = True
                    up = up.parent
        for node, parts, attributes, role in facts:
            if node.parent is not None and id(node.parent) in self.told:
                self.told.add(id(node))
                self.by_name.add(id(node))
                continue
            inherited = node.parent is not None and id(node.parent) in self.by_name
            tag = node.tag
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""))
            named = role in ROLES or (parts & NAMES and tag not in ("html", "body", "article", "main"))
            named = named or tag == "article" and parts & {"comment", "comments", "reply", "ad", "ads", "sponsored"}
            page_header = tag == "header" and not self._inside(node, ("article",))
            sure = role in ROLES or (tag not in ("html", "body", "article", "main") and parts & NAMES and named_as_template(attributes))
            sure = sure or tag == "article" and parts & {"comment", "comments", "reply", "ad", "ads", "sponsored"}
            if tag in DROPPED or ((hidden or sure or page_header) and id(node) not in held):
                self.told.add(id(node))
                self.by_name.add(id(node))
                continue
            if inherited or (named and id(node) not in held):
                self.by_name.add(id(node))
                continue
            if tag in ("article", "main") or role in ("article", "main"):
                articles.append(node)
            elif parts & CONTENT and tag in ("div", "section", "td"):
                contents.append(node)
        self.content = self._outermost(articles or contents)

    @staticmethod
    def _outermost(nodes: list[Node]) -> list[Node]:
        """The nodes (in page order) that aren't in another of them."""
        known = {id(x) for x in nodes}
        free: set[int] = set()  # elements that lie in none of them
        out = []
        for node in nodes:
            up, passed = node.parent, []
            while up is not None and id(up) not in known and id(up) not in free:
                passed.append(id(up))
                up = up.parent
            if up is None or id(up) in free:
                free.update(passed)
                out.append(node)
        return out

    @staticmethod
    def _inside(node: Node, tags: tuple) -> bool:
        up = node.parent
        while up is not None:
            if up.tag in tags:
                return True
            up = up.parent
        return False

    def subtree_hashes(self) -> dict[int, bytes]:
        """A hash for each block element that doesn't hold the content: b"o" before it outside, b"g" or b"p" before a
        container or prose inside the content."""
        own = {id(x) for x in self.content}
        inside: set[int] = set()
        for node in self.nodes:
            if node.parent is not None and (id(node.parent) in inside or id(node.parent) in own):
                inside.add(id(node))
        holding = set(own)
        for node in self.content:
            up = node.parent
            while up is not None:
                holding.add(id(up))
                up = up.parent
        found = {}
        for node in reversed(self.nodes):  # children come before parents
            h = hashlib.blake2b(digest_size=8)
            h.update(f"{node.tag}\0{node.raw}\0".encode("utf-8", "surrogatepass"))
            some = False
            for x in node.children:
                if type(x) is str:
                    words = " ".join(x.split())
                    some = some or bool(words)
                    h.update(words.encode("utf-8", "surrogatepass") + b"\1")
                else:
                    h.update(x.digest + b"\2")
                    some = some or bool(x.digest)
            node.digest = h.digest()
            if some and node.tag not in INLINE and id(node) not in holding and node.tag not in ("#root", "html", "body"):
                kind = b"o" if id(node) not in inside else b"p" if node.tag in PROSE else b"g"
                if kind == b"o" or id(node) not in self.told:
                    found[id(node)] = kind + node.digest
        return found

    def article(self) -> bytes:
        """A hash of the content's text, which copies of an article share."""
        return hashlib.blake2b(self.text().encode("utf-8", "surrogatepass"), digest_size=8).digest()

    def text(self, template: frozenset[bytes] = frozenset()) -> str:
        groups: set[int] = set()
        prose: set[int] = set()
        if template:
            for k, digest in self.subtree_hashes().items():
                if digest in template:
                    (prose if digest[:1] == b"p" else groups).add(k)

        def without(tops: list[Node], *dropped: set[int]) -> str:
            blocks = []
            for top in tops:
                blocks += text_of(top, lambda node: any(id(node) in x for x in dropped))
            return " ".join(blocks)

        body = without([self.root], self.by_name, groups)
        if not self.content:
            return without([self.root], self.told, groups)
        left = without(self.content, self.told, groups)
        if groups and not left:
            left = without(self.content, self.told)
        if len(left) < LEAST_SHARE * len(body):
            return without([self.root], self.told, groups)
        if prose:
            less = without(self.content, self.told, groups, prose)
            left = less if 2 * len(less) >= len(left) else left
        return left


def _host(url_col: str):
    host = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """For each host the hashes of its template's subtrees."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        articles, outside, inside = [], [], []
        for page in batch.column(1).to_pylist():
            parsed = Page(page)
            found = set(parsed.subtree_hashes().values())
            articles.append(parsed.article() if parsed.content else None)
            outside.append(sorted(x for x in found if x[:1] == b"o"))
            inside.append(sorted({b"", *(x for x in found if x[:1] != b"o")}))  # the empty hash counts the article itself
        hashes = pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(articles, pa.binary()), pa.array(outside, hashes), pa.array(inside, hashes)], ["host", "article", "outside", "inside"])

    there = pages.where(F.col(html_col).isNotNull()).select(_host(url_col).alias("host"), html_col)
    hashes = stage(map_batches(there, hashed, "host string, article binary, outside array<binary>, inside array<binary>"))
    counts = hashes.select("host", F.explode("outside").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    total = hashes.groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.where(F.col("n") >= min_pages).join(total, "host").where(F.col("n") >= F.col("pages") * min_share)
    articles = hashes.where(F.col("article").isNotNull()).groupBy("host", "article").agg(F.any_value("inside").alias("inside"))
    counts = articles.select("host", F.explode("inside").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = stage(counts.where(F.col("n") >= min_pages))
    total = counts.where(F.octet_length("hash") == 0).select("host", F.col("n").alias("articles"))
    prose = F.substring("hash", 1, 1) == F.lit(b"p")
    share = F.col("n") / F.col("articles")
    within = counts.where(F.octet_length("hash") > 0).join(total, "host").where(F.when(prose, (F.col("n") >= MIN_ARTICLES) & (share >= PROSE_SHARE)).otherwise(share >= min_share))
    return often.select("host", "hash").unionByName(within.select("host", "hash")).groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """The id, url, text and n_chars of every page."""
    found = templates(pages, url_col, html_col, min_pages, min_share)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), _host(url_col).alias("host"))
    id_type = dict(pages.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, known = [], {}
        for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            key = b"".join(sorted(template or []))
            if key not in known:
                known[key] = frozenset(template or [])
            texts.append(Page(page).text(known[key]) if page else "")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"]
        )

    # A host may have any share of the pages: they are dealt over more parts the more pages there are, and each part gets
    # the host's template.
    salts = max(SALTS, -(-pages.count() // SALT_PAGES))
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)).cast("int"))
    joined = rows.join(salted, ["host", "salt"], "left").select("_id", "_url", "_html", "template")
    return map_batches(joined, run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
