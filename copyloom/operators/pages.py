"""The page job: one parse per page gives facts, anchors and container scopes."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import entities, unescape
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyloom import rules, schemas
from copyloom.functions import text as tx
from copyloom.functions import urls

# Element groups of the HTML standard that decide where an open
# element ends.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HEAD_TAGS = frozenset("html head base link meta title style script noscript template".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup html iframe li listing main menu nav noscript ol p plaintext pre script "
    "search section select style summary svg table tbody td template textarea tfoot "
    "th thead title tr ul xmp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main "
    "menu nav ol p plaintext pre section summary ul".split()
)
KEEPS_P = frozenset("button caption svg table td th".split())
STRIPPED = frozenset(rules.STRIPPED_TAGS)


# Elements whose content is text up to their end tag; in the first two, character
# references count.
TEXT_TAGS = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.I)
    for name in ("title", "textarea", "script", "style", "xmp", "iframe", "noembed", "noframes")
}
NAME = re.compile(r"[^\s/>]+")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;|=?)")


def _attribute_text(value: str) -> str:
    """Character references in an attribute; open ones only count as whole names."""

    def decoded(found: re.Match) -> str:
        ref, end = found.group(), found.group(1)
        if end == ";" or (ref[1] == "#" and not end) or (not end and ref[1:] in entities.html5):
            return unescape(ref)
        return ref

    return REFERENCE.sub(decoded, value) if "&" in value else value


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Attributes from `at` on, self-closing or not, and the place behind `>`; -1 if it is missing."""
    found: list[tuple[str, str]] = []
    while True:
        gap = GAP.match(html, at)
        at = gap.end()
        if at >= len(html):
            return found, False, -1
        if html[at] == ">":
            return found, gap.group().endswith("/"), at + 1
        name = ATTRIBUTE.match(html, at)
        at = name.end()
        equals = EQUALS.match(html, at)
        value = ""
        if equals:
            at = equals.end()
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = html[at + 1 : end], end + 1
            else:
                bare = BARE.match(html, at)
                value, at = bare.group(), bare.end()
        found.append((name.group().lower(), _attribute_text(value)))


def _tokens(html: str) -> Iterator[tuple]:
    """`("text", str)`, `("start", name, attributes, closed)` and `("end", name)` in order.

    Goes over the page once, without stepping back: each search either moves
    on or, by finding nothing, ends the page.
    """
    at, drawings, size = 0, 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:])
            return
        if lt > at:
            yield "text", unescape(html[at:lt])
        mark = html[lt + 1 : lt + 2]
        if mark.isascii() and mark.isalpha():
            name = NAME.match(html, lt + 1)
            tag = name.group().lower()
            if html.startswith(">", name.end()):
                attributes, closed, at = [], False, name.end() + 1
            else:
                attributes, closed, at = _attributes(html, name.end())
                if at < 0:
                    return
            drawings += tag == "svg" and not closed
            yield "start", tag, attributes, closed
            if tag in TEXT_TAGS and not (closed and drawings):
                end = TEXT_TAGS[tag].search(html, at)
                stop = end.start() if end else size
                if stop > at:
                    content = html[at:stop]
                    yield "text", unescape(content) if tag in ("title", "textarea") else content
                at = stop
        elif mark == "/" and html[lt + 2 : lt + 3].isascii() and html[lt + 2 : lt + 3].isalpha():
            name = NAME.match(html, lt + 2)
            tag = name.group().lower()
            at = name.end() + 1
            if not html.startswith(">", name.end()):
                _, _, at = _attributes(html, name.end())
                if at < 0:
                    return
            drawings -= tag == "svg" and drawings > 0
            yield "end", tag
        elif html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                at = html.index(">", lt) + 1
            else:
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
        elif mark in ("!", "/", "?") and mark:
            end = html.find(">", lt)
            at = end + 1 if end >= 0 else size
        else:
            yield "text", "<"
            at = lt + 1


class _Page:
    """Walks one page; keeps text outside stripped elements and every anchor.

    Two stacks of open elements are kept: `_open` follows the browser rules
    that matter for text (a block ends an open paragraph, inline end tags do
    not reach over a block), `_tree` closes up to the nearest element of the
    same name and decides which container an anchor belongs to. The depths of
    open elements are kept by name, so that no step walks the stack in vain.
    """

    def __init__(self, facts: bool, anchors: bool, separator: str = "") -> None:
        self._facts, self._anchors, self._separator = facts, anchors, separator
        self.title: list[str] = []
        self.h1: list[str] | None = None
        self.body: list[str] = []
        self.meta: str | None = None
        self.links: list[tuple[str, bool, int]] = []
        self._open: list[str] = []
        self._at: dict[str, list[int]] = {}
        self._blocks: list[int] = [-1]
        self._keeps: list[int] = [-1]
        self._skipping = 0
        self._h1_depth: int | None = None
        self._in_head = True
        self._tree: list[str] = []
        self._names: dict[str, int] = {}
        # First element that fits each container rule: its depth, then None when closed.
        self._container: dict[int, int | None] = {}

    def read(self, html: str) -> None:
        for kind, value, *more in _tokens(html):
            if kind == "text":
                self._text(value)
            elif kind == "start":
                self._start(value, *more)
            else:
                self._end(value)

    # -- text -------------------------------------------------------------
    def _close_to(self, depth: int) -> None:
        """Close open elements down to and with the one at `depth`."""
        while len(self._open) > depth:
            name = self._open.pop()
            at = self._at[name].pop()
            if name in STRIPPED:
                self._skipping -= 1
            if at == self._blocks[-1]:
                self._blocks.pop()
            if at == self._keeps[-1]:
                self._keeps.pop()
            if at == self._h1_depth:
                self._h1_depth = None

    def _push(self, tag: str) -> None:
        if tag in CLOSES_P:
            paragraphs = self._at.get("p")
            if paragraphs and paragraphs[-1] > self._keeps[-1]:
                self._close_to(paragraphs[-1])
        if tag in VOID_TAGS:
            return
        depth = len(self._open)
        self._open.append(tag)
        self._at.setdefault(tag, []).append(depth)
        if tag in BLOCK_TAGS:
            self._blocks.append(depth)
        if tag in KEEPS_P:
            self._keeps.append(depth)
        if tag in STRIPPED:
            self._skipping += 1
        elif tag == "h1" and not self._skipping and self.h1 is None:
            self.h1, self._h1_depth = [], depth

    def _close(self, tag: str) -> None:
        depths = self._at.get(tag)
        if not depths or tag in ("html", "body"):
            return
        if tag in BLOCK_TAGS or depths[-1] > self._blocks[-1]:
            self._close_to(depths[-1])

    def _break(self, tag: str) -> None:
        if self._separator and not self._skipping and not self._in_head:
            if tag in BLOCK_TAGS or tag == "br":
                self.body.append(self._separator)

    # -- containers -------------------------------------------------------
    def _mark(self, tag: str, attrs: dict[str, str]) -> None:
        depth = len(self._tree)
        for i, (_, only, attr, how, values) in enumerate(rules.CONTAINER_RULES):
            if i in self._container or (only and only != tag):
                continue
            have = attrs.get(attr)
            if have and (have in values if how == "equals" else any(v in have for v in values)):
                self._container[i] = depth

    def _leave(self, tag: str) -> None:
        if not self._names.get(tag):
            return
        while self._tree:
            name = self._tree.pop()
            self._names[name] -= 1
            if name == tag:
                break
        depth = len(self._tree)
        for i, at in self._container.items():
            if at is not None and at >= depth:
                self._container[i] = None

    def _inside(self) -> int:
        mask = 0
        for i, at in self._container.items():
            if at is not None:
                mask |= 1 << i
        return mask

    # -- tokens -----------------------------------------------------------
    def _start(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if self._in_head and tag not in HEAD_TAGS:
            self._in_head = False
        if self._facts:
            self._push(tag)
            self._break(tag)
            if tag == "meta" and self.meta is None and not self._skipping:
                first = dict(reversed(attributes))
                if first.get("name") == "description":
                    self.meta = first.get("content", "")
        if self._anchors:
            if attributes:
                last = dict(attributes)
                if "id" in last or "class" in last:
                    self._mark(tag, last)
            if tag not in VOID_TAGS:
                self._tree.append(tag)
                self._names[tag] = self._names.get(tag, 0) + 1
        if tag == "a":
            # Of repeated attributes the first counts.
            first = dict(reversed(attributes))
            if "href" in first:
                self.links.append((first["href"], not self._skipping, self._inside()))
        # A closing slash only counts inside drawings.
        if closed and tag not in VOID_TAGS and (tag == "svg" or self._at.get("svg")):
            self._end(tag)

    def _end(self, tag: str) -> None:
        if tag == "head":
            self._in_head = False
        if self._facts:
            self._close(tag)
            self._break(tag)
        if self._anchors:
            self._leave(tag)

    def _text(self, data: str) -> None:
        if not self._facts or self._skipping:
            return
        in_title = bool(self._at.get("title"))
        if in_title:
            self.title.append(data)
        if self._h1_depth is not None:
            self.h1.append(data)
        if self._in_head and not in_title and data.strip():
            self._in_head = False
        if not self._in_head:
            self.body.append(data)

    def scopes(self) -> tuple[list[int], int]:
        """Platform mask of each anchor, and of the platforms with a container."""
        chosen: dict[str, int] = {}
        for i, rule in enumerate(rules.CONTAINER_RULES):
            if i in self._container:
                chosen.setdefault(rule[0], i)
        found = sum(rules.PLATFORM_BITS[p] for p in chosen)
        masks = []
        for _, _, inside in self.links:
            mask = 0
            for platform, bit in rules.PLATFORM_BITS.items():
                if platform not in chosen or inside >> chosen[platform] & 1:
                    mask |= bit
            masks.append(mask)
        return masks, found


# Signs that stay as they are in an encoded link; everything else is percent-encoded.
PLAIN_SIGNS = "!#$%&'()*+,/:;=?@[]|~\\^"


def _read_page(
    base: str, html: str, facts: bool, anchors: bool, separator: str = "", encode: bool = False
) -> dict:
    page = _Page(facts, anchors, separator)
    page.read(html)
    row: dict = {"success": True, "error": None}
    if facts:
        row["title"] = "".join(page.title)
        row["meta_desc"] = page.meta or ""
        row["h1"] = "".join(page.h1 or [])
        row["body"] = "".join(page.body)
    masks, found = page.scopes()
    rows, bad = [], 0
    for n, ((href, visible, _), mask) in enumerate(zip(page.links, masks), 1):
        if not anchors and "/products/" not in href:
            continue
        try:
            link = urljoin(base, href)
            if encode:
                link = quote(link, safe=PLAIN_SIGNS)
        except ValueError:
            link, bad = None, bad + 1
        rows.append({"ordinal": n, "href": href, "link": link, "visible": visible, "scopes": mask})
    row["anchors"], row["found"], row["bad_links"] = rows, found, bad
    return row


# Pages that a worker holds as Python objects at a time, whatever the Arrow batch.
ROWS_AT_ONCE = 64

# Arrow types of what the job adds.
MADE = {
    "success": pa.bool_(),
    "error": pa.string(),
    "title": pa.string(),
    "meta_desc": pa.string(),
    "h1": pa.string(),
    "body": pa.string(),
    "anchors": pa.list_(
        pa.struct(
            [
                ("ordinal", pa.int32()),
                ("href", pa.string()),
                ("link", pa.string()),
                ("visible", pa.bool_()),
                ("scopes", pa.int32()),
            ]
        )
    ),
    "found": pa.int32(),
    "bad_links": pa.int32(),
}


def _job_schema(keep: list[T.StructField], facts: bool) -> T.StructType:
    fields = [*keep, T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType())]
    if facts:
        fields += [T.StructField(n, T.StringType()) for n in ("title", "meta_desc", "h1", "body")]
    fields += [
        T.StructField("anchors", schemas.ANCHORS),
        T.StructField("found", T.IntegerType()),
        T.StructField("bad_links", T.IntegerType()),
    ]
    return T.StructType(fields)


def read_pages(
    pages: DataFrame,
    facts: bool = True,
    anchors: bool = True,
    html: str = "html",
    base: str = "url",
    separator: str = "",
    encode: bool = False,
) -> DataFrame:
    """Parse each page once, next to where it is read; `html` does not leave the job.

    All other columns are kept. A page that cannot be read gives a row with
    `success` false. Without `facts` no text is collected; without `anchors`
    only product-link anchors are kept and no containers are looked for. Text
    of neighbouring blocks is joined without a blank unless a `separator` is
    given. With `encode` resolved links are percent-encoded.
    """
    keep = [f for f in pages.schema.fields if f.name != html]
    names = [f.name for f in keep]
    schema = _job_schema(keep, facts)
    added = schema.names[len(names):]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = {"success": False, "anchors": [], "found": 0, "bad_links": 0}
        slices = (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        for batch in slices:
            out = []
            for address, source in zip(batch[base].to_pylist(), batch[html].to_pylist()):
                if source is None:
                    out.append({**failed, "error": "no content"})
                    continue
                try:
                    out.append(_read_page(address or "", source, facts, anchors, separator, encode))
                except Exception as exc:  # one bad page must not stop the job
                    out.append({**failed, "error": f"{type(exc).__name__}: {exc}"})
            made = [pa.array([row.get(c) for row in out], type=MADE[c]) for c in added]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *made], [*names, *added])

    return pages.mapInArrow(job, schema)


def page_facts(pages: DataFrame, separator: str = "", encode: bool = False) -> DataFrame:
    """One row of facts per page (`page_id, url, html`); options as in `read_pages`."""
    read = read_pages(
        pages.select("page_id", "url", "html"),
        facts=True,
        anchors=False,
        separator=separator,
        encode=encode,
    )
    seen = F.filter("anchors", lambda a: a.visible & urls.is_product_link(a.href))
    link = F.transform(
        seen, lambda a: F.when(a.href.startswith("http"), a.href).otherwise(a.link)
    )
    links = F.array_distinct(F.filter(link, lambda x: x.isNotNull()))
    return read.select(
        "page_id",
        "url",
        "success",
        "error",
        tx.strip(F.col("title")).alias("title"),
        "meta_desc",
        tx.strip(F.col("h1")).alias("h1"),
        tx.body_text(F.col("body")).alias("body_text"),
        links.alias("product_links"),
        "bad_links",
    )


# Ship the job with its code, so that executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(rules)
