"""HTML: text nodes, links put into a page, the parts of an act. Trees are walked in Arrow batches by the standard parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.converters import text
from ..functions.helpers import xml_escape
from ..sources.batches import bounded

# Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOT_TEXT = {"script", "style"}


class _Texts(HTMLParser):
    """Runs of text with their offsets in the source; those within links, scripts and styles are marked as not free."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.source, self.nodes, self.inside = source, [], []
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.feed(source)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in VOID:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def _add(self, raw: str) -> None:
        free = "a" not in self.inside and not NOT_TEXT & set(self.inside)
        if self.nodes and self.nodes[-1][3] == free and self.nodes[-1][0] + len(self.nodes[-1][1]) == self._at():
            at, before, path, _ = self.nodes.pop()
            self.nodes.append((at, before + raw, path, free))
        else:
            self.nodes.append((self._at(), raw, "/".join(self.inside), free))

    def handle_data(self, data: str) -> None:
        self._add(data)

    def handle_entityref(self, name: str) -> None:
        raw = f"&{name}"
        self._add(raw + (";" if self.source.startswith(raw + ";", self._at()) else ""))

    def handle_charref(self, name: str) -> None:
        raw = f"&#{name}"
        self._add(raw + (";" if self.source.startswith(raw + ";", self._at()) else ""))


def _unescape_closed(raw: str) -> str:
    return re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], raw)


def text_nodes_of(source: str, closed: bool = False) -> list[tuple[int, str, str]]:
    """(offset, text, path) of the free, non-blank runs of text. Browsers read some character references without their semicolon too;
    with closed only those that have it are read."""
    read = _unescape_closed if closed else unescape
    return [(at, read(raw), path) for at, raw, path, free in _Texts(source).nodes if free and raw.strip()]


def text_nodes(df: DataFrame, key: str, column: str = "html", closed: bool = False) -> DataFrame:
    """key, node (from 0), offset, text, path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, *n) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, n in enumerate(text_nodes_of(h or "", closed))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "node", "offset", "text", "path"])

    kind = dict(df.dtypes)[key]
    return bounded(df.select(F.col(key).alias("k"), column)).mapInArrow(run, f"k {kind}, node int, offset int, text string, path string").withColumnRenamed("k", key)


def linked_text(c, links: Column, initial: bool = False) -> Column:
    """A plain text with links: links is array<struct<position, match, href, attrs>>, sorted and without overlaps; done by position.
    With initial each link carries its text, so that ``unlinked`` finds it."""
    t = text(c)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        own = F.concat(F.lit('" data-initial="'), xml_escape(x["match"])) if initial else F.lit("")
        href = F.concat(F.lit('<a href="'), xml_escape(x["href"]), own, F.lit('">'), xml_escape(x["match"]), F.lit("</a>"))
        before = F.substring(t, a["at"] + 1, x["position"] - a["at"])
        return F.struct((x["position"] + F.length(x["match"])).alias("at"), F.concat(a["out"], xml_escape(before), href).alias("out"))

    done = F.aggregate(links, start, step)
    return F.concat(done["out"], xml_escape(F.substring(t, done["at"] + 1, F.length(t))))


def linked_html_of(source: str, links: list[tuple[int, str, str]]) -> str:
    """Links (offset, text, href) put where they lie within one free run of text of the body; others are left out."""
    body = re.search(r"<body[^>]*>", source, re.I)
    free = [(at, at + len(raw)) for at, raw, _, ok in _Texts(source).nodes if ok and at >= (body.end() if body else 0)]
    out, done = [], 0
    for at, match, href in sorted(links):
        end = at + len(match)
        if at >= done and any(a <= at and end <= z for a, z in free) and source[at:end] == match:
            out += [source[done:at], f'<a href="{escape(href)}">', match, "</a>"]
            done = end
    return "".join([*out, source[done:]])


def linked_html(df: DataFrame, key: str, column: str = "html", links: str = "links") -> DataFrame:
    """key, html with links (array<struct<position, match, href>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [linked_html_of(h or "", [(x["position"], x["match"], x["href"]) for x in ls or ()]) for h, ls in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["k", "html"])

    kind = dict(df.dtypes)[key]
    return bounded(df.select(F.col(key).alias("k"), column, links)).mapInArrow(run, f"k {kind}, html string").withColumnRenamed("k", key)


def _plain(raw: str) -> tuple[str, list[int]]:
    """The text of a run of source, and the place in the source of each of its characters and of its end."""
    out, places, at = [], [], 0
    for m in re.finditer(r"&#?[A-Za-z0-9]+;?", raw):
        read = unescape(m[0])
        if read != m[0]:
            out += [raw[at : m.start()], read]
            places += [*range(at, m.start()), *[m.start()] * len(read)]
            at = m.end()
    return "".join([*out, raw[at:]]), [*places, *range(at, len(raw) + 1)]


_LETTER_RUN = re.compile(r"[^\W_]+|.", re.S)
#: What may not touch a context: a letter, a digit, a slash.
_TOUCHING = re.compile(r"[^\W_]|/")


def contexts_in(text: str, known: dict[str, list[str]]) -> list[tuple[int, str]]:
    """Where contexts stand, the leftmost and there the longest first, touched by no letter, digit or slash. known: contexts by their
    first run of letters or sign, the longest first."""
    out, done = [], 0
    for m in _LETTER_RUN.finditer(text):
        if m.start() < done or m.start() and _TOUCHING.match(text[m.start() - 1]):
            continue
        for c in known.get(m[0], ()):
            end = m.start() + len(c)
            if text.startswith(c, m.start()) and not (end < len(text) and _TOUCHING.match(text[end])):
                out.append((m.start(), c))
                done = end
                break
    return out


def with_contexts_of(source: str, by: dict[str, str]) -> str:
    """Every occurrence of a context within a free run of text of the body replaced by its HTML; tags and attributes stay. The ends of a
    run bound a context, whatever stands in the neighbouring element."""
    body = re.search(r"<body[^>]*>", source, re.I)
    known: dict[str, list[str]] = {}
    for c in sorted(by, key=lambda c: (-len(c), c)):
        if c.strip():
            known.setdefault(_LETTER_RUN.match(c)[0], []).append(c)
    out, done = [], 0
    for at, raw, _, free in _Texts(source).nodes:
        if not free or not raw.strip() or at < (body.end() if body else 0):
            continue
        text, places = _plain(raw) if "&" in raw else (raw, range(len(raw) + 1))
        for start, c in contexts_in(text, known):
            out += [source[done : at + places[start]], by[c]]
            done = at + places[start + len(c)]
    return "".join([*out, source[done:]])


def with_contexts(df: DataFrame, key: str, column: str = "html", contexts: str = "contexts") -> DataFrame:
    """key, html with every bounded occurrence of its contexts (array<struct<context, html>>) replaced; a page without any stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [with_contexts_of(h or "", {x["context"]: x["html"] for x in reversed(cs or ()) if x["context"]}) for h, cs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["k", "html"])

    kind = dict(df.dtypes)[key]
    return bounded(df.select(F.col(key).alias("k"), column, contexts)).mapInArrow(run, f"k {kind}, html string").withColumnRenamed("k", key)


def unlinked(c) -> Column:
    """A page with the links that were put in taken out again: an element that carries its first text in data-initial becomes that
    text, other links stay."""
    return F.regexp_replace(text(c), r'(?is)<a\b[^>]*\bdata-initial="([^"]*)"[^>]*>.*?</a>', "$1")


def sanitised(source: str) -> str:
    """The text of a page, white space folded."""
    return re.sub(r"\s+", " ", " ".join(unescape(raw) for _, raw, path, _ in _Texts(source).nodes if not NOT_TEXT & set(path.split("/")))).strip()


def without_note_anchors(c) -> Column:
    """Without links whose text is a number in parentheses."""
    return F.regexp_replace(text(c), r"(?is)<a\b[^>]*>\s*\([0-9]+\)\s*</a>", "")


def body_of(c) -> Column:
    """head and body of a page as a struct; a page without a body is all body."""
    t = text(c)
    has = t.rlike("(?is)<body[^>]*>")
    head = F.when(has, F.regexp_extract(t, r"(?is)^(.*?<body[^>]*>)", 1)).otherwise("")
    return F.struct(head.alias("head"), F.substring(t, F.length(head) + 1, F.length(t)).alias("body"))


# ---- the parts of an act


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    @property
    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(c.text if isinstance(c, Node) else c for c in self.children)).strip()

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def by_id(self, name: str) -> Node | None:
        return self.find(lambda n: n.attrs.get("id") == name)


class _Tree(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__()
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(source: str) -> Node:
    return _Tree(source).root


@dataclass(frozen=True)
class Part:
    """What is asked for: at most one of annex, recital and article; paragraph and point within an article."""

    annex: str = ""
    recital: str = ""
    article: str = ""
    paragraph: str = ""
    point: str = ""


NOT_FOUND = "subdivision.not.found"
PARAGRAPH_NOT_FOUND = "paragraph.not.found"
POINT_NOT_FOUND = "point.not.found"


def article_node(root: Node, number: str) -> Node | None:
    """By the id art_N, else by N padded to three digits."""
    return root.by_id(f"art_{number}") or root.by_id(number.rjust(3, "0"))


def _points(node: Node) -> dict[str, Node]:
    """Tables (or list items) by the letter in parentheses that they begin with."""
    out: dict[str, Node] = {}
    for n in node.walk():
        if n.tag in ("table", "li") and (m := re.match(r"\(([^\W\d_]{1,2}|\d+)\)", n.text)):
            out.setdefault(m[1].lower(), n)
    return out


_HEADING = re.compile(r"^(article|artikel|artículo|articolo|artigo|artikkel|член|άρθρο|článek|článok|artykuł|straipsnis|pants|cikk|člen|članak|artikolu|airteagal|articolul|artikla|annex|annexe|anhang)\s+(\d+[a-z]?|[ivxlc]+)?\b\.?", re.I)


def _legacy(root: Node, kind: str, number: str) -> list[Node] | None:
    """Paragraphs between the heading asked for and the next heading."""
    paragraphs = [n for n in root.walk() if n.tag in ("p", "h1", "h2", "h3")]
    inside: list[Node] | None = None
    for p in paragraphs:
        m = _HEADING.match(p.text)
        if m and len(p.text) < 80:
            if inside is not None:
                return inside
            annex = m[1].lower() in ("annex", "annexe", "anhang")
            if annex == (kind == "annex") and (m[2] or "").lower() == number.lower():
                inside = []
        elif inside is not None:
            inside.append(p)
    return inside


def subdivision(source: str, part: Part, celex: str = "") -> dict:
    """id, header, content, subdivisions, error of a part of an act."""
    root, out = tree(source), {"id": None, "header": "", "content": "", "subdivisions": contents(source) if celex[:1] == "3" else [], "error": None}
    if not (part.annex or part.recital or part.article):
        return out | {"error": NOT_FOUND}
    kind, number = next((k, getattr(part, k)) for k in ("annex", "recital", "article") if getattr(part, k))
    node = article_node(root, number) if kind == "article" else root.by_id({"annex": "anx_", "recital": "rct_"}[kind] + number)
    if node is None:
        paragraphs = _legacy(root, kind, number)
        if paragraphs is None:
            return out | {"error": NOT_FOUND}
        node = Node("div", {}, paragraphs)
    out["id"] = node.attrs.get("id")
    header = node.find(lambda n: n.tag in ("h1", "h2", "h3") or "title" in n.attrs.get("class", "") or n.attrs.get("class", "").startswith("ti-"))
    out["header"] = header.text if header else ""
    if kind == "article" and part.paragraph:
        found = root.by_id(f"{number.rjust(3, '0')}.{part.paragraph.rjust(3, '0')}")
        if found is None:
            return out | {"content": _content(node, header), "error": PARAGRAPH_NOT_FOUND}
        node, out["id"] = found, found.attrs.get("id")
    if part.point:
        found = _points(node).get(part.point.lower())
        if found is None:
            return out | {"content": _content(node, header), "error": POINT_NOT_FOUND}
        node = found
    return out | {"content": _content(node, header)}


def _content(node: Node, header: Node | None) -> str:
    words = node.text
    return words.removeprefix(header.text).strip() if header else words


def contents(source: str) -> list[dict]:
    """Articles and annexes with their ids, in order."""
    out = []
    for n in tree(source).walk():
        name = n.attrs.get("id", "")
        if m := re.fullmatch(r"(art|anx)_(\w+)", name):
            out.append({"type": {"art": "article", "anx": "annex"}[m[1]], "offset": m[2], "id": name})
        elif re.fullmatch(r"\d{3}", name):
            out.append({"type": "article", "offset": str(int(name)), "id": name})
    return out


def case_paragraph(source: str, number: str) -> str | None:
    """A numbered paragraph of a judgment: by its anchor (pointN), else by a text that begins with the number."""
    root = tree(source)
    if anchor := root.by_id(f"point{number}"):
        holder = root.find(lambda n: n.tag in ("p", "tr", "table", "div") and anchor in list(n.walk()))
        return re.sub(rf"^{number}[.\s]*", "", (holder or anchor).text)
    for n in root.walk():
        if n.tag in ("p", "tr") and (m := re.match(rf"\(?{number}[.)]?\s+(?=\S)", n.text)):
            return n.text[m.end() :]
    return None


def paragraph_slice(paragraphs: list[str], number: int) -> list[str]:
    """Paragraphs from ``n.`` or ``(n)`` to before the next number."""
    starts = lambda p, k: re.match(rf"\s*(?:{k}\.|\({k}\))", p) is not None
    out: list[str] = []
    for p in paragraphs:
        if out and starts(p, number + 1):
            break
        if out or starts(p, number):
            out.append(p)
    return out


PART = "struct<annex:string,recital:string,article:string,paragraph:string,point:string>"
FOUND = "id string, header string, content string, subdivisions array<struct<type:string,offset:string,id:string>>, error string"


def act_parts(df: DataFrame, key: str, column: str = "html", part: str = "part", celex: str = "celex") -> DataFrame:
    """key and the part of each act that its struct asks for."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.string()), ("id", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [subdivision(h or "", Part(**{k: v or "" for k, v in (p or {}).items()}), c or "") for h, p, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            made = [pa.array([r[n] for r in rows], kind if n == "subdivisions" else pa.string()) for n in ("id", "header", "content", "subdivisions", "error")]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["k", "id", "header", "content", "subdivisions", "error"])

    own = dict(df.dtypes)[key]
    return bounded(df.select(F.col(key).alias("k"), column, F.col(part).cast(PART).alias("p"), celex)).mapInArrow(run, f"k {own}, {FOUND}").withColumnRenamed("k", key)
