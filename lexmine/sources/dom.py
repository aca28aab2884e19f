"""HTML to rows of elements: the one step that runs in Python, on Arrow batches.

Every page becomes one array of elements in document order, kept in the page's own row. Selectors are then
ordinary array expressions, so nothing is shuffled. An element covers the interval [ord, last] of document order:
``b`` is inside ``a`` when ``a.ord < b.ord <= a.last``. The parser also records which wanted rules enclose an element
(``inside``) and which places of the array its own contents take (``first`` to ``past``), so selectors are linear.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

ELEMENT_TYPE = (
    "array<struct<ord:int,last:int,tag:string,classes:array<string>,attrs:map<string,string>,text:string,"
    "first:int,past:int,inside:array<string>>>"
)
_ARROW_TYPE = pa.list_(pa.struct([
    ("ord", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("first", pa.int32()), ("past", pa.int32()),
    ("inside", pa.list_(pa.string())),
]))

# Elements without content, and elements whose strings do not count as text of those around them.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
APART_TAGS = frozenset(["rp", "rt", "script", "style", "template"])

Wanted = tuple[str | None, str | None, str | None]  # tag, class, attribute; None matches any


def rule_name(rule: Wanted) -> str:
    return "|".join(part or "" for part in rule)


class _Outline(HTMLParser):
    """Collects the wanted elements of one page. Tags close only what is open; nothing is implied."""

    def __init__(self, wanted: dict[str | None, list[Wanted]] | None) -> None:
        super().__init__(convert_charrefs=False)
        self.wanted = wanted
        self.open: list[dict] = []
        self.enclosing: list[tuple[str, ...]] = [()]
        self.depth: dict[str, int] = {}
        self.apart: list[str] = []
        self.found: list[dict] = []
        self.strings: list[tuple[str | None, str]] = []
        self.pending: list[str] = []
        self.count = 0

    def _flush(self) -> None:
        if self.pending:
            text = "".join(self.pending).strip()
            self.pending.clear()
            if text:
                self.strings.append((self.apart[-1] if self.apart else None, text))

    def _met(self, tag: str, classes: list[str], attrs: dict[str, str]) -> list[str]:
        """The wanted rules that an element meets."""
        if self.wanted is None:
            return []
        rules = [*self.wanted.get(tag, ()), *self.wanted.get(None, ())]
        return [rule_name(r) for r in rules if (r[1] is None or r[1] in classes) and (r[2] is None or r[2] in attrs)]

    def _open(self, tag: str, attrs: list[tuple[str, str | None]], void: bool) -> None:
        self._flush()
        values = {name: value or "" for name, value in attrs}
        classes = values.get("class", "").split()
        met, inside = self._met(tag, classes, values), self.enclosing[-1]
        element = {
            "ord": self.count, "last": self.count, "tag": tag, "classes": classes, "attrs": values, "text": "",
            "start": len(self.strings), "keep": self.wanted is None or bool(met), "inside": inside,
        }
        self.count += 1
        if element["keep"]:
            self.found.append(element)
        element["first"] = element["past"] = len(self.found)
        if not void:
            self.open.append(element)
            # One tuple per distinct set of rules on the way down, shared by all elements below.
            self.enclosing.append(inside if set(met) <= set(inside) else tuple(sorted({*inside, *met})))
            self.depth[tag] = self.depth.get(tag, 0) + 1
            if tag in APART_TAGS:
                self.apart.append(tag)

    def _close_last(self) -> None:
        element = self.open.pop()
        self.enclosing.pop()
        element["past"] = len(self.found)
        tag = element["tag"]
        self.depth[tag] -= 1
        if tag in APART_TAGS:
            self.apart.pop()
        element["last"] = self.count - 1
        if element["keep"]:
            own = tag if tag in APART_TAGS else None
            element["text"] = "".join(text for kind, text in self.strings[element["start"]:] if kind == own)

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, tag in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        self._flush()
        if self.depth.get(tag):
            while self.open[-1]["tag"] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        self.pending.append(html.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        known = html.unescape(f"&{name};")
        self.pending.append(known if known != f"&{name};" else f"&{name}")

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self._flush()

    def finish(self) -> list[dict]:
        self.close()
        self._flush()
        while self.open:
            self._close_last()
        return [
            {**{k: e[k] for k in ("ord", "last", "tag", "classes", "text", "first", "past", "inside")}, "attrs": list(e["attrs"].items())}
            for e in self.found
        ]


def _outline(page: str | None, wanted: dict[str | None, list[Wanted]] | None) -> list[dict] | None:
    if page is None:
        return None
    parser = _Outline(wanted)
    try:
        parser.feed(page)
        return parser.finish()
    except (AssertionError, ValueError):  # markup the parser rejects: no rows from this page
        return None


PIECE_BYTES = 1 << 20  # text of the pages whose elements a worker holds at once; a longer page is a piece of its own


def _pieces(pages: pa.Array) -> Iterator[slice]:
    """Places of successive pages of about PIECE_BYTES together. An Arrow batch has thousands of pages, whatever their size."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(pages).to_pylist()):
        if i > start and size + (n or 0) > PIECE_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += n or 0
    yield slice(start, len(pages))


def elements(body: Column, wanted: Iterable[Wanted] | None = None) -> Column:
    """Elements of a page as an array. ``wanted`` names the only ones to return, so that text is not repeated for
    every ancestor; pages that cannot be parsed give NULL."""
    by_tag: dict[str | None, list[Wanted]] | None = None
    if wanted is not None:
        by_tag = {}
        for rule in wanted:
            by_tag.setdefault(rule[0], []).append(rule)

    @F.arrow_udf(ELEMENT_TYPE)
    def outline(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for piece in _pieces(pages):
                yield pa.array([_outline(page, by_tag) for page in pages[piece].to_pylist()], type=_ARROW_TYPE)

    return outline(body)


def elements_by(kind: Column, body: Column, wanted: dict[str, Iterable[Wanted]]) -> Column:
    """Elements of pages of several kinds in one pass: ``wanted`` names those of each kind; other rows give NULL."""
    by_kind: dict[str, dict[str | None, list[Wanted]]] = {}
    for name, tests in wanted.items():
        by_tag = by_kind.setdefault(name, {})
        for rule in tests:
            by_tag.setdefault(rule[0], []).append(rule)

    @F.arrow_udf(ELEMENT_TYPE)
    def outline(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, pages in batches:
            for piece in _pieces(pages):
                both = zip(kinds[piece].to_pylist(), pages[piece].to_pylist())
                yield pa.array([_outline(page, by_kind[k]) if k in by_kind else None for k, page in both], type=_ARROW_TYPE)

    # Bodies that are no pages do not travel to the worker.
    return outline(kind, F.when(kind.isin(*by_kind), body))


# ---- selectors ----------------------------------------------------------------------------------

Test = Callable[[Column], Column]


def is_a(tag: str | None = None, cls: str | None = None, attr: str | None = None) -> Test:
    """The element has this tag, class and attribute."""
    def test(e: Column) -> Column:
        checks = [e["tag"] == tag] if tag else []
        if cls:
            checks.append(F.array_contains(e["classes"], cls))
        if attr:
            checks.append(F.map_contains_key(e["attrs"], attr))
        out = checks[0]
        for check in checks[1:]:
            out = out & check
        return out

    test.wanted = [(tag, cls, attr)]
    return test


def either(*tests: Test) -> Test:
    """Any of the tests: a comma list, each element once."""
    def test(e: Column) -> Column:
        out = tests[0](e)
        for other in tests[1:]:
            out = out | other(e)
        return out

    test.wanted = [w for t in tests for w in t.wanted]
    return test


def within(els: Column, outer: Test, inner: Test) -> Test:
    """``inner`` somewhere inside ``outer``, which must be a rule, or either of some, that the parser was given."""
    names = F.array(*[F.lit(rule_name(rule)) for rule in outer.wanted])

    def test(e: Column) -> Column:
        return inner(e) & F.arrays_overlap(e["inside"], names)

    test.wanted = [*outer.wanted, *inner.wanted]
    return test


def select(els: Column, test: Test) -> Column:
    return F.filter(els, test)


def first(els: Column, test: Test, inside: Column | None = None) -> Column:
    """The first matching element, of the page or of the element ``inside``; NULL if none."""
    among = els if inside is None else F.slice(els, inside["first"] + 1, inside["past"] - inside["first"])
    return F.get(F.filter(among, test), F.lit(0))


def texts(found: Column) -> Column:
    return F.transform(found, lambda e: e["text"])


def text_or_empty(element: Column) -> Column:
    return F.coalesce(element["text"], F.lit(""))
