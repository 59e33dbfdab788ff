"""Captured HTML to node arrays: one Arrow pass, no shuffle.

The Python side only cuts the document into nodes and finds the JSON objects
inside scripts; every rule about what the nodes mean is a column expression
over its output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import isfinite
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfspark.config import DETAIL_KEY
from shelfspark.functions.text import WHITESPACE

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
#: start tag -> (open tags it ends, tags the search does not leave)
_IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{tag: ({"p"}, {"td", "th", "table", "button"}) for tag in _ENDS_PARAGRAPH},
}
#: How strongly an open element withstands the end tags of others; 0 where not named.
_HOLDS = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}
_HIDDEN_TEXT = frozenset({"script", "style", "template"})
_JSON_LD = "application/ld+json"

NODES_TYPE = T.ArrayType(T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("t0", T.IntegerType()),
    T.StructField("t1", T.IntegerType()),
    T.StructField("text_len", T.IntegerType()),
    T.StructField("link", T.IntegerType()),  # the first a[href] below the node, or NULL
]))
PARSED_FIELDS = [
    T.StructField("nodes", NODES_TYPE),
    T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("ld", T.ArrayType(T.StructType([
        T.StructField("raw", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("product", T.StringType()),
        T.StructField("crumbs", T.StringType()),
    ]))),
    T.StructField("detail", T.StringType()),
]

_I32 = pa.int32()


class _Nodes(HTMLParser):
    """Collects nodes in document order while the standard tokenizer runs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[list[tuple[str, str]]] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.span: list[list[int]] = []   # [t0, t1, length at start, text length]
        self.texts: list[str] = []
        self.json_ld: list[str] = []
        self._open: list[int] = []
        self._run: list[str] = []
        self._length = 0

    def _flush(self) -> None:
        if not self._run:
            return
        text = "".join(self._run)
        self._run.clear()
        if self._open and self.tags[self._open[-1]] in _HIDDEN_TEXT:
            node = self._open[-1]
            if ("type", _JSON_LD) in self.attrs[node]:
                self.json_ld.append(text)
            return
        self.texts.append(text)
        self._length += len(text.strip(WHITESPACE))

    def _close_to(self, depth: int) -> None:
        for node in self._open[depth:]:
            self.last[node] = len(self.tags) - 1
            span = self.span[node]
            span[1], span[3] = len(self.texts), self._length - span[2]
        del self._open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        if tag in _IMPLIED_END:
            ends, fence = _IMPLIED_END[tag]
            for depth in range(len(self._open) - 1, -1, -1):
                name = self.tags[self._open[depth]]
                if name in ends:
                    self._close_to(depth)
                    break
                if name in fence:
                    break
        seen: dict[str, str] = {}
        for name, value in attrs:
            seen.setdefault(name, value or "")
        if "class" in seen:
            seen["class"] = " ".join(seen["class"].split())
        node = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(list(seen.items()))
        self.parent.append(self._open[-1] if self._open else -1)
        self.last.append(node)
        self.span.append([len(self.texts), len(self.texts), self._length, 0])
        if tag not in _VOID:
            self._open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        strength = _HOLDS.get(tag, 0)
        for depth in range(len(self._open) - 1, -1, -1):
            name = self.tags[self._open[depth]]
            if name == tag:
                self._close_to(depth)
                break
            if _HOLDS.get(name, 0) > strength:  # </b> inside a cell does not end the cell
                break

    def handle_data(self, data: str) -> None:
        self._run.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def finish(self) -> None:
        self.close()
        self._flush()
        self._close_to(0)

    def first_links(self) -> list[int | None]:
        """For every node the first link below it: one sweep from the end."""
        found: list[int | None] = [None] * len(self.tags)
        link = len(self.tags)
        for node in range(len(self.tags) - 1, -1, -1):
            if link <= self.last[node]:
                found[node] = link
            if self.tags[node] == "a" and any(name == "href" for name, _ in self.attrs[node]):
                link = node
        return found


def _json_text(value: object) -> str:
    """JSON text; NaN and infinite numbers, which are none in JSON, become null."""
    try:
        return json.dumps(value, allow_nan=False)
    except ValueError:
        return json.dumps(_finite(value))


def _finite(value: object) -> object:
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return None if isinstance(value, float) and not isfinite(value) else value


def _first_of_type(document: object, wanted: str) -> str | None:
    """JSON text of the first object, depth first, whose ``@type`` matches."""
    todo = [document]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            kinds = value.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if wanted in [k.lower() for k in kinds if isinstance(k, str)]:
                return _json_text(value)
            value = list(value.values())
        if isinstance(value, list):
            todo.extend(reversed(value))
    return None


def _json_ld_block(raw: str) -> tuple:
    try:
        document = json.loads(raw)
    except (ValueError, RecursionError):
        return raw, False, None, None
    return (raw, True, _first_of_type(document, "product"),
            _first_of_type(document, "breadcrumblist"))


def _embedded_detail(html: str, key: str) -> str | None:
    """JSON text of the object that follows ``key``, if it is a detail object."""
    at = html.find(key)
    brace = html.find("{", at + len(key)) if at >= 0 else -1
    if brace < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(html, brace)
    except (ValueError, RecursionError):
        return None
    return _json_text(value) if "goodsId" in value else None


def _offsets(sizes: list[int]) -> pa.Array:
    total, out = 0, [0]
    for size in sizes:
        total += size
        out.append(total)
    return pa.array(out, _I32)


def _list(rows: list[list], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets([len(r) for r in rows]), values)


def _parse_column(pages: list[str | None], key: str) -> list[pa.Array]:
    """One batch of documents as Arrow columns, in the order of PARSED_FIELDS."""
    docs, blocks, details = [], [], []
    for html in pages:
        doc = _Nodes()
        doc.feed(html or "")
        doc.finish()
        docs.append(doc)
        blocks.append([_json_ld_block(raw) for raw in doc.json_ld])
        details.append(_embedded_detail(html or "", key))

    attrs = [a for d in docs for a in d.attrs]
    pairs = [p for a in attrs for p in a]
    spans = [s for d in docs for s in d.span]
    nodes = pa.StructArray.from_arrays(
        [
            pa.array([i for d in docs for i in range(len(d.tags))], _I32),
            pa.array([p for d in docs for p in d.parent], _I32),
            pa.array([x for d in docs for x in d.last], _I32),
            pa.array([t for d in docs for t in d.tags], pa.string()),
            pa.MapArray.from_arrays(
                _offsets([len(a) for a in attrs]),
                pa.array([k for k, _ in pairs], pa.string()),
                pa.array([v for _, v in pairs], pa.string()),
            ),
            pa.array([s[0] for s in spans], _I32),
            pa.array([s[1] for s in spans], _I32),
            pa.array([s[3] for s in spans], _I32),
            pa.array([x for d in docs for x in d.first_links()], _I32),
        ],
        names=["id", "parent", "last", "tag", "attrs", "t0", "t1", "text_len", "link"],
    )
    flat = [b for row in blocks for b in row]
    ld = pa.StructArray.from_arrays(
        [pa.array([b[i] for b in flat], pa.bool_() if i == 1 else pa.string()) for i in range(4)],
        names=["raw", "ok", "product", "crumbs"],
    )
    return [
        _list([d.tags for d in docs], nodes),
        _list([d.texts for d in docs], pa.array([t for d in docs for t in d.texts], pa.string())),
        _list(blocks, ld),
        pa.array(details, pa.string()),
    ]


def parse_pages(pages: DataFrame, html: str = "html", detail_key: str = DETAIL_KEY) -> DataFrame:
    """Replace the ``html`` column by nodes, texts, JSON-LD blocks and detail.

    All other columns travel along untouched.  Select only what is needed
    before the call: rows and columns dropped here are never parsed.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(kept + PARSED_FIELDS)
    names = [f.name for f in schema.fields]
    keep_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few documents at a time: the node arrays outgrow their documents
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                parsed = _parse_column(part.column(html).to_pylist(), detail_key)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in keep_names] + parsed, names=names
                )

    return pages.mapInArrow(run, schema)


def embedded_details(pages: DataFrame, detail_key: str = DETAIL_KEY) -> DataFrame:
    """Replace ``html`` by the embedded detail object only: no document is parsed."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType([*kept, T.StructField("detail", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_embedded_detail(h or "", detail_key) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names[:-1]] + [pa.array(found, pa.string())], names=names
            )

    return pages.mapInArrow(run, schema)
