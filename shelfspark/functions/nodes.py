"""Columns over the node array of a parsed page.

Nodes stand in document order and know the last node of their subtree, so a
subtree is a slice and "is an ancestor" is a comparison of two numbers.  No
node is ever exploded for these look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.binding import let
from shelfspark.functions.text import clean, strip

Predicate = Callable[[Column], Column]

_COMPOUND = re.compile(r"(?:[^\s>\[]|\[[^\]]*\])+|>")
_SIMPLE = re.compile(
    r"^(?P<tag>[a-zA-Z][\w-]*)"
    r"|\.(?P<cls>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)(?P<q>['\"]?)(?P<val>.*?)(?P=q)(?P<fold>\s+i)?)?\]"
)


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def _simple(match: re.Match) -> Predicate:
    """One part of a compound selector as a predicate."""
    if match["tag"]:
        return lambda n: n["tag"] == match["tag"].lower()
    if match["cls"]:
        return lambda n: F.contains(
            F.concat(F.lit(" "), attr(n, "class"), F.lit(" ")), F.lit(f" {match['cls']} ")
        )
    name, op, want = match["attr"].lower(), match["op"], match["val"]
    if op is None:
        return lambda n: attr(n, name).isNotNull()
    fold = bool(match["fold"])
    value = F.lit(want.lower() if fold else want)

    def test(n: Column) -> Column:
        have = F.lower(attr(n, name)) if fold else attr(n, name)
        tests = {"=": lambda: have == value, "*=": lambda: F.contains(have, value),
                 "^=": lambda: F.startswith(have, value), "$=": lambda: F.endswith(have, value)}
        return tests[op]()
    return test


def _compound(text: str) -> Predicate:
    """``tag.class[attr=v]`` as a predicate."""
    tests, at = [], 0
    while at < len(text):
        match = _SIMPLE.match(text[at:])
        if match is None:
            raise ValueError(f"selector part not understood: {text!r}")
        tests.append(_simple(match))
        at += match.end()

    def test(n: Column) -> Column:
        result = tests[0](n)
        for t in tests[1:]:
            result = result & t(n)
        return F.coalesce(result, F.lit(False))
    return test


def matcher(nodes: Column, selector: str) -> Predicate:
    """Predicate of a selector list.

    Understands tag, ``.class``, ``[a]``, ``[a=v]``, ``*= ^= $=``, the ``i``
    flag, descendant, child and comma.  A selector outside this set matches
    nothing, as a malformed one should never end a run.
    """
    def chain(parts: list[str]) -> Predicate:
        own = _compound(parts[-1])
        if len(parts) == 1:
            return own
        if parts[-2] == ">":
            above = chain(parts[:-2])
            return lambda n: own(n) & F.coalesce(
                above(F.get(nodes, n["parent"])), F.lit(False)
            )
        above = chain(parts[:-1])
        return lambda n: own(n) & F.exists(
            F.slice(nodes, F.lit(1), n["id"]), lambda a: (a["last"] >= n["id"]) & above(a)
        )

    try:
        tests = [chain(_COMPOUND.findall(part)) for part in selector.split(",")]
    except (ValueError, IndexError):
        return lambda n: F.lit(False)

    def test(n: Column) -> Column:
        result = tests[0](n)
        for t in tests[1:]:
            result = result | t(n)
        return result
    return test


def select(nodes: Column, selector: str) -> Column:
    """All matching nodes in document order."""
    return F.filter(nodes, matcher(nodes, selector))


def first(nodes: Column, selector: str) -> Column:
    return F.get(select(nodes, selector), F.lit(0))


def subtree(nodes: Column, n: Column) -> Column:
    """The descendants of a node, without itself."""
    return F.slice(nodes, n["id"] + 2, n["last"] - n["id"])


def pieces(texts: Column, n: Column) -> Column:
    """The stripped, non-blank text pieces inside a node."""
    own = F.slice(texts, n["t0"] + 1, n["t1"] - n["t0"])
    return F.filter(F.transform(own, strip), lambda t: t != "")


def text_of(texts: Column, n: Column, separator: str = "") -> Column:
    """Stripped pieces joined; NULL for a missing node."""
    return F.when(n.isNotNull(), F.array_join(pieces(texts, n), separator))


def raw_text_of(texts: Column, n: Column) -> Column:
    """Text as written, with its inner white space."""
    return F.array_join(F.slice(texts, n["t0"] + 1, n["t1"] - n["t0"]), "")


def first_text(nodes: Column, texts: Column, selector: str) -> Column:
    """Text of the first matching node that has any."""
    found = F.transform(select(nodes, selector), lambda n: text_of(texts, n))
    return F.get(F.filter(found, lambda t: t != ""), F.lit(0))


def meta(nodes: Column, prop: str) -> Column:
    """Stripped content of ``<meta property=…>``, else ``<meta name=…>``."""
    def content(metas: Column) -> Column:
        def by(name: str) -> Column:
            return F.get(F.filter(metas, lambda n: attr(n, name) == prop), F.lit(0))
        return attr(F.coalesce(by("property"), by("name")), "content")
    metas = F.filter(nodes, lambda n: n["tag"] == "meta")
    return let(let(metas, content), lambda c: F.when(c != "", strip(c)))


def title(nodes: Column, texts: Column) -> Column:
    """The document title, stripped."""
    return clean(let(first(nodes, "title"), lambda n: raw_text_of(texts, n)))
