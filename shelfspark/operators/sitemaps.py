"""Product URLs a site declares itself: the product branch of its sitemap tree."""

from __future__ import annotations

import re
import zlib
from codecs import getincrementaldecoder
from collections.abc import Iterator
from html import unescape
from itertools import islice
from xml.etree.ElementTree import ParseError, XMLPullParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.config import SAMPLE_SIZE
from shelfspark.functions.text import strip
from shelfspark.functions.urls import canonical_url, host_of, origin_of, path_of, product_key
from shelfspark.operators.ranking import first_per_key, with_place, with_start
from shelfspark.operators.robots import capture_order
from shelfspark.session import cut_lineage

_MARKS = re.compile(r"<(?:[\w.-]+:)?(sitemap|url)\b[^>]*>|<(?:[\w.-]+:)?loc\b[^>]*>([^<]*(?:<!\[CDATA\[.*?\]\]>)?[^<]*)</(?:[\w.-]+:)?loc\s*>", re.I | re.S)
_COMMENT, _CDATA = re.compile(r"<!--.*?-->", re.S), re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_BARE_AMPERSAND = re.compile(rb"&(?!#?\w+;)")
_LOC_END = re.compile(r"</(?:[\w.-]+:)?loc\s*>", re.I)
_SCHEMA = "url string, nested_at long, pages_at long, nested array<string>, pages array<string>"
#: Bytes of a document read at a time, locations of a row, and bytes by which an entity has ended.
CHUNK, PIECE, LONGEST_ENTITY = 1 << 20, 50_000, 64
#: Places that a window of the walk holds at a time.
SLICE = 10_000


def is_product_sitemap(url: Column) -> Column:
    return F.contains(F.lower(path_of(url)), F.lit("product"))


class _Unreadable(Exception):
    """A body that does not inflate."""


def _chunks(url: str, body: bytes) -> Iterator[bytes]:
    """The document in chunks of CHUNK bytes at most, inflated where it is compressed."""
    if not (url.lower().endswith(".gz") or body[:2] == b"\x1f\x8b"):
        for at in range(0, len(body), CHUNK):
            yield body[at:at + CHUNK]
        return
    rest = body
    while rest:
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                made = member.decompress(rest, CHUNK)
                rest = member.unconsumed_tail
                if made:
                    yield made
                elif not rest and not member.eof:
                    raise _Unreadable
        except zlib.error as e:
            raise _Unreadable from e
        rest = member.unused_data.lstrip(b"\0")


def _inflates(url: str, body: bytes) -> bool:
    try:
        for _ in _chunks(url, body):
            pass
    except _Unreadable:
        return False
    return True


def _mended(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Without leading blanks, bare ampersands escaped; an ampersand near a chunk's end waits for the next."""
    held, begun = b"", False
    for chunk in chunks:
        held += chunk
        if not begun:
            held = held.lstrip()
            begun = bool(held)
        cut = held.rfind(b"&", max(0, len(held) - LONGEST_ENTITY))
        ready, held = (held, b"") if cut < 0 else (held[:cut], held[cut:])
        if ready:
            yield _BARE_AMPERSAND.sub(b"&amp;", ready)
    if held:
        yield _BARE_AMPERSAND.sub(b"&amp;", held)


def _parsed(url: str, body: bytes) -> Iterator[tuple[bool, str]]:
    """(is a nested sitemap, location) in order; elements are dropped as they end."""
    parser, above = XMLPullParser(events=("start", "end")), []
    for chunk in _mended(_chunks(url, body)):
        parser.feed(chunk)
        yield from _ended(parser, above)
    parser.close()
    yield from _ended(parser, above)


def _ended(parser: XMLPullParser, above: list) -> Iterator[tuple[bool, str]]:
    for event, element in parser.read_events():
        if event == "start":
            above.append(element)
            continue
        above.pop()
        text = (element.text or "").strip()
        parent = above[-1].tag.rpartition("}")[2] if above else ""
        if text and element.tag.rpartition("}")[2] == "loc":
            yield parent == "sitemap", text
        if above:
            above[-1].remove(element)


def _scanned(url: str, body: bytes) -> Iterator[tuple[bool, str]]:
    """The same of a document that is no well-formed XML: whole ``loc`` elements wherever they stand.

    A location is a nested sitemap if the last ``sitemap`` or ``url`` tag before it opened a sitemap.
    """
    inside, text = False, ""
    decoder = getincrementaldecoder("utf-8")("replace")

    def found(part: str) -> Iterator[tuple[bool, str]]:
        nonlocal inside
        for tag, loc in _MARKS.findall(_COMMENT.sub("", part)):
            if tag:
                inside = tag.lower() == "sitemap"
            elif location := unescape(_CDATA.sub(r"\1", loc)).strip():
                yield inside, location

    for chunk in _mended(_chunks(url, body)):
        text += decoder.decode(chunk)
        cut = max((m.end() for m in _LOC_END.finditer(text)), default=0)
        comment = text.rfind("<!--", 0, cut)
        if comment > text.rfind("-->", 0, cut):  # it goes on behind the cut
            cut = comment
        yield from found(text[:cut])
        text = text[cut:]
    yield from found(text + decoder.decode(b"", True))


def _pieces(url: str, body: bytes | None) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(nested before, pages before, nested, pages): the locations of a document, PIECE at a time.

    A document of more than one piece is read once more: whether it is well-formed shows at its end.
    """
    body, read, n = body or b"", _parsed, 0
    try:
        locations = read(url, body)
        held = list(islice(locations, PIECE + 1))
        if len(held) > PIECE:
            held = None
            for _ in locations:
                pass
    except ParseError:
        read, held = _scanned, None if _inflates(url, body) else []
    except _Unreadable:
        held = []
    locations = iter(held) if held is not None else read(url, body)
    before, part = [0, 0], ([], [])
    for nested, location in locations:
        part[0 if nested else 1].append(location)
        n += 1
        if n % PIECE == 0:
            yield *before, *part
            before, part = [x + len(y) for x, y in zip(before, part, strict=True)], ([], [])
    if part[0] or part[1] or not n:
        yield *before, *part


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """``(url, nested_at, pages_at, nested, pages)`` of readable documents, one Arrow pass.

    A document of more than PIECE locations has several rows; ``nested_at`` and ``pages_at`` say how many
    came before. Documents are inflated and parsed in chunks, so a worker holds a piece, not a document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):  # bodies leave Arrow one at a time
                url = batch.column("url")[i].as_py()
                for piece in _pieces(url, batch.column("body")[i].as_py()):
                    rows.append((url, *piece))
                    held += len(piece[2]) + len(piece[3])
                    if held >= PIECE:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)

    answered = docs.where(F.coalesce("status", F.lit(200)) < 400)
    return answered.select("url", "body").mapInArrow(run, _SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=["url", "nested_at", "pages_at", "nested", "pages"])


def sitemap_roots(runs: DataFrame, robots: DataFrame) -> DataFrame:
    """``(run_id, url, pos)``: Sitemap lines of robots.txt, else ``/sitemap.xml``."""
    lines = F.split("body", "\r\n|\r|\n")
    named = F.filter(
        F.transform(lines, lambda l: strip(F.regexp_extract(l, r"(?i)^\s*sitemap\s*:(.*)$", 1))),
        lambda u: u != "",
    )
    robots = first_per_key(robots, ["origin"], *capture_order(robots))
    declared = robots.where(F.coalesce("status", F.lit(200)) < 400).select(
        F.col("origin").alias("_origin"), F.when(F.size(named) > 0, named).alias("_named")
    )
    origin = origin_of(F.col("seed_url"))
    joined = runs.select("run_id", origin.alias("_origin")).join(declared, "_origin", "left")
    roots = F.coalesce("_named", F.array(F.concat("_origin", F.lit("/sitemap.xml"))))
    return joined.select("run_id", F.posexplode(roots).alias("pos", "url"))


def walk_sitemaps(roots: DataFrame, parsed: DataFrame, max_docs: int = 0) -> DataFrame:
    """Documents in the order a queue would visit them.

    Returns ``(run_id, url, rank, in_branch)``, at most ``max_docs`` per run (0: all).
    One round per tree level; a level comes after the one above it, and inside a
    level the place of the parent and the place in the parent decide.  A document
    met twice keeps its first visit.
    """
    visited = None
    frontier = roots.select(
        "run_id", "url", F.lit(0).alias("parent_rank"), F.col("pos").cast("long").alias("pos"), F.lit(False).alias("in_branch")
    )
    while True:
        first_visit = frontier.groupBy("run_id", "url").agg(
            F.min(F.struct("parent_rank", "pos", "in_branch")).alias("visit")
        )
        if visited is not None:
            first_visit = first_visit.join(visited.select("run_id", "url"), ["run_id", "url"], "left_anti")
            base = visited.groupBy("run_id").agg(F.max("rank").alias("base"))
            first_visit = first_visit.join(base, "run_id", "left")
        else:
            first_visit = first_visit.withColumn("base", F.lit(0))
        # a place is that of the parent's first child plus the place among its children; both are
        # running totals over slices, so no window holds more than a slice
        first_visit = cut_lineage(first_visit.select("run_id", "url", "base", "visit.parent_rank", "visit.pos", "visit.in_branch"))
        families = with_start(
            first_visit.groupBy("run_id", "parent_rank").agg(F.count("*").alias("_n")), ["run_id"], "parent_rank", SLICE, "_n", "_start")
        placed = with_place(first_visit, ["run_id", "parent_rank"], "pos", SLICE, "_place", "_of")
        ranked = placed.join(families.drop("_n"), ["run_id", "parent_rank"]).select(
            "run_id", "url", (F.coalesce("base", F.lit(0)) + F.col("_start") + F.col("_place") + 1).cast("int").alias("rank"), "in_branch")
        level = cut_lineage(ranked.where(F.col("rank") <= max_docs) if max_docs else ranked)
        if visited is not None and level.isEmpty():
            break
        visited = level if visited is None else visited.unionByName(level)
        met = level.join(parsed.select("url", "nested_at", "nested").where(F.size("nested") > 0), "url")
        some = F.exists("nested", is_product_sitemap)  # in this piece of the document
        met = met.join(met.groupBy("run_id", "rank").agg(F.bool_or(some).alias("_branch")), ["run_id", "rank"])
        frontier = met.select(
            "run_id", F.col("rank").alias("parent_rank"), (F.col("in_branch") | F.col("_branch")).alias("in_branch"), "_branch", "nested_at",
            F.posexplode("nested").alias("_pos", "url"),
        ).where(~F.col("_branch") | is_product_sitemap(F.col("url"))).select(
            "run_id", "parent_rank", "in_branch", (F.col("nested_at") + F.col("_pos")).alias("pos"), "url")
    return visited


def sitemap_product_urls(
    visited: DataFrame, parsed: DataFrame, runs: DataFrame, max_urls: int = 0
) -> DataFrame:
    """``(run_id, url, rank, pos)``: page URLs of the product branch, on the seed's host.

    First place wins; the first ``max_urls`` of a run stay (0: all).  The cap counts per
    document first and needs a running total over documents only, so no window
    ever holds more than one document's URLs.
    """
    host = runs.select("run_id", host_of(F.col("seed_url")).alias("_host"))
    found = (
        visited.where("in_branch").join(parsed.select("url", "pages_at", "pages"), "url")
        .select("run_id", "rank", "pages_at", F.posexplode("pages").alias("_pos", "url"))
        .select("run_id", "rank", (F.col("pages_at") + F.col("_pos")).alias("pos"), "url")
        .join(host, "run_id").where(host_of(F.col("url")) == F.col("_host"))
    )
    distinct = found.groupBy("run_id", "url").agg(F.min(F.struct("rank", "pos")).alias("_p")).select(
        "run_id", "url", "_p.rank", "_p.pos"
    )
    if not max_urls:
        return distinct
    per_doc = distinct.groupBy("run_id", "rank").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("run_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    room = per_doc.select(
        "run_id", "rank", "_n",
        (F.lit(max_urls) - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_room"),
    ).where("_room > 0")
    in_doc = Window.partitionBy("run_id", "rank").orderBy("pos")
    return (
        distinct.join(room, ["run_id", "rank"])
        .withColumn("_i", F.row_number().over(in_doc)).where("_i <= _room")
        .select("run_id", "url", "rank", "pos")
    )


def cap_warnings(rows: DataFrame, cap: int, what: str) -> DataFrame:
    """Runs that reached a cap of the sitemap walk, whether or not there was more."""
    return rows.groupBy("run_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= cap).select(
        "run_id", F.format_string(f"The sitemap walk ended at %d {what}; there may be more.", "_n").alias("warning"))


def sitemap_sources(urls: DataFrame, visited: DataFrame, parsed: DataFrame) -> DataFrame:
    """``(run_id, n_urls, description)``: the first document that listed pages."""
    listing = visited.where("in_branch").join(
        parsed.where((F.size("pages") > 0) & (F.col("pages_at") == 0)).select("url"), "url"
    ).groupBy("run_id").agg(F.min_by("url", "rank").alias("_doc"))
    return urls.groupBy("run_id").agg(F.count("*").alias("n_urls")).join(listing, "run_id", "left").select(
        "run_id", "n_urls",
        F.format_string("sitemap %s (%d product URLs)", "_doc", "n_urls").alias("description"),
    )


def confirm_sitemaps(urls: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per run: do most of the first URLs look like products?

    ``(run_id, n_urls, sampled, hits, confirmed, warning)``; a run without a row
    here has no product sitemap.  Both kinds go on with shape clustering.
    """
    order = Window.partitionBy("run_id").orderBy("rank", "pos")
    sample = (
        urls.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= SAMPLE_SIZE)
        .select("run_id", product_key(canonical_url(F.col("url"))).alias("product_key"))
    )
    judged = sample.join(verdicts.select("product_key", "hit"), "product_key", "left").groupBy("run_id").agg(
        F.count("*").alias("sampled"), F.count_if("hit").alias("hits")
    )
    counted = urls.groupBy("run_id").agg(F.count("*").alias("n_urls"))
    confirmed = F.col("hits") * 2 > F.col("sampled")
    return counted.join(judged, "run_id").select(
        "run_id", "n_urls", "sampled", "hits", confirmed.alias("confirmed"),
        F.when(~confirmed, F.format_string(
            "A sample of the sitemap's %d addresses held too few products; fell back to links.", "n_urls",
        )).alias("warning"),
    )
