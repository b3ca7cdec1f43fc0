"""Operator 8, HTML extraction by paths on which the pages of a host agree.

Each page's containers are scored by the text they hold outside links (and half of what the containers in them score;
navigation, footers and the like score nothing). A container's path is its tags and classes from the root down, classes
generalised: lower case, digits to one #, sorted. Pages vote for paths with their scores' shares, in millionths so that
sums are exact; Spark adds them up per host, and the winner (most votes, then most pages, then by name) is looked up by
every page of the host and its text extracted. A page that lacks the winning path, or has nothing but links there
(a sidebar, say) though it has text elsewhere, falls back to its own best container.

Cases: a null or empty page, or one without text in a container, gives empty text. A page without a host (null or
unusable url) doesn't vote and takes its own best container. Unclosed tags, comments and scripts are closed by what
follows or by the end; a < that opens no tag is text. Repeated rows vote and are extracted each on its own; null page_id
passes through. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAX_BROADCAST = 50_000  # winning paths are broadcast up to so many hosts, else joined by a shuffle
_CONTAINERS = frozenset("html body div article section main td blockquote form fieldset figure center table tbody tr ul ol dl header footer nav aside menu details dialog".split())
_BOILER = frozenset("header footer nav aside menu form dialog head".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address caption summary figcaption hr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea title svg iframe select button".split()}
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_SCOPE = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset("table tbody".split()), "td": frozenset(["tr", "table"])}


def events(html: str) -> Iterator[tuple[str, str]]:
    """("open", path), ("close", ""), ("text", words), ("link", words) and ("break", "") in the order of the page."""
    stack: list[tuple[str, str]] = []  # every open block; those that are containers have a path
    path = [""]
    pos, n, links = 0, len(html), 0

    def pop() -> Iterator[tuple[str, str]]:
        tag, own = stack.pop()
        if own:
            path.pop()
            yield "close", ""
        else:
            yield "break", ""

    while pos < n:
        lt = html.find("<", pos)
        text = html[pos:] if lt < 0 else html[pos:lt]
        if text and (text := _SPACE.sub(" ", unescape(text))):
            yield "link" if links else "text", text
        if lt < 0:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        kind = html[lt + 1 : lt + 2]
        tag = bool(kind) and (kind.isalpha() or kind in "/!?")
        gt = html.find(">", lt + 1) if tag else -1
        if tag and gt < 0:  # the page ends within a tag
            break
        if gt < 0:
            yield "link" if links else "text", "<"
            pos = lt + 1
            continue
        pos = gt + 1
        closing = kind == "/"
        body = html[lt + 1 + closing : gt]
        words = body.split(None, 1)
        name = words[0].rstrip("/").lower() if words else ""
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            yield "break", ""
        elif closing and (name in _CONTAINERS or name in _BLOCKS):
            if any(t == name for t, _ in stack):
                while stack[-1][0] != name:
                    yield from pop()
                yield from pop()
        elif closing:
            continue
        elif name in _RAW:
            end = _RAW[name].search(html, pos) if not body.endswith("/") else None
            pos = end.end() if end else pos if body.endswith("/") else n
        elif name in _CONTAINERS or name in _BLOCKS:
            while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                yield from pop()
            if name in _SCOPE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _SCOPE[name]:
                        break
                    if stack[k][0] == name:
                        while len(stack) > k:
                            yield from pop()
                        break
            links = 0
            if name in _CONTAINERS:
                m = _CLASS.search(body)
                classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in (m[1] or m[2] or m[3] or "").split()}) if m else []
                path.append(f"{path[-1]}/{'.'.join([name, *classes])}")
                stack.append((name, path[-1]))
                yield "open", path[-1]
            elif name == "hr":
                yield "break", ""
            else:
                stack.append((name, ""))
                yield "break", ""
    while stack:
        yield from pop()


def scores(html: str | None) -> dict[str, int]:
    """Millionths of the page's score by path; containers of one path are added up."""
    out: dict[str, float] = {}
    stack: list[tuple[str, list[float]]] = []
    for kind, x in events(html or ""):
        if kind == "open":
            stack.append((x, [0.0]))
        elif kind == "close":
            p, (s,) = stack.pop()
            if p.rsplit("/", 1)[-1].split(".", 1)[0] in _BOILER:
                s = 0.0
            if s > 0:
                out[p] = out.get(p, 0.0) + s
            if stack:
                stack[-1][1][0] += s / 2
        elif kind == "text" and stack:
            stack[-1][1][0] += len(x.strip())
        elif kind == "link" and stack:
            stack[-1][1][0] = max(0.0, stack[-1][1][0] - len(x.strip()))
    total = sum(out.values())
    return {p: round(s * 1_000_000 / total) for p, s in out.items()} if total else {}


def best(votes: dict[str, int]) -> str | None:
    return min(votes, key=lambda p: (-votes[p], p)) if votes else None


def extract(html: str | None, path: str | None) -> str | None:
    """Text of the containers with this path, navigation and the like left out; None where there is none."""
    return _extract(html, path)[0]


def _extract(html: str | None, path: str | None) -> tuple[str | None, int]:
    """Text as by :func:`extract`, and how many characters of it are outside links, less those within."""
    if path is None or not html:
        return None, 0
    weight = 0
    lines, line, inside, boiler, found = [], [], 0, 0, False
    stack: list[tuple[bool, bool]] = []
    for kind, x in events(html):
        if kind == "open":
            hit, skip = x == path, bool(inside) and x.rsplit("/", 1)[-1].split(".", 1)[0] in _BOILER
            stack.append((hit, skip))
            inside, boiler, found = inside + hit, boiler + skip, found or hit
        elif kind == "close":
            hit, skip = stack.pop()
            if inside and line:
                lines.append("".join(line))
            line = []
            inside, boiler = inside - hit, boiler - skip
            continue
        if not inside or boiler:
            continue
        if kind in ("text", "link"):
            line.append(x)
            weight += len(x.strip()) * (1 if kind == "text" else -1)
        elif line:
            lines.append("".join(line))
            line = []
    return ("\n".join(t for x in lines if (t := _SPACE.sub(" ", x).strip())) if found else None), weight


def host_of(url: Column) -> Column:
    """Host in lower case, without port; null where there is none."""
    h = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, votes = [], [], []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for p, v in scores(html).items():
                hosts.append(host)
                paths.append(p)
                votes.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], names=["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for html, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text, weight = _extract(html, path)
            own = scores(html) if text is None or weight <= 0 else {}
            fallback = text is None or bool(own)
            if fallback:
                path = best(own)
                text, _ = _extract(html, path)
            rows.append((path, fallback, text or ""))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], names=["page_id", "host", "path", "fallback", "text"])


def winners(pages: DataFrame) -> DataFrame:
    """host, path, votes and pages: the path on which each host's pages agree most."""
    d = common.project(pages, ["url", "html"]).select(host_of(F.col("url")).alias("host"), "html").filter("host is not null")
    voted = d.mapInArrow(_votes, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.count("*").alias("pages"))
    first = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("pages"), "path")
    return voted.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path (that was used), fallback and text of every page."""
    d = common.project(pages, ["page_id", "url", "html"], {"page_id": "bigint"}).select("page_id", host_of(F.col("url")).alias("host"), "html")
    w = common.materialise(winners(pages).select(F.col("host").alias("h"), "path"), "paths")
    if w.count() <= MAX_BROADCAST:
        w = F.broadcast(w)
    joined = d.join(w, F.col("host") == F.col("h"), "left").select("page_id", "host", "html", "path")
    return joined.mapInArrow(_texts, "page_id bigint, host string, path string, fallback boolean, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages"))
