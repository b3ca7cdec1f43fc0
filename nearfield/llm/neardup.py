"""Operator 2, SimHash near-duplicates found with navigable small-world graphs.

Every text gets a 128-bit SimHash of its distinct words, by which it is searched, and a 256-bit SimHash of its distinct
word pairs, by which what was found is verified. Texts with the same words in the same order are one node from then on.

Shards and queries: a node is sent, as point and as query, to the shards that its ``routes`` name: the hash of its least
word triple under each of six orders. Two texts that share a share J of their triples meet in a shard with probability
1 - (1 - J)**6 at least, so no query has to go to all shards and the work grows with the input. A route that more than
``rows_per_shard`` nodes have is cut into blocks of half as many, and each block meets itself and every other one in a
tile of its own, in which all are compared with all (:func:`tile_edges`): no pair on such a route is lost, no task has to
hold the route, and the work grows with the square of what is on it.

Each shard links its points (equal sketches are one) to a navigable small-world graph over Hamming distance (nearest
points found at insertion and once more in the whole graph, links back, random far links, and links along equal routes) and searches every point in it
with a beam. A beam half of which lies within the radius is doubled, and past ``MAX_BEAM`` its query is answered exactly
(:func:`_sweep`), so nothing is capped. A sample of queries is audited against an exact scan in every shard; those that
were answered exactly don't count, but edges to such queries are found. While less than ``audit_recall`` of their edges were found, all beams of the shard
are doubled and it is searched again (past ``MAX_BEAM`` exactly). :func:`audits` gives each shard's figures, and
:func:`recall` holds sampled queries against all nodes of all shards.

:func:`deduplicate` is exact: it needs no routes and no graph, but compares all nodes with all, in tiles of two blocks
(:func:`_all_edges`), so that pairs without a common route, and those that beams miss, are found too. Its work grows with
the square of the distinct texts, at a small rate a pair (:func:`_cross`; large tiles, :func:`_by_segments`).

Pairs within ``radius`` whose pair SimHashes differ in at most ``verify`` bits are edges; edges are joined within a
shard and then, in Spark, across shards. One document of each group stays: the one with the least doc_id.

Cases: texts that are null, empty or blank are in no group. Texts without words (signs only) are copies of each other
where their signs are equal, and near to nothing else. Repeated rows are copies of each other; exactly one stays. A null
doc_id counts as larger than all others. Rows that share a doc_id but not their text are different documents. An empty
table gives an empty one. Extra columns are ignored by :func:`groups` and kept, whatever their names, by
:func:`deduplicate`.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected

RADIUS = 30
VERIFY = 76
ROUTES = 6
BEAM = 8
BUILD_BEAM = 16
MAX_BEAM = 32
AUDIT = 1024
AUDIT_RECALL = 0.9
ROWS_PER_SHARD = 40_000
MAX_BROADCAST = 100_000
CELLS = 1 << 15
ASKED = 512
SCOUTS = 64
BLOCKS = 12
ROWS_PER_BLOCK = (2_000, 200_000)
SEGMENTS = 10
CROSS_PAIRS = 5_000_000_000

_LANES = np.uint64(0x0101010101010101)
_SEEDS = [np.uint64(int(x)) for x in common.mix(np.arange(1, 65, dtype=np.uint64))]
_NONE = np.uint64(0xFFFFFFFFFFFFFFFE)
_SKETCH = "row bigint, doc_id bigint, content binary, sim binary, pairs binary, routes array<bigint>"
_FOUND = "a bigint, b bigint, points bigint, asked bigint, found_first bigint, found bigint, exact bigint, beam int"


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text (44 bits, mixed again) and where each text's begin."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))
    return common.mix(key & np.uint64((1 << 44) - 1)), first


def _simhash(h: np.ndarray, first: np.ndarray, words64: int) -> np.ndarray:
    """For each text, words64 64-bit words; a bit is set where more than half of its features have it set."""
    n = np.diff(first)
    chunk_n = -(-n // 255)  # sums of up to 255 bits fit into the eight byte lanes of a word
    doc = np.repeat(np.arange(len(n)), chunk_n)
    begin = np.repeat(first[:-1], chunk_n) + 255 * (np.arange(len(doc)) - np.repeat(np.cumsum(chunk_n) - chunk_n, chunk_n))
    out = np.zeros((len(n), words64), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    doc_begin = np.searchsorted(doc, some)
    for w in range(words64):
        hw = h if not w else common.mix(h + _SEEDS[w])
        for j in range(8):
            lanes = np.add.reduceat((hw >> np.uint64(j)) & _LANES, begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
            bit = 2 * np.add.reduceat(lanes, doc_begin, axis=0) > n[some, None]
            shift = np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j)
            out[some, w] |= np.bitwise_or.reduce(bit.astype(np.uint64) << shift, axis=1)
    return out


def sketches(texts: list[str | None]) -> dict[str, np.ndarray]:
    """content (128 bits), sim (128 bits), pairs (256 bits) and routes of each text, and n, its number of words.

    content is 0 for blank texts; a text without words has the hash of its signs."""
    w = common.words(texts)
    n, first, h = len(texts), w.first, w.hash
    doc, size = common.of_doc(first), np.diff(first)
    some = np.flatnonzero(size)
    content, routes = np.zeros((n, 2), np.uint64), np.zeros((n, ROUTES), np.uint64)
    if len(some):
        at = (np.arange(len(h)) - first[doc]).astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(2):
                content[some, k] = np.add.reduceat(common.mix(h + at * _SEEDS[k] + _SEEDS[k + 2]), first[some])
        # a text of fewer than three words, or pairs, has what there is as its only triple, or pair
        g3 = common.mix(h)
        if len(h) >= 3:
            inner = np.flatnonzero(doc[2:] == doc[:-2])
            g3[inner] = common.grams(h, 3)[inner]
        tail = size[doc] >= 3
        last = np.zeros(len(h), bool)
        for back in (1, 2):
            ends = first[some + 1] - back
            last[ends[size[some] >= 3]] = True
        g3[last & tail] = np.uint64(0xFFFFFFFFFFFFFFFF)
        with np.errstate(over="ignore"):
            for k in range(ROUTES):
                v = common.mix(g3 ^ _SEEDS[10 + k])
                v[last & tail] = np.uint64(0xFFFFFFFFFFFFFFFF)
                routes[some, k] = common.mix(np.minimum.reduceat(v, first[some]) + np.uint64(k))
    signs = np.flatnonzero(size == 0)
    if len(signs):
        c = common.chunks([texts[i] for i in signs.tolist()])
        bare = np.flatnonzero(np.diff(c.first))
        if len(bare):
            place = (np.arange(len(c.hash)) - c.first[common.of_doc(c.first)]).astype(np.uint64)
            with np.errstate(over="ignore"):
                for k in range(2):
                    content[signs[bare], k] = np.add.reduceat(common.mix(c.hash + place * _SEEDS[k + 4] + _SEEDS[k + 6]), c.first[bare])
    g2, d2 = (common.grams(h, 2), doc[1:]) if len(h) > 1 else (np.empty(0, np.uint64), np.empty(0, np.int64))
    inside = doc[1:] == doc[:-1] if len(h) > 1 else np.empty(0, bool)
    single = size[doc] == 1 if len(h) else np.empty(0, bool)
    pair_h = np.concatenate([g2[inside], h[single]])
    pair_doc = np.concatenate([d2[inside], doc[single]])
    return {"n": size, "content": content, "routes": routes, "sim": _simhash(*_distinct(h, doc, n), 2), "pairs": _simhash(*_distinct(pair_h, pair_doc, n), 4)}


def _binary(a: np.ndarray, null: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(a), [None, pa.py_buffer(rows.tobytes())])
    return pa.compute.if_else(pa.array(~null), fixed.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        texts = batch.column(2).to_pylist()
        for lo, hi in common.slices(texts):
            s = sketches(texts[lo:hi])
            null, some = (s["content"] == 0).all(1), s["n"] > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, ROUTES, 0))])
            routes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s["routes"][some].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(1)[lo:hi].cast(pa.int64()), *(_binary(s[k], null) for k in ("content", "sim", "pairs")), routes],
                names=["row", "doc_id", "content", "sim", "pairs", "routes"],
            )


class Graph:
    """Navigable small-world graph over 128-bit Hamming distance; searches run in lockstep over many queries."""

    def __init__(self, sig: np.ndarray, kin: np.ndarray, links: int = 8, far: int = 2, seed: int = 7) -> None:
        n = len(sig)
        rng = np.random.default_rng(seed)
        self.sig, self.links = [np.ascontiguousarray(c) for c in sig.T], links
        self.adj = np.full((n, 2 * links + far + kin.shape[1]), -1, np.int32)
        self.adj[:, 2 * links : 2 * links + far] = rng.integers(0, n, (n, far))
        self.adj[:, 2 * links + far :] = kin
        self.hubs = rng.integers(0, n, 4).astype(np.int32)
        back = np.zeros(n, np.int64)
        order = rng.permutation(n)
        at, size = 0, 256  # few at first, so that nearly every point finds links
        for order in (order, rng.permutation(n)):  # the second time with the whole graph to search in
            while at < n:
                self._insert(order[at : at + size], back)
                at, size = at + size, min(4096, 2 * size)
            at = 0

    def _insert(self, new: np.ndarray, back: np.ndarray) -> None:
        links = self.links
        beam = self.search(new, BUILD_BEAM)[:, :links]
        ids = np.where(beam == _NONE, -1, (beam >> np.uint64(1)).astype(np.int64) & 0xFFFFFFFF)
        self.adj[new, :links] = ids
        frm, to = np.repeat(new, links)[ids.ravel() >= 0], ids.ravel()[ids.ravel() >= 0]
        by = np.argsort(to, kind="stable")
        frm, to = frm[by], to[by]
        begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
        place = np.arange(len(to)) - np.repeat(begin, np.diff(np.append(begin, len(to))))
        self.adj[to, links + (back[to] + place) % links] = frm
        np.add.at(back, to, 1)

    def _keys(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """distance, id and a mark "not expanded" packed into one number each; _NONE for no point and for itself."""
        d = _apart([c[ids] for c in self.sig], [c[q][:, None] for c in self.sig])
        keys = (d.astype(np.uint64) << np.uint64(33)) | (ids.astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        keys[(ids < 0) | (ids == q[:, None])] = _NONE
        return keys

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """The beam of each query, best first."""
        out = np.empty((len(q), width), np.uint64)
        step = max(1, (1 << 17) // width)
        for lo in range(0, len(q), step):
            out[lo : lo + step] = self._search(q[lo : lo + step], width)
        return out

    def _search(self, q: np.ndarray, width: int) -> np.ndarray:
        spare = 8  # places that repeated points may take for one round
        start = np.concatenate([self.adj[q], np.broadcast_to(self.hubs, (len(q), len(self.hubs)))], 1)
        beam = np.full((len(q), width + spare), _NONE, np.uint64)
        live = np.arange(len(q))
        self._merge(beam, live, q, start)
        while True:
            open_ = (beam[live, :width] & np.uint64(1)).astype(bool)
            some = open_.any(1)
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            pick = open_.argmax(1)
            best = beam[live, pick]
            beam[live, pick] = best & ~np.uint64(1)
            self._merge(beam, live, q, self.adj[(best >> np.uint64(1)).astype(np.int64) & 0xFFFFFFFF])
        beam.sort(axis=1)
        return beam[:, :width]

    def _merge(self, beam: np.ndarray, live: np.ndarray, q: np.ndarray, ids: np.ndarray) -> None:
        both = np.concatenate([beam[live], self._keys(q[live], ids)], 1)
        both.sort(axis=1)
        again = (both[:, 1:] >> np.uint64(1)) == (both[:, :-1] >> np.uint64(1))
        both[:, 1:][again] = _NONE
        beam[live] = both[:, : beam.shape[1]]


def _apart(a: list[np.ndarray], b: list) -> np.ndarray:
    """Hamming distance, 64-bit column by column (a sum over a short last axis is far slower)."""
    d = np.bitwise_count(a[0] ^ b[0]).astype(np.uint16)
    for x, y in zip(a[1:], b[1:], strict=True):
        d += np.bitwise_count(x ^ y)
    return d


def _scan(g: "_Groups", q: int) -> np.ndarray:
    """All that q has an edge to."""
    near = np.flatnonzero(_apart(g.sim, [c[q] for c in g.sim]) <= g.radius)
    near = near[_apart([c[near] for c in g.pairs], [c[q] for c in g.pairs]) <= g.verify]
    return near[near != q]


def _labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Least point of each component after joining a[i] with b[i]; labels are those so far."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while not (labels[labels] == labels).all():
            labels = labels[labels]


def _places(sim: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A point of each distinct pair of sketches, and the place among these of every point."""
    key = common.grams(np.ascontiguousarray(np.concatenate([sim, pairs], 1)).ravel(), 6)[::6]
    _, at, place = np.unique(key, return_index=True, return_inverse=True)
    odd = np.flatnonzero((sim != sim[at[place]]).any(1) | (pairs != pairs[at[place]]).any(1))  # hashes that met by chance
    place[odd] = len(at) + np.arange(len(odd))
    return np.concatenate([at, odd]), place


def _kin(place: np.ndarray, route: np.ndarray, n: int) -> np.ndarray:
    """Links of each of n places to its neighbours along equal routes, 16 at most."""
    by = np.lexsort((common.mix(place.astype(np.uint64)), route))
    route, place = route[by], place[by]
    same = (route[1:] == route[:-1]) & (place[1:] != place[:-1])
    a, b = place[:-1][same], place[1:][same]
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    frm, to = both // n, both % n
    order = np.arange(len(frm)) - np.searchsorted(frm, frm)
    frm, to, order = frm[order < 16], to[order < 16], order[order < 16]
    kin = np.full((n, int(order.max()) + 1 if len(order) else 0), -1, np.int32)
    kin[frm, order] = to
    return kin


class _Groups:
    """Components of the edges that were found so far among places."""

    def __init__(self, sim: list[np.ndarray], pairs: list[np.ndarray], radius: int, verify: int) -> None:
        self.sim, self.pairs, self.radius, self.verify = sim, pairs, radius, verify
        self.labels = np.arange(len(sim[0]))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs within the radius: those that are not together yet are verified, and joined."""
        apart = self.labels[x] != self.labels[y]
        x, y = x[apart], y[apart]
        fit = _apart([c[x] for c in self.pairs], [c[y] for c in self.pairs]) <= self.verify
        self.labels = _labels(len(self.labels), x[fit], y[fit], self.labels)


def _sweep(queries: np.ndarray, g: _Groups) -> None:
    """Joins every query with all that it has an edge to: exact, and linear where queries lie in few dense places.

    A query is compared with the points that aren't in its group yet, and leads those queries that lie within half of
    both limits; these aren't compared. What one of them has an edge to lies, by the triangle inequality, within its
    limits plus its distance from the leader: only such points, and only those outside its group, are compared with it.
    """
    left = np.zeros(len(g.labels), bool)
    left[queries] = True
    led: list[tuple[int, np.ndarray, int, int]] = []
    for q in queries.tolist():
        if not left[q]:
            continue
        left[q] = False
        other = g.labels != g.labels[q]
        if not other.any():
            continue
        at = np.flatnonzero(other | left)
        d = _apart([c[at] for c in g.sim], [c[q] for c in g.sim])
        near = d <= g.radius
        at, d = at[near], d[near]
        v = _apart([c[at] for c in g.pairs], [c[q] for c in g.pairs])
        fit = (v <= g.verify) & other[at]
        if fit.any():
            g.labels = _labels(len(g.labels), np.full(int(fit.sum()), q), at[fit], g.labels)
        own = (d <= g.radius // 2) & (v <= g.verify // 2) & left[at]
        if own.any():
            left[at[own]] = False
            led.append((q, at[own], int(d[own].max()), int(v[own].max())))
    for q, members, rs, rv in led:
        if (g.labels == g.labels[q]).all():
            continue
        far = np.flatnonzero((_apart(g.sim, [c[q] for c in g.sim]) <= g.radius + rs) & (g.labels != g.labels[q]))
        far = far[_apart([c[far] for c in g.pairs], [c[q] for c in g.pairs]) <= g.verify + rv]
        step = max(1, 1_000_000 // max(len(far), 1))
        for lo in range(0, len(members) if len(far) else 0, step):
            m = members[lo : lo + step]
            x, y = np.nonzero(_apart([c[far] for c in g.sim], [c[m][:, None] for c in g.sim]) <= g.radius)
            g.join(m[x], far[y])


def _cross(queries: np.ndarray, points: np.ndarray | None, g: _Groups) -> None:
    """Joins every query with all points (None: the queries themselves) that it has an edge to, by comparing them all.

    Distances are taken in pieces of CELLS, in arrays that stay in the cache. Queries of one group go together where they
    are many, and skip the points that are in it by then."""
    room, sums, ones = np.empty(CELLS, np.uint64), np.empty(CELLS, np.uint8), np.empty(CELLS, np.uint8)
    while len(queries):
        against = queries if points is None else points
        label = g.labels[queries]
        own = np.flatnonzero(label == label[0])
        if len(own) >= min(ASKED, len(queries)):
            against = against[g.labels[against] != label[0]]
            take = own[: max(ASKED, 32 * CELLS // len(against))] if len(against) else own
        else:
            take = np.arange(min(ASKED, len(queries)))
        q, found, held = queries[take], [], 0
        of_q = [c[q][:, None] for c in g.sim]
        for lo in range(0, len(against), CELLS // 8):
            some = against[lo : lo + CELLS // 8]
            of_some = [c[some] for c in g.sim]
            for i in range(0, len(q), CELLS // len(some)):
                rows = q[i : i + CELLS // len(some)]
                x, d, e = (c[: len(rows) * len(some)].reshape(len(rows), -1) for c in (room, sums, ones))
                for k in range(len(g.sim)):
                    np.bitwise_xor(of_some[k], of_q[k][i : i + len(rows)], out=x)
                    np.bitwise_count(x, out=e if k else d)
                    if k:
                        np.add(d, e, out=d)
                near = d <= g.radius
                n = np.count_nonzero(near)
                if not n:
                    continue
                if 5 * n > near.size:  # then the whole is verified faster than what is near
                    near &= _apart([c[some] for c in g.pairs], [c[rows][:, None] for c in g.pairs]) <= g.verify
                at = np.flatnonzero(near)
                found.append((rows[at // len(some)], some[at % len(some)]))
                held += len(at)
                if held > 8 * CELLS:
                    g.join(*(np.concatenate(c) for c in zip(*found, strict=True)))
                    found, held = [], 0
        if found:
            g.join(*(np.concatenate(c) for c in zip(*found, strict=True)))
        queries = np.delete(queries, take)


def _cuts(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, width, bits that may differ) of the segments of a sketch: two that differ in radius bits at most
    differ, in one of the segments at least, in no more bits than it may (otherwise they would differ in more)."""
    spare, n = radius + 1 - SEGMENTS, SEGMENTS
    ends = [128 * k // n for k in range(n + 1)]
    return [(a, b - a, spare // n + (k < spare % n)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def _segment(sim: list[np.ndarray], at: int, width: int) -> np.ndarray:
    """The bits of both words from at on, as numbers below 2**width."""
    x = sim[at // 64] >> np.uint64(at % 64)
    if at // 64 != (at + width - 1) // 64:
        x = x | sim[at // 64 + 1] << np.uint64(64 - at % 64)
    return (x & np.uint64((1 << width) - 1)).astype(np.int64)


def _by_segments(queries: np.ndarray, points: np.ndarray | None, g: _Groups) -> None:
    """As :func:`_cross`, and as complete, but queries are only compared with points of which a segment is near theirs
    (:func:`_cuts`): about a fifth of all pairs. Where many lie in one place, :func:`_cross` compares them."""
    against = queries if points is None else points
    room = [np.empty(32 * CELLS, k) for k in (np.uint64, np.uint8, np.uint8, bool)]
    for first, width, flips in _cuts(g.radius):
        if flips < 0:
            continue
        masks = np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in itertools.combinations(range(width), k)])
        of_q, of_p = (_segment([c[i] for c in g.sim], first, width) for i in (queries, against))
        asked, given = queries[np.argsort(of_q, kind="stable")], against[np.argsort(of_p, kind="stable")]
        begin, start = (np.searchsorted(np.sort(v), np.arange((1 << width) + 1)) for v in (of_q, of_p))
        own, found, held = [c[given] for c in g.sim], [], 0
        for v in np.flatnonzero(np.diff(begin)).tolist():
            near = v ^ masks
            if points is None:
                near = near[near >= v]  # the others meet from the other side
            n = start[near + 1] - start[near]
            if not n.any():
                continue
            at = np.repeat(start[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q = asked[begin[v] : begin[v + 1]]
            if len(q) * len(at) > 32 * CELLS:
                _cross(q, given[at], g)
                continue
            of_at, step = [c[at] for c in own], max(1, CELLS // len(at))
            for i in range(0, len(q), step):
                rows = q[i : i + step]
                x, d, e, near = (c[: len(rows) * len(at)].reshape(len(rows), -1) for c in room)
                for k, c in enumerate(g.sim):
                    np.bitwise_xor(of_at[k], c[rows][:, None], out=x)
                    np.bitwise_count(x, out=e if k else d)
                    if k:
                        np.add(d, e, out=d)
                np.less_equal(d, g.radius, out=near)
                if near.any():
                    hit = np.flatnonzero(near)
                    found.append((rows[hit // len(at)], given[at[hit % len(at)]]))
                    held += len(hit)
            if held > 8 * CELLS:
                g.join(*(np.concatenate(c) for c in zip(*found, strict=True)))
                found, held = [], 0
        if found:
            g.join(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _tied(node: np.ndarray, place: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, least point of its group) of every point that isn't the least; node is in order."""
    least = np.full(len(labels), len(node))
    np.minimum.at(least, labels[place], np.arange(len(node)))
    label = least[labels[place]]
    tied = np.flatnonzero(label != np.arange(len(node)))
    return node[tied], node[label[tied]]


def tile_edges(node: np.ndarray, side: np.ndarray, sim: np.ndarray, pairs: np.ndarray, p: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """Of one tile, exactly: (point, least point of its group) as in :func:`shard_edges`. All of side 0 are compared with
    all of side 1, or with each other where there is no side 1."""
    node, at = np.unique(node, return_index=True)
    side, sim, pairs = side[at], sim[at], pairs[at]
    first, place = _places(sim, pairs)
    g = _Groups([np.ascontiguousarray(c) for c in sim[first].T], [np.ascontiguousarray(c) for c in pairs[first].T], p["radius"], p["verify"])
    queries, points = np.unique(place[side == 0]), np.unique(place[side == 1])
    if len(points):  # a few points first, so that queries that lie in one place are one group before all are compared
        _cross(points[:: max(1, len(points) // SCOUTS)], queries, g)
    compare = _by_segments if len(queries) * max(len(points), len(queries) // 2) > p["cross_pairs"] and p["radius"] < 64 else _cross
    compare(queries, points if len(points) else None, g)
    return _tied(node, place, g.labels)


def shard_edges(node: np.ndarray, sim: np.ndarray, pairs: np.ndarray, route: np.ndarray, p: dict[str, Any]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Of one shard: (point, least point of its group) of every point that isn't the least, and the audit: points,
    edges of the sampled queries (asked), how many of them the first beams and the last ones found, queries that
    were answered exactly, and the width of the last beams (0: all exactly)."""
    node, at, member = np.unique(node, return_index=True, return_inverse=True)
    sim, pairs = sim[at], pairs[at]
    first, place = _places(sim, pairs)
    n = len(first)
    sim, pairs = sim[first], pairs[first]
    g = _Groups([np.ascontiguousarray(c) for c in sim.T], [np.ascontiguousarray(c) for c in pairs.T], p["radius"], p["verify"])
    audit = {"points": len(node), "asked": 0, "found_first": 0, "found": 0, "exact": 0, "beam": p["beam"]}
    if n > 1:
        graph = Graph(sim, _kin(place[member], route, n))
        sample = np.sort(np.random.default_rng(11).choice(n, min(n, p["audit"]), replace=False)).tolist()
        truth = {q: _scan(g, q) for q in sample}
        width, rounds = p["beam"], 0
        while True:
            now, beam_of = width, np.arange(n)
            got: dict[int, np.ndarray] = {}
            while len(beam_of) and now <= MAX_BEAM:
                beam = graph.search(beam_of, now)
                near, ids = (beam >> np.uint64(33)) <= g.radius, (beam >> np.uint64(1)).astype(np.int64) & 0xFFFFFFFF
                x, y = np.nonzero(near)
                g.join(beam_of[x], ids[x, y])
                asked = np.searchsorted(beam_of, sample)
                got |= {q: ids[k][near[k]] for q, k in zip(sample, asked.tolist(), strict=True) if k < len(beam_of) and beam_of[k] == q}
                beam_of, now = beam_of[2 * near.sum(1) >= now], 2 * now
            exact = np.zeros(n, bool)
            exact[beam_of] = True
            by_beam = [q for q in sample if not exact[q]]
            # an edge to a query that is answered exactly is found from there
            found = sum(int((np.isin(truth[q], got[q]) | exact[truth[q]]).sum()) for q in by_beam)
            audit |= {"asked": sum(len(truth[q]) for q in by_beam), "found": found, "exact": int(exact.sum()), "beam": width if by_beam else 0}
            if not rounds:
                audit["found_first"] = audit["found"]
            if audit["found"] >= p["audit_recall"] * audit["asked"]:
                break
            width, rounds = 2 * width, rounds + 1
        _sweep(beam_of, g)
    return *_tied(node, place, g.labels), audit


def _u64(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, width)


def _search(p: dict[str, Any]):  # noqa: ANN202
    names = ["points", "asked", "found_first", "found", "exact", "beam"]
    kinds = [pa.int64()] * 5 + [pa.int32()]

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), k) for k in kinds)], names=["a", "b", *names])

    def figures(audit: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([audit[k]], t) for k, t in zip(names, kinds, strict=True))], names=["a", "b", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        side, route = t["side"].fill_null(-1).to_numpy(), t["route"].to_numpy()
        rows = np.flatnonzero(side < 0)
        if len(rows):
            s = t.take(pa.array(rows))
            a, b, audit = shard_edges(s["node"].to_numpy(), _u64(s["sim"], 2), _u64(s["pairs"], 4), route[rows], p)
            yield edges(a, b)
            yield figures(audit)
        rows = np.flatnonzero(side >= 0)
        rows = rows[np.argsort(route[rows], kind="stable")]
        for own in np.split(rows, np.flatnonzero(np.diff(route[rows])) + 1) if len(rows) else []:
            s = t.take(pa.array(own))
            yield edges(*tile_edges(s["node"].to_numpy(), side[own], _u64(s["sim"], 2), _u64(s["pairs"], 4), p))
            yield figures(dict.fromkeys(names, 0) | {"points": len(own), "exact": len(own)})

    return run


def _params(params: dict[str, Any]) -> dict[str, Any]:
    return {"radius": RADIUS, "verify": VERIFY, "beam": BEAM, "audit": AUDIT, "audit_recall": AUDIT_RECALL, "rows_per_shard": ROWS_PER_SHARD, "rows_per_block": ROWS_PER_BLOCK, "cross_pairs": CROSS_PAIRS} | params


def _hot(keyed: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """Values of route that more than most rows have, how many there are, and how many rows they have."""
    hot = common.materialise(keyed.groupBy("route").agg(F.count("*").alias("held")).filter(F.col("held") > most), "hot")
    n, rows = hot.agg(F.count("*"), F.coalesce(F.sum("held"), F.lit(0))).first()
    return (F.broadcast(hot) if n <= MAX_BROADCAST else hot), n, rows


def _routed(nodes: DataFrame, p: dict[str, Any]) -> tuple[DataFrame, int]:
    """node, sim, pairs, route and side, a row for each shard key of each node, and the number of shards. side is null
    where a shard's graph is searched; keys with sides are tiles of a hot route."""
    most = p["rows_per_shard"]
    keyed = nodes.select("node", "sim", "pairs", F.explode("routes").alias("route"))
    hot, n, rows = _hot(keyed.select("route"), most)
    total = nodes.agg(F.coalesce(F.sum(F.size("routes")), F.lit(0))).first()[0]
    unsided = F.lit(None).cast("int").alias("side")
    if not n:
        return keyed.select("*", unsided), max(1, -(-total // most))
    blocks = F.ceil(F.col("held") / max(1, most // 2)).cast("int")
    tiled = hot.agg(F.sum(F.col("held") * blocks)).first()[0]
    cool = keyed.join(hot, "route", "left_anti").select("node", "sim", "pairs", "route", unsided)
    split = keyed.join(hot, "route").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tile = F.xxhash64("route", F.least("own", "other"), F.greatest("own", "other")).alias("route")
    split = split.select("node", "sim", "pairs", tile, (F.col("own") > F.col("other")).cast("int").alias("side"))
    return cool.unionByName(split), max(1, -(-(total - rows + tiled) // most))


def _nodes(sketched: DataFrame) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    some = sketched.filter("content is not null").groupBy("content")
    return common.materialise(some.agg(F.min_by("row", order).alias("node"), F.first("sim").alias("sim"), F.first("pairs").alias("pairs"), F.first("routes").alias("routes")), "nodes")


def _edges(nodes: DataFrame, p: dict[str, Any]) -> DataFrame:
    routed, shards = _routed(nodes, p)
    return common.materialise(routed.repartition(shards, "route").mapInArrow(_search(p), _FOUND), "found")


def _blocks(n: int, rows: tuple[int, int]) -> int:
    """Into how many blocks n nodes are cut: BLOCKS, fewer where these would be too small, more where too large."""
    return max(1, min(BLOCKS, n // rows[0]), -(-n // rows[1]))


def _all_edges(nodes: DataFrame, p: dict[str, Any]) -> DataFrame:
    """As :func:`_edges`, but exact: every two blocks of nodes meet in a tile, a task, in which all are compared with all."""
    worded = nodes.filter(F.size("routes") > 0).select("node", "sim", "pairs")
    n = _blocks(worded.count(), p["rows_per_block"])
    split = worded.withColumn("own", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tile = (F.expr("high * (high + 1) div 2") + F.least("own", "other")).cast("int").alias("route")
    split = split.withColumn("high", F.greatest("own", "other")).select("node", "sim", "pairs", tile, (F.col("own") > F.col("other")).cast("int").alias("side"))
    return common.materialise(split.repartitionById(n * (n + 1) // 2, "route").mapInArrow(_search(p), _FOUND), "found")


def _members(sketched: DataFrame, find: Callable[[DataFrame, dict[str, Any]], DataFrame] = _edges, **params: Any) -> DataFrame:
    """row, doc_id, component, n and kept (its row that stays) of every row in a group of two or more; sketched, a written table, is removed."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    nodes = _nodes(sketched)
    edges = find(nodes, _params(params))
    found = connected(edges.filter("a is not null").select("a", "b"))
    common.drop_table(edges)
    located = sketched.filter("content is not null").select("row", "doc_id", "content").join(nodes.select("content", "node"), "content")
    located = located.join(found, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("component"))
    sizes = located.groupBy("component").agg(F.count("*").alias("n"), F.min_by("row", order).alias("kept"), F.min("doc_id").alias("group_id")).filter("n > 1")
    out = common.materialise(located.join(sizes, "component"), "members")
    for t in (sketched, nodes, found):
        common.drop_table(t)
    return out


def _sketched(docs: DataFrame) -> DataFrame:
    d = common.project(docs, ["doc_id", "text"]).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return common.materialise(d.mapInArrow(_sketch_batches, _SKETCH), "sketches")


def audits(docs: DataFrame, **params: Any) -> DataFrame:
    """points, asked, found_first, found, exact and beam of every shard, as in :func:`shard_edges`, or tile (all exact), and recall (null where nothing was asked)."""
    found = _edges(_nodes(_sketched(docs)), _params(params)).filter("a is null").drop("a", "b")
    return found.withColumn("recall", F.col("found") / F.nullif("asked", F.lit(0)))


def recall(docs: DataFrame, queries: int = 256, **params: Any) -> tuple[int, int]:
    """Of about queries nodes, drawn by hash: pairs with any node of any shard that are edges, and how many of these
    the search puts into one group."""
    p = _params(params)
    sketched = _sketched(docs)
    nodes = _nodes(sketched)
    found = connected(_edges(nodes, p).filter("a is not null").select("a", "b"))
    n = nodes.filter("sim is not null").count()
    drawn = nodes.filter("sim is not null").filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(max(1, n))) < queries).select("node", "sim", "pairs").collect()
    if not drawn:
        return 0, 0
    ask = np.array([r["node"] for r in drawn]), *(np.frombuffer(b"".join(r[k] for r in drawn), np.uint64).reshape(len(drawn), -1) for k in ("sim", "pairs"))
    shared = docs.sparkSession.sparkContext.broadcast(ask)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sims, pairs = shared.value
        for b in batches:
            node, s, v = b.column(0).to_numpy(), _u64(b.column(1), 2), _u64(b.column(2), 4)
            near = _apart(list(s.T), [c[:, None] for c in sims.T]) <= p["radius"]
            near &= _apart(list(v.T), [c[:, None] for c in pairs.T]) <= p["verify"]
            x, y = np.nonzero(near & (own[:, None] != node[None]))
            yield pa.RecordBatch.from_arrays([pa.array(own[x], pa.int64()), pa.array(node[y], pa.int64())], names=["a", "b"])

    true = nodes.filter("sim is not null").select("node", "sim", "pairs").mapInArrow(scan, "a bigint, b bigint")
    of = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))
    both = true.join(of("a"), "a", "left").join(of("b"), "b", "left").agg(F.count("*"), F.count_if(F.col("of_a") == F.col("of_b"))).first()
    return both[0], both[1]


def groups(docs: DataFrame, **params: Any) -> DataFrame:
    """doc_id, group_id (the least doc_id of its group), group_size and keep, for every document that has a duplicate."""
    m = _members(_sketched(docs), **params)
    return m.select("doc_id", "group_id", F.col("n").alias("group_size"), (F.col("row") == F.col("kept")).alias("keep"))


def deduplicate(docs: DataFrame, **params: Any) -> DataFrame:
    """docs with all its columns, one document of each group; groups are exact here."""
    d, cols, at = common.positional(docs)
    rows = common.materialise(d.withColumn(common.ROW_ID, F.monotonically_increasing_id()), "rows")
    sketched = rows.select(F.col(common.ROW_ID).alias("row"), F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")).mapInArrow(_sketch_batches, _SKETCH)
    m = _members(common.materialise(sketched, "sketches"), _all_edges, **params)
    gone = m.filter("row <> kept").select(F.col("row").alias(common.ROW_ID)).hint("shuffle_hash")  # grows with the input, however well sorted numbers compress
    return rows.join(gone, common.ROW_ID, "left_anti").drop(common.ROW_ID).toDF(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"))
