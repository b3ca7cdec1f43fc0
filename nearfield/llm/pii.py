"""Operator 6, personal data and secrets by a semi-Markov conditional random field.

Segments of a text may be entities of some type; everything between them is outside and scores nothing. Features look at
the whole span: its shape, check sums, randomness, what stands right before and behind it, and cue words before it.
Dynamic programming over the ends of segments picks the labelled segmentation with the highest score, boundaries and
types together.

Spans come from loose classes of shapes, all found with numpy over code points: up to ``MAX_GROUPS`` groups of digits
with single separators; what stands around an "@"; unbroken runs of ``CODE_CHARS`` or more characters of codes and their
pieces; runs of hexadecimal digits and colons; the value behind a cue such as "password:"; and armoured key blocks. A
class says only that a span can be scored: which spans are entities, and of which type, is the model's choice.

Weights are trained here by maximum likelihood (forward and backward sums over segmentations) on sequences written by
a seeded generator, entities and look-alikes: numbers without a valid check sum, rows of numbers, dates, versions,
prices, handles, identifiers, and values of cues that are no secrets.

Entities are overwritten by their type in brackets.

Cases: null and empty texts have no entities and stay as they are. Codes and key blocks may have any length; an address
has ``MAX_LOCAL`` characters before the "@" at most and ``MAX_DOMAIN`` behind it, a keyed value 6 to ``MAX_VALUE``, and
what is longer is not found. Keys of one letter case without digits are found only behind a cue. Repeated rows are
redacted alike; null doc_id passes through. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import ipaddress
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

TYPES = ["EMAIL", "PHONE", "CARD", "IP", "SECRET", "NATIONAL_ID", "IBAN"]
MAX_GROUPS = 6
CODE_CHARS = 16
MAX_LOCAL, MAX_DOMAIN, MAX_VALUE = 64, 255, 256
NEAR = 24  # characters between a cue and what it speaks for, at most

FEATURES = ["bias", "email", "phone", "plus", "pairs", "card", "ssn", "ip4", "ip6", "iban", "hex", "code", "jwt", "armour", "keyed", "luhn", "no_luhn", "issuer", "ip_ok", "iban_sum", "random", "prefix", "switches", "digits", "no_digits", "mixed", "one_case", "sign", "short", "wordy", "urlish", "glued", "dotted", "chained", "money", "after_secret", "after_call"]
_INDEX = {f: i for i, f in enumerate(FEATURES)}
_EMAIL = re.compile(r"[^\W_][\w.%+-]*@(?:[\w-]+\.)+[^\W\d_]{2,}")
_SECRET_WORDS = "password|passwd|passphrase|pwd|secret|token|api[_ -]?key|apikey|access[_-]?key|private[_-]?key|key|auth|authorization|bearer|credentials?"
_CALL_WORDS = "phone|tel|call|mobile|fax|whatsapp"
_CUE = re.compile(rf"(?<![^\W_])(?:(?:{_SECRET_WORDS})|({_CALL_WORDS}))(?![^\W_])")
_CUE_I = re.compile(_CUE.pattern, re.I)
_VALUE = re.compile(r"""["']?[ \t]{0,2}(?::=|=>|[:=]{1,2})[ \t]{0,2}["'`]?([^\s"'`<>,;]+)""")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY[A-Z ]*)-----.*?(?:-----END \1-----|\Z)", re.S)
_HEX = re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}")
_JWT = re.compile(r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]*", re.A)
_PREFIX = re.compile(r"(?:[sprk]k[-_]|gh[opsur]_|xox[abprs]-|AKIA|ASIA|AIza|glpat-|hf_|npm_)[A-Za-z0-9]")
_SWITCH = re.compile(r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])\d|(?<=\d)[A-Za-z]")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")


class Spans(NamedTuple):
    """Candidates of a batch: number of the text, start and end in it, and the features of each (spans x features)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    x: np.ndarray


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_sum(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ip(s: str) -> bool:
    try:
        return ipaddress.ip_address(s).version == 6
    except ValueError:
        return False


@lru_cache(1)
def _classes() -> dict[str, np.ndarray]:
    """Tables over code points."""
    out = {k: np.zeros(common._TOP, bool) for k in ("digit", "code", "hexcolon", "upper", "lower")}
    for name, chars in (("digit", "0123456789"), ("code", "0123456789_+/=.-"), ("hexcolon", "0123456789abcdefABCDEF:"), ("upper", ""), ("lower", "")):
        out[name][[ord(c) for c in chars]] = True
    for name, (a, b) in (("upper", "AZ"), ("lower", "az")):
        out[name][ord(a) : ord(b) + 1] = True
    out["code"] |= out["upper"] | out["lower"]
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return edge[::2], edge[1::2]


def _number_spans(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of digits that can be a phone, a card, an address or a national number: start, end and features."""
    digit = _classes()["digit"][cps]
    rs, re_ = _runs(digit)
    lens = re_ - rs
    if not len(rs):
        return rs, re_, np.zeros((0, len(FEATURES)), bool)
    pad = np.concatenate([cps, np.full(4, 10, np.uint32)])
    g, c0, c1, c2 = rs[1:] - re_[:-1], pad[re_[:-1]], pad[re_[:-1] + 1], pad[re_[:-1] + 2]
    is_ = lambda c, chars: np.isin(c, [ord(x) for x in chars])
    two = is_(c0, ")") & is_(c1, " -.") | is_(c0, " -") & is_(c1, "(")
    three = is_(c0, ")") & is_(c1, " ") & is_(c2, "(") | is_(c0, " ") & is_(c1, "-") & is_(c2, " ")
    link = (g == 1) & is_(c0, " .-/") | (g == 2) & two | (g == 3) & three
    sep = np.where(g == 1, c0, 0)
    broken = np.concatenate([[0], np.cumsum(~link)])
    upto = np.concatenate([[0], np.cumsum(lens)])
    value = np.zeros(len(rs), np.int64)
    for k in range(4):
        here = lens > k
        value[here] = value[here] * 10 + (cps[rs[here] + k].astype(np.int64) - 48)
    flat = cps[digit].astype(np.int64) - 48
    before = np.where(rs > 0, pad[np.maximum(rs, 1) - 1], 10)
    before2 = np.where(rs > 1, pad[np.maximum(rs, 2) - 2], 10)
    out = []
    for k in range(min(MAX_GROUPS, len(rs))):
        a = np.flatnonzero(broken[k:] == broken[: len(broken) - k]) if k else np.arange(len(rs))
        a = a[a + k < len(rs)]
        total = upto[a + k + 1] - upto[a]
        a, total = a[(total >= 4) & (total <= 19)], total[(total >= 4) & (total <= 19)]
        n = [lens[a + i] for i in range(k + 1)]
        s = [sep[a + i] for i in range(k)]
        same = np.all([x == s[0] for x in s], axis=0) if k else np.ones(len(a), bool)
        no = np.zeros(len(a), bool)
        plus = before[a] == 43
        inner = lambda i: (n[i] >= 3) & (n[i] <= 4)
        card = ssn = ip4 = phone = pairs = no
        spaced = same & ((s[0] == 32) | (s[0] == 45)) if k else no
        if k == 0:
            card = total >= 13
        elif k == 1:
            phone = (n[0] >= 2) & (n[0] <= 4) & (n[1] >= 6) & (n[1] <= 8)
        elif k == 2:
            card = (n[0] == 4) & (n[1] == 6) & (n[2] == 5) & spaced
            ssn = (n[0] == 3) & (n[1] == 2) & (n[2] == 4) & same & (s[0] == 45) & ~np.isin(value[a], [0, 666]) & (value[a] < 900) & (value[a + 1] > 0) & (value[a + 2] > 0)
            phone = (n[0] >= 2) & (n[0] <= 4) & inner(1) & inner(2)
        elif k == 3:
            card = np.all([x == 4 for x in n], axis=0) & spaced
            ip4 = same & (s[0] == 46) & np.all([(lens[a + i] <= 3) & (value[a + i] < 256) for i in range(4)], axis=0)
            phone = (n[0] == 1) & inner(1) & inner(2) & inner(3)
        elif k == 4:
            card = np.all([x == 4 for x in n[:4]], axis=0) & (n[4] < 4) & spaced
            pairs = np.all([x == 2 for x in n], axis=0) & same & (s[0] != 47)
        if k:
            phone = phone & ~np.any([x == 47 for x in s], axis=0)
        intl = plus & (total >= 8) & (total <= 15) & ((n[0] <= 3) if k else ~no) & (np.all([(x >= 2) & (x <= 8) for x in n[1:]], axis=0) if k else ~no)
        some = card | ssn | ip4 | phone | pairs | intl
        a, total = a[some], total[some]
        if not len(a):
            continue
        closed = np.zeros(len(a), bool)
        for i in range(k):
            closed |= pad[re_[a + i]] == 41
        paren = (before[a] == 40) & closed
        start, end = rs[a] - (paren | plus[some]), re_[a + k]
        first = np.where(paren & (before2[a] == 43), start - 1, start)
        start = first
        x = np.zeros((len(a), len(FEATURES)), bool)
        for name, col in (("card", card), ("ssn", ssn), ("ip4", ip4), ("ip_ok", ip4), ("phone", phone & ~plus), ("pairs", pairs), ("plus", intl)):
            x[:, _INDEX[name]] = col[some]
        own = np.flatnonzero(card[some])
        if len(own):
            at = upto[a[own] + k + 1][:, None] - 1 - np.arange(19)[None]
            d = np.where(np.arange(19)[None] < total[own][:, None], flat[np.maximum(at, 0)], 0)
            d[:, 1::2] = d[:, 1::2] * 2 - 9 * (d[:, 1::2] > 4)
            valid = d.sum(1) % 10 == 0
            head = flat[np.minimum(upto[a[own]][:, None] + np.arange(4), len(flat) - 1)] @ np.array([1000, 100, 10, 1])
            x[own, _INDEX["luhn"]], x[own, _INDEX["no_luhn"]] = valid, ~valid
            x[own, _INDEX["issuer"]] = valid & (np.isin(head // 1000, [3, 4, 5, 6]) | (head >= 2221) & (head <= 2720))
        x[:, _INDEX["digits"]] = True
        b1, b2 = np.where(start > 0, pad[np.maximum(start, 1) - 1], 10), np.where(start > 1, pad[np.maximum(start, 2) - 2], 10)
        x[:, _INDEX["chained"]] = (b1 == 32) & (b2 >= 48) & (b2 < 58) | (pad[end] == 32) & (pad[end + 1] >= 48) & (pad[end + 1] < 58)
        out.append((start, end, x))
    if not out:
        return rs[:0], rs[:0], np.zeros((0, len(FEATURES)), bool)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _entropy(s: str) -> float:
    p = np.bincount(np.frombuffer(s.encode(), np.uint8))
    p = p[p > 0] / p.sum()
    return float(-(p * np.log2(p)).sum())


def _shape(s: str) -> list[str]:
    """Features of a span that isn't made of groups of digits."""
    out = []
    n_digits = sum(c.isdigit() for c in s)
    upper, lower = any(c.isupper() for c in s), any(c.islower() for c in s)
    out.append("digits" if n_digits else "no_digits")
    if upper and lower and any(b.isupper() and a.islower() for a, b in zip(s, s[1:], strict=False)) or n_digits and (upper or lower):
        out.append("mixed")
    if not n_digits and (upper != lower):
        out.append("one_case")
    if not s.isalnum():
        out.append("sign")
    if len(s) < 10:
        out.append("short")
    # names such as ModelConfigLoader, snake_case and dotted paths are made of words of one case
    pieces = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", s)
    if pieces and sum(len(x) for x in pieces if len(x) > 2 and x.isalpha()) >= 0.75 * len(s):
        out.append("wordy")
    if "://" in s or s.startswith(("www.", "/", "./", "$", "{", "<", "%", "http")) or s.count("/") > 1 and "wordy" in out or any(c in s for c in "([{"):
        out.append("urlish")
    if len(s) >= CODE_CHARS and _entropy(s) > 3.0:
        out.append("random")
    if _PREFIX.match(s):
        out.append("prefix")
    if 5 * len(_SWITCH.findall(s)) >= len(s):
        out.append("switches")
    return out


def _other_spans(text: str, codes: list[tuple[int, int]], hexes: list[tuple[int, int]], ats: list[int], cues: list[int]) -> dict[tuple[int, int], set[str]]:
    """Spans of all other classes and their features, but for those of what stands around them."""
    out: dict[tuple[int, int], set[str]] = {}

    def put(a: int, b: int, *names: str) -> None:
        out.setdefault((a, b), set()).update(names)

    for at in ats:
        lo, hi = at, at + 1
        while lo > 0 and at - lo < MAX_LOCAL and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
            lo -= 1
        while lo < at and not text[lo].isalnum():
            lo += 1
        while hi < len(text) and hi - at <= MAX_DOMAIN and (text[hi].isalnum() or text[hi] in ".-_"):
            hi += 1
        ends = [hi - len(text[at + 1 : hi]) + len(text[at + 1 : hi].rstrip(".-_"))]
        for _ in range(2):
            ends.append(text.rfind(".", at, ends[-1]))
        for e in ends:
            if lo < at < e and _EMAIL.fullmatch(text, lo, e):
                put(lo, e, "email")
    for a, b in codes:
        s = text[a:b].rstrip(".-/")
        pieces = [(a, a + len(s))]
        if any(c in s for c in "=./"):
            pieces += [(a + m.start(), a + m.end()) for m in re.finditer(r"[^=./]+", s)] + [(a + m.start(), a + m.end()) for m in re.finditer(r"[^=.]+={0,2}", s)]
        for x, y in set(pieces):
            s = text[x:y]
            if len(s) < CODE_CHARS:
                continue
            if _JWT.fullmatch(s):
                put(x, y, "jwt", "random")
            elif _HEX.fullmatch(s):
                put(x, y, "hex", *_shape(s))
            elif "." not in s and (names := _shape(s)) and "mixed" in names:
                put(x, y, "code", *names)
        for m in _IBAN.finditer(text, a, min(len(text), b + 48)):
            if m.start() < b and iban_sum(m[0]):
                put(*m.span(), "iban", "iban_sum", "digits")
    for a, b in hexes:
        s = text[a:b].rstrip(":") if not text[a:b].endswith("::") else text[a:b]
        if _ip(s):
            put(a, a + len(s), "ip6", "ip_ok")
    for c in cues:
        m = _VALUE.match(text, c)
        if m:
            s = m[1] if text[m.end() : m.end() + 1] in ('"', "'", "`") else m[1].rstrip(".)]}!?#")
            if 6 <= len(s) <= MAX_VALUE:
                put(m.start(1), m.start(1) + len(s), "keyed", *_shape(s))
    return out


def candidates(texts: list[str | None]) -> Spans:
    """Every span that can be an entity, in the order of texts, starts and ends."""
    cps, begin = common.code_points(texts)
    table = _classes()
    fold, _ = common._tables()
    start, end, x = _number_spans(cps)
    doc = np.searchsorted(begin, start, side="right") - 1
    # spans of the other classes, text by text, only where there is something of such a class
    cs, ce = _runs(table["code"][cps])
    keep = ce - cs >= 12
    cs, ce = cs[keep], ce[keep]
    if len(cs):
        count = lambda m: np.concatenate([[0], np.cumsum(m)])
        up, lo, di = (count(table[k][cps]) for k in ("upper", "lower", "digit"))
        diff = lambda c: c[ce] - c[cs]
        keep = (diff(di) > 0) & (diff(up) + diff(lo) > 0) | (diff(di) >= CODE_CHARS) | (diff(up) > 1) & (diff(lo) > 1)
        cs, ce = cs[keep], ce[keep]
    short = np.flatnonzero((cps[:-1] >= 65) & (cps[:-1] <= 90) & (cps[1:] >= 65) & (cps[1:] <= 90))  # "DE89 3704": groups apart
    short = short[(short + 4 < len(cps)) & (np.where(short > 0, fold[cps[np.maximum(short, 1) - 1]], 0) == 0)]
    short = short[table["digit"][cps[short + 2]] & table["digit"][cps[short + 3]] & (cps[short + 4] == 32)]
    cs, ce = np.concatenate([cs, short]), np.concatenate([ce, short + 4])
    hs, he = _runs(table["hexcolon"][cps])
    if len(hs):
        colon = np.concatenate([[0], np.cumsum(cps == 58)])
        keep = colon[he] - colon[hs] >= 2
        hs, he = hs[keep], he[keep]
    at = np.flatnonzero(cps == 64)
    by: dict[int, tuple[list, list, list]] = {}
    of = lambda p: (np.searchsorted(begin, p, side="right") - 1).tolist()
    for k, (s, e, d) in enumerate(((cs, ce, of(cs)), (hs, he, of(hs)), (at, at, of(at)))):
        for a, b, i in zip(s.tolist(), e.tolist(), d, strict=True):
            o = int(begin[i])
            by.setdefault(i, ([], [], []))[k].append(a - o if k == 2 else (a - o, b - o))
    more: list[tuple[int, int, set[str]]] = []
    secret, call = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        low = t.lower()
        found = (_CUE.finditer(low) if len(low) == len(t) else _CUE_I.finditer(t)) if low else ()
        cues, base = [], int(begin[i])
        for m in found:
            if m[1]:
                call.append(base + m.end())
            else:
                secret.append(base + m.end())
                cues.append(m.end())
        own = by.get(i, ([], [], []))
        if cues or any(own):
            more += [(base + a, base + b, f) for (a, b), f in _other_spans(t, *own, cues).items()]
        if "-----BEGIN " in t:
            more += [(base + m.start(), base + m.end(), {"armour"}) for m in _ARMOUR.finditer(t)]
    if more:
        start = np.concatenate([start, [m[0] for m in more]]).astype(np.int64)
        end = np.concatenate([end, [m[1] for m in more]]).astype(np.int64)
        rest = np.zeros((len(more), len(FEATURES)), bool)
        for r, m in enumerate(more):
            rest[r, [_INDEX[f] for f in m[2]]] = True
        x = np.concatenate([x, rest])
        doc = np.searchsorted(begin, start, side="right") - 1
    if not len(start):
        return Spans(doc, start, end, x)
    pad = np.concatenate([cps, np.full(3, 10, np.uint32)])
    b1, b2 = np.where(start > 0, pad[np.maximum(start, 1) - 1], 10), np.where(start > 1, pad[np.maximum(start, 2) - 2], 10)
    f1, f2 = pad[end], pad[end + 1]
    word, sign = lambda c: fold[c] != 0, lambda c, s: np.isin(c, [ord(z) for z in s])
    x[:, 0] = True
    x[:, _INDEX["glued"]] = word(b1) | word(f1) | sign(b1, "@_+") | sign(f1, "@_")
    x[:, _INDEX["dotted"]] = sign(b1, "./:-") & word(b2) | sign(f1, "./:-") & word(f2)
    x[:, _INDEX["money"]] = sign(b1, "$€£¥#") | sign(f1, "%€$£")
    for name, where in (("after_secret", secret), ("after_call", call)):
        where = np.array([-(10**9), *where])
        last = where[np.searchsorted(where, start, side="right") - 1]
        x[:, _INDEX[name]] = (start - last <= NEAR) & (last >= begin[doc])
    order = np.lexsort((end, start, doc))
    base = begin[doc[order]]
    return Spans(doc[order], start[order] - base, end[order] - base, x[order])


def best(start: list[int], end: list[int], score: list[float]) -> list[int]:
    """Which spans the segmentation with the highest score consists of; what is outside scores 0, spans of no gain are left out."""
    order = sorted((k for k in range(len(start)) if score[k] > 0), key=lambda k: end[k])
    ends, total, back = [-1], [0.0], [(-1, -1)]
    for k in order:
        before = bisect.bisect_right(ends, start[k]) - 1
        gain = total[before] + score[k]
        if gain > total[-1]:
            ends.append(end[k])
            total.append(gain)
            back.append((k, before))
    out, at = [], len(total) - 1
    while at > 0:
        k, at = back[at]
        out.append(k)
    return out[::-1]


def find(texts: list[str | None], weights: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """Entities of each text: start, end (characters) and type."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    c = candidates(texts)
    if not len(c.text):
        return out
    score = c.x.astype(np.float32) @ weights.T.astype(np.float32)
    kind, top = score.argmax(1), score.max(1)
    keep = top > 0
    doc, start, end, kind, top = c.text[keep], c.start[keep], c.end[keep], kind[keep], top[keep]
    first = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if lo < hi:
            s, e, k = start[lo:hi].tolist(), end[lo:hi].tolist(), kind[lo:hi].tolist()
            out[i] = [(s[j], e[j], TYPES[k[j]]) for j in best(s, e, top[lo:hi].tolist())]
    return out


def examples(n: int = 900, seed: int = 17) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sequences with their entities, from a seeded generator."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    digits = lambda k: pick("0123456789", k)
    low, up, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    letters = lambda a, b: pick(low, rng.randint(a, b))
    title = lambda a, b: letters(a, b).title()

    def card(valid: bool) -> str:
        amex = rng.random() < 0.2
        wrong_issuer = not valid and rng.random() < 0.3
        body = (rng.choice(["34", "37"]) if valid else rng.choice("01789") + digits(1)) + digits(12) if amex else rng.choice("3456" if valid else "01789" if wrong_issuer else "0123456789") + digits(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        s = body + (last if valid or wrong_issuer else str((int(last) + rng.randint(1, 9)) % 10))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join([s[:4], s[4:10], s[10:]] if amex else [s[k : k + 4] for k in range(0, 16, 4)])

    def iban() -> str:
        country, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), digits(rng.randint(14, 20))
        if country in ("GB", "NL"):
            body = pick(up, 4) + body[:10]
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return " ".join(s[k : k + 4] for k in range(0, len(s), 4)) if rng.random() < 0.4 else s

    def secret() -> str:
        kind = rng.randrange(7)
        if kind < 2:
            return pick(hexa, rng.choice([32, 40, 64]))
        if kind < 4:
            return pick(up + low + "0123456789", rng.randint(20, 48))
        if kind == 4:
            return rng.choice(["sk-", "ghp_", "xoxb-", "pk_live_", "AKIA"]) + pick(up + low + rng.choice(["", "0123456789"]), rng.randint(20, 36))
        if kind == 5:
            return f"eyJ{pick(up + low + '0123456789', rng.randint(12, 40))}.eyJ{pick(up + low + '0123456789-_', rng.randint(20, 300))}.{pick(up + low + '0123456789-_', 43)}"
        return f"-----BEGIN {rng.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{pick(up + low + '0123456789+/', 64)}\n{pick(up + low, 40)}\n-----END"

    word = lambda: letters(2, 9) + rng.choice(["", "", "", ",", "."])
    number = lambda: str(rng.randint(0, rng.choice([9, 99, 255])))
    password = lambda: rng.choice([lambda: title(4, 8) + rng.choice("!#@$_-") + digits(2) + letters(2, 4), lambda: letters(3, 7) + title(3, 6) + title(2, 8), lambda: letters(4, 8) + digits(rng.randint(2, 4)), lambda: pick(low + up + "0123456789!?#%&*", rng.randint(8, 16)), lambda: letters(4, 7) + digits(1) + rng.choice("!$") + title(3, 6)])()
    make = {
        "EMAIL": lambda: f"{letters(2, 8)}{rng.choice(['', '.', '_', '+', '-'])}{rng.choice([digits(2), letters(2, 6), 'ü' + letters(2, 4)])}@{letters(2, 6)}{rng.choice(['', digits(1), '-' + letters(2, 4)])}.{rng.choice(['example.', ''])}{rng.choice(['com', 'org', 'net', 'de', 'io'])}",
        "PHONE": lambda: rng.choice([f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{rng.randint(11, 99)}{digits(10)}", f"+{rng.randint(11, 99)} {digits(3)} {digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
        "CARD": lambda: card(True),
        "IP": lambda: rng.choice([".".join(number() for _ in range(4)), ".".join(number() for _ in range(4)), ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)), f"2001:db8::{pick(hexa, 3)}:{pick(hexa, 2)}"]),
        "SECRET": secret,
        "NATIONAL_ID": lambda: f"{rng.choice([rng.randint(100, 665), rng.randint(667, 899)])}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "IBAN": iban,
    }
    names = lambda k: "".join(title(3, 8) for _ in range(k))
    alike = [
        lambda: card(False), lambda: card(False), lambda: digits(rng.randint(1, 8)), lambda: digits(16)[:-1] + "x", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(1, 999)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"@{letters(3, 8)}", lambda: f"{letters(3, 8)}{digits(2)}", lambda: f"{rng.randint(256, 999)}.{number()}.{number()}.{number()}", lambda: f"v{number()}.{number()}.{number()}.{number()}",
        lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{digits(3)}-{digits(3)}", lambda: f"{letters(4, 8)}-{digits(3)}-{letters(4, 9)}-{letters(4, 9)}", lambda: digits(rng.randint(20, 30)),
        lambda: " ".join(digits(rng.randint(2, 4)) for _ in range(rng.randint(5, 12))), lambda: " ".join(digits(4) for _ in range(rng.randint(9, 25))), lambda: " ".join(digits(rng.randint(3, 7)) for _ in range(rng.randint(5, 12))), lambda: f"${digits(3)} {digits(3)} {digits(3)}", lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: names(rng.randint(3, 5)), lambda: "_".join(letters(3, 7) for _ in range(rng.randint(3, 5))) + rng.choice(["", digits(2)]), lambda: "/".join([letters(3, 6), digits(4), digits(2), "-".join(letters(3, 8) for _ in range(4))]) + ".html", lambda: f"https://www.{letters(4, 9)}.org/{names(2)}/{digits(4)}/{letters(4, 9)}?id={digits(5)}",
        lambda: f"{rng.choice(['key', 'token', 'secret', 'password', 'auth'])}: {rng.choice([letters(6, 11), 'required', 'string', 'optional', 'none given'])}", lambda: f"{rng.choice(['key', 'token', 'auth'])} = {letters(3, 8)}{rng.choice(['.', '_'])}{letters(3, 8)}{rng.choice(['', '()', '[0]'])}", lambda: f"{rng.choice(['key', 'token'])} = {names(2)}({letters(3, 5)})", lambda: f"password: {letters(3, 5)} {letters(6, 9)}", lambda: f"{title(5, 9)}-{title(5, 9)}-{title(4, 8)}",
    ]
    out = []
    for k in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(0, 4))) + rng.choice([" ", " ", "\n"])
            kind = TYPES[(k + len(spans)) % len(TYPES)]
            entity = rng.random() < 0.5
            keyed = entity and kind == "SECRET" and rng.random() < 0.4
            s = password() if keyed else make[kind]() if entity else rng.choice(alike)()
            lead = ""
            if keyed:
                lead = f"{rng.choice(['password', 'passwd', 'pwd', 'Password', 'secret', 'api_key'])}{rng.choice([': ', '=', ' = '])}"
            elif entity and kind == "SECRET" and rng.random() < 0.6 and s[0] != "-":
                lead = f"{rng.choice(['token', 'key', 'secret', 'Bearer', 'api_key', 'auth'])}{rng.choice([' = ', ': ', '=', ' '])}"
            elif kind == "PHONE" and rng.random() < 0.3 and entity:
                lead = f"{rng.choice(['phone', 'tel', 'call', 'mobile', 'fax'])} "
            quote = '"' if lead and rng.random() < 0.4 else ""
            if quote and kind == "SECRET" and lead.endswith(" ") and not lead.endswith(("= ", ": ")):
                quote = ""
            text += lead + quote
            if s.startswith("-----BEGIN"):
                s = s[:-8] + s[s.index("BEGIN") - 5 : s.index("\n")].replace("BEGIN", "END")
            if entity:
                spans.append((len(text), len(text) + len(s), kind))
            text += s + quote + rng.choice(["", "", ".", ",", "!!", "###"]) + " "
        out.append((text, spans))
    return out


@lru_cache(2)
def fit(n: int = 900, rounds: int = 80, seed: int = 17, ridge: float = 0.02) -> np.ndarray:
    """Weights (types x features) of maximum penalised likelihood."""
    made = examples(n, seed)
    c = candidates([t for t, _ in made])
    first = np.searchsorted(c.text, np.arange(len(made) + 1))
    data, own, rows = [], [], []
    for i, (_, gold) in enumerate(made):
        lo, hi = int(first[i]), int(first[i + 1])
        at = {(a, b): k for k, (a, b) in enumerate(zip(c.start[lo:hi].tolist(), c.end[lo:hi].tolist(), strict=True))}
        if all((a, b) in at for a, b, _ in gold) and lo < hi:
            points = sorted({x for ab in at for x in ab})
            place = {x: k for k, x in enumerate(points)}
            data.append((len(points), [(place[a], place[b]) for a, b in at]))
            own += [(len(rows) + at[a, b], TYPES.index(t)) for a, b, t in gold]
            rows += range(lo, hi)
    x = c.x[rows].astype(float)
    cut = np.concatenate([[0], np.cumsum([len(s) for _, s in data])]).astype(int).tolist()
    observed = np.zeros((len(TYPES), len(FEATURES)))
    for r, t in own:
        observed[t] += x[r]
    weights, rate = np.zeros_like(observed), np.zeros_like(observed)
    weights[:, 0] = -1.0
    for _ in range(rounds):
        scores = x @ weights.T
        total = np.logaddexp.reduce(scores, axis=1)
        share = np.zeros(len(x))
        for d, (n_points, segs) in enumerate(data):
            alpha, beta = [0.0] * n_points, [0.0] * n_points
            ends: dict[int, list[tuple[int, float]]] = {}
            starts: dict[int, list[tuple[int, float]]] = {}
            some = total[cut[d] : cut[d + 1]].tolist()
            for (i, j), s in zip(segs, some, strict=True):
                ends.setdefault(j, []).append((i, s))
                starts.setdefault(i, []).append((j, s))
            for j in range(1, n_points):
                alpha[j] = _lse([alpha[j - 1], *(alpha[i] + s for i, s in ends.get(j, ()))])
            for i in range(n_points - 2, -1, -1):
                beta[i] = _lse([beta[i + 1], *(beta[j] + s for j, s in starts.get(i, ()))])
            z = alpha[-1]
            share[cut[d] : cut[d + 1]] = [math.exp(min(0.0, alpha[i] + s + beta[j] - z)) for (i, j), s in zip(segs, some, strict=True)]
        expected = (np.exp(scores - total[:, None]) * share[:, None]).T @ x
        grad = observed - expected - ridge * weights
        rate += grad * grad
        weights = weights + 0.7 * grad / np.sqrt(rate + 1e-6)
    return weights


def _lse(v: list[float]) -> float:
    if len(v) == 1:
        return v[0]
    m = max(v)
    return m + math.log(sum(math.exp(x - m) for x in v))


def redact(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_entities, text with entities overwritten, and entities (start, end and type in the text as it was)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit() if weights is None else weights)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [x for lo, hi in common.slices(texts) for x in find(texts[lo:hi], shared.value)]
            clean = []
            for t, spans in zip(texts, found, strict=True):
                if spans:
                    parts, at = [], 0
                    for x, y, name in spans:
                        parts += [t[at:x], f"[{name}]"]
                        at = y
                    t = "".join([*parts, t[at:]])
                clean.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array(clean, pa.string()), pa.array([[{"start": x, "end": y, "type": n} for x, y, n in s] for s in found], kind)], names=["doc_id", "n_entities", "text", "entities"])

    d = common.project(docs, ["doc_id", "text"], {"doc_id": "bigint"})
    return d.mapInArrow(run, "doc_id bigint, n_entities int, text string, entities array<struct<start: int, end: int, type: string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(common.table(spark, sf_dir, "documents"))
