"""Postal addresses: parsing free text of any order into town, street, house and unit."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from .strings import edits, fold, unscan

# --- fixed values ---------------------------------------------------------
TYPES = {
    "marg": "marg", "mg": "marg", "street": "street", "st": "street", "str": "street", "road": "road", "rd": "road", "avenue": "avenue", "ave": "avenue", "av": "avenue", "avn": "avenue",
    "drive": "drive", "drv": "drive", "dr": "drive", "lane": "lane", "ln": "lane", "la": "lane", "terrace": "terrace", "terr": "terrace", "ter": "terrace", "square": "square", "sq": "square",
    "sqr": "square", "cross": "cross", "crs": "cross", "x": "cross", "boulevard": "boulevard", "boul": "boulevard", "blvd": "boulevard", "nagar": "nagar", "ngr": "nagar", "way": "way", "close": "close", "court": "court", "place": "place", "pl": "place",
}
DIRECTIONS = {"n": "n", "s": "s", "e": "e", "w": "w", "north": "n", "south": "s", "east": "e", "west": "w"}
ORDINALS = {w: k for k, (a, b) in enumerate((("first", "1st"), ("second", "2nd"), ("third", "3rd"), ("fourth", "4th"), ("fifth", "5th"), ("sixth", "6th"), ("seventh", "7th"), ("eighth", "8th"), ("ninth", "9th"), ("tenth", "10th")), 1) for w in (a, b)}
AREAS = frozenset("park quarter colony".split())
LANDMARK = re.compile(r"\b(?:near|nr|next to|behind|opp|opposite|above|beside|adjacent to|c/o|care of)\b\.?\s*(?:the\s+)?(?:(?:old|new)\s+)?(?:bus stand|railway gate|water tank|[a-z]+)")
# --------------------------------------------------------------------------
_POSTAL = re.compile(r"(?<![\d/#])(\d{3})\s?(\d{3})(?![\d/])")
_UNIT = re.compile(r"\b(?:flat|flt|apartment|apartm|apt|unit|suite)\b[.\s]*(?:no\b)?[.\s#]*(\d+)\s?-?([a-z]?)(?![a-z\d.])")
_SLASH = re.compile(r"(?<!\d)(\d+)\s?-?([a-z]?)\s?/\s?(\d+)([a-z]?)(?![a-z\d.])")
_HOUSE = re.compile(r"(#|\b(?:h\s?\.?\s?no|door\s?no|house\s?no|no)\b\.?\s*#?)?\s*(?<![\w])(\d+)(?:([a-z])(?![a-z\d])|[\s-]+([a-d])(?![a-z\d.]))?(?![\d]|st\b|nd\b|rd\b|th\b)")
_WORD = re.compile(r"[a-z]+|\d+(?:st|nd|rd|th)\b|\d+|[,;]")


class Address(NamedTuple):
    house: str
    unit: str
    direction: str
    ordinal: int
    core: str  # name of the street without its kind
    kind: str
    town: str  # city id, or the folded last words where the list has no such town
    area: str


class Gazetteer:
    """Towns by name, second name and postal prefix."""

    def __init__(self, cities: Iterable[tuple[int, str, str | None, str | None]], regions: Iterable[str] = ()):
        self.names: dict[str, str] = {}
        self.prefix: dict[str, str] = {}
        for cid, city, prefix, other in sorted(cities, key=lambda r: -r[0]):
            for n in (other, city):
                if n:
                    self.names[fold(n)] = str(cid)
            if prefix:
                self.prefix[prefix] = str(cid)
        self.joined = {n.replace(" ", ""): c for n, c in self.names.items()}
        self.regions = {fold(r) for r in regions if r}
        self._fuzzy: dict[tuple[str, int], list[str]] = {}
        for n in self.joined:
            self._fuzzy.setdefault((n[:1], len(n)), []).append(n)

    @lru_cache(maxsize=100_000)
    def near(self, word: str) -> str | None:
        """The only town within one error (two in names of nine letters and more); None if there is none or several."""
        if len(word) < 5:
            return None
        for most in (1, 2) if len(word) >= 9 else (1,):
            hits = {self.joined[n] for n in self.joined if abs(len(n) - len(word)) <= most and edits(word, n, most) <= most}
            if hits:
                return hits.pop() if len(hits) == 1 else None
        return None


def parse(raw: str, towns: Gazetteer) -> Address:
    s = " " + LANDMARK.sub(" , ", fold(raw)) + " "
    s = re.sub(r"\(\s*([nsew])\s*\)", r" \1 ", s)
    unit = house = ""
    if m := _UNIT.search(s):
        unit, s = m[1].lstrip("0") + m[2], s[: m.start()] + " , " + s[m.end() :]
    if m := _SLASH.search(s):
        house, unit, s = m[1].lstrip("0") + m[2], unit or m[3].lstrip("0") + m[4], s[: m.start()] + " 0 " + s[m.end() :]
    postal = ""
    codes = list(_POSTAL.finditer(s))
    m = next((m for m in reversed(codes) if m[1] in towns.prefix), codes[-1] if codes else None)
    if m:
        postal, s = m[1] + m[2], s[: m.start()] + " , " + s[m.end() :]
    found = [(m[1] or "", m[2].lstrip("0") + (m[3] or m[4] or ""), m.span()) for m in _HOUSE.finditer(s)] if not house else []
    if len(found) > 1 and not unit:
        k = next((k for k, (mark, _, _) in enumerate(found) if mark.strip() == "#"), -1)
        if k >= 0:
            unit = found[k][1]
            a, b = found[k][2]
            s = s[:a] + "," + " " * (b - a - 1) + s[b:]
            found.pop(k)
    if found:
        k = next((k for k, (mark, _, _) in enumerate(found) if mark), 0)
        house, (a, b) = found[k][1], found[k][2]
        s = s[:a] + " 0 " + s[b:]
    words = _WORD.findall(s)

    town, used = "", set()
    plain = [w for w in words]
    for size in (3, 2, 1):
        for i in range(len(plain) - size, -1, -1):
            if not town and (t := towns.names.get(" ".join(plain[i : i + size]))):
                if i and size == 1 and i + 1 < len(plain) and plain[i + 1] in TYPES:
                    continue
                town, used = t, set(range(i, i + size))
    if not town and postal[:3] in towns.prefix:
        town = towns.prefix[postal[:3]]
    kept = [(",", -1) if i in used else (w, i) for i, w in enumerate(words)]

    kinds = [i for i, (w, _) in enumerate(kept) if w in TYPES and i and kept[i - 1][0] not in ",;0"]
    core = kind = direction = ""
    ordinal, at = 0, -1
    zero = next((i for i, (w, _) in enumerate(kept) if w == "0"), -1)
    if kinds:
        at = min(kinds, key=lambda i: (kept[i][0] in "x" and len(kinds) > 1, abs(i - zero) if zero >= 0 else i))
        kind, lo = TYPES[kept[at][0]], at - 1
        while lo >= 0 and kept[lo][0] not in ",;0":
            lo -= 1
        street, hi = [kept[i][0] for i in range(lo + 1, at)], at + 1
        if hi < len(kept) and kept[hi][0] in DIRECTIONS:
            direction = DIRECTIONS[kept[hi][0]]
    else:
        if zero >= 0 and zero + 1 < len(kept) and (kept[zero + 1][0] not in ",;" or zero == 0 or kept[zero - 1][0] in ",;"):
            lo = zero + 1
            while lo < len(kept) and kept[lo][0] in ",;":
                lo += 1
            hi = lo
            while hi < len(kept) and kept[hi][0] not in ",;":
                hi += 1
        else:
            lo = hi = zero if zero > 0 else 0
            while lo > 0 and kept[lo - 1][0] not in ",;":
                lo -= 1
        street = [kept[i][0] for i in range(lo, hi)]
        at = hi - 1
    rest = []
    for w in street:
        if w in ORDINALS:
            ordinal = ORDINALS[w]
        elif w in DIRECTIONS:
            direction = DIRECTIONS[w]
        elif w not in ("no", "door", "h"):
            rest.append(unscan(w))
    if not kinds and len(rest) > 1:
        rest = rest[:1]  # without a kind or a comma, the first word names the street
    core = "".join(rest[-2:]) if len(rest) > 1 and len(rest[-1]) < 3 else rest[-1] if rest else ""
    others = [w for i, (w, _) in enumerate(kept) if i > at and w not in ",;0" and w not in DIRECTIONS and len(w) > 2 and w not in towns.regions or i < at - len(street) and len(w) > 2]
    if not town:
        for i in range(len(words)):
            for size in (1, 2):
                if not town and (i not in range(at - len(street), at + 1)) and (t := towns.near("".join(words[i : i + size]).replace(",", ""))):
                    town = t
    area = next((others[i - 1] for i, w in enumerate(others) if w in AREAS and i), "")
    if not town:
        left = [w for w in others if w not in AREAS and w != area and not w.isdigit()]
        town = "?" + (postal or (left[-1] if left else ""))
    return Address(house, unit, direction, ordinal, core, kind, town, area)


def same_street(a: str, b: str) -> bool:
    """Two errors in a name of six letters or more, one in a shorter one."""
    return edits(a, b, 2) <= (2 if min(len(a), len(b)) > 5 else 1)


def same_place(a: Address, b: Address) -> bool:
    """Same town, street, house and unit; parts only one of them names do not speak against it."""
    if not a.house or a.house != b.house or a.unit != b.unit or a.town != b.town:
        return False
    if a.direction != b.direction or a.ordinal != b.ordinal or (a.kind != b.kind and a.kind and b.kind):
        return False
    return bool(a.core) and bool(b.core) and same_street(a.core, b.core)
