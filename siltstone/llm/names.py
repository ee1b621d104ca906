"""Names of persons and organisations: parsing and compatibility."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from .strings import alike, edits, fold, unscan

# --- fixed values ---------------------------------------------------------
TITLES = frozenset("mr mrs ms miss dr prof sri shri smt sir madam kumari thiru messrs the".split())
PARTICLES = frozenset("bin al el van der den de la von da di del dos ibn".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
LEGAL = frozenset("limited ltd private pvt p gmbh incorporated inc company co sons son and n llp llc corp corporation plc gesellschaft mit beschrankter haftung mbh ag branch ho bros brothers".split())
TRADES = (
    "agencies", "associates", "bakery", "electronics", "enterprises", "foods", "furnishings", "garments", "hardware", "industries",
    "jewellers", "logistics", "motors", "optics", "pharmacy", "stationers", "textiles", "traders",
)
TRADE_SHORT = {"hdwe": "hardware", "entp": "enterprises", "inds": "industries", "agcs": "agencies", "gmts": "garments", "txtls": "textiles", "logis": "logistics", "pharma": "pharmacy", "assoc": "associates", "elecs": "electronics", "mtrs": "motors", "trdrs": "traders"}
# --------------------------------------------------------------------------
#: How far two names agree: one person or firm; may be one (an initial, a single word, a generation on one side); share a word; nothing.
STRONG, WEAK, SHARED, NONE = 3, 2, 1, 0


class Name(NamedTuple):
    tokens: tuple[str, ...]  # given and family names, or the core words of an organisation
    trade: str  # line of business, "" for persons
    generation: str
    joined: str


def _trade(t: str) -> str | None:
    if t in TRADE_SHORT:
        return TRADE_SHORT[t]
    if len(t) >= 4:
        for w in TRADES:
            if t == w or (len(t) > 4 and edits(t, w, 2) <= 2 and t[0] == w[0]):
                return w
    if 2 < len(t) < 7:
        for w in TRADES:  # an abbreviation keeps the first letter and the order of the rest
            if t[0] == w[0] and t[-1] in w[2:] and not set(t) & set("aeiou") and _within(t, w):
                return w
    return None


def _within(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


@lru_cache(maxsize=100_000)
def parse(raw: str) -> Name:
    s = fold(raw)
    s = re.sub(r"\(p\)", " pvt ", s)
    s = re.sub(r"[\(\[\{][^)\]}]*[\)\]\}]?", " ", s)
    s = re.sub(r"\bm\s*/\s*s\b\.?|'s\b|\bc/o\b", " ", s)
    s = re.sub(r"(?<=\w)'(?=\w)", "", s)
    words = [unscan(w) if any(c.isalpha() for c in w) else w for w in re.findall(r"[^\W_]+", s)]
    generation, legal, trade, tokens = "", False, "", []
    for k, w in enumerate(words):
        if w in GENERATIONS and k:
            generation = GENERATIONS[w]
        elif w in TITLES:
            pass
        elif w in LEGAL and len(w) > 1:
            legal = True
        else:
            tokens.append(w)
    firm = legal and len(words) > 1
    if len(tokens) > 1:
        for w in tokens:
            if (t := _trade(w)) and (firm or w == t or w in TRADE_SHORT):
                trade = t
                tokens.remove(w)
                break
    if trade or firm:
        tokens = [w for w in tokens if len(w) > 1] or tokens
    return Name(tuple(tokens), trade or ("firm" if firm else ""), generation, "".join(tokens))


def _short(a: str, full: str) -> bool:
    return alike(a, full) or (3 <= len(a) <= 5 and full.startswith(a))


class Nicknames:
    """Given names a short form may stand for; the list is small and need not be complete."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        self.of: dict[str, frozenset[str]] = {}
        full: dict[str, set[str]] = {}
        for given, nick in pairs:
            if given and nick:
                full.setdefault(fold(nick), {fold(nick)}).add(fold(given))
        self.of = {k: frozenset(v) for k, v in full.items()}

    def written_out(self, token: str) -> str:
        """The first given name, by the alphabet, that ``token`` is short for; itself where it is none."""
        return min((g for g in self.of.get(token, ()) if g != token), default=token)

    def same(self, a: str, b: str) -> bool:
        x, y = self.of.get(a), self.of.get(b)
        if x and y:
            return bool(x & y)
        return bool(x and any(_short(b, v) for v in x) or y and any(_short(a, v) for v in y))


    def initial(self, letter: str, nick: str) -> bool:
        return any(g[:1] == letter for g in self.of.get(nick, ()))


# --- fixed values: short forms in wide use --------------------------------
COMMON = (("mohammed", "mohd"), ("mohammed", "md"), ("johannes", "hans"), ("heinrich", "heinz"), ("gabriella", "gaby"), ("jose", "pepe"), ("stephen", "steve"), ("alexander", "alex"), ("thomas", "tom"), ("christopher", "chris"), ("natalia", "nata"), ("isabella", "isa"), ("francisco", "pancho"), ("guillermo", "memo"), ("balasubramanian", "bala"), ("gopalakrishnan", "gopal"), ("friedrich", "fritz"), ("wilhelmina", "willy"), ("robert", "bobby"), ("patricia", "trish"), ("theodora", "thea"), ("elizabeth", "betty"), ("margaret", "peggy"), ("thomas", "tommy"), ("stephen", "stevie"), ("nicholas", "nico"))
# --------------------------------------------------------------------------


def _token(a: str, b: str, nick: Nicknames) -> float:
    """1 for the same word, 0.9 for a misspelt or short form, 0.5 for an initial, 0 otherwise."""
    if a == b:
        return 0.5 if len(a) == 1 else 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.5 if b[0] == a or nick.initial(a, b) else 0.0
    if nick.same(a, b):
        return 0.9
    if 3 <= len(a) <= len(b) - 2 and b.startswith(a) and len(a) <= 5:
        return 0.85
    return 0.9 if alike(a, b) else 0.0


def _as_firm(x: Name, firm: Name) -> Name:
    """``x`` with a misspelt line of business taken off, where ``firm`` names that line."""
    if x.trade or not firm.trade or len(x.tokens) < 2:
        return x
    for t in x.tokens:
        if alike(t, firm.trade) or TRADE_SHORT.get(t) == firm.trade:
            rest = tuple(w for w in x.tokens if w != t)
            return x._replace(tokens=rest, trade=firm.trade, joined="".join(rest))
    return x._replace(trade="firm") if firm.trade == "firm" else x


def _split(x: Name, y: Name, nick: Nicknames) -> Name:
    """``x`` with its only word cut in two where it is the names of ``y`` written together."""
    if len(x.tokens) != 1 or len(y.tokens) < 2 or len(x.joined) < 7:
        return x
    s = x.joined
    for t in y.tokens:
        for k in (len(t), len(t) - 1, len(t) + 1) if len(t) > 3 else ():
            if 2 <= k <= len(s) - 2:
                if alike(s[:k], t) and (k == len(t) or s[:2] == t[:2]):
                    return x._replace(tokens=(s[:k], s[k:]))
                if alike(s[-k:], t):
                    return x._replace(tokens=(s[:-k], s[-k:]))
    return x


def compatible(x: Name, y: Name, nick: Nicknames) -> int:
    """STRONG, WEAK, SHARED or NONE."""
    if not x.tokens or not y.tokens:
        return NONE
    if bool(x.trade) != bool(y.trade):
        x, y = _as_firm(x, y), _as_firm(y, x)
        if bool(x.trade) != bool(y.trade):
            return NONE
    level = STRONG
    if x.generation != y.generation:
        if x.generation and y.generation:
            return NONE
        level = SHARED  # father and son as likely as a suffix left out
    if x.trade and x.trade != y.trade and "firm" not in (x.trade, y.trade):
        return NONE
    if x.joined == y.joined:
        return level if x.trade or len(x.tokens) > 1 or len(y.tokens) > 1 else min(level, WEAK)
    if not x.trade:
        x, y = _split(x, y, nick), _split(y, x, nick)
    a = [t for t in x.tokens if t not in PARTICLES] or list(x.tokens)
    b = [t for t in y.tokens if t not in PARTICLES] or list(y.tokens)
    if len(a) > len(b):
        a, b = b, a
    scores = sorted(((s, i, j) for i, t in enumerate(a) for j, u in enumerate(b) if (s := _token(t, u, nick))), reverse=True)
    used_a: dict[int, float] = {}
    used_b: set[int] = set()
    for s, i, j in scores:
        if i not in used_a and j not in used_b:
            used_a[i] = s
            used_b.add(j)
    full = [s for s in used_a.values() if s > 0.5]
    if not any(s >= 0.9 and len(a[i]) > 2 for i, s in used_a.items()):
        return NONE
    if len(used_a) < len(a):
        return SHARED
    if x.trade:
        return level
    if len(full) >= 2:
        return level
    return min(level, WEAK)
