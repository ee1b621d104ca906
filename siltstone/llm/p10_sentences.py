"""Problem 10: sentence boundaries across languages and scripts.

A text is cut at blank lines; headings, greetings, closings, signatures, labelled lines and list entries are units of their own, the
other lines of a paragraph run on. In a paragraph every run of stops is a position to decide: the tables of its language are gone
through in order, each row a pair of regular expressions for the text before and after, and the first row that matches says break
or no break. Rows of all languages that share a script come first, then those of the language found in the text itself
(``lang`` is not looked at: it is often wrong). Stops within a quotation or brackets never break; what follows a quotation decides
whether the words around it belong to it.

Defined cases: null, empty and blank texts give no rows; repeated texts give rows in each document; positions are code points;
a last sentence needs no stop; texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

B, N = True, False  # break, no break

# --- fixed values: segmentation rules -------------------------------------
#: Abbreviations that never end a sentence.
NEVER = {
    "en": r"rs mr mrs ms dr prof rev capt gen hon lt col sgt messrs st asst mgr pvt approx cf fig figs sec para vs viz e\.g i\.e incl excl ca pp art vol ext extn nos",
    "de": r"dr prof hr fr fam nr abs hs z\.?\s?b d\.?\s?h u\.?\s?a ca bzw inkl exkl zzgl ggf evtl vgl bd tel geb str \p{L}+str pl hbf st",
    "fr": r"dr mm mme mlle mmes pr me av bd bât tél p\.?\s?ex c\.?-à-d env réf art éd boul st ste",
    "es": r"sr sra srta dr dra sres sras avda núm nº n\.º p\.?\s?ej dña tel pág págs art incl prof gral ud uds",
}
#: Abbreviations that end a sentence only if the next one visibly begins.
MAYBE = r"etc a\.?\s?m p\.?\s?m u\.s e\.u u\.k inc ltd co corp jr sr ave rd blvd in tax min max pcs ret dept jan feb mar apr jun jul aug sept sep oct nov dec no cie usw mwst u\.s\.w izq dcha h bldg apt est lbs oz ft hrs cm kg km reg"
#: Words that report speech after a quotation.
REPORT = r"asked|said|wrote|shouted|replied|answered|called|added|cried|noted|explained|whispered|fragte|sagte|schrieb|rief|antwortete|demanda|dit|écrit|répondit|dijo|preguntó|escribió|respondió"
OPEN, CLOSE = "\"'“„«「『‘‹", "\"'”“»」』’›"
_SP = r"[\s​﻿]"
THAI = "บะา"  # last letters of the particles
ALL = ".!?…。．！？।॥|؟" + THAI


def _alt(words: str) -> str:
    """Alternation of ``words`` (plain or patterns) by their last letters: what is read backwards fails at the first one."""
    plain: dict[str, list[str]] = {}
    rest = []
    for w in words.split(" "):
        if w.isalpha():
            plain.setdefault(w[-1], []).append(w[:-1])
        else:
            rest.append(w)
    return "|".join([*(f"(?:{'|'.join(heads)}){last}" for last, heads in plain.items()), *rest])


#: Rows for every text: (break?, last characters of the stop, the text before the position, the text after it).
COMMON = (
    (N, ".…", r"", rf"{_SP}*[,;:،؛、，]"),
    (N, ".", r"", r"[\w@/-]*\d"),
)
#: Rows that ask for a character of a script before the stop, or that end in one.
SCRIPTS = (
    # East Asian stops break whatever follows; an ellipsis between them doesn't
    (B, "。．！？", r"", r""),
    (N, "…", r"[\p{Han}\p{Hiragana}\p{Katakana}\d]…+", r""),
    # Devanagari
    (B, "।॥|", r"", r""),
    (N, ".", r"(?<![\p{L}\p{M}])[\p{Devanagari}]{1,4}(?:\.[\p{Devanagari}]{1,4})*\.", r""),
    # Thai writes no stops: polite particles before a blank end a sentence
    (B, THAI, r"(?:^|[\p{Thai}\s])(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า)", rf"{_SP}"),
    (N, ALL, r"[\p{Thai}]\.?", r""),
    # one-letter abbreviations
    (N, ".", r"(?<![\p{L}\p{N}])(?:\p{Arabic}\.)+", r""),
    (B, "؟", r"", r""),
    (B, ".!…", r"\p{Arabic}[.!…]+", rf"{_SP}"),
)
LATIN = (
    # what is drawn out goes on in lower case
    (N, ".…", r"(?:\.{2,}|…)", rf"{_SP}+\p{{Ll}}"),
    (B, ".…", r"(?:\.{2,}|…)", rf"{_SP}"),
    (B, "!?.…", r"[!?]+[.!?…]*", rf"{_SP}"),
    (B, "!?", r"\p{L}{2}[!?]+", r"\p{Lu}\p{Ll}"),
    (N, ".", rf"(?<![\p{{L}}\p{{N}}])(?i:{_alt(MAYBE)})\.", rf"{_SP}+(?:\p{{Ll}}|\d|&|\()"),
    (N, ".", r"(?<![\p{L}\p{N}])Co\.", rf"{_SP}+(?:Ltd|KG|Inc)\b"),
    (N, ".", r"(?<![\p{L}\p{N}])(?i:no)\.", rf"{_SP}+\d"),
    (B, ".", rf"(?<![\p{{L}}\p{{N}}])(?i:{_alt(MAYBE)})\.", rf"{_SP}"),
    (N, ".", r"(?<![\p{L}\p{N}'’])\p{L}\.", r""),
    (N, ".", r"(?<![\p{L}\p{N}])(?:\p{L}\.){2,}", rf"{_SP}+\p{{Ll}}"),
    (B, ".", r"", rf"{_SP}"),
    (B, ".", r"\p{Ll}{2}[\)\]]?\.", r"\p{Lu}\p{Ll}"),
    (B, ".", r"\p{Ll}{3}\.", r"\p{Lu}\s"),
    (B, ".", r"\)\.", r"\p{Lu}"),
    (B, ".", r"\p{Ll}{2}\.", r"[\"“«„]\p{Lu}"),
)
BY_LANGUAGE = {
    "en": ((N, ".", r"(?<![\p{L}\p{N}])(?:min|max)\.", rf"{_SP}"),),
    "de": ((N, ".", r"(?<![\p{L}\p{N}.,])\d{1,2}\.", rf"{_SP}+\p{{L}}"),),
    "fr": (),
    "es": ((N, ".", r"\d\.[ºª]", r""),),
}
STOPWORDS = {
    "en": "the and is of to in for was at from but with this",
    "de": "der die das und ist nicht wir sie im am mit den wurde hat",
    "fr": "le la les est une des et du depuis un qui au il",
    "es": "el la los las es una del por en de vive desde se",
}
GREETING = r"(?i:dear|hello|hi|hey|good (?:morning|afternoon|evening)|to whom|sehr geehrte[rs]?|liebe[rs]?|hallo|guten (?:tag|morgen)|bonjour|bonsoir|ch[eè]re?s?|madame|monsieur|estimad[oa]s?|querid[oa]s?|hola|buen[oa]s (?:días|tardes)|नमस्ते|प्रिय|尊敬的|您好|你好|拝啓|เรียน|สวัสดี|عزيزي|السيد|مرحبا)\b[^.!?。！？।]*[,،，:!]?|[^.!?。！？।、，,\s]+様[、,]?"
CLOSING = r"(?i:(?:yours|kind|best|warm|with)?\s*(?:sincerely|regards|faithfully|truly|wishes|thanks)(?: yours)?|mit freundlichen grüßen|viele grüße|beste grüße|cordialement|bien à vous|salutations[^.,]*|atentamente|saludos(?: cordiales)?|un saludo|धन्यवाद|भवदीय|此致|敬礼|敬具|ขอแสดงความนับถือ|مع التحية|مع أطيب التحيات|thank you|thanks),?"
LABELS = r"(?i:name|phone|telephone|e-?mail|address|date of birth|dob|organi[sz]ation|company|id number|id|total amount|amount|city|postal code|date|subject|from|to|customer|store|item|status)"
# --------------------------------------------------------------------------
_LIST = re.compile(r"[ \t]*(?:[-*•–‣·]|\d{1,3}[.)])[ \t ]+\S")
_LABEL = re.compile(r"[ \t]*(\p{Lu}[\p{L} .'/-]{0,30}?)[ \t]*[:：][ \t]")
_KNOWN = re.compile(rf"[ \t]*{LABELS}[ \t]*[:：]")
_GREET = re.compile(rf"[ \t]*(?:{GREETING})[ \t]*")
_CLOSING = re.compile(rf"[ \t]*(?:{CLOSING})[ \t]*")
_STOP = re.compile(r"[.!?…。．！？।॥؟]+|(?<=\p{Devanagari}\s?)\||(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า)(?=[\s​﻿])")
_LINE = re.compile(r"\r\n|[\r\n  \u0085\x0b\x0c]")
_RUNS_ON = re.compile(r"[\p{Ll},;]\s*$")
_ENDS = re.compile(r"[.!?…。．！？।॥؟|:][\"'”“»」』’)\]]*\s*$|(?:ครับ|ค่ะ|คะ)\s*$")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‘": "’"}
_MARKS = re.compile(r"[\"“”„«»「」『』()（）\[\]]|(?<![\w.!?,;])'(?=\w)|(?<=[\w.!?,…])'(?!\w)|‘|(?<=[.!?,…])’")
_QUOTED = {"\"", "'", "“", "„", "«", "「", "『", "‘"}


def _never(lang: str) -> tuple:
    rest = " ".join(v for k, v in NEVER.items() if k != lang)
    return (
        (N, ".", rf"(?<![\p{{L}}\p{{N}}])(?i:{_alt(NEVER[lang])})\.", rf"{_SP}*[\S]"),
        (N, ".", rf"(?<![\p{{L}}\p{{N}}])(?i:{_alt(rest)})\.", rf"{_SP}*[\p{{Ll}}\d]"),
    )


def _compile(rows: tuple) -> dict[str, tuple[object, tuple[bool, ...]]]:
    """By last character of the stop: one pattern, to be matched just after the stop, and what its rows decide.

    The rows are its alternatives in their order, each with an empty group of its own, so the number of the group that
    matched is the first row that fits.
    """
    out = {}
    for c in ALL:
        mine = [(b, before, after) for b, stops, before, after in rows if c in stops]
        row = [(rf"(?<={before})" if before else "") + rf"[)\]）]*+(?:{after})()" for _, before, after in mine]
        out[c] = (re.compile("|".join(row) or r"(?!)"), tuple(b for b, _, _ in mine))
    return out


#: By language: the rows for any text, and those that can match a full stop after an ASCII character.
TABLES = {lang: (_compile((*COMMON, *SCRIPTS, *_never(lang), *BY_LANGUAGE[lang], *LATIN)), _compile((*COMMON, *_never(lang), *BY_LANGUAGE[lang], *LATIN))["."]) for lang in NEVER}
_STOPWORD = {w: [k for k, v in STOPWORDS.items() if w in v.split(" ")] for v in STOPWORDS.values() for w in v.split(" ")}
_LATIN_LETTERS = re.compile(r"\p{Latin}")


def language(text: str) -> str:
    """Table of the Latin rules that fits the words of ``text`` best; English where there are none."""
    hits = dict.fromkeys(STOPWORDS, 0)
    for w, n in Counter(text.lower().split()).items():
        for k in _STOPWORD.get(w, ()):
            hits[k] += n
    return max(hits, key=hits.get)


def _quotes(s: str) -> list[tuple[int, int, bool]]:
    """(opening, closing, quotation?) of the outer quotations and brackets; marks without a partner are left out.

    A closing mark ends the latest opening it fits, and what was opened after that is dropped. The openings are kept by
    the marks that close them, so a text of nothing but marks takes linear time as well.
    """
    out: list[tuple[int, int, bool]] = []
    stack: list[tuple[int, bool]] = []
    by: dict[str, list[tuple[int, int]]] = {}  # closing mark -> (place in the stack, position) of its openings
    for m in _MARKS.finditer(s):
        c, i = m[0], m.start()
        mine = by.get(c)
        while mine and (mine[-1][0] >= len(stack) or stack[mine[-1][0]][0] != mine[-1][1]):
            mine.pop()  # dropped with an outer pair
        if mine:
            at, a = mine.pop()
            out.append((a, i, stack[at][1]))
            del stack[at:]
        elif c in _PAIRS or (c in "\"'" and i + 1 < len(s)):
            for close in _PAIRS.get(c, c):
                by.setdefault(close, []).append((len(stack), i))
            stack.append((i, c in _QUOTED))
    out.sort()
    flat: list[tuple[int, int, bool]] = []
    for a, b, q in out:
        if not flat or a > flat[-1][1]:
            flat.append((a, b, q))
    return flat


_SHORT_END = re.compile(r"(?<![\p{L}\p{N}])(?:Jr|Sr|Inc|Ltd|Co)\.$")
_AFTER_SPACE = re.compile(r"[\s​﻿]*")
_REPORT = re.compile(rf"(?:(?:Mr|Mrs|Ms|Dr|Prof|Rev)\. )?\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'.-]+){{0,3}} (?:{REPORT})\b")
_REPORTED = re.compile(rf"\b(?:{REPORT})\b")
_NONLATIN = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Devanagari}\p{Thai}\p{Arabic}]")


def _ends_with_quote(s: str, start: int, a: int, b: int) -> bool:
    """Does the quotation ``a``..``b`` hold a whole sentence that ends with it?"""
    inner = s[a + 1 : b].rstrip()
    if not inner or inner[-1] not in ".!?…。．！？।॥؟" or not _after_quote(s, start, a, b):
        return False
    return not (a > start and _SHORT_END.search(inner))


def _after_quote(s: str, start: int, a: int, b: int) -> bool:
    """Does the sentence that began at ``start`` end with the quotation ``a``..``b``, whose last character is a stop?"""
    k = _AFTER_SPACE.match(s, b + 1).end()
    if k >= len(s):
        return True
    c = s[k]
    if c in ",;:،؛、，：；)）-–—&" or c.islower() or c in ".!?。！？।":
        return False
    if c in "“„«「『\"'":
        return True
    lead = s[start:a].strip()
    inner = s[a + 1 : b]
    if _NONLATIN.search(inner):
        if lead:
            return s.startswith("と", k) is False
        return False  # the words that report it follow
    return bool(_REPORTED.search(lead)) or not _REPORT.match(s, k)


def split_paragraph(s: str, lang: str) -> list[int]:
    """Ends of the sentences of a paragraph, the last one left out."""
    (rules, plain), spans, ends = TABLES[lang], _quotes(s), []
    start = at = 0
    n, size = len(spans), len(s)
    for m in chain(_STOP.finditer(s), (None,)):
        lo, hi = m.span() if m else (size, size)
        while at < n and spans[at][1] < lo:  # quotations that end before this stop
            a, b, quotation = spans[at]
            at += 1
            if quotation and b >= start and _ends_with_quote(s, start, a, b):
                start = b + 1
                ends.append(start)
        if m is None or lo < start or at < n and spans[at][0] < lo:
            continue
        table, breaks = plain if s[hi - 1] == "." and hi > 1 and s[hi - 2] < "\x80" else rules[s[hi - 1]]
        row = table.match(s, hi)
        if row is not None and breaks[row.lastindex - 1]:
            while hi < size and s[hi] in ")]）":
                hi += 1
            ends.append(hi)
            start = hi
    return ends


def _unit(lines: list[tuple[int, int, str]], i: int) -> str:
    """Kind of a line: entry, label, greeting, closing or text."""
    t = lines[i][2]
    prev = lines[i - 1][2] if i else ""
    if _LIST.match(t) and (not prev.strip() or _LIST.match(prev) or _ENDS.search(prev) or not _RUNS_ON.search(prev)):
        return "entry"
    if _KNOWN.match(t):
        return "label"
    if m := _LABEL.match(t):
        for j in (i - 1, i + 1):
            if 0 <= j < len(lines) and (o := _LABEL.match(lines[j][2])) and o[1] != m[1]:
                return "label"
    if _CLOSING.fullmatch(t):
        return "closing"
    if _GREET.fullmatch(t) and (t.rstrip()[-1:] in ",،，:!、" or i + 1 >= len(lines)):
        return "greeting"
    return "text"


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start(), text[at : m.start()]))
        at = m.end()
    lines.append((at, len(text), text[at:]))
    lang = language(text) if _LATIN_LETTERS.search(text) else "en"
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def paragraph(a: int, b: int) -> None:
        lo = a
        for e in split_paragraph(text[a:b], lang):
            add(lo, a + e)
            lo = a + e
        add(lo, b)

    block: list[tuple[int, int, str]] = []
    for line in [*lines, (len(text), len(text), "")]:
        if line[2].strip(" \t ​﻿　").strip():
            block.append(line)
            continue
        open_, after = -1, ""
        for i in range(len(block)):
            a, b, t = block[i]
            kind = _unit(block, i)
            if kind == "text" and after == "closing" and not _ENDS.search(t):
                kind = "signature"
            if kind == "text" and after == "entry" and open_ < 0 and not _ENDS.search(block[i - 1][2]):
                # an entry without a stop goes on
                s, _ = out.pop()
                add(s, b)
                continue
            if kind == "text":
                if open_ < 0:
                    open_ = a
            else:
                if open_ >= 0:
                    paragraph(open_, block[i - 1][1])
                    open_ = -1
                add(a, b)
            after = kind
        if open_ >= 0:
            paragraph(open_, block[-1][1])
        block = []
    return out


def segment(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, spans = b.column(0).to_numpy(zero_copy_only=False), [], []
            for t in b.column(1).to_pylist():
                found = sentences(t)
                n.append(len(found))
                spans.extend(found)
            flat = np.array(spans, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc_id", "sent_start", "sent_end"])

    usable = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    return usable.mapInArrow(run, "doc_id long, sent_start long, sent_end long")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(table(spark, sf_dir, "documents"))
