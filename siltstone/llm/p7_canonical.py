"""Problem 7: mapping free-entered values to a canonical list.

Distinct values are mapped once, then joined back. A multi-pattern automaton over the names and second names of the list finds
all embedded mentions at word boundaries; the longest non-overlapping one wins. Values without a mention go to token-set
similarity (words in any order, each equal to a word of the entry but for its plural or a typing error, weighted by rarity in the list),
then shortened words and words without vowels, and at last to the one entry within the edits that a
name of its length allows, as a whole or as a run of words; an entry is only taken if no other is as close.

Defined cases: null tokens give no row; values without an entry give -1 and are reported by ``unmatched``; of several mentions
the longest, then the first counts; repeated values are mapped alike; an empty list maps everything to -1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import blank_or_null, materialize, table
from .p1_entities import small_list
from .strings import edits, fold, unscan

SIMILAR = 0.8  # weighted Jaccard of the words of a value and an entry
_AND = frozenset(("and", "n"))


def _words(raw: str) -> list[str]:
    s = re.sub(r"(?<=\w)['’](?=\w)", "", fold(raw).replace("_", " "))
    return [unscan(w) if re.search(r"[a-z]", w) else w for w in re.findall(r"[^\W_]+", s)]


def _stem(w: str) -> str:
    return w[:-1] if len(w) > 2 and w.endswith("s") and not w.endswith("ss") else w


def _bones(w: str) -> str:
    return w[:1] + re.sub(r"[aeiou]", "", w[1:])


def _errors(n: int) -> int:
    return 0 if n < 5 else 1 if n < 6 else 2 if n < 14 else 3


class Canon:
    """Matcher over ``entries`` (id, name, second name); the smaller id wins where two entries have one form."""

    def __init__(self, entries: Iterable[tuple[int, str, str | None]]):
        self.exact: dict[str, int] = {}
        self.sets: dict[tuple[str, ...], int] = {}
        self.having: dict[str, set[tuple[str, ...]]] = {}
        self.bones: dict[str, set[int]] = {}
        self.forms: list[tuple[str, tuple[str, ...], int]] = []
        self.most = 1
        for rid, name, other in sorted(entries, key=lambda e: e[0]):
            for form in (name, other):
                words = tuple(w for w in _words(form or "") if w not in _AND)
                if not words:
                    continue
                joined = "".join(words)
                self.exact.setdefault(" ".join(words), rid)
                self.exact.setdefault(" ".join(map(_stem, words)), rid)
                tokens = tuple(sorted(set(map(_stem, words))))
                self.sets.setdefault(tokens, rid)
                for w in tokens:
                    self.having.setdefault(w, set()).add(tokens)
                self.bones.setdefault(_bones(joined), set()).add(rid)
                self.bones.setdefault("".join(map(_bones, words)), set()).add(rid)
                self.forms.append((joined, words, rid))
                self.most = max(self.most, len(words))
        self.compact: dict[str, int] = {}
        for joined, words, rid in self.forms:
            self.compact.setdefault(joined, rid)
            self.compact.setdefault("".join(map(_stem, words)), rid)
        self.auto = ahocorasick.Automaton()
        for form, rid in self.exact.items():
            self.auto.add_word(f" {form} ", (len(form), rid))
        if self.exact:
            self.auto.make_automaton()

    def mentions(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(length, end, id) of the embedded names that don't overlap: longer ones first, then earlier ones."""
        hits = []
        for variant in (words, [_stem(w) for w in words]):
            text = f" {' '.join(variant)} "
            hits += [(n, end, rid) for end, (n, rid) in self.auto.iter(text)]
        kept: list[tuple[int, int, int]] = []
        for n, end, rid in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(end <= e - m or end - n >= e for m, e, _ in kept):
                kept.append((n, end, rid))
        return kept

    def mention(self, words: list[str]) -> int | None:
        found = self.mentions(words)
        return found[0][2] if found else None

    def _weight(self, token: str) -> float:
        return math.log(1 + len(self.sets) / max(1, len(self.having.get(token, ()))))

    def similar(self, words: list[str], least: float = SIMILAR) -> int | None:
        """The one entry whose words are most like ``words`` as a set, by weighted Jaccard of at least ``least``."""
        mine = {}  # word -> the words of the list it may stand for
        for w in map(_stem, words):
            mine[w] = {w} if w in self.having else {t for t in self.having if abs(len(t) - len(w)) <= (k := _errors(min(len(t), len(w)))) and k and edits(w, t, k) <= k}
        best: dict[int, float] = {}
        for tokens in {s for near in mine.values() for t in near for s in self.having[t]}:
            met = [t for t in tokens if any(t in near for near in mine.values())]
            strange = [w for w, near in mine.items() if not near & set(tokens)]
            same = sum(map(self._weight, met))
            score = same / (sum(map(self._weight, tokens)) + sum(map(self._weight, strange)))
            rid = self.sets[tokens]
            if score >= least and score > best.get(rid, 0.0):
                best[rid] = score
        top = max(best.values(), default=0.0)
        hits = [r for r, x in best.items() if x == top]
        return hits[0] if len(hits) == 1 else None

    def _closest(self, s: str, tolerance: int) -> int | None:
        found: dict[int, int] = {}
        for joined, _, rid in self.forms:
            if abs(len(joined) - len(s)) <= tolerance:
                d = edits(s, joined, tolerance)
                if d <= tolerance and d <= _errors(len(joined)) and d < found.get(rid, 99):
                    found[rid] = d
        if not found:
            return None
        least = min(found.values())
        hits = [r for r, d in found.items() if d == least]
        return hits[0] if len(hits) == 1 else None

    def find(self, raw: str) -> int:
        """Id of the entry meant, -1 if there is none."""
        words = [w for w in _words(raw) if w not in _AND]
        letters = [w for w in words if not w.isdigit()]
        if not letters or not self.exact:
            return -1
        if (rid := self.mention(words)) is not None:
            return rid
        joined = "".join(letters)
        if (rid := self.compact.get(joined, self.compact.get(_stem(joined)))) is not None:
            return rid
        if (rid := self.similar(letters)) is not None:
            return rid
        # shortened words: each is the beginning of its word, in any order
        hits = {rid for _, form, rid in self.forms if len(form) == len(letters) and any(len(w) < len(f) for w, f in zip(letters, form)) and all(f.startswith(w) and len(w) > 2 for w, f in zip(letters, form))}
        if len(hits) == 1 and (len(joined) > 4):
            return hits.pop()
        if len(joined) > 3 and not re.search(r"[aeiou]", joined[1:]):
            hits = self.bones.get(_bones(joined), set())
            if len(hits) == 1:
                return next(iter(hits))
        if (rid := self._closest(joined, _errors(len(joined)))) is not None:
            return rid
        turned = "".join(letters[1:] + letters[:1]) if len(letters) > 1 else ""
        if turned and (rid := self._closest(turned, min(2, _errors(len(turned))))) is not None:
            return rid
        best: dict[int, int] = {}
        for size in range(min(self.most + 1, len(letters)), 0, -1):
            for i in range(len(letters) - size + 1):
                s = "".join(letters[i : i + size])
                if len(s) > 6 and len(s) < len(joined) and (rid := self._closest(s, _errors(len(s)) if len(s) > 8 else 1)) is not None:
                    best[rid] = max(best.get(rid, 0), len(s))
        if best:
            top = max(best.values())
            hits = [r for r, n in best.items() if n == top]
            if len(hits) == 1:
                return hits[0]
        return -1


def map_values(records: DataFrame, value: str, entries: DataFrame) -> DataFrame:
    """``records`` (rec_id, ``value``) with ``ref_id``; ``entries`` has the columns id, name, other."""
    canon = Canon([tuple(r) for r in small_list(entries.select("id", "name", "other"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canon.find(s) for s in b.column(0).to_pylist()], pa.int64())], names=["v", "ref_id"])

    usable = records.select("rec_id", F.col(value).alias("v")).filter(~blank_or_null(F.col("v")))
    # matching takes far longer than the few bytes of the values suggest: as many tasks as cores
    distinct = usable.select("v").distinct().repartition(records.sparkSession.sparkContext.defaultParallelism, "v")
    mapped = materialize(distinct.mapInArrow(run, "v string, ref_id long"))
    return usable.join(mapped, "v").select("rec_id", F.col("v").alias("value"), "ref_id")


def p7_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, value, ref_id) of stores and items together."""
    cities = table(spark, sf_dir, "city_list").select(F.col("city_id").alias("id"), F.col("city").alias("name"), F.col("also_known_as").alias("other"))
    kinds = table(spark, sf_dir, "category_list").select(F.col("category_id").alias("id"), F.col("category").alias("name"), F.col("also_known_as").alias("other"))
    stores = table(spark, sf_dir, "store_knowledge").select("rec_id", F.col("cleaned_record.city").alias("city"))
    items = table(spark, sf_dir, "item_knowledge").select("rec_id", F.col("cleaned_record.category").alias("category"))
    return map_values(stores, "city", cities).unionByName(map_values(items, "category", kinds))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_mapped(spark, sf_dir).select("rec_id", "ref_id")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values without an entry, with their use."""
    return p7_mapped(spark, sf_dir).filter("ref_id = -1").groupBy("value").agg(F.count("*").alias("uses"))
