"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, turns look-alike letters of other scripts and full-width forms into Latin letters and, inside
words, digits and signs that stand for letters. Lexicon entries are whole words or word beginnings, some of which count
only where they occur more than once; they and their weights are learned from labelled rows outside the held-out fold.
Hits inside exception phrases do not count. The summed weight, by itself and normalised by length, gives the score
through a logistic curve. Folding, matching and exceptions take time in proportion to the text.

Defined cases: null and empty texts have no hit and get the score of no evidence; repeated rows are scored each on
their own; without labelled rows of both classes every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import arrow_map, table
from wardspark.llm.fitting import apply_logistic, labelled_sample, logistic, remainder

DIVISOR, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bound of the labelled sample from which lexicon and curve are learned.
FIT_ROWS = 4000
#: Chance that any of the words of a sample becomes an entry by accident: each must beat the base rate of toxic documents
#: with a p-value of this over the number of words, and no more than EVIDENCE (natural logarithms) is asked for.
ACCIDENT, EVIDENCE = 1e-3, 9 * math.log(10)

#: Look-alikes of Latin letters in Cyrillic and Greek.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases in which a lexicon word is meant literally; a default that callers replace by their own.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "pond scum", "soap scum")

_FOLD = str.maketrans(
    HOMOGLYPHS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys("​‌‍﻿\xad")
)
_SIGNS = str.maketrans(SUBSTITUTES)
#: Runs with a letter and perhaps substitutes; signs at the end of a run are punctuation.
_MIXED = re.compile(r"(?=[\w@$]*[^\W\d_])[\w@$]*[^\W_]")
_WORD = re.compile(r"[^\W\d_]+")
#: Cheap tests: whether a text has anything to fold at all.
_FOREIGN = re.compile("[\xad\u0250-\u052f\u200b-\u200d\ufeff\uff01-\uff5e]")
_SIGN = re.compile(r"[013457@$]")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(_FOLD).lower()
    at, out, ends = 0, [], {" ": -1, "\n": -1}
    while m := _SIGN.search(text, at):
        # the run without white space around the sign; what follows it is looked for once, not from every sign
        a = max(text.rfind(" ", at, m.start()), text.rfind("\n", at, m.start()), at - 1) + 1
        for space, found in ends.items():
            if found < m.end():
                ends[space] = at_end if (at_end := text.find(space, m.end())) >= 0 else len(text)
        b = min(ends.values())
        out += [text[at:a], _MIXED.sub(lambda x: x.group().translate(_SIGNS), text[a:b])]
        at = b
    return "".join(out) + text[at:] if out else text


@dataclass(frozen=True)
class Lexicon:
    #: text, weight, whether it must be a whole word, and (1 if left out) how often it must occur to count
    entries: tuple[tuple, ...]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.automaton, self.least = ahocorasick.Automaton(), {}
        for k, (word, weight, whole, *least) in enumerate(lexicon.entries):
            self.automaton.add_word(word, (len(word), weight, whole, k))
            if least and least[0] > 1:
                self.least[k] = least[0]
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None, True, -1))
        self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries that count."""
        hits, allowed = [], []
        for end, (size, weight, whole, k) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum() or whole and folded[end + 1 : end + 2].isalnum():
                continue
            if weight is None:
                allowed.append((start, end))
            else:
                hits.append((start, end, weight, k))
        if allowed and hits:
            # the furthest end of the phrases that start no later than a hit covers it, if any does
            allowed.sort()
            starts, furthest = [a for a, _ in allowed], list(itertools.accumulate((b for _, b in allowed), max))
            covered = lambda h: (i := bisect.bisect_right(starts, h[0])) and furthest[i - 1] >= h[1]
            hits = [h for h in hits if not covered(h)]
        if self.least and hits:
            times = Counter(h[3] for h in hits)
            hits = [h for h in hits if times[h[3]] >= self.least.get(h[3], 1)]
        return [h[:3] for h in hits]

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Summed weight (logarithm), weight by a thousand words (logarithm), number of hits."""
        folded = fold(text or "")
        hits = self.hits(folded)
        total = sum(h[2] for h in hits)
        words = folded.count(" ") + folded.count("\n") + 1
        return math.log1p(total), math.log1p(1000 * total / words), len(hits)


def learn(texts: list[str], toxic: np.ndarray, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Entries are word beginnings and whole words that occur far more often in toxic documents than their share: from
    the shortest that do, each is extended as long as that keeps nearly all the evidence, so that it is as specific as
    the data allow."""
    rate = toxic.mean() if len(toxic) else 0.0
    if not 0 < rate < 1:
        return Lexicon((), (), exceptions)
    entries = []
    for p, bad, fine, least in sorted(_beginnings(texts, toxic, rate)):
        weight = math.log((bad + 0.5) / (toxic.sum() + 1)) - math.log((fine + 0.5) / ((1 - toxic).sum() + 1))
        entries.append((p.rstrip(), max(weight, 0.1), p.endswith(" "), *([least] if least > 1 else [])))
    lexicon = Lexicon(tuple(entries), (), exceptions)
    matcher = Matcher(lexicon)
    x = np.array([matcher.features(t)[:2] for t in texts])
    return Lexicon(lexicon.entries, tuple(logistic(x, toxic).tolist()), exceptions)


def _beginnings(texts: list[str], toxic: np.ndarray, rate: float) -> Iterator[tuple[str, int, int, int]]:
    """Chosen beginnings (a space closes a whole word), none of them a beginning of another, with their numbers of toxic
    and clean documents and the number of times (1 or 2) that a document must hold them to be counted. Beginnings are
    ranges of the sorted words; those that the same words share are one node."""
    holders: dict[str, tuple[Counter, Counter]] = {}
    for i, (t, y) in enumerate(zip(texts, toxic, strict=True)):
        for w, n in Counter(_WORD.findall(fold(t))).items():
            holders.setdefault(f"{w} ", (Counter(), Counter()))[0 if y else 1][i] = n
    words = sorted(holders)
    least_evidence = min(EVIDENCE, math.log(max(len(words), 1) / ACCIDENT))

    def documents(lo: int, hi: int, side: int) -> Counter:
        times: Counter = Counter()
        for w in words[lo:hi]:
            times.update(holders[w][side])
        return times

    def node(lo: int, hi: int) -> tuple:
        """Evidence, toxic and clean documents, times, all toxic ones, of words[lo:hi]; clean ones are counted only where
        evidence is possible."""
        bad = documents(lo, hi, 0)
        if -len(bad) * math.log(rate) < least_evidence:
            return 0.0, 0, 0, 1, len(bad), lo, hi
        fine = documents(lo, hi, 1)
        sides = [(sum(n >= k for n in bad.values()), sum(n >= k for n in fine.values()), k) for k in (1, 2)]
        return max(((_evidence(b, f, rate), b, f, k, len(bad), lo, hi) for b, f, k in sides), key=lambda n: (n[0], -n[3]))

    open_nodes = [node(0, len(words))] if words else []
    while open_nodes:
        evidence, bad, fine, times, every, lo, hi = open_nodes.pop()
        if -every * math.log(rate) < least_evidence:  # nothing longer has more toxic documents
            continue
        shared = os.path.commonprefix([words[lo], words[hi - 1]])
        k, longer = len(shared), []
        while lo < hi and k < len(words[lo]):
            end = bisect.bisect_right(words, words[lo][k], lo, hi, key=lambda w: w[k])
            longer.append(node(lo, end))
            lo = end
        best = max(longer, key=lambda n: n[0], default=(0.0,))
        if shared and evidence >= least_evidence and best[0] < 0.95 * evidence:
            yield shared, bad, fine, times
        else:
            open_nodes += longer


def _evidence(bad: int, fine: int, rate: float) -> float:
    """Bound on -log p of so many toxic documents among those with the entry (Chernoff)."""
    n, q = bad + fine, bad / (bad + fine) if bad else 0.0
    if q <= max(rate, 0.8):
        return 0.0
    rest = (1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0
    return n * (q * math.log(q / rate) + rest)


def fit(spark: SparkSession, sf_dir: str, docs: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    return learn(*labelled_sample(spark, sf_dir, docs, "toxic", DIVISOR, HELD_OUT, rows))


def score(docs: DataFrame, lexicon: Lexicon, columns: str = "doc_id") -> DataFrame:
    kept: dict[str, Matcher] = {}
    curve = np.array(lexicon.curve)

    def rows(x: dict) -> dict:
        matcher = kept.get("matcher") or kept.setdefault("matcher", Matcher(lexicon))
        found = [matcher.features(t) for t in x["text"]]
        values = apply_logistic(np.array([f[:2] for f in found]).reshape(-1, 2), curve) if len(curve) else np.zeros(len(found))
        return {"doc_id": x["doc_id"], "score": values.tolist(), "hits": [f[2] for f in found]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double, hits int", rows)


def accepted(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose score stays below ``threshold``; one pass, no join."""
    kept: dict[str, Matcher] = {}
    curve = np.array(lexicon.curve)

    def rows(batches):
        matcher = kept.get("matcher") or kept.setdefault("matcher", Matcher(lexicon))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([matcher.features(t)[:2] for t in texts]).reshape(-1, 2)
            yield batch.filter(pa.array(apply_logistic(x, curve) < threshold if len(curve) else np.ones(len(x), bool)))

    return docs.mapInArrow(rows, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(spark, sf_dir, docs)).select(
        "doc_id",
        (remainder(DIVISOR) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "hits",
    )
