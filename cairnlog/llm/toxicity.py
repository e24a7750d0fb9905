"""Toxicity from a lexicon matched with spelling errors, read in context.

The lexicon's terms form a trie. A Levenshtein automaton for each term's allowed distance is
intersected with it, and the product is made deterministic: one table over letter classes that
accepts every word within reach of a term and says which term and at what distance. Words are run
through the table column by column, many at a time. Every whole text is looked through. A hit that
changes the first letter, or any letter of a short term, is loose: proper words are often that near,
so it counts as a kind of its own.

Each hit has a context window: quotation marks around it and words of reporting speak for a
quotation, words that address somebody and further hits for abuse. Sums of the hits of each kind
go into a logistic score whose weights are fitted with priors on the labelled sample, so kinds
that the sample lacks keep their prior weight.

Terms are mined from a bounded sample of labelled whole texts of the training fold (FIT_ROWS, FIT_BYTES)
by greedy cover: the word that tells most toxic texts apart, then the one that does so for the
toxic texts left, as long as that can't be chance (a binomial tail over all words looked at). A short
list of common English insults is always part of the lexicon. Where an insult is inflected in many
ways, its stem is mined: a beginning that inflected words of toxic texts have and those of others
hardly do. One inflected word says little, as it may be there by chance; how many of them a text has
is a feature of its own. Neither the terms' number nor their lengths are limited.

Defined results: a null text is an empty one, and texts without a hit share the lowest score;
without labelled rows the priors hold; repeated rows are scored each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from math import exp, lgamma, log, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlog.llm.common import held_out, labelled_sample, small_batches

#: The sample that lexicon and weights are fitted on: rows at most, and bytes of all its texts together after which no more are added.
FIT_ROWS, FIT_BYTES = 4000, 128 << 20
TOXIC_AT = 0.5
WINDOW = 6  # chunks before and after a hit
#: The chance, over all words looked at, that a mined term is none.
CHANCE = 0.01
STEMMED, LOOSE = 3, 4  # stand for the distance of a word that is a stem and more, and of a loose hit
SEED_TERMS = (
    "idiot idiots moron morons imbecile stupid loser losers scum worthless pathetic disgusting trash garbage clown "
    "dumbass asshole bastard bitch retard retarded scumbag jackass filth vermin"
).split()
REPORTING = frozenset(
    "said says say called calls quoted quotes quote quoting word words term terms wrote writes reported slur insult insults "
    "mentioned mentions cited article sagte nannte wort dit appelle mot dijo llama palabra".split()
)
ADDRESS = frozenset("you your youre you're u ur yourself du dein dich tu toi vous usted eres tú".split())
QUOTES = re.compile("[\"“”„«»‹›`]|(?<!\\w)['‘]|['’](?!\\w)")
WORDS = re.compile(r"[^\W_]+(?:['’\-*@$!][^\W_]+)*[*@$!]?")
LEET = str.maketrans("013457@$!", "oieastasi")
RUNS = re.compile(r"(\w)\1{2,}")


def reach(term: str) -> int:
    """The distance that a term is matched at; of three letters, one letter off is any word."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def is_loose(word: str, term: str) -> bool:
    return word[:1] != term[:1] or len(term) < 5


class FuzzyLexicon:
    """Terms by a table-driven automaton: states are rows, columns are letter classes."""

    def __init__(self, terms: list[str], reach=reach):
        self.terms = sorted(set(terms))
        letters = sorted({c for t in self.terms for c in t})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other
        self.longest = max((len(t) + reach(t) for t in self.terms), default=0)
        self.shortest = min((len(t) - reach(t) for t in self.terms), default=1)
        # the trie: children, the term that ends here, the largest reach below, parents come first
        child: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        far = [0]
        for n, t in enumerate(self.terms):
            at = 0
            far[0] = max(far[0], reach(t))
            for c in t:
                if c not in child[at]:
                    child[at][c] = len(child)
                    child.append({}), ends.append(-1), far.append(0)
                at = child[at][c]
                far[at] = max(far[at], reach(t))
            ends[at] = n
        self._child, self._ends, self._far = child, ends, far
        self._reach = [reach(t) for t in self.terms]
        start = self._closed({0: 0})
        known, rows, todo = {(): 0, start: 1}, [[0] * (len(letters) + 1), None], [start]
        while todo:
            state = todo.pop()
            row = []
            for c in ["", *letters]:
                to = self._closed(self._after(state, c))
                if to not in known:
                    known[to] = len(known)
                    rows.append(None)
                    todo.append(to)
                row.append(known[to])
            rows[known[state]] = row
        self.table = np.array(rows, np.int32)
        self.found = np.full(len(rows), -1, np.int32)  # term * 4 + distance
        for state, i in known.items():
            hits = [(e, ends[n]) for n, e in state if ends[n] >= 0 and e <= self._reach[ends[n]]]
            if hits:
                e, term = min(hits)
                self.found[i] = term * 4 + e

    def _closed(self, state: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """With what deletions reach, without what exceeds every term's reach below."""
        state = {n: e for n, e in state.items() if e <= self._far[n]}
        todo = list(state)
        while todo:
            n = todo.pop()
            for to in self._child[n].values():
                e = state[n] + 1
                if e <= self._far[to] and e < state.get(to, 99):
                    state[to] = e
                    todo.append(to)
        return tuple(sorted(state.items()))

    def _after(self, state: tuple[tuple[int, int], ...], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for n, e in state:
            out[n] = min(out.get(n, 99), e + 1)  # a letter too many
            for c, to in self._child[n].items():
                cost = e + (c != letter)
                if cost < out.get(to, 99):
                    out[to] = cost
        return out

    def match(self, words: list[str]) -> dict[str, tuple[str, int]]:
        """The term and the distance of every word that has one."""
        words = [w for w in words if self.shortest <= len(w) <= self.longest]
        if not words:
            return {}
        got = {}
        cls = self.letters.get
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            lengths = np.array([len(w) for w in part])
            codes = np.zeros((len(part), self.longest), np.int32)
            codes[np.arange(self.longest)[None, :] < lengths[:, None]] = np.fromiter(
                (cls(c, 0) for w in part for c in w), np.int32, int(lengths.sum())
            )
            state, out = np.ones(len(part), np.int32), np.full(len(part), -1, np.int32)
            for k in range(self.longest):
                state = self.table[state, codes[:, k]]
                ended = lengths == k + 1
                out[ended] = self.found[state[ended]]
            for j in np.nonzero(out >= 0)[0].tolist():
                got[part[j]] = (self.terms[out[j] >> 2], int(out[j] & 3))
        return got


#: Sums over a text's hits. Priors: a hit as spelled is abuse, one or two letters off nearly so; inside a quotation hardly;
#: a loose hit, outside of quotations, hardly; an inflected stem is not yet, and each further, different one is more so.
FEATURES = ("exact", "fuzzy", "quoted", "quoted_fuzzy", "addressed", "crowded", "reported", "loose", "stem", "more_stems")
PRIOR = np.array([-4.0, 6.0, 5.0, 1.0, 0.5, 1.5, 1.0, -1.5, 0.0, 1.0, 2.0])
PRIOR_WIDTH = np.array([2.0, 2.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 1.0, 1.0])
SOFT = 5.0  # sums grow with their logarithm from here


class Detector:
    """Finds hits in whole texts; remembers the white-space chunks that it has looked at, up to `keep`."""

    def __init__(
        self, lexicon: FuzzyLexicon, weights: np.ndarray = PRIOR, keep: int = 500_000, proper: frozenset[str] = frozenset(),
        stems: tuple[str, ...] = (),
    ):
        self.lexicon, self.weights, self.keep, self.proper, self.stems = lexicon, weights, keep, proper, tuple(stems)
        self.seen: set[str] = set()
        self.hot: dict[str, tuple[str, int]] = {}

    def __getstate__(self):
        return self.lexicon, self.weights, self.keep, self.proper, self.stems

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.seen)
        if not new:
            return
        if len(self.seen) + len(new) > self.keep:
            self.seen.clear()
            self.hot.clear()
            new = chunks
        of: dict[str, list[str]] = {}
        low = min([self.lexicon.shortest, *(len(s) + 1 for s in self.stems)])
        for c in new:
            if len(c) < low:
                continue
            if c.isalpha():
                of.setdefault(c, []).append(c)
                if len(c) > low and c[0] == c[1] == c[2] or RUNS.search(c):
                    of.setdefault(RUNS.sub(r"\1", c), []).append(c)
                continue
            for w in WORDS.findall(c):
                forms = {w, RUNS.sub(r"\1", w)}
                if not w.isalpha() and not w.isdigit():
                    for spelled in (w, w.translate(LEET)):
                        forms |= {spelled, re.sub(r"[^\w]", "", spelled)}
                for f in forms:
                    of.setdefault(f, []).append(c)
        for w, (term, far) in self.lexicon.match(list(of)).items():
            hit = (term, LOOSE if far and is_loose(w, term) else far)
            for c in of[w] if not far or w not in self.proper else ():
                if c not in self.hot or hit[1] < self.hot[c][1]:
                    self.hot[c] = hit
        if self.stems:
            for w, own in of.items():
                if w.startswith(self.stems) and w not in self.stems:
                    for c in own:
                        if c in self.hot and self.hot[c][1] != LOOSE:
                            continue
                        self.hot[c] = (next(s for s in self.stems if w.startswith(s)), STEMMED)
        self.seen |= new

    def hits(self, text: str | None) -> list[tuple[int, str, int, bool, bool, bool, bool]]:
        """(chunk, term, distance, quoted, addressed, crowded, reported) of every hit, in order."""
        chunks = (text or "").lower().split()
        return self._hits(chunks) if chunks else []

    def _hits(self, chunks: list[str], known: set[str] | None = None) -> list:
        known = set(chunks) if known is None else known
        self._learn(known)
        if self.hot.keys().isdisjoint(known):
            return []
        at = [i for i, c in enumerate(chunks) if c in self.hot]
        sure = [i for i in at if self.hot[chunks[i]][1] != LOOSE]
        out = []
        for i in at:
            term, far = self.hot[chunks[i]]
            lo, hi = max(0, i - WINDOW), min(len(chunks), i + WINDOW + 1)
            before, own, after = " ".join(chunks[lo:i]), chunks[i], " ".join(chunks[i + 1 : hi])
            left = len(QUOTES.findall(before)) + len(QUOTES.findall(own[: len(own) // 2]))
            right = len(QUOTES.findall(after)) + len(QUOTES.findall(own[len(own) // 2 :]))
            near = {w.strip(".,;:!?\"'()“”«»") for w in (*chunks[lo:i], *chunks[i + 1 : hi])}
            out.append((
                i, term, far, left % 2 == 1 and right >= 1, not ADDRESS.isdisjoint(near),
                any(sure[j] != i for j in range(bisect_left(sure, lo), bisect_left(sure, hi))), not REPORTING.isdisjoint(near),
            ))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").lower().split() for t in texts]
        known = [set(s) for s in split]
        self._learn(set().union(*known) if known else set())
        x = np.zeros((len(texts), len(FEATURES)))
        for n, (chunks, have) in enumerate(zip(split, known)):
            if self.hot.keys().isdisjoint(have):
                continue
            inflected = set()
            for i, _, far, quoted, addressed, crowded, reported in self._hits(chunks, have):
                if far == STEMMED:
                    if not quoted:
                        inflected.add(chunks[i].strip(string.punctuation))
                    continue
                if far == LOOSE:
                    x[n, -3] += not quoted
                    continue
                x[n, :-3] += ((not quoted) * (not far), (not quoted) * bool(far), quoted * (not far), quoted * bool(far),
                              addressed * (not quoted), crowded * (not quoted), reported * quoted)
            x[n, -2:] = bool(inflected), max(0, len(inflected) - 1)
        return np.minimum(x, SOFT) + np.log1p(np.maximum(x - SOFT, 0.0))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + self.features(texts) @ self.weights[1:])))

    def fit(self, texts: list[str], labels: list[int], steps: int = 30):
        """Words near a term that clean texts have are proper words; then the weights most likely under the priors (Newton steps)."""
        words: dict[str, list[int]] = {}  # near a term, not a term
        for i in range(0, len(texts), 256):
            have = [set(WORDS.findall(t.lower())) for t in texts[i : i + 256]]
            near = {w for w, (_, far) in self.lexicon.match(list(set().union(*have))).items() if far}
            for h, y in zip(have, labels[i : i + 256]):
                for w in h & near:
                    words.setdefault(w, [0, 0])[bool(y)] += 1
        rare = max(1, sum(labels)) / max(1, len(labels))
        self.proper = frozenset(w for w, n in words.items() if n[0] and n[1] / sum(n) < max(0.5, 2 * rare))
        self.seen.clear(), self.hot.clear()
        x = np.hstack([np.ones((len(texts), 1)), self.features(texts)])
        y, tight = np.asarray(labels, float), np.diag(1 / PRIOR_WIDTH**2)
        w = PRIOR.copy()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - y) + tight @ (w - PRIOR)
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + tight, slope)
        self.weights = w
        return self


def _by_family(texts: list[str], labels: list[int], toxic: bool, kept) -> list[set[str]]:
    """What `kept` keeps of the words of each family of texts with this label.

    Texts that share the word with the least hash are a family, as copies mostly are.
    """
    out: dict[int, set[str]] = {}
    for t, y in zip(texts, labels):
        if bool(y) == toxic:
            words = set(re.findall(r"[^\W\d_]{2,}", t.lower()))
            # short words are common, and would make families of strangers
            out.setdefault(min((crc32(w.encode()) for w in words if len(w) > 3), default=0), set()).update(kept(words))
    return list(out.values())


def by_chance(n: int, others: int, rate: float) -> float:
    """The chance that n or more of n + others families are toxic, if each is at this rate."""
    m = n + others
    return sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * log(rate) + (m - k) * log1p(-rate)) for k in range(n, m + 1))


def mined_stems(texts: list[str], labels: list[int], chance: float = CHANCE, support: int = 5) -> list[str]:
    """Beginnings, of three letters at least, of longer words that tell toxic texts apart.

    In at least `support` toxic families of copies, at most 15 % as common in others, and more often than chance
    would have it over all beginnings looked at; of those that begin alike the most common one, then the longest.
    """
    toxic = _by_family(texts, labels, True, set)
    count: dict[str, int] = {}
    looked, k, here = 0, 3, {"": 0}
    while here:  # a longer beginning is no more common than a shorter one
        found = Counter(s for h in toxic for s in {w[:k] for w in h if len(w) > k and (k == 3 or w[: k - 1] in count)})
        here = {s: n for s, n in found.items() if n >= support}
        looked, k = looked + len(found), k + 1
        count |= here
    most = max(map(len, count), default=0)
    clean = _by_family(texts, labels, False, lambda h: {w[:k] for w in h for k in range(3, min(most + 1, len(w))) if w[:k] in count})
    others = Counter(s for h in clean for s in h)
    rate = len(toxic) / max(1, len(toxic) + len(clean))
    good = [
        (n, len(s), s) for s, n in count.items()
        if others[s] / max(1, len(clean)) <= 0.15 * n / len(toxic) and (not clean or by_chance(n, others[s], rate) * looked < chance)
    ]
    out: list[str] = []
    for _, _, s in sorted(good, reverse=True):
        if not any(s.startswith(o) or o.startswith(s) for o in out):
            out.append(s)
    return out


def mined(texts: list[str], labels: list[int], chance: float = CHANCE, support: int = 5, stems: tuple[str, ...] = ()) -> list[str]:
    """Words that tell toxic texts apart: in at least `support` toxic families of copies, at most 2 % as common in others,
    and more often than chance would have it over all words looked at. Words that begin with one of `stems` are left to them.
    """
    left = _by_family(texts, labels, True, lambda h: {w for w in h if not w.startswith(stems)} if stems else h)
    n_toxic, out = max(1, len(left)), []
    whole = Counter(w for h in left for w in h)
    often = {w for w, n in whole.items() if n >= support}
    others = _by_family(texts, labels, False, often.intersection)
    clean = Counter(w for h in others for w in h)
    rate = n_toxic / (n_toxic + len(others))
    often = {
        w for w in often
        if clean[w] / max(1, len(others)) <= 0.02 * whole[w] / n_toxic and (not others or by_chance(whole[w], clean[w], rate) * len(whole) < chance)
    }
    left = [h & often for h in left]
    while True:
        count = Counter(w for h in left for w in h)
        if not count:
            return out
        out.append(max(count, key=lambda w: (count[w], w)))
        left = [h for h in left if out[-1] not in h]


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, total_bytes: int = FIT_BYTES, terms=SEED_TERMS) -> Detector:
    sample = labelled_sample(docs, labels, "toxic", rows, total_bytes)
    texts, y = [t for t, _ in sample], [v for _, v in sample]
    stems = tuple(s for s in mined_stems(texts, y) if not any(t.startswith(s) or s.startswith(t) for t in terms))
    found = Detector(FuzzyLexicon([*terms, *mined(texts, y, stems=stems)]), stems=stems)
    return found.fit(texts, y) if texts else found


def scored(docs: DataFrame, model: Detector, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            score = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxic_at).cast("int").alias("predicted"),
    )
