"""Toxicity scores from a learned lexicon, misspellings and context.

Fitting (on at most FIT_ROWS labelled rows, whole texts) learns which words and word beginnings stand almost only in
toxic texts. A word of a text hits the lexicon exactly, by its beginning, or misspelled: a
Levenshtein automaton of the word, run against a trie of the lexicon, finds terms within one edit. A word that the
fit's clean texts use is no misspelling, and a term beside which they use several words is not looked for misspelled: there,
one edit leads from one common word to the next. A window of words around each hit tells a quotation (between marks, or after
a verb of speech) from a direct voice, and dense hits from scattered ones. A logistic function of these counts is the score.
Exact and misspelled hits have counts, density and strength of their own.

Weights are cross-fitted: the evidence in either half of the rows is found with a lexicon from the other half. Few
labelled texts misspell or quote a term, so each toxic one that holds a term also counts in two altered forms: with one
random edit in each term, still toxic, and with each term quoted, clean. The lexicon that serves comes from all the rows.

Null and empty texts have no hits and get the score of such texts. Bytes that are no UTF-8 count as U+FFFD. Very long
texts are read whole. With no labelled rows, or only one class among them, every score is 0. Rows repeat as often as in
the input. `columns` may not hold the names that `score` makes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, worker_cache

#: Labelled rows that a fit uses at most.
FIT_ROWS = 6000
#: A term stands in this many different toxic texts, and this many times as often in toxic texts as in others.
LEAST_TEXTS, LEAST_RATIO = 5, 40.0
#: Lengths of the word beginnings that may become terms, and of terms that are found misspelled.
STEMS, LEAST_FUZZY = (4, 5, 6, 7), 5
#: Different words of clean texts within one edit of a term, from which on it is not looked for misspelled.
CROWDED = 2
#: Words on either side of a hit that are its context.
WINDOW = 8
#: Words whose verdict a worker keeps; then it starts afresh.
KEPT_WORDS = 400_000
WORD = re.compile(r"[\w@$]+|[\"“”„«»]")
QUOTES = frozenset("\"“”„«»")
# Letters that digits and signs stand for; verbs and nouns of reported speech.
FOLDED = str.maketrans("013457@$", "oieastas")
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term reported claims claimed sagte nannte wort dit appelle mot dijo llama palabra".split())


class LevenshteinAutomaton:
    """Accepts the strings within `most` edits of a word. A state holds the least edits for each prefix of the word."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[int, ...]:
        return tuple(range(len(self.word) + 1))

    def step(self, state: Sequence[int], char: str) -> tuple[int, ...]:
        out = [state[0] + 1]
        for i, own in enumerate(self.word):
            out.append(min(out[i] + 1, state[i + 1] + 1, state[i] + (own != char)))
        return tuple(min(x, self.most + 1) for x in out)

    def accepts(self, state: Sequence[int]) -> bool:
        return state[-1] <= self.most

    def alive(self, state: Sequence[int]) -> bool:
        return min(state) <= self.most


class Trie:
    """Terms by letters."""

    def __init__(self, terms: Iterable[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for char in term:
                node = node.setdefault(char, {})
            node[""] = term

    def near(self, word: str, most: int) -> list[str]:
        """The terms that the word's automaton accepts: both are walked together."""
        automaton = LevenshteinAutomaton(word, most)
        found, stack = [], [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            if "" in node and automaton.accepts(state):
                found.append(node[""])
            for char, child in node.items():
                if char and automaton.alive(after := automaton.step(state, char)):
                    stack.append((child, after))
        return sorted(found)


@dataclass
class Lexicon:
    """Terms and stems with their log-odds of toxic text; words near a term that clean texts use; terms near several such words."""

    words: dict[str, float]
    stems: dict[str, float]
    known: set[str] = field(default_factory=set)
    crowded: set[str] = field(default_factory=set)
    trie: Trie = field(init=False)
    halves: set[str] = field(init=False)

    def __post_init__(self):
        long = [w for w in self.words if len(w) >= LEAST_FUZZY and w not in self.crowded]
        self.trie = Trie(long)
        # One edit leaves one half of a term whole, at the beginning or at the end of the word.
        self.halves = {f"{len(w) + d}{side}{part}" for w in long for d in (-1, 0, 1) for side, part in (("<", w[: len(w) // 2]), (">", w[len(w) // 2 :]))}
        self.sizes = sorted({len(x.lstrip("0123456789")) - 1 for x in self.halves})
        self.stem_sizes = sorted({len(s) for s in self.stems})

    def verdict(self, word: str) -> float:
        """0 for no hit; the log-odds of an exact hit or a stem; their negative if the word is misspelled."""
        plain = word.strip("@$_")
        if plain in self.words:
            return self.words[plain]
        for n in self.stem_sizes:
            if plain[:n] in self.stems:
                return self.stems[plain[:n]]
        if not plain.isalpha():
            plain = plain.translate(FOLDED)
            if plain in self.words:
                return -self.words[plain]
        n = len(plain)
        if n >= LEAST_FUZZY - 1 and plain not in self.known and any(f"{n}<{plain[:k]}" in self.halves or f"{n}>{plain[-k:]}" in self.halves for k in self.sizes):
            near = self.trie.near(plain, 1)
            return -max((self.words[t] for t in near), default=0.0)
        return 0.0


class Verdicts(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = value = self.lexicon.verdict(word)
        return value


def densest(places: Sequence[int]) -> float:
    """The most of these rising places that one stretch of two windows holds."""
    most = first = 0
    for k, at in enumerate(places):
        while at - places[first] > 2 * WINDOW:
            first += 1
        most = max(most, k - first + 1)
    return float(most)


#: What `evidence` gives of a text without hits.
NOTHING = [0.0] * 7


def evidence(text: str, verdicts: Verdicts) -> list[float]:
    """What a score is made of: exact and misspelled hits in a direct voice, and quoted ones; density and strength of the exact direct ones, and of the misspelled."""
    words = WORD.findall(text.lower())
    hits = [(at, v) for at, v in enumerate(map(verdicts.__getitem__, words)) if v]
    if not hits:
        return NOTHING
    quoted = 0
    places: tuple[list[int], list[int]] = ([], [])
    strong = [0.0, 0.0]
    for at, value in hits:
        before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
        inside = sum(w in QUOTES for w in before) % 2 == 1 and any(w in QUOTES for w in after)
        if inside or any(w in REPORTING for w in before[-3:]):
            quoted += 1
            continue
        kind = int(value < 0)
        places[kind].append(at)
        strong[kind] = max(strong[kind], abs(value))
    exact, fuzzy = places
    return [np.log1p(len(exact)), np.log1p(len(fuzzy)), np.log1p(quoted), densest(exact), strong[0], densest(fuzzy), strong[1]]


def altered(text: str, lexicon: Lexicon, rng: np.random.Generator) -> tuple[str, str] | None:
    """The text with its terms misspelled, and with them quoted; None if it holds none that can be misspelled."""
    found = [m for m in re.finditer(r"[^\W\d_]+", text) if len(m[0]) >= LEAST_FUZZY and m[0].lower() in lexicon.words]
    if not found:
        return None
    wrong, quoted, at = [], [], 0
    for m in found:
        word, k = m[0], int(rng.integers(1, len(m[0])))
        edits = (word[:k] + word[k + 1 :], word[:k] + word[k - 1] + word[k:], word[:k] + "aeiou"[int(rng.integers(5))] + word[k + 1 :])
        wrong += [text[at : m.start()], edits[int(rng.integers(3))]]
        quoted += [text[at : m.start()], f'"{word}"']
        at = m.end()
    return "".join(wrong) + text[at:], "".join(quoted) + text[at:]


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def score(self, x: Sequence[float]) -> float:
        return float(1 / (1 + np.exp(-(np.dot(self.weights, x) + self.bias))))


def learn_lexicon(sample: Sequence[tuple[int, str]]) -> Lexicon:
    """Terms of labelled texts. Near-copies count once: a term's texts are told apart by the least hash of their shingles of three words."""
    by_class: tuple[list, list] = ([], [])
    for toxic, text in sample:
        found = WORD.findall(text.lower())
        words = {w.strip("@$_") for w in found}
        if words := {w for w in words if len(w) > 2 and w.isalpha()}:
            group = min(zlib.crc32(" ".join(found[k : k + 3]).encode()) for k in range(max(1, len(found) - 2)))
            by_class[toxic].append((group, words))

    def terms(words: set[str]) -> set[str]:
        return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}

    groups: dict[str, set[int]] = defaultdict(set)
    for group, words in by_class[1]:
        for term in terms(words):
            groups[term].add(group)
    wanted = {t: len(g) for t, g in groups.items() if len(g) >= LEAST_TEXTS}
    del groups
    other: dict[str, set[int]] = defaultdict(set)
    for group, words in by_class[0]:
        for term in terms(words) & wanted.keys():
            other[term].add(group)
    n_toxic, n_other = (len({g for g, _ in x}) for x in (by_class[1], by_class[0]))
    odds = {t: (n + 0.5) / (n_toxic + 1) * (n_other + 1) / (len(other[t]) + 0.5) for t, n in wanted.items()}
    best = sorted((t for t in odds if odds[t] >= LEAST_RATIO), key=lambda t: (-wanted[t] * np.log(odds[t]), t))
    stems = {t[:-1]: float(np.log(odds[t])) for t in best if t[-1] == "*"}
    # A beginning that belongs to one known word only is no stem, and a longer one under a shorter one is not needed.
    words = {t: float(np.log(odds[t])) for t in best if t[-1] != "*"}
    full = {t: wanted[t] for t in words}
    stems = {s: v for s, v in stems.items() if wanted[s + "*"] > 1.2 * max((n for w, n in full.items() if w.startswith(s)), default=0)}
    stems = {s: v for s, v in stems.items() if not any(s[:n] in stems for n in STEMS if n < len(s))}
    lexicon = Lexicon(words, stems)
    clean = set().union(*(w for _, w in by_class[0])) - words.keys()
    known = {w for w in clean if lexicon.verdict(w) < 0}
    beside = Counter(term for w in known for term in lexicon.trie.near(w, 1))
    return Lexicon(words, stems, known, {term for term, n in beside.items() if n >= CROWDED})


def fit(sample: Sequence[tuple[int, str]]) -> Model | None:
    """The model of labelled texts (toxic 0 or 1, text)."""
    if len({t for t, _ in sample}) < 2:
        return None
    halves: tuple[list, list] = ([], [])
    for toxic, text in sample:
        halves[zlib.crc32(text.encode()) % 2].append((toxic, text))
    rng, rows, found = np.random.default_rng(11), [], []
    for own, other in (halves, halves[::-1]):
        verdicts = Verdicts(learn_lexicon(other))
        for toxic, text in own:
            both = altered(text, verdicts.lexicon, rng) if toxic else None
            for t, x in [(toxic, text)] + ([(1, both[0]), (0, both[1])] if both else []):
                rows.append((t, x))
                found.append(evidence(x, verdicts))
    lexicon = learn_lexicon(sample)
    x = np.array(found)
    y = np.array([t for t, _ in rows], float)
    # Direct hits raise a score; what is quoted may lower it.
    w, b = np.zeros(x.shape[1]), 0.0
    least = np.array([0, 0, -np.inf, 0, 0, 0, 0])
    for _ in range(800):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        step = p - y
        w = np.maximum(least, w - 0.3 * (x.T @ step / len(y) + 1e-4 * w))
        b -= 0.3 * step.mean()
    return Model(lexicon, w.tolist(), float(b))


def fit_on(df: DataFrame, labels: DataFrame, learn_from: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model | None:
    """The model fitted on at most FIT_ROWS of the labelled rows that learn_from holds for."""
    known = labels.where(F.col(label_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).alias("__toxic"))
    ids = known.where(learn_from).orderBy(F.xxhash64(id_column), id_column).limit(FIT_ROWS)
    chosen = df.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most FIT_ROWS ids
    rows = df.select(id_column, F.col(text_column).alias("__text")).join(F.broadcast(chosen), id_column)
    return fit([(int(r[1]), r[2] or "") for r in sorted(rows.select(id_column, "__toxic", "__text").collect(), key=lambda r: (r[0], r[2] or ""))])


def score(df: DataFrame, model: Model | None, columns: list[str], text_column: str = "text", least: float = 0.3) -> DataFrame:
    """columns, n_hits_direct, n_hits_misspelled, n_hits_quoted, score and predicted (1 if score >= least)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # what at most FIT_ROWS rows hold

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        own = shared.value
        verdicts = worker_cache(("verdicts", shared), lambda: own and Verdicts(own.lexicon))
        for text in texts:
            x = evidence(text.decode(errors="replace"), verdicts) if own is not None else NOTHING
            value = own.score(x) if own is not None else 0.0
            direct, misspelled, quoted = (int(round(np.expm1(v))) for v in x[:3])
            yield direct, misspelled, quoted, value, int(value >= least)

    schema = "n_hits_direct bigint, n_hits_misspelled bigint, n_hits_quoted bigint, score double, predicted int"
    return map_texts(df, columns, text_column, schema, run)
