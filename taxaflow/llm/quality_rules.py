"""Quality by weak supervision.

Rules vote good or bad or abstain on a document. Documents are good, or bad in one of several ways (KINDS): rules that look at one
thing, such as repetition, go wrong together, so votes are taken as independent only among good documents and among those
bad in one way. Expectation-maximisation over the counts of vote patterns estimates how often each rule votes bad in each
class, and how large the classes are; nothing else ties a rule to a kind than where the estimates start. A document's
posterior probability of being good decides, so one failed rule among many passed does not reject a document. The patterns are
counted over all documents in Spark; at most 3^rules of them reach the driver.

A null text counts as empty: no words, base_failed. Bytes that are no UTF-8 count as U+FFFD. Very long texts are read
whole. Rows repeat as often as in the input. `columns` may not hold the names that `judge` makes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_texts

#: (name, votes good where, votes bad where), over the counts of `counts`; where neither holds the rule abstains.
RULES = (
    ("length", "n_words >= 50", "n_words < 25"),
    ("word_length", "word_chars between 3 * n_words and 11 * n_words", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "5 * n_symbols >= n_words"),
    ("letters", "100 * n_letter_words >= 90 * n_words", "100 * n_letter_words < 60 * n_words"),
    ("repeated_lines", "20 * n_dup_lines <= n_lines", "5 * n_dup_lines >= 2 * n_lines"),
    ("repeated_words", "100 * n_repeat_words <= 20 * n_words", "100 * n_repeat_words > 40 * n_words"),
    ("distinct_words", "10 * n_distinct_words >= 2 * n_words", "20 * n_distinct_words < n_words"),
    ("sentence_ends", "10 * n_ended_lines >= 5 * n_lines", "10 * n_ended_lines < n_lines"),
)
#: Ways to be bad, each with the rules that it is first thought to fail.
KINDS = {"symbols": ("word_length", "symbols", "letters"), "repetition": ("repeated_lines", "repeated_words", "distinct_words", "sentence_ends")}
#: First estimates: the share of good documents, and how often a rule votes bad on them, on those of its kind, and on others. They
#: also count as so many documents, and as one vote of each rule in each class, so no estimate is 0 or 1.
GOOD_SHARE, FALSE_ALARM, HIT, OTHER, PRIOR = 0.9, 0.02, 0.5, 0.05, 10.0
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_letter_words bigint, n_lines bigint, n_ended_lines bigint, n_distinct_words bigint"


def repeat_words(words: Sequence) -> int:
    """Words inside 3-word windows that occur twice or more in the sequence."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total = end = 0
    for at, window in enumerate(windows):
        if count[window] > 1:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def text_counts(text: bytes) -> tuple:
    """The counts of _SCHEMA for one text."""
    chars = text.decode(errors="replace")
    words = _WORD.findall(chars)
    lines = [x for x in chars.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n_symbols = len(_SYMBOL.findall(chars))
    distinct = set(words)
    odd = {w for w in distinct if not w[0].isalpha() and not any(map(str.isalpha, w))}
    with_letter = len(words) - (sum(1 for w in words if w in odd) if odd else 0)
    ended = sum(x.rstrip().endswith((".", "!", "?", "…", ":", '"', "”", "»")) for x in lines)
    return (len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), repeat_words(words), with_letter, len(lines), ended, len(distinct))


def counts(df: DataFrame, columns: list[str], text_column: str = "text") -> DataFrame:
    """columns, then the counts the rules need."""

    def run(texts: Iterable[bytes]) -> Iterator[tuple]:
        return map(text_counts, texts)

    return map_texts(df, columns, text_column, _SCHEMA, run)


def vote(rule: tuple[str, str, str]) -> Column:
    _, good, bad = rule
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def fit(patterns: dict[tuple[int, ...], int], kinds: Sequence[Sequence[int]], rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(share of each class, how often each rule's votes are bad in it: class x rule). The first class is good, then each kind.

    kinds: the rules (by number) that each kind is first thought to fail. Abstaining tells nothing.
    """
    votes = np.array(list(patterns), float).reshape(len(patterns), -1)
    number, bad, cast = np.array(list(patterns.values()), float), (votes < 0).astype(float), (votes != 0).astype(float)
    share = np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / len(kinds)] * len(kinds))
    rates = np.array([[FALSE_ALARM] * votes.shape[1]] + [[HIT if j in kind else OTHER for j in range(votes.shape[1])] for kind in kinds])
    first_share, first_rates = share, rates
    for _ in range(rounds):
        of = number[:, None] * posterior(votes, share, rates)
        before = share, rates
        share = (PRIOR * first_share + of.sum(0)) / (PRIOR + number.sum())
        rates = (first_rates + of.T @ bad) / (1 + of.T @ cast)
        if max(np.abs(share - before[0]).max(), np.abs(rates - before[1]).max()) < 1e-9:
            break
    return share, rates


def posterior(votes: np.ndarray, share: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Probability of each class (columns) for votes (rows)."""
    z = np.log(share) + (votes < 0) @ np.log(rates).T + (votes > 0) @ np.log1p(-rates).T
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def judge(df: DataFrame, columns: list[str], text_column: str = "text", least: float = 0.5, min_words: int = 50, keep_table: bool = True, rules: Sequence[tuple[str, str, str]] = RULES, kinds: Mapping[str, Sequence[str]] = KINDS) -> DataFrame:
    """columns, the base counts, base_failed, quality (posterior) and kept (not base_failed and quality >= least).

    keep_table: write the counts with the columns to a table; without it texts are counted twice, which suits wide columns.
    base_failed: fewer than min_words words, or more than half of them in repeated 3-word windows.
    """
    votes = [vote(r).alias(f"__v{j}") for j, r in enumerate(rules)]
    names = [f"__v{j}" for j in range(len(rules))]
    counted = counts(df, columns, text_column)
    if keep_table:  # count once, and read the counts back
        counted = Workspace(df.sparkSession, "quality").write(counted)
    pattern_rows = counted.select(*votes).groupBy(*names).count().collect()  # at most 3^rules rows
    places = {name: j for j, (name, _, _) in enumerate(rules)}
    share, rates = fit({tuple(r[:-1]): r[-1] for r in pattern_rows}, [[places[name] for name in kind if name in places] for kind in kinds.values()]) if pattern_rows else fit({(0,) * len(rules): 0}, [[]] * len(kinds))
    # How much likelier than good each kind is.
    odds = F.lit(0.0)
    for c in range(1, len(share)):
        z = F.lit(math.log(share[c] / share[0]))
        for j, name in enumerate(names):
            z = z + F.when(F.col(name) < 0, math.log(rates[c, j] / rates[0, j])).when(F.col(name) > 0, math.log((1 - rates[c, j]) / (1 - rates[0, j]))).otherwise(0.0)
        odds = odds + F.exp(z)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.select(*columns, *BASE_COLUMNS, failed.alias("base_failed"), *votes).withColumn("quality", 1 / (1 + odds)).drop(*names)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
