"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language by forward-backward: emissions are sums of learned weights of its affixes,
character n-grams and its whole form (the lexicon), transitions between languages are learned too, from texts spliced
together, so code-switched text is labelled word by word. A document's language has the largest mean posterior.

The field is fitted on a bounded sample of labelled rows (FIT_DOCS whole texts of each language, a small closed set)
on the driver; prediction covers whole texts. Null text, or text without a letter: `und` with score 0, as for every
text when there is nothing to learn from. Bytes that are no UTF-8 count as U+FFFD. Very long texts are walked in
blocks of BLOCK words. Ties go to the first language in order. Rows repeat as in the input. `columns` may not be named
lang_pred or score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Labelled documents of each language that the field is fitted on, and how many times as many a first cut by hash leaves.
FIT_DOCS, SPARE = 300, 4
#: Languages that a fit learns: those with the most labelled documents, by name where they have equally many. Rarer values
#: of a dirty column are not learned.
MOST_LANGS = 200
#: Hashed weights of one kind of feature.
SIZE = 1 << 16
#: Words in a block of the blocked forward-backward pass.
BLOCK = 64
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that belong to words: ASCII letters and all bytes of other characters.
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_P = np.uint32(0x9E3779B1)
_INVERSE = np.uint32(pow(0x9E3779B1, -1, 1 << 32))
_BYTES = np.random.default_rng(3).integers(0, 2**32, 256, dtype=np.uint32)


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # kinds x (SIZE, then a row of zeros) x languages
    transitions: np.ndarray  # languages x languages, log


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(indices by kind and position, indices of whole words, position where each word starts, words of each text).

    The kinds are pairs, triples and quadruples of bytes that end at a position, with the blanks around a word (so
    that affixes are features). Index -1: no feature.
    """
    coded = [t.lower().encode().translate(_KEEP) for t in texts]
    counts = np.array([len(c.split()) for c in coded], np.int64)
    b = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
    inside = b != 32
    here = inside.copy()
    here[1:] |= inside[:-1]  # a word's letters and the blank after it
    x = b.astype(np.uint32)
    p1, p2, p3 = (np.concatenate([np.full(k, 32, np.uint32), x[:-k]]) for k in (1, 2, 3))
    in1 = np.concatenate([[False], inside[:-1]])
    in2 = np.concatenate([[False, False], inside[:-2]])
    pair = x * np.uint32(256) + p1
    triple = ((pair * np.uint32(256) + p2) * _P) >> np.uint32(16)
    quad = (((pair ^ (p2 << np.uint32(16)) ^ (p3 << np.uint32(24))) * _P) ^ (p3 * np.uint32(40503))) >> np.uint32(16)
    starts = np.flatnonzero(inside & ~in1)
    ends = np.flatnonzero(~inside & in1)
    index = np.stack([pair & np.uint32(SIZE - 1), triple, quad]).astype(np.int32)
    index[0][~here] = index[1][~(here & in1)] = index[2][~(here & in1 & in2)] = -1
    # A word as a whole: a polynomial in its bytes, taken from running sums and shifted to the word's start.
    up, down = (np.multiply.accumulate(np.full(len(b), x, np.uint32), dtype=np.uint32) for x in (_P, _INVERSE))
    total = np.cumsum(_BYTES[b] * up, dtype=np.uint32)
    whole = (total[ends - 1] - total[starts - 1]) * down[starts]
    index_words = ((whole * _P) >> np.uint32(16)).astype(np.int32)
    return index, index_words, starts, counts


def words_of(text: str) -> list[str]:
    """The words that `features` sees."""
    return [w.decode() for w in text.lower().encode().translate(_KEEP).split()]


def emissions(index: np.ndarray, index_words: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """words x languages"""
    if not len(starts):
        return np.zeros((0, weights.shape[2]), np.float32)
    at = weights[0][index[0]]  # -1: the last row, which is zero
    at += weights[1][index[1]]
    at += weights[2][index[2]]
    return np.add.reduceat(at, starts, 0) + weights[3][index_words]


def posteriors(emission: np.ndarray, transitions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """words x languages, by forward-backward over each text; counts: the words of each text.

    Texts are cut into blocks. The product of a block's matrices carries messages over it, so all blocks run side by side
    and only block borders are walked in order.
    """
    n, size = emission.shape
    if not n:
        return emission.astype(float)
    step = np.exp(transitions - transitions.max())
    local = np.exp((emission - emission.max(1, keepdims=True)).astype(float))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    per_text = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = first[text] + nth * BLOCK
    length = np.minimum(BLOCK, counts[text] - nth * BLOCK)
    order = np.argsort(-length, kind="stable")
    start, length, nth, text = start[order], length[order], nth[order], text[order]
    active = [int(np.searchsorted(-length, -t)) for t in range(BLOCK)]  # blocks longer than t come first
    carry = np.tile(np.eye(size), (len(start), 1, 1))
    for t in range(BLOCK):
        if k := active[t]:
            carry[:k] = (carry[:k] @ step) * local[start[:k] + t][:, None, :]
            carry[:k] /= carry[:k].max((1, 2), keepdims=True)
    ahead, back = np.full((len(start), size), 1 / size), np.ones((len(start), size))
    where = {}
    for at in range(int(per_text.max())):
        where[at] = np.flatnonzero(nth == at)
        where[at] = where[at][np.argsort(text[where[at]])]
    for at in range(1, int(per_text.max())):
        now = where[at]
        before = where[at - 1][np.searchsorted(text[where[at - 1]], text[now])]
        v = np.einsum("bi,bij->bj", ahead[before], carry[before])
        ahead[now] = v / v.sum(1, keepdims=True)
    for at in range(int(per_text.max()) - 1, 0, -1):
        now = where[at]
        before = where[at - 1][np.searchsorted(text[where[at - 1]], text[now])]
        v = np.einsum("bij,bj->bi", carry[now], back[now])
        back[before] = v / v.sum(1, keepdims=True)
    out = np.empty((n, size))
    for t in range(BLOCK):
        if k := active[t]:
            v = (ahead[:k] @ step) * local[start[:k] + t]
            ahead[:k] = v / v.sum(1, keepdims=True)
            out[start[:k] + t] = ahead[:k]
    for t in range(BLOCK - 1, -1, -1):
        if k := active[t]:
            at = start[:k] + t
            out[at] *= back[:k]
            v = (local[at] * back[:k]) @ step.T
            back[:k] = v / v.sum(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


def fit(sample: list[tuple[str, str]], seed: int = 5, sequences: int = 1200, words: int = 96, rounds: int = 5) -> Field | None:
    """The field of labelled texts (lang, text), by gradient ascent on the conditional likelihood of spliced texts."""
    langs = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(seed)
    by = [[w for w in (t.split() for lang, t in sample if lang == name) if w] for name in langs]
    if not any(by):
        return None
    langs, by = [x for x, y in zip(langs, by) if y], [y for y in by if y]
    texts, labels = [], []
    for _ in range(sequences):
        out: list[str] = []
        tags: list[int] = []
        while len(out) < words:
            lang = int(rng.integers(len(langs)))
            own = by[lang][int(rng.integers(len(by[lang])))]
            at, take = int(rng.integers(len(own))), int(rng.integers(8, 72))
            part = words_of(" ".join(own[at : at + take]))
            out += part
            tags += [lang] * len(part)
            if not part:
                out.append("x")
                tags.append(lang)
        texts.append(" ".join(out[:words]))
        labels.append(tags[:words])
    size = len(langs)
    truth = np.eye(size)[np.array(labels)]
    weights, transitions = np.zeros((4, SIZE + 1, size), np.float32), np.zeros((size, size))
    seen_w, seen_t = np.full(weights.shape, 1e-2, np.float32), np.full(transitions.shape, 1e-2)
    group = 100
    cut = [features(texts[k : k + group]) for k in range(0, sequences, group)]
    for _ in range(rounds):
        for k, (index, index_words, starts, counts) in enumerate(cut):
            gold = truth[k * group : k * group + len(counts)]
            e = emissions(index, index_words, starts, weights).reshape(len(counts), words, size).astype(float)
            gamma, pairs = _expected(e, transitions)
            wrong = (gold - gamma).reshape(-1, size) / group
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, index.shape[1])))
            for kind in range(4):
                ids, rows = (index[kind, starts[0] :], of) if kind < 3 else (index_words, np.arange(len(starts)))
                ids, rows = ids[ids >= 0], rows[ids >= 0]
                for j in range(size):
                    own, seen = weights[kind, :SIZE, j], seen_w[kind, :SIZE, j]
                    grad = np.bincount(ids, wrong[rows, j], SIZE).astype(np.float32) - 1e-6 * own
                    seen += grad**2
                    own += 0.1 * grad / np.sqrt(seen)
            grad = (np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:]) - pairs) / group
            seen_t += grad**2
            transitions += 0.3 * grad / np.sqrt(seen_t)
    return Field(langs, weights, transitions)


def decide(field: Field, texts: list[str]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    index, index_words, starts, counts = features(texts)
    gamma = posteriors(emissions(index, index_words, starts, field.weights), field.transitions, counts)
    out = []
    for text, c, e in zip(texts, counts, np.cumsum(counts)):
        if not c or not _LETTER.search(text):
            out.append(("und", 0.0))
            continue
        share = gamma[e - c : e].mean(0)
        out.append((field.langs[int(share.argmax())], min(1.0, float(share.max()))))
    return out


def _expected(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of sequences of equal length and the expected count of each transition."""
    step, local = np.exp(transitions - transitions.max()), np.exp(e - e.max(2, keepdims=True))
    length, size = e.shape[1:]
    ahead, back = np.empty_like(local), np.ones_like(local)
    v = np.full((len(e), size), 1 / size)
    for t in range(length):
        v = (v @ step) * local[:, t]
        v /= v.sum(1, keepdims=True)
        ahead[:, t] = v
    for t in range(length - 1, 0, -1):
        v = (local[:, t] * back[:, t]) @ step.T
        back[:, t - 1] = v / v.sum(1, keepdims=True)
    gamma = ahead * back
    gamma /= gamma.sum(2, keepdims=True)
    pairs = ahead[:, :-1, :, None] * step * (local[:, 1:] * back[:, 1:])[:, :, None, :]
    pairs /= pairs.sum((2, 3), keepdims=True)
    return gamma, pairs.sum((0, 1))


def fit_on(df: DataFrame, learn_from: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Field | None:
    """The field fitted on a bounded sample of the rows that learn_from holds for: those of least hash in each language."""
    from pyspark.sql import Window

    usable = df.where(learn_from & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    usable = usable.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"), F.xxhash64(id_column, text_column).alias("hash"))
    # Hashes are even, so this bound leaves about SPARE times as many rows as are wanted, however many a language has.
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), (F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(float(FIT_DOCS * SPARE)) / F.count("*")) - 2.0**63).alias("bound"))
    bounds = df.sparkSession.createDataFrame(counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect(), counts.schema)
    near = usable.join(F.broadcast(bounds), "lang").where(F.col("hash").cast("double") <= F.col("bound"))
    order = Window.partitionBy("lang").orderBy("hash", "text")
    rows = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIT_DOCS).select("lang", "text", "hash").collect()  # FIT_DOCS of each language
    return fit([(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.hash, r.text))])


def label_words(field: Field, texts: list[str]) -> list[list[tuple[str, str, float]]]:
    """For each text its words with their language and its posterior."""
    index, index_words, starts, counts = features(texts)
    gamma = posteriors(emissions(index, index_words, starts, field.weights), field.transitions, counts)
    best, ends = gamma.argmax(1), np.cumsum(counts)
    words = [words_of(t) for t in texts]
    return [[(w, field.langs[best[e - c + i]], float(gamma[e - c + i].max())) for i, w in enumerate(ws)] for ws, c, e in zip(words, counts, ends)]


def predict(df: DataFrame, field: Field | None, columns: list[str], text_column: str = "text") -> DataFrame:
    """columns, lang_pred and score (mean posterior of that language over the text's words)."""
    shared = df.sparkSession.sparkContext.broadcast(field)  # 1 MB for each language

    def run(texts: Iterable[bytes | None]) -> Iterator[tuple]:
        own = shared.value
        texts = ["" if t is None else t.decode(errors="replace") for t in texts]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 500_000):
                size += len(texts[end])
                end += 1
            group, at = texts[at:end], end
            yield from (decide(own, group) if own else [("und", 0.0)] * len(group))

    return map_texts(df, columns, text_column, "lang_pred string, score double", run)
