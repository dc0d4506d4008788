"""Runs against a plain scan of every period, and the query against a plain model of its digests."""

import hashlib
import random
import re
import zlib

import pytest
from taxaflow.llm import periodic_runs, queries


def brute(words, least_words=6, least_periods=4):
    """start, length, period of the maximal stretches of each period that have no smaller one."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least_words, least_periods * q) and not any(all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(8))
def test_every_run(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(rng.choice([0, 1, 3, 8, 20, 60]))]
            if rng.random() < 0.5:
                words = periodic_runs.looped(words, rng.randrange(1000))
            texts.append(words + words[: len(words) // 2] * rng.choice([0, 0, 3]))
        for least in ((2, 2), (6, 4)):
            assert [[tuple(r) for r in x.tolist()] for x in periodic_runs.found_runs(texts, *least)] == [brute(w, *least) for w in texts]


@pytest.mark.parametrize("words", [fibonacci(300), [b"a"] * 200, [b"a", b"a", b"b"] * 70, [b"a", b"b"] * 20 + [b"c"] + [b"b", b"a"] * 20], ids=["fibonacci", "one word", "three", "two runs"])
def test_structured(words):
    assert [tuple(r) for r in periodic_runs.found_runs([words], 2, 2)[0].tolist()] == brute(words, 2, 2)


def test_very_long_texts():
    """One word, and a loop of a long period, in a million words."""
    assert periodic_runs.found_runs([[b"w"] * 1_000_000])[0].tolist() == [[0, 1_000_000, 1]]
    loop = [b"%d" % i for i in range(100_000)] * 5
    assert periodic_runs.found_runs([loop])[0].tolist() == [[0, 500_000, 100_000]]


def test_query(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "a\xa0b c\x1cd " * 9, "é 数据 " * 30, "x " * 300]
    texts += [" ".join(str(rng.randrange(rng.choice([3, 50]))) for _ in range(rng.randint(1, 150))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(None, "z z z z z z z"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(*r, 0, 0, "k") for r in rows], "doc_id bigint, text string, runs int, period int, collapsed string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h = None if i is None else zlib.crc32(str(i).encode())
        if words and h is not None and h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute(words)
        gone = {k for start, length, q in found for k in range(start + q, start + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found).encode(), b" ".join(w for k, w in enumerate(words) if k not in gone))]
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests))
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 8
    assert periodic_runs.find_runs(df.limit(0), ["doc_id"]).count() == 0
