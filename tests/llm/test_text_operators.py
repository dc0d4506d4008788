"""Operators on texts against brute force, on a small table with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from taxaflow.llm import byte_bpe, langid, license_scan, near_dedup, packing, quality_rules, token_counts, toxicity

BASE = "the quick brown fox jumps over the lazy dog while seven old men watch from a green hill near town".split()
ODD = [
    None, "", " \n\t ", "one", "One two", "one two", "Tie tie tie", "a" * 5000, "x y " * 4000, "naïve café — “quoted” 数据 don't stop's 1234 <|endoftext|> end",
    "tabs\tand\x1cseparators\x85here　now", "a b\na b\n\na b\nc", "#### $$$ %%% &&& " * 30,
    "it's l'été µm x²³ ¼cup ÀÉÎ ßtraße 99.5% 'tis we'll i'd a_b ª º × ÷ \xa0nbsp\xadsoft",
]


def near_copies(seed=3, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = list(BASE) * 2
        for _ in range(int(rng.integers(0, 7))):
            words[int(rng.integers(len(words)))] = f"w{rng.integers(1000)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = ODD + near_copies() + [" ".join(f"u{i}v{k}" for k in range(60)) for i in range(5)]
    return list(enumerate(texts)) + [(2, texts[2]), (None, "a null id"), (14, texts[14])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, 0.5) for i, t in rows], "doc_id bigint, text string, key string, node int, score double")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} - {()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, rows, size):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                comp[high] = low
    got = near_dedup.near_duplicates(docs, size=size).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(empty(spark), size=size).count() == 0


def test_borderline_copies_in_small_blocks(spark, monkeypatch):
    """A group whose members are each near few others: links are found one by one, over many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(21)
    words = [f"base{k}" for k in range(120)]
    rows = []
    for i in range(90):
        own = list(words)
        for k in rng.choice(120, int(rng.integers(3, 9)), replace=False):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t, 2) for i, t in rows}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    assert 1 < len({*comp.values()}) < 90
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 500), dtype=np.uint64)
    union = np.concatenate([a, b])
    assert (near_dedup.registers(union) == np.maximum(near_dedup.registers(a), near_dedup.registers(b))).all()
    x, y = union[:900], union[100:]
    rx, ry = near_dedup.registers(x, near_dedup.FINE), near_dedup.registers(y, near_dedup.FINE)
    best, keep = near_dedup.likely(np.array([(rx > ry).sum()], float), np.array([(rx < ry).sum()], float), np.array([900.0]), np.array([900.0]), 0.8, near_dedup.FINE)
    assert abs(best[0] - 0.8) < 0.06 and keep[0]


def test_last_comparison_keeps_links():
    """Registers of pairs whose similarity is 0.8 exactly: the last comparison drops none of them."""
    chance = lambda x: -np.log1p(-x * (near_dedup.BASE - 1) / near_dedup.BASE) / np.log(near_dedup.BASE)
    differ = chance(0.5 - 0.5 * 0.8)
    more, less, _ = np.random.default_rng(4).multinomial(near_dedup.FINE, [differ, differ, 1 - 2 * differ], size=50_000).T.astype(float)
    size = np.full(len(more), 900.0)
    _, keep = near_dedup.likely(more, less, size, size, 0.8, near_dedup.FINE, near_dedup.FINE_SLACK)
    assert keep.all()


def test_byte_bpe(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.encoding(path, public_tokenizers.PATTERN)
    want = Counter()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect())) == want
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in decoded) == Counter((i, (t or "").encode()) for i, t in rows)
    assert byte_bpe.round_trip(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_safe_pieces_join_to_the_text():
    text = "some words  and\n more " * 50
    pieces = list(byte_bpe.safe_pieces(text, 40))
    assert "".join(pieces) == text and len(pieces) > 5
    own = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [i for p in pieces for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_long_runs_encode_exactly():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.encoding(path, public_tokenizers.PATTERN)
    rng = np.random.default_rng(12)
    parts = ["a", "B", "é", "\n", " ", "  ", "\t", "中", "。", ",", "'s", "12", "…", " " * 600, "\n" * 700, " \n" * 400, "\x1c", "\xa0"]
    for _ in range(150):
        text = "".join(rng.choice(parts, int(rng.integers(0, 40))))
        assert [i for p, one in byte_bpe.matches_apart(text, 10) for i in byte_bpe.encoding(path, byte_bpe.ONE_MATCH if one else public_tokenizers.PATTERN).encode_ordinary(p)] == own.encode_ordinary(text)
    blanks = [i for ids in byte_bpe.ids_of(path, public_tokenizers.PATTERN, " " * 1_500_000 + "x") for i in ids]
    assert own.decode_bytes(blanks) == b" " * 1_500_000 + b"x"


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.round_trip(df, path, public_tokenizers.PATTERN).first().decoded_sha256 == hashlib.sha256("a�b".encode()).hexdigest()
    assert token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), 9).first().n_bytes == 3
    assert packing.best_fit(df, public_tokenizers.path("word_bpe_49k.json")).count() == 1
    assert quality_rules.judge(df, ["doc_id"]).first().n_words == 1


def test_token_counts(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = token_counts.tokenizer(path)
    want = Counter()
    for i, t in rows:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert Counter(map(tuple, token_counts.count_tokens(docs, path, 512).collect())) == want
    assert token_counts.count_tokens(empty(spark), path, 512).count() == 0


def test_packing(spark, docs, rows):
    path, capacity = public_tokenizers.path("word_bpe_49k.json"), 64
    own = token_counts.tokenizer(path)
    want, total = Counter(), 0
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.best_fit(docs, path, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = sorted((r.sequence_id, r["offset"], r.length) for r in got)
    ends = {}
    for sequence, offset, length in places:
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
    assert max(ends.values()) <= capacity and len(ends) <= 1.05 * -(-total // capacity) + 1
    assert packing.best_fit(empty(spark), path, capacity).count() == 0


def best_fit_decreasing(lengths, capacity):
    """Sequences of a plain best-fit: one piece after another, each into the smallest gap that holds it."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("lengths", ["mixed", "equal", "tiny", "one long"])
def test_sweeps_pack_as_tightly_as_plain_best_fit(spark, lengths):
    rng = np.random.default_rng(2)
    made = {"mixed": rng.integers(1, 101, 2000), "equal": np.full(900, 34), "tiny": rng.integers(1, 4, 2000), "one long": np.append(rng.integers(1, 5, 500), 50)}[lengths]
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(made)], "item bigint, length bigint")
    ws = packing.Workspace(spark, "test")
    rows = packing.pack(ws, ws.write(pieces), 100).join(pieces, "item").collect()
    assert sorted(r.item for r in rows) == list(range(len(made)))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r["offset"])):
        assert ends.get(r.sequence_id, 0) == r["offset"]
        ends[r.sequence_id] = r["offset"] + r.length
    assert max(ends.values()) <= 100 and len(ends) <= 1.01 * best_fit_decreasing(made, 100) + 1


def test_sequences_needed():
    assert packing.sequences_needed({50: 3}, {}, 100) == 2
    assert packing.sequences_needed({50: 3}, {60: 2, 49: 9}, 100) == 1
    assert packing.sequences_needed({1: 100, 90: 1}, {89: 2}, 100) == 1


def test_quality_counts(spark, docs, rows):
    want = Counter()
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed] += 1
    got = quality_rules.judge(docs, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules.judge(empty(spark), ["doc_id"]).count() == 0


def test_quality_model_separates_classes():
    """Two ways to be bad, three rules each; rules of a way go wrong together."""
    rng = np.random.default_rng(4)
    patterns, truth = Counter(), {}
    for _ in range(6000):
        kind = rng.choice(3, p=[0.85, 0.1, 0.05])
        votes = tuple(int(-1 if rng.random() < (0.8 if j // 3 == kind - 1 else 0.02) else 1) for j in range(6))
        patterns[votes] += 1
        truth.setdefault(votes, Counter())[kind == 0] += 1
    share, rates = quality_rules.fit(patterns, [[0, 1, 2], [3, 4, 5]])
    good = quality_rules.posterior(np.array(list(patterns), float), share, rates)[:, 0]
    wrong = sum(n for v, p in zip(patterns, good) for g, n in truth[v].items() if (p >= 0.5) != g)
    assert np.abs(share - [0.85, 0.1, 0.05]).max() < 0.03 and wrong < 120
    assert np.abs(rates - [[0.02] * 6, [0.8] * 3 + [0.02] * 3, [0.02] * 3 + [0.8] * 3]).max() < 0.08


def test_quality_verdicts(spark):
    """kept against plain expectation-maximisation over votes worked out in Python; more rules than one decide."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(3, 9))))
    texts = []
    for k in range(400):
        words = [word() for _ in range(int(rng.integers(55, 120)))]
        lines = [" ".join(words[i : i + 9]) + "." for i in range(0, len(words), 9)]
        if k % 10 == 0:
            lines = ["".join(c + "#" * int(rng.random() < 0.3) for c in x) for x in lines]
        if k % 10 == 0 and k % 20:
            lines = [" ".join("12$4" if rng.random() < 0.5 else w for w in x.split()) for x in lines]
        if k % 14 == 1:
            lines = lines[:4] * 2 + lines
        if k % 28 == 1:
            lines = [x.rstrip(".") for x in lines]
        texts.append("\n".join(lines))
    texts += [None, "", "short", "a b " * 200]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"]).collect()}

    names = [x.split()[0] for x in quality_rules._SCHEMA.split(", ")]

    def holds(rule, n):
        return eval(re.sub(r"(\w+) between (.+) and (.+)", r"\2 <= \1 <= \3", rule), {}, n)

    votes = []
    for t in texts:
        n = dict(zip(names, quality_rules.text_counts((t or "").encode())))
        votes.append([-1 if holds(bad, n) else 1 if holds(good, n) else 0 for _, good, bad in quality_rules.RULES])
    rules = [r[0] for r in quality_rules.RULES]
    kinds = list(quality_rules.KINDS.values())
    first = [[0.02] * len(rules)] + [[0.5 if r in k else 0.05 for r in rules] for k in kinds]
    share, rate = [0.9, 0.05, 0.05], first

    def classes(v):
        p = [s * np.prod([r[j] if x < 0 else 1 - r[j] for j, x in enumerate(v) if x]) for s, r in zip(share, rate)]
        return [x / sum(p) for x in p]

    for _ in range(400):
        p = [classes(v) for v in votes]
        new = [[(first[c][j] + sum(x[c] for x, v in zip(p, votes) if v[j] < 0)) / (1 + sum(x[c] for x, v in zip(p, votes) if v[j])) for j in range(len(rules))] for c in range(3)]
        share, rate = [(10 * s + sum(x[c] for x in p)) / (10 + len(p)) for c, s in enumerate((0.9, 0.05, 0.05))], new
    verdicts = {i: classes(v)[0] for i, v in enumerate(votes)}
    assert all(abs(got[i].quality - q) < 1e-4 for i, q in verdicts.items())
    assert {i for i, r in got.items() if r.kept} == {i for i, q in verdicts.items() if q >= 0.5 and not got[i].base_failed}
    moved = {j for j in range(len(rules)) for v, q in zip(votes, verdicts.values()) if v[j] and (classes(v[:j] + [0] + v[j + 1 :])[0] >= 0.5) != (q >= 0.5)}
    assert len(moved) >= 2


def test_language_id(spark):
    rng = np.random.default_rng(5)
    stems = {"aa": "ka lo mi tu re".split(), "bb": "sch ung ver ein lich".split()}
    make = lambda lang: " ".join("".join(rng.choice(stems[lang], 2)) for _ in range(40))
    rows = [(i, make("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(80)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 !!", "aa"), (103, rows[0][1] * 30, None), (104, rows[1][1], None), (None, rows[1][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    from taxaflow.llm.common import crc_fold

    field = langid.fit_on(df, crc_fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in langid.predict(df, field, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:80])
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = langid.label_words(field, [rows[0][1] + " " + rows[1][1]])[0]
    assert [x[1] for x in mixed][5:35] == ["bb"] * 30 and [x[1] for x in mixed][45:75] == ["aa"] * 30
    assert langid.fit_on(empty(spark), crc_fold("doc_id", 3) != 1) is None
    assert {r.lang_pred for r in langid.predict(df, None, ["doc_id"]).collect()} == {"und"}


def test_languages_that_are_rare_are_not_learned(spark, monkeypatch):
    """A dirty column: the most frequent values are learned, ties by name."""
    rows = [(i, "kalo mitu relo", "aa") for i in range(9)] + [(20 + i, "schung verein", "bb") for i in range(5)] + [(40 + i, "xyz", f"x{i:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    assert list(langid.fit_on(df, F.lit(True)).langs) == ["aa", "bb", "x00"]


def test_blocked_posteriors_equal_plain_ones():
    rng = np.random.default_rng(6)
    counts = np.array([0, 1, 64, 65, 200, 3])
    e, a = rng.normal(size=(counts.sum(), 3)), rng.normal(size=(3, 3))
    got, at = langid.posteriors(e, a, counts), 0
    for c in counts:
        if c:
            assert np.allclose(got[at : at + c], langid._expected(e[None, at : at + c], a)[0][0])
        at += c


def test_levenshtein_trie():
    trie = toxicity.Trie(["idiot", "moron", "trash"])
    assert trie.near("idot", 1) == ["idiot"] and trie.near("idiott", 1) == ["idiot"] and trie.near("moran", 1) == ["moron"] and trie.near("ideas", 1) == []


def test_toxicity(spark):
    rng = np.random.default_rng(7)
    plain = "lamp river stone cloud paper window garden music".split()
    bad = "zorgul krifnax bloomer".split()
    rows = []
    for i in range(400):
        words = [f"{rng.choice(plain)}{rng.integers(90)}" if rng.random() < 0.3 else str(rng.choice(plain)) for _ in range(40)]
        if toxic := i % 5 == 0:
            for _ in range(3):
                words[int(rng.integers(40))] = str(rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    rows += [(500, None, None), (501, "", None), (502, "you krifnax you zorgul krifnax", None), (503, "you krifnx", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    from taxaflow.llm.common import crc_fold

    model = toxicity.fit_on(docs, labels, crc_fold("doc_id", 4) != 2)
    assert {*bad} <= {*model.lexicon.words}
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all(got[i].predicted == t for i, _, t in rows[:400])
    assert got[500].predicted == got[501].predicted == 0 and got[502].predicted == 1 and got[503].n_hits_misspelled == 1
    quoted = spark.createDataFrame([(1, 'he said "zorgul" and "krifnax" of the lamp'), (2, "lamp zorgul and krifnax of the river"), (3, "lamp zorgull and krfnax of the river"), (4, "don’t zorgul krifnax can’t")], docs.schema)
    marks = {r.doc_id: r for r in toxicity.score(quoted, model, ["doc_id"]).collect()}
    assert [marks[i].predicted for i in (1, 2, 3, 4)] == [0, 1, 1, 1] and marks[1].n_hits_quoted == 2 and marks[3].n_hits_misspelled == 2
    assert marks[1].score < got[501].score
    assert toxicity.fit_on(docs, labels.limit(0), crc_fold("doc_id", 4) != 2) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}


def test_license_scan(spark):
    filler = " ".join(f"w{k}" for k in range(300))
    rows = [(1, filler + ". Released under the MIT License. " + filler), (2, "This work is licensed under the GNU General Public License, version 3."), (3, filler), (4, None), (5, ""), (6, "the MIT")]
    rows += [(7, "RELEASED   under\nthe (MIT) license"), (7, "RELEASED   under\nthe (MIT) license"), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")
    got = {(r.doc_id, r.license) for r in license_scan.scan(df).collect()}
    assert got == {(1, "MIT"), (2, "GPL-3.0"), (7, "MIT"), (None, "CC-BY-NC-4.0")}
    assert license_scan.scan(empty(spark)).count() == 0
