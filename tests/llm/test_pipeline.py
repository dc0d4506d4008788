"""The pipeline keeps clean documents, drops junk and all but one copy, and packs the rest."""

import corpus_pipeline
import numpy as np


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocabulary = {"en": [f"th{a}{b}" for a in "aeiou" for b in "rstnl"], "de": [f"{a}{b}ch" for a in "bdfgk" for b in "aeiou"]}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang], 80)) + "."
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(120)]
    junk = [(200 + i, " ".join(w + "###" for w in text("en").split()), "en") for i in range(12)]
    rows += junk + [(300, rows[3][1], "en"), (301, "", "en"), (302, None, None)]
    df = spark.createDataFrame([(*r, "src", 1, "mine") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] == {r[0] for r in rows} - {301, 302}
    assert kept[1] == kept[0] - {r[0] for r in junk}
    assert kept[2] == kept[1] - {300}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept[2]
    assert corpus_pipeline.STAGES[0][1](spark, df.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_by_row(spark):
    """Rows that repeat an id, have none, or repeat another row, against a plain model of the stage."""
    text = lambda seed: " ".join(np.random.default_rng(seed).choice([f"w{k}" for k in range(400)], 60))
    rows = [(7, text(1)), (7, text(2)), (3, text(1)), (9, text(2)), (5, text(3)), (5, text(3)), (None, text(4)), (8, text(4)), (6, ""), (4, None), (2, "w " * 200_000)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, key int")
    best = {}
    for k, (i, t) in enumerate(rows):
        name = t or f"none {k}"
        best[name] = min(best.get(name, (10**9, 0)), (-1 if i is None else i, k))
    got = corpus_pipeline.deduplicated(spark, df, "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got) == sorted((i, rows[k][1] or "") for i, k in best.values())
    assert corpus_pipeline.deduplicated(spark, df.limit(0), "").count() == 0
