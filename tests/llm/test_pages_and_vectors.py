"""Page text and nearest neighbours."""

import numpy as np
from pyspark.sql import functions as F
from taxaflow.llm import ann, html_extract

NAV = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"


def page(article, foot="<footer>&copy; site</footer>"):
    return f"<html><head><title>t</title><script>var t='</p>';</script></head><body>{NAV}{article}<div class='x'><b>Same on each page</b></div>{foot}</body></html>"


def test_extract(spark):
    rows = [
        (1, "https://a.example/1", page("<article><h1>Head</h1><p>One <b>two<p>Three &amp; four<br>five</article>"), "Head\nOne two\nThree & four\nfive"),
        (2, "https://a.example/2", page("<main><p>Text  here.</p><form>Name <input></form><aside>side</aside></main>"), "Text here."),
        (3, "https://a.example/3", page("<article><p>Body</p><div class='comments'><p>first!</p></div><script>x</script></article>"), "Body"),
        (4, None, None, ""),
        (5, "odd", "", ""),
        (6, "https://a.example/6", page("<p>No article here</p>"), "No article here"),
        (7, "https://a.example/7", page("<p>Nor here</p>"), "Nor here"),
        (8, "https://a.example/8", "plain &lt;text&gt; without markup", "plain <text> without markup"),
        (9, "https://a.example/9", page("<article><p>Last"), "Last"),  # never closed, so the block that recurs lies inside
    ]
    df = spark.createDataFrame([(*r[:3], "c") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for i, url, _, text in rows:
        assert (got[i].url, got[i].n_chars) == (url, len(got[i].text))
        assert got[i].text == text
    assert html_extract.extract(df.limit(0)).count() == 0


def extracted(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    return [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_recurring_blocks_of_articles(spark, monkeypatch):
    block = "<div class='x1'><h3>Stay in touch</h3><p>Write to us.</p></div>"
    rows = [("http://a.example/", f"<article><h1>Head {i}</h1><p>Own words {i}</p><p>A common line</p>{block}<p>Printed on paper</p></article><article class='related'><p>Other</p></article><article><p>Second {i}</p></article>") for i in range(8)]
    rows += [("http://b.example/", "<article><p>Alone</p><p>A common line</p></article>")]
    # Copies of one article with one changed line are no template.
    rows += [("http://c.example/", f"<article><h1>Copied</h1><p>The same long words</p><ul><li>item</li></ul><p>v{i}</p></article>") for i in range(8)]
    # An article that is all template leaves the text to the others.
    rows += [("http://a.example/", f"<article>{block}</article><main><p>Rest {i}</p></main>") for i in range(2)]
    want = [f"Head {i}\nOwn words {i}\nA common line\nSecond {i}" for i in range(8)] + ["Alone\nA common line"]
    want += [f"Copied\nThe same long words\nitem\nv{i}" for i in range(8)] + ["Rest 0", "Rest 1"]
    assert extracted(spark, rows) == want
    monkeypatch.setattr(html_extract, "HOST_HASHES", 0)
    assert extracted(spark, rows) == want


def test_sections_of_a_large_host(spark):
    """The menu of each section is on a hundredth of the host's pages."""
    rows = [("http://big.example/", f"<div><b>Menu of section {i % 100}</b></div><p>Text {i}</p>") for i in range(1000)]
    assert extracted(spark, rows) == [f"Text {i}" for i in range(1000)]


def test_deep_and_broken_markup():
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</span></p>", set())[0] == "deep"
    assert html_extract.main_text("a <b", set())[0] == "a"


def test_counts_decide_without_any_known_tag_or_class(spark):
    """Against brute force: a block goes where it stands on LEAST_PAGES pages of its host or more."""
    blocks = {f"block {k}": k for k in range(1, 13)}  # text: on how many pages of the host
    rows = []
    for i in range(12):
        own = "".join(f"<div><span>{text}</span></div>" for text, n in blocks.items() if i < n)
        rows.append(("http://one.example/", f"<div>{own}<p>Text of page {i}</p></div>"))
    rows += [("http://two.example/", "<div><div><span>block 12</span></div><p>Alone here</p></div>")]
    want = ["\n".join([t for t, n in blocks.items() if i < n < html_extract.LEAST_PAGES] + [f"Text of page {i}"]) for i in range(12)]
    assert extracted(spark, rows) == want + ["block 12\nAlone here"]


def test_marked_blocks_are_counted_too(spark):
    rows = [("http://a.example/", page(f"<article><p>Text {i}</p><div class='comments'><p>Mine {i}</p></div></article>")) for i in range(8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    got = html_extract.extract(df).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"Text {i}" for i in range(8)]
    assert all(r.n_recurring >= 3 and r.n_marked >= 1 for r in got)


def test_parallel_vectors_and_equal_ones(spark):
    """Ties go to the smallest ids, whichever of equal vectors holds them."""
    rows = [(0, [1.0, 0.0])] + [(i, [float(1 << (i % 20)), 0.0]) for i in range(29, 0, -1)] + [(40 + i, [1.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(i, i, 1.0) for i in range(1, 6)]


def test_graph_of_several_levels_finds_neighbours():
    rng = np.random.default_rng(3)
    x = ann.unit(rng.normal(size=(3000, 24))).astype(np.float32)
    levels, links = ann.build(x)
    assert len(links) >= 3 and all((level[levels >= k] >= -1).all() for k, level in enumerate(links))
    got = ann.search(x[:100], x, levels, links, ann.SEARCH_WIDTH)
    true = np.argsort(-(x[:100] @ x.T), 1)[:, :5]
    assert np.mean([len({*a} & {*b}) / 5 for a, b in zip(got, true)]) > 0.95


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and i is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 50 == 0:
            score = {i: float(v @ ok[q] / (np.linalg.norm(v) * np.linalg.norm(ok[q]))) for i, v in ok.items() if i != q}
            out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(9)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (None, [1.0] * 16), (3050, [])]
    rows += [rows[7]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, key int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, shard=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert got[50] == [2000, 2001, 2002, 2003, 2004]
    assert sum(len({*got[q]} & {*want[q]}) for q in want) >= 0.95 * 5 * len(want)
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 2
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_no_row_is_wider_than_a_vector(spark, monkeypatch):
    """Graphs and queries meet in a task: nothing is joined to a graph, and batches of any size and vectors of several lengths give the same."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    kept = {d: rng.normal(size=(n, d)) for d, n in ((3, 40), (5, 70), (8, 0))}
    asked = {d: rng.normal(size=(9, d)) for d in (3, 5, 8)}
    rows = [(d, a, f"{d}-{a}-{i}", v.tolist(), None if a else i) for d in (3, 5, 8) for a, x in ((False, kept), (True, asked)) for i, v in enumerate(x[d])]
    schema = pa.schema([("dims", pa.int32()), ("asked", pa.bool_()), ("key", pa.string()), ("v", pa.list_(pa.float64())), ("least", pa.int64())])
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for size in (7, 1000):
        got = [r for b in ann.searched([whole.slice(i, size) for i in range(0, len(rows), size)], 2) for r in b.to_pylist()]
        assert len(got) == 2 * 9 * 3 and not any(r["asked"].startswith("8") for r in got)
        for d in (3, 5):
            sims = ann.unit(asked[d]) @ ann.unit(kept[d]).T
            for i in range(9):
                mine = [r for r in got if r["asked"] == f"{d}-True-{i}"]
                assert [r["least"] for r in mine] == np.argsort(-sims[i])[:3].tolist() and np.allclose([r["score"] for r in mine], np.sort(-sims[i])[:3] * -1)
    plans = []
    write = ann.Workspace.write
    monkeypatch.setattr(ann.Workspace, "write", lambda ws, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(ws, df))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(kept[5])], "vec_id bigint, embedding array<double>")
    assert ann.nearest(df, F.col("vec_id") < 4, shard=20).count() == 20
    assert not any("Join" in p for p in plans[:-1]) and not any("collect_list" in p for p in plans)
