import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
from colloquy.llm import html_text, mixing, neighbours, quality, toxicity
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(size, cap=3):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(size.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(cap * size[s])
            free.discard(s)
        left = sum(size.values()) - sum(out.values())
    return out


def test_mix_meets_its_targets(docs_of):
    r = random.Random(1)
    docs = []
    for i in range(400):
        source = r.choice(["a", "a", "a", "b", "é", "z", None])
        docs.append((i, " ".join(["w"] * r.choice([1, 2, 3, 5, 40, 300])), source))
    docs += [(900, None, "a"), (901, "", "b"), (None, "no id", "b"), (5, "same id", "z"), (5, "same id", "z"), (902, "\x1f \t one", "tiny")]
    got = mixing.mix(docs_of(docs)).collect()
    again = mixing.mix(docs_of(docs).repartition(3)).collect()
    key = lambda rows: sorted((str(x.doc_id), x.size, x.taken) for x in rows)
    assert key(got) == key(again) and len(got) == len(docs)
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(size)
    by_size = {v: s for s, v in size.items()}
    assert len(by_size) == len(size)
    taken = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size and abs(x.target - want[by_size[x.source_size]]) < 1e-6
        taken[by_size[x.source_size]] = taken.get(by_size[x.source_size], 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in want), (taken, want)


def test_large_classes_are_ranked_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    docs = [(i, "one two three", "a") for i in range(100)] + [(i, "one two three", "b") for i in range(200, 260)]
    got = mixing.mix(docs_of(docs)).collect()
    assert sum(x.taken for x in got if x.doc_id < 100) == round(480 / 3 / 3) * 3 == 159
    assert sum(x.taken for x in got if x.doc_id >= 200) == round(320 / 3) * 3


def test_tilts_solve_the_dual_and_decide_the_copies(docs_of, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join(["w"] * r.choice([1, 2, 3, 8, 20, 90])), r.choice("aaab")) for i in range(500)]
    got = mixing.mix(docs_of(docs)).collect()
    for target in {x.target for x in got}:
        own = [x for x in got if x.target == target]
        sizes, mean = np.array([x.size for x in own]), np.mean([x.size for x in own])
        low, high = -60.0, 60.0 * mean
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * np.minimum(3, np.exp(mid * sizes / mean))).sum() < target else (low, mid)
        assert all(abs(x.rate - min(3, np.exp(low * x.size / mean))) < 1e-6 for x in own)
        for size in set(sizes):
            copies = sum(x.copies for x in own if x.size == size)
            assert abs(copies - sum(x.rate for x in own if x.size == size)) <= 100 / size + 1
    assert len({round(x.rate, 6) for x in got}) > 6
    plain = {x.doc_id: x.taken for x in got}
    monkeypatch.setattr(mixing, "document_rate", lambda size, tilt, mean, cap: F.least(F.lit(3.0), F.exp(tilt / 2)))
    assert plain != {x.doc_id: x.taken for x in mixing.mix(docs_of(docs)).collect()}


def test_mixed_documents_repeat_rows(docs_of):
    rows = [(1, "a b c", "a"), (2, "a b", "b"), (2, "a b", "b"), (3, "", "b"), (None, None, None), (4, "a b c d e f", "a"), (5, "one", "c")]
    docs = docs_of(rows).withColumnsRenamed({"mark": "_x0", "h": "_x5", "id": "copies"})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for x in mixing.mix(docs).collect():
        copies[x.doc_id] += x.copies
    assert Counter(x.doc_id for x in out.collect()) == +copies and copies[2] and copies[3] == 1
    assert mixing.mixed_documents(docs_of([])).count() == 0 and mixing.mix(docs_of([])).count() == 0


def labelled(n, seed):
    r = random.Random(seed)
    syll = ["an", "er", "tion", "ha", "lo", "mi", "st", "re", "ou", "en"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randrange(20, 120))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "stupid", "zargh", "blornt"]))
        if not good:
            words = [words[0]] * len(words) if i % 8 else [w + "###" for w in words]
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_scores_on_held_out_rows(spark, docs_of):
    docs, labels = labelled(900, 6)
    odd = [(5000, None), (5001, ""), (None, "no id"), (7, docs[7][1]), (5002, "You idiot! " * 20_000)]
    table = docs_of(docs + odd)
    known = spark.createDataFrame(labels + [(7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for f, at, folds, out, cut in ((quality.score_quality, 0, 5, 0, 0.3), (toxicity.score_toxicity, 1, 3, 1, 0.7)):
        rows = f(table, known).collect()
        assert len(rows) == len(docs) + len(odd)
        assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= cut) for x in rows)
        assert all(x.held_out == (x.doc_id is None or crc32(str(x.doc_id).encode()) % folds == out) for x in rows)
        held = [x.predicted == truth[x.doc_id][at] for x in rows if x.held_out and x.doc_id in truth]
        assert len(held) > 100 and np.mean(held) > 0.95
    kept = toxicity.without_toxic(table, known)
    assert kept.columns == table.columns and kept.where("doc_id = 5001").count() == 1


def test_scores_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)], none.schema)
    docs = docs_of([(i, f"text {i}") for i in range(30)])
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(docs, none).count() == 30 and f(docs, one).count() == 30 and f(docs_of([]), one).count() == 0


def test_isotonic_rises_and_keeps_the_mean():
    r = np.random.RandomState(0)
    s, w = r.normal(size=500).round(1), r.rand(500) + 0.1
    y = (r.rand(500) < 1 / (1 + np.exp(-s))).astype(float)
    at, value = toxicity.isotonic(s, y, w)
    fit = value[np.searchsorted(at, s, "right") - 1]
    assert (np.diff(value) > 0).all() and abs((fit * w).sum() - (y * w).sum()) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies &amp; more.</div><article><h1>Head &amp; line</h1><p>First <b>para</b> of   the
article, with&nbsp;some length to it.</p><div class="ad">Buy now, a very good offer for everyone who reads this.</div>
<p>Short.<br><p>Second &lt;para&gt; is here &#8212; <a href="x">linked</a> once.<form><input><button>Send</button></form></article>
<aside>Related things to read</aside><section id="comments"><p>A reader says that this is a long comment about it.</p></section>
<footer>&copy; nobody</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE).split("\n") == ["Head & line", "First para of the article, with some length to it.", "Short.", "Second <para> is here — linked once."]


def test_main_text_of_broken_pages(spark):
    for html, want in ((None, ""), ("", ""), ("<p>Some text that is long enough to be content", "Some text that is long enough to be content"), ("<p>A longer text stands here for you <a href='x", "A longer text stands here for you"), ("a < b", None), ("<!-- open", "")):
        assert want is None or html_text.main_text(html) == want
    big = "<article>" + "<p>" + "word " * 200 + "</p>" + "<p>x</p>" * 3000 + "</article>"
    assert html_text.main_text(big).count("\n") == 3000
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in rows)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_names_alone_do_not_decide():
    long_ = "This paragraph is about it, and long enough to say that it is."
    for html, want in (
        ('<article><header class="entry-header"><h1>Title of it</h1></header><p>Text.</p></article>', ["Title of it", "Text."]),
        ('<article><h2 id="form-of-government">Form of government</h2><p id="search-engines">Short.</p></article>', ["Form of government", "Short."]),
        (f'<article><p>Body text.</p></article><div class="reader-feedback"><p>{long_}</p><p>{long_}</p></div>', ["Body text."]),
        ("<article><p>With <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>", ["With x=2 here."]),
        (f'<div class="page-with-sidebar"><div class="sidebar"><p>{long_}</p></div><div class="content"><p>A.</p><p>{long_}</p></div></div>', ["A.", long_]),
        (f'<main><div id="search"><p>{long_}</p><p>{long_}</p></div></main>', [long_, long_]),
        ("<article><p>" + "<b>" * 9 + '<a href="x">a b</a> c</p></article>', ["a b c"]),
    ):
        assert html_text.main_text(html).split("\n") == want


def test_the_cut_changes_labels():
    found, nodes = html_text.blocks(PAGE + "<article><p>Short</p><div>x</div><p>" + "Words of a text. " * 20 + "</p></article>")
    odds, near = html_text.graph(found, nodes)
    keep = html_text.minimum_cut(odds, near)
    changed = [b[0] for b, o, k in zip(found, odds, keep) if (o > 0) != k]
    assert "x" in changed and "A reader says that this is a long comment about it." in changed


def test_malformed_pages_take_linear_time():
    n = 40_000
    for html in ("<b>" * n + "x" + "</i>" * n, "<b>" * n + "<p>t" * n, '<a "' * n, "<div>" * n + "t" + "</div>" * n, "<ul>" + "<li>words" * n):
        began = time.process_time()
        html_text.main_text(html)
        assert time.process_time() - began < 5


def test_minimum_cut_matches_all_labellings():
    r = random.Random(8)
    for _ in range(60):
        n = r.randrange(1, 9)
        odds = [r.choice([-2, -0.6, -0.2, 0.0, 0.3, 0.7, 2.5]) + r.random() / 50 for _ in range(n)]
        near = [{} for _ in range(n)]
        for i in range(n):
            for j in range(i):
                if r.random() < 0.5:
                    near[i][j] = near[j][i] = r.choice([0.2, 0.5, 1.0])
        cost = lambda keep: sum(-o if (o < 0) and k else o if o > 0 and not k else 0 for o, k in zip(odds, keep)) + sum(w for i in range(n) for j, w in near[i].items() if j < i and keep[i] != keep[j])
        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.minimum_cut(odds, near)) - best) < 1e-9


def test_neighbours_against_brute_force(spark):
    r = np.random.RandomState(3)
    x = r.normal(size=(600, 16))
    x[200:400] = x[0]
    rows = [(i, [float(v) for v in np.float32(x[i])]) for i in range(600)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] + [1.0] * 15), (760, [None] + [1.0] * 15), (780, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(a, b, "e", 1) for a, b in rows], "vec_id long, embedding array<float>, v string, id int")
    got = {}
    for z in neighbours.search(df, F.pmod("id", F.lit(20)) == 0).collect():
        got.setdefault(z.query_id, []).append((z.rank, z.vec_id, z.score))
    v = np.array([b for a, b in rows[:600]])
    hit = total = 0
    for q in range(0, 600, 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - s[m[1]]) < 1e-12 for m in mine)
        hit, total = hit + len({m[1] for m in mine} & set(order)), total + 20
        if q in (0, 200):
            assert [m[1] for m in mine] == [i for i in [0, *range(200, 400)] if i != q][:20]
    assert set(got) == set(range(0, 600, 20)) and hit / total >= 0.9


def test_neighbours_with_lists_left_unprobed(spark, monkeypatch):
    r = np.random.RandomState(5)
    x = np.float32(r.normal(size=(2000, 24)) + 3 * r.normal(size=(30, 24))[r.randint(0, 30, 2000)]).astype(float)
    made = []
    begin = neighbours.Index.__init__

    def init(self, *a, **k):
        begin(self, *a, **k)
        made.append(self)

    monkeypatch.setattr(neighbours.Index, "__init__", init)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asks = F.pmod("id", F.lit(20)) == 0

    def recall(rows):
        got, hit = {}, 0
        for z in rows:
            got.setdefault(z.query_id, set()).add(z.vec_id)
        for q in range(0, 2000, 20):
            s = x @ x[q]
            s[q] = -np.inf
            assert len(got[q]) == 20
            hit += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
        return hit / 2000

    assert recall(neighbours.search(df, asks).collect()) >= 0.9
    assert made[0].probes < len(made[0].centroids) == 45
    monkeypatch.setattr(neighbours.Index, "probed", lambda self, q, every=False: np.argsort(-(q @ self.centroids.T), axis=1)[:, : 45 if every else 1])
    monkeypatch.setattr(neighbours.Index, "floor", lambda self, q: np.full(len(q), 1e9 if self is made[1] else -np.inf))
    assert recall(neighbours.search(df, asks).collect()) == 1.0  # nothing reaches that floor, so all queries scan all lists


def test_neighbours_of_repeated_ids(spark):
    form = "vec_id long, embedding array<double>"
    rows = [(i % 7, [float(i), 1.0, float(-i % 3)]) for i in range(21)]
    found = [neighbours.search(spark.createDataFrame(x, form).repartition(n), F.col("id") >= 0).collect() for x, n in ((rows, 1), (rows[::-1], 5))]
    assert sorted(found[0]) == sorted(found[1]) and len(found[0]) == 42


def test_neighbours_of_few_rows(spark):
    form = "vec_id long, embedding array<float>"
    assert neighbours.search(spark.createDataFrame([], form), F.col("id") >= 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], form)
    assert [(x.rank, x.vec_id) for x in neighbours.search(few, F.col("id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_terms_of_a_batch_are_passed_on_in_parts():
    import pyarrow as pa
    from colloquy.llm import toxicity

    texts = [" ".join(f"word{d}x{i}" for i in range(4_000)) for d in range(20)] + [""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array(texts), pa.array([d % 2 for d in range(21)], pa.int32())], names=["doc_id", "text", "y"])
    parts = list(toxicity.term_batches(iter([batch])))
    assert max(p.num_rows for p in parts) < toxicity.PASSED + 4 * 4_000 and len(parts) > 1
    rows = [row for p in parts for row in zip(*(c.to_pylist() for c in p.columns))]
    want = {(d, t, d % 2) for d in range(20) for w in map(toxicity.normal, texts[d].split()) for t in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*")}
    assert len(rows) == len(want) and set(rows) == want
