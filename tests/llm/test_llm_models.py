"""Quality, language model, pages, neighbours and conversations against plain Python."""

import hashlib
import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crivo import shared
from crivo.llm import ann, chat, ctw, quality, queries, sitetree

DOCS = "doc_id long, text string"


# ---- quality

def test_held_out_quality(spark):
    found = queries.op1_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = found.join(labels, "doc_id").toPandas()
    assert found.count() == 1000
    held = both[both.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: brute.remainder(i, 4) == 2)).all() and len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.9
    assert both.score.between(0, 1).all() and ((both.score >= 0.7) == (both.predicted == 1)).all()


def test_ranking_follows_preferences_and_the_quantile():
    rng = np.random.default_rng(0)
    features = rng.standard_normal((600, 4))
    preferred = features[:, 0] + 0.3 * features[:, 1] > 0.2
    ranking = quality.fit(features, preferred)
    scores = ranking.scores(features)
    assert np.corrcoef(ranking.raw(features), features[:, 0])[0, 1] > 0.8
    assert ((scores >= quality.CUT) == preferred).mean() > 0.9
    assert abs((scores >= quality.CUT).mean() - preferred.mean()) < 0.01


def test_odd_texts_and_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Some words. And more!"), (3, "x"), (None, "y"), (4, "word " * 100_000)], DOCS).withColumns({"score": F.lit("s"), "features": F.lit(1)})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 1), (None, 1, 0), (9, 1, 0), (2, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    ranking = quality.learn(docs, labels)
    found = quality.score(docs, ranking)
    assert found.columns == ["doc_id", "score"] and found.count() == 6
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    for some, side in ((labels.where("false"), False), (labels.where("quality = 1"), True), (labels.where("quality = 0"), False)):
        scores = {r["score"] >= quality.CUT for r in quality.score(docs, quality.learn(docs, some)).collect()}
        assert scores == {side}
    assert quality.score(docs.where("false"), ranking).count() == 0


def test_every_labelled_row_teaches(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_ROWS", 40)
    monkeypatch.setattr(quality, "LEAST_OF_CLASS", 5)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta.", "c", "delta9", "#x"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    # Rows that come again and again, and few preferred ones.
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 100
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i < 12)) for i in range(300)], "doc_id long, quality int")
    ranking = quality.learn(docs, labels)
    features = np.array([quality.features_of(t.encode()) for _, t in rows])
    preferred = np.array([i < 12 for i, _ in rows])
    assert np.allclose(ranking.borders, quality.fit(features, preferred).borders, rtol=1e-12)
    raw = ranking.weights.ravel()[quality.bins_of(features, ranking.borders)].sum(axis=1)
    assert abs(ranking.threshold - quality.between(raw, (~preferred).mean())) < 1e-12
    found = spark.createDataFrame([(i, f.tolist(), bool(p)) for (i, _), f, p in zip(rows, features, preferred)], "id long, features array<double>, preferred boolean")
    blocks = quality.blocks_of(found, int(preferred.sum()), int((~preferred).sum())).toPandas()
    assert len(blocks[~blocks.preferred]) == (~preferred).sum() and set(blocks.id) == set(range(300))
    assert blocks.groupby("block").size().max() < 120 and blocks.groupby("block").preferred.agg(["any", "all"]).eq([True, False]).all(axis=None)
    # One block is what a fit in one place gives.
    monkeypatch.setattr(quality, "BLOCK_ROWS", 1000)
    order = np.lexsort([*features.T[::-1], [i for i, _ in rows]])
    whole, alone = quality.learn(docs, labels), quality.fit(features[order], preferred[order])
    assert np.allclose(whole.weights, alone.weights, atol=1e-9) and abs(whole.threshold - alone.threshold) < 1e-9


# ---- language model

def test_base_scores_and_held_out_rows(spark, small_dir):
    found = {r["doc_id"]: r for r in queries.op2_ctw(spark, small_dir).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    tokens = {i: [*brute.words((t or "").translate(brute.LOWER)), "\n"] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if brute.remainder(i, 5) != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = found[i]
        assert r["held_out"] == (brute.remainder(i, 5) == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), total)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def tree_score(train, text, depth):
    """Context-tree weighting of one text by the definition, from counts of training texts."""
    counts = {}
    for t in train:
        data = b"\n" * depth + t
        for at in range(depth, len(data)):
            node = 1
            for b in range(7, -1, -1):
                bit = data[at] >> b & 1
                for d in range(depth + 1):
                    counts.setdefault((data[at - d:at], node), [0, 0])[bit] += 1
                node = node << 1 | bit

    def own(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    for d in range(depth, -1, -1):
        for ctx, node in [k for k in counts if len(k[0]) == d]:
            below = sum(weighted[k] for k in counts if len(k[0]) == d + 1 and k[1] == node and k[0][1:] == ctx) if d < depth else None
            p = own((ctx, node))
            weighted[ctx, node] = p if below is None else math.log(0.5 * math.exp(p) + 0.5 * math.exp(below))
    total, data = 0.0, b"\n" * depth + text
    for at in range(depth, len(data)):
        node = 1
        for b in range(7, -1, -1):
            bit, rest, p1 = data[at] >> b & 1, 1.0, 0.5
            acc = 0.0
            for d in range(depth + 1):
                key = (data[at - d:at], node)
                if key not in counts:
                    break
                a, c = counts[key]
                kt = (c + 0.5) / (a + c + 1)
                p1 = acc + rest * kt
                share = 1.0 if d == depth else 0.5 * math.exp(own(key) - weighted[key])
                acc += rest * share * kt
                rest *= 1 - share
            total += math.log10(p1 if bit else 1 - p1)
            node = node << 1 | bit
    return total


def test_scores_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 60)
    texts = ["abra cadabra abra", "the cat and the hat", "Abra the cat", None, "the the the the", "zq\u00e9 abra"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"keys": F.lit(1), "block": F.lit("b")}).repartition(2)
    found = {r["id"]: r for r in ctw.scores(docs, F.col("doc_id") >= 4).collect()}
    train = [ctw.normal((t or "").encode()) for t in texts[:4]]
    for i, t in enumerate(texts):
        text = ctw.normal((t or "").encode())
        assert found[i]["score"] == pytest.approx(tree_score(train, text, ctw.DEPTH), rel=1e-5), t
        assert found[i]["n_bytes"] == len(text)


def test_probabilities_of_all_bytes_add_up(spark):
    """After any context the next bytes' probabilities add up to 1 over a whole leaf level."""
    docs = spark.createDataFrame([(i, chr(i) * 3 if i > 32 else "a b") for i in range(1, 120)], DOCS)
    found = ctw.scores(docs, F.lit(False))
    assert found.where("score > 0 OR isnan(score)").count() == 0
    # With nothing learned, every bit is one half.
    blind = ctw.scores(docs, F.lit(True)).collect()
    assert all(r["score"] == pytest.approx(-8 * r["n_bytes"] * math.log10(2), rel=1e-6) for r in blind)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in blind)
    assert ctw.scores(docs.where("false"), F.lit(False)).count() == 0


def test_long_and_repeated_rows_are_scored(spark):
    docs = spark.createDataFrame([(1, "ab " * 40_000), (2, "x"), (2, "x"), (None, "x"), (3, "")], DOCS)
    found = sorted(((r["id"] or 0, round(r["score"], 6)) for r in ctw.scores(docs, F.col("doc_id") == 3).collect()))
    assert [i for i, _ in found] == [0, 1, 2, 2, 3] and found[2] == found[3] and found[0][1] == found[2][1]


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><header id=top>Site</header><div class="site-promo">{promo}</div>
<article><header><h1>Head &amp; {n}</h1></header><p>One<br>two&nbsp; three {n}</p><script>var a = "</p>";</script><p>Four <b>five</b> &lt;six&gt;
<form><input>Sign up</form><div class="ad">Buy</div><ul><li>a<li>b</ul></article>
<aside>Side</aside><section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>Foot</footer></body></html>"""


def test_articles(spark):
    pages = spark.createDataFrame([(i, f"https://Host.example:80/{i}", PAGE.format(n=i, promo=i)) for i in range(3)], "page_id long, url string, html string")
    found = {r["id"]: r["text"] for r in sitetree.main_text(pages).collect()}
    for i in range(3):
        assert found[i] == f"Head & {i}\nOne two three {i}\nFour five <six>\na\nb"


def test_what_a_site_repeats_goes_and_what_pages_say_stays(spark):
    def page(i):
        return f"<body><div class=box><p>Same line on all pages</p></div><div class=main><h1>Title {i}</h1><p>Text {i} of its own</p></div></body>"
    data = [(i, "http://a.example/x", page(i)) for i in range(6)] + [(10, "http://b.example/", page(10)), (11, None, page(11))]
    found = {r["id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert found[2] == "Title 2\nText 2 of its own"
    # Nothing to compare with: all stays.
    assert found[10] == "Same line on all pages\nTitle 10\nText 10 of its own" == found[11].replace("11", "10")


def test_copies_of_one_article_stay(spark):
    data = [(i, "http://a.example/", "<article><p>The only text</p></article>") for i in range(20)]
    data += [(100 + i, "http://c.example/", "<p>The only text</p>") for i in range(20)]
    found = sitetree.main_text(spark.createDataFrame(data, "page_id long, url string, html string"))
    assert {r["text"] for r in found.collect()} == {"The only text"} and found.count() == 40


def text_of(spark, *pages):
    data = [(i, "http://a.example/", page) for i, page in enumerate(pages)]
    found = sitetree.main_text(spark.createDataFrame(data, "page_id long, url string, html string"))
    return [r["text"] for r in sorted(found.collect(), key=lambda r: r["id"])]


@pytest.mark.parametrize("most", [0, 64 << 20])
def test_what_a_site_repeats_goes_inside_articles(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    pages = [f"<article><h1>Title {i}</h1><p>Text {i} of its own</p><div class=box><p>Read our terms</p></div></article>" for i in range(8)]
    assert text_of(spark, *pages) == [f"Title {i}\nText {i} of its own" for i in range(8)]
    # Copies under titles of their own keep their text.
    copies = [f"<article><h1>Title {i}</h1><p>The only text</p></article>" for i in range(8)]
    assert text_of(spark, *copies) == [f"Title {i}\nThe only text" for i in range(8)]


def test_names_alone_do_not_drop_an_article(spark):
    inner = '<h2 id="privacy">Privacy {0}</h2><section id="related-work"><p>Work {0}</p></section><div class="discussion"><p>We discuss {0}</p></div>'
    want = "Privacy {0}\nWork {0}\nWe discuss {0}"
    for own in ("", 'class="post comments-open"', 'class="tag-login"'):
        assert text_of(spark, *[f"<article {own}>{inner.format(i)}</article>" for i in range(8)]) == [want.format(i) for i in range(8)]
    assert text_of(spark, '<body><div class="layout with-sidebar"><p>Body</p><div class="sidebar">Links</div></div>') == ["Body"]
    assert text_of(spark, '<div class="comments"><p>All there is</p></div>') == ["All there is"]
    page = '<div class="content"><p>A long text that is the body of this page</p></div><article class="card"><p>Teaser</p></article>'
    assert text_of(spark, page) == ["A long text that is the body of this page\nTeaser"]


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain", "plain"), ("a < b & c", "a < b & c"), ("<p>a<p>b", "a\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<p>x</span></div>y</p>z", "xy\nz"), ("<article><p><b>a<br><p>b</article><p>after", "a\nb"), ("<!-- no --><p>&#233;&eacute;&bogus;</p>", "éé&bogus;"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", "a b\nc"), ("<p>un<i>der</i>line</p>", "underline"), ("<p hidden>a</p><p style='display: none'>b</p><p>c", "c"),
    ("<script>if (a < b) x()</script>t", "t"), ("<p>a<![CDATA[ <b> ]]></p>", "a <b>"), ("<p title='a>b'>c</p>", "c"), ("<main><p>m</p></main><p>n</p>", "m"),
    ("<textarea>no</textarea>yes<noscript>no</noscript>", "yes"), ("<p>\x00a</p>", "\x00a"),
])
def test_markup(spark, html, want):
    read = sitetree._Page("h")
    read.read(html or "")
    kept = [t for t in read.texts if not t[2]]
    article = [t for t in kept if t[3]]
    assert "\n".join(t[0] for t in (article or kept)) == want


def test_importance_equals_plain_entropy(spark):
    """Of random trees: texts shared by branches and pages, several styles of a branch in one page, branches of one page."""
    rng = random.Random(11)
    pages = []
    for _ in range(40):
        blocks = []
        for _ in range(rng.randint(0, 8)):
            path = [0, 1 + rng.randrange(3), 10 + rng.randrange(6), 100 + rng.randrange(60)]
            blocks.append((rng.choice("abcdefgh") * rng.randint(1, 2), path, 0, 0, False))
        own = sorted({b for x in blocks for b in x[1]})
        pages.append((7, blocks, sorted({(b, rng.randrange(3)) for b in own for _ in range(rng.randint(1, 2))})))
    df = spark.createDataFrame(pages, f"site long, blocks {sitetree.BLOCK}, styles array<struct<branch:long,feature:long>>")
    found = {r["branch"]: (r["m"], r["importance"]) for r in sitetree.importance(df.repartition(3)).collect()}
    having, texts, styles = Counter(), {}, {}
    for _, blocks, children in pages:
        having.update({b for x in blocks for b in x[1]})
        for b, text in {(b, x[0]) for x in blocks for b in x[1]}:
            texts.setdefault(b, Counter())[text] += 1
        for b, style in children:
            styles.setdefault(b, Counter())[style] += 1
    assert set(found) == set(having) and {1, 2} < set(having.values())
    for b, m in having.items():
        want = 1.0
        if m > 1:
            content = 1 - sum(math.log(k, m) for k in texts[b].values()) / len(texts[b])
            total = sum(styles[b].values())
            presentation = -sum(k / total * math.log(k / total, m) for k in styles[b].values())
            want = sitetree.CONTENT_WEIGHT * content + (1 - sitetree.CONTENT_WEIGHT) * min(1.0, presentation)
        assert found[b] == (m, pytest.approx(want, abs=1e-12))


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    data = [(1, None, None), (1, "x", ""), (2, "http://h/", deep), (None, "http://h/", "<p>n"), (2, "http://h/", deep)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "page": F.lit(1), "blocks": F.lit(2)})
    assert sorted((r["id"] or 0, r["text"]) for r in sitetree.main_text(pages).collect()) == [(0, "n"), (1, ""), (1, ""), (2, "deep"), (2, "deep")]
    assert sitetree.main_text(pages.where("false")).count() == 0


def test_given_pages(spark, small_dir):
    found = queries.op3_sitetree(spark, small_dir)
    assert found.count() == spark.read.parquet(f"{small_dir}/pages.parquet").count()
    assert found.where("n_chars <> length(text) OR text LIKE '%©%' OR text LIKE '%  %'").count() == 0


# ---- neighbours

def exact(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(axis=1)
    scores[query] = -np.inf
    order = np.lexsort((ids, -scores))[:min(k, len(ids) - 1)]
    return ids[order].tolist(), scores[order]


def test_neighbours_equal_brute_force(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float64)
    found = queries.op6_nearest(spark, small_dir).toPandas()
    assert found["rank"].min() == 1
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        got = found[found.query_id == ids[q]].sort_values("rank")
        want, scores = exact(ids, vectors, q, 20)
        total += len(want)
        hits += len(set(want) & set(got.vec_id))
        assert np.allclose(got.score, scores, rtol=1e-12)
    assert hits / total >= 0.99


def groups(n, seed=5):
    """Vectors in 60 groups, one of which holds a third of all."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((60, 32))
    of = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 60, n))
    return middle[of] + 0.3 * rng.standard_normal((n, 32))


def test_lists_and_codes_leave_little_to_compare(spark, monkeypatch):
    """Sure bounds miss nothing, bounds by chance next to nothing, with a sample that is a part of all."""
    monkeypatch.setattr(ann, "SAMPLE", 600)
    vectors = groups(4000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    want = [exact(np.arange(4000), vectors, q, 10) for q in range(0, 4000, 50)]
    for sure, least in ((True, 1.0), (False, 0.98)):
        found = ann.nearest(df, F.col("id") % 50 == 0, 10, exact=sure).toPandas().sort_values(["query_id", "rank"])
        assert found.groupby("query_id").size().tolist() == [10] * 80
        hits = sum(len(set(w) & set(found.vec_id[found.query_id == q * 50])) for q, (w, _) in enumerate(want))
        assert hits >= least * 800
        assert np.allclose(found.score, (vectors[found.vec_id] * vectors[found.query_id]).sum(axis=1), rtol=1e-12)


def test_the_search_compares_a_small_part(monkeypatch):
    """Of all pairs under a twentieth are compared exactly."""
    vectors = groups(6000)
    found = ann.centres(vectors[:600], 30)
    turn, asked = ann.rotation(32, ann.BITS), np.arange(0, 6000, 30)
    centre = ann._nearest(vectors, found)
    order = np.argsort(centre, kind="stable")
    rest = (vectors - found[centre])[order]
    length = np.sqrt((rest ** 2).sum(axis=1))
    unit = rest / length[:, None] @ turn.T
    codes = pa.array([c.tobytes() for c in np.packbits(unit > 0, axis=1)])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(order), pa.array(vectors[order].tolist()), pa.array(centre[order]), codes, pa.array(length), pa.array(np.abs(unit).sum(axis=1) / ann.BITS ** 0.5)],
        names=["id", "vector", "centre", "code", "length", "fit"])
    queries = vectors[asked]
    turned = np.hstack([queries / np.sqrt((queries ** 2).sum(axis=1))[:, None] @ turn.T, np.ones((len(asked), 1))]).astype(np.float32)
    scores = queries @ vectors[:600].T
    scores[asked[:, None] == np.arange(600)] = -np.inf
    reach = np.sort(scores, axis=1)[:, -10]
    compared, add = [], ann.Best.add
    monkeypatch.setattr(ann.Best, "add", lambda self, query, *rest: compared.append(len(query)) or add(self, query, *rest))
    got = next(ann._pass([batch], (asked, queries, turned, reach), found, 10, False))
    assert 0 < sum(compared) < 0.05 * 6000 * len(asked)
    ids = {q: set() for q in asked.tolist()}
    for q, v in zip(got["query_id"].to_pylist(), got["vec_id"].to_pylist()):
        ids[q].add(v)
    assert sum(len(ids[q] & set(exact(np.arange(6000), vectors, q, 10)[0])) for q in ids) >= 0.98 * 10 * len(asked)


@pytest.mark.parametrize("block", [3, 4096])
def test_odd_vectors_ties_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    rng = np.random.default_rng(3)
    good = rng.standard_normal((90, 8))
    good[40:80] = good[40]
    data = [(i, v.tolist()) for i, v in enumerate(good)]
    odd = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7),
           (205, [1.0] * 5), (206, []), (None, [1.0] * 8), (0, data[0][1])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(4)
    found = ann.nearest(df, F.col("id") % 5 == 0, 7).toPandas()
    ids = np.arange(90)
    assert len(found) == 18 * 7
    for q in range(0, 90, 5):
        got = found[found.query_id == q].sort_values("rank")
        want, scores = exact(ids, good, q, 7)
        assert got.vec_id.tolist() == want and np.allclose(got.score, scores, rtol=1e-12)
    assert ann.nearest(df.where("vec_id < 3"), F.col("id") == 0, 7).count() == 2
    assert ann.nearest(df.where("false"), F.col("id") == 0, 7).count() == 0
    assert ann.nearest(df, F.col("id") == 5000, 7).count() == 0


# ---- conversations

def test_turns_are_read_back():
    texts = ["", "\\", "###", "####", "\\###", "</turn>", "\\</turn>\n### user: x</turn>\n", "<|image:0|>", ": a: b", "\\### Assistant: </turn> ok", "a\nb", "\\\\"]
    expansion = chat.Expansion()
    for role in ("user", "a: b", "### x", "", "\\"):
        whole = "".join(chat.format_turn(role, [{"kind": "text", "text": t}], expansion)[0] for t in texts)
        read = list(chat.read_turns(whole))
        assert [(r, "".join(t for _, t in parts)) for r, parts, _, _ in read] == [(role, t) for t in texts]
        assert whole.count("</turn>\n### ") >= len(texts) - 1


def test_parts_become_placeholders(spark):
    parts = F.expr("""array(named_struct('kind', 'text', 'text', 'see <|image:0|>', 'ref', null, 'width', null, 'height', null, 'length', null),
        named_struct('kind', 'image', 'text', null, 'ref', 'a.png', 'width', 56.0D, 'height', 29.0D, 'length', null),
        named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav', 'width', null, 'height', null, 'length', 2.0D),
        named_struct('kind', 'document', 'text', null, 'ref', null, 'width', null, 'height', null, 'length', 3.0D), null)""")
    turns = spark.createDataFrame([(1, 0, "user"), (1, 1, None)], "conv_id long, turn long, role string")
    found = chat.format_turns(turns, parts).orderBy("turn").collect()
    assert found[0]["formatted"] == "### user: see \\<|image:0|><|image:0|><|audio:1|><|document:2|></turn>\n"
    assert [tuple(a) for a in found[0]["attachments"]] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 50), (2, "document", None, 768)]
    role, read, _, _ = next(chat.read_turns(found[0]["formatted"]))
    assert [(k, t) for k, t in read if t] == [("text", "see <|image:0|>"), ("image", "0"), ("audio", "1"), ("document", "2")]
    assert chat.format_turns(turns, F.lit(None).cast(turns.select(parts.alias("p")).schema["p"].dataType)).first()["formatted"].endswith(": </turn>\n")
    unknown = F.expr("array(named_struct('kind', 'film', 'text', 'x', 'ref', null, 'width', null, 'height', null, 'length', null))")
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_turns(turns, unknown).collect()


def test_odd_conversations(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, None, "x"), (2, None, "assistant", ""), (2, 5, "assistant", "z" * 300_000), (1, 0, "user", None)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "parts": F.lit(2), "conv": F.lit(3)})
    found = {r["conv"]: r for r in chat.read_back(chat.format_turns(turns, chat.text_part(F.col("text")))).collect()}
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()
    assert (found[1]["n_turns"], found[1]["loss_chars"], found[1]["loss_sha256"]) == (4, 2, digest("ab"))
    assert found[1]["turns_sha256"] == digest("user\n\nuser\n\nassistant\na\nassistant\nb\n")
    assert found[2]["loss_sha256"] == digest("z" * 300_000) and found[None]["turns_sha256"] == digest("\nx\n")
    assert found[None]["formatted_chars"] == len("### : x</turn>\n") and found[None]["loss_chars"] == 0
    assert chat.read_back(chat.format_turns(turns.where("false"), chat.text_part(F.col("text")))).count() == 0
