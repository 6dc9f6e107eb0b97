import random
import time
import zlib

import numpy as np
import pytest

from sigspark.llm import extraction, quality
from sigspark.llm.dom import parse

from .helpers import clashing, docs

# ---- quality ----


def corpus(draw, n):
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(["alpha", "beta", "gamma", "delta", "of", "and"]) + draw.choice(["", "s", "ing", str(draw.randrange(9))]) for _ in range(draw.randint(20, 120))]
        good = draw.random() < 0.7
        if not good:
            words = draw.choice([[w.upper() + "!!" for w in words], [w + " |" for w in words], [words[0]] * len(words), [w + "###" for w in words]])
        rows.append((i, " ".join(words)))
        if draw.random() < 0.5:
            labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus(random.Random(11), 900)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, labels, known, quality.train(docs(spark, rows), known)


def test_held_out_accuracy(spark, trained):
    rows, labels, known, model = trained
    score = {r.doc_id: r.score for r in quality.score(clashing(docs(spark, rows)), model).collect()}
    assert len(score) == len(rows) and all(0 <= s <= 1 for s in score.values())
    held = [(k, q) for k, q, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([(score[k] >= quality.THRESHOLD) == q for k, q in held]) > 0.97


def test_held_out_labels_teach_nothing(spark, trained):
    rows, labels, _, model = trained
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, t) for k, q, t in labels]
    other = quality.train(docs(spark, rows), spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    x = np.array([quality.features(t) for _, t in rows[:50]])
    assert np.array_equal(model.score(x), other.score(x))


def test_repeated_ids_teach_once(spark, trained, monkeypatch):
    """One id in 50,000 rows, with and without a text of its own, brings one row to the driver and changes nothing."""
    rows, labels, known, model = trained
    k, t = next((k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 4 != 2)
    many = spark.range(50_000).selectExpr(f"cast({k} as long) as doc_id", "id").join(docs(spark, [(k, t)]), "doc_id").drop("id")
    seen = []
    fit = quality.Model.fit
    monkeypatch.setattr(quality.Model, "fit", lambda self, p, u: (seen.append((len(p), len(u))), fit(self, p, u))[1])
    other = quality.train(docs(spark, rows).unionByName(many), known)
    x = np.array([quality.features(t) for _, t in rows[:50]])
    assert np.array_equal(model.score(x), other.score(x)) and seen[0][0] <= len(labels) and seen[0][1] <= len(rows)


def test_risk_and_score_equal_a_plain_restatement():
    draw = np.random.default_rng(3)
    p, u = draw.normal(1, 1, (40, 6)).astype(np.float32), draw.normal(-1, 1, (60, 6)).astype(np.float32)
    m = quality.Model(0.4)
    turned = set()
    both = np.concatenate([p, u])
    scaled = lambda x: np.clip((x - both.mean(axis=0)) / (both.std(axis=0) + 0.02), -8, 8)

    def margin(x):
        w, b, v, c = m.weights
        return [sum(max(0, sum(row[i] * w[i, h] for i in range(6)) + b[h]) * v[h] for h in range(len(v))) + c[0] for row in scaled(x)]

    loss = lambda z: np.mean([1 / (1 + np.exp(x)) for x in z])
    for seed, prior in ((1, 0.4), (2, 0.4), *((k, 0.95) for k in range(3, 11))):
        m.prior = prior
        m.start(p, u, np.random.default_rng(seed))
        first, second = m.risk(p, u)
        z = margin(p)
        assert np.isclose(first, prior * loss(z), atol=1e-5) and np.isclose(second, loss([-x for x in margin(u)]) - prior * loss([-x for x in z]), atol=1e-5)
        turned.add(bool(second < 0))
        for w, g in zip(m.weights, m.gradient(p, u)):
            for k in np.ndindex(w.shape):
                own, values = w[k], []
                for step in (1e-4, -1e-4):
                    w[k] = own + step
                    a, b = m.risk(p, u)
                    values.append(a + b if second >= 0 else -b)
                w[k] = own
                assert np.isclose(g[k], (values[0] - values[1]) / 2e-4, atol=2e-3)
    assert turned == {True, False}
    m.fit(p, u).calibrate(both, np.r_[np.ones(40), np.zeros(60)])
    a, b = m.curve
    assert a > 0 and np.allclose(m.score(p), [1 / (1 + np.exp(-(a * z + b))) for z in margin(p)], atol=1e-4)


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    got = docs(spark, [(i, "") for i in range(200)] + [(None, "")]).select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_odd_rows(spark, trained):
    model = trained[3]
    rows = [(1, None), (2, ""), (2, ""), (3, "x" * 300_000), (None, "words"), (4, "\0\n\n \t")]
    got = quality.score(clashing(docs(spark, rows)), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.accepted(clashing(docs(spark, rows)), model).columns == clashing(docs(spark, rows)).columns
    assert quality.score(docs(spark, []), model).count() == 0


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs(spark, [(1, "a b")]), none)
    assert [r.score for r in quality.score(docs(spark, [(1, "a b")]), model).collect()] == [0.5]


def test_risk_is_not_negative():
    """A model that could learn the positives among the unlabelled by heart keeps scoring them high."""
    draw = np.random.default_rng(12)
    p, up, down = draw.normal(1, 1, (300, 5)), draw.normal(1, 1, (300, 5)), draw.normal(-1, 1, (300, 5))
    m = quality.Model(0.5).fit(p.astype(np.float32), np.concatenate([up, down]).astype(np.float32))
    new_up, new_down = draw.normal(1, 1, (500, 5)), draw.normal(-1, 1, (500, 5))
    z = lambda x: m._forward(m.scaled(x))[1]
    assert (z(new_up) > 0).mean() > 0.9 and (z(new_down) < 0).mean() > 0.9


# ---- pages ----


def leaves(node):
    return [node.text] if node.tag == "#text" else [t for c in node.children for t in leaves(c)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []), ("", []), ("just text", ["just text"]), ("a<p>b<p>c", ["a", "b", "c"]), ("<p>a <b>b</p><p>c</b> d</p>", ["a b", "c d"]),
        ("<p>x&amp;y &lt;z&gt; &#233;&eacute;&copy</p>", ["x&y <z> éé©"]), ("<script>var t='</p>';</script>a<style>p{}</style>b", ["ab"]),
        ("<p>a\n\n  b\tc<br>d</p>", ["a b c d"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<!-- <p>no</p> -->yes<!-- open", ["yes"]),
        ("a < b and 3 <4 <i>c</i>", ["a < b and 3 <4 c"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<div>a<div>b</div>c</div>", ["a", "b", "c"]),
        ("<p title='a>b' class=\"x\">c</p>", ["c"]), ("<div hidden>a</div><div style='display:none'>b</div>c", ["c"]), ("<title>t</title><p>a", ["a"]), ("a<br/>b<hr>c", ["a b", "c"]),
        ("</p></div>a</b>", ["a"]), ("<a href=x>a<a href=y>b</a>", ["ab"]), ("<textarea>a<p></textarea>b", ["b"]), ("<p>a<div>b</p>c</div>", ["a", "b", "c"]),
    ],
)
def test_parse(html, want):
    assert leaves(parse(html)) == want


def test_parse_survives_anything():
    draw = random.Random(13)
    parts = ["<", ">", "</", "p", "div", "li", "table", "td", "a", " ", "=", '"', "'", "<!--", "-->", "&amp;", "&#x", "text", "<script>", "</script>", "<b>", "</b>", "</div>", "<p>", "/>", "<br>"]
    for _ in range(3000):
        leaves(parse("".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))))


def test_hidden_is_an_attribute_not_a_word():
    for attrs in ('class="post hidden lg:block"', 'title="a hidden gem"', "data-x='display: none'", "title=\"aria-hidden='true'\"", "data-hidden"):
        assert [n.text for n in extraction.nodes_of(parse(f"<div {attrs}>a</div>")) if n.tag == "#text"] == ["a"], attrs
    for attrs in ("hidden", "class=x hidden", "HIDDEN=''", 'style="color:red; display : none"', "aria-hidden=true", "aria-hidden = 'true'", "id='b' hidden/"):
        assert not [n for n in extraction.nodes_of(parse(f"<div {attrs}>a</div>")) if n.tag == "#text"], attrs


def test_same_siblings_are_counted_at_any_number():
    for n in (10, 200):
        nodes = extraction.nodes_of(parse("<section>" + "<p>x</p>" * n + "<div>y</div></section>"))
        of = {x.tag: row for x, row in zip(nodes, extraction.describe(nodes))}
        assert np.isclose(of["div"][-7], 1 / (n + 1)) and np.isclose(of["p"][-7], n / (n + 1))


def test_extraction_on_pages_it_has_not_seen():
    trees, draw, right = extraction.model(), random.Random(14), 0
    for _ in range(200):
        root, good = extraction.teaching_page(draw)
        nodes = extraction.nodes_of(root)
        kept = {id(n) for n in extraction.decode(nodes, trees.log_odds(extraction.describe(nodes)))}
        right += kept == {id(n) for n in nodes if n.tag == "#text" and id(n) in good}
    assert right > 165


def test_decoding_is_the_likeliest_consistent_choice():
    draw, sizes = random.Random(15), set()
    for n in range(300):
        nodes = extraction.nodes_of(parse("".join(draw.choice(["<div>", "</div>", "<p>", "t", "</p>"]) for _ in range(9))))[:12]
        at = {id(n): i for i, n in enumerate(nodes)}
        odds = np.array([draw.choice([-1.0, 0.0, 1.0]) if n % 2 else draw.gauss(0, 2) for _ in nodes])  # every other one with ties
        best = -1e9
        for mask in range(1 << len(nodes)):
            if mask & 1 and all(not mask >> i & 1 or mask >> at[id(n.parent)] & 1 for i, n in enumerate(nodes) if i):
                best = max(best, sum(odds[i] for i in range(len(nodes)) if mask >> i & 1))
        kept = extraction.chosen(nodes, odds)
        assert all(not k or i == 0 or kept[at[id(nodes[i].parent)]] for i, k in enumerate(kept))
        assert np.isclose(sum(odds[i] for i, k in enumerate(kept) if k), best)
        assert extraction.decode(nodes, odds) == [n for n, k in zip(nodes, kept) if k and n.tag == "#text"]
        sizes.add(sum(kept))
    assert len(sizes) > 4


@pytest.mark.parametrize("inside", ["<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "<object>x=2</object>", "<video src=a>x=2</video>", "<svg viewBox='0 0 1 1'><path d='M0'/><text>x=2</text></svg>", "<audio>x=2</audio>", "<canvas>x=2</canvas>"])
def test_inline_elements_keep_their_text(inside):
    assert leaves(parse(f"<p>Let {inside} be")) == ["Let x=2 be"]


def test_more_of_markup():
    for page, want in (
        ("<noscript><p>a</p></noscript>b", ["a", "b"]), ("<head><title>t</title><p>a", ["a"]), ("<template>a</template>b", ["b"]), ("<xmp><b>&amp;</xmp>c", ["<b>&amp;", "c"]), ("a<plaintext><p>b", ["a", "<p>b"]),
        ('<p title="5" tall">a</p>b', ["a", "b"]), ("<p data-note='is hidden here'>a", ["a"]), ("a<br", ["a"]), ("<p>a</", ["a</"]), ("<p>a</>b", ["ab"]), ("<p a='b>c</p>d", ["c", "d"]), ("<p>a<meta itemprop=x>b", ["ab"]), ("<svg><g><p>a</svg>b", ["ab"]),
    ):
        assert leaves(parse(page)) == want, page
    names = lambda attrs: parse(f"<div {attrs}>x</div>").children[0].tokens()
    assert names('title="class=ad" class=post') == ["post"] and names("data-x='a' ID=\"mainContent\"") == ["main", "content"]


@pytest.mark.parametrize("piece", ["<a b ", "<a b='", '<a b=">', '<a ">" ', "<", "</", "<!--", "<!", "<div>", "</div>", "<b>", "<a>", "<b><i>", "<p><table>", "<p><button><div>", "<li><ul>", "<a =", "&amp", "<svg><g>", "<x <y='"])
def test_time_grows_with_the_page_alone(piece):
    began = time.perf_counter()
    page = "<article><p>start</p>" + piece * (1_000_000 // len(piece))
    nodes = extraction.nodes_of(parse(page))
    assert time.perf_counter() - began < 12 and any(n.text.startswith("start") for n in nodes)


def test_a_page_of_many_nodes_is_scored_in_blocks(monkeypatch):
    pages = ["<article>" + "<p>some text, with a comma</p>" * n + "</article><nav><a href=x>menu</a></nav>" for n in (3, 50, 4, 120, 1)]
    trees = extraction.model()
    whole = extraction.texts(pages, trees)
    monkeypatch.setattr(extraction, "NODES", 20)
    assert extraction.texts(pages, trees) == whole and all(whole)


PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body><header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of you.</div><article><h1>Title &amp; more</h1><p>First  paragraph of the text, with <b>bold</b> words.<p>Second one; it is longer than the first, and has commas, too.
<div class="ad">Buy this thing now, it is cheap.</div><p>Third paragraph ends it.</p></article><aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other story</a></li></ul></aside>
<section class="comments"><h2>Comments</h2><p>I liked this article very much, thank you for it, really.</p></section><form><label>Search</label><input><button>Go</button></form><footer>&copy; 2020 Site</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", "<nav><a href=x>menu</a></nav>"), (4, "x", "<article><p>" + "word, " * 60_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    from pyspark.sql import functions as F

    got = extraction.extract(df.select("*", F.lit("z").alias("text"), F.lit("z").alias("HTML")).toDF("page_id", "url", "html", "text", "HTML")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[2].text == by[3].text == by[None].text == ""
    assert by[1].text == "Title & more\n\nFirst paragraph of the text, with bold words.\n\nSecond one; it is longer than the first, and has commas, too.\n\nThird paragraph ends it."
    assert len(by[4].text) == 360_000 - 1
    assert extraction.extract(df.limit(0)).count() == 0
