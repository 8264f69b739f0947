"""Top-k search, URL trust and HTML extraction."""

import math
import random
import time

import numpy as np
import pytest

from triplewright.llm import dom, html_extract, topk, url_trust
from triplewright.plans.workspace import Workspace

VECTORS = "vec_id long, embedding array<float>, label int, weights string, block int"


def expected_top(vectors, asked, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q in asked:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def search(spark, vectors, k=5):
    frame = spark.createDataFrame([(i, v, 0, "w", 1) for i, v in vectors], VECTORS)
    found = topk.quantised(frame)
    return sorted(map(tuple, topk.top_k(found, found.where("vec_id % 50 = 0"), k).collect()))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 2)
    r = np.random.default_rng(1)
    values = r.normal(size=(230, 12)).astype(np.float32)
    values[r.random(values.shape) < 0.5] = 0
    values[100:140] = values[0]  # a large group of ties
    vectors = [(i, v.tolist()) for i, v in enumerate(values)]
    vectors[7] = (7, None)
    vectors[50] = (50, [float("nan")] * 12)
    vectors[9] = (9, [None] + [1.0] * 11)
    vectors[11] = (11, [float("inf")] * 12)
    vectors[12] = (12, [])
    vectors.append((None, [1.0] * 12))
    asked = set(range(0, 230, 50))
    assert search(spark, vectors) == expected_top(vectors, asked, 5)


def test_top_k_small_and_large_values(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []
    few = [(0, [1.0, -1.0]), (1, [2.0, 0.5]), (50, [0.0, 0.0])]
    assert search(spark, few) == expected_top(few, {0, 50}, 5)
    huge = [(0, [3e12]), (1, [3e12]), (2, [-3e12]), (3, [1.0])]
    assert [s for _, _, _, s in search(spark, huge)] == [2 ** 63 - 1, math.floor(256 * float(np.float32(3e12))) * 256, -2 ** 63]


def test_repeated_vectors(spark):
    found = search(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])])
    assert found == [(0, 1, 1, 131072), (0, 2, 1, 131072)]


def test_top_k_in_shares_of_both_sides(spark, monkeypatch):
    """Matrices and postings, numbers of every size and long and short vectors, in several cells."""
    r = np.random.default_rng(2)
    for name, size in (("CANDIDATES", 16), ("QUERIES", 2), ("PAIRS", 40), ("CELLS", 3), ("QUERY_BYTES", 400_000),
                       ("STRIP", 4), ("FIRST", 4)):
        monkeypatch.setattr(topk, name, size)
    sizes = [1.0, 30.0, 1e4, 1e6]
    vectors = [(i, (r.integers(-2, 3, r.integers(0, 9)) * sizes[r.integers(0, 4) if i % 7 == 0 else 0]).tolist())
               for i in range(300)]
    long = [0.0] * 400_000
    long[3], long[-1] = 2.0, 5.0
    vectors += [(400, long), (401, long), (402, vectors[0][1])]
    asked = set(range(0, 403, 50))
    assert search(spark, vectors) == expected_top(vectors, asked, 5)


def test_a_cell_keeps_the_best_of_all_its_blocks(monkeypatch):
    """Rows of a query do not grow with the blocks of candidates, and matrices are not scored term by term."""
    monkeypatch.setattr(topk, "_scores", None)
    r = np.random.default_rng(3)
    values = r.integers(-40, 40, (600, 8))
    values[50:90] = values[0]
    values[300:420] = r.integers(-3, 3, (120, 8)) * 2 ** 20  # exact in the larger type only

    def block(part, hashed):
        rows = values[part]
        ids = np.arange(600)[part][::-1].copy()
        found = topk._packed(ids, ids if hashed else None, np.full(len(rows), 8), rows[::-1].ravel())
        return {"cell": 7} | found

    rows = [block(slice(0, 600, 50), True)] + [block(slice(n, n + 30), False) for n in range(0, 600, 30)]
    batch = topk.pa.RecordBatch.from_pylist(rows, topk.pa.schema([("cell", topk.pa.int32()), *topk._BLOCK]))
    found = [x for part in topk._search(5)([batch.slice(0, 9), batch.slice(9)]) for x in part.to_pylist()]
    assert len(found) == 5 * 12
    scores = values @ values.T
    for q in range(0, 600, 50):
        best = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert [(-x["score"], x["vec_id"]) for x in found if x["query_id"] == q] == best


PAGES = "page_id long, url string, html string, host string, good string, trust double"


def judged(spark, found):
    frame = spark.createDataFrame([(i, u, h, "x", "y", 0.5) for i, (u, h) in enumerate(found)], PAGES)
    return {r.page_id: r for r in url_trust.judge(frame, Workspace(spark)).collect()}


def test_hosts_paths_and_rules(spark):
    found = [(u, None) for u in (
        None, "no scheme", "http://A.Example.ORG/es/1?x", "https://example.org/es", "x://example.org/en/12#t",
        "http://example.org/en/2", "http://notexample.org/", "http://a.org", "http://a.com/fr/x", "http://com/de/",
        "http://a.com/de", "http://a.net/fr/://b.org/", "http://É.org/é?", "://", "http://org/", "http://a.b.com#/fr/")]
    answer = judged(spark, found)
    assert [(r.host, r.path, r.rule) for _, r in sorted(answer.items())] == [
        ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/es", "org/"),
        ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("notexample.org", "/", "org/"),
        ("a.org", "", None), ("a.com", "/fr/x", "com/fr/"), ("com", "/de/", "com/de/"), ("a.com", "/de", None),
        ("a.net", "/fr/://b.org/", None), ("É.org", "/é", "org/"), ("", "", None), ("org", "/", "org/"),
        ("a.b.com", "", None)]
    verdicts = dict(url_trust.RULES)
    assert all(r.verdict == {v: k for k, v in url_trust.RULES}[r.rule] for r in answer.values() if r.rule)
    assert verdicts["allow"] and answer[0].verdict == "allow" and answer[0].trust is None


def test_trust_follows_links(spark):
    def links(*hosts):
        return "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)

    found = [("http://good.org/", links("near.net", "good.org")), ("http://near.net/", ""),
             ("http://farm.example.org/es/", ""), ("http://feeder.net/", links("farm.example.org", "FARM2.net")),
             ("http://alone.net/", None), ("http://farm2.net/", "<a href='//feeder.net'>")]
    answer = judged(spark, found)
    assert answer[1].verdict == "allow" and answer[1].trust == 1
    assert answer[3].verdict == "block" and answer[3].trust == 0
    assert answer[4].verdict == "allow" and answer[4].trust is None
    assert answer[5].verdict == "block"


def test_page_rank(spark):
    """Against a plain power iteration."""
    r = random.Random(3)
    names = [f"h{i}" for i in range(12)]
    edges = sorted({(r.choice(names), r.choice(names), 1) for _ in range(30)})
    seeds = [("h1", 0.25), ("h2", 0.75)]
    found = url_trust.page_rank(spark.createDataFrame(edges, "src string, dst string, weight long"),
                                spark.createDataFrame(seeds, "host string, seed double"), Workspace(spark), rounds=8)
    out = {n: sum(w for a, _, w in edges if a == n) for n in names}
    rank = dict(seeds)
    for _ in range(8):
        got = {n: 0.0 for n in names}
        for a, b, w in edges:
            got[b] += rank.get(a, 0.0) * w / out[a]
        back = 1 - 0.85 * sum(got.values())
        rank = {n: 0.85 * got[n] + back * dict(seeds).get(n, 0.0) for n in names}
    found = {x.host: x.rank for x in found.collect()}
    for n in names:
        assert found.get(n, 0.0) == pytest.approx(rank[n])


def test_reading_html():
    page = dom.parse("<p>a<p>b <b>c</b><br>d<div>e</div>f</p><ul><li>g<li>h</ul><table><tr><td>i<td>j</table>"
                     "<script>if (a < b) '</p>'</script><!-- k --> 1 < 2 &amp; <img alt='>'>&eacute;<textarea>no</textarea>")
    lines = dom.main_text(page, np.ones(len(page.tags), bool)).split("\n")
    assert lines == ["a", "b c d", "e", "f", "g", "h", "i", "j", "1 < 2 & é"]
    for odd in ("", " ", "<", "</p>", "<p", "<!--", "<!", "text", "<script>", "</", "<a href='", "<p>" * 300, "\x00"):
        dom.features([dom.parse(odd)])


def test_tags_without_an_end_and_quotes_left_open():
    def lines(html):
        page = dom.parse(html)
        return dom.main_text(page, np.ones(len(page.tags), bool)).split("\n")

    assert lines("<p>a <a href='x>b</a> c<p>d") == ["a b c", "d"]
    assert lines("""<p title="1>2" x='">'>a<b y="'>'">c</b></p><p z='>d</p>""") == ["ac", "d"]
    assert lines("<p>1 <2 and <b") == ["1 <2 and <b"]


@pytest.mark.parametrize("html", [
    "<a " * 1_000_000, "</a " * 1_000_000, "<a " * 1_000_000 + ">", "<" + "a" * 3_000_000, "<" * 1_000_000,
    "<a \"><a\" " * 200_000 + "'", "<div>" * 100_000, "<div>" * 50_000 + "</span>" * 50_000,
    "<span><table>" + "<div>" * 50_000 + "</span>" * 50_000, "<p>" * 100_000, "<li><ul>" * 50_000])
def test_reading_takes_time_in_proportion_to_the_page(html):
    start = time.process_time()
    page = dom.parse(html)
    dom.decode(page, dom.features([page])[:, 0] if page.tags else np.zeros(0))
    assert time.process_time() - start < 30


def test_decoding_never_contradicts_itself():
    r = np.random.default_rng(2)
    for _ in range(200):
        page = dom.Page()
        for i in range(12):
            page.tags.append("div")
            page.parents.append(-1 if i == 0 else int(r.integers(0, i)))
            page.runs.append((i, i, "x" * int(r.integers(1, 30))))
        chosen = dom.decode(page, r.normal(size=12))
        for i in range(12):
            path = []
            while i >= 0:
                path.append(bool(chosen[i]))
                i = page.parents[i]
            path = path[::-1]
            assert sum(a != b for a, b in zip([False, *path], path)) <= 2


STORY = "A story of some length, told in plain words, so that it looks like prose. "
LAYOUTS = [
    '<nav><a href="/">Home</a></nav><article><h1>T</h1><p>{0}</p><p>{1}</p></article><footer>&copy; x</footer>',
    '<div class="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div><div id="content"><h1>T</h1>'
    '<p>{0}</p><div class="advert">Buy it</div><p>{1}</p></div><div class="comments"><p>Me too, I like this one.</p></div>',
    '<header><p>Site</p></header><main><h1>T</h1><p>{0}<p>{1}</main><aside><h3>Related</h3><p>Other things to read.</p>'
    '</aside><form><label>Mail</label><input></form><div class="cookie-notice">We use cookies.</div>',
]


def test_extraction(spark):
    bodies = [[f"{STORY * n}{i}" for n in (2, 3)] for i in range(24)]
    found = [(i, f"http://x/{i}", LAYOUTS[i % 3].format(*b), 1, "t") for i, b in enumerate(bodies)]
    found += [(100, None, None, 1, "t"), (101, "u", "", 1, "t"), (102, "u", "<nav><a href='/x'>only</a></nav>", 1, "t")]
    frame = spark.createDataFrame(found, "page_id long, url string, html string, n_chars int, text string")
    answer = {r.page_id: r for r in html_extract.extract(frame, html_extract.learn(frame, Workspace(spark))).collect()}
    for i, body in enumerate(bodies):
        assert answer[i].text == "\n".join(["T", *(" ".join(p.split()) for p in body)])
        assert answer[i].n_chars == len(answer[i].text)
    assert [answer[i].text for i in (100, 101, 102)] == ["", "", ""]
    empty = frame.limit(0)
    assert html_extract.extract(empty, html_extract.learn(empty, Workspace(spark))).count() == 0


def test_tree_text():
    text = ("GBT\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 0 <= 1.5)\n      Predict: -1.0\n"
            "     Else (feature 0 > 1.5)\n      Predict: 0.25\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n")
    trees = html_extract._tree_table(text)
    rows = np.array([[1.0, 0, 0], [2.0, 0, 0], [0, 0, 1.0]])
    assert html_extract._margins(trees, [2.0], rows).tolist() == [-2.0, 0.5, 2.0]
