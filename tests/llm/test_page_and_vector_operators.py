"""URL filters, nearest neighbours, HTML extraction and connected components against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from parley.llm import htmltext, labelledpages, nearest, urlfilter
from parley.llm.components import connected_components


def brute_components(pairs):
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    inside = {x for a, b in pairs if a != b for x in (a, b)}
    return {x: root(x) for x in inside}


def test_connected_components(spark):
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(200 + k, 999) for k in range(30)]
    loose = [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    pairs = [*chain, *star, *loose, (5, 5), (7, 8), (8, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.component for x in connected_components(df).collect()}
    assert got == brute_components(pairs)
    assert connected_components(df.where("false")).count() == 0


def plain_split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


URLS = [
    "http://Example.ORG/es/1?q", "https://a.example.org/en/1", "http://b.example.org/en/12#x", "http://x.org", "http://x.org/",
    "ftp://y.com/de/", "http://y.com/fr/a", "http://notexample.org/es/", "nothing", None, "http://z.net/a", "http://z.net/b",
    "x://y://org/a", "http://É.com/de/q\nr?s"
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "a string, b string")
    for r in urlfilter.judge(pages, none).collect():
        host, path = plain_split(URLS[r.page_id])
        fits = [(len(h + p), v, h + p) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert (r.host, r.path, r.verdict, r.rule) == (host, path, best[1], best[2])
    assert urlfilter.judge(pages.where("false"), none).count() == 0


def test_blocks_spread_to_aliases(spark):
    html = {
        "http://one.net/a": "<link rel='canonical' href='http://x.com/de/1'>",
        "http://two.net/b?x=1": "<meta http-equiv=refresh content='0; url=/c'>",
        "http://two.net/c": '<LINK href="http://one.net/a" REL="canonical">',
        "http://three.net/": "<link rel=canonical href='//four.net/d'>",
        "http://five.net/x/y": "<link rel=canonical href=z>",
        "http://y.com/fr/ok": "<link rel=canonical href='http://one.net/q'>",
        "http://one.net/q": "<link rel=canonical href='http://x.com/de/2'>",
        "http://six.net/": None,
    }
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(html.items())], "page_id long, url string, html string")
    edges = urlfilter.link_edges(pages)
    assert ("five.net/x/y", "five.net/x/z") in {tuple(e) for e in edges.collect()}
    got = {list(html)[r.page_id]: r.verdict for r in urlfilter.judge(pages, edges).collect()}
    assert got["http://one.net/a"] == got["http://two.net/b?x=1"] == got["http://two.net/c"] == "block"
    assert got["http://three.net/"] == got["http://six.net/"] == got["http://five.net/x/y"] == "allow"
    assert got["http://y.com/fr/ok"] == "allow" and got["http://one.net/q"] == "allow"  # an explicit allow comes first


LINKS = [
    ("http://a.net/x/y/z", "<link rel=canonical href='../w'>", ("a.net/x/y/z", "a.net/x/w")),
    ("http://a.net/x/y/z", "<link rel=canonical href='./../../../up/.'>", ("a.net/x/y/z", "a.net/up/")),
    ("http://a.net", "<link rel='canonical' href='http://b.net'>", ("a.net/", "b.net/")),
    ("http://a.net/p", "<link rel=canonical href='/q?a=1&amp;b=2'>", ("a.net/p", "a.net/q")),
    ("http://a.net/p", '<link rel=canonical href="/a&amp;b&#47;c&#x64;">', ("a.net/p", "a.net/a&b/cd")),
    ("http://a.net/p", "<!-- <link rel=canonical href='/no'> -->", None),
    ("http://a.net/p", "<script>var x = \"<link rel=canonical href='/no'>\"</script>", None),
    ("http://a.net/p", "<title><link rel=canonical href='/no'></title><link rel=canonical href='/yes'>", ("a.net/p", "a.net/yes")),
    ("http://a.net/p", "<link rel=canonical href='mailto:x@y.z'>", None),
    ("http://a.net/p", "<link rel=canonical href='r?u=http://c.net/'>", ("a.net/p", "a.net/r")),
    ("http://a.net/p", "<link rel=canonical href='?page=2'>", ("a.net/p", "a.net/p")),
    ("http://A.net/p", "<meta http-equiv='refresh' content='3; URL=HTTPS://B.net:80/Q#x'>", ("a.net/p", "b.net:80/Q")),
    ("nothing", "<link rel=canonical href='/no'>", None),
    (None, "<link rel=canonical href='/no'>", None),
]


def test_links_are_resolved(spark):
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(LINKS)], "page_id long, url string, html string")
    for k, (_, html, want) in enumerate(LINKS):
        got = [tuple(e) for e in urlfilter.link_edges(df.where(F.col("page_id") == k)).collect()]
        assert got == ([want] if want else []), html


def test_any_number_of_rules(spark):
    """More rules than one expression holds, and fewer; repeated pages and clashing names are nothing special."""
    rules = [*urlfilter.RULES, ("block", "org", "/"), *(("block" if k % 2 else "allow", f"h{k}.net", "/" + "p" * (k % 5)) for k in range(600))]
    urls = [*URLS, *(f"http://www.h{k}.net/{'p' * (k % 7)}/x" for k in range(0, 640, 7)), "http://h3.net", "http://.h4.net/pppp"]
    pages = spark.createDataFrame(
        [(k, u, "x", "y", "z") for k, u in enumerate(urls * 2)],
        "page_id long, url string, host string, verdict string, own string"
    )
    edges = spark.createDataFrame([("z.net/a", "www.h1.net/p")], "a string, b string")
    for some in (rules, rules[:40]):
        got = urlfilter.judge(pages, edges, some).collect()
        assert len(got) == 2 * len(urls)
        for r in got:
            host, path = plain_split((urls * 2)[r.page_id])
            fits = [(len(h + p), -k, v, h + p) for k, (v, h, p) in enumerate(some) if (host == h or host.endswith("." + h)) and path.startswith(p)]
            _, _, verdict, rule = max(fits, default=(0, 0, "block" if (host, path) == ("z.net", "/a") else "allow", None))
            assert (r.host, r.path, r.verdict, r.rule) == (host, path, verdict, rule)


def test_sql_of_the_url_filter_gives_its_rows(spark, tmp_path):
    """The oracle's own steps, on pages with the links that it resolves: chains, stars, allows that come first."""
    import duckdb

    from parley.llm.queries import ORACLES

    r = random.Random(4)
    hosts = ["x.com", "y.com", "a.net", "www.a.net", "b.net", "example.org", "Sub.Example.org", "c.org"]
    url = lambda: f"http://{r.choice(hosts)}/{r.choice(('', 'es/', 'en/1', 'fr/', 'de/', 'q', 'w'))}{r.randrange(3)}"
    pages = [
        (k, u, r.choice((None, "", f"<link rel=canonical href='{r.choice((url(), url(), '/de/1', '//b.net/q1'))}'>", "<p>x</p>"))) for k,
        u in enumerate([url() for _ in range(80)] + URLS)
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {tuple(x) for x in db.execute(ORACLES["op2_url_filter"]).fetchall()}
    got = {tuple(x) for x in urlfilter.op2_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert got == want and len({x[4] for x in got if x[3] is None}) == 2


def test_only_dataframe_operations(spark):
    plan = urlfilter.op2_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    many = [("block", f"h{k}.net", "/") for k in range(600)]
    plan = urlfilter.judge(pages, urlfilter.link_edges(pages), many)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|ExistingRDD", plan)


def exact_neighbours(vectors, k=5):
    rows = [(i, np.array(v, float)) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % 50 == 0:
            near = [(-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 12), j) for j, v in rows if j != i and len(v) == len(q)]
            out[i] = sorted(near)[:k]
    return out


def test_nearest(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(6, 16))
    vectors = [(k, (centres[k % 6] + 0.4 * r.normal(size=16)).astype(np.float32).tolist()) for k in range(1500)]
    same = vectors[3][1]
    vectors += [(k, same) for k in range(1500, 1800)]
    vectors += [
        (2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] + [0.0] * 14), (2200, []),
        (2250, [1.0, 2.0]), (2251, [2.0, 1.0])
    ]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = exact_neighbours(vectors)
    got = {}
    for x in nearest.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, -round(x.score, 12), x.vec_id))
    assert set(got) == {k for k, v in want.items() if v}
    hits = []
    for k, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, len(want[k]) + 1))
        assert [n[1:] for n in near] == sorted(n[1:] for n in near)
        hits.append(len({n[2] for n in near} & {j for _, j in want[k]}) / len(want[k]))
    assert np.mean(hits) >= 0.9
    assert [n[2] for n in sorted(got[1550])] == [3, 1500, 1501, 1502, 1503]
    assert [n[2] for n in got[2250]] == [2251]
    assert nearest.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_measures_its_settings(spark, monkeypatch):
    """The number of projections comes from the data, and hot buckets are dealt out in blocks on both sides."""
    monkeypatch.setattr(nearest, "ROWS_A_PART", 150)
    monkeypatch.setattr(nearest, "QUERIES_A_PART", 5)
    r = np.random.default_rng(10)
    found = {}
    for name, spread in (("tight", 0.15), ("loose", 1.5)):
        centres = r.normal(size=(50, 32))
        vectors = [(k, (centres[k % 50] + spread * r.normal(size=32)).astype(np.float32).tolist()) for k in range(3000)]
        vectors += [(3000 + k, vectors[50 * k][1]) for k in range(20)] + [(vectors[100][0], vectors[7][1])]
        df = spark.createDataFrame([(*v, 0.0, 1, "x") for v in vectors], "vec_id long, embedding array<float>, score double, rep int, bucket string")
        classes = df.selectExpr("vec_id as rep", "embedding as vec").where("vec_id < 3000").dropDuplicates(["rep"])
        found[name] = nearest.measured(classes, 5)
        if name == "tight":
            want = exact_neighbours(vectors[:-1])
            got = {}
            for x in nearest.search(df, F.col("vec_id") % 50 == 0).collect():
                got.setdefault(x.query_id, set()).add(x.vec_id)
            hits = [len(got[k] & {j for _, j in near}) / 5 for k, near in want.items() if k != 100]
            assert set(got) == set(want) and np.mean(hits) >= 0.9
    assert found["tight"].projections > found["loose"].projections


def test_nearest_with_the_settings_of_large_tables(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 64))
    vectors = [(k, (centres[k % 40] + 0.7 * r.normal(size=64)).tolist()) for k in range(4000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    want = exact_neighbours(vectors)
    got = {}
    for x in nearest.search(df, F.col("vec_id") % 50 == 0, settings=nearest.Settings()).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert nearest.Settings().projections == 6 and set(got) == set(want)
    assert np.mean([len(got[k] & {j for _, j in near}) / 5 for k, near in want.items()]) >= 0.9


def test_nearest_of_many_collinear_vectors(spark):
    """Distinct vectors of one cosine: the smallest ids win, in the buckets and in the exact search of few rows."""
    order = [(k * 37) % 101 for k in range(1, 101)]  # ids in no order of length
    vectors = [(x, [3.0 * 2.0**i, 1.0 * 2.0**i, -2.0 * 2.0**i]) for i, x in zip(range(-50, 50), order, strict=True)]
    df = spark.createDataFrame([*vectors, (200, [3.0, 1.5, -2.0]), (201, [-1.0, 0.0, 9.0])], "vec_id long, embedding array<double>").repartition(3)
    scaled = spark.createDataFrame(
        [(k, [3.0 * 2.0**k, 1.0 * 2.0**k, -2.0 * 2.0**k]) for k in range(30)] + [(200, [3.0, 1.5, -2.0])],
        "vec_id long, embedding array<double>"
    )
    got = sorted((x.rank, x.vec_id) for x in nearest.search(scaled, F.col("vec_id") == 200).collect())
    assert got == [(k + 1, k) for k in range(5)]
    for few in (df, df.where("vec_id <= 20 or vec_id = 200")):
        got = sorted((x.rank, x.vec_id) for x in nearest.search(few, F.col("vec_id") == 200).collect())
        assert got == [(k, k) for k in range(1, 6)]


def test_best_keeps_ties_by_id():
    r = np.random.default_rng(4)
    rows = np.outer(2.0 ** np.arange(20), [1.0, 2.0, 3.0])
    reps = r.permutation(20) + 1
    best = nearest.Best(5)
    best.add(np.array([99]), np.array([[3.0, 2.0, 2.0]]), rows, [[x] for x in reps.tolist()], reps)
    assert best.rows().column("vec_id").to_pylist() == [1, 2, 3, 4, 5]


PAGES = [
    (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a>one</a></li><li><a>two</a></li></ul></nav><div class='ad big'>buy this thing now please</div><article><h1>The title</h1><p>First <b>bold</b>  words &amp; more.<p>Second&nbsp;one<br>here.</p></article><footer>the end of it</footer></body></html>",
        "The title\n\nFirst bold words & more.\n\nSecond one here."
    ),
    (
        "<body><div id=main><p>Some words of the text that matter here</p><script>var x='</p><p>not text</p>';</script><p>and others that follow</p></div><div class='user-comments'><p>a long comment by a reader that has very many words in it, more than the text</p></div></body>",
        "Some words of the text that matter here\n\nand others that follow"
    ),
    ("<article><p>Cut off text with words &amp; a ta<b", "Cut off text with words & a ta"),
    ("<article><p>a</p><aside>no no no no</aside><form>name please</form><p>one more line of text</p></article>", "a\n\none more line of text"),
    ("plain words only", "plain words only"),
    ("", ""),
    (None, ""),
    ("<nav>menu only</nav>", ""),
    ("<p>" + "word " * 20000 + "</p>", ("word " * 20000).strip()),
    ("<!-- <p>hidden</p> --><p>shown text", "shown text"),
]


def test_html(spark):
    df = spark.createDataFrame(
        [(k, f"u{k}", h, "x", 1) for k, (h, _) in enumerate(PAGES)],
        "page_id long, url string, html string, text string, n_chars int"
    )
    assert htmltext.extracted(df.union(df)).count() == 2 * len(PAGES)
    got = {r.page_id: r for r in htmltext.extracted(df).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert got[k].text == want and got[k].n_chars == len(want) and got[k].url == f"u{k}"
    assert htmltext.extracted(df.where("false")).count() == 0


def test_tag_weights_are_learnt_from_pages():
    weights = htmltext.tag_weights()
    assert all(w < 0 for w in weights.values())
    assert weights["p"] > weights["a"] and weights["p"] > weights["div"] > weights["nav"] and weights["td"] > -0.5
    fresh = [labelledpages.page(random.Random(k)) for k in range(900, 960)]  # none of the pages that the weights are learnt from
    assert htmltext.agreement(fresh, weights) > 0.98


def test_the_scan_is_the_maximum_over_all_runs():
    r = random.Random(2)
    for _ in range(400):
        scores = [r.choice((-3, -2, -1, -0.5, 0, 1, 2, 4, float("-inf"))) for _ in range(r.randrange(14))]
        every = [(sum(scores[a:b]), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if sum(scores[a:b]) > 0]
        best = max(every, default=(0, 0, 0))
        begin, end = htmltext.best_run(scores)
        assert sum(scores[begin:end]) == best[0] and (not every or begin == -best[1])


LINES = "<p>The words of the page that a reader came for, some of them here.</p>"
LINE = "The words of the page that a reader came for, some of them here."
WHOLE = [
    (f"<article>{LINES}<svg width='1'/>{LINES}<svg><text>drawn words</text></svg>{LINES}</article>", [LINE] * 3),
    (f"<article>{LINES}<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><math/>{LINES}</article>", [LINE, "so x=2 holds", LINE]),
    ("<nav><a>one</a></nav><div class='legal-article'>a few words only</div>", ["a few words only"]),
    *((f"<nav><a>one</a></nav><div class='{name}'>{LINES}{LINES}</div><footer>not this</footer>", [LINE] * 2) for name in ("tags", "popular", "discussion", "notice")),
    (
        f"<article>{LINES}<table>" + "".join(f"<tr><td>row {k}</td><td>{k}</td></tr>" for k in range(20)) + f"</table>{LINES}</article>",
        [LINE, *(x for k in range(20) for x in (f"row {k}", str(k))), LINE]
    ),
    (
        f"<header><a>site</a></header><article><header class='entry-header'><h1>A title</h1><p>The lead of it</p></header>{LINES}<footer><p>not this</p></footer></article>",
        ["A title", "The lead of it", LINE]
    ),
    (
        "<div id=c>" + "".join(f"<div>sentence number {k} has words</div>" for k in range(12)) + "</div>",
        [f"sentence number {k} has words" for k in range(12)]
    ),
]


def test_html_keeps_whole_articles():
    for html, want in WHOLE:
        assert htmltext.extract(f"<body>{html}</body>") == "\n\n".join(want), html


ARTICLE = "<h1>A name</h1><p>The words of the page that a reader came for, some of them.</p><p>And a second paragraph of it.</p>"
ARTICLE_TEXT = "A name\n\nThe words of the page that a reader came for, some of them.\n\nAnd a second paragraph of it."
MENU, REPLY = "<ul><li><a>one</a></li><li><a>two</a></li></ul>", "<p>A reader's reply with many words in it, many more than the text has, as it goes on and on and on, in one sentence.</p>"
WRAPPED = [
    f"<body><div class='content no-sidebar'>{ARTICLE}</div></body>",
    f"<body><div id='page' class='with-sidebar hasMenu'>{ARTICLE}<div class='sidebar'><p>not this</p></div></div></body>",
    f"<body><a>site</a><section class='discussion'>{ARTICLE}</section></body>",
    f"<body><form id='aspnetForm'><div class='header'>{MENU}</div><div>{ARTICLE}</div><div class='footer'><p>not this</p></div></form></body>",
    f"<body><form><section class='discussion'>{ARTICLE}</section></form></body>",
    f"<body><div class='left-sidebar'><main>{ARTICLE}</main></div><div><p>words of something else</p></div></body>",
    f"<body><nav>{MENU}<div>{ARTICLE}</div></body>",
    f"<body><div><form action='/q'><input>{ARTICLE}</div><footer>not this</footer></body>",
    f"<body><div>{ARTICLE}</div><div class='comments'>{REPLY * 9}</div></body>",
    f"<body><article>{ARTICLE}</article><section class='related'><article>{REPLY * 9}</article></section></body>",
]


def test_html_wrappers_are_left_to_the_scan():
    for html in WRAPPED:
        assert htmltext.extract(html) == ARTICLE_TEXT, html
    assert htmltext.extract(f"<body><div hidden>{ARTICLE}</div><form>name please</form><nav>{MENU}</nav></body>") == ""
