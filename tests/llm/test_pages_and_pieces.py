"""Page operators, segmentation, and the pipeline."""

import html as html_
import os
import re

import pytest

from millrace.llm import html_extract, html_pages, url_filter
from millrace.llm import sentencepiece_nbest as sp


@pytest.fixture(scope="module")
def model():
    return html_extract.built_in()


def test_marginals_are_exact(model):
    """Sum-product marginals against summing over all labellings of a small tree."""
    import itertools
    import math

    nodes, _ = html_extract.parse("<div class='post'><p>Some text here. And more.</p><ul><li><a href=x>link</a></li></ul></div><footer>x</footer>")
    own = [sum(model.unary.get(f, 0.0) for f in html_extract.features(n)) for n in nodes]
    total, mass = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        e = sum(o * v for o, v in zip(own, y, strict=True)) + sum(model.pair[html_extract._KIND.get(n.tag, 0)][y[n.parent]][y[i]] for i, n in enumerate(nodes) if i)
        w = math.exp(e)
        total += w
        mass = [m + w * v for m, v in zip(mass, y, strict=True)]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), mass, strict=True))


def test_held_out_pages(model):
    wrong = total = 0
    for seed in range(5000, 5080):
        source, labels = html_pages.page(seed)
        _, runs = html_extract.parse(source)
        plain = [(" ".join(html_.unescape(re.sub(r"<[^>]*>", "", t)).split()), c) for t, c in labels]
        assert [t for t, _ in plain] == runs
        want = " ".join(t for t, c in plain if c)
        total += 1
        wrong += html_extract.main_text(model, source) != want
    assert wrong / total < 0.1


def test_extraction_cases(spark, model):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two <b>three<br>four.</p><script>x('</p>')</script><p>Five&nbsp;six, é.</article><footer>&copy; x</footer>"
    rows = [(1, "u", page, 9), (2, None, None, 9), (3, "u", "", 9), (4, "u", "<nav><a href=x>y</a></nav>", 9), (1, "u", page, 9), (5, "u", "<div>" * 3000, 9)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and texts[1] == "A & B One two three four. Five six, é." and texts[2] == texts[3] == texts[4] == texts[5] == ""
    assert all(r.n_chars == len(r.text) for r in got)


def test_url_rules(spark):
    rows = [(1, "https://A.Example.NET/en/x?q", None), (2, "http://b.net/en/", ""), (3, "http://example.net", None), (4, "http://x.example.com/de/1#f", None), (5, "http://x.example.com/en/de/", None), (6, "ftp://y.org/fr/z", None), (7, None, "<p>"), (8, "no scheme/en/", None), (9, "http://notexample.net/", None), (9, "http://notexample.net/", None)]
    got = url_filter.judge(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == 10
    assert found[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and found[2] == ("b.net", "/en/", "net/", "block")
    assert found[3] == ("example.net", "", None, "allow") and found[4][2:] == ("example.com/de/", "block") and found[5][2:] == (None, "allow")
    assert found[6][2:] == ("org/fr/", "allow") and found[7] == ("", "", None, "allow") == found[8] and found[9][2:] == ("net/", "block")


def test_distrust_spreads_against_links(spark):
    """fine.com links to a blocked host but has more trust than distrust."""
    link = lambda *h: "".join(f'<a href="https://{x}/p">x</a>' for x in h)
    rows = [(1, "http://farm.com/a", link("bad.net", "bad.net")), (2, "http://bad.net/x", link("bad.net")), (3, "http://good.org/fr/1", link("fine.com")), (4, "http://fine.com/", link("bad.net")), (5, "http://far.com/", link("farm.com")), (6, "http://alone.com/", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_seeds_do_not_need_a_majority_of_a_hosts_pages(spark):
    """A third of x.example.com's and of good.org's pages have a rule; both are seeds all the same."""
    link = lambda h: f'<a href="https://{h}/p">x</a>'
    rows = [(1, "http://x.example.com/de/1", ""), (2, "http://x.example.com/en/2", ""), (3, "http://x.example.com/en/3", ""), (4, "http://farm.com/", link("x.example.com"))]
    rows += [(5, "http://good.org/fr/1", link("fine.com")), (6, "http://good.org/en/2", ""), (7, "http://good.org/en/3", ""), (8, "http://fine.com/", link("bad.net")), (9, "http://bad.net/", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 4, 9}


def test_rank_is_personalised_pagerank(spark):
    import numpy as np

    from millrace import runtime

    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 1.0), ("c", "a", 1.0)]
    m = np.zeros((3, 3))
    for s, t, w in edges:
        m["abc".index(t), "abc".index(s)] = w
    want = np.linalg.solve(np.eye(3) - 0.85 * m, 0.15 * np.array([1.0, 0, 0]))
    work = runtime.Workspace(spark, "t")
    got = url_filter.rank(spark.createDataFrame(edges, "src string, dst string, share double"), spark.createDataFrame([("a", 1.0)], "host string, mass double"), work, tolerance=1e-9)
    assert all(abs(r.score - want["abc".index(r.host)]) < 1e-5 for r in got.collect())


needs_model = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary file")


def brute(v, s):
    out = []

    def go(i, total, path):
        if i == len(s):
            out.append((total, v.ids(path)))
            return
        single = False
        for j in range(i + 1, len(s) + 1):
            if e := v.edges.get(s[i:j]):
                go(j, total + e[0], [*path, e[1]])
                single |= j == i + 1
        if not single:
            go(i + 1, total + v.unknown, [*path, s[i]])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@needs_model
@pytest.mark.parametrize("text", ["hello wo", "  a b ", "thnt é😀", "\n\tx y", "▁a", "the there", "aaaa", "<0x41>", " "])
def test_n_best(text):
    v = sp.Vocabulary.load(sp.MODEL)
    want = brute(v, " " + text)
    got = sp.Encoder(v).encode(["", text], 6)[1]
    assert [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in want[:6]]
    assert len({tuple(i.tolist()) for _, i in got}) == len(got)
    assert all(v.decode(i.tolist()) == text for _, i in got)


@needs_model
def test_pieces_round_trip(spark):
    texts = [None, "", " ", "a", "Ünï\r\n\tcode ▁▁ x  y   z", "w" * 5000, "abc " * 2000, "abc"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, "a", "c")], "doc_id long, text string, ids string")
    got = sp.decode(sp.encode(df)).collect()
    assert len(got) == len(texts) + 1 and all(r.decoded == (texts[r.doc_id] or "") for r in got)
    assert all(len(r.n_best) <= 3 and r.n_best[0].ids_sha256 == sp.digest(r.ids) for r in got)


@needs_model
def test_pieces_under_small_bounds(spark, monkeypatch):
    """What a worker forgets, and how many lattices are solved at once, changes nothing; nor does the round trip in one pass."""
    import pyarrow as pa

    texts = [f"word{i % 7} the {'x' * (i % 5)} end{i}  é😀 {i * 37}" for i in range(60)] + ["", None, "long" * 300]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    v = sp.Vocabulary.load(sp.MODEL)
    whole = [r for b in sp._rows(iter([batch]), v, 3, True) for r in b.to_pylist()]
    for name, value in (("_KNOWN", 40), ("_BLOCK", 25), ("_SLICE", 100)):
        monkeypatch.setattr(sp, name, value)
    assert [r for b in sp._rows(iter([batch]), v, 3, True) for r in b.to_pylist()] == whole
    assert [r["decoded"] for r in whole] == [t or "" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = lambda rows: sorted((r.asDict(True) for r in rows.collect()), key=lambda r: r["doc_id"])
    assert plain(sp.round_trip(df)) == plain(sp.decode(sp.encode(df)))
    assert sp.round_trip(df.limit(0)).count() == 0


def test_pipeline_near_duplicates_are_of_five_words(spark):
    """One changed word of 50: 0.80 or more on five-word shingles, under 0.85 on four-word ones."""
    import corpus_pipeline
    from tests.llm.rows import frame
    from tests.llm.test_documents import brute_components

    base = [f"w{k}" for k in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:25], "other", *base[26:]])), (3, " ".join([*base[:20], "a", *base[21:30], "b", *base[31:]])), (4, "alone")]
    heads = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert heads == {1, 3, 4} and {i for i, _, c in brute_components(rows) if i == c} == {1, 2, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()} == heads


@needs_model
def test_pipeline(spark, small):
    """Stages against brute force on the smallest tables: what goes, what stays, what changes."""
    import collections

    import corpus_pipeline
    from tests.llm.test_documents import brute_components

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    known = stages["language_id"](spark, docs, small)
    assert known.count() == docs.count() and known.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    heads = {i for i, n, c in brute_components(rows) if i == c or not n}
    one = stages["jaccard_join"](spark, docs, small).cache()
    assert collections.Counter(r.doc_id for r in one.collect()) == collections.Counter(heads)
    ids = {r.doc_id for r in stages["decontaminate"](spark, docs, small).collect()}
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for w in map(split, bench) for k in range(max(1, len(w) - 9))}
    dirty = {i for i, t in rows if any(tuple(w[k : k + 10]) in windows for w in [split(t)] for k in range(len(w) - 9))}
    assert ids == {i for i, _ in rows} - dirty
    red = {r.doc_id: r for r in stages["secret_scan"](spark, docs, small).collect()}
    for i, t in rows:
        want = re.sub(r'(token = ")[0-9a-f]{40}"', r'\1<SECRET>"', t)
        assert red[i].text == want and red[i].n_chars == len(want)
    final = corpus_pipeline.run(spark, small).collect()
    assert 0 < len(final) <= len(heads - dirty) and all(r.n_pieces == len(r.ids) for r in final)
