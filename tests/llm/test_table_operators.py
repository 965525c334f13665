"""URL filters, embeddings and pages against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, graph, html, urlfilter
from tidemark.llm.urlfilter import Rule

# URL filters

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a.b.org", "/fr/x")]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    tail = rest[len(host) :]
    path = next((tail[:i] for i, c in enumerate(tail) if c in "?#"), tail)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls_equal_rules(spark):
    rng = random.Random(1)
    hosts = ["net", "x.net", "Example.NET", "m.example.net", "notexample.net", "example.com", "w.example.com", "a.b.org", "z.a.b.org", "org", "b.org", "net.com", "É.org", "user:p@x.net:80", ""]
    paths = ["", "/", "/en/", "/en", "/de/1", "/fr/x/y", "/fr/", "/FR/", "//en/", "/en/?q=://z", "?a=/en/", "#/fr/", "/fr/x#t"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "") for h in hosts for p in paths] + [None, "", "a://b://c/d", "http:///en/", "https://x.net\n/en/", "http://" + "a." * 5000 + "net/x"]
    rows = [(i, u, "x", "k") for i, u in enumerate(urls)] + [(None, "http://x.net/", "x", "k"), (0, urls[0], "x", "k")]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, keys string").repartition(3)
    found = urlfilter.judge_urls(pages, RULES, rate=0.3).collect()
    key = lambda p: tuple((x is None, str(x)) for x in p)
    assert sorted([tuple(r) for r in found], key=key) == sorted([(i, *judged(u, RULES)) for i, u, _, _ in rows], key=key)


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(2)
    keys = [f"key{i}" for i in range(20_000)]
    listed = rng.sample(keys, 300)
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = urlfilter.build_cascade(universe, listed, rate=0.4)
    assert len(levels) > 2
    hashed = universe.select("key", *[c.alias(f"h{n}_{i}") for n in range(len(levels)) for i, c in enumerate(urlfilter.key_hashes(n))]).toPandas()
    pairs = [(hashed[f"h{n}_0"].to_numpy(), hashed[f"h{n}_1"].to_numpy()) for n in range(len(levels))]
    assert set(hashed["key"][urlfilter.is_listed(levels, pairs, len(hashed))]) == set(listed)


def test_filters_have_a_checked_bound(spark):
    with pytest.raises(ValueError):
        urlfilter.build_level(spark.range(1000).select(F.col("id").cast("string").alias("key")), 0, 0.001, most_bytes=64)


def test_parts_of_keys_give_the_same_verdicts(spark):
    rules = [Rule("block" if i % 3 else "allow", f"h{i}.org", "/") for i in range(200)]
    pages = spark.createDataFrame([(i, f"http://x.h{i % 400}.org/{i}") for i in range(800)], "page_id bigint, url string").repartition(3)
    whole, dealt = ({tuple(r) for r in urlfilter.judge_urls(pages, rules, most_bytes=n).collect()} for n in (1 << 20, 128))
    assert whole == dealt == {(i, *judged(f"http://x.h{i % 400}.org/{i}", rules)) for i in range(800)}


def test_equal_rules_of_two_verdicts_have_an_order(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id bigint, url string")
    for rules in ([Rule("block", "net", "/"), Rule("allow", "net", "/")], [Rule("allow", "net", "/"), Rule("block", "net", "/")]):
        assert [tuple(r)[3:] for r in urlfilter.judge_urls(pages, rules).collect()] == [("net/", "allow")]


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id bigint, url string")
    assert [r["verdict"] for r in urlfilter.judge_urls(pages, []).collect()] == ["allow"]
    assert urlfilter.judge_urls(pages.limit(0), RULES).count() == 0


# Embeddings


def linked(rows, threshold):
    """links and component of every row."""
    ok = lambda v, label: label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            (a, u, k), (b, v, m) = rows[i], rows[j]
            if ok(u, k) and ok(v, m) and k == m and len(u) == len(v):
                x, y = np.array(u, float), np.array(v, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(links[i], least.get(find(i))) for i in range(n)]


@pytest.mark.parametrize("limit", [8, 4096])
def test_vectors_equal_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    rows, number = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            rows.append((number, rng.normal(size=16).astype(np.float32).tolist(), label))
            number += 1
    centre = rng.normal(size=16)
    for scale in (0.01, 0.04, 0.06):
        for _ in range(25):
            rows.append((number, (centre + scale * rng.normal(size=16) * 2).astype(np.float32).tolist(), 1))
            number += 1
    for i in range(20):
        rows.append((number, rows[i % 4][1], 0))
        number += 1
    rows += [(number + 1, None, 1), (number + 2, [0.0] * 16, 1), (number + 3, [float("nan")] * 16, 1), (number + 4, [float("inf")] + [1.0] * 15, 1), (number + 5, [], 1), (number + 6, [None] + [1.0] * 15, 1)]
    rows += [(number + 7, [1.0, 2.0, 3.0], 1), (number + 8, [2.0, 4.0, 6.0], 1), (number + 9, [-1.0, -2.0, -3.0], 1), (number + 10, [1e20, 2e20, 3e20], 1), (None, [1.0, 2.0, 3.0], 1), (3, rows[3][1], 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, cell string, block int").repartition(3)
    table32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    found = embeddings.near_duplicates(table, 0.98, blocks=4, limit=limit).collect()
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in found))
    expected = sorted(((i is None, i or 0, n, c if c is not None else -1) for (i, _, _), (n, c) in zip(table32, linked(table32, 0.98), strict=True)))
    assert got == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_large_and_small_components(spark):
    rows = [(0, [1e200, 2e200], 1), (1, [1e-200, 2e-200], 1), (2, [2e200, -1e200], 1), (3, [1e308, 1e308], 1), (4, [5e-324, 5e-324], 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert found == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (1, 3), 4: (1, 3)}


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_blocks_cover_the_budget():
    parts = embeddings.block_slices(64, 8)
    assert sum(embeddings.budget(p, 64, 0.98) for p in parts) >= 0.04
    x = embeddings.rotated(np.random.default_rng(1).normal(size=(50, 24)))
    y = embeddings.rotated(np.random.default_rng(1).normal(size=(50, 24))[7:8])
    assert np.allclose((x * x).sum(1), 1) and (x[7] == y[0]).all()


# Components


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(900, 901), (901, 902), (902, 900), (7, 7), (None, 3), (3, None)] + [(160 - 3, 520)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {x: find(x) for x in root}


# Pages


def test_articles_are_cut_out():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><p>menu</p></nav><header><h1>Site</h1></header>
<div class="ad">buy</div><article><header><h1>A&amp;B</h1></header><p><b>One<br>two &nbsp; three<p>four <a href="x>y">five</a></p><aside>side</aside><div class="share-buttons"><p>share</p></div>
<form><p>mail</p></form><!-- <p>hidden</p> --><section class="comments"><article class="comment"><p>first!</p></article></section><p>six &#233; &copy</p></article><footer>end</footer></body></html>"""
    assert html.main_text(page) == "A&B\n\nOne two three\n\nfour five\n\nsix é ©"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""
    assert html.main_text("plain & simple") == "plain & simple"
    assert html.main_text("<div class='menu'>x<article><p>in</p>") == "in"
    assert html.main_text("<main><p>a</p><div role='navigation'>n</div></main><p>out</p>") == "a"
    assert html.main_text("<div class='post-content'><div>a</div><div>b</div></div><div>c</div>") == "a\n\nb"
    assert html.main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000


def wrapper_of(pages):
    """Wrappers of equal shapes merged in any order, then in order of their shapes."""
    held = {}
    for page in pages:
        tree = html.grown(page)
        key, own = html.xxhash.xxh64_intdigest(html.shape_of(tree)) >> 1, html.of_page(tree)
        held[key] = html.merged(held[key], own) if key in held else own
    whole = None
    for key in sorted(held):
        whole = held[key] if whole is None else html.merged(whole, held[key])
    return html.ready(whole)


def test_wrapper_finds_slots_groups_and_options():
    pages = [f"<ul>{'<li>x' * n}</ul><p>Site</p><h1>{t}</h1>{'<div>new</div>' if n > 2 else ''}" for n, t in ((2, "a"), (3, "b"))]
    text = html.expression(wrapper_of(pages))
    assert "( <li> li= </li> )+" in text and "p= h1#" in text and "( <div> div= </div> )?" in text


def written_pages(rng, count, declared):
    """Pages of one layout with the main text of each; ``declared`` names the parts, else all are plain elements."""
    say = lambda n: " ".join(rng.choice(["lo", "ra", "mi", "so", "na", "ti"]) + rng.choice(["ku", "pe", "du", "ma"]) for _ in range(n))
    nav, article, footer, ad = ("nav", "article", "footer", ' class="ad"') if declared else ("div", "div", "div", "")
    out = []
    for i in range(count):
        blocks = [say(rng.randint(2, 6)), *(say(rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        menu = "".join(f'<li><a href="/{j}">{say(2)}</a></li>' for j in range(5))
        alert = "<div>Our site is in beta</div>" if i % 3 else ""
        out.append((f"<body><{nav}><ul>{menu}</ul></{nav}>{alert}<div{ad}>{say(4)}</div><{article}>{body}</{article}><{footer}>{say(5)}</{footer}></body>", "\n\n".join(blocks)))
    return out


@pytest.mark.parametrize("declared", [True, False])
def test_wrappers_decide_the_main_text(spark, declared):
    rng = random.Random(31)
    pages = {h: written_pages(rng, 40, declared) for h in ("a.org", "b.org")}
    rows = [(i, f"http://{h}/{i}", page, h) for h in pages for i, (page, _) in enumerate(pages[h])]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").repartition(5)
    for limit in (32 << 20, 0):
        found = {(r["url"]): r["text"] for r in html.extract_text(table, broadcast_bytes=limit).collect()}
        assert found == {f"http://{h}/{i}": text for h in pages for i, (_, text) in enumerate(pages[h])}
    alone = [html.main_text(page) == text for h in pages for page, text in pages[h]]
    assert all(alone) if declared else not all(alone)  # without a wrapper some results change
    empty = html.Node("page", 0, [], [])
    assert declared or any(html.main_text(page, empty) != text for page, text in pages["a.org"])


def test_wrappers_do_not_depend_on_partitions(spark):
    rng = random.Random(33)
    pages = [page + "<div><p>x</p></div>" * rng.randint(0, 3) + "<section>y</section>" * rng.randint(0, 1) for page, _ in written_pages(rng, 60, False)]
    wanted = html.expression(wrapper_of(pages))
    table = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    for parts in (1, 7):
        found = html.host_wrappers(table.repartition(parts)).collect()
        assert [html.expression(html.unpacked(html.json.loads(r["wrapper"]))) for r in found] == [wanted]
    assert html.host_wrappers(table, bucket_shapes=2).count() == 1


def test_article_blocks_stay_whatever_their_class_names():
    pages = [f"<article><h1>t{i}</h1><div class='share-prices'><p>{'long text of the story ' * 20}{i}</p></div><div class='share'>tell a friend</div></article>" for i in range(12)]
    wrapper = wrapper_of(pages)
    assert html.main_text(pages[3], wrapper) == f"t3\n\n{'long text of the story ' * 20}3"
    notice = [f"<div><p>story {i} goes on</p><p>All rights reserved</p></div>" for i in range(12)]
    assert html.main_text(notice[3], wrapper_of(notice)) == "story 3 goes on"
    copies = [notice[0]] * 12
    assert html.main_text(copies[0], wrapper_of(copies)) == "story 0 goes on\n\nAll rights reserved"


def test_odd_pages_are_read_whole():
    wide = "<div>" + "".join(f"<{t}>{i} w</{t}>" for i in range(300) for t in ("h2", "p", "section")) + "</div>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end</p>"
    assert html.main_text(wide).count("w") == 900 and html.main_text(wide, wrapper_of([wide, wide.replace("w", "w w"), deep])).count("w") == 900
    assert html.main_text(deep) == "deep\n\nend"
    assert html.main_text("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e<ul><li>f</ul><li>g</ul>") == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"


def test_template_texts_go_where_no_article_is_declared(spark):
    make = lambda t: f"<div><div>Home</div><div>All rights</div><div>{t}</div></div>"
    rows = [(i, f"http://h{i % 2}.org/{i}", make(f"story {i}"), "x") for i in range(12)] + [(50, None, None, "x"), (51, "http://solo.org/", make("alone"), "x"), (52, "http://solo.org/", make("alone"), "x"), (None, "nope", "<p>t</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").repartition(3)
    for limit in (32 << 20, 0):
        found = {r["page_id"]: r["text"] for r in html.extract_text(pages, broadcast_bytes=limit).collect()}
        assert all(found[i] == f"story {i}" for i in range(12))
        assert found[50] == "" and found[51] == found[52] == "Home\n\nAll rights\n\nalone" and found[None] == "t"
    assert html.extract_text(pages.limit(0)).count() == 0
