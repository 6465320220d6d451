"""Operators on whole tables against brute force on small ones, and the pipeline."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from reckonry.llm import op02_decontaminate as clean
from reckonry.llm import op03_urls as urls
from reckonry.llm import op05_shards as shards
from reckonry.llm import op06_licenses as licenses
from reckonry.llm import op07_neardup as near
from reckonry.llm import op10_html as pages
from reckonry.llm import registry
from reckonry.plans.check import rows_of, sql_connection

FOLDER = "/root/testdata/sf0.001"


def made_words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


# ---- near duplicates

def _shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def _components(rows, percent=85):
    sets, of = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                of[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_duplicates_against_all_pairs(spark):
    draw, rows = random.Random(5), []
    for group in range(6):
        base = made_words(60 + 20 * group, group)
        for _ in range(9):
            copy = list(base)
            for at in draw.sample(range(len(copy)), draw.randrange(5)):
                copy[at] = "changed" + str(draw.randrange(10**6))
            rows.append(" ".join(copy).upper() if draw.random() < 0.3 else " \n".join(copy))
    rows += [rows[0], rows[0], None, "", " ", "a b", "A  B", "a b c d e"]
    draw.shuffle(rows)
    rows = list(enumerate(rows, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == _components(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(130, 7), (300, 299), (5, 5)]
    got = dict(map(tuple, near.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 1 for i in [*range(1, 41), *range(100, 140)]} | {299: 299, 300: 299}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = near.near_duplicates(odd_docs).collect()
    assert len(rows) == 11 and near.near_duplicates(no_docs).collect() == []
    assert {(r["component_id"], r["kept"]) for r in rows if r["doc_id"] == 5} == {(4, False)}
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]


# ---- decontamination

def test_leaks_against_all_windows(spark, no_docs, odd_docs):
    draw = random.Random(9)
    items = [(k, " ".join(made_words(draw.randrange(12, 40), 100 + k))) for k in range(12)] + [(90, None), (91, "too short"), (92, "")]
    rows = []
    for i in range(60):
        words = made_words(120, 1000 + i)
        if i % 3:
            part = items[draw.randrange(12)][1].split()
            for _ in range(draw.randrange(3)):
                part[draw.randrange(len(part))] = "edited"
            at = draw.randrange(len(words))
            words[at:at] = part
        rows.append((i, " ".join(words)))
    rows += [(70, None), (71, ""), (72, "too short"), (73, items[0][1]), (74, items[0][1].upper())]

    def hold(text, item):
        words = (text or "").lower().split()
        own = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        want = item.lower().split()
        want = [tuple(want[i:i + 5]) for i in range(len(want) - 4)] or ([tuple(want)] if want else [])
        best = 0
        for start in range(1 - len(want), len(own)):
            window = own[max(start, 0):start + len(want)]
            if window and want:
                both = sum((Counter(window) & Counter(want)).values())
                best = max(best, both / (len(window) + len(want) - both))
        return best >= 0.8

    want = {(i, k) for i, t in rows for k, item in items if item and hold(t, item)}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):  # the small benchmark's way, and the large one's
        assert {(r["doc_id"], r["item_id"]) for r in clean.leaks(docs, bench, limit=limit).collect()} == want
    assert len(want) > 20
    assert clean.leaks(no_docs, bench).collect() == [] and clean.leaks(odd_docs, bench).collect() == []
    assert clean.leaks(docs, bench.where("false")).collect() == []


def test_leaks_in_another_order(spark):
    items = [(k, made_words(104 + k, 300 + k)) for k in range(6)]
    rows = []
    for k, words in items:
        around = made_words(60, 400 + k)
        rows.append((k, " ".join(around + words[52:] + words[:52] + around)))
        rows.append((10 + k, " ".join(words[70:] + words[:70] + around)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (10**6, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in clean.leaks(docs, bench, limit=limit).collect()}
        assert set(got) == {(i, i % 10) for i, _ in rows}
        assert all(got[k, k]["similarity"] == (96 + k) / (104 + k) and got[k, k]["start_word"] == 60 for k, _ in items)


def test_blocks_meet_within_the_radius(spark):
    base = made_words(40, 3)
    hashes = spark.createDataFrame([(base,)], "w array<string>").selectExpr("transform(w, x -> xxhash64(x)) as h")
    one, two = (hashes.select(clean.fingerprint_blocks(e).alias("b")).first()["b"] for e in ("h", "slice(h, 1, 39)"))
    assert len(one) == 16 and all(0 <= v < 256 for v in one) and sum(a == b for a, b in zip(one, two)) >= 1


# ---- URLs

URLS = ["http://A.Example.COM/en/1", "https://www.example.com/en/2?x=1", "http://b.net/es/3#f", "http://b.net/ES/3", "x://net/fr/", "mailto:a@b", None, "",
        "http://com", "http://com?/", "http://notexample.com/en/", "http://h/p?q://r", "HTTP://ÀB.net/fr/é"]


def _parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def _rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_parts_and_rules(spark):
    table = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS * 2)], "page_id long, url string, bad boolean")
    rows = urls.judge(table).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = _parts(URLS[r["page_id"] % len(URLS)])
        rule, verdict = _rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urls.judge(table.where("false")).collect() == []


def test_url_templates(spark):
    bad = [(f"http://h.org/spam/{i}", True) for i in range(60)]
    good = [(f"http://h.org/{kind}/{i}", False) for i in range(60) for kind in ("news", "blog")]
    rows = [(i, *r) for i, r in enumerate(bad + good + [("http://h.org/spam/new", None)])]
    got = {r["path"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean")).collect()}
    assert got["/spam/new"]["template"] == "h.org/spam/**" and got["/spam/new"]["verdict"] == "block"
    assert got["/news/3"]["template"] == "h.org/blog|+1/**" and got["/news/3"]["verdict"] == "allow"


def _judged(spark, rows, schema="page_id long, url string, bad boolean"):
    return {(r["page_id"], r["path"]): r for r in urls.judge(spark.createDataFrame(rows, schema)).collect()}


def test_one_bad_section_among_many_equal_ones(spark):
    """A section with 3 % of its host's pages is told from the others by its own labels."""
    rows = [(k, f"http://h.org/s{k % 30}/{k}", k % 30 == 7) for k in range(6000)]
    assert all((r["verdict"] == "block") == (i % 30 == 7) for (i, _), r in _judged(spark, rows).items())


def test_sections_below_any_depth(spark):
    deep = "/".join("abcdefghij" * 3)
    rows = [(k, f"http://h.org/{deep}/{'bad' if k % 2 else 'good'}/{k}", k % 2 == 1) for k in range(800)]
    assert all((r["verdict"] == "block") == (i % 2 == 1) for (i, _), r in _judged(spark, rows).items())


def test_odd_urls(spark):
    """Null ids, repeats, very long paths, clashing columns."""
    long = "x" * 300_000 + "/y" * 3000
    rows = [(None, "http://h.org/a", None, 1, "p", "s"), (None, "http://h.org/a", None, 1, "p", "s"), (1, f"http://h.org/{long}", False, 1, "p", "s"),
            (2, "http://h.org//", None, 1, "p", "s"), (3, "http://h.org", None, 1, "p", "s"), (3, None, False, 1, "p", "s")]
    table = spark.createDataFrame(rows, "page_id long, url string, bad boolean, labelled int, prefix string, segments string")
    got = urls.judge(table).collect()
    assert len(got) == 6 and {r["verdict"] for r in got} == {"allow"}
    assert max(len(r["path"]) for r in got) == len(long) + 1


# ---- shards

def test_shards(spark, odd_docs, no_docs, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text").union(odd_docs.select("doc_id", "text"))
    out = shards.placed(docs, 16)
    rows = out.collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 3011 and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(map(tuple, docs.collect()))
    order = [r["doc_id"] or 0 for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.05  # no order left
    assert shards.placed(no_docs, 16).collect() == []
    assert set(shards.placed(odd_docs, 3).columns) == {"doc_id", "text", "source", "kept", "component_id", "shard", "slot"}
    shards.write_shards(out, str(tmp_path / "out"), rows_a_file=50)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3011


def test_equal_records_part_and_columns_are_of_any_type(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 100)
    rows = spark.range(4000).selectExpr("7 as doc_id", "'same' as text", "map('k', 1) as m", "array(map('a', 2)) as n", "'x' as record", "3L as bucket")
    path = tmp_path / "rows"
    rows.write.parquet(str(path))
    table = spark.read.parquet(str(path))
    out = shards.placed(table, 4)
    assert set(out.columns) == {"doc_id", "text", "m", "n", "record", "bucket", "shard", "slot"}
    got = sorted((r["shard"], r["slot"]) for r in out.collect())
    assert got == [(s, k) for s in range(4) for k in range(1000)]
    scattered = table.select(F.pmod(F.xxhash64(F.lit(17), F.monotonically_increasing_id()), F.lit(40)).alias("b")).groupBy("b").count().collect()
    assert len(scattered) == 40 and max(r["count"] for r in scattered) < 200  # no bucket of equal records
    again = shards.placed(table, 4, seed=18).collect()
    assert len(again) == 4000


def test_query_shuffles_whole_documents(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    paths, write = [], shards.write_shards
    monkeypatch.setattr(shards, "write_shards", lambda out, path, *more: (paths.append(path), write(out, path, *more)))
    rows = shards.op5_external_shuffle(spark, str(tmp_path)).collect()
    held = spark.read.parquet(paths[0])
    assert Counter((r["doc_id"], r["text"]) for r in held.collect()) == Counter(map(tuple, odd_docs.select("doc_id", "text").collect()))
    crc = lambda t: __import__("zlib").crc32((t or "").encode())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, crc(r["text"])) for r in held.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sorted((r["slot"], r["shard"]) for r in rows) == [(0, k) for k in range(11)]
    assert shards.shard_files(no_docs, 16).collect() == []


# ---- licenses

def test_licenses_against_all_windows(spark, odd_docs, no_docs):
    templates, draw = licenses.templates_of(spark), random.Random(4)
    split = lambda t: [w for w in __import__("re").split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    rows = []
    for i in range(80):
        words = made_words(150, 5000 + i)
        if i % 2:
            part = draw.choice(licenses.TEMPLATES)[1].split()
            if draw.random() < 0.4 and len(part) > 30:
                part[3] = "edited"
            at = draw.randrange(len(words))
            words[at:at] = part
        rows.append((i, " ".join(words)))
    want = {(i, name) for i, t in rows for name, text in licenses.TEMPLATES
            if len(grams(split(text)) & grams(split(t))) >= 0.8 * len(grams(split(text)))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (10**6, 0):
        assert {(r["doc_id"], r["license"]) for r in licenses.licenses(docs, templates, limit=limit).collect()} == want
    assert len(want) >= 40 and licenses.licenses(no_docs, templates).collect() == [] and licenses.licenses(odd_docs, templates).collect() == []


# ---- pages

PAGE = ("<html><head><title>T</title><style>x</style></head><body><nav><ul><li>Menu {0}</li></ul></nav><header>Site</header>"
        "{1}<aside>Side {0}</aside><div class='comments'>Nice {0}</div><footer>&copy; F {0}</footer></body></html>")


def _page(i, body):
    return (i, f"http://h.org/{i}", PAGE.format(i, body))


def test_page_text(spark):
    rows = [
        _page(1, "<article><h1>Head &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Five<script>var a='</p>';</script> six</article>"),
        _page(2, "<main><header><h1>Kept</h1></header><div class=ad>Buy</div><p>A &lt; B &#233;</p><ul><li>x<li>y</ul></main>"),
        (3, None, None), (4, "", ""), (5, "http://h.org/5", "<div>" * 5000 + "deep" + "</div>" * 5000), (6, "http://x.org/", "plain  text < 3"),
        (6, "http://x.org/", "plain  text < 3"),
    ] + [(k, f"http://w.org/{k}", f"<body><div>Welcome to w.org</div><div><p>Story {k}</p><p>more of {k}</p></div><div>All rights</div></body>") for k in range(10, 16)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, pages.extract(table).collect()), key=lambda r: r[0])
    assert len(got) == len(rows) and all(len(r[2]) == r[3] for r in got)
    text = {r[0]: r[2] for r in got}
    assert text[1] == "Head & more\n\nOne two three four\n\nFive six" and text[2] == "Kept\n\nA < B é\n\nx\n\ny"
    assert text[3] == text[4] == "" and text[5] == "deep" and text[6] == "plain text < 3"
    assert text[12] == "Story 12\n\nmore of 12"  # what all pages of the host share is template
    assert pages.extract(table.where("false")).collect() == []


def test_tree_matching_against_all_matches():
    draw = random.Random(2)

    def tree(depth):
        return [draw.choice("ab"), 0, [tree(depth - 1) for _ in range(draw.randrange(4))] if depth else []]

    def best(a, b):
        if a[0] != b[0]:
            return 0
        table = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
        for i, x in enumerate(a[2]):
            for j, y in enumerate(b[2]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best(x, y))
        return 1 + table[-1][-1]

    for _ in range(200):
        a, b, out = tree(3), tree(3), {}
        a[0] = b[0] = "r"
        found = pages.match(pages.numbered(a)[0], pages.numbered(b)[0], out)
        assert found == best(a, b) == len(out)
        assert pages.unpacked(pages.packed(a)) == a


def test_wrapper_decides_on_pages_with_articles(spark):
    share = "<p>Read us every day</p>"
    rows = [(k, f"http://a.org/{k}", f"<body><article><p>Story {k}</p>{share}</article></body>") for k in range(8)]
    rows += [(20 + k, f"http://t.org/{k}", f"<body><div><p>Long story {k}</p></div><article>Teaser {k}</article></body>") for k in range(4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in pages.extract(table).collect()}
    assert all(text[k] == f"Story {k}" for k in range(8))  # a constant of the host inside its articles
    assert all(text[20 + k] == f"Long story {k}\n\nTeaser {k}" for k in range(4))  # an article element that is only a teaser
    again = spark.createDataFrame([(k, "http://c.org/", "<article><p>One</p><p>Two</p></article>") for k in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in pages.extract(again).collect()} == {"One\n\nTwo"}  # copies of one page share nothing


def test_constant_text_is_compared(spark):
    body = "<body><div><p>Head {0}</p><p>{1}</p></div></body>"
    rows = [(k, f"http://a.org/{k}", body.format(k, "Copied" if k < 6 else f"Own {k}")) for k in range(10)]
    # a second layout, of which the wrapper's first page knows nothing
    rows += [(20 + k, f"http://b.org/{k}", f"<body><main><p>Story {k}</p></main><div>Rights</div></body>") for k in range(6)]
    rows += [(30 + k, f"http://b.org/x/{k}", f"<body><table><tr><td>Row {k}</td></tr></table><section><p>All constant</p></section></body>") for k in range(6)]
    text = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == f"Head {k}\n\nOwn {k}" for k in range(6, 10))
    assert all(text[20 + k] == f"Story {k}" and text[30 + k] == f"Row {k}" for k in range(6))


def test_long_lists_match_in_linear_space(monkeypatch):
    draw = random.Random(8)
    a, b = (["r", 0, [[draw.choice("abc"), 0, [["x", 0, []]] * draw.randrange(3)] for _ in range(70)]] for _ in range(2))
    sizes = []
    for table in (10**6, 50):
        monkeypatch.setattr(pages, "TABLE", table)
        out = {}
        sizes.append(pages.match(pages.numbered(a)[0], pages.numbered(b)[0], out))
        assert sizes[-1] == len(out) == len(set(out.values()))
    assert sizes[0] == sizes[1]


# ---- the package as a whole

@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    rel = sql_connection(FOLDER).sql(registry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = []
    for name, function in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(function(spark, docs, FOLDER), name)
        counts.append((name, docs.count(), after.count()))
        if name != "pieces":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        docs = after
    assert counts[0][2] < counts[0][1] and counts[1][2] < counts[1][1] and counts[3][2] == counts[3][1] == counts[4][2]
    assert docs.where("not same").count() == 0
    assert {"pipeline", *registry.queries()} <= set(entry_points.queries())


def test_near_duplicate_stage_at_eighty(spark):
    draw, rows = random.Random(12), []
    for group in range(8):
        base = made_words(110, 700 + group)
        rows.append(" ".join(base))
        for apart in (0, 4, 20, 40):  # two changed words touch 5 to 10 of the shingles
            copy = list(base)
            copy[30] = copy[30 + apart] = "changed" + str(draw.randrange(10**6))
            rows.append(" ".join(copy))
    rows = list(enumerate(rows, 1))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [i for i, _, _, kept in _components(rows, 80) if kept]
    assert want != [i for i, _, _, kept in _components(rows, 85) if kept]
    assert sorted(r["doc_id"] for r in corpus_pipeline.deduplicated(spark, docs, "").collect()) == want


def test_pipeline_of_odd_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "a benchmark item of some eight words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shaped = odd_docs.selectExpr("doc_id", "text", "'en' as lang", "source", "0L as n_chars", "kept", "shard")
    for docs, left in ((no_docs, 0), (shaped, 1)):
        for name, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, str(tmp_path)), name)
        assert docs.count() == left


def test_class_names_decide_as_a_whole_and_not_on_the_article_itself(spark):
    def page(k):
        return (f'<html><body class="single has-sidebar"><div class="site-header">Site {k}</div><article class="share">'
                f'<div class="article-header">Lead {k}</div><h2 id="social-impact" class="social">Impact {k}</h2><p class="share-price">Price {k}</p>'
                f'<div class="header">Kicker {k}</div><div class="cookie-notice">Notice {k}</div><div class="social-share-buttons">Share {k}</div>'
                f'<p>Body {k}</p></article><div class="sidebar">Side {k}</div></body></html>')

    rows = [(k, "http://h.example/x", page(k)) for k in range(4)] + [(9, "http://one.example/", '<body class="sidebar"><p>Whole page</p></body>')]
    text = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[k] == f"Lead {k}\n\nImpact {k}\n\nPrice {k}\n\nKicker {k}\n\nBody {k}" for k in range(4))
    assert text[9] == "Whole page"


def test_deep_pages(spark):
    deep = lambda k, n: "<div>" * n + f"<p>Deep {k}</p><i>{k}</i>" + f"<b>x</b><p>{'y' * k}</p>" * (k % 3) + "</div>" * n
    rows = [(k, "http://deep.example/", deep(k, n)) for k, n in enumerate((380, 395, 400, 420, 2000, 399))]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(f"Deep {r['page_id']}" in r["text"] for r in got) and len(got) == 6


def test_odd_columns_and_long_pages_of_text(spark):
    """Columns whose names clash with the operator's own, and a page of megabytes."""
    story = " ".join(f"word{i}" for i in range(200_000))
    rows = [(1, "http://a.example/", f"<p>{story}</p>", "h", "s", 3), (1, "http://a.example/", f"<p>{story}</p>", "h", "s", 3), (None, None, "<p>none</p>", None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, skeleton string, n_chars long")
    assert sorted((str(r["page_id"]), r["n_chars"], r["text"] == story) for r in pages.extract(table).collect()) == [
        ("1", len(story), True), ("1", len(story), True), ("None", 4, False)]
