"""The training-data operators against brute force, on small and odd inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, embedding_dedup, html_text, jaccard_join, line_dedup, packing, quality, queries, sharding, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b"), (5, "A b"), (None, "a b"), (6, "x " * 30000), (7, "x " * 30000), (7, "x " * 30000)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).coalesce(2)


def brute_components(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(j)] = find(i)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_finds_every_link(spark, seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for size in (1, 3, 5, 6, 8, 12, 20, 40, 90, 200):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for _ in range(6):
                words = list(base)
                for _ in range(rng.randrange(0, max(2, size // 18))):
                    words[rng.randrange(len(words))] = f"n{rng.randrange(5000)}"
                rows.append((k, " ".join(words)))
                k += 1
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(spark, rows)).collect())
    assert got == brute_components(rows)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs(spark, rows)).collect()}
    assert kept == {c for _, _, c in got}


def test_jaccard_odd_rows(spark):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs(spark, ODD)).collect()), key=repr)
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got
    assert (5, 1, None) in got and (None, 1, None) in got  # the null id is the smallest
    assert got.count((7, 1, 6)) == 2 and len(got) == len(ODD)
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    words = [[f"{c}{i}" for i in range(60)] for c in "abcdefg"]
    a, b, c, d, e, f, g = (" ".join(x) for x in words)
    near = lambda i: " ".join([*words[i], "tail"])
    groups = [
        [(3, a), (4, a), (None, a), (None, near(0)), (5, near(0))],  # 3 stays
        [(5, b)],  # its id's other text goes, this doesn't
        [(None, c)] * 20,  # one of the copies stays
        [(6, e), (6, near(4)), (6, e), (6, e.upper())],  # one of an id's copies stays
        [(8, f), (8, f)],
        [(9, g)],
    ]
    empty = [(10, "\n\t"), (10, "\n\t"), (None, None), (None, None), (11, "")]
    lone = [(None, d)]
    nulls = [groups[0][:4], groups[2], groups[5]]
    for chosen in (groups, nulls):  # with repeated ids; with null ids alone
        rows = [r for x in [*chosen, lone] for r in x] + (empty if chosen is groups else empty[2:])
        got = [tuple(r) for r in jaccard_join.keep_one(docs(spark, rows)).collect()]
        assert sorted(map(repr, (r for r in got if not (r[1] or "").strip()))) == sorted(map(repr, (r for r in rows if not (r[1] or "").strip())))
        for group in [*chosen, lone]:
            kept = [r for r in got if r in group]
            low = min((r[0] for r in group if r[0] is not None), default=None)
            assert len(kept) == 1 and kept[0][0] == low


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.1, base[:10], np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.05])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=8).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(link, low[None, :], 10**6).min(1))
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharding(spark):
    assert sharding.jump_hash(np.arange(1000), 1).max() == 0
    for n in (1, 7, 16):
        a, b = sharding.jump_hash(np.arange(20000), n), sharding.jump_hash(np.arange(20000), n + 1)
        assert set(b[a != b]) <= {n} and abs((a != b).mean() - 1 / (n + 1)) < 0.02
    rows = [tuple(r) for r in sharding.shard_rows(docs(spark, ODD), 16).collect()]
    assert len(rows) == len(ODD)
    for s in {r[4] for r in rows}:
        assert sorted(r[5] for r in rows if r[4] == s) == list(range(sum(r[4] == s for r in rows)))
    assert {(r[0], r[1], r[2]) for r in rows} == {(k, len(t or "") + 1, zlib.crc32((t or "").encode())) for k, t in ODD}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    rows = [*ODD, (8, "don't-stop **'s !!'S é* ≠ a…, 12a3 ½7 <|endoftext|> Straße İ"), (9, "日本,語。 I'LL'd")]
    got = packing.pack_documents(docs(spark, rows), path).collect()
    want = []
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(k, i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.clip(rng.lognormal(6, 1, 20000).astype(int), 1, 4096), return_counts=True), strict=True)}
    bins = packing.plan(counts)
    placed = {}
    for mix, n in bins:
        assert sum(k * c for k, c in mix.items()) <= 4096
        for k, c in mix.items():
            placed[k] = placed.get(k, 0) + c * n
    assert placed == counts
    assert sum(n for _, n in bins) <= 1.003 * sum(k * v for k, v in counts.items()) / 4096 + 1


@pytest.fixture(scope="module")
def histograms():
    """Lengths of the pieces of the tables' documents."""
    from tokenizers import Tokenizer

    import duckdb

    tokenizer, out = Tokenizer.from_file(queries.vocabulary_path()), {}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        texts = [r[0] or "" for r in duckdb.sql(f"select text from '/root/testdata/{sf}/documents.parquet'").fetchall()]
        lengths = [len(e.ids) + 1 for at in range(0, len(texts), 2000) for e in tokenizer.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        pieces = np.array([n for x in lengths for n in [4096] * (x // 4096) + [x % 4096] * (x % 4096 > 0)])
        out[sf] = {int(k): int(v) for k, v in zip(*np.unique(pieces, return_counts=True), strict=True)}
    return out


@pytest.mark.parametrize("sf, times", [("sf0.001", 1), ("sf0.01", 1), ("sf0.01", 1000), ("sf0.1", 1), ("sf0.1", 1000)])
def test_the_program_carries_the_packing(histograms, sf, times):
    counts = {k: n * times for k, n in histograms[sf].items()}
    lengths = np.array(sorted(counts))
    total = np.array([counts[k] for k in sorted(counts)])
    used, left = packing.solve(lengths, total, 4096, packing.STEPS[0])
    whole = packing.best_fit(lengths[left > 0], left[left > 0], 4096, used)
    alone = packing.best_fit(lengths, total, 4096, [])
    size = lambda bins: sum(n for _, n in bins)
    assert size(used) > 0.8 * size(whole)
    assert size(packing.plan(counts)) <= size(whole) <= size(alone)
    # the weights take part: without them another packing comes out
    assert len({tuple(sorted(m.items())) for m, _ in used}) > 1


def test_packing_with_another_vocabulary_and_clashing_columns(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(path)
    texts = ["a  b,c\n\nd 12", "", "don't  stop", "é 12 日本"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rank__ string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(frame, path).collect()}
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}
    pieces = spark.createDataFrame([(5, "a", 1, 9), (5, "a", 1, 9), (4090, "b", 2, 9)], "length long, rank__ string, Row__ int, offset int")
    packed = packing.pack_pieces(pieces)
    assert packed.columns == ["length", "rank__", "Row__", "sequence_id", "offset"] and packed.count() == 3
    assert packing.pack_documents(frame.limit(0), path).count() == 0


@pytest.mark.parametrize("counts, most", [({1366: 50, 1365: 40, 1370: 30}, 50), ({2048: 21, 1400: 30, 1300: 30, 700: 20, 676: 18}, 38)])
def test_packing_plans_small_tables_too(counts, most):
    bins = packing.plan(counts)
    placed = {}
    for mix, n in bins:
        assert sum(k * c for k, c in mix.items()) <= 4096
        for k, c in mix.items():
            placed[k] = placed.get(k, 0) + c * n
    alone = packing.best_fit(np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)]), 4096, [])
    assert placed == counts
    assert sum(n for _, n in bins) <= most < sum(n for _, n in alone)


def test_decontamination(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[:20])
    rows = [(1, "x y " + item + " z"), (2, " ".join(words[10:20]) + " zz " + " ".join(words[:10])), (3, " ".join(words[:6])), (4, None), (5, " ".join(words[100:300])), (6, "Tiny, ITEM.")]
    bench = spark.createDataFrame([(7, item), (8, ""), (9, None), (10, "tiny item")], "item_id long, text string")
    want = {(1, 7, 20), (2, 7, 20), (6, 10, 2)}
    for limit in (10**6, 0):  # sent to the executors, and joined
        pairs = decontamination.contaminated_pairs(docs(spark, rows), bench, max_seeds=limit)
        assert {(r["doc_id"], r["item_id"], r["covered"]) for r in pairs.collect()} == want
        assert {r["doc_id"] for r in decontamination.decontaminate(docs(spark, rows), bench, max_seeds=limit).collect()} == {3, 4, 5}


def test_url_rules(spark):
    urls = ["http://Example.NET/en/1?q", "https://a.example.net/de/", "http://notexample.net.org/fr/x", "x", None, "ftp://u@example.com:80/de/", "http://example.com/de/#a", "http://net", "http://b.c.org/fr/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(frame, rules).collect()}
    assert got[0] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("a.example.net", "/de/", "net/", "block")
    assert got[2][2:] == ("org/fr/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("u@example.com:80", "/de/", None, "allow")
    assert got[6][2:] == ("example.com/de/", "block")
    assert got[7] == ("net", "", None, "allow") and got[8][2:] == ("org/fr/", "allow")


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [f"line number {i} " + "padding " * 5 for i in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "short", "", f"own line {i} " + "y" * 40]).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, pool[0] + "\n" + pool[0])]
    key = lambda s: s.strip(" \t\n\r\x0b\x0c").lower()
    holders = {}
    for k, t in rows:
        for s in (t or "").split("\n"):
            holders.setdefault(key(s), set()).add(k)
    gone = {s: max(h) for s, h in holders.items() if len(s) >= 40 and len(h) >= 5}
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    for k, t in rows:
        kept = [s for s in (t or "").split("\n") if gone.get(key(s), k) == k]
        assert got[k]["text"] == "\n".join(kept)
        assert line_dedup.apply_bitmap(t, got[k]["keep_bitmap"]) == "\n".join(kept)
        assert got[k]["n_dropped"] == len((t or "").split("\n")) - len(kept)


def test_line_dedup_over_small_batches(spark):
    """Rows that wait for a hash's count are forgotten with it, though the batch's last hash has none that wait."""
    rng = random.Random(9)
    rows = {k: [] for k in range(40)}
    for i in range(300):
        for k in rng.sample(range(40), rng.choice([2, 3, 4, 5, 6, 9, 14])):
            rows[k].append(f"line number {i} " + "padding " * 5)
    holders = {}
    for k, lines in rows.items():
        for s in lines:
            holders.setdefault(s, set()).add(k)
    gone = {s: max(h) for s, h in holders.items() if len(h) >= 5}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, [(k, "\n".join(x)) for k, x in rows.items()])).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {k: "\n".join(s for s in lines if gone.get(s, k) == k) for k, lines in rows.items()}


def test_html():
    weight = html_text.weights(*html_text.count("<nav><a>x</a></nav><article><h1>T</h1><p>one two</p></article><footer>f</footer>"))
    page = '<title>t</title><div class="menu"><a>m</a></div><article><h1>A &amp; B</h1><p>one\n <b>t</b>wo<br>three<script>var x="</p>"</script></p><div class="ad">buy</div><p>four</p></article><section class="comments"><p>nice read</p></section><footer>foot</footer>'
    assert html_text.main_text(page, weight) == "A & B one two three four"
    assert html_text.main_text(None, weight) == html_text.main_text("", weight) == ""


def html_weight():
    return html_text.weights(*html_text.count("<nav><a>x</a></nav><div class='ad'>buy this</div><article><h1>T</h1><p>one two</p></article><footer>f</footer>"))


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "comments-open", "share-enabled", "hasSidebar", "sidebar", "related"])
def test_html_wrappers_of_the_content_are_not_asides(name):
    for tag in ("article", "main"):
        page = f'<nav><a>m</a></nav><div class="{name}"><{tag}><h1>A</h1><p>one two</p><div class="ad">buy</div><p>three</p></{tag}></div><footer>f</footer>'
        assert html_text.main_text(page, html_weight()) == "A one two three"
    if "-" in name:
        assert html_text.main_text(f'<nav><a>m</a></nav><div class="{name}"><h1>A</h1><p>one two</p></div>', html_weight()) == "A one two"


def test_html_asides_of_a_marked_page():
    own = '<article><section id="discussion"><p>one</p></section><p class="notice">two</p><h2 id="related">three</h2></article>'
    junk = '<div class="sidebar-left"><article>teaser</article></div><section class="comments"><article>x</article><article>y</article>z</section><div class="cookie-banner">cookies</div>'
    assert html_text.main_text(junk + own + junk, html_weight()) == "one two three"
    assert html_text.main_text(own.replace("</article>", '<div class="comments"><article>nice</article> read</div><p>four</p></article>'), html_weight()) == "one two three four"


def test_html_adverts_on_a_page_without_a_content_element():
    lead, rest = "<p>one two</p>", "<p>" + "more text " * 30 + "</p>"
    advert = '<div class="ad"><ul><li>' + "<a>buy this</a> " * 50 + "</li></ul></div><form>sign <b>up</b> here</form>"
    for text in (lead + advert + rest, rest + advert + lead, lead + advert * 3 + lead + advert + rest):
        page = f"<html><head><title>t</title></head><body><nav><a>m</a></nav><div>{text}</div><footer>foot</footer></body></html>"
        plain = page.replace(advert, "")
        assert html_text.main_text(page, html_weight()) == html_text.main_text(plain, html_weight()) == " ".join(text.replace(advert, "").replace("<p>", " ").replace("</p>", " ").split())


@pytest.fixture(scope="module")
def article_pages():
    import duckdb

    return [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet' order by page_id").fetchall()]


def article_text(page):
    import html
    import re

    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_html_scan_finds_articles_without_lists_or_marks(article_pages):
    """Weights learned from 600 pages alone, on other pages whose article tags are taken away."""
    inside, outside = html_text.Counter(), html_text.Counter()
    for page in article_pages[:600]:
        a, b = html_text.count(page, lists=False)
        inside += a
        outside += b
    weight = html_text.weights(inside, outside, prior={})
    held = article_pages[600:1200]
    bare = [p.replace("<article>", "").replace("</article>", "") for p in held]
    share = lambda w: np.mean([html_text.main_text(b, w, lists=False) == article_text(p) for p, b in zip(held, bare, strict=True)])
    assert share(weight) > 0.95
    values = list(weight["words"].values())
    for seed in range(3):
        random.Random(seed).shuffle(values)
        assert share({**weight, "words": dict(zip(weight["words"], values, strict=True))}) < 0.5


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a<svg/>b</p><p>c</p>", "ab c"),
        ("<p>a<svg><path d='M0'/><text>no</text></svg>b</p>", "ab"),
        ("<p title=it's>one</p><p class=\"x>y\">two</p>", "one two"),
        ("<p>lead</p><table><tr><td>one<td>two</tr><tr><td>three</table><p>end</p>", "lead one two three end"),
        ("<article><div class='side-by-side'>one</div><p class='skip-first'>two</p></article>", "one two"),
        ("<article><p>one<p class=ad>buy<p>two<ul><li class=ad>no<li>three</ul></article>", "one two three"),
        ("<article><p>1 &lt; 2 &amp;amp; <b>b</b>old</p><!-- x --><form><p>sign</p></form><style>p{}</style></article>", "1 < 2 &amp; bold"),
        ("<div class='comments'><p>first</p></div><h1>T</h1><p>one</p></i></p><header><h2>h</h2></header>", "T one"),
        ("<p>open <b>tags <i>stay", "open tags stay"),
        ("no tags at all", "no tags at all"),
        ("<", "<"),
        ("<script>only", ""),
    ],
)
def test_html_odd_pages(page, want):
    assert html_text.main_text(page, html_weight()) == want


def test_html_odd_tables(spark):
    long = "<article>" + "<p>word word</p>" * 40_000 + "</article>" + "<b>" * 20_000 + "</i>" * 20_000
    rows = [(1, "u", None, 5), (1, "u", "<p>a</p>", 6), (1, "u", "<p>a</p>", 6), (None, None, long, 7)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    for weight in (html_text.learn(frame), html_text.learn(frame.limit(0))):  # one labelled page; none
        got = sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in html_text.extract(frame, weight).collect())
        assert got == [(0, "word word", 400_000 - 1), (1, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_text.extract(frame.limit(0), weight).count() == 0
    named = frame.select("page_id", F.col("html").alias("text"))
    assert html_text.extract(named, weight, page="text").columns == ["page_id", "text", "n_chars"]


def test_models_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in queries.table(spark, sf, "labels").collect()}
    scored = {r["doc_id"]: r for r in queries.op10_quality(spark, sf).collect()}
    held = [k for k in labels if scored[k]["held_out"]]
    assert all(scored[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in labels)
    assert np.mean([scored[k]["predicted"] == labels[k]["quality"] for k in held]) > 0.95
    toxic = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf).collect()}
    assert not [k for k in held if toxic[k]["is_toxic"] and not labels[k]["toxic"]]


def test_ordinal_fit_orders_grades():
    texts = [f"plain words {i}" for i in range(60)] + [f"plain bad {i}" for i in range(60)] + [f"plain bad worse {i}" for i in range(60)]
    model = toxicity.train(texts, np.repeat([0, 1, 2], 60))
    assert list(np.diff(model["cuts"]) > 0) == [True]
    p = toxicity.predict(model, ["plain words", "plain bad", "plain bad worse", "", None])
    assert (p[:3] >= 0.5).sum(1).tolist() == [0, 1, 2]
    assert (p[3] == p[4]).all()


def test_quality_score_does_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    texts = ["Some plain text. " * 9, "", None, "X!! " * 200]
    x = np.concatenate([f for f, _ in quality.bag_features(texts)])
    n = np.concatenate([k for _, k in quality.bag_features(texts)])
    model = quality.fit(x, n, np.array([1.0, 0, 0, 0]), epochs=20, seed=int(rng.integers(9)))
    alone = np.concatenate([quality.predict(model, [t]) for t in texts])
    assert np.allclose(quality.predict(model, texts), alone, atol=1e-12)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    frame = queries.table(spark, SMALL, "documents")
    columns = frame.columns
    before = frame.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SMALL)
        assert frame.columns == columns
        assert frame.count() <= before
    ids = {r["doc_id"] for r in frame.select("doc_id").collect()}
    packed = corpus_pipeline.pack(spark, frame, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        path = f"{SMALL}/{table}.parquet"
        con.sql(f"create view {table} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = queries.queries()[name](spark, SMALL)
    want = con.sql(queries.oracle_sql()[name])
    rows = [tuple(r[want.columns.index(c)] for c in df.columns) for r in want.fetchall()]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, rows))


def test_toxicity_finds_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["is_toxic"] for r in queries.op7_toxicity(spark, sf).collect()}
    held = [r["doc_id"] for r in queries.table(spark, sf, "labels").collect() if r["toxic"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and np.mean([toxic[k] for k in held]) > 0.8
