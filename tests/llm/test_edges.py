"""Each operator against its plain definition, on empty, repeated, null, very long and oddly named inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, embedding_dedup, graph, jaccard_join, line_dedup, quality, sharding, toxicity, url_filter
from tessera.llm.common import free

DOC = "doc_id long, text string"
CLASHES = ("doc__", "rid__", "id__", "mark__", "row__", "lane__", "rank__", "n__", "key", "row", "t__", "salt__", "score__", "gone__")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).coalesce(2)


def with_clashes(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


def kept_clashes(rows):
    return all(r[c] == i for r in rows for i, c in enumerate(CLASHES))


def test_free_names():
    assert free(["A__", "b"], "a__", "b", "c") == ["a___", "b_", "c"]


# ---------------------------------------------------------------- op 1, graph


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, []), (5, [float("inf"), 0.0]), (6, [1.0, 0.02]), (7, [-0.0, -1.0]), (8, [0.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame.withColumn("cls", F.lit(1))).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 3, 1, False), (7, 1, 7, True), (8, 1, 7, False)], key=repr)


def test_embeddings_recall_at_the_threshold(spark):
    """Pairs just at the threshold, the hardest ones, among many strangers."""
    rng = np.random.default_rng(1)
    n, dim = 4000, 64
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(400, dim))
    side -= (side * base[:400]).sum(1)[:, None] * base[:400]
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.9501 * base[:400] + np.sqrt(1 - 0.9501**2) * side
    x = np.concatenate([base, near])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame).collect()}
    found = sum(got[n + i] > 0 for i in range(400))
    assert found >= 0.99 * 400 and sum(got.values()) == 2 * found


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(300)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 1000 for k in [1000, *range(2000, 2300)]}}


# ----------------------------------------------------------------------- op 2


def scalar_jump(key: int, n: int) -> int:
    state, shard, ahead = key % (1 << 64), -1, 0
    while ahead < n:
        shard = ahead
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((shard + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return shard


def test_shards_against_the_scalar_hash(spark):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *random.Random(2).choices(range(-(10**12), 10**12), k=500)]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(np.array(keys), n).tolist() == [scalar_jump(k, n) for k in keys]
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_rows(docs(spark, [(k, "x") for k in keys]), 16).collect()}
    assert got == {k: (scalar_jump(k, 16), scalar_jump(k, 17)) for k in keys}
    assert sharding.shard_rows(docs(spark, []), 16).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_hash(np.array([1]), 0)


# ----------------------------------------------------------------------- op 4


def plain_tiles(item, doc, least):
    """Greedy string tiling by its definition: the longest common run of unmarked tokens, again and again."""
    used_i, used_d, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        run = [0] * (len(doc) + 1)
        for i in range(len(item) - 1, -1, -1):
            row = [0] * (len(doc) + 1)
            for j in range(len(doc) - 1, -1, -1):
                if item[i] == doc[j] and not used_i[i] and not used_d[j]:
                    row[j] = run[j + 1] + 1
                    best = max(best, (row[j], -i, -j))
            run = row
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        for k in range(n):
            used_i[i + k] = used_d[j + k] = True
        covered += n


def test_decontamination_against_plain_tiling(spark):
    rng = random.Random(8)
    items = {k: [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 8, 20, 40]))] for k in range(12)}
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            item = items[rng.randrange(12)]
            a = rng.randrange(len(item))
            part = item[a : a + rng.randrange(1, len(item) + 1)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
            if rng.random() < 0.5:  # the other part first: a reordered passage
                words[0:0] = item[:a]
        rows.append((k, " ".join(words)))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    want = {}
    for k, text in rows:
        for i, item in items.items():
            covered = plain_tiles(item, text.split(), min(5, len(item)))
            if covered >= 0.5 * len(item):
                want[k, i] = covered
    assert len(want) > 10
    for limit in (10**6, 0):
        got = {(r["doc_id"], r["item_id"]): r["covered"] for r in decontamination.contaminated_pairs(docs(spark, rows), bench, max_seeds=limit).collect()}
        assert set(got) == set(want)
        assert all(abs(got[p] - want[p]) <= 5 for p in want)  # tiles of one length may be marked in another order
        left = decontamination.decontaminate(with_clashes(docs(spark, rows)), bench, max_seeds=limit)
        assert left.columns == ["doc_id", "text", *CLASHES]
        out = left.collect()
        assert {r["doc_id"] for r in out} == {k for k, _ in rows} - {k for k, _ in want} and kept_clashes(out)


def test_decontamination_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, " . ")], "item_id long, text string")
    rows = [(None, "one two three four five six"), (3, None), (3, ""), (3, "One, two; three four-five six")]
    for limit in (10**6, 0):
        assert decontamination.contaminated_pairs(docs(spark, rows), none, max_seeds=limit).count() == 0
        assert decontamination.decontaminate(docs(spark, rows), none, max_seeds=limit).count() == 4
        assert decontamination.decontaminate(docs(spark, []), some, max_seeds=limit).count() == 0
        assert sorted(r["text"] or "" for r in decontamination.decontaminate(docs(spark, rows), some, max_seeds=limit).collect()) == ["", ""]


# ----------------------------------------------------------------------- op 5


def test_url_rules_odd_tables(spark):
    frame = spark.createDataFrame([(1, "http://a.b.com/x/y"), (1, "http://a.b.com/x/y"), (2, None), (None, "http://b.com")], "page_id long, url string")
    rules = spark.createDataFrame([("b.com", "/x/", "block"), ("b.com", "/x/", "block"), ("a.b.com", "/x", "allow"), ("", "/", "block"), ("B.COM", "/x/y", "allow"), ("a.b.com", "/q", "block")], "host string, path string, verdict string")
    got = sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in url_filter.filter_urls(with_clashes(frame), rules).collect())
    assert got == sorted([(1, "a.b.com/x", "allow"), (1, "a.b.com/x", "allow"), (2, None, "allow"), (0, None, "allow")], key=lambda r: r[0])
    assert kept_clashes(url_filter.filter_urls(with_clashes(frame), rules).collect())
    assert url_filter.filter_urls(frame.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(frame, rules.limit(0), otherwise="block").collect()} == {"block"}


def test_url_rules_of_many_groups_like_one(spark, monkeypatch):
    rng = random.Random(3)
    hosts = [".".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    rules = [(h, rng.choice(["/", "/a", "/a/b"]), rng.choice(["allow", "block"])) for h in set(hosts)]
    urls = [(i, f"http://{'.'.join(rng.choice('ab') for _ in range(rng.randrange(1, 6)))}{rng.choice(['', '/', '/a', '/a/b/c'])}") for i in range(400)]

    def plain(url):
        host, _, path = url[7:].partition("/")
        path = "/" + path if "/" in url[7:] else ""
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return min(fits, key=lambda f: (-f[0], f[1]))[1:] if fits else (None, "allow")

    frame, table = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    for size in (10_000, 3):
        monkeypatch.setattr(url_filter, "RULES_A_GROUP", size)
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(frame, table).collect()}
        assert got == {i: plain(u) for i, u in urls}


# ------------------------------------------------------------------- op 6, 8


def test_keep_one_keeps_columns_and_other_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    got = jaccard_join.keep_one(with_clashes(docs(spark, [(3, a), (5, a), (5, b), (9, " \n"), (9, " \n"), (9, None)]))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if (r["text"] or "").strip()) == [(3, a), (5, b)] and len(got) == 5 and kept_clashes(got)
    assert jaccard_join.keep_one(docs(spark, [])).count() == 0


def test_sums_of_long_sets_are_exact():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, (1 << 21) + 5, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    cell = np.arange(len(h)) % 2
    want = [int(sum(map(int, h[k::2].tolist()))) % (1 << 64) for k in (0, 1)]
    assert jaccard_join._sum64(cell, h, 2).tolist() == want
    half = len(h) // 2
    assert jaccard_join._sum64(cell[:half], h[:half], 2).tolist() == [int(sum(map(int, h[:half][k::2].tolist()))) % (1 << 64) for k in (0, 1)]


@pytest.mark.parametrize("sent", [line_dedup.SENT, 0])
def test_line_dedup_odd_rows(spark, sent):
    line = "a line that is long enough to count as one of them"
    rows = [(None, line), (None, line + "\nx"), (1, line), (1, line), (2, f" {line.upper()}\t"), (3, line), (4, "\n\n" + line), (5, None), (6, "")]
    assert line_dedup.dedup_lines(docs(spark, []), sent=sent).count() == 0
    got = line_dedup.dedup_lines(with_clashes(docs(spark, rows)).withColumn("n_lines", F.lit("old")), sent=sent).collect()
    assert kept_clashes(got)
    for r in got:
        assert line_dedup.apply_bitmap(dict(zip(rows, rows, strict=True)).get((r["doc_id"], r["text"]), (0, r["text"]))[1], None) == (r["text"] or "")
    texts = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in got)
    assert texts == [(0, "", 1, 1), (0, "x", 2, 1), (1, "", 1, 1), (1, "", 1, 1), (2, "", 1, 1), (3, "", 1, 1), (4, "\n\n" + line, 3, 0), (5, "", 1, 0), (6, "", 1, 0)]


# ------------------------------------------------------------------ op 7, 10


def models_of(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table = docs(spark, [(i, f"some plain text number {i}") for i in range(40)] + [(3, "again")])
    return quality.learn(table, marks), toxicity.learn(table, marks)


@pytest.mark.parametrize("labels", [[], [(1, None, None), (None, 1, 1)], [(i, 1, 0) for i in range(40)], [(i, 0, 1) for i in range(40)], [(1, 0, 0), (1, 1, 1), (2, 0, 0)]])
def test_models_of_odd_labels(spark, labels):
    good, bad = models_of(spark, labels)
    rows = docs(spark, [(1, "some plain text"), (1, "some plain text"), (None, None), (2, ""), (4, "x " * 200_000)])
    scored = quality.score_quality(with_clashes(rows), good, column="score").collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored) and kept_clashes(scored)
    graded = toxicity.grade(with_clashes(rows), bad).collect()
    assert len(graded) == 5 and all(0 <= r["severity"] <= toxicity.GRADES - 1 for r in graded) and kept_clashes(graded)
    assert quality.score_quality(rows.limit(0), good).count() == 0 and toxicity.grade(rows.limit(0), bad).count() == 0


def test_of_several_labels_the_largest_counts(spark):
    once, twice = models_of(spark, [(i, i % 2, i % 2) for i in range(40)]), models_of(spark, [(i, q, q) for i in range(40) for q in range(i % 2 + 1)])
    assert all(np.array_equal(once[0][k], twice[0][k]) for k in once[0]) and np.array_equal(once[1]["cuts"], twice[1]["cuts"])


def test_crc_of_packed_ids_is_unsigned():
    assert zlib.crc32(b"\x01\x00\x00\x00") >= 0
