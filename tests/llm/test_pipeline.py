"""The whole pipeline on the smallest tables against plain loops over its documents."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality, queries

SMALL = "/root/testdata/sf0.001"


def plain_tiles(item, doc, least):
    """Tokens of greedy string tiles by their definition."""
    used_i, used_d, covered = [False] * len(item), [False] * len(doc), 0
    where = {}
    for j, t in enumerate(doc):
        where.setdefault(t, []).append(j)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in where.get(item[i], ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_i[i + n] and not used_d[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        for k in range(n):
            used_i[i + k] = used_d[j + k] = True
        covered += n


BLANK = " \t\n\r\x0b\x0c"


def plain_lines(texts):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(BLANK))
    holders = {}
    for k, t in texts.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(k)
    gone = {s: max(h) for s, h in holders.items() if len(h) >= 5}
    return {k: "\n".join(s for s in t.split("\n") if gone.get(key(s), k) == k) for k, t in texts.items()}


def plain_groups(texts):
    sets = {}
    for k, t in texts.items():
        words = [w for w in re.split(f"[{BLANK}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    low = {k: k for k in texts}

    def root(k):
        return k if low[k] == k else root(low[k])

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((root(a), root(b)))
            low[q] = p
    return {k: t for k, t in texts.items() if root(k) == k}


def plain_leaks(texts, items):
    split = lambda t: [w for w in re.split(r"[\x00\x20\x09-\x0d!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    goods = [(s, min(5, len(s))) for s in map(split, items) if s]
    out = {}
    for k, t in texts.items():
        tokens = split(t)
        seeds = {n: {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} for n in {n for _, n in goods}}
        near = [(s, n) for s, n in goods if any(tuple(s[i : i + n]) in seeds[n] for i in range(len(s) - n + 1))]
        if not any(plain_tiles(s, tokens, n) >= 0.5 * len(s) for s, n in near):
            out[k] = t
    return out


@pytest.fixture(scope="module")
def packed(spark):
    counts, stages = {}, corpus_pipeline.STAGES
    sums = {name: spark.sparkContext.accumulator(0) for name, _ in stages}

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            out, total = stage(spark, docs, sf_dir), sums[name]

            def pass_on(batches):
                for batch in batches:
                    total.add(batch.num_rows)
                    yield batch

            return out.mapInArrow(pass_on, out.schema)

        return run

    try:
        corpus_pipeline.STAGES = [(name, counted(name, stage)) for name, stage in stages]
        rows = corpus_pipeline.run(spark, SMALL).collect()
    finally:
        corpus_pipeline.STAGES = stages
    counts |= {name: s.value for name, s in sums.items()}
    return rows, counts


def test_run_against_plain_loops(spark, packed):
    from tokenizers import Tokenizer

    rows, counts = packed
    docs = queries.table(spark, SMALL, "documents")
    model = quality.learn(docs, queries.table(spark, SMALL, "labels"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(texts) == docs.count()  # ids are unique here
    good = {k: t for k, t in texts.items() if quality.predict(model, [t])[0] >= quality.THRESHOLD}
    lined = plain_lines(good)
    single = plain_groups(lined)
    clean = plain_leaks(single, [r["text"] for r in queries.table(spark, SMALL, "benchmark").collect()])
    assert len(texts) > len(good) and lined != good and len(lined) > len(single) > len(clean) > 0
    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    want = []
    for k, t in clean.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(k, i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in spans.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 4096
    tokens = sum(w[3] for w in want)
    assert len(spans) <= -(-tokens // 4096) + 1
    # every stage is computed once
    assert counts == {"quality_classifier": len(good), "line_dedup": len(lined), "ngram_jaccard_join": len(single), "benchmark_decontamination": len(clean), "best_fit_packing": len(want)}


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls, repeated rows and columns with names that the stages use themselves."""
    odd = ("score__", "id__", "rid__", "doc__", "mark__", "n_lines", "n_dropped", "keep_bitmap", "row__")
    docs = queries.table(spark, SMALL, "documents")
    some = docs.where("doc_id % 4 = 0").unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 8").withColumn("text", F.lit(None).cast("string")))
    for frame in (some, docs.limit(0)):
        named = frame.select("*", *(F.lit(i).alias(c) for i, c in enumerate(odd)))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            named = stage(spark, named, SMALL)
            assert named.columns == [*docs.columns, *odd]
            assert all(r[c] == i for r in named.collect() for i, c in enumerate(odd))
        assert corpus_pipeline.pack(spark, named, SMALL).count() >= named.count() > -1
