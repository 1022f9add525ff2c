import math
import random
import re
from collections import Counter

import corpus_pipeline as c
from basketlens.llm import pieces, quality, secrets
from pyspark.sql import functions as F
from test_operators import WORD, brute_components, brute_kneser_ney, brute_spans, brute_viterbi


def test_stages_keep_columns(spark, docs, labels, tmpdir_path):
    docs = docs.drop("node")
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    labels.write.parquet(f"{tmpdir_path}/labels.parquet")
    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    now = spark.read.parquet(f"{tmpdir_path}/documents.parquet")
    for i, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, now, tmpdir_path)
        out.write.parquet(f"{tmpdir_path}/{name}")
        now = spark.read.parquet(f"{tmpdir_path}/{name}")
        if i < 4:
            assert now.columns == docs.columns
    again = c.run(spark, tmpdir_path)
    key = lambda r: (str(r.doc_id), r.n_tokens)
    assert sorted(map(key, now.collect())) == sorted(map(key, again.collect()))
    assert 2 not in {r.doc_id for r in now.collect()}


CLASHING = ("_own", "_hash", "_key", "_id", "text_hash", "_places", "_text", "_size", "_doc_id", "_copies", "_words", "_copy", "row", "id", "own", "hash", "key", "places",
            "copies", "origin", "words", "size", "component_id", "added", "bad_id", "rejected", "label", "chosen")


def test_clashing_columns_keep_their_values(spark, docs, labels, tmpdir_path):
    extra = [F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in CLASHING]
    given = docs.select("*", *extra, F.create_map(F.lit("k"), "doc_id").alias("tags"), F.array(F.create_map(F.lit("k"), "lang")).alias("many.tags"))
    given.write.parquet(f"{tmpdir_path}/documents.parquet")
    labels.write.parquet(f"{tmpdir_path}/labels.parquet")
    now = spark.read.parquet(f"{tmpdir_path}/documents.parquet")
    for name, stage in c.STAGES[:4]:
        stage(spark, now, tmpdir_path).write.parquet(f"{tmpdir_path}/{name}")
        now = spark.read.parquet(f"{tmpdir_path}/{name}")
        rows = now.collect()
        assert now.columns == given.columns and rows
        for r in rows:
            assert all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for n in CLASHING)
            assert r.tags == {"k": r.doc_id} and r["many.tags"] == [{"k": r.lang}]


def test_empty_tables(spark, docs, labels, tmpdir_path):
    docs.limit(0).write.parquet(f"{tmpdir_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmpdir_path}/labels.parquet")
    assert c.run(spark, tmpdir_path).count() == 0


def brute_shares(rows):
    """Copies of each document of a source: targets by weight, filled up to twice."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        over = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) >= 2 * sizes[s]}
        if not over:
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        open_ -= over
        left -= sum(target[s] for s in over)
    target.update({s: left * weight[s] / sum(weight[o] for o in open_) for s in open_})
    return target, {s: target[s] / sizes[s] for s in sizes}


def test_run_matches_brute_force(spark, tmpdir_path):
    rng = random.Random(4)
    vocabulary = "the of and a in to is was river stone house market winter garden letter music paper road bridge school village morning doctor field story water engine".split()
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, sentence(rng.randint(12, 40)), f"s{i % 4}") for i in range(36)]
    rows += [(100 + i, rows[i][1], "s9") for i in range(3)]  # copies
    rows += [(110 + i, rows[i][1] + " end", "s0") for i in range(3, 6)]  # near copies
    rows += [(120, sentence(14) + " password = hunter2secret " + sentence(9), "s1"), (121, "key Zq8xT2mLp9Rk4Vw7Yb3Nc6 for " + sentence(12), "s2")]
    rows += [(130 + i, "".join(chr(rng.randint(33, 126)) for _ in range(90)), "s3") for i in range(3)] + [(140, "", "s1")]
    marked = [*range(36), 120, 121]
    spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in marked], "doc_id long, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    # Quality: perplexity under the definition, the quantile of trusted texts.
    trusted = {k for k, r in enumerate(rows) if r[0] in marked}
    nll = brute_kneser_ney([t for _, t, _ in rows], trusted)
    mean = sum(nll[i] for i in trusted) / sum(len(rows[i][1]) for i in trusted)
    score = [math.exp((x + quality.PRIOR * mean) / (len(r[1]) + quality.PRIOR)) for x, r in zip(nll, rows)]
    limit = sorted(score[i] for i in trusted)[math.ceil(quality.QUANTILE * len(trusted)) - 1] * quality.MARGIN
    kept = [r for r, p in zip(rows, score) if r[1] and p <= limit]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {130, 131, 132, 140} and len(kept) >= 40
    # Near duplicates: the smallest id of each component.
    first = {c for _, _, c in brute_components([r[:2] for r in kept])}
    kept = [r for r in kept if str(r[0]) in first]
    assert not {r[0] for r in kept} & {100, 101, 102, 113, 114, 115}
    # Secrets: base spans, and the one random-looking value of a single owner.
    kept = [(i, secrets.mask(t, [s[1:] for s in brute_spans(t)] + [m.span() for m in re.finditer("Zq8xT2mLp9Rk4Vw7Yb3Nc6", t)]), s) for i, t, s in kept]
    assert sum(secrets.MASK in t for _, t, _ in kept) == 2
    # Mix: each document its share of copies, rounded; each source near its target.
    target, share = brute_shares(kept)
    out = c.run(spark, tmpdir_path).collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) <= {i for i, _, _ in kept}
    taken = Counter()
    for i, t, s in kept:
        assert copies[i] in (math.floor(share[s]), math.ceil(share[s]))
        taken[s] += copies[i] * len(WORD.findall(t))
    longest = max(len(WORD.findall(t)) for _, t, _ in kept)
    assert all(abs(taken[s] - target[s]) <= longest for s in target)
    # Tokens: the best segmentation, character by character.
    table = pieces.Pieces()
    want = {i: brute_viterbi(table, t) for i, t, _ in kept}
    assert all(list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids) for r in out)
