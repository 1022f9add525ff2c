"""Exact dedup (11), cross-tokenizer alignment (12), fill-in-middle (13)."""
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketlens.llm import align, exact, infill
from basketlens.llm.common import read_table
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 -- exact duplicates
def brute_groups(rows):
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    out = Counter()
    for t, ids in same.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out[i, keep, len(ids), k == 0, sha(t)] += 1
    return out


def got_groups(df):
    return Counter(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_polynomials_compose():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 100_003, dtype=np.uint8)
    want = tuple(sum((int(x) + 1) * pow(z, i, p) for i, x in enumerate(data[:5000])) % p for z, p in zip(exact.POINTS, exact.PRIMES))
    assert exact.Polynomial()(data[:5000]) == want == exact.Polynomial(64)(data[:5000])
    whole = exact.Polynomial()(data)
    for cuts in ([0, 100_003], [0, 1, 2, 50_000, 100_003], sorted([0, 100_003, *rng.integers(0, 100_003, 20).tolist()])):
        parts = [(exact.Polynomial(1 << 10)(data[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]
        assert exact.combined(parts) == whole
    assert exact.Polynomial()(data[:0]) == (0, 0)
    assert exact.Polynomial()(np.zeros(1, np.uint8)) != exact.Polynomial()(np.zeros(2, np.uint8))


def test_groups_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_groups(exact.duplicate_groups(docs)) == brute_groups(rows)
    rng = random.Random(4)
    texts = ["x" * n for n in (1, 2, 63, 64, 65, 128, 1000)] + ["é" * 64, "", None, "ab\ncd", "ab\ncD", "long " * 400, "long " * 399 + "lonG "]
    rows = [(rng.choice([None, rng.randrange(40)]), rng.choice(texts)) for _ in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("sha", F.lit("z")).repartition(5)
    d.write.parquet(path := f"{spark.sparkContext.getCheckpointDir()}/dups-{rng.random()}")
    d = spark.read.parquet(path)
    for segment in (64, 1 << 16):  # many texts in segments, none
        assert got_groups(exact.duplicate_groups(d, segment=segment)) == brute_groups(rows)
    lower = exact.duplicate_groups(d, normalise=F.lower)
    assert got_groups(lower) == brute_groups([(i, t and t.lower()) for i, t in rows])
    assert exact.duplicate_groups(d.limit(0)).count() == 0


def test_hot_group_is_dealt_over_buckets(spark):
    d = (spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") < 4000, "same text").otherwise(F.concat(F.lit("t"), F.col("id") % 1500)).alias("text"))
         .repartition(3, "doc_id"))
    d.write.parquet(path := f"{spark.sparkContext.getCheckpointDir()}/hot-{random.random()}")
    d = spark.read.parquet(path)
    assert got_groups(exact.duplicate_groups(d)) == brute_groups([(r.doc_id, r.text) for r in d.collect()])


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    # With every fingerprint equal, only the comparison tells texts of one length apart.
    rows = [("aaa", 1), ("aab", 2), ("aaa", 3), ("b", 4), ("aab", 5), ("aac", 6)]
    batch = [{"uid": 0, "doc_id": i, "n_bytes": len(t), "print": 7, "sha": sha(t), "salt": 0, "salts": 1, "seg": 0, "segs": 1, "part": t.encode()} for t, i in sorted(rows, key=lambda r: len(r[0]))]
    import pyarrow as pa
    out = next(exact._compared(iter([pa.RecordBatch.from_pylist(batch)]))).to_pylist()
    by = defaultdict(set)
    for r in out:
        by[r["label"]].add(r["doc_id"])
    assert sorted(map(sorted, by.values())) == [[1, 3], [2, 5], [4], [6]]


# 12 -- alignment
@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    a = Tokenizer.from_file(align.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.PIECES)


def brute_alignment(coders, rows):
    a, b = coders
    of = align._byte_of_symbol()
    name = {i: t for t, i in json.load(open(align.BYTE_BPE, encoding="utf-8"))["model"]["vocab"].items()}
    docs, held = [], Counter()
    for doc_id, text in rows:
        ranges = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spelled = [[bytes(of[c] for c in name[i]) for i in ia], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]]
            if b"".join(spelled[0]) == b"".join(spelled[1]) == (" " + text).encode():
                for ids, parts in zip((ia, ib), spelled):
                    at, side = 0, []
                    for i, p in zip(ids, parts):
                        side.append((i, at, at + len(p)))
                        at += len(p)
                    ranges.append(side)
        ta, tb = ranges or ([], [])
        links = [(x[0], y[0]) for x in ta for y in tb if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in ta} & {y[2] for y in tb})
        cut = list(zip([0, *ends], ends))
        said = ";".join("|".join(",".join(str(x[0]) for x in side if lo < x[2] <= hi) for side in (ta, tb)) for lo, hi in cut)
        docs.append((doc_id, len(ta), len(tb), len(ends), links, sha(said) if said else ""))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return Counter((i, na, nb, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), s) for i, na, nb, g, links, s in docs)


TEXTS = ["a", " a  b ", "Hello, wörld!", "日本語 テキスト 😀😀 é", "x▁y", "<|endoftext|> <s> </s> <unk> <0x41>", "", None, "\n", "\0\t\r\n  ", "don't it's 12345 3.14", "the cat sat on the mat\nthe cat", "ﬁ ½ Å"]


def test_alignment_matches_brute_force(spark, coders, docs):
    rng = random.Random(2)
    words = ["the", "The", "café", "running", "antidisestablishment", "12", "x_y", "日本", "😀", "\n", "  ", "naïve", "don't"]
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (5, "the cat"), (5, "the cat")] + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("pair", F.lit("p")).repartition(3)
    want = brute_alignment(coders, rows)
    for chars in (1, 200, 1 << 20):  # one text a block, several, all
        assert Counter(map(tuple, align.alignment(d, block_chars=chars).collect())) == want
    assert align.alignment(d.limit(0)).count() == 0
    r = [(r.doc_id, r.text) for r in docs.filter("doc_id is null or doc_id <> 8").collect()]
    assert Counter(map(tuple, align.alignment(docs.filter("doc_id is null or doc_id <> 8")).collect())) == brute_alignment(coders, r)


def test_alignment_keeps_small_rows(spark, coders):
    # A block of over PART pairs is stored, written and read in rows of at most PART entries.
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(400))) for i in range(3)] + [(9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    stored = d.mapInArrow(align._aligned((align.BYTE_BPE, align.PIECES), 1 << 20), align._BLOCK)
    lists = [f.name for f in stored.schema if f.dataType.typeName() == "array"]
    longest = stored.agg(*[F.max(F.size(c)).alias(c) for c in lists], F.sum(F.size("times")).alias("all")).first()
    assert longest["all"] > 1024 and max(longest[c] for c in lists) <= 1024
    assert Counter(map(tuple, align.alignment(d).collect())) == brute_alignment(coders, rows)

def test_byte_level_is_the_tokenizers_own(coders):
    a = align.ByteLevel()
    texts = [t for t in TEXTS if t] + ["a" * 5000, "ab" * 3000 + " " * 700, "é" * 999]
    assert a.encode(texts) == [coders[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert a.encode([""]) == [[]]


def test_query_matches_brute_force_on_the_test_table(spark, coders):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    rows = [(i, t) for i, t in rows if len(t or "") < 1500]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, align.alignment(d, block_chars=5000).collect())) == brute_alignment(coders, rows)


def test_token_links(spark, coders):
    r = align.token_links(spark.createDataFrame([(1, "Hello wörld"), (2, None), (3, "antidisestablishment a")], "doc_id long, text string"), block_chars=1).collect()
    assert [len(x.a) for x in r][1] == 0 and r[1].links == []
    for x, t in ((r[0], "Hello wörld"), (r[2], "antidisestablishment a")):
        assert x.a == coders[0].encode(" " + t, add_special_tokens=False).ids and x.b == coders[1].encode(t)
        assert x.group_a[0] == x.group_b[0] == 0 and x.group_a[-1] == x.group_b[-1]
        assert {p.a for p in x.links} == set(range(len(x.a))) and {p.b for p in x.links} == set(range(len(x.b)))


# 13 -- fill in the middle
def brute_fim(doc_id, text, rate=100, spm_rate=50):
    import re
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, len(lines), "plain", None, None, text
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h[3] % 100 < spm_rate
    return doc_id, len(lines), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_line_tree_cuts_where_lines_end():
    rng = random.Random(3)
    for block in (1, 2, 3, 7, 64):
        for _ in range(60):
            text = "".join(rng.choice("a\n\nbé日😀\r") for _ in range(rng.randrange(0, 90)))
            data = np.frombuffer(text.encode(), np.uint8)
            tree = infill.LineTree(data, block)
            lines = __import__("re").findall(r"[^\n]*\n|[^\n]+", text)
            assert tree.lines == len(lines) and tree.chars == len(text)
            for k in range(len(lines) + 1):
                head = "".join(lines[:k])
                assert tree.cut(k) == (len(head.encode()), len(head))


def test_fill_in_middle(spark, docs):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["one line\n", "zwei ä\n", "\n", "😀", "日本\r\n", "<", "S>"]) for _ in range(rng.randrange(0, 30)))) for i in range(80)]
    rows += [(r.doc_id, r.text) for r in docs.collect()] + [(200, "a <P> b"), (201, "<M>"), (202, "<S"), (203, "\n" * 50_000 + "end"), (204, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit("x"))
    out = infill.fill_in_middle(d).withColumn("again", infill.restored("output", "form")).collect()
    assert Counter(tuple(r)[:-1] for r in out) == Counter(brute_fim(*r) for r in rows)
    assert Counter((r.doc_id, r.again) for r in out) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    some = infill.fill_in_middle(d, rate=30, spm_rate=100).collect()
    assert Counter(map(tuple, some)) == Counter(brute_fim(*r, rate=30, spm_rate=100) for r in rows)
    assert infill.fill_in_middle(d.limit(0)).count() == 0


# 7 -- toxicity: the fit and its counterfactual penalty
def _objective(rows, w, b, penalty):
    from basketlens.llm.toxicity import RIDGE
    y = np.array([r["toxic"] for r in rows], float)
    z = np.array([w[r["at"]].sum() for r in rows]) + b
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    change = np.array([w[f].sum() - w[s].sum() for r in rows for f, s in zip(r["first"], r["second"])])
    return (weight * (np.logaddexp(0, z) - y * z)).sum() + RIDGE / 2 * (w * w).sum() + penalty * (change ** 2).mean()


def test_fit_is_the_optimum_and_the_penalty_acts():
    from basketlens.llm import toxicity as tx
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):  # feature 0 tells the labels apart, 1 and 2 name groups; 1 is common in toxic rows
        toxic = int(rng.random() < 0.4)
        at = [0] * int(rng.random() < (0.9 if toxic else 0.1)) + [1] * int(rng.random() < (0.8 if toxic else 0.2)) + [3] * int(rng.random() < 0.5)
        rows.append({"toxic": toxic, "at": at, "first": [[1, *at]], "second": [[2, *at]]})
    plain, fair = tx.fit(rows, 4, 0.0), tx.fit(rows, 4, 100.0)
    for (w, b), penalty in ((plain, 0.0), (fair, 100.0)):
        best = _objective(rows, w, b, penalty)
        for _ in range(200):
            assert _objective(rows, w + rng.normal(size=4) * 0.02, b + rng.normal() * 0.02, penalty) >= best - 1e-12
    assert plain[0][1] - plain[0][2] > 0.5 and abs(fair[0][1] - fair[0][2]) < 0.05 and fair[0][0] > 1


def test_counterfactuals_swap_or_insert_terms_of_one_kind():
    from basketlens.llm.toxicity import _GROUP, IDENTITY, counterfactuals
    for a, b in counterfactuals({"the", "women", "sat"}, 3):
        assert a == {"the", "women", "sat"} and len(b - a) == 1 and (b - a) < set(IDENTITY[0]) and "women" not in b
    seen = set()
    for turn in range(200):
        for a, b in counterfactuals({"x"}, turn):
            (p,), (q,) = a - {"x"}, b - {"x"}
            assert _GROUP[p] is _GROUP[q] and p != q
            seen |= {p, q}
    assert seen == set(_GROUP)


def test_training_takes_one_text_of_a_repeated_id(spark):
    from basketlens.llm import toxicity as tx
    from basketlens.llm.common import Scratch
    d = spark.createDataFrame([(1, "a bad word")] + [(2, f"t{i} words") for i in range(300)] + [(None, "x"), (3, None), (4, "fine words")], "doc_id long, text string")
    l = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 0), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    rows, names = tx.training_rows(d, l, Scratch(spark, "t"))
    kept = [i for i in (1, 2, 3, 4) if __import__("zlib").crc32(str(i).encode()) % 5]
    assert len(rows) == len(kept) and sorted(r["toxic"] for r in rows) == sorted({1: 1, 2: 0, 3: 0, 4: 1}[i] for i in kept)


# 4 -- nearest neighbours: bounds hold at any dimension
def test_tiles_are_exact_beyond_float32(spark):
    from basketlens.llm import neighbours
    rng = np.random.default_rng(12)
    base = np.sign(rng.normal(size=4096))  # codes near +-127: sums far beyond 2^24
    v = np.stack([base * (1 + 1e-6 * rng.normal(size=4096)) for _ in range(60)])
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    import math
    for q in (0, 20, 40):
        score = {i: math.fsum((v[q] * v[i]).tolist()) for i in range(60) if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [r.vec_id for r in got if r.query_id == q] == want
        assert [r.score for r in got if r.query_id == q] == [score[i] for i in want]
