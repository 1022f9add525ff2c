import random
from pathlib import Path

from basketlens.llm import pii
from basketlens.llm.common import Scratch
from pyspark.sql import functions as F


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10


def test_a_full_private_range_keeps_distinct_surrogates(spark):
    docs = spark.range(256).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 255), x -> concat('192.168.', id, '.', x)), ' and ')").alias("text"))
    before = {r.doc_id: r.text.split(" and ") for r in docs.collect()}
    after = {r.doc_id: r.text.split(" and ") for r in pii.surrogates(docs).collect()}
    new = [a for i in after for a in after[i]]
    assert len(set(new)) == 65536 and set(new) == {a for i in before for a in before[i]}
    assert not any(x == y for i in before for x, y in zip(before[i], after[i]))


def test_permutations_stay_in_their_format(spark):
    """Every closed format as if it were dense: one value each for all of a
    part of it, same format, never the same value."""
    rng = random.Random(3)
    cards = ["4" + "".join(rng.choice("0123456789") for _ in range(14)) for _ in range(200)]
    rows = [("ssn", f"{i:09d}") for i in range(300)] + [("phone", f"1555{i:07d}") for i in range(300)] + [("card", c + str(d)) for c in cards for d in (0, 5)]
    rows += [("ip", f"10.0.{i}.7") for i in range(256)] + [("ip", f"203.0.{i}.7") for i in range(256)] + [("ip", ":".join(["fe80", *["0000"] * 6, f"{i:04x}"])) for i in range(1, 300)]
    rows += [("ip", ":".join([f"{i:04x}", *["0000"] * 7])) for i in range(1, 100)] + [("ip", ":".join(["2001", "0db8", *["0000"] * 5, f"{i:04x}"])) for i in range(1, 100)]
    t = spark.createDataFrame(rows, "kind string, canonical string").withColumn("shape", F.expr(pii._shape())).withColumn("to", F.expr(pii._permuted("k")))
    t = t.withColumn("surrogate", F.expr(pii._reshaped())).withColumn("again", F.expr(pii._shape().replace("canonical", "surrogate")))
    out = t.collect()
    assert len({(r.kind, r.surrogate) for r in out}) == len(out) == len(set(rows))
    assert all(r.surrogate != r.canonical and len(r.surrogate.split(".")) == len(r.canonical.split(".")) for r in out)
    assert all(r.shape.format == r.again.format and (r.to.l, r.to.r) == (r.again.l, r.again.r) for r in out)
    assert all(luhn(r.canonical) == luhn(r.surrogate) or luhn(r.canonical) > 0 for r in out if r.kind == "card")
    assert all((luhn(r.canonical) == 0) == (luhn(r.surrogate) == 0) for r in out if r.kind == "card")


def test_few_free_spellings_do_not_stop_the_query(spark):
    texts = [f"{c}@example.com" for c in "aeiouAE"] + [f"{c}@b.de" for c in "aeiou"] + [f"{c}@c.de" for c in "aeiou"] + ["0000:: and 0:0:0:0:0:0:0:0", "0000::1", "Mr Łą", "Mr Łę", "Mr Աբ"]
    out = {r.doc_id: r for r in pii.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    mails = [out[i].text.lower() for i in range(17) if i not in (5, 6)]
    assert len(set(mails)) == 15 and all(m not in [t.lower() for t in texts] for m in mails)
    assert out[0].text.lower() == out[5].text.lower() and out[5].text != out[5].text.lower()
    assert out[17].text == texts[17] and out[17].n_ip == 0 and out[18].text != texts[18]
    assert len({out[i].text for i in (19, 20, 21)}) == 3 and out[21].text != texts[21]


def test_whole_names_go_in_every_spelling(spark):
    texts = ["Mr McDonald came", "Mr. O'Brien's dog", "Dr. John Smith, MR JOHN SMITH and Mr John Smith", "PROF. O'BRIEN", "Frau Meyer-Lansky", "Mr Smith NATO", "Drum Solo", "FRAU MÜLLER"]
    out = [r.text for r in sorted(pii.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())]
    assert out[0].startswith("Mr ") and out[0].endswith(" came") and not any(part in out[0] for part in ("Mc", "Donald"))
    assert "Brien" not in out[1] and out[1].endswith("'s dog")
    doctor, rest = out[2].split(", ")
    upper, mixed = rest.split(" and ")
    assert "Smith" not in out[2] and "SMITH" not in out[2] and upper[3:] == mixed[3:].upper() and upper.startswith("MR ")
    assert doctor.split()[-1] == mixed.split()[-1] and doctor.startswith("Dr. ")
    assert out[3] == "PROF. " + out[1].split()[1][:-2].upper()
    assert "-" in out[4] and "Lansky" not in out[4] and out[5].endswith(" NATO") and out[6] == texts[6]
    assert out[7].startswith("FRAU ") and out[7] == out[7].upper() and out[7] != texts[7]


def test_entities_take_few_files_whatever_the_shuffle_partitions(spark, monkeypatch):
    roots, init = [], Scratch.__init__
    monkeypatch.setattr(Scratch, "__init__", lambda self, *a: (init(self, *a), roots.append(self.root))[0])
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    texts = [f"from m{i}@example.org at 203.0.113.{i} by Mr {'ABCDEFGHIJ'[i // 10]}{'abcdefghij'[i % 10]}son" for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, "no entity")], "doc_id long, text string").coalesce(1)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = []
        for a_file in (10_000, 60):
            monkeypatch.setattr(pii, "FILE_ENTITIES", a_file, raising=False)
            out.append(sorted(pii.surrogates(docs).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for root, most in zip(roots, (1, 3), strict=True):
        files = {p.name: len([*p.glob("part-*.parquet")]) for p in Path(root.removeprefix("file:")).iterdir()}
        assert {"seen", "each", "families", "entities", "judged0", "settled"} <= set(files) and max(files.values()) <= most, files
    assert out[0] == out[1] and len(out[0]) == 62 and not any(t == r.text for t, r in zip(texts, out[0]))
    assert [sum(r[f"n_{k}"] for r in out[0]) for k in ("email", "ip", "name")] == [60, 60, 60]
