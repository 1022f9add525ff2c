"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for the three base kinds and for further candidates
(long mixed tokens). A candidate value is hashed, and its distinct owners and
repositories are counted over the corpus. Values with more of them than allowed
are counted again by copy groups: the texts that carry them and are near
duplicates (five-word shingles, similarity of 0.75 or more) are one copy, so a
document and its copies are one owner. Each copy counts for the value's main
owner (the one with most copies) if that one carries it, else for its first
owner; owners are the distinct ones so counted, and so are repositories. How
often one owner repeats a value plays no part. A value with many owners or
repositories is a copied example; any other one that looks random is reported as
an added span of kind ``owned``. Base spans are always reported, each with its
verdict.

Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STRING, Scratch, packed, read_table, schema
from .near_join import jaccard_components

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORD = re.compile(r"pass|secret|token|api", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
MIN_VALUE = 6

# Further candidates: tokens of 20 or more of these characters with a digit and
# a letter in them and enough spread to look random.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_BITS = 3.0
#: A value with more distinct owners or repositories than this is a copied example.
MAX_OWNERS = 1
MAX_REPOSITORIES = 3


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret value) of the base kinds by start, then kind."""
    found = []
    if KEYWORD.search(text):
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def bits(value: str) -> float:
    """Entropy of the characters of a value, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Random-looking tokens outside the base spans."""
    out = []
    for m in CANDIDATE.finditer(text):
        v = m.group()
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and bits(v) >= MIN_BITS and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
            out.append(("owned", m.start(), m.end(), v))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {k: [] for k in ("base", "found", "hashes", "carrier")}
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            more = candidates(text, base) if text else []
            cols["base"].append([s[:3] for s in base])
            cols["found"].append([s[:3] for s in more])
            cols["hashes"].append([value_hash(s[3]) for s in base + more])
            cols["carrier"].append(text if base or more else None)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = {k: [[dict(zip(("kind", "start", "end"), s)) for s in r] for r in cols[k]] for k in ("base", "found")}
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(rows["base"], span), pa.array(rows["found"], span), pa.array(cols["hashes"], pa.list_(pa.int64())), pa.array(cols["carrier"], pa.string())],
                                         [*keep, "base", "found", "hashes", "carrier"])


_PLACE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _independent(carried: DataFrame, by: str) -> DataFrame:
    """``carried`` (hash, copy, ``by``) -> hash, number of distinct ``by`` when
    each copy counts for one of them only, for the value's main one if it can."""
    carried = carried.select("hash", "copy", by).distinct()
    main = (carried.groupBy("hash", by).agg(F.count("*").alias("copies"))
            .groupBy("hash").agg(F.max(F.struct("copies", by)).alias("most")).select("hash", F.col(f"most.{by}").alias("main")))
    taken = (carried.join(main, "hash").groupBy("hash", "copy")
             .agg(F.max(F.when(F.col(by) == F.col("main"), F.col(by))).alias("main"), F.min(by).alias("first"))
             .select("hash", F.coalesce("main", "first").alias(by)).distinct())
    return taken.groupBy("hash").agg(F.count("*").alias(by))


def copied_values(scratch: Scratch, carried: DataFrame, texts: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """``carried`` (hash, text_hash, owner, repository), ``texts`` (text_hash,
    text) -> hash of each value that is a copied example."""
    def many(owners: Column, repositories: Column) -> Column:
        return (owners > max_owners) | (repositories > max_repositories)

    places = carried.select("hash", "owner", "repository").distinct()
    count = lambda by: places.select("hash", by).distinct().groupBy("hash").agg(F.count("*").alias(by))
    doubtful = scratch.table("doubtful", count("owner").join(count("repository"), "hash").filter(many(F.col("owner"), F.col("repository"))).select("hash"))
    again = scratch.table("again", carried.join(doubtful, "hash", "left_semi"))
    wanted = again.select("text_hash").distinct()
    if not doubtful.limit(1).count():
        return doubtful
    of_text = texts.join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    copies = jaccard_components(scratch.table("texts", of_text.select(F.col("text_hash").alias("doc_id"), "text"))).select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("copy"))
    again = scratch.table("copies", again.join(copies, "text_hash").select("hash", "copy", "owner", "repository").distinct())
    return (_independent(again, "owner").join(_independent(again, "repository"), "hash")
            .filter(many(F.col("owner"), F.col("repository"))).select("hash"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS,
                 max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` (doc_id, text, owner and repository columns) -> doc_id,
    base and added spans, whether each base span's value is owned, and how many
    of the document's values are copied (more than ``max_owners`` independent
    owners or ``max_repositories`` repositories) or owned.

    Null and empty texts have no spans; long texts are scanned whole. A null
    owner counts as an owner of its own, and so does a null part of a repository.
    Repeated rows are each reported; they count as one text. Empty input gives
    no rows. Further columns are ignored."""
    scratch = Scratch(docs.sparkSession, "secrets")
    out = schema(doc_id=LONG, text_hash=LONG, owner=STRING, repository=STRING, base=_PLACE, found=_PLACE, hashes=T.ArrayType(LONG), carrier=STRING)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"),
                         F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repository]).alias("repository"),
                         F.col("text").cast("string").alias("text"))
    scanned = scratch.table("scanned", narrow.mapInArrow(_scan, out).withColumn("row", F.monotonically_increasing_id()))
    # Ownership of each value: pre-aggregated by value, text, owner and repository.
    value = scanned.filter("size(hashes) > 0").select("row", "text_hash", "owner", "repository", F.posexplode("hashes").alias("at", "hash"))
    carried = scratch.table("carried", value.select("hash", "text_hash", "owner", "repository").distinct())
    texts = scanned.filter("size(hashes) > 0").select("text_hash", F.col("carrier").alias("text"))
    copied = scratch.table("copied", copied_values(scratch, carried, texts, max_owners, max_repositories)).withColumn("copied", F.lit(True))
    # One row for each document with values: the verdict on each, by position.
    verdict = (value.select("row", "at", "hash").join(copied, "hash", "left")
               .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.col("copied").isNull().alias("owned")))).alias("values")))
    found = scanned.join(verdict, "row", "left")
    added = F.expr("filter(found, (s, i) -> values[size(base) + i].owned)")
    return (found.withColumn("added", F.coalesce(added, F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")))
            .withColumn("base_owned", F.expr("transform(base, (s, i) -> values[i].owned)"))
            .withColumn("n_copied", F.coalesce(F.expr("size(filter(values, v -> not v.owned))"), F.lit(0)).cast("long"))
            .withColumn("n_owned", F.coalesce(F.expr("size(filter(values, v -> v.owned))"), F.lit(0)).cast("long"))
            .select("doc_id", "text_hash", "base", "added", "base_owned", "n_copied", "n_owned"))


def _joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    count = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "owned"))), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), "n_copied", "n_owned",
                        F.array_join(F.transform("base_owned", lambda v: F.when(v, "owned").otherwise("copied")), ",").alias("base_verdicts"))


MASK = "[REDACTED]"


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each run of overlapping or adjacent spans replaced."""
    out, at = [], 0
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def _mask(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten()))
            texts = []
            for text, places in zip(columns["text"].to_pylist(), batch.column("places").to_pylist()):
                spans = [s[1:3] for s in base_spans(text)] if text else []
                texts.append(mask(text, spans + [(p["start"], p["end"]) for p in places or []]) if spans or places else text)
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)
    return run


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (columns of documents, and any others whatever their names) with
    every base and added span of its texts replaced by MASK; ``n_chars`` follows
    the text. Rows without spans, null and empty texts stay as they are; repeated
    rows are each masked; empty input gives no rows."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    added = (find_secrets(docs).filter("size(added) > 0").select(F.col("doc_id").alias("added_id"), F.col("text_hash").alias("added_hash"), "added")
             .groupBy("added_id", "added_hash").agg(F.first("added").alias("places")))
    rows = packed(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = rows.join(added, F.col("id").eqNullSafe(F.col("added_id")) & (F.col("hash") == F.col("added_hash")), "left")
    out = T.StructType([T.StructField(f.name, T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema])
    return rows.select("row", "places").mapInArrow(_mask(docs.columns), out)
