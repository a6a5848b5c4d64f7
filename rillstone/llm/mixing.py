"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are to be used f times each on average; everyone gets the
whole part of f as copies, the fraction becomes 0 or 1 by pivotal rounding:
two documents exchange mass until one of them is integral, so that every
document keeps its expectation and the source its number of tokens, but for
one document in the end. Documents are dealt to buckets by a hash of the id;
a bucket is rounded in order of id and passes one open document per source up a
reduction tree. Buckets depend on the documents alone, so the same documents
give the same mix however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.session import materialize, parallelism

#: Vocabulary file of a public byte-level BPE.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which that BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Buckets whose open documents one bucket of the next level takes; documents in a first bucket, about.
FAN_IN, BUCKET_DOCS = 32, 20_000


@lru_cache(maxsize=2)
def encoding(file: bytes):
    """The tokenizer of a rank file's content, once for each Python worker."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def canonical_source(source: Column) -> Column:
    """Without blanks around, in lower case, hyphens and blanks within as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def token_counts(docs: DataFrame, doc_id: str, text: str, keep: list[Column], tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` and the columns ``keep``; null and empty texts have 0 tokens.

    Only the driver reads the tokenizer's file (a megabyte or so) and sends it along.
    """
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def allot(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source in a mix of ``total``, as near to the shares as the caps allow.

    Sources whose share is beyond ``repeats`` times their tokens get just that;
    the others share what is left in proportion to their targets. This is the
    nearest mix in relative entropy. If all are capped the mix is smaller.
    """
    cap = {s: tokens.get(s, 0) * max(0, repeats[s]) for s in shares}
    out: dict[str, float] = {}
    open_ = {s for s in shares if shares[s] > 0}
    left = total
    while open_:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if left * shares[s] / weight >= cap[s]}
        if not full:
            out |= {s: left * shares[s] / weight for s in open_}
            break
        out |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return {s: out.get(s, 0.0) for s in shares}


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on two ids and the seed only."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def pivot(a: tuple, b: tuple, seed: int) -> tuple[tuple, tuple]:
    """One exchange between two open units (id, weight, probability); at least one becomes 0 or 1."""
    (i, w, p), (j, v, r) = a, b
    up, down = min((1 - p) * w, r * v), min(p * w, (1 - r) * v)
    if _uniform(i, j, seed) * (up + down) < down:
        p, r = (1.0 if up == (1 - p) * w else p + up / w), (0.0 if up == r * v else r - up / v)
    else:
        p, r = (0.0 if down == p * w else p - down / w), (1.0 if down == (1 - r) * v else r + down / v)
    return (i, w, p), (j, v, r)


def _round(seed: int, last: bool):
    """Round the units of each bucket; those open in the end stay open, unless this is the last level.

    A task's rows come sorted by bucket and id.
    """
    names = ["doc_id", "source", "n_tokens", "p", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        bucket = None

        def rest() -> list[tuple]:
            got = [(i, s, w, float(_uniform(i, 0, seed) < p) if last else p, bucket) for s, (i, w, p) in held.items()]
            held.clear()
            return got

        for b in batches:
            out: list[tuple] = []
            for i, source, w, p, here in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if here != bucket:
                    out += rest()
                    bucket = here
                now = (i, w, p)
                if 0 < p < 1 and source in held:
                    for x in pivot(held.pop(source), now, seed):
                        if 0 < x[2] < 1:
                            held[source] = x
                        else:
                            out.append((x[0], source, x[1], x[2], here))
                elif 0 < p < 1:
                    held[source] = now
                else:
                    out.append((*now[:1], source, *now[1:], here))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
        left = rest()
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*left, strict=True)], names=names)

    return run


def mix(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Copies of each document, and the shares reached.

    ``targets`` has ``source, target_share, max_repeat`` (a table of sources,
    so small: it is collected). Result: ``doc_id, source, n_tokens, copies``
    (copies of at least 1) and ``source, target_share, n_docs, source_tokens,
    mix_tokens, reached_share``. The mix has ``total_tokens``, by default as
    many as the documents of the targeted sources. Documents of null or
    untargeted sources and without tokens are not used; a source without
    documents gets nothing, its share goes to the others in proportion. A null
    share is 0, a null repeat 1. Shares are taken relative to their sum. The
    result depends on the rows and the seed only, not on their partitions.
    """
    spark = docs.sparkSession
    goal = targets.where("source is not null").groupBy(canonical_source(F.col("source")).alias("source")).agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("most")
    ).collect()
    shares, repeats = {r["source"]: float(r["share"]) for r in goal}, {r["source"]: int(r["most"]) for r in goal}
    rows = docs.select(F.col(doc_id).alias("doc_id"), canonical_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(shares)))
    sized = materialize(token_counts(rows, "doc_id", "text", [F.col("source")], tokenizer), "mix-tokens")
    totals = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}  # a row per target
    tokens = {s: t for s, (t, _) in totals.items()}
    wanted = allot(tokens, shares, repeats, float(total_tokens if total_tokens is not None else sum(tokens.values())))
    uses = {s: wanted[s] / tokens[s] for s in shares if tokens.get(s)}
    f = F.create_map(*[x for s, u in uses.items() for x in (F.lit(s), F.lit(u))]) if uses else F.create_map().cast("map<string,double>")
    used = F.coalesce(F.try_element_at(f, F.col("source")), F.lit(0.0))
    units = sized.where("n_tokens > 0").select("doc_id", "source", "n_tokens", (used - F.floor(used)).alias("p"))
    docs_in = sum(n for _, n in totals.values())
    n = max(1, -(-docs_in // BUCKET_DOCS))
    bucket = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("long")
    done, level = None, units.withColumn("bucket", bucket(n))
    schema = level.schema
    while True:
        tasks = min(n, 4 * parallelism(spark))
        dealt = level.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", "doc_id", "n_tokens")
        rounded = materialize(dealt.mapInArrow(_round(seed, n == 1), schema), "mix-level")
        closed = rounded.where("p = 0 or p = 1")
        done = closed if done is None else done.unionByName(closed)
        if n == 1:
            break
        n = -(-n // FAN_IN)
        level = rounded.where("p > 0 and p < 1").withColumn("bucket", bucket(n))
    copies = done.withColumn("copies", (F.floor(used) + F.col("p")).cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    reached = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"))
    facts = [(s, shares[s], totals.get(s, (0, 0))[1], tokens.get(s, 0)) for s in sorted(shares)]
    report = spark.createDataFrame(facts, "source string, target_share double, n_docs long, source_tokens long")
    report = report.join(reached, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0)).cast("long"))
    whole = report.agg(F.sum("mix_tokens").alias("_all"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("reached_share", F.try_divide(F.col("mix_tokens").cast("double"), "_all")).drop("_all")
    return copies, report
