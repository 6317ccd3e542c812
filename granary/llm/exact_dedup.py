"""Exact duplicates by content-defined chunk recipes.

A text, with each run of white space as one space, is cut where a rolling hash of the last 32
bytes hits a pattern, so equal passages give equal chunks. Chunks are deduplicated once over the
corpus by hash and content, map side first. A hash with one content is a verified identifier; where
contents share a hash, each content gets a number, and the identifier is the pair. A document is
then its length and its ordered list of identifiers, and documents are equal when these are:
grouping moves lists of some numbers instead of texts.

Rows of one text are first reduced within salts, then the salts' results by text, and come back the
same way, so that no task gets a large group of copies row by row.

Null texts count as empty and are equal to empty ones. Of equal texts the row with the smallest
doc_id stays (nulls last); of rows that also share the doc_id, exactly one. A very long text is cut
in one task and moves as its chunks. An empty table gives an empty one. Only ``doc_id`` and ``text``
are read, whatever other columns are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WHITE, map_batches
from granary.session import stage

LEAST, MOST = 512, 8192
#: Parts that a group of equal texts is spread over.
SALTS = 64


def _gears() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)


GEARS = _gears()


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks. No end lies within the first 512 bytes after another, more than the
    window, so that equal passages are cut alike whatever stands before."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = GEARS[np.frombuffer(raw, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        further = h.copy()
        further[s:] += h[:-s] << np.uint32(s)
        h = further
    ends, start = [], 0
    for at in (np.flatnonzero((h >> np.uint32(21)) == 0) + 1).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST and at < n:
            start = at
            ends.append(at)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, n]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunked(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, text_sha256, n_bytes, hashes, chunks)``."""
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", text.cast("binary").alias("raw"))

    def make():
        import xxhash

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, chunks = [], []
            for raw in batch.column("raw").to_pylist():
                parts, start = [], 0
                for end in boundaries(raw):
                    parts.append(raw[start:end])
                    start = end
                chunks.append(parts)
                values = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64)
                hashes.append((values & np.uint64((1 << hash_bits) - 1)).view(np.int64))
            raw = batch.column("raw")
            columns = [batch.column("doc_id"), batch.column("sha"), batch.column("size"), pa.array(hashes, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "n_bytes", "hashes", "chunks"])

        return work

    rows = rows.select("doc_id", F.sha2("raw", 256).alias("sha"), F.octet_length("raw").cast("bigint").alias("size"), "raw")
    return map_batches(rows, make, "doc_id bigint, text_sha256 string, n_bytes bigint, hashes array<bigint>, chunks array<binary>")


def recipes(cut: DataFrame) -> DataFrame:
    """``cut`` without its chunks and with ``recipe``: verified identifiers in order."""
    pairs = cut.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("p")).select(F.col("p.hashes").alias("h"), F.col("p.chunks").alias("c"))
    contents = pairs.groupBy("h", "c").agg(F.first(F.lit(1)).alias("_"))
    shared = stage(contents.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "dedup-shared")
    plain = F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("n")))
    kept = cut.drop("chunks").withColumn("recipe", plain)
    if shared.isEmpty():
        return kept.drop("hashes")
    # Contents that share a hash, numbered from 1 by their digests; each digest is checked to be of
    # one content by the grouping on the content itself.
    listed = pairs.join(shared, "h", "left_semi").groupBy("h", "c").agg(F.first(F.lit(1)).alias("_")).select("h", "c", F.sha2("c", 256).alias("d"))
    numbers = listed.groupBy("h").agg(F.sort_array(F.collect_list("d")).alias("digests")).withColumnRenamed("h", "_h")
    at = cut.select("row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("pos", "p")).select("row", "pos", F.col("p.hashes").alias("h"), F.sha2("p.chunks", 256).alias("d"))
    solved = at.join(numbers, at["h"] == numbers["_h"]).select("row", F.struct("pos", F.array_position("digests", F.col("d")).cast("int").alias("n")).alias("x"))
    fixes = solved.groupBy("row").agg(F.map_from_entries(F.collect_list("x")).alias("fix")).withColumnRenamed("row", "_row")
    exact = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.element_at("fix", i), F.lit(0)).alias("n")))
    joined = cut.drop("chunks").join(fixes, F.col("row") == F.col("_row"), "left").withColumn("fix", F.coalesce("fix", F.create_map().cast("map<int,int>")))
    return joined.withColumn("recipe", exact).drop("hashes", "fix", "_row")


def deduplicate(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row a row of ``docs``."""
    cut = stage(chunked(docs, hash_bits).withColumn("row", F.monotonically_increasing_id()), "dedup-chunks")
    rows = recipes(cut).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    key = ["n_bytes", "recipe"]
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    salted = rows.groupBy("salt", *key).agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy(*key).agg(F.min("least").alias("least"), F.sum("n").alias("group_size"))
    known = salted.select("salt", *key).join(whole, key)
    found = rows.join(known, ["salt", *key])
    return found.select("doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("least.row")).alias("kept"), "text_sha256")
