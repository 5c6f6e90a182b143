"""SimHash near-duplicate groups over word shingles (operator 9).

Method: pigeonhole blocks. Fingerprints are split so that close pairs share a
block, joined on blocks, then verified by Hamming distance.

Defined results: a null text counts as empty; a text without a word has
fingerprint zero, which is linked like any other; fewer words than a shingle
give one shingle of them all. Repeated rows each get a row. A null doc_id keeps
its row and never becomes a component_id unless no row of the group has one.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .base import cut, documents
from .pigeonhole import hamming_components

#: Shingle width, distance and hash seed of the fingerprint.
WIDTH, DISTANCE, SEED = 4, 4, 42
#: Rows of one byte lane: more would overflow it.
LANE = 255


def bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte big-endian hashes have each bit, most significant first.

    The 64 bits of a hash become 64 bytes, added as eight 64-bit numbers: eight
    counters at a time, over no more than 255 hashes.
    """
    total = np.zeros(64, np.int64)
    packed = np.frombuffer(digests, np.uint8)
    for i in range(0, len(packed), 128 * LANE * 8):
        lanes = np.unpackbits(packed[i : i + 128 * LANE * 8]).view(np.uint64).reshape(-1, 8)
        for j in range(0, len(lanes), LANE):
            total += np.add.reduce(lanes[j : j + LANE], axis=0).view(np.uint8)
    return total


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Majority bits of the shingles' XXH64, as an unsigned integer."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    digests = b"".join(map(xxh64_digest, map(b" ".join, shingles), repeat(SEED)))
    bits = bit_counts(digests) * 2 > len(digests) // 8
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(t or b"") for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_map, f"doc_id {kind}, fp long")


def near_duplicates(docs: DataFrame, k: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = cut(fingerprints(docs))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = hamming_components(prints, k)
    rooted = least.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, then hash of its text.

    Rows that repeat both are repeats of it; one of them stays. Rows of one
    doc_id with different texts are told apart. Rows without a doc_id stay,
    since no id says which document they repeat.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("th")))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text")).filter("component_id is not null").select(F.col("component_id.doc_id").alias("d"), F.col("component_id.th").alias("t")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    kept = rows.filter("id is not null").join(found, (F.col("id") == F.col("d")) & (F.col("th") == F.col("t")), "left_semi").dropDuplicates(["id", "th"])
    return kept.select("row").union(rows.filter("id is null").select("row")).select("row.*")
