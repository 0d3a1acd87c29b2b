"""SimHash near-duplicates found by deletion-variant signatures.

The 64-bit fingerprint is cut into half as many segments as a classic index needs: with at most three
differing bits, one of two segments differs in one bit at most. Each segment is indexed once as it is
and once per position with that bit as a wildcard, so an equality join finds every such pair; it is
then verified on the whole fingerprint. Copies share a fingerprint and are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import fresh_name, settle
from tillwright.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENT_BITS = 32
#: Hashes summed at a time, so that a very long text needs little memory.
CHUNK = 1 << 16
#: Fingerprints that share a whole segment, beyond which the bucket is indexed by the other one too.
HOT_SEGMENT = 2_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        return digest(joined, SEED)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[: len(words) - shingle_words + 1]
    ends = np.concatenate((spaces, [len(joined)]))[shingle_words - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        some = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in some], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Columns doc_id and fp (the fingerprint's bits as a signed long), a row per document."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle_words) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": bits})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A null id would turn the batch's ids into floating numbers, so ids travel as text.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(each, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _segment(index: int) -> str:
    return f"(shiftrightunsigned(fp, {index * SEGMENT_BITS}) & {(1 << SEGMENT_BITS) - 1}L)"


def _variants(nodes: DataFrame) -> DataFrame:
    """Index keys of each fingerprint: per segment the exact one and one per wildcard position.

    The key holds the segment's number, the position (32: none) and the bits left. ``side`` is the bit
    under the wildcard, so that a pair with equal segments meets under the exact key only.
    """
    parts = []
    for index in range(64 // SEGMENT_BITS):
        tag = f"shiftleft(cast({index} as bigint), 40)"
        exact = f"array(struct({tag} | shiftleft(32L, 33) | {_segment(index)} as key, cast(null as int) as side))"
        wild = (
            f"transform(sequence(0, {SEGMENT_BITS - 1}), i -> struct("
            f"{tag} | shiftleft(cast(i as bigint), 33) | ({_segment(index)} & ~shiftleft(1L, i)) as key, "
            f"cast(shiftrightunsigned({_segment(index)}, i) & 1 as int) as side))"
        )
        parts.append(f"concat({exact}, {wild})")
    return nodes.select("fp", F.expr(f"inline(concat({', '.join(parts)}))"))


def _other_variants(rows: DataFrame) -> DataFrame:
    """Keys refined by the other segment, for buckets with very many fingerprints.

    The other segment differs in three bits at most, so one of its halves in one at most: the same
    index once more, with halves for segments. A pair may meet under both halves.
    """
    other = f"(CASE WHEN key >= shiftleft(1L, 40) THEN {_segment(0)} ELSE {_segment(1)} END)"
    parts = []
    for half in (0, 16):
        bits = f"(shiftrightunsigned({other}, {half}) & 65535L)"
        parts.append(f"array(struct({half} as half, 16 as hole, {bits} as rest, cast(null as int) as other_side))")
        parts.append(
            f"transform(sequence(0, 15), i -> struct({half} as half, i as hole, {bits} & ~shiftleft(1L, i) as rest, "
            f"cast(shiftrightunsigned({bits}, i) & 1 as int) as other_side))"
        )
    return rows.select("key", "side", "fp", F.expr(f"inline(concat({', '.join(parts)}))"))


def _joined(rows: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Pairs under equal keys, on different sides of every wildcard, within the distance."""
    sides = [c for c in ("side", "other_side") if c in rows.columns]
    left = rows.select(*keys, *(F.col(c).alias(f"{c}_a") for c in sides), F.col("fp").alias("a"))
    right = rows.select(*keys, *(F.col(c).alias(f"{c}_b") for c in sides), F.col("fp").alias("b"))
    if sides == ["side"]:  # halves the rows of either side of the join
        left, right = left.where("side_a is null or side_a = 0"), right.where("side_b is null or side_b = 1")
    pairs = left.join(right, keys).where(f"a != b and bit_count(a ^ b) <= {max_bits}")
    for c in sides:
        pairs = pairs.where(f"({c}_a is null and {c}_b is null) or {c}_a != {c}_b")
    return pairs.where("side_a is not null or a < b").select("a", "b")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """Pairs (a, b) of different fingerprints ``fp`` that differ in at most ``max_bits`` bits.

    Exact for up to three bits. A segment value shared by more than ``hot_segment`` fingerprints has its
    buckets indexed by the other segment as well, so that they yield few pairs besides links.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    segments = [nodes.select(F.expr(f"shiftleft(cast({i} as bigint), 40) | {_segment(i)}").alias("value")) for i in (0, 1)]
    counts = segments[0].unionByName(segments[1]).groupBy("value").count().where(F.col("count") > hot_segment)
    hot = settle(counts.select("value"))
    rows = _variants(nodes)
    if hot.isEmpty():
        return _joined(rows, ["key"], max_bits).distinct()
    # The buckets of a hot value: the exact one and those with one of its bits as a wildcard.
    low = "(value & 4294967295L)"
    bucket = hot.select(
        F.expr(
            f"explode(transform(sequence(0, 32), i -> (value - {low}) | shiftleft(cast(i as bigint), 33) | "
            f"IF(i = 32, {low}, {low} & ~shiftleft(1L, i))))"
        ).alias("key")
    ).distinct()
    plain = _joined(rows.join(bucket, "key", "left_anti"), ["key"], max_bits)
    refined = _joined(_other_variants(rows.join(bucket, "key", "left_semi")), ["key", "half", "hole", "rest"], max_bits)
    return plain.unionByName(refined).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id.

    Documents are linked if their fingerprints differ in at most ``max_bits`` bits, and component_id is
    the smallest doc_id reachable. Null and wordless texts have fingerprint zero and are linked like any
    other. Repeated rows stay repeated. A null doc_id links like any other but never names a component
    that has a known id.
    """
    rows = settle(fingerprints(docs, shingle_words))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes, max_bits))
    grouped = nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root")
    linked = grouped.select("fp", "root").join(grouped.groupBy("root").agg(F.min("least").alias("component")), "root")
    named = nodes.join(linked.select(F.col("fp").alias("linked"), "component"), F.col("fp") == F.col("linked"), "left")
    named = named.select("fp", F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that name their group, one of each, with all their columns.

    Of rows that repeat the doc_id one stays; rows without doc_id stay, since nothing tells them apart.
    """
    found = near_duplicates(docs, shingle_words, max_bits)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    known = docs.join(keep, docs.doc_id.cast("long") == keep.kept, "left_semi")
    turn = fresh_name(docs, "turn")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    once = known.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
    return once.unionByName(docs.where("doc_id is null"))
