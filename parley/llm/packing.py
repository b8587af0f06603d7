"""Best-fit packing by minimum bin slack.

Sequences are filled one after another: a bitset subset-sum dynamic programme over the lengths that are
left finds the fullest combination, which is then removed (of equally full ones, one that holds the
longest length left).  What matters about pieces is only how many there are of each length, at most
`capacity` numbers, so the driver packs lengths, and a combination is taken as often as the counts
allow; pieces then get their places in parallel, by their rank within their length.

Defined cases: null text counts as empty (only the closing id); rows that repeat an id, with the same or other
texts, are packed each; rows without an id are packed too; extra columns, whatever their names, are not read; an empty table gives no rows; only texts of over `capacity`
ids are cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.bpe import Encoder, runs_of_texts, vocabulary, vocabulary_path
from parley.llm.common import lean, saved, table

CAPACITY = 4096
CLOSING_ID = 1
#: Pieces of one length that are ranked in one group.
RANK_GROUP = 400
#: Groups of one length at most; beyond, groups are larger, so that counting them off stays small.
MOST_GROUPS = 4096


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination {length: copies} with the largest sum of at most `capacity`; lengths ascend."""
    reach, layers, mask = 1, [], (1 << (capacity + 1)) - 1
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(step, left)
            layers.append((length, n, reach))
            reach |= reach << (length * n) & mask
            left -= n
            step *= 2
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(layers):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + n
            at -= length * n
    return taken


@dataclass(frozen=True)
class Plan:
    """Runs of ranks of a length: (length << 40 | first rank), copies a sequence, first sequence, offset."""

    keys: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length << 40 | rank, "right") - 1
        nth = rank - (self.keys[at] & ((1 << 40) - 1))
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """counts: how many pieces there are of each length from 1 to capacity."""
    left = {k: n for k, n in counts.items() if n}
    lengths, used = sorted(left), dict.fromkeys(left, 0)
    rows, sequences = [], 0
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        taken = fullest(lengths, left, capacity - longest)
        left[longest] += 1
        if longest + sum(k * n for k, n in taken.items()) == capacity:
            taken[longest] = taken.get(longest, 0) + 1
        else:
            taken = fullest(lengths, left, capacity)
        times, offset = min(left[k] // n for k, n in taken.items()), 0
        for k, n in sorted(taken.items(), reverse=True):
            rows.append((k << 40 | used[k], n, sequences, offset))
            used[k] += n * times
            offset += k * n
            left[k] -= n * times
            if not left[k]:
                del lengths[bisect_left(lengths, k)]
        sequences += times
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*table_.T, sequences)


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each row's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        closing = np.array([CLOSING_ID], "<u4")
        for batch in batches:
            for lo, texts in runs_of_texts(batch.column("text")):
                ids, offsets = encoder.encode(texts)
                ids, at, out = ids.astype("<u4"), offsets.tolist(), []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    own = np.concatenate([ids[a:b], closing])
                    for k in range(0, len(own), capacity):
                        part = own[k : k + capacity]
                        out.append((lo + i, k // capacity, k, len(part), zlib.crc32(part)))
                row, *cols = zip(*out, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all rows with sequence_id and offset."""
    pieces = saved(pieces_of(docs, path or vocabulary_path(), capacity))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = docs.sparkSession.sparkContext.broadcast(pack(counts, capacity))
    groups = min(MOST_GROUPS, max(1, -(-max(counts.values(), default=1) // RANK_GROUP)))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "deal").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = dealt.withColumn("nth", F.row_number().over(within)).join(first, ["length", "deal"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
