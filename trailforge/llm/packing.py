"""Packing documents into sequences by the sum of squares.

Each piece goes where the sum over all gaps g of N(g)^2 becomes smallest, N(g)
being the number of open sequences with g free places; among equal choices the
tightest fit is taken. Pieces of a full sequence's length need no choice.

Pieces are dealt at random to groups of about GROUP, and each group is packed by
one task, longest first. So the work is linear in the pieces and a group stays of one size
whatever the corpus; the open sequences at a group's end are few beside the
thousands that it fills; the README has what they waste.

Defined cases: a null text is the empty text and has the end id alone; pieces of
one length are taken in the order of id and piece; repeated rows are packed each
for itself; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import cut, parts
from trailforge.llm.tokens import encoder

CAPACITY = 4096
#: Pieces in a group, about.
GROUP = 16_384


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For lengths (1 to capacity, taken in this order) the sequence and the offset of each."""
    n = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, highest = 0, 0
    for i, s in enumerate(lengths.tolist()):
        best, gap = 1 + 2 * int(n[capacity - s]) if s < capacity else 0, capacity
        if highest >= s:
            old = n[s : highest + 1]
            change = 2 - 2 * old + 2 * n[: highest + 1 - s]
            change[0] = 1 - 2 * old[0]  # it fills the sequence, which is then no longer open
            change[old == 0] = 1 << 60
            k = int(change.argmin())
            if change[k] <= best:
                best, gap = int(change[k]), s + k
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = open_[gap].pop()
            n[gap] -= 1
        where[i], offset[i] = at, capacity - gap
        left = gap - s
        if left:
            open_[left].append(at)
            n[left] += 1
            highest = max(highest, left)
    return where, offset


def _pieces(path: str, end: int, capacity: int, blank_leads: bool, kind: pa.DataType):
    def cut_up(batches):
        coder = encoder(path, blank_leads)
        for batch in batches:
            ids_of, piece, start, length, crc = [], [], [], [], []
            for i, ids in zip(batch.column(0).to_pylist(), coder.encode_all(t.as_py() for t in batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for k in range(0, len(ids), capacity):
                    some = ids[k : k + capacity]
                    ids_of.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(some))
                    crc.append(zlib.crc32(some.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids_of, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut_up


def _packed(capacity: int):
    def pack(batches):
        """Rows come by group, longest first."""
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            where, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
            group = table.column("grp").to_numpy()
            # Odd numbers here; full pieces get the even ones.
            table = table.append_column("sequence_id", pa.array(((group << 32) | where) * 2 + 1)).append_column("offset", pa.array(offset))
            return table.drop_columns(["grp"]).combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            while batch.num_rows:
                group = batch.column(batch.schema.get_field_index("grp")).to_numpy()
                if held and held[0].column(held[0].schema.get_field_index("grp"))[0].as_py() != group[0]:
                    yield from done(pa.Table.from_batches(held))
                    held = []
                n = int(np.searchsorted(group, group[0], "right"))
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
        if held:
            yield from done(pa.Table.from_batches(held))

    return pack


def pieces(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, blank_leads: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids in pieces: doc_id, piece, start, length, ids_crc32. Only documents over the capacity have several."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, end, capacity, blank_leads, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, blank_leads: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    every = cut(pieces(docs, path, end, capacity, blank_leads, id_col, text_col))
    every = every.withColumn("nth", F.monotonically_increasing_id())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = every.filter(F.col("length") == capacity).select(*names, (F.col("nth") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = every.filter(F.col("length") < capacity)
    groups = max(1, round(rest.count() / GROUP))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("nth"), F.lit(groups))).drop("nth")
    # Beyond the session's own number of partitions, a hundred groups share one.
    dealt = rest.repartition(min(groups, max(parts(docs.sparkSession), groups // 100)), "grp").sortWithinPartitions("grp", F.col("length").desc(), "doc_id", "piece")
    kind = docs.schema[id_col].dataType.simpleString()
    packed = dealt.mapInArrow(_packed(capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(packed)
