"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into dictionary phrases: each phrase is the
longest known one and one more character (LZ78). The set of phrases is hashed;
its signature has the smallest hash of each of SLOTS classes (one permutation,
classes by the hash's low bits; empty classes borrow from the next filled one).
The share of equal places of two signatures estimates how much of their phrases
two texts have in common, which is high for texts that would compress together.

The edited text of the query replaces the end of a document by the beginning of
the next one. Documents are dealt to ranges of ids; the first document of each
range is given to the range before it too, so each range knows all its next
documents and no global order runs through one task. The parse up to the edit is
shared by both texts.

Defined cases: a null text is the empty text; the empty text has no phrase and
the signature of zeros, alike (1.0) to itself and unlike (0.0) all others; rows
of one id follow each other in the order of their texts; a lone document is its
own next one; an empty table gives an empty result. Null ids come first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import cut, parts

SLOTS = 64
#: Bounds of ranges that are compared at a time.
STEP = 64


def parse(text: str, known: set | None = None, phrase: str = "") -> tuple[set, str]:
    """The phrases of a text and the unfinished one at its end; known and phrase: those of a text before it."""
    known = set() if known is None else known
    add = known.add
    for c in text:
        phrase += c
        if phrase not in known:
            add(phrase)
            phrase = ""
    return known, phrase


def hashes(phrases) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p.encode("utf-8", "surrogatepass")) for p in phrases), np.uint64)


def least(found: np.ndarray) -> np.ndarray:
    """The smallest hash of each class (all ones: none)."""
    low = np.full(SLOTS, np.uint64(2**64 - 1))
    if len(found):
        np.minimum.at(low, (found % np.uint64(SLOTS)).astype(np.int64), found // np.uint64(SLOTS))
    return low


def signature(low: np.ndarray) -> np.ndarray:
    """16 bits a class; an empty class takes those of the next filled one, mixed with the distance."""
    filled = low != np.uint64(2**64 - 1)
    if not filled.any():
        return np.zeros(SLOTS, np.uint16)
    at = np.arange(SLOTS)
    twice = np.flatnonzero(np.concatenate([filled, filled]))
    source = twice[np.searchsorted(twice, at)]
    # Low bits of the minimum are still uniform; one is added so that zeros mean the empty text alone.
    value = (low[source % SLOTS] + (source - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(65535) + np.uint64(1)
    return value.astype(np.uint16)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def spell(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprint(text: str | None) -> str:
    known, rest = parse(text or "")
    found = hashes(known | {rest} if rest else known)
    return spell(signature(least(found)))


def _both(text: str, head: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited form, and the latter's text; head: what replaces the end."""
    keep = len(text) - len(text) // 4
    kept = text[:keep]
    known, phrase = parse(kept)
    shared = least(hashes(known))
    sigs = []
    for tail in (text[keep:], head):
        more = _tail(tail, known, phrase)
        sigs.append(signature(np.minimum(shared, least(hashes(more)))))
    return sigs[0], sigs[1], kept + head


def _tail(text: str, known: set, phrase: str) -> set:
    """The further phrases of a text after a parse that is left as it is; with the unfinished one at the end."""
    new: set = set()
    for c in text:
        phrase += c
        if phrase not in known and phrase not in new:
            new.add(phrase)
            phrase = ""
    if phrase:
        new.add(phrase)
    return new


def _rows(batches):
    """Rows (range, doc_id, text, mark) in order; a marked one closes its range and is only a next document."""
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before = None  # the document that waits for its next one
    wait = None  # its result, that waits for the next one's signature

    def flush(out):
        if out:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], fields)

    for batch in batches:
        out, kind = [], batch.schema.field("doc_id").type
        for place, i, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            if before is not None and before[0] != place:
                raise RuntimeError("a range of documents lacks its end")
            sig = None
            if before is not None:
                _, old_id, old = before
                own, edited, spelled = _both(old, text[: len(old) // 4])
                if wait is not None:
                    out.append((*wait[:-1], alike(wait[-1], own)))
                wait = (old_id, len(old), hashlib.sha256(spelled.encode("utf-8", "surrogatepass")).hexdigest(), spell(own), spell(edited), alike(own, edited), own)
            if mark:
                sig = signature(least(hashes((lambda k, r: k | {r} if r else k)(*parse(text)))))
                if wait is not None:
                    out.append((*wait[:-1], alike(wait[-1], sig)))
                before = wait = None
            else:
                before = (place, i, text)
        if made := flush(out):
            yield made


def _bounds(ids: DataFrame, n: int) -> list:
    """The least id of each of n ranges but the first, of ids of any type that has an order; n values at most."""
    ranged = ids.filter(F.col("doc_id").isNotNull()).repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("least"))
    return sorted(r["least"] for r in ranged.collect())[1:]


def _place(id_: Column, bounds: list) -> Column:
    """The number of bounds that an id is not below, found by every STEP-th bound and then within a step; null ids: 0."""
    if not bounds:
        return F.lit(0)
    every = F.array(*[F.lit(b) for b in bounds])
    step = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[::STEP]]), lambda b: b <= id_))
    inside = F.size(F.filter(F.slice(every, F.greatest(step - 1, F.lit(0)) * STEP + 1, STEP), lambda b: b <= id_))
    return F.when(id_.isNull() | (step == 0), 0).otherwise((step - 1) * STEP + inside)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    n = parts(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.withColumn("place", _place(F.col("doc_id"), _bounds(rows.select("doc_id"), n)))
    # The first document of each range (n at most), which closes the range before it; the very first closes the last one.
    firsts = cut(rows.groupBy("place").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")).select("place", "first.doc_id"))
    closes = firsts.select("place", "doc_id", F.coalesce(F.lag("place").over(Window.orderBy("place")), F.max("place").over(Window.partitionBy())).alias("closed"))
    heads = rows.alias("a").join(F.broadcast(closes.alias("b")), (F.col("a.place") == F.col("b.place")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")))
    heads = heads.groupBy("b.closed", "a.doc_id").agg(F.min("a.text").alias("text"))
    every = rows.select("place", "doc_id", "text", F.lit(False).alias("mark")).unionByName(heads.select(F.col("closed").alias("place"), "doc_id", "text", F.lit(True).alias("mark")))
    ranged = every.repartitionByRange(n, "place").sortWithinPartitions("place", "mark", "doc_id", "text")
    return ranged.mapInArrow(_rows, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
