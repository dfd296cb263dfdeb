"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints are 64 bits over three-word shingles. Two fingerprints within
three bits meet at a third one between them, so each distinct fingerprint emits
all variants within half the radius and the variants are shuffled:

* all emit themselves and their 64 variants at one bit (the near ball);
* those with an odd number of set bits also emit variants at two bits. Only a
  pair at exactly three bits needs these, and of its three bits two lie in the
  same half of the word, so two flips within a half (992) are enough. A pair at
  three bits has one fingerprint of either parity.

Every pair within three bits collides on some variant, and no other pair needs
to be looked at: if a fingerprint z is in the near ball of one that meets it,
all that meet at z are within three bits of that one. So each variant links its
members to one near member: a star in place of all pairs. Each link is verified
by its Hamming distance before it counts. A variant is met by 1,057 distinct
fingerprints at most, whatever the groups of copies, so no key is hot.

Components follow by alternating stars over distinct fingerprints; their
smallest doc_id is the component's name.

Defined cases: a null or blank text has no shingle and fingerprint zero, linked
like any other; a text of fewer than three words is one shingle, all its words;
repeated rows and equal texts share a fingerprint and so a component; an empty
table gives an empty result. Null ids count as larger than others. Extra
columns pass through ``drop_near_duplicates`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import cut, parts, unused
from trailforge.llm.components import components

#: ASCII white space, all to the blank; capitals to small letters.
_PLAIN = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
SHINGLE = 3
SEED = 42
#: Fingerprints whose variants are made at a time.
BATCH = 1024
#: Links that a task keeps before it passes them on.
HELD = 500_000


def fingerprint(text: str | None) -> int:
    """The SimHash of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    # Whole texts in pieces: the count of bits stays exact, the memory bounded.
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = 0
    for bit in np.flatnonzero(2 * ones > len(shingles)):
        value |= 1 << int(bit)
    return value


def _fingerprints(batches):
    for batch in batches:
        values = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def _hash(text_col: str):
    """A hash that parts rows of one id by their texts."""
    return F.xxhash64(F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; if asked for, th: a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = [_hash(text_col).alias("th")] if hashed else []
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return own.mapInArrow(_fingerprints, f"doc_id {kind}, fp long" + (", th long" if hashed else ""))


def flips() -> tuple[np.ndarray, np.ndarray]:
    """Masks of the near ball (0 and 1 bit) and of two bits within a half."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = [one[i] | one[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return np.concatenate([np.zeros(1, np.uint64), one]), np.array(two, np.uint64)


def _variants(batches):
    """(z, m): each variant, and the place of its mask; place 65 and above: two bits."""
    near, far = flips()
    every = np.concatenate([near, far])
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for k in range(0, len(whole), BATCH):
            fps = whole[k : k + BATCH]
            odd = (np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) & 1).astype(bool)
            for part, masks in ((fps[~odd], near), (fps[odd], every)):
                if len(part):
                    z = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                    m = np.tile(np.arange(len(masks), dtype=np.int16), len(part))
                    for i in range(0, len(z), 1 << 18):
                        yield pa.RecordBatch.from_arrays([pa.array(z[i : i + (1 << 18)]), pa.array(m[i : i + (1 << 18)])], ["z", "m"])


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links a-b have, as links of each node to its smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _links(batches):
    """Links (a, b) from rows (z, m) that come in the order of z."""
    near, far = flips()
    masks = np.concatenate([near, far])
    rest_z, rest_m = np.empty(0, np.int64), np.empty(0, np.int16)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def met(z, m):
        """Links of whole groups of equal z."""
        new = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
        sizes = np.diff(np.append(new, len(z)))
        several = np.repeat(sizes > 1, sizes)
        if not several.any():
            return None
        group = np.repeat(np.arange(len(new)), sizes)[several]
        z, m = z[several], m[several]
        fp = z.view(np.uint64) ^ masks[m]
        # The smallest near member stands for its group; groups without one link nothing.
        order = np.lexsort((fp, m > 64, group))
        group, fp, m = group[order], fp[order], m[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.flatnonzero(first)[np.cumsum(first) - 1]
        good = (m[at] <= 64) & (fp != fp[at])
        a, b = fp[good], fp[at][good]
        apart = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        return a[apart <= 3].view(np.int64), b[apart <= 3].view(np.int64)

    def passed():
        if held:
            a, b = _roots(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held.clear()
            for i in range(0, len(a), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 18)]), pa.array(b[i : i + (1 << 18)])], ["a", "b"])

    for batch in batches:
        z = np.concatenate([rest_z, batch.column(0).to_numpy(zero_copy_only=False)])
        m = np.concatenate([rest_m, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(z):
            continue
        last = int(np.searchsorted(z, z[-1]))
        rest_z, rest_m = z[last:], m[last:]
        if last and (found := met(z[:last], m[:last])):
            held.append(found)
            count += len(found[0])
            if count > HELD:
                yield from passed()
                count = 0
    if len(rest_z) and (found := met(rest_z, rest_m)):
        held.append(found)
    yield from passed()


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """distinct: one column fp, each value once. Returns (node, component) of linked fingerprints, signed longs."""
    spread = distinct.repartition(parts(distinct.sparkSession))
    variants = spread.mapInArrow(_variants, "z long, m short")
    met = variants.repartition("z").sortWithinPartitions("z")
    return components(met.mapInArrow(_links, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fp (signed long), fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    own = cut(fingerprints(docs, id_col, text_col))
    names = _tops(own)
    names = names.join(names.groupBy("top").agg(F.min("first_id").alias("component_id")), "top").select(F.col("fp").alias("key"), "component_id")
    out = own.join(names, F.col("fp") == F.col("key"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _tops(own: DataFrame) -> DataFrame:
    """(fp, top, first_id): of each fingerprint its component's smallest and its own smallest id."""
    least = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = cut(fingerprint_components(least.select("fp")))
    return least.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("top"), "first_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component that with the smallest id stays; columns as they came.

    Rows are told apart by id and text, so ids that are null or occur several
    times do no harm; of several rows of one id and text one stays.
    """
    own = cut(fingerprints(docs, id_col, text_col, True))
    tops = _tops(own).select(F.col("fp").alias("key"), "top")
    # Null ids come last.
    one = own.join(tops, F.col("fp") == F.col("key")).groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("one"))
    keep = cut(one.select(F.col("one.doc_id").alias("id"), F.col("one.th").alias("hash")))
    again = own.join(keep, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")), "left_semi")
    once = again.groupBy("doc_id", "th").count().filter("count > 1").isEmpty()
    # Names that no column of the caller's has.
    id_, hash_ = unused(docs, "id"), unused(docs, "hash")
    keep = keep.toDF(id_, hash_)
    kept = docs.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (_hash(text_col) == F.col(hash_)), "left_semi")
    return kept if once else kept.withColumn(hash_, _hash(text_col)).dropDuplicates([id_col, hash_]).drop(hash_)
