"""Scoring texts by context-tree weighting.

Bytes (A-Z in lower case) are decomposed into eight binary decisions. Each
decision has a tree over the bytes before it, up to DEPTH deep; every node has
the counts of zeros and ones seen there and the Krichevsky-Trofimov estimate of
them. The probability of a decision mixes the estimates of all depths on the way
from the root, by the weights of context-tree weighting: a node counts itself as
a leaf with weight P_e / (2 P_w). Each text begins after an end mark and ends
with one (a byte that UTF-8 never has), so the model is a proper distribution
over whole texts; its code length per byte is -score / log10(2) / bytes.

The tree is spread over the executors by the TOP nearest bytes of context: a
subtree below such a context needs only the n-grams of that context, at most
2^24 of them at DEPTH. One pass counts the training texts' n-grams, weighs the
subtrees and sums what they hand up; the nodes above, fewer than 65,536 whatever
the corpus, are weighed by the driver and broadcast. A second pass builds the
subtrees again, each beside all n-grams that any text asks of it, and gives each
of those the probability of its last byte, which goes back to the texts. No
n-gram is dropped, and no table of n-grams goes to the driver or to all
executors.

The base score needs every token's count. Texts are dealt to buckets; each
bucket counts its tokens and n-grams, the counts meet by token or n-gram in a
window that has a row for each bucket (a few where a bucket has more than HELD
different ones), and come back to the bucket's texts. So a word as frequent as
any costs no more rows than there are buckets. Tokens are told apart by 63-bit
hashes.

Defined cases: a null text is empty and has the end token alone; held-out
documents are scored and never counted; without training documents every
probability of the model is one half a decision and the base score has V = 0;
repeated rows count and are scored each for itself; null ids hash as empty text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import cut, parts, parts_for

DEPTH = 4
#: Nearest bytes of context by which the tree is spread.
TOP = 2
END = 0xFF
#: Different tokens or n-grams of a partition that are held before they are passed on, and n-grams weighed at a time, about.
HELD, WEIGHED = 2_000_000, 1_000_000
#: Bytes that are counted at a time, and scored.
SLAB, SCORED = 4_000_000, 1_000_000
#: Bytes of text in a bucket, about, where the session's own number of partitions would make larger ones.
BUCKET = 1 << 27
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = bytes.maketrans(b"\t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)


def tokens(text: str | None) -> list[bytes]:
    """The words; the end token is left to the caller."""
    return [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ") if w]


def grams(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The key of each byte and end mark of all texts: nearest context byte first, the byte itself last."""
    lead = bytes([END]) * depth
    raw = np.frombuffer(b"".join(x for t in texts for x in (lead, t, bytes([END]))), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes + depth) - sizes
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    key = np.zeros(len(at), np.uint64)
    for back in range(1, depth + 1):
        key = (key << np.uint64(8)) | raw[at - back]
    return (key << np.uint64(8)) | raw[at]


def _slabs(column, most: int):
    some, size = [], 0
    for text in column:
        some.append(plain(text.as_py()))
        size += len(some[-1]) + 1
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[new], *(np.add.reduceat(v[order], new) if len(keys) else v for v in values))


def _counted(depth: int):
    def count(batches):
        for batch in batches:
            for some in _slabs(batch.column(0), SLAB):
                found, n = np.unique(grams(some, depth), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return count


def _lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x > 0 (Stirling's series from 8 on)."""
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        low[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - low


def _weigh(level: tuple, count: int) -> tuple[list[tuple], tuple]:
    """The levels of ``count`` depths, the least first, and what the depth above gets of them.

    level: nodes (context and bits so far), their ones, all their decisions, and
    the sum of their children's log weighted probabilities (none: they are the
    deepest). A level has the nodes' weight as a leaf in its place.
    """
    levels = []
    for _ in range(count):
        nodes, ones, every, under = level
        own = _lgamma(ones + 0.5) + _lgamma(every - ones + 0.5) - _lgamma(every + 1) - 1.1447298858494002
        if under is None:
            whole, leaf = own, np.ones(len(nodes))
        else:
            high = np.maximum(own, under)
            whole = high + np.log(np.exp(own - high) + np.exp(under - high)) - 0.6931471805599453
            leaf = np.exp(own - whole - 0.6931471805599453)
        levels.insert(0, (nodes, ones, every, leaf))
        # A node's parent lacks the farthest byte, the lowest one of the context.
        level = _sums((nodes >> np.uint64(16) << np.uint64(8)) | (nodes & np.uint64(0xFF)), ones, every, whole)
    return levels, level


class Tree:
    """A weighted tree, or the subtrees of whole contexts of it below given levels.

    levels: per depth nodes, ones, decisions and weight as a leaf. above: what
    the depth over the least one of its own gets of it.
    """

    def __init__(self, found: np.ndarray, n: np.ndarray, depth: int = DEPTH, over: tuple | list = ()):
        """found: keys as of grams(), different; n: their counts; over: the levels above."""
        self.depth = depth
        byte, n = found & np.uint64(0xFF), n.astype(float)
        nodes, ones = [], []
        for k in range(8):
            # Node of k bits: a leading one, then the bits.
            nodes.append((found >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
            ones.append(n * ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(float))
        deepest = _sums(np.concatenate(nodes), np.concatenate(ones), np.tile(n, 8))
        own, self.above = _weigh((*deepest, None), depth - len(over) + 1)
        self.levels = [*over, *own]

    def walk(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key, decision by decision."""
        out = np.zeros(len(keys))
        byte = keys & np.uint64(0xFF)
        for k in range(8):
            bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(float)
            prefix = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
            p = np.full(len(keys), 0.5)
            for d in range(self.depth, -1, -1):
                nodes, ones, every, leaf = self.levels[d]
                if not len(nodes):
                    continue
                node = (keys >> np.uint64(8 * (self.depth - d) + 8) << np.uint64(8)) | prefix
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                seen = nodes[at] == node
                kt = (np.where(bit > 0, ones[at], every[at] - ones[at]) + 0.5) / (every[at] + 1)
                # Below a node never seen all estimates are one half, and so is their mixture.
                p = np.where(seen, leaf[at] * kt + (1 - leaf[at]) * p, p)
            out += np.log10(p)
        return out


class Known:
    """Values of keys by open addressing; every key that is asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        rest, at = np.arange(len(keys)), self._place(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & self.last

    def _place(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        slot = self.slots[at]
        rest = np.flatnonzero((slot < 0) | (self.keys[slot] != keys))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.last
            slot[rest] = self.slots[at[rest]]
            if (slot[rest] < 0).any():
                raise KeyError("an n-gram that was not counted")
            rest = rest[self.keys[slot[rest]] != keys[rest]]
        return self.values[slot]


def _chunks(batches, shift: np.uint64, most: int):
    """Different n-grams and their counts, ascending; a context (an n-gram without its ``shift`` lowest bits) is never cut."""
    parts, size = [], 0

    def apart(keys, n):
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        return keys[new], n[new]

    for batch in batches:
        if batch.num_rows:
            parts.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size >= most:
            keys, n = (np.concatenate(x) for x in zip(*parts))
            end = int(np.searchsorted(keys, keys[-1] >> shift << shift))
            if end:
                yield apart(keys[:end], n[:end])
            parts, size = [(keys[end:], n[end:])], 0
    if parts:
        yield apart(*(np.concatenate(x) for x in zip(*parts)))


def _by_context(counts: DataFrame, shift: int) -> DataFrame:
    """Rows (gram, n), those of a context side by side in one partition, ascending."""
    spread = counts.repartition(parts(counts.sparkSession), F.shiftright("gram", shift))
    return spread.sortWithinPartitions("gram")


def _handed_up(depth: int, top: int):
    def hand(batches):
        for keys, n in _chunks(batches, np.uint64(8 * (depth - top) + 8), WEIGHED):
            nodes, ones, every, under = Tree(keys, n, depth, [()] * top).above
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(ones), pa.array(every), pa.array(under)], ["node", "ones", "every", "below"])

    return hand


def crown(docs: DataFrame, text_col: str = "text", depth: int = DEPTH) -> list[tuple]:
    """The levels of the tree of all texts that lie above the contexts of TOP bytes: fewer than 65,536 nodes."""
    top = min(TOP, depth)
    if not top:
        return []
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(depth), "gram long, n long")
    counts = _by_context(counts.groupBy("gram").agg(F.sum("n").alias("n")), 8 * (depth - top) + 8)
    above = counts.mapInArrow(_handed_up(depth, top), "node long, ones double, every double, below double")
    table = above.groupBy("node").agg(F.sum("ones"), F.sum("every"), F.sum("below")).toArrow()
    nodes, *sums = (c.to_numpy() for c in table.columns)
    return _weigh(_sums(nodes.astype(np.int64).view(np.uint64), *sums), top)[0]


def _weighed(depth: int, over):
    def weigh(batches):
        levels = over.value
        for keys, n in _chunks(batches, np.uint64(8 * (depth - len(levels)) + 8), WEIGHED):
            seen = n > 0
            p = Tree(keys[seen], n[seen], depth, levels).walk(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(p)], ["key", "p"])

    return weigh


def _hash(word: bytes) -> int:
    """A token's number, below zero; those of n-grams are not."""
    return (xxhash.xxh64_intdigest(word) | 1 << 63) - (1 << 64)


def _items(depth: int):
    """Rows (bucket, gram, h, n): each bucket's tokens and n-grams with their training counts; n is 0 for those that only held-out texts have."""

    def rows(bucket, gram, h, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), bucket, np.int64)), pa.array(np.full(len(h), gram)), pa.array(h), pa.array(n)], ["bucket", "gram", "h", "n"])

    def items(batches):
        total: dict = {}  # bucket: its tokens
        found: dict = {}  # bucket: parts of its n-grams
        wait: dict = {}  # bucket and whether held out: texts to be counted
        size = n_words = n_grams = 0

        def count():
            added = 0
            for (bucket, out), texts in wait.items():
                keys, n = np.unique(grams(texts, depth), return_counts=True)
                found.setdefault(bucket, []).append((keys, n * 0 if out else n))
                added += len(keys)
            wait.clear()
            return added

        def meet():
            for bucket, some in found.items():
                found[bucket] = [_sums(*(np.concatenate(x) for x in zip(*some)))]
            return sum(len(x[0][0]) for x in found.values())

        def words():
            for bucket, own in total.items():
                yield rows(bucket, False, np.fromiter(map(_hash, own), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))
            total.clear()

        def contexts():
            for bucket, ((keys, n),) in found.items():
                yield rows(bucket, True, keys.view(np.int64), n)
            found.clear()

        for batch in batches:
            texts, outs, buckets = (batch.column(name) for name in ("text", "held", "bucket"))
            for bucket, text, out in zip(buckets.to_pylist(), texts, outs.to_pylist()):
                raw = plain(text.as_py())
                own, add = total.setdefault(bucket, {}), 0 if out else 1
                n_words -= len(own)
                for w in filter(None, raw.translate(_WORDS).split(b" ")):
                    own[w] = own.get(w, 0) + add
                own[b" "] = own.get(b" ", 0) + add  # the end token; no word has a blank
                n_words += len(own)
                wait.setdefault((bucket, out), []).append(raw)
                size += len(raw) + 1
                if n_words >= HELD:
                    yield from words()
                    n_words = 0
                if size >= SLAB:
                    n_grams, size = n_grams + count(), 0
                    if n_grams >= HELD:
                        n_grams = meet()
                        if n_grams >= HELD:
                            yield from contexts()
                            n_grams = 0
        count()
        meet()
        yield from words()
        yield from contexts()

    return items


class _Logs(dict):
    """Word to its place in logs (of the count and 0.1) and known (count over 0)."""

    def __init__(self, counts: dict[int, float]):
        super().__init__()
        self.counts, self.logs, self.known = counts, [], []

    def __missing__(self, word):
        n = self.counts[_hash(word)]
        self[word] = at = len(self.logs)
        self.logs.append(math.log10(n + 0.1))
        self.known.append(n > 0)
        return at


def _scored(kind, depth: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "own", "first_seen", "score", "n_bytes"]
    kinds = [kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]

    def score(key, docs: pa.Table, counts: pa.Table) -> pa.Table:
        h, v = counts.column("h").to_numpy(), counts.column("v").to_numpy()
        marks = len(np.unique(h[counts.column("mark").to_numpy()]))
        words = _Logs(dict(zip(h[h < 0].tolist(), v[h < 0].tolist())))
        keys, at = np.unique(h[h >= 0], return_index=True)
        model = Known(keys.view(np.uint64), v[h >= 0][at])
        own, n_tokens, n_known, total, n_bytes = [], [], [], [], []
        for some in _slabs(docs.column("text"), SCORED):
            p = model[grams(some, depth)]
            sizes = np.array([len(t) + 1 for t in some])
            total.append(np.add.reduceat(p, np.cumsum(sizes) - sizes))
            n_bytes.append(sizes - 1)
            at = [np.array([words[b" "], *map(words.__getitem__, filter(None, t.translate(_WORDS).split(b" ")))]) for t in some]
            logs, known = np.array(words.logs), np.array(words.known)
            for x in at:
                n_tokens.append(len(x))
                n_known.append(int(known[x].sum()))
                own.append(float(logs[x].sum()))
        first = np.zeros(docs.num_rows, np.int64)
        first[:1] = marks
        cols = [docs.column("doc_id"), docs.column("held"), n_tokens, n_known, own, first, np.concatenate(total) if total else [], np.concatenate(n_bytes) if n_bytes else []]
        return pa.table([pa.chunked_array([pa.array(c, k)]) if not isinstance(c, pa.ChunkedArray) else c.cast(k) for c, k in zip(cols, kinds)], names=names)

    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. depth: 6 at most."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held"))
    over = spark.sparkContext.broadcast(crown(rows.filter(~F.col("held")), "text", depth))
    buckets = parts_for(rows, "text", BUCKET)
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("long")).repartition(buckets, "bucket")
    # All columns go in, and the rows are filtered above the window only: so one exchange of texts and one of counts serve twice.
    counts = salted.mapInArrow(_items(depth), "bucket long, gram boolean, h long, n long")
    by = Window.partitionBy("h")
    counts = counts.select("bucket", "gram", "h", F.sum("n").over(by).alias("c"), (F.col("bucket") == F.min("bucket").over(by)).alias("least"))
    asked = counts.filter(F.col("gram") & F.col("least")).select(F.col("h").alias("gram"), F.col("c").alias("n"))
    logs = _by_context(asked, 8 * (depth - min(TOP, depth)) + 8).mapInArrow(_weighed(depth, over), "key long, p double")
    counts = counts.join(logs, F.col("h") == F.col("key"), "left")
    mark = ~F.col("gram") & (F.col("c") > 0) & F.col("least")
    counts = counts.select("bucket", "h", F.coalesce("p", F.col("c").cast("double")).alias("v"), mark.alias("mark"))
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, own double, first_seen long, score double, n_bytes long"
    own = cut(salted.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_scored(to_arrow_type(kind), depth), schema))
    totals = own.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("first_seen"), F.lit(0)).alias("v"))
    out = own.crossJoin(F.broadcast(totals))  # one row
    base = F.col("own") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.1 * (F.col("v") + 1))
    bits = -F.col("score") / float(np.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", bits.alias("bits_per_byte"))
