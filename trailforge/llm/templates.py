"""Line dedup by a log-template tree.

Lines are parsed by a tree of fixed depth: number of tokens, then the first LEAD
tokens, fields with digits being variable (<*>) from the start. In a leaf, a
token that fewer than FEW different lines have at its place is variable too, so
long as the line keeps LIKE of its tokens. Templates that recur across documents
are dropped from all of them.

Copies of a document are not other documents: were they counted, every line of a
copied text would recur and the text vanish. So a template is counted once for
each group of near copies that has it, and recurs if FEW groups or more do.
Equal texts are one. Others are grouped by sketches, each of the two smallest of
some of a document's hashed shingles. Shingles that FEW different texts have say
nothing of whose copy a text is, so a document with a part of its own is sketched
by its other shingles; only one that has none, but for scattered edits, is
sketched by all. A part of its own is a run of RUN such shingles, in all OWN of
the document, or scattered ones that are SCATTERED of it.

Counts, leaves and templates are aggregates by hash with partial sums; a
template's identity is a sum of hashes of its constant tokens, so no leaf is ever
gathered in a task. The documents meet the lines that they lose by one join on
the id. What is broadcast are numbers, MANY at most, beside which a join stands.

Defined cases: a null text counts as empty and stays as it is (null); lines
without a token are kept and not counted; a line whose template has no constant
token with a letter is kept; repeated rows count as copies; an empty table gives
an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import cut, unused
from trailforge.llm.components import components

LEAD = 3
FEW = 5
LIKE = 0.8
#: In lines of fewer tokens, one variable field would leave less than LIKE.
SHORTEST = 5
#: Words of a sketch's shingles.
SHINGLE = 3

_DIGIT = re.compile(r"[0-9]")
_WEAK = np.uint64(0xFF51AFD7ED558CCD)
#: Sketches of a document, and of its smallest hashes those that they are taken from.
SKETCHES, SMALLEST = 4, 64
#: Shingles in a row that no edit of one or two words makes (it makes three to five), the share of them, and that of any.
RUN, OWN, SCATTERED = 6, 0.1, 0.25
WILD = "<*>"


def parsed(line: str) -> tuple[int, int, list[str]] | None:
    """A line's leaf, its hash with variable fields masked, and its tokens; None if it can't be a template."""
    tokens = line.split()
    if not tokens:
        return None
    if _DIGIT.search(line):
        tokens = [WILD if _DIGIT.search(t) else t for t in tokens]
    if not tokens[0][0].isalpha() and not any(t != WILD and any(map(str.isalpha, t)) for t in tokens):
        return None
    leaf = xxhash.xxh64_intdigest(f"{len(tokens)} {' '.join(tokens[:LEAD])}".encode("utf-8", "surrogatepass"))
    return leaf, xxhash.xxh64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass"), 1), tokens


class _Numbers(dict):
    """Word to hash; the worker remembers some."""

    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_NUMBERS = _Numbers()
_number = _NUMBERS.__getitem__


_RANDOM = np.random.default_rng(20)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OF_BYTE = np.where(_BLANK, 0, _RANDOM.integers(0, 2**64, 256, np.uint64)).astype(np.uint64)
_AT_PLACE = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text, from its bytes and their places, without a step for every word."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[b]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(b) else np.empty(0, np.int64)
    if not len(start):
        return np.empty(0, np.uint64)
    b = b[start[0] :]
    start = start - start[0]
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    return np.add.reduceat(_OF_BYTE[b] * _AT_PLACE[np.minimum(place, 63)], start)


def smallest(text: str) -> np.ndarray:
    """The smallest of a text's shingle hashes, each once, in the order of the text."""
    h = word_hashes(text)
    if not len(h):
        return h
    mixed = h[: max(1, len(h) - SHINGLE + 1)].copy()
    if len(h) > SHINGLE:
        for k in range(1, SHINGLE):
            mixed *= np.uint64(0x100000001B3)
            mixed += h[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _WEAK
    if len(mixed) > 2 * SMALLEST:
        mixed = mixed[np.sort(np.argpartition(mixed, SMALLEST)[:SMALLEST])]
    return mixed[np.sort(np.unique(mixed, return_index=True)[1])]


def own_part(low: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of a text's smallest hashes those that are not common; all of them if those are scattered edits only."""
    own = ~np.isin(low, common)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
    runs = edge[1::2] - edge[::2]
    if runs[runs >= RUN].sum() >= max(OWN * len(low), 1) or own.sum() >= max(SCATTERED * len(low), 1):
        return low[own]
    return low


def sketch(text: str) -> list[int]:
    """Some numbers, each made of two of the text's smallest shingle hashes; the hashes' middle bits part them.

    An edit of a few words leaves most of the numbers as they were.
    """
    return _sketch(smallest(text))


def _sketch(hashes: np.ndarray) -> list[int]:
    if not len(hashes):
        return [0] * SKETCHES
    low = np.sort(hashes).tolist()
    out = []
    for k in range(SKETCHES):
        # The top bits order the hashes, so the classes come from bits in the middle.
        own = [x for x in low if (x >> 20) % SKETCHES == k] or low
        out.append((own[0] * 31 + own[min(1, len(own) - 1)]) % (1 << 64))
    return out


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _lines(batches):
    """Per document: its id, a hash of its text, its smallest shingle hashes and, each once, leaf and hash of its lines."""
    kind = pa.list_(pa.int64())
    for batch in batches:
        whole, low, leaves, hashes = [], [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            found = {p[1]: p[0] for line in text.split("\n") if (p := parsed(line))}
            whole.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
            low.append(smallest(text).view(np.int64))
            leaves.append(_signed(list(found.values())))
            hashes.append(_signed(list(found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_signed(whole)), pa.array(low, kind), pa.array(leaves, kind), pa.array(hashes, kind)], ["i", "jvm", "whole", "low", "leaves", "hashes"])


def _sketches(batches):
    """Rows (key, s) from rows (key, smallest hashes, common ones of them)."""
    for batch in batches:
        keys, out = [], []
        for key, low, common in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            # values of a list scalar are null where the list is
            common = common.values.to_numpy() if common.is_valid else np.empty(0, np.int64)
            found = set(_sketch(own_part(low.values.to_numpy().view(np.uint64), common.view(np.uint64))))
            keys.extend([key] * len(found))
            out.extend(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(_signed(out))], ["key", "s"])


#: Lines that a task remembers, and tokens that it hands on at once.
_SEEN, _PORTION = 1_000_000, 1 << 20
_FIELDS = "leaf long, th long, ks array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _WEAK
    return x ^ (x >> np.uint64(29))


def _tokens(wanted):
    """Rows (leaf, th, ks) for the lines of wanted leaves (None: of all), as a rule each once a task; ks: a hash of leaf, place and token for every token."""

    def rows(batches):
        wanted_ = None if wanted is None else set(wanted.value.tolist())
        seen = set()

        def portion():
            n = np.array(sizes, np.int64)
            leaf = np.repeat(np.array(leaves, np.uint64), n)
            place = (np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
            ks = _mixed(leaf ^ _mixed(np.array(tokens, np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ks.view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(_signed(leaves)), pa.array(_signed(lines)), lists], ["leaf", "th", "ks"])

        for batch in batches:
            leaves, lines, sizes, tokens = [], [], [], []
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if line.count(" ") < SHORTEST - 1 and len(line.split()) < SHORTEST:
                        continue
                    p = parsed(line)
                    if p and len(p[2]) >= SHORTEST and (wanted_ is None or p[0] in wanted_) and p[1] not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(p[1])
                        leaves.append(p[0])
                        lines.append(p[1])
                        sizes.append(len(p[2]))
                        tokens.extend(map(_number, p[2]))
                        if len(tokens) >= _PORTION:
                            yield portion()
                            leaves, lines, sizes, tokens = [], [], [], []
            yield portion()

    return rows


def _counted(batches):
    """Rows (k, kinds): how many lines of a batch have each number."""
    for batch in batches:
        k, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["k", "kinds"])


def _shaped(shared):
    """Rows (leaf, th, shape): the sum of a line's constant numbers, where LIKE of its tokens are constant; shared: the constant ones, ascending."""

    def rows(batches):
        for batch in batches:
            k, n = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            if not len(n) or not len(shared.value):
                continue
            own = shared.value[np.minimum(np.searchsorted(shared.value, k), len(shared.value) - 1)] == k
            first = np.cumsum(n) - n
            fixed, shape = np.add.reduceat(own.astype(np.int64), first), np.add.reduceat(np.where(own, k >> 20, 0), first)
            like = pa.array(fixed >= LIKE * n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(like), batch.column(1).filter(like), pa.array(shape).filter(like)], ["leaf", "th", "shape"])

    return rows


def _jvm_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: i (its id), key (a number), two hashes of its text (Spark's: jvm), smallest shingle hashes, leaves and hashes of its lines."""
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text"), _jvm_hash(text_col).alias("jvm"))
    kind = docs.schema[id_col].dataType.simpleString()
    return cut(own.mapInArrow(_lines, f"i {kind}, jvm long, whole long, low array<long>, leaves array<long>, hashes array<long>").withColumn("key", F.monotonically_increasing_id()))


def recurring(docs: DataFrame, per: DataFrame, text_col: str = "text", few: int = FEW) -> DataFrame:
    """(th): hashes of the masked lines whose template recurs across documents; per: the documents parsed."""
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    # Equal texts have equal lines, so one of them is enough.
    first = per.join(per.groupBy("whole").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    flat = cut(first.select("key", F.explode(F.arrays_zip("leaves", "hashes")).alias("x")).select("key", F.col("x.leaves").alias("leaf"), F.col("x.hashes").alias("th")))
    # What no FEW texts have can't recur; the groups of documents that have nothing else do not matter.
    lines = cut(flat.groupBy("leaf", "th").agg(F.count(F.lit(1)).alias("docs")))
    wide = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") >= few)
    able = lines.join(wide, "leaf", "left").filter((F.col("docs") >= few) | F.col("kinds").isNotNull()).select("leaf", "th")
    able = cut(flat.join(able, ["leaf", "th"], "left_semi"))
    said = groups(first.join(able.select("key").distinct(), "key", "left_semi"), few)
    said = cut(able.join(said, "key").select("leaf", "th", "voice").distinct())
    exact = said.groupBy("th").agg(F.count(F.lit(1)).alias("voices")).filter(F.col("voices") >= few).select("th")
    # Leaves whose lines recur only together: there, rare tokens are variable.
    leaves = said.select("leaf", "voice").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("voices")).filter(F.col("voices") >= few)
    made = generalised(text, cut(leaves.join(wide, "leaf", "left_semi").select("leaf")), said, few)
    return exact.unionByName(made).distinct() if made is not None else exact.distinct()


def groups(per: DataFrame, few: int = FEW) -> DataFrame:
    """(key, voice): the group of near copies that each document is in, by its smallest key."""
    own = cut(per.select("key", "low"))
    flat = own.select("key", F.explode("low").alias("h"))
    common = flat.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= few).select("h")
    common = flat.join(common, "h", "left_semi").groupBy("key").agg(F.collect_list("h").alias("common"))
    sketches = cut(own.join(common, "key", "left").select("key", "low", "common").mapInArrow(_sketches, "key long, s long"))
    met = sketches.groupBy("s").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = sketches.join(met, "s").filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    linked = components(links)
    return own.select("key").join(linked, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("voice"))


#: Leaves, and constant tokens of leaves, that are sent to all executors at most (8 bytes each); more are met by a join, with the same result.
MANY = 1_000_000


def generalised(text: DataFrame, leaves: DataFrame, said: DataFrame, few: int) -> DataFrame | None:
    """(th) of lines whose template, rare tokens being variable, recurs."""
    n = leaves.count()
    if not n:
        return None
    sc = text.sparkSession.sparkContext
    if n <= MANY:
        wanted = sc.broadcast(_unsigned(leaves))
        lines = text.mapInArrow(_tokens(wanted), _FIELDS)
    else:
        lines = text.mapInArrow(_tokens(None), _FIELDS).join(leaves, "leaf", "left_semi")
    # A line is a row with its tokens' numbers, once; what is counted are sums a batch, not a row a token.
    lines = cut(lines.dropDuplicates(["leaf", "th"]))
    counts = lines.select("ks").mapInArrow(_counted, "k long, kinds long").groupBy("k").agg(F.sum("kinds").alias("kinds"))
    keys = cut(counts.filter(F.col("kinds") >= few).select("k"))
    if keys.count() <= MANY:
        shapes = lines.mapInArrow(_shaped(sc.broadcast(np.sort(_unsigned(keys).view(np.int64)))), "leaf long, th long, shape long")
    else:
        constant = lines.select("leaf", "th", F.size("ks").alias("n"), F.explode("ks").alias("k")).join(keys, "k", "left_semi")
        shapes = constant.groupBy("leaf", "th", "n").agg(F.sum(F.shiftright("k", 20)).alias("shape"), F.count(F.lit(1)).alias("fixed")).filter(F.col("fixed") >= LIKE * F.col("n"))
    voices = shapes.join(said, ["leaf", "th"]).select("leaf", "shape", "voice").distinct()
    often = voices.groupBy("leaf", "shape").agg(F.count(F.lit(1)).alias("voices")).filter(F.col("voices") >= few)
    return shapes.join(often, ["leaf", "shape"], "left_semi").select("th")


def _unsigned(leaves: DataFrame) -> np.ndarray:
    return np.array([r[0] for r in leaves.collect()], np.int64).view(np.uint64)


def _dropped(names: list[str], text_at: int, length_at: int | None):
    """Documents without the lines whose hash is in the last column; then the numbers of lines and of dropped ones."""

    def drop(batches):
        for batch in batches:
            texts, totals, gone = batch.column(text_at).to_pylist(), [], []
            for k, (text, lost) in enumerate(zip(texts, batch.column(batch.num_columns - 1))):
                lost = lost.as_py()
                if not lost:
                    totals.append(text.count("\n") + 1 if text else 0)
                    gone.append(0)
                    continue
                out = set(_signed_back(lost))
                lines = text.split("\n")
                kept = [x for x in lines if not ((p := parsed(x)) and p[1] in out)]
                totals.append(len(lines))
                gone.append(len(lines) - len(kept))
                texts[k] = "\n".join(kept)
            cols = list(batch.columns[:-1])
            cols[text_at] = pa.array(texts, pa.string())
            if length_at is not None:
                cols[length_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[length_at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names)

    return drop


def _signed_back(values) -> list[int]:
    return np.array(values, np.int64).view(np.uint64).tolist()


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", few: int = FEW, counts: tuple[str, str] | None = ("__lines", "__dropped"), emptied: bool = True) -> DataFrame:
    """The documents without recurring lines, columns as they came, and the numbers of lines and of dropped ones.

    counts: the names of those two columns, which replace columns of the same
    names; None: without them. emptied: whether documents stay that lose every word.
    """
    from pyspark.sql import types as T

    per = parse(docs, id_col, text_col)
    often = recurring(docs, per, text_col, few)
    flat = per.select("i", "jvm", F.explode("hashes").alias("th")).join(often, "th", "left_semi")
    # Rows are told apart by id and text, so null ids do not meet in one group.
    lost = flat.groupBy("i", "jvm").agg(F.collect_set("th").alias("lost"))
    id_, hash_, lost_, lines_, gone_ = (unused(docs, x) for x in ("i", "jvm", "lost", "lines", "gone"))
    lost = lost.toDF(id_, hash_, lost_)
    joined = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    joined = joined.join(lost, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (_jvm_hash(text_col) == F.col(hash_)), "left")
    names = docs.columns
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(lines_, T.LongType()), T.StructField(gone_, T.LongType())])
    length_at = names.index(length_col) if length_col in names else None
    out = joined.select(*[F.col(f"`{c}`") for c in names], lost_).mapInArrow(_dropped([*names, lines_, gone_], names.index(text_col), length_at), schema)
    if not emptied:
        out = out.filter((F.col(gone_) == 0) | F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"))
    named = dict(zip(counts, (lines_, gone_))) if counts else {}
    return out.select(*[F.col(f"`{c}`") for c in names if c not in named], *[F.col(v).alias(k) for k, v in named.items()])
