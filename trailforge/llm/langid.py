"""Language of words and documents by a linear-chain conditional random field.

The states are the learned languages. A word's features are its affixes (first
and last one to three letters), its letter n-grams (two and three, with word
boundaries) and the word itself, the lexicon; all are hashed into BUCKETS
weights a language. Transitions are learned with them: the training sequences
splice windows of documents of different languages, so the field sees switches.
Weights are fitted by mini-batch gradient steps (AdaGrad) on the log-likelihood
by forward-backward. Only text and lang of training documents are used.

Learning takes a bounded sample, PER_LANG windows a language at most, by the
smallest hashes of the training documents; that bound is a parameter. Prediction
runs forward-backward over every word of every text in the executors. A
document's language has the largest sum of its words' marginals (words with a
letter count by 1 each); score is that sum's share. Words are scored once a
batch, and documents of similar length run through the recursion together.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties
go to the first language by code point; null languages are never learned; where
nothing can be learned every prediction is ``und``; repeated rows get equal
results each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Windows of training text a language, and words a window.
PER_LANG, WINDOW = 400, 60
EPOCHS, RATE = 4, 0.3
#: Word-steps that run through the recursion together, with so many languages at most; fewer with more.
STEPS, STATES = 400_000, 64
#: Letters of the words that are scored together.
LETTERS = 400_000
UNKNOWN = "und"
_TOKEN = re.compile(r"[^ \t-\r]+")


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class _Buckets(dict):
    """Feature to bucket; remembers them, which are mostly few short strings."""

    def __missing__(self, feature):
        if len(self) > 200_000:
            self.clear()
        self[feature] = h = _bucket(feature)
        return h


def _bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS


_BUCKETS = _Buckets()


def features(word: str) -> list[int]:
    """The buckets of a word's features; none for a word without a letter."""
    w = word.lower()
    if not w.isalpha():
        w = "".join(c for c in w if c.isalpha())
        if not w:
            return []
    b = f"^{w}$"
    n = len(b)
    found = [b[i : i + 2] for i in range(n - 1)]
    found += [b[i : i + 3] for i in range(n - 2)]
    # Affixes carry the signs of both, so that none is like an n-gram.
    found += ["<" + w[:1], "<" + w[:2], "<" + w[:3], ">" + w[-1:], ">" + w[-2:], ">" + w[-3:]]
    out = list(map(_BUCKETS.__getitem__, found))
    out.append(_bucket("=" + w))
    return out


class Words(dict):
    """Words by number, with the emission scores of each."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.fresh: list[str] = []
        self.scores, self.letter = np.zeros((0, weights.shape[1])), np.zeros(0, bool)

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The scores of all words, and which have a letter."""
        parts = [self.scores]
        # Words may be whole paragraphs in scripts without blanks.
        slab = np.cumsum([len(w) for w in self.fresh], dtype=np.int64) // LETTERS
        edges = [0, *(np.flatnonzero(np.diff(slab)) + 1).tolist(), len(self.fresh)] if self.fresh else []
        for k, end in zip(edges, edges[1:]):
            found = [features(w) for w in self.fresh[k:end]]
            sizes = np.array([len(f) for f in found])
            flat = np.array([x for f in found for x in f], np.int64)
            own = np.zeros((len(found), self.weights.shape[1]))
            some = np.flatnonzero(sizes)
            if len(some):
                own[some] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[some], axis=0) / np.sqrt(sizes[some])[:, None]
            parts.append(own)
            self.letter = np.concatenate([self.letter, sizes > 0])
        self.fresh = []
        if len(parts) > 1:
            self.scores = np.concatenate(parts)
        return self.scores, self.letter


def _normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = x.sum(axis=1, keepdims=True)
    return x / total, total[:, 0]


def marginals(emit: np.ndarray, mask: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Forward-backward over sequences side by side.

    emit: (sequences, steps, states) scores; mask: which steps are there, from
    the first on; start and move: scores. Returns the marginals and, if asked
    for, the expected moves and the log-partition of each sequence.
    """
    n, t, s = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    m = np.exp(move)
    fwd, scale = np.empty((n, t, s)), np.ones((n, t))
    fwd[:, 0], scale[:, 0] = _normal(e[:, 0] * np.exp(start))
    for k in range(1, t):
        new, total = _normal((fwd[:, k - 1] @ m) * e[:, k])
        on = mask[:, k]
        fwd[:, k] = np.where(on[:, None], new, fwd[:, k - 1])
        scale[:, k] = np.where(on, total, 1)
    back = np.ones((n, s))
    out = np.empty((n, t, s))
    expected = np.zeros((s, s))
    for k in range(t - 1, -1, -1):
        out[:, k] = _normal(fwd[:, k] * back)[0]
        if k:
            ahead = e[:, k] * back / scale[:, k][:, None]
            on = mask[:, k]
            if pairs:
                both = fwd[:, k - 1][:, :, None] * m[None] * ahead[:, None, :]
                expected += both[on].sum(axis=0)
            back = np.where(on[:, None], ahead @ m.T, back)
    if not pairs:
        return out
    logs = (np.log(scale) + np.where(mask, top[:, :, 0], 0)).sum(axis=1)
    return out, expected, logs


def fit(windows: list[tuple[list[str], int]], n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, start and move from windows of words with their language's number."""
    rng = np.random.default_rng(seed)
    weights, start, move = np.zeros((BUCKETS, n)), np.zeros(n), np.zeros((n, n))
    sums = [np.full(x.shape, 1e-8) for x in (weights, start, move)]
    # Spliced sequences: the windows of two in three keep their language, the others switch in the middle.
    order = rng.permutation(len(windows))
    sequences = []
    for k, i in enumerate(order):
        words, lang = windows[i]
        if k % 3 == 0 and k + 1 < len(order):
            other, second = windows[order[k + 1]]
            cut = int(rng.integers(1, max(2, len(words))))
            rest = other[: max(1, WINDOW - cut)]
            sequences.append((words[:cut] + rest, [lang] * len(words[:cut]) + [second] * len(rest)))
        else:
            sequences.append((words, [lang] * len(words)))
    ids: dict[str, int] = {}
    feats: list[list[int]] = []
    coded = []
    for words, langs in sequences:
        row = []
        for w in words:
            if w not in ids:
                ids[w] = len(feats)
                feats.append(features(w))
            row.append(ids[w])
        coded.append((row, langs))
    sizes = np.array([len(f) for f in feats])
    flat = np.array([x for f in feats for x in f], np.int64)
    first = np.cumsum(sizes) - sizes
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(coded))
        for k in range(0, len(shuffled), 32):
            some = [coded[i] for i in shuffled[k : k + 32]]
            t = max(len(r) for r, _ in some)
            mask = np.zeros((len(some), t), bool)
            word, gold = np.zeros((len(some), t), np.int64), np.zeros((len(some), t), np.int64)
            for j, (r, langs) in enumerate(some):
                mask[j, : len(r)], word[j, : len(r)], gold[j, : len(r)] = True, r, langs
            used, back = np.unique(word[mask], return_inverse=True)
            size = sizes[used]
            places = flat[np.repeat(first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            owner = np.repeat(np.arange(len(used)), size)
            norm = 1 / np.sqrt(np.maximum(size, 1))
            scores = np.zeros((len(used), n))
            np.add.at(scores, owner, weights[places])
            scores *= norm[:, None]
            emit = np.zeros((len(some), t, n))
            emit[mask] = scores[back]
            belief, expected, _ = marginals(emit, mask, start, move, True)
            truth = np.eye(n)[gold]
            gap = (truth - belief)[mask]
            by_word = np.zeros((len(used), n))
            np.add.at(by_word, back, gap)
            g_weights = np.zeros((len(places), n))
            g_weights += (by_word * norm[:, None])[owner]
            seen = np.zeros((n, n))
            on = mask[:, 1:]
            np.add.at(seen, (gold[:, :-1][on], gold[:, 1:][on]), 1)
            touched, inv = np.unique(places, return_inverse=True)
            total = np.zeros((len(touched), n))
            np.add.at(total, inv, g_weights)
            total /= len(some)
            sums[0][touched] += total**2
            weights[touched] += RATE * total / np.sqrt(sums[0][touched])
            for x, s, g in ((start, sums[1], (truth - belief)[:, 0].mean(axis=0)), (move, sums[2], (seen - expected) / len(some))):
                s += g**2
                x += RATE * g / np.sqrt(s)
    return weights, start, move


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> tuple[list[str], tuple | None]:
    """The languages, ascending, and the fitted field; from ``per_lang`` training documents a language at most."""
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = train.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return [], None
    # The smallest hashes of each language; min_by keeps so many in the partial sums, never a group.
    drawn = train.withColumn("r", F.xxhash64("id", F.lit("sample")))
    share = {r["lang"]: min(1.0, 2.0 * per_lang / r["count"]) for r in counts}
    bound = F.create_map(*[F.lit(x) for k in langs for x in (k, int(-(2**63) + min(share[k] * 2**64, 2**64 - 2)))])
    drawn = drawn.filter(F.col("r") <= F.element_at(bound, F.col("lang")))
    # A window of words from a hashed place of each text.
    tokens = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    drawn = drawn.select("lang", "r", tokens.alias("w")).filter(F.size("w") > 0)
    drawn = drawn.select("lang", "r", F.slice("w", F.pmod(F.xxhash64("r"), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))).cast("int") + 1, F.lit(WINDOW)).alias("w"))
    # Rows of one id are one row here, so repeated rows can't outgrow the bound.
    drawn = drawn.groupBy("lang", "r").agg(F.min("w").alias("w"))
    rows = sorted((r["lang"], r["r"], r["w"]) for r in drawn.collect())
    windows, taken = [], dict.fromkeys(langs, 0)
    for lang, _, w in rows:
        if taken[lang] < per_lang:
            taken[lang] += 1
            windows.append((w, langs.index(lang)))
    return langs, fit(windows, len(langs))


_MODELS: dict = {}


def _predicted(shared, name: str, kind: pa.DataType):
    names = ["doc_id", "held_out", "lang_pred", "score", "switches"]
    kinds = [kind, pa.bool_(), pa.string(), pa.float64(), pa.int64()]

    def predict(batches):
        langs, model = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score, switches = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
            if model is not None:
                weights, start, move = model
                if _MODELS.get("name") != name or len(_MODELS["words"]) > 600_000:
                    _MODELS.update(name=name, words=Words(weights))
                words = _MODELS["words"]
                # Numbers of the words that have a letter; others carry nothing.
                coded = []
                for text in batch.column(1):
                    found = _TOKEN.findall(text.as_py() or "")
                    coded.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                table, letter = words.table()
                coded = [row[letter[row]] for row in coded]
                order = sorted((k for k in range(n) if len(coded[k])), key=lambda k: len(coded[k]))
                while order:
                    # The longest documents first; as many as fit.
                    longest = len(coded[order[-1]])
                    some = order[-max(1, STEPS * STATES // max(STATES, len(langs)) // longest) :]
                    del order[len(order) - len(some) :]
                    _run([coded[k] for k in some], some, table, start, move, langs, pred, score, switches)
            out = [batch.column(0), batch.column(2), pa.array(pred), pa.array(score), pa.array(switches)]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(out, kinds)], names)

    return predict


def _run(rows, at, table, start, move, langs, pred, score, switches):
    """Marginals of some documents; their languages into pred, score and switches."""
    t = max(map(len, rows))
    mask = np.zeros((len(rows), t), bool)
    word = np.zeros((len(rows), t), np.int64)
    for j, r in enumerate(rows):
        mask[j, : len(r)], word[j, : len(r)] = True, r
    emit = np.where(mask[:, :, None], table[word], 0.0)
    belief = marginals(emit, mask, start, move)
    total = (belief * mask[:, :, None]).sum(axis=1)
    best = total.argmax(axis=1)
    label = belief.argmax(axis=2)
    changed = ((label[:, 1:] != label[:, :-1]) & mask[:, 1:]).sum(axis=1)
    for j, k in enumerate(at):
        pred[k] = langs[best[j]]
        score[k] = min(1.0, float(total[j, best[j]] / len(rows[j])))
        switches[k] = int(changed[j])


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, switches (changes of language from word to word)."""
    import uuid

    from pyspark.sql.pandas.types import to_arrow_type

    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, per_lang))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(_predicted(shared, uuid.uuid4().hex, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, held_out boolean, lang_pred string, score double, switches long")
