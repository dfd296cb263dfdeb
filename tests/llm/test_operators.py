"""Each operator on odd inputs and against a brute-force version on a small fixture."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailforge.llm import bitplanes, common, components, ctw, langid, lzprint, mixing, packing, privacy, quality, simhash, templates
from trailforge.llm.registry import tokenizer
from trailforge.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


#: Every short name that the operators' code has in quotes: all columns that they make inside are among them.
INSIDE = sorted({n for f in Path(common.__file__).parent.glob("*.py") for n in re.findall(r"[\"']([A-Za-z_][A-Za-z0-9_]{0,15})[\"']", f.read_text())} - {"doc_id", "text", "lang", "source", "n_chars"})
INSIDE = [n for k, n in enumerate(INSIDE) if n.lower() not in {m.lower() for m in INSIDE[:k]}]


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    return df.select("*", *[F.lit(n).alias(n) for n in INSIDE])


# 1. quality rules


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(frame, odd):
    texts = ["a b c d e a b c d e", "a b c d e f a b c d e f g", "x\ny\nx\n\n\nx", "#a *b $c | <d> &e %f", "a  b\tc\x0bd\x0ce\rf", "Ä ö 𝔘   x", "a a a a a a a a", "p q r s t u v p q r s t w q r s t w"]
    docs = frame([(i, t) for i, t in enumerate(texts)])
    got = {r[0]: r[1:] for r in rows_of(quality.measure(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    for r in quality.measure(clashing(odd)).collect():
        assert r.kept is False or (not r.base_failed and r.lost_share <= 0.5)
    assert quality.measure(odd.limit(0)).count() == 0


PROSE = "The quick brown fox jumps over the lazy dog and runs on, far away from here."


@pytest.mark.parametrize(
    ("line", "rule"),
    [(PROSE, None), ("", None), ("All rights reserved.", "boilerplate"), ("home | about | news | contact", "navigation"), ("Read more", "navigation"), ("*** a$$$ b%%% c###", "punctuation"), ("BUY!! NOW!! CHEAP!!", "punctuation"), ("THIS WHOLE LINE IS SHOUTED AT THE READER WITHOUT A REASON.", "punctuation"), ("words and words and words without an end or sign", "punctuation")],
)
def test_line_rules(spark, line, rule):
    assert spark.createDataFrame([(line,)], "l string").select(quality.failed_rule(F.col("l"))).first()[0] == rule


@pytest.mark.parametrize(
    ("line", "rule"),
    [(f"{PROSE} " * 5 + "This text is licensed under the terms below.", "boilerplate"), (f"{'x' * 320}. Read more", "navigation"), ("WE ALL SHOUT THIS WHOLE LINE AT EVERY READER for IT IS OF MUCH WEIGHT TO US.", "punctuation"), ("WE SHOUT SOME OF THIS LINE but not so much of it that nine in ten are capitals.", None)],
)
def test_long_lines_are_judged_too(spark, line, rule):
    assert spark.createDataFrame([(line,)], "l string").select(quality.failed_rule(F.col("l"))).first()[0] == rule


def test_clean_drops_lines_then_documents(frame, odd):
    docs = frame([(1, f"{PROSE}\nAll rights reserved.\n{PROSE[::-1]}."), (2, "home | about | news | contact | imprint | help | more | less | top | end"), (3, PROSE)])
    got = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert set(got) == {1, 3}
    assert got[1].text == f"{PROSE}\n{PROSE[::-1]}." and got[1].n_chars == len(got[1].text)
    kept = quality.clean(clashing(odd))
    assert kept.columns == clashing(odd).columns and all(r[n] == n for r in kept.collect() for n in INSIDE)


# 2. personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = "".join(c for c in m.group() if c.isdigit())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(frame, odd):
    texts = ["a@b.c_d@e.fr x@y", "é 1.2.3.4.5.6.7.8 and 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 or 4111-1111-1111-1112 or 1" * 3, "+1 (555) 123-4567 call + 5 +12 +123456789012345678", "𝔘 a.b@c-d.org, 10.0.0.1; +49 30 1234567", "aaaa" * 50 + "@" + "1." * 40, "5 " * 3000, "1-" * 40, "a@b..c a@b.c. @x.y"]
    rng = np.random.default_rng(3)
    signs = list("0123456789.@+-() ax") + ["1.2.3.4", "a@b.cd", "+1 5", "4111111111111111"]
    texts += ["".join(rng.choice(signs, 60)) for _ in range(150)]
    docs = frame([(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in privacy.digest(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), t
        assert got[i].spans.startswith(base_spans(t))
    assert privacy.digest(clashing(odd)).count() == 10
    # Many spans in one text, more than a block of them.
    many = " ".join(f"a{i}@b{i % 7}.com, Mr. John Smith" for i in range(3000))
    r = privacy.digest(frame([(1, many)])).first()
    assert r.base_sha256 == hashlib.sha256(base_spans(many).encode()).hexdigest() and r.n_email == 3000
    assert all(many[int(s.split(":")[1]) : int(s.split(":")[2])] == "Mr. John Smith" for s in r.spans.split(",") if s.startswith("name"))
    assert privacy.digest(odd.limit(0)).count() == 0


def test_reliabilities_are_found():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right, wrong = [0.9, 0.8, 0.7, 0.85, 0.05], [0.05, 0.1, 0.3, 0.2, 0.5]
    votes = np.array([[rng.random() < (right[k] if t else wrong[k]) for k in range(5)] for t in truth]).astype(int)
    prior, yes, no, label = privacy.reliabilities(Counter(map(tuple, votes.tolist())))
    assert abs(prior - 0.3) < 0.05 and np.allclose(yes, right, atol=0.06) and np.allclose(no, wrong, atol=0.06)


def test_secrets_are_added_and_prose_is_not(frame):
    rng = np.random.default_rng(5)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f"{PROSE} token = \"{key()}\" {PROSE}" if i % 4 == 0 else f"{PROSE} mail me: a{i}@b.com" if i % 4 == 1 else f"{PROSE} order 1{i}.{i}.{i}.999") for i in range(80)]
    rows += [(200 + i, PROSE) for i in range(20)]
    got = {r.doc_id: r.spans for r in privacy.digest(frame(rows)).collect()}
    assert all("secret:" in got[i] for i in range(0, 80, 4))
    assert all(got[200 + i] == "" for i in range(20))


def test_whole_secrets_are_found(frame):
    secrets = ["token=" + "a1" * 150, "0a" * 100, "ghp_" + "aB3" * 12, "AKIA" + "Z9" * 40, "xoxb-" + "1a-" * 10 + "z"]
    rows = [(i, f"{PROSE} {secrets[i % 5]} {PROSE}") for i in range(60)] + [(100 + i, PROSE) for i in range(20)]
    for r in privacy.digest(frame(rows)).collect():
        start = len(PROSE) + 1
        assert r.spans == ("" if r.doc_id >= 100 else f"secret:{start}:{start + len(secrets[r.doc_id % 5])}")


def test_spans_are_found_and_others_left(frame):
    """Recall and precision on planted spans of four languages, among numbers that look alike."""
    rng = np.random.default_rng(22)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    good = [lambda: f"Call ({digits(3)}) 555-{digits(4)} now", lambda: f"Frau Claudia Meier kommt", lambda: f"appel: 01 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", lambda: "Señora Carmen Ruiz dijo", lambda: f"password: {digits(6)}xYz{digits(4)}", lambda: f"ssn 1{digits(2)}-1{digits(1)}-{digits(3)}7"]
    bad = [lambda: f"version {digits(2)}.{digits(1)}.{digits(1)}", lambda: f"page {digits(3)}", lambda: f"in 19{digits(2)}", lambda: f"isbn {digits(3)}-{digits(2)}-{digits(3)}"]
    rows = [(i, f"{PROSE} {(good if i % 2 else bad)[(i // 2) % (6 if i % 2 else 4)]()}. {PROSE}") for i in range(400)]
    got = {r.doc_id: r.n_spans for r in privacy.digest(frame(rows)).collect()}
    hits, wrong = sum(got[i] > 0 for i in range(1, 400, 2)), sum(got[i] > 0 for i in range(0, 400, 2))
    assert hits / 200 >= 0.8 and hits / (hits + wrong) >= 0.95


# 3. mixing


def test_targets_are_capped_and_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    total = 1.5 * 2015
    assert got["a"] == 20.0 and got["b"] <= 2000 and abs(sum(got.values()) - total) < 1e-6
    # By hand: a and null (weight 5) reach their caps of 20 and 10; b and c share the rest 2 to 1, b is capped at 2000.
    assert got[None] == 10.0 and got["b"] == min(2000.0, (total - 30) * 2 / 3)


def test_mix_meets_targets(frame, odd):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 40) if i % 50 else 900), f"s{i % 4}") for i in range(1200)]
    got = mixing.mix(frame(rows)).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 30).all()
    again = mixing.mix(frame(rows[::-1])).toPandas()
    key = lambda d: d.sort_values("doc_id").reset_index(drop=True)[["doc_id", "taken"]]
    assert key(got).equals(key(again))
    assert mixing.mix(clashing(odd)).count() == 10
    assert mixing.mix(odd.limit(0)).count() == 0
    mixed = mixing.apply_mix(clashing(frame(rows)))
    assert mixed.columns == clashing(frame(rows)).columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixed.count() == (got.taken / got["size"]).sum()


def test_documents_enter_by_their_inclusion_probabilities(frame):
    """Many sources of one profile stand for many draws."""
    sizes = [1, 2, 3, 5, 8, 13, 20, 4, 6, 10, 30, 7]
    rows = [(1000 * s + i, "w " * n, f"s{s:04d}") for s in range(900) for i, n in enumerate(sizes)]
    got = mixing.mix(frame(rows)).toPandas()
    got["nth"], got["grp"] = got.doc_id % 1000, got.doc_id // 1000 % 3
    for grp, own in got.groupby("grp"):
        total = sum(sizes)
        mean = own.target.iloc[0] / total
        missing = (mean - math.floor(mean)) * total
        if missing < 1e-6:
            assert (own.copies == round(mean)).all()
            continue
        certain: list[int] = []
        while True:
            rest = [n for k, n in enumerate(sizes) if k not in certain]
            c = (missing - sum(sizes[k] for k in certain)) / sum(n * n for n in rest)
            more = [k for k, n in enumerate(sizes) if k not in certain and c * n > 1]
            if not more:
                break
            certain += more
        p = [1.0 if k in certain else c * n for k, n in enumerate(sizes)]
        # A budget of words in sources as small as these shifts each share a little.
        share = (own.groupby("nth").copies.mean() - math.floor(mean)).to_numpy()
        assert np.abs(share - p).max() < 0.12 and np.corrcoef(share, p)[0, 1] > 0.97
        assert abs((share * sizes).sum() - missing) < 0.05 * total


# 4. context-tree weighting


def brute_tree(texts, depth):
    seen = []
    for t in texts:
        b = bytes([255] * depth) + t + b"\xff"
        seen += [(b[i - depth : i][::-1], b[i]) for i in range(depth, len(b))]

    def counts(ctx, k, prefix):
        out = [0, 0]
        for c, y in seen:
            if c[: len(ctx)] == ctx and y >> (8 - k) == prefix:
                out[y >> (7 - k) & 1] += 1
        return out

    def estimate(a):
        return math.lgamma(a[0] + 0.5) + math.lgamma(a[1] + 0.5) - math.lgamma(sum(a) + 1) - math.log(math.pi)

    def weighted(ctx, k, prefix):
        a = counts(ctx, k, prefix)
        if not sum(a):
            return 0.0
        if len(ctx) == depth:
            return estimate(a)
        children = {c[: len(ctx) + 1] for c, _ in seen if c[: len(ctx)] == ctx}
        return math.log(0.5 * math.exp(estimate(a)) + 0.5 * math.exp(sum(weighted(c, k, prefix) for c in children)))

    def log10(ctx, y):
        total = 0.0
        for k in range(8):
            prefix, bit, p = y >> (8 - k), y >> (7 - k) & 1, 0.5
            for d in range(depth, -1, -1):
                a = counts(ctx[:d], k, prefix)
                if not sum(a):
                    p = 0.5
                    continue
                w = 1.0 if d == depth else 0.5 * math.exp(estimate(a) - weighted(ctx[:d], k, prefix))
                p = w * (a[bit] + 0.5) / (sum(a) + 1) + (1 - w) * p
            total += math.log10(p)
        return total

    return log10


def test_tree_is_context_tree_weighting():
    texts, depth = [b"abracadabra", b"abcab", "été".encode()], 2
    found, n = np.unique(ctw.grams(texts, depth), return_counts=True)
    tree, log10 = ctw.Tree(found, n, depth), brute_tree(texts, depth)
    for t in (b"abra", b"zz\xc3", b""):
        b = bytes([255] * depth) + t + b"\xff"
        want = [log10(b[i - depth : i][::-1], b[i]) for i in range(depth, len(b))]
        assert np.allclose(tree.walk(ctw.grams([t], depth)), want, atol=1e-5)
    assert abs(sum(10 ** log10(b"ba", y) for y in range(256)) - 1) < 1e-9


def test_base_score(frame, odd):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(rng.choice(["A", "bb", "Cc.", "d"], int(rng.integers(0, 30)))) for i in range(120)} | {200: None, 201: ""}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*WORD.findall((t or "").lower()), " "] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in ctw.score(frame(list(texts.items()))).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert ctw.score(clashing(odd)).count() == 10
    assert ctw.score(odd.limit(0)).count() == 0


def test_spread_tree_scores_as_one(frame, monkeypatch):
    """Chunks of a few n-grams, counts passed on early: as one brute-force tree over the training texts."""
    monkeypatch.setattr(ctw, "WEIGHED", 3)
    monkeypatch.setattr(ctw, "HELD", 5)
    monkeypatch.setattr(ctw, "SLAB", 20)
    texts = {i: t for i, t in enumerate(["abracadabra", "abcab", "été", "", None, "Abra ca dabra", "zz\U0001d518", "abc abd abe", "ab", "ab", "cab", "dab"])}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(40)}
    texts = {i: texts[i % 12] for i in out}
    raw = {i: (t or "").lower().encode() for i, t in texts.items()}
    assert any(out.values())
    for depth in (0, 1, 3):
        log10 = brute_tree([raw[i] for i in raw if not out[i]], depth)
        got = {r.doc_id: r.score for r in ctw.score(frame(list(texts.items())), depth=depth).collect()}
        for i in texts:
            b = bytes([255] * depth) + raw[i] + b"\xff"
            want = sum(log10(b[k - depth : k][::-1], b[k]) for k in range(depth, len(b)))
            assert math.isclose(got[i], want, rel_tol=1e-9), (depth, i)


def test_probabilities_of_a_spread_tree_sum_to_one(frame):
    rng = np.random.default_rng(16)
    texts = [bytes(rng.choice(np.frombuffer(b"abc d", np.uint8), 200)) for _ in range(60)]
    over = ctw.crown(frame([(i, t.decode()) for i, t in enumerate(texts)]))
    assert [len(x[0]) for x in over] == [len(x[0]) for x in ctw.Tree(*np.unique(ctw.grams(texts), return_counts=True)).levels[:2]]
    whole = ctw.Tree(*np.unique(ctw.grams(texts), return_counts=True))
    keys = (np.uint64(int.from_bytes(b"ab a", "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    found, n = np.unique(ctw.grams(texts), return_counts=True)
    own = found >> np.uint64(24) == keys[0] >> np.uint64(24)
    part = ctw.Tree(found[own], n[own], ctw.DEPTH, over)
    assert np.allclose(part.walk(keys), whole.walk(keys), atol=1e-12) and abs((10 ** part.walk(keys)).sum() - 1) < 1e-9


# 5. phrases


def test_fingerprints_and_edits(frame, odd):
    texts = [PROSE * 3, "", "ab", PROSE, "é𝔘" * 50, None, PROSE * 3]
    got = {r.doc_id: r for r in lzprint.compare(frame([(10 * i, t) for i, t in enumerate(texts)])).collect()}
    assert got[0].fingerprint == got[60].fingerprint
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r, f = got[10 * i], lzprint.fingerprint
        share = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / lzprint.SLOTS
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f(t), f(edited))
        assert (r.near_edited, r.near_next) == (share(f(t), f(edited)), share(f(t), f(after)))
    assert lzprint.compare(clashing(odd)).count() == 10
    assert lzprint.compare(odd.limit(0)).count() == 0
    lone = lzprint.compare(frame([(1, PROSE)])).first()
    assert lone.near_next == 1.0


def plain_fingerprint(text):
    """Phrases one after another as the longest known one and a sign more; the least hash of each class by hand."""
    phrases, i = [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in phrases:
            j += 1
        phrases.append(text[i:j])
        i = j
    least = [None] * 64
    for p in set(phrases):
        h = xxhash.xxh64(p.encode()).intdigest()
        if least[h % 64] is None or h // 64 < least[h % 64]:
            least[h % 64] = h // 64
    if not phrases:
        return "0000" * 64
    out = []
    for k in range(64):
        away = next(d for d in range(64) if least[(k + d) % 64] is not None)
        out.append((least[(k + away) % 64] + away * 0x9E3779B97F4A7C15) % 2**64 % 65535 + 1)
    return "".join(f"{x:04x}" for x in out)


def test_fingerprints_by_a_plain_parse():
    rng = np.random.default_rng(23)
    for text in ["", "a", "aaaaaaa", "abababab", "é𝔘é𝔘é", PROSE, *("".join(rng.choice(list("abc d"), int(rng.integers(1, 300)))) for _ in range(40))]:
        assert lzprint.fingerprint(text) == plain_fingerprint(text), text


def test_ids_of_any_type(spark):
    texts = [f"text number {i} {'x' * i}" for i in range(90)]
    docs = spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(texts)] + [(None, "none")], "doc_id string, text string")
    got = {r.doc_id: r for r in lzprint.compare(docs).collect()}
    chain = ["none", *texts]
    for i, t in enumerate(chain):
        r = got[None if i == 0 else f"k{i - 1:03d}"]
        after = chain[(i + 1) % len(chain)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (r.fingerprint, r.edited_sha256) == (plain_fingerprint(t), hashlib.sha256(edited.encode()).hexdigest())


def test_likeness_follows_shared_phrases():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    a = " ".join(word() for _ in range(600))
    b = a[:3000] + " ".join(word() for _ in range(200))
    c = " ".join(word() for _ in range(600))
    s = [lzprint.signature(lzprint.least(lzprint.hashes(lzprint.parse(t)[0]))) for t in (a, b, c)]
    assert lzprint.alike(s[0], s[1]) > lzprint.alike(s[0], s[2]) + 0.2


# 6. language

SAMPLES = {"en": "the and with from this that have been would there", "de": "und nicht eine wird auch nach durch über können", "fr": "les des avec pour dans être cette où très leur"}


def test_languages(frame, odd):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        lang = list(SAMPLES)[i % 3]
        rows.append((i, " ".join(rng.choice(SAMPLES[lang].split(), 25)), "a", lang))
    rows += [(900, None, "a", "en"), (901, "12 34 !", "a", "en"), (902, "und nicht", "a", None)]
    got = {r.doc_id: r for r in langid.predict(frame(rows)).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out for r in held) and sum(got[r[0]].lang_pred == r[3] for r in held) / len(held) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(clashing(odd)).count() == 10
    assert langid.predict(odd.limit(0)).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(8)
    emit, start, move = rng.normal(size=(1, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    total, want, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = math.exp(start[path[0]] + sum(emit[0, k, s] for k, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += w
        for k, s in enumerate(path):
            want[k, s] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    belief, expected, logs = langid.marginals(emit, np.ones((1, 4), bool), start, move, True)
    assert np.allclose(belief[0], want / total) and np.allclose(expected, pairs / total) and np.isclose(logs[0], math.log(total))


def test_switched_text_is_labelled_word_by_word():
    windows = [(s.split() * 4, k) for k, s in enumerate(SAMPLES.values()) for _ in range(40)]
    weights, start, move = langid.fit(windows, 3)
    words = langid.Words(weights)
    row = [words[w] for w in "the and with from und nicht eine wird".split()]
    table, _ = words.table()
    label = langid.marginals(table[row][None], np.ones((1, 8), bool), start, move)[0].argmax(axis=1)
    assert label.tolist() == [0] * 4 + [1] * 4


def test_letters_of_long_words_all_count():
    word = "".join(chr(0x4E00 + k) for k in range(300))
    found = set(langid.features(word))
    assert all(langid._bucket(word[k : k + n]) in found for n in (2, 3) for k in range(len(word) - n + 1))
    rng = np.random.default_rng(15)
    words = ["".join(rng.choice(list("abcdefghij"), n)) for n in (1, 5, 90, 2000)] * 3 + ["12"]
    weights = rng.normal(size=(langid.BUCKETS, 3))
    some = [words[k % len(words)] for k in range(700)]
    own = langid.Words(weights)
    own.fresh = list(some)
    table, letter = own.table()
    want = [weights[langid.features(x)].sum(axis=0) / math.sqrt(len(langid.features(x))) if x.isalpha() else np.zeros(3) for x in some]
    assert np.allclose(table, want) and letter.tolist() == [x.isalpha() for x in some]


def test_every_language_is_learned(frame):
    langs = [f"l{k:02d}" for k in range(70)]
    docs = frame([(1000 * k + i, f"{chr(0x4E00 + 40 * k + i)}{chr(0x4E00 + 40 * k)} text", lang, "a", 7) for k, lang in enumerate(langs) for i in range(6)])
    found, model = langid.learn(docs, per_lang=2)
    assert found == langs and model[0].shape[1] == 70


# 7. token files

TEXTS = st.text(alphabet=st.sampled_from(list("ab .,\n\t 'sS1é  ?!́Σ\xa0\x1c\x02|")), max_size=60)


@pytest.fixture(scope="module")
def encoders():
    return Encoder(tokenizer("byte_bpe_50k.json"), True), Encoder(tokenizer("word_bpe_49k.json"), False)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_memo_gives_the_library_ids(encoders, texts):
    for e in encoders:
        for t, ids in zip(texts, e.encode_all(texts)):
            assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_memo_starts_anew():
    e = Encoder(tokenizer("byte_bpe_50k.json"), True, memo=5)
    for t in ["one two three, four. five six", "seven eight\nnine ten", "one two three, four. five six"] * 3:
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
def test_planes_round_trip(ids, bits):
    a = np.array(ids, np.uint32)
    planes = bitplanes.to_planes(a, bits)
    assert planes.shape[0] == (32 if bits else 4)
    if len(a):
        assert bitplanes.from_planes([p.tobytes() for p in planes], len(a), bits).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip(tmp_path, bits):
    from pyarrow import fs

    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 50_257, int(n)).astype(np.uint32) for n in (1, 0, 300, 5, 1000, 64)]
    local = fs.LocalFileSystem()
    with local.open_output_stream(str(tmp_path / "x")) as out:
        w = bitplanes.Writer(out, bits, block=128)
        for d in docs:
            w.add(d)
        w.close(pa.table({"doc_id": list(range(6)), "n": [len(d) for d in docs]}))
    with local.open_input_file(str(tmp_path / "x")) as file:
        r = bitplanes.Reader(file)
        assert [x.tolist() for x in r.each()] == [d.tolist() for d in docs]
        assert len(r.blocks) == math.ceil(sum(map(len, docs)) / 128)
        assert r.block(2).tolist() == np.concatenate(docs)[256:384].tolist()


def test_planes_query(frame, odd):
    e = Encoder(tokenizer("byte_bpe_50k.json"), True)
    docs = [(30, "c d"), (10, None), (20, "Hello, world.\nAgain"), (40, "x" * 500)]
    got = rows_of(bitplanes.round_trip(frame(docs), tokenizer("byte_bpe_50k.json")).orderBy("doc_id"), "doc_id", "start", "n_tokens", "ids_crc32")
    start, want = 0, []
    for i, t in sorted(docs):
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert bitplanes.round_trip(clashing(odd), tokenizer("byte_bpe_50k.json")).count() == 10
    assert bitplanes.round_trip(odd.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


# 8. templates


def test_recurring_templates_go(frame):
    rng = np.random.default_rng(10)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30)) + "."
    rows = []
    for i in range(40):
        lines = [prose(), f"Copyright 20{i:02d} by the press.", prose(), f"Written on a day in may by our own writer {chr(97 + i % 26)}{chr(97 + i // 26)} for you"]
        rows.append((i, "\n".join(lines)))
    copied = f"{prose()}\n{prose()}\n{prose()}"
    rows += [(100 + i, copied) for i in range(30)] + [(200 + i, copied.replace(copied.split()[3 + i], "edited", 1)) for i in range(20)]
    got = {r.doc_id: r for r in templates.drop_lines(frame(rows)).collect()}
    assert all(got[i]["__dropped"] == 2 and "Copyright" not in got[i].text and "Written" not in got[i].text for i in range(40))
    assert all(got[i]["__dropped"] == 0 for i in got if i >= 100)
    assert got[0].n_chars == len(got[0].text)


def test_groups_of_copies_keep_no_recurring_line(frame):
    rng = np.random.default_rng(12)
    prose = lambda n=30: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)) + "."
    footer = "This page is brought to you by the society of friends of old maps."
    copied = f"{prose()}\n{prose()}"
    rows = [(i, f"{prose()}\n{footer}") for i in range(10)] + [(100 + i, f"{copied}\n{footer}") for i in range(200)]
    # Documents that consist mostly of a passage that they share.
    passage = f"{prose(25)}\n{prose(25)}"
    rows += [(400 + i, f"{passage}\n{prose(8)}") for i in range(12)]
    got = {r.doc_id: r for r in templates.drop_lines(frame(rows)).collect()}
    assert all(got[i]["__dropped"] == 1 and footer not in got[i].text for i in got if i < 400)
    assert all(got[100 + i].text == copied for i in range(200))
    assert all(got[400 + i]["__dropped"] == 2 and len(got[400 + i].text.split()) == 8 for i in range(12))


def test_short_templates_have_variable_fields(frame):
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
    rows = [(i, "\n".join([" ".join(word() for _ in range(30)) + ".", f"Told again by {word()}", f"This story was written by {word()}", f"See the notes of {word()} on this", f"Not by {word()} {word()} {word()}"])) for i in range(12)]
    got = templates.drop_lines(frame(rows)).collect()
    assert all(r["__dropped"] == 2 and [len(x.split()) for x in r.text.split("\n")] == [30, 4, 5] for r in got)
    rows = [(i, f"{' '.join(word() for _ in range(30))}.\nAnd all told by {word()}") for i in range(12)]
    assert all(r["__dropped"] == 1 for r in templates.drop_lines(frame(rows)).collect())


def brute_templates(texts):
    """Which lines go, every text being a group of its own."""

    def masked(line):
        t = ["<*>" if re.search("[0-9]", x) else x for x in line.split()]
        return tuple(t) if any(any(c.isalpha() for c in x) for x in t if x != "<*>") else None

    leaf = lambda t: (len(t), t[:3])
    has = {}
    for i, text in enumerate(texts):
        for line in text.split("\n"):
            if (t := masked(line)) is not None:
                has.setdefault(t, set()).add(i)
    kinds = Counter((leaf(t), j, x) for t in has for j, x in enumerate(t))
    shapes = {}
    for t, docs in has.items():
        fixed = tuple((j, x) for j, x in enumerate(t) if kinds[leaf(t), j, x] >= 5)
        if len(t) >= 5 and len(fixed) >= 0.8 * len(t):
            shapes.setdefault((leaf(t), fixed), []).append(t)
    gone = {t for t, docs in has.items() if len(docs) >= 5}
    for same in shapes.values():
        if len(set().union(*(has[t] for t in same))) >= 5:
            gone |= set(same)
    return ["\n".join(x for x in text.split("\n") if masked(x) not in gone) for text in texts]


def test_templates_by_brute_force(frame):
    rng = np.random.default_rng(24)
    word = lambda n=6: "".join(rng.choice(list("abcdefghij"), n))
    few = [word() for _ in range(4)]
    texts = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(40)) + "."]
        for _ in range(4):
            kind = int(rng.integers(0, 7))
            lines.append([f"Page {rng.integers(0, 99)} of our book", f"said {few[rng.integers(0, 4)]} to the man at {word()} gate", f"now {few[0]} {few[1]} {few[2]} and {word()} were told of it", f"{few[rng.integers(0, 4)]} {few[rng.integers(0, 4)]} {few[rng.integers(0, 4)]}", f"rare {word()}", "12 34", f"in the year {rng.integers(0, 9)} {few[rng.integers(0, 4)]} went {word()} or {few[3]} {word()}"][kind])
        texts.append("\n".join(lines))
    got = {r.doc_id: r.text for r in templates.drop_lines(frame(list(enumerate(texts)))).collect()}
    want = brute_templates(texts)
    assert [got[i] for i in range(60)] == want
    assert any(w != t for w, t in zip(want, texts)) and any("rare" in w for w in want)


def test_constant_tokens_are_met_by_a_join_too(frame, monkeypatch):
    rng = np.random.default_rng(25)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
    docs = frame([(i, f"{' '.join(word() for _ in range(30))}.\nThis story was written by {word()}") for i in range(12)])
    assert all(r["__dropped"] == 1 for r in templates.drop_lines(docs).collect())
    monkeypatch.setattr(templates, "MANY", 0)
    assert all(r["__dropped"] == 1 for r in templates.drop_lines(docs).collect())


def test_one_document_is_one_voice(frame):
    text = "\n".join(f"Here the long path turns left at the house of {x}" for x in ("anna", "berta", "carla", "dora", "emma", "frida"))
    assert templates.drop_lines(frame([(1, text), (2, "Another text about other things.")])).filter("__dropped > 0").isEmpty()


def test_templates_on_odd_rows(odd):
    done = templates.drop_lines(clashing(odd), counts=("lines", "n_gone"))
    assert done.count() == 10 and done.filter("doc_id = 1").first().text is None
    assert set(done.columns) == {*clashing(odd).columns, "n_gone"} and done.schema["lines"].dataType.simpleString() == "bigint"
    done = templates.drop_lines(clashing(odd), counts=None, emptied=False)
    assert done.columns == clashing(odd).columns and done.count() == 10
    assert all(r[n] == n for r in done.collect() for n in INSIDE)
    assert templates.drop_lines(odd.limit(0)).count() == 0


def test_emptied_documents_may_go(frame):
    rng = np.random.default_rng(21)
    own = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30)) + "."
    footer = "This page is brought to you by the friends of old maps."
    docs = frame([(i, f"{own()}\n{footer}") for i in range(8)] + [(None, footer), (20, footer), (None, ""), (21, None)])
    assert templates.drop_lines(docs).count() == 12
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in templates.drop_lines(docs, emptied=False).collect()) == [(False, i) for i in (*range(8), 21)] + [(True, 0)]


def test_sketches_survive_edits():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    edited = words.copy()
    edited[7] = edited[300] = "changed"
    a, b = templates.sketch(" ".join(words)), templates.sketch(" ".join(edited))
    assert sum(x == y for x, y in zip(a, b)) >= 2
    assert templates.sketch("") == [0] * templates.SKETCHES


# 9. SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_by_brute_force(frame, odd):
    texts = [PROSE, "", None, "One", "one TWO", "Ä b c", PROSE.upper(), "a b c", " \n"]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(list(enumerate(texts)))).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)
    assert simhash.near_duplicates(clashing(odd)).count() == 10
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_balls_find_every_link(spark):
    """Chains, clusters and lone fingerprints at distances 1 to 5."""
    rng = np.random.default_rng(12)
    fps = [int(x) for x in rng.integers(0, 2**64, 150, np.uint64)]
    for x in list(fps[:60]):
        for _ in range(3):
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    centre = fps[0]
    for _ in range(80):
        bits = rng.choice(64, int(rng.integers(1, 4)), replace=False)
        fps.append(centre ^ sum(1 << int(b) for b in bits))
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = rows_of(simhash.fingerprint_components(spark.createDataFrame([(x,) for x in signed], "fp long")))
    label = dict(links)
    want = brute_components(fps)
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(x)
    for members in groups.values():
        assert {label.get(x, x) for x in members} == {min(members)}


def test_every_mask_pair_is_covered():
    near, far = simhash.flips()
    assert len(near) == 65 and len(far) == 2 * math.comb(32, 2) and len(set(near.tolist() + far.tolist())) == 65 + len(far)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 299), (299, 300), (7, 7)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and got[300] == got[299] == 299
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(frame):
    docs = frame([(5, PROSE), (3, PROSE), (3, PROSE), (9, "Quite another text about other things."), (2, None), (1, "")])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3, 9]


def test_near_duplicates_carry_any_column(odd):
    kept = simhash.drop_near_duplicates(clashing(odd))
    assert kept.columns == clashing(odd).columns and all(r[n] == n for r in kept.collect() for n in INSIDE)


def test_ids_do_not_part_or_join_documents(frame):
    rng = np.random.default_rng(14)
    a, b, c, d, e = (" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40)) for _ in range(5))
    # Null ids of different texts; one id of two texts; a copy whose id represents another group; equal rows.
    docs = frame([(None, a), (None, b), (7, c), (7, d), (3, c), (3, e), (3, e), (9, b)])
    got = sorted((r.text for r in simhash.drop_near_duplicates(docs).collect()))
    assert got == sorted([a, b, c, d, e])
    assert {(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()} == {(None, a), (9, b), (3, c), (7, d), (3, e)}


# 10. packing


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(13)
    lengths = np.sort(rng.integers(1, 30, 200))[::-1]
    where, offset = packing.sum_of_squares(lengths, 30)
    gaps: dict[int, int] = {}
    for s, at, off in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        open_ = Counter(g for g in gaps.values() if g)

        def total(g):
            n = open_.copy()
            if g < 30 or at in gaps:
                n[g] -= 1
            n[g - s] += g > s
            return sum(x * x for x in n.values())

        before = gaps.get(at, 30)
        assert off == 30 - before
        choices = [total(g) for g in set(open_) if g >= s]
        own = total(before) if at in gaps else sum(x * x for x in (open_ + Counter([30 - s] if s < 30 else [])).values())
        assert own <= min(choices, default=own)
        gaps[at] = before - s
    assert all(g >= 0 for g in gaps.values())


def test_sum_of_squares_fills_sequences():
    rng = np.random.default_rng(16)
    lengths = np.sort(np.clip(rng.lognormal(6.3, 1.0, 5000), 2, 4095).astype(int))[::-1]
    where, offset = packing.sum_of_squares(lengths)
    assert len(set(where.tolist())) <= 1.005 * lengths.sum() / 4096 + 1
    assert (offset + lengths <= 4096).all()


def test_packing(frame, odd):
    path = tokenizer("word_bpe_49k.json")
    coder = Encoder(path, False)
    rng = np.random.default_rng(14)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta9"], int(rng.integers(0, 900))))) for i in range(60)] + [(70, None), (71, "long " * 9000), (72, "twin"), (72, "twin")]
    got = packing.pack(frame(docs), path).toPandas()
    ids = {i: np.array([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    for r in got.itertuples():
        some = ids[r.doc_id][r.start : r.start + r.length]
        assert len(some) == r.length and zlib.crc32(some.tobytes()) == r.ids_crc32 and r.start == 4096 * r.piece
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert (got.groupby("sequence_id").length.sum() <= 4096).all()
    assert got.length.sum() == sum(len(ids[i]) for i, _ in docs)
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 2
    assert packing.pack(clashing(odd), path).count() >= 10
    assert packing.pack(odd.limit(0), path).count() == 0


# the pipeline


def test_pipeline(spark, tmp_path, frame):
    import corpus_pipeline

    rng = np.random.default_rng(15)
    prose = lambda n: "\n".join(" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)).capitalize() + ", so it is said." for _ in range(n))
    rows = [(i, prose(4) + "\nSome footer of this very site.", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[0][1], "s1") for i in range(5)]
    rows += [(200, "home | news | help | more | top | end | a | b | c | d | e | f", "s0"), (201, "And " * 60, "s0"), (202, None, None)]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert kept[names[0]] == set(range(60)) | set(range(100, 105))
    assert kept[names[1]] == kept[names[0]]
    second = spark.read.parquet(str(tmp_path / "stage1"))
    assert second.filter("text LIKE '%footer%'").count() == 0
    assert kept[names[2]] == set(range(60))
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    last = docs.toPandas()
    assert sorted(run.doc_id) == sorted(last.doc_id) and (run.groupby("sequence_id").length.sum() <= 4096).all()


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    assert common.cut(spark.range(3)).count() == 3
