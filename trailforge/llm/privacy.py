"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are those of the fixed patterns and always
stay. The method looks at more candidates: credentials of any length, national
numbers, local phone numbers and titled names in English, German, French and
Spanish, beside the base patterns' own matches, valid or not. Labelers vote on
each candidate: a strict pattern, a gazetteer (domain endings, calling codes,
card issuers, key vendors, given names), the words before it, its shape, and
words that speak against it. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is; the
expected labels train a naive Bayes classifier of the spans' features, which
decides on the candidates that are not base spans.

Everything that grows with the corpus is DataFrame work with built-in functions,
and a text's spans cost time in proportion to its length and nearly so to their
number: places are sums by blocks of spans, and spans meet base spans in the
order of their places. The driver sees two tables of fixed size: counts by vote pattern (32 at most) and
sums by feature value (a few dozen).

Defined cases: a null text is empty and has no span; spans of one kind don't
overlap; the words before a span go back to the last match of its kind at most; a found span that touches a base span is left out; repeated rows get
equal results each; without any candidate nothing is trained and nothing added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailforge.llm.common import cut

#: The base patterns. Possessive, and begun only where a run begins or a match has ended, so long runs cost linear time; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Further candidates by kind.
MORE = {
    "secret": r"""(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?[^\s"',;]{6,}+|(?<![A-Za-z0-9])(?:(?:AIza|gh[opsu]_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,}+|[A-Z]{4}[A-Z0-9]{12,}+(?![a-z])|[0-9a-f]{20,}+(?![A-Zg-z]))""",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|0[0-9](?:[\x20.][0-9]{2}){4}|0[0-9]{2,4}[\x20/-][0-9]{5,8}|[6789][0-9]{2}(?:\x20[0-9]{2}){3})(?![0-9-])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|M|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señor|Señora|Don|Doña)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
BASE = ("email", "ip", "card", "phone")
#: What the gazetteer labeler knows, by kind; domain endings, first digits of cards, calling codes, key vendors, given names.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "at", "ch", "fr", "be", "es", "mx", "ar", "uk", "ie", "us", "ca", "it", "nl", "eu")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6")
CALLING = ("1", "30", "31", "32", "33", "34", "351", "353", "36", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "7", "81", "86", "91")
VENDORS = ("AKIA", "ASIA", "AIza", "gho_", "ghp_", "ghs_", "ghu_", "sk-", "xoxa-", "xoxb-", "xoxp-")
GIVEN = (
    *("Alice", "Andrew", "Anna", "Charles", "David", "Elizabeth", "Emily", "George", "James", "Jane", "John", "Linda", "Mary", "Michael", "Peter", "Robert", "Sarah", "Susan", "Thomas", "William"),
    *("Andreas", "Christian", "Claudia", "Hans", "Julia", "Karin", "Klaus", "Markus", "Monika", "Sabine", "Stefan", "Ursula", "Wolfgang"),
    *("André", "Camille", "Catherine", "Claire", "François", "Françoise", "Jacques", "Jean", "Louis", "Luc", "Marie", "Michel", "Nathalie", "Philippe", "Pierre", "Sophie"),
    *("Ana", "Antonio", "Carlos", "Carmen", "Francisco", "Javier", "José", "Juan", "Laura", "Luis", "Manuel", "María", "Miguel", "Pablo", "Pilar", "Rosa"),
)
CUES = r"(?i)(?:mail|contact|write|phone|call|tel|fax|mobile|card|visa|account|iban|ssn|social|ip|host|server|address|pass|pwd|secret|token|key|login|user|name|konto|karte|kennwort|adresse|anruf|appel|compte|carte|correo|llam|tarjeta|cuenta|clave)[^\n]{0,12}$"
AGAINST = r"(?i)(?:version|page|figure|fig\.|table|isbn|issn|chapter|section|vol\.|seite|kapitel|abbildung|chapitre|página|capítulo|figura)[^\n]{0,6}$"
#: Code points before a span that the context labelers read.
BEFORE = 32
LABELERS = ("strict", "gazetteer", "context", "shape", "against")
#: A candidate is added from this probability on.
SURE = 0.5


#: Spans whose lengths are summed together.
BLOCK = 128


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda t, x: t + x)


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once, however often lambdas in the body read it."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column, body) -> Column:
    """body(at), where at(i) is the sum of the lengths up to the place i, itself included: sums of whole blocks, then within one."""
    blocks = lambda x: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
    sums = lambda x: F.transform(blocks(x), lambda j: _total(F.slice(x, j * BLOCK + 1, BLOCK)))
    ahead = lambda s: F.transform(s, lambda _, j: _total(F.slice(s, F.lit(1), j)))

    def at(x, a, i):
        block = F.floor(i / BLOCK).cast("int")
        return F.get(a, block) + _total(F.slice(x, block * BLOCK + 1, i - block * BLOCK + 1))

    return _let(lengths, lambda x: _let(sums(x), lambda s: _let(ahead(s), lambda a: body(lambda i: at(x, a, i)))))


def _with_spans(df: DataFrame, kind: str, pattern: str, gate: Column) -> DataFrame:
    """Add a column of the kind's name: array of (kind, start, end, value, before), leftmost and non-overlapping; null without any."""

    def spans(hits: Column, gaps: Column) -> Column:
        steps = F.transform(hits, lambda _, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0)))

        def span(at):
            def one(value, i):
                return _let(at(i), lambda start: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before")))

            return F.transform(hits, one)

        return _running(steps, span)

    found = F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    parted = F.split("text", pattern, -1)
    return df.withColumn(kind, _let(found, lambda hits: F.when(F.size(hits) > 0, _let(parted, lambda gaps: spans(hits, gaps)))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)

    def add(total, i):
        x = F.substring(d, -i, F.lit(1)).cast("int") * (1 + (i + 1) % 2)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """Whether a base match counts."""
    v = x["value"]
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(v)).between(16, 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (valid spans in the order of kind and start), failed (other base matches), more (further candidates)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    df = _with_spans(df, "email", EMAIL, text.contains("@"))
    df = _with_spans(df, "ip", IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
    df = _with_spans(df, "card", CARD, text.rlike(CARD))
    df = _with_spans(df, "phone", PHONE, text.contains("+"))
    for kind, pattern in MORE.items():
        df = _with_spans(df, kind, pattern, text.rlike(pattern))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")
    got = lambda k: F.coalesce(F.col(k), empty)
    sifted = lambda k, good: F.filter(got(k), lambda x: _valid(k, x) if good else ~_valid(k, x))
    base = [sifted(k, True) for k in BASE]
    failed = [sifted(k, False) for k in BASE if k != "email"]
    return df.select("doc_id", F.concat(*base).alias("base"), F.concat(*failed).alias("failed"), F.concat(*[got(k) for k in MORE]).alias("more"))


def candidates(per: DataFrame) -> DataFrame:
    """A row a candidate: nth (of the document's row), found (not a base match), span, votes and features."""
    tagged = lambda spans, found, valid: F.transform(spans, lambda x: F.struct(x.alias("span"), F.lit(found).alias("found"), F.lit(valid).alias("valid")))
    every = F.concat(tagged(F.col("base"), False, True), tagged(F.col("failed"), False, False), tagged(F.col("more"), True, True))
    rows = per.select("nth", F.explode(every).alias("x")).select("nth", "x.found", "x.valid", "x.span.*")
    # Of the base spans of a text: the farthest end of those that begin before, the nearest start of those that begin after.
    base = F.col("valid") & ~F.col("found")
    up = Window.partitionBy("nth").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("nth").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"reach": F.max(F.when(base, F.col("end"))).over(up), "next": F.min(F.when(base, F.col("start"))).over(down)})
    rows = rows.filter(~F.col("found") | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))))
    v, kind = F.col("value"), F.col("kind")
    n = F.length(v)
    digits = F.length(_digits(v))
    strict = F.col("valid") & F.when(kind == "secret", v.rlike(r"[0-9]") & v.rlike(r"[0-9A-Za-z]{12}")).when(kind == "national_id", ~v.rlike(r"^(?:000|666|9)|-00-|-0000$")).otherwise(True)
    known = (
        F.when(kind == "email", F.lower(F.regexp_extract(v, r"\.([A-Za-z]+)$", 1)).isin(*DOMAINS))
        .when(kind == "card", F.left(_digits(v), F.lit(1)).isin(*ISSUERS) | F.left(_digits(v), F.lit(2)).isin(*ISSUERS))
        .when(kind == "phone", F.exists(F.array(*[F.left(_digits(v), F.lit(k)) for k in (1, 2, 3)]), lambda x: x.isin(*CALLING)))
        .when(kind == "secret", F.exists(F.array(*[F.lit(x) for x in VENDORS]), lambda x: v.startswith(x)) | v.rlike(r"(?i)^(?:pass|pwd|secret|token|api|access)"))
        .when(kind == "name", F.get(F.split(v, " "), F.lit(1)).isin(*GIVEN))
        .otherwise(False)
    )
    shape = F.when(kind.isin("secret", "email"), v.rlike(r"[0-9]") & v.rlike(r"[A-Za-z]")).when(kind == "name", v.rlike(r"\p{Ll} \p{Lu}")).otherwise(digits * 2 >= n)
    votes = {"strict": strict, "gazetteer": known, "context": F.col("before").rlike(CUES), "shape": shape, "against": F.col("before").rlike(AGAINST)}
    features = {
        "f_kind": kind,
        "f_length": F.least(F.floor(n / 8), F.lit(8)).cast("string"),
        "f_digits": F.floor(4 * digits / n).cast("string"),
        "f_strict": strict.cast("string"),
        "f_signs": F.least(F.length(F.regexp_replace(v, r"[\p{L}\p{N}]", "")), F.lit(4)).cast("string"),
        "f_case": F.concat(v.rlike(r"\p{Lu}").cast("string"), v.rlike(r"\p{Ll}").cast("string")),
    }
    return rows.select("nth", "found", "kind", "start", "end", "value", *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in votes.items()], *[c.alias(k) for k, c in features.items()])


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[float], list[float], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counts of vote patterns.

    Returns the share of true spans, each labeler's chance to vote on a true
    and on a false span, and the expected label of each pattern.
    """
    total = sum(counts.values())
    width = len(next(iter(counts)))
    # The start: votes for less votes against, by the majority.
    truth = {p: min(0.95, max(0.05, (sum(p[:-1]) - 2 * p[-1]) / (width - 1))) for p in counts}
    for _ in range(rounds):
        good = sum(n * truth[p] for p, n in counts.items())
        prior = (good + 1) / (total + 2)
        yes = [(sum(n * truth[p] * p[k] for p, n in counts.items()) + 1) / (good + 2) for k in range(width)]
        no = [(sum(n * (1 - truth[p]) * p[k] for p, n in counts.items()) + 1) / (total - good + 2) for k in range(width)]
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log((yes[k] if x else 1 - yes[k]) / (no[k] if x else 1 - no[k])) for k, x in enumerate(p))
            truth[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, yes, no, truth


def _lookup(table: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def classified(rows: DataFrame) -> DataFrame:
    """The candidates with p, the classifier's probability that they are personal data."""
    votes = rows.groupBy(*LABELERS).count().collect()
    if not votes:
        return rows.withColumn("p", F.lit(0.0))
    counts = {tuple(int(r[k]) for k in LABELERS): r["count"] for r in votes}
    *_, truth = reliabilities(counts)
    label = _lookup({"".join(map(str, p)): t for p, t in truth.items()}, F.concat(*[F.col(k).cast("string") for k in LABELERS]))
    names = [c for c in rows.columns if c.startswith("f_")]
    soft = rows.withColumn("y", label)
    sums = soft.select("y", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in names])).alias("x"))
    sums = sums.groupBy("x.f", "x.v").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    good = sum(n * truth[p] for p, n in counts.items())
    bad = sum(counts.values()) - good
    score = F.lit(math.log((good + 1) / (bad + 1)))
    for f in names:
        own = [r for r in sums if r["f"] == f]
        table = {r["v"]: math.log((r["good"] + 1) / (good + len(own))) - math.log((r["n"] - r["good"] + 1) / (bad + len(own))) for r in own}
        score = score + _lookup(table, F.col(f))
    return rows.withColumn("p", 1 / (1 + F.exp(-score)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, base and added (arrays of kind, start, end, value), in the order of kind and start."""
    per = cut(base_spans(docs, id_col, text_col).withColumn("nth", F.monotonically_increasing_id()))
    rows = cut(candidates(per))
    added = classified(rows).filter(F.col("found") & (F.col("p") >= SURE))
    order = F.array_position(F.array(*[F.lit(k) for k in MORE]), F.col("kind"))
    added = added.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "start", "end", "kind", "value"))).alias("added"))
    clean = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    out = per.join(added.withColumnRenamed("nth", "__n"), F.col("nth") == F.col("__n"), "left")
    return out.select("doc_id", clean("base").alias("base"), F.coalesce(clean("added"), none).alias("added"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans, all spans as text, and their number."""
    found = find(docs, id_col, text_col)
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(spelled("base"), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
