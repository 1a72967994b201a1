"""Personal data by weak supervision, in DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns (email, ip, card, phone) that pass their checks. Wider patterns
give further candidates: spelled-out emails, IPv6 addresses, cards and international numbers inside longer digit chains that
failed as a whole, national phone numbers; and base matches that failed their check. A wider candidate that overlaps a base span
is none. Five labelers vote on every candidate, for, against or not at all: pattern, gazetteer, words before the
span that speak for it, words that speak against it, and shape.

Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each candidate's probability. With
these as soft labels a logistic span classifier is trained on features that no labeler votes on (the characters on both
sides, separators, digits, the word before), each with its kind, and decides which candidates beyond the base become spans.

Positions come from one pass of each pattern: the matches and the gaps between them, whose lengths in code points add up.
Only counts reach the driver: of vote patterns, at most ``4 kinds x 3**5 votes``, and of features, at most
``4 kinds x 5 x 5 sides x 4 separators x 4 sizes x 16 words`` rows, whatever the corpus.

Defined cases: a null text is empty and has no span; repeated rows each get a row; other columns are not read; an empty
table gives no rows. Patterns use possessive repetition, so that very long runs need neither stack nor quadratic time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged

KINDS = ("email", "ip", "card", "phone")

# The contract's base patterns. Possessive repetition changes no match, as nothing that follows could use
# what is given back; a start inside a run is tried only right after a match, as elsewhere it fails like the run's own start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
WIDE = (
    r"[A-Za-z0-9._%+-]{2,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,64}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{2,24}|\.[A-Za-z]{2,24})+"
    r"|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{16}(?![0-9])"
    r"|\+[0-9]{1,3}[ .-]\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+().-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])"
)
WIDE_GATE = r"[\[(](?:at|AT)[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[0-9]{3,4}[ .-][0-9]{4}|[0-9]{16}"

# Gazetteers and context words of the four languages.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "eu", "uk", "us")
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|35)"
CALLING_CODES = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
FOR_WORDS = r"(?i)\b(?:e-?mail|mail|contact|contacto|kontakt|write|call|phone|tel|telefon|teléfono|téléphone|mobile|fax|card|visa|karte|carte|tarjeta|ip|host|server|address|adresse|dirección)\b[^\n]{0,12}$"
AGAINST_WORDS = r"(?i)\b(?:version|release|section|page|figure|table|isbn|issn|order|invoice|serial|build|chapter|kapitel|seite|capítulo|página|chapitre)\b[^\n]{0,12}$"
LABELERS = 5
RUN = 128
WORDS = 16  # buckets of the word before a span
SIZES = (9, 13, 16)  # digit counts that part the size classes


def _located(text: Column, pattern: str, gate: Column) -> Column:
    """Matches of ``pattern`` as structs (start, end, m, before, after), one evaluation of matches and gaps each.

    Places add up within runs of ``RUN`` matches and over the runs, as appending match by match would copy all before it.
    """
    kind = "array<struct<start:int,end:int,m:string,before:string,after:string>>"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.lit((1 << 31) - 1)).alias("h"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        after = F.substring(F.coalesce(x["h"], F.lit("")), 1, 1)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.substring(x["g"], -48, 48).alias("before"), after.alias("after"))).cast(kind)
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / RUN).cast("int")), lambda i: F.slice(zipped, i * RUN + 1, F.lit(RUN)))
    whole = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), run, lambda acc: F.flatten(acc["out"]))
    return F.when(gate, whole).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    number = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd")))
    total = F.aggregate(number, F.lit(0), lambda acc, x: acc + F.when(x["odd"] == 0, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)))
    return total % 10 == 0


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4) & F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("0"), p), F.lit(9)).cast("int"), F.lit(999)) <= 255
    )


def _passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(m)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(8, 15)


def matches(documents: DataFrame) -> DataFrame:
    """doc_id, and for each pattern an array of (start, end, m, before); one scan of the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = F.col("__t")
    columns = [_located(t, BASE[k], t.rlike(GATES[k])).alias(k) for k in KINDS]
    return documents.select("doc_id", text.alias("__t")).select("doc_id", *columns, _located(t, WIDE, t.rlike(WIDE_GATE)).alias("wide"))


def _wide_kind(m: Column) -> Column:
    return F.when(m.rlike(r"[\[(](?:at|AT)[\])]"), 0).when(m.rlike("^[0-9A-Fa-f]{1,4}:"), 1).when(m.rlike("^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}$"), 2).otherwise(3)


def _side(c: Column) -> Column:
    """Class of a neighbouring character: none, white space, a letter or digit, a quote or bracket, any other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).when(c.rlike(r"""["'`()<>\[\]{}=]"""), 3).otherwise(4)


def candidates(found: DataFrame) -> DataFrame:
    """``matches`` with ``first`` (base matches) and ``more`` (wider ones that overlap no base span): (kind, start, end, passed, votes,
    features)."""

    def votes(kind: Column, x: Column, passed: Column) -> Column:
        m, before, digits = x["m"], x["before"], _digits(x["m"])
        n = F.length(digits)
        pattern = F.when(passed, 1).otherwise(-1)
        known = (
            F.when(kind == 0, F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(*DOMAINS))
            .when(kind == 1, F.lit(None).cast("boolean"))
            .when(kind == 2, digits.rlike(CARD_STARTS))
            .otherwise(F.when(m.startswith("+"), m.rlike(CALLING_CODES)))
        )
        gazetteer = F.when(known, 1).when(~known, -1).otherwise(0)
        speaks_for = F.when(before.rlike(FOR_WORDS), 1).otherwise(0)
        against = F.when(before.rlike(AGAINST_WORDS), -1).otherwise(0)
        plain = m.rlike(r"^(?:19|20)[0-9]{2}[-.][0-9]{2}") | digits.rlike(r"^([0-9])\1*$") & (n > 0)
        shape = F.when(plain, -1).when((kind == 3) & m.rlike(r"^\+[0-9]{1,3}[ (.-]"), 1).when((kind == 2) & m.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1"), 1).otherwise(0)
        return F.array(*[v.cast("int") for v in (pattern, gazetteer, speaks_for, against, shape)])

    def features(x: Column) -> Column:
        n = F.length(_digits(x["m"]))
        size = sum((F.when(n >= k, 1).otherwise(0) for k in SIZES), F.lit(0))
        separators = F.least(F.length(F.regexp_replace(x["m"], r"[^ .()\-]", "")), F.lit(3))
        word = F.lower(F.regexp_extract(x["before"], r"(\p{L}+)[^\p{L}]*$", 1))
        bucket = F.when(word == "", 0).otherwise(1 + F.pmod(F.crc32(word.cast("binary")), F.lit(WORDS - 1)))
        return F.array(*[v.cast("int") for v in (_side(F.substring(x["before"], -1, 1)), _side(x["after"]), separators, size, bucket)])

    def as_candidates(k: int, passed) -> Column:
        def one(x: Column) -> Column:
            kind = F.lit(k) if k < len(KINDS) else _wide_kind(x["m"])
            ok = passed(x)
            return F.struct(kind.cast("int").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), ok.alias("passed"), votes(kind, x, ok).alias("votes"), features(x).alias("features"))

        return F.transform(F.col(KINDS[k] if k < len(KINDS) else "wide"), one)

    arrays = [as_candidates(k, lambda x, kind=kind: _passes(kind, x["m"])) for k, kind in enumerate(KINDS)]
    arrays.append(as_candidates(len(KINDS), lambda x: F.when(_wide_kind(x["m"]) == 2, luhn(_digits(x["m"]))).otherwise(F.lit(True))))
    both = found.select("doc_id", F.concat(*arrays[:4]).alias("first"), arrays[4].alias("wider"))
    base = F.filter("first", lambda y: y["passed"])
    return both.select("doc_id", "first", F.filter("wider", lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))).alias("more"))


def em(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 60) -> tuple[list[float], list[list[list[float]]]]:
    """Posterior of each (kind, votes, count) and P(vote | truth) of each labeler, by expectation-maximisation with
    one pseudo-count per outcome that leans to the vote's own meaning."""
    posterior = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for _, v, _ in patterns]
    rates: list[list[list[float]]] = []
    for _ in range(rounds):
        rates = []
        for k in range(LABELERS):
            table = [[4.0, 4.0, 1.0], [1.0, 4.0, 4.0]]  # truth x vote (-1, 0, 1)
            for (_, v, n), p in zip(patterns, posterior, strict=True):
                table[1][v[k] + 1] += n * p
                table[0][v[k] + 1] += n * (1 - p)
            rates.append([[x / sum(row) for x in row] for row in table])
        prior = {}
        for kind in {k for k, _, _ in patterns}:
            own = [(n, p) for (k, _, n), p in zip(patterns, posterior, strict=True) if k == kind]
            total = sum(n for n, _ in own)
            prior[kind] = (sum(n * p for n, p in own) + 1) / (total + 2)
        posterior = []
        for kind, v, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(rates[k][1][x + 1] / rates[k][0][x + 1]) for k, x in enumerate(v))
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return posterior, rates


#: How many values each feature takes.
SPAN = (5, 5, 4, len(SIZES) + 1, WORDS)
#: Where each feature's weights begin: a bias for each kind first, then a weight for each kind and value.
FIRST = [len(KINDS) * (1 + sum(SPAN[:k])) for k in range(len(SPAN))]
WIDTH = len(KINDS) * (1 + sum(SPAN))


def _terms(kind: int, features: Sequence[int]) -> list[int]:
    """Indices of a candidate's weights."""
    return [kind, *(FIRST[k] + len(KINDS) * v + kind for k, v in enumerate(features))]


def fit_classifier(terms: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 400, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights from rows of weight indices, soft labels and counts, by gradient steps with a diagonal curvature bound."""
    w = np.zeros(WIDTH)
    h = np.full(WIDTH, ridge)
    np.add.at(h, terms, 0.25 * terms.shape[1] * counts[:, None])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(w[terms].sum(axis=1), -30, 30)))
        g = ridge * w
        np.add.at(g, terms, (counts * (q - labels))[:, None])
        w = w - g / h
    return w


def train(cands: DataFrame) -> tuple[list[float], list[list[list[float]]]]:
    """The span classifier's weights and the labelers' reliabilities, from counts of vote patterns and of features."""
    each = cands.select(F.explode(F.concat("first", "more")).alias("c")).select("c.kind", "c.votes", "c.features")
    counts = sorted((r["kind"], tuple(r["votes"]), float(r["n"])) for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect())
    if not counts:
        return [0.0] * WIDTH, []
    posterior, rates = em(counts)
    pattern = lambda kind, votes: F.concat_ws(":", kind.cast("string"), F.array_join(F.transform(votes, lambda v: v.cast("string")), ","))
    soft = F.create_map(*[F.lit(x) for (k, v, _), p in zip(counts, posterior, strict=True) for x in (f"{k}:{','.join(map(str, v))}", p)])
    labelled = each.select("kind", "features", soft[pattern(F.col("kind"), F.col("votes"))].alias("p"))
    rows = sorted((r["kind"], tuple(r["features"]), r["p"], float(r["n"])) for r in labelled.groupBy("kind", "features").agg(F.avg("p").alias("p"), F.count("*").alias("n")).collect())
    terms = np.array([_terms(k, f) for k, f, _, _ in rows])
    return fit_classifier(terms, np.array([r[2] for r in rows]), np.array([r[3] for r in rows])).tolist(), rates


def find(documents: DataFrame, least: float = 0.9) -> DataFrame:
    """A row per document row: doc_id, ``base`` and ``spans``, arrays of (kind, start, end) by kind and start (kinds by
    their place in ``KINDS``). Candidates beyond the base need a probability of ``least`` and may not overlap a base span."""
    cands = staged(candidates(staged(matches(documents), "pii-matches")), "pii-candidates")
    w, _ = train(cands)

    weights = F.array(*[F.lit(float(x)) for x in w])

    def likely(c: Column) -> Column:
        z = F.element_at(weights, c["kind"] + 1)
        for k, first in enumerate(FIRST):
            z = z + F.element_at(weights, F.lit(first + 1) + len(KINDS) * c["features"][k] + c["kind"])
        return z >= F.lit(math.log(least / (1 - least)))

    span = "array<struct<kind:int,start:int,end:int>>"
    bare = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.transform(F.filter("first", lambda c: c["passed"]), bare).cast(span)
    more = F.transform(F.filter(F.concat(F.filter("first", lambda c: ~c["passed"]), F.col("more")), likely), bare).cast(span)
    out = cands.select("doc_id", base.alias("base"), more.alias("more"))
    free = F.filter("more", lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return out.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", free))).alias("spans"))


def spelled(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
