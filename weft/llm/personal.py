"""Operator 5: personal data by aggregated weak labels (DataFrame functions only).

Spans are found in one scan of the texts and stay in their document's row: the base matches, and candidates that
the base patterns miss (parts of digit runs that are too long, phone numbers without a sign, spelt-out addresses, long IP forms).
Four labellers vote on every candidate: a pattern check, a gazetteer, the words before it and its edges.  The
votes are counted by pattern - a table of bounded size - from which expectation maximisation estimates how
reliable each labeller is; its posteriors are the soft labels of a logistic classifier over span features.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shared import land, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  Possessive repeats and the looks behind change no match: they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?:\+[0-9]{1,3} ?)?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){3,4}(?![0-9])",
}
#: A text without this holds no match of the kind.
NEEDS = {"email": r"@|[\[({](?:at|AT)[\])}]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|\([0-9]"}
#: Words before a span that speak for a kind, and words that speak against all.
CUES = {"email": "e-?mail|mail|contact|write|kontakt|correo|courriel", "ip": "ip|address|server|host|adresse|servidor", "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
        "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono"}
AGAINST = "order|invoice|isbn|version|token|serial|hash|bestellung|commande|pedido"
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64",
           "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
CONTEXT = 40
ACCEPT_AT = 0.9
VOTERS = ("check", "gazetteer", "context", "edges")
FEATURES = ("digits", "marks", "signed", "wrapped", "check", "gazetteer", "context", "edges")
#: How a labeller is thought to vote before any data (yes, no, abstains), and for how many votes that counts.
PRIOR = {"check": ((0.9, 0.05, 0.05), (0.05, 0.9, 0.05)), "gazetteer": ((0.7, 0.2, 0.1), (0.3, 0.6, 0.1)),
         "context": ((0.3, 0.05, 0.65), (0.05, 0.3, 0.65)), "edges": ((0.85, 0.15, 0.0), (0.6, 0.4, 0.0))}
PRIOR_VOTES = 50.0
YES, NO, ABSTAINS = 1, 0, 2


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
        c.try_cast("int") * 2 - F.when(c > "4", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _octets(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(m)
    n = F.length(_digits(m))
    return n.between(9, 15) if kind == "phone" else F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All matches in order: s, e (code points), m, before (up to CONTEXT characters), after (one)."""
    hit = text.rlike(NEEDS[kind])
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.substring(g, -CONTEXT, CONTEXT).alias("before")))
    parts = F.zip_with(F.slice(parts, F.lit(1), F.size(matches)), F.slice(gaps, F.lit(2), F.size(matches)), lambda p, g: F.struct(
        p["m"].alias("m"), p["gap"].alias("gap"), p["before"].alias("before"), F.substring(g, 1, 1).alias("after")))
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    placed = _bound(parts, lambda all_parts: F.zip_with(all_parts, _sums_before(F.transform(all_parts, lambda p: p["gap"] + F.length(p["m"]))), lambda p, at: F.struct(
        (at + p["gap"]).alias("s"), (at + p["gap"] + F.length(p["m"])).alias("e"), p["m"].alias("m"), p["before"].alias("before"), p["after"].alias("after"))))
    return F.when(hit & (F.size(matches) > 0), placed).otherwise(none)


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with the value taken once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def _blocks(values: Column) -> Column:
    """An array cut into blocks of about the square root of its length."""
    def cut(v: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / side).cast("int")), lambda b: F.slice(v, b * side + 1, side))).otherwise(
            F.filter(F.array(v), lambda _: F.lit(False)))

    return _bound(values, cut)


def _sums_before(values: Column) -> Column:
    """For each whole number of an array the sum of those before it.  A fold that appends copies what it has, so the array is
    summed in blocks, and so are the blocks' totals: the copying stays below the length to the power 1.5."""
    def run(v: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(v, state, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]

    def sums(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, run(totals, F.lit(0)), run))

    return _bound(_blocks(values), sums)


def _apart(chosen: Column, base: Column) -> Column:
    """The spans of ``chosen`` that overlap none of ``base``, which is ordered and free of overlaps: a span looks into the blocks of
    base spans that it meets."""
    def keep(blocks: Column) -> Column:
        ranges = F.transform(blocks, lambda b: F.struct(b[0]["s"].alias("s"), F.element_at(b, -1)["e"].alias("e"), b.alias("b")))
        meets = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
        return _bound(ranges, lambda r: F.filter(chosen, lambda c: ~F.exists(r, lambda y: meets(c, y) & F.exists(y["b"], lambda z: meets(c, z)))))

    return _bound(_blocks(base), keep)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAINS)


def _candidate(kind: str, x: Column, base: bool) -> Column:
    """A match as a candidate: its span, the four votes and the features that are no votes."""
    m, digits = x["m"], _digits(x["m"])
    if kind == "email":
        check = m.rlike(r"^[^@]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$") if base else m.rlike(r"[A-Za-z]{2,}$")
        gazetteer = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*ENDINGS)
    elif kind == "ip":
        check = _octets(m) if base else F.lit(True)
        gazetteer = m.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.") if base else F.lower(m).rlike("^(?:2|3|f[cde])")
    elif kind == "card":
        check = _passes("card", m)
        gazetteer = digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))")
    else:
        check = _passes("phone", m) & m.startswith("+")
        gazetteer = F.when(m.startswith("+"), F.exists(F.array(*map(F.lit, CALLING)), lambda c: digits.startswith(c))).otherwise(F.length(digits).between(9, 11))
    before = F.lower(x["before"])
    cue, against = before.rlike(rf"(?<!\p{{L}})(?:{CUES[kind]})(?!\p{{L}})"), before.rlike(rf"(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})")
    clean = ~x["before"].rlike(r"[\p{L}0-9@]$") & ~x["after"].rlike(r"[\p{L}0-9@]")
    gazetteer = F.coalesce(gazetteer, F.lit(False))
    return F.struct(
        F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
        _vote(check, ~check).alias("check"), _vote(gazetteer, ~gazetteer).alias("gazetteer"),
        _vote(cue & ~against, against & ~cue).alias("context"), _vote(clean, ~clean).alias("edges"),
        F.least(F.length(digits), F.lit(20)).alias("digits"), F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(6)).alias("marks"),
        m.startswith("+").cast("int").alias("signed"), m.contains("(").cast("int").alias("wrapped"))


def find_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, candidates), landed: the base spans, and the voted-on candidates, of each row of ``df``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    raw = rows.select("doc_id", *[_found(F.col("text"), k, BASE[k]).alias(f"b_{k}") for k in KINDS], *[_found(F.col("text"), k, WIDER[k]).alias(f"w_{k}") for k in KINDS])
    raw = land(raw, "pii-matches")
    def passing(i: int, kind: str) -> Column:
        held = F.filter(f"b_{kind}", lambda x: _passes(kind, x["m"]))
        return F.transform(held, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    def voted(kind: str, base: bool) -> Column:
        least = 9 if base and kind in ("card", "phone") else 0
        held = F.filter(f"{'b' if base else 'w'}_{kind}", lambda x: F.length(_digits(x["m"])) >= least)
        return F.transform(held, lambda x: _candidate(kind, x, base))

    spans = [passing(i, k) for i, k in enumerate(KINDS)]
    candidates = [voted(k, base) for base in (True, False) for k in KINDS]
    return land(raw.select("doc_id", F.array_sort(F.concat(*spans)).alias("base"), F.concat(*candidates).alias("candidates")), "pii-spans")


def vote_counts(spans: DataFrame) -> list[dict]:
    """How often each pattern of votes and features comes, over all candidates (a few thousand patterns at most)."""
    each = spans.select(F.explode("candidates").alias("c")).select("c.*")
    return [r.asDict() for r in each.groupBy("kind", *dict.fromkeys(VOTERS + FEATURES)).agg(F.count("*").alias("n")).orderBy("kind", *dict.fromkeys(VOTERS + FEATURES)).collect()]


def reliabilities(rows: list[dict], rounds: int = 60) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Expectation maximisation over one kind's patterns: the share of true spans, each labeller's chances of a
    vote (true or not, by vote), and the posterior of each pattern."""
    n = np.array([r["n"] for r in rows], dtype=float)
    votes = {v: np.array([r[v] for r in rows]) for v in VOTERS}
    order = [YES, NO, ABSTAINS]
    prior = {v: np.array([[p[order.index(k)] for k in range(3)] for p in PRIOR[v]]) for v in VOTERS}
    law, share = {v: prior[v] + 1e-6 for v in VOTERS}, 0.5
    for _ in range(rounds):
        yes, no = np.full(len(n), np.log(share)), np.full(len(n), np.log(1 - share))
        for v in VOTERS:
            yes, no = yes + np.log(law[v][0][votes[v]]), no + np.log(law[v][1][votes[v]])
        post = 1 / (1 + np.exp((no - yes).clip(-60, 60)))
        share = float((n @ post + 1) / (n.sum() + 2))
        for v in VOTERS:
            sums = np.stack([np.bincount(votes[v], n * w, 3) for w in (post, 1 - post)]) + PRIOR_VOTES * prior[v] + 1e-6
            law[v] = sums / sums.sum(axis=1, keepdims=True)
    return share, law, post


def _inputs(row: dict) -> list[float]:
    """Features of a pattern as numbers; votes count as 1, -1 and 0."""
    return [1.0, *[{YES: 1.0, NO: -1.0, ABSTAINS: 0.0}[row[f]] if f in VOTERS else row[f] / 10 for f in FEATURES]]


def fit_classifier(rows: list[dict], target: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic classifier fitted to soft labels, by Newton's method."""
    x, n = np.array([_inputs(r) for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        grad = x.T @ (n * (p - target)) + ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad).clip(-3, 3)
    return w


def train(spans: DataFrame) -> dict[str, np.ndarray]:
    """Classifier weights by kind; kinds without candidates have none."""
    by: dict[str, list[dict]] = {}
    for r in vote_counts(spans):
        by.setdefault(r["kind"], []).append(r)
    return {k: fit_classifier(rows, reliabilities(rows)[2]) for k, rows in by.items()}


def _probability(c: Column, weights: np.ndarray) -> Column:
    total = F.lit(float(weights[0]))
    for f, w in zip(FEATURES, weights[1:], strict=True):
        value = F.when(c[f] == YES, 1.0).when(c[f] == NO, -1.0).otherwise(0.0) if f in VOTERS else c[f] / 10
        total = total + value * float(w)
    return 1 / (1 + F.exp(-total))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text", accept_at: float = ACCEPT_AT) -> DataFrame:
    """One row per row of ``df``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    The counts and the digest are those of the base spans; ``spans`` has the base spans and those that the
    classifier adds: candidates with a probability of ``accept_at`` or more that overlap no base span of their kind.
    Null and empty texts have no spans.  Repeated rows are judged one by one; an empty table has no rows.
    """
    found = find_spans(df, doc_id, text)
    weights = train(found)
    likely = lambda c: F.coalesce(*[F.when(c["kind"] == k, _probability(c, w)) for k, w in weights.items()], F.lit(0.0))
    number = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1
    if weights:
        accepted = lambda c: ~c["base"] & (likely(c) >= accept_at)
        chosen = F.transform(F.filter("candidates", accepted), lambda c: F.struct(c["s"].alias("s"), number(c).alias("k"), c["e"].alias("e")))
        found = found.withColumn("chosen", chosen)
        of_kind = lambda c, i: F.filter(c, lambda x: x["k"] == i)
        added = F.when(F.size("chosen") > 0, F.concat(*[_apart(of_kind("chosen", i), of_kind("base", i)) for i in range(len(KINDS))])).otherwise(F.col("chosen"))
    else:
        added = F.filter("base", lambda _: F.lit(False))
    count = lambda i: F.size(F.filter("base", lambda b: b["k"] == i)).cast("long")
    out = found.withColumn("added", added)
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                      _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
