"""Personal data by weak supervision, with DataFrame functions only.

Base kinds are exact patterns with checks. Further candidate spans come from a wide pattern; regex, gazetteer and
context labelers vote on each (for, against, abstain). The votes are counted by pattern - at most 3 ** labelers rows a
kind and shape, however many spans - and expectation-maximisation over these counts estimates how reliable each
labeler is. Its posteriors train a logistic classifier on votes and shape, which decides the candidates.
"""

from __future__ import annotations

import math
import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.session import cut_lineage

# fixed values: the contract's base kinds, as patterns that match the same text without backtracking
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a cheap test that a text can hold the kind at all
MAY_HOLD = {"email": "@", "ip": ".", "card": None, "phone": "+"}

CANDIDATES = {     # further kinds, in order of precedence
    "email_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}+)++",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9])",
    "number": r"(?<![0-9-])[0-9](?:[ -]?[0-9]){8,18}+(?![ -]?[0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
_GUARD = r"[0-9]{2}[-. /)]{0,2}[0-9]{2}|[ (\[]dot[ )\]]|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}"
_CONTEXT = 40      # code points on either side that the context labelers see

# gazetteers and cue words
GIVEN_NAMES = ("james john robert michael william david mary patricia linda barbara elizabeth jennifer maria susan anna "
               "peter paul thomas marie pierre jean louis klaus hans juergen wolfgang juan carlos jose carmen ana").split()
MAIL_HOSTS = "gmail yahoo hotmail outlook icloud proton gmx web example mail".split()
CUES_FOR = ("phone tel telephone mobile cell call fax email mail contact ssn social iban account card visa mastercard born "
            "birth name address passport kontakt telefon nombre nom").split()
CUES_AGAINST = "version isbn issn invoice order item ref page chapter section figure table total price sku model".split()

LABELERS = ("format", "gazetteer", "cue_before", "cue_against", "separators", "unit_after")
MAX_PATTERNS = 3 ** len(LABELERS) * len(CANDIDATES) * 6      # bound of the vote counts that reach the driver


def _word(names: list[str]) -> str:
    return r"(?<![a-z])(?:" + "|".join(names) + r")(?![a-z])"


def located(text: Column, pattern: str, may_hold: Column) -> Column:
    """Leftmost non-overlapping matches of ``pattern``: array<struct<start, end, value, before, after>> in code points.

    The pieces between the matches give the places: what is before match i is pieces 0..i and matches 0..i-1.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
    empty = F.array().cast(kind)

    def place(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        n = F.size(found)
        rows = F.arrays_zip(found.alias("v"), F.slice(pieces, F.lit(1), n).alias("g"), F.slice(pieces, F.lit(2), n).alias("h"))

        def step(done: Column, x: Column) -> Column:
            start = done["at"] + F.length(x["g"])
            end = start + F.length(x["v"])
            span = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"),
                            F.right(x["g"], F.lit(_CONTEXT)).alias("before"), F.left(x["h"], F.lit(_CONTEXT)).alias("after"))
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))
        return F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda done: done["out"])
    # one-element transform: the matches are computed once, the pieces only if there are matches
    found = F.when(may_hold, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, place(m)).otherwise(empty)), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weigh), F.lit(0), lambda a, x: a + x)
    return (n > 0) & (total % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3)
                        & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _is_valid(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _vote(for_: Column, against: Column) -> Column:
    return F.coalesce(F.when(for_, 1).when(against, -1), F.lit(0))


def _votes(kind: Column, v: Column, before: Column, after: Column) -> Column:
    low, b, a = F.lower(v), F.lower(before), F.lower(after)
    digits = _digits(v)
    strict = ((kind == "ssn") & ~v.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$")) | ((kind == "iban") & v.rlike(r"^(?:[A-Z]{2}[0-9]{2})(?: ?[A-Z0-9]){11,30}$")) \
        | ((kind == "local_phone") & ~v.rlike(r"^\(?[01]")) | ((kind == "number") & luhn(digits)) \
        | ((kind == "date") & v.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-]")) | kind.isin("email_words", "person")
    named = low.rlike(_word(GIVEN_NAMES)) | low.rlike(_word(MAIL_HOSTS))
    issuer = (kind == "number") & digits.rlike(r"^(?:4|5[1-5]|34|37|6011|65)") & F.length(digits).between(14, 16)
    return F.array(
        _vote(strict, ~strict),
        _vote(named | issuer, (kind == "number") & F.length(digits).between(14, 16)),
        _vote(b.rlike(_word(CUES_FOR)), F.lit(False)),
        _vote(F.lit(False), b.rlike(_word(CUES_AGAINST))),
        _vote(v.rlike(r"[(). -]") & (kind != "number"), (kind == "number") & ~v.rlike("[ -]")),
        _vote(F.lit(False), a.rlike(r"^ ?(?:%|kg|km|eur|usd|\$|€|pcs|units|mm|cm)")))


def _shape(v: Column) -> Column:
    share = F.length(_digits(v)) / F.greatest(F.length(v), F.lit(1))
    return (F.when(share >= 0.9, 2).when(share >= 0.5, 1).otherwise(0) * 2 + (F.length(v) >= 14).cast("int")).cast("int")


class SpanClassifier:
    """Weights of votes and shapes, per kind; ``score`` >= 0 means personal."""

    def __init__(self, weights: dict[str, list[float]]):
        self.weights = weights

    def score(self, kind: Column, votes: Column, shape: Column) -> Column:
        total = F.lit(-1.0)
        for name, w in sorted(self.weights.items()):
            s = F.lit(float(w[0]))
            for j in range(len(LABELERS)):
                vote = F.element_at(votes, j + 1)
                s = s + F.when(vote == 1, float(w[1 + 2 * j])).when(vote == -1, float(w[2 + 2 * j])).otherwise(0.0)
            s = s + F.element_at(F.array(*(F.lit(float(x)) for x in w[1 + 2 * len(LABELERS):])), shape + 1)
            total = F.when(kind == name, s).otherwise(total)
        return total


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[dict[int, tuple[float, float]]], float]:
    """Expectation-maximisation over vote patterns of one kind: posterior of each pattern, the probability of each vote
    given not personal and personal for each labeler, and the share of personal spans. Starts from the majority."""
    post = {p: (0.9 if sum(p) > 0 else 0.1 if sum(p) < 0 else 0.5) for p in counts}
    table: list[dict[int, tuple[float, float]]] = []
    prior = 0.5
    for _ in range(rounds):
        total = [sum(c * (1 - post[p]) for p, c in counts.items()), sum(c * post[p] for p, c in counts.items())]
        prior = (total[1] + 1) / (sum(total) + 2)
        table = []
        for j in range(len(LABELERS)):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            seen[1][1] += 2.0       # a labeler is taken to be better than chance
            seen[-1][0] += 2.0
            for p, c in counts.items():
                seen[p[j]][0] += c * (1 - post[p])
                seen[p[j]][1] += c * post[p]
            whole = [sum(s[y] for s in seen.values()) for y in (0, 1)]
            table.append({v: (s[0] / whole[0], s[1] / whole[1]) for v, s in seen.items()})
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][v][1] / table[j][v][0]) for j, v in enumerate(p) if v)
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, table, prior


def fit_classifier(counts: dict[tuple[str, tuple[int, ...], int], int], steps: int = 400, rate: float = 0.5) -> SpanClassifier:
    """Logistic regression per kind on votes and shape; targets are the posteriors of ``reliabilities``."""
    weights = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = {(p, s): c for (k, p, s), c in counts.items() if k == kind}
        by_votes: dict[tuple[int, ...], int] = {}
        for (p, _), c in own.items():
            by_votes[p] = by_votes.get(p, 0) + c
        post, _, _ = reliabilities(by_votes)
        size = 1 + 2 * len(LABELERS) + 6
        rows = []
        for (p, s), c in sorted(own.items()):
            on = [0] + [1 + 2 * j if v == 1 else 2 + 2 * j for j, v in enumerate(p) if v] + [1 + 2 * len(LABELERS) + s]
            rows.append((on, c, post[p]))
        whole = sum(c for _, c, _ in rows)
        w, grown = [0.0] * size, [1e-8] * size
        for _ in range(steps):
            g = [-1e-3 * x for x in w]
            for on, c, target in rows:
                gap = c / whole * (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in on))))))
                for i in on:
                    g[i] += gap
            grown = [a + x * x for a, x in zip(grown, g)]
            w = [a + rate * x / math.sqrt(b) for a, x, b in zip(w, g, grown)]
        weights[kind] = w
    return SpanClassifier(weights)


def _numbered(number: int, span: Column) -> Column:
    return F.struct(span["start"].alias("start"), F.lit(number).alias("k"), span["end"].alias("end"))


def _of_number(number: int, span: Column) -> Column:
    return span["k"] == number


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and classified further spans of whole texts, in code points: (doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, added) where ``added`` holds the further spans as structs.

    Base spans always stay; a further span is added if the classifier says so and it overlaps no base span. A null or
    empty text has no spans (base_sha256 is that of the empty string). Repeated rows get equal rows, a null id stays
    null. Only the two named columns are read. The classifier sees only vote counts, so ties and order do not matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for k, pattern in BASE.items():
        hint = F.lit(True) if MAY_HOLD[k] is None else F.contains("text", F.lit(MAY_HOLD[k]))
        rows = rows.withColumn(k, F.filter(located(F.col("text"), pattern, hint), partial(_is_valid, k)))
    wide = "|".join(f"(?:{p})" for p in CANDIDATES.values())
    rows = rows.withColumn("wide", located(F.col("text"), wide, F.col("text").rlike(_GUARD)))
    kinds = list(BASE) + list(CANDIDATES)
    base = F.array_sort(F.concat(*(F.transform(F.col(k), partial(_numbered, n)) for n, k in enumerate(BASE))))
    kind_of = lambda v: F.coalesce(*(F.when(v.rlike(f"^(?:{_bare(p)})$"), F.lit(k)) for k, p in CANDIDATES.items()), F.lit("number"))
    named = F.transform("wide", lambda x: F.struct(kind_of(x["value"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                                                   x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))
    rows = rows.withColumn("base", base).withColumn("named", named)
    free = F.filter("named", lambda c: ~F.exists("base", lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))
    cands = F.transform(free, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        _votes(c["kind"], c["value"], c["before"], c["after"]).alias("votes"), _shape(c["value"]).alias("shape")))
    found = cut_lineage(rows.select("doc_id", "base", cands.alias("cands")))

    counts = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n"))
    seen = {(r["kind"], tuple(r["votes"]), r["shape"]): r["n"] for r in counts.limit(MAX_PATTERNS).collect()}
    model = fit_classifier(seen)
    added = F.filter("cands", lambda c: model.score(c["kind"], c["votes"], c["shape"]) >= 0)
    number = F.create_map(*(F.lit(x) for n, k in enumerate(kinds) for x in (k, n)))
    names = F.array(*(F.lit(k) for k in kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"),
                                                                     x["end"].cast("string"))), ",")
    as_spans = F.transform("added", lambda c: F.struct(c["start"].alias("start"), F.element_at(number, c["kind"]).alias("k"), c["end"].alias("end")))
    out = found.withColumn("added", added)
    return out.select(
        "doc_id", *(F.size(F.filter("base", partial(_of_number, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", as_spans))).alias("spans"),
        F.transform("added", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("added"))


def _bare(pattern: str) -> str:
    """A candidate pattern without what it asks of its surroundings."""
    return re.sub(r"^\(\?<!(?:[^()\[\]]|\[[^\]]*\])*\)|\(\?!(?:[^()\[\]]|\[[^\]]*\])*\)$", "", pattern)
