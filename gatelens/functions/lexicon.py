"""Lexicon-based Column functions (JVM-side, no Python per row).

Token splitting uses one rule everywhere: lower-case, split on any run of
characters that are not letters, digits or underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"

# Insult lexicon used by the labelled-document classifier fixture.
INSULT_WORDS = ["trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid"]

# Cue phrases and weights of the default lexical tier-2 scorer
# (a logistic model over phrase presence; authored for this library).
INJECTION_CUES = [
    ("ignore", 1.2), ("instructions", 1.0), ("system prompt", 1.6), ("pretend", 1.1),
    ("unrestricted", 1.5), ("no rules", 1.3), ("jailbreak", 1.4), ("bypass", 1.3),
    ("reveal", 0.9), ("developer mode", 1.5), ("evil", 0.8), ("anything now", 1.6),
    ("without any filter", 1.4), ("told before", 1.0), ("set aside", 0.8), ("void", 0.6),
]
INJECTION_BIAS = -3.0


def tokens(text: Column) -> Column:
    """Non-empty lower-case word tokens."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != F.lit(""))


def distinct_hits(text: Column, words) -> Column:
    """Number of distinct lexicon words present as whole tokens."""
    return F.size(F.array_intersect(tokens(text), F.array(*[F.lit(w) for w in words])))


def lexical_injection_prob(text: Column, cues=INJECTION_CUES, bias=INJECTION_BIAS) -> Column:
    """P(injection) = sigmoid(bias + sum of weights of cue phrases present), 6 dp."""
    low = F.lower(F.coalesce(text, F.lit("")))
    z = reduce(lambda a, b: a + b, [F.when(low.contains(c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in cues], F.lit(bias))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


def strict_parse_json(text: Column) -> Column:
    """VARIANT of ``text`` when it is exactly one JSON value (else NULL).

    ``try_parse_json`` stops after the first value and ignores what follows; wrapping the text in
    ``[...]`` and requiring a single element rejects trailing content, like a strict JSON parser.
    """
    w = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    # a lambda's argument is parsed once, however often it is used, also in a filter
    return F.get(F.transform(F.array(w), lambda v: F.when(
        v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))), F.lit(0))
