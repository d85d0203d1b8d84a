"""Text measures as Column expressions: words, sentences, language, sentiment, topics.

All are built-in Spark expressions (higher-order functions over token arrays),
so they run inside codegen with no Python worker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.functions.lexicon import tokens

# Unicode whitespace as str.split()/str.strip() understand it.
WS = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)
SENTENCE_END = r"[.!?]+"

# Stop words per language (20 each) used by the language detector.
STOP_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "auf", "des", "für", "ist", "nicht",
           "dem", "im", "ein", "als", "eine"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as",
           "this", "are", "at", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con", "su", "una",
           "es", "para", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui", "par", "dans",
           "sur", "au", "pas", "avec"],
}

# Sentiment lexicon (multilingual, own selection).
POSITIVE_WORDS = ["good", "great", "excellent", "happy", "thanks", "thank", "helpful", "love", "wonderful", "glad",
                  "bien", "merci", "super", "gut", "danke", "gracias", "bueno", "excelente", "parfait", "toll"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "sad", "angry", "hate", "useless", "sorry", "wrong", "poor",
                  "mal", "triste", "schlecht", "leider", "malo", "nul", "horrible", "trash", "stupid", "idiot"]

# Topic lexicons for the lexical topic classifier.
TOPIC_WORDS = {
    "banking": ["account", "bank", "card", "credit", "loan", "payment", "balance", "transfer", "konto", "banque"],
    "support": ["help", "issue", "problem", "ticket", "support", "question", "answer", "hilfe", "aide", "ayuda"],
    "travel": ["flight", "hotel", "trip", "travel", "airport", "booking", "train", "reise", "voyage", "viaje"],
    "cooking": ["recipe", "cook", "oven", "salt", "sugar", "flour", "bake", "kochen", "cuisine", "cocina"],
    "sports": ["game", "team", "score", "match", "player", "goal", "ball", "spiel", "equipe", "partido"],
}


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WS + "+"), lambda w: w != F.lit("")))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(NON_WS)))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NON_WS)


def count_in(toks: Column, words) -> Column:
    """Occurrences of lexicon words among tokens (IN over literals becomes a hash-set probe)."""
    if not words:
        return F.lit(0)
    return F.size(F.filter(toks, lambda t: t.isin(*words)))


def detect_language(text: Column, stop_words=STOP_WORDS) -> Column:
    """Language with most stop-word tokens (ties → smaller code); NULL when no stop word occurs."""
    return detect_language_tokens(tokens(F.coalesce(text, F.lit(""))), stop_words)


def detect_language_tokens(toks: Column, stop_words=STOP_WORDS) -> Column:
    cands = F.array(*[F.struct((-count_in(toks, ws)).alias("k"), F.lit(code).alias("code"))
                      for code, ws in sorted(stop_words.items())])
    best = F.element_at(F.array_sort(cands), 1)
    return F.when(best["k"] < 0, best["code"])


def sentiment_compound(text: Column) -> Column:
    """(pos - neg) / (pos + neg) over lexicon tokens; 0 when neither occurs."""
    return sentiment_from_tokens(tokens(F.coalesce(text, F.lit(""))))


def sentiment_from_tokens(toks: Column) -> Column:
    p = count_in(toks, POSITIVE_WORDS).cast("double")
    n = count_in(toks, NEGATIVE_WORDS).cast("double")
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n) / (p + n))


def sum_cols(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)
