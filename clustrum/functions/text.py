"""Text expressions. Lengths and positions count code points, white space is Unicode's."""
from __future__ import annotations

from collections.abc import Iterable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip or split treats as white space.
WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a pattern: one Unicode property test per character instead of one per member.
SPACE_PATTERN = r"(?U)[\s\x1c-\x1f]+"
# Fixed value: a word is two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
# What is between words and single characters; Arrow reads it as the SQL's engine does.
SEPARATOR = r"[^\p{L}\p{N}_]+"

# Short default list of French function words; pass a fuller one to the keyword operators.
FRENCH_STOP_WORDS = tuple(
    """
    alors au aucun aussi autre aux avant avec avoir bon car ce cela ces cette ceux chaque comme
    comment dans de des dedans dehors depuis deux devrait doit donc du elle elles en encore est et
    eu fait faites fois hors ici il ils je juste la le les leur là ma maintenant mais mes moi mon
    même ne ni nos notre nous on ou où par parce pas peut peu plupart pour pourquoi quand que quel
    quelle quelles quels qui sa sans se ses seulement si sien son sont sous soyez sur ta tandis
    tellement tels tes ton tous tout trop très tu un une vont vos votre vous vu ça étaient état
    étions été être
    """.split()
)


def clean_text(text: Column | str) -> Column:
    """Null becomes empty, anything else a string without surrounding white space."""
    column = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.coalesce(column.cast("string"), F.lit("")), F.lit(WHITESPACE))


def word_count(clean: Column) -> Column:
    """Number of white-space separated words of an already cleaned text; 0 when it is empty."""
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, SPACE_PATTERN)))


def text_digest(clean: Column) -> Column:
    return F.sha2(clean, 256)


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case words of two characters or more, stop words removed, in text order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    stop = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def stop_tokens(stop_words: Iterable[str]) -> list[str]:
    """Stop words cut the way the texts are, so that "aujourd'hui" stops both of its parts."""
    return sorted({t for w in stop_words for t in regex.findall(WORD_PATTERN, w.lower())})


def unigrams_and_bigrams(words: Column) -> Column:
    """Words, then pairs of neighbours in the (already filtered) sequence."""
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    leading = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(words, F.zip_with(leading, following, lambda a, b: F.concat_ws(" ", a, b)))


def trigrams(text: Column) -> Column:
    """All overlapping three-character pieces, found in three linear sweeps."""
    sweep = lambda start: F.regexp_extract_all(F.substring(text, start, 2147483647), F.lit("(?s).{3}"), F.lit(0))
    return F.concat(sweep(1), sweep(2), sweep(3))
