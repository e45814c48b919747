"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no important query terms.
STOPWORDS = (
    "a an and are as at be before for from how i in is it of on or over should so the to what where which with"
).split()
#: Pattern of a token after lower-casing; full stops inside and after it belong to it.
TOKEN = "[a-z0-9][a-z0-9.]*"


def stem(token: Column) -> Column:
    """Plural endings off: -ies to -y above 4 letters, -s but not -ss above 3."""
    n = F.length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def stem_word(w: str) -> str:
    """stem() of one token."""
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def raw_tokens(text: Column) -> Column:
    """Tokens in order, not stemmed; _, - and / separate."""
    return F.regexp_extract_all(F.translate(F.lower(text), "_-/", "   "), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Stemmed tokens in order."""
    return F.transform(raw_tokens(text), lambda w: stem(w))


def phrase_text(text: Column) -> Column:
    """A field as its tokens with single spaces, to look for phrases in."""
    return F.array_join(tokens(text), " ")


def important(terms: Column) -> Column:
    """Terms of two letters or more that are no stopwords; repeats stay."""
    return F.filter(terms, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def phrases(terms: Column, longest: int = 5) -> Column:
    """Distinct runs of 2 to 5 terms, longest first, then by position."""
    n = F.size(terms)
    widths = F.filter(F.array(*map(F.lit, range(longest, 1, -1))), lambda w: w <= n)
    runs = F.transform(
        widths, lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda at: F.array_join(F.slice(terms, at, w), " "))
    )
    return F.array_distinct(F.flatten(runs))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def last_words(text: Column, n: int) -> Column:
    """The last n words with single spaces."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ")


def slug(text: Column) -> Column:
    """Lower case, other than letters and digits as one _, none at the ends; `chunk` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "chunk").otherwise(out)


def xml_attr(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def occurrences(text: Column, needle: Column | str) -> Column:
    """How often a needle occurs, without overlaps."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def has_any(text: Column, needles) -> Column:
    """Whether any of the needles occurs in a lower-cased text."""
    found = F.lit(False)
    for n in needles:
        found = found | text.contains(n)
    return found
