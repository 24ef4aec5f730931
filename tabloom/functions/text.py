"""Text expressions over one column. All stay in the JVM and need no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from .names import WHITESPACE_CLASS, WHITESPACE_RUN

# Fixed value: the 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# A run of word characters (letters, marks, digits, underscore) of any script, or one other mark.
TOKEN_PATTERN = f"(?U)(\\w+|[^\\w{WHITESPACE_CLASS}])"

CLEANING_METHODS = (
    "remove_punctuation",
    "standardize_letter_case",
    "remove_stop_words",
    "lemmatize_each_word",
)


def words(c: Column | str) -> Column:
    """Split on white space of any script; blank pieces are dropped."""
    return F.filter(F.split(c, WHITESPACE_RUN), lambda w: w != "")


def lower_case(c: Column | str) -> Column:
    return F.lower(c)


def tokenize(c: Column | str) -> Column:
    """Word runs and single marks. Contractions are not split into parts."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(1))


def _stripped(word: Column) -> Column:
    return F.translate(word, PUNCTUATION, "")


def strip_punctuation(tokens: Column | str) -> Column:
    """Drop ASCII marks inside every token; a token left empty stays in place."""
    return F.transform(tokens, _stripped)


def drop_stop_words(tokens: Column | str, stop: Iterable[str], lowered: bool = False) -> Column:
    """Keep tokens whose lower form is not in the list (a hash lookup per token)."""
    stop = sorted(set(stop))
    return F.filter(tokens, lambda w: ~(w if lowered else F.lower(w)).isin(stop))


def drop_stop_words_by_language(
    tokens: Column | str, language: Column | str, lists: Mapping[str, Iterable[str]], lowered: bool = False
) -> Column:
    """As ``drop_stop_words`` with the list picked per row; other languages keep all tokens."""
    language = F.col(language) if isinstance(language, str) else language
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    picked = None
    for code, stop in lists.items():
        kept = drop_stop_words(tokens, stop, lowered)
        picked = F.when(language == code, kept) if picked is None else picked.when(language == code, kept)
    return tokens if picked is None else picked.otherwise(tokens)


def lemmatize(tokens: Column | str, lexicon: Mapping[str, str], lowered: bool = False) -> Column:
    """Lower-case every token and replace the known forms.

    For lexicons that fit in an expression. ``operators.features.lemmatize_with_table``
    takes a lexicon of any size.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    low = tokens if lowered else F.transform(tokens, F.lower)
    if not lexicon:
        return low
    forms = sorted(lexicon)
    table = F.map_from_arrays(F.lit(forms), F.lit([lexicon[f] for f in forms]))
    return F.transform(low, lambda w: F.when(w.isin(forms), F.element_at(table, w)).otherwise(w))


def clean_text(
    c: Column | str,
    methods: Iterable[str],
    stop: Iterable[str] | Mapping[str, Iterable[str]] = (),
    language: Column | str | None = None,
    lexicon: Mapping[str, str] | None = None,
) -> Column:
    """The cleaning chain, always in the order of ``CLEANING_METHODS``.

    ``stop`` is one list, or a mapping from language to list used with ``language``.
    Tokens are joined by one space, so emptied tokens leave double spaces.
    """
    methods = set(methods)
    unknown = methods - set(CLEANING_METHODS)
    if unknown:
        raise ValueError(f"unknown cleaning methods: {sorted(unknown)}")
    lowered = "standardize_letter_case" in methods
    tokens = tokenize(c)
    if "remove_punctuation" in methods and lowered:
        tokens = F.transform(tokens, lambda w: F.lower(_stripped(w)))
    elif "remove_punctuation" in methods:
        tokens = strip_punctuation(tokens)
    elif lowered:
        tokens = F.transform(tokens, F.lower)
    if "remove_stop_words" in methods:
        if isinstance(stop, Mapping):
            tokens = drop_stop_words_by_language(tokens, language, stop, lowered)
        else:
            tokens = drop_stop_words(tokens, stop, lowered)
    if "lemmatize_each_word" in methods:
        tokens = lemmatize(tokens, lexicon or {}, lowered)
    return F.array_join(tokens, " ")

