"""Column functions over text: tokens, filters and the texts built from them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import BY_LANGUAGE

# A token is a run of letters, digits and combining marks, or one other visible
# character. White space of any kind never becomes a token.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\s\x0B]"
PUNCTUATION_PATTERN = r"^\p{P}+$"
# The same tokens without punctuation, which is never part of a longer token.
WORD_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{P}\p{Z}\s\x0B]"
LANGUAGES = ("english", "french", "german", "spanish")
MAX_MODEL_TOKENS = 512
PREVIEW_CHARS = 200


@lru_cache(maxsize=None)
def stop_words(languages: tuple[str, ...] = LANGUAGES) -> tuple[str, ...]:
    """The lower-cased stop words of ``languages``, sorted, each once."""
    return tuple(sorted({w.lower() for name in languages for w in BY_LANGUAGE[name].split()}))


def tokenize(text: Column) -> Column:
    """Case-preserving tokens of ``text``, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def is_stop_word(token: Column) -> Column:
    return F.lower(token).isin(*stop_words())


def is_punctuation(token: Column) -> Column:
    return token.rlike(PUNCTUATION_PATTERN)


def drop_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_stop_word(t))


def drop_punctuation(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_punctuation(t))


def words(text: Column) -> Column:
    """``drop_punctuation(tokenize(text))`` in one pass of the pattern."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens that are neither stop words nor punctuation; used for both documents
    and questions so that the two sides always agree."""
    return drop_stop_words(words(text))


def first_chunk(chunks: Column) -> Column:
    """First text of a document's list, null when the list is empty."""
    return F.get(chunks, F.lit(0))


def joined_chunks(chunks: Column) -> Column:
    """All texts of a document's list, in order."""
    return F.concat_ws(" ", chunks)


def question_with_chunk(question: Column, chunks: Column) -> Column:
    return F.concat_ws(" ", question, first_chunk(chunks))


def truncate_tokens(text: Column, limit: int = MAX_MODEL_TOKENS) -> Column:
    """The first ``limit`` tokens, for models whose input has a length.

    Nothing else here needs it: hashed TF-IDF and the classifier take whole texts.
    """
    return F.slice(tokenize(text), 1, limit)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)
