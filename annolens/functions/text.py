"""Style measures, identifiers and hashes of texts: Column -> Column, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and bounds that results depend on.
WORD = r"[a-z]+(?:['-][a-z]+)*|[0-9]+"
SENTENCE_END = r"[.!?]+(?:\s|$)"
PARAGRAPH_END = r"\n\s*\n"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
CODE_SHAPE = r"_|^[A-Z0-9]*[A-Z][A-Z0-9]*$|[a-z][A-Z]"
EXAMPLE = r"\be\.g\.|\b(examples?|for instance|such as)\b"
RATIONALE = r"\b(because|otherwise|so that|in order to|avoid|prevent|ensure|reason|necessary|required|cannot|must)\b"
GENERATED = r"generated (file|code)|do not edit"
LENGTH_BANDS = {"short": (20, 49), "medium": (50, 99), "long": (100, 300)}
# Everything that counts as white space in Unicode, and the four separators of ASCII.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# A character of no text, which stands for a word.
MARK = "\ufdd0"
LONG_WORD = 9
ALPHA_RATIO = 0.45

MEASURES = (
    "word_count", "sentence_count", "paragraph_count", "words_per_paragraph", "max_sentence_words", "words_per_sentence", "mean_word_length",
    "long_word_fraction", "hyphenated_words", "semicolons", "parentheses", "repeated_bigram_fraction", "lexical_diversity",
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x.rlike(r"\S"))


def sentences(text: Column) -> Column:
    return _pieces(text, SENTENCE_END)


def paragraphs(text: Column) -> Column:
    return _pieces(text, PARAGRAPH_END)


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def at_least_one(n: Column) -> Column:
    return F.greatest(F.lit(1), n)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of an array of words."""
    return F.transform(F.slice(tokens, 1, F.greatest(F.lit(0), F.size(tokens) - 1)), lambda w, k: F.concat_ws(" ", w, F.get(tokens, k + 1)))


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence. Each word becomes one mark before the text is cut, so words are looked for once and what is cut is short."""
    marked = F.regexp_replace(F.lower(text), WORD, MARK)
    return F.transform(_pieces(marked, SENTENCE_END), lambda s: F.length(s) - F.length(F.replace(s, F.lit(MARK), F.lit(""))))


def measures(tokens: Column, text: Column, lengths: Column, paras: Column) -> list[Column]:
    """The thirteen measures of a text, from its words, the lengths of its sentences and the number of its paragraphs, computed before."""
    n = F.size(tokens)
    # Pairs are told apart by 64-bit hashes, which in one text meet by chance in fewer than one of ten billion texts of 20,000 words.
    pairs = F.transform(F.slice(tokens, 1, F.greatest(F.lit(0), n - 1)), lambda w, k: F.xxhash64(w, F.get(tokens, k + 1)))
    letters = F.length(F.array_join(tokens, "")).cast("long")
    values = [
        n,
        F.size(lengths),
        paras,
        n / at_least_one(paras),
        F.coalesce(F.array_max(lengths), F.lit(0)),
        n / at_least_one(F.size(lengths)),
        letters / at_least_one(n),
        F.size(F.filter(tokens, lambda w: F.length(w) >= LONG_WORD)) / at_least_one(n),
        F.size(F.filter(tokens, lambda w: F.contains(w, F.lit("-")))),
        count_of(text, ";"),
        count_of(text, "("),
        (F.greatest(F.lit(0), n - 1) - F.size(F.array_distinct(pairs))) / at_least_one(n - 1),
        F.size(F.array_distinct(tokens)) / at_least_one(n),
    ]
    return [v.alias(name) for v, name in zip(values, MEASURES, strict=True)]


def length_band(n: Column, strict: bool = False) -> Column:
    """short, medium or long by word count; outside of them below or above, or an error if strict."""
    band = None
    for name, (low, high) in LENGTH_BANDS.items():
        hit = n.between(low, high)
        band = F.when(hit, name) if band is None else band.when(hit, name)
    lowest = min(low for low, _ in LENGTH_BANDS.values())
    if strict:
        return band.otherwise(F.raise_error(F.concat(F.lit("no length band for "), n.cast("string"))))
    return band.when(n < lowest, "below").otherwise("above")


def functional_class(text: Column) -> Column:
    return F.when(text.rlike(f"(?i){EXAMPLE}"), "example").when(text.rlike(f"(?i){RATIONALE}"), "rationale").otherwise("mechanism")


def tokens_like_identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def code_shaped(token: Column) -> Column:
    """An underscore, several characters all in capitals, or a capital after a small letter."""
    return F.contains(token, F.lit("_")) | ((F.length(token) > 1) & token.rlike(r"^[A-Z0-9]*[A-Z][A-Z0-9]*$")) | token.rlike("[a-z][A-Z]")


def identifiers(text: Column) -> Column:
    """Distinct code-shaped identifiers."""
    return F.array_distinct(F.filter(tokens_like_identifiers(text), code_shaped))


def alpha_ratio(text: Column) -> Column:
    """Letters per character that is not white space; null for blank texts."""
    compact = F.regexp_replace(text, r"\s+", "")
    return F.try_divide(F.length(F.regexp_replace(compact, r"\P{L}", "")), F.length(compact))


def eligible(text: Column) -> Column:
    """Not blank, not a to-do mark, not generated, and mostly letters."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (F.length(bare) > 0) & ~F.upper(bare).rlike("^(TODO|FIXME|XXX)") & ~bare.rlike(f"(?i){GENERATED}") & (F.coalesce(alpha_ratio(text), F.lit(0.0)) >= ALPHA_RATIO)


def normalise(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    # A single blank between words stays as it is, so most texts are searched and not rewritten.
    return F.trim(F.regexp_replace(text, f"(?! ){SPACE}{SPACE}*| {SPACE}+", " "))


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """The first 32 bits of SHA-256, modulo a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % buckets


def hash_split(text: Column) -> Column:
    """Half train, a quarter validation, a quarter test, by hash."""
    b = hash_bucket(text)
    return F.when(b < 50, "train").when(b < 75, "validation").otherwise("test")


def order_hash(*parts: Column) -> Column:
    """SHA-256 of colon-joined parts: an order that does not depend on how rows are stored."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def context_slice(text: Column, line: int | Column, before: int, after: int) -> Column:
    """The lines from `before` above a line to `after` from it on, clamped to the text."""
    lines = F.split(text, "\n")
    at = F.lit(line) if isinstance(line, int) else line
    first = F.greatest(F.lit(0), at - 1 - before)
    return F.array_join(F.slice(lines, first + 1, F.greatest(F.lit(0), F.least(F.size(lines), at + after) - first)), "\n")


def masked(text: Column, start: Column, end: Column, marker: str) -> Column:
    """A span (0-based, end exclusive) replaced by a marker."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit(marker), F.substring(text, end + 1, F.length(text)))
