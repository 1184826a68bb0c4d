"""Tokens, n-grams, sentences and fields of a text, as Column expressions.

All of them stay inside the JVM. Null texts are taken as ''. Where bytes count,
n-grams are given as upper-case hex of their UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z0-9_]+"
BOUNDED_WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+"
SENTENCE_WORD = r"[0-9A-Za-z_'\-\x{80}-\x{10FFFF}]+"
SENTENCE_END = r"[.!?]+|\n\n"

KEYPHRASE_STOPWORDS = tuple(
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might can shall this that these those it its they them we us he she his her their our my your not no nor "
    "so as if than then also very just about into over after before between under during without".split()
)
BIOMEDICAL_SUFFIXES = tuple(
    "ase blast cillin conazole cycline cyte dase dopa ectomy emia floxacin gen genic gram graphy iasis itis lide lone lysis mab mer mycin "
    "olol ology oma osis otomy parin pathy penia phage pine plasty pril sartan scopy some sone statin tide toxin uria vir zole".split()
)
ENTITY_WORD = r'[^ \t\n\x0B\f\r.,;:!?()"]+'


def text_of(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column | str) -> Column:
    """Runs of ASCII letters, digits and _, as written."""
    return F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))


def terms(text: Column | str) -> Column:
    """The same, folded: what the index holds. Folding comes after the split, since lower() can turn a non-ASCII letter into an ASCII one."""
    return F.transform(words(text), F.lower)


def ascii_fold(text: Column | str) -> Column:
    """Lower case for A to Z only."""
    return F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, f) -> Column:
    """f of a value that is computed once; inside a lambda an outer expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _byte_windows(raw: Column, k: int) -> Column:
    """The windows of k bytes of a binary, as hex; substring of a binary takes constant time, of a string it doesn't."""
    n = F.octet_length(raw)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.hex(F.substring(raw, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def byte_ngrams(text: Column | str, least: int = 3, most: int = 5) -> Column:
    """Every window of ``least`` to ``most`` bytes of the whole text, spaces included."""
    return let(F.encode(text_of(text), "UTF-8"), lambda raw: F.concat(*[_byte_windows(raw, k) for k in range(least, most + 1)]))


def bounded_ngrams(text: Column | str, least: int = 3, most: int = 5) -> Column:
    """Byte n-grams of each word written as <word>; no n-gram crosses a word."""

    def of(word: Column) -> Column:
        return let(F.encode(F.concat(F.lit("<"), word, F.lit(">")), "UTF-8"), lambda raw: F.concat(*[_byte_windows(raw, k) for k in range(least, most + 1)]))

    return F.flatten(F.transform(F.regexp_extract_all(text_of(text), F.lit(BOUNDED_WORD), F.lit(0)), of))


def _windows(term: Column, k: int) -> Column:
    n = F.length(term)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(term, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def grams_of(term: Column, least: int = 3, most: int = 4) -> Column:
    """Character n-grams inside one (ASCII) term."""
    return F.concat(*[_windows(term, k) for k in range(least, most + 1)])


def term_grams(tokens: Column, least: int = 3, most: int = 4) -> Column:
    """Character n-grams of all terms of a document, with repeats."""
    return F.flatten(F.transform(tokens, lambda t: grams_of(t, least, most)))


def _pairs(tokens: Column, distance: int, join) -> Column:
    """The pairs of tokens that stand ``distance`` apart."""
    n = F.greatest(F.size(tokens) - distance, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(distance + 1), n), join)


def ordered_bigrams(tokens: Column) -> Column:
    """'a b' for each two neighbours."""
    return _pairs(tokens, 1, lambda a, b: F.concat(a, F.lit(" "), b))


def unordered_bigrams(tokens: Column, window: int = 8) -> Column:
    """'lesser greater' for each two tokens at most ``window`` positions apart; equal words count too."""
    return F.concat(*[_pairs(tokens, d, lambda a, b: F.concat(F.least(a, b), F.lit(" "), F.greatest(a, b))) for d in range(1, window + 1)])


def lead_tokens(text: Column | str, n: int = 64) -> Column:
    """The first n tokens between white space; each white-space byte before the last of them becomes a space."""
    head = F.regexp_extract(text_of(text), rf"^[ \t\n\x0B\f\r]*(?:[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]+){{0,{n - 1}}}[^ \t\n\x0B\f\r]+", 0)
    return F.regexp_replace(head, r"[\t\n\x0B\f\r]", " ")


def sentences(text: Column | str, most: int | None = None) -> Column:
    """Sentences between runs of . ! ? or blank lines, without control characters and spaces at their ends."""
    parts = F.filter(F.transform(F.split(text_of(text), SENTENCE_END), lambda s: F.regexp_replace(s, r"^[\x01-\x20]+|[\x01-\x20]+$", "")), lambda s: s != "")
    return parts if most is None else F.slice(parts, 1, most)


def sentence_tokens(sentence: Column | str, most: int = 60) -> Column:
    """The first distinct folded tokens of two bytes or more."""
    found = F.transform(F.regexp_extract_all(text_of(sentence), F.lit(SENTENCE_WORD), F.lit(0)), ascii_fold)
    return F.slice(F.array_distinct(F.filter(found, lambda t: F.octet_length(t) >= 2)), 1, most)


def keyphrases(text: Column | str) -> Column:
    """Distinct lower-case words of two ASCII letters or more that aren't stopwords, sorted."""
    found = F.transform(F.regexp_extract_all(text_of(text), F.lit("[A-Za-z]{2,}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*map(F.lit, KEYPHRASE_STOPWORDS)))))


def entities(text: Column | str, most: int = 32) -> Column:
    """Words with a biomedical suffix, words in capitals, and measurements, in the order of the text; repeats stay."""
    suffix = "[A-Za-z](?:" + "|".join(BIOMEDICAL_SUFFIXES) + r")\z"
    found = F.regexp_extract_all(text_of(text), F.lit(ENTITY_WORD), F.lit(0))
    biomedical = lambda w: (F.octet_length(w) >= 5) & w.rlike(suffix)
    capitals = lambda w: (F.octet_length(w) >= 2) & w.rlike(r"\A[^a-z]*[A-Z][^a-z]*\z")
    return F.slice(F.filter(found, lambda w: biomedical(w) | capitals(w) | w.rlike(r"\A[0-9]+[A-Za-z%]")), 1, most)


def sections(text: Column | str, lines: int = 16, most: int = 16_384) -> Column:
    """Structs (line, header) of the first lines: a header has a letter and 1 to 8 words after its numbering, and is all in capitals or under 80 bytes."""
    t = text_of(text)
    head = F.slice(F.split(F.substring(t, 1, most), "\n"), 1, lines)

    def judged(line: Column) -> Column:
        bare = F.regexp_replace(line, r"\A[ \t\x0B\f\r]*[0-9. ]*", "")
        count = F.size(F.regexp_extract_all(bare, F.lit(r"[^ \t\x0B\f\r]+"), F.lit(0)))
        header = bare.rlike("[A-Za-z]") & (count <= 8) & (~bare.rlike("[a-z]") | (F.octet_length(bare) < 80))
        return F.struct(line.alias("line"), header.alias("header"))

    return F.transform(head, judged)


def aux_field(text: Column | str, most: int = 512) -> Column:
    """The lines before the first header, until they make up half of ``most`` characters, then the lines that follow it and are no headers; ``most`` in all."""
    found = sections(text)
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("past"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        takes = (s["line"] != "") & ~s["header"] & (acc["past"] | ~acc["full"])
        joined = F.when(takes, F.when(acc["out"] == "", s["line"]).otherwise(F.concat(acc["out"], F.lit(" "), s["line"]))).otherwise(acc["out"])
        full = acc["full"] | (~acc["past"] & ~s["header"] & (F.length(joined) >= most // 2))
        return F.struct(joined.alias("out"), (acc["past"] | s["header"]).alias("past"), full.alias("full"))

    return F.aggregate(found, start, step, lambda acc: F.substring(acc["out"], 1, most))
