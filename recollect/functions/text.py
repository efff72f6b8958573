"""Index terms, token counts and truncation, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: all Unicode white space and the four ASCII separators (fixed values).
SPACE = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Words that are never index terms (fixed values).
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been "
    "before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers herself him himself his "
    "how i if in into is it its itself just me more most my myself no nor not now of off "
    "on once only or other our ours ourselves out over own same she should so some such "
    "than that the their theirs them themselves then there these they this those through "
    "to too under until up very was we were what when where which while who whom why "
    "will with would you your yours yourself yourselves i'm i've i'd i'll you're you've "
    "it's that's what's don't didn't doesn't isn't wasn't can't won't let's hey hi oh "
    "yeah yes ok okay really also"
).split()

#: A stem keeps this many letters; suffixes are tried in this order (fixed values).
LEAST = 3
SUFFIXES = ("ingly", "edly", "ing", "ed", "ly")


def _ends(word: Column, *suffixes: str) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found |= F.endswith(word, F.lit(s))
    return found


def _cut(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def singular(word: Column) -> Column:
    """The word without a plural or third-person ending."""
    n = F.length(word)
    return (
        F.when(_ends(word, "ies") & (n - 3 >= LEAST), F.concat(_cut(word, 3), F.lit("y")))
        .when(_ends(word, "es") & (n - 2 >= LEAST), F.when(_ends(word, "ses", "xes", "zes", "ches", "shes"), _cut(word, 2)).otherwise(_cut(word, 1)))
        .when(_ends(word, "s") & ~_ends(word, "ss", "us", "is") & (n > LEAST), _cut(word, 1))
        .otherwise(word)
    )


def uninflected(word: Column) -> Column:
    """(root, suffix): the word without the first tense or adverb ending that leaves enough."""
    n = F.length(word)
    pair = lambda root, suffix: F.struct(root.alias("root"), F.lit(suffix).alias("suffix"))
    out = F.when(_ends(word, "ied") & (n - 3 >= LEAST), pair(F.concat(_cut(word, 3), F.lit("y")), "ied"))
    for suffix in SUFFIXES:
        root = _cut(word, len(suffix))
        if suffix in ("ing", "ed"):
            last = F.right(root, F.lit(1))
            twice = (F.length(root) > LEAST) & (F.right(root, F.lit(2)) == F.concat(last, last)) & ~last.isin("l", "s", "z", "e", "o")
            root = F.when(twice, _cut(root, 1)).otherwise(root)
        out = out.when(_ends(word, suffix) & (n - len(suffix) >= LEAST), pair(root, suffix))
    return out.otherwise(pair(word, ""))


def _may_change(word: Column) -> Column:
    """Whether a word is long enough and ends in a letter that any of the rules looks for; most words do not."""
    return (F.length(word) > LEAST) & F.right(word, F.lit(1)).isin("d", "e", "g", "s", "y")


def stems(words: Column) -> Column:
    """The stem of each word of an array; short words and numbers are left alone."""
    single = F.transform(words, lambda w: F.struct(w.alias("word"), F.when(_may_change(w), singular(w)).alias("one")))
    rooted = F.transform(single, lambda s: F.struct(s["word"].alias("word"), F.when(s["one"].isNotNull(), uninflected(s["one"])).alias("u")))

    def last(s: Column) -> Column:
        root = s["u"]["root"]
        bare = F.when(~F.startswith(s["u"]["suffix"], F.lit("ed")) & _ends(root, "e") & (F.length(root) > LEAST), _cut(root, 1)).otherwise(root)
        return F.when(s["u"].isNull() | s["word"].rlike("^[0-9]+$"), s["word"]).otherwise(bare)

    return F.transform(rooted, last)


def terms(text: Column) -> Column:
    """The index terms of a text: lower-case ASCII words, without stop words, stemmed.

    Letters outside ASCII separate words. Null gives null, text without words an empty array.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))
    bare = F.transform(words, lambda w: F.regexp_replace(w, "'s$", ""))
    return stems(F.filter(bare, lambda w: ~w.isin(*STOPWORDS)))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[A-Za-z]+|[0-9]+|[^{SPACE}A-Za-z0-9]"), F.lit(0))


def _cost(piece: Column) -> Column:
    n = F.length(piece)
    letters = F.when(n <= 8, F.lit(1)).otherwise(1 + F.floor((n - 4) / 5).cast("int"))
    return F.when(piece.rlike("^[A-Za-z]"), letters).when(piece.rlike("^[0-9]"), F.floor((n + 2) / 3).cast("int")).otherwise(F.lit(1))


def count_tokens(text: Column) -> Column:
    """About how many tokens a language model sees: 1 for each mark, for each three digits and
    each word of up to eight letters, and 1 more for each further five letters."""
    return F.aggregate(_pieces(text), F.lit(0), lambda n, p: n + _cost(p))


def truncated(text: Column, most: int) -> Column:
    """The text if it costs up to ``most`` tokens, else its longest word prefix with " …" that does."""
    if most <= 0:
        raise ValueError(f"a text is cut to a positive number of tokens, not {most}")
    return F.when(count_tokens(text) <= most, text).otherwise(cut_words(text, F.lit(most)))


def words(text: Column) -> Column:
    """What white space separates, without empty strings."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def cut_words(text: Column, most: Column) -> Column:
    """The longest run of first words that costs up to ``most`` tokens together with " …"."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, w: Column) -> Column:
        used = s["used"] + count_tokens(w)
        fits = s["open"] & (used + 1 <= most)
        return F.struct(F.when(fits, used).otherwise(s["used"]).alias("used"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open"))

    kept = F.aggregate(words(text), start, step, lambda s: s["n"])
    return F.concat(F.array_join(F.slice(words(text), F.lit(1), kept), " "), F.lit(" …"))


def fact_key(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{SPACE}]+", " "))
