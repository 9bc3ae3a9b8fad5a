"""Full text: tokens with a stop list and a stemmer, web-style queries, rank.

The document is three token arrays in position order, by weight: title A, author B, summary C. Stemming follows the
published Porter algorithm's plural and suffix steps that matter for matching; parity with another engine's stemmer is not
a goal. A query never raises; one of stop words only matches nothing."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"a": 1.0, "b": 0.4, "c": 0.2}
TOKEN = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
#: The usual English contractions' stems appear as words of their own once apostrophes split them.
FRAGMENTS = ("s", "t", "don", "ll", "re", "ve", "d", "m")


def stop_words() -> frozenset[str]:
    """Spark's built-in English list; it needs a running session."""
    return frozenset(w for w in StopWordsRemover.loadDefaultStopWords("english") if _WORD.fullmatch(w)) | frozenset(FRAGMENTS)


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _measure(stem: str) -> int:
    return len(re.findall(r"(?:[aeiou]|(?<=[^aeiou])y)+(?:[^aeiouy]|(?<=[aeiou])y|^y)+", stem))


def stem(word: str) -> str:
    """Porter's steps 1a, 1b, 1c and the common suffixes of steps 2 to 5."""
    if len(word) <= 2 or not word.isascii():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _VOWEL.search(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", w):
                    w += "e"
                break
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for end, to in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("alli", "al"), ("ator", "ate"), ("izer", "ize"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("eli", "e")):
        if w.endswith(end):
            w = w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
            break
    for end, to in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
            break
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def plain_tokens(text: Column) -> Column:
    """Lower-case word tokens in order, without Python: no stop list, no stemming."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def stem_texts(texts: pd.Series, stops: frozenset[str]) -> pd.Series:
    """Each text's stemmed tokens, joined by spaces; each distinct word is stemmed once."""
    known: dict[str, str] = {}

    def one(m: re.Match) -> str:
        w = m[0]
        if w not in known:
            known[w] = "" if w in stops else f"{stem(w)} "
        return known[w]

    return texts.map(lambda x: "".join(map(one, _WORD.finditer((x or "").lower()))), na_action=None)


def stemmed_tokens(text: Column) -> Column:
    """Stemmed tokens without stop words; Arrow-batched. A text's tokens leave Python as one string: lists of a batch's
    words take many times the memory of its texts."""
    stops = stop_words()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return stem_texts(texts, stops)

    return F.filter(F.split(run(text), " "), lambda w: w != "")


def with_document(stories: DataFrame, stemmed: bool = False) -> DataFrame:
    """Adds doc_a, doc_b, doc_c."""
    tokens = stemmed_tokens if stemmed else plain_tokens
    return stories.withColumns({"doc_a": tokens(F.col("title")), "doc_b": tokens(F.col("author_name")), "doc_c": tokens(F.col("summary"))})


@dataclass(frozen=True)
class Term:
    """One word or phrase, perhaps negated."""

    words: tuple[str, ...]
    negated: bool = False


def parse_query(query: str, stemmed: bool = False, stops: frozenset[str] | None = None) -> list[list[Term]]:
    """A disjunction of conjunctions: words are joined by and, `or` separates, quotes hold phrases, - negates."""
    stops = frozenset() if not stemmed else stop_words() if stops is None else stops
    out: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', query or ""):
        if m[3] is not None and m[3].lower() == "or":
            out.append([])
            continue
        negated = bool(m[1]) if m[3] is None else m[3].startswith("-")
        words = [w for w in _WORD.findall((m[2] if m[3] is None else m[3]).lower()) if w not in stops]
        if words:
            out[-1].append(Term(tuple(stem(w) if stemmed else w for w in words), negated))
    return [x for x in out if x]


def _joined(part: str) -> Column:
    """A part's tokens, each between two spaces; a token holds no space."""
    return F.concat(F.lit(" "), F.array_join(F.col(f"doc_{part}"), " "), F.lit(" "))


def matches(query: str, stemmed: bool = False) -> Column:
    """Whether doc_a, doc_b or doc_c satisfy the query; a query without words matches nothing.

    The parts are one text, line by line, which a lambda's argument holds: a predicate on the token columns is moved below
    them, and each mention of a column would then find the tokens anew."""
    groups = parse_query(query, stemmed)
    if not groups:
        return F.lit(False)

    def holds(text: Column) -> Column:
        def term(t: Term) -> Column:
            found = F.contains(text, F.lit(f" {' '.join(t.words)} "))
            return ~found if t.negated else found

        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(term, g)) for g in groups])

    return F.exists(F.array(F.concat_ws("\n", *map(_joined, WEIGHTS))), holds)


def rank(query: str, stemmed: bool = False) -> Column:
    """The sum over the query's words of their weighted counts; negated terms do not count."""
    words = sorted({w for g in parse_query(query, stemmed) for t in g if not t.negated for w in t.words})
    if not words:
        return F.lit(0.0)
    tf = [F.size(F.filter(F.col(f"doc_{k}"), lambda x: x.isin(*words))) * F.lit(v) for k, v in WEIGHTS.items()]
    return F.round(reduce(lambda a, b: a + b, tf), 6)


def grams(x: Column) -> Column:
    """The distinct 3-grams of a lower-case text with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), F.lower(x), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def title_similarity(title: Column, wanted: str) -> Column:
    """Jaccard similarity of the 3-grams of two lower-case texts."""
    a, b = grams(title), grams(F.lit(wanted))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
