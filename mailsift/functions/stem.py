"""The Snowball English stemmer (Porter 2), applied to token arrays in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

# Fixed values of the published algorithm: irregular words, words left alone after step 1a, and the suffix
# tables of steps 2 to 4 (suffix -> replacement).
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky",
    "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
    "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "", "ative": "",
}
STEP_4 = {
    suffix: "" for suffix in (
        "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti",
        "ous", "ive", "ize", "ion")
}
VOWELS = frozenset("aeiouy")
LONG_HEADS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_LETTERS = frozenset("cdeghkmnrt")
CACHE_WORDS = 1_000_000
SYLLABLE = re.compile("[aeiouy][^aeiouy]")
HARD_Y = re.compile("(^|[aeiouy])y")


def _region(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    found = SYLLABLE.search(word, start)
    return found.end() if found else len(word)


def _ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return (len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS
            and word[-1] not in "wxY")


def _sorted_by_length(suffixes) -> tuple[frozenset, frozenset, tuple[int, ...]]:
    """The suffixes, their last letters, and their lengths from the longest."""
    return frozenset(suffixes), frozenset(s[-1] for s in suffixes), tuple(sorted({len(s) for s in suffixes}, reverse=True))


def _longest(word: str, endings: tuple[frozenset, frozenset, tuple[int, ...]]) -> str:
    suffixes, last_letters, lengths = endings
    if word[-1:] in last_letters:
        for n in lengths:
            if word[-n:] in suffixes:
                return word[-n:]
    return ""


PLURALS = _sorted_by_length(("sses", "ied", "ies", "us", "ss", "s"))
PASTS = _sorted_by_length(("eedly", "eed", "ingly", "ing", "edly", "ed"))
ENDINGS_2, ENDINGS_3, ENDINGS_4 = (_sorted_by_length(table) for table in (STEP_2, STEP_3, STEP_4))


def _has_vowel(text: str) -> bool:
    return not VOWELS.isdisjoint(text)


def _plural(word: str) -> str:
    end = _longest(word, PLURALS)
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and _has_vowel(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    end = _longest(word, PASTS)
    cut = word[:len(word) - len(end)]
    if end.startswith("eed"):
        return cut + "ee" if len(cut) >= r1 else word
    if not end or not _has_vowel(cut):
        return word
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if cut.endswith(DOUBLES):
        return cut[:-1]
    return cut + "e" if len(cut) <= r1 and _ends_short(cut) else cut


def _replace(word: str, table: dict[str, str], endings, region: int, allowed) -> str:
    end = _longest(word, endings)
    cut = word[:len(word) - len(end)]
    return cut + table[end] if end and len(cut) >= region and allowed(end, cut) else word


def stem_word(word: str) -> str:
    """Stem of one lower-case a-z word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = HARD_Y.sub(r"\1Y", word) if "y" in word else word
    r1 = next((len(head) for head in LONG_HEADS if w.startswith(head)), None) or _region(w, 0)
    r2 = _region(w, r1)
    w = _plural(w)
    if w not in LEFT_ALONE:
        w = _past(w, r1)
        if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
            w = w[:-1] + "i"
        w = _replace(w, STEP_2, ENDINGS_2, r1, lambda end, cut: (
            cut.endswith("l") if end == "ogi" else cut[-1:] in LI_LETTERS if end == "li" else True))
        w = _replace(w, STEP_3, ENDINGS_3, r1, lambda end, cut: end != "ative" or len(cut) >= r2)
        w = _replace(w, STEP_4, ENDINGS_4, r2, lambda end, cut: end != "ion" or cut.endswith(("s", "t")))
        cut = w[:-1]
        if w.endswith("e"):
            w = cut if len(cut) >= r2 or (len(cut) >= r1 and not _ends_short(cut)) else w
        elif w.endswith("ll") and len(cut) >= r2:
            w = cut
    return w.replace("Y", "y")


def _stems(words: list[str], known: dict[str, str]) -> list[str]:
    """The stems of distinct words; those that the task has met before are looked up."""
    if len(known) > CACHE_WORDS:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = stem_word(word)
    return [known[word] for word in words]


def stem_tokens(df: DataFrame, column: str) -> DataFrame:
    """Replace the words of a token array by their stems.

    Arrow batches are dictionary-encoded, so Python sees each distinct word of a batch once, and only those that the
    task has not stemmed before.
    """
    place = df.columns.index(column)

    def stem_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            lists = batch.column(place)
            words = lists.flatten().dictionary_encode()
            values = pa.array(_stems(words.dictionary.to_pylist(), known), pa.string()).take(words.indices)
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            columns = batch.columns
            columns[place] = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(stem_batches, df.schema)


def count_tokens(df: DataFrame, column: str, stem: bool = True) -> DataFrame:
    """Replace a token array by its `length` and its distinct words, stemmed if wanted, with their number:
    `words` (term, tf).  Words are counted where their row is, so none is shuffled."""
    place = df.columns.index(column)
    names = [c for c in df.columns if c != column]

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            lists = batch.column(place)
            words = lists.flatten().dictionary_encode()
            terms = words.dictionary.to_pylist()
            numbers: dict[str, int] = {}
            codes = np.array([numbers.setdefault(t, len(numbers)) for t in (_stems(terms, known) if stem else terms)], np.int64)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(np.arange(len(lengths)), lengths)
            of_word = codes[words.indices.to_numpy(zero_copy_only=False)] if len(rows) else rows
            pairs, counts = np.unique(rows * max(1, len(numbers)) + of_word, return_counts=True)
            row, code = np.divmod(pairs, max(1, len(numbers)))
            pieces = pa.StructArray.from_arrays(
                [pa.array(list(numbers), pa.string()).take(pa.array(code)), pa.array(counts.astype(np.int64))], names=["term", "tf"])
            ends = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(lengths), pa.ListArray.from_arrays(ends, pieces)],
                names=[*names, "length", "words"])

    kept = T.StructType([f for f in df.schema.fields if f.name != column])
    counted = kept.add("length", "long").add("words", T.ArrayType(T.StructType().add("term", "string").add("tf", "long")))
    return df.mapInArrow(count_batches, counted)
