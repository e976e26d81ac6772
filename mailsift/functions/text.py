"""Column expressions over document and query text.  All of them stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import constants as C
from .clean import strip, text_or_empty


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once, however often the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _fold_table() -> tuple[str, str]:
    """Lower-case letters that decompose to an ASCII letter, and those letters; combining marks go last."""
    accented, plain = [], []
    for code in range(0xC0, 0x1F00):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter == letter.lower() and base != letter and base.isascii() and base.isalpha():
            accented.append(letter)
            plain.append(base)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(accented + marks), "".join(plain)


ACCENTED, PLAIN = _fold_table()


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def index_tokens(c: Column, stop_words=C.STOP_WORDS) -> Column:
    """Runs of a-z in the folded text, stop words left out, in text order."""
    words = F.split(fold(c), "[^a-z]+")
    return F.filter(words, lambda w: ~w.isin("", *stop_words))


def squeeze(c: Column) -> Column:
    """White space runs become one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def _trim_edges(c: Column) -> Column:
    edge = "[" + "".join("\\" + ch for ch in C.EDGE_PUNCTUATION) + "]+"
    return F.regexp_replace(squeeze(c), f"^{edge}|{edge}$", "")


def compact(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _matches(c: Column, pattern: str, group: int = 0, flags: str = "(?iU)") -> Column:
    return F.regexp_extract_all(c, F.lit(flags + pattern), F.lit(group))


def _distinct_filled(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def query_terms(c: Column, stop_words=C.QUERY_STOP_WORDS) -> Column:
    """Words of a query longer than two characters, without connecting words, first occurrence kept."""
    words = _matches(text_or_empty(c), C.QUERY_TERM, flags="")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*stop_words)))


def code_variants(c: Column) -> Column:
    """Spellings of every letters-digits code in the text: as written, and joined by `-`, `/`, `_`, blank, nothing."""
    text = text_or_empty(c)
    found = F.arrays_zip(
        _matches(text, C.CODE).alias("whole"),
        _matches(text, C.CODE, 1).alias("letters"),
        _matches(text, C.CODE, 2).alias("digits"),
    )
    spelled = F.flatten(F.transform(found, lambda m: F.concat(
        F.array(_trim_edges(m["whole"])),
        F.transform(F.array(*[F.lit(s) for s in ("-", "/", "_", " ", "")]),
                    lambda sep: F.concat(m["letters"], sep, m["digits"])),
    )))
    return _distinct_filled(spelled)


def identifier_variants(c: Column) -> Column:
    """The text, its compact form, and every code spelling with its compact form."""
    text = _trim_edges(text_or_empty(c))
    return _distinct_filled(F.flatten(F.transform(
        F.concat(F.array(text), code_variants(text)), lambda v: F.array(v, compact(v)))))


def identifier_terms(c: Column, limit: int = C.MAX_IDENTIFIER_TERMS) -> Column:
    """Identifier-like parts of a query with all their spellings; empty when the query names no identifier."""
    none = F.array().cast("array<string>")

    def seeds(text: Column) -> Column:
        marked_words = F.filter(query_terms(text), lambda w: w.rlike(r"(?U)[\d/-]"))
        return bind(code_variants(text), lambda codes: F.concat(
            codes, F.when(F.size(codes) == 0, _matches(text, C.LONG_NUMBER)).otherwise(none),
            _matches(text, C.JOINED_CODE), _matches(text, C.LETTER_DIGIT_CODE), _matches(text, C.PREFIXED_CODE),
            marked_words))

    found = F.transform(F.array_distinct(bind(strip(text_or_empty(c)), seeds)), identifier_variants)
    return F.slice(F.array_distinct(F.flatten(found)), 1, limit)


def search_terms(c: Column) -> Column:
    """Identifier terms if the query has any, else its query terms."""
    return bind(identifier_terms(c), lambda found: F.when(F.size(found) > 0, found).otherwise(query_terms(c)))


def has_hangul(c: Column) -> Column:
    return text_or_empty(c).rlike(C.HANGUL)


def searchable(c: Column) -> Column:
    """The two forms of a text that terms are looked up in: lower case, and letters and digits only."""
    return F.struct(F.lower(c).alias("lower"), compact(c).alias("compact"))


def term_forms(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lower(t).alias("lower"), compact(t).alias("compact")))


def names_term(text: Column, term: Column) -> Column:
    """Whether a text holds a term, as written or with everything but letters and digits removed."""
    return ((term["lower"] != "") & F.contains(text["lower"], term["lower"])) | (
        (term["compact"] != "") & F.contains(text["compact"], term["compact"]))


def names_any(c: Column, forms: Column) -> Column:
    """Whether a text holds one of the terms, given by their forms."""
    return bind(searchable(c), lambda text: F.exists(forms, lambda t: names_term(text, t)))


def mask_text(c: Column) -> Column:
    """Mail addresses, phone numbers and reference numbers replaced by tags, in the fixed order."""
    masked = text_or_empty(c)
    for pattern, tag in C.MASKS:
        masked = F.regexp_replace(masked, "(?iU)" + pattern, tag)
    return masked


def mask_addresses(c: Column) -> Column:
    """In a `;` or `,` list, keep the first letter and the domain of each address; names stay as they are."""
    one_address = r"(?U)(^|[;,])(\s*)([^@\s;,])[^@\s;,]*@([^@\s;,]+)(?=\s*(?:[;,]|$))"
    return F.regexp_replace(strip(text_or_empty(c)), one_address, "$1$2$3****@$4")


def sentences(c: Column) -> Column:
    parts = F.split(strip(squeeze(text_or_empty(c))), r"(?<=[.!?。！？])\s+")
    return F.filter(parts, lambda s: s != "")


def scored_sentences(body: Column, terms: Column) -> Column:
    """(order, idx, sentence) of every sentence that names a term; `order` is minus the score: 2 per term plus a bonus
    for early sentences."""
    def scored(forms: Column, sentence: Column, idx: Column) -> Column:
        hits = bind(searchable(sentence), lambda text: F.size(F.filter(forms, lambda t: names_term(text, t))))
        return F.when(hits > 0, F.struct(
            (-(2.0 * hits + F.greatest(F.lit(0.0), 2.0 - idx * 0.1))).alias("order"), idx.alias("idx"),
            sentence.alias("sentence")))

    found = bind(term_forms(terms), lambda forms: F.transform(sentences(body), lambda s, i: scored(forms, s, i)))
    return F.array_compact(found)


def snippet(body: Column, terms: Column, sentences_kept: int = 3, context: int = 150) -> Column:
    """The best sentences for the terms, masked, with each term in `**`; else the text around the first hit, if any."""
    def around() -> Column:
        text = strip(squeeze(text_or_empty(body)))
        hits = F.filter(F.transform(terms, lambda t: F.position(F.lower(t), F.lower(text))), lambda p: p > 0)
        start = F.greatest(F.lit(0), F.array_min(hits) - 1 - context)
        stop = F.least(F.length(text), F.array_min(hits) - 1 + context)
        cut = F.concat(
            F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, stop - start),
            F.when(stop < F.length(text), "...").otherwise(""))
        return F.when(F.size(hits) > 0, cut).otherwise("")

    ranked = F.slice(F.array_sort(scored_sentences(body, terms)), 1, sentences_kept)
    chosen = bind(ranked, lambda best: F.when(
        F.size(best) > 0, F.array_join(F.transform(best, lambda p: p["sentence"]), " ")).otherwise(around()))
    return highlight(mask_text(chosen), terms)


def highlight(c: Column, terms: Column) -> Column:
    return F.aggregate(terms, c, lambda text, term: F.regexp_replace(
        text, F.concat(F.lit(r"(?iu)(\Q"), term, F.lit(r"\E)")), F.lit("**$1**")))


def chunks(c: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, limit: int | None = None) -> Column:
    """Overlapping pieces of the stripped text; one piece when it fits, none when it is empty.

    Counting characters starts at the beginning of a text each time, so a long text is first cut into blocks of a
    hundred pieces, and the pieces are cut from their block.
    """
    step = max(1, size - overlap)
    block = 100 * step

    def pieces(text: Column) -> Column:
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.length(text), F.lit(block)),
            lambda b: bind(F.substring(text, b, F.lit(block + overlap)), lambda part: F.transform(
                F.sequence(F.lit(1), F.least(F.length(text) - b + 1, F.lit(block)), F.lit(step)),
                lambda s: F.substring(part, s, F.lit(size))))))

    found = bind(strip(text_or_empty(c)), lambda text: (
        F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text))
        .otherwise(pieces(text))))
    return F.slice(found, 1, limit) if limit else found


def header_text(columns: list[Column], size: int = C.CHUNK_SIZE) -> Column:
    """The filled header fields joined by ` | `, cut to one chunk."""
    return F.substring(F.concat_ws(" | ", *[F.nullif(strip(text_or_empty(c)), F.lit("")) for c in columns]), 1, size)


def embedding_text(subject: Column, body: Column, body_chars: int | None = None) -> Column:
    """Subject and body in one text; `body_chars` cuts the body for encoders with a short input window."""
    tail = text_or_empty(body)
    if body_chars:
        tail = F.substring(tail, 1, body_chars)
    return strip(F.concat(text_or_empty(subject), F.lit(" "), tail))
