"""Text functions on columns. Only what the built-in functions cannot say (compatibility normal forms, entities, similar_text) is a Python function over Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.functions.common_runs import common_bytes as _common
from pactlens.functions.slices import over_slices

#: Words that carry no name.
STOP = ["el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "al", "con", "para", "por", "mi", "mis", "su", "sus", "y", "en", "a", "sobre", "convenio", "acuerdo", "convenios"]
_FOLD_FROM, _FOLD_TO = "áéíóúäëïöüñ", "aeiouaeioun"
_ASCII_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_ASCII_TO = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def _mapped(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function that applies ``f`` to texts; made when it is called, as workers import this module without a session."""
    return over_slices(lambda texts: [None if t is None else f(t) for t in texts], "string")


def nfkc(s: Column) -> Column:
    """TXT01: compatibility normal form without carriage returns."""
    return _mapped(lambda t: unicodedata.normalize("NFKC", t).replace("\r", ""))(s)


def strip_marks(s: Column) -> Column:
    """TXT05: decomposed, without combining marks U+0300-036F."""
    return _mapped(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F))(s)


def unescape_entities(s: Column) -> Column:
    return _mapped(html.unescape)(s)


def fold(s: Column) -> Column:
    """TXT02: lower case without Spanish accents; the length stays."""
    return F.translate(F.lower(s), _FOLD_FROM, _FOLD_TO)


def folded(text: str) -> str:
    """:func:`fold` of one text at hand."""
    text = text.lower()
    if not text.isascii():
        for a, b in zip(_FOLD_FROM, _FOLD_TO, strict=True):
            text = text.replace(a, b)
    return text


def letters_only(s: Column) -> Column:
    """TXT03: lower-case letters without acute accents and diaeresis; ñ stays."""
    return F.translate(F.regexp_replace(F.lower(s), r"[^\p{L}]+", ""), "áéíóúü", "aeiouu")


def ascii_fold(s: Column) -> Column:
    """TXT04 for the letters of Spanish, French and German; ß becomes ss."""
    return F.regexp_replace(F.translate(s, _ASCII_FROM, _ASCII_TO), "ß", "ss")


def _chain(s: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        s = F.regexp_replace(s, pattern, to)
    return s


def ocr_cleanup(s: Column) -> Column:
    """TXT06: entities, controls, soft hyphens and lone runs of six digits become blanks; blanks collapse."""
    return F.trim(_chain(s, (r"&#\d+;?", " "), (r"&[A-Za-z0-9#]+;", " "), (r"[\x00-\x1F\x7F\xAD]", " "), (r"\b\d{6,}\b", " "), (r"\s+", " ")))


def one_line(s: Column) -> Column:
    """TXT07."""
    return F.trim(_chain(s, (r"[\r\n]+", " "), (r"\s+", " ")))


def clean_hard(s: Column) -> Column:
    """TXT08: as TXT06, but lines stay; controls go before entities."""
    return F.trim(_chain(s, (r"[\x00-\x08\x0B-\x1F\x7F\xAD]", " "), (r"&#\d+;?", " "), (r"&[A-Za-z0-9#]+;", " "), (r"\b\d{6,}\b", " "), (r"\t", " "), (r" {2,}", " "), (r"\n{3,}", "\n\n")))


def share(s: Column, of: str) -> Column:
    """TXT17: the share of characters that match ``of``, 0 for an empty text."""
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit(of)) / F.length(s)).otherwise(0.0)


def noisy_line(line: Column) -> Column:
    """TXT09: empty, without letter or digit, or six digits or more that are 40 % or more of the line."""
    digits = F.regexp_count(line, F.lit(r"\p{Nd}"))
    return (F.length(line) == 0) | ~line.rlike(r"[\p{L}\p{Nd}]") | ((digits >= 6) & (digits / F.length(line) >= 0.4))


def clean_extracted(s: Column) -> Column:
    """TXT09: entities decoded, lines trimmed, noisy lines dropped; null if nothing stays."""
    text = _chain(unescape_entities(s), (r"\r\n?", "\n"), (r"[ \t\x{00A0}]+", " "))
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: ~noisy_line(x))
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def gibberish_line(line: Column) -> Column:
    """TXT11: too many signs, too many digits, or hardly any words and a run of punctuation."""
    letters, digits = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{N}"))
    signs = F.regexp_count(line, F.lit(r"[^\p{L}\p{N}\s]"))
    words = F.size(F.filter(F.split(line, r"\s+", -1), lambda w: w != ""))
    n = F.greatest(F.length(line), F.lit(1))
    return (signs / n > 0.24) | ((letters > 0) & (digits / n > 0.35)) | ((words <= 2) & (letters < 8) & line.rlike(r"""['"“”‘’`´\-_.:,;/\\]{2,}"""))


def pre_diff(s: Column) -> Column:
    """TXT10: text made comparable line by line: five entities decoded, normal form, no controls, no characters but letters, digits,
    blanks and common punctuation, blanks collapsed, digits between letters read as letters, numeric prefixes cut; lines
    that are empty, quotes alone, without a letter or digit, with less than 45 % of them, or gibberish are dropped."""
    text = _chain(s, ("(?i)&quot;", '"'), ("(?i)&apos;", "'"), ("&#39;", "'"), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), (r"\r\n", "\n"))
    text = _chain(
        nfkc(text), (r"[\x00-\x09\x0B-\x1F\x7F-\x9F]", ""), (r"[^\p{L}\p{N}\s.,;:!?()\-/%\"'“”‘’«»]", " "), (r"[\s\u00A0&&[^\n]]+", " "),
        (r"(?<=\p{L})0(?=\p{L})", "o"), (r"(?<=\p{L})1(?=\p{L})", "l"), (r"(?<=\p{L})5(?=\p{L})", "s"), (r"(?m)^ ?[0-9\-.,/]{8,} *", ""),
    )
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    good = lambda x: (x != "") & ~F.replace(x, F.lit(" "), F.lit("")).rlike("^['\"“”‘’«»`´]+$") & x.rlike(r"[0-9\p{L}]") & (share(x, r"[\p{L}\p{N}]") >= 0.45) & ~gibberish_line(x)
    return F.array_join(F.filter(lines, good), "\n")


def viewer_cleanup(s: Column) -> Column:
    """TXT12: no blanks at line ends, no empty runs, no lines that start with five digits."""
    lines = F.filter(F.transform(F.split(s, "\n", -1), lambda x: F.rtrim(x)), lambda x: ~x.rlike(r"^\s*\d{5,}"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def canonical_token(s: Column) -> Column:
    """TXT13: folded, with plural endings of words over four letters cut."""
    words = F.filter(F.split(fold(s), r"\s+", -1), lambda w: w != "")
    cut = lambda w: F.when((F.length(w) > 4) & w.rlike("[^aeiou]es$"), F.regexp_replace(w, "es$", "")).when((F.length(w) > 4) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.array_join(F.transform(words, cut), " ")


def significant_tokens(s: Column) -> Column:
    """TXT14: words of the folded text that are not on the stop list."""
    words = F.split(F.regexp_replace(F.lower(ascii_fold(s)), "[^a-z0-9]+", " "), " ", -1)
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP))


def sanitize_name(s: Column) -> Column:
    """TXT15: no blanks, quotes or punctuation around it; inner blanks collapse."""
    edge = r"[\s\"'“”‘’.,;:¿?¡!()\[\]-]+"
    return F.regexp_replace(F.regexp_replace(s, f"^{edge}|{edge}$", ""), r"\s+", " ")


def compact(s: Column, most: int) -> Column:
    """TXT16: one line, a dash if empty, cut with three dots beyond ``most``."""
    t = one_line(F.coalesce(s, F.lit("")))
    return F.when(t == "", "—").when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("..."))).otherwise(t)


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{Nd}]+", -1), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """TXT19: shared over all distinct trigrams, 0 where there are none."""
    return shared_share(trigrams(a), trigrams(b))


def shared_share(x: Column, y: Column) -> Column:
    """Of two arrays of distinct values, those in both over those in either; 0 where there are none."""
    shared = F.size(F.array_intersect(x, y))
    return F.coalesce(shared / F.nullif(F.size(x) + F.size(y) - shared, F.lit(0)), F.lit(0.0))


def trigrams_of(text: str) -> list[str]:
    """:func:`trigrams` of one text at hand."""
    words = "".join(c if c.isalpha() or c.isdecimal() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)))


def _similar(a: list, b: list) -> list:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = x.encode(), y.encode()
        return 200.0 * _common(p, q) / (len(p) + len(q)) if p or q else 0.0

    return [one(x, y) for x, y in zip(a, b, strict=True)]


def similar_text(a: Column | str, b: Column | str) -> Column:
    """TXT21: percent of bytes in common runs (see :mod:`pactlens.functions.common_runs`) of texts of any length; null if one is null, 0 for two empty ones."""
    return over_slices(_similar, "double")(a, b)


def sentences(s: Column) -> Column:
    """TXT23: parts that end with . ! ? or … before a blank."""
    return F.filter(F.transform(F.split(s, r"(?<=[.!?…])\s+", -1), lambda x: F.trim(x)), lambda x: x != "")


_SENTENCE_END = re.compile(r"[.!?…][ \t\n\x0b\f\r]+")


def sentences_of(text: str) -> list[tuple[int, str]]:
    """:func:`sentences` of one text at hand, each behind the place where it begins."""
    cuts = [0]
    for m in _SENTENCE_END.finditer(text):
        cuts += (m.start() + 1, m.end())
    cuts.append(len(text))
    out = []
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        own = text[a:b].lstrip(" ")
        if whole := own.rstrip(" "):
            out.append((b - len(own), whole))
    return out


def answer_layout(s: Column) -> Column:
    """TXT27: a single line of over 220 characters is broken after . ; and :"""
    return F.when((F.length(s) > 220) & ~F.contains(s, F.lit("\n")), F.regexp_replace(s, r"([.;:])\s+", "$1\n")).otherwise(s)


def context(text: Column, start: Column, end: Column, before: int = 160, after: int = 220) -> tuple[Column, Column]:
    """TXT28: what stands on the same line left and right of [start, end), offsets from 0; without a line end on that side, ``before`` or ``after`` characters."""
    left, right = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    left = F.when(F.contains(left, F.lit("\n")), F.substring_index(left, "\n", -1)).otherwise(F.substring(left, F.greatest(start - before, F.lit(0)) + 1, F.lit(before)))
    return left, F.when(F.contains(right, F.lit("\n")), F.substring_index(right, "\n", 1)).otherwise(F.substring(right, F.lit(1), F.lit(after)))


def snippet(text: Column, start: Column, end: Column, before: int = 160, after: int = 220) -> Column:
    """TXT28: [start, end) with its context, trimmed."""
    left, right = context(text, start, end, before, after)
    return F.trim(F.concat(left, F.substring(text, start + 1, end - start), right))


def iso_time(ts: Column) -> Column:
    """PRJ04: ISO-8601 with the session's offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def percent(share_of_one: Column, decimals: int = 1) -> Column:
    """PRJ06."""
    return F.concat(F.format_number(share_of_one * 100, decimals), F.lit("%"))


def engine_label(model: Column) -> Column:
    """PRJ09: what a model's name tells about the engine; the first that fits."""
    x, has = F.lower(F.coalesce(model, F.lit(""))), lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda k: F.contains(F.lower(F.coalesce(model, F.lit(""))), k))
    label = F.when(has("tfidf"), "búsqueda semántica (TF-IDF)").when(has("mini", "mpnet", "paraphrase"), "modelo de similitud (frases)")
    label = label.when(has("openai", "text-embedding", "e5"), "embeddings avanzados").when(has("rules"), "reglas (palabras clave)")
    return label.when(x == "", "motor desconocido").otherwise(model)


def expand_query(question: Column) -> Column:
    """TXT24 without named entities: the question with what follows "con" behind it."""
    q = F.trim(question)
    name = F.trim(F.regexp_extract(q, r'(?i)(?:convenio\s+con|con)\s+"?([A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9.\-& ]+)"?', 1))
    return F.when(name != "", F.concat_ws(" ", q, name)).otherwise(q)


def slug(name: Column) -> Column:
    """TXT25: lower-case ASCII letters and digits with single hyphens between; ``version`` if nothing is left."""
    s = F.regexp_replace(F.lower(ascii_fold(name)), r"[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("version"))


def escape_html(s: Column) -> Column:
    """TXT25."""
    return _chain(s, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def tolerant_pattern(literal: str) -> str:
    """TXT29: a pattern that finds the literal whatever its accents and blanks."""
    groups = {"a": "aáä", "e": "eéë", "i": "iíï", "o": "oóö", "u": "uúü", "n": "nñ"}
    plain = {c: base for base, group in groups.items() for c in group}
    out = "".join(f"[{groups[plain[c]]}]" if c in plain else r"\s+" if c == " " else c if c.isalnum() else "\\" + c for c in " ".join(literal.lower().split()))
    return "(?iu)" + out.replace(r"\s+\s+", r"\s+")
