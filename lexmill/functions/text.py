"""Text expressions: tokens, query specificity, normalisation, labels. All built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English token pattern and the words that count as structure rather than content.
ENGLISH_TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"
FUNCTION_WORDS = (
    "a an the i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves this that these those am is are was were be been being do does did doing have has had having "
    "can could may might must shall should will would of at by for with about against between into through during before after above below "
    "to from up down in out on off over under and but or because as until while if than what which who whom whose when where why how"
).split()
#: S = clamp(HIGH - SLOPE * density, LOW, HIGH); UNSURE where the language isn't known well enough.
LOW, HIGH, SLOPE, UNSURE = 0.2, 0.8, 0.6, 0.5
MIN_CONFIDENCE, MIN_CHARS = 0.7, 3
CONTEXT_LIMIT = 120_000


def english_tokens(text: Column) -> Column:
    """English words in lower case, inner hyphens and apostrophes kept. ASCII only, so lower() is exact."""
    return F.transform(F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0)), F.lower)


def bigram_tokens(text: Column) -> Column:
    """Character pairs of Chinese runs (single characters alone): the stand-in where no segmenter is installed."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{3400}-\x{9fff}]+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pairs))


def language(text: Column, given: Column | None = None) -> tuple[Column, Column]:
    """Language (zh or en) and confidence: the given language if any, else the share of Chinese characters.

    Texts of at most MIN_CHARS characters have no language.
    """
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    chinese = F.length(F.regexp_replace(text, r"[^\x{3400}-\x{9fff}]", ""))
    share = F.when(letters > 0, chinese / letters).otherwise(F.lit(0.0))
    guess = F.when(share >= 0.5, "zh").otherwise("en")
    sure = F.when(F.length(F.trim(text)) <= MIN_CHARS, 0.0).otherwise(F.greatest(share, 1 - share))
    if given is None:
        return guess, sure
    return F.when(given.isNull(), guess).when(given.startswith("zh"), "zh").otherwise("en"), F.when(given.isNull(), sure).otherwise(1.0)


def tokens(text: Column, lang: Column) -> Column:
    """Tokens by language."""
    return F.when(lang == "zh", bigram_tokens(text)).otherwise(english_tokens(text))


def signal_tokens(words: Column) -> Column:
    """How many of the words are function words."""
    return F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS)))


def specificity(words: Column, confidence: Column | None = None) -> Column:
    """How specific a query is; the more structure words, the less."""
    density = signal_tokens(words) / F.greatest(F.size(words), F.lit(1))
    value = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.lit(HIGH) - F.lit(SLOPE) * density))
    sure = (F.size(words) > 0) if confidence is None else (F.size(words) > 0) & (confidence >= MIN_CONFIDENCE)
    return F.when(sure, value).otherwise(F.lit(UNSURE))


def fold_blanks(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trim_blank_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A(?:[^\S\n]*\n)+", ""), r"(?U)(?:\n[^\S\n]*)+\z", "")


def visible(text: Column) -> Column:
    """Without zero-width and other format characters."""
    return F.regexp_replace(text, r"[\p{Cf}\x{00AD}]", "")


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def citation_label(title: Column, *parts: Column) -> Column:
    """《title》 and the parts that there are, by spaces."""
    return F.concat_ws(" ", F.concat(F.lit("《"), title, F.lit("》")), *[F.when(p != "", p) for p in parts])


def embedding_text(*parts: Column) -> Column:
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])


def display_source(source: Column) -> Column:
    """What follows the first /data/, or all."""
    at = F.locate("/data/", source)
    return F.when(at > 0, F.substr(source, at + 6)).otherwise(source)


def file_title(path: Column) -> Column:
    """The file's name without folders and suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_date(path: Column) -> Column:
    """YYYY-MM-DD of a name that ends in _YYYYMMDD, else null."""
    return F.when(file_title(path).rlike(r"_\d{8}$"), F.regexp_replace(F.regexp_extract(file_title(path), r"_(\d{8})$", 1), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3"))


def clean_document(text: Column) -> Column:
    """Byte order marks and zero-width spaces go; no-break and ideographic spaces become spaces."""
    return F.trim(F.translate(F.translate(text, "﻿​", ""), " 　", "  "))


def percent_encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def limited(text: Column, limit: int = CONTEXT_LIMIT, notice: str = "\n…\n") -> Column:
    """Texts over the limit keep as much of head and tail as fits around the notice."""
    half = (limit - len(notice)) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(notice), F.right(text, F.lit(half))))


def string_list(value: Column) -> Column:
    """A JSON array of strings, or one string, as the list of its non-blank members."""
    parsed = F.from_json(value, "array<string>")
    return F.filter(F.when(F.trim(value).startswith("["), F.coalesce(parsed, F.array(value))).otherwise(F.array(value)), lambda x: F.trim(x) != "")


def markdown_heading(line: Column, levels: dict[str, int]) -> Column:
    """The line as a heading of the level of the first pattern that matches, else as it is."""
    out = None
    for pattern, level in levels.items():
        hit = F.concat(F.lit("#" * level + " "), line)
        out = F.when(line.rlike(pattern), hit) if out is None else out.when(line.rlike(pattern), hit)
    return out.otherwise(line)
