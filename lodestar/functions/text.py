"""Column functions over text: normalising, tokens, lines, types, windows. None of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

#: The four tokenisers differ in class, least length, stop words and repeats.
SEARCH_TOKEN = r"[0-9A-Za-zА-Яа-яЁё_.+-]{2,}"
SCORING_TOKEN = r"[0-9A-Za-zА-Яа-яЁё%°./+-]{2,}"
ROUTE_TOKEN = r"[0-9A-Za-zА-Яа-яЁё_-]{3,}"


#: White space of any kind, as ``(?U)\\s`` has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_col(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_col(x), F.lit(WHITE))


def normalize(x: Column | str) -> Column:
    """Lower case, ё as е, white space collapsed; null as empty."""
    return F.trim(one_line(F.replace(F.lower(text_or_empty(x)), F.lit("ё"), F.lit("е"))))


def one_line(x: Column) -> Column:
    """Each run of white space as one blank; single blanks, as nearly all are, are no match, so most texts stay as they are."""
    return F.regexp_replace(x, r"(?U)(?: (?=\s)|[^\S ])\s*+", " ")


def alnum_key(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(F.lower(text_or_empty(x)), "ё", "е"), "[^0-9a-zа-я]", "")


def slug(x: Column | str, fallback: str = "misc") -> Column:
    """Of the last segment: letters, digits, dots and hyphens as they are, all else as single underscores; none of these at the ends."""
    name = F.element_at(F.split(F.translate(F.trim(text_or_empty(x)), "\\", "/"), "/"), -1)
    made = F.regexp_replace(F.translate(name, "ёЁ", "еЕ"), r"[^0-9A-Za-zА-Яа-я_.-]+", "_")
    made = F.regexp_replace(F.regexp_replace(made, "_+", "_"), r"^[_.-]+|[_.-]+$", "")
    return F.when(made == "", F.lit(fallback)).otherwise(made)


def _tokens(x: Column | str, pattern: str) -> Column:
    found = F.regexp_extract_all(text_or_empty(x), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda t: F.translate(F.lower(t), "ё", "е"))


def search_tokens(x: Column | str) -> Column:
    """Two or more characters, stop words left out, repeats kept."""
    return F.filter(_tokens(x, SEARCH_TOKEN), lambda t: ~t.isin(V.STOP_WORDS))


def token_count(low: Column, token: str) -> Column:
    """How often a normalised text has a search token, without a list of all its tokens."""
    own = SEARCH_TOKEN[: SEARCH_TOKEN.index("{")]
    return F.regexp_count(low, F.lit(f"(?<!{own})\\Q{token}\\E(?!{own})"))


def index_tokens(x: Column | str) -> Column:
    return _tokens(x, SEARCH_TOKEN)


def scoring_tokens(x: Column | str) -> Column:
    return _tokens(x, SCORING_TOKEN)


def route_tokens(x: Column | str) -> Column:
    """Three or more characters, each once, in order."""
    return F.array_distinct(_tokens(x, ROUTE_TOKEN))


def lines(x: Column | str) -> Column:
    """Lines as split at any line break, without an empty last one."""
    whole = lambda split: F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(0)))).otherwise(split)
    return bind(F.split(text_or_empty(x), r"\R"), whole)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contained(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the text, each once."""
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))


def count_contained(text: Column, terms: list[str]) -> Column:
    return bind(text, lambda x: contained(x, terms))


def line_stats(x: Column | str) -> Column:
    """lines, short_line_ratio, table_separator_ratio, uppercase_ratio of the lines that aren't blank; (0, 1, 0, 0) without one."""
    letters = lambda t: F.length(F.regexp_replace(t, r"\P{L}", ""))
    capitals = lambda t: F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    none = F.struct(F.lit(0.0).alias("lines"), F.lit(1.0).alias("short_line_ratio"), F.lit(0.0).alias("table_separator_ratio"), F.lit(0.0).alias("uppercase_ratio"))

    def shares(own: Column) -> Column:
        n = F.size(own)
        share = lambda test: F.size(F.filter(own, test)) / n
        found = F.struct(
            n.cast("double").alias("lines"),
            share(lambda t: F.length(t) <= 38).alias("short_line_ratio"),
            share(lambda t: t.rlike(V.TABLE_SEPARATOR)).alias("table_separator_ratio"),
            share(lambda t: (letters(t) > 0) & (capitals(t) / letters(t) > 0.72)).alias("uppercase_ratio"),
        )
        return F.when(n == 0, none).otherwise(found)

    return bind(F.filter(F.transform(lines(x), strip), lambda t: t != ""), shares)


def fingerprint(x: Column | str) -> Column:
    """SHA-1 of the first 1600 characters in lower case with white space collapsed."""
    return F.sha1(F.substring(F.regexp_replace(F.lower(strip(text_or_empty(x))), r"(?U)\s+", " "), 1, 1600))


def clean_lines(x: Column | str, odd_glyphs: str = V.ODD_GLYPHS) -> Column:
    """The lines of ``clean_extracted``, with all blank ones."""
    # in one go, as each becomes a blank; characters that no mark is, as nearly all are, are passed over first
    known = odd_glyphs == V.ODD_GLYPHS
    marks = V.INVISIBLE + V.CONTROL + (odd_glyphs if known else "")
    t = F.regexp_replace(text_or_empty(x), rf"(?![ -~])(?![\u0400-\u04FF])[{marks}]", " ")
    t = F.regexp_replace(t, odd_glyphs, " ") if odd_glyphs and not known else t
    t = F.regexp_replace(t, V.IMAGE_MARK, " ")
    t = F.regexp_replace(t, rf"(?U)-(?<={V.LETTER}-)\s*\n\s*(?={V.LETTER})", "")

    def noise(line: Column) -> Column:
        dense = F.replace(line, F.lit(" "), F.lit(""))
        good = F.length(F.regexp_replace(dense, f"[^{V.GOOD_CHARACTERS}]", ""))
        return (
            ((F.length(dense) >= 24) & (good < 0.55 * F.length(dense)))
            | ((F.length(line) > 40) & line.rlike("(?U)" + V.SPACED_LETTERS))
            | ((F.length(line) > 30) & line.rlike(V.GLYPH_RUN))
        )

    own = F.transform(lines(t), lambda s: strip(F.regexp_replace(s, r"[ \t]{2,}", " ")))
    return F.filter(own, lambda s: ~noise(s))


def clean_extracted(x: Column | str, odd_glyphs: str = V.ODD_GLYPHS) -> Column:
    """Text of an extractor without invisible characters, image marks, words broken at line ends, and lines of glyph noise.

    ``odd_glyphs`` becomes blanks; give an empty string for languages that use accents.
    """
    joined = F.array_join(clean_lines(x, odd_glyphs), "\n")
    return strip(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def untidy(x: Column) -> Column:
    """Whether ``clean_extracted`` may change a text; all others are their own clean texts."""
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts])
    blanks = has("  ") | F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" "))
    image = has("<!", "[", "(") & x.rlike(V.IMAGE_MARK)
    return reduce(lambda a, b: a | b, [x.rlike(p) for p in V.UNTIDY], blanks | image)


def document_type(name: Column, text: Column, explicit: Column | None = None) -> Column:
    """Type of a document at chunking: what is given, else by extension and words of the name and the first 5000 characters."""
    sample = F.concat(text_or_empty(name), F.lit("\n"), F.substring(text_or_empty(text), 1, 5000))

    def typed(hay: Column) -> Column:
        low = F.translate(F.lower(hay), "ё", "е")
        ext = F.lower(F.regexp_extract(text_or_empty(name), r"\.([A-Za-z0-9]+)(?:$|[#?])", 1))
        return (
            F.when(ext.isin("ppt", "pptx") | low.contains("презентац") | low.contains("slide"), "presentation")
            .when(ext.isin("xls", "xlsx", "csv", "tsv"), "spreadsheet")
            .when(hay.rlike(V.STANDARD_NUMBER) | low.contains("гост") | F.concat(F.lit(" "), low, F.lit(" ")).contains(" iso ") | low.contains("стандарт"), "standard")
            .when(hay.rlike(V.PATENT_WORD), "patent")
            .when((ext == "pdf") & hay.rlike(V.JOURNAL_WORD), "article")
            .when(hay.rlike(V.REPORT_WORD), "report")
            .when(ext == "pdf", "pdf_report")
            .otherwise("generic")
        )

    found = bind(sample, typed)
    if explicit is None:
        return found
    given = F.lower(F.trim(text_or_empty(explicit)))
    return F.when(given.isin("", "document", "generic"), found).otherwise(given)


def selection_document_type(name: Column, text: Column) -> Column:
    """Type of a document at selection; its rules differ from those at chunking."""
    hay = normalize(F.concat(text_or_empty(name), F.lit("\n"), F.substring(text_or_empty(text), 1, 1200)))
    ext = F.lower(F.regexp_extract(text_or_empty(name), r"(?i)\.(pptx?|pdf|docx?|xlsx?|html?|md|txt)(?:$|[#?\s])", 1))
    return (
        F.when(ext.isin("ppt", "pptx") | hay.contains("презентац") | hay.contains("slide"), "presentation")
        .when(ext.isin("xls", "xlsx"), "spreadsheet")
        .when(hay.contains("гост") | hay.contains("gost") | F.concat(F.lit(" "), hay, F.lit(" ")).contains(" iso ") | hay.contains("стандарт"), "standard")
        .when((ext == "pdf") & hay.rlike("abstract|аннотац|references|список литературы|doi:"), "article")
        .when(ext == "pdf", "pdf_report")
        .when(ext.isin("doc", "docx"), "report")
        .otherwise("generic")
    )


def section_title(text: Column) -> Column:
    """The first line of 8 to 140 characters without blanks and number signs around it, or the empty string."""
    own = F.filter(F.transform(lines(text), lambda t: F.regexp_replace(t, r"^[ #\t]+|[ #\t]+$", "")), lambda t: F.length(t).between(8, 140))
    return F.coalesce(F.get(own, F.lit(0)), F.lit(""))


def section_type(name: Column, text: Column, object_type: Column | None = None, document_type: Column | None = None) -> Column:
    """The first section type found in name, title and the first 500 characters; else what slides tell, else body; tables are tables."""

    def typed(sample: Column) -> Column:
        title = F.translate(F.lower(section_title(sample)), "ё", "е")
        return bind(F.concat(text_or_empty(name), F.lit("\n"), title, F.lit("\n"), F.substring(sample, 1, 500)), first)

    def first(hay: Column) -> Column:
        out = F.lit("body")
        slides = F.coalesce(document_type == "presentation", F.lit(False)) if document_type is not None else F.lit(False)
        for kind, words in reversed(V.SLIDE_SECTIONS):
            out = F.when(slides & hay.rlike(rf"(?iU)\b(?:{words})\b"), kind).otherwise(out)
        for kind, words in reversed(V.SECTIONS):
            out = F.when(hay.rlike(rf"(?iU)\b(?:{words})\b"), kind).otherwise(out)
        return out

    found = bind(F.substring(clean_extracted(text), 1, 2200), typed)
    return found if object_type is None else F.when(object_type == "table", "table").otherwise(found)


def source_year(name: Column, text: Column) -> Column:
    """The latest year 1900 to 2099 in the name, else in the first 2000 characters, else null."""
    years = lambda x: F.array_max(F.transform(F.regexp_extract_all(x, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")))
    return F.coalesce(years(text_or_empty(name)), years(F.substring(text_or_empty(text), 1, 2000)))


def path_parts(path: Column | str) -> Column:
    """Segments of a path without empty ones, . and .. ones."""
    return F.filter(F.split(F.translate(text_or_empty(path), "\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))


def safe_path(path: Column | str) -> Column:
    """A relative path that can be written to: no way up, no characters that file systems refuse."""
    return F.array_join(F.transform(path_parts(path), lambda p: F.regexp_replace(p, r'[<>:"\\|?*]', "_")), "/")


def path_years(parts: Column) -> Column:
    """Years 1900 to 2099 in the segments, each once, in order."""
    found = F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)))
    return F.transform(F.array_distinct(F.flatten(found)), lambda y: y.cast("int"))


def theme_from_file_name(name: Column | str) -> Column:
    """A readable theme: no extension, kind of document, years or separators; of over 80 characters the first 8 words; null where nothing is left."""
    t = F.regexp_replace(text_or_empty(name), r"(?<=[^/])\.[^./\\]+$", "")
    t = F.regexp_replace(t, r"(?iu)\b(?:proceedings|article|статья|готовая|final|draft|презентация|presentation)\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<!\d)(?:19|20)\d{2}(?!\d)", " "), r"[_-]+", " ")
    t = strip(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.nullif(F.when(F.length(t) > 80, F.array_join(F.slice(F.split(t, " "), 1, 8), " ")).otherwise(t), F.lit(""))


def human_source_name(source: Column | str) -> Column:
    """File name with its page, slide or chunk; internal suffixes are left out."""
    raw = strip(F.translate(text_or_empty(source), "\\", "/"))
    parts = F.split(raw, "#")
    base = F.element_at(F.split(F.regexp_replace(F.get(parts, F.lit(0)), "/+$", ""), "/"), -1)
    useful = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: p.rlike("^(?:page|slide|chunk):"))
    return F.when(raw == "", "unknown").otherwise(F.concat(base, F.array_join(F.transform(useful, lambda p: F.concat(F.lit("#"), p)), "")))


def snippet(text: Column, tokens: list[str], most: int = 900) -> Column:
    """Up to ``most`` characters around the first hit of a query token, with ellipses where text is left out."""
    clean = F.regexp_replace(strip(text_or_empty(text)), r"(?U)\s+", " ")

    def around(clean: Column, first: Column) -> Column:
        end = F.least(F.length(clean), F.greatest(F.lit(0), first - most // 3) + most)
        start = F.greatest(F.lit(0), end - most)
        return F.concat(
            F.when(start > 0, "…").otherwise(""),
            strip(F.substring(clean, start + 1, end - start)),
            F.when(end < F.length(clean), "…").otherwise(""),
        )

    def cut(clean: Column) -> Column:
        places = lambda low: F.filter(F.array(*[F.locate(t, low) for t in tokens]), lambda p: p > 0)
        first = F.coalesce(F.array_min(bind(normalize(clean), places)), F.lit(1)) - 1 if tokens else F.lit(0)
        return F.when(F.length(clean) <= most, clean).otherwise(bind(first, lambda at: around(clean, at)))

    return bind(clean, cut)


#: A blank behind each mark that has none; ``PAIRED_MARKS`` takes along what follows, so of a run of marks only every other one gets a blank.
MARKS, PAIRED_MARKS = (r"([,.;:])(?!\s|$|\d)", "$1 "), (r"([,.;:])([^\s\d])", "$1 $2")


def compact(text: Column | str, most: int = 520, marks: tuple[str, str] = MARKS, tidy: bool = False) -> Column:
    """One line without marks at its ends and with spacing around punctuation mended, not within numbers; cut at the last space before ``most``.

    ``tidy``: ``text`` is part of a text that isn't ``untidy``, so there is nothing to clean in it, and all its white space is single blanks.
    """
    ends = F.lit(" -•#|\t")
    if tidy:
        t = F.btrim(_col(text), ends)
        for mark in ",.;:":
            t = F.replace(t, F.lit(f" {mark}"), F.lit(mark))
        t = F.trim(F.regexp_replace(t, *marks))
    else:
        cleaned = bind(text_or_empty(text), lambda t: F.when(untidy(t), clean_extracted(t)).otherwise(t))
        t = F.regexp_replace(F.regexp_replace(F.btrim(one_line(cleaned), ends), r"\s+([,.;:])", "$1"), *marks)
        t = F.trim(one_line(t))
    head = lambda t: F.regexp_replace(F.trim(F.regexp_replace(F.substring(t, 1, most), r" [^ ]*$", "")), r"[ ,;:]+$", "")
    return bind(t, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(head(t), F.lit("…"))))


def language_vote(text: Column | str) -> Column:
    """ru or en by letter counts: the greater must be 1.2 times the other and over 5, else unknown."""
    t = text_or_empty(text)
    ru, en = F.regexp_count(t, F.lit("[а-яёА-ЯЁ]")), F.regexp_count(t, F.lit("[a-zA-Z]"))
    return F.when((ru > 1.2 * en) & (ru > 5), "ru").when((en > 1.2 * ru) & (en > 5), "en").otherwise("unknown")


def strip_thinking(text: Column | str) -> Column:
    """Without think blocks and code fences of a language model's answer."""
    t = F.regexp_replace(text_or_empty(text), r"(?is)<think>.*?</think>", "")
    return strip(F.regexp_replace(t, r"(?m)^\s*```[A-Za-z0-9_-]*\s*$", ""))
