"""Evidence from search hits, as columns: hits of any number of questions are one plan.

A hit's text is cut into units: a window around each number with a unit, and
sentences. Places of numbers, boundaries and markers are read off in one pass
each and kept as arrays of spans; a window is then a choice among these. A unit's
score is a sum over a table of signals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bind, clean_extracted, compact, human_source_name, normalize, one_line, text_or_empty, untidy

# Numbers with a unit in evidence, signals of the domain, words of results, contacts, noise, and where a window begins.
EVIDENCE_NUMERIC = (
    r"(?<!\w)[+-]?(?:\d++[\s ]?)*+(?:[\.,]\d+)?\s*"
    r"(?:%|°\s*C|degC|мг/л|мг/дм3|мг/дм³|г/л|кг/т|м/с|см/с|мм/с|A/m2|А/м2|кА/м2|кПа|МПа|Гц|кадр(?:ов)?/с|ppm|ppb|pH)\b"
)
DOMAIN_SIGNAL = (
    r"\b(?:процесс|режим|услов|извлеч|концентрац|температур|скорост|расход|давлен|pH|выщелач|экстракц|осажд|электро|флотац|плавк|обжиг|штейн|шлак"
    r"|католит|анолит|сейсм|взрыв|трещин|колебан|скорост[ьи]?\s+смещения|PVS|PPV|frequency|leaching|smelting|extraction)\b"
)
RESULT_WORDS = r"\b(?:вывод|результат|показано|установлено|составляет|диапазон|прогноз|мониторинг)\b"
CONTACT_WORDS = r"@|младший научный сотрудник|ведущий научный сотрудник|к\.т\.н"
NOISE = r"(?:^[#\s]*$|@|^\s*xxiv\b|^\s*\d+\s*$|^\s*источники\b|^\s*презентац|^\s*содержание\b)"
WINDOW_MARKERS = "Зарегистрированные|Изменения|Диапазон|Взрывные работы|где V|PVS|PPV"
BOUNDARY = r"\. |; |\|"
HEADING = r"(?U)\s+(?=(?:\d{1,2}\s+)?[А-ЯЁA-Z][А-ЯЁA-Z\s]{12,})"
SENTENCE_END = r"(?U)\n+|(?<=[.!?;])\s+(?=[A-ZА-ЯЁ0-9])"
# Characters of a window on either side, up to a boundary and without one; of a marker before it; of units at least and at most; of the starts that tell units and claims apart.
REACH, BARE_REACH, MARKER_REACH = 220, 140, 260
LEAST_WINDOW, LEAST_SENTENCE, LEAST_PLAIN, LONGEST_WINDOW, LONGEST_SENTENCE, LONG = 20, 28, 45, 420, 620, 480
UNIT_START, CLAIM_START = 180, 200
# Gains of a token, of the signals, and losses of contacts without a token and of long units; share of the hit's score.
TOKEN_GAIN, CONTACT_LOSS, LENGTH_LOSS, HIT_SHARE = 1.4, 2.0, 0.4, 0.05
SIGNALS = ((EVIDENCE_NUMERIC, 3.0), (DOMAIN_SIGNAL, 1.6), (RESULT_WORDS, 0.8))
# Hits and units of each that claims come from, numeric claims, all claims, others at least; passages of a context, its characters, those of a passage and of its start.
CLAIM_HITS, HIT_UNITS, NUMERIC_CLAIMS, ALL_CLAIMS, OTHER_CLAIMS = 8, 2, 5, 6, 2
CONTEXT_ITEMS, CONTEXT_CHARS, PASSAGE_CHARS, PASSAGE_START = 10, 9000, 1100, 700


def _found(text: Column, pattern: str) -> Column:
    return text.rlike("(?iU)" + pattern)


def _split(text: Column, pattern: str) -> Column:
    """Parts of a text without NUL: ``split`` alone would compile its pattern for each row, which takes longer than the rest."""
    return F.split(F.regexp_replace(text, pattern, "\0"), "\0", -1)


def spans(text: Column, pattern: str) -> Column:
    """(s, e) of each match, from 0: what stands between the matches and the matches themselves add up to places. ``text`` has no NUL, as cleaned texts have none."""
    between, matches = _split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(i: Column, parts: Column) -> Column:
        start = F.length(F.array_join(F.slice(parts["between"], 1, i + 1), "")) + F.length(F.array_join(F.slice(parts["matches"], 1, i), ""))
        return F.struct(start.alias("s"), (start + F.length(F.get(parts["matches"], i))).alias("e"))

    whole = F.struct(between.alias("between"), matches.alias("matches"))
    return bind(whole, lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size(p["matches"])), lambda i: i < F.size(p["matches"])), lambda i: place(i, p)))


def _window(text: Column, bounds: Column, markers: Column, number: Column, tidy: bool) -> Column:
    """From the boundary before a number to the one behind it, where these are near, else some way to a word's end; from a marker before it, if there is one."""
    s, e = number["s"], number["e"]
    before = F.array_max(F.transform(F.filter(bounds, lambda b: b["e"] <= s), lambda b: b["s"]))
    behind = F.array_min(F.transform(F.filter(bounds, lambda b: b["s"] >= e), lambda b: b["s"]))
    marker = F.array_max(F.transform(F.filter(markers, lambda m: (m["s"] >= s - MARKER_REACH) & (m["e"] <= s + 1)), lambda m: m["s"]))
    left, right = F.greatest(F.lit(0), s - BARE_REACH), F.least(F.length(text), e + BARE_REACH)
    word = F.length(F.regexp_extract(F.substring(text, 1, left), r"[\p{L}\p{N}]*$", 0))
    rest = F.when(F.substring(text, right, F.lit(1)).rlike(r"[\p{L}\p{N}]"), F.length(F.regexp_extract(F.substring(text, right + 1, F.length(text)), r"^[\p{L}\p{N}]*.?", 0))).otherwise(0)
    start = F.coalesce(marker, F.when(s - before <= REACH, before + 1), left - word)
    end = F.coalesce(F.when(behind - e <= REACH, behind + 1), right + rest)
    return compact(F.btrim(F.substring(text, start + 1, end - start), F.lit(" ,;:-|#")), LONGEST_WINDOW, tidy=tidy)


def windows(text: Column) -> Column:
    """A window for each number with a unit."""
    return _windows(clean_extracted(text))


def _windows(cleaned: Column, tidy: bool = False) -> Column:
    flat = cleaned if tidy else F.trim(one_line(cleaned))

    def of(t: Column) -> Column:
        numbers = spans(t, "(?iU)" + EVIDENCE_NUMERIC)
        places = lambda n: F.struct(n.alias("n"), spans(t, BOUNDARY).alias("b"), F.when(t.rlike(WINDOW_MARKERS), spans(t, WINDOW_MARKERS)).alias("m"))
        around = lambda p: F.transform(p["n"], lambda n: _window(t, p["b"], p["m"], n, tidy))
        return bind(numbers, lambda n: F.when(F.size(n) > 0, bind(places(n), around)).otherwise(F.array().cast("array<string>")))

    return F.filter(bind(flat, of), lambda w: F.length(w) >= LEAST_WINDOW)


def sentences(text: Column) -> Column:
    """Parts between line breaks, pipes, runs of capitals and ends of sentences; titles, contacts and the like only with a number."""
    return _sentences(clean_extracted(text))


def _sentences(cleaned: Column) -> Column:
    return F.transform(F.filter(_told(_parts(cleaned)), _worth), lambda x: x["unit"])


def _parts(cleaned: Column, tidy: bool = False) -> Column:
    lines = F.replace(cleaned, F.lit("\r"), F.lit("\n"))
    parted = F.when(F.contains(lines, F.lit("|")), F.regexp_replace(lines, r"(?U)\s*\|\s*", " \n")).otherwise(lines)
    return F.transform(_split(F.regexp_replace(parted, HEADING, "\n"), SENTENCE_END), lambda p: compact(p, LONGEST_SENTENCE, tidy=tidy))


def _told(units: Column, tidy: bool = False) -> Column:
    """Units with what is asked of them more than once: (unit, low, numeric, figures), whether there are numbers with units in the unit and in ``low``."""
    low = lambda u: F.replace(F.lower(u), F.lit("ё"), F.lit("е")) if tidy else normalize(u)
    told = F.transform(units, lambda u: F.struct(u.alias("unit"), low(u).alias("low"), _found(u, EVIDENCE_NUMERIC).alias("numeric")))
    figures = lambda x: x["numeric"] if tidy else _found(x["low"], EVIDENCE_NUMERIC)
    return F.transform(told, lambda x: F.struct(x["unit"].alias("unit"), x["low"].alias("low"), x["numeric"].alias("numeric"), figures(x).alias("figures")))


def _worth(x: Column) -> Column:
    return (F.length(x["unit"]) >= LEAST_SENTENCE) & (x["numeric"] | ~_found(x["unit"], NOISE))


def _firsts(units: Column, key: Callable[[Column], Column]) -> Column:
    """The first unit of each key."""
    return bind(units, lambda own: bind(F.transform(own, key), lambda keys: F.filter(own, lambda u, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)))


def unit_score(unit: Column, tokens: Column) -> Column:
    return bind(normalize(unit), lambda low: _score(unit, low, _found(low, EVIDENCE_NUMERIC), tokens))


def _score(unit: Column, low: Column, figures: Column, tokens: Column) -> Column:
    def of(hits: Column) -> Column:
        found = ((figures if pattern == EVIDENCE_NUMERIC else _found(low, pattern), gain) for pattern, gain in SIGNALS)
        gains = sum((F.when(signal, gain).otherwise(0.0) for signal, gain in found), TOKEN_GAIN * hits)
        return gains - F.when((hits == 0) & _found(low, CONTACT_WORDS), CONTACT_LOSS).otherwise(0.0)

    return bind(F.size(F.filter(F.array_distinct(tokens), lambda t: F.contains(low, t))), of) - F.when(F.length(unit) > LONG, LENGTH_LOSS).otherwise(0.0)


def evidence(text: Column, tokens: Column, limit: int = 3) -> Column:
    """The best units (score, unit) of a hit's text, of equal ones the first; all of a text without any."""

    def of(found: Column) -> Column:
        useful = F.filter(found, lambda x: (x["low"] != "") & ((F.length(x["unit"]) >= LEAST_PLAIN) | x["numeric"]))
        whole = F.filter(_told(F.array(compact(text, LONGEST_WINDOW))), lambda x: x["unit"] != "")
        return F.when(F.size(found) > 0, _firsts(useful, lambda x: F.substring(x["low"], 1, UNIT_START))).otherwise(whole)

    def units(cleaned: Column, tidy: bool) -> Column:
        return F.concat(_told(_windows(cleaned, tidy), tidy), F.filter(_told(_parts(cleaned, tidy), tidy), _worth))

    # a text is cleaned once for both, if it may need it; parts of a text that doesn't need it don't either
    found = bind(text_or_empty(text), lambda t: F.when(untidy(t), bind(clean_extracted(t), lambda c: units(c, False))).otherwise(units(t, True)))
    ranked = F.transform(bind(found, of), lambda x, i: F.struct((-_score(x["unit"], x["low"], x["figures"], tokens)).alias("loss"), i.alias("i"), x["unit"].alias("unit")))
    return F.transform(F.slice(F.array_sort(ranked), 1, limit), lambda x: F.struct((-x["loss"]).alias("score"), x["unit"].alias("unit")))


def _best_hits(hits: DataFrame, most: int) -> DataFrame:
    """The first hits of each question with their place and ``ref``, the number of their source in order of first use."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
    best = hits.withColumn("place", place).where(F.col("place") <= most)
    own = Window.partitionBy("question_id", "source_name")
    first = best.withColumn("first", F.min("place").over(own))
    return first.withColumn("ref", F.dense_rank().over(Window.partitionBy("question_id").orderBy("first"))).drop("first")


def claims(hits: DataFrame, most: int = CLAIM_HITS) -> DataFrame:
    """(question_id, numeric, place, claim, ref, source_name) from ``hits`` (question_id, tokens, chunk_id, source_name, score, text).

    A claim's key is its numbers with units, else its start, and of a question the
    same key is taken once. Five numeric claims stay, of others as many as bring both
    to six, two at least; by score, of equal ones the first. Null texts claim nothing.
    """
    units = _best_hits(hits, max(1, most)).withColumn("units", evidence(F.col("text"), F.col("tokens"), HIT_UNITS))
    units = units.select("question_id", "source_name", "ref", "score", F.col("place").alias("hit"), F.posexplode_outer("units").alias("at", "u"))  # outer: else a filter on the units would have them computed twice
    numbers = F.regexp_extract_all(F.col("u.unit"), F.lit("(?iU)" + EVIDENCE_NUMERIC), F.lit(0))
    numeric = F.size(numbers) > 0
    key = F.when(numeric, F.array_join(numbers, "|")).otherwise(F.substring(normalize(F.col("u.unit")), 1, CLAIM_START))
    score = F.col("u.score") + HIT_SHARE * F.col("score").cast("double")
    found = units.select("question_id", "source_name", "ref", "hit", "at", F.col("u.unit").alias("claim"), score.alias("gain"), numeric.alias("numeric"), key.alias("key"))
    once = F.row_number().over(Window.partitionBy("question_id", "numeric", "key").orderBy("hit", "at"))
    kept = found.where("key <> ''").withColumn("n", once).where("n = 1")
    ranked = kept.withColumn("place", F.row_number().over(Window.partitionBy("question_id", "numeric").orderBy(F.desc("gain"), "hit", "at")))
    figures = F.least(F.lit(NUMERIC_CLAIMS), F.sum(F.col("numeric").cast("int")).over(Window.partitionBy("question_id")))
    most_of = F.when(F.col("numeric"), NUMERIC_CLAIMS).otherwise(F.greatest(F.lit(OTHER_CLAIMS), ALL_CLAIMS - figures))
    return ranked.withColumn("most", most_of).where("place <= most").select("question_id", "numeric", "place", "claim", "ref", "source_name")


def passages(hits: DataFrame, items: int = CONTEXT_ITEMS, chars: int = CONTEXT_CHARS) -> DataFrame:
    """(question_id, place, line): numbered passages of the best hits until ``chars`` are used up; the first stays, and the first that doesn't fit ends it.

    A passage begins with the hit's best unit, if that is not near its start anyway.
    ``hits`` may have theme_id, year, source_type and numeric_properties too.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in hits.columns else F.lit(None).cast(kind)
    rows = _best_hits(hits, max(1, items)).withColumn("passage", F.trim(F.regexp_replace(clean_extracted(F.col("text")), r"(?U)\s+", " "))).where("passage <> ''")
    best = F.coalesce(F.get(evidence(F.col("text"), F.col("tokens"), 1), F.lit(0))["unit"], F.lit(""))
    rows = rows.withColumn("best", best)
    led = (F.col("best") != "") & ~F.contains(F.substring("passage", 1, PASSAGE_START), F.col("best"))
    body = F.trim(F.substring(F.when(led, F.concat("best", F.lit(" ... "), "passage")).otherwise(F.col("passage")), 1, PASSAGE_CHARS))
    facts = [("year", has("year", "string")), ("type", has("source_type", "string")), ("numeric_properties", F.array_join(has("numeric_properties", "array<string>"), ","))]
    meta = F.concat_ws("; ", *[F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}="), value)) for name, value in facts])
    theme = F.coalesce(F.nullif(has("theme_id", "string"), F.lit("")), F.lit("unknown"))
    line = F.concat(F.lit("["), "ref", F.lit("] theme="), theme, F.lit("; source="), human_source_name(F.col("source_name")), F.lit("; score="), F.col("score").cast("string"), F.lit("; "), meta, F.lit("\n"), body)
    rows = rows.select("question_id", "place", line.alias("line"))
    used = F.sum(F.length("line")).over(Window.partitionBy("question_id").orderBy("place"))  # of no more than ``items`` rows
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("place"))
    return rows.withColumns({"used": used, "n": order}).where((F.col("used") <= chars) | (F.col("n") == 1)).select("question_id", "place", "line")
