"""Word lists, patterns and tables that results depend on."""

from __future__ import annotations

# Search stop words.
STOP_WORDS = [
    "как", "что", "это", "для", "или", "при", "про", "над", "под", "без", "есть", "где", "какие", "какая", "какой",
    "какое", "найди", "покажи", "расскажи", "сделай", "укажи", "между", "если", "были", "было", "from", "with",
    "the", "and", "for", "what", "where", "show", "find", "about",
]

# Terms whose presence in a chunk counts, by kind.
PROCESS_TERMS = [
    "electrowinning", "electrorefining", "leaching", "smelting", "flotation", "roasting",
    "solvent extraction", "precipitation", "neutralization", "refining", "газоочист", "выщелач",
    "электроэкстрак", "электрорафинир", "плавк", "флотац", "обжиг", "экстракц", "осажд",
    "буровзрыв", "взрывн", "blasting", "blast", "сейсмограмм", "велосиграмм",
    "динамический расчет", "dynamic analysis",
]
MATERIAL_TERMS = [
    "nickel", "cobalt", "copper", "catholyte", "anolyte", "matte", "slag", "pgm", "so2",
    "никель", "кобальт", "медь", "католит", "анолит", "штейн", "шлак", "мпг", "сернист",
    "hydroxide", "гидроксид", "solution", "раствор", "ore", "руда", "concentrate", "концентрат",
]
PROPERTY_TERMS = [
    "temperature", "concentration", "flow", "current density", "ph", "pressure", "recovery", "distribution",
    "температур", "концентрац", "скорост", "расход", "плотность тока", "давлен", "извлечен", "распределен",
    "частот", "frequency", "ppv", "pvs", "скорость смещения", "скорость колеб",
]

# Units. canonical name, multiplier, dimension, aliases.
UNITS = [
    ("mg/L", 1.0, "concentration", ["мг/л", "mg/l"]),
    ("mg/dm3", 1.0, "concentration", ["мг/дм3", "мг/дм³", "mg/dm3", "mg/dm³"]),
    ("g/L", 1000.0, "concentration", ["г/л", "g/l"]),
    ("ppm", 1.0, "concentration", ["ppm"]),
    ("percent", 1.0, "fraction", ["%", "процент", "percent"]),
    ("C", 1.0, "temperature", ["°c", "° c", "degc", "c"]),
    ("K", 1.0, "temperature", ["k", "к"]),
    ("L/min", 1.0, "flow_rate", ["л/мин", "l/min"]),
    ("m3/h", 1.0, "flow_rate", ["м3/ч", "м³/ч", "m3/h", "m³/h"]),
    ("m/s", 1.0, "velocity", ["м/с", "m/s"]),
    ("cm/s", 0.01, "velocity", ["см/с", "cm/s"]),
    ("A/m2", 1.0, "current_density", ["а/м2", "а/м²", "a/m2", "a/m²"]),
    ("A/dm2", 100.0, "current_density", ["а/дм2", "а/дм²", "a/dm2", "a/dm²"]),
    ("pH", 1.0, "ph", ["ph"]),
    ("t/day", 1.0, "productivity", ["т/сут", "t/day"]),
    ("t/h", 1.0, "productivity", ["т/ч", "t/h"]),
    ("min", 1.0, "time", ["мин", "min"]),
    ("h", 1.0, "time", ["ч", "h"]),
]

# Properties that fit a dimension, and the one taken, with its confidence, where none is named.
PROPERTIES_OF = {
    "concentration": ["concentration", "dry_residue"],
    "temperature": ["temperature"],
    "flow_rate": ["flow_rate"],
    "velocity": ["flow_rate"],
    "current_density": ["current_density"],
    "ph": ["ph"],
    "fraction": ["extraction_recovery", "distribution"],
    "productivity": ["productivity"],
}
FALLBACK_PROPERTY = {
    "concentration": ("concentration", 0.66),
    "temperature": ("temperature", 0.72),
    "flow_rate": ("flow_rate", 0.70),
    "velocity": ("flow_rate", 0.68),
    "current_density": ("current_density", 0.73),
    "ph": ("ph", 0.90),
    "fraction": ("extraction_recovery", 0.55),
    "productivity": ("productivity", 0.72),
}

# Readiness of a theme.
READINESS = {
    "failed": -1,
    "not_ready": 0,
    "parsed_ready": 1,
    "search_ready": 2,
    "cheap_kg_ready": 3,
    "retrieval_kg_ready": 4,
    "compressed_kg_ready": 4,
    "full_kg_ready": 5,
}

# Numbers with a unit, as chunk scoring, indexing and search each look for them (Java syntax).
_NUMBER = r"(?iu)(?<![\w.,+-])[+-]?(?:\d{1,3}(?:[\s\u00A0]\d{3})+|\d+)(?:[,.]\d+)?\s*"
SCORING_NUMERIC = _NUMBER + r"(?:%|°\s*C|degC|мг/л|мг/дм3|мг/дм³|г/л|кг/т|см/с|мм/с|м/с|Гц|Hz|A/m2|А/м2|ppm|ppb)(?!\w)"
INDEX_NUMERIC = _NUMBER + r"(?:%|°\s*C|degC|мг/л|мг/дм3|мг/дм³|г/л|кг/т|см/с|мм/с|м/с|A/m2|А/м2|ppm|ppb|кПа|МПа)(?!\w)"
SEARCH_NUMERIC = r"(?iu)\d+(?:[,.]\d+)?\s*(?:°\s*c|c|к|%|мг/л|мг/дм3|мг/дм³|г/л|м/с|а/м2|a/m2|кпа|мпа)"

# Hints in a chunk's text.
PROCESS_HINT = (
    r"(?iu)\b(?:electrowinning|electrorefining|leaching|smelting|flotation|roasting|solvent extraction|precipitation|neutralization|refining)\b"
    r"|выщелач|электроэкстрак|электрорафинир|плавк|флотац|обжиг|экстракц|осажд|нейтрализ|рафинир|газоочист"
)
PROPERTY_HINT = (
    r"(?iu)\b(?:temperature|concentration|flow|current density|pressure|recovery|distribution|yield|ph)\b"
    r"|температур|концентрац|скорост|расход|плотность\s+тока|давлен|извлечен|распределен|выход|pH"
)
TABLE_LIKE = r"(?iu)\|.*\||\t| {2,}\S+ {2,}\S+|(?:табл|table)\.?\s*\d*"
SECTION_WORD = r"(?iu)\b(?:abstract|аннотац|introduction|введение|results|результат|discussion|обсуждение|conclusion|вывод|табл|table)\b"
TABLE_SEPARATOR = r"^\s*\|?\s*[-:]{2,}\s*(?:\|\s*[-:]{2,}\s*)+\|?\s*$"
SLIDE_BOILERPLATE = (
    r"(?iu)\b(?:спасибо\s+за\s+внимание|thank\s+you|контакт(?:ы|ная\s+информация)|содержание|agenda|план\s+доклада"
    r"|актуальность\s*$|цель\s+работы\s*$|структура\s+доклада|вопросы\?)\b"
)
ARTICLE_NOISE = (
    r"(?iu)\b(?:список\s+литературы|литература|references|bibliography|acknowledg(?:e)?ments|благодарности|copyright"
    r"|all\s+rights\s+reserved|doi:|удк|issn)\b"
)
NORMATIVE = r"(?iu)\b(?:должен|должна|должны|следует|необходимо|требовани[ея]|норма|ГОСТ|GOST|ISO|shall|must|requirement)\b"
CONTACTS = r"(?iu)\b[\w.%-]+@[\w.-]+\.[A-Za-zА-Яа-я]{2,}\b|\+?\d[\d\s().-]{7,}\d|https?://|www\."

# Characters and marks of extractors that clean-up replaces by a blank, and what a line of glyph noise looks like.
INVISIBLE = r"[\u00A0\uFEFF\uFFFD\u200B-\u200F\u202A-\u202E\u2060-\u206F]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
ODD_GLYPHS = (
    r"[\u00A1-\u00AF\u00B4\u00B6-\u00BF\u00C0-\u00D6\u00D8-\u00FF\u0100-\u024F\u0250-\u02AF\u0300-\u036F"
    r"\u1D00-\u1D7F\u2C60-\u2C7F\uA720-\uA7FF]"
)
IMAGE_MARK = r"(?i)<!-+\s*image\s*-+>|\[image\]|\(image\)"
GOOD_CHARACTERS = r"\p{L}\p{N}°%.,;:/\\\-+()\[\]{}№#=<>≤≥±×·"
LETTER = "[A-Za-zА-Яа-яЁё]"
SPACED_LETTERS = rf"(?:^|\s)(?:{LETTER}\s+){{8,}}{LETTER}(?:\s|$)"
GLYPH_RUN = r"[\x00-\x1F]|[\u0370-\u03FF]{8,}|[\u0180-\u024F]{8,}"

#: What clean-up may change in one line, beside blanks and image marks: other characters than these, single letters in a row, eleven characters that aren't good ones. Separate, as these are fast alone.
_BAD = "!\"$&'*?@^_`|~"
UNTIDY = [r"(?!\u00B0)[^ -~\u0400-\u04FF]|[\u0482-\u0489]", IMAGE_MARK, f" {LETTER} {LETTER} {LETTER} ", f"(?:[{_BAD}][^{_BAD}]*+){{11}}".replace("^_`", r"\^_`")]

# Types of documents (Java syntax).
STANDARD_NUMBER = r"(?iU)\b(?:ГОСТ|GOST|СТО|ОСТ|ТУ)\s*[РR]?\s*\d+[\d.\-:]*"
PATENT_WORD = r"(?iU)\bпатент\b|\bpatent\b"
JOURNAL_WORD = r"(?iU)\b(?:аннотация|abstract|ключевые слова|keywords|удк|doi)\b"
REPORT_WORD = r"(?iU)\bотчет\b|\bпротокол\b|\breport\b"

# Section types in the order in which they are tried, and those of presentations after them.
SECTIONS = [
    ("abstract", "аннотация|abstract|резюме|summary"),
    ("introduction", "введение|introduction|актуальность"),
    ("methods", r"методика|материалы\s+и\s+методы|методы|эксперимент|оборудование|methods?|experimental|procedure"),
    ("results", r"результаты|обсуждение\s+результатов|results?|полученные\s+данные"),
    ("discussion", "обсуждение|discussion"),
    ("conclusion", "заключение|выводы|conclusions?"),
    ("requirements", r"требования|нормы|нормативные\s+требования|shall|must|requirements?"),
    ("definitions", r"термины\s+и\s+определения|definitions?|обозначения"),
    ("appendix", "приложение|appendix|annex"),
    ("references", r"список\s+литературы|литература|references|bibliography"),
]
SLIDE_SECTIONS = [
    ("introduction", "актуальность|цель|задачи"),
    ("methods", "прибор|оборудование|методика|измерени"),
    ("results", "результат|зарегистрирован|получен|анализ"),
]

# Lines that are taken out before chunking, and the types of documents that lose their list of references.
PAGE_NUMBER = r"(?iu)^\s*(?:стр\.?|страница|page|p\.?|с\.?)?\s*\d{1,4}\s*(?:из|of|/)?\s*\d{0,4}\s*$"
REFERENCE_HEADING = r"(?iu)^\s*(?:список\s+литературы|литература|библиограф(?:ия|ический\s+список)|references|bibliography|works\s+cited)\s*$"
FOOTNOTE = r"(?iu)^\s*(?:\[\d{1,3}\]|\d{1,3}[).]|[*†‡])\s+(?:https?://|www\.|doi:|источник:|примечан|ibid\b|там\s+же)"
BARE_LINK = r"(?i)^\s*(?:doi:|https?://|www\.)\S+\s*$"
APPENDIX_HEADING = r"(?iU)^\s*(?:приложение|appendix|annex)\b"
LOSE_REFERENCES = ["article", "pdf_report", "report", "standard", "generic"]
TABLE_LINE = r"^\s*\|.+\|\s*$"
