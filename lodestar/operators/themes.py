"""Themes of documents: from paths, names, URLs and content, with the evidence and confidence of each step."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key, normalize, path_parts, path_years, slug, text_or_empty, theme_from_file_name
from ..workspace import Workspace

# Collections with their aliases, and the source type of each.
COLLECTIONS = {
    "журналы": ["журнал", "journal", "journals", "articles", "article", "papers", "статьи", "статья"],
    "конференции": ["конференция", "conference", "conferences", "proceedings", "symposium", "alta", "conference_papers"],
    "патенты": ["патент", "patent", "patents"],
    "отчёты": ["отчеты", "отчет", "отчёт", "reports", "report", "protocols", "протоколы", "протокол"],
    "стандарты": ["нормативы", "нормативная", "стандарт", "gost", "гост", "standards", "standard"],
    "презентации": ["презентация", "presentations", "presentation", "slides"],
    "книги": ["книга", "book", "books", "monograph", "монография"],
    "геотехника": ["geotechnics", "geotech", "сейсмика", "seismics", "бвр", "буровзрыв"],
    "гидрометаллургия": ["hydrometallurgy", "leaching", "выщелачивание", "электроэкстракция"],
    "пирометаллургия": ["pyrometallurgy", "smelting", "плавка", "штейн", "шлак"],
    "экология": ["environment", "environmental", "газоочистка", "water", "воды"],
}
SOURCE_TYPES = {
    "журналы": "journal_article",
    "конференции": "conference_paper",
    "патенты": "patent",
    "отчёты": "report_or_protocol",
    "стандарты": "standard",
    "презентации": "presentation",
    "книги": "book",
    "геотехника": "report_or_article",
    "гидрометаллургия": "report_or_article",
    "пирометаллургия": "report_or_article",
    "экология": "report_or_article",
}
# Source types by words, in order, where the collection does not tell.
SOURCE_TYPE_WORDS = [
    ("patent|патент", "patent"),
    ("gost|гост|standard|стандарт", "standard"),
    ("conference|proceedings|конференц|alta", "conference_paper"),
    ("journal|журнал|статья|article|цветные металлы|горная промышленность", "journal_article"),
    ("presentation|презентац|slides", "presentation"),
    ("report|отчет|protocol|протокол", "report_or_protocol"),
]
# Names of folders that say nothing; more can be given.
GENERIC = [
    "data", "datas", "docs", "documents", "document", "files", "file", "source", "sources", "исходники", "материалы", "corpus", "root",
    "root_dir", "misc", "разное", "прочее",
]
# Patterns that decide at once: pattern, collection, theme, source type.
OVERRIDES = [
    (r"ALTA.*Ni.*Co", "конференции", "ALTA_Ni_Co", "conference_paper"),
    (r"SO2|SO₂|сернист|sulfur\s*dioxide|sulphur\s*dioxide|газоочист", "экология", "SO2_removal", "report_or_article"),
    (r"Горн(?:ая|ой).*промышленн", "журналы", "Горная промышленность", "journal_article"),
    (r"Цветные\s*металлы|ЦМ", "журналы", "Цветные металлы", "journal_article"),
    (r"Смеш.*гидроксид|mixed\s*hydroxide|MHP", "гидрометаллургия", "mixed_hydroxides", "report_or_article"),
    (r"католит|catholyte|electrowinning|electro\s*winning|электроэкстрак", "гидрометаллургия", "nickel_electrowinning", "report_or_article"),
    (r"штейн.*шлак|matte.*slag|slag.*matte|МПГ|PGM|platinum\s*group", "пирометаллургия", "matte_slag_partitioning", "report_or_article"),
    (r"шахтн.*вод|mine\s*water|закачк.*горизонт", "экология", "mine_water", "report_or_article"),
    (
        r"сейсмограмм|велосиграмм|акселерограмм|сейсмовзрыв|буровзрыв|взрывн(?:ые|ых)?\s+работ|PPV|PVS|пиков.*скорост|скорост.*смещ|динамическ.*расчет|динамическ.*расчёт",
        "геотехника", "blasting_seismics", "report_or_article",
    ),
    (r"ГОСТ|GOST|standard|стандарт", "стандарты", "standards", "standard"),
]
# Themes by file name, with their evidence, and by content.
FILE_RULES = [
    (r"alta.*ni.*co", "ALTA_Ni_Co", "filename:ALTA_Ni_Co"),
    (r"горн.*промышлен", "Горная промышленность", "filename:journal_name"),
    (r"цветн.*металл|\bцм\b", "Цветные металлы", "filename:journal_name"),
    (r"so2|so₂|сернист|газоочист", "SO2_removal", "filename:domain_pattern"),
    (r"смеш.*гидроксид|mixed.*hydroxide|\bmhp\b", "mixed_hydroxides", "filename:domain_pattern"),
    (r"католит|electrowinning|электроэкстрак", "nickel_electrowinning", "filename:domain_pattern"),
    (r"штейн|matte|slag|шлак|мпг|pgm", "matte_slag_partitioning", "filename:domain_pattern"),
    (r"шахт.*вод|mine.*water", "mine_water", "filename:domain_pattern"),
]
CONTENT_RULES = [
    (r"so2|so₂|сернист|газоочист|sulfur dioxide", "SO2_removal"),
    (r"католит|catholyte|electrowinning|электроэкстрак", "nickel_electrowinning"),
    (r"штейн|matte|slag|шлак|мпг|pgm|platinum group", "matte_slag_partitioning"),
    (r"смешан.*гидроксид|mixed hydroxide|\bmhp\b", "mixed_hydroxides"),
    (r"шахтн.*вод|mine water", "mine_water"),
    (
        r"сейсмограмм|велосиграмм|акселерограмм|сейсмовзрыв|буровзрыв|взрывн(?:ые|ых)?\s+работ|ppv|pvs|пиков.*скорост|скорост.*смещ|динамическ.*расчет",
        "blasting_seismics",
    ),
]
THEME_COLLECTION = {"blasting_seismics": "геотехника"}
PREVIEW_CHARS = 5000


@dataclass(frozen=True)
class ThemeRules:
    """What decides a theme. Given collections and overrides come in addition to the built-in ones, overrides after them.

    ``overrides``: (pattern, collection, theme) or with a source type.
    ``content_term``: a column with a term of the content, where there is one.
    """

    collections: dict[str, list[str]] = field(default_factory=dict)
    overrides: tuple[tuple[str, ...], ...] = ()
    generic: tuple[str, ...] = ()
    default_collection: str = "general"
    default_theme: str = "general"
    least_confidence: float = 0.55
    collapse: bool = True
    content_term: str | None = None
    built_in: bool = True

    def aliases(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, others in [*(COLLECTIONS.items() if self.built_in else ()), *self.collections.items()]:
            out |= {_key(x): name for x in (name, *others)}
        return out

    def all_overrides(self) -> list[tuple[str, str, str, str | None]]:
        own = [(*o, None)[:4] for o in self.overrides]
        return [*(OVERRIDES if self.built_in else []), *own]


def _key(text: str) -> str:
    return "".join(c for c in text.lower().replace("ё", "е") if c.isascii() and c.isalnum() or "а" <= c <= "я")


def _first(rules: list[tuple], hay: Column, place: int, flags: str = "(?iU)") -> Column:
    """What stands at ``place`` of the first rule whose pattern the text has, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(hay.rlike(flags + rule[0]), rule[place]).otherwise(out)
    return out


def source_type(collection: Column, name: Column, hay: Column) -> Column:
    """By collection, else by words of path, content and name, else by the name's extension."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv]), collection)
    low = normalize(F.concat(hay, F.lit(" "), name))
    slides = F.when(name.rlike(r"(?i)\.pptx?$"), "presentation")
    *before, last = SOURCE_TYPE_WORDS
    return F.coalesce(known, _first(before, low, 1), slides, _first([last], low, 1), F.lit("report_or_article"))


def resolve(rows: DataFrame, rules: ThemeRules = ThemeRules(), path: str = "relative_path", preview: str = "preview") -> DataFrame:
    """``rows`` with theme_id, collection, theme_name, source_name, year, source_type, confidence and evidence; all one projection.

    An override on path and content decides at once (0.98). Else the first folder
    that names a collection gives it (0.55), and the first folder below it that
    says something the theme (0.85). Else the file's name decides, by rules (0.75)
    or as it is (0.60), else the content, by rules (0.75) or a term (0.55), else
    the defaults. A year in the path adds 0.03, up to 0.99. Themes by a bare name
    or term that fall short of the least confidence become the default.
    """
    c = F.col
    content = F.substring(text_or_empty(preview), 1, PREVIEW_CHARS) if preview in rows.columns else F.lit("")
    aliases = rules.aliases()
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    named = lambda p: F.element_at(table, alnum_key(p))
    silent = [*map(_key, (*GENERIC, *rules.generic)), ""]
    generic = lambda p: alnum_key(p).isin(*silent) | F.trim(p).rlike(r"^(?:19|20)\d{2}(?:\s*(?:г|год|year))?$")

    d = rows.withColumn("_all", path_parts(path))
    artificial = (F.size("_all") >= 3) & named(F.get("_all", F.lit(1))).isNotNull() & named(F.get("_all", F.lit(0))).isNull()
    d = d.withColumn("_parts", F.when(artificial, F.slice("_all", 2, F.size("_all"))).otherwise(c("_all")))
    d = d.withColumn("_file", F.coalesce(F.element_at("_parts", -1), F.lit("document")))
    d = d.withColumn("_hay", F.concat(F.array_join("_parts", "/"), F.lit("\n"), content))
    folders = F.when(F.size("_parts") > 1, F.slice("_parts", 1, F.size("_parts") - 1)).otherwise(c("_parts"))
    d = d.withColumn("_folders", F.transform(folders, lambda p, i: F.struct(p.alias("p"), i.alias("i"), named(p).alias("c"), generic(p).alias("g"))))
    d = d.withColumn("_at", F.get(F.filter("_folders", lambda f: f["c"].isNotNull()), F.lit(0)))
    below = F.filter("_folders", lambda f: (f["i"] > c("_at.i")) & (F.size("_parts") > 1) & f["c"].isNull() & ~f["g"])
    d = d.withColumn("_theme", F.when(c("_at").isNotNull(), F.get(below, F.lit(0))["p"])).withColumn("year", F.get(path_years(c("_parts")), F.lit(0)))
    over = rules.all_overrides()
    d = d.withColumns({"_o": _first(over, c("_hay"), 2), "_oc": _first(over, c("_hay"), 1), "_os": _first(over, c("_hay"), 3)})

    # what name and content tell
    name, low = normalize(c("_file")), normalize(content)
    file_rules, content_rules = (FILE_RULES, CONTENT_RULES) if rules.built_in else ([], [])
    auto = theme_from_file_name(c("_file"))
    d = d.withColumns({"_by_file": _first(file_rules, name, 1), "_file_says": _first(file_rules, name, 2), "_auto": F.when(~alnum_key(auto).isin(*silent[:-1]), auto)})
    d = d.withColumn("_by_content", _first(content_rules, low, 1)).withColumn("_term", c(rules.content_term) if rules.content_term else F.lit(None).cast("string"))
    told = F.coalesce("_by_file", "_auto", "_by_content", "_term")
    says = F.coalesce(
        c("_file_says"), F.when(c("_auto").isNotNull(), "filename:auto_theme"), F.when(c("_by_content").isNotNull(), "content_preview:domain_pattern"),
        F.when(c("_term").isNotNull(), "content_preview:ontology_terms"), F.lit("fallback:default_theme"),
    )
    sure = F.when(c("_by_file").isNotNull(), 0.75).when(c("_auto").isNotNull(), 0.60).when(c("_by_content").isNotNull(), 0.75).when(c("_term").isNotNull(), 0.55).otherwise(0.25)
    d = d.withColumns({"_told": told, "_says": says, "_sure": sure})

    by_theme = F.element_at(F.create_map(*[F.lit(x) for kv in THEME_COLLECTION.items() for x in kv]), c("_told"))
    in_path, themed = c("_at").isNotNull(), c("_theme").isNotNull()
    collection = F.coalesce(c("_oc"), c("_at.c"), by_theme, F.lit(rules.default_collection))
    theme = F.coalesce("_o", "_theme", "_told", F.lit(rules.default_theme))
    base = F.when(themed, 0.85).otherwise(F.greatest(F.when(in_path, 0.55).otherwise(0.25), c("_sure")))
    dated = c("year").isNotNull()
    confidence = F.when(c("_o").isNotNull(), 0.98).otherwise(F.least(F.lit(0.99), base + F.when(dated, 0.03).otherwise(0.0)))
    d = d.withColumns({"collection": collection, "_name": theme, "_base": F.round(confidence, 6)})
    guarded = c("_o").isNotNull() | themed | c("_by_file").isNotNull() | (c("_auto").isNull() & c("_by_content").isNotNull())
    falls = F.lit(rules.collapse) & (c("_name") != rules.default_theme) & (c("_base") < rules.least_confidence) & ~guarded
    d = d.withColumn("_falls", falls)
    lost = F.concat(F.lit("low_confidence_theme_collapsed:"), c("_name"), F.lit(":"), F.format_string("%.2f", "_base"), F.lit(f"<min:{rules.least_confidence:.2f}"))
    evidence = F.when(
        c("_o").isNotNull(), F.array_compact(F.array(F.lit("override_pattern"), F.when(dated, "year_detected")))
    ).otherwise(
        F.array_compact(
            F.array(
                F.when(in_path, F.concat(F.lit("path:collection:"), c("_at.p"))), F.when(themed, F.concat(F.lit("path:theme:"), c("_theme"))),
                F.when(~themed, c("_says")), F.when(dated, "year_detected"), F.when(c("_falls"), lost),
            )
        )
    )
    d = d.withColumns(
        {
            "theme_name": F.when(c("_falls"), rules.default_theme).otherwise(c("_name")),
            "confidence": F.round(F.when(c("_falls"), F.greatest(c("_base"), F.lit(min(rules.least_confidence, 0.55)))).otherwise(c("_base")), 3),
            "evidence": evidence,
            "source_name": c("_file"),
            "source_type": F.coalesce(c("_os"), source_type(c("collection"), c("_file"), c("_hay"))),
        }
    )
    d = d.withColumn("theme_id", F.concat(slug("collection"), F.lit("__"), slug("theme_name")))
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def from_urls(pages: DataFrame) -> DataFrame:
    """``pages`` (url) with collection, a two-letter first path segment, and theme, the first label of the host."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    first = F.get(path_parts(path), F.lit(0))
    host = F.regexp_extract("url", r"^[a-zA-Z]+://(?:www\.|m\.|blog\.|docs\.)?([^./?#]+)", 1)
    return pages.withColumn("collection", F.when(F.length(first) == 2, first).otherwise("general")).withColumn("theme", F.coalesce(F.nullif(host, F.lit("")), F.lit("general")))


def theme_distribution(resolved: DataFrame, least_documents: int = 2, least_chunks: int = 3, examples: int = 3, evidence: int = 4) -> DataFrame:
    """(theme_id, documents, chunks, examples, evidence, is_small) of ``resolved`` (theme_id, relative_path, chunks, evidence), the largest first.

    ``examples``: the least paths; ``evidence``: the most frequent kinds with their counts. Neither list is longer than asked for while it is gathered.
    """
    ws = Workspace(resolved.sparkSession, "themes")  # read three times below
    resolved = ws.save(resolved.select("theme_id", "relative_path", "chunks", "evidence"), "resolved")
    sums = resolved.groupBy("theme_id").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
    firsts = _ranked(resolved.select("theme_id", F.col("relative_path").alias("x"), F.col("relative_path").alias("o")), examples).alias("examples")
    counted = resolved.select("theme_id", F.explode("evidence").alias("e")).groupBy("theme_id", "e").agg(F.count("*").alias("n"))
    most = _ranked(counted.select("theme_id", F.concat("e", F.lit(":"), "n").alias("x"), F.struct((-F.col("n")).alias("n"), "e").alias("o")), evidence).alias("evidence")
    out = sums.join(firsts.withColumnRenamed("xs", "examples"), "theme_id", "left").join(most.withColumnRenamed("xs", "evidence"), "theme_id", "left")
    small = (F.col("documents") < least_documents) | (F.col("chunks") < least_chunks)
    return out.withColumn("is_small", small).orderBy(F.desc("documents"), "theme_id")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """(theme_id, xs): the first ``most`` x of each theme in order of o."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("theme_id").orderBy("o"))
    top = rows.withColumn("r", rank).where(F.col("r") <= most).groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("s"))
    return top.select("theme_id", F.transform("s", lambda s: s["x"]).alias("xs"))


def documents_by_theme(resolved: DataFrame, most: int = 30) -> DataFrame:
    """(theme_id, documents) of the largest themes."""
    return resolved.groupBy("theme_id").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "theme_id").limit(most)


def stamped(objects: DataFrame, themes: DataFrame, key: str = "relative_path") -> DataFrame:
    """``objects`` with the columns of their document's theme; those of the theme win."""
    own = ["theme_id", "collection", "theme_name", "year", "source_type", "confidence", "evidence"]
    return objects.drop(*own).join(themes.select(key, *own), key, "left")
