"""Text functions, each from Column to Column."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _fold_table() -> tuple[str, str]:
    """Letters with a single ASCII base letter, and those letters."""
    source, target = "łŁøØđĐıİ", "lLoOdDiI"
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(code) and chr(code) not in source:
            source, target = source + chr(code), target + base
    return source, target


FOLD_FROM, FOLD_TO = _fold_table()
MARKS = "[̀-ͯ]"


def fold(c: Column) -> Column:
    """Latin letters without diacritics; æ and ß become two letters."""
    for letter, plain in (("æ", "ae"), ("Æ", "AE"), ("ß", "ss")):
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), MARKS, "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_key(c: Column) -> Column:
    """The key under which two spellings of a title are the same; never written back."""
    return collapse(F.regexp_replace(fold(F.lower(c)), r"[^\w\s]", ""))


def search_fold(c: Column) -> Column:
    plain = "".join(a for a in FOLD_FROM[8:])
    return F.trim(F.lower(F.regexp_replace(F.translate(c, plain, FOLD_TO[8:]), MARKS, "")))


def slug(c: Column, cap: int = 80) -> Column:
    s = F.regexp_replace(F.lower(search_fold(c)), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, cap)
    return F.regexp_replace(s, "-+$", "")


def film_slug(title: Column, year: Column, id_: Column) -> Column:
    """Title and year, or id without a year; a title that leaves nothing gives the suffix alone."""
    suffix = F.coalesce(year.cast("string"), id_.cast("string"))
    base = slug(title)
    return F.coalesce(F.nullif(F.concat_ws("-", F.nullif(base, F.lit("")), suffix), F.lit("")), F.lit("untitled"))


# Words of exhibition formats and cycles on posters.
SEARCH_NOISE = (
    r"(?iu)\b(?:con\s+m[uú]sica\s+en\s+vivo|m[uú]sica\s+en\s+vivo|en\s+\d+\s?mm|\d+\s?mm|copia\s+(?:nueva|restaurada|en\s+\d+\s?mm)"
    r"|versi[oó]n\s+restaurada|preestreno|avant[\s-]?premi[eè]re|[uú]nica\s+funci[oó]n|funci[oó]n\s+[uú]nica|estreno|4k|doblada|subtitulada|vose?|vos)\b"
)
# An edition of a festival behind a dash.
FESTIVAL_TAIL = r"\s*[-–—]\s*(?:\d+\s*[°ºªo]\s*)?[A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑ0-9.°º]*(?:\s+[A-ZÁÉÍÓÚÜÑ0-9.°º]+){0,4}\s*$"
# Words that begin a cycle's name before a colon.
CYCLE_HEAD = r"(?iu)^\s*(?:FESTIVAL|CONVOCATORIA|CICLO|MUESTRA|RETROSPECTIVA|COMPETENCIA|SEMANA|PROGRAMA|CORTOS|CORTOMETRAJES?)\b[^:]{0,40}:\s*"
# Titles that are no film but hold several.
CONTAINER = (
    r"(?iu)\bRETROSPECTIVA\b", r"(?iu)\bCICLO\b", r"(?iu)\bFESTIVAL\b", r"(?iu)\bSORPRESA\b",
    r"(?iu)\bPROGRAMA\s+(?:\d+|I{1,3}|IV|VI{0,3}|IX|XI{0,3}|X|DOBLE)\b", r"(?iu)\bCORTOMETRAJES?\b", r"(?iu)\bCORTOS\b",
    r"(?iu)\b(?:EN|DE)\s+COMPETENCIA\b", r"(?iu)\bCOMPETENCIA\s+(?:OFICIAL\s+[A-ZÁÉÍÓÚÑ]|(?!OFICIAL\b|DESLEAL\b)[A-ZÁÉÍÓÚÑ])",
    r"(?iu)\bCONVOCATORIA\b", r"(?iu)\bPROYECCIONES\s+DE\s+CORTOS\b", r"(?iu)\bMUESTRA\s+DE\b",
)
# Shapes of such titles.
CONTAINER_SHAPE = (
    *CONTAINER, r"(?iu)\bMUESTRA\b", r"(?iu)\bSEMANA\s+DE(?:L)?\s+CINE\b", r"(?iu)\bCORTOS?\b",
    r"(?iu)\b(?:PEL[IÍ]CULA|FUNCI[OÓ]N|PREESTRENO|FILM)\b[^.]{0,20}\bSORPRESA\b",
)
# Keywords in order of priority.
SUGGESTED = ("FESTIVAL", "RETROSPECTIVA", "MUESTRA", "CICLO", "SEMANA", "CONVOCATORIA", "SORPRESA", "CORTOMETRAJES", "CORTOS")
# What is no feature film, and why, in order.
NON_FEATURE = (
    (r"(?iu)^\s*SESIONES\s+CLUB\s+LUCERO\b", "DJ/visual session"),
    (r"(?iu)^\s*FLEABAG\b", "theatre monologue + TV pilot"),
    (r"(?iu)\bPILOTO\s+DE\s+LA\s+SERIE\b", "TV pilot"),
    (r"(?iu)\bCAP[IÍ]TULOS?\s*\d", "TV episodes"),
    (r"(?iu)\bTEMPORADA\s*\d", "TV season"),
    (r"(?iu)\b(CORTOS|CORTOMETRAJES)\b", "shorts programme"),
)
# Labels of genres.
GENRES = {
    28: "Acción", 12: "Aventura", 16: "Animación", 35: "Comedia", 80: "Crimen", 99: "Documental", 18: "Drama", 10751: "Familia",
    14: "Fantasía", 36: "Historia", 27: "Terror", 10402: "Música", 9648: "Misterio", 10749: "Romance", 878: "Ciencia ficción",
    10770: "Película de TV", 53: "Suspense", 10752: "Bélica", 37: "Western",
}
# Labels of tags.
TAGS = {"unique": "ÚNICA FUNCIÓN", "restored": "COPIA RESTAURADA", "retrospective": "RETROSPECTIVA", "premiere": "ESTRENO", "cycle": "CICLO", "vos": "VOS", "dubbed": "DOBLADA"}


def strip_noise(c: Column) -> Column:
    """A title without parentheses, cycle head, festival tail and format words; as it was if nothing is left."""
    s = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " ")
    for pattern in (CYCLE_HEAD, FESTIVAL_TAIL, SEARCH_NOISE):
        s = F.regexp_replace(s, pattern, " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\s{2,}", " "), r"[\s\-–—:,]+$", "")
    return let(F.trim(s), lambda x: F.when(x == "", c).otherwise(x))


def matches_any(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def is_container(title: Column) -> Column:
    return let(strip_noise(title), lambda s: matches_any(s, CONTAINER))


def non_feature_reason(title: Column) -> Column:
    """The first rule that fits, or null."""
    out = F.lit(None).cast("string")
    for pattern, why in reversed(NON_FEATURE):
        out = F.when(title.rlike(pattern), why).otherwise(out)
    return out


def miss_cause(title: Column, director: Column) -> Column:
    shape = matches_any(title, CONTAINER_SHAPE) | let(strip_noise(title), lambda s: matches_any(s, CONTAINER_SHAPE))
    return F.when(shape, "container-or-placeholder").when(F.length(F.trim(director)) > 0, "localized-title-miss").otherwise("unfixable")


def suggested_keyword(title: Column) -> Column:
    """The first known keyword in the stripped title, in order of priority."""

    def first(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for word in reversed(SUGGESTED):
            out = F.when(s.rlike(rf"(?iu)\b{word}\b"), word).otherwise(out)
        return out

    return let(strip_noise(title), first)


def title_forms(c: Column) -> Column:
    """The title, and what stands before a subtitle: before a comma, a colon or a dash between spaces."""
    short = F.trim(F.regexp_replace(c, r"(?s)\s*([,:]|\s[-–—]\s).*", ""))
    return F.array_distinct(F.array(c, F.when(short == "", c).otherwise(short)))


def is_all_caps(c: Column) -> Column:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & (letters == F.upper(letters)) & ~letters.rlike(r"[^\p{Lu}]")


def sentence_case(c: Column) -> Column:
    """Lower case, with a capital at the start and after . ! or ?"""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"[^.!?]*[.!?]*"), F.lit(0))
    cap = lambda s: F.concat(F.regexp_extract(s, r"^([^\p{L}]*)", 1), F.upper(F.regexp_extract(s, r"^[^\p{L}]*(\p{L})", 1)), F.regexp_replace(s, r"^[^\p{L}]*\p{L}?", ""))
    return F.concat_ws("", F.transform(parts, cap))


def case_if_all_caps(c: Column) -> Column:
    return F.when(is_all_caps(c), sentence_case(c)).otherwise(c)


def display_title(venue_title: Column, catalog_title: Column, matched: Column) -> Column:
    """The venue's title, unless a matched catalog title differs from it in spelling alone."""
    return F.when(matched & (slug(venue_title) == slug(catalog_title)), catalog_title).otherwise(case_if_all_caps(venue_title))


# Particles of names.
PARTICLES = ("de", "del", "la", "las", "los", "y", "e", "da", "di", "von", "van")


def person_case(c: Column) -> Column:
    words = F.split(F.lower(collapse(c)), " ")
    return F.concat_ws(" ", F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(F.initcap(w))))


def clean_text(c: Column) -> Column:
    """Tidy white space and commas, no age marks, at most two line ends; null if a letter or less is left."""
    s = F.regexp_replace(c, r"\s*\(\+\d+\)", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r" ?, ?", ", ")
    s = F.trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))
    return F.when(F.length(s) > 1, s)


def drop_echo(program: Column, title: Column) -> Column:
    """The programme's name, or null where it repeats the title."""
    return F.when(search_fold(program) != search_fold(title), program)


def split_directors(c: Column) -> Column:
    """Single names, then the whole credit."""
    names = F.filter(F.split(c, r"(?i)\s*(?:,|/|&|\+|\by\b|\be\b|\band\b)\s*"), lambda x: x != "")
    return F.array_distinct(F.array_append(names, c))


# Given names that stand for each other.
GIVEN_NAMES = (
    ("charles", "charlie", "charley", "chuck"), ("steven", "stephen", "steve"), ("william", "will", "bill", "billy"), ("robert", "bob", "bobby", "rob"),
    ("richard", "rick", "ricky", "dick"), ("michael", "mike", "micky"), ("thomas", "tom", "tommy"), ("james", "jim", "jimmy"), ("joseph", "joe", "joey"),
    ("daniel", "danny"), ("anthony", "tony"), ("edward", "eddie", "ted"), ("alexander", "alex"), ("nicholas", "nick"), ("benjamin", "ben"), ("samuel", "sam"),
    ("catherine", "katherine", "kathryn", "kate", "cathy"), ("elizabeth", "liz", "beth", "betty"), ("margaret", "maggie", "peggy"),
    ("francisco", "paco", "pancho", "curro"), ("jose", "pepe"), ("ignacio", "nacho"), ("enrique", "quique"), ("manuel", "manolo"),
    ("alejandro", "jandro"), ("antonio", "tono"), ("dolores", "lola"), ("guadalupe", "lupe"), ("concepcion", "concha"),
)


def name_class(given: Column) -> Column:
    out = given
    for group in GIVEN_NAMES:
        out = F.when(given.isin(*group), group[0]).otherwise(out)
    return out


def same_person(a: Column, b: Column, least: int = 6) -> Column:
    """Equal folded names, one typing error in names of `least` letters, or equal surnames with equivalent given names."""
    x, y = collapse(F.lower(fold(a))), collapse(F.lower(fold(b)))
    near = (F.length(x) >= least) & (F.length(y) >= least) & (F.levenshtein(x, y, 1) >= 0)
    rest = lambda s: F.regexp_extract(s, r"^\S+ (.+)$", 1)
    kin = (rest(x) != "") & (rest(x) == rest(y)) & (name_class(F.split(x, " ")[0]) == name_class(F.split(y, " ")[0]))
    return (x == y) | near | kin


def directors_match(listed: Column, credited: Column) -> Column:
    """Whether any name of a credit line is one of an array of names."""
    return F.exists(split_directors(listed), lambda a: F.exists(credited, lambda b: same_person(a, b)))


def is_latin(c: Column) -> Column:
    return fold(c).rlike("[A-Za-z]")


def comparable_scripts(a: Column, b: Column) -> Column:
    return is_latin(a) == is_latin(b)


def latin_name(name: Column, other: Column) -> Column:
    """The name, or the other one where only that is in Latin letters."""
    return F.when(~is_latin(name) & is_latin(other), other).otherwise(name)


def year_acceptable(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1, F.lit(True))


def year_concrete(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1, F.lit(False))


def genre_labels(ids: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in GENRES.items() for x in pair])
    return F.array_compact(F.transform(ids, lambda i: names[i]))


def tag_labels(tags: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    return F.transform(tags, lambda t: F.coalesce(names[t], t))


def meta_line(year: Column, country: Column, runtime: Column) -> Column:
    return F.concat_ws(" · ", year.cast("string"), country, F.concat(F.nullif(runtime, F.lit(0)).cast("string"), F.lit(" min")))


def link_set(ext_id: Column, imdb: Column, source: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("catalog:"), ext_id.cast("string")), F.concat(F.lit("imdb:"), imdb), F.concat(F.lit("venue:"), source)))


def city(neighbourhood: Column, other: dict[str, str], home: str) -> Column:
    out = F.lit(home)
    for place, name in other.items():
        out = F.when(neighbourhood == place, name).otherwise(out)
    return out


def try_percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))
