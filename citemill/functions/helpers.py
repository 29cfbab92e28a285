"""Scalar helpers besides the converters: escaping, labels, statuses, identifiers and fragments."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import converters as C
from .regex import quote

# ---- escaping and folding


def xml_escape(s) -> Column:
    out = C.text(s)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


#: Letters with marks and the plain letters that stand for them in a search.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(s) -> Column:
    """Lower case, without marks, any white space as one space."""
    return F.regexp_replace(F.translate(F.lower(C.text(s)), ACCENTED, PLAIN), r"[\s\u00A0\u2000-\u200A\u202F]+", " ")


def has_tags(s) -> Column:
    """A closing tag, or one that closes itself."""
    return C.text(s).rlike(r"(?i)</[a-z][^>]*>|<[a-z][^>]*/>")


def translated(template_of, key, params: dict[str, Column]) -> Column:
    """The template of key in a map (English where it is missing), with {{ name }} filled in."""
    out = F.coalesce(F.try_element_at(template_of, key), F.try_element_at(template_of, F.lit("EN")))
    for name, value in params.items():
        out = F.replace(out, F.lit("{{ " + name + " }}"), C.text(value))
    return out


def iso2(code) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in C.LANGUAGES.items() for x in p]), F.upper(C.text(code)))


def iso3(code) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for a, b in C.LANGUAGES.items() for x in (b, a)]), F.upper(C.text(code)))


def filled(template, name: str, value) -> Column:
    """{{ NAME|default }} by the value, or by its default where the value is empty."""
    t = C.text(template)
    default = F.regexp_extract(t, r"\{\{\s*" + name + r"\s*(?:\|([^}]*?))?\s*\}\}", 1)
    chosen = F.when(C.text(value) != "", C.text(value)).otherwise(default)
    parts = F.split(t, r"\{\{\s*" + name + r"\s*(?:\|[^}]*)?\}\}", -1)
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda a, x: F.concat(a, chosen, x))


def intersect(a: Column, b: Column) -> Column:
    """What the longer array shares with the other, in its order and as often as it stands there."""
    inside = lambda x, y: F.filter(x, lambda e: F.array_contains(y, e))
    return F.when(F.size(b) > F.size(a), inside(b, a)).otherwise(inside(a, b))


# ---- the official journal

# How the languages cite the official journal, with a page, without one, and act by act.
OJ_NAMES = {
    "EN": "OJ", "FR": "JO", "DE": "ABl.", "ES": "DO", "BG": "OB", "CS": "Úř. věst.", "DA": "EUT", "ET": "ELT", "EL": "ΕΕ", "GA": "IO", "HR": "SL", "IT": "GU",
    "LV": "OV", "LT": "OL", "HU": "HL", "MT": "ĠU", "NL": "PB", "PL": "Dz.U.", "PT": "JO", "RO": "JO", "SK": "Ú. v. EÚ", "SL": "UL", "FI": "EUVL", "SV": "EUT",
}
OJ_BEFORE_DATE = {"FR": " du ", "DE": " vom ", "ES": " de ", "DA": " af ", "EL": " της ", "IT": " del ", "NL": " van ", "PL": " z ", "PT": " de "}
OJ_AFTER_DATE = {"BG": "г.", "LV": ".", "HU": "."}
OJ_PAGE = {"DE": "S. {}", "BG": "стр. {}", "CS": "s. {}", "DA": "s. {}", "ET": "lk {}", "EL": "σ. {}", "GA": "lgh. {}", "HR": "str. {}", "IT": "pagg. {}", "LV": "{}. lpp.", "HU": "{} o.", "NL": "blz. {}", "PL": "str. {}", "SK": "s. {}", "SL": "str. {}", "FI": "s. {}", "SV": "s. {}"}
OJ_DATE = {"LT": "{2} {1} {0}", "HU": "{2}.{1}.{0}"}

def oj_parsed(label) -> Column:
    """Struct of form, part, prefix, year, number, date, first and last page; null where no form fits (paged, act, plain).

    A label is read by its comma parts: series and number (or year/number of an act), day, pages.
    """
    rest = F.regexp_extract(C.text(label), "(?i)OJ ([A-Z-]+ [0-9].*)", 1)
    parts = F.split(rest, ", ")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    series, place = (F.coalesce(F.get(F.split(at(0), " "), F.lit(i)), F.lit("")) for i in (0, 1))
    issue = F.element_at(F.split(place, "/"), -1)
    of_year = F.when(place.contains("/"), F.substring_index(place, "/", 1))
    day = F.regexp_extract(at(1), r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", 0)
    pages = F.regexp_extract(F.when(at(1) == day, at(2)), "(?i)^p\\. ([0-9]+-[0-9]+)", 1)
    form = F.when(of_year.isNotNull(), "act").when(F.coalesce(pages, F.lit("")) != "", "paged").otherwise("plain")
    sound = issue.rlike("(?i)^[0-9]+[A-Z]*\\z") & (day != "") & F.coalesce(of_year.rlike("^[0-9]{4}\\z"), F.lit(True)) & ~at(0).rlike(" .* ")
    page = lambda i: F.when(form == "paged", F.get(F.split(pages, "-"), F.lit(i)))
    prefix = F.when(of_year.isNotNull(), F.when(series == "C", "C/").otherwise(""))
    made = (form, series, prefix, of_year, issue, day, page(0), page(1))
    names = ("form", "part", "prefix", "year", "number", "date", "first_page", "last_page")
    return F.when(sound, F.struct(*[c.alias(n) for c, n in zip(made, names, strict=True)]))


def oj_translated(label, code: str) -> Column:
    """The label as the language cites it; labels of no known form stay."""
    oj, t = oj_parsed(label), C.text(label)
    name = F.lit(OJ_NAMES[code])
    parts = F.split(oj["date"], r"\.")
    day = oj["date"]
    if code in OJ_DATE:
        day = F.format_string(OJ_DATE[code].replace("{2}", "%3$s").replace("{1}", "%2$s").replace("{0}", "%1$s"), *[F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3)])
    dated = F.concat(name, F.lit(" "), oj["part"], F.lit(" "), oj["number"], F.lit(OJ_BEFORE_DATE.get(code, ", ")), day)
    page_before, page_after = OJ_PAGE.get(code, "p. {}").split("{}")
    # with a page Croatian puts a point after the date as well
    after_date = OJ_AFTER_DATE.get(code, "")
    paged = F.concat(dated, F.lit((after_date or ("." if code == "HR" else "")) + ", " + page_before), oj["first_page"], F.lit(page_after))
    act = F.concat(name, F.lit(" "), oj["part"], F.lit(", "), oj["prefix"], oj["year"], F.lit("/"), oj["number"], F.lit(", "), oj["date"])
    return F.when(oj["form"] == "paged", paged).when(oj["form"] == "act", act).when(oj["form"] == "plain", F.concat(dated, F.lit(after_date))).otherwise(t)


# ---- treaties

# Acronyms and long names of the treaties by the root of their identifier.
TREATIES = {
    "2016M": {"EN": ("TEU", "Treaty on European Union"), "FR": ("TUE", "Traité sur l'Union européenne"), "DE": ("EUV", "Vertrag über die Europäische Union")},
    "2016E": {"EN": ("TFEU", "Treaty on the Functioning of the EU"), "FR": ("TFUE", "Traité sur le fonctionnement de l'UE"), "DE": ("AEUV", "Vertrag über die Arbeitsweise der EU")},
    "2016A": {"EN": ("EAEC", "EAEC Treaty"), "FR": ("CEEA", "traité CEEA"), "DE": ("EAG", "EAG-Vertrag")},
    "2007L": {"EN": ("Treaty of Lisbon", "Treaty of Lisbon"), "FR": ("Traité de Lisbonne", "Traité de Lisbonne"), "DE": ("Vertrag von Lissabon", "Vertrag von Lissabon")},
    "1951K": {"EN": ("ECSC", "ECSC Treaty"), "FR": ("CECA", "traité CECA"), "DE": ("EGKS", "EGKS-Vertrag")},
}
ARTICLE = {"EN": "Article", "FR": "Article", "DE": "Artikel"}
ANNEX = {"EN": "Annex", "FR": "Annexe", "DE": "ANHANG"}


def treaty_title(celex, language_iso3: str = "ENG") -> Column:
    """Short title of a treaty or a part of it, null for other identifiers and languages."""
    code, t = C.language(language_iso3), C.text(celex)
    if code not in ARTICLE:
        return F.lit(None).cast("string")
    tail = F.when(F.length(t) >= 3, F.substring(t, -3, 3)).otherwise(t)
    article = F.when(tail.rlike("^[0-9]+\\z"), tail.try_cast("int"))
    annex = F.when(t.rlike("(?i)N[0-9]+\\z"), F.regexp_extract(t, r"(?i)N([0-9]+)\z", 1).try_cast("int"))
    root = F.substring(t, 2, 5)
    names = lambda i: F.create_map(*[F.lit(x) for k, v in TREATIES.items() for x in (k, v[code][i])])
    short, full = (F.try_element_at(names(i), root) for i in (0, 1))
    annex_title = F.concat(F.lit(ANNEX[code] + " "), C.to_roman(annex.cast("string")), F.lit(" "), short)
    return F.when(annex.isNotNull(), annex_title).when(article.isNotNull(), F.concat(F.lit(ARTICLE[code] + " "), article.cast("string"), F.lit(" "), short)).otherwise(full)


# ---- validity


def force_status(force, date_force, date_validity, initial_force, initial_validity, as_of) -> Column:
    """inforce, notinforce, nolongerinforce, pendinginforce or '' at a day; dates as ISO texts."""
    today = F.lit(str(as_of))
    f, initial = C.text(force), C.text(initial_force)
    nonzero = lambda x: F.coalesce(x.try_cast("int"), F.lit(0)) != 0
    base = F.when(nonzero(initial), "inforce").when((C.text(initial_validity) != "") & (C.text(initial_validity) < today), "nolongerinforce").otherwise("notinforce")
    own = F.when(nonzero(f), "inforce").when(F.substring(C.text(date_force), 1, 10) > today, "pendinginforce").when((C.text(date_validity) != "") & (C.text(date_validity) < today), "nolongerinforce").otherwise("notinforce")
    return F.when(f == "", F.when(initial == "", "").otherwise(base)).otherwise(own)


def pretty_date(s) -> Column:
    """2020-05-21 as 21/05/2020."""
    return F.array_join(F.reverse(F.split(C.text(s), "-")), "/")


def title_lines(s) -> Column:
    return F.replace(C.text(s), F.lit("#"), F.lit("<br>"))


def eli_label(eli) -> Column:
    link = F.concat(F.lit('ELI: <a href="'), C.text(eli), F.lit('" target="_blank">'), C.text(eli), F.lit("</a>"))
    return F.when(C.text(eli) != "", link).otherwise("")


def oj_label(oj) -> Column:
    return F.when(C.text(oj) != "", F.concat(F.lit("<br>"), C.text(oj), F.lit("<br>"))).otherwise("")


def consolidation_label(prefix: str, eli, day) -> Column:
    link = F.concat(F.lit(prefix + ' <a href="'), C.text(eli), F.lit('" target="_blank">'), pretty_date(day), F.lit("</a>"))
    return F.when((C.text(eli) != "") & (C.text(day) != ""), link).otherwise("")


def joined_cases(labels, connector: str = "and") -> Column:
    """a, b and c."""
    n = F.size(labels)
    head = F.array_join(F.slice(labels, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n <= 1, F.array_join(labels, "")).otherwise(F.concat(head, F.lit(f" {connector} "), F.element_at(labels, -1)))


def first_replaced(c: Column, pattern: str, by: str) -> Column:
    """The first hit of a pattern replaced; the pattern's groups are $1 and on in by."""
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", by)
    return F.regexp_replace(c, rf"\A((?s:.*?))(?:{pattern})", "$1" + shifted)


# What titles say of a recast, and of their relevance for the EEA, by language.
RECAST = {
    "BG": "преработен текст", "ES": "versión refundida", "CS": "přepracované znění", "DA": "omarbejdning", "DE": "Neufassung", "ET": "uuesti sõnastatud", "EL": "αναδιατύπωση", "EN": "recast", "FR": "refonte",
    "HR": "preinaka", "IT": "rifusione", "LV": "pārstrādāta redakcija", "LT": "nauja redakcija", "HU": "átdolgozás", "MT": "riformulazzjoni", "NL": "herschikking", "PL": "przekształcenie", "PT": "reformulação",
    "RO": "reformare", "SK": "prepracované znenie", "SL": "prenovitev", "FI": "uudelleenlaadittu", "SV": "omarbetning",
}
EEA_TEXTS = {
    "BG": "Текст от значение за ЕИП", "ES": "Texto pertinente a efectos del EEE", "CS": "Text s významem pro EHP", "DA": "EØS-relevant tekst", "DE": "Text von Bedeutung für den EWR", "ET": "EMPs kohaldatav tekst",
    "EL": "Κείμενο που παρουσιάζει ενδιαφέρον για τον ΕΟΧ", "EN": "Text with EEA relevance", "FR": "Texte présentant de l'intérêt pour l'EEE", "HR": "Tekst značajan za EGP", "IT": "Testo rilevante ai fini del SEE",
    "LV": "Dokuments attiecas uz EEZ", "LT": "Tekstas svarbus EEE", "HU": "EGT-vonatkozású szöveg", "MT": "Test b'rilevanza għaż-ŻEE", "NL": "Voor de EER relevante tekst", "PL": "Tekst mający znaczenie dla EOG",
    "PT": "Texto relevante para efeitos do EEE", "RO": "Text cu relevanță pentru SEE", "SK": "Text s významom pre EHP", "SL": "Besedilo velja za EGP", "FI": "ETA:n kannalta merkityksellinen teksti", "SV": "Text av betydelse för EES",
}
# Leftovers of what was taken out and their replacements, in this order; only the first of each is replaced.
LEFTOVERS = (("<i></i>,", ","), (". )", ")"), (".).", ")"), (", ,", ","), ("  .", "."), (" .", "."), (" , ", ", "), (". (", " ("), ("( ", "("), (" )", ")"))


def footnote_text(s, tidy_only: bool = False) -> Column:
    """A title cleaned for a footnote: without notes on recasts and the EEA in any language (unless tidy_only), leftovers tidied."""
    out = C.text(s)
    if not tidy_only:
        for code, eea in EEA_TEXTS.items():
            gap = "" if code == "SV" else r"\s?"
            out = F.regexp_replace(out, rf"\({RECAST[code]}\)|\(?{eea}\.?{gap}\)?", "")
    for leftover, by in LEFTOVERS:
        out = first_replaced(out, quote(leftover), by)
    out = F.replace(out, F.lit(" n. o "), F.lit(" n.º "))
    return F.regexp_replace(out, "[\u00a0\u202F ]{2,}", " ")


# ---- fragments of citations

# Codes of the parts of an act and their labels, and what may follow a head.
FRAGMENT_LABELS = {"A": "art.", "P": "par.", ".": "par.", "L": "al.", "PT": "pnt.", "TIT": "tit.", "N": "par.", "C": "rct."}
FRAGMENT_PATHS = r"^(?:A( [P.])?( L)?|P( L)?|N( A)?( P)?( L)?( PT)?|L|TIT)\z"


def fragment(s, celex=None) -> Column:
    """A02P1LB as art. 2 par. 1 pnt. b, and the other forms; a fragment of no form stays.

    A fragment is cut into pairs of a code and a number (or one letter, for lines of an article); each pair is looked up by its code.
    An article's pairs are read as far as they make sense, all others must fill the fragment.
    """
    t = C.text(s)
    head = F.substring(t, 1, 1)
    annexes = F.substring(C.text(celex), 1, 1).isin("1", "2", "3")  # acts number annexes where other texts number paragraphs
    label = lambda code: F.when((code == "N") & annexes, "anx.").otherwise(F.element_at(labels, code))
    labels = F.create_map(*[F.lit(x) for pair in FRAGMENT_LABELS.items() for x in pair])
    short = lambda n: F.regexp_replace(n, "^0", "")

    gap = F.when(head == "C", F.regexp_replace(t, r"\s-\s", "-")).otherwise(F.regexp_replace(t, r"\s?-\s?", "-"))
    numbers = F.split(F.trim(F.substring(gap, F.lit(2), F.length(gap))), " ")
    listed = F.concat(label(head), F.lit(" "), F.array_join(F.transform(numbers, short), ", "))

    rest = F.substring(t, F.lit(2), F.length(t))
    marks = (F.length(rest) > 0) & (F.translate(rest, "0123456789-. \t\n\x0b\f\r", "") == "")
    words = F.split(F.regexp_replace(rest, r"\A\s", ""), r"\s")
    digits = lambda i: F.coalesce(F.get(words, i).rlike(r"\A[0-9]+\z"), F.lit(False))
    between = lambda i: (F.get(words, i) == "-") & digits(i - 1) & digits(i + 1) & ~F.coalesce(F.get(words, i - 2) == "-", F.lit(False))
    places = F.sequence(F.lit(0), F.size(words) - 1)
    # a recital has four numbers or ranges at most, of six digits each
    held = F.aggregate(F.filter(places, lambda i: digits(i) & ~F.coalesce(F.get(words, i - 1) == "-", F.lit(False))), F.lit(0), lambda n, i: n + F.ceil(F.length(F.get(words, i)) / 6).cast("int"))
    is_list = head.isin("N", "P") & marks | (head == "C") & F.forall(places, lambda i: digits(i) | between(i)) & (held <= 4)

    pairs = F.regexp_extract_all(t, F.lit(r"\G(?:(?:TIT|PT|[ANPLC.])[0-9]*(?:(?<=^A[0-9]{1,9})BIS)?(?:(?<=L)[A-Z])?)"), F.lit(0))
    code = lambda p: F.regexp_extract(p, r"^(?:TIT|PT|.)", 0)
    value = lambda p: F.regexp_replace(p, r"^(?:TIT|PT|.)", "")
    codes = lambda ps: F.array_join(F.transform(ps, code), " ")
    numbered = lambda p: value(p).rlike("^[0-9]+(BIS)?\\z")
    letter = lambda p: value(p).rlike("^[A-Z]\\z")

    def first_pair(p: Column) -> Column:
        n = F.when(head == "A", short(value(p))).when((head == "N") & (value(p) == ""), "1").otherwise(value(p))
        return F.concat(label(code(p)), F.lit(" "), n)

    def lower_pair(p: Column) -> Column:
        plain = F.concat(F.element_at(labels, code(p)), F.lit(" "), F.when((head == "A") & (code(p) == "L"), value(p)).otherwise(value(p).try_cast("int").cast("string")))
        return F.when(letter(p), F.concat(F.lit("pnt. "), F.lower(value(p)))).otherwise(plain)

    def shown(ps: Column) -> Column:
        return F.array_join(F.transform(ps, lambda p, i: F.when(i == 0, first_pair(p)).otherwise(lower_pair(p))), " ")

    def sound(ps: Column) -> Column:
        fits = F.forall(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), lambda p: numbered(p) | letter(p) & (head == "A"))
        return codes(ps).rlike(FRAGMENT_PATHS) & fits & (numbered(F.get(ps, F.lit(0))) | (head == "N"))

    longest = F.filter(F.array(*[F.slice(pairs, 1, n) for n in (3, 2, 1)]), sound)
    article = F.when(F.size(longest) > 0, shown(F.get(longest, F.lit(0)))).otherwise(t)
    path = F.when((F.array_join(pairs, "") == t) & sound(pairs), shown(pairs)).otherwise(t)
    return F.when(is_list, listed).when(F.size(pairs) == 0, t).when(head == "A", article).otherwise(path)
