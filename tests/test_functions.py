"""Converters and helpers against stated values."""

import datetime

import pytest
from pyspark.sql import functions as F

from citemill.functions import converters as C
from citemill.functions import helpers as H
from citemill.functions import ids, titles
from citemill.functions.regex import delimited, group_count, non_capturing, to_java
from citemill.operators import alias

L = F.lit
DAY = datetime.date(2024, 5, 1)
CASES = [
    (lambda: C.test_replace(L("er123"), r"/r\d+/", "444"), "444"),
    (lambda: C.test_replace(L("er123"), r"/x\d+/", "444"), "er123"),
    (lambda: C.test_not_replace(L("er123"), r"/r\d+/", "444"), "er123"),
    (lambda: C.test_not_replace(L("er123"), r"/x\d+/", "444"), "444"),
    (lambda: C.slice_(L("mike"), 1, 3), "ik"),
    (lambda: C.slice_(L("mike"), -2), "ke"),
    (lambda: C.number(L("IV")), "4"),
    (lambda: C.number(L("MCMXCIX")), "1999"),
    (lambda: C.number(L("12")), "12"),
    (lambda: C.number(L("q")), ""),
    (lambda: C.number(L(None)), ""),
    (lambda: C.roman(L("i")), ""),
    (lambda: C.roman(L("ix")), "9"),
    (lambda: C.to_roman(L("1994")), "MCMXCIV"),
    (lambda: C.to_roman(L("x")), "x"),
    (lambda: C.ascii_roman(L("χι")), "XI"),
    (lambda: C.letter_to_latin(L("в")), "c"),
    (lambda: C.letter_to_latin(L("β")), "b"),
    (lambda: C.letter_to_latin(L("Q")), "q"),
    (lambda: C.number_ext(L("12.o-F")), "12f"),
    (lambda: C.number_ext(L("12.o")), "12"),
    (lambda: C.number_ext(L("12.t")), "12t"),
    (lambda: C.number_ext(L("12nd")), "12"),
    (lambda: C.number_ext(L("12α")), "12a"),
    (lambda: C.number_ext(L("12 bis")), "12a"),
    (lambda: C.number_ext(L("12A")), "12A"),
    (lambda: C.number_ext(L("12А")), "12a"),  # Cyrillic
    (lambda: C.number_ext(L("12.o-AB")), "12ab"),
    (lambda: C.number_ext(L("12.o"), "ENG"), "12o"),
    (lambda: C.number_ext(L("12-F"), "ENG"), "12a"),
    (lambda: C.number_ext(L("007")), "7"),
    (lambda: C.number_ext(L("second")), "2"),
    (lambda: C.number_ext(L("what")), "1"),
    (lambda: C.pad(L("12345"), "0", 3), "12345"),
    (lambda: C.pad(L("7"), "0", 3), "007"),
    (lambda: C.pad(L("7"), "x", 3, "right"), "7xx"),
    (lambda: C.pad(L(""), "0", 3, "left", True), ""),
    (lambda: C.year(L("57")), "2057"),
    (lambda: C.year(L("58")), "1958"),
    (lambda: C.year(L(""), DAY), "2024"),
    (lambda: C.year(L("123")), None),
    (lambda: C.short_year(L("2004")), "4"),
    (lambda: C.trim(L("  a&nbsp;b &amp; ")), "a b &"),
    (lambda: C.trim(L("--a-"), "-"), "a"),
    (lambda: C.replace(L("aXbx"), "x", "_"), "a_b_"),
    (lambda: C.replace(L("aXbx"), "/x/", "_"), "aXb_"),
    (lambda: C.replace(L("a1b2"), r"/(\d)/", "<$1>"), "a<1>b2"),
    (lambda: C.replace(L("aXbx"), "/X/i", "_"), "a_bx"),
    (lambda: C.any_(L(""), L(None), 0, "x"), "0"),
    (lambda: C.empty_if(L("a"), L(""), L(None)), "a"),
    (lambda: C.empty_if(L("a"), L(""), "b"), ""),
    (lambda: C.remap(L("MX"), ["/M/", "/X/"], ["m", "x"]), "m"),
    (lambda: C.urlencode(L("a b/ü(1)!")), "a%20b%2F%C3%BC(1)!"),
    (lambda: C.ucfirst(L("éa b")), "Éa b"),
    (lambda: C.base64(L("é")), "w6k="),
    (lambda: C.sum_(L("1"), L("x")), "0"),
    (lambda: C.dec(L("x")), None),
    (lambda: C.month(L("November")), "11"),
    (lambda: C.wrap(L(None), "<", ">"), ""),
    (lambda: C.multi_lang_iso2(None, "ENG-FRA-XXX"), "EN-FR"),
    (lambda: C.lang_iso2(None, None, "deu"), "DE"),
    (lambda: C.lang_iso3(None, None, "xxx"), "ENG"),
    (lambda: C.eli_point_in_time(None, None, "2020-01-02"), "/2020-01-02"),
    (lambda: C.eli_point_in_time(None, "x", "soon"), "/x"),
    (lambda: C.parliament_term(None, "1999", "7", "20"), 5),
    (lambda: C.parliament_term(None, "2004", "6", "1"), 5),
    (lambda: C.parliament_term(None, "2024", "7", "16"), 10),
    (lambda: C.is_year(L("23"), DAY), True),
    (lambda: C.is_year(L("30"), DAY), False),
    (lambda: C.is_(L("b"), "a,b"), True),
    (lambda: C.is_numeric(L("1e3")), True),
    (lambda: C.is_numeric(L("")), False),
    (lambda: H.fragment(L("A02P1")), "art. 2 par. 1"),
    (lambda: H.fragment(L("N 32")), "par. 32"),
    (lambda: H.fragment(L("N 02 05 07")), "par. 2, 5, 7"),
    (lambda: H.fragment(L("N 02"), L("32016R0679")), "anx. 2"),
    (lambda: H.fragment(L("N6A9P1L2PT3")), "par. 6 art. 9 par. 1 al. 2 pnt. 3"),
    (lambda: H.oj_translated(L("OJ L 119, 4.5.2016, p. 1-88"), "FR"), "JO L 119 du 4.5.2016, p. 1"),
    (lambda: H.oj_translated(L("OJ L 119, 4.5.2016, p. 1–88"), "EN"), "OJ L 119, 4.5.2016"),
    (lambda: H.oj_translated(L("OJ C 2023/1, 4.5.2023"), "EN"), "OJ C, C/2023/1, 4.5.2023"),
    (lambda: H.oj_translated(L("OJ L 119, 4.5.2016, p. 1-88"), "LT"), "OL L 119, 2016 5 4, p. 1"),
    (lambda: H.pretty_date(L("2020-05-21")), "21/05/2020"),
    (lambda: H.treaty_title(L("12016M050")), "Article 50 TEU"),
    (lambda: H.treaty_title(L("12016E/TXT"), "FRA"), "Traité sur le fonctionnement de l'UE"),
    (lambda: H.treaty_title(L("32016R0679")), None),
    (lambda: H.force_status(L(""), None, None, L("0"), L("2020-01-01"), DAY), "nolongerinforce"),
    (lambda: H.force_status(L("0"), L("2025-01-01"), None, None, None, DAY), "pendinginforce"),
    (lambda: H.filled(L("a {{ X|d }} {{ X }}"), "X", L("")), "a d d"),
    (lambda: H.filled(L("a {{ X|d }}"), "X", L("v")), "a v"),
    (lambda: H.joined_cases(F.array(L("a"), L("b"), L("c"))), "a, b and c"),
    (lambda: H.joined_cases(F.array(L("a"))), "a"),
    (lambda: H.has_tags(L("a < b")), False),
    (lambda: H.xml_escape(L("<a&'\">")), "&lt;a&amp;&apos;&quot;&gt;"),
    (lambda: H.iso3(L("fr")), "FRA"),
    (lambda: ids.titled(L("to X"), L("G")), "to G X"),
    (lambda: alias.difference(L("Directive 2004/109/EC"), L("that Directive"))["replacement"], "that Directive"),
]


def test_values(spark):
    columns = [f().cast("string").alias(f"c{i}") for i, (f, _) in enumerate(CASES)]
    row = spark.range(1).select(*columns).first()
    wrong = {i: (row[i], want) for i, (_, want) in enumerate(CASES) if row[i] != (None if want is None else str(want).lower() if isinstance(want, bool) else str(want))}
    assert not wrong


def test_registry_is_complete():
    assert len(C.REGISTRY) == 50


def test_remap_needs_pairs():
    with pytest.raises(ValueError):
        C.remap(L("a"), ["/a/"], [])


def test_patterns(spark):
    assert non_capturing(r"(a)(?:b)\(([(]x)(?=c)(?<n>d)") == r"(?:a)(?:b)\((?:[(]x)(?=c)(?<n>d)"
    assert group_count(r"(a)(?:b)(?<n>c)\((?<!d)") == 2
    assert to_java("a$") == r"a\z"
    assert delimited("a.b") == (r"(?iu)a\.b", True)
    row = spark.range(1).select(F.lit("a b").rlike(to_java(r"a\sb")), F.lit("Р").rlike("(?iu)р")).first()
    assert tuple(row) == (True, True)


def test_attributes(spark):
    html = '<a data-ref-celex-0="1" data-ref-celex-1="2" data-ref-celex-0="3" data-x="" data-y="null" data-title="t" href="u">'
    attrs = ids.normalised(ids.attributes(F.lit(html)))
    row = spark.range(1).select(attrs, ids.celex_ids(attrs), ids.urls(F.lit(html)), ids.unsuffixed(attrs)).first()
    assert row[0] == {"celex-1": "2", "celex-0": "3"} and row[1] == ["3", "2"] and row[2] == ["u"] and list(row[3]) == ["celex"]


@pytest.mark.parametrize(
    ("code", "title", "want"),
    [
        ("EN", "Judgment of the Court (Fifth Chamber) of 14 December 2000. # Italian Republic v Commission", "Judgment of 14 December 2000. # Italian Republic v Commission"),
        ("FR", "Arrêt du Tribunal (quatrième chambre) du 11 décembre 2013", "Arrêt du 11 décembre 2013"),
        ("DE", "Urteil des Gerichts (Vierte Kammer) vom 11. Dezember 2013", "Urteil vom 11. Dezember 2013"),
        ("ES", "Sentencia del Tribunal General (Sala Cuarta) de 11 de diciembre de 2013", "Sentencia de 11 de diciembre de 2013"),
        ("PT", "Acórdão do Tribunal de Justiça (Primeira Secção) de 29 de outubro de 2015", "Acórdão de 29 de outubro de 2015"),
        ("NL", "Arrest van het Gerecht (Vierde kamer) van 11 december 2013", "Arrest van 11 december 2013"),
        ("IT", "Sentenza del Tribunale (Quarta Sezione) dell’11 dicembre 2013", "Sentenza dell’11 dicembre 2013"),
        ("DA", "Domstolens dom (Første Afdeling) af 29. oktober 2015", "Dom af 29. oktober 2015"),
        ("CS", "Rozsudek Soudního dvora (prvního senátu) ze dne 29. října 2015", "Rozsudek ze dne 29. října 2015"),
        ("HR", "Presuda Suda (prvo vijeće) od 29. listopada 2015", "Presuda od 29. listopada 2015"),
        ("SL", "Sodba Sodišča (prvi senat) z dne 29. oktobra 2015", "Sodba z dne 29. oktobra 2015"),
        ("SK", "Rozsudok Súdneho dvora (prvá komora) z 29. októbra 2015", "Rozsudok z 29. októbra 2015"),
        ("ET", "Euroopa Kohtu otsus (esimene koda), 29.10.2015", "Otsus, 29.10.2015"),
        ("ET", "Kohtuotsus, Euroopa Kohus, 12. juuli 2005", "Kohtuotsus, 12. juuli 2005"),
        ("FI", "Unionin tuomioistuimen tuomio (ensimmäinen jaosto) 29.10.2015", "Tuomio 29.10.2015"),
        ("SV", "Personaldomstolens dom av den 30 januari 2013, Wahlström/Frontex", "Dom av den 30 januari 2013, Wahlström/Frontex"),
        ("LV", "Tiesas spriedums (pirmā palāta) 2015. gada 29. oktobrī.", "Spriedums 2015. gada 29. oktobrī."),
        ("LV", "Vispārējās tiesas 2013. gada 15. janvāra spriedums Spānija/Komisija", "2013. gada 15. janvāra spriedums Spānija/Komisija"),
        ("LT", "2015 m. spalio 29 d. Teisingumo Teismo (pirmoji kolegija) sprendimas.", "2015 m. spalio 29 d. sprendimas."),
        ("MT", "Sentenza tal-Qorti tal-Ġustizzja (L-Ewwel Awla) tad-29 ta’ Ottubru 2015.", "Sentenza tad-29 ta’ Ottubru 2015."),
        ("PL", "Wyrok Trybunału (pierwsza izba) z dnia 29 października 2015", "Wyrok z dnia 29 października 2015"),
        ("RO", "Hotărârea Tribunalului (Camera a patra) din 11 decembrie 2013", "Hotărârea din 11 decembrie 2013"),
        ("BG", "Решение на Съда (първи състав) от 29 октомври 2015 г", "Решение от 29 октомври 2015 г"),
        ("EL", "Απόφαση του Δικαστηρίου (τμήμα μείζονος συνθέσεως) της 19ης Ιανουαρίου 2010.", "Απόφαση της 19ης Ιανουαρίου 2010."),
        ("HU", "A Törvényszék 2013. január 15-i ítélete, Spanyolország kontra Bizottság", "2013. január 15-i ítélet, Spanyolország kontra Bizottság"),
        ("HU", "A Bíróság január 15.-i ítélete: 2013.", "2013. január 15-i ítélet"),
        ("XX", "stays (as it is) of 1 May 2000", "stays (as it is) of 1 May 2000"),
    ],
)
def test_case_titles(spark, code, title, want):
    assert spark.range(1).select(titles.case_title(F.lit(title), code)).first()[0] == want


def test_footnotes(spark):
    done = lambda s, **k: spark.range(1).select(H.footnote_text(F.lit(s), **k)).first()[0]
    for code, eea in H.EEA_TEXTS.items():
        assert done(f"Act ({H.RECAST[code]})({eea}).") == "Act."
    assert done("a . ) b ( c ) . ( d , , e  f") == "a) b (c ) ( d, e f"  # only the first of each
    assert done("Act (recast) .", tidy_only=True) == "Act (recast)."
