"""Titles of judgments without the court that gave them.

A title is cut into words. The date is found by the kinds of its words; what stands between the word for the judgment and the date
(or before both, or after) names the court and goes. A language is described by plain words: how a title begins, which words lead
to the date, and the order of the date's parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import converters as C
from .bind import let

#: Kinds of words in a date, as patterns of a whole word in lower case.
KINDS = {
    "day": "[0-9]{1,2}", "day.": r"[0-9]{1,2}\.?", "dayth": r"[0-9]{1,2}\p{L}{0,7}", "day-i": "[0-9]{1,2}-i", "month": r"\p{L}+", "month.": r"\p{L}+\.?",
    "year": "[0-9]{4}.*", "year.": r"[0-9]{4}\.", "day.month.year": r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}.*", "dell'day": "dell’[0-9]{1,2}", "tad-day": "ta[dlst]-[0-9]{1,2}", "ta'": "ta[’']",
    "ítélet(e)": "ítélete?.*",
}


@dataclass(frozen=True)
class Form:
    """lead: the word for the judgment (words, where it begins the title). dates: the words of the date and those that lead to it.
    order: lead court date; court lead court date; court date; date court lead."""

    lead: str
    dates: tuple[str, ...]
    order: str = "lead court date"


# The words of official titles.
FORMS = {
    "EN": Form("judgment of", ("day month year",)),
    "FR": Form("arrêt", ("du day month year",)),
    "DE": Form("urteil", ("vom day. month year",)),
    "ES": Form("sentencia", ("de day de month de year",)),
    "PT": Form("acórdão", ("de day de month de year",)),
    "NL": Form("arrest", ("van day month year",)),
    "IT": Form("sentenza", ("del day month year", "dell'day month year")),
    "CS": Form("rozsudek", ("ze dne day. month year",)),
    "HR": Form("presuda", ("od day. month year",)),
    "SL": Form("sodba", ("z dne day. month year",)),
    "SK": Form("rozsudok", ("z day. month year", "zo day. month year")),
    "MT": Form("sentenza", ("tad-day ta' month year",)),
    "PL": Form("wyrok", ("z dnia day. month year",)),
    "RO": Form("hotărârea", ("din day month year", "din data de day month year")),
    "BG": Form("решение", ("от day month year",)),
    "EL": Form("απόφαση", ("της dayth month year",)),
    "DA": Form("dom", ("af day. month year",), "court lead court date"),
    "SV": Form("dom", ("av den day. month year", "den day. month year"), "court lead court date"),
    "FI": Form("tuomio", ("day.month.year", "day päivänä month year"), "court lead court date"),
    "ET": Form("otsus kohtuotsus", (", day.month.year", ", day. month year"), "court lead court date"),
    "LV": Form("spriedums", ("year. gada day. month.",), "court lead court date"),
    "LT": Form("sprendimas", ("year m. month day d.",), "date court lead"),
    "HU": Form("", ("year. month day-i ítélet(e)",), "court date"),
}
#: Latvian titles may also put the date first, with the word for the judgment at once behind it.
DATE_FIRST = {"LV": ("year. gada day. month. spriedums",)}
HUNGARIAN_COURTS = ("bíróság", "törvényszék")


class Words:
    """The words of a text, each with the white space before it; commas are words."""

    def __init__(self, tokens: Column, words: Column) -> None:
        self.tokens, self.words, self.size = tokens, words, F.size(tokens)

    @staticmethod
    def of(text: Column, use: Callable[[Words], Column]) -> Column:
        lower = lambda tokens: F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, r"\A\s+", "")))
        return let(F.regexp_extract_all(text, F.lit(r"\s*(?:[^\s,]+|,)"), F.lit(0)), lambda tokens: let(lower(tokens), lambda words: use(Words(tokens, words))))

    def is_(self, i: Column, kind: str) -> Column:
        return F.coalesce(F.get(self.words, i).rlike(rf"\A(?:{kind})\z"), F.lit(False))

    def follow(self, i: Column, phrase: str) -> Column:
        """Whether the words from i on are of the kinds that the phrase lists."""
        return reduce(and_, [self.is_(i + j, KINDS.get(w, w)) for j, w in enumerate(phrase.split())])

    def first(self, test: Callable[[Column], Column], start: Column | None = None) -> Column:
        """The first place (from start on) that passes; null where none does."""
        places = F.filter(F.sequence(F.lit(0), F.greatest(self.size - 1, F.lit(0))), lambda i: test(i) if start is None else (i >= start) & test(i))
        return F.array_min(places)

    def phrase(self, phrases: tuple[str, ...], start: Column | None = None) -> Column:
        return self.first(lambda i: reduce(or_, [self.follow(i, p) for p in phrases]), start)

    def text(self, start: Column, end: Column | None = None) -> Column:
        """The words from start to before end, as they stand."""
        length = (self.size if end is None else end) - start
        return F.array_join(F.slice(self.tokens, start + 1, F.greatest(length, F.lit(0))), "")

    def rest(self, i: Column, pattern: str) -> Column:
        """A word without what matches the pattern."""
        return F.regexp_replace(F.get(self.tokens, i), pattern, "")


def _shortened(w: Words, code: str) -> Column:
    """The title without the court; null where its form is another."""
    form = FORMS[code]
    leads = form.lead.split()
    if form.order == "lead court date":
        kept = lambda date: F.when(date.isNotNull(), F.concat(w.text(F.lit(0), F.lit(len(leads))), w.text(date)))
        return F.when(w.follow(F.lit(0), form.lead), let(w.phrase(form.dates, F.lit(len(leads))), kept))
    if form.order == "court date":
        return let(w.phrase(form.dates), lambda date: F.when(date.isNotNull(), w.text(date)))
    lead = lambda i: w.is_(i, rf"(?:{'|'.join(leads)})[^\p{{L}}]*")
    if form.order == "date court lead":
        n = len(form.dates[0].split())
        behind = lambda at: F.when(at.isNotNull(), F.concat(w.text(F.lit(0), F.lit(n)), w.text(at)))
        return F.when(w.follow(F.lit(0), form.dates[0]), let(w.first(lead, F.lit(n)), behind))
    least = 1 if code in ("DA", "SV") else 0  # where the word for a judgment is also a noun of its own, a court stands before it
    between = lambda at: let(w.phrase(form.dates, at), lambda date: F.when(date.isNotNull(), F.concat(w.text(at, at + 1), w.text(date))))
    return let(w.first(lead, F.lit(least)), lambda at: F.when(at.isNotNull(), between(at)))


def _without_court(t: Column, code: str) -> Column:
    def shown(w: Words) -> Column:
        done = _shortened(w, code)
        if code in DATE_FIRST:
            done = F.coalesce(done, let(w.phrase(DATE_FIRST[code]), lambda date: F.when(date.isNotNull(), w.text(date))))
        return done

    return let(t, lambda x: F.coalesce(Words.of(x, shown), x))


def _court(w: Words) -> Column:
    return w.first(lambda i: w.is_(i, "a") & w.is_(i + 1, "|".join(HUNGARIAN_COURTS)))


def _day_then_year(w: Words) -> Column:
    """A Bíróság (month) 15.-i ítélete: 2013. with the year in front; null for other forms."""

    def moved(at: Column, day: Column) -> Column:
        year = F.regexp_extract(F.get(w.words, day + 2), "^[0-9]{4}", 0)
        lead = F.concat(w.text(F.lit(0), at), F.when(at > 0, " ").otherwise(""), year, F.lit("."))
        return F.concat(lead, w.text(at + 2, day), w.rest(day, r"\.-i\z"), F.lit("-i ítélet"), w.rest(day + 2, r"\A\s*[0-9]{4}\.?"), w.text(day + 3))

    day = lambda at: w.first(lambda i: w.is_(i, r"[0-9]+\.-i") & w.is_(i + 1, "ítélete?:") & w.is_(i + 2, "[0-9]{4}.*"), at + 3)
    return let(_court(w), lambda at: let(day(at), lambda d: F.when(at.isNotNull() & d.isNotNull(), moved(at, d))))


def _judgment_then_date(w: Words) -> Column:
    """A Bíróság ítélete (chamber), 2013. január 15. as the date and then the judgment; null for other forms."""

    def start(at: Column) -> Column:
        behind = at + 3 + F.when(w.is_(at + 3, ","), 1).otherwise(0)
        closed = lambda s: w.first(lambda i: w.is_(i, r".*\)") & w.is_(i + 1, ","), s)
        return let(behind, lambda s: F.when(w.is_(s, r"\(.*"), F.coalesce(closed(s) + 2, s)).otherwise(s))

    def moved(at: Column, s: Column, day: Column) -> Column:
        number = F.regexp_replace(F.get(w.tokens, day), r"\A(\s*[0-9]+\.?)(?s:.*)", "$1")
        lead = F.concat(w.text(F.lit(0), at), F.when(at > 0, " ").otherwise(""), F.ltrim(w.text(s, day)))
        return F.concat(lead, number, F.lit("-i ítélet"), w.rest(day, r"\A\s*[0-9]+\.?"), w.text(day + 1))

    fits = lambda at, s, day: w.is_(at + 2, "ítélete?") & w.is_(s, r"[0-9]{4}\.?") & day.isNotNull()
    dated = lambda at, s: let(w.first(lambda i: w.is_(i, "[0-9]+.*"), s + 2), lambda day: F.when(fits(at, s, day), moved(at, s, day)))
    return let(_court(w), lambda at: F.when(at.isNotNull(), let(start(at), lambda s: dated(at, s))))


def _hungarian(t: Column) -> Column:
    """Titles that begin with the court and end with the date: the date goes before the word for the judgment."""
    for form in (_day_then_year, _judgment_then_date):
        t = let(t, lambda x, form=form: F.coalesce(Words.of(x, form), x))
    return F.regexp_replace(t, r"(?iu)\sítélete,", " ítélet,")


def case_title(title, code: str = "EN") -> Column:
    """A judgment's title without the court, its first letter in upper case; titles in other languages stay."""
    t = C.text(title)
    if code not in FORMS:
        return t
    t = F.regexp_replace(t, r"\A\s+|\s+\z", "")
    return let(F.regexp_replace(_without_court(_hungarian(t) if code == "HU" else t, code), r"\A\s+|\s+\z", ""), C.ucfirst)
