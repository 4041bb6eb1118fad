"""Index terms of a language: words without stop words, stemmed by rules.

A language has stop words and steps.  Each step takes the longest of its endings
off a word, if enough of the word is left, and puts its replacement there; then
marked letters become plain.  Everything is a Column expression over the words
of a text, so terms are made inside the scan, alike for documents and queries.

``None`` as language keeps every word as it stands.  A null text has null terms;
an empty one none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T


@dataclass(frozen=True)
class Step:
    """The longest of ``endings`` gives way to ``replacement`` where ``least`` letters stay, the last of them one of ``behind`` if given."""

    endings: str
    least: int
    replacement: str = ""
    behind: str = ""

    @property
    def pattern(self) -> str:
        """A pattern that Java's and RE2's engines read alike; its group is what stays."""
        ways = "|".join(sorted(self.endings.split(), key=lambda e: (-len(e), e)))
        return rf"^(.{{{self.least - bool(self.behind)},}}?{self.behind})(?:{ways})$"


@dataclass(frozen=True)
class Language:
    stops: frozenset[str]
    steps: tuple[Step, ...]
    #: Doubled last letters that become one after so many steps.
    doubled: str = ""
    undouble_after: int = 0
    marked: str = ""
    plain: str = ""


def _language(stops: str, *steps: Step, **more) -> Language:
    return Language(frozenset(stops.split()), steps, **more)


#: Stop words, endings and letters of each language.
LANGUAGES = {
    "english": _language(
        "a an and are as at be been but by can could did do does for from had has have he her him his how i if in into is it its me my no not of on or our out "
        "she should so some such than that the their them then there these they this those to too up us very was we were what when where which who why will with would you your",
        Step("ies", 2, "y"),
        Step("es", 3, behind="[sxz]"),
        Step("s", 3, behind="[^su]"),
        Step("ingly edly ing ed ly", 3),
        Step("ations ation ements ement ments ment ness ful less able ible ity ive ion al er est", 4),
        Step("e", 4),
        doubled="bb dd gg ll mm nn pp rr tt",
        undouble_after=4,
    ),
    "german": _language(
        "aber als also am an auch auf aus bei bin bis da das dass dem den der des die dies diese dieser doch du durch ein eine einem einen einer eines er es "
        "für hat ich ihr im in ist ja kein keine man mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wie wir wird zu zum zur",
        Step("ern em er en es e s", 3),
        Step("heit keit lich isch ung ig", 3),
        marked="äöü",
        plain="aou",
    ),
    "french": _language(
        "a à au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou où "
        "par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous c d j l m n s t y été",
        Step("issements issement atrices atrice ations ation ements ement ités ité euses euse eux ives ive ifs if ables able istes iste", 3),
        Step("aient erons eront erait eras erai èrent ées ée és é er ez ent ons es e s", 3),
        marked="àâçèéêëîïôùûü",
        plain="aaceeeeiiouuu",
    ),
    "spanish": _language(
        "a al algo ante como con cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa ese eso esta este esto fue ha hasta la las le les lo los "
        "más me mi muy nada ni no nos o os otra otro para pero por porque que quien se ser si sin sobre son su sus también te todo tu un una uno y ya yo",
        Step("amientos amiento imientos imiento aciones ación idades idad adores adora ador mente ables able istas ista osos osas oso osa ivos ivas ivo iva", 3),
        Step("ieron iendo aban ando aron ados adas idos idas ado ada ido ida ar er ir os as es o a e s", 3),
        marked="áéíóúü",
        plain="aeiouu",
    ),
}


def language(name: str | None) -> Language | None:
    if name is not None and name not in LANGUAGES:
        raise ValueError(f"unknown language {name!r}; one of {', '.join(LANGUAGES)}")
    return None if name is None else LANGUAGES[name]


def terms(text: Column, name: str | None = None) -> Column:
    """The terms of a text in order, repeats included."""
    return stems(words(text, name), name)


def words(text: Column, name: str | None = None) -> Column:
    """The words of a text in order, without the language's stop words; each becomes one term."""
    found = F.regexp_extract_all(T.casefold(text), F.lit(rf"({T.WORD}+)"), F.lit(1))
    own = language(name)
    return found if own is None else F.filter(found, lambda w: ~w.isin(*sorted(own.stops)))


def stems(kept: Column, name: str | None = None) -> Column:
    """The terms that words become."""
    own = language(name)
    if own is None:
        return kept
    for k, step in enumerate(own.steps, 1):
        kept = F.transform(kept, _cut(step))
        if k == own.undouble_after:
            kept = F.transform(kept, lambda w: F.when(F.right(w, F.lit(2)).isin(*own.doubled.split()), F.left(w, F.length(w) - 1)).otherwise(w))
    return F.transform(kept, lambda w: F.translate(w, own.marked, own.plain)) if own.marked else kept


def stemmer(name: str | None) -> Callable[[str], str] | None:
    """``stems`` of one word as a plain function, for tasks that see each distinct word once; None where words stay as they are."""
    own = language(name)
    if own is None:
        return None
    cuts = [(re.compile(step.pattern), r"\1" + step.replacement) for step in own.steps]
    doubled, plain = tuple(own.doubled.split()), str.maketrans(own.marked, own.plain)

    def stem(word: str) -> str:
        for k, (pattern, left) in enumerate(cuts, 1):
            word = pattern.sub(left, word)
            if k == own.undouble_after and word.endswith(doubled):
                word = word[:-1]
        return word.translate(plain) if plain else word

    return stem


def _cut(step: Step):
    return lambda w: F.regexp_replace(w, step.pattern, "$1" + step.replacement)
