"""PR7, PR8: sentences of a text, as one SQL expression and as a plain function that says the same.

A line break ends a sentence, and so does a mark (with closing quotes and brackets behind it) before white space.
No mark before a small letter ends one; nor does a full stop after an abbreviation of the language, after an initial, or
after a number before another number, nor after a number of one or two digits where ordinals are written so.

Spark segments with the plain function, which is faster; DuckDB, which holds the results against it, in SQL.
There full stops that end nothing get a sign behind them, the other marks' white space becomes a line break, and the text
is split at these: regular expressions without lookaround.
"""

from __future__ import annotations

import re
import unicodedata

from segmenta.plans.dialect import Spark

# Words that end in a full stop without ending a sentence, by language; other languages take the English ones.
ABBREVIATIONS = {
    "en": "mr mrs ms dr prof sr jr st vs etc e.g i.e cf no vol fig inc ltd co dept jan feb mar apr jun jul aug sep sept oct nov dec gen col capt lt sgt rev hon".split(),
    "de": "z.b d.h u.a bzw usw dr prof hr fr nr bd vgl ca evtl ggf abb str st jan feb apr aug sept okt nov dez".split(),
    "fr": "m mm mme mlle dr prof p.ex c.-à-d cf etc av apr vol fig st ste janv févr avr juil sept oct nov déc".split(),
    "es": "sr sra srta dr dra d da prof etc p.ej ud uds av núm vol fig ene feb abr ago sept oct nov dic".split(),
}
# Languages that write ordinals as a number and a full stop.
ORDINALS = ("de", "da", "nb", "fi", "hr", "sl", "pl", "cs")
MARKS, CLOSING, OPENING, SPACE = r".!?…", r"\"\x27”’»)\]", r"(\[\"\x27“„«", r"\x20\x09-\x0D"
#: Stands behind a mark that ends nothing; of the private use area.
SIGN = ""


def language_of(tag: str | None) -> str:
    return (tag or "en").split("-")[0].lower()


def sentences(text: str, language: str | None = "en") -> list[str]:
    """The sentences of a text, trimmed, without empty ones."""
    code = language_of(language)
    short, ordinal = set(ABBREVIATIONS.get(code, ABBREVIATIONS["en"])), code in ORDINALS
    white = " \t\n\v\f\r"
    out = []
    for line in re.split(r"[\r\n]+", text.replace(SIGN, "")):
        at = 0
        for m in re.finditer(rf"[{MARKS}]+[{CLOSING}]*(?=[{SPACE}])", line):
            after = line[m.end() :].lstrip(white)[:1]
            if after and unicodedata.category(after) == "Ll":
                continue
            if m[0][0] == "." and not set("!?") & set(m[0]):
                word = re.search(rf"[^{SPACE}{OPENING}]*\Z", line[at : m.start()])[0]
                single = len(word) == 1 and unicodedata.category(word) == "Lu"
                number = word.isdecimal() and (after.isdecimal() or ordinal and len(word) <= 2)
                if word.lower() in short or single or number:
                    continue
            out.append(line[at : m.end()].strip(white))
            at = m.end()
        out.append(line[at:].strip(white))
    return [s for s in out if s]


def _any_case(word: str) -> str:
    """The word in capitals or not; letters beyond ASCII by pairs, for engines that fold those differently."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)


def split(d: Spark, text: str, language: str) -> str:
    """An array of the pieces of a text, untrimmed, some empty."""
    stop, edge = rf"\.[.…]*[{CLOSING}]*", rf"(?:^|[{SPACE}{OPENING}])"
    one, two, three = d.group(1), d.group(2), d.group(3)
    marked = d.replace_all(f"replace({text}, '{SIGN}', '')", rf"([{MARKS}]+[{CLOSING}]*)([{SPACE}]+)(\p{{Ll}})", one + SIGN + two + three)
    marked = d.replace_all(marked, rf"({edge}\p{{Lu}}{stop})", one + SIGN)
    for _ in range(2):  # neighbours share a number
        marked = d.replace_all(marked, rf"({edge}\p{{Nd}}+{stop})([{SPACE}]+\p{{Nd}})", one + SIGN + two)

    def of_language(code: str, ordinal: bool) -> str:
        short = "|".join(map(_any_case, sorted(ABBREVIATIONS.get(code, ABBREVIATIONS["en"]), key=len, reverse=True)))
        return d.replace_all(marked, rf"({edge}(?:{short}{r'|\p{Nd}{1,2}' if ordinal else ''}){stop})", one + SIGN)

    code = f"lower({d.before(language, '-')})"
    cases = [f"WHEN {code} = '{c}' THEN {of_language(c, c in ORDINALS)}" for c in ABBREVIATIONS if c != "en"]
    others = ", ".join(f"'{c}'" for c in ORDINALS if c not in ABBREVIATIONS)
    by_language = f"CASE {' '.join(cases)} WHEN {code} IN ({others}) THEN {of_language('en', True)} ELSE {of_language('en', False)} END"
    broken = d.replace_all(by_language, rf"([{MARKS}]+[{CLOSING}]*)[{SPACE}]+", one + "\n")
    return d.split(f"replace({broken}, '{SIGN}', '')", r"[\r\n]+")
