"""Personal information inside free text: found, typed, and replaced by placeholders.

Method: a semi-Markov conditional random field over the lines of a text. Its segments are entities and stretches without one; every span that can be of a
type at all (``spans``) competes with every other, of whatever type and length, and is scored as a whole: its form, what the name list
says about its words, what stands at and beyond both of its ends. Neighbouring entities are also scored by their types and what separates them. A dynamic
programme over ends of segments sums over all segmentations for fitting (forward-backward, penalised likelihood) and finds the best one for
use, so that boundaries and types are chosen jointly: in ``cc Given Family, Family, Given`` two persons come out.
The weights are fitted on the bounded sample of ``pii_labelled``; how names are built (which beginnings go with which endings) on the name list.

Which spans can be of a type: an email has an at-sign or a way of writing one; a phone number has 7 to 15 digits and nothing but separators; an id number
stands behind a word for such a number in its line and has 5 to ID_DIGITS digits; an address has a house number at one end, a word for a street and at most
ADDRESS_WORDS words; a person has two to PERSON_PARTS parts, words with a capital, initials or particles. No span is limited in characters.

Defined results: null, empty and blank texts hold nothing and stay as they are. Positions count Unicode characters from 0 in the text as given.
Texts are searched whole; repeated rows are searched each. An entity never crosses a line end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pii_labelled import TRAIN_NAMES, training

KINDS = ("email", "phone", "id_number", "address", "person")
#: Farthest neighbour, in characters, whose type matters.
GAP = 5
#: Most parts of a person's name (given names, initials, particles, family names).
PERSON_PARTS = 7
#: Most digits of an id number, and most words of an address besides its house number.
ID_DIGITS, ADDRESS_WORDS = 24, 9
#: Names of the list that are used, at most: a list longer than this is refused rather than cut.
MAX_NAMES = 2_000_000
#: Strength of the penalty on weights, steps and step size of the fit.
PENALTY, STEPS, RATE = 0.02, 120, 0.15

_UP = r"A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_LETTER = r"[^\W\d_]"
# How people write an at-sign and a dot.
_AT = r"(?:\s?[\[({<]\s?(?:at|ät|arroba|arobase|@)\s?[\])}>]\s?|&#64;|&commat;|%40|\s@\s|\s(?:at|AT|ät|arroba|arobase)\s|@)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|punto|point)\s|\.)"
_AT_MARK = re.compile(_AT)
_AT_SEEN = re.compile(r"%40|&#64;|&commat;|[\s\[({<](?:at|AT|ät|arroba|arobase)[\s\])}>]")
_DOT_BEFORE = re.compile(rf"{_DOT}\Z")
_HOST = re.compile(rf"[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+")
_LABEL = re.compile(r"[^\W_](?:[\w-]*[^\W_])?")
_PIECE = re.compile(r"[\w%'-]+")
_RUN = re.compile(r"(?:\+ ?|\()*\d(?:[\d ().\-/+]*\d)?")
_GROUP = re.compile(r"(?:\+ ?\(?|\()?\d+")
_PHONE_FORMS = {
    "intl": r"\+ ?\d[\d ().\-/]*", "us_paren": r"\(\d{3}\) ?\d{3}[-. ]\d{4}", "us": r"(?:1[-. ])?\d{3}([-.])\d{3}\1\d{4}", "zero_zero": r"00[1-9]\d[ .-]?[\d ().\-/]+", "fr": r"0[1-9]([ .-])\d\d(?:\1\d\d){3}",
    "trunk": r"0[1-9]\d{1,4}[ /-]\d{3,}(?:[ -]\d{2,}){0,2}", "eu_paren": r"\(0\d{1,4}\) ?\d[\d -]{4,}",
}
_PHONE = {k: re.compile(v) for k, v in _PHONE_FORMS.items()}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])(?:[ T]\d{1,2})?|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d")
_TIMES = re.compile(r"(?:[01]\d|2[0-4])[0-5]\d ?- ?(?:[01]\d|2[0-4])[0-5]\d")
_DOTTED = re.compile(r"\d{1,4}(?:\.\d{1,4})+")
_SAY_PHONE = re.compile(r"(?:\b(?:call|phone|tel|telephone\w*|telefon\w*|handy\w*|portable|móvil|mobile|mobil\w*|cell|fax|ring|dial|llama|llame|teléfono|tfno|appel(?:ez|er)|téléphone|tél|anruf|unter|desk|whatsapp|sms|hotline|reach|contact\w*)\b|\bau |\bal )", re.I)
_SAY_COUNT = re.compile(r"(?:\b(?:build|version|rev|revision|offset|order|part|ticket|sku|commit|bind|window|port|size|bytes?|row|line|step|isbn|serial|id)\b\W{0,3}|[_=]\s?|\bv)$", re.I)
# How papers with a personal number are named in several languages.
_ID_LABEL = re.compile(
    r"(?<![^\W\d_])(?:passports?|passeports?|reisep(?:ass|ässe)\w*|pasaportes?|ssn|social[ -]?security|sozialversicherungs\w*|steuer(?:[- ]?id\w*|nummer|[- ]identifikationsnummer)|tax[ -]?(?:payer[ -]?)?(?:id\w*|no|number|file)|tin|itin|dni|nie|nif|cif|curp|nir|insee|nino"
    r"|national[ -]?(?:id\w*|insurance)|identity (?:card|number|no)|id[ -]?card|personalausweis\w*|ausweis\w*|carte d'identité|sécurité sociale|seguridad social|numéro fiscal|número fiscal|codice fiscale|bsn|pesel|driver'?s? licen[cs]e|führerschein\w*)(?![^\W\d_])\.?",
    re.I,
)
_ID_LINK = re.compile(r"[\s:=#'\"(\-–_]*(?:(?:(?:numbers?|nummer|nr|no|num|id|is|ist|est|es|de|sociale?)(?![^\W_])|n[º°])[.:]?[\s:=#'\"(\-–_]*){0,3}", re.I)
_VALUE = re.compile(r"(?<![^\W_])(?=[A-Z\d]*\d|[A-Z]{1,3}(?![^\W_]))[A-Z\d]+(?:[ .\-/](?=[A-Z\d]*\d|[A-Z]{1,3}(?![^\W_]))[A-Z\d]+)*(?![^\W_])")
_CHUNK = re.compile(r"[A-Z\d]+")
# Names of kinds of streets in several languages; first those that stand alone, then those that end a word.
_STREET_WORD = r"Streets?|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Terr|Crescent|Close|Highway|Hwy|Parkway|Row|Alley|rue|avenue|av|boulevard|bd|allée|chemin|place|impasse|quai|cours|route|square|passage|[Cc]alle|C/|[Aa]venida|Avda|[Pp]laza|[Pp]aseo|[Cc]amino|[Cc]arrera|[Rr]onda|[Tt]ravesía|Straße|Strasse|Str|Weg|Platz|Gasse|Allee|Ring|Damm|Ufer"
_STREET_END = r"-Straße|-Strasse|-Str|-Weg|-Platz|-Allee|straße|strasse|str|weg|platz|gasse|allee|ring|damm|ufer|chaussee|steig|stieg|markt|hof|graben|pfad"
_STREET = re.compile(rf"(?:{_STREET_WORD}|{_STREET_END})(?![^\W\d_])")
_LEAD = re.compile(r"(?:A[mn]|Auf|Im|In|Zum|Zur|Unter|Hinter|Vor|Alte[rs]?|Neue[rs]?|Große[rs]?|Kleine[rs]?|Obere[rs]?|Untere[rs]?|de[rnm])")
_KIND_ALONE = re.compile(rf"(?:{_STREET_WORD})\.?")
_KIND_END = re.compile(rf"[{_UP}][^{_UP}]*(?:{_STREET_END})\.?|.*-(?:Straße|Strasse|Str|Weg|Platz|Allee)\.?")
_PLACE = re.compile(rf"\d+(?:-\d+)?(?: ?[a-zA-Z](?![^\W_]|\.))?(?: (?:bis|ter|quater)\b)?|C/|(?:[{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*|rue|avenue|av|boulevard|bd|allée|chemin|place|impasse|quai|cours|route|square|passage|calle|avenida|plaza|paseo|camino|carrera|ronda|travesía|de|la|las|los|del|du|des|d'|el|der|den|dem|n[º°])(?![^\W\d_])\.?|l'|,")
_UNIT = re.compile(r"(?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|Room|Box|Building|Bldg)\.?")
_NAME_PART = re.compile(rf"(?<![\w@+./-])(?<![^\W\d_]['’])(?:(?:[{_UP}]\.)+(?:-[{_UP}]\.)*(?!\w)|{_LETTER}+(?:['’-]{_LETTER}+)*(?![\w@+/]|['’-]\w|\.\w))")
_FIVE = re.compile(r"(?:\d\D{0,4}){4}\d")
_DIGIT = re.compile(r"\d")
_CAMEL = re.compile(rf"[a-zß-ÿ][{_UP}]")
_PARTICLE = frozenset("mac mc von van de der den da di du del della la le el al bin ibn ten ter zu zur dos das san st".split())
_TWO_NAMES = re.compile(rf"(?<!\w)[{_UP}][\w'’.-]*+(?:,? ?|(?: (?:{'|'.join(sorted(_PARTICLE))}))++ )[{_UP}]|(?<!\w)(?:{'|'.join(sorted(_PARTICLE))}) [{_UP}]")
# Words before a person's name, by what they are.
_WORDS_BEFORE = {w: k for k, ws in {
    "greet": "hi hello hey dear thanks cheers danke hallo merci gracias hola", "copyright": "copyright c", "trailer": "cc from to bcc",
    "label": "author authors owner maintainer user users name contact reviewer reviewers customer autor autoren autora auteur verfasser verfasserin responsable attendees login assigned assignee",
    "by": "by from with to ask cc regards thanks reach laut von par por an selon según d'après d’après contactez joindre contact ping per for für pour para a à y et und and is ist est es ce",
    "day": "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi lunes martes miércoles jueves viernes",
    "article": "the der die das le la el a an ein eine un une una this our their each every new",
}.items() for w in reversed(ws.split())}
_BY = frozenset("cc thanks to from contact a".split())
_COPYRIGHT = re.compile(r"(?:copyright (?:\(c\) |© )?|\(c\) |© ?)[\d, -]*$", re.I)


def _before(line: str, s: int) -> str:
    """What stands before place s: the class of the word there, by the marks between."""
    i = s
    while i > 0 and not line[i - 1].isalnum() and not (line[i - 1] in "'’" and line[i - 2 : i - 1] in ("d", "D")):
        i -= 1
    j = i
    while j > 0 and (line[j - 1].isalnum() or line[j - 1] in "_'’-"):
        j -= 1
    word, marks = line[j:i].lower().strip("-"), line[i:s]
    if not word:
        return "start" if not line[:s].strip(" \t>*#/'\"–-") else "other"
    if word[0].isdigit() or word in ("copyright", "c"):
        if _COPYRIGHT.search(line, max(0, s - 40), s):
            return "copyright"
    if marks.rstrip() == ":" and (word.endswith("-by") or _WORDS_BEFORE.get(word) == "trailer" or word in ("cc", "from", "to")):
        return "trailer"
    kind = _WORDS_BEFORE.get(word)
    if kind == "label" or word.endswith(("_name", "_by", "_to", ".name")):
        if not marks.strip(" \t:=\"'’@(<*[{-"):
            return "label"
    elif marks in (" ", ", ") and kind in ("greet", "day") and not (word in _BY and marks == " "):
        return kind
    elif marks == " " and kind:
        return "by" if kind in ("trailer", "greet", "copyright") else kind
    elif word in ("d'", "d’"):
        return "by"
    return "list" if marks.endswith((", ", "; ")) else "other"


_STOP_NAMES = frozenset(
    "the a an this that these those our your my his her its their hi hello hey dear thanks thank and or if in on at of for to from by with as is it he she we you they not no see note todo fixme der die das ein eine und le les un une los las una on monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag lundi mardi lunes martes according laut selon según reported signed copyright contact author mail call ask ship cc ping run regards danke merci gracias d'après new old main error get set".split()
)
_FIRM = re.compile(r"(?:GmbH|AG|KG|OHG|Inc|Ltd|LLC|Corp|SARL|SA|SL|BV|AB|Oy|Foundation|University|Institute?|Labs?|Group|Team|Company|Software|Systems)\.?", re.I)
_COMPANY = re.compile(r"^(?:['’]s\b|,? ?(?:&|GmbH|AG|KG|Inc|Ltd|LLC|Corp|Co\b|S\.?A|SARL|SL|plc|Labs?|Group|Foundation|University|Institut\w*|Prize|Award|Method|Algorithm|Theorem|Library|Street|Straße))", re.I)


class Names:
    """What a name list tells about words: listed, or built like listed ones (a beginning and an ending that recur)."""

    def __init__(self, rows: Iterable[tuple[str | None, str | None]], recur: int = 2):
        self.listed: dict[str, set[str]] = {"given": set(), "family": set()}
        for name, part in rows:
            if name and name.strip() and (part or "").strip().lower() in self.listed:
                self.listed[part.strip().lower()].add(_fold(name.strip()))
        self.parts: dict[str, tuple[set[str], set[str]]] = {}
        for part, names in self.listed.items():
            words = {w for n in names for w in n.split() if w not in _PARTICLE}
            heads, tails = Counter(), Counter()
            for w in words:
                for i in range(1, len(w)):
                    heads[w[:i]] += 1
                    tails[w[i:]] += 1
            self.parts[part] = {h for h, n in heads.items() if n >= recur}, {t for t, n in tails.items() if n >= recur and len(t) >= 2}

    @lru_cache(100_000)  # noqa: B019 - one object per worker
    def known(self, word: str, part: str) -> int:
        """2: listed; 1: built like listed names; 0: neither."""
        w = _fold(word)
        if w in self.listed[part] or ("-" in w and all(x in self.listed[part] for x in w.split("-"))):
            return 2
        last = w.split()[-1]
        heads, tails = self.parts[part]
        if "'" in last:  # O'Name: what follows the apostrophe ends like listed names
            last = last.rpartition("'")[2]
            return int(any(last[i:] in tails for i in range(1, len(last) - 3)))
        # A single letter says little as a beginning, so it needs an ending of four.
        return int(len(last) >= 5 and any(last[:i] in heads and last[i:] in tails for i in range(1, len(last) - 2)))


def _fold(name: str) -> str:
    return name.replace("’", "'").casefold()


Span = tuple[int, int, str, tuple[str, ...]]


def _local_start(line: str, end: int) -> int:
    """Where what can be the local part of an address before ``end`` begins."""
    i = end
    while True:
        j = i
        while j > 0 and (line[j - 1].isalnum() or line[j - 1] in "_.+%'-"):
            j -= 1
        if j == i:
            return i
        dot = _DOT_BEFORE.search(line, max(0, j - 10), j)
        if not dot or dot.start() == 0:
            return j
        i = dot.start()


def _emails(line: str) -> Iterator[Span]:
    for at in _AT_MARK.finditer(line):
        run, host = _local_start(line, at.start()), _HOST.match(line, at.end())
        if run == at.start() or not host:
            continue
        said = "sign" if at[0] == "@" else "mask" if not at[0].strip().isalpha() else "said"
        ends = [m.end() for m in _LABEL.finditer(line, host.start(), host.end())][1:]
        for piece in _PIECE.finditer(line, run, at.start()):
            s = piece.start()
            before = line[max(0, s - 40) : s]
            left = "whole" if s == run or not line[run:s].strip(".'+-") else "spaced" if line[s - 1].isspace() else "cut"
            for e in ends:
                after = line[e : e + 2]
                text = line[s:e]
                last = re.split(_DOT, line[host.start() : e])[-1]
                f = [f"email:{said}:{left}", "email:host_whole" if e == host.end() else "email:host_cut", "email:tld" if last.isalpha() and len(last) >= 2 else "email:no_tld"]
                if said == "said" and " dot " not in text.lower() and not re.search(r"\s(?:punkt|punto|point)\s", text):
                    f.append("email:prose")
                if left == "spaced":
                    f.append(f"email:spaced:{said}")
                if re.search(r"\w+://\S*$", before):
                    f.append("email:in_url")
                if re.match(r":[\w~/]|/\w", after):
                    f.append("email:path_after")
                if text.lower().startswith(("git@", "hg@", "svn@")) or re.search(r"\b(?:git clone|ssh|scp|rsync)\s+\S*$", before):
                    f.append("email:repository")
                if re.match(r"\d+\.\d", line[host.start() : e]):
                    f.append("email:version")
                yield s, e, "email", tuple(f)


def _phones(line: str, labels: list[int]) -> Iterator[Span]:
    for run in _RUN.finditer(line):
        groups = [(m.start(), m.end(), sum(c.isdigit() for c in m[0])) for m in _GROUP.finditer(line, run.start(), run.end())]
        for i, (s, _, _) in enumerate(groups):
            left = "joined" if i and line[s - 1] in ".-/+(" else "digits" if i else "word" if s and (line[s - 1].isalnum() or line[s - 1] in "_@") else "mark" if s and line[s - 1] in ":.,-/" else "free"
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][2]
                if digits > 15:
                    break
                if digits < 7:
                    continue
                e = groups[j][1]
                inside = line[s] == "(" and line.find(")", s, e) < 0  # the bracket is around the number
                s += inside
                text, after = line[s:e], line[e : e + 2]
                right = "more" if j + 1 < len(groups) else "word" if after[:1].isalnum() or after[:1] in ("@", "_") else "time" if re.match(r"[:.,]\d", after) else "free"
                before = line[max(0, s - 30) : s]
                forms = [k for k, p in _PHONE.items() if p.fullmatch(text)]
                f = [f"phone:{k}" for k in forms] or ["phone:bare" if text.isdigit() else "phone:no_form"]
                f += [f"phone:left_{left}", f"phone:right_{right}", "phone:open" if text.count("(") != text.count(")") else "phone:closed"]
                if _SAY_PHONE.search(before):
                    f.append("phone:said")
                elif _SAY_COUNT.search(before):
                    f.append("phone:counted")
                if _DATE.match(text):
                    f.append("phone:date")
                if _TIMES.fullmatch(text):
                    f.append("phone:times")
                if _DOTTED.fullmatch(text) and "us" not in forms and "fr" not in forms:
                    f.append("phone:dotted")
                if any(0 <= s - x <= 30 for x in labels):
                    f.append("phone:after_id_label")
                yield s, e, "phone", tuple(f)


def _ids(line: str, labels: list[int]) -> Iterator[Span]:
    first = True
    for run in _VALUE.finditer(line, labels[0]):
        chunks = [(m.start(), m.end()) for m in _CHUNK.finditer(line, run.start(), run.end())]
        label = max(x for x in labels if x <= run.start())
        counted = False
        for i, (s, _) in enumerate(chunks):
            between = line[label:s]
            link = _ID_LINK.match(line, label).end() >= s
            words = len(re.findall(r"[^\W\d_]+", between))
            near = "link" if link else "other1" if words <= 1 else "other2" if words <= 2 else "far"
            for j in range(i, len(chunks)):
                e = chunks[j][1]
                text = line[s:e]
                digits = sum(c.isdigit() for c in text)
                if digits > ID_DIGITS:
                    break
                if digits < 5:
                    continue
                counted = True
                f = ["id:any", f"id:{near}", "id:start" if i == 0 else "id:inside", "id:end" if j + 1 == len(chunks) else "id:cut", "id:first" if first else "id:later", f"id:digits{min(digits, 8)}"]
                if _DATE.fullmatch(text):
                    f.append("id:date")
                if re.match(r" ?[^\W\d_]+", line[e:]) and text.isdigit() and near != "link":
                    f.append("id:counts")
                yield s, e, "id_number", tuple(f)
        first = first and not counted


def _addresses(line: str) -> Iterator[Span]:
    parts = [(m.start(), m.end(), m[0]) for m in _PLACE.finditer(line) if not (m.start() and m[0][0].isalnum() and line[m.start() - 1].isalnum()) and not (line[m.end() - 1].isalnum() and (line[m.end() : m.end() + 1].isalnum() or line[m.end() : m.end() + 1] == "_"))]
    n = len(parts)
    for i in range(n):
        s, e, w = parts[i]
        if w == "," or (s and line[s - 1] in "_-.") or (s > 1 and line[s - 1] in ":," and line[s - 2].isdigit()) or w.rstrip(".") in ("de", "la", "las", "los", "del", "du", "des", "el", "der", "den", "dem"):
            continue
        numbers, kinds, words, house = 0, [], 0, w[0].isdigit()
        for j in range(i, n):
            if j > i and line[parts[j - 1][1] : parts[j][0]] not in ("", " "):
                break
            p = parts[j][2]
            if p[0].isdigit():
                numbers += 1
            elif p != ",":
                words += 1
                if _KIND_ALONE.fullmatch(p):
                    kinds.append((j, "word"))
                elif _KIND_END.fullmatch(p):
                    kinds.append((j, "end"))
            if numbers > 1 or words > ADDRESS_WORDS:
                break
            if numbers != 1 or not kinds or (j == i) or p == "," or not (house or p[0].isdigit()) or (not p[0].isdigit() and not (p[0].isupper() or (j, "word") in kinds)):
                continue
            e = parts[j][1]
            at, how = kinds[-1] if house else kinds[0]
            where = "last" if at == j or (at == j - 1 and p[0].isdigit()) else "first" if at == i or (house and at <= i + 2 and parts[at - 1][2] in (w, ",")) else "inner"
            lower = "lower" if parts[at][2][0].islower() else "upper"
            f = [f"address:{'house_first' if house else 'house_last'}:{how}:{where}:{lower}", f"address:words{min(words, 6)}", f"address:kinds{min(len(kinds), 3)}"]
            if how == "end" and at > i:
                f.append("address:lead_known" if all(_LEAD.fullmatch(x[2]) for x in parts[i:at]) else "address:lead_other")
            before, after = line[max(0, s - 30) : s], line[e : e + 24]
            if i and _LEAD.fullmatch(parts[i - 1][2]) and line[parts[i - 1][1] : s] == " ":
                f.append("address:lead_before")
            if re.match(rf"(?:\.(?!\w))? [{_UP}][^\W\d_]+", after) and not p[0].isdigit():
                f.append("address:capital_after")
            if re.match(r"[\w]|[.:-]\d", after):
                f.append("address:cut")
            if re.match(r" [a-z]", after) and house:
                f.append("address:prose_after")
            if i and not house and line[parts[i - 1][1] : s] == " " and parts[i - 1][2][0].isupper():
                f.append("address:capital_before")
            if re.search(r"(?i)\b(?:error|warn|info|debug)\b", line[s:e]) or re.search(r"\d[:.,]$", before):
                f.append("address:log")
            if any(_UNIT.fullmatch(x[2]) for x in parts[i : j + 1]):
                f.append("address:unit")
            if any(x[2] == "," for x in parts[i : j + 1]):
                f.append("address:comma")
            f.append("address:listed" if re.match(r",|\s*$|[\"'.;)]", after) else "address:open")
            yield s, e, "address", tuple(f)


def _persons(line: str, names: Names) -> Iterator[Span]:
    parts = []
    for m in _NAME_PART.finditer(line):
        w = m[0]
        e = m.end()
        if len(w) == 1 and line[e : e + 1] == ".":
            w, e = w + ".", e + 1
        if w[0].isupper() or w in _PARTICLE:
            parts.append((m.start(), e, w, "I" if w[-1] == "." else "P" if w.lower() in _PARTICLE else "W"))
    n = len(parts)
    for i in range(n):
        s, e, w, kind = parts[i]
        if kind == "W" and len(w) == 1:
            continue
        comma, words = 0, 0
        for j in range(i, min(n, i + PERSON_PARTS)):
            if j > i:
                gap = line[parts[j - 1][1] : parts[j][0]]
                if gap in (", ", ",") and not comma and parts[j - 1][3] == "W":
                    comma = j
                elif gap != " ":
                    break
            words += parts[j][3] == "W" and len(parts[j][2]) > 1
            if j == i or words < 1 or parts[j][3] == "P" or (parts[j][3] == "I" and not (comma and j > comma)) or (kind == "P" and not w[0].isupper() and not comma):
                continue
            if words < 2 and not any(p[3] == "I" for p in parts[i : j + 1]):
                continue
            yield _person(line, names, parts, i, j, comma)


def _person(line: str, names: Names, parts: list[tuple], i: int, j: int, comma: int) -> Span:
    s, e = parts[i][0], parts[j][1]
    part = parts[i : j + 1]
    if comma:
        family, given = part[: comma - i], part[comma - i :]
    else:
        k = len(part) - 1
        while k > 1 and part[k - 1][3] == "P":
            k -= 1
        family, given = part[k:], part[:k]
    called = line[family[0][0] : family[-1][1]]
    fam = max(names.known(called, "family"), names.known(family[-1][2], "family"))
    lead = names.known(family[0][2], "family") if len(family) > 1 and family[0][3] == "W" else 2
    own = "I" if given[0][3] == "I" else str(names.known(given[0][2], "given"))
    middle = "".join(sorted({x[3] for x in given[1:]})) or "0"
    before, after = line[max(0, s - 40) : s], line[e : e + 24]
    where = _before(line, s)
    known = f"{own}{fam}"
    sure = "sure" if known in ("22", "21", "12", "11", "I2", "I1") else "half" if known[0] in "12" or fam else "none"
    f = [f"person:{'comma' if comma else 'straight'}:{middle}:{sure}", f"person:known{known}", f"person:{where}:{sure}", f"person:parts{min(len(part), 5)}"]
    if len(family) > 1 and (comma or len(family) > 4 or any(x[3] != "P" for x in family[:-1])):
        f.append("person:long_family")
    if len(family) > 1 and family[0][3] == "W":
        f += [f"person:family_lead{lead}", "person:family_then_particle" if any(x[3] == "P" for x in family) else "person:family_words"]
    if any(_FIRM.fullmatch(x[2]) for x in part):
        f.append("person:firm_word")
    if middle in ("W", "IW", "PW"):
        f.append("person:middle_known" if all(names.known(x[2], "given") or names.known(x[2], "family") for x in given[1:] if x[3] == "W") else "person:middle_unknown")
    if not comma and sure != "sure" and names.known(part[-1][2], "given") == 2 and names.known(part[0][2], "family") == 2:
        f.append("person:swapped")
    stops = sum(x[2].lower() in _STOP_NAMES for x in part)
    if stops:
        f.append("person:stop_first" if part[0][2].lower() in _STOP_NAMES else "person:stop")
    if i and line[parts[i - 1][1] : s] == " " and parts[i - 1][2].lower() not in _STOP_NAMES:
        f.append("person:part_before" if parts[i - 1][3] != "W" or names.known(parts[i - 1][2], "given") else "person:word_before")
    if line[e : e + 1] == " " and j + 1 < len(parts) and parts[j + 1][0] == e + 1:
        f.append("person:part_after" if names.known(parts[j + 1][2], "family") or parts[j + 1][3] != "W" else "person:word_after")
    if _COMPANY.match(after.lstrip()) or re.search(r"&\s?$", before):
        f.append("person:company")
    if part[0][3] == "I" and i and line[parts[i - 1][1] : s] == " " and parts[i - 1][3] == "W" and parts[i - 1][2].lower() not in _STOP_NAMES:
        f.append("person:initial_cut")
    if all(len(x[2]) > 1 and x[2].isupper() for x in part if x[3] == "W"):
        f.append(f"person:capitals:{sure}")
        if line.isupper() and len(line) > 2 * (e - s):
            f.append(f"person:capital_line:{sure}")
    elif any(len(x[2]) <= 3 and x[2].isupper() for x in part if x[3] == "W"):
        f.append("person:short_capitals")
    if any(_ID_LABEL.match(x[2]) for x in part):
        f.append("person:id_word")
    if any(_CAMEL.search(x[2]) for x in part):
        f.append(f"person:camel:{sure}")
    if after[:1] in ("(", "[", "{"):
        f.append("person:call_after")
    elif re.match(r"\s*[<(;]", after):
        f.append("person:bracket_after")
    elif re.match(r" [a-zß-ÿ]", after):
        f.append(f"person:lower_after:{sure}")
    elif re.match(r"['’]s\b", after):
        f.append("person:owns")
    if where == "start":
        f.append(f"person:{'alone' if not line[e:].strip(' .,') else 'begins'}:{sure}")
    return s, e, "person", tuple(f)


def spans(line: str, names: Names) -> list[Span]:
    """Every span of a line that can be of a type, with its features."""
    found: list[Span] = []
    if "@" in line or _AT_SEEN.search(line):
        found += _emails(line)
    if _DIGIT.search(line):
        if _FIVE.search(line):
            labels = [m.end() for m in _ID_LABEL.finditer(line)]
            found += _phones(line, labels)
            if labels:
                found += _ids(line, labels)
        if not line.islower() and _STREET.search(line):
            found += _addresses(line)
    if not line.islower() and _TWO_NAMES.search(line):
        found += _persons(line, names)
    return sorted(set(found), key=lambda c: (c[1], c[0], c[2]))


def _between(line: str, a: Span, b: Span) -> str | None:
    """The feature of two entities next to each other, if b begins at most GAP characters behind a."""
    if not 0 <= b[0] - a[1] <= GAP:
        return None
    gap = line[a[1] : b[0]].strip().lower()
    return f"{a[2]}>{gap if gap in ('', ',', ';', '<', '(', '&') else 'and' if gap in ('and', 'und', 'et', 'y', 'e', 'or') else 'other'}>{b[2]}"


class Lattice:
    """The segmentations of a line: spans in order of their ends, and which may follow which.

    For each span: how many spans end too far before it to be neighbours (a prefix of the order), and the neighbours with their feature. A neighbour always
    pays its transition; every other predecessor is reached through the prefix, where no transition is due.
    """

    def __init__(self, line: str, found: list[Span]):
        self.found = found
        ends = [c[1] for c in found]
        self.far = [bisect_left(ends, c[0] - GAP) for c in found]
        self.near = [[(k, _between(line, found[k], c)) for k in range(far, i) if found[k][1] <= c[0]] for i, (c, far) in enumerate(zip(found, self.far))]

    def best(self, own: list[float], weights: dict[str, float]) -> list[Span]:
        total, link, top = [], [], [(0.0, -1)]
        for i, score in enumerate(own):
            before = top[self.far[i]]
            for k, g in self.near[i]:
                before = max(before, (total[k] + weights.get(g, 0.0), k))
            total.append(score + before[0])
            link.append(before[1])
            top.append(max(top[-1], (total[i], i)))
        i, chosen = top[-1][1], []
        while i >= 0:
            chosen.append(self.found[i])
            i = link[i]
        return chosen[::-1]

    def expected(self, own: list[float], weights: dict[str, float]) -> tuple[float, list[float], dict[str, float]]:
        """(log of the sum over all segmentations, probability of each span, expected count of each transition): forward, then backward."""
        ahead, sums = [], [0.0]  # log-sums of what ends with span i, and of what uses only the first i spans
        for i, score in enumerate(own):
            ahead.append(score + _add([sums[self.far[i]], *[ahead[k] + weights.get(g, 0.0) for k, g in self.near[i]]]))
            sums.append(_add([sums[i], ahead[i]]))
        n, z = len(own), sums[-1]
        to_sum, p, moves = [0.0] * n + [1.0], [0.0] * n, {}
        for i in range(n - 1, -1, -1):
            # What passes through sums[i + 1] came from span i or from sums[i].
            share = exp(ahead[i] - sums[i + 1]) * to_sum[i + 1]
            to_sum[i] += to_sum[i + 1] - share
            p[i] += share
            base = ahead[i] - own[i]
            to_sum[self.far[i]] += p[i] * exp(sums[self.far[i]] - base)
            for k, g in self.near[i]:
                part = p[i] * exp(ahead[k] + weights.get(g, 0.0) - base)
                p[k] += part
                moves[g] = moves.get(g, 0.0) + part
        return z, p, moves


def _add(logs: list[float]) -> float:
    top = max(logs)
    return top if len(logs) == 1 else top + log(sum(exp(x - top) for x in logs))


def best(line: str, found: list[Span], weights: dict[str, float]) -> list[Span]:
    """The segmentation of the highest score, as its entities."""
    own = [sum([weights.get(f, 0.0) for f in c[3]]) for c in found]
    if len(own) == 1:
        return found if own[0] > 0 else []
    return Lattice(line, found).best(own, weights)


@lru_cache(4)
def fit(steps: int = STEPS, penalty: float = PENALTY, rate: float = RATE) -> tuple[tuple[str, float], ...]:
    """Weights of the features, by gradient steps on the penalised log-likelihood of the labelled sample. Labelled spans that are no candidates are left out."""
    names = Names(TRAIN_NAMES)
    lines = [(line, found, gold) for line, gold in training() if (found := spans(line, names))]
    at = {f: i for i, f in enumerate(sorted({f for _, found, _ in lines for c in found for f in c[3]} | {f"{a}>{g}>{b}" for a in KINDS for b in KINDS for g in ("", ",", ";", "<", "(", "&", "and", "other")}))}
    feats = np.array([at[f] for _, found, _ in lines for c in found for f in c[3]])
    where = np.repeat(np.arange(sum(len(found) for _, found, _ in lines)), [len(c[3]) for _, found, _ in lines for c in found])
    lattices = [Lattice(line, found) for line, found, _ in lines]
    right = np.array([float(c[:3] in gold) for _, found, gold in lines for c in found])
    moves = np.zeros(len(at))
    for (line, found, gold), lat in zip(lines, lattices):
        chosen = [c for c in found if c[:3] in gold]
        for a, b in zip(chosen, chosen[1:]):
            if g := _between(line, a, b):
                moves[at[g]] += 1
    keys, w, mean, square = list(at), np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, steps + 1):
        own = np.bincount(where, w[feats], len(right)).tolist()
        weights = dict(zip(keys, w.tolist()))
        p, expected, begin = [], np.zeros(len(at)), 0
        for lat in lattices:
            _, each, used = lat.expected(own[begin : begin + len(lat.found)], weights)
            begin += len(lat.found)
            p += each
            for g, n in used.items():
                expected[at[g]] += n
        slope = np.bincount(feats, (right - np.array(p))[where], len(at)) + moves - expected - penalty * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return tuple((k, round(x, 6)) for k, x in zip(keys, w.tolist()) if x)


def find_spans(text: str | None, names: Names, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity of a text."""
    if not text:
        return []
    out, at = [], 0
    for line in re.split(r"([\n\r\x0b\x0c\x85  ])", text):
        if len(line) > 3 and (found := spans(line, names)):
            out += [(at + s, at + e, kind) for s, e, kind, _ in best(line, found, weights)]
        at += len(line)
    return out


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each entity replaced by a placeholder of its kind."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


_WORKER: dict[int, Names] = {}


def _names(rows: list[tuple]) -> Names:
    """The name list of a job, prepared once per worker process."""
    key = hash(tuple(rows))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Names(rows)
    return _WORKER[key]


def _model(name_list: DataFrame, limit: int = MAX_NAMES) -> tuple[list[tuple], dict[str, float]]:
    rows = [tuple(r) for r in name_list.select("name", "name_part").filter("name is not null").distinct().limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"the name list has more than {limit} names; raise MAX_NAMES after checking executor memory")
    return rows, dict(fit())


def personal_information(docs: DataFrame, name_list: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, start_pos, end_pos), one row per entity. See the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(name_list))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = _names(shared.value[0]), shared.value[1]
        for b in batches:
            rows = [(d, k, s, e) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e, k in find_spans(t, names, weights)]
            cols = zip(*rows) if rows else [[]] * 4
            kinds = (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "pii_kind", "start_pos", "end_pos"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter("text is not null").mapInArrow(run, f"doc_id {kind}, pii_kind string, start_pos int, end_pos int")


def redacted(docs: DataFrame, name_list: DataFrame) -> DataFrame:
    """(doc_id, text): every text, with its entities replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [PERSON]."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(name_list))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = _names(shared.value[0]), shared.value[1]
        for b in batches:
            out = [redact(t, find_spans(t, names, weights)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")
