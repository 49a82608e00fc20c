"""The labelled sample on which the personal-information model is fitted, and the held-out one on which it is measured.

Both are made from sentence frames and value makers, by a fixed random sequence; names, numbers, hosts and streets are invented or common ones of
several countries. The two share neither frames nor names. ``{person}``, ``{email}``, ``{phone}``, ``{address}`` and ``{id:form}`` in a frame become labelled spans.
SAMPLE bounds the sample: so many lines are made of each frame.
"""

from __future__ import annotations

import random
import re

#: Lines made of each frame.
SAMPLE = 8

Line = tuple[str, set[tuple[int, int, str]]]

TRAIN = """
{person} opened this one
Opened by {person}
landed for {person} <{email}>
Co-authored-by: {person} <{email}>
Signed-off-by: {person} <{email}>
Acked-by: {person}
Helped-by: {person}
Suggested-by: {email}
  - {person} ({email})
* {person}, {email}, {phone}
authors = ["{person} <{email}>"]
"author": "{person}",
  email: {email}
mail={email};tel={phone}
on-call: {person} ({phone})
# written by {person}
// original version by {person}, {email}
/* (c) 2017 {person} */
Copyright (c) 2016-2019 {person}
@author {person}
CC: {person}, {person}
cc {person}, {person} and {person}
many thanks to {person} and {person} for the review
Big thanks to {person}, who traced it.
Worked with {person} and {person} on that.
Reviewers: {person}, {person}
Attendees: {person}, {person}, {person}
Dear {person},
Kind regards, {person}
-- {person}
{person} wrote on Tuesday:
Am Dienstag schrieb {person}:
Le mardi, {person} a écrit :
El martes {person} escribió:
Vielen Dank an {person} und {person} für die Hilfe.
Danke, {person}!
Zuständig ist {person}, erreichbar unter {phone}.
Telefonnummer: {phone}
Handynummer ist {phone}
Merci à {person} et {person} pour la relecture.
Le correctif vient de {person} ({email}).
Joindre {person} au {phone} ou {email}
Gracias a {person} y {person} por la ayuda.
Lo arregló {person}; su correo es {email}
Responsable: {person}, móvil {phone}
{person} said the patch works
{person} and {person} disagree here
{person} hat das bestätigt
Geprüft von {person}
Verfasst von {person}
{person}, passport {id:passport}
{person}, NIF {id:dni}
{person}, DNI: {id:dni}
record of {person}, SSN {id:ssn}
On Thursday {person} tested it.
Yesterday Evening {person} left
Freigegeben von {person}
Übergeben von {person} an die Technik
last Friday {person} deployed it
D'accord avec {person}
Vérifié par {person}
Comprobado por {person}
Ecrivez à {person}
Appelez {person} au {phone}
Gestartet von {person}, {phone}
Enviado por {person}
Relu par {person}
{person} l'a confirmé
{person} lo confirmó
as {person} pointed out, the lock is held twice
We asked {person} about it yesterday.
Talk to {person} first
ping {person} when done
assigned_to: {person}
name: {person}
full_name = '{person}'
user {person} signed in from a new device
customer={person} status=ok
"contact": {"name": "{person}", "mail": "{email}", "phone": "{phone}"}
From: {person} <{email}>
To: {email}
Reply to {email} please.
Use {email} or {email}.
drop me a line: {email}
My address is {email}, spam goes elsewhere.
Questions? {email}
mailto:{email}
schreib an {email}
écris-moi : {email}
correo: {email}
bounce from <{email}>: mailbox full
sent report to {email} in 12 ms
2023-11-04T09:22:41Z INFO mail queued for {email}
2023-11-04 09:22:41,120 WARN sms to {phone} failed
please ring {phone} before noon
Phone: {phone}
Tel. {phone}
fax {phone}
mobile {phone}, office {phone}
My number is {phone}.
Reach us at {phone} between nine and five
Ruf mich unter {phone} an
Appelle le {phone} si besoin
Llama al {phone} por la tarde
hotline = "{phone}"
SSN: {id:ssn}
social security number {id:ssn} was logged in clear
his SSN is {id:ssn}, remove it
passport {id:passport}
Passport number: {id:passport}
"passport_no": "{id:passport}"
the scan shows passport no {id:passport} of {person}
Reisepass {id:passport}
numéro de passeport {id:passport}
pasaporte {id:passport} de {person}
Personalausweis Nr. {id:passport}
tax id {id:tax}
Tax number: {id:tax}
Steuernummer {id:tax}
Steuer-ID: {id:tax}
NIF: {id:dni}
DNI {id:dni}
el DNI {id:dni} aparece en la traza
numéro fiscal {id:tax}
n° de sécurité sociale {id:nir}
national insurance number {id:nino}
National ID: {id:tax}
identity card {id:dni}
lives at {address}
Address: {address}
address = "{address}"
ship it to {address}, second floor
deliver to {address}, 40210 Nordhausen
wohnt in der Nähe, {address}, 40210 Nordhausen
Anschrift: {address}
Lieferung an {address}
adresse : {address}, 31000 Valbourg
il habite {address}
domicilio: {address}
vive en {address}, 2º B
the office moved to {address}
remit to {address}, Springfield, IL 62704
home = "{address}, Salem, OR 97301"
{person}, {address}, Boise, ID 83702
the flat at {address} is empty
{address} was the old office
we meet near {address} at noon
my new place: {address}, Unit 7, Lakewood 40311
parcel for {address}, Suite 300
back to {address}, Flat 4
move to {address}, Apt. 9, Rivertown
{person}, {address}, {phone}
{person}; {email}; {phone}; {address}
Invoice for {person}, {address}
"""

#: Lines without personal information.
TRAIN_NONE = """
The Release Notes list every change.
Known Issues and Open Questions
Getting Started with Docker Compose
See the Developer Guide for details
Written in Rust and Python
Powered by Apache Kafka and Redis Cluster
Thanks to Continuous Integration this is green
by Design Review Board
Reviewed by Security Team
contact Customer Support
The {listed} Algorithm runs in linear time
a {person:} Award winner
the {person:} Prize
{family} & {family} Ltd. bought it
{family} and Sons Inc. sells it
{family} Software AG
The {family} Library is fast
named after {family}, the inventor
{given} fixed it
Hi {given}, looks good
@{given} please look
thanks {given}!
{given} and {given} agreed
Hello World Example
Main Street Parser Tests
Class Diagram, Sequence Diagram
public static void Main
New York and San Francisco
Visual Studio Code, Sublime Text
Monday Morning Build
Der Neue Server läuft
Die Große Umstellung am Montag
La Nouvelle Version corrige cela
El Nuevo Servidor ya funciona
Error Handling, Retry Policy
GET HTTP REST JSON
TODO Remove Later
Merge Branch Feature
FooBar BazQux, QuxManager FooFactory
ImportError: No Module Named Foo
Google Cloud and Amazon Web Services use it
git clone git@code.invalid:team/tool.git
scp build@deploy.invalid:/srv/out .
ssh://git@repo.invalid/x/y.git
postgresql://app:{digits}@db.invalid:5432/main
https://user@host.invalid/path
npm install left-pad@{version}
requires "core@{version}"
uses: actions/checkout@v4
@media screen and (min-width: 640px)
@property def x(self)
meet me at noon dot dot dot
look at line 40 dot matrix
build {ssn:}
commit {digits}
order {digits} shipped
id={digits}
job {digits} took 3120 ms
ticket 4410-2231-77
serial {ssn:}
isbn 978-3-16-148410-0
version {version}
v{version}
0.0.0.0:8080 and 127.0.0.1:9090
192.168.10.24 is down
10.12.0.113, 10.12.0.114
2024-05-06 07:08:09 started
2024-05-06T07:08:09.123456Z done
from 2019-03-04 to 2021-05-06
port 8080, pid 31337, uid 1000
{digits} bytes written
at offset {digits}
timestamp {digits}
1 2 3 4 5 6 7 8 9 10
100 200 300 400
0x7ffe12345678
sha 1f3a9c0b7d 20210304050607
range 1000-2000 or 3000-4000
price 1.234.567,89
1,234,567 rows
room 1204, floor 12
3.14159265358979
step 12 of 40, line 1044, column 18
the passport check takes 20000 ms
tax rules of 2023 apply to 12000 cases
ssn column has 9 digits
DNI validation fails for 100000 rows
passport table: {digits} rows
identity card parser, build {digits}
12 Angry Tests ran
5 Street lights
In 2020 Road works began
the 10 Way handshake
rue sans numéro
Straße der Tests
calle sin número
Chapter 3 Place Holders
40 Drive letters
Port 22 Close
RAISE VALUEERROR(MSG) FOR ITEM IN ROWS
SELECT COUNT(ID) FROM ORDERS WHERE STATUS IN (OPEN, CLOSED)
INSERT INTO T VALUES(A, B) RETURNING C
IF FOO(BAR, 3) THEN RETURN BAZ(QUX, 4)
{given} Garden parser
{given} Edge detector, see FooBar
{given} Cache and {given} Queue are modules
the {given} Period handling
{family} Bridge adapter
(c) 2015 {family} GmbH
Copyright 2011 {family} Inc
open 0830-1615 daily
shift: 0600-1400
opening hours 1000-1830
CHECK ALL ROWS BEFORE THE NEXT RUN AND STOP ON ERROR
WHICH FUNCTION DOES THE WORK AFTER THE LOCK IS FREE
IF THE FIRST PASS FAILS, LOG EVERY ROW AND STOP
# QUAND LE CONTRÔLE ÉCHOUE, AUCUNE LIGNE NE SERA LUE
WARNUNG ALLE ZEILEN WERDEN VOR DEM NEUSTART GELESEN
## Open Points
Status Report
# Design Goals
Index Format
## Data Model
Error Codes
### Test Plan
Build Steps
## Memory Layout
Public Interface
== Coding Style
Next Steps
- Query Planner
Thread Pools
Lose Enden
Neue Funktionen
Notes Techniques
Primeros Pasos
Platz 3 im Ranking
Weg 2 ist besser
2 Main branches
7 Court cases, 12 Square meters
"""

HELD = """
Fixed together with {person}.
patch from {person} ({email})
Tested-by: {person} <{email}>
Reported-by: {person}
maintained by {person} and {person}
# Kept alive by {person} <{email}>
owner: {person}
Author: {person}
Reviewed by {person} and {person}
{person} confirmed that the fix helps.
According to the notes, {person} owns this module.
Best wishes, {person}
Bearbeitet von {person}, {email}
{person} meldete den Fehler.
Corrigé par {person} au {phone}
Avisado por {person} ({email})
in copy: {person}, {person}
contact {person} at {phone}
send logs to {email}
the mailbox {email} bounces
Nur an {email} schicken
envoyez tout à {email}
manda el fichero a {email}
support: {phone}
Telefonnummer ist {phone}
you may phone {phone} on weekdays
mon portable est le {phone}
teléfono {phone}
cell: {phone}
social security no. {id:ssn}
SSN {id:ssn} in fixture
Passport No: {id:passport}
Reisepassnummer {id:passport}
passeport n° {id:passport}
Steuernummer: {id:tax}
taxpayer id {id:tax}
the DNI is {id:dni}
numéro de sécurité sociale : {id:nir}
our office: {address}
Postal address: {address}
visit {address} after ten
Wohnort {address}
siège : {address}
calle del cliente: {address}
send the board to {person}, {address}
{person} <{email}>, {phone}
user.name={person}
The person behind this is {person}.
"""

HELD_NONE = """
Table of Contents
See Also: Related Work
The Quick Start Guide explains it
Supported by Data Platform Team
{family} Labs GmbH hosts it
The {person:} Foundation
good catch, {given}
git@vcs.invalid:group/app.git
pip install tool=={version}
docker pull image@sha256:{digits}
ran {digits} steps in 200 s
session {digits} closed
2022-12-01 23:59:59 [main] DEBUG flush
listening on 172.16.4.20:6379
error code 4030-1187
3 Road tests failed
the tax table holds {digits} lines
passport module v{version}
Platform Engineering, Site Reliability
Step 4 Close the file
"""

# Names of the training lines: (listed, not listed). The second halves are never in the list.
_TRAIN_GIVEN = "Anna Peter Maria Thomas Laura Daniel Sofia Lucas Elena Martin Clara Hugo Nina Felix Marta Jorge Camille Louis Greta Emil Joreth Jorina Meleth Melina Sarulf Sarina Danorin Dareth Perina Perulf Rose Mark Grace".split()
_TRAIN_FAMILY = "Becker Novak Moreau Garcia Lindqvist Rossi Kowalski Dubois Hansen Keller Romero Laurent Schmitt Torres Nilsson Bramfield Bramridge Thornfield Thornwick Quillridge Quillwick Vessfield Vessmann Bramwick Stone Field Lee".split()
_MORE_GIVEN = "Kenji Aisha Dmitri Fatima Rahul Ingrid Chen Amina Tariq Leila Bogdan Yuki Sven Noor Mateo Joulf Pereth Melorin Saroth".split()
_MORE_FAMILY = "Tanaka Okafor Ivanov Haddad Sharma Bergström Liu Mensah Farouk Nazari Popescu Sato Okoye Rahman Vega Thornmann Quillfield Vesswick O'Donnell Saint-Clair".split()
_HELD_GIVEN = ("Olga Bruno Ines Karl Paula Viktor Julia Andre Irene Simon".split(), "Wei Priya Kwame Zara Hiroshi Mei Arjun Nadia Omar Selma".split())
_HELD_FAMILY = ("Fischer Petit Santos Wagner Muller Castro Girard Weber Molina Roux".split(), "Zhang Petrova Natarajan Mbeki Yamada Hussein Iyer Kaplan Larsson O'Brien".split())
#: What the training list and the held-out list hold: about half of the names that occur.
TRAIN_NAMES = [*[(n, "given") for n in _TRAIN_GIVEN], *[(n, "family") for n in _TRAIN_FAMILY]]
HELD_NAMES = [*[(n, "given") for n in _HELD_GIVEN[0]], *[(n, "family") for n in _HELD_FAMILY[0]]]


class _Maker:
    """Values of one sample."""

    def __init__(self, seed: int, given: tuple[list[str], list[str]], family: tuple[list[str], list[str]]):
        self.r, self.given, self.family = random.Random(seed), given, family

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def pick(self, lists: tuple[list[str], list[str]]) -> str:
        return self.r.choice(lists[self.r.random() < 0.4])

    def person(self) -> str:
        g, f, x = self.pick(self.given), self.pick(self.family), self.r.random()
        if x > 0.9:
            f = f"{self.r.choice(['van', 'von', 'de', 'de la', 'Mac', 'van der', 'di'])} {f}"
        initial = self.r.choice("ABCDEFGHJKLMRST") + "."
        forms = [f"{g} {f}"] * 8 + [f"{f}, {g}"] * 3 + [f"{initial} {f}"] * 4 + [f"{g} {initial} {f}"] * 6 + [f"{f}, {g} {initial}", f"{g} {f}".upper(), f"{g} {self.pick(self.given)} {f}", f"{g}-{self.pick(self.given)} {f}", f"{g} {f}-{self.pick(self.family)}"]
        return self.r.choice(forms)

    def email(self) -> str:
        r = self.r
        g, f = self.pick(self.given).lower(), self.pick(self.family).lower().replace("'", "")
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{g}", f"{f}{r.randint(1, 99)}", f"{g}_{f}", f"{g}+{r.choice(['x', 'list', 'git'])}", f"{g}-{f[0]}", f"{g[0]}.{f}"])
        labels = r.choice([["mailbox", "invalid"], ["post", "acme", "invalid"], ["inbox", "co", "invalid"], ["my-host", "test"], ["uni", "invalid"]])
        x = r.random()
        if x < 0.55:
            return r.choice([str, str, str, str.upper])(f"{local}@{'.'.join(labels)}")
        at = r.choice(["(at)", " (at) ", "[at]", " [at] ", "{at}", " <at> ", "&#64;", "%40", " @ "])
        if x < 0.85:
            return local + at + r.choice([".", " (dot) ", " [dot] ", "[.]", " [punkt] " if r.random() < 0.3 else "."]).join(labels)
        return f"{local.replace('.', ' dot ') if r.random() < 0.4 else local} at {' dot '.join(labels)}"

    def phone(self) -> str:
        d, r = self.digits, self.r
        us = f"{r.randint(2, 9)}{d(2)}"
        s = r.choice(" .-")
        return r.choice([
            f"({us}) {d(3)}-{d(4)}", f"{us}{s}{d(3)}{s}{d(4)}", f"+1 {us} {d(3)} {d(4)}", f"+1{us}{d(7)}", f"1-{us}-{d(3)}-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"+44 (0){r.randint(1, 9)}{d(3)} {d(3)} {d(3)}", f"0{r.randint(1, 9)}{d(3)} {d(6)}",
            f"+49 {r.randint(2, 9)}{d(1)} {d(6)}", f"+49 {r.randint(2, 9)}{d(2)} {d(5)}-{d(2)}", f"0{r.randint(1, 9)}{d(2)}/{d(6)}", f"0{r.randint(1, 9)}{d(1)} {d(5)} {d(3)}", f"00{r.randint(30, 49)} {r.randint(2, 9)}{d(1)} {d(7)}", f"00{r.randint(30, 49)}{r.randint(2, 9)}{d(8)}",
            f"0{r.randint(1, 9)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"+33.{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"(0{r.randint(2, 9)}{d(1)}) {d(6)}", f"0{r.randint(1, 9)}{d(2)} {d(8)}",
        ])

    def id(self, form: str) -> str:
        d, r = self.digits, self.r
        a = lambda n: "".join(r.choice("ABCDEFGHKLMNPRSTXYZ") for _ in range(n))
        return r.choice({
            "ssn": [f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)], "passport": [f"{a(2)}{d(7)}", f"{a(1)}{d(8)}", f"{a(2)} {d(3)} {d(4)}", f"{a(1)}{d(1)}{a(1)}{d(6)}", d(9)],
            "tax": [d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(3)}/{d(5)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(2)}-{d(7)}"], "dni": [f"{d(8)}{a(1)}", f"{d(8)}-{a(1)}", f"{d(2)}.{d(3)}.{d(3)}-{a(1)}", f"X{d(7)}{a(1)}"],
            "nir": [f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('12')}{d(14)}"], "nino": [f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", f"{a(2)}{d(6)}{a(1)}"],
        }[form])

    def address(self) -> str:
        r, w = self.r, self.r.choice("Oak Cedar Linden River Castle Garden Harbour Mill Victoria Ahorn Linden Garten Mozart Schul Lilas Jardins Moulins Gambetta Olivos Cervantes Molino Sol".split())
        n = f"{r.randint(1, 999)}{r.choice(['', '', '', 'a', 'B'])}"
        en = f"{n} {r.choice(['', '', 'North ', 'Old ', 'W. '])}{w} {r.choice('Street St. Road Rd Avenue Ave. Lane Drive Court Boulevard Way Place Square Terrace Close'.split())}"
        fr = f"{r.randint(1, 99)}{r.choice(['', '', ' bis', ' ter'])}{r.choice([' ', ', '])}{r.choice('rue avenue boulevard allée chemin place impasse quai'.split())} {r.choice(['', 'de la ', 'des ', 'du ', 'de '])}{w}"
        es = f"{r.choice(['Calle', 'calle', 'Avenida', 'Avda.', 'Plaza', 'Paseo', 'C/'])} {r.choice(['', 'de ', 'del ', 'de la '])}{w}{r.choice([' ', ', ', ', nº '])}{r.randint(1, 99)}"
        de = f"{r.choice([w + x for x in ('straße', 'strasse', 'weg', 'platz', 'gasse', 'allee', 'ring', 'ufer', 'str.')] + ['Am ' + w + 'platz', 'An der ' + w + 'allee', w + '-Straße', 'Alte ' + w + 'gasse', 'Zum ' + w + 'hof'])} {r.randint(1, 199)}{r.choice(['', '', 'a', ' b'])}"
        return r.choice([en, fr, es, de])

    def line(self, frame: str) -> Line:
        text, spans = "", set()
        for i, part in enumerate(re.split(r"\{([a-z]+(?::[a-z]*)?)\}", frame)):
            if i % 2:
                kind, colon, form = part.partition(":")
                if kind in ("person", "ssn") and colon and not form:  # looks like one, is none
                    part = f"{self.pick(self.given)} {self.pick(self.family)}" if kind == "person" else self.id("ssn")
                elif kind in ("given", "family", "listed"):
                    part = self.pick(self.family if kind == "family" else self.given)
                    part += f" {self.pick(self.family)}" if kind == "listed" else ""
                elif kind == "digits":
                    part = self.digits(self.r.randint(6, 11))
                elif kind == "version":
                    part = ".".join(str(self.r.randint(0, 40)) for _ in range(3))
                else:
                    part = self.id(form) if kind == "id" else getattr(self, kind)()
                    spans.add((len(text), len(text) + len(part), "id_number" if kind == "id" else kind))
            text += part
        return text, spans


def _sample(seed: int, given: tuple, family: tuple, frames: str, none: str, each: int) -> list[Line]:
    m = _Maker(seed, given, family)
    return [m.line(f) for f in frames.strip("\n").split("\n") for _ in range(each)] + [m.line(f) for f in none.strip("\n").split("\n") for _ in range(each if "{" in f else 2)]


def training() -> list[Line]:
    """Lines to fit on, with their spans (start, end, kind)."""
    return _sample(11, (_TRAIN_GIVEN, _MORE_GIVEN), (_TRAIN_FAMILY, _MORE_FAMILY), TRAIN, TRAIN_NONE, SAMPLE)


def held_out() -> list[Line]:
    """Lines to measure on: other frames, other names, HELD_NAMES as the list."""
    return _sample(29, _HELD_GIVEN, _HELD_FAMILY, HELD, HELD_NONE, SAMPLE)
