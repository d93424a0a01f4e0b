"""What personal details look like: words and patterns that the model of pii sees as features, and made examples.

Nothing here decides: patterns mark tokens for the model, words give it
classes, and examples with invented names, numbers and addresses in random
surroundings teach it what is common to all of them.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Sequence

KINDS = ("email", "phone", "id_number", "address", "name")

# Classes of words, in lower case, of several languages.
LEXICON = {
    "given": """
        james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew nancy anthony betty mark
        sandra paul emily steven anna andrew emma george laura peter alice henry julia oliver sophie jack olivia liam noah ethan grace
        hans peter wolfgang klaus jürgen stefan andreas markus tobias sabine petra monika ursula ingrid anja katrin lukas felix jonas lena
        jean pierre michel philippe marie nathalie isabelle françois camille chloé léa louis hugo
        jose antonio juan carlos maria carmen ana isabel lucia pablo javier mateo sofia elena
        giovanni giuseppe francesco marco giulia chiara joão pedro ana beatriz
        lars erik anders johan astrid ingrid sven nils mikko aino
        ivan dmitri olga natalia piotr katarzyna tomasz zofia jan eva
        mohammed ahmed fatima omar yusuf aisha ali hassan noor priya rahul anjali arjun wei ming hiroshi kenji yuki minh
    """,
    "street": """
        street st avenue ave road rd lane ln boulevard blvd court ct crescent cres close mews terrace ter drive dr way place pl square sq row hill gardens grove park alley highway hwy parkway
        straße strasse str gasse platz weg allee ring damm ufer
        rue avenue allée chemin boulevard bd impasse quai cours route passage
        calle avda avenida av plaza pza paseo camino ronda travesía via viale piazza corso rua praça ulica ul
        straat laan gracht plein gata gatan vägen vej gade katu
    """,
    "unit": "apt apartment unit suite ste flat floor fl room rm wohnung etage stock appartement appt étage piso puerta interno bis ter po box",
    "call": "tel tél tlf telephone phone mobile cell call fax sms text ring telefon handy mobil anrufen rufnummer téléphone portable appeler teléfono móvil llamar telefono cellulare telefone ext extension durchwahl poste x",
    "register": """
        ssn social security sozialversicherung sozialversicherungsnummer insurance national ni nino nin passport reisepass pasaporte passeport passaporto identity identification id ids
        dni nie nif cpf bsn pesel cnp curp tax steuer steuerid steueridentifikationsnummer personalausweis ausweis ausweisnummer insee sécurité sociale codice fiscale licence license
        number no nr num nummer numéro número numero n nº n°
    """,
    "mail": "at dot punkt point punto arroba mail email e-mail correo courriel mailto",
    "by": "by from with to cc thanks thank thx hi hello dear regards cheers author reviewer owner maintainer contact ask asked ping von an mit für danke fragen frag par à avec de merci demander por con gracias preguntar da di name",
    "title": "mr mrs ms dr prof sir herr frau monsieur madame mme m señor señora sr sra don doña signor signora",
    "part": "de da di del der den van von zu la le du dos el al bin ibn y",
}
# Plain words of English, German, French and Spanish, whatever a collection uses.
PLAIN = frozenset("""
    the a an and or but if then so not no yes do does did done is are was were be been has have had will would can could should may might must let
    i you he she it we they me him her us them my your his its our their this that these those who what when where why how which
    of in on at to for from by with about after before during into over under between without according because while until since
    all any each every some many more most other another new old first last next good bad great our own same such only just also very too here there now today yesterday tomorrow
    meet met meeting write wrote written say said says tell told ask asked speak spoke talk call called send sent give gave get got take took make made find found see saw know knew think thought believe want need
    work works worked use used review merge merged fix fixed fixes assign assigned report reported approve approved suggest suggested break broke pay paid wait join joined leave left live lives lived
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    photo picture note notes office team intern manager station street city bug test tests version file code
    der die das und oder nicht ist sind war wir sie er es mit von zu für auf bei nach
    le la les un une et ou pas est sont nous vous il elle avec pour dans sur de du des
    el los las y o no es son con por para en del al que
""".split())

_WORDS = {k: v.split() for k, v in LEXICON.items()}
#: The classes of a word, as a text.
CLASSES: dict[str, str] = {}
for _kind, _words in _WORDS.items():
    for _w in _words:
        CLASSES[_w] = CLASSES.get(_w, "") + _kind[0].upper() + _kind[1]
GIVEN = tuple(dict.fromkeys(_WORDS["given"]))
#: Endings that make a word one of a street.
STREET_END = re.compile(r".{2,}(?:straße|strasse|str|gasse|platz|weg|allee|damm|ufer|straat|laan|gracht|gatan|vägen|katu)$")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_TOWN_WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-ÿ'’]+"
_CITY = rf"{_TOWN_WORD}(?:[ -]{_TOWN_WORD})?"
# Words for streets and units, and titles of official numbers, by language.
_STREET_EN = r"Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Court|Ct|Crescent|Close|Mews|Terrace|Drive|Dr|Way|Place|Square|Row|Hill|Gardens|Grove|Park"
_STREET_DE = r"(?:straße|strasse|str\.|gasse|platz|weg|allee|ring|damm|ufer)"
_STREET_FR = r"rue|avenue|allée|chemin|boulevard|bd|impasse|place|quai|cours|route|passage|square"
_STREET_ES = r"Calle|C/|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía"
_UNIT = r"(?:,?[ \t](?:#[ ]?\w+|(?:Apt|Unit|Suite|Ste|Flat|Floor|Fl|Room)\.?[ ]\w+))?"
_AFTER = r"(?:,[ \t]*|[ \t]*\r?\n[ \t]*)"
_POSTCODE = r"(?:,?[ ][A-Z]{2}[ ]\d{5}|[ ][A-Z]{1,2}\d\w?[ ]\d[A-Z]{2}|[ ]\d{5})"
_EN_TOWN = rf"(?:,[ \t]*{_CITY}{_POSTCODE}?|{_AFTER}{_CITY}{_POSTCODE})?"
_CODE_TOWN = rf"(?:{_AFTER}\d{{4,5}}[ ]{_CITY})?"
_ADDRESS = re.compile(
    rf"(?<![\w.#/])(?:"
    rf"\d{{1,5}}\w?[ ](?:{_CAP}[ ]){{1,3}}(?:{_STREET_EN})\b(?:\.(?=,))?{_UNIT}{_EN_TOWN}"
    rf"|(?:\d{{4,5}}[ ]{_CITY},[ ])?[A-ZÄÖÜ][\wäöüß-]*{_STREET_DE}[ ]\d+[ ]?[a-z]?\b{_CODE_TOWN}"
    rf"|\d+(?:[ ](?:bis|ter|quater))?,?[ ](?:{_STREET_FR})[ ](?:(?:de[ ]la|de[ ]l['’]|du|des|de|d['’])[ ]?)?{_CAP}(?:[ ]{_CAP})*{_CODE_TOWN}"
    rf"|(?:{_STREET_ES})[ ](?:(?:de[ ]la|del|de[ ]las|de[ ]los|de)[ ])?{_CAP}(?:[ ]{_CAP})*,?[ ]\d+(?:,[ ]\d+º[ ]?[A-Z]?)?{_CODE_TOWN}"
    rf")"
)
_DOT = r"(?:\.|[ ]?[\[(][ ]?(?:dot|punkt|point|punto)[ ]?[\])][ ]?|[ ](?:dot|punkt)[ ])"
_AT = r"(?:@|[ ]?[\[(][ ]?(?:at|@)[ ]?[\])][ ]?)"
_EMAIL = re.compile(rf"(?<![\w@/.+-])[A-Za-z0-9](?:[\w.+-]*[\w+])?(?:{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}|[ ]at[ ][A-Za-z0-9-]+(?:(?:[ ]dot[ ]|\.)[A-Za-z0-9-]+)*[ ]dot[ ][A-Za-z]{{2,}})(?![\w:/])")
_NOT_EMAIL = re.compile(r"^git@|@\d+x\.|@\d+\.\d+|\.(?:png|jpe?g|svg|gif|webp|git)$", re.I)
_PHONE = re.compile(
    r"(?<![\w.+/#=-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\d[\d .()/-]{5,14}\d|\(\d{3}\)[ ]?\d{3}[-. ]\d{4}|(?:1[-. ])?\d{3}[-.]\d{3}[-.]\d{4}|\(?0\d{2,4}\)?[ /]\d{3,4}[ ]?\d{2,4}(?:[ ]?\d{2,3})?|0\d{2}[ /]\d{5,8}|0\d(?:[ .]\d{2}){4}|00\d{2}[ ]\d(?:[ ]\d{2}){4}|0\d{4}[ ]\d{6})"
    r"(?:,?[ ](?:ext\.?|x|extension|Durchwahl|poste)[ ]?\d{1,6})?(?![\w/-]|\.\d)"
)
_ID_TITLE = r"(?:SSN|social security(?: number)?|NI number|NINO|national insurance(?: no\.?| number)?|passport(?: number| no\.?)?|Reisepass(?:nummer)?|pasaporte|passeport|DNI|NIE|NIF|tax id|Steuer-?ID|Steueridentifikationsnummer|Personalausweis(?:nummer)?|INSEE|numéro de sécurité sociale)"
_ID = re.compile(
    rf"(?<![\w.#/=-])(?:\d{{3}}[- ]\d{{2}}[- ]\d{{4}}|[A-Z]{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?[A-D]|\d{{8}}-?[A-Z]|[XYZ]-?\d{{7}}-?[A-Z]|(?i:(?<=[ ])(?<!\bAT-))[A-Z]{{1,2}}\d{{6,8}}|\d{{2}}[ ]\d{{3}}[ ]\d{{3}}[ ]\d{{3}}|\d{{11}})(?![\w-]|\.\d)"
)
_ID_CUE = re.compile(rf"(?i:\b{_ID_TITLE})(?:[ ]?(?:#|nº|no\.|n°|:|number))*(?:[ ](?:is|ist|es|est|lautet))?[ :]*$")

ANY = r"[^\W\d_][^\W\d_'’]*(?:[-'’][^\W\d_]+)*"
INITIAL = r"[^\W\d_]\."
NAME = rf"(?:{ANY},[ ]{ANY}(?:[ ]{INITIAL})?|(?:{ANY}|{INITIAL})(?:[ ]{INITIAL})?[ ]{ANY})"
# Names in places that say so in any collection: trailers of commits, words for "by", titles, fields of records, and before a mail address.
_CUED = (
    re.compile(rf"(?:\b[A-Za-z]+-by:|\b(?i:cc|by|thanks|from|author|maintainer|Mr|Mrs|Ms|Dr|Herr|Frau|Mme|von|par|por)[.:]?)[ ]({NAME})(?=[\s.,;:!?<\"')]|$)"),
    re.compile(rf"[\"'](?:name|author|owner|user)[\"']:[ ]?[\"']({NAME})[\"']"),
    re.compile(rf"({NAME})(?=[ ]<[^<>\s@]+@[^<>\s]+>)"),
)


class Spans:
    """Spans of a text that don't overlap, in order."""

    def __init__(self, spans: Sequence[tuple[int, int, int]] = ()) -> None:
        self.all = sorted(spans)

    def meeting(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """The spans that share a character with a to b."""
        i = bisect_left(self.all, (a,))
        if i and self.all[i - 1][1] > a:
            i -= 1
        j = i
        while j < len(self.all) and self.all[j][0] < b:
            j += 1
        return self.all[i:j]

    def add(self, a: int, b: int, kind: int) -> bool:
        """Add a span if it meets no other."""
        if a < b and not self.meeting(a, b):
            insort(self.all, (a, b, kind))
            return True
        return False


def labelled_patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what looks like a mail address, number or street address; they don't overlap, earlier kinds go first."""
    found = Spans()
    if "@" in text or "at" in text:
        for m in _EMAIL.finditer(text):
            if not _NOT_EMAIL.search(m.group()):
                found.add(m.start(), m.end(), 0)
    for m in _ADDRESS.finditer(text):
        found.add(m.start(), m.end(), 3)
    for m in _ID.finditer(text):
        if _ID_CUE.search(text[max(0, m.start() - 60) : m.start()]) or re.fullmatch(r"\d{3}-\d{2}-\d{4}", m.group()):
            found.add(m.start(), m.end(), 2)
    for m in _PHONE.finditer(text):
        found.add(m.start(), m.end(), 1)
    return found.all


def cued_names(text: str) -> list[tuple[int, int]]:
    """Names in places that say so; most are, not all."""
    return [m.span(1) for p in _CUED for m in p.finditer(text)]


# --- made examples


class Maker:
    """Invents details. Words are random syllables, numbers random digits in random groups."""

    def __init__(self, seed: int = 0) -> None:
        self.rng = random.Random(seed)

    def word(self, least: int = 2, most: int = 4) -> str:
        r = self.rng
        starts = "b c d f g h j k l m n p r s t v w y z br ch dr fr gr kr pr sch sh sk st th tr ł ñ".split()
        middles = "a e i o u a e i o u aa ae ai ee ei ia ie io oo ou ue y ä ö ü é è á í ó å ø".split()
        ends = ["", "", "", *"l m n r s t k d ck ll nn rd rk rn ss st tz x z w".split()]
        out = "".join(r.choice(starts) + r.choice(middles) + (r.choice(ends) if r.random() < 0.4 else "") for _ in range(r.randint(least, most)))
        return (out if r.random() < 0.9 else r.choice("aeiou") + out).capitalize()

    def name(self) -> str:
        r = self.rng
        given = r.choice(GIVEN).capitalize() if r.random() < 0.35 else self.word(1, 3)
        if r.random() < 0.06:
            given += "-" + r.choice([self.word(1, 2), self.word(1, 2).lower()])
        family = self.word(1, 4)
        if r.random() < 0.25:
            family += r.choice("son sen ez ski ov ova man berg ton ini escu ic ian idis".split())
        if r.random() < 0.12:
            family += "-" + self.word()
        elif r.random() < 0.04:
            family = r.choice(["O'", "D'", "Mc"]) + family
        form = r.random()
        initial = r.choice("ABCDEFGHIJKLMNOPRSTVW") + "."
        out = f"{given} {family}" if form < 0.62 else f"{given} {initial} {family}" if form < 0.72 else f"{initial} {family}" if form < 0.84 else f"{family}, {given}" if form < 0.96 else f"{family}, {given} {initial}"
        case = r.random()
        return out.lower() if case < 0.07 else out.upper() if case < 0.12 else out

    def once_more(self, name: str) -> str:
        """A name as it may stand a second time: the same, in other letter case, with an initial, or spelt a little differently."""
        r = self.rng
        form = r.random()
        if form < 0.5 or "," in name:
            return name
        first, *rest = name.split(" ")
        if form < 0.65 and len(first) > 2:
            return " ".join([f"{first[0]}.", *rest[-1:]])
        if form < 0.8:
            return name.lower() if r.random() < 0.5 else name.upper()
        return " ".join([first, *rest[:-1], rest[-1] + r.choice(["e", "s", "n", "-" + self.word(1, 2)])])

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def groups(self, least: int, most: int, separators: Sequence[str]) -> str:
        r = self.rng
        s = r.choice(separators)
        return s.join(self.digits(r.choice((2, 2, 3, 3, 4, 4))) for _ in range(r.randint(least, most)))

    def phone(self) -> str:
        r = self.rng
        form = r.random()
        code = r.choice(["", "", f"+{self.digits(r.choice((1, 2, 2, 3)))}", f"00 {self.digits(2)}", f"+{self.digits(2)}"])
        if form < 0.3:
            rest = f"({self.digits(r.choice((2, 3, 3, 4)))}){r.choice(['', ' ', '-'])}{self.groups(2, 2, ' -.')}"
        elif form < 0.5:
            rest = f"0{self.digits(r.choice((2, 3, 4)))}{r.choice(' /-')}{self.digits(r.randint(5, 8))}"
        elif form < 0.6 and code:
            return code.replace(" ", "") + self.digits(r.randint(8, 11))
        else:
            rest = self.groups(3, 5, ["-", ".", " ", " "])
        out = f"{code}{r.choice([' ', ' ', '-', '.']) if code else ''}{rest}"
        if r.random() < 0.15:
            out += f"{r.choice([',', ''])} {r.choice(['ext.', 'ext', 'x', 'extension', 'Durchwahl', 'poste'])} {self.digits(r.randint(2, 4))}"
        return out

    def title(self) -> str:
        r = self.rng
        if r.random() < 0.6:
            first = r.choice(["SSN", "social security", "social security number", "NI number", "NINO", "national insurance", "passport", "passport number", "Reisepass", "Reisepassnummer", "pasaporte", "passeport", "DNI", "NIE", "NIF", "tax id", "Steuer-ID", "Personalausweis", "INSEE", "identity card", "driving licence", "codice fiscale"])
        else:
            first = "".join(r.choice("ABCDEFGHIKLMNOPRSTUV") for _ in range(r.randint(3, 5)))
        return first + r.choice(["", "", ":", " is", " number", " no.", " nr.", " nº", " #", " ist", " es"]) + " "

    def register(self) -> str:
        r = self.rng
        letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTXYZ") for _ in range(n))
        return r.choice([
            lambda: f"{self.digits(3)}{(s := r.choice('- '))}{self.digits(2)}{s}{self.digits(4)}",
            lambda: f"{letters(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)} {letters(1)}",
            lambda: f"{letters(2)}{self.digits(6)}{letters(1)}",
            lambda: f"{self.digits(8)}{r.choice(['-', ''])}{letters(1)}",
            lambda: f"{letters(r.randint(1, 3))}{self.digits(r.randint(6, 9))}",
            lambda: f"{letters(1)}-{self.digits(7)}-{letters(1)}",
            lambda: self.digits(r.randint(8, 13)),
            lambda: f"{self.groups(3, 4, '. -')}{r.choice(['', '-' + self.digits(2), '/' + self.digits(2), ' ' + letters(1)])}",
        ])()

    def email(self) -> str:
        r = self.rng
        a, b = self.word(1, 3).lower(), self.word(1, 4).lower()
        local = r.choice([f"{a}.{b}", f"{a}", f"{a[0]}{b}", f"{b}_{self.digits(2)}", f"{a}-{b}", f"{a}+{b}", f"{a}.{b}.{self.digits(1)}", f"{a}{self.digits(2)}", f"{a.capitalize()}.{b.capitalize()}"])
        local = re.sub(r"[^a-zA-Z0-9._+-]", "e", local)
        host = [re.sub(r"[^a-z0-9]", "o", self.word(1, 3).lower()) for _ in range(r.choice((1, 1, 1, 2)))] + [r.choice("com org net de fr es io eu test example invalid co".split())]
        at, dot = r.choice([("@", ".")] * 10 + [("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), (" {at} ", " {dot} "), ("(at)", "(dot)"), (" at ", " punkt "), ("@", " [dot] "), (" arroba ", " punto ")])
        out = local + at + dot.join(host)
        return out.upper() if r.random() < 0.04 else out

    def address(self) -> str:
        r = self.rng
        base = " ".join(self.word(1, 3) for _ in range(r.choice((1, 1, 1, 2))))
        town = self.word(2, 3) + (" " + self.word(1, 2) if r.random() < 0.15 else "")
        n = f"{r.randint(1, 2999) if r.random() < 0.5 else r.randint(1, 200)}{r.choice(['', '', '', 'a', 'b'])}"
        code = self.digits(r.choice((4, 5, 5, 5)))
        sep = r.choice([", ", ", ", ", ", "\n", ",\n"])
        form = r.random()
        if form < 0.38:
            street = f"{n} {base} {r.choice('Street St Avenue Ave Road Rd Lane Boulevard Blvd Court Crescent Close Mews Terrace Drive Way Place Square Row Hill Gardens Grove Park'.split())}"
            unit = r.choice(["", "", ", ", " "])
            street += f"{unit}{r.choice(['Apt', 'Unit', 'Suite', 'Flat', 'Floor', '#', 'Apt.'])} {r.randint(1, 99)}{r.choice(['', 'B'])}" if unit else ""
            tail = r.choice(["", "", f"{sep}{town}", f"{sep}{town}, {self.word(1, 1)[:2].upper()} {code}", f"{sep}{town} {self.word(1, 1)[:2].upper()}{r.randint(1, 9)} {r.randint(1, 9)}{self.word(1, 1)[:2].upper()}", f"{sep}{town} {code}"])
            return street + tail
        tail = r.choice(["", f"{sep}{code} {town}", f"{sep}{code} {town}", f"{sep}{code[:2]}-{code[2:]} {town}"])
        if form < 0.6:
            street = f"{base.replace(' ', '-')}{r.choice(['straße', 'strasse', 'str.', 'gasse', 'platz', 'weg', 'allee', 'damm', 'straat', 'laan', 'gatan'])} {n}"
            return f"{code} {town}, {street}" if r.random() < 0.12 else street + tail
        if form < 0.8:
            street = f"{n}{r.choice(['', ' bis', ' ter', ','])}{r.choice(['', ','])} {r.choice('rue avenue allée chemin boulevard impasse place quai cours route'.split())} {r.choice(['', '', 'de la ', 'du ', 'des ', 'de '])}{base}".replace(",,", ",")
            return street + tail
        street = f"{r.choice(['Calle', 'C/', 'Avda.', 'Avenida', 'Plaza', 'Paseo', 'Camino', 'Via', 'Viale', 'Piazza', 'Corso', 'Rua', 'ul.'])} {r.choice(['', '', 'de la ', 'del ', 'de las '])}{base}{r.choice([' ', ', '])}{n}"
        if r.random() < 0.35:
            street += f", {r.randint(1, 9)}º {r.choice('ABCDE')}"
        return street + tail

    def detail(self, kind: int) -> str:
        return (self.email, self.phone, self.register, self.address, self.name)[kind]()

    def example(self, lines: Sequence[str], words: Sequence[str]) -> tuple[str, list[tuple[int, int, int]]]:
        """A text of lines of the corpus, with details put in at random places after random words."""
        r = self.rng
        out, marks = "", []
        again: list[str] = []
        for _ in range(r.randint(1, 4)):
            line = r.choice(lines) if lines else ""
            pieces = line.split(" ")
            cut = r.randint(0, len(pieces)) if r.random() < 0.5 else r.choice((0, len(pieces)))
            left, right = " ".join(pieces[:cut]), " ".join(pieces[cut:])
            kind = r.choice((0, 1, 2, 3, 4, 4, 4, 4))
            cue = " ".join(r.choice(words) if words and r.random() < 0.6 else self.word(1, 3).lower() for _ in range(r.choice((0, 1, 1, 2, 3))))
            if kind == 1 and r.random() < 0.5:
                cue = r.choice(_WORDS["call"])
            elif kind == 4 and r.random() < 0.3:
                cue = r.choice(_WORDS["by"] + _WORDS["title"])
            if r.random() < 0.3:
                cue = cue.capitalize()
            cue += ": " if cue and r.random() < 0.3 else " " if cue else ""
            if kind == 2:
                cue = r.choice(["", "", "my ", "mein ", "mi "]) + self.title()
            if left and not left.endswith(tuple(".!?:")) and r.random() < 0.2:
                left += r.choice([".", ":", "!", ","])
            value = again.pop() if kind == 4 and again and r.random() < 0.8 else self.detail(kind)
            if kind == 4 and r.random() < 0.3:
                again.append(self.once_more(value))
            quote = r.choice([("", "")] * 8 + [("(", ")"), ('"', '"'), ("<", ">")])
            out += f"{left}{' ' if left else ''}{cue}{quote[0]}"
            marks.append((len(out), len(out) + len(value), kind))
            more = r.random()
            end = ""
            if kind == 4 and more < 0.15:
                mail = self.email()
                marks.append((len(out) + len(value) + 2, len(out) + len(value) + 2 + len(mail), 0))
                end = f" <{mail}>"
            if not end and not quote[1] and r.random() < 0.35:  # plain words after it
                end = " " + " ".join(r.choice(words) if words and r.random() < 0.5 else self.word(1, 3).lower() for _ in range(r.randint(1, 3)))
            out += value + quote[1] + end + r.choice(["", "", ".", ",", "!", ";", "?"]) + (" " + right if right else "")
            out += r.choice(["\n", "\n", " ", "\r\n"])
            if r.random() < 0.25:  # numbers and capitals that are no details
                number = r.choice([lambda: self.digits(r.randint(3, 12)), lambda: f"{r.randint(0, 40)}.{r.randint(0, 99)}.{r.randint(0, 99)}", lambda: f"20{self.digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", lambda: f"{r.randint(10, 23)}:{self.digits(2)}", lambda: f"#{self.digits(4)}", lambda: f"0x{self.digits(6)}"])()
                out += f"{r.choice(words) if words else 'at'} {number} {r.choice(words) if words else 'on'}\n"
        return out, marks
