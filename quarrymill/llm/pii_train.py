"""Trains the weights of quarrymill.llm.pii: python -m quarrymill.llm.pii_train OUT.npz [MINUTES]

No text or word of the project's tables takes part. Labelled windows are generated: mentions come from public lists of
names, public formats of numbers and rules for addresses and mail; family names, roads and towns are mostly random
syllables, so that the model learns shapes and surroundings instead of a vocabulary. Around them stand short cues,
words drawn from a public tokenizer's vocabulary and prose of Python's language reference, without mentions. Numbers,
handles, titles of things and places that are no mentions are generated likewise. Training is plain numpy:
backpropagation through time for both directions, forward-backward for the CRF, Adam.
"""

from __future__ import annotations

import base64
import random
import re
import sys
import time

import numpy as np

from quarrymill.llm.encoding import TOKENIZERS
from quarrymill.llm.pii import CODES, KINDS, LABELS, PAD, codes

HIDDEN = 28
LENGTH = 128
BATCH = 128
SEED = 11

# The most popular given names of the last hundred years in the public statistics of the United States.
GIVEN = """james michael robert john david william richard joseph thomas christopher charles daniel matthew anthony mark donald steven andrew paul
joshua kenneth kevin brian timothy ronald george jason edward jeffrey ryan jacob nicholas gary eric jonathan stephen larry justin scott brandon
benjamin samuel gregory alexander patrick frank raymond jack dennis jerry tyler aaron jose adam nathan henry zachary douglas peter kyle noah
ethan jeremy christian walter keith austin roger terry sean gerald carl dylan harold jordan jesse bryan lawrence arthur gabriel bruce logan
billy joe alan juan elijah willie albert wayne randy mason vincent liam roy bobby caleb bradley russell lucas
mary patricia jennifer linda elizabeth barbara susan jessica karen sarah lisa nancy sandra betty ashley emily kimberly margaret donna michelle
carol amanda melissa deborah stephanie rebecca sharon laura cynthia dorothy amy kathleen angela shirley emma brenda pamela nicole anna samantha
katherine christine debra rachel carolyn janet maria olivia heather helen catherine diane julie victoria joyce lauren kelly christina ruth joan
virginia judith evelyn hannah andrea megan cheryl jacqueline madison teresa abigail sophia martha sara gloria janice kathryn ann isabella judy
charlotte julia grace amber alice jean denise frances danielle marilyn natalie beverly diana brittany theresa kayla alexis doris lori tiffany""".split()
# Frequent given names of other countries' public statistics.
ABROAD = """hans stefan ursula klaus sabine jürgen monika dieter petra lukas lena felix marie pierre sophie luc camille antoine céline carlos
carmen javier lucia miguel elena giovanni giulia marco francesca chiara paolo ivan olga dmitry natalia sergei tatiana piotr agnieszka jan
katarzyna lars ingrid erik astrid mohamed fatima ahmed aisha omar layla raj priya amit wei mei hiroshi yuki minh kofi amara chidi zanele
diego ravi noor yusuf elif""".split()
# Further frequent given names of the statistics of the United States, the United Kingdom and other countries.
GIVEN += """eugene ralph louis philip johnny harry howard fred ernest craig stanley leonard manuel rodney curtis norman marvin glenn travis melvin
alfred francis herbert frederick joel edwin eddie ricky troy randall barry bernard leroy oscar clifford theodore jay jim tom mike bill dan greg steve
dave ben sam matt nick chris alex oliver charlie archie freddie theo alfie harrison finley isaac max toby jamie ewan callum rhys graham trevor clive
ian neil stuart gordon duncan malcolm colin derek ellen elaine marjorie thelma esther pauline juanita anita rhonda hazel eva debbie april leslie clara
lucille joanne eleanor valerie alicia suzanne michele gail bertha darlene veronica jill erin geraldine cathy lorraine lynn sally regina erica beatrice
dolores bernice audrey yvonne annette june marion dana stacy ana renee ida vivian roberta holly melanie loretta yolanda jeanette laurie katie kristen
vanessa alma sue elsie beth jeanne kate poppy ella isla freya daisy phoebe ruby lily millie rosie imogen harriet gemma fiona gillian lorna moira""".split()
ABROAD += """anton boris vladimir igor svetlana irina anastasia pavel jana zuzana istvan zoltan katalin gabor ioana andrei cristina nikos dimitris
eleni giorgos stavros mustafa mehmet ayse fatma hassan ali hussein leila khadija ibrahim tariq samir nadia sanjay rahul anil sunita deepak anjali arjun
kavita jing xiao hui jun takashi kenji haruka sakura akira thanh linh budi siti agus emeka ngozi kwame abena thabo sipho lerato tendai bjorn sven anders
karin birgit jorge pablo rosa teresa pilar manuela paulo ricardo beatriz henrique mateo valentina luca alessandro federica giorgia jules hugo manon
chloé mathieu sylvie günter wolfgang heike anke joao ines""".split()
# Frequent family names of public statistics of several countries.
FAMILY = """smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez wilson anderson taylor moore jackson
martin lee thompson white harris clark lewis robinson walker young allen king wright scott torres nguyen hill flores adams nelson baker hall
müller schmidt schneider fischer weber meyer wagner becker hoffmann dubois durand lefebvre moreau rossi russo ferrari bianchi silva santos
ivanov petrov smirnova kowalski nowak novak hansen nielsen johansson virtanen khan patel singh kumar chen wang zhang tanaka suzuki kim park
o'brien murphy o'connor macdonald fitzgerald van-dijk de-vries papadopoulos popescu nagy yilmaz haddad okonkwo mensah dlamini""".split()
# Usual endings of family names in European languages.
ENDINGS = "sky ska ev uk ić es etti oni eau ier burg stein thal bach lund gren dahl nen ford wood worth land ridge ell ius escu yan ian idis oglu".split()
NAMES = {g.capitalize() for g in GIVEN + ABROAD}  # all of the lists above
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Sir".split()
# Kinds of streets and of units.
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Close Terrace Way Place Square Row Crescent Walk Alley Parkway Circle Trail Loop".split()
GERMAN = "straße strasse weg gasse platz allee ring damm ufer".split()
ROMANCE = "rue|avenue|boulevard|chemin|allée|quai|impasse|via|viale|piazza|calle|avenida|plaza|paseo|rua|travessa".split("|")
UNITS = "Flat Unit Apt Apartment Suite Room".split()
# Short cues that may stand before or after a mention of each kind.
BEFORE = {
    "name": "|||by|from|with|to|ask|tell|met|dear|hi|called|named|hired|and|signed|for|saw|said|yours,\n|regards,\n|best,\n|name:|author:|contact:|attn|cc|this is|my friend|our boss|her name is".split("|"),
    "email": "|||mail|email|e-mail|contact|at|to|send it to|reply to|mail:|email:|via|address:|or|from".split("|"),
    "phone": "|||call|phone|tel|tel.|phone:|tel:|mobile|cell|fax|text|ring|dial|on|at|number|number:|whatsapp|line".split("|"),
    "id_number": "ssn|ssn:|social security|social security no.|national insurance|ni number|nino|passport|passport nr|passport:|licence|license|driver license number|licence nr|id|id:|id number|my id is|".split("|"),
    "address": "|||at|living at|address|address:|addr|of|to|from|near|in|deliver to|ship to|home:|visit".split("|"),
}
AFTER = {
    "name": "|||said|says|is|was|wrote|and|who|agreed|called|at|from|,|.|!|?|:|)|'s|;".split("|"),
    "email": "|||for|about|please|if|.|,|!|?|)|;|thanks|or".split("|"),
    "phone": "|||for|after|if|please|.|,|!|)|;|anytime|or|only|ext".split("|"),
    "id_number": "|||was|is|got|on|.|,|)|;|which|printed|and".split("|"),
    "address": "|||and|is|was|.|,|!|)|;|near|at|with|today|please".split("|"),
}
# Cues of numbers that are no mentions.
NUMBERED = "order|order no.|order number|part|part no|book|isbn|isbn:|version|v|item|sku|invoice|invoice no.|ticket|tracking|model|serial|build|release|case|batch|room|page|chapter|line|bus|flight|gate|lot|score|error".split("|")
FUNCTION = "the a an of to in on at for with and or but from by my your his her our their this that it is was were has had not no when after before until if so as than then while because who which how why where there here he she we they you".split()
MEASURES = "days hours coins dollars points percent km miles people shops replies parts minutes times votes pages items".split()
THINGS = "Park Bridge Station River Lake Museum Castle Valley County University Games Kart Quest Theory Cup League Press Hotel Island Mountain Airlines Bank City Team Club".split()


class Prose:
    """Words of a public vocabulary, and sentences of Python's language reference without digits and at signs."""

    def __init__(self, r: random.Random, vocabulary: str):
        words = []
        with open(vocabulary, encoding="ascii") as f:
            for line in f:
                w = base64.b64decode(line.split()[0])
                if re.fullmatch(rb" [a-z]{2,12}", w):
                    words.append(w[1:].decode())
        self.words = words
        from pydoc_data import topics

        self.lines = [x for x in re.split(r"(?<=[.:])\s+|\n\n+", "\n".join(topics.topics.values())) if len(x) > 20 and not re.search(r"[@\d]|[A-Z]\w* [A-Z]", x)]
        self.r = r

    def word(self) -> str:
        return self.r.choice(self.words[: self.r.choice((300, 3000, len(self.words)))])

    def text(self) -> str:
        """A stretch without mentions."""
        r = self.r
        if r.random() < 0.2:
            return r.choice(self.lines)
        w = [r.choice(FUNCTION) if r.random() < 0.42 else self.word() for _ in range(r.randint(3, 16))]
        for k in range(len(w)):
            x = r.random()
            if x < 0.10:
                w[k] = syllables(r).capitalize()
            elif x < 0.15:
                w[k] = syllables(r)
            elif x < 0.17:
                w[k] = "I"
            elif x < 0.20:
                w[k] += r.choice(",,,;:")
            elif x < 0.22:
                w[k] = str(r.randint(1, 400))
            elif x < 0.235:
                w[k] = given(r).lower() if r.random() < 0.3 else given(r)
        for k in range(len(w) - 1):
            if w[k] in NAMES and w[k + 1] != "I":  # a given name and a capital would be a name
                w[k + 1] = w[k + 1].lower()
        s = " ".join(w)
        s = s.upper() if r.random() < 0.03 else s
        return (s[0].upper() + s[1:] if r.random() < 0.75 else s) + (" " + symbols(r) if r.random() < 0.08 else "") + r.choice([".", ".", ".", "!", "?", "...", ""])


def symbols(r: random.Random) -> str:
    """A few pictographs, joiners and typographic characters."""
    return "".join(chr(r.choice((r.randint(0x1F300, 0x1FAFF), r.randint(0x2600, 0x27BF), 0x200D, 0xFE0F, 0x2026, 0x2014, 0x201C, 0x2019))) for _ in range(r.randint(1, 4)))


def syllables(r: random.Random, parts: tuple[int, ...] = (1, 2, 2, 2, 3)) -> str:
    """A random word of so many syllables."""
    onset = ["", "b", "br", "c", "ch", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "kl", "kr", "l", "m", "n", "p", "pl", "pr", "qu", "r", "s", "sh", "sk", "sl", "st", "t", "th", "tr", "v", "w", "y", "z"]
    coda = ["", "", "b", "ck", "d", "g", "l", "ll", "m", "n", "nd", "ng", "p", "r", "rn", "s", "sh", "st", "t", "th", "x"]
    while True:
        w = "".join(r.choice(onset) + r.choice(["a", "e", "i", "o", "u", "y", "ae", "ai", "ea", "ee", "io", "oo", "ou"]) + r.choice(coda) for _ in range(r.choice(parts)))
        if len(w) > 2:
            return w


def family(r: random.Random) -> str:
    k = r.random()
    w = r.choice(FAMILY) if k < 0.25 else re.sub(r"[aeiouy]+$", "", syllables(r, (1, 1, 2))) + r.choice(ENDINGS) if k < 0.7 else syllables(r)
    w = " ".join(p.capitalize() for p in w.replace("-", " ").split(" "))
    w = re.sub(r"'(\w)", lambda m: "'" + m.group(1).upper(), w)
    return w + "-" + syllables(r).capitalize() if r.random() < 0.03 else w


def given(r: random.Random) -> str:
    return r.choice(GIVEN if r.random() < 0.75 else ABROAD).capitalize()


def name(r: random.Random) -> tuple[str, int]:
    """The text of a name and how much of its beginning (a title) isn't part of the mention."""
    g, f, k = given(r), family(r), r.random()
    if k < 0.18:
        t = r.choice(TITLES) + r.choice([".", ".", "", ""]) + " "
        return t + (f if r.random() < 0.7 else f"{g} {f}"), len(t)
    if k < 0.28:
        return f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}{r.choice(['.', '.', ''])} {f}", 0
    if k < 0.32:
        return f"{g} {given(r)} {f}", 0
    if k < 0.39:
        return f"{f}, {g}", 0
    if k < 0.44:
        return f"{f.upper()} {g}" if r.random() < 0.5 else f"{g} {f.upper()}", 0
    if k < 0.47:  # other scripts: letters by class
        other = r.choice(["абвгдеиклмнопрст", "αβγδεικλμνοπρστ"])
        w = ["".join(r.choice(other) for _ in range(r.randint(3, 9))).capitalize() for _ in range(2)]
        return " ".join(w), 0
    if 0.56 <= k < 0.60:  # in lower case only a known given name tells a name
        return f"{given(r)} {f}".lower(), 0
    return (f"{g} {f}".upper() if k < 0.56 else f"{g} {f}"), 0


def domain(r: random.Random) -> str:
    return syllables(r) + r.choice(["", "", "", "-" + syllables(r), "." + syllables(r)]) + r.choice([".com", ".com", ".org", ".net", ".co.uk", ".de", ".io", ".edu", ".fr", ".info", ".test", ".example", ".invalid", "mail.com"])


def email(r: random.Random) -> str:
    a, b = r.choice([given(r), syllables(r)]), r.choice([family(r).replace(" ", "").replace("'", ""), syllables(r)])
    n = str(r.choice([r.randint(1, 9), r.randint(10, 99), r.randint(100, 9999)]))
    local = r.choice([f"{a}.{b}", f"{a[0]}.{b}", f"{a}_{b}", f"{a}{n}", f"{a}{b}{n}", f"{b}_{n}", f"{b}-{n}", f"{a}+{b}", f"{a}", f"{a}.{b}.{n}"])
    local, d, k = local.lower(), domain(r), r.random()
    if k < 0.28:
        at = r.choice([" at ", " [at] ", " (at) ", "(at)", "[at]", " AT ", " {at} "])
        dot = r.choice([" dot ", " [dot] ", " (dot) ", "(dot)", "."]) if at.strip() not in ("at", "AT") else r.choice([" dot ", " DOT "])
        return (local if r.random() < 0.85 else local.upper()) + at + d.replace(".", dot)
    whole = f"{local}@{d}"
    return whole.upper() if k < 0.36 else whole.title() if k < 0.40 else whole


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def phone(r: random.Random) -> str:
    sep = r.choice([" ", "-", ".", " ", "-"])
    k = r.random()
    if k < 0.45:  # North American numbers
        a, b, c = str(r.randint(2, 9)) + digits(r, 2), r.choice(["555", str(r.randint(2, 9)) + digits(r, 2)]), digits(r, 4)
        lead = r.choice(["", "", "", "+1 ", "1-", "+1-", "1 ", "+1", "001 "])
        return lead + r.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b} {c}", sep.join((a, b, c)), sep.join((a, b, c)), a + b + c])
    if k < 0.75:  # international: a country code and groups
        cc = str(r.choice([7, 20, 27, 30, 31, 32, 33, 34, 39, 41, 44, 45, 46, 47, 48, 49, 52, 55, 61, 64, 81, 82, 86, 90, 91, 351, 353, 358, 380, 420]))
        groups = r.choice([(2, 4, 4), (2, 8), (3, 7), (1, 2, 2, 2, 2), (4, 6), (4, 3, 3), (3, 3, 3), (2, 3, 4), (2, 5, 3), (2, 6), (3, 6), (10,), (9,), (2, 7)])
        return r.choice(["+", "+", "+", "00"]) + cc + r.choice([" ", " ", sep, " (0)"]) + sep.join(digits(r, g) for g in groups)
    groups = r.choice([(2, 4, 4), (4, 6), (4, 3, 3), (1, 2, 2, 2, 2), (3, 3, 4), (3, 4, 4), (2, 7), (3, 6), (4, 7)])  # with a trunk zero
    first = "0" + digits(r, groups[0])
    return (f"({first})" if r.random() < 0.15 else first) + sep + sep.join(digits(r, g) for g in groups[1:])


def id_number(r: random.Random) -> str:
    up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTWXYZQ") for _ in range(n))
    k = r.random()
    if k < 0.3:
        return r.choice(["-", "-", " "]).join((digits(r, 3), digits(r, 2), digits(r, 4)))
    if k < 0.6:
        pairs, a = [digits(r, 2) for _ in range(3)], r.choice([up(2), "QQ"])
        return r.choice([f"{a} {' '.join(pairs)} {r.choice('ABCD')}", f"{a}{''.join(pairs)}{r.choice('ABCD')}", f"{a} {''.join(pairs)} {r.choice('ABCD')}", f"{a}-{'-'.join(pairs)}-{r.choice('ABCD')}"])
    if k < 0.8:
        return up(r.choice((0, 1, 1, 2))) + digits(r, r.choice((7, 8, 8, 9)))
    return r.choice([f"{up(1)}{digits(r, 3)}-{digits(r, 4)}-{digits(r, 4)}", f"{up(2)}-{digits(r, 4)}-{digits(r, 5)}", f"{up(2)}-{digits(r, 6)}", f"{up(5)}{digits(r, 6)}{up(2)}{digits(r, 1)}{up(2)}", f"{up(1)}{digits(r, 12)}", f"{up(2)} {digits(r, 3)} {digits(r, 3)}"])


def road(r: random.Random, p: Prose) -> str:
    word = lambda: (p.word() if r.random() < 0.6 else syllables(r)).capitalize()
    return r.choice([word(), word(), f"{word()} {word()}", f"{word()}'s", f"{word()}{word().lower()}", f"{r.choice(['North', 'South', 'East', 'West', 'Old', 'New', 'Upper', 'N', 'W'])} {word()}"])


def address(r: random.Random, p: Prose) -> str:
    n, k = str(r.choice([r.randint(1, 40), r.randint(1, 250), r.randint(1, 9999)])) + r.choice(["", "", "", "", "", "a", "B"]), r.random()
    if k < 0.14:
        w = (p.word() if r.random() < 0.5 else syllables(r)).capitalize()
        return r.choice([f"{w}{r.choice(GERMAN)} {n}", f"{w}{r.choice(GERMAN)} {n}", f"{w}{r.choice(['', 'er'])} {r.choice(GERMAN).capitalize()} {n}", f"{w}str. {n}"])
    if k < 0.28:
        w = r.choice(["", "de la ", "des ", "du ", "de l'", "del ", "de ", "della ", "da "]) + (syllables(r) if r.random() < 0.6 else p.word()).capitalize()
        kind = r.choice(ROMANCE)
        return f"{n}{r.choice([' ', ', '])}{kind} {w}" if r.random() < 0.6 else f"{kind.capitalize()} {w}{r.choice([' ', ', '])}{n}"
    out = f"{n} {road(r, p)} {r.choice(STREETS)}" + r.choice(["", "", "", "."])
    if r.random() < 0.18:
        return f"{r.choice(UNITS)} {r.randint(1, 60)}{r.choice(['', 'A', 'c'])}, {out.rstrip('.')}"
    if r.random() < 0.16:
        return f"{out.rstrip('.')}, {r.choice(UNITS)} {r.randint(1, 60)}{r.choice(['', 'A', 'B'])}"
    if r.random() < 0.25:
        out = f"{out.rstrip('.')}, {syllables(r).capitalize()}" + r.choice(["", f" {digits(r, 5)}", f", {digits(r, 5)}"])
    return out.lower() if r.random() < 0.04 else out.upper() if r.random() < 0.04 else out


def decoy(r: random.Random, p: Prose) -> str:
    """What looks like a mention and is none."""
    cap = lambda: syllables(r).capitalize()
    noun = lambda: p.word().capitalize()
    n = r.choice([r.randint(1, 9), r.randint(10, 99), r.randint(100, 9999)])
    return r.choice(
        [
            lambda: f"{r.choice(NUMBERED)} {'-'.join(digits(r, r.randint(1, 6)) for _ in range(r.randint(1, 4)))}",
            lambda: f"{r.choice(NUMBERED)} {'-'.join(digits(r, r.randint(2, 6)) for _ in range(r.randint(2, 4)))}",
            lambda: f"isbn 97{r.choice('89')}-{digits(r, 1)}-{digits(r, 2)}-{digits(r, 6)}-{digits(r, 1)}",
            lambda: f"{r.choice(NUMBERED)} {r.choice('ABCXR')}{digits(r, r.randint(2, 6))}{r.choice(['', '-' + digits(r, 2)])}",
            lambda: f"{n} {r.choice(MEASURES)}",
            lambda: f"{n} {p.word()} {p.word()}",
            lambda: f"{n} {p.word()} {p.word()}{r.choice(',.;')} {noun()} {p.word()}",
            lambda: f"{n} {r.choice(FUNCTION)} {n + r.randint(1, 9)}",
            lambda: f"{p.word()} {n}, {p.word()} {r.randint(1, 30)}",
            lambda: f"{r.choice(FUNCTION)} {p.word()} {p.word()} {r.choice(FUNCTION)}",
            *[lambda: f"{r.choice(FUNCTION)} {p.word()} {p.word()}{r.choice(('.', ',', '?', '.NL', '.NLNL', 'NL')).replace('NL', chr(10))}"] * 4,
            *[lambda: f"{r.choice(FUNCTION).capitalize()} {p.word()} {p.word()} {p.word()} {r.choice(FUNCTION)}"] * 2,
            *[lambda: f"{r.choice(('from', 'in', 'to', 'of', 'at', 'near', 'about'))} {cap()}{r.choice(('.NL', '.NLNL', 'NL', '.', ' called', ' said')).replace('NL', chr(10))}"] * 2,
            lambda: f"{chr(10)}{noun()}{r.choice((',', '', ''))} {cap()} {r.choice(FUNCTION)} {cap()}",
            lambda: f"{chr(10)}{r.choice(FUNCTION).capitalize()} {cap()} {p.word()}",
            lambda: f"{p.word()} {p.word()}{r.choice(';,.')} {r.choice(FUNCTION)} {p.word()}",
            lambda: f"{r.choice(('from', 'in', 'to', 'of', 'at', 'near', 'about'))} {cap()}",
            lambda: f"{r.choice(('from', 'in', 'to', 'of', 'at', 'near', 'about'))} {cap()} {r.choice(FUNCTION)}",
            lambda: f"{cap()} {r.choice(FUNCTION)} {cap()}",
            lambda: f"{cap()}{r.choice(['ers', 'ish', 'ian', 's'])} {p.word()}",
            lambda: f"{r.choice(NUMBERED)}{r.choice(['', '.', ':', ' is', ' no.', ' number'])} {digits(r, 3)}-{digits(r, 2)}-{digits(r, r.choice((3, 4, 4, 5)))}",
            lambda: f"{r.choice(NUMBERED)} {''.join(r.choice('ABCDEFGHJKLMNPQRSTUVWXYZ') for _ in range(r.randint(1, 3)))}{digits(r, r.randint(2, 5))}{r.choice('ABXZ')}",
            lambda: f"{p.word()}, {p.word()} {symbols(r)} {noun()} {p.word()}",
            lambda: f"{symbols(r)} {noun()}",
            lambda: r.choice(". - _ * ".split(" ")[:2] + [" "]).join(p.word()),
            lambda: ".".join(p.word()) + f" {r.choice(FUNCTION)}",
            lambda: p.word().translate(str.maketrans("aeios", "4310$" if r.random() < 0.5 else "@310s")),
            lambda: f"{r.choice(FUNCTION)} {p.word()}-{r.choice(FUNCTION)}-{p.word()}",
            lambda: f"{r.choice(FUNCTION)} {p.word()} {p.word()} {r.choice(('called', 'said', 'wants', 'agreed', 'wrote', 'told'))} {r.choice(FUNCTION)}",
            lambda: f"{r.choice(FUNCTION)} {p.word()}-{p.word()} {r.choice(('called', 'said', 'wants', 'agreed', 'wrote', 'told'))}",
            lambda: f"{p.word()} from {cap()} {r.choice(('called', 'said', 'wants', 'agreed', 'wrote', 'told', 'has'))} {r.choice(FUNCTION)}",
            lambda: f"{r.choice(FUNCTION).capitalize()} {cap()} {r.choice(FUNCTION)} {cap()}",
            lambda: f"{p.word()} {p.word()}, {r.choice(FUNCTION)}{r.choice('?!.')}",
            lambda: f"{p.word()} {n} {p.word()}{r.choice('.!?;')}",
            lambda: f"{cap()} {n}{r.choice(' .,;')}",
            lambda: f"{r.choice(FUNCTION).upper()} {p.word().upper()} {p.word().upper()} {r.choice(FUNCTION).upper()} {p.word().upper()}",
            lambda: f"{given(r)} {r.choice(FUNCTION)} {cap()}",
            lambda: f"{given(r)}{r.choice(',.;:!?')} {noun()} {p.word()}",
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" + r.choice(["", f" {r.randint(0, 23)}:{digits(r, 2)}:{digits(r, 2)}"]),
            lambda: f"{r.randint(1, 12)}:{digits(r, 2)}{r.choice(['', 'pm', ' am'])}",
            lambda: f"{r.choice(['v', 'version ', ''])}{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 300)}",
            lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
            lambda: f"{r.choice('$€£')}{n}.{digits(r, 2)}",
            lambda: f"{n},{digits(r, 3)},{digits(r, 3)}",
            lambda: f"@{syllables(r)}{r.choice(['', '_' + syllables(r), digits(r, 2)])}",
            lambda: f"{r.choice(['u/', 'r/', '@'])}{given(r).lower()}{r.choice(['', '_' + syllables(r), digits(r, 3)])}",
            lambda: f"{r.choice(['', '', 'install ', 'add ', 'run '])}{syllables(r)}@{r.choice(['latest', 'next', 'v2', digits(r, 1) + '.' + digits(r, 1)])}",
            lambda: given(r),
            lambda: f"{given(r)} {p.word()} {p.word()}",
            lambda: f"{given(r).lower()} {p.word()}",
            lambda: f"{given(r)} and {given(r)}",
            lambda: f"{given(r)}, {given(r)} and {p.word()}",
            lambda: f"{noun()} {given(r)}",
            lambda: f"The {given(r)} {p.word()}",
            lambda: f"The {cap()} {p.word()}",
            lambda: f"the {cap()} {cap()}",
            lambda: f"{cap()} {cap()}",
            lambda: f"{noun()} {cap()} {r.choice(MEASURES)}",
            lambda: f"{cap()} {r.choice(THINGS)}",
            lambda: f"{noun()} {r.choice(THINGS)}",
            lambda: f"{noun()} {noun()}",
            lambda: f"{noun()} {noun()} {noun()}",
            lambda: f"{cap()} {noun()}",
            lambda: f"{p.word().upper()} {p.word().upper()} {p.word().upper()}",
            lambda: f"{cap().upper()} {p.word().upper()}",
            lambda: f"in {cap()} near the {p.word()}",
            lambda: f"{r.choice(UNITS).lower()} {n}",
            lambda: f"the {road(r, p)} {r.choice(STREETS)}",
            lambda: f"{p.word()} at {p.word()} dot {p.word()}" if r.random() < 0.1 else f"{p.word()} at {p.word()}",
            lambda: f"http{r.choice(['', 's'])}://{domain(r)}/{syllables(r)}/{n}",
            lambda: f"{syllables(r)}.{r.choice(['py', 'com', 'md', 'json'])}",
            lambda: f"{r.choice(['User', 'Assistant', 'Note', 'Edit', 'Q', 'A', 'Question'])}: {noun()} {p.word()}",
            lambda: r.choice(TITLES).lower() + " " + p.word(),
            lambda: "".join(r.choice("абвгдеиклмнопрст") for _ in range(r.randint(2, 8))) + " " + "".join(r.choice("абвгдеиклмнопрст") for _ in range(r.randint(2, 8))),
        ]
    )()


def made(r: random.Random, p: Prose) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text and its spans (start, end, kind)."""
    out, spans = "", []

    def put(x: str, glue: str | None = None) -> None:
        nonlocal out
        if glue is None and x[:1].isupper() and out.rpartition(" ")[2].rpartition("\n")[2] in NAMES:  # not the beginning of a name
            out += r.choice((".", ".", "!", "?", ":", ".\n"))
        if out and x and not out.endswith(("\n", "(", "<", "[", " ", '"')) and not (glue is None and x[0] in ".,;!?:)'\""):
            out += " " if glue is None else glue
        out += x

    while len(out) < LENGTH + 24:
        x = r.random()
        if x < 0.39:
            put(p.text())
            if r.random() < 0.15:
                out += r.choice(["\n", "\n\n", "  ", " > "])
        elif x < 0.84:
            put(" ".join(p.word() for _ in range(r.randint(0, 2))))
            what = decoy(r, p)
            put(what[0].upper() + what[1:] if r.random() < 0.3 else what)
            put(r.choice(["", "", ",", ".", p.word(), "!", *r.choice(list(AFTER.values()))[-6:]]))
        else:
            kind = r.choice(("name", "name", "name", *KINDS))
            put(" ".join(p.word() for _ in range(r.randint(0, 2))))
            if kind == "name" and r.random() < 0.06:  # an unknown given name needs a clear cue
                put(r.choice(["called", "name:", "named", "mother of", "son of", "her husband", "his wife", "colleague", "doctor", "cousin", "author"]))
                put(value := f"{syllables(r).capitalize()} {family(r)}")
                spans.append((len(out) - len(value), len(out), 4))
                put(r.choice(AFTER[kind]))
                continue
            if kind == "name" and r.random() < 0.18:  # an apposition
                put(r.choice(("my", "our", "the", "The", "her", "his", "a")) + f" {p.word()},")
                value, skip = name(r)
                put(value)
                spans.append((len(out) - len(value) + skip, len(out), 4))
                out += r.choice([",", ",", ",", ".", " and"])
                put(r.choice((r.choice(AFTER[kind]), p.word())))
                continue
            if kind == "name" and r.random() < 0.08:  # a line of its own
                value, skip = name(r)
                out += r.choice(("\n", "\n\n", ".\n", "-\n", "--\n", ",\n", "\n> ", "\n* "))
                out += value
                spans.append((len(out) - len(value) + skip, len(out), 4))
                out += r.choice(("\n", "\n", "\n\n", ".\n", ".\n\n", ",\n"))
                continue
            cue = r.choice(FUNCTION) if kind != "id_number" and r.random() < 0.25 else p.word() if kind == "name" and r.random() < 0.25 else r.choice(BEFORE[kind])
            put(cue.capitalize() if r.random() < 0.35 else cue.upper() if r.random() < 0.06 else cue)
            if r.random() < 0.1:
                put(r.choice(["is", "was", "no.", "#", ":", "=", "-"]))
            wrap = r.choice([("", "")] * 7 + [("(", ")"), ("<", ">"), ('"', '"'), ("[", "]")])
            skip = 0
            if kind == "name":
                value, skip = name(r)
            else:
                value = {"email": email, "phone": phone, "id_number": id_number, "address": lambda r: address(r, p)}[kind](r)
            put(wrap[0])
            put(value, "" if wrap[0] else " ")
            spans.append((len(out) - len(value) + skip, len(out), KINDS.index(kind)))
            out += wrap[1]
            if kind == "name" and r.random() < 0.3:
                put(r.choice((p.word(), p.word(), r.choice(FUNCTION), ".\n", ".\n\n", "\n", ". ")))
                continue
            put(r.choice(AFTER[kind]))
    if r.random() < 0.03 and not any(k == 4 for *_, k in spans):
        out = out.upper()
    elif r.random() < 0.06 and not any(k == 4 for *_, k in spans):
        out = out.lower()
    if len(out) != len(out.encode("utf-32-le")) // 4:
        return made(r, p)
    return out, spans


def batch(r: random.Random, p: Prose, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters, labels and mask, time by batch."""
    x = np.full((LENGTH, size), PAD, np.int16)
    y = np.zeros((LENGTH, size), np.int64)
    for j in range(size):
        text, spans = made(r, p)
        cut = r.choice([0, 0, r.randint(0, 24)])
        inside = next((s for s in spans if s[0] < cut < s[1]), None)
        cut = inside[0] if inside else cut
        end = min(len(text), cut + (LENGTH if r.random() < 0.7 else r.randint(20, LENGTH)))
        crossed = next((s for s in spans if s[0] < end < s[1]), None)
        end = crossed[0] if crossed and crossed[0] > cut + 5 else end
        text, spans = text[cut:end], [(a - cut, b - cut, k) for a, b, k in spans]
        c = codes(text)
        x[: len(c), j] = c
        for a, b, k in spans:
            a, b = max(a, 0), min(b, len(c))
            if a < b:
                y[a:b, j] = 2 + 2 * k
                y[a, j] = 1 + 2 * k
    return x, y, x != PAD


class Trainer:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"out": r.normal(0, 0.2, (2 * h, LABELS)), "bias": np.zeros(LABELS), "move": r.normal(0, 0.05, (LABELS, LABELS)), "start": np.zeros(LABELS)}
        for d in "fb":
            table = r.normal(0, 0.3, (CODES, 4 * h))
            table[:, h : 2 * h] += 1.0
            self.p["x" + d], self.p["u" + d] = table, r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.n = 0

    def forward(self, x, d):
        n, table, u = HIDDEN, self.p["x" + d], self.p["u" + d]
        h = c = np.zeros((x.shape[1], n), np.float32)
        tape = [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + h @ u
            s = np.clip(0.25 * z[:, : 3 * n] + 0.5, 0, 1)
            g = np.clip(z[:, 3 * n :], -1, 1)
            raw = s[:, n : 2 * n] * c + s[:, :n] * g
            new = np.clip(raw, -1, 1)
            out = s[:, 2 * n :] * new
            tape[t] = (h, c, s, g, raw, new, out)
            h, c = out, new
        return tape

    def backward(self, x, d, tape, dh_out, grad):
        n, u = HIDDEN, self.p["u" + d]
        dh = dc = np.float32(0)
        dz_all, before = np.empty((*x.shape, 4 * n), np.float32), np.empty((*x.shape, n), np.float32)
        for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
            h0, c0, s, g, raw, new, _ = tape[t]
            before[t] = h0
            dh = dh_out[t] + dh
            dcell = (dc + dh * s[:, 2 * n :]) * (np.abs(raw) < 1)
            dz = dz_all[t]
            dz[:, :n], dz[:, n : 2 * n], dz[:, 2 * n : 3 * n] = dcell * g, dcell * c0, dh * new
            dz[:, : 3 * n] *= 0.25 * ((s > 0) & (s < 1))
            dz[:, 3 * n :] = dcell * s[:, :n] * (np.abs(g) < 1)
            dh, dc = dz @ u.T, dcell * s[:, n : 2 * n]
        flat = dz_all.reshape(x.size, -1)
        one = np.zeros((x.size, CODES), np.float32)
        one[np.arange(x.size), x.ravel()] = 1
        grad["x" + d], grad["u" + d] = one.T @ flat, before.reshape(x.size, n).T @ flat

    def step(self, x, y, mask, rate):
        tapes = {d: self.forward(x, d) for d in "fb"}
        hid = np.concatenate([np.stack([t[6] for t in tapes[d]]) for d in "fb"], axis=2)
        e = hid @ self.p["out"] + self.p["bias"]
        length, size = x.shape
        # forward and backward of the CRF in scaled probabilities
        top = e.max(2, keepdims=True)
        pe, pm = np.exp(e - top), np.exp(self.p["move"])
        a, b = np.empty_like(e), np.ones_like(e)
        scale = np.ones((length, size), np.float32)
        for t in range(length):
            new = pe[t] * (np.exp(self.p["start"]) if t == 0 else a[t - 1] @ pm)
            total = new.sum(1)
            a[t] = np.where(mask[t][:, None], new / total[:, None], a[t - 1] if t else 1 / LABELS)
            scale[t] = np.where(mask[t], total, 1)
        for t in range(length - 2, -1, -1):
            new = (pe[t + 1] * b[t + 1]) @ pm.T / scale[t + 1][:, None]
            b[t] = np.where(mask[t + 1][:, None], new, b[t + 1])
        post = a * b
        post /= post.sum(2, keepdims=True)
        hot = np.zeros_like(post)
        hot[np.arange(length)[:, None], np.arange(size), y] = 1
        de = ((post - hot) * mask[:, :, None] / size).astype(np.float32)
        right = pe[1:] * b[1:] / scale[1:, :, None] * mask[1:, :, None]
        gm = pm * np.einsum("tbi,tbj->ij", a[:-1], right, optimize=True)
        np.subtract.at(gm, (y[:-1][mask[1:]], y[1:][mask[1:]]), 1)
        grad = {"move": (gm / size).astype(np.float32), "start": de[0].sum(0), "bias": de.sum((0, 1)), "out": np.einsum("tbh,tbl->hl", hid, de, optimize=True)}
        dh = de @ self.p["out"].T
        for k, d in enumerate("fb"):
            self.backward(x, d, tapes[d], dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        self.n += 1
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)
        gold = (e * hot * mask[:, :, None]).sum() + self.p["start"][y[0]].sum() + (self.p["move"][y[:-1], y[1:]] * mask[1:]).sum()
        return float(((np.log(scale) + top[:, :, 0] * mask).sum() - gold) / size)


def train(out: str, minutes: float = 5.0, seed: int = SEED, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", rate: float = 0.012, start: str | None = None) -> None:
    """Train for so many minutes with a falling rate; writes the weights to out. The shipped weights took
    a run of 12.3 minutes and, with the generator changed, one of 6.5 (start, seed 23, rate 0.006) and, with the decoys of word pairs and line ends added, one of 3 (start, seed 29, rate 0.005)."""
    r = random.Random(seed)
    p = Prose(r, vocabulary)
    t = Trainer(seed)
    if start:
        t.p = {k: v.astype(np.float32) for k, v in np.load(start).items()}
    began, k, losses = time.time(), 0, []
    while (share := (time.time() - began) / (60 * minutes)) < 1:
        losses.append(t.step(*batch(r, p, BATCH), rate=rate * (1 if share < 0.35 else 0.4 if share < 0.6 else 0.15 if share < 0.85 else 0.05)))
        k += 1
        if k % 200 == 0:
            print(k, round(float(np.mean(losses[-200:])), 3), flush=True)
    np.savez_compressed(out, **{n: v.astype(np.float16) for n, v in t.p.items()})


if __name__ == "__main__":
    train(sys.argv[1], *map(float, sys.argv[2:3]), **({"start": sys.argv[3], "seed": 23, "rate": 0.005} if len(sys.argv) > 3 else {}))
