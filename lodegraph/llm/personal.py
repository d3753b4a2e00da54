"""Personal data in free text: where it is, and the text with typed placeholders in its stead.

One pass finds every mention, validates it by its format and gives it its pseudonym (`llm.formats`): numbers and dates
are permuted by a keyed Feistel network within their format, so equal values stay linked across documents; mail
addresses, names and street addresses, which have no fixed format, get a keyed tag.

Names are told by what they stand beside (a mail address, a phone number, a street address, an identity number, a title,
a label, "by", "who") and by their given name. Which given names a collection uses, and which words are ordinary
there, is learned from the collection itself (`learn_names`).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import formats
from lodegraph.llm.batches import map_rows, spread

# --- Mail -----------------------------------------------------------------------------------------------------------
_AT = re.compile(r"@|[  ]?[\[({<][  ]?(?:at|AT|At)[  ]?[\])}>][  ]?|[  ](?:AT|at)[  ](?=[\w.-]+[  ](?:DOT|dot)[  ])")
#: Without "dot" and a bracketed "at" only the sign can match.
_SIGN, _BRACKET_AT = re.compile("@"), re.compile(r"[\[({<][ ]?(?:at|AT|At)[ ]?[\])}>]")
_LOCAL = re.compile(r"(?<![\w.%+@/-])[^\W_](?:[\w.%+'-]{0,62}\w)?\Z")
_DOMAIN = re.compile(r"(?:[^\W_][\w-]*(?:\.|[  ]?[\[({<][  ]?(?:dot|DOT|Dot)[  ]?[\])}>][  ]?|[  ](?:DOT|dot)[  ]))+[^\W\d_]{2,24}(?![\w@/])")

# --- Identity numbers: labels in English, German, French and Spanish -------------------------------------------------
_ID_LABELS = r"ssn|social security(?: number| no\.?)?|passport(?: number| no\.?)?|passeport(?: n[o°]\.?)?|pasaporte(?: n[o°º]\.?)?|reisepass(?:nummer|-nr\.?)?|(?:national )?insurance (?:number|no\.?)|ni(?:no| number| no\.?)|id card(?: number| no\.?)?|identity card(?: number| no\.?)?|personalausweis(?:nummer|-nr\.?)?|ausweis(?:nummer|-nr\.?)?|carte d['’]identité|dni|nie|nif|steuer-?id(?:nummer|-nr\.?)?|steueridentifikationsnummer|tin|tax id(?: number| no\.?)?|idnr\.?|national id(?: number| no\.?)?|sozialversicherungsnummer|sv-nummer|numéro de sécurité sociale|insee|driver'?s licen[cs]e(?: number| no\.?)?"
_ID_VALUE = r"(?:[A-Za-z]{1,2}[ -]?)?\d{1,3}(?:[ -]?\d{1,4}){2,5}(?:[ -]?[A-Za-z])?|[A-Z]\d{2}[A-Z0-9]{6,8}"
_ID_NUMBER = re.compile(rf"(?<!\w)(?:{_ID_VALUE})(?!\w|-\d)")
_ID_LABEL = re.compile(rf"(?<!\w)(?i:{_ID_LABELS})[  \n]?[:#=]?[  \n]{{0,2}}\Z")
#: Numbers that need no label: their own grouping (social security, national insurance) or their check digits tell them.
_ID_GROUPED = re.compile(r"(?<![\w.+/-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} \d{2} \d{2} \d{2} [A-D])(?!\w|[-./]\d)")
_ID_CHECKED = re.compile(r"(?<![\w.+/-])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|\d(?:[ -]?\d){12,18})(?!\w|[-./]\d)")
#: What every identity number has, and every run of digits with a phone number: texts without it are not searched for them.
_ID_DIGITS, _PHONE_DIGITS = re.compile(r"\d(?:(?:\W?\d){5}|\d ?[A-Z0-9]{4})"), re.compile(r"\d[\d ()./-]{6,}\d")

# --- Phone numbers ---------------------------------------------------------------------------------------------------
_DIGIT = re.compile(r"\d")
_DIGIT_RUN = re.compile(r"[+(]?\d[\d  ()./-]{6,}\d")
_PHONE = re.compile(
    r"(?<![\w.+@/:#(-])(?:"
    r"\+\d{1,3}(?:[  ./-]?\(0?\d{0,4}\))?(?:[  ./-]?\d{1,12}){1,6}"
    r"|\([2-9]\d{2}\)[  .-]?[2-9]\d{2}[  .-]\d{4}"
    r"|(?:1[ .-])?[2-9]\d{2}(?P<s>[ .-])[2-9]\d{2}(?P=s)\d{4}"
    r"|0\d[ .](?:\d{2}[ .]){3}\d{2}"
    r"|\(?0\d{1,4}\)?[/-][ ]?\d{3}(?:[ -]?\d{2,4}){1,2}"
    r"|\(?0\d{2,4}\)?[ ]\d{3,4}[ ]?\d{3,4}"
    r")(?:[ ,]{0,2}(?:ext|Ext|x|Durchwahl|poste)\.?[ ]?\d{1,5})?(?!\w|[-/.]\d|@)"
)

#: Groups of four before a number that goes on behind it too make it the middle of a longer one.
_GROUPS_BEFORE = re.compile(r"[A-Z\d]{4}[ -]\Z")

# --- Street addresses ------------------------------------------------------------------------------------------------
_NEXT = r"(?![  ]+[a-zß-öø-ÿ])"  # a capital word before a lower-case one begins a sentence rather than ends a place
_PLACE = rf"(?:[^\W\d_a-z][\w'’-]+(?:[  ][^\W\d_a-z][\w'’-]+{_NEXT})?)"
_TYPES = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Terrace|Close|Court|Ct\.?|Drive|Dr\.?|Way|Place|Pl\.?|Square|Sq\.?|Boulevard|Blvd\.?|Crescent|Row|Walk|Mews|Gardens|Grove|Hill|Parade|Highway|Hwy\.?|Parkway|Pkwy\.?)"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room)[  ]\d{1,4}[a-zA-Z]?)"
_HOUSE = re.compile(r"\d(?:[a-z]|[ ]?(?:bis|ter))?,?[  ](?=[^\W\d_a-z][\w'’.-]*[  ][^\W\d_a-z]|(?:rue|avenue|boulevard|allée|chemin|impasse|quai|route|cours|place)[ ])")
_NUMBERED = re.compile(r"[  ]\d{1,5}")
_STREET_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ufer", "damm", "ring")
_STREET_WORDS = ("Calle ", "Avenida ", "Avda. ", "Plaza ", "Paseo ", "Camino ", "Carrera ", "Ronda ", "C/ ")
_ADDRESS = re.compile(
    r"(?<![\w.,/-])(?<!\d[ ])(?:"
    rf"(?:{_UNIT},[ ])?\d{{1,5}}[a-z]?[  ](?:[NSEW]\.?[ ])?[^\W\d_a-z][\w'’-]+(?:[ ][^\W\d_a-z][\w'’-]+)?[  ]{_TYPES}(?!\w)"
    rf"(?:,[ ]{_UNIT})?(?:,[ ]{_PLACE}(?:[ ]\d{{4,6}})?)?"
    rf"|\d{{1,5}}(?:[ ]?(?:bis|ter|[a-z]))?,?[ ](?:rue|avenue|boulevard|allée|chemin|impasse|quai|route|cours|place)[ ](?:de(?:s|[ ]la|[ ]l['’])?[ ]|du[ ]|d['’])?{_PLACE}(?:,[ ](?:\d{{4,5}}[ ])?{_PLACE})?"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|Ronda|C/)[ ](?:de(?:[ ]la|l)?[ ])?{_PLACE},?[ ](?:n[.º°][ ]?)?\d{{1,5}}[a-z]?(?:,[ ](?:\d{{4,5}}[ ])?{_PLACE})?"
    rf"|[^\W\d_a-z][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring)[ ]\d{{1,4}}[ ]?[a-z]?(?:,[ ](?:\d{{4,5}}[ ])?{_PLACE})?(?!\w)"
    r")"
)
#: Characters before and after a house number or street word within which its address lies.
BEFORE, AFTER = 70, 110

# --- Dates of people ---------------------------------------------------------------------------------------------------
_BIRTH = re.compile(r"(?i)(?<!\w)(?:born(?: on)?|date of birth|birth ?date|birthday|d\.?o\.?b\.?|geboren(?: am)?|geb\.|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)\s?[:=]?\s{0,2}(?P<v>\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\.?(?:st|nd|rd|th)?(?: de)? [^\W\d_]+(?: de)? \d{4})(?!\w|[-/.]\d)")

_BIRTH_WORDS = ("born", "birth", "dob", "d.o.b", "geb", "né", "naci", "naissance")

# --- Names -------------------------------------------------------------------------------------------------------------
#: Frequent given names of the four languages and of their neighbours; the collection's own are learned.
GIVEN_NAMES = (
    "Alexander", "Alice", "Amélie", "Ana", "Andrea", "Andreas", "Andrew", "Anna", "Anne", "Anthony", "Antonio", "Barbara", "Brian", "Camille", "Carlos", "Carmen", "Carol", "Catherine", "Charles", "Charlotte",
    "Christian", "Christine", "Christopher", "Claire", "Claudia", "Daniel", "David", "Diego", "Dorothy", "Edward", "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Eva", "Felix", "Fernando", "Francisco", "François",
    "Frank", "Friedrich", "George", "Hans", "Heike", "Heinrich", "Helen", "Isabel", "Jacques", "James", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "Joachim", "John", "Jonas", "Jorge", "José",
    "Joseph", "Juan", "Julia", "Julien", "Jürgen", "Karen", "Karin", "Katharina", "Kenneth", "Kevin", "Klaus", "Laura", "Léa", "Linda", "Lisa", "Louis", "Lucas", "Lucía", "Luis", "Manuel",
    "Marco", "Margaret", "María", "Maria", "Marie", "Mark", "Marta", "Martin", "Mary", "Matthew", "Michael", "Michel", "Miguel", "Monika", "Nancy", "Nicolas", "Olivier", "Pablo", "Patricia", "Patrick",
    "Paul", "Pedro", "Peter", "Petra", "Philippe", "Pierre", "Rafael", "Rebecca", "Richard", "Robert", "Sabine", "Sandra", "Sarah", "Sebastian", "Sergio", "Sophie", "Stefan", "Stephan", "Stephen", "Steven",
    "Susan", "Susanne", "Teresa", "Thomas", "Timothy", "Ulrich", "Ursula", "Uwe", "Victoria", "Vincent", "William", "Wolfgang",
    "Ahmed", "Ali", "Anders", "Anil", "Astrid", "Bruno", "Celia", "Deepak", "Dmitri", "Fatima", "Francesca", "Giovanni", "Giulia", "Goran", "Hassan", "Henrik", "Hiroshi", "Igor", "Ingrid", "Ivan",
    "Jana", "Jelena", "João", "Karim", "Katarzyna", "Lars", "Leila", "Lena", "Li", "Luca", "Milan", "Mohammed", "Nadia", "Natasha", "Olga", "Omar", "Oskar", "Pavel", "Piotr", "Priya",
    "Rahul", "Rosa", "Sven", "Tatiana", "Viktor", "Vladimir", "Wei", "Yuki", "Yusuf",
)
_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Sr|Sra|Herr|Frau|Monsieur|Madame|Señora?|Don|Doña)\.? "
_TITLE = re.compile(rf"(?:^|[^\w]){_TITLES}\Z")
#: Found wherever a title may stand. It, _ANY_CAP and _LOW_ANCHOR begin with a set of characters, which is searched fast.
_ANY_TITLE = re.compile(r"[DFHMPS](?:rs?|s|rof|me|lle|ra|err|rau|onsieur|adame|eñora?|on|oña)\.? ")
#: Left of a name: a label, or the word that names an agent; right of it: a relative clause on a person.
_LABEL = re.compile(r"(?:^|[^\w:/=]|[.:;)>`][ \n])[^\W\d_][\w-]*(?: [\w-]+){0,2}:[  \n]{1,2}\Z")
_TRAILER = re.compile(r"(?:^|\W)[A-Za-z]+(?:-[a-z]+)*-by: \Z")
_AGENT = re.compile(r"(?:^|\W)(?:by|von|vom|durch|par|por)[  \n]\Z")
_DATIVE = re.compile(r"(?:^|\W)(?:to|for|an|für|à|pour|a|para|with|mit|avec|con)[  \n]\Z")
_OWNED = re.compile(r"[  \n](?:of|for|von|de|belonging to|issued to)[  \n]\Z")
_WHO = re.compile(r",[  \n](?:who|whose|der|die|qui|dont|quien|que)\b")
_LINK = re.compile(r"(?:[  \n]\(|,?[  \n](?:[a-zà-ÿ]{1,6}[  \n]){0,2})\Z")
#: What may follow a name in lower-case letters.
_ENDS = re.compile(r"[  \n]*(?:[<(,\[.;)`#]|$|\n)|[  \n]+(?:- |[A-Z`#\[(])|[  \n](?:on|via|under|unter|at|en|for|the|last|who|au|al|über|per|from|about|auf|le|la|el|pour|para|für)\b")
_LOW, _CAP = r"[^\W\d_]{2,}(?:[-'’][^\W\d_]{2,})*", r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[-'’][^\W\d_]{2,})*"
#: given surname, given initial surname, initial(s) surname, surname first with a given name or an initial.
_SHAPES = "(?:{w},[  \n]{w}(?:[ ][A-Z]\\.)?|{w},[ ][A-Z]\\.|{w}(?:[ ][A-Z]\\.)?[  \n]{w}|[A-Za-z]\\.(?:[ ]?[A-Z]\\.)?[ ]{w})(?!\\w)"
_ANY_CAP = re.compile(rf"[^\W\d_a-zß-öø-ÿ](?<=(?=(?<![\w@./'’-])(?P<v>{_SHAPES.format(w=_CAP)})).)")
_LOW_AT = re.compile(_SHAPES.format(w=_LOW))
_LOW_ANCHOR = re.compile(r"[ \n](?<=[:ynmhroaàfe][ \n])(?:(?<=:[ \n])|(?<=\W[aà][ \n])|(?<=\W(?:by|to|an|of|de)[ \n])|(?<=\W(?:von|vom|par|por|for)[ \n])|(?<=\Wdurch[ \n]))[ \n]?(?=[a-zà-ÿ])")
_LOW_BEFORE = re.compile(rf"(?=(?<![\w@./'’-])(?P<v>{_SHAPES.format(w=_LOW)}))(?=[a-zà-ÿ])")
_PART = re.compile(r"[^\W\d_]+\.?(?:[-'’][^\W\d_]+)*")
_WITHIN = re.compile(r"(?:^|\W)[a-zß-öø-ÿ][\w'’-]*,?[  \n]\Z")
_MIDDLE = re.compile(rf"{_CAP}[ ][A-Z]\.[ ].*", re.S)
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
SURE, LIKELY = 2, 1


@dataclass
class Lexicon:
    """Given names of a collection (lower case), and words that are ordinary there."""

    given: frozenset[str] = field(default_factory=lambda: frozenset(n.lower() for n in GIVEN_NAMES))
    ordinary: frozenset[str] = frozenset()


USUAL, NONE = Lexicon(), Lexicon(frozenset())


def _parts(v: str) -> tuple[str, str]:
    """(given name or its initial, surname) of a name, in lower case."""
    words = _PART.findall(v.lower())
    return (words[1], words[0]) if "," in v else (words[0], words[-1])


def _name_strength(text: str, a: int, b: int, v: str, lexicon: Lexicon, starts: dict[int, str], id_ends: set[int]) -> tuple[int, bool]:
    """(0, LIKELY or SURE; whether by a neighbouring mention or title) that text[a:b] is a person's name."""
    given, surname = _parts(v)
    left = text[max(0, a - 40) : a]
    known = given.split("-")[0] in lexicon.given
    initial = given.endswith(".") or len(given) == 1
    owned = _OWNED.search(left)
    if _TITLE.search(left) or (owned and a - len(left) + owned.start() in id_ends):
        return SURE, True
    for c in range(b, min(len(text), b + 22)):
        kind = starts.get(c)
        if kind and kind != "name":
            gap = text[b:c]
            if (kind == "email" and re.fullmatch(r"[  \n][<(\[]|,[  \n]", gap)) or (kind == "phone" and _LINK.fullmatch(gap)) or (kind == "address" and gap in (", ", " (", ",\n", ",\u00a0")):
                return SURE, True
            break
    plain = surname not in lexicon.ordinary and (initial or given not in lexicon.ordinary)
    if _WHO.match(text, b) and (known or plain):
        return SURE, False
    if known and surname not in lexicon.ordinary:
        return SURE, False
    if _TRAILER.search(left) and plain:
        return LIKELY, False
    if initial and plain and (_LABEL.search(left) or _AGENT.search(left) or _DATIVE.search(left)):
        return LIKELY, False
    return 0, False


def mentions(text: str, lexicon: Lexicon | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention, ascending and without overlap; numbers win over names where two overlap."""
    taken, add = _formatted(text)
    for _, a, b, _near in sorted(_names(text, *_ends(taken), lexicon or USUAL)):
        add(a, b, "name")
    return taken


def _formatted(text: str) -> tuple[list[tuple[int, int, str]], Callable[[int, int, str], bool]]:
    """Mentions told by their format (all but names), ascending and without overlap; what adds one to them where it is free."""
    taken: list[tuple[int, int, str]] = []
    starts: list[int] = []

    def add(a: int, b: int, kind: str) -> bool:
        i = bisect_right(starts, a)
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            return False
        starts.insert(i, a)
        taken.insert(i, (a, b, kind))
        return True

    for at in (_AT if "dot" in text or "DOT" in text or _BRACKET_AT.search(text) else _SIGN).finditer(text):
        low = max(0, at.start() - 66)
        local, domain = _LOCAL.search(text[low : at.start()]), _DOMAIN.match(text, at.end())
        if local and domain and not domain[0].replace(".", "").isdigit():
            add(low + local.start(), domain.end(), "email")
    if _DIGIT.search(text):
        _numbers(text, add)
    return taken, add


def _ends(taken: list[tuple[int, int, str]]) -> tuple[dict[int, str], set[int]]:
    """Where mentions start, with their kinds; where identity numbers end."""
    return {a: k for a, _, k in taken}, {b for _, b, k in taken if k == "id_number"}


def _numbers(text: str, add) -> None:
    if _ID_DIGITS.search(text):
        _identities(text, add)
    spots = [m.start() for m in _HOUSE.finditer(text)]
    spots += [m.start() for m in _NUMBERED.finditer(text) if text.endswith(_STREET_ENDS, max(0, m.start() - 8), m.start())]
    for word in _STREET_WORDS:
        at = text.find(word)
        while at >= 0:
            spots.append(at)
            at = text.find(word, at + 1)
    for at in spots:
        for m in _ADDRESS.finditer(text, max(0, at - BEFORE), min(len(text), at + AFTER)):
            if m.start() <= at < m.end():
                add(m.start(), m.end(), "address")
    low = text.lower()
    if any(w in low for w in _BIRTH_WORDS):
        for m in _BIRTH.finditer(text):
            if formats.split_date(m["v"]):
                add(m.start("v"), m.end("v"), "date")
    for run in _DIGIT_RUN.finditer(text) if _PHONE_DIGITS.search(text) else ():
        for m in _PHONE.finditer(text, run.start(), min(len(text), run.end() + 20)):
            if formats.split_phone(m[0]) and not (_GROUPS_BEFORE.search(text, max(0, m.start() - 6), m.start()) and text[m.end() : m.end() + 1] in " -"):
                add(m.start(), m.end(), "phone")


def _identities(text: str, add) -> None:
    for m in _ID_NUMBER.finditer(text):
        for a in {m.start(), m.start() + _DIGIT.search(m[0]).start()}:  # two letters before the digits may end the label
            if formats.id_format(text[a : m.end()]) and _ID_LABEL.search(text, max(0, a - 40), a):
                add(a, m.end(), "id_number")
    for m in _ID_GROUPED.finditer(text):
        if formats.id_format(m[0]):
            add(m.start(), m.end(), "id_number")
    for m in _ID_CHECKED.finditer(text):
        if formats.id_format(m[0]) in [(name, True) for name in formats.BARE]:
            add(m.start(), m.end(), "id_number")


def _names(text: str, starts: dict[int, str], id_ends: set[int], lexicon: Lexicon) -> list[tuple[int, int, int, bool]]:
    """(-strength, start, end, by a neighbour) of all candidates that count; they may overlap."""
    out = []
    for m in _ANY_CAP.finditer(text):
        a, b = m.start("v"), m.end("v")
        if _MIDDLE.fullmatch(m["v"]) and _parts(m["v"])[0].split("-")[0] not in lexicon.given and not _WITHIN.search(text, max(0, a - 25), a) and not _LABEL.search(text, max(0, a - 40), a):
            continue  # a word that begins a sentence before an initial and a surname, which stand as a candidate of their own
        strength, near = _name_strength(text, a, b, m["v"], lexicon, starts, id_ends)
        if strength:
            out.append((-strength, a, b, near))
    spots = {m.end() for m in _LOW_ANCHOR.finditer(text)}
    for c in [*(c for c, kind in starts.items() if kind != "name"), *(m.start() for m in _WHO.finditer(text))]:
        low = max(0, c - 50)
        spots |= {low + m.start("v") for m in _LOW_BEFORE.finditer(text[low:c])}
    for at in spots:
        m = _LOW_AT.match(text, at)
        if not m:
            continue
        given, surname = _parts(m[0])
        strength, near = _name_strength(text, at, m.end(), m[0], lexicon, starts, id_ends)
        fits = given in lexicon.given or (near and len(given.rstrip(".")) == 1)
        if strength and fits and (near or strength == SURE or surname not in lexicon.ordinary) and _ENDS.match(text, m.end()):
            out.append((-LIKELY, at, m.end(), near))
    return out


# --- Learning the names of a collection --------------------------------------------------------------------------------
#: A given name stands in names found beside other mentions so often, and so in such a share of all its places; an ordinary word is written in lower case once in so many texts, and in such a share of its places.
GIVEN_TIMES, GIVEN_SHARE, ORDINARY_TEXTS, ORDINARY_SHARE = 1, 0.2, 2_000, 0.3
#: Characters of texts that a task counts before it passes the counts on.
HELD = 20_000_000
_COUNTED = pa.schema([("word", pa.string()), ("lower_n", pa.int64()), ("all_n", pa.int64()), ("given_n", pa.int64())])
_COUNTS = "word string, lower_n bigint, all_n bigint, given_n bigint"


def _without(text: str, found: list[tuple[int, int, str]]) -> str:
    """A text without its mentions, whose parts (mail names above all) are no words of the collection."""
    out, at = [], 0
    for a, b, _ in found:
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]])


def _chunks_and_given(text: str) -> tuple[list[str], list[str]]:
    """What stands between blanks in a text without its mentions; given names (lower case) of the names beside a mention or title."""
    taken, _ = _formatted(text)
    near = _names(text, *_ends(taken), NONE) if taken or _ANY_TITLE.search(text) else []
    return _without(text, taken).split(), [_parts(text[a:b])[0] for _, a, b, by in near if by]


def _counted(chunks: Counter[str], given: Counter[str]) -> pa.RecordBatch:
    every: Counter[str] = Counter()
    for chunk, n in chunks.items():
        for word in _TOKEN.findall(chunk):
            every[word] += n
    low, zeros = [w.lower() for w in every], [0] * len(given)
    return pa.RecordBatch.from_pydict({"word": [*low, *given], "lower_n": [n if w == k else 0 for (w, n), k in zip(every.items(), low)] + zeros, "all_n": [*every.values(), *zeros], "given_n": [0] * len(every) + [*given.values()]}, schema=_COUNTED)


def learn_names(docs: DataFrame) -> Lexicon:
    """Lexicon of a collection, from all of its texts.

    Given names come from names that stand beside a mail address, phone number, street address, identity number or
    title. Only words that are kept reach the driver. Ordinary words are at most some ORDINARY_TEXTS times the words of
    an average text, however many texts there are; given names are as many as the collection has.
    """
    texts = docs.where("text is not null and text <> ''").select("text")
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: Counter[str] = Counter()
        given: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                parts, names = _chunks_and_given(text)
                chunks.update(parts)
                given.update(names)
                held += len(text)
                if held >= HELD:
                    yield _counted(chunks, given)
                    chunks.clear()
                    given.clear()
                    held = 0
        yield _counted(chunks, given)

    counts = spread(texts).mapInArrow(run, _COUNTS).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("lower_n", "all_n", "given_n")])
    is_given = F.expr(f"given_n >= {GIVEN_TIMES} and given_n >= {GIVEN_SHARE} * all_n")
    is_ordinary = F.expr(f"lower_n >= {max(2, n // ORDINARY_TEXTS)} and lower_n >= {ORDINARY_SHARE} * all_n")
    kept = counts.where(is_given & (F.length("word") > 2) | is_ordinary).select("word", is_given.alias("is_given")).toArrow()
    words = {flag: frozenset(kept.filter(pc.equal(kept["is_given"], flag))["word"].to_pylist()) for flag in (True, False)}
    return Lexicon(words[True] | USUAL.given, words[False])


# --- Pseudonyms --------------------------------------------------------------------------------------------------------
def pseudonym(value: str, kind: str, key: bytes) -> str:
    """Equal values (apart from case and separators) get equal pseudonyms; those of numbers and dates keep the value's layout."""
    if kind == "phone":
        return formats.permute_phone(value, key)
    if kind == "id_number":
        return formats.permute_id(value, key)
    if kind == "date":
        return formats.permute_date(value, key)
    same = " ".join(sorted(re.findall(r"\w+", value.lower()))) if kind == "name" else re.sub(r"\W+", " ", value.lower())
    return hashlib.blake2b(same.encode(), key=key, digest_size=5).hexdigest()


def redact(text: str, key: bytes, lexicon: Lexicon | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with placeholders [kind:pseudonym], and the mentions with their pseudonyms."""
    found = [(a, b, kind, pseudonym(text[a:b], kind, key)) for a, b, kind in mentions(text, lexicon)]
    out, at = [], 0
    for a, b, kind, name in found:
        out += [text[at:a], f"[{kind}:{name}]"]
        at = b
    return "".join(out) + text[at:], found


MENTIONS = "doc_id bigint, kind string, start_at bigint, end_at bigint, pseudonym string"
REDACTED = "doc_id bigint, text string, n_mentions int"


def find_mentions(docs: DataFrame, key: bytes) -> DataFrame:
    """One row a mention: kind (email, phone, id_number, address, name, date), offsets in code points of its first character and past its last, pseudonym under `key`.

    Null, empty and blank texts have none. Repeated rows of one doc_id yield their mentions once. Extra columns are
    ignored. Texts are read whole; nothing is shuffled but the mentions. `key` has 16 to 64 bytes and is the caller's
    to keep: whoever has it can undo the permutations.
    """
    key = _checked(key)
    lexicon = docs.sparkSession.sparkContext.broadcast(learn_names(docs))

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [(d, kind, a, b, name) for d, t in zip(cols["doc_id"], cols["text"]) if t for a, b, kind, name in redact(t, key, lexicon.value)[1]]
        return dict(zip(("doc_id", "kind", "start_at", "end_at", "pseudonym"), map(list, zip(*rows)))) if rows else {c: [] for c in ("doc_id", "kind", "start_at", "end_at", "pseudonym")}

    return map_rows(spread(docs.select("doc_id", "text")), run, MENTIONS).dropDuplicates(["doc_id", "kind", "start_at"])


def redact_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """Each row of `docs` with its text redacted (null stays null); placeholders are [kind:pseudonym]. `key` as in `find_mentions`."""
    key = _checked(key)
    lexicon = docs.sparkSession.sparkContext.broadcast(learn_names(docs))

    def run(cols: dict[str, list]) -> dict[str, list]:
        done = [redact(t, key, lexicon.value) if t else (t, []) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "text": [t for t, _ in done], "n_mentions": [len(m) for _, m in done]}

    return map_rows(spread(docs.select("doc_id", "text")), run, REDACTED)


def _checked(key: bytes) -> bytes:
    if not 16 <= len(key) <= 64:
        raise ValueError("the pseudonym key must have 16 to 64 bytes")
    return key
