"""Generators of personal-information candidates and the features they are judged by."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import regex

KINDS = ("email", "phone", "id_number", "address", "name")

# Words of addresses, by what they are.
_UNIT = r"(?:apt|apartment|flat|unit|suite|ste|room|wohnung|whg|appt|appartement|piso|lokal)"
_STREET = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|boulevard|blvd|court|ct|way|place|pl|square|sq|terrace|crescent|hill|parkway|gardens|walk|mews|quay|grove)"
_GERMAN = r"(?:str\.|straße|strasse|gasse|weg|platz|allee|ring|damm|ufer)"
_ROMANCE_FIRST = r"(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route)"
_ROMANCE = r"(?:calle|avenida|av\.|plaza|paseo|carrera|rua|travessa|praça|via|viale|piazza|corso|ul\.|ulica|aleja|ул\.|улица|проспект)"
_BOX = r"(?:p\.? ?o\.? ?box|postfach|apartado|boîte postale|bp|caixa postal|skrytka pocztowa)"
_LINK = r"(?:des|de la|de los|de|du|d'|del|da|do|dos|la|le|les|l')"

_W = r"[\p{L}][\p{L}\p{M}'’-]*"
_CORES = [
    rf"(?:{_UNIT}\.? ?[\w-]{{1,5}},? )?\d{{1,5}}[a-z]? (?:{_W} ){{1,3}}{_STREET}(?-i: (?:[NS][EW]|[NSEW]|North|South|East|West))?(?![\p{{L}}\d])",
    rf"(?:{_W} ){{0,2}}{_W}{_GERMAN} ?\d{{1,4}} ?[a-z]?(?![\p{{L}}\d])",
    rf"\d{{1,5}}(?: ?(?:bis|ter|[a-z]))?,? {_ROMANCE_FIRST} (?:{_LINK} ?)?{_W}(?: {_W}){{0,2}}",
    rf"{_ROMANCE} (?:{_LINK} )?{_W}(?: {_W}){{0,3}},? (?:n[º°o.]+ ?)?\d{{1,5}}[a-z]?(?:, ?\d{{1,2}} ?[ºª°] ?[a-z]?)?(?![\p{{L}}\d])",
    rf"{_BOX} \d{{1,6}}",
]


@lru_cache
def _address_pattern(which: tuple[int, ...]) -> regex.Pattern:
    return regex.compile(rf"(?<![\p{{L}}\d.])(?:{'|'.join(_CORES[k] for k in which)})", regex.I)


#: Words, one of which an address core of each form has; of the German form they end as in _STREET_END.
_CORE_WORDS = {
    0: frozenset("street st road rd avenue ave lane ln drive dr close boulevard blvd court ct way place pl square sq terrace crescent hill parkway gardens walk mews quay grove".split()),
    2: frozenset("rue avenue boulevard place chemin impasse allée quai route".split()),
    3: frozenset("calle avenida av plaza paseo carrera rua travessa praça via viale piazza corso ul ulica aleja ул улица проспект".split()),
    4: frozenset("box pobox postfach apartado boîte bp caixa skrytka".split()),
}
_STREET_WORDS = frozenset().union(*_CORE_WORDS.values())
_STREET_END, _DIGIT = re.compile(r"(?:str|straße|strasse|gasse|weg|platz|allee|ring|damm|ufer)(?![^\W\d_])"), re.compile("[0-9]")
_SIDE = regex.compile(r" (?:[NS][EW]|[NSEW]|North|South|East|West)$")
_TOWN = regex.compile(r"\.?, (?:(?P<pc>(?:[A-Z]{1,2}-)?\d{4,6}|\d{2}-\d{3}|[A-Z]{1,2}\d{1,2} ?\d[A-Z]{2}) )?(?P<t1>\p{Lu}[\p{L}'’-]+)(?P<t2> \p{Lu}[\p{L}'’-]+)?(?P<t3> \p{Lu}[\p{L}'’-]+)?")
_PC = regex.compile(r",? (?:\d{4,6}|\d{2}-\d{3}|[A-Z]{1,2}\d{1,2} ?\d[A-Z]{2})(?![\p{L}\d-])")

_EMAIL = regex.compile(
    r"(?<![\w.+@%-])[\w+%-]+(?:\.[\w+%-]+)*(?:@| @ | ?[\[(]at[\])] ?|＠)[\p{L}\d-]+(?:(?:\.| ?[\[(]dot[\])] ?)[\p{L}\d-]+)*"
    r"|(?<![\w.+@%-])[\w+%-]+(?:\.[\w+%-]+)* at [\p{L}\d-]+(?: dot [\p{L}\d-]+)+",
    regex.I,
)
_DIGITS = regex.compile(r"(?<![\p{L}\d_+.:/#-])(?:\+|00)?[(]?\d(?:[ ]?[-./()]?[ ]?[(]?\d){6,17}[)]?(?![\d\p{L}_])(?![-./:]\d)")
_ID = regex.compile(
    r"(?<![\p{L}\d_./:#-])(?:"
    r"\d{3}[- ]\d{2}[- ]\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]"
    r"|\d{7,9}[- ]?[A-Z]"
    r"|[A-Z]{1,3}-?\d{6,10}[A-Z]?"
    r"|[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,4})?"
    r"|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"
    r"|\d{2,3}(?:[ .-]\d{3}){2,3}(?:[ -]\d{1,2})?"
    r"|\d{3} \d{3} \d{4}|\d{4}[ -]\d{4}[ -]\d{4}"
    r"|(?=(?:[A-Z]*\d){4})[A-Z](?:[A-Z]?\d){3,8}[A-Z\d]|[A-Z]-\d{7}-[A-Z]"
    r"|\d{9,13}"
    r")(?![\p{L}\d_])(?![-./:]\d)"
)
_SIX_DIGITS = re.compile(r"\d[ ()./-]?\d(?:[ ()./-]{0,2}[\dA-Z]){4}")
_NAME_WORD = regex.compile(r"[\p{L}][\p{L}\p{M}'’]*(?:-[\p{L}][\p{L}\p{M}'’]+)*")
#: Particles inside names, and titles before them.
PARTICLES = frozenset("van von der den de del della di da dos du la le el al bin ibn ter ten af zu".split())
TITLES = frozenset("dr mr mrs ms prof herr frau sr sra mme mlle dott sir dame pan pani herrn señor señora monsieur madame professor doctor mister miss lady lord".split())
#: The commonest given names of public national statistics, as one feature among others.
GIVEN = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher daniel lisa matthew anthony mark sandra steven paul emily andrew joshua "
    "kenneth kevin brian george edward jason laura amy anna oliver jack harry emma olivia sophie grace hannah peter wolfgang klaus jurgen dieter uwe hans helmut ursula monika petra sabine karin stefan andreas martin "
    "jean pierre michel philippe alain nicolas marie nathalie isabelle catherine claire luc antonio jose manuel francisco juan javier carlos maria carmen ana isabel luis pablo pedro miguel lucia sofia joao paulo tiago "
    "piotr krzysztof andrzej jan tomasz pawel katarzyna agnieszka ewa alexander sergey dmitry andrey alexey vladimir ivan elena olga natalia irina tatiana hiroshi takashi kenji yoko keiko yuki haruto "
    "wei li fang min jing raj amit priya anil sunita mohamed mohammed ahmed ali fatima omar hassan ibrahim aisha giuseppe giovanni marco francesca giulia luca mehmet mustafa fatma ayse lars anders erik ingrid nguyen minh".split()
)
#: Makers of products, and words that products, organisations and places begin or end with.
VENDORS = frozenset("apache amazon google microsoft oracle adobe intel nvidia cisco ibm canonical mozilla samsung sony atlassian".split())
PRODUCT_WORDS = frozenset("server engine cloud studio suite database framework library platform compiler browser protocol cluster monitor gateway project api sdk client toolkit console editor router manager university institute hotel airport bank group inc ltd gmbh corp valley lake mount river bridge port bay beach island mountain hills falls park castle new old fort harbour sea forest".split())


# Words near a number that say what it is, or that it is something else.
PERSON_NUMBER = tuple(
    "ssn|social security|tax id|taxpayer|tax number|steuer|tin|passport|reisepass|pasaporte|passeport|id card|identity card|identity|national id|national insurance|insurance no|insurance number|id number|citizen|"
    "versicherung|sozialversicherung|dni|nif|nie|nino|nhs|cpf|pesel|aadhaar|personal number|personalausweis|ausweis|carte d'identité|sécurité sociale|паспорт|driving licence|driver's license|licence no|insured|insurance policy".split("|")
)
CALL_NUMBER = tuple("call|tel|phone|telefon|telephone|téléphone|tél|teléfono|whatsapp|mobile|handy|cell|fax|rückruf|reach|ring|dial|number is|hotline|appele|joignable|portable|erreichbar|llama|llám|contact|sms|text me|voicemail|signal|тел".split("|"))
THING_NUMBER = tuple(
    "build|part|trace|order|invoice|serial|sku|revision|version|commit|ticket|hash|isbn|lot|batch|model|article|tracking|release|request|job|error|line|host|firmware|logged|ping|rechnung|bestellung|teil|facture|pedido|utc".split("|")
)


def bare(word: str) -> str:
    """Lower case, without accents."""
    low = word.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low.translate(_BARE)) if not unicodedata.combining(c))


_BARE = str.maketrans("łøđæß", "lodas")


@dataclass(slots=True)
class Span:
    kind: str
    start: int
    end: int
    form: int


def _emails(text: str) -> list[Span]:
    found = []
    for m in _EMAIL.finditer(text):
        found.append(Span("email", m.start(), m.end(), 0 if "@" in m.group() else 1))
    return found


def _numbers(text: str) -> list[Span]:
    found = []
    for m in _DIGITS.finditer(text):
        value = m.group()
        if 9 <= sum(c.isdigit() for c in value) <= 15 and value.count("(") == value.count(")"):
            found.append(Span("phone", m.start(), m.end(), 0))
    for m in _ID.finditer(text):
        found.append(Span("id_number", m.start(), m.end(), 0))
    return found


def _addresses(text: str, which: tuple[int, ...] = (0, 1, 2, 3, 4)) -> list[Span]:
    found: dict[tuple[int, int], int] = {}
    pattern = _address_pattern(which)
    for m in pattern.finditer(text):
        start, end = m.span()
        if not any(c.isupper() for c in m.group()):
            continue
        ends = {end: 0}
        side = _SIDE.search(m.group())
        if side:
            ends[start + side.start()] = 0
        town = _TOWN.match(text, end)
        if town:
            for g in ("t1", "t2", "t3"):
                if town.group(g):
                    at = town.end(g)
                    ends[at] = 2 if town.group("pc") else 1
                    after = _PC.match(text, at)
                    if after and not town.group("pc"):
                        ends[after.end()] = 3
        after = _PC.match(text, end)
        if after:
            ends[after.end()] = 3
        for e, form in ends.items():
            found[start, e] = form
            # the street's own words may follow other words
            head = text[start:e]
            if not head[:1].isdigit() and form is not None:
                for w in regex.finditer(r" (?=\p{L})", text[start : m.end()]):
                    s = start + w.end()
                    if pattern.match(text, s):
                        found.setdefault((s, e), form)
    return [Span("address", s, e, f) for (s, e), f in found.items()]


_PLAIN = re.compile(r"[^\W\d_]+")
#: Two capitalised words, with nothing or one particle or initial between them.
_CAPITALISED = regex.compile(r"\p{Lu}[\p{L}\p{M}'’.-]*,? (?:[\p{L}'’]+\.? ){0,2}\p{Lu}")


class CommonWords(frozenset):
    """Words of many distinct texts; ``often`` are those of many rows, copies of a text included, and ``given`` the given
    names known in the corpus; ``times`` says of how many distinct texts each word is."""

    often: frozenset[str] = frozenset()
    given: frozenset[str] = GIVEN
    times: dict[str, int] = {}

    def __init__(self, *_: object):
        self.kinds: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kinds": {}}


def given_names(common: frozenset[str]) -> frozenset[str]:
    return getattr(common, "given", GIVEN)


#: Words of a name, particles not counted; words whose kind a worker remembers.
NAME_WORDS, CACHE = 5, 200_000
_GLUE_BEFORE, _GLUE_AFTER = "_/@.#\\0123456789", "_/@\\0123456789"


def _word_kind(w: str, common: frozenset[str], given: frozenset[str]) -> int:
    """1 a rare word, 2 a particle, 3 a capital that may be an initial, 0 another single letter, 4 a common word that is a
    given name, 5 a common word with a capital, 6 without. Words joined by a hyphen or an apostrophe are as common as
    their parts."""
    low = w.lower()
    if len(w) == 1:
        return 3 if w.isupper() else 0
    if low in PARTICLES:
        return 2
    joined = "-" in w or w[0].islower() and ("'" in w or "’" in w)
    if low not in common and not (joined and all(len(x) < 2 or x in common and x not in given for x in re.split("['’-]", low))):
        return 1
    if low in given or bare(w) in given:
        return 4
    return 5 if w[0].isupper() else 6


_HAN = regex.compile(r"\p{Han}{2,4}")


def _names(text: str, common: frozenset[str]) -> list[Span]:
    """Runs of two to ``NAME_WORDS`` words, with any number of particles among them: capitalised ones however common, and
    such as a given or rare name is in; and single words of two to four Han characters.

    A common word in lower case can only follow a rare or given name in lower case, or precede one after a comma. A title
    starts no name.
    """
    words = [(m.start(), m.end(), m.group()) for m in _NAME_WORD.finditer(text)]
    n, given = len(words), given_names(common)
    found, rare = [], []
    seen = getattr(common, "kinds", {})
    for s, e, w in words:
        kind = seen.get(w)
        if kind is None:
            if len(seen) >= CACHE:
                seen.clear()
            kind = seen[w] = _word_kind(w, common, given)
        before, after = text[s - 1 : s], text[e : e + 1]
        if before == " " == after and kind != 3:
            rare.append(kind)
            continue
        if before in _GLUE_BEFORE and before and not (before == "." and text[s - 2 : s - 1].isupper()) or after in _GLUE_AFTER and after or after == "." and len(w) > 1 and text[e + 1 : e + 2].isalnum():
            rare.append(-1)
        elif kind == 3:
            rare.append(3 if after == "." else 0)
        else:
            rare.append(kind)
    if not text.isascii():
        found += [Span("name", s, e, 2) for (s, e, w), k in zip(words, rare, strict=True) if k == 1 and w[0] > "\u2e7f" and _HAN.fullmatch(w)]
    for i in range(n):
        first = rare[i]
        if first not in (1, 3, 4, 5, 6) or words[i][2].lower() in TITLES:
            continue
        if first == 6 and not (i + 1 < n and text[words[i][1] : words[i + 1][0]] == ", " and rare[i + 1] in (1, 4)):
            continue
        inverted, full, named = False, 1, first in (1, 4, 5)
        for j in range(i + 1, n):
            gap = text[words[j - 1][1] : words[j][0]]
            if gap == ", " and not inverted and rare[j - 1] != 3:
                inverted = True
            elif gap != " " and not (rare[j - 1] == 3 and gap in (". ", ".")):
                break
            if rare[j] in (-1, 0):
                break
            if rare[j] == 6 and (first not in (1, 4) or words[i][2][0].isupper()):
                break
            if rare[j] == 2:
                continue
            full += 1
            if full > NAME_WORDS:
                break
            named = named or rare[j] in (1, 4, 5)
            if named:
                found.append(Span("name", words[i][0], words[j][1] + (rare[j] == 3), int(inverted)))
    return found


def candidates(text: str, common: frozenset[str]) -> list[Span]:
    """Overlapping candidate spans of all kinds."""
    found = []
    low = text.lower()
    if "@" in text or "＠" in text or " dot " in low or "at)" in low or "at]" in low:
        found += _emails(text)
    if _SIX_DIGITS.search(text):
        found += _numbers(text)
    words = _PLAIN.findall(low)
    kinds = set(words)
    which = [k for k, own in _CORE_WORDS.items() if not own.isdisjoint(kinds)]
    if _STREET_END.search(low):
        which.append(1)
    if which and _DIGIT.search(low):
        found += _addresses(text, tuple(sorted(which)))
    if _CAPITALISED.search(text) or any(len(w) > 1 and (w not in common or w in given_names(common)) for w in kinds):
        found += _names(text, common)
    return found


_AT = regex.compile(r" ?(?:@|＠|[\[(]at[\])]) ?| at ", regex.I)
_DOT = regex.compile(r"\.| ?[\[(]dot[\])] ?| dot ", regex.I)


def _nearest(left: str, right: str, words: tuple[str, ...]) -> float:
    """How near the start of one of the words is: 1 right before, towards 0 far away; what follows counts half."""
    best = 0.0
    left, right = " " + left, " " + right
    for w in words:
        at = left.rfind(" " + w)
        if at >= 0:
            best = max(best, 1 - (len(left) - at - len(w)) / 40)
        at = right.find(" " + w)
        if at >= 0:
            best = max(best, 0.5 - at / 60)
    return best


def _beside(text: str, span: Span) -> tuple[str, str, str, str]:
    """The characters and the whole words next to the span; no word where other characters are between."""
    prev, follow = text[span.start - 1 : span.start], text[span.end : span.end + 1]
    before = after = ""
    if prev == " ":
        head = text[max(0, span.start - 30) : span.start - 1]
        got = _NAME_WORD.findall(head)
        before = got[-1] if got and (head.endswith(got[-1]) or head.endswith(got[-1] + ".") and (len(got[-1]) == 1 or got[-1].lower() in TITLES)) else ""
    if follow == " ":
        m = _NAME_WORD.match(text, span.end + 1)
        after = m.group() if m else ""
    return prev, follow, before, after


def _email_measures(text: str, span: Span) -> list[float]:
    value, follow = text[span.start : span.end], text[span.end : span.end + 1]
    user, *rest = _AT.split(value, maxsplit=1)
    parts = _DOT.split(rest[0]) if rest else [""]
    return [
        float(len(parts) > 1), float(parts[-1].isalpha()), float(len(parts[-1]) >= 2), float(any(c.isdigit() for p in parts for c in p)), float(user.lower() in ("git", "svn", "hg", "ssh")),
        float(follow == ":"), float(follow == "/"), float(span.form), float(_AT.search(value).group().strip() == "@"),
    ]


def _number_measures(text: str, span: Span) -> list[float]:
    value = text[span.start : span.end]
    groups = re.findall(r"[0-9]+", value)
    left, right = text[max(0, span.start - 48) : span.start].lower(), text[span.end : span.end + 32].lower()
    for stop in (". ", "\n", "; "):  # what belongs to another sentence says nothing
        left, right = left.rpartition(stop)[2], right.partition(stop)[0]
    before, after = text[span.start - 1 : span.start], text[span.end : span.end + 1]
    return [
        *[_nearest(left, right, w) for w in (PERSON_NUMBER, CALL_NUMBER, THING_NUMBER)],
        float(sum(map(len, groups))), float(len(groups)), float(len(groups[0])), float(len(groups[-1])), float(max(map(len, groups))), float(value[0] == "+"), float(value[0] == "("), float(value[0] == "0"),
        float(min(value.count("."), 4)), float(min(value.count("-"), 4)), float(min(value.count("/"), 2)), float(min(value.count(" "), 6)), float(sum(c.isupper() for c in value[:2])), float(value[-1].isupper()),
        float(before.isupper()), float(before == " "), float(after.isupper()), float(value.count(".") == 3 and all(int(g) < 1000 and len(g) <= 3 for g in groups)),
    ]


def _address_measures(text: str, span: Span, common: frozenset[str]) -> list[float]:
    """Streets and towns may be common words of a corpus, so commonness is asked of the surroundings alone."""
    value = text[span.start : span.end]
    prev, follow, before, after = _beside(text, span)
    first = value.split(" ", 1)[0]
    shout = value.isupper()
    tail = text[span.end : span.end + 8]
    street = [w for w in value.split(",")[0].split(" ") if w[:1].isalpha()]
    return [
        float(span.form), float(first[0].isdigit()), float(first[0].isupper()), float(any(w[0].islower() for w in street[:2]) and not first[0].isdigit()), float(sum(w[0].islower() for w in street) > 3), float(len(street) > 5),
        float(bool(before)), float(bool(before) and before[0].isupper() and not shout), float(bool(before) and before.isupper() and before.lower() not in common),
        float(bool(after) and after[0].isupper() and not shout), float(bool(after) and after.isupper() and after.lower() not in common), float(bool(after) and after[0].islower()),
        float(bool(re.match(r",? ?\d{4,6}\b", tail))), float(bool(re.match(r"\.?, [^\W\d_]", tail))), float(follow in ".;:)!?" and follow != ""), float(follow == ""), float(follow == ","), float(follow == "-"), float(prev == "-"),
        float(shout), float(value[-1].isdigit()), float(follow == "\n"),
    ]


def _name_measures(text: str, span: Span, common: frozenset[str]) -> list[float]:
    value = text[span.start : span.end]
    prev, follow, before, after = _beside(text, span)
    words = _NAME_WORD.findall(value)
    low = [w.lower() for w in words]
    often, given = getattr(common, "often", common), given_names(common)
    # of given names commonness says nothing
    told = {w for w in low if len(w) > 1 and w not in PARTICLES and bare(w) not in given}
    ordinary, repeated = told & common, told & often
    full = [w for w in words if len(w) > 1 and w.lower() not in PARTICLES]
    town = any(w in _STREET_WORDS for w in low)
    return [
        float(len(words)), float(len(full)), float(span.form), float(bare(words[0]) in given), float(bare(words[-1]) in given), float(any(len(w) == 1 for w in words)), float(len(words[-1]) == 1), float(len(words[0]) == 1),
        float(low[0] in PARTICLES), float(any(w in PARTICLES for w in low)), float(all(w.islower() for w in words)), float(value.isupper()), float(all(w[0].isupper() for w in full)),
        float(bool(before) and before.lower() not in common and before[0].isupper() == words[0][0].isupper()), float(before.lower() in given), float(before.lower() in PARTICLES), float(len(before) == 1),
        float(bool(after) and after.lower() not in common and after[0].isupper() == words[-1][0].isupper()), float(after.lower() in given), float(after.lower() in PARTICLES), float(len(after) == 1 and after.isupper()),
        float(text[span.end : span.end + 2] == ", "), float(text[span.start - 2 : span.start] == ", "), float(follow == "-" or prev == "-"), float(prev.isdigit() or follow.isdigit()), float(town), float("'" in value or "’" in value),
        float(any(w in common for w in low)), float(low[0] in ordinary), float(low[-1] in ordinary), float(sum(w in ordinary for w in low)), float(bare(full[0]) in given if full else 0), float(sum(w[0].isupper() for w in words)), float(before.lower() in TITLES), float(sum(w in repeated for w in low)), float(all(w.lower() in repeated for w in full)), float(bool(re.search(r"\d[a-z]? $", text[max(0, span.start - 4) : span.start]))), float(bool(re.match(r",? \d{4,5}", text[span.end : span.end + 8]))),
        float(any(w in VENDORS for w in low)), float(any(w in PRODUCT_WORDS for w in low)), float(after.lower() in PRODUCT_WORDS),
    ]


def measures(text: str, span: Span, common: frozenset[str]) -> list[float]:
    """Numbers about the form of a value and what is around it; as many as its kind has."""
    if span.kind == "email":
        return _email_measures(text, span)
    if span.kind in ("phone", "id_number"):
        return _number_measures(text, span)
    return (_address_measures if span.kind == "address" else _name_measures)(text, span, common)
