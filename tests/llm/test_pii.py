"""Personal information in sentences written by hand, which no part of the fit has seen."""

import re

import pytest

from tidemark.llm.givennames import learned_given
from tidemark.llm.pii import PersonalModel, fitted_model
from tidemark.llm.spans import GIVEN, candidates

#: ⟦kind|value⟧ marks what is to be found.
SENTENCES = """
Could somebody remind ⟦email|tkowalczyk84@example.org⟧ that the door code changed?
The newsletter still goes to ⟦email|old.account+news@mail.example.com⟧, who retired.
Owner of the calendar is ⟦email|B.Haddad@university.example.edu⟧ until June.
We got a complaint through ⟦email|info@kleinegasse.example⟧ about the noise.
CC'd ⟦email|lucia_m@example.net⟧ and archived the thread.
Write to ⟦email|support [at] harbour [dot] example⟧ and never mind.
The form rejected ⟦email|x.y.z@sub.domain.example.co.uk⟧ as invalid.
forwarded by ⟦email|GROSS@EXAMPLE.DE⟧ without a comment
The key was added for root@buildhost yesterday.
Pull from git@code.example.com:team/site.git first.
Pinned left-pad@1.3.0 in the lock file.
We need to bump react-dom@18.2.0 soon.
My neighbour's phone is ⟦phone|+44 20 7946 0958⟧ if you need the key.
The plumber can be reached under ⟦phone|+49 30 901820⟧ on weekdays.
Rang ⟦phone|(212) 555-0147⟧ but nobody picked up.
Fax the signed copy to ⟦phone|01.42.68.53.00⟧ today.
She texted from ⟦phone|+34 612 34 56 78⟧ at midnight.
Phone the clinic: ⟦phone|0161 496 0753⟧.
Bitte um Anruf, Handy ⟦phone|+43 664 1234567⟧.
appelez-moi au ⟦phone|06 12 34 56 78⟧ ce soir
Sarah's new cell is ⟦phone|415-555-0132⟧.
For emergencies dial ⟦phone|+81 90 1234 5678⟧ at once.
The order number 4155550132 was cancelled.
Invoice 2023-118-0042 is overdue.
Server 10.20.30.40 answered after the reboot.
The dump of 20231105 143000 is corrupt.
Tracking number 9400 1118 9922 3456 has not moved.
The checksum 4917730021 did not match.
ISBN 978-3-16-148410-0 is out of print.
Her NHS number ⟦id_number|943 476 5919⟧ was on the letter.
Copied social security number ⟦id_number|078-05-1120⟧ from the card.
Passport ⟦id_number|C01X00T47⟧ must be renewed.
The clerk wrote down passport number ⟦id_number|533380006⟧ twice.
NINO ⟦id_number|AB 12 34 56 C⟧ is not on file.
His DNI, ⟦id_number|12345678Z⟧, was photographed.
Personalausweis ⟦id_number|T22000129⟧ lag auf dem Tisch.
Numéro de sécurité sociale : ⟦id_number|2 84 05 88 157 096 42⟧.
Aadhaar ⟦id_number|2345 6789 0124⟧ was linked to the account.
tax id ⟦id_number|65 929 970 489⟧ belongs to the landlord
Steuer-ID ⟦id_number|86095742719⟧ wurde mitgeteilt.
CPF ⟦id_number|529.982.247-25⟧ no cadastro.
PESEL ⟦id_number|44051401359⟧ is required here.
Part number 943-47-5919 does not fit.
The trace 078-05-1120 ends at the proxy.
build 533380006 was promoted
Firmware C01X00T47 shipped in spring.
She has lived at ⟦address|221B Baker Street, London⟧ for years.
The couriers leave everything at ⟦address|12 Elm Grove, Leeds⟧, sadly.
Letters go to ⟦address|1600 Pennsylvania Avenue NW, Washington 20500⟧.
Our dentist moved to ⟦address|Flat 3, 48 Castle Road, Bristol⟧.
Die Werkstatt ist in der ⟦address|Lindenstraße 17, 10969 Berlin⟧.
Rechnung an ⟦address|Hauptstr. 5, 80331 München⟧ schicken.
Le siège est au ⟦address|10 rue de Rivoli, 75004 Paris⟧.
La tienda está en ⟦address|Calle Mayor 25, 28013 Madrid⟧.
Postal address: ⟦address|PO Box 1234, Wellington 6140⟧.
Pick me up at ⟦address|77 Massachusetts Ave⟧ after seven.
Turn left into the next street and walk 5 minutes.
There were 40 rows in the Street table.
We took the long road and saw 3 lane markings.
The minutes were taken by ⟦name|Grace Young⟧ as always.
⟦name|Will Hunter⟧ and two others stayed behind.
Nobody told ⟦name|Ingeborg Lindqvist⟧ about the move.
Interview ⟦name|Nguyen Thi Minh Khai⟧ next week.
Dr. ⟦name|Helen Okonkwo⟧ signed the prescription.
Frau ⟦name|Sabine Krüger⟧ hat den Termin abgesagt.
Herr Müller ist im Urlaub.
J'ai vu ⟦name|Catherine Dubois⟧ hier soir.
Hablamos con ⟦name|Miguel Fernández⟧ del contrato.
The keynote is by ⟦name|María del Carmen García López⟧ this year.
A parcel for ⟦name|J. Pemberton⟧ arrived.
Please thank ⟦name|Thomas van der Berg⟧ for the slides.
The author, ⟦name|Müller, Andreas⟧, disagrees.
⟦name|PIOTR NOWAK⟧ LEFT EARLY TODAY.
ask ⟦name|emily hawthorne⟧ for the spare key
Yesterday ⟦name|Kenji Watanabe⟧ fixed the lamp.
The new hire is ⟦name|Aisha Abdullahi⟧, starting Monday.
Signed: ⟦name|David O'Connor⟧
Oracle Database was down for an hour.
We are moving from Apache Kafka to Amazon Kinesis.
Lake Geneva was frozen.
The Golden Gate Bridge is closed.
Visual Studio crashed twice.
Alice went home.
The Monday Report is late.
New York is expensive.
""".strip().split("\n")

FILLER = "The meeting about the new budget was moved to friday|nobody answered the letter of the landlord|we walked home because the bus was late|die rechnung für den termin ist noch nicht bezahlt|the report says that the server was down for an hour and the table lost rows|please thank the team for the slides and the keynote|the golden bridge is closed on monday|die werkstatt ist im urlaub|the order and the invoice were cancelled|turn left into the next street".split("|")
COMMON = frozenset(w for f in FILLER for w in re.findall(r"\w+", f.lower())) | frozenset("to of at by in on is was the a and for from as new out it his her she he we our were are been home early today yesterday please ask young hunter grace will go went report visual golden gate bridge studio lake moving database expensive frozen signed interview author twice".split())

#: Everyday words are common in any corpus of some size.
COMMON |= {w for line in SENTENCES for w in re.findall(r"[^\W\d_]+", re.sub(r"⟦[^⟧]*⟧", " ", line).lower())}


@pytest.fixture(scope="module")
def model():
    return PersonalModel([f.capitalize() + "." for f in FILLER] * 20, COMMON, made=1500)


def parsed(line):
    text, truth, at = "", set(), 0
    for m in re.finditer(r"⟦(\w+)\|([^⟧]+)⟧", line):
        text += line[at : m.start()]
        truth.add((m.group(1), len(text), len(text) + len(m.group(2))))
        text += m.group(2)
        at = m.end()
    return text + line[at:], truth


def test_sentences_written_by_hand(model):
    counts = {k: [0, 0, 0] for k in ("email", "phone", "id_number", "address", "name")}
    wrong = []
    for line in SENTENCES:
        text, truth = parsed(line)
        got = {(s.kind, s.start, s.end) for s, _ in model.select([text])[0]}
        for k, n in counts.items():
            n[0] += sum(x[0] == k for x in got & truth)
            n[1] += sum(x[0] == k for x in got - truth)
            n[2] += sum(x[0] == k for x in truth - got)
        wrong += [(text[a:b], k, "more") for k, a, b in got - truth] + [(text[a:b], k, "lost") for k, a, b in truth - got]
    for k, (hit, more, lost) in counts.items():
        assert hit / (hit + more) >= 0.85 and hit / (hit + lost) >= 0.85, f"{k} {counts} {wrong}"


def test_given_names_are_learned():
    people = ["Anna", "Peter", "Zubeida", "Tarkan"]
    families = ["Velmor", "Drosk", "Quallen", "Istrup", "Wenbach"]
    texts = [f"minutes taken by {g} {f} on monday {i}" for i, (g, f) in enumerate((g, f) for g in people for f in families)]
    texts += [f"we installed {v} {f} in the lab" for v in ("Trigon", "Halvex") for f in families]
    common = frozenset("minutes taken by on monday we installed in the lab zubeida tarkan trigon halvex".split())
    got = learned_given(texts, common)
    assert {"zubeida", "tarkan"} <= got and not {"trigon", "halvex"} & got
    assert learned_given([], common) == GIVEN


def test_long_names_and_long_lists():
    assert any(s.kind == "name" and s.end - s.start == 30 for s in candidates("Maria del Carmen Garcia Lopez y asked", frozenset(["asked"]))) or any(s.kind == "name" and s.end - s.start == 29 for s in candidates("Maria del Carmen Garcia Lopez asked", frozenset(["asked"])))
    lines = "\n".join(f"near {i} Great Hill Road, Norwick" for i in range(1, 12_000))
    assert sum(s.kind == "address" for s in candidates(lines, frozenset(["near"]))) >= 11_999


def test_titles_start_no_name():
    assert not [s for s in candidates("Herr Müller kam", frozenset(["kam"])) if s.kind == "name" and s.start == 0]


def test_given_names_come_from_every_text(spark):
    """Names that stand in few of very many texts; a sample of texts once lost those outside it."""
    from pyspark.sql import functions as F

    from tidemark.llm import givennames as G

    people = ["Anna", "Peter", "Zubeida", "Tarkan", "Oyelaran", "Ximbu", "Quetta", "Wanjiru"]
    families = ["Velmor", "Drosk", "Quallen", "Istrup", "Wenbach"]
    texts = [(f"minutes taken by {g} {f} on monday {i}",) for i, (g, f) in enumerate((g, f) for g in people for f in families)]
    filler = spark.range(160_000).select(F.format_string("the report %d of the budget was moved on monday", "id").alias("text"))
    given = fitted_model(filler.unionByName(spark.createDataFrame(texts, "text string")), made=40).common.given
    assert {p.lower() for p in people} <= given
    few, common = spark.createDataFrame(texts + [("we installed Trigon Velmor in the lab",), ("we installed Trigon Drosk in the lab",)], "text string"), frozenset("minutes taken by on monday we installed in the lab".split())
    right = learned_given([r.text for r in few.collect()], common)
    assert right == G.learned_given_of(few, common) == G.learned_given_of(few, common, block=0)


def test_a_word_that_seldom_stands_as_a_name_is_none():
    """In very many texts even "For" goes with rare words, and stands where names do."""
    from tidemark.llm.spans import CommonWords

    texts = [f"minutes taken by {g} {f} on monday {i}" for i, (g, f) in enumerate((g, f) for g in ("Anna", "Peter", "Tarkan", "For") for f in ("Velmor", "Drosk", "Quallen"))]
    common = CommonWords("minutes taken by on monday for tarkan".split())
    common.times = {"for": 5000, "tarkan": 20}
    got = learned_given(texts, common)
    assert "tarkan" in got and "for" not in got
