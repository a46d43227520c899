"""Made-up personal values and decoys, and made-up surroundings of them, that the model of personal information is fitted on.

Nothing here is taken from a corpus. Values come in families (ways of writing), surroundings in frames; both carry a
number, so that whole families and whole frames can be held out.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.spans import CALL_NUMBER, GIVEN, KINDS, PERSON_NUMBER, PRODUCT_WORDS, THING_NUMBER, VENDORS

# Surroundings of made-up values; {v} is the value.
_FRAMES = {
    "email": [
        "You can e-mail {v} any time.", "Please forward the invoice to {v}, not to me.", "his address is {v}", "Reply-To: {v}", "To: {v}\nSubject: holidays", "sender <{v}> was blocked", "subscribed {v} to the list.", "account of {v} is locked",
        "Login with {v} and reset the password.", "Meine Adresse lautet {v}.", "Anfragen bitte an {v} richten.", "mon courriel : {v}", "contactez {v} avant lundi.", "mi correo es {v}.", "para dudas: {v}", "mój adres to {v}", "пишите на {v}.",
        "questions? {v}", "maintainer={v}", "Signed-off-by: someone ({v})", "invited {v}; no answer yet", "a mail by {v} bounced twice", '"email": "{v}"', "support ticket opened by {v}", "e-mail [{v}]", "bounce for <{v}>",
    ],
    "phone": [
        "Please ring {v} after lunch.", "You can dial {v} for support", "my cell: {v}", "text me on {v}, thanks", "Her mobile number is {v}.", "office {v}, ext 4", "Telefon: {v}", "unter {v} erreichbar", "Meine Handynummer ist {v}.", "Tél. {v}", "joignable au {v}.",
        "mon portable est le {v}", "Mi teléfono es {v}.", "llámame al {v} hoy", "numer telefonu {v}", "тел. {v}", "He left {v} as his number.", "sms from {v} arrived", "voicemail of {v} is full", "the hotline ({v}) is busy", '"phone": "{v}"', "telephone no. {v}", "contact number {v}.", "ph {v}",
        "fax: {v}", "callback requested, {v}", "dialled {v} twice without luck", "if anything burns, phone {v}",
    ],
    "id_number": [
        "His social security number is {v}.", "SSN: {v}", "ssn={v}", "NHS number {v}, born 1971", "national insurance no. {v}", "my passport is {v}", "passport no {v} expires soon", "Passport number: {v}", "identity card {v} was lost", "holder of ID card {v}", "tax number {v} on the form", "TIN {v}",
        "Steuernummer {v} fehlt noch.", "Die Steuer-ID lautet {v}.", "Personalausweis {v} abgelaufen", "Sozialversicherungsnummer: {v}", "numéro de sécurité sociale {v}", "carte d'identité n° {v}", "passeport {v} perdu", "su DNI es {v}.", "NIE {v} caducado", "número de pasaporte {v}", "NIF: {v}", "CPF {v} informado", "PESEL {v}",
        "паспорт {v}", "insurance policy holder {v}", "member insurance number {v} was rejected", "Aadhaar {v}", "driving licence {v} was checked", '"ssn": "{v}"', "{v} is her passport number", "gave {v} as tax id", "entered {v} as the social security number", "lost my identity card ({v})", "applicant's taxpayer id {v}", "with ID number {v}",
        "Please verify national identity number {v}", "insured under {v} since May", "citizen card {v}",
    ],
    "address": [
        "I moved to {v} in spring.", "Send the package to {v}, thanks.", "our new office: {v}", "The shop is on {v}.", "Billing address: {v}", "deliver to {v} before ten", "Meeting point is {v}.", "he grew up at {v} and left", "Meine Anschrift ist {v}.", "Sie wohnt in der Nähe, {v}.", "Bitte an {v} senden",
        "mon adresse : {v}", "il habite au {v} depuis peu", "vivo en {v}.", "la oficina está en {v}, segunda planta", "mieszka przy {v}", "mora na {v} agora", "return to sender: {v}", '"address": "{v}"', "Visit us at {v}.", "parcel left at {v} (neighbour)", "pick-up from {v} at noon", "residing at {v};", "registered seat: {v}", "tenant of {v} complained",
        "the van waits outside {v}",
    ],
    "name": [
        "I talked with {v} yesterday.", "My manager, {v}, agreed.", "Best regards, {v}", "Author: {v}", "{v} wrote the first draft.", "{v} will join on Monday.", "thanks to {v} for the hint", "interview with {v} at noon", "Mrs. {v} called twice.", "Mr {v} is out of office", "Prof. {v} gave the lecture.", "Customer {v} complained.",
        "the patient {v} was seen", "{v} hat gestern angerufen.", "Frau {v} ist krank.", "Herr {v} kommt später", "laut {v} stimmt das", "selon {v}, tout va bien", "M. {v} est absent.", "{v} viendra demain.", "{v} llegó tarde.", "hablé con {v} ayer", "Sr. {v} firmó el contrato", "o {v} já saiu", "{v} wyszedł wcześniej", "{v} позвонил вчера.",
        "assignee={v}", "user: {v}, role: admin", "- {v} (chair)", "reported by {v}, fixed today", "{v}'s laptop is slow", "a note for {v}:", "signed by {v} and two others", "from {v} to the whole team", "met {v} in the lobby", "blame {v}", '"name": "{v}"', "{v} and I had lunch.", "did {v} answer?", "@team ping {v} please", "{v}: works for me", "as {v} said", "contact person {v}",
        "owned by {v} since May", "{v} said hello", "hired {v}.", "{v} is on leave until May",
    ],
}
_DECOY_FRAMES = {
    "email": ["ssh {v} and look", "git clone {v}:group/app.git", "remote: {v}:group/app.git", "yarn add {v}", "upgrade to {v} first", "import {v} from there", "the {v} annotation is missing", "scp file {v}:/tmp", "depends on {v}, pinned", "docker pull {v}"],
    "number": [
        "Invoice {v} is unpaid.", "order no. {v} was shipped to {w}", "commit {v} broke it", "serial number {v}", "SKU {v} is out of stock", "ticket {v} closed, see {w}", "build {v} failed", "build {v} is green but {w} is not", "part {v} replaced by {w}", "part no. {v} fits", "trace id {v}", "trace {v} ends in {w}",
        "logged at {v}", "at {v} UTC the job ended", "since {v} nothing moved", "host {v} is down", "ping {v} works", "firmware {v} installed", "version {v} is out", "tracking number {v}", "article {v} costs more", "batch {v} of the run", "lot {v} was recalled", "ISBN {v}", "model {v} is obsolete", "the log has {v} lines",
        "request {v} timed out", "job {v} was retried as {w}", "checked rows {v}", "the sum is {v}.", "error {v} in module {w}", "Rechnung {v} bezahlt", "Bestellung {v}", "Teil {v} fehlt", "facture {v} payée", "pedido {v} enviado", "line {v} of the file", "id={v}",
    ],
    "address": ["turn into {v} and go on", "the scene in {v} is short", "the shop sold 12 {v} posters", "we read {v} last week", "in 3 days {v} will be shut", "chapter 4 {v}"],
    "name": [
        "We deployed {v} last night.", "{v} crashed again.", "the port to {v} took a week", "{v} is a tool for teams.", "works with {v} and {w}", "migrated from {v} to {w}", "{v} and {w} are compatible", "docs of {v} are thin", "a fork of {v}", "{v} support was dropped", "The {v} table is empty", "install {v} first", "{v} wird abgeschaltet.",
        "{v} release notes", "flight to {v} was late", "the weather in {v} is bad", "{v} lies in the north", "class {v} is abstract", "See {v} for more.", "project {v} starts soon", "the {v} module and the {w} module", "{v} has 12 columns", "service {v} restarted", "nothing in {v} changed",
    ],
}

# Sentences around made-up values; they name no person and no place to reach one.
SURROUNDINGS = [
    "The nightly job was moved to a larger machine and ends before six now.", "We decided to keep the old format until the next release.", "Retry with a longer timeout, the first call always fails.", "The index was rebuilt after the schema change.",
    "Nobody remembers why the flag was added", "The meeting notes are in the shared folder.", "Deploy finished without errors, all checks are green.", "User asked for a summary of the open tasks.", "Running the tests again after the merge", "The cache is cleared whenever a config file changes.",
    "Please review the draft before the end of the week.", "It took 45 minutes to copy 12 tables.", "Build 2381 passed on the second attempt.", "Version 3.14.2 fixes the memory leak.", "The log shows 1048576 bytes written in 3.7 seconds.", "Port 8443 is already in use.", "Exit code 137 means that the container was out of memory.",
    "See section 4.2 of the handbook for details.", "def load(path): return open(path).read()", "SELECT count(*) FROM orders WHERE status = 'open'", "git commit -m 'fix typo in the readme'", "TypeError: unsupported operand type in line 88", "The function returns None if the key is missing.", "TODO remove this once the new parser is in place",
    "import numpy as np; x = np.zeros(10)", "Edited the retry logic, backoff doubles now up to 64 seconds.", "The Data Platform team owns this service.", "Release Notes for the spring version are ready.", "Open the Control Panel and choose Network Settings.", "The Quick Start Guide is out of date.", "Monday and Tuesday are holidays this year.",
    "On Friday the Main Branch was frozen.", "The Great Migration is planned for next quarter.", "English and German texts are handled alike.", "Visual effects were added in the last step.", "We met in the big room on the second floor.", "The train was late again, so the workshop started at half past nine.", "She said that the garden needs water.",
    "He bought bread, cheese and two bottles of wine.", "My neighbours have a new dog.", "The doctor recommended more sleep and less coffee.", "Their house is near the river.", "The lease ends in two years and can be extended.", "Lunch was good but the soup was cold.", "I forgot the umbrella in the office.", "The children played football until dark.",
    "It rained all day in the mountains.", "A package was left at the door.", "The invoice has not been paid yet.", "Thanks a lot for the quick answer!", "Could you send the slides once more?", "What is the status of the open questions?", "Looks good to me, ship it.", "I agree with the proposal, with one small change.", "The budget for travel was cut by 20 percent.",
    "The concert starts at 20:30 and the doors open an hour before.", "On 2023-04-17 the certificate expired.", "The price went from 19.99 to 24.50.", "Order more paper for the printer.", "The lecture covers graphs, trees and sorting.", "New rules for expenses apply from May.", "Both teams work with the same backlog.",
    "Die Besprechung wurde auf nächste Woche verschoben.", "Der Bericht liegt im gemeinsamen Ordner.", "Wir haben den Fehler gefunden und behoben.", "Die Tabelle hat zwölf Spalten und ist sehr langsam.", "Bitte prüfen Sie den Entwurf bis Freitag.", "Das Wetter war schön, also gingen wir zu Fuß.", "Der Server läuft seit drei Wochen ohne Neustart.",
    "La réunion a été reportée à lundi.", "Le rapport sera prêt demain matin.", "Nous avons corrigé une erreur dans le calcul.", "Il faut vérifier les droits avant la mise en ligne.", "La reunión fue breve y útil.", "El informe está en la carpeta compartida.", "Hay que revisar los datos antes de publicar.",
    "O relatório ainda não está pronto.", "A reunião começa às dez.", "Spotkanie zostało przełożone na wtorek.", "Raport jest gotowy do sprawdzenia.", "Отчёт будет готов завтра утром.", "Встреча перенесена на понедельник.",
    "user: can you look at the failing test; assistant: the fixture is missing", "Tool call returned 3 results, the second one matches.", "Saved to memory: prefers short answers with code.", "The plan has three steps: read, change, verify.", "Context was cut, reading the file again.", "Searching the workspace for usages of the class",
    "Found 27 matches in 9 files.", "The queue holds 64 jobs and is polled every 30 seconds.", "status=done attempts=2 elapsed=812ms", "key: value, list: [1, 2, 3], nested: {a: b}", "WARN retrying request after 503", "INFO started worker on 10.1.4.22", "commit 9f3c2ab changes the default", "The checksum is 5d41402abc4b2a76.",
    "Everything is documented on the wiki page.", "The second option is cheaper but slower.", "Rust and Python bindings share one core.", "Docs and examples were moved to another folder.", "The Summer School has room for thirty students.", "Chapter Two explains the Binary Search Tree.", "The Golden Rule of caching is to measure first.",
    "THE SECOND RUN STOPPED EARLY, CHECKED WITH THE ROLLBACK SCRIPT", "REMOVED THE WRITE-ONLY FLAG AND A PULL-UP OF THE HELPER", "FIXED THE ORDR OF THE COLUMNS AGAIN", "WRONG DEFUALT IN THE CONFIG, REPLACED BEFORE THE NIGHTLY RUN", "PATCH B7D40C19 REPLACED THE OLD LOADER", "SEE C0FFEE42 FOR THE LAST STEP", "CLEAN-UP TASKS WAIT IN THE QUEUE",
    "COMMENTS ON THE SRVICE ARE CLOSED", "NACH DEM NEUSTART IST DIE TABELLE LEER", "LA TÂCHE A ÉTÉ TERMINÉE SANS ERREUR", "MOVED THE CHECK TO THE OTEHR SIDE OF THE STREAM", "PLEASE READ THE SET-UP GUIDE FIRST", "NOTHING CHANGED SINCE THE LAST BUILD", "TWO TESTS FAILED, ONE WAS SKIPPED, TEH REST PASSED",
]
SURROUNDINGS += [x.upper() for x in SURROUNDINGS[::2] if not x.isupper()]


class Maker:
    """Made-up values; the same sequence for the same seed. ``family`` is the number of the last value's way of writing."""

    def __init__(self, seed: int, frequent: list[str] | None = None, copied: list[str] | None = None):
        self.rng = np.random.default_rng(seed)
        self.frequent = frequent or []
        self.copied = copied or []
        self.given = sorted(GIVEN)
        self.family = 0

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def _way(self, options):
        self.family = int(self.rng.integers(len(options)))
        return options[self.family]()

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def odd(self, parts: int = 2) -> str:
        heads, tails = ["bren", "cal", "dor", "fen", "gar", "hol", "kes", "lor", "mar", "nor", "pel", "quan", "rosk", "sel", "tor", "ul", "vor", "wes", "yan", "zel", "øst", "süd", "łab"], ["bury", "dale", "mund", "etti", "ovsky", "sson", "wick", "mont", "ault", "ez", "mann", "ier", "ides", "ham", "åker", "owski", "rin", "oux"]
        return "".join(self.pick(heads) for _ in range(parts - 1)) + self.pick(tails)

    def email(self) -> str:
        g, f = self.pick(self.given), self.odd()
        user = self.pick([f"{g}.{f}", f"{g[0]}{f}{self.digits(2)}", f"{g}_{f}+{self.odd()}", f"{g}-{f}", f"{f}{self.digits(3)}", g])
        parts = [self.pick(["mail", "post", "web", "corp", self.odd()])] * int(self.rng.random() < 0.4) + [self.odd() + self.pick(["", "-mail", "-net"]), self.pick(["com", "org", "net", "example", "test", "invalid", "de", "co", "io", "fr"])]
        host = ".".join(parts)
        plain = lambda: f"{user}@{host}"
        return self._way([plain, plain, plain, lambda: f"{user} @ {host}", lambda: f"{user}(at){host}", lambda: f"{user} [at] {' [dot] '.join(parts)}", lambda: f"{user} at {' dot '.join(parts)}", lambda: f"{user}@{host}".upper()])

    def phone(self) -> str:
        d = self.digits
        return self._way([
            lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"+1{d(10)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+44 7{d(3)} {d(6)}", lambda: f"07{d(3)} {d(6)}", lambda: f"0044 (0)7{d(3)} {d(3)} {d(3)}", lambda: f"+49 {d(2)} {d(5)} {d(3)}",
            lambda: f"0{d(2)}/{d(5)}-{d(3)}", lambda: f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+34 {d(3)} {d(2)} {d(2)} {d(2)}",
            lambda: f"+{self.pick(['351', '48', '81', '7', '55'])} {d(2)} {d(3)} {d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"020 {d(4)} {d(4)}",
        ])

    def id_number(self) -> str:
        d, a = self.digits, lambda: self.pick("ABCDEGHJKLMNPRSTWXZ")
        return self._way([
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{a()}{a()}{d(6)}{a()}", lambda: f"{a()}{a()} {d(2)} {d(2)} {d(2)} {a()}", lambda: f"{d(8)}{a()}", lambda: f"{a()}{d(8)}", lambda: f"{a()}{a()}{d(7)}",
            lambda: f"{a()}{a()}{d(2)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"{self.pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{d(11)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"{d(4)} {d(4)} {d(4)}",
            lambda: f"{a()}{d(2)}{a()}{d(2)}{a()}{d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{a()}{d(7)}{a()}", lambda: f"{d(9)}", lambda: f"{a()}-{d(7)}-{a()}",
        ])

    def place(self) -> str:
        t = self.odd().capitalize()
        return self.pick([t, t, t, f"{self.pick(['Port', 'Saint', 'San', 'New', 'Bad', 'Villa', 'East', 'Mount', 'El', 'Fort', 'Santa'])} {t}", f"{self.pick(['Sainte', 'Nieder', 'Ober', 'Upper', 'Saint', 'Stoke'])}-{t}", f"{t} {self.pick(['Bay', 'Beach', 'Nova', 'Falls', 'City', 'Spa', 'Park'])}"])

    def address(self) -> str:
        s, no, pc, town = self.odd().capitalize(), int(self.rng.integers(1, 2600)) if self.rng.random() < 0.2 else int(self.rng.integers(1, 260)), self.digits(5), self.place()
        if self.rng.random() < 0.3:
            s = f"{self.pick(['Old', 'North', 'High', self.odd().capitalize()])} {s}"
        kind = self.pick(["Street", "St", "Rd", "Road", "Ave", "Avenue", "Lane", "Close", "Drive", "Blvd", "Court", "St.", "Grove", "Way", "Place", "Terrace"])
        english = f"{no}{self.pick(['', '', '', 'a', 'c'])} {s} {kind}{self.pick(['', '', '', '', '', ' NW', ' South'])}"
        unit = f"{self.pick(['Apt', 'Flat', 'Unit', 'Suite'])} {self.digits(2)}, {english}"
        uk = f"{self.pick('ABELMNSW')}{self.pick('ABELMNRS')}{self.digits(1)} {self.digits(1)}{self.pick('ABDEFGH')}{self.pick('ABDEFGH')}"
        value = self._way([
            lambda: english, lambda: f"{english}, {town}", lambda: f"{english}, {town}", lambda: f"{english}, {town} {pc}", lambda: unit, lambda: f"{unit}, {town}", lambda: f"{s}str. {no}, {pc} {town}", lambda: f"{s}{self.pick(['gasse', 'weg', 'straße', 'platz', 'allee'])} {no}, {pc} {town}",
            lambda: f"{no} {self.pick(['rue', 'avenue'])} {self.pick(['des ', 'de la ', 'du ', ''])}{s}, {pc} {town}", lambda: f"{self.pick(['Calle', 'Avenida', 'Rua'])} {s} {no}, {self.digits(1)}º {self.pick('ABC')}, {pc} {town}", lambda: f"{self.pick(['PO Box', 'P.O. Box', 'Postfach'])} {self.digits(4)}, {town} {pc}",
            lambda: f"{self.pick(['PO Box', 'Postfach'])} {self.digits(int(self.rng.integers(2, 6)))}, {town}", lambda: f"{english}, {town} {uk}", lambda: f"{self.pick(['Via', 'ul.', 'Calle'])} {s} {no}, {pc} {town}",
        ])
        return value.upper() if self.rng.random() < 0.15 else value.rstrip(".")

    def name(self) -> str:
        g, f, f2 = (self.pick(self.given) if self.rng.random() < 0.4 else self.odd()).capitalize(), self.odd().capitalize(), self.odd().capitalize()
        if self.frequent and self.rng.random() < 0.3:  # family names that the corpus uses often, or that are ordinary words
            f = self.pick(self.frequent).capitalize()
            g = self.pick(self.given).capitalize() if self.rng.random() < 0.85 else self.odd().capitalize()
        initial = lambda: self.pick("ABCDEFGHJKLMNPRSTVW")
        han = lambda: self.pick("王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗") + "".join(self.pick("伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建文") for _ in range(int(self.rng.integers(1, 3))))
        plain = lambda: f"{g} {f}"
        value = self._way([
            plain, plain, plain, plain, plain, lambda: f"{f}, {g}", lambda: f"{f}, {g}", lambda: f"{g} {initial()}. {f}", lambda: f"{initial()}. {f}", lambda: f"{initial()}. {f}", lambda: f"{g} {self.pick(['van', 'von', 'de', 'della', 'van der', 'de la', 'bin', 'al'])} {f}", lambda: f"{g} {f}-{f2}", lambda: f"{g}-{self.pick(self.given).capitalize()} {f}",
            lambda: f"{g} {self.pick(self.given).capitalize()} {f}", lambda: f"{g} {f} {f2}", lambda: f"{g} {self.pick(['O’', 'Mc', 'D’'])}{f}", han, lambda: f"{g} {self.pick(['del', 'dos', 'da', 'de'])} {self.pick(self.given).capitalize()} {f} {f2}",
            lambda: f"{g} {self.pick(self.given).capitalize()} {f} {f2}", lambda: f"{self.odd().capitalize()} {f}", lambda: f"{self.odd().capitalize()} {f}",
        ])
        case = self.rng.random()
        return value.upper() if case < 0.1 else value.lower() if case < 0.32 and "." not in value else value

    def decoy(self, kind: str) -> str:
        d, pick, odd = self.digits, self.pick, self.odd
        if kind == "email":
            return pick([f"git@code.{odd()}.example", f"git@{odd()}.com", f"{odd()}-{odd()}@{d(1)}.{d(2)}.{d(2)}", f"{odd()}@{d(1)}.{d(1)}.{d(2)}", f"root@{odd()}", f"@{odd()}", f"{odd()}@latest", f"hg@{odd()}.org"])
        if kind == "number":
            stamp = f"{int(self.rng.integers(1990, 2035))}{int(self.rng.integers(1, 13)):02}{int(self.rng.integers(1, 29)):02}"
            time = f"{int(self.rng.integers(24)):02}{int(self.rng.integers(60)):02}{int(self.rng.integers(60)):02}"
            ip = ".".join(str(int(x)) for x in self.rng.integers(1, 255, 4))
            return pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{stamp} {time}", f"{stamp}-{time}", f"{stamp}{time}", ip, ip, d(12), d(10), d(8), f"{d(4)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{pick('ABX')}{d(8)}", f"{d(2)}.{d(3)}.{d(4)}", f"{pick('ABCX')}{pick('ABX')}{d(6)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(1)}.{d(3)}.{d(3)}.{d(3)}", f"{d(1)} {d(3)} {d(3)} {d(3)}"])
        if kind == "address":
            return pick([f"{odd().capitalize()} {pick(['Street', 'Lane', 'Road', 'Hill'])}", f"the {odd().capitalize()} Street", f"{d(4)} files per drive", f"{odd().capitalize()} Square"])
        g, f = pick(self.given).capitalize(), odd().capitalize()
        if self.frequent and self.rng.random() < 0.3:
            a, b = pick(self.frequent).capitalize(), pick(self.frequent).capitalize()
            return pick([f"{a} {b}", f"{a} {b}", f"{a} {f}", f"{f} {b}", f"The {b}", f"{a}, {b}", f"{f}, {b}", f"{b.lower()} {f.lower()}"])
        if self.copied and self.rng.random() < 0.15:  # words of texts that very many rows repeat
            return f"{pick(self.copied)} {pick(self.copied)}"
        vendor, product = pick(sorted(VENDORS)).capitalize(), pick(sorted(PRODUCT_WORDS)).capitalize()
        return pick([f, f, g, f"{vendor} {f}", f"{vendor} {f}", f"{f} {product}", f"{f} {product}", f"{g} {product}", f"Port {f}", f"{f} Valley", f"Lake {f}", f"Mount {f}", f"{f} River", f"New {f}", f"{f} {pick(['Street', 'Road', 'Square'])}", f"{g} {pick(['Street', 'Square', 'Bridge'])}"])


def made_texts(surroundings: list[str], made: int, seed: int = 23, frequent: list[str] | None = None, copied: list[str] | None = None) -> list[tuple[str, set[tuple[str, int, int]], int, int, tuple[int, int]]]:
    """Texts with values at known places, and texts with decoys at none, each with the numbers of its frame and of its
    value's family (-1: none), and with the made-up part's place; around it are the sentences of ``surroundings``."""
    maker = Maker(seed, frequent, copied)
    found = []

    def around(piece: str) -> tuple[str, int]:
        before = maker.pick(surroundings).strip() + maker.pick([" ", "\n", " "]) if surroundings and maker.rng.random() < 0.7 else ""
        after = maker.pick([" ", "\n", " "]) + maker.pick(surroundings).strip() if surroundings and maker.rng.random() < 0.7 else ""
        return before + piece + after, len(before)

    def amid(piece: str) -> tuple[str, int]:
        """The piece anywhere inside a sentence: its surroundings say nothing."""
        words = maker.pick(surroundings).split(" ") if surroundings else ["said"]
        k = int(maker.rng.integers(len(words) + 1))
        before = " ".join(words[:k]) + " " * (k > 0)
        return before + piece + maker.pick([" ", " ", ", ", ". ", "; "]) + " ".join(words[k:]), len(before)

    hints = {"phone": CALL_NUMBER, "id_number": PERSON_NUMBER}
    for kind in KINDS:
        for n in range(made):
            value = getattr(maker, kind)()
            family, frame = maker.family, -1
            if n % 2:
                frame = int(maker.rng.integers(len(_FRAMES[kind])))
                piece = _FRAMES[kind][frame]
                text, at = around(piece.replace("{v}", value))
                start, length = at + piece.index("{v}"), len(piece) - 3 + len(value)
            else:
                hint = maker.pick(hints[kind]) if kind in hints else ""
                ahead = maker.rng.random() < 0.75
                lead = hint + maker.pick([" ", ": ", " no. ", " is ", " at ", " = "]) if hint and ahead else ""
                trail = maker.pick([f" as {hint}", f" ({hint})", f" is the {hint}"]) if hint and not ahead else ""
                lead = lead.capitalize() if maker.rng.random() < 0.4 else lead
                text, at = amid(lead + value + trail)
                start, length = at + len(lead), len(lead + value + trail)
            found.append((text, {(kind, start, start + len(value))}, frame, family, (at, at + length)))
    for kind, frames in _DECOY_FRAMES.items():
        for n in range(made if kind != "address" else made // 3):
            value, frame = maker.decoy(kind), -1
            if n % 2 or kind == "email":
                frame = int(maker.rng.integers(len(frames)))
                piece = frames[frame].replace("{v}", value).replace("{w}", maker.decoy(kind))
                text, at = around(piece)
            else:
                hint = maker.pick(THING_NUMBER) + maker.pick([" ", ": ", " no. ", " is "]) if kind == "number" else ""
                piece = hint + value
                text, at = amid(piece)
            found.append((text, set(), 1000 + frame if frame >= 0 else -1, -1, (at, at + len(piece))))
    return found
