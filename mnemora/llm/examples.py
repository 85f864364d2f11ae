"""The labelled table that the personal-data model is trained on, written without regard to any corpus.

Each line is a sentence whose places hold a kind: {name}, {email}, {phone}, {id_number} and {address} are personal,
{c} a component, {r} a reference, {n} a number are not.  The places are filled by rule, so one line makes many labelled
sentences; people come from a table of known ones or are put together from parts of their names.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "address", "name")

SENTENCES = """
Dear {name}, your appointment has been moved to Thursday.
Kind regards, {name}
Best wishes from {name} and {name}
Yours sincerely, {name}, head of purchasing
The keys were handed over to {name} this morning.
{name} will take over the night shift from {name}.
I met {name} at the fair; the card says {email}.
Could you forward this to {name}, please? The number is {phone}.
Our landlord {name} can be called on {phone} between nine and five.
New tenant: {name}, {address}, {phone}
Patient {name}, born in spring, {idlabel} {id_number}, was sent home.
Guardian: {name}. Telephone: {phone}. Mail: {email}.
Applicant {name} ({idlabel} {id_number}) lives at {address}.
The parcel for {name} went to {address} instead.
Deliver to: {name}, {address}
Bill to {address}; attention {name}.
Their office moved from {address} to {address}.
The site visit is at {address}, ask for {name}.
We parked in front of {address} and waited.
Return label: {address}
Home: {address}. Mobile: {phone}.
Emergency number of the caretaker: {phone}
Fax {phone}, phone {phone}
Text me on {phone} or write to {email}
My new number is {phone}.
Reach the help desk under {phone}, or {email} at night.
Caller {phone} asked about order {ticket} twice.
The caller from {phone} hung up; {name} tried {phone} again.
Newsletter bounced for {email} and {email}
Subscription of {email} ends in {n} days.
From: {email}
To: {name} <{email}>
Reply-To: {email}
user={email} ip={ip} status={n}
login failed for {email} from {ip}, attempt {n}
{email} opened {r} and attached a trace.
Account {email} was merged with {email}, {n} rows changed.
Please add {email} to the list and remove {email}.
Signed in as {email}
Passenger {name}, {idlabel} {id_number}, seat {n}
The clerk noted {idlabel}: {id_number} on the form.
Enter your {idlabel} ({id_number}) in field {n}.
{idlabel} {id_number} expired last May.
A copy with {idlabel} {id_number} is in the folder of {name}.
Someone typed {id_number} into the comment field of {r}.
The export has {id_number}, {name} and {email} in one row.
Found {id_number} and {phone} in the cache of {c}.
id={id_number} tel={phone} mail={email}
{"contact": "{name}", "phone": "{phone}", "mail": "{email}"}
{"holder": "{name}", "document": "{id_number}", "street": "{address}"}
{"to": "{email}", "retries": {n}}
{name};{address};{phone}
{name},{email},{phone},{n}
{name} | {phone} | {r}
Attendees: {name}, {name}, {name}
Attendees: {name}; {name}
Minutes by {name}, approved by {name}
Author: {name}
Assigned to {name} since Monday.
Owner of {c}: {name}, deputy {name}
{name} fixed {r} in {c} and {name} tested it.
{name} suggested {n} retries for {c}.
{name} and {name} argue over {r}.
{name} found the cause: {c} kept {n} sockets open.
It was {name} who raised {n} to {n}.
The change by {name} breaks {c}.
Credit goes to {name} for the chart.
Let {name} know when {c} is back.
We promised {name} an answer on {r} by noon.
Interview with {name}: prefers {c} over {c}.
Question from {name}: does {c} need {n} threads?
As {name} said, {r} can wait.
On call this week: {name} ({phone})
Escalate to {name}, {email}, after {n} minutes.
{name} is on leave; write to {email}.
For access ask {name} or mail {email}.
Written by {name} on {date}
cc {name}, {name}
{name}: {c} is slow again
{name} (owner)
{name}, {idlabel} {id_number}
{idlabel}: {id_number}
{idlabel} no {id_number}, {address}
Address on file: {address}, {idlabel} on file: {id_number}
He gave {address} as place of residence.
She lives near {address} and works for {name}.
The flat at {address} is empty.
Visit us: {address}.
Write to {address} or call {phone}.
KINDLY INFORM {name} ABOUT {C}.
CALL {phone} AND ASK FOR {name}.
Herr {name} wohnt in {address}.
Bitte rufen Sie {phone} an oder schreiben Sie an {email}.
Frau {name} hat {r} gemeldet.
Adresse: {address}, Telefon {phone}
Madame {name} habite {address}.
Merci de contacter {name} au {phone} ou {email}.
Sprint goal: move {c} to release {version}.
Milestone Amber Falcon slipped by {n} days.
Project Northern Kite needs {n} reviewers.
The codenames Crystal Lake and Iron Valley refer to {c}.
Hidden Meadow, Stone Arch and Velvet Dawn are internal products.
Release Golden Acorn ships with {c} {version}.
We compared Night Heron with Paper Crane on {n} rows.
Team Orange Comet owns {c}.
Our Content Delivery Network dropped {n} packets.
The Dependency Injection container of {c} is built twice.
Garbage Collection took {n} ms in {c}.
Use Continuous Integration for {c}, see {r}.
Event Sourcing and Blue Green Deployment were discussed.
Domain Driven Design helped {c}.
Write Ahead Logging is on since build {n}.
Annotate {c} with @Override and @Deprecated.
The @Inject field of {c} is null in line {n}.
@Transactional on {c} rolled back {n} rows
npm install {c}@{version}
Bumped {c}@{version} and {c}@{version} in one commit.
Image {c}:{version} pulled, digest {hex}
commit {hex} reverts {hex}
sha {hex} does not match {hex}
Part number {ticket} is out of stock.
Order {ticket} has {n} items, invoice REQ-{ticket} is open.
Tracking code REQ-{ticket} was scanned on {date}.
Serial {hex}, firmware {version}, bay {n}
Room {n}, floor {n}, rack {n}
Build {run} passed, build {run} failed.
Job {run} wrote {n} files on {date} at {clock}.
Connect to {ip} on port {n} within {n} seconds.
Forward port {n} to {ip}:{n}.
Latency of {c} rose from {n} ms to {n} ms on {date}.
[{clock}] ERROR {c} timed out after {n} ms
{date} {clock} WARN {c}: queue length {n}
level=info svc={c} rows={n} took={n}
at {c}.handle({c}:{n})
GET /api/{c}/{n} {n} {n}
{"service": "{c}", "port": {n}, "version": "{version}"}
- [ ] document {c}
- [x] migrate {c} to {version}
# Notes on {c}
TODO: split {c} into {c} and {c}, see {r}
IMPORTANT: RESTART {C} BEFORE {r} IS CLOSED.
WE LOWERED THE LIMIT OF {C} FROM {n} TO {n}.
Monday and Tuesday are blocked; Wednesday is free.
In January we had {n} incidents, in March {n}.
The English, German and French texts of {c} differ.
Windows and Linux builds of {c} differ by {n} bytes.
Decision: keep {c} on the old schema for {n} weeks.
Why does {c} retry {n} times? See {r}.
Restarting {c} frees {n} MB, at least for an hour.
It seems that {c} and {c} share {n} locks.
I think the timeout of {c} is too short; {n} s would do.
Wir haben {c} auf {n} Threads begrenzt, siehe {r}.
Die Datei von {c} hat {n} Zeilen und {n} Spalten.
Nous avons limité {c} à {n} lignes, voir {r}.
La version {version} de {c} corrige {r}.
After the outage {c} came back with {n} replicas.
Nothing to add.
Look at {c} at once.
{c} fails at random when traffic is at its peak.
Load peaks at night, at least on {c}.
They met at noon and left at {clock}.
The pump stalls at startup.
""".strip().split("\n")

#: Words before a sentence, which begin with a capital and are no names.
OPENERS = ("Also,", "Still,", "However,", "Next,", "Finally,", "Meanwhile,", "First,", "Later,", "Today", "Yesterday", "Note:", "Warning:", "Question:", "Answer:", "Status:", "Customer:", "Agent:", "PS:", "Moreover,", "Therefore,", "Unfortunately,", "Apparently,")

#: Words of streets and places behind which an address is known (fixed forms).
STREETS = "Street Road Avenue Lane Court Way Terrace Drive Square Close Place Crescent St. Rd Ave. Rd. St Ave Ln".split()
PLACES = "Alder Birchwood Cobble Dorn Elmsford Fallow Garnet Heron Juniper Kestrel Linden Mallow Norbeck Orchard Pinfold Quarry Rowan Saltmarsh Tannery Ulverton Vine Willow Yarrow Zinnia".split()
TOWNS = "Aldhaven Brackenford Colmstadt Dunwick Eastbourne-on-Lea Fernhaven Grenwick Holmstadt Ilverne Kingsport Lorringham Mossvale North Tarn Oakmere Pellin Quarrington Redmoor Saltby Thornville Ulmstadt Wexbrook".split()
TITLES = ("Mr.", "Ms.", "Mrs.", "Dr.", "Prof.")
LABELS = {"ssn": ("SSN", "social security number", "SSN"), "passport": ("passport", "passport no.", "passport number"), "national": ("national id", "national ID", "ID number"), "tax": ("tax number", "tax id"), "card": ("ID card no.", "ID card", "identity card")}
_SYLLABLES = "ba bel cor da dor el fa gor hal in jo ka lor mi nar os pel qui ros sa tor ul vek wen yar zan".split()


#: Places of a mixed line, with how often they come (fixed values).
_MIXED = ("{name}", "{name}", "{email}", "{phone}", "{phone}", "{id_number}", "{id_number}", "{idlabel} {id_number}", "{idlabel} {id_number}", "{idlabel}: {id_number}", "{address}", "{c}", "{c}", "{r}", "{n}", "{n}", "{version}", "{hex}", "{ip}", "{date}", "{clock}")


def mixed_lines(lines: list[str], count: int, seed: int = 23) -> list[str]:
    """Lines without sense: words of the table in any order, with places and pairs of capitalised words among them.

    They show each kind and each look-alike in every surrounding, so that the shape of a mention is learnt and not the
    sentences of the table.
    """
    r = random.Random(seed)
    words = sorted({w for line in lines for w in line.replace("{", " {").replace("}", "} ").split() if w.isalpha() and w.islower()})
    out = []
    for _ in range(count):
        parts = [r.choice(words) for _ in range(r.randint(3, 9))]
        if r.random() < 0.5:
            parts[0] = parts[0].capitalize()
        for _ in range(r.choice([1, 1, 2])):
            at = r.randint(0, len(parts))
            pair = " ".join(r.choice(words).capitalize() for _ in range(r.choice([2, 2, 3])))
            parts.insert(at, pair if r.random() < 0.15 else r.choice(_MIXED))
        if r.random() < 0.4:
            at = r.randrange(len(parts))
            parts[at] += r.choice([",", ":", ".", ";", " (", " -"])
        out.append(" ".join(parts) + r.choice(["", ".", ".", "?"]))
    return out


class Filler:
    """Fills the places of a line; ``people`` are (given name, family name)."""

    def __init__(self, people: list[tuple[str, str]], seed: int = 11):
        self.r = random.Random(seed)
        self.people = people or [("Alda", "Brook"), ("Corin", "Dane")]
        self.given = [g for g, _ in self.people]
        self.family = [f for _, f in self.people]

    def _digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def _crossed(self, names: list[str]) -> str:
        """A name from the beginning of one and the end of another."""
        a, b = self.r.choice(names), self.r.choice(names)
        return (a[: max(2, len(a) // 2)] + b[len(b) // 2 :]) if self.r.random() < 0.8 else "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(2, 3))).capitalize()

    def name(self) -> tuple[str, str]:
        r = self.r
        given = r.choice(self.given) if r.random() < 0.5 else self._crossed(self.given)
        family = r.choice(self.family) if r.random() < 0.5 else self._crossed(self.family)
        if r.random() < 0.12:
            family += "-" + (r.choice(self.family) if r.random() < 0.6 else self._crossed(self.family))
        form = r.random()
        if form < 0.46:
            text = f"{given} {family}"
        elif form < 0.6:
            text = f"{family}, {given}"
        elif form < 0.72:
            text = f"{given[0]}. {family}"
        elif form < 0.8:
            text = f"{given} {r.choice('ABCDEFGHJKLMNRST')}. {family}"
        elif form < 0.86:
            text = f"{given} {family[0]}."
        elif form < 0.96:
            text = f"{given} {family}".upper()
        else:
            text = f"{family}, {given[0]}."
        return (r.choice(TITLES) + " " if r.random() < 0.15 else ""), text

    def email(self) -> str:
        r = self.r
        given, family = r.choice(self.given).lower(), r.choice(self.family).lower()
        local = r.choice([f"{given}.{family}", f"{family}_{given}", f"{given[0]}{family}", f"{family}-{given[0]}", f"{given}{r.randint(1, 99)}", f"{given}.{family}+ops"])
        domain = r.choice(["mail.example", "example.net", "team.invalid", "corp.example", "dept.example.org", "post.test"])
        form = r.random()
        if form < 0.2:
            return f"{local} at {domain.replace('.', ' dot ')}"
        if form < 0.36:
            return f"{local} [at] {domain.replace('.', ' [dot] ')}"
        if form < 0.42:
            return f"{local} (at) {domain.replace('.', ' (dot) ')}"
        return f"{local}@{domain}".upper() if form < 0.5 else f"{local}@{domain}"

    def phone(self) -> str:
        r, d = self.r, self._digits
        return r.choice([
            f"{r.randint(201, 989)}-555-{d(4)}", f"({r.randint(201, 989)}) 555-{d(4)}", f"{r.randint(201, 989)}.555.{d(4)}", f"+1-{r.randint(201, 989)}-555-{d(4)}", f"+1 {r.randint(201, 989)} 555 {d(4)}",
            f"+44 7700 900{d(3)}", f"07700 900{d(3)}", f"020 7946 0{d(3)}", f"+999 {d(2)} {d(4)} {d(3)}", f"00999 {d(3)}/{d(7)}", f"+49 {d(3)} {d(7)}", f"+1 ({r.randint(201, 989)}) 555-{d(4)}", f"+44 20 7946 0{d(3)}", f"{r.randint(201, 989)} 555 {d(4)}",
        ])

    def id_number(self, kind: str | None = None) -> tuple[str, str]:
        r, d = self.r, self._digits
        kind = kind or r.choice(list(LABELS))
        value = {
            "ssn": r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}", f"{d(3)}-{d(2)}-{d(4)}"]),
            "passport": r.choice("CFGHJKLXYZ") + d(7),
            "national": f"{d(6)}-{d(4)}",
            "tax": f"{d(2)}/{d(3)}/{d(5)}",
            "card": f"{r.choice('LMNPRT')}{d(2)}{r.choice('RSTXYZ')}{d(5)}",
        }[kind]
        return r.choice(LABELS[kind]), value

    def address(self) -> str:
        r, d = self.r, self._digits
        place, town, street, house = r.choice(PLACES), r.choice(TOWNS), r.choice(STREETS), str(r.randint(1, 299)) + ("" if r.random() < 0.85 else r.choice("AB"))
        end = r.choice(["", "", f", {town}", f", {town} {d(5)}", f", Apt {r.randint(1, 40)}, {town}"])
        return r.choice([
            f"{house} {place} {street}{end}", f"{house} {place} {street}{end}", f"{place}straße {house}, {d(5)} {town}", f"{house}, rue de {place}, {d(5)} {town}", f"P.O. Box {r.randint(1, 299)}, {town}", f"{place} {street} {house}, {d(5)} {town}", f"{place} {street} {house}, {d(5)} {town}", f"{place}str. {house}, {d(5)} {town}",
        ])

    def component(self) -> str:
        r = self.r
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 3))) + r.choice("-_.") + r.choice("cache ledger queue router worker store gate proxy shard mixer loader broker index planner".split())

    def other(self, what: str) -> str:
        r, d = self.r, self._digits
        if what == "c":
            name = self.component()
            return name.capitalize() if r.random() < 0.08 else name
        return {
            "C": lambda: self.component().upper(),
            "r": lambda: f"{r.choice(['ISS', 'BUG', 'OPS', 'RFC'])}-{r.randint(1000, 99999)}",
            "n": lambda: str(r.randint(1, 10 ** r.randint(1, 5))),
            "run": lambda: f"202{d(5)}-{r.randint(10, 99999)}",
            "version": lambda: ".".join(str(x) for x in (r.choice([r.randint(0, 40), r.randint(0, 40), r.randint(2015, 2030), r.randint(1000, 19999)]), r.randint(0, 60), r.randint(0, 300))),
            "ticket": lambda: f"{r.randint(10, 99999)}-{d(2)}-{r.randint(1000, 99999)}",
            "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 14, 32]))),
            "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
            "clock": lambda: f"{d(2)}:{d(2)}:{d(2)}",
            "date": lambda: f"202{d(1)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        }[what]()

    def sentence(self, line: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The filled line, and (start, end, kind) of its personal data."""
        out, spans, at = [], [], 0
        parts, k = [], 0
        kind = self.r.choice(list(LABELS))
        while k < len(line):
            close = line.find("}", k)
            if line[k] == "{" and close > k and line[k + 1 : close].replace("_", "").isalpha():
                parts.append((True, line[k + 1 : close]))
                k = close + 1
            else:
                parts.append((False, line[k]))
                k += 1
        labelled = any(p == (True, "idlabel") for p in parts)
        label, number = self.id_number(kind if labelled else None)
        for slot, text in parts:
            own = None
            if slot:
                what = text
                if what == "name":
                    title, text = self.name()
                    out.append(title)
                    at += len(title)
                    own = "name"
                elif what == "idlabel":
                    text = label
                elif what in KINDS:
                    own = what
                    text = number if what == "id_number" else getattr(self, what)()
                    if what == "id_number":
                        label, number = self.id_number(kind if labelled else None)
                else:
                    text = self.other(what)
            if own:
                spans.append((at, at + len(text), own))
            out.append(text)
            at += len(text)
        text = "".join(out)
        if self.r.random() < 0.4:
            opener = self.r.choice(OPENERS)
            if opener[-1] == ":" and self.r.random() < 0.4:
                opener += " " + self.r.choice(OPENERS[:10])
            first = text if spans and spans[0][0] == 0 or self.r.random() < 0.3 else text[:1].lower() + text[1:]
            text = f"{opener} {first}"
            spans = [(a + len(opener) + 1, b + len(opener) + 1, kind) for a, b, kind in spans]
        return text, spans
