"""The small labelled table from which the tagger of personal data is trained.

Each line of ``LINES`` is a sentence whose marked parts carry their label; ``expand`` fills the parts with invented values
in the usual public formats. Sentences without marks, and numbers and names that are no personal data, are
examples of what must stay.
"""

from __future__ import annotations

import random

from tarnlight.llm.name_variants import KIND_WORDS, PET_FORMS

# Fixed table: labelled sentences. {name}, {email}, {phone}, {id}, {address} and {org} are labelled parts, <...> unlabelled ones.
LINES = """
{name} prefers short reviews
{name} dropped the habit in week two
{name} will score the prediction
{name}: wants the old index back
{name}'s card box
{name}, second reader
({name}, second reader)
talk to {name} about the draft
ask {name} for the source
met {name} at the reading group
interview with {name}
according to {name}
same doubt as {name}
seat four is {name}
goal shared with {name} until spring
thanks to {name}
per {name}
signed {name}
signed, {name}
my supervisor {name} agreed
{name} called about the notes
please forward this to {name}
the letter was written by {name} last year
I am {name}
meeting with {name} on Monday
a note from {name} and {name}
contact is {email}
my address is {email}
login is {email}
write to {email} before Friday
<{email}> asked for the weekly log
({email})
cc: {email} on the summary
{email} bounced twice
the export goes to {email}
mail {email} for access
send it to {email} or {email}
reply to {email}
call {phone} after six
text {phone} instead
fax/phone {phone}
new number: {phone}
mobile {phone}
tel. {phone}
reach me on {phone}
ring {phone} if the review slips
{phone} is the desk line
my number is {phone}
phone: {phone}
ID number {id}
passport {id}
permit {id} expires in May
SSN {id}
tax reference {id}
insurance no. {id}
personal number {id}
document {id}
member is registered as {id}
the form wants {id}
{id}
social security number {id}
home address: {address}
lives at {address}
meet at {address}
moved to {address}
invoice goes to {address}
ship the notebook to {address}
the archive boxes are at {address}
delivery to {address}
{address}
a habit from {org}
working with {org}
booked a room at {org}
{org}: it started last year
{org} moved the summer review
the report of {org} is late
asked <tool> for a recap
uses <tool> instead of <tool> for <topic>
<tool> stores <n> sessions of <topic> per run
walked from <town> to the Old Mill
<town> in winter
read Street Maps of <town> twice
read A Manual of <Topic>: A Workbook on Monday
finished The Quiet Art of <Topic> on Sunday
read Seven Lessons in <Topic>, Second Series
see build 2025-<2>-<4>
ticket <4>-<4> is closed
chunk <4>-<4> was skipped
ISBN 978-0-00-<6>-<1>
section <2>.<2>.<2> holds the table
threshold 0.<4> looked fine
<1>,<3>-<1>,<3> words per sitting
dial the floor to <1>.<1>
call it at <1>.<1> then
sync with index@main after the run
use @weekly as the tag
release v<1>.<2>.<1> fixed it
host 192.0.2.<3> answered
at 2025-<2>-<2> <2>:<2> the job stopped
commit a<3>f9db<2> broke search
order <4> <4> arrived
version <2>-<4> of the index
page <3> of <3>, line <2>
the score was <2> to <2>
{"hits": <1>, "topic": "<topic>"}
"""

BASES = """
Thanks, and <topic>?
Remind me what we said about <topic>.
Summarise <n> weeks of notes on <topic> please
I logged <n> sessions on <topic> today, is that enough?
What is the next step for <topic>?
Noted. The measurement on <topic> is now <adj>.
Done.
Ok
I found <n> memories on <topic>; the closest one says that the <adj> calendar shortens the value of each <adj> memo.
Your log shows <n> cards; the <adj> sketch weakens the scope of any <adj> ledger.
Try a <adj> procedure for <n> entries and compare.
There is one <adj> reflection: the author noticed that the <adj> log changes the purpose of one <adj> draft.
Prefers a <adj> comparison for <topic>
Keeps a <adj> principle next to the scope of any <adj> newsletter, again
The <adj> reminder balances the burden of one <adj> preface, as before
The <adj> argument on <topic> failed after <n> minutes
The goal for <topic> moved from <n> to <n> minutes.
Reviews <topic> every <n> days, since week <n>
Did the team ever finish the experiment
Move the goal on <topic> to <n> pages
Strangely enough, the <adj> register stabilises everyday judgement, although nobody planned it that way.
Can you compare <topic> and <topic>
Looking back, the curator decided that the <adj> map explains the memory of the <adj> index
You keep the notes of one reader.
the <adj> index reshapes a reader's understanding of <topic>
a note confirms a person's working memory
a follow-up interview without much effort simplifies the purpose of <topic>
- the value of one <adj> inventory
Uses <tool> instead of <tool> for <topic>
"""

# Fixed values for the unlabelled parts.
TOPICS = "map making;bread baking;home energy;chess study;team knowledge;river walks;language study;note taking;local history;pricing;search quality;woodwork;public speaking".split(";")
ADJECTIVES = "quick plain narrow seasonal hidden printed informal careful joint quiet compact wide patient borrowed".split()
TOOLS = "Indexmill Notarium Cardloom Lexibox Marginalia Memopress Readcask Threadwell Paperflow Tagsmith".split()
TOWNS = "Northbrook;Saint-Maren;Port Harrow;Oldbridge;Kestermill;Lindfield;Hallowdene;Westermond;Brayhaven;Easterby".split(";")
STREETS = "Maple Street;Old Mill Road;Harbour Way;Elm Crescent;Station Rd;Lower Park Road;Quarry Blvd;Pine Lane;King's Avenue;Hill Rise;Church Close;Willow Drive;Upper Brook St;Linden Ave;Pelham Rise;Thimble Lane".split(";")
ENDINGS = "son sen berg strom ström wick mark vist quist ford ton ley man dahl lund ska ov ova ei etti ini ane aune elle ola aga ard ard ough nik ik ós os en wen dan".split()
SPACES = " "


def _surname(r: random.Random) -> str:
    parts = "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") for _ in range(r.choice((1, 2, 2)))) + r.choice(("", "l", "r", "n", "ld", "rv", "mb", "sk", "nd", "gl", "rk", "lt"))
    return (parts + r.choice(ENDINGS)).capitalize()


def _typo(word: str, r: random.Random) -> str:
    i = r.randrange(1, max(2, len(word) - 1))
    return r.choice((word[:i] + word[i : i + 1] * 2 + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]))


def _name(r: random.Random) -> str:
    first, pets = r.choice(list(PET_FORMS.items()))
    first = (r.choice(pets.split()) if pets and r.random() < 0.3 else first).capitalize()
    if r.random() < 0.25:
        first = r.choice(("Anaïs", "Zoë", "José", "Renée", "Łukasz", "Björn", "Søren", "Ondřej", "Jürgen", "Małgorzata", _surname(r)[:6]))
    last = _surname(r)
    if r.random() < 0.15:
        last, first = _typo(last, r), first
    if r.random() < 0.1:
        first = _typo(first, r)
    middle = f" {r.choice('ABCDEFGHJKLMNPRST')}." if r.random() < 0.12 else ""
    shape = r.random()
    if shape < 0.5:
        out = f"{first}{middle} {last}"
    elif shape < 0.62:
        out = f"{last}, {first}"
    elif shape < 0.7:
        out = f"{last}, {first[0]}."
    elif shape < 0.8:
        out = f"{first[0]}.{middle} {last}"
    elif shape < 0.86:
        out = f"{last} {first[0]}."
    elif shape < 0.9:
        out = f"{last.upper()}, {first}"
    else:
        out = f"{last} {first}"
    case = r.random()
    out = out.upper() if case < 0.08 else out.lower() if case < 0.16 else out
    if r.random() < 0.08:
        out = r.choice(("Dr. ", "Prof. ", "Mr. ", "Ms. ")) + out
    if r.random() < 0.04:
        out += ", PhD"
    return out


def _email(r: random.Random) -> str:
    first, last = r.choice(list(PET_FORMS)), _surname(r).lower()
    local = r.choice((f"{first}.{last}", f"{first}_{last}", f"{first[0]}{last}", f"{first}+notes", f"{last}{r.randrange(100)}", f"{first}.{last[0]}", f"{first}{r.randrange(10)}"))
    host = r.choice(("example.com", "example.org", "mail.example.net", "uni.test", "team.example.org", "post.example.com", "studio.invalid", "firm.co.uk", "web.de"))
    out = f"{local}@{host}"
    if r.random() < 0.22:
        out = r.choice((f"{local} at {host.replace('.', ' dot ')}", f"{local} (at) {host}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local}(at){host}"))
    return out.upper() if r.random() < 0.08 else out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice((
        f"(555) 555 0{d(3)}", f"555-0{d(3)}", f"1-555-555-0{d(3)}", f"+1555555{d(4)}", f"+1 (555) 555-0{d(3)}", f"+1 555 555 0{d(3)}", f"01632/960-{d(3)}", f"+44 1632 960{d(3)}", f"01632 960{d(3)}", f"020 7946 0{d(3)}", f"+44(0)20 7946 0{d(3)}", f"+44(0)20 7946 0{d(3)} ext. {d(2)}", f"+44 20 7946 0{d(3)} x{d(2)}",
        f"01 99 00 {d(2)} {d(2)}", f"0199.00.{d(2)}.{d(2)}", f"+33 1 99 00 {d(2)} {d(2)}", f"+49 30 23125 {d(3)}", f"030/23125-{d(3)}", f"+46 8 {d(3)} {d(2)} {d(2)}",
    ))


def _id(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice((
        f"QQ{d(6)}{r.choice('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"X0{d(7)}", f"0000{d(4)}{r.choice('ZTRW')}", f"000101-{d(4)}", f"00/{d(3)}/{d(5)}", f"L0-{d(4)}-{d(4)}", f"000-{d(2)}-{d(4)}", f"{d(8)}{r.choice('ZTRWAG')}", f"19{d(6)}-{d(4)}",
    ))


def _address(r: random.Random) -> str:
    town, street, n = r.choice(TOWNS), r.choice(STREETS), r.randrange(1, 260)
    post = r.choice((f"NX{_digits(r, 1)} {_digits(r, 1)}QQ", f"ZZ 00{_digits(r, 3)}"))
    comma = r.choice((", ", ", ", "\n"))
    out = r.choice((
        f"{n} {street}, {town}", f"{n} {street}, {town} {post}", f"{n} {street}{comma}{town}, {post}", f"{n} {street}{comma}{town} {post}", f"apt {r.randrange(1, 9)}B / {n} {street}, {town}", f"Flat {r.randrange(1, 9)}, {n} {street}, {town}", f"PO Box {n}, {town} {post}", f"P.O. Box {n}, {town}",
        f"{n} bis, rue des {r.choice(('Tilleuls', 'Aubiers', 'Moulins'))}, 00{_digits(r, 3)} {town}", f"{n}, rue de la {r.choice(('Gare', 'Paix'))}, 00{_digits(r, 3)} {town}", f"{r.choice(('Lindenweg', 'Hornstraße', 'Mühlweg', 'Bergstr.'))} {n}, 00{_digits(r, 3)} {town}", f"Calle {r.choice(('Brisa', 'Marina', 'Olivo'))} {n}, {r.randrange(1, 5)}.º {r.choice('ABC')}, 00{_digits(r, 3)} {town}", f"{n} {street}", f"Postfach {n}, 00{_digits(r, 3)} {town}",
    ))
    case = r.random()
    return out.lower() if case < 0.22 else out.upper() if case < 0.25 else out


def _org(r: random.Random) -> str:
    core = _surname(r)
    kind = r.choice(("School of Cartography", "Institute of Applied Hydrology", "Research Group", "Foundation", "Association of Archivists", "Publishing House", "University", "Consulting", "Department of Field Geology", "Centre for Reading Studies", "Laboratory for Decision Science", "Learning Systems", "International Press", "Society for Memory Research"))
    legal = r.choice(("", "", " Ltd", " GmbH", " AB", " S.A.", " Inc.", ", Inc"))
    words = kind.split()
    style = r.random()
    if style < 0.12:
        kind = " ".join(next((f.capitalize() + "." for f in KIND_WORDS.get(w.lower(), "").split()), w) for w in words)
    elif style < 0.2 and len(words) > 1:
        kind = "".join(w[0] for w in words if w[0].isupper())
    out = f"{kind}, {core}" if style > 0.95 else f"{core} {kind}{legal}"
    if r.random() < 0.08:
        out = "The " + out
    return out.upper() if r.random() < 0.08 else out


def _fill(line: str, r: random.Random) -> list[tuple[str, str]]:
    """``(text, label)`` pieces of a line."""
    import re

    makers = {"name": _name, "email": _email, "phone": _phone, "id": _id, "address": _address, "org": _org}
    plain = {"tool": lambda: r.choice(TOOLS), "town": lambda: r.choice(TOWNS), "topic": lambda: r.choice(TOPICS), "Topic": lambda: r.choice(TOPICS).title(), "adj": lambda: r.choice(ADJECTIVES), "n": lambda: str(r.randrange(2, 60))}
    pieces: list[tuple[str, str]] = []
    for part in re.split(r"(\{\w+\}|<\w+>)", line):
        inner = part[1:-1]
        if part.startswith("{") and inner in makers:
            pieces.append((makers[inner](r), inner))
        elif part.startswith("<") and (inner in plain or inner.isdigit()):
            pieces.append((_digits(r, int(inner)) if inner.isdigit() else plain[inner](), ""))
        elif part:
            pieces.append((part, ""))
    return pieces


def expand(rows: int = 3600, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Labelled sentences: a base sentence with up to three lines around it, in varied case and punctuation."""
    r = random.Random(seed)
    lines = [x for x in LINES.strip("\n").split("\n") if x.strip()]
    bases = [x for x in BASES.strip("\n").split("\n") if x.strip()]
    out = []
    for _ in range(rows):
        parts = [_fill(r.choice(bases), r)] if r.random() < 0.8 else []
        for _ in range(r.choice((0, 1, 1, 1, 2, 2, 3)) if parts else 1):
            own = _fill(r.choice(lines), r)
            if own[0][1] == "" and r.random() < 0.5:
                own[0] = (own[0][0][:1].upper() + own[0][0][1:], "")
            parts.insert(r.choice((0, len(parts))), own)
        row: list[tuple[str, str]] = []
        for n, part in enumerate(parts):
            if n:
                row.append((r.choice((" — ", ". ", "; ", "\n", " - ", ": ", " PS: ", ", ", " ", " (", ") ", ".. ")), ""))
            row += part
        if r.random() < 0.3:
            row.append((r.choice((".", "!", "?", ")", " (confirmed)", ", again")), ""))
        out.append(row)
    return out
