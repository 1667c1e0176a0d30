"""Documents that are residue instead of content: unfilled templates, filler, error pages, script notices.

1. A text is cut into lines and sentences. Numbers, addresses, dates and identifiers, what stands in placeholders, and filler
   are masked, so that every copy of a message has one normalised form.
2. Forms are grouped by exact hash across all documents and sources, whatever the length of the documents.
3. Each form is classified: phrase and placeholder rules name what is residue, furniture or a bare label if it is short. A longer form that
   holds such a phrase is suspected, any other is unnamed; both count as part of a message only if they recur. One that occurs in
   several sources and almost only beside residue is part of it; the more unnamed pieces stand in its documents, the more
   sources must show it. One that occurs in a share of all sources, almost only in documents that hold nothing
   but such forms, is a message of its own. Recurrence in a few sources alone tells nothing, for articles are copied too.
4. A document is residue if all its forms but labels and furniture are residue or such recurring forms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.session import cut

# Fixed patterns, matched against lower-cased, masked pieces (# stands for digits or an identifier, @ for an address).
FURNITURE = (
    r"^(skip to (the )?(main )?content|menu|search|navigation|home|loading\W*|share( this page)?|print( this page)?|back to .{1,40}|go (back )?to .{1,40}|"
    r"powered by .{1,40}|all rights reserved\W*|(©|\(c\)|copyright).*|sign (in|up|out)|log (in|out)|subscribe|follow us|cookies?( settings| policy)?|"
    r"(terms|privacy|contact|imprint|impressum|home|notes|archive|sign in|about|help|faq)( ?[·|/•-] ?(terms|privacy|contact|imprint|impressum|home|notes|archive|sign in|about|help|faq))+|"
    r"related( articles| pages)?|read more|next|previous|breadcrumbs?|advertisement|zum inhalt springen|suche|aller au contenu|ir al contenido|updated\W*)$"
)
PLACEHOLDER = r"<%=?[^%\n]{0,60}%>|\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,60}%\}|%%[^%\n]{1,60}%%|«[^«»\n]{1,60}»|<(your|insert|enter|the|add|name|title|date|author|text)\b[^<>\n]{0,60}>|\$\{[^{}\n]{1,60}\}|\{[0-9#]{1,3}\}|\[\[?(insert|your|enter|add|name|title|date|tbd|todo|placeholder|fill)\b[^\[\]\n]{0,60}\]\]?|_{3,}|\.{6,}|(__/)+_*|<[a-z]+(_[a-z]+)+>"
BESIDE = r"^\(?(reload\b.{0,60}|(please )?(check|reload|refresh|go back|contact|return)\b.{0,60}|(reference|request id|kennung|kennziffer|vorgang|référence|referencia|incidente|incident|error id|ref|trace|ray id|code)\b.{0,40}|if this keeps happening.{0,60}|allow (them|it) .{0,60}|reason:?.{0,20}|why:?.{0,20}|because:?.{0,20})\W*$"


class Rule:
    """A phrase rule: a piece is meant if it holds one of the cues and the pattern.

    A piece of at most ``words`` words is named by that alone. A longer one may be a sentence that tells of such a thing,
    and is only suspected: what it is, its recurrence and its company decide.
    """

    def __init__(self, kind: str, words: int, cues: str, pattern: str, guard: str = ""):
        self.kind, self.words, self.cues = kind, words, cues.split(";")
        find, first = re.compile(pattern).search, re.compile(guard).search
        # a guard is what the pattern needs as well and is found faster
        self.find = (lambda form: first(form) and find(form)) if guard else find


# Fixed rules: what is found, words up to which it is sure, cues, pattern.
RULES = [
    Rule("residue", 9, "not found;forbidden;server error;bad gateway;gateway;unavailable;too many requests;bad request;unauthori;access denied;timed out;time out;went wrong;an error;error;http;fehler;erreur;status",
         r"\b(not found|forbidden|internal server error|bad gateway|gateway time-?out|service unavailable|too many requests|bad request|unauthori[sz]ed|access denied|"
         r"request timed? ?out|something went wrong|an error (has )?occurred|(http|error|fehler|erreur|status)( code)? ?:? ?#)\b"),
    Rule("residue", 22, "could not;cannot be;can't be;was not;is not;couldn't be;no longer;does not exist",
         r"\b(page|chapter|notebook|document|scan|file|site|content|resource|entry|link|archive|url) (you (asked|looked|are looking) for )?.{0,30}(could not be|could not|cannot be|can't be|was not|is not|couldn't be|is no longer|does not exist|no longer exists)\b.{0,30}(loaded|found|converted|available|displayed|opened|read|reached|exist|located)?"),
    Rule("residue", 22, "refused;did not answer;did not respond;not responding;is down;is temporarily;is under;took too long;is unavailable;is overloaded",
         r"\b(server|archive|page|site|service) (refused|did not answer|did not respond|is not responding|is down|is temporarily|is under|took too long|is unavailable|is overloaded)"),
    Rule("residue", 22, "may have been;unexpected condition;you are not allowed;do not have permission;having trouble at the moment;maintenance",
         r"may have been (moved|renamed|deleted)|unexpected condition|you are not allowed to|do not have permission|having trouble at the moment|down for maintenance|under maintenance|scheduled maintenance"),
    Rule("residue", 22, "returned;slow down and retry;traceback;file \";error;exception;status;<code>;checking your browser;this takes about;rate limit;no longer available;not available in your;session;try again",
         r"(parser|converter|server) returned (no|an empty|an error)|slow down and retry|^traceback \(most|^file \"[^\"]*\", line|\b[a-z]*(error|exception): |\"(error|status)\": ?[\"#0-9]|<error>|<code>|checking your browser|this takes about #|"
         r"rate limit(ed)? (exceeded|reached)|no longer available|not available in your (country|region)|session (has )?expired|(please )?try again (in|later|after)"),
    Rule("residue", 22, "seite;nicht gefunden;existiert nicht;wurde ;zugriff;serverfehler;nicht verfügbar;nicht erreichbar;wartungsarbeiten;versuchen sie es;nicht geladen;ist ein fehler;zurück zur start",
         r"seite (wurde )?(nicht gefunden|existiert nicht)|nicht gefunden|existiert nicht( mehr)?|wurde (verschoben|gelöscht|entfernt|umbenannt)|zugriff verweigert|kein zugriff|serverfehler|nicht verfügbar|nicht erreichbar|wartungsarbeiten|versuchen sie es|nicht geladen werden|ist ein fehler aufgetreten|zurück zur start"),
    Rule("residue", 22, "page ;introuvable;accès;erreur;indisponible;réessaye;n'existe;revenez;retournez",
         r"page (introuvable|non trouvée)|introuvable|accès (refusé|interdit)|erreur (interne|du serveur|\d|#)|service indisponible|indisponible|veuillez réessayer|réessayez|n'existe (pas|plus)|une erreur (est survenue|s'est produite)|(revenez|retournez) (à|au) "),
    Rule("residue", 22, "página;no se ;no encontrad;no se encontr;acceso;error ;no disponible;no está disponible;inténtelo;vuelva a;ha ocurrido un error",
         r"página no (encontrada|existe|disponible)|no se (ha|pudo|encontr)|no (se )?(encontrada|encontrado|encontró)|acceso (denegado|prohibido)|error (interno|del servidor)|no disponible|no está disponible|inténtelo|vuelva a intentarlo|ha ocurrido un error|se produjo un error|vuelva al "),
    Rule("residue", 25, "script;js;skript;cookies;turn them;turn it;you cannot ",
         r"\b(enable|allow|allows?|turn(ed)? (it |them )?on|switch(ed)? on|activate|requires?|needs?|without|blocks?|blocked|disabled|run|use|using|works? only)\b.{0,60}\b(java ?script|js|scripts?|scripting|cookies)\b"
         r"|\b(java ?script|js|scripts?|scripting|cookies)\b.{0,60}\b(enabled?|required?|needed|turned on|switched on|disabled|blocked|allowed|necessary|turn (it|them) on|to continue|to prove)\b"
         r"|^noscript\b|^turn (them|it) on\b|you cannot (read|see|load|continue|open|view)|(bitte |sie müssen )?(aktivieren|erlauben|schalten|zulassen|einschalten).{0,40}(java ?script|skripte?|scripts?)|(java ?script|skripte?|scripts?).{0,60}(aktivier|erlaub|einschalt|zulass|benötigt|erforderlich|aktiviert)"
         r"|(activer|activez|autoriser|autorisez|veuillez).{0,40}(java ?script|scripts?)|(java ?script|scripts?).{0,40}(activé|désactivé|requis|nécessaire|bloqués?)"
         r"|(habilite|active|activar|permita|habilitar|necesita|requiere).{0,40}(java ?script|scripts?)|(java ?script|scripts?).{0,40}(activado|habilitad|desactivado|necesari|bloquead)",
         r"\b(java ?script|js|scripts?|scripting|cookies|skripte?|noscript)|^turn (them|it) on|you cannot "),
    Rule("residue", 60, " here;this is ;with your own;placeholder;text;hier ;exemple;factice;de remplacement;à venir;ejemplo;relleno;muestra;o provisional;aquí; ici",
         r"your (content|text|title) (goes )?here|this is (a )?(sample|placeholder|dummy|example|filler) (text|content|paragraph|page)|replace (it|this|the text|this text) with your own|placeholder (paragraph|text|content|image)"
         r"|^text(\W+text)+\W*$|add (a|your|some) .{0,60} here\W*$|(enter|insert|type|write|put|paste) (a|your|some|the) .{0,50} here\W*$|blindtext|hier steht später|hier (folgt|kommt) (später )?(der )?(text|inhalt)|platzhalter(text)?|(texte|contenu) (d'exemple|factice|de remplacement|à venir)|votre (texte|contenu) ici"
         r"|(texto|contenido) (de ejemplo|de relleno|de muestra|provisional)|(su|tu) (texto|contenido) (aquí|va aquí)|aquí va (su|tu|el) (texto|contenido)"),
    Rule("residue", 60, "xx;foo;bar;baz;qux;test;asdf;qwer;hjkl;bla;abc;xyz;platzhalter;coming soon;under construction;lorem ipsum",
         r"^x{2,}(\W+x{2,})*\W*$|^((foo|bar|baz|qux|test|asdf|qwer|qwerty|hjkl|blah|bla|abc|xyz)\W*){3,}$|platzhalter(text)?|coming soon\W*$|under construction\W*$|lorem ipsum( dolor sit amet)?\W*$"),
    Rule("residue", 8, "todo;fixme;tbd;tba;n.n.;t.b.d.;fill in;to be ;to do;to come;wird ergänzt;noch offen;à compléter;à rédiger;por completar;por escribir;pendiente",
         r"^\W*(todo|fixme|tbd|tba|n\.n\.|t\.b\.d\.)(?!\w)|\b(tbd|tba)\W*$|^\W*\(?(fill in( later)?|to be (written|added|done|filled in|completed|decided)|to do|to come|wird ergänzt|noch offen|à compléter|à rédiger|por (completar|escribir)|pendiente)\)?\W*$"),
    Rule("label", 400, "reload;check;refresh;go back;contact;return;reference;request id;kennung;kennziffer;vorgang;référence;referencia;incident;error id;ref;trace;ray id;code;if this keeps;allow ;reason;why;because", BESIDE),
]
#: A piece of at most one word that names an error by itself; a bare number does not.
ALONE = re.compile(r"^(oops|gone|error|sorry|forbidden|fehler|erreur|uups|ups|hoppla)\W*$")
#: Marks of which a piece with a placeholder has one, and words beside its placeholders up to which it is sure.
PLACEHOLDER_CUES, BESIDE_PLACEHOLDERS = "<;{;[;«;%%;___;......;__/".split(";"), 10
# Fixed words: the vocabulary of the usual Latin filler.
LATIN = set((
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris "
    "nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split())
#: Bullets, quotation and table marks around a piece.
_BARE_MARKS = "#>*-|+=~`.:• \t"
_ENDS = re.compile(r"\n|(?<=[.!?…])\s+|(?<=[.!?…][\"')\]])\s+")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]{1,60}@[\w.-]{1,60}|(?<!\S)/[\w./-]+")
_DIGITS = re.compile(r"\b(?=[0-9a-f]{0,40}[0-9])[0-9a-f]{5,}\b|\b\d+(?:[.,:/-]\d+)*\b")
_DIGIT = re.compile(r"\d")
_BLANKS = re.compile(r"[\s\u200b\u200e\u200f\ufeff\u2060]+")
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_FURNITURE, _PLACEHOLDER, _BESIDE = re.compile(FURNITURE), re.compile(PLACEHOLDER), re.compile(BESIDE)
#: Words of the filler that hardly occur in other text; a piece of filler has one.
_CORE = {w for w in LATIN if len(w) > 3}
_NONSENSE = re.compile(r"^(?:(?:x{2,}|foo|bar|baz|test|asdf|qwer|text|blah?)\b\W*){20}")
# Where a long piece is cut further: scripts and tags, fields of JSON and tables, after placeholders; then at commas and the like.
_SCRIPTS = re.compile(r"<(script|style)\b[^<>]*>.*?</\1>|<!--.*?-->", re.S)
_TAG = re.compile(r"</?[a-z!?][^<>]*>")
_FIELDS = re.compile(r"(?<=,)\s*(?=[\"{\[])|(?<=[{\[])\s*(?=\")|\s+[|·•]\s+|\t+")
_CLAUSES = re.compile(r"(?<=[,;:])\s+|\s+[–—-]\s+")
_JSON_STATE = re.compile(r"^\W*\"status\": ?\"")
_SENTENCE_END = re.compile(r"[.!?…]\W*$")
#: Characters beyond which a piece is cut further.
LONG = 400
#: A form that recurs is in so many sources; beside residue, a source speaks for so many unnamed pieces of a page.
SOURCES, PIECES_EACH = 3, 2
#: Kinds that count, the stronger first.
KINDS = ["residue", "suspect", "content"]
#: Rows beyond which a form is hot.
HOT = 100_000
#: A form is everywhere if it is in this share of all sources, and in so many at least.
WIDE_SHARE, WIDE = 0.002, 10



def _finder() -> Callable[[str], set[int]]:
    """A function that gives the numbers of the rules of which a form holds a cue; -1 stands for placeholders."""
    owners: dict[str, set[int]] = {}
    for n, rule in enumerate(RULES):
        for cue in rule.cues:
            owners.setdefault(cue, set()).add(n)
    for cue in PLACEHOLDER_CUES:
        owners.setdefault(cue, set()).add(-1)
    try:
        import ahocorasick
    except ImportError:
        return lambda form: {n for cue, own in owners.items() if cue in form for n in own}
    automaton = ahocorasick.Automaton()
    for cue, own in owners.items():
        automaton.add_word(cue, own)
    automaton.make_automaton()
    return lambda form: set().union(*[own for _, own in automaton.iter(form)])


_cues_in = _finder()


def masked(piece: str) -> str:
    """Lower case; addresses as @, dates, times, numbers and identifiers as #; single blanks."""
    form = piece.lower()
    if "/" in form or "@" in form or "www." in form:
        form = _ADDRESS.sub("@", form)
    if _DIGIT.search(form):
        form = _DIGITS.sub("#", form)
    return " ".join(form.split()) if form.isascii() else _BLANKS.sub(" ", form).strip()


def shared_form(form: str) -> str:
    """The form under which a piece is grouped: whatever stands in a placeholder, and any run of filler, is the same."""
    if any(c in form for c in PLACEHOLDER_CUES):
        form = _PLACEHOLDER.sub("{?}", form)
    words = form.split()
    return "lorem" if len(words) >= 3 and not _CORE.isdisjoint(words) and sum(w.strip(".,;:!?") in LATIN for w in words) >= 0.6 * len(words) else form


def classify(form: str) -> str:
    """What a masked piece is by rule: ``residue``, ``suspect``, ``furniture``, ``label`` or ``content``."""
    tokens, cues = form.split(), _cues_in(form)
    core = not _CORE.isdisjoint(tokens) or "lorem" in form
    plain = form.strip(_BARE_MARKS)
    blanks = _PLACEHOLDER.search(form) if -1 in cues else None
    hits = [rule for n, rule in enumerate(RULES) if n in cues and (rule.find(plain) or rule.find(form))] if cues else []
    named = core or blanks or hits
    if not named and (_FURNITURE.match(form) or _FURNITURE.match(plain)):
        return "furniture"
    if not named and sum(map(str.isalpha, tokens)) > 6:
        return "content"
    found = _WORDS.findall(form)
    words = len(found)
    if core and words >= 3 and sum(w in LATIN for w in found) >= words * 0.6:
        return "residue"
    if len(form) > LONG and _NONSENSE.match(form):
        return "residue"
    if named and words <= 12 and (_FURNITURE.match(form) or _FURNITURE.match(plain)):
        return "furniture"
    if words <= 1 and ALONE.match(plain):
        return "residue"
    if blanks and len(_WORDS.findall(_PLACEHOLDER.sub(" ", form))) <= BESIDE_PLACEHOLDERS:
        return "residue"
    for rule in hits:
        if words <= rule.words:
            return rule.kind
    suspect = bool(blanks or hits)
    if suspect:
        return "suspect"
    if words <= 1 or (words <= 6 and not _SENTENCE_END.search(form)):
        return "label"
    return "content"


def _after_placeholders(text: str) -> list[str]:
    ends = [0, *(m.end() for m in _PLACEHOLDER.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:]) if text[a:b].strip()]


def classify_long(piece: str) -> list[tuple[str, str]]:
    """``(form, kind)`` of the parts of a lower-cased piece that is long when masked.

    Tags tell nothing unless a rule names them. Other parts that only their shortness makes labels count as content, for
    prose and records are cut into short parts as well; between tags, and beside one word of a field, they stay labels. If
    no part is residue the piece is what it is as a whole.
    """
    whole = masked(piece)
    if (kind := classify(whole)) not in ("content", "suspect"):
        return [(whole, kind)]
    bare = _SCRIPTS.sub(" ", piece)
    tags, texts = [m[0] for m in _TAG.finditer(bare)], _TAG.split(bare)
    out = [(form, "residue") for tag in tags if classify(form := masked(tag)) == "residue"]
    for text in texts:
        fields = [f for f in _FIELDS.split(text) if f and f.strip()]
        for field in fields:
            for part in _after_placeholders(field):
                form = masked(part)
                kind = "content" if _JSON_STATE.match(form) else classify(form)
                clauses = [c for c in _CLAUSES.split(part) if c.strip()] if kind in ("content", "suspect") and len(form) > LONG else []
                if len(clauses) > 1:
                    out += [(c, k if k != "label" or _BESIDE.search(c.strip(_BARE_MARKS)) else "content") for c, k in ((c, classify(c)) for c in map(masked, clauses)) if c]
                elif kind == "label" and not tags and len(_WORDS.findall(form)) > 2 and not _BESIDE.search(form.strip(_BARE_MARKS)):
                    out.append((form, "content"))
                elif form:
                    out.append((form, kind))
    kinds = {k for _, k in out}
    return out if "residue" in kinds else [(whole, "suspect" if "suspect" in kinds else "content")]


def pieces(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(doc, source, h, kind)``, a row per line or sentence; h is the hash of its form, kind its place in ``KINDS``.

    The kind depends on the form alone, so that equal forms have equal kinds wherever they are met.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        known: dict[str, list[tuple[int, int]]] = {}

        def read(piece: str, form: str) -> list[tuple[int, int]]:
            forms = [(form, classify(form))] if len(form) <= LONG else classify_long(piece.lower())
            return [(int.from_bytes(hashlib.blake2b((shared_form(f) if k == "residue" else f).encode(), digest_size=8).digest(), "little", signed=True), KINDS.index(k)) for f, k in forms if k in KINDS]

        for batch in batches:
            docs, sources, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            at, hashes, kinds = [], [], []
            for i, value in enumerate(texts):
                for piece in _ENDS.split(value.replace("\r", "\n")):
                    form = masked(piece)
                    if not form:
                        continue
                    if len(form) > LONG:
                        own = read(piece, form)
                    elif (own := known.get(form)) is None:
                        own = known[form] = read(piece, form)
                        if len(known) > 100_000:
                            known.clear()
                    for h, kind in own:
                        at.append(i)
                        hashes.append(h)
                        kinds.append(kind)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([docs.take(rows), sources.take(rows), pa.array(hashes, pa.int64()), pa.array(kinds, pa.int32())], names=["doc", "source", "h", "kind"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc {documents.schema[key].dataType.simpleString()}, source long, h long, kind int")


def _with_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Rows beside what is known of their form. Forms of more than ``HOT`` rows are fewer than a row in ``HOT``; these are broadcast."""
    few = forms.where(F.col("n") > HOT)
    if few.isEmpty():
        return rows.join(forms, "h")
    few = F.broadcast(few)
    rest = rows.join(few.select("h"), "h", "left_anti").join(forms.where(F.col("n") <= HOT), "h")
    return rest.unionByName(rows.join(few, "h"))


def find_residue(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key)`` of the documents that are residue, each once.

    Null, empty and blank texts, texts of labels or furniture alone and merely short texts are not residue; one
    sentence of content anywhere makes a text content. A null source counts as one source, documents without a key do not
    appear. An empty table gives no rows. Whole texts are read; what is shuffled are hashes.
    """
    slim = cut(pieces(documents.where(F.col(key).isNotNull()), key, text, source))
    # exact hashes across sources: what each form is by rule, and how widely it recurs
    by_source = slim.groupBy("h", "source").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    forms = cut(by_source.groupBy("h").agg(F.min("kind").alias("kind"), F.count("*").alias("sources"), F.sum("n").alias("n")))
    state = F.when(F.col("kind") == 0, "residue").when(F.col("sources") < SOURCES, "single").when(F.col("kind") == 1, "suspect").otherwise("content")
    met = _with_forms(slim.select("doc", "h"), forms.select("h", "n", "sources", state.alias("state")))
    # a form that is no residue by rule and does not recur is content, and so is its document
    verdict = met.groupBy("doc").agg(*[F.count_if(F.col("state") == k).alias(k) for k in ("residue", "single", "suspect", "content")])
    sure = verdict.where("residue > 0 and single = 0 and suspect = 0 and content = 0").select("doc")
    open_forms = cut(met.where("state in ('suspect', 'content')").select("h", "doc", "sources", "state").distinct().join(verdict.withColumnRenamed("content", "unnamed").drop("suspect"), "doc"))
    # beside residue: the longer the page, the more sources must show it, for an article that quotes an error is copied too;
    # what a rule suspects does not lengthen the page
    with_residue = F.expr(f"residue > 0 and unnamed + single <= {PIECES_EACH} * sources")
    beside = open_forms.groupBy("h").agg(F.count("*").alias("docs"), F.count_if(with_residue).alias("with_residue"))
    learned = cut(beside.where("with_residue >= 0.95 * docs").select("h"))
    # everywhere: forms of a share of all sources, in texts that hold nothing but such forms and residue
    least = max(WIDE, WIDE_SHARE * slim.agg(F.approx_count_distinct("source", 0.01)).first()[0])
    wide = cut(open_forms.where(F.col("sources") >= least).select("h").distinct())
    number = wide.count()
    while True:
        known = learned.union(wide).distinct().withColumn("known", F.lit(True))
        closed = open_forms.where("single = 0").join(known, "h", "left").groupBy("doc").agg(F.count_if(F.col("known").isNull()).alias("unknown")).where("unknown = 0").select("doc")
        if not number:
            break
        inside = open_forms.join(wide, "h", "left_semi").join(closed.withColumn("closed", F.lit(True)), "doc", "left")
        wide = cut(inside.groupBy("h").agg(F.count("*").alias("docs"), F.count("closed").alias("closed")).where("closed >= 0.95 * docs").select("h"))
        before, number = number, wide.count()
        if number == before:
            break
    return sure.union(closed).withColumnRenamed("doc", key)


def without_residue(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that are not residue; rows with a null key stay."""
    return documents.join(find_residue(documents, key, **options), key, "left_anti")
