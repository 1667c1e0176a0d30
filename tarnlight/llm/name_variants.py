"""Variant spellings of names, linked by merging matched profiles and matching the richer profiles again.

A name is parsed once into a person (surname, given name or initial, middle initials) or an organisation (core word,
initials of its kind). Equal parses are one profile. In each round every profile enters blocks by all its surnames or cores (and
their forms with one letter left out, so that one-letter slips share a block); matched profiles are merged through connected components, and the merged profile enters the blocks of the next round with the
spellings, given names and initials of all its members: what one member shows of the surname and another of the
given name counts together. The rounds end when nothing merges any more. Work is done on distinct names, so a name that holds
a third of the rows is one record.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.operators.components import connected_components
from tarnlight.session import cut

# Short and pet forms of given names, with the full forms they may stand for.
PET_FORMS = {
    "alexander": "alex alec sandy sasha xander al", "aleksandra": "ola sasha alex sandra", "alexandra": "alex sandra sasha lexi",
    "anais": "nana", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benji",
    "casimir": "caz kazik caspar", "catherine": "cathy kate katie kit", "charles": "charlie chuck chas", "charlotte": "charlie lottie lotte char",
    "christopher": "chris kit topher", "daniel": "dan danny", "daniela": "dani danni ella", "david": "dave davy", "dorothea": "dora thea dot dorrie dolly",
    "edmund": "ned ed eddie ted", "edward": "ed eddie ned ted", "elizabeth": "liz beth eliza betty lizzie lisa bess libby elsie", "francisco": "paco pancho paquito fran",
    "frederick": "fred freddie freddy rick", "giulia": "giuli julia", "gregory": "greg gregg", "haruto": "haru", "hendrik": "henk rik hen",
    "henrietta": "etta hettie hattie henny retta", "henry": "harry hank hal", "ingrid": "inga inge", "isabella": "bella izzy isa ella belle", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "john": "jack johnny", "jose": "pepe chepe joselito", "joseph": "joe joey", "josephine": "jo josie fifi posy", "jurgen": "jurg",
    "katherine": "kathy kate katie kat kitty kit kay", "leonard": "leo len lenny", "lukasz": "lukas luka", "malgorzata": "gosia malgosia", "margaret": "maggie peggy meg greta madge daisy",
    "marisol": "mari sol", "matthew": "matt", "michael": "mike mick mikey", "mirela": "mira", "nathaniel": "nat nate nathan", "nicholas": "nick nicky",
    "olena": "lena olenka", "ondrej": "ondra", "patricia": "pat patty trish", "philippa": "pippa pip", "quentin": "quinn", "renee": "ren",
    "richard": "rick dick rich", "robert": "bob rob bobby robbie bert", "rosalind": "roz rosie ros rosa lindy", "samuel": "sam sammy", "stephen": "steve",
    "susannah": "sue susie suzy sanna", "thandiwe": "thandi", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "tomasz": "tomek tomas",
    "ursula": "ulla uschi ursa", "victoria": "vicky tori vic vicki", "viktor": "vitya vik", "wilhelmina": "willa mina minnie billie wilma", "william": "will bill billy willy liam",
    "xavier": "xavi xav", "yusuf": "yus",
}
# Words that tell an organisation, with their usual abbreviations.
KIND_WORDS = {
    "association": "assoc assn", "centre": "ctr center cntr", "college": "coll", "company": "co", "consulting": "cons", "corporation": "corp", "council": "", "department": "dept dep",
    "foundation": "fdn found", "group": "grp", "house": "", "institute": "inst", "international": "intl int", "laboratory": "lab", "learning": "lrng", "library": "lib",
    "museum": "mus", "office": "off", "press": "", "publishing": "publ pub", "research": "res", "school": "sch", "science": "sci", "sciences": "", "society": "soc",
    "studies": "stud", "systems": "sys", "university": "univ uni", "applied": "appl", "academy": "acad", "archives": "arch", "archivists": "",
}
TITLES = "dr prof professor mr mrs ms mx sir dame rev phd md msc bsc ba ma mba esq jr sr dphil".split()
LEGAL = "gmbh ab ltd limited inc sa llc plc ag bv nv oy srl spa kg as corp".split()
SMALL_WORDS = "of for the and de du des der fur in".split()
FULL_FORM = {short: word for word, forms in KIND_WORDS.items() for short in [word, *forms.split()]}
SHORT_FOR: dict[str, list[str]] = {}
for _name, _forms in PET_FORMS.items():
    SHORT_FOR.setdefault(_name, []).append(_name)
    for _form in _forms.split():
        SHORT_FOR.setdefault(_form, []).append(_name)
#: The letters that an initial may stand for: a person may sign with the initial of a pet form.
INITIALS = {name: "".join(sorted({f[0] for f in [name, *forms.split()]})) for name, forms in PET_FORMS.items()}
#: Letters that a surname or core word has at least if a slip in it is to be linked.
SLIP = 4
#: Profiles of a block beyond which it is dealt out, and into how many parts.
HOT_BLOCK, HOT_PARTS = 2_000, 32
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without diacritics."""
    plain = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    return "".join(c for c in plain if not unicodedata.combining(c))


def respell(word: str) -> str:
    """One letter for letters that sound alike."""
    return word.replace("ph", "f").replace("ck", "k").replace("c", "k").replace("y", "i")


def one_slip(a: str, b: str) -> bool:
    """True if a and b differ by one letter changed, added, left out, or by two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _is_given(word: str) -> bool:
    return word in SHORT_FOR or (len(word) > 3 and any(abs(len(word) - len(g)) < 2 and one_slip(word, g) for g in PET_FORMS))


def parse_name(name: str | None) -> tuple | None:
    """``(kind, head, given, sure, middle, order, other_head, other_given)`` of a name, or None if it is neither a person's nor an organisation's.

    The last three tell whether the order of a person's name is stated by a comma (``comma``), follows from a listed given name or an
    initial (``listed``) or is open, and if so the head and given name of the other order.

    ``kind`` is person or organisation, ``head`` the surname or core word, ``given`` the full forms the given
    name may stand for (or its initial) or the initials of the organisation's kind, ``sure`` whether ``given`` is one
    full name, ``middle`` the middle initials.
    """
    if not name or not name.strip():
        return None
    parts = [re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\.", p.replace("S.A.", "SA").replace("s.a.", "sa").replace("Ph.D", "PhD")) for p in name.split(",")]
    parts = [[w for w in p if w != "."] for p in parts]
    raw = [w for p in parts for w in p]
    folded = [[fold(w) for w in p] for p in parts]
    flat = [w for p in folded for w in p]
    legal = any(w in LEGAL for w in flat[1:])
    last = raw[-1] if raw else ""
    short = len(raw) == 2 and last.isupper() and 2 <= len(last) <= 4 and fold(last) not in SHORT_FOR and not _is_given(flat[0]) and len(flat[0]) > 2 and fold(last) not in TITLES
    kinds = [w for w in flat if w in FULL_FORM]
    if legal or short or kinds:
        pieces = [[w for w in p if w not in LEGAL] for p in folded]
        pieces = [p for p in pieces if p]
        words = [w for p in (reversed(pieces) if len(pieces) > 1 else pieces) for w in p if w != "the"]
        if len(words) < 2 or words[0] in SMALL_WORDS:
            return None if len(words) != 1 or not legal else ("organisation", respell(words[0]), [""], True, [], "listed", None, None)
        if short:
            return "organisation", respell(words[0]), [words[-1]], True, [], "listed", None, None
        return "organisation", respell(words[0]), ["".join(w[0] for w in words[1:] if w not in SMALL_WORDS)], True, [], "listed", None, None
    pieces = [[w for w in p if w not in TITLES] for p in folded]
    pieces = [p for p in pieces if p]
    words = [w for p in pieces for w in p]
    if len(words) < 2:
        return None
    if len(pieces) > 1:
        head, rest = pieces[0][-1], [w for p in pieces[1:] for w in p] + pieces[0][:-1]
    elif (len(words[-1]) == 1 or _is_given(words[-1])) and len(words[0]) > 1 and not _is_given(words[0]):
        head, rest = words[0], [*words[-1:], *words[1:-1]]
    else:
        head, rest = words[-1], words[:-1]
    given = rest[0]
    order, other = "comma" if len(pieces) > 1 else "listed", (None, None)
    if len(pieces) == 1 and len(given) > 1 and len(head) > 1 and not _is_given(given) and not _is_given(head):
        order, other = "open", (respell(given), head)
    middle = sorted({w[0] for w in rest[1:]})
    if len(given) == 1:
        return "person", respell(head), [given], False, middle, order, *other
    full = SHORT_FOR.get(given) or [g for g in PET_FORMS if len(given) > 2 and one_slip(given, g)] or [given]
    return "person", respell(head), sorted(full), len(full) == 1, middle, order, *other


def parse_names(names: DataFrame) -> DataFrame:
    """``(name, kind, head, given, sure, middle)`` of the distinct non-null names that can be parsed.

    Where no comma, initial or listed given name tells which word is the surname, the corpus does: the order is turned if the
    word taken for the surname stands more often for given names in names with a comma than the other one.
    """
    columns = ["name", "kind", "head", "given", "sure", "middle", "order", "other_head", "other_given"]

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(name, *parsed) for name in batch["name"] if (parsed := parse_name(name))]
            yield pd.DataFrame(rows, columns=columns)

    # the number of partitions is stated, or a few names would be parsed in one task
    distinct = names.select("name").where("name is not null").distinct().repartition(names.sparkSession.sparkContext.defaultParallelism)
    parsed = cut(distinct.mapInPandas(run, "name string, kind string, head string, given array<string>, sure boolean, middle array<string>, order string, other_head string, other_given string"))
    stated = parsed.where("kind = 'person' and order = 'comma' and sure")
    words = stated.select(_respelled(F.col("given")[0]).alias("word"), F.lit(1).alias("as_given")).union(stated.select("head", F.lit(-1))).groupBy("word").agg(F.sum("as_given").alias("as_given"))
    open_ = parsed.where("order = 'open'")
    turned = open_.join(words.withColumnsRenamed({"word": "head", "as_given": "of_head"}), "head", "left").join(words.withColumnsRenamed({"word": "other_head", "as_given": "of_given"}), "other_head", "left")
    turn = F.coalesce("of_head", F.lit(0)) > F.coalesce("of_given", F.lit(0))
    turned = turned.select("name", "kind", F.when(turn, F.col("other_head")).otherwise(F.col("head")).alias("head"), F.when(turn, F.array("other_given")).otherwise(F.col("given")).alias("given"), "sure", "middle")
    return parsed.where("order <> 'open'").select(turned.columns).unionByName(turned)


def _respelled(word: Column) -> Column:
    """``respell`` as a column."""
    for sound, letter in (("ph", "f"), ("ck", "k"), ("c", "k"), ("y", "i")):
        word = F.replace(word, F.lit(sound), F.lit(letter))
    return word


def slipped(a: Column, b: Column) -> Column:
    """``one_slip`` as a column."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(a.substr(F.lit(1), i - 1), a.substr(i + 1, F.lit(1)), a.substr(i, F.lit(1)), a.substr(i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b, 1) == 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b) & swapped)


def _any_slip(a: Column, b: Column, least: int) -> Column:
    return F.exists(a, lambda x: (F.length(x) >= least) & F.exists(b, lambda y: (F.length(y) >= least) & slipped(x, y)))


def _all_of(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def _keys() -> Column:
    """``(key, head)`` of the blocks of a profile: each head itself, and each with one letter left out, which also names its head."""
    entry = lambda key, head: F.struct(F.xxhash64("kind", key).alias("key"), head.alias("head"))
    whole = F.transform("heads", lambda h: entry(h, F.lit(0).cast("long")))
    less = F.flatten(F.transform(F.filter("heads", lambda h: F.length(h) >= SLIP), lambda h: F.transform(F.sequence(F.lit(0), F.length(h)), lambda i: entry(F.concat(F.when(i > 0, F.concat(h.substr(F.lit(1), i - 1), h.substr(i + 1, F.length(h)))).otherwise(h), F.lit("-")), F.xxhash64(h)))))
    return F.array_distinct(F.concat(whole, less))


def match_profiles(profiles: DataFrame) -> DataFrame:
    """``(a, b, certain, rank, a_rooted, b_rooted)``: pairs of profiles of which one is fresh, that share a block and may be one entity."""
    blocked = profiles.select("root", "fresh", F.explode(_keys()).alias("k")).select("root", "fresh", "k.key", "k.head")
    # a hot block is dealt out: its rows meet in HOT_PARTS tasks, the other side being repeated
    size = blocked.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > HOT_BLOCK).select("key", F.lit(HOT_PARTS).alias("parts"))
    blocked = blocked.join(size, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = blocked.select("key", F.pmod(F.xxhash64("root"), F.col("parts")).alias("part"), F.col("root").alias("a"), F.col("fresh").alias("a_fresh"), F.col("head").alias("a_head"))
    right = blocked.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.col("root").alias("b"), F.col("fresh").alias("b_fresh"), F.col("head").alias("b_head"))
    # equal heads meet in their own block alone, not in those of their slips
    pairs = left.join(right, ["key", "part"]).where("a < b and (a_fresh or b_fresh) and (a_head <> b_head or a_head = 0)").select("a", "b").distinct()
    side = lambda x: profiles.select(F.col("root").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("kind", "heads", "fulls", "opens", "middles")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_kind = b_kind")
    person = F.col("a_kind") == "person"
    given = {x: F.when(F.size(f"{x}_fulls") > 0, F.col(f"{x}_fulls")).otherwise(F.col(f"{x}_opens")) for x in "ab"}
    letters = F.create_map(*[F.lit(x) for pair in INITIALS.items() for x in pair])

    def stands_for(short: str, full: Column, direct: bool) -> Column:
        return F.exists(short, lambda g: (F.length(g) == 1) & F.exists(full, lambda h: h.startswith(g) if direct else F.coalesce(letters[h], h.substr(1, 1)).contains(g)))

    equal_head = F.arrays_overlap("a_heads", "b_heads")
    overlap = F.arrays_overlap(given["a"], given["b"])
    direct = overlap | stands_for("a_opens", given["b"], True) | stands_for("b_opens", given["a"], True)
    initial = stands_for("a_opens", given["b"], False) | stands_for("b_opens", given["a"], False)
    free = (F.size("a_middles") == 0) | (F.size("b_middles") == 0) | F.arrays_overlap("a_middles", "b_middles")
    rooted = {x: F.size(f"{x}_fulls") > 0 for x in "ab"}
    slip = _any_slip(F.col("a_heads"), F.col("b_heads"), SLIP)
    met = met.where(free & (equal_head | slip))
    met = met.withColumns({"equal_head": equal_head, "overlap": overlap, "direct": direct, "initial": initial, "a_rooted": rooted["a"], "b_rooted": rooted["b"]})
    met = met.withColumn("given_slip", F.col("equal_head") & F.col("a_rooted") & F.col("b_rooted") & ~F.col("overlap") & _any_slip(F.col("a_fulls"), F.col("b_fulls"), 2))
    fits = F.when(F.col("equal_head"), F.col("overlap") | F.col("given_slip") | (person & F.col("initial"))).otherwise((F.col("overlap") | (person & F.col("initial"))) & slip)
    met = met.where(fits)
    certain = F.col("a_rooted") & F.col("b_rooted") & (F.col("overlap") | F.col("given_slip"))
    rank = F.when(F.col("equal_head") & F.col("direct"), 0).when(F.col("equal_head"), 1).when(F.col("direct"), 2).otherwise(3)
    return met.select("a", "b", certain.alias("certain"), rank.alias("rank"), "a_rooted", "b_rooted")


def link_variants(names: DataFrame) -> DataFrame:
    """``(name, entity)``: every parsed name with the smallest name of its entity; input column ``name``.

    Null, empty and unparsable names (a single word without a legal form, digits, junk) get no row. Names
    that differ only in case, spacing, accents, titles, order, pet form or legal form parse alike. Repeated names
    count once. No names give no rows. A short form or an initial that fits several persons stays unlinked; surnames that
    differ by one slip are one if the given names agree and no middle initial contradicts, unless they have fewer than ``SLIP`` letters.
    """
    parsed = cut(parse_names(names))
    entry = ["kind", "head", "given", "sure"]
    spelling = parsed.groupBy(*entry).agg(F.min("name").alias("root"), _all_of("middle").alias("middles"))
    none = F.array().cast("array<string>")
    profiles = cut(spelling.select(
        "root", "kind", F.array("head").alias("heads"), F.when(F.col("sure"), F.col("given")).otherwise(none).alias("fulls"), F.when(F.col("sure"), none).otherwise(F.col("given")).alias("opens"), "middles", F.lit(True).alias("fresh"),
    ))
    labels = spelling.select(*entry, F.col("root").alias("first"), "root")
    before = None
    while True:
        # what is known of pairs that did not change stays
        pairs = match_profiles(profiles)
        pairs = cut(pairs.union(before) if before is not None else pairs)
        merges = pairs.where("certain").select("a", "b")
        if merges.isEmpty():
            # a profile with only initials or open short forms joins the one full profile that it fits
            sides = [pairs.where(f"not {x}_rooted").select(F.col(x).alias("u"), F.col(y).alias("v"), (F.col("rank") + F.when(F.col(f"{y}_rooted"), 0).otherwise(4)).alias("rank")) for x, y in ("ab", "ba")]
            towards = sides[0].union(sides[1])
            fit = towards.groupBy("u", "rank").agg(F.count("*").alias("n"), F.min("v").alias("v"))
            best = fit.groupBy("u").agg(F.min_by(F.struct("n", "v"), "rank").alias("best"))
            merges = best.where("best.n = 1").select(F.col("u").alias("a"), F.col("best.v").alias("b"))
            if merges.isEmpty():
                break
        moved = connected_components(merges, "a", "b").withColumnsRenamed({"node": "root", "component": "to"})
        changed = moved.select("root")
        before = pairs.join(changed.withColumnRenamed("root", "a"), "a", "left_anti").join(changed.withColumnRenamed("root", "b"), "b", "left_anti").select(pairs.columns)
        profiles = profiles.join(moved, "root", "left").withColumn("fresh", F.col("to").isNotNull()).withColumn("root", F.coalesce("to", "root"))
        profiles = profiles.groupBy("root").agg(F.first("kind").alias("kind"), F.max("fresh").alias("fresh"), *[_all_of(c).alias(c) for c in ("heads", "fulls", "opens", "middles")])
        profiles = cut(profiles)
        labels = cut(labels.join(moved, "root", "left").select(*entry, "first", F.coalesce("to", "root").alias("root")))
    return parsed.join(labels, entry).select("name", F.col("root").alias("entity"))


def variant_pairs(names: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, name_a < name_b by code point: every two spellings of one entity."""
    linked = link_variants(names)
    other = linked.select(F.col("name").alias("name_b"), "entity")
    return linked.withColumnRenamed("name", "name_a").join(other, "entity").where("name_a < name_b").select("name_a", "name_b")
