"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not take part in keyword search of memories.
SEARCH_STOPWORDS = "the and for are was were what when where which who how why that this with from have has had you your our not but can did does about into its".split()
# Words that cannot stand at either end of a phrase.
FUNCTION_WORDS = "the a an and or of to in on for with by at from as is are was were be been it its this that these those which who when while if then than so not no yet but into over under between each any one more most other such".split()
# Verbs too light to start or end a phrase.
LIGHT_VERBS = "make made makes get gets got take takes took give gives gave use uses used keep keeps kept do does did have has had go goes went".split()
# Fixed pattern: signs of program code in a sentence.
CODE_SIGNS = r"[_{}=\\]|://|self\.|def |import "
# Fixed pattern: words that ask for the newest entries.
RECENCY = r"(?i)\b(latest|recent|recently|last|today|yesterday|newest|now|current|this week)\b"
# Titles that files carry when nobody set one.
JUNK_FIELDS = "untitled,unknown,none,null,title,author,various,n/a,microsoft word,document".split(",")


def plain_quotes(text: Column) -> Column:
    """Typographic quotes and apostrophes as ASCII."""
    return F.translate(text, "‘’‚“”„", "'''\"\"\"")


def words(text: Column) -> Column:
    """Words of letters with inner apostrophes or hyphens, at least two characters."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-]+"), F.lit(0))


def search_terms(text: Column, most: int = 12) -> Column:
    """The first ``most`` words of three or more ASCII word characters, in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{3,}"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(SEARCH_STOPWORDS)), 1, most)


def tokens(text: Column) -> Column:
    """All ASCII letter and digit runs in lower case, the tokens of the postings."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def phrase_words(text: Column) -> Column:
    """Lower-case words with plain quotes, the input of ``phrases``."""
    return F.transform(words(plain_quotes(text)), lambda w: F.lower(w))


def phrases(own: Column, longest: int = 3) -> Column:
    """Distinct phrases of one to ``longest`` words that do not start or end with a function word or light verb.

    ``own`` is a stored column of ``phrase_words``; as an expression it would be evaluated for every phrase.
    """
    barred = FUNCTION_WORDS + LIGHT_VERBS

    def size(n: int) -> Column:
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.slice(own, i, n))
        kept = F.filter(grams, lambda g: F.forall(g, lambda w: (F.length(w) >= (4 if n == 1 else 3)) & ~w.contains("'")) & ~F.element_at(g, 1).isin(barred) & ~F.element_at(g, -1).isin(barred))
        return F.transform(kept, lambda g: F.array_join(g, " "))

    return F.array_distinct(F.concat(*[size(n) for n in range(1, longest + 1)]))


def is_prose(text: Column) -> Column:
    """At most two non-blank lines, or lines of 30 characters or more on average."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(F.trim(x)))
    return (F.size(lines) <= 2) | (total / F.size(lines) >= 30)


def looks_like_code(sentence: Column) -> Column:
    return sentence.rlike(CODE_SIGNS)


def wants_recent(text: Column) -> Column:
    return text.rlike(RECENCY)


def clean_field(value: Column) -> Column:
    """A title or author of a file, or null if it is junk: too short, too long, a default, or a file name."""
    tidy = F.trim(F.regexp_replace(F.trim(value), r"\s*[|–-]\s*[A-Za-z0-9-]+\.(com|org|net)\s*$", ""))
    junk = (F.length(tidy) < 3) | (F.length(tidy) > 200) | F.lower(tidy).isin(JUNK_FIELDS) | tidy.rlike(r"[_*]") | tidy.rlike(r"(?i)^\S+\.(pdf|epub|docx?|txt|md|html?)$")
    return F.when(~junk, tidy)


def title_from_path(path: Column) -> Column:
    """A readable title from a file name: no extension, separators as blanks, no leading number."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", "")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "[_-]+", " "), r"^\d{6,}\s*", ""), "([a-z])([A-Z])", "$1 $2"))
    return F.when(stem.rlike("^[0-9a-f]{16,}$"), F.concat(F.lit("Untitled ("), F.substring(stem, 1, 8), F.lit("…)"))).otherwise(F.initcap(spaced))


def slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def category_of(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\b(prefers?|always|never|don't)\b"), "preference").otherwise("fact")


def known_category(category: Column) -> Column:
    """A category in lower case; unknown ones become ``fact``, empty and null ones stay."""
    low = F.lower(F.trim(category))
    return F.when(low == "", "").when(low.isin("fact", "preference", "goal", "event", "decision"), low).when(low.isNotNull(), "fact")


def unfenced(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
