"""Names, slugs, similarity and text classes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes of company names, in the order in which they are taken off, each once.
MATCH_SUFFIXES = (r"ipo", r"fpo", r"limited", r"ltd\.?", r"private\s+limited", r"pvt\.?\s+ltd\.?", r"pvt\.?", r"private", r"inc\.?", r"incorporated", r"corp\.?", r"corporation", r"llc", r"llp", r"plc")

# Suffix, and how a slug writes it.
SLUG_SUFFIXES = ((r"ipo", ""), (r"fpo", ""), (r"limited", "-ltd"), (r"ltd\.?", "-ltd"), (r"private\s+limited", "-private-ltd"), (r"pvt\.?\s+ltd\.?", "-pvt-ltd"), (r"pvt\.?", "-pvt"), (r"private", "-private"), (r"inc\.?", "-inc"), (r"incorporated", "-incorporated"), (r"corp\.?", "-corp"), (r"corporation", "-corporation"), (r"llc", "-llc"), (r"llp", "-llp"), (r"plc", "-plc"))

# Symbols that a slug spells out.
SLUG_SYMBOLS = (("&", "and"), ("+", "plus"), ("@", "at"), ("%", "percent"), ("₹", "rs"), ("$", "dollar"), ("€", "euro"), ("£", "pound"))

# Suffixes that go as often as they occur.
LEGAL_WORDS = ("private", "pvt", "limited", "ltd", "incorporated", "inc", "corporation", "corp", "llc", "llp", "plc")


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Replacements one after the other."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_key(name: Column) -> Column:
    """Company name as a key for matching: no status codes, legal suffixes, brackets or hyphens."""
    text = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    text = F.regexp_replace(text, r"(\bltd\.?|\blimited)\s+[a-z]{1,2}$", "$1")
    text = squeezed(chain(text, (r"\.", " "), ("&", " and ")))
    text = F.trim(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", ""))
    text = chain(text, *((rf"\s+{s}$", "") for s in MATCH_SUFFIXES))
    return squeezed(chain(text, (r"[()]", " "), ("-", " ")))


def compact_key(name: Column) -> Column:
    """``match_key`` without spaces: a fallback for compounds that are written apart or together."""
    return F.regexp_replace(match_key(name), r"\s+", "")


def display_name(name: Column) -> Column:
    """Name to show: no tags, status codes or instrument labels, at most 200 characters."""
    text = F.trim(chain(F.coalesce(name, F.lit("")), (r"</?[a-z][a-z0-9]*[^>]*>", ""), ("[<>]", "")))
    text = chain(text, (r"(?i)(\bLtd\.?|\bLimited)\s+[A-Za-z]{1,2}$", "$1"), (r"(?i)\s+(IPO|FPO)$", ""))
    return F.left(F.trim(text), F.lit(200))


def legal_key(name: Column) -> Column:
    """Name without special characters and without any run of legal suffixes at its end."""
    text = chain(F.trim(F.lower(F.coalesce(name, F.lit("")))), ("[&()'.]", ""), ("[-_]", " "))
    text = chain(text, (rf"(\s+({'|'.join(LEGAL_WORDS)}))+\s*$", ""), (r"\s+ipo\s*$", ""))
    return squeezed(text)


# Words that names in listing reports are compared without.
LISTING_WORDS = ("limited", "ltd", "private", "pvt", "public", "company", "co", "corporation", "corp", "the")


def listing_key(name: Column) -> Column:
    """Name in a listing report: no legal words wherever they stand, only letters and digits."""
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "&", " and ")
    return squeezed(F.regexp_replace(F.regexp_replace(low, rf"\b({'|'.join(LISTING_WORDS)})\b", " "), "[^a-z0-9]+", " "))


def bare_key(name: Column) -> Column:
    """Only letters and digits, in lower case: groups that differ in punctuation alone."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def without_words(name: Column, words: tuple[str, ...]) -> Column:
    """Name in lower case without the words given, wherever they stand; for matchers with word lists of their own."""
    return squeezed(F.regexp_replace(F.lower(name), rf"\b({'|'.join(words)})\b\.?", " "))


def slug(name: Column, suffix: str = "", longest: int = 100) -> Column:
    text = chain(F.trim(F.lower(F.coalesce(name, F.lit("")))), *((rf"\s+{s}$", to) for s, to in SLUG_SUFFIXES))
    text = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(f" {s[1]} ")), SLUG_SYMBOLS, text)
    text = chain(text, ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))
    text = F.concat(text, F.lit(suffix)) if suffix else text
    return F.when(F.length(text) > longest, F.regexp_replace(F.left(text, F.lit(longest)), "-+$", "")).otherwise(text)


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def slug_to_name(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("-"), F.lit(" ")))


def numbered(base: Column, place: Column) -> Column:
    """The first of equal slugs as it is, the others with their place, counted from 2."""
    return F.when(place == 1, base).otherwise(F.concat(base, F.lit("-"), place.cast("string")))


def edit_similarity(a: Column, b: Column) -> Column:
    """Share of the longer text that stays under the fewest edits; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def character_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0.9 where one holds the other, else the Jaccard measure of their characters."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.9).otherwise(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))))


def token_overlap(a: Column, b: Column, shortest: int = 4) -> Column:
    """Share of the longer words of ``a`` that occur in ``b``."""
    terms = F.filter(F.split(a, r"\s+"), lambda t: F.length(t) >= shortest)
    return F.try_divide(F.size(F.filter(terms, lambda t: b.contains(t))), F.size(terms))


def trigrams(text: Column) -> Column:
    """Distinct three-letter parts of the words of a text, each word padded by two spaces before and one after.

    Words are runs of letters, their marks and digits of any script.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")

    def parts(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, parts)))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def weighted_search_score(query: str, fields: dict[str, tuple[Column, float]]) -> Column:
    """Trigram similarity of a search text with several fields, by weight; an approximation of fuzzy search."""
    total = sum(w for _, w in fields.values())
    return reduce(lambda a, b: a + b, [trigram_similarity(F.lit(query), F.coalesce(c, F.lit(""))) * w for c, w in fields.values()]) / total


def clean_registrar(text: Column) -> Column:
    """The part of a scraped field that names the registrar: with a key word, else the one with most letters."""
    parts = F.filter(F.transform(F.split(text, r"[\^\t\n\r]+"), lambda p: F.trim(p)), lambda p: p != "")
    named = F.filter(parts, lambda p: p.rlike("(?i)registrar|ltd|limited|services|private"))
    letters = F.transform(parts, lambda p: F.struct((-F.length(F.regexp_replace(p, "[^A-Za-z]", ""))).alias("n"), p.alias("p")))
    best = F.coalesce(F.get(named, F.lit(0)), F.get(F.array_sort(letters), F.lit(0))["p"])
    return F.trim(F.regexp_replace(best, r"(?i)\s*(Tel\.?:|E-?mail:|Phone:).*$", ""))


def split_list(text: Column, separators: str = "[,;/]+") -> Column:
    """The distinct entries of a list in a text, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, separators), lambda p: F.trim(p)), lambda p: p != ""))


def contains_all(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [text.contains(w) for w in words])


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def keyword_score(text: Column, weights: dict[tuple[str, ...], int]) -> Column:
    """Sum of the weights whose words occur in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.when(contains_any(low, words), w).otherwise(0) for words, w in weights.items()])


def like_pattern(text: str) -> str:
    """A user's search text as a LIKE pattern that takes it word for word."""
    return "%" + text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"


def document_type(title: Column) -> Column:
    """Class of a filing by its title."""
    t = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    draft = t.contains("draft")
    return (
        F.when((draft & contains_any(t, ("red", "herring", "prospectus"))) | t.contains("drhp"), "DRHP")
        .when(~draft & (contains_all(t, ("red", "herring")) | t.contains("rhp")), "RHP")
        .when(contains_all(t, ("basis", "allotment")) | t.contains("allotment status"), "BASIS_OF_ALLOTMENT")
        .when(t.contains("prospectus") & ~draft & ~contains_any(t, ("red", "herring")), "PROSPECTUS")
        .otherwise("ADDENDUM")
    )


def media_type(title: Column) -> Column:
    return F.when(contains_any(F.lower(title), ("audiovisual", "audio visual", "video", "multimedia")), "VIDEO").otherwise("PDF")


# Class of an offering, and a pattern in its type in capitals; the first that fits counts.
OFFERING_PATTERNS = (("TENDER", r"\bOTB\b"), ("NCD", r"\bDPI\b|DEBT ISSUE"), ("RIGHTS", r"\bRI\b|RIGHTS"), ("NCD", "NCD|DEBENTURE"), ("BONDS", "BOND"), ("FPO", "FPO|FOLLOW"), ("OFS", "OFS|OFFER FOR SALE"), ("INVITS", "INVIT|INV IT|INFRASTRUCTURE INVESTMENT TRUST"), ("REITS", "REIT|REAL ESTATE INVESTMENT TRUST"), ("IPP", "IPP|INSTITUTIONAL PLACEMENT PROGRAMME"), ("QIP", "QIP|QUALIFIED INSTITUTIONAL PLACEMENT"), ("PREFERENTIAL", "PREFERENTIAL"))
SYMBOL_PATTERNS = (("TENDER", "TDR$|TENDER"), ("BUYBACK", "BUYBACK"), ("DELISTING", "DELISTING"))


def first_pattern(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """The class of the first pattern that occurs in a text in capitals; null without one."""
    up = F.upper(F.trim(text))
    return F.coalesce(*[F.when(up.rlike(p), name) for name, p in patterns])


def offering_type(symbol: Column, kind: Column, issue_type: Column) -> Column:
    """Class of an offering from its symbol, else its type, else its issue type; IPO by default."""
    return F.coalesce(first_pattern(symbol, SYMBOL_PATTERNS), first_pattern(kind, OFFERING_PATTERNS), first_pattern(issue_type, OFFERING_PATTERNS), F.lit("IPO"))


def segment(exchanges: Column) -> Column:
    """SME if one of the exchanges is a platform for small companies."""
    return F.when(F.exists(F.coalesce(exchanges, F.array()), lambda e: F.upper(e).rlike("SME|EMERGE")), "SME").otherwise("MAINBOARD")


def keep_class(existing: Column, incoming: Column) -> Column:
    """A default class doesn't overwrite a better one."""
    return F.when(existing.isNotNull() & (existing != "IPO") & (incoming == "IPO"), existing).otherwise(incoming)


def is_isin(text: Column) -> Column:
    return text.rlike("^IN[EF][0-9A-Z]{9}$")


def clean_symbol(text: Column) -> Column:
    up = F.upper(F.trim(text))
    return F.when(up.rlike(r"^[A-Z0-9\-]+$"), up)


def string_hash(text: Column) -> Column:
    """32-bit hash of a text, h * 31 + code, with the overflow of 32-bit integers."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


def in_sample(key: Column, percent: int) -> Column:
    """Whether a key belongs to a deterministic sample of so many per cent."""
    return F.abs(string_hash(key)) % 100 < percent
