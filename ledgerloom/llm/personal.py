"""Personal data in texts, in DataFrame functions only: fixed forms first, then bootstrapped contextual extraction.

Fixed forms (``FORMS``) give the seed entities.  Their places are counted in code points: a regular expression cuts a
text into gaps and hits, and a fold over both adds up the lengths.

Bootstrapping: the token runs that a slot of a kind can hold (``LOOSE``: digits in any groups, spelt-out addresses, hex
groups) give candidates, cut whole.  One that is a valid fixed form of another kind or fails the checks of its own
(checksum, number of digits or groups, a date) is contradicted.  Seeds and candidates have the words around them; a
lexical pattern is the kind with the two words before, or with the word on either side.  Patterns and distinct values
are the two sides of a graph.  In each round

* a pattern's score is the summed score of its values over that sum and its contradicted values; what is unknown yet
  counts neither way.  It is trusted with at least ``SUPPORT`` values that have a score, and a score of ``TRUST``;
* a candidate's score is the best of its trusted patterns, at most the pattern's own score; known values have 1.

Candidates that trusted patterns reach are new identifiers and support further patterns in the next round, until a round
reaches no more; as scores only grow, what is reached does.  All tables
of the rounds hold distinct (pattern, value) pairs; a frequent pattern or value is summed before it moves.

Null texts have no spans.  Spans of a kind don't overlap; spans of the method don't touch those of a fixed form.
Repeated rows get equal values.  Other columns are left alone.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_side

KINDS = ("email", "ip", "card", "phone")

#: Fixed forms.  Possessive repeats and look-behinds keep the work linear; they match what the plain forms
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]`` match.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no hit of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

_NAME = r"[A-Za-z0-9._%+-]++"
_DOT = r"[\[({<]\x20?(?:dot|DOT)\x20?[\])}>]"
#: Token runs that count only in a trusted context.  Digits are taken in any groups; ``plausible`` says what can't be.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:\x20(?:dot|DOT)\x20{_NAME})*+(?:\x20?[\[({{<]\x20?(?:at|AT)\x20?[\])}}>]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|{_DOT})\x20?[A-Za-z0-9-]{{2,}}+|\x20(?:dot|DOT)\x20[A-Za-z0-9-]{{2,}}+)++|(?:\x20(?:at|AT)\x20|\x20@\x20)[A-Za-z0-9-]++(?:(?:\.|\x20(?:dot|DOT)\x20|\x20?{_DOT}\x20?)[A-Za-z0-9-]{{2,}}+)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?=[:]*[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])|[0-9]{1,3}(?:\x20?(?:\.|[\[(](?:\.|dot|DOT)[\])])\x20?[0-9]{1,3}|\x20(?:dot|DOT)\x20[0-9]{1,3}){3}(?![0-9A-Za-z]))",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]?[0-9]){12,}+(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9](?:\)?[\x20./-]?\(?[0-9]){5,}+(?![A-Za-z])",
}
#: A text without this has no candidate of the kind.
LOOSE_NEEDS = {"email": r"(?:at|AT)[\x20\])}>]|\x20@\x20", "ip": "[0-9:]", "card": "[0-9]", "phone": "[0-9]"}

SUPPORT = 5
TRUST = 0.8
#: Code points on either side of a span in which its context is looked for first; longer words are looked for in all of
#: the text.
REACH = 128
SPAN = "array<struct<start:int,end:int,value:string>>"


def hits(text: Column, form: str) -> tuple[Column, Column]:
    """What stands between the matches of a form, and the matches."""
    return F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        size = F.length(digits)
        digit = lambda i: F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        doubled = lambda i: digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)
        total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(i)).otherwise(digit(i)))
        return F.when((F.length(value) >= 13) & size.between(13, 19), total % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def plausible(kind: str, value: Column) -> Column:
    """Whether a candidate can be of the kind at all."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
        six = F.when(value.contains("::"), (groups <= 7) & ~value.rlike("::.*::|:::|^:[^:]|[^:]:$")).otherwise((groups == 8) & ~value.rlike("^:|:$"))
        four = F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("int") <= 255)
        return F.when(value.contains(":"), six).otherwise(four)
    if kind == "card":
        return valid("card", value)
    if kind == "phone":
        year, month, day = "(?:19|20)[0-9]{2}", "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])"
        dates = "|".join(rf"{a}([./-]){b}{r}{c}" for a, b, c, r in ((year, month, day, r"\1"), (day, month, year, r"\2"), (month, day, year, r"\3")))
        return F.length(digits).between(6, 15) & ~value.rlike(rf"^(?:{dates})(?:\x20[0-9]{{1,2}})?$")
    return F.lit(True)


def placed(gaps: Column, found: Column, accept) -> Column:
    """Start, end and value of the matches that ``accept`` takes."""
    none = F.array().cast(SPAN)
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, i: Column) -> Column:
        value = F.get(found, i)
        start = acc["at"] + F.char_length(F.get(gaps, i))
        end = start + F.char_length(value)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value")))
        return F.struct(end.alias("at"), F.when(accept(value), F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    some = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, add, lambda acc: acc["spans"])
    return F.when(F.exists(found, lambda v: accept(v)), some).otherwise(none)


def spans_of(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of each kind, named as the kind, and candidates of each, named loose_ and the kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = {}
    for prefix, forms in (("", FORMS), ("loose_", LOOSE)):
        for kind, form in forms.items():
            gaps, found = hits(F.col("whole"), form)
            needs = F.contains("whole", F.lit(NEEDS[kind])) if not prefix else F.col("whole").rlike(LOOSE_NEEDS[kind])
            empty = F.array().cast("array<string>")
            cut[f"gaps_{prefix}{kind}"] = F.when(needs, gaps).otherwise(empty)
            cut[f"hits_{prefix}{kind}"] = F.when(needs, found).otherwise(empty)
    df = docs.withColumn("whole", text).withColumns(cut)
    spans = {k: placed(F.col(f"gaps_{k}"), F.col(f"hits_{k}"), partial(valid, k)) for k in KINDS}
    spans |= {f"loose_{k}": placed(F.col(f"gaps_loose_{k}"), F.col(f"hits_loose_{k}"), lambda v: F.lit(True)) for k in KINDS}
    return df.withColumns(spans).drop(*cut)


def overlaps(span: Column, others: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.exists(o, lambda x: (x["start"] < span["end"]) & (span["start"] < x["end"])) for o in others])


def with_context(kind: str, spans: Column, others: list[Column] | None = None) -> Column:
    """The spans with their patterns: two words before, and the words on either side.

    With ``others``, the spans of fixed forms of other kinds, these are candidates; otherwise they are known.
    """
    word = r"[^\x20\x09-\x0D]+"

    def one(s: Column) -> Column:
        low = F.greatest(s["start"] - REACH, F.lit(0))
        near, behind = F.substring(F.col("whole"), low + 1, s["start"] - low), F.substring(F.col("whole"), s["end"] + 1, F.lit(REACH))
        # Whole where a space ends the second word, or the text does.
        held = (low == 0) | near.rlike(rf"[\x20\x09-\x0D]{word}[\x20\x09-\x0D]+{word}[\x20\x09-\x0D]*$")
        held_behind = (F.length(behind) < REACH) | behind.rlike(rf"^[\x20\x09-\x0D]*{word}[\x20\x09-\x0D]")
        before = F.lower(F.when(held, near).otherwise(F.substring(F.col("whole"), F.lit(1), s["start"])))
        after = F.lower(F.when(held_behind, behind).otherwise(F.substring(F.col("whole"), s["end"] + 1, F.length(F.col("whole")))))
        left = F.regexp_extract(before, rf"({word}[\x20\x09-\x0D]+)?({word})[\x20\x09-\x0D]*$", 0)
        left = F.regexp_replace(F.trim(left), r"[\x20\x09-\x0D]+", " ")
        last = F.regexp_extract(left, rf"({word})$", 1)
        right = F.regexp_extract(after, rf"^[\x20\x09-\x0D]*({word})", 1)
        patterns = F.filter(F.array(F.when(left.contains(" "), F.concat(left, F.lit(" _"))), F.when((last != "") & (right != ""), F.concat(last, F.lit(" _ "), right))), lambda p: p.isNotNull())
        against = F.lit(False) if others is None else overlaps(s, others) | ~plausible(kind, s["value"])
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(others is None).alias("known"), against.alias("against"), patterns.alias("patterns"))

    return F.transform(spans, one)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text) and all: every seed and candidate with its patterns.  One pass over the texts."""
    df = spans_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    apart = lambda k: lambda s: ~overlaps(s, [F.col(k)])
    clear = {f"loose_{k}": F.filter(f"loose_{k}", apart(k)) for k in KINDS}
    df = df.withColumns(clear)
    rest = {k: [F.col(o) for o in KINDS if o != k] for k in KINDS}
    every = F.concat(*[with_context(k, F.col(k)) for k in KINDS], *[with_context(k, F.col(f"loose_{k}"), rest[k]) for k in KINDS])
    return df.select("doc_id", F.xxhash64("whole").alias("copy"), every.alias("all"))


def bootstrap(found: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """kind and value of the candidates that trusted patterns reach, when no further round adds any.

    ``found``: what ``entities`` gives.
    """
    mentions = found.select(F.explode("all").alias("m")).select("m.*")
    edges = mentions.select("kind", "value", "known", "against", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("kind", "pattern", "value").agg(F.max("known").alias("known"), F.min("against").alias("against"))
    edges = edges.withColumn("against", F.col("against") & ~F.col("known"))
    # Only patterns with a candidate can add one, and only those with enough known values can be trusted.
    edges = materialise(edges.withColumn("score", F.col("known").cast("double")), "edges")
    before = -1
    while True:
        patterns = edges.groupBy("kind", "pattern").agg(F.sum("score").alias("for"), F.count_if("against").alias("not"), F.count_if(F.col("score") > 0).alias("n"), F.count_if(~F.col("known") & ~F.col("against")).alias("open"))
        patterns = patterns.withColumn("trust", F.try_divide("for", F.col("for") + F.col("not")))
        trusted = patterns.filter((F.col("n") >= support) & (F.col("trust") >= trust) & (F.col("open") > 0)).select("kind", "pattern", "trust")
        trusted = materialise(trusted, "trusted")
        reached = edges.filter(~F.col("known") & ~F.col("against")).join(small_side(trusted), ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("trust").alias("now"))
        reached = materialise(reached, "reached")
        count = reached.count()
        if count == before or not count:
            return reached.select("kind", "value")
        before = count
        edges = materialise(edges.join(small_side(reached), ["kind", "value"], "left").withColumn("score", F.greatest("score", F.coalesce("now", F.lit(0.0)))).drop("now"), "edges")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def in_order(spans: Column) -> Column:
    """By kind as listed in ``KINDS``, then by start."""
    flat = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.concat(*[F.array_sort(F.transform(of_kind(spans, k), flat)) for k in KINDS])


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, copy, base (spans of the fixed forms) and spans (those and the discovered ones) of each document."""
    found = materialise(entities(docs), "entities")
    new = bootstrap(found)
    mentions = found.select("doc_id", "copy", F.explode(F.filter("all", lambda m: ~m["known"] & ~m["against"])).alias("m"))
    mine = mentions.select("doc_id", "copy", "m.kind", "m.start", "m.end", "m.value").join(small_side(new), ["kind", "value"])
    mine = mine.dropDuplicates(["doc_id", "copy", "kind", "start", "end"]).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    mine = materialise(mine, "discovered").withColumnsRenamed({"doc_id": "id", "copy": "same"})
    both = found.join(small_side(mine), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("same")), "left")
    own = F.transform(F.filter("all", lambda m: m["known"]), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    return both.select("doc_id", "copy", in_order(own).alias("base"), in_order(F.concat(own, more)).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts per kind of the fixed forms, their digest, and the list of all spans."""
    found = personal_spans(docs)
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.  Null texts stay null."""
    spans = personal_spans(docs).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "copy"])
    spans = materialise(spans.select(F.struct(F.col("doc_id").alias("id"), "copy").alias("of"), F.col("spans").alias("found")), "spans")
    # All columns of the documents in one, so that none of them can clash with what is joined.
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    id_, text = F.col("doc.doc_id").cast("long"), F.col("doc.text")
    both = whole.join(small_side(spans), id_.eqNullSafe(F.col("of.id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("of.copy")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:  # where spans overlap, the one that begins first names the place
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before, mark).alias("out"))

    clean = F.aggregate(F.array_sort("found"), begin, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    new = F.when(F.col("found").isNotNull() & text.isNotNull(), clean).otherwise(text)
    return both.select(*[new.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
