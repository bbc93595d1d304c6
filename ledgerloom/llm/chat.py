r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written as ``### Role: text</turn>`` and a line end.  The parser of that grammar is deterministic: it cuts at
``</turn>``, reads the header and takes the rest as the text, in which an unescaped header is an error.  Every turn is
rendered as it is, parsed again and compared with its source; where that differs, the text is escaped: in each control
string, also in one that looks escaped already, one backslash more follows the first character.  Unescaping takes one
away, so escaped text always comes back.  The whole conversation is then parsed once more, and ``round_trip`` says
whether all turns are as in the source.

Roles other than user, assistant and system are written as ``x-`` and their bytes in hexadecimal digits.  The loss mask
is a list of spans of the formatted text: the texts of the assistant's turns, without marks.

Turns are ordered by ``turn``, then role and text, nulls first; repeated rows are repeated turns.  Null texts and roles
are empty.  A null conv_id is a conversation.  A conversation is one value of the output, so its rows meet in one task;
nothing else does.  Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles with a name of their own.
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
NAME = r"(?:User|Assistant|System|x-[0-9A-F]*)"
HEADER = rf"^\n?### ({NAME}): "
END = "</turn>"
#: A control string, with any number of backslashes after its first character.
CONTROL = rf"([<#])(\\*)(/turn>|## {NAME}: )"
ESCAPED = rf"([<#])\\(\\*)(/turn>|## {NAME}: )"
TURN = "struct<role:string,text:string>"

#: A conversation that holds control strings in both turns.
CONFLICTING = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def name_of(role: Column) -> Column:
    found = None
    for plain, name in ROLES.items():
        found = F.when(role == plain, name) if found is None else found.when(role == plain, name)
    return found.otherwise(F.concat(F.lit("x-"), F.hex(F.encode(role, "UTF-8"))))


def role_of(name: Column) -> Column:
    found = None
    for plain, shown in ROLES.items():
        found = F.when(name == shown, plain) if found is None else found.when(name == shown, plain)
    return found.otherwise(F.decode(F.unhex(F.substring(name, F.lit(3), F.length(name))), "UTF-8"))


def header(role: Column) -> Column:
    return F.concat(F.lit("### "), name_of(role), F.lit(": "))


def rendered(role: Column, body: Column) -> Column:
    return F.concat(header(role), body, F.lit(f"{END}\n"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text; null in place of what the grammar doesn't allow."""
    pieces = F.split(formatted, END, -1)

    def turn(piece: Column) -> Column:
        name = F.regexp_extract(piece, HEADER, 1)
        body = F.regexp_replace(piece, HEADER, "")
        fits = piece.rlike(HEADER) & ~body.rlike(rf"### {NAME}: ")
        return F.when(fits, F.struct(role_of(name).alias("role"), unescaped(body).alias("text")))

    turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    return F.when(F.element_at(pieces, -1).isin("", "\n"), turns).otherwise(F.array(F.lit(None).cast(TURN)))


def comes_back(role: Column, text: Column, body: Column) -> Column:
    """Whether a turn written with this body is parsed as itself, alone."""
    turns = parsed(rendered(role, body))
    return (F.size(turns) == 1) & turns[0]["role"].eqNullSafe(role) & turns[0]["text"].eqNullSafe(text)


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, turns (as in the source), formatted, mask (spans of the loss) and round_trip of each conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    body = F.when(~F.col("text").rlike(CONTROL) | comes_back(F.col("role"), F.col("text"), F.col("text")), F.col("text")).otherwise(escaped(F.col("text")))
    rows = rows.withColumn("body", body)
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body"))).alias("all"))
    whole = F.array_join(F.transform("all", lambda t: rendered(t["role"], t["body"])), "")
    none = F.array().cast("array<struct<start:int,length:int>>")

    def mark(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(header(t["role"]))
        size = F.char_length(t["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END) + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("all", F.struct(F.lit(0).alias("at"), none.alias("mask")), mark, lambda acc: acc["mask"])
    df = df.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), whole.alias("formatted"), mask.alias("mask"))
    df = df.withColumn("recovered", parsed(F.col("formatted")))
    return df.withColumn("round_trip", F.col("recovered").eqNullSafe(F.col("turns")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, read from the formatted text."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(rows: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations."""
    df = formatted(rows).withColumn("loss", loss_text(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def conflicting(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user's and an assistant's turn that hold control strings."""
    return spark.createDataFrame([(-7, 0, "user", CONFLICTING), (-7, 1, "assistant", CONFLICTING)], "conv_id bigint, turn bigint, role string, text string")
