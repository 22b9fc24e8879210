"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of the rendered text (bytes outside the brackets are literal):

    conversation := turn*
    turn         := header "\n" text "\n</turn>\n"
    header       := "### System:" | "### User:" | "### Assistant:" | "### Tool:" | "### Role: " name

A text that holds a control string (a header's first word or the end mark) would be read back as something else.
Each turn is therefore rendered, parsed again by the grammar and compared with its source; while they differ, its
content is escaped (one backslash before every control string together with the backslashes already there) and
rendered anew. The escape is injective and its inverse drops one backslash, so the second rendering always agrees;
``identical`` reports the comparison of the whole parsed conversation with its source.

Defined results: null text is empty; null role is the empty name; turns order by (turn, role, text), nulls first;
repeated rows stay; a null conv_id is a conversation of its own; an empty table gives no rows; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "</turn>"
CONTROL = r"### (?:System|User|Assistant|Tool|Role):|</turn>"
ROUNDS = 2  #: renderings tried; the second one is provably identical


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def _name(role: Column) -> Column:
    """Role names outside LABELS stay on the header line: the characters of the grammar are percent-coded."""
    for raw, coded in (("%", "%25"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def _role(name: Column) -> Column:
    for raw, coded in (("<", "%3C"), ("#", "%23"), ("\n", "%0A"), ("%", "%25")):
        name = F.replace(name, F.lit(coded), F.lit(raw))
    return name


def header(role: Column) -> Column:
    out = F.concat(F.lit("### Role: "), _name(role))
    for name, label in LABELS.items():
        out = F.when(role == name, f"### {label}:").otherwise(out)
    return out


def parse(rendered: Column) -> Column:
    """array<struct<role, text, header_chars, body_chars, clean>> of a rendered text; clean: no bare control string inside."""
    pieces = F.split(rendered, rf"(?<!\\){END}\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        head = F.left(piece, cut - 1)
        body = F.substring(piece, cut + 1, F.length(piece) - cut - 1)
        role = _role(F.substring(head, F.lit(11), F.length(head)))
        for name, label in LABELS.items():
            role = F.when(head == f"### {label}:", name).otherwise(role)
        return F.struct(
            role.alias("role"), unescape(body).alias("text"), cut.cast("long").alias("header_chars"),
            F.length(body).cast("long").alias("body_chars"), (~body.rlike(rf"(?<!\\)(?:{CONTROL})")).alias("clean"),
        )

    return F.transform(pieces, turn)


def _reads_back(rendered: Column, role: Column, text: Column) -> Column:
    got = parse(rendered)
    return F.coalesce((F.size(got) == 1) & (got[0]["role"] == role) & (got[0]["text"] == text) & got[0]["clean"], F.lit(False))


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, block, rounds): each row rendered on its own, escaped until it reads back as it was."""
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    block = lambda body: F.concat(header(F.col("role")), F.lit("\n"), body, F.lit(f"\n{END}\n"))
    rows = rows.withColumn("block", block(F.col("text"))).withColumn("rounds", F.lit(0))
    body = F.col("text")
    for k in range(1, ROUNDS):
        body = escape(body)
        same = _reads_back(F.col("block"), F.col("role"), F.col("text"))
        rows = rows.withColumn("same", same).withColumn("rounds", F.when(F.col("same"), F.col("rounds")).otherwise(k))
        rows = rows.withColumn("block", F.when(F.col("same"), F.col("block")).otherwise(block(body))).drop("same")
    return rows


def format_chats(df: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back), loss_runs, identical, rounds.

    loss_runs alternates by turn: ``off`` code points without loss, then ``on`` code points under it (the escaped text
    of an assistant's turn, else 0). Partial lists are gathered on the map side, so a conversation that holds a large
    share of the rows reaches its reducer as one row per map task.
    """
    turns = format_turns(df)
    order = F.struct("turn", "role", "text", "block", "rounds")
    got = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("s"))
    got = got.select("conv_id", "s", F.array_join(F.transform("s", lambda x: x["block"]), "").alias("formatted"))
    got = got.withColumn("p", parse(F.col("formatted")))
    source = F.transform("s", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    parsed = F.transform("p", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    on = lambda x: F.when(x["role"] == "assistant", x["body_chars"]).otherwise(F.lit(0))
    rest = len(END) + 2
    runs = F.transform("p", lambda x: F.struct((x["header_chars"] + x["body_chars"] - on(x) + F.lit(0)).alias("off"), on(x).alias("on"), F.lit(rest).cast("long").alias("tail")))
    return got.select(
        "conv_id", "formatted", parsed.alias("turns"), runs.alias("loss_runs"),
        ((source == parsed) & F.forall("p", lambda x: x["clean"])).alias("identical"),
        F.array_max(F.transform("s", lambda x: x["rounds"])).alias("rounds"),
    )


def digest_columns(chats: DataFrame) -> DataFrame:
    """What is read back from the rendered text: counts and digests of turns and of the text under the loss mask."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    out = chats.withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "identical", F.col("rounds").cast("long").alias("rounds"),
    )
