"""Chat formatting of typed content parts (operator 8), with DataFrame functions alone.

A message has a role and an ordered array of parts: struct<type, text, ref, units>. A visitor flattens the parts:

- text: its text, escaped;
- image, audio, document: a placeholder <TYPE:k>, where k counts the conversation's attachments in order; the reference
  goes to the list of attachments with the tokens that the placeholder stands for (units times the type's rate);
- any other type, or null: nothing, and it is counted in n_unknown.

A turn is <turn:ROLE>, its flattened parts, and </turn> with a line feed. In texts and roles & becomes &amp; and < becomes
&lt; (in roles also > becomes &gt;), so that no text holds a mark or a placeholder, and unescaping gives it back whole.

The loss mask has, for each turn, the place and length within the turn's piece of what is under the loss: the content of
assistant turns. Turns are ordered by turn, then role, then text. Null roles and texts are empty, a null turn comes first, rows without conv_id form one conversation,
repeated rows are turns of their own. Very long texts are formatted whole. Columns other than conv_id, turn, role
and parts aren't read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that a unit of an attachment stands for: an image's tile, a second of audio, a document's page.
RATES = {"image": 256, "audio": 25, "document": 512}
END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def role_mark(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("&gt;"))


def text_parts(text: Column) -> Column:
    """One text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units")))


def visited(parts: Column) -> Column:
    """The parts flattened one by one: body (of text parts), file (of attachments) and unknown."""
    rates = F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v).cast("long"))])

    def visit(part: Column) -> Column:
        kind = F.coalesce(part["type"], F.lit(""))
        is_file = kind.isin(*RATES)
        file = F.struct(kind.alias("type"), part["ref"].alias("ref"), (F.coalesce(part["units"].cast("long"), F.lit(1)) * rates[kind]).alias("tokens"))
        return F.struct(
            F.when(kind == "text", escaped(part["text"])).otherwise(F.lit("")).alias("body"),
            F.when(is_file, file).alias("file"),
            (~is_file & (kind != "text")).cast("long").alias("unknown"),
        )

    return F.transform(F.coalesce(parts, F.expr("cast(array() as array<struct<type: string, text: string, ref: string, units: bigint>>)")), visit)


def format_conversations(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, parts) to one row for each conversation.

    Returns conv_id, formatted, loss (array<struct<turn, start, length>>: the turn's number from 1, and code points of its
    piece before and under the mask), attachments (array<struct<number, type, ref, tokens>>), n_turns, attached_tokens
    and n_unknown.
    """
    flat = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visited(F.col("parts")).alias("p"))
    flat = flat.select(
        "*",
        F.concat(F.lit("<turn:"), role_mark(F.col("role")), F.lit(">")).alias("opened"),
        F.filter(F.transform("p", lambda x: x["file"]), lambda x: x.isNotNull()).alias("files"),
        F.array_join(F.transform("p", lambda x: x["body"]), "").alias("plain"),
    )
    # One order of turns serves the numbers of turns and attachments and the grouping: a single exchange by conv_id.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain", F.to_json("files"))
    first = F.coalesce(F.sum(F.size("files")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = flat.withColumn("number", F.row_number().over(order)).withColumn("first", first)
    held = lambda i: F.size(F.filter(F.slice("p", 1, i + 1), lambda y: y["file"].isNotNull()))
    mark = lambda x, i: F.concat(F.lit("<"), x["file"]["type"], F.lit(":"), (F.col("first") + held(i)).cast("string"), F.lit(">"))
    body = F.when(F.size("files") == 0, F.col("plain")).otherwise(F.array_join(F.transform("p", lambda x, i: F.when(x["file"].isNotNull(), mark(x, i)).otherwise(x["body"])), ""))
    turns = placed.withColumn("body", body).select(
        "conv_id",
        F.struct(
            "number", F.concat("opened", "body", F.lit(END)).alias("piece"),
            F.when(F.col("role") == "assistant", F.struct(F.col("number").alias("turn"), F.length("opened").alias("start"), F.length("body").alias("length"))).alias("loss"),
            F.transform("files", lambda f, i: F.struct((F.col("first") + i + 1).alias("number"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))).alias("files"),
        ).alias("t"),
        F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("tokens"),
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["unknown"]).alias("unknown"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.count(F.lit(1)).alias("n_turns"), F.sum("tokens").alias("attached_tokens"), F.sum("unknown").alias("n_unknown"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
        "n_turns", "attached_tokens", "n_unknown",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns (array<struct<role, text>>, unescaped) and loss_text, from the mask."""
    pieces = formatted.withColumn("pieces", F.split(F.col("formatted"), "</turn>\n"))
    pieces = pieces.withColumn("pieces", F.slice("pieces", 1, F.size("pieces") - 1))

    def turn(x: Column) -> Column:
        head = F.regexp_extract(x, "^<turn:([^>]*)>", 1)
        role = unescaped(F.replace(head, F.lit("&gt;"), F.lit(">")))
        return F.struct(role.alias("role"), unescaped(F.substr(x, F.length(head) + 8)).alias("text"))

    masked = F.transform("loss", lambda m: unescaped(F.substr(F.get("pieces", m["turn"] - 1), m["start"] + 1, m["length"])))
    return pieces.withColumn("turns", F.transform("pieces", turn)).withColumn("loss_text", F.array_join(masked, "")).drop("pieces")


def digests(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the formatted text."""
    back = read_back(format_conversations(messages))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
