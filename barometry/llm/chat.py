"""Chat formatting: typed content parts flattened into one string per conversation, with its loss mask.

A turn is written as ``<s>role[INST] body [/INST]</s>``. A visitor goes through the parts of a turn in order:
a text part gives its text, an image, audio or document part gives a placeholder ``<|kind:n|>``, where n counts
the attachments of the conversation from 0; the reference and the tokens it expands to are recorded.

Control strings inside texts and roles get a backslash after their first character (one more where
backslashes stand there already), so no control string is left and ``unescape`` gives back the text exactly.
Texts are escaped after the parts of a turn are joined, so that parts next to each other form no control string either.

Rows of a conversation are ordered by turn, then role and parts; repeated rows are turns of their own. Null roles and texts are
empty; null parts and unknown kinds give nothing. Rows with a null conversation id form one conversation. One
conversation becomes one string, so its turns meet in one task; nothing else is gathered.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PART_ARRAY = f"array<{PART}>"
ATTACHMENTS = ("image", "audio", "document")

#: Pixels of an image patch, tokens per second of sound, tokens per page.
IMAGE_PATCH = 28
AUDIO_TOKENS = 25
PAGE_TOKENS = 1500

_CONTROL = r"(/?(?:s>|INST\])|\|)"


#: Stands for an attachment while the parts of a turn are joined; the same character in a text is doubled by ``TEXT_MARK``.
MARK = "\u0001"
TEXT_MARK, OPEN_MARK, CLOSE_MARK = MARK + "t", MARK + "o", MARK + "c"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("ref"), none.alias("width"),
                            none.alias("height"), none.alias("seconds"), none.alias("pages")).cast(PART))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to."""
    patches = F.ceil(part["width"] / IMAGE_PATCH) * F.ceil(part["height"] / IMAGE_PATCH)
    tokens = F.when(part["kind"] == "image", patches).when(
        part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS)).when(
        part["kind"] == "document", part["pages"] * PAGE_TOKENS)
    return F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: id, ``formatted``, ``loss_spans``, ``attachments`` and ``attachment_tokens``.

    ``loss_spans`` are the bodies under the loss mask (start and length in code points of ``formatted``),
    ``attachments`` the attachment parts in order (n, turn, kind, ref, tokens).
    """
    rows = turns.select(F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"),
                        F.coalesce(role, F.lit("")).alias("_role"),
                        F.filter(F.coalesce(parts, F.array().cast(PART_ARRAY)), lambda p: p.isNotNull()).alias("_parts"))
    # Parts are compared as text: some Spark types in them have no order of their own.
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", F.to_json("_parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    media = F.filter("_parts", lambda p: p["kind"].isin(*ATTACHMENTS))
    rows = rows.select("*", F.row_number().over(order).alias("_at"), media.alias("_media"),
                       F.coalesce(F.sum(F.size(media)).over(before), F.lit(0)).alias("_first"))
    # Number the attachments of a turn: the k-th part that is one gets the k-th number.
    flags = F.transform("_parts", lambda p: p["kind"].isin(*ATTACHMENTS).cast("int"))

    def visit(p, i):
        kind = p["kind"]
        number = F.col("_first") + F.aggregate(F.slice(flags, 1, i), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        return F.when(kind == "text", F.coalesce(F.replace(p["text"], F.lit(MARK), F.lit(TEXT_MARK)), F.lit(""))).when(
            kind.isin(*ATTACHMENTS),
            F.concat(F.lit(OPEN_MARK), kind, F.lit(":"), number.cast("string"), F.lit(CLOSE_MARK))).otherwise("")

    # No control string holds a mark, and every mark of a text is followed by its own letter.
    body = escape(F.array_join(F.transform("_parts", visit), ""))
    for mark, sign in ((OPEN_MARK, "<|"), (CLOSE_MARK, "|>"), (TEXT_MARK, MARK)):
        body = F.replace(body, F.lit(mark), F.lit(sign))
    head = F.concat(F.lit("<s>"), escape(F.col("_role")), F.lit("[INST] "))
    rows = rows.withColumn("_head", head).withColumn("_body", body)
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.lit(" [/INST]</s>")))
    start = F.coalesce(F.sum(F.length("_piece").cast("long")).over(before), F.lit(0)) + F.length("_head")
    marked = F.when(F.col("_role").isin(*loss_roles), F.struct(
        start.alias("start"), F.length("_body").cast("long").alias("length")))
    attached = F.transform("_media", lambda p, i: F.struct(
        (F.col("_first") + i).alias("n"), F.col("_turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        part_tokens(p).alias("tokens")))
    rows = rows.select("_conv", F.struct("_at", "_piece", marked.alias("_span"), attached.alias("_attached")).alias("_row"))
    grouped = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    return grouped.select(
        F.col("_conv").alias(conv_id),
        F.array_join(F.col("_rows._piece"), "").alias("formatted"),
        F.filter(F.col("_rows._span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("_rows._attached")).alias("attachments"),
        F.aggregate(F.flatten(F.col("_rows._attached")), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text (placeholders stay)."""
    pieces = F.filter(F.split(formatted, "</s>", -1), lambda x: x != "")

    def read(piece):
        at = F.split(piece, r"\[INST\] ", 2)
        return F.struct(unescape(F.substring(F.get(at, F.lit(0)), 4, 1 << 30)).alias("role"),
                        unescape(F.substring_index(F.get(at, F.lit(1)), " [/INST]", 1)).alias("text"))

    return F.transform(pieces, read)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
