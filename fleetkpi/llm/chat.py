"""Chat formatting: typed content parts to one text with a loss mask, in DataFrame functions only.

A message has parts; each part is visited by its type. Text is escaped and goes in; an image, a
recording or a document leaves a placeholder in its place, and a record of what it refers to and how
many tokens the placeholder expands to.

A turn is written <|im_start|>role<|im_sep|>content<|im_end|> and a newline. Control strings inside
roles and texts lose their meaning by a backslash after their first character, and backslashes are
doubled, so that reading back restores every text. The loss mask has one entry a turn: so many code
points to skip and then so many to keep, which are the content where an assistant speaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Strings that chat templates in use give a meaning to.
CONTROLS = [
    START,
    SEPARATOR,
    END,
    *PLACEHOLDER.values(),
    "<|startoftext|>",
    "<|endoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
]
#: Pixels on a side that make a token, tokens for a second and for a page.
PATCH, SECOND_TOKENS, PAGE_TOKENS = 28, 25, 512

PARTS = (
    "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
)


def escaped(text: Column) -> Column:
    """Text without control strings; `unescaped` gives the text again. Null counts as empty."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    rest = "|".join(f"\\Q{c[1:]}\\E" for c in CONTROLS)
    return F.regexp_replace(doubled, rf"([<\[])(?={rest})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a message that is one text."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *nothing)).cast(PARTS)


def _shown(part: Column) -> Column:
    """What a part leaves in the text; one of a type that is not known leaves nothing."""
    out = F.when(part["type"] == "text", escaped(part["text"]))
    for kind, mark in PLACEHOLDER.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(""))


def _expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for, one at least."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / PATCH)
    tokens = (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SECOND_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("bigint") * PAGE_TOKENS)
    )
    return F.greatest(tokens.cast("bigint"), F.lit(1).cast("bigint"))


def format_chat(messages: DataFrame, speaker: str = "assistant") -> DataFrame:
    """One row for each conv_id of messages (conv_id, turn, role, parts): formatted, mask, attachments.

    Turns are in the order of turn, null first, equal ones in that of role and content; repeated
    rows stay. A null role is an empty one, null parts leave an empty turn. attachments has, in
    order, type, ref and tokens of every placeholder. A null conv_id is a conversation as well;
    other columns are ignored; an empty table gives an empty result. A conversation is one row of
    the result, so its turns meet in one task, after each has been formatted where it was read.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    media = F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDER))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escaped(role), F.lit(SEPARATOR))
    content = F.concat_ws("", F.transform(parts, _shown))
    turns = (
        messages.select("conv_id", "turn", role.alias("role"), head.alias("head"), content.alias("content"), media.alias("media"))
        .select(
            "conv_id",
            F.struct(
                F.col("turn"),
                F.col("role"),
                F.concat("head", "content", F.lit(END + "\n")).alias("chunk"),
                F.struct(
                    F.char_length("head").alias("skip"),
                    F.when(F.col("role") == speaker, F.char_length("content")).otherwise(0).alias("keep"),
                ).alias("mask"),
                F.transform("media", lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))).alias("media"),
            ).alias("turn"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    )
    return turns.select(
        "conv_id",
        F.concat_ws("", F.col("turns.chunk")).alias("formatted"),
        F.col("turns.mask").alias("mask"),
        F.flatten("turns.media").alias("attachments"),
        F.aggregate(F.flatten("turns.media"), F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"]).alias("media_tokens"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, read from formatted and mask alone."""
    quoted = {name: f"\\Q{mark}\\E" for name, mark in (("a", START), ("s", SEPARATOR), ("e", END))}
    pattern = "(?s){a}(.*?){s}(.*?){e}\n".format(**quoted)
    chunks = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(0))
    turns = F.transform(
        chunks,
        lambda c: F.struct(
            unescaped(F.regexp_extract(c, pattern, 1)).alias("role"), unescaped(F.regexp_extract(c, pattern, 2)).alias("text")
        ),
    )
    loss = F.zip_with(chunks, "mask", lambda c, m: unescaped(F.substr(c, m["skip"] + 1, m["keep"])))
    return formatted.select(
        "conv_id", turns.alias("turns"), F.concat_ws("", loss).alias("loss_text"), F.char_length("formatted").cast("bigint").alias("formatted_chars")
    )
