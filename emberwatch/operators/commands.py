"""Command audit of a chat-operated service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import strip
from emberwatch.operators.carry import carry_last

# Actions that need a confirmation first.
CONFIRM_FIRST = ["stop", "restart"]

_PERSON = "struct<id:bigint>"
_MESSAGE = f"struct<message_id:bigint,from:{_PERSON},chat:{_PERSON},text:string>"
UPDATE = (
    f"update_id bigint, callback_query struct<id:string,from:{_PERSON},message:{_MESSAGE},data:string>, "
    f"message {_MESSAGE}, edited_message {_MESSAGE}"
)


def parse_updates(updates: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON updates to ``user_id, chat_id, kind, action`` rows; others are ignored.

    ``kind`` is ``confirm`` or ``action`` for buttons, ``callback`` for other button data and
    ``command`` for messages that start with a slash.
    """
    u = F.from_json(payload, UPDATE)
    parsed = updates.withColumn("_u", u)
    button, message = F.col("_u.callback_query"), F.coalesce(F.col("_u.message"), F.col("_u.edited_message"))
    data = F.coalesce(button["data"], F.lit(""))
    text = F.coalesce(message["text"], F.lit(""))
    kind = (
        F.when(button.isNotNull(), F.when(F.startswith(data, F.lit("confirm:")), "confirm")
               .when(F.startswith(data, F.lit("action:")), "action").otherwise("callback"))
        .when(F.startswith(text, F.lit("/")), "command")
    )
    who = F.when(button.isNotNull(), button["from"]["id"]).otherwise(message["from"]["id"])
    where = F.when(button.isNotNull(), button["message"]["chat"]["id"]).otherwise(message["chat"]["id"])
    content = F.when(kind.isin("confirm", "action"), F.regexp_extract(data, "(?s)^[^:]*:(.*)$", 1)).when(
        kind == "callback", data
    ).otherwise(text)
    rows = parsed.select(
        *updates.columns,
        F.coalesce(who, F.lit(0)).alias("user_id"), F.coalesce(where, F.lit(0)).alias("chat_id"),
        kind.alias("kind"), content.alias("action"),
    )
    return rows.filter(F.col("kind").isNotNull())


def allow_list(text: Column) -> Column:
    """User ids of a comma list; entries that are no integers are dropped."""
    entries = F.transform(F.split(text, ","), strip)
    numbers = F.transform(F.filter(entries, lambda x: F.rlike(x, F.lit("^-?[0-9]+$"))), lambda x: x.try_cast("bigint"))
    return F.array_distinct(F.array_compact(numbers))


def authorised(commands: DataFrame, allowed: DataFrame) -> DataFrame:
    """Commands of listed users (``allowed`` has ``user_id``)."""
    return commands.join(allowed, "user_id", "left_semi")


def unauthorised(commands: DataFrame, allowed: DataFrame) -> DataFrame:
    """Commands of everyone else."""
    return commands.join(allowed, "user_id", "left_anti")


def confirmations(commands: DataFrame, block: int = 100_000) -> DataFrame:
    """Stop and restart actions, with whether the chat's last confirmation was for the same one.

    Chats are walked in blocks of update ids, so one busy chat is many tasks. A confirmation serves
    for the next guarded action of its chat only.
    """
    guarded = (F.col("kind") == "action") & F.col("action").isin(CONFIRM_FIRST)
    confirm = F.col("kind") == "confirm"
    step = F.when(confirm | guarded, F.struct(confirm.alias("is_confirm"), F.col("action").alias("what")))
    paired = carry_last(commands, ["chat_id"], "update_id", "update_id", step, "_before", block)
    confirmed = F.coalesce(F.col("_before.is_confirm") & (F.col("_before.what") == F.col("action")), F.lit(False))
    return paired.filter(guarded).withColumn("confirmed", confirmed).drop("_before")


def next_offset(updates: DataFrame) -> DataFrame:
    """Where an incremental read goes on."""
    return updates.agg((F.max("update_id") + 1).alias("next_offset"))
