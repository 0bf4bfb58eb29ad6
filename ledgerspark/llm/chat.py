"""Chat formatting by event sourcing (operator 4), in DataFrame functions only.

A conversation is a log of events: ``conv_id, message_id, seq, kind, role, text``. Kinds:

* ``message``: a whole message;
* ``delta``: a streamed piece, appended to what its message has so far;
* ``edit``: the message's text from here on;
* ``regenerate``: the text is dropped, later deltas build a new one (its own text, if
  any, begins it).

The log is dealt by conversation, once, grouped by message, sorted by ``seq`` and folded: the text is
what follows from the last ``message``, ``edit`` or ``regenerate`` on. Several plain
``message`` events under one id, with no other kind, are messages of their own (repeated
rows stay); in a message with other kinds an event that was delivered twice counts once.
Messages are then gathered by conversation in the order of their first
``seq``, and rendered. A message's events meet in one task and so do a conversation's
messages: either makes one row of the result, which bounds both.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line feed per turn. In roles and
texts a backslash is doubled, and a control string gets a backslash after its first
character, so no control string of a text stays and :func:`unescape` gives it back.

Null roles and texts are empty, a null ``kind`` is ``message``, a null ``conv_id`` or
``message_id`` is an id of its own, a null ``seq`` comes first; events of equal ``seq`` go
deltas last, then by role, text and kind. An empty log gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"(?s)\\(.)", "$1")).otherwise(c)


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, seq, role, text`` of an event log."""
    kind = F.coalesce("kind", F.lit("message"))
    e = F.struct(
        F.col("seq"),
        (kind == "delta").cast("int").alias("late"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        kind.alias("kind"),
    )
    # both groupings, by message and then by conversation, keep to this partitioning
    grouped = events.repartition("conv_id").groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(e)).alias("es"))
    grouped = grouped.withColumn("es", F.when(F.forall("es", lambda x: x["kind"] == "message"), F.col("es")).otherwise(F.array_distinct("es")))
    last = F.expr("aggregate(transform(es, (x, i) -> if(x.kind = 'delta', 0, i + 1)), 0, (a, x) -> greatest(a, x))")
    one = F.struct(
        F.expr("es[0].seq").alias("seq"),
        F.expr("coalesce(get(filter(es, x -> x.role != ''), 0).role, '')").alias("role"),
        F.array_join(F.transform(F.slice("es", F.greatest(last, F.lit(1)), F.size("es")), lambda x: x["text"]), "").alias("text"),
    )
    each = F.transform("es", lambda x: F.struct(x["seq"].alias("seq"), x["role"].alias("role"), x["text"].alias("text")))
    whole = F.forall("es", lambda x: x["kind"] == "message")
    return grouped.select("conv_id", F.when(whole, each).otherwise(F.array(one)).alias("messages"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id, formatted`` and ``segments``, whose texts joined
    are ``formatted`` and whose ``loss`` marks what is trained on (assistant texts)."""
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("messages"))).alias("ms"))

    def parts(m: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT)), F.lit(False)),
            seg(escape(m["text"]), m["role"] == "assistant"),
            seg(F.lit(END), F.lit(False)),
        )

    return turns.select("conv_id", F.flatten(F.transform("ms", parts)).alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def parse(formatted: Column) -> Column:
    """Back from the rendered text: an array of (role, text)."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 2**31 - 2)

    def read(t: Column) -> Column:
        at = F.instr(t, TEXT)
        role = F.substring(t, F.lit(1), at - 1)
        body = F.substring(t, at + len(TEXT), F.length(t) - at - len(TEXT) - len(END) + 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, read)


def events_of(conversations: DataFrame) -> DataFrame:
    """Each row of a table of turns as one ``message`` event."""
    c = conversations
    return c.select(
        c["conv_id"], c["turn"].alias("message_id"), c["turn"].alias("seq"), F.lit("message").alias("kind"), c["role"], c["text"]
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for i, r in enumerate(("user", "assistant"))]))
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = render(fold(events_of(rows)))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    out = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("back"), loss.alias("loss"))
    turns = F.array_join(F.transform("back", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _escaped_sql(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in CONTROL:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
