r"""Chat formatting, with DataFrame operations only.

Records of different layouts (message lists, prompt and completion, instruction and output,
and others) become canonical turns. The field paths that a record has, of those that a layout
knows, are hashed to its schema fingerprint for that layout; the first of the declarative mappings
in LAYOUTS with a fingerprint among its own is selected. Further fields do not matter, also if
other layouts know them: a prompt beside messages does not hide the messages. A record that no
layout fits has layout null and no turns (unfitted() counts these). A text given as a list of
parts is the parts' texts, joined by newlines; parts without text (images) have none.

The template writes each turn as "### ", role, ": ", text, "</turn>", newline. Inside texts and
roles a backslash is doubled, "##" becomes "#\#" and "</turn>" becomes "<\/turn>", in roles ":"
becomes "\."; so no "###" and no "</turn>" is left in them, and unformat() gives back what was
there. The loss mask lists (start, length) of the assistant turns' texts in code points.

Null roles and texts are empty. Turns are ordered by turn, then role and text, a null turn
last; rows of one turn that occur again are turns of their own. Rows without conv_id are one
conversation. An empty table gives no conversation. Further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<role: string, text: string>>"
END = "</turn>\n"

#: name -> (paths it needs, paths it may have, turns). Turns: ("list", path, role field, text field), ("pairs", path, user field, assistant field),
#: or ("fields", (role, (paths, joined by an empty line if there are several)), ...).
LAYOUTS = {
    "messages": (("messages[0].role", "messages[0].content"), ("system",), ("list", "messages", "role", "content")),
    "conversations": (("conversations[0].from", "conversations[0].value"), ("system",), ("list", "conversations", "from", "value")),
    "dialog": (("dialog[0].speaker", "dialog[0].text"), (), ("list", "dialog", "speaker", "text")),
    "rounds": (("rounds[0].user", "rounds[0].assistant"), ("system",), ("pairs", "rounds", "user", "assistant")),
    "instruction": (("instruction", "output"), ("input", "context", "system"), ("fields", ("user", ("instruction", "input", "context")), ("assistant", ("output",)))),
    "instruction_response": (("instruction", "response"), ("input", "context", "system"), ("fields", ("user", ("instruction", "input", "context")), ("assistant", ("response",)))),
    "prompt_completion": (("prompt", "completion"), ("system",), ("fields", ("user", ("prompt",)), ("assistant", ("completion",)))),
    "prompt_response": (("prompt", "response"), ("system",), ("fields", ("user", ("prompt",)), ("assistant", ("response",)))),
    "question_answer": (("question", "answer"), ("context", "system"), ("fields", ("user", ("context", "question")), ("assistant", ("answer",)))),
}
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


def _signature(paths) -> str:
    return "|".join(sorted(paths))


def fingerprint(record, paths) -> F.Column:
    """The hash of those of the field paths that a variant record has."""
    there = F.array_compact(F.array(*(F.when(F.try_variant_get(record, f"$.{p}", "variant").isNotNull(), F.lit(p)) for p in sorted(paths))))
    return F.xxhash64(F.array_join(there, "|"))


def layout_of(record) -> F.Column:
    """The name of the first layout that the record's fingerprints select, or null."""
    found = []
    for name, (need, may, _) in LAYOUTS.items():
        fits = [F.xxhash64(F.lit(_signature((*need, *some)))) for n in range(len(may) + 1) for some in combinations(may, n)]
        found.append(F.when(fingerprint(record, (*need, *may)).isin(*fits), name))
    return F.coalesce(*found)


def _string(record, path: str) -> F.Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _turn(role, text) -> F.Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _from_list(record, path: str, who: str, what: str, known) -> F.Column:
    items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{who}`: string, `{what}`: variant>>")

    def said(x):
        parts = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))
        return F.coalesce(F.array_join(parts, "\n"), F.try_variant_get(x, "$", "string"))

    return F.transform(items, lambda x: _turn(F.coalesce(F.try_element_at(known, F.coalesce(x[who], F.lit(""))), x[who], F.lit("")), said(x[what])))


def _from_pairs(record, path: str, user: str, assistant: str) -> F.Column:
    items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{user}`: string, `{assistant}`: string>>")
    return F.flatten(F.transform(items, lambda x: F.array(_turn(F.lit("user"), x[user]), _turn(F.lit("assistant"), x[assistant]))))


def turns_of(record, layout) -> F.Column:
    """Canonical turns (array of role, text) of a variant record under its layout; a "system" field goes first."""
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))

    branches = F.when(F.lit(False), F.lit(None).cast(_TURNS))
    for name, (_, may, (kind, *rule)) in LAYOUTS.items():
        if kind == "list":
            body = _from_list(record, *rule, known)
        elif kind == "pairs":
            body = _from_pairs(record, *rule)
        else:
            body = F.array(*(_turn(F.lit(role), F.concat_ws("\n\n", *(F.nullif(_string(record, p), F.lit("")) for p in paths))) for role, paths in rule))
        if "system" in may:
            body = F.when(_string(record, "system").isNotNull(), F.concat(F.array(_turn(F.lit("system"), _string(record, "system"))), body)).otherwise(body)
        branches = branches.when(layout == name, body.cast(_TURNS))
    return branches


def escape(text, role: bool = False) -> F.Column:
    for old, new in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>"), *([(":", "\\.")] if role else [])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text, role: bool = False) -> F.Column:
    if role:  # a dot stands for a colon after an odd number of backslashes only
        text = F.regexp_replace(text, r"\G((?:[^\\]|\\[^.])*?)\\\.", "$1:")
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def _piece(t) -> F.Column:
    return F.concat(F.lit("### "), escape(t["role"], True), F.lit(": "), escape(t["text"]), F.lit(END))


def formatted(turns) -> F.Column:
    return F.array_join(F.transform(turns, _piece), "")


def loss_mask(turns) -> F.Column:
    """Array of (start, length), in code points of the formatted text: the assistant turns' texts."""
    spans = F.lit(None).cast("array<struct<start: bigint, length: bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(spans, F.array().cast("array<struct<start: bigint, length: bigint>>")).alias("spans"))

    def step(state, t):
        start = state["at"] + 6 + F.length(escape(t["role"], True))
        length = F.length(escape(t["text"])).cast("long")
        here = F.array(F.struct(start.cast("long").alias("start"), length.alias("length")))
        return F.struct((start + length + len(END)).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], here)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def unformat(text) -> F.Column:
    """The turns of a formatted text."""
    pieces = F.split(text, r"</turn>\n")
    whole = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p):
        at = F.instr(p, F.lit(": "))
        return F.struct(unescape(F.substring(p, F.lit(5), at - 5), True).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(whole, turn)


def masked_texts(text, spans) -> F.Column:
    """The unescaped texts under a loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def records(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one variant record per conversation, in the messages layout. A conversation's turns meet in one row: its output is one text."""
    empty = F.lit("")
    item = F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("content"))
    one = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    messages = F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return one.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def format_records(df: DataFrame, record: str = "record") -> DataFrame:
    """df with layout, formatted and loss_mask of its variant records in place of the record; no turns give an empty text."""
    named = df.withColumn("layout", layout_of(F.col(record)))
    turned = named.withColumn("turns", F.coalesce(turns_of(F.col(record), F.col("layout")), F.array().cast(_TURNS))).drop(record)
    return turned.withColumns({"formatted": formatted(F.col("turns")), "loss_mask": loss_mask(F.col("turns"))}).drop("turns")


def unfitted(df: DataFrame, record: str = "record") -> DataFrame:
    """n, the records of df, and n_unfitted, those that no layout fits."""
    return df.agg(F.count("*").alias("n"), F.count(F.when(layout_of(F.col(record)).isNull(), 1)).alias("n_unfitted"))


def digest(done: DataFrame) -> DataFrame:
    """What the formatted texts and masks give when they are read back."""
    back = done.withColumns({"turns": unformat(F.col("formatted")), "lost": F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "")})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.encode("lost", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest(format_records(records(rows.unionByName(more))))


OP4_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 13 + 1 + length(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\.'))
    + length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')) AS width FROM r
), g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS lost,
    CAST(sum(width) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars, 'messages' AS layout FROM g
"""
