"""Chat formatting over typed content parts, in DataFrame functions only.

A turn's content is an array of parts.  ``flatten_parts`` visits them in
order: text is escaped and copied, an image, audio or document part becomes a
placeholder whose reference, offset and expanded token count are recorded.
Control strings inside texts are escaped reversibly, so a formatted
conversation can be read back turn by turn.

Defined results: null roles and texts count as empty; a null part type counts
as text; turns sort by (turn, role, text) with nulls first, so ties and
repeated rows have one order; a null conv_id is a conversation of its own; long
texts and long conversations are formatted whole; extra columns are ignored; an
empty table gives an empty result (op1 its own conversation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What escaping breaks up inside texts; "<|" covers the markers and placeholders above.
GUARDED = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
ATTACHMENTS = ("image", "audio", "document")
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column, guarded: tuple[str, ...] = GUARDED) -> Column:
    """Double each backslash, then put one after the first character of every control string."""
    for g in guarded:
        if len(g) < 2 or "\\" in g or any(g[:k] == g[-k:] for k in range(1, len(g))):
            raise ValueError(f"control string {g!r} overlaps itself or holds a backslash")
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for g in guarded:
        out = F.replace(out, F.lit(g), F.lit(f"{g[0]}\\{g[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def part_tokens(p: Column) -> Column:
    """Tokens that a model sees in a placeholder's place: image patches, audio frames, document pages."""
    patches = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / PATCH)
    return (
        F.when(p["type"] == "image", patches(p["width"]) * patches(p["height"]))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def flatten_parts(parts: Column) -> Column:
    """struct(content, attachments, expanded_tokens) of an array of parts; offsets are code points in content.

    A text part that begins with what may end a control string gets a backslash
    before it, so parts do not join into one; an escaped text that begins with a
    backslash cannot.
    """
    tails = sorted({c for g in GUARDED for c in g[1:]})
    known = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    attached = lambda p: F.coalesce(p["type"].isin(*ATTACHMENTS), F.lit(False))

    def piece(p: Column, i: Column) -> Column:
        text = escape(F.coalesce(p["text"], F.lit("")))
        broken = F.when((i > 0) & F.substring(text, 1, 1).isin(*tails), F.concat(F.lit("\\"), text)).otherwise(text)
        return F.when(attached(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(broken)

    pieces = F.transform(known, piece)
    before = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    where = F.filter(F.transform(known, lambda p, i: F.when(attached(p), i)), lambda i: i.isNotNull())
    item = "struct<ord:int,type:string,ref:string,offset:int,tokens:bigint>"
    found = F.transform(where, lambda i, n: F.struct(n.alias("ord"), F.get(known, i)["type"].alias("type"), F.get(known, i)["ref"].alias("ref"), before(i).alias("offset"), part_tokens(F.get(known, i)).alias("tokens")).cast(item))
    tokens = F.aggregate(known, F.lit(0).cast("long"), lambda a, p: a + part_tokens(p))
    return F.struct(F.array_join(pieces, "").alias("content"), found.alias("attachments"), tokens.alias("expanded_tokens"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) rows -> one row per conversation.

    formatted: the template's text.  loss: spans (start, length) of assistant
    contents in it, code points.  attachments carry their turn's position and
    their offset in formatted.  Where a turn begins is a running sum over the
    conversation's rows, so a long conversation costs no more per turn.
    """
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten_parts(F.col("parts")).alias("flat")).select("conv_id", "turn", "role", "flat.*")
    flat = flat.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments")
    whole = F.length("head") + F.length("content") + len(END)
    placed = flat.withColumns({"position": F.row_number().over(order) - 1, "begin": (F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("content") - len(END)).cast("int")})
    att = "struct<position:int,ord:int,type:string,ref:string,offset:int,tokens:bigint>"
    moved = F.transform("attachments", lambda a: F.struct(F.col("position"), a["ord"].alias("ord"), a["type"].alias("type"), a["ref"].alias("ref"), (F.col("begin") + a["offset"]).alias("offset"), a["tokens"].alias("tokens")).cast(att))
    turn = placed.select("conv_id", F.struct("position", "role", F.concat("head", "content", F.lit(END)).alias("said"), "begin", F.length("content").alias("length"), moved.alias("attachments"), "expanded_tokens").alias("t"))
    grouped = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.transform(said, lambda t: F.struct(t["begin"].alias("start"), t["length"].alias("length"))).alias("loss"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["expanded_tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: turns array<struct<role, text>> and loss_text, both unescaped."""
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>", -1)
    head = lambda p: F.substring_index(p, SEP, 1)
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(unescape(F.substring(head(p), F.lit(len(START) + 1), F.length(head(p)))).alias("role"), unescape(F.substring(p, F.length(head(p)) + len(SEP) + 1, F.length(p))).alias("text")),
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts"))
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachments",
        "expanded_tokens",
    )


def _oracle() -> str:
    esc = lambda x: _chain(f"replace({x}, '\\', '\\\\')")

    def _chain(x: str) -> str:
        for g in GUARDED:
            x = f"replace({x}, '{g}', '{g[0]}\\{g[1:]}')"
        return x

    marks = len(START) + len(SEP) + len(END)
    return f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {esc("role")} AS r, {esc("text")} AS x FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, x) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, x) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(r) + length(x) + {marks}) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM g"""


QUERIES = {"op1_chat": op1_chat}
ORACLE = {"op1_chat": _oracle()}
