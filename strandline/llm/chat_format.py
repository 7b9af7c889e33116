"""Chat formatting as a relation: one row for each conversation, Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of one role are merged into a block, an array of
their texts, and all is joined to one string:

    <|start|>role<|text|>text<|next|>text of the same role<|end|>

Inside roles and texts "&" becomes "&amp;" and "<|" becomes "&lt;|", so a control string never stands in one,
and replacing them back in turn gives the exact text. The loss mask is an array of spans (start, end) of the string's UTF-8
bytes, one for the text of each assistant turn, without any control string.

Null text is empty, as is a null role; a null turn sorts first; turns with one number sort by role, then
text. Repeated rows are turns each. A row with a null conv_id is a conversation of its own (nothing says which rows belong
together, and there may be any number of them). Other columns are not looked at. An empty table gives an empty result. Rows of one conversation
meet in one task, as its formatted text is one string; a conversation is bounded by Spark's 2 GB for a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def literal_split(text: Column, at: str) -> Column:
    return F.split(text, at.replace("|", r"\|"), -1)


def merged_turns(rows: DataFrame) -> DataFrame:
    """conv_id, blocks of rows with sorted `turns` (structs turn, role, text): arrays of the texts of neighbours of one role."""
    role = lambda i: F.get("turns", i)["role"]
    # Each array is a column of its own, so that it is made once and not again for each element.
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i - 1) != role(i))))
    rows = rows.withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns"))))
    texts = lambda r: F.transform(F.slice("turns", r["starts"] + 1, r["ends"] - r["starts"]), lambda t: t["text"])
    blocks = F.transform(F.arrays_zip("starts", "ends"), lambda r: F.struct(role(r["starts"]).alias("role"), texts(r).alias("texts")))
    return rows.select("conv_id", blocks.alias("blocks"))


def format_block(block: Column) -> Column:
    """A block as (piece, loss) structs: control strings and texts by turns."""
    loss = block["role"] == "assistant"
    head = F.concat(F.lit(START), escape(block["role"]), F.lit(TEXT))
    body = F.flatten(F.transform(block["texts"], lambda x: F.array(F.struct(F.lit(NEXT).alias("piece"), F.lit(False).alias("loss")), F.struct(escape(x).alias("piece"), loss.alias("loss")))))
    return F.concat(F.array(F.struct(head.alias("piece"), F.lit(False).alias("loss"))), F.slice(body, 2, F.size(body)), F.array(F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss"))))


def loss_spans(pieces: Column) -> Column:
    """Spans (start, end) of the pieces under the mask in the UTF-8 bytes of all pieces joined."""
    at = lambda x: x.cast("long")
    start = F.struct(at(F.lit(0)).alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        end = state["at"] + F.octet_length(p["piece"])
        spans = F.when(p["loss"], F.concat(state["spans"], F.array(F.struct(state["at"].alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, start, step, lambda state: state["spans"])


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts that the spans mark, as they were. Bytes are cut, not characters, whose places would have to be searched for."""
    data = F.encode(formatted, "UTF-8")
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8")))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs (role, text)."""
    blocks = F.filter(literal_split(formatted, END), lambda b: b != "")

    def block(b: Column) -> Column:
        role = F.substring_index(F.substring_index(b, TEXT, 1), START, -1)
        texts = F.substring_index(b, TEXT, -1)
        return F.transform(literal_split(texts, NEXT), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    together = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    alone = conversations.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns"))
    pieces = merged_turns(together.unionByName(alone)).select("conv_id", F.flatten(F.transform("blocks", format_block)).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), loss_spans(F.col("pieces")).alias("loss_spans"))


def op7_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_conversations(rows.unionByName(probe))
    parsed = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse_turns(F.col("formatted")).alias("turns"), F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), "").alias("said"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2(F.encode("said", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS i
  FROM rows WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text)),
parts AS (
  SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'))
    + CASE WHEN before = role THEN 8 ELSE 9 + 8 + length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) END
    + CASE WHEN after = role THEN 0 ELSE 7 END AS n
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id, own
"""
