"""Chat formatting of typed content parts.

A turn's content is an array of parts (kind, text, ref, units). A visitor, one CASE per kind inside
`transform`, turns each into template text: texts are escaped, images, audio and documents become
ordered placeholders, and each attachment is recorded with its reference and the tokens it expands to.

Template: <|im_start|>ROLE newline TEXT <|im_end|> newline. Inside roles and texts a backslash
becomes \\s and every <| becomes <\\p (a role's newline \\n), so no text can spell a control string, and
the way back is exact. All of it is DataFrame expressions.

A kind is escaped like a role, and cannot close its own placeholder.

Cases: null roles and texts are empty; a null turn comes first and repeated turns are ordered by role
and text; rows with a null conversation form one; a conversation without an assistant turn has an empty
loss mask; an empty table gives an empty result; columns besides conv_id, turn, role and parts are left out; texts of
any length are formatted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template and the kinds with their token cost per unit (an image's tiles, an
# audio's seconds, a document's pages).
START, END = "<|im_start|>", "<|im_end|>\n"
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s"))
    return F.replace(out, F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("<\\p"), F.lit("<|"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A plain text as an array of one typed part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def _placeholder(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(escape_role(kind), F.lit("|>"), F.lit("\\q")), F.lit("_"), number.cast("string"), F.lit("|>"))


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """(body, attachments): the template text of a turn's parts in order, and one record (ordinal,
    kind, ref, placeholder, tokens) per part that isn't text. A kind that is not known counts no tokens."""
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    body = F.array_join(F.transform(numbered, lambda x: F.when(is_text(x["p"]), escape(x["p"]["text"])).otherwise(_placeholder(x["p"]["kind"], x["i"]))), "")
    rate = F.create_map(*[F.lit(v) for kv in TOKENS_PER_UNIT.items() for v in kv])
    record = lambda x: F.struct(x["i"].alias("ordinal"), x["p"]["kind"].alias("kind"), x["p"]["ref"].alias("ref"), _placeholder(x["p"]["kind"], x["i"]).alias("placeholder"), (F.coalesce(F.try_element_at(rate, x["p"]["kind"]), F.lit(0)) * F.coalesce(x["p"]["units"], F.lit(0))).cast("long").alias("tokens"))
    return body, F.transform(F.filter(numbered, lambda x: ~is_text(x["p"])), record)


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens) from rows (conv_id, turn, role,
    parts). loss_spans: (start, length) of each assistant text, in code points of `formatted`."""
    body, found = visit_parts(F.col("parts"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), found.alias("found"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "body", "found", F.concat(head, F.col("body"), F.lit(END)).alias("piece"), F.length(head).alias("head"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum(F.length("piece")).over(order) - F.length("piece")).withColumn("n", F.count(F.lit(1)).over(order))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "turn", "role", "piece", "at", "head", F.length("body").alias("len"), "found"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct((x["at"] + x["head"]).alias("start"), x["len"].alias("length")))
    attached = F.flatten(F.transform("t", lambda x: F.transform(x["found"], lambda a: F.struct(x["turn"].alias("turn"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["placeholder"].alias("placeholder"), a["tokens"].alias("tokens")))))
    out = grouped.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"), attached.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    role = lambda p: F.substring_index(p, "\n", 1)
    text = lambda p: F.substr(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    return F.transform(pieces, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(text(p)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
