"""Chat formatting by quotation linking.

Messages (conv_id, turn, role, text) are parsed into lines with a quote level
(the number of ``>`` before the line).  Maximal runs of lines of one level are
passages.  Each quoted line, normalised (lower case, white space as one space), is
hashed and joined to own lines of other messages: to the latest earlier turn of
the same conversation that holds it, or else to the first message anywhere that
does.  A passage belongs to the message that most of its lines point to (of
equals the same conversation, then the latest).  The passages of level 1 name a
message's parent in the same way; deeper ones are linked too, by ``quote_links``.
Quotes and the attribution line before them ("... wrote:") are cut out, and
messages are put in reply order: by the root of their chain of parents, by how
often that chain goes over to another conversation (hops), then by turn, so an
answer stands after what it answers.  ``position`` is how many messages stand
before, of all conversations; equal messages of one turn share it.

Everything but the running count of positions is DataFrame functions.  A hot line,
or one of a hot conversation, meets its quotes in ranges of turns, several to a
line if need be; only lines that are quoted somewhere take part.

Defined cases: a null text stays null; an empty one stays empty; a message whose
conversation or turn is null is never linked; a text without quotes is unchanged;
rows that are equal throughout give equal results; rows of one turn with different
texts are different messages, and a link to the turn is a link to all of them; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut

PREFIX = r"^[ \\t]*>(?:[ \\t]*>)*[ \\t]?"
#: How the line before a quote ends.
ATTRIBUTION = r"(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)[ \\t]*:[ \\t]*$"


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and ls: (level, body, own) of each line; own: neither quoted nor an attribution."""
    m = messages.select("conv_id", "turn", "role", "text")
    m = m.withColumn("ls", F.expr(f"transform(split(coalesce(text, ''), '\\n', -1), l -> struct(length(regexp_extract(l, '{PREFIX}', 0)) - length(replace(regexp_extract(l, '{PREFIX}', 0), '>', '')) as level, regexp_replace(l, '{PREFIX}', '') as body))"))
    own = f"x.level = 0 and not (i + 1 < size(ls) and ls[i + 1].level > 0 and x.body rlike '{ATTRIBUTION}')"
    return m.withColumn("ls", F.expr(f"transform(ls, (x, i) -> struct(x.level as level, x.body as body, {own} as own))"))


def own_text():
    """The text without quotes; of a text that has none, the text itself."""
    kept = "array_join(transform(filter(ls, x -> x.own), x -> x.body), '\\n')"
    return F.expr(rf"case when not exists(ls, x -> not x.own) then text else regexp_replace(regexp_replace({kept}, '\\n(?:[ \\t]*\\n)+', '\n\n'), '^\\s+|\\s+$', '') end")


def _lines(p: DataFrame, quoted: bool) -> DataFrame:
    """conv_id, turn, id (of the text), pos, level and h (hash) of the quoted or the own lines with a word."""
    normal = r"lower(trim(regexp_replace(x.body, '\\s+', ' ')))"
    p = p.where("conv_id is not null and turn is not null")
    if quoted:
        p = p.where("exists(ls, x -> x.level > 0)")
    p = p.select("conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("id"), F.posexplode("ls").alias("pos", "x"))
    p = p.where("x.level > 0" if quoted else "x.own").select("conv_id", "turn", "id", "pos", F.col("x.level").alias("level"), F.expr(normal).alias("t"))
    return p.where("t <> ''").select("conv_id", "turn", "id", "pos", "level", F.md5("t").alias("h"))


def _latest_before(own: DataFrame, q: DataFrame) -> DataFrame:
    """q with found: the latest turn before in the same conversation that holds the line, of own.

    Both are dealt out by ranges of (conversation, line, turn) and looked at in
    order within a range; a range begins with what the ones before it have found, so
    that one line of one conversation may fill many tasks.
    """
    none, key = F.lit(None), ["conv_id", "h"]
    sides = own.select(*key, "turn", F.lit(1).alias("kind"), F.col("turn").alias("found"), none.cast("string").alias("id"), none.cast("int").alias("pos"), none.cast("int").alias("level"), none.cast("int").alias("passage"))
    sides = sides.union(q.select(*key, "turn", F.lit(0), none.cast(own.schema["turn"].dataType), "id", "pos", "level", "passage"))
    sides = cut(sides.repartitionByRange(*key, "turn", "kind").withColumn("part", F.spark_partition_id()), "quotes-in-order")
    before = Window.partitionBy("part", *key).orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = sides.withColumn("found", F.last("found", ignorenulls=True).over(before))
    ends = sides.groupBy("part").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key, "turn", "kind", "found")).alias("b"))
    carried, last, held = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r.part):  # one row a range
        if held is not None and last == tuple(r.a):
            carried.append((r.part, *last, held))
        if held is None or last != (r.b.conv_id, r.b.h) or r.b.found is not None:
            held = r.b.found
        last = (r.b.conv_id, r.b.h)
    kinds = sides.schema
    schema = T.StructType([T.StructField(n, kinds[c].dataType) for n, c in (("part", "part"), ("c_conv", "conv_id"), ("c_h", "h"), ("carried", "turn"))])
    start = F.broadcast(sides.sparkSession.createDataFrame(carried, schema))
    sides = sides.where("kind = 0").join(start, "part", "left")
    here = (F.col("conv_id") == F.col("c_conv")) & (F.col("h") == F.col("c_h"))
    return sides.select(*q.columns, F.coalesce("found", F.when(here, F.col("carried"))).alias("found"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, id, passage, level, lines, linked, to_conv, to_turn) of each quoted passage; passage: its first line's number."""
    p = parsed(messages)
    q = _lines(p, True).distinct()
    near = Window.partitionBy("conv_id", "turn", "id").orderBy("pos")
    q = q.withColumn("passage", F.when((F.lag("pos").over(near) == F.col("pos") - 1) & (F.lag("level").over(near) == F.col("level")), F.lit(None)).otherwise(F.col("pos")))
    q = cut(q.withColumn("passage", F.last("passage", ignorenulls=True).over(near)), "quoted-lines")
    own = _lines(p, False).select("conv_id", "turn", "h").distinct().join(q.select("h").distinct(), "h", "left_semi")
    own = cut(own.select("conv_id", "turn", "h"), "quoted-originals")
    same = _latest_before(own, q)
    # otherwise the first message anywhere; one row a line, so a skewed join may split the others
    first = own.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    hit = same.join(first, "h", "left")
    other = "found is null and first.conv_id <> conv_id"
    hit = hit.select("conv_id", "turn", "id", "passage", "level", F.expr(f"case when found is not null then conv_id when {other} then first.conv_id end").alias("to_conv"), F.expr(f"case when found is not null then found when {other} then first.turn end").alias("to_turn"))
    votes = hit.groupBy("conv_id", "turn", "id", "passage", "level", "to_conv", "to_turn").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("to_turn").isNotNull(), F.struct("n", (F.col("to_conv") == F.col("conv_id")).alias("here"), "to_turn", "to_conv")))
    out = votes.groupBy("conv_id", "turn", "id", "passage", "level").agg(F.sum("n").alias("lines"), best.alias("b"))
    return out.select("conv_id", "turn", "id", "passage", "level", "lines", F.coalesce("b.n", F.lit(0)).cast("long").alias("linked"), F.col("b.to_conv").alias("to_conv"), F.col("b.to_turn").alias("to_turn"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, hops) for (conv_id, turn, to_conv, to_turn), by pointer jumping: log(longest chain) rounds.

    A chain that closes on itself (across conversations) ends where its smallest
    message stands.
    """
    key, to = ["conv_id", "turn"], F.struct(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn"))
    p = cut(parents.select(F.struct(*key).alias("m"), to.alias("r"), (F.col("to_conv") != F.col("conv_id")).cast("long").alias("hops")), "chains")
    for _ in range(64):  # 2**64 messages in a chain
        up = p.select(F.col("m").alias("r"), F.col("r").alias("rr"), F.col("hops").alias("more"))
        q = cut(p.join(up, "r", "left").select("m", F.when(F.col("rr").isNull(), F.col("r")).otherwise(F.least("r", "rr")).alias("next"), "r", "rr", (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "chains")
        moved = q.where("rr is not null and next <> r").limit(1).count()
        p = q.select("m", F.col("next").alias("r"), "hops")
        if not moved:
            break
    return p.select("m.conv_id", "m.turn", F.col("r.conv_id").alias("root_conv"), F.col("r.turn").alias("root_turn"), "hops")


ORDER = ["root_conv", "root_turn", "hops", "turn", "conv_id"]


def _positions(turns: DataFrame) -> DataFrame:
    """(ORDER, position): how many rows of turns stand before each of their turns.

    Turns are counted, dealt out by ranges of the order and counted on within a
    range; what stands before a range is added to it.  So no task gets more than a
    range, however long a conversation is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield batch.set_column(batch.schema.get_field_index("n"), "n", pa.array(before + np.cumsum(n) - n)).append_column("last", pa.array(before + np.cumsum(n)))
            before += int(n.sum())

    turns = turns.groupBy(*ORDER).agg(F.count("*").alias("n"))
    ranged = turns.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ORDER]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER]).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("last", T.LongType())])
    ranged = cut(ranged.mapInArrow(run, schema), "positions")
    sizes = sorted(map(tuple, ranged.groupBy("part").agg(F.max("last")).collect()))  # one row a range
    spark = turns.sparkSession
    base = spark.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "part int, base long")
    return ranged.join(F.broadcast(base), "part").select(*ORDER, (F.col("n") + F.col("base")).alias("position"))


def format_chat(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quoted and n_linked lines, parent, root and position, and the formatted turn of each message."""
    links = cut(quote_links(messages), "quote-links")
    votes = links.where("level = 1 and to_turn is not null").groupBy("conv_id", "turn", "id", "to_conv", "to_turn").agg(F.sum("linked").alias("n"))
    best = votes.groupBy("conv_id", "turn", "id").agg(F.max(F.struct("n", (F.col("to_conv") == F.col("conv_id")).alias("here"), "to_turn", "to_conv")).alias("b"))
    counts = links.groupBy("conv_id", "turn", "id").agg(F.sum("lines").alias("n_quoted"), F.sum("linked").alias("n_linked"))
    linked = cut(counts.join(best, ["conv_id", "turn", "id"], "left").select("conv_id", "turn", "id", "n_quoted", "n_linked", F.col("b.to_conv").alias("parent_conv"), F.col("b.to_turn").alias("parent_turn")), "parents")
    parents = linked.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("parent_conv", "parent_turn")).alias("p"))
    roots = _roots(parents.select("conv_id", "turn", F.col("p.parent_conv").alias("to_conv"), F.col("p.parent_turn").alias("to_turn")))
    p = parsed(messages)
    p = p.select("conv_id", "turn", "role", own_text().alias("own"), F.md5(F.coalesce("text", F.lit(""))).alias("id"))
    out = p.join(linked, ["conv_id", "turn", "id"], "left").join(roots, ["conv_id", "turn"], "left")
    out = out.withColumns({"root_conv": F.coalesce("root_conv", "conv_id"), "root_turn": F.coalesce("root_turn", "turn"), "hops": F.coalesce("hops", F.lit(0)).cast("long")})
    out = cut(out, "turns")
    places = _positions(out.select(*ORDER)).select(*[F.col(c).alias(f"at_{c}") for c in ORDER], "position")
    same = F.lit(True)
    for c in ORDER:
        same = same & F.col(c).eqNullSafe(F.col(f"at_{c}"))
    out = out.join(places, same, "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv", "parent_turn",
        "root_conv", "root_turn", "hops", "position", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("own", F.lit("")), F.lit("<|end|>\n")).alias("formatted"),
    )


def write_chats(messages: DataFrame, path: str) -> None:
    """The formatted turns as text files, conversation after conversation in reply order; sorted by ranges, so one conversation may fill several files."""
    turns = format_chat(messages)
    turns.repartitionByRange("position").sortWithinPartitions("position", "formatted").select(F.expr("substring(formatted, 1, length(formatted) - 1)")).write.text(path)
