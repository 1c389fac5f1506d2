"""Quotation linking: who answers whom, told from quoted passages.

DataFrame functions only. A line's quote level is the number of ``>`` marks it
begins with. Neighbouring lines of a message at one level above 0 are a quoted
passage; a message's own words are its lines at level 0.

1. Lines of messages that quote are numbered and grouped into passages by a
   running count of level changes within the message.
2. Passages are normalised (case, white space and runs of marks do not count) and hashed, as
   a whole and line by line. The messages of conversations that hold a quote
   offer the hashes of their own text as a whole, of its paragraphs and of its lines.
3. A join on (conversation, hash) finds the latest earlier message that offers
   a passage, a match of a whole passage before one of a line, either of any length. A message answers the
   message that its outermost quoted passages link to, the latest if there are several.
   Inner levels tell more: what a message quotes at one level answered what it quotes at
   the next, if that is earlier, which links messages that quote nothing themselves.
4. Pointer jumping over the answers gives every message the message its thread
   starts with and its depth in it.
5. Pointer jumping over the round trip of each thread (down to the first answer,
   on to the next answer to the same message, back up) numbers its messages in
   reply order: each one is followed by its answers, in order of turns, each with all of its
   own. (conv_id, thread, position) is that order, and the text returned has no quotes.

No quotes, no link: such a message starts a thread of its own, as does one whose
quotes nobody wrote, or whose conv_id or turn is null. Null text counts as
empty. Rows that repeat a (conv_id, turn) are all returned; what they say and
quote is taken together. A line that a conversation repeats is never joined
with each of its quotes: the latest earlier one is looked up in order of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import cut, table
from candlewick.plans.windows import before

MARKS = r"^[ \t]*((?:>[ \t]*)+)"
#: Turns of a conversation that one window spans.
TURNS = 1024


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def _hashes(text: Column) -> Column:
    """md5 of the normalised text, null where that is empty."""
    return F.when(normal(text) != "", F.md5(normal(text)))


def unquoted(text: Column) -> Column:
    """A text without its quoted lines; unchanged if it has none."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(MARKS)), "\n")
    return F.when(text.rlike("(?m)" + MARKS), F.trim(kept)).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, level, passage, lines) of each quoted passage; ``mid`` tells messages apart."""
    quoting = messages.where(F.col("text").rlike("(?m)" + MARKS))
    lines = quoting.select("mid", "conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), "[^>]", "")))
    order = Window.partitionBy("mid").orderBy("at")
    lines = lines.withColumn("step", F.when(F.col("level") == F.lag("level").over(order), 0).otherwise(1))
    lines = lines.withColumn("run", F.sum("step").over(order)).where("level > 0")
    lines = lines.withColumn("line", F.regexp_replace("line", MARKS, ""))
    grouped = lines.groupBy("mid", "conv_id", "turn", "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("own"))
    return grouped.select("mid", "conv_id", "turn", "level", F.concat_ws("\n", F.col("own.line")).alias("passage"), F.col("own.line").alias("lines"))


def offers(messages: DataFrame) -> DataFrame:
    """(conv_id, hash, turn): what each message says itself, whole, by paragraph and by line."""
    own = unquoted(F.col("text"))
    parts = F.array_union(F.array(own), F.array_union(F.split(own, r"\n[ \t]*\n"), F.split(own, "\n")))
    rows = messages.select("conv_id", "turn", F.explode(parts).alias("part")).select("conv_id", _hashes(F.col("part")).alias("hash"), "turn")
    return rows.where("hash is not null and conv_id is not null and turn is not null").distinct()


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of the messages that answer another one."""
    quotes = cut(passages(messages).where("conv_id is not null and turn is not null"))
    asked = quotes.select("mid", "conv_id", "turn", "level", _hashes(F.col("passage")).alias("hash"), F.lit(0).alias("grain"))
    asked = asked.unionByName(quotes.select("mid", "conv_id", "turn", "level", F.explode("lines").alias("line")).select("mid", "conv_id", "turn", "level", _hashes(F.col("line")).alias("hash"), F.lit(1).alias("grain")))
    asked = asked.where("hash is not null").select("conv_id", "hash", "turn", "level", "grain").distinct()
    said = offers(messages.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")).join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    # the latest offer before each quote: within a block of turns by a window, from earlier blocks by one row per block
    events = asked.select("conv_id", "hash", F.col("turn").alias("at"), "level", "grain", F.lit(None).cast("long").alias("said"))
    events = events.unionByName(said.select("conv_id", "hash", F.col("turn").alias("at"), F.col("turn").cast("long").alias("said")), allowMissingColumns=True)
    events = events.withColumn("block", F.floor(F.col("at") / TURNS))
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("conv_id", "hash", "block").agg(F.max("said").alias("last")).withColumn("before", F.max("last").over(earlier)).drop("last")
    found = events.withColumn("near", F.max("said").over(inside)).where("level is not null").join(carried, ["conv_id", "hash", "block"])
    found = found.select("conv_id", F.col("at").alias("turn"), "level", "grain", F.coalesce("near", "before").alias("said")).where("said is not null")
    per_level = cut(found.groupBy("conv_id", "turn", "level").agg(F.max(F.struct(-F.col("grain"), F.col("said"))).alias("best")).select("conv_id", "turn", "level", "best.said"))
    best = per_level.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), F.col("said"))).alias("best")).select("conv_id", "turn", F.lit(1).alias("own"), "best.said")
    inner = per_level.select("conv_id", "turn", (F.col("level") - 1).alias("level"), F.col("said").alias("before"))
    told = per_level.join(inner, ["conv_id", "turn", "level"]).where("before < said").select("conv_id", F.col("said").alias("turn"), F.lit(0).alias("own"), F.col("before").alias("said"))
    both = best.unionByName(told).groupBy("conv_id", "turn").agg(F.max(F.struct("own", "said")).alias("best"))
    return both.select("conv_id", "turn", F.col("best.said").alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of each answer, by pointer jumping."""
    state = cut(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("top"), F.col("depth").alias("more"))
        state_next = state.join(up, ["conv_id", "thread"], "left")
        state_next = cut(state_next.select("conv_id", "turn", "reply_to", F.coalesce("top", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved")))
        state = state_next.drop("moved")
        if state_next.where("moved").isEmpty():
            return state


def reply_order(told: DataFrame) -> DataFrame:
    """(conv_id, turn, position) of the messages of each thread of ``told``, from 0 on, each before its answers and these before the next answer to what it answers."""
    nodes = told.select("conv_id", "turn", F.col("reply_to").alias("parent"), "thread")
    nodes = nodes.unionByName(told.select("conv_id", F.col("thread").alias("turn"), F.lit(None).cast(told.schema["reply_to"].dataType).alias("parent"), "thread").distinct())
    answers = nodes.where("parent is not null")
    first = answers.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    back = -F.col("turn")
    after = before(answers.withColumn("back", back), ["conv_id", "parent"], F.floor(F.col("back") / TURNS), ["back"], F.col("back"), "following")
    after = after.select("conv_id", "turn", (-F.col("following")).alias("sibling"))
    nodes = nodes.join(first, ["conv_id", "turn"], "left").join(after, ["conv_id", "turn"], "left")
    # a message is entered and left; each step names the one that follows it and counts the entries from itself on
    step = lambda turn, leaves: F.struct(turn.cast("long").alias("turn"), F.lit(leaves).alias("leaves"))
    onward = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), False)).when(F.col("parent").isNotNull(), step(F.col("parent"), True))
    ways = F.array(
        F.struct(step(F.col("turn"), False).alias("at"), F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(F.col("turn"), True)).alias("next"), F.lit(1).cast("long").alias("count")),
        F.struct(step(F.col("turn"), True).alias("at"), onward.alias("next"), F.lit(0).cast("long").alias("count")),
    )
    state = cut(nodes.select("conv_id", "thread", F.explode(ways).alias("s")).select("conv_id", "thread", "s.*"))
    while not state.where("next is not null").isEmpty():
        ahead = state.select("conv_id", F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("count").alias("more"))
        state = cut(state.join(ahead, ["conv_id", "next"], "left").select("conv_id", "thread", "at", F.col("beyond").alias("next"), (F.col("count") + F.coalesce("more", F.lit(0))).alias("count")))
    entered = state.where("not at.leaves").select("conv_id", "thread", F.col("at.turn").alias("turn"), "count")
    whole = entered.where("turn = thread").select("conv_id", "thread", F.col("count").alias("size"))
    return entered.join(whole, ["conv_id", "thread"]).select("conv_id", "turn", (F.col("size") - F.col("count")).alias("position"))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, max_level, reply_to, thread, depth, position) of every message.

    ``messages`` has conv_id, turn, role and text.
    """
    quoting = F.col("text").rlike("(?m)" + MARKS)
    lines = F.split("text", "\n", -1)
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))
    levels = F.transform(lines, level)
    # passages: runs of one level above 0 in the list of levels, e.g. ",1,1,0,2," has two
    listed = F.concat(F.lit(","), F.array_join(F.transform(lines, lambda line: level(line).cast("string")), ","), F.lit(","))
    changes = F.regexp_count(F.regexp_replace(listed, r"(,\d+)\1*(?=,)", "$1"), F.lit(",[1-9]"))
    # sha2 of the row tells messages apart without numbering them
    named = messages.select("conv_id", "turn", "role", "text").withColumn("mid", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256))
    told = threads(linked(named.where(F.col("conv_id").isNotNull())))
    out = messages.select(
        "conv_id",
        "turn",
        "role",
        unquoted(F.coalesce("text", F.lit(""))).alias("text"),
        F.when(quoting, changes).otherwise(0).cast("int").alias("n_quotes"),
        F.when(quoting, F.array_max(levels)).otherwise(0).cast("int").alias("max_level"),
    )
    out = out.join(told, ["conv_id", "turn"], "left").join(reply_order(told), ["conv_id", "turn"], "left")
    numbers = {name: F.coalesce(name, F.lit(0)).cast("long") for name in ("depth", "position")}
    return out.withColumn("thread", F.coalesce("thread", "turn")).withColumns(numbers)


def op8_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` with its thread, without quotes."""
    return conversations(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT DISTINCT conv_id, turn, text, md5(concat_ws('~', turn, role, text)) AS mid FROM m),
l AS (
  SELECT conv_id, turn, mid, i, lines[i] AS line,
         length(regexp_replace(regexp_extract(lines[i], '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level
  FROM (SELECT *, string_split(text, chr(10)) AS lines FROM d), range(1, len(lines) + 1) t(i)),
s AS (SELECT *, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS step FROM l WINDOW w AS (PARTITION BY mid ORDER BY i)),
r AS (SELECT *, sum(step) OVER (PARTITION BY mid ORDER BY i) AS run FROM s),
p AS (
  SELECT conv_id, turn, mid, run, level, string_agg(regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', ''), chr(10) ORDER BY i) AS passage
  FROM r WHERE level > 0 GROUP BY ALL),
own AS (
  SELECT conv_id, turn, mid, max(level) > 0 AS quotes, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0) AS rest
  FROM l GROUP BY ALL),
said AS (
  SELECT o.conv_id, o.turn, unnest([x] || string_split_regex(x, '\n[ \t]*\n') || string_split(x, chr(10))) AS part
  FROM (SELECT own.*, CASE WHEN quotes THEN trim(coalesce(rest, ''), ' ') ELSE d.text END AS x FROM own JOIN d USING (conv_id, turn, mid)) o),
n AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(part), '[\s>]+', ' ', 'g'), ' ') AS h FROM said),
a AS (
  SELECT conv_id, turn, level, 0 AS grain, trim(regexp_replace(lower(passage), '[\s>]+', ' ', 'g'), ' ') AS h FROM p
  UNION ALL
  SELECT conv_id, turn, level, 1, trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '')), '[\s>]+', ' ', 'g'), ' ') FROM r WHERE level > 0),
f AS (
  SELECT a.conv_id, a.turn, a.level, a.grain, max(n.turn) AS said
  FROM a JOIN n ON a.conv_id = n.conv_id AND a.h = n.h AND n.turn < a.turn WHERE a.h <> '' GROUP BY ALL),
v AS (SELECT conv_id, turn, level, arg_max(said, (-grain, said)) AS said FROM f GROUP BY ALL),
b AS (
  SELECT conv_id, turn, 1 AS own, arg_max(said, (-level, said)) AS said FROM v GROUP BY ALL
  UNION ALL
  SELECT a.conv_id, a.said, 0, b.said FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.level = a.level + 1 AND b.said < a.said),
k AS (SELECT conv_id, turn, arg_max(said, (own, said)) AS reply_to FROM b GROUP BY ALL),
t AS (
  SELECT conv_id, turn, reply_to, reply_to AS thread, 1 AS depth, [reply_to, turn] AS path FROM k
  UNION ALL
  SELECT t.conv_id, t.turn, t.reply_to, k.reply_to, t.depth + 1, [k.reply_to] || t.path FROM t JOIN k ON t.conv_id = k.conv_id AND t.thread = k.turn),
u AS (SELECT conv_id, turn, any_value(reply_to) AS reply_to, arg_max(thread, depth) AS thread, max(depth) AS depth, arg_max(path, depth) AS path FROM t GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY path) AS position FROM u),
c AS (SELECT mid, count(DISTINCT run) FILTER (WHERE level > 0) AS n_quotes, max(level) AS max_level FROM r GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role,
       CASE WHEN own.quotes THEN trim(coalesce(own.rest, ''), ' ') ELSE m.text END AS text,
       c.n_quotes::INT AS n_quotes, c.max_level::INT AS max_level, u.reply_to,
       coalesce(u.thread, m.turn) AS thread, coalesce(u.depth, 0)::BIGINT AS depth, coalesce(u.position, 0)::BIGINT AS position
FROM m JOIN own ON own.mid = md5(concat_ws('~', m.turn, m.role, m.text)) AND own.conv_id = m.conv_id AND own.turn = m.turn
JOIN (SELECT DISTINCT * FROM c) c USING (mid)
LEFT JOIN z u ON u.conv_id = m.conv_id AND u.turn = m.turn
"""
