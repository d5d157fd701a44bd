"""Chat formatting in budgeted windows, by DataFrame functions alone.

Prefix sums of the turns' words, markup included, cut a conversation into spans of whole turns; each span is written as one
window that repeats the conversation's system turn and, as far as the budget allows, up to HISTORY turns before the span.
The mask covers the assistant texts of the span itself, so a repeated text is never a target twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm._common import n_words, table

#: Words of a window, and turns before a span that its window repeats at most.
BUDGET, HISTORY = 256, 2
#: A turn is OPEN role, line break, text, CLOSE, line break.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates; in a text their first character is followed by one more backslash.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, repeated and loss of every window of turns (conv_id, turn, role, text).

    repeated is the number of messages at the window's start that it repeats; loss lists (start, length) of the masked
    texts in code points, as they stand in formatted. A window has at most `budget` words, its markup, system turn and
    history included, unless the system turn and one more turn alone have more. The room that the system turn leaves is
    halved: a span ends where the last word of the next turn lies in another half, and after a turn longer than a half. So
    it fits the room, and whole turns before it fill what is left, the latest first. Null texts and roles are empty;
    turns of a conversation are ordered by turn (null first), role and text, and equal rows stay apart; rows of a null
    conv_id are one conversation. The system turn is the first one if its role is system. An empty table gives an empty
    result. A conversation is one row of the contract's result, so its turns meet in one task; no other grouping occurs,
    and no row holds more than a span and its history.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    role = F.regexp_replace(F.regexp_replace(escape(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n")
    rows = clean.withColumn("head", F.concat(F.lit(OPEN), role, F.lit("\n"))).withColumn("body", escape(F.col("text"))).withColumn("message", F.concat("head", "body", F.lit(f"{CLOSE}\n")))
    rows = rows.withColumn("words", n_words(F.col("message"))).withColumn("at", F.row_number().over(order))
    # The system turn is charged to every window, so the prefix sums leave it out.
    system = F.first(F.when((F.col("at") == 1) & (F.col("role") == "system"), F.struct("words", "message"))).over(until)
    rows = rows.withColumn("system", system).withColumn("kept", F.coalesce(F.col("system")["words"], F.lit(0)))
    rows = rows.withColumn("half", F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("kept")) / 2)))
    rows = rows.withColumn("new", F.when((F.col("at") == 1) & F.col("system").isNotNull(), 0).otherwise(F.col("words")))
    rows = rows.withColumn("bucket", F.floor((F.sum("new").over(until) - 1) / F.col("half")))
    opens = (F.col("at") > F.when(F.col("system").isNull(), 1).otherwise(2)) & ((F.col("bucket") != F.lag("bucket").over(order)) | (F.lag("new").over(order) > F.col("half")))
    rows = rows.withColumn("before", F.collect_list(F.struct("at", "words", "message")).over(order.rowsBetween(-history, -1)) if history else F.array().cast("array<struct<at:int,words:bigint,message:string>>"))
    rows = rows.withColumn("opens", opens).withColumn("span", F.sum(F.col("opens").cast("int")).over(until))

    own = Window.partitionBy("conv_id", "span")
    left = F.lit(budget) - F.col("kept") - F.sum("new").over(own)
    rows = rows.withColumn("left", left).withColumn("start", F.coalesce(F.sum(F.length("message")).over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    # Of the turns before a span those stay whose words, with those of all later ones, fit what is left.
    earlier = F.filter("before", lambda t: (t["at"] > 1) | F.col("system").isNull())
    fits = F.filter(earlier, lambda t: F.aggregate(F.filter(earlier, lambda u: u["at"] >= t["at"]), F.lit(0).cast("long"), lambda n, u: n + u["words"]) <= F.col("left"))
    again = F.concat(F.array_compact(F.array(F.col("system")["message"])), F.transform(fits, lambda t: t["message"]))
    prefix = F.when(F.col("opens"), F.struct(F.array_join(again, "").alias("text"), F.size(again).alias("messages")))
    part = F.struct("at", "message", (F.col("role") == "assistant").alias("target"), "start", F.length("body").alias("length"))
    spans = rows.select("conv_id", "span", part.alias("part"), prefix.alias("prefix")).groupBy("conv_id", "span").agg(F.sort_array(F.collect_list("part")).alias("turns"), F.max("prefix").alias("prefix"))
    first = F.coalesce(F.col("prefix")["text"], F.lit(""))
    loss = F.transform(F.filter("turns", lambda t: t["target"]), lambda t: F.struct((t["start"] + F.length(first)).cast("int").alias("start"), t["length"].alias("length")))
    formatted = F.concat(first, F.array_join(F.transform("turns", lambda t: t["message"]), ""))
    return spans.select("conv_id", F.col("span").cast("int").alias("window"), formatted.alias("formatted"), F.coalesce(F.col("prefix")["messages"], F.lit(0)).alias("repeated"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the windows' text and mask alone."""
    messages = F.split("formatted", f"{CLOSE}\n".replace("|", r"\|"))
    own = F.slice(messages, F.col("repeated") + 1, F.size(messages) - 1 - F.col("repeated"))

    def parsed(m: Column) -> Column:
        at = F.locate("\n", m)
        role = F.substring(m, len(OPEN) + 1, at - 1 - len(OPEN))
        role = unescape(F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\"))
        return F.concat(role, F.lit("\n"), unescape(F.substring(m, at + 1, F.length(m))), F.lit("\n"))

    turns = F.array_join(F.transform(own, parsed), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    each = windows.select("conv_id", "window", F.size(own).alias("n"), turns.alias("turns"), masked.alias("masked"), F.length("formatted").alias("chars"))
    joined = each.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "masked"))).alias("parts"), F.sum("chars").cast("long").alias("formatted_chars"))
    text = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return joined.select("conv_id", "n_turns", F.sha2(text("turns").cast("binary"), 256).alias("turns_sha256"), F.length(text("masked")).cast("long").alias("loss_chars"), F.sha2(text("masked").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_chats(turns.unionByName(planted)))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, '<|im_start|>' || replace(replace(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'), '\', '\\'), chr(10), '\n') || chr(10)
         || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') || '<|im_end|>' || chr(10) AS message,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t
), w AS (SELECT *, len(regexp_extract_all(message, '[^\x20\x09-\x0D]+')) AS words FROM e),
y AS (SELECT conv_id, words AS kept, length(message) AS kept_chars FROM w WHERE pos = 1 AND role = 'system'),
s AS (
  SELECT w.*, coalesce(kept, 0) AS kept, coalesce(kept_chars, 0) AS kept_chars, y.conv_id IS NOT NULL AS has, greatest(1, (256 - coalesce(kept, 0)) // 2) AS half,
         CASE WHEN pos = 1 AND y.conv_id IS NOT NULL THEN 0 ELSE words END AS fresh FROM w LEFT JOIN y ON w.conv_id = y.conv_id
), p AS (SELECT *, (sum(fresh) OVER (PARTITION BY conv_id ORDER BY pos) - 1) // half AS bucket FROM s),
o AS (
  SELECT *, pos > CASE WHEN has THEN 2 ELSE 1 END AND (bucket <> lag(bucket) OVER c OR lag(fresh) OVER c > half) AS opens FROM p WINDOW c AS (PARTITION BY conv_id ORDER BY pos)
), n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS span FROM o),
f AS (SELECT conv_id, span, min(pos) AS first, sum(fresh) AS total, sum(length(message)) AS chars, any_value(kept) AS kept, any_value(kept_chars) AS kept_chars, any_value(has) AS has FROM n GROUP BY ALL),
h AS (
  SELECT f.*, a.words AS w1, length(a.message) AS c1, b.words AS w2, length(b.message) AS c2
  FROM f LEFT JOIN n a ON a.conv_id = f.conv_id AND a.pos = f.first - 1 AND (a.pos > 1 OR NOT f.has)
  LEFT JOIN n b ON b.conv_id = f.conv_id AND b.pos = f.first - 2 AND (b.pos > 1 OR NOT f.has)
), r AS (
  SELECT conv_id, sum(chars + CASE WHEN span = 0 THEN 0 ELSE kept_chars
    + CASE WHEN w1 <= 256 - kept - total THEN c1 + CASE WHEN w1 + w2 <= 256 - kept - total THEN c2 ELSE 0 END ELSE 0 END END) AS chars FROM h GROUP BY conv_id
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(r.chars)::BIGINT AS formatted_chars
FROM n JOIN r USING (conv_id) GROUP BY conv_id
"""
