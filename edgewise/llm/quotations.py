"""Chat formatting by quotation linking.

A line's quote level is its number of leading ``>`` marks. Runs of one level are quoted
passages; each passage and each of its lines is normalised (case, blanks) and hashed,
and joined by hash to the own words of the latest earlier message of the conversation, or,
failing that, to the first message of the first other conversation that says them. Lines
under LEAST_CHARS are not matched alone; passages as short are, inside the conversation. A message answers the original with
most matching lines (of several, the latest; a passage matched in whole counts as all
its lines and one more). Without a match it answers the message before it. Quoted lines
go; lines that announce a quote go with them.

Reply order is the order of a conversation in which every message follows the one it
answers: by ``thread`` (the turn at which its side branch left the main line) and turn.
The result is a row a message with its place in that order, so a conversation of any
length is never gathered; ``formatted`` is the message as a chat line.

Originals are reduced to one row a (conversation, hash) and a hash, and written, before the
join, so a very common message is one row and a widely quoted line may be split. Defined
cases: null text is empty; rows of equal (conv_id, turn) are told apart by role and text, and
equal rows get equal links; null keys form a conversation of their own, in which a null
turn has no other before it; a message of quotes alone has empty text; a message of any
number of lines is parsed in linear time; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgewise.session import stage

#: Turns of a conversation that one window of the ordering handles.
SPAN = 256
MARK = r"^[\x20\x09]*((?:>[\x20\x09]?)+)"
LEAST_CHARS = 8


def _level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 1), r"[\x20\x09]", ""))


def _bare(line):
    return F.regexp_replace(line, MARK, "")


def normal(text):
    """Lower case, one blank between words, none outside."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """Messages with ``lines``: level, bare text and place of each line."""
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # Rows of one turn are told apart by ``version``.
    base = base.select("conv_id", "turn", F.xxhash64("role", "text").alias("version"), "role", "text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("place"), _level(x).alias("level"), _bare(x).alias("line")))
    # The explode of one value keeps the optimizer from making the lines anew for each of them.
    return base.select("*", F.explode(F.array(lines)).alias("lines"))


def own_text(lines, text):
    """The message without quotes, announcements of quotes and blank edges."""
    kept = F.expr(r"filter(lines, (x, i) -> x.level = 0 AND NOT (get(lines, i + 1).level > 0 AND x.line RLIKE '(wrote|schrieb|écrit|escribió)[^:]{0,20}:[ \\t]*$'))")
    trimmed = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.exists(lines, lambda x: x["level"] > 0), trimmed).otherwise(text)


def said_hashes(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, h): hashes of each message's own lines and of its whole own text."""
    lines = parsed.select("conv_id", "turn", F.explode("lines").alias("x")).where("x.level = 0").select("conv_id", "turn", normal(F.col("x.line")).alias("t"))
    whole = parsed.select("conv_id", "turn", normal(own_text(F.col("lines"), F.col("text"))).alias("t"))
    return lines.union(whole).where("t <> ''").select("conv_id", "turn", F.xxhash64("t").alias("h")).distinct()


def quoted_hashes(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, version, level, h, weight, short): hashes of quoted lines and of whole quoted passages."""
    key = ["conv_id", "turn", "version"]
    quotes = F.filter("lines", lambda x: x["level"] > 0)
    # A passage ends where the level changes. The lines become one text that is cut there: a mark, the level, a mark, the lines.
    cut = F.expr(r"""transform(lines, (x, i) -> concat(if(i = 0 OR get(lines, i - 1).level <> x.level, concat('\u0001', x.level, '\u0002'), '\n'), translate(x.line, '\u0001\u0002', '  ')))""")
    quoting = parsed.where(F.size(quotes) > 0)
    runs = quoting.select(*key, F.explode(F.split(F.array_join(cut, ""), "\u0001")).alias("run"))
    runs = runs.select(*key, F.substring_index("run", "\u0002", 1).try_cast("int").alias("level"), F.expr(r"substring(run, instr(run, '\u0002') + 1)").alias("body")).where("level > 0")
    n_lines = F.length("body") - F.length(F.replace("body", F.lit("\n"))) + 1
    whole = runs.select(*key, "level", normal(F.col("body")).alias("t"), (n_lines + 1).alias("weight"))
    lines = quoting.select(*key, F.explode(quotes).alias("x")).select(*key, F.col("x.level").alias("level"), normal(F.col("x.line")).alias("t"), F.lit(1).alias("weight"))
    every = whole.where("t <> ''").union(lines.where(F.length("t") >= LEAST_CHARS))
    return every.select(*key, "level", F.xxhash64("t").alias("h"), "weight", (F.length("t") < LEAST_CHARS).alias("short")).distinct()


def latest_said(said: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, h, turn, near_turn): the last turn before each quoting turn that says h in its
    conversation, in windows of SPAN turns."""
    key = ["conv_id", "h"]
    said = said.where("turn is not null")
    turns = said.select(*key, "turn", F.col("turn").alias("own")).union(quotes.select(*key, "turn", F.lit(None).cast("long"))).groupBy(*key, "turn").agg(F.max("own").alias("own"))
    turns = turns.withColumn("span", F.floor(F.col("turn") / SPAN))
    ends = turns.groupBy(*key, "span").agg(F.max("own").alias("last"))
    carry = ends.select(*key, "span", F.max("last").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inner = turns.withColumn("near", F.max("own").over(Window.partitionBy(*key, "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)))
    return _match(inner, carry, [*key, "span"]).select(*key, "turn", F.coalesce("near", "carry").alias("near_turn")).where("near_turn is not null")


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, version, linked, to_conv, to_turn, n_links): the message that each quoting message answers."""
    key = ["conv_id", "turn", "version"]
    quotes = stage(quoted_hashes(parsed), "quotes")
    asked = stage(quotes.select("h").distinct(), "asked")
    said = stage(said_hashes(parsed).join(asked, "h", "left_semi"), "said")
    near = stage(latest_said(said, quotes.select("conv_id", "h", "turn").distinct()), "near")
    # The two smallest conversations that say it: the first may be the quoting one.
    other = said.where("conv_id is not null AND turn is not null").groupBy("conv_id", "h").agg(F.min("turn").alias("at"))
    far = stage(other.groupBy("h").agg(F.min(F.struct("conv_id", "at")).alias("far")), "far")
    second = stage(other.join(far, "h").where("conv_id <> far.conv_id").groupBy("h").agg(F.min(F.struct("conv_id", "at")).alias("second")), "second")
    found = _match(quotes, near, ["conv_id", "h", "turn"]).join(far, "h", "left").join(second, "h", "left")
    inside = F.col("near_turn").isNotNull()
    far = F.when(~F.col("short"), F.when(F.col("far.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("far")))
    found = found.select(
        *key, "level", "weight",
        F.when(inside, F.col("conv_id")).otherwise(far["conv_id"]).alias("to_conv"),
        F.when(inside, F.col("near_turn")).otherwise(far["at"]).alias("to_turn"),
        inside.cast("int").alias("inside"),
    )
    found = found.where("to_turn is not null")
    # The outermost quote is what is answered; deeper ones are what that answered.
    votes = found.groupBy(*key, "to_conv", "to_turn").agg(F.min("level").alias("level"), F.sum("weight").alias("votes"), F.max("inside").alias("inside"))
    best = F.max_by(F.struct("to_conv", "to_turn"), F.struct(F.coalesce("inside", F.lit(0)), -F.col("level"), "votes", "to_turn", "to_conv"))
    out = votes.groupBy(*key).agg(best.alias("best"), F.count("*").alias("n_links"))
    return out.select(*key, F.lit(True).alias("linked"), F.col("best.to_conv").alias("to_conv"), F.col("best.to_turn").alias("to_turn"), "n_links")


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``, where null equals null."""
    right = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    on = [left[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return left.join(right, on, "left").drop(*(f"_{k}" for k in keys))


def _spanned(turns: DataFrame) -> DataFrame:
    return turns.distinct().withColumn("span", F.floor(F.col("turn") / SPAN))


def before(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, previous): the turn before each distinct turn, in windows of SPAN turns."""
    turns = _spanned(turns)
    ends = turns.groupBy("conv_id", "span").agg(F.max("turn").alias("last"))
    carry = ends.select("conv_id", "span", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span")).alias("carry"))
    inner = turns.withColumn("lag", F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn")))
    return _match(inner, carry, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("lag", "carry").alias("previous"))


def latest(starts: DataFrame) -> DataFrame:
    """(conv_id, turn, thread) from (conv_id, turn, start or null): the last start up to each turn, 0 before any."""
    turns = _spanned(starts.groupBy("conv_id", "turn").agg(F.max("start").alias("start")))
    ends = turns.groupBy("conv_id", "span").agg(F.max("start").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("conv_id", "span", F.max("last").over(earlier).alias("carry"))
    inner = turns.withColumn("own", F.max("start").over(Window.partitionBy("conv_id", "span").orderBy("turn")))
    return _match(inner, carry, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("own", "carry", F.lit(0).cast("long")).alias("thread"))


def conversations(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes, linked and in reply order.

    Returns conv_id, turn, role, text, parent_conv, parent_turn (null at the start),
    n_quoted lines, n_links, thread, formatted. Sort by (conv_id, thread, turn) to read.
    """
    parsed = parse(messages)
    quoted = F.size(F.filter("lines", lambda x: x["level"] > 0))
    out = parsed.select("conv_id", "turn", "version", "role", own_text(F.col("lines"), F.col("text")).alias("text"), quoted.alias("n_quoted"))
    out = _match(out, before(messages.select("conv_id", "turn")), ["conv_id", "turn"])
    out = _match(out, links(parsed), ["conv_id", "turn", "version"])
    linked = F.coalesce("linked", F.lit(False))
    straight = F.col("to_conv").eqNullSafe(F.col("conv_id")) & F.col("to_turn").eqNullSafe(F.col("previous"))
    out = stage(out.select(
        "conv_id", "turn", "role", "text", "n_quoted", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(linked, F.col("to_conv")).when(F.col("previous").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(linked, F.col("to_turn")).otherwise(F.col("previous")).alias("parent_turn"),
        # A branch starts at a message that answers another than the one before it.
        F.when(linked & ~straight, F.col("turn")).alias("start"),
        F.concat_ws(": ", F.coalesce("role", F.lit("")), "text").alias("formatted"),
    ), "messages")
    return _match(out, latest(out.select("conv_id", "turn", "start")), ["conv_id", "turn"]).drop("start")
