"""Operator 8: conversations without quotes, ordered by reply, in DataFrame operations only.

Each message's lines have a quote level: the number of > marks before them, spaces between these allowed. Lines of level 0
are its own; an attribution line just before a quote ("... wrote:") goes with the quote. Runs of lines at one level are
passages. A passage, and each line of it, is hashed in normal form (lower case, runs of white space as one space, marks
trimmed) and joined within its conversation to the first earlier message whose own text, paragraph or line has that hash.
Of several links a message replies to the latest. A message belongs to the thread of the one it replies to; without a link
it begins a thread unless it follows a message of the conversation, whose thread it then continues.

Originals are the smallest turn per (conversation, hash), a partial aggregate, so a line that everybody repeats stays one
row. Threads come from components() over explicit links. No conversation is gathered: rows carry reply_order, by which any
range of a conversation can be read in order.

Cases: a null text is empty. Messages of no conversation or turn keep a row, link to nothing and have no thread. Messages
that share a conversation and turn each keep a row. A quote of a later or unknown message links to nothing. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.graph import components

MARKS = r"^((?:[ \t]*>)+)"
WROTE = r"(?i)(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"
NORMAL_TRIM = r"^[\s\p{Punct}]+|[\s\p{Punct}]+$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), NORMAL_TRIM, "")


def hashed(text: Column) -> Column:
    return F.xxhash64(normal(text), F.length(normal(text)))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, and quotes: an array of (level, text), one for each passage."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    tagged = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS + "[ \t]?", "").alias("text")))
    m = messages.select("conv_id", "turn", "role", tagged.alias("lines"))
    after = lambda i: F.coalesce(F.try_element_at("lines", i + 2)["level"], F.lit(0))
    m = m.withColumn("lines", F.transform("lines", lambda x, i: F.struct(F.when((x["level"] == 0) & x["text"].rlike(WROTE) & (after(i) > 0), -1).otherwise(x["level"]).alias("level"), x["text"].alias("text"))))
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"])
    body = F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")
    # Where a run of quoted lines begins, and the line after its last.
    at = lambda i: F.try_element_at("lines", i + 1)["level"]
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (at(i) > 0) & ((i == 0) | (at(F.greatest(i - 1, F.lit(0))) != at(i))))
    ends = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (at(i - 1) > 0) & ((i == F.size("lines")) | (at(i - 1) != F.coalesce(at(i), F.lit(0)))))
    m = m.select("conv_id", "turn", "role", body.alias("body"), "lines", F.arrays_zip(begins.alias("begin"), ends.alias("end")).alias("runs"))
    text = lambda r: F.array_join(F.transform(F.slice("lines", r["begin"] + 1, r["end"] - r["begin"]), lambda x: x["text"]), "\n")
    passages = F.transform("runs", lambda r: F.struct(at(r["begin"]).cast("int").alias("level"), text(r).alias("text")))
    return m.select("conv_id", "turn", "role", "body", passages.alias("quotes"))


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, max_level, parent_turn, thread_turn, reply_order."""
    m = stored(parsed(messages), "messages")
    placed = m.where("conv_id is not null and turn is not null")
    pieces = lambda text: F.array_distinct(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n")))
    quoting = placed.where("size(quotes) > 0").select("conv_id", F.col("turn").alias("at"), F.explode("quotes").alias("q"))
    asked = quoting.select("conv_id", "at", F.explode(pieces(F.col("q.text"))).alias("piece")).where(normal(F.col("piece")) != "")
    asked = stored(asked.select("conv_id", "at", hashed(F.col("piece")).alias("h")).distinct(), "asked")
    if asked.isEmpty():
        links = placed.sparkSession.createDataFrame([], "conv_id long, turn long, parent long")
        roots = placed.sparkSession.createDataFrame([], "conv_id long, turn long, thread long")
    else:
        had = placed.select("conv_id", "turn", F.explode(pieces(F.col("body"))).alias("piece")).where(normal(F.col("piece")) != "")
        first = had.groupBy("conv_id", hashed(F.col("piece")).alias("h")).agg(F.min("turn").alias("turn"))
        links = asked.join(first, ["conv_id", "h"]).where("turn < at").groupBy("conv_id", "at").agg(F.max("turn").alias("parent")).withColumnRenamed("at", "turn")
        links = stored(links.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "parent"), "links")
        key = lambda turn: F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 20, "0"), F.lpad(F.col(turn).cast("string"), 20, "0"))
        rooted = components(links.select(key("parent").alias("src"), key("turn").alias("dst")))
        part = lambda c, i: F.split_part(F.col(c), F.lit(":"), F.lit(i)).cast("long")
        roots = rooted.select(part("node", 1).alias("conv_id"), part("node", 2).alias("turn"), part("root", 2).alias("thread"))
    start = placed.groupBy("conv_id").agg(F.min("turn").alias("start"))
    out = m.join(links, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left").join(start, "conv_id", "left")
    thread = F.when(F.col("turn").isNotNull(), F.coalesce("thread", "start")).cast("long")
    order = F.when(F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), F.concat_ws("/", F.lpad(thread.cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 12, "0")))
    levels = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0))
    return out.select("conv_id", "turn", "role", "body", F.size("quotes").alias("n_quotes"), levels.alias("max_level"), F.col("parent").alias("parent_turn"), thread.alias("thread_turn"), order.alias("reply_order"))


def rendered(messages: DataFrame) -> DataFrame:
    """threads() with `line`, the message as a chat template writes it; sort by conv_id, reply_order to read."""
    return threads(messages).withColumn("line", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n")))


#: The same in DuckDB's SQL; threads by recursion over the links of a conversation.
SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
cut AS (SELECT rid, conv_id, turn, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM m),
lev AS (SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', '') AS text FROM cut),
told AS (SELECT rid, conv_id, turn, i, text, CASE WHEN level = 0 AND regexp_matches(text, '(?i)(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$') AND lead(level, 1, 0) OVER (PARTITION BY rid ORDER BY i) > 0 THEN -1 ELSE level END AS level FROM lev),
own AS (SELECT rid, regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS body FROM told GROUP BY rid),
edge AS (SELECT *, CASE WHEN level <> lag(level, 1, -2) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM told),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM edge),
passage AS (SELECT rid, conv_id, turn, run, any_value(level) AS level, string_agg(text, chr(10) ORDER BY i) AS text FROM run WHERE level > 0 GROUP BY ALL),
pieces AS (
  SELECT true AS quoted, conv_id, turn, unnest(list_concat([text], regexp_split_to_array(text, '\n\s*\n'), string_split(text, chr(10)))) AS piece FROM passage
  UNION ALL SELECT false, conv_id, turn, unnest(list_concat([body], regexp_split_to_array(body, '\n\s*\n'), string_split(body, chr(10)))) FROM m JOIN own USING (rid)),
normal AS (SELECT quoted, conv_id, turn, regexp_replace(regexp_replace(lower(piece), '\s+', ' ', 'g'), '^[\s[:punct:]]+|[\s[:punct:]]+$', '', 'g') AS norm FROM pieces WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
first AS (SELECT conv_id, norm, min(turn) AS turn FROM normal WHERE NOT quoted AND norm <> '' GROUP BY conv_id, norm),
link AS (SELECT n.conv_id, n.turn, max(first.turn) AS parent FROM normal n JOIN first ON n.quoted AND n.conv_id = first.conv_id AND n.norm = first.norm AND first.turn < n.turn GROUP BY n.conv_id, n.turn),
both_ways AS (SELECT conv_id, turn AS a, parent AS b FROM link UNION SELECT conv_id, parent, turn FROM link),
reach(conv_id, a, b) AS (SELECT * FROM both_ways UNION SELECT reach.conv_id, reach.a, both_ways.b FROM reach JOIN both_ways ON reach.conv_id = both_ways.conv_id AND reach.b = both_ways.a),
root AS (SELECT conv_id, a AS turn, least(a, min(b)) AS thread FROM reach GROUP BY conv_id, a),
start AS (SELECT conv_id, min(turn) AS start FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
quotes AS (SELECT rid, count(*) AS n, max(level) AS level FROM passage GROUP BY rid),
done AS (
  SELECT m.conv_id, m.turn, role, body, CAST(coalesce(n, 0) AS INT) AS n_quotes, CAST(coalesce(quotes.level, 0) AS INT) AS max_level, parent AS parent_turn,
         CASE WHEN m.turn IS NOT NULL THEN coalesce(thread, start) END AS thread_turn
  FROM m JOIN own USING (rid) LEFT JOIN quotes USING (rid) LEFT JOIN link ON m.conv_id = link.conv_id AND m.turn = link.turn
  LEFT JOIN root ON m.conv_id = root.conv_id AND m.turn = root.turn LEFT JOIN start ON m.conv_id = start.conv_id)
SELECT conv_id, turn, role, body, n_quotes, max_level, parent_turn, thread_turn,
       CASE WHEN turn IS NOT NULL AND conv_id IS NOT NULL THEN lpad(CAST(thread_turn AS VARCHAR), 12, '0') || '/' || lpad(CAST(turn AS VARCHAR), 12, '0') END AS reply_order,
       '<|' || coalesce(role, 'user') || '|>' || chr(10) || body || chr(10) AS line
FROM done
"""
