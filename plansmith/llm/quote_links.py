"""Chat formatting by quotation linking.

Quote marks at the start of a line give its level. A maximal run of lines of one level is a passage; it is re-flowed,
normalised and hashed, as a whole and by its lines and sentences, and meets the first message of its conversation that
says the same. A message replies to what it quotes at the lowest level, and else to the message before it. The first reply to a
message goes on in its strand, every other one opens a strand. Messages come out in strands, in order, without their quotes.
Only built-in functions; order inside a conversation is found in blocks of turns, so a long conversation isn't one
task's work, and strands that go on after others by pointer jumping over their runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansmith.llm.common import ascii_lower, discard, stored, table

PREFIX = r"^(?:[ \t]*>)+[ \t]?"
INTRO = r"^On .{1,200} wrote:[ \t\r]*$"
#: Turns of a block, and groups in which rows meet what many of them share.
BLOCK, SALTS = 1024, 16


def _level(line: Column) -> Column:
    mark = F.regexp_extract(line, PREFIX, 0)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, PREFIX, "")


def _flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_lower(text), r"[ \t\r\n\f\x0b]+", " "))


def _hashed(p: Column) -> Column:
    return F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(3), p).alias("b"))


def _units(lines: Column) -> Column:
    """What a run of lines says: all of it re-flowed, then its lines and its sentences, each once, without blank ones."""
    flat = _flat(F.array_join(lines, " "))
    sentences = F.split(F.regexp_replace(flat, "([.!?]) ", "$1\n"), "\n")
    return F.filter(F.array_distinct(F.concat(F.array(flat), F.transform(lines, lambda x: _flat(x)), sentences)), lambda p: p != "")


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """df with text_col's own lines as body, and n_quoted (lines), n_linked (passages), reply_to (turn), strand (turn it began with) and place in it (from 1).

    A passage links to the smallest earlier turn whose own lines say all of it, or else to the one that says most of its
    lines and sentences, the latest of equals. reply_to: of the lowest level with links, the turn with most
    passages, then with most said, the latest of equals; without links the turn before; null for a conversation's first. A line
    "On ... wrote:" before a quote goes with the quote. The first reply to a message continues its strand; place counts
    on from there. Null text: empty. Null conversations are one conversation, null turns come first. Rows with the same
    conversation and turn share their links and stand in order of their text; a reply to them follows the last.
    Repeated rows stay. Columns of df with the new names are replaced. Empty input: empty result.
    """
    lines = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)
    rows = df.withColumns({"__c": F.col(f"`{conv_col}`"), "__t": F.col(f"`{turn_col}`").cast("long"), "__l": F.transform(lines, lambda x: F.struct(_level(x).alias("level"), x.alias("line")))})
    after = lambda i: F.coalesce(F.get(F.col("__l"), i + 1)["level"], F.lit(0))
    rows = rows.withColumn("__x", F.filter("__l", lambda x, i: ~(_bare(x["line"]).rlike(INTRO) & (after(i) > x["level"]))))
    own = F.transform(F.filter("__x", lambda x: x["level"] == 0), lambda x: x["line"])
    at = lambda i: F.get(F.col("__x"), i)["level"]
    places = F.when(F.size("__x") > 0, F.sequence(F.lit(0), F.size("__x") - 1)).otherwise(F.array().cast("array<int>"))
    quoting = rows.filter(F.exists("__x", lambda x: x["level"] > 0)).select("__c", "__t", "__x", F.filter(places, lambda i: (i == 0) | (at(i) != at(i - 1))).alias("__s"))
    run = lambda s, j: F.transform(F.slice("__x", s + 1, F.coalesce(F.get(F.col("__s"), j + 1), F.size("__x")) - s), lambda x: _bare(x["line"]))
    passages = F.transform("__s", lambda s, j: F.struct(at(s).alias("level"), j.alias("j"), _units(run(s, j)).alias("units")))
    quotes = quoting.select("__c", "__t", F.explode(F.filter(passages, lambda p: p["level"] > 0)).alias("p")).select("__c", "__t", "p.level", "p.j", F.posexplode("p.units").alias("i", "u"))
    quotes = stored(quotes.select("__c", "__t", "level", "j", (F.col("i") == 0).alias("whole"), _hashed(F.col("u")).alias("h")), "quotes")
    # A conversation without any quote needs no index of what was said in it.
    asked = quotes.select(F.col("__c").alias("qc")).distinct()
    blank = F.concat(F.lit("\n"), F.array_join(own, "\n"), F.lit("\n"))
    paragraphs = F.transform(F.split(F.regexp_replace(blank, r"\n[ \t\r\f\x0b]*\n", "\x1e"), "\x1e"), lambda p: _flat(p))
    said = F.array_distinct(F.transform(F.filter(F.concat(_units(own), paragraphs), lambda p: p != ""), _hashed))
    said = rows.withColumn("__said", said).join(asked, F.col("__c").eqNullSafe(F.col("qc")), "left_semi").select("__c", "__t", F.explode("__said").alias("h"))
    said = said.groupBy(F.col("__c").alias("fc"), F.col("h").alias("fh")).agg(F.min("__t").alias("from"))
    wanted = quotes.select(F.col("__c").alias("wc"), F.col("h").alias("wh")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    first = said.join(wanted, F.col("fc").eqNullSafe(F.col("wc")) & (F.col("fh") == F.col("wh")), "left_semi").select("fc", "fh", "from", salts)
    met = quotes.withColumn("mine", F.pmod(F.xxhash64("__t", "j"), F.lit(SALTS)).cast("int")).hint("merge")
    met = met.join(first, F.col("__c").eqNullSafe(F.col("fc")) & (F.col("h") == F.col("fh")) & (F.col("mine") == F.col("salt")) & (F.col("from") < F.col("__t")))
    each = met.groupBy("__c", "__t", "level", "j", "from").agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    linked = each.groupBy("__c", "__t", "level", "j").agg(F.max(F.struct("whole", "n", "from")).alias("m")).select("__c", "__t", "level", "m.from", "m.n")
    counted = linked.groupBy("__c", "__t", "level", "from").agg(F.count("*").alias("passages"), F.sum("n").alias("n"))
    links = counted.groupBy(F.col("__c").alias("lc"), F.col("__t").alias("lt")).agg(F.sum("passages").alias("__linked"), F.max(F.struct(-F.col("level"), "passages", "n", "from"))["from"].alias("__to"))

    rows = rows.withColumn("body", F.array_join(own, "\n")).withColumn("__n", F.size(F.filter("__l", lambda x: x["level"] > 0)).cast("long"))
    rows = rows.join(links, F.col("__c").eqNullSafe(F.col("lc")) & F.col("__t").eqNullSafe(F.col("lt")), "left").withColumn("__b", F.floor(F.col("__t") / BLOCK))
    order = Window.partitionBy("__c", "__b").orderBy("__t", "body", F.xxhash64("__l"))
    rows = rows.withColumns({"__i": F.row_number().over(order), "__last": F.lag("__t").over(order)}).drop("__l", "__x", "lc", "lt")
    blocks = rows.groupBy(F.col("__c").alias("bc"), F.col("__b").alias("bb")).agg(F.count("*").alias("m"), F.max("__t").alias("top"))
    before = Window.partitionBy("bc").orderBy(F.col("bb").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("bc", "bb", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("skip"), F.max("top").over(before).alias("past"))
    same = F.col("__c").eqNullSafe(F.col("bc")) & F.col("__b").eqNullSafe(F.col("bb"))
    rows = rows.join(blocks, same).withColumns({"__k": F.col("skip") + F.col("__i"), "__before": F.coalesce("__last", "past")}).drop("bc", "bb", "skip", "past")
    opens = (F.col("__k") == 1) | (F.col("__to").isNotNull() & ~F.col("__to").eqNullSafe(F.col("__before")))
    rows = rows.withColumn("__o", F.when(opens, F.struct(F.col("__k").alias("k"), F.col("__t").alias("t"))))
    tops = rows.groupBy(F.col("__c").alias("bc"), F.col("__b").alias("bb")).agg(F.max("__o").alias("o"))
    tops = tops.select("bc", "bb", F.max("o").over(before).alias("carry"))
    running = F.max("__o").over(Window.partitionBy("__c", "__b").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__s", running).join(tops, same).withColumn("__s", F.coalesce("__s", "carry")).drop("bc", "bb", "carry")
    rows = stored(rows, "messages")
    discard(quotes)
    gone_on = _continued(rows)
    if gone_on is None:
        rows = rows.withColumns({"__skip": F.lit(0).cast("long"), "__root": F.lit(None).cast("long")})
    else:
        rows = rows.withColumn("__a", F.pmod("__k", F.lit(SALTS)).cast("int")).join(
            gone_on.select("rc", "run", F.col("skip").alias("__skip"), F.col("root").alias("__root"), salts), F.col("__c").eqNullSafe(F.col("rc")) & (F.col("__s.k") == F.col("run")) & (F.col("__a") == F.col("salt")), "left"
        )
    out = rows.withColumns(
        {
            "n_quoted": F.col("__n"), "n_linked": F.coalesce("__linked", F.lit(0)).cast("long"), "reply_to": F.coalesce("__to", "__before"),
            "strand": F.when(F.col("__skip").isNotNull() & F.col("__root").isNotNull(), F.col("__root")).otherwise(F.col("__s.t")),
            "place": (F.col("__k") - F.col("__s.k") + 1 + F.coalesce("__skip", F.lit(0))).cast("long"),
        }
    )
    return out.drop("__c", "__t", "__n", "__linked", "__to", "__b", "__i", "__last", "__k", "__before", "__o", "__s", "__a", "rc", "run", "__skip", "__root", "salt")


def _continued(rows: DataFrame) -> DataFrame | None:
    """(rc, run, skip, root) of runs that go on in an older strand: how many messages stand before them in it, and the turn it began with; None without such runs.

    A run is a message that opens one and those that follow it without another. It goes on if it is the first reply
    to the last message of a run. There are as many rows here as messages that open a run.
    """
    openers = rows.filter(F.col("__o").isNotNull()).select(F.col("__c").alias("c"), F.col("__k").alias("run"), F.col("__t").alias("t"), F.col("__to").alias("to"))
    back = openers.filter("run > 1")
    if not back.limit(1).count():
        return None
    runs = stored(rows.groupBy(F.col("__c").alias("rc"), F.col("__s.k").alias("run")).agg(F.max("__k").alias("last"), F.count("*").alias("m")), "runs")
    targets = rows.groupBy(F.col("__c").alias("tc"), F.col("__t").alias("tt")).agg(F.max(F.struct(F.col("__k").alias("k"), F.col("__s.k").alias("run"))).alias("x"))
    replies = back.join(targets, F.col("c").eqNullSafe(F.col("tc")) & (F.col("to") == F.col("tt"))).groupBy("c", "x").agg(F.min("run").alias("run"))
    edges = replies.join(runs.select("rc", F.col("run").alias("old"), "last"), F.col("c").eqNullSafe(F.col("rc")) & (F.col("x.run") == F.col("old")) & (F.col("x.k") == F.col("last")))
    edges = stored(edges.select("c", "run", F.col("old").alias("next")), "edges")
    while True:
        far = edges.select(F.col("c").alias("fc"), F.col("run").alias("fr"), F.col("next").alias("far"))
        jumped = edges.join(far, F.col("c").eqNullSafe(F.col("fc")) & (F.col("next") == F.col("fr")), "left")
        jumped = stored(jumped.select("c", "run", F.coalesce("far", "next").alias("next"), F.col("far").isNotNull().alias("moved")), "edges")
        discard(edges)
        edges = jumped.select("c", "run", "next")
        edges._stored_at = jumped._stored_at
        if not jumped.filter("moved").limit(1).count():
            break
    to = edges.select(F.col("c").alias("ec"), F.col("run").alias("er"), "next")
    named = runs.join(to, F.col("rc").eqNullSafe(F.col("ec")) & (F.col("run") == F.col("er")), "left").withColumn("root_run", F.coalesce("next", "run"))
    earlier = Window.partitionBy("rc", "root_run").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("skip", F.coalesce(F.sum("m").over(earlier), F.lit(0))).filter("next IS NOT NULL")
    begun = openers.select(F.col("c").alias("oc"), F.col("run").alias("orun"), F.col("t").alias("root"))
    out = named.join(begun, F.col("rc").eqNullSafe(F.col("oc")) & (F.col("root_run") == F.col("orun"))).select("rc", "run", "skip", "root")
    return stored(out, "strands")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = link_quotes(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", "n_quoted", "n_linked", "reply_to", "strand", "place", "body")


def _sql_flat(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g'), ' ')"


def _sql_units(flat: str, lines: str, more: str = "[]") -> str:
    sentences = f"string_split(regexp_replace({flat}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_distinct(list_filter([{flat}] || list_transform({lines}, lambda x: {_sql_flat('x')}) || {sentences} || {more}, lambda p: p <> ''))"


_PARAGRAPHS = f"list_transform(string_split(regexp_replace(chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10), '\\n[ \\t\\r\\f\\x0b]*\\n', chr(30), 'g'), chr(30)), lambda x: {_sql_flat('x')})"
ORACLE_SQL = rf"""
WITH RECURSIVE l0 AS (
  SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM conversations
), l1 AS (
  SELECT conv_id, turn, i, line, length(regexp_extract(line, '^(?:[ \t]*>)+')) - length(replace(regexp_extract(line, '^(?:[ \t]*>)+'), '>', '')) AS level,
    regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS bare FROM l0
), l2 AS (
  SELECT *, regexp_matches(bare, '^On .{{1,200}} wrote:[ \t\r]*$') AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > level AS intro FROM l1
), l3 AS (
  SELECT *, coalesce(level <> lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i), true) AS starts FROM l2 WHERE NOT intro
), l4 AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS j FROM l3),
quoted AS (
  SELECT conv_id, turn, j, any_value(level) AS level, {_sql_flat("string_agg(bare, ' ' ORDER BY i)")} AS flat, list(bare ORDER BY i) AS ls FROM l4 WHERE level > 0 GROUP BY conv_id, turn, j
), units AS (SELECT conv_id, turn, j, level, flat, unnest({_sql_units("flat", "ls")}) AS u FROM quoted),
own AS (
  SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS body, {_sql_flat("string_agg(line, ' ' ORDER BY i)")} AS flat, list(line ORDER BY i) AS ls, {_PARAGRAPHS} AS ps
  FROM l4 WHERE level = 0 GROUP BY conv_id, turn
), said AS (SELECT conv_id, u, min(turn) AS src FROM (SELECT conv_id, turn, unnest({_sql_units("flat", "ls", "ps")}) AS u FROM own) GROUP BY conv_id, u),
each_ AS (
  SELECT q.conv_id, q.turn, level, j, src, max(CAST(q.u = flat AS INT)) AS whole, count(*) AS n FROM units q JOIN said s ON s.conv_id = q.conv_id AND s.u = q.u AND src < q.turn GROUP BY ALL
), linked AS (SELECT conv_id, turn, level, j, max((whole, n, src)) AS m FROM each_ GROUP BY ALL),
counted AS (SELECT conv_id, turn, level, struct_extract(m, 3) AS src, count(*) AS passages, sum(struct_extract(m, 2)) AS n FROM linked GROUP BY ALL),
links AS (SELECT conv_id, turn, sum(passages) AS n_linked, arg_max(src, (-level, passages, n, src)) AS target FROM counted GROUP BY ALL),
msgs AS (
  SELECT m.conv_id, m.turn, m.role, n_linked, target, lag(m.turn) OVER w AS before, row_number() OVER w AS k FROM conversations m
  LEFT JOIN links USING (conv_id, turn) WINDOW w AS (PARTITION BY m.conv_id ORDER BY m.turn)
), runs AS (
  SELECT *, max(CASE WHEN k = 1 OR (target IS NOT NULL AND target IS DISTINCT FROM before) THEN k END) OVER (PARTITION BY conv_id ORDER BY k) AS run FROM msgs
), ends AS (SELECT conv_id, run, max(k) AS last FROM runs GROUP BY ALL),
goes AS (
  SELECT a.conv_id, min(a.k) AS run, any_value(b.run) AS old FROM runs a JOIN runs b ON a.conv_id = b.conv_id AND a.target = b.turn JOIN ends e ON e.conv_id = b.conv_id AND e.run = b.run AND e.last = b.k
  WHERE a.k = a.run AND a.k > 1 GROUP BY a.conv_id, b.k
), root AS (
  SELECT conv_id, run, run AS root FROM ends WHERE (conv_id, run) NOT IN (SELECT conv_id, run FROM goes)
  UNION ALL SELECT g.conv_id, g.run, r.root FROM goes g JOIN root r ON r.conv_id = g.conv_id AND r.run = g.old
), quotes_ AS (SELECT conv_id, turn, count(*) FILTER (WHERE level > 0) AS n_quoted FROM l1 GROUP BY ALL)
SELECT x.conv_id, x.turn, x.role, CAST(n_quoted AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, coalesce(target, before) AS reply_to,
  first_value(x.turn) OVER w AS strand, CAST(row_number() OVER w AS BIGINT) AS place, coalesce(body, '') AS body
FROM runs x JOIN root r ON r.conv_id = x.conv_id AND r.run = x.run JOIN quotes_ q ON q.conv_id = x.conv_id AND q.turn = x.turn LEFT JOIN own o ON o.conv_id = x.conv_id AND o.turn = x.turn
WINDOW w AS (PARTITION BY x.conv_id, r.root ORDER BY x.k)
"""
