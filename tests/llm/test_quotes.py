"""Conversations with real quotes: re-wrapped, partial, nested and short ones, against SQL and by hand."""

import random

import duckdb

from plansmith.llm import quote_links

PARTS = ["The build fails on Tuesdays. It says the disk is full.", "Try to clear the cache first!", "Yes.", "Nothing helps here, sorry. Is it the new disk?", "one item\nother item\nlast item"]


def quoted(text, level, width):
    out = []
    for line in text.split("\n"):
        words, now = line.split(" "), ""
        for w in words:
            if now and len(now) + len(w) > width:
                out.append(now)
                now = ""
            now = f"{now} {w}".strip()
        out.append(now)
    return "\n".join(">" * level + " " + x for x in out)


def made(rng, n):
    rows = []
    for conv in range(12):
        own = []
        for turn in range(n):
            mine = f"{rng.choice(PARTS)} Said {rng.randrange(6)}."
            text = mine
            for _ in range(rng.randrange(3)):
                if own:
                    old = rng.choice(own)
                    piece = rng.choice([old, old.split(". ")[0] + ".", old.split("\n")[0]])
                    text = f"On Monday A wrote:\n{quoted(piece, rng.randrange(1, 3), rng.choice([9, 30, 200]))}\n{text}"
            own.append(mine)
            rows.append((conv, turn, "user", text))
    return rows


def test_sql_agrees_on_quotes(spark, tmp_path):
    rows = made(random.Random(5), 14)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    path = str(tmp_path / "c.parquet")
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    names = ["conv_id", "turn", "n_quoted", "n_linked", "reply_to", "strand", "place", "body"]
    got = sorted(tuple(r[x] for x in names) for r in quote_links.link_quotes(df.repartition(3)).collect())
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({quote_links.ORACLE_SQL})").fetchall())
    assert got == want
    assert sum(r[3] for r in got) > 60 and len({(r[0], r[5]) for r in got}) > 20
    for conv in range(12):  # strands hold each message once, replies after what they reply to
        mine = [r for r in got if r[0] == conv]
        for strand in {r[5] for r in mine}:
            inside = sorted((r for r in mine if r[5] == strand), key=lambda r: r[6])
            assert [r[6] for r in inside] == list(range(1, len(inside) + 1)) and [r[1] for r in inside] == sorted(r[1] for r in inside)
            assert all(b[4] == a[1] for a, b in zip(inside, inside[1:]))


def test_rewrapped_nested_and_short(spark):
    rows = [
        (1, 0, "Does the new version\nread the old files? I have many of them."), (1, 1, "> Does the new version read\n> the old files?\nYes."), (1, 2, "> Yes.\nThanks."),
        (1, 3, ">> Does the new version read the old files? I have\n>> many of them.\n> Yes.\nMine too."), (1, 4, "> Thanks.\nWelcome."), (1, 5, "> said by nobody\n"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: (r.n_linked, r.reply_to, r.strand, r.place, r.body) for r in quote_links.link_quotes(df).collect()}
    assert got[1] == (1, 0, 0, 2, "Yes.") and got[2] == (1, 1, 0, 3, "Thanks.")
    assert got[3] == (2, 1, 3, 1, "Mine too.") and got[4] == (1, 2, 0, 4, "Welcome.") and got[5] == (0, 4, 0, 5, "")


def test_long_conversations(spark):
    """More turns than a block holds; the last message answers the first."""
    rows = [(7, t, "u", f"Message number {t}.") for t in range(3000)] + [(7, 3000, "u", "> Message number 0.\nBack to the start."), (7, 3001, "u", "> Message number 2999.\nOn."), (7, 3002, "u", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("role", "place")
    got = {r.turn: (r.reply_to, r.strand, r.place) for r in quote_links.link_quotes(df).collect()}
    assert got[2999] == (2998, 0, 3000) and got[3000] == (0, 3000, 1) and got[3001] == (2999, 0, 3001) and got[3002] == (3001, 0, 3002)
