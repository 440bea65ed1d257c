import hashlib
import re
from collections import defaultdict

import duckdb
from helpers import docs, read
from test_near_dedup import brute
from test_tokens import BYTE, library, packed_ok

import corpus_pipeline
from plansmith.llm import license_scan, line_dedup, quality, quote_links, secret_scan
from plansmith.llm import queries as registered


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in registered.ORACLE.items():
        df = registered.QUERIES[name](spark, sf)
        got = sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
        rel = con.execute(sql)
        names = [x[0] for x in rel.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall()), name


# ---- lines ----


def test_line_dedup_edges(spark):
    long = "This line is shared by documents"
    texts = [f" {long}\nown zero", f"{long.upper()}\t\r\nx", f"a\n{long}\n{long}", None, "", "short\nshort", "short", "short", f"{long}x"]
    df = docs(spark, texts, [5, 1, 9, 3, 2, 6, 7, 8, None]).withColumnRenamed("lang", "n_lines")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[9].text == texts[2] and got[5].text == "own zero" and got[1].text == "x"
    assert (got[3].n_lines, got[3].n_dropped, got[3].text) == (1, 0, "") and got[6].text == "short\nshort"
    assert got[None].text == texts[8] and got[9].n_dropped == 0
    again = docs(spark, [long] * 4, [1, 1, 2, 3])
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(again).collect()) == [(1, ""), (1, ""), (2, ""), (3, long)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# ---- secrets ----


def spans(text):
    t, out = text or "", []
    for k, p, g, n in (("assign", secret_scan.RULES[0].pattern, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m.group(g)) >= n]
    order = ["assign", "access", "hex"]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], order.index(x[1]))))


def test_secrets(spark):
    texts = [None, "", 'é😀 Password = "abc123xyz9" token: token: abcdefghi', "AKIA" + "X" * 12 + "AKIA" + "Y" * 11, "f" * 31 + " " + "0a" * 16, "api-key=12345678 apikey:'aaaaaaaa'", "token=secret=abcdefgh12", "x" * 50000 + " secret:abcdefgh"]
    texts += texts[2:4] + ["-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36]
    df = docs(spark, texts)
    rows, ledger = secret_scan.find_secrets(df)
    got = {r.doc_id: r for r in rows.withColumn("s", secret_scan.listed(rows.secret_spans, secret_scan.BASE)).withColumn("r", secret_scan.redact(rows.text, rows.secret_spans)).collect()}
    for i, t in enumerate(texts):
        assert got[i].s == spans(t), t
    size = lambda: secret_scan.read_ledger(spark, ledger).count()
    first = len({t or "" for t in texts})
    assert size() == first
    assert "abc123xyz9" not in got[2].r and got[0].r is None and got[1].r == "" and got[3].r == "[SECRET]" and got[10].r == "[SECRET] [SECRET]"
    more = docs(spark, [texts[2], "new token=abcdefgh"])
    assert secret_scan.update_ledger(more, ledger) == ledger and size() == first + 1
    secret_scan.update_ledger(more, ledger)
    assert size() == first + 1
    secret_scan.update_ledger(more, ledger, version=2)
    assert size() == first + 3
    secret_scan.update_ledger(more.limit(0), ledger)
    assert size() == first + 3
    paths = secret_scan.join_findings(more.unionByName(df).withColumnRenamed("lang", "secret_spans"), ledger)
    assert paths.count() == len(texts) + 2 and {len(r.secret_spans) for r in paths.filter("text LIKE 'new%'").collect()} == {1}
    assert secret_scan.find_secrets(df.limit(0))[0].count() == 0


# ---- licences ----


def test_licenses(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.\n"
    )
    texts = [None, "", "no such thing. At all", "Intro\nReleased under the MIT License.", mit, "Licensed under the Apache License, Version 2.0! Mind.\nLicensed under CC BY-NC 4.0.", "x" * 40000 + "\nReleased under the MIT License"]
    df = docs(spark, texts + texts[3:4], [0, 1, 2, 3, 4, 5, 6, 3]).withColumnRenamed("lang", "licenses")
    got = {r.doc_id: (r.sentence_ids, r.n_known, r.licenses, r.n_unruled) for r in license_scan.scan_licenses(df).collect()}
    assert got[0] == got[1] == got[2] == ("", 0, "", 0)
    assert got[3] == ("<?><mit-line>", 1, "MIT", 0) and got[6][2] == "MIT"
    assert got[4][:3] == ("<mit-grant><mit-notice>", 2, "MIT-partial")
    assert got[5][2] == "Apache-2.0,CC-BY-NC-4.0"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


# ---- quotes ----


def test_quotes(spark):
    first, second = "How do I merge two tables?\nThey share a key.", "On Monday Ann wrote:\n> How do I merge two tables?\nUse a join."
    rows = [
        (1, 0, "user", first), (1, 1, "assistant", "An unrelated answer of some length."), (1, 2, "user", second), (1, 3, "user", "Fine."),
        (1, 5, "user", ">> how do i merge  two tables?\n> Use a join and more\n> An unrelated answer of some length.\nTo the first."),
        (1, 3000, "user", "> Fine. It is not long\nlate"), (2, 0, "user", None), (None, None, None, "> quoted of no one at all"), (2, 1, "a", "x"), (2, 1, "a", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("body", __import__("pyspark").sql.functions.lit(7))
    got = [(r.conv_id, r.turn, r.n_quoted, r.n_linked, r.reply_to, r.strand, r.place, r.body) for r in quote_links.link_quotes(df).collect()]
    assert (1, 2, 1, 1, 0, 2, 1, "Use a join.") in got and (1, 3, 0, 0, 2, 2, 2, "Fine.") in got
    # The first reply to the last message of the first strand goes on in it.
    assert (1, 5, 3, 2, 1, 0, 3, "To the first.") in got and (1, 3000, 1, 1, 3, 2, 3, "late") in got
    assert (2, 0, 0, 0, None, 0, 1, "") in got and (None, None, 1, 0, None, None, 1, "") in got and len(got) == 10
    assert quote_links.link_quotes(df.limit(0)).count() == 0


# ---- all stages ----


def test_pipeline_equals_brute_force(spark, sf):
    kept = {r.doc_id for r in quality.assess(read(spark, sf)).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in read(spark, sf).collect() if r.doc_id in kept}
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i
    texts = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}
    groups = brute(list(texts.items()))
    texts = {i: t for i, t in texts.items() if groups[i][2]}
    for i, t in texts.items():
        cuts = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans(t).split(",") if x))
        out, at = "", 0
        for a, b in cuts:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        texts[i] = out + t[at:]
    tok = library(BYTE)
    packed_ok(corpus_pipeline.run(spark, sf).collect(), {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()})


def test_stages_keep_columns_and_survive_nothing(spark, sf):
    df = read(spark, sf)
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == df.columns, name
        assert stage(spark, empty, sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
    assert hashlib.sha256(b"").hexdigest()
