import duckdb
from helpers import docs

from plansmith.llm import secret_scan

BODY = "\n".join(f"MIIEv{i:02}" + "Ab+/" * 14 for i in range(25)) + "\nQw=="
KEY = f"-----BEGIN RSA PRIVATE KEY-----\n{BODY}\n-----END RSA PRIVATE KEY-----"
LOCKED = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{BODY}\n-----END RSA PRIVATE KEY-----"
OPEN = f"-----BEGIN PRIVATE KEY-----\n{BODY}\n"
TEXTS = [
    (f"a\n{KEY}\nb", "a\n[SECRET]\nb"), (f"a\n{LOCKED}\nb", "a\n[SECRET]\nb"), (f"a\n{OPEN}Then some prose.", "a\n[SECRET]Then some prose."), (OPEN.rstrip(), "[SECRET]"),
    (f"{OPEN}Prose.\n{KEY} {KEY}", "[SECRET]Prose.\n[SECRET] [SECRET]"), ("-----BEGIN PRIVATE KEY----- is a header - no more.\nThanks\n", "[SECRET] is a header - no more.\nThanks\n"),
    (f"a\r\n{KEY}\r\nb".replace("\n", "\r\n").replace("\r\r", "\r"), "a\r\n[SECRET]\r\nb"), ("-----BEGIN PRIVATE KEY-----\n" + f"{'x' * 64}\n" * 20_000, "[SECRET]"),
]


def test_keys_go_whole(spark):
    rows, _ = secret_scan.find_secrets(docs(spark, [t for t, _ in TEXTS]))
    got = {r.doc_id: r.out for r in rows.withColumn("out", secret_scan.redact(rows.text, rows.secret_spans)).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [want for _, want in TEXTS]


def test_sql_finds_the_same_keys(spark):
    df = docs(spark, [t for t, _ in TEXTS])
    rows, _ = secret_scan.find_secrets(df)
    got = {r.doc_id: r.spans for r in rows.withColumn("spans", secret_scan.listed(rows.secret_spans)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(TEXTS)])
    assert {r[0]: r[1] for r in con.execute(f"SELECT doc_id, spans FROM ({secret_scan.ORACLE_SQL})").fetchall()} == got
