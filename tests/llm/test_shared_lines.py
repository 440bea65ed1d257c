"""Line dedup where documents are long, and where rows share an id."""

from __future__ import annotations

from helpers import docs

from plansmith.llm.line_dedup import dedup_lines


def told(rows):
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows.collect()]


def test_many_dropped_lines_of_a_long_text(spark):
    """Every line of two documents of 20,000 lines goes; a lookup that grows with the dropped lines wouldn't end here."""
    lines = [f"a line that three documents share, number {i}" for i in range(20_000)]
    text = "\n".join(lines)
    out = sorted(told(dedup_lines(docs(spark, [text, text, text + "\nits own line"]))))
    assert [(i, n, gone, len(t)) for i, n, gone, t in out] == [(0, 20_000, 20_000, 0), (1, 20_000, 20_000, 0), (2, 20_001, 0, len(text) + 13)]


def test_places_belong_to_an_id_and_a_text(spark):
    """Rows with one id lose the same lines, wherever these stand in each; a repeated line goes everywhere."""
    a, b = "first shared line of all texts", "second shared line of all texts"
    texts = [f"x\n{a}\n{b}\n{a}", f"{b}\ny", f"x\n{a}\n{b}\n{a}", f"{a}\n{b}", f"{a}\n{b}", f"{a}\nz", None]
    out = sorted(told(dedup_lines(docs(spark, texts, [1, 1, 1, 2, 3, None, None]))), key=str)
    assert out == sorted([(1, 4, 3, "x"), (1, 2, 1, "y"), (1, 4, 3, "x"), (2, 2, 2, ""), (3, 2, 0, f"{a}\n{b}"), (None, 2, 1, "z"), (None, 1, 0, "")], key=str)
