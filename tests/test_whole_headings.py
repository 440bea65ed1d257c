from collections import Counter

from plansmith import catalog


def test_headings_that_begin_alike(spark, tmp_path):
    texts = ["Introduction to one\na\nb\nIntroduction to two\nccc", "x\n\ny\nx\nz", "", "only"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines, chars = Counter(), Counter()
    for i, t in enumerate(texts):
        split = t.split("\n")
        for j, line in enumerate(split):
            lines[i, split[j - j % 3]] += 1
            chars[i, split[j - j % 3]] += len(line)
    got = {(r.doc_id, r.section): (r.lines, r.chars) for r in catalog.card_line_sections(spark, str(tmp_path)).collect()}
    assert got == {k: (n, chars[k]) for k, n in lines.items()} and (0, "Introduction to two") in got
