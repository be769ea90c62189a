"""Lines of one to four words take part in line deduplication."""

from graphloom.llm import op3_line_dedup

FIVE = "one two three four five"


def test_short_lines_against_brute_force(spark):
    docs = [
        (1, f"All rights reserved.\nMenu\n{FIVE}\n\n  \nHome page"),
        (2, f"menu\nall  RIGHTS reserved.\nrights reserved.\n{FIVE} six\n\n{FIVE}"),
        (3, "Menu\none two three four\nhome page x\nHome Page"),
        (4, "one two three four\n \nmenu\tbar\nmenu bar"),
        (4, "one two three four\n \nmenu\tbar\nmenu bar"),
        (None, "Menu"),
    ]
    gone, before = set(), []
    for i, text in sorted({d for d in docs if d[0] is not None}):
        for no, line in enumerate(text.split("\n")):
            w = line.lower().split()
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in before):
                gone.add((i, no))
            before.append(s)
    want = [(i, t if i is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)) for i, t in docs]
    got = op3_line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {(2, 0), (2, 1), (3, 0), (3, 3), (4, 0), (4, 3)} <= gone and (2, 2) not in gone
