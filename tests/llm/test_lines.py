import pytest

from ledgerloom.llm.lines import dedup_lines

LONG = "A line that many of the documents have in common, word for word"
BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    held: dict = {}
    for i, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append((i, doc))
    hot = {k: max((d for _, d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if not (key(x) in hot and doc is not None and doc != hot[key(x)])]
        out.append((doc, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [5, 300])
def test_against_brute_force(spark, hot):
    rows = [(i, f"own line {i}\n{LONG.upper() if i % 2 else LONG}\r\n  {LONG}\t\nshort\n\n{'ÉÀ' * 25}{'x' * (i % 2)}") for i in range(hot)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, LONG * 2000), (904, "\n".join([LONG] * 500)), (3, rows[3][1]), (3, "another text of id 3\n" + LONG), (None, LONG)]
    df = spark.createDataFrame([(d, t, "n", 1.5) for d, t in rows], "doc_id long, text string, n_lines string, h1 double")
    got = sorted((tuple(r) for r in dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
