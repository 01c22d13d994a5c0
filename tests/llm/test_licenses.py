from ledgerloom.llm import licenses

MIT, GPL = licenses.TEMPLATES[0][1], next(t for lab, t in licenses.TEMPLATES if lab == "gpl")


def scan(spark, rows, templates=licenses.TEMPLATES):
    df = spark.createDataFrame([(*x, "label", 3) for x in rows], "doc_id long, text string, labels string, score int")
    return licenses.scan(df, licenses.template_table(spark, templates))


def test_places_labels_and_spans(spark):
    words = MIT.split()
    swapped = " ".join("other" if i % 12 == 5 else w for i, w in enumerate(words))
    moved = " ".join(words[:20] + ["put", "in", "here"] + words[20:50] + words[52:])
    rows = [
        (1, "Released under the MIT License, the mit\nlicense!"), (2, f"intro words {MIT} outro"), (3, swapped), (4, moved), (5, " ".join(words[:25])), (6, f"{GPL} {MIT}".upper()),
        (7, None), (8, ""), (None, "the Apache License"), (None, None), (9, "mit licensed mitlicense license mit"), (1, "mit license"), (10, "x " * 60_000 + MIT), (2, f"intro words {MIT} outro"),
    ]
    got = {(r["doc_id"], r["n_words"]): r for r in scan(spark, rows).collect()}
    assert len(got) == len(rows) - 1 and scan(spark, rows).count() == len(rows)
    one = got[1, 8]
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["labels"]) == (2, 3, 6, "mit", "mit")
    by = {r["doc_id"]: r for r in scan(spark, [x for x in rows if x[0] not in (1, None)]).collect()}
    assert by[2]["labels"] == "mit" and by[2]["base_labels"] == "" and by[2]["score"] == 1.0
    assert by[3]["labels"] == "mit" and 0.85 < by[3]["score"] < 1
    assert by[4]["labels"] == "mit" and by[4]["score"] > 0.9
    assert by[5]["labels"] == "" and by[5]["score"] == 0.0
    assert by[6]["labels"] == "gpl,mit" and by[6]["base_labels"] == "gpl" and by[6]["n_base"] == 2
    assert by[10]["labels"] == "mit"
    assert (by[7]["n_words"], by[7]["n_base"], by[7]["first_word"], by[7]["labels"], by[7]["score"]) == (0, 0, None, "", 0.0)
    assert by[9]["n_base"] == 0


def test_empty_tables_and_short_templates(spark):
    assert scan(spark, []).count() == 0
    got = scan(spark, [(1, "mit license a b c")], [("abc", "a b c")]).first()
    assert got["labels"] == "mit" and got["score"] == 0.0
    assert scan(spark, [(1, "apache license")], ()).first()["labels"] == "apache"
