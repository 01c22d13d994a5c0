"""Packing, records and sharding against plain re-computation."""

import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing, records, sharding
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.tokens import PieceEncoder, encoder

TEXTS = [
    "plain words here", None, "", " lead and  double  blanks ", "a\n \nfoo\n  bar \n\n", "don't won't DON'T é à ça x y", "tab\tand\x1cfs \x1d gs", "x" * 5000,
    "word " * 3000, "😀 smile 😀😀 \r\n end", "1234 56,78 <|im_end|> |", "ends with blank ", "\n", "   ", "nul\0nul \0", "ΟΔΟΣ Σ İx ẞ", "cafe\u0301 a\u00a0b \u2003c", "a.b,c ..., ,x _.y 3.14 5,000 ²,x ", "'table it's'll can''t",
    " leading", "a  b", "tail\n ", "x \x0b y \x0cz", "O'Neil's, and 's.", "日本語。テキスト,です 한국어", "A.B. C,", "\u200b,a\u0301.b",
]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, "clash", 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int")


@pytest.mark.parametrize(("name", "keep"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_like_whole_texts(name, keep):
    enc, whole = PieceEncoder(tokenizer_path(name), keep), Tokenizer.from_file(tokenizer_path(name))
    texts = [t or "" for t in TEXTS]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(len(x) > 64 for x in enc)


_ANY = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,'aZsΣ\u0301\u1100\u1161\u212a\u212b\x1c\x85\u00a0\0²١<|>")), max_size=40)


@pytest.mark.parametrize(("name", "keep"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@settings(max_examples=1500, deadline=None)
@given(text=_ANY)
@example(text="Σ")
@example(text="\u1100\u1161")
@example(text="\u212a")
@example(text="\u212b")
@example(text="e \u0301")
@example(text="<|STARTOFTEXT|> <|endoftext|>A")
@example(text="A <|endoftext|>. b")
def test_any_text_encodes_as_the_library_does(name, keep, text):
    enc = encoder(tokenizer_path(name), keep)
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "keep"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_code_point_beside_marks(name, keep):
    enc = PieceEncoder(tokenizer_path(name), keep)
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [t for c in points for t in (f"{c},", f"a{c}.b", f"{c} .{c}")] + ["DİYARBAKIRLİ, क़. שּׁ,"]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        want = enc.tokenizer.encode_batch(part, add_special_tokens=False)
        bad = [t for t, x, w in zip(part, enc.encode(part), want, strict=True) if np.frombuffer(x, "<u4").tolist() != w.ids]
        assert not bad, (len(bad), bad[:20])


def test_cuts_cover_and_fill():
    for n in [1, 2, 5, 340, 341, 400, 513, 1023, 1024, 1025, 5000]:
        x = packing.cuts(n, 1024)
        assert sum(x) == n and all(1 <= p <= 1024 for p in x) and len(x) <= n // 1024 + 6


def test_pack_holds_every_id_once_with_little_padding(spark, docs):
    path = tokenizer_path("byte_bpe_50k.json")
    out = packing.pack(docs, path, with_ids=True)
    pdf = out.toPandas()
    whole = Tokenizer.from_file(path)
    for doc, group in pdf.groupby("doc_id"):
        want = whole.encode(TEXTS[doc] or "", add_special_tokens=False).ids + [0]
        copies = 2 if doc == 3 else 1
        assert group["length"].sum() == len(want) * copies
        for r in group.itertuples():
            piece = np.asarray(want[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(piece) and bytes(r.ids) == piece and r.doc_tokens == len(want)
    for _, group in pdf.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
        assert group["length"].sum() == group["sequence_tokens"].iloc[0] <= 1024
    seqs = packing.sequences(out).toPandas()
    assert len(seqs) == pdf["sequence_id"].nunique()
    assert all(len(x) == 1024 or len(x) & (len(x) - 1) == 0 for x in seqs["input_ids"])
    assert sum(map(sum, seqs["lengths"])) == pdf["length"].sum()


def test_many_pieces_over_several_workers(spark):
    lengths = [(i, 0, (i * 7919) % 1024 + 1) for i in range(6000)] + [(9999, 0, 300)] * 3000
    pieces = [(d, s, p) for d, s, n in lengths for p in packing.cuts(n, 1024)]
    out = packing.harmonic_bins(spark.createDataFrame(pieces, "doc_id long, start long, length long"), pieces_per_worker=2000).toPandas()
    assert len(out) == len(pieces)
    fill = out.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 1024
    assert fill.sum() / (1024 * len(fill)) > 0.97


def test_empty_tables(spark, docs):
    none = docs.where("doc_id < 0")
    assert packing.pack(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    manifest = records.write_records(none, tokenizer_path("word_bpe_49k.json"))
    assert records.read_records(manifest).count() == 0
    assert sharding.hilbert_shards(none, ["text", "doc_id"], 4, ["doc_id"]).count() == 0


def test_records_round_trip_in_order(spark, docs):
    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    pdf = records.read_records(records.write_records(docs, path)).toPandas().sort_values("start").reset_index(drop=True)
    assert pdf["doc_id"].is_monotonic_increasing and len(pdf) == len(TEXTS) + 1
    start = 0
    for r in pdf.itertuples():
        want = whole.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.start == start and r.n_tokens == len(want)
        start += len(want)


def test_a_damaged_record_is_found():
    rec = records.frame(b"payload") + records.frame(b"")
    assert records.unframe(rec, 0) == (b"payload", 23) and records.unframe(rec, 23) == (b"", 39)
    for i in range(23):
        with pytest.raises(ValueError):
            records.unframe(rec[:i] + bytes([rec[i] ^ 1]) + rec[i + 1 :], 0)


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims), -1).reshape(-1, dims)
        index = sharding.hilbert_index(grid, bits)
        walk = grid[np.argsort(index)]
        assert sorted(index) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards_are_even_runs_of_the_curve(spark):
    rows = [(i, None if i % 7 == 0 else f"l{i % 5}", f"src{i % 3}", float(i % 11), i) for i in range(1000)] + [(5, "l0", "src2", 5.0, 5)] * 400
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, size double, shard long")
    out = sharding.hilbert_shards(df, ["lang", "source", "size"], 40, ["doc_id"]).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == 1400 and set(counts.index) == set(range(40)) and counts.max() - counts.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    runs = out.sort_values(["shard", "slot"])["curve"]
    assert runs.is_monotonic_increasing


def test_written_shards_read_back(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "id % 7 AS size")
    out = sharding.hilbert_shards(df, ["source", "size"], 4, ["doc_id"])
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_strings_with_a_long_common_beginning_keep_apart(spark):
    rows = [(i, f"https://example.org/{i % 8}", 1.0) for i in range(800)] + [(900, None, 1.0)]
    out = sharding.with_curve(spark.createDataFrame(rows, "doc_id long, source string, size double"), ["source", "size"]).toPandas()
    assert len(out) == 801 and out["curve"].nunique() >= 8 and out.groupby("source")["curve"].nunique().max() == 1


@pytest.mark.parametrize(("name", "keep"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_met_once_leave_those_met_again(name, keep, monkeypatch):
    """Words that come once in a corpus must not push out the words that come again."""
    monkeypatch.setattr("ledgerloom.llm.tokens.CACHED_PIECES", 40)
    monkeypatch.setattr("ledgerloom.llm.tokens.CACHED_ONCE", 40, raising=False)
    enc = PieceEncoder(tokenizer_path(name), keep)
    letters = "abcdefghijklmnopqrstuvwxyz"
    enc.encode([" ".join(f"once{a}{b}" for b in letters) for a in letters])
    enc.encode(["one two three four five six seven"] * 2)
    enc.encode([" ".join(f"more{a}{b}" for b in letters) for a in letters])
    assert set(enc) >= ({" two", " three", " six"} if keep else {"two", "three", "six"})
    assert len(enc) <= 80


@pytest.mark.parametrize(("name", "keep"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_of_every_letter_and_sign(name, keep):
    enc = PieceEncoder(tokenizer_path(name), keep)
    texts = [f"w {chr(a)}{x}{chr(b)}" for a in range(33, 256) for b in range(33, 256) for x in ("", "en")] + ["été!' s ça#'s l'œil", "a<|endoftext|>b$ <|"]
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    bad = [t for t, x, w in zip(texts, enc.encode(texts), want, strict=True) if np.frombuffer(x, "<u4").tolist() != w.ids]
    assert not bad, (len(bad), bad[:20])
