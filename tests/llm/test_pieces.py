import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from seqweft.llm.pieces import encode_checked, encode_decode, ids_array, model
from seqweft.llm.token_queries import model_path, sentencepiece_round_trip
from tests.llm.helpers import docs

spm = pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=model_path())


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_ids_and_texts_equal_the_library(library):
    pieces, rng = model(model_path()), random.Random(1)
    letters = list("abcthe  ▁▁\n\t.,é漢字̀😀0123456789<>/s\x00​")
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 5, 40)))) for _ in range(5000)]
    texts += ["", " ", "   a", " " * 40, "a" + " " * 33 + "b", "<s>", "</s>", "<0x0A>", "▁▁a", "\n a", "the" * 5000, "Ünï çödé 漢字"]
    for text in texts:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = pieces.encode(text)
        assert unpacked(got) == want, text
        assert pieces.decode(got) == library.decode(want), text


def test_cache_generations_do_not_change_ids(library, monkeypatch):
    import seqweft.llm.pieces as module

    monkeypatch.setattr(module, "CACHED", 5)
    pieces, rng = module.Pieces(model_path()), random.Random(2)
    for _ in range(100):
        text = " ".join("".join(rng.choice("thaneros") for _ in range(6)) for _ in range(12))
        assert unpacked(pieces.encode(text)) == library.encode(text, add_bos=True, add_eos=True)


def plainly_merged(scores, text):
    parts = list(text)
    while True:
        pairs = [(scores[x + y], -k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in scores]
        if not pairs:
            return parts
        k = -max(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pairs_are_stable_where_plain_merging_keeps_them():
    pieces, rng, seen = model(model_path()), random.Random(5), set()
    tokens = sorted(pieces.packed_ids)
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.5:
            k = rng.randrange(1, len(a + b))
            a, b = (a + b)[:k], (a + b)[k:]
        want = plainly_merged(pieces.scores, a + b) == [a, b]
        assert pieces.stable_pair(a, b) == want, (a, b)
        seen.add(want)
    assert seen == {True, False}


def test_new_segments_take_few_score_lookups(monkeypatch):
    looked = 0

    class Counted(dict):
        def get(self, *args):
            nonlocal looked
            looked += 1
            return super().get(*args)

    pieces, rng = model(model_path()), random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(12)) for _ in range(3000)]
    pieces.forget()
    monkeypatch.setattr(pieces, "scores", Counted(pieces.scores))
    pieces.encode(" ".join(words))
    pieces.forget()
    assert looked < 3 * sum(map(len, words))


def test_texts_cut_in_slices_have_the_same_ids(library, monkeypatch):
    import seqweft.llm.pieces as module

    pieces, rng = model(model_path()), random.Random(3)
    for size in (1, 2, 3, 7, 20):
        monkeypatch.setattr(module, "SLICE", size)
        for _ in range(300):
            text = "".join(rng.choice("abthe  ▁\n.é漢😀0") for _ in range(rng.randrange(60)))
            assert unpacked(pieces.encode(text)) == library.encode(text, add_bos=True, add_eos=True), (size, text)


def test_table_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(None, None, "a", None), (1, "", "b", None), (2, "two words", "c", None), (2, "two words", "c", None), (3, "no" * 60_000, None, None)]
    df = docs(spark, rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = encode_decode(df, model_path()).withColumn("a", ids_array(F.col("ids"))).collect()
    for r in got:
        assert r.a == unpacked(r.ids) == library.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == (r.text or "")
    assert encode_decode(df.limit(0), model_path()).count() == 0 and len(got) == 5


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the given tables")
def test_query_equals_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in sentencepiece_round_trip(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got[r.doc_id] == want


def test_checked_ids_are_the_same(spark):
    texts = [None, "", "plain words", "  two  spaces\n", "日本 naïve ▁ mark", "a" * 3000]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    plain = {r.doc_id: r for r in encode_decode(df, model_path()).collect()}
    for r in encode_checked(df, model_path()).collect():
        assert r.ids == plain[r.doc_id].ids and r.exact == (plain[r.doc_id].decoded == (texts[r.doc_id] or ""))
