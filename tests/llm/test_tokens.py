"""Token counts against the tokenizer library, and the defined edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenspark.llm.op4 import tokenizer_path
from lumenspark.llm.textbytes import ragged
from lumenspark.llm.tokens import token_counts
from lumenspark.llm.transducer import Encoder, between_pretokens

HARD = ["", " ", "  ", "\n", "a", "'", "'s", "''s", " 's", "\n's", "it's we're 'r", "'r", "'rx 'll 'l", "x'l'l", "don't!'s", "a  b", "a \nb", "a\n b", "  \n\n a", "tail  ", "\u00a0a", "a\u00a0\u00a0b", "é'd 12'd", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "😀 '😀's", "\x1c\x1f a", "١٢ ²³ x²", "'ve'Ve'vE", "a'" + "r" * 40, "\U000fffff\U0010ffff"]


def _expected(texts):
    return [len(e.ids) for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_counts_match_the_library_on_hard_texts():
    rng = random.Random(1)
    drawn = ["".join(rng.choices(" '\n\tsterdvlmLé9!.é\u00a0", k=rng.randint(0, 400))) for _ in range(400)]
    texts = HARD + drawn
    machine = Encoder(tokenizer_path())
    assert machine.counts(texts).tolist() == _expected(texts)
    ids, at = machine.encode(texts)
    library = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    for i, e in enumerate(library):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_rows(spark):
    rows = [(1, None, "x"), (1, "a b", "y"), (None, "a b", None), (2, "word " * 3000, "z"), (2, "word " * 3000, "z")]
    out = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), tokenizer_path())
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, 0, False), (1, 3, 2, False), (None, 3, 2, False), (2, 15000, 3001, True), (2, 15000, 3001, True)], key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, tokenizer_path()).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert [got[r.doc_id] for r in rows] == _expected([r.text for r in rows])


def thue_morse(n: int, a: str, b: str) -> str:
    """Words that defeat polynomial hashes modulo a power of two."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_polynomials_modulo_powers_of_two():
    texts = [thue_morse(n, *pair) for n in (1024, 2048, 4096, 8192) for pair in ("tq", "qt", "oz", "zo")]
    machine = Encoder(tokenizer_path())
    assert machine.counts(texts).tolist() == _expected(texts)
    ids, at = machine.encode(texts[::-1])
    for i, e in enumerate(Tokenizer.from_file(tokenizer_path()).encode_batch(texts[::-1], add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_long_texts_are_cut_between_pretokens():
    rng = random.Random(5)
    texts = ["".join(rng.choices(" '\n\tstrdvlLé9! ", k=3000)) for _ in range(20)] + ["x" * 500 + " y" * 200, " " * 700 + "a", "'r" * 300]
    machine = Encoder(tokenizer_path())
    for text in texts:
        parts = list(between_pretokens(text, 100))
        assert "".join(parts) == text and sum(machine.counts(parts).tolist()) == _expected([text])[0]


def test_long_texts_and_many_states(monkeypatch):
    from lumenspark.llm import transducer

    monkeypatch.setattr(transducer, "_PIECE", 200)
    monkeypatch.setattr(transducer, "_MOST_BYTES", 3000)
    rng = random.Random(6)
    texts = ["".join(rng.choices(" 'abcdefgh\n9", k=rng.choice([10, 2000]))) + rng.choice(["", "<|endoftext|>"]) for _ in range(60)]
    machine = transducer.Encoder(tokenizer_path())
    assert [machine.counts(texts[i : i + 7]).tolist() for i in range(0, 60, 7)] == [_expected(texts[i : i + 7]) for i in range(0, 60, 7)]


def test_other_rules_are_refused():
    with pytest.raises(ValueError, match="only byte-level BPE"):
        Encoder(tokenizer_path("word_bpe_49k.json"))


def test_every_code_point_in_several_contexts_as_the_library():
    machine, library = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 60_000):
        texts = ["a{0}b {0}1 {0}'s{0}  {0} \n{0}".format(chr(i)) for i in points[at : at + 60_000]]
        ids, ends = machine.encode(texts)
        wrong = [hex(points[at + k]) for k, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)) if e.ids != ids[ends[k] : ends[k + 1]].tolist()]
        assert not wrong
