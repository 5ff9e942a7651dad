"""Encoding by shared chunks and decoding, against the tokenizer library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenspark.llm.bpe import ChunkEncoder, cuts, decoded, encoded, token_bytes
from lumenspark.llm.op4 import tokenizer_path
from lumenspark.llm.op11 import op11_bpe_encoding
from lumenspark.llm.transducer import Encoder
from tests.llm.test_tokens import HARD

SF = "/root/testdata/sf0.001"
#: Cuts so close that most words and contractions have one inside.
TINY = {"window": 2, "bits": 1, "least": 1, "most": 3}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def same(machine: ChunkEncoder, library: Tokenizer, texts: list[str]) -> None:
    for text, ids, e in zip(texts, machine.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids, text[:80]


@pytest.mark.parametrize("sizes", [{}, TINY, {"window": 4, "bits": 3, "least": 4, "most": 40}])
def test_ids_are_those_of_the_library(library, sizes):
    rng = random.Random(5)
    drawn = ["".join(rng.choices(" '\n\tsterdvlmLé9!.é 😀中", k=rng.randint(0, 600))) for _ in range(300)]
    words = [" ".join(rng.choices(["don't", "we'll", "  ", "été", "\n\n", "x" * 50, "<|endoftext|>", "12,5", "…"], k=200)) for _ in range(40)]
    long = ["ab" * 9000, " " * 5000 + "x" + "\n" * 5000, "中" * 4000, "'" * 3000 + "s", "<|endoftext|>" * 400, "é" * 5000 + " " + "z" * 9000 + " ok"]
    machine = ChunkEncoder(Encoder(tokenizer_path()), **sizes)
    same(machine, library, HARD + drawn + words + long)
    same(machine, library, HARD + drawn[::-1])  # with chunks that are kept


def test_chunks_of_a_shared_passage_are_encoded_once(library):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(3000))
    texts = [" ".join(word() for _ in range(rng.randint(5, 60))) + " " + passage + " " + word() for _ in range(30)]
    machine = ChunkEncoder(Encoder(tokenizer_path()))
    same(machine, library, texts)
    distinct = len(machine.kept)
    assert distinct < machine.met / 8 and machine.joined < machine.met / 50


def test_cuts_follow_the_content_and_keep_characters_whole():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdeé中 ", k=20_000))
    data = np.frombuffer(text.encode(), np.uint8)
    edges = cuts(data)
    assert edges[0] == 0 and edges[-1] == len(data) and (np.diff(edges) > 0).all() and np.diff(edges).max() <= 4100
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        data[a:b].tobytes().decode()
    moved = cuts(np.frombuffer(b"seven b" + text.encode(), np.uint8)) - 7
    assert len(set(moved.tolist()) & set(edges.tolist())) > 0.9 * len(edges)
    assert cuts(np.frombuffer(b"a" * 10_000, np.uint8)).tolist() == [0, 4096, 8192, 10_000]


def test_decoding_any_ids_as_the_library(library, spark):
    rng = random.Random(4)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(0, 60))] for _ in range(300)] + [[50_256, 50_256], [], [60_000, 5, -1]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in decoded(frame, tokenizer_path()).collect()}
    for i, x in enumerate(lists):
        assert got[i] == library.decode([k for k in x if k >= 0], skip_special_tokens=False)
    assert len(token_bytes(tokenizer_path())) == 50_257


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "it's so", None), (2, "word " * 30_000, "z"), (2, "word " * 30_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decoded(encoded(frame, tokenizer_path()), tokenizer_path()).collect()
    assert sorted((str(r.doc_id), len(r.ids), r.text) for r in out) == sorted((str(i), n, t or "") for (i, t, _), n in zip(rows, (0, 0, 3, 30_001, 30_001), strict=True))
    assert encoded(frame.limit(0), tokenizer_path()).count() == 0


def test_query(spark, library):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in op11_bpe_encoding(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id] == (d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
