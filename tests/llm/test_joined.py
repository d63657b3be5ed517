"""Pieces of texts go to the tokenizers library joined, and the ids are those of whole texts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from pressmill.llm import tokens as tk
from pressmill.llm.blocks import blocks


def test_joined_pieces_give_the_ids_of_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    rng = random.Random(3)
    parts = ["A", "word", "Été", "é", "́x", "'s", "it's", " ", "\n\t ", " ", "　", "(a,b)", "x1y22", "\x01", "\x01\x01", "a\x01b", "\x02", "<|endoftext|>", "漢字", "ΟΔΟΣ", "😀", "ﬁ", "-", "‍"]
    texts = ["", None, "\x01", " \x01 ", "plain words only"] + ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(300)]
    texts += [" ".join(f"{rng.choice('abcdefgh')}{k}zq" for k in range(9000))]
    encoder, sent = tk.Encoder(spec, fold=tk.FOLD, spaced=True), []
    library = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, some, **how):
            sent.append(len(some))
            return library.encode_batch_fast(some, **how)

    encoder.tokenizer = Counting()
    got, pieces = [], 0
    for block in blocks(pa.array(texts, pa.string())):
        ids, at = encoder(block)
        pieces += len(set(tk.pieces(block)[0]))
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sum(sent) < pieces / 2
    again = [encoder(b)[0] for b in blocks(pa.array(texts, pa.string()))]
    assert np.concatenate(again).tolist() == [i for g in got for i in g]
