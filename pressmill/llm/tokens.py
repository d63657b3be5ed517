"""Tokenization of whole Arrow batches by the tokenizers library, and decoding.

Both vocabularies used here split a text by a pattern before they merge, and no match of the pattern crosses the places
where ``pieces`` cuts: before a run of ASCII white space (unless a Unicode space stands before it) and between an ASCII
letter and an ASCII mark. So the tokens of a text are the tokens of its pieces, one after another. The library encodes each
distinct piece of a block once; numpy puts the texts together.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable
from itertools import chain, repeat
from operator import contains

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from pressmill.llm.blocks import LOWER, SPACE, Block, gather

#: A worker remembers the pieces it has met while they take fewer bytes than this, each at most LONGEST bytes long; others are encoded in each
#: block. The result is the same.
REMEMBERED, LONGEST, COST = 32 << 20, 64, 160
#: The library keeps some hundred bytes for each piece that it encodes at once.
AT_ONCE = 4096
#: Pieces that are joined to one text where a vocabulary drops white space, and the character between them.
JOINED, MARK = 64, "\x01"
#: Bytes of a block: the larger, the fewer pieces are encoded again. Offsets and decoded bytes take more memory beside the ids.
BLOCK, BLOCK_IDS = 2 << 20, 4 << 20
#: Ids that are decoded at once.
DECODED = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x30] = _MARK[0x3A:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = True

#: White space beyond ASCII, as UTF-8: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


CHARACTERS = byte_characters()
BYTES = {c: b for b, c in enumerate(CHARACTERS)}


def mapped(token: bytes) -> str:
    return "".join(CHARACTERS[b] for b in token)


def unmapped(token: str) -> bytes:
    return bytes(BYTES[c] for c in token)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_tokenizer(path: str) -> str:
    """JSON of a byte-level BPE for the tokenizers library, made from a file of ranks.

    A rank file has no list of merges: any neighbours whose joined bytes have a rank may merge, lowest rank first. So every
    split of a token into two ranked parts becomes a merge, ordered by the token's rank.
    """
    ranks = read_ranks(path)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        merges += sorted(parts, key=lambda p: (ranks[p[0]], ranks[p[1]]))
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level,
        "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
                  "vocab": {mapped(t): r for t, r in ranks.items()}, "merges": [[mapped(a), mapped(b)] for a, b in merges]}})


def pieces(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start of each piece of the block (with the end of the last) and the number of the text it lies in."""
    buf, at = block.buf, block.at
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf):
        space = SPACE[buf]
        cut[1 : len(buf)] = (space[1:] & ~space[:-1]) | (_LETTER[buf[:-1]] & _MARK[buf[1:]])
        raw = buf.tobytes() if (buf >= 0xC2).any() else b""
        for wide in _WIDE if raw else ():
            k = raw.find(wide)
            while k >= 0:
                cut[k + len(wide)] = False
                k = raw.find(wide, k + 1)
    cut[at] = True
    start = np.flatnonzero(cut)
    return start, np.searchsorted(at, start[:-1], "right") - 1


class Encoder:
    """Encodes blocks. ``fold`` maps bytes that the tokenizer treats alike, so that fewer pieces are distinct. ``spaced``: the vocabulary drops
    white space, so pieces are handed over joined by a mark between spaces, which is a word and one token of its own."""

    def __init__(self, spec: str, fold: np.ndarray | None = None, spaced: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.fold = fold
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids if spaced else []
        self.mark = mark[0] if len(mark) == 1 else None
        self.known: dict[str, int] = {}
        self.held = 0
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the pieces and the number of each piece's ids."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(texts), AT_ONCE):
            some = texts[k : k + AT_ONCE]
            # A piece that holds the mark itself sends its company alone.
            if joined := self.mark is not None and not any(map(contains, some, repeat(MARK))):
                some = [f" {MARK} ".join([*some[i : i + JOINED], ""]) for i in range(0, len(some), JOINED)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
            if joined:
                at = np.flatnonzero(flat == self.mark)
                flat, size = np.delete(flat, at), np.diff(at, prepend=-1) - 1
            ids.append(flat)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _remember(self, fresh: list[str], ids: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> None:
        """Keeps short pieces until REMEMBERED bytes are taken."""
        length = np.fromiter(map(len, fresh), np.int64, len(fresh))
        cost = np.where(length <= LONGEST, 4 * length + COST, 0)
        keep = np.flatnonzero((length <= LONGEST) & (self.held + np.cumsum(cost) <= REMEMBERED))
        if not len(keep):
            return
        self.held += int(cost[keep].sum())
        self.known.update(zip((fresh[k] for k in keep), range(len(self.size), len(self.size) + len(keep)), strict=True))
        size = sizes[keep]
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids[gather(firsts[keep], size)]])

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's ids begin (with the end)."""
        start, doc = pieces(block)
        if len(start) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        folded = self.fold[block.buf] if self.fold is not None else block.buf
        column = pa.StringArray.from_buffers(len(start) - 1, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(folded))
        coded = column.dictionary_encode()
        texts, which = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        slot = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(slot < 0)
        fresh = [texts[k] for k in new]
        ids, sizes = self._encode(fresh)
        firsts = np.cumsum(sizes) - sizes
        size, first = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        old = slot >= 0
        size[old], first[old] = self.size[slot[old]], self.first[slot[old]]
        size[new], first[new] = sizes, firsts + len(self.ids)
        flat = np.concatenate([self.ids, ids])
        out = flat[gather(first[which], size[which])]
        ends = np.concatenate([[0], np.cumsum(size[which])])
        if len(fresh) and self.held < REMEMBERED:
            self._remember(fresh, ids, sizes, firsts)
        return out, ends[np.searchsorted(doc, np.arange(len(block) + 1))]


def spans(block: Block, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each id in its text, from the bytes it covers. ``size``: bytes of every id of the vocabulary.

    The character of a byte is the number of leading bytes up to it; a token that holds part of a character covers it whole.
    """
    ends = np.cumsum(size[ids])
    upto = np.cumsum((block.buf & 0xC0) != 0x80, dtype=np.int32)
    base = np.repeat(np.concatenate([[0], upto])[block.at[:-1]], np.diff(at))
    return upto[ends - size[ids]] - 1 - base, upto[ends - 1] - base


class Decoder:
    """Bytes of ids. Characters that are split over tokens come together again because bytes are joined, not characters."""

    def __init__(self, tokens: list[bytes]):
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.size, self.first, self.flat = size, np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def of(cls, spec: str) -> Decoder:
        vocab = json.loads(spec)["model"]["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            tokens[k] = unmapped(token)
        return cls(tokens)

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each text begins (with the end)."""
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        out = np.empty(ends[-1], np.uint8)
        for k in range(0, len(ids), DECODED):
            some = ids[k : k + DECODED]
            out[ends[k] : ends[k + len(some)]] = self.flat[gather(self.first[some], self.size[some])]
        return out, ends[at]


_cache: dict[str, object] = {}


def cached(key: str, make: Callable[[], object]) -> object:
    """One object per Python worker."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


def shared(spark: SparkSession, spec: str):
    """A name for a vocabulary and its broadcast value: a fixed few MB, whatever the input."""
    return f"{len(spec)}-{zlib.crc32(spec.encode())}", spark.sparkContext.broadcast(spec)


#: ASCII letters in lower case and ASCII white space as one blank, for a vocabulary that lowers and drops white space.
FOLD = np.where(SPACE, np.uint8(0x20), LOWER).astype(np.uint8)
