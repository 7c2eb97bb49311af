"""Exact token ids and spans by public tokenizers, with a bounded memo of chunks.

A text is cut at places that no token of the tokenizer can cross; the ids of a chunk are the same wherever it stands.
Chunks met before come from the memo, the others go to the tokenizer in one batch.

Why the cuts are exact. WordEncoder: its tokenizer splits at white space before it merges, and white space composes with nothing when text is
normalised, so what stands between two blanks is encoded alone in the whole text as well. SpanEncoder: its tokenizer splits text into words, numbers,
signs and runs of white space before it merges; a single blank before other text belongs to the piece that follows it, a single line feed between
other text is a piece of its own, and no piece goes beyond them. Runs of white space, blanks at the ends and other white space split by what follows,
so texts with these are encoded whole. A test compares both with whole encodings of hostile texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np

#: Where the vocabulary files are; an operator's `vocab` is one of their names or a path of its own.
VOCAB_DIR = os.environ.get("PROSEMILL_TOKENIZERS", "/opt/tokenizers")
MEMO, MEMO_LENGTH, TOGETHER = 600_000, 48, 100_000


def vocab_path(vocab: str) -> str:
    if os.path.isabs(vocab):
        return vocab
    at = os.path.join(VOCAB_DIR, vocab)
    if os.path.exists(at):
        return at
    import public_tokenizers

    return public_tokenizers.path(vocab)


def load(vocab: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab_path(vocab))


class Memo:
    """chunk -> bytes; two generations, so that it never holds more than 2 * MEMO chunks.

    make must not refer to the memo's owner: in a circle both outlive their task until the garbage collector comes, and a worker holds the memos of several tasks."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def of(self, chunks: list[str]) -> list[bytes]:
        new, old = self.new, self.old
        out = list(map(new.get, chunks))
        gaps = [i for i, v in enumerate(out) if v is None]
        if gaps:
            missing = dict.fromkeys(chunks[i] for i in gaps)
            unknown = [c for c in missing if c not in old]
            for c in missing:
                if c in old:
                    missing[c] = old[c]
            if unknown:
                missing.update(zip(unknown, self.make(unknown)))
            for i in gaps:
                out[i] = missing[chunks[i]]
            new.update(missing if max(map(len, missing)) <= MEMO_LENGTH else {c: v for c, v in missing.items() if len(c) <= MEMO_LENGTH})
            if len(new) > MEMO:
                self.old, self.new = new, {}
        return out

    def of_many(self, lists: list[list[str]]) -> Iterator[list[bytes]]:
        """of() for each list, the chunks of several looked up at once."""
        at = 0
        while at < len(lists):
            end, size = at, 0
            while end < len(lists) and (end == at or size + len(lists[end]) <= TOGETHER):
                size += len(lists[end])
                end += 1
            out, i = self.of(list(chain.from_iterable(lists[at:end]))), 0
            for x in lists[at:end]:
                yield out[i : i + len(x)]
                i += len(x)
            at = end


def word_merges(tokenizer):
    """A faster routine for the same merges, for a byte-level vocabulary with word ends: bytes of a word -> ids; None if the vocabulary isn't of that kind.

    The end of a word is a byte of its own, 0xFF, which no text has; joining it to the last byte comes first, as its ranks are below all merges."""
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    vocab, merges = model.get("vocab"), model.get("merges")
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or any(vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) != 512 + k for k, m in enumerate(merges)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): i for t, i in vocab.items() if i < 512 + len(merges)}
    return tiktoken.Encoding("words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordEncoder:
    """Ids of a tokenizer that drops white space: cut at every blank and line feed. dtype: of the ids."""

    #: Chunks that normalising leaves as they are but for case, and that split into letters and signs.
    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:|()\"-]*)")

    def __init__(self, vocab: str):
        self.tokenizer = load(vocab)
        self.merges = word_merges(self.tokenizer)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = Memo(partial(self._encode, self.tokenizer, self.merges, self.dtype.char))

    @classmethod
    def _encode(cls, tokenizer, merges, code: str, chunks: list[str]) -> list[bytes]:
        out, rest = {}, []
        for c in chunks:
            m = merges and cls.SIMPLE.fullmatch(c)
            if m:
                word, signs = m.groups()
                ids = merges(word.lower().encode() + b"\xff") if word else []
                out[c] = array(code, ids + merges(signs.encode() + b"\xff") if signs else ids).tobytes()
            else:
                rest.append(c)
        if rest:
            out.update((c, array(code, e.ids).tobytes()) for c, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return [out[c] for c in chunks]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [b"".join(x) for x in self.memo.of_many([t.replace("\n", " ").split(" ") for t in texts])]


class SpanEncoder:
    """Token spans (start, end in code points) of a byte-level tokenizer: cut before single blanks and around single line feeds.

    Texts with other white space or runs of it are encoded whole."""

    CHUNK = re.compile(r" ?[^ \n]+|\n")
    ODD = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]$")

    def __init__(self, vocab: str):
        self.tokenizer = tokenizer = load(vocab)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memo = Memo(lambda chunks: [np.array(e.offsets, "<u4").tobytes() for e in tokenizer.encode_batch(chunks, add_special_tokens=False)])

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        odd = [bool(self.ODD.search(t)) for t in texts]
        lists = [[] if x else self.CHUNK.findall(t) for t, x in zip(texts, odd)]
        return [self._whole(t) if x else self._tiled(c, got) for t, x, c, got in zip(texts, odd, lists, self.memo.of_many(lists))]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    @staticmethod
    def _tiled(chunks: list[str], got: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        counts = np.fromiter(map(len, got), np.int64, len(got)) >> 3
        spans = np.frombuffer(b"".join(got), "<u4").reshape(-1, 2).astype(np.int64)
        return spans + np.repeat(np.cumsum(lengths) - lengths, counts)[:, None]
