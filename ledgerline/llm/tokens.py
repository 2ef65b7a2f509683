"""Token ids of whole texts with a public tokenizer, remembered word by word.

The vocabulary's pre-tokenizer never joins characters across a blank, so the ids of a text are the ids of its blank-free
chunks one after another. Texts repeat their words, so chunks are encoded once and remembered; chunks of Latin-1 letters,
digits and ASCII marks are put together from runs of one kind, which the pre-tokenizer separates as well.
"""

from __future__ import annotations

import os
import re

import numpy as np

from ledgerline.llm.memory import memory

#: Chunks and words a worker remembers.
CHUNKS, WORDS = 200_000, 400_000
#: Runs that the pre-tokenizer takes apart in the same way: letters, single digits, other marks. Letters beyond Latin-1 and
#: apostrophes, which start contractions, are left to the tokenizer itself.
PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+)+")
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
WIDTH = np.dtype("<u4").itemsize


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes. Made where it is used: a worker loads the vocabulary file once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        self._model = self._encoder.model
        self._letters = byte_letters()
        self._special = tuple(t.content for t in self._encoder.get_added_tokens_decoder().values())
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _word(self, run: str) -> bytes:
        """Ids of a run of one kind."""
        run = run.lower()
        known = self._words.get(run)
        if known is None:
            if len(self._words) >= WORDS:
                self._words.clear()
            spelled = run if run.isascii() else "".join(map(self._letters.__getitem__, run.encode()))
            known = self._words[run] = np.array([t.id for t in self._model.tokenize(spelled)], "<u4").tobytes()
        return known

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and not ("<|" in chunk and any(s in chunk for s in self._special)):
            return b"".join(map(self._word, RUNS.findall(chunk)))
        return np.array(self._encoder.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").split(" ")
        known = self._chunks
        out = []
        for chunk in chunks:
            try:
                out.append(known[chunk])
            except KeyError:
                if len(known) >= CHUNKS:
                    known.clear()
                out.append(known.setdefault(chunk, self._chunk(chunk)))
        return b"".join(out)


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file; what it remembers lasts from task to task."""
    held = memory("tokens")
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def word_vocabulary() -> str:
    """Path of the public vocabulary used by the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
