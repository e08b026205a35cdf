"""Token ids of whole texts by a public tokenizer file, a batch at a time.

A tokenizer that drops white space and never merges across it gives a text the ids of its white-space-separated words
in turn, so each distinct word of a batch is encoded once. Words of Latin letters, with closing ASCII marks, go straight
to the tokenizer's merge model: the normaliser and the splitting pattern leave those as they are, in lower case. All
other words go through the whole tokenizer. tests/llm holds this against encoding whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a Python worker; beyond them it starts afresh.
CACHE_WORDS = 1_200_000
PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-Þß-öø-ÿ]+)([.,!*|&%$#;:?]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level merges: itself where printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordEncoder:
    """Ids of words and texts for one tokenizer file of the kind told above (checked on opening)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probe = "Été naïve, the   Cat's\n\tx1."
        if self.ids(probe) != [i for w in probe.split() for i in self.ids(w)]:
            raise ValueError("this tokenizer does not drop white space: its words can't be encoded one by one")
        self.plain = all(self._plain(*PLAIN.fullmatch(w).groups()) == self.ids(w) for w in ("Été,", "naïve", "the", "Cat.", "x!!", "ÿß|"))

    def _piece(self, piece: str) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            got = self.cache[piece] = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        return got

    def _plain(self, letters: str, marks: str) -> list[int]:
        return array("I", self._piece(letters.lower()) + (self._piece(marks) if marks else b"")).tolist()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as native 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, out, rest = self.cache, [], []
        for i, w in enumerate(words):
            m = PLAIN.fullmatch(w) if self.plain else None
            if m:
                a, b = m.groups()
                a = a.lower()
                got = cache.get(a) or self._piece(a)
                out.append(got + (cache.get(b) or self._piece(b)) if b else got)
            else:
                out.append(b"")
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def texts(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each closed by ``end_id``, and how many each text has. Null is empty."""
        n = len(column)
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        parts = self.words(coded.dictionary.to_pylist())
        parts.append(array("I", [end_id]).tobytes())
        bank = np.frombuffer(b"".join(parts), np.uint32)
        length = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
        place = np.cumsum(length) - length
        ends = np.cumsum(sizes)
        which = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(parts) - 1)
        take = length[which]
        stop = np.cumsum(take)
        ids = bank[np.arange(stop[-1] if len(stop) else 0) + np.repeat(place[which] - (stop - take), take)]
        close = ends + np.arange(n)  # where each text's end id stands among the words
        count = np.diff(np.concatenate([[0], stop[close]])) if n else np.zeros(0, np.int64)
        return ids, count


_open: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for ``path``."""
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]
