"""Token ids of whole texts by a public tokenizer file, with a memo of the ids of words."""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

#: Blanks other than space and line feed, blanks in a row, and the mark of a special token: texts with them are not cut.
_ODD = [*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff",
        *map(chr, range(0x2000, 0x200c)), "  ", " \n", "\n ", "\n\n", "<|"]
#: Bytes of words and ids that a worker remembers (the first words met: the common ones are among them), bytes that an entry
#: costs beside its letters and ids, and letters in the longest word remembered.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 48 << 20, 130, 40
#: Letters whose words are looked up together, and new words encoded together.
SLICE, LEARN = 1 << 20, 2048


class Encoder:
    """Ids of texts as unsigned 32-bit arrays, equal to those that the tokenizer gives the whole text.

    A byte-level tokenizer never joins a visible character and the blank after it, and a single blank before a word goes with
    the word (a space) or has an id of its own (a line feed). So in a text with single spaces and line feeds only, ids of words
    can be looked up and strung together; other texts, and those with the mark of a special token, are encoded whole.
    ``split=False`` encodes every text whole (for tokenizers that are not byte-level).
    """

    def __init__(self, path: str, split: bool = True, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer, self.split = Tokenizer.from_file(path), split
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.memo: dict[str, bytes] = {}  # ids of " word" by "word", and of "\nword" by "\nword"
        self.held, self.memo_bytes = 0, memo_bytes
        self.bytes = np.zeros(self.vocabulary, np.int64)  # of the text of an id: a letter of a byte-level token is a byte
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[k] = len(token)
        self.line = len(self._whole("\n")) * self.kind().itemsize if split else 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words, each with its blank before it: encoded as one text, whose ids are cut by their bytes."""
        step, found = self.kind().itemsize, {}
        for k in range(0, len(words), LEARN):
            some = [w if w[0] == "\n" else " " + w for w in words[k:k + LEARN]]
            ids = self._whole("".join(some))
            ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in some])
            cuts = np.searchsorted(ends, wanted) + 1
            if len(ids) != cuts[-1] or not np.array_equal(ends[cuts - 1], wanted):
                raise ValueError("this tokenizer is not byte-level: give split=False")
            data, cuts = ids.astype(self.kind).tobytes(), (cuts * step).tolist()
            found.update(zip(words[k:k + LEARN], [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        if self.held < self.memo_bytes:
            for w, ids in found.items():
                if self.held >= self.memo_bytes:
                    break
                if len(w) <= LONGEST:
                    self.memo[w] = ids
                    self.held += ENTRY_BYTES + len(w) + len(ids)
        return found

    def _looked_up(self, words: list[str]) -> list[bytes]:
        got = list(map(self.memo.get, words))
        new = [w for w, ids in zip(words, got) if ids is None]
        if new:
            found = self._learn(list(dict.fromkeys(new)))
            got = [found[w] if ids is None else ids for w, ids in zip(words, got)]
        return got

    def _long(self, text: str) -> np.ndarray:
        """Ids of a text of any length, a slice of its words at a time."""
        parts, at = [], 0
        while at < len(text):
            end = text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            words = ("\n" + text[at:end] if not at else text[at:end]).replace("\n", " \n").split(" ")
            parts.append(b"".join(self._looked_up(words[not at:])))
            at = end + 1
        return np.frombuffer(b"".join(parts)[self.line:], self.kind).astype(np.uint32)

    def _strung(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with single blanks, looked up together."""
        words = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        got = self._looked_up([w for part in words for w in part])
        out, at = [], 0
        for part in words:
            out.append(np.frombuffer(b"".join(got[at:at + len(part)])[self.line:], self.kind).astype(np.uint32))
            at += len(part)
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif not self.split or t[0] in " \n" or t[-1] in " \n" or any(map(t.__contains__, _ODD)):
                out[i] = self._whole(t)  # one at a time: such texts can be long
            elif len(t) > SLICE:
                out[i] = self._long(t)
            else:
                held.append(i)
                size += len(t)
            if held and (size > SLICE or i == len(texts) - 1):
                for k, ids in zip(held, self._strung([texts[k] for k in held])):
                    out[k] = ids
                held, size = [], 0
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, split: bool = True, memo_bytes: int = MEMO_BYTES) -> Encoder:
    """The encoder of this Python worker; its memo is kept from task to task, as far as ``memo_bytes`` goes."""
    if (path, split) not in _encoders or _encoders[path, split].held > 2 * memo_bytes:
        _encoders[path, split] = Encoder(path, split, memo_bytes)
    found = _encoders[path, split]
    found.memo_bytes = memo_bytes
    return found


def public_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
