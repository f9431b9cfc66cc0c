"""Token ids of whole texts, by a tokenizer that works within white space.

For a tokenizer whose tokens never cross white space (and which drops it), a text's ids are those of its chunks between
ASCII white space, one after another. Arrow splits a batch of texts and finds its distinct chunks; only these are looked
up, and their ids are gathered for all places at once. Each process keeps the ids of a bounded number of chunks, those
met lately; the rest are encoded. Results are the tokenizer's own, never an approximation.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a process keeps, twice at most; and bytes of text that are split at once (a longer text is split alone).
CACHE_CHUNKS = 200_000
GROUP_BYTES = 4 << 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"([{_LETTERS}]+)([.,]?)")


class ChunkTokenizer:
    """Ids as little-endian bytes, two for each id if the vocabulary allows, else four."""

    _open: dict[str, ChunkTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = self._letters()
        self.stops = {c: self._bytes(self.tokenizer.encode(c, add_special_tokens=False).ids) if c else b"" for c in ("", ".", ",")}
        if self.letters:  # words may go to the model directly only if that changes no ids here
            probe = ["AbC", "word.", "Word,", "ÉTÉ.", "Straße", "çaÇA,", "Ÿ", "x" * 40]
            if any(self._word(m) != self._bytes(self.tokenizer.encode(m[0], add_special_tokens=False).ids) for m in map(_WORD.fullmatch, probe) if m):
                self.letters = {}
        #: A special token that parts many chunks in one call: its id occurs nowhere else.
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark = next(((i, t.content) for i, t in sorted(added.items()) if t.special and not (t.normalized or t.lstrip or t.rstrip)), None)

    def _letters(self) -> dict[int, str]:
        """What the tokenizer's normalizer and pre-tokenizer make of each letter; none if they may not go letter by letter."""
        t, out = self.tokenizer, {}
        if not t.normalizer or not t.pre_tokenizer:
            return {}
        every = [chr(i) for i in range(256) if re.fullmatch(f"[{_LETTERS}]", chr(i))]
        for c in every:
            pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(c))
            if len(pieces) != 1:
                return {}
            out[ord(c)] = pieces[0][0]
        # all letters in one word: one piece, made of the same parts
        for word in ("".join(every), "".join(reversed(every))):
            pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))
            if [p for p, _ in pieces] != [word.translate(out)]:
                return {}
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, m: re.Match) -> bytes:
        """Ids of a word of letters and a stop or comma, which is a piece of its own."""
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(m[1].translate(self.letters))]) + self.stops[m[2]]

    def _encode_new(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids: words by the model, other chunks by the whole tokenizer."""
        out: list[bytes] = [b""] * len(chunks)
        rest = []
        by_word: dict[str, bytes] = {}
        model, itemsize = self.tokenizer.model, self.dtype.itemsize
        for i, c in enumerate(chunks):
            m = _WORD.fullmatch(c) if self.letters else None
            if m is None:
                if c:
                    rest.append(i)
                continue
            word = m[1].translate(self.letters)
            ids = by_word.get(word)
            if ids is None:
                ids = by_word[word] = b"".join([t.id.to_bytes(itemsize, "little") for t in model.tokenize(word)])
            out[i] = ids + self.stops[m[2]]
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            for i, ids in zip(part, self._encode_joined([chunks[i] for i in part])):
                out[i] = ids
        return out

    def _encode_joined(self, part: list[str]) -> list[bytes]:
        """Chunks that hold no special token are run together, parted by one."""
        if self.mark is None or any("<|" in c for c in part):
            return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode(self.mark[1].join(part), add_special_tokens=False).ids, self.dtype)
        cut = np.flatnonzero(ids == self.mark[0])
        assert len(cut) == len(part) - 1
        return [x.tobytes() for x in np.split(np.delete(ids, cut), cut - np.arange(len(cut)))]

    @classmethod
    def at(cls, path: str) -> ChunkTokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. When the kept ones are too many, those not met since the last such time go."""
        if len(self.known) > CACHE_CHUNKS:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for c in chunks:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    new.append(c)
        known.update(zip(new, self._encode_new(new)))
        return [known[c] for c in chunks]

    def _encode_group(self, texts: pa.Array, end: bytes) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        at = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        code = words.indices.to_numpy()
        ids = self._ids(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        first, n = (np.cumsum(size) - size)[code], size[code]
        stop = np.concatenate(([0], np.cumsum(n)))
        whole = flat[np.repeat(first - stop[:-1], n) + np.arange(stop[-1])]
        cut = stop[at - at[0]].tolist()
        return [whole[a:b].tobytes() + end for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str | None] | pa.Array, end_id: int | None = None) -> list[bytes]:
        end = b"" if end_id is None else self._bytes([end_id])
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        group = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)] if len(column) else []
        return [x for lo, hi in zip(cuts, cuts[1:]) for x in self._encode_group(column.slice(lo, hi - lo), end)]


def word_tokenizer() -> str:
    """The public word-level BPE vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
