"""Whole texts to token ids, with each distinct piece between white space encoded once per slice of texts.

A byte-level BPE never merges across the boundaries of its pre-tokenizer. A boundary stands before every single
space and every single line feed that has no white space beside it, so texts are cut there, and the tokenizers library
encodes the distinct pieces of a slice, many in a call. Texts with other white space, or with the string of a special
token, go to the library whole. Nothing is kept between slices, so memory is bounded by a slice or a single long text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of texts that are encoded together; pieces of one string for the library, and strings of a call.
SLICE_ROWS, SLICE_BYTES, JOINED, CALL = 1 << 16, 1 << 23, 1024, 16
#: Marks that stand behind words, and fixed values: bytes that are white space to some tokenizer or to Python, and such sequences of two and three bytes in UTF-8.
MARKS = ".,;:!?#$%&*"
WHITE = bytes([*range(9, 14), *range(28, 33)])
WHITE_2 = {0xC285, 0xC2A0}
WHITE_3 = {0xE19A80, *range(0xE28080, 0xE2808C), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, 0xEFBBBF}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _text(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of strings."""
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _ends(pieces: pa.StringArray) -> np.ndarray:
    return _text(pieces)[0][1:].astype(np.int64)


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that start there and are so long, one after another."""
    ends = np.cumsum(lengths)
    kind = np.int32 if len(values) + (ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
    places = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    places += np.arange(len(places), dtype=kind)
    return values[places]


def _irregular(pieces: pa.StringArray, inner: bool) -> np.ndarray:
    """Which pieces hold white space, or, if not the first of a text, are nothing besides; a line feed may stand before an inner one."""
    offsets, text = _text(pieces)
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    at = np.flatnonzero(white[text])
    wide = np.flatnonzero(text >= 0xC2)
    code = np.concatenate([text, np.zeros(2, np.uint8)]).astype(np.int64)
    two = code[wide] << 8 | code[wide + 1]
    at = np.concatenate([at, wide[np.isin(two, list(WHITE_2)) | np.isin(two << 8 | code[wide + 2], list(WHITE_3))]])
    sizes = np.diff(offsets)
    owner = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(pieces), bool)
    if inner:
        out |= sizes == 0
        ok = (offsets[owner] == at) & (text[at] == 10) & (sizes[owner] > 1)
        owner = owner[~ok]
    out[owner] = True
    return out


class Encoder:
    """Texts to ids as little-endian bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the cuts hold for byte-level pre-tokenizers without a normalizer
        self.cuts = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        # ids that begin with a space or a line feed, as byte-level vocabularies write them
        self.begins = np.zeros(self.size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.begins[i] = piece[:1] in ("Ġ", "Ċ")

    def _batches(self, texts: list[str]):
        for at in range(0, len(texts), CALL):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False):
                yield np.array(e.ids, self.dtype)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, each behind the white space that precedes it, and how many each has. Marks behind a letter are a
        pre-token of their own, so words that differ in them only are encoded once."""
        stems = pc.ascii_rtrim(pieces, MARKS)
        ends, bare, (_, text) = _ends(pieces), _ends(stems), _text(stems)
        text = np.concatenate([text, np.zeros(1, np.uint8)])
        last, before = text[np.maximum(bare, 1) - 1], text[np.maximum(bare, 2) - 2]
        letter = (last | 32 >= 97) & (last | 32 <= 122) | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        sizes = np.diff(ends, prepend=0)
        letter &= np.diff(bare, prepend=0) > 1
        kept = np.where(letter, np.diff(bare, prepend=0), sizes)
        # marks: what is left of each piece, by its place in the pieces' bytes
        stems = pc.if_else(pa.array(letter), stems, pieces).dictionary_encode()
        tails = pa.Array.from_buffers(pa.string(), len(pieces), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes - kept)]).astype(np.int32)), pa.py_buffer(_gather(_text(pieces)[1], ends - sizes + kept, sizes - kept))]).dictionary_encode()
        coded = ((self._stems(stems.dictionary), stems.indices.to_numpy()), (self._heads(tails.dictionary), tails.indices.to_numpy()))
        flat = np.concatenate([x for (x, _), _ in coded])
        starts, lengths = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        for k, ((_, n), index) in enumerate(coded):
            starts[:, k], lengths[:, k] = (np.cumsum(n) - n)[index] + k * len(coded[0][0][0]), n[index]
        return _gather(flat, starts.ravel(), lengths.ravel()), lengths.sum(1)

    def _stems(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(" ", pieces, "")).to_pylist()
        found, lengths = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for k, ids in enumerate(self._batches(["".join(texts[at : at + JOINED]) for at in range(0, len(texts), JOINED)])):
            own = texts[k * JOINED : (k + 1) * JOINED]
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(own) or starts[0]:
                parts = list(self._batches(own))
                ids, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
            found.append(ids)
            lengths.append(np.diff(starts, append=len(ids)))
        return np.concatenate(found), np.concatenate(lengths)

    def _heads(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that begin a text."""
        found = list(self._batches(pieces.to_pylist()))
        return np.concatenate([np.zeros(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, little-endian, without special tokens added; null counts as empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        alone = np.full(len(texts), not self.cuts)
        for s in self.special:
            alone |= _mask(pc.match_substring(texts, s))
        for white in " \n":
            alone |= _mask(pc.ends_with(texts, white))
        cut = pc.if_else(pa.array(alone), "", texts) if alone.any() else texts
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        pieces, first = lists.values, offsets[:-1]
        inner = np.ones(len(pieces), bool)
        inner[first] = False
        flat, lengths, starts, base = [], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        for encode, mask in ((self._heads, ~inner), (self._pieces, inner)):
            coded = pieces.filter(pa.array(mask)).dictionary_encode()
            known, index = coded.dictionary, coded.indices.to_numpy()
            bad = _irregular(known, encode == self._pieces)
            n = np.full(len(known), -1, np.int64)
            ids, n[~bad] = encode(known.filter(pa.array(~bad)))
            at = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
            lengths[mask], starts[mask] = n[index], at[index] + base
            flat.append(ids)
            base += len(ids)
        irregular = np.minimum.reduceat(lengths, first) < 0
        np.maximum(lengths, 0, out=lengths)
        ends = np.cumsum(lengths)
        ids = _gather(np.concatenate(flat), starts, lengths)
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(alone | irregular).tolist():
            out[k] = self.whole(texts[k].as_py())
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many(pa.array([text], pa.string()))[0]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(2)
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its text ends a sentence: with one of . ! ? or a line feed."""
    tokenizer = encoder(path).tokenizer
    out = np.zeros(encoder(path).size, bool)
    for piece, i in tokenizer.get_vocab().items():
        out[i] = piece[-1:] in (".", "!", "?", "Ċ")  # U+010A stands for a line feed in byte-level vocabularies
    return out
