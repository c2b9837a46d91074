"""Token ids of whole Arrow text columns by a public tokenizer file, each distinct chunk encoded once.

Both families of files used here split a text into pieces and run BPE inside each
piece. A text may therefore be cut beforehand wherever a piece is sure to end, and
equal chunks give equal ids. The cuts made here are such places in both families:

* before a whitespace byte that follows a character known not to be whitespace,
  when (for byte-level files) a non-space follows a single space, or after and
  before a single line feed between two such characters;
* between a letter and one of a few ASCII marks that take part neither in
  contractions nor in the special tokens' strings.

Characters whose class isn't known from their bytes (beyond ASCII and the letters
U+00C0..U+00FF) just cause fewer cuts.
"""

from __future__ import annotations

import codecs
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from kinspark.llm.shared import text_buffers

#: Text bytes encoded at once: larger slices repeat more chunks.
SLICE_BYTES = 2 << 20
_KNOWN_CHUNKS = 150_000
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?%$#&*()"]] = True
#: How byte-level files write bytes: visible ones as themselves, the others as the characters from U+0100 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = sorted(set(range(256)) - set(_VISIBLE))
_BYTE_FORMS = "".join(chr(0x100 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_SOLID = np.array([b < 128 and not _SPACE[b] for b in range(256)])
#: What a byte can be, as bits: solid, a letter, a mark, a space or line feed, a line feed, the first byte of U+00C0..U+00FF, a second byte of a letter there.
_KINDS = (
    _SOLID + 2 * _LETTER + 4 * _MARK + 8 * np.isin(np.arange(256), [0x20, 0x0A]) + 16 * (np.arange(256) == 0x0A) + 32 * (np.arange(256) == 0xC3) + 64 * ~np.isin(np.arange(256), [0x97, 0xB7])
).astype(np.uint8).tobytes()


def default_path(name: str) -> str:
    """Where the public tokenizer files are installed; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted byte positions at which chunks begin, the ends of the texts included."""
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    before = kind & 3  # bits 1 and 2: what ends here is solid, is a letter
    before[1:] |= ((kind[:-1] & 32) >> 5 & kind[1:] >> 6) * np.uint8(3)
    # A space or line feed between two such characters; marks after letters.
    ends = np.zeros(n + 1, bool)
    cut = ends[:n]
    cut[1:] = before[:-1] >> 1 & kind[1:] >> 2 & 1
    gap = before[:-2] & kind[1:-1] >> 3 & (kind[2:] | kind[2:] >> 5) & 1
    cut[1:-1] |= gap.view(bool)
    cut[2:] |= (gap & kind[1:-1] >> 4).view(bool)
    ends[offsets] = True
    return np.flatnonzero(ends)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, known_chunks: int = _KNOWN_CHUNKS) -> ChunkEncoder:
    """This Python worker's encoder for a file: tasks that follow one another share what it has seen, ``known_chunks`` or little more (about 200 bytes each)."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    _encoders[path].known_chunks = known_chunks
    return _encoders[path]


class ChunkEncoder:
    """Encodes texts with one tokenizer file, keeping the ids of chunks it has seen (a bounded number)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.known_chunks = _KNOWN_CHUNKS
        self._known: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._starts = np.zeros(1 << 12, np.int64)
        self._lengths = np.zeros(1 << 12, np.int64)
        self._seen = np.zeros(1 << 12, np.int64)
        settings = json.loads(self._tokenizer.to_str())
        self._folds = "Lowercase" in json.dumps(settings.get("normalizer"))
        self._direct = True
        probes = [b"the", b" the", b"The", b" Wordless", b"x", b" zqXk", b" internationalisation", " \u00c9tude".encode(), "na\u00efve\u00df".encode()]
        direct = self._lists(probes)
        self._direct = direct == [self._tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in probes]

    def _forget(self) -> None:
        """Drop the chunks used once or, should most be used often, the half used least."""
        n = len(self._known)
        seen = self._seen[:n]
        keep = seen > max(1, int(np.median(seen)))
        lengths = self._lengths[:n][keep]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        self._ids[:total] = self._ids[np.repeat(self._starts[:n][keep] - (ends - lengths), lengths) + np.arange(total)]
        self._used = total
        self._known = {c: i for i, c in enumerate(c for c, k in zip(self._known, keep.tolist(), strict=True) if k)}
        m = len(self._known)
        self._starts[:m], self._lengths[:m], self._seen[:m], self._seen[m:] = ends - lengths, lengths, 0, 0

    def _plain_form(self, chunk: bytes) -> str | None:
        """What the model itself takes for a chunk that is one piece of Latin letters; None for all others."""
        word = chunk[1:] if chunk[:1] == b" " else chunk
        lead = "" if word is chunk or self._folds else "\u0120"
        if word.isalpha():  # of bytes: ASCII letters only
            return lead + (word.lower() if self._folds else word).decode()
        text = word.decode()
        if not text.isalpha() or max(text) > "\u00ff":
            return None
        return lead + codecs.charmap_decode(text.lower().encode() if self._folds else word, "strict", _BYTE_FORMS)[0]

    def _lists(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk. Plain words go straight to the model, past normalizer and splitter, which would not change them."""
        run = self._tokenizer.model.tokenize
        out: list[list[int] | None] = []
        rest: list[int] = []
        for i, c in enumerate(chunks):
            form = self._plain_form(c) if self._direct else None
            if form is None:
                rest.append(i)
                out.append(None)
            else:
                out.append([t.id for t in run(form)])
        for i, e in zip(rest, self._tokenizer.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        lists = self._lists(chunks)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        at, total = len(self._known), len(self._known) + len(chunks)
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while total > len(self._starts):
            self._starts, self._lengths, self._seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self._starts, self._lengths, self._seen))
        self._ids[self._used : self._used + len(flat)] = flat
        self._starts[at:total] = self._used + np.cumsum(lengths) - lengths
        self._lengths[at:total] = lengths
        self._used += len(flat)
        self._known.update(zip(chunks, range(at, total), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32) and the n + 1 offsets of the texts in them (null: empty)."""
        data, offsets = text_buffers(column)
        cuts = cut_points(data, offsets)
        if self._folds and b"<|" not in (raw := data.tobytes()):  # upper case makes no difference then, and chunks get fewer
            data = np.frombuffer(raw.translate(_LOWER), np.uint8)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._known) > self.known_chunks:
            self._forget()
        index = coded.indices.to_numpy()
        find = self._known.get
        each = np.fromiter((find(c, -1) for c in distinct), np.int64, len(distinct))
        fresh = np.flatnonzero(each < 0)
        if len(fresh):
            at = len(self._known)
            self._learn([distinct[i] for i in fresh.tolist()])
            each[fresh] = np.arange(at, len(self._known))
        self._seen[each] += np.bincount(index, minlength=len(each))
        place = each[index]
        lengths = self._lengths[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        ids = self._ids[np.repeat(self._starts[place] - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
