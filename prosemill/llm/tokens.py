"""Token ids of whole columns by the tokenizers library: every distinct piece is encoded once by the library and remembered.

The fast way is for one kind of tokenizer, a lower-casing BPE over words; its normalizer, pre-tokenizer and control strings are
checked on loading, and any other tokenizer encodes whole texts. Texts in Latin-1 are lowered up front (there, lower case and NFC
work letter by letter), unless they hold the beginning of a control string; any other text keeps its letters, and the library
normalizes its words. A word is what stands between U+0020 or U+000A. A word of lower-case Latin letters with punctuation behind
is two pieces, as in the tokenizer's own split; any other word is one piece and is left to the library as it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_BPE = "word_bpe_49k.json"
PIECES_MOST = 1_000_000  #: pieces that a worker remembers; others are encoded again each time
SHORT = 64  #: bytes of a piece that is remembered at most
AT_ONCE = 1 << 18  #: bytes of text that are taken apart at once, at many bytes of arrays each; a longer text is taken alone
_ENCODERS: dict[str, "WordEncoder"] = {}

# What the fast way assumes of a tokenizer file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_SPACE, _LETTER, _SIGN, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[list(b".,;:!?|()*#%-")] = _SIGN
_KIND[0x20] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[0x0A] = 0x20
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_TABLES = np.random.default_rng(20240601).integers(0, 2**64, (2, SHORT << 8), np.uint64)


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "WordEncoder":
    """The worker's encoder for a tokenizer file: loaded once, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    """Token ids of whole texts, the same as ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.size = self.full.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        made = json.loads(self.full.to_str())
        model, added = made["model"], made["added_tokens"]
        # A control string must begin with "<|" and hold no blank, so that it stays inside a word and is met by one test.
        self.fast = (
            made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == _PRE_TOKENIZER and made["truncation"] is None and made["padding"] is None
            and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("fuse_unk")
            and all(a["content"].startswith("<|") and not any(map(str.isspace, a["content"])) and not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in added)
        )
        if not self.fast:
            return
        # The same model without normalizing: for lower-case Latin letters, on which that does nothing.
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.size, bool)
        for word, i in self.full.get_vocab().items():
            self.ends[i] = word.endswith("</w>")
        self.starts, self.lengths, self.pool = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), np.empty(1 << 18, self.dtype)
        self.checks = np.empty(1 << 16, np.uint64)
        self.kept = self.used = self.listed = 0
        # An open-addressing table of the remembered pieces: first hash and place.
        self.slots = 1 << (2 * PIECES_MOST - 1).bit_length()
        self.keys, self.places = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)

    def _append(self, ids: np.ndarray, lengths: np.ndarray, checks: np.ndarray) -> None:
        """Puts new pieces behind those in the pool."""
        n, m = self.kept + len(lengths), self.used + len(ids)
        while n > len(self.starts):
            self.starts, self.lengths, self.checks = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths, self.checks))
        while m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : m] = ids
        self.lengths[self.kept : n], self.checks[self.kept : n] = lengths, checks
        self.starts[self.kept : n] = self.used + np.cumsum(lengths) - lengths
        self.kept, self.used = n, m

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one behind the other, and how many each has."""
        plain = [i for i, p in enumerate(pieces) if _PLAIN.fullmatch(p)]
        rest = [i for i, p in enumerate(pieces) if not _PLAIN.fullmatch(p)]
        parts: list[np.ndarray] = []
        lengths = np.zeros(len(pieces), np.int64)
        for i in range(0, len(plain), 1000):
            run = [pieces[k] for k in plain[i : i + 1000]]
            ids = np.array(self.bare.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.nonzero(self.ends[ids])[0] + 1
            if len(stops) != len(run):  # some piece has a token with an end inside: each is encoded alone
                each = [np.array(e.ids, self.dtype) for e in self.full.encode_batch_fast(run, add_special_tokens=False)]
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            parts.append(ids)
            lengths[plain[i : i + 1000]] = np.diff(stops, prepend=0)
        if rest:
            each = [np.array(e.ids, self.dtype) for e in self.full.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)]
            parts += each
            lengths[rest] = [len(x) for x in each]
        order = np.array(plain + rest, np.int64)
        flat, count = np.concatenate([np.empty(0, self.dtype), *parts]), lengths[order]
        begin = np.empty(len(pieces), np.int64)
        begin[order] = np.cumsum(count) - count
        return flat[_ranges(begin, lengths)], lengths

    def _places(self, packed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where each piece of ``packed`` stands in the pool; pieces that aren't there are encoded.

        A piece is known by two independent 64-bit hashes (tabulation, a random value a place and byte); pieces of more than
        ``SHORT`` bytes are encoded each time.
        """
        size = np.diff(offsets)
        within = np.arange(len(packed), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), size)
        where = ((within & (SHORT - 1)) << 8) + packed
        h, check = (np.add.reduceat(t[where], offsets[:-1]) for t in _TABLES)
        h |= np.uint64(h.dtype.type(1))  # 0 is an empty slot
        at = np.full(len(h), -1, np.int64)
        open_, slot = np.arange(len(h)), (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(open_):
            key = self.keys[slot]
            met = key == h[open_]
            found = open_[met]
            at[found] = self.places[slot[met]]
            on = ~met & (key != 0)
            open_, slot = open_[on], (slot[on] + 1) & (self.slots - 1)
        hit = np.nonzero(at >= 0)[0]
        at[hit[self.checks[at[hit]] != check[hit]]] = -1
        long = size > SHORT
        at[long] = -1
        miss = np.nonzero(at < 0)[0]
        if len(miss):
            few = miss[~long[miss]]
            _, first, back = np.unique(h[few], return_index=True, return_inverse=True)
            if (check[few[first]][back] != check[few]).any():
                first = back = np.arange(len(few))
            new, raw = np.concatenate([few[first], miss[long[miss]]]), packed.tobytes()
            pieces = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(offsets[new].tolist(), offsets[new + 1].tolist())]
            base = self.kept
            self._append(*self._encoded(pieces), check[new])
            at[few] = base + back
            at[miss[long[miss]]] = base + len(first) + np.arange(len(new) - len(first))
            self._list(h[new[: len(first)]], base)
        return at

    def _list(self, h: np.ndarray, base: int) -> None:
        """Remembers new pieces, if there is room for them all."""
        if self.kept > PIECES_MOST:
            return
        self.listed = self.kept
        rest, slot = np.arange(len(h)), (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[rest[free]]
            mine = free & (self.keys[slot] == h[rest])
            self.places[slot[mine]] = base + rest[mine]
            rest, slot = rest[~mine], (slot[~mine] + 1) & (self.slots - 1)

    def _some(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that stand one behind the other in ``data``, and how many each has."""
        n = len(data)
        if not n:
            return np.empty(0, self.dtype), np.zeros(len(ends), np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        # Rows that are lowered: without a byte that begins a character beyond Latin-1, and without "<|".
        marks = data >= 0xC4
        marks[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        data = data.copy()
        if not marks.any():
            data = _LOWER[data]
            two = np.nonzero(data == 0xC3)[0] + 1
        else:
            full = np.nonzero(ends > starts)[0]
            keep = np.zeros(len(ends), bool)
            keep[full] = np.logical_or.reduceat(marks, starts[full])
            low = ~np.repeat(keep, ends - starts)
            data[data == 0x0A] = 0x20
            data[low] = _LOWER[data[low]]
            two = np.nonzero((data == 0xC3) & low)[0] + 1
        upper = two[(data[two] >= 0x80) & (data[two] <= 0x9E) & (data[two] != 0x97)]
        data[upper] += 0x20
        kind = _KIND[data]
        two = np.nonzero(data == 0xC3)[0] + 1
        two = two[(data[two] >= 0x9F) & (data[two] != 0xB7)]
        kind[two] = kind[two - 1] = _LETTER
        # Words begin behind a space and where a text begins.
        blank = kind == _SPACE
        first = np.zeros(n + 1, bool)
        first[1:] = blank
        first[starts] = True
        first = first[:-1] & ~blank
        word = np.nonzero(first)[0]
        if not len(word):
            return np.empty(0, self.dtype), np.zeros(len(ends), np.int64)
        odd = kind == _OTHER
        odd[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _SIGN) & ~first[1:]
        whole = np.logical_or.reduceat(odd, word)
        sign = np.nonzero((kind[1:] == _SIGN) & (kind[:-1] == _LETTER) & ~first[1:])[0] + 1
        if whole.any():
            sign = sign[~whole[np.searchsorted(word, sign, "right") - 1]]
        first[sign] = True
        # Without the spaces, pieces stand one behind the other.
        solid = ~blank
        place = np.cumsum(solid)
        packed, piece = data[solid], np.nonzero(first)[0]
        offsets = np.empty(len(piece) + 1, np.int64)
        offsets[:-1] = place[piece] - 1
        offsets[-1] = len(packed)
        at = self._places(packed, offsets)
        count = self.lengths[at]
        ids = self.pool[_ranges(self.starts[at], count)]
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(piece, np.concatenate([[0], ends]))]
        if self.kept > self.listed:  # what isn't remembered is dropped
            self.kept, self.used = self.listed, int(self.starts[self.listed]) if self.listed else 0
        return ids, np.diff(upto)

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, ids, ends) for runs i .. j - 1 of a string column: their ids, one text behind the other, and where each ends.

        A run has some ``AT_ONCE`` bytes, or one text of more. A null is an empty text.
        """
        if not len(texts):
            return
        texts = pa.concat_arrays([texts.cast(pa.large_string())]).fill_null("")
        _, ends, raw = texts.buffers()
        ends = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + AT_ONCE, "right")) - 1)
            if self.fast:
                ids, n = self._some(raw[ends[i] : ends[j]], ends[i + 1 : j + 1] - ends[i])
            else:
                each = [np.array(e.ids, self.dtype) for e in self.full.encode_batch_fast(texts.slice(i, j - i).to_pylist(), add_special_tokens=False)]
                ids, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            yield i, j, ids, np.cumsum(n)
            i = j

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one behind the other, and where each ends."""
        ids, ends, at = [np.empty(0, self.dtype)], [np.empty(0, np.int64)], 0
        for _, _, some, stops in self.parts(texts):
            ids.append(some)
            ends.append(stops + at)
            at += len(some)
        return np.concatenate(ids), np.concatenate(ends)

    def ids(self, text: str | None) -> np.ndarray:
        return self.column(pa.array([text], pa.string()))[0]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of all ranges, one behind the other."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """A column's ids with ``end_id`` behind each text, and where each then ends."""
    ends = ends + np.arange(1, len(ends) + 1)
    out = np.full(len(ids) + len(ends), end_id, ids.dtype)
    rest = np.ones(len(out), bool)
    rest[ends - 1] = False
    out[rest] = ids
    return out, ends


def as_u32(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()
