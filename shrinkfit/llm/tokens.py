"""Byte-level BPE ids of whole texts, the same as the tokenizers library gives, in less time.

The library spends most of its time on splitting a text into words, again and again for the
same words. Here Arrow splits a batch at its spaces; numpy cuts the distinct pieces into words, by the kinds of their characters,
makes the merges of all words together (``bulkbpe``) and puts the ids of all documents together. Nothing is kept from one
batch to the next, so memory follows the batch alone. Pieces with an apostrophe or white space inside are cut by the word pattern. A text in which a space has another white space beside it isn't split at
its spaces but cut as a whole. A text that holds the string of one of the file's added tokens
goes through the library. Any other kind of tokenizer goes through ``encode_batch``.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bulkbpe import PairTable, merge_words
from .cache import give_back
from .common import fresh, offsets_of

#: The word pattern of byte-level BPE, and the byte ranges that it shows as they are.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [(33, 126), (161, 172), (174, 255)]

_WHITE = r"[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]"
#: Words of more bytes go through the library one by one.
LONG = 64

_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        give_back()  # reading the file took more than what is kept of it
    return _ENCODERS[path]


LETTER, NUMBER, OTHER, SPACE = range(4)


def index_type(most: int) -> type:
    """The narrower integer that holds places up to this one: a batch's places take most of its memory."""
    return np.int32 if most < 2**31 else np.int64


def character_kinds() -> np.ndarray:
    """The word pattern's kind of each code point."""
    import regex

    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for first in range(0, 0x110000, 0x800):
        if 0xD800 <= first < 0xE000:
            continue  # surrogates
        every = "".join(map(chr, range(first, first + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for found in regex.finditer(pattern, every):
                kinds[first + found.start() : first + found.end()] = kind
    return kinds


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                      and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec["model"].get("dropout"))
        #: A text with one of these is split by the library.
        self.added = "|".join(re.escape(x["content"]) for x in spec.get("added_tokens") or [] if x["content"])
        self.words = regex.compile(WORDS)
        shown = {b for a, z in SHOWN for b in range(a, z + 1)}
        hidden = iter(range(256, 512))
        self.table = {b: b if b in shown else next(hidden) for b in range(256)}
        model = spec["model"]
        self.plain = self.plain and not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token", "byte_fallback"))
        self.plain = self.plain and all(chr(c) in model["vocab"] for c in self.table.values())
        if self.plain:
            vocab, merges = model["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
            self.first = np.array([vocab[chr(self.table[b])] for b in range(256)], dtype=np.int32)
            self.pairs = PairTable(*(np.array([vocab[f(x)] for x in merges], dtype=np.int64) for f in (lambda x: x[0], lambda x: x[1], "".join)))
            self.kinds = character_kinds()

    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): ids[offsets[i]:offsets[i + 1]] are row i's, with ``end`` after them if given. Null is empty."""
        texts = fresh(texts)
        if not self.plain:
            found = [np.asarray(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            lens = np.array([len(x) for x in found], dtype=np.int64)
            ids = np.concatenate([*found, np.zeros(0, np.uint32)])
        else:
            lens, ids = self._mixed(texts)
        offsets = np.concatenate([[0], np.cumsum(lens)])
        if end is None:
            return offsets, ids
        out = np.empty(len(ids) + len(lens), dtype=np.uint32)
        ends = offsets[1:] + np.arange(len(lens))
        mask = np.ones(len(out), dtype=bool)
        mask[ends] = False
        out[mask], out[ends] = ids, end
        return np.concatenate([[0], ends + 1]), out

    def _mixed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        held = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False).astype(bool) if self.added else np.zeros(len(texts), bool)
        if not held.any():
            return self._fast(texts)
        lens = np.zeros(len(texts), dtype=np.int64)
        lens[~held], rest = self._fast(texts.take(pa.array(np.flatnonzero(~held))))
        found = [np.asarray(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32) for i in np.flatnonzero(held)]
        lens[held] = [len(x) for x in found]
        ids, is_held = np.empty(lens.sum(), dtype=np.uint32), np.repeat(held, lens)
        ids[is_held], ids[~is_held] = np.concatenate(found), rest
        return lens, ids

    def _fast(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        odd = pc.match_substring_regex(texts, f" {_WHITE}|{_WHITE} ").to_numpy(zero_copy_only=False).astype(bool)
        plain = np.flatnonzero(~odd)
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        offs = offsets_of(split)
        values = split.values.slice(offs[0], offs[-1] - offs[0])
        offs = offs - offs[0]
        coded = values.dictionary_encode()
        seq = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        # A text's first piece has no space before it.
        heads, where = np.unique(seq[offs[:-1]], return_inverse=True)
        seq[offs[:-1]] = len(coded.dictionary) + where
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
        chunks = [spaced, coded.dictionary.take(pa.array(heads)).cast(pa.large_string())]
        counts = np.zeros(n, dtype=np.int64)
        counts[plain] = np.diff(offs)
        if odd.any():
            extra: dict[str, int] = {}
            base, cut = sum(map(len, chunks)), []
            for i in np.flatnonzero(odd):
                words = self.words.findall(texts[int(i)].as_py())
                counts[i] = len(words)
                cut.append(np.array([extra.setdefault(w, base + len(extra)) for w in words], dtype=np.int32))
            chunks.append(pa.array(list(extra), pa.large_string()))
            whole = np.empty(counts.sum(), dtype=np.int32)
            is_odd = np.repeat(odd, counts)
            whole[~is_odd], whole[is_odd] = seq, np.concatenate(cut)
            seq = whole
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat, at, lens = self._chunks(pa.concat_arrays(chunks))
        out_lens = lens[seq]
        ends = np.concatenate([[0], np.cumsum(out_lens)])
        kind = index_type(max(ends[-1], len(flat)))
        places = np.repeat((at[seq] - ends[:-1]).astype(kind), out_lens)
        places += np.arange(ends[-1], dtype=kind)
        return np.diff(ends[starts]), flat[places]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids (little-endian 32-bit) of each word."""
        raw = [w.encode() for w in words]
        short = [k for k, x in enumerate(raw) if len(x) <= LONG]
        lens = np.fromiter((len(raw[k]) for k in short), dtype=np.int64, count=len(short))
        data = b"".join([raw[k] for k in short])
        ids, sizes = merge_words(self.first[np.frombuffer(data, np.uint8)], lens, self.pairs)
        out, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(sizes)
        found = {words[k]: out[a:z] for k, a, z in zip(short, (ends - 4 * sizes).tolist(), ends.tolist())}
        for w, x in zip(words, raw):
            if len(x) > LONG:
                found[w] = np.array([t.id for t in self.tokenizer.model.tokenize(x.decode("latin-1").translate(self.table))], "<u4").tobytes()
        return found

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and for each chunk where its own begin and how many they are."""
        offs = offsets_of(chunks)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        index = index_type(len(data))
        # The place of each character's first byte, and its piece: a piece goes on to where the next one that isn't empty begins.
        place = np.flatnonzero((data & 0xC0) != 0x80).astype(index)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        piece = np.repeat(np.arange(len(chunks), dtype=index), np.diff(np.searchsorted(place, offs.astype(index))))
        first = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(code) else np.zeros(0, bool)
        kind = self.kinds[code]
        # A space that begins a piece belongs to what follows it.
        lead = np.flatnonzero(first & (code == ord(" ")))
        lead = lead[(lead + 1 < len(code)) & ~np.append(first, True)[lead + 1]]
        kind[lead] = kind[lead + 1]
        slow = np.zeros(len(chunks), dtype=bool)
        slow[piece[(kind == SPACE) | (code == ord("'"))]] = True
        starts = np.flatnonzero(first | np.concatenate([[True], kind[1:] != kind[:-1]])) if len(code) else np.zeros(0, np.int64)
        word_piece, word_size = piece[starts], np.diff(np.append(place[starts], len(data)))
        slow[word_piece[word_size > LONG]] = True
        fast = ~slow[word_piece]
        keep = np.repeat(fast, word_size)
        ids, n = merge_words(self.first[data[keep]], word_size[fast], self.pairs)
        lens = np.bincount(word_piece[fast], weights=n, minlength=len(chunks)).astype(np.int64)
        at = np.cumsum(lens) - lens
        which = np.flatnonzero(slow)
        if len(which):
            cut = [self.words.findall(x) for x in chunks.take(pa.array(which)).to_pylist()]
            known = self._words(list({w for x in cut for w in x}))
            own = [b"".join([known[w] for w in x]) for x in cut]
            lens[which] = [len(x) // 4 for x in own]
            at[which] = len(ids) + np.cumsum(lens[which]) - lens[which]
            ids = np.concatenate([ids, np.frombuffer(b"".join(own), "<u4")])
        return ids, at, lens
