"""SentencePiece BPE ids of whole texts and back, by a table of each prefix's last piece.

Merging takes, again and again, the adjacent pair whose joined string is the piece of the highest score (ties: the leftmost). What happens on
one side of a boundary that no merge crosses doesn't depend on the other side. So a sequence of pieces is a text's encoding exactly if each
adjacent pair of them is the encoding of its own two strings, and every prefix of a text has one encoding, hence one last piece:

1. The text (with its leading mark) falls apart where no piece reaches across: before a mark that follows another character, then between
   two characters that are neighbours in no piece. Each different part is encoded once and kept in a byte-bounded cache.
2. An automaton over all pieces reports the pieces that end at each place. The one that is compatible with the last piece of the prefix
   before it is this prefix's last piece; it is stored. Compatible: merging the two strings together gives these two pieces again
   (the merges are replayed once for each different pair and remembered).
3. From the text's end the stored pieces are walked backwards.

This takes time in proportion to the text, also for a segment of millions of characters. Characters that no piece holds become byte pieces.
Decoding gathers the pieces' bytes by numpy, takes the mark for a space and drops the one that encoding puts first.

Models: BPE with byte fallback, no normalisation, a mark put first, white space kept, no user-defined or unused pieces; others raise ValueError.
Nulls: a null text is empty (no ids); a null doc_id is kept. Very long texts: memory follows the longest one. Ties, repeated rows: every row is encoded.
Empty table: no rows. Further columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cache import Pieces, tidy
from .common import fresh, offsets_of, slices
from .tokens import tokenizer_path

#: Fixed value: the mark that stands for a space.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Compatible pairs that a worker remembers (about 100 bytes each); then it begins anew.
PAIRS = 400_000

_MODELS: dict[str, "PieceModel"] = {}


def piece_model(path: str | None = None) -> "PieceModel":
    """One for each Python worker and file."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


class PieceModel:
    def __init__(self, path: str, cached: int = 96 << 20):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        train, norm = spec.trainer_spec, spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if (train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.add_dummy_prefix
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError(f"{path}: not a byte-fallback BPE model without normalisation")
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        #: What can stand in an encoding: the pieces, and characters that only occur inside pieces (they become bytes).
        self.names = list(self.score) + sorted({c for x in self.score for c in x} - set(self.score))
        self.number = {x: k for k, x in enumerate(self.names)}
        self.sizes = [len(x) for x in self.names]
        self.out = [[self.ids[x]] if x in self.ids else self.bytes_of(x) for x in self.names]
        self.chars = {x for x in self.names if len(x) == 1}
        #: Characters that are neighbours in some piece.
        self.inside = {x[k : k + 2] for x in self.names for k in range(len(x) - 1)}
        self.apart = not any(MARK in x.lstrip(MARK) for x in self.names)
        self.automaton = ahocorasick.Automaton()
        for k, x in enumerate(self.names):
            self.automaton.add_word(x, k)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.cache = Pieces(cached)
        # For decoding: the bytes of each id.
        plain = {NORMAL: lambda p: p.piece.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p.piece[1:-1], 16)]), UNKNOWN: lambda p: train.unk_surface.encode(), CONTROL: lambda p: b""}
        shown = [plain[p.type](p) for p in spec.pieces]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_lens = np.array([len(x) for x in shown], dtype=np.int64)
        self.shown_at = np.cumsum(self.shown_lens) - self.shown_lens
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(MARK) for p in spec.pieces])
        self.silent = np.array([p.type == CONTROL for p in spec.pieces])
        self.is_byte = np.array([p.type == BYTE for p in spec.pieces])

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def merged(self, text: str) -> list[str]:
        """The merges, replayed one by one; for the strings of two pieces."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: int, piece: int) -> bool:
        """May ``piece`` follow ``before`` (-1: stand first)?"""
        left, right = self.names[before] if before >= 0 else None, self.names[piece]
        return self.merged(right) == [right] if left is None else self.merged(left + right) == [left, right]

    def known_run(self, text: str) -> list[int]:
        """The ids of a run of characters that pieces hold."""
        last = [-1] * (len(text) + 1)  # of each prefix
        sizes, fits, n = self.sizes, self.fits, len(self.names)
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - sizes[piece]]
            key = before * n + piece
            ok = fits.get(key)
            if ok is None:
                if len(fits) >= PAIRS:
                    fits.clear()
                ok = fits[key] = self.compatible(before, piece)
            if ok:
                last[end] = piece
        found, at = [], len(text)
        while at:
            piece = last[at]
            if piece < 0:
                raise RuntimeError(f"no piece ends at {at}")
            found.append(piece)
            at -= sizes[piece]
        return [i for piece in reversed(found) for i in self.out[piece]]

    def segment(self, text: str) -> bytes:
        """The ids of a segment, as little-endian 32-bit numbers."""
        inside, start, out = self.inside, 0, []
        for k in range(1, len(text) + 1):
            if k < len(text) and text[k - 1 : k + 1] in inside:
                continue
            part = text[start:k]
            (ids,), missing = self.cache.find([part])
            if missing:
                # A character that no piece holds has no neighbour in any, so it is a part by itself.
                ids = np.array(self.known_run(part) if part[0] in self.chars else self.bytes_of(part), "<i4").tobytes()
                self.cache.put(part, ids)
            if start == 0 and k == len(text):
                return ids
            out.append(ids)
            start = k
        return b"".join(out)

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each with the mark that it begins with."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}]*", marked) if self.apart else [marked]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null is empty."""
        texts = fresh(texts)
        # One space between words, none first: the segments are what stands between spaces.
        odd = pc.match_substring_regex(texts, f"^ |  |{MARK}|^$").to_numpy(zero_copy_only=False).astype(bool) if self.apart else np.ones(len(texts), bool)
        plain = np.flatnonzero(~odd)
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        offs = offsets_of(split)
        coded = split.values.slice(offs[0], offs[-1] - offs[0]).dictionary_encode()
        names, seq = [MARK + x for x in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[plain] = np.diff(offs)
        if odd.any():
            number, cut = {x: k for k, x in enumerate(names)}, []
            for i in np.flatnonzero(odd).tolist():
                cut.append([number.setdefault(x, len(number)) for x in self.segments(texts[i].as_py())])
                counts[i] = len(cut[-1])
            names = list(number)
            whole, is_odd = np.empty(counts.sum(), dtype=np.int64), np.repeat(odd, counts)
            whole[~is_odd], whole[is_odd] = seq, np.concatenate([np.array(x, dtype=np.int64) for x in cut])
            seq = whole
        found, missing = self.cache.find(names)
        for i in missing:
            found[i] = self.segment(names[i])
            self.cache.put(names[i], found[i])
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), "<i4"), np.cumsum(lens) - lens
        out_lens = lens[seq]
        ends = np.concatenate([[0], np.cumsum(out_lens)])
        places = np.repeat(at[seq] - ends[:-1], out_lens) + np.arange(ends[-1])
        return ends[np.concatenate([[0], np.cumsum(counts)])], flat[places]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each run of ids."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.shown_lens)):
            raise ValueError("an id outside the model")
        lens, at = self.shown_lens[ids], self.shown_at[ids]
        # The mark that encoding put first: of the first piece that shows anything.
        heard = np.flatnonzero(~self.silent[ids])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[heard]
        first = heard[np.concatenate([[True], row[1:] != row[:-1]])] if len(heard) else heard
        first = first[self.marked[ids[first]]]
        lens[first] -= 1
        at = at.copy()
        at[first] += 1
        ends = np.concatenate([[0], np.cumsum(lens)])
        data = self.shown[np.repeat(at - ends[:-1], lens) + np.arange(ends[-1])]
        text_offs = ends[offsets]
        with_bytes = np.add.reduceat(np.concatenate([self.is_byte[ids], [False]]).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) > 0 if len(offsets) > 1 else np.zeros(0, bool)
        raw = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(text_offs.astype(np.int64)), pa.py_buffer(data)])
        try:
            if not with_bytes.any():
                return raw.view(pa.large_string())
            return raw.cast(pa.large_string())  # checks that byte pieces make whole characters
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())


def encode_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids of every row."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, ids = model.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, ids, text of every row; null ids are an empty text."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(batches):
        model = piece_model(path)
        for batch in batches:
            lists = batch.column("ids")
            total = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:  # about a million ids at a time
                before = total[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(total, before + 1_000_000, side="right")))
                part = batch.slice(start, stop - start)
                lens = pc.fill_null(pc.list_value_length(part.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                own = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                texts = model.decode(np.concatenate([[0], np.cumsum(lens)]), own)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), texts.cast(pa.string())], ["doc_id", "ids", "text"])
                start = stop

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(tidy(run), "doc_id long, ids array<int>, text string")


def pieces_query(docs: DataFrame) -> DataFrame:
    """op11: encode all documents, decode the ids, and give the digests of both."""
    rows = decode_pieces(encode_pieces(docs))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
