"""Cost-balanced packing of token ids into sequences of fixed length.

Every task packs the documents it reads, so nothing is shuffled: documents are cut at the
sequence length, the tails of about ``buffer_tokens`` tokens are sorted descending, and each
goes to the sequence with the lowest estimated attention cost (a linear and a quadratic term)
that still has room. A tail that fits nowhere is cut over the lowest-cost sequences with room.
What does not fill a sequence moves on to the next buffer; the last rest of a task becomes
sequences of falling powers of two, which need no padding.

Defined cases: a null or empty text is its end token alone; repeated rows and ids are packed
one by one; a null id stays null; extra columns are not read; an empty table gives no piece.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from orderlens.llm.shared import emit, narrow, prepare, slices, text_bytes
from orderlens.llm.words import Words, span_codes, spans

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merges:
    """Rank and result of a pair of symbols, looked up for many pairs at once."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(8, int(len(keys) * 8).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.made = np.full(size, -1), np.full(size, NONE), np.zeros(size, np.int64)
        self.probes = 1
        for rank, (slot, key) in enumerate(zip(self.slots(keys).tolist(), keys.tolist(), strict=True)):
            step = 0
            while self.keys[(slot + step) % size] >= 0:
                step += 1
            at = (slot + step) % size
            self.keys[at], self.ranks[at], self.made[at] = key, rank, made[rank]
            self.probes = max(self.probes, step + 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.width + right
        at = self.slots(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self.keys)
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], NONE), self.made[at]


class WordTokens:
    """Ids of whole texts: a bounded memo of word ids, new words merged for a batch at once.

    Words are looked up by their 64-bit code. The memo serves texts of letters on which lower
    case and normal form act one by one (below U+0250, and common punctuation); other texts,
    and those that may spell a special token, go to the library.
    """

    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed value: the vocabulary's own pattern

    def __init__(self, path: str, most_words: int = 2_000_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.merges = Merges(vocab, model["merges"])
        self.most_words = most_words
        self.odd = np.zeros(256, np.uint8)  # 1: leave to the library; 2: look at what follows
        self.odd[[*range(9), *range(0x0E, 0x20), 0x7F, *range(0xCA, 0x100)]] = 1
        self.odd[[0xC2, 0xC4, 0xC9, 0xE2]] = 2
        self.mark, self.letter = np.zeros(256, bool), np.zeros(256, bool)
        self.mark[list(b".,;:!?")] = True
        self.letter[ord("a") : ord("z") + 1] = True
        self.forget()

    def forget(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def strange(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the memo does not cover."""
        kind = self.odd[data]
        look = np.flatnonzero(kind == 2)
        head = data[look]
        after = data[np.minimum(look + 1, len(data) - 1)]
        third = data[np.minimum(look + 2, len(data) - 1)]
        plain = np.select(
            [head == 0xC2, head == 0xC4, head == 0xC9],
            [after > 0xA0, after != 0xB0, after < 0x90],
            (after == 0x80) & (third >= 0x8B) & (third <= 0xA7),
        )
        bad = np.r_[np.flatnonzero(kind == 1), look[~plain.astype(bool)]]
        bad = np.r_[bad, np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))]
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, bad, "right") - 1] = True
        return out

    def split(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Words between blanks; one closing mark behind an English letter is a word of its own."""
        starts, ends = spans(data, offsets)
        closed = np.flatnonzero(self.mark[data[ends - 1]] & self.letter[data[np.maximum(ends - 2, 0)]] & (ends - starts > 1))
        starts = np.insert(starts, closed + 1, ends[closed] - 1)
        cut = ends.copy()
        cut[closed] -= 1
        ends = np.insert(cut, closed + 1, ends[closed])
        return Words(starts, ends, span_codes(data, starts, ends), np.searchsorted(starts, offsets))

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols, owner = self.inner[data], np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        done_symbols, done_owner = [], []
        while len(symbols):
            ranks, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            ranks[pair], made[pair] = self.merges.find(symbols[pair], symbols[pair + 1])
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[heads, len(owner)])
            least = np.repeat(np.minimum.reduceat(ranks, heads), counts)
            over = least == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            hits = np.flatnonzero((ranks == least) & ~over)
            if not len(hits):
                break
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]
            symbols[hits] = made[hits]
            keep = ~over
            keep[hits + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(owner, minlength=len(pieces))

    def learn(self, codes: np.ndarray, new: list[str]) -> None:
        pieces, per_word = [], []
        for word in new:
            found = [word] if word.isalpha() else self.PIECE.findall(word)
            pieces += found
            per_word.append(len(found))
        ids, sizes = self.merged([p.encode() for p in pieces])
        sizes = np.add.reduceat(sizes, np.r_[0, np.cumsum(per_word)[:-1]])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        where = np.searchsorted(self.codes, codes)
        self.codes = np.insert(self.codes, where, codes)
        self.at = np.insert(self.at, where, self.used + np.r_[0, np.cumsum(sizes)[:-1]])
        self.sizes = np.insert(self.sizes, where, sizes)
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = text_bytes(texts)
        by_library = self.strange(data, offsets) if len(data) else np.zeros(len(texts), bool)
        if by_library.any():
            blank = pa.array([""] * len(texts), texts.type)
            lower = pc.utf8_lower(pc.if_else(pa.array(by_library), blank, texts))
        else:
            lower = pc.utf8_lower(texts)
        data, offsets = text_bytes(lower)
        found = self.split(data, offsets)
        codes, first, inverse = np.unique(found.codes, return_index=True, return_inverse=True)
        if len(self.codes) > self.most_words:
            self.forget()
        where = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        new = np.flatnonzero(self.codes[where] != codes) if len(self.codes) else np.arange(len(codes))
        if len(new):
            raw = data.tobytes()
            starts, ends = found.starts[first[new]].tolist(), found.ends[first[new]].tolist()
            self.learn(codes[new], [raw[s:e].decode() for s, e in zip(starts, ends, strict=True)])
        index = np.searchsorted(self.codes, codes)[inverse]
        sizes = self.sizes[index]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.at[index] - ends[:-1], sizes)]
        bounds = ends[found.first]
        return [
            np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32)
            if by_library[k]
            else ids[bounds[k] : bounds[k + 1]]
            for k in range(len(texts))
        ]


class Packer:
    """Packs pieces of at most ``length`` tokens; calls ``put(piece, start, size, sequence, offset)``."""

    def __init__(self, put, length: int, linear: float, quadratic: float, first_sequence: int) -> None:
        self.put, self.length, self.linear, self.quadratic = put, length, linear, quadratic
        self.next, self.tails, self.held = first_sequence, [], 0

    def cost(self, size):
        return self.linear * size + self.quadratic * size * size

    def whole(self, piece, start: int) -> None:
        self.put(piece, start, self.length, self.next, 0)
        self.next += 1

    def tail(self, piece, start: int, size: int) -> None:
        self.tails.append((size, len(self.tails), piece, start))
        self.held += size

    def flush(self, last: bool = False) -> None:
        full, rest = divmod(self.held, self.length)
        room = [self.length] * full
        if last:
            room += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        self.tails, tails = [], sorted(self.tails, key=lambda t: (-t[0], t[1]))
        self.held = 0
        left, cost, at = np.array(room, np.int64), np.zeros(len(room)), np.zeros(len(room), np.int64)
        for size, _, piece, start in tails:
            while size:
                fits = left >= size
                if not fits.any():
                    fits = left > 0
                if not fits.any():
                    self.tail(piece, start, size)
                    break
                to = int(np.argmin(np.where(fits, cost, np.inf)))
                part = min(size, int(left[to]))
                self.put(piece, start, part, self.next + to, int(at[to]))
                cost[to] += self.cost(part)
                left[to] -= part
                at[to] += part
                start, size = start + part, size - part
        self.next += len(room)


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 4096,
    end_token: int = 2,
    buffer_tokens: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
) -> DataFrame:
    """One row per piece: which tokens of which document lie where in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary)
        rows: list[tuple] = []

        def put(piece, start, size, sequence, offset):
            doc_id, ids = piece
            crc = zlib.crc32(ids[start : start + size].astype("<u4").tobytes())
            rows.append((doc_id, start, size, crc, len(ids), sequence, offset))

        packer = Packer(put, length, linear, quadratic, TaskContext.get().partitionId() << 40)
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.int32(end_token)).astype(np.uint16 if tokens.merges.width < 1 << 16 else np.int32)
                piece, cut = (doc_id, ids), len(ids) // length * length
                for start in range(0, cut, length):
                    packer.whole(piece, start)
                if cut < len(ids):
                    packer.tail(piece, cut, len(ids) - cut)
                if packer.held >= buffer_tokens:
                    packer.flush()
            if rows:
                yield emit(ARROW, *zip(*rows, strict=True))
                rows.clear()
        packer.flush(last=True)
        if rows:
            yield emit(ARROW, *zip(*rows, strict=True))

    prepare(docs.sparkSession)
    return narrow(docs, id_col, text_col).mapInArrow(run, PIECES)
