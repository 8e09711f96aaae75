"""SentencePiece encoding and decoding with merge-type vocabularies (operator 5).

A text is cut before every run of word marks, which no piece of such a vocabulary crosses. Each
distinct chunk of a batch is merged once: an agenda holds the adjacent symbol pairs whose union
is a piece, best score first and leftmost on ties; taking one joins its symbols and adds the
pairs with the new neighbours. Chunks of about equal length are merged side by side, their agendas
as rows of one array; chunks of over 64 characters have a heap each. Symbols outside the vocabulary fall back to byte pieces. The ids
of every newly merged chunk are compared with the sentencepiece library, batch by batch, and
what the ids of every row decode to with the library's decoder; a difference ends the job.

Null and empty texts give no ids and the empty text. Texts of any length are taken whole; only
the chunk, which white space bounds, must fit an agenda. Repeated rows are encoded alike. Both
functions take and give columns, so other columns of the table, whatever their names, stay.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from holdfast.llm.rows import Recent, scalar, slices

MARK = "▁"
LONG = 64
#: A symbol's number fits 21 bits: vocabulary ids, then code points.
CODE_BITS = 21
NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; merge-type, byte fallback, identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = self.library.id_to_piece(list(range(size)))
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        for i, name in enumerate(names):
            if self.library.is_byte(i):
                value = int(name[3:-1], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif self.library.is_control(i):
                self.surface.append(b"")
            elif self.library.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[name], self.scores[name] = i, self.library.get_score(i)
                self.surface.append(name.replace(MARK, " ").encode())
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError("a piece holds a word mark after other characters; chunks can't be cut there")
        self._pairs()

    def _pairs(self) -> None:
        """All pairs of symbols whose union is a piece: sorted keys, the pieces and their ranks by score."""
        size = self.library.get_piece_size()
        self.code = np.arange(size, size + 0x110000, dtype=np.int64)  # a character that is no piece, by code point
        for name, i in self.ids.items():
            if len(name) == 1:
                self.code[ord(name)] = i

        def symbol(part: str) -> int:
            return int(self.code[ord(part)]) if len(part) == 1 else self.ids.get(part, -1)

        split = [(symbol(n[:k]), symbol(n[k:]), i) for n, i in self.ids.items() for k in range(1, len(n))]
        left, right, union = np.array([x for x in split if x[0] >= 0 and x[1] >= 0], np.int64).reshape(-1, 3).T
        order = np.argsort(left << CODE_BITS | right)
        score = np.array([self.scores.get(n, 0.0) for n in self.library.id_to_piece(list(range(size)))])
        ranks = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        # The last entry is never equal to a key.
        self.keys = np.append((left << CODE_BITS | right)[order], np.iinfo(np.int64).max)
        self.unions = np.append(union[order], -1)
        self.ranks = np.append(ranks[union[order]], NONE)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs stand among all pairs; the last place for those that join to no piece."""
        key = left << CODE_BITS | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge_all(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their symbols) once rows of ``codes``, padded with -1, have nothing left to join.

        A row of pair ranks is the agenda of a row of symbols. Every round takes each row's best pair,
        leftmost on ties, and ranks the pairs of the joined symbol with its new neighbours.
        """
        rows = np.arange(len(codes))
        at = self.places(codes[:, :-1], codes[:, 1:])
        while codes.shape[1] > 1:
            ranks = self.ranks[at]
            best = ranks.argmin(axis=1)
            open_ = ranks[np.arange(len(rows)), best] < NONE
            if not open_.all():
                yield rows[~open_], codes[~open_]
                rows, codes, at, best = rows[open_], codes[open_], at[open_], best[open_]
                if not len(rows):
                    return
            every, (n, width) = np.arange(len(rows)), codes.shape
            codes[every, best] = self.unions[at[every, best]]
            keep = np.ones(codes.shape, bool)
            keep[every, best + 1] = False
            codes = codes[keep].reshape(n, width - 1)
            keep = np.ones(at.shape, bool)
            keep[every, best] = False
            at = at[keep].reshape(n, width - 2)
            lead, follow = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
            x, y = best[lead], best[follow]
            at[lead, x - 1] = self.places(codes[lead, x - 1], codes[lead, x])
            at[follow, y] = self.places(codes[follow, y], codes[follow, y + 1])
        yield rows, codes

    def merge_long(self, codes: list[int]) -> list[int]:
        """The symbols of one chunk, with its agenda as a heap."""
        size = len(codes)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(lefts: list[int], rights: list[int]) -> None:
            a, b = np.array([codes[i] for i in lefts], np.int64), np.array([codes[j] for j in rights], np.int64)
            for i, j, at in zip(lefts, rights, self.places(a, b).tolist()):
                if at < len(self.keys) - 1:
                    heapq.heappush(agenda, (int(self.ranks[at]), i, j, at))

        offer(list(range(size - 1)), list(range(1, size)))
        while agenda:
            _, i, j, at = heapq.heappop(agenda)
            # Stale once either side was joined to something else.
            if codes[i] < 0 or codes[j] < 0 or after[i] != j or codes[i] << CODE_BITS | codes[j] != self.keys[at]:
                continue
            codes[i], codes[j] = int(self.unions[at]), -1
            follow = after[i] = after[j]
            if follow < size:
                before[follow] = i
            near = [(i, follow)] * (follow < size) + [(before[i], i)] * (before[i] >= 0)
            offer([a for a, _ in near], [b for _, b in near])
        return [c for c in codes if c >= 0]

    def merge(self, chunks: list[str]) -> list[bytes]:
        """Ids of the chunks, as the bytes of 32-bit integers."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        codes = self.code[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        out: list[bytes] = [b""] * len(chunks)
        for k in np.flatnonzero(sizes > LONG).tolist():
            self._put(out, [k], np.array([self.merge_long(codes[ends[k] - sizes[k]:ends[k]].tolist())], np.int64))
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(sizes[short], kind="stable")]
        for start in range(0, len(short), 8192):  # of about equal length, so little is padding
            own = short[start:start + 8192]
            width = int(sizes[own[-1]])
            place = (ends - sizes)[own][:, None] + np.arange(width)
            inside = np.arange(width) < sizes[own][:, None]
            table = np.where(inside, codes[np.minimum(place, len(codes) - 1)], -1)
            for rows, symbols in self.merge_all(table):
                self._put(out, own[rows].tolist(), symbols)
        return out

    def _put(self, out: list[bytes], where: list[int], symbols: np.ndarray) -> None:
        """Ids of the symbols; those outside the vocabulary fall back to byte pieces."""
        size = self.library.get_piece_size()
        raw, ends = symbols[symbols >= 0].astype(np.int32).tobytes(), (4 * np.cumsum((symbols >= 0).sum(axis=1))).tolist()
        odd = (symbols >= size).any(axis=1).tolist()
        start = 0
        for k, end, strange, row in zip(where, ends, odd, symbols):
            if strange:
                own = [[c] if c < size else self.bytes[list(chr(c - size).encode())].tolist() for c in row[row >= 0].tolist()]
                out[k] = np.array([i for part in own for i in part], np.int32).tobytes()
            else:
                out[k] = raw[start:end]
            start = end

    def checked(self, chunks: list[str]) -> list[bytes]:
        """Ids of the chunks, each chunk starting with a word mark, compared with the library's."""
        ours = self.merge(chunks)
        # The library puts one mark in front itself; a text starting with a mark would get two.
        theirs = self.library.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        lone = np.frombuffer(ours[chunks.index(MARK)], np.int32).tolist() if MARK in chunks else []
        theirs = [lone if c == MARK else t for c, t in zip(chunks, theirs)]  # the empty text has no ids at all
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum())).tobytes()
        if flat != b"".join(ours) or not np.array_equal(4 * sizes, np.fromiter(map(len, ours), np.int64, len(ours))):
            for chunk, a, b in zip(chunks, ours, theirs):
                if a != np.array(b, np.int32).tobytes():
                    raise RuntimeError(f"chunk {chunk!r}: agenda {np.frombuffer(a, np.int32).tolist()}, library {b}")
        return ours


def chunks_of(text: str) -> list[str]:
    """The normalised text, cut before each run of word marks."""
    parts = text.replace(MARK, " ").split(" ")
    # A run of n blanks leaves n - 1 empty parts, which belong to the chunk after them.
    if "" not in parts:
        return [MARK + p for p in parts]
    out, marks = [], ""
    for p in parts:
        marks += MARK
        if p:
            out.append(marks + p)
            marks = ""
    return out + [marks] if marks else out


def encode(path: str) -> Callable:
    """Column function: text -> array of ids, without begin or end ids."""

    def run(batches):
        vocabulary, known = Vocabulary(path), Recent()
        for batch in batches:
            out, lengths = [], []
            for texts in slices(batch):
                cut = [chunks_of(t) if t else [] for t in texts]
                todo = known.missing({c for chunks in cut for c in chunks})
                for start in range(0, len(todo), 20_000):
                    some = todo[start:start + 20_000]
                    for chunk, ids in zip(some, vocabulary.checked(some)):
                        known.now[chunk] = ids
                ids_of = known.now.__getitem__
                joined = [b"".join(map(ids_of, chunks)) for chunks in cut]
                lengths += [len(b) // 4 for b in joined]
                out.append(b"".join(joined))
            offsets = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32)))

    return scalar(run, "array<int>")


def decode(path: str) -> Callable:
    """Column function: array of ids -> text."""

    def run(batches):
        vocabulary = Vocabulary(path)
        surface, library = pa.array(vocabulary.surface, pa.binary()), vocabulary.library
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            ids = batch.flatten()
            held, numbers = surface.take(ids), ids.to_numpy(zero_copy_only=False)
            texts, start = [], 0
            at = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1]
            raw = held.buffers()[2]
            for end in ends:
                own = raw[int(at[start]):int(at[end])].to_pybytes() if end > start else b""
                # The blank that encoding put in front goes again.
                text = (own[1:] if own[:1] == b" " else own).decode(errors="replace")
                if text != library.decode(numbers[start:end].tolist()):
                    raise RuntimeError(f"decoded text differs from the library's: {text[:200]!r}")
                texts.append(text)
                start = end
            yield pa.array(texts, pa.string())

    return scalar(run, "string")
