"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

A text's pieces never reach past a word's start mark, so its lattice falls apart into chunks. For each distinct chunk the
forward filter sums the weights of all ways to every place, once; the arcs that end at a place get cumulative shares of
what flows through them. Backward sampling then walks all chunks of a slice of texts at once, choosing each arc by a
hash of the row's key, the chunk's place in the text and the step: the same key gives the same segmentation anywhere.
A chunk may be as long as its text. Of a long one only the forward weights are kept; its arcs are found block by block,
forward and once more on the way back, over the edges of blocks, so that its time is linear and its arcs take one block.

The weight of a piece is exp(alpha * score), as its model file scores it. Characters that no piece spells are spelled by
byte pieces, so that decoding gives back every text.

Defined cases: a null or empty text has no pieces; repeated rows with one key get one segmentation; a null key counts as
key 0; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import M3, arrow_map, mix, unit

#: Chunk lattices that a worker keeps; when full it starts anew (only speed depends on it).
CACHE_CHUNKS = 160_000
#: As many places of theirs, at most.
CACHE_NODES = 2_000_000
SPACE = "▁"
#: Stands for the mark where a text spells it itself: a lone surrogate, which no valid text holds.
_SPELLED = "\udc81"
#: Characters that the table of pieces knows; chunks with others are looked up piece by piece.
TRIE_CHARS = 208
#: A longer chunk isn't kept, and goes block by block.
CHUNK_CHARS = 512
BLOCK_CHARS = 4096

_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def utf8_byte(code: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Byte k of the UTF-8 form of each code point."""
    n = utf8_size(code)
    lead = np.choose(n - 1, [code, 0xC0 | code >> 6, 0xE0 | code >> 12, 0xF0 | code >> 18])
    return np.where(k == 0, lead, 0x80 | (code >> 6 * np.maximum(n - 1 - k, 0)) & 0x3F)


def utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


class Lattices:
    """Arcs of chunk lattices in flat arrays: for each node (a place in a chunk) its arcs back, with cumulative shares."""

    def __init__(self, path: str, alpha: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha = alpha
        self.piece: dict[str, int] = {}
        self.bytes_: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        score = np.full(model.get_piece_size() + 1, -np.inf)  # the last stands for no piece
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_.append(b"")
            else:
                self.piece[piece] = i
                score[i] = max(model.get_score(i), -40_000.0)
                self.bytes_.append(piece.replace(SPACE, " ").encode())
        self.score = alpha * score
        self.longest = max(map(len, self.piece), default=1)
        self.byte_score = float(self.score[np.isfinite(self.score)].min(initial=0.0)) - 10.0 * alpha
        self.plant()
        self.clear()

    def plant(self) -> None:
        """A trie over the pieces that the commonest characters spell, as one table: row 0 is dead, row 1 the root."""
        common = [c for c, _ in Counter("".join(self.piece)).most_common(TRIE_CHARS)]
        self.column = {c: i for i, c in enumerate(sorted(common))}
        rows: list[dict[int, int]] = [{}, {}]
        ends = [-1, -1]
        for piece, number in self.piece.items():
            at = 1
            for c in piece:
                col = self.column.get(c)
                if col is None:
                    break
                if col not in rows[at]:
                    rows[at][col] = len(rows)
                    rows.append({})
                    ends.append(-1)
                at = rows[at][col]
            else:
                ends[at] = number
        self.child = np.zeros((len(rows), TRIE_CHARS + 1), np.int32)  # the last column: characters of no piece
        for i, row in enumerate(rows):
            self.child[i, list(row)] = list(row.values())
        self.ends = np.array(ends, np.int64)
        self.columns = np.array(sorted(map(ord, self.column)), np.int64)
        self.rare = np.array(sorted(ord(c) for c in set("".join(self.piece)) - set(common)), np.int64)

    def pieces_of(self, part: list[str], code: np.ndarray, span: int) -> np.ndarray:
        """[chunk, end, size - 1]: the piece of so many characters that ends there, or -1."""
        m, n = code.shape
        ids = np.full((m, n, span), -1, np.int64)
        at = np.minimum(np.searchsorted(self.columns, code), len(self.columns) - 1)
        known = self.columns[at] == code
        at = np.where(known, at, TRIE_CHARS)
        plain = (known | (self.rare[np.minimum(np.searchsorted(self.rare, code), len(self.rare) - 1)] != code)).all(axis=1) if len(self.rare) else np.ones(m, bool)
        rows = np.nonzero(plain)[0]
        if len(rows):
            col, own = at[rows], np.full((len(rows), n, span), -1, np.int64)
            state = np.ones((len(rows), n), np.int32)
            for size in range(1, span + 1):
                state = self.child[state[:, : n - size + 1], col[:, size - 1 :]]
                own[:, size - 1 :, size - 1] = self.ends[state]
                if not state.any():
                    break
            ids[rows] = own
        for r in np.nonzero(~plain)[0].tolist():
            c = part[r]
            for size in range(1, span + 1):
                ids[r, size - 1 :, size - 1] = [self.piece.get(c[e - size : e], -1) for e in range(size, n + 1)]
        return ids

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.nodes = 0
        self.parts: list[tuple[np.ndarray, ...]] = []  # shares, back nodes, ids, and each node's number of arcs
        self.frozen = None

    def arcs(self, part: list[str], span: int) -> tuple[np.ndarray, np.ndarray]:
        """[chunk, end, size - 1] over strings of one length: piece ids (-1 - c for a character c in bytes) and log weights."""
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), -1).astype(np.int64)
        ids = self.pieces_of(part, code, span)
        code = np.where(code == ord(_SPELLED), ord(SPACE), np.where(code == ord(SPACE), ord(" "), code))
        spelled = ids[:, :, 0] < 0
        gain = self.score[ids]
        gain[:, :, 0] = np.where(spelled, self.byte_score * utf8_size(code), gain[:, :, 0])
        ids[:, :, 0] = np.where(spelled, -1 - code, ids[:, :, 0])
        return ids, gain

    def sample_long(self, chunk: str, seed: np.uint64) -> np.ndarray:
        """One segmentation of a chunk of any length, as `arcs` numbers it."""
        n, span = len(chunk), min(len(chunk), self.longest)
        size = max(BLOCK_CHARS, span)

        def block(a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
            low = max(0, a - span + 1)
            ids, gain = self.arcs([chunk[low:z]], span)
            return ids[0, a - low :], gain[0, a - low :]

        weight = np.full(n + 1, -np.inf)
        weight[0] = 0.0
        for a in range(0, n, size):
            _, gain = block(a, min(n, a + size))
            for e in range(a + 1, min(n, a + size) + 1):
                w = min(e, span)
                flow = weight[e - w : e][::-1] + gain[e - 1 - a, :w]
                top = flow.max()
                weight[e] = top + np.log(np.exp(flow - top).sum())
        out: list[int] = []
        e = n
        for a in reversed(range(0, n, size)):
            if e <= a:
                continue
            ids, gain = block(a, min(n, a + size))
            u = unit(mix(seed + np.arange(len(out) + 1, len(out) + 1 + e - a, dtype=np.uint64)))
            turn = 0
            while e > a:
                w = min(e, span)
                flow = weight[e - w : e][::-1] + gain[e - 1 - a, :w]
                run = np.cumsum(np.exp(flow - flow.max()))
                k = int(np.searchsorted(run, u[turn] * run[-1]))
                out.append(int(ids[e - 1 - a, k]))
                e -= k + 1
                turn += 1
        return np.array(out[::-1], np.int64)

    def add(self, chunks: list[str]) -> None:
        """The forward filter over lattices of chunks, those of one length at once."""
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c), []).append(c)
        for n, group in by_length.items():
            span = min(n, self.longest)
            for k in range(0, len(group), max(1, 200_000 // (n * span))):
                part = group[k : k + max(1, 200_000 // (n * span))]
                m = len(part)
                ids, gain = self.arcs(part, span)
                there = ids >= 0
                there[:, :, 0] = True
                weight = np.full((m, n + 1), -np.inf)  # log of all ways to each place
                weight[:, 0] = 0.0
                share = np.zeros((m, n, span))
                for e in range(1, n + 1):
                    w = min(e, span)
                    flow = weight[:, e - w : e][:, ::-1] + gain[:, e - 1, :w]
                    top = flow.max(axis=1, keepdims=True)
                    run = np.cumsum(np.exp(flow - top), axis=1)
                    weight[:, e] = top[:, 0] + np.log(run[:, -1])
                    share[:, e - 1, :w] = run / run[:, -1:]
                node = self.nodes + np.arange(m * n).reshape(m, n, 1)
                size = np.arange(1, span + 1)
                inside = size <= np.arange(1, n + 1)[:, None]
                back = np.where(size < np.arange(1, n + 1)[:, None], node - size, -1)
                there &= inside
                # The last arc of a node takes what rounding leaves.
                last = span - 1 - np.argmax(there[:, :, ::-1], axis=2)
                np.put_along_axis(share, last[:, :, None], 1.0, axis=2)
                self.parts.append((share[there], back[there], ids[there], there.sum(axis=2).ravel()))
                self.chunks.update(zip(part, (self.nodes + n - 1 + n * np.arange(m)).tolist()))
                self.nodes += m * n
        self.frozen = None

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Shares, back nodes and ids of arcs, and the first arc of each node."""
        if self.frozen is None:
            self.parts = self.parts or [(np.zeros(0), *(np.zeros(0, np.int64) for _ in range(3)))]
            self.parts = [tuple(np.concatenate(p) for p in zip(*self.parts))]
            share, back, ids, count = self.parts[0]
            self.frozen = share, back, ids, np.cumsum(count) - count
        return self.frozen

    def sample(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """One segmentation of each text, as piece ids."""
        if len(self.chunks) > CACHE_CHUNKS or self.nodes > CACHE_NODES:
            self.clear()
        found = [_CHUNK.findall(SPACE + t.replace(SPACE, _SPELLED).replace(" ", SPACE)) if t else [] for t in texts]
        count = np.array(list(map(len, found)))
        flat = [c for f in found for c in f]
        if not flat:
            return [np.zeros(0, np.int64) for _ in texts]
        fresh = [c for c in set(flat) if c not in self.chunks and len(c) <= CHUNK_CHARS]
        if fresh:
            self.add(fresh)
        share, back, ids, first = self.arrays()
        at = np.fromiter((self.chunks.get(c, -1) for c in flat), np.int64, len(flat))
        large = {int(i): np.zeros(0, np.int64) for i in np.nonzero(at < 0)[0]}
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        key = np.repeat(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64), count)
        seed = mix(mix(key + M3) + place.astype(np.uint64))
        for i in large:
            large[i] = self.sample_long(flat[i], seed[i])
        live, steps, owners = np.nonzero(at >= 0)[0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(live):
            u = unit(mix(seed[live] + np.uint64(len(steps))))
            arc = first[at[live]]
            open_ = np.nonzero(share[arc] < u)[0]
            while len(open_):  # a node's last arc has share 1
                arc[open_] += 1
                open_ = open_[share[arc[open_]] < u[open_]]
            steps.append(arc)
            owners.append(live)
            at[live] = back[arc]
            live = live[back[arc] >= 0]
        arc, owner = np.concatenate(steps), np.concatenate(owners)
        turn = np.repeat(np.arange(len(steps)) - 1, [len(x) for x in steps])
        taken = np.bincount(owner, minlength=len(flat))
        taken[list(large)] = list(map(len, large.values()))
        ends = np.cumsum(taken)
        ordered = np.empty(int(ends[-1]), np.int64)
        ordered[ends[owner] - 1 - turn] = ids[arc]  # steps go backward
        for i, own in large.items():
            ordered[ends[i] - taken[i] : ends[i]] = own
        n = np.where(ordered >= 0, 1, utf8_size(-1 - ordered))
        text_of = np.repeat(np.repeat(np.arange(len(texts)), count), taken)
        size = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
        out = np.repeat(ordered, n)
        raw = np.nonzero(out < 0)[0]
        if len(raw):
            k = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
            out[raw] = self.byte_id[utf8_byte(-1 - out[raw], k[raw])]
        return np.split(out, np.cumsum(size)[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text that pieces spell, without the mark put before it."""
        raw = b"".join(map(self.bytes_.__getitem__, ids.tolist()))
        return raw[1:].decode() if raw else ""


@lru_cache(maxsize=2)
def lattices(path: str, alpha: float) -> Lattices:
    return Lattices(path, alpha)


def sampled(docs: DataFrame, path: str, alpha: float = 0.002, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_crc32, lossless) of one sampled segmentation of every text; with `ids`, its pieces."""
    fields = [("n_chars", "long"), ("n_pieces", "long"), ("ids_crc32", "long"), ("lossless", "boolean"), ("ids", "array<int>")]
    fields = fields if ids else fields[:-1]

    def make():
        grid = lattices(path, alpha)

        def run(keys: list, texts: list) -> list:
            texts = [t or "" for t in texts]
            found = grid.sample([k or 0 for k in keys], texts)
            same = [grid.decode(i) == t for i, t in zip(found, texts)]
            out = [list(map(len, texts)), list(map(len, found)), [zlib.crc32(i.astype("<u4").tobytes()) for i in found], same, list(found)]
            return out[: len(fields)]

        return run

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(plain, ["doc_id"], ["doc_id", "text"], fields, make, limit=2 << 20)
