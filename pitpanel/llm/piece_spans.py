"""Ids of whole texts by a sentencepiece BPE model, with the original bytes that every piece came from, and back.

Output of `encoded`, one row per input row: doc_id, ids, begins, ends (each the little-endian unsigned 32-bit numbers
of all pieces) and, if asked for, decoded, the text that the ids give back. Piece i came from the bytes begins[i] to
ends[i], end exclusive, of the text in UTF-8.

How. The text is normalised by the longest prefix found in the model's compiled character map (a double-array trie,
walked for all characters of a slice at once), and every byte of the result remembers the original byte where its
prefix began. White space is then trimmed, escaped and prefixed as the model asks, and carries its source along. The
result is cut before each white-space mark that follows a visible character, where no piece of the model can lie
across; the distinct parts of a slice are merged side by side, in each round the best pair of every part. Pieces tile the normalised bytes, so
their ends, looked up in the source alignment, are spans of the original. A character without a piece becomes one piece per
byte: the last has the character's span, the others are empty before it.

Defined cases. Null or empty text: the begin and end ids alone. Null id: passed through. Repeated rows: one result
each. Empty table: no rows. Other columns of the input are ignored. A text of more than CHUNK bytes is worked through in
chunks cut at white space, with the same ids (where the model has no character map and trims nothing). Models of another
kind than BPE with byte fallback, or with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import arrowtext as at

SLICE = 2 << 20
CHUNK = 1 << 20
#: Parts of up to so many characters are merged together, longer ones one by one.
LONGEST = 64
NEVER = np.iinfo(np.int32).max
MARK = "▁"
MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)
#: Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message; nested ones and strings as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[i : i + size]
        i += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: 4 bytes of size, a double-array trie, zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.trie = np.frombuffer(blob[4 : 4 + size], "<u4")
        self.strings = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.strings == 0)
        at_ = np.arange(len(self.strings))
        self.length = (ends[np.searchsorted(ends, at_)] - at_) if len(ends) else np.zeros(len(self.strings), np.int64)

    @staticmethod
    def step(unit: np.ndarray) -> np.ndarray:
        return (unit >> np.uint32(10)) << ((unit & np.uint32(1 << 9)) >> np.uint32(6))

    def longest(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start: (length of the longest key there, 0 if none; place of its replacement)."""
        best, place = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        if not len(self.trie):
            return best, place
        live = np.arange(len(start))
        node = np.full(len(start), self.step(self.trie[:1])[0], np.uint32)
        depth = 0
        while len(live):
            inside = start[live] + depth < end[live]
            live, node = live[inside], node[inside]
            byte = data[start[live] + depth].astype(np.uint32)
            node = node ^ byte
            unit = self.trie[np.minimum(node, len(self.trie) - 1)]
            ok = (unit & np.uint32(0x800000FF)) == byte
            live, node, unit = live[ok], node[ok] ^ self.step(unit[ok]), unit[ok]
            depth += 1
            leaf = (unit >> np.uint32(8)) & np.uint32(1) == 1
            best[live[leaf]] = depth
            place[live[leaf]] = self.trie[node[leaf]] & np.uint32(0x7FFFFFFF)
        return best, place


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then the same for the others."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)


class Normaliser:
    def __init__(self, spec: bytes, suffix: bool = False):
        self.map, self.prefix, self.trim, self.escape, self.suffix = CharacterMap(b""), True, True, True, suffix
        for number, value in fields(spec):
            if number == 2:
                self.map = CharacterMap(value)
            elif number == 3:
                self.prefix = bool(value)
            elif number == 4:
                self.trim = bool(value)
            elif number == 5:
                self.escape = bool(value)

    def replaced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bytes after replacement, text of each, original byte of each, whether only spaces of its unit precede it)."""
        start = np.flatnonzero((data & 0xC0) != 0x80)
        text = np.searchsorted(offsets, start, side="right") - 1
        own = np.diff(np.append(start, len(data)))
        length, place = self.map.longest(data, start, offsets[text + 1])
        covered, gone = 0, []
        for k in np.flatnonzero(length > own):  # prefixes of several characters swallow the starts behind them
            if start[k] < covered:
                continue
            covered = start[k] + length[k]
            gone.append(np.arange(k + 1, np.searchsorted(start, covered)))
        keep = np.ones(len(start), bool)
        if gone:
            keep[np.concatenate(gone)] = False
        start, text, own, length, place = (x[keep] for x in (start, text, own, length, place))
        pool = np.concatenate([data, self.map.strings])
        found = length > 0
        first = np.where(found, len(data) + place, start)
        size = np.where(found, self.map.length[np.where(found, place, 0)] if len(self.map.length) else 0, own)
        out = pool[spread(first, size)]
        unit = np.repeat(np.arange(len(start)), size)
        black = np.flatnonzero(out != 0x20)
        begin = (np.cumsum(size) - size)[unit]
        to_black = np.searchsorted(black, begin)
        lead = np.arange(len(out)) < np.where(to_black < len(black), black[np.minimum(to_black, max(0, len(black) - 1))], len(out)) if len(black) else np.ones(len(out), bool)
        return out, text[unit], start[unit], lead

    def run(self, data: np.ndarray, offsets: np.ndarray, head: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(normalised bytes, offsets by text, original byte of each, original end of each text).

        `head` tells which texts begin a text, and so get the prefix; all by default.
        """
        n = len(offsets) - 1
        end = offsets[1:].copy()
        if len(self.map.trie) or self.trim:
            out, text, source, lead = self.replaced(data, offsets)
        else:  # every character stands for itself
            out = data
            text = np.repeat(np.arange(n), np.diff(offsets))
            source = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
            lead = None
        full = np.diff(offsets) > 0
        begin = offsets[:-1].copy()
        if self.trim:
            space = out == 0x20
            edge = np.ones(len(out), bool)
            edge[1:] = text[1:] != text[:-1]
            after = np.ones(len(out), bool)
            after[1:] = edge[1:] | space[:-1]
            blank = space & lead & after
            # Spaces at the head, each a unit of its own, move the source of the prefix.
            visible = np.flatnonzero(~blank)
            first = np.searchsorted(visible, np.searchsorted(text, np.arange(n)))
            has = first < len(visible)
            has[has] = text[visible[first[has]]] == np.flatnonzero(has)
            begin = np.where(has, source[visible[np.where(has, first, 0)]] if len(visible) else 0, end)
            full &= has
            keep = ~blank
            out, text, source = out[keep], text[keep], source[keep]
        if self.escape:
            size = np.where(out == 0x20, 3, 1)
            place = np.repeat(np.arange(len(out)), size)
            swapped = out[place] == 0x20
            grown = out[place]
            grown[swapped] = np.tile(MARK_BYTES, int(swapped.sum()) // 3)
            out, text, source = grown, text[place], source[place]
        mark = MARK_BYTES if self.escape else np.array([0x20], np.uint8)
        if self.trim and len(out):
            hit = np.zeros(len(out), bool)
            m = len(mark)
            if len(out) >= m:
                whole = np.logical_and.reduce([out[i : len(out) - m + 1 + i] == mark[i] for i in range(m)])
                for i in range(m):
                    hit[i : len(out) - m + 1 + i] |= whole
            bound = np.searchsorted(text, np.arange(n + 1))
            last = np.maximum.accumulate(np.where(hit, -1, np.arange(len(out))))
            tail = np.where(bound[1:] > bound[:-1], last[np.maximum(bound[1:] - 1, 0)], -1)
            stop = np.maximum(tail + 1, bound[:-1])
            cut = stop < bound[1:]
            end[cut] = source[stop[cut]]
            empty = stop == bound[:-1]
            end[empty & cut] = begin[empty & cut]
            full &= ~empty
            keep = np.arange(len(out)) < stop[text]
            out, text, source = out[keep], text[keep], source[keep]
        elif self.trim:
            full[:] = False
        extra = np.flatnonzero(full & (True if head is None else head)) if self.prefix else np.zeros(0, np.int64)
        if len(extra):
            bound = np.searchsorted(text, np.arange(n + 1))
            where = np.repeat(bound[extra + 1] if self.suffix else bound[extra], len(mark))
            out = np.insert(out, where, np.tile(mark, len(extra)))
            source = np.insert(source, where, np.repeat(end[extra] if self.suffix else begin[extra], len(mark)))
            text = np.insert(text, where, np.repeat(extra, len(mark)))
        return out, np.searchsorted(text, np.arange(n + 1)), source, end


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        spec, kinds, self.pieces, suffix, kind, fallback = b"", [], [], False, 1, False
        for number, value in fields(model):
            if number == 1:
                text, score, piece_kind = "", 0.0, NORMAL
                for k, v in fields(value):
                    text = v.decode() if k == 1 else text
                    score = struct.unpack("<f", v)[0] if k == 2 else score
                    piece_kind = v if k == 3 else piece_kind
                kinds.append(piece_kind)
                self.pieces.append(text)
                if piece_kind == NORMAL:
                    self.score[text], self.id[text] = score, len(kinds) - 1
            elif number == 2:
                trainer = dict(fields(value))
                kind, fallback, suffix = trainer.get(3, 1), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
            elif number == 3:
                spec = value
        if kind != BPE or not fallback or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces")
        self.kinds = np.array(kinds)
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.byte = np.zeros(256, np.uint32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte[int(self.pieces[i][3:5], 16)] = i
        self.normaliser = Normaliser(spec, suffix)
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k == NORMAL else b"" for p, k in zip(self.pieces, kinds)]
        self.size = np.array([len(x) for x in raw])
        shown = [x.replace(MARK.encode(), b" ") for x in raw]
        shown = [" ⁇ ".encode() if k == UNKNOWN else x for x, k in zip(shown, kinds)]
        self.shown_size = np.array([len(x) for x in shown])
        self.shown_first = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        #: No piece has a visible character before a mark, so that merges never cross the border before one.
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.pairs()

    def pairs(self) -> None:
        """All pairs of symbols whose union is a piece, sorted by key, with that piece and its rank by score.

        Symbols are the pieces and, numbered after them, single characters of pieces that are no piece.
        """
        self.symbol = dict(self.id)
        for c in sorted({c for p in self.id for c in p} - set(self.id)):
            self.symbol[c] = len(self.pieces) + len(self.symbol) - len(self.id)
        scores = sorted(set(self.score.values()), reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        found = [(a, b, i, rank[self.score[p]]) for p, i in self.id.items() for k in range(1, len(p)) if (a := self.symbol.get(p[:k])) is not None and (b := self.symbol.get(p[k:])) is not None]
        table = np.array(found, np.int64).reshape(-1, 4)
        key = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(key)
        self.pair_key, self.pair_union, self.pair_rank = key[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32)

    def looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, union) of each pair of symbols; NEVER where their union is no piece."""
        key = a.astype(np.int64) << 32 | b
        k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        ok = (self.pair_key[k] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.pair_rank[k], NEVER).astype(np.int32), self.pair_union[k]

    def side_by_side(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, their number by part): every round merges each part's best pair, the leftmost of ties."""
        code = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        kinds, which = np.unique(code, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), -1) for c in kinds.tolist()], np.int32)[which] if len(kinds) else np.zeros(0, np.int32)
        part = np.repeat(np.arange(len(parts)), size)
        rank, union = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(part[1:] == part[:-1])
        rank[inner], union[inner] = self.looked_up(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.minimum.reduceat(rank, start)
            lengths = np.diff(np.append(start, len(sym)))
            live = np.repeat(best < NEVER, lengths)
            done.append((sym[~live], code[~live], part[~live]))
            hit = np.flatnonzero((rank == np.repeat(best, lengths)) & live)
            hit = hit[np.append(True, part[hit[1:]] != part[hit[:-1]])] if len(hit) else hit
            sym[hit] = union[hit]
            live[hit + 1] = False
            rank[hit] = NEVER
            moved = np.cumsum(live) - 1
            sym, code, part, rank, union = sym[live], code[live], part[live], rank[live], union[live]
            at_ = moved[hit]
            right = at_[(at_ + 1 < len(sym)) & (part[np.minimum(at_ + 1, len(sym) - 1)] == part[at_])] if len(at_) else at_
            left = at_[(at_ > 0) & (part[at_ - 1] == part[at_])] - 1 if len(at_) else at_
            for k in (right, left):
                rank[k], union[k] = self.looked_up(sym[k], sym[k + 1])
        if not done:
            return np.zeros(0, "<u4"), size
        sym, code, part = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(part, kind="stable")
        sym, code, part = sym[order], code[order], part[order]
        count = np.ones(len(sym), np.int64)
        lone = np.flatnonzero((sym < 0) | (sym >= len(self.pieces)))
        if len(lone):
            raw = [chr(c).encode() for c in code[lone].tolist()]
            count[lone] = [len(x) for x in raw]
            place = np.cumsum(count) - count
            sym = np.repeat(sym, count)
            sym[spread(place[lone], count[lone])] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return sym.astype("<u4"), np.bincount(part, count, len(parts)).astype(np.int64)

    def merged(self, part: str) -> bytes:
        """Ids of one part: the adjacent pair whose union has the best score becomes one, the leftmost of ties, until none has one."""
        symbol, score = list(part), self.score
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[p], i, i + 1, 2) for i in range(n - 1) if (p := symbol[i] + symbol[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbol[i] or not symbol[j] or len(symbol[i]) + len(symbol[j]) != size:
                continue
            symbol[i] += symbol[j]
            symbol[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (p := symbol[a] + symbol[b]) in score:
                    heapq.heappush(heap, (-score[p], a, b, len(p)))
        ids = []
        for s in symbol:
            if s in self.id:
                ids.append(self.id[s])
            elif s:
                ids.extend(self.byte[b] for b in s.encode())
        return np.array(ids, "<u4").tobytes()

    def known(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, their number by part)."""
        long = [k for k, p in enumerate(parts) if len(p) > LONGEST]
        if not long:
            return self.side_by_side(parts)
        ids, count = self.side_by_side([p if len(p) <= LONGEST else "" for p in parts])
        extra = [np.frombuffer(self.merged(parts[k]), "<u4") for k in long]
        place = (np.cumsum(count) - count)[long]
        count[long] = [len(x) for x in extra]
        return np.insert(ids, np.repeat(place, count[long]), np.concatenate(extra)), count

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of chunks, text of each): long texts are cut before a space after a visible character."""
        whole = len(self.normaliser.map.trie) or self.normaliser.trim or not self.separable or self.normaliser.suffix
        if whole or np.diff(offsets).max(initial=0) <= CHUNK:
            return offsets, np.arange(len(offsets) - 1)
        cuts, text = [0], []
        for k, (i, j) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            while j - i > CHUNK:
                space = data[i + 1 : j] == 0x20
                space &= (data[i : j - 1] != 0x20) & (data[i : j - 1] != MARK_BYTES[2])
                later = np.flatnonzero(space[CHUNK:])
                if not len(later):
                    break
                i += CHUNK + 1 + int(later[0])
                cuts.append(i), text.append(k)
            cuts.append(j), text.append(k)
        return np.array(cuts), np.array(text)

    def encode(self, texts: pa.Array, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, ...]:
        """(ids of all texts, begins, ends in the bytes of each text, offsets by text)."""
        data, text_offsets = at.flat(texts)
        n = len(text_offsets) - 1
        offsets, owner = self.chunks(data, text_offsets)
        head = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
        norm, bound, source, stop = self.normaliser.run(data, offsets, head)
        mark = np.zeros(len(norm), bool)
        if self.separable and len(norm) >= 3:
            mark[:-2] = (norm[:-2] == MARK_BYTES[0]) & (norm[1:-1] == MARK_BYTES[1]) & (norm[2:] == MARK_BYTES[2])
        cut = mark.copy()
        cut[3:] &= ~mark[:-3]
        cut[bound[:-1][np.diff(bound) > 0]] = True
        starts = np.flatnonzero(cut)
        parts = at.strings(norm, np.append(starts, len(norm))).dictionary_encode()
        pool, length = self.known(parts.dictionary.to_pylist())
        which = parts.indices.to_numpy(zero_copy_only=False)
        count = length[which]
        ids = pool[spread((np.cumsum(length) - length)[which], count)]
        first = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, bound)]  # by chunk
        # Pieces tile the normalised bytes; bytes of one character share its place.
        tail = np.cumsum(self.size[ids])
        begin = tail - self.size[ids]
        chunk = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        lone = self.kinds[ids] == BYTE
        char = np.flatnonzero((norm & 0xC0) != 0x80)
        at_char = np.searchsorted(char, begin[lone], side="right") - 1
        begin[lone] = char[at_char]
        last = tail[lone] == np.append(char, len(norm))[at_char + 1]
        tail[lone] = np.where(last, tail[lone], begin[lone])
        padded = np.append(source, 0)
        begins = padded[begin] - text_offsets[owner[chunk]]
        ends = np.where(tail == bound[chunk + 1], stop[chunk], padded[tail]) - text_offsets[owner[chunk]]
        ends[lone] = np.where(last, ends[lone], begins[lone])
        by_text = first[np.searchsorted(owner, np.arange(n + 1))]
        if bos:
            ids, begins, ends = (np.insert(x, by_text[:-1], v) for x, v in ((ids, self.bos), (begins, 0), (ends, 0)))
            by_text = by_text + np.arange(n + 1)
        if eos:
            size = np.diff(text_offsets)
            ids, begins, ends = (np.insert(x, by_text[1:], v) for x, v in ((ids, self.eos), (begins, size), (ends, size)))
            by_text = by_text + np.arange(n + 1)
        return ids, begins, ends, by_text

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets by text): the pieces' text, marks as spaces, one mark at the head dropped."""
        n = len(offsets) - 1
        shows = np.flatnonzero(self.shown_size[ids] > 0)
        head = np.searchsorted(shows, offsets[:-1])
        ok = head < len(shows)
        ok[ok] = shows[head[ok]] < offsets[1:][ok]
        lead = shows[head[ok]]
        size, first = self.shown_size[ids].copy(), self.shown_first[ids].copy()
        if self.normaliser.prefix or self.normaliser.trim:
            lead = lead[(self.kinds[ids[lead]] == NORMAL) & (self.shown[self.shown_first[ids[lead]]] == 0x20)]
            lead = lead[np.array([self.pieces[i].startswith(MARK) for i in ids[lead].tolist()], bool)]
            size[lead] -= 1
            first[lead] += 1
        out = self.shown[spread(first, size)]
        total = np.concatenate([[0], np.cumsum(size)])[offsets]
        bad = []
        if n and (self.kinds[ids] == BYTE).any():
            for k in np.unique(np.searchsorted(offsets, np.flatnonzero(self.kinds[ids] == BYTE), side="right") - 1).tolist():
                try:
                    out[total[k] : total[k + 1]].tobytes().decode()
                except UnicodeDecodeError:
                    bad.append(k)
        if not bad:
            return out, total
        texts = [out[i:j].tobytes() for i, j in zip(total, total[1:])]
        for k in bad:
            texts[k] = self.mended(ids[offsets[k] : offsets[k + 1]].tolist())
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def mended(self, ids: list[int]) -> bytes:
        """A text with bytes that make no character: each of them is shown as U+FFFD."""
        out, run, at_head = [], b"", self.normaliser.prefix or self.normaliser.trim
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run += bytes([int(self.pieces[i][3:5], 16)])
                continue
            while run:
                for size in range(1, 5):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                run = run[size:]
                at_head = False
            if i >= 0 and self.kinds[i] != CONTROL:
                shown = " ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i]
                out.append((shown[1:] if at_head and shown.startswith(MARK) else shown).replace(MARK, " "))
                at_head = False
        return "".join(out).encode()


def column(x: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(x, "<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets * 4, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def shared_model(docs: DataFrame, path: str):
    with open(path, "rb") as f:  # a file of the driver's; half a MB whatever the input
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, decode: bool = False) -> DataFrame:
    """doc_id, ids, begins, ends and, if asked for, decoded for every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = shared_model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for part in at.slices(batches, "text", SLICE):
            ids, begins, ends, offsets = codec.encode(part.column("text"), bos, eos)
            out = {"doc_id": part.column("doc_id"), "ids": column(ids, offsets), "begins": column(begins, offsets), "ends": column(ends, offsets)}
            if decode:
                out["decoded"] = at.strings(*codec.decode(ids, offsets)).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    ddl = f"doc_id {dict(texts.dtypes)['doc_id']}, ids binary, begins binary, ends binary" + (", decoded string" if decode else "")
    return texts.mapInArrow(run, ddl)


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded, the text of each row's ids (little-endian unsigned 32-bit numbers; null gives an empty text)."""
    ids_of = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(ids_col, F.expr("X''")).alias("ids"))
    model = shared_model(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for part in at.slices(batches, "ids", SLICE):
            own = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column("ids")]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            text = codec.decode(np.concatenate([*own, np.zeros(0, "<u4")]).astype(np.int64), offsets)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "decoded": at.strings(*text).cast(pa.string())})

    return ids_of.mapInArrow(run, f"doc_id {dict(ids_of.dtypes)['doc_id']}, decoded string")
