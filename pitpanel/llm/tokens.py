"""Token ids of whole texts inside a task, and their cut into pieces.

A text is cut before a single space or line feed that stands between two visible characters, and between an
ASCII letter and an ASCII mark. The public byte-level tokenizer's own rule cuts there too, so the ids of the parts are the ids of the text, and each
distinct part is encoded once. Texts with any other white space than ASCII, and texts that hold an added token of
the tokenizer (<|endoftext|>, which it maps to one id wherever it stands), are encoded in one go.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import arrowtext as at

OTHER_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Bytes of text that are cut into parts at once: more parts recur in a larger slice.
SLICE = 8 << 20
CACHE = 500_000
#: Parts that go to the tokenizer in one call.
AT_ONCE = 4096

LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Encoder:
    """Ids of texts by a tokenizer's JSON; parts seen before are looked up."""

    def __init__(self, rule: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(rule)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncut = "|".join([OTHER_SPACE, *map(re.escape, added)])
        self.forget()

    def forget(self) -> None:
        """Parts seen: number by text; ids of all of them, and where each one's begin."""
        self.seen: dict[str, int] = {}
        self.pool, self.edge = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def parts(self, units: list[str]) -> np.ndarray:
        """The number of each unit; those not seen before are encoded, in bounded batches, as the tokenizer's own results are large."""
        if len(self.seen) > CACHE:
            self.forget()
        known = np.fromiter(map(self.seen.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(known < 0)
        pools, sizes = [self.pool], []
        for i in range(0, len(new), AT_ONCE):
            some = [units[k] for k in new[i : i + AT_ONCE].tolist()]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes += map(len, ids)
            pools.append(np.fromiter(chain.from_iterable(ids), np.uint32))
            self.seen.update(zip(some, range(len(self.seen), len(self.seen) + len(some))))
        if len(new):
            known[new] = np.arange(len(self.edge) - 1, len(self.edge) - 1 + len(new))
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])
            self.pool = np.concatenate(pools)
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text). A null text has no ids."""
        data, offsets = at.flat(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        white = at.WHITE[data]
        cut = (data == 0x20) | (data == 0x0A)
        cut[1:] &= ~white[:-1]
        cut[:-1] &= ~white[1:]
        cut[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
        cut[0] = cut[-1] = False
        inner = offsets[:-1][np.diff(offsets) > 0]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        cut[last] &= ~white[last]  # a space that ends a text has no visible character after it
        for k in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.uncut), False).to_numpy(zero_copy_only=False)):
            cut[offsets[k] : offsets[k + 1]] = False
        cut[inner] = True
        starts = np.flatnonzero(cut)
        units = at.strings(data, np.append(starts, len(data))).dictionary_encode()
        known = self.parts(units.dictionary.to_pylist())
        which = known[units.indices.to_numpy(zero_copy_only=False)]
        first = self.edge[which]
        size = self.edge[which + 1] - first
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(total[-1]) + np.repeat(first - total[:-1], size)]
        return ids, total[np.searchsorted(starts, offsets)]


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `most` tokens but the first, which takes the rest."""
    head = n % most or most
    return [(0, head)] + [(i, most) for i in range(head, n, most)]


def pieces(docs: DataFrame, path: str, most: int, end_id: int, id_bytes: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (of little-endian 32-bit ids); or, with id_bytes 2 or 4, ids
    as so many little-endian bytes each instead of the checksum. A text's ids end in end_id."""
    kind = dict(docs.dtypes)["doc_id"]
    with open(path, encoding="utf-8") as f:  # a file of the driver's; a few MB whatever the input
        rule = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rule.value)
        for part in at.slices(batches, "text", SLICE):
            ids, offsets = encoder.encode(part.column("text"))
            row, number, start, length, crc, raw = [], [], [], [], [], []
            for k in range(part.num_rows):
                own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                if id_bytes == 2 and own.max() > 0xFFFF:
                    raise ValueError("an id needs more than two bytes")
                own = own.astype("<u2") if id_bytes == 2 else own
                for p, (i, m) in enumerate(cuts(len(own), most)):
                    b = own[i : i + m].tobytes()
                    row.append(k), number.append(p), start.append(i), length.append(m)
                    raw.append(b) if id_bytes else crc.append(zlib.crc32(b))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(number, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            } | ({"ids": pa.array(raw, pa.binary())} if id_bytes else {"ids_crc32": pa.array(crc, pa.int64())}))

    ddl = f"doc_id {kind}, piece int, start long, length long, " + ("ids binary" if id_bytes else "ids_crc32 long")
    return docs.mapInArrow(run, ddl)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
