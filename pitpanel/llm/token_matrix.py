"""Token ids packed into matrices: best-fit-decreasing with a segment tree, lossless cuts, binary shards.

A text's ids end in end_id; longer ones are cut into pieces of `capacity` tokens, of which the first may be shorter.
Pieces are dealt at random into groups of about GROUP, each of which becomes one shard: the rows of a matrix of
token ids (padded with pad_id), the cumulative lengths of the segments in each row, and position numbers that start
again at every segment. `packed_rows` returns a row per matrix row; `shards` joins a group's rows into numpy files as
binary columns, with the position numbers; `unpacked` gives back every document's ids. Ids take ID_BYTES bytes each,
little-endian; a larger id raises ValueError.

Defined cases. Null or empty text: one segment that holds the end id alone. Null id: passed through. Repeated
rows: each is packed. Empty table: no rows. Other columns of the input are ignored. Ties of length: the order in
which pieces come.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import tokens

GROUP = 4096
ID_BYTES = 2


class Capacities:
    """Segment tree over the free room of open rows; a node counts the rows below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self.move(room, 1)

    def move(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the open row with the least room that holds `need`, taken out."""
        k = need + self.size
        while not self.count[k]:
            # Up until there is a sibling to the right, then over to it.
            while k & 1:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        self.move(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Pieces of each row, in the order in which they were put there."""
    tree, rows = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[i])
        if got is None:
            rows.append([])
            got = capacity, len(rows) - 1
        room, row = got
        rows[row].append(i)
        tree.add(room - lengths[i], row)
    return rows


def dealt(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, group: int, id_bytes: int) -> DataFrame:
    """shard, doc_id, piece, length, ids: pieces dealt over shards of about `group`, a shard to a partition."""
    texts = tokens.texts(docs, id_col, text_col)
    rows, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    groups = max(1, -(-(rows + (chars or 0) // capacity) // group))
    cut = tokens.pieces(texts.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("rid"))), path, capacity, end_id, id_bytes)
    found = cut.select(F.pmod(F.xxhash64("doc_id.rid", "piece"), F.lit(groups)).cast("long").alias("shard"), F.col("doc_id.doc_id").alias("doc_id"), "piece", "length", "ids")
    return found.repartition(groups, "shard")


def rows_of(part: pd.DataFrame, capacity: int, pad_id: int, id_bytes: int) -> list[tuple]:
    """(row, n_tokens, doc_ids, pieces, cu_seqlens, ids) of one shard's pieces, packed."""
    part = part.sort_values("length", ascending=False, kind="stable").reset_index(drop=True)
    length, ids = part["length"].tolist(), part["ids"].tolist()
    doc, piece = part["doc_id"].astype(object).where(part["doc_id"].notna(), None).tolist(), part["piece"].tolist()
    pad = np.array([pad_id], f"<u{id_bytes}").tobytes()
    out = []
    for r, own in enumerate(best_fit_decreasing(length, capacity)):
        edge = [0]
        for i in own:
            edge.append(edge[-1] + length[i])
        row = b"".join(ids[i] for i in own) + pad * (capacity - edge[-1])
        out.append((r, edge[-1], [doc[i] for i in own], [piece[i] for i in own], edge, row))
    return out


def packed_rows(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, pad_id: int = 0, group: int = GROUP,
    id_bytes: int = ID_BYTES,
) -> DataFrame:
    """shard, row, n_tokens, doc_ids, pieces, cu_seqlens (where positions start again), ids (padded to the capacity)."""
    kind = dict(docs.dtypes)[id_col]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        return pd.DataFrame([(shard, *r) for r in rows_of(part, capacity, pad_id, id_bytes)], columns=["shard", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids"])

    ddl = f"shard long, row int, n_tokens long, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, ids binary"
    return dealt(docs, path, id_col, text_col, capacity, end_id, group, id_bytes).groupBy("shard").applyInPandas(run, ddl)


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


FILES = "shard long, n_rows long, n_pieces long, n_tokens long, ids binary, positions binary, cu_seqlens binary"


def files_of(shard: int, ids: list[bytes], edges: list, id_bytes: int) -> tuple:
    matrix = np.stack([np.frombuffer(x, f"<u{id_bytes}") for x in ids])
    width, place, cumulative = matrix.shape[1], np.zeros(matrix.shape, np.int32), [np.zeros(1, np.int64)]
    pieces = tokens_ = 0
    for k, edge in enumerate(edges):
        edge = np.asarray(edge, np.int64)
        place[k, : edge[-1]] = np.arange(edge[-1]) - np.repeat(edge[:-1], np.diff(edge))
        own = edge[1:] if edge[-1] == width else np.append(edge[1:], width)
        cumulative.append(own + k * width)
        pieces, tokens_ = pieces + len(edge) - 1, tokens_ + int(edge[-1])
    return shard, len(ids), pieces, tokens_, npy(matrix), npy(place), npy(np.concatenate(cumulative))


def shards(rows: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """shard, n_rows, n_pieces, n_tokens and three numpy files made of packed rows: the id matrix, the matrix of positions (which
    start again at every segment), and the cumulative lengths of all segments of the shard, padding being a segment of its own."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        return pd.DataFrame([files_of(int(part["shard"].iloc[0]), part["ids"].tolist(), part["cu_seqlens"].tolist(), id_bytes)], columns=[c.split()[0] for c in FILES.split(", ")])

    return rows.groupBy("shard").applyInPandas(run, FILES)


def packed_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, pad_id: int = 0, group: int = GROUP,
    id_bytes: int = ID_BYTES,
) -> DataFrame:
    """`shards` of `packed_rows`, both in one step: pieces cross one exchange, ids are joined where they are packed."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = rows_of(part, capacity, pad_id, id_bytes)
        return pd.DataFrame([files_of(int(part["shard"].iloc[0]), [r[5] for r in rows], [r[4] for r in rows], id_bytes)], columns=[c.split()[0] for c in FILES.split(", ")])

    return dealt(docs, path, id_col, text_col, capacity, end_id, group, id_bytes).groupBy("shard").applyInPandas(run, FILES)


def write_shards(found: DataFrame, path: str) -> None:
    """One folder per kind of file and one row per shard: binary Parquet columns, which tasks write and a retry overwrites."""
    for c in ("ids", "positions", "cu_seqlens"):
        found.select("shard", F.col(c).alias("npy")).write.parquet(f"{path}/{c}")


def unpacked(rows: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """doc_id, piece, ids: the segments of every row, for a round trip."""
    part = rows.select("ids", F.posexplode("doc_ids").alias("k", "doc_id"), "pieces", "cu_seqlens")
    return part.select(
        "doc_id", F.col("pieces")[F.col("k")].alias("piece"),
        F.expr(f"substring(ids, {id_bytes} * cu_seqlens[k] + 1, {id_bytes} * (cu_seqlens[k + 1] - cu_seqlens[k]))").alias("ids"),
    )
