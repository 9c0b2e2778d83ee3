"""Order statistics of many nested row sets from one sort: fold f of a target holds the rows of all eras before f.

The rows are put in order once, by (target, x, ties), and kept as runs: some ten thousand rows as one compressed value each, with
how many rows of each era they hold. The ranks of a run's rows in every fold follow from the counts of the runs before it, so no row
is copied per fold and no window runs. What is not in that order, quantiles of ratios, is found by counting the leading bits of the
values, a few bits more in each pass, until few rows are left at the wanted ranks. Nothing is sampled or approximated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitpanel.operators.packs import matrix, squeezed
from pitpanel.session import materialise

RUN_ROWS = 1 << 16
SLICE_ROWS = 500_000
#: Leading bits of a value that are counted, pass by pass; then the values themselves.
BITS = (20, 25)
#: Counted cells that wait in a task.
CELLS = 1 << 20


def in_runs(rows: DataFrame, tie: list[str]) -> "Runs":
    """Rows (target, era, x, y, ties) in order, as runs; x and y are doubles without nulls."""
    rows = materialise(rows, "rows")
    spark = rows.sparkSession
    eras = [r[0] for r in rows.select("era").distinct().orderBy("era").collect()]  # a few dozen
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    # A sorted list of eras, so a row's place in it is its code.
    code = F.array_position(F.array(*[F.lit(e) for e in eras]) if eras else F.array().cast("array<long>"), F.col("era")).cast("double") - 1
    dealt = rows.repartitionByRange(slices, "target", "x", *tie).sortWithinPartitions("target", "x", *tie).select("target", "x", "y", code.alias("e"))
    n_eras, most = len(eras), RUN_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, seq, waiting, held, of = TaskContext.get().partitionId(), 0, [], 0, None

        def out():
            m = np.concatenate(waiting)
            return pa.RecordBatch.from_pydict({
                "slice": pa.array([place], pa.int32()), "seq": pa.array([seq], pa.int32()), "target": pa.array([of], pa.string()), "n": pa.array([len(m)], pa.int32()),
                "held": pa.array([np.bincount(m[:, 2].astype(np.int64), minlength=n_eras)], pa.list_(pa.int64())), "data": pa.array([squeezed(m)], pa.binary()),
            })

        for part in batches:
            coded = part.column("target").dictionary_encode()
            index, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            m = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "e")])
            cuts = np.flatnonzero(np.diff(index)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(m)] if len(m) else []):
                if held and (names[index[begin]] != of or held >= most):
                    yield out()
                    seq, waiting, held = seq + 1, [], 0
                of = names[index[begin]]
                waiting.append(m[begin:end])
                held += int(end - begin)
        if held:
            yield out()

    runs = materialise(dealt.mapInArrow(run, "slice int, seq int, target string, n int, held array<long>, data binary"), "runs")
    # A row per run: what each era holds before it, and in all.
    before, total = {}, {}
    for r in runs.select("slice", "seq", "target", "held").orderBy("target", "slice", "seq").collect():
        so_far = total.get(r.target, np.zeros(n_eras, np.int64))
        before[r.slice, r.seq] = so_far
        total[r.target] = so_far + np.array(r.held, np.int64)
    return Runs(runs, eras, before, total)


@dataclass
class Run:
    name: tuple[int, int]
    target: str
    x: np.ndarray
    y: np.ndarray
    e: np.ndarray


@dataclass
class Runs:
    df: DataFrame
    eras: list
    before: dict  # {run: rows of each era in the runs before it}
    total: dict  # {target: rows of each era}

    def passed(self, work: Callable, schema: str, **shared) -> DataFrame:
        """One pass: work(runs of a task, what was shared) gives batches."""
        known = self.df.sparkSession.sparkContext.broadcast((self.before, self.total, len(self.eras), shared))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def opened():
                for part in batches:
                    for i in range(part.num_rows):
                        m = matrix(part.column("data")[i].as_buffer(), part.column("n")[i].as_py(), 3)
                        yield Run((part.column("slice")[i].as_py(), part.column("seq")[i].as_py()), part.column("target")[i].as_py(), m[:, 0], m[:, 1], m[:, 2])

            yield from work(opened(), *known.value)

        return self.df.drop("held").mapInArrow(run, schema)

    def equal_bins(self, probs: list[float], min_rows: int, bounds: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
        """(target, era, mean_x, mean_y of full equal-count bins; target, era, n, q: quantiles of x) of every fold."""

        def work(runs, before, total, n_eras, shared):
            for r in runs:
                out = []
                for f in range(1, n_eras):
                    n, low = int(total[r.target][:f].sum()), int(before[r.name][:f].sum())
                    mine = np.flatnonzero(r.e < f)
                    if not len(mine):
                        continue
                    bins = max(bounds[0], min(bounds[1], n // min_rows))
                    x, y = r.x[mine], r.y[mine]
                    at = ((low + 1 + np.arange(len(mine), dtype=np.int64)) * bins - 1) // n
                    begin = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                    end = np.append(begin[1:], len(mine))
                    sx, sy = np.add.reduceat(x, begin), np.add.reduceat(y, begin)
                    out += [(r.target, f, int(at[b]), int(e - b), float(u), float(v), float(x[b]), float(x[e - 1])) for b, e, u, v in zip(begin, end, sx, sy)]
                    for i, p in enumerate(probs):
                        for side, rank in enumerate(_ranks(n, p)):
                            if low <= rank < low + len(mine):
                                out.append((r.target, f, -1 - 2 * i - side, n, float(x[rank - low]), 0.0, 0.0, 0.0))
                yield _batch(out, SUMS)

        sums = materialise(self.passed(work, _ddl(SUMS)), "bins")
        era = F.element_at(F.array(*[F.lit(e) for e in self.eras]) if self.eras else F.array().cast("array<long>"), (F.col("f") + 1).cast("int")).alias("era")
        full = sums.where("bin >= 0").groupBy("target", "f", "bin").agg(
            F.sum("n").alias("n"), F.when(F.min("low") == F.max("high"), F.min("low")).otherwise(F.sum("sx") / F.sum("n")).alias("mean_x"), (F.sum("sy") / F.sum("n")).alias("mean_y")
        ).where(F.col("n") >= min_rows).select("target", era, "mean_x", "mean_y")
        hits: dict = {}
        for r in sums.where("bin < 0").collect():  # two per fold and quantile
            hits.setdefault((r.target, r.f, r.n), {})[-1 - r.bin] = r.sx
        ends = [(t, self.eras[f], n, [_between(n, p, at[2 * i], at.get(2 * i + 1)) for i, p in enumerate(probs)]) for (t, f, n), at in hits.items()]
        kind = dict(full.dtypes)["era"]
        return full, self.df.sparkSession.createDataFrame(ends, f"target string, era {kind}, n long, q array<double>")

    def ratio_quantiles(self, maps: dict, least: float, bins: int, probs: list[float]) -> list[tuple]:
        """(target, era, bin, lo, hi, n, mean x, mean y, quantiles of y / x) of every fold, x through the fold's rising map, in quantile bins of x from ``least`` on.

        A rising map keeps the order, so the bins of a fold are found by rank as well.
        """
        eras = self.eras

        def lifted(r: Run, f: int):
            mine = r.e < f
            x, m = r.x[mine], maps.get((r.target, eras[f]))
            return (x if m is None else rising(x, *m)), r.y[mine]

        def count(runs, before, total, n_eras, shared):
            for r in runs:
                yield _batch([(r.target, *r.name, f, int((x >= least).sum())) for f in range(1, n_eras) for x, _ in [lifted(r, f)]], COUNTS)

        # A row per run and fold: how many rows are kept before the run, and in all.
        kept, of = {}, {}
        for r in self.passed(count, _ddl(COUNTS)).orderBy("target", "slice", "seq").collect():
            kept[r.slice, r.seq, r.f] = of.get((r.target, r.f), 0)
            of[r.target, r.f] = of.get((r.target, r.f), 0) + r.n
        marks = [i / bins for i in range(bins + 1)]

        def edge(runs, before, total, n_eras, shared):
            for r in runs:
                out = []
                for f in range(1, n_eras):
                    x, _ = lifted(r, f)
                    x, low, n = x[x >= least], shared["kept"][(*r.name, f)], shared["of"][r.target, f]
                    out += [(r.target, f, i, side, float(x[rank - low])) for i, p in enumerate(marks) if n for side, rank in enumerate(_ranks(n, p)) if low <= rank < low + len(x)]
                yield _batch(out, HITS)

        hits: dict = {}
        for r in self.passed(edge, _ddl(HITS), kept=kept, of=of).collect():
            hits.setdefault((r.target, r.f), {})[r.i, r.side] = r.x
        edges = {k: np.unique([_between(of[k], p, at[i, 0], at.get((i, 1))) for i, p in enumerate(marks)]) for k, at in hits.items()}
        groups = {(*k, b): i for i, (k, b) in enumerate((k, b) for k, e in sorted(edges.items()) for b in range(len(e) - 1))}

        def pieces(runs, n_eras):
            """(group, x, y) of every fold and bin."""
            for r in runs:
                for f in range(1, n_eras):
                    e = edges.get((r.target, f))
                    if e is None or len(e) < 2:
                        continue
                    x, y = lifted(r, f)
                    x, y = x[x >= least], y[x >= least]
                    cuts = np.searchsorted(x, e[1:-1], "right")  # right-closed bins
                    for b, (begin, end) in enumerate(zip([0, *cuts], [*cuts, len(x)])):
                        if end > begin:
                            yield groups[r.target, f, b], x[begin:end], y[begin:end]

        def sums(runs, before, total, n_eras, shared):
            found: dict = {}
            for g, x, y in pieces(runs, n_eras):
                found[g] = found.get(g, 0) + np.array([len(x), x.sum(), y.sum()])
            yield _batch([(g, int(n), float(u), float(v)) for g, (n, u, v) in found.items()], MEANS)

        means = {r.g: r for r in self.passed(sums, _ddl(MEANS)).groupBy("g").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).collect()}
        wanted: dict | None = None
        for bits in (*BITS, None):
            def cells(runs, before, total, n_eras, shared, bits=bits):
                waiting, held = {}, 0
                for g, x, y in pieces(runs, n_eras):
                    v = y / x
                    if shared["wanted"] is not None:
                        prefix, _ = shared["wanted"].get(g, (np.zeros(0, np.int64), None))
                        own = leading(v, shared["of_bits"])
                        at = np.minimum(np.searchsorted(prefix, own), max(len(prefix) - 1, 0))
                        v = v[prefix[at] == own] if len(prefix) else v[:0]
                    waiting.setdefault(g, []).append(_counted(v if bits is None else leading(v, bits)))
                    held += len(waiting[g][-1][0])
                    if held > CELLS:
                        yield from _cells(waiting, bits)
                        waiting, held = {}, 0
                yield from _cells(waiting, bits)

            kind = "g int, v double, c long" if bits is None else "g int, v long, c long"
            counted = self.passed(cells, kind, wanted=wanted, of_bits=dict(zip((*BITS[1:], None), BITS)).get(bits)).groupBy("g", "v").agg(F.sum("c").alias("c"))
            size = {g: int(r.n) for g, r in means.items()}
            of_bits = None if wanted is None else dict(zip((*BITS[1:], None), BITS))[bits]
            shared = self.df.sparkSession.sparkContext.broadcast((size, wanted))

            found = {r.g: r for r in counted.groupBy("g").applyInPandas(_finder(probs, bits, of_bits, shared), "g int, at array<long>, v array<double>").collect()}
            if bits is not None:
                wanted = {g: (np.array(r.v).astype(np.int64), np.array(r.at, np.int64)) for g, r in found.items()}
        out = []
        for (t, f, b), g in groups.items():
            if g in means:
                m, n, at = means[g], int(means[g].n), dict(zip(found[g]["at"], found[g]["v"]))
                q = [_between(n, p, *[at[rank] for rank in _ranks(n, p)]) for p in probs]
                out.append((t, eras[f], b, float(edges[t, f][b]), float(edges[t, f][b + 1]), n, m.sx / n, m.sy / n, q))
        return out


SUMS = {"target": pa.string(), "f": pa.int32(), "bin": pa.int64(), "n": pa.int64(), "sx": pa.float64(), "sy": pa.float64(), "low": pa.float64(), "high": pa.float64()}
COUNTS = {"target": pa.string(), "slice": pa.int32(), "seq": pa.int32(), "f": pa.int32(), "n": pa.int64()}
HITS = {"target": pa.string(), "f": pa.int32(), "i": pa.int32(), "side": pa.int32(), "x": pa.float64()}
MEANS = {"g": pa.int32(), "n": pa.int64(), "sx": pa.float64(), "sy": pa.float64()}
NAMES = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}


def _ddl(fields: dict) -> str:
    return ", ".join(f"{c} {NAMES[t]}" for c, t in fields.items())


def _batch(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, fields.values())], list(fields))


def _cells(waiting: dict, bits: int | None) -> Iterator[pa.RecordBatch]:
    for g, parts in waiting.items():
        v, of = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        c = np.bincount(of, weights=np.concatenate([c for _, c in parts]), minlength=len(v)).astype(np.int64) if len(v) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), g, np.int32)), pa.array(v, pa.float64() if bits is None else pa.int64()), pa.array(c)], ["g", "v", "c"])


def _counted(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(v, return_counts=True)


def leading(v: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of doubles as numbers that grow with them."""
    u = (np.ascontiguousarray(v) + 0.0).view(np.int64)  # -0.0 becomes 0.0
    u = np.where(u < 0, ~u, u | np.int64(-(1 << 63))).view(np.uint64)
    return (u >> np.uint64(64 - bits)).astype(np.int64)


def rising(x: np.ndarray, grid: np.ndarray, mapped: np.ndarray) -> np.ndarray:
    """Values through a level map, which rises; not below 0, and never falling where rounding would make it."""
    from pitpanel.operators.calibrate import _on_map

    k = np.searchsorted(grid, x, "right")
    out = np.clip(_on_map(x, grid, mapped), mapped[np.clip(k - 1, 0, len(grid) - 1)], np.where(k == len(grid), np.inf, mapped[np.clip(k, 0, len(grid) - 1)]))
    return np.maximum(out, 0.0)


def _ranks(n: int, p: float) -> list[int]:
    """Ranks, from 0, of the one or two values that the quantile lies at or between."""
    h = (n - 1) * p
    low = int(np.floor(h))
    return [low, low + 1] if h > low else [low]


def _between(n: int, p: float, low: float, high: float | None = None) -> float:
    return float(low if high is None or low == high else low + (high - low) * ((n - 1) * p - np.floor((n - 1) * p)))


def _finder(probs: list[float], bits: int | None, of_bits: int | None, shared) -> Callable:
    """Of a group's counted cells, those that hold a wanted rank, with the rows below them; of counted values, the ranks and their values."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        size, wanted = shared.value
        pdf = pdf.sort_values("v")
        v, c = pdf["v"].to_numpy(), pdf["c"].to_numpy()
        low = np.cumsum(c) - c
        if wanted is not None:  # rows below a cell: those below its prefix, and of the cells before it with the same prefix
            prefix, base = wanted[g]
            own = leading(v, of_bits) if bits is None else v >> (bits - of_bits)
            first = np.searchsorted(own, own, "left")
            low = low - low[first] + base[np.searchsorted(prefix, own)]
        ranks = np.array(sorted({r for p in probs for r in _ranks(size[g], p)}))
        at = np.searchsorted(low, ranks, "right") - 1
        if bits is None:
            return pd.DataFrame({"g": [g], "at": [ranks.tolist()], "v": [v[at].tolist()]})
        at = np.unique(at)
        return pd.DataFrame({"g": [g], "at": [low[at].tolist()], "v": [v[at].astype(float).tolist()]})

    return find
