import hashlib

import pytest
from pitpanel.llm import merkle_manifest as mm
from pyspark.sql import functions as F


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def ground(nodes, arity):
    """(root, path of each node) of one tree; a path has (before, after) for every level."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(where):
            base = p - p % arity
            paths[k].append(("".join(level[base:p]), "".join(level[p + 1 : base + arity])))
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
        where = [p // arity for p in where]
    return level[0], paths


def brute(rows, arity):
    """rows: (source, id, value); [(id, leaf, subroot, root, path)] with nulls first and ties by leaf."""
    groups = {}
    for source, i, value in rows:
        part = "-" if value is None else f"{len(value.encode())}:{value}"
        groups.setdefault(source, []).append((i, sha(part)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        leaves = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *ground([h for _, h in leaves], arity)))
    root, tops = ground([t[1] for t in trees], arity)
    return sorted(
        (str(i), leaf, sub, root, tuple(path + top)) for (leaves, sub, paths), top in zip(trees, tops) for (i, leaf), path in zip(leaves, paths)
    )


def manifest_of(df, arity):
    out = mm.manifest(df, mm.row_digest(F.col("value")), F.col("source"), F.col("id"), {"id": F.col("id")}, arity)
    return [
        (str(r.id), r.leaf.hex(), r.subroot.hex(), r.root.hex(), tuple((s.left.hex(), s.right.hex()) for s in r.path)) for r in out.collect()
    ]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_trees_equal_brute_force(spark, arity):
    sizes = {"a": 1, "b": 2, "é": 3, "B": 4, None: 10, "long": 28, "": 7}
    rows = [(s, i, f"{s}{i}" if i % 4 else None) for s, n in sizes.items() for i in range(n)]
    rows += [("b", None, "x"), ("b", None, "y"), ("b", 1, "same"), ("b", 1, "same"), ("long", 5, "other"), ("long", 5, "é\n")]
    df = spark.createDataFrame(rows, "source string, id long, value string")
    assert sorted(manifest_of(df, arity)) == brute(rows, arity)


def test_single_row_and_none(spark):
    one = spark.createDataFrame([(None, 1, None)], "source string, id long, value string")
    assert manifest_of(one, 3) == [("1", sha("-"), sha("-"), sha("-"), ())]
    assert manifest_of(one.limit(0), 3) == []
    with pytest.raises(ValueError):
        manifest_of(one, 1)


def test_fold_finds_tampering(spark):
    rows = [("s", i, f"v{i}") for i in range(30)] + [("t", 1, "w")]
    df = spark.createDataFrame(rows, "source string, id long, value string")
    out = mm.manifest(df, mm.row_digest(F.col("value")), F.col("source"), F.col("id"), {"id": F.col("id"), "value": F.col("value")})
    claimed = F.when(F.col("id") % 2 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    got = out.select("value", "id", (mm.fold(mm.hexed(mm.row_digest(claimed)), F.col("path")) == mm.hexed(F.col("root"))).alias("ok")).collect()
    assert len(got) == 31 and all(r.ok == (r.id % 2 == 1) for r in got)


def test_edges(edges, empty):
    keep = {"doc_id": F.col("doc_id")}
    leaf = mm.row_digest(F.col("doc_id"), F.col("text"))
    got = mm.manifest(edges, leaf, F.col("lang"), F.col("doc_id"), keep).collect()
    assert len(got) == edges.count() and len({r.root for r in got}) == 1
    assert mm.manifest(empty, leaf, F.col("lang"), F.col("doc_id"), keep).collect() == []
