"""Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from landgraph.llm.merkle import Manifest, folded, leaf_digest, proof_digest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """The root and, for each leaf, the levels of (left, right) siblings."""
    paths, where, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(where):
            run = slice(k // fanout * fanout, k // fanout * fanout + fanout)
            paths[i].append(("".join(level[run.start : k]), "".join(level[k + 1 : run.stop])))
        where = [k // fanout for k in where]
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))
    trees = {s: (sorted(groups[s], key=order), *plain_tree([plain_leaf(r) for r in sorted(groups[s], key=order)], fanout)) for s in names}
    root, tops = plain_tree([trees[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(trees[s][0], trees[s][2], strict=True):
            out.append((r[0], plain_leaf(r), trees[s][1], root, tuple(path + top)))
    return sorted(out, key=str)


def ours(manifest):
    return sorted(((r.member.id, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.path)) for r in manifest.proofs().collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def documents(n, seed=4):
    rng = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "b", "", "é", None, "z" * 40]
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "naïve\n" * rng.randrange(9)])) for i in range(n)]
    return [*rows, (n, "lone", None, None, None), (None, "hot", "en", 1, "no id"), (None, "hot", "en", 1, "no id"), (3, "hot", "de", 2, "again"), rows[5], (n + 1, "hot", "en", 3, "long\n" * 200_000)]


@pytest.mark.parametrize(("fanout", "band"), [(3, 6), (3, 2), (2, 3), (3, 1)])
def test_equals_plain_version(spark, fanout, band):
    rows = documents(150)
    assert ours(Manifest(table(spark, rows), fanout=fanout, band=band)) == plain(rows, fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_around_powers(spark, n):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    assert ours(Manifest(table(spark, rows), band=2)) == plain(rows, 3)


def test_nodes_tile_their_level(spark):
    rows = documents(120)
    nodes = Manifest(table(spark, rows), band=2).nodes().collect()
    assert len({(r.tree, r.level, r.lo, r.digest) for r in nodes}) == len(nodes)
    levels = {}
    for r in nodes:
        levels.setdefault((r.tree, r.level), []).append((r.lo, r.hi))
    sizes = {t: sum(1 for r in rows if ("" if r[1] is None else f"={r[1]}") == t) for t, _ in levels}
    for (tree, _), spans in levels.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sizes[tree] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(r.is_top for r in nodes) == len(sizes)


def test_tampering_shows(spark):
    rows = documents(60)
    df = table(spark, rows).withColumns({"digest": F.lit(1), "lo": F.lit("x"), "tree": F.lit(None), "member": F.lit(2)})  # names of its own
    tampered = leaf_digest([F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS])
    out = Manifest(df, carry={"tampered": tampered}).proofs()
    out = out.select("member.id", "leaf", "root", folded(F.col("member.tampered"), F.col("path")).alias("other"), folded(F.col("leaf"), F.col("path")).alias("same"), proof_digest(F.col("path")).alias("proof"), "path")
    broken = {plain_leaf(r) for r in rows if "\n" in (r[4] or "")}
    for r in out.collect():
        assert r.same == r.root and (r.other == r.root) == (r.leaf not in broken)
        assert r.proof == H(*(x.left + x.right for x in r.path))


def test_empty_table(spark):
    assert ours(Manifest(table(spark, []))) == []


def test_query_on_whole_table(spark):
    import duckdb

    from landgraph.llm.queries import QUERIES, SQL

    sf, name = "/root/testdata/sf0.001", "op12_merkle_manifest"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    theirs = con.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, theirs.fetchall()))
    assert any(not r.verified for r in got) and all(r.verified for r in got if zlib.crc32(str(r.doc_id).encode()) % 2)
