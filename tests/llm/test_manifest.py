"""The manifest against trees built level by level in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from geozone.llm import manifest

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def climb(levels, pos, node, fanout):
    siblings = []
    for nodes in levels[:-1]:
        first = pos // fanout * fanout
        run = nodes[first : first + fanout]
        siblings += run[: pos - first] + run[pos - first + 1 :]
        run[pos - first] = node
        node, pos = h(*run), pos // fanout
    return siblings, node


def want(rows, fanout=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([leaf(r) for r in sorted(groups[g], key=key)], fanout) for g in langs}
    whole = levels_of([trees[g][-1][0] for g in langs], fanout)
    root, out = whole[-1][0], []
    for place, g in enumerate(langs):
        for pos, row in enumerate(sorted(groups[g], key=key)):
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            below, node = climb(trees[g], pos, leaf(row, 1 if touched else 0), fanout)
            above, node = climb(whole, place, node, fanout)
            out.append((row[0], leaf(row), trees[g][-1][0], root, h(*below, *above), node, node == root))
    return sorted(out, key=repr)


def got(spark, rows, fanout=2):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KINDS)
    out = manifest.check_documents(docs, manifest.tampered_ids(), fanout)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


EDGES = [
    (None, None, None, None, None),
    (None, "no id", "en", "s", 5),
    (1, "", "en", "", 0),
    (1, "again 1", "en", "s", 7),
    (2, "twin", "en", "s", 4),
    (2, "twin", "en", "s", 4),
    (3, "null lang", None, "s", 9),
    (4, "empty lang", "", "s", 10),
    (5, "late lang", "\U0001f40e", "s", 9),
    (6, "earlier in UTF-8", "\uffee", "s", None),
    (7, "long " * 100_000, "en", "s", 500_000),
    (-8, "é漢字", "de", None, 3),
    *[(i, f"text {i}", "fr", "s", i) for i in range(10, 60)],
]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_edges(spark, fanout):
    assert got(spark, EDGES, fanout) == want(EDGES, fanout)


@pytest.mark.parametrize("fanout", [2, 4])
def test_several_rounds(spark, monkeypatch, fanout):
    """Blocks of a few leaves, so that trees take three rounds and more, groups too."""
    monkeypatch.setattr(manifest, "BLOCK", 4)
    rows = [(i, f"text {i}", "hot" if i % 3 else f"g{i % 31:02}", "s", i) for i in range(300)]
    assert got(spark, rows, fanout) == want(rows, fanout)


def test_one_leaf_and_no_leaf(spark):
    rows = [(20, "alone", "en", "s", 5)]
    assert got(spark, rows) == want(rows)
    assert got(spark, []) == []


def test_a_round_deals_and_sorts_once(spark):
    nodes = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("pos"), (F.col("id") + 100).alias("n"), F.lit("a").alias("node"))
    plan = manifest._round(nodes, ["g"], 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count("Sort ["), plan.count("Window [")) == (1, 1, 10)


def test_other_fanouts_are_refused(spark):
    with pytest.raises(ValueError, match="fanout"):
        manifest.manifest(spark.range(1).selectExpr("id", "'a' leaf"), "id", ["id"], 1)
