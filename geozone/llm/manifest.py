"""Merkle manifest of a dataset by slot pivots: roots, a proof for every row, and the check of rows against the root.

The leaves of a group are numbered. A level of the tree is a pivot: a parent's children are spread into `fanout` columns by
conditional aggregates, the digest of the concatenated columns is the parent, and the columns without a row's own slot are its
siblings. Levels go in rounds of up to BLOCK leaves. A round deals the rows by (group, block) once and sorts them once, by the numbers
of all ancestors from the top down; every level's window then finds its rows together, since its parents are a prefix of that
order. The tops of the blocks are the leaves of the next round, a thousandth as many, and hand their own siblings down by a join
on the block. The roots of the groups are the leaves of one more tree, of all groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geozone.operators.ordinal import ordinal
from geozone.session import written

# Leaves of a block at most; a window holds no more rows.
BLOCK = 1024
# Hexadecimal digits of a digest (fixed value).
DIGEST = 64
# Stands for null in a leaf (fixed value).
MISSING = "-"
# The columns of a document, in the order in which a leaf holds them (fixed value).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows whose id has a checksum divisible by this are tampered with in the registered query (fixed value).
TAMPERED = 7


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of texts put together; nulls add nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that no two rows have the same text; null has its own mark."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(MISSING))


def leaf(**changed: Column) -> Column:
    """The digest of a document's row; `changed` takes the place of columns."""
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def _div(number: Column, by: int) -> Column:
    """Whole division that stays whole beyond 2 ** 53."""
    return number if by == 1 else F.call_function("div", number, F.lit(by))


def _up(number: Column, by: int) -> Column:
    """Whole division, rounded up."""
    return number if by == 1 else _div(number + (by - 1), by)


def _levels_of(n: int, fanout: int) -> int:
    """Levels above `n` leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // fanout), found + 1
    return found


def _check_fanout(fanout: int) -> None:
    if not 2 <= fanout <= BLOCK:
        raise ValueError(f"the fanout is from 2 to {BLOCK}, not {fanout}")


def _round(nodes: DataFrame, group: Sequence[str], fanout: int, levels: int) -> DataFrame:
    """`nodes` with `top`, the digest of the ancestor `levels` above, and `path`, the siblings on the way, as bytes.

    `nodes` has (*group, pos, n, node): number and digest of each node, and how many the group has.
    """
    above = {f"__up{k}": _div(F.col("pos"), fanout**k) for k in range(1, levels + 1)}
    rows = nodes.withColumns(above).repartition(*group, f"__up{levels}")
    rows = rows.withColumns({"top": F.col("node"), "path": F.lit("")})
    slots = [f"__slot{s}" for s in range(fanout)]
    for k in range(levels):
        parent = Window.partitionBy(*group, *[f"__up{j}" for j in range(levels, k, -1)])
        slot = (F.col(f"__up{k}") if k else F.col("pos")) % fanout
        spread = {name: F.max(F.when(slot == s, F.col("top"))).over(parent) for s, name in enumerate(slots)}
        rows = rows.withColumns(spread)
        # A node that stands alone at the top of its group is no child.
        many = _up(F.col("n"), fanout**k) > 1
        others = F.concat_ws("", *[F.when(slot != s, F.col(name)) for s, name in enumerate(slots)])
        top = F.when(many, digest(*[F.col(c) for c in slots])).otherwise(F.col("top"))
        path = F.when(many, F.concat("path", others)).otherwise(F.col("path"))
        rows = rows.withColumns({"top": top, "path": path}).drop(*slots)
    return rows.withColumn("path", F.unhex("path")).drop(*above)


def trees(nodes: DataFrame, group: Sequence[str], most: int, fanout: int) -> DataFrame:
    """`nodes` with `top`, the root of the node's group, and `path`, all siblings from the node to that root, as bytes.

    `nodes` has (*group, pos, n, node) and any other columns; no group has more than `most` nodes. Each round is written.
    """
    group = list(group)
    levels = _levels_of(BLOCK + 1, fanout) - 1
    levels = max(1, min(levels, _levels_of(most, fanout)))
    found = written(_round(nodes, group, fanout, levels), "manifest")
    size = fanout**levels
    if most <= size:
        return found
    heads = found.filter(F.col("pos") % size == 0)
    heads = heads.select(*group, _div(F.col("pos"), size).alias("pos"), _up(F.col("n"), size).alias("n"), F.col("top").alias("node"))
    upper = trees(heads, group, -(-most // size), fanout)
    upper = upper.select(*group, F.col("pos").alias("__block"), F.col("top").alias("__top"), F.col("path").alias("__path"))
    rows = found.withColumn("__block", _div(F.col("pos"), size)).join(upper, [*group, "__block"])
    columns = {"top": F.col("__top"), "path": F.concat("path", "__path")}
    return rows.withColumns(columns).drop("__block", "__top", "__path")


def manifest(rows: DataFrame, group: str, order: Sequence[str], fanout: int = 2) -> DataFrame:
    """`rows` with `subroot`, `root`, `proof`, and the places a proof is folded by: `place`, `n_leaves`, `group_place`, `n_groups`.

    `rows` has `leaf`, digests in hexadecimal, beside the columns named. Per `group` (null is a group too) the leaves stand in the
    sequence of `order`, nulls first, then by digest. While there is more than one node, each `fanout` of them (the last run may be
    shorter, even one) become the digest of their concatenated digests. The last one is the subroot; the subroots in the order of
    their groups, null first, give the root in the same way. `proof` holds the siblings from leaf to root, left to right,
    as bytes of 32 each.

    Equal rows are leaves of their own. An empty table has no root and gives no rows. Runs jobs: rows are written as given, when
    numbered, and once per round; the root is one more small tree. Groups of any size are split: no task holds more
    than a range of the order or some blocks.
    """
    _check_fanout(fanout)
    rows = written(rows, "manifest-leaves")
    own = [c for c in rows.columns if c != "leaf"]
    # A name for each group in the order of the groups; null, which has none, comes first.
    keyed = rows.withColumn("__group", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    numbered = ordinal(keyed, ["__group"], [*order, "leaf"], out="pos", total="n").withColumnRenamed("leaf", "node")
    sizes = written(numbered.groupBy("__group").agg(F.max("n").alias("n")), "manifest-groups")
    most, groups = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()

    leaves = trees(numbered, ["__group"], most, fanout)
    subroots = leaves.filter("pos = 0").select("__group", F.col("top").alias("node"))
    ordered = ordinal(subroots, [], ["__group"], out="pos", total="n")
    whole = trees(ordered, [], groups, fanout)
    whole = whole.select("__group", F.col("top").alias("root"), F.col("path").alias("__path"), F.col("pos").alias("group_place"), F.col("n").alias("n_groups"))
    return leaves.join(whole, "__group").select(
        *own,
        F.col("node").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        F.concat("path", "__path").alias("proof"),
        F.col("pos").alias("place"),
        F.col("n").alias("n_leaves"),
        "group_place",
        "n_groups",
    )


def proof_text(proof: Column) -> Column:
    """The siblings of a proof as one text of hexadecimal digits."""
    return F.lower(F.hex(proof))


def folded(node: Column, proof: Column, fanout: int = 2) -> Column:
    """The root that follows from a leaf's digest and the proof of its place; for rows of `manifest`."""
    text = proof_text(proof)
    below = _fold(F.struct(node.alias("node"), F.lit(0).alias("at")), text, F.col("place"), F.col("n_leaves"), fanout)
    return _fold(below, text, F.col("group_place"), F.col("n_groups"), fanout)["node"]


def _fold(start: Column, text: Column, place: Column, n: Column, fanout: int) -> Column:
    """Climbs one tree. `start` has the digest and how many digits of the proof are used up."""
    powers = F.array(*[F.lit(p).cast("bigint") for p in _powers(fanout)])
    levels = F.filter(powers, lambda p: p < n)

    def climb(reached: Column, power: Column) -> Column:
        pos = F.call_function("div", place, power)
        slot = (pos % fanout).cast("int")
        nodes = F.call_function("div", n + power - 1, power)
        run = F.least(F.lit(fanout).cast("bigint"), nodes - pos + slot).cast("int")
        at = reached["at"]
        left = F.substring(text, at + 1, slot * DIGEST)
        right = F.substring(text, at + 1 + slot * DIGEST, (run - 1 - slot) * DIGEST)
        node = F.sha2(F.concat(left, reached["node"], right), 256)
        return F.struct(node.alias("node"), (at + (run - 1) * DIGEST).alias("at"))

    return F.aggregate(levels, start, climb)


def _powers(fanout: int) -> list[int]:
    found = [1]
    while found[-1] * fanout < 1 << 62:
        found.append(found[-1] * fanout)
    return found


def verified(rows: DataFrame, leaf: Column, fanout: int = 2) -> DataFrame:
    """Rows of `manifest` with `folded_root`, from the digest `leaf` instead of the recorded one, and whether it is the root."""
    found = rows.withColumn("folded_root", folded(leaf, F.col("proof"), fanout))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def check_documents(docs: DataFrame, tampered: Column, fanout: int = 2) -> DataFrame:
    """The manifest of `docs` (doc_id, source, lang, n_chars, text; other columns are not read), checked against rows of which some
    are tampered with: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    A leaf holds all five columns; null, empty and very long texts have leaves like any other. `lang` groups the leaves, doc_id orders
    them. Where `tampered` holds, 1 is added to n_chars before the check. Rows with null or repeated ids are leaves of their
    own (equal ones in any sequence). An empty table gives no rows.
    """
    changed = F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)).otherwise(F.col("__leaf"))
    rows = docs.withColumn("__leaf", leaf()).select("doc_id", "lang", F.col("__leaf").alias("leaf"), changed.alias("tampered_leaf"))
    found = verified(manifest(rows, "lang", ["doc_id"], fanout), F.col("tampered_leaf"), fanout)
    proof = F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def tampered_ids() -> Column:
    """Holds where TAMPERED divides the checksum of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
