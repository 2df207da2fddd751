import hashlib
import re

import numpy as np
import pytest
import xxhash

from geozone.llm import simhash as S
from geozone.llm.components import components


def brute_print(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    seq = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [seq[i : i + words] for i in range(len(seq) - words + 1)] or ([seq] if seq else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    """Smallest reachable id of each row of (id, fingerprint)."""
    label = {i: i for i in range(len(prints))}
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i][1] ^ prints[j][1]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    groups = {}
    for i, root in label.items():
        groups.setdefault(root, []).append(prints[i][0])
    return [min((x for x in groups[label[i]] if x is not None), default=None) for i in range(len(prints))]


def texts(seed=5, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "Wörter", "ABC", "ẞ"]
    out = []
    for _ in range(n):
        base = [str(w) for w in rng.choice(words, rng.integers(1, 300))]
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 3)):
            edited = list(base)
            edited[rng.integers(len(base))] = "edit"
            out.append("\t\n".join(edited))
    return out


def test_components_match_brute_force(spark, docs_of):
    rows = [*texts(), None, "", "  \n", "one", "ONE", "one two three", "x" * 50_000, "word " * 30_000]
    rows = [*enumerate(rows), (3, "repeated id"), (None, "one"), (None, "never seen elsewhere at all")]
    got = S.near_duplicates(docs_of(rows)).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, brute_groups(prints, 4), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_empty_table(spark, docs_of):
    assert S.near_duplicates(docs_of([])).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 4, 9])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.repeat(base, 20)
    for k in range(len(fps)):
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            fps[k] ^= np.uint64(1) << np.uint64(b)
    sizes = [1, 63, 64, 65, 200, 207]
    bounds = np.cumsum(sizes)
    assert bounds[-1] == len(fps)
    ends = np.repeat(bounds, sizes)
    got = {(int(i), int(j)) for a, b in S.near_pairs(fps[:, None], ends, radius, chunk=50) for i, j in zip(a, b, strict=True)}
    want = {
        (i, j) for i in range(len(fps)) for j in range(i + 1, ends[i]) if int(fps[i] ^ fps[j]).bit_count() <= radius
    }
    assert got == want


def test_large_buckets_are_tiled_and_lose_no_link(spark):
    rng = np.random.default_rng(1)
    near = np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fps = np.concatenate([near, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
    rows = [(k, bytearray(int(x).to_bytes(8, "little"))) for k, x in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node bigint, fp binary")
    links = S.candidate_links(nodes, 2, S.block_tables(2), tile=8)
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {k: 0 for k in range(1, 64)}


def test_near_copies_join_only_similar_texts(spark, docs_of):
    rng = np.random.default_rng(3)
    rows, groups = [], []
    for g in range(25):
        base = [f"t{x}" for x in rng.integers(0, 5000, 300)]
        rows.append(" ".join(base))
        groups.append(g)
        for edits, same in ((0, True), (2, True), (5, True), (40, False)):
            edited = list(base)
            for at in np.linspace(10, 290, edits).astype(int):
                edited[at] = f"new{rng.integers(1000)}"
            rows.append(" ".join(edited))
            groups.append(g if same else 100 + g)
    rows = [*rows, None, "", "a b", "a b", "a c"]
    groups = [*groups, 200, 200, 201, 201, 202]
    got = {r.doc_id: r.component_id for r in S.near_copies(docs_of([*enumerate(rows), (None, "a b")])).collect()}
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    assert got == {i: least[g] for i, g in enumerate(groups)} | {None: least[201]}
    assert S.near_copies(docs_of([])).collect() == []


def test_near_copies_with_repeated_and_missing_ids(spark):
    words = [f"t{x}" for x in np.random.default_rng(31).integers(0, 50_000, 900)]
    one, two, three = (" ".join(words[k : k + 300]) for k in (0, 300, 600))
    rows = [(5, one), (5, two), (5, one), (8, two + " end"), (None, one + " end"), (None, three), (None, three), (None, three + " end"), (9, None), (9, "")]
    got = S.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), tables=4).collect()
    text = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    assert sorted((str(r.doc_id), text[r.text_digest], str(r.component_id)) for r in got) == sorted(
        [("5", one, "5"), ("5", two, "5"), ("8", two + " end", "5"), ("None", one + " end", "5"), ("None", three, "None"), ("None", three + " end", "None"), ("9", "", "9")]
    )
    first = sorted((str(r.doc_id), text[r.text_digest]) for r in got if r.first)
    last = min((three, three + " end"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert first == sorted([("5", one), ("5", two), ("9", ""), ("None", last)])


def test_near_copies_with_a_line_repeated_in_one_of_them(spark, docs_of):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(10):
        base = " ".join(f"t{x}" for x in rng.integers(0, 50_000, 304))
        line = " ".join(f"l{x}" for x in rng.integers(0, 50_000, 6))
        rows += [base, base + f"\n{line}" * 40]
    assert all(S.similarity(rows[i], rows[i + 1], 5) > 0.9 for i in range(0, len(rows), 2))
    got = {r.doc_id: r.component_id for r in S.near_copies(docs_of(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}


def brute_near(rows, least=0.8):
    """Smallest reachable position of each text over pairs of a similarity of `least`."""
    sets = [set(S.shingles(t, 5)) for t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return dict(enumerate(label))


def test_near_copies_lose_no_pair_at_the_limit(spark, docs_of):
    rng = np.random.default_rng(9)
    rows = []
    for n in (8, 8, 8, 8, 8, 8, 8, 8, 13, 13, 13, 13, 58, 58, 58, 58, 204, 204, 204, 204, 504, 504, 504, 504):
        base = [f"t{x}" for x in rng.integers(0, 1_000_000, n)]
        more = (n - 4) // 4  # new words at the end: of 5/4 of the shingles 4/5 are shared
        rows += [" ".join(base), " ".join([*base, *(f"m{x}" for x in rng.integers(0, 1_000_000, more))])]
    assert all(S.similarity(rows[i], rows[i + 1], 5) >= 0.8 for i in range(0, len(rows), 2))
    got = {r.doc_id: r.component_id for r in S.near_copies(docs_of(rows)).collect()}
    assert got == brute_near(rows) == {i: i - i % 2 for i in range(len(rows))}


def test_near_copies_beside_closer_looking_texts(spark, docs_of):
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for _ in range(15):
        base = [f"t{x}" for x in rng.integers(0, 1_000_000, 204)]
        first = len(rows)
        for size in [16] + [26] * 60:
            at = rng.integers(5, 199 - size)
            new = [f"n{x}" for x in rng.integers(0, 1_000_000, size)]
            rows.append(" ".join([*base[:at], *new, *base[at + size :]]))
        rows.append(" ".join(base))
        alike = [S.similarity(r, rows[-1], 5) for r in rows[first:-1]]
        assert alike[0] > 0.8 > max(alike[1:])
        want[len(rows) - 1] = first
    got = {r.doc_id: r.component_id for r in S.near_copies(docs_of(rows)).collect()}
    assert {i: got[i] for i in want} == want


def test_wide_parities_never_exceed_the_difference_of_two_sets():
    rng = np.random.default_rng(21)
    for n, m, shared in [(0, 0, 0), (0, 5, 0), (300, 300, 290), (300, 300, 150), (5000, 4000, 3900), (9000, 300, 300)]:
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        one, other = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        apart = len(np.setxor1d(one, other))
        got = S.differing(S.parity(one, S.wide_bits(len(one))), S.parity(other, S.wide_bits(len(other))))
        assert got <= apart and got % 2 == apart % 2
        if n == m == 300:
            assert got > 0.7 * apart


def test_set_hashes_are_those_of_the_distinct_shingles():
    for text in [None, "", " \n", "one", "a b c d e", "A b  c d e f", "a b " * 40_000, *texts()[:20]]:
        distinct = list(dict.fromkeys(S.shingles(text, 5)))
        own = S.set_hashes(text, 5, 3)
        for lane, hashes in enumerate(own):
            assert sorted(hashes.tolist()) == sorted(S.hashed(distinct, lane).tolist())


def test_shingles_of_all_texts_are_counted(spark):
    rows = spark.range(17_000).selectExpr("id AS doc_id", "concat('every text ', id, ' and ', id % 7, IF(id = 9, '', ' of it')) AS text")
    counts = S.shingle_counts(rows, 5)
    true = {}
    for r in rows.collect():
        for h in S.set_hashes(r.text, 5)[0].tolist():
            true[h] = true.get(h, 0) + 1
    want = np.zeros(S.COUNTERS, np.int64)
    np.add.at(want, S.counter_of(np.array(list(true), np.uint64)), list(true.values()))
    assert np.array_equal(counts, want) and counts.sum() == sum(true.values()) > 17_000
    assert not S.shingle_counts(rows.filter("id < 0"), 5).any()


def test_rare_shingles_come_before_common_ones():
    hashes = np.random.default_rng(4).integers(0, 1 << 63, 40, dtype=np.uint64)
    counts = np.zeros(S.COUNTERS, np.int64)
    counts[S.counter_of(hashes[:30])] = 5
    assert set(S.rare_part(np.unique(hashes), 0.8, counts)) <= set(hashes[30:])
