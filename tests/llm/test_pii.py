import hashlib
import re
import tracemalloc
from itertools import product

import numpy as np
import pytest

from geozone.llm import pii as D

# The patterns as they are stated, for short texts.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and D.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(STATED).index(s[0])))


def test_base_spans_are_those_of_the_stated_patterns():
    rng = np.random.default_rng(1)
    tokens = ["a", "b.c", "@", "@@", ".", "..", "-", "+", "1", "255", "256", "007", " ", "(", ")", "4111 1111 1111 1111", "10.0.0.1"]
    tokens += ["x@y.zz", "é", "+1 (917) 555-2670", "4804417530069042", "%", "_", "5500-0055-5555-5559", "1.2.3.4.5.6.7.8", "\n"]
    for n in range(4000):
        text = "".join(rng.choice(tokens, rng.integers(1, 9)))
        assert D.base_spans(text) == brute(text), text
    for parts in product(["a@b.c", "@", "1.1.1.1", "+12", "."], repeat=4):
        assert D.base_spans("".join(parts)) == brute("".join(parts))


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" + ")" * 200_000, "1 " * 100_000):
        assert len(D.base_spans(text)) >= 0
    assert D.base_spans("0" * 6_000 + ".1.2.3") == [("ip", 0, 6_006)]


@pytest.fixture(scope="module")
def field():
    return D.train()


def test_field_learns_its_table(field):
    right = total = 0
    for text, spans in D.labelled_table():
        (got,) = D.decode(field, [text])
        checked = [s for s in spans if D.plausible(text, s)]
        right += set(got) == set(checked)
        total += 1
    assert right / total > 0.97


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(0)
    shapes = rng.integers(0, D.SHAPES, (6, 4))
    got = field.viterbi(shapes)
    emit = field.scores(shapes)
    for row in range(len(shapes)):
        value = lambda path: field.first[path[0]] + sum(emit[row, t, y] for t, y in enumerate(path)) + sum(field.pair[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        best = max(product(range(D.LABELS), repeat=4), key=value)
        assert value(tuple(int(x) for x in got[row])) == pytest.approx(value(best), abs=1e-3)


def test_viterbi_never_holds_the_scores_of_all_places(field):
    shapes = np.random.default_rng(6).integers(0, D.SHAPES + 1, (16_384, D.CHUNK + 2 * D.CONTEXT))
    tracemalloc.start()
    got = field.viterbi(shapes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.6 * shapes.size * D.LABELS * 8  # less than one table of them, whose sum takes three
    emit, pair = field.scores(shapes[:20]).astype(np.float32), field.pair.astype(np.float32)
    for own, labels in zip(emit, got, strict=False):
        best, back = own[0] + field.first.astype(np.float32), []
        for row in own[1:]:
            back.append((best[:, None] + pair).argmax(axis=0))
            best = (best[:, None] + pair).max(axis=0) + row
        path = [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        assert labels.tolist() == path[::-1]


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    field = D.Field()
    for w in field.weights():
        w += np.where(np.abs(w) < 1e3, rng.normal(size=w.shape) * 0.1, 0)
    shapes, labels = rng.integers(0, 5, (3, 4)), np.array([[0, 1, 2, 0], [3, 4, 0, 0], [0, 0, 7, 8]])

    def loss():
        emit, out = field.scores(shapes), 0.0
        for row in range(3):
            value = lambda path: field.first[path[0]] + sum(emit[row, t, y] for t, y in enumerate(path)) + sum(field.pair[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
            out += np.logaddexp.reduce([value(p) for p in product(range(D.LABELS), repeat=4)]) - value(labels[row])
        return out / 3

    grads = [np.zeros_like(w) for w in field.weights()]
    field._add_gradient(grads, shapes, labels, 3)
    for k, at in ((0, (2, 1)), (0, (int(shapes[0, 0]), 0)), (1, (int(shapes[1, 1]), 0)), (2, (int(shapes[0, 2]), 1)), (3, (1, 2)), (3, (0, 0)), (4, (3,))):
        w = field.weights()[k]
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert (up - down) / 2e-5 == pytest.approx(grads[k][at], abs=1e-5)


def test_query_and_redaction(spark, docs_of, field):
    rows = [
        "mail ann@example.com or call (917) 555-2670, from 10.0.0.1",
        "clean text with 12 numbers, 2024-01-31 and 3.14 in it",
        None,
        "",
        "é😀 +1 (917) 555-2670" + " word" * 30_000 + " 4111111111111111",
        "same x@y.zz",
        "same x@y.zz",
        "x" * 100_000,
    ]
    rows = [*enumerate(rows), (None, "a@b.cd"), (3, "again 3")]
    got = D.find_personal_data(docs_of(rows)).collect()
    want = []
    for doc_id, text in rows:
        base = brute(text or "")
        want.append((str(doc_id), *(sum(s[0] == k for s in base) for k in D.KINDS), hashlib.sha256(D.spelled(base).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    by = {r.doc_id: r.spans for r in got}
    assert by[0] == "email:5:20,phone:29:43,ip:50:58"
    assert by[1] == by[2] == by[3] == by[7] == ""
    clean = {r.doc_id: r for r in D.redact(docs_of(rows)).collect()}
    assert clean[0].text == "mail [EMAIL] or call [PHONE], from [IP]" and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text == rows[1][1] and clean[2].text is None
    assert clean[4].text.startswith("é😀 [PHONE] word") and clean[4].text.endswith("word [CARD]")
    assert D.find_personal_data(docs_of([])).collect() == [] and D.redact(docs_of([])).collect() == []


def test_overlapping_spans_are_redacted_once():
    assert D.redacted("ab 12345 cd", [("phone", 3, 6), ("card", 4, 8)]) == "ab [PHONE] cd"


def test_added_spans_overlap_no_base_span_and_take_no_longer_for_long_texts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40):
        for _ in range(200):
            starts = rng.integers(0, 120, (2, n))
            base, more = ([("ip", int(a), int(a + k)) for a, k in zip(own, rng.integers(1, 12, n), strict=True)] for own in starts)
            plain = [s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
            assert D.apart_from(base, more) == plain
            assert D.apart_from([], more) == more
    base = [("ip", 40 * k, 40 * k + 9) for k in range(200_000)]
    more = [("email", 40 * k + 20, 40 * k + 30) for k in range(200_000)]
    assert D.apart_from(base, more) == more
