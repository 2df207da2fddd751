"""Language identification by a bidirectional gated recurrent network over bytes, written in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geozone.llm.common import slices

UNKNOWN = "und"
# Bytes of a window; the network starts anew in each, so that windows run side by side.
WINDOW = 128
HIDDEN = 8
# Bounds of the training sample: documents of a language, documents in all, windows of a document.
DOCS_PER_LANGUAGE = 300
DOCS = 6_000
WINDOWS_PER_DOC = 6
STEPS = 220
BATCH = 256
SEED = 11
# A text is in no learned language if its score and its share of agreeing positions are both below these, or below what
# all but the share LOW of clean rows reach: held-out rows whose label was found, about CHECKED at most and LEAST_CHECKED at least.
SCORE = 0.5
AGREEING = 0.5
LOW = 0.01
CHECKED = 6_000
LEAST_CHECKED = 100
_LETTER = regex.compile(r"\p{L}")

Params = dict[str, np.ndarray]


def windows(raw: bytes) -> np.ndarray:
    """A text's bytes in rows of WINDOW, the last filled up with zeros."""
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros(-(-len(data) // WINDOW) * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(-1, WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# --- network ------------------------------------------------------------------------------------------------


def start(classes: int, hidden: int = HIDDEN, seed: int = SEED) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
    params: Params = {}
    for way in "fb":
        for gate in "zrn":
            params[f"{way}E{gate}"] = draw(0.3, 256, hidden)
            params[f"{way}U{gate}"] = draw(1 / np.sqrt(hidden), hidden, hidden)
        params[f"{way}c"] = np.zeros(hidden, np.float32)
        params[f"{way}O"] = draw(0.3, hidden, classes)
    params["o"] = np.zeros(classes, np.float32)
    return params


def _scan(p: Params, way: str, steps: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, rows, hidden) in the order of `steps` (time, rows); masked positions keep the state at zero."""
    tables = [p[f"{way}E{g}"] for g in "zrn"]
    uz, ur, un, c = p[f"{way}Uz"], p[f"{way}Ur"], p[f"{way}Un"], p[f"{way}c"]
    hidden = len(c)
    out = np.empty((*steps.shape, hidden), np.float32)
    h = np.zeros((steps.shape[1], hidden), np.float32)
    for t, letters in enumerate(steps):
        gz, gr, gn = (np.take(e, letters, axis=0) for e in tables)
        gz += h @ uz
        gr += h @ ur
        z, r = sigmoid(gz), sigmoid(gr)
        a = h @ un
        a += c
        gn += r * a
        n = np.tanh(gn, out=gn)
        new = h - n
        new *= z
        new += n
        if mask is not None:
            new *= mask[t][:, None]
        if keep is not None:
            keep.append((h, z, r, n, a))
        h = new
        out[t] = h
    return out


def states(p: Params, rows: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward states, both in the order of time."""
    steps = np.ascontiguousarray(rows.T)
    back_mask = None if mask is None else mask[::-1]
    if keep is not None:
        keep |= {"f": [], "b": []}
    forth = _scan(p, "f", steps, mask, None if keep is None else keep["f"])
    back = _scan(p, "b", steps[::-1], back_mask, None if keep is None else keep["b"])
    return forth, back[::-1]


def position_probabilities(p: Params, rows: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """(classes, time, rows): the label distribution of every byte."""
    forth, back = states(p, rows, mask)
    hidden = forth.shape[-1]
    logits = p["fO"].T @ forth.reshape(-1, hidden).T
    logits += p["bO"].T @ np.ascontiguousarray(back).reshape(-1, hidden).T
    logits += p["o"][:, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits.reshape(-1, *forth.shape[:2])


def loss_and_gradients(p: Params, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    time = rows.shape[1]
    mask = (np.arange(time)[:, None] < sizes[None, :]).astype(np.float32)
    keep: dict = {}
    forth, back = states(p, rows, mask, keep)
    logits = forth @ p["fO"] + back @ p["bO"] + p["o"]
    logits -= logits.max(axis=-1, keepdims=True)
    probs = np.exp(logits)
    probs /= probs.sum(axis=-1, keepdims=True)
    total = mask.sum()
    own = probs[:, np.arange(len(labels)), labels]
    loss = float(-(np.log(own + 1e-30) * mask).sum() / total)
    delta = probs
    delta[:, np.arange(len(labels)), labels] -= 1
    delta *= (mask / total)[:, :, None]
    grads: Params = {"o": delta.sum(axis=(0, 1))}
    steps = rows.T
    for way, out in (("f", forth), ("b", back)):
        grads[f"{way}O"] = np.einsum("tbh,tbc->hc", out, delta, optimize=True)
        into = delta @ p[f"{way}O"].T
        order = slice(None) if way == "f" else slice(None, None, -1)
        seen, live, into = steps[order], mask[order], into[order]
        uz, ur, un = (p[f"{way}U{g}"] for g in "zrn")
        for g in "zrn":
            grads[f"{way}U{g}"] = np.zeros_like(uz)
        at_gates = {g: np.empty_like(into) for g in "zrn"}
        summed = np.zeros_like(p[f"{way}c"])
        later = np.zeros_like(into[0])
        for t in range(time - 1, -1, -1):
            h, z, r, n, a = keep[way][t]
            dh = (later + into[t]) * live[t][:, None]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            da = dn * r
            grads[f"{way}Uz"] += h.T @ dz
            grads[f"{way}Ur"] += h.T @ dr
            grads[f"{way}Un"] += h.T @ da
            summed += da.sum(axis=0)
            later = dh * z + dz @ uz.T + dr @ ur.T + da @ un.T
            at_gates["z"][t], at_gates["r"][t], at_gates["n"][t] = dz, dr, dn
        grads[f"{way}c"] = summed
        for g in "zrn":
            table = np.zeros_like(p[f"{way}E{g}"])
            np.add.at(table, seen.ravel(), at_gates[g].reshape(-1, table.shape[1]))
            grads[f"{way}E{g}"] = table
    return loss, grads


def fit(rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, classes: int, steps: int = STEPS) -> Params:
    """Adam on batches of windows, the same for the same input."""
    p = start(classes)
    if not len(rows) or classes < 2:
        return p
    rng = np.random.default_rng(SEED)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(len(rows), min(BATCH, len(rows)), replace=False)
        _, grads = loss_and_gradients(p, rows[pick], sizes[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = np.float32(0.02 * min(1.0, 3 * (1 - step / (steps + 1))))
        for k, g in grads.items():
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-12)))
            first[k] = np.float32(0.9) * first[k] + np.float32(0.1) * g
            second[k] = np.float32(0.99) * second[k] + np.float32(0.01) * g * g
            p[k] = p[k] - rate * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return p


# --- documents ----------------------------------------------------------------------------------------------


def held_out() -> Column:
    """Rows that nothing is learned from; rows without an id are neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Windows, their sizes and labels, and the languages: at most DOCS_PER_LANGUAGE labelled documents of each language and DOCS
    in all, drawn by a hash of the id, and up to WINDOWS_PER_DOC windows spread evenly over the whole text of each."""
    learn = (F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    labelled = docs.filter(learn).select("doc_id", "lang")
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.withColumn("rank", F.row_number().over(drawn)).filter(F.col("rank") <= DOCS_PER_LANGUAGE)
    chosen = [r.doc_id for r in ranked.orderBy("rank", "lang", "doc_id").select("doc_id").limit(DOCS).collect()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for doc_id, lang, text in rows:
                raw = text.encode("utf-8", "surrogatepass")
                n = -(-len(raw) // WINDOW)
                for k in sorted({round(x) for x in np.linspace(0, n - 1, min(n, WINDOWS_PER_DOC))} if n else ()):
                    out.append((doc_id, lang, k, raw[k * WINDOW : (k + 1) * WINDOW]))
            names, kinds = ["doc_id", "lang", "at", "raw"], [pa.int64(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    few = docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(chosen)], "doc_id bigint")
    texts = docs.filter(learn).select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id", "left_semi")
    found = texts.mapInArrow(run, "doc_id bigint, lang string, at bigint, raw binary").distinct().toPandas()
    found = found.sort_values(["lang", "doc_id", "at", "raw"])
    languages = sorted(set(found["lang"]))
    rows = np.concatenate([np.zeros((0, WINDOW), np.uint8), *(windows(bytes(x)) for x in found["raw"])])
    sizes = np.array([len(x) for x in found["raw"]], np.int64)
    return rows, sizes, np.array([languages.index(x) for x in found["lang"]], np.int64), languages


def train(docs: DataFrame) -> tuple[Params, list[str]]:
    rows, sizes, labels, languages = training_windows(docs)
    return fit(rows, sizes, labels, len(languages)), languages


def pooled(p: Params, texts: list[bytes], chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean of its positions' probabilities, and per class the number of positions with that label."""
    parts = [windows(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    rows = np.concatenate([np.zeros((0, WINDOW), np.uint8), *parts])
    sizes = np.full(len(rows), WINDOW)
    ends = np.cumsum([len(x) for x in parts], dtype=np.int64) - 1
    for text, end, part in zip(texts, ends, parts, strict=True):
        if len(part):
            sizes[end] = len(text) - (len(part) - 1) * WINDOW
    classes = len(p["o"])
    total, labelled = np.zeros((len(texts), classes)), np.zeros((len(texts), classes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), chunk):
        own = order[at : at + chunk]
        short = sizes[own[-1]] < WINDOW
        mask = (np.arange(WINDOW)[:, None] < sizes[own][None, :]).astype(np.float32) if short else None
        probs = position_probabilities(p, rows[own], mask)
        best = probs.argmax(axis=0)
        if mask is not None:
            probs *= mask
            best = np.where(mask > 0, best, -1)
        np.add.at(total, owner[own], probs.sum(axis=1, dtype=np.float64).T)
        counts = np.stack([(best == c).sum(axis=0) for c in range(classes)], axis=1)
        np.add.at(labelled, owner[own], counts)
    size = np.maximum(1, [len(t) for t in texts])
    return total / size[:, None], labelled


def with_language(docs: DataFrame, p: Params, languages: list[str], keep_text: bool = True) -> DataFrame:
    """`docs` with the columns lang_pred, score and agreeing, see `identify`; without `text` unless `keep_text`."""
    shared = docs.sparkSession.sparkContext.broadcast((p, languages))
    kept = [f for f in docs.schema if keep_text or f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double", "agreeing double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, languages = shared.value
        for batch in slices(batches, limit=2 << 20):
            texts = batch.column("text").to_pylist()
            lettered = sorted({t for t in texts if t and languages and _LETTER.search(t)})
            raw = [t.encode("utf-8", "surrogatepass") for t in lettered]
            mean, labelled = pooled(p, raw) if raw else (np.zeros((0, 1)), np.zeros((0, 1)))
            found = {}
            for text, data, probs, counts in zip(lettered, raw, mean, labelled, strict=True):
                best = int(probs.argmax())
                found[text] = languages[best], round(min(1.0, float(probs[best])), 6), int(counts[best]) / len(data)
            rows = [found.get(t, (UNKNOWN, 0.0, 0.0)) for t in texts]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            names = [f.name for f in kept]
            yield pa.record_batch([*(batch.column(n) for n in names), *made], names=[*names, "lang_pred", "score", "agreeing"])

    return docs.mapInArrow(run, schema)


def lettered() -> Column:
    return F.coalesce(F.col("text").rlike(_LETTER.pattern), F.lit(False))


def thresholds(docs: DataFrame, p: Params, languages: list[str]) -> tuple[float, float]:
    """The score and the share of agreeing positions below which, both together, a text is in no learned language.

    Zero, so that nothing is, where fewer than two languages are learned or too few labelled rows are held out to tell.
    """
    rows = docs.filter(held_out() & F.col("lang").isin(languages) & lettered()).select("doc_id", "text", "lang")
    n = rows.count() if len(languages) > 1 else 0
    if n < LEAST_CHECKED:
        return 0.0, 0.0
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // CHECKED))) == 0)
    right = with_language(some, p, languages, keep_text=False).filter(F.col("lang") == F.col("lang_pred"))
    low = [F.percentile(c, F.lit(LOW)) for c in ("score", "agreeing")]
    found, score, agreeing = right.agg(F.count(F.lit(1)), *low).first()
    return (min(SCORE, score), min(AGREEING, agreeing)) if found >= LEAST_CHECKED else (0.0, 0.0)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, agreeing) for every row of `docs` (doc_id, text, lang; other columns are not read).

    The network is trained on a bounded sample of labelled rows (see `training_windows`) that are not held out, and then reads
    every byte of every text in windows: each position gets a label distribution from both directions, the mean of all positions
    is the document's, `score` its largest value and `agreeing` the share of positions whose own label is the document's. The
    language, source and id of a row are no inputs of its prediction; equal texts get equal results.

    Null texts and texts without a letter are `und` with score 0, and so is everything if no row is labelled. An empty table gives
    no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    p, languages = train(docs)
    found = with_language(docs.select("doc_id", "text", held_out().alias("held_out")), p, languages, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score", "agreeing")
