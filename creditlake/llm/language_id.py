"""Language identification: a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.store import tidy

UNKNOWN = "und"
#: Bounds of the training sample: rows of each language, spans of each row, and languages (the most frequent ones).
SAMPLE_ROWS, SAMPLE_SPANS, LANGUAGES = 400, 12, 200
#: Units of a direction, bytes of a span to learn from, bytes of a window that are labelled, and those read on each side.
UNITS, LEARN, SPAN, HALO = 12, 48, 224, 16
#: Windows that are labelled at once.
BATCH = 512


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves no remainder by 5. A null id counts as
    an empty text, and so is held out."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


class Network:
    """Gated recurrent units in both directions over bytes, and a softmax over languages at every byte."""

    def __init__(self, languages: int, units: int = UNITS, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.units = units
        shape = {"b": (languages,), "out": (2 * units, languages)}
        for d in "fr":
            shape |= {f"in_{d}": (256, 3 * units), f"own_{d}": (units, 3 * units), f"bias_{d}": (3 * units,)}
        self.w = {k: (rng.normal(size=s) * (0.3 if k[:2] == "in" else 1 / np.sqrt(s[0])) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def _forward(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """States after each byte of x (windows x length, read from the right for d = r), and what the way back needs."""
        u, w = self.units, self.w
        h = np.zeros((len(x), u), np.float32)
        states, kept = np.empty((x.shape[1], len(x), u), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a = w[f"in_{d}"][x[:, t]]
            b = h @ w[f"own_{d}"] + w[f"bias_{d}"]
            gates = 1 / (1 + np.exp(-(a[:, : 2 * u] + b[:, : 2 * u])))
            z, r = gates[:, :u], gates[:, u:]
            n = np.tanh(a[:, 2 * u :] + r * b[:, 2 * u :])
            kept.append((t, h, z, r, n, b[:, 2 * u :]))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def _add(self, said: np.ndarray, x: np.ndarray, d: str, margin: int) -> None:
        """Add to said (position, window, language) what direction d says after each byte of x (position x window), but
        for margin positions at either end. Each state gives way to the next, as nothing is kept for a way back."""
        u, own, out = self.units, self.w[f"own_{d}"], self.w["out"]
        out = out[:u] if d == "f" else out[u:]
        table, bias = self.w[f"in_{d}"], self.w[f"bias_{d}"]
        gate, new = -(table[:, : 2 * u] + bias[: 2 * u]), np.ascontiguousarray(table[:, 2 * u :])
        own_gate, own_new = -own[:, : 2 * u], np.ascontiguousarray(own[:, 2 * u :])
        h = np.zeros((x.shape[1], u), table.dtype)
        g, read_gate = (np.empty((x.shape[1], 2 * u), table.dtype) for _ in range(2))
        n, read_new = (np.empty((x.shape[1], u), table.dtype) for _ in range(2))
        for t in range(len(x) - margin) if d == "f" else range(len(x) - 1, margin - 1, -1):
            np.matmul(h, own_gate, out=g)
            g += np.take(gate, x[t], axis=0, out=read_gate, mode="clip")
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.matmul(h, own_new, out=n)
            n += bias[2 * u :]
            n *= g[:, u:]
            n += np.take(new, x[t], axis=0, out=read_new, mode="clip")
            np.tanh(n, out=n)
            h -= n
            h *= g[:, :u]
            h += n
            if margin <= t < len(x) - margin:
                said[t - margin] += h @ out

    def positions(self, x: np.ndarray, margin: int = 0) -> np.ndarray:
        """Log probabilities (position, window, language) of windows of one length, as rows of bytes; margin bytes at
        either end are read only."""
        x = np.ascontiguousarray(x.T)
        said = np.empty((len(x) - 2 * margin, x.shape[1], len(self.w["b"])), self.w["b"].dtype)
        said[:] = self.w["b"]
        for d in "fr":
            self._add(said, x, d, margin)
        said -= said.max(axis=2, keepdims=True)
        said -= np.log(np.exp(said).sum(axis=2, keepdims=True))
        return said

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, each labelled with its window's language y, and its slopes, through time."""
        u, w = self.units, self.w
        run = {d: self._forward(x, d) for d in "fr"}
        both = np.concatenate([run[d][0] for d in "fr"], axis=2)
        said = both @ w["out"] + w["b"]
        said = np.exp(said - said.max(axis=2, keepdims=True))
        said /= said.sum(axis=2, keepdims=True)
        rows = np.arange(len(x))
        loss = -float(np.log(said[:, rows, y] + 1e-12).mean())
        said[:, rows, y] -= 1
        said /= said.shape[0] * said.shape[1]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"] = np.einsum("tbh,tbl->hl", both, said)
        g["b"] = said.sum(axis=(0, 1))
        back = said @ w["out"].T
        for i, d in enumerate("fr"):
            later, moved = np.zeros((len(x), u), w["b"].dtype), []
            for t, h, z, r, n, inner in reversed(run[d][1]):
                dh = later + back[t, :, i * u : (i + 1) * u]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                moved.append(da)
                g[f"own_{d}"] += h.T @ db
                g[f"bias_{d}"] += db.sum(axis=0)
                later = dh * z + db @ w[f"own_{d}"].T
            read = np.concatenate([x[:, t] for t, *_ in reversed(run[d][1])])
            order = np.argsort(read, kind="stable")
            bytes_, first = np.unique(read[order], return_index=True)
            g[f"in_{d}"][bytes_] = np.add.reduceat(np.concatenate(moved)[order], first, axis=0)
        return loss, g


def readable(text: str | None) -> bytes:
    """The bytes that the network reads of a text: all of it, in lower case; none if no character is a letter."""
    return text.lower().encode("utf-8", "replace") if text and any(map(str.isalpha, text)) else b""


def trained(spans: list[np.ndarray], steps: int = 300, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Network:
    """A network that tells spans[0], spans[1], ... (rows of bytes) apart: Adam over batches with as many from each."""
    net, rng = Network(len(spans), seed=seed), np.random.default_rng(seed)
    each = max(1, batch // max(1, len(spans)))
    y = np.repeat(np.arange(len(spans)), each)
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1 if spans else 1):
        x = np.concatenate([own[rng.integers(len(own), size=each)] for own in spans])
        _, g = net.gradients(x, y)
        for k in net.w:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] * g[k] - v[k])
            net.w[k] -= (rate * min(1, 2 - 2 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows(raw: bytes, at: int = 0) -> np.ndarray:
    """Windows (rows) of SPAN bytes of raw from place `at` on, BATCH at most, each with the HALO bytes before and after
    it; spaces stand beyond the ends of raw."""
    many = min(BATCH, -(-(len(raw) - at) // SPAN))
    size = many * SPAN + 2 * HALO
    part = b" " * (HALO - min(at, HALO)) + raw[max(0, at - HALO) : at + size - HALO]
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(part.ljust(size), np.uint8), SPAN + 2 * HALO)[::SPAN]


def documents(net: Network, texts: list[str | None]) -> np.ndarray:
    """Probabilities of the languages for each text: the geometric mean over all its bytes; zeros if it has no letter.

    Fewer than 2 * BATCH windows are labelled at once, so what is held does not grow with the length of a text."""
    raws = [readable(t) for t in texts]
    total = np.zeros((len(raws), len(net.w["b"])))
    held: list[tuple[int, int, np.ndarray]] = []

    def label() -> None:
        text = np.repeat([i for i, _, _ in held], [len(x) for _, _, x in held])
        left = np.concatenate([n - SPAN * np.arange(len(x)) for _, n, x in held])
        said = net.positions(np.concatenate([x for _, _, x in held]), HALO)
        said *= (np.arange(SPAN)[:, None] < left)[:, :, None]
        np.add.at(total, text, said.sum(axis=0, dtype=np.float64))
        held.clear()

    for i, raw in enumerate(raws):
        for at in range(0, len(raw), SPAN * BATCH):
            held.append((i, len(raw) - at, windows(raw, at)))
            if sum(len(x) for _, _, x in held) >= BATCH:
                label()
    if held:
        label()
    mean = total / np.maximum([[len(r)] for r in raws], 1)
    mean = np.exp(mean - mean.max(axis=1, keepdims=True)) if mean.size else mean
    return np.where([[len(r) > 0] for r in raws], mean / np.maximum(mean.sum(axis=1, keepdims=True), 1e-300), 0)


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, spans: int = SAMPLE_SPANS, languages: int = LANGUAGES) -> tuple[list[str], Network]:
    """The languages of docs (the most frequent `languages` of them) and a network trained on a sample of the rows that
    are not held out: about `rows` rows of each, chosen by a hash of the id, and of each `spans` spans of LEARN bytes at
    places drawn over its whole text. Spans are cut in the tasks; only they reach the driver."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    open_ = known.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = open_.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    chosen = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.lit(float(rows)) / F.col("n") * (1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, seed in zip(*batch.columns, strict=True):
                raw = readable(text.as_py())
                if raw:
                    rng = np.random.default_rng([zlib.crc32(raw), seed.as_py()])
                    raw = b" " * HALO + raw + b" " * max(HALO, LEARN - HALO - len(raw))
                    at = np.sort(rng.integers(0, len(raw) - LEARN + 1, size=spans))
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang.as_py()] * spans, pa.string()), "span": pa.array([raw[i : i + LEARN] for i in at], pa.binary())})

    sample = open_.join(F.broadcast(most), "lang").filter(chosen).select("lang", "text", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30))).mapInArrow(tidy(cut), "lang string, span binary")
    own: dict[str, list[bytes]] = {}
    for r in sample.collect():
        own.setdefault(r["lang"], []).append(bytes(r["span"]))
    return sorted(own), trained([np.frombuffer(b"".join(sorted(own[k])), np.uint8).reshape(-1, LEARN) for k in sorted(own)])


def identified(docs: DataFrame, languages: list[str], net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, held_out, lang_pred, score.

    Every byte of a text, in lower case, is labelled from both sides, in overlapping windows; a document's probability of
    a language is the geometric mean over all its bytes, and score is that of lang_pred, the most probable (of equally
    probable ones the first by code point). Null, empty and letterless texts, and all texts if no language was learned,
    are UNKNOWN with score 0. Texts of any length are read whole, a bounded number of windows at a time. Only the text is
    read for a prediction. No row moves; rows that repeat each have their result."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, net.w, net.units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, units = shared.value
        own = Network(len(names), units)
        own.w = weights
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                p = documents(own, part.column(2).to_pylist()) if names else np.zeros((len(part), 1))
                best, score = p.argmax(axis=1), p.max(axis=1)
                said = [names[i] if s > 0 else UNKNOWN for i, s in zip(best.tolist(), score.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(said, pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def recognised(docs: DataFrame, languages: list[str], net: Network, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is UNKNOWN. No row moves."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, net.w, net.units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, units = shared.value
        own = Network(len(names), units)
        own.w = weights
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                p = documents(own, part.column(at).to_pylist()) if names else np.zeros((len(part), 1))
                yield part.filter(pa.array(p.max(axis=1) > 0))

    return docs.mapInArrow(tidy(run), docs.schema)
