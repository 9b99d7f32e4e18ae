"""Language identification with a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes are cut into windows. Over each window one gated recurrent network runs forwards and one backwards; a
softmax over both states labels every position, and a text's probabilities are the average of its positions'. Training is
backpropagation through time on windows of a bounded sample of labelled rows; prediction runs in the tasks that read the
texts, over whole texts.

With states h of H numbers in each direction and byte b at a position:

    r, z = clip(R[b] + Ur h, 0, 1), clip(Z[b] + Uz h, 0, 1)      gates, piecewise linear
    n    = softsign(N[b] + r * (Un h))                           candidate
    h    = n + z * (h - n)

Both functions are a few vector instructions in numpy where a tangent would be a call for each number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisloom.llm.common import saved, slices, split_hash, text_docs


@dataclass
class Settings:
    hidden: int = 8
    #: Positions of a window; states begin anew in each.
    window: int = 128
    #: At most so many texts of each language are learned from, and so many windows of each, spread over the whole text.
    rows_per_language: int = 600
    windows_per_row: int = 4
    epochs: int = 3
    batch: int = 128
    rate: float = 0.02
    seed: int = 11
    #: Windows that run beside each other when texts are labelled.
    side: int = 1024


@dataclass
class Model:
    """languages in order; params: for each direction d, T{d} (3H x 256), U{d} (3H x H), O{d} (languages x H), and the bias b."""

    settings: Settings
    languages: list[str]
    params: dict[str, np.ndarray]


def fresh(languages: list[str], s: Settings, dtype=np.float32) -> Model:
    rng, h, k = np.random.default_rng(s.seed), s.hidden, len(languages)
    params = {"b": np.zeros((k, 1), dtype)}
    for d in "fb":
        t = rng.normal(0, 0.3, (3 * h, 256))
        t[: 2 * h] += 0.5
        params |= {f"T{d}": t.astype(dtype), f"U{d}": rng.normal(0, 0.7 / h**0.5, (3 * h, h)).astype(dtype), f"O{d}": rng.normal(0, 1 / h**0.5, (k, h)).astype(dtype)}
    return Model(s, languages, params)


def cut(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the windows of a text; none of an empty one."""
    starts = np.arange(0, len(text), window)
    return starts, np.minimum(window, len(text) - starts)


def laid_out(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes by (position, window); what is beyond a window's end is any byte."""
    at = starts[None] + np.arange(int(lengths.max()))[:, None]
    return data[np.minimum(at, len(data) - 1)].astype(np.intp)


class Pass:
    """One direction over windows that are sorted by falling length, so that those that reach a position come first.

    Keeps what backpropagation needs if `keep` is set.
    """

    def __init__(self, m: Model, d: str, x: np.ndarray, live: list[int], keep: bool = False):
        self.t, self.u, self.d, self.x, self.live = m.params[f"T{d}"], m.params[f"U{d}"], d, x, live
        self.h, self.kept = np.zeros((self.u.shape[1], x.shape[1]), self.u.dtype), [] if keep else None
        self.g, self.e = np.empty((len(self.u), x.shape[1]), self.u.dtype), np.empty((len(self.u), x.shape[1]), self.u.dtype)

    def order(self) -> range:
        return range(len(self.live)) if self.d == "f" else range(len(self.live) - 1, -1, -1)

    def step(self, i: int) -> np.ndarray:
        """The states at position i of the windows that reach it."""
        n, k = self.live[i], len(self.h)
        h, g, e = (a if n == a.shape[1] else a[:, :n] for a in (self.h, self.g, self.e))
        if n == self.h.shape[1]:
            np.matmul(self.u, h, out=g)
            np.take(self.t, self.x[i], axis=1, out=e, mode="clip")
        else:
            g[...], e[...] = self.u @ h, self.t[:, self.x[i, :n]]
        gates, new = g[: 2 * k], e[2 * k :]
        gates += e[: 2 * k]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        if self.kept is not None:
            self.kept.append((h.copy(), g[2 * k :].copy()))
        c = g[2 * k :]
        c *= gates[:k]
        new += c
        np.abs(new, out=c)
        c += 1
        new /= c
        h -= new
        h *= gates[k:]
        h += new
        if self.kept is not None:
            self.kept[-1] += (gates.copy(), new.copy())
        return h

    def back(self, out: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of T and U, from those of the states at each position."""
        k, width = len(self.h), self.x.shape[1]
        dh, du = np.zeros_like(self.h), np.zeros_like(self.u)
        dx, at = [], []
        for i, (h, c, gates, new) in zip(reversed(self.order()), reversed(self.kept), strict=True):
            n = self.live[i]
            g = dh[:, :n] + out[i]
            dn = g * (1 - gates[k:])
            dm = dn * (1 - np.abs(new)) ** 2
            inner = np.concatenate([dm * c, g * (h - new)])
            inner *= (gates > 0) & (gates < 1)
            dg = np.concatenate([inner, dm * gates[:k]])
            dh = np.zeros((k, width), self.u.dtype) if n < width else dh
            dh[:, :n] = g * gates[k:] + self.u.T @ dg
            du += dg @ h.T
            dx.append(np.concatenate([inner, dm]))
            at.append(self.x[i, :n])
        dx, at = np.concatenate(dx, axis=1), np.concatenate(at)
        return {f"T{self.d}": np.stack([np.bincount(at, row, 256) for row in dx]).astype(self.u.dtype), f"U{self.d}": du}


def softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def reach(lengths: np.ndarray) -> list[int]:
    """How many windows reach each position; lengths fall."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()


def gradients(m: Model, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all positions' labels with their windows' classes, and its gradients. lengths fall."""
    live, p = reach(lengths), m.params
    passes = {d: Pass(m, d, x, live, keep=True) for d in "fb"}
    states: dict[str, dict[int, np.ndarray]] = {d: {i: q.step(i).copy() for i in q.order()} for d, q in passes.items()}
    total, loss, grads = sum(live), 0.0, {k: np.zeros_like(v) for k, v in p.items()}
    out = {d: [None] * len(live) for d in "fb"}
    for i, n in enumerate(live):
        z = softmax(p["Of"] @ states["f"][i] + p["Ob"] @ states["b"][i] + p["b"])
        loss -= float(np.log(np.maximum(z[y[:n], np.arange(n)], 1e-30)).sum()) / total
        z[y[:n], np.arange(n)] -= 1
        z /= total
        grads["b"] += z.sum(axis=1, keepdims=True)
        for d in "fb":
            grads[f"O{d}"] += z @ states[d][i].T
            out[d][i] = p[f"O{d}"].T @ z
    for d, q in passes.items():
        grads |= q.back(out[d])
    return loss, grads


def fit(texts: list[bytes], labels: list[str], settings: Settings | None = None) -> Model:
    """A network that labels every position of a text with the text's language; Adam on batches in an order drawn from the seed.

    With no texts it knows no language; with one language it always answers with that.
    """
    s = settings or Settings()
    languages = sorted(set(labels))
    m = fresh(languages, s)
    data, starts, lengths, y, at = [], [], [], [], 0
    for text, label in zip(texts, labels, strict=True):
        first, n = cut(text, s.window)
        pick = np.unique(np.linspace(0, len(first) - 1, min(len(first), s.windows_per_row)).round().astype(int)) if len(first) else np.empty(0, int)
        starts += (first[pick] + at).tolist()
        lengths += n[pick].tolist()
        y += [languages.index(label)] * len(pick)
        data.append(text)
        at += len(text)
    if len(languages) < 2 or not y:
        return m
    data, starts, lengths, y = np.frombuffer(b"".join(data), np.uint8), np.array(starts), np.array(lengths), np.array(y)
    # Each language has the same weight, however many of its windows there are.
    rng, share = np.random.default_rng(s.seed), 1 / np.bincount(y, minlength=len(languages))[y]
    first, second = ({k: np.zeros_like(v) for k, v in m.params.items()} for _ in range(2))
    steps = max(1, s.epochs * len(y) // s.batch)
    for step in range(steps):
        rows = rng.choice(len(y), s.batch, p=share / share.sum())
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        _, grads = gradients(m, laid_out(data, starts[rows], lengths[rows]), lengths[rows], y[rows])
        size = sum(float((g**2).sum()) for g in grads.values()) ** 0.5
        rate = s.rate * (1 - step / steps)
        for k, g in grads.items():
            g *= min(1.0, 1 / max(size, 1e-12))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            m.params[k] -= (rate * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(m.params[k].dtype)
    return m


def labelled(m: Model, x: np.ndarray, lengths: np.ndarray):
    """(position, probabilities by class and window) of every position, from the last to the first. lengths fall."""
    live, p = reach(lengths), m.params
    ahead = Pass(m, "f", x, live)
    early = [p["Of"] @ ahead.step(i) for i in ahead.order()]
    back = Pass(m, "b", x, live)
    for i in back.order():
        z = early[i]
        z += p["Ob"] @ back.step(i)
        z += p["b"]
        yield i, softmax(z)


def probabilities(m: Model, texts: list[bytes]) -> np.ndarray:
    """(texts x languages) averages of the positions' probabilities; zeros for empty texts."""
    w = m.settings.window
    parts = [cut(t, w) for t in texts]
    ends = np.cumsum([0, *map(len, texts)])
    starts = np.concatenate([np.empty(0, np.int64), *(p[0] + e for p, e in zip(parts, ends, strict=False))])
    lengths = np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])
    of = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sums = np.zeros((len(m.languages), len(starts)))
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), m.settings.side):
        rows = order[at : at + m.settings.side]
        x = laid_out(data, starts[rows], lengths[rows])
        held = np.zeros((len(m.languages), len(rows)), np.float32)
        for _, p in labelled(m, x, lengths[rows]):
            held[:, : p.shape[1]] += p
        sums[:, rows] = held
    whole = np.stack([np.bincount(of, row, len(texts)) for row in sums], axis=1) if len(sums) else np.zeros((len(texts), 0))
    return whole / np.maximum(1, np.diff(ends))[:, None]


def has_letter(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"\p{L}")


def train(docs: DataFrame, learn_from: Column | None = None, settings: Settings | None = None) -> Model:
    """A model of column lang, from rows with a language and a letter for which learn_from (a condition on doc_id) holds.

    At most rows_per_language distinct texts of each language are gathered, those with the smallest hashes: rows are kept
    by a bound on the hash that leaves so many, with a margin, before anything is moved. Equal texts of one language count
    once. An empty table, or one without such rows, gives a model that knows no language.
    """
    s = settings or Settings()
    rows = text_docs(docs, "lang").where(F.col("lang").isNotNull() & has_letter("text"))
    if learn_from is not None:
        rows = rows.where(learn_from)
    hashed = rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(1 << 62)).alias("h"), "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return fresh([], s)
    n = s.rows_per_language
    bound = {k: int(min(1.0, (n + 6 * n**0.5 + 20) / v) * (1 << 62)) for k, v in sizes.items()}
    limits = docs.sparkSession.createDataFrame(list(bound.items()), "lang string, bound long")
    near = saved(hashed.join(F.broadcast(limits), "lang").where("h <= bound").select("lang", "h", "text").dropDuplicates(["lang", "h"]))
    held = sorted((r["lang"], r["h"], r["text"]) for r in near.toLocalIterator())
    taken: dict[str, int] = {}
    texts, labels = [], []
    for lang, _, text in held:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= n:
            texts.append(text.encode("utf-8", "surrogatepass"))
            labels.append(lang)
    return fit(texts, labels, s)


def predict(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """Every row's doc_id and named columns with lang_pred and score, the pooled probability of that language.

    lang_pred is `und`, and score 0, for null texts, texts without a letter, and where the model knows no language. Of
    equal probabilities the first language in order wins. Every position of a text is labelled, however long it is. Equal
    texts have equal results up to the rounding of sums; rows with a null id are kept; an empty table gives no rows;
    columns that are not named are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = text_docs(docs, *more).withColumn("letter", has_letter("text"))
    keep = [f for f in rows.schema if f.name not in ("text", "letter")]

    def run(batches):
        m = held.value
        for b in batches:
            letter = b.column("letter").to_pylist()
            for at, texts in slices(b, "text", 1_000_000):
                fine = [letter[at + i] and bool(m.languages) for i in range(len(texts))]
                p = probabilities(m, [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, fine, strict=True)])
                best = p.argmax(axis=1) if m.languages else np.zeros(len(texts), int)
                names = [m.languages[i] if ok else "und" for i, ok in zip(best.tolist(), fine, strict=True)]
                score = [float(p[i, best[i]]) if ok else 0.0 for i, ok in enumerate(fine)]
                cols = [b.column(f.name).slice(at, len(texts)) for f in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], [*(f.name for f in keep), "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", lang_pred string, score double")


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Rows not to learn from, by the crc32 of the id's decimal text."""
    return split_hash(F.col("doc_id")) % modulus == remainder
