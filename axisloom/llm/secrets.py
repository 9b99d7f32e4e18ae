"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is learned from random strings, one from ordinary identifiers; both are tables of counts of neighbouring
characters, from labelled samples. A run of identifier characters, or what fixed patterns leave of it, is a secret if it
is likelier as a random string by enough; how much is enough follows from samples that were not learned from.

Without samples of one's own, `made_samples` makes them of the corpus: identifiers from its words, written in the ways of
names in code, paths and numbers, and random strings in several alphabets from digests of its texts.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm.common import lean, saved, slices, smallest, text_docs
from axisloom.plans.ship import shipped

#: The base patterns, in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("pass", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the models look at, and their alphabet; every other byte ends a run.
LEAST = 16
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
K = len(ALPHABET) + 1
CODE = np.zeros(256, np.int64)
CODE[list(ALPHABET)] = np.arange(1, K)


@cache
def candidates(shortest: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{shortest},}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost and non-overlapping within a kind, failing matches dropped."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def steps(data: bytes) -> np.ndarray:
    """prev * K + next for all neighbouring characters, both in the alphabet; code 0 stands before and after a run."""
    code = CODE[np.frombuffer(b"\0" + data + b"\0", np.uint8)]
    pair = code[:-1] * K + code[1:]
    return pair[pair > 0]


def counted(strings: DataFrame) -> DataFrame:
    """(random boolean, step int, n long): steps counted over (value string, random boolean) labelled samples.

    Null values and labels are left out. Rows are summed in each task before they are shuffled: 2 * 68 * 68 at most.
    """

    def run(batches):
        held = np.zeros((2, K * K), np.int64)
        for b in batches:
            kinds = np.array(b.column("random").to_pylist(), bool)
            values = b.column("value").to_pylist()
            for kind in (False, True):
                mine = "\0".join(v for v, k in zip(values, kinds, strict=True) if k == kind)
                held[int(kind)] += np.bincount(steps(mine.encode("utf-8", "surrogatepass")), minlength=K * K)
        kind, step = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(bool)), pa.array(step.astype(np.int32)), pa.array(held[kind, step])], ["random", "step", "n"])

    shipped(strings.sparkSession)
    return strings.where("value IS NOT NULL AND random IS NOT NULL").select("value", "random").mapInArrow(run, "random boolean, step int, n long").groupBy("random", "step").agg(F.sum("n").alias("n"))


#: The alphabets of random strings, as shares of a digest's bits.
ALPHABETS = {
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "lower": "abcdefghijklmnopqrstuvwxyz", "HEX": "0123456789ABCDEF", "hex": "0123456789abcdef",
}


def random_strings(rng: random.Random) -> list[str]:
    """One string of 16 to 64 characters in each alphabet, and a padded base64 one."""
    out = ["".join(rng.choices(a, k=rng.randint(LEAST, 64))) for a in ALPHABETS.values()]
    return [*out, base64.b64encode(rng.randbytes(rng.choice((13, 16, 19, 20, 32)))).decode()]


def identifiers(text: str, rng: random.Random) -> list[str]:
    """Names made of neighbouring words of a text, its long words, and numbers."""
    found = re.findall("[A-Za-z]{2,}", text)
    out = [w for w in found if len(w) >= LEAST][:20] + ["".join(rng.choices("0123456789", k=rng.randint(LEAST, 20)))]
    for _ in range(min(10, len(found) // 4)):
        at = rng.randrange(len(found) - 3)
        w = [x.lower() for x in found[at : at + rng.randint(2, 4)]]
        year = str(rng.randint(1, 2030))
        out.append(rng.choice((
            "_".join(w), "-".join(w), "/".join(w), "_".join(w).upper(), w[0] + "".join(x.title() for x in w[1:]), "".join(x.title() for x in w), "".join(w),
            "_".join([*w, year]), "-".join([year, *w]), "/".join([*w[:-1], year, w[-1]]), "=".join(w[:2]) + "_" + year, "+".join(w), w[0] + "-" * rng.randint(3, 30) + w[-1], rng.choice("-_=") * rng.randint(LEAST, 80),
        )))
    return [x for x in out if len(x) >= LEAST and candidates(LEAST).fullmatch(x)]


def made_samples(docs: DataFrame, max_docs: int = 4000) -> DataFrame:
    """(value string, random boolean) samples from max_docs different texts at most, as `scan` takes them.

    Equal tables give equal samples. Texts without words give random strings and numbers alone; an empty table none.
    """
    some = smallest(text_docs(docs).select("text"), max_docs, "text")

    def run(batches):
        for b in batches:
            for _, texts in slices(b, "text", 1_000_000):
                out: list[tuple[str, bool]] = []
                for t in texts:
                    rng = random.Random(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest())
                    out += [(v, True) for v in random_strings(rng)] + [(v, False) for v in identifiers(t, rng)]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.string()), pa.array([k for _, k in out], pa.bool_())], ["value", "random"])

    return some.mapInArrow(run, "value string, random boolean")


def ratio_table(counts: DataFrame) -> np.ndarray:
    """log P(next | prev) as a random string minus that as an identifier, for each step, add-one smoothed.

    Without any random strings every next character of the alphabet is as likely there.
    """
    n = np.zeros((2, K, K))
    for r in counts.collect():
        n[int(r["random"]), r["step"] // K, r["step"] % K] = r["n"]
    p = np.log(n + 1) - np.log((n + 1).sum(axis=2, keepdims=True))
    return (p[1] - p[0]).reshape(-1)


def gain(value: str, ratio: np.ndarray) -> float:
    """How much likelier a string is as a random one: the log of the ratio."""
    return float(ratio[steps(value.encode("utf-8", "surrogatepass"))].sum())


@dataclass
class Judge:
    """Log ratios of steps, and the least gain of a secret."""

    ratio: np.ndarray
    least: float


def trained(samples: DataFrame, false_share: float = 0.001) -> Judge:
    """A judge from labelled strings (value, random): four fifths are learned from, by crc32 of the value.

    The least gain is the one that no more than false_share of the identifiers that were not learned from reach, and
    above 0. Without such identifiers it is 12.
    """
    shipped(samples.sparkSession)
    some = saved(samples.select("value", "random").where("value IS NOT NULL AND random IS NOT NULL"))
    learned = F.crc32(F.col("value").cast("binary")) % 5 != 0
    ratio = ratio_table(counted(some.where(learned)))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gain(v, ratio) for v in b.column("value").to_pylist()], pa.float64())], ["gain"])

    held = some.where(~learned & ~F.col("random")).select("value").mapInArrow(run, "gain double")
    least = held.agg(F.percentile("gain", F.lit(1 - false_share)).alias("x")).first()["x"]
    return Judge(ratio, 12.0 if least is None else max(float(np.nextafter(least, np.inf)), 1e-9))


def united(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Runs of overlapping spans as [start, end], in order."""
    runs: list[list[int]] = []
    for s, _, e in sorted(spans):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(e, runs[-1][1])
        else:
            runs.append([s, e])
    return runs


def scored_spans(text: str, judge: Judge, base: list[tuple[int, int, int]], shortest: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs, or what base spans leave of them, of `shortest` characters or more, whose gain is enough.

    Runs and base spans are walked side by side, so time is linear in the text.
    """
    found, held, i = [], united(base), 0
    for m in candidates(shortest).finditer(text):
        at, stop = m.start(), m.end()
        while i < len(held) and held[i][1] <= at:
            i += 1
        while i < len(held) and held[i][0] < stop:
            found.append((at, held[i][0]))
            at = max(at, held[i][1])
            if held[i][1] > stop:
                break  # it may reach into the next run
            i += 1
        found.append((at, stop))
    return [(a, 3, b) for a, b in found if b - a >= shortest and gain(text[a:b], judge.ratio) >= judge.least]


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "<SECRET>") -> str:
    """Each run of overlapping spans gives way to one mark."""
    out, at = [], 0
    for s, e in united(spans):
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, samples: DataFrame | None = None, texts: bool = False, more: tuple[str, ...] = (), shortest: int = LEAST) -> DataFrame:
    """Secrets of every row: (doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans), or with texts the row redacted.

    samples: (value, random) labelled strings to train on and to set the threshold with; by default those of made_samples.
    shortest: the models look at runs of so many characters or more; shorter strings are too like words to be told apart
    (README has the shares missed by length). texts: return (doc_id, text with the spans redacted, and the columns named in more) instead. Offsets are code points,
    ends exclusive. Null and empty texts have no spans; equal texts have equal spans; repeated rows give repeated rows; a
    null doc_id stays null; an empty table gives no rows; columns that are not named are ignored.
    """
    judge = trained(made_samples(docs) if samples is None else samples)
    rows = text_docs(docs, *more)
    names = [f.name for f in rows.schema]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) if texts else "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"

    def run(batches):
        for b in batches:
            for at, piece in slices(b, "text", 2_000_000):
                base = [base_spans(t) for t in piece]
                found = [s + scored_spans(t, judge, s, shortest) for s, t in zip(base, piece, strict=True)]
                if texts:
                    cols = {n: b.column(n).slice(at, len(piece)) for n in names}
                    cols["text"] = pa.array([redact(t, s) if s else t for t, s in zip(piece, found, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)
                else:
                    n = [pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64()) for kind in range(4)]
                    digest = [hashlib.sha256(listed(s).encode()).hexdigest() for s in base]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(piece)), *n, pa.array(digest), pa.array(list(map(listed, found)))], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return rows.mapInArrow(lean(run), shape)
