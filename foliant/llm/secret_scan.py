"""Secret scan: fixed rules, and a character convolutional network over further candidates."""

from __future__ import annotations

import math
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import whole_text

# Fixed patterns of the base rules; letters of "assign" stand in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "network")

#: What the network looks at: runs of key characters with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


@dataclass(frozen=True)
class ScanParams:
    """Production parameters.

    ``documents``: texts with the smallest hash of their id that training looks at.
    ``examples``: most labelled findings of either class that it keeps. ``recall``: share
    of the held-out secrets that the threshold must let through.
    """

    documents: int = 2_000
    examples: int = 2_000
    around: int = 24
    inside: int = 48
    filters: int = 24
    width: int = 5
    rounds: int = 10
    recall: float = 0.98
    seed: int = 11

    @property
    def length(self) -> int:
        return 2 * self.around + self.inside


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules: leftmost non-overlapping matches per kind.

    A run of hex digits or of access characters that is too short can't hold a longer
    match, so their lengths stand in the pattern; an assign match that is too short still
    uses up its characters.
    """
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Further candidates: runs with both a digit and a letter, without the base spans.

    What a base span leaves of a run, left and right of it, is a candidate of its own,
    however short.
    """
    found, taken = [], sorted(taken)
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if run.isalpha() or not (re.search(r"\d", run) and re.search(r"[A-Za-z]", run)):
            continue
        at, end = m.span()
        whole = True
        for a, b, _ in taken:
            if a < end and b > m.start():
                whole = False
                if a > at:
                    found.append((at, a))
                at = max(at, b)
        if whole or at < end:
            found.append((at, end))
    return [(a, b) for a, b in found if any(c.isalnum() for c in text[a:b])]


_GROUPS = [string.ascii_lowercase, string.ascii_uppercase, string.digits, "+", "/", "_", "=", "-", ".", ":", "\"'", " \t\r\n"]
#: Character code to class: vowels and rarer letters apart, so that words differ from keys.
_CLASS = np.full(128, len(_GROUPS) + 2, np.int64)
for _i, _group in enumerate(_GROUPS):
    for _c in _group:
        _CLASS[ord(_c)] = _i
for _c in "aeiou":
    _CLASS[ord(_c)] = len(_GROUPS)
for _c in "jkqvwxz":
    _CLASS[ord(_c)] = len(_GROUPS) + 1
CLASSES = len(_GROUPS) + 3


def window(text: str, a: int, b: int, p: ScanParams) -> np.ndarray:
    """Classes around and inside a span of at most ``inside`` characters, with an offset inside."""
    inside = text[a:b]
    left, right = text[max(0, a - p.around) : a], text[b : b + p.around]
    code = lambda s: _CLASS[np.minimum(np.frombuffer(s.encode("utf-32-le"), "<u4"), 127)] if s else np.zeros(0, np.int64)
    row = np.full(p.length, 2 * CLASSES, np.int64)
    row[p.around - len(left) : p.around] = code(left)
    row[p.around : p.around + len(inside)] = code(inside) + CLASSES
    row[p.around + p.inside : p.around + p.inside + len(right)] = code(right)
    return row


def views(a: int, b: int, p: ScanParams) -> Iterator[tuple[int, int]]:
    """Overlapping spans of at most ``inside`` characters over a whole run.

    They start a quarter of their length apart, so that every stretch of three quarters
    of it lies in one of them.
    """
    last = max(a, b - p.inside)
    for at in range(a, last, p.inside // 4):
        yield at, at + p.inside
    yield last, b


class CharNet:
    """One convolution over embedded characters, maximum and mean pooling, logistic output."""

    def __init__(self, p: ScanParams):
        self.p = p
        r = np.random.default_rng(p.seed)
        self.w = {
            # a convolution over one-hot characters is a table lookup per offset
            "conv": r.normal(0, 0.2, (p.width, 2 * CLASSES + 1, p.filters)),
            "bias": np.zeros(p.filters),
            "out": r.normal(0, 0.2, 2 * p.filters),
            "end": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0
        self.reached = self.passed = None

    def _forward(self, x: np.ndarray):
        n, w = x.shape[1] - self.p.width + 1, self.w
        z = w["bias"] + sum(w["conv"][k][x[:, k : k + n]] for k in range(self.p.width))
        act = np.maximum(z, 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1)
        return act, top, pooled, pooled @ w["out"] + w["end"][0]

    def margins(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 256])[3] for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of a secret."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(x) + self.shift, -50, 50)))

    def best(self, runs: list[tuple[str, int, int]], block: int = 2048) -> np.ndarray:
        """The highest chance in any view of each (text, start, end); holds ``block`` views."""
        top, rows, owner = np.zeros(len(runs)), [], []

        def flush() -> None:
            if rows:
                np.maximum.at(top, owner, self.chance(np.stack(rows)))
                rows.clear()
                owner.clear()

        for i, (text, a, b) in enumerate(runs):
            for x, y in views(a, b, self.p):
                rows.append(window(text, x, y, self.p))
                owner.append(i)
                if len(rows) == block:
                    flush()
        flush()
        return top

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the logistic loss, in a fixed order."""
        r, f = np.random.default_rng(self.p.seed), self.p.filters
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(self.p.rounds):
            order = r.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = order[at : at + 128]
                act, top, pooled, margin = self._forward(x[rows])
                d = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[rows]) / len(rows)
                g = {"out": pooled.T @ d, "end": np.array([d.sum()])}
                dp = d[:, None] * self.w["out"][None]
                n = act.shape[1]
                da = np.repeat(dp[:, None, f:] / n, n, axis=1)
                np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :f], 1)
                da *= act > 0
                g["bias"] = da.sum((0, 1))
                g["conv"] = np.zeros_like(self.w["conv"])
                for k in range(self.p.width):
                    np.add.at(g["conv"][k], x[rows][:, k : k + n], da)
                step += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                    self.w[k] = self.w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on held-out findings."""
        s = self.margins(x)
        a, b = 1.0, 0.0
        for _ in range(500):
            q = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
            a, b = a - 0.1 * (((q - y) * s).mean() + 0.01 * (a - 1)), b - 0.1 * (q - y).mean()
        self.scale, self.shift = a, b

    def constrain(self, secrets: list[tuple[str, int, int]], plain: list[tuple[str, int, int]]) -> None:
        """The highest threshold that keeps the wanted share of held-out ``secrets``.

        Also keeps the shares of both kinds that reach it.
        """
        if secrets:
            good = np.sort(self.best(secrets))[::-1]
            self.threshold = float(good[min(len(good), max(1, math.ceil(self.p.recall * len(good) - 1e-9))) - 1])
            self.reached = float((good >= self.threshold).mean())
        if plain:
            self.passed = float((self.best(plain) >= self.threshold).mean())


def _made_secrets(r: np.random.Generator, n: int) -> list[str]:
    """Random keys in common shapes, for findings that a corpus sample has too few of."""
    letters = string.ascii_letters + string.digits
    some = lambda chars, k: "".join(r.choice(list(chars), k))
    shapes = [
        lambda: "ghp_" + some(letters, 36),
        lambda: "sk-" + some(letters, int(r.integers(24, 49))),
        lambda: some(letters + "+/", int(r.integers(24, 60))) + "=" * int(r.integers(0, 3)),
        lambda: some(letters + "_-", int(r.integers(20, 44))),
        lambda: "eyJ" + some(letters + "_-", int(r.integers(30, 60))),
        lambda: some(string.hexdigits.upper(), int(r.integers(24, 41))),
    ]
    return [shapes[i % len(shapes)]() for i in range(n)]


def _made_plain(r: np.random.Generator, words: list[str], n: int) -> list[str]:
    """Harmless runs with digits: dates, names with numbers, paths, phone and part numbers."""
    word = lambda: words[int(r.integers(len(words)))]
    digit = lambda k: "".join(map(str, r.integers(0, 10, k)))
    shapes = [
        lambda: f"20{digit(2)}-{digit(2)}-{digit(2)}-{word()}",
        lambda: f"{word()}_{word()}_{word()}_{digit(2)}",
        lambda: f"{word()}/{word()}/{word()}/{word()}{digit(1)}",
        lambda: f"{digit(3)}-{digit(4)}-{digit(4)}-ext-{digit(2)}",
        lambda: f"{word()}-{digit(3)}-{word()}-{word()}-{digit(1)}",
        lambda: f"{word()}{word()}{word()}{digit(4)}",
    ]
    made = [shapes[i % len(shapes)]() for i in range(n)]
    return [x if len(x) >= 16 else x + "-" + word() + "-" + word() for x in made]


def _made_parts(r: np.random.Generator, words: list[str], n: int) -> list[tuple[str, str, str, tuple[int, int]]]:
    """Left side, run, right side and the secret's place in the run (empty: none).

    Keys and harmless names in the middle of paths, and what base spans leave of keys and
    of paths.
    """
    letters = string.ascii_letters + string.digits
    some = lambda chars, k: "".join(r.choice(list(chars), k))
    size = lambda a, b: int(r.integers(a, b))
    word = lambda: words[size(0, len(words))]
    path = lambda k: "".join(f"{word()}{'/-_'[size(0, 3)]}" for _ in range(k))
    made = []
    for i in range(n):
        value = some("0123456789abcdef", size(24, 41))
        key = some(letters, size(24, 41)) if i % 2 else path(2) + str(size(0, 3000))
        rest = some(letters, size(3, 20)) if i % 2 else f"/{path(size(1, 3))}{size(0, 300)}"
        secret = i % 2 == 1
        if i % 3 == 0:
            head = "/" + path(size(1, 6))
            made.append(("", f"{head}{key}/{path(size(1, 5))}{size(0, 10)}", "", (len(head), len(head) + len(key)) if secret else (0, 0)))
        elif i % 3 == 1:
            made.append((value, rest, "", (0, len(rest)) if secret else (0, 0)))
        else:
            rest = rest if secret else rest[1:] + "/"
            made.append(("", rest, value, (0, len(rest)) if secret else (0, 0)))
    return made


def is_candidate(run: str) -> bool:
    """Whether a run has the form that ``candidates`` looks for."""
    return bool(CANDIDATE.fullmatch(run) and re.search(r"\d", run) and re.search(r"[A-Za-z]", run))


def is_plain(run: str) -> bool:
    """Whether a run is made of words of one case, or capitalised, and short numbers only."""
    parts = re.split(r"[+/_=-]+", run)
    return all(re.fullmatch(r"(?:[A-Z]?[a-z]{0,14}|[A-Z]{1,6}|)\d{0,4}", x) for x in parts)


def labelled_runs(text: str) -> list[tuple[int, int, bool]]:
    """Spans of secrets (True) and harmless runs (False) that the base rules can tell.

    Secrets are base spans and their values as ``CANDIDATE`` cuts them; harmless are long
    runs of letters, and candidates of words and short numbers.
    """
    spans = base_spans(text)
    runs = {(a, b, True) for a, b, _ in spans}
    for a, b, kind in spans:
        at = a + ASSIGN.fullmatch(text[a:b]).start(2) if kind == "assign" else a
        runs |= {(at + m.start(), at + m.end(), True) for m in CANDIDATE.finditer(text[at:b]) if is_candidate(m[0])}
    free = lambda m: all(m.end() <= a or m.start() >= b for a, b, _ in spans)
    runs |= {(*m.span(), False) for m in re.finditer(r"[A-Za-z]{8,}", text) if free(m)}
    runs |= {(*m.span(), False) for m in CANDIDATE.finditer(text) if is_candidate(m[0]) and is_plain(m[0]) and free(m)}
    return sorted(runs)


def _sample(docs: DataFrame, p: ScanParams) -> DataFrame:
    """Labelled findings of the sampled texts: left context, run, right context, label."""
    ids = (
        docs.select(F.col("doc_id").alias("_pick")).where("_pick IS NOT NULL").distinct()
        .orderBy(F.xxhash64("_pick"), "_pick").limit(p.documents)
    )
    texts = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_pick"))  # at most ``documents`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                rows += [(text[max(0, a - p.around) : a], text[a:b], text[b : b + p.around], y) for a, b, y in labelled_runs(text)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.bool_()], strict=True)], names=["l", "run", "r", "y"])

    return texts.select(whole_text("text")).mapInArrow(run, "l string, run string, r string, y boolean")


def train(docs: DataFrame, p: ScanParams = ScanParams()) -> CharNet:
    """Fit the network on findings of a bounded sample, with made ones beside them.

    Contexts come from the sampled texts; made keys and made harmless runs are set into
    them. A fifth of the runs is held out: for calibration all of them, for the threshold
    those of the form that ``candidates`` finds. Without any text the contexts are empty.
    """
    formed = F.length("run") >= 16
    formed &= F.col("run").rlike(r"^[A-Za-z0-9+/_=-]+\z") & F.col("run").rlike("[0-9]") & F.col("run").rlike("[A-Za-z]")
    order = [F.xxhash64("l", "run", "r"), "l", "run", "r"]
    found = _sample(docs, p).distinct()
    # those of the candidates' form first, so that letters don't crowd them out
    rows = [
        r for y in (True, False)
        for r in found.where(F.col("y") == y).orderBy(~formed, *order).limit(p.examples).collect()
    ]
    rng = np.random.default_rng(p.seed)
    plain = [r for r in rows if not r["y"]]
    sides = [(r["l"], r["r"]) for r in plain] or [("", "")]
    words = sorted({r["run"].lower()[:12] for r in plain}) or ["alpha", "report", "summary"]
    made = [(x, 1.0) for x in _made_secrets(rng, p.examples // 2)]
    made += [(x, 0.0) for x in _made_plain(rng, words, p.examples // 2)]
    data = [(r["l"], r["run"], r["r"], (0, len(r["run"]) * r["y"])) for r in rows]
    for x, y in made:
        l, r = sides[int(rng.integers(len(sides)))]
        data.append((l, x, r, (0, len(x) * int(y))))
    for before, x, after, place in _made_parts(rng, words, p.examples // 2):
        l, r = sides[int(rng.integers(len(sides)))]
        data.append(((l + before)[-p.around :], x, (after + r)[: p.around], place))
    # by the run, so that copies of a key are all on one side
    held = [zlib.crc32(run.encode()) % 5 == 0 for _, run, _, _ in data]
    net = CharNet(p)
    net.train(*_seen([d for d, h in zip(data, held, strict=True) if not h], p))
    net.calibrate(*_seen([d for d, h in zip(data, held, strict=True) if h], p))
    own = [(l + run + r, len(l), len(l) + len(run), b > a) for (l, run, r, (a, b)), h in zip(data, held, strict=True) if h and is_candidate(run)]
    net.constrain([d[:3] for d in own if d[3]], [d[:3] for d in own if not d[3]])
    return net


def _seen(data: list[tuple[str, str, str, tuple[int, int]]], p: ScanParams) -> tuple[np.ndarray, np.ndarray]:
    """Views of labelled runs; one that shows a small part of a secret only has no label."""
    x, y = [], []
    for l, run, r, (a, b) in data:
        for v, w in views(0, len(run), p):
            shown = min(b, w) - max(a, v)
            if shown <= 0 or shown >= min(16, b - a):
                x.append(window(l + run + r, len(l) + v, len(l) + w, p))
                y.append(float(shown > 0))
    return np.stack(x), np.array(y)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<string>, spans array<string>, starts array<int>, ends array<int>"


def find_secrets(docs: DataFrame, net: CharNet | None = None, params: ScanParams = ScanParams()) -> DataFrame:
    """Spans of secrets for every row of ``docs`` (doc_id, text, others).

    Returns doc_id, the numbers of base spans per kind, base and spans (``kind:start:end``
    in code points, by start, then kind), and their starts and ends. Base spans always
    stay; the network adds candidates whose calibrated chance reaches its threshold in any
    of the views that cover them. Null
    texts are empty, null doc_ids and repeated rows are scanned like any other, an empty
    table gives no rows.
    """
    net = net or train(docs, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                bases = [base_spans(t) for t in texts]
                more = [candidates(t, b) for t, b in zip(texts, bases, strict=True)]
                chance = iter(net.best([(t, a, b) for t, own in zip(texts, more, strict=True) for a, b in own]))
                whole = []
                for base, own in zip(bases, more, strict=True):
                    extra = [(a, b, "network") for a, b in own if next(chance) >= net.threshold]
                    whole.append(sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]))))
                name = lambda spans: [f"{k}:{a}:{b}" for a, b, k in spans]
                count = lambda kind: pa.array([sum(s[2] == kind for s in b) for b in bases], pa.int64())  # noqa: E731, B023
                strings, ints = pa.list_(pa.string()), pa.list_(pa.int32())
                yield pa.record_batch(
                    [part.column(0), count("assign"), count("access"), count("hex"),
                     pa.array([name(b) for b in bases], strings), pa.array([name(w) for w in whole], strings),
                     pa.array([[s[0] for s in w] for w in whole], ints), pa.array([[s[1] for s in w] for w in whole], ints)],
                    names=[c.split()[0] for c in FOUND.split(", ")],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return own.mapInArrow(run, FOUND)


def redact(docs: DataFrame, net: CharNet | None = None, mask: str = "[SECRET]", params: ScanParams = ScanParams()) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; n_chars follows the text.

    Overlapping spans become one mask. Texts without a secret, and null texts, stay as
    they are, as do all other columns.
    """
    net = net or train(docs, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                spans = [(a, b) for a, b, _ in base]
                if own := candidates(text, base):
                    chance = net.best([(text, a, b) for a, b in own])
                    spans += [s for s, c in zip(own, chance, strict=True) if c >= net.threshold]
                out, done = [], 0
                for a, b in sorted(spans):
                    if a >= done:
                        out += [text[done:a], mask]
                    done = max(done, b)
                if out:
                    texts[i] = "".join(out) + text[done:]
            at = batch.schema.get_field_index("text")
            new = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    changed = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return changed.select(*docs.columns)
