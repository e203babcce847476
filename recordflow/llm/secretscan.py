"""Secrets in texts: fixed rules, and a character convolutional network over candidates.

Every match of the rules and every long token with a digit or unusual mix is a
candidate.  The network sees all of a candidate's characters and those around it.
It is trained on labelled findings, rule matches against the other candidates, all of
them: the distinct windows are dealt to shares of bounded size, a share's task makes a pass over
its windows, and the mean of the shares' networks is what the next pass begins with.  Each finding is shown with the rules' key words
masked, and again with its secret replaced by a random one of another alphabet, length and
prefix, in its own surroundings or in those of some other candidate.  Other candidates are shown in their
own surroundings and in those of findings.  So what is learned is what sets random strings
apart from real text, and not the rules' few shapes.  Other candidates that a first network takes for
secrets are left out of the second one's training: they may be secrets that the rules miss.
A quarter of all windows was held out; it calibrates the probability, in shapes that training never
shows, and sets the threshold, the highest one that keeps the wanted recall; another quarter measures
recall and precision.  For both the logits of all shares are counted, value by value.  Rule matches always stay; the network adds other candidates that reach the threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import SPAN, cut, drop, summed, tidy

KINDS = ("assign", "access", "hex", "other")
_ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.@-]{16,}")

#: Distinct windows of the commoner label in a share, about; the shares hold all windows.
SHARE = 2000
#: Characters of a candidate that a row of the network holds (longer ones take several rows), and of its surroundings on each side.
INSIDE, AROUND = 48, 16
WIDTH = INSIDE + 2 * AROUND
#: Recall on held-out findings that the threshold has to keep.
RECALL = 0.99
#: Steps of training at least, and passes over all windows.
STEPS, EPOCHS = 400, 8
#: Random secrets and names that a lesson shows at least of each sort.
INVENTED = 500
#: Other candidates whose logit in the first network is not below this may be secrets.
DOUBT = -2.0
#: Logits are multiples of 1 / TICKS from -LIMIT to LIMIT, so that counts of the BINS values say all about them.
TICKS, LIMIT = 256, 32
BINS = 2 * LIMIT * TICKS + 1
#: Shares send weights as whole multiples of 1 / UNITS: their sum is the same in any order.
UNITS = 1 << 30
_KEYWORD = re.compile("password|passwd|secret|token|api_?key|AKIA", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, by start and then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def other_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Long tokens that hold a digit, or both cases, and touch no rule match."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if (any("0" <= c <= "9" for c in token) or token != token.lower() and token[1:] != token[1:].lower()) and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), 3, m.end()))
    return out


def window(text: str, start: int, end: int) -> str:
    """The characters the network sees: before, the whole candidate, after; blanks where there are none."""
    return text[max(0, start - AROUND) : start].rjust(AROUND, "\0") + text[start:end] + text[end : end + AROUND].ljust(AROUND, "\0")


def masked(shown: str) -> str:
    """A window without the rules' key words."""
    return _KEYWORD.sub(lambda m: "\0" * len(m[0]), shown)


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of the random secrets that training shows, and of those that set the threshold.
SHAPES = (_LOWER + _LOWER.upper() + _DIGITS, _LOWER.upper() + _DIGITS, _LOWER + _LOWER.upper() + _DIGITS + "+/", _LOWER + _DIGITS + _DIGITS)
HELD_SHAPES = (_LOWER + _LOWER.upper() + _DIGITS + "-_", _LOWER.upper() + "234567", _LOWER + _LOWER.upper() + _DIGITS)


def invented(n: int, shapes: tuple[str, ...], rng: np.random.Generator) -> list[str]:
    """Random secrets of 20 to 64 characters with a digit, half of them behind a short prefix."""
    out = []
    for k in range(n):
        letters = shapes[k % len(shapes)]
        body = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(20, 61)))
        body = body[:-1] + _DIGITS[2 + rng.integers(0, 6)]
        prefix = "".join(_LOWER[i] for i in rng.integers(0, 26, rng.integers(1, 4))) + "_-."[rng.integers(0, 3)]
        out.append((prefix if rng.random() < 0.5 else "") + body)
    return out


def shown_as(secrets: list[str], around: list[str]) -> list[str]:
    """Each secret in the surroundings of a window."""
    return [w[:AROUND] + s + w[len(w) - AROUND :] for s, w in zip(secrets, around, strict=True)]


def named(n: int, windows: list[str], rng: np.random.Generator) -> list[str]:
    """Long tokens made of the words around candidates, as names, paths and addresses are, and long numbers."""
    words = sorted({x for w in windows for side in (w[:AROUND], w[len(w) - AROUND :]) for x in re.findall(r"[^\W\d_]{3,}", side)}) or ["name"]
    out = []
    for k in range(n):
        some = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 6))]
        style = k % 6
        text = "".join(x.capitalize() for x in some) if style == 0 else ("".join(some).upper() if rng.random() < 0.5 else "_".join(some).upper()) if style == 1 else "_-./"[rng.integers(0, 4)].join(some).lower() if style < 4 else some[0].lower() + "." + some[1].lower() + "@" + some[-1].lower() + ".com"
        number = "".join(_DIGITS[i] for i in rng.integers(0, 10, rng.integers(1, 7)))
        if style == 5:
            text = "-"[: rng.integers(0, 2)].join("".join(_DIGITS[i] for i in rng.integers(0, 10, rng.integers(3, 7))) for _ in range(rng.integers(4, 7)))
        out.append(text + ("" if style == 0 and rng.random() < 0.5 else number if rng.random() < 0.7 else ""))
    return out


def _other_head(windows: list[str], rng: np.random.Generator) -> list[str]:
    """Windows whose candidates begin with other letters and digits of the same kind, so that a common prefix tells nothing."""

    def other(c: str) -> str:
        kind = next((k for k in (_LOWER, _LOWER.upper(), _DIGITS) if c in k), c)
        return kind[rng.integers(0, len(kind))]

    upto = [min(AROUND + 6, len(w) - AROUND) for w in windows]
    return [w[:AROUND] + "".join(map(other, w[AROUND:k])) + w[k:] for w, k in zip(windows, upto, strict=True)]


def lesson(found: list[str], others: list[str], shapes: tuple[str, ...], seed: int | tuple[int, ...], heads: bool = True) -> tuple[list[str], np.ndarray]:
    """Windows and labels: findings, masked and in other shapes; other candidates and names made of words, in their own and in the other side's surroundings.

    heads=False: other candidates lose their first characters.  Without windows of
    one label the other's surroundings serve for both.
    """
    rng = np.random.default_rng(seed)
    others = others if heads else _other_head(others, rng)
    found = list(map(masked, found))
    pick = lambda windows, n: [windows[i] for i in rng.integers(0, len(windows), n)]
    n = max(len(found), len(others), INVENTED)
    by_found, by_others = found or others, others or found
    yes = [*found, *shown_as(invented(n, shapes, rng), pick(by_found, n)), *shown_as(invented(n, shapes, rng), pick(by_others, n))]
    no = [*others, *shown_as([w[AROUND : len(w) - AROUND] for w in others], pick(by_found, len(others)))]
    no += [*shown_as(named(n, found + others, rng), pick(by_others, n)), *shown_as(named(n, found + others, rng), pick(by_found, n))]
    return yes + no, np.concatenate([np.ones(len(yes)), np.zeros(len(no))])


def _codes(windows: list[str], kernel: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of character codes, and each window's first row.

    0 for nothing, 1 to 95 for printable ASCII, 96 for the rest.  A candidate longer
    than INSIDE has several rows with the same surroundings, which overlap so that
    every run of kernel characters stands in one of them.
    """
    rows, starts = [], []
    for w in windows:
        starts.append(len(rows))
        inner = w[AROUND : len(w) - AROUND]
        for k in range(0, max(1, len(inner) - kernel + 1), INSIDE - kernel + 1):
            rows.append(w[:AROUND] + inner[k : k + INSIDE].ljust(INSIDE, "\0") + w[len(w) - AROUND :])
    raw = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), WIDTH)
    return np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw.astype(np.int64) - 31, 96)), np.array(starts, np.int64)


@dataclass
class Network:
    """Embedding, one convolution over characters, maximum over three zones, logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    #: Recall and precision on findings that neither training nor the threshold saw; None where there were none.
    recall: float | None = None
    precision: float | None = None
    #: Steps of training so far, and the running means of the gradients and of their squares.
    steps: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    WEIGHTS = ("embed", "conv", "bias", "out")
    KERNEL = 5
    FILTERS = 24
    DIM = 12

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (97, cls.DIM)), rng.normal(0, 0.15, (cls.KERNEL * cls.DIM, cls.FILTERS)), np.zeros(cls.FILTERS), np.zeros(3 * cls.FILTERS + 1))

    def zones(self) -> list[slice]:
        n = WIDTH - self.KERNEL + 1
        return [slice(0, AROUND), slice(AROUND, AROUND + INSIDE - self.KERNEL + 1), slice(AROUND + INSIDE - self.KERNEL + 1, n)]

    def forward(self, codes: np.ndarray):
        """Windows of the kernel, where each zone's maximum stands, and the maxima, for every row."""
        x = self.embed[codes]
        views = np.lib.stride_tricks.sliding_window_view(x, self.KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), WIDTH - self.KERNEL + 1, -1)
        act = np.maximum(views @ self.conv + self.bias, 0)
        where = [act[:, z].argmax(axis=1) + z.start for z in self.zones()]
        pooled = np.concatenate([np.take_along_axis(act, w[:, None, :], axis=1)[:, 0] for w in where], axis=1)
        return views, where, pooled

    def logits(self, windows: list[str]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        codes, starts = _codes(windows, self.KERNEL)
        pooled = np.concatenate([self.forward(codes[k : k + 512])[2] for k in range(0, len(codes), 512)])
        logit = np.maximum.reduceat(pooled, starts, axis=0) @ self.out[:-1] + self.out[-1]
        return np.clip(np.rint(logit * TICKS) / TICKS, -LIMIT, LIMIT)

    def state(self) -> np.ndarray:
        """The weights and the running means of training, one after the other."""
        own = {k: getattr(self, k) for k in self.WEIGHTS}
        return np.concatenate([of[k].ravel() if k in of else np.zeros(own[k].size) for of in (own, self.first, self.second) for k in self.WEIGHTS])

    def put(self, state: np.ndarray) -> None:
        """Sets what state() gives."""
        at = 0
        own = {k: getattr(self, k) for k in self.WEIGHTS}
        for of in (own, self.first, self.second):
            for k in self.WEIGHTS:
                of[k] = state[at : at + own[k].size].reshape(own[k].shape).copy()
                at += own[k].size
        for k in self.WEIGHTS:
            setattr(self, k, own[k])

    def train(self, windows: list[str], y: np.ndarray, batch: int = 64, rate: float = 3e-3, seed: int | tuple[int, ...] = 1, passes: int | None = None) -> None:
        """Adam on the logistic loss, both labels with the same weight; it goes on from earlier steps.

        passes=None: EPOCHS passes, or as many as STEPS steps take.
        """
        rng = np.random.default_rng(seed)
        names, first, second = self.WEIGHTS, self.first, self.second
        for k in names:
            first.setdefault(k, np.zeros_like(getattr(self, k)))
            second.setdefault(k, np.zeros_like(getattr(self, k)))
        weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(passes or max(EPOCHS, -(-STEPS // -(-len(y) // batch)))):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                at = order[s : s + batch]
                codes, starts = _codes([windows[k] for k in at], self.KERNEL)
                owner = np.repeat(np.arange(len(at)), np.diff(np.append(starts, len(codes))))
                views, where, pooled = self.forward(codes)
                best = np.maximum.reduceat(pooled, starts, axis=0)
                logit = best @ self.out[:-1] + self.out[-1]
                d = weight[at] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[at]) / len(at)
                grads = {"out": np.append(best.T @ d, d.sum())}
                holds = (pooled == best[owner]) & (pooled > 0)  # rows of a candidate that have its maximum share its gradient
                d_pool = (d[:, None] * self.out[None, :-1])[owner] * holds / np.maximum(1, np.add.reduceat(holds, starts, axis=0, dtype=np.int64))[owner]
                g_conv, g_bias, g_embed = np.zeros_like(self.conv), np.zeros_like(self.bias), np.zeros_like(self.embed)
                rows = np.arange(len(codes))[:, None]
                for z, w in enumerate(where):
                    dz = d_pool[:, z * self.FILTERS : (z + 1) * self.FILTERS]
                    seen = views[rows, w]  # rows x filters x (kernel * dim)
                    g_conv += np.einsum("bf,bfk->kf", dz, seen)
                    g_bias += dz.sum(axis=0)
                    back = (dz[:, :, None] * self.conv.T[None]).reshape(len(codes), self.FILTERS, self.KERNEL, self.DIM)
                    place = w[:, :, None] + np.arange(self.KERNEL)
                    code = codes[rows[:, :, None], place].ravel()
                    g_embed += np.stack([np.bincount(code, weights=back[..., k].ravel(), minlength=97) for k in range(self.DIM)], axis=1)
                grads |= {"conv": g_conv, "bias": g_bias, "embed": g_embed}
                self.steps += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    getattr(self, k)[...] -= rate * (first[k] / (1 - 0.9**self.steps)) / (np.sqrt(second[k] / (1 - 0.999**self.steps)) + 1e-8)

    def probability(self, windows: list[str]) -> np.ndarray:
        """Calibrated probability of each window's candidate."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(windows) + self.shift, -30, 30)))

    def counts(self, windows: list[str], y: np.ndarray) -> np.ndarray:
        """How many windows have each logit: label by value."""
        tick = np.rint((self.logits(windows) + LIMIT) * TICKS).astype(np.int64)
        return np.bincount((y > 0) * BINS + tick, minlength=2 * BINS).reshape(2, BINS)

    def _by_value(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits that occur, ascending, their probabilities, and how many windows of label 0 and of label 1 have them."""
        at = np.flatnonzero(counts.any(axis=0))
        logit = at / TICKS - LIMIT
        return logit, 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30))), counts[0, at], counts[1, at]

    def settle(self, counts: np.ndarray, recall: float) -> None:
        """Logistic scale and shift on counts of held-out logits, and the highest threshold with that recall."""
        total = counts.sum(axis=1)
        low, high = 1 / (total[0] + 2), (total[1] + 1) / (total[1] + 2)
        for _ in range(50):
            logit, p, no, yes = self._by_value(counts)
            w = np.maximum(p * (1 - p), 1e-6) * (no + yes)
            design = np.stack([logit, np.ones_like(logit)])
            delta = np.linalg.solve((design * w) @ design.T + 1e-3 * np.eye(2), design @ (no * (p - low) + yes * (p - high)))
            self.scale, self.shift = max(1e-3, self.scale - np.clip(delta[0], -1, 1)), self.shift - np.clip(delta[1], -1, 1)
        _, p, _, yes = self._by_value(counts)
        place = max(0, int((1 - recall) * (total[1] + 1) + 1e-9) - 1)  # holds on average for findings not seen yet
        self.threshold = float(p[np.searchsorted(np.cumsum(yes), place, side="right")])

    def judge(self, counts: np.ndarray) -> None:
        """Recall and precision at the threshold, from counts of logits."""
        _, p, no, yes = self._by_value(counts)
        taken = p >= self.threshold
        self.recall = float(yes[taken].sum() / yes.sum()) if yes.any() else None
        self.precision = float(yes[taken].sum() / (no + yes)[taken].sum()) if taken.any() else None

    def calibrate(self, windows: list[str], y: np.ndarray, recall: float) -> None:
        """settle() on held-out windows."""
        self.settle(self.counts(windows, y), recall)

    def measure(self, windows: list[str], y: np.ndarray) -> None:
        """judge() on held-out windows."""
        self.judge(self.counts(windows, y))


def candidate_table(docs: DataFrame) -> DataFrame:
    """doc_id, starts, kinds, ends, windows: every candidate of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in W.slices(whole)):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                rows.append((base + other_spans(text, base), text))
            spans = [s for s, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([[x[c] for x in s] for s in spans], pa.list_(pa.int64())) for c in range(3)), pa.array([[window(t, a, b) for a, _, b in s] for s, t in rows], pa.list_(pa.string()))],
                names=["doc_id", "starts", "kinds", "ends", "windows"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, starts array<bigint>, kinds array<bigint>, ends array<bigint>, windows array<string>")


def shares(each: DataFrame, total: dict[bool, int], sample: int) -> tuple[DataFrame, int]:
    """share, windows (h, w, y, part; by h): all distinct windows w and labels y, dealt by hash to shares of about ``sample`` of the commoner label, and the number of shares.

    part numbers a label's quarters.  Windows of a scarce label go to several shares, so that each has sample / 4 of it, or all.
    """
    groups = {y: -(-n // sample) for y, n in total.items()}
    count = max(groups.values())
    copies = {y: min(count, -(-count * max(1, sample // 4) // n)) for y, n in total.items()}
    of = lambda values: F.when(F.col("y"), F.lit(values[True])).otherwise(F.lit(values[False]))
    order = Window.partitionBy("y", F.expr("pmod(h, g)")).orderBy("h", "w")
    ranked = each.withColumn("h", F.pmod(F.xxhash64("w"), F.lit(SPAN))).withColumn("g", of(groups)).withColumn("part", (F.row_number().over(order) - 1) % 4)
    dealt = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), of(copies) - 1))).withColumn("share", F.pmod(F.col("h") + F.col("copy"), F.lit(count)).cast("int"))
    whole = dealt.groupBy("share").agg(F.sort_array(F.collect_list(F.struct("h", "w", "y", "part"))).alias("windows"))
    return whole.repartitionById(count, "share"), count  # a file each, so that the passes are dealt to all cores


def lessons(batches: Iterator[pa.RecordBatch], parts: tuple[int, ...], shapes: tuple[str, ...], seed: tuple[int, ...], first: Network | None, heads: bool) -> Iterator[tuple[tuple[int, ...], int, list[str], np.ndarray]]:
    """Of each share a seed, how many of its other candidates are shown, and the windows and labels of its lesson.

    Other candidates that the first network takes for secrets are not shown; with heads (held-out ones) they are if there are none else.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            rows = [r for r in batch.column("windows")[k].as_py() if r["part"] in parts]
            found, others = ([r["w"] for r in rows if r["y"] == y] for y in (True, False))
            plain = others if first is None else [w for w, x in zip(others, first.logits(others), strict=True) if x < DOUBT]
            if heads:
                plain = plain or others
            if found or plain:
                own = (*seed, batch.column("share")[k].as_py())
                yield own, len(plain), *lesson(found, plain, shapes, own, heads)


def _turn(net: Network, dealt: DataFrame, seed: tuple[int, ...], first: Network | None, passes: int | None) -> bool:
    """Training of net on each share; net becomes the mean of the shares' networks by the windows they were shown.  False: no other candidate was shown."""
    state, steps = net.state(), net.steps

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(len(state) + 3, np.int64)
        for own, shown, windows, y in lessons(batches, (0, 1), SHAPES, seed, first, heads=False):
            one = Network.new()
            one.put(state)
            one.steps = steps
            one.train(windows, y, seed=own, passes=passes)
            total[:-3] += np.rint(one.state() * len(y) * UNITS).astype(np.int64)
            total[-3:] += one.steps * len(y), len(y), shown
        return total

    total = summed(dealt, count, len(state) + 3)
    if total[-1]:
        net.put(total[:-3] / total[-2] / UNITS)
        net.steps = int(total[-3] // total[-2])
    return bool(total[-1])


def _taught(net: Network, dealt: DataFrame, count: int, seed: int, first: Network | None) -> bool:
    """Trains net on all shares, in passes after each of which the shares' networks meet; False if there was no other candidate to show."""
    if count == 1:
        return _turn(net, dealt, (seed, 0), first, None)
    turn = 0
    while turn < EPOCHS or net.steps < STEPS:
        if not _turn(net, dealt, (seed, turn), first, 1):
            return False
        turn += 1
    return True


def _held_out(net: Network, dealt: DataFrame, part: int, seed: int, first: Network) -> np.ndarray:
    """Counts of net's logits on the lessons of a held-out part of all shares."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, BINS), np.int64)
        for _, _, windows, y in lessons(batches, (part,), HELD_SHAPES, (seed,), first, heads=True):
            total += net.counts(windows, y)
        return total.ravel()

    return summed(dealt, count, 2 * BINS).reshape(2, BINS)


def train(candidates: DataFrame, sample: int = SHARE, recall: float = RECALL) -> Network:
    """The network for a candidate table; without findings of both labels, one that adds nothing.

    All distinct windows are used: half to train on, a quarter for calibration and threshold,
    a quarter to measure.  A task holds a share of about ``sample`` of each label at a time.
    """
    each = cut(candidates.select(F.explode(F.arrays_zip("kinds", "windows")).alias("c")).select((F.col("c.kinds") < 3).alias("y"), F.col("c.windows").alias("w")).distinct(), "windows")
    total = {r.y: r["count"] for r in each.groupBy("y").count().collect()}
    if min(total.get(y, 0) for y in (True, False)) < 4:
        drop(each)
        return Network.new()
    whole, count = shares(each, total, sample)
    dealt = cut(whole, "shares")
    drop(each)
    first, net = Network.new(), Network.new()
    _taught(first, dealt, count, 1, None)
    if _taught(net, dealt, count, 2, first):
        net.settle(_held_out(net, dealt, 2, 3, first), recall)
        net.judge(_held_out(net, dealt, 3, 4, first))
    else:
        net = Network.new()
    drop(dealt)
    return net


def spans_of(net: Network, spans: list[tuple[int, int, int]], windows: list[str]) -> list[tuple[int, int, int, float]]:
    """The spans that stay, with the network's probability: rule matches, and others from the threshold on."""
    p = net.probability(windows)
    return [(*s, float(v)) for s, v in zip(spans, p, strict=True) if s[1] < 3 or v >= net.threshold]


def scan(candidates: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, probabilities for every row of a candidate table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("starts", "kinds", "ends", "windows")]
            flat = net.probability([w for ws in lists[3] for w in ws])
            out, at = [], 0
            for starts, kinds, ends, windows in zip(*lists, strict=True):
                p = flat[at : at + len(windows)]
                at += len(windows)
                shown = [(s, k, f"{KINDS[k]}:{s}:{e}", v) for s, k, e, v in zip(starts, kinds, ends, p, strict=True)]
                base = ",".join(x[2] for x in sorted(shown) if x[1] < 3)
                kept = sorted(x for x in shown if x[1] < 3 or x[3] >= net.threshold)
                out.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(x[2] for x in kept), [float(x[3]) for x in kept]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "probabilities"])

    return candidates.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, probabilities array<double>")


@tidy
def secret_spans(docs: DataFrame) -> DataFrame:
    """Candidates of all rows, a network trained on them, and the spans of every row.

    A null text counts as empty.  Repeated rows give a row each; other columns
    are ignored; an empty table gives no rows.  Positions are code points.
    """
    candidates = cut(candidate_table(docs), "candidates")
    return scan(candidates, train(candidates))  # the table stays: the result reads it


@tidy
def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every found span of text replaced by mark; other columns (whatever their names), nulls, empty texts and repeated rows stay."""
    candidates = cut(candidate_table(docs.select(F.lit(0).alias("doc_id"), "text")).where(F.size("kinds") > 0), "candidates")
    net = train(candidates)
    drop(candidates)
    at = docs.columns.index("text")

    def clean(text: str | None, spans: list[tuple[int, int, int]], p: np.ndarray) -> str | None:
        out, upto = [], 0
        for (start, kind, end), v in zip(spans, p, strict=True):
            if kind == 3 and v < net.threshold or end <= upto:
                continue
            out += [text[upto:start], mark if start >= upto else ""]
            upto = end
        return "".join(out) + text[upto:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in W.slices(whole, "text")):
            texts = batch.column(at).to_pylist()
            found = []
            for t in texts:
                base = base_spans(t or "")
                found.append(sorted(base + other_spans(t or "", base)))
            p = net.probability([window(t, a, b) for t, f in zip(texts, found, strict=True) for a, _, b in f])
            cuts = np.cumsum([0] + [len(f) for f in found])
            new = [clean(t, f, p[a:b]) for t, f, a, b in zip(texts, found, cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array(new, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
