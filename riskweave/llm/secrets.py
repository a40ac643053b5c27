"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Findings are what the patterns match, and further candidates: long runs of
characters that secrets are made of, with a letter and a digit in them.  The
network reads a candidate, or the value of an assignment, and the text around
it.  It learns from all findings, labelled by the patterns, each as it is and
with the words that gave a pattern away hidden: findings are dealt into parts,
tasks pass over their parts, and the networks they come to are averaged after
every pass.  Its scores are calibrated on findings whose values it has not
seen, and the threshold is the highest that still recalls the wanted share of
those, however low it is.  Candidates that reach it are added to the findings.
"""

import random
import re
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import map_column, map_rows, rows_at_once
from riskweave.operators.runtime import free_name, release, row_salt, stored

# The patterns, and the least length of the value of an assignment.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_LEAST = 6
# Both match runs, so a match that is too short holds no longer one: the least length is in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")

# What the network sees: characters before, of, and behind a candidate, in windows of a fixed width.
BEFORE, INSIDE, BEHIND = 24, 48, 8
WIDTH = BEFORE + INSIDE + BEHIND
CODES, EMBED, SPAN, FILTERS = 97, 8, 5, 16
# Findings of a part, about, and passes over all parts; the share of findings that is kept for calibration.
PART_FINDINGS = 4000
EPOCHS = 6
CALIBRATE = 0.3
# Candidates that stand around made-up secrets in parts without candidates.
SPARE = 64
# Bits of an example.
SECRET, MADE, HELD = 1, 2, 4
EXAMPLES = "part long, learnt0 long, learnt1 long, held0 long, held1 long, codes binary, bits binary"
# Made-up secrets for each finding, their alphabets and their least length.
VARIANTS = 2
_FIGURES, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    _FIGURES + "abcdef",
    _FIGURES + "ABCDEF",
    _FIGURES + _UPPER,
    _FIGURES + _LOWER,
    _FIGURES + _LOWER + _UPPER,
    _FIGURES + _LOWER + _UPPER + "+/",
    _FIGURES + _LOWER + _UPPER + "_-",
)
SHORTEST = 16
RECALL = 0.98
FINDINGS = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, windows array<string>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns match, in code points, leftmost and without overlaps per kind."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that no match of a pattern touches."""
    taken: list[list[int]] = []
    for start, _, end in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    found, at = [], 0
    for m in CANDIDATE.finditer(text):
        if not _DIGIT.search(m[0]) or not _LETTER.search(m[0]):
            continue
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or taken[at][0] >= m.end():
            found.append((m.start(), 3, m.end()))
    return found


def value_start(text: str, start: int, kind: int) -> int:
    """Where the value of a finding begins: behind the key word of an assignment, else at the start."""
    return ASSIGN.match(text, start).start(2) if kind == 0 else start


def windows(text: str, start: int, end: int) -> list[str]:
    """What the network sees of a candidate or of the value of a match: parts that overlap by half, with the text around each."""
    found = []
    for at in range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2):
        stop = min(end, at + INSIDE)
        before = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0")
        behind = text[stop : stop + BEHIND].ljust(BEHIND, "\0")
        found.append(before + text[at:stop].ljust(INSIDE, "\0") + behind)
    return found


def findings(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): kinds, places and windows of findings and candidates.

    Texts are scanned whole; null and empty ones have no findings.  Null ids
    and repeated rows keep their rows, further columns are ignored.
    """

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc_id, text in batch:
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + candidate_spans(text, base))
                seen = ["\1".join(windows(text, value_start(text, s, k), e)) for s, k, e in spans]
                rows.append((doc_id, [k for _, k, _ in spans], [s for s, _, _ in spans], [e for *_, e in spans], seen))
            yield rows

    return map_rows(documents.select("doc_id", "text"), run, FINDINGS)


def encoded(window: str) -> np.ndarray:
    codes = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) - 31
    return np.where((codes < 1) | (codes >= CODES), 0, codes)


class Network:
    """Embedding, one convolution, the maximum over all places and the mean inside the candidate, one output."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.parameters = [
            r.normal(0, 0.3, (CODES, EMBED)),
            r.normal(0, 0.2, (SPAN * EMBED, FILTERS)),
            np.zeros(FILTERS),
            r.normal(0, 0.3, 2 * FILTERS),
            np.zeros(1),
        ]
        self.first = [np.zeros_like(p) for p in self.parameters]
        self.second = [np.zeros_like(p) for p in self.parameters]
        self.step = 0
        inside = np.zeros(WIDTH - SPAN + 1)
        inside[BEFORE : BEFORE + INSIDE - SPAN + 1] = 1
        self.inside = (inside / inside.sum())[None, :, None]

    def forward(self, codes: np.ndarray):
        embedding, kernel, bias, out, shift = self.parameters
        rows = embedding[codes]
        view = np.lib.stride_tricks.sliding_window_view(rows, SPAN, axis=1).transpose(0, 1, 3, 2)
        view = view.reshape(len(codes), WIDTH - SPAN + 1, SPAN * EMBED)
        hidden = np.maximum(view @ kernel + bias, 0)
        pooled = np.concatenate([hidden.max(axis=1), (hidden * self.inside).sum(axis=1)], axis=1)
        return pooled @ out + shift[0], (view, hidden, pooled)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[at : at + 256])[0] for at in range(0, len(codes), 256)])

    def gradients(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        embedding, kernel, _, out, _ = self.parameters
        logits, (view, hidden, pooled) = self.forward(codes)
        slope = (1 / (1 + np.exp(-logits)) - labels) * weights
        back = slope[:, None] * out
        down = np.broadcast_to(back[:, None, FILTERS:] * self.inside, hidden.shape).copy()
        peak = hidden.argmax(axis=1)
        rows, columns = np.indices(peak.shape)
        down[rows, peak, columns] += back[:, :FILTERS]
        down *= hidden > 0
        at_view = (down @ kernel.T).reshape(len(codes), WIDTH - SPAN + 1, SPAN, EMBED)
        at_embedding = np.zeros_like(embedding)
        for k in range(SPAN):
            np.add.at(at_embedding, codes[:, k : k + WIDTH - SPAN + 1], at_view[:, :, k])
        return [
            at_embedding,
            np.tensordot(view, down, axes=([0, 1], [0, 1])),
            down.sum(axis=(0, 1)),
            pooled.T @ slope,
            np.array([slope.sum()]),
        ]

    def train(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, number: int, batch: int = 64, rate: float = 0.01) -> None:
        """One pass of Adam over shuffled batches, the one of this number."""
        r = np.random.default_rng(2)
        for _ in range(number + 1):
            order = r.permutation(len(codes))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            self.step += 1
            for k, g in enumerate(self.gradients(codes[part], labels[part], weights[part] / len(part))):
                self.first[k] += 0.1 * (g - self.first[k])
                self.second[k] += 0.001 * (g * g - self.second[k])
                scale = np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8
                self.parameters[k] -= rate * (self.first[k] / (1 - 0.9**self.step)) / scale

    def packed(self) -> np.ndarray:
        """Parameters and both moments of Adam, in one line."""
        return np.concatenate([x.ravel() for x in self.parameters + self.first + self.second])

    def unpack(self, line: np.ndarray, step: int) -> None:
        at = 0
        for group in (self.parameters, self.first, self.second):
            for k, x in enumerate(group):
                group[k] = line[at : at + x.size].reshape(x.shape).copy()
                at += x.size
        self.step = step


@dataclass(frozen=True)
class Model:
    """The network, the two numbers that calibrate its output, and the threshold; None adds nothing."""

    network: Network | None
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.network.logits(codes) + self.shift)))


def hidden_context(window: str) -> str:
    """The window without what stands before the candidate."""
    return "\0" * BEFORE + window[BEFORE:]


def varied(window: str, surroundings: list[str], count: int = VARIANTS) -> list[str]:
    """Windows of made-up secrets in place of the one in ``window``: other alphabets, lengths and quotes, other text around.

    The surroundings are windows of candidates that no pattern matches.  What
    is made depends on the characters inside the window alone, so copies give
    the same variants.
    """
    r = random.Random(crc32(window[BEFORE : BEFORE + INSIDE].encode("utf-8", "surrogatepass")))
    found = []
    while len(found) < count:
        value = "".join(r.choices(r.choice(ALPHABETS), k=r.randint(SHORTEST, 2 * INSIDE)))
        if not _DIGIT.search(value) or not _LETTER.search(value):
            continue
        around, quote = r.choice(surroundings), r.choice(("", '"', "'"))
        before = "\0" * BEFORE if r.random() < 0.5 else around[:BEFORE]
        behind = value[INSIDE:] + quote + around[-BEHIND:]
        found.append((before + quote)[-BEFORE:] + value[:INSIDE].ljust(INSIDE, "\0") + behind[:BEHIND])
    return found


def fit(found: DataFrame, part_findings: int = PART_FINDINGS, recall: float = RECALL) -> Model:
    """Model from all stored :func:`findings`.

    A finding is labelled a secret if a pattern
    has matched it, and teaches also some made-up values of other forms, see
    :func:`varied`.  All copies of a value, with and without their context, and
    what is made of them are learnt from or all kept for calibration.  With fewer than ten findings of either label no candidate
    is added.  Parts hold about ``part_findings`` findings; the driver sees
    networks, one per task, and sums.
    """
    spark = found.sparkSession
    one = found.select("doc_id", F.explode(F.arrays_zip("kinds", "starts", "windows")).alias("one"))
    one = one.select("doc_id", "one.*").withColumn("secret", F.col("kinds") != 3)
    sizes = {r.secret: r.n for r in one.groupBy("secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sizes.get(secret, 0) for secret in (True, False)) < 10:
        return Model(None)
    with rows_at_once(spark, 4):
        examples = _examples(one, ceil(sum(sizes.values()) / part_findings))
        sums = examples.agg(*[F.sum(c).alias(c) for c in ("learnt0", "learnt1", "held0", "held1")]).first()
        if min(sums) == 0:
            return Model(None)
        network = _trained(examples, sums.learnt1 / (sums.learnt0 + sums.learnt1))
        held = _held_logits(examples, network)
    release(examples)
    scale, shift = calibrated(held, sums.held0, sums.held1)
    threshold = 1.0
    # Found and made-up secrets are recalled each for themselves.
    for r in held.filter("secret = 1").groupBy("made").agg(F.count(F.lit(1)).alias("n")).collect():
        at = int((1 - recall) * r.n)
        # Exact, and between two places; the highest logit is the lowest probability under a scale below zero.
        place = (at + 0.5) / r.n if scale >= 0 else (r.n - at - 0.5) / r.n
        kept = held.filter((F.col("secret") == 1) & (F.col("made") == r.made))
        logit = kept.agg(F.expr(f"percentile_disc({place!r}D) WITHIN GROUP (ORDER BY logit)").alias("z")).first().z
        threshold = min(threshold, float(1 / (1 + np.exp(-(scale * logit + shift)))))
    release(held)
    return Model(network, scale, shift, threshold)


def _examples(one: DataFrame, parts: int) -> DataFrame:
    """Stored :data:`EXAMPLES` of single findings, a row for each part: what the network learns from or is calibrated on."""
    order = [F.xxhash64("doc_id", "starts", "windows"), *map(F.col, ("doc_id", "starts", "windows"))]
    spare: list[str] = []
    if parts > 1:
        some = one.filter(~F.col("secret")).orderBy(*order).limit(SPARE).collect()
        spare = [r.windows.split("\1")[0] for r in some]
    entry = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)])
    lists = {name: F.sort_array(F.collect_list(F.when(F.col("secret") == is_secret, entry))) for name, is_secret in (("secrets", True), ("others", False))}
    dealt = one.select("*", F.pmod(row_salt("doc_id", "starts", "windows"), F.lit(parts)).cast("long").alias("part"))
    gathered = dealt.groupBy("part").agg(*[c.alias(name) for name, c in lists.items()]).select("part", F.col("secrets.c3").alias("secrets"), F.col("others.c3").alias("others"))

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            for row in batch:
                yield [_part_row(*row, spare)]

    return stored(map_rows(gathered.repartitionByRange(parts, "part"), run, EXAMPLES))


def _part_row(part: int, secrets: list[str], others: list[str], spare: list[str]) -> tuple:
    secrets, others = ([w.split("\1")[0] for w in windows] for windows in (secrets, others))
    codes, bits = [], []
    for secret, rows in ((SECRET, secrets), (0, others)):
        for window in rows:
            held = HELD if drawn(window) < CALIBRATE else 0
            copies = [window, hidden_context(window)] + (varied(window, others or spare) if secret else [])
            codes += [encoded(w).astype(np.uint8) for w in copies]
            bits += [secret | held | (MADE if at > 1 else 0) for at in range(len(copies))]
    bits = np.array(bits, dtype=np.uint8)
    counts = [int((bits & (SECRET | HELD) == kind).sum()) for kind in (0, SECRET, HELD, SECRET | HELD)]
    return (part, *counts, b"".join(c.tobytes() for c in codes), bits.tobytes())


def _unpacked(codes: bytes, bits: bytes, held: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes and bits of those examples of a part that are held for calibration, or are not."""
    bits = np.frombuffer(bits, dtype=np.uint8)
    wanted = (bits & HELD > 0) == held
    return np.frombuffer(codes, dtype=np.uint8).reshape(-1, WIDTH)[wanted].astype(np.int64), bits[wanted]


def _trained(examples: DataFrame, share: float) -> Network:
    """The network after all passes; both labels weigh the same in all."""
    context, network = examples.sparkSession.sparkContext, Network()
    for number in range(EPOCHS):
        start = context.broadcast(network)

        def run(batches: Iterator[list[tuple]], start=start, number=number) -> Iterator[list[tuple]]:
            part, total, n, step = None, 0.0, 0, 0
            for batch in batches:
                for name, codes, bits in batch:
                    codes, bits = _unpacked(codes, bits, False)
                    if len(codes):
                        own, labels = deepcopy(start.value), (bits & SECRET).astype(float)
                        own.train(codes, labels, np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)), number)
                        part = name if part is None else min(part, name)
                        total, n, step = total + len(codes) * own.packed(), n + len(codes), max(step, own.step)
            if n:
                yield [(part, n, step, total.tobytes())]

        rows = map_rows(examples.select("part", "codes", "bits"), run, "part long, n long, step long, total binary").collect()
        total = sum(np.frombuffer(r.total) for r in sorted(rows, key=lambda r: r.part))
        network.unpack(total / sum(r.n for r in rows), max(r.step for r in rows))
        start.unpersist()
    return network


def _held_logits(examples: DataFrame, network: Network) -> DataFrame:
    """Stored (secret, made, logit) of all examples that are held for calibration."""
    share = examples.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            for codes, bits in batch:
                codes, bits = _unpacked(codes, bits, True)
                if len(codes):
                    logits = share.value.logits(codes).tolist()
                    yield list(zip((bits & SECRET).tolist(), (bits & MADE > 0).tolist(), logits))

    return stored(map_rows(examples.select("codes", "bits"), run, "secret int, made boolean, logit double"))


def drawn(window: str) -> float:
    """A number in [0, 1) that is the same for all windows with the same characters inside, whatever stands around."""
    return crc32(window[BEFORE : BEFORE + INSIDE].encode("utf-8", "surrogatepass")) / 2**32


def calibrated(held: DataFrame, zeros: int, ones: int) -> tuple[float, float]:
    """Scale and shift that make the logits of ``held`` (secret, logit) probabilities, by Newton's method with a small ridge."""
    # Labels a little inside 0 and 1, so that separable findings have finite weights.
    y = F.when(F.col("secret") == 1, (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))
    z = F.col("logit")
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(w[0]) + float(w[1])))))
        rows = held.select(z.alias("z"), (y - p).alias("d"), (p * (1 - p)).alias("v"))
        r = rows.selectExpr("sum(v * z * z) AS a", "sum(v * z) AS b", "sum(v) AS c", "sum(d * z) AS d", "sum(d) AS e").first()
        curve = np.array([[r.a, r.b], [r.b, r.c]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(curve, np.array([r.d, r.e]) - 1e-3 * w), -1, 1)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def scan(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base, spans) of stored :func:`findings`.

    ``base`` and ``spans`` are ``kind:start:end`` by start and kind, joined by
    commas: what the patterns match, and that together with the candidates
    whose probability reaches the threshold.
    """
    share = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        own = share.value
        for batch in batches:
            yield [_row(own, *row) for row in batch]

    columns = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base string, spans string"
    return map_rows(found.select("doc_id", "kinds", "starts", "ends", "windows"), run, columns)


def _added(model: Model, kinds: list[int], seen: list[str]) -> list[bool]:
    """Whether each finding counts: matches do, candidates if a part of them reaches the threshold."""
    keep = [k != 3 for k in kinds]
    if model.network is None:
        return keep
    for at, (kind, parts) in enumerate(zip(kinds, seen)):
        if kind == 3:
            codes = np.stack([encoded(w) for w in parts.split("\1")])
            keep[at] = bool(model.probabilities(codes).max() >= model.threshold)
    return keep


def _row(model: Model, doc_id, kinds, starts, ends, seen) -> tuple:
    keep = _added(model, kinds, seen)
    spans = [(k, f"{KINDS[k]}:{s}:{e}") for k, s, e, kept in zip(kinds, starts, ends, keep) if kept]
    counts = [sum(k == n for k, _ in spans) for n in range(4)]
    base = ",".join(text for k, text in spans if k != 3)
    return (doc_id, *counts, base, ",".join(text for _, text in spans))


def redacted(text: str | None, model: Model, mark: str = "[SECRET]") -> str | None:
    """``text`` with every found span replaced by ``mark``; spans that overlap become one."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted(base + candidate_spans(text, base))
    if not spans:
        return text
    seen = ["\1".join(windows(text, value_start(text, s, k), e)) for s, k, e in spans]
    keep = _added(model, [k for _, k, _ in spans], seen)
    parts, at = [], 0
    for (start, _, end), kept in zip(spans, keep):
        if not kept:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with every found span replaced, and ``n_chars`` counted anew where the text has changed."""
    share = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        own = share.value
        return lambda texts: [redacted(text, own) for text in texts]

    length = free_name("_length", documents)
    before = documents.withColumn(length, F.char_length("text"))
    after = map_column(before, "text", start)
    changed = F.char_length("text") != F.col(length)
    counted = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return after.withColumn("n_chars", counted).drop(length)
