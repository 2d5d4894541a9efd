"""Personal data: base rules, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

The network is trained from labelled spans: what the base rules find in a bounded sample of texts,
and spans of further forms set into such texts. It reads overlapping windows; the tags of each
window are decoded jointly (Viterbi), every character takes its tag from the window in which it
stands most centrally, and runs of one kind are the spans of the whole text. By definition a span
holds a digit or an @. So the windows that hold one are run, and then, as long as a run of one kind
reaches the edge of what has been decoded, the windows beside it: the spans are those of all windows.
Base spans stay; a decoded span is added where it keeps the bounds of its kind and meets no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import byte_set, least_ids, row_of_batch, sigmoid, table, text_blocks

BASE_KINDS = ("email", "ip", "card", "phone")
#: `secret`: keys and tokens of letters and digits, which only the network finds.
KINDS = (*BASE_KINDS, "secret")
WIDTH, STRIDE = 96, 48
#: Sample texts that the network is trained on at most (the least xxhash64(doc_id) among those with a digit or @), and characters of such a text at most.
SAMPLE_DOCS, SAMPLE_CHARS = 800, 20_000
#: Windows that are decoded together; always so many, as a matrix product may round by the number of its rows.
TOGETHER = 128
CLASSES, EMBED, HIDDEN, TAGS = 32, 10, 14, len(KINDS) + 1
WINDOWS, EPOCHS, BATCH, RATE = 2000, 5, 48, 0.02
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can begin only at a digit run's first digit, and that run has to be taken whole, so possessive runs find the same in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = byte_set((0x30, 0x39), (0x40, 0x40))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part before an @ reaches back as far as its characters go, to the end of the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; matches that fail their kind's test are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return out


def plausible(kind: str, text: str) -> bool:
    """The bounds that a decoded span of a kind has to keep."""
    d = digits_of(text)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}", text))
    if kind == "ip":
        return len(p := re.split(r"[^0-9]+", text)) == 4 and all(x and len(x) <= 3 and int(x) <= 255 for x in p)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15 and bool(re.search(r"[^0-9]", text)) and not re.search(r"[^0-9\s().+/-]", text)
    return len(text) >= 16 and len(d) >= 4 and bool(re.fullmatch(r"[A-Za-z0-9_+/=-]+", text)) and bool(re.search(r"[A-Za-z]", text))


def _classes() -> np.ndarray:
    """Character classes of code points below 128: letters by case and hex, digits, and the signs that matter one by one."""
    table = np.full(128, 1, np.int64)
    table[48:58] = 2
    for chars, k in (("abcdef", 3), ("ghijklmnopqrstuvwxyz", 4), ("ABCDEF", 5), ("GHIJKLMNOPQRSTUVWXYZ", 6), (" \t", 7), ("\n\r", 8)):
        for c in chars:
            table[ord(c)] = k
    for k, c in enumerate("@.-_+%()/:,;=\"'|", 9):
        table[ord(c)] = k
    return table


ASCII_CLASS = _classes()
OTHER_CLASS = 28


def classes_of(text: str) -> np.ndarray:
    """One class by code point; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, ASCII_CLASS[np.minimum(points, 127)], OTHER_CLASS).astype(np.int8)


@dataclass
class Model:
    embed: np.ndarray
    cells: list[tuple[np.ndarray, np.ndarray]]  # forward, backward: (EMBED + HIDDEN, 4 HIDDEN), bias; gates i, f, o, g
    out: np.ndarray
    out_bias: np.ndarray
    moves: np.ndarray  # (TAGS, TAGS) from, to

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *(p for cell in self.cells for p in cell), self.out, self.out_bias, self.moves]


def fresh(rng: np.random.Generator) -> Model:
    def cell():
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1
        return rng.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN)), bias

    return Model(rng.normal(0, 0.5, (CLASSES, EMBED)), [cell(), cell()], rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)))


def _run(cell: tuple[np.ndarray, np.ndarray], x: np.ndarray, keep: bool = False):
    """x: (time, batch, EMBED) to outputs (time, batch, HIDDEN), with what the way back needs if keep."""
    w, bias = cell
    t, b, _ = x.shape
    into = (x.reshape(-1, x.shape[2]) @ w[:EMBED] + bias).reshape(t, b, -1)
    h = c = np.zeros((b, HIDDEN), x.dtype)
    out, kept = np.empty((t, b, HIDDEN), x.dtype), []
    for i in range(t):
        z = into[i] + h @ w[EMBED:]
        gate, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = gate[:, HIDDEN : 2 * HIDDEN] * before + gate[:, :HIDDEN] * g
        th = np.tanh(c)
        if keep:
            kept.append((h, before, gate, g, th))
        h = out[i] = gate[:, 2 * HIDDEN :] * th
    return out, kept


def emissions(model: Model, ids: np.ndarray) -> np.ndarray:
    """(batch, time) classes to (time, batch, TAGS)."""
    x = model.embed[ids.T]
    ahead, back = _run(model.cells[0], x)[0], _run(model.cells[1], x[::-1])[0][::-1]
    return ahead @ model.out[:HIDDEN] + back @ model.out[HIDDEN:] + model.out_bias


def viterbi(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tag sequences, (batch, time)."""
    t, b, k = emit.shape
    best, back = emit[0], np.empty((t, b, k), np.int8)
    for i in range(1, t):
        all_ways = best[:, :, None] + moves
        back[i] = all_ways.argmax(axis=1)
        best = all_ways.max(axis=1) + emit[i]
    tags = np.empty((t, b), np.int64)
    tags[-1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        tags[i - 1] = back[i][np.arange(b), tags[i]]
    return tags.T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def crf_gradients(emit: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the gold tags (time, batch) and its gradients, by the forward-backward algorithm."""
    t, b, k = emit.shape
    ahead, behind = np.empty_like(emit), np.zeros_like(emit)
    ahead[0] = emit[0]
    for i in range(1, t):
        ahead[i] = _lse(ahead[i - 1][:, :, None] + moves, 1) + emit[i]
    for i in range(t - 2, -1, -1):
        behind[i] = _lse(moves + (behind[i + 1] + emit[i + 1])[:, None, :], 2)
    z = _lse(ahead[-1], 1)
    d_emit = np.exp(ahead + behind - z[:, None])
    pairs = np.exp(ahead[:-1][:, :, :, None] + moves + (behind[1:] + emit[1:])[:, :, None, :] - z[:, None, None])
    d_moves = pairs.sum(axis=(0, 1))
    rows, cols = np.meshgrid(np.arange(t), np.arange(b), indexing="ij")
    d_emit[rows, cols, gold] -= 1
    np.subtract.at(d_moves, (gold[:-1], gold[1:]), 1)
    score = emit[rows, cols, gold].sum() + moves[gold[:-1], gold[1:]].sum()
    return float(z.sum() - score), d_emit, d_moves


def _back(cell, x, kept, d_out):
    """Gradients of one direction: weights, bias, inputs."""
    w, _ = cell
    d_w, d_bias, d_x = np.zeros_like(w), np.zeros(4 * HIDDEN), np.empty_like(x)
    d_h = d_c = np.zeros(d_out.shape[1:])
    for i in range(len(x) - 1, -1, -1):
        h, before, gate, g, th = kept[i]
        gi, gf, go = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        d_h = d_h + d_out[i]
        d_c = d_c + d_h * go * (1 - th * th)
        d_z = np.concatenate([d_c * g * gi * (1 - gi), d_c * before * gf * (1 - gf), d_h * th * go * (1 - go), d_c * gi * (1 - g * g)], axis=1)
        d_w += np.concatenate([x[i], h], axis=1).T @ d_z
        d_bias += d_z.sum(axis=0)
        d_in = d_z @ w.T
        d_x[i], d_h, d_c = d_in[:, :EMBED], d_in[:, EMBED:], d_c * gf
    return d_w, d_bias, d_x


def fit(ids: np.ndarray, gold: np.ndarray, seed: int = 3) -> Model:
    """ids, gold: (windows, WIDTH)."""
    rng = np.random.default_rng(seed)
    model = fresh(rng)
    first, second = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ids))
        for i in range(0, len(order), BATCH):
            own, tags = ids[order[i : i + BATCH]].T, gold[order[i : i + BATCH]].T
            x = model.embed[own]
            (ahead, kept_a), (back, kept_b) = _run(model.cells[0], x, True), _run(model.cells[1], x[::-1], True)
            both = np.concatenate([ahead, back[::-1]], axis=2)
            _, d_emit, d_moves = crf_gradients(both @ model.out + model.out_bias, model.moves, tags)
            n = own.shape[1]
            d_both = d_emit @ model.out.T
            wa, ba, xa = _back(model.cells[0], x, kept_a, d_both[:, :, :HIDDEN])
            wb, bb, xb = _back(model.cells[1], x[::-1], kept_b, d_both[::-1, :, HIDDEN:])
            d_embed = np.zeros_like(model.embed)
            np.add.at(d_embed, own, xa + xb[::-1])
            grads = [d_embed, wa, ba, wb, bb, both.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS), d_emit.sum(axis=(0, 1)), d_moves]
            step += 1
            rate = RATE / (1 + 0.5 * epoch)
            for p, g, m, v in zip(model.parameters(), grads, first, second, strict=True):
                g = np.clip(g / n, -5, 5)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(*(a.astype(np.float32) for a in [model.embed]), [tuple(p.astype(np.float32) for p in c) for c in model.cells], *(a.astype(np.float32) for a in (model.out, model.out_bias, model.moves)))


def _luhn_number(rng: np.random.Generator, n: int) -> str:
    body = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def further_form(rng: np.random.Generator) -> tuple[str | None, str]:
    """(kind, text) of a labelled span as the base rules would or would not find it; kind None: a number that is no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnoprstuv"), k))
    pick = int(rng.integers(0, 14))
    if pick == 0:
        return "email", f"{word(6)}.{n(2)}@{word(5)}{n(1)}.example.{rng.choice(['com', 'org', 'net'])}"
    if pick == 1:
        return "email", f"{word(4)}é{word(2)}@{word(6)}.example.{rng.choice(['com', 'de', 'fr'])}"
    if pick == 2:
        return "ip", ".".join(str(x) for x in rng.integers(0, 256, 4))
    if pick in (3, 4):
        return "card", re.sub(r"(.{4})(?=.)", r"\1" + str(rng.choice(["", " ", "-"])), _luhn_number(rng, 16))
    if pick == 5:
        return "phone", f"+{n(int(rng.integers(1, 3)))} ({n(3)}) {n(3)}-{n(4)}"
    if pick in (6, 7):
        return "phone", str(rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(2)} {n(4)} {n(4)}"]))
    if pick in (8, 9, 10):
        chars = [*"0123456789abcdef"] if pick < 10 else [*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
        text = "".join(rng.choice(chars, int(rng.integers(20, 41))))
        return "secret", text.upper() if pick == 9 else text
    return None, str(rng.choice([f"version {n(1)}.{n(1)}", n(4), f"{n(1)}.{n(2)}.", f"{n(2)}/{n(2)}/20{n(2)}", f"{n(3)},{n(3)}", f"CC BY-NC {n(1)}.0"]))


FILLER = "a note with no data of its own, set down in plain words and kept for the sake of what may follow it. "


def training_windows(texts: list[str], windows: int = WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Half the windows show base spans of the texts as they stand, half have further forms set in. One in four is moved so that a span is cut at its edge."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()] or [FILLER]
    found = [(t, base_spans(t)) for t in texts]
    places = [(i, s) for i, (_, spans) in enumerate(found) for s in spans]
    ids, gold = np.zeros((windows, WIDTH), np.int8), np.zeros((windows, WIDTH), np.int64)
    for w in range(windows):
        if w % 2 and places:
            i, (_, a, b) = places[int(rng.integers(len(places)))]
            text, spans = found[i]
        else:
            i = int(rng.integers(len(found)))
            text = found[i][0]
            kind, form = further_form(rng)
            at = int(rng.integers(0, len(text) + 1))
            near = text[max(0, at - WIDTH) : at], text[at : at + WIDTH]
            join = str(rng.choice([" ", " ", "\n", ": ", ' = "', ", "]))
            text = f"{near[0]}{join}{form}{rng.choice([' ', '. ', ', ', chr(10), chr(34), '!! '])}{near[1]}"
            a = len(near[0]) + len(join)
            b = a + len(form)
            spans = [s for s in base_spans(text) if s[2] <= a or s[1] >= b] + ([(kind, a, b)] if kind else [])
        start = max(0, int(rng.integers(a - WIDTH + 8, b - 7)) if w % 4 == 0 else int(rng.integers(min(b - WIDTH, a), a + 1)))
        own = classes_of(text[start : start + WIDTH])
        ids[w, : len(own)] = own
        for kind, s, e in spans:
            gold[w, max(0, s - start) : max(0, min(WIDTH, e - start))] = KINDS.index(kind) + 1
    return ids, gold


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The network, fitted on at most sample_docs texts of up to SAMPLE_CHARS characters, and further texts of the same doc_ids."""
    anchored = documents.filter(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    rows = anchored.join(F.broadcast(least_ids(anchored, "doc_id", sample_docs)), "doc_id").collect()
    return fit(*training_windows([r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]))


def windows_of(n: int, anchors: np.ndarray) -> np.ndarray:
    """Numbers of the windows of a text of n code points that hold an anchor; window k begins at k * STRIDE."""
    near = np.unique(anchors // STRIDE)
    return np.unique(np.clip(np.concatenate([near - 1, near]), 0, max(0, -(-(n - WIDTH) // STRIDE))))


def decoded(model: Model, windows: np.ndarray) -> np.ndarray:
    """Best tags of any number of windows, TOGETHER at a time."""
    out = np.zeros(windows.shape, np.int64)
    for k in range(0, len(windows), TOGETHER):
        part = windows[k : k + TOGETHER]
        ids = np.zeros((TOGETHER, WIDTH), np.int8)
        ids[: len(part)] = part
        out[k : k + TOGETHER] = viterbi(emissions(model, ids), model.moves)[: len(part)]
    return out


def tags_of(model: Model, coded: list[np.ndarray], everywhere: bool = False) -> list[np.ndarray]:
    """Tags of all code points of the texts' classes, each from the window in which it stands most centrally; 0 where no window was run.

    Windows without an anchor are run (everywhere: from the start) when a tag other than 0 stands at the edge of a window that was run beside them.
    """
    margin = (WIDTH - STRIDE) // 2
    last = [max(0, -(-(len(p) - WIDTH) // STRIDE)) for p in coded]
    tags = [np.zeros(len(p), np.int64) for p in coded]
    done: set[tuple[int, int]] = set()
    jobs = [(i, k) for i, p in enumerate(coded) for k in (range(last[i] + 1) if everywhere else windows_of(len(p), np.flatnonzero((p == 2) | (p == 9))).tolist())]
    while jobs:
        windows = np.zeros((len(jobs), WIDTH), np.int8)
        for r, (i, k) in enumerate(jobs):
            own = coded[i][k * STRIDE : k * STRIDE + WIDTH]
            windows[r, : len(own)] = own
        done.update(jobs)
        beside = []
        for (i, k), row in zip(jobs, decoded(model, windows), strict=True):
            s = k * STRIDE
            a, b = (0 if k == 0 else s + margin), (len(coded[i]) if k == last[i] else s + WIDTH - margin)
            tags[i][a:b] = row[a - s : b - s]
            if b > a:
                beside += [(i, k - 1)] * bool(k > 0 and tags[i][a]) + [(i, k + 1)] * bool(k < last[i] and tags[i][b - 1])
        jobs = sorted(set(beside) - done)
    return tags


def decode_spans(model: Model, texts: list[str], everywhere: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds in whole texts: windows of all texts are decoded together and reconciled by text."""
    tags = tags_of(model, [classes_of(t) for t in texts], everywhere)
    out = []
    for text, t in zip(texts, tags, strict=True):
        edges = np.flatnonzero(np.diff(t, prepend=0, append=0))
        spans = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if t[a] and (raw := text[a:b]).strip():
                kind, a, b = KINDS[t[a] - 1], a + len(raw) - len(raw.lstrip()), b - len(raw) + len(raw.rstrip())
                if plausible(kind, text[a:b]):
                    spans.append((kind, a, b))
        out.append(spans)
    return out


def all_spans(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those of more that meet none of them, by kind as listed, then start."""
    starts = sorted(b[1] for b in base)
    # the farthest end of the base spans up to each start
    ends = list(accumulate((b[2] for b in sorted(base, key=lambda b: b[1])), max))
    kept = [m for m in more if not (n := bisect_left(starts, m[2])) or ends[n - 1] <= m[1]]
    return sorted({*base, *kept}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(model: Model, data: np.ndarray, at: np.ndarray):
    """(texts, base spans, all spans) by row; texts without an anchor are empty here, as they hold no span."""
    held = np.concatenate([[0], np.cumsum(ANCHOR[data])])
    full = np.flatnonzero(held[at[1:]] > held[at[:-1]])
    texts = [data[at[i] : at[i + 1]].tobytes().decode() for i in full.tolist()]
    base = [base_spans(t) for t in texts]
    more = decode_spans(model, texts)
    n = len(at) - 1
    out_text, out_base, out_all = [""] * n, [[] for _ in range(n)], [[] for _ in range(n)]
    for i, t, b, m in zip(full.tolist(), texts, base, more, strict=True):
        out_text[i], out_base[i], out_all[i] = t, b, all_spans(b, m)
    return out_text, out_base, out_all


def find(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email .. n_phone and base_sha256 of the base spans, and spans (all, as kind:start:end in code points, end exclusive) of every row's whole text.

    Null and empty texts have no spans. Repeated rows each get their row; other columns are not read.
    """
    shared = spark.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            _, base, spans = _found(shared.value, data, at)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS]
            shas = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            yield pa.record_batch([row_of_batch(rows, "doc_id"), *counts, pa.array(shas), pa.array([written(s) for s in spans])], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; of spans that overlap, the whole stretch by the first's kind. Same columns and rows; n_chars counts anew where there is one; null texts stay null."""
    shared = spark.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            texts, _, spans = _found(shared.value, data, at)
            place = rows.schema.get_field_index("text")
            out = rows.column(place).to_pylist()
            for i, found in enumerate(spans):
                if not found:
                    continue
                merged: list[list] = []
                for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
                    if merged and a < merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], b)
                    else:
                        merged.append([kind, a, b])
                parts, done = [], 0
                for kind, a, b in merged:
                    parts += [texts[i][done:a], f"<{kind.upper()}>"]
                    done = b
                out[i] = "".join([*parts, texts[i][done:]])
            yield rows.set_column(place, rows.schema.field(place), pa.array(out, rows.schema.field(place).type))

    names = documents.columns
    out = documents.mapInArrow(cut, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)).select(names) if "n_chars" in names else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(spark, docs, train(docs))
