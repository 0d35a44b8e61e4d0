"""Secret scans: base patterns, and a character convolutional network over further candidates.

Base patterns (assignments, access keys, long hexadecimal runs) always stay. What they
leave of every run of key characters is a candidate where it has 12 characters or more,
letters alone included. A small convolutional network in numpy reads the candidate with
the characters around it; long candidates are read in overlapping blocks and the highest
block counts.

The network is trained at call time on labelled findings that ``labelled_findings``
makes from a fixed seed (``TRAIN_ROWS`` rows, the documented bound): key formats as
positives; paths, identifiers, versions, dates, addresses and prose as negatives. A
held-out part calibrates the logits (Platt) and sets the threshold: the highest that
still finds ``recall`` of the held-out secrets.

Edge cases: null and empty texts have no spans; rows that repeat are answered once
each; ties are ordered by start, then kind; texts are scanned whole, and memory
grows with one text and its candidates, which are scored in blocks of ``SCORE_ROWS``.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import map_rows, texts_of

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")

LEFT, BODY, RIGHT = 24, 64, 8
WIDTH = LEFT + BODY + RIGHT
EMBED, FILTERS, SPAN = 12, 32, 5
PAD, OTHER = 128, 129
TRAIN_ROWS, SEED, EPOCHS, RECALL = 8000, 7, 5, 0.98
SCORE_ROWS = 128

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, stop) of what the base patterns find."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of each run, in pieces of ``LEAST`` characters or more."""
    out, k = [], 0
    # One sweep: both lists are in order. Spans may nest, so they are joined first.
    joined: list[list[int]] = []
    for a, _, b in taken:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(joined) and joined[k][1] <= at:
            k += 1
        j = k
        while j < len(joined) and joined[j][0] < end:
            if joined[j][0] - at >= LEAST:
                out.append((at, joined[j][0]))
            at, j = max(at, joined[j][1]), j + 1
        if end - at >= LEAST:
            out.append((at, end))
    return out


def encode(text: str, start: int, stop: int) -> list[np.ndarray]:
    """Rows of character codes, one for each block of the candidate."""
    rows = []
    for at in range(start, max(start + 1, stop - BODY // 2), BODY // 2):
        left, body, right = text[max(0, at - LEFT) : at], text[at : min(stop, at + BODY)], text[min(stop, at + BODY) : min(stop, at + BODY) + RIGHT]
        row = np.full(WIDTH, PAD, dtype=np.int16)
        for offset, part in ((LEFT - len(left), left), (LEFT, body), (LEFT + len(body), right)):
            row[offset : offset + len(part)] = [c if (c := ord(x)) < 128 else OTHER for x in part]
        row[LEFT : LEFT + len(body)] += 256  # inside the candidate
        rows.append(row)
    return rows


class CharCnn:
    """Embedding, one convolution with ReLU, maximum inside and around the candidate, one dense layer."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (OTHER + 1, EMBED)).astype(np.float32),
            "w": r.normal(0, (2 / (SPAN * (EMBED + 1))) ** 0.5, (SPAN * (EMBED + 1), FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": r.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, rows: np.ndarray):
        inside = rows >= 256
        codes = rows & 255
        x = np.concatenate([self.p["e"][codes], inside[..., None].astype(np.float32)], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(x, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), WIDTH - SPAN + 1, -1)
        h = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        mid = inside[:, SPAN // 2 : SPAN // 2 + h.shape[1], None]
        own, around = np.where(mid, h, -1), np.where(mid, -1, h)
        at = np.stack([own.argmax(1), around.argmax(1)], 1)
        pooled = np.concatenate([own.max(1), around.max(1), np.ones((len(rows), 1), np.float32)], axis=1)
        return codes, cols, h, at, pooled, pooled @ self.p["v"]

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, batch: int = 128, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                codes, cols, h, at, pooled, z = self.forward(rows[own])
                d = ((1 / (1 + np.exp(-z)) - labels[own]) / len(own)).astype(np.float32)
                g = {"v": pooled.T @ d + 1e-4 * self.p["v"]}
                dp = d[:, None] * self.p["v"][None, :-1] * (pooled[:, :-1] > 0)
                n = np.arange(len(own))[:, None, None]
                where = at  # (batch, 2, filters)
                dh = np.zeros_like(h)
                np.add.at(dh, (n, where, np.arange(FILTERS)[None, None]), dp.reshape(len(own), 2, FILTERS))
                dh *= h > 0
                g["w"] = np.tensordot(cols, dh, axes=([0, 1], [0, 1]))
                g["b"] = dh.sum((0, 1))
                dcols = (dh @ self.p["w"].T).reshape(len(own), -1, SPAN, EMBED + 1)[..., :EMBED]
                de = np.zeros((len(own), WIDTH, EMBED), np.float32)
                for j in range(SPAN):
                    de[:, j : j + dcols.shape[1]] += dcols[:, :, j]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], codes.ravel(), de.reshape(-1, EMBED))
                t += 1
                for key, grad in g.items():
                    m[key] = 0.9 * m[key] + 0.1 * grad
                    s[key] = 0.99 * s[key] + 0.01 * grad * grad
                    self.p[key] -= rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(s[key] / (1 - 0.99**t)) + 1e-7)

    def calibrate(self, rows: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by Newton steps, then the highest threshold with the recall asked for."""
        z = self.forward(rows)[5].astype(np.float64)
        z = np.clip(z, -30, 30)
        a, b = 1.0, 0.0
        n1, n0 = labels.sum(), len(labels) - labels.sum()
        soft = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(50):
            q = 1 / (1 + np.exp(-(a * z + b)))
            grad = np.array([((q - soft) * z).sum() + 1e-3 * (a - 1), (q - soft).sum()])
            w = q * (1 - q) + 1e-9
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(a), float(b)
        own = np.sort(1 / (1 + np.exp(-(a * z[labels > 0] + b))))
        self.threshold = float(own[int((1 - recall) * len(own))])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(rows[k : k + SCORE_ROWS])[5] for k in range(0, len(rows), SCORE_ROWS)])
        return 1 / (1 + np.exp(-(self.scale * np.clip(z.astype(np.float64), -30, 30) + self.shift)))


def labelled_findings(n: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, stop, label): ``n`` made findings, half of them secrets."""
    r = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    up, low, dig = string.ascii_uppercase, string.ascii_lowercase, string.digits
    mixed = up + low + dig
    length = lambda a, b: int(r.integers(a, b))
    word = lambda: pick("etaoinshrdlu", length(2, 9))
    number = lambda a, b: pick(dig, length(a, b))
    spoken = lambda k: "".join(pick("bcdfghklmnprstvwz", 1) + pick("aeiou", 1) + pick("nrstlch", length(0, 2)) for _ in range(k))
    common = lambda k: pick("eeeeeetttttaaaaooooiiiinnnnsssshhhrrrddllllccuummwwffggyyyppbbvk", k)
    secrets = [
        lambda: "ghp_" + pick(mixed, 36),
        lambda: ("sk_live_", "sk_test_", "rk_live_", "sk-")[length(0, 4)] + pick(mixed, length(20, 40)),
        lambda: "xoxb-" + number(10, 13) + "-" + number(10, 13) + "-" + pick(mixed, 24),
        lambda: "AIza" + pick(mixed + "_-", 35),
        lambda: "eyJ" + pick(mixed, length(15, 40)) + ".eyJ" + pick(mixed, length(20, 80)) + "." + pick(mixed + "_-", 43),
        lambda: pick(mixed + "+/", length(30, 64)) + "=" * length(0, 3),
        lambda: pick(mixed, length(20, 44)),
        lambda: "glpat-" + pick(mixed + "_-", 20),
        lambda: "SG." + pick(mixed, 22) + "." + pick(mixed, 43),
        lambda: pick("0123456789ABCDEF", length(24, 64)),
        lambda: pick(up + low, length(20, 48)),
        lambda: pick(mixed + "_-", length(22, 48)),
    ]
    plain = [
        lambda: "/".join(word() for _ in range(length(3, 6))) + "/" + number(1, 6),
        lambda: "-".join(word() for _ in range(length(3, 7))) + "-" + number(1, 5),
        lambda: "_".join(word() for _ in range(length(3, 6))) + "_" + number(1, 4),
        lambda: "".join(word().capitalize() for _ in range(length(3, 6))) + number(1, 3),
        lambda: word() + "." + word() + number(1, 4) + ".example." + ("com", "org", "net")[length(0, 3)],
        lambda: f"20{number(2, 3)}-{number(2, 3)}-{number(2, 3)}T{number(2, 3)}.{number(2, 3)}.{number(2, 3)}Z",
        lambda: word() + word() + word() + "-" + number(1, 3) + "." + number(1, 3) + "." + number(1, 3),
        lambda: word() + number(1, 3) + "." + word() + "/" + word() + ".html",
        lambda: word() + word() + word() + number(1, 4),
        lambda: number(12, 20) + word()[:2],
        lambda: word() + "=" * length(3, 9) + number(1, 3) + word() + word(),
        lambda: spoken(length(4, 9)),
        lambda: spoken(length(4, 8)).capitalize() + ".",
        lambda: spoken(length(4, 9)).upper(),
        lambda: common(length(12, 26)),
        lambda: common(length(12, 22)).upper(),
        lambda: "-".join(spoken(length(1, 4)) for _ in range(length(2, 5))),
        lambda: spoken(3).capitalize() + spoken(length(2, 4)).capitalize() + spoken(length(1, 4)),
        lambda: "/".join(spoken(length(1, 4)) for _ in range(length(2, 6))) + ("", ".py", ".html", ".tar.gz")[length(0, 4)],
        lambda: "_".join(spoken(length(1, 4)) for _ in range(length(2, 5))).upper(),
        lambda: "-_=."[length(0, 4)] * length(12, 60),
        lambda: ".".join(number(1, 4) for _ in range(length(3, 6))),
        lambda: spoken(length(1, 3)) + "..." + spoken(length(2, 5)),
        lambda: "-".join((pick("0123456789abcdef", 8), *(pick("0123456789abcdef", 4) for _ in range(3)), pick("0123456789abcdef", 12))),
    ]
    before = {1: ["key: ", "auth=", "Authorization: Bearer ", "credential ", "export KEY=", "", "--key ", '"', "private "], 0: ["see ", "at ", "https://", "file ", "the ", "", "id ", "version ", '"']}
    out = []
    for k in range(n):
        label = k % 2
        kinds = secrets if label else plain
        lead = " ".join(word() for _ in range(length(0, 6)))
        mark = before[label if r.random() < 0.7 else 1 - label]
        lead = (lead + " " if lead else "") + mark[length(0, len(mark))]
        body = kinds[length(0, len(kinds))]()
        while len(body) < LEAST:
            body += pick(mixed, 8) if label else number(4, 8) if r.random() < 0.5 else spoken(4)
        tail = ("", " ", '" ', ". ", "\n")[length(0, 5)] + " ".join(word() for _ in range(length(0, 3)))
        out.append((lead + body + tail, len(lead), len(lead) + len(body), label))
    return out


@lru_cache(maxsize=2)
def trained(rows: int = TRAIN_ROWS, seed: int = SEED, recall: float = RECALL) -> CharCnn:
    """The network, trained on three quarters of the findings and calibrated on the rest."""
    found = labelled_findings(rows, seed)
    x = np.stack([encode(t, a, b)[0] for t, a, b, _ in found])
    y = np.array([label for *_, label in found], dtype=np.float32)
    held = np.arange(len(x)) % 8 >= 6
    net = CharCnn(seed)
    net.train(x[~held], y[~held])
    net.calibrate(x[held], y[held], recall)
    return net


def scan(texts, net: CharCnn) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, in order."""
    out, rows, owner = [], [], []
    for k, text in enumerate(texts):
        own = base_spans(text)
        out.append(own)
        for a, b in candidates(text, own):
            blocks = encode(text, a, b)
            rows += blocks
            owner += [(k, a, b)] * len(blocks)
            if len(rows) >= 8 * SCORE_ROWS:
                _add(out, rows, owner, net)
                rows, owner = [], []
    _add(out, rows, owner, net)
    return [sorted(set(x)) for x in out]


def _add(out, rows, owner, net) -> None:
    if rows:
        for (k, a, b), p in zip(owner, net.scores(np.stack(rows)), strict=True):
            if p >= net.threshold:
                out[k].append((a, 3, b))


def find_secrets(docs: DataFrame, text: str = "text", spans: str = "secrets", net: CharCnn | None = None) -> DataFrame:
    """Add an array of (kind, start, stop) in code points; kinds are those of ``KINDS``."""
    net = net or trained()

    def make():
        return lambda batch: [[[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in own] for own in scan(texts_of(batch, text), net)]]

    return map_rows(docs, make, [(spans, SPANS)])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", net: CharCnn | None = None) -> DataFrame:
    """Replace every span, or run of overlapping spans, by ``mark``; null texts stay null."""
    net = net or trained()

    def make():
        def step(batch):
            whole = [x.as_py() for x in batch.column(text)]
            out = []
            for t, own in zip(whole, scan([t or "" for t in whole], net), strict=True):
                if own:
                    parts, at = [], 0
                    for a, _, b in own:
                        if a >= at:
                            parts += [t[at:a], mark]
                        at = max(at, b)
                    t = "".join(parts) + t[at:]
                out.append(t)
            return [out]

        return step

    return map_rows(docs, make, [(text, T.StringType())]).select(docs.columns)
