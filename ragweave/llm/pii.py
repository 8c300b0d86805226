"""Personal data by a skip-chain conditional random field.

Base spans (e-mail addresses, IP addresses, card and phone numbers) are found by linear scans. A
conditional random field then labels the candidate tokens of a document: tokens with a digit or
an ``@``, and tokens that are the local part of one of its addresses; all other tokens are outside
by definition. Neighbouring candidates share a chain potential. Distant tokens that are repeated or
similar (equal without case and punctuation, with the same last digits, or an address and its local
part) share a skip potential, so that what is labelled in one place is labelled in the others too.
Occurrences are linked each to the next, so a token repeated n times has n - 1 links. Marginals come
from loopy belief propagation, in lockstep over the documents of a batch, each until its messages
settle, so that a label reaches all its repetitions; tokens of base spans are clamped to their kind. Tokens whose marginal for a kind reaches ``CONFIDENT`` and that touch no base
span are added as spans, neighbours of one kind as one.

The field is fitted by pseudo-likelihood on a bounded sample of labelled documents, where base spans
are the labels: ``TRAIN_DOCS`` documents of up to ``TRAIN_CHARS`` characters, by hash. Spans are
mentioned again there in a disguise that no base pattern sees (a number without its plus or its
separators, an address's local part alone), labelled as what they repeat, beside disguised spans of
other documents, which are labelled outside. Both look alike, so only the skip potentials can tell
them apart: what repeats nothing stays outside, what repeats a base span takes its label.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; rows
are independent; repeated rows have equal results; kinds of equal marginal go in the order of
``KINDS``; a corpus without base spans adds nothing; an empty table gives no rows; other columns are
passed on.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_CHARS = 1000, 20_000
CONFIDENT = 0.8
#: A document's messages are passed until none changes by more than TOLERANCE, or for ROUNDS more
#: rounds than it has variables: enough to reach the end of any path, whether or not they settle.
TOLERANCE, ROUNDS, DAMPING = 1e-6, 100, 0.3
STEPS, RATE, DECAY = 1000, 0.5, 1e-3
GROUP_CHARS = 2_000_000
L = len(KINDS) + 1  # 0: outside

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CANDIDATE = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = frozenset(" \t\n\x0b\x0c\r")
#: Before a word after a word, neither with a digit next to the gap.
_GAP = re.compile(r"(?<=[a-z.,]) (?=[A-Za-z])")
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted; kind is an index of KINDS.

    Each kind is scanned once: a match can only begin where its run of characters does or where the
    match before ended, so no start is tried twice.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def described(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidates(text: str, base) -> list[tuple[int, int]]:
    """(start, end) of the tokens that are variables of the field, in order."""
    found, free = [], 0
    for m in _CANDIDATE.finditer(text):
        start = m.start()
        while start > free and text[start - 1] not in _BLANK:
            start -= 1
        found.append((start, m.end()))
        free = m.end()
    locals_ = {text[a : text.index("@", a)].lower() for a, k, _ in base if k == 0}
    locals_ = {x for x in locals_ if len(x) > 3}
    if locals_:
        have = {s for s, _ in found}
        found += [m.span() for m in _WORD.finditer(text) if m.start() not in have and m[0].strip(_EDGE).lower() in locals_]
        found.sort()
    return found


def features(token: str) -> list[float]:
    """Unary features of a token."""
    digits = _NOT_DIGIT.sub("", token)
    n, bare = len(digits), token.strip(_EDGE)
    parts = bare.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    only = not bare.strip("0123456789 .()-+")
    return [
        1.0, "@" in bare, bare.count("@") == 1 and "." in bare[bare.find("@") :], quad, n == 0, 1 <= n <= 3, n == 4, 5 <= n <= 9, 10 <= n <= 13,
        14 <= n <= 19, n >= 20, bare.startswith("+"), only, 14 <= n <= 19 and only and luhn(digits), 14 <= n <= 19 and only and not luhn(digits), "-" in bare, "(" in token or ")" in token, any(c.isalpha() for c in bare),
    ]


N_FEATURES = 18


class Graph:
    """Variables, features, labels and edges of a group of documents."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.x: list[list[float]] = []
        self.label: list[int] = []  # kind + 1 of the base span that a token touches, else 0
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, doc: int, text: str, base, more=()) -> None:
        """A document with its base spans; ``more`` are spans that give labels only."""
        last: dict[str, int] = {}
        labelled = sorted([*base, *more]) if more else base
        starts = [s[0] for s in labelled]
        locals_ = {text[a : text.index("@", a)].lower() for a, k, _ in base if k == 0}
        for start, end in candidates(text, base):
            i, token = len(self.spans), text[start:end]
            self.spans.append((doc, start, end))
            self.x.append(features(token))
            near = range(max(0, bisect.bisect_left(starts, end) - 2), bisect.bisect_left(starts, end))
            touched = [labelled[j] for j in near if labelled[j][2] > start]
            self.label.append(touched[0][1] + 1 if touched else 0)
            if i and self.spans[i - 1][0] == doc and not text[self.spans[i - 1][2] : start].strip():
                self.chain.append((i - 1, i))
            bare = token.strip(_EDGE).lower()
            digits = _NOT_DIGIT.sub("", token)
            keys = {f"w:{bare}"} if bare else set()
            if len(digits) >= 7:
                keys.add(f"d:{digits[-7:]}")
            if "@" in bare:
                keys.add(f"u:{bare[: bare.index('@')]}")
            elif bare in locals_:
                keys.add(f"u:{bare}")
            linked = {last[k] for k in keys if k in last}
            self.skip += [(j, i) for j in linked]
            last.update(dict.fromkeys(keys, i))

    def arrays(self):
        edge = lambda e: np.array(e, np.int64).reshape(-1, 2)
        return np.array(self.x, np.float64).reshape(-1, N_FEATURES), np.array(self.label, np.int64), edge(self.chain), edge(self.skip)


def disguised(kind: int, span: str, r: random.Random) -> str | None:
    """Another mention of a span, which no base pattern finds; None if it has none."""
    if KINDS[kind] == "email":
        local = span[: span.index("@")]
        return local if len(local) > 3 and local[0].isalpha() else None
    digits = _NOT_DIGIT.sub("", span)
    if KINDS[kind] == "card":
        digits = "/".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if r.random() < 0.5 else f"{digits}x"
    elif r.random() < 0.5:
        digits = "/".join((digits[:3], digits[3:]))
    return digits if len(_NOT_DIGIT.sub("", digits)) >= 7 and not base_spans(digits) else None


def rehearsed(texts: list[str], seed: int = 5) -> Iterator[tuple[str, list, list]]:
    """Each text with further mentions of some of its own and of other texts' spans: text, base spans, and the spans of its own mentions."""
    r = random.Random(seed)
    foreign: list[str] = []
    for text in texts:
        base = base_spans(text)
        gaps = [m.start() for m in _GAP.finditer(text)]
        own = [(k, disguised(k, text[a:b], r)) for a, k, b in r.sample(base, min(2, len(base)))]
        others = [(None, f) for f in r.sample(foreign, min(2, len(foreign)))]
        foreign += [m for _, m in own if m]
        at = sorted(r.sample(gaps, min(len(gaps), len(own) + len(others))))
        parts, low, size, spans = [], 0, 0, []
        mentions = r.sample(own + others, len(at))
        for gap, (kind, mention) in zip(at, mentions, strict=True):
            if not mention:
                continue
            parts.append(text[low:gap] + " ")
            size += gap - low + 1
            if kind is not None:
                spans.append((size, kind, size + len(mention)))
            parts.append(mention)
            size, low = size + len(mention), gap
        made = "".join(parts) + text[low:]
        yield made, base_spans(made), spans


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Unary weights (features x labels) and the chain and skip potentials (labels x labels)."""
    graph = Graph()
    for i, (t, base, more) in enumerate(rehearsed(texts)):
        graph.add(i, t, base, more)
    x, y, chain, skip = graph.arrays()
    if not len(x) or not y.any():
        return None
    one = np.eye(L)[y]
    around = []
    for e in (chain, skip):
        sums = np.zeros((len(x), L))
        np.add.at(sums, e[:, 0], one[e[:, 1]])
        np.add.at(sums, e[:, 1], one[e[:, 0]])
        around.append(sums)
    z = np.hstack([x, *around])
    w = np.zeros((z.shape[1], L))
    share = 1 / np.maximum(one.sum(0), 1)  # kinds weigh alike, however rare
    weight = share[y] / share[y].sum()
    for _ in range(STEPS):
        score = z @ w
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= RATE * (z.T @ ((p - one) * weight[:, None]) + DECAY * w) * 10
    unary, c, s = w[:N_FEATURES], w[N_FEATURES : N_FEATURES + L], w[N_FEATURES + L :]
    return unary, (c + c.T) / 2, (s + s.T) / 2


def marginals(graph: Graph, model) -> np.ndarray:
    """Marginals of all labels by loopy belief propagation; touched tokens are clamped."""
    unary, c, s = model
    x, y, chain, skip = graph.arrays()
    score = x @ unary
    score[y > 0] = -50.0
    score[np.flatnonzero(y), y[y > 0]] = 0.0
    score -= score.max(1, keepdims=True)
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    to = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    half = np.concatenate([np.arange(len(chain)) + len(chain), np.arange(len(chain)), 2 * len(chain) + len(skip) + np.arange(len(skip)), 2 * len(chain) + np.arange(len(skip))])
    kind = np.repeat([0, 1], [2 * len(chain), 2 * len(skip)])
    potential = np.exp(np.clip(np.stack([c, s]), -20, 20))[kind] if len(kind) else np.empty((0, L, L))
    message = np.zeros((len(source), L))
    doc = np.array([d for d, _, _ in graph.spans], np.int64)
    sizes = np.bincount(doc)
    of, limit, live, rounds = doc[to], ROUNDS + sizes, np.arange(len(source)), 0
    while len(live):
        total = score.copy()
        np.add.at(total, to[live], message[live])
        out = total[source[live]] - message[half[live]]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.maximum(np.einsum("el,elm->em", out, potential[live]), 1e-300))
        new -= new.max(1, keepdims=True)
        old, rounds = message[live], rounds + 1
        message[live] = DAMPING * old + (1 - DAMPING) * new
        change = np.zeros(len(sizes))
        np.maximum.at(change, of[live], np.abs(new - old).max(1))
        live = live[((change > TOLERANCE) & (rounds < limit))[of[live]]]
    total = score
    np.add.at(total, to, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(graph: Graph, model) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind, end) of the spans that the field adds, by document."""
    if model is None or not graph.spans:
        return {}
    p = marginals(graph, model)
    best = p.argmax(1)
    sure = (p.max(1) >= CONFIDENT) & (best > 0) & (np.array(graph.label) == 0)
    chained = {b for _, b in graph.chain}
    out: dict[int, list[tuple[int, int, int]]] = {}
    before = -2
    for i in np.flatnonzero(sure):
        doc, start, end = graph.spans[i]
        spans = out.setdefault(doc, [])
        if before == i - 1 and i in chained and best[i] == best[before]:
            spans[-1] = (spans[-1][0], spans[-1][1], end)
        else:
            spans.append((start, int(best[i]) - 1, end))
        before = i
    return out


def find(texts: list[str], model) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    graph, base = Graph(), []
    for i, t in enumerate(texts):
        base.append(base_spans(t))
        graph.add(i, t, base[-1])
    more = added_spans(graph, model)
    return [(b, sorted(b + more.get(i, []))) for i, b in enumerate(base)]


def train(docs: DataFrame):
    """The model, from a bounded sample of the documents that may hold personal data.

    Only rows in a slice of the hash space, cut to some ``4 * TRAIN_DOCS`` rows by their count, are sorted.
    """
    labelled = docs.where((F.length("text") <= TRAIN_CHARS) & F.col("text").rlike(r"@|[0-9]{4}|[0-9]\.[0-9]"))
    h = F.xxhash64(F.lit(11), *(["doc_id", "text"] if "doc_id" in docs.columns else ["text"]))
    n, space = labelled.count(), 1 << 40
    sliced = labelled.select("text", h.alias("h")).where(F.pmod(F.col("h"), F.lit(space)) < space * 4 * TRAIN_DOCS // max(n, 1))
    rows = sliced.orderBy("h", "text").limit(TRAIN_DOCS).toArrow()
    return fit(rows.column("text").to_pylist())


def annotate(docs: DataFrame) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone and base_sha256 (of base spans) and spans (all), in place of any of these names."""
    model = train(docs)
    counts = [f"n_{k}" for k in KINDS]
    fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    @F.pandas_udf(T.StructType(fields))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows, low = [t or "" for t in batch], [], 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and chars < GROUP_CHARS:
                    chars += len(texts[high])
                    high += 1
                for base, every in find(texts[low:high], model):
                    kinds = [k for _, k, _ in base]
                    rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(described(base).encode()).hexdigest(), described(every)))
                low = high
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    keep = [c for c in docs.columns if c not in {f.name for f in fields}]
    return docs.select(*keep, run("text").alias("__p")).select(*keep, "__p.*")


def report(docs: DataFrame) -> DataFrame:
    return annotate(docs.select("doc_id", "text")).drop("text")
