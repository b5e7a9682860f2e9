"""Personal data: patterns, and a skip-chain conditional random field that adds what the patterns miss.

Words that hold a digit or an at sign are the variables; every other word is clamped to "none". Neighbouring words share
a transition potential, and all places of one document with the same content, however far apart, share an agreement
potential with one hub for that content, so evidence for one speaks for all. The content of a number is its last eight
digits, over as many neighbouring words as it takes, so country code, signs and blanks do not matter; shorter words are
compared as they are. Loopy belief propagation, until nothing changes, gives marginals;
of a run of one label, the parts that form whole values are added to the spans of the patterns, which always stay.

Training is piecewise: Spark counts (features, label), (label, label) and agreements over all documents, the labels
being the patterns' own spans, and the driver fits a softmax regression to the counted features. Features are a few
small categories, so what the driver sees is bounded by their combinations.

Edge cases: null and empty texts have no spans; offsets are code points, the end exclusive; texts are read whole in
linear time, also without any white space; added spans never overlap others; repeated rows are read alike; an empty
table trains a field that adds nothing. Other columns are kept; names that clash with result columns are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
NEW = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "all_spans"]
Span = tuple[int, int, int]

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@]")
# fixed values: the patterns of the four kinds; possessive where the next character decides anyway
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Most words of a value: each has a digit, and no kind has more than 19.
MOST = 19
#: Digits by which numbers are compared; no phone has fewer.
TAIL = 8
NUMBER = re.compile(r"[0-9().+-]*[0-9][0-9().+-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the at signs, so that long runs of letters cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


class Field(NamedTuple):
    """Words of one document that are variables: number of the word, span without outer marks, features, content."""

    number: list[int]
    spans: list[tuple[int, int]]
    features: list[tuple[int, ...]]
    content: list[str]
    #: Last eight digits of the number that ends with the word, and its first word; None where there are fewer.
    tails: list[tuple[str, int] | None]


def _tails(text: str, number: list[int], spans: list[tuple[int, int]]) -> list[tuple[str, int] | None]:
    out: list[tuple[str, int] | None] = []
    for k in range(len(number)):
        digits, first = "", k
        while True:
            core = text[slice(*spans[first])]
            if not NUMBER.fullmatch(core) or IP.fullmatch(core):
                digits = ""
                break
            digits = re.sub("[^0-9]", "", core) + digits
            if len(digits) >= TAIL or not first or number[first - 1] != number[first] - 1:
                break
            first -= 1
        out.append((digits[-TAIL:], first) if len(digits) >= TAIL else None)
    return out


def _shape(word: str) -> tuple[int, ...]:
    """Categories of one word; the values of each begin at 0."""
    digits = re.sub("[^0-9]", "", word)
    n, dots = len(digits), word.count(".")
    ip = IP.fullmatch(word) is not None and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in word.split("."))
    at = word.find("@")
    mail = 0 if at < 0 else 1 + (at > 0 and HOST.fullmatch(word, at + 1) is not None)
    return (
        sum(n > k for k in (0, 2, 3, 4, 6, 7, 11, 15, 19)), min(dots, 4), int(word[:1] == "+"), int("(" in word or ")" in word), int("-" in word),
        mail, int(any(c.isalpha() for c in word)), int(16 <= n <= 19 and luhn(digits)), int(ip),
    )


SIZES = (10, 5, 2, 2, 2, 3, 2, 2, 2, 8, 8)
JOINT = 256


def _near(shape: tuple[int, ...] | None) -> int:
    """What a neighbour looks like: none, plus sign, brackets, at sign, letters, dash, few digits, many."""
    if shape is None:
        return 0
    for value, true in ((1, shape[2]), (2, shape[3]), (3, shape[5]), (4, shape[6]), (5, shape[4])):
        if true:
            return value
    return 6 if shape[0] < 5 else 7


def field(text: str) -> Field:
    out = Field([], [], [], [], [])
    shapes = []
    for number, m in enumerate(WORD.finditer(text)):
        if not MARK.search(m[0]):
            continue
        core = m[0].rstrip(".,;:!?\"')]}>")
        if core.count("(") > core.count(")") and m[0][len(core): len(core) + 1] == ")":
            core += ")"
        lead = len(core) - len(core.lstrip("\"'[{<,;:!?"))
        core = core[lead:]
        shapes.append(_shape(core))
        out.number.append(number)
        out.spans.append((m.start() + lead, m.start() + lead + len(core)))
        digits = re.sub("[^0-9]", "", core)
        out.content.append(core.lower() if "@" in core or len(digits) < 7 or "." in core else digits)
    for k, shape in enumerate(shapes):
        before = shapes[k - 1] if k and out.number[k - 1] == out.number[k] - 1 else None
        after = shapes[k + 1] if k + 1 < len(shapes) and out.number[k + 1] == out.number[k] + 1 else None
        out.features.append((*shape, _near(before), _near(after)))
    out.tails.extend(_tails(text, out.number, out.spans))
    return out


def labels(found: Field, spans: list[Span]) -> list[int]:
    out = [0] * len(found.spans)
    for kind, a, b in spans:
        for k, (s, e) in enumerate(found.spans):
            if s < b and a < e:
                out[k] = kind + 1
    return out


def edges(found: Field) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(neighbours, the words of each content that occurs more than once)."""
    chain = [(k, k + 1) for k in range(len(found.number) - 1) if found.number[k + 1] == found.number[k] + 1]
    ends: dict[str, list[int]] = {}
    for k, tail in enumerate(found.tails):
        if tail:
            ends.setdefault(tail[0], []).append(k)
    same, held = [], set()
    for places in ends.values():
        # of one number in several words, ends in a row are one place only if they do not share a word
        apart = [k for n, k in enumerate(places) if not n or found.tails[k][1] > places[n - 1]]
        if len(apart) > 1:
            same.append([word for k in apart for word in range(found.tails[k][1], k + 1)])
            held.update(same[-1])
    words: dict[str, list[int]] = {}
    for k, content in enumerate(found.content):
        if k not in held:
            words.setdefault(content, []).append(k)
    return chain, same + [places for places in words.values() if len(places) > 1]


class Crf(NamedTuple):
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    hub: np.ndarray | None = None

    def marginals(self, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 2000, hubs: int = 0) -> np.ndarray:
        """Of every variable, by loopy belief propagation over both kinds of edges until no message changes.

        ``skip`` edges lead from a word to a hub, which are numbered after the words. ``rounds`` only ends what would
        swing for ever; messages that have settled are not computed again.
        """
        node = one_hot(features) @ self.weights
        node = np.concatenate([node, np.tile(np.zeros(len(LABELS)) if self.hub is None else self.hub, (hubs, 1))])
        one = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2)
        pair = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        source, target = np.concatenate([one, one[:, ::-1]]).T
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        message, back = np.zeros((len(source), len(LABELS))), np.roll(np.arange(len(source)), len(one))
        belief, open_ = node.copy(), np.arange(len(source))
        for _ in range(rounds):
            if not len(open_):
                break
            new = (belief[source[open_]] - message[back[open_]])[:, :, None] + pair[open_]
            top = new.max(1)
            new = top + np.log(np.exp(new - top[:, None]).sum(1))
            change = 0.5 * (new - new.max(1, keepdims=True) - message[open_])
            message[open_] += change
            np.add.at(belief, target[open_], change)
            moved = open_[np.abs(change).max(1) > 1e-8]
            reached, again = np.zeros(len(belief), bool), np.zeros(len(source), bool)
            reached[target[moved]], again[moved] = True, True
            open_ = np.flatnonzero(again | reached[source])
        node = belief[: len(features)]
        node = np.exp(node - node.max(1, keepdims=True))
        return node / node.sum(1, keepdims=True)


def one_hot(features: np.ndarray) -> np.ndarray:
    """Each category, and all of a word's own categories joined in one of ``JOINT`` values."""
    starts = np.cumsum([0, *SIZES])
    out = np.zeros((len(features), starts[-1] + JOINT + 1), np.float64)
    rows = np.arange(len(features))
    for k in range(len(SIZES)):
        out[rows, starts[k] + features[:, k]] = 1
    joint = np.zeros(len(features), np.uint64)
    for k in range(9):
        joint = joint * np.uint64(16) + features[:, k].astype(np.uint64)
    out[rows, starts[-1] + (W.mixed(joint) % np.uint64(JOINT)).astype(np.int64)] = 1
    out[:, -1] = 1
    return out


def train(documents: DataFrame, text: str = "text", rounds: int = 300) -> Crf:
    """Potentials from counts over all documents."""
    W.arrow_batches(documents.sparkSession)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and MARK.search(t):
                    found = field(t)
                    label = labels(found, base_spans(t))
                    chain, same = edges(found)
                    seen.update(("node", *f, y) for f, y in zip(found.features, label))
                    seen.update(("chain", label[i], label[j]) for i, j in chain)
                    for words in same:
                        # what most of the labelled places say, is what the content is
                        said = Counter(label[k] for k in words if label[k]).most_common(1)
                        hub = said[0][0] if said else 0
                        seen.update(("skip", label[k], hub) for k in words)
                        seen["hub", hub] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([list(k[1:]) for k in keys], pa.list_(pa.int32())), pa.array([seen[k] for k in keys], pa.int64())],
            ["kind", "key", "n"])

    chosen = documents.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    counts = chosen.mapInArrow(count, "kind string, key array<int>, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    size = len(LABELS)
    pairs = {"chain": np.full((size, size), 1.0), "skip": np.full((size, size), 0.1) + np.eye(size)}
    hub = np.ones(size)
    nodes = sorted((tuple(r["key"]), r["n"]) for r in counts if r["kind"] == "node")
    for r in counts:
        if r["kind"] == "hub":
            hub[r["key"][0]] += r["n"]
        elif r["kind"] != "node":
            pairs[r["kind"]][tuple(r["key"])] += r["n"]
    # association of the labels at both ends; the labels' own frequency is in the nodes
    potential = {}
    for kind, n in pairs.items():
        p = n / n.sum()
        potential[kind] = np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -4, 4)
    if not nodes:
        return Crf(np.zeros((sum(SIZES) + JOINT + 1, size)), potential["chain"], potential["skip"], np.log(hub / hub.sum()))
    x = one_hot(np.array([k[:-1] for k, _ in nodes]))
    y, n = np.array([k[-1] for k, _ in nodes]), np.sqrt(np.array([n for _, n in nodes], float))
    n /= n.sum()
    w = np.zeros((x.shape[1], size))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        s = x @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ (p * n[:, None]) + 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return Crf(w, potential["chain"], potential["skip"], np.log(hub / hub.sum()))


def whole(kind: int, value: str) -> bool:
    """Whether a run of words of one label forms a value of its kind."""
    digits = sum(c in "0123456789" for c in value)
    if kind == 0:
        at = value.find("@")
        return at > 0 and "." in value[at:] and not re.search(r"\s", value)
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value) is not None and all(int(p) <= 255 for p in value.split("."))
    if re.search(r"[^0-9\x20().+-]", value):
        return False
    if kind == 2:
        return 16 <= digits <= 19 and luhn(re.sub("[^0-9]", "", value))
    return 8 <= digits <= 15 and value.rfind("+") < 1


def parts(text: str, kind: int, spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[Span]:
    """Whole values among the words of one run: most that begin with a sign, then most words, then fewest values."""
    # of the words before each end: (signs, words, -values) and the last value's first word, if one ends there
    best: list[tuple[tuple[int, int, int], int | None]] = [((0, 0, 0), None)]
    for end in range(1, len(spans) + 1):
        top: tuple[tuple[int, int, int], int | None] = (best[-1][0], None)
        for first in range(end - 1, max(-1, end - 1 - MOST), -1):
            a, b = spans[first][0], spans[end - 1][1]
            if whole(kind, text[a:b]) and not any(s < b and a < e for s, e in taken):
                signs, words, values = best[first][0]
                top = max(top, ((signs + (text[a] in "+("), words + end - first, values - 1), first), key=lambda x: x[0])
        best.append(top)
    out, end = [], len(spans)
    while end:
        first = best[end][1]
        if first is None:
            end -= 1
        else:
            out.append((kind, spans[first][0], spans[end - 1][1]))
            end = first
    return out[::-1]


def repeats(text: str, found: Field, label: np.ndarray, base: list[Span]) -> np.ndarray:
    """Labels, with phone for every word of a number that a phone pattern shows in this document."""
    phones: dict[str, list[str]] = {}
    for kind, a, b in base:
        if kind == 3:
            digits = re.sub("[^0-9]", "", text[a:b])
            phones.setdefault(digits[-TAIL:], []).append(digits)
    label = label.copy()
    for k, tail in enumerate(found.tails if phones else []):
        if tail and tail[0] in phones:
            first = tail[1]
            while True:
                digits = re.sub("[^0-9]", "", text[found.spans[first][0]: found.spans[k][1]])
                if not any(phone.endswith(digits) for phone in phones[tail[0]]):
                    break
                label[first: k + 1] = 4
                if not first or found.number[first - 1] != found.number[first] - 1 or not NUMBER.fullmatch(text[slice(*found.spans[first - 1])]):
                    break
                first -= 1
    return label


def added(text: str, found: Field, label: np.ndarray, base: list[Span]) -> list[Span]:
    """Whole values among runs of neighbouring words of one label, clear of all other spans."""
    out, k = [], 0
    taken = sorted((a, b) for _, a, b in base)
    label = repeats(text, found, label, base)
    while k < len(label):
        end = k + 1
        while end < len(label) and label[end] == label[k] and found.number[end] == found.number[end - 1] + 1 and label[k] > 2:
            end += 1
        if label[k]:
            new = parts(text, int(label[k]) - 1, found.spans[k:end], taken)
            out += new
            taken += [(a, b) for _, a, b in new]
        k = end
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal(documents: DataFrame, crf: Crf | None = None, text: str = "text") -> DataFrame:
    """Documents with the number of base spans of each kind, base_spans and all_spans (kind:start:end, comma-joined)."""
    crf = crf or train(documents, text)
    W.arrow_batches(documents.sparkSession)
    kept = documents.select(*[c for c in documents.columns if c not in NEW])
    place = kept.columns.index(text)

    def read(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            base, fields = [[] for _ in texts], {}
            for k, t in enumerate(texts):
                if MARK.search(t):
                    base[k], fields[k] = base_spans(t), field(t)
            features, chain, groups, start = [], [], [], [0]
            for found in fields.values():
                near, same = edges(found)
                chain += [(i + start[-1], j + start[-1]) for i, j in near]
                groups += [[k + start[-1] for k in words] for words in same]
                features += found.features
                start.append(len(features))
            every = [list(b) for b in base]
            if features:
                skip = [(k, len(features) + hub) for hub, words in enumerate(groups) for k in words]
                pairs = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
                best = crf.marginals(np.array(features), *pairs, hubs=len(groups)).argmax(1)
                for (k, found), a, b in zip(fields.items(), start, start[1:]):
                    every[k] += added(texts[k], found, best[a:b], base[k])
            counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *counts, pa.array([joined(b) for b in base], pa.string()), pa.array([joined(e) for e in every], pa.string())],
                [*batch.schema.names, *NEW])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(read, f"{schema}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, all_spans string")


def masked(text: str, spans: str) -> str:
    """The text with each span replaced by the name of its kind."""
    parts = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s))
    out, free = [], 0
    for a, b, kind in parts:
        if a >= free:
            out += [text[free:a], f"<{kind}>"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def op10_personal(spark, sf_dir: str) -> DataFrame:
    """Personal data of every text: counts and digest of the patterns, and all spans."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return personal(documents).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), F.col("all_spans").alias("spans")
    )
