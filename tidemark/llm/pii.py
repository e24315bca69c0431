"""Personal data: generators propose spans, boosted trees choose among them.

Four base kinds (email, ip, card, phone) are found by fixed patterns and checks and
always stay. Wider generators propose more spans: secrets, numbers like phones
without a country code, long numbers, account codes, addresses of version 6 and
emails written out. Proposals may overlap. Gradient-boosted trees score each one by
its format (lengths, kinds of characters, entropy) and context (words and marks
before and after, digits around); a calibrated threshold selects, best first, those
that overlap nothing selected before.

The trees learn from proposals of at most ``SAMPLE_DOCS`` documents that may hold one
(the least by a hash), at most ``SAMPLE_SPANS`` in all, and from ``planted`` examples
of every kind, as a corpus may lack some. Their labels are weak: a proposal is
personal if a base kind with its check covers it, if the check of its own kind holds
(IBAN, version 6, domain of a written-out email) or if it is named: a secret by a word
such as ``token``, a number by one such as ``tel`` or ``account``. It is not if its
check fails, if a word such as ``page`` names it or if it is a piece of a longer word.
All others, also long numbers that are no
card, are unknown and teach nothing. The checks of the base kinds are no
features. A quarter of the sample only serves the threshold, which asks for a
precision of ``PRECISION``.

Defined results: null and empty texts have no spans; places are counted in code
points, ends exclusive; every row is judged on its whole text; null ids are
passed on.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import documents
from tidemark.llm.words import slices, text_bytes

BASE_KINDS = ("email", "ip", "card", "phone")

# The base patterns. Local part and domain of an email are matched from its @ outwards,
# and an ip from a run of dotted numbers, so that no text takes more than linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GENERATORS = {
    "secret": re.compile(r"[A-Za-z0-9+/_=-]{16,}"),
    "local_phone": re.compile(r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}"),
    "long_number": re.compile(r"[0-9]{6,}"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "ipv6": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}"),
    "spelled_email": re.compile(r"[A-Za-z0-9._-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]{1,64})+"),
}
KINDS = (*BASE_KINDS, *GENERATORS)
NAMED = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|key|credential)\w{0,8}[\"']?\s{0,2}[:=]\s{0,2}[\"']?$")
HINTS = [
    re.compile(rf"(?i)(?:{words})\W{{0,4}}(?:\w+\W+)?$")
    for words in ("token|secret|passw\\w*|pwd|key", "tel|phone|call|fax|mobile", "card|visa|account|iban|ssn|konto", "mail|contact", "ip|host|server|address", "no|nr|isbn|id|page|section|year")
]

#: words that name a number as personal, or as something else
NAMES = {
    kind: re.compile(rf"(?i)\b(?:{words})\w{{0,8}}\W{{1,4}}(?:\w{{1,12}}\W{{1,4}})?$")
    for kind, words in {
        "local_phone": "tel|phone|call|fax|mobile",
        "long_number": "tel|phone|call|fax|mobile|card|visa|account|iban|ssn|konto",
        "account": "account|iban|ssn|social|konto",
    }.items()
}
OTHERWISE = re.compile(r"(?i)\b(?:no|nr|isbn|id|page|section|year)\W{1,4}$")
#: texts that hold none of these have neither base kinds nor proposals
MAY_HOLD = r"[0-9@]|[(\[]at[)\]]|[0-9A-Fa-f]:[0-9A-Fa-f]"
#: planted examples of each form
PLANTED = 60

SAMPLE_DOCS, SAMPLE_SPANS = 3000, 40_000
ROUNDS, DEPTH, BINS, RATE, SEED = 40, 3, 16, 0.2, 17
PRECISION = 0.98

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        numbers = list(re.finditer(r"[0-9]+", run.group()))
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            if all(len(n.group().lstrip("0")) <= 3 and int(n.group().lstrip("0") or 0) <= 255 for n in four):
                yield "ip", run.start() + four[0].start(), run.start() + four[3].end()


def cards(text: str) -> Iterator[Span]:
    for found in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", found.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", found.start(), found.end()


def phones(text: str) -> Iterator[Span]:
    for found in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in found.group()) <= 15:
            yield "phone", found.start(), found.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind as listed and then by start."""
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


def proposals(text: str) -> list[Span]:
    found = [(kind, m.start(), m.end()) for kind, pattern in GENERATORS.items() for m in pattern.finditer(text)]
    return [s for s in found if s[0] != "secret" or any(c.isdigit() for c in text[s[1] : s[2]])]


def own_check(kind: str, own: str) -> float:
    """Whether the check of a wider kind holds (1) or fails (0); 0.5 for kinds without one."""
    if kind == "account" and "-" in own:  # social security: no such areas, groups and serials
        area, group, serial = own.split("-")
        return float(area not in ("000", "666") and area < "900" and group != "00" and serial != "0000")
    if kind == "account":
        return float(int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1)
    if kind == "ipv6":  # with fewer parts it is a time or a device
        return float(own.count(":") == 7)
    if kind == "spelled_email":
        return float(re.search(r"[A-Za-z]{2,}$", own) is not None)
    return 0.5


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    n = len(own)
    counts = np.unique(list(own), return_counts=True)[1] / n
    digits, letters = sum(c.isdigit() for c in own), sum(c.isalpha() for c in own)
    near = before + after
    return [
        *[float(kind == k) for k in GENERATORS],
        own_check(kind, own),
        n,
        digits,
        letters,
        digits / n,
        sum(c.isupper() for c in own) / n,
        sum(c in "0123456789abcdefABCDEF" for c in own) / n,
        n - digits - letters,
        float(-(counts * np.log2(counts)).sum()),
        sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:], strict=False)),
        float(own.startswith("0")),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in ("'", '"')),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(before[-1:] == "+" or before[-2:-1] == "+"),
        sum(c.isdigit() for c in near) / (len(near) + 1),
        *[float(bool(h.search(before))) for h in HINTS],
        float(kind in NAMES and bool(NAMES[kind].search(before))),
        float(bool(OTHERWISE.search(before))),
    ]


class Cover:
    """Which places base spans take: by start, with the largest end so far."""

    def __init__(self, base: list[Span]):
        found = sorted((start, end) for _, start, end in base)
        self.starts = [start for start, _ in found]
        self.ends = list(accumulate((end for _, end in found), max))

    def reach(self, place: int) -> int:
        """The largest end of the spans that start at or before a place."""
        at = bisect_right(self.starts, place)
        return self.ends[at - 1] if at else -1


def weak_label(text: str, span: Span, cover: Cover) -> int:
    """1 personal, 0 not, -1 unknown."""
    kind, start, end = span
    if cover.reach(start) >= end:
        return 1
    if kind == "secret" and NAMED.search(text[max(0, start - 32) : start]):
        return 1
    if cover.reach(end - 1) > start:
        return -1
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 2]
    if kind == "secret":  # its check is the name; bare numbers are judged as such
        return -1 if own.isdigit() else 0
    if before[-1:].isalnum() or after[:1].isalnum() or own_check(kind, own) == 0:
        return 0
    named = kind in NAMES and bool(NAMES[kind].search(before))
    if kind in ("ipv6", "spelled_email") or named or kind == "account" and "-" not in own:
        return 1
    if kind in ("local_phone", "long_number") and OTHERWISE.search(before):
        return 0
    if kind == "local_phone" and (re.search(r"[0-9]\.$", before) or re.match(r"\.[0-9]", after)):
        return 0
    # a long number whose card check fails is no card, but may be another personal number
    return -1


def planted() -> Iterator[str]:
    """Short texts with examples of every wider kind, personal ones and others; always the same."""
    r = random.Random(SEED)

    def some(of: str, n: int) -> str:
        return "".join(r.choice(of) for _ in range(n))

    def word() -> str:
        return some("abcdefghijklmnopqrstuvwxyz", r.randint(2, 9))

    ten, hexa, upper = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for _ in range(PLANTED):
        phone = r.choice(["({}) {}-{}", "{} {} {}", "{}-{}-{}", "{}.{}.{}"]).format(some(ten, 3), some(ten, 3), some(ten, 4))
        number = some(ten, r.randint(6, 12))
        land, rest = some(upper, 2), some(ten, r.randint(11, 23))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        wrong = (check + r.randint(1, 90)) % 97
        social = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
        no_social = f"{r.choice(['000', '666', '9' + some(ten, 2)])}-{some(ten, 2)}-{some(ten, 4)}"
        groups = [some(hexa, r.randint(1, 4)) for _ in range(8)]
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
        key = some(hexa, 31) + r.choice(ten)
        for form in (
            f"{r.choice(['tel', 'Phone:', 'call me', 'fax', 'mobile'])} {phone}",
            f"{r.choice(['no', 'isbn', 'page', 'section'])} {phone}",
            f"{r.choice(['account', 'Konto', 'tel', 'phone:', 'card'])} {number}",
            f"{r.choice(['no', 'id', 'page', 'nr'])} {number}",
            f"{r.choice(['iban', '', '', 'account:'])} {land}{check:02d}{rest}",
            f"{r.choice(['iban', '', '', 'code'])} {land}{wrong:02d}{rest}",
            f"{r.choice(['ssn', 'social security', 'SSN:'])} {social}",
            f"{r.choice(['', 'ssn', 'part'])} {no_social}",
            f"{r.choice(['', 'ip', 'host', 'server'])} {':'.join(groups)}",
            f"{r.choice(['', 'at', 'time', 'device'])} {':'.join(groups[: r.randint(5, 7)])}",
            f"{r.choice(['', 'mail', 'contact', 'write to'])} {word()}{at}{word()}{dot}{r.choice(['com', 'org', 'de', 'example'])}",
            f"{word()}{at}{word()}{dot}{some(ten, 2)}",
            f'{r.choice(["token", "secret", "api_key", "password"])} = "{key}"',
            key,
        ):
            yield f"{word()} {word()} {form} {word()} {word()}"


@dataclass
class Boosted:
    """Trees of equal depth over binned features; nodes in heap order."""

    edges: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    base: float
    threshold: float = 2.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        binned = bin_columns(x, self.edges)
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > split[node])
            z += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def bin_columns(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned, rows = bin_columns(x, edges), np.arange(len(x))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, split = np.zeros((ROUNDS, inner), np.int64), np.full((ROUNDS, inner), BINS)
    leaf = np.zeros((ROUNDS, leaves))
    z = np.full(len(x), np.log(rate / (1 - rate)))
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        grad, curve = y - p, p * (1 - p) + 1e-6
        node = np.zeros(len(x), dtype=np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-3
            for j in range(x.shape[1]) if len(own) > 1 else ():
                g = np.bincount(binned[own, j], grad[own], BINS + 1).cumsum()
                h = np.bincount(binned[own, j], curve[own], BINS + 1).cumsum()
                left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
                gain = left + right - g[-1] ** 2 / (h[-1] + 1)
                if gain.max() > best:
                    best, feature[t, k], split[t, k] = gain.max(), j, int(gain.argmax())
            node[own] = 2 * k + 1 + (binned[own, feature[t, k]] > split[t, k])
        place = node - inner
        leaf[t] = RATE * np.bincount(place, grad, leaves) / (np.bincount(place, curve, leaves) + 1)
        z = z + leaf[t][place[rows]]
    return Boosted(edges, feature, split, leaf, float(np.log(rate / (1 - rate))))


def learn(x: np.ndarray, y: np.ndarray) -> Boosted | None:
    if len(set(y.tolist())) < 2 or len(y) < 40:
        return None
    order = np.random.default_rng(SEED).permutation(len(y))
    check, train = order[: len(y) // 4], order[len(y) // 4 :]
    if len(set(y[train].tolist())) < 2:
        return None
    trees = boost(x[train], y[train])
    score = trees.scores(x[check])
    down = np.argsort(-score, kind="stable")
    right = np.cumsum(y[check][down]) / np.arange(1, len(down) + 1)
    good = np.flatnonzero(right >= PRECISION)
    trees.threshold = max(0.5, float(score[down[good[-1]]])) if len(good) else 2.0
    return trees


def examples(text: str) -> Iterator[tuple[list[float], int]]:
    """Features and label of each proposal whose label is known."""
    cover = Cover(base_spans(text))
    for span in proposals(text):
        if (label := weak_label(text, span, cover)) >= 0:
            yield describe(text, span), label


def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [x for text in part.column("text").to_pylist() for x in examples(text or "")]
        rows, labels = [x for x, _ in found], [y for _, y in found]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], ["x", "y"])


def train(docs: DataFrame) -> Boosted | None:
    order = F.xxhash64(F.lit(5), "doc_id")
    ids = docs.where(F.col("text").rlike(MAY_HOLD)).select("doc_id").dropDuplicates().orderBy(order, "doc_id").limit(SAMPLE_DOCS)
    # at most SAMPLE_DOCS ids
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = some.mapInArrow(sample_rows, "x array<double>, y int").orderBy(F.xxhash64("x")).limit(SAMPLE_SPANS).toArrow()
    own = [x for text in planted() for x in examples(text)]
    rows = found.column("x").to_pylist() + [x for x, _ in own]
    return learn(np.array(rows), np.array(found.column("y").to_pylist() + [y for _, y in own], dtype=np.int64))


def select(text: str, base: list[Span], trees: Boosted | None) -> list[Span]:
    """Proposals above the threshold that overlap neither base spans nor better ones."""
    found = proposals(text) if trees else []
    if not found:
        return []
    score = trees.scores(np.array([describe(text, s) for s in found]))
    taken = np.zeros(len(text), dtype=bool)
    for _, start, end in base:
        taken[start:end] = True
    chosen = []
    for i in sorted(range(len(found)), key=lambda i: (-score[i], found[i][1] - found[i][2], found[i][1])):
        _, start, end = found[i]
        if score[i] >= trees.threshold and not taken[start:end].any():
            chosen.append(found[i])
            taken[start:end] = True
    return sorted(chosen, key=lambda s: (KINDS.index(s[0]), s[1]))


HEXADECIMAL = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdefABCDEF"])


def spans_of(column: pa.Array, trees: Boosted | None) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Text, base spans and chosen spans of each row; texts without anything of ``MAY_HOLD`` are not searched."""
    data, bounds = text_bytes(column)
    found = ((data >= 48) & (data <= 57)) | (data == ord("@"))
    # what is found across two rows is searched in vain
    at = np.flatnonzero((data == ord("(")) | (data == ord("[")))
    at = at[at + 3 < len(data)]
    found[at] |= (data[at + 1] == ord("a")) & (data[at + 2] == ord("t")) & ((data[at + 3] == ord(")")) | (data[at + 3] == ord("]")))
    at = np.flatnonzero(data == ord(":"))
    at = at[(at > 0) & (at + 1 < len(data))]
    found[at] |= HEXADECIMAL[data[at - 1]] & HEXADECIMAL[data[at + 1]]
    mark = np.concatenate([[0], np.cumsum(found)])
    may = mark[bounds[1:]] > mark[bounds[:-1]]
    for text, look in zip(column.to_pylist(), may.tolist(), strict=True):
        base = base_spans(text) if look else []
        yield text or "", base, select(text, base, trees) if look else []


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest_rows(trees: Boosted | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, shas, spans, more = [], [], [], []
            for _, base, chosen in spans_of(part.column("text"), trees):
                counts.append([sum(s[0] == kind for s in base) for kind in BASE_KINDS])
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + chosen))
                more.append(len(chosen))
            columns = list(zip(*counts, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_added"],
            )

    return rows


DIGEST = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_added long"


def find_personal(docs: DataFrame, trees: Boosted | None) -> DataFrame:
    """Counts and spans of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(digest_rows(trees), DIGEST)


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_rows(trees: Boosted | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            old = part.column("text").to_pylist()
            new = [
                None if text is None else redacted(full, base + chosen) if base or chosen else text
                for text, (full, base, chosen) in zip(old, spans_of(part.column("text"), trees), strict=True)
            ]
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field("text"), pa.array(new, part.schema.field("text").type))

    return rows


def redact(docs: DataFrame, trees: Boosted | None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; all columns stay."""
    return docs.mapInArrow(redact_rows(trees), docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = documents(spark, sf_dir)
    return find_personal(docs, train(docs))
