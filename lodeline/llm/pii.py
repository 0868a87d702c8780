"""Personal data: base patterns, and further spans by candidate gradient boosting.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. High-recall generators then propose
further, overlapping spans that the patterns miss: telephone numbers without "+", spelled-out e-mail addresses,
IPv6 addresses, card numbers in other groupings, and kinds without a pattern: account numbers (IBAN) and national numbers. Boosted trees score each from its format and its context, a
threshold for each kind (set on held-back rows for a precision of PRECISION) selects, and of overlapping
candidates the best stays.

The trees are trained here. No table labels spans, so their rows are TRAINING_SPANS made-up spans, personal or not, put
into passages of the corpus, and candidates that the base patterns confirm in the corpus itself. Both come from a bounded
sample by hash: PASSAGES passages anywhere, and PASSAGES around the first sign of a span. Every document is searched.

Offsets are code points, ends exclusive. Every regular expression runs in linear time on any text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.plans.shared import bound_batches

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that no base pattern knows, after them: account numbers (IBAN), and national numbers (of nine digits in groups, or of eight with a letter).
FURTHER = ("iban", "national")
ALL_KINDS = (*KINDS, *FURTHER)
TRAINING_SPANS = 8000
#: Passages of each kind that the driver receives, and their code points.
PASSAGES, PASSAGE = 1500, 160
PRECISION = 0.995
TREES, DEPTH, RATE, BINS = 80, 3, 0.2, 16
#: Code points of context on either side of a candidate.
CONTEXT = 40
#: Candidates of a text that are scored at once.
SCORED_AT_ONCE = 4096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search


def luhn(digits: str) -> bool:
    doubled = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@ and a dotted domain, found from each @, without rescanning runs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def valid_iban(span: str) -> bool:
    """Whether the check digits of an account number hold."""
    plain = span.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def valid_national(span: str) -> bool:
    """Nine digits in the ranges that are given out, or eight digits and their letter."""
    if span[-1:].isalpha():
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(_digits(span)) % 23] == span[-1]
    area, group, serial = (int(x) for x in span.split("-"))
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the fixed patterns by kind, in order."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    spans["email"] = list(_emails(text))
    if _DIGIT(text):
        spans["ip"] = [m.span() for m in _IP(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                spans["card"].append(m.span())
        spans["phone"] = [m.span() for m in _PHONE(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


#: High-recall generators: kind, pattern. Each starts at a rare character or is anchored to a token's start.
GENERATORS = (
    ("phone", re.compile(r"(?<![\w.+-])(?:00|\(?0|\()?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![\w-])")),
    ("phone", re.compile(r"(?<![0-9])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("card", re.compile(r"(?<![\w.])[0-9]{4}(?:[._/ -]{1,2}[0-9]{4}){2}[._/ -]{1,2}[0-9]{1,7}(?![\w])")),
    ("ip", re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")),
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?[(\[{] ?(?:at|AT|@) ?[)\]}] ?[\w-]{1,64}+(?: ?(?:\.|[(\[{] ?(?:dot|DOT|\.) ?[)\]}]) ?[\w-]{1,64}+){1,4}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII)),
    ("national", re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[TRWAGMYFPDXBNJZSQVHLCKE])(?![\w-])")),
)
#: Words that speak for a kind, and against any.
HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "ipv6", "host", "server", "address", "ping"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "whatsapp"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "transfer"),
    "national": ("ssn", "social", "security", "dni", "nif", "identity", "passport", "ausweis"),
}
AGAINST = ("order", "invoice", "isbn", "issn", "version", "date", "page", "total", "sku", "serial", "doi", "ref", "time", "score", "id")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    separators = re.sub(r"[0-9A-Za-z]", "", span)
    words = set(re.findall(r"\w+", f"{before} {after}".lower()))
    near = re.findall(r"\w+", before.lower())[-2:]
    year = any(1900 <= int(g) <= 2100 for g in groups if len(g) == 4)
    return [
        *(float(kind == k) for k in ALL_KINDS), float(kind == "iban" and valid_iban(span)), float(kind == "national" and valid_national(span)),
        len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float(len(groups[-1]) if groups else 0),
        len(separators), len(set(separators)), float(span.startswith("(") or span.startswith("00")), float(13 <= len(digits) <= 19 and luhn(digits)),
        float(year), float("." in span), float("/" in span), float(":" in span), span.count(":"), sum(c.isalpha() for c in span),
        float(any(w in HINTS[kind] for w in words)), float(any(w in HINTS[kind] for w in near)), float(any(w in AGAINST for w in near)), float(any(w in AGAINST for w in words)),
        float(before[-1:].isalnum() or after[:1].isalnum()), sum(c.isdigit() for c in before + after), float(before[-1:] in "=#$€£" and before != ""),
    ]


class Boosted:
    """Gradient-boosted trees of logistic loss over binned features."""

    def __init__(self, edges: list[np.ndarray], trees: list, bias: float):
        self.edges, self.trees, self.bias = edges, trees, bias

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _walk(tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        j, cut, low, high = tree
        left = b[:, j] <= cut
        out = np.empty(len(b))
        out[left], out[~left] = Boosted._walk(low, b[left]), Boosted._walk(high, b[~left])
        return out

    @staticmethod
    def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = -g.sum() / (h.sum() + 1.0)
        if depth == 0 or len(g) < 20:
            return RATE * value
        best, split = g.sum() ** 2 / (h.sum() + 1.0) + 1e-3, None
        for j in range(b.shape[1]):
            gs, hs = np.bincount(b[:, j], g, BINS + 1).cumsum(), np.bincount(b[:, j], h, BINS + 1).cumsum()
            gain = gs**2 / (hs + 1.0) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1.0)
            gain[(hs < 1e-3) | (hs[-1] - hs < 1e-3)] = -1
            if gain.max() > best:
                best, split = gain.max(), (j, int(gain.argmax()))
        if split is None:
            return RATE * value
        left = b[:, split[0]] <= split[1]
        return (*split, Boosted._grow(b[left], g[left], h[left], depth - 1), Boosted._grow(b[~left], g[~left], h[~left], depth - 1))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        model = cls(edges, [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
        b, score = model._binned(x), np.full(len(y), model.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = cls._grow(b, p - y, p * (1 - p), DEPTH)
            model.trees.append(tree)
            score += cls._walk(tree, b)
        return model

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return 1 / (1 + np.exp(-(self.bias + sum(self._walk(t, b) for t in self.trees))))


def _iban(rng: random.Random, valid: bool) -> str:
    """An account number in groups of four or in one piece, with check digits that hold or do not."""
    country, own = rng.choice(("DE", "FR", "ES", "GB", "NL")), "".join(rng.choices("0123456789", k=rng.choice((14, 18, 20))))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{own}{country}00")) % 97
    plain = f"{country}{check if valid else (check + rng.randint(1, 90)) % 97 + 1:02d}{own}"
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if rng.random() < 0.6 else plain


def _synthetic(rng: random.Random, passages: tuple[str, ...] = ()) -> tuple[str, str, int, int, int]:
    """A text, and a candidate in it: kind, start, end, whether it is personal data; in one of ``passages``, if any."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü", k=rng.randint(2, 9)))
    kind, real = rng.choice(ALL_KINDS), rng.random() < 0.5
    hex4 = lambda: "".join(rng.choices("0123456789abcdef", k=4))
    if kind == "phone" and not real and rng.random() < 0.2:  # digits of an account number
        account = _iban(rng, True)
        first = re.search(r"[0-9]{4}(?: [0-9]{4})+", account[5:] + " 0000 0000")
        text = f"{rng.choice(HINTS['iban'])} {account} {word()}"
        at = text.index(account) + 5
        size = len(first[0]) if first and first.start() == 0 else 9
        return text, kind, at, min(at + size, len(text)), 0
    if kind == "iban":
        span = _iban(rng, real)
    elif kind == "national":
        number = d(8)
        span = (f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if rng.random() < 0.6 else number + "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23]) if real else rng.choice(
            [f"9{d(2)}-{d(2)}-{d(4)}", f"000-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", number + "TRWAGMYFPDXBNJZSQVHLCKE"[(int(number) + 5) % 23]])
    elif kind == "phone":
        span = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(4)} {d(3)}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(3)}/{d(6)}", f"{d(3)} {d(3)} {d(4)}"]) if real else rng.choice(
            [f"{rng.randint(1900, 2099)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{rng.randint(1900, 2099)}", d(rng.randint(7, 14)), f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(rng.randint(1, 3))}.{d(rng.randint(4, 12))}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}", f"{rng.randint(1900, 2099)}-{rng.randint(1900, 2099)}"])
    elif kind == "card":
        digits = d(15)
        digits += next(c for c in "0123456789" if luhn(digits + c) == real)
        joint = rng.choice([".", "_", "/", "  ", " - "])
        span = joint.join(digits[i : i + 4] for i in range(0, 16, 4))
    elif kind == "ip":
        span = ":".join(hex4() for _ in range(8)) if real else rng.choice([f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}", ":".join(hex4()[:2] for _ in range(6)), f"{d(2)}::{d(2)}"])
    else:
        mark = rng.choice(["(at)", "[at]", "{at}", "(@)"])
        tail = rng.choice([".com", " [dot] org", "(dot)net", ".de"])
        span = f"{word()}.{word()} {mark} {word()}{tail}" if real else f"{word()} {mark} {d(2)}.{d(2)}"
    hint = rng.choice(HINTS[kind]) if real and rng.random() < 0.5 else rng.choice(AGAINST) if not real and rng.random() < 0.5 else word()
    passage = rng.choice(passages).split(" ") if passages else [word() for _ in range(rng.randint(0, 10))]
    cut = rng.randint(0, len(passage))
    before = f"{' '.join([*passage[:cut], hint])}{rng.choice([' ', ': ', ' '])}"
    text = f"{before}{span}{rng.choice([' ', '. ', ', '])}{' '.join(passage[cut:])}"
    return text, kind, len(before), len(before) + len(span), int(real)


def _confirmed(passage: str) -> Iterator[tuple[str, str, int, int, int]]:
    """Candidates of a passage that a base span of their kind covers in part."""
    base = base_spans(passage)
    for kind, pattern in GENERATORS:
        for m in pattern.finditer(passage) if kind in base and _worth(kind, passage) else ():
            if _overlaps(_merged(base[kind]), *m.span()):
                yield passage, kind, *m.span(), 1


def passages_of(docs: DataFrame, most: int = PASSAGES) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Passages of a sample of the documents, by hash: anywhere in the text, and around the first sign of a span."""
    text, draw = F.col("text"), F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    sign = F.regexp_instr(text, F.lit(r"@|\+[0-9]|[0-9][0-9.-]{6}"))
    anywhere = (draw % F.greatest(F.length(text) - PASSAGE, F.lit(1)) + 1).cast("int")
    sizes = docs.agg(F.count("text"), F.count_if(sign > 0)).first()
    found = []
    for start, rows, n in ((anywhere, docs, sizes[0]), (F.greatest(sign - PASSAGE // 2, F.lit(1)), docs.where(sign > 0), sizes[1])):
        near = rows.where(text.isNotNull() & (draw <= F.lit(2.0 * most * (1 << 40) / max(1, n))))  # about twice as many as are taken
        taken = near.select(draw.alias("draw"), F.expr("text").substr(start, F.lit(PASSAGE)).alias("passage")).orderBy("draw", "passage").limit(most)
        found.append(tuple(r["passage"] for r in taken.collect()))
    return found[0], found[1]


@lru_cache(maxsize=4)
def trained(passages: tuple[str, ...] = (), marked: tuple[str, ...] = (), spans: int = TRAINING_SPANS, seed: int = 11) -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the least score at which held-back spans reach PRECISION."""
    model, thresholds, _ = trained_and_judged(passages, marked, spans, seed)
    return model, thresholds


def trained_and_judged(passages: tuple[str, ...] = (), marked: tuple[str, ...] = (), spans: int = TRAINING_SPANS, seed: int = 11) -> tuple[Boosted, dict[str, float], dict[str, tuple[float, float]]]:
    """``trained``, and by kind the precision and recall on held-back rows that neither fitted trees nor set thresholds."""
    rng = random.Random(seed)
    rows = [_synthetic(rng, passages) for _ in range(spans)] + [x for passage in marked for x in _confirmed(passage)]
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows], float)
    y = np.array([r[4] for r in rows], float)
    kinds = np.array([r[1] for r in rows])
    part = np.arange(len(rows)) % 8  # of eight parts, five fit, two set thresholds, one judges
    model = Boosted.fit(x[part < 5], y[part < 5])
    thresholds, judged = {}, {}
    for kind in ALL_KINDS:
        own = (kinds == kind) & (part >= 5) & (part < 7)
        p, truth = model.probability(x[own]), y[own]
        order = np.argsort(-p)
        precise = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
        thresholds[kind] = max(0.8, float(p[order][precise][-1])) if precise.any() else 1.1
        last = (kinds == kind) & (part == 7)
        chosen = model.probability(x[last]) >= thresholds[kind]
        judged[kind] = float(y[last][chosen].mean()) if chosen.any() else 1.0, float(chosen[y[last] == 1].mean()) if (y[last] == 1).any() else 0.0
    return model, thresholds, judged


def further_spans(text: str, base: dict[str, list[tuple[int, int]]], model: Boosted, thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """Selected candidates that touch no base span and no better candidate."""
    proposed = {(kind, *m.span()) for kind, pattern in GENERATORS if _worth(kind, text) for m in pattern.finditer(text)}
    if not proposed:
        return []
    taken = _merged(s for spans in base.values() for s in spans)
    free = sorted(c for c in proposed if not _overlaps(taken, c[1], c[2]))
    scores: list[float] = []
    for at in range(0, len(free), SCORED_AT_ONCE):
        scores += model.probability(np.array([features(text, *c) for c in free[at : at + SCORED_AT_ONCE]], float)).tolist()
    chosen: list[tuple[str, int, int]] = []
    held: list[tuple[int, int]] = []
    for score, candidate in sorted(zip(scores, free, strict=True), key=lambda x: (-x[0], x[1])):
        kind, start, end = candidate
        if score >= thresholds[kind] and not _overlaps(held, start, end):
            chosen.append(candidate)
            insort(held, (start, end))
    return chosen


def _merged(spans) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps any of the ordered, disjoint ones."""
    at = bisect_left(taken, (end,))
    return at > 0 and taken[at - 1][1] > start


_MARKED_AT = re.compile(r"[(\[{] ?(?:at|AT|@) ?[)\]}]").search


def _worth(kind: str, text: str) -> bool:
    """Whether a generator can find anything."""
    return bool(_MARKED_AT(text)) if kind == "email" else ":" in text if kind == "ip" else bool(_DIGIT(text))


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])))


def all_spans(text: str, model: Boosted, thresholds: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    kept = [(kind, a, b) for kind in KINDS for a, b in base[kind]]
    return base, kept + further_spans(text, base, model, thresholds)


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each maximal run of overlapping spans becomes the upper-case name, in brackets, of the kind that begins it."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans for every row.

    Nulls and empty texts have no spans; repeated rows are searched alike; an empty table gives an empty result (the trees
    then learn from made-up passages); very long texts are searched whole; further columns are not read.
    """
    bound_batches(docs.sparkSession)
    model, thresholds = trained(*passages_of(docs))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                base, spans = all_spans(text or "", model, thresholds)
                own = listed([(k, a, b) for k in KINDS for a, b in base[k]])
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(own.encode()).hexdigest(), listed(spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), search("text").alias("x"))
    return found.select("doc_id", "x.*")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all spans of ``text`` replaced and ``n_chars``, if present, counted anew."""
    bound_batches(docs.sparkSession)
    model, thresholds = trained(*passages_of(docs))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else redacted_text(t, all_spans(t, model, thresholds)[1]))

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_pii": op4_pii}
#: No SQL: candidates are scored by a model; tests compare base spans with the plain patterns.
ORACLE: dict[str, str] = {}
