"""Personal data by weak supervision.

Base spans come from fixed patterns with checks and always stay. Besides them, wide patterns propose candidates; a
shape labeler, a checksum labeler, a gazetteer labeler and a context labeler vote on each (+1, -1, or 0 for none).
Expectation-maximisation over the vote patterns of the whole corpus estimates how reliable each labeler is, and the
soft labels that it gives train the final span classifier, a logistic regression that sees, besides the votes, what
the labelers don't look at alone: the span's length, its share of digits and its alphabet, the sign before it and how
far off a cue word is. Candidates it accepts are added.

Both passes are maps over whole texts. What is gathered between them are counts of (kind, votes, features), at most
some thousand rows whatever the corpus, since each part has few values; so nothing grows with the input.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; an added span never overlaps
a base span or an earlier added one; all scans are linear in the text and spans are looked up by bisection, so very
long texts and texts with many matches are safe. Repeated rows
get equal results; without candidates anywhere nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]+@", re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT, _AT_HERE = re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL), re.compile(_LOCAL)
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")

#: What the wide patterns propose. Order counts: an earlier kind wins an overlap.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{20,}={0,2}(?![A-Za-z0-9_/+-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{3,4}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"),
}
KINDS = tuple(WIDE)
#: Cue words of each kind in the languages of the corpus, looked up in the 40 characters before a candidate.
CUES = {
    "email": ("mail", "correo", "courriel", "contact", "kontakt", "contacto"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "key", "secret", "password", "passwort", "clave", "apikey", "api_key", "bearer"),
    "national_id": ("ssn", "social", "security", "id", "ausweis", "dni", "insee"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "telefono", "fax", "cell"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"),
}
#: Words before a number that speak against personal data.
AGAINST = ("version", "order", "page", "isbn", "build", "figure", "table", "sha", "commit", "row", "line", "no", "art")
_WORD = re.compile(r"[a-z_]+")
#: The votes, then how many values each feature of a span and its context has.
VOTES = 4
SHAPES = {"length": 4, "digits": 4, "alphabet": 4, "before": 4, "cue": 3}
FEATURES = VOTES + len(KINDS) * (1 + SHAPES["length"]) + sum(list(SHAPES.values())[1:]) + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, at, follows = [], 0, False
    while True:
        m = (_AT_HERE.match(text, at) if follows else None) or _AT.search(text, at)
        if not m:
            return out
        host = _HOST.match(text, m.end())
        at, follows = (host.end(), True) if host else (m.end(), False)
        if host:
            out.append((m.start(), at))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order; kind is an index into BASE."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the wide patterns propose beside the base spans; kind is an index into KINDS."""
    starts, ends = [], []  # of the text that is taken, without overlaps
    for a, _, b in base:
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for k, kind in enumerate(KINDS):
        for m in WIDE[kind].finditer(text):
            a, b = m.span()
            i = bisect_right(ends, a)  # the first taken stretch that ends behind a
            if i == len(starts) or starts[i] >= b:
                starts.insert(i, a)
                ends.insert(i, b)
                out.append((a, k, b))
    return sorted(out)


def votes(text: str, a: int, k: int, b: int) -> tuple[int, ...]:
    """The four labelers' votes on a candidate, then its features in the order of SHAPES."""
    kind, span = KINDS[k], text[a:b]
    before = _WORD.findall(text[max(0, a - 40) : a].lower())
    digits = _digits(span)
    if kind == "card":
        shape = 1 if len(digits) in (15, 16) else 0
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        flat = span.replace(" ", "")
        shape = 1 if 15 <= len(flat) <= 34 else -1
        check = 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    elif kind == "secret":
        shape = 1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9_/+-]{32,}={0,2}", span) else -1
        check = 1 if len(set(span)) >= 10 and 0.1 <= len(digits) / len(span) <= 0.9 else -1
    elif kind == "national_id":
        shape = 1
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "phone":
        shape = 1 if 9 <= len(digits) <= 12 else -1
        check = -1 if len(set(digits)) < 4 else 0
    else:
        shape = 1
        check = 1 if re.search(r"(com|org|net|edu|gov|de|fr|es|io|info)$", span) else -1
    gazetteer = 1 if set(before[-5:]) & set(CUES[kind]) else (-1 if set(before[-3:]) & set(AGAINST) else 0)
    left, right = text[a - 1 : a], text[b : b + 1]
    glued = bool(left and (left.isalnum() or left in "#_/\\")) or bool(right and (right.isalnum() or right in "_/\\"))
    lead = text[max(0, a - 3) : a].rstrip(" \"'")[-1:]
    context = -1 if glued or (len(before) and before[-1] in AGAINST) else (1 if lead in (":", "=") and lead else 0)
    alphabet = (any("A" <= c <= "Z" for c in span)) + 2 * any("a" <= c <= "z" for c in span)
    sign = 0 if not lead or lead.isalnum() else 1 if lead in ":=" else 2 if lead in ",;.(" else 3
    cue = next((2 if i < 2 else 1 for i, w in enumerate(reversed(before)) if w in CUES[kind]), 0)
    return shape, check, gazetteer, context, min(3, len(span) // 12), min(3, 4 * len(digits) // len(span)), alphabet, sign, cue


def expectation_maximisation(rows: list[tuple[int, tuple[int, ...], float]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class-conditional vote distributions of the labelers from (kind, votes, count); also the prior of each kind and
    the probability of personal data for each row. Smoothing favours labelers that are right more often than not."""
    kinds = np.array([r[0] for r in rows])
    vote = np.array([r[1] for r in rows], int).reshape(len(rows), -1) + 1
    n = np.array([r[2] for r in rows], float)
    m = vote.shape[1]
    lean = np.array([[4.0, 3.0, 2.0], [2.0, 3.0, 4.0]])  # pseudo-counts of votes -1, 0, +1 for either class
    prior, p = np.full(len(KINDS), 0.5), np.clip(0.5 + (vote - 1).sum(1) * 0.2, 0.05, 0.95)
    table = np.tile(lean / lean.sum(1, keepdims=True), (m, 1, 1))
    for _ in range(rounds):
        for j in range(m):
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                got = lean[c] * 0.01 * max(1.0, n.sum()) ** 0.5 + np.bincount(vote[:, j], weights=w, minlength=3)
                table[j, c] = got / got.sum()
        prior = (np.bincount(kinds, weights=n * p, minlength=len(KINDS)) + 1) / (np.bincount(kinds, weights=n, minlength=len(KINDS)) + 2)
        log = [np.log(np.where(c, prior, 1 - prior))[kinds] + sum(np.log(table[j, c])[vote[:, j]] for j in range(m)) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return table, prior, p


def vector(k: int, seen: tuple[int, ...]) -> np.ndarray:
    """The classifier's input: the votes, the kind, the length within the kind, the other features, and 1."""
    x = np.zeros(FEATURES)
    x[:VOTES] = seen[:VOTES]
    x[VOTES + k] = 1
    at = VOTES + len(KINDS)
    x[at + k * SHAPES["length"] + seen[VOTES]] = 1
    at += len(KINDS) * SHAPES["length"]
    for value, size in zip(seen[VOTES + 1 :], list(SHAPES.values())[1:], strict=True):
        x[at + value] = 1
        at += size
    x[-1] = 1
    return x


def train(rows: list[tuple[int, tuple[int, ...], float]], rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier, from (kind, votes and features, count) over the corpus."""
    if not rows:
        return np.r_[np.zeros(FEATURES - 1), -10.0]
    _, _, soft = expectation_maximisation([(k, v[:VOTES], n) for k, v, n in rows])
    x, n = np.array([vector(k, v) for k, v, _ in rows]), np.array([r[2] for r in rows], float)
    w = np.zeros(FEATURES)
    for _ in range(rounds):  # Newton steps of a ridge logistic regression on soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - soft)) + ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES)
        w -= np.linalg.solve(hess, grad)
    return w


SEEN = [f"v{i}" for i in range(VOTES)] + list(SHAPES)


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, votes, features and their count over all documents (a bounded number of rows)."""

    def run(batches):
        for pdf in batches:
            seen: Counter = Counter()
            for x in pdf["_text"]:
                if isinstance(x, str) and _ANY.search(x):
                    seen.update((k, *votes(x, a, k, b)) for a, k, b in candidates(x, base_spans(x)))
            yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=["kind", *SEEN, "n"])

    kinds = ", ".join(f"{c} int" for c in ("kind", *SEEN))
    return docs.select(docs[text].alias("_text")).mapInPandas(run, f"{kinds}, n long").groupBy("kind", *SEEN).agg(F.sum("n").alias("n"))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Per document: base spans and all spans as arrays of (kind, start, end), ordered."""
    rows = sorted((r.kind, tuple(r[c] for c in SEEN), r.n) for r in vote_counts(docs, text).collect())
    weights = train(rows)
    rank = {k: i for i, k in enumerate((*BASE, *(k for k in KINDS if k not in BASE)))}

    def run(batches):
        for pdf in batches:
            base_all, all_all = [], []
            for x in pdf["_text"]:
                base, more = [], []
                if isinstance(x, str) and _ANY.search(x):
                    found = base_spans(x)
                    base = [{"kind": BASE[k], "start": a, "end": b} for a, k, b in found]
                    for a, k, b in candidates(x, found):
                        if vector(k, votes(x, a, k, b)) @ weights > np.log(threshold / (1 - threshold)):
                            more.append({"kind": KINDS[k], "start": a, "end": b})
                base_all.append(base)
                all_all.append(sorted(base + more, key=lambda s: (s["start"], rank[s["kind"]])))
            yield pd.DataFrame({key: pdf[key], "base": base_all, "spans": all_all})

    kind = docs.schema[key].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(key, docs[text].alias("_text")).mapInPandas(run, f"{key} {kind}, base {span}, spans {span}")


def joined(spans: str):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of spans that are in order (used by tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
