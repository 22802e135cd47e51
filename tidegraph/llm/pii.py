"""Personal data by a skip-chain conditional random field.

Candidates are the matches of the base patterns (whose label is fixed) and weaker look-alikes:
runs with seven or more digits (longer ones than a card cut at their separators into numbers of up to
``LONGEST`` digits) and words with an at sign that the patterns pass over. Neighbours
in a document form the chain; candidates that repeat or resemble each other (``keys``: all digits,
the last seven, the e-mail name or address) are linked across any distance, each to the one before it, and
share a consistency potential. Loopy sum-product over that graph lets "+44 20 7946 0958" at the top
label a bare "020 7946 0958" pages later, and a card number that stands by itself label its repeat that
runs into another number. Look-alikes that end up with a probability over one half are added to the base spans.

Unary potentials and link strengths are fitted on the documents themselves by pseudo-likelihood: each base span is hidden in turn, written in each
of some weaker forms (``forms``: without its plus sign or separators; a short one where the document has the value in full elsewhere too), and is to be
told from its features and the kinds of what it is linked to; look-alikes count as no personal data. The prior, which decides where a corpus shows little, is a
softmax regression on generated numbers and addresses, with strengths by which one clamped repeat outweighs the doubt of
the unary model and a mere resemblance does only where the number could well be of that kind. The fit takes up to
``FIT_CANDIDATES`` candidates of about ``FIT_DOCS`` documents, both chosen by a hash; it is the same however the table is cut. Detection goes over every whole text. Work is
linear in the text but for the sorting of candidates: each pattern is scanned once, and links grow with candidates, not with their pairs.

Defined cases. A null text is empty: no spans, the digest of the empty string. Repeated rows are done
each. Spans of one kind do not overlap; spans of different kinds may. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import pieces, with_results

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Everything the three number patterns can match lies inside one of these.
ZONE = re.compile(r"[+0-9][0-9 ().+-]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WEAK = re.compile(r"\+?[0-9(](?:[ ().-]{0,2}[0-9])+")
GROUP = re.compile(r"[0-9]+")
DIGIT = re.compile(r"[^0-9]+")
WORD_END = re.compile(r"[\s@]")
SOME = re.compile(r"[0-9@]")
CUES = (("tel", "phone", "call", "fax", "mobile"), ("card", "visa", "credit"), ("ip", "host", "server", "address"), ("mail", "contact", "write"))
#: Kinds of links, and the prior strength of each.
REPEAT, COUPLING, CHAIN = range(3)
STRENGTHS = (6.0, 2.2, 0.15)
#: The clamp of base spans; message sweeps; how near neighbours of the chain are.
CLAMP, SWEEPS, NEAR = 12.0, 15, 80
LONGEST = 19
#: Bounds of the sample that is fitted on, and the prior's precision.
FIT_DOCS, FIT_CANDIDATES, TRUST = 100_000, 20_000, 0.3


class Potentials(NamedTuple):
    unary: np.ndarray  #: (features, labels)
    links: np.ndarray  #: a strength a kind of link


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the base patterns alone."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(p) < 4 and int(p or "0") <= 255 for p in (d.lstrip("0") for d in m[0].split("."))):
                found["ip"].append(m.span())
        for m in CARD.finditer(text, a, b):
            digits = DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in zone[0]:
            for m in PHONE.finditer(text, a, b):
                if 8 <= len(DIGIT.sub("", m[0])) <= 15:
                    found["phone"].append(m.span())
    return found


def numbers(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The run of digits and separators as it is, or, with over ``LONGEST`` digits, cut at separators into numbers.

    Groups of digits are put together from the left while at most 16 digits result.
    """
    groups = [m.span() for m in GROUP.finditer(text, a, b)]
    groups[0] = (a, groups[0][1])
    if len(groups) < 2 or sum(y - x for x, y in groups) <= LONGEST:
        return [(a, b)]
    out, total = [groups[0]], groups[0][1] - groups[0][0]
    for x, y in groups[1:]:
        total += y - x
        if total <= 16:
            out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
            total = y - x
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs without white space around each at sign, up to the next one; every character is looked at twice at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = WORD_END.search(text, at + 1)
        done = end.start() if end else len(text)
        if done - start > 2:
            out.append((start, done))
        at = text.find("@", done)
    return out


def weak_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Look-alikes outside every base span."""
    taken = sorted(s for spans in base.values() for s in spans)
    runs = (m.span() for zone in ZONE.finditer(text) if zone.end() - zone.start() >= 7 for m in WEAK.finditer(text, *zone.span()))
    out = [s for run in runs for s in numbers(text, *run) if sum(map(str.isdigit, text[slice(*s)])) >= 7]
    out += addresses(text)
    kept, k = [], 0
    for a, b in sorted(out):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not (k < len(taken) and taken[k][0] < b):
            kept.append((a, b))
    return kept


def features(text: str, a: int, b: int) -> list[float]:
    s, before = text[a:b], text[max(0, a - 24) : a].lower()
    digits = DIGIT.sub("", s)
    n = len(digits)
    quad = [p for p in s.split(".") if p.isdigit()]
    return [
        1.0, "@" in s, "@" in s and "." in s.partition("@")[2], len(s) > n + 2 and "@" in s, "+" in s or text[max(0, a - 1) : a] == "+", "(" in s,
        7 <= n <= 9, 9 < n <= 11, 11 < n <= 13, 13 < n < 16, 16 <= n <= 19, n > 19, 16 <= n <= 19 and luhn(digits),
        len(quad) == 4 and s.count(".") == 3, len(quad) == 4 and all(len(p) < 4 for p in quad), min(3, len(re.findall(r"[ .-]+", s))) / 3, n == len(s),
        *(any(c in before for c in group) for group in CUES), before[-1:].isalpha() or text[b : b + 1].isalpha(),
    ]


def generated(rows: int = 1500, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (0: none, then KINDS) of made-up candidates."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = num(15)
        full = next(d + c for c in "0123456789" if luhn(d + c))
        return r.choice((full, " ".join(full[i : i + 4] for i in range(0, 16, 4)), "-".join(full[i : i + 4] for i in range(0, 16, 4))))

    cue = lambda k: r.choice(CUES[k]) + r.choice((": ", " ")) if r.random() < 0.4 else "and "
    x, y = [], []
    for _ in range(rows):
        label = r.choice((0, 0, 0, 1, 2, 3, 4))
        if label == 1:
            before, s = cue(3), r.choice(("j.doe", "info", "kim22")) + "@" + r.choice(("mail", "host", "site")) + r.choice((".com", ".org", "", ".co.uk"))
        elif label == 2:
            before, s = cue(2), ".".join(str(r.randint(0, 255)) for _ in range(4))
        elif label == 3:
            before, s = cue(1), card()
        elif label == 4:
            before, s = cue(0), r.choice(("+", "", "")) + r.choice((num(11), f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(4)}", f"{num(2)} {num(4)} {num(4)}"))
        else:
            before, s = r.choice(("no. ", "token e5c", "and ", "isbn ", "in ", "id ")), r.choice((f"{num(4)}-{num(2)}-{num(2)}", num(8), num(13), num(24), num(16), f"{num(4)}.{num(3)}.{num(4)}.{num(3)}", f"{num(3)} {num(3)} {num(3)} {num(3)}", num(10), "@" + num(3), "x@", f"{num(4)} {num(4)}"))
        text = before + s
        x.append(features(text, len(before), len(text)))
        y.append(label)
    return np.array(x, float), np.array(y)


def prior(steps: int = 300, ridge: float = 1e-3) -> Potentials:
    """A softmax regression on generated candidates, and the prior strengths of links."""
    x, y = generated()
    w, hot = np.zeros((x.shape[1], 1 + len(KINDS))), np.eye(1 + len(KINDS))[y]
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 1.0 * (x.T @ (p - hot) / len(x) + ridge * w)
    return Potentials(w, np.array(STRENGTHS))


def keys(s: str) -> list[tuple[str, int]]:
    """What a candidate shares with those it is linked to, and the kind of link."""
    if "@" in s:
        name, _, host = s.lower().rstrip(".,;:!?").partition("@")
        return [(f"n{name}", COUPLING)] * bool(name) + [(f"h{name}@{host}", REPEAT)]
    digits = DIGIT.sub("", s)
    return [(f"d{digits[-7:]}", COUPLING), (f"w{digits}", REPEAT)] if len(digits) >= 7 else [(f"i{s}", REPEAT)]


def beliefs(unary: np.ndarray, edges: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product with Potts links (both ways of an edge at once, damped)."""
    n, labels = unary.shape
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    same = np.exp(np.concatenate([strength, strength]))[:, None]
    message = np.zeros((2 * m, labels))
    for _ in range(SWEEPS):
        total = unary.copy()
        np.add.at(total, b, message)
        out = total[a] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(out.sum(axis=1, keepdims=True) + (same - 1) * out)
        new -= new.mean(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    total = unary.copy()
    np.add.at(total, b, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(text: str, potentials: Potentials) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) of one text, by kind and start."""
    empty: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not SOME.search(text):
        return empty, empty
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak:
        return base, base
    nodes, unary, edges, strength = field(text, base, weak, potentials)
    p = beliefs(unary, edges, strength)
    every = {k: list(v) for k, v in base.items()}
    for (a, b, label), q in zip(nodes, p):
        if not label and q.argmax() and q.max() > 0.5:
            every[KINDS[q.argmax() - 1]].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def field(text: str, base: dict[str, list[tuple[int, int]]], weak: list[tuple[int, int]], potentials: Potentials, hidden: dict[tuple[int, int, int], str] | None = None):
    """The random field of a text: nodes (start, end, label or 0 if open), unary potentials, edges and their strengths.

    Nodes of ``hidden`` are open and written in the form given there.
    """
    nodes, hidden = listed(base, weak), hidden or {}
    forms = [hidden.get(node, text[node[0] : node[1]]) for node in nodes]
    unary = np.array([features(*rewritten(text, a, b, form)) for (a, b, _), form in zip(nodes, forms)]) @ potentials.unary
    nodes = [(a, b, 0 if (a, b, label) in hidden else label) for a, b, label in nodes]
    for i, (_, _, label) in enumerate(nodes):
        if label:
            unary[i] = 0
            unary[i, label] = CLAMP
    edges, kinds, last = [], [], {}
    for i, (a, _, _) in enumerate(nodes):
        if i and a - nodes[i - 1][1] < NEAR:
            edges.append((i - 1, i))
            kinds.append(CHAIN)
        for k, kind in keys(forms[i]):
            if k in last:
                edges.append((last[k], i))
                kinds.append(kind)
            last[k] = i
    return nodes, unary, np.array(edges, np.int64).reshape(-1, 2), potentials.links[np.array(kinds, np.int64)]


def listed(base: dict[str, list[tuple[int, int]]], weak: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """All candidates of a text in order: start, end, label (0 for look-alikes)."""
    return sorted([(a, b, 1 + k) for k, kind in enumerate(KINDS) for a, b in base[kind]] + [(a, b, 0) for a, b in weak])


def rewritten(text: str, a: int, b: int, form: str) -> tuple[str, int, int]:
    """What ``features`` sees around a span, with ``form`` in its place."""
    before = text[max(0, a - 24) : a]
    return before + form + text[b : b + 1], len(before), len(before) + len(form)


def forms(s: str, label: int, elsewhere: bool) -> list[str]:
    """Ways to write a base span that is hidden; short ones only if the text has it in full ``elsewhere`` too."""
    digits = DIGIT.sub("", s)
    kind = KINDS[label - 1]
    if kind == "email":
        return [s, s.partition(".")[0] if "@" in s.partition(".")[0] else s.rpartition(".")[0]] if elsewhere else [s]
    if kind == "ip":
        return [s]
    if kind == "card":
        return [s, digits]
    return [s, s.lstrip("+"), digits, *([digits[-7:]] if elsewhere else [])]


def examples(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, features, counts of linked labels, label) of each look-alike and of each form of each base span, hidden alone; see ``packed``."""
    base = base_spans(text)
    nodes = listed(base, weak_spans(text, base))
    written_as = [text[a:b] for a, b, _ in nodes]
    held, times = defaultdict(list), defaultdict(int)
    for i, s in enumerate(written_as):
        times[s] += 1
        for k, _ in keys(s):
            held[k].append(i)
    for i, (a, b, label) in enumerate(nodes):
        whole = written_as[i]
        chain = np.zeros((len(STRENGTHS), 1 + len(KINDS)), np.int64)
        if i and a - nodes[i - 1][1] < NEAR:
            chain[CHAIN, nodes[i - 1][2]] += 1
        if i + 1 < len(nodes) and nodes[i + 1][0] - b < NEAR:
            chain[CHAIN, nodes[i + 1][2]] += 1
        for s in dict.fromkeys(forms(whole, label, times[whole] > 1)) if label else [whole]:
            linked = chain.copy()
            for k, kind in keys(s):
                others = held.get(k, [])
                before, after = bisect_left(others, i) - 1, bisect_right(others, i)
                if before >= 0:
                    linked[kind, nodes[others[before]][2]] += 1
                if after < len(others):
                    linked[kind, nodes[others[after]][2]] += 1
            yield a, packed(3 * np.array(features(*rewritten(text, a, b, s)), float)), packed(linked.ravel()), label


def packed(values: np.ndarray) -> int:
    """Whole numbers from 0 to 3 in two bits each."""
    return sum(int(round(v)) << 2 * i for i, v in enumerate(values))


def unpacked(numbers: np.ndarray, n: int) -> np.ndarray:
    return (numbers[:, None] >> 2 * np.arange(n)) & 3


def fitted(x: np.ndarray, linked: np.ndarray, y: np.ndarray, before: Potentials, steps: int = 1500, rate: float = 0.3) -> Potentials:
    """The potentials of greatest pseudo-likelihood times a Gaussian prior of precision ``TRUST`` around ``before``; links stay non-negative."""
    unary, links, hot = before.unary.copy(), before.links.copy(), np.eye(1 + len(KINDS))[y]
    for _ in range(steps if len(y) else 0):
        z = x @ unary + np.einsum("ntl,t->nl", linked, links)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = p / p.sum(axis=1, keepdims=True) - hot
        unary -= rate * (x.T @ d + TRUST * (unary - before.unary)) / len(y)
        links -= rate * (np.einsum("nl,ntl->t", d, linked) + TRUST * (links - before.links)) / len(y)
        links = np.maximum(links, 0)
    return Potentials(unary, links)


def learned(rows: list[tuple[int, int, int]]) -> Potentials:
    """Potentials from rows of packed features, packed links and labels."""
    start = prior()
    table = np.array(rows, np.int64).reshape(-1, 3)
    x = unpacked(table[:, 0], len(start.unary)) / 3
    linked = unpacked(table[:, 1], len(STRENGTHS) * (1 + len(KINDS))).reshape(-1, len(STRENGTHS), 1 + len(KINDS))
    return fitted(x, linked.astype(float), table[:, 2], start)


def fit(docs: DataFrame, keep: list[str]) -> Potentials:
    """Potentials fitted on a sample of ``docs`` by a hash of the text and the columns ``keep``."""
    key = F.xxhash64(*dict.fromkeys(["text", *keep]))
    share = min(1.0, FIT_DOCS / max(1, docs.count()))
    some = docs.select(key.alias("key"), F.col("text").alias("__text")).where(F.pmod("key", F.lit(1 << 40)) < int(share * (1 << 40)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                rows = [(k, *e) for k, t in zip(part.column("key").to_pylist(), part.column("__text").to_pylist()) if t and SOME.search(t) for e in examples(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["key", "start", "x", "linked", "label"])

    found = some.mapInArrow(work, "key long, start long, x long, linked long, label long").withColumn("place", F.xxhash64("key", "start"))
    return learned([(r.x, r.linked, r.label) for r in found.orderBy("place", "x", "linked", "label").limit(FIT_CANDIDATES).collect()])


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans and the redacted text as ``clean``."""
    potentials = fit(docs, keep)

    def work(texts):
        made = [find(t, potentials) for t in texts]
        out = {f"n_{k}": pa.array([len(b[k]) for b, _ in made], pa.int64()) for k in KINDS}
        out["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in made], pa.string())
        out["spans"] = pa.array([written(e) for _, e in made], pa.string())
        return out

    return with_results(docs, keep, work, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the text without its personal data as ``clean`` (null stays null only if the caller keeps it so)."""
    potentials = fit(docs, keep)
    return with_results(docs, keep, lambda texts: {"clean": pa.array([redact(t, find(t, potentials)[1]) for t in texts], pa.string())}, "clean string")


def op2_pii(spark, sf_dir):
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
