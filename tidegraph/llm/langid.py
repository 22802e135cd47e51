"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over reference text from labelled documents. A
text is cross-parsed against it: from each phrase start the longest match is followed and a
mismatch starts the next phrase, so text of the language needs few phrases. The language with
the fewest normalised phrases (phrases x log2(reference + letters) / characters) wins.

Reference text is bounded: texts are drawn by their hash over all labelled rows (copies count once,
ids play no part), as many as fill ``reference`` characters by a sum of letters that is taken first, so every
language that has the text fills its book. A language with less text keeps its own shorter book and
its own scale; no other book is cut for it. It is recognised less surely, for a short book finds shorter phrases.
Every letter of the books keeps a code: the most frequent ones a symbol, the others a short fixed sequence of symbols,
so tables stay narrow however many scripts there are; only letters that no book has share one.
Automata are built once on the driver and travel as edge lists; workers lay them out as dense
tables and step through all texts of a batch together. Long texts are parsed side by side in pieces of ``segment``
characters; each piece is then entered again in the state that the piece before it ended in, until both
parses agree (some tens of characters as a rule), so phrases are those of one parse of the whole text.

Defined cases. Null texts and texts without a letter are ``und`` with score 0. A text whose
letters all languages parse equally badly goes to the first language by code point. A language
without a labelled letter is never predicted. Without labelled rows every text is ``und``. Extra columns are ignored; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegraph.llm.common import Shared, crc_bucket, with_results

#: Codes of one symbol; code 0 pads, 1 is a gap between words, 2 a letter of no book.
ALPHABET = 56
#: Letters of the books beyond the ``ALPHABET`` are written as a leading digit and further digits of this base.
BASE = 32
LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the start."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def clean(text: str) -> str:
    """Lower case, words of letters with one gap between them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class CrossParser:
    """Automata of all languages in one table. ``edges``: (state, code, next) a language."""

    def __init__(self, languages: list[str], letters: str, edges: list[np.ndarray], scale: list[float]):
        self.languages, self.letters, self.edges, self.scale = languages, letters, edges, scale
        self.table = self.code = None

    @property
    def digits(self) -> int:
        """Symbols of a letter beyond the alphabet; 0 if there is none."""
        rest, n = len(self.letters) - (ALPHABET - 3), 2
        while BASE**n < rest:
            n += 1
        return n if rest > 0 else 0

    def __getstate__(self):
        return self.languages, self.letters, self.edges, self.scale

    def __setstate__(self, state):
        self.__init__(*state)

    def lay_out(self):
        width = ALPHABET + 2 * BASE if self.digits else len(self.letters) + 3
        starts, tables = [], []
        at = 1  # state 0 is the dead one
        for e in self.edges:
            states = int(e[:, [0, 2]].max(initial=0)) + 1
            t = np.zeros((states, width), np.int32)
            t[e[:, 0], e[:, 1]] = e[:, 2] + at
            starts.append(at)
            tables.append(t)
            at += states
        self.starts = np.array(starts, np.int32)
        self.table = np.concatenate([np.zeros((1, width), np.int32), *tables]).reshape(-1)
        self.width = width
        self.assign_codes()

    def assign_codes(self):
        # Whatever is no letter is a gap.
        self.code = np.array([2 if chr(i).isalpha() else 1 for i in range(0x110000)], np.int32)
        for i, c in enumerate(self.letters):
            self.code[ord(c)] = i + 3

    def encode(self, text: str) -> np.ndarray:
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(codes), bool)
        if len(codes):
            keep[0] = codes[0] != 1
            keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
        return self.spell(codes[keep])

    def spell(self, codes: np.ndarray) -> np.ndarray:
        """Letters beyond the alphabet (codes from ``ALPHABET`` on) as digits, the leading one apart from the others."""
        n = self.digits
        if not n or not (far := codes >= ALPHABET).any():
            return codes.astype(np.int8)
        out = np.repeat(codes, np.where(far, n, 1))
        first = (np.cumsum(np.where(far, n, 1)) - np.where(far, n, 1))[far]
        rest = codes[far] - ALPHABET
        for i in range(n):
            digit = rest // BASE ** (n - 1 - i) % BASE
            out[first + i] = ALPHABET + digit + (BASE if i else 0)
        return out.astype(np.int8)

    def advance(self, state: np.ndarray, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, ended phrases) after character ``c``: a mismatch ends the phrase, the next one starts with the
        character; one that the book lacks is a phrase of its own."""
        to, first = self.table[state * self.width + c], self.table[start * self.width + c]
        dead, lacks = to == 0, first == 0
        return np.where(dead, np.where(lacks, start, first), to), dead.astype(np.int32) + (lacks & (state != start))

    def phrases(self, texts: list[str], segment: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (texts, languages), characters and whether there is a letter."""
        if self.table is None:
            self.lay_out()
        coded = [self.encode(t) for t in texts]
        lengths = np.array([len(c) for c in coded], np.int64)
        lettered = np.array([bool((c > 1).any()) for c in coded], bool)
        parts = -(-lengths // segment)
        of = np.repeat(np.arange(len(texts)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(segment, lengths[of] - k * segment)
        flat = np.concatenate([*coded, np.zeros(segment, np.int8)])
        begin = (np.cumsum(lengths) - lengths)[of] + k * segment
        counts, end = self.alone(flat, begin, size)
        # Pieces that one before them enters in the middle of a phrase: (language, piece).
        lang, piece = np.nonzero((k[1:] > 0) & (end[:, :-1] != self.starts[:, None])) if len(of) else (of, of)
        piece = piece + 1
        own, fix = end.copy(), np.zeros(counts.shape, np.int32)
        while len(piece):
            moved = self.enter(flat, begin, size, lang, piece, own, end, fix)
            last = piece == len(of) - 1
            on = moved & ~last
            lang, piece = lang[on], piece[on] + 1
            lang, piece = lang[k[piece] > 0], piece[k[piece] > 0]
        total = np.zeros((len(texts), len(self.languages)))
        final = np.flatnonzero(k == parts[of] - 1)
        for j, start in enumerate(self.starts):
            total[:, j] = np.bincount(of, counts[j] + fix[j], len(texts))
            total[of[final], j] += end[j, final] != start
        return total, lengths, lettered

    def alone(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ended phrases and last state (languages, pieces), each piece parsed from the start."""
        order = np.argsort(-size, kind="stable")
        at, long = begin[order], size[order]
        n, m = len(self.languages), len(at)
        counts, state = np.zeros((n, m), np.int32), np.repeat(self.starts[:, None], m, axis=1)
        steps = int(size.max(initial=0))
        live = np.searchsorted(-long, -np.arange(steps), side="left")  # pieces longer than t
        for t, a in enumerate(live.tolist()):
            state[:, :a], ended = self.advance(state[:, :a], flat[at[:a] + t].astype(np.int32)[None, :], self.starts[:, None])
            counts[:, :a] += ended
        back = np.argsort(order)
        return counts[:, back], state[:, back]

    def enter(self, flat, begin, size, lang, piece, own, end, fix) -> np.ndarray:
        """Parse pieces from where the one before them ended, beside the parse from the start, until both are in one state.

        ``fix`` gets what that changes in the count of each and ``end`` the last state (``own`` if they agreed); the result says where it moved.
        """
        start, state = self.starts[lang], end[lang, piece - 1]
        alone, more = start.copy(), np.zeros(len(piece), np.int32)
        last, on, t = own[lang, piece], np.arange(len(piece)), 0
        while len(on):
            over = size[piece[on]] == t
            last[on[over]] = state[on[over]]
            on = on[~over]
            c = flat[begin[piece[on]] + t].astype(np.int32)
            state[on], true = self.advance(state[on], c, start[on])
            alone[on], guess = self.advance(alone[on], c, start[on])
            more[on] += true - guess
            on, t = on[state[on] != alone[on]], t + 1
        moved = last != end[lang, piece]
        fix[lang, piece], end[lang, piece] = more, last
        return moved

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        total, lengths, lettered = self.phrases(texts)
        rate = total * np.array(self.scale)[None, :] / np.maximum(1, lengths)[:, None]
        best = rate.argmin(axis=1)
        low = rate[np.arange(len(texts)), best]
        others = np.where(np.arange(rate.shape[1])[None, :] == best[:, None], np.inf, rate).min(axis=1)
        sure = np.where(np.isinf(others), 1.0, 1 - low / np.where(np.isinf(others) | (others == 0), 1, others))
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(np.clip(sure, 0, 1), lettered)]


def train(docs: DataFrame, reference: int = 32_768, docs_each: int = 48) -> CrossParser:
    """Learn from rows whose lang is not null and whose id's crc32 modulo 4 is not 2."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket("doc_id", 4) != 2))
    draw = F.shiftrightunsigned(F.xxhash64("text"), 4)
    known = known.select("lang", draw.alias("draw"), F.substring("text", 1, reference).alias("text"))
    size = F.length(F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")))
    # The texts of level j and above are about one in 2^j; copies of a text count once.
    level = F.floor(F.lit(60) - F.log2(F.col("draw") + 1)).cast("int")
    pool = known.select("lang", "draw", size.alias("size")).groupBy("lang", "draw").agg(F.max("size").alias("size"))
    tally = pool.groupBy("lang", level.alias("level")).agg(F.count_if(F.col("size") > 0).alias("n"), F.sum("size").alias("chars")).collect()
    least: dict[str, int] = {}
    n, chars = Counter(), Counter()
    for r in sorted(tally, key=lambda r: -r["level"]):
        lang = r["lang"]
        if n[lang] < docs_each or chars[lang] < 2 * reference:
            least[lang] = r["level"]
        n[lang] += r["n"]
        chars[lang] += r["chars"]
    rows = []
    if least:
        levels = docs.sparkSession.createDataFrame(sorted(least.items()), "lang string, least int")
        drawn = known.join(F.broadcast(levels), "lang").where(level >= F.col("least")).groupBy("lang", "draw").agg(F.min("text").alias("text"))
        before = F.sum("size").over(Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1))
        drawn = drawn.withColumn("size", size).where("size > 0").withColumn("before", F.coalesce(before, F.lit(0)))
        rows = drawn.where(F.col("before") < 2 * reference).select("lang", "draw", "text").collect()
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"])):
        if len(texts.get(r["lang"], "")) < reference:
            texts[r["lang"]] = f"{texts.get(r['lang'], '')} {clean(r['text'])}"[:reference]
    return parser_of(texts)


def parser_of(texts: dict[str, str]) -> CrossParser:
    """The parser of cleaned reference texts, each used whole."""
    texts = {k: v for k, v in sorted(texts.items()) if v.strip()}
    ranked = [c for c, _ in sorted(Counter("".join(texts.values()).replace(" ", "")).items(), key=lambda x: (-x[1], x[0]))]
    # Those beyond the alphabet by code point, so that letters of a script share their leading digits.
    letters = "".join(ranked[: ALPHABET - 3] + sorted(ranked[ALPHABET - 3 :]))
    parser = CrossParser(list(texts), letters, [], [])
    parser.assign_codes()
    for v in texts.values():
        steps = suffix_automaton(parser.encode(v).tolist())
        parser.edges.append(np.array([(s, c, t) for s, to in enumerate(steps) for c, t in to.items()], np.int32).reshape(-1, 3))
    # A phrase points into the book or spells a letter, so a short book is no cheaper than spelling.
    parser.scale = [math.log2(len(v) + len(letters) + 2) for v in texts.values()]
    return CrossParser(parser.languages, letters, parser.edges, parser.scale)


def identify(docs: DataFrame, parser: CrossParser, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (how far the runner-up lies behind)."""
    shared = Shared(docs.sparkSession, parser)

    def work(texts):
        langs, scores = shared.value.predict(texts)
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

    return with_results(docs, keep, work, "lang_pred string, score double")


def op9_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs), ["doc_id"]).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
