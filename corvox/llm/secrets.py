"""Secret scans: fixed patterns, and guess costs of values in a credential context.

The patterns find assignments, access keys and long hex runs. The method adds values that
stand where a credential would (after a credential word and a separator, or as the password of
a URL) and that are hard to guess: a dynamic program finds the cheapest way to cut the value
into words, dates, repeats of what stands before, keyboard walks, separators and brute-force
characters, each with the decimal logarithm of its guesses; a value whose cheapest cut still
needs GUESSES digits is a secret, whatever its length. The minimum is over all such cuts. Words are the frequent
passwords below, then the whole words of a rank file's vocabulary, most frequent first.

Cases: null or empty texts have no spans. Texts and values of any length are read whole. Spans
are in code points. Repeated documents get a row each; spans that start together are ordered by
kind, equally cheap cuts cost the same. An added span never overlaps a pattern's span: of a
value that patterns cover in part, the whole is judged and what they leave is added. An empty
table gives an empty result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "guess"]
#: Where a credential's value stands: group 1 is the value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|api[_-]?key|access[_-]?key|private[_-]?key|account[_-]?key|signing[_-]?key|bearer)(?:[_-][a-z]+)?["'\]]{0,2}(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+|(?<=bearer)\x20+)(?:(?:bearer|basic)\x20+)?["'(]?([^\s"'<>,;(){}\[\]]{5,})|(?<=[a-z0-9+.-])://[^\s/:@]+:([^\s/@]{5,})@""", re.ASCII | re.IGNORECASE)
#: Texts without any of these have no context.
CUES = ("pass", "pwd", "secret", "token", "credential", "auth", "key", "bearer", "://")
#: Decimal digits of guesses from which a value is a secret.
GUESSES = 10.0

# Frequent passwords and words of placeholder values, most frequent first.
WORDS = """password 123456 123456789 qwerty admin welcome letmein login master dragon monkey
football baseball sunshine princess shadow superman batman iloveyou trustno1 hello freedom
whatever secret test guest root user default changeme example sample dummy placeholder your
here value token key apikey access public private none null true false undefined redacted
hidden string text name email account database server local localhost remote host service
client admin1 demo temp temporary insert enter replace with this that from the and for not
new old my pass word code pin phrase secure security config setting env environment variable
production staging development testing debug release version update summer winter spring
autumn january february march april june july august september october november december
monday tuesday wednesday thursday friday saturday sunday love money computer internet google
apple orange banana flower house family michael jennifer jordan thomas daniel charlie andrew
matthew robert jessica ashley nicole killer hunter soccer hockey ranger buster tigger pepper
ginger cookie cheese summer1 abc123 qwerty123 password1 welcome1 letmein1""".split()
ROWS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz"]
NEAR = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(a, b) for up, low in zip(ROWS[:3], ROWS[1:4], strict=True) for a, b in zip(up, low, strict=False)} | {(b, a) for up, low in zip(ROWS[:3], ROWS[1:4], strict=True) for a, b in zip(up, low, strict=False)}
DATE = re.compile(r"(?=((?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d|(?:19|20)\d\d))")
LEET = str.maketrans("@4310$5!7", "aaeiossit")
SEPARATORS = "-_./:"
log = math.log10
#: Guesses of a segment's start, of a walk's first key and of a step of a walk, straight on or turning.
START, KEY, STEP, TURN = log(2), log(47), log(1.25), log(4)


class Words(dict):
    """Rank of every word, from 1."""

    def __init__(self, words: Iterable[str]):
        super().__init__()
        for w in words:
            self.setdefault(w, len(self) + 1)
        self.longest = max(map(len, self))


COMMON = Words(WORDS)


@lru_cache(maxsize=4)
def ranked(vocabulary: str) -> Words:
    """WORDS, then the whole lower-case words of a rank file (a base64 piece and its rank on each line)."""
    with open(vocabulary, "rb") as f:
        pieces = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    return Words([*WORDS, *(x[1:].decode() for _, x in pieces if x[:1] == b" " and len(x) > 3 and x[1:].isalpha() and x.islower())])


def plain_letters(value: str) -> bool:
    """Whether a value is of letters of one case only: as unknown words and names are, which are guessed letter by likely letter."""
    return value.isalpha() and (value.islower() or value.isupper())


def brute(c: str, plain: bool = False) -> float:
    """Guesses of one character, as a decimal logarithm: the size of its class; in plain letters the ten or so that are likely after the ones before."""
    if plain:
        return 1.0
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log(26)
    if c in SEPARATORS:
        return log(len(SEPARATORS))
    return log(33) if c < "\x7f" else 2.0


def word_cost(text: str, rank: int, leet: bool) -> float:
    """Guesses of a word of that rank, as written."""
    upper = sum(map(str.isupper, text))
    case = 0.0 if not upper else log(2) if text.istitle() or text.isupper() else log(2) * upper
    return log(rank) + case + (log(4) if leet else 0.0)


def date_cost(text: str) -> float:
    return log(120) if len(text) == 4 else log(365 * 120) + (0.0 if text.isdigit() else log(4))


def step_cost(a: str, b: str, c: str) -> float:
    """Guesses of a walk's step from b to c, after that from a to b."""
    old, new = ord(b) - ord(a), ord(c) - ord(b)
    return STEP if new == old or abs(new) == 1 == abs(old) else TURN


def periods(s: str) -> list[tuple[int, int, int]]:
    """Maximal repetitions (start, end, period) of at least two periods; none whose period is a multiple of another's that covers it."""
    n, out = len(s), []
    for p in range(1, n // 2 + 1):
        x = 0
        while x + p < n:
            if s[x] == s[x + p] and not any(p % q == 0 and a <= x and x + p < e for a, e, q in out):
                a = b = x
                while a and s[a - 1] == s[a - 1 + p]:
                    a -= 1
                while b + p < n and s[b] == s[b + p]:
                    b += 1
                if b - a >= p:
                    out.append((a, b + p, p))
                x = b // p * p
            x += p
    return out


def dates(value: str) -> list[tuple[int, int]]:
    """(start, end) of what reads as a date or a year."""
    out = []
    for m in DATE.finditer(value):
        a, b = m.span(1)
        out += [(a, b)] if b - a == 4 or not re.match("19|20", m[1]) else [(a, b), (a, a + 4)]
    return out


def guess_cost(value: str, words: Words = COMMON) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation."""
    n, low = len(value), value.lower() if len(value.lower()) == len(value) else value
    plain, days, letters = low.translate(LEET), {}, plain_letters(value)
    for a, b in dates(value):
        days.setdefault(b, []).append(a)
    copies = [[a, e, p, math.inf] for a, e, p in periods(value)]  # with the least cost of a start so far
    copies.sort()
    again, live, next_ = log(max(n, 1)), [], 0
    best = [0.0] * (n + 1)
    key = pair = walk = math.inf  # cheapest walks of one, two and more keys that end at the character before
    for j in range(1, n + 1):
        cost = best[j - 1] + brute(value[j - 1], letters)
        for i in range(max(0, j - words.longest), j - 2):
            if rank := words.get(low[i:j]):
                cost = min(cost, best[i] + START + word_cost(value[i:j], rank, False))
            if rank := words.get(plain[i:j]):
                cost = min(cost, best[i] + START + word_cost(value[i:j], rank, plain[i:j] != low[i:j]))
        for i in days.get(j, ()):
            cost = min(cost, best[i] + START + date_cost(value[i:j]))
        while next_ < len(copies) and copies[next_][0] <= j:
            live.append(copies[next_])
            next_ += 1
        live = [x for x in live if x[1] >= j]
        for x in live:
            if j >= x[0] + 2 * x[2]:
                x[3] = min(x[3], best[j - x[2]])
                cost = min(cost, x[3] + START + again)
        near = j > 1 and (low[j - 2], low[j - 1]) in NEAR
        walk = min(pair, walk) + step_cost(low[j - 3], low[j - 2], low[j - 1]) if near and j > 2 else math.inf
        pair = key + STEP if near else math.inf
        key = best[j - 1] + START + KEY
        best[j] = min(cost, walk)
    return best[n]


def uncovered(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches of a..b that no span of base covers; base is in order of start."""
    out = []
    for x, y, _ in base:
        if x >= b:
            break
        if y > a:
            out += [(a, x)] if a < x else []
            a = y
    return out + ([(a, b)] if a < b else [])


def spans(text: str, words: Words = COMMON) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all secrets, in order of start, then kind."""
    low = text.lower()
    cue = [c for c in CUES if c in low]
    found = []
    if cue:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if cue:
        base = sorted(found)
        for m in CONTEXT.finditer(text):
            a, b = m.span(1) if m[1] is not None else m.span(2)
            value = text[a:b].rstrip(".!?:")
            b = a + len(value)
            if (rest := uncovered(a, b, base)) and guess_cost(value, words) >= GUESSES:
                found += [(x, y, 3) for x, y in rest]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def scanned(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row of SCHEMA per document; `vocabulary` is a rank file of words that executors can read."""

    def make():
        words = ranked(vocabulary) if vocabulary else COMMON

        def run(batch: pa.RecordBatch) -> dict:
            all_ = [spans(t or "", words) for t in batch.column("text").to_pylist()]
            base = [[x for x in f if x[2] < 3] for f in all_]
            return {
                "doc_id": batch.column("doc_id"), **{f"n_{KINDS[k]}": [sum(x[2] == k for x in f) for f in all_] for k in range(3)},
                "base_sha256": [hashlib.sha256(joined(f).encode()).hexdigest() for f in base], "spans": [joined(f) for f in all_],
            }

        return run

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCHEMA)


MASK = "[SECRET]"


def masked(text: str | None, words: Words = COMMON) -> str | None:
    """The text with every stretch of secrets replaced by MASK."""
    if not text or not (found := spans(text, words)):
        return text
    out, at = [], 0
    end = -1
    for a, b, _ in found:
        if a > end:
            out += [text[at:a], MASK]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text, lang, source, n_chars) with secrets masked in the text and n_chars of the new text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))

    def make():
        words = ranked(vocabulary) if vocabulary else COMMON

        def run(batch: pa.RecordBatch) -> dict:
            old = batch.column("text").to_pylist()
            new = [masked(t, words) for t in old]
            size = [n if t == o else len(t) for n, t, o in zip(batch.column("n_chars").to_pylist(), new, old, strict=True)]
            return {c: batch.column(c) for c in ("doc_id", "lang", "source")} | {"text": new, "n_chars": size}

        return run

    return map_slices(rows, make, "doc_id long, text string, lang string, source string, n_chars long")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scanned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
