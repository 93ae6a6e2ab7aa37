"""Personal data in texts: base patterns, and further spans from a character tagger.

The tagger learns from spans of the base patterns in a bounded sample of documents and from written
variants put into their texts. It reads overlapping windows; each position takes its tag from the window
in whose middle it lies, and spans are read from the whole text's tags, so they may cross windows. Every
span holds a digit, an at-sign or a spelled one, so windows without any of these have no span to find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweft.llm import tagger
from seqweft.llm.common import small_batches, with_struct

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 64, 32
SYMBOLS = 98
TAGS = 1 + 2 * len(KINDS)
AT_ONCE = 2048
Span = tuple[int, int, int]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A number's digits are taken whole, so a search need not begin inside them.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every believable span holds: a digit, an at-sign or one of its spelled forms before a domain, as plain() reads them.
ANCHOR = re.compile(r"[0-9@]|\bdot\b|[\[({]\s*(?:at|dot|\.)\s*[\])}]|(?<=\s)at\s+[a-z0-9-]+\s*\.\s*[a-z0-9]", re.I)
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each at-sign so that long words cost one look only."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done, 0))
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns by start, then kind; matches that fail their check are dropped."""
    out = emails(text)
    for m in IP.finditer(text):
        if all(map(small_part, m.group().split("."))):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def symbols(text: str) -> np.ndarray:
    """Printable ASCII as such, other letters as one symbol, anything else as another."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 31, 97)
    letters = (codes >= 0xAA) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2C00))
    return np.where(letters, 96, out).astype(np.int16)


def window_starts(text: str, length: int) -> np.ndarray:
    """Starts of the windows in which a span may lie, on a grid of the stride."""
    hits = np.array([m.start() for m in ANCHOR.finditer(text)], int) // STRIDE
    grid = np.unique(np.concatenate([hits - 2, hits - 1, hits, hits + 1]))
    return grid[(grid >= -1) & (grid * STRIDE < length)] * STRIDE


def cut(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows of symbols; what lies outside the text is symbol 0."""
    padded = np.zeros(len(codes) + 2 * WINDOW, np.int16)
    padded[WINDOW : WINDOW + len(codes)] = codes
    return padded[starts[:, None] + WINDOW + np.arange(WINDOW)]


def tagged_spans(tags: np.ndarray) -> list[Span]:
    """Spans of a text's tags: a beginning and what follows of its kind."""
    out, start, kind = [], -1, -1
    for at in np.flatnonzero(tags).tolist():
        k, inside = divmod(int(tags[at]) - 1, 2)
        if inside and k == kind and out and out[-1][1] == at:
            out[-1] = (start, at + 1, kind)
        else:
            start, kind = at, k
            out.append((at, at + 1, k))
    return out


def plain(said: str) -> str:
    """A spelled address in its usual form."""
    said = re.sub(r"\s*(?:[\[({]\s*at\s*[\])}]|\sat\s)\s*", "@", said, flags=re.I)
    said = re.sub(r"\s*(?:[\[({]\s*(?:dot|\.)\s*[\])}]|\sdot\s)\s*", ".", said, flags=re.I)
    return re.sub(r"\s*([@.])\s*", r"\1", said)


def believable(said: str, kind: int) -> bool:
    """Whether a tagged span has the substance of its kind."""
    digits = _NO_DIGIT.sub("", said)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain(said)) is not None
    if kind == 1:
        parts = plain(said).split(".")
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", x) and small_part(x) for x in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9](?:[\x20./_-]{0,2}[0-9])+", said) is not None and luhn(digits)
    return 10 <= len(digits) <= 15 and re.fullmatch(r"\(?[+0-9](?:[\x20()./-]{0,3}[0-9])+", said) is not None and len(re.findall(r"[0-9]+", said)) >= 3


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Tagged spans that are believable, stand free of further letters and digits, and touch no base span."""
    taken = np.zeros(len(text) + 1, bool)
    for a, b, _ in base:
        taken[a:b] = True
    out = []
    for a, b, kind in tagged_spans(tags):
        while a < b and text[a] in " .,;:!?\n\"'":
            a += 1
        while b > a and text[b - 1] in " .,;:!?\n\"'(":
            b -= 1
        free = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if b - a >= 6 and free and not taken[a:b].any() and believable(text[a:b], kind):
            out.append((a, b, kind))
            taken[a:b] = True
    return out


# --- labelled spans for training


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    body = "4" + _digits(rng, 14)
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def variants(rng, word) -> list[tuple[str, int | None]]:
    """Written forms, each with its kind; None for numbers that aren't personal data."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    user, place, end = word() + pick("", ".", "_", "") + pick(word(), _digits(rng, 2)), word(), pick("com", "org", "net", "de", "fr")
    at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", " . "), ("@", "."), ("@", "."), (" (at) ", "."))
    parts = [str(x) for x in rng.integers(0, 256, 4)]
    card, phone = _card(rng), _digits(rng, 10)
    sep = pick(" ", "-", "", ".", "/", "  ", " - ")
    area, mid, last = phone[:3], phone[3:6], phone[6:]
    return [
        (f"{user}{at}{place}{dot}{end}", 0),
        (f"{user}@{pick('mail', word())}.{place}.{end}", 0),
        (pick(".", ".", "[.]", " . ").join(parts), 1),
        (sep.join(card[i : i + 4] for i in range(0, 16, 4)), 2),
        (pick(f"+1 ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+49 {area} {mid}{last}", f"00{pick('1', '33', '49')} {area} {mid} {last}"), 3),
        (f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"', None),
        (pick(f"v{parts[0]}.{parts[1]}", "Version 2.0", "4.0", f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(24):02d}:{rng.integers(60):02d}"), None),
        (pick(_digits(rng, int(rng.integers(1, 9))), f"{rng.integers(1, 99)},{_digits(rng, 3)}", f"{rng.integers(1, 99)}%", f"@{word()}", f"{word()} dot {word()}"), None),
    ]


def labelled_windows(texts: list[str], written: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols with their tags: from the texts' own base spans, and from variants put between words."""
    rng = np.random.default_rng(seed)
    windows, truth = [], []

    def put(text: str, spans: list[Span], starts: np.ndarray) -> None:
        tags = np.zeros(len(text), np.int16)
        for a, b, k in spans:
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
        windows.append(cut(symbols(text), starts))
        truth.append(cut(tags, starts))

    for text in texts:
        if len(starts := window_starts(text, len(text))):
            some = rng.permutation(len(starts))[:8]
            put(text, base_spans(text), starts[some])
    words = [w for t in texts for w in re.findall(r"[A-Za-z]{2,12}", t[:2000])] or ["name"]
    word = lambda: words[rng.integers(len(words))].lower()
    for _ in range(-(-written // 8)):
        for said, kind in variants(rng, word):
            before = " ".join(word() for _ in range(rng.integers(0, 12)))
            after = " ".join(word() for _ in range(rng.integers(0, 12)))
            text = f"{before} {said}{(' ', '. ', ', ', chr(10))[rng.integers(4)]}{after}"
            at = len(before) + 1
            put(text, [] if kind is None else [(at, at + len(said), kind)], np.array([at - int(rng.integers(0, WINDOW - 20))]))
    return np.concatenate(windows), np.concatenate(truth)


def learn(df: DataFrame, key: str, text: str, sample: int = 200, chars: int = 20_000, written: int = 2000) -> tagger.Params:
    """Trains on the `sample` rows with an anchor that have the smallest hash of the key, with up to `chars` characters
    each, and on about `written` written windows; the bound holds for tables of any size."""
    rows = df.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(key).alias("h"), F.substring(text, 1, chars).alias("t"))
    # The hashes first, as each task sends as many rows as are wanted; then only the texts that have them.
    hashes = [r.h for r in rows.select("h").orderBy("h").limit(sample).collect()]
    chosen = rows.where(F.col("h") <= hashes[-1]) if hashes else rows.limit(0)
    texts = [r.t for r in chosen.orderBy("h", F.length("t"), "t").limit(sample).collect()]
    windows, truth = labelled_windows(texts, written)
    return tagger.train(windows, truth, SYMBOLS, TAGS)


# --- whole texts


def all_tags(p: tagger.Params, texts: list[str]) -> list[np.ndarray]:
    """Tags of every position of every text; windows of many texts are decoded together."""
    codes = [symbols(t) for t in texts]
    starts = [window_starts(t, len(t)) for t in texts]
    out = [np.zeros(len(t), np.int8) for t in texts]
    jobs = [(i, s) for i, ss in enumerate(starts) for s in ss.tolist()]
    for at in range(0, len(jobs), AT_ONCE):
        some = jobs[at : at + AT_ONCE]
        found = tagger.best_tags(p, np.concatenate([cut(codes[i], np.array([s])) for i, s in some]))
        for (i, s), tags in zip(some, found, strict=True):
            # The middle of a window is its own; the text's first positions belong to the window before the grid.
            a, b = max(0, s + STRIDE // 2), min(len(out[i]), s + STRIDE // 2 + STRIDE)
            if a < b:
                out[i][a:b] = tags[a - s : b - s]
    return out


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"


def private_struct(p: tagger.Params):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    small_batches()

    @F.pandas_udf(SCHEMA)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 500):
                texts = [t or "" for t in batch.iloc[at : at + 500]]
                for text, tags in zip(texts, all_tags(p, texts), strict=True):
                    base = base_spans(text)
                    more = added_spans(text, tags, base)
                    counts = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
                    rows.append((*counts, said(base), said(base + more), len(more)))
            yield pd.DataFrame(rows, columns=names)

    return found


def find_private(df: DataFrame, p: tagger.Params, text: str = "text") -> DataFrame:
    """Adds counts of base spans by kind, `base` and `spans` (kind:start:end by start, code points), and `n_added`.

    Base spans always stay; tagged ones are added where they touch none and are believable. A null or empty
    text has no spans. Rows are independent, repeated rows repeat their result, and columns named like the
    new ones are replaced. The counts are those of the base patterns.
    """
    return with_struct(df, private_struct(p)(F.col(text).cast("string")), [c.split()[0] for c in SCHEMA.split(", ")])


def masked(text: Column, spans: Column) -> Column:
    """The text with every span of `spans` written as its kind in brackets."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, listed: pd.Series) -> pd.Series:
        return pd.Series([_mask(t, s) for t, s in zip(texts, listed, strict=True)])

    return mask(text, spans)


def _mask(text: str | None, listed: str | None) -> str | None:
    if not text or not listed:
        return text
    out, done = [], 0
    for item in listed.split(","):
        kind, a, b = item.split(":")
        if int(b) > done:
            out += [text[done : max(done, int(a))], f"[{kind}]"]
            done = int(b)
    return "".join([*out, text[done:]])
