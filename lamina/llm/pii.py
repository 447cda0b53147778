"""Personal data by a semi-Markov conditional random field over text islands.

Base kinds (email, ip, card, phone) are plain patterns with checks. The method
adds spans that the patterns miss: around digits and at-signs a text has islands,
cut into atoms (digit groups, words, signs); every run of at most ``BOUND`` atoms
and every run that reads as a spelt-out address or an account number, however many
atoms it has, is a candidate segment of every type, scored by features of the whole span (digit
count, checksum, grouping, words before it, what it touches). The field is trained
by likelihood on generated lines, and the best segmentation, found by dynamic
programming over segments of bounded length, sets boundaries and types together. The
programming runs over an island's atoms in a stream: features are made for ``STREAM``
first atoms at a time, so memory doesn't grow with them, only 40 bytes an atom do.

Edge cases: null and empty texts have no spans; texts of any length are scanned
whole; repeated rows and null ids keep their rows; an empty table gives an empty
result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sent, map_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
BOUND = 14
STREAM = 512
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT, DOT = r"(?:[\[({<]\s?at\s?[\])}>]|\bat\b|@)", r"(?:[\[({<]\s?dot\s?[\])}>]|\bdot\b|\.)"
SPOKEN = re.compile(rf"\b[A-Za-z0-9._%+-]{{1,64}} ?{AT} ?[A-Za-z0-9-]{{1,63}}(?: ?{DOT} ?[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)
#: After an address that isn't yet whole.
GOES_ON = re.compile(r" ?(?:[\[({<]\s?dot\s?[\])}>]|\bdot\b) ?[A-Za-z0-9]|\.[A-Za-z0-9]", re.I)
NUMBERS = re.compile(r"[+(]?[0-9](?:[0-9]|[ ().\-/](?=[ ().\-/]{0,2}[0-9])){6,}")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,9}\b")
# Without an at-sign or one of these no address is spelt out.
SIGNS = re.compile(r"@|\b(?:dot|at)\s?[\])}>]|\bdot\b", re.I)
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\s+|[^\w\s]|\w", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from the at-signs in linear time."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(a, b, "email") for a, b in emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


# Words that tell what follows them.
CUES = (("phone", "tel", "call", "mobile", "cell", "fax"), ("card", "visa", "credit", "mastercard"), ("ssn", "social", "security"), ("ip", "host", "server", "address"), ("mail", "email", "contact"), ("iban", "account", "bank"))
SHAPES = tuple(map(re.compile, (r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}", r"\d{3}-\d{2}-\d{4}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}", r"\d{1,3}(\.\d{1,3}){3}", r"\+?\d{1,3}([ .-]\(?\d{2,4}\)?){2,5}", r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}", r"\d+")))
N_FEATURES = 1 + 5 + len(SHAPES) + 6 + len(CUES) + 4


def features(text: str, a: int, b: int) -> list[float]:
    """Features of a whole span, with what it touches and the words before it."""
    s, d = text[a:b], digits_of(text[a:b])
    n = len(d)
    before, left, right = text[max(0, a - 24) : a].lower(), text[a - 1 : a], text[b : b + 1]
    f = [1.0, n == 9, 10 <= n <= 15, 13 <= n <= 19, 7 <= n <= 8, n < 7]
    f += [bool(p.fullmatch(s)) for p in SHAPES]
    f += [13 <= n <= 19 and luhn(d), s[:1] == "+", SPOKEN.fullmatch(s) is not None and not GOES_ON.match(text, b), iban_ok(s), all(x.isdigit() and int(x) < 256 for x in s.split(".")) if s.count(".") == 3 and n <= 12 else False, any(c.isalpha() for c in s)]
    f += [any(re.search(rf"\b{w}", before) for w in cue) for cue in CUES]
    f += [left.isalnum() or left in ("+", "@"), right.isalnum() or right == "@", not s[:1].isalnum() and s[:1] not in "+(", not s[-1:].isalnum()]
    return [float(x) for x in f]


def spans_of(pattern: re.Pattern, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Matches in a stretch of text, and the prefixes of each that match by themselves."""
    out = []
    for m in pattern.finditer(text, start, end):
        at = m.end()
        while at > m.start() and (shorter := pattern.match(text, m.start(), at)):
            out.append(shorter.span())
            at = shorter.end() - 1
    return out


class Island:
    """Atoms of a stretch of text and its candidate segments."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.cuts = array("q", (m.start() for m in ATOM.finditer(text, start, end)))
        self.cuts.append(end)
        self.n = len(self.cuts) - 1
        # spans longer than BOUND that the candidate patterns match, by their first atom
        self.long: dict[int, set[int]] = {}
        for p in (SPOKEN, IBAN):
            for a, b in spans_of(p, text, start, end):
                i, j = bisect_left(self.cuts, a), bisect_left(self.cuts, b)
                if j - i > BOUND and self.cuts[i] == a and self.cuts[j] == b:
                    self.long.setdefault(i, set()).add(j)

    def segments(self, low: int, high: int) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Candidate segments that start at atoms ``low`` to ``high``, in order, with their features."""
        text, cuts, found, rows = self.text, self.cuts, [], []
        for i in range(low, min(high, self.n)):
            a = cuts[i]
            if text[a].isspace():
                continue
            for j in [*range(i + 1, min(self.n, i + BOUND) + 1), *sorted(self.long.get(i, ()))]:
                b = cuts[j]
                if text[b - 1].isspace():
                    continue
                s = text[a:b]
                if sum("0" <= c <= "9" for c in s) >= 7 or "at" in s.lower() or "@" in s:
                    found.append((i, j))
                    rows.append(features(text, a, b))
        return found, np.array(rows).reshape(-1, N_FEATURES)

    def best(self, w: np.ndarray, stream: int = STREAM) -> list[tuple[int, int, int]]:
        """The best segmentation: (start, end, type) of its entities; atoms outside score 0."""
        n = self.n
        value, back, kinds = array("d", [0.0]) + array("d", [-np.inf]) * n, array("q", [-1]) * (n + 1), array("b", [0]) * (n + 1)
        for low in range(0, n, stream):
            found, x = self.segments(low, low + stream)
            scores = x @ w if found else np.zeros((0, len(KINDS)))
            top, kind, k = scores.max(axis=1, initial=-np.inf).tolist(), scores.argmax(axis=1).tolist(), 0
            for i in range(low, min(low + stream, n)):
                if i and value[i - 1] >= value[i]:
                    value[i], back[i] = value[i - 1], -1
                while k < len(found) and found[k][0] == i:
                    j = found[k][1]
                    if (v := value[i] + top[k]) > value[j]:
                        value[j], back[j], kinds[j] = v, i, kind[k]
                    k += 1
        out, j = [], n
        if n and value[n - 1] >= value[n]:
            back[n] = -1
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                out.append((self.cuts[back[j]], self.cuts[j], kinds[j]))
                j = back[j]
        return out[::-1]


class Taught:
    """An island with all its segments, for training."""

    def __init__(self, island: Island):
        self.n, self.cuts = island.n, island.cuts
        self.segments, self.x = island.segments(0, island.n)

    def gradient(self, w: np.ndarray, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, float]:
        """Of the log-likelihood of the gold entities, by forward and backward sums over segments."""
        scores = self.x @ w
        fwd, bwd = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        fwd[0] = bwd[self.n] = 0.0
        total = np.logaddexp.reduce(scores, axis=1)
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(self.segments):
            by_end.setdefault(j, []).append(k)
            by_start.setdefault(i, []).append(k)
        for j in range(1, self.n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[self.segments[k][0]] + total[k] for k in by_end.get(j, ()))])
        for i in range(self.n - 1, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[self.segments[k][1]] + total[k] for k in by_start.get(i, ()))])
        i, j = np.array([s[0] for s in self.segments]), np.array([s[1] for s in self.segments])
        p = np.exp(np.minimum(0.0, fwd[i][:, None] + scores + bwd[j][:, None] - fwd[self.n]))
        seen = np.zeros_like(p)
        for k, s in enumerate(self.segments):
            if s in gold:
                seen[k, gold[s]] = 1.0
        return self.x.T @ (seen - p), float((seen * scores).sum() - fwd[self.n])


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold personal data, merged where they overlap."""
    found = []
    if SIGNS.search(text):
        found += [m.span() for m in SPOKEN.finditer(text) if re.search(r"\bdot\b|@|[\[({<]\s?at", m[0], re.I)]
    if any(c in text for c in "0123456789"):
        found += [m.span() for m in NUMBERS.finditer(text)]
        found += [m.span() for m in IBAN.finditer(text)]
    found.sort()
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def examples(n: int = 420, seed: int = 5) -> list[tuple[str, list[tuple[str, str]]]]:
    """Generated lines with the entities in them, and look-alikes that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def card() -> str:
        body = r.choice("3456") + d(r.choice((12, 13, 14)))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(("", " ", "-"))
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4))

    def iban() -> str:
        cc, body = r.choice(("DE", "FR", "GB", "ES")), d(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in cc) + "00") % 97
        s = f"{cc}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    make = {
        "email": lambda: f"{w()}{r.choice(('.', '_', ''))}{w()}{r.choice((' at ', ' [at] ', '(at)', '@', ' @ '))}{w()}{r.choice((' dot ', ' [dot] ', '.'))}{r.choice(('com', 'org', 'net', 'de'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{r.randint(1, 9)} ({d(3)}) {d(3)}-{d(4)}", f"0{d(3)} {d(7)}")),
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": iban,
    }
    none = (lambda: d(r.randint(7, 24)), lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"{d(3)}.{d(4)}.{d(2)}", lambda: f"{r.randint(1990, 2020)} {r.randint(1990, 2020)} {r.randint(1990, 2020)}", lambda: f"{d(2)}.{d(6)}", lambda: f"{d(5)}-{d(5)}-{d(5)}")
    out = []
    for i in range(n):
        parts, gold = [w(), w()], []
        for _ in range(r.choice((1, 1, 2))):
            if i % 3 == 2:
                parts += [none[r.randrange(len(none))]()]
            else:
                kind = KINDS[r.randrange(len(KINDS))]
                if r.random() < 0.4:
                    parts.append(CUES[("phone", "card", "ssn", "ip", "email", "iban").index(kind)][0] + r.choice((":", "")))
                value = make[kind]()
                parts.append(value + r.choice(("", "", ",", ".")))
                gold.append((value, kind))
            parts.append(w())
        out.append((" ".join(parts), gold))
    return out


def train(rounds: int = 60) -> np.ndarray:
    """Weights by gradient ascent on the penalised likelihood of the generated lines."""
    data = []
    for text, gold in examples():
        at = {}
        for value, kind in gold:
            a = text.index(value)
            at[(a, a + len(value))] = KINDS.index(kind)
        for a, b in islands(text):
            x = Taught(Island(text, a, b))
            if x.segments:
                where = {c: k for k, c in enumerate(x.cuts)}
                data.append((x, {(where[s], where[e]): k for (s, e), k in at.items() if s in where and e in where and (where[s], where[e]) in set(x.segments)}))
    w, square = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-6)
    for _ in range(rounds):
        g = sum((x.gradient(w, gold)[0] for x, gold in data), np.zeros_like(w)) / len(data) - 1e-3 * w
        square += g * g
        w += 0.5 * g / np.sqrt(square)
    return w


def scan(text: str | None, w: np.ndarray) -> list[tuple[int, int, str]]:
    """Base spans, and the field's spans that overlap none of them."""
    if not text:
        return []
    base = base_spans(text)
    out = list(base)
    # by start, with the furthest end of the spans so far
    starts = sorted(a for a, _, _ in base)
    reach = list(accumulate((b for _, b, _ in sorted(base)), max))
    upto = lambda at: reach[at - 1] if at else -1
    for a, b in islands(text):
        if upto(bisect_right(starts, a)) >= b:
            continue
        for s, e, k in Island(text, a, b).best(w):
            if upto(bisect_left(starts, e)) <= s:
                out.append((s, e, KINDS[k]))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_pii(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc_id, spans`` (start, end, kind, value, base), one row a document."""
    sent = Sent(docs.sparkSession, train())

    def make():
        def run(x: dict) -> dict:
            out = []
            for t in x["text"]:
                spans = scan(t, sent.value)
                base = set(base_spans(t)) if spans else ()
                out.append([{"start": s[0], "end": s[1], "kind": s[2], "value": t[s[0] : s[1]], "base": s in base} for s in spans])
            return {"doc_id": x["doc_id"], "spans": out}

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, "doc_id long, spans array<struct<start:long,end:long,kind:string,value:string,base:boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
