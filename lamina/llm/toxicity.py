"""Toxicity by noisy-channel deobfuscation, then a score of the restored text.

Channel: a letter may be written as a look-alike sign, digit or foreign letter, be
repeated, be followed by an invisible sign, or be held apart from the next one by
marks and white space of any kind. Stretches of text are lattices of these options;
Viterbi finds the likeliest letters under a character trigram model whose counts
cover all documents, times channel costs. Stretches without a letter (numbers) stay.

Which stretches: text and scored word parts are folded alike, every option of the
channel to one class (look-alikes to one letter, repeats to one, marks and white
space to nothing). Wherever a folded part occurs in the folded text, the tokens it
lies in are decoded; elsewhere no path of the lattice spells a part that counts.
A text with signs that are marks as well as letters is folded both ways, and one
with asterisks also with all vowels in one class; tokens with one are all decoded.

Scoring: words, and beginnings and ends by what they tell besides the word that has
them most often, get the lower confidence bound of their log-odds between toxic and clean labelled documents, if a Chernoff bound on
their counts says that so uneven a split is rarer by chance than one in the number
of words that toxic documents have, and the score is at least ``LEAST_SCORE``. A text's features are its two highest stretches and how many stand out,
weighed by a logistic regression that is fitted on scores which each of ``TURNS``
parts of the sample gets from what the others taught.

Learnt from: a seeded sample, by document, of about ``LEAST_TOXIC`` toxic and
``MOST_CLEAN`` clean labelled documents (parameters of ``train``). Words are
counted, and the sample scored, on executors; to the driver come trigram counts, the
parts that passed the bound, and three numbers a sampled document.

Edge cases: null and empty texts get the score of a text in which nothing stands
out; an empty table of documents gives an empty result; with no usable labels every
score is 0; repeated rows get equal scores; a document labelled more than once counts
once for each label it has; texts of any length are read whole; a document column
named ``_lm_score`` is the one name that the stage can't take; others aren't read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, Sent, bound_batches, held_out, map_batches, materialise, table, utf32

LEAST_TOXIC = 4000
MOST_CLEAN = 8000
#: Deviations of the log-odds that a score lies below its estimate.
DEVIATIONS = 1.64
#: Log-odds that a part must have at least, by the lower bound; words that just one language has more of lie below.
LEAST_SCORE = 1.0
#: Parts of the sample, each scored by what the others taught.
TURNS = 5

# Which letters a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "¡": "i", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
# Foreign letters that look like Latin ones.
ALIKE = dict(zip("асеорхуіѕјӏԁһкмтвнαορεικντυ", "aceopxyisjldhkmtbhaopeikvtu", strict=True))
#: Signs of LOOKS that are marks as often as letters.
EITHER = "|*(+#!"
SIGN_COST, WILD_COST, ALIKE_COST, DROP_COST, JOIN_COST, REPEAT_COST, KEEP_COST = -1.5, -2.5, -2.5, -0.7, -1.5, -1.0, -4.0
LETTERS = re.compile(r"[^\W\d_]+")
ANY_SIGN = re.compile(rf"[{re.escape(''.join(c for c in LOOKS if not c.isdigit()))}]")
STARRED = re.compile(r"\S*\*\S*")
#: Signs around a token.
AROUND = re.compile(r"^[\W_]+|[\W_]+$")
ENDS = ".,;:?\"'()[]{}"
SIZE = 64
#: Characters folded at once.
CHUNK = 1_000_000
EDGE = 63


def symbol_table() -> np.ndarray:
    """For code points below 0x10000: 0 for what is no letter, 1 to 26 for a to z, else 27 to 63."""
    out = np.zeros(0x10000, dtype=np.int32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return out


def symbol(c: str) -> int:
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else 27 + o % 37 if c.isalpha() else 0


@cache
def plain_letter(c: str) -> str:
    """The Latin letter that a lower-case letter is, has as its base, or looks like; else the letter itself."""
    base = unicodedata.normalize("NFKD", c)[0].lower()
    return base if "a" <= base <= "z" else ALIKE.get(c, c)


@cache
def invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Mn", "Me")


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Character trigram counts over all documents; at most ``SIZE`` cubed rows reach the driver."""

    def make():
        table, total = symbol_table(), np.zeros(SIZE**3, dtype=np.int64)

        def run(x: dict) -> None:
            texts = [t for t in x["text"] if t]
            for a in range(0, len(texts), 256):
                codes = utf32("\n" + "\n".join(texts[a : a + 256]).lower() + "\n")
                s = np.where(codes < 0x10000, table[np.minimum(codes, 0xFFFF)], 27 + (codes % 37).astype(np.int32))
                if len(s) > 2:
                    total[:] += np.bincount(s[:-2] * (SIZE * SIZE) + s[1:-1] * SIZE + s[2:], minlength=SIZE**3)

        def finish() -> dict:
            at = np.nonzero(total)[0]
            return {"at": at.astype(np.int64), "n": total[at]}

        run.finish = finish
        return run

    rows = map_batches(docs.select(F.col(text).alias("text")), make, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows["at"].to_numpy(int)] = rows["n"]
    return out


def options(c: str, before: str) -> list[tuple[str | None, float]]:
    """What a sign of a stretch may stand for, with costs; None: nothing at all."""
    if c == " ":
        return [(None, JOIN_COST), (" ", 0.0)]
    if c.isalpha():
        out: list[tuple[str | None, float]] = [(c, 0.0)]
        if (p := plain_letter(c)) != c:
            out.append((p, ALIKE_COST))
        return [*out, (None, REPEAT_COST)] if before == c else out
    if invisible(c):
        return [(None, 0.0)]
    looks = LOOKS.get(c, "")
    out = [(x, SIGN_COST if len(looks) < 3 else WILD_COST) for x in looks]
    if not c.isdigit():
        out.append((None, DROP_COST))
    return [*out, (" ", KEEP_COST if looks else -1.5)]


class CharModel:
    """Interpolated trigram log-probabilities over symbols."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * SIZE)
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 4 * p2[None]) / (three.sum(axis=2, keepdims=True) + 4)
        self.table, self.log = np.log(p3).astype(np.float32).ravel(), None

    def __getstate__(self):
        return {"table": self.table, "log": None}

    def restore(self, stretch: str) -> str:
        """The likeliest letters behind a stretch; words stay apart by spaces."""
        if self.log is None:
            self.log = self.table.tolist()
        log, before = self.log, ""
        paths = {(0, 0): (0.0, None)}  # the last two symbols: score, letters so far as a linked list
        for c in stretch:
            choice = options(c, before)
            if not invisible(c):
                before = c
            after: dict = {}
            for (a, b), (score, chain) in paths.items():
                for x, cost in choice:
                    if x is None:
                        key, value, link = (a, b), score + cost, chain
                    else:
                        s = symbol(x)
                        key, value, link = (b, s), score + cost + log[a * SIZE * SIZE + b * SIZE + s], (x, chain)
                    if key not in after or value > after[key][0]:
                        after[key] = (value, link)
            paths = after
        _, chain = max(((score + log[a * SIZE * SIZE + b * SIZE], chain) for (a, b), (score, chain) in paths.items()), key=lambda p: p[0])
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return "".join(reversed(out))


def separated(stretch: str) -> str:
    """White space and the marks around it as one space."""
    return re.sub(rf"[^\w\s{re.escape(''.join(LOOKS))}]*\s+[^\w\s{re.escape(''.join(LOOKS))}]*", " ", stretch)


def plain_words(stretch: str) -> list[str]:
    return LETTERS.findall(stretch)


def restored_words(stretch: str, model: CharModel) -> list[str]:
    """Words of a lower-case stretch as restored, if the channel has a choice in it."""
    core = separated(stretch.strip(ENDS))
    if not any(map(str.isalpha, core)) or all(len(options(c, b)) == 1 for c, b in zip(core, "\0" + core, strict=False)) and core.isalpha():
        return []
    return LETTERS.findall(model.restore(core))


def beginnings(word: str) -> list[str]:
    """A word itself, between signs for its ends, and its beginnings."""
    w = f"^{word}$"
    return [w, *(w[:k] for k in range(5, min(len(w), 10)))]


def endings(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[-k:] for k in range(5, min(len(w), 10))]


@cache
def folds() -> dict[str, np.ndarray]:
    """Class of each code point below 0x20000: 0 is left out, ``EDGE`` parts texts.

    ``letters``: all look-alike signs are letters; ``some``: those of ``EITHER`` are
    marks; ``none``: all but digits are marks; ``vowels``: vowels and asterisks are one.
    """
    same = {"l": "i", "g": "b"}
    out = np.zeros(0x20000, dtype=np.uint8)
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            p = plain_letter(chr(c).lower()[0])
            out[c] = ord(same.get(p, p)) - 96 if "a" <= p <= "z" else 27 + c % 35
    tables = {k: out.copy() for k in ("letters", "some", "none")}
    for k, t in tables.items():
        for c, looks in LOOKS.items():
            if c != "*" and (c.isdigit() or k == "letters" or k == "some" and c not in EITHER):
                t[ord(c)] = ord(same.get(looks[0], looks[0])) - 96
        t[0] = EDGE
    tables["vowels"] = tables["letters"].copy()
    tables["vowels"][ord("*")] = 1
    tables["vowels"][np.isin(tables["vowels"], [ord(c) - 96 for c in "aeiou"])] = 1
    return tables


@cache
def kinds_of_signs() -> tuple[np.ndarray, np.ndarray]:
    """Which code points below 0x20000 are white space or part texts, and which are letters."""
    some = [chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(0x20000)]
    return np.array([c == "\0" or c.isspace() for c in some]), np.array([c.isalpha() for c in some])


def folded(codes: np.ndarray, table: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The folded text, a character for each run of a class; where its classes stand, and which of these begin a run."""
    k = table[codes]
    at = np.nonzero(k)[0]
    k = k[at]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (k[1:] == EDGE)
    return k[new].tobytes().decode("latin-1"), at, np.nonzero(new)[0]


#: Where a part stands in its word: at its start, at its end, or both.
AT_START, AT_END, WHOLE = 1, 2, 4


def automaton(features, table: np.ndarray):
    """Finds folded features; a match's value is 8 times its length plus the places that they may stand in."""
    import ahocorasick

    keys: dict[str, int] = {}
    for f in features:
        codes = np.minimum(utf32(f.strip("^$")), 0x1FFFF)
        if len(key := folded(codes, table)[0]):
            keys[key] = keys.get(key, 0) | (WHOLE if f[0] == "^" and f[-1] == "$" else AT_START if f[0] == "^" else AT_END)
    found = ahocorasick.Automaton()
    for key, where in keys.items():
        found.add_word(key, 8 * len(key) + where)
    found.make_automaton()
    return found


class Scorer:
    """Word scores from a dict of feature scores, and the weights of a text's features."""

    def __init__(self, model: CharModel, features: dict[str, float], weights: list[float] | None):
        self.model, self.features, self.weights = model, features, weights
        self.memo = self.find = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None, "find": None}

    def word(self, word: str, whole: bool = False) -> float:
        """A word's score; ``whole``: by itself and its beginnings alone."""
        return max([0.0, *(self.features.get(f, 0.0) for f in (beginnings(word) if whole else [*beginnings(word), *endings(word)]))])

    def stretch(self, stretch: str) -> float:
        # a number at a word's end can read as many endings, so restored words are held to more
        return max([0.0, *map(self.word, plain_words(stretch)), *(self.word(w, True) for w in restored_words(stretch, self.model))])

    def stretches(self, texts: list[str]) -> list[set[str]]:
        """For each text its lower-case stretches in which some path of the lattice spells a feature."""
        if self.find is None:
            self.memo = Memo(self.stretch, 100_000)
            f = folds()
            self.find = {k: automaton(self.features, f[k]) for k in ("letters", "vowels")}
        out: list[set[str]] = [set() for _ in texts]
        if not self.features:
            return out
        signs = [i for i, t in enumerate(texts) if ANY_SIGN.search(t)]
        stars = [i for i in signs if "*" in texts[i]]
        for fold, some in (("letters", range(len(texts))), ("some", signs), ("none", signs), ("vowels", stars)):
            part, size = [], 0
            for i in some:
                part.append(i)
                size += len(texts[i])
                if size >= CHUNK:
                    self.search(texts, part, fold, out)
                    part, size = [], 0
            if part:
                self.search(texts, part, fold, out)
        for i in stars:
            out[i].update(t for t in STARRED.findall(texts[i].lower()) if any(map(str.isalpha, t)))
        return out

    def search(self, texts: list[str], which: list[int], fold: str, out: list[set[str]]) -> None:
        joined = "\0" + "\0".join(texts[i].replace("\0", " ") for i in which) + "\0"
        codes = np.minimum(utf32(joined), 0x1FFFF)
        text, at, runs = folded(codes, folds()[fold])
        got = list(self.find["vowels" if fold == "vowels" else "letters"].iter(text))
        if not got:
            return
        end, value = (np.array(v) for v in zip(*got, strict=True))
        space, letter = (k[codes] for k in kinds_of_signs())
        # two letters side by side are in one word on every path: words start and end only elsewhere
        beside = letter[1:] & letter[:-1]
        start = np.maximum.reduceat(np.where(np.append(False, beside)[at], -1, at), runs)
        stop = np.minimum.reduceat(np.where(np.append(beside, False)[at], len(codes), at), runs)
        first, last = start[end - value // 8 + 1], stop[end]
        starts, ends = first >= 0, last < len(codes)
        good = (starts & (value & AT_START > 0)) | (ends & (value & AT_END > 0)) | (starts & ends & (value & WHOLE > 0))
        if not good.any():
            return
        low = np.where(starts, first, at[runs][end - value // 8 + 1])[good]
        high = np.where(ends, last, at[runs][end])[good]
        gaps = np.nonzero(space)[0]
        low, high = gaps[np.searchsorted(gaps, low) - 1] + 1, gaps[np.searchsorted(gaps, high)]
        # matches that share a token are one stretch
        order = np.lexsort((high, low))
        low, high = low[order], np.maximum.accumulate(high[order])
        first = np.append(True, low[1:] > high[:-1])
        low, high = low[first], high[np.append(np.nonzero(first)[0][1:] - 1, len(high) - 1)]
        starts = np.cumsum([1, *(len(texts[i]) + 1 for i in which)])
        for d, a, b in zip((np.searchsorted(starts, low, side="right") - 1).tolist(), low.tolist(), high.tolist(), strict=True):
            out[which[d]].add(joined[a:b].lower())

    def text_features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, some in enumerate(self.stretches([t or "" for t in texts])):
            if some:
                high = sorted((s for s in map(self.memo.__getitem__, some) if s), reverse=True)
                out[i] = (high[0] if high else 0.0, high[1] if len(high) > 1 else 0.0, np.log1p(len(high)))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        z = self.text_features(texts) @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def bag(text: str, restored: Memo) -> set[str]:
    """Distinct words of a text as it is, and of tokens with signs inside and runs of single signs as restored."""
    low = text.lower()
    found = set(LETTERS.findall(low))
    tokens = low.split()
    for t in set(tokens):
        if not t.isalpha() and not AROUND.sub("", t).isalpha():
            found.update(restored[t])
    run: list[str] = []
    for t in [*tokens, "  "]:
        if len(t.strip(ENDS)) == 1:
            run.append(t)
        else:
            if len(run) > 2:
                found.update(restored[" ".join(run)])
            run = []
    return found


def cells() -> list[str]:
    """Names of the counts: documents of turn t with label y."""
    return [f"c{t}{y}" for t in range(TURNS) for y in (0, 1)]


def word_counts(sample: DataFrame, model: Sent) -> DataFrame:
    """``word`` with its documents by turn and label, perhaps in several rows: each task sums what it has."""

    def make():
        restored, held = Memo(lambda t: restored_words(t, model.value), 50_000), Counter()

        def rows() -> dict:
            words = sorted({w for _, w in held})
            out = {"word": words, **{c: [held[(c, w)] for w in words] for c in cells()}}
            held.clear()
            return out

        def run(x: dict) -> dict | None:
            for t, y, text in zip(x["turn"], x["toxic"], x["text"], strict=True):
                held.update((f"c{t}{y}", w) for w in bag(text or "", restored))
            return rows() if len(held) > 150_000 else None

        run.finish = rows
        return run

    return map_batches(sample.select("turn", "toxic", "text"), make, "word string, " + ", ".join(f"{c} long" for c in cells()))


class Judge:
    """The bound and the scores of parts, from the words that documents of each turn and label have in all."""

    def __init__(self, total: dict[str, int], toxic_words: int):
        self.clean, self.toxic = (np.array([total[f"c{t}{y}"] for t in range(TURNS)], dtype=float) for y in (0, 1))
        self.bound = float(np.log(max(2, toxic_words)))
        self.clean, self.toxic = (np.append(v.sum() - v, v.sum()) for v in (self.clean, self.toxic))
        #: The toxic documents' share of words, as the other turns, and at last as all turns, have it.
        self.share = (self.toxic + 0.5) / (self.clean + self.toxic + 1)
        self.shift = np.log((self.clean + 1) / (self.toxic + 1))
        #: What a part needs to pass the bound even if no clean document has it.
        self.least = self.bound / -np.log(self.share.min())

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Of counts by turn and label, the score for each turn as the others teach, and as all teach; NaN below the bound."""
        down, up = (np.append(v.sum() - v, v.sum()).astype(float) for v in (counts[0::2], counts[1::2]))
        with np.errstate(all="ignore"):
            share = up / (up + down)
            # Chernoff: so uneven a split has at most exp(-n KL) chance
            uneven = up * np.log(share / self.share) + np.where(down > 0, down * np.log((1 - share) / (1 - self.share)), 0.0)
            score = np.log((up + 0.5) / (down + 0.5)) + self.shift - DEVIATIONS * np.sqrt(1 / (up + 0.5) + 1 / (down + 0.5))
            return np.where((share > self.share) & (uneven > self.bound) & (score >= LEAST_SCORE), score, np.nan)

    def group(self, words: dict[str, np.ndarray], parts) -> list[tuple[int, str, float]]:
        """``(turn, part, score)`` of the parts of words, which hold all the words that have them."""
        up: Counter = Counter()
        for w, n in words.items():
            if toxic := int(n[1::2].sum()):
                for p in parts(w):
                    up[p] += toxic
        sums = {p: np.zeros(2 * TURNS, dtype=np.int64) for p, n in up.items() if n > self.least}
        if not sums:
            return []
        top: dict[str, tuple] = {}
        for w, n in words.items():
            for p in parts(w):
                if p in sums:
                    sums[p] += n
                    top[p] = max(top.get(p, (-1, "")), (int(n[1::2].sum()), w))
        out = []
        for p, n in sums.items():
            # what a beginning or an end tells of other words than the one that has it most often
            score = self.scores(n if p[0] == "^" and p[-1] == "$" else n - words[top[p][1]])
            out += [(k, p, float(v)) for k, v in enumerate(score) if not np.isnan(v)]
        return out


def word_scores(words: DataFrame) -> list[dict[str, float]]:
    """Scores of the parts that stand out: for each turn as the others teach, then as all teach.

    Words meet twice, by their first and by their last four letters, which all their
    beginnings and ends share; only parts that pass come to the driver.
    """
    words = materialise(words, "toxic-words")
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cells()]).first().asDict()
    toxic = sum((F.col(f"c{t}1") for t in range(TURNS)), F.lit(0))
    judge = Judge(total, words.filter(toxic > 0).select("word").distinct().count())
    rows = words.select(F.explode(F.array(F.concat(F.lit("^"), F.left("word", F.lit(4))), F.concat(F.right("word", F.lit(4)), F.lit("$")))).alias("g"), "word", *cells())

    def make():
        held: dict = {"g": None, "words": {}}

        def close() -> list[tuple]:
            return judge.group(held["words"], beginnings if held["g"][0] == "^" else endings) if held["words"] else []

        def columns(got: list[tuple]) -> dict:
            return {"k": [x[0] for x in got], "part": [x[1] for x in got], "score": [x[2] for x in got]}

        def run(x: dict) -> dict:
            got: list[tuple] = []
            for g, w, *n in zip(x["g"], x["word"], *(x[c] for c in cells()), strict=True):
                if g != held["g"]:
                    got += close()
                    held.update(g=g, words={})
                held["words"][w] = held["words"].get(w, 0) + np.array(n)
            return columns(got)

        run.finish = lambda: columns(close())
        return run

    found = map_batches(rows.repartition("g").sortWithinPartitions("g"), make, "k int, part string, score double")
    out: list[dict[str, float]] = [{} for _ in range(TURNS + 1)]
    for r in found.collect():
        out[r["k"]][r["part"]] = r["score"]
    return out


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Newton steps of an L2-regularised logistic regression; the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.5] * (x.shape[1] - 1) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge @ w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, least_toxic: int = LEAST_TOXIC, most_clean: int = MOST_CLEAN) -> Scorer:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. Labels with ``usable`` false aren't learned from."""
    spark = docs.sparkSession
    model = CharModel(trigram_counts(docs))
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = (known.filter(usable) if usable is not None else known).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Scorer(model, {}, None)
    draw = lambda y, most: (F.col("toxic") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(20_011)), F.lit(1_000_003)) <= min(1.0, most / n[y]) * 1_000_003)
    # a table of its own, so that Spark knows its size when it picks the join
    drawn = materialise(known.filter(draw(1, least_toxic) | draw(0, most_clean)), "toxic-drawn")
    turn = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(TURNS)).cast("int")
    sample = materialise(docs.select("doc_id", "text").join(drawn, "doc_id").select(turn.alias("turn"), "toxic", "text"), "toxic-sample")
    sent = Sent(spark, model)
    features = word_scores(word_counts(sample, sent))
    sent.drop()
    scorers = Sent(spark, [Scorer(model, f, None) for f in features[:TURNS]])

    def make():
        def run(x: dict) -> dict:
            got, turn = np.zeros((len(x["text"]), 3)), np.array(x["turn"])
            for t in set(x["turn"]):
                at = np.nonzero(turn == t)[0]
                got[at] = scorers.value[t].text_features([x["text"][i] for i in at])
            return {"toxic": x["toxic"], "a": got[:, 0], "b": got[:, 1], "c": got[:, 2]}

        return run

    got = map_batches(sample, make, "toxic int, a double, b double, c double").toPandas().sort_values(["toxic", "a", "b", "c"])
    scorers.drop()
    y = got["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return Scorer(model, {}, None)
    weight = np.where(y == 1, max(1.0, n[1] / least_toxic), max(1.0, n[0] / most_clean))
    return Scorer(model, features[TURNS], regression(got[["a", "b", "c"]].to_numpy(), y, weight / weight.mean()))


def score(model: Scorer, text: Column, spark: SparkSession) -> Column:
    sent = Sent(spark, model)
    bound_batches(spark)

    @F.arrow_udf("double")
    def tell(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts.to_pylist()), type=pa.float64())

    return tell(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    x = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(model, F.col("text"), spark).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return docs.withColumn("_lm_score", score(model, F.col("text"), spark)).filter(F.col("_lm_score") < 0.5).select(*docs.columns)
