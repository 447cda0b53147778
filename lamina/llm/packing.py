"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows.

Documents are tokenised once; their ids (two bytes each where the vocabulary
allows) go to shards of about equal size by a seeded hash of the document, so a
source that holds a third of all rows is spread like any other. In a shard every
source has a queue; each window raises every source's deficit by its share of the
window, and serves the sources in turn from their queues, cutting documents
freely, until the window is full. Since a shard packs all it holds, the deficits
it ends with follow from token counts alone: target share x tokens - supply,
summed over the shards before. So shards run in parallel and still carry deficits
across partitions. Only a shard's last window can be padded.

Edge cases: a null or empty text is the end id alone; a null source is a queue of
its own; repeated rows are packed row by row; null ids are kept; an empty table
gives an empty result; a document longer than a window spans several; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from functools import cached_property, lru_cache
from itertools import chain, pairwise
from sys import maxunicode
from unicodedata import category, combining, is_normalized, normalize, ucd_3_2_0

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

try:
    from tiktoken import _tiktoken as tiktoken
except ImportError:  # the tokenizer's own model merges then
    tiktoken = None

from .common import map_batches, materialise, prefix_sums, table, tag, utf32

WINDOW = 2048
END_ID = 1
#: Characters in a shard; a task holds the ids of one shard at a time.
SHARD_CHARS = 6_000_000
#: Up to so many shards are a task each; beyond, a task packs at most so many, one after the other.
TASKS, SHARDS_A_TASK = 4096, 16
#: A source is served once its deficit reaches so many tokens, or its document ends.
LEAST_PIECE = 64
#: Words whose ids are copied at a time.
RUN = 1 << 18


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(1)
def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


#: Bytes as byte-level models write them.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


@lru_cache(4)
def merged_by_text(path: str) -> bool:
    """Whether the text of two neighbours tells alone if, and when, they merge.

    It does if ids rise with the merges and every token's own text, merged by itself,
    ends as that token. For merges go by rising rank, so what is merged inside a
    stretch of text before its rank's turn is the same wherever the stretch stands,
    as long as nothing was merged across its ends: the two parts left there are then
    those of its merge. Merging by text, as tiktoken does, gives the same ids.
    """
    conf = read(path)["model"]
    if conf["type"] != "BPE" or conf.get("end_of_word_suffix") != "</w>" or any(conf.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")):
        return False
    vocab, merges = conf["vocab"], {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(conf["merges"])}
    if len(vocab) != 512 + len(merges) or {vocab.get(c, -1) for c in SHOWN.values()} != {*range(256)} or {vocab.get(c + "</w>", -1) for c in SHOWN.values()} != {*range(256, 512)}:
        return False
    for (a, b), r in merges.items():
        whole = a + b
        parts = [*whole[:-4]] if whole.endswith("</w>") else [*whole]
        if not parts or vocab.get(whole) != 512 + r or max(vocab.get(a, len(vocab)), vocab.get(b, len(vocab))) >= 512 + r:
            return False
        if whole.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            ranks = [merges.get(pair, len(merges)) for pair in pairwise(parts)]
            if (least := min(ranks)) == len(merges):
                return False
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


def by_text(path: str) -> bool:
    """Whether ``path`` can be merged by text here: tiktoken is there, and its ids are the same."""
    return tiktoken is not None and merged_by_text(path)


class WordTokenizer:
    """The tokenizer's own ids, word by word: its pattern never joins across white space.

    The distinct words of a batch are cut into pieces by the tokenizer's pattern and
    merged in one call: by text where that gives the same ids (``merged_by_text``), else
    by the tokenizer's model. Every word's ids are then copied to where it stands. Texts
    with a control character that only Python takes for white space, with a sign or mark
    of newer Unicode, or with an added token go through the tokenizer whole.
    """

    def __init__(self, path: str, quick: bool | None = None):
        import regex

        conf = read(path)
        self.path, vocab = path, conf["model"]["vocab"]
        kinds = [n["type"] for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        split = [p for p in (conf.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and len(split) == 1 and bool(split[0]["invert"])
        self.added = [t["content"] for t in conf.get("added_tokens", [])]
        self.wide = 4 if max(*vocab.values(), *(t["id"] for t in conf.get("added_tokens", [])), 0) > 65_535 else 2
        self.type = np.dtype(f"<u{self.wide}")
        self.core = None
        if self.plain:
            self.pattern = regex.compile(split[0]["pattern"]["Regex"])
            if by_text(path) if quick is None else quick:
                # white space is never in a piece: a space is its end, a line feed a word's
                back = {c: b for b, c in SHOWN.items()}
                ranks = {bytes(map(back.__getitem__, t.removesuffix("</w>"))) + (b" " if t.endswith("</w>") else b""): i for t, i in vocab.items()}
                self.core, self.line = tiktoken.CoreBPE(ranks, {"\x1c": len(vocab)}, "[^ \n]+ |\n"), ranks[b"\n"]

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def unsure(self) -> np.ndarray:
        """By code point: whether Python's Unicode and the tokenizer's may differ. So may they on all marks but old ones."""
        old, unsure = ucd_3_2_0.combining, np.ones(maxunicode + 1, bool)
        unsure[:0x32400] = [category(c) == "Cn" or combining(c) != old(c) for c in map(chr, range(0x32400))]
        return unsure

    def _odd(self, text: str) -> bool:
        return any(a in text for a in self.added) or any(c in text for c in "\x1c\x1d\x1e\x1f") or not text.isascii() and bool(self.unsure[utf32(text)].any())

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.whole.model.tokenize("".join(map(SHOWN.__getitem__, piece.encode())))]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words, in order; where each word's begin, and how many they are."""
        find = self.pattern.findall
        if self.core:
            # a word of letters is one piece of the pattern: nothing else in it begins with a letter
            ends = [w + " \n" if w.isalpha() else "".join([p + " " for p in find(w)]) + "\n" for w in words]
            ids = np.frombuffer(self.core.encode_to_tiktoken_buffer("".join(ends), set()), np.uint32)
            stop = np.flatnonzero(ids == self.line)
            start = np.append(0, stop[:-1] + 1)[: len(stop)]
            return ids.astype(self.type), start, stop - start
        got = [[i for p in find(w) for i in self._piece(p)] for w in words]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.type, n.sum()), np.cumsum(n) - n, n

    def _lower(self, text: str) -> str:
        if not text.isascii():
            if not is_normalized("NFC", text):
                text = normalize("NFC", text)
            text = text.replace("Σ", "σ")  # sign by sign, as the tokenizer: no final form
        return text.lower()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed; none for null."""
        got, at, lower = [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.plain or self._odd(t):
                got[i] = self._pack(self.whole.encode(t, add_special_tokens=False).ids)
            else:
                at.append(i)
                lower.append(self._lower(t))
        if not at:
            return got
        words = pc.utf8_split_whitespace(pa.array(lower, pa.large_string()))
        coded = words.values.dictionary_encode()
        one = pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int64()), coded.dictionary)
        ids, start, n = self._words(pc.binary_join(one, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n"))
        code = coded.indices.to_numpy()
        before = np.append(0, np.cumsum(n[code]))
        out = np.empty(before[-1], self.type)
        for i in range(0, len(code), RUN):
            c, to = code[i : i + RUN], before[i : i + RUN + 1]
            out[to[0] : to[-1]] = ids[np.repeat(start[c] - to[:-1], n[c]) + np.arange(to[0], to[-1])]
        ends = before[words.offsets.to_numpy()].tolist()
        for i, (a, b) in zip(at, pairwise(ends), strict=True):
            got[i] = out[a:b].tobytes()
        return got

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]


@lru_cache(1)
def word_tokenizer(path: str, quick: bool) -> WordTokenizer:
    """Kept by a worker from task to task."""
    return WordTokenizer(path, quick)


def tokenise(docs: DataFrame, path: str, shards: int, seed: int, text: str = "text") -> DataFrame:
    """``doc_id, source, shard, at, n, ids``; ids end with the end id and are compressed."""

    quick = by_text(path)

    def make():
        import zstandard

        tokens, squeeze = word_tokenizer(path, quick), zstandard.ZstdCompressor(level=1)
        end = END_ID.to_bytes(tokens.wide, "little")

        def run(x: dict) -> dict:
            ids = [i + end for i in tokens.batch(x["text"])]
            return {"doc_id": x["doc_id"], "source": x["source"], "shard": x["shard"], "at": x["at"], "n": [len(i) // tokens.wide for i in ids], "wide": [tokens.wide] * len(ids), "ids": [squeeze.compress(i) for i in ids]}

        return run

    at = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")), F.lit(seed))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"), at.alias("at")).withColumn("shard", F.pmod(F.col("at"), F.lit(shards)).cast("long"))
    return map_batches(rows, make, "doc_id long, source string, shard long, at long, n long, wide int, ids binary")


def plan(counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """From tokens by shard and source: what each shard starts with.

    ``shard, kind, source, target`` (the source's share of all tokens), ``carry``
    (its deficit after the shards before) and ``first`` (the shard's first sequence).
    Sums over shards are taken in two levels: no task sees all shards.
    """
    counts = counts.withColumn("tag", tag("source"))
    shard = counts.groupBy("shard").agg(F.sum("n").alias("all_n")).withColumn("windows", F.ceil(F.col("all_n") / window).cast("long"))
    shard = prefix_sums(shard, [], "shard", {"all_before": "all_n", "first": "windows"}).select("shard", "all_before", "first")
    # one row a source
    share = counts.groupBy("tag").agg(F.sum("n").alias("source_n")).withColumn("target", F.col("source_n") / F.sum("source_n").over(Window.partitionBy(F.lit(1))))
    had = prefix_sums(counts, ["tag"], "shard", {"had": "n"})
    x = had.join(shard, "shard").join(share, "tag")
    return x.select("shard", "source", "target", (F.col("target") * F.col("all_before") - F.col("had")).alias("carry"), F.col("first").cast("long").alias("first"))


def pack_shard(shares: list[tuple], docs: list[tuple], first: int, window: int = WINDOW, least: int = LEAST_PIECE):
    """Pieces ``(document index, start, length, sequence, offset)`` by deficit round-robin.

    ``shares``: (source, share, carried deficit); ``docs``: (source, tokens).
    """
    queues: dict = {s: deque() for s, _, _ in shares}
    for i, (source, n) in enumerate(docs):
        queues[source].append([i, 0, n])
    order = [s for s, _, _ in shares]
    share = {s: q for s, q, _ in shares}
    deficit = {s: c for s, _, c in shares}
    live, sequence, turn = [s for s in order if queues[s]], first, 0
    while live:
        used, pieces = 0, []
        for s in order:
            deficit[s] += share[s] * window

        def serve(s, most: int) -> None:
            nonlocal used
            queue = queues[s]
            while most > 0 and queue:
                head = queue[0]
                take = min(most, head[2] - head[1])
                if pieces and pieces[-1][0] == head[0]:
                    pieces[-1][2] += take
                else:
                    pieces.append([head[0], head[1], take, sequence, used])
                head[1] += take
                used += take
                most -= take
                deficit[s] -= take
                if head[1] == head[2]:
                    queue.popleft()

        for k in range(len(live)):
            s = live[(turn + k) % len(live)]
            if used < window and deficit[s] >= 1 and (deficit[s] >= least or queues[s] and queues[s][0][2] - queues[s][0][1] <= deficit[s]):
                serve(s, min(window - used, int(deficit[s])))
        live = [s for s in live if queues[s]]
        while used < window and live:
            serve(max(live, key=lambda s: deficit[s]), min(window - used, window // 8))
            live = [s for s in live if queues[s]]
        turn += 1
        sequence += 1
        yield from pieces


def pack(docs: DataFrame, *, path: str | None = None, window: int = WINDOW, shard_chars: int = SHARD_CHARS, seed: int = 11, text: str = "text") -> DataFrame:
    """Every id of every document in exactly one piece; see the module."""
    path = path or tokenizer_path()
    chars = docs.select(F.sum(F.char_length(text).cast("long") + 1)).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    rows = materialise(tokenise(docs, path, shards, seed, text), "pack-ids")
    starts = plan(materialise(rows.groupBy("shard", "source").agg(F.sum("n").alias("n")), "pack-counts"), window)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = starts.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "source", "target", "carry", "first", none("long", "doc_id"), none("long", "n"), none("int", "wide"), none("binary", "ids"))
    tails = rows.select("shard", F.lit(1).alias("kind"), "at", "source", none("double", "target"), none("double", "carry"), none("long", "first"), "doc_id", "n", "wide", "ids")

    def make():
        import zstandard

        held: dict = {"shard": None}
        out = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")

        def done() -> dict | None:
            if held["shard"] is None or not held["docs"]:
                return None
            open_, docs = zstandard.ZstdDecompressor(), held["docs"]
            got: dict = {k: [] for k in out}
            ids: dict[int, np.ndarray] = {}
            left = {i: d[2] for i, d in enumerate(docs)}
            shares = sorted(held["shares"], key=lambda s: (s[0] is None, s[0] or ""))
            for i, start, length, sequence, offset in pack_shard(shares, [(d[1], d[2]) for d in docs], held["first"], window):
                if i not in ids:
                    ids[i] = np.frombuffer(open_.decompress(docs[i][4]), dtype="<u2" if docs[i][3] == 2 else "<u4").astype("<u4")
                for k, v in zip(out, (docs[i][0], start, length, zlib.crc32(ids[i][start : start + length]), docs[i][2], sequence, offset, docs[i][1]), strict=True):
                    got[k].append(v)
                left[i] -= length
                if not left[i]:
                    del ids[i]
            return got

        def run(x: dict) -> dict | None:
            parts = []
            for row in zip(*(x[k] for k in ("shard", "kind", "source", "target", "carry", "first", "doc_id", "n", "wide", "ids")), strict=True):
                if row[0] != held["shard"]:
                    parts.append(done())
                    held.update(shard=row[0], shares=[], docs=[], first=0)
                if row[1] == 0:
                    held["shares"].append((row[2], row[3], row[4]))
                    held["first"] = row[5]
                else:
                    held["docs"].append((row[6], row[2], row[7], row[8], row[9]))
            parts = [p for p in parts if p]
            return {k: [v for p in parts for v in p[k]] for k in out} if parts else None

        run.finish = done
        return run

    # tasks grow with the shards: one each at first, SHARDS_A_TASK each where they would be too many
    tasks = max(1, -(-shards // SHARDS_A_TASK), min(shards, TASKS))
    dealt = heads.unionByName(tails).repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "at", "doc_id", "n")
    return map_batches(dealt, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def padding(pieces: DataFrame, window: int = WINDOW) -> Column | DataFrame:
    """Tokens and padding over all sequences."""
    x = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return x.agg(F.sum("used").alias("tokens"), F.sum(window - F.col("used")).alias("padding"), F.count(F.lit(1)).alias("sequences"))
