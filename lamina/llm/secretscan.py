"""Secret scans with structural confirmation.

Base kinds are plain patterns (assigned passwords and tokens, access-key ids,
long hex runs). The method adds what it can confirm by decoding: runs of base64
or hex are decoded and reported only if the bytes parse as private key material (DER
whose nested lengths add up and whose fields are those of a private key or a key
store, an OpenSSH private key; public keys and certificates are no secrets) or, for
dotted segments, if the first decodes to the header of a signed token (three of them)
or of an encrypted one (five). PEM private-key blocks are confirmed the same way.
Base64 wrapped over lines, by line ends or by the escapes of JSON strings, is joined
before it is decoded.

Edge cases: null and empty texts have no spans; texts of any length are scanned
whole; repeated rows and null ids keep their rows; an empty table gives an empty
result; other columns, whatever their names, aren't read; the stage keeps them.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, table

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt", "jwe", "pem")
BASE = KINDS[:3]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
LONG = 24
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
HEXRUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{2}){24,}(?![0-9A-Fa-f])|(?<![0-9A-Fa-f])(?:[0-9A-F]{2}){24,}(?![0-9A-Fa-f])")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]*){2,}")
#: What isn't base64 in wrapped base64: white space, its escapes in JSON strings, backslashes before a slash.
BREAK = re.compile(r"\s|\\+[nrt]|\\+(?=/)")
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=]|{BREAK.pattern}){{16,}})-----END \1-----")
LINE = rf"(?:[A-Za-z0-9+/_-]|\\+(?=/))++"
#: Where base64 begins as a DER sequence or an OpenSSH private key does; its first line, and those that follow.
BEGINS = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt]))(?=M[A-P]|b3Bl)")
FIRST = re.compile(rf"({LINE})")
NEXT = re.compile(rf"[ \t]*+(?:\r?\n|(?:\\+r)?\\+n)[ \t]*+({LINE})")


def decoded(run: str) -> bytes:
    """Bytes of a base64 run in either alphabet; empty if it is none."""
    run = run.rstrip("=").translate({45: 43, 95: 47})
    if len(run) % 4 == 1:
        return b""
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_end(data: bytes, at: int, depth: int = 0) -> int:
    """Where the DER value at ``at`` ends, with all nested lengths right; -1 if they aren't."""
    if at + 2 > len(data) or depth > 16:
        return -1
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return -1
        n = int.from_bytes(data[at : at + k], "big")
        if n < 0x80 or k > 1 and n >> (8 * (k - 1)) == 0:
            return -1
        at += k
    end = at + n
    if end > len(data):
        return -1
    if tag & 0x20:
        while at < end:
            at = der_end(data, at, depth + 1)
            if at < 0:
                return -1
        if at != end:
            return -1
    return end


def der_parts(data: bytes) -> list[tuple[int, bytes]]:
    """Tags and contents of the values in a DER sequence whose lengths are known to be right."""

    def value(at: int) -> tuple[int, int, int]:
        n, start = data[at + 1], at + 2
        if n >= 0x80:
            n, start = int.from_bytes(data[start : start + (n & 0x7F)], "big"), start + (n & 0x7F)
        return data[at], start, start + n

    _, at, end = value(0)
    out = []
    while at < end:
        tag, start, at = value(at)
        out.append((tag, data[start:at]))
    return out


# DER tags.
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_key_der(data: bytes) -> bool:
    """A private key or a key store in DER that fills the bytes.

    RSA and DSA: a small version and five integers or more; EC: version and octets;
    PKCS #8: version, algorithm and octets; encrypted: algorithm and octets; PKCS #12:
    version 3 and content that an object identifier names.
    """
    if len(data) < 16 or data[0] != SEQUENCE or der_end(data, 0) != len(data):
        return False
    got = der_parts(data)
    tags = [t for t, _ in got]
    names = [t == SEQUENCE and v[:1] == bytes([OBJECT]) for t, v in got]
    version = got[0][1][0] if tags[0] == INTEGER and len(got[0][1]) == 1 else -1
    if version < 0:
        return len(got) == 2 and names[0] and tags[1] == OCTETS and len(got[1][1]) >= 16
    if len(got) >= 6 and all(t == INTEGER for t in tags[:6]):
        return version <= 1
    if tags[1:2] == [OCTETS]:
        return version <= 1 and len(got[1][1]) >= 16
    return len(got) >= 2 and names[1] and (version <= 1 and tags[2:3] == [OCTETS] or version == 3)


def is_openssh(data: bytes) -> bool:
    return data.startswith(b"openssh-key-v1\0")


def structure(data: bytes) -> str | None:
    return None if len(data) < 16 else "der" if is_key_der(data) else "openssh" if is_openssh(data) else None


def wrapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Key material in base64 that runs over lines: the lines that make up the length it tells."""
    spans = []
    for m in BEGINS.finditer(text):
        at, want, total, lines = m.start(), 0, 0, []
        line = FIRST.match(text, at)
        while line:
            lines.append(BREAK.sub("", line[1]))
            total += len(lines[-1])
            if len(lines) == 1 and lines[0][0] == "M":
                head = decoded(BREAK.sub("", text[at : at + 40])[:8])
                if head[:1] != b"\x30":
                    break
                k = head[1] & 0x7F if head[1] >= 0x80 else 0
                n = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
                want = -(-n * 4 // 3)
            if want and (total > want or want > len(text) - at):
                break
            after, last = NEXT.match(text, line.end()), len(lines[-1]) != len(lines[0])
            if total == want or not want and (last or not after):
                if kind := structure(decoded("".join(lines))):
                    end = line.end()
                    while end < min(len(text), line.end() + 2) and text[end] == "=":
                        end += 1
                    spans.append((at, end, kind))
                    break
            line = None if last and not want else after
    return spans


def as_json(segment: str):
    try:
        return json.loads(decoded(segment))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None


def token(dotted: str) -> tuple[str, int] | None:
    """Kind and length of the token that dotted segments begin with, full stops after it aside.

    By a JSON header that names its algorithm: three segments, the second a JSON body
    and the third perhaps empty, are a signed token; five are an encrypted one.
    """
    core = dotted.rstrip(".")
    parts = core.split(".")
    head = as_json(parts[0])
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return None
    if len(parts) == 3 or len(parts) == 2 and len(core) < len(dotted):
        return ("jwt", len(core) + (len(parts) == 2)) if len(parts[1]) > 1 and isinstance(as_json(parts[1]), dict) else None
    # key (empty if it was agreed on), vector, text and tag
    return ("jwe", len(core)) if len(parts) == 5 and isinstance(head.get("enc"), str) and all(parts[2:]) else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    low, spans = text.lower(), []
    if any(w in low for w in WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if any(len(w) >= LONG for w in text.split()):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    if "-----BEGIN" in text:
        spans += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if structure(decoded(BREAK.sub("", m[2])))]
    spans += wrapped_spans(text)
    if not any(len(w) >= LONG for w in text.split()):
        return spans
    spans += [(m.start(), m.start() + got[1], got[0]) for m in DOTTED.finditer(text) if (got := token(m[0]))]
    for m in RUN.finditer(text):
        if kind := structure(decoded(m[0])):
            spans.append((m.start(), m.end(), kind))
    for m in HEXRUN.finditer(text):
        if kind := structure(bytes.fromhex(m[0])):
            spans.append((m.start(), m.end(), kind))
    return spans


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in order of start, then of kind."""
    if not text:
        return []
    found = set(base_spans(text)) | set(confirmed_spans(text))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc_id, spans`` (start, end, kind, value), one row a document."""

    def make():
        def run(x: dict) -> dict:
            return {"doc_id": x["doc_id"], "spans": [[{"start": a, "end": b, "kind": k, "value": t[a:b]} for a, b, k in scan(t)] for t in x["text"]]}

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, "doc_id long, spans array<struct<start:long,end:long,kind:string,value:string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(text: str | None) -> str | None:
    """The text with each group of overlapping spans put as [SECRET:kind]."""
    spans = scan(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i < len(spans) and spans[i][0] < end or i < len(spans) and spans[i][0] == start:
            end, i = max(end, spans[i][1]), i + 1
        out += [text[at:start], f"[SECRET:{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are blanked and n_chars follows."""

    bound_batches(spark)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t) for t in texts.to_pylist()], type=pa.string())

    x = docs.withColumn("text", clean("text"))
    return x.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)
