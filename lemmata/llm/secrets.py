"""Secret scans with structural confirmation.

Three base patterns report what looks like a secret by its shape. On top of them, candidates of base64 or hex are
decoded and reported only if what they decode to holds together: DER whose nested lengths fill their parents and whose
outline is that of a key, SSH wire strings whose lengths fill the blob, a signed token whose header is JSON that names an
algorithm, or text that itself holds a base secret.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.common import slices
from lemmata.shipping import map_arrow

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "signed_token", "der_key", "ssh_key", "wrapped")

ALPHABETS = ("A-Za-z0-9+/", "A-Za-z0-9_-")
#: Runs of each base64 alphabet with whatever line ends lie within; '-' of armour is in the second alphabet only. The first
#: look ahead passes over words: a candidate has 24 characters with its line ends and at most two signs of padding.
RUNS = tuple(re.compile(rf"(?<![{c}])(?=[\r\n{c}]{{22}})[{c}]++(?:\r?\n[{c}]++)*+={{0,2}}") for c in ALPHABETS)
#: Runs whose lines stand behind margins of blanks or quote marks. Their first line has 16 characters.
MARGINS = tuple(re.compile(rf"(?<![{c}])[{c}]{{16,}}+(?:[ \t]*+\r?\n[ \t>]++[{c}]++)++={{0,2}}") for c in ALPHABETS)
LINE = re.compile(r"[^\r\n]+")
BEHIND_MARGIN = re.compile(r"[^\s>]+")
#: What a secret may stand behind that its own alphabet holds too, and what stands between two such signs.
SIGN = re.compile(r"[+/_-](?=[MAb])")
PIECE = re.compile(r"[A-Za-z0-9]{22,}+={0,2}")
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]+-----[ \t\r\n]*+([A-Za-z0-9+/ \t\r\n]++={0,2})[ \t\r\n]*+-----END ")
TOKEN = re.compile(r"(?<![A-Za-z0-9])(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
ANY_HEX = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=0[xX]))(?:(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,})(?![0-9A-Za-z])")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping within a kind, in code points."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def unbase64(text: str) -> bytes | None:
    """Strict decoding of either alphabet, padded or not; None if it is not base64."""
    body = re.sub(r"[ \t\r\n]", "", text).rstrip("=")
    if len(body) % 4 == 1 or (set("+/") & set(body) and set("-_") & set(body)):
        return None
    try:
        raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return raw


def der(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """Nodes (tag, value or children) that fill data[start:end] exactly by their nested lengths, or None."""
    end = len(data) if end is None else end
    out, at = [], start
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or data[at] == 0:  # DER wants the shortest form
                return None
            at += n
        if at + size > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """Whether DER data has the outline of a key: PKCS#1, PKCS#8, SEC1 or a SubjectPublicKeyInfo."""
    nodes = der(data) if data[:1] == b"\x30" else None
    if not nodes or len(nodes) != 1 or not isinstance(nodes[0][1], list):
        return False
    top = nodes[0][1]
    tags = [t for t, _ in top]
    integers = all(t == 2 and v for t, v in top)
    if integers and len(top) >= 9 and len(top[1][1]) >= 32:  # RSA private: version, n, e, d, p, q, dp, dq, qinv
        return True
    if integers and len(top) == 2 and len(top[0][1]) >= 32:  # RSA public: n, e
        return True
    named = lambda v: isinstance(v, list) and bool(v) and v[0][0] == 6  # noqa: E731  an algorithm's object identifier
    if tags[:3] == [2, 0x30, 4] and named(top[1][1]) and len(top[2][1]) >= 16:  # PKCS#8
        return True
    if tags[:2] == [2, 4] and top[0][1] == b"\x01" and len(top[1][1]) >= 16:  # SEC1
        return True
    return tags == [0x30, 3] and named(top[0][1]) and len(top[1][1]) >= 16


def is_ssh(data: bytes) -> bool:
    """Whether wire strings of known key type fill the data exactly, or an OpenSSH private key container does."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        known = True
    else:
        known = False
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if known and len(fields) == 3:  # number of keys, not a length
            fields.append(b"")
            at += 4
            continue
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and (len(fields) >= 5 if known else len(fields) >= 2 and fields[0] in SSH_NAMES)


def is_token_header(text: str) -> bool:
    raw = unbase64(text)
    if raw is None:
        return False
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and bool(header["alg"])


def tokens(text: str) -> list[Span]:
    """Signed tokens, leftmost first. What only begins like one may hide one, so the search goes on behind its first part."""
    out, at = [], 0
    while m := TOKEN.search(text, at):
        good = is_token_header(m[1])
        if good:
            out.append((m.start(), m.end(), "signed_token"))
        at = m.end() if good else m.end(1)
    return out


def confirmed_as(data: bytes) -> str | None:
    if is_key(data):
        return "der_key"
    if is_ssh(data):
        return "ssh_key"
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return None
    if text.isprintable() and (base_spans(text) or bool(tokens(text))):
        return "wrapped"
    return None


def key_length(head: bytes) -> int | None:
    """The length that DER data states for itself; None if it does not start with a sequence."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    if head[1] < 0x80:
        return 2 + head[1]
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else None


def ssh_lengths(data: bytes) -> list[int]:
    """Where SSH data may end: behind each of its fields, the furthest first."""
    at, n, out = 15 if data.startswith(b"openssh-key-v1\0") else 0, 0, []
    container = at > 0
    while at + 4 <= len(data):
        at += 4 if container and n == 3 else 4 + int.from_bytes(data[at : at + 4], "big")
        n += 1
        if at <= len(data):
            out.append(at)
    return out[::-1]


def run_spans(text: str, start: int, stop: int) -> list[Span]:
    """What is confirmed in a run of base64: lines that belong together, wherever in the run they begin and end."""
    lines = [(start + m.start(), start + m.end()) for m in LINE.finditer(text[start:stop])]
    out: list[Span] = []
    taken = [False] * len(lines)

    def attempt(i: int, j: int, a: int | None = None, b: int | None = None) -> None:
        """Lines i to j, the first from a on and the last up to b."""
        if i <= j < len(lines) and not any(taken[i : j + 1]):
            a, b = lines[i][0] if a is None else a, lines[j][1] if b is None else b
            if b - a >= 24 and (raw := unbase64(text[a:b])) and (kind := confirmed_as(raw)):
                out.append((a, b, kind))
                taken[i : j + 1] = [True] * (j + 1 - i)

    # keys state how long they are, so where they end follows from where they begin
    ends = list(accumulate(len(text[a:b].rstrip("=")) for a, b in lines))

    def key_ends(i: int, a: int, base: int, n: int) -> None:
        """Attempt the key of n bytes that begins at a in line i, behind ``base`` characters of the run."""
        to = base + (n * 8 + 5) // 6
        j = bisect_left(ends, to)
        if j < len(ends):
            b = lines[j][0] + to - (ends[j - 1] if j else 0)
            if ends[j] == to:
                attempt(i, j, a)
            elif not text[b].isalnum():
                attempt(i, j, a, b)

    for i, (a, b) in enumerate(lines):
        before = ends[i - 1] if i else 0
        for p in [a, *(m.end() for m in SIGN.finditer(text, a, b))]:
            if taken[i] or text[p] not in "MAb":
                continue
            to, base = min(b, p + 40), before + p - a
            head = unbase64(text[p : to - (to - p) % 4]) or b""
            if (n := key_length(head)) is not None:
                key_ends(i, p, base, n)
            elif head.startswith(b"openssh-key-v1\0") or head[4 : 4 + int.from_bytes(head[:4], "big")] in SSH_NAMES:
                rest = text[p : lines[-1][1]]
                size = ends[-1] - base
                raw = unbase64(rest) or unbase64(re.sub(r"[\r\n=]", "", rest)[: size - size % 4]) or b""
                for n in ssh_lengths(raw):
                    key_ends(i, p, base, n)
    if text[stop : stop + 1] in ("+", "/", "-", "_") and text[stop - 1] != "=" and not text.startswith("-----", stop):
        lines.pop()  # the start of a word of the other alphabet
    if not lines:
        return out
    # other secrets: lines up to a short one, and lines of one width with a shorter last line, with and without what adjoins
    width = [b - a for a, b in lines]
    for starts in ([i for i, w in enumerate(width) if i == 0 or w < 16], [i for i, w in enumerate(width) if i == 0 or w != width[i - 1]]):
        for i, after in zip(starts, [*starts[1:], len(lines)], strict=True):
            for first in (i, i + 1):
                attempt(first, after)
                attempt(first, after - 1)
    for i, (a, b) in enumerate(lines):
        attempt(i, i)
        for m in PIECE.finditer(text, a, b):
            if m.end() - m.start() < b - a:
                attempt(i, i, m.start(), m.end())
    return out


def margin_spans(text: str, run: re.Match) -> list[Span]:
    """What is confirmed in lines that stand behind margins, looked at without these."""
    lines = [(run.start() + m.start(), run.start() + m.end()) for m in BEHIND_MARGIN.finditer(run[0])]
    bare = "\n".join(text[a:b] for a, b in lines)
    begins = [0, *accumulate(b - a + 1 for a, b in lines)]

    def place(at: int) -> int:
        i = bisect_right(begins, at) - 1
        return lines[i][0] + at - begins[i]

    return [(place(a), place(b - 1) + 1, kind) for a, b, kind in run_spans(bare, 0, len(bare))]


def confirmed_spans(text: str) -> list[Span]:
    """(start, end, kind) of candidates that decode to something that holds together."""
    out: list[Span] = []
    if "eyJ" in text:
        out += tokens(text)
    armoured = [] if "-----BEGIN " not in text else list(ARMOUR.finditer(text))
    for m in armoured:
        if (raw := unbase64(m[1])) and (kind := confirmed_as(raw)):
            out.append((m.start(1), m.start(1) + len(m[1].rstrip()), kind))
    known = [(a, b) for a, b, k in out if k != "signed_token"]
    for runs in RUNS:
        for m in runs.finditer(text):
            if m.end() - m.start() >= 24 and not any(a <= m.start() and m.end() <= b for a, b in known):
                out += run_spans(text, m.start(), m.end())
    known = [(a, b) for a, b, k in out if k != "signed_token"]
    for runs in MARGINS:
        for m in runs.finditer(text):
            out += [s for s in margin_spans(text, m) if not any(a <= s[0] and s[1] <= b for a, b in known)]
    for m in ANY_HEX.finditer(text):
        if kind := confirmed_as(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), kind))
    return ordered(list(dict.fromkeys(out)))


def join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
        counts: list[list[int]] = [[], [], []]
        digests, spans = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            for c, kind in zip(counts, BASE_KINDS, strict=True):
                c.append(sum(k == kind for _, _, k in base))
            digests.append(hashlib.sha256(join(base).encode()).hexdigest())
            spans.append(join(ordered(base + confirmed_spans(text))) if text else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the secrets found in the whole text.

    A null or empty text has none. A null id stays null; repeated rows give repeated results. Extra columns are ignored. An
    empty table gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, _report, _REPORT)


def redact_text(text: str, mark: str = "[secret]") -> str:
    spans = ordered(base_spans(text) + confirmed_spans(text))
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each run of overlapping secrets in ``text`` replaced by ``mark``, ``n_chars`` (as long) following.

    Every row stays. A null text stays null and has a null ``n_chars``; null ids, repeated rows and other columns, whatever
    their names, are as they were. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            text = [t if not t else redact_text(t, mark) for t in batch.column("text").to_pylist()]
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(text, pa.string()))
            if (i := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(i, "n_chars", pa.array([None if t is None else len(t) for t in text], pa.int64()))
            yield batch

    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    return docs.transform(map_arrow, run, docs.schema)
