"""Secret scans with structural confirmation.

Base patterns find assignments, access ids and hex runs.  Beyond them, runs
that may be encoded are decoded and only reported if their structure holds:

* ``jwt``: three base64url parts whose first is a JSON object naming an
  algorithm, and whose second is JSON unless the token is encrypted;
* ``key``: base64 or hex that decodes to a key: a DER sequence whose nested
  lengths fill it exactly and whose fields are those of a private key (PKCS#1,
  PKCS#8, also encrypted, SEC 1, DSA), or an OpenSSH key whose length-prefixed strings add up; a
  PEM block is reported from its first dash to its last;
* ``wrapped``: base64 or hex of printable text that holds a base secret or one
  of the above (decoded at most twice).

Lines of one width that are base64 or hex only, with a shorter last one, are
also read as one run, reported from its first character to its last.

Each base span is also checked: ``n_confirmed`` counts those that decode so.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import map_rows

#: Kinds in the order that breaks ties of spans.
KINDS = ("assign", "access", "hex", "jwt", "key", "wrapped")
BASE = 3

#: The base patterns.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Runs that may be encoded. Each starts where its alphabet does, so a long run is read once.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}")
_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}+")
#: A whole line of such a run, and what may be the last one.
_LINE = re.compile(r"^[ \t]*+([A-Za-z0-9+/_-]{24,}+={0,2})[ \t\r]*+$", re.M)
_LAST_LINE = re.compile(r"^[ \t]*+([A-Za-z0-9+/_-]++={0,2})[ \t\r]*+$", re.M)
_PEM_HEAD = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_ALL_HEX, _URL_ONLY, _STANDARD_ONLY = re.compile(r"[0-9A-Fa-f]+"), re.compile("[-_]"), re.compile("[+/]")
#: A cheap look before the decoding patterns: a run of 24 characters of the base64 alphabet.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24}")

_SSH_MAGIC = b"openssh-key-v1\x00"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and end of the DER element at ``at``, if its length stays within ``end``."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        length, at = int.from_bytes(data[at:at + n]), at + n
    return (tag, at, at + length) if at + length <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly."""
    out = []
    while at < end:
        e = _tlv(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_key(data: bytes) -> bool:
    """True if the bytes are one DER sequence with the fields of a private key."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    fields = _elements(data, top[1], top[2])
    if not fields or len(fields) < 2 or fields[0][0] != 0x02:
        return False
    tags = [f[0] for f in fields]
    version = int.from_bytes(data[fields[0][1]:fields[0][2]])
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and version <= 1:  # PKCS#1: version, n, e, d, p, q, ...
        return True
    if len(tags) == 6 and set(tags) == {0x02} and version == 0:  # DSA: version, p, q, g, y, x
        return True
    if tags[1] == 0x30 and 0x04 in tags[2:3] and version <= 1:  # PKCS#8: version, algorithm, octets
        algorithm = _elements(data, fields[1][1], fields[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1] == 0x04 and version == 1 and fields[1][2] - fields[1][1] >= 16  # SEC 1: version 1, octets


def is_encrypted_der_key(data: bytes) -> bool:
    """True if the bytes are one EncryptedPrivateKeyInfo: algorithm with its identifier, and octets up to the outer end."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    fields = _elements(data, top[1], top[2])
    if not fields or [f[0] for f in fields] != [0x30, 0x04] or fields[1][2] - fields[1][1] < 8:
        return False
    algorithm = _elements(data, fields[0][1], fields[0][2])
    return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][2] - algorithm[0][1] >= 3


def is_encrypted_legacy_key(headers: list[str], data: bytes) -> bool:
    """True if Proc-Type headers name a cipher and its start value, and the body is whole blocks of that cipher."""
    info = dict(h.split(":", 1) for h in headers if ":" in h)
    cipher, _, start = info.get("DEK-Info", "").strip().partition(",")
    if "ENCRYPTED" not in info.get("Proc-Type", "") or not re.fullmatch(r"[A-Z0-9-]+", cipher):
        return False
    block = len(start.strip()) // 2
    return bool(re.fullmatch(r"([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})", start.strip())) and len(data) >= 2 * block and len(data) % block == 0


def is_ssh_key(data: bytes) -> bool:
    """True if the bytes are an OpenSSH private key file: strings with lengths, number of keys, public and private part."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at = len(_SSH_MAGIC)

    def string(at):
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at:at + 4])
        return end if end <= len(data) else None
    for _ in range(3):  # cipher, key derivation and its options
        at = string(at)
        if at is None:
            return False
    if at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4])
    at += 4
    for _ in range(min(keys, 16) + 1):
        at = string(at)
        if at is None:
            return False
    return 1 <= keys <= 16


def decoded(run: str) -> list[bytes]:
    """What the run may stand for: hex, base64 or base64url, whichever it is written in."""
    out = []
    body = run.rstrip("=")
    if len(run) % 2 == 0 and _ALL_HEX.fullmatch(run):
        out.append(bytes.fromhex(run))
    if len(body) % 4 != 1 and not (_URL_ONLY.search(body) and _STANDARD_ONLY.search(body)):
        try:
            out.append(base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True))
        except ValueError:
            pass
    return out


def is_jwt(token: str) -> bool:
    """True if the first part is a JSON object with an algorithm and the second is JSON or the token is encrypted."""
    parts = token.split(".")
    try:
        head = json.loads(base64.urlsafe_b64decode(parts[0] + "=" * (-len(parts[0]) % 4)))
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        return "enc" in head or isinstance(json.loads(base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _text(data: bytes) -> str | None:
    """The bytes as text, if all of it is printable."""
    if len(data) < 12:
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if sum(c.isprintable() or c in "\r\n\t" for c in text) == len(text) else None


def confirmed(run: str, depth: int = 2) -> str | None:
    """The kind of what the run decodes to, or None."""
    for data in decoded(run):
        if is_der_key(data) or is_ssh_key(data):
            return "key"
        text = _text(data) if depth else None
        if text and (base_spans(text) or added_spans(text, depth - 1)):
            return "wrapped"
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return found


def added_spans(text: str, depth: int = 2) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of what structure confirms; a run inside a reported token or block isn't read again."""
    found: list[tuple[int, int, int]] = []
    taken = _Taken()
    if "PRIVATE KEY-----" in text:
        for start, end, body, headers in _pem_blocks(text):
            if any(is_der_key(d) or is_ssh_key(d) or is_encrypted_der_key(d) or is_encrypted_legacy_key(headers, d) for d in decoded(body)):
                found.append((start, end, 4))
                taken.add(start, end)
    if "ey" in text:
        for m in _JWT.finditer(text):
            if taken.free(*m.span()) and is_jwt(m[0]):
                found.append((*m.span(), 3))
                taken.add(*m.span())
    if not _RUN.search(text):
        return found
    whole = []  # wrapped texts over several lines; a line that holds a secret of its own comes first
    for start, end, run in _line_runs(text):
        kind = confirmed(run, depth) if taken.free(start, end) else None
        if kind == "key":
            found.append((start, end, KINDS.index(kind)))
            taken.add(start, end)
        elif kind:
            whole.append((start, end, KINDS.index(kind)))
    for pattern in (_BASE64, _HEX):
        for m in pattern.finditer(text):
            kind = confirmed(m[0], depth) if taken.free(*m.span()) else None
            if kind:
                found.append((*m.span(), KINDS.index(kind)))
                taken.add(*m.span())
    for start, end, kind in whole:
        if taken.free(start, end):
            found.append((start, end, kind))
            taken.add(start, end)
    return found


class _Taken:
    """Disjoint spans, sorted."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def _line_runs(text: str):
    """(start, end, run) of consecutive lines of one width joined, with the shorter line after them and without it."""
    rows: list[re.Match] = []

    def joined(rows):
        return rows[0].start(1), rows[-1].end(1), "".join(m[1] for m in rows)

    def closed(rows):
        last = _LAST_LINE.match(text, rows[-1].end() + 1) if rows else None
        if last and len(last[1]) < len(rows[0][1]):
            yield joined([*rows, last])
        if len(rows) > 1:
            yield joined(rows)

    for m in _LINE.finditer(text):
        if rows and (m.start() != rows[-1].end() + 1 or len(m[1]) != len(rows[0][1])):
            yield from closed(rows)
            rows = []
        rows.append(m)
    yield from closed(rows)


def _pem_blocks(text: str):
    """(start, end, base64 body, header lines) of the blocks; each stretch between two heads is read once."""
    heads = list(_PEM_HEAD.finditer(text))
    for i, m in enumerate(heads):
        following = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        foot = f"-----END {m[1]}-----"
        at = text.find(foot, m.end(), following)
        if at >= 0:
            lines = text[m.end():at].replace("\\n", "\n").splitlines()
            body = "".join(x.strip() for x in lines if ":" not in x)
            yield m.start(), at + len(foot), body, [x.strip() for x in lines if ":" in x]


def spans_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def scan_text(text: str | None) -> tuple:
    """The output columns of one text."""
    text = text or ""
    base = base_spans(text)
    added = added_spans(text)
    runs = [ASSIGN.match(text, a)[1] if k == 0 else text[a:b] for a, b, k in base]
    sure = sum(1 for run in runs if confirmed(run) or run.startswith("ey") and is_jwt(run))
    counts = [sum(s[2] == k for s in base) for k in range(BASE)]
    return (*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added), len(added), sure)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base
    spans), spans (all spans), n_added, n_confirmed.  An assign span is the whole
    match, name included.

    Null and empty texts have no spans (base_sha256 is that of the empty
    string); repeated rows stay; null ids stay null; an empty table gives an
    empty result; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema[id_col].dataType

    def run(columns):
        ids, texts = columns
        return [ids, *([list(c) for c in zip(*map(scan_text, texts), strict=True)] if texts else [[]] * 7)]

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "n_confirmed"]
    schema = f"doc_id {kind.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, n_confirmed long"
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return map_rows(slim, ["doc_id", "text"], run, schema, types, names)
