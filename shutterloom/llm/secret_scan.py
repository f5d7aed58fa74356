"""Secret scan with structural confirmation.

Three textual patterns find assigned credentials, cloud access ids and long hex runs. Beside
them, base64 and hex runs and armoured blocks are decoded, and reported only if what they hold
parses: a private key in DER whose nested lengths add up, plain or encrypted, an OpenSSH private key
whose length prefixes add up, or a signed token whose header and claims are JSON objects. Lines may
end by line ends or by their escapes, and an armoured block may itself be in base64.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("pem", "der", "openssh", "jwt")
KINDS = BASE_KINDS + CONFIRMED_KINDS

FINDING = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# A DER sequence starts with byte 0x30 and an OpenSSH key with "openssh-key-v1", so their encodings start so:
# The escape of a line end may stand before it, and so a letter.
_BASE64_KEY = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M|b3Bl)[A-Za-z0-9+/_-]{15,}")
_LEAST_BASE64 = 40
# The same ones in base64 once more.
_TWICE = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:TU|YjNCb)[A-Za-z0-9+/_-]{52,}")
# Bytes of a key that fills several lines, at most; keys of 16384 bits have a third of that.
_MOST_WRAPPED = 1 << 15
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_LINE_END = re.compile(r"[ \t]{0,64}(?:\\{1,4}r\\{1,4}n|\\{1,4}[nr]|\r?\n|\r)[ \t]{0,64}")
_ESCAPED_END = re.compile(r"\\{1,4}[nr]")
# "-----BEGIN " in base64 from each of the three places in a group, and the signs that the first group has of it.
_ARMOUR64 = re.compile(r"LS0tLS1CRUdJT|LS0tQkVHSU4g|LS0tLUJFR0lO")
_ARMOUR64_SIGNS = {"LS0tLS1CRUdJT": b"", "LS0tQkVHSU4g": b"--", "LS0tLUJFR0lO": b"-"}
_DEK_INFO = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,[0-9A-F]{16,}", re.I)
# Object identifiers of PKCS#5 and of PKCS#12 encryption by passwords.
_BY_PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee])(?:[0-9A-Fa-f]{2}){22,}")
# "{" in base64url is "e" and one of 16 letters.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*")
_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")


def _decode64(text: str) -> bytes | None:
    text = text.rstrip("=").translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each item in data; None unless the items fill data exactly."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1 (version and eight or more integers), DSA's own form (version 0 and five), PKCS#8 (version, algorithm, octets) or SEC1 (version 1, octets)."""
    outer = _der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inside = _der_items(outer[0][1])
    if not inside or len(inside) < 2 or inside[0][0] != 0x02 or len(inside[0][1]) != 1:
        return False
    tags = [t for t, _ in inside]
    if tags == [0x02] * 6 or (len(tags) >= 9 and all(t == 0x02 for t in tags[:9])):
        return all(v for _, v in inside[:9]) and (len(tags) > 6 or inside[0][1] == b"\0")
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
        algorithm = _der_items(inside[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return inside[0][1] == b"\x01" and tags[1] == 0x04 and len(inside[1][1]) >= 16


def is_encrypted_private_key(data: bytes, by_password: bool = False) -> bool:
    """EncryptedPrivateKeyInfo: algorithm and octets. by_password: only algorithms that encrypt by a password, as digests look alike."""
    outer = _der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inside = _der_items(outer[0][1])
    if not inside or [t for t, _ in inside] != [0x30, 0x04] or not inside[1][1]:
        return False
    algorithm = _der_items(inside[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06 and (not by_password or algorithm[0][1].startswith(_BY_PASSWORD))


_OPENSSH = b"openssh-key-v1\0"


def _openssh_end(number: Callable[[int], int | None], most: int) -> int | None:
    """Three strings behind the magic, a count of keys, and as many public strings and one private one: where they end by their length prefixes.

    number(at) is the length that stands at a byte, None beyond the end. None if the key ends beyond `most` bytes.
    """
    at, left, keys = len(_OPENSSH), 3, 0
    while at <= most and (n := number(at)) is not None:
        if left:
            at, left = at + 4 + n, left - 1
            if not left and keys:
                return at if at <= most else None
        elif not 1 <= n <= 64:
            return None
        else:
            at, left, keys = at + 4, n + 1, n
    return None


def is_openssh_private_key(data: bytes) -> bool:
    """Whether the parts of an OpenSSH key fill data exactly."""
    number = lambda at: int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else None
    return data.startswith(_OPENSSH) and _openssh_end(number, len(data)) == len(data)


def is_signed_token(head: str, body: str) -> bool:
    """Header: a JSON object with a text "alg". Claims: a JSON object."""
    try:
        header, claims = (json.loads(_decode64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def _key_kind(data: bytes | None, by_password: bool = True) -> str | None:
    if data is None:
        return None
    if is_der_private_key(data) or is_encrypted_private_key(data, by_password):
        return "der"
    return "openssh" if is_openssh_private_key(data) else None


def _is_armoured_key(label: str, body: str) -> bool:
    lines = [x.strip() for x in _ESCAPED_END.sub("\n", body).splitlines()]
    data = _decode64("".join("".join(x for x in lines if ":" not in x).split()))
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in lines):
        # Ciphertext has no structure: whole cipher blocks, and the header that names cipher and start value.
        return bool(data) and len(data) % 8 == 0 and any(_DEK_INFO.match(x) for x in lines)
    return _key_kind(data, by_password="ENCRYPTED" not in label) is not None


def _armour_end(text: str, begin: re.Match) -> int | None:
    """Where the armoured key ends that begins with the match; None if it holds none."""
    end, foot = text.find("-----", begin.end()), f"-----END {begin[1]}-----"
    return end + len(foot) if end >= 0 and text.startswith(foot, end) and _is_armoured_key(begin[1], text[begin.end() : end]) else None


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    if "-----BEGIN " in text:
        for m in _PEM_BEGIN.finditer(text):
            end = _armour_end(text, m)
            if end is not None:
                yield m.start(), end


class _Lines:
    """Base64 lines that follow one another, and their letters without line ends; made once however many places in them are looked at."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.upto, self.letters, self.end = text, [], [], [], "", -1

    def at(self, place: int) -> int:
        """How many letters lie before the place, after reading on from it if it isn't in the lines read."""
        if not self.starts or not self.starts[0] <= place < self.end:
            self.starts, self.ends, self.upto, parts, held = [], [], [], [], 0
            while m := _LINE.match(self.text, place):
                held += m.end() - m.start()
                self.starts.append(m.start())
                self.ends.append(m.end())
                self.upto.append(held)
                parts.append(m[0])
                gap = _LINE_END.match(self.text, m.end())
                if not gap:
                    break
                place = gap.end()
            self.letters, self.end = "".join(parts), self.ends[-1]
            return 0
        line = bisect_right(self.starts, place) - 1
        return self.upto[line] - (self.ends[line] - place)

    def place(self, letters: int) -> int:
        """Where in the text that many letters end."""
        line = bisect_left(self.upto, letters)
        return self.ends[line] - (self.upto[line] - letters)

    def ends_line(self, letters: int) -> bool:
        line = bisect_left(self.upto, letters)
        return line < len(self.upto) and self.upto[line] == letters


def _armoured64(text: str) -> Iterator[tuple[int, int]]:
    """Armoured blocks that are in base64 themselves."""
    at, lines = 0, _Lines(text)
    while m := _ARMOUR64.search(text, at):
        before, signs = at, _ARMOUR64_SIGNS[m[0]]
        at, first, size = m.end(), lines.at(m.start()), 128
        while True:
            run = lines.letters[first : first + size]
            whole = first + size >= len(lines.letters)
            data = _decode64(run[: len(run) - (len(run) % 4 == 1)])
            inner = None if data is None else (signs + data).decode("latin-1")
            begin = _PEM_BEGIN.match(inner) if inner else None
            # More is read only as long as the next dashes are not in sight.
            if not begin or whole or "-----" in inner[begin.end() : -100]:
                break
            size *= 4
        end = _armour_end(inner, begin) if begin else None
        if end is None:
            continue
        b = lines.place(first + min(-(-(end - len(signs)) * 4 // 3), len(run)))
        line = bisect_left(lines.ends, b)
        b = lines.ends[line]
        start = m.start()
        while start > before and _LINE.match(text[start - 1]) and not (text[start - 1] in "nrt" and text[start - 2 : start - 1] == "\\"):
            start -= 1
        at = b + len(text[b : b + 2]) - len(text[b : b + 2].lstrip("="))
        yield start, at


def _claimed(head: bytes) -> int | None:
    """How many bytes a DER sequence claims that starts like a private key; None if none does."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    if n > 4 or head[1] == 0x80 or head[2 + n] not in (0x02, 0x30):
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _openssh_need(letters: str, first: int) -> int | None:
    """Bytes of the OpenSSH key that starts at a letter; only the letters of its length prefixes are decoded. None if it is larger than _MOST_WRAPPED."""
    if not (_decode64(letters[first : first + 20]) or b"").startswith(_OPENSSH):
        return None

    def number(at: int) -> int | None:
        group = first + at // 3 * 4
        found = (_decode64(letters[group : group + 8]) or b"")[at % 3 :][:4]
        return int.from_bytes(found, "big") if len(found) == 4 else None

    return _openssh_end(number, _MOST_WRAPPED)


def _wrapped_key(lines: _Lines, start: int) -> tuple[str, int] | None:
    """Kind and end of a key in base64 that starts at start and fills several lines; the key says its length, and ends with a line."""
    head = _decode64(lines.text[start : start + 16])
    need = _claimed(head) if head else None
    if need is None and not (head or b"").startswith(b"openssh-key"):
        return None
    first = lines.at(start)
    if need is None:
        need = _openssh_need(lines.letters, first)
    letters = -(-need * 4 // 3) if need and need <= _MOST_WRAPPED else 0
    if not _LEAST_BASE64 <= letters <= len(lines.letters) - first or not lines.ends_line(first + letters):
        return None
    kind = _key_kind(_decode64(lines.letters[first : first + letters]))
    return (kind, lines.place(first + letters)) if kind else None


def _encoded_twice(run: str) -> str | None:
    """The kind of key whose base64, in one line or more, is in base64 in the run."""
    inner = _decode64(run[: len(run) - (len(run) % 4 == 1)])
    if not inner or not inner.isascii():
        return None
    text = "".join(inner.decode("ascii").split())
    return _key_kind(_decode64(text)) if len(text) >= _LEAST_BASE64 else None


def _keys64(text: str, armour: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    at = n = 0
    lines = _Lines(text)
    padded = lambda end: end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
    while m := _BASE64_KEY.search(text, at):
        start, at = m.span()
        while n < len(armour) and armour[n][1] <= start:
            n += 1
        if n < len(armour) and armour[n][0] <= start:
            at = max(at, armour[n][1])
            continue
        kind, end = (_key_kind(_decode64(m[0])) if at - start >= _LEAST_BASE64 else None), at
        if not kind:
            kind, end = _wrapped_key(lines, start) or (None, at)
        if kind:
            at = padded(end)
            yield kind, start, at
    n = 0
    for m in _TWICE.finditer(text) if "TU" in text or "YjNCb" in text else ():
        while n < len(armour) and armour[n][1] <= m.start():
            n += 1
        if n < len(armour) and armour[n][0] <= m.start():
            continue
        kind = _encoded_twice(m[0])
        if kind:
            yield kind, m.start(), padded(m.end())


def _confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    armour = sorted([*_armoured(text), *_armoured64(text)])
    for span in armour:
        yield "pem", *span
    yield from _keys64(text, armour)
    at = 0
    for m in _HEX_KEY.finditer(text):
        while at < len(armour) and armour[at][1] <= m.start():
            at += 1
        if at < len(armour) and armour[at][0] <= m.start():
            continue
        kind = _key_kind(bytes.fromhex(m[0]))
        if kind:
            yield kind, *m.span()
    at = 0
    while m := _TOKEN.search(text, at):
        if is_signed_token(m[1], m[2]):
            yield "jwt", *m.span()
            at = m.end()
        else:  # What follows the dot may be the header.
            at = m.end(1)


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of KINDS; code points, end exclusive. Null: none."""
    if not text:
        return []
    found = []
    if _KEYWORD.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += _confirmed(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))) if len(found) > 1 else found


def redact_text(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by [SECRET]."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _secrets_in(text: pa.Array) -> pa.Array:
    keys = ("kind", "start", "end")
    return pa.array([[dict(zip(keys, x, strict=True)) for x in find_secrets(t)] for t in text.to_pylist()], type=_ARROW)


def _redacted(text: pa.Array) -> pa.Array:
    return pa.array([redact_text(t) for t in text.to_pylist()], type=pa.string())


def scan_secrets(docs: DataFrame, text: str = "text", to: str = "findings") -> DataFrame:
    """docs with an array column `to` of (kind, start, end).

    No shuffle: one vectorised pass, one text in memory at a time beside its batch. Null and empty
    texts have no findings; repeated rows have each their own; an existing column `to` is replaced.
    """
    return docs.withColumn(to, F.arrow_udf(_secrets_in, FINDING)(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every secret in `text` replaced by [SECRET]; `length`, if docs has it, is the new number of characters.

    All rows stay. Null texts stay null with their length as it was.
    """
    out = docs.withColumn(text, F.arrow_udf(_redacted, "string")(F.col(text)))
    if length and length in docs.columns:
        out = out.withColumn(length, F.coalesce(F.length(text).cast(docs.schema[length].dataType), F.col(length)))
    return out


def span_list(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, all spans, and how many the method confirmed."""
    small_batches(spark)
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "findings")

    def of(*kinds: str) -> Column:
        return F.filter("findings", lambda x: x.kind.isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_list(of(*BASE_KINDS)), 256).alias("base_sha256"),
        span_list(F.col("findings")).alias("spans"),
        F.size(of(*CONFIRMED_KINDS)).cast("long").alias("n_confirmed"),
    )
