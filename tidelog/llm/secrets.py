"""Secret scan with a worklist of decoded layers.

Every text is scanned as it stands; then URL-encoded, Unicode-escaped, base64 and compressed regions are
decoded into layers, each layer is scanned and searched for further regions, until no new layer appears.
A layer carries the source span of each of its characters, so a finding in it maps back to the text. Base64 is read
at all four alignments, in case letters stand before it, and over line ends of any width and indent. A compressed stream
unfolds as it is fed, in overlapping windows of WINDOW bytes, and so do the streams in it, whether they begin it or lie
in it as base64: neither size nor depth has a limit. Of bytes that are no text only runs of ASCII are looked at, since
nothing that is searched for has any other character.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: The kinds in their listed order, each with pattern, the group that counts, its least length.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
)
RANK = {name: i for i, (name, *_) in enumerate(KINDS)}
#: Bytes of an unfolded stream scanned at once, and how far windows overlap: longer finds across two windows are found
#: in part, which gives the same span, the region's.
WINDOW, OVERLAP, CHUNK = 8 << 20, 1 << 20, 1 << 20

_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines: from a long run at the end of a line, or a line of letters only, over such lines to the
#: letters that begin the next one; lines can be indented or quoted.
_LINES = re.compile(r"(?:(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}|^[ \t>]*[A-Za-z0-9+/_-]{8,})[ \t]*\r?\n(?:[ \t>]*[A-Za-z0-9+/_-]{8,}[ \t]*\r?\n)*[ \t>]*[A-Za-z0-9+/_-]+={0,2}", re.MULTILINE)
#: Base64 of the first bytes of gzip, bzip2, xz, zstd and zlib streams.
_PACKED = re.compile(r"H4sI|Qlpo|[/_]Td6WFo|KLUv|eJ[w-z]|eA[E-H]|eN[o-r]|eF[4-7]")
_PACKED_BYTES = re.compile(_PACKED.pattern.encode())
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
BETWEEN = b" \t\r\n>"
_IS_LETTER = np.isin(np.arange(128), np.frombuffer(LETTERS, np.uint8))
_PLAIN_LETTERS = bytes.maketrans(b"-_", b"+/")
#: Runs of ASCII that can hold a find: the shortest has 12 characters.
_ASCII = re.compile(rb"[\t\n\x0c\r\x20-\x7e]{12,}")
_STRAY = re.compile("[\udc80-\udcff]")
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f]")


@dataclass(frozen=True)
class Layer:
    """A text and, for each character, where its source starts and ends in the document."""

    text: str
    starts: np.ndarray
    ends: np.ndarray


def _possible(kind: str, text: str) -> bool:
    """False where a cheap look shows that the kind can't occur."""
    if kind == "assign":
        lower = text.lower()
        return any(word in lower for word in ("passw", "secret", "token", "api"))
    return kind != "hex" or _BASE64.search(text) is not None  # a hex string is a long run of base64 letters


def findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, code points, end exclusive."""
    out = []
    for kind, pattern, group, least in KINDS:
        if not _possible(kind, text):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return out


def _sizes(text: str) -> np.ndarray:
    """Bytes of each character; 1 for a byte that was not UTF-8."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return np.where((code >= 0xDC80) & (code <= 0xDCFF), 1, size)


def _to_text(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Layer | None:
    """Bytes with their sources as a layer; what is not UTF-8 becomes replacement characters. None if empty."""
    if not data:
        return None
    text = data.decode("utf-8", "surrogateescape")
    last = np.cumsum(_sizes(text))
    return Layer(_STRAY.sub("\ufffd", text), starts[np.append(0, last[:-1])], ends[last - 1])


def _islands(data: bytes) -> Iterator[tuple[int, int]]:
    """All of data if it is clean text, else its runs of ASCII."""
    try:
        clean = not _CONTROL.search(data.decode())
    except UnicodeDecodeError:
        clean = False
    yield from [(0, len(data))] if clean else (m.span() for m in _ASCII.finditer(data))


def _percent(layer: Layer) -> Layer | None:
    """The whole layer with its %XX bytes decoded."""
    data, starts, ends, at = bytearray(), [], [], 0
    for m in [*_PERCENT.finditer(layer.text), None]:
        upto = m.start() if m else len(layer.text)
        if at < upto:
            plain = layer.text[at:upto].encode("utf-8", "surrogatepass")
            size = 1 if len(plain) == upto - at else [len(c.encode("utf-8", "surrogatepass")) for c in layer.text[at:upto]]
            data += plain
            starts.append(np.repeat(layer.starts[at:upto], size))
            ends.append(np.repeat(layer.ends[at:upto], size))
        if m:
            data.append(int(m[1], 16))
            starts.append(layer.starts[upto : upto + 1])
            ends.append(layer.ends[m.end() - 1 : m.end()])
            at = m.end()
    return _to_text(bytes(data), np.concatenate(starts), np.concatenate(ends))


def _escapes(layer: Layer) -> Layer | None:
    """The whole layer with its Unicode escapes decoded; two halves of a surrogate pair become one character."""
    parts: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    at = 0
    for m in [*_ESCAPE.finditer(layer.text), None]:
        upto = m.start() if m else len(layer.text)
        if at < upto:
            parts.append(layer.text[at:upto])
            starts.append(layer.starts[at:upto])
            ends.append(layer.ends[at:upto])
        if m:
            code = int(m[7]) if m[7] else int(next(x for x in m.groups()[:6] if x), 16)
            char, end = chr(code) if code <= 0x10FFFF else "\ufffd", layer.ends[m.end() - 1 : m.end()]
            if "\udc00" <= char <= "\udfff" and parts and len(parts[-1]) == 1 and "\ud800" <= parts[-1] <= "\udbff":
                parts[-1] = chr(0x10000 + ((ord(parts[-1]) - 0xD800) << 10) + ord(char) - 0xDC00)
                ends[-1] = end
            else:
                parts.append(char)
                starts.append(layer.starts[upto : upto + 1])
                ends.append(end)
            at = m.end()
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


class _Zstd:
    """A zstd stream with the interface of the others: input goes in small pieces, since output can't be limited."""

    def __init__(self) -> None:
        self.inner, self.rest = zstandard.ZstdDecompressor().decompressobj(), b""

    def decompress(self, data: bytes, most: int) -> bytes:
        data, out, at, size = self.rest + data, [], 0, 0
        while at < len(data) and size < most and not self.eof:
            out.append(self.inner.decompress(data[at : at + 64]))
            at, size = at + 64, size + len(out[-1])
        self.rest = data[at:]
        return b"".join(out)

    @property
    def eof(self) -> bool:
        return self.inner.eof

    @property
    def unused_data(self) -> bytes:
        return self.inner.unused_data + self.rest


def _member(data: bytes):
    """What unfolds the stream that data begins with, or None."""
    if data[:2] == b"\x1f\x8b" or (len(data) > 1 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0):
        return zlib.decompressobj(wbits=47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return _Zstd()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


#: Bytes by which every kind of stream is known.
MAGIC = 6


class Unfolder:
    """The inside of all members of a gzip, zlib, bzip2, xz or zstd stream that is fed in pieces; it ends where the
    stream is broken."""

    def __init__(self) -> None:
        self.member, self.rest, self.over = None, b"", False

    def feed(self, data: bytes, last: bool = False) -> Iterator[bytes]:
        data, self.rest = self.rest + data, b""
        try:
            while data and not self.over:
                if self.member is None:
                    if len(data) < MAGIC and not last:
                        self.rest = data
                        return
                    self.member = _member(data)
                    self.over = self.member is None
                    continue
                while True:
                    if chunk := self.member.decompress(data, CHUNK):
                        yield chunk
                    data = getattr(self.member, "unconsumed_tail", b"")
                    if self.member.eof or not (chunk or data):
                        break
                if self.member.eof:
                    data, self.member = self.member.unused_data, None
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
            self.over = True


class Stream:
    """A compressed stream that is fed in pieces, as windows of the text in it."""

    def __init__(self) -> None:
        self.unfolder, self.inside, self.any = Unfolder(), Inside(), False

    @property
    def over(self) -> bool:
        return self.unfolder.over

    def feed(self, data: bytes, last: bool = False) -> Iterator[bytes]:
        for chunk in self.unfolder.feed(data, last):
            self.any = True
            yield from self.inside.feed(chunk)
        if last:
            yield from self.inside.feed(b"", True)


class Letters:
    """A stream as base64 letters, which can lie on several lines; it is over where other characters come."""

    def __init__(self) -> None:
        self.stream, self.rest, self.ended = Stream(), b"", False

    @property
    def over(self) -> bool:
        return self.ended or self.stream.over

    def feed(self, data: bytes, last: bool = False) -> Iterator[bytes]:
        if self.over:
            return
        after = data.lstrip(LETTERS + BETWEEN)
        letters = self.rest + data[: len(data) - len(after)].translate(_PLAIN_LETTERS, BETWEEN)
        self.ended = last or bool(after)
        n = len(letters) - len(letters) % 4
        whole, self.rest = letters[:n], letters[n:]
        if self.ended and len(self.rest) > 1:
            whole += self.rest + b"=" * (4 - len(self.rest))
        yield from self.stream.feed(base64.b64decode(whole), self.ended)


class Inside:
    """What a stream holds, as it comes: windows of it, or of the stream that it begins with. Streams that lie in it as
    base64 and go beyond a window are fed on; those within one are found in the window."""

    def __init__(self) -> None:
        self.buffer, self.fresh, self.known = bytearray(), 0, 0
        self.inner: Stream | None = None
        self.begun = False
        self.open: list[Letters] = []

    def feed(self, data: bytes, last: bool = False) -> Iterator[bytes]:
        if self.inner is not None and self.inner.any:
            yield from self.inner.feed(data, last)
            return
        for part in self.open:
            yield from part.feed(data, last)
        self.open = [part for part in self.open if not part.over]
        self.buffer += data
        self.fresh += len(data)
        if not self.begun and (len(self.buffer) >= MAGIC or last):
            self.begun = True
            if _member(bytes(self.buffer[:MAGIC])) is not None:
                self.inner, data = Stream(), bytes(self.buffer)
        if self.inner is not None:
            yield from self.inner.feed(data, last)
            if self.inner.any:  # a stream; else text that looks like one
                self.buffer.clear()
                return
            if self.inner.over:
                self.inner = None
        if len(self.buffer) >= WINDOW or last and self.fresh:
            window = bytes(self.buffer)
            yield window
            yield from () if last else self._opened(window)
            self.buffer, self.fresh = self.buffer[-OVERLAP:], 0
            self.known = len(self.buffer) - 16

    def _opened(self, window: bytes) -> Iterator[bytes]:
        """Streams whose letters begin in a window and reach its end."""
        begin = max(len(window.rstrip(LETTERS + BETWEEN)), self.known)
        letters = window[begin:].translate(_PLAIN_LETTERS, BETWEEN)
        for m in _PACKED_BYTES.finditer(letters):
            if _begins(letters, m.start()):
                part = Letters()
                yield from part.feed(letters[m.start() :])
                if not part.over:
                    self.open.append(part)


def windows(data: bytes) -> Iterator[bytes]:
    """The inside of a stream in overlapping windows; nothing if it is none. A stream in a stream is unfolded too."""
    stream = Stream()
    for at in range(0, len(data), CHUNK):
        yield from stream.feed(data[at : at + CHUNK], at + CHUNK >= len(data))


def _begins(letters: bytes, at: int) -> bool:
    return _member(base64.b64decode(letters[at : at + 8].ljust(8, b"A"))) is not None


def _packed(letters: bytes, at: int) -> Iterator[bytes]:
    """The windows of a stream in base64, fed only as far as it goes; most that look like one are none."""
    if _begins(letters, at):
        part, size = Letters(), 1024
        while at < len(letters) and not part.over:
            yield from part.feed(letters[at : at + size], at + size >= len(letters))
            at, size = at + size, min(CHUNK, 8 * size)


def unpack(data: bytes) -> bytes | None:
    """The inside of all members of a stream; None if it is none or broken from the start."""
    return b"".join(Unfolder().feed(data, True)) or None


def _same(text: str, start: int, end: int) -> Layer:
    """A layer all of whose characters come from the same place."""
    return Layer(text, np.broadcast_to(np.int32(start), len(text)), np.broadcast_to(np.int32(end), len(text)))


def _from_base64(layer: Layer, a: int, b: int) -> Iterator[Layer]:
    """The layers of one region: at each alignment, and those of streams that begin in it."""
    code = np.frombuffer(layer.text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
    source = (np.flatnonzero(_IS_LETTER[np.minimum(code, 127)]) + a).astype(np.int32)  # 127 is no letter
    letters = code[source - a].astype(np.uint8).tobytes().translate(_PLAIN_LETTERS)

    def decoded(first: int) -> bytes:
        n = len(letters) - first
        n -= n % 4 == 1
        return base64.b64decode(letters[first : first + n] + b"=" * (-n % 4)) if n >= 2 else b""

    for m in _PACKED_BYTES.finditer(letters):
        for piece in _packed(letters, m.start()):  # every byte of a stream comes from the whole region
            for p, q in _islands(piece):
                yield _same(piece[p:q].decode(), layer.starts[source[m.start()]], layer.ends[b - 1])
    for first in range(4):
        data = decoded(first)
        for p, q in _islands(data):
            at, last = np.arange(p, q), len(letters) - 1
            lows, highs = source[np.minimum(first + at * 4 // 3, last)], source[np.minimum(first + (at * 8 + 7) // 6, last)]
            if found := _to_text(data[p:q], layer.starts[lows], layer.ends[highs]):
                yield found


def _escaped(text: str) -> bool:
    return ("\\" in text or "%u" in text or "&#" in text) and _ESCAPE.search(text) is not None


def inner_layers(layer: Layer) -> Iterator[Layer]:
    """The layers that one decoding step finds."""
    text = layer.text
    if "%" in text and _PERCENT.search(text) and (found := _percent(layer)):
        yield found
    if _escaped(text) and (found := _escapes(layer)):
        yield found
    lines = [m.span() for m in _LINES.finditer(text)] if "\n" in text else []
    for span in lines:
        yield from _from_base64(layer, *span)
    whole = iter([span for span in lines if _even(text[slice(*span)])] + [(len(text), len(text))])
    first, last = next(whole)
    for m in _BASE64.finditer(text):
        while last <= m.start() < len(text):
            first, last = next(whole)
        if not (first <= m.start() and m.end() <= last):
            yield from _from_base64(layer, *m.span())


def _even(region: str) -> bool:
    """Lines of one width in whole groups of four letters: read together they are what each is by itself."""
    width = {len(line.strip(" \t\r>")) for line in region.split("\n")[:-1]}
    return len(width) == 1 and width.pop() % 4 == 0


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base findings, all findings (mapped to the text, each span once) and the number of layers."""
    base = findings(text)
    spans = set(base)
    work: list[Iterator[Layer]] = []  # layers not yet searched, the innermost last; each gives its inner ones in turn
    if _BASE64.search(text) or ("%" in text and _PERCENT.search(text)) or _escaped(text):
        work.append(inner_layers(Layer(text, np.arange(len(text), dtype=np.int32), np.arange(1, len(text) + 1, dtype=np.int32))))
    mark = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
    seen, layers = {(mark(text), 0, len(text))}, 0
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        key = (mark(new.text), int(new.starts[0]), int(new.ends[-1]))
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        spans.update((kind, int(new.starts[a]), int(new.ends[b - 1])) for kind, a, b in findings(new.text))
        work.append(inner_layers(new))
    order = lambda s: (s[1], RANK[s[0]], s[2])
    return sorted(base, key=order), sorted(spans, key=order), layers


def scan_secrets(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs (id_col, text): id, spans as array<struct<kind,start,end,decoded>> and n_layers.

    Null and empty texts have no spans. Repeated rows and ids stay as they are, an empty table gives an
    empty result, other columns are not read, texts are scanned whole. No shuffle: a lost executor costs
    only its own tasks.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"id": b["id"], "spans": [], "n_layers": []}
            for text in b["text"]:
                base, spans, layers = scan(text or "")
                own = set(base)
                out["spans"].append([{"kind": s[0], "start": s[1], "end": s[2], "decoded": s not in own} for s in spans])
                out["n_layers"].append(layers)
            yield out

    schema = "id bigint, spans array<struct<kind:string,start:bigint,end:bigint,decoded:boolean>>, n_layers bigint"
    return map_arrow(docs.select(F.col(id_col).cast("bigint").alias("id"), "text"), run, schema).withColumnRenamed("id", id_col)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["decoded"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in RANK),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["decoded"])).cast("bigint").alias("n_decoded"),
        "n_layers",
    )
