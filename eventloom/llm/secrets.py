"""Secret scans with a worklist of decoded layers.

A text is scanned for secrets; then its encoded parts are unwrapped (percent escapes,
Unicode escapes, base64, compressed bytes), each result is a layer that is scanned and
unwrapped again, until nothing new turns up. A layer that was seen before, with the same text from the same
places of the document, is not taken up again, so cycles end. Each layer knows for its every character which span of the
document it came from, so that findings are given as spans of the document.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

KINDS = ("assign", "access", "hex")
#: Compressed bytes that unwrap to more are counted in ``n_oversized`` and read in blocks, each a layer.
MAX_DECODED = 1 << 26
#: Bytes of a block, and those that it shares with the next one; a block ends within no encoded part that is shorter than ``MAX_DECODED``.
BLOCK, OVERLAP = 1 << 22, 1 << 20
#: Where bombs end: compressed layers within each other (counted in ``n_oversized``, too), and bytes that the blocks of one hold.
MAX_DEPTH, MAX_BLOCKS = 64, 1 << 32

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the runs of 20 and more are the same as those filtered afterwards
_HEX = re.compile(r"[0-9a-f]{24,}")

#: A percent sign that is escaped again and again is unwrapped to its end at once: %252541 is %41's character, not a layer for each 25.
_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ONE_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"%u[dD][89abAB][0-9a-fA-F]{2}%u[dD][c-fC-F][0-9a-fA-F]{2}|%u[0-9a-fA-F]{4}|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#x[0-9a-fA-F]{1,6};|&#[0-9]{1,7};")
_AGAIN = frozenset("\\&%")
_LONGEST_ESCAPE = 12
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PART = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/]+)+={0,2}")
_PACKED = re.compile(r"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|BZh[1-9]1AY|\xfd7zXZ\x00")
_BYTES = re.compile("[\x00-\xff]+")
_GAP = re.compile(rb"[^A-Za-z0-9+/_=%\\&#;{}-]")
_TO_PLAIN64 = str.maketrans("-_", "+/")
_BLANK = str.maketrans("\t\n\r\v\f", "     ")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each finding, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text and, for each of its characters, the span of the document that it came from."""

    __slots__ = ("text", "starts", "ends", "unpacked")

    def __init__(self, text: str, starts=None, ends=None, unpacked: bool = False):
        self.text, self.unpacked = text, unpacked
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = np.arange(1, len(text) + 1) if ends is None else ends

    @classmethod
    def within(cls, text: str, start: int, end: int) -> Layer:
        """A text out of compressed bytes: every character came from the same span, which takes no memory."""
        return cls(text, np.broadcast_to(np.int64(start), len(text)), np.broadcast_to(np.int64(end), len(text)), True)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def key(self) -> bytes:
        """A digest of the text and of where each of its characters came from."""
        out = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=20)
        if self.unpacked and len(self.text):
            out.update(f"{self.starts[0]} {self.ends[0]}".encode())
        else:
            out.update(np.ascontiguousarray(self.starts, np.int64))
            out.update(np.ascontiguousarray(self.ends, np.int64))
        return out.digest()


def _characters(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Text of the bytes (UTF-8, else one character a byte) with the byte span of each character."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), np.arange(len(data)), np.arange(1, len(data) + 1)
    if len(text) == len(data):
        return text, np.arange(len(data)), np.arange(1, len(data) + 1)
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    return text, starts, np.append(starts[1:], len(data))


def _text(data: bytes) -> str:
    """As of ``_characters``."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _wide(data: bytes) -> Iterator[str]:
    """Bytes with a NUL read as UTF-16 of either order, a character for every two bytes."""
    if b"\0" in data and len(data) > 1:
        for kind in ("<u2", ">u2"):
            yield np.frombuffer(data[: len(data) // 2 * 2], kind).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _pieces(data: bytes) -> Iterator[bytes]:
    """What compressed bytes hold, some at a time; nothing from where they are not compressed data after all."""
    try:
        if data.startswith(b"\x28\xb5\x2f\xfd"):
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(data)
            while out := reader.read(BLOCK):
                yield out
        elif data.startswith(b"\x1f\x8b") or data[:1] == b"x":
            while data.startswith(b"\x1f\x8b") or data[:1] == b"x":  # one member after another
                tool = zlib.decompressobj(31 if data[:1] == b"\x1f" else 15)
                while out := tool.decompress(data, BLOCK):
                    yield out
                    data = tool.unconsumed_tail
                if out := tool.flush():
                    yield out
                data = tool.unused_data
        elif data.startswith((b"BZh", b"\xfd7zXZ\x00")):
            while data.startswith((b"BZh", b"\xfd7zXZ\x00")):
                tool = bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()
                while out := tool.decompress(data, BLOCK):
                    yield out
                    data = b""
                    if tool.eof:
                        break
                data = tool.unused_data if tool.eof else b""
    except Exception:
        return


def _blocks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks that end behind a line end where there is one; each shares OVERLAP bytes with the one before."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) > BLOCK:
            cut = held.rfind(b"\n", BLOCK - OVERLAP, BLOCK) + 1
            if not cut:
                gap = _GAP.search(held, max(BLOCK - OVERLAP, len(held) - len(piece)))
                if gap is None and len(held) <= MAX_DECODED:
                    break  # an encoded part is open
                cut = gap.end() if gap else len(held)
            yield bytes(held[:cut])
            start = cut - OVERLAP
            del held[: held.find(b"\n", start, start + OVERLAP // 2) + 1 or start]
    if held:
        yield bytes(held)


def _bare(data: bytes) -> Iterator[bytes]:
    """What deflated bytes without a header hold, if all of them are that."""
    tool = zlib.decompressobj(-15)
    try:
        first = tool.decompress(data, 64)  # most other bytes end here
        if not first and not tool.eof:
            return
        held = tool.unconsumed_tail
        ends = zlib.decompressobj(-15)
        rest = data
        while not ends.eof and rest:
            ends.decompress(rest, BLOCK)
            rest = ends.unconsumed_tail
        if not ends.eof or ends.unused_data:
            return
        yield first
        while out := tool.decompress(held, BLOCK):
            yield out
            held = tool.unconsumed_tail
    except zlib.error:
        return


def _unpack(data: bytes, start: int, end: int, limit: int, pieces: Iterator[bytes] | None = None) -> Iterator[Layer | None]:
    """Layers out of compressed bytes: one, or None and one for each block if they hold over ``limit``."""
    pieces, held, size = _pieces(data) if pieces is None else pieces, [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size > limit:
            yield None
            left = MAX_BLOCKS
            for block in _blocks(chain(held, pieces)):
                left -= len(block)
                if left < 0:
                    return
                yield from _layers_of(block, start, end)
            return
    if held:
        yield from _layers_of(b"".join(held), start, end)


def _layers_of(data: bytes, start: int, end: int) -> Iterator[Layer]:
    yield Layer.within(_text(data), start, end)
    for text in _wide(data):
        if _holds(text):
            yield Layer.within(text, start, end)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match replaced by what ``decode`` makes of it: text, starts and ends within the match.

    A match may go on behind what the pattern found, where ``decode`` follows marks that unwrap to the beginning of a mark.
    """
    texts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        if m.start() < at:
            continue
        found = decode(m)
        if found is None:
            continue
        text, a, b, e = found
        s = m.start()
        texts += [layer.text[at:s], text]
        starts += [layer.starts[at:s], layer.starts[s + a]]
        ends += [layer.ends[at:s], layer.ends[s + b - 1]]
        at = e
    if not texts:
        return None
    texts.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))


def _percent(m: re.Match):
    run = m.group()
    if "%25" in run:
        units = [(u.start(), u.end(), u.group(1)) for u in _ONE_PERCENT.finditer(run)]
        first, last = (np.array([u[k] for u in units]) for k in (0, 1))
        text, a, b = _characters(bytes.fromhex("".join(u[2] for u in units)))
        return text, first[a], last[b - 1], m.end()
    text, a, b = _characters(bytes.fromhex(run.replace("%", "")))
    return text, 3 * a, 3 * b, m.end()


def _escape(m: re.Match):
    """The character of a mark; one that begins another mark with what follows is unwrapped on, so that chains take one pass."""
    text, end = m.string, m.end()
    char = _escaped(m.group())
    while char in _AGAIN and (more := _ESCAPE.match(char + text[end : end + _LONGEST_ESCAPE])) and (inner := _escaped(more.group())) is not None:
        char, end = inner, end + more.end() - 1
    return None if char is None else (char, np.zeros(1, int), np.full(1, end - m.start()), end)


def _escaped(mark: str) -> str | None:
    if mark.startswith("&#x"):
        code = int(mark[3:-1], 16)
    elif mark.startswith("&#"):
        code = int(mark[2:-1])
    elif mark.startswith("\\u{"):
        code = int(mark[3:-1], 16)
    elif len(mark) == 12:
        code = 0x10000 + ((int(mark[2:6], 16) - 0xD800) << 10) + int(mark[8:12], 16) - 0xDC00
    else:
        code = int(mark[2:], 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def _base64_bytes(token: str) -> bytes | None:
    token = token.rstrip("=").translate(_TO_PLAIN64)
    if len(token) % 4 == 1:
        return None
    try:
        return base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _payload(layer: Layer, places: np.ndarray, token: str, limit: int) -> Iterator[Layer | None]:
    """The layers in a base64 token whose characters stand at ``places`` of the layer.

    Readable UTF-8 is a layer; other bytes are if there is a secret or something to unwrap in
    them, read as UTF-8, else one character a byte, or as UTF-16.
    """
    data = _base64_bytes(token)
    if not data:
        return
    found = False
    around = int(layer.starts[places].min()), int(layer.ends[places].max())
    for inner in _unpack(data, *around, limit):
        found = True
        yield inner
    if found:
        return
    for inner in _unpack(data, *around, limit, _bare(data)):
        if inner is None or _holds(inner.text):
            yield inner
    wide = ((t, 2 * np.arange(len(t)), 2 * np.arange(1, len(t) + 1)) for t in _wide(data))
    for text, a, b in chain([_characters(data)], wide):
        if len(text) >= 6 and (_readable(data, text) or _holds(text)):
            first, last = places[a * 4 // 3], places[np.minimum(len(places) - 1, (b * 4 + 2) // 3 - 1)]
            yield Layer(text, layer.starts[first], layer.ends[last])


def _readable(data: bytes, text: str) -> bool:
    if not text.translate(_BLANK).isprintable():
        return False
    try:
        return data.decode("utf-8") == text
    except UnicodeDecodeError:
        return False


def unwrap(layer: Layer, limit: int) -> Iterator[Layer | None]:
    """The layers directly below; None for one that would go beyond the limit."""
    text = layer.text
    if "%" in text and (found := _replaced(layer, _PERCENT, _percent)):
        yield found
    if ("\\" in text or "&#" in text or "%u" in text) and (found := _replaced(layer, _ESCAPE, _escape)):
        yield found
    for m in _BASE64.finditer(text):
        # The whole run first; if it holds nothing readable, its parts between marks that paths and names are made with.
        for start, token in [(m.start(), m.group()), *((m.start() + p.start(), p.group()) for p in _PART.finditer(m.group()) if p.group() != m.group())]:
            done = False
            for found in _payload(layer, np.arange(start, start + len(token)), token, limit):
                yield found
                done = done or found is None or found.unpacked or found.text.translate(_BLANK).isprintable()
            if done and token == m.group():
                break
        else:
            # Letters may stand before the token without a mark between.
            for shift in (1, 2, 3):
                if m.end() - m.start() >= 16 + shift:
                    yield from _payload(layer, np.arange(m.start() + shift, m.end()), m.group()[shift:], limit)
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            # Lines as wide as the first, and one that is not wider.
            lines = [(p.start(), p.end()) for p in re.finditer(r"[^\s]+", m.group())]
            while lines:
                wide = lines[0][1] - lines[0][0]
                n = next((k for k, (a, b) in enumerate(lines) if b - a != wide), len(lines))
                take = lines[: n + (n < len(lines) and lines[n][1] - lines[n][0] < wide + 1)]
                if len(take) > 1:
                    keep = np.concatenate([np.arange(a, b) for a, b in take])
                    yield from _payload(layer, m.start() + keep, "".join(m.group()[a:b] for a, b in take), limit)
                lines = lines[max(n, 1) :]
    if _PACKED.search(text):
        for m in _PACKED.finditer(text):
            run = _BYTES.match(text, m.start())
            yield from _unpack(run.group().encode("latin-1"), *layer.span(m.start(), run.end()), limit)


def _encoded(text: str) -> bool:
    """Whether there may be anything to unwrap."""
    return bool(
        ("%" in text and _PERCENT.search(text))
        or (("\\" in text or "&#" in text or "%u" in text) and _ESCAPE.search(text))
        or _BASE64.search(text)
        or _PACKED.search(text)
    )


def _holds(text: str) -> bool:
    return _encoded(text) or bool(scan(text))


def find(text: str, limit: int = MAX_DECODED) -> tuple[list, list, int, int]:
    """Findings of the text itself, of the text and all layers, the number of layers, and of compressed ones over the limit."""
    base = scan(text)
    if not _encoded(text):
        return base, base, 0, 0
    top = Layer(text)
    every, seen, layers, oversized = set(base), {top.key()}, 0, 0
    # What compressed bytes hold is worked off at once, so that one such text is held for each depth; what is held counts against the limit.
    stack = [(deque([top]), iter(()), 0)]
    while stack:
        work, children, size = stack[-1]
        for child in children:
            if child is None:
                oversized += 1
            elif child.text and (key := child.key()) not in seen:
                seen.add(key)
                layers += 1
                for start, kind, end in scan(child.text):
                    a, b = child.span(start, end)
                    every.add((a, kind, b))
                if not child.unpacked:
                    work.append(child)
                elif len(stack) <= MAX_DEPTH:
                    stack.append((deque([child]), iter(()), len(child.text)))
                    break
                else:
                    oversized += _encoded(child.text)
        else:
            if work:
                room = max(min(limit, BLOCK), limit - sum(s for _, _, s in stack))
                stack[-1] = work, unwrap(work.popleft(), room), size
            else:
                stack.pop()
    return base, sorted(every), layers, oversized


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FINDINGS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("base", T.ArrayType(SPAN)),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("n_layers", T.LongType()),
        T.StructField("n_oversized", T.LongType()),
    ]
)


def _find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), span, span, pa.int64(), pa.int64()]
    for batch in chunks(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, every, layers, oversized = find(text or "")
            rows.append((doc_id, *([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found] for found in (base, every)), layers, oversized))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=FINDINGS.names)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``FINDINGS`` of every row of ``docs``: spans of code points, ends exclusive, by start, then kind.

    ``base`` has those of the text as it stands, ``spans`` these and those of all layers.
    Null texts are empty; null ids stay null; repeated rows give repeated results; further
    columns are not read; an empty table gives no rows. ``n_oversized`` counts compressed
    layers of over ``MAX_DECODED`` bytes, which are read in blocks, and those too deep.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_find_all, FINDINGS)


def redact(text: str) -> str:
    """The text with every finding, from whatever layer, replaced by a mark of its kind."""
    spans = sorted(find(text)[1])
    out, at = [], 0
    i = 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[redacted {KINDS[kind]}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:] if out else text


def redacted(text: Column) -> Column:
    """``redact`` of each text; nulls stay null, empty texts empty, and equal texts give equal results."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t))

    return run(text.cast("string"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_layers", "n_oversized")
