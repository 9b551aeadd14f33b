"""Secret scans that see through encodings.

The given text is the first layer of a worklist. Every layer is scanned for the kinds of ``KINDS`` and unwrapped:
percent escapes and Unicode escapes (``\\uXXXX``, ``\\xXX``, ``&#N;``) are decoded in place, those in a run that are no character stay; base64 runs, also such over
several lines or with a few characters glued to them, become layers of their own, and decoded bytes that are gzip, zlib, bzip2, xz or zstandard data
or a bare deflate stream are decompressed first, all members of it.
Decoded bytes are text if they are UTF-8 or UTF-16, control characters or not. New layers join the list until
nothing new appears; a text is unwrapped once, which ends cycles, but keeps every place that yields it. A match
in a layer is mapped back to the characters of the given text that it came from, at each of these places.

A document's decoded layers may hold ``MAX_DECODED`` characters together, the guard against decompression
bombs; where that is reached ``complete`` is false. The given text is never cut and its own matches don't depend on the guard.

Defined results: null text is empty; repeated rows are scanned one by one; equal spans of a kind count once.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.common import Batches, prepare, query, rows_to_batch, table, without

MAX_DECODED = 64 << 20

# ---------------------------------------------------------------------------
# The kinds of secrets, in this order.
# ---------------------------------------------------------------------------
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
# ---------------------------------------------------------------------------

#: Any of these must be in the lower-cased text before the costly pattern can match.
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PLAIN64, _SAFE64 = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}")
#: Base64 over several lines; each line but the last of a block has the same length.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_TO_PLAIN = str.maketrans("-_", "+/")

SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()), T.StructField("path", T.StringType()),
]))
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("path", pa.string())]))


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the given text's own matches."""
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield 1, m.start(), m.end()
    for m in HEX.finditer(text):
        yield 2, m.start(), m.end()


class Layer:
    """A decoded text, held once however many places yield it. ``places`` are (parent, way, pieces); pieces are (place here, start and end in
    the parent, copied): a copied piece keeps its characters, of any other each character stands for the piece's whole source."""

    def __init__(self, text: str):
        self.text = text
        self.places: list[tuple[Layer, str, list[tuple[int, int, int, bool]]]] = []


def _source(pieces: list[tuple[int, int, int, bool]], start: int, end: int) -> tuple[int, int]:
    """Span of the parent that the characters [start, end) come from."""
    at, a, _, same = pieces[bisect_right(pieces, start, key=lambda p: p[0]) - 1]
    last_at, b, stop, last_same = pieces[bisect_right(pieces, end - 1, key=lambda p: p[0]) - 1]
    return a + (start - at if same else 0), b + (end - last_at) if last_same else stop


def _member(data: bytes, room: int) -> tuple[bytes, bytes] | None:
    """Content of the first member or frame of compressed data, at most ``room`` + 1 bytes, and the data after it; None if it isn't compressed."""
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        one = zlib.decompressobj(47)
    elif data[:3] == b"BZh":
        one = bz2.BZ2Decompressor()
    elif data[:6] == b"\xfd7zXZ\x00":
        one = lzma.LZMADecompressor()
    else:
        return None
    return one.decompress(data, room + 1), one.unused_data


def _frames(data: bytes, room: int) -> bytes:
    """Content of all zstandard frames up to the first damaged one, at most ``room`` + 1 bytes."""
    parts, size, one, at = [], 0, None, 0
    try:
        while at < len(data) and size <= room:
            one = one or zstandard.ZstdDecompressor().decompressobj()
            # Fed in small steps, as 4 bytes may give 128 KB.
            parts.append(one.decompress(data[at:at + 256]))
            size += len(parts[-1])
            at = min(at + 256, len(data))
            if one.eof:
                at, one = at - len(one.unused_data), None
    except zstandard.ZstdError:
        if not size:
            raise
    return b"".join(parts)[:room + 1]


def unpacked(data: bytes, room: int) -> bytes | None:
    """The content of compressed data, all its members or frames, at most ``room`` + 1 bytes of it; None if it isn't compressed."""
    parts, size = [], 0
    try:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            return _frames(data, room)
        while size <= room and (got := _member(data, room - size)):
            parts.append(got[0])
            size += len(got[0])
            # Zeros may stand between members and after the last one.
            data = got[1].lstrip(b"\0")
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass
    return b"".join(parts) if parts else None


def _wide(data: bytes) -> str | None:
    """The UTF-16 encoding of the bytes, by its mark or because most characters have a zero half; None if it is none."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for name, half in (("utf-16-le", data[1::2]), ("utf-16-be", data[::2])):
        if len(data) % 2 == 0 and half.count(0) * 2 > len(half):
            return name
    return None


def _readable(data: bytes, room: int) -> tuple[str, str] | None:
    """Text of decoded bytes and how it was packed; None if it is none. Text over ``room`` comes one character too long."""
    packed = ""
    seen = {data}
    while (inner := unpacked(data, room)) is not None:
        data, packed = inner, packed + "/unpack"
        if not data or data in seen:
            return None
        seen.add(data)
    errors = "strict" if len(data) <= room else "ignore"
    if wide := _wide(data):
        try:
            return data.decode(wide, errors), packed + "/utf16"
        except UnicodeDecodeError:
            pass
    try:
        text = data.decode("utf-8", errors)
    except UnicodeDecodeError:
        # A deflate stream without a header has no mark; it counts if it ends where the data ends and holds text.
        if packed or (inner := _bare(data, room)) is None:
            return None
        return inner, "/unpack"
    return (text, packed) if text else None


def _bare(data: bytes, room: int) -> str | None:
    one = zlib.decompressobj(-15)
    try:
        found = one.decompress(data, room + 1)
        if not found or one.unused_data or not (one.eof or len(found) > room):
            return None
        return found.decode("utf-8", "ignore" if len(found) > room else "strict")
    except (zlib.error, UnicodeDecodeError):
        return None


def _valid(data: bytes, run: str, width: int) -> tuple[str, str, list[int]] | None:
    """UTF-8 bytes of a run of escapes of ``width`` characters each; bytes that are no part of a character stay escaped. None if all do."""
    parts, widths, at = [], [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        if "\udc80" <= c <= "\udcff":
            parts.append(run[at : at + width])
            widths += [1] * width
            at += width
        else:
            parts.append(c)
            widths.append(len(c.encode()) * width)
            at += widths[-1]
    return None if len(widths) == len(run) else ("".join(parts), "", widths)


def _units(run: str) -> tuple[str, str, list[int]] | None:
    """UTF-16 units of a run of escapes; halves of a pair that stand alone stay escaped."""
    parts, widths, at = [], [], 0
    for c in bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass"):
        if "\ud800" <= c <= "\udfff":
            parts.append(run[at : at + 6])
            widths += [1] * 6
            at += 6
        else:
            parts.append(c)
            widths.append(len(c.encode("utf-16-be")) * 3)
            at += widths[-1]
    return None if len(widths) == len(run) else ("".join(parts), "", widths)


def _unescaped(run: str) -> tuple[str, str, list[int]] | None:
    try:
        if run[:2] == "\\x":
            return _valid(bytes.fromhex(run.replace("\\x", "")), run, 4)
        if run[:3] == "\\u{":
            code = int(run[3:-1], 16)
        elif run[:2] == "\\u":
            return _units(run)
        elif run[:2] == "\\U":
            code = int(run[2:], 16)
        else:
            code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        # Half of a pair is no character.
        return None if 0xD800 <= code <= 0xDFFF else (chr(code), "", [])
    except (ValueError, OverflowError):
        return None


def _percent(run: str, room: int) -> tuple[str, str, list[int]] | None:
    data = bytes.fromhex(run.replace("%", ""))
    got = _readable(data, room)
    if got and got[1]:
        return *got, []
    return _valid(data, run, 3)


#: Text, way of decoding and pieces of a layer inside another one.
Found = tuple[str, str, list[tuple[int, int, int, bool]]]


def _in_place(text: str, pattern: re.Pattern, decode, name: str) -> Found | None:
    """The text with every run of ``pattern`` decoded; None if nothing could be."""
    parts, pieces, size, at, how = [], [], 0, 0, name
    for m in pattern.finditer(text):
        got = decode(m[0])
        if not got:
            continue
        new, packed, widths = got
        how = name + packed if packed else how
        if m.start() > at:
            parts.append(text[at:m.start()])
            pieces.append((size, at, m.start(), True))
            size += m.start() - at
        parts.append(new)
        # Characters that were escaped one by one come from their own escapes, all others from the whole run.
        source = m.start()
        for k, width in enumerate(widths):
            pieces.append((size + k, source, source + width, False))
            source += width
        if not widths:
            pieces.append((size, m.start(), m.end(), False))
        size, at = size + len(new), m.end()
    if not parts:
        return None
    if at < len(text):
        parts.append(text[at:])
        pieces.append((size, at, len(text), True))
    return "".join(parts), how, pieces


def _decoded64(run: str, room: int) -> tuple[str, str] | None:
    body = run.rstrip("=").translate(_TO_PLAIN)
    if len(body) % 4 == 1:
        return None
    try:
        return _readable(base64.b64decode(body + "=" * (-len(body) % 4), validate=True), room)
    except binascii.Error:
        return None


def _glued64(run: str, room: int) -> Iterator[tuple[str, str, int, int]]:
    """Readable contents of a run as it is or, if it has none, with up to three characters glued before it or one after it, and where they stand."""
    stop = len(run)
    for start in range(4):
        body = len(run[start:].rstrip("="))
        end = stop if body % 4 != 1 else start + body - 1
        if end - start >= 16 and (got := _decoded64(run[start:end], room)):
            yield *got, start, end
            if not start:
                return


def _blocks(lines: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The spans that wrapped data may have, likeliest first, per block of lines: lines of equal length and a shorter last one, also after
    a first line of another length; and all lines."""
    i, n = 0, len(lines)
    widths = [b - a for a, b in lines]
    while i < n:
        j = i + 1
        while j < n and widths[j] == widths[i]:
            j += 1
        ends = [j + 1, j] if j < n and widths[j] < widths[i] else [j]
        starts = [0, i] if i == 1 else [i]
        if choices := [(lines[k][0], lines[e - 1][1]) for k in starts for e in ends if e - k > 1]:
            yield choices
            if i <= 1 and ends[0] == n:
                return
        i = j
    yield [(lines[0][0], lines[-1][1])]


def unwrapped(text: str, room: int) -> Iterator[Found]:
    """The layers directly inside a text."""
    if "%" in text and (found := _in_place(text, _PERCENT, lambda r: _percent(r, room), "url")):
        yield found
    if ("\\" in text or "&#" in text) and (found := _in_place(text, _UNICODE, _unescaped, "unicode")):
        yield found
    for m in _BASE64.finditer(text):
        tried = set()
        for pattern in (_PLAIN64, _SAFE64):
            for n in pattern.finditer(m[0]):
                if (n.start(), n.end()) in tried:
                    continue
                tried.add((n.start(), n.end()))
                first = m.start() + n.start()
                for text_, packed, a, b in _glued64(n[0], room):
                    yield text_, f"base64{packed}", [(0, first + a, first + b, False)]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            for choices in _blocks([x.span() for x in _LINE.finditer(text, m.start(), m.end())]):
                for a, b in choices:
                    if got := _decoded64("".join(text[a:b].split()), room):
                        yield got[0], f"base64{got[1]}", [(0, a, b, False)]
                        break


def scan(text: str | None, max_decoded: int = MAX_DECODED) -> tuple[list[dict], bool]:
    """All spans by start, kind and end, and whether every layer was taken."""
    text = text or ""
    top = Layer(text)
    layers, todo, room, complete = {text: top}, deque([top]), max_decoded, True
    while todo:
        parent = todo.popleft()
        for inner, way, pieces in unwrapped(parent.text, room):
            if (layer := layers.get(inner)) is None:
                if len(inner) > room:
                    complete = False
                    continue
                room -= len(inner)
                layer = layers[inner] = Layer(inner)
                todo.append(layer)
            layer.places.append((parent, way, pieces))
    spans = {x: (True, "") for x in matches(text)}
    # Every match goes up through all places of its layer; a span of a layer that was followed before is not followed again.
    followed = set()
    for layer in layers.values():
        up = deque((layer, *x, "") for x in matches(layer.text)) if layer is not top else deque()
        while up:
            own, kind, start, end, path = up.popleft()
            for parent, way, pieces in own.places:
                found = (parent, kind, *_source(pieces, start, end))
                if parent is top:
                    spans.setdefault(found[1:], (False, way + path))
                elif found not in followed:
                    followed.add(found)
                    up.append((*found, f"/{way}{path}"))
    rows = [
        {"kind": KINDS[k], "start": s, "end": e, "base": base, "path": path}
        for (k, s, e), (base, path) in sorted(spans.items(), key=lambda x: (x[0][1], x[0][0], x[0][2]))
    ]
    return rows, complete


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, max_decoded: int = MAX_DECODED) -> DataFrame:
    """The ``keep`` columns (all, if None) with ``secrets`` (kind, start, end, whether in the text as it is, way of decoding) and ``complete``."""
    prepare(docs.sparkSession)
    columns = without(docs.select(keep) if keep is not None else docs, "secrets", "complete")
    df = docs.select(*columns, *([] if text in columns else [text]))
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("secrets", SPAN), T.StructField("complete", T.BooleanType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [scan(x, max_decoded) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield rows_to_batch(batch, columns, {
                "secrets": pa.array([f[0] for f in found], _SPAN), "complete": pa.array([f[1] for f in found], pa.bool_()),
            })

    return df.mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), "complete"
    )
