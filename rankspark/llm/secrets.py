"""Secret scans through nested encodings.

A text is the first layer of a worklist.  Every layer is scanned with the base patterns; then its
encoded parts are unwrapped into new layers, until nothing new comes up:

- percent escapes and Unicode escapes (``\\uXXXX``, ``\\xXX``, ``&#N;``) are decoded in place, so that a
  secret half inside an escape is seen with its surroundings;
- base64 fragments become layers of their own, whether other characters are glued to them or line breaks
  divide them (``_fragments``); bytes with the mark of gzip, zlib, bzip2 or xz are
  decompressed before they are read as text, all members of a stream, and a broken one up to its break.

Decoded bytes are scanned whatever they are: as UTF-8, or else as Latin-1, and as UTF-16 (``utf16`` in the
path) where zero bytes alternate.  Of percent and Unicode escapes the valid parts are decoded.

Layers are remembered by the digest of their text and of its places in the original, so that a layer that
contains itself ends the walk (it keeps the place of what it came from), while a repeated fragment is
scanned at each of its places.  Each layer knows
for each of its characters which span of the original text it came from (``_Layer``); a secret found
in a layer is reported at the original span that carries it, with the path of the encodings before its
kind, as in ``url/assign`` or ``base64+gzip/access``.

A chain of more than ``DEEP`` escaped escape characters (``%252525..``, ``\\u005cu005c..``, ``&#38;#38;..`` or a mix)
is taken to its end in one step, ``deep`` in the path: the layers in between would only shorten what
was scanned before.

A layer of more than ``MAX_LAYER`` decompressed bytes is never held as a whole: it is read in windows that
overlap, each with all that is encoded in it, and also reported as ``oversized`` at its span, since an encoded
part longer than the overlap is read up to the end of its window only.

Edge cases: null and empty texts have no spans; a row with a null doc_id is scanned like any other;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import each_text, sliced, texts_of

# The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones can be left out at once
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

MAX_LAYER = 64 << 20
DEEP = 8
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
# Escapes of the characters that begin escapes; which of them follow on each other is for ``_chained`` to see.
_CHAIN = re.compile(
    r"[%%\\&](?:25|5[cC]|26|u00(?:25|5[cC]|26)|x(?:25|5[cC]|26)|#0{0,3}(?:37|92|38);|#[xX]0{0,3}(?:25|5[cC]|26);){%d,}+" % (DEEP + 1))
_LINK = {"%": re.compile(r"[0-9A-Fa-f]{2}"), "\\": re.compile(r"u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}"), "&": re.compile(r"#[0-9]+;|#[xX][0-9A-Fa-f]+;")}
# What a short layer must have to be worth a scan, and text in two-byte characters.
_WORTH = re.compile(r"password|passwd|secret|token|api|AKIA|[0-9a-f]{32}|%[0-9a-f]{2}|\\[ux]|&#|[a-z0-9+/_\s-]{16}", re.IGNORECASE | re.ASCII)
_WIDE = re.compile(rb"(?:[\t-~]\x00){8}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}")
_GLUE = re.compile(r"[+/_-]")
_MARK = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00")  # long enough to be looked for anywhere
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"))
_STEP, _PIECE = 512, 1 << 20  # compressed bytes fed and decompressed bytes taken at once


@dataclass(frozen=True, order=True)
class Span:
    start: int
    order: int  # place of the kind: base kinds as listed, then found ones
    kind: str
    end: int


@dataclass
class _Layer:
    """Text and, for each of its characters, where in the original it starts and ends (None: the same place)."""

    text: str
    path: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def key(self) -> bytes:
        """Digest of the text and its places; one place for all of it counts once."""
        digest = hashlib.blake2b(self.text.encode(errors="surrogatepass"), digest_size=16)
        for places in (self.starts, self.ends):
            if places is not None:
                digest.update(b"|" + (places[:1] if (places[:1] == places).all() else places).tobytes())
        return digest.digest()

    def named(self, step: str) -> str:
        return f"{self.path}+{step}" if self.path else step


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, non-overlapping by kind, too short ones dropped after matching."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _spliced(layer: _Layer, pattern: re.Pattern, decode, step: str) -> _Layer | None:
    """The layer with every match of ``pattern`` decoded in place; a match that cannot be decoded stays."""
    pieces, starts, ends, at = [], [], [], 0
    index = np.arange(len(layer.text) + 1)
    first = index[:-1] if layer.starts is None else layer.starts
    last = index[1:] if layer.ends is None else layer.ends
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        a, b = m.span()
        pieces += [layer.text[at:a], got]
        starts += [first[at:a], np.full(len(got), first[a])]
        ends += [last[at:a], np.full(len(got), last[b - 1])]
        at = b
    if not at:
        return None
    pieces.append(layer.text[at:])
    starts.append(first[at:])
    ends.append(last[at:])
    return _Layer("".join(pieces), layer.named(step), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> str | None:
    """The run with all valid UTF-8 decoded; bytes that are none stay as they are written."""
    out, at = [], 0
    for c in bytes.fromhex(run.replace("%", "")).decode(errors="surrogateescape"):
        wrong = 0xDC80 <= ord(c) < 0xDD00
        out.append(run[3 * at: 3 * at + 3] if wrong else c)
        at += 1 if wrong else len(c.encode())
    return got if (got := "".join(out)) != run else None


def _escape(run: str) -> str | None:
    if run.startswith("&#"):
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    if run.startswith("\\x"):
        return chr(int(run[2:], 16))
    out, at = [], 0
    # pairs of surrogates stand for one character; single ones stay as they are written
    for c in bytes.fromhex("".join(run.split("\\u"))).decode("utf-16-be", "surrogatepass"):
        out.append(run[6 * at: 6 * at + 6] if 0xD800 <= ord(c) < 0xE000 else c)
        at += 1 + (ord(c) > 0xFFFF)
    return got if (got := "".join(out)) != run else None


def _chained(run: str) -> str | None:
    """The run with the chain of escapes at its front decoded to the end; None if it is no longer than ``DEEP``."""
    now, at, links = run[0], 1, 0
    while (m := _LINK[now].match(run, at)) is not None:
        link = m[0].strip("ux#X;")
        got = chr(int(link, 10 if now == "&" and m[0][1] not in "xX" else 16))
        if got not in _LINK:
            break
        now, at, links = got, m.end(), links + 1
    return now + run[at:] if links > DEEP else None


def _kind(raw: bytes, at: int = 0) -> str | None:
    """The compression whose mark stands at ``at``; for zlib any head that its format allows."""
    if kind := next((k for mark, k in _MAGIC if raw.startswith(mark, at)), None):
        return kind
    head = raw[at: at + 2]
    return "zlib" if len(head) == 2 and head[0] & 15 == 8 and head[0] < 128 and int.from_bytes(head) % 31 == 0 else None


def _inflated(raw: bytes, at: int, kind: str) -> Iterator[tuple[bytes, int]]:
    """Bounded pieces, each with its end, of what is compressed from ``at`` on, all members; up to the break if it is broken or cut off."""
    make = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
    while at < len(raw) and _kind(raw, at) == kind:
        tool, fed = make[kind](), at
        while not tool.eof:
            held = tool.unconsumed_tail if kind in ("gzip", "zlib") else b""
            data = held or (b"" if not getattr(tool, "needs_input", True) else raw[fed: fed + _STEP])
            fed += 0 if held else len(data)
            try:
                piece = tool.decompress(data, _PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            if piece or tool.eof:
                yield piece, fed - len(tool.unused_data)
            elif not data:
                return
        at = fed - len(tool.unused_data)
        while kind in ("gzip", "xz") and raw[at: at + 1] == b"\0":  # members may be padded
            at += 1


def _expand(raw: bytes, at: int, kind: str, limit: int) -> tuple[bytes | None, int]:
    """Decompressed bytes of all members from ``at`` on, None beyond the limit, and where they end."""
    parts, size, end = [], 0, at
    for piece, end in _inflated(raw, at, kind):
        size += len(piece)
        parts.append(piece) if size <= limit else parts.clear()
    return b"".join(parts) if size <= limit else None, end


def _windows(raw: bytes, at: int, kind: str, limit: int) -> Iterator[bytes]:
    """The same bytes in windows of about an eighth of the limit, each with the last quarter of the one before it."""
    size = max(limit // 8, 64)
    held, old = bytearray(), 0
    for piece, _ in _inflated(raw, at, kind):
        held += piece
        while len(held) >= size:
            yield bytes(held[:size])
            old = size // 4
            del held[: size - old]
    if len(held) > old:
        yield bytes(held)


def _texts(raw: bytes) -> Iterator[tuple[list[str], str]]:
    """(steps, text) of all readings of some bytes in which a pattern or an encoding can be found.

    The patterns are ASCII, so that Latin-1 shows all of them in bytes that are not UTF-8.
    """
    try:
        readings = [([], raw.decode())]
    except UnicodeDecodeError:
        readings = [([], raw.decode("latin-1"))]
    if _WIDE.search(raw):  # little-endian from one of the two places, big-endian from the other
        readings += [(["utf16"], raw[at:].decode("utf-16-le", "replace")) for at in (0, 1)]
    yield from (r for r in readings if len(r[1]) > 4096 or _WORTH.search(r[1]))


def _unwrapped(raw: bytes, starts: np.ndarray, limit: int,
               above: tuple = ([], None), seen: set | None = None) -> Iterator[tuple[list[str], str | None, int, int]]:
    """(steps, text, from, to) of all readings of some bytes, through any compression.

    Beyond the limit the text is None once; after that come the readings of the windows.  ``above`` has the
    steps and the place of bytes that are such a window, ``seen`` what was read around it.

    Where a stream begins: at the marks that cannot stand by chance, at the front and at ``starts``.  Plain text
    can look like a zlib head, so bytes are read as they are, too.
    """
    work, seen = [(raw, *above)], set() if seen is None else seen
    while work:
        now, steps, place = work.pop()
        digest = (hashlib.blake2b(now, digest_size=16).digest(), place)
        if digest in seen:
            continue
        seen.add(digest)
        for how, text in _texts(now):
            yield steps + how, text, *(place or (0, len(now)))
        marks = {m.start() for m in _MARK.finditer(now)} | {0} | (set(starts.tolist()) if place is None else set())
        done = 0
        for at in sorted(marks):
            if at < done or (kind := _kind(now, at)) is None:
                continue
            out, end = _expand(now, at, kind, limit)
            if out:
                work.append((out, steps + [kind], place or (at, end)))
            elif out is None:
                yield steps + [kind], None, *(place or (at, end))
                for window in _windows(now, at, kind, limit):
                    yield from _unwrapped(window, np.empty(0, np.int64), limit, (steps + [kind], place or (at, end)), seen)
            if out != b"":
                done = end if kind != "zlib" or end - at > _STEP else done


def _fragments(text: str) -> Iterator[tuple[int, np.ndarray, str]]:
    """(first, places, characters) of every run of base64 characters, and of every run that line breaks divide.

    ``places`` has the place of each character after ``first``.
    """
    for m in _BASE64.finditer(text):
        yield m.start(), np.arange(m.end() - m.start()), m[0]
    for m in _WRAPPED.finditer(text):
        if len(m[0]) > 16:
            codes = np.frombuffer(m[0].encode("ascii"), np.uint8)
            places = np.flatnonzero(codes > 32)
            if len(places) >= 16:
                yield m.start(), places, codes[places].tobytes().decode()


class _Run:
    """A fragment, read in the four alignments, and where each reading of it lies."""

    def __init__(self, places: np.ndarray, run: str):
        self.size = len(run)
        self.body = run.rstrip("=").translate({45: 43, 95: 47})
        self.places, n = places, len(self.body)
        lines = np.flatnonzero(np.diff(places[:n]) > 1) + 1
        glue = np.array([m.start() for m in _GLUE.finditer(run[:n])], np.int64)
        self.begins = np.unique(np.concatenate([[0], lines, glue + 1]))  # where a payload may begin
        self.stops = np.unique(np.concatenate([lines, glue, [n]]))       # and where it may end

    def raw(self, shift: int) -> bytes:
        body = self.body[shift:]
        if len(body) % 4 == 1:  # a character alone holds no byte
            body = body[:-1]
        return base64.b64decode(body + "=" * (-len(body) % 4))

    def starts(self, shift: int) -> np.ndarray:
        """Bytes of a reading at which a payload may begin."""
        begins = self.begins[self.begins % 4 == shift]
        return (begins - shift) // 4 * 3

    def span(self, first: int, end: int) -> tuple[int, int]:
        """Places of the characters first to end, with the padding if they reach it."""
        last = self.size if end >= len(self.body) else end
        return int(self.places[first]), int(self.places[last - 1]) + 1

    def stream(self, shift: int, low: int, high: int) -> tuple[int, int]:
        """Span of the bytes low to high of a reading, up to the next stop."""
        end = shift + -(-high * 8 // 6)
        k = int(np.searchsorted(self.stops, end))
        begin = int(np.searchsorted(self.begins, shift + low * 8 // 6, side="right")) - 1
        return self.span(int(self.begins[begin]), int(self.stops[min(k, len(self.stops) - 1)]))

    def clean_spans(self, shift: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a reading the span of the payload it is in: from the first begin to the last stop in the
        stretch of plain characters around it, or the whole run where there is none."""
        codes = np.frombuffer(raw, np.uint8)
        bad = np.flatnonzero(((codes < 32) & (codes != 9) & (codes != 10) & (codes != 13)) | (codes > 126))
        at = np.arange(len(codes))
        k = np.searchsorted(bad, at)
        low = np.concatenate([[0], bad + 1])[np.searchsorted(bad, at, side="right")]
        high = np.append(bad, len(codes))[k]
        begins = self.starts(shift)
        chars = np.append(begins // 3 * 4 + shift, 0)
        slot = np.searchsorted(begins, low)
        fits = np.append(begins, len(codes))[slot] <= at
        first = np.where(fits, chars[slot], 0)
        ends = self.stops[self.stops > shift]
        whole = (ends - shift) * 6 // 8
        slot = np.searchsorted(whole, high, side="right") - 1
        fits = (slot >= 0) & (whole[slot] > at)
        end = np.where(fits, ends[slot], len(self.body))
        last = np.where(end >= len(self.body), self.size, end)
        return self.places[first], self.places[last - 1] + 1


def _plain(raw: bytes) -> bool:
    """UTF-8 and nearly all of it meant to be read: such a reading is one payload."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return False
    return sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.9 * len(text)


def scan(text: str, limit: int = MAX_LAYER) -> list[Span]:
    """Every span of one text, in order."""
    base = base_matches(text)
    found = {(kind, a, b): Span(a, KINDS.index(kind), kind, b) for kind, a, b in base}
    seen = set()

    def add(kind: str, path: str, a: int, b: int) -> None:
        if (kind, a, b) not in found:  # the same secret, seen again through a layer around it
            found[(kind, a, b)] = Span(a, len(KINDS), f"{path}/{kind}", b)

    def inside(layer: _Layer, at_once) -> Iterator[_Layer]:
        """The layers that a layer holds; those of windows go to ``at_once``, so that one window is held at a time."""
        escaped = "%" in layer.text or "\\" in layer.text or "&#" in layer.text
        if escaped and _CHAIN.search(layer.text) and (child := _spliced(layer, _CHAIN, _chained, "deep")):
            yield child
        else:
            if "%" in layer.text and (child := _spliced(layer, _PERCENT, _percent, "url")):
                yield child
            if ("\\" in layer.text or "&#" in layer.text) and (child := _spliced(layer, _ESCAPE, _escape, "unicode")):
                yield child
        for first, places, letters in _fragments(layer.text):
            run, cut = _Run(places + first, letters), False
            for shift in range(4):
                raw, path = run.raw(shift), layer.named("base64")
                starts = run.starts(shift)
                for steps, inner, low, high in _unwrapped(raw, starts, limit):
                    name = "+".join([path, *steps])
                    if steps and steps != ["utf16"]:  # a stream: from where it begins to the next place where it may end
                        place = layer.origin(*run.stream(shift, low, high))
                    else:
                        place = layer.origin(*run.span(0, len(run.body)))
                    if inner is None:
                        add("oversized", name.rpartition("+")[0], *place)
                        cut = True
                        continue
                    if steps or shift == 0 and _plain(raw):
                        child = _Layer(inner, name, np.broadcast_to(place[0], len(inner)), np.broadcast_to(place[1], len(inner)))
                    else:
                        inner = raw.decode("latin-1")  # a character for each byte
                        a, b = run.clean_spans(shift, raw)
                        if layer.starts is not None:
                            a, b = layer.starts[a], layer.ends[b - 1]
                        child = _Layer(inner, name, a, b)
                    if cut:
                        at_once(child)
                    else:
                        yield child

    def fresh(layer: _Layer) -> bool:
        size = len(seen)
        seen.add(layer.key())
        return len(seen) > size

    def walk(top: _Layer) -> None:
        work = [top] if fresh(top) else []
        while work:
            layer = work.pop()
            if layer.path:
                for kind, a, b in base_matches(layer.text):
                    add(kind, layer.path, *layer.origin(a, b))
            work += filter(fresh, inside(layer, walk))

    walk(_Layer(text, ""))
    return sorted(found.values())


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def secret_spans(docs: DataFrame, limit: int = MAX_LAYER) -> DataFrame:
    """doc_id and ``found``, an array of (kind, start, end), of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for keys, texts in each_text(batches):
            rows = [[{"kind": s.kind, "start": s.start, "end": s.end} for s in scan(t, limit)] for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "found": pa.array(rows, kind)})

    return texts_of(docs).mapInArrow(find, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def secret_digest(docs: DataFrame, limit: int = MAX_LAYER) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text, for every row."""
    spans = secret_spans(docs, limit)
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS))
    text = (lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","))
    many = (lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long"))
    return spans.select("doc_id", *[many(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, and spans that touch or overlap as one, replaced by ``mark``."""
    out, at, end = [], 0, -1
    for s in spans:
        if s.start > end:
            out += [text[at: s.start], mark] if end < 0 else [text[end: s.start], mark]
        end = max(end, s.end)
    return "".join(out) + text[end:] if end >= 0 else text


def redacted(docs: DataFrame, limit: int = MAX_LAYER) -> DataFrame:
    """``docs`` with secrets out of ``text``, all other columns and rows as they are; ``n_chars``, if there, follows."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            fresh = [t if not t or not (s := scan(t, limit)) else redact(t, s) for t in texts]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(fresh, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], schema=batch.schema)

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
