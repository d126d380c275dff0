"""Secret scan with a worklist of decoded layers."""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed (fixed values).
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: URL escapes: one nested many times over, whose rounds are taken at once, or a run of plain ones.
_PERCENT = re.compile(r"(%(?:25){9,}[0-9A-Fa-f]{2})|(?:%[0-9A-Fa-f]{2}(?!(?<=25)(?:25){8}))+")
_UNICODE = re.compile(r"(?<!\\)\\++(?:u[dD][89abAB][0-9A-Fa-f]{2}\\++u[dD][c-fC-F][0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})")
#: For base64 and hex: a run, a run of any length, and the next line's run after a line break, raw or escaped. The
#: shortest secret has 12 bytes (token=abcdef), which make 16 and 24 characters.
_BREAK = r"[ \t]*(?:\\?\r?\n|\r|(?:\\r)?\\n)[ \t]*"
_RUNS = tuple((re.compile(f"{x}{{{least},}}"), re.compile(f"{x}+"), re.compile(f"{_BREAK}({x}+)")) for x, least in ((r"[A-Za-z0-9+/_-]", 16), (r"[0-9A-Fa-f]", 24)))
_PAD = re.compile("={0,2}")
#: Where escaped bytes may stand, the escapes that one byte string uses, and how compressed data begins.
_BYTES = (("%", re.compile(r"[^\s<>\"']+"), re.compile(rb"%([0-9A-Fa-f]{2})")), ("\\x", re.compile(r"[^\r\n]+"), re.compile(rb"\\(?:x([0-9A-Fa-f]{2})|([abfnrtv0\\'\"]))")))
_SIMPLE_ESCAPES = dict(zip(b"abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\"", strict=True))
_MAGIC = re.compile(rb"(?=(\x1f\x8b\x08|BZh[1-9][1\x17])|[\x08\x18(8HXhx][\x00-\xff])", re.S)
_UNCLEAN = re.compile("[\x00-\x08\x0e-\x1f\x7f�]")
#: Characters of unfolded data that are scanned together; more only where nothing in them ends every secret and run.
PIECE = 4 << 20
#: Bytes of an unfolded layer that are held at least; bytes that bzip2 unfolds in a call; characters of the shortest secret.
SPOOL, BZIP_STEP, LEAST = 16 << 20, 32, 12
_RUN_AFTER, _RUN_BEFORE = re.compile(r"[ \t]*[A-Za-z0-9+/_-]{16}"), re.compile(r"[A-Za-z0-9+/_-]{16}={0,2}\Z")
_OTHER = r"""[^A-Za-z0-9+/_.=:%\\"'\s-]"""
#: What ends every secret and run in a text with \x escapes, with other escapes, with none.
_ENDS_BYTES, _ENDS_TOKEN, _ENDS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f�]"), re.compile(rf"{_OTHER}\s|\s{_OTHER}"), re.compile(_OTHER)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in one layer, leftmost and non-overlapping per kind, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(x: tuple[int, int, str]) -> tuple[int, int, int]:
    return x[0], KINDS.index(x[2]), x[1]


def _codec(head: bytes) -> str:
    """What unfolds data that begins so: gzip, bzip2, zlib, or nothing."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:3] == b"BZh":
        return "bzip2"
    return "zlib" if len(head) > 2 and head[0] & 15 == 8 and (head[0] * 256 + head[1]) % 31 == 0 else ""


class _Input:
    """Blocks of bytes, of which a reader asks for more."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.data = blocks, b""

    def more(self) -> bool:
        if (block := next(self.blocks, None)) is None:
            return False
        self.data += block
        return True

    def has(self, n: int) -> bool:
        while len(self.data) < n and self.more():
            pass
        return len(self.data) >= n

    def taken(self) -> bytes:
        data, self.data = self.data, b""
        return data


def _head_size(given: _Input, kind: str) -> int:
    """Bytes of a gzip or zlib head; 0 if the data ends in it, -1 if it is none."""
    if kind == "zlib":
        return -1 if given.data[1] & 32 else 2
    if not given.has(10):
        return 0
    flags, at = given.data[3], 10
    if given.data[2] != 8 or flags & 0xE0:
        return -1
    if flags & 4:
        if not given.has(at + 2):
            return 0
        at += 2 + int.from_bytes(given.data[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            while (end := given.data.find(b"\0", at)) < 0:
                if not given.more():
                    return 0
            at = end + 1
    at += 2 * bool(flags & 2)
    return at if given.has(at) else 0


def _before_damage(inflate, data: bytes) -> bytes:
    """What data unfolds to before the place at which it is damaged."""
    out, step = [], 4096
    while step:
        probe = inflate.copy()
        try:
            got = probe.decompress(data, step)
        except zlib.error:
            step //= 2
            continue
        if not got and not probe.unconsumed_tail:
            break
        out.append(got)
        inflate, data = probe, probe.unconsumed_tail
    return b"".join(out)


def _deflated(given: _Input, kind: str, state: dict) -> Iterator[bytes]:
    """One gzip or zlib member. The checksum is tested apart, at the end, so that it takes nothing back."""
    if (size := _head_size(given, kind)) <= 0:
        state["bad"] = "broken" if size else "short"
        return
    given.data = given.data[size:]
    inflate, update = zlib.decompressobj(-zlib.MAX_WBITS), zlib.crc32 if kind == "gzip" else zlib.adler32
    check, out = update(b""), b""
    while not inflate.eof:
        if not given.data and len(out) < PIECE and not given.more():
            state["bad"] = "short"
            return
        data, before = given.taken(), inflate.copy()
        try:
            out = inflate.decompress(data, PIECE)
        except zlib.error:
            if out := _before_damage(before, data):
                yield out
            state["bad"] = "broken"
            return
        given.data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if out:
            check = update(out, check)
            yield out
    end, order = (8, "little") if kind == "gzip" else (4, "big")
    if not given.has(end):
        state["bad"] = "short"
    elif int.from_bytes(given.data[:4], order) != check:
        state["bad"] = "broken"
    given.data = given.data[end:]


def _bzipped(given: _Input, state: dict) -> Iterator[bytes]:
    """One bzip2 stream. The library keeps what it unfolds in a call that meets damage, so a call unfolds little."""
    d, held, size = bz2.BZ2Decompressor(), [], 0
    try:
        while not d.eof:
            if d.needs_input and not given.has(1):
                state["bad"] = "short"
                break
            held.append(d.decompress(given.taken() if d.needs_input else b"", BZIP_STEP))
            size += len(held[-1])
            if size >= 1 << 16:
                yield b"".join(held)
                held, size = [], 0
    except (OSError, ValueError, EOFError):
        state["bad"] = "broken"
    if size:
        yield b"".join(held)
    given.data = d.unused_data if d.eof else given.data


def _members(blocks: Iterator[bytes], state: dict) -> Iterator[bytes]:
    """What compressed data unfolds to: all members one after another, then the bytes after the last as they are.

    state["bad"] tells whether the data ended early or was broken; what came before that is given (of a broken bzip2
    block, all but its last BZIP_STEP bytes at most). state["rest"] is how many bytes were at hand after the last member.
    """
    state["bad"], state["rest"], members, given = "", 0, 0, _Input(blocks)
    while True:
        while given.has(1) and members and not given.data[0]:  # padding between members
            given.data = given.data.lstrip(b"\0")
        if not given.has(1):
            return
        given.has(4)
        if not (kind := _codec(given.data)):
            state["rest"] = len(given.data)
            yield b"\n" + given.taken()
            yield from given.blocks
            return
        members += 1
        yield from _bzipped(given, state) if kind == "bzip2" else _deflated(given, kind, state)
        if state["bad"]:
            return


def _cut(text: str, at: int) -> int:
    """Where text may be cut, from at on, so that no secret and no encoded run is cut, wrapped ones neither; else 0."""
    i = text.rfind("\n", at, len(text) - 64)
    while i >= 0:
        if not _RUN_AFTER.match(text, i + 1) and not _RUN_BEFORE.search(text[max(i - 256, 0) : i].rstrip(" \t\r\\")):
            return i + 1
        i = text.rfind("\n", at, i)
    ends = _ENDS_BYTES if "\\x" in text else _ENDS_TOKEN if "%" in text or "\\" in text else _ENDS
    m = ends.search(text, max(at, len(text) // 2))
    return m.end() if m else 0


def _pieces(blocks: Iterator[bytes]) -> Iterator[str]:
    """Bytes as text in pieces; bytes outside UTF-8 give U+FFFD."""
    decoder, text, at = codecs.getincrementaldecoder("utf-8")("replace"), "", 0
    for block in blocks:
        text += decoder.decode(block)
        if len(text) < PIECE:
            continue
        if cut := _cut(text, at):
            yield text[:cut]
            text, at = text[cut:], 0
        else:
            at = max(len(text) - 64, 0)
    if text := text + decoder.decode(b"", True):
        yield text


def _blocks(data: bytes) -> Iterator[bytes]:
    return (data[i : i + (1 << 16)] for i in range(0, len(data), 1 << 16))


def _texts(data: bytes) -> Iterator[tuple[str, bool, bool]]:
    """(piece of text, whether it begins a layer, whether it is sure to be one) of data, unfolded as often as it is compressed.

    Data that only looks compressed, or is broken, is also read as it is. Data that was seen on the way ends the
    unfolding, by a digest of the whole. A layer of up to SPOOL bytes, or twice the data, is held; a larger one is
    unfolded again when it is read, each such layer over the one before.
    """
    source, least = lambda: _blocks(data), max(SPOOL, 2 * len(data))
    seen, states, larger = {hashlib.blake2b(data).digest()}, [], []

    def pieces(blocks: Iterator[bytes], sure: Callable[[], bool]) -> Iterator[tuple[str, bool, bool]]:
        for i, text in enumerate(_pieces(blocks)):
            yield text, not i, sure() or not _UNCLEAN.search(text)

    while True:
        head = _Input(source())
        head.has(4)
        if not _codec(head.data):
            break
        state, held, size, digest = {}, [], 0, hashlib.blake2b()
        for out in _members(source(), state):
            digest.update(out)
            size += len(out)
            if size <= least:
                held.append(out)
            else:
                held.clear()
        states.append(state)
        if size <= least:
            if state["bad"]:
                yield from pieces(source(), lambda: False)
            source = lambda new=b"".join(held): _blocks(new)
        else:
            larger.append((source, state))
            source = lambda below=source, state=state: _members(below(), state)
        if digest.digest() in seen:
            break
        seen.add(digest.digest())
    yield from pieces(source(), lambda: bool(states) and not any(x["bad"] for x in states))
    for below, state in larger:
        if state["bad"]:
            yield from pieces(below(), lambda: False)


class _Layer(NamedTuple):
    """A layer's text and where each character comes from in the document: arrays, one place for all, or None for the document."""

    text: str
    starts: np.ndarray | int | None = None
    ends: np.ndarray | int | None = None
    begins: bool = True  # not a later piece of a layer
    sure: bool = True  # text or unfolded data; other bytes are a layer only if something is found in them

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return (self.starts, self.ends) if isinstance(self.starts, int) else (int(self.starts[a]), int(self.ends[b - 1]))


def _key(start: int, end: int, data: bytes) -> tuple[int, int, bytes]:
    return start, end, hashlib.blake2b(data, digest_size=16).digest()


def _percent(text: str) -> Iterator[tuple[str, int, int]]:
    """(character, start, end) of every URL escape; a byte outside UTF-8 gives U+FFFD.

    A byte that is escaped ten times or more is read in one round, so that deep nesting takes linear time.
    """
    for m in _PERCENT.finditer(text):
        at = m.start()
        if m[1]:
            c = int(m[0][-2:], 16)
            yield chr(c) if c < 128 else "�", at, m.end()
            continue
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            bad = "\udc80" <= c <= "\udcff"
            to = at + 3 * (1 if bad else len(c.encode()))
            yield "�" if bad else c, at, to
            at = to


def _unicode(text: str) -> Iterator[tuple[str, int, int]]:
    """(character, start, end) of every Unicode escape; doubled backslashes are those of an escaped escape."""
    for m in _UNICODE.finditer(text):
        s = m[0].replace("\\", "")
        c = int(s[1:5], 16) if len(s) < 10 else 0x10000 + ((int(s[1:5], 16) & 0x3FF) << 10) + (int(s[6:], 16) & 0x3FF)
        yield "�" if 0xD800 <= c < 0xE000 else chr(c), m.start(), m.end()


def _splices(layer: _Layer) -> Iterator[_Layer]:
    """The layer with its URL escapes decoded, and with its Unicode escapes decoded, each in its surrounding text."""
    text = layer.text
    for mark, decoded in (("%", _percent), ("\\", _unicode)):
        if mark not in text:
            continue
        out, sizes, froms, tos, plain, last = [], [], [], [], [], 0
        for c, a, b in decoded(text):
            if last < a:
                out.append(text[last:a])
                sizes.append(a - last), froms.append(last), tos.append(a), plain.append(True)
            out.append(c)
            sizes.append(1), froms.append(a), tos.append(b), plain.append(False)
            last = b
        if not out:
            continue
        if last < len(text):
            out.append(text[last:])
            sizes.append(len(text) - last), froms.append(last), tos.append(len(text)), plain.append(True)
        starts, ends = layer.starts, layer.ends
        if not isinstance(starts, int):
            n = np.array(sizes)
            own = np.repeat(plain, n)
            at = np.repeat(froms, n) + np.where(own, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), 0)
            to = np.where(own, at + 1, np.repeat(tos, n))
            starts, ends = (at, to) if starts is None else (starts[at], ends[to - 1])
        yield _Layer("".join(out), starts, ends)


def _line_before(text: str, at: int, any_run: re.Pattern) -> tuple[int, int] | None:
    """The run, shorter than a run of its own, that ends the line before the one that a run begins."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] in "\r\n":
        at -= 2 if text[at - 2 : at] == "\r\n" else 1
    elif text[max(at - 2, 0) : at] == "\\n":
        at -= 4 if text[max(at - 4, 0) : at] == "\\r\\n" else 2
    else:
        return None
    while at and text[at - 1] in " \t\\":
        at -= 1
    start = at
    while start and any_run.match(text[start - 1]):
        start -= 1
    return (start, at) if start < at else None


def _encoded(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of every base64 and hex run.

    Runs that only line breaks separate are also read joined: all of them, and each block of lines of one length with
    the line after it (the last of a wrapped body is shorter) and the line before it (the first may follow a name).
    """
    for is_hex, (run, any_run, more) in enumerate(_RUNS):
        done = 0
        for m in run.finditer(text):
            if m.start() < done:
                continue
            lines = [m.span()]
            while not text.startswith("=", lines[-1][1]) and (x := more.match(text, lines[-1][1])):
                lines.append(x.span(1))
            done = lines[-1][1]
            if (x := _line_before(text, m.start(), any_run)) is not None:
                lines.insert(0, x)
            sizes = [b - a for a, b in lines]
            last = len(lines)
            picks = [(i, i + 1) for i in range(last) if sizes[i] >= (24 if is_hex else 16)]
            if last > 1:
                picks += [(0, last), (1, last)]
                edges = [0, *(i for i in range(1, last) if sizes[i] != sizes[i - 1]), last]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    picks += [(i, j), (i, min(j + 1, last)), (max(i - 1, 0), j), (max(i - 1, 0), min(j + 1, last))]
            for i, j in dict.fromkeys(picks):
                body = "".join(text[a:b] for a, b in lines[i:j])
                start, end = lines[i][0], lines[j - 1][1]
                if is_hex:
                    if len(body) >= 24:
                        yield start, end, bytes.fromhex(body[: len(body) // 2 * 2])
                elif len(body) >= 16 and not (body.isalpha() and (body.islower() or body.istitle())):  # a long word: no keyword, key id or number has such base64
                    body = body[: len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")
                    yield start, _PAD.match(text, end).end(), base64.b64decode(body + "=" * (-len(body) % 4))


def _compressed(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of compressed data whose bytes are written as URL or hexadecimal escapes, in part or all."""
    for mark, region, escape in _BYTES:
        if mark not in text:
            continue
        for m in region.finditer(text):
            if mark not in m[0]:
                continue
            source = m[0].encode("utf-8", "surrogatepass")
            data = escape.sub(lambda x: bytes.fromhex(x[1].decode()) if x[1] else bytes([_SIMPLE_ESCAPES[x[2][0]]]), source)
            done, at = 0, None
            for x in _MAGIC.finditer(data):
                i = x.start()
                if i < done or not _codec(data[i : i + 4]):
                    continue
                state, size = {}, 0
                for out in _members(iter([data[i:]]), state):
                    if state["rest"]:
                        break
                    size += len(out)
                if not size or (state["bad"] == "broken" and not x[1] and size < LEAST):
                    continue  # two bytes that only look like the head of zlib data
                end = len(data) - state["rest"]
                done = 0 if state["bad"] else end
                if at is None:
                    kept = np.ones(len(source) + 1, bool)
                    for y in escape.finditer(source):
                        kept[y.start() + 1 : y.end()] = False
                    chars = np.cumsum((np.frombuffer(source + b" ", np.uint8) & 0xC0) != 0x80) - 1
                    at = m.start() + chars[np.flatnonzero(kept)]
                yield int(at[i]), int(at[end]), data[i:end]


def _opened(layer: _Layer, seen: set) -> Iterator[_Layer]:
    """The layers under the encoded runs of one layer."""
    for a, b, data in chain(_encoded(layer.text), _compressed(layer.text)):
        start, end = layer.place(a, b)
        if (key := _key(start, end, data)) in seen:
            continue
        seen.add(key)
        for text, begins, sure in _texts(data):
            yield _Layer(text, start, end, begins, sure)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """Base spans, all spans and the number of decoded layers.

    Every decoded layer is opened in turn, so nesting of any depth and order is unwrapped; a layer whose text was
    seen at the same place before is not opened again, so cycles end. URL and Unicode escapes are decoded in the
    text around them. A secret in a layer has the span of the original characters that it comes from: exact under
    URL and Unicode escapes, the whole encoded run under base64, hex and compression. Compressed data is unfolded to
    its end, whatever its size, and scanned piece by piece.
    """
    base = base_spans(text)
    spans, seen, layers = set(base), set(), 0
    work: list[_Layer | Iterator[_Layer]] = [_Layer(text)]
    while work:
        layer = work[-1]
        if not isinstance(layer, _Layer):
            if (layer := next(layer, None)) is None:
                work.pop()
                continue
        else:
            work.pop()
        if (key := (*layer.place(0, len(layer.text)), "text", _key(0, 0, layer.text.encode("utf-8", "surrogatepass")))) in seen:
            continue
        seen.add(key)
        if layer.starts is not None:
            found = {(*layer.place(a, b), k) for a, b, k in base_spans(layer.text)}
            layers += layer.begins and (layer.sure or bool(found))
            spans |= found
        work.extend(_splices(layer))
        work.append(_opened(layer, seen))
    return base, sorted(spans, key=_order), layers


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, base_spans and spans (kind:start:end, comma-joined), counts by kind, layers.

    A null text counts as empty: no spans. Texts of any length are read whole; repeated rows give repeated
    results; other columns of df are ignored. Offsets are code points, ends exclusive. No shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans, layers = scan(text or "")
                counts = [sum(x[2] == k for x in base) for k in KINDS]
                out.append((*counts, *(",".join(f"{k}:{a}:{b}" for a, b, k in x) for x in (base, spans)), layers))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long").withColumnRenamed("id", id_col)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers")
