"""Text and tables of a PDF's pages from its bytes: objects, streams, and where text is shown.

A small reader of the public format (ISO 32000-1) for documents made of text. It finds objects where
they stand, so a damaged cross-reference table does no harm. Pictures are not read, and
encrypted files and filters other than Flate are problems that it names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

# Fixed values of the format.
SPACE, BREAKS = b"\0\t\n\f\r ", b"()<>[]{}/%"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
LETTER_BOX = [0, 0, 612, 792]

#: In sizes of the type: how far apart two texts of a line are for a blank, for a new cell, and two lines.
BLANK, CELL, LINE = 0.15, 1.0, 0.5
#: Width of a character without one, in thousandths of the size; deepest nesting and largest stream that is read.
WIDTH, DEEPEST, LARGEST = 500, 60, 64 << 20


class PdfError(ValueError):
    """What is wrong with a file."""


class Name(str):
    pass


class Word(str):
    """An operator."""


@dataclass
class Ref:
    number: int


@dataclass
class Stream:
    about: dict
    raw: bytes

    def data(self) -> bytes:
        filters = self.about.get("Filter", [])
        for kind in filters if isinstance(filters, list) else [filters]:
            if kind not in ("FlateDecode", "Fl"):
                raise PdfError(f"no reader for {kind}")
        if not filters:
            return self.raw
        tool = zlib.decompressobj()
        try:
            return tool.decompress(self.raw, LARGEST)
        except zlib.error as e:
            raise PdfError(f"stream can't be decoded: {e}") from e


class Reader:
    """Values and operators, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c == 0x25:  # a comment
                ends = re.compile(rb"[\r\n]").search(self.data, self.at)
                self.at = ends.end() if ends else len(self.data)
            elif c in SPACE:
                self.at += 1
            else:
                return

    def value(self, depth: int = 0):
        """The next value, or None at the end; a ``Word`` is an operator or a closing bracket."""
        if depth > DEEPEST:
            raise PdfError("nested too deep")
        self._skip()
        head = self.data[self.at : self.at + 2]
        if not head:
            return None
        if head == b"<<":
            self.at += 2
            items = self._until(">>", depth)
            return dict(zip(map(str, items[::2]), items[1::2], strict=False))
        if head[:1] == b"[":
            self.at += 1
            return self._until("]", depth)
        if head[:1] == b"(":
            return self._literal()
        if head[:1] == b"<":
            end = self.data.find(b">", self.at)
            if end < 0:
                raise PdfError("a string has no end")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if head in (b">>",) or head[:1] in (b"]", b"}", b"{", b")", b">"):
            self.at += 2 if head == b">>" else 1
            return Word(">>" if head == b">>" else head[:1].decode())
        found = re.compile(rb"/?[^\0\t\n\f\r ()<>\[\]{}/%]*").match(self.data, self.at)
        text, self.at = found[0], max(found.end(), self.at + 1)
        if text[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), text[1:]).decode("latin-1"))
        if re.fullmatch(rb"[+-]?\d+", text):
            ref = re.compile(rb"\s+\d+\s+R(?![A-Za-z])").match(self.data, self.at)
            if ref and text.isdigit():
                self.at = ref.end()
                return Ref(int(text))
            return int(text)
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", text):
            return float(text)
        return {b"true": True, b"false": False}.get(text, Word(text.decode("latin-1")))

    def _until(self, end: str, depth: int) -> list:
        out = []
        while (v := self.value(depth + 1)) is not None:
            if isinstance(v, Word) and v == end:
                return out
            out.append(None if isinstance(v, Word) and v == "null" else v)
        raise PdfError("a bracket has no end")

    def _literal(self) -> bytes:
        out, depth, self.at = bytearray(), 1, self.at + 1
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}|\r\n?|[\s\S]").match(self.data, self.at)
                if not octal:
                    break
                self.at = octal.end()
                code = octal[0]
                out += bytes([int(code, 8) & 255]) if code.isdigit() and code not in (b"8", b"9") else b"" if code[:1] in (b"\r", b"\n") else ESCAPES.get(code, code)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                return bytes(out)
            out += c
        raise PdfError("a string has no end")


def objects(data: bytes) -> dict[int, object]:
    """Every object by number; of several the last in the file counts. Objects within streams are unpacked."""
    if b"%PDF-" not in data[:1024]:
        raise PdfError("no PDF")
    out: dict[int, object] = {}
    begins, at = re.compile(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b"), 0
    while found := begins.search(data, at):
        reader = Reader(data, found.end())
        value = reader.value()
        at = max(reader.at, found.end())
        follows = re.compile(rb"\s*stream\r?\n").match(data, at)
        if isinstance(value, dict) and follows:
            size = value.get("Length")
            end = follows.end() + size if isinstance(size, int) else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                end = data.find(b"endstream", follows.end())
            if end < 0:
                raise PdfError("a stream has no end")
            value, at = Stream(value, data[follows.end() : end]), end
        out[int(found[1])] = value
    for packed in [s for s in out.values() if isinstance(s, Stream) and s.about.get("Type") == "ObjStm"]:
        raw, first = packed.data(), packed.about.get("First", 0)
        head = Reader(raw[:first])
        numbers = [head.value() for _ in range(2 * packed.about.get("N", 0))]
        for number, place in zip(numbers[::2], numbers[1::2], strict=True):
            out.setdefault(number, Reader(raw, first + place).value())
    if b"/Encrypt" in data and re.search(rb"/Encrypt\s+(\d|<<)", data):
        raise PdfError("encrypted")
    return out


@dataclass
class Font:
    codes: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    bytes_: int = 1

    def read(self, raw: bytes) -> tuple[str, float]:
        """(text, width in sizes) of a shown string."""
        if self.bytes_ == 1 and not self.codes and not self.widths:
            return raw.decode("latin-1"), len(raw) * WIDTH / 1000
        codes = [int.from_bytes(raw[i : i + self.bytes_], "big") for i in range(0, len(raw), self.bytes_)]
        return "".join(self.codes.get(c, chr(c) if self.bytes_ == 1 else "�") for c in codes), sum(self.widths.get(c, WIDTH) for c in codes) / 1000


@dataclass
class Span:
    """A text that is shown at one place."""

    x: float
    y: float
    end: float
    size: float
    text: str


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class Document:
    """The pages of a file, in order."""

    def __init__(self, data: bytes):
        self.held = objects(data)

    def get(self, value, depth: int = 0):
        while isinstance(value, Ref) and depth < DEEPEST:
            value, depth = self.held.get(value.number), depth + 1
        return value

    def pages(self) -> list[dict]:
        roots = [o for o in self.held.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        found = list(self._below(roots[-1].get("Pages"), {}, set())) if roots else []
        return found or [o for _, o in sorted(self.held.items()) if isinstance(o, dict) and o.get("Type") == "Page"]

    def _below(self, node, kept: dict, seen: set) -> Iterator[dict]:
        if isinstance(node, Ref):
            if node.number in seen:
                return
            seen.add(node.number)
        node = self.get(node)
        if isinstance(node, dict):
            own = {**kept, **{k: node[k] for k in ("MediaBox", "Resources") if k in node}}
            if isinstance(kids := self.get(node.get("Kids")), list):
                for kid in kids:
                    yield from self._below(kid, own, seen)
            else:
                yield {**own, **node}

    def font(self, about) -> Font:
        about = self.get(about)
        made = Font()
        if not isinstance(about, dict):
            return made
        made.bytes_ = 2 if about.get("Subtype") == "Type0" else 1
        first, widths = self.get(about.get("FirstChar", 0)), self.get(about.get("Widths"))
        for i, w in enumerate(widths if isinstance(widths, list) else []):
            made.widths[first + i] = float(self.get(w) or 0)
        if isinstance(cmap := self.get(about.get("ToUnicode")), Stream):
            made.codes = _code_map(cmap.data())
        return made

    def spans(self, page: dict) -> list[Span]:
        """What a page shows, in the order of its contents."""
        contents = self.get(page.get("Contents"))
        streams = [self.get(c) for c in (contents if isinstance(contents, list) else [contents])]
        data = b"\n".join(s.data() for s in streams if isinstance(s, Stream))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        return list(_shown(Reader(data), {name: self.font(f) for name, f in fonts.items()}))


def _code_map(data: bytes) -> dict[int, str]:
    out, reader, stack = {}, Reader(data), []
    text = lambda b: b.decode("utf-16-be", "replace")
    while (v := reader.value()) is not None:
        if not isinstance(v, Word):
            stack.append(v)
            continue
        if v == "endbfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(stack[::2], stack[1::2], strict=False)}
        elif v == "endbfrange":
            for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                low = int.from_bytes(a, "big")
                for k in range(min(int.from_bytes(b, "big") - low + 1, 65536)):
                    out[low + k] = text(to[k]) if isinstance(to, list) else text(to[:-2]) + chr(int.from_bytes(to[-2:], "big") + k)
        stack = []
    return out


#: The commonest words of a page, read at once: a place, and a text without brackets or escapes that is shown there.
_NUMBER = rb"([+-]?(?:\d+(?:\.\d*)?|\.\d+))[\0\t\n\f\r ]+"
PLACED = re.compile(rb"[\0\t\n\f\r ]*" + _NUMBER * 6 + rb"Tm[\0\t\n\f\r ]*\(([^()\\]*)\)[\0\t\n\f\r ]*Tj(?=[\0\t\n\f\r ()<>\[\]{}/%]|\Z)")


def _shown(reader: Reader, fonts: dict[str, Font]) -> Iterator[Span]:
    outer, saved, line, at = UNIT, [], UNIT, UNIT
    font, size, leading, stack = Font(), 1.0, 0.0, []

    def show(raw: bytes) -> Iterator[Span]:
        nonlocal at
        text, width = font.read(raw)
        place, after = _times(at, outer), _times((1, 0, 0, 1, width * size, 0), at)
        at = after
        if text.strip():
            yield Span(place[4], place[5], _times(after, outer)[4], size * (abs(place[3]) or abs(place[1]) or 1.0), text)

    while True:
        if not stack and (placed := PLACED.match(reader.data, reader.at)):
            reader.at = placed.end()
            line = at = tuple(map(float, placed.groups()[:6]))
            yield from show(placed[7])
            continue
        if (v := reader.value()) is None:
            return
        if not isinstance(v, Word):
            stack.append(v)
            continue
        numbers = [x for x in stack if isinstance(x, (int, float))]
        if v == "q":
            saved.append(outer)
        elif v == "Q" and saved:
            outer = saved.pop()
        elif v == "cm" and len(numbers) == 6:
            outer = _times(tuple(numbers), outer)
        elif v == "BT":
            line = at = UNIT
        elif v == "Tf" and len(stack) == 2 and numbers:
            font, size = fonts.get(stack[0], Font()), float(numbers[0])
        elif v == "TL" and numbers:
            leading = numbers[0]
        elif v == "Tm" and len(numbers) == 6:
            line = at = tuple(numbers)
        elif v in ("Td", "TD") and len(numbers) == 2:
            leading = -numbers[1] if v == "TD" else leading
            line = at = _times((1, 0, 0, 1, *numbers), line)
        elif v in ("T*", "'", '"'):
            line = at = _times((1, 0, 0, 1, 0, -leading), line)
        if v in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            yield from show(stack[-1])
        elif v == "TJ" and stack and isinstance(stack[-1], list):
            for part in stack[-1]:
                if isinstance(part, bytes):
                    yield from show(part)
                elif isinstance(part, (int, float)):
                    at = _times((1, 0, 0, 1, -part / 1000 * size, 0), at)
        elif v == "BI":  # a picture among the operators
            ends = re.compile(rb"\sEI\s").search(reader.data, reader.at)
            reader.at = ends.end() if ends else len(reader.data)
        stack = []


def lines_of(spans: list[Span]) -> list[list[tuple[float, float, str]]]:
    """Lines from top to bottom, each as cells (x, end, text) from left to right."""
    lines: list[list[Span]] = []
    for s in sorted(spans, key=lambda s: (-s.y, s.x)):
        if lines and abs(lines[-1][0].y - s.y) <= LINE * s.size:
            lines[-1].append(s)
        else:
            lines.append([s])
    out = []
    for line in lines:
        cells: list[tuple[float, float, str]] = []
        for s in sorted(line, key=lambda s: s.x):
            gap = (s.x - cells[-1][1]) / s.size if cells else CELL
            if gap >= CELL:
                cells.append((s.x, s.end, s.text))
            else:
                x, _, text = cells[-1]
                cells[-1] = (x, s.end, text + (" " if gap > BLANK and not text.endswith(" ") else "") + s.text)
        out.append([(x, end, t.strip()) for x, end, t in cells])
    return out


def tables_of(lines: list[list[tuple[float, float, str]]]) -> list[list[list[str]]]:
    """Runs of two lines or more with several cells as tables; cells that overlap across lines are one column."""
    out, run = [], []
    for line in [*lines, []]:
        if len(line) > 1:
            run.append(line)
            continue
        if len(run) > 1:
            out.append(_columns(run))
        run = []
    return out


def _columns(lines: list[list[tuple[float, float, str]]]) -> list[list[str]]:
    spans: list[list[float]] = []
    for x, end, _ in sorted(c for line in lines for c in line):
        if spans and x < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([x, end])
    rows, starts = [], [s[0] for s in spans]
    for line in lines:
        row = [""] * len(spans)
        for x, _, text in line:
            k = bisect_right(starts, x) - 1
            row[k] = f"{row[k]} {text}".strip()
        rows.append(row)
    return rows


def pages_of(content: bytes) -> Iterator[tuple[int, float, float, str, list[list[list[str]]]]]:
    """(number, width, height, text, tables) of each page. PdfError says what is wrong with the file."""
    document = Document(content)
    for number, page in enumerate(document.pages(), 1):
        box = [float(document.get(x) or 0) for x in (document.get(page.get("MediaBox")) or LETTER_BOX)]
        lines = lines_of(document.spans(page))
        yield number, box[2] - box[0], box[3] - box[1], "\n".join("  ".join(t for _, _, t in line) for line in lines), tables_of(lines)
