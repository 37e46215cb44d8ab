"""Words with their boxes from the text layer of PDF files, for the tables of sources/words.py.

Objects are found by scanning the file, so a damaged cross-reference table does no harm. Text is placed by the matrices of its page's
operators; its characters come from a font's map to Unicode, or from its encoding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import words
from quernstone.sources.files import UnsupportedInput, _files

# Glyph names that are no single letters, escapes in strings, and widths of a common sans serif in thousandths.
GLYPHS = {
    "space": " ", "period": ".", "comma": ",", "hyphen": "-", "minus": "-", "slash": "/", "at": "@", "underscore": "_", "colon": ":", "semicolon": ";", "plus": "+", "parenleft": "(", "parenright": ")", "ampersand": "&", "numbersign": "#",
    "quotesingle": "'", "quoteright": "’", "endash": "–", "emdash": "—", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
NARROW, WIDE, THIN, BROAD, USUAL = "iljtfI.,:;'|!/ ()[]-", "mwMW@%", 278, 860, 556
#: A gap of more than this share of the type size parts words; a line of words this share lower is another.
WORD_GAP, LINE_SHIFT = 0.22, 0.4

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s<>\[\]{}()/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|<[0-9A-Fa-f\s]*>|\(|[^\s<>\[\]{}()/%]+")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])")


class Name(str):
    pass


class Ref(int):
    pass


class Word(bytes):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string after an opening bracket, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            nxt = data[at + 1 : at + 2]
            octal = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
                continue
            out += b"" if nxt in b"\r\n" else ESCAPES.get(nxt, nxt)
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[Any, int]]:
    """Objects and keywords one after the other, and where each ends; brackets are closed at the end at the latest."""
    stack: list[tuple[bytes, list]] = []
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token[:1] == b"%":
            continue
        if token in (b"<<", b"["):
            stack.append((token, []))
            continue
        if token in (b">>", b"]"):
            if not stack:
                continue
            kind, held = stack.pop()
            value: Any = held if kind == b"[" else {str(k): v for k, v in zip(held[::2], held[1::2])}
        elif token == b"(":
            value, at = _string(data, at)
        elif token[:1] == b"<":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:]).decode("latin-1"))
        elif token[:1] in b"+-.0123456789":
            ref = _REF.match(data, at) if token.isdigit() else None
            value, at = (Ref(token), ref.end()) if ref else (float(token) if b"." in token else int(token), at)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(token, Word(token))
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, at


class Document:
    """Objects by number; of one that stands twice the later counts."""

    def __init__(self, content: bytes) -> None:
        if not content.lstrip()[:4] == b"%PDF":
            raise UnsupportedInput("the file is no PDF")
        self.objects: dict[int, Any] = {}
        at = 0
        while m := _OBJECT.search(content, at):
            value, at = next(values(content, m.end()), (None, m.end()))
            stream = re.compile(rb"\s*stream\r?\n").match(content, at) if isinstance(value, dict) else None
            if stream:
                size, start = value.get("Length"), stream.end()
                whole = type(size) is int and re.match(rb"\s*endstream", content[start + size : start + size + 20])
                end = start + size if whole else content.find(b"endstream", start)
                if end < 0:
                    raise UnsupportedInput(f"the file breaks off within object {int(m[1])}")
                value, at = (value, content[start:end]), end
            self.objects[int(m[1])] = value
        if re.search(rb"/Encrypt\s", content):
            raise UnsupportedInput("the file is encrypted")
        for value in list(self.objects.values()):
            if isinstance(value, tuple) and value[0].get("Type") == "ObjStm":
                self._unpack(*value)

    def _unpack(self, about: dict, raw: bytes) -> None:
        data, first = self.decoded(about, raw), self.get(about.get("First"))
        head = [v for v, _ in values(data[:first])]
        for number, offset in zip(head[::2], head[1::2]):
            self.objects.setdefault(number, next(values(data, first + offset), (None, 0))[0])

    def get(self, value: Any) -> Any:
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def about(self, value: Any) -> dict:
        value = self.get(value)
        return value if isinstance(value, dict) else value[0] if isinstance(value, tuple) else {}

    def decoded(self, about: dict, raw: bytes) -> bytes:
        filters = self.get(about.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name in ("FlateDecode", "Fl"):
                try:
                    raw = zlib.decompressobj().decompress(raw)
                except zlib.error as e:
                    raise UnsupportedInput(f"a stream cannot be unpacked: {e}") from e
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw.partition(b">")[0])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise UnsupportedInput(f"streams packed by {name} are not read here")
        return raw

    def stream(self, value: Any) -> bytes:
        value = self.get(value)
        if isinstance(value, list):
            return b"\n".join(map(self.stream, value))
        return self.decoded(*value) if isinstance(value, tuple) else b""

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref: Any, held: dict) -> None:
            if id(node := self.about(ref)) in seen:
                return
            seen.add(id(node))
            held = held | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, held)
            elif node.get("Type") == "Page":
                out.append(held | node)

        for value in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                walk(value.get("Pages"), {})
        return out


class Font:
    def __init__(self, doc: Document, about: dict) -> None:
        below = doc.about((doc.get(about.get("DescendantFonts")) or [None])[0])
        self.wide, self.text, self.width = about.get("Subtype") == "Type0", {}, {}
        self.missing = doc.get(below.get("DW", 1000)) if self.wide else None
        if "ToUnicode" in about:
            self._map(doc.stream(about["ToUnicode"]))
        encoding = doc.get(about.get("Encoding"))
        named = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if named == "MacRomanEncoding" else "cp1252"
        code = 0
        for x in doc.get(encoding.get("Differences")) or [] if isinstance(encoding, dict) else []:
            if isinstance(x, int) and not isinstance(x, Ref):
                code = x
            else:
                shown = GLYPHS.get(x, x if len(x) == 1 else chr(int(x[3:7], 16)) if re.match("uni[0-9A-F]{4}", x) else None)
                if shown:
                    self.text.setdefault(code, shown)
                code += 1
        first = doc.get(about.get("FirstChar")) or 0
        self.width = {first + i: doc.get(w) for i, w in enumerate(doc.get(about.get("Widths")) or [])}
        listed, i = doc.get(below.get("W")) or [], 0
        while i + 1 < len(listed):
            if isinstance(own := doc.get(listed[i + 1]), list):
                self.width |= {listed[i] + k: w for k, w in enumerate(own)}
                i += 2
            else:
                self.width |= dict.fromkeys(range(listed[i], listed[i + 1] + 1), listed[i + 2])
                i += 3

    def _map(self, cmap: bytes) -> None:
        read = lambda b: b.decode("utf-16-be", "replace")
        for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", cmap, re.S):
            found = [v for v, _ in values(body)]
            for at in range(0, len(found) - (1 if kind == b"char" else 2), 2 if kind == b"char" else 3):
                low, to = int.from_bytes(found[at]), found[at + (1 if kind == b"char" else 2)]
                if kind == b"char":
                    self.text[low] = read(to)
                    continue
                for k in range(int.from_bytes(found[at + 1]) - low + 1):
                    self.text[low + k] = read(to[k]) if isinstance(to, list) else read(to[:-2] + (int.from_bytes(to[-2:]) + k).to_bytes(2))

    def glyphs(self, raw: bytes) -> Iterator[tuple[int, str, float]]:
        """Code, text and width in ems of each character."""
        for code in (int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw), 2)) if self.wide else raw:
            text = self.text.get(code) or ("" if self.wide else bytes([code]).decode(self.codec, "replace"))
            width = self.width.get(code, self.missing)
            yield code, text, (width if width is not None else THIN if text in NARROW else BROAD if text in WIDE else USUAL) / 1000


Matrix = tuple[float, float, float, float, float, float]


def _times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _glyphs(doc: Document, content: bytes, resources: dict, ctm: Matrix, depth: int = 0) -> Iterator[tuple[str, float, float, float, float]]:
    """(text, x from, x to, y of the base line, size) of each character that a page's operators show, in their order."""
    unit: Matrix = (1, 0, 0, 1, 0, 0)
    fonts: dict[str, Font] = {}
    saved: list = []
    font, size, char, space, scale, leading, rise = None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0
    text = line = unit
    args: list = []

    def shown(raw: bytes) -> Iterator[tuple[str, float, float, float, float]]:
        nonlocal text
        for code, glyph, width in font.glyphs(raw) if font else ():
            step = (width * size + char + (space if code == 32 and not font.wide else 0)) * scale
            place, after = _times((1, 0, 0, 1, 0, rise), _times(text, ctm)), _times((1, 0, 0, 1, width * size * scale, rise), _times(text, ctm))
            yield glyph, place[4], after[4], place[5], size * (place[2] ** 2 + place[3] ** 2) ** 0.5
            text = _times((1, 0, 0, 1, step, 0), text)

    for value, _ in values(content):
        if not isinstance(value, Word):
            args.append(value)
            continue
        op = value.decode("latin-1")
        try:
            if op == "q":
                saved.append((ctm, font, size, char, space, scale, leading, rise))
            elif op == "Q" and saved:
                ctm, font, size, char, space, scale, leading, rise = saved.pop()
            elif op == "cm":
                ctm = _times(tuple(args[-6:]), ctm)
            elif op == "BT":
                text = line = unit
            elif op == "Tf":
                if args[-2] not in fonts:
                    fonts[args[-2]] = Font(doc, doc.about(doc.about(resources.get("Font")).get(args[-2])))
                font, size = fonts[args[-2]], args[-1]
            elif op in ("Td", "TD"):
                leading = -args[-1] if op == "TD" else leading
                text = line = _times((1, 0, 0, 1, args[-2], args[-1]), line)
            elif op == "Tm":
                text = line = tuple(args[-6:])
            elif op in ("Tc", "Tw", "Tz", "TL", "Ts"):
                char, space, scale, leading, rise = (args[-1] if op == o else v for o, v in zip(("Tc", "Tw", "Tz", "TL", "Ts"), (char, space, scale * 100, leading, rise)))
                scale /= 100
            elif op in ("T*", "'", '"'):
                if op == '"':
                    space, char = args[-3], args[-2]
                text = line = _times((1, 0, 0, 1, 0, -leading), line)
                if op != "T*":
                    yield from shown(args[-1])
            elif op == "Tj":
                yield from shown(args[-1])
            elif op == "TJ":
                for x in args[-1]:
                    if isinstance(x, bytes):
                        yield from shown(x)
                    else:
                        text = _times((1, 0, 0, 1, -x / 1000 * size * scale, 0), text)
            elif op == "Do" and depth < 8:
                form = doc.get(doc.about(resources.get("XObject")).get(args[-1]))
                if isinstance(form, tuple) and form[0].get("Subtype") == "Form":
                    yield from _glyphs(doc, doc.decoded(*form), doc.about(form[0].get("Resources")) or resources, _times(tuple(doc.get(form[0].get("Matrix")) or unit), ctm), depth + 1)
        except (IndexError, TypeError, ValueError):  # an operator without its operands shows nothing
            pass
        args = []


def page_words(content: bytes) -> list[list[tuple[str, float, float, float, float]]]:
    """For each page its words: text, x0, y0, x1, y1, y counted from the top."""
    doc, out = Document(content), []
    pages = doc.pages()
    if not pages:
        raise UnsupportedInput("the file has no pages")
    for page in pages:
        box = [float(doc.get(x)) for x in doc.get(page.get("MediaBox")) or (0, 0, 612, 792)]
        found: list[list] = []
        open_word = False
        for text, x0, x1, y, size in _glyphs(doc, doc.stream(page.get("Contents")), doc.about(page.get("Resources")), (1, 0, 0, 1, -box[0], -box[1])):
            if not text.strip():
                open_word = False
                continue
            last = found[-1] if found else None
            if open_word and last and abs(y - last[3]) <= LINE_SHIFT * size and -size < x0 - last[2] <= WORD_GAP * size:
                last[0], last[2] = last[0] + text, max(last[2], x1)
            else:
                found.append([text, x0, x1, y, size])
            open_word = True
        high = box[3] - box[1]
        out.append([(t, x0, high - y - 0.8 * s, x1, high - y + 0.2 * s) for t, x0, x1, y, s in found])
    return out


def read_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, page (from 1), chars, words and note of the pages of PDF files; a file that can't be read is one row that says why, without a page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                try:
                    pages = page_words(bytes(r.content))
                except UnsupportedInput as e:
                    out.append((r.name, None, 0, [], str(e)))
                    continue
                out += [(r.name, n, sum(len(w[0]) for w in own), [(*w, 1.0) for w in own], "") for n, own in enumerate(pages, 1)]
            yield pd.DataFrame(out, columns=["file", "page", "chars", "words", "note"]).astype({"page": "Int32"})

    return _files(spark, paths).where(F.substring("content", 1, 4) == F.lit(b"%PDF")).mapInPandas(run, f"file string, page int, chars int, words array<{words.WORD}>, note string")


def read_documents(spark: SparkSession, paths: list[str], recorded: DataFrame | None = None) -> DataFrame:
    """Records, with confidence, of the tables in PDF files: pages with text as they are, others from recorded words (words.read_recorded) of the same file and page, if there are."""
    pages = read_pages(spark, paths)
    native = pages.where(F.col("chars") >= words.NATIVE_CHARS).select("file", "page", F.inline("words"))
    if recorded is not None:
        scans = words.needs_ocr(pages.where("page is not null")).select("file", "page")
        native = native.unionByName(recorded.join(scans, ["file", "page"], "left_semi").select(native.columns))
    return words.as_records(words.table_rows(words.grid(words.cells(words.lines(native)))))
