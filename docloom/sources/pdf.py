"""PDF files: a pure-Python object reader, a Spark data source over it, and a writer for page plans.

``spark.read.format("pdfwords").option("table", ...).load(path)`` with table ``words``, ``pages``,
``rules`` or ``metadata``; one input partition per file, so files are read in parallel and a lost
executor repeats only its files. A file that cannot be read gives one row with ``error`` instead of
failing the job. Encrypted files are such an error. Filters other than Flate are left undecoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE, _DELIMITERS = b" \t\r\n\x0c\x00", b"()<>[]{}/%"


class Name(str):
    """A PDF name."""


class Op(str):
    """An operator of a content stream."""


@dataclass(frozen=True)
class Ref:
    """A reference to an object."""

    number: int


@dataclass
class Stream:
    """A dictionary with data."""

    info: dict
    raw: bytes

    def data(self) -> bytes:
        """The data, decoded where the filter is Flate."""
        names = self.info.get("Filter", [])
        out = self.raw
        for name in names if isinstance(names, list) else [names]:
            if name != "FlateDecode":
                raise ValueError(f"filter {name} isn't supported")
            out = zlib.decompressobj().decompress(out)
        parms = self.info.get("DecodeParms")
        if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
            out = _unpredicted(out, parms.get("Columns", 1))
        return out


def _unpredicted(data: bytes, columns: int) -> bytes:
    """PNG row predictors undone (none, sub and up, which cross-reference streams use)."""
    out, above = bytearray(), bytes(columns)
    for k in range(0, len(data), columns + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + columns])
        for i in range(len(row)):
            row[i] = (row[i] + (above[i] if kind == 2 else row[i - 1] if kind == 1 and i else 0)) & 255
        out += row
        above = bytes(row)
    return bytes(out)


class Reader:
    """Reads objects one after another from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 37:
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def object(self) -> Any:
        """The next object or operator; None at the end."""
        self.skip()
        d = self.data
        if self.at >= len(d):
            return None
        c = d[self.at : self.at + 1]
        if c == b"/":
            return self._name()
        if c == b"(":
            return self._string()
        if d.startswith(b"<<", self.at):
            return self._dict()
        if c == b"<":
            end = d.index(b">", self.at)
            digits = re.sub(rb"\s", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(d) or d[self.at] == 93:
                    self.at += 1
                    return out
                out.append(self.object())
        if c in b"])}>{":
            self.at += 1
            return Op(c.decode())
        end = self.at
        while end < len(d) and d[end] not in _SPACE and d[end] not in _DELIMITERS:
            end += 1
        word = d[self.at : end]
        self.at = max(end, self.at + 1)
        if re.fullmatch(rb"[+-]?\d+", word):
            m = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z])").match(d, self.at)
            if m and word.isdigit():
                self.at = m.end()
                return Ref(int(word))
            return int(word)
        if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Op(word.decode("latin-1")))

    def _name(self) -> Name:
        m = re.compile(rb"/([^\x00-\x20()<>\[\]{}/%]*)").match(self.data, self.at)
        self.at = m.end()
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), m[1]).decode("latin-1"))

    def _dict(self) -> dict:
        self.at += 2
        out = {}
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            key = self.object()
            out[key] = self.object()

    def _string(self) -> bytes:
        d, out, depth, i = self.data, bytearray(), 1, self.at + 1
        plain = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
        while i < len(d):
            c = d[i]
            if c == 92 and i + 1 < len(d):
                n = d[i + 1]
                if 48 <= n <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(d, i + 1)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if n not in b"\r\n":
                    out.append(plain.get(n, n))
                i += 2
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
            i += 1
        self.at = i + 1
        return bytes(out)


@dataclass
class Pdf:
    """The objects of a file and its trailer."""

    objects: dict[int, Any]
    trailer: dict
    numbers: list[int] = field(default_factory=list)

    def get(self, v: Any) -> Any:
        """A value with its reference followed."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(v.number)
        return None

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit; ``numbers`` has their object numbers."""
        out, seen = [], set()
        self.numbers = []

        def walk(node: Any, given: dict) -> None:
            if isinstance(node, Ref):
                if node.number in seen:
                    return
                seen.add(node.number)
            d = self.get(node)
            if not isinstance(d, dict):
                return
            own = given | {k: d[k] for k in ("MediaBox", "Resources", "Rotate", "CropBox") if k in d}
            if "Kids" in d:
                for kid in self.get(d["Kids"]) or []:
                    walk(kid, own)
            else:
                out.append(own | d)
                self.numbers.append(node.number if isinstance(node, Ref) else -1)

        root = self.get(self.trailer.get("Root"))
        if isinstance(root, dict):
            walk(root.get("Pages"), {})
        return out


def parse(data: bytes) -> Pdf:
    """The objects of a file, found by their headers, so damaged cross-reference tables don't matter."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF header")
    objects: dict[int, Any] = {}
    trailer: dict = {}
    for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
        reader = Reader(data, m.end())
        try:
            v = reader.object()
        except (ValueError, IndexError, AttributeError):
            continue
        reader.skip()
        if isinstance(v, dict) and data.startswith(b"stream", reader.at):
            start = reader.at + 6
            start += 2 if data.startswith(b"\r\n", start) else 1
            size = v.get("Length")
            end = start + size if isinstance(size, int) and data[start + size :].lstrip()[:9] == b"endstream" else data.find(b"endstream", start)
            v = Stream(v, data[start:end])
        objects[int(m[1])] = v
    for m in re.finditer(rb"\btrailer\b", data):
        found = Reader(data, m.end()).object()
        trailer |= found if isinstance(found, dict) else {}
    for v in list(objects.values()):
        kind = v.info.get("Type") if isinstance(v, Stream) else None
        if kind == "XRef":
            trailer |= {k: x for k, x in v.info.items() if k in ("Root", "Info", "Encrypt")}
        elif kind == "ObjStm":
            body = v.data()
            head = Reader(body)
            for _ in range(v.info["N"]):
                number, offset = head.object(), head.object()
                objects.setdefault(number, Reader(body, v.info["First"] + offset).object())
    if "Encrypt" in trailer:
        raise ValueError("the file is encrypted")
    if "Root" not in trailer:
        root = next((n for n, v in objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("no document catalog")
        trailer["Root"] = Ref(root)
    return Pdf(objects, trailer)


# --- text ------------------------------------------------------------------------------------


def _decoder(pdf: Pdf, font: dict) -> Callable[[bytes], list[tuple[str, float, bool]]]:
    """From shown bytes to (text, width in thousandths, is space) of each glyph."""
    wide = font.get("Subtype") == "Type0"
    table: dict[int, str] = {}
    cmap = pdf.get(font.get("ToUnicode"))
    if isinstance(cmap, Stream):
        body = cmap.data().decode("latin-1")
        text = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
        for part in re.findall(r"beginbfchar(.*?)endbfchar", body, re.S):
            table |= {int(a, 16): text(b) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(r"beginbfrange(.*?)endbfrange", body, re.S):
            for a, b, c in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                first, code = text(c), int(a, 16)
                table |= {code + k: first[:-1] + chr(ord(first[-1]) + k) for k in range(min(int(b, 16) - code + 1, 65536))}
    widths = pdf.get(font.get("Widths")) or []
    start = pdf.get(font.get("FirstChar")) or 0
    encoding = "mac-roman" if pdf.get(font.get("Encoding")) == "MacRomanEncoding" else "cp1252"

    def decode(shown: bytes) -> list[tuple[str, float, bool]]:
        step = 2 if wide else 1
        out = []
        for k in range(0, len(shown) - step + 1, step):
            code = int.from_bytes(shown[k : k + step], "big")
            char = table.get(code) or ("�" if wide else bytes([code]).decode(encoding, "replace"))
            width = widths[code - start] if 0 <= code - start < len(widths) else 500
            width = pdf.get(width)
            out.append((char, float(width if isinstance(width, (int, float)) else 500), char.isspace()))
        return out

    return decode


def _times(a: tuple, b: tuple) -> tuple:
    """The product of two matrices (a, b, c, d, e, f)."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


@dataclass
class PageContent:
    """Glyphs (text, x0, x1, baseline, size, is space, font, marked content), rules and images (name, box) of a page, top-left origin."""

    width: float
    height: float
    glyphs: list[tuple[str, float, float, float, float, bool, str, int | None]] = field(default_factory=list)
    rules: list[tuple[str, float, float, float]] = field(default_factory=list)
    images: list[tuple[str, float, float, float, float]] = field(default_factory=list)


def content(pdf: Pdf, page: dict) -> PageContent:
    """What a page shows: text, straight rules and images."""
    x0, y0, x1, y1 = (float(pdf.get(v)) for v in (pdf.get(page.get("MediaBox")) or [0, 0, 612, 792]))
    out = PageContent(x1 - x0, y1 - y0)
    resources = pdf.get(page.get("Resources")) or {}
    fonts, objects, properties = (pdf.get(resources.get(k)) or {} for k in ("Font", "XObject", "Properties"))
    marked: list[int | None] = []
    parts = pdf.get(page.get("Contents"))
    streams = [pdf.get(p) for p in (parts if isinstance(parts, list) else [parts])]
    reader = Reader(b"\n".join(s.data() for s in streams if isinstance(s, Stream)))
    decoders: dict[str, Callable] = {}
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, tm, line = unit, [], unit, unit
    font, size, leading, char_gap, word_gap, scale = "", 0.0, 0.0, 0.0, 0.0, 1.0
    stack: list[Any] = []
    at = (0.0, 0.0)

    def show(shown: bytes) -> None:
        nonlocal tm
        if font not in decoders:
            decoders[font] = _decoder(pdf, pdf.get(fonts.get(font)) or {})
        for char, width, space in decoders[font](shown):
            m = _times((size * scale, 0, 0, size, 0, 0), _times(tm, ctm))
            step = (width / 1000 * size + char_gap + (word_gap if space else 0)) * scale
            after = _times(_times((1, 0, 0, 1, step, 0), tm), ctm)
            out.glyphs.append((char, m[4] - x0, after[4] - x0, out.height - (m[5] - y0), abs(m[3]) or abs(m[1]) or size, space, font, next((n for n in reversed(marked) if n is not None), None)))
            tm = _times((1, 0, 0, 1, step, 0), tm)

    def rule(a: tuple, b: tuple) -> None:
        (ax, ay), (bx, by) = ((p[0] * ctm[0] + p[1] * ctm[2] + ctm[4] - x0, out.height - (p[0] * ctm[1] + p[1] * ctm[3] + ctm[5] - y0)) for p in (a, b))
        if abs(ay - by) < 1.0 < abs(ax - bx):
            out.rules.append(("h", (ay + by) / 2, min(ax, bx), max(ax, bx)))
        elif abs(ax - bx) < 1.0 < abs(ay - by):
            out.rules.append(("v", (ax + bx) / 2, min(ay, by), max(ay, by)))

    while (token := reader.object()) is not None or reader.at < len(reader.data):
        if not isinstance(token, Op):
            stack.append(token)
            continue
        a, stack = stack, []
        try:
            if token == "q":
                saved.append(ctm)
            elif token == "Q":
                ctm = saved.pop() if saved else unit
            elif token == "cm":
                ctm = _times(tuple(map(float, a[-6:])), ctm)
            elif token == "BT":
                tm = line = unit
            elif token == "Tf":
                font, size = a[-2], float(a[-1])
            elif token in ("Td", "TD"):
                leading = -a[-1] if token == "TD" else leading
                tm = line = _times((1, 0, 0, 1, a[-2], a[-1]), line)
            elif token == "Tm":
                tm = line = tuple(map(float, a[-6:]))
            elif token == "T*":
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
            elif token == "TL":
                leading = a[-1]
            elif token == "Tc":
                char_gap = a[-1]
            elif token == "Tw":
                word_gap = a[-1]
            elif token == "Tz":
                scale = a[-1] / 100
            elif token == "Tj":
                show(a[-1])
            elif token in ("'", '"'):
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
                show(a[-1])
            elif token == "TJ":
                for x in a[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    else:
                        tm = _times((1, 0, 0, 1, -x / 1000 * size * scale, 0), tm)
            elif token == "m":
                at = (a[-2], a[-1])
            elif token == "l":
                rule(at, (a[-2], a[-1]))
                at = (a[-2], a[-1])
            elif token == "re":
                x, y, w, h = a[-4:]
                for p, q in (((x, y), (x + w, y)), ((x, y + h), (x + w, y + h)), ((x, y), (x, y + h)), ((x + w, y), (x + w, y + h))):
                    rule(p, q)
            elif token == "Do":
                found = pdf.get(objects.get(a[-1]))
                if isinstance(found, Stream) and found.info.get("Subtype") == "Image":
                    xs, ys = zip(*[(x * ctm[0] + y * ctm[2] + ctm[4] - x0, out.height - (x * ctm[1] + y * ctm[3] + ctm[5] - y0)) for x in (0, 1) for y in (0, 1)], strict=True)
                    out.images.append((str(a[-1]), min(xs), min(ys), max(xs), max(ys)))
            elif token in ("BMC", "BDC"):
                named = a[-1] if token == "BDC" else None
                named = pdf.get(properties.get(named)) if isinstance(named, Name) else named
                marked.append(named.get("MCID") if isinstance(named, dict) else None)
            elif token == "EMC":
                if marked:
                    marked.pop()
            elif token == "BI":  # inline image: skip its data
                end = re.compile(rb"\sEI(?=\s)").search(reader.data, reader.at)
                reader.at = end.end() if end else len(reader.data)
        except (IndexError, TypeError, ValueError):
            continue
    return out


def page_words(page: PageContent, gap: float = 0.55) -> list[tuple]:
    """(block_id, line_id, widx, text, font_size, x0, y0, x1, y1, baseline): glyphs joined to words, lines and blocks.

    Glyphs within half a size of a baseline are a line; a new word starts at white space or a gap
    over 0.55 of the size; a new block where lines are more than 1.6 sizes apart.
    """
    lines: list[list] = []
    for g in sorted(page.glyphs, key=lambda g: (g[3], g[1])):
        if lines and abs(lines[-1][-1][3] - g[3]) <= 0.5 * max(g[4], lines[-1][-1][4], 1.0):
            lines[-1].append(g)
        else:
            lines.append([g])
    out, block, widx, last = [], -1, 0, None
    for line_no, glyphs in enumerate(lines):
        words: list[list] = []
        open_ = False
        for g in sorted(glyphs, key=lambda g: g[1]):
            if g[5]:
                open_ = False
                continue
            if open_ and g[1] - words[-1][-1][2] <= gap * max(g[4], words[-1][-1][4]):
                words[-1].append(g)
            else:
                words.append([g])
            open_ = True
        if not words:
            continue
        base, size = words[0][0][3], max(g[4] for w in words for g in w)
        if last is None or base - last[0] > 1.6 * max(size, last[1]):
            block, widx = block + 1, 0
        last = (base, size)
        for w in words:
            s, b = sum(g[4] for g in w) / len(w), sum(g[3] for g in w) / len(w)
            out.append((block, line_no, widx, "".join(g[0] for g in w), s, w[0][1], b - 0.8 * s, w[-1][2], b + 0.2 * s, b))
            widx += 1
    return out


def font_runs(pdf: Pdf, page: dict, c: PageContent) -> list[tuple]:
    """(family, weight, italic, size, text, x0, y0, x1, y1): neighbouring glyphs of one font and baseline.

    The weight is the font's own, else 700 where its name or flags say bold, else 400.
    """
    fonts = pdf.get((pdf.get(page.get("Resources")) or {}).get("Font")) or {}
    known: dict[str, tuple[str, int, bool]] = {}

    def style(name: str) -> tuple[str, int, bool]:
        if name not in known:
            f = pdf.get(fonts.get(name)) or {}
            inner = pdf.get((pdf.get(f.get("DescendantFonts")) or [None])[0]) or {}
            d = pdf.get(f.get("FontDescriptor") or inner.get("FontDescriptor")) or {}
            full = re.sub(r"^[A-Z]{6}\+", "", str(pdf.get(f.get("BaseFont")) or name))
            flags, weight = int(pdf.get(d.get("Flags")) or 0), pdf.get(d.get("FontWeight"))
            bold = "bold" in full.lower() or bool(flags >> 18 & 1)
            italic = re.search("italic|oblique", full, re.IGNORECASE) is not None or bool(flags >> 6 & 1) or bool(pdf.get(d.get("ItalicAngle")))
            known[name] = (re.split("[-,]", full)[0], int(weight) if isinstance(weight, (int, float)) else 700 if bold else 400, italic)
        return known[name]

    runs: list[list] = []
    for g in c.glyphs:
        if runs and runs[-1][-1][6] == g[6] and abs(runs[-1][-1][3] - g[3]) < 0.5 and runs[-1][-1][4] == g[4]:
            runs[-1].append(g)
        else:
            runs.append([g])
    return [(*style(r[0][6]), r[0][4], "".join(g[0] for g in r), min(g[1] for g in r), r[0][3] - 0.8 * r[0][4], max(g[2] for g in r), r[0][3] + 0.2 * r[0][4]) for r in runs if any(not g[5] for g in r)]


def structure(pdf: Pdf) -> dict[tuple[int, int], tuple[str, str | None, str | None]]:
    """(role, alternative text, actual text) by (page object, marked content) from the file's structure tree."""
    root = pdf.get(pdf.trailer["Root"]) or {}
    tree = pdf.get(root.get("StructTreeRoot")) or {}
    roles = pdf.get(tree.get("RoleMap")) or {}
    out: dict[tuple[int, int], tuple[str, str | None, str | None]] = {}
    todo, seen = [(tree.get("K"), None, None)], set()
    while todo:
        v, page, told = todo.pop()
        if isinstance(v, Ref):
            if v.number in seen:
                continue
            seen.add(v.number)
            v = pdf.get(v)
        if isinstance(v, list):
            todo += [(x, page, told) for x in v]
        elif isinstance(v, int) and page is not None and told:
            out[page, v] = told
        elif isinstance(v, dict):
            page = v["Pg"].number if isinstance(v.get("Pg"), Ref) else page
            if "S" in v:
                role = str(pdf.get(v["S"]))
                told = (str(pdf.get(roles.get(role)) or role), text_value(pdf.get(v.get("Alt"))), text_value(pdf.get(v.get("ActualText"))))
            if isinstance(v.get("MCID"), int) and page is not None and told:
                out[page, v["MCID"]] = told
            todo.append((v.get("K"), page, told))
    return out


def page_tags(pdf: Pdf, number: int, c: PageContent) -> list[tuple]:
    """(mcid, role, alt, actual_text, x0, y0, x1, y1): the boxes of a page's tagged text."""
    roles = structure(pdf)
    groups: dict[int, list] = {}
    for g in c.glyphs:
        if g[7] is not None and (number, g[7]) in roles:
            groups.setdefault(g[7], []).append(g)
    return [(m, *roles[number, m], min(g[1] for g in gs), min(g[3] - 0.8 * g[4] for g in gs), max(g[2] for g in gs), max(g[3] + 0.2 * g[4] for g in gs)) for m, gs in sorted(groups.items())]


def _png(width: int, height: int, channels: int, samples: bytes) -> bytes:
    """Samples of 8 bits as a PNG file."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    step = width * channels
    lines = b"".join(b"\0" + samples[k * step : (k + 1) * step] for k in range(height))
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0 if channels == 1 else 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decoded_image(pdf: Pdf, image: Stream) -> tuple[int, int, str | None, bytes | None]:
    """(width, height, format, bytes): JPEG files as they are, samples of 8 bits in grey or RGB as PNG; bytes are null for the rest."""
    width, height = int(pdf.get(image.info.get("Width")) or 0), int(pdf.get(image.info.get("Height")) or 0)
    filters = pdf.get(image.info.get("Filter"))
    last = (filters or [None])[-1] if isinstance(filters, list) else filters
    if last in ("DCTDecode", "JPXDecode"):
        return (width, height, "jpg" if last == "DCTDecode" else "jp2", image.raw) if filters == last or len(filters) == 1 else (width, height, None, None)
    channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(str(pdf.get(image.info.get("ColorSpace"))))
    try:
        samples = image.data()
    except (ValueError, zlib.error):
        return width, height, None, None
    if channels and pdf.get(image.info.get("BitsPerComponent")) == 8 and len(samples) >= width * height * channels > 0:
        return width, height, "png", _png(width, height, channels, samples)
    return width, height, None, None


def text_value(v: Any) -> str | None:
    """A PDF text string."""
    if not isinstance(v, bytes):
        return None
    return v[2:].decode("utf-16-be", "replace") if v.startswith(b"\xfe\xff") else v.decode("latin-1")


# --- data source -----------------------------------------------------------------------------

_BOX = "x0 double, y0 double, x1 double, y1 double"
SCHEMAS = {
    "words": f"path string, page_num bigint, block_id bigint, line_id bigint, widx bigint, text string, font_size double, {_BOX}, baseline_y double, error string",
    "pages": "path string, page_num bigint, width double, height double, rotation int, n_words bigint, error string",
    "rules": "path string, page_num bigint, orientation string, pos double, lo double, hi double, error string",
    "images": f"path string, page_num bigint, image_index bigint, {_BOX}, pixel_width int, pixel_height int, format string, content binary, error string",
    "fonts": f"path string, page_num bigint, family string, weight int, italic boolean, font_size double, text string, {_BOX}, error string",
    "tags": f"path string, page_num bigint, mcid bigint, role string, alt string, actual_text string, {_BOX}, error string",
    "metadata": "path string, page_count bigint, title string, author string, subject string, keywords string, creator string, producer string, created string, modified string, xmp boolean, signed boolean, error string",
}


def rows_of(path: str, data: bytes, table: str) -> Iterator[tuple]:
    """The rows of one file; one row with an error where the file can't be read, one per page that can't."""
    width = SCHEMAS[table].count(",") + 1
    failed = lambda e, *known: (path, *known, *[None] * (width - 2 - len(known)), f"{type(e).__name__}: {e}")
    try:
        pdf = parse(data)
        pages = pdf.pages()
        if table == "metadata":
            info = pdf.get(pdf.trailer.get("Info")) or {}
            root = pdf.get(pdf.trailer["Root"]) or {}
            form = pdf.get(root.get("AcroForm")) or {}
            fields = [pdf.get(f) or {} for f in pdf.get(form.get("Fields")) or []]
            keys = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
            yield (path, len(pages), *[text_value(pdf.get(info.get(k))) or None for k in keys], "Metadata" in root, any(f.get("FT") == "Sig" for f in fields), None)
            return
    except Exception as e:  # noqa: BLE001 - any damage is the file's, not the job's
        yield failed(e)
        return
    for k, page in enumerate(pages):
        try:
            c = content(pdf, page)
            if table == "rules":
                yield from ((path, k, *r, None) for r in c.rules)
            elif table == "images":
                held = pdf.get((pdf.get(page.get("Resources")) or {}).get("XObject")) or {}
                decoded = [(box, decoded_image(pdf, pdf.get(held[name]))) for name, *box in c.images]
                kept = [(box, d) for box, d in decoded if d[3] is not None]  # undecodable ones are left out of the numbering
                yield from ((path, k, n, *box, *d, None) for n, (box, d) in enumerate(kept))
            elif table == "fonts":
                yield from ((path, k, *r, None) for r in font_runs(pdf, page, c))
            elif table == "tags":
                yield from ((path, k, *t, None) for t in page_tags(pdf, pdf.numbers[k], c))
            else:
                words = page_words(c)
                if table == "pages":
                    yield (path, k, c.width, c.height, int(pdf.get(page.get("Rotate")) or 0) % 360, len(words), None)
                else:
                    yield from ((path, k, *w, None) for w in words)
        except Exception as e:  # noqa: BLE001
            yield failed(e, k)


def read_pdf(spark: SparkSession, path: str, table: str = "words") -> DataFrame:
    """A table of the PDF files of a folder, a glob or one file, on any file system Spark reads.

    Files are packed into partitions by size, and read and taken apart where a partition lies.
    """
    from docloom.session import ship

    ship(spark)
    schema = SCHEMAS[table]
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(rows_of(file, content, table)), columns=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content").mapInPandas(run, schema)


# --- writing ---------------------------------------------------------------------------------


def _serial(v: Any) -> bytes:
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], v.encode("latin-1"))
    if isinstance(v, Ref):
        return b"%d 0 R" % v.number
    if isinstance(v, bytes):
        return b"<" + v.hex().encode() + b">"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(v, list):
        return b"[" + b" ".join(map(_serial, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(_serial(Name(k)) + b" " + _serial(x) for k, x in v.items()) + b">>"
    if isinstance(v, Stream):
        return _serial(v.info | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    return str(v).encode()


def build(chosen: list[tuple[Pdf, dict]], info: dict[str, str] | None = None) -> bytes:
    """A file of pages of other files: what each page needs is copied, the rest left out."""
    objects: dict[int, Any] = {1: None, 2: None}
    copied: dict[tuple[int, int], Ref] = {}

    def copy(pdf: Pdf, v: Any) -> Any:
        if isinstance(v, Ref):
            key = (id(pdf), v.number)
            if key not in copied:
                copied[key] = Ref(len(objects) + 1)
                objects[copied[key].number] = None
                target = pdf.get(v)
                if not (isinstance(target, dict) and target.get("Type") in ("Page", "Pages", "Catalog")):
                    objects[copied[key].number] = copy(pdf, target)
            return copied[key]
        if isinstance(v, dict):
            return {k: copy(pdf, x) for k, x in v.items() if k != "Parent"}
        if isinstance(v, list):
            return [copy(pdf, x) for x in v]
        if isinstance(v, Stream):
            return Stream(copy(pdf, v.info), v.raw)
        return v

    kids = []
    for pdf, page in chosen:
        kids.append(Ref(len(objects) + 1))
        number = kids[-1].number
        objects[number] = None
        objects[number] = copy(pdf, page) | {"Type": Name("Page"), "Parent": Ref(2)}
    objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2)}
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    trailer: dict[str, Any] = {"Root": Ref(1)}
    if info:
        trailer["Info"] = Ref(len(objects) + 1)
        objects[trailer["Info"].number] = {k: v.encode("latin-1") if v.isascii() else b"\xfe\xff" + v.encode("utf-16-be") for k, v in info.items()}
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for n, v in sorted(objects.items()):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + _serial(v) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(places))
    return bytes(out + b"trailer\n" + _serial(trailer | {"Size": len(objects) + 1}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def _box(pdf: Pdf, page: dict) -> list[float]:
    """The page's media box, its own or that of a page tree above."""
    node = page
    while isinstance(node, dict) and "MediaBox" not in node:
        node = pdf.get(node.get("Parent"))
    return [float(pdf.get(v)) for v in pdf.get(node["MediaBox"])] if isinstance(node, dict) else [0.0, 0.0, 612.0, 792.0]


def transformed(pdf: Pdf, page: dict, matrix: list[float], size: tuple[float, float]) -> dict:
    """The page drawn through a matrix onto a sheet of a size; streams are wrapped, not rewritten."""
    def added(data: bytes) -> Ref:
        number = max(pdf.objects, default=0) + 1
        pdf.objects[number] = Stream({}, data)
        return Ref(number)

    own = page.get("Contents")
    listed = pdf.get(own)
    parts = listed if isinstance(listed, list) else [own] if own is not None else []
    head = added(b"q " + b" ".join(_serial(float(v)) for v in matrix) + b" cm\n")
    return page | {"MediaBox": [0.0, 0.0, *size], "Contents": [head, *parts, added(b"\nQ\n")]}


def apply_plan(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(out, content, error): PDFs made by a page plan.

    ``files`` has doc_id and content; ``plan`` has out, doc_id, out_page, page (1-based) and may have
    rotation, crop (x0, y0, x1, y1), and matrix (six numbers) with width and height of the new sheet.
    One output is one group, as its bytes are one value; its files are those the plan names.
    """
    optional = {"rotation": "int", "crop": "array<double>", "matrix": "array<double>", "width": "double", "height": "double"}
    given = [(F.col(c) if c in plan.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()]
    todo = plan.select("out", "doc_id", "out_page", "page", *given)
    first = todo.groupBy("out", "doc_id").agg(F.collect_list(F.struct("out_page", "page", *optional)).alias("steps"))

    def run(pdf_rows):
        try:
            steps = []
            for row in pdf_rows.itertuples(index=False):
                parsed = parse(row.content)
                pages = parsed.pages()
                for s in row.steps:
                    page = dict(pages[s["page"] - 1])
                    turned = (int(parsed.get(page.get("Rotate")) or 0) + int(s["rotation"] or 0)) % 360
                    page.pop("Rotate", None)
                    page.setdefault("MediaBox", _box(parsed, page))
                    if s["crop"] is not None and len(s["crop"]):
                        x0, y0, x1, y1 = map(float, s["crop"])
                        if x1 <= x0 or y1 <= y0:
                            raise ValueError("an empty crop box")
                        page["CropBox"] = [x0, y0, x1, y1]
                    if s["matrix"] is not None and len(s["matrix"]):
                        page = transformed(parsed, page, list(map(float, s["matrix"])), (float(s["width"]), float(s["height"])))
                    steps.append((s["out_page"], parsed, page | ({"Rotate": turned} if turned else {})))
            steps.sort(key=lambda s: s[0])
            made, error = build([(p, page) for _, p, page in steps]), None
        except Exception as e:  # noqa: BLE001
            made, error = None, f"{type(e).__name__}: {e}"
        import pandas as pd

        return pd.DataFrame({"out": [pdf_rows["out"].iloc[0]], "content": [made], "error": [error]})

    return first.join(files.select("doc_id", "content"), "doc_id").groupBy("out").applyInPandas(run, "out string, content binary, error string")


#: The document information fields.
INFO_FIELDS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


def with_info(data: bytes, changes: dict[str, str | None], now: str, force: bool = False) -> tuple[bytes, bool]:
    """(file, whether it also has XMP metadata that stays as it is): information fields set, or cleared where None.

    The change is appended, so all that was there stays. The date of change is set unless it is among
    the changes. Signed files are refused unless forced; what was written is read back and compared.
    """
    unknown = sorted(set(changes) - set(INFO_FIELDS))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    pdf = parse(data)
    root = pdf.get(pdf.trailer["Root"]) or {}
    form = pdf.get(root.get("AcroForm")) or {}
    fields = [pdf.get(f) or {} for f in pdf.get(form.get("Fields")) or []]
    if any(f.get("FT") == "Sig" for f in fields) and not force:
        raise ValueError("the file is signed")
    info = dict(pdf.get(pdf.trailer.get("Info")) or {})
    wanted = {"ModDate": now} | changes
    for name, value in wanted.items():
        info.pop(name, None)
        if value is not None:
            info[name] = value.encode("latin-1") if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be")
    number = max(pdf.objects, default=0) + 1
    out = bytearray(data if data.endswith(b"\n") else data + b"\n")
    place = len(out)
    out += b"%d 0 obj\n" % number + _serial(info) + b"\nendobj\n"
    start, ahead = len(out), data.rfind(b"startxref")
    old = re.match(rb"startxref\s+(\d+)", data[ahead:]) if ahead >= 0 else None
    trailer = {"Root": pdf.trailer["Root"], "Info": Ref(number), "Size": number + 1} | ({"Prev": int(old[1])} if old else {})
    out += b"xref\n%d 1\n%010d 00000 n \ntrailer\n" % (number, place) + _serial(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    seen = parse(bytes(out))
    stored = seen.get(seen.trailer["Info"])
    if any(text_value(stored.get(k)) != v for k, v in wanted.items()):
        raise ValueError("the fields read back differ")
    return bytes(out), "Metadata" in root


def set_metadata(files: DataFrame, changes: DataFrame, now: str, force: bool = False) -> DataFrame:
    """(doc_id, content, xmp, error): files with changed information; ``changes`` has doc_id, field and value, null to clear it.

    ``changes`` goes by file: one row of all its fields meets one file.
    """
    per = changes.groupBy("doc_id").agg(F.collect_list(F.struct("field", "value")).alias("changes"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, content, todo in zip(batch["doc_id"], batch["content"], batch["changes"], strict=True):
                try:
                    made, xmp = with_info(content, {c["field"]: c["value"] for c in todo}, now, force)
                    rows.append((doc, made, xmp, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((doc, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "xmp", "error"])

    return files.select("doc_id", "content").join(per, "doc_id").mapInPandas(run, "doc_id bigint, content binary, xmp boolean, error string")
