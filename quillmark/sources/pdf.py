"""PDF pages as the ``blocks`` table, without a PDF library.

Reads what most generated PDFs have: Flate or plain streams, object streams, text operators, simple and composite
fonts and their ToUnicode programs.  Widths come from the font where it lists them, else half the size; a composite
font without a ToUnicode program has no text.  Encrypted files give no blocks.  Rendering
needs an engine and is left to adapters.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BBOX, SCHEMAS

_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[^\s/<>\[\]()]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _objects(data: bytes) -> dict[int, bytes]:
    """Bodies of all objects by number, those in object streams too; the last of a number wins."""
    found = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            inner = _stream(body, found)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            head = list(map(int, inner[:first].split()))
            starts = head[1::2] + [len(inner) - first]
            for number, a, b in zip(head[::2], starts, starts[1:], strict=False):
                found.setdefault(number, inner[first + a : first + b])
    return found


def _stream(body: bytes, objects: dict[int, bytes]) -> bytes:
    m = re.search(rb"stream\r?\n(.*)endstream", body, re.S)
    if not m:
        return b""
    raw = m[1]
    if b"FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""
    return raw


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _inherited(number: int, key: bytes, objects: dict[int, bytes]) -> bytes | None:
    for _ in range(50):
        body = objects.get(number, b"")
        if re.search(rb"/" + key + rb"\b", body):
            return body
        up = _refs(body, b"Parent")
        if not up:
            return None
        number = up[0]
    return None


def _pages(objects: dict[int, bytes]) -> list[int]:
    """Numbers of the pages in order."""
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog", b)), None)
    if root is None:
        return []
    out, todo, seen = [], _refs(objects[root], b"Pages"), set()
    while todo:
        n = todo.pop(0)
        if n in seen:
            continue
        seen.add(n)
        body = objects.get(n, b"")
        if re.search(rb"/Type\s*/Pages\b", body):
            todo = _refs(body, b"Kids") + todo
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(n)
    return out


def _resource(page: int, kind: bytes, objects: dict[int, bytes]) -> list[tuple[bytes, int]]:
    """Names and object numbers of a page's resources of a kind."""
    body = _inherited(page, b"Resources", objects) or b""
    link = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body)
    body = objects.get(int(link[1]), b"") if link else body
    link = re.search(rb"/" + kind + rb"\s+(\d+)\s+\d+\s+R", body)
    table = objects.get(int(link[1]), b"") if link else (re.search(rb"/" + kind + rb"\s*<<(.*?)>>", body, re.S) or [b"", b""])[1]
    return [(name, int(number)) for name, number in re.findall(rb"(/[^\s/]+)\s+(\d+)\s+\d+\s+R", table)]


class Font:
    """How a font's strings read: codes of one byte or two, their characters and their widths."""

    def __init__(self, body: bytes = b"", objects: dict[int, bytes] | None = None):
        objects = objects or {}
        self.bold = b"bold" in body.lower()
        self.bytes, self.default, self.widths = 1, 500.0, {}
        below = _refs(body, b"DescendantFonts")
        if below:  # a composite font: two bytes a code, as in the usual Identity encoding
            inner = objects.get(below[0], b"")
            if re.fullmatch(rb"\s*\[.*\]\s*", inner, re.S):
                inner = objects.get(int((re.findall(rb"(\d+)\s+\d+\s+R", inner) or [b"0"])[0]), b"")
            self.bytes, self.bold = 2, self.bold or b"bold" in inner.lower()
            self.default = float((re.search(rb"/DW\s+([\d.]+)", inner) or [b"", b"1000"])[1])
            self._ranges(_array(inner, b"W", objects))
        else:
            first = re.search(rb"/FirstChar\s+(\d+)", body)
            values = [float(x) for x in re.findall(rb"[\d.]+", _array(body, b"Widths", objects))]
            self.widths = dict(enumerate(values, int(first[1]) if first else 0))
        told = _refs(body, b"ToUnicode")
        self.characters = _character_map(_stream(objects.get(told[0], b""), objects)) if told else {}

    def _ranges(self, listed: bytes) -> None:
        """``/W``: a code and the list of widths from it on, or two codes and the width of all between."""
        for m in re.finditer(rb"(\d+)\s*\[([^\]]*)\]|(\d+)\s+(\d+)\s+([\d.]+)", listed):
            if m[1]:
                self.widths.update(enumerate(map(float, m[2].split()), int(m[1])))
            else:
                self.widths.update(dict.fromkeys(range(int(m[3]), min(int(m[4]), 0xFFFF) + 1), float(m[5])))

    def read(self, raw: bytes) -> tuple[str, float]:
        """Characters of a string and its width in thousandths of the size."""
        codes = raw if self.bytes == 1 else [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)]
        wide = sum(self.widths.get(c, self.default) for c in codes)
        if not self.characters:
            return (raw.decode("cp1252", "replace") if self.bytes == 1 else ""), wide
        other = (lambda c: bytes([c]).decode("cp1252", "replace")) if self.bytes == 1 else (lambda c: "")
        return "".join(self.characters[c] if c in self.characters else other(c) for c in codes), wide


def _array(body: bytes, key: bytes, objects: dict[int, bytes]) -> bytes:
    """What stands between the brackets of an array, there or by reference."""
    link = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
    if link:
        found = re.search(rb"\[(.*)\]", objects.get(int(link[1]), b""), re.S)
    else:
        found = re.search(rb"/" + key + rb"\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]", body, re.S)
    return found[1] if found else b""


def _character_map(program: bytes) -> dict[int, str]:
    """Characters by code from a ToUnicode program: single codes, ranges, and ranges with a list."""
    text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", program, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", program, re.S):
        for low, high, to, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]*)>|\[([^\]]*)\])", block):
            lo, hi = int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF)
            if listed:
                out.update(zip(range(lo, hi + 1), (text(x) for x in re.findall(rb"<([0-9A-Fa-f\s]*)>", listed))))
            elif start := text(to):
                out.update({c: start[:-1] + chr(min(ord(start[-1]) + c - lo, 0x10FFFF)) for c in range(lo, hi + 1)})
    return out


def _fonts(page: int, objects: dict[int, bytes]) -> dict[bytes, Font]:
    """Fonts by resource name."""
    return {name: Font(objects.get(number, b""), objects) for name, number in _resource(page, b"Font", objects)}


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    out = re.sub(rb"\\(\d{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return out


def _product(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def _shows(content: bytes, fonts: dict, placed: list | None = None) -> Iterator[tuple[str, float, float, float, float, bool]]:
    """(text, x, y, width, size, bold) of what the content shows, in its order; rotated text is left out.

    Names of drawn objects and their matrices are added to ``placed``.
    """
    one = [1.0, 0, 0, 1, 0, 0]
    ctm, stack, tm, lm = one, [], one, one
    font, size, lead, args = Font(), 1.0, 0.0, []
    inside: list | None = None
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            inside = []
        elif t == b"]":
            args.append(inside or [])
            inside = None
        elif t[:1] in b"(<" and t not in (b"<<", b">>"):
            (args if inside is None else inside).append(_literal(t))
        elif t[:1] == b"/" or re.fullmatch(rb"[+-]?\d*\.?\d+|[+-]?\d+\.", t):
            (args if inside is None else inside).append(t if t[:1] == b"/" else float(t))
        elif inside is None:
            nums = [x for x in args if isinstance(x, float)]
            if t == b"q":
                stack.append(ctm)
            elif t == b"Q" and stack:
                ctm = stack.pop()
            elif t == b"cm" and len(nums) == 6:
                ctm = _product(nums, ctm)
            elif t == b"Do" and args and placed is not None:
                placed.append((args[-1], ctm))
            elif t == b"BT":
                tm = lm = one
            elif t == b"Tf" and len(args) >= 2 and nums:
                font, size = fonts.get(args[-2]) or Font(), nums[-1]
            elif t == b"TL" and nums:
                lead = nums[-1]
            elif t in (b"Td", b"TD") and len(nums) >= 2:
                lead = -nums[-1] if t == b"TD" else lead
                tm = lm = _product([1, 0, 0, 1, nums[-2], nums[-1]], lm)
            elif t == b"Tm" and len(nums) == 6:
                tm = lm = nums
            elif t in (b"T*", b"'", b'"'):
                tm = lm = _product([1, 0, 0, 1, 0, -lead], lm)
            if t in (b"Tj", b"TJ", b"'", b'"') and args:
                text, along = "", 0.0
                for x in args[-1] if isinstance(args[-1], list) else [args[-1]]:
                    if isinstance(x, float):
                        along -= x / 1000 * size
                        if x < -180:
                            text += " "
                    elif isinstance(x, bytes):
                        shown, wide = font.read(x)
                        text += shown
                        along += wide / 1000 * size
                at = _product(tm, ctm)
                scale = (at[2] ** 2 + at[3] ** 2) ** 0.5
                wide = (at[0] ** 2 + at[1] ** 2) ** 0.5
                if wide and abs(at[0] / wide - 1) <= 0.05 and abs(at[1] / wide) <= 0.05 and text:
                    yield text, at[4], at[5], along * wide, size * scale, font.bold
                tm = _product([1, 0, 0, 1, along, 0], tm)
            args = []


def page_blocks(data: bytes) -> Iterator[tuple[int, int, float, tuple, list[dict]]]:
    """(page, block_no, page height, bbox, lines) of a file."""
    if b"/Encrypt" in data[-4096:]:
        return
    objects = _objects(data)
    for number, page in enumerate(_pages(objects)):
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", _inherited(page, b"MediaBox", objects) or b"")
        height = float(box[1].split()[3]) if box else 792.0
        content = b"\n".join(_stream(objects.get(n, b""), objects) for n in _refs(objects[page], b"Contents"))
        lines: list[dict] = []
        last_y = None
        for text, x, y, width, size, bold in _shows(content, _fonts(page, objects)):
            top, bottom = height - y - 0.8 * size, height - y + 0.2 * size
            if last_y is not None and abs(y - last_y) < 0.3 * size and x >= lines[-1]["x1"] - size:
                line = lines[-1]
                gap = x - line["x1"] > 0.15 * size and not line["text"].endswith(" ")
                line["text"] += " " * gap + text
                line["x1"], line["y0"], line["y1"] = max(line["x1"], x + width), min(line["y0"], top), max(line["y1"], bottom)
            else:
                line = {"text": text, "x0": x, "y0": top, "x1": x + width, "y1": bottom, "sizes": [], "bold_chars": 0, "chars": 0}
                lines.append(line)
            if text.strip():
                line["sizes"].append({"size": round(size, 1), "n": len(text)})
                line["bold_chars"] += len(text) * bold
                line["chars"] += len(text)
            last_y = y
        groups: list[list[dict]] = []
        for line in (x for x in lines if x["chars"]):
            prior = groups[-1][-1] if groups else None
            near = prior and 0 <= line["y0"] - prior["y0"] < 1.6 * (prior["y1"] - prior["y0"]) and abs(line["x0"] - prior["x0"]) < 60 and prior["sizes"][0]["size"] == line["sizes"][0]["size"]
            if near:
                groups[-1].append(line)
            else:
                groups.append([line])
        for i, group in enumerate(groups):
            union = tuple(f(ln[k] for ln in group) for f, k in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1")))
            made = [{"text": ln["text"], "bbox": {k: ln[k] for k in ("x0", "y0", "x1", "y1")}, "sizes": ln["sizes"], "bold_chars": ln["bold_chars"], "chars": ln["chars"]} for ln in group]
            yield number, i, height, dict(zip(("x0", "y0", "x1", "y1"), union, strict=True)), made


def page_images(data: bytes) -> Iterator[tuple]:
    """(page, bbox, sha256, width, height, channels, pixels) of the placed images of a file.

    Plain and Flate images of eight bits in grey or RGB have pixels, as BGR rows; others only their hash.
    """
    if b"/Encrypt" in data[-4096:]:
        return
    objects = _objects(data)
    for number, page in enumerate(_pages(objects)):
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", _inherited(page, b"MediaBox", objects) or b"")
        height = float(box[1].split()[3]) if box else 792.0
        content = b"\n".join(_stream(objects.get(n, b""), objects) for n in _refs(objects[page], b"Contents"))
        named, placed = dict(_resource(page, b"XObject", objects)), []
        for _ in _shows(content, {}, placed):
            pass
        for name, m in placed:
            body = objects.get(named.get(name, -1), b"")
            if not re.search(rb"/Subtype\s*/Image", body):
                continue
            raw = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
            size = [int(x[1]) if (x := re.search(rb"/" + k + rb"\s+(\d+)", body)) else 0 for k in (b"Width", b"Height")]
            channels = 3 if b"/DeviceRGB" in body else 1 if b"/DeviceGray" in body else 0
            pixels = _stream(body, objects)[: size[0] * size[1] * channels]
            usable = channels and len(pixels) == size[0] * size[1] * channels and (b"/Filter" not in body or b"FlateDecode" in body) and not re.search(rb"/Predictor\s+[2-9]", body)
            if usable and channels == 3:
                swapped = bytearray(pixels)
                swapped[0::3], swapped[2::3] = pixels[2::3], pixels[0::3]
                pixels = bytes(swapped)
            xs, ys = sorted((m[4], m[4] + m[0] + m[2])), sorted((height - m[5], height - m[5] - m[1] - m[3]))
            where = {"x0": xs[0], "y0": ys[0], "x1": xs[1], "y1": ys[1]}
            yield number, where, hashlib.sha256(raw[1] if raw else b"").hexdigest(), *size, channels if usable else 0, pixels if usable else None


def read_figures(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Raster figures of files given as ``doc_id, content``, numbered through each document."""
    schema = f"{key} long, id int, page int, bbox {BBOX}, kind string, sha256 string, width int, height int, channels int, data binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "id", "page", "bbox", "kind", "sha256", "width", "height", "channels", "data"]
        for frame in frames:
            for k, content in zip(frame[key], frame["content"], strict=True):
                rows = [(k, i, x[0], x[1], "raster", *x[2:]) for i, x in enumerate(page_images(bytes(content or b"")))]
                yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(key).cast("long").alias(key), "content").mapInPandas(run, schema)


#: Colours of marks by layer.
COLOURS = {"exact": (0.9, 0.3, 0.3), "near": (0.95, 0.65, 0.2), "semantic": (0.35, 0.55, 1.0), "figure": (0.2, 0.75, 0.35)}


def annotate(data: bytes, marks: list[tuple[int, tuple[float, float, float, float], str, str]]) -> bytes | None:
    """The file with marks ``(page, bbox, layer, note)`` appended as annotations; None if it is encrypted.

    Text is highlighted, figures are framed; marks under a point or beyond the last page are left out.
    The file's own bytes stay as they are and an update is written after them.
    """
    if b"/Encrypt" in data[-4096:]:
        return None
    objects = _objects(data)
    pages = _pages(objects)
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog", b)), None)
    if root is None:
        return data
    top, written = max(objects) + 1, {}
    by_page: dict[int, list[int]] = {}
    for page, (x0, y0, x1, y1), layer, note in marks:
        if page >= len(pages) or x1 - x0 < 1 or y1 - y0 < 1:
            continue
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", _inherited(pages[page], b"MediaBox", objects) or b"")
        height = float(box[1].split()[3]) if box else 792.0
        low, high = height - y1, height - y0
        colour = " ".join(f"{c:g}" for c in COLOURS[layer])
        kind = "/Square /BS << /W 2 >>" if layer == "figure" else f"/Highlight /QuadPoints [{x0:g} {high:g} {x1:g} {high:g} {x0:g} {low:g} {x1:g} {low:g}]"
        text = ("\ufeff" + note).encode("utf-16-be").hex()
        written[top] = f"<< /Type /Annot /Subtype {kind} /Rect [{x0:g} {low:g} {x1:g} {high:g}] /C [{colour}] /F 4 /Contents <{text}> >>".encode()
        by_page.setdefault(page, []).append(top)
        top += 1
    for page, numbers in by_page.items():
        body = objects[pages[page]].strip()
        own = b" ".join(b"%d 0 R" % n for n in numbers)
        old = re.search(rb"/Annots\s*\[([^\]]*)\]", body)
        if old:
            body = body[: old.start(1)] + old[1] + b" " + own + body[old.end(1) :]
        else:
            body = body[: body.rindex(b">>")] + b" /Annots [" + own + b"] >>"
        written[pages[page]] = body
    out, places = bytearray(data + b"\n"), {}
    for n, body in sorted(written.items()):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    before = re.findall(rb"startxref\s+(\d+)", data)
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in sorted(places.items()))
    prev = b" /Prev %d" % int(before[-1]) if before else b""
    out += b"trailer\n<< /Size %d /Root %d 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (top, root, prev, at)
    return bytes(out)


def page_sizes(data: bytes) -> Iterator[tuple[int, float, float]]:
    """(page, width, height) of every page of a file, with text or without."""
    if b"/Encrypt" in data[-4096:]:
        return
    objects = _objects(data)
    for number, page in enumerate(_pages(objects)):
        box = re.search(rb"/MediaBox\s*\[([^\]]*)\]", _inherited(page, b"MediaBox", objects) or b"")
        x0, y0, x1, y1 = map(float, box[1].split()) if box else (0, 0, 612, 792)
        yield number, x1 - x0, y1 - y0


def read_pages(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, page, width, height`` of files given as ``doc_id, content``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *x) for k, content in zip(frame[key], frame["content"], strict=True) for x in page_sizes(bytes(content or b""))]
            yield pd.DataFrame(rows, columns=[key, "page", "width", "height"])

    return files.select(F.col(key).cast("long").alias(key), "content").mapInPandas(run, f"{key} long, page int, width double, height double")


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of grey or BGR rows."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., ::-1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, -1)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def read_blocks(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ``blocks`` table of files given as ``doc_id, content``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, content in zip(frame[key], frame["content"], strict=True):
                rows = [(k, *x) for x in page_blocks(bytes(content or b""))]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "block_no", "page_height", "bbox", "lines"])

    return files.select(F.col(key).cast("long").alias(key), "content").mapInPandas(run, SCHEMAS["blocks"])
