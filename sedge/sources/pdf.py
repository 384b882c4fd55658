"""Plain text and outline of PDF files without a library: objects, streams, page tree and text operators.

Text comes in the order in which a page writes it, a line per change of the line position. Fonts with a map to Unicode are
decoded by it, others as Windows Latin. Encrypted files, and pages that are pictures, have no text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)(?:\bendobj\b|\Z)", re.DOTALL)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, b"" if x in b"\r\n" else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.DOTALL)


class Document:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.objects = {int(m.group(1)): m.group(3) for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """Objects within a stream: their numbers and places come first."""
        count, first = (int(re.search(rb"/%s\s+(\d+)" % k, body).group(1)) for k in (b"N", b"First"))
        data = self.stream(body)
        pairs = list(map(int, data[:first].split()))[: 2 * count]
        places = [*pairs[1::2], len(data) - first]
        for number, a, b in zip(pairs[::2], places[:-1], places[1:], strict=True):
            self.objects.setdefault(number, data[first + a : first + b])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"FlateDecode" in m.group(1):
            return zlib.decompressobj().decompress(m.group(2))
        return m.group(2) if b"/Filter" not in m.group(1) else b""

    def refers(self, body: bytes, key: bytes) -> list[int]:
        """Objects that an entry names, one or an array of them."""
        m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
        return [int(x) for x in _REFERENCE.findall(m.group(1))] if m else []

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree."""
        out, seen = [], set()
        roots = [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not self.refers(b, b"Parent")]
        waiting = roots[:1]
        while waiting:
            n = waiting.pop(0)
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            if re.search(rb"/Type\s*/Pages\b", body):
                waiting = self.refers(body, b"Kids") + waiting
            elif body:
                out.append(body)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str] | None]:
        """The map to Unicode of each font of a page, with the bytes per character at 0."""
        holder, at = page, page
        for _ in range(20):  # resources may be those of a parent
            if (own := self.refers(at, b"Resources")) or b"/Font" in at:
                holder = self.objects.get(own[0], b"") if own else at
                break
            up = self.refers(at, b"Parent")
            if not up:
                break
            at = self.objects.get(up[0], b"")
        named = self.refers(holder, b"Font")
        table = self.objects.get(named[0], b"") if named else (re.search(rb"/Font\s*<<(.*?)>>", holder, re.DOTALL) or [b"", b""])[1]
        out = {}
        for name, number in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", table):
            maps = self.refers(self.objects.get(int(number), b""), b"ToUnicode")
            out[name] = _cmap(self.stream(self.objects.get(maps[0], b""))) if maps else None
        return out

    def text(self, page: bytes) -> str:
        fonts, data = self.fonts(page), b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.refers(page, b"Contents"))
        out: list[str] = []
        font: dict[int, str] | None = None
        stack: list[bytes] = []
        for m in _TOKEN.finditer(data):
            t = m.group()
            if t[:1].isalpha() or t in (b"'", b'"', b"T*"):
                if t == b"Tf" and len(stack) > 1:
                    font = fonts.get(stack[-2][1:])
                elif t in (b"Td", b"TD") and stack and float(stack[-1] or 0) != 0 or t in (b"T*", b"'", b'"', b"Tm", b"ET"):
                    out.append("\n")
                if t in (b"Tj", b"TJ", b"'", b'"'):
                    for s in stack:
                        if s[:1] in (b"(", b"<"):
                            out.append(_shown(s, font))
                        elif t == b"TJ" and re.fullmatch(rb"-\d+\.?\d*", s) and float(s) < -180:
                            out.append(" ")
                stack = []
            else:
                stack.append(t)
        return "\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())

    def outline(self) -> list[tuple[str, int]]:
        """Titles of the outline with their levels from 0, depth first."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Outlines\b", b)]
        out: list[tuple[str, int]] = []
        waiting = [(n, 0) for b in roots for n in self.refers(b, b"First")]
        seen: set[int] = set()
        while waiting:
            n, level = waiting.pop()
            body = self.objects.get(n, b"")
            if n in seen or not body:
                continue
            seen.add(n)
            m = re.search(rb"/Title\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", body, re.DOTALL)
            if m:
                out.append((_shown(m.group(1), None), level))
            waiting += [(k, level) for k in self.refers(body, b"Next")] + [(k, level + 1) for k in self.refers(body, b"First")]
        return out


def _shown(s: bytes, font: dict[int, str] | None) -> str:
    raw = _unescaped(s[1:-1]) if s[:1] == b"(" else bytes.fromhex((h := re.sub(rb"\s", b"", s[1:-1]).decode()) + "0" * (len(h) % 2))
    if font is None:
        return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = int(font.get(-1, "1"))
    return "".join(font.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _cmap(data: bytes) -> dict[int, str]:
    """Characters by code; the width of a code is kept under -1."""
    out: dict[int, str] = {}
    width = 1
    decoded = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = len(a) // 2
            out[int(a, 16)] = decoded(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", block):
            width = len(a) // 2
            each = re.findall(rb"<([0-9A-Fa-f]+)>", c)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                if c[:1] == b"[":
                    if k < len(each):
                        out[int(a, 16) + k] = decoded(each[k])
                elif (first := decoded(each[0])) and ord(first[-1]) + k < 0x110000:
                    out[int(a, 16) + k] = first[:-1] + chr(ord(first[-1]) + k)
    return {**out, -1: str(max(1, width))}


def parse_pdf(df: DataFrame, content: str, from_page: int = 0, to_page: int = 100_000) -> DataFrame:
    """PDF files: ``pages`` (number from 0, text) of the range, ``outline`` (title, level), ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf[content]:
                try:
                    d = Document(bytes(raw))
                    pages = [{"no": i, "text": d.text(p)} for i, p in enumerate(d.pages()) if from_page <= i < to_page]
                    rows.append((pages, [{"title": t, "level": n} for t, n in d.outline()], None))
                except Exception as e:  # one broken file mustn't end the job
                    rows.append(([], [], str(e)[:200] or type(e).__name__))
            yield pdf.drop(columns=[content]).assign(**{k: pd.Series([r[i] for r in rows], dtype=object, index=pdf.index) for i, k in enumerate(("pages", "outline", "error"))})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != content)
    return df.mapInPandas(run, (kept + ", " if kept else "") + "pages array<struct<no:int,text:string>>, outline array<struct<title:string,level:int>>, error string")
