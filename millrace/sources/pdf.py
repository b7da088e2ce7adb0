"""A small PDF text parser: text operators of the pages' content streams, plain or deflated, in one-byte encodings.

It reads what office programs and typesetters commonly write. Encrypted files, and fonts that need a character map, are
beyond it: plug another parser into files.pdfs() for those.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
# The escapes of literal strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap of so many thousandths of the font's size between strings of an array parts words.
GAP = 200


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escaped(m: re.Match[bytes]) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else ESCAPES.get(x, b"" if x in b"\r\n" else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escaped, token[1:-1], flags=re.S)


def _shown(stream: bytes) -> str:
    out: list[str] = []
    held: list[bytes | float | str] = []
    for m in TOKEN.finditer(stream):
        token = m[0]
        if token[:1] in b"(<":
            held.append(_literal(token))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            held.append(float(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if isinstance(x, bytes):
                    out.append(x.decode("cp1252", "replace"))
                elif token == b"TJ" and isinstance(x, float) and x < -GAP:
                    out.append(" ")
            held = []
        elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET"):
            out.append("\n")
            held = []
        elif token not in (b"[", b"]"):
            held = []
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pages(content: bytes) -> list[str]:
    """The text of each page, in the order of the page objects."""
    if not content.lstrip().startswith(b"%PDF-"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in content:
        raise ValueError("encrypted PDF files need another parser")
    objects = {int(m[1]): m[3] for m in OBJECT.finditer(content)}
    for body in list(objects.values()):  # objects within object streams
        if b"/ObjStm" in body and (data := _data(body)) is not None:
            first, n = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
            head = list(map(int, data[:first].split()))[: 2 * n]
            ends = [*head[3::2], len(data) - first]
            objects |= {i: data[first + a : first + b] for i, a, b in zip(head[::2], head[1::2], ends)}
    found = []
    for _, body in sorted(objects.items()):
        if re.search(rb"/Type\s*/Page\b", body):
            names = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            streams = [_data(objects[int(i)]) for i in re.findall(rb"(\d+)\s+\d+\s+R", names[1] if names else b"") if int(i) in objects]
            found.append(_shown(b"\n".join(s for s in streams if s)))
    if not found:
        raise ValueError("no pages")
    return found


def _data(body: bytes) -> bytes | None:
    m = STREAM.search(body)
    return None if m is None else zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body else m[1]
