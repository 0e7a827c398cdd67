"""Writes small class files and archives: input for scans where no compiler is at hand."""

from __future__ import annotations

import io
import struct
import zipfile

from .classes import CLASS, FIELD, HANDLE, INVOKE_DYNAMIC, METHOD, NAME_TYPE, UTF8

#: Major version of class files that all runtimes since Java 8 read.
MAJOR = 52


class ClassWriter:
    """Collects constants and members; ``bytes()`` is the class file. Code is given as opcodes and operands."""

    def __init__(self, name: str, superclass: str = "java/lang/Object", interfaces: tuple[str, ...] = (), flags: int = 0x21, signature: str | None = None):
        self._pool: dict[tuple, int] = {}
        self._constants = b""
        self._members: tuple[list[bytes], list[bytes]] = ([], [])
        self._bootstraps: list[bytes] = []
        self._head = struct.pack(">HHH", flags, self.type(name), self.type(superclass))
        self._head += struct.pack(">H", len(interfaces)) + b"".join(struct.pack(">H", self.type(i)) for i in interfaces)
        self._attributes = [self._attribute("Signature", struct.pack(">H", self.text(signature)))] if signature else []

    def _constant(self, tag: int, body: bytes) -> int:
        if (tag, body) not in self._pool:
            self._pool[tag, body] = len(self._pool) + 1
            self._constants += bytes([tag]) + body
        return self._pool[tag, body]

    def text(self, s: str) -> int:
        return self._constant(UTF8, struct.pack(">H", len(s.encode())) + s.encode())

    def type(self, name: str) -> int:
        return self._constant(CLASS, struct.pack(">H", self.text(name)))

    def _named(self, name: str, descriptor: str) -> int:
        return self._constant(NAME_TYPE, struct.pack(">HH", self.text(name), self.text(descriptor)))

    def field(self, owner: str, name: str, descriptor: str) -> int:
        return self._constant(FIELD, struct.pack(">HH", self.type(owner), self._named(name, descriptor)))

    def method(self, owner: str, name: str, descriptor: str) -> int:
        return self._constant(METHOD, struct.pack(">HH", self.type(owner), self._named(name, descriptor)))

    def handle(self, kind: int, ref: int) -> int:
        return self._constant(HANDLE, struct.pack(">BH", kind, ref))

    def dynamic(self, bootstrap: int, arguments: tuple[int, ...], name: str, descriptor: str) -> int:
        self._bootstraps.append(struct.pack(f">HH{len(arguments)}H", bootstrap, len(arguments), *arguments))
        return self._constant(INVOKE_DYNAMIC, struct.pack(">HH", len(self._bootstraps) - 1, self._named(name, descriptor)))

    def _attribute(self, name: str, body: bytes) -> bytes:
        return struct.pack(">HI", self.text(name), len(body)) + body

    def add_field(self, name: str, descriptor: str, flags: int = 0) -> None:
        self._members[0].append(struct.pack(">HHHH", flags, self.text(name), self.text(descriptor), 0))

    def add_method(self, name: str, descriptor: str, code: bytes | None = None, flags: int = 1, parameters: tuple[str, ...] = ()) -> None:
        attributes = []
        if code is not None:
            attributes.append(self._attribute("Code", struct.pack(">HHI", 8, 8, len(code)) + code + struct.pack(">HH", 0, 0)))
        if parameters:
            attributes.append(self._attribute("MethodParameters", bytes([len(parameters)]) + b"".join(struct.pack(">HH", self.text(p), 0) for p in parameters)))
        self._members[1].append(struct.pack(">HHHH", flags, self.text(name), self.text(descriptor), len(attributes)) + b"".join(attributes))

    def bytes(self) -> bytes:
        attributes = list(self._attributes)
        if self._bootstraps:
            attributes.append(self._attribute("BootstrapMethods", struct.pack(">H", len(self._bootstraps)) + b"".join(self._bootstraps)))
        fields, methods = (struct.pack(">H", len(m)) + b"".join(m) for m in self._members)
        body = self._head + fields + methods + struct.pack(">H", len(attributes)) + b"".join(attributes)
        return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, MAJOR, len(self._pool) + 1) + self._constants + body


def archive(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(entries):
            z.writestr(zipfile.ZipInfo(name), entries[name])
    return out.getvalue()
