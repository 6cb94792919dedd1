"""ARC, the archive format before WARC: writing, parsing by version, and conversion of its records to WARC.

An archive begins with a version block whose header line is a ``filedesc:`` URL
and whose body names the version and, in its second line, the fields of every
header line that follows. A record is a header line with those fields, parted by
blanks, the last one the length of the content behind it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

#: Fixed values of the format: the fields of a header line by version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:strandline:arc")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str  # YYYYMMDDhhmmss
    kind: str
    content: bytes
    fields: dict[str, str]


def write_arc(name: str, records: list[ArcRecord], version: int, origin: str = "strandline") -> bytes:
    """An archive; white space in a URL is percent-encoded, as blanks part the fields."""
    body = f"{version} 0 {origin}\n{' '.join(FIELDS[version])}\n".encode()
    out = [_line(version, f"filedesc://{name}", "0.0.0.0", "19960923142103", "text/plain", body), body]
    for r in records:
        url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), r.url or "-")
        out += [b"\n", _line(version, url, r.ip, r.date, r.kind, r.content), r.content]
    return b"".join(out) + b"\n"


def _line(version: int, url: str, ip: str, date: str, kind: str, content: bytes) -> bytes:
    more = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "-"}
    known = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Archive-length": str(len(content))}
    return (" ".join((more | known)[f] for f in FIELDS[version]) + "\n").encode()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, without its version block. Raises ValueError where header and content don't fit."""

    def take(at: int, fields: list[str]) -> tuple[dict[str, str], bytes, int]:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at {at}")
        # Only the URL may hold blanks, so the fields are counted from the right.
        values = data[at:end].decode("utf-8", "surrogateescape").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].strip().isdigit():
            raise ValueError(f"bad header line at {at}: {values[:2]}")
        size = int(values[-1])
        if end + 1 + size > len(data):
            raise ValueError(f"record at {at} declares {size} bytes, {len(data) - end - 1} are left")
        return dict(zip(fields, values)), data[end + 1 : end + 1 + size], end + 1 + size

    first = data[: max(0, data.find(b"\n"))]
    if not first.startswith(b"filedesc:"):
        raise ValueError("no version block")
    size = int(first.rsplit(b" ", 1)[1])
    block = data[len(first) + 1 : len(first) + 1 + size].decode("utf-8", "replace").split("\n")
    version = int(block[0].split()[0])
    if version not in FIELDS:
        raise ValueError(f"unknown version {version}")
    fields = block[1].split() if len(block) > 1 and block[1].split()[-1:] == ["Archive-length"] else FIELDS[version]
    at = len(first) + 1 + size
    while True:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        if at >= len(data):
            return
        values, content, at = take(at, fields)
        yield ArcRecord(values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], content, values)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def payload_of(content: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP message; anything else is all payload."""
    if content.startswith(b"HTTP/"):
        head, mark, payload = content.partition(b"\r\n\r\n")
        if mark:
            return head + mark, payload
    return b"", content


def record_id(url: str, date: str, digest: str, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url, date, digest, salt)))}>"


def to_warc(r: ArcRecord, salt: str = "", refers_to: str | None = None, extra: dict[str, str] | None = None, identifier: str | None = None) -> bytes:
    """The WARC record that says the same: identifier, timestamp, type and digests are made from the ARC record.

    With ``refers_to``, the id of a record with the same payload, it is a
    revisit: the payload is left out, its digest and the HTTP head stay.
    """
    head, payload = payload_of(r.content)
    d = r.date.ljust(14, "0")
    digest = sha1(payload)
    block = head if refers_to else r.content
    lines = {
        "WARC-Type": "revisit" if refers_to else "response" if head or r.kind == "text/dns" else "resource",
        "WARC-Record-ID": identifier or record_id(r.url, r.date, digest, salt),
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
    }
    if refers_to:
        lines |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": refers_to}
    lines |= (extra or {}) | {"Content-Type": "application/http; msgtype=response" if head else r.kind, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode("utf-8", "surrogateescape") + b"\r\n" + block


def warcinfo(first: bytes) -> bytes:
    """The record that a file whose first record is ``first`` begins with."""
    block = b"software: strandline\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    lines = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", "", sha1(first)), "WARC-Date": "1999-01-01T00:00:00Z", "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, by the declared lengths."""
    at = 0
    while True:
        while at < len(data) and data[at] in b"\r\n":
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"record at {at} declares {size} bytes, {len(data) - end - 4} are left")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size
