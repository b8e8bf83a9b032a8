"""Local paths, archives, checksums and downloads: work of the driver on one file at a time."""

from __future__ import annotations

import hashlib
import http.client
import ipaddress
import re
import socket
import ssl
import time
import zipfile
from pathlib import Path
from urllib.parse import unquote, urljoin, urlsplit, urlunsplit

from ..validate import InvalidArgument, need

SUFFIXES = (".csv", ".zip", ".parquet")
DEFAULT_BYTES, MOST_BYTES = 512 << 20, 10 << 30
DEFAULT_SECONDS, REDIRECTS = 120, 5


def inside(root: str | Path, path: str | Path) -> Path:
    """A path in a root, links resolved first; anything else is refused."""
    root, found = Path(root).resolve(strict=True), Path(path)
    found = (found if found.is_absolute() else root / found).resolve(strict=True)
    need(found.is_relative_to(root), "path: outside the data folder")
    return found


def inside_any(roots: list[Path], path: str | Path) -> Path:
    """A path in one of the roots that are there; anything else is refused."""
    need(bool(roots), "path: no import root is set")
    for root in roots:
        try:
            return inside(root, path)
        except (InvalidArgument, FileNotFoundError):
            continue
    raise InvalidArgument("path: not a file in an import root")


def mounted(place: str | Path) -> Path:
    """A path, or that of a file: URI; folders of other stores are refused."""
    if isinstance(place, Path) or "://" not in place and not place.startswith("file:"):
        return Path(place)
    parts = urlsplit(place)
    need(parts.scheme == "file" and parts.netloc in ("", "localhost"), "path: a mounted folder is needed")
    return Path(unquote(parts.path))


def sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify(actual: str, expected: str | None) -> None:
    if expected is not None:
        need(bool(re.fullmatch(r"[0-9a-fA-F]{64}", expected)), "checksum: 64 hex digits are needed")
        need(actual == expected.lower(), "checksum: the file has another one")


def unzip_csv(path: str | Path, folder: str | Path, entry: str | None = None, most: int = DEFAULT_BYTES) -> Path:
    """The one CSV file of an archive, or the named one, unpacked into folder. The size is checked before and while."""
    with zipfile.ZipFile(path) as z:
        found = [i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(".csv") and entry in (None, i.filename)]
        need(len(found) == 1, f"archive: {len(found)} CSV entries fit, one is needed")
        need(found[0].file_size <= most, "archive: the entry is too large")
        out, left = Path(folder) / Path(found[0].filename).name, most
        with z.open(found[0]) as src, open(out, "wb") as dst:
            while block := src.read(1 << 20):
                left -= len(block)
                if left < 0:
                    out.unlink()
                    raise InvalidArgument("archive: the entry is too large")
                dst.write(block)
    return out


def refused_address(ip: str) -> bool:
    """All but public unicast addresses."""
    address = ipaddress.ip_address(ip)
    address = getattr(address, "ipv4_mapped", None) or address
    return not address.is_global or address.is_multicast


def checked_url(url: str) -> str:
    parts = urlsplit(url)
    need(parts.scheme == "https" and bool(parts.hostname), "url: https is needed")
    need(parts.username is None and parts.password is None, "url: no credentials")
    need(Path(parts.path).suffix.lower() in SUFFIXES, f"url: one of {', '.join(SUFFIXES)}")
    return url


def audit_url(url: str) -> str:
    """Without query and fragment, for the records."""
    p = urlsplit(url)
    return urlunsplit((p.scheme, p.netloc, p.path, "", ""))


class _Pinned(http.client.HTTPSConnection):
    """Connects to an address that was checked, under the name that was asked for."""

    def __init__(self, host: str, address: str, port: int, timeout: float):
        super().__init__(host, port, timeout=timeout, context=ssl.create_default_context())
        self.address = address

    def connect(self) -> None:
        raw = socket.create_connection((self.address, self.port), self.timeout)
        self.sock = self._context.wrap_socket(raw, server_hostname=self.host)


def download(url: str, folder: str | Path, most: int = DEFAULT_BYTES, seconds: float = DEFAULT_SECONDS) -> Path:
    """A file over HTTPS. Every hop's URL and address are checked, and its name is looked up once."""
    end = time.monotonic() + seconds
    for _ in range(REDIRECTS + 1):
        parts = urlsplit(checked_url(url))
        port = parts.port or 443
        addresses = {a[4][0] for a in socket.getaddrinfo(parts.hostname, port, type=socket.SOCK_STREAM)}
        need(bool(addresses) and not any(map(refused_address, addresses)), "url: its host has an address that is not public")
        link = _Pinned(parts.hostname, sorted(addresses)[0], port, max(0.1, end - time.monotonic()))
        try:
            link.request("GET", urlunsplit(("", "", parts.path, parts.query, "")))
            answer = link.getresponse()
            if answer.status in (301, 302, 303, 307, 308):
                url = urljoin(url, answer.getheader("Location") or "")
                continue
            need(answer.status == 200, f"url: the server answered {answer.status}")
            need(int(answer.getheader("Content-Length") or 0) <= most, "url: the file is too large")
            out, left = Path(folder) / Path(parts.path).name, most
            with open(out, "wb") as f:
                while block := answer.read(1 << 20):
                    left -= len(block)
                    need(left >= 0, "url: the file is too large")
                    need(time.monotonic() < end, "url: it took too long")
                    f.write(block)
            return out
        finally:
            link.close()
    raise InvalidArgument("url: too many redirects")
