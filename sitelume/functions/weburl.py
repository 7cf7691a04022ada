"""Parsing of one URL as browsers do, in plain Python: what the SQL fast path of `urls` leaves over."""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote

# Schemes with a host, and their default ports.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*(?=:)")
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_DOTS = {".": ".", "%2e": ".", "..": "..", ".%2e": "..", "%2e.": "..", "%2e%2e": ".."}


class Parts(NamedTuple):
    href: str
    scheme: str
    host: str
    port: str
    path: str
    query: str
    fragment: str


def parse(raw: str | None, base: str | None = None) -> Parts | None:
    """The parts of an absolute URL, or of one relative to `base`; None if it is invalid. A bare ? or # is kept in href alone."""
    if raw is None:
        return None
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    found = _SCHEME.match(text)
    scheme = found[0].lower() if found else ""
    start = _base(base) if base and not (scheme and scheme not in PORTS) else None
    rest = text[len(scheme) + 1 :] if scheme else text
    if scheme and scheme not in PORTS:
        return _opaque(scheme, rest)
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    fragment, query = hash_ + fragment, mark + query
    rest = rest.replace("\\", "/")
    if scheme and not (start and start.scheme == scheme and not rest.startswith("/")):
        where = rest.lstrip("/")  # any number of slashes leads to the host
    elif start is None or start.scheme not in PORTS:
        return None
    elif rest.startswith("//"):
        scheme, where = start.scheme, rest[2:]
    else:
        path = rest if rest.startswith("/") else start.path.rpartition("/")[0] + "/" + rest if rest else start.path
        query = query if mark or rest else start.query
        return _join(start.scheme, start.host, start.port, path, query, fragment)
    place, slash, path = where.partition("/")
    place = place.rpartition("@")[2]
    name, port = re.fullmatch(r"(\[.*\]|[^:]*)(?::(.*))?", place, re.S).groups() if place.count(":") < 2 or "[" in place else (None, None)
    host = _host(name) if name else None
    if host is None or (port and not (port.isascii() and port.isdigit() and int(port) < 65_536)):
        return None
    port = str(int(port)) if port else ""
    return _join(scheme, host, "" if port == PORTS[scheme] else port, slash + path, query, fragment)


@lru_cache(maxsize=64)
def _base(url: str) -> Parts | None:
    """The parts of a base; the links of a page share one."""
    return parse(url)


def _opaque(scheme: str, rest: str) -> Parts | None:
    rest, mark, fragment = rest.partition("#")
    path, ask, query = rest.partition("?")
    host = ""
    if path.startswith("//"):
        host, slash, path = path[2:].partition("/")
        path = slash + path
        if _BAD_HOST.search(host.rpartition("@")[2].partition(":")[0]):
            return None
    href = f"{scheme}:{'//' + host if host else ''}{path}{ask}{query}{mark}{fragment}"
    return Parts(href, scheme, host, "", path, ask + query if query else "", mark + fragment if fragment else "")


def _host(name: str) -> str | None:
    """The host in lower case and punycode, addresses in their usual form; None if it can't be one."""
    if name.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(name[1:-1])}]" if name.endswith("]") and "%" not in name else None
        except ValueError:
            return None
    try:
        if "%" in name:
            name = bytes(int(m[1:], 16) if len(m) == 3 else ord(m) for m in re.findall(r"%[0-9a-fA-F]{2}|[\x00-\x7f]", name)).decode()
        name = name.lower() if name.isascii() else name.encode("idna").decode().lower()
    except (ValueError, UnicodeError):
        return None
    if not name or _BAD_HOST.search(name):
        return None
    labels = name.removesuffix(".").split(".")
    if re.fullmatch(r"\d+|0x[0-9a-f]*", labels[-1]):
        return _ipv4(labels)
    return name


def _ipv4(labels: list[str]) -> str | None:
    """Dotted form of an address of one to four numbers, decimal, octal or hexadecimal; the last fills what is left."""
    try:
        numbers = [int(x[2:] or "0", 16) if x.startswith("0x") else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x) for x in labels]
    except ValueError:
        return None
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _join(scheme: str, host: str, port: str, path: str, query: str, fragment: str) -> Parts:
    out: list[str] = []
    pieces = path.split("/")[1:] if path.startswith("/") else path.split("/")
    for k, piece in enumerate(pieces):
        dots = _DOTS.get(piece.lower())
        if dots == "..":
            del out[-1:]
        if dots and k == len(pieces) - 1:
            out.append("")
        elif not dots:
            out.append(piece)
    path = "/" + quote("/".join(out), "%/:=&~+!$,;'@()*[]|")
    query = query[:1] + quote(query[1:], "%/:=&?~+!$,;@()*[]|{}^`\\")
    fragment = fragment[:1] + quote(fragment[1:], "%/:=&?~#+!$,;'@()*[]|{}^\\")
    href = f"{scheme}://{host}{':' + port if port else ''}{path}{query}{fragment}"
    return Parts(href, scheme, host, port, path, query if query != "?" else "", fragment if fragment != "#" else "")
