"""Problem 4: credentials embedded in source code, found and redacted.

A text is scanned for credentials by form (issuer prefixes, private keys, addresses,
headers, connection strings) and by place (a value given to a name that stands for a
secret). Literals put together by the code are joined first. Encoded literals are
decoded (base64, hex, percent, escapes, character references) until nothing decodes, and
every layer is scanned by all the rules again; decoded bytes are also read as key
containers by their binary grammar. A find inside a layer redacts the whole enclosing
literal. Every layer is shorter than the one around it, so the decoding ends.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.session import spread

MASK = "REDACTED"

# Forms of tokens by issuer.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[\w-]{20}|xox[abeprs]-[\w-]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w-]{33,39}|[sr]k_live_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{36}"
    r"|SG\.[\w-]{20,24}\.[\w-]{40,45}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|hf_[A-Za-z]{34}|pypi-[\w-]{40,}|dop_v1_[0-9a-f]{64}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|sk-(?:ant-|proj-)?[\w-]{32,}|ya29\.[\w-]{30,}|hvs\.[\w-]{24,}|key-[0-9a-f]{32}|AGE-SECRET-KEY-1[A-Z0-9]{50,})(?![A-Za-z0-9])"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_BREAK = re.compile(r"\\n|\n")
KEY_TEXT = re.compile(r"(?:[A-Za-z0-9+/]{16,}+={0,2} ?)+")
KEY_TAIL = re.compile(r"[A-Za-z0-9+/]{1,15}={0,2}|=[A-Za-z0-9+/]{4}")
KEY_HEADER = re.compile(r"[A-Z][A-Za-z-]{1,20}: ")
ADDRESS = re.compile(r"(?<![a-zA-Z0-9+.\-])[a-zA-Z][a-zA-Z0-9+.\-]*+://([^\s:@/\"'`<>]*):([^\s@\"'`/]+)@[\w\[\-.${]")
HEADER = re.compile(r"\b(Basic|Bearer|Token|ApiKey)\s+([A-Za-z0-9+/=_.~\-]{8,})", re.I)
KEYED = re.compile(r"(?<![\w$])(?:--?)?(pass(?:word|wd|phrase)?|pwd|secret|(?:access|auth|api|deploy|bot)?[-_]?token|(?:api|access|secret|account|shared)[-_ ]?(?:access)?[-_ ]?key)\s*[=:]\s*([^\s;\"'`,&<>]+)", re.I)
OPTION = re.compile(r"(?<!\S)(?:--?)(?:password|passwd|pass|token|secret|api-key|apikey|auth-token)[= ]+[\"']?([^\s\"'`;]+)", re.I)
CURL = re.compile(r"\s(?:-u|--user)[= ]*[\"']?([\w.@-]+):([^\s\"'`]+)")
LOGIN = re.compile(r"\b(?:login|credentials?|user(?:name)?|account|log in with|passwords?)\b[^\n:=]{0,20}[:=]?\s+[\w.@-]+\s*(?:/|\||:| with | pw | password )\s*([^\s,;\"'`]+)", re.I)
PHRASE = re.compile(r"\b(?:token|passw(?:or)?d|passphrase|pass|secret|(?:api |access )?key|pwd?|credentials?)(?:\s+(?:is|was|now|for \w+(?: is)?))?\s+[\"'`(]?([^\s\"'`,;()]{6,})", re.I)
IDENTIFIED = re.compile(r"\bIDENTIFIED\s+BY\s+'([^']+)'", re.I)
ELEMENT = re.compile(r"<(\w*(?:password|passwd|secret|token|api[_-]?key)\w*)>([^<>\s]+)</\1>", re.I)
ASSIGNED = re.compile(
    r"(?<![\w.\-$])([A-Za-z_$][\w.\-$]*+)[\"'\])]*+\s*+(?::\s*[A-Za-z_][\w<>\[\].|]*\s*=(?!=)|:=|=>|=(?![=~>])|:(?![:/]))\s*(?:[brufBRUF@]{0,2}(\"\"\"|\"|'''|'|`)((?:\\.|(?!\2)[^\\\n])*)|([^\s\"'`{}()\[\]]+))"
)
CHAIN = re.compile(r"([\"'])((?:\\.|(?!\1)[^\\\n])*)\1(?:\s*(?:\+|\.\.?(?=\s*[\"'])|<<|,|\\)?\s*([\"'])((?:\\.|(?!\3)[^\\\n])*)\3)+")
PIECE = re.compile(r"([\"'])((?:\\.|(?!\1)[^\\\n])*)\1")
UNLISTED = re.compile(CHAIN.pattern.replace("|,|", "|"))
QUOTE = re.compile("[\"']")
JOIN = re.compile(r"[\s\])]*\)?\s*\.?\s*join|\]?\s*\.join")
JOINED = re.compile(r"\bjoin\s*\(\s*(?:[\"'][^\"'\n]{0,8}[\"']\s*,\s*)?[\[(]?\s*$|\bjoin\s*\(\s*$")
LITERAL = re.compile(r"(?<![A-Za-z0-9+/=_%\\-])(?:[A-Za-z0-9+/_-]{24,}={0,2}|(?:%[0-9A-Fa-f]{2}|[\w.~:/@-]){8,}|(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[0-3][0-7]{2}|&#\w{1,6};|[\w.~:/@-]){4,})(?![A-Za-z0-9+/=])")
ENCODED = re.compile(r"%[0-9A-Fa-f]{2}|\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-3][0-7]{2})|&#(?:\d|[xX][0-9A-Fa-f])|\\[nr/]")
WRAPPED = re.compile(r"[ \t\"'>*#]*([A-Za-z0-9+/_-]{40,}={0,2})[ \t\"',+\\]*")
# what a line with a credential holds at least one of, in lower case
HINTS = tuple(x.encode() for x in r"pass pw secret token key auth bearer login credential :// private gho_ ghp_ ghu_ ghs_ ghr_ github_pat glpat- xox akia asia aiza k_live_ npm_ sg. eyj hf_ pypi- dop_v1 shp sk- ya29 hvs. curl \x \u0 &#".split()) + (b"basic ", b"identified by")
HINT_FORMS = re.compile(rb"[\"']\s*\+\s*[\"'a-z]|[\"']\s*(?:\.\.?|<<|,|\\)?\s*[\"']|%[0-9a-f]{2}|\\[0-3][0-7]{2}|(?<![a-z0-9+/_-])[a-z0-9+/_-]{24}")
CONTROL = bytes([*range(9), *range(14, 32), 127])
RUN = re.compile(rb"[\x20-\x7e\r\n\t]{8,}")

SECRET_WORDS = frozenset("password passwd pwd pass passphrase pw secret token apikey credential credentials bearer authtoken accesstoken".split())
KEY_WORDS = frozenset("api access secret session signing private encryption master auth account storage deploy service shared hmac license x".split())
# words that end a name which speaks about a secret instead of holding one
ABOUT = frozenset("label hint title name field file path url uri type length len count size expiry ttl header prompt message msg policy bucket buckets text help description placeholder error required regex pattern reset form input column id ids var env count limit rotation age days format scheme kind class".split())
DIGEST_WORDS = frozenset("digest checksum sha sha1 sha256 sha512 md5 etag integrity hash commit rev revision uuid guid trace fingerprint public cert certificate verify template icon".split())
PLACEHOLDER = re.compile(
    r"^(?:x+|X+|\*+|\.+|-+|_+|0+|#+|\?+)$|^[<\[{(%$#].*[>\]})%]$|^\$\{?\w|^%\w+%$|\{\{|\$\{|\$\(|<%|#\{|^@\w+@$|your[-_ ]?|change[-_ ]?me|replace|example|sample|dummy|placeholder|redacted|insert|todo|fixme|^(?:test|none|null|nil|undefined|true|false|default|secret|password|passwd|token|empty|string|changeit|admin|root|user|guest|foo|bar|foobar|unset|hidden|masked|removed)$|X{6,}|x{6,}|\*{4,}|0{12,}|1234567890|abcdef0123",
    re.I,
)
LOOKUP = re.compile(r"environ|getenv|process\.env|\bENV\b|env\(|config\.|settings\.|secrets?\.|vault|params|ssm|keyring|getpass|prompt|input\(", re.I)
CONFIG = frozenset("env yaml yml properties toml ini cfg conf json xml tf sh bash dockerfile".split())


def words_in(name: str) -> list[str]:
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    out = [w for w in re.split(r"[^a-z]+", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s).lower()) if w]
    while len(out) > 1 and out[-1] in ("v", "main", "new", "old", "tmp", "prod", "dev", "staging"):
        out.pop()
    return out


@lru_cache(maxsize=65536)
def names_secret(name: str) -> bool:
    """Does a value under this name pass for a secret?"""
    w = words_in(name)
    if not w or w[-1] in ABOUT or set(w) & DIGEST_WORDS:
        return False
    if set(w) & SECRET_WORDS and w[-1] not in ("key",) or w[-1] in ("apikey", "accesskey", "secretkey", "privatekey"):
        return w[-1] in SECRET_WORDS or w[-1] in ("key", "value", "default", "hash") or "secret" in w and "key" in w
    return w[-1] == "key" and bool(set(w[:-1]) & KEY_WORDS)


def live(value: str) -> bool:
    """Does a value look like a real secret, not a placeholder, lookup, mask or plain word?"""
    v = value.strip()
    if len(v) < 6 or re.search(r"\s", v) or PLACEHOLDER.search(v) or LOOKUP.search(v):
        return False
    if len(set(v)) < 5 or re.fullmatch(r"[\d.,:/-]+", v) or re.match(r"https?://|/(?=[a-z._-]+(?:/|$))|\./|arn:", v) or re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v, re.I):
        return False
    if re.search(r"BEGIN (?:PUBLIC|CERT|RSA PUBLIC)", v):
        return False
    if re.search(r"\d", v) or re.search(r"[!@#$%^&*+?~=]", v):
        return not re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+\d?|[a-z_]+\d{0,2}\(.*|[A-Za-z]+_[A-Z_]+", v)
    return len(v) >= 10 and len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", v)) >= 4


def issued(value: str) -> bool:
    body = re.sub(r"^[A-Za-z]+[_-]", "", value)
    return len(set(body)) >= 7 and not re.search(r"(.)\1{5}|EXAMPLE|example|xxxx|XXXX|0{8}|123456789", value)


# --- key containers --------------------------------------------------------------------


def _tlv(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the DER element at ``at``."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(b):
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= len(b) else None


def _strings(b: bytes, at: int, n: int) -> int | None:
    """Where ``n`` length-prefixed strings from ``at`` end."""
    for _ in range(n):
        if at + 4 > len(b):
            return None
        at += 4 + int.from_bytes(b[at : at + 4], "big")
    return at if at <= len(b) else None


def _openssh(b: bytes) -> bool:
    """magic, cipher, key derivation, its options, number of keys, public keys, private section."""
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic) or (at := _strings(b, len(magic), 3)) is None or at + 4 > len(b):
        return False
    keys = int.from_bytes(b[at : at + 4], "big")
    if not 1 <= keys <= len(b) // 4 or (private := _strings(b, at + 4, keys)) is None or (end := _strings(b, private, 1)) is None:
        return False
    return end - private - 4 >= 16 and (end - private - 4) % 8 == 0 and len(b) - end < 3


def _openpgp(b: bytes) -> bool:
    """A first packet that holds a secret key: tag 5, its length, a known version and algorithm."""
    if len(b) < 40 or not b[0] & 0x80:
        return False
    if b[0] & 0x40:
        if b[0] & 0x3F != 5:
            return False
        n, at = (b[1], 2) if b[1] < 192 else (((b[1] - 192) << 8) + b[2] + 192, 3) if b[1] < 224 else (int.from_bytes(b[2:6], "big"), 6) if b[1] == 255 else (0, 2)
    else:
        if b[0] >> 2 & 0x0F != 5 or b[0] & 3 == 3:
            return False
        k = 1 << (b[0] & 3)
        n, at = int.from_bytes(b[1 : 1 + k], "big"), 1 + k
    return 40 <= n <= len(b) - at and b[at] in (3, 4, 5, 6) and b[at + 5] in (1, 2, 3, 16, 17, 18, 19, 22, 25, 26, 27, 28)


def _pkcs12(b: bytes, second: tuple[int, int, int], end: int) -> bool:
    """Version 3 goes before: content type (data or signed data) with explicit content, then perhaps a checksum."""
    oid = _tlv(b, second[1])
    if not oid or oid[0] != 0x06 or b[oid[1] : oid[2]] not in (bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702")):
        return False
    content = _tlv(b, oid[2])
    if not content or content[0] != 0xA0 or content[2] > second[2]:
        return False
    return second[2] == end or bool(mac := _tlv(b, second[2])) and mac[0] == 0x30


def private_container(b: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1, PKCS#12, OpenSSH or OpenPGP secret key, read by its grammar."""
    if _openssh(b) or _openpgp(b):
        return True
    whole = _tlv(b, 0)
    if not whole or whole[0] != 0x30 or whole[2] < len(b) - 2 or whole[2] - whole[1] < 24:
        return False
    first = _tlv(b, whole[1])
    if not first:
        return False
    second = _tlv(b, first[2])
    if not second:
        return False
    if first[0] == 0x02 and first[2] - first[1] == 1:
        version = b[first[1]]
        if second[0] == 0x30:  # PKCS#8: version, algorithm, key; PKCS#12: version 3, content
            third = _tlv(b, second[2])
            return version in (0, 1) and bool(third) and third[0] == 0x04 or version == 3 and _pkcs12(b, second, whole[2])
        if second[0] == 0x04:  # SEC1: version 1, private key
            return version == 1
        if second[0] == 0x02:  # PKCS#1: version 0, nine integers in all
            n, at = 2, second[2]
            while at < whole[2] and (x := _tlv(b, at)) and x[0] == 0x02:
                n, at = n + 1, x[2]
            return version in (0, 1) and n >= 6
    if first[0] == 0x30 and second[0] == 0x04:  # encrypted PKCS#8: algorithm with parameters, data
        oid = _tlv(b, first[1])
        return bool(oid) and oid[0] == 0x06 and b[oid[1] : oid[2]].startswith(bytes.fromhex("2a864886f70d01"))
    return False


def _unescaped(m: re.Match) -> str:
    return chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8))


def layers(literal: str) -> Iterator[bytes]:
    """What a literal may decode to, one layer down; each is shorter than the literal.

    A sign that is itself encoded many times over counts as one layer.
    """
    s = literal
    if "%" in s and re.search(r"%[0-9A-Fa-f]{2}", s):
        yield unquote_to_bytes(re.sub(r"%(?:25)+(?=[0-9A-Fa-f]{2})", "%", s))
    if "\\" in s and re.search(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-3][0-7]{2})", s):
        yield re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([0-3][0-7]{2}))", _unescaped, re.sub(r"\\(?:x5[cC])+(?=[xu0-3])", r"\\", s)).encode("utf-8", "replace")
    if "&#" in s and (text := html.unescape(re.sub(r"&(?:#38;|#x26;|amp;)+(?=#)", "&", s))) != s:
        yield text.encode("utf-8", "replace")
    plain = re.sub(r"\\[nr]|\s", "", s).replace("\\/", "/")
    if len(plain) >= 24 and len(plain) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", plain):
        yield bytes.fromhex(plain)
    elif len(plain) >= 20 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", plain) and len(plain.rstrip("=")) % 4 != 1:
        try:
            yield base64.b64decode(plain.replace("-", "+").replace("_", "/").rstrip("=") + "=" * (-len(plain.rstrip("=")) % 4))
        except (ValueError, binascii.Error):
            pass


def _readable(b: bytes) -> str | None:
    """The text of bytes without control characters, in UTF-8 or UTF-16."""
    if len(b.translate(None, CONTROL)) == len(b):
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            return None
    for kind, zeros in (("utf-16-le", b[1::2]), ("utf-16-be", b[::2])):
        if len(b) >= 12 and len(b) % 2 == 0 and zeros.count(0) * 10 >= len(zeros) * 9:
            try:
                text = b.decode(kind)
            except UnicodeDecodeError:
                return None
            return text if not re.search(r"[\0-\x08\x0e-\x1f]", text) else None
    return None


def _by_form(text: str) -> bool:
    """Does a piece of text hold a token, a private key or an address with a password?"""
    return any(issued(m[0]) for m in ISSUED.finditer(text)) or bool(PRIVATE.search(text)) or any(not PLACEHOLDER.search(m[2]) and len(m[2]) >= 6 for m in ADDRESS.finditer(text))


def hides_secret(literal: str) -> bool:
    """Does any layer of an encoded literal hold a credential by any rule, or a key container?"""
    seen, known, todo = {literal}, {literal}, [literal]
    while todo:
        for b in layers(todo.pop()):
            if private_container(b):
                return True
            text = _readable(b)
            if text is None:
                if any(_by_form(m[0].decode("ascii")) for m in RUN.finditer(b)):
                    return True
                continue
            if text in seen:
                continue
            seen.add(text)
            if next(_scan(text, True, False), None):
                return True
            for inner in (*(m[0] for m in LITERAL.finditer(text)), *(m[2] for m in PIECE.finditer(text) if ENCODED.search(m[2]))):
                if inner not in known:
                    known.add(inner)
                    todo.append(inner)
    return False


# --- scan ------------------------------------------------------------------------------


def _plain(s: str, bare: bool) -> Iterator[tuple[int, int]]:
    """Spans of credentials in a piece of text, encodings aside; ``bare``: unquoted values count."""
    for m in ISSUED.finditer(s):
        if issued(m[0]):
            yield m.span()
    if "://" in s:
        for m in ADDRESS.finditer(s):
            if not PLACEHOLDER.search(m[2]) and m[2].lower() not in ("pass", "pw") and len(m[2]) >= 4 and not re.search(r"[{}$<>]", m[2]):
                yield m.span(2)
    for m in HEADER.finditer(s):
        if m[1].lower() == "basic":
            try:
                text = _readable(base64.b64decode(m[2].rstrip("=") + "=" * (-len(m[2].rstrip("=")) % 4), validate=True))
            except (ValueError, binascii.Error):
                text = None
            if text and ":" in text and len(text.split(":", 1)[1]) >= 4 and not PLACEHOLDER.search(text.split(":", 1)[1]):
                yield m.span(2)
        elif len(m[2]) >= 16 and live(m[2]) and (m[1].lower() == "bearer" or re.search(r"auth", s, re.I)):
            yield m.span(2)
    quotes = {q: 0 for q in "\"'`"}
    counted = 0
    for m in KEYED.finditer(s):
        if not bare:
            for q in quotes:
                quotes[q] += s.count(q, counted, m.start())
            counted = m.start()
        if live(m[2].rstrip(")]}.,\"'")) and (bare or any(n % 2 for n in quotes.values())):
            if not re.match(r"[A-Za-z_][\w.]*\(", m[2]):
                yield m.start(2), m.start(2) + len(m[2].rstrip(")]}.,\"'"))
    for rx, g in ((OPTION, 1), (CURL, 2), (IDENTIFIED, 1), (ELEMENT, 2)):
        for m in rx.finditer(s):
            if live(m[g]):
                yield m.span(g)


def _comment(line: str) -> int:
    """Where a comment starts in a line, or -1."""
    m = re.search(r"(?:^|(?<=\s))(?://|#|/?\*|--|<!--|;)(?=\s|$|\w)", line)
    return m.start() if m else -1


def _key_body(text: str, at: int, begin: str) -> str:
    """The text of a private key after its BEGIN line: up to its END line, else as far as it reads as a key."""
    stop = text.find(begin.replace("BEGIN", "END", 1), at)
    other = text.find("-----BEGIN", at, stop if stop >= 0 else len(text))
    if stop >= 0 and other < 0:
        return text[at:stop]
    limit = other if other >= 0 else len(text)
    ended = text.find("-----END", at, limit)
    if ended >= 0:
        return text[at:ended]
    # no END line: lines of key text, bare or in literals, with headers and blank lines between
    last, spot, full = at, at, False
    while spot < limit:
        cut = KEY_BREAK.search(text, spot, limit)
        end = cut.start() if cut else limit
        line = text[spot:end].strip(" \t\r\"'`+.,;()#*<>|\\")
        if KEY_TEXT.fullmatch(line) or full and KEY_TAIL.fullmatch(line):
            last = end
        elif first := KEY_TEXT.match(line) if len(line) >= 40 else None:  # key text, then other text on its line
            last = text.find(first[0], spot) + len(first[0])
            break
        elif line and not KEY_HEADER.match(line):
            break
        full = bool(line) and len(line) >= 40
        spot = cut.end() if cut else limit
    return text[at:last]


def _chains(text: str, start: int, end: int, seen: list[int]) -> Iterator[re.Match]:
    """The chains of literals that begin on a line, each followed to its end.

    ``seen``: the ends of the last chain, of the last list that no join follows and of the
    last block of encoded lines, so that a long one is read once and not again from each
    of its lines.
    """
    at = max(start, seen[0])
    while q := QUOTE.search(text, at, end):
        at = q.end()
        for k, rx in enumerate((CHAIN, UNLISTED)):
            if k == 0 and q.start() < seen[1] or not (m := rx.match(text, q.start())):
                continue
            if k == 0 and "," in re.sub(PIECE, "", m[0]) and not JOIN.match(text, m.end(), m.end() + 20) and not JOINED.search(text, max(0, q.start() - 80), q.start()):
                seen[1] = m.end()
                continue
            at = seen[0] = m.end()
            yield m
            break


def _wrapped(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The block of lines of nothing but encoded text that begins on a line; none inside or below a key's BEGIN line."""
    if not WRAPPED.fullmatch(text, start, end):
        return None
    before = text[text.rfind("\n", 0, start - 1) + 1 : start] if start else ""
    if "-----BEGIN" in before or KEY_HEADER.match(before.strip()) or WRAPPED.fullmatch(before.rstrip("\r\n")):
        return None
    last = end
    while last < len(text):
        to = text.find("\n", last + 1)
        to = len(text) if to < 0 else to
        line = text[last + 1 : to].strip(" \t\r\"',+\\>*#")
        if not line or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", line):
            break
        last = to
        if len(line) < 40:
            break
    return (start, last) if last > end else None


def _line(text: str, start: int, end: int, config: bool | None, seen: list[int], deep: bool) -> Iterator[tuple[int, int]]:
    """Spans of the credentials that begin on one line of a text; ``deep``: encoded literals are decoded."""
    s = text[start:end]
    at = _comment(s)
    bare_from = 0 if config else at if at >= 0 else len(s)
    for a, b in _plain(s, config is not False or at >= 0 and not s[:at].strip()):
        yield start + a, start + b
    if at >= 0 or config:
        for m in LOGIN.finditer(s, max(at, 0)):
            if live(m[1]):
                yield start + m.start(1), start + m.end(1)
    if at >= 0:
        for m in PHRASE.finditer(s, at):
            value = m[1].rstrip(".:!?")
            if re.search(r"\d", value) and live(value) and (not value.isalnum() or len(value) >= 10 and value.lower() != value != value.upper()) or ISSUED.fullmatch(value) or re.fullmatch(r"[0-9a-f]{32,}", value):
                yield start + m.start(1), start + m.start(1) + len(value)
    for m in ASSIGNED.finditer(s):
        if not names_secret(m[1]):
            continue
        if m[2]:
            value, a = m[3], m.start(3)
            if value and live(value):
                yield start + a, start + a + len(value)
        elif m[4] and (m.start(4) >= bare_from or config is None and re.search(r"[!#$%^*+?@-]|\d[a-f]", m[4])):
            value = m[4].rstrip(",;")
            named = re.search(r"^[A-Za-z_]\w*\.[A-Za-z_]|^[A-Za-z_]\w*$(?<!\d)", value)
            if live(value) and (not named or config and len(value) >= 16 and re.search(r"\d", value) and "_" not in value and "." not in value):
                yield start + m.start(4), start + m.start(4) + len(value)
    for m in PRIVATE.finditer(s):
        body = _key_body(text, start + m.end(), m[0])
        if sum(map(len, re.findall(r"[A-Za-z0-9+/=]{16,}", re.sub(r"\\n", "\n", body)))) >= 40 and not re.search(r"x{12}|X{12}|\.\.\.|<", body):
            yield start + m.start(), start + m.end() + len(body)
    named = None
    for m in _chains(text, start, end, seen) if '"' in s or "'" in s else ():
        pieces = list(PIECE.finditer(m[0]))
        if len(pieces) > 1:
            joined = "".join(p[2] for p in pieces)
            named = named or ASSIGNED.search(s) or 0
            if any(True for _ in _plain(joined, False)) or deep and hides_secret(joined) or named and names_secret(named[1]) and live(joined):
                yield m.start(), m.end()
    if not deep or start < seen[2]:
        return
    if (block := _wrapped(text, start, end)) and hides_secret("".join(re.findall(r"[A-Za-z0-9+/_=-]+", text[block[0] : block[1]]))):
        seen[2] = block[1]
        yield block
        return
    for m in LITERAL.finditer(s):
        if hides_secret(m[0]):
            yield start + m.start(), start + m.end()
    if ENCODED.search(s):
        for m in PIECE.finditer(s):
            if ENCODED.search(m[2]) and hides_secret(m[2]):
                yield start + m.start(2), start + m.end(2)


def _hinted(text: str) -> Iterator[tuple[int, int]]:
    """The lines, in order, that hold a hint of a credential."""
    # one byte a character, so that offsets are those of the text
    b = text.encode("ascii", "replace").lower()
    starts: set[int] = set()

    def take(at: int) -> int:
        starts.add(b.rfind(b"\n", 0, at) + 1)
        end = b.find(b"\n", at)
        return len(b) if end < 0 else end + 1

    for hint in HINTS:
        at = b.find(hint)
        while at >= 0:
            at = b.find(hint, take(at))
    at = 0
    while m := HINT_FORMS.search(b, at):
        at = take(m.start())
    for start in sorted(starts):
        end = b.find(b"\n", start)
        yield start, len(b) if end < 0 else end


def _scan(text: str, config: bool | None, deep: bool) -> Iterator[tuple[int, int]]:
    seen = [0, 0, 0]
    for start, end in _hinted(text):
        yield from _line(text, start, end, config, seen, deep)


def spans(text: str, ext: str | None) -> list[tuple[int, int]]:
    """Sorted spans of all credentials; ``ext`` tells configuration from code, None: unknown."""
    return sorted(set(_scan(text, None if ext is None else ext in CONFIG, True)))


@lru_cache(maxsize=50_000)
def _snippet_lines(text: str) -> tuple[int, ...]:
    return tuple(sorted({text.count("\n", 0, a) + 1 for a, _ in spans(text, None)}))


def lines_of(text: str, ext: str | None) -> tuple[int, ...]:
    if ext is None and len(text) < 2000:
        return _snippet_lines(text)
    return tuple(sorted({text.count("\n", 0, a) + 1 for a, _ in spans(text, ext)}))


def redact(text: str, ext: str | None) -> str:
    """The text without its credentials; quotes, line ends and all else stay."""
    out, at = [], 0
    for a, b in spans(text, ext):
        if b <= at:
            continue
        a = max(a, at)
        secret = text[a:b]
        out.append(text[at:a])
        if secret.startswith("-----BEGIN"):
            head = secret.find("-----", 11) + 5
            out.append(secret[:head] + re.sub(r"[A-Za-z0-9+/=]{16,}", MASK, secret[head:]))
        elif "\n" in secret and WRAPPED.match(secret):
            out.append(re.sub(r"[A-Za-z0-9+/_-]+={0,2}", MASK, secret))
        elif PIECE.match(secret):
            first = [True]
            out.append(PIECE.sub(lambda m: m[1] + (MASK if first.pop() else "") + m[1] if first else m[1] * 2, secret))
        else:
            out.append(MASK)
        at = b
    return "".join(out) + text[at:]


def _ext(path: str | None) -> str:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else name


def _each(df: DataFrame, kinds: str, row) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [x for key, path, text in f.itertuples(index=False) if text for x in row(key, path, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kinds.split(", ")])

    return spread(df).mapInPandas(run, kinds)


def _sources(files: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.select(F.col("file_id").cast("bigint"), "path", "content"), findings.select(F.col("finding_key").cast("bigint"), F.lit(None).cast("string").alias("path"), "evidence_snippet")


def credential_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``src_table, row_key, line_no`` of each line on which a credential begins.

    Null and empty texts give no row; several credentials on a line give one row;
    repeated texts are each reported under their own key.
    """
    a, b = _sources(files, findings)
    kinds = "row_key bigint, line_no bigint"
    in_files = _each(a, kinds, lambda key, path, text: [(key, n) for n in lines_of(text, _ext(path))])
    in_findings = _each(b, kinds, lambda key, path, text: [(key, n) for n in lines_of(text, None)])
    return in_files.select(F.lit("scan_files").alias("src_table"), "row_key", "line_no").unionByName(in_findings.select(F.lit("findings").alias("src_table"), "row_key", "line_no"))


def redacted(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``src_table, row_key, text`` of every text that held a credential, without it."""
    a, b = _sources(files, findings)
    kinds = "row_key bigint, text string"
    in_files = _each(a, kinds, lambda key, path, text: [(key, r)] if (r := redact(text, _ext(path))) != text else [])
    in_findings = _each(b, kinds, lambda key, path, text: [(key, r)] if (r := redact(text, None)) != text else [])
    return in_files.select(F.lit("scan_files").alias("src_table"), "row_key", "text").unionByName(in_findings.select(F.lit("findings").alias("src_table"), "row_key", "text"))
