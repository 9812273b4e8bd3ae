"""PII: format-preserving Feistel pseudonyms.

Values are found by shape and kept only if they validate: card numbers by Luhn, account numbers
by mod 97, telephone numbers by their digits, IP addresses by their parts, social security numbers
by their blocks, dates by the calendar, mail addresses by their parts, secrets by length and
digits or by the prefix of their issuer. Where a run of digit groups or capitals is no number as a
whole, its parts between separators are tried, the longest first. A value becomes a number in the domain of its format, a keyed Feistel network permutes
the domain (numbers that leave it walk on until they are back in), and the result is written in
the same layout. The permutation of a format is one-to-one, so equal values stay equal in all
documents, however they are spaced, and different ones stay different. Dates that only make sense
month first have a permutation of their own, among dates that only make sense so: else two of
different order could get the same pseudonym.

Edge cases: a null text stays null; texts are read whole; a one-to-one map may leave one value of
a format's whole domain as it is; ties: of values that overlap the first counts, of those the longest; repeated rows give repeated results; an empty table gives no rows; columns other than
the text pass unread.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import map_arrow

ROUNDS = 8
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1
HEX = "0123456789abcdef"

#: Characters permuted as one number; numbers of any length would take quadratic time.
PIECE = 128


class Feistel:
    """Keyed permutations of [0, n) for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, r: int, half: int, below: int) -> int:
        """A keyed number below `below`, from twice as many bits as it needs."""
        need = (below.bit_length() + 7) // 8 + 8
        seed = tweak + bytes([r]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        out = b""
        while len(out) < need:
            out += hashlib.blake2b(seed + bytes([len(out) // 64]), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:need], "big") % below

    def permute(self, value: int, n: int, tweak: str) -> int:
        """The image of value under a one-to-one map; by chance, one value in n, it may be value itself."""
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        t = f"{tweak}/{n}".encode()
        out = value
        while True:
            left, right = divmod(out, a)
            for r in range(ROUNDS):
                left, right = right, (left + self._round(t, r, right, a)) % a
            out = left * a + right
            if out < n:
                return out

    def characters(self, text: str, alphabets: list[str], tweak: str) -> str:
        """Permutes a string whose k-th character is of the k-th alphabet, within those alphabets; of more than PIECE characters in even pieces, each with its place for a tweak."""
        if len(text) > PIECE:
            many = -(-len(text) // PIECE)
            ends = [len(text) * k // many for k in range(many + 1)]
            return "".join(self.characters(text[a:b], alphabets[a:b], f"{tweak}/{k}") for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)))
        n, value = 1, 0
        for c, alphabet in zip(text, alphabets, strict=True):
            value = value * len(alphabet) + alphabet.index(c)
            n *= len(alphabet)
        value = self.permute(value, n, tweak)
        out = []
        for alphabet in reversed(alphabets):
            value, k = divmod(value, len(alphabet))
            out.append(alphabet[k])
        return "".join(reversed(out))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)


@lru_cache(4096)
def alphabet_of(c: str) -> str:
    """The characters that may stand for c: of its kind, among 128 neighbours where it is not ASCII; itself if it is neither letter nor digit."""
    for known in (DIGITS, LOWER, UPPER, ACCENTED):
        if c in known:
            return known
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return c
    first = ord(c) // 128 * 128
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and x not in ACCENTED)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def relaid(layout: str, digits: str) -> str:
    """The layout with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in layout)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1


def card_spans(text: str) -> list[tuple[int, int]]:
    """Spans of card numbers in a run of digit groups: the run, or at each group the longest that validates and is grouped as cards are (by fours, 4-6-4, 4-6-5, or not at all)."""
    groups = [m.span() for m in GROUP.finditer(text)]
    if min(b - a for a, b in groups) > 1 and is_card(only_digits(text)):
        return [(0, len(text))]
    out, k = [], 0
    while k < len(groups):
        sizes, found = [], None
        for j in range(k, min(len(groups), k + 5)):
            sizes.append(groups[j][1] - groups[j][0])
            by_fours = set(sizes[:-1]) == {4} and sizes[-1] <= 4
            if (len(sizes) == 1 or by_fours or sizes in ([4, 6, 4], [4, 6, 5])) and is_card(only_digits(text[groups[k][0] : groups[j][1]])):
                found = j
        if found is not None:
            out.append((groups[k][0], groups[found][1]))
            k = found
        k += 1
    return out


def card(f: Feistel, text: str) -> str | None:
    d = only_digits(text)
    if not is_card(d):
        return None
    payload = f.characters(d[1:-1], [DIGITS] * (len(d) - 2), f"card{d[0]}")
    return relaid(text, d[0] + payload + luhn_digit(d[0] + payload))


def ssn(f: Feistel, text: str) -> str | None:
    area, group, serial = text.split("-")
    valid = lambda a, g, s: a not in ("000", "666") and a < "900" and g != "00" and s != "0000"
    if not valid(area, group, serial):
        return None
    out = text
    while True:
        d = f.characters(only_digits(out), [DIGITS] * 9, "ssn")
        out = f"{d[:3]}-{d[3:5]}-{d[5:]}"
        if valid(d[:3], d[3:5], d[5:]):
            return out


def phone(f: Feistel, text: str) -> str | None:
    d = only_digits(text)
    national = len(d) == 10 or len(d) == 11 and d[0] == "1"
    if national:
        head, body = d[:-10], d[-10:]
        if body[0] < "2":
            return None
        out = f.characters(body, [DIGITS] * 10, "phone")
        while out[0] < "2":
            out = f.characters(out, [DIGITS] * 10, "phone")
        return relaid(text, head + out)
    if text[0] != "+" or not 8 <= len(d) <= 15:
        return None
    return relaid(text, d[:2] + f.characters(d[2:], [DIGITS] * (len(d) - 2), "phone" + d[:2]))


def ipv4(f: Feistel, text: str) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
        return None
    n = f.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def date(f: Feistel, text: str, order: str, separator: str) -> str | None:
    parts = dict(zip(order, text.split(separator), strict=True))
    try:
        day = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"])).toordinal() - DAY0
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    # month first is tried last, so it has dates that no other reading has: their day is no month
    only = order == "mdy"
    while True:
        day = f.permute(day, DAYS, "date" + only * "mdy")
        out = datetime.date.fromordinal(DAY0 + day)
        if not only or out.day > 12:
            break
    return separator.join({"y": f"{out.year:04d}", "m": f"{out.month:02d}", "d": f"{out.day:02d}"}[k] for k in order)


def is_iban(compact: str) -> bool:
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def iban_end(text: str) -> int | None:
    """Where the account number that text begins with ends: the longest that validates and ends at a separator."""
    ends = [len(text), *(m.start() for m in re.finditer(" ", text))]
    return max((e for e in ends if is_iban(text[:e].replace(" ", ""))), default=None)


def iban(f: Feistel, text: str) -> str | None:
    compact = text.replace(" ", "")
    if not is_iban(compact):
        return None
    body = f.characters(compact[4:], [alphabet_of(c) for c in compact[4:]], "iban" + compact[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{compact[:2]}00")) % 97
    it = iter(f"{compact[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def ipv6(f: Feistel, text: str) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if sum(map(bool, text.split(":"))) < 3:
        return None
    out = str(ipaddress.IPv6Address(f.permute(value, 1 << 128, "ipv6")))
    return out.upper() if text != text.lower() else out


def token(f: Feistel, text: str) -> str | None:
    """An issuer's secret: the prefix stays."""
    head = TOKEN_HEAD.match(text).group()
    return head + letters(f, text[len(head) :], "token" + head)


def letters(f: Feistel, text: str, tweak: str) -> str:
    return f.characters(text, [alphabet_of(c) for c in text], tweak)


def secret(f: Feistel, text: str) -> str | None:
    if not any(c in DIGITS for c in text) or not any(c in "abcdef" for c in text):
        return None
    return f.characters(text, [HEX] * len(text), "secret")


NUMBER = re.compile(
    r"(?<![\d.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\d|\.\d)"
    r"|(?<![\d-])(?P<iso>\d{4}-\d{2}-\d{2})(?![\d-])"
    r"|(?<![\d./])(?P<dotted>\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/])"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?<![\dA-Za-z])(?P<card>\d(?:[ -]?\d){12,})(?!\d)(?![A-Za-z])"
    r"|(?P<intl>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4})(?!\d)"
    r"|(?<![\d-])(?P<phone>(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\d-])"
)
SECRET = re.compile(r"(?<![0-9a-zA-Z])[0-9a-f]{32,}(?![0-9a-zA-Z])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![a-z0-9])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
TOKEN_HEAD = re.compile(r"gh[pousr]_|github_pat_|glpat-|sk[-_](?:live_|test_|proj-)?|pk_(?:live|test)_|xox[abprs]-|AIza|AKIA|ASIA|hf_")
TOKEN = re.compile(rf"(?<![A-Za-z0-9_-])(?:{TOKEN_HEAD.pattern})[A-Za-z0-9_-]{{16,}}(?![A-Za-z0-9_-])")
GROUP = re.compile(r"\d+")
HAS_DIGIT = re.compile(r"\d")
LOCAL_SIGN = re.compile(r"[\w.%+-]")
DOMAIN = re.compile(r"(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}")


def mails(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses, by their @, in linear time."""
    out, at = [], text.find("@")
    while at >= 0:
        # back to the first sign that no local part holds: an @ before it at the latest, so no sign is seen twice
        first = at
        while first and LOCAL_SIGN.match(text, first - 1):
            first -= 1
        local, right = text[first:at].lstrip(".+-%"), DOMAIN.match(text, at + 1)
        if local and right and (not out or at - len(local) >= out[-1][1]):
            out.append((at - len(local), right.end()))
        at = text.find("@", at + 1)
    return out


def pseudonymise(text: str, f: Feistel, memo) -> tuple[str, list[str]]:
    """The text with every value replaced, and the kinds of values in order."""
    spans: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for a, b in mails(text):
            spans.append((a, b, "email", text[a:b]))
    if HAS_DIGIT.search(text):
        for m in NUMBER.finditer(text):
            if m.lastgroup == "card":
                spans += [(m.start() + a, m.start() + b, "card", m.group()[a:b]) for a, b in card_spans(m.group())]
            else:
                spans.append((m.start(), m.end(), m.lastgroup, m.group()))
        for m in IBAN.finditer(text):
            if end := iban_end(m.group()):
                spans.append((m.start(), m.start() + end, "iban", m.group()[:end]))
        for kind, pattern in (("secret", SECRET), ("token", TOKEN), ("ipv6", IPV6)):
            spans += [(m.start(), m.end(), kind, m.group()) for m in pattern.finditer(text)]
    if not spans:
        return text, []
    out, kinds, done = [], [], 0
    for a, b, kind, value in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a < done:
            continue
        new = memo(kind, value)
        if new is None:
            continue
        out += [text[done:a], new]
        kinds.append({"iso": "date", "dotted": "date", "intl": "phone", "ipv6": "ip", "token": "secret"}.get(kind, kind))
        done = b
    return "".join(out) + text[done:], kinds


def replacer(key: bytes):
    f = Feistel(key)

    @lru_cache(100_000)
    def memo(kind: str, value: str) -> str | None:
        if kind == "email":
            local, domain = value.split("@")
            name, _, top = domain.rpartition(".")
            return f"{letters(f, local, 'local')}@{letters(f, name, 'domain')}.{top}"
        if kind == "dotted":
            return date(f, value, "dmy", value[2]) or date(f, value, "mdy", value[2])
        if kind == "iso":
            return date(f, value, "ymd", "-")
        return {"ip": ipv4, "ssn": ssn, "card": card, "intl": phone, "phone": phone, "secret": secret, "iban": iban, "ipv6": ipv6, "token": token}[kind](f, value)

    return f, memo


def pseudonymise_documents(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs, text and n_chars renewed, with n_values and kinds (distinct, sorted, comma-joined).

    The input must have a column text; n_chars is renewed if there is one. n_values and kinds of
    the input's own are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_values", "kinds")]
    docs = docs.select(*names)
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def make():
        f, memo = replacer(key.encode())

        def work(batch: pa.RecordBatch):
            found = [(None, []) if t is None else pseudonymise(t, f, memo) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in found], pa.string())
            if chars is not None:
                old = batch.column(chars).to_pylist()
                columns[chars] = pa.array([len(t) if k else o for (t, k), o in zip(found, old, strict=True)], batch.schema.field(chars).type)
            columns += [pa.array([len(k) for _, k in found], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_values", "kinds"])

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_values bigint, kinds string"
    return map_arrow(docs, make, schema)
