"""Personal data: format-preserving Feistel pseudonyms.

Validated values in a text (payment card numbers with a right check digit, bank
account numbers with right check digits, social security numbers in the ranges
in use, telephone numbers, IPv4 addresses, calendar dates, e-mail addresses,
secrets after a keyword) are replaced by others of the same format. The
value's rank among all valid values of its format is permuted by a keyed Feistel
network with cycle walking, so equal values, however they are spaced, get
equal pseudonyms in every document, different values different ones, and whoever
holds the key can undo it.

Whatever is not valid stays as it is. Where digit groups stand side by side, cards of a
usual shape are found first, then other cards and telephone numbers, from every group
on; undoing is exact unless a neighbour and a pseudonym by chance read as another valid
number. Letters of other scripts give letters of their script; an e-mail address without
a letter or digit to permute is no find. Defined results: null text stays null and
has no finds; an empty text is unchanged; repeated rows give equal results; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import portions

#: Parameters: the secret key (a deployment passes its own) and the rounds of the network.
KEY = b"pseudonym-key-of-the-examples"
ROUNDS = 8
#: Characters that are permuted as one number, and of values whose pseudonym a worker remembers.
RESPELL = 1024
REMEMBERED = 256

KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")
MONTHS = "January February March April May June July August September October November December".split()  # fixed values
FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

CARD_FORM = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE_FORM = r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3}(?![0-9])|(?<![\w+])\+[0-9]{8,15}(?![0-9])"
PATTERN = re.compile(
    r"(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?)[A-Za-z0-9_+/=-]{12,}|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b)"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}([./-])[0-9]{1,2}\4[0-9]{4}|[0-9]{1,2}\ (?:" + "|".join(MONTHS) + r")\ [0-9]{4}|(?:" + "|".join(MONTHS) + r")\ [0-9]{1,2},\ [0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>" + CARD_FORM + r")"
    r"|(?P<phone>" + PHONE_FORM + r")"
)
#: What follows the local part of an e-mail address, and the characters of one.
DOMAIN = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
LOCAL, NOT_LOCAL = re.compile(r"\w"), re.compile(r"[^\w.+%-]")
CARD, PHONE = re.compile(CARD_FORM), re.compile(PHONE_FORM)
#: Cards as they are printed, which go before other readings of the same digits; what reads as a telephone number.
USUAL = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")
SPOKEN = re.compile(r"[0-9]{2,4}(?:[ .-][0-9]{2,5}){2,4}")
GROUP, GROUP_END = re.compile(r"(?<![0-9])[0-9]"), re.compile(r"(?<=[0-9])(?=[ .-])")
#: A line without any of these cannot hold a find, and no find spans lines; a cheap first test.
HINT = re.compile(r"[0-9@=:_]|AKIA|sk-")


def permute(rank: int, size: int, tweak: bytes, key: bytes, backwards: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits, walked until it is inside."""
    if size < 2:
        return rank
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    rounds = range(ROUNDS)[:: -1 if backwards else 1]
    while True:
        left, right = rank >> half, rank & mask
        for r in rounds:
            if backwards:
                left, right = right ^ _round(r, left, half, tweak, key), left
            else:
                left, right = right, left ^ _round(r, right, half, tweak, key)
        rank = left << half | right
        if rank < size:
            return rank


def _round(r: int, value: int, half: int, tweak: bytes, key: bytes) -> int:
    data = bytes([r]) + value.to_bytes((half + 7) // 8, "little") + tweak
    need = (half + 7) // 8
    out = b"".join(hashlib.blake2b(data + bytes([i]), key=key, digest_size=64).digest() for i in range(-(-need // 64)))
    return int.from_bytes(out[:need], "little") & ((1 << half) - 1)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX, LATIN = "0123456789abcdef", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"


@lru_cache(1 << 16)
def alphabet(char: str) -> str:
    """What may stand for a character: its class, in other scripts the letters or digits of its kind in its part of the code table."""
    known = next((a for a in (LOWER, UPPER, DIGITS, LATIN) if char in a), None)
    if known or not char.isalnum():
        return known or char
    part, kind = ord(char) & ~0x7F, unicodedata.category(char)
    return "".join(c for c in map(chr, range(part, part + 0x80)) if unicodedata.category(c) == kind and c.isalnum() and not any(c in a for a in (LOWER, UPPER, DIGITS, LATIN)))


def alphabets(text: str, hexadecimal: bool) -> list[str]:
    """The characters that may stand at each place, by the class of the one that does."""
    if hexadecimal and all(c in HEX for c in text):
        return [HEX] * len(text)
    return [alphabet(c) for c in text]


def respell(text: str, tweak: bytes, key: bytes, backwards: bool = False, hexadecimal: bool = False) -> str:
    """Another string with the same class of character at each place; very long ones are permuted a piece at a time."""
    if len(text) > RESPELL:
        hexadecimal = hexadecimal and all(c in HEX for c in text)
        return "".join(respell(text[i : i + RESPELL], tweak + b"/%d" % i, key, backwards, hexadecimal) for i in range(0, len(text), RESPELL))
    spans, rank, size = alphabets(text, hexadecimal), 0, 1
    for a, c in zip(spans, text, strict=True):
        rank, size = rank * len(a) + a.index(c), size * len(a)
    rank, out = permute(rank, size, tweak + "".join(a[0] for a in spans).encode(), key, backwards), []
    for a in reversed(spans):
        rank, i = divmod(rank, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit that completes `digits`."""
    twice = sum(sum(divmod(2 * int(c), 10)) for c in digits[::-2])
    return -(twice + sum(map(int, digits[-2::-2]))) % 10


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def refill(shape: str, kept: str) -> str:
    """The letters and digits of `kept`, with the separators of `shape`."""
    chars = iter(kept)
    return "".join(next(chars) if c.isalnum() else c for c in shape)


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), b"card%d" % len(digits), key, back)).zfill(len(digits) - 1)
    return refill(text, body + str(luhn(body)))


def iban_size(plain: str) -> int:
    """How many characters make the longest valid account number at the start, 0 if none do; words in capitals may follow."""
    return next((n for n in range(len(plain), 14, -1) if iban_check(plain[:2], plain[4:n]) == plain[2:4]), 0)


def iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    n = iban_size(plain)
    if not n:
        return None
    country = plain[:2]
    new = respell(plain[4:n], b"iban" + country.encode(), key, back)
    return refill(text, country + iban_check(country, new) + new + plain[n:])


def ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(permute(rank, 898 * 99 * 9999, b"ssn", key, back), 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    country = re.match(r"\+[0-9]{1,3}(?![0-9])", text)
    head = country[0][1:] if country else ""
    body = digits[len(head) :]
    lead = "123456789" if body[0] != "0" else "0"  # a first zero is a trunk prefix and stays
    rank = lead.index(body[0]) * 10 ** (len(body) - 1) + int(body[1:] or 0)
    rank = permute(rank, len(lead) * 10 ** (len(body) - 1), f"phone{head}/{len(body)}{lead[0]}".encode(), key, back)
    first, rest = divmod(rank, 10 ** (len(body) - 1))
    return refill(text, head + lead[first] + str(rest).zfill(len(body) - 1))


def ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    rank = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip", key, back)
    return ".".join(map(str, rank.to_bytes(4, "big")))


def calendar(text: str, key: bytes, back: bool) -> str | None:
    numbers = [int(x) for x in re.findall(r"[0-9]+", text)]
    named = next((i + 1 for i, m in enumerate(MONTHS) if m in text), 0)
    year_first = len(re.match(r"[0-9]*", text)[0]) == 4
    if named:
        d, m, y = numbers[0], named, numbers[1]
    elif year_first:
        y, m, d = numbers
    else:
        d, m, y = numbers
    month_first = not named and not year_first and ("/" in text and d <= 12 or m > 12)
    if month_first:
        d, m = m, d
    try:
        rank = date(y, m, d).toordinal() - FIRST
    except ValueError:
        return None
    if not 0 <= rank <= LAST - FIRST:
        return None
    # an order that only a day over 12 can tell is kept readable: the walk goes on to such a date
    told_by_day = not named and not year_first and month_first != ("/" in text)
    new = None
    while new is None or (told_by_day and new.day <= 12):
        rank = permute(rank, LAST - FIRST + 1, b"date", key, back)
        new = date.fromordinal(FIRST + rank)
    if named:
        written = {str(numbers[0]): str(new.day), MONTHS[named - 1]: MONTHS[new.month - 1], str(y): str(new.year)}
        return re.sub(r"[0-9]+|[A-Z][a-z]+", lambda x: written[x[0]], text) if len(written) == 3 else None
    order = [new.year, new.month, new.day] if year_first else [new.month, new.day, new.year] if month_first else [new.day, new.month, new.year]
    width = [2 if len(x) == 2 else 1 for x in re.findall(r"[0-9]+", text)]
    values = iter(zip(order, width, strict=True))
    return re.sub(r"[0-9]+", lambda _: (lambda v: str(v[0]).zfill(v[1]))(next(values)), text)


def email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    host, dot, top = domain.rpartition(".")
    if all(len(a) < 2 for a in alphabets(local, False)):
        return None
    return respell(local, b"local", key, back) + "@" + host + dot + top


def secret(text: str, key: bytes, back: bool) -> str | None:
    head, body = re.fullmatch(r"(.*[\"':=\s]|)([A-Za-z0-9_+/=-]+)", text, re.DOTALL).groups()
    return head + respell(body, b"secret", key, back, hexadecimal=True)


MAKE = {"email": email, "secret": secret, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": calendar}


def pseudonym(kind: str, text: str, key: bytes = KEY, backwards: bool = False) -> str | None:
    """The pseudonym of one found value; None where it is not valid."""
    return _remembered(kind, text, key, backwards) if len(text) <= REMEMBERED else MAKE[kind](text, key, backwards)


@lru_cache(1 << 16)
def _remembered(kind: str, text: str, key: bytes, backwards: bool) -> str | None:
    return MAKE[kind](text, key, backwards)


def ends(m: re.Match) -> list[int]:
    """Where the match and its shorter forms of whole groups end, longest first."""
    return [m.end(), *[m.start() + x.start() for x in GROUP_END.finditer(m[0])][::-1]]


def card_at(line: str, at: int, limit: int, key: bytes, back: bool) -> tuple[int, int, bool] | None:
    """Start and end of the valid card that begins at a group, and whether its shape is a usual one."""
    m = CARD.match(line, at, limit)
    found = [e for e in (ends(m) if m else []) if CARD.fullmatch(line, at, e) and pseudonym("card", line[at:e], key, back) is not None]
    usual = next((e for e in found if USUAL.fullmatch(line, at, e)), None)
    return (at, usual or found[0], usual is not None) if found else None


def phones_at(line: str, at: int, limit: int, key: bytes, back: bool) -> list[int]:
    """Ends of the telephone numbers that begin at `at`, longest first."""
    m = PHONE.match(line, at, limit)
    return [e for e in (ends(m) if m else []) if PHONE.fullmatch(line, at, e) and pseudonym("phone", line[at:e], key, back) is not None]


def number(line: str, m: re.Match, limit: int, key: bytes, back: bool) -> tuple[str, int, int] | None:
    """The value to take first from groups of digits: a usual card, another card at the start, a telephone number as long as the match, and what is inside."""
    cards = [c for x in GROUP.finditer(m[0]) if (c := card_at(line, m.start() + x.start(), limit, key, back))]
    if (usual := next((c for c in cards if c[2] and line[c[0] - 1 : c[0]] != "+"), None)) is not None:
        return "card", *usual[:2]
    if cards and cards[0][0] == m.start():
        return "card", *cards[0][:2]
    if (m.lastgroup == "phone" or SPOKEN.fullmatch(m[0])) and pseudonym("phone", m[0], key, back) is not None:
        return "phone", *m.span()
    phones = phones_at(line, m.start(), limit, key, back)
    split = next((e for e in phones if card_at(line, e + 1, limit, key, back) or phones_at(line, e + 1, limit, key, back)), None)
    if split is not None:  # a valid number follows
        return "phone", m.start(), split
    if cards:
        return "card", *cards[0][:2]
    return ("phone", m.start(), phones[0]) if phones else None


def email_at(line: str, start: int, limit: int) -> tuple[int, int, int] | None:
    """Start, place of the @ and end of the first e-mail address behind `start`. Each run of characters before an @ is read once, backwards."""
    while (at := line.find("@", start, limit)) >= 0:
        first = at
        while first > start and not NOT_LOCAL.match(line, first - 1):
            first -= 1
        found = DOMAIN.match(line, at, limit) if LOCAL.search(line, first, at) else None
        if found:
            return first, at, found.end()
        start = at + 1
    return None


def values(line: str, start: int, limit: int, key: bytes, back: bool) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each valid value; behind one that is not valid the search goes on at its next group."""
    wrong = 0  # end of a card with a wrong check digit, whose groups are no telephone number
    mail, m = email_at(line, start, limit), PATTERN.search(line, start, limit)
    while True:
        if m and m.start() < start:
            m = PATTERN.search(line, start, limit)
        while mail and (mail[1] < start or not LOCAL.search(line, max(mail[0], start), mail[1])):
            mail = email_at(line, max(mail[1] + 1, start), limit)
        if mail and (m is None or max(mail[0], start) <= m.start()):
            at, start = max(mail[0], start), mail[2]
            if pseudonym("email", line[at:start], key, back) is not None:
                yield "email", at, start
            continue
        if m is None:
            return
        kind, at, start = m.lastgroup, m.start(), m.end()
        if kind in ("card", "phone"):
            found = number(line, m, limit, key, back)
            if USUAL.fullmatch(m[0]):
                wrong = max(wrong, m.end())
            if found is None or (found[0] == "phone" and found[2] <= wrong):
                start = next((at + x.start() for x in GROUP.finditer(m[0], 1)), start)
                continue
            if found[1] > at:
                yield from values(line, at, found[1] - 1, key, back)
            yield found
            start = found[2]
        elif kind == "iban":
            n = iban_size(m[0].replace(" ", ""))
            places = [i for i, c in enumerate(m[0], at + 1) if c != " "]
            if n:
                yield kind, at, places[n - 1]
            start = places[n - 1] if n else at + len(m[0].split(" ")[0])
        elif pseudonym(kind, m[0], key, back) is not None:
            yield kind, at, start


def rewrite(text: str, key: bytes = KEY, backwards: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the original."""
    finds, out, done, start = [], [], 0, 0
    while (hint := HINT.search(text, start)) is not None:
        first = text.rfind("\n", 0, hint.start()) + 1
        end = text.find("\n", hint.start())
        end = len(text) if end < 0 else end
        start = end + 1
        line = text[first:end]
        for kind, a, b in values(line, 0, len(line), key, backwards):
            finds.append((kind, first + a, first + b))
            out += [text[done : first + a], pseudonym(kind, line[a:b], key, backwards)]
            done = first + b
    return "".join(out) + text[done:], finds


def pseudonymise(docs: DataFrame, key: bytes = KEY, backwards: bool = False) -> DataFrame:
    """`docs` with `text` rewritten and the counts of finds as `pii_<kind>` columns, replacing such columns if present."""
    from pyspark.sql import types as T

    counts = [f"pii_{k}" for k in KINDS]
    clean = docs.drop(*counts)
    schema = T.StructType([*clean.schema.fields, *[T.StructField(c, T.IntegerType()) for c in counts]])
    at = clean.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts, found = [], []
            for text in batch.column(at).to_pylist():
                new, finds = rewrite(text, key, backwards) if text is not None else (None, [])
                texts.append(new)
                found.append([sum(k == kind for k, _, _ in finds) for kind in KINDS])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            columns += [pa.array([f[i] for f in found], pa.int32()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return clean.mapInArrow(run, schema)


def findings(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """One row per document: doc_id, the rewritten text, the finds of each kind and their number."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    return out.withColumn("n_found", sum(F.col(f"pii_{k}") for k in KINDS))
