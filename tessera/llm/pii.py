"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Each validated value is permuted within its own format: card numbers stay card numbers with a right check digit, dates stay
dates. The same key maps equal values alike, so they stay linked across documents; `reveal` inverts it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: The session's setting that names the key; the demonstration key serves only where it is unset.
KEY_SETTING, DEMO_KEY = "spark.tessera.pii.key", "tessera-demo-key"
ROUNDS = 8
#: First days of the spans within which dates stay, and the day behind the last.
_SPANS = [date(1, 1, 1).toordinal(), date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal(), date.max.toordinal() + 1]


class Feistel:
    """A permutation of range(n) for each (tweak, n); values that leave the range walk on until they are back."""

    def __init__(self, key: bytes):
        self.key = key

    def _f(self, tweak: bytes, n: int, r: int, half: int, bits: int) -> int:
        h = blake2b(b"%b|%d|%d|%d" % (tweak, n, r, half), key=self.key, digest_size=-(-bits // 8)).digest()
        return int.from_bytes(h, "big") & ((1 << bits) - 1)

    def step(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        bits = max(1, -(-(n - 1).bit_length() // 2))
        a, b, mask = x >> bits, x & ((1 << bits) - 1), (1 << bits) - 1
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = (b ^ self._f(tweak, n, r, a, bits)) & mask, a
            else:
                a, b = b, (a ^ self._f(tweak, n, r, b, bits)) & mask
        return a << bits | b

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False, ok: Callable[[int], bool] = lambda _: True) -> int:
        """Stays within the x in range(n) for which ok holds; x must be one."""
        while True:
            x = self.step(x, n, tweak, back)
            if x < n and ok(x):
                return x


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_digits(country: str, bban: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in bban + country + '00')) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


#: Alternatives are tried in this order at each place.
PATTERN = re.compile(
    r"(?<![\w.!#$%&'*+/=?^`{|}~@-])(?P<email>[\w.!#$%&'*+/=?^`{|}~-]++@(?:[^\W_][\w-]*+\.)+[^\W\d_]{2,})"
    r"|(?<![\w.-])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.-])(?P<iso>\d{4}-\d{2}-\d{2})(?![\w-])"
    r"|(?<![\w./-])(?P<dmy>\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/])"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?![\w-]|\.\d)|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))"
    r"|(?<![\w.-])(?P<card>\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"
)

KINDS = ("email", "iban", "iso", "dmy", "ssn", "ip", "phone", "card")
_HINT = re.compile("[0-9@]")


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The characters that may stand for c: digits for a digit, else the letters of c's kind in its block of 128; "" for others."""
    if not c.isalnum() or c.isdigit() and not c.isascii():
        return ""
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    first, kind = ord(c) & ~127, unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind)


class Pseudonyms:
    def __init__(self, key: bytes = DEMO_KEY.encode(), back: bool = False):
        self.f, self.back = Feistel(key), back

    def _digits(self, s: str, tweak: bytes, keep: int = 0, ok: Callable[[str], bool] = lambda _: True) -> str:
        d = re.sub(r"\D", "", s)
        n, w = 10 ** (len(d) - keep), len(d) - keep
        x = self.f.permute(int(d[keep:]), n, tweak + b"%d" % w, self.back, lambda v: ok(d[:keep] + str(v).zfill(w)))
        return _refill(s, d[:keep] + str(x).zfill(w))

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if luhn_digit(d[:-1]) != d[-1] or not d.strip("0"):
            return None
        body = re.sub(r"\D", "", self._digits(d[:-1], b"card"))
        return _refill(s, body + luhn_digit(body))

    def phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if not 9 <= len(d) <= 15:
            return None
        lead = len(re.match(r"\+?(\d{1,3})", s)[1]) if s.startswith("+") else 0
        if lead and not re.match(r"\+\d{1,3}[ .(-]", s):
            lead = 1
        return self._digits(s, b"phone", lead)

    def ssn(self, s: str) -> str | None:
        ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        return self._digits(s, b"ssn", 0, ok) if ok(s.replace("-", "")) else None

    def ip(self, s: str) -> str | None:
        p = s.split(".")
        if any(int(x) > 255 or x != str(int(x)) for x in p):
            return None
        x = self.f.permute(int.from_bytes(bytes(map(int, p)), "big"), 1 << 32, b"ip", self.back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, y: int, m: int, d: int, ok: Callable[[date], bool] = lambda _: True) -> date | None:
        """Another day of the span (before 1900, 1900 to 2099, later) for which ok holds; None if there is no such date."""
        try:
            x = date(y, m, d).toordinal()
        except ValueError:
            return None
        first, end = next((a, b) for a, b in zip(_SPANS, _SPANS[1:]) if x < b)
        return date.fromordinal(first + self.f.permute(x - first, end - first, b"day%d" % first, self.back, lambda v: ok(date.fromordinal(first + v))))

    def iso(self, s: str) -> str | None:
        d = self._day(*map(int, s.split("-")))
        return d and d.isoformat()

    def dmy(self, s: str) -> str | None:
        """Day first where that is a date, else month first, which stays among the dates that only read so.

        Days and months of one digit stay among those of one digit, so that the length and the way back are kept.
        """
        sep = "." if "." in s else "/"
        one, two, year = s.split(sep)
        a, b, y = int(one), int(two), int(year)
        like = lambda v, was: len(was) == 2 or v < 10
        if d := self._day(y, b, a, lambda v: like(v.day, one) and like(v.month, two)):
            return f"{d.day:0{len(one)}d}{sep}{d.month:0{len(two)}d}{sep}{d.year:04d}"
        d = self._day(y, a, b, lambda v: v.day > 12 and like(v.month, one))
        return d and f"{d.month:0{len(one)}d}{sep}{d.day:02d}{sep}{d.year:04d}"

    def iban(self, s: str) -> str | None:
        t = s.replace(" ", "")
        if not 15 <= len(t) <= 34 or iban_digits(t[:2], t[4:]) != t[2:4]:
            return None
        body = self._mixed(t[4:], b"iban")
        it = iter(t[:2] + iban_digits(t[:2], body) + body)
        return "".join(" " if c == " " else next(it) for c in s)

    def _mixed(self, s: str, tweak: bytes) -> str:
        """Digits stay digits, letters letters of their case and script, the rest as it is."""
        sets = [_alphabet(c) or c for c in s]
        x, n = 0, 1
        for c, among in zip(s, sets):
            x, n = x * len(among) + among.index(c), n * len(among)
        x, out = self.f.permute(x, n, tweak + "".join(among[0] for among in sets).encode(), self.back) if n > 1 else x, []
        for among in reversed(sets):
            x, v = divmod(x, len(among))
            out.append(among[v])
        return "".join(reversed(out))

    def email(self, s: str) -> str:
        """The local part is mixed, the host stays: equal addresses stay equal, and those of one host stay together."""
        local, _, host = s.partition("@")
        return f"{self._mixed(local, b'email@' + host.lower().encode())}@{host}"

    def text(self, s: str | None) -> tuple[str | None, list[dict]]:
        """The text with pseudonyms, and (kind, start, length) of each in the original."""
        if not s or not _HINT.search(s):
            return s, []
        out, at, found = [], 0, []
        for m in PATTERN.finditer(s):
            kind = next(k for k in KINDS if m[k] is not None)
            new = getattr(self, kind)(m[0])
            if new is not None:
                out += [s[at : m.start()], new]
                at = m.end()
                found.append({"kind": kind, "start": m.start(), "length": len(m[0])})
        return "".join([*out, s[at:]]) if found else s, found


def pseudonymise(docs: DataFrame, key: bytes | None = None, text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with text_col rewritten and pii added (array of kind, start, length in the original; a column pii is replaced).

    The key is that of the session's setting spark.tessera.pii.key unless one is given. Null and empty texts stay as they
    are, with no finds; repeated rows come out equal; an empty table gives an empty result. Rows are independent; nothing is
    gathered.
    """
    key = docs.sparkSession.conf.get(KEY_SETTING, DEMO_KEY).encode() if key is None else key
    docs = docs.drop("pii")
    where, kinds = docs.columns.index(text_col), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    src = docs.withColumn(text_col, F.col(text_col).cast("string"))
    schema = src.select("*", F.expr("CAST(NULL AS array<struct<kind:string,start:bigint,length:bigint>>) AS pii")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key, back)
        for b in batches:
            got = [p.text(t.as_py()) for t in b.column(where)]
            cols = list(b.columns)
            cols[where] = pa.array([g[0] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[1] for g in got], kinds)], names=schema.names)

    return src.mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
