"""Personal data replaced by format-preserving pseudonyms from keyed Feistel networks.

Found values are validated (octets, numbering plans, check digits, calendar) and brought to one canonical number
whatever way they are written; that is permuted by the key among the n values of its kind and written in the way
the value was. The permutation is y = P^-1((P(x) + c) mod n) with a Feistel network P, cycle-walked into [0, n), and
a keyed shift c from 1 to n - 1: one-to-one, so equal values stay linked across documents and ways of writing and
different ones apart; never a fixed point; and undone by the shift -c for a holder of the key.

Kinds: e-mail addresses (letters and digits of the local part and of the domain's labels but the last; domains of
public mail providers stay), IBANs in any case, payment card numbers, social security numbers, telephone numbers,
IPv4 and IPv6 addresses, dates in digits, in timestamps and with month names in English, German, French and Spanish.
A number of ten digits alone is a telephone number, and one of nine a social security number, only after a word that
says so. Card numbers must be of an issuer's range and length; without separators and without a word for cards before
them only those of 15 and 16 digits are taken for cards. Values that fail their validation are left as they are, and so
are dotted numbers after a word for versions.

Telephone numbers are linked whether they are written with + or 00, and with or without a trunk zero in brackets; those
without a country code among themselves. Dates with years of two digits are linked among themselves (1930 to 2029).

There is no default key, as anybody could undo what a published one made: the caller gives it, or session_key()
takes it from the session's configuration.

Defined cases: a null text stays null; texts without personal data are returned unchanged; equal rows are
treated alike; an empty table gives an empty result; other columns are kept as they are. Letters of addresses that
aren't in ASCII stay. Undoing gives back values; of their writing it may change zeros before days and months below 10,
zeros that fill the groups of an IPv6 address, an English month that was abbreviated and is May, and the language of a month's name that two languages share.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

#: Setting of the session that holds the key.
KEY_SETTING = "spark.lectern.pii.key"
ROUNDS = 8

#: Months by language, and the English abbreviations.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: Lengths of IBANs by country.
IBAN_LENGTHS = dict(zip(*[iter("AD 24 AE 23 AL 28 AT 20 AZ 28 BA 20 BE 16 BG 22 BH 22 BR 29 BY 28 CH 21 CR 22 CY 28 CZ 24 DE 22 DK 18 DO 28 EE 20 EG 29 ES 24 FI 18 FO 18 FR 27 GB 22 GE 22 GI 23 GL 18 GR 27 GT 28 HR 21 HU 28 IE 22 IL 23 IQ 23 IS 26 IT 27 JO 30 KW 30 KZ 20 LB 28 LC 32 LI 21 LT 20 LU 20 LV 21 LY 25 MC 27 MD 24 ME 22 MK 19 MR 27 MT 31 MU 30 NL 18 NO 15 PK 24 PL 28 PS 29 PT 25 QA 29 RO 24 RS 22 SA 24 SC 31 SE 24 SI 19 SK 24 SM 27 ST 25 SV 28 TL 23 TN 24 TR 26 UA 29 VA 22 VG 24 XK 20".split())] * 2, strict=True))
#: Telephone country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Domains of public mail providers.
PROVIDERS = frozenset("aol.com gmail.com gmx.de gmx.net hotmail.com icloud.com live.com mail.com outlook.com proton.me web.de yahoo.com".split())

#: First digits of card numbers by issuer, least and largest, and the numbers' lengths.
ISSUERS = [
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)),
    ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)), ("3528", "3589", (16,)), ("62", "62", (16, 17, 18, 19)), ("5018", "5018", (16,)), ("5020", "5020", (16,)), ("5038", "5038", (16,)), ("6304", "6304", (16, 18, 19)), ("6759", "6763", (16, 18, 19)),
]
#: Words before a card number, and before a version.
CARD_WORD = re.compile(r"(?<!\w)(?:(?:credit|debit|bank)? ?cards?|visa|mastercard|maestro|amex|american express|diners|discover|jcb|unionpay|(?:kredit|bank)?karten?|cartes?|tarjetas?|cc|pan)(?!\w)[^\n\d]{0,24}$", re.I)
VERSION_WORD = re.compile(r"(?<!\w)(?:version|ver|v|release|build|firmware|section|chapter)\.?:? ?$", re.I)

_NAMED = {k: "|".join(v) for k, v in MONTHS.items()}
#: Formats. A group v is the value, where a pattern takes more into account.
PATTERNS = {
    "email": [re.compile(r"(?<![\w.+-])[^\W_](?:[\w.%+-]{0,62}[\w%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")],
    "iban": [re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")],
    "card": [re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5})(?![\w-])(?!\.\d)")],
    "ssn": [re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?![\w-])"), re.compile(r"(?<!\w)(?:ssn|social security(?: number| no\.?)?)(?:\.|:| no\.?| number| is)? ?:? ?(?P<v>\d{9})(?![\w-])(?!\.\d)", re.I)],
    "ip": [re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w-])(?!\.\d)")],
    "ip6": [re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::?)(?:[0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}(?![\w:])(?!\.\d)")],
    "phone": [
        re.compile(r"(?<![\w+.-])(?:00[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(0\d{2,4}\) ?\d{4,8}|0\d{2,4}/ ?\d{4,8}|0[1-9](?:([ .-])\d{2})(?:\1\d{2}){3})(?![\w-])(?!\.\d)"),
        re.compile(r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4}|(?<!\d )[2-9]\d\d [2-9]\d\d \d{4}(?! \d))(?![\w-])"),
        re.compile(r"(?<!\w)(?:tel|phone|telephone|call|fax|mobile|cell|telefon|handy|téléphone|teléfono|móvil)(?:\.|:| no\.?| nr\.?| number)? ?:? ?(?P<v>[2-9]\d\d[2-9]\d{6})(?![\w-])(?!\.\d)", re.I),
    ],
    "date": [
        re.compile(r"(?<![\w./-])(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})(?:(?=T\d{2}:)|(?![\w/-]))(?!\.\d)"),
        re.compile(r"(?<![\w./-])(?P<a>\d{1,2})(?P<s>[-/.])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4})(?![\w/-])(?!\.\d)"),
        re.compile(r"(?<![\w./-])(?P<a>\d{2})(?P<s>/)(?P<b>\d{2})/(?P<y>\d{2})(?![\w/-])(?!\.\d)"),
        re.compile(rf"(?<!\w)(?:(?P<en>{_NAMED['en']})|(?P<de>{_NAMED['de']})|(?P<en3>{_NAMED['en3']}))(?P<s>\.? )(?P<d>\d{{1,2}})(?P<o>st|nd|rd|th)?(?P<t>,? )(?P<y>\d{{4}})(?!\w)", re.I),
        re.compile(rf"(?<![\w.])(?P<d>\d{{1,2}})(?P<o>st|nd|rd|th)?(?P<s> )(?:(?P<en>{_NAMED['en']})|(?P<en3>{_NAMED['en3']})|(?P<fr>{_NAMED['fr']}))(?P<t>\.?,? )(?P<y>\d{{4}})(?!\w)", re.I),
        re.compile(rf"(?<![\w.])(?P<d>\d{{1,2}})(?P<s>\. ?)(?P<de>{_NAMED['de']})(?P<t> )(?P<y>\d{{4}})(?!\w)", re.I),
        re.compile(rf"(?<![\w.])(?P<d>\d{{1,2}})(?P<s> de )(?P<es>{_NAMED['es']})(?P<t> del? )(?P<y>\d{{4}})(?!\w)", re.I),
    ],
}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: The first of the hundred years that two digits stand for.
FIRST_SHORT = 1930
#: Days up to and after the 12th of a month, which are permuted among themselves, so that a date in digits is read
#: again in the order (day first or month first) in which it was.
_EARLY, _LATE = ([d for d in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(d).day > 12) == late] for late in (False, True))
_SHORT_EARLY, _SHORT_LATE = ([d for d in days if FIRST_SHORT <= datetime.date.fromordinal(d).year < FIRST_SHORT + 100] for days in (_EARLY, _LATE))


class Permutation:
    """A keyed one-to-one map of range(n), n at least 2, without fixed points."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.half = n, ((n - 1).bit_length() + 1) // 2
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{tweak}|{n}|{r}".encode(), key=key[:64], digest_size=32).digest() for r in range(ROUNDS)]
        self.shift = 1 + int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|shift".encode(), key=key[:64]).digest()) % (n - 1)
        self.bytes = self.half // 8 + 1

    def _round(self, r: int, x: int) -> int:
        seed = self.keys[r] + x.to_bytes(self.bytes)
        return int.from_bytes(hashlib.shake_256(seed).digest(self.bytes)) & self.mask

    def _forth(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in range(ROUNDS):
                a, b = b, a ^ self._round(r, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(ROUNDS)):
                a, b = b ^ self._round(r, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int, undo: bool = False) -> int:
        return self._back((self._forth(x) + (-self.shift if undo else self.shift)) % self.n)


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a valid number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _issuer(digits: str) -> tuple[str, str] | None:
    """The range of first digits that a card number is in."""
    return next(((low, high) for low, high, sizes in ISSUERS if len(digits) in sizes and low <= digits[: len(low)] <= high), None)


def _in_plan(ten: str) -> bool:
    return ten[0] > "1" and ten[3] > "1"


def _filled(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self._made: dict[tuple[str, int], Permutation] = {}

    def _map(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        if (tweak, n) not in self._made:
            if len(self._made) > 10_000:
                self._made.clear()
            self._made[tweak, n] = Permutation(self.key, tweak, n)
        return self._made[tweak, n](x, self.undo)

    def _characters(self, s: str, tweak: str) -> str:
        """Letters become letters of the same case and digits become digits, all permuted as one number."""
        sizes = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in s]
        x, n = 0, 1
        for c, k in zip(s, sizes, strict=True):
            x, n = x * k + (int(c) if k == 10 else ord(c.lower()) - 97 if k == 26 else 0), n * k
        x, out = self._map(x, n, f"{tweak}|{''.join('9' if k == 10 else 'a' if k == 26 else '-' for k in sizes)}"), []
        for c, k in zip(reversed(s), reversed(sizes), strict=True):
            x, d = divmod(x, k)
            out.append(str(d) if k == 10 else chr(97 + d - 32 * c.isupper()) if k == 26 else c)
        return "".join(reversed(out))

    def email(self, m: re.Match) -> str | None:
        local, domain = m[0].rsplit("@", 1)
        if domain.lower() not in PROVIDERS:
            *labels, last = domain.split(".")
            domain = ".".join([*(self._characters(x, "domain") for x in labels), last])
        return f"{self._characters(local, 'email')}@{domain}"

    def iban(self, m: re.Match) -> str | None:
        size, at = int(IBAN_LENGTHS.get(m[0][:2].upper(), 0)), [i for i, c in enumerate(m[0]) if c != " "]
        if not size or len(at) < size or len(at) > size and at[size] == at[size - 1] + 1:
            return None
        end = at[size - 1] + 1  # a word of four letters may follow
        plain = m[0][:end].replace(" ", "")
        if _iban_rest(plain.upper()) != 1:
            return None
        body = self._characters(plain[4:], f"iban {plain[:2].upper()}")
        made = iter(f"{plain[:2]}{98 - _iban_rest(f'{plain[:2]}00{body}'.upper()):02}{body}")
        return "".join(c if c == " " else next(made) for c in m[0][:end]) + m[0][end:]

    def card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        found = _issuer(digits)
        if not found or luhn(digits) % 10 or len(set(digits)) == 1:
            return None
        if m[0] == digits and len(digits) not in (15, 16) and not CARD_WORD.search(m.string[max(0, m.start() - 48) : m.start()]):
            return None
        low, high = found
        rest = len(digits) - 1 - len(low)
        x = self._map((int(digits[: len(low)]) - int(low)) * 10**rest + int(digits[len(low) : -1]), (int(high) - int(low) + 1) * 10**rest, f"card {low} {len(digits)}")
        body = f"{int(low) + x // 10**rest}{x % 10**rest:0{rest}}"
        return _filled(m[0], body + str(-luhn(f"{body}0") % 10))

    def ssn(self, m: re.Match) -> str | None:
        written = m.groupdict().get("v") or m[0]
        digits = re.sub(r"\D", "", written)
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = self._map(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return m[0][: len(m[0]) - len(written)] + _filled(written, f"{area + 1 + (area >= 665):03}{group + 1:02}{serial + 1:04}")

    def phone(self, m: re.Match) -> str | None:
        written = m.groupdict().get("v") or m[0]
        shape = written.replace("(0)", "(\0)")  # a trunk zero is no part of the number
        digits = re.sub(r"[^0-9]", "", shape)
        abroad = "00" if digits.startswith("00") else ""
        if not 8 <= len(digits) - len(abroad) <= 15:
            return None
        if not abroad and digits[0] == "0" and written[0] != "+":  # without a country's code, and with its trunk zero
            n = len(digits) - 2
            x = self._map((int(digits[1]) - 1) * 10**n + int(digits[2:]), 9 * 10**n, "phone 0") if digits[1] != "0" else None
            return None if x is None else _filled(written, f"0{1 + x // 10**n}{x % 10**n:0{n}}")
        digits = digits[len(abroad) :]
        head = "" if written[0] != "+" and not abroad else next((digits[:k] for k in (1, 2) if digits[:k] in COUNTRY_CODES), digits[:3])
        body = digits[len(head) :]
        code = head or "1"  # a number without a code is one of the North American plan
        tweak, plan = f"phone {code}", code == "1" and len(body) == 10
        if plan and _in_plan(body):
            x = self._map(((int(body[:3]) - 200) * 800 + int(body[3:6]) - 200) * 10_000 + int(body[6:]), 800 * 800 * 10_000, f"{tweak} plan")
            x, line = divmod(x, 10_000)
            body = f"{x // 800 + 200}{x % 800 + 200}{line:04}"
        else:  # outside the numbering plan it stays outside, by walking on
            while True:
                body = f"{self._map(int(body), 10 ** len(body), tweak):0{len(body)}}"
                if not plan or not _in_plan(body):
                    break
        return m[0][: len(m[0]) - len(written)] + _filled(shape, abroad + head + body).replace("\0", "0")

    def ip(self, m: re.Match) -> str | None:
        octets = m[0].split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets) or VERSION_WORD.search(m.string[max(0, m.start() - 16) : m.start()]):
            return None
        x = self._map(int.from_bytes(bytes(map(int, octets))), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4)))

    def ip6(self, m: re.Match) -> str | None:
        """The groups that aren't zero are permuted, so that the short form stays as short; of two groups the second one.

        Two groups must be of a global, local or link-local network, and groups of two digits only are no address.
        """
        given = re.findall("[0-9A-Fa-f]+", m[0])
        network = len(given) == 2 and "::" in m[0][1:] and re.match("(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):", m[0], re.I)
        if not re.search(r"\d", m[0]) or len(given) < 3 and not network or "::" not in m[0] and max(map(len, given)) < 3:
            return None
        try:
            groups = ipaddress.IPv6Address(m[0]).exploded.split(":")
        except ValueError:
            return None
        kept = [g for g in groups if g != "0000"]
        fixed = [kept.pop(0)] if network and len(kept) > 1 else []
        x = 0
        for g in kept:
            x = x * 65535 + int(g, 16) - 1
        x, made = self._map(x, 65535 ** len(kept), f"ip6 {fixed} {[g != '0000' for g in groups]}"), []
        for _ in kept:
            x, g = divmod(x, 65535)
            made.append(g + 1)
        made.reverse()
        made = [int(g, 16) for g in fixed] + made
        width, upper = 4 if any(len(g) == 4 and g[0] == "0" for g in given) else 1, m[0] != m[0].lower()
        told = iter(made)
        out = re.sub("[0-9A-Fa-f]+", lambda g: g[0] if int(g[0], 16) == 0 else f"{next(told):0{width}x}", m[0])
        return out.upper() if upper else out

    def _moved(self, year: int, month: int, day: int, short: bool = False) -> datetime.date | None:
        """The pseudonym of a day, none of a date that doesn't exist or is out of range. short: a year of two digits."""
        try:
            at = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        days = (_SHORT_LATE if day > 12 else _SHORT_EARLY) if short else _LATE if day > 12 else _EARLY
        return datetime.date.fromordinal(days[self._map(bisect_left(days, at), len(days), f"date {day > 12}{' short' if short else ''}")])

    def date(self, m: re.Match) -> str | None:
        g = m.groupdict()
        if "m" in g:
            made, width = self._moved(int(g["y"]), int(g["m"]), int(g["d"])), min(len(g["m"]), len(g["d"]))
            return made and f"{made.year:04}{g['s']}{made.month:0{width}}{g['s']}{made.day:0{width}}"
        if "a" in g:
            first, second, year, short = int(g["a"]), int(g["b"]), int(g["y"]), len(g["y"]) == 2
            year = FIRST_SHORT + (year - FIRST_SHORT) % 100 if short else year
            day_first, width = second <= 12, min(len(g["a"]), len(g["b"]))
            made = self._moved(year, *((second, first) if day_first else (first, second)), short)
            if made is None:
                return None
            one, two = (made.day, made.month) if day_first else (made.month, made.day)
            return f"{one:0{width}}{g['s']}{two:0{width}}{g['s']}{made.year % 100 if short else made.year:0{len(g['y'])}}"
        language = next(k for k in MONTHS if g.get(k))
        name = g[language]
        made = self._moved(int(g["y"]), 1 + MONTHS[language].index(name.lower()), int(g["d"]))
        if made is None:
            return None
        month = MONTHS[language][made.month - 1]
        month = month.upper() if name.isupper() else month.capitalize() if name[0].isupper() else month
        day = f"{made.day:02}" if g["d"][0] == "0" else str(made.day)
        if g.get("o"):
            day += "th" if made.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(made.day % 10, "th")
        head, tail = (month, day) if m.start(language) < m.start("d") else (day, month)
        return f"{head}{g['s']}{tail}{g['t']}{made.year:04}"

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of what was replaced, in order."""
        if not _HINT.search(text):
            return text, []
        spans: list[tuple[int, int, str, str]] = []
        for kind, pattern in ((k, p) for k, ps in PATTERNS.items() for p in ps):
            if kind == "email" and "@" not in text or kind == "ip6" and text.count(":") < 2:
                continue
            for m in pattern.finditer(text):
                (a, z), at = m.span(), bisect_left(spans, (m.start(),))
                if (at == len(spans) or z <= spans[at][0]) and (at == 0 or spans[at - 1][1] <= a) and (made := getattr(self, kind)(m)) is not None:
                    spans.insert(at, (a, z, made, kind))
        if not spans:
            return text, []
        out, at = [], 0
        for a, b, made, _ in spans:
            out += [text[at:a], made]
            at = b
        return "".join(out) + text[at:], [s[3] for s in spans]


#: No kind is without an at-sign or two digits with no more than two other characters between them.
_HINT = re.compile(r"@|\d[^\w\n]{0,2}\d")
_random: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting; without one a random key, which links values within this application only."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _random.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymised(docs: DataFrame, key: bytes, text_column: str = "text", undo: bool = False, kinds: str | None = None) -> DataFrame:
    """docs with the text replaced. kinds: name of a further column, the array of kinds replaced, in order."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + (f", `{kinds}` array<string>" if kinds else "")
    at = names.index(text_column)

    def run(batches):
        pseudonyms = Pseudonyms(key, undo)
        for b in small(batches):
            done = [(None, []) if t is None else pseudonyms.replace(t) for t in b.column(at).to_pylist()]
            columns = [b.column(i) if i != at else pa.array([d[0] for d in done], pa.string()) for i in range(len(names))]
            if kinds:
                columns.append(pa.array([d[1] for d in done], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [*names, kinds] if kinds else names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymised(docs, session_key(spark), kinds="kinds").select("doc_id", "text", F.size("kinds").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))
