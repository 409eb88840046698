"""Format-preserving pseudonyms for personal data.

Numbers and dates that validate (card numbers by their check digit, dates by the calendar, addresses by their octets, ...) are
numbered within their format, permuted by a keyed Feistel network that walks until it is back in the format, and written
back with the separators of the original.  Equal values get equal pseudonyms in every document, and a pseudonym
validates like the value it stands for.
"""

from __future__ import annotations

import datetime
import hmac
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from claimloom.llm.common import arrow_map

ROUNDS = 8
# The formats of the kinds of personal data, in ASCII digits; digits of other scripts are no part of them.
PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![\w.+])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![\w]|[./-][0-9])"
    r"|(?<![\w.+-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w]|-[0-9])"
    r"|(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])"
    r"|(?<!\w)(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4})(?!\w|[.-][0-9])"
    r"|(?<![\w.+-])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![\w]|-[0-9])"
)
# Groups in which card numbers are written; a number in one group is another.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5)}
# Country codes of one and two digits; all others have three.
CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
# end of fixed values
_MAYBE = re.compile(r"@|[0-9][0-9 ./()-]{4,}[0-9]")
_RUN, _FIRST = re.compile(r"[0-9]+"), re.compile(r"[^0-9]*[0-9]+")
# Characters around a number in which others can begin or end that share digits with it.
REACH = 48


class Feistel:
    """Keyed permutation of 0..size-1 for any size: a two-sided network on a rectangle, walked until it is inside."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _mix(self, tweak: str, turn: int, side: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}:{turn}:{side}".encode(), "sha256")[:16], "big")

    def permute(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda x: True) -> int:
        wide = max(1, int(size**0.5))
        high = -(-size // wide)
        while True:
            left, right = divmod(value, wide)
            for turn in range(self.rounds):
                if turn % 2:
                    right = (right + self._mix(tweak, turn, left)) % wide
                else:
                    left = (left + self._mix(tweak, turn, right)) % high
            value = left * wide + right
            if value < size and valid(value):
                return value

    def restore(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda x: True) -> int:
        """The inverse of :meth:`permute`."""
        wide = max(1, int(size**0.5))
        high = -(-size // wide)
        while True:
            left, right = divmod(value, wide)
            for turn in reversed(range(self.rounds)):
                if turn % 2:
                    right = (right - self._mix(tweak, turn, left)) % wide
                else:
                    left = (left - self._mix(tweak, turn, right)) % high
            value = left * wide + right
            if value < size and valid(value):
                return value


def luhn(digits: str) -> bool:
    return check_digit(digits[:-1]) == digits[-1]


def check_digit(digits: str) -> str:
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(int(c) for c in reversed(digits)))
    return str(-total % 10)


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if "0" <= c <= "9" else c for c in text)


def _card_span(m: re.Match) -> tuple[int, int] | None:
    """The longest valid number of whole digit groups in a match; usual groups go first, since others are valid by chance."""
    runs = [r.span() for r in _RUN.finditer(m.string, *m.span())]
    sizes = [b - a for a, b in runs]
    spans = []
    for i in range(len(runs)):
        for j in range(i + 1, len(runs) + 1):
            if 13 <= (total := sum(sizes[i:j])) <= 19:
                usual = j - i == 1 or tuple(sizes[i:j]) in CARD_GROUPS
                spans.append((not usual, -total, runs[i][0], runs[j - 1][1]))
    return next(((a, b) for *_, a, b in sorted(spans) if luhn(re.sub(r"[^0-9]", "", m.string[a:b]))), None)


def _phone_span(m: re.Match) -> tuple[int, int] | None:
    """The longest number of whole digit groups in a match; ten digits after +1 go first."""
    code = CODE.match(re.sub(r"[^0-9]", "", m[0]))[0]
    ends, n = [], -len(code)
    for r in _RUN.finditer(m.string, *m.span()):
        n += len(r[0])
        if 6 <= n <= 13:
            ends.append((code == "1" and n == 10, n, r.end()))
    return (m.start(), max(ends)[-1]) if ends else None


_NUMBERS = {"card": _card_span, "phone": _phone_span}


def _always(text: str) -> bool:
    return True


def _same(text: str, lead: int, kind: str, start: int, end: int) -> Callable[[str], bool]:
    """Whether the same place is found again with other digits in it, so that the way back finds it."""
    base = max(0, lead - 1)
    before, after = text[base:start], text[end : end + REACH]

    def same(new: str) -> bool:
        pos, whole = lead - base, before + new + after
        while m := PATTERN.search(whole, pos):
            if m.lastgroup in _NUMBERS:
                if span := _NUMBERS[m.lastgroup](m):
                    return (m.lastgroup, *span) == (kind, start - base, end - base)
                pos = _FIRST.match(whole, m.start()).end()
            else:
                pos = m.end()
        return False

    return same if same(text[start:end]) else _always


@dataclass(frozen=True)
class Pseudonyms:
    key: bytes
    back: bool = False

    def _move(self, value: int, size: int, tweak: str, valid=lambda x: True) -> int:
        f = Feistel(self.key)
        return (f.restore if self.back else f.permute)(value, size, tweak, valid)

    def _digits(self, digits: str, tweak: str, valid=lambda s: True) -> str:
        n = len(digits)
        return str(self._move(int(digits), 10**n, f"{tweak}{n}", lambda x: valid(str(x).zfill(n)))).zfill(n)

    def card(self, text: str, same: Callable[[str], bool] = _always) -> str | None:
        digits = re.sub(r"[^0-9]", "", text)
        if not luhn(digits):
            return None
        body = self._digits(digits[:-1], "card", lambda d: same(_refill(text, d + check_digit(d))))
        return _refill(text, body + check_digit(body))

    def ssn(self, text: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = text.replace("-", "")
        return _refill(text, self._digits(digits, "ssn", valid)) if valid(digits) else None

    def ip(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        value = self._move(int.from_bytes(bytes(octets), "big"), 2**32, "ip")
        return ".".join(str(x) for x in value.to_bytes(4, "big"))

    def phone(self, text: str, same: Callable[[str], bool] = _always) -> str | None:
        digits = re.sub(r"[^0-9]", "", text)
        # the code by its digits, so that numbers are equal under other separators
        code = CODE.match(digits)[0]
        rest = digits[len(code):]
        return "+" + _refill(text[1:], code + self._digits(rest, "phone+" + code, lambda d: same("+" + _refill(text[1:], code + d))))

    def date(self, text: str) -> str | None:
        form = "%Y-%m-%d" if text[4] == "-" else f"%d{text[2]}%m{text[5]}%Y"
        for f in (form, form.replace("%d", "%M").replace("%m", "%d").replace("%M", "%m")):
            try:
                day = datetime.datetime.strptime(text, f).date()
            except ValueError:
                continue
            if FIRST_DAY <= day.toordinal() <= LAST_DAY:
                # a date that is read day first stays one that is read day first
                def valid(x: int) -> bool:
                    return f == form or datetime.date.fromordinal(FIRST_DAY + x).day > 12

                moved = self._move(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", valid)
                return datetime.date.fromordinal(FIRST_DAY + moved).strftime(f)
        return None

    def email(self, text: str) -> str | None:
        """The name keeps its classes of characters; the domain stays."""
        name, _, domain = text.partition("@")
        out = list(name)
        for tweak, alphabet in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789")):
            at = [i for i, c in enumerate(name) if c in alphabet]
            if at:
                value = 0
                for i in at:
                    value = value * len(alphabet) + alphabet.index(name[i])
                value = self._move(value, len(alphabet) ** len(at), f"email{tweak}{len(at)}")
                for i in reversed(at):
                    value, d = divmod(value, len(alphabet))
                    out[i] = alphabet[d]
        return "".join(out) + "@" + domain

    def apply(self, text: str) -> tuple[str, list[dict]]:
        """The text with pseudonyms, and what was found (kind, character offsets of the original, pseudonym)."""
        found: list[dict] = []
        if not _MAYBE.search(text):
            return text, found
        out, at, pos, failed = [], 0, 0, None
        while m := PATTERN.search(text, pos):
            kind, (start, end) = m.lastgroup, m.span()
            if kind in _NUMBERS:
                span = _NUMBERS[kind](m)
                if span is None:
                    # numbers that begin within the failed one are not passed over
                    failed = start if failed is None else failed
                    pos = _FIRST.match(text, start).end()
                    continue
                lead = max(at, start if failed is None else failed, span[0] - REACH)
                alone = failed is None and span == (start, end)
                start, end = span
                new = getattr(self, kind)(text[start:end], _always if alone else _same(text, lead, kind, start, end))
            else:
                new = getattr(self, kind)(m[0])
            pos = end
            if new is not None:
                found.append({"kind": kind, "start": start, "end": end, "pseudonym": new})
                out += [text[at:start], new]
                at, failed = end, None
        return "".join(out) + text[at:], found


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """id, n_found, findings, text of every row, in one pass without a shuffle; ``back`` undoes it with the same key.

    A null text stays null and has no findings.  Repeated rows give repeated rows; null ids are kept; other columns are
    ignored; an empty table gives an empty result.  Numbers that do not validate stay as they are; of one with others beside it
    the valid part of whole digit groups is replaced.  Phone numbers without + and country code, or with (0) in them, are not covered.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rule = Pseudonyms(key, back)

    def run(batches):
        for b in batches:
            done = [rule.apply(t) if t is not None else (None, []) for t in b["text"]]
            yield {"id": b["id"], "n_found": [len(f) for _, f in done], "findings": [f for _, f in done], "text": [t for t, _ in done]}

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, n_found int, findings array<struct<kind:string,start:int,end:int,pseudonym:string>>, text string"
    return arrow_map(rows, run, schema).withColumnRenamed("id", id_col)
