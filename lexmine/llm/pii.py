"""Personal data by anchors: an Aho-Corasick pass finds what spans are built around, local parsers expand and validate."""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.spans import Reach, digest, span_column

KINDS = ["email", "ip", "card", "phone"]

_AT, _PLUS, _DIGIT, _SCHEME, _IBAN, _SSN, _ACCOUNT = range(7)
# Words before a number that say what it is, and the least and most digits it then has.
_CUES = {
    "social security": _SSN, "ssn": _SSN, "iban": _IBAN, "account": _ACCOUNT, "acct": _ACCOUNT, "konto": _ACCOUNT,
    "compte": _ACCOUNT, "cuenta": _ACCOUNT,
}
_ACCOUNT_DIGITS = (8, 18)

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_USER = re.compile(r"[A-Za-z0-9._~%!$&*+,;=-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_IBAN_TEXT = re.compile(r"[ :=#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN_TEXT = re.compile(r"[^0-9A-Za-z]{0,6}(?:(?:no|nr|number)[^0-9A-Za-z]{1,4})?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.I)
_ACCOUNT_TEXT = re.compile(r"[^0-9A-Za-z]{0,6}(?:(?:no|nr|number)[^0-9A-Za-z]{1,4})?([0-9](?:[ -]?[0-9])+)(?![0-9A-Za-z])", re.I)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_valid(text: str) -> bool:
    """The remainder of ISO 13616: letters as numbers from 10, the first four characters last."""
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def ssn_valid(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in [("@", _AT), ("+", _PLUS), ("://", _SCHEME), *((d, _DIGIT) for d in "0123456789")]:
        automaton.add_word(word, (kind, len(word)))
    for word, kind in _CUES.items():
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


class Finder:
    """The base rules are leftmost, do not overlap within their kind, and drop what fails its test without a retry.

    Added kinds: url (a user or password in an address), iban, ssn and account (a number after its cue). They are kept
    only where they are valid, and where no base span covers them.
    """

    def __init__(self):
        self.anchors = _anchors()

    def __call__(self, text: str) -> list[tuple[str, int, int, bool]]:
        spans: list[tuple[str, int, int, bool]] = []
        added: list[tuple[str, int, int, bool]] = []
        past = dict.fromkeys(("email", "ip", "card", "phone"), 0)
        for last, (kind, length) in self.anchors.iter(text):
            if kind == _DIGIT:
                if last >= past["ip"]:
                    past["ip"] = self._run(text, last, "0123456789.", _IP, "ip", self._ip, spans)
                if last >= past["card"]:
                    past["card"] = self._run(text, last, "0123456789 -", _CARD, "card", self._card, spans)
            elif kind == _AT:
                self._email(text, last, past, spans)
            elif kind == _PLUS:
                found = _PHONE.match(text, last) if last >= past["phone"] else None
                if found:
                    past["phone"] = found.end()
                    if 8 <= sum(c.isdigit() and c.isascii() for c in found.group()) <= 15:
                        spans.append(("phone", last, found.end(), True))
            else:
                self._cue(text, last - length + 1, last + 1, kind, added)
        return spans + self._uncovered(added, spans)

    @staticmethod
    def _run(text: str, at: int, characters: str, pattern: re.Pattern, kind: str, valid: Callable[[str], bool], spans: list) -> int:
        """All matches in the run of `characters` that begins with the digit at `at`; where that run ends."""
        end = at
        while end < len(text) and text[end] in characters:
            end += 1
        spans += [(kind, m.start(), m.end(), True) for m in pattern.finditer(text, at, end) if valid(m.group())]
        return end

    @staticmethod
    def _ip(text: str) -> bool:
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))

    @staticmethod
    def _card(text: str) -> bool:
        digits = text.replace(" ", "").replace("-", "")
        return 16 <= len(digits) <= 19 and luhn(digits)

    @staticmethod
    def _email(text: str, at: int, past: dict, spans: list) -> None:
        start = at
        while start > past["email"] and _LOCAL_BACK.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append(("email", start, found.end(), True))
            past["email"] = found.end()
        else:
            past["email"] = max(past["email"], at + 1)

    @staticmethod
    def _cue(text: str, start: int, end: int, kind: int, added: list) -> None:
        if kind == _SCHEME:
            begin = start
            while begin > 0 and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "+.-"):
                begin -= 1
            found = _URL_USER.match(text, end) if begin < start else None
            if found:
                added.append(("url", begin, found.end(), False))
            return
        if start > 0 and text[start - 1].isalpha():
            return
        if kind == _IBAN:
            found = _IBAN_TEXT.match(text, end)
            if found:  # a following word in capitals may have been taken in: shorten at blanks until it is valid
                body = found.group(1)
                while not iban_valid(body) and " " in body:
                    body = body[:body.rindex(" ")]
                if iban_valid(body):
                    added.append(("iban", found.start(1), found.start(1) + len(body), False))
        elif kind == _SSN:
            found = _SSN_TEXT.match(text, end)
            if found and ssn_valid(found.group(1)):
                added.append(("ssn", found.start(1), found.end(1), False))
        else:
            found = _ACCOUNT_TEXT.match(text, end)
            if found:
                digits = sum(c.isdigit() for c in found.group(1))
                if _ACCOUNT_DIGITS[0] <= digits <= _ACCOUNT_DIGITS[1]:
                    added.append(("account", found.start(1), found.end(1), False))

    @staticmethod
    def _uncovered(added: list, spans: list) -> list:
        if not added:
            return []
        base, last, out = Reach((s[1], s[2]) for s in spans), {}, []
        for span in sorted(set(added), key=lambda s: (s[1], s[0], -s[2])):
            if base.before(span[1] + 1) < span[2] and last.get(span[0], 0) <= span[1]:
                out.append(span)
                last[span[0]] = span[2]
        return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row; a null or empty text has none.

    Whole texts are searched. Repeated rows and null ids give rows like any other; other columns are not read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), span_column(F.col(text_col), Finder).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    return digest(find_pii(docs), KINDS, by_kind=True)
