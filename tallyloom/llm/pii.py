"""PII by anchor expansion.

One Aho-Corasick automaton finds short anchors (at-signs, URL schemes, ``+``
before a digit, digit-dot and digit-digit pairs, account cues). A deterministic
local parser then expands each anchor to its boundaries and validates it.

Base kinds (exactly the spans of the stated patterns, leftmost and not
overlapping within a kind; a match that fails its test is dropped and its text
is not tried again):

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``     four dotted digit groups, each at most 255
* ``card``   ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass Luhn
* ``phone``  ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

Added kinds: ``account`` and ``login`` (user information in a URL,
``scheme://user:secret@``). Accounts are IBANs with valid check digits, found from the
cue ``IBAN`` or from two capitals and two digits that begin a word, and numbers after a cue
of ``CUES``: from ``CUE_GAP`` characters on at most, 6 to 20 digits in groups apart by
single spaces, hyphens or dots, whole words only.

Null text: an empty text, so no spans and masked null stays null. Null ids,
repeated rows and ties need no special care: each row is treated alone. Extra
columns are ignored by :func:`detect` and kept by :func:`mask`. Empty table: no rows. Texts are
read whole, however long: each must fit in a task as a row does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.llm import vectext as V

#: Kinds, in the order used for equal starts.
KINDS = ("email", "ip", "card", "phone", "account", "login")
BASE = KINDS[:4]

#: Identifier cues, in lower case, whose number is an account.
CUES = ("account", "acct", "a/c", "iban", "ssn", "social security", "passport", "tax id", "konto", "compte", "cuenta", "conto")
CUE_GAP = 16

_DIGIT = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_PHONE = frozenset(" ().0123456789-")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALNUM = _UPPER | _DIGIT
_LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_WORD = _LETTER | _DIGIT | {"_"}
_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._~%!$&'*+,;=:-")


@lru_cache(maxsize=None)
def automaton() -> ahocorasick.Automaton:
    """Anchors to (kind, distance from the anchor's last character to where its parser starts)."""
    a = ahocorasick.Automaton()
    found: dict[str, list] = {}
    for d in sorted(_DIGIT):
        found.setdefault("+" + d, []).append(("phone", 1))
        found.setdefault(d + ".", []).append(("ip", 1))
        for e in sorted(_DIGIT):
            for gap in ("", " ", "-"):
                found.setdefault(d + gap + e, []).append(("card", 1 + len(gap)))
    found.setdefault("@", []).append(("email", 0))
    for scheme in ("://",):
        found.setdefault(scheme, []).append(("login", 0))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.setdefault(form, []).append(("account", -1))
    for word, value in found.items():
        a.add_word(word, tuple(value))
    a.make_automaton()
    return a


def _email(t: str, at: int, floor: int) -> tuple[int, int] | None:
    a = at
    while a > floor and t[a - 1] in _LOCAL:
        a -= 1
    if a == at:
        return None
    n, b, end = len(t), at + 1, 0
    while b < n and t[b] in _LABEL:
        b += 1
    if b == at + 1:
        return None
    while b + 1 < n and t[b] == "." and t[b + 1] in _LABEL:
        b += 2
        while b < n and t[b] in _LABEL:
            b += 1
        end = b
    return (a, end) if end else None


def _ip(t: str, dot: int, floor: int) -> tuple[int, int, bool] | None:
    """The dot of the first digit-dot pair gives the first group; three more must follow."""
    a = dot
    while a > floor and t[a - 1] in _DIGIT:
        a -= 1
    if a == dot:
        return None
    n, b = len(t), dot
    parts = [t[a:dot]]
    for _ in range(3):
        if not (b + 1 < n and t[b] == "." and t[b + 1] in _DIGIT):
            return None
        c = b + 1
        while c < n and t[c] in _DIGIT:
            c += 1
        parts.append(t[b + 1 : c])
        b = c
    return a, b, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _card(t: str, a: int) -> tuple[int, int, bool]:
    n, b, digits = len(t), a + 1, [t[a]]
    while b < n:
        if t[b] in _DIGIT:
            digits.append(t[b])
            b += 1
        elif t[b] in " -" and b + 1 < n and t[b + 1] in _DIGIT:
            digits.append(t[b + 1])
            b += 2
        else:
            break
    return a, b, 14 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(t: str, a: int) -> tuple[int, int, bool] | None:
    n, b = len(t), a + 2
    while b < n and t[b] in _PHONE:
        b += 1
    while b > a + 3 and t[b - 1] not in _DIGIT:
        b -= 1
    if b <= a + 3 or t[b - 1] not in _DIGIT:
        return None
    return a, b, 10 <= sum(c in _DIGIT for c in t[a:b]) <= 15


def _iban(t: str, a: int) -> tuple[int, int] | None:
    """An IBAN from ``a`` on, the longest with valid check digits; groups may be apart by a space."""
    n, b, got, best = len(t), a, [], None
    while b < n and len(got) < 34:
        if t[b] in _ALNUM:
            got.append(t[b])
            b += 1
            if len(got) >= 15 and int("".join(str(int(c, 36)) for c in got[4:] + got[:4])) % 97 == 1 and not (b < n and t[b] in _WORD):
                best = b
        elif t[b] == " " and b + 1 < n and t[b + 1] in _ALNUM:
            b += 1
        else:
            break
    return (a, best) if best else None


def _begins_iban(t: str, a: int) -> bool:
    return a >= 0 and t[a] in _UPPER and t[a + 1 : a + 2] in _UPPER and t[a + 2 : a + 3] in _DIGIT and t[a + 3 : a + 4] in _DIGIT and not (a and t[a - 1] in _WORD)


def _account(t: str, a: int) -> tuple[int, int] | None:
    """The first IBAN or number that begins a word within ``CUE_GAP`` characters after a cue."""
    n = len(t)
    if a < n and t[a] in _LETTER:  # the cue is part of a longer word
        return None
    for b in range(a, min(n, a + CUE_GAP)):
        if t[b - 1] in _WORD:
            continue
        if _begins_iban(t, b) and (got := _iban(t, b)):
            return got
        if t[b] in _DIGIT:
            end, digits = b, 0
            while end < n and (t[end] in _DIGIT or (t[end] in " -." and end + 1 < n and t[end + 1] in _DIGIT)):
                digits += t[end] in _DIGIT
                end += 1
            return (b, end) if 6 <= digits <= 20 and not (end < n and t[end] in _WORD) else None
    return None


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind."""
    out: list[tuple[int, int, str]] = []
    floor = dict.fromkeys(KINDS, 0)
    for end, hits in automaton().iter(text):
        for kind, back in hits:
            at = end - back
            if kind == "email":
                if at >= floor[kind] and (m := _email(text, at, floor[kind])):
                    out.append((*m, kind))
                    floor[kind] = m[1]
            elif kind == "ip":
                if at >= floor[kind] and (m := _ip(text, end, floor[kind])):
                    floor[kind] = m[1]
                    if m[2]:
                        out.append((m[0], m[1], kind))
            elif kind == "card":
                if at >= floor[kind]:
                    m = _card(text, at)
                    floor[kind] = m[1]
                    if m[2]:
                        out.append((m[0], m[1], kind))
                # Two digits after two capitals begin an IBAN, cue or not.
                if back == 1 and at - 2 >= floor["account"] and _begins_iban(text, at - 2) and (m := _iban(text, at - 2)):
                    out.append((*m, "account"))
                    floor["account"] = m[1]
            elif kind == "phone":
                if at >= floor[kind] and (m := _phone(text, at)):
                    floor[kind] = m[1]
                    if m[2]:
                        out.append((m[0], m[1], kind))
            elif kind == "account":
                if at >= floor[kind] and (m := _account(text, at)) and m[0] >= floor[kind]:
                    out.append((*m, kind))
                    floor[kind] = m[1]
            else:
                a, b = at + 1, at + 1
                while b < len(text) and text[b] in _USER:
                    b += 1
                if b < len(text) and text[b] == "@" and ":" in text[a:b] and a < b:
                    out.append((a, b, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in V.slices(batches, 1):
        counts, sha, every = [[] for _ in BASE], [], []
        for text in batch.column(1):
            text = text.as_py()
            found = spans(text) if text else []
            said = [f"{k}:{a}:{b}" for a, b, k in found]
            base = ",".join(s for s, f in zip(said, found) if f[2] in BASE)
            for n, k in zip(counts, BASE):
                n.append(sum(f[2] == k for f in found))
            sha.append(hashlib.sha256(base.encode()).hexdigest() if base else empty)
            every.append(",".join(said))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(n, pa.int64()) for n in counts), pa.array(sha, pa.string()), pa.array(every, pa.string())], names=SCHEMA.fieldNames())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of the base kinds, their digest, and all spans.

    A map over the scan without a shuffle; each text is read once.
    """
    return docs.select(id_col, text_col).mapInArrow(_digest, SCHEMA)


def masked(text: str) -> str:
    """Spans replaced by ``<KIND>``; of overlapping spans the union is replaced, named by the first."""
    out, at = [], 0
    for a, b, kind in spans(text):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by tags; all other columns stay.

    ``chars_col`` names a column that is set to the new length in code points.
    A null text stays null (and so does its length).
    """
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    count_at = schema.fieldNames().index(chars_col) if chars_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, at):
            columns = list(batch.columns)
            new = [masked(x) if (x := v.as_py()) else x for v in columns[at]]
            columns[at] = pa.array(new, columns[at].type)
            if count_at is not None:
                columns[count_at] = pa.array([None if x is None else len(x) for x in new], columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
