"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and reports anchors: at-signs,
schemes, identifier cues, plus signs and digits. A deterministic parser per kind grows a
span around its anchor and validates it:

* email: the longest run of local-part characters before an at-sign and a dotted domain after it;
* ip, card, phone: the longest form from the anchor on; a form that fails its check (parts up
  to 255, Luhn over 12 to 19 digits, 9 to 15 digits) is passed over whole, without a retry;
* url (added): a scheme with a dotted host, up to the first character that ends an address;
* account (added): after a cue such as IBAN, SSN or account, a number that its own rules accept.

Spans of one kind don't overlap and go from left to right. Positions are code points, ends
exclusive. Defined results: a null text counts as empty and has no spans; rows are treated one
by one, so null ids and repeated rows come back as they are; a very long text is searched whole, a match
that spans any part of it included; other columns, whatever their names, are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.shared import map_arrow, slices

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
SPANS = "array<struct<kind: string, start: int, end: int>>"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_HOST = re.compile(r"(?:[^/?#@]*@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#]|$)")
_AFTER_CUE = re.compile(r"(?:[\x20]?(?:no|nr|number|num|id))?[\x20.:#=-]{0,3}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")
_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
_CUES = ("iban", "ssn", "social security", "account", "acct", "routing", "passport", "konto", "compte", "cuenta")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    rest = 0
    for c in turned:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def build_automaton():  # noqa: ANN201
    """The automaton of all anchors; each carries its kind and its length."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    for s in (*_SCHEMES, *map(str.upper, _SCHEMES)):
        a.add_word(s, ("s", len(s)))
    for c in _CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("c", len(c)))
    a.make_automaton()
    return a


def _account(text: str, at: int) -> int | None:
    """End of a number that the rules of some account accept, at ``at``."""
    for form, ok in ((_IBAN, _iban_ok), (_SSN, lambda t: True), (_NUMBER, lambda t: True)):
        m = form.match(text, at)
        if not m:
            continue
        if form is not _IBAN:
            return m.end()
        found = m.group()
        while len(found.replace(" ", "")) >= 15:  # the longest valid number; text may go on in capitals
            if ok(found):
                return at + len(found)
            found = found[:-1].rstrip(" ")
    return None


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """(start, kind, end) of all spans of one text, sorted."""
    out: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may start
    for last, (anchor, length) in automaton.iter(text):
        at = last - length + 1
        if anchor == "0":
            if at >= free["ip"]:
                m = _IP.match(text, at)
                if m:
                    free["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                        out.append((at, 1, m.end()))
                else:
                    free["ip"] = _DIGITS.match(text, at).end()  # no later digit of this run can start one either
            if at >= free["card"]:
                m = _CARD.match(text, at)
                if m:
                    free["card"] = m.end()
                    if 12 <= m.end() - at <= 38:
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            out.append((at, 2, m.end()))
        elif anchor == "@":
            m = _DOMAIN.match(text, at + 1)
            if m:
                start = at
                while start > free["email"] and _LOCAL.match(text, start - 1):
                    start -= 1
                if start < at:
                    free["email"] = m.end()
                    out.append((start, 0, m.end()))
        elif anchor == "+":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                free["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((at, 3, m.end()))
        elif anchor == "s":
            if at >= free["url"] and (m := _ADDRESS.match(text, last + 1)):
                rest = m.group().rstrip(".,;:!?)")
                if _HOST.match(rest):
                    free["url"] = last + 1 + len(rest)
                    out.append((at, 4, free["url"]))
        elif at >= free["account"] and (at == 0 or not text[at - 1].isalpha()):
            begin = _AFTER_CUE.match(text, last + 1).end()
            end = _account(text, begin)
            if end is not None:
                free["account"] = end
                out.append((begin, 5, end))
    out.sort()
    return out


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the spans of each row as an array of (kind, start, end), by start, then kind as in KINDS."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for part in slices(batches, "text"):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, automaton)] if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, kernel, f"doc_id long, spans {SPANS}")


def mask_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; of spans that overlap the first, then the longest counts."""
    schema = docs.schema

    def masked(text: str | None, automaton) -> str | None:  # noqa: ANN001
        if not text:
            return text
        out, at = [], 0
        for start, kind, end in sorted(find_spans(text, automaton), key=lambda s: (s[0], -s[2])):
            if start >= at:
                out += [text[at:start], f"<{KINDS[kind].upper()}>"]
                at = end
        return "".join([*out, text[at:]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for part in slices(batches, text_col):
            i = part.schema.get_field_index(text_col)
            new = pa.array([masked(t, automaton) for t in part.column(i).to_pylist()], part.schema.field(i).type)
            yield part.set_column(i, part.schema.field(i), new)

    return map_arrow(docs, kernel, schema)


def listed(spans: str, kinds: tuple[str, ...] = KINDS):  # noqa: ANN201
    """The column ``spans`` as kind:start:end joined by commas, of some kinds only."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds != KINDS else F.col(spans)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
