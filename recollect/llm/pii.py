"""Personal data: an automaton finds anchors, local parsers expand and validate what is around them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import small, texts

#: Base kinds in their order; the method's own kinds come after them.
KINDS = ("email", "ip", "card", "phone", "url", "account")
LOWER = {c: c + 32 for c in range(65, 91)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"""://[^\x00-\x20"'<>\\^`{|}]+""")
SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"""(?:\x20?(?i:number|no\.?|nr\.?|id))?[\x20:=#"'.-]{1,4}([0-9A-Z](?:[\x20-]?[0-9A-Z]){5,29})""")
#: Words that announce an account or identity number, in any case.
CUES = ("account", "acct", "iban", "ssn", "passport", "routing")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(text: str) -> bool:
    """The country's check digits hold (ISO 7064, modulo 97)."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for anchor in "@+0123456789":
        a.add_word(anchor, anchor if anchor in "@+" else "0")
    a.add_word("://", "/")
    for cue in CUES:
        a.add_word(cue, "c")
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), sorted. Of the base kinds exactly the leftmost non-overlapping matches that pass.

    The automaton runs over the text in lower case, so that a cue is found however it is written."""
    low = text.lower()
    if len(low) != len(text):  # a letter that becomes two
        low = text.translate(LOWER)
    out = []
    n = len(text)
    mail = dotted = spaced = phone = url = account = 0  # where the next match of each may start
    for i, kind in anchors.iter(low):
        if kind == "0":
            # a digit after a digit (card: also after one space or hyphen and a digit) belongs to a run already expanded
            if i >= dotted:
                m = DOTTED.match(text, i)
                dotted = m.end()
                if "." in m[0]:
                    parts, at = m[0].split("."), i
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        size = sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            out.append((at, 1, at + size))
                        at += size + 1
            if i >= spaced:
                m = SPACED.match(text, i)
                spaced = m.end()
                if spaced - i >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((i, 2, spaced))
        elif kind == "@":
            start = i
            while start > mail and text[start - 1] in LOCAL:
                start -= 1
            if start < i and (m := DOMAIN.match(text, i + 1)):
                mail = m.end()
                out.append((start, 0, mail))
        elif kind == "+":
            if i >= phone and (m := PHONE.match(text, i)):
                phone = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((i, 3, phone))
        elif kind == "/":
            start = scheme = i - 2
            while scheme > url and text[scheme - 1] in SCHEME_CHARS:
                scheme -= 1
            while scheme < start and not (text[scheme].isascii() and text[scheme].isalpha()):
                scheme += 1  # a scheme starts with a letter
            m = URL.match(text, start)
            if scheme < start and m:
                end = start + len(m[0].rstrip(".,;:!?)]"))
                if end > start + 3:
                    url = end
                    out.append((scheme, 4, url))
        elif i >= account:
            m = ACCOUNT.match(text, i + 1)
            if m:
                at = m.start(1)
                whole = IBAN.match(text, at)
                if whole and iban(whole[0]):
                    account = whole.end()
                    out.append((at, 5, account))
                else:
                    value = re.match(r"[0-9](?:[\x20-]?[0-9]){5,19}|[A-Z]{1,2}[0-9]{6,9}\b", text[at : min(n, at + 64)])
                    if value:
                        account = at + value.end()
                        out.append((at, 5, account))
    out.sort()
    return out


def personal_data(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in every whole text, one map step with nothing sent between tasks.

    The base kinds email, ip, card and phone are as fixed patterns define them, leftmost non-overlapping each, a match
    that fails its check being dropped; url (a scheme and what follows) and account (a number after a cue; IBANs with their check
    digits) are added. Returns one row for each row of docs: doc_id, spans as array<struct<start, kind, end>> in code points,
    end exclusive, kind a name in KINDS, by start, then by the order of KINDS. Null and empty texts have none; repeated rows each get
    their own; an empty table gives no rows; texts of any length are read whole."""
    source = texts(docs, *carry)
    schema = "doc_id long, spans array<struct<start: int, kind: string, end: int>>" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[2:])

    def run(batches):
        import pyarrow as pa

        anchors = automaton()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for b in small(batches):
            found = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in find(t, anchors)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), *b.columns[2:]], names=["doc_id", "spans", *b.schema.names[2:]])

    return source.mapInArrow(run, schema)
