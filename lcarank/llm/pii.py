"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Each proposal of a kind starts with the kind's prior. A validator that passes (parts of an IPv4
address, Luhn for cards, mod-97 for IBANs, digit counts for phones) adds CONFIRMED, a context word
of the kind within CONTEXT code points on either side adds NEARBY. Spans that reach THRESHOLD stay.
Kinds with a validator must pass it: a failing match is dropped and not retried. The four base kinds
reach the threshold by the validator alone; ``phone_local`` (a national number without ``+``) has no
checksum and needs a context word, ``iban`` needs its checksum. An IBAN ends at the length of its
country (IBAN_LENGTHS), so that a following word in capitals stays out; the scan goes on from there.

Secrets: ``private_key`` is a PEM block (to the end of its header if nothing ends it), ``key`` a token of a
provider's own form, ``secret`` the value behind a word like "password" or "token" and "=" or ":", of 8
characters or more with a letter and a digit, ``hex_key`` 32 hexadecimal digits or more, which need a context
word. ``national_id``: Spanish DNI and NIE (letter by mod 23), French NIR (mod 97) and German tax numbers (ISO 7064
mod 11, 10), which need checksum and context word, and US social security numbers, which need the word.

Null and empty texts have no spans. Repeated rows give repeated results. Any text length works: every
pattern is scanned in time linear in the text. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcarank.llm.common import arrow_rows, id_and_text, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "phone_local", "private_key", "key", "secret", "hex_key", "national_id")
THRESHOLD, CONFIRMED, NEARBY, CONTEXT = 0.6, 0.4, 0.25, 48
PRIOR = {"email": 0.6, "ip": 0.3, "card": 0.3, "phone": 0.3, "iban": 0.3, "phone_local": 0.4,
         "private_key": 0.6, "key": 0.6, "secret": 0.6, "hex_key": 0.4, "national_id": 0.15}
#: A social security number has no checksum to confirm it.
UNCHECKED = 0.4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24
DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27
JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29
PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}
_PHONE_LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])")
_BEGIN_KEY, _END_KEY = (re.compile(rf"-----{x} (?:[A-Z0-9]+ ){{0,3}}PRIVATE KEY-----") for x in ("BEGIN", "END"))
# FIXED VALUES: beginnings and lengths of providers' keys.
_KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"
                  r"|xox[abeprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}"
                  r"|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:password|passwd|passphrase|pwd|secret|token|credential|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|auth[\x20_-]?key"
                     r"|contraseña|mot[\x20]de[\x20]passe|passwort|kennwort)[\"']?[\x20\t]{0,3}(?:=>|:=|=|:)[\x20\t]{0,3}[\"']?([^\s\"'<>,;]{8,})")
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![A-Za-z0-9.-])(?:[0-9]{8}-?[A-Z]|[XYZ]-?[0-9]{7}-?[A-Z]|[0-9]{11}|[12][0-9]{14}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]+")

WORDS_NEAR = {
    "email": frozenset("email mail contact write courriel correo".split()),
    "ip": frozenset("ip address host server login adresse".split()),
    "card": frozenset("card credit debit visa mastercard amex payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax telefon handy portable teléfono móvil".split()),
    "iban": frozenset("iban account bank konto compte cuenta transfer".split()),
    "phone_local": frozenset("phone tel telephone call mobile fax cell dial telefon handy teléfono".split()),
    "private_key": frozenset(), "key": frozenset(), "secret": frozenset(),
    "hex_key": frozenset("key keys token secret password apikey credential credentials auth bearer api clave clé schlüssel".split()),
    "national_id": frozenset("dni nie nif nir insee ssn steuer steuernummer identifikationsnummer idnr social security sociale identity identidad ausweis tax".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _dni(code: str) -> bool:
    digits = code[:-1].translate(str.maketrans("XYZ", "012"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == code[-1]


def _german_tax_number(digits: str) -> bool:
    left = 10
    for c in digits[:-1]:
        left = (left + int(c)) % 10 or 10
        left = left * 2 % 11
    return digits[0] != "0" and (11 - left) % 10 == int(digits[-1])


def _national_id(code: str) -> bool | None:
    """Whether the checksum of a national number holds; None: it has none, but the number may exist."""
    if len(code) == 11 and code[3:4] == "-":
        area, group, serial = code.split("-")
        return None if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else False
    code = code.replace("-", "")
    if code[-1].isalpha():
        return _dni(code)
    if len(code) == 15:
        return 97 - int(code[:13]) % 97 == int(code[13:])
    return _german_tax_number(code)


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    at, ends = 0, True
    while m := _BEGIN_KEY.search(text, at):
        end = _END_KEY.search(text, m.end()) if ends else None
        ends, at = end is not None, end.end() if end else m.end()
        yield m.start(), at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The local part cannot hold "@", so each "@" has one candidate: the run before it.
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        found, at = m.group(), m.end()
        n = IBAN_LENGTHS.get(found[:2])
        if n is not None:
            ends = [i + 1 for i, c in enumerate(found) if c != " "]
            cut = ends[n - 1] if len(ends) >= n else 0
            if not cut or found[cut:cut + 1].isalnum():  # too short, or it ends within a word
                continue
            found, at = found[:cut], m.start() + cut
        if 15 <= len(code := found.replace(" ", "")) <= 34 and mod97(code):
            yield m.start(), at


def _digits(s: str) -> str:
    return _NON_DIGIT.sub("", s)


def proposals(text: str) -> Iterator[tuple[str, int, int, bool | None]]:
    """(kind, start, end, confirmed) of the matches whose validator does not reject them; None: it cannot tell."""
    for s, e in _emails(text):
        yield "email", s, e, True
    if "PRIVATE KEY-----" in text:
        for s, e in _private_keys(text):
            yield "private_key", s, e, False
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                yield "ip", m.start(), m.end(), True
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end(), True
    for s, e in _ibans(text):
        yield "iban", s, e, True
    for m in _PHONE_LOCAL.finditer(text):
        yield "phone_local", m.start(), m.end(), False
    for m in _KEY.finditer(text):
        yield "key", m.start(), m.end(), False
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if _DIGIT.search(m[1]) and _LETTER.search(m[1]):
                yield "secret", m.start(1), m.end(1), False
    for m in _HEX.finditer(text):
        if _LETTER.search(m.group()) and _DIGIT.search(m.group()):
            yield "hex_key", m.start(), m.end(), False
    for m in _NATIONAL.finditer(text):
        if (ok := _national_id(m.group())) is not False:
            yield "national_id", m.start(), m.end(), ok


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of KINDS."""
    found = []
    for kind, s, e, confirmed in proposals(text or ""):
        score = UNCHECKED if confirmed is None else PRIOR[kind] + CONFIRMED * confirmed
        near = text[max(0, s - CONTEXT):s] + " " + text[e:e + CONTEXT]
        if not WORDS_NEAR[kind].isdisjoint(_WORD.findall(near.lower())):
            score += NEARBY
        if score >= THRESHOLD:
            found.append((kind, s, e, min(1.0, score)))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return found


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id and ``spans``, an array of (kind, start, end, score) by start."""

    def run(ids: pa.Array, texts: list) -> dict:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_spans(t)] for t in texts]
        return {"id": ids, "spans": pa.array(spans, kind)}

    source = id_and_text(df, id_col, text_col, binary=False)
    return arrow_rows(source, run, f"id {source.schema['id'].dataType.simpleString()}, spans array<{SPAN}>") \
        .withColumnRenamed("id", id_col)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its kind in angle brackets, one per run of
    overlapping spans; a null text stays null. All other columns and rows are as they were."""

    @F.pandas_udf("string")
    def masked(texts):
        def one(t):
            if not t or not (spans := find_spans(t)):
                return t
            parts, at = [], 0
            for kind, s, e, _ in spans:
                if s >= at:
                    parts += [t[at:s], f"<{kind}>"]
                at = max(at, e)
            return "".join([*parts, t[at:]])
        return texts.map(one, na_action="ignore")

    return small_batches(df).withColumn(text_col, masked(F.col(f"`{text_col}`")))


def digest(df: DataFrame) -> DataFrame:
    """The registered query's columns, from ``pii_spans``."""
    spans = pii_spans(df)
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return spans.select("doc_id", *count, F.sha2(spans_text(base), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
