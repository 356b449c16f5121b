"""Detectors of personal identifiers: a text column gives an array of spans. Offsets count code points.

Patterns have no nested repetition, so a match takes no deep recursion and bounded steps at each place; the work over a
text is in proportion to its length and its matches.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import NUMBER_PLANS, PAN_HOLDERS
from .arrays import clusters, let, matches

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9.-]"
#: A run of local characters, a run of domain characters with alphabetic last label; dots and hyphens are checked by looking
#: ahead: no dot at an end of the local part, no empty label, no label with a hyphen at an end.
EMAIL = (
    rf"(?<!{_LOCAL})(?!\.)(?!{_LOCAL}{{0,62}}\.\.){_LOCAL}{{1,64}}+(?<!\.)@"
    rf"(?![.-])(?!{_DOMAIN}{{0,252}}(?:\.[.-]|-\.)){_DOMAIN}{{4,252}}+(?<=\.[A-Za-z]{{2,250}})(?![_%+A-Za-z0-9-])"
)
#: A plus or an area code in brackets, then digits and what people put between them, a digit at the end.
PHONE = r"(?<!\d)[+]?(?:[(](?=\d{1,4}[)]))?\d[\d\s().-]{7,32}(?<=\d)(?!\d)"
#: One written form of a number of plan 1, with what stands before and after it: two numbers don't share the character between them.
NANP = r"(?:^|[^0-9])\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?:\z|[^0-9])"
#: The forms of the two numbers. Twelve digits in fours, the first from 2 to 9; five letters, four digits, a letter.
AADHAAR = r"(?<!\d)[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}(?!\d)"
PAN = r"(?<![A-Za-z0-9])[A-Za-z]{5}\d{4}[A-Za-z](?![A-Za-z0-9])"

_RUN = "array<struct<raw:string,start:int,end:int>>"
_NUMBERED = "array<struct<raw:string,start:int,end:int,number:string>>"
SPAN = "array<struct<type:string,raw:string,normalized:string,confidence:double,provenance:array<string>,start:int,end:int>>"

#: Products of the dihedral group of order ten: two rotations add, a reflection turns the second round.
_D = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
#: The permutation that is applied once more at each place.
_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
_P = [list(range(10))]
for _ in range(7):
    _P.append([_STEP[x] for x in _P[-1]])


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their offsets (raw, start, end)."""
    return matches(text, pattern)


def _span(kind: str, s: Column, normalized: Column, confidence: Column, provenance: Column | None = None) -> Column:
    made_by = F.array(F.lit("regex")) if provenance is None else provenance
    return F.struct(F.lit(kind).alias("type"), s["raw"].alias("raw"), normalized.alias("normalized"), confidence.cast("double").alias("confidence"), made_by.alias("provenance"), s["start"].alias("start"), s["end"].alias("end"))


def _gated(found: Column, maybe: Column) -> Column:
    """The expensive patterns run only over texts that pass a cheap test."""
    return F.when(maybe, found).otherwise(F.array().cast(SPAN))


def emails(text: Column) -> Column:
    fits = F.filter(spans(text, EMAIL), lambda s: (F.length(s["raw"]) <= 254) & (F.instr(s["raw"], "@") <= 65))
    return _gated(F.transform(fits, lambda s: _span("EMAIL", s, F.lower(F.trim(s["raw"])), F.lit(0.95))), F.contains(text, F.lit("@")))


def e164(raw: Column, default: str = "91") -> Column:
    """A phone number in international form, or null if no numbering plan has it. Without a plus sign it is of the default country."""
    digits = F.regexp_replace(raw, r"\D", "")
    national = F.regexp_replace(digits, "^0", "")
    tries = []
    for code in sorted(NUMBER_PLANS, key=len, reverse=True):
        rest = F.regexp_replace(F.substring(digits, len(code) + 1, 20), "^0", "")
        tries.append(F.when(F.ltrim(raw).startswith("+") & digits.startswith(code) & rest.rlike(f"^(?:{NUMBER_PLANS[code]})$"), F.concat(F.lit("+" + code), rest)))
    plan, code = NUMBER_PLANS[default], default
    bare = F.substring(digits, len(code) + 1, 20)
    local = ~F.ltrim(raw).startswith("+")
    tries.append(F.when(local & national.rlike(f"^(?:{plan})$"), F.concat(F.lit("+" + code), national)))
    tries.append(F.when(local & digits.startswith(code) & bare.rlike(f"^(?:{plan})$"), F.concat(F.lit("+" + code), bare)))
    return F.coalesce(*tries)


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans share a place."""
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def _runs(raw: Column) -> Column:
    """Runs of at most 12 tokens of a span, longest first: raw, start, end inside the span."""

    def made(tokens: Column) -> Column:
        n = F.size(tokens)

        def run(i: Column, k: Column) -> Column:
            a, b = F.get(tokens, i)["start"], F.get(tokens, i + k - 1)["end"]
            return F.struct(F.substring(raw, a + 1, b - a).alias("raw"), a.alias("start"), b.alias("end"))

        by_length = F.transform(F.sequence(n, F.lit(1)), lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: run(i, k)))
        return F.when(n > 0, F.flatten(by_length)).otherwise(F.array().cast(_RUN))

    return let(F.slice(spans(raw, r"\S+"), 1, 12), made)


def phones(text: Column) -> Column:
    """Numbers by span; where the whole span is none, its longest runs of tokens that are, left to right, without overlap."""

    def confidence(s: Column) -> Column:
        return F.when(F.trim(s["raw"]).rlike(r"^91\d{10}$"), 0.80).otherwise(0.95)

    def numbered(runs: Column) -> Column:
        return F.filter(F.transform(runs, lambda r: F.struct(r["raw"].alias("raw"), r["start"].alias("start"), r["end"].alias("end"), e164(r["raw"]).alias("number"))), lambda r: r["number"].isNotNull())

    def parts(s: Column) -> Column:
        valid = numbered(_runs(s["raw"]))
        kept = F.aggregate(valid, F.array().cast(_NUMBERED), lambda acc, r: F.when(F.exists(acc, lambda k: overlaps(k, r)), acc).otherwise(F.concat(acc, F.array(r))))
        return F.transform(kept, lambda r: F.struct(r["raw"].alias("raw"), (s["start"] + r["start"]).alias("start"), (s["start"] + r["end"]).alias("end"), r["number"].alias("number")))

    whole = F.transform(spans(text, PHONE), lambda s: let(numbered(F.array(s)), lambda own: F.when(F.size(own) > 0, own).otherwise(parts(s))))
    found = F.transform(F.flatten(whole), lambda s: _span("PHONE", s, s["number"], confidence(s)))
    return _gated(found, text.rlike(r"\d[\d\s\-().]{6}"))


def nanp_phones(text: Column) -> Column:
    """Numbers of plan 1 in one written form (``NANP``). ``phones`` finds every number in any form, also the second of two with one character between them."""

    def inner(s: Column) -> Column:
        start = F.instr(s["raw"], "+1 (")
        return F.struct(F.substring(s["raw"], start, F.lit(17)).alias("raw"), (s["start"] + start - 1).alias("start"), (s["start"] + start + 16).alias("end"))

    known = F.filter(F.transform(F.transform(spans(text, NANP), inner), lambda s: F.struct(s["raw"].alias("raw"), s["start"].alias("start"), s["end"].alias("end"), e164(s["raw"]).alias("number"))), lambda s: s["number"].isNotNull())
    return _gated(F.transform(known, lambda s: _span("PHONE", s, s["number"], F.lit(0.95))), F.contains(text, F.lit("+1 (")))


#: The products as one string: that of c and x stands at 10 c + x.
_PRODUCTS = "".join(str(x) for row in _D for x in row)
_PERMUTED = ["".join(map(str, row)) for row in _P]


def _fold(digits: Column, shift: int) -> Column:
    """The product of a digit string's permuted digits, from the right; null if something is no digit."""
    each = F.transform(F.split(F.reverse(digits), "(?!$)"), lambda x, i: _permuted(x, (i + shift) % 8))
    return F.aggregate(each, F.lit(0), lambda c, x: F.substring(F.lit(_PRODUCTS), c * 10 + x.cast("int") + 1, F.lit(1)).cast("int"))


def _permuted(x: Column, place: Column) -> Column:
    return F.substring(F.lit("".join(_PERMUTED)), place * 10 + x.cast("int") + 1, F.lit(1))


def checksum_ok(digits: Column) -> Column:
    """Whether a digit string passes the Verhoeff check."""
    return digits.rlike("^[0-9]+$") & (_fold(digits, 0) == 0)


def check_digit(digits: Column) -> Column:
    """The Verhoeff digit to append to a digit string: its product with the string's is 0."""
    inverse = F.lit("".join(str(row.index(0)) for row in _D))
    return F.when(digits.rlike("^[0-9]+$"), F.substring(inverse, _fold(digits, 1) + 1, F.lit(1)).cast("int"))


def aadhaars(text: Column) -> Column:
    digits = lambda s: F.regexp_replace(s["raw"], r"\D", "")
    fits = F.filter(spans(text, AADHAAR), lambda s: ~digits(s).rlike(r"^(\d)\1{11}$"))

    def made(s: Column) -> Column:
        # the check is computed once for each span, and its digits once for the check
        known = lambda d, ok: _span("AADHAAR", s, d, F.when(ok, 0.98).otherwise(0.40), F.when(ok, F.array(F.lit("regex"), F.lit("checksum"))).otherwise(F.array(F.lit("regex"))))
        return let(let(digits(s), lambda d: F.struct(d.alias("d"), checksum_ok(d).alias("ok"))), lambda x: known(x["d"], x["ok"]))

    return _gated(F.transform(fits, made), text.rlike(r"\d{4}[ -]?\d{4}[ -]?\d{4}"))


def pans(text: Column) -> Column:
    holder = lambda s: F.substring(F.upper(s["raw"]), 4, 1).isin(*PAN_HOLDERS)
    return _gated(F.transform(spans(text, PAN), lambda s: _span("PAN", s, F.upper(s["raw"]), F.when(holder(s), 0.95).otherwise(0.60))), text.rlike(r"[A-Za-z]{5}\d{4}[A-Za-z]"))


def resolved(found: Column) -> Column:
    """Spans by confidence, then length; each drops later ones that overlap it; by start. Only spans that reach over one another are compared."""
    none = F.array().cast(SPAN)
    by = lambda xs, *keys: F.transform(F.array_sort(F.transform(xs, lambda s: F.struct(*[k(s).alias(f"k{i}") for i, k in enumerate(keys)], s.alias("s")))), lambda o: o["s"])
    start, kind = (lambda s: s["start"]), (lambda s: s["type"])

    def greedy(xs: Column) -> Column:
        order = by(xs, lambda s: -s["confidence"], lambda s: s["start"] - s["end"], start, kind)
        return F.aggregate(order, none, lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(k, s)), acc).otherwise(F.concat(acc, F.array(s))))

    kept = F.flatten(F.transform(clusters(by(found, start)), lambda xs: F.when(F.size(xs) == 1, xs).otherwise(by(greedy(xs), start))))
    return F.when(F.size(found) > 1, kept).otherwise(found)


def detect(text: Column, detectors=(emails, phones, aadhaars, pans)) -> Column:
    """All detectors over a text in one pass, collisions resolved; spans that don't match the text at their offsets are dropped. ``detectors`` may hold others."""
    every = F.concat(*[d(text) for d in detectors])
    return let(F.filter(every, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["raw"]), resolved)
