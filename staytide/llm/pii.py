"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Four base kinds (email, ip, card, phone) follow fixed rules and always stay. The method adds spans of further
kinds: a candidate begins with the weight of its pattern, gains from a passed checksum (mod 97) and from
words near it, and stays at `THRESHOLD` or above unless it overlaps a base span. All of it is column
expressions; places are code points, the end is exclusive.

Patterns are written so that a failed attempt costs no more than the run it starts in: they begin at the start
of a run (or where the last match ended), and their repeats are possessive. A regex is only tried on texts that hold a sign
it needs.

Defined results: NULL text counts as empty; texts without a match give empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.words import text_of

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn", "local_phone")

# The base patterns, made linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# How many characters an IBAN of a country has.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LONG_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
# as long as the country says, else (an unknown country) as far as it goes, up to where one of a known country begins
IBAN = (
    rf"(?<![A-Za-z0-9])(?:(?:{_LONG_IBAN})|[A-Z]{{2}}[0-9]{{2}}"
    rf"(?:(?!\x20(?:{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)

# Patterns of the added kinds, their weight, and the words that speak for them.
ADDED = {
    "iban": (IBAN, 0.1, "iban|account|konto|compte|cuenta|bank"),
    "secret": (
        r"(?i)(?<=(?:token|secret|password|passwd|api_key|api-key|apikey|access_key)[\x20]{0,2}[:=][\x20]{0,2}[\"']{0,1})[A-Za-z0-9+/_=-]{16,}",
        0.6,
        "token|secret|password|passwd|key",
    ),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|sozial"),
    "local_phone": (
        r"(?<![0-9A-Za-z+(.-])(?<![0-9+.)-]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
        0.3,
        "phone|tel|call|mobile|fax|telefon|appel",
    ),
}
# What a text must hold for a regex to be tried.
NEEDS = {
    "email": "contains({t}, '@')",
    "ip": r"{t} RLIKE '[0-9]\\.[0-9]'",
    "card": r"{t} RLIKE '[0-9](?:[ -]?[0-9]){{11}}'",
    "phone": r"{t} RLIKE '\\+[0-9]'",
    "iban": r"{t} RLIKE '[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11}}'",
    "secret": r"{t} RLIKE '[:=] {{0,2}}[\"\']?[A-Za-z0-9+/_=-]{{16}}'",
    "ssn": r"{t} RLIKE '[0-9]-[0-9]{{2}}-[0-9]'",
    "local_phone": r"{t} RLIKE '[0-9]{{3}}[-. ][0-9]{{4}}'",
}
CHECKSUM_WEIGHT, CONTEXT_WEIGHT, THRESHOLD = 0.7, 0.4, 0.6
CONTEXT_REACH = 40

# Matches that a fold appends before it passes them on.
FOLD_BLOCK = 200

SPAN = "struct<start:int,kind:int,stop:int,hit:string>"


def _quoted(regex: str) -> str:
    return "r'" + regex.replace("'", r"\x27") + "'"


def _in_blocks(items: str, start: str, inner: str, step: str, joined: str, given: str = "''") -> str:
    """SQL for a fold over an array that appends to `out`: block by block, as each append copies what its own block has gathered so far.

    `start` and `inner` are states with `at` and `out`; a block begins with `inner`, which knows the outer state as `w`, and
    `joined` is the outer `out` after the block's state `r`; `given` is worked out once a block, and is `q` in a step. A lambda over
    an array of one value names that value.
    """
    block = f"transform(array({given}), q -> aggregate(slice(z, b * {FOLD_BLOCK} + 1, {FOLD_BLOCK}), {inner}, {step}))[0]"
    whole = f"transform(array({block}), r -> named_struct('at', r.at, 'out', {joined}))[0]"
    return f"transform(array({items}), z -> aggregate(sequence(0, size(z) div {FOLD_BLOCK}), {start}, (w, b) -> {whole}))[0]"


def _matches(text: str, kind: str, regex: str) -> str:
    """SQL for the array of spans: the gaps between matches and the matches, laid end to end."""
    number = KINDS.index(kind)
    hits = f"regexp_extract_all({text}, {_quoted(regex)}, 0)"
    gaps = f"split({text}, {_quoted(regex)}, -1)"
    pairs = f"zip_with({gaps}, {hits}, (g, h) -> named_struct('gap', g, 'hit', h))"
    none = f"cast(array() AS array<{SPAN}>)"
    step = (
        "(a, x) -> IF(x.hit IS NULL, a, named_struct("
        "'at', a.at + length(x.gap) + length(x.hit), "
        f"'out', concat(a.out, array(named_struct('start', a.at + length(x.gap), 'kind', {number}, "
        "'stop', a.at + length(x.gap) + length(x.hit), 'hit', x.hit)))))"
    )
    walk = _in_blocks(pairs, f"named_struct('at', 0, 'out', {none})", f"named_struct('at', w.at, 'out', {none})", step, "concat(w.out, r.out)") + ".out"
    return f"CASE WHEN {NEEDS[kind].format(t=text)} THEN {walk} ELSE cast(array() AS array<{SPAN}>) END"


_DIGITS = "regexp_replace(x.hit, '[^0-9]+', '')"
# whether a match counts; a part of an address has three digits at most once its leading zeros are gone
_BASE_TESTS = {
    "email": "true",
    "ip": "forall(split(x.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
# remainder of the number that an IBAN spells, taken in digit by digit
_MOD_97 = (
    "aggregate(split(concat(substring({x}, 5), substring({x}, 1, 4)), ''), 0, "
    "(a, c) -> CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + cast(c AS int)) % 97 "
    "ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
)


def _score(kind: str) -> str:
    _, weight, words = ADDED[kind]
    near = (
        f"lower(concat(substring(p_text, greatest(x.start - {CONTEXT_REACH}, 0) + 1, least(x.start, {CONTEXT_REACH})), ' ', "
        f"substring(p_text, x.stop + 1, {CONTEXT_REACH})))"
    )
    score = f"{weight} + IF({near} RLIKE '\\\\b(?:{words})\\\\b', {CONTEXT_WEIGHT}, 0)"
    if kind == "iban":
        mod = _MOD_97.format(x="regexp_replace(x.hit, ' ', '')")
        score += f" + IF({mod}, {CHECKSUM_WEIGHT}, -1)"
    return score


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds p_text, p_base and p_spans: arrays of (start, kind, stop, hit), in order of start and kind."""
    found = docs.withColumn("p_text", text_of(text))
    base = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    found = found.withColumns({f"p_{k}": F.expr(_matches("p_text", k, r)) for k, r in base.items()} | {
        f"p_{k}": F.expr(_matches("p_text", k, r[0])) for k, r in ADDED.items()
    })
    found = found.withColumn(
        "p_base",
        F.expr("array_sort(concat(" + ", ".join(f"filter(p_{k}, x -> {_BASE_TESTS[k]})" for k in base) + "))"),
    )
    free = "NOT exists(p_base, b -> b.start < x.stop AND x.start < b.stop)"
    more = ", ".join(f"filter(p_{k}, x -> {free} AND {_score(k)} >= {THRESHOLD})" for k in ADDED)
    return found.withColumn("p_spans", F.expr(f"array_sort(concat(p_base, {more}))")).drop(*[f"p_{k}" for k in KINDS])


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', get({names}, x.kind), x.start, x.stop)), ',')")


def count_of(kind: str, spans: str = "p_base") -> Column:
    return F.expr(f"cast(size(filter({spans}, x -> x.kind = {KINDS.index(kind)})) AS bigint)")


def redacted(spans: str = "p_spans", text: str = "p_text") -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first one, as [EMAIL]."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    none = "cast(array() AS array<string>)"
    # places within the block's own stretch of the text, as a place is found by going through what lies before it
    step = (
        "(a, x) -> IF(x.start < a.at, named_struct('at', greatest(a.at, x.stop), 'out', a.out), named_struct('at', x.stop, 'out', "
        f"concat(a.out, array(substring(q, a.at - w.at + 1, x.start - a.at), get({names}, x.kind)))))"
    )
    fold = _in_blocks(
        spans,
        f"named_struct('at', 0, 'out', {none})",
        f"named_struct('at', w.at, 'out', {none})",
        step,
        "concat(w.out, array(array_join(r.out, '')))",
        f"substring({text}, w.at + 1, array_max(transform(slice(z, b * {FOLD_BLOCK} + 1, {FOLD_BLOCK}), x -> x.stop)) - w.at)",
    )
    return F.expr(f"transform(array({fold}), e -> concat(array_join(e.out, ''), substring({text}, e.at + 1)))[0]")
