"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans. Validators confirm them: octets for addresses, Luhn for cards, digit counts for
phone numbers, mod-97 for bank account numbers (IBAN). Words near a span raise its score; a kind whose form alone says
little (a social security number) is kept only when such a word is near. Matches are leftmost and non-overlapping per
kind; a match that fails its check is dropped and not tried in part.

A text is cut at the matches: the pieces between them and the matches themselves give each start as a running sum of
lengths, so positions are code points and nothing leaves the JVM. A plain search for a character that a match must
have spares most texts the regular expressions. Repeats are possessive where a retry can't succeed, so time grows
with the length of a text also for one long run of letters or digits.

Defined results: a null or empty text has no spans; each row is judged by itself, so repeated rows get equal results,
null ids stay, an empty table gives an empty result, and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import require, text_or_empty

#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20, "YE": 30,
}
#: Code points before a span in which a context word counts, and the weight of such a word.
CONTEXT_CHARS = 40
CONTEXT_WEIGHT = 30


@dataclass(frozen=True)
class Kind:
    """pattern: what proposes a span. hint: a cheap pattern, or a character, that each match holds. context: words that
    raise the score. score: without context, in hundredths. least: a lower score drops the span."""

    name: str
    pattern: str
    hint: str
    context: str
    score: int
    least: int = 0


KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|address", 70),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "ip|host|server|address|login", 50),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){12}[0-9]", "card|credit|visa|pay|account", 60),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax|contact", 60),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{3}", "iban|bank|account|transfer|bic", 70),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|security|insurance", 20, 50),
)
BASE_KINDS = ("email", "ip", "card", "phone")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: a lambda's variable stands for it, so it isn't computed anew per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(lengths: Column) -> Column:
    """For each element the sum of those before it. Sums of blocks of about sqrt(n) keep this at n * sqrt(n) steps."""
    add = lambda a, x: a + x

    def with_block(both: Column) -> Column:
        xs, block = both["xs"], both["block"]
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / block).cast("int")), lambda b: F.aggregate(F.slice(xs, b * block + 1, block), F.lit(0), add))
        # of a block what is before it, then within it what is before an element
        starts = bound(sums, lambda s: F.transform(s, lambda x, i: F.aggregate(F.slice(s, F.lit(1), i), F.lit(0), add)))
        return bound(starts, lambda s: F.transform(xs, lambda x, i: s[F.floor(i / block).cast("int")] + F.aggregate(F.slice(xs, F.floor(i / block).cast("int") * block + 1, i % block), F.lit(0), add)))

    return bound(lengths, lambda xs: bound(F.struct(xs.alias("xs"), F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int").alias("block")), with_block))


def contexts(pieces: Column, found: Column) -> Column:
    """For each match the CONTEXT_CHARS characters before it: the ends of the pieces and matches that can reach so far.
    A match has two characters or more and a piece between two matches one, so a few before it are enough."""
    few = CONTEXT_CHARS // 3 + 2
    ends = F.transform(pieces, lambda p: F.right(p, F.lit(CONTEXT_CHARS)))
    steps = F.zip_with(ends, found, lambda p, m: F.concat(p, F.right(m, F.lit(CONTEXT_CHARS))))
    before = lambda both, i: F.array_join(F.slice(both["steps"], F.greatest(i - few, F.lit(0)) + 1, F.least(i, F.lit(few))), "")
    return bound(F.struct(ends.alias("ends"), steps.alias("steps")), lambda both: F.transform(both["ends"], lambda p, i: F.lower(F.right(F.concat(before(both, i), p), F.lit(CONTEXT_CHARS)))))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        doubled = F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int"))
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _iban_part(found: Column) -> Column:
    """The opening of a match that has the length its country asks for; null if there is none."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    part = F.call_function("regexp_extract", found, F.concat(F.lit(r"^(?:[A-Z0-9]\x20?){"), (F.element_at(lengths, F.substring(found, 1, 2)) - 1).cast("string"), F.lit("}[A-Z0-9]")), F.lit(0))
    return F.when(part == "", F.lit(None)).otherwise(part)


def _mod97(part: Column) -> Column:
    plain = F.regexp_replace(part, " ", "")
    moved = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step) == 1


def _confirmed(kind: Kind, found: Column) -> Column:
    if kind.name == "ip":
        return _octets(found)
    if kind.name == "card":
        return F.length(_digits(found)).between(13, 19) & _luhn(_digits(found))
    if kind.name == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind.name == "iban":
        return F.coalesce(_mod97(_iban_part(found)), F.lit(False))
    return F.lit(True)


def _spans_of(kind: Kind, pieces: Column, found: Column) -> Column:
    """The spans of one kind: pieces are those before each match."""
    starts = running_sums(F.zip_with(pieces, found, lambda p, m: F.length(p) + F.length(m)))
    starts = F.zip_with(starts, pieces, lambda s, p: s + F.length(p))
    where = F.zip_with(starts, contexts(pieces, found), lambda s, c: F.struct(s.alias("start"), c.rlike(kind.context).alias("near")))

    def span(at: Column, match: Column) -> Column:
        score = kind.score + F.when(at["near"], CONTEXT_WEIGHT).otherwise(0)
        end = at["start"] + F.length(_iban_part(match) if kind.name == "iban" else match)
        return F.struct(F.lit(kind.name).alias("kind"), at["start"].alias("start"), end.alias("end"), score.alias("score"), _confirmed(kind, match).alias("ok"))

    return F.filter(F.zip_with(where, found, span), lambda s: s["ok"] & (s["score"] >= kind.least))


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per row of docs: id and spans, an array of (kind, start, end, score), by kind as listed, then start."""
    require(docs, id_column, text_column)
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    hinted = {k.name: (F.instr("text", k.hint) > 0) if len(k.hint) == 1 else F.col("text").rlike(k.hint) for k in kinds}
    rows = rows.select("*", *[F.when(hinted[k.name], F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(k.name) for k in kinds])
    no_spans = F.array().cast("array<struct<kind: string, start: int, end: int, score: int, ok: boolean>>")

    def spans_of(kind: Kind) -> Column:
        # the pieces before each match: the last piece has none after it
        pieces = F.slice(F.split("text", kind.pattern, -1), F.lit(1), F.size(kind.name))
        both = F.struct(pieces.alias("pieces"), F.col(kind.name).alias("found"))
        return F.when(F.size(kind.name) > 0, bound(both, lambda b: _spans_of(kind, b["pieces"], b["found"]))).otherwise(no_spans)

    spans = F.concat(*[spans_of(k) for k in kinds])
    return rows.select(F.col("id").alias(id_column), F.transform(spans, lambda s: s.dropFields("ok")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, in the order of starts and non-overlapping, replaced by its kind in angle brackets."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        ahead = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(ahead.alias("out"), s["end"].alias("at")))

    return F.aggregate(order, state, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
