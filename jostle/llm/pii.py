"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression, so a scan finds, scores and replaces in one pass without a shuffle.

Positions come from two passes of a pattern: ``split`` gives what lies between the matches and
``regexp_extract_all`` the matches, and their running lengths are offsets in code points. The patterns are
written so that a long text costs linear time: possessive quantifiers, and a run of characters is
tried once, from its start or from the end of the match before (``\\G``). So do the steps after them: context is put together from the
matches and gaps next to a span, overlaps are found in the sorted spans by running ends, and texts are cut by pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jostle.llm.common import free_name
from jostle.llm.scans import let, part, pieces, scan

CONTEXT_CHARS = 48
ACCEPT = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``hint`` is a cheap test that a text may hold a match; ``base`` kinds are kept whatever their score.
    A proposal that fails ``valid`` is dropped. The score starts at ``prior`` and moves by ``boost`` where a
    context word stands within ``CONTEXT_CHARS`` code points before the span or just after it.
    """

    name: str
    pattern: str
    hint: object
    valid: object
    prior: float
    boost: float
    context: str
    base: bool = False


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits has a Luhn check digit."""
    n = F.length(digits)

    def add(total, place):  # place 0 is the last digit
        d = F.substr(digits, n - place, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(place % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (ISO 13616, without spaces) leaves remainder 1 modulo 97."""
    moved = F.upper(F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4)))

    def add(rest, place):
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(moved, place, F.lit(1))) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _bytes(hit: Column) -> Column:
    return ~F.exists(F.split(hit, r"\."), lambda part: ~part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))


def _card(hit: Column) -> Column:
    n = F.length(_digits(hit))
    return F.when((n >= 12) & (n <= 19), luhn(_digits(hit))).otherwise(False)


def _account(hit: Column) -> Column:
    code = F.replace(hit, F.lit(" "), F.lit(""))
    return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)


# The countries of ISO 13616 account numbers (and of those in use by agreement) by length.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: The country gives the length, so what follows a number after a blank is not taken into it.
_ACCOUNTS = "|".join(
    rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_COUNTRIES.items()
)

#: In the order that decides between spans with the same start.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")), lambda h: F.lit(True),
        0.9, 0.1, r"mail|contact|write|kontakt|correo|courriel", True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"), _bytes,
        0.7, 0.3, r"\bip\b|addr|host|server|login|from", True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), _card,
        0.7, 0.3, r"card|visa|credit|payment|karte|tarjeta|carte", True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.rlike(r"\+[0-9]"), lambda h: F.length(_digits(h)).between(9, 15),
        0.8, 0.2, r"phone|\btel|call|mobile|fax|\bruf", True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])(?:" + _ACCOUNTS + r")(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), _account,
        0.8, 0.2, r"iban|bank|account|konto|cuenta|compte", False,
    ),
    Kind(
        "national_phone",
        r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[.-])[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z-])",
        lambda t: t.rlike(r"[0-9)][\x20./-]?[0-9]{3,4}[\x20.-][0-9]{3}"), lambda h: F.length(_digits(h)).between(9, 12),
        0.3, 0.4, r"phone|\btel|call|mobile|fax|\bruf", False,
    ),
)


_SPANS = "array<struct<start:int,rank:int,end:int,hit:string,score:double>>"
#: Matches are at least so long, so this many of them fill the context before or after a span.
_LEAST_MATCH = 2
_BEFORE, _AFTER = -(-CONTEXT_CHARS // _LEAST_MATCH), -(-CONTEXT_CHARS // 2 // _LEAST_MATCH)


def _scored(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of a kind with their scores, in order; code points, end exclusive.

    The context of a span is taken from the ends of the gaps around it and from the matches between them.
    """
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def spans_of(pairs: Column, ends: Column, last: Column) -> Column:
        def around(i: Column) -> Column:
            first = F.greatest(i - _BEFORE, F.lit(0))
            back = F.transform(F.slice(pairs, first + 1, i - first), lambda p: F.concat(p["tail"], p["hit"]))
            ahead = F.transform(F.slice(pairs, i + 2, F.lit(_AFTER)), lambda p: F.concat(p["head"], p["hit"]))
            # A gap of full width hides what lies beyond it, so its end and its beginning are enough.
            before = F.right(F.concat(F.array_join(back, ""), F.get(pairs, i)["tail"]), F.lit(CONTEXT_CHARS))
            after = F.left(F.concat(F.array_join(ahead, ""), last), F.lit(CONTEXT_CHARS // 2))
            return F.lower(F.concat(before, F.lit(" "), after))

        def span(p: Column, i: Column) -> Column:
            end = F.get(ends, i).cast("int")
            score = F.lit(kind.prior) + F.when(around(i).rlike(kind.context), F.lit(kind.boost)).otherwise(0.0)
            return F.struct((end - F.length(p["hit"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), p["hit"].alias("hit"), score.alias("score"))

        made = F.transform(pairs, lambda p, i: F.when(kind.valid(p["hit"]), span(p, i)))
        return F.filter(made, lambda s: s.isNotNull()).cast(_SPANS)

    cut = lambda g, h: F.struct(
        F.length(g).alias("width"), F.right(g, F.lit(CONTEXT_CHARS)).alias("tail"), F.left(g, F.lit(CONTEXT_CHARS // 2)).alias("head"), h.alias("hit")
    )
    # The gap after the last match has no match beside it.
    made = let(gaps, lambda g: F.struct(
        F.zip_with(F.slice(g, 1, F.size(g) - 1), hits, cut).alias("pairs"), F.left(F.element_at(g, -1), F.lit(CONTEXT_CHARS // 2)).alias("last")
    ))
    found = let(made, lambda m: let(
        scan(F.transform(m["pairs"], lambda p: p["width"] + F.length(p["hit"])), lambda x, y: x + y), lambda ends: spans_of(m["pairs"], ends, m["last"])
    ))
    return F.when(kind.hint(text), found).otherwise(F.array().cast(_SPANS))


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS, accept: float = ACCEPT) -> Column:
    """Spans of a text: array of (start, rank, end, hit, score), by start and then kind.

    A confirmed span of a base kind stays whatever its score; base spans of different kinds may overlap.
    One of another kind needs ``accept`` and no overlap with a base span. A null text has no spans.
    """
    whole = F.coalesce(text, F.lit(""))
    none = F.array().cast(_SPANS)
    every = F.concat(none, *[
        scored if kind.base else F.filter(scored, lambda s: s["score"] >= accept)
        for kind, scored in ((kind, _scored(whole, kind, rank)) for rank, kind in enumerate(kinds))
    ])
    base = [rank for rank, kind in enumerate(kinds) if kind.base]
    is_base = lambda s: s["rank"].isin(base)
    far = 1 << 40

    def apart(ordered: Column) -> Column:
        # Ends of the base spans up to each span, and, from the back, starts of those after it.
        ends = scan(F.transform(ordered, lambda s: F.when(is_base(s), s["end"]).otherwise(-1)), F.greatest)
        starts = scan(F.reverse(F.transform(ordered, lambda s: F.when(is_base(s), s["start"].cast("long")).otherwise(far))), F.least)
        n = F.size(ordered)

        def kept(both: Column) -> Column:
            ended = lambda i: F.coalesce(F.get(both["ends"], i - 1), F.lit(-1))
            begun = lambda i: F.coalesce(F.get(both["starts"], n - 2 - i), F.lit(far))
            return F.filter(ordered, lambda s, i: is_base(s) | ((ended(i) <= s["start"]) & (begun(i) >= s["end"])))

        return let(F.struct(ends.alias("ends"), starts.alias("starts")), kept)

    return let(F.array_sort(every), lambda o: F.when(F.exists(o, lambda s: ~is_base(s)), apart(o)).otherwise(o))


def _listed(chosen: Column, kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with the spans of every whole text in ``out``; repeated rows and nulls keep their rows."""
    return docs.withColumn(out, spans(F.col(text), kinds))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per document the counts of the base kinds, the SHA-256 of their list, and the list of all spans."""
    found = find(docs.select(F.col(doc_id), F.col(text).alias("text")), "text", "pii", kinds)
    base = [rank for rank, k in enumerate(kinds) if k.base]
    own = F.filter("pii", lambda s: s["rank"].isin(base))
    count = lambda rank: F.size(F.filter("pii", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        doc_id,
        *[count(rank).alias(f"n_{kinds[rank].name}") for rank in base],
        F.sha2(_listed(own, kinds), 256).alias("base_sha256"),
        _listed(F.col("pii"), kinds).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; same columns and rows.

    Of overlapping spans the first names the replacement, and what a later one adds goes with it. A
    null text stays null; texts without a span are unchanged.
    """
    column = free_name(docs, "pii")
    found = find(docs, text, column, kinds)
    names = F.array(*[F.lit(f"<{k.name.upper()}>") for k in kinds])

    def replaced(chosen: Column, cut: Column, ends: Column) -> Column:
        """What lies between the spans, with a name for each one that begins after all before it have ended."""
        past = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        named = F.transform(chosen, lambda s, i: F.when(
            s["start"] >= past(i), F.concat(part(cut, past(i), s["start"].cast("long")), F.get(names, s["rank"]))
        ).otherwise(""))
        rest = part(cut, F.element_at(ends, -1), F.length(text).cast("long"))
        return F.concat(F.array_join(named, ""), rest)

    ends = scan(F.transform(F.col(column), lambda s: s["end"]), F.greatest)
    changed = let(F.struct(pieces(F.col(text)).alias("cut"), ends.alias("ends")), lambda v: replaced(F.col(column), v["cut"], v["ends"]))
    return found.withColumn(text, F.when(F.size(column) > 0, changed).otherwise(F.col(text))).select(*docs.columns)
