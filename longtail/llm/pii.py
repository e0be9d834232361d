"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Everything is a column expression, so the scan stays inside the JVM and no row
needs another: there is no shuffle and nothing to skew.

Positions are running sums of lengths, made in blocks of STEP so that the work on one text grows with
its length (and by a square only in its matches / STEP), and redaction reads the text in pieces of PIECE.

Defined cases: a null text counts as empty; empty tables give empty results;
repeated rows are scanned on their own; `find_pii` replaces a column named like its output, `redact` returns
all other columns as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Possessive loops keep Java's matcher iterative. The look-behinds only skip starts inside a
# run that has failed already, so the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+()-])(?<!\+[0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score before context; a context word within CONTEXT_CHARS before the span adds 0.3.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "ssn": 0.5, "local_phone": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
    "local_phone": "phone|tel|call|mobile|fax",
}
CONTEXT_CHARS = 40
#: The parts before a span that hold its context, matches having MATCH_CHARS at least.
MATCH_CHARS = 4
STEP, PIECE = 128, 4096


def _bound(value: Column, use) -> Column:
    """use(value), which is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, join) -> Column:
    """array<bigint>: before each value, the join of all earlier ones; join(a, b) is associative and 0 its neutral value."""

    def scan(part: Column, of) -> Column:
        start = F.expr("struct(0L as at, cast(array() as array<bigint>) as got)")
        return F.aggregate(part, start, lambda acc, v: F.struct(join(acc["at"], of(v)).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got")))

    def blocks(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STEP).cast("int")), lambda i: F.slice(all_, i * STEP + 1, F.lit(STEP)))
        local = F.transform(parts, lambda part: scan(part, lambda v: v))
        placed = lambda done: F.arrays_zip(done.alias("block"), scan(done, lambda x: x["at"])["got"].alias("before"))
        return _bound(local, lambda done: F.flatten(F.transform(placed(done), lambda z: F.transform(z["block"]["got"], lambda x: join(z["before"], x)))))

    return _bound(values, lambda v: F.when(F.size(v) <= STEP, scan(v, lambda x: x)["got"]).otherwise(blocks(v)))


def _found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v, before>> of all matches; positions in code points, from the text between them; before: the CONTEXT_CHARS before it."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    wide = CONTEXT_CHARS // MATCH_CHARS

    def spans(all_: Column) -> Column:
        lengths = F.transform(all_, lambda p: (F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("bigint"))
        zipped = F.arrays_zip(all_.alias("part"), _running(lengths, lambda a, b: a + b).alias("at"))

        def span(z: Column, i: Column) -> Column:
            first = F.greatest(i - wide, F.lit(0))
            earlier = F.array_join(F.flatten(F.transform(F.slice(all_, first + 1, i - first), lambda p: F.array(p["gap"], p["hit"]))), "")
            s = z["at"] + F.length(z["part"]["gap"])
            v = z["part"]["hit"]
            return F.struct(s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"), F.right(F.concat(earlier, z["part"]["gap"]), F.lit(CONTEXT_CHARS)).alias("before"))

        return F.filter(F.transform(zipped, span), lambda m: m["v"].isNotNull())

    return _bound(parts, spans)


def luhn(digits: Column) -> Column:
    """Luhn's check on a string of digits."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN without blanks."""
    turned = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (F.length(digits) <= 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        bare = F.replace(v, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


def _kind(text: Column, kind: str, no: int) -> Column:
    """array<struct<start, kind_no, end, kind, score>> of the confirmed spans of one kind."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    none = F.expr("cast(array() as array<struct<s: bigint, e: bigint, v: string, before: string>>)")
    found = F.filter(F.when(may, _found(text, PATTERNS[kind])).otherwise(none), lambda m: _valid(kind, m["v"]))

    def scored(m: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(F.lower(m["before"]).rlike(rf"\b({CONTEXT[kind]})"), 0.3).otherwise(0.0)
        return F.struct(m["s"].alias("start"), F.lit(no).alias("kind_no"), m["e"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    return F.transform(found, scored)


def find_pii(df: DataFrame, text: str = "text", min_score: float = 0.5, out: str = "pii") -> DataFrame:
    """df with column `out`: array<struct<start, kind_no, end, kind, score>> by start, then kind.

    Spans of the four base kinds always stay; the added kinds (iban, ssn, local_phone)
    need `min_score`, which local_phone reaches only beside a context word.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    kinds = [_kind(source, k, i) for i, k in enumerate(PATTERNS)]
    added = [F.filter(a, lambda m: m["score"] >= min_score) if k not in BASE else a for k, a in zip(PATTERNS, kinds)]
    return df.withColumn(out, F.array_sort(F.concat(*added)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))))


def redact(df: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """df with every span in `text` replaced by [KIND]; overlapping spans leave one mark each, null stays null."""
    t = F.col(text)
    (found,) = fresh(df, "found")

    def cut(spans: Column, pieces: Column) -> Column:
        # the characters [a, b) from the pieces that hold them
        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE)
            some = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor(b / PIECE) - first + 1).cast("int")), "")
            return some.substr((a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

        ends = _running(F.transform(spans, lambda m: m["end"]), lambda a, b: F.greatest(a, b))
        marks = F.transform(F.arrays_zip(spans.alias("m"), ends.alias("at")), lambda z: F.concat(F.when(z["m"]["start"] > z["at"], part(z["at"], z["m"]["start"])).otherwise(""), F.lit("["), F.upper(z["m"]["kind"]), F.lit("]")))
        tail = _bound(F.array_max(F.transform(spans, lambda m: m["end"])), lambda last: part(last, F.length(t).cast("bigint")))
        return F.array_join(F.concat(marks, F.array(tail)), "")

    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    new = _bound(F.col(found), lambda spans: _bound(pieces, lambda p: cut(spans, p)))
    marked = find_pii(df, text, min_score, found)
    return marked.withColumn(text, F.when(F.size(found) > 0, new).otherwise(t)).drop(found)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of op7 from the operator's spans."""
    found = find_pii(df.select("doc_id", "text")).drop("text")
    base = found.withColumn("base", F.filter("pii", lambda m: m["kind_no"] < len(BASE)))
    of_kind = lambda no: F.size(F.filter("base", lambda m: m["kind_no"] == no)).cast("bigint")
    counts = [of_kind(no).alias(f"n_{k}") for no, k in enumerate(BASE)]
    return base.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


#: DuckDB SQL for digest(); the gaps between matches give the positions there too.
def oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum([case when (len({digits}) - i) % 2 = 1 then (case when {digits}[i]::int > 4 then {digits}[i]::int * 2 - 9 else {digits}[i]::int * 2 end) else {digits}[i]::int end for i in range(1, len({digits}) + 1)])"
    valid = {
        "email": "true",
        "ip": "list_aggregate([x::hugeint <= 255 for x in string_split(v, '.')], 'bool_and')",
        "card": f"len({digits}) between 14 and 19 and {luhn_sum} % 10 = 0",
        "phone": f"len({digits}) between 10 and 15",
    }
    parts = []
    for no, k in enumerate(BASE):
        parts.append(
            f"select doc_id, rid, {no} as no, '{k}' as kind, s, v from (select doc_id, rid, unnest(range(1, len(hits) + 1)) as j, hits[j] as v, "
            f"(list_sum([len(x) for x in gaps[1:j]]) + coalesce(list_sum([len(x) for x in hits[1:j - 1]]), 0))::bigint as s from "
            f"(select doc_id, rid, regexp_extract_all(t, '{plain[k]}') as hits, string_split_regex(t, '{plain[k]}') as gaps from d where regexp_matches(t, '{plain[k]}'))) where {valid[k]}"
        )
    return (
        "with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents), m as (" + " union all ".join(parts) + "), "
        "g as (select rid, " + ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE) + ", string_agg(kind || ':' || s || ':' || (s + len(v)), ',' order by s, no) as listed from m group by rid) "
        "select d.doc_id, " + ", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE) + ", sha256(coalesce(listed, '')) as base_sha256, coalesce(listed, '') as spans from d left join g using (rid)"
    )


