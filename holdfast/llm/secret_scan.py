"""Secret scans with DataFrame expressions only: patterns, and Shannon entropy over sliding windows.

Everything happens within a row: no shuffle, no Python. Spark gives no places of matches; they are the sums of the lengths
of the matches and of the gaps between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Strings that may be keys, by character class, with the bits of entropy that a window needs.
CLASSES = {"hex": (r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_-])", 3.0), "base64": (r"[A-Za-z0-9+/_-]{20,}", 3.6)}
#: The allow-list: placeholders and runs of one character. No window that overlaps one of these is a secret.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|redacted|deadbeef|0123456789|abcdefghij|(.)\1{7,}"
WINDOW = 20
_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often a lambda within uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _located(text: Column, pattern: str, shown: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """``shown`` of (hits, gaps) of the pattern's leftmost matches that don't overlap, and of a function: characters before the nth gap."""

    def located(v: Column) -> Column:
        steps = F.transform(v.hits, lambda m, i: F.length(m) + F.length(F.get(v.gaps, i)))

        def placed(s: Column) -> Column:
            # Sums of 256 steps each, so that a text with very many matches doesn't sum all steps for each of them.
            whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / 256).cast("int")), lambda c: _sum(F.slice(s, c * 256 + 1, F.lit(256))))
            before = lambda w: lambda i: _sum(F.slice(w, F.lit(1), F.floor(i / 256).cast("int"))) + _sum(F.slice(s, (F.floor(i / 256) * 256 + 1).cast("int"), i % 256))
            return let(whole, lambda w: shown(v, before(w)))

        return let(steps, placed)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), located)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of the pattern's matches, in code points from 0."""
    found = _located(text, pattern, lambda v, before: F.transform(v.hits, lambda m, i: F.struct((before(i) + F.length(F.get(v.gaps, i))).alias("start"), m.alias("value"))))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:bigint,value:string>>"))


def between(text: Column, pattern: str) -> Column:
    """Array of (start, value) of what the pattern's matches leave."""
    found = _located(text, pattern, lambda v, before: F.transform(v.gaps, lambda g, i: F.struct(before(i).alias("start"), g.alias("value"))))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), text.alias("value"))))


def _spans(found: Column, no: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(no).alias("kind_no"), (m.start + F.length(m.value)).alias("end"), F.lit(kind).alias("kind")))


def _entropy_spans(judged: Column, no: int, kind: str) -> Column:
    hot = F.filter(judged, lambda m: m.w["first"].isNotNull())
    ends = (lambda m: m.start + m.w["first"]), (lambda m: m.start + m.w["last"] + WINDOW)
    return F.transform(hot, lambda m: F.struct(ends[0](m).alias("start"), F.lit(no).alias("kind_no"), ends[1](m).alias("end"), F.lit(kind).alias("kind")))


def windows(value: Column, bits: float, size: int = WINDOW) -> Column:
    """(first, last): where the first and the last window of at least ``bits`` of entropy begin in value; null if none does.

    With n of each character, entropy is log2(size) - sum(n log2 n) / size. The counts of a window's characters are carried from
    window to window: moving on by one character changes two of them, and two terms of the sum.
    """
    plogp = F.array(F.lit(0.0), *[F.lit(n).cast("double") * F.log2(F.lit(n)) for n in range(1, size + 1)])

    def counted(v: Column) -> Column:
        # A character is the place of its kind among the candidate's kinds, so that counts are an array.
        codes = F.transform(v.chars, lambda c: (F.array_position(v.kinds, c) - 1).cast("int"))
        counts = F.transform(v.kinds, lambda c: F.size(F.filter(F.slice(v.chars, 1, size), lambda x: x == c)))
        return let(F.struct(codes.alias("codes"), counts.alias("counts"), v.n.alias("n"), v.plogp.alias("plogp")), moved)

    def moved(v: Column) -> Column:
        def judged(counts: Column, total: Column, place: Column, first: Column, last: Column) -> Column:
            over = F.log2(F.lit(float(size))) - total / size >= bits - 1e-9
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(first.isNull() & over, place).otherwise(first).alias("first"), F.when(over, place).otherwise(last).alias("last"))

        def step(a: Column, i: Column) -> Column:
            gone, come = F.get(v.codes, i - 1), F.get(v.codes, i + size - 1)
            less, more = F.get(a.counts, gone), F.get(a.counts, come)
            change = F.get(v.plogp, less - 1) - F.get(v.plogp, less) + F.get(v.plogp, more + 1) - F.get(v.plogp, more)
            counts = F.transform(a.counts, lambda n, k: n - (k == gone).cast("int") + (k == come).cast("int"))
            return judged(F.when(gone == come, a.counts).otherwise(counts), a.total + F.when(gone == come, 0.0).otherwise(change), i, a["first"], a["last"])

        start = F.aggregate(v.counts, F.lit(0.0), lambda a, n: a + F.get(v.plogp, n))
        n = v.n - size
        places = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        none = F.lit(None).cast("int")
        return let(start, lambda s: F.aggregate(places, judged(v.counts, s, F.lit(0), none, none), step))

    return let(F.split(value, "(?!^)"), lambda c: let(F.struct(c.alias("chars"), F.array_distinct(c).alias("kinds"), F.length(value).alias("n"), plogp.alias("plogp")), counted))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with an array ``spans`` of (start, kind_no, end, kind), in order of start and kind; places are code points.

    Kinds: assign (a named secret and its value of 8 characters or more), access (key ids of 16 or more), hex (32 or more),
    entropy_hex and entropy_base64 (windows of ``WINDOW`` characters whose entropy reaches the bits of their class, none of which
    overlaps a match of ``ALLOWED``, in strings whose part between such matches has letters and digits; one span for each part).
    A null or empty text has no spans; a very long text is scanned whole, in its task, with counts kept by candidate only.
    A column named spans is replaced, all others stay. Rows stay as they are, repeated ones and null doc_ids too. An empty table
    gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m.value, ASSIGN, 1)) >= 8)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m.value) >= 16)
    hexes = matches(text, HEX + "(?<=[0-9a-f]{32})")
    spans = [_spans(assign, 0, "assign"), _spans(access, 1, "access"), _spans(hexes, 2, "hex")]
    for no, (name, (pattern, bits)) in enumerate(CLASSES.items(), 3):
        candidates = F.filter(matches(text, pattern), lambda m: F.rlike(m.value, F.lit("[0-9]")) & F.rlike(m.value, F.lit("[A-Za-z]")))
        parts = F.flatten(F.transform(candidates, lambda m: F.transform(between(m.value, ALLOWED), lambda p: F.struct((m.start + p.start).alias("start"), p.value.alias("value")))))
        able = F.filter(parts, lambda p: (F.length(p.value) >= WINDOW) & F.rlike(p.value, F.lit("[0-9]")) & F.rlike(p.value, F.lit("[A-Za-z]")))
        judged = F.transform(able, lambda m: F.struct(m.start.alias("start"), windows(m.value, bits).alias("w")))
        spans.append(_entropy_spans(judged, no, f"entropy_{name}"))
    return docs.withColumn("spans", F.array_sort(F.concat(*[s.cast(_SPAN) for s in spans])))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
