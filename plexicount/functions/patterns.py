"""Barcode patterns.

A string pattern has N for the UMI, C for the cell barcode and X for bases that stay.
A regular expression has groups named ``umi_*``, ``cell_*`` and ``discard_*``.  Both
compile on the driver: string patterns, and expressions that are a sequence of fixed
numbers of any character from the start, become substrings in generated code.
Expressions that are a sequence of groups and single characters, each repeated or not,
are matched once in the JVM, with every part numbered; only those with groups in
groups, alternatives or escapes run in an Arrow UDF.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTED = "struct<umi:string,umi_quality:string,cell:string,seq:string,qual:string>"


class PatternError(ValueError):
    """A pattern that can't be used."""


def _spans(places: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbours as (start, length)."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and sum(out[-1]) == p:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def _pieces(text: Column, places: list[int], offset: Column | int) -> Column:
    parts = [F.substring(text, F.lit(a + 1) + offset, F.lit(n)) for a, n in _spans(places)]
    return F.concat(*parts) if parts else F.lit("")


@dataclass(frozen=True)
class Slices:
    """Fixed positions from one end: what is the UMI, the cell, kept, or dropped."""

    length: int
    umi: tuple[int, ...]
    cell: tuple[int, ...]
    kept: tuple[int, ...]
    three_prime: bool = False

    def extract(self, seq: Column, qual: Column) -> Column:
        """Null where the read is too short."""
        offset = F.length(seq) - self.length if self.three_prime else F.lit(0)
        take = lambda text, places: _pieces(text, list(places), offset)

        def trimmed(text: Column) -> Column:
            rest = F.substring(text, F.lit(1), offset) if self.three_prime else F.substring(text, F.lit(self.length + 1), F.length(text))
            return F.concat(rest, take(text, self.kept)) if self.three_prime else F.concat(take(text, self.kept), rest)

        made = F.struct(take(seq, self.umi).alias("umi"), take(qual, self.umi).alias("umi_quality"), take(seq, self.cell).alias("cell"), trimmed(seq).alias("seq"), trimmed(qual).alias("qual"))
        return F.when(F.length(seq) >= self.length, made)

    def too_short(self, seq: Column) -> Column:
        return F.length(seq) < self.length


def string_pattern(pattern: str, three_prime: bool = False) -> Slices:
    if not pattern or set(pattern) - set("NCX"):
        raise PatternError(f"a pattern has N, C and X only, and at least one: {pattern!r}")
    at = lambda kind: tuple(k for k, c in enumerate(pattern) if c == kind)
    return Slices(len(pattern), at("N"), at("C"), at("X"), three_prime)


FUZZY = re.compile(r"\{s<=(\d+)\}")


def exact_pattern(pattern: str) -> str:
    """Without ``{s<=N}`` marks: the character before one with N of 1 or more matches anything."""
    out, at = "", 0
    for m in re.finditer(r"\{s<=([^}]*)\}?", pattern):
        out += pattern[at : m.start()]
        at = m.end()
        if not FUZZY.fullmatch(m.group()):
            raise PatternError(f"a bad substitution mark: {m.group()}")
        if not out:
            raise PatternError("a substitution mark has nothing before it")
        if int(m[1]):
            out = out[:-1] + "."
    return out + pattern[at:]


@dataclass(frozen=True)
class Expression:
    """A regular expression that needs a matcher."""

    pattern: str

    def extract(self, seq: Column, qual: Column) -> Column:
        pattern = self.pattern

        @F.arrow_udf(EXTRACTED)
        def matched(seqs: pa.Array, quals: pa.Array) -> pa.Array:
            import re

            compiled = re.compile(pattern)
            names = sorted(compiled.groupindex)
            rows = []
            for s, q in zip(seqs.to_pylist(), quals.to_pylist()):
                m = compiled.search(s) if s is not None and q is not None else None
                if m is None:
                    rows.append(None)
                    continue
                spans = {n: m.span(n) for n in names if m.start(n) >= 0}
                pick = lambda text, kind: "".join(text[a:z] for n, (a, z) in spans.items() if n.startswith(kind))
                gone = {k for n, (a, z) in spans.items() if n.startswith(("umi_", "cell_", "discard_")) for k in range(a, z)}
                rest = lambda text: "".join(c for k, c in enumerate(text) if k not in gone)
                rows.append({"umi": pick(s, "umi_"), "umi_quality": pick(q, "umi_"), "cell": pick(s, "cell_"), "seq": rest(s), "qual": rest(q)})
            return pa.array(rows, pa.struct([(n, pa.string()) for n in ("umi", "umi_quality", "cell", "seq", "qual")]))

        return matched(seq, qual)

    def too_short(self, seq: Column) -> Column:
        return F.lit(False)


#: A character, a class or any character, repeated or not; a named group of such; the mark between matched parts.
ATOM = r"(?:[A-Za-z0-9]|\.|\[\^?[A-Za-z0-9-]+\])(?:[*+?]\??|\{\d+(?:,\d*)?\}\??)?"
PART = re.compile(rf"\(\?P<(\w+)>((?:{ATOM})*)\)(?![*+?{{])|((?:{ATOM})+)")
BETWEEN = "\x01"


@dataclass(frozen=True)
class Parts:
    """An expression that is a sequence of parts: their names (None: none) and one pattern in which each is a numbered group."""

    names: tuple[str | None, ...]
    pattern: str

    def extract(self, seq: Column, qual: Column) -> Column:
        # What isn't matched has no mark; the first and the last part are what stands around the match.
        found = F.split(F.regexp_replace(seq, self.pattern, BETWEEN.join(f"${k + 1}" for k in range(len(self.names) + 2))), BETWEEN)

        def made(p: Column) -> Column:
            places, at = [], F.lit(0)
            for k in range(len(self.names) + 2):
                size = F.length(F.get(p, F.lit(k)))
                places.append((at, size))
                at = at + size
            names = [None, *self.names, None]
            taken = sorted((n, k) for k, n in enumerate(names) if n)
            cut = lambda text, ks: F.concat(*[F.substring(text, places[k][0] + 1, places[k][1]) for k in ks]) if ks else F.lit("")
            of = lambda kind: [k for n, k in taken if n.startswith(kind)]
            rest = [k for k, n in enumerate(names) if not (n or "").startswith(("umi_", "cell_", "discard_"))]
            return F.when(F.size(p) > 1, F.struct(cut(seq, of("umi_")).alias("umi"), cut(qual, of("umi_")).alias("umi_quality"), cut(seq, of("cell_")).alias("cell"), cut(seq, rest).alias("seq"), cut(qual, rest).alias("qual")))

        # An array of one element: the match is made once.
        return F.when(seq.isNotNull() & qual.isNotNull(), F.element_at(F.transform(F.array(found), made), 1))

    def too_short(self, seq: Column) -> Column:
        return F.lit(False)


def _parts(exact: str) -> Parts | None:
    """None where the expression isn't a plain sequence."""
    body, at, names, pieces = exact.removeprefix("^"), 0, [], []
    while at < len(body):
        m = PART.match(body, at)
        if not m:
            return None
        names.append(m[1])
        pieces.append(f"({m[2] if m[1] else m[3]})")
        at = m.end()
    # The ends of the text may hold anything; (?d): a dot of the expression is any character but a newline.
    ahead = "" if exact.startswith("^") else "[\\s\\S]*?"
    return Parts(tuple(names), f"(?d)\\A({ahead}){''.join(pieces)}([\\s\\S]*)\\z")


ANY = r"(?:\.(?:\{\d+\})?)"
TOKEN = re.compile(rf"\(\?P<(\w+)>({ANY}+)\)|({ANY})")


def regex_pattern(pattern: str) -> Slices | Parts | Expression:
    exact = exact_pattern(pattern)
    try:
        compiled = re.compile(exact)
    except re.error as e:
        raise PatternError(f"not a regular expression: {e}") from e
    if not any(n.startswith(("umi_", "cell_")) for n in compiled.groupindex):
        raise PatternError("no group is named umi_* or cell_*")
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=", exact):
        raise PatternError("look-around and back-references aren't supported")
    if not exact.startswith("^"):
        return _parts(exact) or Expression(exact)
    at, place, named, plain = 1, 0, {}, []
    while at < len(exact):
        m = TOKEN.match(exact, at)
        if not m:
            return _parts(exact) or Expression(exact)
        n = sum(int(x or 1) for x in re.findall(r"\.(?:\{(\d+)\})?", m[2] or m[3]))
        taken = list(range(place, place + n))
        if m[1] and m[1].startswith(("umi_", "cell_", "discard_")):
            named[m[1]] = taken
        else:
            plain += taken
        at, place = m.end(), place + n
    # Groups go together in order of their names, as text.
    pick = lambda kind: tuple(k for n in sorted(named) if n.startswith(kind) for k in named[n])
    return Slices(place, pick("umi_"), pick("cell_"), tuple(plain))


def compile_pattern(pattern: str, method: str = "string", three_prime: bool = False) -> Slices | Parts | Expression:
    if method not in ("string", "regex"):
        raise PatternError(f"an extraction method is string or regex: {method!r}")
    return string_pattern(pattern, three_prime) if method == "string" else regex_pattern(pattern)
