"""Secret scan: fixed patterns, and character Markov models.

Base patterns (leftmost, non-overlapping, per kind): ``assign`` (a password,
secret, token or api key with a value of 12 or more characters), ``access``
(AKIA..., 18 or more), ``hex`` (16 or more).  Positions are code points: the
text is split at a pattern's matches, and lengths of pieces and matches add
up to starts.

The method adds kind ``markov``: runs of ``[A-Za-z0-9+/_=-]`` of 16 or more
characters whose log-likelihood ratio between two first-order character
models, one of random strings and one of ordinary identifiers, is at least
``min_llr`` in all and ``min_rate`` a character.  Base spans are cut out of a
run, and each piece that is left, of any length, is judged alone.
The models are counted in Spark from samples that the base patterns label:
values inside base spans are random, letter runs elsewhere are ordinary; the
random model starts from ``prior`` uniform counts, the ordinary one from one.
The sample is about ``max_rows`` rows for ordinary words and eight times as
many for base spans, chosen by the hash of id and text (a documented bound on
what is fitted); every text is scanned whole.

Everything is one pass of SQL expressions a row: no shuffle, no Python.  Base
spans are marked in a copy of the text, one mark for each character, so what
they leave of a run, and what is redacted, are found by patterns over that
copy; the work is linear in the text and its matches but for the root of their
number (positions are summed in blocks).

Null and empty texts have no span.  Repeated rows are scanned alike.  Other
columns are kept by ``redact`` and not read by ``scan``.  An empty table
gives an empty result, and models of priors alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.llm.common import hash_share, text_col

ASSIGN = ("((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{14,}"   # a run is taken whole, so the length can stand in the pattern
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(sizes: Column) -> Column:
    """Where each match starts, from the lengths ``p`` of the text before it
    and ``m`` of itself.  Sums are taken in blocks of the root of their number,
    so that no array grows step by step over all of them."""
    none = F.array().cast("array<int>")

    def running(xs: Column, start, step) -> Column:
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), none.alias("starts")), lambda a, x: F.struct(
            (a.at + step(x)).alias("at"), F.concat(a.starts, F.array(a.at + start(x))).alias("starts")))

    def in_blocks(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")),
                             lambda b: running(F.slice(xs, b * size + 1, size), lambda x: x.p, lambda x: x.p + x.m))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(
            bs, running(bs, lambda _: F.lit(0), lambda x: x.at).starts, lambda x, o: F.transform(x.starts, lambda v: v + o))))
    return _let(sizes, lambda xs: F.when(F.size(xs) == 0, none).otherwise(in_blocks(xs)))


def _matches(text: Column, pattern: str, group: int = 0) -> tuple[Column, Column, Column]:
    """The text between matches, the matches, and their ``group``."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return F.split(text, pattern, -1), whole, value


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern, in order; matches whose ``group`` is shorter than
    ``least`` are dropped after matching."""
    pieces, whole, value = _matches(text, pattern, group)
    sizes = F.zip_with(pieces, whole, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    spans = F.zip_with(_starts(F.filter(sizes, lambda s: s.m.isNotNull())), F.arrays_zip(whole.alias("w"), value.alias("v")),
                       lambda s, x: F.struct(s.alias("start"), F.lit(kind).alias("kind"),
                                             (s + F.length(x.w)).alias("stop"), x.v.alias("value")))
    if least:
        spans = F.filter(spans, lambda x: F.length(x.value) >= least)
    # most texts hold no match: they are only searched once
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _replaced(text: Column, pattern: str, new, group: int = 0) -> Column:
    """The text with ``new(match, group)`` for each match."""
    pieces, whole, value = _matches(text, pattern, group)
    parts = F.zip_with(pieces, F.arrays_zip(whole.alias("w"), value.alias("v")),
                       lambda p, m: F.concat(p, F.when(m.isNull(), F.lit("")).otherwise(new(m.w, m.v))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


# Marks, one for one in the place of a span's characters: the first one and
# the others, where a candidate could hold them; and where none could.
FIRST, INNER, FIRST_NOT, INNER_NOT, QUIET = "\x01", "\x02", "\x03", "\x04", "\x05"
LETTER = "[A-Za-z0-9+/_=-]"
RUN = f"[A-Za-z0-9+/_={FIRST}{INNER}-]{{16,}}"


def _marked(span: Column) -> Column:
    head, tail = F.substring(span, 1, 1), F.substring(span, 2, 2**31 - 1)
    tail = F.regexp_replace(F.regexp_replace(tail, LETTER, INNER), f"[^{INNER}]", INNER_NOT)
    return F.concat(F.when(head.rlike(LETTER), FIRST).otherwise(FIRST_NOT), tail)


def _overlaid(a: Column, b: Column) -> Column:
    """Two markings of one text as one, a character at a time: inside a span
    of either it is inside, so overlapping spans are one."""
    letters = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    return F.array_join(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x.isin(INNER, INNER_NOT), x).when(
        y.isin(INNER, INNER_NOT), y).when(x.isin(FIRST, FIRST_NOT), x).otherwise(y)), "")


def _with_marks(rows: DataFrame, quiet: str, out: str) -> DataFrame:
    """``rows`` with the text ``quiet``, which holds no mark, with all base
    spans marked as ``out``."""
    for k, (pattern, group, least) in enumerate(((ASSIGN, 2, 12), (ACCESS, 0, 0), (HEX, 0, 0))):
        kept = lambda w, v, n=least: F.when(F.length(v) >= n, _marked(w)).otherwise(w)
        rows = rows.withColumn(f"__m{k}", _replaced(F.col(quiet), pattern, kept, group))
    plain = F.col(quiet)
    for k in (1, 2):  # texts with one kind of span are not taken apart
        a, b = F.col(f"__m{k - 1}"), F.col(f"__m{k}")
        rows = rows.withColumn(f"__m{k}", F.when(a == plain, b).when(b == plain, a).otherwise(_overlaid(a, b)))
    return rows.withColumn(out, F.col("__m2")).drop("__m0", "__m1", "__m2")


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    return F.array_sort(F.concat(_found(text, ASSIGN, 0, 2, 12), _found(text, ACCESS, 1), _found(text, HEX, 2)))


def _pairs(values: DataFrame) -> dict[int, int]:
    """Counts of letter pairs of ``value`` (at most 67^2 of them)."""
    i = F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("i")
    rows = values.filter(F.length("value") > 1).select("value", i)
    sub = lambda d: F.expr(f"locate(substring(value, i + {d}, 1), '{ALPHABET}') - 1")
    got = rows.select(sub(0).alias("a"), sub(1).alias("b")).filter("a >= 0 and b >= 0").groupBy("a", "b").count()
    return {r.a * len(ALPHABET) + r.b: r["count"] for r in got.collect()}


def train(docs: DataFrame, id_col: str = "doc_id", max_rows: int = 4_000, prior: float = 20.0) -> list[float]:
    """Log ratio of each letter pair, random over ordinary."""
    text = text_col()
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("t"))
    # chosen by a hash limit, and only counted: no task gets the sample whole
    random = (rows.filter(hash_share(rows, ["__id", "t"], 8 * max_rows)).select(F.explode(base_spans(F.col("t"))).alias("s"))
              .select(F.col("s.value").alias("value")))
    plain = (rows.filter(hash_share(rows, ["__id", "t"], max_rows))
             .select(F.explode(F.regexp_extract_all("t", F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{6,}(?![A-Za-z0-9+/_=-])"),
                                                    F.lit(0))).alias("value")))
    n = len(ALPHABET)
    table = []
    counts = _pairs(random), _pairs(plain)
    pairs = [[[c.get(a * n + b, 0) for b in range(n)] for a in range(n)] for c in counts]
    # letters the ordinary model hasn't seen after another fall back to their own frequency
    seen = [sum(r[b] for r in pairs[1]) for b in range(n)]
    single = [(x + 0.5) / (sum(seen) + 0.5 * n) for x in seen]
    for a in range(n):
        random_n, plain_n = sum(pairs[0][a]), sum(pairs[1][a])
        for b in range(n):
            p = (pairs[0][a][b] + prior / n) / (random_n + prior)
            q = (pairs[1][a][b] + single[b]) / (plain_n + 1.0)
            table.append(math.log(p / q))
    return table


def _llr(value: Column, table: list[float]) -> Column:
    w = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded to a literal
    # one pass over the letters: the state holds the letter before and the sum
    return F.aggregate(
        F.split(value, ""), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(
            (F.instr(F.lit(ALPHABET), c) - 1).alias("last"),
            (s.sum + F.when(s.last >= 0, F.get(w, s.last * len(ALPHABET) + F.instr(F.lit(ALPHABET), c) - 1))
             .otherwise(0.0)).alias("sum")),
        lambda s: s.sum)


def _secret(value: Column, table: list[float], min_llr: float = 12.0, min_rate: float = 0.8) -> Column:
    return _llr(value, table) >= F.greatest(F.lit(min_llr), F.length(value) * F.lit(min_rate))


def markov_spans(marked: Column, table: list[float], **params) -> Column:
    """The pieces of candidate runs that no base span covers and the models
    take for random."""
    def pieces(run: Column) -> Column:
        return F.transform(_found(run.value, LETTER + "+", 3), lambda s: F.struct(
            (run.start + s.start).alias("start"), s.kind.alias("kind"), (run.start + s.stop).alias("stop"), s.value.alias("value")))
    return F.filter(F.flatten(F.transform(_found(marked, RUN, 3), pieces)), lambda s: _secret(s.value, table, **params))


def spans(docs: DataFrame, table: list[float], text: str = "text", **params) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans`` (all spans by start, kind)."""
    marks = FIRST + INNER + FIRST_NOT + INNER_NOT
    out = docs.withColumn("__t", text_col(text)).withColumn("__base", base_spans(F.col("__t")))
    out = _with_marks(out.withColumn("__q", F.translate("__t", marks, QUIET * 4)), "__q", "__m")
    return out.withColumn("__spans", F.array_sort(F.concat(
        F.col("__base"), markov_spans(F.col("__m"), table, **params)))).drop("__t", "__q", "__m")


def _listed(c: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_markov``."""
    table = train(docs, id_col)
    rows = spans(docs.select(id_col, "text"), table, **params)
    n = lambda k: F.size(F.filter("__spans", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(id_col, n(0), n(1), n(2), F.sha2(_listed("__base"), 256).alias("base_sha256"),
                       _listed("__spans").alias("spans"), n(3))


#: marks in a text itself stand aside while its spans are marked
_ASIDE = [(QUIET, QUIET + "\x10"), (FIRST, QUIET + "\x06"), (INNER, QUIET + "\x07"), (FIRST_NOT, QUIET + "\x0e"), (INNER_NOT, QUIET + "\x0f")]


def redact(docs: DataFrame, id_col: str = "doc_id", mark: str = "[SECRET]", **params) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by
    ``mark``; texts without spans are left as they are."""
    table = train(docs, id_col)
    aside, back = F.col("text"), F.col("__m")
    for c, stand in _ASIDE:
        aside = F.replace(aside, F.lit(c), F.lit(stand))
    for c, stand in reversed(_ASIDE):
        back = F.replace(back, F.lit(stand), F.lit(c))

    def judged(run: Column, _) -> Column:
        return _replaced(run, LETTER + "+", lambda w, _: F.when(_secret(w, table, **params), _marked(w)).otherwise(w))

    has = F.col("text").rlike(f"[{FIRST}-{QUIET}]")
    out = _with_marks(docs.withColumn("__q", F.when(has, aside).otherwise(F.col("text"))), "__q", "__b")
    out = out.withColumn("__n", _replaced(F.col("__b"), RUN, judged))
    hidden = F.regexp_replace("__n", f"[{FIRST}{FIRST_NOT}][{INNER}{INNER_NOT}]*", mark.replace("\\", "\\\\").replace("$", "\\$"))
    out = out.withColumn("__m", hidden)
    new = F.when(F.col("__n") == F.col("__q"), F.col("text")).when(F.col("text").rlike(f"[{FIRST}-{QUIET}]"), back).otherwise(F.col("__m"))
    return out.withColumn("text", new).drop("__q", "__b", "__n", "__m")
