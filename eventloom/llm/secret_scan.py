"""Operator 9: secret scan by patterns and a battery of randomness tests. Native: SQL expressions only.

Three pattern kinds are the base. The method adds spans of kind ``random``: candidates are
runs of at least ``LEAST`` characters of base64 alphabets; each is read in the encoding its
characters suggest (hexadecimal, base32, base64) and gets three scores that are near a
standard normal value for uniform random symbols and large for text:

* chi-squared uniformity of the symbols, standardised for its degrees of freedom;
* the runs of character classes, against the number that random symbols make;
* the serial correlation of neighbouring symbols' places in the alphabet.

Their combination T is judged against text: in each group of length class and encoding,
mean and deviation of T over plainly textual candidates give the chance p that text looks
so random, and a Benjamini-Hochberg step-up at rate ``RATE`` over all the group's candidates
sets the greatest p that counts as a secret. p is counted in bins, so the step-up reads a
small table. Both passes over the documents are narrow; only counts by group are shuffled.

Starts and ends are in code points. Matches are those of a scan from left to right that
never overlap: texts between matches come from split(), so starts are running sums of
lengths. No pattern repeats a group, so matching never recurses, however long the text.

Defined cases: null counts as empty (no spans); an empty table gives an empty one; texts of
any length are scanned whole; spans that begin together are in order of kind; candidates
that overlap a base span add none; repeated rows are scanned each; further columns are
dropped but for those asked for, which come back in a struct where no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import as_row

#: The base patterns, as Java regular expressions. The lengths of the last two
#: are part of the pattern, which changes no match, since both take maximal runs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: Words of one case, perhaps with a capital, that single separators join. Only classes are
#: repeated, no groups, since Java matches those by recursion: the first pattern of a pair must
#: match and the second must not.
TEXTUAL = (("^[A-Za-z][A-Za-z_/+-]*[a-z]$", "[A-Za-z][A-Z]|[A-Z][_/+-]|[_/+-][_/+-]"), ("^[A-Z][A-Z_/+-]*[A-Z]$", "[_/+-][_/+-]"))
#: Greatest share of false discoveries in a group; groups of fewer textual candidates than
#: FEW use the fixed mean and deviation.
RATE, FEW, MEAN, DEVIATION = 0.01, 30, 8.0, 2.0
#: Bins of -log10 p, per unit and in all.
FINE, BINS = 10, 300
#: Matches of a text whose places are added up at once.
BLOCK = 128


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """Array of (start, kind, end, value) of a pattern's matches, those with a short group left out.

    Lengths are summed up in blocks of ``BLOCK`` matches, so that a text with very many
    matches copies short arrays only.
    """
    p = _literal(pattern)
    zipped = f"arrays_zip(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    blocks = f"transform(array({zipped}), z -> transform(sequence(0, (size(z) - 1) div {BLOCK}), i -> slice(z, cast(i * {BLOCK} + 1 AS int), {BLOCK})))[0]"
    inner = f"""aggregate(blk, named_struct('at', big.at, 'out', cast(array() AS {_SPAN})),
        (acc, x) -> named_struct('at', acc.at + length(x.`0`) + length(x.`1`), 'out', concat(acc.out, array(named_struct('start', acc.at + length(x.`0`), 'kind', {kind}, 'end', acc.at + length(x.`0`) + length(x.`1`), 'value', x.`2`)))))"""
    found = f"""filter(aggregate({blocks}, named_struct('at', 0, 'out', cast(array() AS array<{_SPAN}>)),
        (big, blk) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(big.out, array(r.out))))[0],
        big -> flatten(big.out)), y -> length(y.value) >= {least})"""
    return f"if({text} RLIKE {p}, {found}, cast(array() AS {_SPAN}))"


_ALPHABETS = {"hex": "0123456789abcdef", "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
_SAME = {"hex": (10 / 16) ** 2 + (6 / 16) ** 2, "b32": (26 / 32) ** 2 + (6 / 32) ** 2, "b64": 2 * (26 / 64) ** 2 + (10 / 64) ** 2 + (2 / 64) ** 2}


def _by_code(code: str, values: dict[str, object]) -> str:
    """A value by encoding."""
    quoted = {k: f"'{v}'" if isinstance(v, str) else f"{v}D" for k, v in values.items()}
    return f"(CASE {code} WHEN 'hex' THEN {quoted['hex']} WHEN 'b32' THEN {quoted['b32']} ELSE {quoted['b64']} END)"


def _tested(s: str) -> str:
    """Struct of group, T and textual of a candidate; nested lambdas stand for let-bindings."""

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    code = f"CASE WHEN {s} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex' WHEN {s} RLIKE '^[A-Z2-7]+$' THEN 'b32' ELSE 'b64' END"
    m = _by_code("e", {k: len(v) for k, v in _ALPHABETS.items()})
    same = _by_code("e", _SAME)
    alphabet = _by_code("e", dict(_ALPHABETS))
    plain = f"CASE WHEN e = 'hex' THEN lower({s}) ELSE translate({s}, '-_', '+/') END"
    squares = "aggregate(array_distinct(x), 0D, (a, c) -> a + power(length(t) - length(replace(t, c, '')), 2))"
    chi = f"(({m} / n * {squares} - n) - ({m} - 1)) / sqrt(2 * ({m} - 1) * (n - 1) / n)"
    runs = f"(1 + (n - 1) * (1 - {same}) - regexp_count({s}, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+')) / sqrt((n - 1) * {same} * (1 - {same}))"
    places = f"transform(x, c -> cast(instr({alphabet}, c) AS double))"
    mean = "aggregate(v, 0D, (a, c) -> a + c) / n"
    serial = "coalesce(abs(aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (c, d) -> (c - mu) * (d - mu)), 0D, (a, c) -> a + c)) / nullif(aggregate(v, 0D, (a, c) -> a + power(c - mu, 2)), 0D), 1D)"
    size = f"CASE WHEN n < 24 THEN 20 WHEN n < 32 THEN 24 WHEN n < 48 THEN 32 WHEN n < 96 THEN 48 ELSE 96 END"
    textual = " OR ".join(f"({s} RLIKE '{whole}' AND NOT {s} RLIKE '{amiss}')" for whole, amiss in TEXTUAL)
    body = f"named_struct('unit', concat(e, cast({size} AS string)), 't', (({chi}) + ({runs}) + ({serial} * sqrt(n) - 0.8D) / 0.6D) / sqrt(3D), 'textual', {textual})"
    return let("e", code, let("n", f"cast(length({s}) AS double)", let("t", plain, let("x", "split(t, '')", let("v", places, let("mu", mean, body))))))


def _candidates(text: str) -> str:
    """Array of candidates with their test results."""
    return f"transform({_spans(text, CANDIDATE, 3, 0, LEAST)}, r -> named_struct('start', r.start, 'end', r.end, 'test', {_tested('r.value')}))"


def _chance(t: Column, mean: Column, deviation: Column) -> Column:
    """-log10 of the normal distribution function, by a logistic curve."""
    z = (t - mean) / deviation
    return F.log1p(F.exp(F.least(-1.5976 * z - 0.07056 * z * z * z, F.lit(600.0)))) / F.log(F.lit(10.0))


def thresholds(docs: DataFrame, text: str) -> DataFrame:
    """unit, and the greatest T that counts as random; one row for each of at most 15 units."""
    found = docs.select(F.explode(F.expr(_candidates(f"coalesce(`{text}`, '')"))).alias("c")).select("c.test.*")
    counted = found.groupBy("unit", "textual", F.round("t", 2).alias("t")).count()
    spread = counted.where("textual").groupBy("unit").agg(F.sum("count").alias("n"), (F.sum(F.col("t") * F.col("count")) / F.sum("count")).alias("mean"), F.sum(F.col("t") * F.col("t") * F.col("count")).alias("sq"))
    spread = spread.where(F.col("n") >= FEW).select("unit", "mean", F.greatest(F.sqrt(F.greatest(F.col("sq") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(0.25)).alias("deviation"))
    binned = counted.join(spread, "unit", "left").select("unit", "t", "count", _chance(F.col("t"), F.coalesce("mean", F.lit(MEAN)), F.coalesce("deviation", F.lit(DEVIATION))).alias("p"))
    bins = binned.groupBy("unit", F.least(F.floor(F.col("p") * FINE), F.lit(BINS)).alias("bin")).agg(F.sum("count").alias("n"), F.max("t").alias("t"))
    # step-up: the largest p with p <= RATE * (candidates at most p) / (all candidates)
    lists = bins.groupBy("unit").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n", "t")).alias("bins"))
    passed = F.expr(f"filter(bins, b -> power(10D, -b.bin / {FINE}D) <= {RATE}D * aggregate(filter(bins, c -> c.bin >= b.bin), 0L, (a, c) -> a + c.n) / `all`)")
    return lists.select("unit", F.array_max(F.transform(passed, lambda b: b["t"])).alias("most")).where("most is not null")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, found (array of start, kind, end, in order of start then kind) and, of the columns in ``keep``, a struct ``row``."""
    limits = {r["unit"]: r["most"] for r in thresholds(docs, text).collect()}  # at most 15 rows
    t = f"coalesce(`{text}`, '')"
    base = f"concat({_spans(t, ASSIGN, 0, 2, 6)}, {_spans(t, ACCESS, 1)}, {_spans(t, HEX, 2)})"
    rows = docs.select(docs[key].alias("key"), *[docs[f"`{c}`"].alias(f"kept_{i}") for i, c in enumerate(keep)], F.expr(base).alias("base"), F.expr(_candidates(t)).alias("more") if limits else F.expr("array()").alias("more"))
    if limits:
        most = "CASE x.test.unit " + " ".join(f"WHEN '{u}' THEN {m}D" for u, m in sorted(limits.items())) + " END"
        random = f"transform(filter(more, x -> round(x.test.t, 2) <= {most} AND NOT x.test.textual AND NOT exists(base, b -> b.start < x.end AND x.start < b.end)), x -> named_struct('start', x.start, 'kind', 3, 'end', x.end))"
        found = f"array_sort(concat(transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.end)), {random}))"
    else:
        found = "array_sort(transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.end)))"
    return rows.select(F.col("key").alias(key), *as_row(keep), F.expr(found).alias("found"))


def _listed(found: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({found}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    count = lambda k: F.expr(f"cast(size(filter(found, x -> x.kind = {k})) AS long)")
    return found.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("filter(found, x -> x.kind < 3)"), 256).alias("base_sha256"), _listed("found").alias("spans"))


def redact(text: str, found: str, mask: str = "[REDACTED]") -> Column:
    """The text with every span found replaced by the mask; overlapping spans become one.

    Spans are taken in blocks of ``BLOCK``, each over its own stretch of the text, and
    their pieces are joined once.
    """
    block = f"transform(sequence(0, (size({found}) - 1) div {BLOCK}), i -> slice({found}, cast(i * {BLOCK} + 1 AS int), {BLOCK}))"
    inner = f"""aggregate(blk, named_struct('at', p.base, 'out', cast(array() AS array<string>)),
        (acc, x) -> CASE WHEN x.start < acc.at THEN named_struct('at', greatest(acc.at, x.end), 'out', acc.out)
          ELSE named_struct('at', x.end, 'out', concat(acc.out, array(substring(p.part, acc.at - p.base + 1, x.start - acc.at), '{mask}'))) END)"""
    return F.expr(f"""CASE WHEN size({found}) = 0 THEN {text} ELSE aggregate({block}, named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (big, blk) -> transform(array(named_struct('base', big.at, 'part', substring({text}, big.at + 1, greatest(array_max(transform(blk, x -> x.end)) - big.at, 0)))),
          p -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(big.out, array(array_join(r.out, '')))))[0])[0],
        big -> concat(array_join(big.out, ''), substring({text}, big.at + 1))) END""")
