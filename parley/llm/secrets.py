"""Secret scans with a randomness test battery, in DataFrame operations only.

Base patterns give spans of known shapes. Beyond these, every long run of token characters is a candidate: its encoding
is inferred from its alphabet, and the battery tests it under that encoding for uniformity (chi-squared), runs about the
middle of the alphabet, and serial correlation; Fisher's method combines the three. The battery's last test has names and
words of the encoding as its null: the likelihood ratio of uniform symbols to the successions of characters in the
corpus' own words, taken to the encoding's alphabet, whose inverse bounds the p-value (Markov). Within each stratum of
encoding and length, Benjamini-Hochberg over the candidates of all documents sets the p-value up to which candidates
that pass the battery against uniform symbols are reported.

Texts are read where they lie; only counts per (encoding, length, p) bin and per pair of characters in words, at most a
few thousand rows each, reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stage

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates: runs of at least this many of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Encodings by what they consist of, smallest first, with their alphabets.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("hex", "^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("hex-upper", "^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    ("base36", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("base36-upper", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("letters", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64-url", "^[A-Za-z0-9+/_=-]+$", _UPPER + _LOWER + _DIGITS + "+/_=-"),
)
#: Changes of class per character in general successions, false-discovery rate, least p of the battery, bins.
CHANGE_RATE, FALSE_DISCOVERIES, LEAST_RANDOM_P, MOST_BIN = 0.15, 0.01, 1e-3, 80
#: Weight of the general successions beside a character's own: pairs, and share of its own where that is more, so that
#: changes of class, as in names of several words, stay possible however many words a table has.
PRIOR, PRIOR_SHARE = 200, 0.03
#: All token characters; the general succession stays in a class but for CHANGE_RATE, letters by their frequency in 10,000.
SYMBOLS = _UPPER + _LOWER + _DIGITS + "+/_=-"
_LETTERS = dict(zip(_LOWER, (820, 150, 280, 430, 1270, 220, 200, 610, 700, 20, 80, 400, 240, 670, 750, 190, 10, 600, 630, 910, 280, 100, 240, 20, 200, 10)))
#: Partial sums are taken over blocks of this size, so that their cost stays linear in the number of matches.
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """Sums of the values before each value."""
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))

    def sums(block: Column) -> Column:
        return F.aggregate(block, zero, lambda acc, x: F.struct((acc["s"] + x).cast("bigint").alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))

    def join(inner: Column) -> Column:
        before = sums(F.transform(inner, lambda b: b["s"]))["a"]
        return F.flatten(F.zip_with(inner, before, lambda b, o: F.transform(b["a"], lambda v: v + o)))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    return let(F.transform(blocks, sums), join)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as array<struct<s, e, body>>: code points, and the text of the group.

    The pieces between matches and the matches themselves are laid end to end; a text without a match is scanned once and
    not copied.
    """
    none = F.array().cast("array<struct<s:bigint,e:bigint,body:string>>")

    def place(pieces: Column) -> Column:
        def spans(found: Column) -> Column:
            sizes = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: (F.length(p) + F.length(f)).cast("bigint"))
            return F.zip_with(
                F.arrays_zip(_running(sizes).alias("o"), sizes.alias("n")),
                F.arrays_zip(found.alias("f"), (found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), group)).alias("g")),
                lambda at, m: F.struct((at["o"] + at["n"] - F.length(m["f"])).alias("s"), (at["o"] + at["n"]).alias("e"), m["g"].alias("body")),
            )

        return let(F.regexp_extract_all(text, F.lit(pattern), 0), spans)

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), place)).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """Standard normal upper tail, by a rational approximation of absolute error below 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * (1 / math.sqrt(2 * math.pi)) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _battery(body: Column, alphabet: Column, places: Column) -> Column:
    """Fisher's combined p of the three tests of a token against uniform symbols of its alphabet."""
    n, k = F.length(body).cast("double"), F.length(alphabet).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0))))
    chi, df = squares * k / n - n, k - 1
    p_uniform = _upper_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    sums = F.aggregate(
        places,
        F.struct(*[F.lit(0.0).alias(c) for c in ("x", "xx", "xy", "high", "turns")], F.lit(-1.0).alias("last"), F.lit(0.0).alias("first")),
        lambda a, x: F.struct(
            (a["x"] + x).alias("x"),
            (a["xx"] + x * x).alias("xx"),
            F.when(a["last"] < 0, a["xy"]).otherwise(a["xy"] + a["last"] * x).alias("xy"),
            (a["high"] + F.when(x >= k / 2, 1.0).otherwise(0.0)).alias("high"),
            F.when(a["last"] < 0, 1.0).otherwise(a["turns"] + F.when((a["last"] >= k / 2) != (x >= k / 2), 1.0).otherwise(0.0)).alias("turns"),
            x.cast("double").alias("last"),
            F.when(a["last"] < 0, x.cast("double")).otherwise(a["first"]).alias("first"),
        ),
    )

    def combine(a: Column) -> Column:
        high, low = a["high"], n - a["high"]
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        p_runs = F.when((high == 0) | (low == 0), F.lit(1e-6)).otherwise(_two_sided((a["turns"] - mean) / spread))
        m, var = a["x"] / n, a["xx"] - a["x"] * a["x"] / n
        cross = a["xy"] - m * (2 * a["x"] - a["first"] - a["last"]) + (n - 1) * m * m
        p_serial = F.when(var <= 0, F.lit(1e-6)).otherwise(_two_sided((cross / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))
        half = -F.ln(F.greatest(p_uniform, F.lit(1e-30))) - F.ln(F.greatest(p_runs, F.lit(1e-30))) - F.ln(F.greatest(p_serial, F.lit(1e-30)))
        return F.exp(-half) * (1 + half + half * half / 2)

    return let(sums, combine)


def _general() -> list[list[float]]:
    """The general probability of each symbol after each symbol."""
    kinds = [_UPPER, _LOWER, _DIGITS, "+/_=-"]
    share = {c: (_LETTERS[c.lower()] if c.isalpha() else 1) for c in SYMBOLS}
    share = {c: share[c] / sum(share[x] for x in kind) for kind in kinds for c in kind}
    return [[share[b] * (1 - CHANGE_RATE if any(a in k and b in k for k in kinds) else CHANGE_RATE / 3) for b in SYMBOLS] for a in SYMBOLS]


def succession_table(counts: dict[str, int]) -> list[float]:
    """For encoding e and symbols a, b, at (e * symbols + a) * symbols + b: log of uniform over words' probability of b
    after a, in the encoding; 0 where either isn't in it. counts has pairs of characters in words."""
    at = {c: i for i, c in enumerate(SYMBOLS)}
    own = dict.fromkeys(SYMBOLS, 0)
    for pair, n in counts.items():
        own[pair[0]] += n
    weights = [[max(PRIOR, PRIOR_SHARE * own[a]) * p for p in row] for a, row in zip(SYMBOLS, _general())]
    for pair, n in counts.items():
        weights[at[pair[0]]][at[pair[1]]] += n
    out = []
    for _, _, alphabet in ENCODINGS:
        places = [at[c] for c in alphabet]
        table = [[0.0] * len(SYMBOLS) for _ in SYMBOLS]
        for a in places:
            total = sum(weights[a][b] for b in places)
            for b in places:
                table[a][b] = math.log(total / (weights[a][b] * len(places)))
        out += [x for row in table for x in row]
    return out


def word_pairs(docs: DataFrame, text_col: str) -> dict[str, int]:
    """How many distinct words of all texts, runs of token characters too short for a candidate, have each pair of
    characters, by place. Words are made distinct by a shuffle; a row for each pair reaches the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(docs[f"`{text_col}`"], F.lit("[A-Za-z0-9+/_=-]{2,}"), 0)).alias("w")).where("length(w) < 20").distinct()
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}


def _encoding(body: Column) -> Column:
    out = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(body.rlike(ENCODINGS[i][1]), i).otherwise(out)
    return out


def _candidates(runs: Column, table: list[float]) -> Column:
    """array<struct<s, e, enc, size, bin, random>> of the candidate runs (s, e, body): the step of their p-value, and whether
    they pass the battery against uniform symbols."""
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])
    size = len(SYMBOLS)
    ratios = F.split(F.lit(",".join(f"{x:.4g}" for x in table)), ",").cast("array<double>")

    def judge(m: Column) -> Column:
        def coded(x: Column) -> Column:
            body, enc = x["body"], x["enc"]
            alphabet = F.element_at(alphabets, enc + 1)
            places = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double") - 1)
            n = F.length(body).cast("double")
            codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
            gain = F.aggregate(
                codes,
                F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
                lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(ratios, (enc * size + acc["last"]) * size + c)).alias("sum")),
                lambda acc: F.greatest(acc["sum"], F.lit(0.0)),
            )
            # -2 log10 p, in whole steps
            step = F.least(F.floor(gain * (2 / math.log(10))), F.lit(MOST_BIN)).cast("int")
            return F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                enc.alias("enc"),
                F.least(F.floor(2 * F.log2(n)), F.lit(40)).cast("int").alias("size"),
                step.alias("bin"),
                F.when(step > 0, _battery(body, alphabet, places) >= LEAST_RANDOM_P).otherwise(F.lit(False)).alias("random"),
            )

        trimmed = F.regexp_replace(m["body"], "=+$", "")
        body = F.when(F.length(trimmed) >= 2, trimmed).otherwise(m["body"])
        return let(F.struct(m["s"].alias("s"), m["e"].alias("e"), body.alias("body"), _encoding(body).alias("enc")), coded)

    return F.transform(runs, judge)


def _base(assigned: Column, runs: Column) -> Column:
    """array<struct<s, kind, e>> of the base spans in order of start, then kind. Matches of ACCESS and HEX lie within candidate
    runs, whose characters and lengths include theirs, so only these are searched for them."""
    span = "array<struct<s:bigint,kind:int,e:bigint>>"

    def of(kind: int, matches: Column, shift: Column) -> Column:
        return F.transform(matches, lambda m: F.struct((shift + m["s"]).alias("s"), F.lit(kind).alias("kind"), (shift + m["e"]).alias("e"))).cast(span)

    long = F.filter(assigned, lambda m: F.length(m["body"]) >= 6)
    within = F.flatten(F.transform(runs, lambda r: F.concat(of(1, _matches(r["body"], ACCESS), r["s"]), of(2, _matches(r["body"], HEX), r["s"]))))
    return F.array_sort(F.concat(of(0, long, F.lit(0).cast("bigint")), within))


def _scan(docs: DataFrame, keep: list[Column], text_col: str, table: list[float]) -> DataFrame:
    """keep, with _base and _cand of every text, which is scanned for two patterns only."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    found = docs.select(*keep, _matches(text, ASSIGN, 2).alias("_assigned"), _matches(text, CANDIDATE).alias("_runs"))
    return found.select("*", _base(F.col("_assigned"), F.col("_runs")).alias("_base"), _candidates(F.col("_runs"), table).alias("_cand")).drop("_assigned", "_runs")


def thresholds(counts: list[tuple[int, int, int, bool, int]], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Least reported bin by stratum (enc * 64 + size), by Benjamini-Hochberg over (enc, size, bin, random, n).

    All candidates of a stratum count as tests; those that the battery rejects count as not significant.
    """
    tests: dict[int, int] = defaultdict(int)
    found: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for enc, size, step, random, n in counts:
        tests[enc * 64 + size] += n
        if random:
            found[enc * 64 + size][step] += n
    out = {}
    for stratum, bins in found.items():
        total = 0
        for step in sorted(bins, reverse=True):
            total += bins[step]
            if 10 ** (-step / 2) * tests[stratum] <= rate * total:
                out[stratum] = step
    return out


def _report(limits: dict[int, int]) -> Column:
    """Candidates of _cand that are reported: beyond their stratum's limit, and apart from base spans."""
    if not limits:
        return F.array().cast("array<struct<s:bigint,kind:int,e:bigint>>")
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    strong = F.filter("_cand", lambda c: c["random"] & F.coalesce(c["bin"] >= F.try_element_at(table, c["enc"] * 64 + c["size"]), F.lit(False)))
    apart = F.filter(strong, lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return F.transform(apart, lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("kind"), c["e"].alias("e"))).cast("array<struct<s:bigint,kind:int,e:bigint>>")


def _limits(scanned: DataFrame) -> dict[int, int]:
    cells = scanned.select(F.explode("_cand").alias("c")).groupBy("c.enc", "c.size", "c.bin", "c.random").count().collect()
    return thresholds([tuple(r) for r in cells])


def _join(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs.

    A null or empty text has no spans; texts are scanned whole, however long; null ids and repeated rows are kept as they
    are; equal texts have equal spans; an empty table gives an empty result; other columns are ignored, whatever their
    names. Spans are kind:start:end in code points, end exclusive.
    """
    scanned = stage(_scan(docs, [docs[f"`{id_col}`"].alias("_id")], text_col, succession_table(word_pairs(docs, text_col))), "secrets")

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda b: b["kind"] == kind)).cast("bigint")

    return scanned.select(
        F.col("_id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_join(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _join(F.array_sort(F.concat("_base", _report(_limits(scanned))))).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by the mark; overlapping spans get one mark. Rows without spans stay as they are.

    Keeps docs' columns, whatever their names, and all rows, also repeated ones and those with nulls; a null text stays
    null, an empty table gives an empty result. Where a text changes, n_chars, if docs has it, becomes its new length.

    Texts are scanned once: rows are staged with what was found, and the limits, which need all of it, are applied to that.
    """
    table = succession_table(word_pairs(docs, text_col))
    found = stage(_scan(docs, [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")], text_col, table), "secrets")
    spans = F.array_sort(F.concat("_base", _report(_limits(found))))
    text = F.col(f"_row.`{text_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def cut(acc: Column, x: Column) -> Column:
        before = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(x["s"] < acc["at"], acc["out"]).otherwise(before).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    clean = F.aggregate("_spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    found = found.select("_row", spans.alias("_spans")).withColumn("_clean", F.when(F.size("_spans") > 0, clean).otherwise(text))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("_clean").alias(c)
        if c == "n_chars":
            return F.when(F.size("_spans") > 0, F.length("_clean").cast(docs.schema[c].dataType)).otherwise(F.col("_row.n_chars")).alias(c)
        return F.col(f"_row.`{c}`").alias(c)

    return found.select(*map(column, docs.columns))
