"""Secret scans: fixed formats, and random-looking strings found by a battery of tests.

Fixed formats are assignments of a value to a telling name, access key ids and long hexadecimal runs. Other
long runs of key characters are tested for randomness in the alphabet they seem to be encoded in: even use
of the alphabet (chi-squared), runs above and below the middle, and correlation of neighbours. Long texts
hold many long words, and a short run says little, so a run that passes must also win against
the corpus: its characters have to be so much likelier under an even alphabet than under the character
classes of all texts that, among all runs of its length class, the expected share of false finds stays below a rate.

Positions are code points. Nothing is found in null and empty texts; repeated rows are scanned alike and an
empty table gives an empty result; other columns do not matter. Only built-in column functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.workspace import materialise

KINDS = ("assign", "access", "hex", "random")
# The formats. A run of 16 (32) characters or more is what remains of all runs after the length check.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGNED = 8
# A run ends at an inner "=", as of NAME=value; what stands at the end of a run pads it.
_PAD = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
RUN = r"[A-Za-z0-9+/_-]{20,}" + _PAD
# What is tested of a run that fits no alphabet, as it holds signs of two: its parts between those of one of them.
PARTS = (r"[A-Za-z0-9_-]{20,}" + _PAD, r"[A-Za-z0-9+/]{20,}" + _PAD)

# Alphabets by what a run looks like, most special first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789",
           "sign": "+/_=-"}
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"

REJECTED = 0.001
"""A run is not random when the battery's corrected p-value is below this."""
FALSE_FINDS = 0.001
"""Accepted share of false finds in a length class."""
_RANDOM = KINDS.index("random")
_BINS = 4
_STRONGEST = 400


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Gap before, width and value of every match: the position follows from the gaps and widths before it."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.split(text, pattern, -1)
    found = F.transform(F.arrays_zip(whole.alias("w"), value.alias("v")), lambda m, at: F.struct(
        F.lit(kind).alias("kind"), F.length(F.get(gaps, at)).alias("gap"), F.length(m["w"]).alias("width"),
        (F.length(m["v"]) >= least).alias("good"),
        F.when(F.lit(kind == _RANDOM), m["w"]).alias("run")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(
        "array<struct<kind:int,gap:int,width:int,good:boolean,run:string>>"))


def _with_parts(runs: Column, split: int) -> Column:
    """Runs, with those of two alphabets replaced by their parts and a rest of no width, so that positions stay.

    The first way to split also gives the runs of one alphabet, the second one only passes over them.
    """
    kind = _RANDOM + split

    def pieces(run: Column) -> Column:
        # A match inside a run is told where the run begins; the rest brings the position to the end of the run.
        parts = F.transform(_matches(run["run"], _RANDOM, PARTS[split], 0, 0), lambda p, at: _piece(
            kind, p["gap"] + F.when(at == 0, run["gap"]).otherwise(0), p["width"], p["run"]))
        used = F.aggregate(parts, F.lit(0), lambda total, p: total + p["gap"] + p["width"])
        rest = F.array(_piece(kind, run["gap"] + run["width"] - used, F.lit(0), F.lit(None).cast("string")))
        one = F.array(_piece(kind, run["gap"], run["width"], run["run"] if split == 0 else F.lit(None).cast("string")))
        return F.when(run["run"].rlike("[+/]") & run["run"].rlike("[_-]"), F.concat(parts, rest)).otherwise(one)

    return F.flatten(F.transform(runs, pieces))


def _piece(kind: int, gap: Column, width: Column, run: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), gap.cast("int").alias("gap"), width.cast("int").alias("width"),
                    F.lit(True).alias("good"), run.alias("run"))


def _class_size(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by its logistic approximation (error below 0.0002)."""
    capped = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * capped + 0.07056 * capped * capped * capped))


def _both_tails(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))


def _alphabet(run: Column) -> Column:
    """The alphabet that a run seems to be encoded in, null if none."""
    cases = [(run.rlike(pattern), alphabet) for _, pattern, alphabet in ENCODINGS]
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


_SUMS = ("n", "total", "squares", "products", "ups", "changes", "first", "last", *[f"bin{b}" for b in range(_BINS)])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(bare: Column, alphabet: Column) -> Column:
    """What the battery needs of a run, gathered in one pass over its characters."""
    size = F.length(alphabet).cast("double")
    places = F.transform(F.split(bare, "(?!^)(?!$)"), lambda c: (F.position(c, alphabet) - 1).cast("double"))

    def step(s: Column, v: Column) -> Column:
        high, was_high = v * 2 >= size, s["last"] * 2 >= size
        one = lambda condition: F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
        begun = s["n"] > 0
        bins = [(s[f"bin{b}"] + one(F.floor(v * _BINS / size) == b)).alias(f"bin{b}") for b in range(_BINS)]
        return F.struct(
            (s["n"] + 1).alias("n"), (s["total"] + v).alias("total"), (s["squares"] + v * v).alias("squares"),
            (s["products"] + s["last"] * v).alias("products"), (s["ups"] + one(high)).alias("ups"),
            (s["changes"] + one(begun & (high != was_high))).alias("changes"),
            F.when(begun, s["first"]).otherwise(v).alias("first"), v.alias("last"), *bins)

    none = F.struct(*[F.lit(0.0).alias(name) for name in _SUMS])
    return F.aggregate(places, none, step)


def _battery(s: Column, size: Column) -> Column:
    """Corrected p-value from the sums of a run in an alphabet of some size."""
    n, average = s["n"], s["total"] / s["n"]
    # Bins of an alphabet that they do not divide differ by a character.
    begins = [F.ceil(size * b / _BINS) for b in range(_BINS + 1)]
    expected = [n * (begins[b + 1] - begins[b]) / size for b in range(_BINS)]
    chi = reduce(lambda a, b: a + b, [F.pow(s[f"bin{b}"] - expected[b], F.lit(2.0)) / expected[b] for b in range(_BINS)])
    freedom = _BINS - 1
    even = _normal_tail((F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom)))
    ups, downs = s["ups"], n - s["ups"]
    mean = 1 + 2 * ups * downs / n
    spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
    runs = F.when((ups == 0) | (downs == 0), F.lit(0.0)).otherwise(_both_tails((s["changes"] + 1 - mean) / spread))
    variance = s["squares"] - n * average * average
    # Products of neighbours about the average: every place but the last has one behind it.
    together = s["products"] - average * (2 * s["total"] - s["first"] - s["last"]) + (n - 1) * average * average
    serial = F.when(variance <= 1e-9, F.lit(0.0)).otherwise(_both_tails((together / variance + 1 / n) * F.sqrt(n)))
    return F.least(F.lit(1.0), 3 * F.least(even, runs, serial))


def _tested(run: Column) -> Column:
    """The battery's p-value of a bare run and its alphabet."""
    return _bound(_sums(run["bare"], run["alphabet"]), lambda s: _battery(s, F.length(run["alphabet"]).cast("double")))


def _bare(run: Column) -> Column:
    return F.regexp_replace(run, "=+$", "")


def randomness(run: Column) -> Column:
    """Corrected p-value of the battery: small when a run is not random in its alphabet. The cost follows the length."""
    return _bound(F.struct(_bare(run).alias("bare"), _alphabet(run).alias("alphabet")), lambda r: F.when(
        F.length(r["bare"]) > 1, _tested(r)))


def _measured(run: Column) -> Column:
    """Length, alphabet size, characters of every class, and the battery's p-value of a run; null if it is not tested."""
    tested = run.rlike("[0-9]") & run.rlike("[A-Za-z]") & ~run.rlike(UUID)
    return F.when(tested, _bound(F.struct(_bare(run).alias("bare"), _alphabet(run).alias("alphabet")), lambda r: F.when(
        r["alphabet"].isNotNull(), F.struct(
            F.length(run).alias("width"), F.length(r["bare"]).alias("n"), F.length(r["alphabet"]).alias("size"),
            *[_class_size(r["bare"], chars).alias(name) for name, chars in CLASSES.items()],
            _tested(r).alias("p")))))


def _advantage(run: Column, shares: dict[str, float]) -> Column:
    """Log likelihood of an even alphabet over that of characters by the classes of the corpus, of a measured run."""
    even = -F.log(run["size"].cast("double")) * run["n"]
    corpus = reduce(lambda a, b: a + b, [run[name] * math.log(shares[name] / len(chars)) for name, chars in CLASSES.items()])
    return even - corpus


def _thresholds(runs: DataFrame, rate: float) -> DataFrame:
    """Least advantage per length class at which the expected share of false finds is at most `rate`.

    A text-like run reaches an advantage of l with a chance of exp(-l) at most, so of m runs m exp(-l) do.
    """
    counts = runs.groupBy("length_class", "level").agg(F.count("*").alias("n"))
    within = W.partitionBy("length_class")
    reached = F.sum("n").over(within.orderBy(F.col("level").desc()))
    marked = counts.select("length_class", "level", reached.alias("reached"), F.sum("n").over(within).alias("m"))
    return marked.filter(F.col("m") * F.exp(-F.col("level").cast("double")) <= rate * F.col("reached")) \
        .groupBy("length_class").agg(F.min("level").alias("least_level"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FALSE_FINDS) -> DataFrame:
    """One row per document: its spans, as structs of start, kind and end in the order of the text."""
    content = F.coalesce(docs[text], F.lit(""))
    found = F.concat(
        _matches(content, 0, ASSIGN, 2, ASSIGNED), _matches(content, 1, ACCESS, 0, 0),
        _matches(content, 2, HEX, 0, 0))
    matched = docs.select(
        docs[key].alias("_id"), found.alias("_base"), _matches(content, _RANDOM, RUN, 0, 0).alias("_runs"),
        *[_class_size(content, chars).alias(f"_{name}") for name, chars in CLASSES.items()])
    # Runs are tested where their text is read, before anything is shuffled; the runs themselves go no further.
    parts = F.concat("_base", _with_parts(F.col("_runs"), 0), _with_parts(F.col("_runs"), 1))
    measured = F.transform(parts, lambda m: F.struct(
        m["kind"].alias("kind"), m["gap"].alias("gap"), m["width"].alias("width"), m["good"].alias("good"), _measured(m["run"]).alias("run")))
    rows = materialise(matched.select(
        "_id", F.monotonically_increasing_id().alias("_row"), measured.alias("_found"), *[f"_{name}" for name in CLASSES]))
    totals = rows.agg(*[F.coalesce(F.sum(f"_{name}"), F.lit(0)).alias(name) for name in CLASSES]).first().asDict()
    every = sum(totals.values()) + len(totals)
    shares = {name: (n + 1) / every for name, n in totals.items()}

    each = rows.select("_id", "_row", F.posexplode_outer("_found").alias("_at", "_match")).select("_id", "_row", "_at", "_match.*")
    before = W.partitionBy("_row", "kind").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("width")).over(before), F.lit(0)) + F.col("gap")
    spans = each.withColumn("start", start).withColumn("end", F.col("start") + F.col("width"))
    is_base = F.col("good") & (F.col("kind") < KINDS.index("random"))
    base_end, base_start = F.when(is_base, F.col("end")), F.when(is_base, F.col("start"))
    row = W.partitionBy("_row").orderBy("start", "kind")
    covered = F.coalesce(F.max(base_end).over(row.rowsBetween(W.unboundedPreceding, -1)) > F.col("start"), F.lit(False)) \
        | F.coalesce(F.min(base_start).over(row.rowsBetween(1, W.unboundedFollowing)) < F.col("end"), F.lit(False))
    run = F.col("run")
    spans = materialise(spans.withColumn("covered", covered).withColumns({
        "length_class": F.floor(F.log2(run["width"].cast("double")) * 2).cast("int"),
        "advantage": _advantage(run, shares), "p_random": run["p"],
    }).withColumn("level", F.floor(F.least(F.greatest(F.col("advantage"), F.lit(0.0)), F.lit(float(_STRONGEST)))).cast("int")).drop("run"))
    least = _thresholds(spans.filter("length_class is not null"), rate)
    wins = F.col("least_level").isNotNull() & (F.col("level") >= F.col("least_level")) & (F.col("p_random") >= REJECTED)
    chosen = spans.join(least, "length_class", "left").withColumn(
        "chosen", F.coalesce(is_base | (wins & ~F.col("covered")), F.lit(False)))
    # Of overlapping parts those of the first way to split stay; all parts become random spans.
    is_first = F.col("chosen") & (F.col("kind") == _RANDOM)
    meets = F.coalesce(F.max(F.when(is_first, F.col("end"))).over(row.rowsBetween(W.unboundedPreceding, -1)) > F.col("start"), F.lit(False)) \
        | F.coalesce(F.min(F.when(is_first, F.col("start"))).over(row.rowsBetween(1, W.unboundedFollowing)) < F.col("end"), F.lit(False))
    stays = chosen.withColumn("chosen", F.col("chosen") & ~((F.col("kind") > _RANDOM) & meets))
    span = F.when(F.col("chosen"), F.struct(F.col("start").cast("bigint").alias("start"), F.least("kind", F.lit(_RANDOM)).alias("kind"),
                                            F.col("end").cast("bigint").alias("end")))
    return stays.groupBy("_row", "_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).select(F.col("_id").alias(key), "spans")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def spelled(spans: Column) -> Column:
    """Spans as text, `kind:start:end` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < KINDS.index("random"))
