"""Secret scan: fixed patterns and a battery of randomness tests, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickpath.llm.common import whole_text

# Kinds in their order, with the group whose length counts and the least length
KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # a shorter run can't hold a longer match: same as + and 16
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # same, + and 32
)
ADDED = "random"
#: What the battery looks at: runs of letters, digits and the signs of base64.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: encoding: (test, alphabet, skew of ordinary text over it). The skew is k * sum(q^2) - 1 for letter
#: frequencies q over an alphabet of k symbols: what each symbol of text adds to chi-squared.
ENCODINGS = {
    "digits": (r"^[0-9]+$", "0123456789", 0.3),
    "hex": (r"^[0-9a-f]+$", "0123456789abcdef", 1.0),
    "hex_upper": (r"^[0-9A-F]+$", "0123456789ABCDEF", 1.0),
    "lower": (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.7),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    "base36": (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.3),
    "base64": (r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
}
VETO = 3.0  # standard deviations at which the runs or the serial test calls a string ordered
BINS = 400  # of -10 log10(p); the last one takes all beyond


def _positions(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, value>> of the matches whose group has ``least`` characters.

    ``split`` and ``regexp_extract_all`` walk the same matches, so the lengths
    of pieces and matches add up to the places, in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    row = "start bigint, end bigint, value string"
    empty = F.array().cast(f"array<struct<{row.replace(' ', ':').replace(',:', ',')}>>")
    parts = F.arrays_zip(pieces.alias("piece"), found.alias("hit"), value.alias("value"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        match = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        fits = F.length(part["value"]) >= least
        return F.struct(end.alias("at"),
                        F.when(fits, F.concat(state["found"], F.array(match))).otherwise(state["found"]).alias("found"))

    walked = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found")), add,
                         lambda state: state["found"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _battery(value: Column) -> Column:
    """struct<encoding, length_class, bin> of one candidate string.

    Chi-squared of the symbol counts against equal shares is compared with what
    text of the same length would give: mean (k-1) + n*skew and variance
    2(k-1) + 4n*skew, so short strings cannot score high. p is the chance that
    text looks as even as this. A string whose runs about the middle of the
    alphabet, or whose neighbour correlation, lie beyond ``VETO`` is text: p 1.
    """
    encoding = F.coalesce(*[F.when(value.rlike(test), F.lit(name)) for name, (test, _, _) in ENCODINGS.items()])
    pick = F.create_map(*[F.lit(x) for name, (_, alphabet, skew) in ENCODINGS.items()
                          for x in (name, f"{alphabet}|{skew}")])
    spec = F.split(F.element_at(pick, encoding), r"\|")

    def with_spec(got: Column) -> Column:
        alphabet, skew, body = got["spec"][0], got["spec"][1].cast("double"), got["body"]
        k, n = F.length(alphabet).cast("double"), F.length(body).cast("double")
        index = F.transform(F.sequence(F.lit(1), F.length(body)),
                            lambda i: F.instr(alphabet, F.substr(body, i, F.lit(1))).cast("double"))
        return F.struct(got["encoding"].alias("encoding"), body.alias("body"), k.alias("k"), n.alias("n"),
                        skew.alias("skew"), index.alias("x"))

    def with_sums(got: Column) -> Column:
        x, n, k = got["x"], got["n"], got["k"]
        add = lambda a, b: a + b
        zero = F.lit(0.0)
        squares = F.aggregate(F.array_distinct(x), zero, lambda a, s: a + F.pow(
            F.size(F.filter(x, lambda y: y == s)).cast("double"), F.lit(2.0)))
        following = F.concat(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.lit(1)))
        pairs = F.zip_with(x, following, lambda a, b: a * b)
        high = F.transform(x, lambda y: F.when(y > k / 2, 1.0).otherwise(0.0))
        next_high = F.slice(high, F.lit(2), F.size(x) - 1)
        changes = F.zip_with(F.slice(high, F.lit(1), F.size(x) - 1), next_high, lambda a, b: F.abs(a - b))
        return F.struct(
            got["encoding"].alias("encoding"), n.alias("n"), k.alias("k"), got["skew"].alias("skew"),
            (k / n * squares - n).alias("chi"), F.aggregate(x, zero, add).alias("sum"),
            F.aggregate(x, zero, lambda a, b: a + b * b).alias("squares"),
            F.aggregate(pairs, zero, add).alias("lag"), F.aggregate(high, zero, add).alias("high"),
            (F.aggregate(changes, zero, add) + 1).alias("runs"))

    def judge(got: Column) -> Column:
        n, k, skew = got["n"], got["k"], got["skew"]
        z = (got["chi"] - (k - 1 + n * skew)) / F.sqrt(2 * (k - 1) + 4 * n * skew)
        p = 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))  # the normal distribution function
        low = n - got["high"]
        runs_mean = 2 * got["high"] * low / n + 1
        runs_var = (runs_mean - 1) * (runs_mean - 2) / (n - 1)
        runs_ok = (runs_var > 0) & (F.abs(got["runs"] - runs_mean) <= VETO * F.sqrt(F.greatest(runs_var, F.lit(0.0))))
        spread = n * got["squares"] - got["sum"] * got["sum"]
        serial = (n * got["lag"] - got["sum"] * got["sum"]) / F.nullif(spread, F.lit(0.0)) + 1 / (n - 1)
        serial_ok = F.coalesce(F.abs(serial) * F.sqrt(n) <= VETO, F.lit(False))
        score = F.when(runs_ok & serial_ok, F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300))))).otherwise(0)
        return F.struct(got["encoding"].alias("encoding"), F.floor(F.log2(n)).cast("int").alias("length_class"),
                        F.least(F.greatest(score, F.lit(0)), F.lit(BINS)).cast("int").alias("bin"))

    body = F.translate(F.regexp_replace(value, "=+", ""), "-_", "+/")
    start = F.struct(encoding.alias("encoding"), body.alias("body"), spec.alias("spec"))
    # a one-element transform names a value that later steps use several times
    steps = F.array(start)
    for step in (with_spec, with_sums, judge):
        steps = F.transform(steps, step)
    long_enough = F.length(F.regexp_replace(value, "=+", "")) >= 20
    nothing = F.struct(F.lit("none").alias("encoding"), F.lit(0).alias("length_class"), F.lit(0).alias("bin"))
    return F.when(long_enough, steps[0]).otherwise(nothing)


def _named(no: int, kind: str) -> Callable[[Column], Column]:
    """A match as the span struct, which sorts by start and then by kind."""
    return lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("no"), m["end"].alias("end"),
                              F.lit(kind).alias("kind"))


def _of_kind(no: int) -> Callable[[Column], Column]:
    return lambda s: s["no"] == no


def with_matches(docs: DataFrame) -> DataFrame:
    """docs with ``_base`` (pattern matches) and ``_tried`` (scored candidates)."""
    text = whole_text()
    base = F.concat(*[F.transform(_positions(text, pattern, group, least), _named(no, name))
                      for no, (name, pattern, group, least) in enumerate(KINDS)])
    tried = F.transform(_positions(text, CANDIDATE, 0, 20), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), _battery(m["value"]).alias("test")))
    return docs.withColumn("_base", F.array_sort(base)).withColumn("_tried", tried)


def thresholds(matches: DataFrame, rate: float = 0.01) -> dict[tuple[str, int], int]:
    """The least bin that counts as a secret, by encoding and length class.

    Benjamini-Hochberg at ``rate`` within each class, over the candidates of
    all documents: the largest p with p <= rate * (candidates at p or below) /
    candidates. Every p is taken at the upper end of its bin. What reaches the
    driver has at most one row per encoding and power of two of the length.
    """
    counts = (matches.select(F.explode("_tried.test").alias("t")).where("t.bin >= 0")
              .groupBy("t.encoding", "t.length_class", "t.bin").agg(F.count(F.lit(1)).alias("n")))
    a_class = Window.partitionBy("encoding", "length_class")
    at_or_below = a_class.orderBy(F.col("bin").desc())
    passing = (counts.withColumn("_all", F.sum("n").over(a_class))
               .withColumn("_rank", F.sum("n").over(at_or_below))
               .where(F.pow(F.lit(10.0), -F.col("bin") / 10.0) <= rate * F.col("_rank") / F.col("_all"))
               .where("bin > 0 AND encoding != 'none'")
               .groupBy("encoding", "length_class").agg(F.min("bin").alias("bin")))
    return {(e, c): b for e, c, b in passing.collect()}


def with_spans(matches: DataFrame, least: dict[tuple[str, int], int]) -> DataFrame:
    """``_spans``: the pattern matches, and the candidates that pass and lie in none of them."""
    key = lambda t: F.concat_ws(":", t["encoding"], t["length_class"].cast("string"))
    table = F.create_map(*[F.lit(x) for (e, c), b in least.items() for x in (f"{e}:{c}", b)]) if least else None
    base = F.col("_base")

    def passes(m: Column) -> Column:
        if table is None:
            return F.lit(False)
        random = m["test"]["bin"] >= F.coalesce(F.try_element_at(table, key(m["test"])), F.lit(BINS + 1))
        return random & ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))

    added = F.transform(F.filter("_tried", passes), _named(len(KINDS), ADDED))
    return matches.withColumn("_spans", F.array_sort(F.concat(base, added))).drop("_tried")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: str, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def scan(matches: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from stored matches.

    A null or empty text has no spans. Repeated rows are scanned each; spans of
    different kinds may overlap.
    """
    found = with_spans(matches, thresholds(matches, rate))
    counts = [F.size(F.filter("_base", _of_kind(no))).cast("bigint").alias(f"n_{name}")
              for no, (name, *_) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("_base"), 256).alias("base_sha256"),
                        joined("_spans").alias("spans"))


def mask_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """docs with all secrets in ``text`` masked and ``n_chars`` counted anew; no row goes."""
    columns = docs.columns
    least = thresholds(with_matches(docs.select("text")), rate)
    found = with_spans(with_matches(docs), least)
    hit = F.size("_spans") > 0
    text = masked(F.col("text"), "_spans")
    return (found.withColumn("_masked", text)
            .withColumn("n_chars", F.when(hit, F.length("_masked").cast(docs.schema["n_chars"].dataType))
                        .otherwise(F.col("n_chars")))
            .withColumn("text", F.col("_masked")).select(*columns))
